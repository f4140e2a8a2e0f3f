"""Language identification by rank-order profiles.

A profile is the ranked list of a language's most frequent letter n-grams (1 to 3 letters, words padded by a space). A
text's own ranked list is compared with each profile: an n-gram adds the difference of its two ranks, or the list's
full length if the profile lacks it; the smallest sum wins.

Defined results: null texts and texts without a letter are `und` with score 0, as are all texts when no profile could
be learned. Ties between languages go to the alphabetically first. Repeated rows are judged each by itself.
"""

from __future__ import annotations

import sys
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sedgewren.llm.common import fold, map_columns, prepare, spread, tidy
from sedgewren.session import table

UNDETERMINED = "und"
#: n-grams in a ranked list.
LIST = 300
#: Longest n-gram, in code points of 21 bits.
N = 3
#: Documents a language that profiles are learned from, about: a bound on the fit, whatever the corpus.
DOCS_PER_LANGUAGE = 600
#: Languages that are learned, at most.
LANGUAGES = 512
SPACE = 32


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """Code point to itself for letters and combining marks, to a space for all else."""
    out = np.full(sys.maxunicode + 1, SPACE, dtype=np.int64)
    for cp in range(sys.maxunicode + 1):
        if unicodedata.category(chr(cp))[0] in "LM":
            out[cp] = cp
    return out


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The packed n-grams of a text, ascending, and their counts; empty without a letter."""
    none = np.empty(0, np.int64)
    if not text:
        return none, none
    cps = letter_table()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    keep = np.empty(len(cps), bool)
    keep[0] = cps[0] != SPACE
    np.logical_or(cps[1:] != SPACE, cps[:-1] != SPACE, out=keep[1:])
    cps = cps[keep]
    if not len(cps) or (len(cps) == 1 and cps[0] == SPACE):
        return none, none
    cps = np.concatenate(([SPACE], cps, [SPACE])) if cps[-1] != SPACE else np.concatenate(([SPACE], cps))
    two = (cps[:-1] << 21) | cps[1:]
    three = (two[:-1] << 21) | cps[2:]
    return np.unique(np.concatenate((cps[cps != SPACE], two, three)), return_counts=True)


def ranked(codes: np.ndarray, counts: np.ndarray, length: int = LIST) -> np.ndarray:
    """The codes by falling count, ties by code."""
    return codes[np.argsort(-counts, kind="stable")[:length]]


@dataclass(frozen=True)
class Profiles:
    """languages: sorted; codes: all profiles' n-grams, ascending; ranks: of each in each language, length if lacking."""

    languages: tuple[str, ...]
    codes: np.ndarray
    ranks: np.ndarray
    length: int = LIST

    @staticmethod
    def of(lists: dict[str, list[int]], length: int = LIST) -> Profiles:
        languages = tuple(sorted(lists))
        codes = np.unique(np.array([c for x in lists.values() for c in x], dtype=np.int64))
        ranks = np.full((len(codes), len(languages)), length, dtype=np.int32)
        for k, lang in enumerate(languages):
            ranks[np.searchsorted(codes, lists[lang]), k] = np.arange(len(lists[lang]))
        return Profiles(languages, codes, ranks, length)

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and 1 less the mean out-of-place distance, as a share of the largest."""
        own = ranked(*grams(text), self.length)
        if not len(own) or not self.languages:
            return UNDETERMINED, 0.0
        at = np.searchsorted(self.codes, own)
        at[at == len(self.codes)] = 0
        hit = self.codes[at] == own
        places = np.arange(len(own))
        known = np.abs(self.ranks[at[hit]] - places[hit, None])
        known[self.ranks[at[hit]] == self.length] = self.length
        far = known.sum(axis=0) + self.length * int((~hit).sum())
        k = int(np.argmin(far))
        return self.languages[k], 1.0 - float(far[k]) / (self.length * len(own))


def _count_task():
    """Counts n-grams by language over a batch, so that few rows leave the worker."""

    def step(langs: list, texts: list):
        total: dict[tuple[str, int], int] = {}
        for lang, text in zip(langs, texts, strict=True):
            for code, count in zip(*map(np.ndarray.tolist, grams(text)), strict=True):
                total[lang, code] = total.get((lang, code), 0) + count
        return [k[0] for k in total], [k[1] for k in total], list(total.values())

    return step


def learn(docs: DataFrame, allowed, docs_per_language: int = DOCS_PER_LANGUAGE, length: int = LIST) -> Profiles:
    """Profiles from about docs_per_language documents of each language among the allowed rows with a language.

    Languages are counted over all rows, and the LANGUAGES most frequent ones are learned; a hash of the id then keeps each row with a chance of docs_per_language over
    its language's count. Only the ranked lists (length times the number of languages) reach the driver."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & allowed).select("doc_id", "lang", "text")
    sizes = rows.groupBy("lang").agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), "lang").limit(LANGUAGES)
    sample = rows.join(F.broadcast(sizes), "lang").where(spread(F.col("doc_id"), 5) < F.lit(docs_per_language) / F.col("_n"))
    counts = map_columns(sample.select("lang", "text"), _count_task, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    top = counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))).where(F.col("rank") <= length)
    lists: dict[str, list[int]] = {}
    for r in sorted(top.collect(), key=lambda r: (r["lang"], r["rank"])):
        lists.setdefault(r["lang"], []).append(r["code"])
    return Profiles.of(lists, length)


def identify(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of every row, in one pass without a shuffle."""

    def task():
        def step(ids: list, texts: list):
            found = [profiles.predict(t) for t in texts]
            return ids, [x[0] for x in found], [x[1] for x in found]

        return step

    return map_columns(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), task, "doc_id long, lang_pred string, score double")


#: Scores below it say that a text is like no learned language: one word over and over, shouted or garbled text.
LEAST = 0.4


def keep_identified(docs: DataFrame, profiles: Profiles, least: float = LEAST) -> DataFrame:
    """The rows whose language is determined, with a score of at least `least`; all columns as they are. Rows with a null
    or letterless text go; repeated rows are judged each by itself."""
    prepare(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            found = [profiles.predict(t) for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array([lang != UNDETERMINED and s >= least for lang, s in found], pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)


HELD_FOLD = (4, 2)


def learn_contract(docs: DataFrame) -> Profiles:
    return learn(docs, fold(F.col("doc_id"), HELD_FOLD[0]) != HELD_FOLD[1])


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, learn_contract(docs))
    return found.select("doc_id", (fold(F.col("doc_id"), HELD_FOLD[0]) == HELD_FOLD[1]).alias("held_out"), "lang_pred", "score")
