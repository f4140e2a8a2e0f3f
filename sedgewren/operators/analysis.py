"""Text analysis of whole tables in Arrow batches: the tokens and terms of functions/text, a word's remembered once met.

The expressions of functions/text are evaluated anew for each word of each text; here a text is cleaned as a whole, and what
a cleaned word stands for is looked up. Tests hold both to the same results."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from sedgewren.functions.text import STOP_WORDS
from sedgewren.session import bound_batches

#: Words that a worker remembers at most, and rows of a batch that it hands on.
MOST_WORDS, PIECE_ROWS = 100_000, 1 << 16
_STOPS = frozenset(STOP_WORDS)
_ADDRESS = re.compile(rb"https?://[^ \t\n\x0b\f\r]+")
_KEPT = bytes(c if chr(c) in "abcdefghijklmnopqrstuvwxyz0123456789+#.-" else 32 for c in range(256))


def cleaned(text: bytes) -> list[bytes]:
    """The words of a text in UTF-8: lower case, without addresses, of the characters that tokens have.

    Beyond ASCII only two characters have a lower case that holds ASCII; all others end a word."""
    low = text.lower()
    if not low.isascii():
        low = low.replace(b"\xc4\xb0", b"i\xcc\x87").replace(b"\xe2\x84\xaa", b"k")
    if b"http" in low:
        low = _ADDRESS.sub(b" ", low)
    return low.translate(_KEPT).split()


def tokens_of(word: bytes) -> tuple[str, ...]:
    """The tokens of a cleaned word, as tokenize has them."""
    t = word.strip(b".-").decode()
    if not 1 < len(t) < 32:
        return ()
    whole = () if t in _STOPS else (t,)
    return (*whole, *(p for p in t.split("-") if len(p) > 1 and p not in _STOPS)) if "-" in t else whole


def stem(w: str) -> str:
    """The stem of a token: most end in a letter that no rule is about."""
    if w[-1] == "s" and len(w) > 4:
        if w[-3:] == "ies" and len(w) > 5:
            w = w[:-3] + "y"
        elif w[-4:] == "sses" or (w[-2:] == "es" and len(w) > 5):
            w = w[:-2]
        elif w[-2:] != "ss":
            w = w[:-1]
    if w[-1] in "gdy" and len(w) > 5:
        for ending, least in (("ingly", 9), ("edly", 8), ("ing", 7), ("ed", 6)):
            if w.endswith(ending) and len(w) >= least:
                return w[: -len(ending)]
    return w


class Words(dict):
    """What cleaned words stand for: the token, or its stem; several (as a tuple) where they have hyphens; or nothing.

    Words that were met of late stay known: once MOST_WORDS are, those not met since the last time are forgotten."""

    def __init__(self, stemmed: bool = True) -> None:
        super().__init__()
        self.stemmed, self.older = stemmed, {}

    def __missing__(self, word: bytes) -> str | tuple[str, ...]:
        found = self.older.get(word)
        if found is None:
            if b"-" in word:
                found = tokens_of(word)
                found = tuple(map(stem, found)) if self.stemmed else found
            else:
                t = word.strip(b".").decode()
                found = "" if not 1 < len(t) < 32 or t in _STOPS else stem(t) if self.stemmed else t
        if len(self) >= MOST_WORDS:
            self.older = dict(self)
            self.clear()
        self[word] = found
        return found

    def of(self, text: bytes | None) -> list[str]:
        if not text:
            return []
        found = list(filter(None, map(self.__getitem__, cleaned(text))))
        if b"-" in text and tuple in set(map(type, found)):
            found = list(chain.from_iterable((x,) if type(x) is str else x for x in found))
        return found


def map_texts(rows: DataFrame, keep: tuple[str, ...], texts: list[Column], make: Callable[[], Callable], ddl: str) -> DataFrame:
    """The columns to keep, and those of ddl. make() runs once a task and gives a function from lists of texts (UTF-8 or None)
    to the places of the rows that its results belong to, and the columns of these."""
    bound_batches(rows.sparkSession)
    asked = rows.select(*keep, *[t.cast("binary").alias(f"_text{k}") for k, t in enumerate(texts)])
    made = _parse_datatype_string(ddl)
    schema, new, n = StructType([*(asked.schema[c] for c in keep), *made]), list(to_arrow_schema(made)), len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            if not batch.num_rows:
                continue
            at, columns = step(*[batch.column(k).to_pylist() for k in range(n, batch.num_columns)])
            at = pa.array(at, pa.int64())
            held = [batch.column(k).take(at) for k in range(n)]
            fields = [batch.schema.field(k) for k in range(n)]
            whole = pa.RecordBatch.from_arrays([*held, *(pa.array(c, f.type) for c, f in zip(columns, new, strict=True))], schema=pa.schema([*fields, *new]))
            for lo in range(0, whole.num_rows, PIECE_ROWS):
                yield whole.slice(lo, PIECE_ROWS)

    return asked.mapInArrow(run, schema)


def repeats(rows: DataFrame, id_col: str) -> bool:
    """Whether an id has several rows: only then what is made of a row needs to be summed up by id."""
    return not rows.groupBy(id_col).count().where("count > 1").isEmpty()


def places(sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Of runs of these sizes: the run of each member, and its place in it from 0."""
    n = np.array(sizes, np.int64)
    at = np.repeat(np.arange(len(n)), n)
    return at, np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)


def tokens(docs: DataFrame, id_col: str, text: Column) -> DataFrame:
    """The id, pos (from 1) and token of each token."""

    def make() -> Callable:
        words = Words(stemmed=False)

        def step(texts: list):
            found = [words.of(t) for t in texts]
            at, place = places([len(x) for x in found])
            return at, (place + 1, list(chain.from_iterable(found)))

        return step

    return map_texts(docs, (id_col,), [text], make, "pos long, token string")


def bigrams(docs: DataFrame, id_col: str, text: Column) -> DataFrame:
    """The id, pos (from 1), a and b of each two terms in succession."""

    def make() -> Callable:
        words = Words()

        def step(texts: list):
            found = [words.of(t) for t in texts]
            at, place = places([max(0, len(x) - 1) for x in found])
            return at, (place + 1, list(chain.from_iterable(x[:-1] for x in found)), list(chain.from_iterable(x[1:] for x in found)))

        return step

    return map_texts(docs, (id_col,), [text], make, "pos long, a string, b string")


def joined_terms(docs: DataFrame, id_col: str, text: Column) -> DataFrame:
    """The id and the terms of each text, a blank between them; null without a text."""

    def make() -> Callable:
        words = Words()
        return lambda texts: (range(len(texts)), ([None if t is None else " ".join(words.of(t)) for t in texts],))

    return map_texts(docs, (id_col,), [text], make, "terms string")


def term_counts(docs: DataFrame, id_col: str, text: Column) -> DataFrame:
    """The id, term and n of each row's distinct terms; rows that share an id aren't summed up."""

    def make() -> Callable:
        words = Words()

        def step(texts: list):
            found = [Counter(words.of(t)) for t in texts]
            at, _ = places([len(x) for x in found])
            return at, (list(chain.from_iterable(found)), list(chain.from_iterable(x.values() for x in found)))

        return step

    return map_texts(docs, (id_col,), [text], make, "term string, n long")


def hit_counts(rows: DataFrame, keep: tuple[str, ...], texts: list[Column], query_terms: list[str]) -> DataFrame:
    """The columns to keep, and hits0, hits1 ...: how many terms of each text, repeats counted, are terms of the query."""
    asked = frozenset(query_terms)

    def make() -> Callable:
        words = Words()
        count = lambda t: sum(x in asked for x in words.of(t))
        return lambda *texts: (range(len(texts[0])), [[count(t) for t in column] for column in texts])

    return map_texts(rows, keep, texts, make, ", ".join(f"hits{k} long" for k in range(len(texts))))
