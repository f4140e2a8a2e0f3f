"""Evidence for search results: best window, matching words, and where the match is."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedgewren.functions.text import collapse_ws, stem, terms, truncate
from sedgewren.operators.analysis import MOST_WORDS, Words, hit_counts, map_texts


def hits(text: Column, query_terms: list[str]) -> Column:
    """How many terms of a text, repeats counted, are terms of the query."""
    return F.size(F.filter(terms(F.coalesce(text, F.lit(""))), lambda t: t.isin(query_terms)))


def topic_hit(topics: Column, query_terms: list[str]) -> Column:
    """Whether the first word of a topic is a term of the query."""
    return F.exists(F.coalesce(topics, F.array().cast("array<string>")), lambda t: F.split_part(t, F.lit("-"), F.lit(1)).isin(query_terms))


def _full(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def headline(title: Column, description: Column) -> Column:
    return F.concat_ws(" — ", _full(title), _full(description))


def match_place(head_hits: Column, excerpt_hits: Column, topics: Column, query_terms: list[str]) -> Column:
    """Where the match is: on the page, if its excerpt holds more of the query's terms than its head."""
    found = F.when(excerpt_hits > head_hits, "page").otherwise("title")
    return F.when(F.greatest(head_hits, excerpt_hits) > 0, found).when(topic_hit(topics, query_terms), "topic").otherwise("semantic")


def best_evidence(title: Column, description: Column, excerpt: Column, topics: Column, query_terms: list[str]) -> dict[str, Column]:
    """evidence and matched_in: the title and description, or the page's excerpt if it holds more of the query's terms.
    Without any hit, a topic or the meaning matched, and the description speaks for the entry."""
    head = headline(title, description)
    h, e = hits(head, query_terms), hits(excerpt, query_terms)
    text = F.when(F.greatest(h, e) == 0, F.coalesce(_full(description), _full(excerpt), title)).when(e > h, excerpt).otherwise(head)
    return {"evidence": F.coalesce(text, F.lit("")), "matched_in": match_place(h, e, topics, query_terms)}


def matched_in(rows: DataFrame, keep: tuple[str, ...], title: Column, description: Column, excerpt: Column, topics: Column, query_terms: list[str]) -> DataFrame:
    """The columns to keep, and matched_in of best_evidence, for a whole table."""
    counted = hit_counts(rows.withColumn("_topics", topics), (*keep, "_topics"), [headline(title, description), excerpt], query_terms)
    return counted.select(*keep, match_place(F.col("hits0"), F.col("hits1"), F.col("_topics"), query_terms).alias("matched_in"))


#: A run of the characters that words have holds one word, from its first letter or digit on.
WORD_CHARS = r"\p{L}\p{N}'+#.\-"


def near_words(query_terms: list[str]) -> str:
    """A pattern of what may lie before a word in its run (group 1), and words that may have a query term as their stem (group
    2). Stems keep all but a word's end, so other words need no analysis; those found do."""
    begin = "|".join("".join(f"\\x{{{ord(c):x}}}" for c in t[:-1]) for t in query_terms)
    return rf"(?<![{WORD_CHARS}])(['+#.\-]*+)((?=[\p{{L}}\p{{N}}])(?iu:{begin})[{WORD_CHARS}]*+)"


def highlight_words(text: Column, query_terms: list[str]) -> Column:
    """The words of a text whose stem is a query term."""
    if not query_terms:
        return F.when(text.isNotNull(), F.array().cast("array<string>"))
    found = F.regexp_extract_all(text, F.lit(near_words(query_terms)), F.lit(2))
    return F.filter(found, lambda w: stem(F.lower(w)).isin(query_terms))


#: Marks in texts that are cut into runs; what the texts hold of the mark itself is written as MARK!. No mark holds what words do.
MARK = "\ufdd0"


def highlight_runs(text: Column, query_terms: list[str]) -> Column:
    """The text as runs (text, match) in its order: a word matches if its stem is a query term, and all between two matching
    words is one run. Joined, the runs are the text. An empty or null text has none."""
    whole = F.coalesce(text, F.lit(""))
    run = lambda t, m: F.struct(t.alias("text"), m.alias("match"))
    if not query_terms:
        return F.filter(F.array(run(whole, F.lit(False))), lambda r: r["text"] != "")
    bare = lambda x: F.replace(F.replace(x, F.lit(MARK + "<"), F.lit("")), F.lit(MARK + ">"), F.lit(""))
    cut = lambda x: F.filter(F.split(x, f"(?={MARK}<)|(?<={MARK}>)"), lambda p: p != "")
    near = F.regexp_replace(F.replace(whole, F.lit(MARK), F.lit(MARK + "!")), near_words(query_terms), f"$1{MARK}<$2{MARK}>")
    hit = lambda x: F.coalesce(stem(F.lower(bare(x))).isin(query_terms), F.lit(False))
    sure = F.transform(cut(near), lambda x: F.when(F.startswith(x, F.lit(MARK + "<")) & ~hit(x), bare(x)).otherwise(x))
    return F.transform(cut(F.array_join(sure, "")), lambda x: run(F.replace(bare(x), F.lit(MARK + "!"), F.lit(MARK)), F.startswith(x, F.lit(MARK + "<"))))


def snippets(docs: DataFrame, id_col: str, text_col: str, query_terms: list[str], size: int = 240, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, snippet and the columns to keep: the first window of words, among every third, with most hits; the text's head without a hit."""
    width, asked = max(12, int(size / 6 + 0.5)), frozenset(query_terms)

    def make():
        words, known = Words(), {}

        def hit(w: bytes) -> int:
            found = known.get(w)
            if found is None:
                if len(known) >= MOST_WORDS:
                    known.clear()
                found = known[w] = int(words.of(w)[:1] != [] and words.of(w)[0] in asked)
            return found

        def step(texts: list):
            best, begins, sizes, pieces = [], [], [], []
            for text in texts:
                own = text.split(b" ")
                sums = np.cumsum([0, *map(hit, own)])
                starts = np.arange(0, max(0, len(own) - width) + 1, 3)
                scores = sums[np.minimum(starts + width, len(own))] - sums[starts]
                k = int(np.argmax(scores))
                best.append(int(scores[k]))
                begins.append(int(starts[k]))
                sizes.append(len(own))
                # without a hit the head is shown: so much of it that its own truncation is the whole text's
                pieces.append((b" ".join(own[starts[k] : starts[k] + width]) if scores[k] else text[: 4 * (size + 2)]).decode("utf-8", "replace" if scores[k] else "ignore"))
            return range(len(texts)), (best, begins, sizes, pieces)

        return step

    rows = docs.select(F.col(id_col).alias("doc_id"), *keep, collapse_ws(F.coalesce(F.col(text_col), F.lit(""))).alias("_t"))
    found = map_texts(rows, ("doc_id", *keep), [F.col("_t")], make, "_best long, _begin long, _size long, _piece string")
    piece = truncate(F.col("_piece"), size)
    framed = F.concat(F.when(F.col("_begin") > 0, "…").otherwise(""), piece, F.when(F.col("_begin") + width < F.col("_size"), "…").otherwise(""))
    return found.select("doc_id", *keep, F.when(F.col("_best") > 0, F.regexp_replace(framed, "……", "…")).otherwise(piece).alias("snippet"))
