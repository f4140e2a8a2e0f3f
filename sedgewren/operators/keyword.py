"""Field-weighted BM25 over postings with shortened-prefix keys."""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sedgewren.functions.text import prefix_key, terms
from sedgewren.operators.analysis import Words, map_texts, places, repeats

#: Fixed values of the ranking.
K1, B, PREFIX_FACTOR = 1.4, 0.75, 0.35
#: Queries of more characters than this may be boosted, where a headline or only the text holds them.
BOOST_OVER, MOST_BOOST, TEXT_BOOST = 4, 1.6, 1.25
#: Decimals of a score: sums that come in another order, as after a lost executor, give the same ranks.
PLACES = 12
#: Hundredths of a field's weight, and of its prefix keys.
FIELD_WEIGHTS = {"search_text": (100, 35), "title": (340, 119), "description": (240, 84), "domain": (220, 77), "topics": (200, 70)}


def postings(docs: DataFrame, id_col: str, fields: dict[str, Column], keys: DataFrame | None = None, carry: tuple[str, ...] = (), sized: bool = False) -> DataFrame:
    """doc_id, the columns to carry (of a document), term, tf (hundredths): one pass over all fields, which is summed up by a
    shuffle only where rows share an id. sized: also len, the tokens of search_text, and a row for each document by itself,
    without a term and with tf 1.

    With keys (a query's handful, broadcast) only their postings are made, and no others are shuffled."""
    names = list(fields)
    weights = [FIELD_WEIGHTS[name] for name in names]

    def make():
        words = Words()

        def step(*texts: list):
            sizes, lens, found, tfs = [], [], [], []
            for row in zip(*texts, strict=True):
                size, tf = 1, {}
                for name, (whole, prefix), text in zip(names, weights, row, strict=True):
                    own = words.of(text)
                    if name == "search_text":
                        size = max(1, len(own))
                    for t, n in Counter(own).items():
                        tf[t] = tf.get(t, 0) + n * whole
                        if len(t) > 6:
                            key = "~" + t[:6]
                            tf[key] = tf.get(key, 0) + n * prefix
                if sized:
                    tf[None] = 1
                sizes.append(len(tf))
                lens.append(size)
                found.extend(tf)
                tfs.extend(tf.values())
            at, _ = places(sizes)
            return at, (np.array(lens, np.int64)[at], found, tfs)

        return step

    rows = docs.select(F.col(id_col).alias("doc_id"), *carry, *[c.alias(f"_{name}") for name, c in fields.items()])
    found = map_texts(rows, ("doc_id", *carry), [F.col(f"_{name}") for name in names], make, "len long, term string, tf long")
    own = ("doc_id", *carry, *(["len"] if sized else []), "term")
    if keys is not None:
        found = found.join(F.broadcast(keys.select(F.col("key").alias("term")).distinct()), "term", "left_semi")
    return found.groupBy(*own).agg(F.sum("tf").alias("tf")) if repeats(rows, "doc_id") else found.select(*own, "tf")


def lengths(docs: DataFrame, id_col: str, search_text: Column) -> DataFrame:
    """doc_id and the tokens of a text, at least one."""

    def make():
        words = Words(stemmed=False)
        return lambda texts: (range(len(texts)), ([max(1, len(words.of(t))) for t in texts],))

    return map_texts(docs.select(F.col(id_col).alias("doc_id"), search_text.alias("_t")), ("doc_id",), [F.col("_t")], make, "len long")


def query_keys(spark: SparkSession, words: list[str]) -> DataFrame:
    """key, factor of the distinct terms of a query: the term, and its prefix key at a lower factor."""
    one = spark.createDataFrame([(" ".join(words),)], "q string")
    found = one.select(F.explode(F.array_distinct(terms(F.col("q")))).alias("term"))
    whole = found.select(F.col("term").alias("key"), F.lit(1.0).alias("factor"))
    return whole.unionAll(found.select(prefix_key(F.col("term")).alias("key"), F.lit(PREFIX_FACTOR).alias("factor")).where("key is not null"))


def scored(hits: DataFrame, keys: DataFrame, stats: DataFrame) -> DataFrame:
    """doc_id, score from the postings of a query's keys (doc_id, term, tf, len) and one row of statistics (n, avg_len).

    Keys and their counts are a handful of rows and broadcast. A key that two terms share counts twice."""
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") / F.lit(100.0)
    part = F.col("factor") * idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    weighted = F.broadcast(keys.select(F.col("key").alias("term"), "factor"))
    rows = hits.join(weighted, "term").join(F.broadcast(df), "term").crossJoin(F.broadcast(stats.select("n", "avg_len")))
    return rows.groupBy("doc_id").agg(F.round(F.sum(part), PLACES).alias("score"))


def bm25(index: DataFrame, sizes: DataFrame, keys: DataFrame) -> DataFrame:
    """doc_id, score from postings and lengths that lie apart; statistics cover the whole collection."""
    hits = index.join(F.broadcast(keys.select(F.col("key").alias("term")).distinct()), "term", "left_semi")
    stats = sizes.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))
    return scored(hits.join(sizes, "doc_id"), keys, stats)


def phrase_boost(scored: DataFrame, docs: DataFrame, query: str, headline: Column, search_text: Column) -> DataFrame:
    """Scores times 1.6 where the headline holds the query, 1.25 where only the text does; queries of over 4 characters."""
    q = query.strip().lower()
    if len(q) <= BOOST_OVER:
        return scored
    texts = docs.select("doc_id", F.lower(headline).alias("_h"), F.lower(search_text).alias("_t"))
    factor = F.when(F.contains("_h", F.lit(q)), MOST_BOOST).when(F.contains("_t", F.lit(q)), TEXT_BOOST).otherwise(1.0)
    return scored.join(texts, "doc_id").select("doc_id", (F.col("score") * factor).alias("score"))
