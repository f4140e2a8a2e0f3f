"""Hashed n-gram embeddings, cosine, exact nearest neighbours and score fusion."""

from __future__ import annotations

import math
from itertools import chain

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedgewren.operators.analysis import Words, map_texts, places, repeats

DIMENSIONS = 512
#: Vectors a block of the exact comparison, and rows of it that are scored at once.
BLOCK_ROWS, SLICE_ROWS = 4096, 512


def feature_sums(docs: list[list[str]], dims: int) -> np.ndarray:
    """A row of dims sums for each list of terms: of the terms, of two in succession, and of runs of four characters in a term.

    Features are hashed for all distinct terms at once, a character at a time; the hash of two terms goes on from the first
    one's state through the second one's characters."""
    flat = list(chain.from_iterable(docs))
    ids = {t: k for k, t in enumerate(dict.fromkeys(flat))}
    of = np.fromiter(map(ids.__getitem__, flat), np.int64, len(flat))
    spelled = np.array(list(ids), "S32")  # terms are of less than 32 ASCII characters
    chars, sizes = spelled.view(np.uint8).reshape(len(ids), 32), np.char.str_len(spelled)
    doc, _ = places([len(x) for x in docs])
    total, base = np.zeros(len(docs) * dims), doc * dims
    prime = np.uint32(16777619)

    def start(prefix: str) -> np.ndarray:
        h = np.full(len(ids), 2166136261, np.uint32)
        for c in prefix.encode():
            h = (h ^ np.uint32(c)) * prime
        return h

    def follow(h: np.ndarray, rows: np.ndarray, longest: int) -> np.ndarray:
        for i in range(longest):
            c = rows[:, i].astype(np.uint32)
            h = np.where(c > 0, (h ^ c) * prime, h)
        return h

    def add(bases: np.ndarray, h: np.ndarray, x: int) -> None:
        total[:] += np.bincount(bases + h % np.uint32(dims), np.where(h >= 1 << 31, -x, x), len(total))

    longest = int(sizes.max(initial=0))
    add(base, follow(start("w:"), chars, longest)[of], 20)
    states = (follow(start("b:"), chars, longest) ^ np.uint32(ord("_"))) * prime
    second = np.flatnonzero(doc[1:] == doc[:-1]) + 1
    add(base[second], follow(states[of[second - 1]], chars[of[second]], longest), 12)
    own, grams = np.where(sizes >= 5, sizes - 3, 0), start("c:")
    left = np.flatnonzero(own[of] > 0)
    for i in range(longest - 3):
        left = left[own[of[left]] > i]
        h = grams
        for k in range(4):
            h = (h ^ chars[:, i + k].astype(np.uint32)) * prime
        add(base[left], h[of[left]], 5)
    return total.astype(np.int64).reshape(len(docs), dims)  # whole numbers far below 2**53


def local_embed(docs: DataFrame, id_col: str, text: Column, dims: int = DIMENSIONS) -> DataFrame:
    """doc_id, bucket, weight: the sparse unit vector of each text; texts that share an id make one vector."""

    def make():
        words = Words()

        def step(texts: list):
            sums = feature_sums([words.of(t) for t in texts], dims)
            at, bucket = np.nonzero(sums)
            x = sums[at, bucket]
            norm = np.sqrt((sums * sums).sum(axis=1).astype(np.float64))
            return at, (bucket, x, x / norm[at])

        return step

    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("_t"))
    found = map_texts(rows, ("doc_id",), [F.col("_t")], make, "bucket long, x long, weight double")
    if not repeats(rows, "doc_id"):
        return found.drop("x")
    buckets = found.groupBy("doc_id", "bucket").agg(F.sum("x").alias("x")).where("x <> 0")
    # the norm is a sum of its own: an expression over the list would be evaluated anew for each of the list's rows
    whole = buckets.groupBy("doc_id").agg(F.collect_list(F.struct("bucket", "x")).alias("of"), F.sqrt(F.sum(F.col("x") * F.col("x")).cast("double")).alias("norm"))  # at most dims entries a row
    return whole.select("doc_id", "norm", F.inline("of")).select("doc_id", "bucket", (F.col("x") / F.col("norm")).alias("weight"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def cosine(a: Column, b: Column) -> Column:
    """Over the common length; 0 where a norm is 0."""
    n = F.least(F.size(a), F.size(b))
    a, b = F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / norm)


def knn(rows: DataFrame, query: list[float], k: int, id_col: str, vector: str, exclude: tuple = (), where: Column | None = None) -> DataFrame:
    """The k rows nearest to a query vector among those allowed; a scan with a bounded heap a task."""
    rows = rows if where is None else rows.where(where)
    rows = rows.where(~F.col(id_col).isin(*exclude)) if exclude else rows
    score = cosine(F.col(vector), F.array(*[F.lit(float(x)) for x in query]))
    return rows.select(F.col(id_col), score.alias("score")).orderBy(F.desc("score"), id_col).limit(k)


def related(rows: DataFrame, id_col: str, vector: str, k: int = 6, least: float = 0.02, blocks: int | None = None) -> DataFrame:
    """Each row's k nearest others, exactly: every pair of blocks meets once in a task, which keeps only k a row, so at most
    blocks * k candidates a row are shuffled. All pairs are compared, which is quadratic; blocks grow in number, not in
    size, so a task holds about two of BLOCK_ROWS vectors and the scores of SLICE_ROWS rows."""
    if blocks is None:
        blocks = max(math.ceil(rows.count() / BLOCK_ROWS), math.ceil(math.sqrt(rows.sparkSession.sparkContext.defaultParallelism)))
    import pandas as pd

    left = rows.select(F.col(id_col).alias("id"), F.col(vector).alias("v"), F.pmod(F.xxhash64(id_col), F.lit(blocks)).cast("int").alias("block"))
    queries = left.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    keyed_q = queries.select("id", "v", F.col("block").alias("i"), F.col("other").alias("j"), F.lit(0).alias("side"))
    keyed_d = queries.select("id", "v", F.col("other").alias("i"), F.col("block").alias("j"), F.lit(1).alias("side"))

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        q, d = pdf[pdf.side == 0], pdf[pdf.side == 1]
        if q.empty or d.empty:
            return pd.DataFrame({"id": [], "neighbour": [], "score": []})
        unit = lambda x: (m := np.stack(x).astype(float)) / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
        ids, own, to, out = d.id.to_numpy(), q.id.to_numpy(), unit(d.v).T, []
        of = unit(q.v)
        for at in range(0, len(own), SLICE_ROWS):
            mine = own[at : at + SLICE_ROWS]
            scores = of[at : at + SLICE_ROWS] @ to
            scores[mine[:, None] == ids[None, :]] = -9
            last = min(k, len(ids)) - 1
            edge = -np.partition(-scores, last, axis=1)[:, last]
            for r in range(len(mine)):
                near = np.flatnonzero(scores[r] >= max(edge[r], least))  # ties with the last are told apart by id
                best = near[np.lexsort((ids[near], -scores[r][near]))[:k]]
                out += [(mine[r], ids[c], scores[r, c]) for c in best if scores[r, c] > least]
        return pd.DataFrame(out, columns=["id", "neighbour", "score"])

    met = keyed_q.unionAll(keyed_d).groupBy("i", "j").applyInPandas(meet, "id long, neighbour long, score double")
    ranked = met.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "neighbour")))
    return ranked.where(F.col("rank") <= k).select("id", "rank", "neighbour", "score")


#: Cutoffs and calibration of the vector leg by provider.
CALIBRATION = {"local": (0.04, 0.30, 0.8), "remote": (0.22, 0.70, 1.1)}
FLOOR, SHARE_OF_TOP, ADMISSION = 0.02, 0.4, 0.12


def fuse(keyword: DataFrame, vector: DataFrame, provider: str = "local") -> DataFrame:
    """Adds calibrated vector confidence to keyword scores relative to the best. keyword, vector: doc_id, score; each at
    most a page of candidates."""
    low, high, weight = CALIBRATION[provider]
    one = Window.partitionBy(F.lit(1))
    k = keyword.select("doc_id", (F.col("score") / F.max("score").over(one)).alias("k"), F.row_number().over(one.orderBy(F.desc("score"), "doc_id")).alias("keyword_rank"))
    v = vector.select("doc_id", F.col("score").alias("vector_score"), F.max("score").over(one).alias("top"), F.row_number().over(one.orderBy(F.desc("score"), "doc_id")).alias("vector_rank"))
    v = v.where(F.col("vector_score") >= F.greatest(F.lit(FLOOR), SHARE_OF_TOP * F.col("top")))
    confidence = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("vector_score") - low) / (high - low)))
    both = k.join(v.select("doc_id", "vector_score", "vector_rank", confidence.alias("c")), "doc_id", "full")
    both = both.where(F.col("k").isNotNull() | (F.col("c") >= ADMISSION))
    score = F.coalesce("k", F.lit(0.0)) + weight * F.coalesce("c", F.lit(0.0))
    return both.select("doc_id", score.alias("score"), "keyword_rank", "vector_rank", "vector_score")
