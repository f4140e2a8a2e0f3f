"""Threshold-scaled document sketches.

A text's sketch keeps every shingle hash (5 words) below a fixed fraction of the hash range, so it grows with the text,
sketches of parts merge into the sketch of the union's shingles, and containment can be estimated between texts of very
unequal length. The sketch also carries the number of shingles and a digest of the whole shingle set, which tells equal
sets apart from merely small ones.

Defined results: a null text counts as empty; texts without words have an empty sketch, alike (1.0) to each other and
unlike (0.0) any other; texts too short to keep a hash are alike only if their shingle sets are equal. Repeated rows
each get their own row; among rows of one id the order is that of their texts. Null ids come after all others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from sedgewren.llm.common import map_columns, prepare, schema_of, tidy
from sedgewren.llm.shingles import Shingler
from sedgewren.session import table

WORDS = 5
#: One in SCALE hashes is kept.
SCALE = 8


def sketch(text: str | None, shingler: Shingler, scale: int = SCALE) -> tuple[int, str, np.ndarray]:
    """Number of shingles, digest of their set, and the kept hashes, ascending."""
    all_hashes = shingler.hashes(text)
    return len(all_hashes), xxhash.xxh3_64_hexdigest(all_hashes.tobytes()), all_hashes[: np.searchsorted(all_hashes, np.uint64(2**64 // scale))]


def encode(found: tuple[int, str, np.ndarray]) -> str:
    """count:digest:kept hashes, each 16 hexadecimal digits."""
    return f"{found[0]}:{found[1]}:{found[2].astype('>u8').tobytes().hex()}"


def decode(text: str) -> tuple[int, str, np.ndarray]:
    count, digest, kept = text.split(":")
    return int(count), digest, np.frombuffer(bytes.fromhex(kept), ">u8").astype(np.uint64)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Kept hashes of the union of two shingle sets."""
    return np.union1d(a, b)


def _common(a: np.ndarray, b: np.ndarray) -> int:
    return len(np.intersect1d(a, b, assume_unique=True))


def likeness(a: tuple[int, str, np.ndarray], b: tuple[int, str, np.ndarray]) -> float:
    """The estimated Jaccard similarity of the shingle sets."""
    if a[:2] == b[:2]:
        return 1.0
    both = _common(a[2], b[2])
    union = len(a[2]) + len(b[2]) - both
    return both / union if union else 0.0


def containment(a: tuple[int, str, np.ndarray], b: tuple[int, str, np.ndarray]) -> float:
    """The estimated share of a's shingles that b holds, however unequal their sizes."""
    if a[:2] == b[:2]:
        return 1.0
    return _common(a[2], b[2]) / len(a[2]) if len(a[2]) else 0.0


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, bucket, lead: documents dealt to ranges of falling doc_id, each range with a copy (lead) of the
    first document of the range after it, so that every document's successor is in its own range.

    Range edges come from quantiles of the ids alone; one shuffle then moves each text once, and one text a range twice."""
    spark = docs.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ids = docs.select(F.col("doc_id"))
    edges = ids.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)] or [0.5], 10000)).first()[0] or []
    edges = sorted(set(edges))
    #: Bucket 0 holds the largest ids; null ids go last.
    above = F.aggregate(F.lit(edges).cast("array<bigint>"), F.lit(0), lambda a, e: a + (F.col("doc_id") <= e).cast("int")) if edges else F.lit(0)
    bucket = F.when(F.col("doc_id").isNull(), F.lit(len(edges) + 1)).otherwise(above)
    firsts = ids.select("doc_id", bucket.alias("bucket")).groupBy("bucket").agg(F.max("doc_id").alias("first")).orderBy("bucket").collect()
    back = {r["first"]: firsts[i - 1]["bucket"] for i, r in enumerate(firsts)}  # of the first range: the last
    lead = spark.createDataFrame([(k, v) for k, v in back.items()], "_first long, _to int")
    rows = docs.select("doc_id", "text", bucket.alias("bucket"))
    rows = rows.join(F.broadcast(lead), rows["doc_id"].eqNullSafe(lead["_first"]), "left").drop("_first")
    places = F.array_compact(F.array(F.struct(F.col("bucket").alias("b"), F.lit(False).alias("lead")), F.when(F.col("_to").isNotNull(), F.struct(F.col("_to").alias("b"), F.lit(True).alias("lead")))))
    rows = rows.select("doc_id", "text", F.explode(places).alias("_p")).select("doc_id", "text", F.col("_p.b").alias("bucket"), F.col("_p.lead").alias("lead"))
    return rows.repartition(n, "bucket").sortWithinPartitions("bucket", "lead", F.desc_nulls_last("doc_id"), F.asc_nulls_first("text"))


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by the beginning of the one that follows."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


def compare_neighbours(docs: DataFrame, scale: int = SCALE) -> DataFrame:
    """Each document's fingerprint beside those of its edited text and its successor in falling doc_id."""
    prepare(docs.sparkSession)
    schema = schema_of(
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_shingles long"
    )
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(WORDS)
        held = None  # the document before, awaiting its successor: id, text, sketch, bucket
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text, bucket, lead in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                text = text or ""
                own = sketch(text, shingler, scale)
                if held is not None and held[3] == bucket:
                    changed = edited(held[1], text)
                    other = sketch(changed, shingler, scale)
                    digest = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
                    out.append((held[0], len(held[1]), digest, encode(held[2]), encode(other), likeness(held[2], other), likeness(held[2], own), held[2][0]))
                held = None if lead else (doc_id, text, own, bucket)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    return with_next(docs.select("doc_id", "text")).mapInArrow(tidy(run), schema)


def fingerprints(docs: DataFrame, scale: int = SCALE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint of every row, in one pass without a shuffle."""
    def task():
        shingler = Shingler(WORDS)
        return lambda ids, texts: (ids, [encode(sketch(t, shingler, scale)) for t in texts])

    return map_columns(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), task, "doc_id long, fingerprint string")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_neighbours(table(spark, sf_dir, "documents"))
