"""What the operators of this subpackage share: Arrow-batched row functions and held-out folds."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from sedgewren.session import ship_package

#: Text handled at once by a Python worker, in bytes of Arrow data.
BATCH_BYTES = 2 << 20
BATCH_ROWS = 2000

#: Characters of a text that a model is fitted on, at most.
FIT_CHARS = 20_000


def prepare(spark: SparkSession) -> None:
    """Ships the package and bounds Arrow batches by bytes as well as rows, so long texts don't pile up in a worker."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def tidy(run: Callable) -> Callable:
    """run, after which the worker gives unused memory back: workers are kept, and many of them share an executor."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return whole


def schema_of(ddl: str | StructType) -> StructType:
    return ddl if isinstance(ddl, StructType) else _parse_datatype_string(ddl)


def map_columns(df: DataFrame, make: Callable[[], Callable], ddl: str) -> DataFrame:
    """mapInArrow with plain lists: make() runs once per task and gives a function from the input columns (one list
    each, in order) to the output columns (lists or arrays, in the order of ddl)."""
    prepare(df.sparkSession)
    schema = schema_of(ddl)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            if batch.num_rows == 0:
                continue
            out = step(*[batch.column(i).to_pylist() for i in range(batch.num_columns)])
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(out, arrow, strict=True)], schema=arrow)

    return df.mapInArrow(tidy(run), schema)


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null ids fall in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % F.lit(n), F.lit(0))


def spread(doc_id: Column, salt: int) -> Column:
    """A uniform number in [0, 1) fixed by the id; picks bounded training samples."""
    return F.pmod(F.xxhash64(doc_id, F.lit(salt)), F.lit(1 << 40)) / F.lit(float(1 << 40))


def _labelled(labels: DataFrame, label: str, keep: Column) -> DataFrame:
    """doc_id, _y of the rows that keep allows, one row an id."""
    rows = labels.select("doc_id", F.col(label).cast("int").alias("_y")).where(F.col("doc_id").isNotNull() & F.col("_y").isin(0, 1) & keep)
    return rows.groupBy("doc_id").agg(F.max("_y").alias("_y"))


def labelled_share(labels: DataFrame, label: str, keep: Column) -> float | None:
    """The share of label 1 among all ids that labelled_sample picks from; None without any."""
    return _labelled(labels, label, keep).agg(F.avg("_y")).first()[0]


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, keep: Column, per_class: int, salt: int) -> list:
    """At most per_class rows (text, label) of each class, picked by a hash of the id among the rows that keep allows; one row
    an id, and none of more than FIT_CHARS characters, so that what reaches the driver is bounded.

    Only the ids of the sample (at most 2 * per_class, a fixed bound) are broadcast back to the documents."""
    ranked = _labelled(labels, label, keep).withColumn("_r", spread(F.col("doc_id"), salt))
    picked = None
    for y in (0, 1):
        part = ranked.where(F.col("_y") == y).orderBy("_r", "doc_id").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    ids = [(r["doc_id"], r["_y"]) for r in picked.collect()]
    if not ids:
        return []
    small = docs.sparkSession.createDataFrame(ids, "doc_id long, _y int")
    found = docs.select("doc_id", "text").where(F.length("text") <= FIT_CHARS).join(F.broadcast(small), "doc_id").groupBy("doc_id", "_y").agg(F.min("text").alias("text")).collect()
    return [(r["text"], r["_y"]) for r in sorted(found, key=lambda r: (r["doc_id"], r["text"]))]
