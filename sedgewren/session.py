"""Session defaults, package shipping and shared scratch tables."""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(app: str = "sedgewren", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the defaults this library is written for."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (DEFAULTS | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors once per application, so that workers can import it."""
    if getattr(spark.sparkContext, "_sedgewren_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="sedgewren-")) / "sedgewren.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"sedgewren/{p.relative_to(root)}")
    spark.sparkContext.addPyFile(str(target))
    spark.sparkContext._sedgewren_shipped = True


#: Text and rows that a Python worker gets at once. What it makes of them is several times as large.
BATCH_BYTES, BATCH_ROWS = 2 << 20, 2000


def bound_batches(spark: SparkSession) -> None:
    """Ships the package and bounds Arrow batches by bytes as well as rows, so that long texts don't pile up in a worker."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a local master may leave it unset: there a folder of
    this machine serves, which executors elsewhere would not see."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        found = Path(tempfile.gettempdir(), f"sedgewren-checkpoint-{os.getpid()}").as_uri()
        spark.conf.set("spark.checkpoint.dir", found)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(found)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.makeQualified(path).toString().rstrip("/")


def files_digest(spark: SparkSession, path: str) -> str:
    """Tells the files under a path apart from others, or from later ones, by names, lengths and times."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found, listed = [], fs.listFiles(fs.makeQualified(target), True)
    while listed.hasNext():
        f = listed.next()
        found.append(f"{f.getPath().toString()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()[:24]


def shared_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/sedgewren/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Cuts lineage through a table in the shared folder; the table outlives lost executors."""
    path = shared_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_plainly(spark: SparkSession) -> None:
    """Parquet files are read in turn from now on. Vectored reads of a local path leave a buffer of a column chunk's size
    outside the heap with each thread that has read one."""
    spark.conf.set("parquet.hadoop.vectored.io.enabled", "false")


class Scratch:
    """Tables in the shared folder that are needed for a while; leaving the block removes them.

    What a block returns must not read them: materialize it within the block."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, {}

    def __call__(self, df: DataFrame, tag: str) -> DataFrame:
        path = shared_path(self.spark, tag)
        df.write.parquet(path)
        found = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(found)] = (found, path)
        return found

    def drop(self, df: DataFrame) -> None:
        """Removes one table before the end."""
        found, path = self.paths.pop(id(df), (None, None))
        if found is not None:
            remove_path(self.spark, path)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *error) -> None:
        for _, path in self.paths.values():
            remove_path(self.spark, path)
        self.paths = {}


def remove_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes a core that are worth dealing out before text is analysed.
DEALT_BYTES = 16 << 20


def text_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose texts are to be analysed: dealt to all cores if it is so small that its files, read as they lie, would
    keep few of them busy. Larger tables are read in their own splits, without a shuffle."""
    found, cores = table(spark, sf_dir, name), spark.sparkContext.defaultParallelism
    size = int(str(found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return found.repartition(cores) if size < cores * DEALT_BYTES else found
