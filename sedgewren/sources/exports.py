"""Exports of saved posts and the library's own files: guarded reads, multi-part assembly, scans, sinks, build guard."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sedgewren.functions.urls import canonical_url, url_key
from sedgewren.operators.vectors import DIMENSIONS
from sedgewren.sources.records import ID_NAMES, items, kind, node, normalise, pick

#: Texts that failed uploads leave, container and count names, states of a fetch, files that aren't records.
PLACEHOLDER = r"(?i)^(<file>|placeholder|null|undefined|todo|tbd|\{\}|\[\])$"
LEAST_CHARS = 32
CONTAINERS = ("$.data", "$.items")
COUNTS = ("$.count", "$.total", "$.total_count")
STATUSES = ("ok", "empty", "unsupported_type", "http_error", "network_error", "timeout", "blocked_by_robots", "skipped")
BOOKKEEPING = ("index.json", "short-links.json")
CRAWL_SCHEMA = (
    "key string, url string, final_url string, status string, http_status int, content_type string, title string, description string, site_name string, byline string, "
    "published_at string, text string, word_count long, fetched_at string, duration_ms long, error string"
)
MANIFEST_SCHEMA = "count long, last_id string, source string, owner string, parts array<struct<file:string,n:long,bytes:long,lines:long>>"


@dataclass
class ExportRead:
    """What a guarded read found. reason: missing, invalid_json, wrong_shape, no_records or truncated, if it isn't ok."""

    ok: bool
    reason: str | None = None
    message: str = ""
    records: DataFrame | None = None
    skipped: int = 0
    declared: int | None = None


@dataclass
class Assembly:
    """The parts' records (part, pos, id, record as JSON), or what keeps them from being assembled."""

    ok: bool
    broken: dict[str, str] = field(default_factory=dict)
    missing: list[str] = field(default_factory=list)
    message: str = ""
    records: DataFrame | None = None
    count: int = 0
    duplicates: int = 0


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def containers(v: Column, holders: tuple[str, ...] = CONTAINERS) -> Column:
    """The array of records: the document itself or the first of the holders that is there; null if that is no array."""
    return F.when(kind(v).startswith("ARRAY"), items(v)).otherwise(items(node(v, *holders)))


def read_export(spark: SparkSession, path: str, holders: tuple[str, ...] = CONTAINERS, counts: tuple[str, ...] = COUNTS) -> ExportRead:
    """Reads one JSON export, whose records are in one of the holders and counted by one of the counts (paths). A file that is missing, a placeholder, malformed, without usable records, or that holds
    fewer than it declares is told apart. One document is one task's work; large exports come in parts (assemble)."""
    if not exists(spark, path):
        return ExportRead(False, "missing", f"No export at {path}.")
    doc = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", r"^\s+|\s+$", "").alias("raw"))
    doc = doc.select("raw", F.try_parse_json("raw").alias("v"))
    given = [F.when(kind(F.try_variant_get("v", p, "variant")).rlike("^(BIGINT|DOUBLE|DECIMAL)"), F.try_variant_get("v", p, "double")) for p in counts]
    declared = F.coalesce(*[F.when(c >= 0, c) for c in given])
    facts = doc.select(F.left("raw", F.lit(40)).alias("start"), F.length("raw").alias("n"), F.col("raw").rlike(PLACEHOLDER).alias("empty"), F.col("v").isNull().alias("bad"), kind(F.col("v")).alias("kind"), declared.alias("declared")).first()
    if facts is None or facts["empty"] or facts["n"] < LEAST_CHARS:
        return ExportRead(False, "invalid_json", f"{path} holds {facts['start'] if facts else 'nothing'!r}: it looks like a placeholder of a failed upload.")
    if facts["bad"]:
        return ExportRead(False, "invalid_json", f"{path} is not valid JSON. It starts with {facts['start']!r}.")
    if not facts["kind"].startswith(("ARRAY", "OBJECT")):
        return ExportRead(False, "wrong_shape", f"{path} holds {facts['kind']}, not an array or an object of records.")
    rows = doc.select(F.posexplode(containers(F.col("v"), holders)).alias("pos", "record"))
    records = normalise(rows, "record", "pos")
    entries = rows.select(F.count("*").alias("n"), F.count(pick(F.col("record"), *ID_NAMES)).alias("usable")).first()
    skipped = entries["n"] - entries["usable"]
    usable = records.count()
    if usable == 0:
        return ExportRead(False, "no_records", f"{path} has no usable records ({skipped} entries rejected).", skipped=skipped)
    if facts["declared"] is not None and facts["declared"] > usable + skipped:
        return ExportRead(False, "truncated", f"{path} declares {facts['declared']:.0f} records but contains {usable + skipped}.", skipped=skipped)
    return ExportRead(True, None, "", records, skipped, None if facts["declared"] is None else int(facts["declared"]))


def part_problem(entry: dict[str, Column], raw: Column, length: Column, v: Column, records: Column) -> Column:
    """Why a part doesn't match its manifest entry, or null. A difference of one line end is none."""
    breaks = F.length(raw) - F.length(F.replace(raw, F.lit("\n"), F.lit("")))
    lines = breaks + 1 - F.endswith(raw, F.lit("\n")).cast("int")
    says = lambda what, n, of: F.concat(n.cast("string"), F.lit(f" {what}, manifest says "), of.cast("string"))
    return (
        F.when(F.abs(length - entry["bytes"]) > 1, says("bytes", length, entry["bytes"]))
        .when(F.abs(lines - entry["lines"]) > 1, says("lines", lines, entry["lines"]))
        .when(v.isNull(), F.lit("invalid JSON"))
        .when(records.isNull(), F.lit("no array of records found"))
        .when(F.size(records) != entry["n"], says("records", F.size(records), entry["n"]))
    )


def first_of_each(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key by `order`; rows whose key is null or empty are all kept.

    Sums up before the shuffle, and rows without a key aren't shuffled, so neither can become one task's group."""
    columns = rows.columns
    known = F.coalesce(F.col(key), F.lit("")) != ""
    best = rows.where(known).groupBy(key).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("_r")).select("_r.*")
    return best.unionByName(rows.where(~known))


def assemble(spark: SparkSession, folder: str, minimum: int | None = None, if_complete: bool = False) -> Assembly:
    """Verifies every part that folder/manifest.json lists against its bytes, lines and records, then joins them in the
    manifest's order, the first record of an id winning. Nothing is assembled while a part is broken or missing.

    With if_complete, parts that haven't come yet (or no manifest) are no failure: the result is ok and has no records.
    Broken parts stay one."""
    manifest_path = f"{folder}/manifest.json"
    if not exists(spark, manifest_path):
        return Assembly(if_complete, message=f"No manifest at {manifest_path}.")
    manifest = spark.read.schema(MANIFEST_SCHEMA).json(manifest_path, multiLine=True).first()
    if manifest is None or not manifest["parts"]:
        return Assembly(False, message=f"{manifest_path} lists no parts.")
    entries = spark.createDataFrame([(k, *p) for k, p in enumerate(manifest["parts"])], "part int, file string, n long, bytes long, lines long")
    files = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), "length", F.decode("content", "UTF-8").alias("raw"))
    read = files.join(F.broadcast(entries), "file").withColumn("v", F.try_parse_json("raw"))
    found = F.when(kind(F.col("v")).startswith("ARRAY"), items(F.col("v"))).otherwise(F.coalesce(*[items(F.try_variant_get("v", p, "variant")) for p in CONTAINERS]))
    read = read.withColumn("records", found)
    problem = part_problem({c: F.col(c) for c in ("n", "bytes", "lines")}, F.col("raw"), F.col("length"), F.col("v"), F.col("records"))
    state = {r["file"]: r["problem"] for r in read.select("file", problem.alias("problem")).collect()}  # a row a part
    broken = {f: p for f, p in state.items() if p}
    missing = [p["file"] for p in manifest["parts"] if p["file"] not in state]
    if broken or missing:
        return Assembly(if_complete and not broken, broken, missing, f"{len(broken)} broken, {len(missing)} missing of {len(manifest['parts'])} parts; nothing was assembled.")
    every = read.select("part", F.posexplode("records").alias("pos", "r"))
    key = F.coalesce(F.try_variant_get(node(F.col("r"), "$.id", "$.post_id"), "$", "string"), F.lit(""))
    every = every.select("part", "pos", key.alias("id"), F.to_json("r").alias("record"))
    kept = first_of_each(every, "id", ["part", "pos"])
    facts = kept.agg(F.count("*").alias("n"), F.count_if(F.col("id") == F.lit(manifest["last_id"])).alias("last")).first()
    least = manifest["count"] if minimum is None else minimum
    duplicates = sum(p["n"] for p in manifest["parts"]) - facts["n"]
    if least is not None and facts["n"] < least:
        return Assembly(False, message=f"Assembled {facts['n']} records of {least}.", count=facts["n"], duplicates=duplicates)
    if manifest["last_id"] and not facts["last"]:
        return Assembly(False, message=f"The manifest's last id {manifest['last_id']} is not among the records.", count=facts["n"], duplicates=duplicates)
    return Assembly(True, records=kept, count=facts["n"], duplicates=duplicates)


def write_assembled(found: Assembly, path: str, source: str, owner: str) -> None:
    """Records as JSON lines in path/records in the manifest's order, and a row of facts about them in path/envelope."""
    rows = found.records.orderBy("part", "pos")
    rows.select(F.col("record").alias("value")).write.mode("overwrite").text(f"{path}/records")
    spark = rows.sparkSession
    facts = spark.range(1).select(F.lit(source).alias("source"), F.lit(owner).alias("owner"), F.lit(found.count).alias("count"), F.current_timestamp().alias("assembled_at"))
    write_json(facts, f"{path}/envelope")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_crawl(spark: SparkSession, folder: str, schema: str | StructType = CRAWL_SCHEMA) -> tuple[DataFrame, DataFrame]:
    """Records of a folder of JSON files, one a file, and the names of those that don't fit. Of equal keys the later file wins."""
    if not exists(spark, folder):
        typed = spark.createDataFrame([], schema)
        return typed, spark.createDataFrame([], "file string")
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.json").select(F.col("_metadata.file_name").alias("file"), "value").where(~F.col("file").isin(*BOOKKEEPING))
    parsed = files.select("file", F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r"))
    fits = F.coalesce(F.col("r.url").isNotNull() & F.col("r.status").isin(*STATUSES) & F.col("r.fetched_at").isNotNull() & F.col("r.duration_ms").isNotNull(), F.lit(False))
    named = parsed.where(fits).select("file", "r.*").withColumn("key", F.coalesce("key", url_key(canonical_url(F.col("url")))))
    columns = [c for c in named.columns if c != "file"]
    kept = named.groupBy("key").agg(F.max_by(F.struct(*columns), F.col("file")).alias("_r")).select("_r.*")
    return kept, parsed.where(~fits).select("file")


def read_links(spark: SparkSession, path: str) -> DataFrame:
    """The table of resolved short links; empty where there is none yet."""
    schema = "short_url string, url string, status string, http_status int, error string, resolved_at timestamp"
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def write_links(links: DataFrame, path: str) -> None:
    links.orderBy("short_url").write.mode("overwrite").parquet(path)


def write_index(links: DataFrame, vectors: DataFrame, meta: DataFrame, folder: str) -> None:
    """The read model: entries, vectors with values to five places, and a row of facts."""
    to_five = F.transform("vector", lambda x: F.floor(x * 1e5 + 0.5) / 1e5)
    links.write.mode("overwrite").parquet(f"{folder}/links")
    vectors.withColumn("vector", to_five).write.mode("overwrite").parquet(f"{folder}/vectors")
    write_json(meta, f"{folder}/meta")


def empty_index(spark: SparkSession, model: str, dimensions: int = DIMENSIONS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """An index without entries that still says how its vectors would be made."""
    links = spark.createDataFrame([], "id string, url string, domain string, title string, status string, saved_at timestamp, saves long, topics array<string>")
    vectors = spark.createDataFrame([], "id string, vector array<double>")
    meta = spark.createDataFrame([(0, 0, 0, "local", model, dimensions)], "link_count long, source_count long, crawled_count long, provider string, model string, dimensions int")
    return links, vectors, meta


def require(export: ExportRead) -> DataFrame:
    """The records of a guarded read, or an error that says what is wrong; rejected entries are warned of."""
    if not export.ok:
        raise ValueError(export.message)
    if export.skipped:
        warnings.warn(f"{export.skipped} entries were rejected", stacklevel=2)
    return export.records


def build_action(index_complete: bool, export: ExportRead) -> str:
    """use, use_stale, rebuild, stub or fail: an index is never emptied by a broken export, only by a missing one."""
    if not export.ok and export.reason != "missing":
        return "use_stale" if index_complete else "fail"
    if index_complete:
        return "use"
    return "rebuild" if export.ok else "stub"
