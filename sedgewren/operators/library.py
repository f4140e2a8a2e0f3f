"""Relational shapes of the library: crawl queue, redirects, rollups, top groups, sitemap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def crawl_queue(wanted: DataFrame, records: DataFrame, key: str, again: Column, force: bool = False) -> DataFrame:
    """Wanted rows without a record, or whose record is to be fetched again; all of them if force."""
    if force:
        return wanted
    known = records.withColumn("_known", F.lit(True))
    return wanted.join(known, key, "left").where(F.col("_known").isNull() | again)


def chase(starts: DataFrame, key: str, links: DataFrame, hops: int) -> DataFrame:
    """Follows src to dst at most `hops` times: key, target, hops."""
    rows = starts.select(key, F.col(key).alias("target"), F.lit(0).cast("long").alias("hops"))
    for _ in range(hops):
        step = links.select(F.col("src").alias("target"), "dst")
        rows = rows.join(step, "target", "left").select(key, F.coalesce("dst", "target").alias("target"), (F.col("hops") + F.when(F.col("dst").isNotNull(), 1).otherwise(0)).cast("long").alias("hops"))
    return rows


def resolve_links(starts: DataFrame, key: str, answers: DataFrame, hops: int = 4) -> DataFrame:
    """What short links lead to, by a table of answers (url, location, http_status, error): key, url, status, http_status, error.

    At most `hops` requests a link. A redirect (3xx with a location) is followed; an address met before is a loop. The first
    other answer after a redirect is the target, whatever its status; a link that doesn't redirect is an error where it
    answers with success and dead otherwise. No answer, or one that failed, is an error. After the last hop, the address
    reached is the target. Repeated answers of an address count once, the smallest location first."""
    found = answers.groupBy("url").agg(F.min(F.struct("location", "http_status", "error")).alias("a"))
    at = found.select(F.col("url").alias("at"), "a")
    none = F.lit(None).cast("string")
    begun = {"at": F.col(key), "seen": F.array().cast("array<string>"), "status": none, "http_status": F.lit(None).cast("int"), "error": none}
    rows = starts.select(key).distinct().withColumns(begun)
    for hop in range(hops):
        open_ = F.col("status").isNull()
        rows = rows.withColumn("_ask", F.when(open_, F.col("at"))).join(at.withColumnRenamed("at", "_ask"), "_ask", "left")
        moved = F.col("a.http_status").between(300, 399) & F.col("a.location").isNotNull()
        good = F.col("a.http_status").between(200, 299)
        state = (
            F.when(F.array_contains("seen", F.col("at")), "loop")
            .when(F.col("a").isNull() | F.col("a.error").isNotNull() | F.col("a.http_status").isNull(), "error")
            .when(moved, none)
            .when(F.lit(hop > 0) & (F.col("at") != F.col(key)), "resolved")
            .otherwise(F.when(good, "error").otherwise("dead"))
        )
        message = F.when(F.col("_state") == "loop", "Redirect loop").when(F.col("_state") == "dead", F.concat(F.lit("HTTP "), F.col("a.http_status").cast("string")))
        message = message.when(F.col("_state") == "error", F.coalesce(F.left("a.error", F.lit(200)), F.when(good, "Shortener did not redirect").otherwise("No answer")))
        rows = rows.withColumn("_state", state)
        rows = rows.select(
            key, F.when(open_ & F.col("_state").isNull() & moved, F.col("a.location")).otherwise(F.col("at")).alias("at"), F.when(open_, F.array_append("seen", F.col("at"))).otherwise(F.col("seen")).alias("seen"),
            F.when(open_, F.col("_state")).otherwise(F.col("status")).alias("status"), F.when(open_ & (F.col("_state") != "loop"), F.col("a.http_status")).otherwise(F.col("http_status")).alias("http_status"),
            F.when(open_, message).otherwise(F.col("error")).alias("error"),
        )
    status = F.coalesce("status", F.lit("resolved"))
    return rows.select(key, F.when(status == "resolved", F.col("at")).alias("url"), status.alias("status"), "http_status", "error")


def sitemap(topics: DataFrame, slug: str, entries: DataFrame, key: str, saved_at: str, indexed_at: Column) -> DataFrame:
    """path, last_modified, priority of the root, the topics page, each topic (all as old as the index) and each entry."""
    spark = topics.sparkSession
    row = lambda path, at, rank: [path.alias("path"), at.alias("last_modified"), F.lit(rank).alias("priority")]
    root = spark.range(1).select(*row(F.lit("/"), indexed_at, 1.0))
    listing = spark.range(1).select(*row(F.lit("/topics"), indexed_at, 0.8))
    by_topic = topics.select(*row(F.concat(F.lit("/topics/"), slug), indexed_at, 0.7))
    return root.unionAll(listing).unionAll(by_topic).unionAll(entries.select(*row(F.concat(F.lit("/s/"), key), F.col(saved_at), 0.5)))


def ranked_groups(rows: DataFrame, group: str) -> DataFrame:
    """Groups by falling size. Groups are few; the window runs over their counts alone."""
    counts = rows.groupBy(group).agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), group)))


def top_per_group(rows: DataFrame, group: str, value: str, k: int) -> DataFrame:
    """The k most frequent values of each group, ties by value."""
    counts = rows.groupBy(group, value).agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), value))).where(F.col("rank") <= k)
