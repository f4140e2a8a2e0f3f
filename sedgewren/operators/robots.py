"""Robots files, fetch outcomes and polite schedules, as tables by host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters of a robots file that are read, and the longest wait between two fetches of a host.
MOST_CHARS, LONGEST_GAP_MS = 200_000, 5_000


def directives(files: DataFrame, most: int = MOST_CHARS) -> DataFrame:
    """host, place, field, value, section of the lines of robots files (host, body): comments and lines without a colon are
    left out. A section begins with the first of adjoining user-agent lines; section 0 lies before the first."""
    lines = files.select("host", F.posexplode(F.split(F.substring("body", 1, most), r"\r?\n")).alias("place", "line"))
    text = F.trim(F.split_part(F.col("line"), F.lit("#"), F.lit(1)), F.lit(" \t\r\f\x0b"))
    pair = lines.withColumn("text", text).where(F.col("text").contains(":"))
    pair = pair.select("host", "place", F.lower(F.regexp_extract("text", r"^([^:]*?)\s*:", 1)).alias("field"), F.regexp_extract("text", r"^[^:]*:\s*([\s\S]*)$", 1).alias("value"))
    by_host = Window.partitionBy("host").orderBy("place")
    begins = (F.col("field") == "user-agent") & (F.lag("field", 1, "").over(by_host) != "user-agent")
    return pair.withColumn("begins", begins.cast("int")).withColumn("section", F.sum("begins").over(by_host)).drop("begins")


def robots_rules(files: DataFrame, agent: str, most: int = MOST_CHARS) -> DataFrame:
    """host, rules (pattern, allow), delay_ms that hold for an agent, one row a host of files (host, status, body).

    Sections that name the agent (one of their names is part of the agent's own) hold, else those for all. A server error
    forbids everything; any other answer but success means no rules, as does a null status. A section's last delay counts,
    and of several sections' the first."""
    found = directives(files.where("status between 200 and 299"), most).where("section > 0")
    name = F.when(F.col("field") == "user-agent", F.lower("value"))
    named = F.bool_or((name != "*") & F.lit(agent).contains(name))
    seconds = F.when((F.col("field") == "crawl-delay") & F.col("value").rlike(r"^[0-9]*\.?[0-9]+$"), F.col("value").cast("double"))
    rule = F.when(F.col("field").isin("allow", "disallow") & (F.col("value") != ""), F.struct("place", F.col("value").alias("pattern"), (F.col("field") == "allow").alias("allow")))
    sections = found.groupBy("host", "section").agg(
        F.coalesce(named, F.lit(False)).alias("named"), F.coalesce(F.bool_or(name == "*"), F.lit(False)).alias("general"),
        F.collect_list(rule).alias("rules"), F.max_by(F.when(seconds > 0, F.round(seconds * 1000).cast("long")), F.when(seconds > 0, F.col("place"))).alias("delay_ms"),
    )
    sections = sections.withColumn("any_named", F.max("named").over(Window.partitionBy("host"))).where(F.when(F.col("any_named"), F.col("named")).otherwise(F.col("general")))
    rules = F.transform(F.array_sort(F.flatten(F.collect_list("rules"))), lambda r: F.struct(r["pattern"].alias("pattern"), r["allow"].alias("allow")))
    held = sections.groupBy("host").agg(rules.alias("rules"), F.min_by("delay_ms", F.when(F.col("delay_ms").isNotNull(), F.col("section"))).alias("delay_ms"))
    none = F.array().cast("array<struct<pattern:string,allow:boolean>>")
    shut = F.array(F.struct(F.lit("/").alias("pattern"), F.lit(False).alias("allow")))
    return files.select("host", "status").join(held, "host", "left").select("host", F.when(F.col("status") >= 500, shut).otherwise(F.coalesce("rules", none)).alias("rules"), "delay_ms")


def pattern_regex(pattern: Column) -> Column:
    """The expression for a pattern: * is any run of characters, a closing $ the end, all else stands for itself."""
    anchored = pattern.endswith("$")
    plain = F.when(anchored, F.left(pattern, F.length(pattern) - 1)).otherwise(pattern)
    quoted = F.replace(F.replace(plain, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("*"), F.lit("\\E.*\\Q"))
    return F.concat(F.lit("^\\Q"), quoted, F.lit("\\E"), F.when(anchored, F.lit("$")).otherwise(F.lit("")))


def allowed(target: Column, rules: Column) -> Column:
    """Whether rules (array of pattern, allow) let a path be fetched: the longest matching pattern decides, Allow on ties;
    without a match, or without rules, it may be."""
    hits = F.filter(rules, lambda r: F.regexp_like(target, pattern_regex(r["pattern"])))
    best = F.array_max(F.transform(hits, lambda r: F.struct(F.length(r["pattern"]).alias("n"), r["allow"].alias("allow"))))
    return F.coalesce(best["allow"], F.lit(True))


def fetch_outcome(error: Column, status: Column, content_type: Column) -> Column:
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    return (
        F.when(F.lower(error).rlike("timeout|timed out|abort"), "timeout")
        .when(error.isNotNull() | status.isNull(), "network_error")
        .when((status < 200) | (status >= 300), "http_error")
        .when(~kind.rlike(r"html|xhtml|text/plain|\+xml"), "unsupported_type")
        .otherwise("ok")
    )


def polite_gap(gap_ms: int, delay_ms: Column, longest: int = LONGEST_GAP_MS) -> Column:
    """The gap between fetches of a host: its own crawl delay if that is longer, up to a limit."""
    return F.least(F.greatest(F.lit(gap_ms).cast("long"), F.coalesce(delay_ms, F.lit(0).cast("long"))), F.lit(longest).cast("long"))


#: Ids a part of a host's queue spans.
PART_IDS = 1 << 16


def schedule(rows: DataFrame, host: str, order: str, gap_ms: int | Column) -> DataFrame:
    """Earliest starts with a gap between fetches of one host, in the order of whole-number ids; null ids come first.

    A host may hold most rows: its queue is cut into parts by id, each part is ranked by itself, and begins after the rows
    of the parts before it, which are counted first."""
    part = F.coalesce(F.floor(F.col(order) / PART_IDS), F.lit(-(1 << 62))).cast("long")
    gap = gap_ms if isinstance(gap_ms, Column) else F.lit(gap_ms)
    cut = rows.withColumns({"_host": F.coalesce(F.col(host), F.lit("")), "_part": part, "_gap": gap})
    counts = cut.groupBy("_host", "_part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("_host").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select("_host", "_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_begin"))
    within = F.row_number().over(Window.partitionBy("_host", "_part").orderBy(order)) - 1
    return cut.withColumn("_at", within).join(begins, ["_host", "_part"]).select(order, host, ((F.col("_begin") + F.col("_at")) * F.col("_gap")).cast("long").alias("start_ms"))


def unread_title(url: Column) -> Column:
    """What a page that isn't text is called: the last segment of its path, null without one."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    return F.try_element_at(F.filter(F.split(path, "/"), lambda s: s != ""), F.lit(-1))
