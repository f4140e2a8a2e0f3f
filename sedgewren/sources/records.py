"""Loose JSON records of saved posts as one fixed set of columns.

Records are variants: exports name and nest their fields in several ways, and mix types. Everything here is a Column
expression, so normalisation is one projection without a shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedgewren.functions.urls import canonical_url, domain, is_external, is_shortener

#: The names that exports give to a field, likeliest first, and the form of a post's address.
ID_NAMES = ("$.id", "$.post_id", "$.tweet_id", "$.id_str", "$.rest_id", "$.legacy.id_str")
TEXT_NAMES = ("$.text", "$.full_text", "$.note_tweet_text", "$.content", "$.legacy.full_text", "$.legacy.text")
ADDRESS_NAMES = ("$.url", "$.post_url", "$.permalink", "$.tweet_url")
AUTHOR_NODES = ("$.author", "$.user", "$.core")
NESTED_HANDLES = ("$.handle", "$.screen_name", "$.username", "$.screenName")
FLAT_HANDLES = ("$.author_username", "$.author_handle", "$.author_screen_name", "$.handle", "$.username", "$.screen_name")
NESTED_NAMES = ("$.name", "$.display_name", "$.displayName")
FLAT_NAMES = ("$.author_name", "$.author_display_name", "$.name")
NESTED_AVATARS = ("$.avatar_url", "$.profile_image_url", "$.profile_image_url_https")
FLAT_AVATARS = ("$.author_avatar_url", "$.avatar_url", "$.profile_image_url")
ADDRESS = ("https://x.com/", "/status/")
LINK = r"(https?://[^\s<>\"')]+)"
LEGACY_DATE = "MMM d HH:mm:ss Z yyyy"

COLUMNS = ("id", "text", "author_name", "author_handle", "avatar_url", "url", "created_at", "saved_at", "external_urls", "short_urls", "topics", "media", "metrics")
_NONE = "array<string>"


def node(v: Column, *paths: str) -> Column:
    """The first part of a variant that is there and isn't JSON's null."""
    found = [F.try_variant_get(v, p, "variant") for p in paths]
    return F.coalesce(*[F.when(~F.is_variant_null(x), x) for x in found])


def kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def scalar(v: Column) -> Column:
    """A string that isn't blank, trimmed, or a number as a string; null for anything else."""
    trimmed = F.regexp_replace(F.try_variant_get(v, "$", "string"), r"(?U)^\s+|\s+$", "")
    number = F.regexp_replace(trimmed, r"\.0+$", "")
    k = kind(v)
    return F.when(k == "STRING", F.nullif(trimmed, F.lit(""))).when(k.isin("BIGINT", "DOUBLE", "FLOAT") | k.startswith("DECIMAL"), number)


def pick(v: Column, *paths: str) -> Column:
    """The first scalar among some parts."""
    return F.coalesce(*[scalar(F.try_variant_get(v, p, "variant")) for p in paths])


def items(v: Column) -> Column:
    """The elements of an array; null where v is none."""
    return F.when(kind(v).startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>"))


def moment(raw: Column) -> Column:
    """A point in time from ISO forms or from dates such as `Wed Oct 10 20:19:24 +0000 2018`; null if it is neither."""
    return F.coalesce(F.try_to_timestamp(raw), F.try_to_timestamp(F.regexp_replace(raw, r"^\w{3} ", ""), F.lit(LEGACY_DATE)))


def _canonical(urls: Column) -> Column:
    made = F.filter(F.transform(urls, canonical_url), lambda u: u.isNotNull())
    return F.coalesce(made, F.array().cast(_NONE))


def _union(lists: list[Column], keep) -> Column:
    return F.filter(F.array_distinct(reduce(F.concat, lists)), keep)


def normalised(v: Column) -> list[Column]:
    """The columns of COLUMNS from a variant. A record without an id, or that is no object, has a null id.

    Missing texts are empty, missing authors `unknown`, missing dates the epoch; handles lose one leading @."""
    author = node(v, *AUTHOR_NODES)
    handle_raw = F.coalesce(pick(author, *NESTED_HANDLES), pick(v, *FLAT_HANDLES), F.lit("unknown"))
    handle = F.regexp_replace(handle_raw, "^@", "")
    name = F.coalesce(pick(author, *NESTED_NAMES), pick(v, *FLAT_NAMES), handle_raw)
    key = pick(v, *ID_NAMES)
    text = F.coalesce(pick(v, *TEXT_NAMES), F.lit(""))
    created = F.coalesce(moment(scalar(node(v, "$.created_at", "$.createdAt", "$.legacy.created_at"))), moment(pick(v, "$.bookmarked_at")), F.timestamp_seconds(F.lit(0)))
    in_text = _canonical(F.regexp_extract_all(text, F.lit(LINK), F.lit(1)))
    entities = items(node(v, "$.entities.urls"))
    listed = F.transform(items(node(v, "$.external_urls", "$.urls", "$.links")), lambda x: F.when(kind(x) == "STRING", scalar(x)).otherwise(pick(x, "$.expanded_url")))
    expanded = F.transform(entities, lambda x: pick(x, "$.expanded_url", "$.unwound_url", "$.url"))
    shortened = F.transform(entities, lambda x: pick(x, "$.url"))
    topics = F.filter(F.transform(items(node(v, "$.topics", "$.tags")), scalar), lambda t: t.isNotNull())
    media = F.transform(items(node(v, "$.media")), lambda x: F.struct(F.coalesce(pick(x, "$.type"), F.lit("photo")).alias("type"), pick(x, "$.url", "$.media_url_https").alias("url")))
    metrics = node(v, "$.metrics")
    made = [
        key,
        text,
        name,
        handle,
        F.coalesce(pick(author, *NESTED_AVATARS), pick(v, *FLAT_AVATARS)),
        F.coalesce(pick(v, *ADDRESS_NAMES), F.concat(F.lit(ADDRESS[0]), handle, F.lit(ADDRESS[1]), key)),
        created,
        moment(scalar(node(v, "$.bookmarked_at", "$.saved_at"))),
        _union([_canonical(listed), _canonical(expanded), in_text], is_external),
        _union([in_text, _canonical(shortened)], is_shortener),
        F.coalesce(topics, F.array().cast(_NONE)),
        F.coalesce(F.filter(media, lambda m: m["url"].isNotNull()), F.array().cast("array<struct<type:string,url:string>>")),
        F.when(kind(metrics).startswith("OBJECT"), F.to_json(metrics)),
    ]
    return [c.alias(n) for c, n in zip(made, COLUMNS, strict=True)]


def normalise(rows: DataFrame, record: str, order: str) -> DataFrame:
    """Usable records, the first of each id by `order`. Sums up before it shuffles, so one id may hold most rows."""
    made = rows.select(F.col(order).alias("_at"), *normalised(F.col(record))).where(F.col("id").isNotNull())
    whole = F.struct(*COLUMNS[1:])
    return made.groupBy("id").agg(F.min_by(whole, F.col("_at")).alias("_r")).select("id", "_r.*")


def newest_first(records: DataFrame) -> DataFrame:
    return records.orderBy(F.desc("created_at"), "id")


#: What a report warns of, where any record shows it.
WARNINGS = {
    "rejected": "were rejected",
    "unknown_authors": "have no author that can be told",
    "undated": "have no usable date",
    "empty_text": "have no text",
    "short_only": "carry short links alone, which must be resolved first",
}


def quality_report(records: DataFrame, skipped: int = 0) -> DataFrame:
    """One row about normalised records: how many there are; distinct links, short links, domains and authors; how many are
    undated, by an unknown author, without text, with short links alone, or without any link."""
    links, shorts = F.size("external_urls"), F.size("short_urls")
    counted = records.agg(
        F.count("*").alias("records"), F.count_distinct(F.lower("author_handle")).alias("authors"),
        F.count_if(F.unix_micros("created_at") <= 0).alias("undated"), F.count_if(F.col("author_handle") == "unknown").alias("unknown_authors"),
        F.count_if(F.regexp_replace("text", r"(?U)^\s+|\s+$", "") == "").alias("empty_text"), F.count_if((links == 0) & (shorts > 0)).alias("short_only"), F.count_if((links == 0) & (shorts == 0)).alias("no_links"),
    )
    found = records.select(F.explode("external_urls").alias("url")).distinct().withColumn("host", F.nullif(domain(F.col("url")), F.lit("")))
    linked = found.agg(F.count("*").alias("links"), F.count_distinct("host").alias("domains"))
    short = records.select(F.explode("short_urls").alias("url")).agg(F.count_distinct("url").alias("short_links"))
    return counted.crossJoin(linked).crossJoin(short).withColumn("rejected", F.lit(skipped).cast("long"))  # of one row each


def report_warnings(report: DataFrame) -> DataFrame:
    """kind, n, percent, message for what the report's row should be warned of; percent of the records, rounded."""
    told = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("n"), F.lit(m).alias("message")) for k, m in WARNINGS.items()])
    rows = report.select("records", F.inline(told)).where("n > 0")
    percent = F.floor(F.when(F.col("records") > 0, 100 * F.col("n") / F.col("records")).otherwise(0.0) + 0.5).cast("long")
    return rows.select("kind", "n", percent.alias("percent"), F.concat(F.col("n").cast("string"), F.lit(" records ("), percent.cast("string"), F.lit("%) "), F.col("message")).alias("message"))


def meets(report: DataFrame, minimum: int) -> bool:
    """Whether there are as many records as expected."""
    return report.first()["records"] >= minimum
