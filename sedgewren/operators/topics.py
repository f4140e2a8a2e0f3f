"""Weighted taxonomy classification. The taxonomy is a table: slug, ord, keyword, weight."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedgewren.operators.analysis import term_counts

#: Points for a listed domain and for a hint, and what picks need.
DOMAIN_POINTS, HINT_POINTS, LEAST_SHARE, MOST_TOPICS = 12.0, 18.0, 0.34, 3


def host_suffixes(host: Column) -> Column:
    """The host and each of its parent domains."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def topic_scores(docs: DataFrame, id_col: str, text: Column, taxonomy: DataFrame, domains: DataFrame | None = None, host: Column | None = None, hints: Column | None = None) -> DataFrame:
    """doc_id, slug, ord, score: sums over keywords of weight * (1 + ln n), relative to the document's best, 3 places.

    The taxonomy is small and broadcast, and only counts of its keywords are shuffled. A keyword with a hyphen also matches its
    joined form where the whole is absent."""
    forms = taxonomy.select(F.explode(F.array("keyword", F.regexp_replace("keyword", "-", ""))).alias("term")).distinct()
    found = term_counts(docs.select(F.col(id_col).alias("doc_id"), text.alias("_t")), "doc_id", F.col("_t")).join(F.broadcast(forms), "term", "left_semi")
    counted = found.groupBy("doc_id", "term").agg(F.sum("n").alias("n"))
    small = F.broadcast(taxonomy)
    whole = counted.join(small, counted["term"] == taxonomy["keyword"]).select("doc_id", "slug", "ord", "keyword", "weight", "n", F.lit(0).alias("k"))
    joined = F.broadcast(taxonomy.where(F.contains("keyword", F.lit("-"))).withColumn("_bare", F.regexp_replace("keyword", "-", "")))
    bare = counted.join(joined, F.col("term") == F.col("_bare")).select("doc_id", "slug", "ord", "keyword", "weight", "n", F.lit(1).alias("k"))
    best = whole.unionAll(bare).groupBy("doc_id", "slug", "ord", "keyword").agg(F.min(F.struct("k", "n", "weight")).alias("x"))
    points = best.select("doc_id", "slug", "ord", (F.col("x.weight") * (1 + F.log(F.col("x.n").cast("double")))).alias("s"))
    if domains is not None and host is not None:
        at = docs.select(F.col(id_col).alias("doc_id"), F.explode(host_suffixes(host)).alias("domain")).join(F.broadcast(domains), "domain")
        points = points.unionAll(at.select("doc_id", "slug", "ord", F.lit(DOMAIN_POINTS).alias("s")))
    if hints is not None:
        slugs = taxonomy.select("slug", "ord").distinct()
        at = docs.select(F.col(id_col).alias("doc_id"), F.explode(hints).alias("slug")).join(F.broadcast(slugs), "slug")
        points = points.unionAll(at.select("doc_id", "slug", "ord", F.lit(HINT_POINTS).alias("s")))
    raw = points.groupBy("doc_id", "slug", "ord").agg(F.sum("s").alias("s")).where("s > 0")
    share = F.col("s") / F.max("s").over(Window.partitionBy("doc_id"))
    return raw.select("doc_id", "slug", "ord", (F.floor(share * F.lit(1000.0) + 0.5) / F.lit(1000.0)).alias("score"))


def pick_topics(ids: DataFrame, scores: DataFrame) -> DataFrame:
    """doc_id, rank, slug: the best topic, up to two more with a third of its score; misc without any."""
    ranked = scores.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "ord")).cast("long"))
    kept = ranked.where((F.col("rank") == 1) | ((F.col("rank") <= MOST_TOPICS) & (F.col("score") >= LEAST_SHARE)))
    return ids.join(kept.select("doc_id", "rank", "slug"), "doc_id", "left").select("doc_id", F.coalesce("rank", F.lit(1).cast("long")).alias("rank"), F.coalesce("slug", F.lit("misc")).alias("slug"))


def alias_slug(value: Column, aliases: dict[str, str]) -> Column:
    """A slug for a slug, label or alias; runs of blanks and underscores count as one blank, then as a hyphen."""
    raw = F.lower(F.trim(value))
    known = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    loose = F.regexp_replace(raw, r"[_\s]+", " ")
    return F.coalesce(known[raw], known[loose], known[F.regexp_replace(loose, " ", "-")])


def topic_counts(entries: DataFrame, slugs: DataFrame) -> DataFrame:
    """slug, n over the topics arrays: those with entries, and misc always."""
    counts = entries.select(F.explode("topics").alias("slug")).groupBy("slug").agg(F.count("*").alias("n"))
    found = slugs.join(counts, "slug", "left").select("slug", F.coalesce("n", F.lit(0)).alias("n"))
    return found.where((F.col("n") > 0) | (F.col("slug") == "misc"))


def topic_label(slug: Column, labels: dict[str, str]) -> Column:
    """The name a topic is shown with; slugs without one are shown as they are."""
    if not labels:
        return slug
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in labels.items() for x in kv]), slug), slug)
