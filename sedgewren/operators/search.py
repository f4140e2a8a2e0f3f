"""Search over a stored index: texts are analysed once, when it is written; a query reads the rows of its own terms."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sedgewren.functions.text import page_text, terms
from sedgewren.operators import keyword, vectors
from sedgewren.operators.snippets import best_evidence, snippets
from sedgewren.session import read_plainly
from sedgewren.sources.exports import exists

#: Columns that an entry needs; doc_id may be of any type with an order.
ENTRY = ("doc_id", "url", "title", "description", "domain", "site_name", "topics", "excerpt", "search_text", "saved_at")
#: How many candidates each leg gives, how many results are shown, and how long a page's query may be.
CANDIDATES, DEFAULT_LIMIT, MOST_RESULTS, PAGE_QUERY, PAGE_LIMIT, TYPED_LEAST, TYPED_LIMIT = 60, 8, 50, 200, 40, 2, 6
EMBEDDED_CHARS = 1600


@dataclass(frozen=True)
class Index:
    """Tables of a stored index: entries; postings (term, doc_id, tf, len), each file in the order of a hash of the term;
    weights (dim, doc_id, weight), each file in the order of dimensions; one row of facts."""

    entries: DataFrame
    postings: DataFrame
    weights: DataFrame
    facts: DataFrame
    buckets: int


def spaced(topics: Column) -> Column:
    return F.replace(F.array_join(F.coalesce(topics, F.array().cast("array<string>")), " "), F.lit("-"), F.lit(" "))


def full_text(title: Column, description: Column, site_name: Column, domain: Column, body: Column, topics: Column) -> Column:
    """What the keyword leg searches: every field of an entry, a line each."""
    return page_text([title, description, site_name, domain, body, spaced(topics)], F.lit(""), 1)


def embed_text(title: Column, description: Column, site_name: Column, domain: Column, body: Column, topics: Column) -> Column:
    """What an entry's vector is made from: its fields, the beginning of its body, and its topics as they are."""
    names = F.array_join(F.coalesce(topics, F.array().cast("array<string>")), " ")
    spelled = F.replace(domain, F.lit("."), F.lit(" "))
    page = page_text([title, description, site_name, spelled], body, EMBEDDED_CHARS)
    return F.concat_ws("\n", F.nullif(page, F.lit("")), F.nullif(names, F.lit("")))


def fields() -> dict[str, Column]:
    return {"search_text": F.col("search_text"), "title": F.col("title"), "description": F.col("description"), "domain": F.replace("domain", F.lit("."), F.lit(" ")), "topics": spaced(F.col("topics"))}


def write_search_index(entries: DataFrame, folder: str, buckets: int = 1 << 16) -> None:
    """Writes an index of entries (ENTRY, distinct ids).

    The entries are written as they lie and read again by all else. Each task sorts its own postings and weights and writes
    them in a file: nothing is shuffled, a term of most documents is in all files, and a query prunes the row groups and pages
    of each by bucket. The facts come last: an index without them isn't complete."""
    spark = entries.sparkSession
    read_plainly(spark)
    whole = entries.select(*ENTRY)
    whole.write.mode("overwrite").parquet(f"{folder}/entries")
    rows = spark.read.schema(whole.schema).parquet(f"{folder}/entries")
    bucket = F.when(F.col("term").isNull(), -1).otherwise(F.pmod(F.xxhash64("term"), F.lit(buckets))).cast("int")
    posted = keyword.postings(rows, "doc_id", fields(), sized=True).withColumn("bucket", bucket)
    posted.sortWithinPartitions("bucket").write.mode("overwrite").parquet(f"{folder}/postings")
    body = F.coalesce("excerpt", F.lit(""))
    embedded = rows.select("doc_id", embed_text(*map(F.col, ("title", "description", "site_name", "domain")), body, F.col("topics")).alias("text"))
    weights = vectors.local_embed(embedded, "doc_id", F.col("text")).select("doc_id", F.col("bucket").alias("dim"), "weight")
    weights.sortWithinPartitions("dim").write.mode("overwrite").parquet(f"{folder}/weights")
    kind = whole.schema["doc_id"].dataType.simpleString()
    sizes = _stored_postings(spark, folder, kind).where("bucket = -1")  # a row a document, beside the terms
    facts = sizes.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("len") * F.col("tf")), F.lit(0)).alias("total"), F.lit(buckets).alias("buckets"))
    facts.write.mode("overwrite").parquet(f"{folder}/facts")


def _stored_postings(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    return spark.read.schema(f"doc_id {kind}, len long, term string, tf long, bucket int").parquet(f"{folder}/postings")


def complete(spark: SparkSession, folder: str) -> bool:
    return exists(spark, f"{folder}/facts/_SUCCESS")


def open_search_index(spark: SparkSession, folder: str) -> Index:
    entries, facts = spark.read.parquet(f"{folder}/entries"), spark.read.parquet(f"{folder}/facts")
    kind = entries.schema["doc_id"].dataType.simpleString()  # given, as an empty table in folders has no file to tell its columns
    postings = _stored_postings(spark, folder, kind).where("bucket >= 0")
    weights = spark.read.schema(f"doc_id {kind}, dim long, weight double").parquet(f"{folder}/weights")
    average = F.when(F.col("n") > 0, F.col("total") / F.col("n")).otherwise(0.0)
    return Index(entries, postings, weights, facts.select("n", average.alias("avg_len")), facts.first()["buckets"])


def query_terms(spark: SparkSession, query: str) -> list[str]:
    """The distinct terms of a query, as few as the query has words."""
    found = spark.range(1).select(F.array_distinct(terms(F.lit(query))).alias("t")).first()
    return list(found["t"])


def keyword_scores(index: Index, words: list[str]) -> DataFrame:
    """doc_id, score of all entries that hold a key of the words. Row groups and pages of other terms aren't read, and
    lengths lie beside the postings, so that nothing but the hits is shuffled."""
    spark = index.postings.sparkSession
    weighted = keyword.query_keys(spark, words)
    keys = weighted.groupBy("key").agg(F.sum("factor").alias("factor")).withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(index.buckets)).cast("int")).collect()  # two a word at most
    if not keys:
        return index.postings.select("doc_id", F.lit(0.0).alias("score")).where(F.lit(False))
    hits = index.postings.where(F.col("bucket").isin([k["bucket"] for k in keys]) & F.col("term").isin([k["key"] for k in keys]))
    return keyword.scored(hits.select("doc_id", "term", "tf", "len"), weighted, index.facts)


def boosted(index: Index, scores: DataFrame, query: str) -> DataFrame:
    """Scores raised where an entry holds the query as it was typed."""
    columns = index.entries.select("doc_id", F.concat_ws(" ", "title", "description", "domain", "site_name").alias("headline"), "search_text")
    return keyword.phrase_boost(scores, columns, query, F.col("headline"), F.col("search_text"))


def keyword_candidates(index: Index, query: str, words: list[str], topic: str | None = None, most: int = CANDIDATES) -> DataFrame:
    """doc_id, score of the best entries of a topic. A boost is at most MOST_BOOST, so only entries whose score may still
    reach the last candidate's have their texts read: the result is the same as if all had."""
    scores = keyword_scores(index, words)
    if topic is not None:
        scores = scores.join(in_topic(index.entries, topic).select("doc_id"), "doc_id", "left_semi")
    if len(query.strip()) > keyword.BOOST_OVER:
        last = scores.orderBy(F.desc("score")).limit(most).agg(F.count("*").alias("n"), F.min("score").alias("least"))
        least = F.when(F.col("n") == most, F.col("least")).otherwise(0.0)
        able = scores.crossJoin(F.broadcast(last.select(least.alias("least")))).where(F.col("score") * keyword.MOST_BOOST >= F.col("least"))
        scores = boosted(index, able.select("doc_id", "score"), query)
    return scores.orderBy(F.desc("score"), "doc_id").limit(most)


def vector_candidates(index: Index, query: str, topic: str | None = None, most: int = CANDIDATES) -> DataFrame:
    """doc_id, score of the entries nearest to a query by cosine; only the query's own dimensions are read."""
    spark = index.weights.sparkSession
    one = spark.createDataFrame([(0, query)], "id int, q string")
    weighted = [(r["bucket"], r["weight"]) for r in vectors.local_embed(one, "id", F.col("q")).collect()]  # at most as many as a vector has
    asked, dims = spark.createDataFrame(weighted, "dim long, q double"), [dim for dim, _ in weighted]
    near = index.weights.where(F.col("dim").isin(dims)) if dims else index.weights.where(F.lit(False))
    scores = near.join(F.broadcast(asked), "dim").groupBy("doc_id").agg(F.round(F.sum(F.col("weight") * F.col("q")), keyword.PLACES).alias("score"))
    if topic is not None:
        scores = scores.join(in_topic(index.entries, topic).select("doc_id"), "doc_id", "left_semi")
    return scores.orderBy(F.desc("score"), "doc_id").limit(most)


def in_topic(entries: DataFrame, topic: str | None) -> DataFrame:
    return entries if topic is None else entries.where(F.array_contains("topics", topic))


def entry(entries: DataFrame, key: object) -> DataFrame:
    """The entry of an id, or no row."""
    return entries.where(F.col("doc_id") == F.lit(key))


def newest(entries: DataFrame, topic: str | None = None) -> DataFrame:
    """All entries, or those of a topic, the last saved first."""
    return in_topic(entries, topic).orderBy(F.desc("saved_at"), "doc_id")


def clamp(limit: object, default: int = DEFAULT_LIMIT, most: int = MOST_RESULTS) -> int:
    """A number of results as an outside caller gave it: the default for what is no number, or 0."""
    try:
        n = float(str(limit))
    except ValueError:
        n = 0.0
    if n != n or n == 0:
        n = default
    return int(min(most, max(1, n)))


RESULT = ("doc_id", "url", "title", "domain", "saved_at", "topics", "snippet", "matched_in", "score", "keyword_rank", "vector_rank", "vector_score", "mode", "total")


def search(index: Index, query: str, topic: str | None = None, limit: int = 30, slugs: tuple[str, ...] | None = None, candidates: int = CANDIDATES) -> DataFrame:
    """The best entries for a query (RESULT), best first: keyword and vector candidates, fused; total counts them before
    the limit. A blank query gives the newest entries with score 0. A topic that isn't among slugs is ignored."""
    spark, q = index.entries.sparkSession, query.strip()
    topic = topic if topic and (slugs is None or topic in slugs) else None
    if not q:
        rows = in_topic(index.entries, topic)
        total = rows.agg(F.count("*").alias("total"))
        shown = rows.orderBy(F.desc("saved_at"), "doc_id").limit(limit).crossJoin(F.broadcast(total))
        none = {"score": F.lit(0.0), "keyword_rank": F.lit(None).cast("long"), "vector_rank": F.lit(None).cast("long"), "vector_score": F.lit(None).cast("double")}
        text = F.coalesce("description", "excerpt", F.lit(""))
        return shown.withColumns(none | {"snippet": text, "matched_in": F.lit("title"), "mode": F.lit("recent")}).select(*RESULT).orderBy(F.desc("saved_at"), "doc_id")
    words = query_terms(spark, q)
    kept = lambda leg: spark.createDataFrame(leg.collect(), index.entries.select("doc_id").schema.add("score", "double"))  # noqa: E731  at most `candidates` rows
    near = kept(vector_candidates(index, q, topic, candidates))
    fused = vectors.fuse(kept(keyword_candidates(index, q, words, topic, candidates)), near)
    found = fused.withColumn("total", F.count("*").over(Window.partitionBy(F.lit(1)))).orderBy(F.desc("score"), "doc_id").limit(limit)
    rows = index.entries.join(F.broadcast(found), "doc_id").withColumns(best_evidence(*map(F.col, ("title", "description", "excerpt", "topics")), words))
    mode = F.lit("keyword" if near.isEmpty() else "hybrid").alias("mode")
    ranks = {c: F.col(c).cast("long") for c in ("keyword_rank", "vector_rank", "total")}
    rows = rows.withColumns(ranks).select("*", mode)
    shown = snippets(rows, "doc_id", "evidence", words, keep=tuple(c for c in RESULT if c not in ("doc_id", "snippet")))
    return shown.select(*RESULT).orderBy(F.desc("score"), "doc_id")


def rounded(c: str, digits: int) -> Column:
    return F.floor(F.col(c) * F.lit(10.0**digits) + 0.5) / F.lit(10.0**digits)


def search_endpoint(index: Index, query: str | None, topic: str | None = None, limit: object = None, slugs: tuple[str, ...] | None = None) -> DataFrame:
    """The search as a program asks for it: limits clamped, scores rounded, a row of JSON by toJSON()."""
    found = search(index, query or "", topic, clamp(limit), slugs)
    return found.withColumns({"score": rounded("score", 4), "vector_score": rounded("vector_score", 3)})


def search_page(index: Index, query: str, topic: str | None = None, slugs: tuple[str, ...] | None = None) -> DataFrame:
    """The search as a page shows it."""
    return search(index, query[:PAGE_QUERY], topic, PAGE_LIMIT, slugs)


def suggestions(index: Index, typed: str) -> DataFrame:
    """The search as it runs while a query is typed: nothing before its second character."""
    found = search(index, typed, None, TYPED_LIMIT)
    return found if len(typed.strip()) >= TYPED_LEAST else found.where(F.lit(False))
