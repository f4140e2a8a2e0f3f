"""The registered queries over the driver's tables, each beside its DuckDB SQL.

Scores are rounded as floor(x * 10^n + 0.5) / 10^n on both sides, and every order is made total by an id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sedgewren.functions import text as T
from sedgewren.functions import urls as U
from sedgewren.operators import analysis as A
from sedgewren.operators import vectors as V
from sedgewren.plans import duck as D
from sedgewren.session import files_digest, shared_dir, table, text_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Terms that the ranking queries look for.
WORDS = ["thing", "inoran", "orantion"]
#: A small taxonomy for the topic queries: slug, place, keyword, weight. Real ones are passed in as tables.
TAXONOMY = [("alpha", 0, "thing", 3), ("alpha", 0, "onhean", 2), ("beta", 1, "inoran", 3), ("beta", 1, "thion", 2), ("gamma", 2, "nicht", 4), ("gamma", 2, "der", 1), ("delta", 3, "que", 2), ("delta", 3, "des", 1)]


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


def r(c: Column, n: int) -> Column:
    return F.floor(c * F.lit(10.0**n) + 0.5) / F.lit(10.0**n)


def count_long() -> Column:
    return F.count("*").alias("n")


# --- text and address functions


@query("tokenize", f"SELECT doc_id, CAST(p AS BIGINT) AS pos, ts[p] AS token FROM (SELECT doc_id, ts, unnest(range(1, len(ts) + 1)) AS p FROM (SELECT doc_id, {D.tokens('text')} AS ts FROM documents))")
def _(spark, d):
    return A.tokens(text_table(spark, d, "documents"), "doc_id", F.col("text"))


@query("stem", f"SELECT DISTINCT q AS token, {D.stem('q')} AS stem FROM (SELECT unnest({D.tokens('text')}) AS q FROM documents)")
def _(spark, d):
    rows = A.tokens(text_table(spark, d, "documents"), "doc_id", F.col("text")).select("token").distinct()
    return rows.select("token", T.stem(F.col("token")).alias("stem"))


@query("terms", f"SELECT doc_id, array_to_string({D.terms('text')}, ' ') AS terms FROM documents")
def _(spark, d):
    return A.joined_terms(text_table(spark, d, "documents"), "doc_id", F.col("text"))


@query("term_freq", f"SELECT doc_id, term, CAST(count(*) AS BIGINT) AS n FROM (SELECT doc_id, unnest({D.terms('text')}) AS term FROM documents) GROUP BY ALL")
def _(spark, d):
    docs = text_table(spark, d, "documents")
    found = A.term_counts(docs, "doc_id", F.col("text"))
    return found.groupBy("doc_id", "term").agg(F.sum("n").alias("n")) if A.repeats(docs, "doc_id") else found


@query("bigrams", f"SELECT doc_id, CAST(p AS BIGINT) AS pos, ts[p] AS a, ts[p + 1] AS b FROM (SELECT doc_id, ts, unnest(range(1, len(ts))) AS p FROM (SELECT doc_id, {D.terms('text')} AS ts FROM documents))")
def _(spark, d):
    return A.bigrams(text_table(spark, d, "documents"), "doc_id", F.col("text"))


@query("collapse_ws", f"SELECT page_id, {D.collapsed('html')} AS text FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", T.collapse_ws(F.col("html")).alias("text"))


@query("truncate_text", f"SELECT doc_id, {D.truncated('text', 240)} AS text FROM documents")
def _(spark, d):
    return text_table(spark, d, "documents").select("doc_id", T.truncate(F.col("text"), 240).alias("text"))


@query("card_blurb", f"SELECT page_id, {D.truncated('html', 260)} AS blurb, {D.truncated('url', 140)} AS title FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", T.truncate(F.col("html"), 260).alias("blurb"), T.truncate(F.col("url"), 140).alias("title"))


@query("format_date", "SELECT event_id, strftime(ts, '%b %-d, %Y') AS day FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", T.format_date(F.col("ts")).alias("day"))


@query(
    "relative_date",
    "SELECT o_orderkey, CASE WHEN n < 1 THEN 'today' WHEN n < 2 THEN 'yesterday' WHEN n < 30 THEN n || 'd ago' WHEN n < 365 THEN (n // 30) || 'mo ago' ELSE (n // 365) || 'y ago' END AS age "
    "FROM (SELECT o_orderkey, CAST(floor((epoch_us(TIMESTAMP '1999-01-01') - epoch_us(o_orderdate)) / 86400000000) AS BIGINT) AS n FROM orders)",
)
def _(spark, d):
    now = F.lit("1999-01-01 00:00:00").cast("timestamp")
    return table(spark, d, "orders").select("o_orderkey", T.relative_date(F.col("o_orderdate").cast("timestamp"), now).alias("age"))


@query("pluralize", "SELECT doc_id, format('{:,}', n_chars) || CASE WHEN n_chars = 1 THEN ' char' ELSE ' chars' END AS label FROM documents")
def _(spark, d):
    return text_table(spark, d, "documents").select("doc_id", T.pluralize(F.col("n_chars"), "char", "chars").alias("label"))


@query("fnv1a", f"SELECT w, {D.fnv('w')} AS h FROM (SELECT DISTINCT 'w:' || q AS w FROM (SELECT unnest({D.tokens('text')}) AS q FROM documents))")
def _(spark, d):
    rows = A.tokens(text_table(spark, d, "documents"), "doc_id", F.col("text")).select(F.col("token").alias("q")).distinct()
    return rows.select(F.concat(F.lit("w:"), "q").alias("w")).select("w", T.fnv1a(F.col("w")).alias("h"))


@query("page_text", "SELECT doc_id, concat_ws(chr(10), nullif(source, ''), nullif(lang, ''), nullif(left(text, 1500), '')) AS page_text FROM documents")
def _(spark, d):
    return text_table(spark, d, "documents").select("doc_id", T.page_text([F.col("source"), F.col("lang")], F.col("text"), 1500).alias("page_text"))


@query("search_text", "SELECT doc_id, concat_ws(chr(10), nullif(source, ''), nullif(lang, ''), nullif(text, '')) AS search_text FROM documents")
def _(spark, d):
    return text_table(spark, d, "documents").select("doc_id", T.page_text([F.col("source"), F.col("lang")], F.col("text"), 1 << 30).alias("search_text"))


@query("canonical_url", f"SELECT page_id, {D.canonical('url')} AS canonical FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", U.canonical_url(F.col("url")).alias("canonical"))


@query("url_domain", f"SELECT page_id, {D.host('url')} AS domain FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", U.domain(F.col("url")).alias("domain"))


@query("url_key", f"SELECT page_id, left(sha1({D.canonical('url')}), 16) AS key FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", U.url_key(U.canonical_url(F.col("url"))).alias("key"))


_MIXED = "CASE page_id % 4 WHEN 0 THEN 'https://t.co/' || page_id WHEN 1 THEN 'https://pbs.twimg.com/' || page_id WHEN 2 THEN 'ftp://h/' || page_id ELSE url END"


@query(
    "url_classify",
    f"SELECT page_id, u AS url, h IN ({D.SHORT}) AS shortener, h IN ({D.ORIGIN}) OR h LIKE '%.twimg.com' AS origin, "
    f"u LIKE 'http%' AND h NOT IN ({D.SHORT}) AND h NOT IN ({D.ORIGIN}) AND h NOT LIKE '%.twimg.com' AS external FROM (SELECT page_id, u, {D.host('u')} AS h FROM (SELECT page_id, {_MIXED} AS u FROM pages))",
)
def _(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", F.expr(_MIXED).alias("url")).select("page_id", "url", U.is_shortener(u).alias("shortener"), U.is_origin(u).alias("origin"), U.is_external(u).alias("external"))


@query("pretty_url", f"SELECT page_id, {D.truncated('u', 40)} AS pretty FROM (SELECT page_id, regexp_replace(regexp_replace(url, '^https?://', ''), '/$', '') AS u FROM pages)")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", U.pretty_url(F.col("url"), 40).alias("pretty"))


@query(
    "title_from_url",
    f"""SELECT page_id, CASE WHEN n = '' OR regexp_matches(n, '^[0-9]+$') THEN {D.host('url')}
  ELSE array_to_string(list_transform(string_split(n, ' '), lambda w: upper(left(w, 1)) || substr(w, 2)), ' ') END AS title
FROM (SELECT page_id, url, trim(regexp_replace(regexp_replace(url_decode(coalesce(list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/'), lambda s: s <> '')[-1], '')),
  '(?i)\\.(html?|php|aspx?|pdf|md)$', ''), '[-_+]+', ' ', 'g')) AS n FROM pages)""",
)
def _(spark, d):
    return table(spark, d, "pages").select("page_id", U.title_from_url(F.col("url")).alias("title"))


_POST = "'see ' || url || ' and https://t.co/' || page_id || ' or ' || url || ' too'"


@query("extract_urls", f"SELECT page_id, CAST(1 AS BIGINT) AS pos, {D.canonical('url')} AS url FROM pages")
def _(spark, d):
    rows = table(spark, d, "pages").select("page_id", F.expr(_POST).alias("post"))
    return rows.select("page_id", F.posexplode(U.extract_urls(F.col("post"))).alias("p", "url")).select("page_id", (F.col("p") + 1).cast("long").alias("pos"), "url")


@query("topic_alias", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'beta' WHEN 1 THEN 'gamma-ray' WHEN 2 THEN 'gamma-ray' END AS slug FROM pages")
def _(spark, d):
    from sedgewren.operators.topics import alias_slug

    given = F.expr("CASE page_id % 4 WHEN 0 THEN ' BETA ' WHEN 1 THEN 'Gamma_Ray' WHEN 2 THEN 'rays' ELSE 'none' END")
    return table(spark, d, "pages").select("page_id", alias_slug(given, {"beta": "beta", "gamma-ray": "gamma-ray", "rays": "gamma-ray"}).alias("slug"))


@query("coalesce_pick", "SELECT event_id, coalesce(nullif(trim(json_extract_string(props, '$.id')), ''), nullif(trim(json_extract_string(props, '$.k')), ''), event_type) AS picked FROM events")
def _(spark, d):
    pick = lambda k: F.nullif(F.trim(F.get_json_object("props", f"$.{k}")), F.lit(""))
    return table(spark, d, "events").select("event_id", F.coalesce(pick("id"), pick("k"), F.col("event_type")).alias("picked"))


# --- joins, aggregates, windows


def saves(spark: SparkSession, d: str) -> DataFrame:
    """Each event saves one page."""
    pages = table(spark, d, "pages").select("page_id", U.canonical_url(F.col("url")).alias("url"))
    n = pages.count()
    return table(spark, d, "events").select("event_id", "ts", (F.col("event_id") % n).alias("page_id")).join(pages, "page_id")


_SAVES = f"SELECT event_id, ts, p.url FROM events e JOIN (SELECT page_id, {D.canonical('url')} AS url FROM pages) p ON e.event_id % (SELECT count(*) FROM pages) = p.page_id"


@query("library_candidates", f"SELECT url, min(ts) AS saved_at, CAST(count(DISTINCT event_id) AS BIGINT) AS saves FROM ({_SAVES}) GROUP BY url")
def _(spark, d):
    return saves(spark, d).select("event_id", "ts", "url").distinct().groupBy("url").agg(F.min("ts").alias("saved_at"), F.count("*").alias("saves"))


@query("dedupe_first_wins", "SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY text")
def _(spark, d):
    return text_table(spark, d, "documents").groupBy("text").agg(F.min("doc_id").alias("doc_id"))


@query("dedupe_latest_first", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, max(ts) AS ts FROM events GROUP BY user_id")
def _(spark, d):
    top = F.max(F.struct("ts", "event_id")).alias("x")
    return table(spark, d, "events").groupBy("user_id").agg(top).select("user_id", "x.event_id", "x.ts")


@query("library_left_join", "SELECT d.doc_id, coalesce(l.quality, -1) AS quality, l.doc_id IS NOT NULL AS labelled, CASE WHEN l.doc_id IS NULL THEN 0 ELSE n_chars END AS n_chars FROM documents d LEFT JOIN labels l USING (doc_id)")
def _(spark, d):
    labels = table(spark, d, "labels").select("doc_id", "quality", F.lit(True).alias("hit"))
    rows = text_table(spark, d, "documents").select("doc_id", "n_chars").join(labels, "doc_id", "left")
    return rows.select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce("hit", F.lit(False)).alias("labelled"), F.when(F.col("hit"), F.col("n_chars")).otherwise(F.lit(0)).alias("n_chars"))


@query("crawl_queue", "SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.doc_id IS NULL OR l.quality = 0 OR d.n_chars > 20000")
def _(spark, d):
    from sedgewren.operators.library import crawl_queue

    return crawl_queue(text_table(spark, d, "documents"), table(spark, d, "labels"), "doc_id", (F.col("quality") == 0) | (F.col("n_chars") > 20000)).select("doc_id")


@query("prune_stale", "SELECT doc_id, quality, toxic FROM labels WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def _(spark, d):
    return table(spark, d, "labels").select("doc_id", "quality", "toxic").join(table(spark, d, "documents").where("lang = 'en'"), "doc_id", "left_semi")


@query("shortlink_join", "SELECT p.page_id, q.url FROM pages p JOIN pages q ON q.page_id = 2 * p.page_id")
def _(spark, d):
    pages = table(spark, d, "pages")
    return pages.select("page_id").join(pages.select(F.col("page_id").alias("other"), "url"), F.col("other") == 2 * F.col("page_id")).select("page_id", "url")


@query(
    "redirect_chase",
    """WITH RECURSIVE hop(page_id, pos, n) AS (SELECT page_id, page_id, 0 FROM pages UNION ALL SELECT page_id, pos // 2, n + 1 FROM hop WHERE n < 4 AND pos > 1 AND pos % 2 = 0)
SELECT page_id, arg_max(pos, n) AS target, CAST(max(n) AS BIGINT) AS hops FROM hop GROUP BY page_id""",
)
def _(spark, d):
    from sedgewren.operators.library import chase

    pages = table(spark, d, "pages").select("page_id")
    links = pages.where("page_id > 1 AND page_id % 2 = 0").select(F.col("page_id").alias("src"), F.expr("page_id div 2").alias("dst"))
    return chase(pages, "page_id", links, 4)


@query(
    "resolve_links",
    """SELECT page_id, CASE page_id % 6 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN 'p' || page_id || '/1' WHEN 3 THEN NULL WHEN 4 THEN NULL ELSE 'p' || page_id || '/4' END AS url,
CASE page_id % 6 WHEN 0 THEN 'error' WHEN 1 THEN 'dead' WHEN 2 THEN 'resolved' WHEN 3 THEN 'loop' WHEN 4 THEN 'error' ELSE 'resolved' END AS status FROM pages""",
)
def _(spark, d):
    from sedgewren.operators.library import resolve_links

    k = F.col("page_id") % 6
    at = lambda n: F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit(f"/{n}"))
    none = F.lit(None).cast("string")
    answer = lambda n, to, status, error=none: F.struct(at(n).alias("url"), to.alias("location"), F.lit(status).cast("int").alias("http_status"), error.alias("error"))
    chain = F.array(*[answer(n, at(n + 1), 302) for n in range(5)])
    made = F.when(k == 0, F.array(answer(0, none, 200))).when(k == 1, F.array(answer(0, none, 410))).when(k == 2, F.array(answer(0, at(1), 301), answer(1, none, 404)))
    made = made.when(k == 3, F.array(answer(0, at(1), 301), answer(1, at(0), 301))).when(k == 4, F.array(answer(0, none, None, F.lit("refused")))).otherwise(chain)
    pages = table(spark, d, "pages").select("page_id")
    found = resolve_links(pages.select(at(0).alias("short")), "short", pages.select(F.inline(made)))
    return found.select(F.regexp_extract("short", r"p(\d+)/", 1).cast("long").alias("page_id"), "url", "status")


@query("related_lookup", "SELECT a.vec_id, CAST(k AS BIGINT) AS pos, b.label FROM (SELECT vec_id, unnest([1, 2, 3, 4]) AS k FROM embeddings) a JOIN embeddings b ON b.vec_id = a.vec_id + a.k")
def _(spark, d):
    rows = table(spark, d, "embeddings")
    refs = rows.select("vec_id", F.posexplode(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda k: F.col("vec_id") + k)).alias("p", "ref"))
    return refs.join(rows.select(F.col("vec_id").alias("ref"), "label"), "ref").select("vec_id", (F.col("p") + 1).cast("long").alias("pos"), "label")


@query("domain_suffix_join", f"SELECT page_id, s.suffix FROM (SELECT page_id, {D.host('url')} AS h FROM pages) p JOIN (VALUES ('com'), ('org'), ('example.com'), ('net')) s(suffix) ON h = s.suffix OR h LIKE '%.' || s.suffix")
def _(spark, d):
    from sedgewren.operators.topics import host_suffixes

    listed = spark.createDataFrame([("com",), ("org",), ("example.com",), ("net",)], "suffix string")
    rows = table(spark, d, "pages").select("page_id", F.explode(host_suffixes(U.domain(F.col("url")))).alias("suffix"))
    return rows.join(F.broadcast(listed), "suffix").select("page_id", "suffix")


@query("url_union_distinct", f"SELECT {D.canonical('url')} AS url FROM pages UNION SELECT 'https://resolved.example/' || page_id % 10 FROM pages")
def _(spark, d):
    pages = table(spark, d, "pages")
    return pages.select(U.canonical_url(F.col("url")).alias("url")).union(pages.select(F.concat(F.lit("https://resolved.example/"), (F.col("page_id") % 10).cast("string")))).distinct()


@query(
    "sitemap_feed",
    f"""SELECT * FROM (VALUES ('/', TIMESTAMP '2024-01-01', 1.0::DOUBLE), ('/topics', TIMESTAMP '2024-01-01', 0.8)) v(path, last_modified, priority)
UNION ALL SELECT DISTINCT '/topics/' || lang, TIMESTAMP '2024-01-01', 0.7 FROM documents WHERE lang IS NOT NULL UNION ALL SELECT '/s/' || left(sha1({D.canonical('url')}), 16), make_timestamp(page_id * 1000000), 0.5 FROM pages""",
)
def _(spark, d):
    from sedgewren.operators.library import sitemap

    entries = table(spark, d, "pages").select(U.url_key(U.canonical_url(F.col("url"))).alias("key"), F.timestamp_seconds("page_id").cast("timestamp_ntz").alias("saved_at"))
    return sitemap(table(spark, d, "documents").select("lang").where("lang is not null").distinct(), "lang", entries, "key", "saved_at", F.lit("2024-01-01").cast("timestamp_ntz"))


@query("status_rollup", "SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1")
def _(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(count_long()).orderBy(F.desc("n"), "event_type")


@query("topic_counts", "SELECT lang AS slug, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY 1 UNION ALL SELECT 'misc', 0")
def _(spark, d):
    from sedgewren.operators.topics import topic_counts

    slugs = spark.createDataFrame([("en",), ("de",), ("fr",), ("es",), ("xx",), ("misc",)], "slug string")
    return topic_counts(text_table(spark, d, "documents").select(F.array("lang").alias("topics")), slugs)


@query("topic_rank", "SELECT source AS slug, CAST(row_number() OVER (ORDER BY count(*) DESC, source) AS BIGINT) AS rank FROM documents GROUP BY source")
def _(spark, d):
    from sedgewren.operators.library import ranked_groups

    return ranked_groups(text_table(spark, d, "documents"), "source").select(F.col("source").alias("slug"), F.col("rank").cast("long").alias("rank"))


@query(
    "topic_summaries",
    """WITH c AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, source) AS rank FROM c)
SELECT lang, CAST(rank AS BIGINT) AS rank, source, CAST(n AS BIGINT) AS n, (SELECT max(doc_id) FROM documents d WHERE d.lang = k.lang) AS latest FROM k WHERE rank <= 3""",
)
def _(spark, d):
    from sedgewren.operators.library import top_per_group

    docs = text_table(spark, d, "documents")
    latest = docs.groupBy("lang").agg(F.max("doc_id").alias("latest"))
    return top_per_group(docs, "lang", "source", 3).join(F.broadcast(latest), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "source", "n", "latest")


@query(
    "library_stats",
    "SELECT CAST(count(*) AS BIGINT) AS entries, CAST(count(DISTINCT source) AS BIGINT) AS domains, CAST(count(*) FILTER (quality = 1) AS BIGINT) AS ok, CAST(coalesce(sum(n_chars) FILTER (quality = 1), 0) AS BIGINT) AS chars, min(doc_id) AS first, max(doc_id) AS last FROM documents LEFT JOIN labels USING (doc_id)",
)
def _(spark, d):
    rows = text_table(spark, d, "documents").select("doc_id", "source", "n_chars").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    ok = F.col("quality") == 1
    return rows.agg(F.count("*").alias("entries"), F.count_distinct("source").alias("domains"), F.count_if(ok).alias("ok"), F.coalesce(F.sum(F.when(ok, F.col("n_chars"))), F.lit(0)).alias("chars"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))


_SAVED = f"""SELECT page_id, page_id % 4 AS k, {D.canonical('url')} AS url FROM pages"""
_REPORT = f"""SELECT CAST(count(*) AS BIGINT) AS records, CAST(count(DISTINCT CASE WHEN page_id % 3 = 0 THEN 'unknown' ELSE 'a' || page_id % 7 END) AS BIGINT) AS authors, CAST(count(*) FILTER (page_id % 5 = 0) AS BIGINT) AS undated,
CAST(count(*) FILTER (page_id % 3 = 0) AS BIGINT) AS unknown_authors, CAST(count(*) FILTER (k = 0) AS BIGINT) AS empty_text, CAST(count(*) FILTER (k = 1) AS BIGINT) AS short_only, CAST(count(*) FILTER (k IN (0, 2)) AS BIGINT) AS no_links,
CAST(count(DISTINCT url) FILTER (k = 3) AS BIGINT) AS links, CAST(count(DISTINCT {D.host('url')}) FILTER (k = 3) AS BIGINT) AS domains, CAST(count(*) FILTER (k = 1) AS BIGINT) AS short_links, CAST(0 AS BIGINT) AS rejected FROM ({_SAVED})"""


def _saved_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages as saved posts: without text, with a short link, without a link, or with the page's address; some of them
    without an author or a date."""
    from sedgewren.sources.records import normalise

    k, key = F.col("page_id") % 4, F.col("page_id").cast("string")
    text = F.when(k == 1, F.concat(F.lit("see https://t.co/x"), key)).when(k == 2, "a note").when(k == 3, F.concat(F.lit("seen at "), "url")).otherwise("")
    author = F.when(F.col("page_id") % 3 > 0, F.concat(F.lit("A"), (F.col("page_id") % 7).cast("string")))
    made = F.struct(key.alias("id"), text.alias("text"), author.alias("author_handle"), F.when(F.col("page_id") % 5 > 0, "2024-05-06T07:08:09Z").alias("created_at"))
    return normalise(table(spark, d, "pages").select("page_id", F.try_parse_json(F.to_json(made)).alias("record")), "record", "page_id")


@query("quality_report", _REPORT)
def _(spark, d):
    from sedgewren.sources.records import quality_report

    return quality_report(_saved_pages(spark, d))


_KINDS = "(VALUES ('unknown_authors', unknown_authors), ('undated', undated), ('empty_text', empty_text), ('short_only', short_only)) v(kind, n)"


@query("report_warnings", f"SELECT kind, n, CAST(floor(100.0 * n / records + 0.5) AS BIGINT) AS percent FROM ({_REPORT}) r, {_KINDS} WHERE n > 0")
def _(spark, d):
    from sedgewren.sources.records import quality_report, report_warnings

    return report_warnings(quality_report(_saved_pages(spark, d))).select("kind", "n", "percent")


@query("index_meta", "SELECT CAST((SELECT count(*) FROM documents) AS BIGINT) AS link_count, CAST((SELECT count(*) FROM events) AS BIGINT) AS source_count, CAST((SELECT count(*) FROM labels) AS BIGINT) AS crawled_count, CAST(512 AS BIGINT) AS dimensions")
def _(spark, d):
    one = lambda t, n: table(spark, d, t).agg(F.count("*").alias(n))
    return one("documents", "link_count").crossJoin(one("events", "source_count")).crossJoin(one("labels", "crawled_count")).withColumn("dimensions", F.lit(V.DIMENSIONS).cast("long"))


@query("recent_topk", "SELECT event_id, ts FROM events WHERE event_type = (SELECT min(event_type) FROM events) ORDER BY ts DESC, event_id LIMIT 50")
def _(spark, d):
    rows = table(spark, d, "events")
    return rows.join(F.broadcast(rows.agg(F.min("event_type").alias("event_type"))), "event_type").select("event_id", "ts").orderBy(F.desc("ts"), "event_id").limit(50)


@query("filter_topic", "SELECT doc_id FROM documents WHERE lang = 'de' OR source = 'src1'")
def _(spark, d):
    return text_table(spark, d, "documents").where(F.array_contains(F.array("lang", "source"), "de") | F.array_contains(F.array("lang", "source"), "src1")).select("doc_id")


@query("throttle_schedule", f"SELECT page_id, domain, CAST((row_number() OVER (PARTITION BY domain ORDER BY page_id) - 1) * 750 AS BIGINT) AS start_ms FROM (SELECT page_id, {D.host('url')} AS domain FROM pages)")
def _(spark, d):
    from sedgewren.operators.robots import schedule

    return schedule(table(spark, d, "pages").select("page_id", U.domain(F.col("url")).alias("domain")), "domain", "page_id", 750)


@query(
    "fetch_outcome",
    "SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'ok' WHEN 1 THEN 'http_error' WHEN 2 THEN 'unsupported_type' WHEN 3 THEN 'timeout' ELSE 'network_error' END AS status FROM pages",
)
def _(spark, d):
    from sedgewren.operators.robots import fetch_outcome

    k = F.col("page_id") % 5
    status = F.when(k == 1, 404).when(k < 3, 200)
    kind = F.when(k == 2, "application/pdf").otherwise("text/html; charset=utf-8")
    error = F.when(k == 3, "TimeoutError: the operation timed out").when(k == 4, "connect refused")
    return table(spark, d, "pages").select("page_id", fetch_outcome(error, status, kind).alias("status"))


@query(
    "robots_decision",
    f"""SELECT page_id, coalesce((SELECT arg_max(allow, (length(pattern), allow)) FROM (VALUES ('/', true), ('/*?', false), ('/a', false), ('/*.html$', true)) v(pattern, allow)
  WHERE regexp_matches(t, CASE pattern WHEN '/' THEN '^/' WHEN '/*?' THEN '^/.*\\?' WHEN '/a' THEN '^/a' ELSE '^/.*\\.html$' END)), true) AS allowed
FROM (SELECT page_id, CASE WHEN x = '' OR x[1] <> '/' THEN '/' || x ELSE x END AS t FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]+([^#]*)', 1) AS x FROM pages))""",
)
def _(spark, d):
    from sedgewren.operators.robots import allowed

    rules = F.array(*[F.struct(F.lit(p).alias("pattern"), F.lit(a).alias("allow")) for p, a in (("/", True), ("/*?", False), ("/a", False), ("/*.html$", True))])
    target = F.regexp_extract("url", "^[a-z]+://[^/?#]+([^#]*)", 1)
    target = F.when(target.startswith("/"), target).otherwise(F.concat(F.lit("/"), target))
    return table(spark, d, "pages").select("page_id", allowed(target, rules).alias("allowed"))


@query("extract_article")
def _(spark, d):
    from sedgewren.operators.html import extract_articles

    return extract_articles(table(spark, d, "pages"), "page_id", "html")


# --- topics


_TAX = ", ".join(f"('{s}', {o}, '{k}', {w})" for s, o, k, w in TAXONOMY)
_SCORES = f"""WITH tok AS (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest({D.terms('text')}) AS term FROM documents) GROUP BY ALL),
tax(slug, ord, keyword, weight) AS (VALUES {_TAX}),
raw AS (SELECT doc_id, slug, ord, sum(weight * (1 + ln(n))) AS s FROM tok JOIN tax ON term = keyword GROUP BY ALL),
scored AS (SELECT doc_id, slug, ord, {D.rounded('s / max(s) OVER (PARTITION BY doc_id)', 3)} AS score FROM raw)"""


def _taxonomy(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TAXONOMY, "slug string, ord int, keyword string, weight int")


@query("topic_scores", f"{_SCORES} SELECT doc_id, slug, score FROM scored")
def _(spark, d):
    from sedgewren.operators.topics import topic_scores

    return topic_scores(text_table(spark, d, "documents"), "doc_id", F.col("text"), _taxonomy(spark)).select("doc_id", "slug", "score")


@query(
    "topic_pick",
    f"{_SCORES}, k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ord) AS rank FROM scored) SELECT d.doc_id, CAST(coalesce(rank, 1) AS BIGINT) AS rank, coalesce(slug, 'misc') AS slug FROM documents d LEFT JOIN (SELECT * FROM k WHERE rank = 1 OR (rank <= 3 AND score >= 0.34)) k USING (doc_id)",
)
def _(spark, d):
    from sedgewren.operators.topics import pick_topics, topic_scores

    docs = text_table(spark, d, "documents")
    return pick_topics(docs.select("doc_id"), topic_scores(docs, "doc_id", F.col("text"), _taxonomy(spark)))


# --- ranking: the library's entries are made from the documents, and all queries read one stored index of them


_ENTRIES = f"""lib AS (SELECT *, concat_ws(chr(10), nullif(title, ''), nullif(description, ''), nullif(site_name, ''), nullif(domain, ''), nullif(text, ''), nullif(lang, '')) AS search_text FROM
  (SELECT doc_id, left(text, 60) AS title, substr(text, 61, 140) AS description, source || '.example.org' AS domain, source AS site_name, lang, text, {D.truncated('text', 2400)} AS excerpt FROM documents))"""
_FIELDS = " UNION ALL ".join(f"SELECT doc_id, unnest({D.terms(x)}) AS term, {w} AS w, {p} AS p FROM lib" for x, w, p in (("search_text", 100, 35), ("title", 340, 119), ("description", 240, 84), ("replace(domain, '.', ' ')", 220, 77), ("replace(lang, '-', ' ')", 200, 70)))
_POSTINGS = f"""WITH {_ENTRIES}, t AS ({_FIELDS}),
post AS (SELECT doc_id, term, CAST(sum(w) AS BIGINT) AS tf FROM (SELECT doc_id, term, w FROM t UNION ALL SELECT doc_id, '~' || left(term, 6), p FROM t WHERE length(term) > 6) GROUP BY ALL),
len AS (SELECT doc_id, CAST(greatest(len({D.tokens('search_text')}), 1) AS BIGINT) AS len FROM lib)"""


def _ranked(keys: str) -> str:
    return f"""{_POSTINGS}, keys(key, factor) AS (VALUES {keys}),
hit AS (SELECT doc_id, term, factor, tf / 100.0::DOUBLE AS tf FROM post JOIN keys ON term = key),
df AS (SELECT term, count(DISTINCT doc_id) AS df FROM hit GROUP BY term), st AS (SELECT count(*) AS n, avg(len) AS al FROM len),
bm AS (SELECT doc_id, round(sum(factor * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.4 / (tf + 1.4 * (0.25 + 0.75 * len / al))), 12) AS score FROM hit JOIN df USING (term) JOIN len USING (doc_id), st GROUP BY doc_id)"""


_BM25 = _ranked("('thing', 1.0::DOUBLE), ('inoran', 1.0), ('orantion', 1.0), ('~oranti', 0.35)")


def _entries(spark: SparkSession, d: str) -> DataFrame:
    from sedgewren.operators.search import full_text

    docs = text_table(spark, d, "documents")
    topics = F.when(F.col("lang").isNotNull(), F.array("lang")).otherwise(F.array().cast("array<string>"))
    rows = docs.select(
        "doc_id", F.concat(F.lit("https://"), "source", F.lit(".example.org/"), F.col("doc_id").cast("string")).alias("url"), F.substring("text", 1, 60).alias("title"), F.substring("text", 61, 140).alias("description"),
        F.concat("source", F.lit(".example.org")).alias("domain"), F.col("source").alias("site_name"), topics.alias("topics"), T.truncate(F.col("text"), 2400).alias("excerpt"), "text", F.timestamp_seconds("doc_id").alias("saved_at"),
    )
    return rows.withColumn("search_text", full_text(*map(F.col, ("title", "description", "site_name", "domain", "text", "topics"))))


def _library(spark: SparkSession, d: str):
    """The stored index of a folder's documents, written by the first query that needs it; other documents (by their files'
    names, lengths and times) have another index."""
    from sedgewren.operators import search as S

    folder = f"{shared_dir(spark)}/sedgewren/index-{files_digest(spark, f'{d}/documents.parquet')}"
    if not S.complete(spark, folder):
        S.write_search_index(_entries(spark, d), folder)
    return S.open_search_index(spark, folder)


def _bm25(spark: SparkSession, d: str) -> DataFrame:
    from sedgewren.operators.search import keyword_scores

    return keyword_scores(_library(spark, d), WORDS)


@query("postings", f"{_POSTINGS} SELECT doc_id, term, tf FROM post")
def _(spark, d):
    return _library(spark, d).postings.select("doc_id", "term", "tf")


@query("corpus_stats", f"{_POSTINGS} SELECT CAST(count(*) AS BIGINT) AS n, {D.rounded('avg(len)', 4)} AS avg_len, CAST((SELECT count(DISTINCT term) FROM post) AS BIGINT) AS keys FROM len")
def _(spark, d):
    index = _library(spark, d)
    return index.facts.select("n", r(F.col("avg_len"), 4).alias("avg_len")).crossJoin(index.postings.agg(F.count_distinct("term").alias("keys")))


@query("bm25_topk", f"{_BM25} SELECT doc_id, {D.rounded('score', 6)} AS score FROM bm ORDER BY bm.score DESC, doc_id LIMIT 60")
def _(spark, d):
    return _bm25(spark, d).orderBy(F.desc("score"), "doc_id").limit(60).select("doc_id", r(F.col("score"), 6).alias("score"))


_HEADLINE = "lower(concat_ws(' ', title, description, domain, site_name))"


_PHRASE = f"score * CASE WHEN contains({_HEADLINE}, 'thing') THEN 1.6 WHEN contains(lower(search_text), 'thing') THEN 1.25 ELSE 1.0 END"


@query("bm25_phrase", f"{_BM25} SELECT doc_id, {D.rounded(_PHRASE, 6)} AS score FROM bm JOIN lib USING (doc_id)")
def _(spark, d):
    from sedgewren.operators.search import boosted

    return boosted(_library(spark, d), _bm25(spark, d), " Thing ").select("doc_id", r(F.col("score"), 6).alias("score"))


_COS = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


def _first_vector(spark: SparkSession, d: str) -> list[float]:
    return [float(x) for x in table(spark, d, "embeddings").where("vec_id = 0").first()["embedding"]]


@query("cosine_pairs", f"SELECT a.vec_id, {D.rounded(_COS, 6)} AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def _(spark, d):
    rows = table(spark, d, "embeddings")
    nexts = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return rows.join(nexts, "vec_id").select("vec_id", r(V.cosine(F.col("embedding"), F.col("other")), 6).alias("score"))


@query("knn_topk", f"SELECT a.vec_id, {D.rounded(_COS, 6)} AS score FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) b WHERE a.vec_id NOT IN (0, 3) ORDER BY score DESC, a.vec_id LIMIT 20")
def _(spark, d):
    return V.knn(table(spark, d, "embeddings"), _first_vector(spark, d), 20, "vec_id", "embedding", exclude=(0, 3)).select("vec_id", r(F.col("score"), 6).alias("score"))


@query("knn_filtered", f"SELECT a.vec_id, {D.rounded(_COS, 6)} AS score FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) b WHERE a.label = 3 ORDER BY score DESC, a.vec_id LIMIT 20")
def _(spark, d):
    return V.knn(table(spark, d, "embeddings"), _first_vector(spark, d), 20, "vec_id", "embedding", where=F.col("label") == 3).select("vec_id", r(F.col("score"), 6).alias("score"))


@query(
    "related_topk",
    f"SELECT id, CAST(rank AS BIGINT) AS rank, neighbour, {D.rounded('s', 6)} AS score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, neighbour) AS rank FROM (SELECT a.vec_id AS id, b.vec_id AS neighbour, {_COS} AS s FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id) WHERE s > 0.02) WHERE rank <= 6",
)
def _(spark, d):
    return V.related(table(spark, d, "embeddings"), "vec_id", "embedding").select("id", F.col("rank").cast("long").alias("rank"), "neighbour", r(F.col("score"), 6).alias("score"))


@query("vector_quantize", "SELECT vec_id, CAST(p AS BIGINT) AS pos, floor(embedding[p]::DOUBLE * 1e5 + 0.5) / 1e5 AS x FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS p FROM embeddings)")
def _(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("p", "x"))
    return rows.select("vec_id", (F.col("p") + 1).cast("long").alias("pos"), r(F.col("x").cast("double"), 5).alias("x"))


def _features(source: str) -> str:
    """Common tables up to b (doc_id, bucket, x) over a table of doc_id and text."""
    return f"""ts AS (SELECT doc_id, {D.terms('text')} AS t FROM {source}), w AS (SELECT doc_id, unnest(t) AS w FROM ts),
f AS (SELECT doc_id, 'w:' || w AS f, 20 AS x FROM w UNION ALL SELECT doc_id, 'b:' || t[p] || '_' || t[p + 1], 12 FROM (SELECT doc_id, t, unnest(range(1, len(t))) AS p FROM ts)
  UNION ALL SELECT doc_id, 'c:' || substr(w, p, 4), 5 FROM (SELECT doc_id, w, unnest(range(1, length(w) - 2)) AS p FROM w WHERE length(w) >= 5)),
g AS (SELECT doc_id, f, sum(x) AS x FROM f GROUP BY ALL), hh AS (SELECT f, {D.fnv('f')} AS h FROM (SELECT DISTINCT f FROM g)),
b AS (SELECT doc_id, h % 512 AS bucket, CAST(sum(CASE WHEN h >= 2147483648 THEN -x ELSE x END) AS BIGINT) AS x FROM g JOIN hh USING (f) GROUP BY ALL),
unit AS (SELECT doc_id, bucket, x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)::DOUBLE) AS weight FROM b WHERE x <> 0)"""


@query("local_embed", f"WITH {_features('documents')} SELECT doc_id, bucket, {D.rounded('weight', 6)} AS weight FROM unit")
def _(spark, d):
    return V.local_embed(text_table(spark, d, "documents"), "doc_id", F.col("text")).select("doc_id", "bucket", r(F.col("weight"), 6).alias("weight"))


_FUSED = f"""{_BM25}, kw AS (SELECT doc_id, score / max(score) OVER () AS k, row_number() OVER (ORDER BY score DESC, doc_id) AS keyword_rank FROM (SELECT * FROM bm ORDER BY score DESC, doc_id LIMIT 60)),
vs AS (SELECT a.vec_id AS doc_id, {_COS} AS s FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) b ORDER BY s DESC, a.vec_id LIMIT 60),
vr AS (SELECT *, row_number() OVER (ORDER BY s DESC, doc_id) AS vector_rank, max(s) OVER () AS top FROM vs), vk AS (SELECT *, least(1.0, greatest(0.0, (s - 0.04) / 0.26)) AS c FROM vr WHERE s >= greatest(0.02, 0.4 * top)),
fused AS (SELECT doc_id, coalesce(k, 0) + 0.8 * coalesce(c, 0) AS score, keyword_rank, vector_rank, s FROM kw FULL JOIN vk USING (doc_id) WHERE k IS NOT NULL OR c >= 0.12)"""


def _fused(spark: SparkSession, d: str) -> DataFrame:
    words = _bm25(spark, d).orderBy(F.desc("score"), "doc_id").limit(60)
    near = V.knn(table(spark, d, "embeddings"), _first_vector(spark, d), 60, "vec_id", "embedding").withColumnRenamed("vec_id", "doc_id")
    return V.fuse(words, near)


@query("hybrid_fusion", f"{_FUSED} SELECT doc_id, {D.rounded('score', 6)} AS score, CAST(coalesce(keyword_rank, 0) AS BIGINT) AS keyword_rank, CAST(coalesce(vector_rank, 0) AS BIGINT) AS vector_rank, {D.rounded('coalesce(s, -1)', 6)} AS vector_score FROM fused")
def _(spark, d):
    rank = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return _fused(spark, d).select("doc_id", r(F.col("score"), 6).alias("score"), rank("keyword_rank"), rank("vector_rank"), r(F.coalesce("vector_score", F.lit(-1.0)), 6).alias("vector_score"))


@query("search_api", f"{_FUSED} SELECT doc_id, {D.rounded('score', 4)} AS score, {D.rounded('coalesce(s, -1)', 3)} AS vector_score, CAST(count(*) OVER () AS BIGINT) AS total FROM fused ORDER BY fused.score DESC, doc_id LIMIT 8")
def _(spark, d):
    rows = _fused(spark, d)
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(F.desc("score"), "doc_id").limit(8).crossJoin(F.broadcast(total)).select("doc_id", r(F.col("score"), 4).alias("score"), r(F.coalesce("vector_score", F.lit(-1.0)), 3).alias("vector_score"), "total")


_Q = "orantion"
_SEARCH_CORE = f"""{_ranked("('orantion', 1.0::DOUBLE), ('~oranti', 0.35)")},
boost AS (SELECT doc_id, lang, score * CASE WHEN contains({_HEADLINE}, '{_Q}') THEN 1.6 WHEN contains(lower(search_text), '{_Q}') THEN 1.25 ELSE 1.0 END AS score FROM bm JOIN lib USING (doc_id)),
texts AS (SELECT doc_id, concat_ws(chr(10), nullif(title, ''), nullif(description, ''), nullif(site_name, ''), nullif(replace(domain, '.', ' '), ''), nullif(left(excerpt, 1600), ''), nullif(lang, '')) AS text FROM lib UNION ALL SELECT -1, '{_Q}'),
{_features('texts')}, near AS (SELECT a.doc_id, round(sum(a.weight * b.weight), 12) AS s FROM unit a JOIN unit b ON a.bucket = b.bucket AND b.doc_id = -1 AND a.doc_id <> -1 GROUP BY a.doc_id)"""


def _search_sql(where: str, limit: int, columns: str) -> str:
    return f"""{_SEARCH_CORE}, kw AS (SELECT doc_id, score / max(score) OVER () AS k, row_number() OVER (ORDER BY score DESC, doc_id) AS keyword_rank FROM (SELECT * FROM boost WHERE {where} ORDER BY score DESC, doc_id LIMIT 60)),
vs AS (SELECT doc_id, s FROM near JOIN lib USING (doc_id) WHERE {where} ORDER BY s DESC, doc_id LIMIT 60),
vr AS (SELECT *, row_number() OVER (ORDER BY s DESC, doc_id) AS vector_rank, max(s) OVER () AS top FROM vs), vk AS (SELECT *, least(1.0, greatest(0.0, (s - 0.04) / 0.26)) AS c FROM vr WHERE s >= greatest(0.02, 0.4 * top)),
fused AS (SELECT doc_id, coalesce(k, 0) + 0.8 * coalesce(c, 0) AS score, keyword_rank, vector_rank, s, count(*) OVER () AS total FROM kw FULL JOIN vk USING (doc_id) WHERE k IS NOT NULL OR c >= 0.12),
best AS (SELECT * FROM fused ORDER BY score DESC, doc_id LIMIT {limit}),
ev AS (SELECT doc_id, len(list_filter({D.terms("concat_ws(' — ', nullif(title, ''), nullif(description, ''))")}, lambda x: x = '{_Q}')) AS h, len(list_filter({D.terms('excerpt')}, lambda x: x = '{_Q}')) AS e FROM lib)
SELECT doc_id, {columns}, CAST(keyword_rank AS BIGINT) AS keyword_rank, CAST(vector_rank AS BIGINT) AS vector_rank, CAST(total AS BIGINT) AS total, CASE WHEN h = 0 AND e = 0 THEN 'semantic' WHEN e > h THEN 'page' ELSE 'title' END AS matched_in FROM best JOIN ev USING (doc_id)"""


@query("search_library", _search_sql("true", 30, f"{D.rounded('score', 6)} AS score, {D.rounded('s', 6)} AS vector_score"))
def _(spark, d):
    from sedgewren.operators.search import search

    found = search(_library(spark, d), f" {_Q} ", topic="nothing", slugs=("en", "de", "fr", "es"))
    return found.select("doc_id", r(F.col("score"), 6).alias("score"), r(F.col("vector_score"), 6).alias("vector_score"), "keyword_rank", "vector_rank", "total", "matched_in")


@query("search_endpoint", _search_sql("lang = 'en'", 8, f"{D.rounded('score', 4)} AS score, {D.rounded('s', 3)} AS vector_score"))
def _(spark, d):
    from sedgewren.operators.search import search_endpoint

    return search_endpoint(_library(spark, d), _Q, "en", "0", ("en", "de", "fr", "es")).select("doc_id", "score", "vector_score", "keyword_rank", "vector_rank", "total", "matched_in")


@query("search_recent", "SELECT doc_id, CAST(count(*) OVER () AS BIGINT) AS total, 0.0::DOUBLE AS score FROM documents WHERE lang = 'de' ORDER BY doc_id DESC LIMIT 50")
def _(spark, d):
    from sedgewren.operators.search import search_endpoint

    return search_endpoint(_library(spark, d), "  ", "de", 500).select("doc_id", "total", "score")


@query("embed_text", f"WITH {_ENTRIES} SELECT doc_id, concat_ws(chr(10), nullif(title, ''), nullif(description, ''), nullif(site_name, ''), nullif(replace(domain, '.', ' '), ''), nullif(left(text, 1600), ''), nullif(lang, '')) AS embed_text FROM lib")
def _(spark, d):
    from sedgewren.operators.search import embed_text

    return _entries(spark, d).select("doc_id", embed_text(*map(F.col, ("title", "description", "site_name", "domain", "text", "topics"))).alias("embed_text"))


_ASKED = "('thing', 'inoran', 'orantion', 'fr')"


@query(
    "matched_in",
    f"""WITH {_ENTRIES}, n AS (SELECT doc_id, lang, len(list_filter({D.terms("concat_ws(' — ', nullif(title, ''), nullif(description, ''))")}, lambda x: x IN {_ASKED})) AS h, len(list_filter({D.terms('excerpt')}, lambda x: x IN {_ASKED})) AS e FROM lib)
SELECT doc_id, CASE WHEN h = 0 AND e = 0 THEN CASE WHEN lang = 'fr' THEN 'topic' ELSE 'semantic' END WHEN e > h THEN 'page' ELSE 'title' END AS matched_in FROM n""",
)
def _(spark, d):
    from sedgewren.operators.snippets import matched_in

    return matched_in(_entries(spark, d), ("doc_id",), *map(F.col, ("title", "description", "excerpt", "topics")), [*WORDS, "fr"])


_WORD = "[\\p{L}\\p{N}][\\p{L}\\p{N}''+#.\\-]*"


@query(
    "highlight_runs",
    f"""WITH pc AS (SELECT doc_id, unnest(ps) AS w, generate_subscripts(ps, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{_WORD}|[^\\p{{L}}\\p{{N}}]+') AS ps FROM documents)),
f AS (SELECT *, coalesce({D.stem('lower(w)')} IN ('thing', 'inoran', 'orantion'), false) AS m FROM pc), g AS (SELECT *, 2 * count(*) FILTER (m) OVER (PARTITION BY doc_id ORDER BY i) - m::INT AS k FROM f)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) AS BIGINT) AS pos, string_agg(w, '' ORDER BY i) AS text, bool_or(m) AS match FROM g GROUP BY doc_id, k""",
)
def _(spark, d):
    from sedgewren.operators.snippets import highlight_runs

    runs = text_table(spark, d, "documents").select("doc_id", F.posexplode(highlight_runs(F.col("text"), WORDS)).alias("p", "x"))
    return runs.select("doc_id", (F.col("p") + 1).cast("long").alias("pos"), "x.text", "x.match")


@query("highlight_hits", f"SELECT doc_id, CAST(len(list_filter(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}][\\p{{L}}\\p{{N}}''+#.\\-]*'), lambda w: {D.stem('lower(w)')} IN ('thing', 'inoran', 'orantion'))) AS BIGINT) AS hits FROM documents")
def _(spark, d):
    from sedgewren.operators.snippets import highlight_words

    return text_table(spark, d, "documents").select("doc_id", F.size(highlight_words(F.col("text"), WORDS)).cast("long").alias("hits"))


_SNIPPET = f"""WITH ws AS (SELECT doc_id, c, string_split(c, ' ') AS ws FROM (SELECT doc_id, {D.collapsed("coalesce(text, '')")} AS c FROM documents)),
w AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS i FROM ws),
flag AS (SELECT w, CASE WHEN coalesce({D.stem('t')} IN ('thing', 'inoran', 'orantion'), false) THEN 1 ELSE 0 END AS hit FROM (SELECT w, {D.tokens('w')}[1] AS t FROM (SELECT DISTINCT w FROM w))),
s AS (SELECT doc_id, n, i, sum(hit) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 39 FOLLOWING) AS sc FROM w JOIN flag USING (w)),
best AS (SELECT doc_id, max(sc) AS sc, arg_min(i, (-sc, i)) AS i, any_value(n) AS n FROM s WHERE i % 3 = 0 AND i <= greatest(0, n - 40) GROUP BY doc_id),
cut AS (SELECT *, array_to_string(ws[i + 1:i + 40], ' ') AS piece FROM best JOIN ws USING (doc_id))
SELECT doc_id, CASE WHEN sc > 0 THEN regexp_replace(CASE WHEN i > 0 THEN '…' ELSE '' END || {D.truncated('piece', 240)} || CASE WHEN i + 40 < n THEN '…' ELSE '' END, '……', '…', 'g') ELSE {D.truncated('c', 240)} END AS snippet FROM cut"""


@query("snippet", _SNIPPET)
def _(spark, d):
    from sedgewren.operators.snippets import snippets

    return snippets(text_table(spark, d, "documents"), "doc_id", "text", WORDS, 240)


# --- records, parts and entries


_TRIM = "regexp_replace({}, '^[\\s\\x{{0B}}\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+|[\\s\\x{{0B}}\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+$', '', 'g')"


def _posts(spark: SparkSession, d: str) -> DataFrame:
    """Documents as records of a nested export, and each once more, later, in a flat form: pos, record."""
    author = F.struct(F.col("lang").alias("name"), F.concat(F.lit("@"), "source").alias("screen_name"))
    body = F.struct(F.col("text").alias("full_text"), F.lit("Wed Oct 10 20:19:24 +0000 2018").alias("created_at"))
    record = F.to_json(F.struct(F.col("doc_id").alias("rest_id"), author.alias("core"), body.alias("legacy")))
    rows = text_table(spark, d, "documents").select("doc_id", F.try_parse_json(record).alias("record"))
    again = table(spark, d, "documents").select(F.col("doc_id") + (1 << 40), F.try_parse_json(F.to_json(F.struct(F.col("doc_id").alias("id"), F.lit("saved again").alias("text")))))
    return rows.unionAll(again).withColumnRenamed("doc_id", "pos")


@query(
    "normalize_records",
    f"""SELECT CAST(doc_id AS VARCHAR) AS id, coalesce({_TRIM.format('text')}, '') AS text, coalesce(nullif({_TRIM.format('lang')}, ''), '@' || source, 'unknown') AS author_name, coalesce(source, 'unknown') AS author_handle,
'https://x.com/' || coalesce(source, 'unknown') || '/status/' || doc_id AS url, 1539202764 AS created FROM documents""",
)
def _(spark, d):
    from sedgewren.sources.records import normalise

    return normalise(_posts(spark, d), "record", "pos").select("id", "text", "author_name", "author_handle", "url", F.unix_timestamp("created_at").cast("int").alias("created"))


@query("assemble_dedupe", "SELECT doc_id, CAST(doc_id % 5 AS INTEGER) AS part FROM documents QUALIFY coalesce(text, '') = '' OR row_number() OVER (PARTITION BY text ORDER BY doc_id % 5, doc_id) = 1")
def _(spark, d):
    from sedgewren.sources.exports import first_of_each

    rows = text_table(spark, d, "documents").select("doc_id", F.md5("text").alias("hash"), (F.col("doc_id") % 5).cast("int").alias("part"), F.coalesce(F.length("text"), F.lit(0)).alias("n"))
    keyed = rows.withColumn("key", F.when(F.col("n") > 0, F.col("hash")))
    return first_of_each(keyed, "key", ["part", "doc_id"]).select("doc_id", "part")


_FURNITURE = ("script", "style", "nav", "header", "footer", "aside", "form")


def _stripped_sql() -> str:
    found = "html"
    for tag in _FURNITURE:
        found = f"regexp_replace({found}, '(?is)<{tag}\\b.*?</{tag}\\s*>', ' ', 'g')"
    return D.collapsed(f"regexp_replace({found}, '(?s)<[^>]*>', ' ', 'g')")


@query("html_strip", f"SELECT page_id, {_stripped_sql()} AS text FROM pages")
def _(spark, d):
    found = F.col("html")
    for tag in _FURNITURE:
        found = F.regexp_replace(found, rf"(?is)<{tag}\b.*?</{tag}\s*>", " ")
    return table(spark, d, "pages").select("page_id", T.collapse_ws(F.regexp_replace(found, "(?s)<[^>]*>", " ")).alias("text"))


@query("html_meta", f"SELECT page_id, {D.collapsed('regexp_extract(html, ' + chr(39) + '(?is)<title[^>]*>(.*?)</title' + chr(39) + ', 1)')} AS title FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", T.collapse_ws(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title", 1)).alias("title"))


def _articles(spark: SparkSession, d: str) -> DataFrame:
    from sedgewren.operators.html import extract_articles

    return extract_articles(table(spark, d, "pages"), "page_id", "html")


@query("crawl_status")
def _(spark, d):
    from sedgewren.operators.html import content_status

    return _articles(spark, d).select("page_id", content_status(F.col("text"), F.col("description")).alias("status"), "word_count")


@query("library_build")
def _(spark, d):
    from sedgewren.operators.html import content_status

    rows = _articles(spark, d).join(table(spark, d, "pages").select("page_id", U.canonical_url(F.col("url")).alias("url")), "page_id")
    title = F.coalesce(F.nullif("title", F.lit("")), U.title_from_url(F.col("url")))
    status = content_status(F.col("text"), F.col("description"))
    return rows.select("page_id", "url", U.domain(F.col("url")).alias("domain"), title.alias("title"), "description", F.coalesce("site_name", U.domain(F.col("url"))).alias("site_name"), T.truncate(F.col("text"), 2400).alias("excerpt"), F.coalesce("word_count", F.lit(0)).alias("word_count"), status.alias("status"))


# --- choices and labels


@query(
    "status_labels",
    "SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'archived' WHEN 1 THEN 'server refused' WHEN 2 THEN 'not HTML' WHEN 3 THEN 'timed out' ELSE 'odd' END AS label FROM pages",
)
def _(spark, d):
    from sedgewren.operators.choices import status_label

    state = F.element_at(F.array(*map(F.lit, ("ok", "http_error", "unsupported_type", "timeout", "odd"))), (F.col("page_id") % 5 + 1).cast("int"))
    return table(spark, d, "pages").select("page_id", status_label(state).alias("label"))


@query("topic_label", "SELECT doc_id, CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'Deutsch' ELSE lang END AS label FROM documents")
def _(spark, d):
    from sedgewren.operators.topics import topic_label

    return table(spark, d, "documents").select("doc_id", topic_label(F.col("lang"), {"en": "English", "de": "Deutsch"}).alias("label"))


@query("point_lookup", "SELECT doc_id, lang FROM documents WHERE doc_id = 7")
def _(spark, d):
    from sedgewren.operators.search import entry

    return entry(table(spark, d, "documents"), 7).select("doc_id", "lang")


@query("detail_label", "SELECT doc_id, CASE WHEN coalesce(lang, '') <> '' AND lower(lang) <> lower(source) THEN lang || ' · ' || source ELSE source END AS label FROM documents")
def _(spark, d):
    from sedgewren.operators.choices import detail_label

    return text_table(spark, d, "documents").select("doc_id", detail_label(F.col("lang"), F.col("source")).alias("label"))


@query(
    "classifier_arbitration",
    "SELECT doc_id, array_to_string(CASE WHEN lang IN ('en', 'de') THEN CASE WHEN doc_id % 2 = 0 THEN [lang, 'misc'] ELSE [lang] END WHEN doc_id % 2 = 0 THEN ['misc'] ELSE ['picked'] END, ',') AS topics FROM documents",
)
def _(spark, d):
    from sedgewren.operators.choices import arbitrate

    proposed = F.array(F.lit("unknown"), F.col("lang"), F.when(F.col("doc_id") % 2 == 0, "misc").otherwise("odd"))
    topics = arbitrate(proposed, F.array(F.lit("picked")), F.array(*map(F.lit, ("en", "de", "misc"))))
    return text_table(spark, d, "documents").select("doc_id", F.array_join(topics, ",").alias("topics"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
