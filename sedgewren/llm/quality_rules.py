"""Line-first quality rules, as DataFrame expressions only.

Every line is judged by itself (navigation, boilerplate, symbol noise, shouting, missing end punctuation); failing lines
go; a document that loses too large a share of its words with them is rejected, as is one that fails the base rules on
length and repetition.

Defined results: a null or blank text has no words, all counts 0, fails the base rules and keeps no line. Repeated rows
are judged each by itself. Columns beside the id and the text are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sedgewren.session import table

#: White space between words, as a character list and as a Java class.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = "[\\x20\\x09-\\x0D]"
SYMBOLS = "#*$%&|<>"
SYMBOL_CLASS = "[#*$%&|<>]"

#: Phrases of page furniture, lower case.
BOILERPLATE = (
    "accept cookies",
    "all rights reserved",
    "back to top",
    "click here to",
    "enable javascript",
    "log in to your account",
    "privacy policy",
    "share on facebook",
    "share this article",
    "sign up for our newsletter",
    "skip to content",
    "terms of service",
    "terms of use",
    "this site uses cookies",
)


@dataclass(frozen=True)
class LineRules:
    """A line fails on any of: more than max_bars vertical bars a word; more than max_symbols symbols a word; no lower
    case but capitals, with min_shout words at least; a boilerplate phrase, in at most max_furniture words; no end punctuation, with min_unfinished
    words at least. A document is rejected if its failing lines hold over max_lost_percent of its words."""

    max_bars: float = 0.25
    max_symbols: float = 0.5
    min_shout: int = 4
    min_unfinished: int = 60
    max_furniture: int = 25
    max_lost_percent: int = 40
    min_words: int = 50
    max_repeat_percent: int = 50
    boilerplate: tuple[str, ...] = field(default=BOILERPLATE)


END_MARK = r"""[.!?;:,)"'\]\x{2026}\x{3002}\x{201d}\x{2019}\x{bb}]$"""


def without(text: Column, chars: str) -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def trimmed_line(line: Column) -> Column:
    return F.struct(line.alias("line"), F.split(line, SPACE_CLASS + "+").alias("words"))


def line_facts(line: Column, words: Column, rules: LineRules) -> Column:
    """Counts of a trimmed line that has a word, given its words, and whether it is to go."""
    size = F.size(words)
    has_symbols = line.rlike(SYMBOL_CLASS)
    symbols = F.when(has_symbols, F.length(line) - F.length(without(line, SYMBOLS))).otherwise(F.lit(0))
    bars = F.length(line) - F.length(without(line, "|"))
    furniture = (size <= rules.max_furniture) & F.lower(line).rlike("|".join(rules.boilerplate))
    noisy = has_symbols & ((bars > F.lit(rules.max_bars) * size) | (symbols > F.lit(rules.max_symbols) * size))
    fails = (
        noisy
        | ((size >= rules.min_shout) & ~line.rlike(r"\p{Ll}") & line.rlike(r"\p{Lu}"))
        | ((size >= rules.min_unfinished) & ~line.rlike(END_MARK))
        | furniture
    )
    return F.struct(
        size.cast("long").alias("words"), F.length(F.array_join(words, "")).cast("long").alias("chars"), symbols.cast("long").alias("symbols"), fails.alias("fails")
    )


def _sum(rows: Column, name: str, only: str | None = None) -> Column:
    add = (lambda a, r: a + r[name]) if only is None else (lambda a, r: a + F.when(r[only], r[name]).otherwise(F.lit(0).cast("long")))
    return F.aggregate(rows, F.lit(0).cast("long"), add)


def apply_rules(docs: DataFrame, rules: LineRules = LineRules(), id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row a row of docs: the id, the base counts, both verdicts, lines and words lost, and the cleaned text.

    A chain of projections over the scan: no shuffle, no Python. Repetition is found within the row, by sorting hashed
    windows beside their places, so that a text of n words costs n log n."""
    none = F.array().cast("array<long>")
    at = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), *[F.col(c) for c in keep])
    at = at.withColumn("_raw", F.filter(F.split("_text", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != ""))
    at = at.withColumn("_lines", F.transform("_raw", lambda x: trimmed_line(F.btrim(x, F.lit(SPACES)))))
    at = at.withColumn("_facts", F.transform("_lines", lambda x: line_facts(x["line"], x["words"], rules)))
    at = at.withColumn("_words", F.flatten(F.transform("_lines", lambda x: x["words"])))
    at = at.withColumn("n_words", F.size("_words").cast("long"))
    at = at.withColumn(
        "_windows",
        F.when(
            F.col("n_words") >= 3,
            F.transform(F.sequence(F.lit(0), F.size("_words") - 3), lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2))),
        ).otherwise(none),
    )
    at = at.withColumn(
        "_sorted",
        F.when(
            F.size(F.array_distinct("_windows")) < F.size("_windows"),
            F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.cast("long").alias("p")))),
        ).otherwise(F.array().cast("array<struct<h:bigint,p:bigint>>")),
    )
    twice = lambda r, i: F.get("_sorted", i - 1)["h"].eqNullSafe(r["h"]) | F.get("_sorted", i + 1)["h"].eqNullSafe(r["h"])
    at = at.withColumn("_places", F.sort_array(F.filter(F.transform("_sorted", lambda r, i: F.when(twice(r, i), r["p"])), lambda p: p.isNotNull())))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    covered = F.aggregate("_places", zero, lambda a, p: F.struct((a["n"] + p + 3 - F.greatest(p, a["end"])).alias("n"), (p + 3).alias("end")), lambda a: a["n"])
    at = at.select(
        "doc_id",
        "n_words",
        _sum(F.col("_facts"), "chars").alias("word_chars"),
        _sum(F.col("_facts"), "symbols").alias("n_symbols"),
        (F.size("_raw") - F.size(F.array_distinct("_raw"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        F.size(F.filter("_facts", lambda r: r["fails"])).cast("long").alias("n_lines_lost"),
        _sum(F.col("_facts"), "words", "fails").alias("n_words_lost"),
        F.when(
            F.exists("_facts", lambda r: r["fails"]),
            F.array_join(F.filter("_raw", lambda x, i: ~F.get("_facts", i)["fails"]), "\n"),
        ).otherwise(F.col("_text")).alias("clean_text"),
        *keep,
    )
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    at = at.withColumn("base_failed", failed)
    return at.withColumn("kept", ~F.col("base_failed") & (100 * F.col("n_words_lost") <= rules.max_lost_percent * F.col("n_words")))


def keep_clean(docs: DataFrame, rules: LineRules = LineRules(), keep: tuple[str, ...] = ()) -> DataFrame:
    """The rows of apply_rules that are kept.

    The verdict must be a finished column before it is filtered by: pushed below the projections, its expressions would
    be evaluated anew for every element. A row number, which isn't deterministic, holds the filter above them."""
    judged = apply_rules(docs, rules, keep=keep).withColumn("_row", F.monotonically_increasing_id())
    return judged.where((F.col("_row") >= 0) & F.col("kept")).drop("_row")


COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_words_lost")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(table(spark, sf_dir, "documents")).select(*COLUMNS)


def op10_oracle(rules: LineRules = LineRules()) -> str:
    """DuckDB SQL for the query: lines and windows are unnested and grouped."""
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
raw AS (SELECT doc_id, unnest(string_split(x, chr(10))) AS l FROM d),
lines AS (
  SELECT doc_id, l, trim(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM raw
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
facts AS (
  SELECT doc_id, l, t, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS w,
    length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS chars,
    len(regexp_extract_all(t, '[#*$%&|<>]')) AS symbols, len(regexp_extract_all(t, '[|]')) AS bars FROM lines),
judged AS (
  SELECT *, bars > {rules.max_bars} * w OR symbols > {rules.max_symbols} * w
    OR (w >= {rules.min_shout} AND NOT regexp_matches(t, '\\p{{Ll}}') AND regexp_matches(t, '\\p{{Lu}}'))
    OR (w >= {rules.min_unfinished} AND NOT regexp_matches(t, '{END_MARK.replace("'", "''")}'))
    OR (w <= {rules.max_furniture} AND regexp_matches(lower(t), '{"|".join(rules.boilerplate)}')) AS fails FROM facts),
by_line AS (
  SELECT doc_id, CAST(sum(w) AS BIGINT) AS n_words, CAST(sum(chars) AS BIGINT) AS word_chars, CAST(sum(symbols) AS BIGINT) AS n_symbols,
    CAST(count(*) - count(DISTINCT l) AS BIGINT) AS n_dup_lines, CAST(sum(CASE WHEN fails THEN w ELSE 0 END) AS BIGINT) AS n_words_lost
  FROM judged GROUP BY doc_id),
ws AS (SELECT doc_id, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS w FROM d),
win AS (
  SELECT doc_id, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS p FROM ws)),
twice AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
rep AS (
  SELECT doc_id, CAST(count(DISTINCT q) AS BIGINT) AS n
  FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM twice) GROUP BY doc_id),
base AS (
  SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, coalesce(n_symbols, 0) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(n_words_lost, 0) AS n_words_lost
  FROM d LEFT JOIN by_line USING (doc_id) LEFT JOIN rep USING (doc_id)),
verdict AS (SELECT *, n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_percent} * n_words AS base_failed FROM base)
SELECT *, NOT base_failed AND 100 * n_words_lost <= {rules.max_lost_percent} * n_words AS kept FROM verdict"""
