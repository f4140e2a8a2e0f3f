"""Text analysis as Column expressions: tokens, stems, terms, truncation, dates and counts for display."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that are not indexed.
STOP_WORDS = (
    "a about after all also am an and any are as at be because been but by can come could did do does for from get got "
    "had has have he her here him his how i if in into is it its just like make me more most my no not now of on one "
    "only or other our out over own she should so some such than that the their them then there these they this those "
    "to too up us very via was we were what when which while who why will with would you your"
).split()

#: White space as browsers see it, beyond what Java's \s covers. Java is slow at classes within classes and at negated ones.
WIDE_SPACE = "[\\x09-\\x0D\\x20\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]"


def _not_stop(t: Column) -> Column:
    return ~t.isin(STOP_WORDS)


def tokenize(text: Column) -> Column:
    """Lower-case tokens of 2 to 31 characters without stop words; a hyphenated token is followed by its parts."""
    clean = F.regexp_replace(F.regexp_replace(F.lower(text), r"https?://\S+", " "), r"[^a-z0-9+#.\-\s]", " ")
    raw = F.transform(F.split(clean, r"\s+"), lambda t: F.regexp_replace(t, r"^[.\-]+|[.\-]+$", ""))
    raw = F.filter(raw, lambda t: (F.length(t) > 1) & (F.length(t) < 32))
    none = F.array().cast("array<string>")

    def spread(t: Column) -> Column:
        whole = F.when(_not_stop(t), F.array(t)).otherwise(none)
        parts = F.filter(F.split(t, "-"), lambda p: (F.length(p) > 1) & _not_stop(p))
        return F.when(F.contains(t, F.lit("-")), F.concat(whole, parts)).otherwise(whole)

    return F.flatten(F.transform(raw, spread))


def _cut(w: Column, n: int) -> Column:
    return F.substring(w, F.lit(1), F.length(w) - n)


def singular(w: Column) -> Column:
    n = F.length(w)
    return (
        F.when(n <= 4, w)
        .when(w.endswith("ies") & (n > 5), F.concat(_cut(w, 3), F.lit("y")))
        .when(w.endswith("sses"), _cut(w, 2))
        .when(w.endswith("es") & (n > 5), _cut(w, 2))
        .when(w.endswith("s") & ~w.endswith("ss"), _cut(w, 1))
        .otherwise(w)
    )


def unverbed(w: Column) -> Column:
    n = F.length(w)
    return (
        F.when(n <= 5, w)
        .when(w.endswith("ingly") & (n >= 9), _cut(w, 5))
        .when(w.endswith("edly") & (n >= 8), _cut(w, 4))
        .when(w.endswith("ing") & (n >= 7), _cut(w, 3))
        .when(w.endswith("ed") & (n >= 6), _cut(w, 2))
        .otherwise(w)
    )


def stem(w: Column) -> Column:
    """Plurals first, then verb endings that leave four characters."""
    return unverbed(singular(w))


def terms(text: Column) -> Column:
    """The stems of a text's tokens, in two steps, as an expression that repeats the first one would be evaluated anew for
    each of the second's conditions."""
    return F.transform(F.transform(tokenize(text), singular), unverbed)


def prefix_key(term: Column) -> Column:
    """~ and six characters for terms longer than six, else null."""
    return F.when(F.length(term) > 6, F.concat(F.lit("~"), F.substring(term, 1, 6)))


def collapse_ws(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, WIDE_SPACE + "+", " "))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), the value evaluated once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def truncate(text: Column, most: int) -> Column:
    """Collapsed text; if longer than `most`, cut at the last space beyond 60 % of it, with an ellipsis.

    A beginning that is longer than `most` when collapsed gives the same as the whole text, which is then left alone."""

    def kept(cut: Column) -> Column:
        space = F.when(F.instr(cut, " ") == 0, F.lit(-1)).otherwise(F.length(cut) - F.instr(F.reverse(cut), " "))  # 0-based place of the last space
        return F.concat(F.rtrim(F.when(space > most * 0.6, F.substring(cut, F.lit(1), space)).otherwise(cut)), F.lit("…"))

    def shortened(clean: Column) -> Column:
        return F.when(F.length(clean) <= most, clean).otherwise(_let(F.substring(clean, 1, most), kept))

    whole = lambda head: F.when((F.length(head) > most) | (F.length(text) <= 2 * most), head).otherwise(collapse_ws(text))
    return _let(_let(collapse_ws(F.substring(text, 1, 2 * most)), whole), shortened)


def format_date(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "MMM d, yyyy"), F.lit(""))


def relative_date(ts: Column, now: Column) -> Column:
    """today, yesterday, Nd, Nmo or Ny ago; empty for nulls."""
    days = F.floor((F.unix_micros(now) - F.unix_micros(ts)) / F.lit(86_400_000_000)).cast("long")
    return (
        F.when(ts.isNull(), F.lit(""))
        .when(days < 1, F.lit("today"))
        .when(days < 2, F.lit("yesterday"))
        .when(days < 30, F.concat(days.cast("string"), F.lit("d ago")))
        .when(days < 365, F.concat(F.floor(days / 30).cast("string"), F.lit("mo ago")))
        .otherwise(F.concat(F.floor(days / 365).cast("string"), F.lit("y ago")))
    )


def pluralize(n: Column, one: str, many: str) -> Column:
    return F.concat(F.format_number(n, 0), F.lit(" "), F.when(n == 1, F.lit(one)).otherwise(F.lit(many)))


def page_text(parts: list[Column], body: Column, limit: int) -> Column:
    """Non-empty parts and the body's beginning, a line each."""
    full = lambda c: F.when(F.length(c) > 0, c)
    return F.concat_ws("\n", *[full(p) for p in parts], full(F.substring(body, 1, limit)))


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over characters, as a long."""
    codes = F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.ascii(F.substring(text, i, F.lit(1))).cast("long"))
    codes = F.when(F.length(text) > 0, codes).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(codes, F.lit(2166136261).cast("long"), lambda h, c: ((h.bitwiseXOR(c)) * F.lit(16777619)).bitwiseAND(F.lit(4294967295)))
