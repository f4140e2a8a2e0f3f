"""DuckDB SQL fragments for the oracles, written apart from the Spark expressions they check."""

from sedgewren.functions.text import STOP_WORDS
from sedgewren.functions.urls import ORIGIN_HOSTS, SHORTENERS

STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)


def tokens(x: str) -> str:
    raw = (
        f"list_filter(list_transform(string_split_regex(regexp_replace(regexp_replace(lower({x}), 'https?://\\S+', ' ', 'g'), '[^a-z0-9+#.\\-\\s]', ' ', 'g'), '\\s+'), "
        "lambda t: regexp_replace(t, '^[.\\-]+|[.\\-]+$', '', 'g')), lambda t: length(t) > 1 AND length(t) < 32)"
    )
    return (
        f"flatten(list_transform({raw}, lambda t: list_concat(CASE WHEN t IN ({STOPS}) THEN []::VARCHAR[] ELSE [t] END, "
        f"CASE WHEN contains(t, '-') THEN list_filter(string_split(t, '-'), lambda p: length(p) > 1 AND p NOT IN ({STOPS})) ELSE []::VARCHAR[] END)))"
    )


def stem(w: str) -> str:
    one = (
        f"(CASE WHEN length({w}) <= 4 THEN {w} WHEN {w} LIKE '%ies' AND length({w}) > 5 THEN left({w}, length({w}) - 3) || 'y' WHEN {w} LIKE '%sses' THEN left({w}, length({w}) - 2) "
        f"WHEN {w} LIKE '%es' AND length({w}) > 5 THEN left({w}, length({w}) - 2) WHEN {w} LIKE '%s' AND {w} NOT LIKE '%ss' THEN left({w}, length({w}) - 1) ELSE {w} END)"
    )
    return (
        f"(list_transform([{one}], lambda z: CASE WHEN length(z) <= 5 THEN z WHEN z LIKE '%ingly' AND length(z) >= 9 THEN left(z, length(z) - 5) WHEN z LIKE '%edly' AND length(z) >= 8 "
        "THEN left(z, length(z) - 4) WHEN z LIKE '%ing' AND length(z) >= 7 THEN left(z, length(z) - 3) WHEN z LIKE '%ed' AND length(z) >= 6 THEN left(z, length(z) - 2) ELSE z END))[1]"
    )


def terms(x: str) -> str:
    return f"list_transform({tokens(x)}, lambda q: {stem('q')})"


def collapsed(x: str) -> str:
    return f"trim(regexp_replace({x}, '[\\s\\x{{0B}}\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}\\x{{FEFF}}]+', ' ', 'g'))"


def truncated(x: str, n: int) -> str:
    clean = collapsed(x)
    return (
        f"(list_transform([{clean}], lambda c: CASE WHEN length(c) <= {n} THEN c ELSE (list_transform([left(c, {n})], lambda u: rtrim(CASE WHEN contains(u, ' ') AND "
        f"length(u) - strpos(reverse(u), ' ') > {n} * 0.6 THEN left(u, length(u) - strpos(reverse(u), ' ')) ELSE u END)))[1] || '…' END))[1]"
    )


def host(u: str) -> str:
    return f"regexp_replace(lower(regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.\\-]*:/+([^/?#:]+)', 1)), '^www\\.', '')"


def canonical(u: str) -> str:
    """For addresses with a scheme and without port or user."""
    path = f"(list_transform([regexp_replace(regexp_extract({u}, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/+$', '')], lambda p: CASE WHEN p = '' THEN '/' ELSE p END))[1]"
    query = (
        f"array_to_string(list_filter(string_split(regexp_extract({u}, '^[^?#]*\\?([^#]*)', 1), '&'), "
        "lambda k: k <> '' AND NOT regexp_matches(lower(string_split(k, '=')[1]), '^(utm_|ref_)|^(ref|fbclid|gclid|mc_cid|mc_eid|igshid|si)$')), '&')"
    )
    return f"lower(regexp_extract({u}, '^([a-zA-Z]+)://', 1)) || '://' || {host(u)} || {path} || CASE WHEN {query} = '' THEN '' ELSE '?' || {query} END"


def hosts(values: tuple) -> str:
    return ", ".join(f"'{h}'" for h in values)


SHORT, ORIGIN = hosts(SHORTENERS), hosts(ORIGIN_HOSTS)


def fnv(x: str) -> str:
    return f"list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split({x}, ''), lambda ch: ascii(ch)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295)"


def rounded(x: str, digits: int) -> str:
    return f"floor(({x}) * 1e{digits} + 0.5) / 1e{digits}"
