"""Personal data by a semi-Markov conditional random field, beside exact base patterns.

Text near digits and at-signs is cut into zones, zones into tokens. Every run of tokens, up to LONGEST characters, that
could be an e-mail address, network address, payment card or telephone number is a candidate segment, scored as a whole by a
linear model of its kind. A dynamic program over token ends, with segments of bounded length, jointly chooses boundaries
and kinds (Viterbi); the same recurrences in log space train the model on segmentations that the base patterns give for
a bounded sample of zones, and on written-out and reformatted variants of such data.

Base spans always stay; spans of the model are added where they overlap no base span.

Defined results: null and empty texts have no spans. Kinds may overlap each other among base spans (they are found kind
by kind), added spans overlap nothing; of segmentations that score alike, the one that Viterbi meets first stays. Repeated
rows are judged each by itself. Very long texts are taken whole, in time and memory that grow with their length. Columns but
id and text aren't read (`masked` hands the others on); an empty table gives no rows. Offsets are code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from bisect import bisect_right
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedgewren.llm.common import map_columns, spread
from sedgewren.session import table

KINDS = ("email", "ip", "card", "phone")
#: Characters of a segment, at most: the longest e-mail address there is.
LONGEST = 254
#: Characters around a trigger that belong to its zone, at most: no segment is longer.
REACH = LONGEST
#: Zones that the model is fitted on, at most; of a document, and their length.
FIT_ZONES, FIT_ZONES_DOCUMENT, FIT_LENGTH = 1500, 8, 384
#: Share of the documents, by a hash of the id, that these zones are picked from.
FIT_SHARE = 0.125

_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def octets(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in s.split("."))


def emails(text: str) -> list[Span]:
    """Leftmost non-overlapping addresses, found from their at-signs: one pass, whatever lies between."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> list[Span]:
    """Spans of the base patterns, by kind as listed, then start."""
    out = emails(text) if "@" in text else []
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if octets(m[0])] if "." in text else []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(digits_of(m[0])) <= 15]
    return out


# --- zones and candidate segments


_TRIGGER = re.compile(r"[0-9@]+|[\[({] ?at ?[\])}]| dot ", re.IGNORECASE)
_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|\s|.", re.DOTALL)


def zones(text: str, digits_only: re.Pattern = re.compile(r"[0-9@]+")) -> list[tuple[int, int]]:
    """Stretches of text that can hold a segment: around triggers, up to white space or REACH characters."""
    lower = text.lower()
    written = any(x in lower for x in ("at]", "at)", "at}", "at ]", "at )", "at }", " dot "))
    out: list[tuple[int, int]] = []
    for m in (_TRIGGER if written else digits_only).finditer(text):
        a, b = m.start(), m.end()
        if out and a - out[-1][1] <= 0:
            start = out[-1][0]
        else:
            start = a
            while start > 0 and a - start < REACH and not text[start - 1].isspace():
                start -= 1
            while start > 0 and a - start < REACH and text[start - 1] in "+( ":
                start -= 1
        end = b
        while end < len(text) and end - b < REACH and not text[end].isspace():
            end += 1
        while end < len(text) and end - b < REACH and text[end] in " \t":
            end += 1
        if m[0][0] not in "0123456789@":  # written out: a few words on both sides
            start, end = max(0, a - REACH), min(len(text), b + REACH)
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


_AT = re.compile(r"\s?(?:[\[({]\s?at\s?[\])}]|@| at )\s?", re.IGNORECASE)
_DOT = re.compile(r"\s?(?:[\[({]\s?dot\s?[\])}]| dot |\.)\s?", re.IGNORECASE)
_NUMBER = re.compile(r"[0-9 .()+-]+")
_V6 = re.compile(r"(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}")
_V4 = re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}")
#: As far as segments can go: at most 19 digits, 8 groups of hexadecimal digits, names joined by dots.
_NUMBER_RUN = re.compile(r"(?:[ .()+-]*+[0-9]){1,19}")
_V6_RUN = re.compile(r"[0-9A-Fa-f:]{1,39}")
_LOCAL_RUN = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN_RUN = re.compile(rf"(?:[^\W_]|-)+(?:{_DOT.pattern}(?:[^\W_]|-)+)*", re.IGNORECASE)
_DOT_MORE = re.compile(r"\s?(?:[\[({]\s?dot\s?[\])}]| dot )\s?[^\W_]", re.IGNORECASE)
_NAMES = {name: i for i, name in enumerate(
    "bias valid edges_clean left_digit right_digit one_separator spaces_inside plus paren luhn groups_even groups_many long_group digits_few digits_phone digits_card digits_over "
    "plain_at written_at tld_alpha local_short dotted v6 v6_whole leading_zero repeated date_like cue decimal".split())}  # fmt: skip
WIDTH = len(_NAMES)
_CUES = {"email": ("mail", "contact", "write"), "ip": ("ip", "host", "address", "server"), "card": ("card", "visa", "credit"), "phone": ("phone", "tel", "call", "fax", "mobile")}


def kinds_of(s: str) -> list[str]:
    """Kinds that a segment could be of at all."""
    if s[0].isspace() or s[-1].isspace():
        return []
    if s[0] in "0123456789+(" and s[-1] in "0123456789" and _NUMBER.fullmatch(s):
        n = len(digits_of(s))
        out = ["ip"] if _V4.fullmatch(s) else []
        if 13 <= n <= 19 and "(" not in s and "+" not in s:
            out.append("card")
        if 7 <= n <= 15 and s.count("+") <= 1 and s.rfind("+") <= 0:
            out.append("phone")
        return out
    if len(s) >= 6 and s[-1].isalnum():
        if _V6.fullmatch(s):
            return ["ip"]
        parts = _AT.split(s)
        if len(parts) == 2 and parts[0] and all(c in _LOCAL_CHARS for c in parts[0]) and all(p and all(c.isalnum() or c == "-" for c in p) for p in _DOT.split(parts[1])) and _DOT.search(parts[1]):
            return ["email"]
    return []


def span_features(kind: str, zone: str, a: int, b: int) -> list[int]:
    """Features of a whole segment that hold, as indices of the kind's block."""
    s = zone[a:b]
    left, right = zone[a - 1 : a], zone[b : b + 1]
    on = ["bias"]
    if (not left or left.isspace() or left in "\"'([<:,;") and (not right or right.isspace() or right in "\"')]>:,;.!?"):
        on.append("edges_clean")
    if left.isalnum() or left and left in "@._%+-":
        on.append("left_digit")
    if right.isalnum() or right and right in "@_%" or right in ".-" and zone[b + 1 : b + 2].isalnum() or kind == "email" and _DOT_MORE.match(zone, b):
        on.append("right_digit")
    before = zone[max(0, a - 24) : a].lower()
    if any(c in before for c in _CUES[kind]):
        on.append("cue")
    if kind == "email":
        parts = _AT.split(s)
        labels = _DOT.split(parts[1])
        plain = "@" in s and not any(c.isspace() for c in s)
        on.append("plain_at" if plain else "written_at")
        if labels[-1].isalpha() and 2 <= len(labels[-1]) <= 12:
            on.append("tld_alpha")
        if len(parts[0]) < 2:
            on.append("local_short")
        if plain and _DOMAIN.fullmatch(parts[1]):
            on.append("valid")
    else:
        d = digits_of(s)
        groups = [g for g in re.split(r"[^0-9]+", s) if g]
        marks = {c for c in s if not c.isalnum()}
        n = len(d)
        if len(marks - {"+", "(", ")"}) <= 1:
            on.append("one_separator")
        if " " in s:
            on.append("spaces_inside")
        if "+" in s:
            on.append("plus")
        if "(" in s and ")" in s:
            on.append("paren")
        if n >= 13 and luhn(d):
            on.append("luhn")
        if len(groups) > 1 and len({len(g) for g in groups[:-1]}) == 1:
            on.append("groups_even")
        if len(groups) > 6:
            on.append("groups_many")
        if max(map(len, groups), default=0) > 5:
            on.append("long_group")
        on.append("digits_few" if n < 8 else "digits_phone" if n <= 12 else "digits_card" if n in (15, 16) else "digits_over")
        if "." in marks:
            on.append("dotted")
            if len(groups) == 2:
                on.append("decimal")
        if ":" in s:
            on.append("v6")
            if s.count(":") == 7:
                on.append("v6_whole")
        if d[:1] == "0":
            on.append("leading_zero")
        if len(set(d)) <= 2:
            on.append("repeated")
        if re.fullmatch(r"(?:19|20)[0-9]{2}[-. ][0-9]{1,2}[-. ][0-9]{1,2}|[0-9]{1,2}[-. ][0-9]{1,2}[-. ](?:19|20)[0-9]{2}|(?:19|20)[0-9]{2} ?- ?(?:19|20)[0-9]{2}", s):
            on.append("date_like")
        if (kind == "ip" and (":" in s or octets(s))) or (kind == "card" and 16 <= n <= 19 and luhn(d) and "." not in s) or (kind == "phone" and s[0] == "+" and 8 <= n <= 15):
            on.append("valid")
    at = KINDS.index(kind) * WIDTH
    return [at + _NAMES[x] for x in on]


def furthest(zone: str, a: int) -> int:
    """The last place where a segment that begins at a can end."""
    stop = a + LONGEST
    far = max((m.end() for run in (_NUMBER_RUN, _V6_RUN) if (m := run.match(zone, a, stop))), default=a)
    if (m := _LOCAL_RUN.match(zone, a, stop)) and (m := _AT.match(zone, m.end(), stop)) and (m := _DOMAIN_RUN.match(zone, m.end(), stop)):
        far = max(far, m.end())
    return far


def lattice(zone: str) -> tuple[list[int], dict[int, list[tuple[int, str, list[int]]]]]:
    """Token ends of a zone; for each end the segments that finish there: first token, kind, features."""
    ends, starts = [], []
    for m in _TOKEN.finditer(zone):
        starts.append(m.start())
        ends.append(m.end())
    segments: dict[int, list[tuple[int, str, list[int]]]] = {}
    for i, a in enumerate(starts):
        c = zone[a]
        if c.isspace() or not (c.isalnum() or c in "+(._%-"):
            continue
        far = furthest(zone, a)
        for j in range(i, len(ends)):
            if ends[j] > far:
                break
            if ends[j] - a < 6 or not zone[ends[j] - 1].isalnum():
                continue
            for kind in kinds_of(zone[a : ends[j]]):
                segments.setdefault(j, []).append((i, kind, span_features(kind, zone, a, ends[j])))
    return ends, segments


@dataclass
class Crf:
    weights: np.ndarray = field(default_factory=lambda: np.zeros(len(KINDS) * WIDTH))

    def decode(self, zone: str) -> list[Span]:
        """The best segmentation: for each token end, the best of leaving the token outside and closing a segment."""
        ends, segments = lattice(zone)
        if not segments:
            return []
        best, back = [0.0] * (len(ends) + 1), [None] * (len(ends) + 1)
        for j in range(len(ends)):
            best[j + 1] = best[j]
            for i, kind, on in segments.get(j, ()):
                s = best[i] + float(self.weights[on].sum())
                if s > best[j + 1]:
                    best[j + 1], back[j + 1] = s, (i, kind)
        out, j = [], len(ends)
        while j:
            if back[j]:
                i, kind = back[j]
                out.append((kind, ends[i - 1] if i else 0, ends[j - 1]))
                j = i
            else:
                j -= 1
        return out[::-1]


def fit(examples: list[tuple[str, list[Span]]], epochs: int = 8, rate: float = 0.5, ridge: float = 1e-4, seed: int = 3) -> Crf:
    """Maximises the likelihood of the given segmentations: gold less expected features, from forward and backward sums."""
    model = Crf()
    data = []
    for zone, gold in examples:
        ends, segments = lattice(zone)
        if segments:
            want = set(gold)
            data.append((len(ends), [(i, j, on, (kind, ends[i - 1] if i else 0, ends[j]) in want) for j, found in segments.items() for i, kind, on in found]))
    order, grads = random.Random(seed), np.full(len(model.weights), 1e-8)
    for _ in range(epochs):
        order.shuffle(data)
        for n, segs in data:
            scores = [float(model.weights[on].sum()) for _, _, on, _ in segs]
            at_end: dict[int, list[int]] = {}
            at_start: dict[int, list[int]] = {}
            for k, (i, j, _, _) in enumerate(segs):
                at_end.setdefault(j + 1, []).append(k)
                at_start.setdefault(i, []).append(k)
            f, b = [0.0] * (n + 1), [0.0] * (n + 1)
            for j in range(1, n + 1):
                f[j] = _log_sum([f[j - 1], *(f[segs[k][0]] + scores[k] for k in at_end.get(j, ()))])
            for i in range(n - 1, -1, -1):
                b[i] = _log_sum([b[i + 1], *(b[segs[k][1] + 1] + scores[k] for k in at_start.get(i, ()))])
            g = -ridge * model.weights
            for k, (i, j, on, is_gold) in enumerate(segs):
                g[on] += is_gold - math.exp(min(0.0, f[i] + scores[k] + b[j + 1] - f[n]))
            grads += g * g
            model.weights += rate * g / np.sqrt(grads)
    return model


def _log_sum(xs: list[float]) -> float:
    top = max(xs)
    return top + math.log(sum(math.exp(x - top) for x in xs))


def variants(seed: int = 11, n: int = 60) -> list[tuple[str, list[Span]]]:
    """Written-out and reformatted personal data with its spans, and look-alikes without."""
    r = random.Random(seed)
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("abcdefghiklmnoprstuvw") for _ in range(r.randint(3, 8)))
    out = []

    def add(kind: str | None, s: str) -> None:
        before, after = word() + r.choice([" ", ": ", ", "]), r.choice([" ", ". ", ", "]) + word()
        out.append((before + s + after, [(kind, len(before), len(before) + len(s))] if kind else []))

    def card() -> str:
        d = "4" + digits(14)
        return next(d + c for c in "0123456789" if luhn(d + c))

    for _ in range(n):
        at, dot = r.choice([("[at]", "[dot]"), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" (at) ", " dot "), (" @ ", ".")])
        add("email", f"{word()}.{word()}{at}{word()}{dot}{r.choice(['com', 'org', 'net', 'de', 'example'])}")
        add("email", f"{word()}{digits(2)}@{word()}.{r.choice(['com', 'example.com', 'org'])}")
        add("phone", f"({digits(3)}) {digits(3)}-{digits(4)}")
        add("phone", f"{r.choice('23456789')}{digits(2)}{(s := r.choice('-. '))}{r.choice('23456789')}{digits(2)}{s}{digits(4)}")
        add("phone", f"+{r.randint(1, 99)} ({digits(3)}) {digits(3)}-{digits(4)}")
        add("phone", f"+{r.randint(1, 99)}{digits(9)}")
        c = card()
        add("card", r.choice([" ", "-", ".", ""]).join(c[i : i + 4] for i in range(0, 16, 4)))
        add("ip", f"{r.randint(1, 255)}.{r.randint(0, 255)}.{r.randint(0, 255)}.{r.randint(0, 255)}")
        add("ip", ":".join(f"{r.randrange(65536):x}" for _ in range(8)))
        add(None, f"{r.randint(256, 999)}.{r.randint(256, 999)}.{digits(2)}.{digits(3)}")
        d = "4" + digits(14)
        add(None, d + next(c for c in "0123456789" if not luhn(d + c)))
        add(None, f"{r.randint(1900, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}")
        add(None, digits(r.randint(7, 12)))
        add(None, f"{digits(r.randint(4, 7))}.{digits(r.randint(4, 8))}")
        add(None, " ".join(digits(r.randint(1, 3)) for _ in range(r.randint(4, 7))))
        add(None, f"{r.randint(1900, 2030)} - {r.randint(1900, 2030)}")
    return out


def judged_zones(text: str | None) -> list[tuple[str, list[Span]]]:
    """Zones of a text with the base spans that lie within."""
    text = text or ""
    spans = base_spans(text)
    return [(text[a:b], [(k, s - a, e - a) for k, s, e in spans if a <= s and e <= b]) for a, b in zones(text)]


def learn(docs: DataFrame, most: int = FIT_ZONES) -> Crf:
    """Fits the model on at most `most` zones, picked by a hash of their document's id, and on the variants."""

    def task():
        def step(ids: list, texts: list):
            rows = []
            for i, t in zip(ids, texts, strict=True):
                found = [(zlib.crc32(z.encode("utf-8", "replace")), k, z, g) for k, (z, g) in enumerate(judged_zones(t)) if len(z) <= FIT_LENGTH]
                rows += [(i, k, z, ",".join(f"{a}:{b}:{c}" for a, b, c in g)) for _, k, z, g in sorted(found)[:FIT_ZONES_DOCUMENT]]
            return tuple([r[c] for r in rows] for c in range(4))

        return step

    rows = docs.where(F.col("text").rlike("[0-9@]") & (spread(F.col("doc_id"), 2) < F.lit(FIT_SHARE))).select("doc_id", "text")
    found = map_columns(rows, task, "doc_id long, place int, zone string, gold string")
    sample = found.orderBy(F.xxhash64("doc_id", "place"), "zone").limit(most).collect()
    gold = [(r["zone"], [(a, int(b), int(c)) for a, b, c in (x.split(":") for x in r["gold"].split(",") if x)]) for r in sample]
    return fit(variants() + gold)


def find(text: str | None, model: Crf) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans: both by kind as listed, then start."""
    text = text or ""
    base = base_spans(text)
    starts, ends = [], []  # the stretches that base spans cover, in order
    for _, x, y in sorted(base, key=lambda x: x[1:]):
        if ends and x <= ends[-1]:
            ends[-1] = max(ends[-1], y)
        else:
            starts.append(x)
            ends.append(y)
    added = []
    for a, b in zones(text):
        k = bisect_right(ends, a)
        if k < len(ends) and starts[k] <= a and b <= ends[k]:
            continue
        for kind, s, e in model.decode(text[a:b]):
            k = bisect_right(ends, a + s)  # the first stretch that ends after the span's start
            if k == len(ends) or starts[k] >= a + e:
                added.append((kind, a + s, a + e))
    return base, sorted(base + added, key=lambda x: (KINDS.index(x[0]), x[1], x[2]))


def render(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def mask(text: str, spans: list[Span]) -> str:
    """The text with each stretch covered by spans replaced by the kind of the first span there."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda x: (x[1], -x[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def detect(docs: DataFrame, model: Crf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a row of docs: base counts, base digest, all spans; one pass without a shuffle."""

    def task():
        def step(ids: list, texts: list):
            found = [find(t, model) for t in texts]
            counts = [[sum(s[0] == kind for s in base) for base, _ in found] for kind in KINDS]
            return ids, *counts, [hashlib.sha256(render(b).encode()).hexdigest() for b, _ in found], [render(s) for _, s in found], [len(s) - len(b) for b, s in found]

        return step

    ddl = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return map_columns(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), task, ddl)


def masked(docs: DataFrame, model: Crf) -> DataFrame:
    """The documents with personal data masked and n_chars brought up to date; null texts stay null."""

    def task():
        def step(ids: list, texts: list, langs: list, sources: list, sizes: list):
            out = [None if t is None else mask(t, find(t, model)[1]) for t in texts]
            return ids, out, langs, sources, [n if t is None else len(t) for t, n in zip(out, sizes, strict=True)]

        return step

    return map_columns(docs.select("doc_id", "text", "lang", "source", "n_chars"), task, "doc_id long, text string, lang string, source string, n_chars long")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return detect(docs, learn(docs))
