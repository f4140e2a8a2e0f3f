"""Byte-pair encoding as a transducer with bounded lookahead, and an incremental decoder.

Symbols go in one by one. For each place the transducer knows the last token of the encoding of all symbols up to it: of the
tokens that end there, the one that the merges keep apart from the last token before it. A token is stable, and leaves, once
the encodings that can still go on (those that end where a longer token may begin) agree on it. What follows a place can
change the tokens before it only through a chain of merges, each of a later rank than the one that set it off, and the
chain's length in symbols is bounded by the merge list alone. `sufficient_lookahead` computes that bound, so what is held is
bounded too, and a word without end takes constant memory.

The merge list, special tokens and vocabulary come from a tokenizer file, whose path is a parameter. In the list, each token
must be made by one rule, of parts that earlier rules make; other lists are refused.

Defined results: a null text counts as empty; an empty text has no tokens and decodes to the empty text. Lone surrogates
are replaced. Repeated rows are encoded each by itself. Very long texts and words are encoded whole. Ties don't arise: equal
pairs merge from the left. Columns but id and text aren't read; an empty table gives no rows.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import unicodedata
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedgewren.llm.common import map_columns
from sedgewren.session import table

#: Symbols between two looks for stable tokens.
STEP = 8
#: Words in each of the two generations of the memo, and pairs of tokens whose order of merging is remembered.
MEMO, PAIRS = 150_000, 500_000
_SPACE = r"\p{White_Space}"
WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_SPACE}\p{{L}}\p{{N}}]+")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in vocabularies of byte-level tokenizers."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [], 256
    for b in range(256):
        if b in plain:
            out.append(chr(b))
        else:
            out.append(chr(extra))
            extra += 1
    return out


class Merges:
    """A merge list over symbols: bytes within a word, and bytes at its end. As text, a symbol is chr(byte) or, at the end of
    a word where the list tells these apart, chr(256 + byte)."""

    def __init__(self, path: str) -> None:
        spec = json.loads(open(path, encoding="utf-8").read())
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.text: dict[int, str] = {i: t for t, i in vocab.items()} | {a["id"]: a["content"] for a in spec["added_tokens"]}
        self.special: dict[str, int] = {a["content"]: a["id"] for a in spec["added_tokens"]}
        alphabet = byte_alphabet()
        self.ended = 256 if self.suffix else 0
        self.symbols: dict[int, str] = {vocab[c]: chr(b) for b, c in enumerate(alphabet)} | {vocab[c + self.suffix]: chr(self.ended + b) for b, c in enumerate(alphabet)}
        self.pairs: dict[tuple[int, int], int] = {}
        self.rank: dict[int, int] = dict.fromkeys(self.symbols, -1)
        self.parts: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b, made = vocab[left], vocab[right], vocab[left + right]
            if made in self.rank or a not in self.rank or b not in self.rank:
                raise ValueError(f"rule {rank} makes a token again, or of parts that no earlier rule makes: {left!r} {right!r}")
            self.pairs[a, b], self.rank[made], self.parts[made] = rank, rank, (a, b)
            self.symbols[made] = self.symbols[a] + self.symbols[b]
        self.size = {t: len(x) for t, x in self.symbols.items()}
        self.longest = max(self.size.values())
        #: Of each token and each beginning of one: the token (or -1), and whether a longer one begins so.
        self.known: dict[str, tuple[int, bool]] = {}
        for x in self.symbols.values():
            for n in range(1, len(x)):
                self.known[x[:n]] = (-1, True)
        self.asked: dict[tuple[int, int], bool] = {}
        self.sound = {t: True for t in self.symbols if t not in self.parts}  # whether a token's own symbols give it
        for t, (a, b) in self.parts.items():
            self.sound[t] = self.sound[a] and self.sound[b] and self._apart(a, b, self.rank[t])
        for t, x in self.symbols.items():
            self.known[x] = (t if self.sound[t] else -1, x in self.known)

    def edge(self, token: int, right: bool, until: float) -> list[tuple[int, float]]:
        """The symbols and tokens that stand at an end of a token while it is made, with the rank that ends each."""
        out = []
        while True:
            out.append((token, until))
            if token not in self.parts:
                return out[::-1]
            until, token = self.rank[token], self.parts[token][right]

    def apart(self, a: int, b: int) -> bool:
        """Whether the merges of a's and b's symbols in a row leave a and b: no rule joins what stands at the border before
        a rule within a (which lies to the left, so is first among equals) or b takes it away."""
        found = self.asked.get((a, b))
        if found is None:
            if len(self.asked) >= PAIRS:
                self.asked.clear()
            found = self.asked[a, b] = self._apart(a, b, float("inf"))
        return found

    def _apart(self, a: int, b: int, until: float) -> bool:
        """The same for rules below a rank."""
        left, right = self.edge(a, True, until), self.edge(b, False, until)
        i = j = 0
        while i < len(left) and j < len(right):
            (x, x_ends), (y, y_ends) = left[i], right[j]
            rank = self.pairs.get((x, y))
            if rank is not None and rank < x_ends and rank <= y_ends:
                return False
            if x_ends <= y_ends:
                i += 1
            if y_ends <= x_ends:
                j += 1
        return True

    def sufficient_lookahead(self) -> int:
        """Symbols after a place beyond which nothing can change the tokens that end at or before it.

        Where two continuations differ, the difference moves left only by a merge (x, a) that one of them makes and
        the other doesn't, x ending at the difference and a starting there; the next such merge is of a later rank, and
        its right part starts with x. The longest such chain, in symbols of the x, is found rule by rule in rank order."""
        reach: dict[int, int] = {}  # longest chain that ends with a rule whose left part is this symbol
        most = 0
        for (x, a), _ in sorted(self.pairs.items(), key=lambda kv: kv[1]):
            before, c = 0, a
            while True:
                before = max(before, reach.get(c, 0))
                if c not in self.parts:
                    break
                c = self.parts[c][0]
            chain = self.size[x] + before
            reach[x] = max(reach.get(x, 0), chain)
            most = max(most, chain)
        return most

    def spelled(self, raw: bytes) -> str:
        """The symbols of a word's bytes."""
        return raw[:-1].decode("latin-1") + chr(self.ended + raw[-1]) if raw else ""

    def apply(self, symbols: str) -> list[int]:
        """The tokens of a whole word by merging over and over: slow, and what the transducer's results are tested by."""
        base, made = {x: t for t, x in self.symbols.items() if len(x) == 1}, {pair: t for t, pair in self.parts.items()}
        out = [base[c] for c in symbols]
        while found := [(self.pairs[p], i) for i, p in enumerate(zip(out, out[1:])) if p in self.pairs]:
            _, i = min(found)
            out[i : i + 2] = [made[out[i], out[i + 1]]]
        return out



class Transducer:
    """Symbols in, stable tokens out. It holds at most the sufficient lookahead, a longest token and STEP symbols."""

    def __init__(self, merges: Merges, lookahead: int) -> None:
        self.merges, self.most = merges, lookahead + merges.longest + STEP
        self.early = 0  # tokens that left before their word's end
        self.reset()

    def reset(self) -> None:
        self.held = ""
        self.last: list[tuple[int, int]] = []  # of each held symbol: the token that ends with it, and where that begins
        self.open: list[int] = []  # places where a token that is longer than what is held may begin
        self.before = -1  # the token that left last

    def feed(self, symbols: str) -> list[int]:
        """Takes the next symbols of a word; gives the tokens that are stable by now."""
        out: list[int] = []
        for at in range(0, len(symbols), STEP):
            self._take(symbols[at : at + STEP])
            if len(symbols) > at + STEP or len(self.held) >= STEP:
                self._leave(out)
        self.early += len(out)
        return out

    def _take(self, symbols: str) -> None:
        known, asked, apart, last, before = self.merges.known, self.merges.asked, self.merges.apart, self.last, self.before
        begins, held, self.held = self.open, self.held, self.held + symbols
        text = self.held
        for i in range(len(held), len(text)):
            begins.append(i)
            goes_on, made = [], None
            for s in begins:
                hit = known.get(text[s : i + 1])
                if hit is None:
                    continue
                token, more = hit
                if more:
                    goes_on.append(s)
                if made is None and token >= 0:
                    left = last[s - 1][0] if s else before
                    if left < 0 or (asked[left, token] if (left, token) in asked else apart(left, token)):
                        made = (token, s)
            last.append(made)
            begins = goes_on
        self.open = begins

    def _leave(self, out: list[int]) -> None:
        """Moves the tokens that all encodings that can go on have in common to out."""
        ends = {*self.open, len(self.held)}
        while len(ends) > 1:
            end = max(ends)
            ends.remove(end)
            ends.add(self.last[end - 1][1])
        if end := ends.pop():
            self._move(end, out)
            self.held, self.open = self.held[end:], [s - end for s in self.open]
            self.last = [(t, s - end) for t, s in self.last[end:]]
        elif len(self.held) > self.most:
            raise RuntimeError("tokens that must be stable by now are not")

    def _move(self, end: int, out: list[int]) -> None:
        chain = []
        while end:
            token, end = self.last[end - 1]
            chain.append(token)
        out += reversed(chain)
        self.before = out[-1]

    def finish(self) -> list[int]:
        """Ends the word: gives its remaining tokens and is as new."""
        out: list[int] = []
        if self.held:
            self._move(len(self.held), out)
        self.reset()
        return out


class Encoder:
    """Texts to token ids, for byte-level tokenizers that fold case and drop white space."""

    def __init__(self, path: str) -> None:
        self.merges = Merges(path)
        self.lookahead = self.merges.sufficient_lookahead()
        self.transducer = Transducer(self.merges, self.lookahead)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.merges.special, key=len, reverse=True)))) if self.merges.special else None

    def word(self, word: str) -> bytes:
        """The ids of a word, little-endian; words of usual length are remembered for a while."""
        found = self.young.get(word)
        if found is None:
            found = self.old.pop(word, None)
            if found is None:
                ids = self.transducer.feed(self.merges.spelled(word.encode("utf-8", "replace")))
                found = np.array(ids + self.transducer.finish(), "<u4").tobytes()
            if len(word) > 64:
                return found
            if len(self.young) >= MEMO:
                self.old, self.young = self.young, {}
            self.young[word] = found
        return found

    def _plain(self, text: str) -> bytes:
        if not text.isascii() and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        words = WORDS.findall(text.replace("Σ", "σ").lower())
        young = self.young
        try:
            return b"".join([young[w] for w in words])
        except KeyError:
            return b"".join([self.word(w) for w in words])

    def encode(self, text: str | None) -> bytes:
        """The ids of a text, as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.specials is None or "<|" not in text:
            return self._plain(text)
        out, at = [], 0
        for m in self.specials.finditer(text):
            out += [self._plain(text[at : m.start()]), np.array([self.merges.special[m[0]]], "<u4").tobytes()]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])


class Decoder:
    """Ids to text, piece by piece, with the state that has to be kept between pieces.

    Bytes go through a UTF-8 state machine. joined: as the tokenizers library decodes without a decoder, those of the token
    texts with a space between them. Otherwise those that the tokens stand for, and a word's end becomes a space."""

    def __init__(self, merges: Merges, joined: bool = True) -> None:
        self.joined = joined
        size = max(merges.text) + 1
        of_char = {c: bytes([b]) for b, c in enumerate(byte_alphabet())}
        self.pieces: list[bytes] = [b""] * size
        for i, t in merges.text.items():
            if joined or t in merges.special:
                self.pieces[i] = t.encode()
            else:
                ended = bool(merges.suffix) and t.endswith(merges.suffix)
                self.pieces[i] = b"".join(of_char[c] for c in (t[: -len(merges.suffix)] if ended else t)) + b" " * ended
        self.reset()

    def reset(self) -> None:
        self.begun = False
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        """The next stretch of decoded text, without an unfinished character."""
        found = [self.pieces[i] for i in ids]
        if not self.joined:
            return self.machine.decode(b"".join(found))
        if not found:
            return ""
        lead = b" " if self.begun else b""
        self.begun = True
        return self.machine.decode(lead + b" ".join(found))

    def finish(self) -> str:
        out = self.machine.decode(b"", True)
        self.reset()
        return out


#: Ids that are decoded at once.
STRETCH = 1 << 14


def decoded_digest(decoder: Decoder, ids: bytes) -> str:
    """SHA-256 of the decoded text, taken stretch by stretch."""
    digest = hashlib.sha256()
    decoder.reset()
    for at in range(0, len(ids), 4 * STRETCH):
        digest.update(decoder.feed(np.frombuffer(ids[at : at + 4 * STRETCH], "<u4").tolist()).encode("utf-8"))
    digest.update(decoder.finish().encode("utf-8"))
    return digest.hexdigest()


@lru_cache(maxsize=2)
def _tools(path: str) -> tuple[Encoder, Decoder]:
    encoder = Encoder(path)
    return encoder, Decoder(encoder.merges)


def encode_column(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers) of every row, in one pass without a shuffle."""

    def task():
        encoder = _tools(path)[0]
        return lambda rows, texts: (rows, [encoder.encode(t) for t in texts])

    return map_columns(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), task, "doc_id long, ids binary")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, digests of ids and of decoded text; one pass without a shuffle."""

    def task():
        encoder, decoder = _tools(path)

        def step(rows: list, texts: list):
            ids = [encoder.encode(t) for t in texts]
            return rows, [len(x) // 4 for x in ids], [hashlib.sha256(x).hexdigest() for x in ids], [decoded_digest(decoder, x) for x in ids]

        return step

    ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_columns(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), task, ddl)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
