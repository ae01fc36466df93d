"""Exact byte-pair encoding by backtracking over longest token matches, and decoding by an offset table.

A sequence of tokens is what the merges give if and only if each pair of neighbours is: no merge of higher priority can
bridge the boundary of the two. So an Aho-Corasick automaton finds all tokens in a word in one pass, the encoder takes the
longest match that is compatible with the token before it, and steps back where no match is left. Each position of a word
is given up at most once, so the time is linear in the word's length.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import unicodedata
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, normalizers, pre_tokenizers

from quillon.runtime import ship_package

WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Stands for the end-of-word suffix, as one character that no byte maps to.
END = "\ue000"
#: Encoded words kept in a worker; a full cache starts anew. Longer words are not kept.
CACHE_WORDS, CACHE_CHARS = 300_000, 48
PAIRS = 500_000


def byte_chars() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, spare = [], 256
    for b in range(256):
        out.append(chr(b if b in plain else spare))
        spare += b not in plain
    return out


@functools.cache
def newer_chars() -> frozenset[str]:
    """Characters that ``regex`` knows and Python's own Unicode tables do not."""
    unknown = "".join(chr(c) for c in range(0x110000) if unicodedata.category(chr(c)) == "Cn")
    return frozenset(regex.findall(r"\P{Cn}", unknown))


@functools.cache
def first_newer() -> re.Pattern:
    """Finds characters from the least of :func:`newer_chars` on: most texts have none."""
    return re.compile(f"[{min(newer_chars())}-\U0010ffff]")


@functools.cache
def careful(pattern: str) -> regex.Pattern:
    """A pattern in which letters and numbers are those of the tokenizers library, also among :func:`newer_chars`."""
    new = "".join(sorted(newer_chars()))
    for kind in (r"\p{L}", r"\p{N}"):
        found = pre_tokenizers.Split(Regex(f"[^{kind}]+"), "removed").pre_tokenize_str(new)
        theirs = {c for part, _ in found for c in part}
        less = "".join(regex.escape(c) for c in regex.findall(kind, new) if c not in theirs)
        if less:
            pattern = pattern.replace(f"[{kind}]", kind).replace(kind, f"[{kind}--[{less}]]")
    return regex.compile(pattern, regex.V1)


class Backtracker:
    """The encoder of one vocabulary: ``encode(word)`` gives the ids of a word of byte characters."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str):
        self.suffix = suffix
        inner = {(t[: -len(suffix)] + END if suffix and t.endswith(suffix) else t): i for t, i in vocab.items()}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in merges]
        if suffix:
            pairs = [tuple(t[: -len(suffix)] + END if t.endswith(suffix) else t for t in p) for p in pairs]
        # ranks: basic tokens first, then one for each merge in order of priority
        rank, self.left, self.right, self.joined = {}, [], [], {}
        made = {a + b for a, b in pairs}
        for t in inner:
            if t not in made:
                rank[t] = len(rank)
        self.left, self.right = list(range(len(rank))), list(range(len(rank)))
        for a, b in pairs:
            if a in rank and b in rank and a + b in inner and a + b not in rank:
                r = rank[a + b] = len(rank)
                self.left.append(rank[a])
                self.right.append(rank[b])
                self.joined[rank[a], rank[b]] = r
        self.ids = [0] * len(rank)
        self.size = [0] * len(rank)
        self.automaton = ahocorasick.Automaton()
        for t, r in rank.items():
            self.ids[r] = inner[t]
            self.size[r] = len(t)
            self.automaton.add_word(t, r)
        self.automaton.make_automaton()
        self.known: dict[tuple[int, int], bool] = {}

    def compatible(self, x: int, y: int) -> bool:
        """Whether the merges leave a boundary between tokens ``x`` and ``y``: undo their merges, latest first."""
        seen = self.known.get((x, y))
        if seen is not None:
            return seen
        a, b, bar, ok = x, y, len(self.ids), True
        left, right, joined = self.left, self.right, self.joined
        while True:
            if joined.get((a, b), bar) < bar:
                ok = False
                break
            # the side made last is taken apart; merges across the boundary then had to come before it
            whole_a, whole_b = right[a] == a, left[b] == b
            if whole_a and whole_b:
                break
            if not whole_a and (a > b or whole_b):
                bar, a = a, right[a]
            elif not whole_b and (b >= a or whole_a):
                bar, b = b + 1, left[b]
        if len(self.known) >= PAIRS:
            self.known.clear()
        self.known[x, y] = ok
        return ok

    def encode(self, word: str) -> list[int]:
        """Ids of a word of byte characters (``END`` last if the vocabulary has a suffix)."""
        n = len(word)
        starting: list[list[int]] = [[] for _ in range(n)]
        size = self.size
        for end, r in self.automaton.iter(word):
            starting[end + 1 - size[r]].append(r)  # ends grow, so the longest comes last
        chosen: list[int] = []
        at = 0
        while at < n:
            here = starting[at]
            while here:
                r = here.pop()
                if (at + size[r] == n or starting[at + size[r]]) and (not chosen or self.compatible(chosen[-1], r)):
                    chosen.append(r)
                    at += size[r]
                    break
            else:
                if not chosen:
                    raise ValueError("the vocabulary cannot spell this word")
                at -= size[chosen.pop()]
        return [self.ids[r] for r in chosen]


#: The library's own normalizers: their tables and Python's are of different ages.
_COMPOSE, _LOWER = normalizers.NFC(), normalizers.Lowercase()


class Codec:
    """Text to ids and back for a vocabulary file of the tokenizers library (byte-level BPE, with or without word ends)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.words = bool(model["end_of_word_suffix"])
        self.suffix = model["end_of_word_suffix"] or ""
        self.bpe = Backtracker(model["vocab"], model["merges"], self.suffix)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.pattern = WORD_PATTERN if self.words else BYTE_PATTERN
        self.split = regex.compile(self.pattern)
        self.to_chars = {b: c for b, c in enumerate(byte_chars())}
        tokens = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        spelled = [tokens.get(i, "").encode("utf-8") for i in range(max(tokens) + 1)]
        # the offset table: token i is blob[start[i]:start[i + 1]], a space before each
        self.blob = np.frombuffer(b"".join(b" " + t for t in spelled), np.uint8)
        self.start = np.concatenate(([0], np.cumsum([len(t) + 1 for t in spelled])))

    def ids_of(self, word: str) -> list[int]:
        chars = word.encode("utf-8").decode("latin-1").translate(self.to_chars)
        return self.bpe.encode(chars + END if self.suffix else chars)

    def parts(self, text: str) -> Iterator[tuple[str | None, list[str]]]:
        """The text's pieces: a special token, or the words of what stands between."""
        new = not text.isascii() and bool(first_newer().search(text)) and not newer_chars().isdisjoint(text)
        split = careful(self.pattern) if new else self.split
        at = 0
        for m in self.cut.finditer(text) if self.cut else ():
            yield None, split.findall(self.normal(text[at : m.start()], new))
            yield m[0], []
            at = m.end()
        yield None, split.findall(self.normal(text[at:], new))

    def normal(self, text: str, new: bool = False) -> str:
        """The text composed and in lower case if the vocabulary has word ends; ``new`` tells of characters newer than Python's tables."""
        if not self.words:
            return text
        if new:
            return _LOWER.normalize_str(_COMPOSE.normalize_str(text))
        if not unicodedata.is_normalized("NFC", text):
            text = _COMPOSE.normalize_str(text)
        # each character is lowered for itself, so a final sigma is a sigma like any other
        return (text.replace("Σ", "σ") if "Σ" in text else text).lower()

    def decode_each(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The decoded bytes of several id sequences laid end to end: tokens joined by a space."""
        begin = self.start[ids]
        size = self.start[ids + 1] - begin
        ends = np.cumsum(size)
        take = np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - size), size)
        raw = self.blob[take].tobytes()
        out, at, tokens = [], 0, np.cumsum(counts)
        for k in range(len(counts)):
            end = int(ends[tokens[k] - 1]) if tokens[k] else 0
            out.append(raw[at + 1 : end])
            at = end
        return out


class Memo(dict):
    """Values of a function of short strings, at most ``bound`` of them beside the ``fixed`` ones, which are never dropped."""

    def __init__(self, fn: Callable, bound: int, fixed: dict | None = None):
        super().__init__(fixed or {})
        self.fn, self.fixed, self.bound = fn, fixed or {}, bound + len(fixed or {})

    def __missing__(self, key: str):
        value = self.fn(key)
        if len(key) <= CACHE_CHARS:
            if len(self) >= self.bound:
                self.clear()
                self.update(self.fixed)
            self[key] = value
        return value


_CODECS: dict[str, Codec] = {}
_WORDS: dict[str, Memo] = {}


def codec(path: str) -> Codec:
    """The worker's codec for a vocabulary file."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def _packed(path: str) -> Memo:
    if path not in _WORDS:
        c = codec(path)
        _WORDS[path] = Memo(lambda w: np.array(c.ids_of(w), "<u4").tobytes(), CACHE_WORDS)
    return _WORDS[path]


def encode_bytes(path: str, text: str | None) -> bytes:
    """Ids of a whole text as little-endian unsigned 32-bit integers; null and empty texts have none."""
    if not text:
        return b""
    c, get = codec(path), _packed(path).__getitem__
    out = []
    for special, words in c.parts(text):
        out.append(c.special[special].to_bytes(4, "little") if special else b"".join(map(get, words)))
    return b"".join(out)


#: Ids that are decoded in one go.
DECODE_IDS = 200_000


def _digests(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            coded = [encode_bytes(path, t) for t in batch.column("text").to_pylist()]
            counts = np.array([len(x) // 4 for x in coded], np.int64)
            decoded: list[str] = []
            at = 0
            while at < len(coded):
                end, size = at, 0
                while end < len(coded) and (end == at or size + counts[end] <= DECODE_IDS):
                    size += counts[end]
                    end += 1
                if end == at + 1 and size > DECODE_IDS:  # one long text: decoded in parts
                    h, ids = hashlib.sha256(), np.frombuffer(coded[at], "<u4")
                    for k in range(0, len(ids), DECODE_IDS):
                        part = ids[k : k + DECODE_IDS]
                        h.update((b" " if k else b"") + c.decode_each(part, np.array([len(part)]))[0])
                    decoded.append(h.hexdigest())
                else:
                    ids = np.frombuffer(b"".join(coded[at:end]), "<u4")
                    decoded += [hashlib.sha256(t).hexdigest() for t in c.decode_each(ids, counts[at:end])]
                at = end
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(counts), pa.array([hashlib.sha256(x).hexdigest() for x in coded], pa.string()), pa.array(decoded, pa.string())],
                [*batch.schema.names[:-1], "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return run


def _lists(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            ids = [np.frombuffer(encode_bytes(path, t), "<u4").astype(np.int32) for t in batch.column("text").to_pylist()]
            text = [c.decode_each(x, np.array([len(x)]))[0].decode("utf-8") for x in ids]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(ids, pa.list_(pa.int32())), pa.array(text, pa.string())], [*batch.schema.names[:-1], "ids", "decoded"])

    return run


def word_vocabulary() -> str:
    """The default vocabulary's file."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode_decode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text: ``doc_id``, ``ids`` (array<int>) and ``decoded`` (the text that the ids decode to).

    Null and empty texts give no ids and an empty text. Special strings in a text become their special ids, as the
    tokenizers library does by default. Rows are independent, so repeated rows repeat; other columns are ignored.
    """
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_lists(path or word_vocabulary()), "doc_id long, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As :func:`encode_decode`, with counts and digests in place of ids and texts: ``doc_id``, ``n_tokens``,
    ``ids_sha256`` (of the ids as little-endian unsigned 32-bit integers) and ``decoded_sha256`` (of UTF-8)."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_digests(path or word_vocabulary()), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8_bpe_encode_decode(spark, sf_dir: str) -> DataFrame:
    """Token counts and digests of every text of ``documents``."""
    return encode_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
