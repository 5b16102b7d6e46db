"""Byte-level BPE with a contiguous rank array per short word.

A word's parts and the merge ranks of neighbouring parts are held in two short arrays. The minimum rank is found
by scanning, the boundary behind it is deleted, and the ranks beside it are refreshed, until no rank is left.
Words beyond ``SHORT`` bytes use a heap over linked parts, with the same result in n log n.

Texts are cut at single spaces first: a unit (space plus the characters to the next space) whose second character
is no white space is a token boundary on both sides whatever stands around it, so units are cached. Texts with
other spacing go through the split pattern as a whole. Added tokens of the file are cut out before anything else.

Defined results: null is the empty text and encodes to no ids; ids are little-endian unsigned 32-bit integers in
a binary column; invalid bytes decode to U+FFFD as the tokenizers library does; the appended column takes the
place of one with the same name; other columns pass through.
"""

from __future__ import annotations

import heapq
import json
import re
from array import array
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

#: Fixed value: the split pattern of this family of vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SHORT = 200
CACHE = 500_000
NONE = 1 << 40


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteBPE:
    """Encoder and decoder for one vocabulary file (its JSON text)."""

    def __init__(self, source: str):
        spec = json.loads(source)
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.single = [0] * 256
        for letter, byte in letters.items():
            self.single[byte] = vocab[letter]
        self.ranks: dict[int, int] = {}
        self.made: list[int] = []
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.ranks.setdefault(vocab[left] << 20 | vocab[right], rank)
            self.made.append(vocab[left + right])
        self.pieces: dict[int, bytes] = {i: bytes(letters[c] for c in t) for t, i in vocab.items()}
        self.pieces |= {i: t.encode() for t, i in self.added.items()}
        self.split = regex.compile(PATTERN)
        self.cut = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.words: dict[str, bytes] = {}
        self.units: dict[str, bytes] = {}

    def merge_short(self, ids: list[int]) -> list[int]:
        get, made = self.ranks.get, self.made
        ranks = [get(a << 20 | b, NONE) for a, b in zip(ids, ids[1:])]
        while ranks:
            rank = min(ranks)
            if rank == NONE:
                break
            i = ranks.index(rank)
            ids[i] = made[rank]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] << 20 | ids[i], NONE)
            if i < len(ranks):
                ranks[i] = get(ids[i] << 20 | ids[i + 1], NONE)
        return ids

    def merge_long(self, ids: list[int]) -> list[int]:
        n, get = len(ids), self.ranks.get
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get(ids[i] << 20 | ids[i + 1], NONE)) < NONE]
        heapq.heapify(heap)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i]
            if j >= n or ids[i] != left or ids[j] != right:
                continue
            ids[i], ids[j] = self.made[rank], -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (r := get(ids[a] << 20 | ids[b], NONE)) < NONE:
                    heapq.heappush(heap, (r, a, ids[a], ids[b]))
        return [x for x in ids if x >= 0]

    def word(self, w: str) -> bytes:
        out = self.words.get(w)
        if out is None:
            ids = [self.single[b] for b in w.encode()]
            out = array("I", self.merge_short(ids) if len(ids) <= SHORT else self.merge_long(ids)).tobytes()
            if len(w) <= SHORT:
                if len(self.words) >= CACHE:
                    self.words.clear()
                self.words[w] = out
        return out

    def spelled(self, text: str) -> bytes:
        return b"".join(map(self.word, self.split.findall(text)))

    def encode(self, text: str) -> bytes:
        if self.cut is not None and any(t in text for t in self.added):
            parts = self.cut.split(text)
            return b"".join(array("I", [self.added[p]]).tobytes() if i % 2 else self.plain(p) for i, p in enumerate(parts))
        return self.plain(text)

    def plain(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        found = list(map(self.units.get, rest))
        if None in found:
            for i, x in enumerate(found):
                if x is None:
                    unit = rest[i]
                    if not unit or unit[0].isspace():
                        return self.spelled(text)
                    found[i] = self.spelled(" " + unit)
                    if len(unit) <= SHORT:
                        if len(self.units) >= CACHE:
                            self.units.clear()
                        self.units[unit] = found[i]
        return self.spelled(first) + b"".join(found)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.pieces.__getitem__, array("I", ids))).decode("utf-8", "replace")


_LOADED: dict[int, object] = {}


def loaded(kind: Callable[[str], object], source: str) -> object:
    """One encoder per worker process and file."""
    key = hash((kind.__name__, source))
    if key not in _LOADED:
        _LOADED[key] = kind(source)
    return _LOADED[key]


def add_column(df: DataFrame, name: str, kind, of: str, make: Callable[[], Callable]) -> DataFrame:
    """Append column ``name`` = f(column ``of``), computed in Arrow batches; ``make`` runs once per task."""
    rest = [c for c in df.columns if c != name] if name != of else df.columns
    if name == of:
        raise ValueError("the new column must not replace its input")
    src = df.select(*[df[f"`{c}`"] for c in rest])
    schema = StructType([*src.schema.fields, StructField(name, kind)])
    at = rest.index(of)
    arrow = pa.large_binary() if isinstance(kind, BinaryType) else pa.large_string()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in batches:
            for s in range(0, b.num_rows, 2000):
                p = b.slice(s, 2000)
                new = pa.array([f(x) for x in p.column(at).to_pylist()], arrow)
                yield pa.RecordBatch.from_arrays([*p.columns, new], names=[*rest, name])

    return src.mapInArrow(run, schema)


def read_file(path: str) -> str:
    """The vocabulary file, read where the query is written; a few MB, so it is broadcast to the tasks."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(df: DataFrame, path: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    source = df.sparkSession.sparkContext.broadcast(read_file(path))

    def make():
        bpe = loaded(ByteBPE, source.value)
        return lambda x: bpe.encode(x or "")

    return add_column(df, out_col, BinaryType(), text_col, make)


def decode(df: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    source = df.sparkSession.sparkContext.broadcast(read_file(path))

    def make():
        bpe = loaded(ByteBPE, source.value)
        return lambda x: bpe.decode(bytes(x or b""))

    return add_column(df, out_col, StringType(), ids_col, make)
