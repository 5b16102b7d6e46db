"""Repeated byte strings, found by sorting suffixes.

A byte is covered when it lies in a string of ``length`` bytes that also starts at another place of any text. Two
places start such a string exactly when their suffixes, cut to ``length`` bytes, are equal and so adjacent in sorted
order.

* **Sieve.** Sorting every suffix of the corpus would move many times its size, so suffixes that can't have a
  partner are left out first, without loss. Every suffix (cut to ``length`` bytes) has an anchor: the place in it
  whose ``2/5 length`` bytes hash lowest, leftmost among equals. Equal suffixes have equal anchors at equal offsets.
  Consecutive suffixes of one anchor form a stretch. Blocks of texts ask, per distinct anchor string, whether it
  occurs again, and whether all its stretches are the same bytes. Anchor strings of one stretch: no suffix has a
  partner. All stretches alike: every suffix has one. Else their suffixes are sorted.
* **Sort.** A suffix is its leading token, the first 8 bytes, and the fingerprint of the other bytes. Splitters
  sampled from the suffixes cut them into ranges by leading token; a block sends each distinct suffix once to its
  range. Ranges sort by multikey quicksort and compare neighbours. A suffix that the sample holds from two blocks is
  repeated already and is not sent, so no string, however common, crowds a range. Ranges are cut further by
  fingerprint where the corpus needs more buckets than ``RANGES``, so the splitters stay below 64 KB.
* Blocks get answers in their own key order, mark intervals and join them.

Fingerprints have 64 bits, of a polynomial with random coefficients; two different suffixes are taken as equal only
if their first 8 bytes and the fingerprints of the rest agree.

Defined results: null counts as the empty text; texts shorter than ``length`` have nothing removed; repeated rows
cover each other, each row gets its own result; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weatherlake.llm.common import body
from weatherlake.llm.exchange import BLOCK, REQUEST, bucketed, exchange, in_order, requests, text_blocks, text_of
from weatherlake.llm.ngram_lm import deltas, pack, unpack

#: Suffixes worked on at once, text bytes per range of anchor strings, suffixes per bucket, sampled blocks, ranges.
CHUNK, RANGE, BUCKET, SAMPLED, RANGES = 1 << 20, 32 << 20, 1 << 20, 64, 4096
#: Per sampled block.
SAMPLE = 1024
ODD = 0x9E3779B97F4A7C15
U64 = np.uint64


@lru_cache(1)
def coefficients(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random number per byte value, powers of an odd number, and powers of its inverse modulo 2 ** 64."""
    table = np.random.default_rng(20).integers(0, 2**64, 256, U64)
    up, down = np.full(size, ODD, U64), np.full(size, pow(ODD, -1, 2**64), U64)
    up[0] = down[0] = 1
    return table, np.multiply.accumulate(up), np.multiply.accumulate(down)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U64(29))
    x *= U64(0xBF58476D1CE4E5B9)
    return x ^ (x >> U64(32))


class Prints:
    """Fingerprints of all substrings of a piece of text."""

    def __init__(self, piece: np.ndarray, size: int):
        table, up, self.down = coefficients(size)
        self.sums = np.zeros(len(piece) + 1, U64)
        np.cumsum(table[piece] * up[: len(piece)], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mixed((self.sums[stop] - self.sums[start]) * self.down[start])

    def every(self, size: int) -> np.ndarray:
        return mixed((self.sums[size:] - self.sums[:-size]) * self.down[: len(self.sums) - size])


class Stretch:
    """Stretches of a chunk: first and last suffix (places in the block), anchor string, and all bytes."""

    def __init__(self, prints: Prints, base: int, valid: np.ndarray, length: int):
        size = length * 2 // 5 or 1
        width, n = length - size + 1, len(prints.sums) - length
        value = prints.every(size)
        place = np.arange(len(value), dtype=U64)
        ranked = (value & U64(0xFFFFFFFF00000000)) | place
        # the lowest of every ``width`` neighbours: of the end of one span and of the start of the next
        spans = np.full(-(-len(ranked) // width) * width, U64(2**64 - 1))
        spans[: len(ranked)] = ranked
        spans = spans.reshape(-1, width)
        head = np.minimum.accumulate(spans, 1).ravel()
        tail = np.minimum.accumulate(spans[:, ::-1], 1)[:, ::-1].ravel()
        anchor = (np.minimum(tail[:n], head[width - 1 : width - 1 + n]) & U64(0xFFFFFFFF)).astype(np.int64)
        s = np.flatnonzero(valid[:n])
        at = anchor[s]
        new = np.ones(len(s), bool)
        new[1:] = (at[1:] != at[:-1]) | (s[1:] != s[:-1] + 1)
        i = np.flatnonzero(new)
        first, last = s[i], s[np.append(i[1:], len(s)) - 1] if len(s) else s
        self.prints, self.base = prints, base
        self.first, self.last, self.anchor = first + base, last + base, value[at[i]]
        self.whole = prints.of(first, last + length) + (last - first).astype(U64)


class Text:
    """The texts of a block; ``stretches`` walks them in chunks."""

    def __init__(self, sizes: list[int], data: bytes, length: int):
        self.raw, self.length = text_of(data), length
        self.bytes = np.frombuffer(self.raw, np.uint8)
        self.sizes = np.array(sizes, np.int64)
        self.start = np.cumsum(self.sizes + 1) - self.sizes - 1
        # suffixes that are long enough
        self.valid = np.zeros(len(self.bytes) + 1, bool)
        for a, n in zip(self.start.tolist(), sizes):
            if n >= length:
                self.valid[a : a + n - length + 1] = True

    def stretches(self) -> Iterator[Stretch]:
        for base in range(0, len(self.bytes) - self.length + 1, CHUNK):
            piece = self.bytes[base : base + CHUNK + self.length - 1]
            if len(piece) >= self.length:
                yield Stretch(Prints(piece, CHUNK + self.length), base, self.valid[base : base + CHUNK], self.length)

    def lead(self, s: np.ndarray) -> np.ndarray:
        """First 8 bytes (or all, if ``length`` is less) as a number that sorts like them."""
        out = np.zeros(len(s), U64)
        for k in range(min(8, self.length)):
            out = (out << U64(8)) | self.bytes[s + k]
        return out

    def contested(self, states: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
        """(place, lead, rest) of the suffixes that must be sorted, and the intervals of sure repeats."""
        keys, state = states
        places, leads, rests, sure = [np.zeros(0, np.int64)], [np.zeros(0, U64)], [np.zeros(0, U64)], []
        for x in self.stretches():
            if not len(keys):
                continue
            i = np.minimum(np.searchsorted(keys, x.anchor), len(keys) - 1)
            found = np.where(keys[i] == x.anchor, state[i], 0)
            sure.append((x.first[found == 1], x.last[found == 1]))
            first, last = x.first[found == 2], x.last[found == 2]
            n = last - first + 1
            s = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
            at = s - x.base
            places.append(s)
            leads.append(self.lead(s))
            rests.append(x.prints.of(at + min(8, self.length), at + self.length))
        return np.concatenate(places), np.concatenate(leads), np.concatenate(rests), sure


def distinct(lead: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order of the pairs, and the number of each ordered pair among the distinct ones."""
    order = multikey_order([lead, rest])
    a, b = lead[order], rest[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return order, np.cumsum(new) - 1


def multikey_order(tokens: list[np.ndarray], small: int = 4096) -> np.ndarray:
    """Order of strings of tokens by multikey quicksort: split at a pivot's token into less, equal and greater; the
    equal ones go on to their next token. Short pieces are ordered at once."""
    n = len(tokens[0])
    out, todo, done = np.empty(n, np.int64), [(np.arange(n), 0)], 0
    while todo:
        at, depth = todo.pop()
        if depth == len(tokens):
            ordered = at
        elif len(at) <= small:
            ordered = at[np.lexsort([t[at] for t in reversed(tokens[depth:])])]
        else:
            token = tokens[depth][at]
            drawn = np.sort(token[:: max(1, len(token) // 15)])
            pivot = drawn[len(drawn) // 2]
            less, more = token < pivot, token > pivot
            todo += [(at[more], depth), (at[~(less | more)], depth + 1), (at[less], depth)]
            continue
        out[done : done + len(ordered)] = ordered
        done += len(ordered)
    return out


def answer_anchors(bodies: list[bytes]) -> list[bytes]:
    """Per request: anchor strings that occur again, and 1 if all stretches are alike, else 2."""
    got = [unpack(b, U64, np.bool_, U64, U64) for b in bodies]
    each = [np.cumsum(g[0], dtype=U64) for g in got]
    keys, at = np.unique(np.concatenate(each), return_inverse=True)
    times = np.bincount(at, 1 + np.concatenate([g[1] for g in got]), len(keys))
    order = np.argsort(at, kind="stable")
    first = np.searchsorted(at[order], np.arange(len(keys)))
    low = np.concatenate([g[2] for g in got])
    high = low + np.concatenate([g[3] for g in got])
    alike = np.minimum.reduceat(low[order], first) == np.maximum.reduceat(high[order], first)
    state = np.where(times < 2, 0, np.where(alike, 1, 2)).astype(np.uint8)
    cut = np.cumsum([0, *map(len, each)])
    out = []
    for mine, i, j in zip(each, cut, cut[1:]):
        s = state[at[i:j]]
        out.append(pack(deltas(mine[s > 0]), s[s > 0]))
    return out


def read_states(answers: list[dict] | None) -> tuple[np.ndarray, np.ndarray]:
    got = [unpack(b, U64, np.uint8) for b in in_order(answers)]
    keys = [np.cumsum(g[0], dtype=U64) for g in got]
    return np.concatenate([np.zeros(0, U64), *keys]), np.concatenate([np.zeros(0, np.uint8), *(g[1] for g in got)])


def answer_suffixes(bodies: list[bytes]) -> list[bytes]:
    """Per request: which of its suffixes occur again, in this block or another one."""
    got = [unpack(b, U64, U64, np.bool_) for b in bodies]
    order, number = distinct(np.concatenate([np.cumsum(g[0], dtype=U64) for g in got]), np.concatenate([g[1] for g in got]))
    more = np.concatenate([g[2] for g in got])
    times = np.bincount(number, 1 + more[order])
    again = np.empty(len(order), bool)
    again[order] = times[number] > 1
    cut = np.cumsum([0, *(len(g[0]) for g in got)])
    return [np.packbits(again[i:j]).tobytes() + bytes([(j - i) % 8]) for i, j in zip(cut, cut[1:])]


def read_bits(data: bytes) -> np.ndarray:
    n = 8 * (len(data) - 1) - (8 - data[-1]) % 8
    return np.unpackbits(np.frombuffer(data[:-1], np.uint8), count=n).astype(bool)


class Ranges:
    """Buckets of suffixes: ranges between splitters, cut further by fingerprint; and suffixes known to repeat."""

    def __init__(self, samples: list[tuple[np.ndarray, np.ndarray]], total: int):
        buckets = max(1, -(-total // BUCKET))
        n = min(RANGES, buckets)
        self.subs = U64(-(-buckets // n))
        lead, rest = (np.concatenate([np.zeros(0, U64), *(s[i] for s in samples)]) for i in (0, 1))
        order, number = distinct(lead, rest)
        a, b = lead[order], rest[order]
        twice = np.bincount(number) > 1 if len(number) else np.zeros(0, bool)
        one = np.unique(number, return_index=True)[1]
        self.known = {(int(a[i]), int(b[i])) for i in one[twice].tolist()}
        self.hot = np.unique(b[one[twice]])
        once = a[one][~twice]
        self.splitters = once[(np.arange(1, n) * len(once)) // n] if len(once) else once

    def repeats(self, lead: np.ndarray, rest: np.ndarray) -> np.ndarray:
        out = np.zeros(len(lead), bool)
        if len(self.hot):
            i = np.minimum(np.searchsorted(self.hot, rest), len(self.hot) - 1)
            for k in np.flatnonzero(self.hot[i] == rest).tolist():
                out[k] = (int(lead[k]), int(rest[k])) in self.known
        return out

    def parts(self, lead: np.ndarray, rest: np.ndarray) -> np.ndarray:
        low, high = (np.searchsorted(self.splitters, lead, side).astype(U64) for side in ("left", "right"))
        # a leading token that fills several ranges is dealt to them by fingerprint
        spread = (high - low + U64(1)) * self.subs
        return low * self.subs + ((rest >> U64(32)) * spread >> U64(32))


class Sent:
    """The distinct suffixes of a block in the order in which they are asked for."""

    def __init__(self, lead: np.ndarray, rest: np.ndarray, ranges: Ranges):
        order, number = distinct(lead, rest)
        self.number = np.empty(len(order), np.int64)
        self.number[order] = number
        first = np.unique(number, return_index=True)[1]
        self.lead, self.rest = lead[order][first], rest[order][first]
        self.many = np.bincount(number, minlength=len(first)) > 1
        sure = ranges.repeats(self.lead, self.rest)
        self.known = sure | self.many
        parts = ranges.parts(self.lead, self.rest)
        # suffixes that occur twice in this block still go out, as partners for other blocks; known ones don't
        asked = np.flatnonzero(~sure)
        self.asked = asked[np.argsort(parts[asked], kind="stable")]
        self.parts = parts[self.asked]


def find_repeats(docs: DataFrame, length: int = 400, block_bytes: int = BLOCK) -> DataFrame:
    """(doc_id, n_bytes, spans, kept): maximal repeated byte runs of every text and the bytes outside them."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(body()))).first()[0] or 0
    buckets, ranges = max(8, -(-size // (2 * block_bytes))), max(8, -(-size // RANGE))
    blocks = bucketed(text_blocks(docs, block_bytes), buckets, "blocks")

    def ask_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, sizes, data in zip(*(c.to_pylist() for c in b.columns)):
                found = [(x.anchor, x.whole) for x in Text(sizes, data, length).stretches()]
                if not sum(len(k) for k, _ in found):
                    continue
                key, whole = (np.concatenate([f[i] for f in found]) for i in (0, 1))
                order = np.argsort(key, kind="stable")
                keys, first, times = np.unique(key[order], return_index=True, return_counts=True)
                low, high = np.minimum.reduceat(whole[order], first), np.maximum.reduceat(whole[order], first)
                parts = ((keys >> U64(32)) * U64(ranges)) >> U64(32)
                yield requests(block, parts, lambda s: pack(deltas(keys[s]), times[s] > 1, low[s], high[s] - low[s]))

    anchors = exchange(blocks.select("block", "sizes", "data").mapInArrow(ask_anchors, REQUEST), answer_anchors, buckets, "anchors")
    sieved = blocks.join(anchors, "block", "left").select("block", "ids", "sizes", "data", "anchors")

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for sizes, data, states in zip(*(c.to_pylist() for c in b.columns)):
                _, lead, rest, _ = Text(sizes, data, length).contested(read_states(states))
                order, number = distinct(lead, rest)
                first = order[np.unique(number, return_index=True)[1]]
                first = first[:: max(1, -(-len(first) // SAMPLE))]
                values = [pa.array([len(order)]), pa.array([lead[first].tobytes()], pa.binary()), pa.array([rest[first].tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(values, names=["n", "lead", "rest"])

    # at most SAMPLED blocks of SAMPLE suffixes reach the driver, whatever the corpus
    n_blocks = blocks.count()
    few = blocks.select("block").orderBy(F.xxhash64("block"), "block").limit(SAMPLED)
    some = sieved.join(F.broadcast(few), "block", "left_semi").select("sizes", "data", "anchors")
    drawn = some.mapInArrow(sample, "n long, lead binary, rest binary").collect()
    total = math.ceil(sum(r["n"] for r in drawn) / max(len(drawn), 1) * n_blocks)
    cuts = Ranges([(np.frombuffer(r["lead"], U64), np.frombuffer(r["rest"], U64)) for r in drawn], total)
    shared = spark.sparkContext.broadcast(cuts)

    def ask_suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, sizes, data, states in zip(*(c.to_pylist() for c in b.columns)):
                _, lead, rest, _ = Text(sizes, data, length).contested(read_states(states))
                sent = Sent(lead, rest, shared.value)
                a, r, m = sent.lead[sent.asked], sent.rest[sent.asked], sent.many[sent.asked]
                if len(a):
                    yield requests(block, sent.parts, lambda s: pack(deltas(a[s]), r[s], m[s]))

    asked = sieved.select("block", "sizes", "data", "anchors").mapInArrow(ask_suffixes, REQUEST)
    suffixes = exchange(asked, answer_suffixes, buckets, "suffixes")
    everything = sieved.join(suffixes, "block", "left").select("ids", "sizes", "data", "anchors", "suffixes")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, sizes, data, states, bits in zip(*(c.to_pylist() for c in b.columns)):
                text = Text(sizes, data, length)
                place, lead, rest, sure = text.contested(read_states(states))
                sent = Sent(lead, rest, shared.value)
                again = sent.known.copy()
                again[sent.asked] |= np.concatenate([np.zeros(0, bool), *map(read_bits, in_order(bits))])
                hit = place[again[sent.number]]
                first = np.concatenate([hit, *(f for f, _ in sure)])
                stop = np.concatenate([hit, *(s for _, s in sure)]) + length
                yield results(text, ids, *joined_runs(first, stop))

    return everything.mapInArrow(mark, "doc_id long, n_bytes long, spans array<struct<start:long,stop:long>>, kept binary")


def joined_runs(first: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of overlapping or touching intervals."""
    order = np.argsort(first, kind="stable")
    first, stop = first[order], np.maximum.accumulate(stop[order]) if len(stop) else stop
    new = np.ones(len(first), bool)
    new[1:] = first[1:] > stop[:-1]
    i = np.flatnonzero(new)
    return first[i], stop[np.append(i[1:], len(first)) - 1] if len(first) else stop


def results(text: Text, ids: list, first: np.ndarray, stop: np.ndarray) -> pa.RecordBatch:
    cut = np.searchsorted(first, np.append(text.start, len(text.bytes))).tolist()
    first, stop = first.tolist(), stop.tolist()
    spans, kept = [], []
    for a, n, i, j in zip(text.start.tolist(), text.sizes.tolist(), cut, cut[1:]):
        spans.append([{"start": f - a, "stop": s - a} for f, s in zip(first[i:j], stop[i:j])])
        edges = [a, *(x for pair in zip(first[i:j], stop[i:j]) for x in pair), a + n]
        kept.append(b"".join(text.raw[x:y] for x, y in zip(edges[::2], edges[1::2])))
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    values = [pa.array(ids, pa.int64()), pa.array(text.sizes), pa.array(spans, span), pa.array(kept, pa.large_binary())]
    return pa.RecordBatch.from_arrays(values, names=["doc_id", "n_bytes", "spans", "kept"])
