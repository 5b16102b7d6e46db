"""Language-model scores by deleted interpolation of word n-grams of orders 0 to 3.

A token is a word (A-Z folded) or the end of a text. Its probability given the two tokens before it is a mixture
of maximum-likelihood estimates: trigram, bigram and unigram ratios of counts, and 1 / (V + 1). The weights
depend on the frequency bucket of the context (the two-token context if it was seen, else the one-token context)
and are learned by expectation-maximisation on held-out counts: a tenth of the training texts is left out of the
counts that the estimates are made of, and its tokens are counted by (bucket, estimates in logarithmic steps).
The final estimates use all training texts.

All counts are exact and distributed; no n-gram table is collected or broadcast. Documents are cut into blocks of
about ``BLOCK`` bytes as they are read. A block asks for each of its distinct n-grams once: sorted hashes, cut by
hash range, with the block's own training counts. A range adds the blocks' counts up and answers every block with
the totals. Trigrams are sent only where both of their bigrams occur in another block too (in any text) and in some
training text, since otherwise the block's own count is the total and no other block needs it. An n-gram with a third of all tokens is one entry per block. Blocks and answers
are stored in tables bucketed by block, so joining them moves nothing.

Hashes of words keep 24 bits more than the logarithm of the corpus size, those of longer n-grams 20, so the
expected share of n-grams that collide is about 1 in 10 million at any size.

Defined results: null text is empty and has the one token "end"; a null id hashes as the empty text; repeated
rows count as often as they occur; without training texts every estimate is the one of order 0; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weatherlake.llm.common import LOWER, UPPER, body, id_hash
from weatherlake.session import scratch_path

BLOCK, RANGE = 4 << 20, 16 << 20
BUCKETS = 24  # of each kind of context
STEPS = 44  # log2 half-steps of an estimate, 0 for an estimate of zero
FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: No word contains a space, so these two can't clash with one. They are words 0 and 1 of every block.
START, END = b"\x20s", b"\x20e"
HELD, COUNTED, ASIDE = 0, 1, 2
ANSWER = "array<struct<part:int,body:binary>>"


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split()


def word_hash(words: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of the pair of hashes."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def squeeze(x: np.ndarray) -> bytes:
    """Bytes of equal significance together, then compressed; counts and differences of sorted keys get small."""
    return zstandard.ZstdCompressor(level=3).compress(x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes())


def expand(data: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(kind).ravel()


def pack(*columns: np.ndarray) -> bytes:
    """Several arrays in one value: lengths first."""
    parts = [squeeze(c) if len(c) else b"" for c in columns]
    return b"".join([np.array([len(p) for p in parts], np.uint32).tobytes(), *parts])


def unpack(data: bytes, *kinds: type) -> list[np.ndarray]:
    sizes, at, out = np.frombuffer(data[: 4 * len(kinds)], np.uint32), 4 * len(kinds), []
    for size, kind in zip(sizes.tolist(), kinds):
        out.append(expand(data[at : at + size], kind) if size else np.zeros(0, kind))
        at += size
    return out


def deltas(keys: np.ndarray) -> np.ndarray:
    return np.diff(keys, prepend=np.zeros(1, np.uint64))


def parts(docs: DataFrame) -> DataFrame:
    """(doc_id, text, use): HELD texts are not learned from, ASIDE ones only tune the weights."""
    text_id = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    aside = F.crc32(F.concat(F.lit("aside-"), text_id).cast("binary")) % 10 == 0
    use = F.when(id_hash() % 5 == 1, HELD).when(aside, ASIDE).otherwise(COUNTED)
    return docs.select(F.col("doc_id").cast("long"), body().alias("text"), use.alias("use"), F.spark_partition_id().alias("part"))


def make_blocks(rows: DataFrame, block_bytes: int) -> DataFrame:
    """One row per block: ids, use and token numbers of its texts, and the hashes of its distinct words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict[bytes, int] = {START: 0, END: 1}
        ids: list = []
        use: list[int] = []
        tokens: list[np.ndarray] = []
        size = made = 0

        def out(part: int) -> pa.RecordBatch:
            lengths = np.array([len(t) for t in tokens], np.uint32)
            data = pack(np.array(use, np.uint8), lengths, np.concatenate(tokens), word_hash(list(number)))
            values = [pa.array([part << 32 | made], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([data], pa.binary())]
            return pa.RecordBatch.from_arrays(values, names=["block", "ids", "data"])

        part = 0
        for b in batches:
            for doc_id, text, u, part in zip(*(c.to_pylist() for c in b.columns)):
                ids.append(doc_id)
                use.append(u)
                tokens.append(np.array([number.setdefault(w, len(number)) for w in words_of(text)] + [1], np.uint32))
                size += len(text) + 16
                if size >= block_bytes:
                    yield out(part)
                    number, ids, use, tokens, size, made = {START: 0, END: 1}, [], [], [], 0, made + 1
        if ids:
            yield out(part)

    return rows.mapInArrow(run, "block long, ids array<long>, data binary")


class Block:
    """The n-grams of a block: per order sorted keys, their own training counts, and each token's key number."""

    def __init__(self, data: bytes, bits: int):
        self.use, lengths, tokens, hashes = unpack(data, np.uint8, np.uint32, np.uint32, np.uint64)
        self.lengths = lengths.astype(np.int64)
        self.ends = np.cumsum(self.lengths)
        n, self.bits = len(tokens), [bits, bits - 4, bits - 4]
        first = np.zeros(n, bool)
        first[self.ends - self.lengths] = True
        before = np.concatenate([[0], tokens[:-1]])
        before[first] = 0
        second = np.concatenate([[0], before[:-1]])
        second[first] = 0
        self.first = first
        self.of = np.repeat(self.use, self.lengths)
        pair = joined(hashes[before], hashes[tokens])
        keys = [hashes[tokens], pair, joined(joined(hashes[second], hashes[before]), hashes[tokens])]
        self.keys: list[np.ndarray] = []
        self.at: list[np.ndarray] = []
        self.own: list[tuple[np.ndarray, np.ndarray]] = []
        for k, kept in zip(keys, self.bits):
            unique, at = np.unique(k >> np.uint64(64 - kept), return_inverse=True)
            self.keys.append(unique)
            self.at.append(at)
            self.own.append(tuple(np.bincount(at[self.of == u], minlength=len(unique)).astype(np.uint32) for u in (COUNTED, ASIDE)))
        # number of the one-token and of the two-token context among the keys; texts begin after START
        self.context = np.concatenate([[0], self.at[0][:-1]])
        self.pair_before = np.concatenate([[0], self.at[1][:-1]])

    def asked(self, order: int, chosen: np.ndarray | None, ranges: int) -> Iterator[tuple[int, bytes]]:
        """(range, request) for the chosen keys of an order."""
        keys, (counted, aside) = self.keys[order], self.own[order]
        if chosen is not None:
            keys, counted, aside = keys[chosen], counted[chosen], aside[chosen]
        home = ((keys >> np.uint64(self.bits[order] - 32)) * np.uint64(ranges)) >> np.uint64(32)
        cut = np.searchsorted(home, np.arange(ranges + 1, dtype=np.uint64))
        for r in range(ranges):
            i, j = int(cut[r]), int(cut[r + 1])
            if j > i:
                yield r, pack(deltas(keys[i:j]), counted[i:j], aside[i:j])


def read_answers(rows: list[dict]) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """Totals (counted, aside) in key order, and whether another block has the key."""
    got = [unpack(r["body"], np.uint32, np.uint32, np.bool_) for r in sorted(rows, key=lambda r: r["part"])]
    counted, aside, shared = (np.concatenate([np.zeros(0, k), *(g[i] for g in got)]) for i, k in enumerate((np.int64, np.int64, np.bool_)))
    return (counted, aside), shared


def answer(table: pa.Table) -> pa.Table:
    """Totals of one order and hash range for every block that asked; block -1 gets distinct keys and sums."""
    blocks, order, part = (table.column(c).to_pylist() for c in ("block", "order", "part"))
    got = [unpack(x, np.uint64, np.uint32, np.uint32) for x in table.column("body").to_pylist()]
    keys, at = np.unique(np.concatenate([np.cumsum(g[0], dtype=np.uint64) for g in got]), return_inverse=True)
    counted, aside = (np.bincount(at, np.concatenate([g[i] for g in got]), len(keys)).astype(np.uint32) for i in (1, 2))
    ends = np.cumsum([0, *(len(g[0]) for g in got)])
    shared = np.bincount(at, minlength=len(keys)) > 1
    bodies = [pack(counted[at[i:j]], aside[at[i:j]], shared[at[i:j]]) for i, j in zip(ends, ends[1:])]
    both = counted.astype(np.int64) + aside
    bodies.append(np.array([int((both > 0).sum()), int(both.sum()), int(counted.sum())], np.int64).tobytes())
    kinds = {"block": pa.int64(), "order": pa.int32(), "part": pa.int32(), "body": pa.binary()}
    columns = [[*blocks, -1], [*order, order[0]], [*part, part[0]], bodies]
    return pa.table({n: pa.array(c, k) for (n, k), c in zip(kinds.items(), columns)})


class Estimates:
    """Estimates of all tokens of a block from its answers."""

    def __init__(self, data: bytes, answers: list[list[dict]], bits: int):
        self.block = b = Block(data, bits)
        self.totals = [read_answers(answers[0])[0]]
        pairs, self.shared = read_answers(answers[1])
        self.totals.append(pairs)
        if len(answers) > 2:
            tri = [own.astype(np.int64) for own in b.own[2]]
            chosen = self.open_trigrams()
            for mine, all_of_it in zip(tri, read_answers(answers[2])[0]):
                mine[chosen] = all_of_it
            self.totals.append(tuple(tri))

    def open_trigrams(self) -> np.ndarray:
        """Trigrams whose bigrams both occur in another block and in training texts."""
        b = self.block
        common = self.shared & (sum(self.totals[1]) > 0)
        at = common[b.at[1]] & common[b.pair_before] & ~b.first
        return np.flatnonzero(np.bincount(b.at[2][at], minlength=len(b.keys[2])) > 0)

    def ratios(self, take, starts: int, total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Context bucket and the trigram, bigram and unigram ratio of every token. ``take`` picks the counts;
        ``starts`` texts and ``total`` tokens were counted."""
        b = self.block
        one, two, three = (take(t) for t in self.totals)
        c1, c2 = one[b.at[0]], two[b.at[1]]
        context = np.where(b.first, starts, one[b.context])
        # the first token has no second context; its trigram is its bigram
        wide = np.where(b.first, starts, two[b.pair_before])
        c3 = np.where(b.first, c2, three[b.at[2]])
        bucket = lambda c: np.minimum(np.log2(np.maximum(c, 1)).astype(np.int64), BUCKETS - 1)
        kind = np.where(wide > 0, bucket(wide), np.where(context > 0, BUCKETS + bucket(context), 2 * BUCKETS))
        return kind, c3 / np.maximum(wide, 1), c2 / np.maximum(context, 1), c1 / max(total, 1)


def learn(cells: list[tuple[int, int]], v: int, steps: int = 40) -> np.ndarray:
    """Mixture weights (bucket, order 3 to 0) by expectation-maximisation on the held-out cells."""
    start = np.array([0.4, 0.2, 0.35, 0.05])
    weights = np.tile(start, (2 * BUCKETS + 1, 1))
    if cells:
        code, n = np.array([c for c, _ in cells]), np.array([m for _, m in cells], float)
        steps_of = [code // STEPS**2 % STEPS, code // STEPS % STEPS, code % STEPS]
        f = np.stack([np.where(s > 0, 2.0 ** (-(s - 1) / 2), 0.0) for s in steps_of] + [np.full(len(code), 1 / (v + 1))], 1)
        kind = code // STEPS**3
        for _ in range(steps):
            share = weights[kind] * f
            share *= (n / share.sum(1))[:, None]
            # a hundred tokens' worth of the starting weights keeps thin buckets sane
            weights = np.stack([np.bincount(kind, share[:, i], len(weights)) for i in range(4)], 1) + 100 * start
            weights /= weights.sum(1, keepdims=True)
    # an unseen context gives no estimate, so its share goes to the lower orders
    weights[BUCKETS:, 0] = 0
    weights[2 * BUCKETS :, 1] = 0
    weights = np.maximum(weights, [[0, 0, 0, 1e-4]])
    return weights / weights.sum(1, keepdims=True)


def score(docs: DataFrame, block_bytes: int = BLOCK) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document."""
    spark = docs.sparkSession
    rows = parts(docs)
    facts = rows.agg(F.sum(F.octet_length("text")), F.sum((F.col("use") != HELD).cast("long")), F.sum((F.col("use") == COUNTED).cast("long"))).first()
    size, starts, counted_starts = (int(x or 0) for x in facts)
    buckets, ranges = max(8, -(-size // (2 * block_bytes))), max(8, -(-size // RANGE))
    bits = min(64, 24 + math.ceil(math.log2(size + 256)))

    def bucketed(df: DataFrame, label: str) -> DataFrame:
        """A table in the shared folder, bucketed by block."""
        name = f"llm_{label}_{uuid.uuid4().hex}"
        df.write.bucketBy(buckets, "block").option("path", scratch_path(spark, name)).saveAsTable(name)
        return spark.table(name)

    def exchange(requests: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
        """Answers by block (one row a block), and the ranges' statistics."""
        answers = requests.groupBy("order", "part").applyInArrow(answer, "block long, order int, part int, body binary")
        each = answers.repartition(buckets, "block").groupBy("block").pivot("order", orders[label]).agg(F.collect_list(F.struct("part", "body")))
        table = bucketed(each.select("block", *[F.col(str(o)).alias(f"a{o}") for o in orders[label]]), label)
        return table.filter("block >= 0"), table.filter("block < 0")

    orders = {"pairs": [0, 1], "triples": [2]}
    request = "block long, order int, part int, body binary"
    names = [x.split(" ")[0] for x in request.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary()]

    def batch(columns: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    def ask_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                grams = Block(data, bits)
                found = [(block, o, r, x) for o in (0, 1) for r, x in grams.asked(o, None, ranges)]
                yield batch(list(zip(*found)))

    def ask_triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, data, a0, a1 in zip(*(c.to_pylist() for c in b.columns)):
                e = Estimates(data, [a0, a1], bits)
                found = [(block, 2, r, x) for r, x in e.block.asked(2, e.open_trigrams(), ranges)]
                if found:
                    yield batch(list(zip(*found)))

    blocks = bucketed(make_blocks(rows, block_bytes), "blocks")
    pairs, pair_facts = exchange(blocks.select("block", "data").mapInArrow(ask_pairs, request), "pairs")
    first = blocks.join(pairs, "block")
    triples, _ = exchange(first.select("block", "data", "a0", "a1").mapInArrow(ask_triples, request), "triples")
    everything = first.join(triples, "block", "left").select("ids", "data", "a0", "a1", "a2")
    known = [np.frombuffer(r["body"], np.int64) for r in pair_facts.select(F.explode("a0").alias("a")).select("a.body").toLocalIterator()]
    v, n, counted_n = (int(sum(k[i] for k in known)) for i in range(3))

    def held_out_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, data, a0, a1, a2 in zip(*(c.to_pylist() for c in b.columns)):
                e = Estimates(data, [a0, a1, a2 or []], bits)
                aside = e.block.of == ASIDE
                kind, *ratios = e.ratios(lambda t: t[0], counted_starts, counted_n)
                code = kind[aside]
                for f in ratios:
                    f = f[aside]
                    level = np.where(f > 0, np.minimum(1 + np.round(-2 * np.log2(np.maximum(f, 1e-12))), STEPS - 1), 0)
                    code = code * STEPS + level.astype(np.int64)
                cells, m = np.unique(code, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(m)], names=["cell", "m"])

    cells = everything.mapInArrow(held_out_cells, "cell long, m long").groupBy("cell").agg(F.sum("m").alias("m"))
    weights = learn([(r["cell"], r["m"]) for r in cells.collect()], v)  # at most buckets x STEPS ** 3 rows, whatever the corpus

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, data, a0, a1, a2 in zip(*(c.to_pylist() for c in b.columns)):
                e = Estimates(data, [a0, a1, a2 or []], bits)
                g = e.block
                kind, f3, f2, f1 = e.ratios(lambda t: t[0] + t[1], starts, n)
                w = weights[kind]
                mixed = w[:, 0] * f3 + w[:, 1] * f2 + w[:, 2] * f1 + w[:, 3] / (v + 1)
                c = sum(e.totals[0])[g.at[0]]
                head = g.ends - g.lengths
                total = lambda x: np.add.reduceat(x, head)
                values = {
                    "doc_id": pa.array(ids, pa.int64()),
                    "held_out": pa.array(g.use == HELD),
                    "n_tokens": pa.array(g.lengths),
                    "n_known": pa.array(total((c > 0).astype(np.int64))),
                    "train_tokens": pa.array(np.full(len(ids), n, np.int64)),
                    "base_score": pa.array(total(np.log10((c + 0.5) / (n + 0.5 * (v + 1))))),
                    "score": pa.array(total(np.log10(mixed))),
                }
                yield pa.RecordBatch.from_arrays(list(values.values()), names=list(values))

    return everything.mapInArrow(
        rate, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
