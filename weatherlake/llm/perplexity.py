"""Quality rules by character n-gram perplexity under modified Kneser-Ney models, one per language.

Symbols are code points, whatever the script, and every language has a model of its own, whatever their number. Spark
counts the ``ORDER``-grams of all texts per language and turns them into probabilities by grouping and joining: lower
orders use continuation counts, discounts come from counts of counts, and contexts add up what was freed. A model is a
table of (language, n-gram, log10 probability). No model is collected or broadcast, and no task holds a language.

Texts lie in blocks. A block asks for each of its distinct n-grams once; a bucket, a range of hashed n-grams of one
language, holds its part of the model as sorted hash arrays and answers the blocks by binary search. A document's
perplexity is the mean negative log10 probability of its symbols, with start symbols before the first.

The band of a language is its median plus or minus ``width`` robust standard deviations over documents with at least
``min_words`` words; documents outside are rejected. Plain counts (short or repetitive texts) reject as well.

Defined results: null or empty text has no words, fails the base rule, and has perplexity 1 (log 0); a null language
counts as the empty one; a language without measured documents has no band and rejects none; repeated rows count as
often as they occur and score alike; an empty table gives an empty result; extra columns are ignored or, in
``drop_rejected``, kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weatherlake.llm.common import ROW, SPACES, body, discard, keep_rows, numbered, stored
from weatherlake.llm.exchange import bucketed, text_blocks, text_of
from weatherlake.llm.ngram_lm import deltas, pack, unpack

ORDER = 4
#: Bits of a symbol in a key, and the symbol before a text's first.
BITS, START = 21, 0x110000
WIDTH = 5.0
#: log10 probability of an n-gram that the model does not have.
UNSEEN = -6.0
#: Distinct n-grams that a task holds before it passes its counts on, text bytes per range of n-grams, and per block.
HELD, RANGE, BLOCK = 1 << 20, 32 << 20, 2 << 20
GRAM = ["lang", "ctx", "w"]
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def numbers(x: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values below ``size``, ascending, and the number of each value among them."""
    if size > max(8 * len(x), 1 << 16):
        return np.unique(x, return_inverse=True)
    there = np.zeros(size, bool)
    there[x] = True
    return np.flatnonzero(there), (np.cumsum(there, dtype=np.int32) - np.int32(1))[x]


def present(points: np.ndarray) -> np.ndarray:
    """Distinct symbols, ascending."""
    there = np.zeros(START, bool)
    there[points] = True
    return np.flatnonzero(there)


class Grams:
    """The n-grams of a block: per language its distinct (ctx, w), and the number of each symbol's n-gram."""

    def __init__(self, raw: bytes, sizes: list[int], langs: list[str]):
        points = np.frombuffer(raw.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.int32)
        self.sizes = np.array(sizes, np.int64)
        at = np.cumsum(self.sizes + 1) - self.sizes - 1
        # places of bytes to places of characters
        before = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80, dtype=np.int32)])
        self.first, self.stop = before[at].astype(np.int64), before[at + self.sizes].astype(np.int64)
        del before
        columns = [points]
        for back in range(1, ORDER):
            x = np.concatenate([np.full(back, START, np.int32), points[:-back]])[: len(points)]
            for ahead in range(back):
                i = self.first + ahead
                x[i[i < len(x)]] = START
            columns.insert(0, x)
        number = {x: i for i, x in enumerate(dict.fromkeys(langs))}
        self.langs = list(number)
        of = np.full(len(points), -1, np.int32)
        for i, j, lang in zip(self.first.tolist(), self.stop.tolist(), langs):
            of[i:j] = number[lang]
        self.at = np.full(len(points), -1, np.int32)
        self.keys: list[tuple[np.ndarray, np.ndarray]] = []
        self.counts: list[np.ndarray] = []
        for k in range(len(self.langs)):
            here = of == k
            n = int(here.sum())
            mine = [c[here] for c in columns]
            symbols = np.append(present(mine[-1]), START)
            s = len(symbols)
            # the symbols' numbers, then those of pairs of symbols, then those of pairs of pairs
            code = [np.searchsorted(symbols, c) if n < 4096 else lookup(symbols)[c] for c in mine]
            pair = np.empty(2 * n, np.int64)
            pair[:n], pair[n:] = code[0], code[2]
            pair *= s
            pair[:n] += code[1]
            pair[n:] += code[3]
            del mine, code
            pairs, pair = numbers(pair, s * s)
            quad = pair[:n] * np.int64(len(pairs))
            quad += pair[n:]
            del pair
            quads, quad = numbers(quad, len(pairs) ** 2)
            a, b = np.divmod(pairs[quads // len(pairs)], s) if len(quads) else (quads, quads)
            c, d = np.divmod(pairs[quads % len(pairs)], s) if len(quads) else (quads, quads)
            ctx = (symbols[a] << 2 * BITS) | (symbols[b] << BITS) | symbols[c]
            self.keys.append((ctx, symbols[d]))
            self.counts.append(np.bincount(quad, minlength=len(quads)))
            # numbers go on from one language to the next; places between texts keep -1
            self.at[here] = quad + sum(len(k[0]) for k in self.keys[:-1])


def lookup(symbols: np.ndarray) -> np.ndarray:
    out = np.zeros(START + 1, np.int32)
    out[symbols] = np.arange(len(symbols))
    return out


def hashed(ctx: np.ndarray, w: np.ndarray) -> np.ndarray:
    """64-bit hashes of n-grams."""
    x = ctx.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + w.astype(np.uint64)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def part_column(ranges: int) -> Column:
    return (F.col("ctx") % 1_000_003 * 1009 + F.col("w")) % ranges


def part_of(ctx: np.ndarray, w: np.ndarray, ranges: int) -> np.ndarray:
    return (ctx % 1_000_003 * 1009 + w) % ranges


def language() -> Column:
    return F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang")


def gram_blocks(docs: DataFrame, buckets: int, block_bytes: int) -> DataFrame:
    return bucketed(text_blocks(docs.withColumn("lang", language()), block_bytes, tag="lang"), buckets, "blocks")


def count_grams(blocks: DataFrame) -> DataFrame:
    """(lang, ctx, w, n): ``ctx`` holds the first three symbols of a 4-gram, ``w`` is the last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                ctx, w, n = (np.concatenate([p[i] for p in parts]) for i in range(3))
                order = np.lexsort((w, ctx))
                ctx, w, n = ctx[order], w[order], n[order]
                new = np.ones(len(ctx), bool)
                new[1:] = (ctx[1:] != ctx[:-1]) | (w[1:] != w[:-1])
                i = np.flatnonzero(new)
                if len(i):
                    values = [pa.array([lang] * len(i)), pa.array(ctx[i]), pa.array(w[i].astype(np.int32)), pa.array(np.add.reduceat(n, i))]
                    yield pa.RecordBatch.from_arrays(values, names=[*GRAM, "n"])

        for b in batches:
            for sizes, langs, data in zip(*(c.to_pylist() for c in b.columns)):
                g = Grams(text_of(data), sizes, langs)
                for lang, (ctx, w), n in zip(g.langs, g.keys, g.counts):
                    held.setdefault(lang, []).append((ctx, w, n))
                    size += len(ctx)
                if size >= HELD:
                    yield from out()
                    held, size = {}, 0
        yield from out()

    partial = blocks.select("sizes", "tags", "data").mapInArrow(run, "lang string, ctx long, w int, n long")
    return partial.groupBy(*GRAM).agg(F.sum("n").alias("n"))


def discount(order_counts: DataFrame) -> DataFrame:
    """(lang, d1, d2, d3): modified Kneser-Ney discounts for counts 1, 2 and 3 or more, from counts of counts."""
    c = order_counts.groupBy("lang").agg(*[F.count_if(F.col("n") == i).cast("double").alias(f"n{i}") for i in (1, 2, 3, 4)])
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    usable = (F.col("n1") > 0) & (F.col("n2") > 0)

    def clipped(x: Column, top: float) -> Column:
        return F.when(usable, F.least(F.greatest(x, F.lit(0.05)), F.lit(top))).otherwise(F.lit(0.5))

    return c.select(
        "lang",
        clipped(1 - 2 * y * F.col("n2") / F.nullif(F.col("n1"), F.lit(0.0)), 1.0).alias("d1"),
        clipped(2 - 3 * y * F.col("n3") / F.nullif(F.col("n2"), F.lit(0.0)), 2.0).alias("d2"),
        clipped(F.coalesce(3 - 4 * y * F.col("n4") / F.nullif(F.col("n3"), F.lit(0.0)), F.lit(0.5)), 3.0).alias("d3"),
    )


def train(counts: DataFrame) -> DataFrame:
    """(lang, ctx, w, logp): probabilities of all counted n-grams."""
    orders, size = {ORDER: counts}, {ORDER: counts.count()}
    for k in range(ORDER - 1, 0, -1):
        tail = F.col("ctx").bitwiseAND(F.lit((1 << BITS * (k - 1)) - 1)).alias("ctx")
        orders[k] = stored(orders[k + 1].select("lang", tail, "w").groupBy(*GRAM).agg(F.count("*").alias("n")), f"grams-{k}", size[k + 1])
        size[k] = orders[k].count()
    # below the single symbols: all symbols of the language alike, and one for those it does not have
    lower = orders[1].groupBy("lang").agg((1.0 / (F.count("*") + 1)).alias("back"))
    for k in range(1, ORDER + 1):
        d = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        x = orders[k].join(discount(orders[k]), "lang").select(*GRAM, "n", d.alias("d"))
        of = x.groupBy("lang", "ctx").agg(F.sum("n").alias("total"), F.sum("d").alias("freed"))
        x = x.join(of, ["lang", "ctx"])
        if k == 1:
            x = x.join(lower, "lang")
        else:
            x = x.withColumn("tail", F.col("ctx").bitwiseAND(F.lit((1 << BITS * (k - 2)) - 1)))
            x = x.join(lower.withColumnsRenamed({"ctx": "tail"}), ["lang", "tail", "w"])
        p = (F.col("n") - F.col("d")) / F.col("total") + F.col("freed") / F.col("total") * F.col("back")
        lower = stored(x.select(*GRAM, p.alias("back")), f"probabilities-{k}", size[k])
    return lower.select(*GRAM, F.log10("back").cast("float").alias("logp"))


def answers(blocks: DataFrame, model: DataFrame, ranges: int, buckets: int) -> DataFrame:
    """(block, grams): per block the log10 probabilities of its distinct n-grams, by language and part."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, sizes, langs, data in zip(*(c.to_pylist() for c in b.columns)):
                g = Grams(text_of(data), sizes, langs)
                rows: list[tuple] = []
                for lang, (ctx, w) in zip(g.langs, g.keys):
                    if len(ctx):
                        order, cut, present = asked_order(ctx, w, ranges)
                        ctx, w = ctx[order], w[order]
                        rows += [(block, lang, p, pack(deltas(ctx[i:j].astype(np.uint64)), w[i:j].astype(np.uint32))) for p, i, j in zip(present, cut, cut[1:])]
                if rows:
                    kinds = [pa.int64(), pa.string(), pa.int64(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["block", "lang", "part", "body"])

    def answer(requests: pa.Table, held: pa.Table) -> pa.Table:
        keys = hashed(held.column("ctx").to_numpy(), held.column("w").to_numpy())
        order = np.argsort(keys)
        keys, logp = keys[order], held.column("logp").to_numpy()[order]
        bodies = []
        for data in requests.column("body").to_pylist():
            ctx, w = unpack(data, np.uint64, np.uint32)
            wanted = hashed(np.cumsum(ctx, dtype=np.uint64), w)
            at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
            found = np.where(keys[at] == wanted, logp[at], UNSEEN) if len(keys) else np.full(len(wanted), UNSEEN)
            bodies.append(found.astype(np.float32).tobytes())
        return requests.set_column(3, "body", pa.array(bodies, pa.binary()))

    requests = blocks.select("block", "sizes", "tags", "data").mapInArrow(ask, "block long, lang string, part long, body binary")
    held = model.withColumn("part", part_column(ranges).cast("long"))
    got = requests.groupBy("part", "lang").cogroup(held.groupBy("part", "lang")).applyInArrow(answer, "block long, lang string, part long, body binary")
    got = got.repartition(buckets, "block").groupBy("block").agg(F.collect_list(F.struct("lang", "part", "body")).alias("grams"))
    return bucketed(got, buckets, "answers")


def asked_order(ctx: np.ndarray, w: np.ndarray, ranges: int) -> tuple[np.ndarray, list[int], list[int]]:
    """Order in which n-grams are asked for (by part, then by key), where parts begin, and the parts."""
    part = part_of(ctx, w, ranges)
    order = np.lexsort((w, ctx, part))
    present, first = np.unique(part[order], return_index=True)
    return order, [*first.tolist(), len(order)], present.tolist()


def log_probabilities(g: Grams, rows: list[dict] | None, ranges: int) -> np.ndarray:
    """log10 probability of every symbol of the block."""
    by: dict[str, list[dict]] = {}
    for r in rows or []:
        by.setdefault(r["lang"], []).append(r)
    each = [np.zeros(0)]
    for lang, (ctx, w) in zip(g.langs, g.keys):
        found = np.zeros(len(ctx))
        if len(ctx):
            order, _, _ = asked_order(ctx, w, ranges)
            found[order] = np.concatenate([np.frombuffer(r["body"], np.float32) for r in sorted(by[lang], key=lambda r: r["part"])])
        each.append(found)
    return np.concatenate([*each, [0.0]])[g.at]


def repeated_words(words: list[bytes]) -> int:
    """Words covered by three-word windows that occur twice or more."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    if len(number) == len(words):
        return 0
    key = (ids[:-2] * len(number) + ids[1:-1]) * len(number) + ids[2:] if len(number) < 2_000_000 else None
    if key is None:
        pair = np.unique(ids[:-2] * len(number) + ids[1:-1], return_inverse=True)[1]
        key = pair * len(number) + ids[2:]
    _, at, n = np.unique(key, return_inverse=True, return_counts=True)
    hot = n[at] > 1
    covered = np.zeros(len(words), bool)
    for i in range(3):
        covered[i : len(words) - 2 + i] |= hot
    return int(covered.sum())


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    spaces = len(raw) - len(raw.translate(None, SPACES))
    symbols = len(raw) - len(raw.translate(None, b"#*$%&|<>"))
    lines = [x for x in raw.split(b"\n") if x.strip(SPACES)]
    return len(words), len(text) - spaces, symbols, len(lines) - len(set(lines)), repeated_words(words)


def measure(docs: DataFrame, block_bytes: int = BLOCK) -> DataFrame:
    """Stored (doc_id, lang, the base counts, log_ppl): ``log_ppl`` is the mean negative log10 probability per symbol."""
    size = docs.agg(F.sum(F.octet_length(body()))).first()[0] or 0
    buckets, ranges = max(8, -(-size // (2 * block_bytes))), max(8, -(-size // RANGE))
    blocks = gram_blocks(docs, buckets, block_bytes)
    model = train(stored(count_grams(blocks), "grams"))
    answered = answers(blocks, model, ranges, buckets)
    both = blocks.join(answered, "block", "left").select("ids", "sizes", "tags", "data", "grams")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, sizes, langs, data, rows in zip(*(c.to_pylist() for c in b.columns)):
                raw = text_of(data)
                g = Grams(raw, sizes, langs)
                logp = log_probabilities(g, rows, ranges)
                ppl = [-float(logp[i:j].sum()) / (j - i) if j > i else 0.0 for i, j in zip(g.first.tolist(), g.stop.tolist())]
                at = np.cumsum([0, *(n + 1 for n in sizes)]).tolist()
                counts = list(zip(*(base_counts(raw[i : i + n].decode("utf-8", "surrogatepass")) for i, n in zip(at, sizes))))
                values = [pa.array(ids, pa.int64()), pa.array(langs), *[pa.array(c, pa.int64()) for c in counts], pa.array(ppl)]
                yield pa.RecordBatch.from_arrays(values, names=["doc_id", "lang", *COUNTS, "log_ppl"])

    measured = stored(both.mapInArrow(run, "doc_id long, lang string, " + "".join(f"{c} long, " for c in COUNTS) + "log_ppl double"), "rule-counts")
    discard(blocks)
    discard(answered)
    return measured


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def bands(measured: DataFrame, width: float = WIDTH, min_words: int = 50) -> DataFrame:
    """(lang, low, high) of every language."""
    q = measured.filter(F.col("n_words") >= min_words).groupBy("lang").agg(F.percentile_approx("log_ppl", [0.25, 0.5, 0.75], 10000).alias("q"))
    spread = (F.col("q")[2] - F.col("q")[0]) / 1.349
    return q.select("lang", (F.col("q")[1] - width * spread).alias("low"), (F.col("q")[1] + width * spread).alias("high"))


def judge(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """Append ``base_failed`` and ``kept`` to the rows of ``measure``."""
    x = measured.join(limits, "lang", "left")
    inside = F.coalesce(F.col("log_ppl").between(F.col("low"), F.col("high")), F.lit(True))
    return x.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & inside).drop("low", "high")


def rules(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, the base counts, log_ppl, base_failed, kept) of every row; model and bands are those of ``docs``."""
    measured = measure(docs)
    return judge(measured, bands(measured))


def drop_rejected(docs: DataFrame) -> DataFrame:
    """The documents that pass, with all their columns."""
    rows = numbered(docs)
    found = rules(rows.select(F.col(ROW).alias("doc_id"), "_doc.text", "_doc.lang"))
    return keep_rows(rows, found.filter("kept").select(F.col("doc_id").alias(ROW)))
