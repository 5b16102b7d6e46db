"""Phrases whose words occur together far more often than their frequencies explain, per language.

N-grams are counted in two passes over hash partitions of (language, n-gram). Tasks count what they read in runs of
``RUN`` words and send each hash partition one packed summary a run. A partition merges its summaries as Misra-Gries
counters: when there are more counters than the capacity, the value of the first one too many is taken from all, and
those at zero go. The capacity exceeds the partition's mass (the sum of its counts) divided by the threshold, so less
than the threshold is taken from any n-gram in total and every frequent one survives. The second pass over the
partition's summaries counts the survivors exactly. Counters are bounded by the mass, not by the number of distinct
n-grams, and the number of partitions grows with the corpus, so that each has about ``MASS`` occurrences; a common
n-gram is one entry a run.

Scores need the counts of both parts of every cut of a phrase, which are at least as frequent as the phrase and so
among the survivors: one join. Whether a phrase lies in a longer one is decided by the phrases one word longer, as a
longer phrase's inner phrases are at least as frequent as itself. Products are decimals of 38 digits; they hold
counts up to 10 ** 16.

Defined results: null text is empty, a null language counts as ``und``; repeated rows count as often as they occur;
ties in score and count go to the smaller phrase in byte order; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weatherlake.llm.common import LOWER, UPPER, body, stored
from weatherlake.llm.ngram_lm import pack, unpack

#: Words that a task counts at once, and occurrences per partition. Numbers of a run's words fit 20 bits, three fit 63.
RUN, MASS = (1 << 20) - 2, 2 << 20
BREAKS = b".,;:!?\n\x0b\x0c\r"
#: Folds A-Z, turns every break into a full stop, which is no part of a word, and tabs into spaces.
FOLD = bytes.maketrans(UPPER.encode() + BREAKS + b"\t", LOWER.encode() + b"." * len(BREAKS) + b" ")
SPACE, NOTHING, NEWLINE = (pa.scalar(x, pa.large_binary()) for x in (b" ", b"", b"\n"))
SALTS = 8
RUNS = "part long, lang string, mass long, words long, grams binary, counts binary"
FOUND = "lang string, phrase string, words int, n long"


def words_of(text: bytes) -> pa.Array:
    """All words of the text, with full stops between pieces and at the end."""
    return pa.array((text + b".").translate(FOLD).replace(b".", b" . ").split(), pa.large_binary())


def word_numbers(words: list[pa.Array]) -> tuple[np.ndarray, pa.Array]:
    """Numbers of all words, 0 between pieces, and the vocabulary that they number."""
    coded = pa.concat_arrays([pa.array([b"."], pa.large_binary()), *words]).dictionary_encode()
    return coded.indices.to_numpy()[1:].astype(np.int64), coded.dictionary


def ngrams(numbers: np.ndarray, size: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams, as rows of word numbers of at most ``bits`` bits, and their counts."""
    n = max(len(numbers) - size + 1, 0)
    columns = [numbers[k : k + n] for k in range(size)]
    whole = np.logical_and.reduce([c > 0 for c in columns])
    columns = [c[whole] for c in columns]
    keys = columns[0]
    if size * bits <= 63:
        for c in columns[1:]:
            keys = keys << bits | c
        keys, counts = np.unique(keys, return_counts=True)
        return np.stack([keys >> bits * (size - 1 - k) & (1 << bits) - 1 for k in range(size)], 1), counts
    for c in columns[1:]:
        # beginnings by rank, so two numbers below 2 ** 32 always make a key
        keys = np.unique(keys, return_inverse=True)[1] << 32 | c
    _, first, counts = np.unique(keys, return_index=True, return_counts=True)
    return np.stack([c[first] for c in columns], 1), counts


def summaries(lang: str, numbers: np.ndarray, vocabulary: pa.Array, sizes: int, parts: int) -> pa.RecordBatch:
    """The run's counts of one language, one row per hash partition."""
    seed = np.uint64(xxhash.xxh3_64_intdigest(lang.encode()))
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in vocabulary.to_pylist()], np.uint64)
    grams, counts, homes, single = [], [], [], []
    for size in range(1, sizes + 1):
        rows, n = ngrams(numbers, size, len(vocabulary).bit_length())
        mixed = np.full(len(rows), seed, np.uint64)
        for k in range(size):
            mixed = (mixed ^ hashes[rows[:, k]]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(32)
        homes.append((mixed >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32))
        words = [vocabulary.take(pa.array(rows[:, k])) for k in range(size)]
        line = pc.binary_join_element_wise(*words, SPACE) if size > 1 else words[0]
        grams.append(pc.binary_join_element_wise(line, NOTHING, NEWLINE))
        counts.append(n)
        single.append(n if size == 1 else np.zeros(len(n), np.int64))
    home, n, one = np.concatenate(homes), np.concatenate(counts), np.concatenate(single)
    home = home.astype(np.uint16 if parts <= 1 << 16 else np.int64)  # short numbers sort by radix
    order = np.argsort(home, kind="stable")
    n, one = n[order], one[order]
    present, first = np.unique(home[order], return_index=True)
    # all n-grams in the order of the partitions as one text, a line each
    lines = pa.concat_arrays(grams).take(pa.array(order))
    ends = np.frombuffer(lines.buffers()[1], np.int64, len(lines) + 1, lines.offset * 8)
    text = memoryview(lines.buffers()[2])
    cut = [*first.tolist(), len(order)]
    zip_up = zstandard.ZstdCompressor(level=1).compress
    out: list[list] = [[] for _ in range(6)]
    for part, i, j in zip(present.tolist(), cut, cut[1:]):
        row = [part, lang, int(n[i:j].sum()), int(one[i:j].sum()), zip_up(text[ends[i] : ends[j] - 1]), pack(n[i:j].astype(np.uint32))]
        for column, value in zip(out, row):
            column.append(value)
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=[c.split(" ")[0] for c in RUNS.split(", ")])


def read_run(grams: bytes, counts: bytes) -> tuple[list[bytes], list[int]]:
    return zstandard.ZstdDecompressor().decompress(grams).split(b"\n"), unpack(counts, np.uint32)[0].tolist()


class MisraGries:
    """Counters of which at most ``capacity`` are kept; ``taken`` bounds what any count may lack."""

    def __init__(self, capacity: int):
        self.capacity, self.taken = capacity, 0
        self.counters: dict[bytes, int] = {}

    def add(self, grams: list[bytes], counts: list[int]) -> None:
        held = self.counters
        get = held.get
        for g, n in zip(grams, counts):
            held[g] = get(g, 0) + n
        if len(held) > 2 * self.capacity:
            self.shrink()

    def shrink(self) -> None:
        if len(self.counters) <= self.capacity:
            return
        values = np.fromiter(self.counters.values(), np.int64, len(self.counters))
        cut = int(np.partition(values, -self.capacity - 1)[-self.capacity - 1])
        self.counters = {g: n - cut for g, n in self.counters.items() if n > cut}
        self.taken += cut

    def may_reach(self, threshold: int) -> list[bytes]:
        self.shrink()
        return [g for g, n in self.counters.items() if n + self.taken >= threshold]


def frequent_of(runs: list[tuple[bytes, bytes]], mass: int, threshold: int) -> dict[bytes, int]:
    """Exact counts of all n-grams that occur ``threshold`` times or more in the runs."""
    first = MisraGries(mass // threshold + 1)
    for run in runs:
        first.add(*read_run(*run))
    exact = dict.fromkeys(first.may_reach(threshold), 0)
    for run in runs:
        for g, n in zip(*read_run(*run)):
            if g in exact:
                exact[g] += n
    return {g: n for g, n in exact.items() if n >= threshold}


def frequent(docs: DataFrame, sizes: int, threshold: int) -> DataFrame:
    """(lang, phrase, words, n): n-grams of up to ``sizes`` words with n >= ``threshold``, and rows with words = 0
    whose n adds up to all words of the language."""
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), body().cast("binary").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # prose has six bytes a word
    parts = max(32, size * sizes // 6 // MASS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[pa.Array]] = {}
        total = 0

        def out() -> Iterator[pa.RecordBatch]:
            for lang, words in held.items():
                numbers, vocabulary = word_numbers(words)
                if numbers.any():
                    yield summaries(lang, numbers, vocabulary, sizes, parts)

        for b in batches:
            langs: dict[str, list[bytes]] = {}
            for lang, text in zip(*(c.to_pylist() for c in b.columns)):
                langs.setdefault(lang, []).append(text)
            for lang, texts in langs.items():
                for group in portions(texts, RUN):
                    # a word and what parts it from the next are two bytes at least
                    if total and total + len(group) // 2 + 1 > RUN:
                        yield from out()
                        held, total = {}, 0
                    words = words_of(group)
                    held.setdefault(lang, []).append(words)
                    total += len(words)
        yield from out()

    def settle(key: tuple, t: pa.Table) -> pa.Table:
        runs = list(zip(t.column("grams").to_pylist(), t.column("counts").to_pylist()))
        found = frequent_of(runs, sum(t.column("mass").to_pylist()), threshold)
        grams = [b"", *found]
        words = [0, *(g.count(b" ") + 1 for g in found)]
        values = [[key[1].as_py()] * len(grams), grams, words, [sum(t.column("words").to_pylist()), *found.values()]]
        kinds = [pa.string(), pa.string(), pa.int32(), pa.int64()]
        return pa.table([pa.array(v, k) for v, k in zip(values, kinds)], names=["lang", "phrase", "words", "n"])

    return stored(rows.mapInArrow(count, RUNS).groupBy("part", "lang").applyInArrow(settle, FOUND), "frequent")


def portions(texts: list[bytes], most: int) -> Iterator[bytes]:
    """The texts, joined into portions of about 1 MB; a text over ``most`` bytes is cut at breaks between pieces."""
    held: list[bytes] = []
    size = 0
    for text in texts:
        for piece in cut_text(text, most // 2):
            if held and size + len(piece) > 1 << 20:
                yield b".".join(held)
                held, size = [], 0
            held.append(piece)
            size += len(piece) + 1
    if held:
        yield b".".join(held)


def cut_text(text: bytes, most: int) -> Iterator[bytes]:
    """The text, cut at breaks into parts of ``most`` bytes; a longer piece without a break stays whole."""
    at = 0
    while len(text) - at > most:
        stop = max(text.rfind(bytes([c]), at, at + most) for c in BREAKS)
        if stop < at:
            stop = min((i for i in (text.find(bytes([c]), at + most) for c in BREAKS) if i >= 0), default=-1)
            if stop < 0:
                break
        yield text[at:stop]
        at = stop + 1
    yield text[at:]


def mine(docs: DataFrame, sizes: int = 3, threshold: int = 10, inside: int = 50, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best ``top`` phrases of 2 to ``sizes`` words.

    ``a`` counts the phrase, ``l`` and ``r`` the parts of its lowest-scoring cut, ``n`` all words of the language;
    the score is floor(1000000 a a / (l r)). A phrase inside a longer one that occurs at least ``inside`` percent as
    often is left out.
    """
    found = frequent(docs, sizes, threshold)
    totals = found.filter("words = 0").groupBy("lang").agg(F.sum("n").alias("n"))
    whole = found.filter("words >= 2").select("lang", "phrase", "words", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    join = lambda start, length: F.array_join(F.slice("w", start, length), " ")

    longer = whole.filter("words >= 3").select("lang", "a", F.explode(F.array(join(F.lit(1), F.col("words") - 1), join(F.lit(2), F.col("words") - 1))).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("longest"))
    kept = whole.join(longer, ["lang", "phrase"], "left").filter(f"longest is null or 100 * longest < {inside} * a")

    cuts = kept.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    sides = F.array(
        F.struct(F.lit(True).alias("left"), join(F.lit(1), F.col("k")).alias("part"), F.col("k").alias("size")),
        F.struct(F.lit(False).alias("left"), join(F.col("k") + 1, F.col("words") - F.col("k")).alias("part"), (F.col("words") - F.col("k")).alias("size")),
    )
    asked = cuts.select("lang", "phrase", "a", "k", F.explode(sides).alias("s")).select("lang", "phrase", "a", "k", "s.*")
    # a common word is a part of many phrases: words are kept SALTS times and asked for by the phrase's hash
    asked = asked.withColumn("salt", F.when(F.col("size") == 1, F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).otherwise(F.lit(0)))
    parts = found.filter(f"words between 1 and {sizes - 1}").select("lang", F.col("phrase").alias("part"), F.col("n").alias("f"), "words")
    parts = parts.withColumn("salt", F.explode(F.when(F.col("words") == 1, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    both = asked.join(parts.drop("words").withColumn("salt", F.col("salt").cast("long")), ["lang", "part", "salt"])
    both = both.repartition("lang", "phrase")
    each = both.groupBy("lang", "phrase", "a", "k").agg(F.max(F.when(F.col("left"), F.col("f"))).alias("l"), F.max(F.when(~F.col("left"), F.col("f"))).alias("r"))
    score = F.expr("(cast(1000000 as decimal(7,0)) * (cast(a as decimal(16,0)) * cast(a as decimal(16,0)))) div (cast(l as decimal(16,0)) * cast(r as decimal(16,0)))")
    worst = each.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    scored = worst.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # a language's best are among the best of its parts
    part = scored.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(256)))
    part = part.withColumn("_at", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).filter(F.col("_at") <= top)
    best = part.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
