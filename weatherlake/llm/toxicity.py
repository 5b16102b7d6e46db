"""Toxic passages by maximum-scoring segments over token log-odds.

A token's log-odds come from counts in a bounded labelled sample under nested Dirichlet priors. Its rate in toxic and in
clean texts, relative to its share of all documents, starts from the rates of its stems of 3, 4 and 5 letters, each a
Dirichlet prior of ``PRIOR`` expected tokens for the next longer one and the last for the word itself. So a word that
labels show often has its own odds, and one that they hardly or never show has those of the words it begins like. Shares
come from the counts of all documents. All tokens lose ``DRIFT``, so clean text drifts down. A linear scan finds every
maximal segment of positive sum. Segments follow an extreme-value law: the expected number of segments of score S or
more in a clean text of m tokens is E = K m exp(-lambda S), lambda being the positive root of the clean tokens' moment
equation and K fitted to the segments of clean sample texts that the odds were not learned from. A document's evidence
is the sum of -ln E over its significant segments (E < 1) or, where it has none, the -ln E of its best one, so texts
without a passage are ranked too. A logistic curve turns it into a score; it is fitted on sample texts, each scored with
odds learned from the other half of the sample. Scoring is a map over the documents: no shuffle.

The lexicon holds the stems of the sample's words, and those words that it has ``LEAST`` times or more; it is bounded by
the labelled rows. Other words use their stems.

Defined results: null or empty text has no passages and gets the score of no evidence at all; without both labels in
the sample every score is 0; repeated rows score alike; an empty table gives an empty result; extra columns pass
through.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weatherlake.llm.common import map_columns, stored
from weatherlake.llm.labelled import sample

SAMPLE = 20_000
DRIFT, PRIOR = 1.0, 1.0
STEMS = (3, 4, 5)
#: Occurrences in the sample from which a word has odds of its own.
LEAST = 4
#: Words whose values a task remembers.
KNOWN = 1 << 20
WORD = re.compile(r"[^\W\d_]+")


def tokens(text: str) -> list[str]:
    return WORD.findall(text.lower())


def segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, sum) of a sequence, in linear time."""
    found: list[list[float]] = []  # start, end, sum before start, sum at end
    total = 0.0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        new = [i, i + 1, before, total]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                # a candidate that starts no lower can be neither extended nor passed; step over it
                j = found[j][4]
            if j < 0 or found[j][3] >= new[3]:
                found.append([*new, j])
                break
            new = [found[j][0], new[1], found[j][2], new[3]]
            del found[j:]
    return [(int(f[0]), int(f[1]), f[3] - f[2]) for f in found]


def count_tokens(picked: DataFrame) -> DataFrame:
    """(token, toxic0, toxic1, clean0, clean1): counts over the two halves of the sample. Words that it has less than
    ``LEAST`` times are added up under their longest stem."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], Counter] = {(f, y): Counter() for f in (0, 1) for y in (0, 1)}
        for b in batches:
            for text, y, fold in zip(*(c.to_pylist() for c in b.columns)):
                seen[fold, y].update(tokens(text))
        for fold in (0, 1):
            words = list(seen[fold, 0].keys() | seen[fold, 1].keys())
            cols = [words, [fold] * len(words), [seen[fold, 1][w] for w in words], [seen[fold, 0][w] for w in words]]
            kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["token", "fold", "toxic", "clean"])

    rows = picked.select("text", "y", "fold").mapInArrow(run, "token string, fold int, toxic long, clean long")
    sides = [F.sum(F.when(F.col("fold") == f, F.col(c))).alias(f"{c}{f}") for c in ("toxic", "clean") for f in (0, 1)]
    each = rows.groupBy("token").agg(*sides).fillna(0)
    # a rare word counts for its stem alone
    often = sum(F.col(f"{c}{f}") for c in ("toxic", "clean") for f in (0, 1)) >= LEAST
    key = F.when(often, F.col("token")).otherwise(F.substring("token", 1, max(STEMS)))
    return each.groupBy(key.alias("token")).agg(*[F.sum(f"{c}{f}").alias(f"{c}{f}") for c in ("toxic", "clean") for f in (0, 1)])


def shares(docs: DataFrame, words: list[str]) -> tuple[Counter, int]:
    """Counts of the sample's words in all documents, and all tokens of these."""
    shared = docs.sparkSession.sparkContext.broadcast(frozenset(words))

    def add_known(to: Counter, counts: Counter) -> None:
        known, longest = shared.value, max(STEMS)
        for w, n in counts.items():
            k = w if w in known else w[:longest]
            if k in known:
                to[k] += n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        total = 0
        for b in batches:
            for text in b.column(0).to_pylist():
                found = tokens(text or "")
                total += len(found)
                seen.update(found)
            if len(seen) > KNOWN:
                kept: Counter = Counter()
                add_known(kept, seen)
                seen = kept
        kept = Counter()
        add_known(kept, seen)
        cols = [pa.array([None, *kept], pa.string()), pa.array([total, *kept.values()], pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, names=["token", "n"])

    # at most one row a word of the sample
    rows = docs.select("text").mapInArrow(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    counts = Counter({r["token"]: r["n"] for r in rows if r["token"] is not None})
    return counts, sum(r["n"] for r in rows if r["token"] is None)


def log_odds(toxic: Counter, clean: Counter, everywhere: Counter, total: int) -> dict[tuple[int, str], float]:
    """Log-odds of the sample's words (level 0) and stems (level: their length)."""
    n_toxic, n_clean = sum(toxic.values()), sum(clean.values())
    if not n_toxic or not n_clean or not total:
        return {}
    words = toxic.keys() | clean.keys()
    rates: dict[tuple[int, str], tuple[float, float]] = {}
    for level in (*STEMS, 0):
        of: dict[str, list[int]] = {}
        for w in words:
            sums = of.setdefault(w[:level] if level else w, [0, 0, 0])
            sums[0] += toxic[w]
            sums[1] += clean[w]
            sums[2] += max(everywhere[w], toxic[w] + clean[w])
        for k, (t, c, n) in of.items():
            above = parent(k, level, rates)
            share = n / total
            rates[level, k] = (t + PRIOR * above[0]) / (n_toxic * share + PRIOR), (c + PRIOR * above[1]) / (n_clean * share + PRIOR)
    return {k: math.log(t / c) for k, (t, c) in rates.items()}


def parent(k: str, level: int, held: dict, other=(1.0, 1.0)):
    """What the longest known stem of a word, shorter than its own level, holds."""
    for stem in reversed(STEMS):
        if not level or stem < level:
            found = held.get((stem, k[:stem]))
            if found is not None:
                return found
    return other


class Passages:
    """Lexicon and calibration; ``find`` gives the significant passages, ``score`` the calibrated score."""

    def __init__(self, lexicon: dict[tuple[int, str], float]):
        self.lexicon = lexicon
        self.rate, self.k = 1.0, 0.1
        self.weights = np.array([-math.inf, 0.0])
        self.known: dict[str, float] = {}

    def __getstate__(self) -> dict:
        return {**self.__dict__, "known": {}}

    def value(self, word: str) -> float:
        found = self.lexicon.get((0, word))
        return (parent(word, 0, self.lexicon, 0.0) if found is None else found) - DRIFT

    def values(self, words: list[str]) -> list[float]:
        known = self.known
        if len(known) > KNOWN:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = self.value(w)
        return [known[w] for w in words]

    def all_segments(self, text: str) -> list[tuple[int, int, float, float]]:
        """(first token, end token, sum, -ln E) of every maximal segment."""
        values = self.values(tokens(text))
        size = math.log(self.k * max(len(values), 1))
        return [(a, b, s, self.rate * s - size) for a, b, s in segments(values)] if values else []

    def find(self, text: str) -> list[tuple[int, int, float, float]]:
        """The segments that clean text would not show by chance."""
        return [x for x in self.all_segments(text) if x[3] > 0]

    def evidence(self, text: str) -> tuple[float, int]:
        """Evidence on a logarithmic scale both ways from zero, and the number of significant segments."""
        found = self.all_segments(text)
        sure = [x[3] for x in found if x[3] > 0]
        if sure:
            return math.log1p(sum(sure)), len(sure)
        best = max((x[3] for x in found), default=-math.log(self.k * max(len(tokens(text)), 1)))
        return -math.log1p(max(-best, 0.0)), 0

    def score(self, evidence: float) -> float:
        if not self.lexicon:
            return 0.0
        z = self.weights[0] + self.weights[1] * evidence
        return 1 / (1 + math.exp(-min(max(z, -50.0), 50.0)))


def solve_rate(values: np.ndarray, weight: np.ndarray) -> float:
    """The positive root of sum(weight * exp(rate * value)) = 1."""
    lo, hi = 1e-6, 1.0
    f = lambda r: float((weight * np.exp(np.minimum(r * values, 700.0))).sum())
    while f(hi) < 1 and hi < 64:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 1 else (lo, mid)
    return max(lo, 1e-3)


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Intercept and slope by Newton steps, with a weak pull to zero."""
    design, w = np.stack([np.ones_like(x), x], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (y - p) - 1e-2 * w
        w = w + np.linalg.solve((design * (p * (1 - p) + 1e-9)[:, None]).T @ design + 1e-2 * np.eye(2), grad)
    return w


def learn(counts: list, folds: tuple[int, ...], everywhere: Counter, total: int) -> tuple[Passages, Counter]:
    """Odds and rate from the given halves of the sample, and their clean counts."""
    toxic, clean = Counter(), Counter()
    for r in counts:
        for f in folds:
            toxic[r["token"]] += r[f"toxic{f}"]
            clean[r["token"]] += r[f"clean{f}"]
    toxic, clean = +toxic, +clean
    model = Passages(log_odds(toxic, clean, everywhere, total))
    if model.lexicon:
        seen = [(model.value(w), n) for w, n in clean.items() if n]
        value, weight = (np.array(x, float) for x in zip(*seen))
        model.rate = solve_rate(value, weight / weight.sum())
    return model, clean


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = SAMPLE) -> Passages:
    """Learn from a bounded labelled sample (odds, clean-text law, final curve) and the counts of all documents."""
    half = F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2)).cast("int").alias("fold")
    picked = stored(sample(docs, labels, label, rows).select("text", "y", half), "toxic-sample")
    # the sample's words of LEAST occurrences, and stems: bounded by the labelled rows
    counts = count_tokens(picked).collect()
    everywhere, total = shares(docs, list({r["token"] for r in counts}))
    model, _ = learn(counts, (0, 1), everywhere, total)
    if not model.lexicon:
        return model
    # each half is scored with the odds of the other one
    crossed = [learn(counts, (1 - f,), everywhere, total)[0] for f in (0, 1)]
    shared = docs.sparkSession.sparkContext.broadcast(crossed)

    def strong_segments() -> Callable:
        models = shared.value

        def f(texts: list, folds: list) -> list[list]:
            return [[float(sum(1 for x in models[h].all_segments(t) if x[2] >= 1.0)) for t, h in zip(texts, folds)]]

        return f

    clean = map_columns(picked.filter("y = 0"), ["text", "fold"], [("n", "double")], strong_segments)
    many = clean.agg(F.sum("n")).first()[0] or 0.0
    n_clean = float(sum(r["clean0"] + r["clean1"] for r in counts))
    for m in (model, *crossed):
        m.k = float(np.clip((many + 0.5) / max(n_clean, 1.0) * math.exp(m.rate), 1e-6, 1.0))
    shared = docs.sparkSession.sparkContext.broadcast(crossed)

    def evidence() -> Callable:
        models = shared.value
        return lambda texts, folds: [[models[h].evidence(t)[0] for t, h in zip(texts, folds)]]

    seen_rows = map_columns(picked, ["text", "fold"], [("evidence", "double")], evidence).select("evidence", "y").collect()
    model.weights = logistic(np.array([r[0] for r in seen_rows]), np.array([r[1] for r in seen_rows], float))
    return model


def score(docs: DataFrame, model: Passages) -> DataFrame:
    """Append score and passages (the number of significant ones)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make() -> Callable:
        model = shared.value

        def f(texts: list) -> list[list]:
            found = [model.evidence(t or "") for t in texts]
            return [[model.score(e) for e, _ in found], [n for _, n in found]]

        return f

    return map_columns(docs, ["text"], [("score", "double"), ("passages", "long")], make)
