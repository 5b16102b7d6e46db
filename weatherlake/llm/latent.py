"""Quality by nearest-neighbour voting over latent-semantic vectors.

Terms describe how a text is written, not what it says: runs of three character classes and counts of repetition
(word equal to the one before, word inside a repeated three-word window, repeated line, new word). Term weights
are log frequencies times inverse document frequency, projected to ``DIMS`` latent dimensions found by singular
value decomposition on a bounded sample of labelled rows. The sample's unit vectors (at most ``SAMPLE`` x ``DIMS``
floats, 2 MB) are broadcast; every document's cosine to all of them is one blocked matrix product, and the
``NEIGHBOURS`` nearest vote with weight cosine ** ``POWER``. Scoring is a map over the documents: no shuffle.

Defined results: null or empty text has no terms and gets the share of label 1 in the sample; without a usable
sample every score is 1, so that nothing is rejected on no evidence; ties among neighbours are resolved by sample order; repeated rows
are scored alike; an empty table gives an empty result; extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weatherlake.llm.common import map_columns, stored
from weatherlake.llm.labelled import sample
from weatherlake.llm.perplexity import base_counts

SAMPLE, DIMS, NEIGHBOURS, POWER, TERMS = 8192, 48, 25, 8, 2048
#: Character classes told apart; everything else is one class, as are small letters, capitals and digits.
MARKS = "\n .,!?;:'\"()-#*$%&|<>@/_=+[]{}\\"
SHAPES = len(MARKS) + 4
EXTRA = 5


@lru_cache(1)
def shapes() -> np.ndarray:
    out = np.zeros(0x110000, np.uint8)
    for point in range(0x30000):
        c = chr(point)
        out[point] = 1 if c.islower() else 2 if c.isupper() else 3 if c.isdigit() else 0
    for i, c in enumerate(MARKS):
        out[ord(c)] = 4 + i
    return out


def terms(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Term numbers and weights (log of one plus the frequency per thousand)."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    x = np.concatenate([np.zeros(2, np.int32), shapes()[points].astype(np.int32)])
    keys, n = np.unique((x[:-2] * SHAPES + x[1:-1]) * SHAPES + x[2:], return_counts=True)
    words = text.lower().split()
    n_words, _, _, dup_lines, repeated = base_counts(text)
    same = sum(a == b for a, b in zip(words, words[1:]))
    lines = max(1, text.count("\n") + 1)
    share = [same / max(1, n_words), repeated / max(1, n_words), dup_lines / lines, len(set(words)) / max(1, len(words)), min(1.0, n_words / 50)]
    weight = np.concatenate([n * (1000.0 / max(1, len(points))), 1000.0 * np.array(share)])
    keys = np.concatenate([keys, SHAPES**3 + np.arange(EXTRA)])
    return keys[weight > 0], np.log1p(weight[weight > 0])


class Neighbours:
    """The fitted model: term columns, weights, projection, labelled unit vectors."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray, int]]):
        """``rows``: term numbers, their weights and the label of each labelled text."""
        self.prior = float(np.mean([y for _, _, y in rows])) if rows else 1.0
        found = [((k, w), y) for k, w, y in rows if len(k)]
        self.labels = np.array([y for _, y in found], np.float32)
        df = np.zeros(SHAPES**3 + EXTRA, np.int64)
        for (k, _), _ in found:
            df[k] += 1
        self.ready = len(found) >= 2 and len(set(self.labels.tolist())) == 2
        if not self.ready:
            return
        used = np.argsort(-df, kind="stable")[:TERMS]
        used = np.sort(used[df[used] > 0])
        self.column = np.full(len(df), -1, np.int32)
        self.column[used] = np.arange(len(used))
        self.idf = (np.log((1 + len(found)) / (1 + df[used])) + 1).astype(np.float32)
        x = np.zeros((len(found), len(used)), np.float32)
        for i, (t, _) in enumerate(found):
            x[i] = self.row(*t)
        values, vectors = np.linalg.eigh((x.T @ x).astype(np.float64))
        self.axes = vectors[:, np.argsort(-values)[:DIMS]].astype(np.float32)
        self.known = self.unit(x @ self.axes)

    def row(self, keys: np.ndarray, weight: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.idf), np.float32)
        at = self.column[keys]
        out[at[at >= 0]] = weight[at >= 0]
        out *= self.idf
        return out / max(float(np.linalg.norm(out)), 1e-9)

    @staticmethod
    def unit(z: np.ndarray) -> np.ndarray:
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)

    def scores(self, texts: list[str]) -> np.ndarray:
        out = np.full(len(texts), self.prior)
        full = [i for i, t in enumerate(texts) if t]
        if not self.ready:
            return np.ones(len(texts))
        if not full:
            return out
        z = self.unit(np.stack([self.row(*terms(texts[i])) for i in full]) @ self.axes)
        cosine = z @ self.known.T
        k = min(NEIGHBOURS, cosine.shape[1])
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosine, near, 1).astype(np.float64), 1e-3) ** POWER
        out[full] = (weight * self.labels[near]).sum(1) / weight.sum(1)
        return np.clip(out, 0.0, 1.0)


def term_lists(texts: list) -> list[list[bytes]]:
    found = [terms(t or "") for t in texts]
    return [[k.astype(np.int64).tobytes() for k, _ in found], [w.astype(np.float64).tobytes() for _, w in found]]


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE) -> Neighbours:
    """Learn from a bounded sample of at most ``rows`` labelled texts. Texts stay on the executors; the driver gets
    each one's term numbers and weights, at most one per term (``SHAPES`` ** 3 + ``EXTRA``) however long the text."""
    picked = sample(docs, labels, label, rows)
    lists = map_columns(picked, ["text"], [("keys", "binary"), ("weights", "binary")], lambda: term_lists)
    lists = stored(lists.select("doc_id", "keys", "weights", "y"), "quality-terms", rows)
    found = lists.orderBy(F.xxhash64("doc_id"), "doc_id", "keys", "weights").toLocalIterator()
    return Neighbours([(np.frombuffer(r["keys"], np.int64), np.frombuffer(r["weights"], np.float64), r["y"]) for r in found])


def score(docs: DataFrame, model: Neighbours, out_col: str = "score", block: int = 256) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make() -> Callable:
        model = shared.value

        def f(texts: list) -> list:
            parts = [model.scores([t or "" for t in texts[i : i + block]]) for i in range(0, len(texts), block)]
            return [np.concatenate(parts)]

        return f

    return map_columns(docs, ["text"], [(out_col, "double")], make)


def drop_rejected(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The documents that score at least ``threshold``, with all their columns."""
    model = fit(docs, labels)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), "text")
    return score(whole, model).filter(F.col("score") >= threshold).select("_doc.*")
