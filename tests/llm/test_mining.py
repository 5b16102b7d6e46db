"""Phrases, repeated strings and clusters against brute force, on odd rows and on the smallest tables."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weatherlake.llm import centroids, phrases, queries, suffix_dedup
from weatherlake.llm.common import stored, table

DIR = "/root/testdata/sf0.001"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string"
EXTRA = {"block": 7, "part": 1, "words": 2, "phrase": "p", "n": 4, "data": "d", "k": 6, "a": True}
SAID = "the quick brown fox jumps over the lazy dog. "
SOME = [
    (1, SAID * 4, "en", "a"),
    (2, SAID * 4, "en", "a"),
    (2, SAID * 4, "en", "a"),
    (None, "The Quick brown\tfox; a b a b a b a b", None, None),
    (3, None, None, "b"),
    (4, "", "de", None),
    (5, " \n\t ", "en", "a"),
    (6, "a b c a b c a b c", "en", "a"),
    (7, "ab" * 300, "en", "b"),
    (8, "Größe ändert nichts, Größe ändert alles. " * 5, "de", "b"),
    (9, "x" * 90_000 + SAID + "y" * 10, "en", "b"),
    (10, "lead " + SAID * 3 + "tail", "en", "b"),
    (11, " ".join(f"w{i % 50} v{i % 3}" for i in range(20_000)), "fr", "b"),
]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(SOME, SCHEMA)
    return stored(df.withColumns({k: F.lit(v) for k, v in EXTRA.items()}).repartition(3), "odd")


@pytest.fixture(scope="module")
def none(odd):
    return stored(odd.limit(0), "none")


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, DIR, "documents")


def brute_phrases(rows, sizes, threshold, inside, top):
    counts = defaultdict(Counter)
    for r in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (r.text or "").translate(FOLD)):
            w = re.findall(r"[^\x20\x09]+", piece)
            for n in range(1, sizes + 1):
                counts["und" if r.lang is None else r.lang].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, f in counts.items():
        total = sum(c for g, c in f.items() if len(g) == 1)
        candidates = {g: c for g, c in f.items() if len(g) > 1 and c >= threshold}
        held = {}
        for g, a in candidates.items():
            around = [c for h, c in candidates.items() if len(h) > len(g) and any(h[i : i + len(g)] == g for i in range(len(h) - len(g) + 1))]
            if not any(100 * c >= inside * a for c in around):
                held[g] = min((1000000 * a * a // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g)))
        order = sorted(held, key=lambda g: (-held[g][0], -f[g], " ".join(g).encode()))
        for rank, g in enumerate(order[:top], 1):
            score, k = held[g]
            out.append((lang, rank, " ".join(g), f[g], f[g[:k]], f[g[k:]], total, score))
    return sorted(out)


@pytest.mark.parametrize("sizes,threshold,inside,top", [(3, 3, 50, 2000), (4, 2, 80, 5), (2, 5, 50, 10)])
@pytest.mark.parametrize("which", ["odd", "none"])
def test_phrases(which, sizes, threshold, inside, top, request):
    df = request.getfixturevalue(which)
    got = sorted(map(tuple, phrases.mine(df, sizes, threshold, inside, top).collect()))
    assert got == brute_phrases(df.select("text", "lang").collect(), sizes, threshold, inside, top)


def test_phrases_of_documents(docs):
    got = sorted(map(tuple, phrases.mine(docs).collect()))
    assert got and got == brute_phrases(docs.select("text", "lang").collect(), 3, 10, 50, 2000)


@given(st.lists(st.lists(st.tuples(st.sampled_from([b"a", b"b", b"c", b"d", b"e", b"f", b"g"]), st.integers(1, 9)), max_size=9), max_size=6), st.integers(1, 12))
@settings(max_examples=200, deadline=None)
def test_every_frequent_ngram_survives(runs, threshold):
    total = Counter()
    for run in runs:
        for g, n in run:
            total[g] += n
    mass = sum(total.values())
    held = phrases.MisraGries(mass // threshold + 1)
    for run in runs:
        held.add([g for g, _ in run], [n for _, n in run])
        held.shrink()
        assert len(held.counters) <= held.capacity
    assert held.taken * (held.capacity + 1) <= mass and held.taken < threshold
    for g, n in total.items():
        assert held.counters.get(g, 0) <= n <= held.counters.get(g, 0) + held.taken
    assert {g for g, n in total.items() if n >= threshold} <= set(held.may_reach(threshold))


def test_long_vocabularies_and_runs(monkeypatch):
    numbers = np.array([5, 7, 5, 7, 0, 5, 7, 5])
    for bits in (4, 30):
        rows, n = phrases.ngrams(numbers, 3, bits)
        assert {tuple(r): c for r, c in zip(rows.tolist(), n.tolist())} == {(5, 7, 5): 2, (7, 5, 7): 1}
    text = b"one two three. four five\nsix seven " + b"long" * 40 + b" piece, end"
    for most in (3, 8, 20, 1000):
        pieces = b"|".join(phrases.cut_text(text, most))
        assert re.split(rb"[.,\n|]", pieces) == re.split(rb"[.,\n]", text)


def brute_repeats(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        covered = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                covered[i : i + length] = b"\1" * length
        runs = [(m.start(), m.end()) for m in re.finditer(rb"\x01+", bytes(covered))]
        out.append((len(t), runs, bytes(c for c, m in zip(t, covered) if not m)))
    return out


def repeats(df, length, **how):
    got = suffix_dedup.find_repeats(df, length, **how).collect()
    return Counter((r.doc_id, r.n_bytes, tuple((s.start, s.stop) for s in r.spans), bytes(r.kept)) for r in got)


@pytest.mark.parametrize("length", [5, 40, 400])
@pytest.mark.parametrize("which", ["odd", "none"])
def test_repeats(which, length, request):
    df = request.getfixturevalue(which)
    rows = df.select("doc_id", "text").collect()
    want = brute_repeats([(r.text or "").encode() for r in rows], length)
    assert repeats(df, length) == Counter((r.doc_id, n, tuple(s), k) for r, (n, s, k) in zip(rows, want))


def test_repeats_over_small_blocks_and_ranges(spark, monkeypatch):
    """Passages of every kind of overlap, cut by blocks, ranges and buckets."""
    draw = random.Random(3)
    letters = "abcdefghij "
    passages = ["".join(draw.choices(letters, k=n)) for n in (39, 40, 41, 60, 200, 700)]
    texts = []
    for _ in range(60):
        parts = [draw.choice(passages)[draw.randrange(0, 30) :] if draw.random() < 0.6 else "".join(draw.choices(letters, k=draw.randrange(80))) for _ in range(5)]
        texts.append("".join(parts))
    texts += [passages[-1]] * 30 + ["ab" * 200, "ab" * 90 + "c"]
    for name, value in {"RANGE": 500, "BUCKET": 64, "RANGES": 5}.items():
        monkeypatch.setattr(suffix_dedup, name, value)
    df = stored(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), "passages")
    rows = df.collect()
    want = brute_repeats([r.text.encode() for r in rows], 40)
    assert repeats(df, 40, block_bytes=900) == Counter((r.doc_id, n, tuple(s), k) for r, (n, s, k) in zip(rows, want))


def test_chunks_do_not_change_anchors(monkeypatch):
    """Every suffix has the same anchor string whatever the chunk, and equal suffixes have equal ones."""
    draw = random.Random(5)
    texts = ["".join(draw.choices("abc", k=n)).encode() for n in (0, 39, 40, 500, 1300)]
    texts += [texts[3] + b"x" + texts[4][:200], b"ab" * 300]
    data = zstandard.ZstdCompressor().compress(b"\0".join([*texts, b""]))
    seen = []
    for chunk in (64, 97, 1 << 20):
        monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
        text = suffix_dedup.Text([len(t) for t in texts], data, 40)
        found = {}
        for x in text.stretches():
            for first, last, anchor in zip(x.first.tolist(), x.last.tolist(), x.anchor.tolist()):
                found |= dict.fromkeys(range(first, last + 1), anchor)
        seen.append(found)
    assert seen[0] == seen[1] == seen[2] and sorted(seen[0]) == np.flatnonzero(text.valid).tolist()
    by = defaultdict(set)
    for place, anchor in seen[0].items():
        by[text.raw[place : place + 40]].add(anchor)
    assert all(len(a) == 1 for a in by.values())


@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 3), st.integers(0, 2**64 - 1)), max_size=80))
def test_multikey_order(rows):
    tokens = [np.array([r[i] for r in rows], np.uint64) for i in range(3)]
    order = suffix_dedup.multikey_order(tokens, small=2)
    assert sorted(order.tolist()) == list(range(len(rows)))
    assert [rows[i] for i in order] == sorted(rows)


def test_repeats_query(spark, docs):
    texts = [(r.text or "").encode() for r in docs.collect()]
    want = Counter((n, sum(b - a for a, b in s), len(s), hashlib.sha256(k).hexdigest()) for n, s, k in brute_repeats(texts, 400))
    got = queries.QUERIES["op12_suffix_dedup"](spark, DIR).collect()
    assert Counter((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want and any(r.n_removed for r in got)


def brute_clusters(rows, k, rounds, size, scale):
    kept = [(r.vec_id, [math.floor(scale * x) for x in r.embedding]) for r in rows if r.embedding is not None and len(r.embedding) == size and all(x is not None and math.isfinite(x) for x in r.embedding)]
    mark = lambda v: hashlib.sha256(f"1:{'' if v[0] is None else v[0]}".encode()).hexdigest()
    middle = [v for _, v in sorted(kept, key=lambda v: (mark(v), v[1]))[:k]]

    def place(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(middle))

    for _ in range(rounds):
        of = [place(x)[1] for _, x in kept]
        for j in range(len(middle)):
            mine = [x for (_, x), c in zip(kept, of) if c == j]
            if mine:
                middle[j] = [sum(column) // len(mine) for column in zip(*mine)]
    out = [(i, *place(x)[::-1]) for i, x in kept]
    inertia = Counter()
    for _, c, d in out:
        inertia[c] += d
    return Counter((i, c, d, inertia[c], sum(inertia.values()), tuple(middle[c])) for i, c, d in out)


VECTORS = [
    (1, [0.0, 0.0], 1), (2, [0.0, 0.0], 1), (2, [0.0, 0.0], 1), (None, [1.0, 1.0], 0), (3, None, 0), (4, [], 0), (5, [1.0], 0),
    (6, [1.0, None], 0), (7, [float("nan"), 1.0], 0), (8, [float("inf"), 1.0], 0), (9, [-0.4, 3.9], 0), (10, [5.0, -5.0], 0),
    (11, [5.0, -5.0], 1), (12, [1e5, -1e5], 0), (13, [2.5, -2.5], 0), (14, [-2.5, 2.5], 0),
]


@pytest.mark.parametrize("k,rounds", [(1, 2), (3, 0), (4, 3), (16, 3), (40, 3)])
def test_clusters(spark, monkeypatch, k, rounds):
    monkeypatch.setattr(centroids, "BLOCK", 3)
    draw = random.Random(k)
    more = [(100 + i, [draw.gauss(i % 5, 1.0), draw.gauss(-(i % 3), 0.6)], 0) for i in range(200)]
    df = spark.createDataFrame(VECTORS + more, "vec_id long, embedding array<double>, cluster int").repartition(3)
    df = stored(df, "vectors")
    got = centroids.clusters(df, k=k, rounds=rounds, size=2, scale=8).collect()
    assert Counter((*r[:5], tuple(r.centroid)) for r in got) == brute_clusters(df.collect(), k, rounds, 2, 8)
    assert centroids.clusters(df.limit(0), k=k, size=2).collect() == []


def test_bounds_spare_rescans():
    """A round that moves centroids little pops few vectors, and no vector that changes its cluster is missed."""
    draw = np.random.default_rng(1)
    middle = draw.integers(-500, 500, (12, 8))
    x = middle[draw.integers(0, 12, 3000)] + draw.integers(-90, 90, (3000, 8))
    drift = centroids.Drift(x[:12])
    heaps = centroids.Heaps.start(x, drift)
    popped = []
    for _ in range(12):
        sums = centroids.cluster_sums(x, heaps.cluster, 12)
        drift = drift.move(np.where(sums[:, -1:] > 0, sums[:, :-1] // np.maximum(sums[:, -1:], 1), drift.centroids))
        heaps = centroids.Heaps.read([None, *heaps.row([], np.zeros(0, np.int64))[1:]], 8)
        popped.append(len(heaps.round(drift)))
        assert (heaps.cluster == centroids.distances(x, drift.centroids).argmin(1)).all()
    assert popped[-1] < len(x) / 10 and max(popped) > 0


def test_large_components_are_refused(spark):
    df = spark.createDataFrame([(1, [1e9, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too large"):
        centroids.clusters(df, k=1, size=2).collect()


@pytest.mark.parametrize("name", ["op11_phrase_collocations", "op13_centroid_clusters"])
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    cur = con.execute(queries.SQL[name])
    columns = [c[0] for c in cur.description]
    got = queries.QUERIES[name](spark, DIR)
    assert sorted(got.columns) == sorted(columns)
    assert Counter(map(tuple, got.select(*columns).collect())) == Counter(cur.fetchall())
