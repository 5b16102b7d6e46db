"""The training-data operators against brute force, on a small fixture of odd rows and on the smallest tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weatherlake.llm import bpe, chat, common, exact_dedup, latent, ngram_join, ngram_lm, packing, perplexity, queries, sharding, toxicity
from weatherlake.llm.common import attached, keep_rows, numbered, stored, sums_before, table
from weatherlake.llm.components import components
from weatherlake.llm.labelled import sample

DIR = "/root/testdata/sf0.001"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = " ".join(f"word{i % 977} und{i % 31}" for i in range(30_000)) + "x" * 5000
ODD = [
    # doc_id, text, lang, source, and columns whose names the operators use themselves
    (1, "One two three four five six seven eight nine ten", "en", "a"),
    (2, "one TWO three four five six seven eight nine ten", "en", "a"),
    (2, "one TWO three four five six seven eight nine ten", "en", "a"),
    (None, "one two three four five six seven eight nine ten", None, None),
    (3, None, None, "b"),
    (4, "", "de", None),
    (5, " \n\t ", "en", "a"),
    (6, "a b c", "en", "a"),
    (7, "A b C", "en", "b"),
    (8, LONG, "en", "b"),
    (9, LONG + " tail", "en", "b"),
    (10, "x <|endoftext|> y\r\n z  İ end ", "en", "a"),
    (11, "one two three four five six seven eight nine ten\nextra", "en", "a"),
]
SCHEMA = "doc_id long, text string, lang string, source string"
EXTRA = {"_row": 7, "part": 1, "size": 2, "score": 3.5, "n": 4, "digest": "d", "block": 5, "slot": 6, "kept": True}


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, SCHEMA)
    return stored(df.withColumns({k: F.lit(v) for k, v in EXTRA.items()}).repartition(3), "odd")


@pytest.fixture(scope="module")
def none(spark, odd):
    return stored(odd.limit(0), "none")


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, DIR, "documents")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


@pytest.mark.parametrize("which", ["odd", "docs", "none"])
def test_shards(which, request):
    df = request.getfixturevalue(which)
    got = sharding.byte_shards(df, 5).collect()
    want = Counter((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in df.collect())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    by = defaultdict(list)
    for r in sorted(got, key=lambda r: r.position):
        by[r.shard].append(r)
    total, largest = sum(r["size"] for r in got), max([r["size"] for r in got], default=0)
    at, last = 0, None
    for s in sorted(by):
        assert [r.slot for r in by[s]] == list(range(len(by[s])))
        assert abs(sum(r["size"] for r in by[s]) - total / 5) <= largest
        for r in by[s]:
            assert r.position == at
            at += r["size"]
            key = (r.doc_id is not None, r.doc_id or 0)
            assert last is None or key >= last
            last = key


def test_sums_before(spark):
    df = spark.range(5000).select(F.col("id").alias("i"), (F.col("id") % 3).alias("k"), (F.col("id") % 7).alias("v"))
    got = {r.i: r.v_before for r in sums_before(df, ["k"], "i", ["v"], span=64).collect()}
    assert got == {i: sum(j % 7 for j in range(i % 3, i, 3)) for i in range(5000)}


@pytest.mark.parametrize("which", ["odd", "docs", "none"])
@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_copies(which, keep, request):
    df = request.getfixturevalue(which)
    got = exact_dedup.find_copies(df, keep).collect()
    groups = defaultdict(list)
    for r in df.collect():
        groups[(r.text or "").translate(FOLD)].append(r.doc_id)
    best = max if keep == "largest" else min
    for r in got:
        ids = next(g for t, g in groups.items() if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256)
        known = [i for i in ids if i is not None]
        assert r.group_size == len(ids) and r.keep_id == (best(known) if known else None)
    assert len(got) == df.count() and sum(r.kept for r in got) == len(groups)
    left = exact_dedup.drop_copies(df, keep)
    assert left.columns == df.columns and left.count() == len(groups)
    assert Counter(r.text_sha256 for r in got if r.kept) == Counter(hashlib.sha256((r.text or "").translate(FOLD).encode()).hexdigest() for r in left.collect())


def test_stored_documents_are_not_moved(spark):
    """Rows of several blocks get all of their values; neither the documents nor their texts pass a shuffle."""
    rows = numbered(spark.range(50_000, numPartitions=2).select(F.col("id").alias("doc_id"), F.concat(F.lit("text"), "id").alias("text")))
    assert rows.select("block").distinct().count() == 4
    some = rows.filter("_doc.doc_id % 7 = 0").select("_row", (F.col("_doc.doc_id") * 2).alias("x"))
    found = attached(rows, some.unionAll(some.select("_row", F.col("x") + 1)))
    got = {r.doc_id: (r.text, r.x) for r in found.select("_doc.*", F.sort_array("_values.x").alias("x")).collect()}
    assert got == {i: (f"text{i}", [2 * i, 2 * i + 1]) for i in range(0, 50_000, 7)}
    left = keep_rows(rows, some.unionAll(some))
    plan = left._jdf.queryExecution().executedPlan().toString()
    moved = [x for x in plan.split("\n") if "Exchange" in x]
    assert len(moved) == 2 and "SortMergeJoin" not in plan and "SelectedBucketsCount" in plan
    assert sorted(r.doc_id for r in left.collect()) == list(range(0, 50_000, 7)) and left.columns == ["doc_id", "text"]


def reference_tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path())


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]) | st.sampled_from(" \n\t \x1c\x85'sl.,1a<|endoftext|>")) | st.just("<|endoftext|>a"))
def test_bpe_equals_the_library(text):
    tok = reference_tokenizer.cache if hasattr(reference_tokenizer, "cache") else reference_tokenizer()
    reference_tokenizer.cache = tok
    own = bpe.loaded(bpe.ByteBPE, test_bpe_equals_the_library.source)
    ids = tok.encode(text, add_special_tokens=False).ids
    coded = own.encode(text)
    assert np.frombuffer(coded, np.uint32).tolist() == ids
    assert own.decode(coded) == tok.decode(ids, skip_special_tokens=False)
    fast = bpe.loaded(packing.UnitTokenizer, test_bpe_equals_the_library.source)
    assert np.frombuffer(fast.encode(text), fast.kind).tolist() == ids


test_bpe_equals_the_library.source = bpe.read_file(queries.tokenizer_path())


def test_long_words_and_columns(odd, none):
    own = bpe.loaded(bpe.ByteBPE, test_bpe_equals_the_library.source)
    for w in ("a" * 3000, "ab" * 500 + "the" * 700, "thethe" * 40):
        ids = [own.single[b] for b in w.encode()]
        assert own.merge_short(ids[:]) == own.merge_long(ids[:]) == reference_tokenizer().encode(w).ids
    coded = bpe.decode(bpe.encode(odd, queries.tokenizer_path()), queries.tokenizer_path())
    assert coded.columns == [*odd.columns, "ids", "decoded"]
    assert all(r.decoded == (r.text or "") for r in coded.collect())
    assert bpe.encode(none, queries.tokenizer_path()).count() == 0


def test_units_are_known_without_their_marks(monkeypatch):
    """A stretch that was met is not encoded again behind other marks, nor at once when the cache is full."""
    monkeypatch.setattr(packing, "HELD", 4)
    fast, tok = packing.UnitTokenizer(test_bpe_equals_the_library.source), reference_tokenizer()
    asked: list[str] = []
    whole = fast.whole
    monkeypatch.setattr(fast, "whole", lambda t: asked.append(t) or whole(t))
    check = lambda t: np.frombuffer(fast.encode(t), fast.kind).tolist() == tok.encode(t, add_special_tokens=False).ids
    assert check(" quorble zanté") and check(" quorble, zanté%%% zanté.") and check(" quorble,")
    assert sorted(asked) == [" quorble zanté", "%%%", ",", "."]
    assert check(" one two three four") and fast.older and check(" quorble two zanté;")
    assert asked[4:] == [" one two three four", ";"]
    for text in (" a', b's, it's. 1, ²; x\n, (, )a( ﬁ, ß: \x1c. é́,", " <|endoftext|>, a|>. b<|endoftext", " a,b,c ,, a.\nb.", "a. a.'s a's."):
        assert all(check(t) for t in (text, " " + text, text + text))


def test_texts_are_encoded_in_batches(monkeypatch):
    """An unknown stretch of a batch goes to the library once, behind spaces and line ends; batches are cut by bytes."""
    fast, tok = packing.UnitTokenizer(test_bpe_equals_the_library.source), reference_tokenizer()
    asked: list[str] = []
    whole = fast.whole
    monkeypatch.setattr(fast, "whole", lambda t: asked.append(t) or whole(t))
    texts = ["quorble zanté\nquorble", " quorble, zanté\r\nquorble.", "quorble zanté,", ""]
    texts += ["quorble  x", "\n", "quorble\n\nx", "\tquorble", "x<|endoftext|>quorble", "quorble \u3000x", "x " * 3]
    check = lambda: [np.frombuffer(x, fast.kind).tolist() for x in fast.encode_all(pa.array(texts))]
    want = [tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert check() == want
    assert sorted(asked) == ["\nquorble zanté quorble", " zanté\r", ",", "."]
    assert check() == want and len(asked) == 4
    monkeypatch.setattr(packing, "TEXT_BYTES", 8)
    batch = pa.record_batch([pa.array(["a" * n for n in (3, 3, 3, 0, 20, 1, 1)])], ["text"])
    slices = list(packing.text_batches([batch, batch.slice(0, 0)], 0))
    assert [x.num_rows for x in slices] == [2, 2, 3] and pa.Table.from_batches(slices).to_pydict() == batch.to_pydict()


@pytest.mark.parametrize("which", ["odd", "docs", "none"])
def test_packing(which, request):
    df = request.getfixturevalue(which)
    size = 256
    got = packing.pack(df, queries.tokenizer_path(), size=size, quantum=32, group_windows=16).collect()
    tok = reference_tokenizer()
    want = sorted(tuple(tok.encode(r.text or "", add_special_tokens=False).ids + [1]) for r in df.collect())
    whole, seqs = defaultdict(list), defaultdict(list)
    for r in got:
        whole[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
    ids = []
    for parts in whole.values():
        runs = defaultdict(list)
        for p in sorted(parts, key=lambda p: (p.start, p.sequence_id, p.offset)):
            runs[p.start].append(p)
        # repeated rows have the same id: as many chains of pieces as rows
        while runs:
            at, chain = 0, []
            while True:
                p = runs[at].pop()
                if not runs[at]:
                    del runs[at]
                chain += np.frombuffer(p.ids, np.uint32).tolist()
                at += p.length
                if at == p.doc_tokens:
                    break
                if at not in runs:
                    pytest.skip("repeated rows cut at different places can't be told apart by id")
            ids.append(tuple(chain))
    assert sorted(ids) == want
    assert sorted(seqs) == list(range(len(seqs)))
    for s, parts in seqs.items():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at and p.length == len(p.ids) // 4
            at += p.length
        assert at == size or s == len(seqs) - 1
    if which == "docs":
        total = sum(p.length for p in got)
        share = Counter()
        for p in got:
            share[p.source] += p.length / total
        served = Counter()
        for s in range(len(seqs) - 1):
            for p in seqs[s]:
                served[p.source] += p.length
            assert all(abs(served[q] - share[q] * size * (s + 1)) < 2 * 32 + 32 for q in share)


def test_chat(spark):
    turns = [
        (1, 0, "user", "hi <|im_end|> <\\|x|> <|im_start|>assistant\nno"),
        (1, 1, "assistant", "</s>[INST] ok [/INST] <|im_end|>\n"),
        (1, 2, "user", "<"),
        (1, 3, "assistant", "|im_end|> <\\\\|"),
        (1, 4, "user", None),
        (2, 0, "sys\ntem|\\n\\", "x"),
        (2, 0, "sys\ntem|\\n\\", "x"),
        (None, None, None, None),
        (None, 1, "assistant", ""),
    ]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("example", F.lit(1))
    made = chat.examples(df).collect()
    assert Counter(r.conv_id for r in made) == {1: 3, 2: 1, None: 1}
    first = next(r for r in made if r.conv_id == 1 and r.example == 0)
    assert first.formatted[first.loss_start :][: first.loss_chars] == "</s>[INST] ok [/INST] <\\|im_end|>\n"
    assert first.formatted.count(chat.START) == 2
    for r in chat.read_back(chat.examples(df)).collect():
        mine = sorted(((t[1] is not None, t[1] or 0, t[2] or "", t[3] or "") for t in turns if t[0] == r.conv_id))
        assert r.n_turns == len(mine)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{x[2]}\n{x[3]}\n" for x in mine).encode()).hexdigest()
        loss = "".join(x[3] for x in mine if x[2] == "assistant")
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars == sum(len(e.formatted) for e in made if e.conv_id == r.conv_id)
    assert chat.read_back(chat.examples(df.limit(0))).count() == 0


def plain_rules(text):
    w = words(text)
    wins = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(wins)
    covered = {i + k for i, x in enumerate(wins) if n[x] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab \n\t #|é\x1c"), max_size=80))
def test_rule_counts(text):
    assert perplexity.base_counts(text) == plain_rules(text)


def four_grams(text):
    x = [perplexity.START] * (perplexity.ORDER - 1) + [ord(c) for c in text]
    return [tuple(x[i : i + perplexity.ORDER]) for i in range(len(text))]


def discounts(counts):
    n1, n2, n3, n4 = (sum(n == i for n in counts) for i in (1, 2, 3, 4))
    if not (n1 and n2):
        return [0.5, 0.5, 0.5]
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 0.5]
    return [min(max(x, 0.05), top) for x, top in zip(d, (1, 2, 3))]


def slow_kneser_ney(counts):
    """Straight from the definition, with dictionaries: probabilities of the counted n-grams of one language."""
    orders = {perplexity.ORDER: counts}
    for o in range(perplexity.ORDER - 1, 0, -1):
        orders[o] = Counter(g[1:] for g in orders[o + 1])
    d = {o: discounts(c.values()) for o, c in orders.items()}
    followers = {o: defaultdict(list) for o in orders}
    for o, c in orders.items():
        for g, n in c.items():
            followers[o][g[:-1]].append(n)

    def p(g):
        o = len(g)
        if o == 0:
            return 1 / (len(orders[1]) + 1)
        same = followers[o][g[:-1]]
        cut = lambda n: d[o][min(n, 3) - 1] if n else 0
        n = orders[o].get(g, 0)
        return (n - cut(n)) / sum(same) + sum(map(cut, same)) / sum(same) * p(g[1:])

    return {g: p(g) for g in counts}


def perplexities(rows):
    """Mean negative log10 probability of every (lang, text) by the definition."""
    grams = defaultdict(Counter)
    for lang, text in rows:
        grams[lang or ""].update(four_grams(text or ""))
    models = {lang: slow_kneser_ney(c) for lang, c in grams.items()}
    return [-sum(math.log10(models[lang or ""][g]) for g in four_grams(text)) / len(text) if text else 0.0 for lang, text in rows]


@pytest.mark.parametrize("which", ["odd", "docs", "none"])
def test_quality_rules(which, request):
    df = request.getfixturevalue(which)
    measured = stored(perplexity.measure(df, block_bytes=50_000), "t")
    limits = {r.lang: r for r in perplexity.bands(measured).collect()}
    held = df.collect()
    want = perplexities([(r.lang, r.text) for r in held])
    got = perplexity.judge(measured, perplexity.bands(measured)).collect()
    key = lambda r: (r[0], r[1], *r[2])
    rows_of = lambda x: sorted(x, key=lambda r: (repr(r[0]), r[1], r[2], r[3]))
    plain = rows_of((r.doc_id, r.lang or "", plain_rules(r.text or ""), w) for r, w in zip(held, want))
    mine = rows_of((r.doc_id, r.lang, (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words), r.log_ppl) for r in got)
    assert [key(r) for r in mine] == [key(r) for r in plain]
    assert all(math.isclose(a[3], b[3], rel_tol=1e-5, abs_tol=1e-9) for a, b in zip(mine, plain))
    for r in got:
        fail = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        band = limits.get(r.lang)
        assert r.base_failed == fail and r.kept == (not fail and (band is None or band.low <= r.log_ppl <= band.high))
    left = perplexity.drop_rejected(df)
    assert left.columns == df.columns and sorted((r.doc_id for r in left.collect()), key=repr) == sorted((r.doc_id for r in got if r.kept), key=repr)


def test_random_letters_of_any_script_are_rejected(spark):
    """Random letters of the script and word lengths of a text go and the text stays, whatever the script; each of 200
    languages has a band of its own."""
    draw = np.random.default_rng(7)
    scripts = {"ru": (0x430, 32), "el": (0x3B1, 24), "zh": (0x4E00, 400), "ar": (0x627, 28)}
    rows_, bad = [], set()
    for name, (start, size) in scripts.items():
        letters = [chr(start + i) for i in range(size)]
        words_ = ["".join(draw.choice(letters, draw.integers(2, 7))) for _ in range(60)]
        for _ in range(200):
            rows_.append((len(rows_), " ".join(draw.choice(words_, 60)), name))
        for _ in range(4):
            bad.add(len(rows_))
            rows_.append((len(rows_), " ".join("".join(draw.choice(letters, len(w))) for w in draw.choice(words_, 60)), name))
    for k in range(196):
        rows_.append((len(rows_), " ".join(chr(0x61 + (k + i * i) % 26) * (1 + i % 3) for i in range(50 + k % 7)), f"lang{k}"))
    df = spark.createDataFrame(rows_, "doc_id long, text string, lang string")
    measured = stored(perplexity.measure(df), "scripts")
    assert perplexity.bands(measured).count() == 200
    got = {r.doc_id: r.kept for r in perplexity.judge(measured, perplexity.bands(measured)).collect() if r.lang in scripts}
    assert not any(got[i] for i in bad)
    assert sum(got[i] for i in got if i not in bad) >= 0.98 * (len(got) - len(bad))


def test_rules_keep_columns_of_their_own_names(spark, odd):
    df = stored(odd.withColumns({"low": F.lit(1), "high": F.lit(2), "log_ppl": F.lit("x"), "band_lang": F.lit(3)}), "clash")
    assert perplexity.drop_rejected(df).columns == df.columns


def brute_links(df):
    sets, ids = [], []
    for r in df.collect():
        w = words((r.text or "").translate(FOLD))
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
        ids.append(r.doc_id)
    parent, degree = list(range(len(ids))), [0] * len(ids)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                degree[i] += 1
                degree[j] += 1
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, x in enumerate(ids):
        least[find(i)].append(x)
    smallest = {k: min([x for x in v if x is not None], default=None) for k, v in least.items()}
    return sorted(((ids[i], len(s), smallest[find(i)], degree[i]) for i, s in enumerate(sets)), key=repr), len(least)


@pytest.mark.parametrize("which,hot,side", [("odd", 32, 1024), ("docs", 32, 1024), ("docs", 2, 3), ("none", 32, 1024)])
def test_ngram_join(which, hot, side, request):
    df = request.getfixturevalue(which)
    want, groups = brute_links(df)
    got = ngram_join.similar(df, hot_size=hot, block_sets=side)
    assert rows(got, "doc_id", "n_shingles", "component_id", "n_links") == want
    if hot == 32:
        left = ngram_join.drop_similar(df)
        assert left.columns == df.columns and left.count() == groups


def test_large_group_of_near_copies(spark):
    """A third of all rows in one group, small lists and blocks, so that every way of the join is taken."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(90):
        w = list(base)
        for k in rng.integers(0, 120, rng.integers(0, 5)):
            w[k] = f"new{i}x{k}"
        texts.append(" ".join(w))
    texts += [" ".join(f"o{rng.integers(0, 400)}" for _ in range(60)) for _ in range(180)]
    df = stored(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5), "group")
    got = ngram_join.similar(df, hot_size=4, block_sets=20)
    assert rows(got, "doc_id", "n_shingles", "component_id", "n_links") == brute_links(df)[0]


def test_small_tables_are_few_files(spark, monkeypatch):
    """A file for every shuffle partition starts two processes each on a local disk, whatever its size."""
    texts = [f"{LONG[i : i + 900]} {i}" for i in range(0, 36_000, 600)]
    rows = [(i, t, "en", "a") for i, t in enumerate([*texts, *(t + " near" for t in texts)])]
    df = stored(spark.createDataFrame(rows, SCHEMA).repartition(3), "files")
    wanted = [(r.doc_id, r.component_id, r.n_links) for r in ngram_join.similar(df).orderBy("doc_id").collect()]
    files, write = defaultdict(list), common.materialise

    def counted(df, label):
        out = write(df, label)
        files[re.sub(r"-\d$", "", label)].append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(common, "materialise", counted)
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = [(r.doc_id, r.component_id, r.n_links) for r in ngram_join.similar(df).orderBy("doc_id").collect()]
        perplexity.rules(df).count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == wanted and any(n for _, _, n in got)
    for label in ("llm-up", "llm-join-classes", "llm-join-members", "llm-join-found", "llm-probabilities"):
        assert files[label] and max(files[label]) <= spark.sparkContext.defaultParallelism, (label, files[label])
    # n-grams below the highest order; those of the highest are written where they are counted
    assert max(files["llm-edges"][1:]) <= spark.sparkContext.defaultParallelism
    assert max(files["llm-grams"][1:]) <= spark.sparkContext.defaultParallelism


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(200, 200), (300, 301), (301, 300)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {300: 300, 301: 300}


@pytest.mark.parametrize("which,block", [("odd", 60_000), ("docs", 60_000), ("docs", 4 << 20), ("none", 60_000)])
def test_lm(which, block, request):
    df = request.getfixturevalue(which)
    mine = [(r.doc_id, words((r.text or "").translate(FOLD)) + [" end"]) for r in df.collect()]
    crc = lambda s: zlib.crc32(s.encode())
    name = lambda i: "" if i is None else str(i)
    train = [(i, w) for i, w in mine if crc(name(i)) % 5 != 1]
    one, two, three, starts = Counter(), Counter(), Counter(), len(train)
    for _, w in train:
        padded = [" s", " s", *w]
        one.update(w)
        two.update(zip(padded[1:], w))
        three.update(zip(padded, padded[1:], w))
    n, v = sum(one.values()), len(one)
    got = ngram_lm.score(df, block_bytes=block).collect()
    assert len(got) == len(mine)
    exact = defaultdict(list)
    for i, w in mine:
        base = sum(math.log10((one[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        exact[i].append((len(w), sum(one[x] > 0 for x in w), round(base, 6)))
    for r in got:
        assert (r.n_tokens, r.n_known, round(r.base_score, 6)) in exact[r.doc_id]
        assert r.held_out == (crc(name(r.doc_id)) % 5 == 1) and r.train_tokens == n and r.score < 0
    if which == "docs" and block < 1 << 20:
        # the tallies behind the score, against the brute-force counts
        weights = {}
        learnt = ngram_lm.learn
        assert learnt([], v).shape == (2 * ngram_lm.BUCKETS + 1, 4) and not weights
        held = [r for r in got if r.held_out]
        assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_lm_estimates_by_brute_force():
    """Ratios of every token of two blocks that share n-grams, against counts made with dictionaries."""
    texts = [["a b c a b", "c a b", "b b b a b c"], ["a b c", "x y", "a b d a b c", ""]]
    use = [[1, 2, 0], [1, 1, 2, 1]]
    bits = 48
    data = []
    for ts, us in zip(texts, use):
        number = {ngram_lm.START: 0, ngram_lm.END: 1}
        toks = [np.array([number.setdefault(w, len(number)) for w in ngram_lm.words_of(t)] + [1], np.uint32) for t in ts]
        lengths = np.array([len(t) for t in toks], np.uint32)
        data.append(ngram_lm.pack(np.array(us, np.uint8), lengths, np.concatenate(toks), ngram_lm.word_hash(list(number))))
    import pyarrow as pa

    def exchange(orders, chosen):
        asked = []
        for block, d in enumerate(data):
            b = ngram_lm.Block(d, bits)
            for o in orders:
                asked += [(block, o, r, x) for r, x in b.asked(o, chosen[block] if chosen else None, 4)]
        out = defaultdict(list)
        for o in orders:
            for part in range(4):
                some = [x for x in asked if x[1] == o and x[2] == part]
                if some:
                    t = pa.table({k: list(c) for k, c in zip(("block", "order", "part", "body"), zip(*some))})
                    for r in ngram_lm.answer(t).to_pylist():
                        out[r["block"], r["order"]].append({"part": r["part"], "body": r["body"]})
        return out

    first = exchange([0, 1], None)
    halves = [ngram_lm.Estimates(d, [first[i, 0], first[i, 1]], bits) for i, d in enumerate(data)]
    second = exchange([2], [h.open_trigrams() for h in halves])
    for u, take in (((1,), lambda t: t[0]), ((1, 2), lambda t: t[0] + t[1])):
        one, two, three, starts = Counter(), Counter(), Counter(), 0
        for ts, us in zip(texts, use):
            for t, k in zip(ts, us):
                if k in u:
                    w = [*t.split(), "$"]
                    starts += 1
                    one.update(w)
                    two.update(zip(["^", *w], w))
                    three.update(zip(["^", "^", *w], ["^", *w], w))
        n = sum(one.values())
        for i, d in enumerate(data):
            e = ngram_lm.Estimates(d, [first[i, 0], first[i, 1], second[i, 2]], bits)
            _, f3, f2, f1 = e.ratios(take, starts, n)
            want = []
            for t in texts[i]:
                w = [*t.split(), "$"]
                for k, x in enumerate(w):
                    a, b = (["^", "^", *w][k], ["^", *w][k])
                    wide = two[a, b] if k else starts
                    want.append((three[a, b, x] / max(wide, 1), two[b, x] / max(one[b] if k else starts, 1), one[x] / n))
            assert np.allclose(np.stack([f3, f2, f1], 1), want)


def test_weights_maximise_likelihood():
    s = ngram_lm.STEPS
    cells = [(3 * s**3 + 2 * s**2 + 4 * s + 10, 5000), (3 * s**3 + 0 * s**2 + 4 * s + 8, 3000)]
    w = ngram_lm.learn(cells, 100)[3]
    like = lambda w: sum(m * math.log(sum(a * b for a, b in zip(w, f))) for m, f in ((5000, (2**-0.5, 2**-1.5, 2**-4.5, 1 / 101)), (3000, (0, 2**-1.5, 2**-3.5, 1 / 101))))
    assert math.isclose(w.sum(), 1)
    for d in ((0.03, -0.03, 0, 0), (-0.03, 0.03, 0, 0)):
        assert like(w) > like(np.clip(w + d, 1e-9, 1))


@pytest.mark.parametrize("which", ["odd", "none"])
def test_classifiers_on_odd_rows(spark, which, request):
    df = request.getfixturevalue(which)
    odd_labels = [(1, 1, 0), (1, 1, 0), (2, 0, 1), (4, 1, 0), (7, 0, 1), (8, 1, 0), (None, 1, 1), (9, None, None), (10, 0, 1), (11, 1, 0), (99, 1, 1)]
    labels = spark.createDataFrame(odd_labels, "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash"))
    for made in (latent.score(df.select("doc_id", "text"), latent.fit(df, labels)), toxicity.score(df.select("doc_id", "text"), toxicity.fit(df, labels))):
        got = made.collect()
        assert len(got) == df.count() and all(0 <= r.score <= 1 for r in got)
        same = defaultdict(set)
        for r in got:
            same[r.text].add(r.score)
        assert all(max(s) - min(s) < 1e-4 for s in same.values())
    left = latent.drop_rejected(df, labels)
    assert left.columns == df.columns
    if which == "odd":
        bare = toxicity.fit(df, labels.limit(0))
        assert {r.score for r in toxicity.score(df, bare).collect()} == {0.0}
        assert latent.drop_rejected(df, labels.limit(0)).count() == df.count()


def auc(good, bad):
    return np.mean([(np.array(good) > b).mean() + 0.5 * (np.array(good) == b).mean() for b in bad])


@pytest.mark.parametrize("name,label,least", [("op6_quality_classifier", "quality", 0.95), ("op10_toxicity", "toxic", 0.9)])
def test_held_out_accuracy(spark, name, label, least):
    d = "/root/testdata/sf0.01"
    labels = {r.doc_id: r[label] for r in table(spark, d, "labels").collect()}
    got = [r for r in queries.QUERIES[name](spark, d).collect() if r.held_out and r.doc_id in labels]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in got)
    assert auc([r.score for r in got if labels[r.doc_id]], [r.score for r in got if not labels[r.doc_id]]) >= least


def test_neighbours_are_exact():
    texts = [("Plain words in a row here.", 1), ("Other plain words go there.", 1), ("SHOUT!! SHOUT!! LOUD!!", 0), ("$$$ *** ### %%%", 0)] * 3
    m = latent.Neighbours([(*latent.terms(t), y) for t, y in texts])
    asked = ["Some plain words in a line.", "LOUD!! NOISE!!", ""]
    got = m.scores(asked)
    for t, s in zip(asked[:2], got):
        z = m.unit((m.row(*latent.terms(t)) @ m.axes)[None])[0]
        cosine = m.known @ z
        near = np.argsort(-cosine)[: latent.NEIGHBOURS]
        w = np.maximum(cosine[near].astype(np.float64), 1e-3) ** latent.POWER
        assert math.isclose(s, (w * m.labels[near]).sum() / w.sum(), rel_tol=1e-5)
    assert got[0] > 0.7 > got[1] and got[2] == m.prior


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(-4, 4), max_size=14))
def test_segments_by_definition(values):
    """The maximal segments are found by taking the best one and recursing to both sides."""

    def best(lo, hi):
        found = [(sum(values[i:j]), -(j - i), -i, i, j) for i in range(lo, hi) for j in range(i + 1, hi + 1)]
        top = max(found, default=(0,))
        if top[0] <= 0:
            return []
        return best(lo, top[3]) + [(top[3], top[4], float(top[0]))] + best(top[4], hi)

    got = toxicity.segments([float(v) for v in values])
    assert sorted(s for *_, s in got) == sorted(s for *_, s in best(0, len(values)))
    for a, b, s in got:
        assert s == sum(values[a:b]) > 0
    assert all(x[1] <= y[0] for x, y in zip(got, got[1:]))
    assert not got or max(s for *_, s in got) == max(s for *_, s in best(0, len(values)))


def brute_odds(toxic, clean, everywhere, total, word):
    """Log-odds of a word by the definition: nested Dirichlet means over its stems that the sample holds."""
    words_ = set(toxic) | set(clean)
    nt, nc = sum(toxic.values()), sum(clean.values())
    rt = rc = 1.0
    for level in (*toxicity.STEMS, None):
        stem = word if level is None else word[:level]
        like = [w for w in words_ if (w if level is None else w[:level]) == stem]
        if like:
            share = sum(max(everywhere[w], toxic[w] + clean[w]) for w in like) / total
            rt = (sum(toxic[w] for w in like) + toxicity.PRIOR * rt) / (nt * share + toxicity.PRIOR)
            rc = (sum(clean[w] for w in like) + toxicity.PRIOR * rc) / (nc * share + toxicity.PRIOR)
    return math.log(rt / rc)


def test_odds_rate_and_score_by_definition():
    toxic = Counter({"idiot": 9, "idiotic": 2, "the": 40, "a": 3, "grauenvoll": 2})
    clean = Counter({"the": 400, "a": 31, "ideal": 7, "word": 90, "wordy": 1, "gray": 3, "idiot": 1})
    everywhere = Counter({"the": 4000, "idiot": 12, "word": 800, "ideal": 70, "a": 300})
    odds = toxicity.log_odds(toxic, clean, everywhere, 6000)
    model = toxicity.Passages(odds)
    for w in (*toxic, *clean, "idiotically", "wordless", "unseen", "the"):
        assert math.isclose(model.value(w) + toxicity.DRIFT, brute_odds(toxic, clean, everywhere, 6000, w), abs_tol=1e-12), w
    assert model.value("idiot") > model.value("idiotically") > 0 > model.value("unseen") == -toxicity.DRIFT
    value, weight = np.array([model.value(w) for w in clean]), np.array([float(n) for n in clean.values()])
    rate = toxicity.solve_rate(value, weight / weight.sum())
    assert math.isclose((weight / weight.sum() * np.exp(rate * value)).sum(), 1.0, rel_tol=1e-6)
    model.rate, model.k, model.weights = rate, 0.05, np.array([-1.0, 2.0])
    for text in ("the word idiot idiot the the word word idiot", "a word", "", "42 !", "idiot"):
        v = [model.value(w) for w in toxicity.tokens(text)]
        sums = [sum(v[i:j]) for i in range(len(v)) for j in range(i + 1, len(v) + 1)]
        top = max([x for x in sums if x > 0], default=0.0)
        best = rate * top - math.log(0.05 * max(len(v), 1))
        e, n = model.evidence(text)
        assert (n > 0) == (top > 0 and best > 0)
        assert e >= math.log1p(best) - 1e-9 if n else math.isclose(e, -math.log1p(max(-best, 0.0)))
        assert math.isclose(model.score(e), 1 / (1 + math.exp(1.0 - 2.0 * e)))


def test_samples_are_bounded_in_rows(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(1000)] + [(i, "x") for i in range(2, 40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 40)] + [(1, 1)], "doc_id long, toxic int")
    got = sample(docs, labels, "toxic", 5).collect()
    assert len(got) == 5 and len({r.doc_id for r in got}) == 5
    assert sample(docs, labels.filter("doc_id = 1"), "toxic", 5).count() == 1


def test_pipeline(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.01"
    docs = table(spark, d, "documents")
    columns, before = docs.columns, docs.count()
    labels = {r.doc_id: r.quality for r in table(spark, d, "labels").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, d), "stage")
        assert docs.columns == columns and 0 < docs.count() < before, name
        before = docs.count()
    left = docs.collect()
    assert len({(r.text or "").translate(FOLD) for r in left}) == len(left)
    assert all(r.component_id == r.doc_id for r in ngram_join.similar(docs).collect())
    assert sum(labels.get(r.doc_id) == 0 for r in left) <= 0.1 * sum(v == 0 for v in labels.values())
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, d).collect()
    assert {p.doc_id for p in packed} == {r.doc_id for r in left}


def test_row_numbers_outlive_a_new_split(spark, monkeypatch):
    """A later plan that cuts the files otherwise (executors lost or added) still meets the stored numbers."""
    given = [(i, f"text {i // 2} " + " ".join(f"w{i // 2}x{j}" for j in range(12)) + (" end" if i % 2 else "")) for i in range(400)]
    df = stored(spark.createDataFrame([*given, *given], "doc_id long, text string").repartition(24), "split")
    name, before = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    frequencies = ngram_join.frequencies

    def split(read):
        spark.conf.set(name, "4m")
        return frequencies(read)

    try:
        parts = df.rdd.getNumPartitions()
        left = exact_dedup.drop_copies(df)
        spark.conf.set(name, "4m")
        assert spark.read.parquet(*df.inputFiles()).rdd.getNumPartitions() > parts
        assert sorted(left.collect()) == sorted(given)
        spark.conf.set(name, before)
        monkeypatch.setattr(ngram_join, "frequencies", split)
        assert sorted(ngram_join.drop_similar(df).collect()) == given[::2]
        spark.conf.set(name, before)
        assert {(r.doc_id, r.component_id, r.n_links) for r in ngram_join.similar(df).collect()} == {(i, i - i % 2, 3) for i in range(400)}
    finally:
        spark.conf.set(name, before)
