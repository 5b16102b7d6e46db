"""Jaccard self-join on word n-grams with rare-first prefix filtering; components of the links.

Sets. A text's set holds the 64-bit hashes of its distinct five-word shingles. Texts with the same set form a
class, found by a 128-bit digest; only one text of a class goes through the join.

Order. Shingles are ordered by an estimate of their document frequency, then by hash. The estimate is a table of
2 ** ``SKETCH`` counters (16 MB, whatever the corpus), summed over the partitions and broadcast; any consistent
order is right, a good one makes the lists of the prefixes short.

Join. Two sets that link share at least one of the n - ceil(0.75 n) + 1 first shingles of either. Each partition
sends the prefixes of its distinct sets by hash range. In a list of up to ``HOT`` sets all pairs pass
the length filter (sizes within 0.75) and the positional filter (what the positions leave room for) and are
counted; over all ranges this gives the number of shared prefix shingles of every pair. The suffix filter then
drops pairs whose shared prefix plus the longer suffix can't reach the needed overlap. A list of more than
``HOT`` sets gives a chain of neighbours only, and all sets chained to each other count as candidates of one
another, so no list grows with the square of its length and no pair is lost.

Verification. Candidate groups are components of surviving pairs and chains; every linked pair lies inside one.
Groups are checked by exact intersection counts (matrix products over the shared shingles). A group of more than
``SIDE`` sets is cut into blocks and every pair of blocks is a task of its own, so each pair of sets is checked
once, and by one task of bounded size. A task returns one edge per set, not its pairs.

Defined results: null or empty text has no shingles and links with nothing, not even its own kind; a text of one
to four words has one shingle, its whole word sequence; repeated rows are copies of each other; null ids take
part and have the smallest id of their group, or null; an empty table gives an empty result; extra columns are
ignored or, in ``drop_similar``, kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weatherlake.llm.common import ROW, attached, body, keep_rows, numbered, stored
from weatherlake.llm.components import components
from weatherlake.llm.ngram_lm import deltas, joined, pack, squeeze, expand, unpack, word_hash, words_of

WORDS = 5
PERCENT = 75
SKETCH, CHUNKS = 22, 64
HOT = 32
SIDE = 1024
RANGE_BYTES = 16 << 20
POSTINGS = 2_000_000


def shingles(texts: list[str]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    number: dict[bytes, int] = {}
    rows = [[number.setdefault(w, len(number)) for w in words_of(t)] for t in texts]
    hashes = word_hash(list(number))
    out = []
    for r in rows:
        if not r:
            out.append(np.zeros(0, np.uint64))
            continue
        h = hashes[np.array(r)]
        n = min(len(h), WORDS)
        key = np.full(len(h) - n + 1, n, np.uint64)
        for i in range(n):
            key = joined(key, h[i : len(h) - n + 1 + i])
        out.append(np.unique(key))
    return out


def set_digest(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def class_number(digest: bytes) -> int:
    """The 64-bit name of a class in candidate lists; names that clash only add candidates."""
    return int.from_bytes(digest[:8], "little", signed=True)


def needed(a, b):
    """Smallest overlap that links sets of the given sizes."""
    return -(-PERCENT * (a + b) // (100 + PERCENT))


def prefix(n):
    return n - -(-PERCENT * n // 100) + 1


def batches_of(texts: list[str], size: int = 512) -> Iterator[tuple[int, list[np.ndarray]]]:
    for i in range(0, len(texts), size):
        yield i, shingles([t or "" for t in texts[i : i + size]])


def read_sets(docs: DataFrame) -> DataFrame:
    """Stored rows: (row, doc_id, n, digest, class) per numbered document, (chunk, counts) of the frequency sketch per partition."""
    rows = docs.select(ROW, F.col("doc_id").cast("long"), body().alias("text"))
    cells = 1 << SKETCH

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [ROW, "doc_id", "n", "digest", "class", "chunk", "counts"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.binary()]
        sketch, waiting, size, seen = np.zeros(cells, np.int64), [], 0, set()
        for b in batches:
            texts = b.column(2).to_pylist()
            for i, sets in batches_of(texts):
                digests = [set_digest(s) if len(s) else None for s in sets]
                for s, d in zip(sets, digests):
                    if d is not None and d not in seen:
                        seen.add(d)
                        waiting.append((s & np.uint64(cells - 1)).astype(np.int64))
                        size += len(s)
                if size >= 1 << 20:
                    sketch += np.bincount(np.concatenate(waiting), minlength=cells)
                    waiting, size = [], 0
                k = len(sets)
                columns = [
                    b.column(0).slice(i, k),
                    b.column(1).slice(i, k),
                    pa.array([len(s) for s in sets], kinds[2]),
                    pa.array(digests, kinds[3]),
                    pa.array([None if d is None else class_number(d) for d in digests], kinds[4]),
                    pa.nulls(k, kinds[5]),
                    pa.nulls(k, kinds[6]),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)
        if waiting:
            sketch += np.bincount(np.concatenate(waiting), minlength=cells)
        if sketch.any():
            parts = [squeeze(p) for p in sketch.astype(np.uint32).reshape(CHUNKS, -1)]
            columns = [*(pa.nulls(CHUNKS, k) for k in kinds[:5]), pa.array(range(CHUNKS), kinds[5]), pa.array(parts, kinds[6])]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return stored(rows.mapInArrow(run, f"{ROW} long, doc_id long, n long, digest binary, class long, chunk int, counts binary"), "join-sets")


def frequencies(read: DataFrame) -> np.ndarray:
    """The summed sketch; its size does not depend on the corpus."""

    def add(t: pa.Table) -> pa.Table:
        total = sum(expand(c, np.uint32).astype(np.uint64) for c in t.column("counts").to_pylist())
        return pa.table({"chunk": pa.array([t.column("chunk")[0].as_py()], pa.int32()), "counts": pa.array([np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes()])})

    rows = read.filter("chunk is not null").select("chunk", "counts").groupBy("chunk").applyInArrow(add, "chunk int, counts binary").collect()
    out = np.zeros((CHUNKS, (1 << SKETCH) // CHUNKS), np.uint32)
    for r in rows:
        out[r["chunk"]] = np.frombuffer(r["counts"], np.uint32)
    return out.ravel()


def send_prefixes(docs: DataFrame, sketch: np.ndarray, ranges: int) -> DataFrame:
    """(part, body): prefix shingles of the distinct sets of a partition, by hash range."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch)
    mask = np.uint64((1 << SKETCH) - 1)

    def out(grams: list[np.ndarray], sizes: list[int], classes: list[int]) -> pa.RecordBatch:
        owner = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams])
        key = np.concatenate(grams)
        order = np.argsort(key, kind="stable")
        key, owner, place = key[order], owner[order], place[order]
        home = ((key >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
        cut = np.searchsorted(home, np.arange(ranges + 1, dtype=np.uint64))
        n, c = np.array(sizes, np.uint32), np.array(classes, np.int64)
        parts, bodies = [], []
        for r in range(ranges):
            i, j = int(cut[r]), int(cut[r + 1])
            if j > i:
                used, at = np.unique(owner[i:j], return_inverse=True)
                parts.append(r)
                bodies.append(pack(deltas(key[i:j]), at.astype(np.uint32), place[i:j].astype(np.uint32), n[used], c[used]))
        return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(bodies, pa.binary())], names=["part", "body"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq = shared.value
        seen: set[bytes] = set()
        grams, sizes, classes, waiting = [], [], [], 0
        for b in batches:
            for _, sets in batches_of(b.column(0).to_pylist()):
                for s in sets:
                    if not len(s) or (d := set_digest(s)) in seen:
                        continue
                    seen.add(d)
                    order = np.lexsort((s, freq[(s & mask).astype(np.int64)]))
                    grams.append(s[order[: prefix(len(s))]])
                    sizes.append(len(s))
                    classes.append(class_number(d))
                    waiting += len(grams[-1])
                if waiting >= POSTINGS:
                    yield out(grams, sizes, classes)
                    grams, sizes, classes, waiting = [], [], [], 0
        if grams:
            yield out(grams, sizes, classes)

    return docs.select(body().alias("text")).mapInArrow(run, "part int, body binary")


def match(table: pa.Table, hot_size: int = HOT) -> pa.Table:
    """Candidates of one hash range: counted pairs of short lists, neighbours of long ones."""
    got = [unpack(x, np.uint64, np.uint32, np.uint32, np.uint32, np.int64) for x in table.column("body").to_pylist()]
    key = np.concatenate([np.cumsum(g[0], dtype=np.uint64) for g in got])
    place = np.concatenate([g[2] for g in got]).astype(np.int64)
    size = np.concatenate([g[3][g[1]] for g in got]).astype(np.int64)
    name = np.concatenate([g[4][g[1]] for g in got])
    order = np.lexsort((name, key))
    key, place, size, name = key[order], place[order], size[order], name[order]
    once = np.ones(len(key), bool)  # copies of a set come from several partitions
    once[1:] = (key[1:] != key[:-1]) | (name[1:] != name[:-1])
    key, place, size, name = key[once], place[once], size[once], name[once]
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    length = np.diff(np.append(begin, len(key)))
    first, second = [], []
    for gap in range(1, hot_size):
        at = begin[(length > gap) & (length <= hot_size)]
        most = length[(length > gap) & (length <= hot_size)] - gap
        i = np.repeat(at, most) + (np.arange(most.sum()) - np.repeat(np.cumsum(most) - most, most))
        a, b = size[i], size[i + gap]
        fits = 100 * np.minimum(a, b) >= PERCENT * np.maximum(a, b)
        room = np.minimum(place[i], place[i + gap]) + 1 + np.minimum(a - place[i], b - place[i + gap]) - 1
        keep = i[fits & (room >= needed(a, b))]
        first.append(keep)
        second.append(keep + gap)
    i, j = np.concatenate(first), np.concatenate(second)
    pair, at, shared = np.unique(np.stack([name[i], name[j]], 1), axis=0, return_index=True, return_counts=True) if len(i) else (np.zeros((0, 2), np.int64), i, i)
    hot = np.repeat(length > hot_size, length)
    inside = hot[1:] & (key[1:] == key[:-1])
    # neighbours in name order: the same few pairs in all lists of a group
    chain = np.unique(np.stack([name[:-1][inside], name[1:][inside]], 1), axis=0)
    some, none = pa.array(np.concatenate([pair, chain])[:, 0]), np.zeros(len(chain), np.int64)
    return pa.table(
        {
            "a": some,
            "b": pa.array(np.concatenate([pair, chain])[:, 1]),
            "na": pa.array(np.concatenate([size[i][at], none])),
            "nb": pa.array(np.concatenate([size[j][at], none])),
            "shared": pa.array(np.concatenate([shared.astype(np.int64), none])),
            "chained": pa.array(np.concatenate([np.zeros(len(pair), bool), np.ones(len(chain), bool)])),
        }
    )


def suffix_filter(pairs: DataFrame) -> DataFrame:
    """Pairs that may still link: shared prefix shingles plus all of the longer suffix reach the needed overlap."""
    rest = lambda n: F.ceil(n * PERCENT / 100) - 1
    enough = F.ceil((F.col("na") + F.col("nb")) * PERCENT / (100 + PERCENT))
    total = pairs.groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.max("na").alias("na"), F.max("nb").alias("nb"), F.max("chained").alias("chained"))
    return total.filter(F.col("chained") | (F.col("shared") + F.greatest(rest(F.col("na")), rest(F.col("nb"))) >= enough)).select("a", "b")


def overlaps(left: list[np.ndarray], right: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Intersection sizes of all left sets with all right sets, through the shingles that both sides have."""
    sides = []
    for sets in (left, right):
        sides.append((np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])))
    common = np.intersect1d(sides[0][0], sides[1][0])
    if left is right:
        values, n = np.unique(sides[0][0], return_counts=True)
        common = values[n > 1]
    places = []
    for grams, row in sides:
        at = np.searchsorted(common, grams)
        ok = (at < len(common)) & (common[np.minimum(at, len(common) - 1)] == grams) if len(common) else np.zeros(len(grams), bool)
        order = np.argsort(at[ok], kind="stable")
        places.append((at[ok][order], row[ok][order]))
    out = np.zeros((len(left), len(right)), np.float32)
    for c in range(0, len(common), columns):
        blocks = []
        for (at, row), n in zip(places, (len(left), len(right))):
            i, j = np.searchsorted(at, [c, c + columns])
            m = np.zeros((n, min(columns, len(common) - c)), np.float32)
            m[row[i:j], at[i:j] - c] = 1
            blocks.append(m)
        out += blocks[0] @ blocks[1].T
    return out.astype(np.int64)


def links(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    a, b = np.array([len(s) for s in left])[:, None], np.array([len(s) for s in right])[None, :]
    found = (100 + PERCENT) * overlaps(left, right) >= PERCENT * (a + b)
    if left is right:
        if len(left):
            np.fill_diagonal(found, False)
    return found


def verify(table: pa.Table) -> pa.Table:
    """Check the groups of a task: one edge per linked set, and what each set is linked with."""
    group, side, rows, copies = (table.column(c).to_pylist() for c in ("grp", "side", ROW, "copies"))
    sets = [s for _, part in batches_of(table.column("text").to_pylist()) for s in part]
    members: dict[int, list[int]] = {}
    for i, g in enumerate(group):
        members.setdefault(g, []).append(i)
    rows, copies, sides = np.array(rows), np.array(copies), np.array(side)
    out: list[np.ndarray] = []
    for at in members.values():
        at = np.array(at)
        left = at[sides[at] <= 0]
        right = left if (sides[at] < 0).any() or not (sides[at] > 0).any() else at[sides[at] > 0]
        a = [sets[i] for i in left]
        found = links(a, a if right is left else [sets[i] for i in right])
        for x, y, f in ((left, right, found),) if right is left else ((left, right, found), (right, left, found.T)):
            has = np.flatnonzero(f.any(1))
            if len(has):
                near = y[f[has].argmax(1)]
                out.append(np.stack([rows[x[has]], rows[near], f[has] @ copies[y]], 1))
        forest = spanning(left, right, found)
        if len(forest):
            out.append(np.stack([rows[forest[:, 0]], rows[forest[:, 1]], np.zeros(len(forest), np.int64)], 1))
    x = np.concatenate(out) if out else np.zeros((0, 3), np.int64)
    return pa.table({"a": pa.array(x[:, 0]), "b": pa.array(x[:, 1]), "linked": pa.array(x[:, 2])})


def spanning(left: np.ndarray, right: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Edges (member, smallest member of its component) of the bipartite or square link matrix."""
    nodes = np.concatenate([left, right])
    n = len(left)
    label = np.arange(len(nodes))
    if right is left:
        label[n:] = label[:n]
    while True:
        before = label.copy()
        big = len(nodes)
        rows = np.where(found, label[None, n:], big).min(1, initial=big)
        label[:n] = np.minimum(label[:n], rows)
        columns = np.where(found, label[:n, None], big).min(0, initial=big)
        label[n:] = np.minimum(label[n:], columns)
        if right is left:
            label[:n] = label[n:] = np.minimum(label[:n], label[n:])
        label = label[label]
        if (label == before).all():
            break
    at = np.flatnonzero(nodes[label] != nodes)
    return np.stack([nodes[at], nodes[label[at]]], 1)


def similar(docs: DataFrame, hot_size: int = HOT, block_sets: int = SIDE) -> DataFrame:
    """(_row, doc_id, n_shingles, component_id, n_links, component) of every document."""
    return similar_rows(numbered(docs.select("doc_id", "text")), hot_size, block_sets)


def similar_rows(rows: DataFrame, hot_size: int = HOT, block_sets: int = SIDE) -> DataFrame:
    """``similar`` of stored numbered rows; every pass over the texts reads the same numbers."""
    docs = rows.select(ROW, "_doc.doc_id", "_doc.text")
    size, n_docs = docs.agg(F.sum(F.octet_length(body())), F.count("*")).first()
    ranges = max(32, -(-(size or 0) // RANGE_BYTES))
    read = read_sets(docs)
    sets = read.filter("chunk is null").select(ROW, "doc_id", "n", "digest", "class")
    prefixes = send_prefixes(docs, frequencies(read), ranges)
    candidates = suffix_filter(prefixes.groupBy("part").applyInArrow(lambda t: match(t, hot_size), "a long, b long, na long, nb long, shared long, chained boolean"))
    grouped = components(candidates)
    # one text of every class that has a candidate
    classes = sets.filter("n > 0").groupBy("digest", "class").agg(F.min(ROW).alias(ROW), F.count("*").alias("copies"), F.min("doc_id").alias("first_id"))
    classes = stored(classes, "join-classes", n_docs)
    members = classes.join(grouped.withColumnRenamed("node", "class"), "class").select(ROW, "copies", F.col("root").alias("grp"))
    members = stored(members, "join-members", n_docs)
    blocks = members.groupBy("grp").agg(F.ceil(F.count("*") / block_sets).alias("blocks"))
    tasks = max(32, -(-members.count() // 512))
    spread = members.join(blocks, "grp").withColumn("mine", F.pmod(F.xxhash64(ROW), F.col("blocks")))
    # block x meets every block y: the task (min, max), where it is the left (0) or the right (1) side, or both (-1)
    spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    low, high = F.least("mine", "other"), F.greatest("mine", "other")
    spread = spread.select(
        ROW,
        "copies",
        F.xxhash64("grp", low, high).alias("grp"),
        F.when(low == high, -1).when(F.col("mine") == low, 0).otherwise(1).alias("side"),
        F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("grp"), F.lit(tasks))).otherwise(F.xxhash64("grp", low, high)).alias("task"),
    )
    # only the texts of members move, and once
    texts = attached(rows.select(ROW, "block", body("_doc.text").alias("text")), spread).select(ROW, "text", F.explode("_values").alias("_at"))
    checked = stored(
        texts.select("_at.task", "_at.grp", "_at.side", ROW, "_at.copies", "text").groupBy("task").applyInArrow(verify, "a long, b long, linked long"),
        "join-links",
    )
    linked = checked.groupBy(F.col("a").alias(ROW)).agg(F.sum("linked").alias("linked"))
    roots = components(checked.select("a", "b"), checked.count()).select(F.col("node").alias(ROW), "root")
    found = classes.join(roots, ROW, "left").join(linked, ROW, "left").withColumn("root", F.coalesce("root", ROW))
    found = stored(found.select("digest", "class", "first_id", "root", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"), ROW), "join-found", n_docs)
    best = F.min(F.struct(F.col("first_id").isNull().alias("none"), F.col("first_id").alias("id"), F.col(ROW).alias("row")))
    smallest = found.groupBy("root").agg(best.alias("best"))
    answer = found.join(smallest, "root").select("digest", F.col("best.id").alias("component_id"), "n_links", F.col("root").alias("component"))
    alone = sets.filter("n = 0").select(ROW, "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"), F.col(ROW).alias("component"))
    rest = sets.filter("n > 0").join(answer, "digest").select(ROW, "doc_id", F.col("n").alias("n_shingles"), "component_id", "n_links", "component")
    return rest.unionByName(alone)


def drop_similar(docs: DataFrame) -> DataFrame:
    """The documents with one of each component left, the one with the smallest id, with all their columns."""
    rows = numbered(docs)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", ROW)).alias("first")
    kept = similar_rows(rows).groupBy("component").agg(first).select(F.col(f"first.{ROW}").alias(ROW))
    return keep_rows(rows, kept)
