"""Mixture-controlled packing by deficit round-robin.

Every source is a queue of documents in input order. A window takes tokens from the queues so that each source
keeps its share of the stream: a window adds share * tokens to every deficit, sources are served in turn when
their deficit reaches ``quantum`` tokens, and what is not served is carried on. The target shares are the
sources' shares of all tokens, so all queues run dry together and no document is left out or repeated.

To run in parallel, the queues are cut at equal fractions into groups of about ``group_windows`` windows. Prefix
sums over the groups give each group its first position in the packed stream and what every source has been
served before it, and hence the exact deficits to start from; a window may be shared by two groups. Only the
very last sequence is padded.

Documents are tokenized once into a shared table (16-bit ids where the vocabulary allows). The schedule is made
from lengths alone and joined back to the ids by row, so the ids are shuffled once.

Defined results: null text is empty (one piece, the end id); a null source is the queue ``""``; repeated rows are
packed as often as they occur; an empty table gives no pieces; extra columns are ignored.
"""

from __future__ import annotations

import json
import math
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weatherlake.llm.bpe import SHORT, byte_letters, loaded, read_file
from weatherlake.llm.common import ROW, body, stored, sums_before, with_row

END_ID = 1
#: The letters that stand for the space byte and the line end in byte-level vocabularies.
SPACE, LINE = "\u0120", "\u010a"
#: Marks that a unit may end in, the letters before them that every Unicode version has, and units in a cache's half.
MARKS, LATIN, HELD = ".,;:!?#*$%&|<>\"()[]{}-_/=+@~", "\u0250", 350_000
#: Stretches of letters below ``LATIN``, each behind a space or line end.
WORDS = re.compile("(?:[ \\n][A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)+")
#: First bytes of white space, and of some other letters.
BLANKS = np.isin(np.arange(256), [*range(9, 14), *range(28, 33), 0xC2, 0xE1, 0xE2, 0xE3])
#: Bytes of text and rows that are cut at once, and stretches that the library is asked at once.
TEXT_BYTES, TEXT_ROWS, ASKED = 4 << 20, 8192, 16384
#: Rows of which pieces are made at once.
CUT_ROWS = 512
PIECES = "doc_id long, source string, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class UnitTokenizer:
    """Ids by the tokenizers library, with a cache of the stretches between single spaces or line ends.

    In vocabularies with the usual byte-level split pattern, a space or line end before a character that is no white
    space starts a token, and no other token starts with it. So the texts of a batch are cut there at once, each
    distinct stretch is looked up once, the unknown ones are encoded in one call and cut apart at the tokens that start
    with a space or line end. A text with other spacing or with added tokens, and any text of another kind of
    vocabulary, is encoded as a whole.

    The pattern also cuts between a letter and the marks behind it, so a stretch is looked up without the marks it
    ends in. Stretches of letters only need no pattern: they go to the same model already cut and spelled in its
    letters. The cache has two halves: a full one becomes the older one, from which stretches that are met again are
    taken over.
    """

    def __init__(self, source: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(source)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        spec = json.loads(source)
        split = spec.get("pre_tokenizer") or {}
        vocab = self.tokenizer.get_vocab()
        usual = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space", True)
        self.cuts = usual and not spec.get("normalizer") and LINE in vocab and not any(c in t for t in self.added for c in " \n")
        self.words = Tokenizer.from_str(json.dumps(spec | {"pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}))
        self.letters = {b: letter for letter, b in byte_letters().items()}
        self.kind = np.uint16 if max(vocab.values()) < 1 << 16 else np.uint32
        self.opens = np.zeros(max(vocab.values()) + 1, bool)
        self.opens[[i for t, i in vocab.items() if t.startswith(SPACE) or t == LINE]] = True
        self.line = np.array([vocab.get(LINE, 0)], self.kind).tobytes()
        self.units: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.tails: dict[bytes, bytes] = {}

    def ids(self, tokenizer, text: str) -> np.ndarray:
        return np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)

    def whole(self, text: str) -> np.ndarray:
        """Ids of a text without added tokens."""
        if self.cuts and WORDS.fullmatch(text):
            spelled = text.encode().decode("latin-1").translate(self.letters)
            return self.ids(self.words, spelled.replace(SPACE, " " + SPACE).replace(LINE, f" {LINE} "))
        return self.ids(self.tokenizer, text)

    def tail(self, marks: bytes) -> bytes:
        found = self.tails.get(marks)
        if found is None:
            found = self.whole(marks.decode()).tobytes()
            if len(marks) <= SHORT and len(self.tails) < HELD:
                self.tails[marks] = found
        return found

    def learn(self, stems: list[str], known: list[bytes | None], missing: list[int]) -> None:
        """Fill in the ids of the missing stretches."""
        fresh: list[list[str]] = [[], []]
        places: list[list[int]] = [[], []]
        for i in missing:
            stem = stems[i]
            x = known[i] = self.older.get(stem)
            if x is None:
                stem = stem if stem[0] == "\n" else " " + stem
                kind = WORDS.fullmatch(stem) is None
                fresh[kind].append(stem)
                places[kind].append(i)
            else:
                self.units[stem] = x
        for kind, s in ((k, s) for k in (0, 1) for s in range(0, len(fresh[k]), ASKED)):
            ids = self.whole("".join(fresh[kind][s : s + ASKED]))
            raw, width = ids.tobytes(), ids.itemsize
            cuts = [*(np.flatnonzero(self.opens[ids]) * width).tolist(), len(raw)]
            for i, a, b in zip(places[kind][s : s + ASKED], cuts[:-1], cuts[1:], strict=True):
                x = known[i] = raw[a:b]
                if len(stems[i]) <= SHORT:
                    self.units[stems[i]] = x
        if len(self.units) > HELD:
            self.older, self.units = self.units, {}

    def encode_all(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text (none is null)."""
        if not self.cuts:
            return [self.ids(self.tokenizer, t).tobytes() for t in texts.to_pylist()]
        # every text begins with a line end, which leaves its ids again, and a line end begins its stretch
        empty, line = pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string())
        lined = pc.binary_join_element_wise(empty, pc.replace_substring(texts.cast(pa.large_string()), "\n", " \n"), line)
        cut = pc.split_pattern(lined, " ")
        borders, stretches = cut.offsets.to_numpy(), cut.flatten().dictionary_encode()
        at, names = stretches.indices.to_numpy(), stretches.dictionary
        ends, raw = np.frombuffer(names.buffers()[1], np.int64)[: len(names) + 1], names.buffers()[2].to_pybytes()
        del lined, cut

        # texts to be encoded as a whole: a stretch begins with white space, but for the first, which may be empty
        lead = np.frombuffer(raw + b" ", np.uint8)[ends[:-1]]
        check = np.flatnonzero((np.diff(ends) == 0) | BLANKS[lead])
        odd, bare = np.zeros(len(names), bool), np.zeros(len(names), bool)
        for i, u in zip(check.tolist(), names.take(pa.array(check)).to_pylist()):
            bare[i] = u == "\n"
            odd[i] = not u.removeprefix("\n") or u.removeprefix("\n")[0].isspace()
        odd_at = odd[at]
        odd_at[borders[:-1]] &= ~bare[at[borders[:-1]]]
        apart = np.logical_or.reduceat(odd_at, borders[:-1])
        for t in self.added:
            apart |= pc.match_substring(texts, t).to_numpy(zero_copy_only=False)
        needed = np.zeros(len(names), bool)
        needed[at[~np.repeat(apart, np.diff(borders))]] = True

        # stretches without the marks behind a letter
        bodies = pc.utf8_rtrim(names, MARKS)
        marks = np.diff(ends) - pc.binary_length(bodies).to_numpy()
        last = pc.utf8_slice_codeunits(bodies, -1).dictionary_encode()
        letter = np.array([c != "" and c < LATIN and c.isalpha() for c in last.dictionary.to_pylist()], bool)
        parted = (marks > 0) & letter[last.indices.to_numpy()]
        tails = np.full(len(names), b"", object)
        tails[parted] = [self.tail(raw[b - n : b]) for b, n in zip(ends[1:][parted].tolist(), marks[parted].tolist())]
        bodies = pc.if_else(pa.array(parted), bodies, names).dictionary_encode()
        of, stems = bodies.indices.to_numpy(), bodies.dictionary.to_numpy(zero_copy_only=False).tolist()

        known = list(map(self.units.get, stems))
        wanted = np.zeros(len(stems), bool)
        wanted[of[needed & ~bare]] = True
        self.learn(stems, known, [i for i, (x, w) in enumerate(zip(known, wanted.tolist())) if x is None and w])
        for i in of[bare]:
            known[i] = self.line
        coded = pa.array([x or b"" for x in known], pa.large_binary()).take(bodies.indices)
        coded = pc.binary_join_element_wise(coded, pa.array(tails, pa.large_binary()), pa.scalar(b"", pa.large_binary()))
        found = coded.take(stretches.indices)
        ends, raw = np.frombuffer(found.buffers()[1], np.int64)[borders].tolist(), memoryview(found.buffers()[2] or b"")
        width = len(self.line)
        ids = [bytes(raw[a + width : b]) for a, b in zip(ends, ends[1:])]
        for i in np.flatnonzero(apart).tolist():
            ids[i] = self.ids(self.tokenizer, texts[i].as_py()).tobytes()
        return ids

    def encode(self, text: str) -> bytes:
        return self.encode_all(pa.array([text]))[0]


def text_batches(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The rows in slices of about ``TEXT_BYTES`` of text."""
    for b in batches:
        before = np.cumsum(pc.binary_length(b.column(column)).to_numpy(zero_copy_only=False), dtype=np.int64) // TEXT_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(before)) + 1).tolist(), b.num_rows]
        for s, e in zip(cuts, cuts[1:]):
            for r in range(s, e, TEXT_ROWS):
                yield b.slice(r, min(TEXT_ROWS, e - r))


def token_rows(docs: DataFrame, path: str, text_col: str, source_col: str) -> DataFrame:
    """Stored rows (row, part, id, source, earlier tokens of the source in the part, length, ids)."""
    source = docs.sparkSession.sparkContext.broadcast(read_file(path))
    queue = F.coalesce(F.col(source_col).cast("string"), F.lit("")) if source_col in docs.columns else F.lit("")
    rows = with_row(docs).select(ROW, F.spark_partition_id().alias("part"), F.col("doc_id").cast("long"), queue.alias("source"), body(text_col).alias("_t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = loaded(UnitTokenizer, source.value)
        end = np.array([END_ID], tok.kind).tobytes()
        seen: dict[str, int] = {}
        for x in text_batches(batches, 4):
            ids = [coded + end for coded in tok.encode_all(x.column(4))]
            before, size = [], [len(coded) // len(end) for coded in ids]
            for q, n in zip(x.column(3).to_pylist(), size):
                before.append(seen.get(q, 0))
                seen[q] = before[-1] + n
            cols = [*x.columns[:4], pa.array(before, pa.int64()), pa.array(size, pa.int64()), pa.array(ids, pa.large_binary())]
            yield pa.RecordBatch.from_arrays(cols, names=[ROW, "part", "doc_id", "source", "cum", "n", "ids"])

    out = rows.mapInArrow(run, f"{ROW} long, part int, doc_id long, source string, cum long, n long, ids binary")
    return stored(out, "pack-tokens")


def serve(rows: pd.DataFrame, queues: pd.DataFrame, size: int, quantum: int) -> pd.DataFrame:
    """Deficit round-robin over one group: pieces (row, start, length, at)."""
    queues = queues.sort_values("source")
    names = queues["source"].tolist()
    share, deficit = queues["share"].tolist(), queues["deficit"].tolist()
    rows = rows.sort_values(["source", "pos"])
    by = {q: (r[ROW].tolist(), r["n"].tolist(), r["skip"].tolist()) for q, r in rows.groupby("source", sort=False)}
    docs = [by.get(q, ([], [], [])) for q in names]
    rest = [sum(d[1]) for d in docs]
    head, inside = [0] * len(names), [0] * len(names)
    at, left, turn, count = int(queues["first"].iloc[0]), sum(rest), 0, len(names)
    out: list[tuple[int, int, int, int]] = []
    while left:
        w = min(size - at % size, left)
        for s in range(count):
            deficit[s] += share[s] * w
        left -= w
        while w:
            for k in range(count):
                s = (turn + k) % count
                if rest[s] and deficit[s] >= min(quantum, rest[s]):
                    take = min(w, rest[s], int(deficit[s]))
                    break
            else:
                s = max((i for i in range(count) if rest[i]), key=deficit.__getitem__)
                take = min(w, rest[s], quantum)
            turn = s + 1
            deficit[s] -= take
            rest[s] -= take
            w -= take
            ids, n, skip = docs[s]
            while take:
                h, start = head[s], inside[s]
                part = min(take, n[h] - start)
                out.append((ids[h], skip[h] + start, part, at))
                at += part
                take -= part
                if start + part == n[h]:
                    head[s], inside[s] = h + 1, 0
                else:
                    inside[s] = start + part
    return pd.DataFrame(out, columns=[ROW, "start", "length", "at"])


def pack(
    docs: DataFrame,
    path: str,
    size: int = 2048,
    quantum: int = 256,
    group_windows: int = 128,
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """Pieces of all documents: doc_id, source, start, length, ids (unsigned 32-bit), doc_tokens, sequence_id, offset."""
    tokens = token_rows(docs, path, text_col, source_col)
    per_part = tokens.groupBy("source", "part").agg(F.sum("n").alias("m"))
    per_source = per_part.groupBy("source").agg(F.sum("m").alias("source_tokens"))
    everything = per_source.agg(F.sum("source_tokens")).first()[0] or 0
    groups = max(1, math.ceil(everything / (size * group_windows)))
    starts = sums_before(per_part, ["source"], "part", ["m"]).join(per_source, "source").drop("m")
    lines = tokens.select(ROW, "source", "part", "cum", "n").join(starts, ["source", "part"])
    # token y of a source belongs to group y * groups div source_tokens; documents over a border are cut there
    group_of = lambda y: F.expr(f"cast({y} as decimal(19,0)) * {groups} div source_tokens")
    cut = (
        lines.withColumn("a", F.col("m_before") + F.col("cum"))
        .withColumn("b", F.col("a") + F.col("n"))
        .withColumn("grp", F.explode(F.sequence(group_of("a"), group_of("b - 1"))))
        .withColumn("lo", F.expr(f"(cast(grp as decimal(19,0)) * source_tokens + {groups - 1}) div {groups}"))
        .withColumn("hi", F.expr(f"(cast(grp + 1 as decimal(19,0)) * source_tokens + {groups - 1}) div {groups}"))
        .withColumn("pos", F.greatest("a", "lo"))
    )
    placed = cut.select(
        ROW, "source", "grp", "pos", (F.least("b", "hi") - F.col("pos")).alias("n"), (F.col("pos") - F.col("a")).alias("skip"), "source_tokens"
    )
    placed = stored(placed, "pack-rows")
    taken = placed.groupBy("grp", "source").agg(F.sum("n").alias("taken"), F.max("source_tokens").alias("source_tokens"))
    firsts = sums_before(taken.groupBy("grp").agg(F.sum("taken").alias("m")), [], "grp", ["m"]).select("grp", F.col("m_before").alias("first"))
    queues = (
        sums_before(taken, ["source"], "grp", ["taken"])
        .join(firsts, "grp")
        .withColumn("share", F.col("source_tokens") / F.lit(float(max(everything, 1))))
        .select("grp", "source", "first", "share", (F.col("share") * F.col("first") - F.col("taken_before")).alias("deficit"))
    )
    queues = stored(queues, "pack-queues")
    schedule = (
        placed.select("grp", ROW, "source", "pos", "n", "skip")
        .groupBy("grp")
        .cogroup(queues.groupBy("grp"))
        .applyInPandas(lambda r, q: serve(r, q, size, quantum), f"{ROW} long, start long, length long, at long")
    )
    per_doc = schedule.groupBy(ROW).agg(F.collect_list(F.struct("start", "length", "at")).alias("cuts"))
    wide = per_doc.join(tokens.select(ROW, "doc_id", "source", "n", "ids"), ROW)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [p.split(" ")[0] for p in PIECES.split(", ")]
        for whole in batches:
            for s in range(0, whole.num_rows, CUT_ROWS):
                b = whole.slice(s, CUT_ROWS)
                n, cuts, raw = b.column("n").to_numpy(), b.column("cuts"), b"".join(b.column("ids").to_pylist())
                ids = np.frombuffer(raw, np.uint16 if len(raw) == 2 * n.sum() else np.uint32).astype("<u4")
                doc = np.repeat(np.arange(b.num_rows), cuts.value_lengths().to_numpy())
                start, length, at = (x.to_numpy() for x in cuts.flatten().flatten())
                # the pieces of a document are all of its ids, so in their order they lie one behind the other
                place = (np.cumsum(n) - n)[doc] + start
                order = np.argsort(place)
                doc, start, length, at = doc[order], start[order], length[order], at[order]
                ends = np.append(place[order], len(ids)) * 4
                body = pa.Array.from_buffers(pa.large_binary(), len(order), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(ids)])
                of = pa.array(doc)
                values = [b.column("doc_id").take(of), b.column("source").take(of), pa.array(start), pa.array(length), body]
                values += [b.column("n").take(of), pa.array(at // size), pa.array(at % size)]
                yield pa.RecordBatch.from_arrays(values, names=names)

    return wide.mapInArrow(pieces, PIECES)
