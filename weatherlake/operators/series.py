"""Time-series features over raw observations (O-TS-01..07, 22): tiled windows, any series length."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from weatherlake.operators.windows import PLACE, POS, RANGE, TILE, left_join, over_tiles, sorted_ranges, trailing
from weatherlake.session import materialise

LAGS = (1, 3, 6, 12, 24, 48, 72, 168)
WINDOWS = (6, 12, 24, 48, 168)
EMA_SPANS = (12, 24, 48)
LENGTH = "_n"
#: Rows that a task computes at once; a tile is never cut, and some batches may be needed to hold one.
ROWS = 1 << 14


# Moments of a frame: values n, mean m, squared deviations q, extremes lo and hi, and for the trend the
# mean position t, its squared deviations u and the co-deviation c. Two adjoining frames merge without
# subtraction, so nothing cancels and a constant frame has exactly q = 0; an empty frame is all zeros, lo is
# NaN and hi minus infinity. As in Spark, NaN exceeds every number.
_NEEDS = {"window": "n m q lo hi", "anomaly": "n m q", "rolling": "n m", "trend": "n m t u c"}
_EMPTY = {"lo": np.nan, "hi": -np.inf}

Frame = dict[str, np.ndarray]
#: Values, and where they are there.
Feature = tuple[np.ndarray, np.ndarray]


def _rows(x: np.ndarray, there: np.ndarray, pos: np.ndarray, fields: Sequence[str]) -> Frame:
    """Frames of one row each; ``x`` and ``there`` hold a line for each variable."""
    zero = np.zeros(x.shape)
    all_fields = {
        "n": there.astype(float),
        "m": np.where(there, x, 0.0),
        "q": zero,
        "lo": np.where(there, x, np.nan),
        "hi": np.where(there, x, -np.inf),
        "t": np.where(there, pos, 0.0),
        "u": zero,
        "c": zero,
    }
    return {f: all_fields[f] for f in fields}


def _merged(a: Frame, b: Frame) -> Frame:
    share = b["n"] / np.maximum(a["n"] + b["n"], 1.0)
    dm = b["m"] - a["m"]
    out = {"n": a["n"] + b["n"], "m": a["m"] + dm * share}
    if "q" in a:
        out["q"] = a["q"] + b["q"] + dm * dm * a["n"] * share
    if "lo" in a:
        out["lo"], out["hi"] = np.fmin(a["lo"], b["lo"]), np.maximum(a["hi"], b["hi"])
    if "t" in a:
        dt = b["t"] - a["t"]
        out["t"] = a["t"] + dt * share
        out["u"] = a["u"] + b["u"] + dt * dt * a["n"] * share
        out["c"] = a["c"] + b["c"] + dm * dt * a["n"] * share
    return out


def _back(frame: Frame, rows: int, place: np.ndarray) -> Frame:
    """The frames that end ``rows`` rows earlier; ``place`` numbers the rows of a tile from 0."""
    out = {}
    for f, a in frame.items():
        out[f] = np.where(place >= rows, np.roll(a, rows, 1), _EMPTY.get(f, 0.0))
    return out


def trailing_frames(rows: Frame, sizes: Sequence[int], place: np.ndarray) -> dict[int, Frame]:
    """The moments of the trailing ``size`` rows for every size.

    Frames of 2, 4, 8, ... rows come from merging a frame with the one just before it; a frame of any
    size is the merge of at most log2(size) of them. A row costs the logarithm of the frame length.
    """
    powers = [rows]
    for k in range(1, max(sizes).bit_length()):
        powers.append(_merged(_back(powers[-1], 2 ** (k - 1), place), powers[-1]))
    out = {}
    for size in sizes:
        reach, got = 0, None
        for k in reversed(range(size.bit_length())):
            if size >> k & 1:
                part = _back(powers[k], reach, place) if reach else powers[k]
                got = part if got is None else _merged(got, part)
                reach += 2**k
        out[size] = got
    return out


def _std(f: Frame) -> np.ndarray:
    return np.sqrt(f["q"] / (f["n"] - 1))


def rolling_columns(size: int, f: Frame, x: np.ndarray, there: np.ndarray, pos: np.ndarray, length: np.ndarray) -> dict[str, Feature]:
    """Mean, sample std, min and max with at least max(1, size // 2) observations; a window longer than the series
    yields no feature."""
    ok = (f["n"] >= max(1, size // 2)) & (length >= size)
    return {
        "rollmean": (f["m"], ok),
        "rollstd": (_std(f), ok & (f["n"] >= 2)),
        "rollmin": (f["lo"], ok),
        "rollmax": (f["hi"], ok),
    }


def trend_columns(size: int, f: Frame, x: np.ndarray, there: np.ndarray, pos: np.ndarray, length: np.ndarray) -> dict[str, Feature]:
    """Least-squares slope per step over full windows with two or more values.

    Partial leading windows give NULL: the array form of the feature, not the biased short-frame one.
    """
    return {"trend": (f["c"] / f["u"], (pos >= size) & (f["n"] >= 2))}


def zscore_columns(
    size: int, f: Frame, x: np.ndarray, there: np.ndarray, pos: np.ndarray, length: np.ndarray, limit: float = 3.0
) -> dict[str, Feature]:
    std = _std(f)
    ok = there & (f["n"] >= max(2, size // 2)) & (std != 0) & (length >= size)
    z = (x - f["m"]) / std
    return {"anomaly": (z, ok), "is_anomaly": (ok & ((np.abs(z) > limit) | np.isnan(z)), np.ones(z.shape, bool))}


def full_mean_columns(size: int, f: Frame, x: np.ndarray, there: np.ndarray, pos: np.ndarray, length: np.ndarray) -> dict[str, Feature]:
    """Trailing mean, NULL until the window holds ``size`` values."""
    return {"rolling": (f["m"], f["n"] == size)}


_MAKERS = {"window": rolling_columns, "trend": trend_columns, "anomaly": zscore_columns, "rolling": full_mean_columns}
_NAMES = {"window": ("rollmean", "rollstd", "rollmin", "rollmax"), "trend": ("trend",), "anomaly": ("anomaly", "is_anomaly"), "rolling": ("rolling",)}


def _tile_begins(t: pa.Table) -> np.ndarray:
    """Where a tile begins in rows sorted by key and tile. A tile's rows are numbered without a gap, and no key ends
    in a tile just before the number with which another key's rows in that tile begin."""
    pos, tile = (t.column(c).to_numpy() for c in (POS, TILE))
    return np.concatenate([[True], (np.diff(pos) != 1) | (np.diff(tile) != 0)])[: len(pos)]


def features(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    variables: Sequence[str],
    stats: Sequence[str] = ("lag", "window", "trend", "anomaly", "rolling"),
    lags: Sequence[int] = LAGS,
    windows: Sequence[int] = WINDOWS,
) -> DataFrame:
    """All requested features of all variables from one tiling; the rows of many tiles are computed at once, as arrays."""
    framed = [name for name in _MAKERS if name in stats] if windows else []
    fields = list(dict.fromkeys(f for name in framed for f in _NEEDS[name].split()))
    lagged = list(lags) if "lag" in stats else []

    def build(x: DataFrame, w: WindowSpec) -> DataFrame:
        made = []
        for v in variables:
            made += [StructField(f"{v}_lag_{k}", x.schema[v].dataType) for k in lagged]
            for name in framed:
                for size in windows:
                    made += [StructField(f"{v}_{n}_{size}", BooleanType() if n == "is_anomaly" else DoubleType()) for n in _NAMES[name]]
        x = x.drop(*[f.name for f in made])

        def compute(t: pa.Table, begins: np.ndarray) -> pa.RecordBatch:
            at = np.arange(len(t))
            place = at - np.maximum.accumulate(np.where(begins, at, 0))
            t = t.combine_chunks()
            out = [c.chunk(0) for c in t.columns]
            values = [t.column(v).chunk(0).cast(pa.float64()) for v in variables]
            there = np.stack([c.is_valid().to_numpy(zero_copy_only=False) for c in values])
            xs = np.stack([c.fill_null(0.0).to_numpy() for c in values])
            pos, length = t.column(POS).to_numpy(), t.column(LENGTH).to_numpy()
            got = {}
            with np.errstate(all="ignore"):
                frames = trailing_frames(_rows(xs, there, pos, fields), windows, place) if framed else {}
                for name in framed:
                    for size in windows:
                        got[name, size] = _MAKERS[name](size, frames[size], xs, there, pos, length)
            for i, v in enumerate(variables):
                out += [t.column(v).chunk(0).take(pa.array(np.maximum(at - k, 0), mask=place < k)) for k in lagged]
                for name in framed:
                    for size in windows:
                        for n in _NAMES[name]:
                            value, ok = got[name, size][n]
                            out.append(pa.array(value[i], mask=~ok[i]))
            return pa.RecordBatch.from_arrays(out, names=[*t.column_names, *[f.name for f in made]])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []
            for b in batches:
                held.append(b)
                if sum(p.num_rows for p in held) >= ROWS:
                    t = pa.Table.from_batches(held)
                    begins = _tile_begins(t)
                    cut = int(np.flatnonzero(begins)[-1])
                    if cut:
                        # the last tile may go on in the next batch
                        yield compute(t.slice(0, cut), begins[:cut])
                        held = t.slice(cut).to_batches()
            if any(p.num_rows for p in held):
                t = pa.Table.from_batches(held)
                yield compute(t, _tile_begins(t))

        tiles = x.repartition(*keys, TILE).sortWithinPartitions(*keys, TILE, POS)
        return tiles.mapInArrow(run, StructType([*x.schema.fields, *made]))

    reach = max([*lagged, *[w - 1 for w in windows], 1])
    return over_tiles(df, keys, order, build, before=reach, size=LENGTH).drop(LENGTH)


def ema(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], variables: str | Sequence[str], spans: Sequence[int] = EMA_SPANS
) -> DataFrame:
    """Exponential moving averages with alpha = 2 / (span + 1), seeded with a series' first value.

    Assumption: the smoothing kernel of the original library is external; this is its usual form. A row is the
    affine map y -> (1 - alpha) y + alpha x of the average before it, a NULL row the identity, and a series' first
    value the constant x. Ranges of rows are scanned by composing maps (all variables and spans at once), seeded with
    the first value they hold. A series that goes on from an earlier range was seeded wrongly by some amount, of which
    (1 - alpha) ** n is left after n values: that much is added when the ends of the ranges before it, composed in
    order, are known. Rows with a NULL value stay in the result with NULL averages.
    """
    names = [variables] if isinstance(variables, str) else list(variables)
    alphas = [2 / (s + 1) for s in spans]
    made = [f"{v}_ema_{s}" for v in names for s in spans]
    seen = [f"_seen_{v}" for v in names]
    src = sorted_ranges(df.drop(*made), keys, order)
    schema = ", ".join([f"`{c}` double" for c in made] + [f"`{c}` long" for c in seen])
    local = src.mapInArrow(_affine_scan(list(keys), names, alphas, made, seen), StructType([*src.schema.fields, *StructType.fromDDL(schema).fields]))
    local = materialise(local, "ema-ranges")

    by = [*keys, RANGE]
    ends = [F.max(c).alias(c) for c in seen]
    for v in names:
        at = F.when(F.col(v).isNotNull(), F.col(PLACE))
        ends += [F.min_by(F.col(v).cast("double"), at).alias(f"_first_{v}"), *[F.max_by(c, at).alias(c) for c in made if c.startswith(f"{v}_ema_")]]
    part = local.groupBy(*by).agg(*ends).withColumn("_parts", F.count("*").over(Window.partitionBy(*keys)))
    # keys of several ranges: a range has two at most, the one it begins with and the one it ends with
    broken = part.filter("_parts > 1").orderBy(RANGE).collect()
    shifts = _carried([r.asDict() for r in broken], list(keys), names, list(spans))
    fields = [part.schema[c] for c in by]
    table = df.sparkSession.createDataFrame(shifts, StructType([*fields, *StructType.fromDDL(", ".join(f"`_shift_{c}` double" for c in made)).fields]))
    joined = left_join(local, table, by, small=True)
    mended = {}
    for v in names:
        for s, alpha in zip(spans, alphas):
            c = f"{v}_ema_{s}"
            left = F.pow(F.lit(1 - alpha), F.col(f"_seen_{v}")) * F.col(f"_shift_{c}")
            mended[c] = F.when(F.col(v).isNotNull(), F.col(c) + F.coalesce(left, F.lit(0.0)))
    return joined.withColumns(mended).drop(RANGE, PLACE, *seen, *[f"_shift_{c}" for c in made])


def _carried(ends: list[dict], keys: list[str], names: list[str], spans: list[int]) -> list[tuple]:
    """(keys, range, shifts): by how much the seed of each range of a broken series was wrong. ``ends`` come in the
    order of the ranges."""
    state: dict[tuple, dict[str, float]] = {}
    out = []
    for r in ends:
        key = tuple(r[k] for k in keys)
        before = state.setdefault(key, {})
        shift = []
        for v in names:
            first, n = r[f"_first_{v}"], r[f"_seen_{v}"]
            for s in spans:
                c = f"{v}_ema_{s}"
                wrong = before[c] - first if c in before and first is not None else None
                shift.append(wrong)
                if first is not None:
                    before[c] = r[c] + (wrong * (1 - 2 / (s + 1)) ** n if wrong is not None else 0.0)
        out.append((*key, r[RANGE], *shift))
    return out


def _affine_scan(keys: list[str], names: list[str], alphas: list[float], made: list[str], seen: list[str]):
    """Map over sorted rows: the averages of every (key, range), and how many values a row has seen with its own."""
    decay = np.tile(1 - np.array(alphas), len(names))
    spread = np.repeat(np.arange(len(names)), len(alphas))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple | None = None
        level, count = np.zeros(len(made)), np.zeros(len(names), np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            starts = np.zeros(b.num_rows, bool)
            for k in keys:
                code = b.column(k).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                starts[1:] |= code[1:] != code[:-1]
            first = tuple(b.column(k)[0].as_py() for k in keys)
            starts[0] = first != key
            x = np.stack([b.column(v).cast(pa.float64()).to_numpy(zero_copy_only=False) for v in names], 1)
            there = np.stack([b.column(v).is_valid().to_numpy(zero_copy_only=False) for v in names], 1)
            total = np.cumsum(there, 0)
            begin = np.maximum.accumulate(np.where(starts, np.arange(len(x)), 0))
            n = total - (total - there)[begin] + np.where((np.cumsum(starts) == 0)[:, None], count, 0)
            scale = np.where(there[:, spread], decay, 1.0)
            add = np.where(there[:, spread], (1 - decay) * x[:, spread], 0.0)
            seed = there[:, spread] & (n == 1)[:, spread]
            add[seed] = x[:, spread][seed]
            scale[seed] = 0.0
            scale[starts] = 0.0
            if not starts[0]:
                add[0] += scale[0] * level
                scale[0] = 0.0
            step = 1
            while step < len(x) and scale[step:].any():
                # compose each map with the one of the rows before it; spans of composed rows double
                add[step:] += scale[step:] * add[:-step]
                scale[step:] *= scale[:-step]
                scale[scale < 1e-300] = 0.0
                step *= 2
            key, level, count = tuple(b.column(k)[-1].as_py() for k in keys), add[-1], n[-1]
            shown = there[:, spread]
            columns = [pa.array(add[:, i], mask=~shown[:, i]) for i in range(len(made))]
            yield pa.RecordBatch.from_arrays([*b.columns, *columns, *[pa.array(n[:, i]) for i in range(len(names))]], names=[*b.schema.names, *made, *seen])

    return run


def sequences(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    columns: Sequence[str],
    length: int = 168,
) -> DataFrame:
    """Model input: the last ``length`` rows per row, the head padded with the first row of the frame."""

    def build(x: DataFrame, w: WindowSpec) -> DataFrame:
        got = F.collect_list(F.struct(*columns)).over(trailing(w, length))
        x = x.withColumn("_got", got)
        pad = F.array_repeat(F.col("_got")[0], F.lit(length) - F.size("_got"))
        return x.withColumn("sequence", F.concat(pad, F.col("_got"))).drop("_got")

    return over_tiles(df, keys, order, build, before=length - 1)


