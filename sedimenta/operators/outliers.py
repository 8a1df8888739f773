"""Implausible readings: peaks over a threshold on seasonal residuals, stuck runs and plausibility rules, per source.

Readings are brought into one order of source and time by a range exchange, so a source of any size is spread over as
many tasks as it fills. A source that lies inside one task is measured there in one go. One that goes on in another task
is measured in pieces: the pieces' runs and outermost readings are exchanged first (a bounded number per task), then sums
for its season, then a histogram of its residuals. All of these add up exactly, so where the cuts lie makes no difference.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.operators.common import join_unique, staged

STUCK_RUN = 8  # equal readings in a row
SIDE = 7  # usable readings that make up the level before and after
CHUNK = 250_000  # rows aimed at in one task
RISK = 1e-6  # chance that a plausible reading passes its source's cutoff
TAIL_START = 1.0  # residuals in units of spread from which the tail is fitted
SCALE_WEIGHT, SHAPE_WEIGHT, RATE_WEIGHT = 50.0, 1000.0, 100.0  # exceedances (readings, for the rate) that the pooled tail counts for
SHAPES = (-0.5, 0.45)  # shapes whose moments exist
RETURN = 0.4  # a spike is as far from the level on its nearer side as this share of the farther side, at least
SURE = 2.0  # or so many times the cutoff away from either side
SHORTEST, RATIO, PERIODS = 300e6, 1.1, 90  # periods tried: microseconds of the first, step from one to the next, how many (to 17 days)
LEAST_PER_PERIOD, LEAST_PERIODS = 12, 2  # readings in a period and periods in a source's time for it to be tried
SEASON_GAIN = 6.0  # a season has to explain this many times what chance would, times the logarithm of the number of readings
BINS = 200.0  # bins of a histogram in a factor of e

PERIOD = SHORTEST * RATIO ** np.arange(PERIODS)


def ordered(heartbeats: DataFrame, metrics: list[str]) -> DataFrame:
    """(source, at, id, metrics...) without exact repeats, in one order over all partitions; null sources are left out.

    Repeats are in the same partition, and dropping them needs no other exchange.
    """
    rows = heartbeats.where("worker_id is not null").select(
        F.col("worker_id").alias("source"), F.unix_micros(F.col("sent_at").cast("timestamp")).alias("at"), F.col("heartbeat_id").alias("id"),
        *[(F.col(m).cast("double") + F.lit(0.0)).alias(f"m{i}") for i, m in enumerate(metrics)],
    )
    parts = max(int(heartbeats.sparkSession.conf.get("spark.sql.shuffle.partitions")), heartbeats.count() // CHUNK + 1)
    return rows.repartitionByRange(parts, "source", "at", "id").dropDuplicates().sortWithinPartitions("source", "at", "id", *[f"m{i}" for i in range(len(metrics))])


def runs_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, lengths) of runs of equal values; NaN equals nothing."""
    starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.zeros(0, np.int64)
    return starts, np.diff(np.r_[starts, len(values)])


def in_range(values: np.ndarray) -> np.ndarray:
    return (values >= 0) & (values <= 100)


@dataclass
class Halo:
    """What a piece of a series has to know of its surroundings."""

    before: tuple[float, int] = (np.nan, 0)  # the run of equal readings that ends where the piece begins
    after: tuple[float, int] = (np.nan, 0)
    left: list[float] = field(default_factory=list)  # up to SIDE usable readings before the piece, in order
    right: list[float] = field(default_factory=list)


@dataclass
class Summary:
    """What a piece tells the pieces around it: its outer runs, and up to SIDE usable readings next to them on either side."""

    first: tuple[float, int]
    head: list[float]
    tail: list[float]
    last: tuple[float, int] | None  # None if all of the piece is one run

    @classmethod
    def of(cls, values: np.ndarray) -> Summary:
        starts, lengths = runs_of(values)
        first = (float(values[0]), int(lengths[0]))
        if len(starts) == 1:
            return cls(first, [], [], None)
        inner = values[lengths[0] : starts[-1]]
        stuck = np.repeat(lengths[1:-1] >= STUCK_RUN, lengths[1:-1])
        usable = inner[~stuck & in_range(inner)]
        return cls(first, usable[:SIDE].tolist(), usable[-SIDE:].tolist(), (float(values[-1]), int(lengths[-1])))


def halos(pieces: list[Summary]) -> list[Halo]:
    """The surroundings of each of the consecutive pieces of one series."""
    n = len(pieces)
    ends = [p.last or p.first for p in pieces]
    before, after = [0] * n, [0] * n  # readings equal to a piece's first (last) one that go before (after) it without a gap
    for i in range(1, n):
        if ends[i - 1][0] == pieces[i].first[0]:
            before[i] = ends[i - 1][1] + (before[i - 1] if pieces[i - 1].last is None else 0)
    for i in range(n - 2, -1, -1):
        if ends[i][0] == pieces[i + 1].first[0]:
            after[i] = pieces[i + 1].first[1] + (after[i + 1] if pieces[i + 1].last is None else 0)

    def usable(run: tuple[float, int], more: int) -> list[float]:
        return [run[0]] * min(run[1], SIDE) if 0 <= run[0] <= 100 and run[1] + more < STUCK_RUN else []

    def readings(i: int, forward: bool) -> list[float]:
        p = pieces[i]
        if p.last is None:
            return usable(p.first, before[i] + after[i])
        return [*usable(p.first, before[i]), *(p.head if forward else p.tail), *usable(p.last, after[i])] if len(p.head) < SIDE or not forward else [*usable(p.first, before[i]), *p.head]

    out = []
    for i in range(n):
        left: list[float] = []
        for j in range(i - 1, -1, -1):
            if len(left) >= SIDE:
                break
            p = pieces[j]
            whole = readings(j, False)
            if p.last is not None and len(p.tail) == SIDE:
                whole = [*p.tail, *usable(p.last, after[j])]
            left = [*whole, *left][-SIDE:]
        right: list[float] = []
        for j in range(i + 1, n):
            if len(right) >= SIDE:
                break
            right = [*right, *readings(j, True)][:SIDE]
        out.append(Halo((pieces[i].first[0], before[i]), (ends[i][0], after[i]), left, right))
    return out


@dataclass
class Measured:
    """Readings of a (piece of a) series: which are stuck and which usable, and of the usable ones the distances to both levels."""

    stuck: np.ndarray
    usable: np.ndarray  # places
    a: np.ndarray  # distance to the level before
    b: np.ndarray  # distance to the level after
    width: np.ndarray  # range of the readings around


def measure(values: np.ndarray, halo: Halo) -> Measured:
    """Levels are medians of the SIDE usable readings before and after; at an end of the series the other side's stands in."""
    _, lengths = runs_of(values)
    total = lengths.copy()
    if len(total):
        total[0] += halo.before[1]
        total[-1] += halo.after[1]
    stuck = np.repeat(total >= STUCK_RUN, lengths)
    usable = np.flatnonzero(~stuck & in_range(values))
    n, skip = len(usable), len(halo.left)
    x = np.r_[halo.left, values[usable], halo.right]
    size = len(x)
    if not n or size < 2:
        return Measured(stuck, usable, np.zeros(n), np.zeros(n), np.zeros(n))
    windows = np.lib.stride_tricks.sliding_window_view(np.r_[np.full(SIDE, np.inf), x, np.full(SIDE, np.inf)], SIDE)
    at = np.arange(skip, skip + n)
    before, after = np.minimum(at, SIDE), np.minimum(size - 1 - at, SIDE)
    left, right = np.sort(windows[at], axis=1), np.sort(windows[at + SIDE + 1], axis=1)
    rows = np.arange(n)

    def median(side: np.ndarray, count: np.ndarray) -> np.ndarray:
        some = np.maximum(count, 1)
        return (side[rows, (some - 1) // 2] + side[rows, some // 2]) / 2

    low, high = median(left, before), median(right, after)
    low, high = np.where(before == 0, high, low), np.where(after == 0, low, high)
    top = np.maximum(np.where(before > 0, left[rows, np.maximum(before, 1) - 1], -np.inf), np.where(after > 0, right[rows, np.maximum(after, 1) - 1], -np.inf))
    v = values[usable]
    return Measured(stuck, usable, v - low, v - high, top - np.minimum(left[:, 0], right[:, 0]))


def season_sums(m: Measured, times: np.ndarray, tried: np.ndarray) -> np.ndarray:
    """Sums of a harmonic regression of both distances for every period tried; they add up over the pieces of a series.

    Distances are held within the range of the readings around, so that spikes do not make seasons. Readings without a
    time do not take part.
    """
    sums = np.zeros((8, PERIODS))
    of = times[m.usable]
    there = np.flatnonzero(of >= 0)
    for i in range(0, len(there), 16_384):
        some = there[i : i + 16_384]
        phase = of[some, None] * (2 * np.pi / PERIOD[tried])
        c, s = np.cos(phase), np.sin(phase)
        ya, yb = (np.clip(d[some], -m.width[some], m.width[some]) for d in (m.a, m.b))
        sums[:, tried] += np.stack([(c * c).sum(0), (s * s).sum(0), (c * s).sum(0), ya @ c, ya @ s, yb @ c, yb @ s, np.full(len(tried), ya @ ya + yb @ yb)])
    return sums


def periods_tried(first: float, last: float, count: int) -> np.ndarray:
    """Numbers of the periods that a source's time and number of usable readings allow."""
    span = last - first
    return np.flatnonzero((PERIOD * LEAST_PERIODS <= span) & (PERIOD * (count - 1) >= LEAST_PER_PERIOD * span)) if count > 1 and span > 0 else np.zeros(0, np.int64)


Season = tuple[float, float, float, float, float]


def fit_season(sums: np.ndarray, tried: np.ndarray, count: int) -> Season | None:
    """(period, cosine and sine for the level before, the same for the level after) of the best period, if it explains enough."""
    if not len(tried):
        return None
    cc, ss, cs, ac, as_, bc, bs, total = sums[:, tried]
    det = np.maximum(cc * ss - cs * cs, 1e-9)
    p, q, u, v = (ac * ss - as_ * cs) / det, (as_ * cc - ac * cs) / det, (bc * ss - bs * cs) / det, (bs * cc - bc * cs) / det
    gain = p * ac + q * as_ + u * bc + v * bs
    best = int(np.argmax(gain))
    if not gain[best] > total[best] * min(1.0, SEASON_GAIN * np.log(count) / count):
        return None
    return float(PERIOD[tried[best]]), float(p[best]), float(q[best]), float(u[best]), float(v[best])


def residuals(m: Measured, times: np.ndarray, season: Season | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(near, far, center) of the usable readings, without their season.

    near and far: distance to the nearer and the farther of both levels, 0 unless both lie on the same side. center:
    distance to the middle of both.
    """
    a, b = m.a, m.b
    if season is not None:
        period, p, q, u, v = season
        of = times[m.usable]
        phase = of * (2 * np.pi / period)
        c, s = np.where(of >= 0, np.cos(phase), 0), np.where(of >= 0, np.sin(phase), 0)
        a, b = a - p * c - q * s, b - u * c - v * s
    same = np.sign(a) == np.sign(b)
    return np.where(same, np.minimum(abs(a), abs(b)), 0), np.where(same, np.maximum(abs(a), abs(b)), 0), abs(a + b) / 2


NONE = -(1 << 30)  # the bin of zero


def bins_of(values: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.where(values > 0, np.floor(np.log(np.maximum(values, 1e-300)) * BINS), NONE).astype(np.int64)


def spread_of(bins: np.ndarray, counts: np.ndarray, total: float) -> float:
    """1.4826 times the median of values in (sorted) bins; the mean where the median is zero."""
    n = counts.sum()
    if not n:
        return 0.0
    middle = bins[np.searchsorted(np.cumsum(counts), (n + 1) // 2)]
    return float(1.4826 * np.exp((middle + 0.5) / BINS)) if middle != NONE else float(total / n)


@dataclass
class Scale:
    """A source's season, spread, greatest plausible value and number of usable readings."""

    season: Season | None
    spread: float
    top: float
    count: int


def judge(ids: pa.Array, values: np.ndarray, times: np.ndarray, m: Measured, scale: Scale) -> pa.RecordBatch:
    """Readings that are impossible or stuck, and those in the tail: (id, value, state, z, brief, n)."""
    with np.errstate(invalid="ignore"):
        impossible = ~((values >= 0) & (values <= scale.top))
    z, brief = np.full(len(values), np.nan), np.zeros(len(values), bool)
    near, far, _ = residuals(m, times, scale.season)
    if scale.spread > 0:
        z[m.usable] = near / scale.spread
        brief[m.usable] = near >= RETURN * far
    z[impossible | m.stuck] = np.nan
    state = np.where(impossible, 2, np.where(m.stuck, 1, 0)).astype(np.int8)
    keep = np.flatnonzero((state > 0) | (z > TAIL_START))
    return pa.record_batch([ids.take(pa.array(keep)), pa.array(values[keep]), pa.array(state[keep]), pa.array(z[keep]), pa.array(brief[keep]), pa.array(np.full(len(keep), scale.count))], names=["id", "value", "state", "z", "brief", "n"])


def _histogram(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(bins_of(values), return_counts=True)


def whole(ids: pa.Array, values: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
    """A series that lies in one task, measured and judged."""
    m = measure(values, Halo())
    of = times[m.usable]
    of = of[of >= 0]
    tried = periods_tried(of.min(), of.max(), len(of)) if len(of) else np.zeros(0, np.int64)
    season = fit_season(season_sums(m, times, tried), tried, len(of))
    _, _, center = residuals(m, times, season)
    plain = values[in_range(values)]
    top = 100.0 if len(plain) and (plain > 1).sum() * 2 > len(plain) else 1.0
    return judge(ids, values, times, m, Scale(season, spread_of(*_histogram(center), center.sum()), top, len(m.usable)))


FOUND = ["id", "value", "state", "z", "brief", "n"]


def _measured(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """Judged readings of series inside one task; those of a task's outermost sources as pieces (part, ids, times, values)."""
    types = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        rows = list(batches)
        if not rows or not (n := sum(b.num_rows for b in rows)):
            return
        table = pa.Table.from_batches(rows).combine_chunks()
        source, ids = (table.column(c).chunk(0) for c in ("source", "id"))
        at = table.column("at").chunk(0).fill_null(-1).to_numpy()
        fresh = np.asarray(pc.not_equal(source.slice(1), source.slice(0, n - 1)).to_numpy(zero_copy_only=False), bool)
        edges = [0, *(np.flatnonzero(fresh) + 1).tolist(), n]
        columns = [table.column(f"m{i}").chunk(0) for i in range(len(metrics))]
        there = [np.asarray(c.is_valid().to_numpy(zero_copy_only=False), bool) for c in columns]
        numbers = [c.fill_null(0.0).to_numpy() for c in columns]
        out = pa.schema([("source", source.type), ("metric", pa.int32()), ("id", ids.type), ("value", pa.float64()), ("state", pa.int8()), ("z", pa.float64()), ("brief", pa.bool_()), ("n", pa.int64()), ("part", pa.int32()), ("ids", pa.list_(ids.type)), ("times", pa.list_(pa.int64())), ("values", pa.list_(pa.float64()))])
        done: list[pa.RecordBatch] = []
        size = 0
        for e, (a, b) in enumerate(zip(edges, edges[1:])):
            for i in range(len(metrics)):
                places = a + np.flatnonzero(there[i][a:b])
                if not len(places):
                    continue
                own, times, values = ids.take(pa.array(places)), at[places], numbers[i][places]
                if e in (0, len(edges) - 2):
                    lists = [pa.ListArray.from_arrays(pa.array([0, len(places)], pa.int32()), x) for x in (own, pa.array(times), pa.array(values))]
                    done.append(pa.record_batch([source.slice(a, 1), pa.array([i], pa.int32()), *[pa.nulls(1, out.field(c).type) for c in FOUND], pa.array([part], pa.int32()), *lists], schema=out))
                else:
                    found = whole(own, values, times)
                    k = found.num_rows
                    done.append(pa.record_batch([pa.repeat(source[a], k), pa.array(np.full(k, i, np.int32)), *found.columns, *[pa.nulls(k, out.field(c).type) for c in ("part", "ids", "times", "values")]], schema=out))
                size += done[-1].num_rows
                if size > 20_000:
                    yield from pa.Table.from_batches(done).combine_chunks().to_batches()
                    done, size = [], 0
        if done:
            yield from pa.Table.from_batches(done).combine_chunks().to_batches()

    return rows.mapInArrow(run, f"source {types['source']}, metric int, id {types['id']}, value double, state tinyint, z double, brief boolean, n long, part int, ids array<{types['id']}>, times array<long>, values array<double>")


def _pieces(frame: DataFrame, make: Any, schema: str) -> DataFrame:
    """make(source, metric, part, ids, times, values) of every piece; a piece fits one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                source, metric, part = one.column("source")[0], one.column("metric")[0].as_py(), one.column("part")[0].as_py()
                ids, times, values = (one.column(c).flatten() for c in ("ids", "times", "values"))
                made = make(source, metric, part, ids, times.to_numpy(), values.to_numpy())
                if made is not None and made.num_rows:
                    yield made

    return frame.select("source", "metric", "part", "ids", "times", "values").mapInArrow(run, schema)


def _spanning(pieces: DataFrame) -> DataFrame | None:
    """Judged readings of the series that may go on from task to task.

    Every task has two outermost sources, so what reaches the driver - outer runs, sums, histograms - is bounded by the
    number of tasks, whatever the number of readings.
    """
    spark = pieces.sparkSession
    types = dict(pieces.dtypes)
    key = f"source {types['source']}, metric int, part int"

    def tell(source, metric, part, ids, times, values):
        s = Summary.of(values)
        return pa.record_batch([pa.array([source.as_py()], source.type), pa.array([metric], pa.int32()), pa.array([part], pa.int32()), pa.array([[*s.first, *(s.last or (np.nan, -1))]], pa.list_(pa.float64())), pa.array([s.head], pa.list_(pa.float64())), pa.array([s.tail], pa.list_(pa.float64()))], names=["source", "metric", "part", "runs", "head", "tail"])

    told = _pieces(pieces, tell, f"{key}, runs array<double>, head array<double>, tail array<double>").collect()
    if not told:
        return None
    series: dict[tuple, list] = {}
    for r in sorted(told, key=lambda r: r["part"]):
        last = (r["runs"][2], int(r["runs"][3])) if r["runs"][3] >= 0 else None
        series.setdefault((r["source"], r["metric"]), []).append((r["part"], Summary((r["runs"][0], int(r["runs"][1])), r["head"], r["tail"], last)))
    around = {(*k, part): h for k, parts in series.items() for (part, _), h in zip(parts, halos([s for _, s in parts]))}
    shared = spark.sparkContext.broadcast(around)

    def add_up(source, metric, part, ids, times, values):
        m = measure(values, shared.value[source.as_py(), metric, part])
        of = times[m.usable]
        of = of[of >= 0]
        sums = season_sums(m, times, np.arange(PERIODS))
        return pa.record_batch([pa.array([source.as_py()], source.type), pa.array([metric], pa.int32()), pa.array([part], pa.int32()), pa.array([sums.tobytes()], pa.binary()), pa.array([len(of)], pa.int64()), pa.array([float(of.min()) if len(of) else np.inf]), pa.array([float(of.max()) if len(of) else -np.inf])], names=["source", "metric", "part", "sums", "n", "t0", "t1"])

    seasons: dict[tuple, Season | None] = {}
    added: dict[tuple, list] = {}
    for r in sorted(_pieces(pieces, add_up, f"{key}, sums binary, n long, t0 double, t1 double").collect(), key=lambda r: r["part"]):
        added.setdefault((r["source"], r["metric"]), []).append(r)
    for k, parts in added.items():
        count = sum(r["n"] for r in parts)
        tried = periods_tried(min(r["t0"] for r in parts), max(r["t1"] for r in parts), count)
        seasons[k] = fit_season(sum(np.frombuffer(r["sums"]).reshape(8, PERIODS) for r in parts), tried, count)
    fitted = spark.sparkContext.broadcast(seasons)

    def count(source, metric, part, ids, times, values):
        m = measure(values, shared.value[source.as_py(), metric, part])
        _, _, center = residuals(m, times, fitted.value[source.as_py(), metric])
        bins, counts = _histogram(center)
        plain = values[in_range(values)]
        return pa.record_batch([pa.array([source.as_py()], source.type), pa.array([metric], pa.int32()), pa.array([part], pa.int32()), pa.array([bins.tolist()], pa.list_(pa.int64())), pa.array([counts.tolist()], pa.list_(pa.int64())), pa.array([float(center.sum())]), pa.array([len(plain)], pa.int64()), pa.array([int((plain > 1).sum())], pa.int64())], names=["source", "metric", "part", "bins", "counts", "total", "plain", "over"])

    scales: dict[tuple, Scale] = {}
    counted: dict[tuple, list] = {}
    for r in sorted(_pieces(pieces, count, f"{key}, bins array<long>, counts array<long>, total double, plain long, over long").collect(), key=lambda r: r["part"]):
        counted.setdefault((r["source"], r["metric"]), []).append(r)
    for k, parts in counted.items():
        bins, at = np.unique(np.concatenate([np.array(r["bins"], np.int64) for r in parts]), return_inverse=True)
        counts = np.bincount(at, np.concatenate([np.array(r["counts"], np.int64) for r in parts]), len(bins)).astype(np.int64)
        top = 100.0 if sum(r["over"] for r in parts) * 2 > sum(r["plain"] for r in parts) else 1.0
        scales[k] = Scale(seasons[k], spread_of(bins, counts, sum(r["total"] for r in parts)), top, int(counts.sum()))
    known = spark.sparkContext.broadcast(scales)

    def decide(source, metric, part, ids, times, values):
        m = measure(values, shared.value[source.as_py(), metric, part])
        found = judge(ids, values, times, m, known.value[source.as_py(), metric])
        k = found.num_rows
        return pa.record_batch([pa.repeat(source, k), pa.array(np.full(k, metric, np.int32)), *found.columns], names=["source", "metric", *FOUND])

    return _pieces(pieces, decide, f"source {types['source']}, metric int, id {types['id']}, value double, state tinyint, z double, brief boolean, n long")


Tail = tuple[float, float]


def cutoff(scale: float, shape: float, rate: float) -> float:
    """Excess over TAIL_START that a reading passes with the chance RISK, if exceedances have that rate."""
    tail = max(rate / RISK, 1.0)
    return scale * np.log(tail) if abs(shape) < 1e-3 else scale / shape * (tail**shape - 1)


def fit_tail(excess: np.ndarray, counts: np.ndarray, rate: float, pooled: Tail | None = None) -> tuple[float, float, float]:
    """(cutoff over TAIL_START, scale, shape) of a generalised Pareto tail of binned excesses (in order).

    The fit starts from the pooled tail or, for that one, from an exponential tail with the median's scale, and takes in
    exceedances up to its own cutoff until no more come in; so a heavy tail draws its cutoff up, and spikes beyond do
    not. A source's own moments are drawn towards the pooled ones, and the pooled shape towards an exponential tail's, the
    more the fewer exceedances there are.
    """
    if pooled is None:
        at = np.searchsorted(np.cumsum(counts), counts.sum() / 2)
        scale, shape = max(float(excess[at]) / np.log(2), 1e-9), 0.0
    else:
        scale, shape = pooled
        mean = scale / (1 - shape)
    cut, seen = cutoff(scale, shape, rate), -1
    while True:
        some = excess <= cut
        n = counts[some].sum()
        if n <= seen:
            return cut, scale, shape
        seen = n
        own = float((counts * excess)[some].sum() / n) if n else 0.0
        var = float((counts * excess**2)[some].sum() / n) - own**2 if n else 0.0
        bent = float(np.clip((1 - own**2 / var) / 2, *SHAPES)) if var > 0 else None
        if pooled is None:
            shape = n * bent / (n + SHAPE_WEIGHT) if bent is not None else 0.0
            scale = own * (1 - shape)
        else:
            shape = (n * bent + SHAPE_WEIGHT * pooled[1]) / (n + SHAPE_WEIGHT) if bent is not None else pooled[1]
            scale = (n * own + SCALE_WEIGHT * mean) / (n + SCALE_WEIGHT) * (1 - shape)
        cut = cutoff(scale, shape, rate)


def _cutoffs(found: DataFrame) -> DataFrame:
    """(series, cut): the cutoff in spreads of every source that has exceedances."""
    excess = found.where("state = 0").select("series", "n", F.floor(F.log(F.greatest(F.col("z") - TAIL_START, F.lit(1e-12))) * (BINS / 2)).cast("int").alias("bin"))
    # At most some thousand bins a source, whatever its number of readings.
    binned = excess.groupBy("series", "bin").agg(F.count(F.lit(1)).alias("k"), F.max("n").alias("n"))
    binned = staged(binned, "exceedances")
    pooled = sorted((r["bin"], r["k"]) for r in binned.groupBy("bin").agg(F.sum("k").alias("k")).collect())
    per_series = binned.groupBy("series").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("bin", "k"))).alias("bins"))
    readings = per_series.agg(F.sum("n")).first()[0] or 1
    middle = lambda bins: np.exp((np.array(bins) + 0.5) / (BINS / 2))
    if pooled:
        common = sum(k for _, k in pooled) / readings
        _, scale, shape = fit_tail(middle([b for b, _ in pooled]), np.array([k for _, k in pooled], float), common)
    else:
        common, scale, shape = 0.0, 1.0, 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cuts = []
            for n, bins in zip(batch.column("n").to_pylist(), batch.column("bins").to_pylist()):
                counts = np.array([b["k"] for b in bins], float)
                rate = (counts.sum() + RATE_WEIGHT * common) / (n + RATE_WEIGHT)
                cuts.append(TAIL_START + fit_tail(middle([b["bin"] for b in bins]), counts, rate, (scale, shape))[0])
            yield pa.record_batch([batch.column("series"), pa.array(cuts, pa.float64())], names=["series", "cut"])

    return per_series.mapInArrow(run, f"series {dict(per_series.dtypes)['series']}, cut double")


def flag_readings(heartbeats: DataFrame, metrics: list[str]) -> DataFrame:
    """(id, source, metric, value, reason): reason is impossible, stuck or spike; other readings are left out.

    A source's unit is a percentage if over half of its readings from 0 to 100 are over 1, else a fraction. A reading's
    residual is its distance to the levels before and after it less the source's season there: a wave of the period that
    explains most, if any does. A source's spread is 1.4826 times the median residual. Spikes are found by a generalised
    Pareto tail of the residuals over TAIL_START spreads, with few exceedances drawn towards the tail of all sources; its
    cutoff is passed with the chance RISK and nothing else bounds it. A spike has to stand out against the level before
    it and the level after it, which a step, a slow rise or its reset does not. Null readings and null sources are
    ignored; a source of one reading has no level. Exact repeats count once; readings without a time come first.
    """
    judged = staged(_measured(ordered(heartbeats, metrics), metrics), "measured")
    narrow = ["source", "metric", *FOUND]
    found = judged.where("part is null").select(*narrow)
    spanning = _spanning(judged.where("part is not null"))
    if spanning is not None:
        found = found.unionByName(staged(spanning, "spanning"))
    found = found.withColumn("series", F.struct("source", "metric"))
    met = join_unique(found.where("state = 0"), _cutoffs(found), "series", "inner")
    spikes = met.where((F.col("z") > F.col("cut")) & (F.col("brief") | (F.col("z") > SURE * F.col("cut")))).drop("cut")
    names = F.array(*[F.lit(m) for m in metrics])
    reason = F.when(F.col("state") == 2, "impossible").when(F.col("state") == 1, "stuck").otherwise("spike")
    return found.where("state > 0").unionByName(spikes).select("id", "source", F.element_at(names, F.col("metric") + 1).alias("metric"), "value", reason.alias("reason"))
