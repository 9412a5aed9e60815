"""Fences and statistics of any sample of participants, looked up instead of made from its trials.

The index holds each participant's times of each effect variant in order, with their cells, and the numbers of the samples
that drew the participant. How many of a sample's times lie below a value is then a sum of binary searches over its
participants. A median is found by narrowing a bracket with such counts: a pass over the index counts at many values of every
sample's bracket at once, and also tells the nearest times on both sides of each value, so a bracket always ends on times
that are there and closes on the exact one. A median absolute deviation is found alike, by two searches for each value. What lies inside
fences is the difference of prefix sums at two searches, for all rules and transformations in one pass.

No trial is ever joined to a sample. A pass sends a row for each sample and effect variant and task; what comes to the driver
is a row for each sample and variant, the size of the grid. A participant with more than PART trials is cut into
parts with lists of their own; all that is looked up adds up over parts.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specgrid.sources.scratch import saved

KEYS = ["sample_size", "sample", "subsample_id"]
#: Trials of a participant in one list.
PART = 8192
#: Values that a pass counts at, over all samples and variants, and the fewest and most in one bracket.
PROBES, FEWEST, MOST = 1 << 18, 16, 2048
#: Hot participants that are broadcast at most; more are joined.
BROADCAST_ROWS = 100_000
CELLS = ((1, 1), (1, -1), (-1, 1), (-1, -1))
LARGEST = 8e307


@dataclass
class TrialIndex:
    rows: DataFrame
    strips: tuple[str, ...]
    samples: list[tuple[float, str, int]]
    split: bool

    @property
    def shape(self) -> tuple[int, int]:
        return len(self.strips), len(self.samples)


def build(effects: DataFrame, members: DataFrame, strips: Sequence[str]) -> TrialIndex:
    """The index of effects (participant_id, source_row, cong, prev_cong, strip_method, rt), of participants that some sample drew.

    Null and not-a-number times are left out, as every rule does; trials without codes count for the fences only.
    """
    spark, strips = effects.sparkSession, tuple(strips)
    samples = sorted(tuple(r) for r in members.select(*KEYS).distinct().collect())
    numbered = spark.createDataFrame([(*s, i) for i, s in enumerate(samples)], "sample_size double, sample string, subsample_id int, at int")
    drawn = members.withColumn("subsample_id", F.col("subsample_id").cast("int")).join(F.broadcast(numbered), KEYS).groupBy("participant_id").agg(F.sort_array(F.collect_set("at")).alias("samples"))
    timed = effects.where(F.col("rt").isNotNull() & ~F.isnan("rt") & F.col("strip_method").isin(*strips))
    # as many trials in each variant, but for null times
    sizes = timed.groupBy("participant_id").agg((F.count("*") / len(strips)).alias("n")).where(F.col("n") > PART)
    heavy = saved(sizes.select("participant_id", F.ceil(F.col("n") / PART).alias("parts")))
    n_heavy = heavy.count()
    part = F.lit(0).cast("long")
    if n_heavy:
        timed = timed.join(F.broadcast(heavy) if n_heavy <= BROADCAST_ROWS else heavy, "participant_id", "left")
        part = F.coalesce(F.pmod(F.xxhash64("source_row", "rt"), F.col("parts")), part)
    known = F.col("cong").isin(-1, 1) & F.col("prev_cong").isin(-1, 1)
    cell = F.when(known, (F.col("cong") == -1).cast("int") * 2 + (F.col("prev_cong") == -1).cast("int")).otherwise(4).cast("tinyint")
    variant = F.array_position(F.array(*map(F.lit, strips)), F.col("strip_method")).cast("int") - 1
    person = effects.schema["participant_id"].dataType.simpleString()
    rows = timed.select(variant.alias("variant"), "participant_id", part.alias("part"), (F.col("rt") + 0.0).alias("rt"), cell.alias("cell"))
    rows = rows.repartition("participant_id", "part").sortWithinPartitions("variant", "participant_id", "part", "rt")
    lists = rows.mapInArrow(in_lists, f"variant int, participant_id {person}, times array<double>, cells array<tinyint>")
    return TrialIndex(saved(lists.join(drawn, "participant_id")), strips, samples, n_heavy > 0)


def freed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; a worker gives back what earlier ones held before it takes the next, and when it is done."""
    for batch in batches:
        yield batch
        del batch
        pa.default_memory_pool().release_unused()


def in_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (variant, participant_id, part, rt, cell) as a row of two lists for each variant, participant and part."""
    rest = None
    for batch in itertools.chain(freed(batches), [None]):
        if batch is not None and not batch.num_rows:
            continue
        rows = pa.Table.from_batches([x for x in (rest, batch) if x is not None]).combine_chunks() if rest or batch else None
        if rows is None:
            return
        rows = rows.to_batches()[0]
        new = np.zeros(rows.num_rows, bool)
        for name in ("variant", "participant_id", "part"):
            column = rows.column(name)
            new[1:] |= pc.fill_null(pc.not_equal(column[1:], column[:-1]), True).to_numpy(zero_copy_only=False)
        new[0] = True
        starts = np.flatnonzero(new)
        # the last list may go on in the next batch
        ends = np.append(starts[1:], rows.num_rows) if batch is None else starts[1:]
        if len(ends):
            edges = pa.array(np.concatenate(([0], ends)), pa.int32())
            first = pa.array(starts[: len(ends)])
            lists = (pa.ListArray.from_arrays(edges, rows.column(name).slice(0, ends[-1])) for name in ("rt", "cell"))
            yield pa.RecordBatch.from_arrays([rows.column("variant").take(first), rows.column("participant_id").take(first), *lists], ["variant", "participant_id", "times", "cells"])
        rest = None if batch is None else rows.slice(starts[-1])


def lists_of(batch: pa.RecordBatch, name: str) -> list[np.ndarray]:
    return lists_of_array(batch.column(name))


def lists_of_array(column: pa.ListArray) -> list[np.ndarray]:
    edges, flat = column.offsets.to_numpy(), column.flatten().to_numpy()
    return [flat[a - edges[0] : b - edges[0]] for a, b in zip(edges[:-1], edges[1:], strict=True)]


#: For the times of a participant in a variant and the numbers of its samples: what adds up, what is least and what is largest, a row for each sample.
Look = Callable[[np.ndarray, int, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


#: What a pass sends for a sample and variant: sums, minima and maxima.
KINDS = ("add", "low", "high")


def merged(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows that tasks sent for a sample and variant as one, added up a batch at a time, however many tasks there are."""
    whole = None
    for batch in freed(batches):
        for row in zip(*(lists_of(batch, k) for k in KINDS), strict=True):
            whole = [f(x, y) for f, x, y in zip((np.add, np.minimum, np.maximum), whole, row, strict=True)] if whole else [x.copy() for x in row]
    lists = (pa.array([x.tolist()], pa.list_(pa.float64())) for x in whole)
    yield pa.RecordBatch.from_arrays([*(pa.array([k.as_py()], pa.int32()) for k in key), *lists], ["v", "s", *KINDS])


def passed(index: TrialIndex, look: Look, widths: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums, minima and maxima (variants, samples, width) over all participants of each sample: one pass over the index."""
    shape = index.shape
    start = (0.0, np.inf, -np.inf)

    def run(batches):
        held = [np.full((*shape, w), x) for w, x in zip(widths, start, strict=True)]
        met = np.zeros(shape, bool)
        for batch in freed(batches):
            variants = batch.column("variant").to_pylist()
            for v, own, times in zip(variants, lists_of(batch, "samples"), lists_of(batch, "times"), strict=True):
                add, low, high = look(times, v, own)
                met[v, own] = True
                held[0][v, own] += add
                held[1][v, own] = np.minimum(held[1][v, own], low)
                held[2][v, own] = np.maximum(held[2][v, own], high)
        v, s = np.nonzero(met)
        flat = [x[v, s] for x in held]
        lists = (pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * w, pa.int32()), pa.array(x.ravel())) for x, w in zip(flat, widths, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.int32()), pa.array(s, pa.int32()), *lists], ["v", "s", *KINDS])

    sent = index.rows.select("variant", "samples", "times").mapInArrow(run, "v int, s int, add array<double>, low array<double>, high array<double>")

    got = sent.groupBy("v", "s").applyInArrow(merged, sent.schema)
    out = tuple(np.full((*shape, w), x) for w, x in zip(widths, start, strict=True))
    for v, s, *values in got.collect():
        for to, x in zip(out, values, strict=True):
            to[v, s] = x
    return out


def summary(index: TrialIndex, centre: np.ndarray) -> dict[str, np.ndarray]:
    """n, mean, sd (0 for one time), least and largest time of every variant and sample; sums are about a centre for each variant."""

    def look(times, v, own):
        y = times - centre[v]
        return np.broadcast_to([len(y), y.sum(), (y * y).sum()], (len(own), 3)), np.broadcast_to(times[:1], (len(own), 1)), np.broadcast_to(times[-1:], (len(own), 1))

    add, low, high = passed(index, look, (3, 1, 1))
    n, s, ss = np.moveaxis(add, 2, 0)
    with np.errstate(invalid="ignore", divide="ignore"):
        sd = np.where(n > 1, np.sqrt(np.maximum(ss - s * s / n, 0) / (n - 1)), 0.0)
        return {"n": n, "mean": s / n + centre[:, None], "sd": sd, "least": low[..., 0], "most": high[..., 0]}


def beside(times: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The times before and from each place on; infinite beyond the ends."""
    padded = np.concatenate(([-np.inf], times, [np.inf]))
    return padded[at], padded[at + 1]


def time_probe(values: np.ndarray) -> Look:
    """For values (variants, samples, width): how many times are at most each value, the next larger time and the last that is not."""

    def look(times, v, own):
        at = np.searchsorted(times, values[v, own].ravel(), "right").reshape(len(own), -1)
        before, after = beside(times, at)
        return at, after, before

    return look


def deviation_probe(values: np.ndarray, middle: np.ndarray) -> Look:
    """The same for the absolute deviations of times from a middle (variants, samples)."""

    def look(times, v, own):
        x, m = values[v, own], middle[v, own][:, None]
        high = np.searchsorted(times, (m + x).ravel(), "right").reshape(x.shape)
        low = np.searchsorted(times, (m - x).ravel(), "left").reshape(x.shape)
        # a sum and a difference may be rounded to different sides: the difference decides
        while True:
            h0, h1 = beside(times, high)
            l0, l1 = beside(times, low)
            up, down, left, right = h1 - m <= x, h0 - m > x, m - l0 <= x, m - l1 > x
            if not (up | down | left | right).any():
                break
            high, low = high + up - (down & ~up), low - left + (right & ~left)
        inside = high > low
        over = np.where(inside, np.maximum(h0 - m, m - l1), -np.inf)
        return np.maximum(high - low, 0), np.minimum(h1 - m, m - l0), over

    return look


def selected(index: TrialIndex, ranks: np.ndarray, least: np.ndarray, most: np.ndarray, probe: Callable[[np.ndarray], Look]) -> np.ndarray:
    """The values of the given ranks (variants, samples, r), each somewhere from least to most: brackets are narrowed until they close."""
    shape, r = index.shape, ranks.shape[2]
    a, b = np.repeat(least[..., None], r, 2), np.repeat(most[..., None], r, 2)
    c = int(np.clip(PROBES // max(1, shape[0] * shape[1] * r), FEWEST, MOST))
    while (a < b).any():
        # infinite times lie beyond every value that is asked for
        begin, end = np.clip(a, -LARGEST, LARGEST), np.clip(b, -LARGEST, LARGEST)
        inner = begin[..., None] + (end - begin)[..., None] * (np.arange(c) / c)
        values = inner.reshape(*shape, r * c)
        count, after, before = (x.reshape(*shape, r, c) for x in passed(index, probe(values), (r * c,) * 3))
        # the first value with enough times up to it ends the bracket, the one before it begins it
        enough = count >= ranks[..., None]
        j = np.where(enough.any(-1), enough.argmax(-1), c)
        take = lambda x, i: np.take_along_axis(x, np.clip(i, 0, c - 1)[..., None], -1)[..., 0]
        b, a = np.where(j < c, np.minimum(take(before, j), b), b), np.where(j > 0, np.maximum(take(after, j - 1), a), a)
        a = np.minimum(a, b)
    return b


def medians(index: TrialIndex, about: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Median and median absolute deviation (variants, samples); not a number for samples without times."""
    n = about["n"].astype(np.int64)
    ranks = np.stack(((n + 1) // 2, n // 2 + 1), 2)
    there = n > 0
    least, most = (np.where(there, about[k], 0.0) for k in ("least", "most"))
    middle = selected(index, np.where(there[..., None], ranks, 0), least, most, time_probe).mean(2)
    away = np.maximum(most - middle, middle - least)
    off = selected(index, np.where(there[..., None], ranks, 0), np.zeros_like(away), away, lambda values: deviation_probe(values, middle)).mean(2)
    return np.where(there, middle, np.nan), np.where(there, off, np.nan)


def bounds(index: TrialIndex, effects: DataFrame, rules: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper fence (variants, samples, rules), both inclusive; infinite where a rule keeps everything."""
    kinds = [r.partition("_")[0] for r in rules]
    if unknown := {r for r, k in zip(rules, kinds, strict=True) if k not in ("none", "range", "sd", "mad")}:
        raise ValueError(f"unknown outlier rules: {sorted(unknown)}")
    low, high = np.full((*index.shape, len(rules)), -np.inf), np.full((*index.shape, len(rules)), np.inf)
    about, m = {}, {}
    if {"sd", "mad"} & set(kinds):
        mean = {r[0]: r[1] for r in effects.where(~F.isnan("rt")).groupBy("strip_method").agg(F.avg("rt")).collect()}
        about = summary(index, np.array([mean.get(s) or 0.0 for s in index.strips]))
        m["sd"] = about["mean"], about["sd"]
    if "mad" in kinds:
        m["mad"] = medians(index, about)
    for i, (rule, kind) in enumerate(zip(rules, kinds, strict=True)):
        if kind == "range":
            low[..., i], high[..., i] = 200.0, float(rule[6:])
        elif kind in m:
            middle, spread = m[kind]
            low[..., i], high[..., i] = middle - float(rule.partition("_")[2]) * spread, middle + float(rule.partition("_")[2]) * spread
    return low, high


def labelled(index: TrialIndex, df: DataFrame) -> DataFrame:
    """df (variant, at, ...) with the sample's keys and the variant's name in their place."""
    names = df.sparkSession.createDataFrame([(i, *s) for i, s in enumerate(index.samples)], "at int, sample_size double, sample string, subsample_id int")
    rest = [c for c in df.columns if c not in ("variant", "at")]
    return df.join(F.broadcast(names), "at").select(*KEYS, F.element_at(F.array(*map(F.lit, index.strips)), F.col("variant") + 1).alias("strip_method"), *rest)


def fences(index: TrialIndex, effects: DataFrame, rules: Sequence[str]) -> DataFrame:
    """(sample_size, sample, subsample_id, strip_method, outlier, lo, hi) as `sampling.fences` has them; null bounds keep everything."""
    low, high = bounds(index, effects, rules)
    finite = lambda x: float(x) if np.isfinite(x) else None
    rows = [(v, s, rule, finite(low[v, s, i]), finite(high[v, s, i])) for v in range(index.shape[0]) for s in range(index.shape[1]) for i, rule in enumerate(rules)]
    return labelled(index, effects.sparkSession.createDataFrame(rows, "variant int, at int, outlier string, lo double, hi double"))


#: Where the model's times begin (exclusive) in each transformation: both the time and its logarithm have to be above 0.
FLOORS = {"no_log_rt": 0.0, "log_rt": 1.0}


def grid_stats(index: TrialIndex, effects: DataFrame, rules: Sequence[str], transforms: Sequence[str]) -> DataFrame:
    """(sample keys, strip_method, outlier, transformation, participant_id, cong, prev_cong, n, sy, syy) of every branch, from two searches a fence."""
    low, high = bounds(index, effects, rules)
    rules, transforms = tuple(rules), tuple(transforms)
    person = index.rows.schema["participant_id"]

    def run(batches):
        for batch in freed(batches):
            lists = (lists_of(batch, c) for c in ("samples", "times", "cells"))
            for i, (v, own, times, cells) in enumerate(zip(batch.column("variant").to_pylist(), *lists, strict=True)):
                first = np.searchsorted(times, low[v, own].ravel(), "left").reshape(len(own), -1)
                end = np.minimum(np.searchsorted(times, high[v, own].ravel(), "right").reshape(len(own), -1), np.searchsorted(times, np.inf, "left"))
                out = []
                for t, name in enumerate(transforms):
                    floor = int(np.searchsorted(times, FLOORS[name], "right"))
                    y = np.zeros(len(times))
                    y[floor:] = np.log(times[floor:]) if name == "log_rt" else times[floor:]
                    y[~np.isfinite(y)] = 0.0
                    # three prefix sums for each cell; all are positive and rise, so extreme times, which come last, don't blur the sums before them
                    sums = np.zeros((len(times) + 1, 4, 3))
                    for c in range(4):
                        own_cell = cells == c
                        sums[1:, c, 0] = np.cumsum(own_cell)
                        sums[1:, c, 1] = np.cumsum(np.where(own_cell, y, 0.0))
                        sums[1:, c, 2] = np.cumsum(np.where(own_cell, y * y, 0.0))
                    begin = np.maximum(first, floor)
                    got = sums[np.maximum(end, begin)] - sums[begin]
                    s, r, c = np.nonzero(got[..., 0] > 0)
                    out.append((own[s], r, np.full(len(s), t), c, *got[s, r, c].T))
                at, r, t, c, n, sy, syy = map(np.concatenate, zip(*out, strict=True))
                codes = np.array(CELLS)[c]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), v), pa.int32()), pa.array(at, pa.int32()), pa.array(r, pa.int32()), pa.array(t, pa.int32()), batch.column("participant_id").take(pa.array(np.full(len(at), i))),
                     pa.array(codes[:, 0], pa.int32()), pa.array(codes[:, 1], pa.int32()), pa.array(n.astype(np.int64)), pa.array(sy), pa.array(syy)],
                    ["variant", "at", "rule", "transform", "participant_id", "cong", "prev_cong", "n", "sy", "syy"])

    got = index.rows.mapInArrow(run, f"variant int, at int, rule int, transform int, participant_id {person.dataType.simpleString()}, cong int, prev_cong int, n long, sy double, syy double")
    if index.split:
        got = got.groupBy("variant", "at", "rule", "transform", "participant_id", "cong", "prev_cong").agg(F.sum("n").alias("n"), F.sum("sy").alias("sy"), F.sum("syy").alias("syy"))
    name = lambda c, names: F.element_at(F.array(*map(F.lit, names)), F.col(c) + 1)
    return labelled(index, got.select("variant", "at", name("rule", rules).alias("outlier"), name("transform", transforms).alias("transformation"), "participant_id", "cong", "prev_cong", "n", "sy", "syy"))
