"""Approximate nearest neighbours by cross-polytope hashing.

A unit vector is turned by a fast pseudo-rotation (three rounds of random signs and a Hadamard transform) and goes to the
nearest signed axis: one of twice as many buckets as dimensions, for each of TABLES rotations. A query looks into the PROBES
buckets whose axes are nearest to it in each table; every candidate found there is scored exactly, on the original vectors.

Few tables with many probes find as much as many tables with few, and a vector is sent once for each table. The buckets of a
table lie in SLOTS slots, so a query is sent once for each slot that it probes and not for each bucket.

Scores are compared as they are; parallel vectors are made the same numbers first, and tie. Equal vectors are one candidate with
its k + 1 smallest ids, so copies can't crowd a bucket; slots that hold many rows are
dealt over several groups, and so are a slot's queries. Queries for which too few candidates turn up are run again over all
buckets of one table, which is every vector there is.

Cases: vectors that are null, zero or hold null or non-finite components take no part (neither as queries nor as
candidates); vectors meet only vectors of their own length; ties go to the smaller id; rows that carry the query's own id
are not its neighbours; a null id can be neither; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from specgrid.llm.common import saved, small, table

TABLES = 2
PROBES = 48
SLOTS = 16
#: Rows and queries of one slot that meet in one group; larger slots are dealt over several.
GROUP_ROWS = 20_000
GROUP_QUERIES = 4_000
#: Places to which scores are compared, and the same as a difference.
TIE = 1e-12
SEED = 7


def hadamard(x: np.ndarray) -> np.ndarray:
    """Rows times the normalised Hadamard matrix, in n log n steps."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def rotated(x: np.ndarray, number: int) -> np.ndarray:
    """The vectors turned by pseudo-rotation `number`, padded with zeros to a power of two."""
    n = 1 << max(0, x.shape[1] - 1).bit_length()
    x = np.pad(x, ((0, 0), (0, n - x.shape[1])))
    for signs in np.random.default_rng((SEED, number, n)).choice((-1.0, 1.0), (3, n)):
        x = hadamard(x * signs)
    return x


def axes(x: np.ndarray, number: int, probes: int) -> np.ndarray:
    """The signed axes nearest to each vector, nearest first: i for +e_i, n + i for -e_i."""
    y = rotated(x, number)
    y = np.concatenate([y, -y], axis=1)
    return np.argsort(-y, axis=1, kind="stable")[:, :probes] if probes > 1 else np.argmax(y, axis=1)[:, None]


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def hashed(rows: DataFrame, tables: int, probes: int | None, payload: bool = True) -> DataFrame:
    """rows (tag, v) once for each table and slot with probed buckets, as (dims, tab, slot) and, with payload, (tag, buckets, v).

    buckets and v are arrays of int32 and of the vectors' own numbers, as bytes; probes None: all buckets.
    """
    kind, tag = number_type(rows), rows.schema["tag"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            length = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(kind)
            begin = np.concatenate(([0], np.cumsum(length)))
            for d in np.unique(length):
                own = np.flatnonzero(length == d)
                v = flat[begin[own][:, None] + np.arange(d)]
                blobs = pa.array([x.tobytes() for x in v] if payload else [], pa.binary())
                x = v.astype(np.float64)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                for number in range(tables):
                    near = axes(x, number, 1 << 30 if probes is None else probes).astype(np.int32)
                    near = np.take_along_axis(near, np.argsort(near % SLOTS, axis=1, kind="stable"), axis=1)
                    first = np.ones(near.shape, bool)
                    first[:, 1:] = near[:, 1:] % SLOTS != near[:, :-1] % SLOTS
                    take, slot = np.nonzero(first)[0], near[first] % SLOTS
                    columns = [pa.array(np.full(len(take), x, np.int32)) for x in (d, number)] + [pa.array(slot)]
                    if payload:
                        buckets = np.split(near.ravel(), np.flatnonzero(first.ravel())[1:])
                        columns += [batch.column(0).take(pa.array(own[take])), pa.array([y.tobytes() for y in buckets], pa.binary()), blobs.take(pa.array(take))]
                    yield pa.RecordBatch.from_arrays(columns, ["dims", "tab", "slot", "tag", "buckets", "v"][: len(columns)])

    return rows.select("tag", "v").mapInArrow(run, "dims int, tab int, slot int" + f", tag {tag}, buckets binary, v binary" * payload)


def number_type(rows: DataFrame) -> np.dtype:
    return np.dtype("<f4") if rows.schema["v"].dataType.elementType == T.FloatType() else np.dtype("<f8")


def kth(near: np.ndarray, first: np.ndarray, ids: list[list[int]], me: int, k: int) -> float:
    """The score by which k different ids other than me are reached, -inf if there are fewer; first are the k best rows."""
    while True:
        found = set()
        for j in first[np.argsort(-near[first], kind="stable")]:
            if near[j] > -np.inf:
                found.update(ids[j])
                if len(found) - (me in found) >= k:
                    return near[j]
        if len(first) == len(near):
            return -np.inf
        n = min(4 * len(first), len(near))
        first = np.argpartition(-near, n - 1)[:n]


def best_of(q: np.ndarray, asked: list[int], x: np.ndarray, ids: list[list[int]], k: int) -> list[dict[int, float]]:
    """For each query the scores of the k best of the other ids, and of all that tie with the last of them, each by its best row."""
    norm = np.sqrt((x * x).sum(axis=1))
    close = max(TIE, 8 * x.shape[1] * np.finfo(np.float64).eps)
    alone = defaultdict(list)
    for j, own in enumerate(ids):
        if len(own) == 1:
            alone[own[0]].append(j)
    found = []
    for at in range(0, len(q), 256):
        part, asker = q[at : at + 256], asked[at : at + 256]
        length = np.sqrt((part * part).sum(axis=1))
        near = (part @ x.T) / norm / length[:, None]
        for i, me in enumerate(asker):
            if me in alone:
                near[i, alone[me]] = -np.inf
        first = np.argpartition(-near, min(k, len(x)) - 1, axis=1)[:, :k]
        # rounding moves a score by less than `close`, so no row of the k best or equal to the last of them is left out
        least = np.array([kth(near[i], first[i], ids, me, k) for i, me in enumerate(asker)]) - close
        which, rows_of = np.nonzero((near >= least[:, None]) & (near > -np.inf))
        for i, own in enumerate(np.split(rows_of, np.searchsorted(which, np.arange(1, len(part))))):
            # once more, with the same order of additions for every pair, so that equal pairs score equally
            exact = (part[i] * x[own]).sum(axis=1) / (length[i] * norm[own])
            best = {}
            for j, s in zip(own, exact.tolist(), strict=True):
                for vec in ids[j]:
                    if vec != asker[i] and s > best.get(vec, -np.inf):
                        best[vec] = s
            found.append(best)
    return found


def found_in_buckets(base: DataFrame, queries: DataFrame, k: int, tables: int, probes: int | None) -> DataFrame:
    """(query_id, vec_id, score): for each slot in which a query probes buckets, the k best of the other ids in them, each by its best row."""
    kind, slot = number_type(base), ["dims", "tab", "slot"]
    # a few rows for each length of vectors: SLOTS * tables
    sizes = hashed(base, tables, 1, payload=False).groupBy(*slot).agg(F.ceil(F.count("*") / GROUP_ROWS).cast("int").alias("parts"))
    calls = hashed(queries, tables, probes, payload=False).groupBy(*slot).agg(F.ceil(F.count("*") / GROUP_QUERIES).cast("int").alias("turns"))
    both = small(saved(sizes.join(calls, slot)))
    rows = hashed(base, tables, 1).join(both, slot).withColumn("part", F.pmod(F.xxhash64("v"), F.col("parts")).cast("int")).withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)))
    asked = hashed(queries, tables, probes).join(both, slot).withColumn("turn", F.pmod(F.xxhash64("tag"), F.col("turns")).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    key = [*slot, "part", "turn"]

    def score(left, right):
        out = [], [], []
        if len(left) and len(right):
            q, x = (np.frombuffer(b"".join(t.column("v").to_pylist()), kind).astype(np.float64).reshape(len(t), -1) for t in (left, right))
            # by the largest component, so that a vector and its multiples are the same numbers and score the same
            q, x = (v / np.abs(v).max(axis=1, keepdims=True) for v in (q, x))
            asked_id, ids = left.column("tag").to_pylist(), right.column("tag").to_pylist()
            bucket = np.frombuffer(b"".join(right.column("buckets").to_pylist()), np.int32)
            probing = defaultdict(list)
            for i, blob in enumerate(left.column("buckets").to_pylist()):
                for b in np.frombuffer(blob, np.int32).tolist():
                    probing[b].append(i)
            best = defaultdict(dict)
            for b in np.unique(bucket).tolist():
                at, who = np.flatnonzero(bucket == b), probing[b]
                for i, own in zip(who, best_of(q[who], [asked_id[i] for i in who], x[at], [ids[j] for j in at], k), strict=True):
                    for vec, s in own.items():
                        if s > best[i].get(vec, -np.inf):
                            best[i][vec] = s
            for i, own in best.items():
                for vec, s in heapq.nsmallest(k, own.items(), key=lambda item: (-item[1], item[0])):
                    out[0].append(asked_id[i])
                    out[1].append(vec)
                    out[2].append(s)
        return pa.Table.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["query_id", "vec_id", "score"])

    sent = [*key, "tag", "buckets", "v"]
    return asked.select(*sent).groupBy(*key).cogroup(rows.select(*sent).groupBy(*key)).applyInArrow(score, "query_id long, vec_id long, score double")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, tables: int = TABLES, probes: int | None = PROBES) -> DataFrame:
    """(query_id, rank, vec_id, score) from rows (vec_id, v) of both: each query's k nearest by cosine."""
    good = vectors.where(usable(F.col("v")) & F.col("vec_id").isNotNull())
    few = good.select("vec_id", "v").distinct().withColumn("nth", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("nth") <= k + 1)
    base = saved(few.groupBy("v").agg(F.array_sort(F.collect_set("vec_id")).alias("tag")).select("tag", "v"))
    asked = saved(queries.where(usable(F.col("v")) & F.col("vec_id").isNotNull()).select(F.col("vec_id").alias("tag"), "v"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def best(found):
        one = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        return one.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    got = saved(best(found_in_buckets(base, asked, k, tables, probes)))
    full = got.groupBy("query_id").count().where(F.col("count") >= k).select(F.col("query_id").alias("tag"))
    left = asked.join(full, "tag", "left_anti")
    if probes is not None and not left.isEmpty():
        left = saved(left)
        more = best(found_in_buckets(base, left, k, 1, None))
        got = got.join(left.select(F.col("tag").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(more)
    return got.select("query_id", "rank", "vec_id", "score")


def op7_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every vector whose id is divisible by 50."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long"), F.col("embedding").alias("v"))
    return nearest(rows, rows.where(F.col("vec_id") % 50 == 0))
