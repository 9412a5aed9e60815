"""Reversible line dedup: sharded cuckoo filters in front of exact reference-count tables.

A line's key is the line without white space at its ends and with A-Z in lower case; keys shorter than 10 characters are not
looked at. Keys are known by 128-bit digests, and a digest's shard by a part of it. An index holds three tables, each written in versions:

- lines: for every inserted document the digests of its keys, and the ids of deleted documents;
- filters: for every shard a cuckoo filter with one fingerprint for each key that any document holds;
- references: for every key that was held by two documents or more, how many hold it and the smallest id among them.

Inserting documents sends the digests of a task, added up by key, to their shards. There the filter tells apart keys that are
surely new and held once, for which one fingerprint is put in and nothing else is done, and those that may be held already:
by a document of the same batch, which are counted exactly on the spot, or by an earlier one, which are counted exactly in the
lines table. Deleting documents counts their keys again in the lines table, and takes the fingerprints of those out that nobody holds any
more. So after any insertions and deletions the index is what the documents left would have made. A version
counts once it stands in the log, which is written last; a job that is lost on the way leaves nothing behind that is read.

The smallest id that holds a key keeps all its lines with it, the others lose theirs.

Cases: a null or empty text is one empty line; rows of one id are one document; rows without id are one document, after all
others, which can't be deleted; inserting an id again adds to its lines; lines are bytes, so invalid UTF-8 is kept as it is;
a line that all documents hold is one row for each task on the way to its shard, and is joined by broadcast when it is
looked up (how many such lines there can be is bounded); an empty table changes nothing; columns named like an added one are replaced.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from specgrid.llm.common import LOWER_AZ, SPACE, parts, saved, scratch, small, table, utf8

#: Code points of a key at least.
LEAST_CHARS = 10
#: Keys of a shard on average when an index is made, and the fewest shards.
SHARD_KEYS, LEAST_SHARDS = 1 << 16, 64
#: Key rows that a task adds up at once.
CHUNK = 400_000
#: Keys held by more than a share of 1/HOT of all rows of repeated keys are joined by broadcast: fewer than HOT of them.
HOT = 50_000
#: Bytes of dropped keys that are broadcast at most; beyond that they are joined to their documents by a shuffle.
BROADCAST_BYTES = 32 << 20
#: Stands for a null id, so that it comes last.
NO_ID = np.iinfo(np.int64).max


# --- cuckoo filter


class CuckooFilter:
    """Fingerprints of 16 bits in buckets of four, each in one of two buckets; layers are added as keys come in.

    Every added key has a fingerprint of its own, so one can be removed without losing another's. There are no false negatives.
    """

    SLOTS, LOAD, ROUNDS = 4, 0.8, 300

    def __init__(self, layers: list[bytes] = ()):
        self.layers = [np.frombuffer(x, np.uint16).reshape(-1, self.SLOTS).copy() for x in layers]

    def dump(self) -> list[bytes]:
        return [x.tobytes() for x in self.layers]

    @staticmethod
    def other(buckets: np.ndarray, prints: np.ndarray, size: int) -> np.ndarray:
        """The second bucket of a fingerprint that may be in the first one, and the other way round."""
        return buckets ^ ((prints.astype(np.int64) * 0x5BD1E995 >> 7) & (size - 1))

    @classmethod
    def places(cls, keys: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprint and both buckets of 64-bit keys in a layer of `size` buckets, a power of two."""
        keys = keys.astype(np.uint64)
        prints = np.maximum(keys >> np.uint64(48), np.uint64(1)).astype(np.uint16)
        first = (keys & np.uint64(size - 1)).astype(np.int64)
        return prints, first, cls.other(first, prints, size)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        found = np.zeros(len(keys), bool)
        for layer in self.layers:
            prints, first, second = self.places(keys, len(layer))
            found |= (layer[first] == prints[:, None]).any(axis=1) | (layer[second] == prints[:, None]).any(axis=1)
        return found

    def alike(self, keys: np.ndarray) -> np.ndarray:
        """Which of the keys share their fingerprint with another one here: what finding out one after the other would tell, and the first of each."""
        prints = np.maximum(keys.astype(np.uint64) >> np.uint64(48), np.uint64(1))
        # buckets differ wherever these bits differ, however large a layer is made
        pairs = prints << np.uint64(48) | (keys.astype(np.uint64) & np.uint64(0xFFFF))
        _, group, n = np.unique(pairs, return_inverse=True, return_counts=True)
        return n[group] > 1

    def add(self, keys: np.ndarray) -> None:
        if not len(keys):
            return
        if not self.layers or np.count_nonzero(self.layers[-1]) + len(keys) > self.LOAD * self.layers[-1].size:
            size = 1 << max(6, int(np.ceil(np.log2(len(keys) / self.LOAD / self.SLOTS))))
            self.layers.append(np.zeros((size, self.SLOTS), np.uint16))
        prints, bucket, _ = self.places(keys, len(self.layers[-1]))
        while True:
            prints, bucket = self.settle(self.layers[-1], prints, bucket)
            if not len(prints):
                return
            # what finds no place goes to a further layer of the same size, where its buckets are the same
            self.layers.append(np.zeros_like(self.layers[-1]))

    def settle(self, layer: np.ndarray, prints: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Puts fingerprints into their buckets, round by round; one of those that find a bucket full drives a resident out, the rest go to their other bucket."""
        for turn in range(self.ROUNDS):
            order = np.argsort(bucket, kind="stable")
            prints, bucket = prints[order], bucket[order]
            rank = np.arange(len(bucket)) - np.searchsorted(bucket, bucket)
            free = layer[bucket] == 0
            fits = rank < free.sum(axis=1)
            slot = ((np.cumsum(free, axis=1) == rank[:, None] + 1) & free).argmax(axis=1)
            layer[bucket[fits], slot[fits]] = prints[fits]
            prints, bucket = prints[~fits], bucket[~fits]
            if not len(prints):
                break
            drives = np.concatenate(([True], bucket[1:] != bucket[:-1])) & (turn % 2 == 1)
            at = (bucket[drives], np.full(drives.sum(), turn // 2 % self.SLOTS))
            layer[at], prints[drives] = prints[drives], layer[at]
            bucket = self.other(bucket, prints, len(layer))
        return prints, bucket

    def remove(self, keys: np.ndarray) -> None:
        """Takes one fingerprint out for each key, which must be in."""
        for key in keys:
            for layer in self.layers:
                prints, first, second = self.places(np.array([key]), len(layer))
                at = next(((b, s) for b in (first[0], second[0]) for s in range(self.SLOTS) if layer[b, s] == prints[0]), None)
                if at is not None:
                    layer[at] = 0
                    break


# --- lines


def key_of(line: bytes) -> tuple[int, int] | None:
    """The digest of a line's key as two numbers; null if the key is too short."""
    key = line.strip(SPACE).translate(LOWER_AZ)
    if len(key) < LEAST_CHARS or len(key) < 4 * LEAST_CHARS and not key.isascii() and sum(b & 0xC0 != 0x80 for b in key) < LEAST_CHARS:
        return None
    return struct.unpack("<qq", hashlib.blake2b(key, digest_size=16).digest())


def line_keys(docs: DataFrame) -> DataFrame:
    """(doc_id, hi, lo): each row's distinct keys as two lists of numbers."""

    def read(batches):
        for batch in parts(batches):
            ends, hi, lo = [0], [], []
            for text in batch.column(1).to_pylist():
                for a, b in dict.fromkeys(map(key_of, (text or b"").split(b"\n"))).keys() - {None}:
                    hi.append(a)
                    lo.append(b)
                ends.append(len(hi))
            lists = (pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int64())) for x in (hi, lo))
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], ["doc_id", "hi", "lo"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("text")).mapInArrow(read, "doc_id long, hi array<long>, lo array<long>")


def summed(hi: np.ndarray, lo: np.ndarray, refs: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """One row for each key: its references added up and its smallest id."""
    order = np.lexsort((lo, hi))
    hi, lo, refs, first = hi[order], lo[order], refs[order], first[order]
    at = np.flatnonzero(np.concatenate(([True], (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])))) if len(hi) else np.zeros(0, np.int64)
    return (hi[at], lo[at], np.add.reduceat(refs, at), np.minimum.reduceat(first, at)) if len(hi) else (hi, lo, refs, first)


KEYS = "hi long, lo long, refs long, first long"


def key_rows(lines: DataFrame) -> DataFrame:
    """(hi, lo, refs, first): keys of documents, added up within tasks, so that a key comes once from each of a task's chunks."""

    def add_up(batches):
        held, n = [], 0
        for batch in batches:
            hi, sizes = batch.column("hi"), pc.list_value_length(batch.column("hi")).to_numpy()
            ids = np.repeat(batch.column("doc_id").fill_null(NO_ID).to_numpy(), sizes)
            held.append((hi.flatten().to_numpy(), batch.column("lo").flatten().to_numpy(), np.ones(len(ids), np.int64), ids))
            n += len(ids)
            if n >= CHUNK:
                yield rows(held)
                held, n = [], 0
        if held:
            yield rows(held)

    def rows(held):
        return pa.RecordBatch.from_arrays([pa.array(x) for x in summed(*map(np.concatenate, zip(*held, strict=True)))], ["hi", "lo", "refs", "first"])

    return lines.mapInArrow(add_up, KEYS)


def shard_of(shards: int) -> Column:
    return F.pmod("hi", F.lit(shards)).cast("int")


MET = "shard int, hi long, lo long, refs long, first long, known boolean, layer int, cells binary"


def column(t: pa.Table, name: str) -> np.ndarray:
    return t.column(name).combine_chunks().to_numpy()


def answer(shard: int, keys: tuple[np.ndarray, ...], known: np.ndarray, cuckoo: CuckooFilter) -> pa.Table:
    """Key rows and filter layers of a shard, in one table."""
    layers, n = cuckoo.dump(), len(known)
    pad = lambda x, kind: pa.concat_arrays([pa.array(x, kind), pa.nulls(len(layers), kind)])
    return pa.Table.from_arrays(
        [pa.array([shard] * (n + len(layers)), pa.int32()), *(pad(x, pa.int64()) for x in keys), pad(known, pa.bool_()),
         pa.array([None] * n + list(range(len(layers))), pa.int32()), pa.array([None] * n + layers, pa.binary())],
        ["shard", "hi", "lo", "refs", "first", "known", "layer", "cells"])


def filter_in(filters: pa.Table) -> CuckooFilter:
    return CuckooFilter([x for _, x in sorted(zip(filters.column("layer").to_pylist(), filters.column("cells").to_pylist(), strict=True))])


def meet(key, rows: pa.Table, filters: pa.Table) -> pa.Table:
    """A shard's new keys against its filter: exact counts of those that may be held more than once, and the filter with all that are new."""
    cuckoo = filter_in(filters)
    hi, lo, refs, first = (column(rows, c) for c in ("hi", "lo", "refs", "first"))
    known = cuckoo.contains(lo)
    again = known | cuckoo.alike(lo) | (refs > 1)
    held = summed(hi[again], lo[again], refs[again], first[again])
    was = cuckoo.contains(held[1])
    cuckoo.add(np.concatenate((lo[~again], held[1][~was])))
    told = was | (held[2] > 1)
    return answer(key[0].as_py(), tuple(x[told] for x in held), was[told], cuckoo)


def put_in(key, rows: pa.Table, filters: pa.Table) -> pa.Table:
    cuckoo = filter_in(filters)
    cuckoo.add(column(rows, "lo"))
    return answer(key[0].as_py(), (np.zeros(0, np.int64),) * 4, np.zeros(0, bool), cuckoo)


def take_out(key, rows: pa.Table, filters: pa.Table) -> pa.Table:
    cuckoo = filter_in(filters)
    cuckoo.remove(column(rows, "lo"))
    return answer(key[0].as_py(), (np.zeros(0, np.int64),) * 4, np.zeros(0, bool), cuckoo)


class LineIndex:
    """The index in a folder that driver and executors share. Documents have the columns doc_id and text."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.log = self._log()

    def _log(self) -> list[tuple[int, str, int]]:
        try:
            return sorted(map(tuple, self.spark.read.schema("version long, kind string, shards long").parquet(f"{self.path}/log").collect()))
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return []
            raise

    @property
    def version(self) -> int:
        return self.log[-1][0] if self.log else 0

    @property
    def shards(self) -> int | None:
        return self.log[-1][2] if self.log else None

    def _write(self, df: DataFrame, name: str, version: int) -> DataFrame:
        """A version of a table; one that a lost job began is replaced."""
        to = f"{self.path}/{name}/{version}"
        df.write.mode("overwrite").parquet(to)
        return self.spark.read.schema(df.schema).parquet(to)

    def _read(self, name: str, schema: str, kinds: tuple[str, ...] = ("insert", "delete")) -> DataFrame:
        """All versions of a table, with their numbers."""
        found = self.spark.createDataFrame([], f"{schema}, version long")
        for version, kind, _ in self.log:
            if kind in kinds:
                found = found.unionByName(self.spark.read.schema(schema).parquet(f"{self.path}/{name}/{version}").withColumn("version", F.lit(version).cast("long")))
        return found

    def _commit(self, kind: str, shards: int, references: DataFrame, filters: DataFrame) -> None:
        version = self.version + 1
        self._write(references, "references", version)
        self._write(filters, "filters", version)
        row = self.spark.createDataFrame([(version, kind, shards)], "version long, kind string, shards long")
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/log")
        self.log.append((version, kind, shards))

    def lines(self) -> DataFrame:
        """(doc_id, hi, lo) of all documents that are in: those inserted after they were last deleted."""
        rows = self._read("lines", "doc_id long, hi array<long>, lo array<long>", ("insert",))
        if any(kind == "delete" for _, kind, _ in self.log):
            gone = self._read("gone", "doc_id long", ("delete",)).groupBy("doc_id").agg(F.max("version").alias("gone"))
            rows = rows.join(small(saved(gone)), "doc_id", "left").where(F.col("gone").isNull() | (F.col("gone") < F.col("version")))
        return rows.select("doc_id", "hi", "lo")

    def filters(self) -> DataFrame:
        """(shard, layer, cells): the latest filter of every shard."""
        rows = self._read("filters", "shard int, layer int, cells binary")
        latest = rows.groupBy("shard").agg(F.max("version").alias("version"))
        return rows.join(latest, ["shard", "version"]).select("shard", "layer", "cells")

    def references(self) -> DataFrame:
        """(hi, lo, refs, first) of all keys that two documents or more hold; first is null for documents without id."""
        rows = self._read("references", KEYS)
        if len(self.log) > 1:
            rows = rows.groupBy("hi", "lo").agg(F.max(F.struct("version", "refs", "first")).alias("x")).select("hi", "lo", "x.refs", "x.first")
        return rows.where(F.col("refs") > 1).select("hi", "lo", "refs", F.when(F.col("first") != NO_ID, F.col("first")).alias("first"))

    def _counted(self, keys: DataFrame, lines: DataFrame) -> DataFrame:
        """(hi, lo, refs, first) of the given keys, exactly, in lines."""
        rows = key_rows(lines).join(small(keys.select("hi", "lo")), ["hi", "lo"], "left_semi")
        return rows.groupBy("hi", "lo").agg(F.sum("refs").alias("refs"), F.min("first").alias("first"))

    def insert(self, docs: DataFrame) -> None:
        earlier = self.lines() if self.log else None
        lines = self._write(line_keys(docs), "lines", self.version + 1)
        shards = self.shards or max(LEAST_SHARDS, -(-(lines.agg(F.sum(F.size("hi"))).first()[0] or 0) // SHARD_KEYS))
        filters = self.filters() if self.log else self.spark.createDataFrame([], "shard int, layer int, cells binary")
        met = key_rows(lines).withColumn("shard", shard_of(shards)).groupBy("shard").cogroup(filters.groupBy("shard")).applyInArrow(meet, MET)
        met = saved(met)
        keys, new = met.where(F.col("layer").isNull()), met.where(F.col("layer").isNotNull()).select("shard", "layer", "cells")
        if earlier is not None:
            known = saved(keys.where("known").select("shard", "hi", "lo", F.col("refs").alias("more"), F.col("first").alias("least")))
            held = saved(self._counted(known, earlier))
            both = saved(known.join(held, ["hi", "lo"], "left"))
            # the filter was wrong about those that nobody holds: they are put in as well
            wrong = both.where(F.col("refs").isNull()).select("shard", "hi", "lo")
            if wrong.limit(1).count():
                patched = saved(wrong.groupBy("shard").cogroup(new.groupBy("shard")).applyInArrow(put_in, MET)).select("shard", "layer", "cells")
                new = saved(patched.where(F.col("layer").isNotNull()))
            told = both.select("hi", "lo", (F.coalesce("refs", F.lit(0)) + F.col("more")).alias("refs"), F.least(F.coalesce("first", "least"), "least").alias("first"))
            keys = keys.where("not known").select("hi", "lo", "refs", "first").unionByName(told)
        self._commit("insert", shards, keys.select("hi", "lo", "refs", "first"), new)

    def delete(self, ids: DataFrame) -> None:
        """Takes the documents of the given ids (doc_id) out again; ids that are not in change nothing."""
        if not self.log:
            return
        ids = self._write(ids.select(F.col("doc_id").cast("long").alias("doc_id")).where(F.col("doc_id").isNotNull()).distinct(), "gone", self.version + 1)
        before = saved(self.lines())
        out, left = before.join(small(ids), "doc_id", "left_semi"), before.join(small(ids), "doc_id", "left_anti")
        lost = saved(key_rows(out).groupBy("hi", "lo").agg(F.sum("refs").alias("lost")))
        now = saved(lost.join(self._counted(lost, left), ["hi", "lo"], "left").select("hi", "lo", "lost", F.coalesce("refs", F.lit(0)).alias("refs"), F.coalesce("first", F.lit(NO_ID)).alias("first")))
        free = now.where("refs = 0").select(shard_of(self.shards).alias("shard"), "hi", "lo")
        old = saved(self.filters())
        new = saved(free.groupBy("shard").cogroup(old.groupBy("shard")).applyInArrow(take_out, MET)).select("shard", "layer", "cells")
        self._commit("delete", self.shards, now.where(F.col("refs") + F.col("lost") > 1).select("hi", "lo", "refs", "first"), new)

    def dropped(self) -> DataFrame:
        """(doc_id, keys): the keys whose lines a document loses, for documents that lose any."""
        repeated, rows = saved(self.references()), self.lines().select("doc_id", F.inline(F.arrays_zip("hi", "lo")))
        n, total = repeated.agg(F.count("*"), F.sum("refs")).first()
        # keys of so many references are few, and the rows of any other are few: no key is heavy in the join by shuffle
        heavy = F.col("refs") > F.lit(max(1000, (total or 0) // HOT))
        split = [repeated] if n <= HOT else [repeated.where(heavy), repeated.where(~heavy)]
        found = None
        for i, own in enumerate(split):
            got = rows.join(F.broadcast(own) if i == 0 else own, ["hi", "lo"]).where(~F.col("first").eqNullSafe(F.col("doc_id"))).select("doc_id", "hi", "lo")
            found = got if found is None else found.unionByName(got)
        return found.groupBy("doc_id").agg(F.collect_set(F.struct("hi", "lo")).alias("keys"))

    def apply(self, docs: DataFrame) -> DataFrame:
        """docs with the lines left in text, and n_lines (before), n_dropped."""
        added = ["n_lines", "n_dropped"]
        own = [c for c in docs.columns if c not in added and c != "text"]
        lost = saved(self.dropped().withColumnRenamed("doc_id", "gone_from"))
        size = lost.agg(F.sum(16 * F.size("keys") + 32)).first()[0] or 0
        wide = docs.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("row"), utf8().alias("text"))
        wide = wide.join(F.broadcast(lost) if size <= BROADCAST_BYTES else lost, F.col("row.doc_id").cast("long").eqNullSafe(F.col("gone_from")), "left").select("row", "text", "keys")
        got = wide.mapInArrow(without_lines, T.StructType([wide.schema["row"], *T.StructType.fromDDL("text binary, n_lines long, n_dropped long")]))
        return got.select("row.*", F.col("text").cast("string").alias("text"), *added)


def without_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parts(batches):
        texts, n, dropped = [], [], []
        for text, keys in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            lines = (text or b"").split(b"\n")
            gone = {(k["hi"], k["lo"]) for k in keys or ()}
            left = [x for x in lines if key_of(x) not in gone] if gone else lines
            texts.append(b"\n".join(left))
            n.append(len(lines))
            dropped.append(len(lines) - len(left))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary()), pa.array(n, pa.int64()), pa.array(dropped, pa.int64())], ["row", "text", "n_lines", "n_dropped"])


def op13_cuckoo_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document keeps of its lines, after all documents were inserted into an index."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    index = LineIndex(spark, scratch(spark))
    index.insert(docs)
    return index.apply(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OP13_SQL = f"""
with numbered as (select row_number() over () as d, doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
lines as (select d, doc_id, unnest(ls) as line, unnest(range(len(ls))) as i from numbered),
keyed as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') as k from lines),
repeated as (select k, min(doc_id) as first from keyed where length(k) >= 10 group by k having count(distinct doc_id) + max(case when doc_id is null then 1 else 0 end) >= 2),
judged as (select d, any_value(keyed.doc_id) as doc_id, i, any_value(line) as line, bool_or(repeated.k is not null and first is distinct from keyed.doc_id) as gone
  from keyed left join repeated on keyed.k = repeated.k group by d, i)
select any_value(doc_id) as doc_id, cast(count(*) as bigint) as n_lines, cast(count(*) filter (where gone) as bigint) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '')) as kept_sha256
from judged group by d
"""
