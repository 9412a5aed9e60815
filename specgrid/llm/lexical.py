"""Ranked lexical search: the k best documents of every query under an integer BM25 score, by presence-mask grouping.

Documents are read once into postings of the queries' terms, written to the scratch folder. From these come the number and
length of documents, document frequencies, and the most that a term adds to any document. A task then takes its postings in
blocks of documents. A block holds a bitmap of documents for each term; the bitmaps of a query's terms are transposed into
one mask a document (which terms it holds), and documents of equal masks are a group with one upper bound, the sum of the
most that the mask's terms add. Groups are scored from the highest bound on until the k-th best score found so far lies above
the bounds of all groups left, so what is left out can't be among the best. The best found carry over from block to block, so later blocks score
ever fewer groups. A task sends at most k documents a query, and the k best of those are the result.

Cases: null texts and texts without terms are no documents; terms that no document holds add nothing; rows of one query id
are one query with the terms of all of them, and a null id is an id; rows that repeat a document are ranked each by itself;
equal scores go by ascending id, null ids last; a query without terms, or of terms in no document, has no rows, as has an
empty table; further columns are not looked at. Queries are taken in blocks of about BLOCK_BYTES of text, with a pass over the
documents each; what goes through the driver is a block's terms.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from specgrid.llm.common import ALNUM_AZ, parts, saved, table, utf8

#: Rows of the result for each query.
BEST = 10
#: Bytes of query text that share a pass over the documents.
BLOCK_BYTES = 4 << 20
#: Documents whose bitmaps are made at once, and those that are scored at once at least.
BLOCK_DOCS, SCORED = 4096, 64


def terms_of(text: bytes | None) -> list[bytes]:
    """Maximal runs of letters, digits and characters beyond ASCII, A-Z in lower case."""
    return text.translate(ALNUM_AZ).split() if text else []


def query_blocks(queries: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[dict[object, set[bytes]]]:
    """The terms of every query id, a block of ids at a time; rows of one id are in one block."""
    own = saved(queries.select("item_id", utf8().alias("text")))
    blocks = max(1, -(-(own.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes))
    for i in range(blocks):
        found: dict[object, set[bytes]] = {}
        for item, text in own.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == i).toLocalIterator():
            found.setdefault(item, set()).update(terms_of(text and bytes(text)))
        yield {item: terms for item, terms in found.items() if terms}


def postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tfs): each row's number of terms, and how often it holds those of the vocabulary; written."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def read(batches):
        get = held.value.get
        for batch in parts(batches):
            n, ends, terms, tfs = [], [0], [], []
            for text in batch.column(1).to_pylist():
                ws = terms_of(text)
                counts = Counter(map(get, ws))
                counts.pop(None, None)
                n.append(len(ws))
                terms += counts.keys()
                tfs += counts.values()
                ends.append(len(terms))
            lists = (pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (terms, tfs))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])

    return saved(docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("text")).mapInArrow(read, "doc_id long, n long, terms array<int>, tfs array<int>"))


def impacts(tf: np.ndarray, n: np.ndarray, total: int, length: int) -> np.ndarray:
    """What a term adds to a document before its weight: it grows with the term's share of the document."""
    m = 100 - 90 + 90 * n * total // length
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


class Postings:
    """The postings of a batch as flat arrays: those of document i are terms[edges[i]:edges[i + 1]]."""

    def __init__(self, batch: pa.RecordBatch, total: int, length: int):
        ids, terms = batch.column("doc_id"), batch.column("terms")
        self.null = ids.is_null().to_numpy(zero_copy_only=False)
        self.ids = ids.fill_null(0).to_numpy()
        edges = terms.offsets.to_numpy().astype(np.int64)
        self.edges = edges - edges[0]
        self.terms = terms.flatten().to_numpy()
        self.docs = np.repeat(np.arange(len(ids)), np.diff(self.edges))
        self.impact = impacts(batch.column("tfs").flatten().to_numpy().astype(np.int64), batch.column("n").to_numpy()[self.docs], total, length)


def term_statistics(index: DataFrame, size: int, total: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """How many documents hold each term of the vocabulary, and the largest impact it has on one."""

    def count(batches):
        df, most = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for batch in batches:
            own = Postings(batch, total, length)
            df += np.bincount(own.terms, minlength=size)
            np.maximum.at(most, own.terms, own.impact)
        there = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(df[there]), pa.array(most[there])], ["term", "df", "most"])

    df, most = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for term, n, x in index.mapInArrow(count, "term int, df long, most long").groupBy("term").agg(F.sum("df"), F.max("most")).collect():
        df[term], most[term] = n, x
    return df, most


def distinct_masks(member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For bits (terms, documents): a document of each distinct column, and the number of its column for each document."""
    packed = np.packbits(member, axis=0, bitorder="little")
    packed = np.concatenate((packed, np.zeros((-len(packed) % 4, packed.shape[1]), np.uint8)))
    group = np.zeros(packed.shape[1], np.uint64)
    for i in range(0, len(packed), 4):
        # 32 terms more: the group so far and their bits
        word = np.ascontiguousarray(packed[i : i + 4].T).view("<u4")[:, 0]
        _, first, group = np.unique(group << np.uint64(32) | word, return_index=True, return_inverse=True)
        group = group.astype(np.uint64)
    return first, group.astype(np.int64)


class Block:
    """Bitmaps and impacts of up to BLOCK_DOCS documents. slot is an array over the vocabulary for the block's use."""

    def __init__(self, own: Postings, weight: np.ndarray, slot: np.ndarray):
        self.own, self.slot, self.n = own, slot, len(own.ids)
        self.score = weight[own.terms] * own.impact
        self.here = np.unique(own.terms)
        slot[self.here] = np.arange(len(self.here))
        self.bitmaps = np.zeros((len(self.here), -(-self.n // 8)), np.uint8)
        np.bitwise_or.at(self.bitmaps, (slot[own.terms], own.docs >> 3), (1 << (own.docs & 7)).astype(np.uint8))

    def close(self):
        self.slot[self.here] = -1

    def scores(self, docs: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """The exact scores of documents for the terms marked in `wanted`."""
        sizes = self.own.edges[docs + 1] - self.own.edges[docs]
        of = np.repeat(np.arange(len(docs)), sizes)
        at = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(self.own.edges[docs], sizes)
        counted = wanted[self.own.terms[at]]
        found = np.zeros(len(docs), np.int64)
        np.add.at(found, of[counted], self.score[at[counted]])
        return found

    def search(self, terms: np.ndarray, most: np.ndarray, wanted: np.ndarray, best: Best) -> None:
        """Adds the block's documents for a query's terms to the best found so far; most: the most each term of the vocabulary adds."""
        terms = terms[self.slot[terms] >= 0]
        if not len(terms) or most[terms].sum() < best.least():
            return
        rows = self.bitmaps[self.slot[terms]]
        docs = np.flatnonzero(np.unpackbits(np.bitwise_or.reduce(rows, axis=0), count=self.n, bitorder="little"))
        member = np.unpackbits(rows, axis=1, count=self.n, bitorder="little")[:, docs]
        first, group = distinct_masks(member)
        bound = (most[terms][:, None] * member[:, first]).sum(axis=0)
        order = np.argsort(-bound, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        docs = docs[np.argsort(place[group], kind="stable")]
        bound, ends = bound[order], np.cumsum(np.bincount(place[group]))
        at, wanted[terms] = 0, True
        while at < len(bound) and bound[at] >= best.least():
            done = ends[at - 1] if at else 0
            to = min(len(bound), max(at, int(np.searchsorted(ends, done + SCORED))) + 1)
            some = docs[done : ends[to - 1]]
            best.add(self.scores(some, wanted), self.own.ids[some], self.own.null[some])
            at = to
        wanted[terms] = False


class Best:
    """The k best (score, id) so far: the higher score first, then the smaller id, null ids last."""

    def __init__(self, k: int):
        self.k, self.score, self.ids, self.null = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def least(self) -> int:
        """Documents below this score can't come in any more."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        come = score >= self.least()
        score, ids, null = (np.concatenate((a, b[come])) for a, b in ((self.score, score), (self.ids, ids), (self.null, null)))
        order = np.lexsort((ids, null, -score))[: self.k]
        self.score, self.ids, self.null = score[order], ids[order], null[order]


def best_of_block(docs: DataFrame, items: dict[object, set[bytes]], k: int = BEST) -> DataFrame | None:
    """(item, doc_id, score) of the k best documents of each task for a block of queries, item being a query's place in the block."""
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*items.values())))}
    index = postings(docs, vocabulary)
    total, length = index.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    if not total:
        return None
    df, top = term_statistics(index, len(vocabulary), total, length)
    weight = np.array([math.floor(1000 * math.log((2 * total + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)
    wanted = [np.array(sorted(t for t in map(vocabulary.get, terms) if df[t]), np.int32) for terms in items.values()]
    held = docs.sparkSession.sparkContext.broadcast((weight, weight * top, wanted))

    def search(batches):
        weight, most, queries = held.value
        slot, mark, best = np.full(len(weight), -1, np.int64), np.zeros(len(weight), bool), [Best(k) for _ in queries]
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_DOCS):
                block = Block(Postings(batch.slice(at, BLOCK_DOCS), total, length), weight, slot)
                for terms, found in zip(queries, best, strict=True):
                    block.search(terms, most, mark, found)
                block.close()
        item = np.repeat(np.arange(len(best), dtype=np.int32), [len(x.ids) for x in best])
        ids, null, score = (np.concatenate([getattr(x, c) for x in best]) for c in ("ids", "null", "score"))
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(ids, mask=null), pa.array(score)], ["item", "doc_id", "score"])

    return index.mapInArrow(search, "item int, doc_id long, score long")


def search(docs: DataFrame, queries: DataFrame, k: int = BEST, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents (doc_id, text) of every query (item_id, text)."""
    spark, kind = docs.sparkSession, queries.schema["item_id"].dataType.simpleString()
    found = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    for items in query_blocks(queries, block_bytes):
        if items and (got := best_of_block(docs, items, k)) is not None:
            got = got.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            names = spark.createDataFrame(list(enumerate(items)), f"item int, item_id {kind}")
            found = found.unionByName(got.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    return found


def op12_presence_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item, over all documents."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OP12_SQL = f"""
with words as (
  select row_number() over () as d, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') as ws from documents),
held as (select d, doc_id, cast(len(ws) as bigint) as n, ws from words where len(ws) > 0),
whole as (select cast(count(*) as bigint) as n_docs, cast(sum(n) as bigint) as n_all from held),
tf as (select d, any_value(doc_id) as doc_id, any_value(n) as n, term, cast(count(*) as bigint) as tf from (select d, doc_id, n, unnest(ws) as term from held) group by d, term),
weights as (select term, cast(floor(1000 * ln(cast(2 * max(n_docs) + 2 as double) / cast(2 * count(*) + 1 as double))) as bigint) as w from tf, whole group by term),
asked as (
  select distinct item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')) as term from benchmark),
scored as (
  select item_id, d, any_value(doc_id) as doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // n_all)))) as bigint) as score
  from asked join tf using (term) join weights using (term), whole group by item_id, d),
ranked as (select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id nulls last) as rank from scored where score > 0)
select item_id, cast(rank as int) as rank, doc_id, score from ranked where rank <= 10
"""
