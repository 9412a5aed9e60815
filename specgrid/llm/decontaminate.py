"""Benchmark decontamination with a distributed positional inverted index.

Three passes over the documents, none of which gathers a document set anywhere:

1. document frequencies of the benchmark's words (counted over all documents);
2. the index: for the rarest words of each benchmark window, a table of postings (term, document, positions), in which
   nothing but those words is kept, since no other list is ever opened;
3. the lists of a window's two rarest words are shifted by the words' offsets in the item and intersected, which leaves
   alignments (document, item, start); those are compared word by word with the document (exact phrases), while word pairs
   that meet within a few words of each other without being aligned are proximity matches.

A document is known by the hash of its text, so rows that repeat an id, or have none, never meet each other's lists, and equal
texts are compared once. Only texts with an alignment are sent to be compared.

Cases: a null text has no words; an item without words matches nothing; an item of fewer words than a window is one window;
repeated items count by item id; an item without an id hits words but is not listed or counted among the items; an empty
table of documents gives an empty result and an empty benchmark hits nothing; `clean` keeps columns of any name,
`decontaminate` replaces those named like its own. The benchmark is worked through in blocks of about BLOCK_BYTES of text:
a block's words are what the driver and each task hold.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from specgrid.llm.common import LOOKED_AT, ALNUM_AZ, parts, saved, shielded, small, table, utf8

WINDOW = 13
#: A benchmark is worked through in blocks of so much text, on average; each block's words are what is broadcast.
BLOCK_BYTES = 12_000_000
#: Words by which a pair of rare words may be off its distance in the item to be near.
SLOP = 5


def words(text: bytes | None) -> list[bytes]:
    return text.translate(ALNUM_AZ).split() if text else []


def windows(n: int, window: int = WINDOW) -> Iterator[tuple[int, int]]:
    """(first word, length) of each window of an item of n words."""
    if n:
        for i in range(max(1, n - window + 1)):
            yield i, min(n, window)


def document_frequencies(docs: DataFrame, vocabulary: set[bytes]) -> dict[bytes, int]:
    """In how many rows each word of the vocabulary occurs; what comes back is bounded by the vocabulary."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches):
        own, n = held.value, Counter()
        for batch in parts(batches):
            for text in batch.column(0).to_pylist():
                n.update(own.intersection(words(text)))
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64())], ["term", "df"])

    got = docs.select(utf8().alias("text")).mapInArrow(count, "term binary, df long").groupBy("term").agg(F.sum("df"))
    return {bytes(term): n for term, n in got.collect()}


def anchors(items: dict[int, list[bytes]], df: dict[bytes, int], window: int = WINDOW) -> list[tuple[bytes, int, int, int, int]]:
    """(term, item, offset, pair, place): each window's two rarest words by document frequency, once for each pair of offsets.

    Windows of which a word occurs in no document can't match and are left out. A window of one word has one anchor.
    """
    rows = []
    for item, ws in items.items():
        pairs = {}
        for i, n in windows(len(ws), window):
            rarest = sorted(range(i, i + n), key=lambda j: (df.get(ws[j], 0), j))[:2]
            if all(df.get(ws[j], 0) for j in rarest):
                pairs.setdefault(tuple(sorted(rarest)), len(pairs))
        rows += [(ws[j], item, j, pair, place) for offsets, pair in pairs.items() for place, j in enumerate(offsets)]
    return rows


def text_hash() -> Column:
    return F.xxhash64("text").alias("doc")


def build_index(docs: DataFrame, terms: set[bytes]) -> DataFrame:
    """(term, doc, positions): the stored posting lists of the given words in all documents, one row for each row and word; doc is the text's hash."""
    held = docs.sparkSession.sparkContext.broadcast(terms)

    def postings(batches):
        own = held.value
        for batch in parts(batches):
            term, at, places = [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                ws = words(text)
                found = own.intersection(ws)
                if found:
                    lists = {w: [] for w in found}
                    for j, w in enumerate(ws):
                        if w in lists:
                            lists[w].append(j)
                    term += lists
                    places += lists.values()
                    at += [i] * len(lists)
            ids = batch.column(0).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(term, pa.binary()), ids, pa.array(places, pa.list_(pa.int32()))], ["term", "doc", "positions"])

    return saved(docs.select(text_hash(), utf8().alias("text")).mapInArrow(postings, "term binary, doc long, positions array<int>"))


def alignments(index: DataFrame, anchor_rows: list[tuple[bytes, int, int, int, int]]) -> DataFrame:
    """(doc, item, start): where the shifted lists of both anchors of some window meet. start may be negative if the item begins before the document."""
    lists = index.sparkSession.createDataFrame([(bytearray(t), *rest) for t, *rest in anchor_rows], "term binary, item long, offset int, pair int, place int")
    need = lists.groupBy("item", "pair").agg(F.count("*").alias("need"))
    shifted = (
        index.join(lists.join(need, ["item", "pair"]), "term")
        .select("doc", "item", "pair", "place", "need", F.explode("positions").alias("at"), "offset")
        .select("doc", "item", "pair", "need", (F.col("at") - F.col("offset")).alias("start"), "place")
    )
    # places are 0 and 1 (0 alone for a window of one word), whatever the number of rows that share a text
    met = shifted.groupBy("doc", "item", "pair", "start").agg(F.min("place").alias("low"), F.max("place").alias("high"), F.max("need").alias("need"))
    return met.where((F.col("low") == 0) & (F.col("high") == F.col("need") - 1)).select("doc", "item", "start").distinct()


def proximity_matches(index: DataFrame, anchor_rows: list[tuple[bytes, int, int, int, int]], slop: int = SLOP) -> DataFrame:
    """(doc, item, at, other, drift): both anchors of a window, in the item's order, at most slop words off their distance in the item.

    drift 0 is an exact alignment. Positions are compared inside cells of slop + the anchors' distance, so no list meets another whole.
    """
    lists = index.sparkSession.createDataFrame([(bytearray(t), *rest) for t, *rest in anchor_rows], "term binary, item long, offset int, pair int, place int")
    first = index.join(lists.where("place = 0"), "term").select("doc", "item", "pair", F.col("offset").alias("o1"), F.explode("positions").alias("at"))
    second = index.join(lists.where("place = 1"), "term").select("doc", "item", "pair", F.col("offset").alias("o2"), F.explode("positions").alias("other"))
    cell = WINDOW + slop
    first = first.withColumn("cell", F.explode(F.array(F.floor(F.col("at") / cell), F.floor(F.col("at") / cell) + 1)))
    second = second.withColumn("cell", F.floor(F.col("other") / cell))
    drift = (F.col("other") - F.col("at")) - (F.col("o2") - F.col("o1"))
    got = first.join(second, ["doc", "item", "pair", "cell"]).withColumn("drift", drift)
    return got.where((F.col("other") > F.col("at")) & (F.abs("drift") <= slop)).select("doc", "item", "at", "other", "drift").distinct()


def matched(ws: list[bytes], own: list[bytes], starts: list[int], window: int = WINDOW) -> list[tuple[int, int]]:
    """The document's spans that windows of an item cover, which may begin at the given words."""
    spans, size = [], min(len(own), window)
    for start in starts:
        run = 0
        for j in range(max(0, -start), min(len(own), len(ws) - start)):
            run = run + 1 if ws[start + j] == own[j] else 0
            if run >= size:
                spans.append((start + j - size + 1, start + j + 1))
    return spans


def merged(spans: list[tuple[int, int]]) -> list[dict[str, int]]:
    out: list[dict[str, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]["end"]:
            out[-1]["end"] = max(b, out[-1]["end"])
        else:
            out.append({"first": a, "end": b})
    return out


HITS = "doc long, n_words long, hit_spans array<struct<first: int, end: int>>, item_ids array<string>"


def found_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, near: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """(hits, near) by text hash: hits (doc, n_words, hit_spans, item_ids) of texts with an alignment; near (doc, n_near), how many pairs of rare words meet without being aligned.

    hit_spans are merged [first, end) word positions. The benchmark's own columns are item_id and text.
    """
    items = saved(benchmark.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("string").alias("item_id"), utf8().alias("item_text")))
    blocks = max(1, -(-(items.agg(F.sum(F.octet_length("item_text"))).first()[0] or 0) // BLOCK_BYTES))
    found, close = None, None
    for block in range(blocks):
        own = {r["item"]: words(r["item_text"] and bytes(r["item_text"])) for r in items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).collect()}
        df = document_frequencies(docs, {w for ws in own.values() for w in ws})
        rows = anchors(own, df, window)
        index = build_index(docs, {r[0] for r in rows})
        got = alignments(index, rows)
        found = got if found is None else found.unionByName(got)
        if near:
            got = proximity_matches(index, rows).where("drift <> 0")
            close = got if close is None else close.unionByName(got)
    found = saved(found)
    starts = found.groupBy("doc", "item").agg(F.collect_list("start").alias("starts")).join(small(items, 20_000), "item")
    starts = starts.groupBy("doc").agg(F.collect_list(F.struct("item_id", "item_text", "starts")).alias("items"))
    texts = docs.select(text_hash(), utf8().alias("text")).join(small(saved(found.select("doc").distinct())), "doc", "left_semi").dropDuplicates(["doc"])
    span_type = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))

    def compare(batches):
        for batch in parts(batches):
            n, spans, which = [], [], []
            for text, aligned in zip(batch.column("text").to_pylist(), batch.column("items").to_pylist(), strict=True):
                ws, raw, of = words(text), [], set()
                for x in aligned:
                    if got := matched(ws, words(x["item_text"]), x["starts"], window):
                        raw += got
                        of.add(x["item_id"])
                n.append(len(ws))
                spans.append(merged(raw))
                which.append(sorted(of - {None}))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(n, pa.int64()), pa.array(spans, span_type), pa.array(which, pa.list_(pa.string()))], ["doc", "n_words", "hit_spans", "item_ids"])

    hits = saved(texts.join(starts, "doc").select("doc", "text", "items").mapInArrow(compare, HITS))
    return hits, None if close is None else saved(close.groupBy("doc").agg(F.count("*").alias("n_near")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, columns: list[str] | None = None, near: bool = False) -> DataFrame:
    """docs (or the named columns of it) with n_words, hit_spans (array of [first, end) word positions, merged), item_ids and, if near, n_near.

    Columns of the input that are named like an added one are replaced.
    """
    if columns and set(columns) <= set(LOOKED_AT):
        return annotated(docs, benchmark, window, columns, near)
    got = shielded(annotated)(docs, benchmark, window, None, near)
    return got.select(*(f"`{c}`" for c in got.columns if c in (columns or docs.columns) or c not in docs.columns or c in ("n_words", "hit_spans", "item_ids", "n_near")))


def annotated(docs: DataFrame, benchmark: DataFrame, window: int, columns: list[str] | None, near: bool) -> DataFrame:
    hits, close = found_hits(docs, benchmark, window, near)
    own, added = columns or docs.columns, ["n_words", "hit_spans", "item_ids"] + ["n_near"] * near
    kept = [c for c in own if c not in added]
    got = counted(docs, kept).join(small(hits.withColumnRenamed("doc", "__decon_hit"), 100_000), F.col("__decon_doc") == F.col("__decon_hit"), "left")
    spans, ids = (F.from_json(F.lit("[]"), hits.schema[c].dataType) for c in ("hit_spans", "item_ids"))
    got = got.withColumns({"n_words": F.coalesce("n_words", "__decon_words"), "hit_spans": F.coalesce("hit_spans", spans), "item_ids": F.coalesce("item_ids", ids)})
    if near:
        got = got.join(small(close.withColumnRenamed("doc", "__decon_near")), F.col("__decon_doc") == F.col("__decon_near"), "left").withColumn("n_near", F.coalesce("n_near", F.lit(0)))
    return got.select(*kept, *added)


def counted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The named columns with the text's hash and its number of words."""
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*columns).schema)

    def count(batches):
        for batch in parts(batches):
            n = [len(words(text)) for text in batch.column("__decon_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), batch.column("__decon_doc"), pa.array(n, pa.int64())], [*columns, "__decon_doc", "__decon_words"])

    wide = docs.select(*columns, text_hash().alias("__decon_doc"), utf8().alias("__decon_text"))
    return wide.mapInArrow(count, f"{schema}__decon_doc long, __decon_words long")


def n_hit() -> Column:
    return F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, x: a + (x["end"] - x["first"]))


def contaminated() -> Column:
    """The rule: any word hit, and the hit words are at least a twentieth of all."""
    return (n_hit() > 0) & (20 * n_hit() >= F.col("n_words"))


@shielded
def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that aren't contaminated, with docs's columns."""
    hits, _ = found_hits(docs, benchmark)
    gone = small(saved(hits.where(contaminated()).select(F.col("doc").alias("__decon_gone"))))
    return docs.join(gone, F.xxhash64("text") == F.col("__decon_gone"), "left_anti")


def op3_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's words, hit words and matching benchmark items, and its proximity matches."""
    got = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), columns=["doc_id"], near=True)
    return got.select(
        "doc_id", "n_words", n_hit().alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), contaminated().alias("contaminated"), "n_near",
    )
