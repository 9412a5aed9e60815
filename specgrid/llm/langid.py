"""Language identification by the nearest of several TF-IDF centroids per language.

A text becomes hashed byte trigrams of its lower-cased letters, weighed by log(1 + tf) * idf and normalised. Document
frequencies are counted over all labelled training rows; each language's centroids come from spherical k-means over a
bounded sample of them (SAMPLE rows a language, by hash of the id). A text takes the language of the centroid with the
largest cosine, which is also the score; a text farther from it than nearly all of that centroid's own training texts is
marked as rejected.

Cases: a text that is null or has no letter is `und` with score 0; rows without a language teach nothing; a null id is
never held out; ties go to the language first by code point; without any training row every text is `und`; in document
frequencies repeated rows count as often as they occur, in the sample once; invalid UTF-8 is read with replacement characters;
other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specgrid.llm.common import crc_mod, parts, table, utf8

DIMS = 4096
CENTROIDS = 4
#: Training rows of each language from which its centroids are made, and of all languages together.
SAMPLE = 400
SAMPLE_ALL = 8000
#: Share of a centroid's training texts that its radius leaves out.
OUTSIDE = 0.01
#: Word characters that may be letters (numerals such as ² or Ⅷ are among them).
LETTER = re.compile(r"[^\W\d_]")
#: ASCII but lower-case letters to a space.
LETTERS = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def term_counts(raw: bytes | None) -> np.ndarray | None:
    """Counts of the text's hashed byte trigrams; None for a text without letters."""
    text = raw.decode("utf-8", "replace") if raw else ""
    if not any(m[0].isalpha() for m in LETTER.finditer(text)):
        return None
    b = np.frombuffer(b" " + b" ".join(text.lower().encode().translate(LETTERS).split()) + b" ", np.uint8).astype(np.int64)
    h = (b[:-2] * 7919 + b[1:-1] * 104729 + b[2:] * 1299709) * 2654435761 >> 16
    return np.bincount(h & (DIMS - 1), minlength=DIMS)


def vectors(texts: list[bytes | None], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which texts have letters, their unit vectors)."""
    found = [(i, x) for i, x in enumerate(map(term_counts, texts)) if x is not None]
    if not found:
        return np.empty(0, np.int64), np.empty((0, DIMS), np.float32)
    x = np.log1p(np.stack([x for _, x in found]).astype(np.float32)) * idf
    return np.array([i for i, _ in found]), x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def inverse_frequencies(train: DataFrame) -> np.ndarray:
    """idf of each hashed trigram over all rows of train (text); at most DIMS + 1 rows reach the driver."""

    def count(batches):
        n, df = 0, np.zeros(DIMS, np.int64)
        for batch in parts(batches):
            for x in map(term_counts, batch.column(0).to_pylist()):
                if x is not None:
                    n, df = n + 1, df + (x > 0)
        has = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(has, -1)), pa.array(np.append(df[has], n))], ["dim", "df"])

    got = train.select(utf8().alias("text")).mapInArrow(count, "dim long, df long").groupBy("dim").agg(F.sum("df")).collect()
    df = np.zeros(DIMS)
    n = 0
    for dim, k in got:
        if dim < 0:
            n = k
        else:
            df[dim] = k
    return (np.log((1 + n) / (1 + df)) + 0.1).astype(np.float32)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """(unit centroids, radius as least cosine of each), seeded by the farthest points."""
    centres = [x.mean(axis=0)]
    while len(centres) < min(k, len(x)):
        near = np.max(x @ np.stack(centres).T, axis=1)
        centres.append(x[int(np.argmin(near))])
    c = np.stack(centres)
    c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        c = np.stack([x[own == i].mean(axis=0) if (own == i).any() else c[i] for i in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    near, own = np.max(x @ c.T, axis=1), np.argmax(x @ c.T, axis=1)
    radius = [float(np.quantile(near[own == i], OUTSIDE)) if (own == i).any() else 1.0 for i in range(len(c))]
    return c.astype(np.float32), np.array(radius)


def fit(train: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """(language of each centroid, centroids, radii, idf) from rows (doc_id, text, lang) with a language."""
    idf = inverse_frequencies(train)
    sizes = {r[0]: r[1] for r in train.groupBy("lang").count().collect()}
    if not sizes:
        return [], np.empty((0, DIMS), np.float32), np.empty(0), idf
    each = max(1, min(SAMPLE, SAMPLE_ALL // len(sizes)))
    spot = F.pmod(F.xxhash64(F.lit(4), "doc_id", "text"), F.lit(1 << 30))
    share = F.create_map(*[x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(min(1.0, each / n)))])
    # about `each` different texts for each language
    sample = train.where(spot < share[F.col("lang")] * (1 << 30)).select("lang", utf8().alias("text")).distinct()

    def cluster(key, held):
        _, x = vectors(held.column("text").to_pylist(), idf)
        if not len(x):
            return pa.Table.from_arrays([pa.array([], pa.string()), pa.array([], pa.binary()), pa.array([], pa.float64())], ["lang", "centre", "radius"])
        c, radius = spherical_kmeans(x, CENTROIDS)
        return pa.Table.from_arrays([pa.array([key[0].as_py()] * len(c), pa.string()), pa.array([y.tobytes() for y in c], pa.binary()), pa.array(radius)], ["lang", "centre", "radius"])

    rows = sorted((r[0], bytes(r[1]), r[2]) for r in sample.groupBy("lang").applyInArrow(cluster, "lang string, centre binary, radius double").collect())
    return [r[0] for r in rows], np.array([np.frombuffer(r[1], np.float32) for r in rows]).reshape(-1, DIMS), np.array([r[2] for r in rows]), idf


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray, np.ndarray]) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) for every row, from its text alone."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def judge(batches):
        langs, centres, radius, idf = held.value
        for batch in parts(batches):
            n, texts = batch.num_rows, batch.column(1).to_pylist()
            lang, score, rejected = ["und"] * n, np.zeros(n), np.ones(n, bool)
            which, x = vectors(texts if langs else [], idf)
            if len(which):
                near = x @ centres.T
                best = np.argmax(near, axis=1)
                value = near[np.arange(len(best)), best]
                score[which], rejected[which] = np.clip(value, 0, 1), value < radius[best]
                for i, b in zip(which, best, strict=True):
                    lang[i] = langs[b]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang), pa.array(score), pa.array(rejected)], ["doc_id", "lang_pred", "score", "rejected"])

    return docs.select("doc_id", utf8().alias("text")).mapInArrow(judge, f"doc_id {id_type}, lang_pred string, score double, rejected boolean")


def op4_nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    train = docs.where(F.col("lang").isNotNull() & (F.coalesce(crc_mod("doc_id", 3), F.lit(0)) != 1)).select("doc_id", "text", "lang")
    got = predict(docs, fit(train))
    return got.select("doc_id", F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
