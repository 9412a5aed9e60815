"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One weight vector over hashed features of the text and K - 1 ordered thresholds give P(grade <= k) = logistic(threshold_k -
score), so all grades share what makes a text good. The features are the text's words, pairs of words and letter triples,
hashed, the same triples of character classes, and hashed bins of a few counts. The expected grade and the probability of
reaching a grade follow, and selection compares that tail probability with a cut. The model is fitted to a bounded sample of
rated rows (SAMPLE ids for each grade, by hash of the id, weighted back to the true shares of the grades).

Cases: a null or empty text has no features but the intercept's and gets the prior; rows without a rating teach nothing; of
several ratings of a document the rounded mean counts, and of several texts of one id the least one teaches; with one grade
only, every text expects that grade; without ratings the grade is null; repeated rows score alike; invalid UTF-8 is hashed as
it is; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specgrid.llm.common import crc_mod, parts, table, utf8
from specgrid.llm.ngram_join import BLANK, ODD, Powers, mix, word_hashes

#: Hashed slots of words, of pairs of words, of letter triples, of triples of character classes, and of bins.
PARTS = {"words": 768, "pairs": 512, "letters": 768, "shapes": 512, "bins": 512}
DIMS = sum(PARTS.values())
SAMPLE = 3000
LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.int64)
#: Lower case to a, upper case to A, digits to 0; signs, spaces and bytes beyond ASCII as they are (those to a).
SHAPE = np.array([97 if 97 <= c <= 122 or c >= 128 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c for c in range(256)], np.int64)
SENTENCE_SIGN = np.isin(np.arange(256), list(b".!?,;:"))


def hashed_counts(h: np.ndarray, slots: int) -> np.ndarray:
    """log(1 + count) of each slot, as a unit vector."""
    x = np.log1p(np.bincount((h % np.uint64(slots)).astype(np.int64), minlength=slots))
    return x / max(1e-9, np.linalg.norm(x))


def triples(b: np.ndarray) -> np.ndarray:
    return mix((b[:-2] << 16 | b[1:-1] << 8 | b[2:]).astype(np.uint64))


def features(text: bytes | None, powers: Powers) -> np.ndarray:
    """Hashed features of the whole text."""
    data = np.frombuffer(text or b"", np.uint8)
    h = word_hashes(data, np.array([0, len(data)]), powers)[0]
    if not len(h):
        return np.zeros(DIMS, np.float32)
    shape = SHAPE[data]
    third = np.ones(len(shape), bool)
    third[2:] = (shape[2:] != shape[1:-1]) | (shape[2:] != shape[:-2])  # longer runs count as two
    blank = np.append(BLANK[data], True)
    lines = text.split(b"\n")
    again, distinct, ends = (h[1:] == h[:-1]).sum() / len(h), len(np.unique(h)) / len(h), (SENTENCE_SIGN[data] & blank[1:]).sum() / len(h)
    names = [f"again{min(9, int(again * 20))}", f"distinct{int(distinct * 10)}", f"length{len(h).bit_length()}", f"lines{len(lines).bit_length()}", f"ends{min(9, int(ends * 20))}", f"uniquelines{int(10 * len(set(lines)) / len(lines))}"]
    bins = np.bincount([xxhash.xxh32_intdigest(x) % PARTS["bins"] for x in names], minlength=PARTS["bins"])
    own = [hashed_counts(x, PARTS[k]) for k, x in (("words", h), ("pairs", mix(h[:-1] * ODD + h[1:])), ("letters", triples(LOWER[data])), ("shapes", triples(shape[third])))]
    return np.concatenate([own[0], own[1], own[2], 3 * own[3], bins]).astype(np.float32)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def cumulative_link(x: np.ndarray, y: np.ndarray, weight: np.ndarray, grades: int, ridge: float = 1e-4, rounds: int = 400, rate: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """(weights, ordered thresholds) by maximum likelihood for grades 0 to grades - 1 (Adam; thresholds as a first one and positive gaps)."""
    weight, x = weight / weight.sum(), x.astype(np.float32)
    share = np.array([weight[y <= k].sum() for k in range(grades - 1)]).clip(1e-3, 1 - 1e-3)
    cut = np.log(share / (1 - share))
    w = np.zeros(x.shape[1])
    free = np.concatenate([cut[:1], np.log(np.maximum(np.diff(cut), 1e-3))])
    mean, square = np.zeros(len(w) + len(free)), np.zeros(len(w) + len(free))
    for step in range(1, rounds + 1):
        cut = free[0] + np.concatenate([[0.0], np.cumsum(np.exp(free[1:]))])
        edges = np.concatenate([[-np.inf], cut, [np.inf]])
        s = (x @ w.astype(np.float32)).astype(np.float64)
        upper, lower = sigmoid(edges[y + 1] - s), sigmoid(edges[y] - s)
        upper, lower = np.where(y == grades - 1, 1.0, upper), np.where(y == 0, 0.0, lower)
        p = np.maximum(upper - lower, 1e-12)
        du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p
        to_score = weight * (du - dl)  # d(-log p)/ds
        to_cut = np.array([(weight * dl)[y == k + 1].sum() - (weight * du)[y == k].sum() for k in range(grades - 1)])
        to_free = np.array([to_cut.sum(), *(np.exp(free[j]) * to_cut[j:].sum() for j in range(1, grades - 1))])
        grad = np.concatenate([x.T @ to_score.astype(np.float32) + ridge * w, to_free])
        mean, square = 0.9 * mean + 0.1 * grad, 0.999 * square + 0.001 * grad * grad
        move = rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        w, free = w - move[: len(w)], free - move[len(w) :]
    return w, free[0] + np.concatenate([[0.0], np.cumsum(np.exp(free[1:]))])


def fit(docs: DataFrame, ratings: DataFrame, sample: int = SAMPLE) -> tuple[list[int], np.ndarray, np.ndarray] | None:
    """(grades, weights, thresholds) from rows (doc_id, grade) that may be learned from."""
    known = ratings.where("grade is not null and doc_id is not null").groupBy("doc_id").agg(F.round(F.avg("grade")).cast("int").alias("grade"))
    sizes = {r[0]: r[1] for r in known.groupBy("grade").count().collect()}
    if not sizes:
        return None
    grades = sorted(sizes)
    if len(grades) == 1:
        return grades, np.zeros(DIMS), np.zeros(0)
    spot = F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(1 << 30))
    share = F.create_map(*[x for g, n in sizes.items() for x in (F.lit(g), F.lit(min(1.0, sample / n)))])
    # about `sample` rows for each grade: a bound on what is broadcast and on what the driver gets
    chosen = known.where(spot < share[F.col("grade")] * (1 << 30))

    def make(batches):
        powers = Powers()
        for batch in parts(batches):
            blobs = [features(t, powers).astype(np.float16).tobytes() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(blobs, pa.binary()), batch.column(1)], ["x", "grade"])

    texts = docs.select("doc_id", utf8().alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "grade").agg(F.min("text").alias("text"))
    rows = texts.select("text", "grade").mapInArrow(make, "x binary, grade int").collect()
    if not rows:
        return None
    rows = sorted((r[1], bytes(r[0])) for r in rows)
    x = np.frombuffer(b"".join(r[1] for r in rows), np.float16).reshape(-1, DIMS).astype(np.float32)
    y = np.array([grades.index(r[0]) for r in rows])
    weight = np.array([max(1.0, sizes[g] / sample) for g in grades])[y]
    return grades, *cumulative_link(x, y, weight, len(grades))


def grade(docs: DataFrame, model: tuple[list[int], np.ndarray, np.ndarray] | None, reach: int | None = None) -> DataFrame:
    """(doc_id, score, expected_grade, tail_probability) for every row; the tail is that of reaching grade `reach`, the highest if None."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def judge(batches):
        model, powers = held.value, Powers()
        for batch in parts(batches):
            n = batch.num_rows
            if model is None:
                columns = [pa.nulls(n, pa.float64())] * 3
            else:
                grades, w, cut = model
                score = np.array([features(t, powers) @ w for t in batch.column(1).to_pylist()]).reshape(n)
                above = sigmoid(score[:, None] - cut[None, :])  # P(grade > k)
                expected = grades[0] + above @ np.diff(grades) if len(cut) else np.full(n, float(grades[0]))
                at = len(grades) - 1 if reach is None else sum(g < reach for g in grades)
                tail = np.ones(n) if at == 0 else np.zeros(n) if at >= len(grades) else above[:, at - 1]
                columns = [pa.array(score), pa.array(expected), pa.array(tail)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "score", "expected_grade", "tail_probability"])

    return docs.select("doc_id", utf8().alias("text")).mapInArrow(judge, f"doc_id {id_type}, score double, expected_grade double, tail_probability double")


def op1_cumulative_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade and tail probability of every document, learned from the ratings of four in five; it is selected if it likely reaches the highest grade."""
    docs, held_out = table(spark, sf_dir, "documents"), F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))
    ratings = table(spark, sf_dir, "labels").where(~held_out).select("doc_id", F.col("quality").alias("grade"))
    got = grade(docs, fit(docs, ratings))
    return got.select("doc_id", held_out.alias("held_out"), "score", "expected_grade", "tail_probability", (F.col("tail_probability") >= 0.5).alias("selected"))
