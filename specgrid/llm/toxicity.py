"""Toxicity scores on text restored by a noisy-channel decoder.

Words that look disguised (letters spelled with digits or signs, letters spaced out one by one, letters drawn out) become a
lattice of what each character may stand for; a Viterbi search finds the likeliest spelling under a character language
model counted over the whole corpus. The restored text is scored: words and their character n-grams have weights learned
from labelled rows (lower confidence bounds of the log odds, so that only clear evidence counts), and a small logistic
regression over the strongest words gives the probability of label 1.

Cases: a null or empty text has no words and gets the base rate's score; rows with several labels are toxic if any is; rows
without a label teach nothing but the language model; of several texts of one labelled id the least one teaches; without
training rows every score is 0; repeated rows score alike; invalid UTF-8 is read with replacement characters; other columns
are ignored or, in `without_toxic`, kept.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specgrid.llm.common import crc_mod, parts, saved, shielded, table, utf8

#: What a sign may stand for.
SIGNS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i",
}
#: Costs (in nats) of reading a sign as a letter, of dropping a sign, of dropping a separator, and of dropping a letter of a run of two or of more.
AS_LETTER, DROP_SIGN, DROP_SEPARATOR, DROP_DOUBLE, DROP_RUN = 0.5, 4.0, 0.5, 3.0, 0.5
SPACED = re.compile(r"(?<![^\W_])[^\W_](?:[ .\-_*]{1,2}[^\W_@$!|]|[ .\-_*]{1,2}[0-9@$!|]){2,}(?![^\W_])")
DISGUISED = re.compile(r"[^\W\d_][0-9@$!|+(<€£¡*.\-_']+[^\W\d_]|^[0-9@$!|+(<€£¡][^\W\d_]|[^\W\d_](?:[0-9]+|[$@])$|([^\W\d_])\1\1")
#: Cheap signs that a text holds any of these, and the tokens that are then looked at.
MAY_BE_SPACED = re.compile(r"[ .\-_*][^\W_][ .\-_*]{1,2}\S[ .\-_*]{1,2}\S")
SIGN_BY_LETTER = re.compile(r"[0-9@$!|+(<€£¡*.\-_'](?=[^\W\d_])|[0-9$@](?<=[^\W\d_].)(?=[0-9]*[.,;:!?]?(?!\S))")
WITH_SIGN = re.compile(r"(?<!\S)\S*(?:[0-9@$!|+(<€£¡*.\-_'](?=[^\W\d_])|[0-9$@](?<=[^\W\d_].)(?=[0-9]*[.,;:!?]?(?!\S)))\S*")
DRAWN_OUT = re.compile(r"(?<!\S)\S*([^\W\d_])\1\1\S*")
TRIPLES = tuple(3 * c for c in "abcdefghijklmnopqrstuvwxyz")
#: A token's beginning that is no part of a spelling; and signs that may be its last letter.
FRONT = re.compile(r"[^\w@$!|+(<€£¡]+")
LAST_LETTERS = frozenset("@$!|+")
#: Lower-case text as bytes: ASCII but letters to a space.
LETTERS_ONLY = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
#: Lengths in bytes of the pieces of a word, its edges included, and the slots they hash into.
GRAMS = (4, 5, 6)
FEATURES = 1 << 20
#: Labelled rows of each class that are used to fit; two thirds give the word weights and the others the regression.
SAMPLE = 6000
#: Toxic rows that a piece of a word must occur in to have a weight.
LEAST_ROWS = 4
POOLED = 5
LETTERS = 27  # a word's edge and a to z

FOLD = {c: b for c in range(0xC0, 0x250) if "a" <= (b := unicodedata.normalize("NFD", chr(c))[0].lower()) <= "z"} | {ord("ß"): "s", ord("æ"): "a", ord("ø"): "o"}


def fold(word: str) -> str:
    return word.lower().translate(FOLD)


def count_grams(docs: DataFrame) -> np.ndarray:
    """Counts of 4-character sequences of words (edges included) over all texts: at most LETTERS ** 4 rows reach the driver."""

    def spelled(words: Counter) -> pa.RecordBatch:
        own = [(w, n) for w, n in ((fold(w.decode("utf-8", "replace")), n) for w, n in words.items()) if w.isascii()]
        b = np.frombuffer(("```" + "```".join(w for w, _ in own) + "```").encode(), np.uint8).astype(np.int64) - 96
        weight = np.repeat([n for _, n in own], [len(w) + 3 for w, _ in own])
        code = ((b[:-3] * LETTERS + b[1:-2]) * LETTERS + b[2:-1]) * LETTERS + b[3:]
        good = (b[3:] > 0) | (b[2:-1] > 0)
        n = np.bincount(code[good], weight[: len(code)][good], minlength=LETTERS**4) if own else np.zeros(1)
        has = np.flatnonzero(n)
        return pa.RecordBatch.from_arrays([pa.array(has), pa.array(n[has].astype(np.int64))], ["gram", "n"])

    def count(batches):
        words = Counter()
        for batch in parts(batches):
            for text in batch.column(0).to_pylist():
                words.update((text or b"").decode("utf-8", "replace").lower().encode("utf-8", "replace").translate(LETTERS_ONLY).split())
            if len(words) > 300_000:
                yield spelled(words)
                words = Counter()
        yield spelled(words)

    got = docs.select(utf8().alias("text")).mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n")).collect()
    grams = np.zeros(LETTERS**4)
    for gram, n in got:
        grams[gram] = n
    return grams


def language_model(grams: np.ndarray) -> np.ndarray:
    """log p(character | three before it), each order smoothed with the next shorter one."""
    c4 = grams.reshape((LETTERS,) * 4)
    p = np.full(LETTERS, 1 / LETTERS)
    for axes in ((0, 1, 2), (0, 1), (0,), ()):
        c = c4.sum(axis=axes)
        p = (c + 5 * p) / (c.sum(axis=-1, keepdims=True) + 5)
    return np.log(p).astype(np.float32)


def arcs_of(chars: str, i: int) -> list[tuple[str, str, float]] | None:
    """What character i may stand for: (letter for the language model, what is shown, cost); None for a letter of another script."""
    ch = chars[i]
    base = FOLD.get(ord(ch), ch)
    if "a" <= base <= "z":
        arcs = [(base, ch, 0.0)]
        if i and chars[i - 1] == ch:
            run = i > 1 and chars[i - 2] == ch or chars[i + 1 : i + 2] == ch
            arcs.append(("", "", DROP_RUN if run else DROP_DOUBLE))
        return arcs
    if ch in SIGNS:
        return [(x, x, AS_LETTER) for x in SIGNS[ch]] + [("", "", DROP_SIGN)]
    return None if ch.isalpha() else [("", "", DROP_SEPARATOR)]


def decode(token: str, lm: np.ndarray, spread: float | None = None) -> str:
    """The likeliest spelling of a disguised token: the best path for each three-letter context.

    From two contexts the same continuation differs by three letters' probabilities at most (`spread`, the largest such
    difference), so a path that is farther behind the best than that can't win.
    """
    chars = token.lower()
    spread = 3 * float(lm.max() - lm.min()) if spread is None else spread
    paths = {(0, 0, 0): (0.0, "")}
    for i in range(len(chars)):
        arcs = arcs_of(chars, i)
        if arcs is None:
            return token
        step = {}
        for (a, b, c), (score, text) in paths.items():
            for letter, shown, cost in arcs:
                if letter:
                    k = ord(letter) - 96
                    to, got = (b, c, k), score - cost + float(lm[a, b, c, k])
                else:
                    to, got = (a, b, c), score - cost
                if to not in step or got > step[to][0]:
                    step[to] = (got, text + shown)
        least = max(x[0] for x in step.values()) - spread
        paths = {k: x for k, x in step.items() if x[0] >= least} if len(step) > 8 else step
    return max(((s + float(lm[a, b, c, 0]), t) for (a, b, c), (s, t) in paths.items()), default=(0, token))[1]


def core_of(token: str) -> str:
    """The token without punctuation at its ends: a sign that stands alone at the end may be a letter. One pass, however long the token."""
    begin = m.end() if (m := FRONT.match(token)) else 0
    end = len(token)
    while end > begin and not (token[end - 1].isalnum() or token[end - 1] == "_"):
        end -= 1
    last = token[end:]
    return token[begin:end] + (last if len(last) == 1 and last in LAST_LETTERS else "")


class Restorer:
    """Restores texts; keeps what it has decoded for the task's other texts."""

    def __init__(self, lm: np.ndarray):
        self.lm, self.known, self.spread = lm, {}, 3 * float(lm.max() - lm.min())

    def token(self, token: str) -> str:
        got = self.known.get(token)
        if got is None:
            core = core_of(token)
            letters = sum(map(str.isalpha, core))
            got = decode(core, self.lm, self.spread) if core and 3 * letters >= len(core) and DISGUISED.search(core) else token
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[token] = got
        return got

    def text(self, text: str) -> str:
        if MAY_BE_SPACED.search(f" {text}"):
            text = SPACED.sub(lambda m: decode(re.sub(r"[ .\-_*]", "", m[0]), self.lm, self.spread), text)
        if SIGN_BY_LETTER.search(text):
            text = WITH_SIGN.sub(lambda m: self.token(m[0]), text)
        low = text.lower()
        if any(x in low for x in TRIPLES):
            text = DRAWN_OUT.sub(lambda m: self.token(m[0]), text)
        return text


def restored_words(raw: bytes | None, restorer: Restorer) -> list[bytes]:
    """The distinct words of the restored text."""
    return sorted(set(restorer.text(raw.decode("utf-8", "replace")).lower().encode("utf-8", "replace").translate(LETTERS_ONLY).split())) if raw else []


def pieces(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashed pieces of all words, the word each is of): runs of GRAMS bytes of ^word$."""
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    raw = np.frombuffer(b"^" + b"$^".join(words) + b"$", np.uint8)
    of = np.cumsum(raw == 94) - 1
    h, out, owner = raw.astype(np.uint32), [], []
    for n in range(2, max(GRAMS) + 1):
        h = h[:-1] * np.uint32(16777619) ^ raw[n - 1 :]
        if n in GRAMS:
            inside = of[: len(h)] == of[n - 1 :]
            mixed = (h ^ (h >> np.uint32(15))) * np.uint32(2246822519)
            out.append((mixed >> np.uint32(12))[inside])
            owner.append(of[: len(h)][inside])
    return np.concatenate(out).astype(np.int64), np.concatenate(owner)


class Scorer:
    """A text's pooled evidence: its three strongest words, how many are strong, and all evidence together."""

    def __init__(self, lm: np.ndarray, weights: np.ndarray):
        self.restorer, self.weights = Restorer(lm), weights

    def pooled(self, text: bytes | None) -> list[float]:
        words = restored_words(text, self.restorer)
        h, owner = pieces(words)
        value = self.weights[h]
        strong = value > 0
        per_word = np.zeros(len(words))
        np.maximum.at(per_word, owner[strong], value[strong])
        best = np.sort(per_word[per_word > 0])[::-1]
        top = [*best[:3], 0.0, 0.0, 0.0][:3]
        return [*map(float, top), float(np.log1p((best > 1.5).sum())), float(best.sum() / np.sqrt(1 + len(words)))]


def word_weights(sample: DataFrame, lm: np.ndarray) -> np.ndarray:
    """Lower bounds of the log odds of hashed pieces of words, from rows (text, toxic): those that are clearly above 0, else 0."""
    held = sample.sparkSession.sparkContext.broadcast(lm)

    def count(batches):
        restorer = Restorer(held.value)
        n = np.zeros((2, FEATURES), np.int32)
        rows = [0, 0]
        for batch in parts(batches):
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n[toxic, np.unique(pieces(restored_words(text, restorer))[0])] += 1
                rows[toxic] += 1
        has = np.flatnonzero(n[0] + n[1])
        yield pa.RecordBatch.from_arrays([pa.array(np.append(has, -1)), pa.array(np.append(n[1, has], rows[1]).astype(np.int64)), pa.array(np.append(n[0, has], rows[0]).astype(np.int64))], ["f", "a", "b"])

    got = sample.select("text", "toxic").mapInArrow(count, "f long, a long, b long").groupBy("f").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    rows = got.where((F.col("f") < 0) | (F.col("a") >= LEAST_ROWS)).collect()
    total = next(((r["a"], r["b"]) for r in rows if r["f"] < 0), (0, 0))
    out = np.zeros(FEATURES, np.float32)
    for f, a, b in rows:
        if f >= 0:
            odds = np.log((a + 0.5) / (total[0] + 1)) - np.log((b + 0.5) / (total[1] + 1))
            low = odds - 1.64 * np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
            if low > 0.7:
                out[f] = float(low)
    return out


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Coefficients (the last is the intercept) by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    weight = weight / weight.sum()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + ridge * w
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(language model, word weights, coefficients) from docs and rows (doc_id, toxic) that may be learned from; None without rows of both classes."""
    lm = language_model(count_grams(docs))
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    if not sizes.get(0) or not sizes.get(1):
        return None
    spot = F.pmod(F.xxhash64(F.lit(10), "doc_id"), F.lit(1 << 30))
    chosen = known.where(spot < F.when(F.col("toxic") == 1, min(1.0, SAMPLE / sizes[1])).otherwise(min(1.0, SAMPLE / sizes[0])) * (1 << 30))
    # about SAMPLE ids of each class, with one text each: a bound on what is broadcast and on what is learned from
    sample = docs.select("doc_id", utf8().alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    sample = saved(sample).withColumn("third", F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(3)))
    weights = word_weights(sample.where("third < 2"), lm)
    held = docs.sparkSession.sparkContext.broadcast((lm, weights))

    def pool(batches):
        scorer = Scorer(*held.value)
        for batch in parts(batches):
            x = np.array([scorer.pooled(t) for t in batch.column(0).to_pylist()]).reshape(-1, POOLED)
            yield pa.RecordBatch.from_arrays([batch.column(1), *(pa.array(c) for c in x.T)], ["toxic", *(f"x{i}" for i in range(POOLED))])

    rows = sample.where("third = 2").select("text", "toxic").mapInArrow(pool, "toxic int, " + ", ".join(f"x{i} double" for i in range(POOLED))).collect()
    if not rows:
        return None
    x, y = np.array([r[1:] for r in rows], float), np.array([r[0] for r in rows], float)
    weight = np.where(y == 1, max(1, sizes[1] / SAMPLE), max(1, sizes[0] / SAMPLE))
    return lm, weights, logistic(x, y, weight)


def scores(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, np.ndarray] | None, columns: list[str] | None = None) -> DataFrame:
    """The named columns of docs (doc_id) and score, for every row."""
    columns = columns or ["doc_id"]
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*columns).schema)

    def judge(batches):
        model = held.value
        scorer = Scorer(*model[:2]) if model else None
        for batch in parts(batches):
            got = np.zeros(batch.num_rows)
            if scorer:
                x = np.array([scorer.pooled(t) for t in batch.column("__text").to_pylist()]).reshape(-1, POOLED)
                got = 1 / (1 + np.exp(-np.clip(x @ model[2][:-1] + model[2][-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(got)], [*columns, "__score"])

    got = docs.select(*columns, utf8().alias("__text")).mapInArrow(judge, f"{schema}, __score double")
    return got


def trained(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """The model of all documents and of the labels that aren't held out."""
    return fit(docs, labels.where(F.coalesce(crc_mod("doc_id", 5), F.lit(0)) != 0).select("doc_id", "toxic"))


@shielded
def without_toxic(docs: DataFrame, labels: DataFrame, at: float = 0.5) -> DataFrame:
    """The rows of docs that score below `at`, with docs's columns."""
    return scores(docs, trained(docs, labels), docs.columns).where(F.col("__score") < at).select(*docs.columns)


def op10_noisy_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The probability that each document is toxic."""
    docs = table(spark, sf_dir, "documents")
    got = scores(docs, trained(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out")
    return got.select("doc_id", held_out, F.col("__score").alias("score"), (F.col("__score") >= 0.5).cast("int").alias("predicted"))
