"""Logistic regression of an outcome over analytic choices, from counted covariate patterns.

Rows are counted by their factors first, so a fit reads a row for each combination that occurs, however many branches there are.
Newton steps sum the patterns' contributions. Where the likelihood has no maximum since factors separate the outcome, the
fit is that of the likelihood penalised by half the log determinant of the information (Jeffreys' prior), which always has one.

Cases: rows with a null outcome or a null (or not-a-number) factor take no part; terms that follow from earlier ones have a null
estimate; too few rows or an outcome that is always the same give None; a factor of more than MOST_TERMS levels is an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specgrid.sources.scratch import saved

#: Patterns that are summed on the driver; more are summed by tasks. Terms of a regression at most.
FEW_PATTERNS, MOST_TERMS = 20_000, 300
STEPS, CLOSE, FAR = 100, 1e-10, 15.0
FIELDS = "term string, estimate double, odds_ratio double, ci_lower double, ci_upper double, mcfadden_r2 double, base_rate double, n long, separated boolean"

#: The columns of a term: factors, each with a level (None for a number).
Term = tuple[tuple[str, str | None], ...]
Sums = Callable[[np.ndarray, np.ndarray | None], tuple[np.ndarray, np.ndarray, float, float]]


def read_formula(formula: str) -> list[tuple[str, ...]]:
    """Terms of `a + b*c + a:b` as tuples of factors; `b*c` is b + c + b:c."""
    out: list[tuple[str, ...]] = []
    for part in formula.replace(" ", "").split("+"):
        names = part.split("*")
        out += [(x,) for x in names] if len(names) > 1 else []
        out.append(tuple(part.replace("*", ":").split(":")))
    main = [t for t in out if len(t) == 1]
    return list(dict.fromkeys([*main, *(t for t in out if len(t) > 1)]))


def covariate_patterns(df: DataFrame, outcome: str, factors: list[str]) -> DataFrame:
    """(factors..., n, hits): how many rows have each combination of factors, and in how many of them the outcome holds."""
    known = [F.col(f).isNotNull() & (~F.isnan(f) if df.schema[f].dataType.typeName() in ("double", "float") else F.lit(True)) for f in factors]
    rows = df.where(F.col(outcome).isNotNull()).where(known[0] if len(known) == 1 else F.forall(F.array(*known), lambda x: x))
    return rows.groupBy(*factors).agg(F.count("*").alias("n"), F.sum(F.col(outcome).cast("long")).alias("hits"))


def coded(columns: dict[str, np.ndarray], terms: list[Term]) -> np.ndarray:
    """A column for each term: the product of its numbers and of the indicators of its levels."""
    out = np.ones((len(next(iter(columns.values()))), len(terms)))
    for j, term in enumerate(terms):
        for factor, level in term:
            out[:, j] *= columns[factor].astype(float) if level is None else columns[factor] == level
    return out


def contribution(x: np.ndarray, n: np.ndarray, hits: np.ndarray, beta: np.ndarray, inverse: np.ndarray | None) -> np.ndarray:
    """Information, score, log-likelihood and largest linear predictor, one after another. With the inverse of the information, the score is the penalised one."""
    eta = x @ beta
    p = 1 / (1 + np.exp(-np.clip(eta, -700, 700)))
    weight = n * p * (1 - p)
    lift = 0.0 if inverse is None else weight * np.einsum("ij,jk,ik->i", x, inverse, x) * (0.5 - p)
    like = (hits * -np.logaddexp(0, -eta) + (n - hits) * -np.logaddexp(0, eta)).sum()
    return np.concatenate([((x * weight[:, None]).T @ x).ravel(), x.T @ (hits - n * p + lift), [like, np.abs(eta).max(initial=0)]])


def summing(patterns: DataFrame, factors: list[str], numbers: set[str], terms: list[Term]) -> Sums:
    """The sums of all patterns' contributions at given coefficients: here if they are few, else by tasks."""
    k = len(terms)

    def read(batch: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        columns = {f: np.array([str(v) for v in batch.column(f).to_pylist()], dtype=object) if f not in numbers else np.array(batch.column(f).to_pylist(), dtype=float) for f in factors}
        return coded(columns, terms), np.array(batch.column("n").to_pylist(), dtype=float), np.array(batch.column("hits").to_pylist(), dtype=float)

    def split(total: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
        return total[: k * k].reshape(k, k), total[k * k : k * k + k], float(total[-2]), float(total[-1])

    if patterns.count() <= FEW_PATTERNS:
        held = read(patterns.toArrow())
        return lambda beta, inverse: split(contribution(*held, beta, inverse))

    def everywhere(beta: np.ndarray, inverse: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, float, float]:
        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    part = contribution(*read(batch), beta, inverse)
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(part))), pa.array(part)], ["at", "value"])

        parts = patterns.mapInArrow(each, "at long, value double").groupBy("at").agg(F.sum("value").alias("sum"), F.max("value").alias("max"))
        got = sorted(parts.collect())
        return split(np.array([r["sum"] for r in got[:-1]] + [got[-1]["max"]]))

    return everywhere


def independent(gram: np.ndarray) -> list[int]:
    """The columns that don't follow from earlier ones, from their sums of products."""
    scale = np.sqrt(np.diag(gram))
    kept: list[int] = []
    for j in range(len(gram)):
        if scale[j] == 0:
            continue
        unit = gram[np.ix_([*kept, j], [*kept, j])] / np.outer(scale[[*kept, j]], scale[[*kept, j]])
        rest = unit[-1, -1] - (unit[-1, :-1] @ np.linalg.solve(unit[:-1, :-1], unit[:-1, -1]) if kept else 0.0)
        if rest > 1e-9:
            kept.append(j)
    return kept


def climb(sums: Sums, k: int, penalised: bool) -> tuple[np.ndarray, np.ndarray, float, np.ndarray]:
    """(coefficients, inverse of the information, log-likelihood, which coefficients run away) after Newton steps, halved while they don't climb."""
    beta, away = np.zeros(k), np.zeros(k, bool)

    def at(b: np.ndarray) -> tuple:
        information, score, like, far = sums(b, None)
        goal = like + (np.linalg.slogdet(information)[1] / 2 if penalised else 0.0)
        return information, score, like, far, goal

    now = at(beta)
    for _ in range(STEPS):
        inverse = np.linalg.pinv(now[0], hermitian=True)
        step = inverse @ (sums(beta, inverse)[1] if penalised else now[1])
        if not penalised and now[3] > FAR and np.abs(step).max() > 0.1:
            return beta, inverse, now[2], np.abs(step) > 0.1
        if penalised:
            step *= min(1.0, 5 / max(np.abs(step).max(), 1e-300))
        for _ in range(30):
            new = at(beta + step)
            if np.isfinite(new[4]) and new[4] >= now[4] - 1e-9 * abs(now[4]):
                break
            step = step / 2
        beta, now = beta + step, new
        if np.abs(step).max() <= CLOSE * (1 + np.abs(beta).max()):
            break
    return beta, np.linalg.inv(now[0]), now[2], away


def grid_logit(df: DataFrame, outcome: str, formula: str, min_rows: int = 10) -> DataFrame | None:
    """(term, estimate, odds_ratio, ci_lower, ci_upper, mcfadden_r2, base_rate, n, separated) of a logistic regression; None with too few rows or a constant outcome.

    Text factors have a term `factor_level` for each level but the first in sorted order; interactions join terms by a colon. separated marks
    terms whose likelihood has no maximum; all estimates are penalised ones then, and finite.
    """
    parts = read_formula(formula)
    factors = list(dict.fromkeys(f for t in parts for f in t))
    numbers = {f for f in factors if df.schema[f].dataType.typeName() in ("byte", "short", "integer", "long", "float", "double", "decimal")}
    patterns = saved(covariate_patterns(df, outcome, factors))
    n, hits = patterns.agg(F.sum("n"), F.sum("hits")).first()
    if not n or n < min_rows or not 0 < hits < n:
        return None
    levels: dict[str, list[str | None]] = {f: [None] for f in numbers}
    for f in set(factors) - numbers:
        found = [r[0] for r in patterns.select(f).distinct().limit(MOST_TERMS + 1).collect()]
        if len(found) > MOST_TERMS:
            raise ValueError(f"{f} has more than {MOST_TERMS} levels")
        levels[f] = sorted(map(str, found))[1:]
    terms: list[Term] = [()]
    for part in parts:
        product: list[Term] = [()]
        for f in part:
            product = [(*t, (f, level)) for t in product for level in levels[f]]
        terms += product
    if len(terms) > MOST_TERMS:
        raise ValueError(f"{len(terms)} terms, more than {MOST_TERMS}")
    kept = independent(summing(patterns, factors, numbers, terms)(np.zeros(len(terms)), None)[0])
    sums = summing(patterns, factors, numbers, [terms[j] for j in kept])
    beta, inverse, like, away = climb(sums, len(kept), penalised=False)
    if away.any():
        beta, inverse, like, _ = climb(sums, len(kept), penalised=True)
    rate = hits / n
    null = n * (rate * np.log(rate) + (1 - rate) * np.log(1 - rate))
    name = lambda term: ":".join(f if level is None else f"{f}_{level}" for f, level in term) or "(intercept)"
    odds = lambda b: float(np.exp(np.clip(b, -700, 700)))
    fit = {j: (float(b), odds(b), odds(b - 1.96 * s), odds(b + 1.96 * s)) for j, b, s in zip(kept, beta, np.sqrt(np.diag(inverse)), strict=True)}
    lost = {j: bool(a) for j, a in zip(kept, away, strict=True)}
    rows = [(name(t), *fit.get(j, (None,) * 4), float(1 - like / null), float(rate), int(n), lost.get(j, False)) for j, t in enumerate(terms)]
    return df.sparkSession.createDataFrame(rows, FIELDS)
