"""Models of the interaction per branch, from sufficient statistics.

The trials of a branch are reduced to n, sum and sum of squares for each participant and cell; everything a 2 x 2 design
needs follows from those. The closed-form models are plain columns; the mixed models are solved from patterns of equal cell
counts (20 numbers each, never trials), many branches in a batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from specgrid.functions.stats import chi2_p_values, t_p_value, t_p_values
from specgrid.schema import RESULTS_SCHEMA

CELLS = ((1, 1), (1, -1), (-1, 1), (-1, -1))
MODELS = ("rmanova", "lmm_intercept", "lmm_cong_slope", "lmm_full_slope")


def model_rows(df: DataFrame) -> DataFrame:
    """Rows that a fit uses: finite positive rt and both codes, coded -0.5 and +0.5. Rows without a previous code are left out."""
    rt = F.col("rt")
    good = rt.isNotNull() & ~F.isnan(rt) & (rt > 0) & (rt < float("inf")) & F.col("cong").isin(-1, 1) & F.col("prev_cong").isin(-1, 1)
    return df.where(good).withColumns({"cong_code": F.col("cong") / 2, "prev_code": F.col("prev_cong") / 2})


def suff_stats(df: DataFrame, by: list[str]) -> DataFrame:
    """(by..., participant_id, cong, prev_cong, n, sy, syy): one shuffle, combined before it."""
    return model_rows(df).groupBy(*by, "participant_id", "cong", "prev_cong").agg(
        F.count("*").alias("n"), F.sum("rt").alias("sy"), F.sum(F.col("rt") * F.col("rt")).alias("syy")
    )


def wide_means(stats: DataFrame, by: list[str]) -> DataFrame:
    """(by..., participant_id, m11, m10, m01, m00, cells, n): each participant's cell means side by side."""
    mean = lambda c, p: F.max(F.when((F.col("cong") == c) & (F.col("prev_cong") == p), F.col("sy") / F.col("n")))
    names = dict(zip(CELLS, ("m11", "m10", "m01", "m00"), strict=True))
    return stats.groupBy(*by, "participant_id").agg(*(mean(*c).alias(names[c]) for c in CELLS), F.count("*").alias("cells"), F.sum("n").alias("n"))


def rmanova(stats: DataFrame, by: list[str]) -> DataFrame:
    """Interaction test of the 2 x 2 within-participants analysis of variance: F is t squared of the participants' contrasts.

    Participants with a missing cell are dropped and counted. ges is the generalised effect size from the design's error sums of squares.
    """
    wide = wide_means(stats, by).withColumns({"z": F.when(F.col("cells") == 4, F.col("m11") - F.col("m10") - F.col("m01") + F.col("m00"))})
    whole = F.col("cells") == 4
    a = F.when(whole, F.col("m11") + F.col("m10") - F.col("m01") - F.col("m00"))
    b = F.when(whole, F.col("m11") - F.col("m10") + F.col("m01") - F.col("m00"))
    s = F.when(whole, F.col("m11") + F.col("m10") + F.col("m01") + F.col("m00"))
    got = wide.withColumns({"a": a, "b": b, "s": s}).groupBy(*by).agg(
        F.count("z").alias("n_complete"), F.count(F.when(~whole, 1)).alias("n_dropped"), F.avg("z").alias("estimate"), F.stddev_samp("z").alias("sd"),
        *(F.var_samp(c).alias(f"v_{c}") for c in "abs"), F.var_samp("z").alias("v_z"), F.sum(F.when(whole, F.col("n"))).alias("n_obs"),
    )
    k = F.col("n_complete")
    t = F.when((k >= 2) & (F.col("sd") > 0), F.col("estimate") / (F.col("sd") / F.sqrt(k)))
    # a contrast of four means with unit coefficients carries a quarter of its square per participant
    effect = k * F.col("estimate") ** 2 / 4
    errors = (k - 1) * (F.col("v_a") + F.col("v_b") + F.col("v_s") + F.col("v_z")) / 4
    got = got.withColumn("t", t).withColumns({"std_error": F.when(k >= 2, F.col("sd") / F.sqrt(k)), "f": F.col("t") ** 2, "df1": F.lit(1), "df2": (k - 1).cast("int"), "ges": F.when(effect + errors > 0, effect / (effect + errors))})
    return got.select(*by, "n_complete", "n_dropped", "n_obs", "estimate", "std_error", "t", "f", "df1", "df2", "ges")


def with_p_values(fits: DataFrame, t: str = "t", df: str = "df2") -> DataFrame:
    return fits.withColumn("p_value", t_p_value(F.col(t), F.col(df)))


def cell_mean_t(df: DataFrame, by: list[str], strict: bool = False) -> DataFrame:
    """One-sample t of participant contrasts of cell means, on raw and on log times; strict gives an error where a participant lacks a cell."""
    out = None
    for scale, rows in (("raw", df), ("log", df.withColumn("rt", F.when(F.col("rt") > 0, F.log("rt"))))):
        stats = df_stats(rows, by)
        got = rmanova(stats, by).select(*by, F.lit(scale).alias("scale"), "n_complete", "n_dropped", "estimate", "std_error", "t", F.col("df2").alias("df"))
        bad = F.lit(strict) & (F.col("n_dropped") > 0)
        got = got.withColumn("error", bad).withColumns({c: F.when(~bad, F.col(c)) for c in ("estimate", "std_error", "t")})
        out = got if out is None else out.unionByName(got)
    return out


def df_stats(df: DataFrame, by: list[str]) -> DataFrame:
    """suff_stats without the demand that times are positive, for log times."""
    good = df.where(F.col("rt").isNotNull() & ~F.isnan("rt") & F.col("cong").isin(-1, 1) & F.col("prev_cong").isin(-1, 1))
    return good.groupBy(*by, "participant_id", "cong", "prev_cong").agg(F.count("*").alias("n"), F.sum("rt").alias("sy"), F.sum(F.col("rt") * F.col("rt")).alias("syy"))


def participant_fe_lm(stats: DataFrame, by: list[str]) -> DataFrame:
    """Interaction of rt ~ cong * prev_cong + participant: participants' means are taken out, which leaves three normal equations."""
    x = {"c": F.col("cong") / 2, "p": F.col("prev_cong") / 2, "i": F.col("cong") * F.col("prev_cong") / 4}
    own = stats.groupBy(*by, "participant_id").agg(
        F.sum("n").alias("n"), F.sum("sy").alias("sy"), F.sum("syy").alias("syy"),
        *(F.sum(F.col("n") * v).alias(f"s{k}") for k, v in x.items()), *(F.sum(F.col("sy") * v).alias(f"y{k}") for k, v in x.items()),
        *(F.sum(F.col("n") * x[a] * x[b]).alias(f"x{a}{b}") for a, b in ("cc", "cp", "ci", "pp", "pi", "ii")),
    )
    within = lambda total, a, b: F.sum(F.col(total) - F.col(a) * F.col(b) / F.col("n"))
    got = own.groupBy(*by).agg(
        F.sum("n").alias("n_obs"), F.count("*").alias("n_participants"), within("syy", "sy", "sy").alias("yy"),
        *(within(f"y{k}", f"s{k}", "sy").alias(f"b{k}") for k in "cpi"), *(within(f"x{a}{b}", f"s{a}", f"s{b}").alias(f"a{a}{b}") for a, b in ("cc", "cp", "ci", "pp", "pi", "ii")),
    )
    a = {k: F.col(f"a{k}") for k in ("cc", "cp", "ci", "pp", "pi", "ii")}
    minors = [a["cp"] * a["pi"] - a["ci"] * a["pp"], a["ci"] * a["cp"] - a["cc"] * a["pi"], a["cc"] * a["pp"] - a["cp"] * a["cp"]]
    det = a["ci"] * minors[0] + a["pi"] * minors[1] + a["ii"] * minors[2]
    got = got.withColumns({"det": det, "m0": minors[0], "m1": minors[1], "m2": minors[2]})
    good = F.col("det") > 1e-9 * F.col("acc") * F.col("app") * F.col("aii")
    got = got.withColumn("estimate", F.when(good, (F.col("m0") * F.col("bc") + F.col("m1") * F.col("bp") + F.col("m2") * F.col("bi")) / F.col("det")))
    # the other two coefficients, for the residual sum of squares
    c0 = (a["pp"] * a["ii"] - a["pi"] ** 2, a["ci"] * a["pi"] - a["cp"] * a["ii"], a["cp"] * a["pi"] - a["ci"] * a["pp"])
    c1 = (a["ci"] * a["pi"] - a["cp"] * a["ii"], a["cc"] * a["ii"] - a["ci"] ** 2, a["ci"] * a["cp"] - a["cc"] * a["pi"])
    dot = lambda r: (r[0] * F.col("bc") + r[1] * F.col("bp") + r[2] * F.col("bi")) / F.col("det")
    rss = F.col("yy") - dot(c0) * F.col("bc") - dot(c1) * F.col("bp") - F.col("estimate") * F.col("bi")
    df = F.col("n_obs") - F.col("n_participants") - 3
    got = got.withColumns({"df": df, "std_error": F.when(good & (df > 0), F.sqrt(F.greatest(rss, F.lit(0.0)) / df * F.col("m2") / F.col("det"))), "error": ~good})
    return got.select(*by, "n_obs", "n_participants", "estimate", "std_error", F.when(F.col("std_error") > 0, F.col("estimate") / F.col("std_error")).alias("t"), "df", "error")


# --- mixed models -----------------------------------------------------------------------------------------------------

FIT_FIELDS = (
    "n_obs int, n_participants int, main_estimate double, main_std_error double, main_t_stat double, df double, main_p_value double, effect_ci_lower double, effect_ci_upper double,"
    " residual_var double, random_intercept_var double, random_cong_slope_var double, random_prev_cong_slope_var double, random_cse_slope_var double, full_repca_min_sd double,"
    " full_is_singular boolean, full_converged boolean, null_converged boolean, loglik_full double, loglik_null double, npar_full int, npar_null int,"
    " AIC_diff double, BIC_diff double, LR_stat double, LR_df int, LR_p double, fallback_level string, fallback_p_value double, error boolean, error_message string"
)
RANDOM = {"lmm_intercept": 1, "lmm_cong_slope": 2, "lmm_full_slope": 4}
#: A random-effect sd, relative to the residual's, below which a fit is singular.
SINGULAR = 1e-4


#: A row of the design (intercept, both codes, interaction) for each cell.
X_CELLS = np.array([[1, c / 2, p / 2, c * p / 4] for c, p in CELLS])
PAIRS = [(i, j) for i in range(4) for j in range(i, 4)]


class Design:
    """What a branch's likelihood needs: participants of equal cell counts are one pattern, with the sums and cross-products of their cells' sums.

    The response of a participant has covariance s2 (I + Z L L' Z'), Z being the first q columns of its design and L a lower
    triangle of theta. For a pattern everything follows from its q x q matrices, whatever the number of its participants.
    """

    def __init__(self, counts: np.ndarray, people: np.ndarray, sums: np.ndarray, products: np.ndarray, squares: float, q: int):
        self.q, self.m, self.squares = q, people.astype(float), float(squares)
        self.n, self.people = float((counts.sum(axis=1) * people).sum()), int(people.sum())
        self.xx = np.einsum("uc,ci,cj->uij", counts.astype(float), X_CELLS, X_CELLS)
        self.t, self.tt = sums @ X_CELLS, np.einsum("ci,ucd,dj->uij", X_CELLS, products, X_CELLS)
        self.parts = (counts, people, sums, products, squares)
        self.at = np.tril_indices(q)
        self.units = np.zeros((len(self.at[0]), q, q))
        self.units[np.arange(len(self.at[0])), self.at[0], self.at[1]] = 1.0

    def of(self, q: int) -> Design:
        """The same data with q random effects."""
        return Design(*self.parts, q)

    def look(self, theta: np.ndarray, p: int, reml: bool, log_sd: float | None = None, bend: bool = False) -> dict:
        """Criterion (-2 log likelihood), its gradient and, with bend, its average information at theta, for the first p fixed effects.

        The residual variance is profiled out unless log_sd gives the logarithm of its root; the gradient then ends with that.
        """
        q, m, free = self.q, self.m, self.n - (p if reml else 0)
        lam = np.zeros((q, q))
        lam[self.at] = theta
        a, zx, tz = self.xx[:, :q, :q], self.xx[:, :q, :p], self.t[:, :q]
        inner = np.eye(q) + lam.T @ a @ lam
        r = lam @ np.linalg.inv(inner) @ lam.T
        k = np.eye(q) - a @ r
        s, b = k @ a, k @ zx
        xvx = (m[:, None, None] * (self.xx[:, :p, :p] - zx.transpose(0, 2, 1) @ r @ zx)).sum(axis=0)
        xvy = self.t[:, :p].sum(axis=0) - (zx.transpose(0, 2, 1) @ (r @ tz[:, :, None])).sum(axis=0)[:, 0]
        inverse = np.linalg.inv(xvx)
        beta = inverse @ xvy
        rss = max(self.squares - (r * self.tt[:, :q, :q]).sum() - xvy @ beta, 1e-12)
        variance = rss / free if log_sd is None else np.exp(2 * log_sd)
        value = (m * np.linalg.slogdet(inner)[1]).sum() + free * np.log(2 * np.pi * variance) + rss / variance + (np.linalg.slogdet(xvx)[1] if reml else 0.0)
        # what is left of each pattern: sums and cross-products of Z'V^-1 (y - X beta)
        fitted, kt = b @ beta, (k @ tz[:, :, None])[:, :, 0]
        cross = kt[:, :, None] * fitted[:, None, :]
        w = kt - m[:, None] * fitted
        ww = k @ self.tt[:, :q, :q] @ k.transpose(0, 2, 1) - cross - cross.transpose(0, 2, 1) + m[:, None, None] * fitted[:, :, None] * fitted[:, None, :]
        slope = (m[:, None, None] * s).sum(axis=0) - ww.sum(axis=0) / variance
        if reml:
            slope -= np.tensordot(m[:, None, None] * (b @ inverse), b, axes=([0, 2], [0, 2]))
        grad = 2 * (slope @ lam)[self.at]
        out = {"value": value, "grad": grad, "beta": beta, "inverse": inverse, "variance": variance, "lam": lam, "slope": slope}
        moves = self.units @ lam.T
        moves = moves + moves.transpose(0, 2, 1)
        if log_sd is not None:
            out["grad"] = np.append(grad, 2 * free - 2 * rss / variance)
            last = b @ inverse[:, -1]
            out["spread"] = (moves * ((m[:, None] * last).T @ last)).sum(axis=(1, 2))
        if bend:
            toward = np.tensordot(np.tensordot(w, moves, axes=(1, 2)), b, axes=([0, 2], [0, 1]))
            # one parameter at a time: all at once would hold a matrix for each pattern and parameter
            sw = np.stack([(s @ move @ ww).sum(axis=0) for move in moves])
            info = ((moves[:, None] * sw).sum(axis=(2, 3)) - toward @ inverse @ toward.T) / variance
            drawn = (moves * ww.sum(axis=0)).sum(axis=(1, 2)) / variance
            i, j = self.at
            # the covariance is a square of theta, which bends the criterion by its own slope as well
            out["info"] = info - np.outer(drawn, drawn) / free + 2 * slope[np.ix_(i, i)] * (j[:, None] == j)
        return out


def grown(m: Design, here: dict, p: int, reml: bool) -> np.ndarray | None:
    """A theta that is better than a stationary one, if a random effect that it lacks would help: along the most negative slope in the covariance."""
    low, along = np.linalg.eigh(here["slope"])
    if low[0] >= -1e-9 * m.n:
        return None
    for size in (1e-1, 1e-2, 1e-3, 1e-4, 1e-6):
        cov = here["lam"] @ here["lam"].T + size * np.outer(along[:, 0], along[:, 0])
        new = np.linalg.cholesky(cov + np.eye(m.q) * 1e-14)[m.at]
        if m.look(new, p, reml)["value"] < here["value"] - 1e-9:
            return new
    return None


def fit_mixed(m: Design, p: int, reml: bool, rounds: int = 100) -> tuple[np.ndarray, dict, bool]:
    """(theta, the likelihood there, converged): Newton steps, projected on relative sds of 0 at least and halved until they help.

    Where they end, the slope in the covariance itself has to be that of a smallest value: theta alone has stationary points wherever an effect is 0.
    """
    diagonal = m.at[0] == m.at[1]
    theta, lower = np.where(diagonal, 0.3, 0.0), np.where(diagonal, 0.0, -np.inf)
    here = m.look(theta, p, reml, bend=True)
    for _ in range(rounds):
        g = here["grad"]
        free = ~((theta <= lower) & (g >= 0))
        better = None
        if free.any():
            bent, along = np.linalg.eigh(here["info"][np.ix_(free, free)])
            bent = np.maximum(np.abs(bent), 1e-9 * np.abs(bent).max() + 1e-12)
            step = -along @ ((along.T @ g[free]) / bent)
            worth = float(-step @ g[free])
            step = step / max(1.0, float(np.linalg.norm(step)))
            size = 1.0 if worth > 1e-14 * (1 + abs(here["value"])) else 0.0
            while size > 1e-6:
                new = theta.copy()
                new[free] = np.maximum(theta[free] + size * step, lower[free])
                there = m.look(new, p, reml, bend=True)
                # close to the end the criterion is flatter than its rounding, and a smaller slope tells
                if there["value"] < here["value"] - 1e-11 * (1 + abs(here["value"])) or worth < 1e-5 and np.abs(there["grad"][free]).max() < 0.5 * np.abs(g[free]).max():
                    better = new, there
                    break
                size /= 2
        if better is None:
            new = grown(m, here, p, reml)
            if new is None:
                return theta, here, not free.any() or bool(np.abs(g[free]).max() < 1e-6 * (1 + abs(here["value"])))
            better = new, m.look(new, p, reml, bend=True)
        theta, here = better
    return theta, here, False


def satterthwaite(m: Design, theta: np.ndarray, variance: float) -> float | None:
    """Degrees of freedom of the interaction: the gradient of its variance against the curvature of the REML criterion in theta and the residual's log sd."""
    log_sd = 0.5 * np.log(variance)
    at = m.look(theta, 4, True, log_sd)
    k, step = len(theta) + 1, 1e-4
    bend = np.empty((k, k))
    for i in range(k):
        move = np.zeros(k)
        move[i] = step
        up, down = (m.look(theta + x[:-1], 4, True, log_sd + x[-1])["grad"] for x in (move, -move))
        bend[i] = (up - down) / (2 * step)
    spread = variance * at["inverse"][3, 3]
    grad = np.append(variance * at["spread"], 2 * spread)
    try:
        below = grad @ (2 * np.linalg.inv((bend + bend.T) / 2)) @ grad
    except np.linalg.LinAlgError:
        return None
    df = 2 * spread**2 / below if below > 0 else np.nan
    return float(df) if np.isfinite(df) and df > 0 else None


def fit_branch(design: Design, model: str) -> dict:
    """One mixed model on one branch's patterns, as a row of FIT_FIELDS; a failure is a row too."""
    out = dict.fromkeys((f.split()[0] for f in FIT_FIELDS.split(", ")))
    out |= {"error": False, "n_obs": int(design.n), "n_participants": design.people}
    try:
        m, q = design.of(RANDOM[model]), RANDOM[model]
        theta, best, fine = fit_mixed(m, 4, True)
        beta, variance = best["beta"], float(best["variance"])
        se = float(np.sqrt(variance * best["inverse"][3, 3]))
        t = float(beta[3] / se)
        df = satterthwaite(m, theta, variance) if fine else None
        cov = best["lam"] @ best["lam"].T
        sds = np.sqrt(np.maximum(np.linalg.eigvalsh(cov), 0))
        named = dict(zip(("random_intercept_var", "random_cong_slope_var", "random_prev_cong_slope_var", "random_cse_slope_var"), (np.diag(cov) * variance).tolist(), strict=False))
        full, null = fit_mixed(m, 4, False), fit_mixed(m, 1, False)
        above, below = float(full[1]["value"]), float(null[1]["value"])
        lr = max(0.0, below - above)
        extra = len(theta) + 1
        out |= named | {
            "main_estimate": float(beta[3]), "main_std_error": se, "main_t_stat": t, "df": df, "main_p_value": float(t_p_values(np.array([t]), np.array([df]))[0]) if df else None,
            "effect_ci_lower": float(beta[3] - 1.959963984540054 * se), "effect_ci_upper": float(beta[3] + 1.959963984540054 * se), "residual_var": variance,
            "full_repca_min_sd": float(sds.min()), "full_is_singular": bool(sds.min() <= SINGULAR), "full_converged": bool(fine and full[2]), "null_converged": bool(null[2]),
            "loglik_full": -above / 2, "loglik_null": -below / 2, "npar_full": 4 + extra, "npar_null": 1 + extra,
            "AIC_diff": above - below + 6, "BIC_diff": float(above - below + 3 * np.log(m.n)), "LR_stat": lr, "LR_df": 3, "LR_p": float(chi2_p_values(np.array([lr]), 3)[0]),
        }
        if q > 1 and (not out["full_converged"] or out["full_is_singular"]):
            smaller = "lmm_cong_slope" if model == "lmm_full_slope" else "lmm_intercept"
            again = fit_branch(design, smaller)
            out |= {"fallback_level": again["fallback_level"] or smaller, "fallback_p_value": again["fallback_p_value"] or again["main_p_value"]}
    except (np.linalg.LinAlgError, ValueError, ZeroDivisionError, FloatingPointError) as e:
        out |= {"error": True, "error_message": str(e)[:200]}
    return out


def patterns(stats: DataFrame, by: list[str]) -> DataFrame:
    """(by..., n0..n3, people, s0..s3, p0_0..p3_3, squares): participants of equal cell counts as one row, with sums and products of their cells' sums."""
    cell = lambda name, i: F.expr(f"coalesce(max(if(cong = {CELLS[i][0]} and prev_cong = {CELLS[i][1]}, {name}, null)), 0)")
    wide = stats.groupBy(*by, "participant_id").agg(*(cell("n", i).cast("long").alias(f"n{i}") for i in range(4)), *(cell("sy", i).cast("double").alias(f"y{i}") for i in range(4)), F.sum("syy").alias("yy"))
    return wide.groupBy(*by, "n0", "n1", "n2", "n3").agg(
        F.count("*").alias("people"), *(F.expr(f"sum(y{i}) as s{i}") for i in range(4)), *(F.expr(f"sum(y{i} * y{j}) as p{i}_{j}") for i, j in PAIRS), F.sum("yy").alias("squares"),
    )


def design_of(rows: np.ndarray) -> Design:
    """From patterns as rows of numbers, in the order of `patterns`."""
    products = np.zeros((len(rows), 4, 4))
    for at, (i, j) in enumerate(PAIRS):
        products[:, i, j] = products[:, j, i] = rows[:, 9 + at]
    return Design(rows[:, :4], rows[:, 4], rows[:, 5:9], products, rows[:, 19].sum(), 4)


def mixed_models(stats: DataFrame, by: list[str], models: tuple[str, ...] = ("lmm_intercept", "lmm_cong_slope", "lmm_full_slope")) -> DataFrame:
    """A row for each branch and mixed model. A branch comes to Python as its patterns, many branches in a batch; its models are solved in different tasks."""
    names = [*(f"n{i}" for i in range(4)), "people", *(f"s{i}" for i in range(4)), *(f"p{i}_{j}" for i, j in PAIRS), "squares"]
    fields = T.StructType.fromDDL(FIT_FIELDS)
    arrow = {f.name: {"integer": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}[f.dataType.typeName()] for f in fields}

    def solve(batches):
        for batch in batches:
            flat, edges = batch.column("rows").flatten(), batch.column("rows").offsets.to_numpy()
            numbers = flat.flatten().to_numpy().reshape(len(flat), len(names))
            rows = [fit_branch(design_of(numbers[a - edges[0] : b - edges[0]]), model) for a, b, model in zip(edges[:-1], edges[1:], batch.column("model").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("model"), *(pa.array([r[f] for r in rows], kind) for f, kind in arrow.items())], ["key", "model", *arrow])

    key = F.struct(*(F.col(c).alias(f"k{i}") for i, c in enumerate(by)), F.lit(True).alias("whole"))
    each = patterns(stats, by).groupBy(key.alias("key")).agg(F.collect_list(F.array(*(F.col(c).cast("double") for c in names))).alias("rows"))
    each = each.select("key", "rows", F.explode(F.array(*map(F.lit, models))).alias("model")).repartition("key", "model")
    got = each.mapInArrow(solve, T.StructType([each.schema["key"], each.schema["model"], *fields]))
    return got.select(*(F.col(f"key.k{i}").alias(c) for i, c in enumerate(by)), "model", *arrow)


# --- result rows --------------------------------------------------------------------------------------------------------


def result_rows(branches: DataFrame, fits: DataFrame) -> DataFrame:
    """A row of RESULTS_SCHEMA for every planned branch: what the fit gives, else an error row. fits are keyed by branch_id."""
    own = [c for c in fits.columns if c != "branch_id" and c in RESULTS_SCHEMA.names]
    got = branches.select("branch_id", F.col("branch_idx").cast("long"), "sample_size", "subsample_id", "transformation", "outlier", "model", "effect_condition", "strip_method")
    got = got.join(fits.select("branch_id", F.lit(True).alias("__fit"), *(c for c in own if c not in got.columns)), "branch_id", "left")
    lost = F.col("__fit").isNull()
    err = F.coalesce(F.col("error"), F.lit(False)) if "error" in got.columns else F.lit(False)
    message = F.col("error_message") if "error_message" in got.columns else F.lit(None).cast("string")
    got = got.withColumns({"error": lost | err, "error_message": F.when(lost, F.lit("no fit for this branch")).otherwise(message), "stage_completed": F.when(lost, F.lit("planned")).otherwise(F.lit("fitted"))})
    if {"main_estimate", "residual_var"} <= set(got.columns):
        got = got.withColumn("effect_size", F.coalesce(*( [F.col("effect_size")] if "effect_size" in got.columns else []), F.when(F.col("residual_var") > 0, F.col("main_estimate") / F.sqrt("residual_var"))))
    return got.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in got.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in RESULTS_SCHEMA))


def anova_results(fits: DataFrame) -> DataFrame:
    """rmanova fits under the names of the result columns."""
    return with_p_values(fits).select(
        "branch_id", F.col("n_obs").cast("int").alias("n_obs"), F.col("n_complete").cast("int").alias("n_participants"), (F.col("estimate")).alias("main_estimate"),
        F.col("std_error").alias("main_std_error"), F.col("t").alias("main_t_stat"), F.col("p_value").alias("main_p_value"), F.col("ges").alias("effect_size"),
        F.lit(True).alias("full_converged"), F.lit(False).alias("full_is_singular"), (F.col("n_complete") < 2).alias("error"),
        F.when(F.col("n_complete") < 2, "fewer than two complete participants").alias("error_message"), F.lit("primary").alias("inference_source"),
    )


def select_interaction(terms: DataFrame, by: list[str], a: str = "cong", b: str = "prev_cong") -> DataFrame:
    """(by..., n_terms, term, estimate, error): the a:b term in either order, level suffixes allowed; none gives null, several an error."""
    parts = F.split(F.col("term"), ":")
    suffix = r"([0-9.+-]|\[.*\])*$"
    side = lambda i, name: F.coalesce(F.get(parts, i - 1), F.lit("")).rlike(f"^{name}{suffix}")
    hit = (F.size(parts) == 2) & ((side(1, a) & side(2, b)) | (side(1, b) & side(2, a)))
    got = terms.withColumn("hit", hit).groupBy(*by).agg(F.count(F.when(F.col("hit"), 1)).alias("n_terms"), F.min(F.when(F.col("hit"), F.col("term"))).alias("term"), F.min(F.when(F.col("hit"), F.col("estimate"))).alias("estimate"))
    one = F.col("n_terms") == 1
    return got.select(*by, "n_terms", F.when(one, F.col("term")).alias("term"), F.when(one, F.col("estimate")).alias("estimate"), (F.col("n_terms") > 1).alias("error"))


def collapse_separated(df: DataFrame, outcome: str, factor: str, other: str = "other_separated") -> DataFrame:
    """df with the factor's levels in which the outcome never or always occurs merged into one."""
    rate = df.groupBy(F.col(factor).alias("__level")).agg(F.avg(F.col(outcome).cast("int")).alias("__rate"))
    got = df.join(rate, F.col(factor).eqNullSafe(F.col("__level")), "left")
    return got.withColumn(factor, F.when((F.col("__rate") == 0) | (F.col("__rate") == 1), F.lit(other)).otherwise(F.col(factor))).drop("__level", "__rate")


def significant(p: Column, alpha: float = 0.05) -> Column:
    return p < alpha
