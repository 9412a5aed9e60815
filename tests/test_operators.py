"""Known answers, invariants and bounds of the operators."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from specgrid import registry
from specgrid.functions import order, stats
from specgrid.functions.quantile import inverse_on_grid, quantile_type8
from specgrid.operators import audit, diagnostics, grid, logit, materialize, models, nullify, report, sampling, tables
from specgrid.plans import index, scale
from specgrid.schema import RESULTS_SCHEMA
from specgrid.sources import io
from specgrid.sources.scratch import saved
from specgrid.sources.views import view

CELLS = [(1, 1), (1, -1), (-1, 1), (-1, -1)]


def trials(spark, rows):
    """rows of (participant, cong, prev, rt), in order."""
    data, at = [], {}
    for i, (p, c, q, rt) in enumerate(rows):
        at[p] = at.get(p, 0) + 1
        data.append(("s", p, i + 1, at[p], 1 + at[p] // 50, c, q, float(rt) if rt is not None else None, True, True))
    return spark.createDataFrame(data, "study string, participant_id string, source_row long, trial_index long, block_index long, cong int, prev_cong int, rt double, correct boolean, prev_correct boolean")


def location(spark, people=6, reps=30, cse=42):
    return trials(spark, [(f"p{p}", c, q, 600 + 7 * p + 18 * c + 11 * q + cse * c * q + 0.35 * (r - reps / 2)) for p in range(people) for r in range(reps) for c, q in CELLS])


def contrast(df):
    m = {(r[0], r[1]): r[2] for r in df.groupBy("cong", "prev_cong").agg(F.avg("rt")).collect()}
    return m[1, 1] - m[1, -1] - m[-1, 1] + m[-1, -1], (m[1, 1] + m[1, -1] - m[-1, 1] - m[-1, -1]) / 2


def test_location_effect_is_removed(spark):
    df = location(spark)
    before, cong = contrast(df)
    assert abs(before - 168) < 1e-6
    for method, most in (("additive_qmap", 1), ("local_mean_residual", 1), ("local_median_residual", 1)):
        after, cong_after = contrast(nullify.nullify(df, method))
        assert abs(after) < most, method
        assert abs(cong_after - cong) < 1
    assert abs(contrast(nullify.shuffle(df))[0]) < 0.3 * before


def test_shuffle_keeps_multisets(spark):
    df = location(spark, 3, 10)
    once, again = (sorted(map(tuple, nullify.shuffle(df).select("source_row", "rt").collect())) for _ in range(2))
    assert once == again
    got = diagnostics.multiset_compare(df, nullify.shuffle(df)).first()
    assert got["preserved"] and got["n_groups"] == 6
    assert not diagnostics.multiset_compare(df, df.withColumn("rt", F.col("rt") + (F.col("source_row") == 1).cast("int"))).first()["preserved"]


def plain_qmap(rows, grid_n=200):
    """The quantile map in plain loops, for cells of two or more."""
    taus = np.linspace(0, 1, grid_n)

    def curve(xs):
        xs = np.sort(xs)
        h = np.clip((len(xs) + 1 / 3) * taus + 1 / 3, 1, len(xs))
        low = np.floor(h).astype(int)
        return xs[low - 1] + (h - low) * (xs[np.minimum(low, len(xs) - 1)] - xs[low - 1])

    out = []
    for i, (p, c, q, rt) in enumerate(rows):
        own = [r for r in rows if r[0] == p]
        cell = np.array([r[3] for r in own if r[1] == c and r[2] == q])
        tau = (cell <= rt).mean()
        read = lambda xs: np.interp(tau, taus, curve(np.array(xs)))  # noqa: B023, E731
        out.append((i + 1, read([r[3] for r in own if r[1] == c]) + read([r[3] for r in own if r[2] == q]) - read([r[3] for r in own])))
    return out


def test_qmap_equals_plain_loops(spark):
    rng = np.random.default_rng(1)
    rows = [(f"p{p}", c, q, float(np.round(rng.gamma(9, 60), 1))) for p in range(3) for _ in range(7) for c, q in CELLS]
    got = sorted(map(tuple, nullify.additive_qmap(trials(spark, rows)).select("source_row", "rt").collect()))
    for (i, a), (j, b) in zip(got, plain_qmap(rows), strict=True):
        assert i == j and abs(a - b) < 1e-9


def test_large_participants_are_spread_with_the_same_numbers(spark, monkeypatch):
    """A third of all rows on one participant, many ties, a cell of one, a null participant and rows without a code."""
    rng = np.random.default_rng(5)
    rt = lambda: float(np.round(rng.gamma(9, 60), 0))
    rows = [("hot", c, q, rt()) for _ in range(50) for c, q in CELLS] + [(f"p{p}", c, q, rt()) for p in range(12) for _ in range(8) for c, q in CELLS]
    rows += [("odd", 1, 1, 400.0), ("hot", -1, None, 480.0), ("hot", 1, 1, None)] + [("flat", 1, 1, 500.0)] * 40 + [("flat", -1, 1, 510.0)] + [(None, c, q, rt()) for _ in range(9) for c, q in CELLS]
    order = rng.permutation(len(rows))
    df = trials(spark, [rows[i] for i in order]).repartition(7)
    methods = ("shuffle", "additive_qmap", "additive_qmap_trial_bin")
    values = lambda: {m: sorted((r["source_row"], r["rt"]) for r in nullify.nullify(df, m).select("source_row", "rt").collect()) for m in methods}
    want = values()
    monkeypatch.setattr(nullify, "TOGETHER", 35)
    got = values()
    for m in methods:
        assert len(got[m]) == len(want[m]) == len(rows), m
        for (i, a), (j, b) in zip(want[m], got[m], strict=True):
            assert i == j and (a == b or abs(a - b) < 1e-9), (m, i, a, b)


def test_running_counts_over_ranges(spark):
    rng = np.random.default_rng(6)
    rows = [(None if g == 2 else f"g{g}", float(v)) for g, n in ((0, 900), (1, 5), (2, 40)) for v in rng.integers(-20, 20, n)]
    df = spark.createDataFrame(rows, "g string, value double")
    got = {(r["g"], r["value"]): (r["upto"], r["total"]) for r in order.cumulative(order.counted(df, ["g"]), ["g"]).collect()}
    assert got == {(g, v): (sum(h == g and w <= v for h, w in rows), sum(h == g for h, _ in rows)) for g, v in rows}


def test_sparse_cells_and_nulls_pass_through(spark):
    df = trials(spark, [("a", 1, 1, 500), ("a", 1, 1, 520), ("a", 1, -1, 510), ("a", -1, None, 480), ("b", 1, 1, 700), ("a", -1, -1, None)])
    for method in grid.STRIPS:
        got = nullify.nullify(df, method)
        assert got.count() == 6
        values = {r["source_row"]: r["rt"] for r in got.collect()}
        assert values[4] == 480 and values[6] is None
        assert all(np.isfinite(v) for v in values.values() if v is not None)


def test_qmap_of_sparse_cells_equals_plain_loops(spark):
    rng = np.random.default_rng(2)
    rt = lambda: float(np.round(rng.gamma(9, 60), 1))
    rows = [("rich", c, q, rt()) for _ in range(7) for c, q in CELLS] + [("poor", c, q, rt()) for c, q in [*CELLS, (1, 1)]] + [("one", 1, -1, rt())]
    taus = np.linspace(0, 1, 200)

    def curve(xs):
        xs = np.sort(xs)
        h = np.clip((len(xs) + 1 / 3) * taus + 1 / 3, 1, len(xs))
        low = np.floor(h).astype(int)
        return xs[low - 1] + (h - low) * (xs[np.minimum(low, len(xs) - 1)] - xs[low - 1])

    got = {r["source_row"]: r["rt"] for r in nullify.additive_qmap(trials(spark, [*rows, ("poor", -1, None, 480)])).collect()}
    assert len(got) == len(rows) + 1 and got[len(rows) + 1] == 480
    for i, (p, c, q, x) in enumerate(rows):
        own = [r for r in rows if r[0] == p]
        cell = np.array([r[3] for r in own if r[1:3] == (c, q)])
        y = curve([r[3] for r in rows if r[1:3] == (c, q)])
        tau = (cell <= x).mean() if len(cell) > 1 else 0.0 if x <= y[0] else np.interp(x, *(lambda at: (y[at], taus[at]))(np.unique(y, return_index=True)[1]))
        want = x if len(own) < 2 else sum(sign * np.interp(tau, taus, curve([r[3] for r in own if keep(r)])) for sign, keep in ((1, lambda r: r[1] == c), (1, lambda r: r[2] == q), (-1, lambda r: True)))  # noqa: B023
        assert abs(got[i + 1] - want) < 1e-6, (i, p, c, q)


def test_branch_checks_of_every_study(spark):
    g = grid.Grid(fractions=(0.5, 1.0), samples=3, outliers=("none", "sd_2"), models=("rmanova",))
    every = grid.model_branches(spark, g).crossJoin(spark.createDataFrame([("s1",), ("s2",), ("s3",)], "study string"))
    twice = every.where("study = 's2' and branch_idx = 1")
    bad = {(r["study"], r["rule"]): r["n_bad"] for r in audit.branch_contract(every.unionByName(twice), 4, 2, 2, 6, 1, by=["study"]).collect()}
    assert len(bad) == 12 and {k: v for k, v in bad.items() if v} == {("s2", "rows"): 1, ("s2", "repeated_ids"): 1}
    got = {tuple(r) for r in audit.branch_coverage(every, every.where("study = 's3' or branch_idx = 1"), by=["study"]).collect()}
    assert got == {("s1", 96, 1, 95), ("s2", 96, 1, 95), ("s3", 96, 96, 0)}
    marked = audit.attach_data_id(every, every.unionByName(twice).where("study <> 's3'"), by=["study"]).where("id_problem is not null").groupBy("study", "id_problem").count()
    assert {tuple(r) for r in marked.collect()} == {("s2", "repeated", 1), ("s3", "absent", 96)}


def test_empty_table(spark):
    df = location(spark, 1, 1).where("false")
    for method in grid.STRIPS:
        assert nullify.nullify(df, method).count() == 0
    assert models.rmanova(models.suff_stats(df, ["study"]), ["study"]).count() == 0


def test_outlier_rules(spark):
    df = trials(spark, [("a", 1, 1, x) for x in (100, 400, 500, 600, 5000)] + [("a", 1, 1, None)])
    got = {r["outlier"]: (r["lo"], r["hi"]) for r in sampling.fences(df, [], ("none", "sd_2", "mad_2", "range_1000")).collect()}
    xs = np.array([100, 400, 500, 600, 5000.0])
    assert got["none"] == (None, None) and got["range_1000"] == (200, 1000) and got["mad_2"] == (300, 700)
    assert np.allclose(got["sd_2"], (xs.mean() - 2 * xs.std(ddof=1), xs.mean() + 2 * xs.std(ddof=1)))
    assert sampling.apply_rule(df, "none").count() == 6 and sampling.apply_rule(df, "mad_2").count() == 3


def test_sampling_counts(spark):
    df = location(spark, 5, 2)
    got = {(r[0], r[1]): r[2] for r in sampling.membership(df, grid.base_samples(spark, (0.0, 0.5, 1.0), 2)).groupBy("sample_size", "subsample_id").count().collect()}
    assert got == {(0.5, 1): 3, (0.5, 2): 3, (1.0, 1): 5}


def test_grid_counts_and_ids(spark):
    g = grid.Grid(fractions=(0.5, 1.0), samples=3, outliers=("none", "sd_2"), models=("rmanova", "lmm_intercept"))
    rows = grid.model_branches(spark, g).collect()
    assert len(rows) == 4 * 2 * 2 * 6 * 2 and len({r["branch_id"] for r in rows}) == len(rows) == max(r["branch_idx"] for r in rows)
    one = rows[0]
    assert one["branch_id"].startswith(("0.5__", "1__"))
    assert spark.range(1).select(grid.data_id_of(F.lit(one["branch_id"]))).first()[0] == one["data_id"]
    with pytest.raises(Exception, match="unknown"):
        spark.range(1).select(grid.normalized(F.lit("nope"), "outlier")).collect()


def test_scale_plan_equals_simple_plan(spark):
    df = location(spark, 6, 8)
    samples = grid.base_samples(spark, (0.5, 1.0), 2)
    args = (df, samples, ("none", "local_mean_residual"), ("none", "sd_2", "mad_2", "mad_2.5", "range_1000"), ("log_rt", "no_log_rt"))
    key = ["sample", "subsample_id", "strip_method", "outlier", "transformation", "participant_id", "cong", "prev_cong"]
    a, b = ({tuple(r[k] for k in key): (r["n"], r["sy"]) for r in f(*args).collect()} for f in (scale.grid_stats, scale.simple_grid_stats))
    assert a.keys() == b.keys() and all(a[k][0] == b[k][0] and abs(a[k][1] - b[k][1]) < 1e-6 for k in a)


@pytest.mark.parametrize("part", [8192, 5])
def test_grid_index_equals_simple_plan(spark, monkeypatch, part):
    """All ten rules, ties, nulls, missing codes, infinite and huge times, one-trial and hot participants cut into parts, and few probes in a pass."""
    monkeypatch.setattr(index, "PART", part)
    monkeypatch.setattr(index, "MOST", 16 if part == 5 else 512)
    rng = random.Random(2)
    rows = []
    for i in range(700):
        who = "hot" if i % 3 == 0 else f"p{rng.randrange(9)}"
        rt = rng.choice((None, float("nan"), 250.0, 250.0, 400.0, 1e9, 0.5, -3.0, rng.lognormvariate(6, 0.5), round(rng.lognormvariate(6, 0.4)) * 1.0, rng.lognormvariate(6.2, 0.6)))
        rows.append((who, i, i, rng.choice((1, -1)), rng.choice((1, -1, None)), rt))
    rows += [("lonely", 900, 1, 1, 1, 333.0)]
    df = spark.createDataFrame(rows, "participant_id string, source_row long, trial_index long, cong int, prev_cong int, rt double").withColumn("study", F.lit("s"))
    samples = grid.base_samples(spark, (0.3, 0.6, 1.0), 2)
    args = (df, samples, ("none", "local_mean_residual"), grid.OUTLIERS, ("log_rt", "no_log_rt"))
    key = ["sample", "subsample_id", "strip_method", "outlier", "transformation", "participant_id", "cong", "prev_cong"]
    a, b = ({tuple(r[k] for k in key): (r["n"], r["sy"], r["syy"]) for r in f(*args).collect()} for f in (scale.grid_stats, scale.simple_grid_stats))
    assert a.keys() == b.keys() and len(a) > 500
    assert all(a[k][0] == b[k][0] and all(math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-6) for x, y in zip(a[k][1:], b[k][1:], strict=True)) for k in a)
    # the fences themselves, and an infinite time in the data
    more = df.unionByName(df.where("source_row = 7").withColumns({"rt": F.lit(float("inf")), "source_row": F.lit(5000).cast("long")}))
    effects = nullify.long_effects(nullify.all_effects(more, ("none",)), ("none",))
    members = sampling.membership(more, samples)
    rules = ("none", "mad_2", "mad_2.5", "range_1250")
    got = index.fences(index.build(effects, members, ("none",)), effects, rules)
    want = sampling.fences(effects.join(members, "participant_id"), [*scale.KEYS, "strip_method"], rules)
    a, b = ({(r["sample"], r["subsample_id"], r["outlier"]): (r["lo"], r["hi"]) for r in x.collect()} for x in (got, want))
    assert a.keys() == b.keys() and all(x is y is None or math.isclose(x, y, rel_tol=1e-12) for k in a for x, y in zip(a[k], b[k], strict=True))


def test_no_trial_meets_a_sample(spark):
    """The grid's plan joins nothing to samples but participants: the statistics are read off the index in one map."""
    df = location(spark, 6, 8)
    plan = scale.grid_stats(df, grid.base_samples(spark, (0.5, 1.0), 2), ("none",), grid.OUTLIERS, ("log_rt",))._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "SortMergeJoin" not in plan and "CartesianProduct" not in plan and "Window" not in plan


def test_grouped_quantiles(spark, monkeypatch):
    """All groups at once, with buckets cut again, against plain ones."""
    monkeypatch.setattr(order, "SORTED", 20)
    monkeypatch.setattr(order, "CUTS", 4)
    rng = random.Random(6)
    kinds = {"a": lambda: rng.lognormvariate(6, 0.4), "b": lambda: float(rng.randrange(3)), "c": lambda: rng.gauss(0, 1) * 10 ** rng.randrange(-9, 9), "d": lambda: 500 + rng.random() * 1e-6, None: lambda: -rng.random()}
    rows = [(g, rng.randrange(3), kinds[g]()) for g in kinds for _ in range(400)] + [("one", 0, 7.5), ("two", 1, float("nan")), ("two", 1, None)]
    df = spark.createDataFrame(rows, "g string, h int, value double")
    shares = (0.0, 0.1, 0.25, 0.5, 0.9, 1.0)
    for kind in (7, 8):
        out = order.grouped_quantiles(df, [(["g"], shares), (["g", "h"], (0.5,)), (["h"], shares)], kind=kind)
        for keys, asked, got in zip((("g",), ("g", "h"), ("h",)), (shares, (0.5,), shares), out, strict=True):
            groups = {}
            for g, h, v in rows:
                if v is not None and not math.isnan(v):
                    groups.setdefault(tuple({"g": g, "h": h}[k] for k in keys), []).append(v)
            got = {tuple(r[k] for k in keys): r["quantiles"] for r in got.collect()}
            assert got.keys() == groups.keys()
            for k, vs in groups.items():
                vs = sorted(vs)
                for q, x in zip(asked, got[k], strict=True):
                    at = min(max((len(vs) - 1) * q if kind == 7 else (len(vs) + 1 / 3) * q + 1 / 3 - 1, 0), len(vs) - 1)
                    low = int(at)
                    assert math.isclose(x, vs[low] + (at - low) * (vs[min(low + 1, len(vs) - 1)] - vs[low]), rel_tol=1e-9, abs_tol=1e-12)
    empty = order.grouped_quantiles(df.where("false"), [(["g"], (0.5,))])[0]
    assert empty.count() == 0


def test_fingerprints_add_up(spark):
    """Order doesn't matter; a changed, added, lost or missing value does."""
    base = [(float(i % 7) + 0.25, i) for i in range(60)] + [(None, 99)]
    of = lambda rows: diagnostics.rt_fingerprint(spark.createDataFrame([("a", r[0]) for r in rows], "k string, rt double").repartition(3), ["k"]).first()["fingerprint"]
    same = of(base)
    assert of(base[::-1]) == same and of(base[:-1]) != same and of(base + base[:1]) != same and of([(7.5, 0), *base[1:]]) != same
    assert of([(1.0, 0), (3.0, 1)]) != of([(2.0, 0), (2.0, 1)])


def test_ranks_of_a_key_in_several_tasks(spark):
    """One key with nearly all rows: the ranks are those of a window, and no plan has a window over the rows of a key."""
    rng = random.Random(9)
    df = spark.createDataFrame([("big" if i % 50 else rng.choice(("a", None)), rng.randrange(300) * 1.0, i) for i in range(4000)], "k string, x double, i long").repartition(5)
    got = order.ranked(df, ["k"], ["x", "i"])
    want = {}
    for k, x, i in sorted(((r["k"] or "", r["x"], r["i"]) for r in df.collect())):
        want[i] = want.get(("n", k), 0) + 1
        want["n", k] = want[i]
    rows = got.collect()
    assert len(rows) == 4000 and all(r["rank"] == want[r["i"]] for r in rows)
    spread = got.where("k = 'big'").select(F.spark_partition_id().alias("p"), "rank").groupBy("p").count().collect()
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString() and len(spread) >= 1
    assert order.ranked(df.where("false"), ["k"], ["x", "i"]).count() == 0


def test_previous_slope_of_odd_rows(spark):
    """Times below 0 count, trials without codes don't; null below four trials or with one code."""
    rows = [("a", 1, 1, 5.0), ("a", 1, -1, -5.0), ("a", 1, 1, 3.0), ("a", -1, -1, 2.0), ("a", -1, 1, 8.0), ("a", 1, None, 99.0), ("a", None, 1, 4.0), ("a", None, -1, 1.0), ("a", 1, 3, 7.0), ("a", 1, 1, float("inf")), ("a", 1, -1, None)]
    make = lambda rs: spark.createDataFrame([(*r, "x") for r in rs], "participant_id string, cong int, prev_cong int, rt double, k string")
    used = [r for r in rows if r[3] is not None and math.isfinite(r[3]) and r[2] in (1, -1)]
    groups = {}
    for r in used:
        groups.setdefault((r[0], r[1]), []).append(r)
    xy = xx = 0.0
    for g in groups.values():
        mx, my = sum(r[2] for r in g) / len(g), sum(r[3] for r in g) / len(g)
        xy, xx = xy + sum((r[2] - mx) * (r[3] - my) for r in g), xx + sum((r[2] - mx) ** 2 for r in g)
    slope = lambda rs: diagnostics.conditional_previous_slope(make(rs), ["k"]).collect()
    assert math.isclose(slope(rows)[0][1], xy / xx)
    assert slope(used[:3])[0][1] is None and slope([("a", 1, 1, float(i)) for i in range(6)])[0][1] is None and slope([("a", 1, None, 2.0)]) == []


def test_diagnostics_of_a_known_effect(spark):
    df = trials(spark, [(f"p{p}", c, q, 600 + 10 * c + 5 * q + 25 * c * q + r) for p in range(4) for r in range(20) for c, q in CELLS])
    assert abs(diagnostics.cse_summary(df, ["study"]).first()["mean_cse"] - 100) < 1e-9
    assert diagnostics.pooled(df, ["study"]).first()["cell_min_n"] == 80
    approx = diagnostics.pooled(df, ["study"], 10000).first()
    assert abs(approx["q050_cse"] - 100) < 2


def test_diagnostics_are_of_valid_rows(spark):
    """Rows without a previous code, with times of 0 or less or not finite change nothing; an empty cell counts as a share of 0."""
    import math

    key = "participant_id string, study string, source_row long, trial_index long, block_index long, cong int, prev_cong int, rt double, prev_correct boolean"
    good = [("p%d" % p, "s", 100 * p + i, i, i // 6, c, q, 500.0 + 7 * ((i * i) % 11) + 3 * c + 2 * q + 5 * c * q + p, i % 3 > 0) for p in range(3) for i, (c, q) in enumerate(CELLS * 4)]
    odd = [("p0", "s", 900, 0, 0, 1, None, 9999.0, True), ("p1", "s", 901, 50, 3, 1, 1, 0.0, False), ("p1", "s", 902, 51, 3, -1, 1, -5.0, True), ("p2", "s", 903, 52, 3, 1, -1, math.inf, False), ("p2", "s", 904, 53, 3, -1, -1, math.nan, True), ("p9", "s", 905, 54, 3, 1, 1, None, True)]
    a, b = (spark.createDataFrame(rows, key) for rows in (good, good + odd))
    one = lambda df: diagnostics.branch_diagnostics(df, ["study"]).first().asDict()
    clean, mixed = one(a), one(b)
    assert mixed["n_rows"] == len(good) + 6 and mixed["n_valid"] == len(good) and mixed["n_participants"] == 3 and mixed["warnings"] == "dropped_invalid_rows=6" and clean["warnings"] == ""
    assert all(clean[k] == mixed[k] or abs(clean[k] - mixed[k]) < 1e-9 for k in clean if k not in ("n_rows", "warnings", "source_row_monotonic"))
    # the order is that of all rows: 900 comes before 1 in trial 0
    assert clean["source_row_monotonic"] and not mixed["source_row_monotonic"] and clean["studies"] == mixed["studies"] == "s" and clean["n_studies"] == 1
    x, y = (diagnostics.exchangeability(df).first().asDict() for df in (a, b))
    assert all(x[k] == y[k] or abs(x[k] - y[k]) < 1e-9 for k in x)
    lacking = one(a.where("not (cong = 1 and prev_cong = -1)"))
    assert abs(lacking["transition_imbalance"] - 1 / 3) < 1e-12 and lacking["cell_min_n"] == 0 and lacking["mean_cse"] is None and lacking["q050_cse"] is None
    assert lacking["warnings"] == "incomplete_participant_cells;no_finite_participant_cse;missing_pooled_cell"
    level = diagnostics.pooled(a.where("cong = 1"), ["study"]).first()
    assert level["transition_imbalance"] == 0.0 and diagnostics.exchangeability(a.where("cong = 1")).first()["transition_imbalance"] is None
    # two trials are enough for a slope; fewer than five different ones give no time bins
    two = a.where("trial_index in (0, 5) and participant_id = 'p0'").collect()
    want = (two[1]["rt"] - two[0]["rt"]) / (two[1]["trial_index"] - two[0]["trial_index"])
    assert abs(diagnostics.trial_slope(a.where("trial_index in (0, 5) and participant_id = 'p0'"), ["study"]).first()[1] - want) < 1e-9
    assert diagnostics.trial_slope(a.where("trial_index = 0"), ["study"]).first()[1] is None
    assert diagnostics.time_bin_contrast(a.where("trial_index < 4"), ["study"]).collect() == [] and diagnostics.time_bin_contrast(a, ["study"]).first()[1] is not None
    order = diagnostics.source_rows_monotonic(b.withColumn("trial_index", F.when(F.col("source_row") == 3, 1).otherwise(F.col("trial_index"))), ["study"]).first()
    assert order["n_falls"] == 2 and not order["source_row_monotonic"]  # 900 before 1 in trial 1, and 3 before 2


def test_gates_ask_for_finite_numbers(spark):
    names = [*diagnostics.DELTAS, "median_cse"]
    rows = [("present", "none", *([1.0] * len(names))), ("null_interaction", "shuffle", *([float("nan"), float("inf")] + [1.0] * (len(names) - 2))), ("null_interaction", "additive_qmap", *([100.0] + [1.0] * (len(names) - 1)))]
    df = spark.createDataFrame([(1.0, 1, "no_log_rt", "none", *r) for r in rows], "sample_size double, subsample_id int, transformation string, outlier string, effect_condition string, strip_method string, " + ", ".join(f"{c} double" for c in names))
    got = {r["strip_method"]: r for r in diagnostics.preservation_gates(df).collect()}
    assert got["shuffle"]["preservation_pass"] and got["shuffle"]["nullification_verdict"] == "interpretable_nullifier" and got["none"]["preservation_pass"] is None
    assert got["additive_qmap"]["preservation_warnings"] == "current_cong_effect_delta_gt_5ms"


def test_materialized_branches(spark, tmp_path):
    df = location(spark, 6, 8)
    spec = grid.Grid(fractions=(0.5, 1.0), samples=1, transforms=("log_rt",), outliers=("none", "sd_2", "mad_2"), strips=("local_mean_residual",))
    branches = grid.data_branches(spark, spec)
    got = materialize.materialized(df, branches)
    members = {(r["sample"], r["subsample_id"]): set() for r in sampling.membership(df, branches.select("sample_size", "sample", "subsample_id").distinct()).collect()}
    for r in sampling.membership(df, branches.select("sample_size", "sample", "subsample_id").distinct()).collect():
        members[r["sample"], r["subsample_id"]].add(r["participant_id"])
    count = {r["data_id"]: r["count"] for r in got.groupBy("data_id").count().collect()}
    for b in branches.collect():
        people = members[b["sample"], b["subsample_id"]]
        own = nullify.nullify(df, b["strip_method"]).where(F.col("participant_id").isin(*people))
        rows = sampling.transformed(sampling.apply_rule(own, b["outlier"]), b["transformation"])
        assert rows.count() == count.get(b["data_id"], 0), b["data_id"]
    materialize.write_materialized(df, branches, str(tmp_path / "b"))
    one = io.read_branch(spark, str(tmp_path / "b"), ["rt", "data_id"]).where("strip_method = 'none' and outlier = 'sd_2'")
    assert one.count() == sum(n for k, n in count.items() if "__sd_2__present__" in k)
    assert materialize.materialized(df, branches.where("false")).count() == 0


def test_quantile_helpers(spark):
    xs = [1.0, 2.0, 4.0, 8.0]
    got = spark.range(1).select(quantile_type8(F.array(*map(F.lit, xs)), 0.5), quantile_type8(F.array(*map(F.lit, xs)), 0.0), inverse_on_grid(F.array(*map(F.lit, xs)), F.lit(3.0)), inverse_on_grid(F.array(*map(F.lit, [1.0, 1.0, 2.0])), F.lit(1.0))).first()
    assert abs(got[0] - 3) < 1e-12 and got[1] == 1 and abs(got[2] - 0.5) < 1e-12 and got[3] == 0


@pytest.mark.parametrize("whole", [order.WHOLE, 0])
def test_order_statistics(spark, monkeypatch, whole):
    """Against numpy: ties, a hot value, groups of one and of nulls only, both kinds of quantiles, in one buffer and in parts."""
    monkeypatch.setattr(order, "WHOLE", whole)
    rng = np.random.default_rng(4)
    groups = {"a": rng.normal(size=700), "b": np.repeat([3.0, 1.0, 2.0], [900, 2, 1]), "c": np.array([5.0]), "d": np.round(rng.exponential(size=333), 1)}
    rows = [(g, float(v)) for g, x in groups.items() for v in x] + [("a", None), ("e", None)]
    df, shares = spark.createDataFrame(rows, "g string, value double").repartition(7), [0.0, 0.1, 1 / 3, 0.5, 0.99, 1.0]
    for kind, method in ((7, "linear"), (8, "median_unbiased")):
        got = {r["g"]: r["quantiles"] for r in order.quantiles(df, ["g"], shares, kind=kind).collect()}
        assert got.keys() == groups.keys() and all(np.allclose(got[g], np.quantile(x, shares, method=method)) for g, x in groups.items())
    assert {r["g"]: r["median"] for r in order.medians(df, ["g"]).collect()} == {g: float(np.median(x)) for g, x in groups.items()}
    assert order.medians(df.where("false"), ["g"]).count() == 0


def test_distributions(spark):
    for t, df, p in ((2.228138852, 10, 0.05), (1.959963985, 1e7, 0.05), (12.7062047, 1, 0.05), (2.5758293, 1e8, 0.01)):
        assert abs(stats.t_p_values(np.array([t]), np.array([df]))[0] - p) < 1e-6
    assert abs(stats.chi2_p_values(np.array([7.814727903]), 3)[0] - 0.05) < 1e-8
    got = spark.range(1).select(*(stats.qnorm(F.lit(p)) for p in (0.5, 0.975, 1e-10, 0.0))).first()
    assert abs(got[0]) < 1e-15 and abs(got[1] - 1.959963984540054) < 1e-12 and abs(got[2] + 6.361340902404056) < 1e-9 and got[3] is None


def test_mixed_model_of_a_balanced_design(spark):
    """With a full random slope and balance, the fixed effect and its t are those of the participants' contrasts."""
    rng = np.random.default_rng(3)
    rows = []
    for p in range(14):
        u = rng.normal(0, [40, 12, 10, 30])
        for _ in range(12):
            rows += [(f"p{p}", c, q, 600 + u[0] + (20 + u[1]) * c / 2 + (10 + u[2]) * q / 2 + (30 + u[3]) * c * q / 4 + rng.normal(0, 25)) for c, q in CELLS]
    st = models.suff_stats(trials(spark, rows), ["study"])
    anova = models.rmanova(st, ["study"]).first()
    fits = {r["model"]: r for r in models.mixed_models(st, ["study"]).collect()}
    full = fits["lmm_full_slope"]
    assert not full["error"] and abs(full["main_estimate"] - anova["estimate"]) < 1e-3 and abs(full["main_t_stat"] / anova["t"] - 1) < 0.05
    assert full["df"] is not None and abs(full["df"] - 13) < 3
    fe = models.participant_fe_lm(st, ["study"]).first()
    x = np.array([[c / 2, q / 2, c * q / 4] + [float(p == f"p{k}") for k in range(14)] for p, c, q, _ in rows])
    y = np.array([r[3] for r in rows])
    beta, rss, *_ = np.linalg.lstsq(x, y, rcond=None)
    se = np.sqrt(rss[0] / (len(y) - 17) * np.linalg.inv(x.T @ x)[2, 2])
    assert abs(fe["estimate"] - beta[2]) < 1e-6 and abs(fe["std_error"] - se) < 1e-6


def unbalanced(rng, people, most):
    x, y, g = [], [], []
    for p in range(people):
        u = rng.normal(0, [40, 12, 10, 20])
        for c in models.X_CELLS:
            for _ in range(rng.integers(0, most)):
                x.append(c)
                g.append(p)
                y.append(600 + c @ u + c[1:] @ [20, 10, 15] + rng.normal(0, 30))
    return np.array(x), np.array(y), np.array(g)


def dense(x, y, g, theta, q, p, reml):
    """-2 log likelihood by whole matrices, the residual variance profiled out."""
    lam = np.zeros((q, q))
    lam[np.tril_indices(q)] = theta
    v = np.eye(len(y))
    for a in np.unique(g):
        i = np.flatnonzero(g == a)
        v[np.ix_(i, i)] += x[i][:, :q] @ lam @ lam.T @ x[i][:, :q].T
    inv, f = np.linalg.inv(v), x[:, :p]
    a = f.T @ inv @ f
    r = y - f @ np.linalg.solve(a, f.T @ inv @ y)
    free = len(y) - (p if reml else 0)
    return np.linalg.slogdet(v)[1] + free * np.log(2 * np.pi * (r @ inv @ r) / free) + free + (np.linalg.slogdet(a)[1] if reml else 0)


@pytest.mark.parametrize("people,most", [(7, 4), (4, 9)])
def test_mixed_likelihood_equals_a_dense_one(people, most):
    rng = np.random.default_rng(people)
    x, y, g = unbalanced(rng, people, most)
    sums = {p: np.array([y[(g == p) & (x == c).all(axis=1)].sum() for c in models.X_CELLS]) for p in np.unique(g)}
    found = {}
    for p, s in sums.items():
        found.setdefault(tuple(int(((g == p) & (x == c).all(axis=1)).sum()) for c in models.X_CELLS), []).append(s)
    parts = np.array(list(found)), np.array([len(v) for v in found.values()]), np.array([np.sum(v, axis=0) for v in found.values()]), np.array([np.transpose(v) @ np.array(v) for v in found.values()]), (y * y).sum()
    for q in (1, 2, 4):
        m = models.Design(*parts, q)
        for p, reml in ((4, True), (4, False), (1, True), (1, False)):
            theta = rng.normal(0, 0.5, q * (q + 1) // 2)
            got = m.look(theta, p, reml, bend=True)
            assert math.isclose(got["value"], dense(x, y, g, theta, q, p, reml), rel_tol=1e-10)
            near = [(dense(x, y, g, theta + e, q, p, reml) - dense(x, y, g, theta - e, q, p, reml)) / 2e-5 for e in np.eye(len(theta)) * 1e-5]
            assert np.allclose(got["grad"], near, rtol=1e-4, atol=1e-4)
            best, at, fine = models.fit_mixed(m, p, reml)
            # nothing nearby is better than what was found
            assert fine and all(dense(x, y, g, best + rng.normal(0, s, len(best)), q, p, reml) > at["value"] - 1e-5 for s in (1e-3, 0.03, 0.3) for _ in range(15))


def test_mixed_models_of_awkward_branches(spark):
    """One participant, one cell, constant times and an empty table give rows (or none), not crashes."""
    rows = [("a", f"p{i}", 1, 1, 4, 40.0, 410.0) for i in range(3)] + [("b", "p1", c, q, 3, 30.0, 300.0) for c, q in CELLS] + [("c", f"p{i}", c, q, 3, 30.0, 300.0) for i in range(4) for c, q in CELLS]
    st = spark.createDataFrame(rows, "k string, participant_id string, cong int, prev_cong int, n long, sy double, syy double")
    got = {(r["k"], r["model"]): r for r in models.mixed_models(st, ["k"]).collect()}
    assert len(got) == 9 and all(r["n_obs"] in (12, 48) for r in got.values()) and got["a", "lmm_intercept"]["error"]
    assert models.mixed_models(st.where("false"), ["k"]).count() == 0 and models.mixed_models(st.where("k = 'c'").drop("k"), []).count() == 3


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "t.csv").write_text("participant_id,cong,prev_cong,rt\na,1,1.0,500\na,-1,NA,NaN\nb,x,-1.0,\n")
    df = io.normalize_types(io.read_trials(spark, str(tmp_path / "t.csv")))
    assert [tuple(r) for r in df.collect()] == [("a", 1, 1, 500.0), ("a", -1, None, None), ("b", None, -1, None)]
    with pytest.raises(ValueError, match="missing"):
        io.read_branch(spark, str(tmp_path / "t.csv"), ["trial_index"])
    with pytest.raises(ValueError, match="missing"):
        io.indexed_design(df)
    empty = io.empty_results(spark)
    assert len(empty.columns) == 61
    one = models.result_rows(spark.createDataFrame([("b1", 1, 1.0, 1, "log_rt", "none", "rmanova", "present", "none")], "branch_id string, branch_idx int, sample_size double, subsample_id int, transformation string, outlier string, model string, effect_condition string, strip_method string"), empty.limit(0))
    io.write_results(one, str(tmp_path / "r"))
    back = io.load_results(spark, str(tmp_path / "r"))
    assert back.count() == 1 and back.first()["error"]
    assert io.write_tables({"a": df, "b": df.where("false")}, str(tmp_path / "w")) == ["a"]
    numbered = io.indexed_design(spark.createDataFrame([("p_x", *(["1"] * 7))], "participant_id string, trial_index string, block_index string, cong string, rt string, correct string, prev_correct string, prev_cong string"))
    assert numbered.first()["source_row"] == 1 and numbered.first()["study"] == "x"
    io.write_branches(df.withColumns({"strip_method": F.lit("none"), "outlier": F.lit("sd_2")}), str(tmp_path / "b"))
    assert io.read_branch(spark, str(tmp_path / "b"), ["rt"], ["rt", "outlier"]).columns == ["rt", "outlier"]
    for rows in ([("b1", 3)], [("b1", 3)], [("b1", 3), ("b1", 3), ("b2", None)]):
        io.append_metadata(spark.createDataFrame(rows, "branch_id string, n int"), str(tmp_path / "m"))
    assert sorted(map(tuple, io.read_published(spark, str(tmp_path / "m")).collect()), key=str) == sorted([("b1", 3)] * 3 + [("b2", None)], key=str)
    counts = spark.createDataFrame([("b1", 5, 3, 2), ("b2", 5, 0, 5)], "branch_id string, n_rows_in int, n_rows_out int, n_removed int")
    io.write_branch_metadata(io.branch_metadata(counts), str(tmp_path / "j"))
    assert {(r["branch_id"], r["success"], r["error"]) for r in spark.read.json(str(tmp_path / "j")).collect()} == {("b1", True, None), ("b2", False, "no rows left")}
    # what is written again replaces itself; a lost job's files are not read
    io.write_results(one, str(tmp_path / "r"))
    io.write_results(one.withColumn("n_obs", F.lit(7)), str(tmp_path / "r"), run="again")
    io.write_results(one.withColumn("n_obs", F.lit(9)), str(tmp_path / "r"), run="again")
    assert sorted(str(r["n_obs"]) for r in io.read_published(spark, str(tmp_path / "r")).collect()) == ["9", "None"] and io.load_results(spark, str(tmp_path / "r")).count() == 1
    io.write_branch_metadata(io.branch_metadata(counts), str(tmp_path / "j"))
    assert io.read_published(spark, str(tmp_path / "j"), "json").count() == 2
    branches = spark.createDataFrame([("none", "sd_2", "d1", 1.0), ("none", "sd_2", "d2", 2.0), ("shuffle", "sd_2", "d3", 3.0)], "strip_method string, outlier string, data_id string, rt double")
    io.write_branches(branches, str(tmp_path / "bb"))
    io.write_branches(branches.where("data_id <> 'd1'").withColumn("rt", F.col("rt") * 10), str(tmp_path / "bb"))
    (tmp_path / "bb" / "_temporary").mkdir()
    assert sorted((r["data_id"], r["rt"]) for r in io.read_branch(spark, str(tmp_path / "bb"), ["rt"]).collect()) == [("d1", 1.0), ("d2", 20.0), ("d3", 30.0)]
    many = io.numbered(spark.range(1000).repartition(7).withColumn("source_row", F.lit("x")).drop("source_row"), "source_row")
    assert sorted(r["source_row"] for r in many.collect()) == list(range(1, 1001))
    (tmp_path / "d.csv").write_text(",participant_id,trial_index,block_index,cong,rt,correct,prev_correct,prev_cong\n7,p1_zz,1,1,1,500,TRUE,NA,NA\n8,p1_zz,2,1,-1,NA,TRUE,TRUE,1\n")
    design = io.read_indexed_design(spark, str(tmp_path / "d.csv"))
    assert [(r["source_row"], r["study"], r["rt"]) for r in design.collect()] == [(7, "zz", "500"), (8, "zz", None)]
    with pytest.raises(ValueError, match="missing required columns: nothing"):
        audit.check_required(df, ["rt", "nothing"])


def test_partitioning_does_not_matter(spark):
    df = location(spark, 4, 6)
    want = None
    for n in (1, 8, 60):
        got = sorted((r["source_row"], round(r["rt"], 9)) for m in ("shuffle", "local_mean_residual") for r in nullify.nullify(df.repartition(n), m).collect())
        want = want or got
        assert got == want


def test_plans_do_not_collect_or_nest(spark):
    plan = models.suff_stats(location(spark, 2, 2), ["study"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "partial_sum" in plan and "Python" not in plan


def dense_logit(rows, names, penalised):
    """The gradient of the (penalised) log-likelihood at given coefficients, by central differences on all rows."""
    x = np.array([[1.0, *(float(r[0] == a) for a in names[0]), *(float(r[1] == b) for b in names[1]), r[2], *(float(r[0] == a) * r[2] for a in names[0])] for r in rows])
    y = np.array([float(r[3]) for r in rows])

    def goal(beta):
        eta = x @ beta
        p = 1 / (1 + np.exp(-eta))
        out = (y * -np.logaddexp(0, -eta) + (1 - y) * -np.logaddexp(0, eta)).sum()
        return out + (np.linalg.slogdet((x * (p * (1 - p))[:, None]).T @ x)[1] / 2 if penalised else 0.0)

    return lambda beta: np.array([(goal(beta + h) - goal(beta - h)) / 2e-5 for h in np.eye(len(beta)) * 1e-5])


@pytest.mark.parametrize("separated", [False, True])
def test_grid_logit_is_the_top_of_a_dense_likelihood(spark, monkeypatch, separated):
    rng = np.random.default_rng(7)
    rows = []
    for _ in range(600):
        a, b, z = str(rng.choice(["p", "q", "r"])), str(rng.choice(["u", "v"])), float(rng.integers(1, 5)) / 4
        hit = bool(rng.random() < 1 / (1 + np.exp(-(-0.8 + 0.9 * (a == "q") - 0.5 * (b == "v") + 1.1 * z))))
        rows.append((a, b, z, (hit and b != "v") if separated else hit))
    df = spark.createDataFrame([*rows, ("p", None, 0.5, True), ("p", "u", float("nan"), True), ("q", "u", 0.5, None)], "a string, b string, z double, hit boolean")
    got = logit.grid_logit(df, "hit", "a*z + b").collect()
    values = {r["term"]: r for r in got}
    order_of = ["(intercept)", "a_q", "a_r", "b_v", "z", "a_q:z", "a_r:z"]
    assert set(values) == set(order_of) and all(r["n"] == 600 for r in got)
    beta = np.array([values[t]["estimate"] for t in order_of])
    assert np.abs(dense_logit(rows, (["q", "r"], ["v"]), separated)(beta)).max() < 1e-4
    assert {t for t, r in values.items() if r["separated"]} == ({"b_v"} if separated else set())
    assert all(r["ci_lower"] < r["odds_ratio"] < r["ci_upper"] for r in got)
    # the same by tasks
    monkeypatch.setattr(logit, "FEW_PATTERNS", 0)
    monkeypatch.setattr(logit, "STEPS", 4)
    spread = [r["estimate"] for r in logit.grid_logit(df, "hit", "b", 10).collect()]
    monkeypatch.setattr(logit, "FEW_PATTERNS", 100)
    assert np.allclose(spread, [r["estimate"] for r in logit.grid_logit(df, "hit", "b", 10).collect()], atol=1e-9)


def test_grid_logit_of_odd_tables(spark):
    rows = spark.createDataFrame([("a", "x", i % 3 == 0) for i in range(20)] + [("b", "y", i % 4 == 0) for i in range(20)], "a string, b string, hit boolean")
    got = {r["term"]: r for r in logit.grid_logit(rows, "hit", "a + b").collect()}
    assert got["b_y"]["estimate"] is None and abs(got["a_b"]["estimate"] - (math.log(5 / 15) - math.log(7 / 13))) < 1e-8
    assert abs(got["(intercept)"]["estimate"] - math.log(7 / 13)) < 1e-8
    assert logit.grid_logit(rows.limit(5), "hit", "a") is None and logit.grid_logit(rows.where("hit"), "hit", "a") is None and logit.grid_logit(rows.where("false"), "hit", "a + b") is None


def test_results_of_large_numbers(spark, tmp_path):
    # numbers made from a row's own keys pass 32 bits
    plan = "branch_id string, branch_idx long, sample_size double, subsample_id int, transformation string, outlier string, model string, effect_condition string, strip_method string"
    branches = spark.createDataFrame([("b1", 9_990_000_001, 1.0, 1, "log_rt", "none", "rmanova", "present", "none")], plan)
    io.write_results(models.result_rows(branches, io.empty_results(spark)), str(tmp_path / "r"))
    assert io.load_results(spark, str(tmp_path / "r")).first()["branch_idx"] == 9_990_000_001


def test_partitions_follow_the_rows(spark):
    from specgrid.sources.views import ROWS, partitioned

    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        partitioned(spark, 0)
        assert spark.conf.get("spark.sql.shuffle.partitions") == before
        partitioned(spark, 99 * ROWS + 1)
        assert spark.conf.get("spark.sql.shuffle.partitions") == "100"
        partitioned(spark, 5 * ROWS)
        assert spark.conf.get("spark.sql.shuffle.partitions") == "100"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_windows_stay_spread(spark):
    # adaptive execution merges small partitions of a window's own shuffle, and with them the rows a task sorts
    df, before = location(spark, 4, 6), spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 9)
        assert nullify.trial_bins(df).rdd.getNumPartitions() == 9
        assert nullify.local_median_residual(df).rdd.getNumPartitions() == 9
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_multisets_are_counted_without_a_join(spark, capsys):
    a = spark.createDataFrame([("a", 1, 500.0), ("a", 1, 500.0), ("a", -1, None), (None, 1, 1.0)], "participant_id string, cong int, rt double")
    b = spark.createDataFrame([("a", 1, 500.0), ("a", 1, 501.0), ("a", -1, None), (None, 1, 1.0)], "participant_id string, cong int, rt double")
    got = diagnostics.multiset_compare(a, b)
    got.explain()
    assert "Join" not in capsys.readouterr().out
    assert tuple(got.first()) == (3, 0, 1, False) and tuple(diagnostics.multiset_compare(a, a).first()) == (3, 0, 0, True)


def test_time_bins_meet_their_edges_without_a_shuffle(spark, capsys):
    diagnostics.time_bin_contrast(location(spark, 4, 6), ["study"]).explain()
    assert "SortMergeJoin" not in capsys.readouterr().out


def test_branches_share_folders(spark, tmp_path):
    path = str(tmp_path / "b")
    rows = spark.range(600).select(F.lit("none").alias("strip_method"), F.when(F.col("id") % 2 == 0, "sd_2").otherwise("none").alias("outlier"), F.when(F.col("id") > 0, F.format_string("%05d", F.floor(F.col("id") / 2))).alias("data_id"), F.col("id").cast("double").alias("rt"))
    io.write_branches(rows.coalesce(2), path)
    io.write_branches(rows.where("id < 100").withColumn("rt", -F.col("rt")).coalesce(2), path)
    io.write_branches(rows.where("id < 10").withColumn("rt", F.col("rt") + 0.5).where("rt > 5").coalesce(2), path)
    # folders don't grow with the branches, whose ids stay text
    assert len(list((tmp_path / "b").rglob("*=*"))) == 12
    got = {(r["outlier"], r["data_id"]): r["rt"] for r in io.read_branch(spark, path, ["rt", "data_id"]).collect()}
    value = lambda i: i + 0.5 if 5 <= i < 10 else float(-i) if i < 100 else float(i)
    assert got == {("none" if i % 2 else "sd_2", f"{i // 2:05d}" if i else None): value(i) for i in range(600)}
    assert sorted(io.read_branch(spark, path, ["rt"]).columns) == sorted(rows.columns)


def test_block_sums_are_hashed_and_studies_counted_apart(spark):
    key = "b string, participant_id string, study string, source_row long, trial_index long, block_index long, cong int, prev_cong int, rt double, prev_correct boolean"
    rows = [("x", "p", "ts"[i % 2], i, i, 0, c, q, 300.0 + i, True) for i, (c, q) in enumerate(CELLS * 2)]
    rows += [("x", "p", "never_valid", 90, 90, 0, 1, 1, -1.0, True), ("x", "q", None, 91, None, 0, 1, 1, 400.0, True), ("y", "p", "s", 0, 0, 0, 1, 1, None, True)]
    df = spark.createDataFrame(rows, key)
    # sums in buffers of fixed size: no list in a group's buffer, so no fall back to sorting
    plan = diagnostics.block_sums(df, ["b"])._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "ObjectHashAggregate" not in plan and "SortAggregate" not in plan
    got = {r["b"]: r for r in diagnostics.branch_diagnostics(df, ["b"]).collect()}
    assert (got["x"]["studies"], got["x"]["n_studies"], got["x"]["n_valid"], got["x"]["n_rows"]) == ("s;t", 2, 9, 10)
    assert (got["y"]["studies"], got["y"]["n_studies"], got["y"]["n_rows"]) == ("", 0, 1)
    # trials 0 to 7 in five bins cut at quantiles, right-closed: most have one cell only, so no contrast
    assert got["x"]["max_abs_timebin_q050_cse"] is None and got["x"]["cell_min_n"] == 2


def test_trials_meet_their_branches_in_one_join(spark):
    df = location(spark, 4, 8)
    branches = grid.data_branches(spark, grid.Grid(fractions=(0.5, 1.0), samples=2, outliers=("none", "sd_2"), strips=("local_mean_residual",)))
    got = materialize.materialized(df, branches)
    # a trial meets all branches of its sample and variant in one join on their numbers, and no rule or transformation in one of its own
    joins = [x for x in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in x]
    assert any("__variant" in x for x in joins) and not any("outlier" in x or "strip_method" in x for x in joins)
    rows = got.groupBy("data_id", "outlier", "transformation", "strip_method").agg(F.count("*").alias("n"), F.count_if(F.col("rt") > 20).alias("plain")).collect()
    assert len(rows) == branches.count() and all((r["plain"] == 0) == (r["transformation"] == "log_rt") for r in rows)


def test_report_quantiles_of_counted_values(spark, monkeypatch):
    values = {("m", "a"): [1.0, 5.0, 2.0, 2.0, 9.0, 4.5, 7.0], ("m", None): [3.0, 8.0, 1.5], ("k", "a"): [0.5] * 4, ("k", "b"): []}
    rows = [(m, s, x) for (m, s), xs in values.items() for x in [*xs, None]]
    long = spark.createDataFrame(rows, "metric string, strip_method string, abs_cse_value double")
    wide = spark.createDataFrame([(s, -x) for (m, s), xs in values.items() if m == "m" for x in xs], "strip_method string, a_delta_from_present double")
    want = {k: tuple(np.quantile(xs, (0.5, 0.95))) if xs else (None, None) for k, xs in values.items()}
    for whole in (order.WHOLE, 2):  # in one buffer where few values are different, and by buckets where not
        monkeypatch.setattr(order, "WHOLE", whole)
        got = {(r["metric"], r["strip_method"]): (r["median_abs"], r["p95_abs"]) for r in report.metric_summary(long).collect()}
        assert got.keys() == want.keys() and all(got[k] == want[k] or np.allclose(got[k], want[k]) for k in want)
        got = {r["strip_method"]: (r["median_abs"], r["p95_abs"]) for r in report.residual_deltas(wide).collect()}
        assert got.keys() == {"a", None} and all(np.allclose(got[s], want["m", s]) for s in got)
    plan = report.residual_deltas(wide)._jdf.queryExecution().optimizedPlan().toString()
    assert "abs(" not in plan  # what is read are written, counted values


def test_operating_tables_join_once(spark):
    base = "data_id string, model string, effect_condition string, strip_method string, transformation string, outlier string, sample_size double, subsample_id int, error boolean, full_converged boolean, main_estimate double, main_std_error double, main_p_value double, n_obs int"
    rows = [(f"d{i}", "rmanova", *(("present", "none") if i % 3 == 0 else ("null_interaction", "shuffle")), "log_rt", "sd_2", 1.0, i, i % 4 == 1, True, float(i), 1.0, 0.01 * i, 200) for i in range(12)]
    results = spark.createDataFrame(rows, base)
    diags = spark.createDataFrame([(f"d{i}", "interpretable_nullifier" if i % 2 else "fails_preservation_gates") for i in range(10)], "data_id string, nullification_verdict string")
    got = tables.operating_tables(results, diags)
    assert not any("Join" in t._jdf.queryExecution().optimizedPlan().toString() for t in got.values())
    nulls = [i for i in range(12) if i % 3]
    assert sum(r["n"] for r in got["fpr_coarse"].collect()) == sum(i % 4 != 1 for i in nulls) and got["fpr_per_branch"].count() == sum(i % 4 != 1 for i in nulls)
    aware = {r["interpretable_fpr_source"]: (r["n_planned"], r["extraction_or_preprocessing_error"], r["significant_primary"]) for r in got["failure_aware"].collect()}
    of = lambda odd: [i for i in nulls if (i % 2 == 1 and i < 10) == odd]
    assert aware == {odd: (len(of(odd)), sum(i % 4 == 1 for i in of(odd)), sum(i % 4 != 1 and i < 5 for i in of(odd))) for odd in (True, False)}


def test_sums_of_tasks_are_merged_in_batches():
    import pyarrow as pa

    start, held, width = pa.total_allocated_bytes(), [], 50_000
    def sent():
        for i in range(40):
            lists = [pa.array([[float(x)] * width], pa.list_(pa.float64())) for x in (1, i, i)]
            yield pa.RecordBatch.from_arrays([pa.array([3], pa.int32()), pa.array([5], pa.int32()), *lists], ["v", "s", *index.KINDS])
            del lists
            held.append(pa.total_allocated_bytes() - start)

    (got,) = index.merged((pa.scalar(3), pa.scalar(5)), sent())
    assert [got.column(c)[0].as_py() for c in ("v", "s")] == [3, 5]
    assert [set(got.column(c)[0].as_py()) for c in index.KINDS] == [{40.0}, {0.0}, {39.0}]
    # 40 tasks sent 1.2 MB each; a few of these are held at once
    assert max(held) < 5 * 3 * 8 * width


def test_bend_holds_no_matrix_for_each_pattern_and_parameter():
    import tracemalloc

    rng, u = np.random.default_rng(1), 20_000
    counts, sums = rng.integers(1, 9, (u, 4)), rng.normal(500, 50, (u, 4))
    design = models.Design(counts, np.ones(u, int), sums, sums[:, :, None] * sums[:, None, :], float((sums * sums).sum() * 1.1), 4)
    theta = np.eye(4)[design.at] * 0.5
    tracemalloc.start()
    got = design.look(theta, 4, True, bend=True)
    peak = tracemalloc.get_traced_memory()[1] / u
    tracemalloc.stop()
    assert got["info"].shape == (10, 10) and np.isfinite(got["info"]).all() and np.allclose(got["info"], got["info"].T)
    assert peak < 2_500, peak


def test_branch_counts_take_further_aggregates(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0)], "study string, rt double")
    plan = spark.createDataFrame([("a",), ("b",)], "study string")
    got = sampling.branch_counts(plan, df.where("rt < 4"), df, ["study"], [F.avg("rt").alias("mean")])
    assert sorted(map(tuple, got.collect())) == [("a", 2, 2, 2.0, 0), ("b", 1, 0, None, 1)]


def test_quantile_maps_read_what_is_written(spark, capsys):
    own = Window.partitionBy("participant_id").orderBy("source_row")
    df = location(spark, 4, 6).withColumn("prev_cong", F.coalesce(F.lag("cong").over(own), F.lit(1)))
    for f in (nullify.additive_qmap, nullify.additive_qmap_trial_bin):
        f(df).explain()
        assert "lag(" not in capsys.readouterr().out


def test_results_are_written_from_one_narrow_pass(spark, sf, tmp_path, capsys, monkeypatch):
    def plan(df):
        capsys.readouterr()
        df.explain()
        return capsys.readouterr().out

    # what the view makes of a row is not shuffled, only the row
    below = plan(view(spark, sf, "results_li", dealt=True)).split("Exchange")
    assert len(below) == 2 and "CASE" not in below[1]
    publish, windows = io.publish, []
    monkeypatch.setattr(io, "publish", lambda rows, *args, **named: windows.append("Window" in plan(rows)) or publish(rows, *args, **named))
    got = registry.QUERIES["io_results_again"](spark, sf)
    assert windows == [False] * 3 and got.count() == 4
    # no task sorts a whole split of a table before its rows are dealt out
    table = str(tmp_path / "r")
    rows = spark.createDataFrame([("b1", 1, "rmanova"), ("b2", 2, None)], "branch_id string, branch_idx long, model string")
    rows = saved(rows.select(*(F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in RESULTS_SCHEMA)))
    name = io.write_results(rows, table)
    below = plan(io.load_results(spark, table)).split("Exchange")
    assert len(below) == 2 and "Sort" not in below[1]
    # stored rows get the same name and are not saved again
    monkeypatch.setattr(io, "saved", lambda df: pytest.fail("saved again"))
    assert io.write_results(rows, table, stored=True) == name and io.read_published(spark, table).count() == 2
