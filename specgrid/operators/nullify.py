"""Counterfactual response times without the interaction. Every operator keeps the rows and replaces rt.

cong and prev_cong are -1 or +1 (null otherwise). Rows with a missing code or response time pass through unchanged and take
no part in what others are compared with. Participants are the unit of every window and array.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specgrid.functions.order import FEW, counted, cumulative, grouped_quantiles, quantiles, ranked
from specgrid.functions.quantile import GRID, inverse_on_grid, quantile_type8, read_knots
from specgrid.sources.scratch import saved, spread

CELLS = ((1, 1), (1, -1), (-1, 1), (-1, -1))
MIN_CELL, BINS, KAPPA = 5, 4, 5.0
#: Trials of a group that may meet in one task, and parts in which the trials of larger groups meet their group's curves.
TOGETHER, SALTS = 200_000, 64


def usable() -> Column:
    return F.col("rt").isNotNull() & ~F.isnan("rt") & F.col("cong").isNotNull() & F.col("prev_cong").isNotNull()


def in_cell(c: int, p: int) -> Column:
    return usable() & (F.col("cong") == c) & (F.col("prev_cong") == p)


def contrast(values: dict[tuple[int, int], Column]) -> Column:
    return values[1, 1] - values[1, -1] - values[-1, 1] + values[-1, -1]


def trial_bins(df: DataFrame, bins: int = BINS) -> DataFrame:
    """df with bin: floor(place * bins / N) of the participant's trials by trial_index, ties in source order."""
    own = Window.partitionBy("participant_id")
    place = F.row_number().over(own.orderBy(F.coalesce("trial_index", "source_row"), "source_row")) - 1
    return spread(df, "participant_id").withColumn("bin", F.least(F.floor(place * bins / F.count("*").over(own)), F.lit(bins - 1)).cast("int"))


def same(keys: Sequence[str], prefix: str) -> Column:
    """Whether keys equal the columns of those names after a prefix; nulls are equal."""
    return reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"{prefix}{k}")) for k in keys))


def apart(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame | None]:
    """(rows of groups of at most TOGETHER rows, rows of larger groups or None where there are none). Counts the groups."""
    large = df.groupBy(*(F.col(k).alias(f"__large_{k}") for k in keys)).count().where(F.col("count") > TOGETHER).drop("count")
    if large.isEmpty():
        return df, None
    large = saved(large)
    large = F.broadcast(large) if large.count() <= FEW else large
    return df.join(large, same(keys, "__large_"), "left_anti"), df.join(large, same(keys, "__large_"), "left_semi")


def dealt(df: DataFrame, by: list[str], rank: Callable[[DataFrame, str, str], DataFrame]) -> DataFrame:
    """df with rt dealt anew within by: the place by __draw takes the place by source_row; rank(df, order, name) adds places."""
    rows = rank(df.drop("rt"), "source_row", "__at")
    values = rank(df.select(*by, "__draw", "source_row", "rt"), "__draw", "__to").select(*(F.col(k).alias(f"__of_{k}") for k in by), "__to", "rt")
    return rows.join(values, same(by, "__of_") & (F.col("__at") == F.col("__to")))


def shuffle(df: DataFrame, seed: str = "42") -> DataFrame:
    """rt permuted among the trials of a participant and congruency: the order by a hash of the row takes the order by row.

    The join is on the place as well, so it is even whatever a group's size.
    """
    by = ["participant_id", "cong"]
    good = df.where(usable()).withColumn("__draw", F.md5(F.concat_ws("|", F.lit(seed), F.col("source_row").cast("string")).cast("binary")))
    order = lambda c: list(dict.fromkeys((c, "source_row")))
    small, large = apart(good, by)
    out = dealt(small, by, lambda d, c, name: spread(d, *by).withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order(c)))))
    if large is not None:
        out = out.select(*df.columns).unionByName(dealt(large, by, lambda d, c, name: ranked(d, by, order(c), name)).select(*df.columns))
    return out.select(*df.columns).unionByName(df.where(~usable()))


def residual_rt(kind: str, min_cell: int = MIN_CELL) -> Column:
    """rt less beta * cong * prev_cong for trials that have a bin: beta is a quarter of the contrast of cell means or medians in the trial's bin, else in the participant.

    All of it is read off windows over the participant and its bins, so the trials are dealt out once and joined to nothing.
    """

    fine = "rt is not null and not isnan(rt)"
    times = [f"if({fine} and cong = {c} and prev_cong = {p}, rt, null)" for c, p in CELLS]
    middle = {"mean": "avg", "median": "median"}[kind]

    def beta(keys: str) -> Column:
        least = ", ".join(f"count({t}) over (partition by {keys})" for t in times)
        a, b, c, d = (f"{middle}({t}) over (partition by {keys})" for t in times)
        return F.expr(f"if(least({least}) >= {min_cell}, ({a} - {b} - {c} + {d}) / 4, null)")

    own = F.coalesce(beta("participant_id, bin"), beta("participant_id"), F.lit(0.0))
    return F.when(usable(), F.col("rt") - own * F.col("cong") * F.col("prev_cong")).otherwise(F.col("rt"))


def residual(df: DataFrame, kind: str, min_cell: int = MIN_CELL, bins: int = BINS) -> DataFrame:
    return trial_bins(df, bins).withColumn("rt", residual_rt(kind, min_cell)).select(*df.columns)


def local_mean_residual(df: DataFrame, min_cell: int = MIN_CELL, bins: int = BINS) -> DataFrame:
    return residual(df, "mean", min_cell, bins)


def local_median_residual(df: DataFrame, min_cell: int = MIN_CELL, bins: int = BINS) -> DataFrame:
    return residual(df, "median", min_cell, bins)


def cell_curves(df: DataFrame, grid: int = GRID) -> DataFrame:
    """(cong, prev_cong, curve): the type-8 quantiles of each cell over everyone, at `grid` knots."""
    good = df.where(usable()).select("cong", "prev_cong", F.col("rt").alias("value"))
    return quantiles(good, ["cong", "prev_cong"], [k / (grid - 1) for k in range(grid)], kind=8).withColumnRenamed("quantiles", "curve")


MARGINS = {("cong", 1): "__cong_1", ("cong", -1): "__cong_-1", ("prev_cong", 1): "__prev_cong_1", ("prev_cong", -1): "__prev_cong_-1"}


def listed_curves(good: DataFrame, keys: list[str], grid: int) -> DataFrame:
    """(__key_<key>..., __all, __grand and a column of MARGINS each): a group's trials and its curves of `grid` knots, from sorted lists of its times."""
    sorted_list = lambda value: F.array_sort(F.collect_list(value))
    lists = good.groupBy(*(F.col(k).alias(f"__key_{k}") for k in keys)).agg(
        sorted_list(F.col("rt")).alias("__grand"), *(sorted_list(F.when(F.col(c) == v, F.col("rt"))).alias(name) for (c, v), name in MARGINS.items()), F.count("*").alias("__all"),
    )
    knots = F.sequence(F.lit(0), F.lit(grid - 1))
    curve = lambda name: F.when(F.size(name) > 0, F.transform(knots, lambda k: quantile_type8(F.col(name), k / F.lit(float(grid - 1))))).alias(name)
    return lists.select(*(f"__key_{k}" for k in keys), "__all", *(curve(name) for name in ("__grand", *MARGINS.values())))


def selected_curves(good: DataFrame, keys: list[str], grid: int) -> DataFrame:
    """The columns of listed_curves by exact selection: one histogram for all groups and margins, and the buckets that hold a knot."""
    shares = [k / (grid - 1) for k in range(grid)]
    *margins, grand = grouped_quantiles(good, [([*keys, "cong"], shares), ([*keys, "prev_cong"], shares), (keys, shares)], "rt", kind=8)
    out = good.groupBy(*(F.col(k).alias(f"__key_{k}") for k in keys)).agg(F.count("*").alias("__all"))
    tables = [grand.withColumnRenamed("quantiles", "__grand")]
    for c, table in zip(("cong", "prev_cong"), margins, strict=True):
        tables.append(table.groupBy(*keys).agg(*(F.max(F.when(F.col(c) == v, F.col("quantiles"))).alias(name) for (of, v), name in MARGINS.items() if of == c)))
    for table in tables:
        out = out.join(table, same(keys, "__key_"), "left").drop(*keys)
    return out


def quantile_map(df: DataFrame, keys: list[str], curves: DataFrame | None, kappa: float = KAPPA, grid: int = GRID) -> DataFrame:
    """rt as q_cong(tau) + q_prev(tau) - q_all(tau) within keys, tau the trial's share in its cell.

    In a cell of one trial tau is read off the cell's curve over everyone: shrinking a constant curve towards that one by
    kappa leaves the inverse where it is, and with kappa 0 it is 0. A group of one trial keeps its rt.

    A group of up to TOGETHER trials is one row of sorted lists. In a larger one shares are running counts over ranges of
    times, knots are selected from a histogram, and trials meet the curves in SALTS parts.
    """
    cell = [*keys, "cong", "prev_cong"]

    def mapped(good: DataFrame, groups: DataFrame, salted: bool) -> DataFrame:
        if curves is not None and kappa > 0:
            # four curves; only trials of cells of one are read off them
            alone = F.coalesce(inverse_on_grid(F.col("curve"), F.col("rt")), F.col("__tau"))
            good = good.join(F.broadcast(curves), ["cong", "prev_cong"], "left").withColumn("__tau", F.when(F.col("__n") >= 2, F.col("__tau")).otherwise(alone)).drop("curve")
        else:
            good = good.withColumn("__tau", F.when(F.col("__n") >= 2, F.col("__tau")).otherwise(0.0))
        on = same(keys, "__key_")
        if salted:
            good = good.withColumn("__part", F.pmod(F.xxhash64("source_row"), F.lit(SALTS)).cast("int"))
            groups = groups.withColumn("__parts", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            on = on & (F.col("__part") == F.col("__parts"))
        got = good.join(groups, on)
        # a trial's curve is chosen before it is read: one reading for each margin keeps the generated code small
        side = lambda c: read_knots(F.when(F.col(c) == 1, F.col(MARGINS[c, 1])).otherwise(F.col(MARGINS[c, -1])), F.col("__tau"), grid)
        value = side("cong") + side("prev_cong") - read_knots(F.col("__grand"), F.col("__tau"), grid)
        return got.withColumn("rt", F.when(F.col("__all") < 2, F.col("rt")).otherwise(value)).select(*df.columns)

    small, large = apart(df.where(usable()), keys)
    own = Window.partitionBy(*cell)
    shares = small.withColumns({"__tau": F.cume_dist().over(own.orderBy("rt")), "__n": F.count("*").over(own)})
    out = mapped(shares, listed_curves(small, keys, grid), salted=False)
    if large is not None:
        held = cumulative(counted(large, cell, "rt"), cell).withColumnsRenamed({c: f"__of_{c}" for c in (*cell, "value")})
        shares = large.join(held, same(cell, "__of_") & (F.col("rt") == F.col("__of_value"))).select(*df.columns, (F.col("upto") / F.col("total")).alias("__tau"), F.col("total").alias("__n"))
        out = out.unionByName(mapped(shares, selected_curves(large, keys, grid), salted=True))
    return out.unionByName(df.where(~usable()))


def additive_qmap(df: DataFrame, kappa: float = KAPPA, grid: int = GRID) -> DataFrame:
    # written once: counts, curves, shares and the rows without a code all read it
    return written_qmap(saved(df), kappa, grid)


def written_qmap(df: DataFrame, kappa: float, grid: int) -> DataFrame:
    return quantile_map(df, ["participant_id"], saved(cell_curves(df, grid)), kappa, grid)


def spread_trial_bins(df: DataFrame, bins: int = BINS) -> DataFrame:
    """trial_bins with the trials of large participants ranked in many tasks."""
    small, large = apart(df, ["participant_id"])
    out = trial_bins(small, bins)
    if large is None:
        return out
    ordered = ranked(large.withColumn("__order", F.coalesce("trial_index", "source_row")), ["participant_id"], ["__order", "source_row"], "__place").drop("__order")
    sizes = large.groupBy(F.col("participant_id").alias("__of_participant_id")).agg(F.count("*").alias("__in"))
    placed = ordered.join(sizes, same(["participant_id"], "__of_"))
    return out.unionByName(placed.withColumn("bin", F.least(F.floor((F.col("__place") - 1) * bins / F.col("__in")), F.lit(bins - 1)).cast("int")).select(*out.columns))


def additive_qmap_trial_bin(df: DataFrame, min_cell: int = MIN_CELL, bins: int = BINS, kappa: float = KAPPA, grid: int = GRID) -> DataFrame:
    """The quantile map within a participant's trial bin where all four cells hold min_cell trials there, else over the whole participant."""
    df = saved(df)
    whole = written_qmap(df, kappa, grid)
    binned = saved(spread_trial_bins(df, bins))
    full = binned.groupBy("participant_id", "bin").agg(F.least(*(F.count(F.when(in_cell(*c), 1)) for c in CELLS)).alias("__least"))
    rich = binned.join(full.where(F.col("__least") >= min_cell).select("participant_id", "bin"), ["participant_id", "bin"], "left_semi").where(F.col("trial_index").isNotNull())
    rich = saved(rich.select("source_row", "participant_id", "bin", "cong", "prev_cong", "rt"))
    local = quantile_map(rich, ["participant_id", "bin"], None, kappa, grid).select(F.col("source_row").alias("__row"), F.col("rt").alias("__rt"))
    return whole.join(local, F.col("source_row") == F.col("__row"), "left").withColumn("rt", F.coalesce("__rt", "rt")).select(*df.columns)


METHODS = {
    "shuffle": shuffle,
    "additive_qmap": additive_qmap,
    "additive_qmap_trial_bin": additive_qmap_trial_bin,
    "local_mean_residual": local_mean_residual,
    "local_median_residual": local_median_residual,
}


def nullify(df: DataFrame, method: str) -> DataFrame:
    """df under one effect variant; `none` is the data as they are."""
    return df if method == "none" else METHODS[method](df)


#: Methods that are columns of trials with their bins, at the default settings.
AS_COLUMNS = {"none": lambda: F.col("rt"), "local_mean_residual": lambda: residual_rt("mean"), "local_median_residual": lambda: residual_rt("median")}


def all_effects(df: DataFrame, methods: tuple[str, ...]) -> DataFrame:
    """df with one rt column for each method (rt_<method>), made once on everyone, before any sampling. A participant's source rows must differ."""
    wide = df
    if {"local_mean_residual", "local_median_residual"} & set(methods):
        wide = trial_bins(df)
    wide = wide.withColumns({f"rt_{m}": AS_COLUMNS[m]() for m in methods if m in AS_COLUMNS})
    if "bin" not in df.columns:
        wide = wide.drop("bin")
    for m in methods:
        if m not in AS_COLUMNS:
            own = METHODS[m](df).select(F.col("participant_id").alias("__pid"), F.col("source_row").alias("__row"), F.col("rt").alias(f"rt_{m}"))
            wide = wide.join(own, F.col("participant_id").eqNullSafe(F.col("__pid")) & (F.col("source_row") == F.col("__row"))).drop("__pid", "__row")
    return wide


def long_effects(wide: DataFrame, methods: tuple[str, ...]) -> DataFrame:
    """One row for each trial and method from all_effects' columns, without another scan."""
    pairs = [F.struct(F.lit(m).alias("strip_method"), F.col(f"rt_{m}").alias("rt")) for m in methods]
    keep = [c for c in wide.columns if not c.startswith("rt_") and c != "rt"]
    return wide.select(*keep, F.inline(F.array(*pairs)))
