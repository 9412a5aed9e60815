"""Participant samples, outlier rules and the transformation of response times."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specgrid.functions.order import counted, counted_quantiles
from specgrid.sources.scratch import saved

SEED = "42"
#: Hex digits of a hash by which a sample is cut: a 4,096th of the participants is ranked.
PREFIX = 3


def membership(trials: DataFrame, samples: DataFrame, seed: str = SEED) -> DataFrame:
    """(sample_size, sample, subsample_id, participant_id): ceil(P * fraction) participants of each sample, by rank of a hash.

    The same participants are drawn whatever the effect variant, outlier rule or transformation. A fraction of 0 draws none.
    """
    people = trials.select("participant_id").distinct()
    total = people.agg(F.count("*").alias("people"))
    wanted = samples.select("sample_size", "sample", "subsample_id").crossJoin(F.broadcast(total)).withColumn("wanted", F.ceil(F.col("people") * F.col("sample_size")))
    of = ["sample", "subsample_id"]
    key = F.md5(F.concat_ws("|", F.lit(seed), "sample", F.col("subsample_id").cast("string"), "participant_id").cast("binary"))
    drawn = people.crossJoin(F.broadcast(wanted.select(*of, "sample_size", "wanted"))).withColumn("key", key).withColumn("prefix", F.substring("key", 1, PREFIX))
    # the prefix in which a sample's last participant lies, and how many of that prefix it takes; all below are in
    counts = drawn.groupBy(*of, "prefix").agg(F.count("*").alias("n"), F.max("wanted").alias("wanted"))
    counts = counts.withColumn("before", F.sum("n").over(Window.partitionBy(*of).orderBy("prefix")) - F.col("n"))
    cut = counts.where((F.col("wanted") > F.col("before")) & (F.col("wanted") <= F.col("before") + F.col("n"))).select(*of, F.col("prefix").alias("last"), (F.col("wanted") - F.col("before")).alias("left"))
    drawn = drawn.join(F.broadcast(cut), of).where(F.col("prefix") <= F.col("last"))
    # only participants of the last prefix are ranked
    rank = F.row_number().over(Window.partitionBy(*of, "prefix").orderBy("key", "participant_id"))
    last = drawn.where(F.col("prefix") == F.col("last")).withColumn("rank", rank).where(F.col("rank") <= F.col("left"))
    columns = ["sample_size", "sample", "subsample_id", "participant_id"]
    return drawn.where(F.col("prefix") < F.col("last")).select(*columns).unionByName(last.select(*columns))


def sample_participants(trials: DataFrame, members: DataFrame) -> DataFrame:
    """All trials of the sampled participants."""
    return trials.join(members.select("participant_id").distinct(), "participant_id", "left_semi")


def middle(values: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(keys..., name): the median of each group of counted values."""
    return counted_quantiles(values, keys, (0.5,)).select(*keys, F.col("quantiles")[0].alias(name))


def fences(df: DataFrame, by: list[str], rules: tuple[str, ...]) -> DataFrame:
    """(by..., outlier, lo, hi): the bounds of every rule in every branch, both inclusive; null bounds keep everything.

    sd_k: mean -/+ k sd of the branch's trials (sd 0 with one trial); mad_k: median -/+ k times the median absolute
    deviation, unscaled; range_x: 200 to x. Not-a-number is left out as missing.
    """
    rt = F.when(~F.isnan("rt"), F.col("rt"))
    df, keys = (df, by) if by else (df.withColumn("__whole", F.lit(1)), ["__whole"])
    base = df.groupBy(*keys).agg(F.avg(rt).alias("m"), F.coalesce(F.stddev_samp(rt), F.lit(0.0)).alias("s"))
    if any(r.startswith("mad_") for r in rules):
        # counted and sorted by parts, so that no branch's times meet in one buffer; the distances are made of counted values too
        values = counted(df.select(*keys, rt.alias("value")), keys)
        med = saved(middle(values, keys, "med"))
        away = values.join(F.broadcast(med), keys).groupBy(*keys, F.abs(F.col("value") - F.col("med")).alias("value")).agg(F.sum("n").alias("n"))
        base = saved(base).join(med, keys, "left").join(saved(middle(saved(away), keys, "mad")), keys, "left")
    bounds = []
    for rule in rules:
        kind, _, k = rule.partition("_")
        none = F.lit(None).cast("double")
        lo, hi = {
            "none": lambda: (none, none),
            "sd": lambda: (F.col("m") - float(k) * F.col("s"), F.col("m") + float(k) * F.col("s")),
            "mad": lambda: (F.col("med") - float(k) * F.col("mad"), F.col("med") + float(k) * F.col("mad")),
            "range": lambda: (F.lit(200.0), F.lit(float(k))),
        }[kind]()
        bounds.append(F.struct(F.lit(rule).alias("outlier"), lo.cast("double").alias("lo"), hi.cast("double").alias("hi")))
    return base.select(*by, F.inline(F.array(*bounds)))


def inside(rt: Column, outlier: Column, lo: Column, hi: Column) -> Column:
    """Whether a rule keeps a trial: `none` keeps all, any other drops null and not-a-number."""
    return (outlier == "none") | F.coalesce(rt.between(lo, hi) & ~F.isnan(rt), F.lit(False))


def apply_rule(df: DataFrame, rule: str) -> DataFrame:
    """df without what one rule calls outliers, over df as a whole."""
    if rule == "none":
        return df
    if rule.startswith("range_"):
        return df.where(F.col("rt").between(200.0, float(rule[6:])))
    bound = fences(df, [], (rule,)).select("lo", "hi")
    return df.crossJoin(F.broadcast(bound)).where(inside(F.col("rt"), F.lit(rule), F.col("lo"), F.col("hi"))).drop("lo", "hi")


def transformed(df: DataFrame, transformation: str) -> DataFrame:
    """Natural log for log_rt (null where undefined), unchanged for no_log_rt."""
    return df.withColumn("rt", F.when(F.col("rt") > 0, F.log("rt"))) if transformation == "log_rt" else df


def branch_counts(branches: DataFrame, kept: DataFrame, before: DataFrame, by: list[str], more: Sequence[Column] = ()) -> DataFrame:
    """branches with n_rows_in, n_rows_out, n_removed: rows before and after the outlier rule; branches without rows count 0. more: further aggregates of the kept rows."""
    n_in = before.groupBy(*[c for c in by if c in before.columns]).agg(F.count("*").alias("n_rows_in"))
    n_out = kept.groupBy(*by).agg(F.count("*").alias("n_rows_out"), *more)
    got = branches.join(n_in, [c for c in by if c in before.columns], "left").join(n_out, by, "left").fillna(0, ["n_rows_in", "n_rows_out"])
    return got.withColumn("n_removed", F.col("n_rows_in") - F.col("n_rows_out"))
