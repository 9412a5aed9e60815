"""Data branches as tables: effect variant, participant sample, outlier rule and transformation, in this order.

The grid plans of `plans/scale.py` need no branch as a copy of its trials. Where one is wanted all the same (to be written,
handed on or looked into), this makes the trials of any number of branches in one job: effects are made once on everyone,
fences are looked up in the index of `plans/index.py`, samples are joined as lists of participants, and a trial is repeated
only for the branches that keep it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specgrid.operators import nullify, sampling
from specgrid.plans import index
from specgrid.sources import io
from specgrid.sources.scratch import saved

SAMPLE = ["sample_size", "sample", "subsample_id"]


def materialized(trials: DataFrame, branches: DataFrame, seed: str = sampling.SEED) -> DataFrame:
    """The trials of every data branch, as trials's columns (rt as the branch has it) and the branch's data_id, axes and strip_method.

    branches are rows of `grid.data_branches`, a plan of the size of the configuration; only the labels of its axes are
    collected. A branch that keeps no trial has no rows here (`sampling.branch_counts` tells).
    """
    labels = branches.agg(F.collect_set("strip_method"), F.collect_set("outlier")).first()
    strips, rules = (tuple(sorted(x)) for x in labels)
    if not strips:
        return trials.where("false").join(branches, F.lit(True))
    keep = [c for c in trials.columns if c not in (*branches.columns, "rt")]
    effects = saved(nullify.long_effects(nullify.all_effects(trials, strips), strips))
    members = saved(sampling.membership(trials, branches.select(*SAMPLE).distinct(), seed))
    by = [*SAMPLE, "strip_method"]
    fences = index.fences(index.build(effects, members, strips), effects, rules)
    # a row for each branch: its bounds, its axes, and numbers for its sample and variant, so that a trial meets its branches in one look-up
    at = F.array_position(F.array(*map(F.lit, strips)), F.col("strip_method")).cast("int")
    numbers = saved(branches.select(*SAMPLE).distinct().coalesce(1).withColumn("__sample", F.monotonically_increasing_id().cast("int")))
    axes = branches.select("data_id", *by, "outlier", "transformation", "effect_condition").join(fences, [*by, "outlier"]).join(numbers, SAMPLE)
    axes = saved(axes.select("*", at.alias("__variant"), (F.col("outlier") == "none").alias("__every"), (F.col("transformation") == "log_rt").alias("__log")))
    drawn = members.join(F.broadcast(numbers), SAMPLE).select("participant_id", "__sample")
    timed = effects.select(*keep, F.col("rt").alias("__rt"), at.alias("__variant")).join(drawn, "participant_id")
    kept = timed.join(F.broadcast(axes), ["__sample", "__variant"]).where(F.col("__every") | F.coalesce(F.col("__rt").between(F.col("lo"), F.col("hi")) & ~F.isnan("__rt"), F.lit(False)))
    rt = F.when(F.col("__log"), F.when(F.col("__rt") > 0, F.log("__rt"))).otherwise(F.col("__rt"))
    return kept.select("data_id", *by, "outlier", "transformation", "effect_condition", *keep, rt.alias("rt"))


def write_materialized(trials: DataFrame, branches: DataFrame, path: str, seed: str = sampling.SEED) -> None:
    """Writes every data branch as Parquet, in folders that readers of single branches can prune to."""
    io.write_branches(materialized(trials, branches, seed), path)
