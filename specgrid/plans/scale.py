"""The grid without copying trials: branches are rows, looked up in an index of each participant's ordered times.

Copying trials into every branch would multiply them by the samples, effect variants, rules and transformations. Instead the
effect variants are made once on everyone, a sample is a list of participants, fences of any rule come from counts over the
index (`plans/index.py`), and the statistics inside them from two searches a fence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specgrid.operators import models, nullify, sampling
from specgrid.plans import index
from specgrid.sources.scratch import saved

CELL = ["participant_id", "cong", "prev_cong"]
KEYS = ["sample_size", "sample", "subsample_id"]


def scaled(df: DataFrame, transforms: tuple[str, ...]) -> DataFrame:
    """One row for each transformation, the transformed time in rt."""
    of = {"no_log_rt": F.col("rt"), "log_rt": F.when(F.col("rt") > 0, F.log("rt"))}
    keep = [c for c in df.columns if c != "rt"]
    return df.select(*keep, F.inline(F.array(*(F.struct(F.lit(t).alias("transformation"), of[t].alias("rt")) for t in transforms))))


def grid_stats(trials: DataFrame, samples: DataFrame, strips: tuple[str, ...], rules: tuple[str, ...], transforms: tuple[str, ...], seed: str = sampling.SEED) -> DataFrame:
    """(sample_size, sample, subsample_id, strip_method, outlier, transformation, participant_id, cong, prev_cong, n, sy, syy) for the whole grid.

    The effects and the samples are read by several passes, so they are written to the scratch folder.
    """
    effects = saved(nullify.long_effects(nullify.all_effects(trials, strips), strips).select(*CELL, "source_row", "strip_method", "rt"))
    members = saved(sampling.membership(trials, samples, seed))
    own = index.build(effects, members, strips)
    return index.grid_stats(own, effects, rules, transforms).select(*KEYS, "strip_method", "outlier", "transformation", *CELL, "n", "sy", "syy")


def simple_grid_stats(trials: DataFrame, samples: DataFrame, strips: tuple[str, ...], rules: tuple[str, ...], transforms: tuple[str, ...], seed: str = sampling.SEED) -> DataFrame:
    """The same by joining the trials to every sample first: for any rule, and what the plan above is held against."""
    effects = nullify.long_effects(nullify.all_effects(trials, strips), strips)
    drawn = saved(effects.join(sampling.membership(trials, samples, seed), "participant_id"))
    by = [*KEYS, "strip_method"]
    bounds = sampling.fences(drawn, by, rules)
    kept = drawn.join(bounds, by).where(sampling.inside(F.col("rt"), F.col("outlier"), F.col("lo"), F.col("hi")))
    return models.suff_stats(scaled(kept, transforms), [*by, "outlier", "transformation"])


def grid_mixed(trials: DataFrame, samples: DataFrame, strips: tuple[str, ...], rules: tuple[str, ...], transforms: tuple[str, ...]) -> DataFrame:
    """The mixed models of every branch, from the same statistics; a row for each branch and model."""
    return models.mixed_models(grid_stats(trials, samples, strips, rules, transforms), [*KEYS, "strip_method", "outlier", "transformation"])


def grid_rmanova(trials: DataFrame, samples: DataFrame, strips: tuple[str, ...], rules: tuple[str, ...], transforms: tuple[str, ...]) -> DataFrame:
    """The interaction test of every branch."""
    return models.rmanova(grid_stats(trials, samples, strips, rules, transforms), [*KEYS, "strip_method", "outlier", "transformation"])
