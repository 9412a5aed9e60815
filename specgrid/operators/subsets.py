"""Design subsets for quick runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranked_participants(df: DataFrame) -> DataFrame:
    """(study, participant_id, rank) by first source row."""
    first = df.groupBy("study", "participant_id").agg(F.min("source_row").alias("first"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("study").orderBy("first", "participant_id")))


def subset_studies(df: DataFrame, n: int = 30) -> DataFrame:
    """All trials of the first n participants of each study."""
    return df.join(ranked_participants(df).where(F.col("rank") <= n).select("study", "participant_id"), ["study", "participant_id"], "left_semi")


def first_n_participants(df: DataFrame, studies: list[str], n: int) -> DataFrame:
    """Valid trials of the first n participants of some studies, coded -0.5 and +0.5, with trial_z: the trial index standardised within the participant (0 if constant)."""
    rt = F.col("rt")
    good = df.where(F.col("study").isin(*studies) & (rt > 0) & ~F.isnan(rt) & (rt < float("inf")) & F.col("cong").isin(-1, 1) & F.col("prev_cong").isin(-1, 1))
    own = Window.partitionBy("study", "participant_id")
    sd = F.stddev_samp("trial_index").over(own)
    z = F.when(sd > 0, (F.col("trial_index") - F.avg("trial_index").over(own)) / sd).otherwise(0.0)
    return subset_studies(good, n).withColumns({"trial_z": z, "cong_code": F.col("cong") / 2, "prev_code": F.col("prev_cong") / 2})
