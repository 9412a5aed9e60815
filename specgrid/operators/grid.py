"""The branch grid: every combination of sample, transformation, outlier rule, model and effect variant, as rows.

Ids keep seven parts, joined by two underscores: sample, subsample, transformation, outlier, model, effect, strip method; a
data branch's id leaves out the model.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Labels of the axes, in the order that numbers branches: fixed names.
TRANSFORMS = ("log_rt", "no_log_rt")
OUTLIERS = ("none", "sd_2", "sd_2.5", "sd_3", "mad_2", "mad_2.5", "mad_3", "range_1000", "range_1250", "range_1500")
MODELS = ("rmanova", "lmm_intercept", "lmm_cong_slope", "lmm_full_slope")
STRIPS = ("shuffle", "additive_qmap", "additive_qmap_trial_bin", "local_mean_residual", "local_median_residual")
EFFECTS = ("present", "null_interaction")
#: Older spellings: fixed names.
ALIASES = {"qmap": "additive_qmap", "qmap_5": "additive_qmap", "qmap_5_trial_bin": "additive_qmap_trial_bin"}
SEP = "__"


@dataclass(frozen=True)
class Grid:
    fractions: tuple[float, ...] = (0.1, 0.25, 0.5, 1.0)
    samples: int = 5
    transforms: tuple[str, ...] = TRANSFORMS
    outliers: tuple[str, ...] = OUTLIERS
    models: tuple[str, ...] = MODELS
    effects: tuple[str, ...] = EFFECTS
    strips: tuple[str, ...] = STRIPS


def label_of(fraction: float) -> str:
    """The shortest decimal: 1 for 1.0, 0.15 for 0.15."""
    return f"{fraction:.10g}"


def axis(spark: SparkSession, name: str, values: tuple) -> DataFrame:
    """(name, name_at) rows of one axis, a literal table as long as the configuration names values."""
    kind = "double" if values and isinstance(values[0], float) else "string"
    return spark.createDataFrame([(v, i) for i, v in enumerate(values)], f"{name} {kind}, {name}_at int")


def base_samples(spark: SparkSession, fractions: tuple[float, ...], samples: int) -> DataFrame:
    """(sample_size, sample, subsample_id, task_id, interpretation): `samples` ids for each fraction, one for the whole."""
    rows, task = [], 0
    for f in fractions:
        whole = abs(f - 1.0) < 1e-6
        n = 1 if whole else samples
        rows.append((float(f), label_of(f), n, task, "full_sample" if whole else "participant_subsample"))
        task += n
    held = spark.createDataFrame(rows, "sample_size double, sample string, n int, first int, interpretation string")
    ids = held.withColumn("subsample_id", F.explode(F.sequence(F.lit(1), F.col("n"))))
    return ids.select("sample_size", "sample", "subsample_id", (F.col("first") + F.col("subsample_id") - 1).alias("task_id"), "interpretation")


def effect_variants(spark: SparkSession, effects: tuple[str, ...], strips: tuple[str, ...]) -> DataFrame:
    """(effect_condition, strip_method, variant_at): present once with none, null_interaction once for each method."""
    rows = [("present", "none")] * ("present" in effects) + [("null_interaction", s) for s in strips if "null_interaction" in effects]
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "effect_condition string, strip_method string, variant_at int")


def branch_id(model: Column | None = None) -> Column:
    parts = ["sample", F.col("subsample_id").cast("string"), "transformation", "outlier", *([] if model is None else [model]), "effect_condition", "strip_method"]
    return F.concat_ws(SEP, *parts)


def data_branches(spark: SparkSession, grid: Grid) -> DataFrame:
    """One row for each data branch: its axes and data_id."""
    got = base_samples(spark, grid.fractions, grid.samples)
    for name, values in (("transformation", grid.transforms), ("outlier", grid.outliers)):
        got = got.crossJoin(F.broadcast(axis(spark, name, values)))
    got = got.crossJoin(F.broadcast(effect_variants(spark, grid.effects, grid.strips)))
    return got.withColumn("data_id", branch_id())


def model_branches(spark: SparkSession, grid: Grid) -> DataFrame:
    """One row for each model branch, with branch_id, data_id and branch_idx (from the places on the axes, so no sort is needed)."""
    got = data_branches(spark, grid).crossJoin(F.broadcast(axis(spark, "model", grid.models)))
    variants = ("present" in grid.effects) + len(grid.strips) * ("null_interaction" in grid.effects)
    at = F.col("task_id").cast("long")
    for name, n in (("transformation_at", len(grid.transforms)), ("outlier_at", len(grid.outliers)), ("variant_at", variants), ("model_at", len(grid.models))):
        at = at * n + F.col(name)
    return got.select(
        (at + 1).alias("branch_idx"), branch_id(F.col("model")).alias("branch_id"), "data_id", "sample_size", "subsample_id", "transformation", "outlier", "model", "effect_condition", "strip_method",
    )


def data_id_of(branch: Column) -> Column:
    """A branch id without its fifth part, the model."""
    parts = F.split(branch, SEP)
    return F.concat_ws(SEP, F.slice(parts, 1, 4), F.slice(parts, 6, 2))


def parse_data_id(df: DataFrame, column: str = "data_id") -> DataFrame:
    """df with the six parts of a data id as columns; null where there are not six parts."""
    parts = F.split(F.col(column), SEP)
    part = lambda i: F.when(F.size(parts) == 6, F.element_at(parts, i))
    return df.withColumns({
        "sample_size": part(1).try_cast("double"), "subsample_id": part(2).try_cast("int"), "transformation": part(3), "outlier": part(4), "effect_condition": part(5), "strip_method": part(6),
    })


def normalized(column: Column, kind: str) -> Column:
    """The label in lower case without blanks, older spellings replaced; an unknown one raises."""
    known = {"transformation": TRANSFORMS, "outlier": OUTLIERS, "effect_condition": EFFECTS, "strip_method": ("none", *STRIPS)}[kind]
    low = F.lower(F.trim(column))
    pairs = {**{k: k for k in known}, **{a: b for a, b in ALIASES.items() if b in known}}
    found = F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])[low]
    return F.when(found.isNotNull() | column.isNull(), found).otherwise(F.raise_error(F.concat(F.lit(f"unknown {kind}: "), column)).cast("string"))


def pending(branches: DataFrame, done: DataFrame) -> DataFrame:
    """Branches without a result yet."""
    return branches.join(done.select("branch_id").distinct(), "branch_id", "left_anti")


#: The fits that this package runs: what each is called, the operator, its random part as a formula, and how many variance parameters that has.
FITS = (
    ("rmanova", "models.rmanova", "Error(participant_id / (cong * prev_cong))", 0),
    ("cell_mean_t", "models.cell_mean_t", "Error(participant_id / (cong * prev_cong))", 0),
    ("participant_fe", "models.participant_fe_lm", "participant_id", 0),
    ("lmm_intercept", "models.mixed_models", "(1 | participant_id)", 1),
    ("lmm_cong_slope", "models.mixed_models", "(1 + cong | participant_id)", 3),
    ("lmm_full_slope", "models.mixed_models", "(1 + cong * prev_cong | participant_id)", 10),
)
#: What a fit's row says when there is no estimate, and which rows count as usable, as the operators have them.
ENDS = {
    "models.rmanova": ("n_complete < 2 or sd = 0", "n_complete"),
    "models.cell_mean_t": ("error (strict) or n_complete < 2", "n_complete"),
    "models.participant_fe_lm": ("error", "df > 0"),
    "models.mixed_models": ("error or not full_converged", "full_converged and not full_is_singular"),
}
STRATEGY_SCHEMA = "strategy_id string, operator string, outcome_scale string, formula_full string, formula_null string, term string, n_variances int, fails_if string, usable_if string"


def strategy_rows() -> list[tuple]:
    """A row of STRATEGY_SCHEMA for every fit on either scale; the formulas follow from the fixed part, with and without the interaction."""
    return [
        (f"{name}__{scale}", operator, scale, *(f"{y} ~ cong {op} prev_cong + {random}" for op in "*+"), "cong:prev_cong", n, *ENDS[operator])
        for name, operator, random, n in FITS for scale, y in (("rt", "rt"), ("log_rt", "ln(rt)"))
    ]


def strategy_table(spark: SparkSession) -> DataFrame:
    """The fits of this package: their operators, formulas with and without the interaction, and what makes a fit fail or usable."""
    return spark.createDataFrame(strategy_rows(), STRATEGY_SCHEMA)


def planned_strategies(trials: DataFrame, by: list[str]) -> DataFrame:
    """The strategies for each group of trials (by), with the rows and participants that each can use: finite times, above 0 on the log scale, and both codes."""
    fine = F.col("rt").isNotNull() & ~F.isnan("rt") & (F.abs("rt") < float("inf")) & F.col("cong").isNotNull() & F.col("prev_cong").isNotNull()
    log = fine & (F.col("rt") > 0)
    count = lambda ok: F.struct(F.count(F.when(ok, 1)).alias("n_rows"), F.count_distinct(F.when(ok, F.col("participant_id"))).alias("n_participants"))
    held = trials.groupBy(*by).agg(count(fine).alias("rt"), count(log).alias("log_rt"))
    got = held.crossJoin(F.broadcast(strategy_table(trials.sparkSession)))
    use = F.when(F.col("outcome_scale") == "rt", F.col("rt")).otherwise(F.col("log_rt"))
    return got.select(*by, *(c.split()[0] for c in STRATEGY_SCHEMA.split(", ")), use["n_rows"].alias("n_rows"), use["n_participants"].alias("n_participants"))
