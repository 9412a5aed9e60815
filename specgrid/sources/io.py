"""Sources and sinks. Readers take paths that Spark opens; what is written again replaces itself, by run or by branch."""

from __future__ import annotations

import time
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from specgrid.operators.audit import study_of
from specgrid.schema import RESULTS_SCHEMA
from specgrid.sources.scratch import saved, spread

NULL_TOKENS = ("NA", "NaN", "")
REQUIRED = ("trial_index", "block_index", "cong", "participant_id", "rt", "correct", "prev_correct", "prev_cong")

#: What names a data branch, the column of its write, and replaced branches that are broadcast at most.
BRANCH, WRITTEN, REPLACED = ("strip_method", "outlier", "data_id"), "written", 1_000_000


def null_tokens(df: DataFrame, tokens: tuple[str, ...] = NULL_TOKENS) -> DataFrame:
    return df.select(*(F.when(~F.col(f"`{c}`").isin(*tokens), F.col(f"`{c}`")).alias(c) if k == "string" else F.col(f"`{c}`") for c, k in df.dtypes))


def read_trials(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header, every column a string, NA, NaN and the empty string as null."""
    return null_tokens(spark.read.csv(path, header=True, inferSchema=False))


def code(column: Column) -> Column:
    """-1 or +1 from "1", "1.0", "-1" or "-1.0"; anything else is null."""
    value = column.cast("string").try_cast("double")
    return F.when(value.isin(-1.0, 1.0), value).cast("int")


def normalize_types(df: DataFrame) -> DataFrame:
    kinds = {"participant_id": F.col("participant_id").cast("string"), "rt": F.col("rt").cast("string").try_cast("double"), "cong": code(F.col("cong")), "prev_cong": code(F.col("prev_cong"))}
    return df.withColumns({c: x for c, x in kinds.items() if c in df.columns})


def indexed_design(df: DataFrame) -> DataFrame:
    """A design table: a blank first column becomes export_row_index, required columns are checked, study comes from the id's suffix, source_row is kept or numbered."""
    first = df.columns[0]
    if first.strip() in ("", "_c0"):
        df = df.withColumnRenamed(first, "export_row_index")
    if missing := [c for c in REQUIRED if c not in df.columns]:
        raise ValueError(f"missing required columns: {', '.join(missing)}")
    df = df.withColumn("study", study_of(F.col("participant_id"))) if "study" not in df.columns else df
    if "source_row" in df.columns:
        return df
    if "export_row_index" in df.columns:
        return df.withColumn("source_row", F.col("export_row_index").cast("long"))
    return numbered(df, "source_row")


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df with numbers from 1, without gaps, in the order of its partitions and their rows: each partition counts its own and begins after those before it."""
    kept = saved(df.withColumn("__id", F.monotonically_increasing_id()))
    part = F.shiftright("__id", 33)
    sizes = kept.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    starts = sizes.select(F.col("__part"), (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__start"))
    got = kept.join(F.broadcast(starts), part == F.col("__part"))
    return got.withColumn(name, F.col("__start") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)) + 1).select(*df.columns, name)


def read_indexed_design(spark: SparkSession, path: str) -> DataFrame:
    return indexed_design(read_trials(spark, path))


def read_branch(spark: SparkSession, path: str, required: list[str], columns: list[str] | None = None) -> DataFrame:
    """Parquet (also what write_branches wrote) or CSV with only the wanted columns; missing required ones raise."""
    df = spark.read.csv(path, header=True) if path.rstrip("/").endswith(".csv") else spark.read.parquet(path)
    df = latest_branches(df) if WRITTEN in df.columns else df
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"missing required columns: {', '.join(missing)}")
    return df.select(*[c for c in (columns or df.columns) if c in df.columns])


def latest_results(results: DataFrame) -> DataFrame:
    """One row for each branch id: the latest by timestamp, then by stage."""
    w = Window.partitionBy("branch_id").orderBy(F.col("timestamp").desc_nulls_last(), F.col("stage_completed").desc_nulls_last(), "branch_idx")
    return results.withColumn("__at", F.row_number().over(w)).where("__at = 1").drop("__at")


def load_results(spark: SparkSession, path: str, validate: bool = True) -> DataFrame:
    if validate and (missing := [c for c in RESULTS_SCHEMA.names if c not in spark.read.parquet(path).columns]):
        raise ValueError(f"missing result columns: {', '.join(missing)}")
    return latest_results(spread(spark.read.schema(RESULTS_SCHEMA).parquet(path), "branch_id"))


def run_id(rows: DataFrame) -> str:
    """A name made from the rows, whatever their order: the same rows written again get the same."""
    text = F.to_json(F.struct(*(F.col(f"`{c}`") for c in rows.columns)))
    n, a, b = rows.select(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b")).agg(F.count("*"), F.sum(F.col("a").cast("decimal(38,0)")), F.sum(F.col("b").cast("decimal(38,0)"))).first()
    return f"{n}-{int(a or 0) % (1 << 64):016x}{int(b or 0) % (1 << 64):016x}"


def publish(rows: DataFrame, path: str, run: str | None = None, kind: str = "parquet", stored: bool = False) -> str:
    """Adds rows to a table as one run (its name, or one made from the rows) and returns that.

    A run that is there already is replaced, so a job that is repeated, or was lost half way and starts anew, adds nothing
    twice; files of an unfinished job lie beside the table and are never read. Other runs stay as they are.

    A run without a name reads its rows twice, for the name and to write them, so they are saved first, unless they are stored: read
    from a written table, with nothing that costs much or may differ the next time.
    """
    if run is None:
        rows = rows if stored else saved(rows)
        run = run_id(rows)
    writer = rows.withColumn("run", F.lit(run)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").format(kind)
    (writer.option("compression", "zstd") if kind == "parquet" else writer).save(path)
    return run


def read_published(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """All runs of a table, without their names."""
    return spark.read.format(kind).load(path).drop("run")


def write_branches(df: DataFrame, path: str) -> None:
    """Data branches as Parquet, a folder for each write, strip method and outlier rule, however many branches there are; read_branch reads them.

    A branch that is written again is replaced for its readers, who take its latest write by the writers' clocks; others stay. A
    folder appears when all of it is written, and writers of different branches don't meet.
    """
    folders = [c for c in BRANCH[:2] if c in df.columns]
    rows = df.withColumn(WRITTEN, F.lit(f"w{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(WRITTEN, *folders).parquet(path)


def latest_branches(table: DataFrame) -> DataFrame:
    """The rows of each branch's latest write. Branches and their writes are counted; only those that were written again are looked up."""
    keys = [c for c in BRANCH if c in table.columns]
    writes = table.groupBy(*keys, WRITTEN).agg(F.count("*").alias("n"))
    old = writes.withColumn("__last", F.max(WRITTEN).over(Window.partitionBy(*keys))).where(F.col(WRITTEN) < F.col("__last"))
    old = saved(old.select(*(F.col(c).alias(f"__old_{c}") for c in (*keys, WRITTEN))))
    n = old.count()
    if not n:
        return table.drop(WRITTEN)
    on = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"__old_{c}")) for c in (*keys, WRITTEN)))
    return table.join(F.broadcast(old) if n <= REPLACED else old, on, "left_anti").drop(WRITTEN)


def write_results(results: DataFrame, path: str, run: str | None = None, stored: bool = False) -> str:
    return publish(results.select(*(F.col(f.name).cast(f.dataType) for f in RESULTS_SCHEMA)), path, run, stored=stored)


def append_metadata(rows: DataFrame, path: str, run: str | None = None) -> str:
    return publish(rows, path, run)


def branch_metadata(counts: DataFrame) -> DataFrame:
    """Counts of rows in, out and removed as a branch's metadata; a branch without rows is a failure with a reason."""
    ok = F.col("n_rows_out") > 0
    return counts.withColumns({"success": ok, "error": F.when(~ok, "no rows left")})


def write_branch_metadata(meta: DataFrame, path: str, run: str | None = None) -> str:
    return publish(meta, path, run, "json")


def write_tables(tables: dict[str, DataFrame], path: str) -> list[str]:
    """One CSV folder with a header for each table that isn't empty; returns their names."""
    written = [k for k, t in tables.items() if not t.isEmpty()]
    for k in written:
        tables[k].write.mode("overwrite").csv(f"{path.rstrip('/')}/{k}", header=True)
    return written


def table_manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, n_rows, n_columns, columns) of every table."""
    parts = [t.agg(F.lit(k).alias("table"), F.count("*").alias("n_rows"), F.lit(len(t.columns)).cast("long").alias("n_columns"), F.lit(",".join(t.columns)).alias("columns")) for k, t in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def empty_results(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], RESULTS_SCHEMA)
