"""Trial and result tables over the general tables, in SQL that Spark and other engines read alike.

Names in braces are tables. source_row and branch_idx are made from the row's own keys, so no global numbering is needed.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession

from specgrid.sources.scratch import spread

TRIALS_EV = """
select cast(user_id as string) as participant_id, event_id as source_row,
  cast(row_number() over (partition by user_id order by ts, event_id) as bigint) as trial_index,
  cast(floor((row_number() over (partition by user_id order by ts, event_id) - 1) / 16) as bigint) + 1 as block_index,
  case when event_type in ('click', 'view') then 1 else -1 end as cong,
  lag(case when event_type in ('click', 'view') then 1 else -1 end) over (partition by user_id order by ts, event_id) as prev_cong,
  value as rt, event_type <> 'error' as correct,
  lag(event_type <> 'error') over (partition by user_id order by ts, event_id) as prev_correct,
  case when user_id % 2 = 0 then 'even' else 'odd' end as study
from {events}
"""

KEY = "l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice"
TRIALS_LI = f"""
select cast(l_suppkey as string) as participant_id, cast(l_suppkey as bigint) * 10000000 + row_number() over (partition by l_suppkey order by {KEY}) as source_row,
  cast(row_number() over (partition by l_suppkey order by {KEY}) as bigint) as trial_index,
  cast(year(l_shipdate) as bigint) as block_index,
  case when l_linestatus = 'O' then 1 else -1 end as cong,
  lag(case when l_linestatus = 'O' then 1 else -1 end) over (partition by l_suppkey order by {KEY}) as prev_cong,
  cast(l_extendedprice as double) / 50 as rt, l_returnflag <> 'R' as correct,
  lag(l_returnflag <> 'R') over (partition by l_suppkey order by {KEY}) as prev_correct,
  concat('s', cast(l_suppkey % 5 as string)) as study
from {{lineitem}}
"""

RESULTS_LI = f"""
select cast(l_suppkey as bigint) * 10000000 + row_number() over (partition by l_suppkey order by {KEY}) as branch_idx,
  concat('b', cast(cast(l_suppkey as bigint) * 10000000 + row_number() over (partition by l_suppkey order by {KEY}) as string)) as branch_id,
  case l_partkey % 4 when 0 then 'rmanova' when 1 then 'lmm_intercept' when 2 then 'lmm_cong_slope' else 'lmm_full_slope' end as model,
  case when l_linestatus = 'O' then 'log_rt' else 'no_log_rt' end as transformation,
  case l_linenumber when 1 then 'none' when 2 then 'sd_2' when 3 then 'sd_2.5' when 4 then 'mad_2'
    when 5 then 'mad_2.5' when 6 then 'range_1000' else 'range_1500' end as outlier,
  cast(case l_suppkey % 4 when 0 then 0.1 when 1 then 0.25 when 2 then 0.5 else 1.0 end as double) as sample_size,
  cast(l_quantity as int) as subsample_id,
  case when l_returnflag = 'N' then 'present' else 'null_interaction' end as effect_condition,
  case when l_returnflag = 'N' then 'none' else case l_orderkey % 5 when 0 then 'shuffle' when 1 then 'additive_qmap'
    when 2 then 'additive_qmap_trial_bin' when 3 then 'local_mean_residual' else 'local_median_residual' end end as strip_method,
  cast(cast(l_quantity as double) * 10 as int) as n_obs,
  l_orderkey % 41 = 0 as error, l_orderkey % 13 <> 0 as full_converged, l_partkey % 29 <> 0 as null_converged, l_partkey % 17 = 0 as full_is_singular,
  cast(l_extendedprice as double) / 1000 - 50 as main_estimate, 1 + cast(l_tax as double) * 10 as main_std_error, cast(l_discount as double) as main_p_value,
  case when l_returnflag = 'N' then 'reference_present' when l_orderkey % 3 = 0 then 'fails_preservation_gates' else 'interpretable_nullifier' end as nullification_verdict,
  cast(l_extendedprice as double) / 1000 - 50 - 1.96 * (1 + cast(l_tax as double) * 10) as effect_ci_lower,
  cast(l_extendedprice as double) / 1000 - 50 + 1.96 * (1 + cast(l_tax as double) * 10) as effect_ci_upper
from {{lineitem}}
"""
#: SQL, table, and the column whose rows meet in the view's windows.
VIEWS = {"trials_ev": (TRIALS_EV, "events", "user_id"), "trials_li": (TRIALS_LI, "lineitem", "l_suppkey"), "results_li": (RESULTS_LI, "lineitem", "l_suppkey")}


#: Rows of a table for each partition of a shuffle.
ROWS = 250_000


def partitioned(spark: SparkSession, rows: int) -> None:
    """Raises spark.sql.shuffle.partitions to one for every ROWS rows, so that a task's rows don't grow with the table; never lowers it."""
    wanted = math.ceil(rows / ROWS)
    if wanted > int(spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set("spark.sql.shuffle.partitions", wanted)


def view(spark: SparkSession, sf_dir: str, name: str, dealt: bool = False) -> DataFrame:
    """The view of a table. dealt: the table's own rows are shuffled to the windows, not the wider ones that the view makes of them; for queries that read
    most columns and what the windows number, since others need no shuffle or a smaller one."""
    sql, source, key = VIEWS[name]
    table = spark.read.parquet(f"{sf_dir}/{source}.parquet")
    partitioned(spark, table.count())
    return spark.sql(sql, **{source: spread(table, key) if dealt else table})


def plain(name: str) -> str:
    """The view's SQL with the table's own name, for other engines."""
    sql, source, _ = VIEWS[name]
    return sql.format(**{source: source})
