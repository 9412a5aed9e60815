"""Queries over trials: harmonising, audits, the grid, nullifiers, sampling, models and diagnostics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from specgrid.functions.quantile import inverse_on_grid, quantile_type8
from specgrid.operators import audit, diagnostics, grid, harmonize, materialize, models, nullify, sampling, subsets
from specgrid.plans import scale
from specgrid.registry import query
from specgrid.sources import io
from specgrid.sources.scratch import saved, scratch

CELLS = ((1, 1), (1, -1), (-1, 1), (-1, -1))


def contrast_sql(agg: str, column: str = "rt") -> str:
    one = lambda c, p: f"{agg}(case when cong = {c} and prev_cong = {p} then {column} end)"
    return f"({one(1, 1)} - {one(1, -1)} - {one(-1, 1)} + {one(-1, -1)})"


def least_sql(extra: str = "") -> str:
    return "least(" + ", ".join(f"count(case when cong = {c} and prev_cong = {p}{extra} then 1 end)" for c, p in CELLS) + ")"


# --- harmonising --------------------------------------------------------------------------------------------------------

RAW = "select participant_id as participant, source_row, trial_index, rt, correct, case when cong = -1 then 'incongruent' else 'congruent' end as congruency, study from trials"


def raw(df: DataFrame) -> DataFrame:
    return df.select(F.col("participant_id").alias("participant"), "source_row", "trial_index", "rt", "correct", F.when(F.col("cong") == -1, "incongruent").otherwise("congruent").alias("congruency"))


@query("trials_ev", "participant_id:s source_row cong prev_cong correct:b prev_correct:b study:s", f"""
with raw as ({RAW}) select concat(participant, '_zeng') as participant_id, source_row, case when congruency = 'incongruent' then -1 else 1 end as cong,
  case when lag(congruency) over w is null then null when lag(congruency) over w = 'incongruent' then -1 else 1 end as prev_cong, correct, lag(correct) over w as prev_correct, 'zeng' as study
from raw window w as (partition by participant order by trial_index, source_row)""")
def harmonize_zeng(df):
    return harmonize.adapt_zeng(raw(df))


@query("trials_ev", "participant_id:s source_row block_index changes", """
with c as (select *, case when correct <> lag(correct) over w then 1 else 0 end as changed, case when cong = -1 then 1 else 0 end as pause from trials window w as (partition by participant_id order by trial_index, source_row))
select participant_id, source_row, 1 + sum(pause) over w as block_index, 1 + sum(changed) over w as changes from c window w as (partition by participant_id order by trial_index, source_row)""")
def harmonize_blocks(df):
    changed = harmonize.block_by_change(df, "correct").withColumnRenamed("block_index", "changes")
    return harmonize.block_by_marker(changed, F.col("cong") == -1)


@query("trials_ev", "participant_id:s source_row cong prev_cong prev_correct:b is_practice:b", """
with r as (select concat(participant_id, '_zhang') as participant_id, source_row, trial_index, correct,
    case when cong = 1 then 1 else -1 end as cong, trial_index <= 4 as is_practice from trials where trial_index % 7 <> 0)
select participant_id, source_row, cong, lag(cong) over w as prev_cong, lag(correct) over w as prev_correct, is_practice from r window w as (partition by participant_id order by trial_index, source_row)""")
def harmonize_zhang(df):
    condition = F.when(F.col("cong") == 1, "no_conflict").when(F.col("trial_index") % 2 == 0, "low_conflict").otherwise("high_conflict")
    base = raw(df).withColumns({"is_response": F.col("trial_index") % 7 != 0, "name": F.when(F.col("trial_index") <= 4, "practice").otherwise("main")})
    cond = df.select(F.col("source_row"), condition.alias("condition"))
    return harmonize.adapt_zhang(base.join(cond, "source_row"))


@query("trials_ev", "participant_id:s source_row cong prev_cong prev_correct:b prev_loss block_index block_feedback_type:s", """
with r as (select concat(participant_id, '_yang') as participant_id, source_row, trial_index, correct, case when cong = -1 then 'incongruent' else 'congruent' end as congruency,
    case when trial_index % 5 = 0 then 'probe' else 'feedback' end as task, case when rt > 70 then 'monetary_loss' when rt > 40 then 'tickmark' end as feedback, concat('f', cast(trial_index % 3 as varchar)) as feedback_type from trials),
l as (select *, lag(feedback, 4) over w as pf, lag(correct, 5) over w as prev_correct, lag(congruency, 5) over w as pc, lead(feedback_type) over w as block_feedback_type from r window w as (partition by participant_id order by trial_index, source_row)),
p as (select *, case when pc is null then null when pc = 'incongruent' then -1 else 1 end as prev_cong from l where task = 'probe')
select participant_id, source_row, case when congruency = 'incongruent' then -1 else 1 end as cong, prev_cong, prev_correct, case when pf is null then null when pf = 'monetary_loss' then 1 else 0 end as prev_loss,
  sum(case when prev_cong is null and prev_correct is null then 1 else 0 end) over (partition by participant_id order by trial_index, source_row) as block_index, block_feedback_type from p""")
def harmonize_yang(df):
    stimulus = F.when(F.col("rt") > 70, "<div>✘<br>5</div>").when(F.col("rt") > 40, "<div>✔</div>").otherwise("<div></div>")
    base = raw(df).withColumns({"task": F.when(F.col("trial_index") % 5 == 0, "probe").otherwise("feedback"), "stimulus": stimulus, "feedback_type": F.concat(F.lit("f"), (F.col("trial_index") % 3).cast("string")), "name": F.lit("main")})
    return harmonize.adapt_yang(base)


@query("trials_ev", "participant_id:s source_row trial_index prev_correct:b is_first_trial:b", """
select concat(participant_id, '_flanker') as participant_id, source_row, row_number() over w as trial_index, lag(correct) over w as prev_correct, row_number() over w = 1 as is_first_trial
from trials window w as (partition by participant_id order by source_row)""")
def harmonize_supplied_prev(df):
    return harmonize.adapt_supplied_prev(raw(df), "flanker")


@query("trials_ev", "study:s participant_id:s n_rows n_true n_false n_null", """
select study, participant_id, count(*) as n_rows, count(case when b then 1 end) as n_true, count(case when not b then 1 end) as n_false, count(case when b is null then 1 end) as n_null from (
  select study, participant_id, case when t in ('t', '1') then true when t = 'no' then false end as b
  from (select *, case source_row % 4 when 0 then 't' when 1 then '1' when 2 then 'no' else 'maybe' end as t from trials) x
  union all select study, participant_id, case when correct then true else false end from trials) y group by study, participant_id""")
def harmonize_union(df):
    text = F.element_at(F.array(F.lit("t"), F.lit(" 1 "), F.lit("No"), F.lit("maybe")), (F.col("source_row") % 4 + 1).cast("int"))
    first = df.select("study", "participant_id", "source_row", text.alias("correct"))
    got = harmonize.union_studies([first, df.select("study", "participant_id", "source_row", F.col("correct").cast("string").alias("correct"), "rt")])
    n = lambda c: F.count(F.when(c, 1))
    b = F.col("correct_bool")
    return got.groupBy("study", "participant_id").agg(F.count("*").alias("n_rows"), n(b).alias("n_true"), n(~b).alias("n_false"), n(b.isNull()).alias("n_null"))


def flagged(df: DataFrame) -> DataFrame:
    base = df.withColumns({"correct_bool": F.col("correct"), "prev_correct_bool": F.col("prev_correct"), "is_practice_bool": F.col("trial_index") <= 2})
    return harmonize.first_in_block(base)


def exclusion_parts(df: DataFrame):
    base = flagged(df)
    blocks = harmonize.block_instability(harmonize.accuracy(base, ["study", "participant_id", "block_index"]), 0.5)
    people = harmonize.exclusion_reasons(harmonize.accuracy(base, ["study", "participant_id"]), blocks, 0.7)
    eligible = harmonize.eligible_trials(base, people)
    counts = harmonize.cell_counts_complete(eligible)
    return base, people, eligible, counts, harmonize.filter_summary(people, harmonize.cell_balance(counts, 0.2))


ELIGIBLE = f"""
base as (select *, trial_index <= 2 as practice, row_number() over (partition by study, participant_id, block_index order by trial_index, source_row) = 1 as first_in_block from trials),
acc as (select study, participant_id, avg(cast(correct as int)) as accuracy, count(*) as n_trials from base where not practice and correct is not null group by all),
blk as (select study, participant_id, block_index, avg(cast(correct as int)) as a from base where not practice and correct is not null group by all),
inst as (select study, participant_id, min(a) as min_block_accuracy, bool_or(a < 0.5) as below from blk group by all),
people as (select acc.*, min_block_accuracy, accuracy < 0.7 as low, coalesce(below, true) as unstable, accuracy < 0.7 or coalesce(below, true) as pre,
  concat_ws(';', case when accuracy < 0.7 then 'low_overall_accuracy' end, case when coalesce(below, true) then 'unstable_block_accuracy' end) as pre_reason from acc left join inst using (study, participant_id)),
fine as (select *, coalesce(not practice and correct and prev_correct and not first_in_block and rt > 0 and cong is not null and prev_cong is not null, false) as fine from base),
eligible as (select f.* from fine f join people p using (study, participant_id) where fine and not pre),
counts as (select study, participant_id, {', '.join(f"count(case when cong = {c} and prev_cong = {p} then 1 end) as n{i}" for i, (c, p) in enumerate(CELLS))} from eligible group by all),
bal as (select study, participant_id, least(n0, n1, n2, n3) as min_cell_n, greatest(n0, n1, n2, n3) as max_cell_n from counts),
summary as (select p.*, min_cell_n, max_cell_n, not pre and not coalesce(min_cell_n > 0 and min_cell_n / max_cell_n >= 0.2, false) as odd from people p left join bal using (study, participant_id))
"""


@query("trials_ev", "study:s participant_id:s accuracy:d n_trials min_block_accuracy:d excluded:b exclusion_reason:s min_cell_n max_cell_n", f"""
with {ELIGIBLE} select study, participant_id, accuracy, n_trials, min_block_accuracy, pre or odd as excluded,
  concat_ws(';', case when pre_reason <> '' then pre_reason end, case when odd then 'imbalanced_condition_cells' end) as exclusion_reason, min_cell_n, max_cell_n from summary""")
def harmonize_exclusions(df):
    return exclusion_parts(df)[4]


@query("trials_ev", "study:s participant_id:s cong prev_cong cell_n", f"""
with {ELIGIBLE} select study, participant_id, unnest([1, 1, -1, -1]) as cong, unnest([1, -1, 1, -1]) as prev_cong, unnest([n0, n1, n2, n3]) as cell_n from counts""")
def harmonize_cell_counts(df):
    return exclusion_parts(df)[3]


@query("trials_ev", "study:s participant_id:s source_row rt:d", f"""
with {ELIGIBLE} select e.study, e.participant_id, source_row, rt from eligible e join summary s using (study, participant_id) where not odd""")
def harmonize_eligible(df):
    _, _, eligible, _, summary = exclusion_parts(df)
    return harmonize.final_eligible(eligible, summary)


@query("trials_ev", "filter_stage:s study:s n_rows n_participants", f"""
with {ELIGIBLE}, staged as (
  select 'unfiltered_indexed' as filter_stage, study, participant_id from base union all select 'non_practice', study, participant_id from base where not practice
  union all select 'trial_filtered_pre_cell', study, participant_id from eligible
  union all select 'final_cse_eligible', e.study, e.participant_id from eligible e join summary s using (study, participant_id) where not odd)
select filter_stage, study, count(*) as n_rows, count(distinct participant_id) as n_participants from staged group by all""")
def harmonize_funnel(df):
    base, people, _, _, summary = exclusion_parts(df)
    return harmonize.filter_funnel(base, people, summary)


# --- sources and audits -----------------------------------------------------------------------------------------------


@query("trials_ev", "participant_id:s rt:d cong prev_cong study:s source_row", """
select participant_id, case when source_row % 9 = 0 then null else rt end as rt, case when source_row % 11 = 0 then null else cong end as cong, prev_cong, study, source_row from trials""")
def io_normalize_types(df):
    text = df.select(
        "participant_id", F.when(F.col("source_row") % 9 == 0, "NA").otherwise(F.col("rt").cast("string")).alias("rt"), "study", "source_row",
        F.when(F.col("source_row") % 11 == 0, "x").otherwise(F.concat(F.col("cong").cast("string"), F.lit(".0"))).alias("cong"), F.col("prev_cong").cast("string").alias("prev_cong"),
    )
    return io.normalize_types(io.null_tokens(text))


@query("trials_ev", "study:s participant_id:s source_row", "select concat('s', cast(block_index % 3 as varchar)) as study, concat(participant_id, '_s', cast(block_index % 3 as varchar)) as participant_id, source_row from trials")
def io_indexed_design(df):
    named = df.drop("study").withColumn("participant_id", F.concat("participant_id", F.lit("_s"), (F.col("block_index") % 3).cast("string")))
    return io.indexed_design(named)


@query("trials_ev", "table:s n_rows n_columns columns:s", """
select 'trials' as "table", count(*) as n_rows, 2 as n_columns, 'participant_id,rt' as columns from trials union all select 'errors', count(*), 1, 'source_row' from trials where not correct""")
def io_table_manifest(df):
    return io.table_manifest({"trials": df.select("participant_id", "rt"), "errors": df.where("not correct").select("source_row")})


CANON = "canon as (select *, lag(cong) over w as cp, lag(correct) over w as cc from trials window w as (partition by participant_id order by study, block_index, trial_index, source_row))"


@query("trials_li", "study:s participant_id:s rows missing_rt nonpositive_rt prev_cong_mismatch prev_correct_mismatch missing_prev_cong min_cell_n complete_four_cells:b prev_cong_mismatch_rate:d", f"""
with {CANON}, x as (select study, participant_id, count(*) as rows, count(case when rt is null then 1 end) as missing_rt, count(case when rt <= 0 then 1 end) as nonpositive_rt, count(case when prev_cong is distinct from cp then 1 end) as prev_cong_mismatch,
  count(case when prev_correct is distinct from cc then 1 end) as prev_correct_mismatch, count(case when prev_cong is null then 1 end) as missing_prev_cong, {least_sql()} as min_cell_n from canon group by all)
select *, min_cell_n > 0 as complete_four_cells, prev_cong_mismatch / rows as prev_cong_mismatch_rate from x""")
def audit_previous(df):
    return audit.previous_audit(df)


@query("trials_ev", "study:s rows participants complete_participants prev_cong_mismatch_rate:d missing_prev_cong_rate:d min_cell_n median_cell_n:d", f"""
with {CANON}, x as (select study, participant_id, count(*) as rows, count(case when prev_cong is distinct from cp then 1 end) as mm, count(case when prev_cong is null then 1 end) as mp, {least_sql()} as m from canon group by all)
select study, sum(rows) as rows, count(*) as participants, count(case when m > 0 then 1 end) as complete_participants, sum(mm) / sum(rows) as prev_cong_mismatch_rate, sum(mp) / sum(rows) as missing_prev_cong_rate, min(m) as min_cell_n, median(m) as median_cell_n from x group by study""")
def audit_design_inventory(df):
    return audit.design_inventory(df)


LONG = " union all ".join(f"select '{c}' as col, study, cast({c} as varchar) as v from trials" for c in ("cong", "prev_cong", "study", "participant_id"))


@query("trials_ev", "column:s rows n_missing missing_rate:d n_distinct studies_present examples:s", f"""
with l as ({LONG}), d as (select distinct col, v from l where v is not null), e as (select col, v, row_number() over (partition by col order by v) as nth from d)
select l.col as "column", count(*) as rows, count(case when v is null then 1 end) as n_missing, count(case when v is null then 1 end) / count(*) as missing_rate, (select count(*) from d where d.col = l.col) as n_distinct,
  count(distinct case when v is not null then study end) as studies_present, (select string_agg(v, '; ' order by v) from e where e.col = l.col and nth <= 5) as examples from l group by l.col""")
def audit_column_inventory(df):
    return audit.column_inventory(df, ["cong", "prev_cong", "study", "participant_id"])


@query("trials_ev", "confound:s columns:s column:s status:s n_columns n_present missing_rate:d worst_rate:d risk:s", """
with k(confound, columns, c, held, fixed) as (values
  ('previous congruency', 'prev_cong', 'prev_cong', 'available_but_recompute_required', false), ('previous accuracy/post-error slowing', 'prev_correct', 'prev_correct', 'available_but_recompute_required', false),
  ('current accuracy filtering', 'correct', 'correct', 'available', false), ('trial index/fatigue/practice trend', 'trial_index; is_practice', 'trial_index', 'available', false),
  ('block effects', 'block_index; name; condition', 'block_index', 'available_study_specific', false), ('practice trials', 'is_practice; name', 'is_practice', 'available_study_sparse', false),
  ('stimulus identity/repetition', '', null, 'insufficient', true), ('response identity/repetition', '', null, 'missing', true), ('feature/event-file integration', '', null, 'missing', true),
  ('contingency learning/item-specific proportion congruency', '', null, 'missing', true), ('study-specific affect/conflict condition', 'condition; congruency; name', 'condition', 'available_study_sparse', true)),
t as (select *, case when source_row % 3 > 0 then prev_correct end as thin, case when source_row % 3 = 0 then block_index end as bare from trials),
m as (select 'prev_cong' as c, count(*) filter (where prev_cong is null) / count(*) as r from t union all select 'correct', count(*) filter (where correct is null) / count(*) from t
  union all select 'trial_index', count(*) filter (where trial_index is null) / count(*) from t union all select 'prev_correct', count(*) filter (where thin is null) / count(*) from t
  union all select 'block_index', count(*) filter (where bare is null) / count(*) from t union all select 'name', 0),
e as (select confound, count(*) as n_present, max(r) as worst_rate from (select confound, unnest(string_split(columns, '; ')) as c from k) u join m using (c) group by confound),
s as (select k.*, r, worst_rate, coalesce(n_present, 0) as n_present, case when columns = '' then 0 else len(string_split(columns, '; ')) end as n_columns, case when fixed or r is not null then held else 'missing' end as status from k left join m using (c) left join e using (confound))
select confound, columns, c as "column", status, n_columns, n_present, r as missing_rate, worst_rate, case when n_present = 0 then 'nothing measured on ' || confound when r is null then c || ' not there, ' || n_present || ' other column(s)'
  else case when r <= 0.01 then 'can be conditioned on: ' when r <= 0.5 then 'conditioning loses rows: ' else 'mostly unknown: ' end || cast(round(r * 100, 1) as double) || '% of rows lack ' || c end as risk from s""")
def audit_confound_risk(df):
    odd = df.withColumns({"prev_correct": F.when(F.col("source_row") % 3 > 0, F.col("prev_correct")), "block_index": F.when(F.col("source_row") % 3 == 0, F.col("block_index")), "name": F.lit("x")})
    return audit.confound_risk(audit.column_inventory(odd, ["prev_cong", "correct", "trial_index", "prev_correct", "block_index", "name"]))


@query("trials_li", "outlier:s data_id:s n_rows rt:d", """
select study as outlier, concat(study, '_', participant_id) as data_id, count(*) as n_rows, sum(case when study in ('s1', 's3') then rt + 1 else rt end) as rt from trials group by all""")
def io_branches_again(df):
    """Every participant's trials as a branch, written, and those of two studies written again with other times: one copy of each is left."""
    path = scratch(df.sparkSession)
    rows = df.select("participant_id", "rt", F.col("study").alias("outlier"), F.lit("none").alias("strip_method"), F.concat_ws("_", "study", "participant_id").alias("data_id"))
    io.write_branches(rows, path)
    io.write_branches(rows.where("outlier in ('s1', 's3')").withColumn("rt", F.col("rt") + 1), path)
    return io.read_branch(df.sparkSession, path, ["rt", "data_id"], ["outlier", "data_id", "rt"]).groupBy("outlier", "data_id").agg(F.count("*").alias("n_rows"), F.sum("rt").alias("rt"))


@query("trials_ev", "participant_id:s n_rows cong prev_cong rt:d", """
select participant_id, count(*) as n_rows, sum(cong) as cong, sum(prev_cong) as prev_cong, sum(round(rt, 3)) as rt from trials group by participant_id""")
def io_read_trials(df):
    """The trials written as text and read again, with their tokens for missing values."""
    path = scratch(df.sparkSession)
    io.write_tables({"trials": df.select("participant_id", "cong", F.coalesce(F.col("prev_cong").cast("string"), F.lit("NA")).alias("prev_cong"), F.round("rt", 3).alias("rt")), "nothing": df.where("false")}, path)
    back = io.normalize_types(io.read_trials(df.sparkSession, f"{path}/trials"))
    return back.groupBy("participant_id").agg(F.count("*").alias("n_rows"), F.sum("cong").alias("cong"), F.sum("prev_cong").alias("prev_cong"), F.sum("rt").alias("rt"))


@query("trials_ev", "check:s n_bad examples:s", f"""
with d as (select participant_id, source_row, trial_index, cong, case when source_row % 50 = 0 then 3 else prev_cong end as prev_cong, rt - 20 as rt from trials),
cells as (select participant_id, {least_sql(" and rt is not null")} as m from d group by 1),
ord as (select participant_id, trial_index < lag(trial_index) over (partition by participant_id order by source_row) as bad from d),
x as (select 'codes_prev_cong' as "check", (select count(*) from d where prev_cong is not null and prev_cong not in (-1, 1)) as n_bad, '3' as examples
  union all select 'rt_nonpositive', (select count(*) from d where rt <= 0), '' union all select 'rt_slow', (select count(*) from d where rt > 5000), ''
  union all select 'trial_order', (select count(*) from (select participant_id from ord group by 1 having bool_or(bad)) q), '' union all select 'cells', (select count(*) from cells where m < 5), ''
  union all select 'log_rt_undefined', (select count(*) from d where rt <= 0), '')
select * from x where n_bad > 0""")
def audit_validate(df):
    odd = df.withColumns({"prev_cong": F.when(F.col("source_row") % 50 == 0, 3).otherwise(F.col("prev_cong")), "rt": F.col("rt") - 20})
    return audit.validate_trials(odd, min_cell=5, log_rt=True)


# --- grid ----------------------------------------------------------------------------------------------------------------

SMALL = grid.Grid(fractions=(0.15, 0.5, 1.0), samples=4)
SAMPLES = "(select * from (values (0.15, '0.15', 0), (0.5, '0.5', 4)) f(sample_size, sample, first), (select unnest(range(1, 5)) as subsample_id) i union all select 1.0, '1', 8, 1)"
VARIANTS = "(values ('present', 'none', 0), " + ", ".join(f"('null_interaction', '{s}', {i + 1})" for i, s in enumerate(grid.STRIPS)) + ") v(effect_condition, strip_method, v_at)"


def values_sql(name: str, values: tuple) -> str:
    return "(values " + ", ".join(f"('{v}', {i})" for i, v in enumerate(values)) + f") {name}({name}, {name}_at)"


BRANCHES = f"""select (((cast(first + subsample_id - 1 as bigint) * 2 + transformation_at) * 10 + outlier_at) * 6 + v_at) * 4 + model_at + 1 as branch_idx, sample_size, subsample_id, transformation, outlier, model, effect_condition, strip_method,
  concat_ws('__', sample, subsample_id, transformation, outlier, model, effect_condition, strip_method) as branch_id, concat_ws('__', sample, subsample_id, transformation, outlier, effect_condition, strip_method) as data_id
from {SAMPLES} s, {values_sql('transformation', grid.TRANSFORMS)}, {values_sql('outlier', grid.OUTLIERS)}, {values_sql('model', grid.MODELS)}, {VARIANTS}"""


def branches_of(df: DataFrame) -> DataFrame:
    """The grid's branches for every study in the data, so that the table grows with what is planned for."""
    return grid.model_branches(df.sparkSession, SMALL).crossJoin(F.broadcast(df.select("study").distinct()))


@query("trials_li", "study:s branch_idx branch_id:s data_id:s sample_size:d subsample_id transformation:s outlier:s model:s effect_condition:s strip_method:s", f"select s.study, b.* from ({BRANCHES}) b, (select distinct study from trials) s")
def grid_branches(df):
    return branches_of(df)


@query("trials_li", "study:s branch_id:s data_id:s sample_size:d subsample_id outlier:s strip_method:s", f"""
select study, branch_id, data_id, sample_size, subsample_id, outlier, strip_method from ({BRANCHES}) b, (select distinct study from trials) s where branch_idx % 3 <> 0""")
def grid_pending_and_ids(df):
    every = branches_of(df)
    left = grid.pending(every, every.where("branch_idx % 3 = 0"))
    parsed = grid.parse_data_id(left.select("study", "branch_id", grid.data_id_of(F.col("branch_id")).alias("data_id")))
    return parsed.withColumn("strip_method", grid.normalized(F.upper("strip_method"), "strip_method"))


CONTRACT = f"""with b as (select study, b.* from ({BRANCHES}) b, (select distinct study from trials) s where not (study = 's2' and branch_idx % 7 = 0)),
p as (select * replace (case when study = 's4' and effect_condition = 'null_interaction' and branch_idx % 13 = 0 then 'none' else strip_method end as strip_method) from b union all select * from b where study = 's3' and branch_idx % 11 = 0),
i as (select study, count(case when k > 1 then 1 end) as repeated_ids from (select study, branch_id, count(*) as k from p group by all) q group by study),
c as (select study, count(case when (effect_condition = 'present') <> (strip_method = 'none') then 1 end) as labels, abs(count(*) - 4320) as rows, abs(count(distinct data_id) - 1080) as data_ids from p group by study)
select study, unnest(['labels', 'rows', 'data_ids', 'repeated_ids']) as rule, unnest([labels, rows, data_ids, repeated_ids]) as n_bad from c join i using (study)"""


@query("trials_li", "study:s rule:s n_bad", CONTRACT, name="grid_contract_studies")
@query("trials_li", "study:s rule:s n_bad", CONTRACT)
def grid_contract(df):
    """The contract of a whole grid, for every study; three studies' branches are lost, repeated or mislabelled in part."""
    of = lambda study, k: (F.col("study") == study) & (F.col("branch_idx") % k == 0)
    held = branches_of(df).where(~of("s2", 7))
    mislabelled = of("s4", 13) & (F.col("effect_condition") == "null_interaction")
    every = held.withColumn("strip_method", F.when(mislabelled, "none").otherwise(F.col("strip_method"))).unionByName(held.where(of("s3", 11)))
    return audit.branch_contract(every, 9, 2, 10, 6, 4, by=["study"])


@query("trials_li", "study:s expected present missing n_problem", f"""
select study, count(*) as expected, count(case when branch_idx % 5 = 0 then 1 end) as present, count(case when branch_idx % 5 <> 0 then 1 end) as missing, 0 as n_problem from ({BRANCHES}) b, (select distinct study from trials) s group by study""", name="grid_coverage_studies")
@query("trials_li", "study:s expected present missing n_problem", f"""
select study, count(*) as expected, count(case when branch_idx % 5 = 0 then 1 end) as present, count(case when branch_idx % 5 <> 0 then 1 end) as missing, 0 as n_problem from ({BRANCHES}) b, (select distinct study from trials) s group by study""")
def grid_coverage(df):
    """How much of the grid is done, for every study."""
    every = branches_of(df)
    done = every.where("branch_idx % 5 = 0")
    problems = audit.attach_data_id(done.drop("data_id"), every, by=["study"]).groupBy("study").agg(F.count("id_problem").alias("n_problem"))
    return audit.branch_coverage(every, done, by=["study"]).join(problems, "study", "left").withColumn("n_problem", F.coalesce("n_problem", F.lit(0)))


@query("trials_ev", "study:s strategy_id:s operator:s outcome_scale:s formula_full:s formula_null:s n_variances usable_if:s n_rows n_participants", """
with f(name, operator, random, n_variances, usable_if) as (values ('rmanova', 'rmanova', 'Error(participant_id / (cong * prev_cong))', 0, 'n_complete'), ('cell_mean_t', 'cell_mean_t', 'Error(participant_id / (cong * prev_cong))', 0, 'n_complete'),
  ('participant_fe', 'participant_fe_lm', 'participant_id', 0, 'df > 0'), ('lmm_intercept', 'mixed_models', '(1 | participant_id)', 1, 'full_converged and not full_is_singular'),
  ('lmm_cong_slope', 'mixed_models', '(1 + cong | participant_id)', 3, 'full_converged and not full_is_singular'), ('lmm_full_slope', 'mixed_models', '(1 + cong * prev_cong | participant_id)', 10, 'full_converged and not full_is_singular')),
t as (select study, participant_id, unnest(['rt', 'log_rt']) as outcome_scale, unnest([true, rt - 20 > 0]) as fine from trials where rt is not null and cong is not null and prev_cong is not null),
c as (select study, outcome_scale, count(case when fine then 1 end) as n_rows, count(distinct case when fine then participant_id end) as n_participants from t group by all)
select study, name || '__' || outcome_scale as strategy_id, 'models.' || operator as operator, outcome_scale, case outcome_scale when 'rt' then 'rt' else 'ln(rt)' end || ' ~ cong * prev_cong + ' || random as formula_full,
  case outcome_scale when 'rt' then 'rt' else 'ln(rt)' end || ' ~ cong + prev_cong + ' || random as formula_null, n_variances, usable_if, n_rows, n_participants from f, c""")
def grid_strategies(df):
    return grid.planned_strategies(df.withColumn("rt", F.col("rt") - 20), ["study"])


# --- nullifiers ----------------------------------------------------------------------------------------------------------

BINNED = "binned as (select *, least(cast(floor((row_number() over (partition by participant_id order by trial_index, source_row) - 1) * 4 / count(*) over (partition by participant_id)) as bigint), 3) as bin from trials)"


def residual_sql(agg: str) -> str:
    beta = f"case when {least_sql(' and rt is not null')} >= 5 then {contrast_sql(agg)} / 4 end"
    return f"""with {BINNED}, b as (select participant_id, bin, {beta} as beta from binned group by all), p as (select participant_id, {beta} as beta from binned group by all)
select source_row, participant_id, case when cong is null or prev_cong is null then rt else rt - coalesce(b.beta, p.beta, 0) * cong * prev_cong end as rt from binned join b using (participant_id, bin) join p using (participant_id)"""


for of in ("ev", "li"):
    for kind, agg in (("mean", "avg"), ("median", "median")):
        query(f"trials_{of}", "source_row participant_id:s rt:f", residual_sql(agg), name=f"nullify_local_{kind}_{of}")(nullify.METHODS[f"local_{kind}_residual"])

SHUFFLE = """good as (select * from trials where rt is not null and cong is not null and prev_cong is not null),
a as (select *, row_number() over (partition by participant_id, cong order by source_row) as nth from good),
d as (select participant_id, cong, list(rt order by md5(concat_ws('|', '42', cast(source_row as varchar))), source_row) as rts from good group by participant_id, cong),
shuffled as (select a.* exclude (rt, nth), d.rts[a.nth] as rt from a join d using (participant_id, cong) union all by name select * from trials where rt is null or cong is null or prev_cong is null)"""


@query("trials_li", "source_row participant_id:s cong rt:d", f"with {SHUFFLE} select * from shuffled")
def nullify_shuffle(df):
    return nullify.shuffle(df)


def type8_sql(arr: str, p: str) -> str:
    """Type-8 quantile of a sorted list, as SQL."""
    h = f"((len({arr}) + 1.0/3) * ({p}) + 1.0/3)"
    low = f"least(greatest(cast(floor({h}) as bigint), 1), len({arr}))"
    return f"({arr}[{low}] + greatest(least({h} - {low}, 1.0), 0.0) * ({arr}[least({low} + 1, len({arr}))] - {arr}[{low}]))"


def grid_sql(arr: str, tau: str) -> str:
    at, right = f"({tau} * 199)", f"greatest(least(cast(ceil({tau} * 199) as bigint), 199), 1)"
    low, high = type8_sql(arr, f"({right} - 1) / 199.0"), type8_sql(arr, f"{right} / 199.0")
    return f"({low} + ({at} - ({right} - 1)) * ({high} - {low}))"


QMAP = f"""good as (select * from trials where rt is not null and cong is not null and prev_cong is not null),
t as (select *, cume_dist() over (partition by participant_id, cong, prev_cong order by rt) as tau, count(*) over (partition by participant_id, cong, prev_cong) as nc, count(*) over (partition by participant_id) as na from good),
r as (select participant_id, cong, list(rt order by rt) as r from good group by all), c as (select participant_id, prev_cong, list(rt order by rt) as c from good group by all), g as (select participant_id, list(rt order by rt) as g from good group by all)
select source_row, participant_id, case when na < 2 then rt else {grid_sql('r', 'tau')} + {grid_sql('c', 'tau')} - {grid_sql('g', 'tau')} end as rt from t join r using (participant_id, cong) join c using (participant_id, prev_cong) join g using (participant_id) where nc >= 2"""


# as QMAP, with every trial: in a cell of one, tau is read off the cell's curve over everyone; trials without a code or time pass through
QMAP_WHOLE = QMAP[: QMAP.index("select source_row")] + f""", o as (select cong, prev_cong, list(rt order by rt) as o from good group by all), y as (select cong, prev_cong, [{', '.join(type8_sql('o', f'{k} / 199.0') for k in range(200))}] as y from o),
s as (select t.* exclude (tau), y, tau as own_tau, len(list_filter(y, lambda v: v < rt)) as before from t join y using (cong, prev_cong)),
u as (select s.* exclude (y, own_tau, before), case when nc >= 2 then own_tau when rt <= y[1] then 0 when rt >= y[200] then 1
  else (before - 1 + case when y[before + 1] - y[before] < 2.2e-16 then 0 else (rt - y[before]) / (y[before + 1] - y[before]) end) / 199 end as tau from s)
select source_row, participant_id, case when na < 2 then rt else {grid_sql('r', 'tau')} + {grid_sql('c', 'tau')} - {grid_sql('g', 'tau')} end as rt from u join r using (participant_id, cong) join c using (participant_id, prev_cong) join g using (participant_id)
union all select source_row, participant_id, rt from trials where rt is null or cong is null or prev_cong is null"""


@query("trials_li", "source_row participant_id:s rt:f", f"with {QMAP_WHOLE}", name="nullify_qmap_whole")
@query("trials_li", "source_row participant_id:s rt:f", f"with {QMAP_WHOLE}")
def nullify_qmap(df):
    """Every trial, those of cells of one too."""
    return nullify.additive_qmap(df)


@query("trials_ev", "source_row participant_id:s rt:f", f"with {QMAP_WHOLE}")
def nullify_qmap_sparse(df):
    return nullify.additive_qmap(df)


def binned_qmap_sql() -> str:
    """The map within rich trial bins (five trials in each cell), else over the whole participant."""
    keys = "participant_id, bin"
    return f"""with {BINNED}, rich as (select * from binned join (select participant_id, bin from binned group by all having {least_sql(' and rt is not null')} >= 5) q using (participant_id, bin) where rt is not null and cong is not null and prev_cong is not null and trial_index is not null),
lt as (select *, cume_dist() over (partition by {keys}, cong, prev_cong order by rt) as tau from rich), lr as (select {keys}, cong, list(rt order by rt) as r from rich group by {keys}, cong),
lc as (select {keys}, prev_cong, list(rt order by rt) as c from rich group by {keys}, prev_cong), lg as (select {keys}, list(rt order by rt) as g from rich group by {keys}),
near as (select source_row, participant_id, {grid_sql('r', 'tau')} + {grid_sql('c', 'tau')} - {grid_sql('g', 'tau')} as rt from lt join lr using ({keys}, cong) join lc using ({keys}, prev_cong) join lg using ({keys})),
far as (with {QMAP_WHOLE}) select source_row, participant_id, coalesce(near.rt, far.rt) as rt from far left join near using (source_row, participant_id)"""


@query("trials_li", "source_row participant_id:s rt:f", binned_qmap_sql())
def nullify_qmap_trial_bin(df):
    return nullify.additive_qmap_trial_bin(df)


@query("trials_li", "participant_id:s bin n first_trial", f"with {BINNED} select participant_id, bin, count(*) as n, min(trial_index) as first_trial from binned group by all")
def nullify_trial_bins(df):
    return nullify.trial_bins(df).groupBy("participant_id", "bin").agg(F.count("*").alias("n"), F.min("trial_index").alias("first_trial"))


@query("trials_li", "strip_method:s n rt:d", f"""
select 'none' as strip_method, count(*) as n, avg(rt) as rt from trials union all select 'local_mean_residual', count(*), avg(rt) from ({residual_sql('avg')}) union all select 'local_median_residual', count(*), avg(rt) from ({residual_sql('median')})""")
def nullify_all_effects(df):
    methods = ("none", "local_mean_residual", "local_median_residual")
    return nullify.long_effects(nullify.all_effects(df, methods), methods).groupBy("strip_method").agg(F.count("*").alias("n"), F.avg("rt").alias("rt"))


@query("trials_li", "participant_id:s q05:d q50:d q95:d place:d share:d", f"""
with a as (select participant_id, list(rt order by rt) as v, avg(rt) as m from trials where rt is not null group by 1), q as (select *, {type8_sql('v', '0.05')} as q05, {type8_sql('v', '0.5')} as q50, {type8_sql('v', '0.95')} as q95, len(list_filter(v, lambda x: x < m)) as k from a)
select participant_id, q05, q50, q95, case when m <= v[1] then 0 when m >= v[-1] then 1 else (k - 1 + case when v[least(k + 1, len(v))] - v[k] < 2.220446049250313e-16 then 0 else (m - v[k]) / (v[least(k + 1, len(v))] - v[k]) end) / (len(v) - 1) end as place,
  len(list_filter(v, lambda x: x <= m)) / len(v) as share from q""")
def quantile_helpers(df):
    from specgrid.functions.quantile import ecdf

    got = df.where("rt is not null").groupBy("participant_id").agg(F.array_sort(F.collect_list("rt")).alias("v"), F.avg("rt").alias("m"))
    v, m = F.col("v"), F.col("m")
    return got.select("participant_id", *(quantile_type8(v, p).alias(n) for n, p in (("q05", 0.05), ("q50", 0.5), ("q95", 0.95))), inverse_on_grid(v, m).alias("place"), ecdf(v, m).alias("share"))


# --- sampling, rules, models ------------------------------------------------------------------------------------------

MEMBERS = """people as (select distinct participant_id from trials), sample(sample_size, sample, subsample_id) as (values (0.25, '0.25', 1), (0.25, '0.25', 2), (0.25, '0.25', 3), (0.5, '0.5', 1), (0.5, '0.5', 2), (0.5, '0.5', 3), (1.0, '1', 1)),
ranked as (select s.*, participant_id, row_number() over (partition by sample, subsample_id order by md5(concat_ws('|', '42', sample, cast(subsample_id as varchar), participant_id)), participant_id) as rk, (select count(*) from people) as p from people, sample s),
members as (select sample_size, sample, subsample_id, participant_id from ranked where rk <= ceil(p * sample_size))"""


def samples_of(df: DataFrame) -> DataFrame:
    return grid.base_samples(df.sparkSession, (0.25, 0.5, 1.0), 3)


@query("trials_li", "sample_size:d subsample_id participant_id:s", f"with {MEMBERS} select * from members")
def sampling_membership(df):
    return sampling.membership(df, samples_of(df))


RULES = ("none", "sd_2", "sd_2.5", "mad_2", "mad_2.5", "range_1000", "range_1250", "range_1500")
FENCES = """base as (select study, avg(rt) as m, coalesce(stddev_samp(rt), 0) as s, median(rt) as med from trials group by study), madv as (select study, median(abs(rt - med)) as mad from trials join base using (study) group by study),
fences as (select study, unnest(['none', 'sd_2', 'sd_2.5', 'mad_2', 'mad_2.5', 'range_1000', 'range_1250', 'range_1500']) as outlier,
  unnest([null, m - 2 * s, m - 2.5 * s, med - 2 * mad, med - 2.5 * mad, 200, 200, 200]) as lo, unnest([null, m + 2 * s, m + 2.5 * s, med + 2 * mad, med + 2.5 * mad, 1000, 1250, 1500]) as hi from base join madv using (study))"""


@query("trials_li", "study:s outlier:s lo:d hi:d", f"with {FENCES} select * from fences")
def outlier_fences(df):
    return sampling.fences(df, ["study"], RULES)


@query("trials_li", "study:s outlier:s n_rows_in n_rows_out n_removed mean_log:d success:b", f"""
with {FENCES}, n as (select study, count(*) as n_in from trials group by study)
select f.study, f.outlier, n_in as n_rows_in, count(case when f.outlier = 'none' or rt between lo and hi then 1 end) as n_rows_out, n_in - count(case when f.outlier = 'none' or rt between lo and hi then 1 end) as n_removed,
  avg(case when rt > 0 and (f.outlier = 'none' or rt between lo and hi) then ln(rt) end) as mean_log, count(case when f.outlier = 'none' or rt between lo and hi then 1 end) > 0 as success
from fences f join trials t using (study) join n using (study) group by f.study, f.outlier, n_in""")
def outlier_branch_counts(df):
    bounds = saved(sampling.fences(df, ["study"], RULES))
    # a row for each study and rule; a trial is repeated for the rules once, for counts and logs together
    kept = df.join(F.broadcast(bounds), "study").where(sampling.inside(F.col("rt"), F.col("outlier"), F.col("lo"), F.col("hi")))
    logs = F.avg(F.when(F.col("rt") > 0, F.log("rt"))).alias("mean_log")
    return io.branch_metadata(sampling.branch_counts(bounds.select("study", "outlier"), kept, df, ["study", "outlier"], [logs]))


@query("trials_li", "n rt:d lo:d", "with b as (select avg(rt) - 2 * stddev_samp(rt) as lo, avg(rt) + 2 * stddev_samp(rt) as hi from trials) select count(*) as n, avg(rt) as rt, min(rt) as lo from trials, b where rt between b.lo and b.hi")
def outlier_apply_rule(df):
    return sampling.apply_rule(df, "sd_2").agg(F.count("*").alias("n"), F.avg("rt").alias("rt"), F.min("rt").alias("lo"))


T_SQL = """select {keys} count(z) as n_complete, count(*) - count(z) as n_dropped, avg(z) as estimate, stddev_samp(z) / sqrt(count(z)) as std_error, avg(z) / (stddev_samp(z) / sqrt(count(z))) as t, (avg(z) / (stddev_samp(z) / sqrt(count(z)))) ** 2 as f, count(z) - 1 as df2 from w {group}"""
MODEL_ROWS = "rt is not null and rt > 0 and cong in (-1, 1) and prev_cong in (-1, 1)"


@query("trials_li", "study:s n_complete n_dropped n_obs estimate:d std_error:d t:d f:d df2 ges:d", f"""
with m as (select study, participant_id, {', '.join(f"avg(case when cong = {c} and prev_cong = {p} then rt end) as m{i}" for i, (c, p) in enumerate(CELLS))}, count(*) as n from trials where {MODEL_ROWS} group by all),
w as (select *, m0 - m1 - m2 + m3 as z, m0 + m1 - m2 - m3 as a, m0 - m1 + m2 - m3 as b, m0 + m1 + m2 + m3 as s from m),
g as (select study, count(z) as n_complete, count(*) - count(z) as n_dropped, sum(case when z is not null then n end) as n_obs, avg(z) as estimate, stddev_samp(z) / sqrt(count(z)) as std_error,
  (count(z) - 1) * (var_samp(case when z is not null then a end) + var_samp(case when z is not null then b end) + var_samp(case when z is not null then s end) + var_samp(z)) / 4 as errors, count(z) * avg(z) ** 2 / 4 as effect from w group by study)
select *, estimate / std_error as t, (estimate / std_error) ** 2 as f, n_complete - 1 as df2, effect / (effect + errors) as ges from g""")
def model_rmanova(df):
    return models.rmanova(models.suff_stats(df, ["study"]), ["study"])


@query("trials_li", "study:s scale:s n_complete estimate:d t:d error:b", f"""
with s as (select study, participant_id, cong, prev_cong, 'raw' as scale, rt as y from trials where {MODEL_ROWS} union all select study, participant_id, cong, prev_cong, 'log', ln(rt) from trials where {MODEL_ROWS}),
w as (select study, scale, participant_id, {contrast_sql('avg', 'y')} as z from s group by all)
select study, scale, count(z) as n_complete, avg(z) as estimate, avg(z) / (stddev_samp(z) / sqrt(count(z))) as t, false as error from w group by all""")
def model_cell_mean_t(df):
    return models.cell_mean_t(df, ["study"])


@query("trials_li", "study:s n_obs n_participants estimate:d std_error:d t:d df", f"""
with d as (select study, participant_id, rt as y, cong / 2.0 as c, prev_cong / 2.0 as p, cong * prev_cong / 4.0 as i from trials where {MODEL_ROWS}),
k as (select study, y - avg(y) over w as y, c - avg(c) over w as c, p - avg(p) over w as p, i - avg(i) over w as i, participant_id from d window w as (partition by study, participant_id)),
s as (select study, count(*) as n, count(distinct participant_id) as np, sum(c*c) as cc, sum(c*p) as cp, sum(c*i) as ci, sum(p*p) as pp, sum(p*i) as pi, sum(i*i) as ii, sum(c*y) as bc, sum(p*y) as bp, sum(i*y) as bi, sum(y*y) as yy from k group by study),
e as (select *, cc*(pp*ii-pi*pi) - cp*(cp*ii-pi*ci) + ci*(cp*pi-pp*ci) as det from s),
o as (select *, ((pp*ii-pi*pi)*bc + (ci*pi-cp*ii)*bp + (cp*pi-ci*pp)*bi)/det as e0, ((ci*pi-cp*ii)*bc + (cc*ii-ci*ci)*bp + (ci*cp-cc*pi)*bi)/det as e1, ((cp*pi-ci*pp)*bc + (ci*cp-cc*pi)*bp + (cc*pp-cp*cp)*bi)/det as e2 from e)
select study, n as n_obs, np as n_participants, e2 as estimate, sqrt((yy-e0*bc-e1*bp-e2*bi)/(n-np-3)*(cc*pp-cp*cp)/det) as std_error, e2 / sqrt((yy-e0*bc-e1*bp-e2*bi)/(n-np-3)*(cc*pp-cp*cp)/det) as t, n-np-3 as df from o""")
def model_participant_fe(df):
    return models.participant_fe_lm(models.suff_stats(df, ["study"]), ["study"])


@query("trials_ev", "study:s model:s n_obs n_participants main_estimate:d main_std_error:d df:d main_p_value:d residual_var:d LR_stat:d LR_p:d AIC_diff:d full_is_singular:b full_converged:b fallback_level:s error:b")
def model_mixed(df):
    return models.mixed_models(models.suff_stats(df, ["study"]), ["study"])


BALANCED_CELL = 5


@query("trials_li", "study:s n_obs n_participants main_estimate:d main_std_error:d main_t_stat:d residual_sd:d random_intercept_sd:d full_is_singular:b", f"""
with placed as (select study, participant_id, cong, prev_cong, rt, row_number() over (partition by participant_id, cong, prev_cong order by source_row) as place from trials where {MODEL_ROWS}),
few as (select *, count(*) over (partition by participant_id) as own from placed where place <= {BALANCED_CELL}), even as (select * from few where own = {4 * BALANCED_CELL}),
cells as (select study, cong, prev_cong, avg(rt) as m from even group by all), persons as (select study, participant_id, avg(rt) as m from even group by all),
whole as (select study, count(*) as n, count(distinct participant_id) as p, avg(rt) as m from even group by study),
fixed as (select study, sum(case when cong = prev_cong then m else -m end) as estimate from cells group by study),
total as (select study, sum((rt - cells.m) * (rt - cells.m)) as within from even join cells using (study, cong, prev_cong) group by study),
between as (select study, {4 * BALANCED_CELL} * sum((persons.m - whole.m) * (persons.m - whole.m)) as ssb from persons join whole using (study) group by study),
v as (select study, n, p, estimate, ssb / (p - 1) as msb, (within - ssb) / (n - p - 3) as mse, within / (n - 4) as pooled from whole join fixed using (study) join total using (study) join between using (study))
select study, n as n_obs, p as n_participants, estimate as main_estimate, round(4 * sqrt(case when msb > mse then mse else pooled end / n), 4) as main_std_error,
  round(estimate / (4 * sqrt(case when msb > mse then mse else pooled end / n)), 5) as main_t_stat, round(sqrt(case when msb > mse then mse else pooled end), 4) as residual_sd,
  round(sqrt(case when msb > mse then (msb - mse) / {4 * BALANCED_CELL} else 0 end), 2) as random_intercept_sd, msb <= mse as full_is_singular from v""")
def model_mixed_balanced(df):
    """The random-intercept model where every participant has as many trials in each cell: there it has a closed form."""
    own = Window.partitionBy("participant_id", "cong", "prev_cong").orderBy("source_row")
    few = models.model_rows(df).withColumn("place", F.row_number().over(own)).where(F.col("place") <= BALANCED_CELL)
    even = few.withColumn("own", F.count("*").over(Window.partitionBy("participant_id"))).where(F.col("own") == 4 * BALANCED_CELL)
    fits = models.mixed_models(models.suff_stats(even, ["study"]), ["study"], ("lmm_intercept",))
    places = {"main_std_error": ("main_std_error", 4), "main_t_stat": ("main_t_stat", 5), "residual_sd": (F.sqrt("residual_var"), 4), "random_intercept_sd": (F.sqrt("random_intercept_var"), 2)}
    return fits.withColumns({k: F.round(c, n) for k, (c, n) in places.items()})


@query("trials_li", "study:s n_terms term:s estimate:d error:b", """
with m as (select study, avg(rt) as m from trials group by study),
t as (select study, unnest(['cong1', 'prev_cong1', 'cong1:prev_cong1', 'cong1:trial', 'prev_cong[S.1]:cong[S.1]', 'congruent:prev_cong1']) as term, m * unnest([2, 3, 1, 4, 5, 6]) as estimate from m),
k as (select * from t where not (study = 's1' and term in ('cong1:prev_cong1', 'prev_cong[S.1]:cong[S.1]')) and not (study in ('s0', 's3') and term = 'prev_cong[S.1]:cong[S.1]') and not (study = 's4' and term = 'cong1:prev_cong1')),
h as (select *, regexp_full_match(term, '(cong([0-9.+-]|\\[.*\\])*:prev_cong([0-9.+-]|\\[.*\\])*)|(prev_cong([0-9.+-]|\\[.*\\])*:cong([0-9.+-]|\\[.*\\])*)') as hit from k)
select study, count(case when hit then 1 end) as n_terms, case when count(case when hit then 1 end) = 1 then min(case when hit then term end) end as term, case when count(case when hit then 1 end) = 1 then min(case when hit then estimate end) end as estimate,
  count(case when hit then 1 end) > 1 as error from h group by study""")
def model_select_interaction(df):
    """One hit, none and several: the studies' fits lack different terms."""
    means = df.groupBy("study").agg(F.avg("rt").alias("m"))
    a, b = "cong1:prev_cong1", "prev_cong[S.1]:cong[S.1]"
    every = (("cong1", 2), ("prev_cong1", 3), (a, 1), ("cong1:trial", 4), (b, 5), ("congruent:prev_cong1", 6))
    terms = means.select("study", F.inline(F.array(*(F.struct(F.lit(t).alias("term"), (F.col("m") * k).alias("estimate")) for t, k in every))))
    lacking = {"s0": (b,), "s1": (a, b), "s3": (b,), "s4": (a,)}
    for study, gone in lacking.items():
        terms = terms.where(~((F.col("study") == study) & F.col("term").isin(*gone)))
    return models.select_interaction(terms, ["study"])


# --- the grid, end to end ----------------------------------------------------------------------------------------------

GRID_RULES = ("none", "sd_2", "range_1500")


@query("trials_li", "sample_size:d subsample_id strip_method:s transformation:s outlier:s n_complete estimate:d t:d df2", f"""
with {MEMBERS}, eff as (select *, 'none' as strip_method from trials union all by name select t.* exclude (rt), r.rt, 'local_mean_residual' as strip_method from trials t join ({residual_sql('avg')}) r using (source_row)),
drawn as (select e.*, m.sample_size, m.sample, m.subsample_id from eff e join members m using (participant_id)),
f as (select sample, subsample_id, strip_method, avg(rt) as m, stddev_samp(rt) as s from drawn group by all),
kept as (select d.*, unnest(['none', 'sd_2', 'range_1500']) as outlier, unnest([true, rt between m - 2 * s and m + 2 * s, rt between 200 and 1500]) as keep from drawn d join f using (sample, subsample_id, strip_method)),
scaled as (select *, 'no_log_rt' as transformation, rt as y from kept where keep union all select *, 'log_rt', case when rt > 0 then ln(rt) end from kept where keep),
w as (select sample_size, subsample_id, strip_method, transformation, outlier, participant_id, {contrast_sql('avg', 'y')} as z from scaled where y > 0 and cong in (-1, 1) and prev_cong in (-1, 1) group by all)
select sample_size, subsample_id, strip_method, transformation, outlier, count(z) as n_complete, avg(z) as estimate, avg(z) / (stddev_samp(z) / sqrt(count(z))) as t, count(z) - 1 as df2 from w group by all""")
def grid_rmanova(df):
    """Interaction tests of a grid: samples x effect variants x outlier rules x transformations, from statistics per participant where the fences are fixed."""
    return scale.grid_rmanova(df, samples_of(df), ("none", "local_mean_residual"), GRID_RULES, grid.TRANSFORMS)


@query("trials_ev", "sample_size:d subsample_id strip_method:s transformation:s outlier:s n_complete estimate:d p_value:d significant:b")
def grid_p_values(df):
    got = scale.grid_rmanova(df, samples_of(df), ("none", "local_mean_residual", "shuffle"), GRID_RULES, grid.TRANSFORMS)
    return models.with_p_values(got).withColumn("significant", models.significant(F.col("p_value")))


MATERIALIZED_RULES = ("none", "sd_2", "mad_2.5", "range_1500")


@query("trials_li", "data_id:s n_rows rt:d lo:d hi:d n_participants n_logs", f"""
with {MEMBERS}, eff as (select *, 'none' as strip_method, 'present' as effect_condition from trials union all by name select t.* exclude (rt), r.rt, 'local_mean_residual' as strip_method, 'null_interaction' as effect_condition from trials t join ({residual_sql('avg')}) r using (source_row)),
drawn as (select e.*, m.sample_size, m.sample, m.subsample_id from eff e join members m using (participant_id)),
f as (select sample, subsample_id, strip_method, avg(rt) as m, stddev_samp(rt) as s, median(rt) as med from drawn group by all),
g as (select f.*, mad from f join (select sample, subsample_id, strip_method, median(abs(rt - med)) as mad from drawn join f using (sample, subsample_id, strip_method) group by all) q using (sample, subsample_id, strip_method)),
kept as (select d.*, unnest(['none', 'sd_2', 'mad_2.5', 'range_1500']) as outlier, unnest([true, rt between m - 2 * s and m + 2 * s, rt between med - 2.5 * mad and med + 2.5 * mad, rt between 200 and 1500]) as keep from drawn d join g using (sample, subsample_id, strip_method)),
scaled as (select *, 'no_log_rt' as transformation, rt as y from kept where keep union all select *, 'log_rt', case when rt > 0 then ln(rt) end from kept where keep)
select concat_ws('__', sample, cast(subsample_id as varchar), transformation, outlier, effect_condition, strip_method) as data_id, count(*) as n_rows, avg(y) as rt, min(y) as lo, max(y) as hi, count(distinct participant_id) as n_participants, count(case when transformation = 'log_rt' then y end) as n_logs from scaled group by all""")
def grid_materialize(df):
    """The trials of 112 data branches, with rules of every kind, and what each holds."""
    spec = grid.Grid(fractions=(0.25, 0.5, 1.0), samples=3, outliers=MATERIALIZED_RULES, strips=("local_mean_residual",))
    got = materialize.materialized(df, grid.data_branches(df.sparkSession, spec))
    return got.groupBy("data_id").agg(
        F.count("*").alias("n_rows"), F.avg("rt").alias("rt"), F.min("rt").alias("lo"), F.max("rt").alias("hi"), F.count_distinct("participant_id").alias("n_participants"),
        F.count(F.when(F.col("transformation") == "log_rt", F.col("rt"))).alias("n_logs"),
    )


@query("trials_li", "sample_size:d subsample_id strip_method:s transformation:s outlier:s n_complete estimate:d t:d df2", f"""
with {MEMBERS}, drawn as (select t.*, m.sample_size, m.sample, m.subsample_id from trials t join members m using (participant_id)),
f as (select sample, subsample_id, median(rt) as med from drawn group by all),
g as (select f.*, mad from f join (select sample, subsample_id, median(abs(rt - med)) as mad from drawn join f using (sample, subsample_id) group by all) q using (sample, subsample_id)),
kept as (select d.*, unnest(['mad_2', 'mad_3']) as outlier, unnest([rt between med - 2 * mad and med + 2 * mad, rt between med - 3 * mad and med + 3 * mad]) as keep from drawn d join g using (sample, subsample_id)),
scaled as (select *, 'no_log_rt' as transformation, rt as y from kept where keep union all select *, 'log_rt', case when rt > 0 then ln(rt) end from kept where keep),
w as (select sample_size, subsample_id, transformation, outlier, participant_id, {contrast_sql('avg', 'y')} as z from scaled where y > 0 and cong in (-1, 1) and prev_cong in (-1, 1) group by all)
select sample_size, subsample_id, 'none' as strip_method, transformation, outlier, count(z) as n_complete, avg(z) as estimate, avg(z) / (stddev_samp(z) / sqrt(count(z))) as t, count(z) - 1 as df2 from w group by all""")
def grid_rmanova_mad(df):
    """The same grid plan under rules that need a median for each sample."""
    return scale.grid_rmanova(df, samples_of(df), ("none",), ("mad_2", "mad_3"), grid.TRANSFORMS)


@query("trials_ev", "sample_size:d subsample_id strip_method:s transformation:s outlier:s model:s n_obs n_participants main_estimate:d error:b")
def grid_mixed_models(df):
    """Mixed models over a grid's statistics."""
    samples = grid.base_samples(df.sparkSession, (0.5, 1.0), 1)
    return scale.grid_mixed(df, samples, ("none", "local_mean_residual"), ("none", "sd_2"), ("no_log_rt",))


# --- diagnostics -------------------------------------------------------------------------------------------------------

BY = ["study"]
VALID = "isfinite(rt) and rt > 0 and cong is not null and prev_cong is not null"


def shares_sql() -> list[str]:
    """A cell's share among those whose codes both occur."""
    level = lambda name, code: f"count(case when {VALID} and {name} = {code} then 1 end)"
    return [f"case when {level('cong', c)} > 0 and {level('prev_cong', p)} > 0 then count(case when {VALID} and cong = {c} and prev_cong = {p} then 1 end) / count(case when {VALID} then 1 end) end" for c, p in CELLS]


def metrics_sql(source: str, keys: str) -> str:
    """CTEs ending in `metrics`: every diagnostic of every branch (keys) of a table."""
    vrt = f"case when {VALID} then rt end"
    side = lambda name: f"avg(case when {name} = 1 then {vrt} end) - avg(case when {name} = -1 then {vrt} end)"
    cuts = ", ".join(f"quantile_cont(trial_index, {i / 5})" for i in range(1, 5))
    return f"""good as (select * from {source} where {VALID}),
cells as (select {keys}, {quantiles_sql()} from good group by {keys}),
pools as (select {keys}, {least_sql(' and ' + VALID)} as cell_min_n, {side('cong')} as current_cong_effect, {side('prev_cong')} as previous_cong_effect,
  avg(case when not prev_correct then {vrt} end) - avg(case when prev_correct then {vrt} end) as post_error_slowing, greatest({', '.join(shares_sql())}) - least({', '.join(shares_sql())}) as transition_imbalance,
  count(*) as n_rows, count({vrt}) as n_valid, count(distinct case when {VALID} then participant_id end) as n_participants from {source} group by {keys}),
each as (select {keys}, participant_id, {contrast_sql('avg')} as cse, count(*) as n, stddev_samp(rt) as sd, max(trial_index) > min(trial_index) as two, regr_slope(rt, trial_index) as k from good group by {keys}, participant_id),
cses as (select {keys}, avg(cse) as mean_cse, median(cse) as median_cse, max(abs(cse)) as max_abs_cse, count(case when cse is null then 1 end) as n_incomplete, avg(case when two then k end) as trial_rt_slope_mean from each group by {keys}),
pairs as (select {keys}, participant_id, rt, lag(rt) over (partition by {keys}, participant_id order by trial_index, source_row) as b from good),
corrs as (select {keys}, participant_id, count(*) as n, stddev_samp(rt) as sd, corr(b, rt) as r from pairs group by {keys}, participant_id),
lags as (select {keys}, avg(case when n >= 3 and sd > 0 and isfinite(r) then r end) as lag1_autocorr_mean from corrs group by {keys}),
blocks as (select {keys}, stddev_samp(m) as block_mean_sd from (select {keys}, participant_id, block_index, avg(rt) as m from good group by {keys}, participant_id, block_index) q group by {keys}),
edges as (select {keys}, list_distinct([{cuts}]) as e from good group by {keys} having count(distinct trial_index) >= 5),
bins as (select {keys}, bin, {contrast_sql('median')} as d from (select good.*, len(list_filter(e, lambda x: x < trial_index)) as bin from good join edges using ({keys})) q group by {keys}, bin),
times as (select {keys}, max(abs(d)) as max_abs_timebin_q050_cse from bins group by {keys}),
metrics as (select * from pools left join cells using ({keys}) left join cses using ({keys}) left join lags using ({keys}) left join blocks using ({keys}) left join times using ({keys}))"""


def quantiles_sql() -> str:
    return ", ".join(f"{contrast_sql('quantile_cont').replace('end)', f'end, {p})')} as {n}" for p, n in zip(diagnostics.PROBS, diagnostics.QUANTILE_NAMES, strict=True))


METRICS = metrics_sql("trials", "study")


@query("trials_li", "study:s mean_cse:d median_cse:d max_abs_cse:d n_incomplete", f"with {METRICS} select * from metrics")
def diag_cse(df):
    return diagnostics.cse_summary(df, BY)


@query("trials_li", "study:s q010_cse:d q025_cse:d q050_cse:d q075_cse:d q090_cse:d cell_min_n current_cong_effect:d previous_cong_effect:d post_error_slowing:d transition_imbalance:d n_rows n_valid n_participants", f"with {METRICS} select * from metrics")
def diag_pooled(df):
    return diagnostics.pooled(df, BY)


@query("trials_li", "study:s lag1_autocorr_mean:d trial_rt_slope_mean:d block_mean_sd:d", f"with {METRICS} select * from metrics")
def diag_order(df):
    return reduce(lambda a, b: a.join(b, BY), [diagnostics.lag1_autocorrelation(df, BY), diagnostics.trial_slope(df, BY), diagnostics.block_spread(df, BY)])


@query("trials_li", "study:s max_abs_timebin_q050_cse:d", f"with {METRICS} select * from metrics")
def diag_time_bins(df):
    return diagnostics.time_bin_contrast(df, BY)


def diagnosed(df: DataFrame) -> DataFrame:
    """Diagnostics of two samples' branches: present, and the mean and median residual variants."""
    methods = ("none", "local_mean_residual", "local_median_residual")
    long = nullify.long_effects(nullify.all_effects(df, methods), methods)
    half = long.withColumns({"sample_size": F.when(F.col("study").isin("s0", "s1", "even"), 0.5).otherwise(1.0), "subsample_id": F.lit(1), "transformation": F.lit("no_log_rt"), "outlier": F.lit("none"), "effect_condition": F.when(F.col("strip_method") == "none", "present").otherwise("null_interaction")})
    keys = ["sample_size", "subsample_id", "transformation", "outlier", "effect_condition", "strip_method"]
    got = diagnostics.branch_diagnostics(half, keys)
    return got.withColumn("data_id", F.concat_ws("__", F.col("sample_size").cast("string"), "subsample_id", "transformation", "outlier", "effect_condition", "strip_method"))


def gates_sql() -> str:
    """CTEs ending in `gated`: the branches of `diagnosed` with their differences from the present ones, and the gates' verdict."""
    variants = " union all ".join(
        f"select t.* exclude (rt), {rt} as rt, '{method}' as strip_method from trials t {join}"
        for method, rt, join in (("none", "t.rt", ""), *((f"local_{kind}_residual", "r.rt", f"join ({residual_sql(agg)}) r on r.source_row = t.source_row and r.participant_id = t.participant_id") for kind, agg in (("mean", "avg"), ("median", "median"))))
    )
    deltas = ", ".join(f"case when g.strip_method <> 'none' then g.{c} - p.{c} end as {c}_delta_from_present" for c in diagnostics.DELTAS)
    gates = ", ".join(f"case when isfinite({c}) and abs({c}) > {most} then '{label}' end" for c, most, label in diagnostics.GATES)
    return f"""long as (select *, case when study in ('s0', 's1', 'even') then 0.5 else 1.0 end as sample_size from ({variants}) q), {metrics_sql('long', 'sample_size, strip_method')},
deltas as (select g.*, {deltas} from metrics g join metrics p on p.sample_size = g.sample_size and p.strip_method = 'none'),
gated as (select *, case when strip_method = 'none' then 'present' else 'null_interaction' end as effect_condition, case when strip_method = 'none' then '' else concat_ws(';', {gates}) end as preservation_warnings,
  concat_ws(';', case when n_rows > n_valid then 'dropped_invalid_rows=' || (n_rows - n_valid) end, case when coalesce(n_incomplete > 0, true) then 'incomplete_participant_cells' end, case when mean_cse is null then 'no_finite_participant_cse' end, case when cell_min_n = 0 then 'missing_pooled_cell' end) as warnings from deltas),
judged as (select *, case when strip_method <> 'none' then preservation_warnings = '' end as preservation_pass, concat_ws('__', cast(sample_size as varchar), '1', 'no_log_rt', 'none', effect_condition, strip_method) as data_id,
  case when strip_method = 'none' then 'reference_present' when preservation_warnings = '' then 'interpretable_nullifier' else 'fails_preservation_gates' end as nullification_verdict from gated)"""


@query("trials_li", "data_id:s strip_method:s mean_cse:d q050_cse:d warnings:s current_cong_effect_delta_from_present:d transition_imbalance_delta_from_present:d max_abs_timebin_q050_cse_delta_from_present:d preservation_warnings:s preservation_pass:b nullification_verdict:s", f"with {gates_sql()} select * from judged")
def diag_gates(df):
    return diagnostics.preservation_gates(diagnosed(df))


@query("trials_ev", "study:s n_participants n_rows transition_imbalance:d post_error_slowing:d lag1_autocorr_mean:d trial_rt_slope_mean:d block_sd:d recommendation:s", f"""
with coded as (select * from trials where {VALID} and cong in (-1, 1) and prev_cong in (-1, 1)), {metrics_sql('coded', 'study')},
c as (select study, stddev_samp(m) as block_sd from (select study, block_index, avg(rt) as m from coded group by all) q group by study),
d as (select study, case when count(distinct cong) = 2 and count(distinct prev_cong) = 2 then greatest({', '.join(f'abs({s} - 0.25)' for s in shares_sql())}) end as far from coded group by study)
select metrics.* exclude (transition_imbalance), far as transition_imbalance, block_sd, 'do_not_use_as_primary_counterfactual' as recommendation from metrics join c using (study) join d using (study)""")
def diag_exchangeability(df):
    return diagnostics.exchangeability(df)


def shuffle_pair(df: DataFrame) -> DataFrame:
    keys = {"sample_size": F.lit(1.0), "subsample_id": F.lit(1), "transformation": F.lit("no_log_rt"), "outlier": F.col("study")}
    both = df.withColumn("strip_method", F.lit("none")).where("study <> 's4'").unionByName(nullify.shuffle(df).withColumn("strip_method", F.lit("shuffle")))
    return both.withColumns(keys)


SLOPE_SQL = "select study, sum(x * y) / sum(x * x) as slope from (select study, prev_cong - avg(prev_cong) over w as x, rt - avg(rt) over w as y from {} where rt is not null and cong is not null and prev_cong is not null window w as (partition by study, participant_id, cong)) q group by study"


@query("trials_li", "outlier:s n_groups n_count_mismatch n_value_mismatch preserved:b conditional_prev_slope:d present_prev_slope:d error:b pass:b", f"""
with {SHUFFLE}, sa as ({SLOPE_SQL.format('shuffled')}), sb as ({SLOPE_SQL.format('trials')} having study <> 's4'), g as (select study, count(*) as n from (select distinct study, participant_id, cong from shuffled) q group by study)
select sa.study as outlier, n as n_groups, case when sa.study = 's4' then n else 0 end as n_count_mismatch, case when sa.study = 's4' then n else 0 end as n_value_mismatch, sa.study <> 's4' as preserved, sa.slope as conditional_prev_slope, sb.slope as present_prev_slope,
  sa.study = 's4' as error, sa.study <> 's4' and abs(sa.slope) <= 5 as pass from sa left join sb using (study) join g on g.study = sa.study""")
def diag_shuffle_check(df):
    return diagnostics.shuffle_check(shuffle_pair(df))


FINGERPRINT = """select participant_id, cong, concat_ws('-', cast(count(*) as varchar), cast(sum(cast('0x' || substr(h, 1, 15) as bigint)) as varchar), cast(sum(cast('0x' || substr(h, 16, 15) as bigint)) as varchar)) as fingerprint
  from (select participant_id, cong, md5(coalesce(cast(round(rt, 10) as varchar), 'NA')) as h from {} where prev_cong is not null) q group by all"""


@query("trials_li", "participant_id:s cong fingerprint:s same:b", f"""
with {SHUFFLE}, fa as ({FINGERPRINT.format('trials')}), fb as ({FINGERPRINT.format('shuffled')}) select participant_id, cong, fa.fingerprint, fa.fingerprint = fb.fingerprint as same from fa join fb using (participant_id, cong)""")
def diag_fingerprints(df):
    a, b = (diagnostics.rt_fingerprint(x.where("prev_cong is not null"), ["participant_id", "cong"]) for x in (df, nullify.shuffle(df)))
    return a.join(b.withColumnRenamed("fingerprint", "other"), ["participant_id", "cong"]).withColumn("same", F.col("fingerprint") == F.col("other"))


@query("trials_li", "study:s n_falls source_row_monotonic:b", f"""
with moved as (select *, case when participant_id like '%7' then -trial_index else trial_index end as place from trials), f as (select study, source_row < lag(source_row) over (partition by study, participant_id order by place, source_row) as falls from moved)
select study, count(case when falls then 1 end) as n_falls, count(case when falls then 1 end) = 0 as source_row_monotonic from f group by study""")
def diag_source_row_order(df):
    moved = df.withColumn("place", F.when(F.col("participant_id").endswith("7"), -F.col("trial_index")).otherwise(F.col("trial_index")))
    return diagnostics.source_rows_monotonic(moved, BY, "place")


@query("trials_li", "n_lost n_new kept:b", "select count(*) as n_lost, 0 as n_new, false as kept from trials where trial_index % 10 = 0")
def diag_source_rows(df):
    return diagnostics.source_rows_kept(df, df.where("trial_index % 10 <> 0"))


@query("trials_li", "effect_condition:s strip_method:s sample_size:d n_branches location_mean_cse:d max_abs_distributional_cse:d max_abs_time_local_distributional_cse:d distribution_minus_location_abs:d distributional_flag:s", f"""
with {gates_sql()}, f as (select effect_condition, strip_method, sample_size, nullification_verdict, preservation_pass, count(distinct data_id) as n_branches, avg(mean_cse) as location_mean_cse,
  max(greatest({', '.join(f'abs({c})' for c in ('median_cse', *diagnostics.QUANTILE_NAMES))})) as max_abs_distributional_cse, max(abs(max_abs_timebin_q050_cse)) as max_abs_time_local_distributional_cse from judged group by all)
select *, max_abs_distributional_cse - abs(location_mean_cse) as distribution_minus_location_abs, case when max_abs_distributional_cse is null then 'missing_distributional_metrics'
  when max_abs_distributional_cse > 10 and abs(location_mean_cse) <= 5 then 'distributional_residual_without_location_cse' when max_abs_distributional_cse <= 10 and abs(location_mean_cse) <= 5 then 'location_and_distributional_near_zero' else 'location_cse_present' end as distributional_flag from f""")
def diag_definitions(df):
    return diagnostics.cse_definitions(diagnostics.preservation_gates(diagnosed(df)))


@query("trials_li", "study:s participant_id:s source_row trial_z:d cong_code:d", f"""
with s as (select study, participant_id, min(source_row) as first from trials where {MODEL_ROWS} group by all), r as (select *, row_number() over (partition by study order by first, participant_id) as rk from s)
select t.study, t.participant_id, source_row, coalesce((trial_index - avg(trial_index) over w) / nullif(stddev_samp(trial_index) over w, 0), 0) as trial_z, cong / 2.0 as cong_code
from trials t join r using (study, participant_id) where rk <= 3 and t.study in ('s1', 's2') and {MODEL_ROWS} window w as (partition by study, participant_id)""")
def subset_first_participants(df):
    return subsets.first_n_participants(df, ["s1", "s2"], 3)
