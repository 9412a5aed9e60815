"""Preference formatting, in DataFrame operations only.

A pair of conversations, one chosen and one rejected, becomes one row: the turns that both begin with are rendered once as
the prompt, and what follows is rendered for each side with its mask, the spans of characters that a trainer should learn
from (assistant turns) as against those it only reads.

Turns are compared by role and text, in turn order. Sides are gathered per conversation, whose length is the only thing
that bounds an array.

Cases: a null role or text compares and renders as empty; repeated turns of one number are ordered by role and text, and
equal rows count as several turns; a side that ends with the prefix has an empty completion; pairs of which one side has no
turn are kept with an empty prompt; a null conversation id is no conversation; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from specgrid.llm.common import table

OPEN, MIDDLE, CLOSE = "<|", "|>\n", "\n<|end|>\n"
LEARNED = "assistant"


def turns_of(rows: DataFrame, key: str) -> DataFrame:
    """(key, turns: array of (turn, role, text) in order) from rows (key, turn, role, text)."""
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_list(turn)).alias("turns"))


def prefix_length(a: Column, b: Column) -> Column:
    """How many turns both begin with: the first place where they differ, or the shorter one's length."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce((x["role"] == y["role"]) & (x["text"] == y["text"]), F.lit(False)))
    at = F.array_position(same, False)
    return F.when(at > 0, at - 1).otherwise(F.size(same)).cast("int")


def rendered(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit(MIDDLE), turn["text"], F.lit(CLOSE))


def text_of(turns: Column) -> Column:
    return F.array_join(F.transform(turns, rendered), "")


def mask_of(turns: Column) -> Column:
    """[start, end) spans, in characters of text_of(turns), of what is learned: assistant texts with their closing mark."""
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start: int, end: int>>)").alias("spans"))

    def step(s, t):
        begin = s["at"] + F.length(t["role"]) + F.lit(len(OPEN) + len(MIDDLE))
        end = begin + F.length(t["text"]) + F.lit(len(CLOSE))
        span = F.struct(begin.alias("start"), end.alias("end"))
        spans = F.when(t["role"] == LEARNED, F.concat(s["spans"], F.array(span))).otherwise(s["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    return F.aggregate(turns, start, step, lambda s: s["spans"])


def format_pairs(pairs: DataFrame) -> DataFrame:
    """Rows with chosen and rejected (arrays of turns) plus prompt, n_prefix, and completion and mask of each side."""
    at = pairs.withColumn("n_prefix", F.coalesce(prefix_length(F.col("chosen"), F.col("rejected")), F.lit(0)))
    tail = lambda side: F.slice(F.coalesce(side, F.expr("cast(array() as array<struct<turn: bigint, role: string, text: string>>)")), F.col("n_prefix") + 1, 1 << 30)
    at = at.withColumns({"__prefix": F.slice("chosen", 1, F.col("n_prefix")), "__chosen": tail(F.col("chosen")), "__rejected": tail(F.col("rejected"))})
    return at.withColumns({
        "prompt": F.coalesce(text_of(F.col("__prefix")), F.lit("")),
        "chosen_completion": text_of(F.col("__chosen")), "chosen_mask": mask_of(F.col("__chosen")),
        "rejected_completion": text_of(F.col("__rejected")), "rejected_mask": mask_of(F.col("__rejected")),
    }).drop("__prefix", "__chosen", "__rejected", "chosen", "rejected")


def reply_pairs(conversations: DataFrame) -> DataFrame:
    """(conv_id, chosen, rejected): every conversation up to its last assistant turn, against the same with the next conversation's last reply there.

    The next conversation is the one with the next id; one without an assistant turn, or without a successor that has one, makes no pair.
    """
    held = turns_of(conversations, "conv_id")
    last = F.array_max(F.transform(F.col("turns"), lambda t, i: F.when(t["role"] == LEARNED, i)))
    held = held.withColumn("last", last).where("last is not null")
    replies = held.select((F.col("conv_id") - 1).alias("conv_id"), F.element_at("turns", F.col("last") + 1)["text"].alias("reply"))
    both = held.join(replies, "conv_id")
    turn = F.element_at("turns", F.col("last") + 1)
    other = F.struct(turn["turn"].alias("turn"), turn["role"].alias("role"), F.col("reply").alias("text"))
    return both.select("conv_id", F.slice("turns", 1, F.col("last") + 1).alias("chosen"), F.concat(F.slice("turns", 1, F.col("last")), F.array(other)).alias("rejected"))


def op9_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A preference pair for each conversation with a reply, its masks as text (start-end;...)."""
    got = format_pairs(reply_pairs(table(spark, sf_dir, "conversations")))
    spans = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string"))), ";")
    return got.select(
        "conv_id", F.col("n_prefix").cast("long").alias("n_prefix"), "prompt", "chosen_completion", spans(F.col("chosen_mask")).alias("chosen_mask"),
        "rejected_completion", spans(F.col("rejected_mask")).alias("rejected_mask"),
    )


#: The same in DuckDB: the prefix is all turns before the last reply, and one more if both replies are equal.
OP9_SQL = """
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn, coalesce(role, ''), coalesce(text, '')) as k
  from conversations where conv_id is not null),
last as (select conv_id, max(k) as k from t where role = 'assistant' group by conv_id),
reply as (select t.conv_id, t.k, t.text from t join last using (conv_id, k)),
pair as (select a.conv_id, a.k, a.text as chosen, b.text as rejected from reply a join reply b on b.conv_id = a.conv_id + 1),
head as (select p.conv_id, string_agg('<|' || t.role || '|>' || chr(10) || t.text || chr(10) || '<|end|>' || chr(10), '' order by t.k) as prompt
  from pair p join t on t.conv_id = p.conv_id and (t.k < p.k or (t.k = p.k and p.chosen = p.rejected)) group by p.conv_id)
select p.conv_id, cast(p.k - 1 + case when p.chosen = p.rejected then 1 else 0 end as bigint) as n_prefix, coalesce(h.prompt, '') as prompt,
  case when p.chosen = p.rejected then '' else '<|assistant|>' || chr(10) || p.chosen || chr(10) || '<|end|>' || chr(10) end as chosen_completion,
  case when p.chosen = p.rejected then '' else '14-' || cast(14 + length(p.chosen) + 9 as varchar) end as chosen_mask,
  case when p.chosen = p.rejected then '' else '<|assistant|>' || chr(10) || p.rejected || chr(10) || '<|end|>' || chr(10) end as rejected_completion,
  case when p.chosen = p.rejected then '' else '14-' || cast(14 + length(p.rejected) + 9 as varchar) end as rejected_mask
from pair p left join head h using (conv_id)
"""
