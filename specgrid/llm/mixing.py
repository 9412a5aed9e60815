"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

Every source gets a target number of words. A document's expected copies are its source's target over its size; the whole
part is taken outright and the fraction is rounded at random so that the words a source gives stay put: fractions are
paired, and mass (words) moves from one to the other until one of them is 0 or 1, in a random direction that keeps each
expectation. What one bucket of documents leaves open is a single fraction; those are bucketed again, level by level, until
one is left for each source. Very long documents are settled first, and the others make up for them, so that a source's words
differ from its target by a short document.

Cases: a null text or one without words has size 0 and gives nothing; a null source is a source of its own, after the
others; rows that are equal in id, text and source are one unit with a multiplicity, so they can't crowd a bucket; an empty
table gives an empty result; draws come from hashes of the rows, so reruns and other partitionings agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from specgrid.llm.common import SPACED_WORD, saved, shielded, small, table

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
CAP = 2.0
#: Units that a bucket holds on average: the width of the reduction tree.
BUCKET = 256
#: A document with more than 1/LONG of its source's words is drawn before the others.
LONG = 100

#: One pivotal step. s.held is the open unit and x the next one; one of the two comes out with its fraction settled.
STEP = """
aggregate(units, named_struct('held', cast(null as {unit}), 'done', cast(array() as array<struct<key: bigint, extra: int>>)), (s, x) ->
  if(s.held is null, named_struct('held', x, 'done', s.done), element_at(transform(
    array(named_struct('to_x', least(s.held.mass, x.cap - x.mass), 'to_held', least(x.mass, s.held.cap - s.held.mass), 'all', s.held.mass + x.mass,
      'u', shiftrightunsigned(xxhash64({seed}, s.held.key, x.key), 11) / 9007199254740992D)), m ->
    if(m.u * (m.to_x + m.to_held) < m.to_held,
      if(s.held.mass <= x.cap - x.mass,
        named_struct('held', named_struct('cap', x.cap, 'key', x.key, 'mass', m.all), 'done', concat(s.done, array(named_struct('key', s.held.key, 'extra', 0)))),
        named_struct('held', named_struct('cap', s.held.cap, 'key', s.held.key, 'mass', m.all - x.cap), 'done', concat(s.done, array(named_struct('key', x.key, 'extra', 1))))),
      if(x.mass <= s.held.cap - s.held.mass,
        named_struct('held', named_struct('cap', s.held.cap, 'key', s.held.key, 'mass', m.all), 'done', concat(s.done, array(named_struct('key', x.key, 'extra', 0)))),
        named_struct('held', named_struct('cap', x.cap, 'key', x.key, 'mass', m.all - s.held.cap), 'done', concat(s.done, array(named_struct('key', s.held.key, 'extra', 1))))))), 1)))
"""
UNIT = "struct<cap: double, key: bigint, mass: double>"


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(SPACED_WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size, n, target) from rows (source, size, m): share of all words dealt by weight, no source above cap times its own.

    The excess is dealt again by weight until none is above: the water level is that of the first source, in order of
    cap over weight, which stays below its cap. The windows run over the sources, not over the documents.
    """
    by = Window.orderBy(F.col("source").asc_nulls_last())
    order, every = Window.orderBy("reach", "nth"), Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    got = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).cast("long").alias("source_size"), F.count("*").alias("n"))
    got = got.withColumn("nth", F.row_number().over(by))
    got = got.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("nth") - 1) % len(weights) + 1).cast("int")))
    got = got.withColumn("cap", F.col("source_size") * F.lit(cap)).withColumn("reach", F.col("cap") / F.col("weight"))
    got = got.withColumn("budget", F.sum("source_size").over(every) * F.lit(share))
    got = got.withColumn("before", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    got = got.withColumn("rest", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    got = got.withColumn("level", (F.col("budget") - F.col("before")) / F.col("rest"))
    got = got.withColumn("full", F.col("level") >= F.col("reach"))
    got = got.withColumn("water", F.min(F.when(~F.col("full"), F.struct("reach", "nth", "level"))).over(every)["level"])
    return got.select("source", "source_size", "n", F.when(F.col("full"), F.col("cap")).otherwise(F.col("water") * F.col("weight")).alias("target"))


def settled(units: DataFrame, seed: int) -> DataFrame:
    """(key, extra 0 or 1) for units (source, key, cap, mass): the reduction tree, a level of buckets at a time."""
    found, level = None, 0
    while True:
        counts = saved(units.groupBy("source").agg(F.count("*").alias("__n")).withColumnRenamed("source", "__source"))
        most = counts.agg(F.max("__n")).first()[0] or 0
        dealt = units.join(small(counts), F.col("source").eqNullSafe(F.col("__source"))).select(
            "source", F.pmod(F.xxhash64(F.lit(seed + level), "key"), F.ceil(F.col("__n") / BUCKET)).alias("bucket"), F.struct("cap", "key", "mass").alias("unit"),
        ).repartition("source", "bucket")
        folded = dealt.groupBy("source", "bucket").agg(F.reverse(F.array_sort(F.collect_list("unit"))).alias("units"))
        folded = saved(folded.select("source", F.expr(STEP.format(unit=UNIT, seed=seed + level)).alias("got")))
        done = folded.select(F.explode("got.done").alias("d")).select("d.key", "d.extra")
        found = done if found is None else found.unionByName(done)
        units = folded.select("source", "got.held.key", "got.held.cap", "got.held.mass")
        level += 1
        if most <= BUCKET:
            u = F.shiftrightunsigned(F.xxhash64(F.lit(seed + level), "key"), 11) / F.lit(float(1 << 53))
            return found.unionByName(units.select("key", (u * F.col("cap") < F.col("mass")).cast("int").alias("extra")))


def drawn(units: DataFrame, seed: int) -> DataFrame:
    """units (key, source, size, m, rate) with base and extra: of the m equal rows the first `extra` get base + 1 copies, the others base."""
    units = units.withColumn("base", F.floor(F.col("rate") + F.lit(1e-12))).withColumn("__all", F.greatest(F.col("rate") - F.col("base"), F.lit(0.0)) * F.col("m"))
    units = units.withColumn("__whole", F.floor(F.col("__all") + F.lit(1e-12)))
    part = F.greatest(F.col("__all") - F.col("__whole"), F.lit(0.0))
    units = units.withColumn("__part", F.when(part > 1e-12, part).otherwise(0.0))
    open_ = units.where((F.col("__part") > 0) & (F.col("size") > 0))
    got = settled(open_.select("source", "key", F.col("size").cast("double").alias("cap"), (F.col("__part") * F.col("size")).alias("mass")), seed)
    return units.join(got, "key", "left").withColumn("extra", F.col("__whole") + F.coalesce("extra", F.lit(0))).drop("__all", "__whole", "__part")


def rounded_copies(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = 0) -> DataFrame:
    """(doc_id, source, size, h, m, source_size, target, base, extra) for rows (doc_id, source, size, h), equal rows as one with multiplicity m.

    Documents of over 1/LONG of their source are drawn first (there are at most LONG of them in a source), and what they
    took more or less than expected is spread over the others, whose words then meet the rest of the target closely.
    """
    units = saved(rows.groupBy("doc_id", "source", "size", "h").agg(F.count("*").alias("m")))
    want = targets(units, weights, share, cap).withColumnRenamed("source", "__source")
    units = units.join(want, F.col("source").eqNullSafe(F.col("__source"))).drop("__source", "n")
    # the key is unique among units that differ in any column
    units = saved(units.withColumn("key", F.xxhash64("doc_id", "source", "size", "h")).withColumn("__long", F.col("size") * LONG > F.col("source_size")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    long = saved(drawn(units.where("__long").withColumn("rate", rate), seed))
    gone = long.groupBy(F.col("source").alias("__source")).agg(
        F.sum(F.col("size") * (F.col("m") * F.col("base") + F.col("extra"))).alias("__taken"), F.sum(F.col("size") * F.col("m")).alias("__size")
    )
    short = units.where(~F.col("__long")).join(gone, F.col("source").eqNullSafe(F.col("__source")), "left")
    left = F.col("source_size") - F.coalesce("__size", F.lit(0))
    rate = F.when(left > 0, F.least(F.greatest((F.col("target") - F.coalesce("__taken", F.lit(0))) / left, F.lit(0.0)), F.lit(cap))).otherwise(0.0)
    short = drawn(short.withColumn("rate", rate).drop("__source", "__taken", "__size"), seed + 100)
    return long.unionByName(short).select("doc_id", "source", "size", "h", "m", "source_size", "target", "base", "extra")


def row_hash() -> Column:
    """Tells rows apart by id, text and source; a null differs from every value."""
    columns = ("doc_id", "text", "source")
    return F.xxhash64(*columns, *(F.col(c).isNull() for c in columns))


def keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("__h", row_hash())


@shielded
def mix(docs: DataFrame, **how) -> DataFrame:
    """The mixed corpus: the rows of docs, each as often as it was drawn (0 to 2 times at the default settings), with docs's columns."""
    here = keyed(docs)
    drawn = rounded_copies(here.select("doc_id", "source", word_count().alias("size"), F.col("__h").alias("h")), **how)
    drawn = saved(drawn.where((F.col("base") > 0) | (F.col("extra") > 0)).select(F.col("h").alias("__h"), "m", "base", F.col("extra").alias("__extra")))
    got = here.join(small(drawn.withColumnsRenamed({"m": "__m", "base": "__base"})), "__h")
    if (drawn.agg(F.max("m")).first()[0] or 0) > 1:
        got = got.withColumn("__nth", F.row_number().over(Window.partitionBy("__h").orderBy("__m")))
    else:
        got = got.withColumn("__nth", F.lit(1))
    copies = (F.col("__base") + (F.col("__nth") <= F.col("__extra")).cast("long")).cast("int")
    return got.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), copies))).select(*docs.columns)


def op8_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of each document, over all documents."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", word_count().alias("size"), row_hash().alias("h"))
    got = rounded_copies(rows).withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("m").cast("int"))))
    copies = F.col("base") + (F.col("nth") <= F.col("extra")).cast("long")
    return got.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).cast("long").alias("taken"), "source", copies.cast("long").alias("copies"))
