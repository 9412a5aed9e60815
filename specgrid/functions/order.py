"""Exact order statistics of large groups, without any group's values in one buffer or one task.

Values are counted first, so repeated ones are one row. Where every group is counted to have few different values, Spark's own
exact percentile reads them; else approximate quantiles cut each group's range into buckets, bucket sums tell in which bucket
a rank lies, and only those buckets are sorted, each by itself. Both ways give the same numbers.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specgrid.sources.scratch import saved

#: Parts into which a group's values are cut.
BUCKETS = 64
#: Different values of a group that may meet in one buffer.
WHOLE = 250_000


def counted(df: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """(by..., value, n): how often each value occurs in each group, written to the scratch folder; null values don't count."""
    return saved(df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("value")).agg(F.count("*").alias("n")))


def order_statistics(values: DataFrame, by: Sequence[str], ranks: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(by..., rank, value) for ranks (by..., rank from 1) within the groups of counted values (by..., value, n); by holds no nulls."""
    by = list(by)
    edges = values.groupBy(*by).agg(F.percentile_approx("value", [i / buckets for i in range(1, buckets)], 1000).alias("__edges"))
    placed = values.join(edges, by).withColumn("__b", F.size(F.filter("__edges", lambda e: e < F.col("value")))).drop("__edges")
    order = Window.partitionBy(*by).orderBy("__b")
    sums = placed.groupBy(*by, "__b").agg(F.sum("n").alias("__in")).withColumn("__before", F.sum("__in").over(order) - F.col("__in"))
    wanted = ranks.select(*by, "rank").distinct().join(sums, by).where((F.col("rank") > F.col("__before")) & (F.col("rank") <= F.col("__before") + F.col("__in"))).drop("__in")
    held = placed.join(wanted.select(*by, "__b").distinct(), [*by, "__b"], "left_semi")
    held = held.withColumn("__to", F.sum("n").over(Window.partitionBy(*by, "__b").orderBy("value")))
    got = held.join(wanted, [*by, "__b"]).where((F.col("rank") > F.col("__before") + F.col("__to") - F.col("n")) & (F.col("rank") <= F.col("__before") + F.col("__to")))
    return got.select(*by, "rank", "value")


def place(n: Column, share: Column, kind: int) -> Column:
    """Where a share lies among n sorted values, from 1: type 7 (the ends are 0 and 1) or type 8 (median-unbiased)."""
    h = (n - 1) * share + 1 if kind == 7 else (n + F.lit(1 / 3)) * share + F.lit(1 / 3)
    return F.least(F.greatest(h, F.lit(1.0)), n.cast("double"))


def quantiles(df: DataFrame, by: Sequence[str], shares: Sequence[float], value: str = "value", kind: int = 7) -> DataFrame:
    """(by..., quantiles): the exact quantiles of each group that has values, in the order of shares, linear between neighbours."""
    return counted_quantiles(counted(df, by, value), by, shares, kind)


def counted_quantiles(values: DataFrame, by: Sequence[str], shares: Sequence[float], kind: int = 7) -> DataFrame:
    """The same of counted values (by..., value, n), which are read more than once."""
    by = list(by)
    if kind == 7 and (values.groupBy(*by).count().agg(F.max("count")).first()[0] or 0) <= WHOLE:
        return values.groupBy(*by).agg(F.percentile("value", [float(s) for s in shares], F.col("n")).alias("quantiles"))
    at = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(float(s)).alias("share")) for i, s in enumerate(shares)))
    sizes = values.groupBy(*by).agg(F.sum("n").alias("__size"))
    asked = sizes.select(*by, "__size", F.inline(at)).withColumn("__h", place(F.col("__size"), F.col("share"), kind)).withColumn("__low", F.floor("__h"))
    asked = asked.withColumn("__high", F.least(F.col("__low") + 1, F.col("__size")))
    ends = asked.select(*by, "i", "__h", "__low", F.inline(F.array(F.struct(F.col("__low").alias("rank"), F.lit(0).alias("side")), F.struct(F.col("__high").alias("rank"), F.lit(1).alias("side")))))
    found = ends.join(order_statistics(values, by, ends), [*by, "rank"])
    side = lambda k: F.max(F.when(F.col("side") == k, F.col("value")))
    each = found.groupBy(*by, "i").agg(side(0).alias("__a"), side(1).alias("__b"), F.first(F.col("__h") - F.col("__low")).alias("__f"))
    each = each.withColumn("__q", F.col("__a") + F.col("__f") * (F.col("__b") - F.col("__a")))
    return each.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "__q"))), lambda x: x["__q"]).alias("quantiles"))


def medians(df: DataFrame, by: Sequence[str], value: str = "value", name: str = "median") -> DataFrame:
    """(by..., name): each group's exact median."""
    return quantiles(df, by, (0.5,), value).select(*by, F.col("quantiles")[0].alias(name))


#: Steps of the first buckets of `grouped_quantiles` for each unit of the logarithm, parts of a bucket that is cut again, and values that are sorted in one task.
STEPS, CUTS, SORTED = 64, 1024, 200_000
#: Rows of ranks that are broadcast at most.
FEW = 100_000


def bucket(value: Column) -> Column:
    """A whole number that never falls as the value rises: steps of a 64th of the logarithm."""
    return (F.signum(value) * F.floor(F.log1p(F.abs(value)) * STEPS)).cast("long")


def grouped_quantiles(df: DataFrame, requests: Sequence[tuple[Sequence[str], Sequence[float]]], value: str = "value", kind: int = 7) -> list[DataFrame]:
    """For each request (keys, shares) a table (keys..., quantiles): exact quantiles of all groups of all requests at once.

    One pass over the values makes a histogram with all keys, in buckets that are the same for all groups; each request rolls it
    up to its own keys and finds the buckets in which its ranks lie. A second pass sorts those buckets only. A bucket
    of more than SORTED values is cut again, by passes over its values, until it is small or a single value.
    Null values don't count, nor does not-a-number. Keys that hold nulls are groups too.
    """
    every = list(dict.fromkeys(k for keys, _ in requests for k in keys))
    same = [k for k in every if all(k in keys for keys, _ in requests)]
    v = F.col(value).cast("double")
    rows = df.where(v.isNotNull() & ~F.isnan(v)).select(*every, v.alias("__v")).withColumn("__b", bucket(F.col("__v")))
    hist = saved(rows.groupBy(*every, "__b").agg(F.count("*").alias("__n"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi")))

    def asked(r: int, keys: Sequence[str], shares: Sequence[float]) -> DataFrame:
        order = Window.partitionBy(*keys, F.lit(r)).orderBy("__b")
        own = hist.groupBy(*keys, "__b").agg(F.sum("__n").alias("__n"), F.min("__lo").alias("__lo"), F.max("__hi").alias("__hi"))
        own = own.withColumn("__before", F.sum("__n").over(order) - F.col("__n")).withColumn("__size", F.sum("__n").over(Window.partitionBy(*keys, F.lit(r))))
        def ends(i: Column, share: Column) -> list[Column]:
            h = place(F.col("__size"), share, kind)
            return [F.struct(i.alias("__i"), F.lit(side).alias("__side"), F.least(F.floor(h) + side, F.col("__size")).alias("__rank"), (h - F.floor(h)).alias("__f")) for side in (0, 1)]

        if len(shares) <= 16:
            ranks = F.array(*(e for i, x in enumerate(shares) for e in ends(F.lit(i), F.lit(float(x)))))
        else:  # one expression over a list, as code for each share would grow too large
            listed = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(float(x)).alias("share")) for i, x in enumerate(shares)))
            inside = lambda e: (e["__rank"] > F.col("__before")) & (e["__rank"] <= F.col("__before") + F.col("__n"))
            ranks = F.filter(F.flatten(F.transform(listed, lambda x: F.array(*ends(x["i"], x["share"])))), inside)
        got = own.select("*", F.inline(ranks)).where((F.col("__rank") > F.col("__before")) & (F.col("__rank") <= F.col("__before") + F.col("__n")))
        other = [F.lit(None).cast(df.schema[k].dataType).alias(k) for k in every if k not in keys]
        return got.select(F.lit(r).alias("__r"), *keys, *other, "__b", "__i", "__side", "__f", (F.col("__rank") - F.col("__before")).alias("__rank"), "__n", "__lo", "__hi")

    def held(ranges: DataFrame) -> DataFrame:
        """The values that lie in ranges (__r, keys, __b, __lo, __hi)."""
        ranges = saved(ranges)
        named = ranges.withColumnsRenamed({k: f"__of_{k}" for k in every} | {"__b": "__of_b"})
        on = [F.col(k).eqNullSafe(F.col(f"__of_{k}")) for k in same] + [F.col("__b") == F.col("__of_b"), F.col("__v").between(F.col("__lo"), F.col("__hi"))]
        # keys that a request doesn't have may be anything
        for k in every:
            if k not in same:
                without = [r for r, (keys, _) in enumerate(requests) if k not in keys]
                on.append(F.col("__r").isin(*without) | F.col(k).eqNullSafe(F.col(f"__of_{k}")))
        got = rows.join(F.broadcast(named) if ranges.count() <= FEW else named, reduce(lambda a, b: a & b, on))
        return got.select("__r", *(F.col(f"__of_{k}").alias(k) for k in every), "__b", "__lo", "__hi", "__v")

    keys = ["__r", *every, "__b", "__lo", "__hi"]
    matched = lambda a, b: reduce(lambda x, y: x & y, (F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys))
    wanted = saved(reduce(DataFrame.unionByName, (asked(r, k, s) for r, (k, s) in enumerate(requests))))
    while not (large := wanted.where((F.col("__n") > SORTED) & (F.col("__lo") < F.col("__hi")))).isEmpty():
        # halves are taken before the difference, which can't overflow then
        part = F.floor((F.col("__v") / 2 - F.col("__lo") / 2) / (F.col("__hi") / 2 - F.col("__lo") / 2) * CUTS)
        cut = held(large.select(*keys).distinct()).groupBy(*keys, part.alias("__part")).agg(F.count("*").alias("__in"), F.min("__v").alias("__from"), F.max("__v").alias("__to"))
        cut = cut.withColumn("__before", F.sum("__in").over(Window.partitionBy(*keys).orderBy("__part")) - F.col("__in"))
        found = large.alias("a").join(cut.alias("b"), matched("a", "b")).where((F.col("a.__rank") > F.col("__before")) & (F.col("a.__rank") <= F.col("__before") + F.col("__in")))
        found = found.select("a.__r", *(f"a.{k}" for k in every), "a.__b", "a.__i", "a.__side", "a.__f", (F.col("a.__rank") - F.col("__before")).alias("__rank"), F.col("__in").alias("__n"), F.col("__from").alias("__lo"), F.col("__to").alias("__hi"))
        wanted = saved(wanted.where((F.col("__n") <= SORTED) | (F.col("__lo") >= F.col("__hi"))).unionByName(found))
    open_ = wanted.where("__lo < __hi")
    placed = held(open_.select(*keys).distinct()).withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy("__v")))
    exact = open_.alias("a").join(placed.alias("b"), matched("a", "b") & (F.col("a.__rank") == F.col("b.__rank"))).select("a.__r", *(f"a.{k}" for k in every), "a.__i", "a.__side", "a.__f", F.col("b.__v").alias("__v"))
    exact = saved(exact.unionByName(wanted.where("__lo >= __hi").select("__r", *every, "__i", "__side", "__f", F.col("__lo").alias("__v"))))
    out = []
    for r, (own, _) in enumerate(requests):
        side = lambda k: F.max(F.when(F.col("__side") == k, F.col("__v")))
        each = exact.where(F.col("__r") == r).groupBy(*own, "__i").agg(side(0).alias("__a"), side(1).alias("__z"), F.max(F.when(F.col("__side") == 0, F.col("__f"))).alias("__f"))
        each = each.withColumn("__q", F.col("__a") + F.when(F.col("__f") > 0, F.col("__f") * (F.col("__z") - F.col("__a"))).otherwise(0.0))
        out.append(each.groupBy(*own).agg(F.transform(F.array_sort(F.collect_list(F.struct("__i", "__q"))), lambda x: x["__q"]).alias("quantiles")))
    return out


def ranked(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str = "rank") -> DataFrame:
    """df with each row's rank within its group by, from 1, in rising order of columns that tell all rows of a group apart.

    Rows are dealt out by ranges of keys and order, so a large group lies in several tasks; each counts its own rows of a
    group, and a row's rank is its place among them after the counts of the tasks before.
    """
    by = list(by)
    dealt = saved(df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).withColumn("__id", F.monotonically_increasing_id()))
    rows = dealt.withColumn("__part", F.shiftright("__id", 33))
    pieces = rows.groupBy("__part", *by).agg(F.count("*").alias("__n"), F.min("__id").alias("__first"))
    before = F.sum("__n").over(Window.partitionBy(*by).orderBy("__part")) - F.col("__n")
    pieces = saved(pieces.select(F.col("__part").alias("__of"), *(F.col(k).alias(f"__of_{k}") for k in by), (before - F.col("__first") + 1).alias("__shift")))
    on = [F.col("__part") == F.col("__of")] + [F.col(k).eqNullSafe(F.col(f"__of_{k}")) for k in by]
    got = rows.join(F.broadcast(pieces) if pieces.count() <= FEW else pieces, reduce(lambda a, b: a & b, on))
    return got.select(*df.columns, (F.col("__id") + F.col("__shift")).alias(name))


def cumulative(values: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by..., value, upto, total) of counted values (by..., value, n): how many of its group's values are at most each, and how many there are.

    Values are dealt out by ranges, so a large group lies in several tasks; each adds up its own, after the sums of those before.
    """
    by = list(by)
    rows = saved(values.repartitionByRange(*by, "value").withColumn("__part", F.spark_partition_id()))
    own, until = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("__part")
    pieces = rows.groupBy("__part", *by).agg(F.sum("n").alias("__in")).select(
        F.col("__part").alias("__of"), *(F.col(k).alias(f"__of_{k}") for k in by), (F.sum("__in").over(until) - F.col("__in")).alias("__before"), F.sum("__in").over(own).alias("total"),
    )
    on = [F.col("__part") == F.col("__of")] + [F.col(k).eqNullSafe(F.col(f"__of_{k}")) for k in by]
    got = rows.join(pieces, reduce(lambda a, b: a & b, on))
    upto = F.col("__before") + F.sum("n").over(Window.partitionBy("__part", *by).orderBy("value"))
    return got.select(*by, "value", upto.alias("upto"), "total")
