"""Nested scopes as intervals: opening and closing marks paired by prefix sums, and what encloses a point found by level.

A running sum of marks gives each its level. An opening and the next closing of the same level are a pair, and the
innermost interval around a point at a level is the last one opened at that level before it. All of that is windows over
the marks of one text; no stack is kept and no pair of a point and an interval is tried.

To look a name up through enclosing scopes, give `enclosing` the intervals that define it and group by the name: the
innermost of those is the one meant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.lineage import cut


def within(rows: DataFrame, by: list[str], at: str, step: Column, wanted: Column) -> DataFrame:
    """rows with opens, closes (the place of the opening it closes) and inside: the place of the innermost wanted opening around each row, null where none is.

    step: 1 where a row opens, -1 where it closes, else 0; wanted tells which openings count. An opening is inside
    itself, a closing is outside again; what is never closed lasts to the end. Rows are told apart by `at`, are used
    once, and only windows pass over them.
    """
    order = Window.partitionBy(*by).orderBy(at)
    rows = rows.withColumn("_step", step).withColumn("_sum", F.sum("_step").over(order))
    rows = rows.withColumn("_low", F.least(F.lit(0), F.min("_sum").over(order)))
    stray = F.col("_low") < F.lag("_low", 1, 0).over(order)
    level = F.when(F.col("_step") != 0, F.col("_sum") - F.col("_low") + F.when(F.col("_step") < 0, 1).otherwise(0))
    rows = rows.withColumn("_stray", stray).withColumn("_level", level).withColumn("opens", (F.col("_step") > 0) & wanted)
    same = Window.partitionBy(*by, "_stray", "_level").orderBy(at)
    opened = F.lag(F.when(F.col("opens"), F.col(at))).over(same)
    rows = rows.withColumn("closes", F.when((F.col("_step") < 0) & ~F.col("_stray"), opened))
    rows = rows.withColumn("_depth", F.sum(F.when(F.col("opens"), 1).when(F.col("closes").isNotNull(), -1).otherwise(0)).over(order))
    last = F.last(F.when(F.col("opens"), F.col(at)), ignorenulls=True).over(Window.partitionBy(*by, "_depth").orderBy(at))
    return rows.withColumn("inside", F.when(F.col("_depth") > 0, last)).drop("_step", "_sum", "_low", "_stray", "_level", "_depth")


def pairs(marks: DataFrame, by: list[str]) -> DataFrame:
    """by, begin, end: marks (by, at, step: 1 opens, -1 closes) paired; openings and closings without a partner are left out.

    Marks of one group stand at different places; a repeated mark counts once, one without a place not at all.
    """
    rows = marks.where("at is not null").select(*by, "at", "step").distinct()
    order = Window.partitionBy(*by).orderBy("at")
    rows = rows.withColumn("sum", F.sum("step").over(order))
    # A closing that takes the sum to a new low closes nothing; levels count from the low.
    rows = rows.withColumn("low", F.least(F.lit(0), F.min("sum").over(order)))
    rows = rows.withColumn("stray", F.col("low") < F.lag("low", 1, 0).over(order)).where("not stray")
    level = F.col("sum") - F.col("low") + F.when(F.col("step") < 0, 1).otherwise(0)
    same = Window.partitionBy(*by, "level").orderBy("at")
    ahead = rows.withColumn("level", level).withColumn("end", F.when(F.lead("step").over(same) < 0, F.lead("at").over(same)))
    return ahead.where("step > 0 and end is not null").select(*by, F.col("at").alias("begin"), "end")


def levelled(intervals: DataFrame, by: list[str]) -> DataFrame:
    """Intervals (by, begin, end and other columns) with how many are open at their begin and before their end, themselves included."""
    mine = F.struct(*intervals.columns)
    marks = intervals.select(*by, F.explode(F.array(F.struct(F.col("begin").alias("at"), F.lit(1).alias("step"), mine.alias("it")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("step"), mine.alias("it")))).alias("m")).select(*by, "m.*")
    order = Window.partitionBy(*by).orderBy("at", "step")
    rows = marks.withColumn("sum", F.sum("step").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    both = rows.groupBy(*by, F.col("it.begin").alias("begin")).agg(F.any_value("it").alias("it"), F.max(F.when(F.col("step") > 0, F.col("sum"))).alias("level"), F.max(F.when(F.col("step") < 0, F.col("sum") + 1)).alias("last_level"))
    return both.select("it.*", "level", "last_level")


def nested(intervals: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Those intervals that nest, with their level (the outermost has 1), and those that cross others.

    An interval that crosses another begins and ends at different levels, or comes to once others are taken out; rounds
    take these out till none is left. If all begin and end at the same level, the first that ends is the last that
    began, so it crosses none, nor do those left without it.
    """
    crossed = None
    while True:
        rows = cut(levelled(intervals, by))
        out = rows.where("level <> last_level").select(*intervals.columns)
        if out.isEmpty():
            return rows.drop("last_level"), crossed if crossed is not None else out
        crossed = out if crossed is None else crossed.union(out)
        intervals = rows.where("level = last_level").select(*intervals.columns)


def enclosing(points: DataFrame, intervals: DataFrame, by: list[str]) -> DataFrame:
    """points (by, at and other columns) with begin, end: the innermost of nested intervals (by, begin, end) around each, null where there's none.

    An interval is around what lies between its begin and end, both left out. Points keep repeated rows.
    """
    none = F.lit(None).cast(points.select(F.struct(*points.columns).alias("p")).schema["p"].dataType)
    interval = F.struct("begin", "end")
    given = intervals.select(*by, "begin", "end").distinct()
    mark = lambda at, rank, step: F.struct(F.col(at).alias("at"), F.lit(rank).alias("rank"), F.lit(step).alias("step"))
    marks = given.select(*by, F.explode(F.array(mark("begin", 2, 1), mark("end", 0, -1))).alias("m"), interval.alias("it"), none.alias("point"))
    wanted = points.select(*by, mark("at", 1, 0).alias("m"), F.lit(None).cast(marks.schema["it"].dataType).alias("it"), F.struct(*points.columns).alias("point"))
    order = Window.partitionBy(*by).orderBy("m.at", "m.rank").rowsBetween(Window.unboundedPreceding, 0)
    rows = marks.unionByName(wanted).withColumn("level", F.sum("m.step").over(order)).where("m.step >= 0")
    same = Window.partitionBy(*by, "level").orderBy("m.at", "m.rank").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("around", F.when(F.col("level") > 0, F.last("it", ignorenulls=True).over(same)))
    return rows.where("m.step = 0").select("point.*", "around.begin", "around.end")
