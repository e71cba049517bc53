"""Names that may be alike, by an inverted index of their letters, and greedy matching of ranked pairs or of places, in rounds.

The ratio of two names can't exceed twice the letters they share over their lengths. A name's letters, numbered
where they repeat, make a set; names reach a ratio only if their sets overlap so far, and then the rarest letters
of each, as many as could be missed and one more, have one in common. Only names that meet so, in the same group,
are compared; the bound is then taken on the whole sets, and only pairs that pass it reach Python.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from tidemark.sources.shared import written


@pandas_udf(T.DoubleType())
def similarity(old: pd.Series, new: pd.Series) -> pd.Series:
    """Ratcliff/Obershelp ratio of two names without their case; the order of the two matters."""
    return pd.Series([SequenceMatcher(None, a.casefold(), b.casefold()).ratio() for a, b in zip(old, new)], dtype="float64")


@pandas_udf(T.ArrayType(T.StringType()))
def letters(names: pd.Series) -> pd.Series:
    """The letters of each name without its case, each with how often it came before."""

    def numbered(name: str) -> list[str]:
        seen: Counter[str] = Counter()
        out = []
        for c in name.casefold():
            out.append(f"{seen[c]}{c}")
            seen[c] += 1
        return out

    return names.map(numbered)


def indexed(names: DataFrame, group: Sequence[str], least: tuple[int, int]) -> DataFrame:
    """group, side, name, sorted (its letters, the rarest first) and head (those of which one must be shared). names: group, side, name."""
    each = names.select(*group, "side", "name").distinct().withColumn("letter", F.explode(letters("name")))
    often = each.groupBy("letter").agg(F.count(F.lit(1)).alias("often"))
    by_name = each.join(often, "letter").groupBy(*group, "side", "name").agg(F.sort_array(F.collect_list(F.struct("often", "letter"))).alias("s"))
    p, q = least
    n = F.size("sorted")
    kept = F.floor((p * n + 2 * q - p - 1) / (2 * q - p)).cast("int")  # at least so many letters are shared with whatever reaches the ratio
    return by_name.select(*group, "side", "name", F.col("s.letter").alias("sorted")).withColumn("head", F.slice("sorted", F.lit(1), n - kept + 1))


def reaches(shared: Column, a: Column, b: Column, least: tuple[int, int]) -> Column:
    return 2 * least[1] * shared >= least[0] * (a + b)


def candidates(old: DataFrame, new: DataFrame, group: Sequence[str], least: tuple[int, int]) -> DataFrame:
    """group, old, new, shared: the pairs of a group whose shared letters allow a ratio of least, a fraction. old, new: group and name.

    A pair meets under each letter that both heads hold; the first of them alone counts.
    """
    both = old.select(*group, "name").withColumn("side", F.lit(0)).unionByName(new.select(*group, "name").withColumn("side", F.lit(1)))
    names = written(indexed(both.where("name is not null"), group, least), "letters")
    one = names.where("side = 0").select(*group, F.col("name").alias("old"), F.col("sorted").alias("a"), F.col("head").alias("head_a"), F.explode("head").alias("letter"))
    two = names.where("side = 1").select(*group, F.col("name").alias("new"), F.col("sorted").alias("b"), F.col("head").alias("head_b"), F.explode("head").alias("letter"))
    n, m = F.size("a"), F.size("b")
    met = one.join(two, [*group, "letter"]).where(reaches(F.least(n, m), n, m, least))
    met = met.where(F.element_at(F.array_intersect("head_a", "head_b"), 1) == F.col("letter")).withColumn("shared", F.size(F.array_intersect("a", "b")))
    found = met.where(reaches(F.col("shared"), n, m, least)).select(*group, "old", "new", "shared")
    empty = [x.where("name = ''").select(*group, F.col("name").alias(c)).distinct() for x, c in ((old, "old"), (new, "new"))]
    return found.unionByName(empty[0].join(empty[1], list(group)).withColumn("shared", F.lit(0)))


def alike(old: DataFrame, new: DataFrame, group: Sequence[str], least: tuple[int, int]) -> DataFrame:
    """group, old, new, similarity: the pairs of a group whose ratio is least or more."""
    found = candidates(old, new, group, least).withColumn("similarity", similarity("old", "new"))
    return found.where(F.col("similarity") >= least[0] / least[1]).drop("shared")


def greedy(pairs: DataFrame, left: Sequence[str], right: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The pairs that are left when the best is taken, then the best of those whose ends are free, and so on.

    left and right: the columns of a pair's ends. order: columns by which the greatest is best; with the ends they
    decide between all pairs. A pair that is the best of both its ends is taken whatever happens elsewhere, so a
    round takes all such pairs of all groups at once; what they leave goes into the next round. Rounds are few unless
    ranks descend along a chain of pairs. A best is a maximum, combined before it is exchanged, so an end with very
    many pairs is no hot group.
    """
    ends = list(dict.fromkeys([*left, *right]))
    rank = F.struct(*order, *(c for c in ends if c not in order))
    rest, found = written(pairs.dropDuplicates(ends), "pairs"), []
    while not rest.isEmpty():
        best = [rest.groupBy(*x).agg(F.max(rank).alias(f"_best{i}")) for i, x in enumerate((left, right))]
        ranked = rest.join(best[0], list(left)).join(best[1], list(right))
        taken = ranked.where((rank == F.col("_best0")) & (F.col("_best0") == F.col("_best1"))).select(*pairs.columns)
        found.append(written(taken, "taken"))
        for x in (left, right):
            rest = rest.join(found[-1].select(*x), list(x), "left_anti")
        rest = written(rest, "pairs")
    out = rest
    for x in found:
        out = out.unionByName(x)
    return out.select(*pairs.columns)


def neighbours(free: DataFrame, group: Sequence[str], width: int) -> DataFrame:
    """group, at, lo (the least key on side 0 there), and by side d0, d1 (how far the other side's nearest place is, at most width, else null) with the one or two places that are so far (others0, others1).

    Windows pass over bands as wide as twice the width and more, so none grows beyond the places that a band can have.
    """
    has = lambda side: F.max(F.when(F.col("side") == side, F.lit(True))).alias(f"has{side}")
    places = free.groupBy(*group, "at").agg(has(0), has(1), F.min(F.when(F.col("side") == 0, F.col("key"))).alias("lo"))
    band = F.floor(F.col("at") / max(1, width))
    rows = places.withColumn("own", F.explode(F.array(*(F.lit(i) for i in (-1, 0, 1))))).withColumn("band", band + F.col("own"))
    up, down = (Window.partitionBy(*group, "band").orderBy(o).rowsBetween(Window.unboundedPreceding, 0) for o in (F.col("at"), F.col("at").desc()))
    for side, other in ((0, 1), (1, 0)):
        there = F.when(F.col(f"has{other}"), F.col("at"))
        rows = rows.withColumn(f"_below{side}", F.last(there, ignorenulls=True).over(up)).withColumn(f"_above{side}", F.last(there, ignorenulls=True).over(down))
    rows = rows.where("own = 0")
    found = [*group, "at", "lo"]
    for side in (0, 1):
        below, above = F.col(f"_below{side}"), F.col(f"_above{side}")
        d = F.least(F.col("at") - below, above - F.col("at"))
        found.append(F.when(F.col(f"has{side}") & (d <= width), d).alias(f"d{side}"))
        found.append(F.array_distinct(F.filter(F.array(below, above), lambda at: F.abs(at - F.col("at")) == d)).alias(f"others{side}"))  # noqa: B023
    return rows.select(*found)


def settled(places: DataFrame, group: Sequence[str]) -> DataFrame:
    """group, side, at, by, centre, apart, below: places whose best pairs are each other's, by what they share; of side 0 only keys less than below count, if it isn't null.

    A place of side 0 goes ahead if all its nearest ones have none nearer, as what nearer pairs leave may come first.
    Equally near places make chains in which the sides take turns. Around a place of side 1 whose neighbours have no
    other, all pairs can be taken in order of their keys; elsewhere a place of side 0 takes part with those of its keys
    that come before all of its rivals'.
    """
    ends = places.where("d0 is not null").select(*group, F.col("at").alias("x"), "lo", "d0", F.size("others0").alias("ys"))
    around = places.where("d1 is not null").select(*group, F.col("at").alias("y"), "d1", F.explode("others1").alias("x")).join(ends, [*group, "x"])
    around = around.groupBy(*group, "y", "d1").agg(F.collect_list(F.struct("x", "lo")).alias("xs"), F.bool_and((F.col("d0") == F.col("d1")) & (F.col("ys") == 1)).alias("star"))
    of_x = Window.partitionBy(*group, "x")
    edges = places.where("d0 is not null").select(*group, F.col("at").alias("x"), "lo", "d0", F.explode("others0").alias("y")).join(around, [*group, "y"])
    rivals = F.array_min(F.filter("xs", lambda r: r["x"] != F.col("x"))["lo"])
    edges = edges.withColumn("each", F.bool_and(F.col("d0") == F.col("d1")).over(of_x)).withColumn("below", F.min(F.when(~F.col("star"), rivals)).over(of_x))
    edges = edges.where("each and (star or below is null or lo < below)")
    by, centre = F.when(F.col("star"), 1).otherwise(0).alias("by"), F.when(F.col("star"), F.col("y")).otherwise(F.col("x")).alias("centre")
    side = lambda s, at: F.struct(F.lit(s).alias("side"), F.col(at).alias("at"))
    return edges.select(*group, F.explode(F.array(side(0, "x"), side(1, "y"))).alias("p"), by, centre, F.col("d0").alias("apart"), "below").select(*group, "p.*", "by", "centre", "apart", "below").distinct()


def nearest(left: DataFrame, right: DataFrame, group: Sequence[str], width: int) -> DataFrame:
    """group, left, right, apart: what is left when the nearest pair of a group is taken, then the nearest of what is free, and so on; of equally near ones the least left key, then the least right one.

    left, right: group, key, at (a whole number). Pairs are at most width apart and are never listed: a place's nearest
    ones are found by windows, and a round takes all pairs of all places that are each other's nearest. Keys at one
    place are taken together, so rounds don't grow with how many share a place. Rows with a null take no part; a key
    has one place in its group, of several the least.
    """
    sides = [x.groupBy(*group, "key").agg(F.min("at").alias("at")).withColumn("side", F.lit(s)) for s, x in enumerate(x.dropna(subset=[*group, "key", "at"]) for x in (left, right))]
    free, found = written(sides[0].unionByName(sides[1]), "free"), []
    while True:
        places = written(neighbours(free, group, width).where("d0 is not null or d1 is not null"), "places")
        members = free.join(settled(places, group), [*group, "side", "at"]).where("side = 1 or below is null or key < below")
        ranked = members.withColumn("rank", F.row_number().over(Window.partitionBy(*group, "by", "centre", "side").orderBy("key")))
        key = lambda s: F.max(F.when(F.col("side") == s, F.col("key")))
        pairs = ranked.groupBy(*group, "by", "centre", "rank").agg(key(0).alias("left"), key(1).alias("right"), F.max("apart").alias("apart"))
        taken = written(pairs.dropna(subset=["left", "right"]).select(*group, "left", "right", "apart"), "taken")
        found.append(taken)
        if taken.isEmpty():
            break
        gone = taken.select(*group, F.lit(0).alias("side"), F.col("left").alias("key")).union(taken.select(*group, F.lit(1).alias("side"), F.col("right").alias("key")))
        near = places.select(*group, "at", F.explode(F.array_compact(F.array(F.when(F.col("d0").isNotNull(), 0), F.when(F.col("d1").isNotNull(), 1)))).alias("side"))
        free = written(free.join(near, [*group, "at", "side"], "left_semi").join(gone, [*group, "side", "key"], "left_anti").select(free.columns), "free")
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out
