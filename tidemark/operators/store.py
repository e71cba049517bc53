"""Stored tables of records, one for each key, that change sets are merged into.

A table is Parquet, partitioned by a hash of the columns that `by` names. Each value column is kept with the version
that it comes from; the value of the greatest version stays, or under the rule "first" that of the least, of equal
versions the greatest (least) value, and nulls never replace anything. So it doesn't matter in which order change
sets come, whether versions repeat in one, or how often one comes.

Merging reads the partitions that a change set touches, and overwrites those of them whose records change, by
dynamic partition overwrite; the others' files stay as they are, and merging a set again writes nothing. What is
about to be written is written beside the table first. If a driver is lost while partitions are being exchanged,
the next merge finds it there and puts it in, as it puts in a change set.

Defined results: records with a null key are left out, as are changes without a version; an empty change set
changes nothing. One writer at a time.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AT = "version"


@dataclass(frozen=True)
class Records:
    """path, keys, values with their types, by (keys that partitions come from; all if not given), rules by value column, and how many partitions."""

    path: str
    keys: dict[str, str]
    values: dict[str, str] = field(default_factory=dict)
    by: tuple[str, ...] = ()
    rules: dict[str, str] = field(default_factory=dict)
    parts: int = 64

    @property
    def part(self) -> Column:
        return F.pmod(F.xxhash64(*(self.by or self.keys)), F.lit(self.parts)).cast("int").alias("part")

    @property
    def schema(self) -> str:
        columns = {**self.keys, **{k: v for c, t in self.values.items() for k, v in ((c, t), (f"{c}_{AT}", "long"))}, "part": "int"}
        return ", ".join(f"`{c}` {t}" for c, t in columns.items())

    def known(self) -> Column:
        found = F.lit(True)
        for k in self.keys:
            found = found & F.col(k).isNotNull()
        return found


def exists(spark: SparkSession, path: str) -> bool:
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    return file.getFileSystem(spark._jsc.hadoopConfiguration()).exists(file)


def stored(spark: SparkSession, table: Records) -> DataFrame:
    found = exists(spark, table.path)
    return spark.read.schema(table.schema).parquet(table.path) if found else spark.createDataFrame([], table.schema)


def awaiting(spark: SparkSession, table: Records) -> DataFrame:
    """What is pending, if it was written to its end."""
    found = exists(spark, f"{pending(table)}/_SUCCESS")
    return spark.read.schema(table.schema).parquet(pending(table)) if found else spark.createDataFrame([], table.schema)


def read(spark: SparkSession, table: Records) -> DataFrame:
    """The records: keys and values."""
    return stored(spark, table).where(table.known()).select(*table.keys, *table.values)


def pending(table: Records) -> str:
    return f"{table.path}.pending"


def touched(rows: DataFrame) -> list[int]:
    """The partitions of rows; at most as many as a table has."""
    return sorted(r["part"] for r in rows.select("part").distinct().collect())


def exchange(spark: SparkSession, table: Records, parts: list[int]) -> None:
    """What is pending, in place of what these partitions hold; each partition is written by tasks of its own, by several if a shuffle has more tasks than the table partitions."""
    rows = awaiting(spark, table).where(F.col("part").isin(parts))
    shares = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // table.parts)
    rows.repartition("part", F.pmod(F.xxhash64(*table.keys), F.lit(shares))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(table.path)


def best(table: Records, column: str, of: Column | None = None) -> Column:
    """The version and the value that stay, of the rows that `of` marks."""
    rule = F.min if table.rules.get(column) == "first" else F.max
    has = F.col(column).isNotNull() & F.col(f"{column}_{AT}").isNotNull()
    return rule(F.when(has if of is None else has & of, F.struct(f"{column}_{AT}", column)))


def merge(spark: SparkSession, table: Records, changes: DataFrame) -> list[int]:
    """Puts changes (the keys, version, and any of the values) into a table; the partitions that were rewritten."""
    given = [c for c in table.values if c in changes.columns]
    delta = changes.where(table.known()).select(*(F.col(k).cast(t).alias(k) for k, t in table.keys.items()), *(F.col(c).cast(table.values[c]).alias(c) for c in given), *(F.col(AT).cast("long").alias(f"{c}_{AT}") for c in given), table.part)
    delta = delta.groupBy(*table.keys, "part").agg(F.count(F.lit(1)), *(best(table, c).alias(c) for c in given)).select(*table.keys, "part", *(F.col(f"{c}.*") for c in given))
    left = awaiting(spark, table)
    parts = sorted({*touched(delta), *touched(left)})
    held = F.col("_held")
    now = stored(spark, table).where(F.col("part").isin(parts)).withColumn("_held", F.lit(True))
    rows = now.unionByName(left.unionByName(delta, allowMissingColumns=True).withColumn("_held", F.lit(False)))
    both = rows.where(table.known()).groupBy(*table.keys, "part").agg(F.max("_held").alias("_was"), *(best(table, c).alias(f"_new_{c}") for c in table.values), *(best(table, c, held).alias(f"_old_{c}") for c in table.values))
    changed = ~F.col("_was")
    for c in table.values:
        changed = changed | ~F.col(f"_new_{c}").eqNullSafe(F.col(f"_old_{c}"))
    values = [F.col(f"_new_{c}")[x].alias(x) for c in table.values for x in (c, f"{c}_{AT}")]
    merged = both.select(*table.keys, *values, "part", changed.alias("_changed"))
    staging = f"{table.path}.merged"
    merged.write.mode("overwrite").parquet(staging)
    merged = spark.read.parquet(staging)
    parts = touched(merged.where("_changed"))
    if parts:
        merged.where(F.col("part").isin(parts)).drop("_changed").write.mode("overwrite").parquet(pending(table))
        exchange(spark, table, parts)
    return parts


def replace(spark: SparkSession, table: Records, groups: DataFrame, rows: DataFrame) -> list[int]:
    """Puts rows in place of all records of the groups, which are values of the columns that `by` names; the partitions that were rewritten.

    Rows of other groups are ignored. A partition that loses all its records keeps one row without keys, as
    overwriting doesn't remove it.
    """
    groups = groups.select(*table.by).distinct().withColumn("part", table.part)
    parts = touched(groups)
    if not parts:
        return parts
    added = rows.where(table.known()).join(groups.select(*table.by), list(table.by), "left_semi").withColumn("part", table.part)
    added = added.select(*table.keys, *table.values, *(F.col(AT).cast("long").alias(f"{c}_{AT}") for c in table.values), "part").distinct()
    now = stored(spark, table).where(F.col("part").isin(parts)).where(table.known())
    kept = now.join(groups.select(*table.by), list(table.by), "left_anti")
    none = spark.createDataFrame([(p,) for p in parts], "part int")
    found = kept.unionByName(added).unionByName(none, allowMissingColumns=True)
    found.write.mode("overwrite").parquet(pending(table))
    exchange(spark, table, parts)
    spark.createDataFrame([], table.schema).write.mode("overwrite").parquet(pending(table))  # taken records must not come back
    return parts


def notes(path: str, values: dict[str, str], **options) -> Records:
    """Descriptions and other fields of a dataset's columns; fields that a change leaves out stay."""
    return Records(path, {"dataset_urn": "string", "name": "string"}, values, **options)


def tags(path: str, **options) -> Records:
    return Records(path, {"urn": "string", "field": "string", "tag": "string"}, **options)


def incidents(path: str, **options) -> Records:
    """By their id. A review's status has a greater version than triage, so it stays."""
    return Records(path, {"id": "string"}, {"drift": "string", "dataset_urn": "string", "column": "string", "status": "string"}, **options)


def links(path: str, **options) -> Records:
    """By dataset and address; the label that came first stays."""
    return Records(path, {"urn": "string", "url": "string"}, {"label": "string"}, rules={"label": "first"}, **options)


def edges(path: str, **options) -> Records:
    """Column lineage, replaced by the dataset that edges lead into."""
    return Records(path, {"up_urn": "string", "up_path": "string", "down_urn": "string", "down_path": "string"}, {"operation": "string"}, by=("down_urn",), **options)
