"""Repairs as edits of a table of code lines.

Only assets that require a patch change. A line is edited at the words where the table of references says
that they name the column; literals, comments and all other text stay to the byte.
"""

from __future__ import annotations

import difflib
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import references


def _referring(code: DataFrame, patch: DataFrame, column: str) -> DataFrame:
    """code with its words, and refs: where, among a line's words, an asset to patch (asset_urn) names the column; null if nowhere.

    bare and cast: where it is a select item of its own, and where a cast holds it.
    """
    found = references.matching(references.find(code), column).join(patch.select("asset_urn").distinct(), "asset_urn", "left_semi")
    where = lambda c: F.collect_set(F.when(F.col(c), F.col("at"))).alias(c)
    found = found.groupBy("asset_urn", "line").agg(F.collect_set("at").alias("refs"), where("bare"), where("cast"))
    return references.split(code).join(found, ["asset_urn", "line"], "left")


def _edited(edit: Callable[[Column, Column], Column]) -> Column:
    """A line whose words are edited by place; all other text, comments too, stays to the byte.

    edit takes a word with the blanks before it, and its place.
    """
    rest = F.substring(F.col("text"), F.length(F.array_join("words", "")) + 1, F.length("text"))
    return F.when(F.col("refs").isNull(), F.col("text")).otherwise(F.concat(F.array_join(F.transform("words", edit), ""), rest))


def rename(code: DataFrame, patch: DataFrame, old: str, new: str) -> DataFrame:
    """Every reference by its new name, in the case it is written in. An output called by its input is then renamed as well."""

    def edit(word: Column, at: Column) -> Column:
        name = F.trim(word)
        to = F.when(name == F.upper(name), F.lit(new.upper())).when(name == F.lower(name), F.lit(new.lower())).otherwise(F.lit(new))
        return F.when(F.array_contains("refs", at), F.concat(F.substring(word, F.lit(1), F.length(word) - F.length(name)), to)).otherwise(word)

    return _referring(code, patch, old).withColumn("text", _edited(edit)).select(*code.columns)


def retype(code: DataFrame, patch: DataFrame, column: str, old_type: str) -> DataFrame:
    """Every reference cast back to its old type, unless it is; a select item of its own keeps its name."""
    done = F.col("text").rlike(rf"(?i)cast\(\s*(\w+\.)?{re.escape(column)}\s+as\s+{re.escape(old_type)}\s*\)")
    goes = lambda at: F.array_contains("refs", at) & ~(done & F.array_contains("cast", at))

    def edit(word: Column, at: Column) -> Column:
        word_at = lambda i: F.coalesce(F.trim(F.get("words", i)), F.lit(""))
        ends = goes(at)
        begins = F.when(word_at(at + 1) == ".", goes(at + 2)).otherwise(ends & (word_at(at - 1) != "."))
        name = F.trim(word)
        blanks = F.substring(word, F.lit(1), F.length(word) - F.length(name))
        named = F.when(F.array_contains("bare", at), F.concat(F.lit(f" AS {old_type}) AS "), name)).otherwise(F.lit(f" AS {old_type})"))
        return F.concat(blanks, F.when(begins, F.lit("CAST(")).otherwise(F.lit("")), name, F.when(ends, named).otherwise(F.lit("")))

    return _referring(code, patch, column).withColumn("text", _edited(edit)).select(*code.columns)


def drop(code: DataFrame, patch: DataFrame, column: str, dated: str) -> DataFrame:
    """Select items that read the column become comments; when the last item goes, the one before loses its comma.

    Uses outside a select list stay, for validation to stop.
    """
    rows = _referring(code, patch, column)
    item = F.col("refs").isNotNull() & ~F.lower(F.ltrim("text")).rlike(r"^(from|where|join|left|on|group|select)\b")
    rows = rows.withColumn("goes", item)
    note = F.concat(F.lit(f"    -- {dated}: `{column}` was dropped upstream; TODO review: "), F.trim("text"))
    gone = rows.where("goes").select("asset_urn", F.col("line").alias("gone"), (~F.rtrim("text").endswith(",")).alias("was_last"))
    last = gone.where("was_last").groupBy("asset_urn").agg(F.min("gone").alias("gone"))
    before = rows.where(~F.col("goes")).join(last, "asset_urn").where(F.col("line") < F.col("gone")).groupBy("asset_urn").agg(F.max("line").alias("line")).withColumn("trims", F.lit(True))
    rows = rows.join(before, ["asset_urn", "line"], "left")
    text = F.when(F.col("goes"), note).when(F.col("trims"), F.regexp_replace("text", r",\s*$", "")).otherwise(F.col("text"))
    return rows.withColumn("text", text).select(*code.columns)


def diff(before: list[str], after: list[str], path: str) -> str:
    """The unified diff of one file."""
    return "".join(difflib.unified_diff([x + "\n" for x in before], [x + "\n" for x in after], f"a/{path}", f"b/{path}"))


def patches(before: DataFrame, after: DataFrame) -> DataFrame:
    """asset_urn, asset, before, after, changed_lines of the files that changed."""
    both = before.select("asset_urn", "asset", "line", F.col("text").alias("old")).join(after.select("asset_urn", "line", F.col("text").alias("new")), ["asset_urn", "line"])
    joined = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", c))), lambda x: x[c]), "\n")
    return both.groupBy("asset_urn", "asset").agg(joined("old").alias("before"), joined("new").alias("after"), F.count_if(F.col("old") != F.col("new")).alias("changed_lines")).where("changed_lines > 0")
