"""Column references in code, found by classifying words in a table of code lines.

Code is rows of asset, line and text. Lines become rows of words, and a word is a column reference unless its
neighbours say otherwise: it names a table after from or join or an alias of one, qualifies another word,
is called, follows `as`, or is one of the workload's keywords. Windows over each asset look at neighbours,
so assets spread over the cluster and no text is parsed as a whole. This grammar is narrow on purpose, that
of the workload; what else a statement holds, Spark's own analysis judges (operators.analysis).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import nesting
from tidemark.operators.lineage import cut

#: Words of the workload's SQL that are never columns.
KEYWORDS = ["select", "from", "where", "group", "by", "left", "join", "on", "as", "with", "and", "or", "not", "is", "null", "false", "true", "case", "when", "then", "else", "end", "day", "inner", "distinct", "having", "order", "limit", "in", "like", "between", "over", "partition", "asc", "desc", "union", "all", "exists", "interval"]
#: A literal, a quoted name, a comment (to its end, or the line's), a name, a number or a sign; what comes first in a line decides.
#: Words that begin a clause.
CLAUSES = ["select", "from", "where", "group", "having", "order", "limit", "on"]
WORD = r"""'[^']*'|"[^"]*"|--.*$|/\*.*?(?:\*/|$)|\{\w+\}|:?[A-Za-z_]\w*|\d+|<>|[^\s\w]"""
#: What a comment that an earlier line opened takes of a line: all of it, or up to its end.
REST = r"^(?:(?!\*/).)*(?:\*/|$)"


def split(code: DataFrame) -> DataFrame:
    """code with words: the line's words, each with the blanks before it; of a line that begins in a comment, the comment's rest is the first.

    Whether a line ends in a comment doesn't depend on the lines before unless it neither opens nor closes one, so
    the last line that does tells for all after it.
    """
    parts = lambda text: F.regexp_extract_all(text, F.lit(rf"\s*(?:{WORD})"), F.lit(0))
    opens = lambda words: F.exists(words, lambda w: F.ltrim(w).startswith("/*") & ~w.endswith("*/"))
    rest = F.regexp_extract("text", REST, 0)
    inside, outside = F.concat(F.array(rest), parts(F.substring(F.col("text"), F.length(rest) + 1, F.length("text")))), parts(F.col("text"))
    rows = code.withColumn("_out", outside).withColumn("_in", inside)
    ends = F.when(opens(F.col("_out")), True).when(F.contains("text", F.lit("*/")), opens(F.col("_in")))
    before = Window.partitionBy("asset_urn").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    begins = F.coalesce(F.last(ends, ignorenulls=True).over(before), F.lit(False))
    return rows.withColumn("words", F.when(begins, F.col("_in")).otherwise(F.col("_out"))).withColumn("commented", begins).drop("_in", "_out")


def words(code: DataFrame) -> DataFrame:
    """asset_urn, asset, kind, line, at (its number in the line), word; comments aren't words, but are numbered."""
    rows = split(code).select("asset_urn", "asset", "kind", "line", "commented", F.posexplode("words").alias("at", "word"))
    comment = (F.col("commented") & (F.col("at") == 0)) | F.ltrim("word").startswith("--") | F.ltrim("word").startswith("/*")
    return rows.where(~comment).select("asset_urn", "asset", "kind", "line", "at", F.trim("word").alias("word"))


def placed(code: DataFrame) -> DataFrame:
    """words with their neighbours in lower case, and scope: the subquery that a word is in, else the local table whose body it is in, else null.

    A subquery's scope is named by its local table, if any, and its place: opens and closes tell where it does, parent
    the scope around it. What is placed already stays as it is.
    """
    if "parent" in code.columns:
        return code
    order = Window.partitionBy("asset_urn").orderBy("line", "at")
    low = F.lower("word")
    rows = words(code).withColumn("low", low)
    for n in (1, 2, 3, 4):
        rows = rows.withColumn(f"prev{n}", F.coalesce(F.lag("low", n).over(order), F.lit("")))
    for n in (1, 2):
        rows = rows.withColumn(f"next{n}", F.coalesce(F.lead("low", n).over(order), F.lit("")))
    depth = F.sum(F.when(F.col("word") == "(", 1).when(F.col("prev1") == ")", -1).otherwise(0)).over(order)
    rows = rows.withColumn("depth", depth)
    opens = (F.col("word") == "(") & (F.col("prev1") == "as") & (F.col("depth") == 1)
    outer = F.when((F.col("word") == "(") & (F.col("depth") == 1), F.when(opens, F.col("prev2")).otherwise(""))
    rows = rows.withColumn("body", F.last(outer, ignorenulls=True).over(order))
    rows = rows.withColumn("local", F.when((F.col("depth") > 0) & (F.col("body") != ""), F.col("body"))).withColumn("n", F.row_number().over(order))
    step = F.when(F.col("word") == "(", 1).when(F.col("word") == ")", -1).otherwise(0)
    rows = nesting.within(rows, ["asset_urn"], "n", step, (F.col("next1") == "select") & ~opens)
    rows = rows.withColumn("scope", F.when(F.col("inside").isNotNull(), subquery("inside")).otherwise(F.col("local")))
    rows = rows.withColumn("parent", F.lag("scope").over(order)).drop("inside")
    clause = F.last(F.when(F.col("low").isin(*CLAUSES), F.struct("low", "depth")), ignorenulls=True).over(order)
    return rows.withColumn("clause", clause)


def subquery(place: str | Column) -> Column:
    """The scope of the subquery that opens at a place."""
    return F.concat(F.coalesce("local", F.lit("")), F.lit("#"), F.col(place) if isinstance(place, str) else place)


def visible(code: DataFrame) -> DataFrame:
    """asset_urn, scope, outer, distance: the scopes whose tables a scope's words may mean, nearest first: its own and, but for what stands in place of a table, those around it."""
    rows = cut(placed(code).select("asset_urn", "scope", "parent", "opens", "prev1"))
    around = rows.where("opens and prev1 not in ('from', 'join')").select("asset_urn", F.col("scope").alias("outer"), "parent")
    found = frontier = cut(rows.select("asset_urn", "scope", F.col("scope").alias("outer"), F.lit(0).alias("distance")).distinct())
    while not frontier.isEmpty():
        frontier = cut(frontier.join(around, ["asset_urn", "outer"]).select("asset_urn", "scope", F.col("parent").alias("outer"), (F.col("distance") + 1).alias("distance")))
        found = found.union(frontier)
    return found


def tables(code: DataFrame) -> DataFrame:
    """asset_urn, scope, alias, target: what each name of a table stands for; target is {input}, a local table or the scope of a subquery."""
    rows, is_name = placed(code), lambda c: F.col(c).rlike("^[a-z_]\\w*$") & ~F.col(c).isin(*KEYWORDS)
    named = F.when(is_name("next1"), F.col("next1")).when((F.col("next1") == "as") & is_name("next2"), F.col("next2"))
    own = F.regexp_replace("low", "[{}]", "")
    plain = rows.where(F.col("prev1").isin("from", "join") & (F.col("word") != "("))
    begun = rows.where(F.col("opens") & F.col("prev1").isin("from", "join")).select("asset_urn", F.col("n").alias("closes"))
    derived = rows.join(begun, ["asset_urn", "closes"], "left_semi")
    found = plain.select("asset_urn", "scope", F.coalesce(named, own).alias("alias"), F.col("low").alias("target"))
    return found.union(derived.select("asset_urn", "scope", F.coalesce(named, F.lit("")), subquery("closes"))).distinct()


def find(code: DataFrame) -> DataFrame:
    """asset_urn, asset, kind, line, at, scope, qualifier, name, bare (it is an item of a select list, with no name of its own) and cast (it is all that a cast holds)."""
    rows = placed(code)
    is_name = F.col("word").rlike("^[A-Za-z_]\\w*$") & ~F.col("low").isin(*KEYWORDS)
    is_table = F.col("prev1").isin("from", "join")
    is_alias = F.col("prev2").isin("from", "join") & (F.col("prev1") != ".")
    is_local = (F.col("next1") == "as") & (F.col("next2") == "(")
    # A name right after a bracket is what the bracket is called.
    used = is_name & (F.col("prev1") != ")") & ~is_table & ~is_alias & ~is_local & (F.col("prev1") != "as") & ~F.col("next1").isin("(", ".")
    qualifier = F.when(F.col("prev1") == ".", F.col("prev2"))
    ahead = F.when(F.col("prev1") == ".", F.col("prev3")).otherwise(F.col("prev1"))
    listed = (F.col("clause.low") == "select") & (F.col("clause.depth") == F.col("depth"))
    bare = listed & ahead.isin("select", "distinct", ",") & F.col("next1").isin(",", "from", "")
    cast = (ahead == "(") & (F.when(F.col("prev1") == ".", F.col("prev4")).otherwise(F.col("prev2")) == "cast") & (F.col("next1") == "as")
    return rows.where(used).select("asset_urn", "asset", "kind", "line", "at", "scope", qualifier.alias("qualifier"), F.col("word").alias("name"), bare.alias("bare"), cast.alias("cast"))


def matching(references: DataFrame, column: str) -> DataFrame:
    """References to a column by its name alone, whatever its case."""
    return references.where(F.lower("name") == column.lower())


def locations(references: DataFrame, *by: str) -> DataFrame:
    """by (asset_urn alone if not given), n_references, lines, located (as reports word it)."""
    found = references.groupBy(*(by or ("asset_urn",))).agg(F.count(F.lit(1)).alias("n_references"), F.sort_array(F.collect_set("line")).alias("lines"))
    times: Column = F.when(F.col("n_references") == 1, "once").otherwise(F.concat(F.col("n_references").cast("string"), F.lit(" times")))
    label = F.when(F.size("lines") == 1, " on line ").otherwise(" on lines ")
    return found.withColumn("located", F.concat(times, label, F.array_join(F.col("lines").cast("array<string>"), ", ")))
