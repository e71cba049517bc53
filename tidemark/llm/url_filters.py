"""Operator 9: URL filters by host-suffix and path-prefix expressions.

A URL's host and path expand into the expressions that a rule could name: its last n labels, for every
number of labels that some rule has, joined to the first m characters of its path, for every path length
that some rule has. Expressions equi-join the rules on the first 32 bits of their SHA-256; the full
digests then confirm, and the longest rule wins (ties: longer host, then block before allow).

Both lists of lengths come from the rules and are at most as long as the longest rule; URLs multiply by
no more than that, whatever the number of rules. Only DataFrame functions are used.

Defined results: a null URL, or one without `://`, has an empty host and path; what no rule fits gets the
default verdict and a null rule; equal rows and null ids are kept; of a very long URL only prefixes as long as
some rule expand; empty tables of pages or rules are defined; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, host, path."""
    at = F.coalesce(F.locate("://", F.col("url")), F.lit(0))
    rest = F.when(at > 0, F.expr("substring(url, locate('://', url) + 3)")).otherwise("")
    pages = pages.select("page_id", rest.alias("_rest"))
    host = F.translate(F.regexp_extract("_rest", "^[^/?#]*", 0), UPPER, LOWER)
    return pages.select("page_id", host.alias("host"), F.regexp_extract("_rest", "^[^/?#]*([^?#]*)", 1).alias("path"))


def digested(expression: Column) -> list[Column]:
    digest = F.sha2(expression, 256)
    return [F.substring(digest, 1, 8).alias("prefix"), digest.alias("digest")]


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict. rules: host (lower case), path (empty or from /), verdict."""
    urls = parsed(pages)
    n_labels = F.size(F.split("host", r"\."))
    lengths = rules.agg(F.sort_array(F.collect_set(n_labels)).alias("labels"), F.sort_array(F.collect_set(F.length("path"))).alias("chars")).first()
    if not lengths["labels"]:
        return urls.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    labels, chars = (F.array(*map(F.lit, lengths[k])) for k in ("labels", "chars"))

    parts = F.split("host", r"\.")
    hosts = F.transform(F.filter(labels, lambda n: n <= F.size(parts)), lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "."))
    paths = F.transform(F.filter(chars, lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    expanded = urls.select("host", "path", F.explode(hosts).alias("h")).select("host", "path", "h", F.explode(paths).alias("p"))
    expanded = expanded.select("host", "path", *digested(F.concat("h", "p")))

    named = rules.select(F.concat("host", "path").alias("rule"), F.length("host").alias("host_length"), "verdict")
    named = named.select("*", *digested(F.col("rule")))
    confirmed = expanded.join(named.withColumnRenamed("digest", "full"), "prefix").where(F.col("digest") == F.col("full"))
    order = F.struct(F.length("rule"), "host_length", F.col("verdict").alias("v"), F.col("rule").alias("r"))
    best = confirmed.groupBy("host", "path").agg(F.max(order).alias("best"))
    best = best.select("host", "path", F.col("best.r").alias("rule"), F.col("best.v").alias("v"))
    return urls.join(best, ["host", "path"], "left").select("page_id", "host", "path", "rule", F.coalesce("v", F.lit(default)).alias("verdict"))
