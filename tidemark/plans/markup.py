"""Registered queries over the markup of pages: spans masked and put back, elements nested and looked up; their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import masks, nesting
from tidemark.sources.shared import written
from tidemark.sources.warehouse import parquet

#: Elements that have no closing tag.
VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"]
#: Elements that a page's words are told apart by.
SECTIONS = ["article", "aside", "footer", "header", "main", "nav", "section"]


def pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.pieces(parquet(spark, sf_dir, "pages"), "page_id", "html")


def page_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments, scripts, styles and quoted attributes of every page, by code points."""
    found = masks.spans(pieces(spark, sf_dir))
    return found.select(F.col("key").alias("page_id"), "kind", F.col("begin").alias("opened"), F.col("end").alias("closed"), F.md5(F.encode("text", "utf-8")).alias("text_md5"))


def masked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page that has a text, masked, and what putting its spans back gives."""
    parts = written(pieces(spark, sf_dir), "pieces")
    shown = masks.masked(parts)
    back = masks.unmasked(shown, masks.spans(parts))
    digest = lambda c: F.md5(F.encode(c, "utf-8"))
    return shown.join(back, "key").select(F.col("key").alias("page_id"), (F.length(F.regexp_replace("masked", f"[^{masks.MARK}]", ""))).alias("n_spans"), digest("masked").alias("masked_md5"), digest("text").alias("restored_md5"))


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, at (its number in the page), name, step of all tags outside masked spans, but for those of void elements."""
    shown = masks.masked(pieces(spark, sf_dir))
    rows = shown.select(F.col("key").alias("page_id"), F.posexplode(F.regexp_extract_all("masked", F.lit("(?i)</?[a-z][a-z0-9]*[^>]*>"), F.lit(0))).alias("at", "tag"))
    name = F.lower(F.regexp_extract("tag", "(?i)^</?([a-z][a-z0-9]*)", 1))
    step = F.when(F.col("tag").startswith("</"), -1).otherwise(1)
    return rows.select("page_id", "at", name.alias("name"), step.alias("step")).where(~F.col("name").isin(VOID))


def elements(found: DataFrame) -> DataFrame:
    """page_id, name, begin, end, level of elements that are closed and cross no other."""
    return nesting.nested(nesting.pairs(found, ["page_id", "name"]), ["page_id"])[0]


def page_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The elements of every page, their levels and the opening tags of their parents (-1: none)."""
    found = elements(tags(spark, sf_dir))
    children = found.select("page_id", F.col("begin").alias("at"), "name", F.col("begin").alias("opened"), F.col("end").alias("closed"), "level")
    return nesting.enclosing(children, found, ["page_id"]).select("page_id", "name", "opened", "closed", "level", F.coalesce("begin", F.lit(-1)).alias("parent"))


def page_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every opening tag, closed or not, with the innermost section around it (-1: none)."""
    found = written(tags(spark, sf_dir), "tags")
    sections = elements(found).where(F.col("name").isin(SECTIONS))
    placed = nesting.enclosing(found.where("step > 0").select("page_id", "at", "name"), sections, ["page_id"])
    named = placed.join(sections.select("page_id", "begin", F.col("name").alias("section")), ["page_id", "begin"], "left")
    return named.select("page_id", F.col("at").alias("place"), "name", F.coalesce("begin", F.lit(-1)).alias("section_at"), "section")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (page_spans, masked_pages, page_elements, page_scopes)}

WHOLE = rf"""(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script>|\z)|<style\b.*?(?:</style>|\z)|<[a-z/!](?:[^>"'']|"[^"]*(?:"|\z)|''[^'']*(?:''|\z))*(?:>|\z)|[^<{masks.MARK}]+|{masks.MARK}|<"""
IN_TAG = rf"""(?s)"[^"]*"?|''[^'']*''?|{masks.MARK}|[^"''{masks.MARK}]+"""
#: w: page_id, i, j, word, kind of every word of pages, in order; kept words have no kind.
WORDS = f"""a as (select page_id, unnest(t) as token, generate_subscripts(t, 1) as i from (select page_id, regexp_extract_all(html, '{WHOLE}') as t from pages)),
b as (select *, case when token like '<!--%' then 'comment' when regexp_matches(token, '(?i)^<script\\b') then 'script' when regexp_matches(token, '(?i)^<style\\b') then 'style' when token = '{masks.MARK}' then 'mark' end as kind from a),
c as (select page_id, i, kind, if(kind is null and regexp_matches(token, '(?i)^<[a-z/!]'), regexp_extract_all(token, '{IN_TAG}'), [token]) as t from b),
w as (select page_id, i, j, word, case when kind is not null then kind when len_t > 1 and word = '{masks.MARK}' then 'mark' when len_t > 1 and word[1] in ('"', '''') then 'quoted' end as kind
      from (select page_id, i, kind, len(t) as len_t, unnest(t) as word, generate_subscripts(t, 1) as j from c))"""
MASKED = f"m as (select page_id, string_agg(if(kind is null, word, '{masks.MARK}'), '' order by i, j) as masked, count(kind) as n_spans, string_agg(word, '' order by i, j) as whole from w group by page_id)"
TAGS = f"""{WORDS}, {MASKED},
t0 as (select page_id, unnest(t) as tag, cast(generate_subscripts(t, 1) - 1 as int) as place from (select page_id, regexp_extract_all(masked, '(?i)</?[a-z][a-z0-9]*[^>]*>') as t from m)),
t1 as (select page_id, place, lower(regexp_extract(tag, '(?i)^</?([a-z][a-z0-9]*)', 1)) as name, if(tag like '</%', -1, 1) as step from t0),
t as materialized (select *, sum(step) over (partition by page_id, name order by place) as d from t1 where name not in ({", ".join(f"'{v}'" for v in VOID)})),
e as materialized (select o.page_id, o.name, o.place as opened, min(c.place) as closed from t o join t c on o.page_id = c.page_id and o.name = c.name and c.place > o.place and c.d < o.d where o.step = 1 group by all)"""
ORACLE_SQL: dict[str, str] = {
    "page_spans": f"""with {WORDS}, p as (select *, sum(length(word)) over (partition by page_id order by i, j) as upto from w)
select page_id, kind, cast(upto - length(word) as int) as opened, cast(upto as int) as closed, md5(word) as text_md5 from p where kind is not null""",
    "masked_pages": f"with {WORDS}, {MASKED} select page_id, cast(n_spans as int) as n_spans, md5(masked) as masked_md5, md5(html) as restored_md5 from m join pages using (page_id)",
    # The tables' elements don't cross, so none is left out.
    "page_elements": f"""with {TAGS} select e.page_id, e.name, e.opened, e.closed, cast(1 + count(u.opened) as bigint) as level, coalesce(max(u.opened), -1) as parent
from e left join e u on u.page_id = e.page_id and u.opened < e.opened and u.closed > e.closed group by e.page_id, e.name, e.opened, e.closed""",
    "page_scopes": f"""with {TAGS}, s as (select * from e where name in ({", ".join(f"'{v}'" for v in SECTIONS)})),
f as (select t.page_id, t.place, t.name, coalesce(max(s.opened), -1) as section_at from t left join s on s.page_id = t.page_id and s.opened < t.place and s.closed > t.place where step = 1 group by t.page_id, t.place, t.name)
select f.page_id, place, f.name, section_at, s.name as section from f left join s on s.page_id = f.page_id and s.opened = f.section_at""",
}
