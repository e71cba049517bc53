"""The registered queries of the numbered operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import clustering, clustering_sql, conversations, conversations_sql, id_files, language, lm, packing, pieces, pii, quality, simhash, topk, toxicity, url_filters
from tidemark.llm.common import fold, new_path, table
from tidemark.llm.tokens import BLANKS_DROPPED, BLANKS_KEPT, vocabulary

#: The rules that op9 judges by.
URL_RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0)
    scored = toxicity.score(docs, toxicity.learn(docs, labels))
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted", F.size("spans").alias("n_offending"))


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.checked(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op3_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = lm.score(docs, fold("doc_id", 7) != 2)
    return scored.select("doc_id", (fold("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "ids")
    id_files.write_ids(table(spark, sf_dir, "documents"), path, vocabulary("byte_bpe_50k.json"), BLANKS_KEPT, 2)
    return id_files.read_ids(spark, path, "doc_id long, start long, n_tokens long, ids_crc32 long", id_files.digests)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judged(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", *quality.COUNTS, "base_failed", "kept")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = packing.pieces(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), BLANKS_DROPPED, 1, 2048, digest=True)
    return packing.pack(cut, 2048)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.grouped(table(spark, sf_dir, "documents")).drop("component")


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(URL_RULES), "host string, path string, verdict string")
    return url_filters.judge(table(spark, sf_dir, "pages"), rules)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.learn(docs.where(fold("doc_id", 3) != 1))
    found = language.classify(docs, model)
    return found.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "accepted")


def op11_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster(table(spark, sf_dir, "embeddings"))


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.counted(pii.find(table(spark, sf_dir, "documents")))


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.audited(conversations.damage(table(spark, sf_dir, "conversations")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_pieces, op3_lm, op4_token_ids, op5_quality, op6_packing, op7_simhash, op8_topk, op9_url_filters, op10_language,
        op11_clusters, op12_pii, op13_conversations,
    )
}

OP5_SQL = r"""
with d as (select row_number() over () as r, doc_id, source, coalesce(text, '') as text from documents),
w as (
  select r, unnest(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+')) as word,
         generate_subscripts(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+'), 1) as i
  from d
),
per as (select r, count(*) as n_words, sum(length(word)) as word_chars from w group by r),
grams as (
  select r, i, string_agg(word, ' ') over (partition by r order by i rows between current row and 7 following) as gram,
         count(*) over (partition by r order by i rows between current row and 7 following) as n
  from w
),
often as (select r, i from (select r, i, count(*) over (partition by r, gram) as times from grams where n = 8) where times > 1),
covered as (select r, count(distinct i + k) as n_repeat_words from often, range(8) as t(k) group by r),
lines as (select r, unnest(string_split(text, chr(10))) as line from d),
dups as (select r, count(*) - count(distinct line) as n_dup_lines from lines where regexp_matches(line, '[^ \t\n\x0B\f\r]') group by r),
m as (
  select d.r, doc_id, coalesce('=' || source, '') as host, coalesce(n_words, 0) as n_words, cast(coalesce(word_chars, 0) as bigint) as word_chars,
         cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
         coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words
  from d left join per using (r) left join dups using (r) left join covered using (r)
),
b as (
  select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed, 10 * n_symbols > word_chars as signs_failed,
         10 * n_dup_lines > n_words as lines_failed, n_words > 0 and (word_chars < 2 * n_words or word_chars > 15 * n_words) as lengths_failed
  from m
),
failed as (unpivot (select host, cast(base_failed as int) as base, cast(signs_failed as int) as signs, cast(lines_failed as int) as lines, cast(lengths_failed as int) as lengths from b)
           on base, signs, lines, lengths into name rule value failed),
h as (select rule, host, count(*) as n, sum(failed) as f from failed group by rule, host),
s as (select rule, sum(f) / sum(n) as mean, sum(f * f / n) / sum(n) as squares, count(*) / sum(n) as spread from h group by rule),
p as (select rule, mean, least(greatest(mean * (1 - mean) / greatest(squares - mean * mean - spread * mean * (1 - mean), 1e-6) - 1, 1.0), 1e6) as weight from s),
v as (select host, max((f + mean * weight) / (n + weight)) as rate from h join p using (rule) group by host)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and rate < 0.5 as kept
from b join v using (host)
"""

OP9_SQL = f"""
with r(rhost, rpath, verdict) as (values {", ".join(str(r) for r in URL_RULES)}),
p as (select page_id, case when position('://' in url) > 0 then substr(url, position('://' in url) + 3) else '' end as rest from pages),
u as (
  select page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{url_filters.UPPER}', '{url_filters.LOWER}') as host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
  from p
),
best as (
  select host, path, rhost || rpath as rule, verdict,
         row_number() over (partition by host, path order by length(rhost || rpath) desc, length(rhost) desc, verdict desc) as k
  from (select distinct host, path from u) join r on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath)
)
select page_id, u.host, u.path, rule, coalesce(verdict, 'allow') as verdict
from u left join best on u.host = best.host and u.path = best.path and k = 1
"""

OP8_SQL = """
with r as (
  select row_number() over () as r, vec_id, [cast(x as double) for x in embedding] as x from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
),
e as (
  select r, vec_id, [cast(floor(256 * y) as bigint) for y in x] as v from r
  where len(list_filter(x, lambda y: y is not null and isfinite(y))) = len(x)
),
s as (
  select q.r, q.vec_id as query_id, c.vec_id as vec_id, cast(list_sum([p[1] * p[2] for p in list_zip(q.v, c.v)]) as bigint) as score
  from e q join e c on q.vec_id % 50 = 0 and q.r != c.r and len(q.v) = len(c.v)
)
select query_id, cast(rank as int) as rank, vec_id, score
from (select *, row_number() over (partition by r order by score desc, vec_id) as rank from s)
where rank <= 5
"""

ORACLE_SQL: dict[str, str] = {"op5_quality": OP5_SQL, "op8_topk": OP8_SQL, "op9_url_filters": OP9_SQL, "op11_clusters": clustering_sql.sql(), "op13_conversations": conversations_sql.SQL}
