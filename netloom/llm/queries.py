"""The operators' queries, over whole tables, and their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, exact_dedup, licenses, near_dedup, packing, pii, quality, substring_dedup, toxicity, urls


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _read(spark, sf_dir, "labels")))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_read(spark, sf_dir, "pages"), _read(spark, sf_dir, "labels"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeats across documents."""
    return substring_dedup.removals(_read(spark, sf_dir, "documents"), within=False).drop("component")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, _read(spark, sf_dir, "labels")))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.search(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_read(spark, sf_dir, "documents")).drop("blocks")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(_read(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decide(_read(spark, sf_dir, "documents")).select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), "kept", "text_sha256")


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.decide(_read(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    import corpus_pipeline  # noqa: F401  counted as part of this subpackage

    return {f.__name__: f for f in (op1_toxicity, op2_url_filter, op3_substring_dedup, op4_quality, op5_decontamination, op6_packing, op7_licenses, op8_pii, op9_exact_dedup, op10_near_dedup, pipeline)}


_TEMPLATES = ", ".join(f"({k}, '{t.label}', {t.size}, {t.need}, '{row[1]}', '{row[2]}', '{row[3]}')" for k, (t, row) in enumerate(zip(licenses.index({}).templates, licenses.TEMPLATES)))
OP7 = f"""
with d as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
w as (select doc_id, t, regexp_extract_all(t, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from d),
base as (
  select doc_id, i, case when w[i+1] = 'mit' then 'mit' else 'apache' end as label from (select doc_id, w, unnest(range(len(w) - 1)) as i from w where len(w) > 1) where w[i+1] in ('mit', 'apache') and w[i+2] = 'license'
  union all
  select doc_id, i, 'gpl' from (select doc_id, w, unnest(range(len(w) - 2)) as i from w where len(w) > 2) where w[i+1] = 'general' and w[i+2] = 'public' and w[i+3] = 'license'),
templates as (select k, label, size, need, tw, string_split(must, ' ') as must, string_split(without, ' ') as without from (values {_TEMPLATES}) v(k, label, size, need, t, must, without), lateral (select list_distinct(regexp_extract_all(lower(t), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) as tw)),
tok as (select doc_id, unnest(range(len(w))) as i, unnest(w) as x from w),
hit as (select k, doc_id, i, x from tok join (select k, unnest(tw) as x from templates) using (x)),
other as (select k, doc_id, i from tok join (select k, unnest(without) as x from templates) using (x)),
near as (select hit.* from hit join (select k, doc_id from hit join templates using (k) group by k, doc_id, need having count(distinct x) >= need) using (k, doc_id)),
block as (select k, near.doc_id, near.i, size, need, any_value(len(tw)) as n, count(distinct q.x) as c from near join templates using (k) join near q using (k, doc_id) where q.i >= near.i and q.i < near.i + size group by k, near.doc_id, near.i, size, need, must
  having count(distinct q.x) >= need and count(distinct case when list_contains(must, q.x) then q.x end) = len(must)),
met as (select block.doc_id, label, max(block.c::double / n) as c from block join templates using (k) where not exists (select 1 from other o where o.k = block.k and o.doc_id = block.doc_id and o.i >= block.i and o.i < block.i + block.size) group by block.doc_id, label),
b as (select doc_id, count(*) as n_base, min(i) as first_word, max(i) as last_word, list_sort(list_distinct(list(label))) as l from base group by doc_id),
m as (select doc_id, list(label) as l, max(c) as c from met group by doc_id)
select w.doc_id, len(w.w)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word,
  coalesce(array_to_string(b.l, ','), '') as base_labels, coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.l, []), coalesce(m.l, [])))), ','), '') as labels,
  case when n_base > 0 then 1.0 else coalesce(m.c, 0.0) end::double as score
from w left join b using (doc_id) left join m using (doc_id)
"""
OP9 = r"""
with d as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents)
select doc_id, min(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = min(doc_id) over w as kept, sha256(t) as text_sha256 from d window w as (partition by t)
"""
OP10 = r"""
with recursive d as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
w as (select doc_id, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from d),
s as (select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) end as s from w),
e as (select doc_id, hash(x) as x from (select doc_id, unnest(s) as x from s)),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as c from e a join e b on a.x = b.x and a.doc_id < b.doc_id group by all),
links as (select a, b from pairs join s p on p.doc_id = a join s q on q.doc_id = b where 100 * c >= 75 * (len(p.s) + len(q.s) - c)),
edges as (select a, b from links union all select b, a from links),
reach as (select doc_id as id, doc_id as c from s union select b, c from reach join edges on a = id),
comp as (select id, min(c) as c from reach group by id)
select doc_id, len(s)::bigint as n_shingles, c as component_id, doc_id = c as kept from s join comp on id = doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op7_licenses": OP7, "op9_exact_dedup": OP9, "op10_near_dedup": OP10}
