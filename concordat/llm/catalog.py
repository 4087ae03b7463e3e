"""The registered query of each operator, over the whole of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from concordat.llm import embeddings, filter_audit, html_regions, line_templates, mixing, order_minhash, packing, preference, pseudo_likelihood, quality_rules, secrets, token_alignment, url_templates


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_files() -> dict[str, str]:
    import public_tokenizers as P

    return {"vocabulary": P.path("byte_bpe_50k.json"), "ranks": P.path("byte_bpe_50k.tiktoken"), "pattern": P.PATTERN}


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_likelihood.pseudo_likelihood(read(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(read(spark, sf_dir, "documents")))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_templates.judge(read(spark, sf_dir, "pages"))


def op5_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(read(spark, sf_dir, "embeddings"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference.rank(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_templates.dedup(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.array_join("dropped_at", ",").alias("dropped_at"), F.sha2(F.col("text"), 256).alias("text_sha256"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), **tokenizer_files())


def op9_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.classes(read(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_regions.main_text(read(spark, sf_dir, "pages"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return token_alignment.align(read(spark, sf_dir, "documents"), {**tokenizer_files(), "pieces": P.path("piece_bpe_32k.model")})


QUERIES = {f.__name__: f for f in (
    op1_lm_scoring, op2_quality_rules, op3_secret_scan, op4_url_filter, op5_embedding_neardup, op6_quality_classifier, op7_line_dedup, op8_packing,
    op9_minhash_neardup, op10_mixing, op11_filter_audit, op12_html_extraction, op13_token_alignment,
)}

#: Small vectors by brute force: all pairs of a label, then reachability by recursion.
EMBEDDING_SQL = """
with recursive v as (
  select vec_id, label, cast(embedding as double[]) e from embeddings
  where embedding is not null and label is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
l as (select a.vec_id a, b.vec_id b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
      where list_cosine_similarity(a.e, b.e) >= 0.98),
r(a, b) as (select a, b from l union select r.a, l.b from r join l on r.b = l.a)
select e.vec_id, (select count(*) from l where l.a = e.vec_id) n_links,
  least(e.vec_id, coalesce((select min(r.b) from r where r.a = e.vec_id), e.vec_id)) component_id,
  e.vec_id = least(e.vec_id, coalesce((select min(r.b) from r where r.a = e.vec_id), e.vec_id)) kept
from embeddings e"""

#: Masks of whole texts, then every order and step over the histogram of masks.
AUDIT_SQL = r"""
with w as (
  select doc_id, coalesce(lang, '') part, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') ws,
    min(doc_id) over (partition by coalesce(text, '')) first_id from documents),
l as (select doc_id, max(case when quality = 1 then 1 else 0 end) good, max(case when toxic = 1 then 1 else 0 end) toxic from labels group by doc_id),
m as (
  select part, coalesce(l.good, 0) good, coalesce(l.toxic, 0) toxic, {
    'A': (len(ws) < 200)::int, 'B': (100 * len(list_distinct(ws)) < 50 * len(ws))::int,
    'C': (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t))::int,
    'D': regexp_matches(t, '[#$%&*|]')::int, 'E': coalesce(w.doc_id > first_id, false)::int} f
  from w left join l on l.doc_id = w.doc_id),
h as (select part, map(['A', 'B', 'C', 'D', 'E'], [f['A'], f['B'], f['C'], f['D'], f['E']]) f, count(*) n, sum(good) good, sum(toxic) toxic from m group by all),
x as (select unnest(['A', 'B', 'C', 'D', 'E']) c),
o as (select a.c || b.c || c.c || d.c || e.c filter_order from x a, x b, x c, x d, x e where len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
s as (select filter_order, step, substr(filter_order, step, 1) own, substr(filter_order, 1, step - 1) before from o, (select unnest(range(1, 6))::int step)),
r as (
  select part, filter_order, step, own, n, good, toxic, f[own] fails, list_sum([f[k] for k in ['A', 'B', 'C', 'D', 'E'] if contains(before, k)]) earlier,
    list_sum(map_values(f)) all_fails from h, s),
t as (
  select part, filter_order, step, any_value(own) own, sum(case when fails = 0 and coalesce(earlier, 0) = 0 then n else 0 end) kept,
    sum(case when fails = 1 and coalesce(earlier, 0) = 0 then n else 0 end) removed, sum(case when fails = 1 and earlier > 0 then n else 0 end) redundant,
    sum(case when fails = 1 and all_fails = 1 then n else 0 end) unique_fails,
    sum(case when fails = 1 and coalesce(earlier, 0) = 0 then good else 0 end) good_lost, sum(case when fails = 1 and coalesce(earlier, 0) = 0 then toxic else 0 end) toxic_lost
  from r group by part, filter_order, step)
select part, filter_order, step, kept::bigint kept, removed::bigint removed, redundant::bigint redundant, unique_fails::bigint unique_fails, good_lost::bigint good_lost,
  toxic_lost::bigint toxic_lost, (sum(removed) over (partition by part, own))::bigint shapley from t"""
ORACLE = {"op5_embedding_neardup": EMBEDDING_SQL, "op11_filter_audit": AUDIT_SQL}
