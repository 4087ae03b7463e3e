"""Queries of words, quotes and runs over whole documents as pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from concordat.functions import text
from concordat.functions.bind import let
from concordat.operators import metrics, quotes, tokens
from concordat.session import table

CUT = 7  # characters of a token: they end where words do not


def recognised_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all documents as a recogniser gives them: tokens of a fixed number of characters, ten units each, every third line without boxes."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page"), F.posexplode(F.split("text", "\n", -1)).alias("line", "text"))
    n = F.length("text")
    at = F.sequence(F.lit(0), F.greatest(F.ceil(n / CUT) - 1, F.lit(0)).cast("int"))
    row = F.col("line") * 20.0
    box = lambda a, b: F.struct((a * 10.0).alias("x0"), row.alias("y0"), (b * 10.0).alias("x1"), (row + 15.0).alias("y1"))
    boxed = (F.col("line") % 3 != 2) & (n > 0)
    return d.select(
        "page", "line", "text", F.lit(0.9).alias("confidence"), box(F.lit(0), n).alias("box"),
        F.when(boxed, F.regexp_extract_all("text", F.lit(f"(?s).{{1,{CUT}}}"), F.lit(0))).alias("tokens"),
        F.when(boxed, let(n, lambda m: F.transform(at, lambda i: box(i * CUT, F.least((i + 1) * CUT, m))))).alias("token_boxes"),
    )


def token_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every page with the extent of their boxes."""
    w = tokens.words_of_lines(recognised_lines(spark, sf_dir))
    whole = lambda c: F.sum(F.round(F.col(c) * 100).cast("bigint"))
    return w.groupBy("page").agg(F.count(F.lit(1)).alias("words"), F.sum(F.length("text")).alias("chars"), whole("x0").alias("x0"), whole("x1").alias("x1"), F.max("y1").alias("bottom"))


def text_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tokens.text_only(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page"), "text"))
    return p.groupBy("page").agg(F.count(F.lit(1)).alias("lines"), F.count("box").alias("boxes"), F.max("line").alias("last_line"), F.sum(F.length("text")).alias("chars"))


def variance_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested values of three runs: keys in another order and digits beyond cents agree, other values do not."""
    k, p = F.col("o_orderkey"), F.col("o_totalprice").cast("decimal(18,2)")
    o = table(spark, sf_dir, "orders")
    s = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v for v in x])
    first = s('{"a":{"n":', p, ',"t":["x",1]},"b":"Größe"}')
    second = s('{ "b": "Größe", "a": {"t": ["x", 1], "n": ', p, '001} }')
    third = F.when(k % 4 == 0, s('{"a":{"n":', p + 1, ',"t":["x",1]},"b":"Größe"}')).when(k % 4 == 1, s('{"a":{"n":', p, ',"t":[1,"x"]},"b":"Größe"}')).when(k % 4 == 2, second).otherwise(F.lit(None).cast("string"))
    runs = o.select(k.alias("doc_id"), F.lit("value").alias("field"), F.explode(F.array(first, second, third)).alias("value"))
    return metrics.agreement(runs.withColumn("value", F.coalesce(text.canonical_json(F.col("value")), F.lit("null"))))


def quote_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes of 30 characters looked up in whole documents: as printed, with one character misread, and never printed."""
    k = F.col("doc_id")
    d = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(F.lower("text"), r"(?U)\s+", "").alias("page_text")).where(F.length("page_text") >= 40)
    cut = F.substr("page_text", (k * 7 % (F.length("page_text") - 30) + 1).cast("int"), F.lit(30))
    quote = F.when(k % 3 == 0, cut).when(k % 3 == 1, F.concat(F.substr(cut, F.lit(1), F.lit(14)), F.lit("§"), F.substr(cut, F.lit(16)))).otherwise(F.repeat(F.lit("§¶"), F.lit(15)))
    found = quotes.locate(d.select("doc_id", F.lit("f").alias("field"), quote.alias("quote"), "page_text"))
    return found.groupBy("doc_id").agg(F.min(F.when(F.col("score") == 1, F.col("start"))).alias("first"), F.max(F.when(F.col("score") == 1, F.col("start"))).alias("last"), F.max(F.round("score", 6)).alias("score"))


QUERIES = {f.__name__: f for f in (quote_places, token_words, text_pages, variance_agreement)}

SPACE = r"[\s\x0b\x85\p{Z}]"
ORACLE = {
    "quote_places": rf"""with d as (select doc_id k, regexp_replace(lower(text), '(?:{SPACE})+', '', 'g') s from documents), q as (select k, s, substr(s, cast(k * 7 % (length(s) - 30) as int) + 1, 30) c from d where length(s) >= 40)
select k doc_id, case when k % 3 = 0 then strpos(s, c) - 1 end::int as first, case when k % 3 = 0 then length(s) - strpos(reverse(s), reverse(c)) - 29 end::int as last, case when k % 3 = 0 then 1 else 0.966667 end::double score
from q where k % 3 < 2""",
    "token_words": rf"""
with l as (select doc_id page, unnest(string_split(text, chr(10))) t, generate_subscripts(string_split(text, chr(10)), 1) - 1 line from documents where text is not null),
p as (select page, line, length(t) n, regexp_extract_all(t, '(?:{SPACE})+|[^\s\x0b\x85\p{{Z}}]+') ps from l),
q as (select page, line, n, unnest(ps) w, unnest(list_transform(range(1, len(ps) + 1), lambda i: coalesce(list_sum(list_transform(ps[1:i-1], lambda x: length(x))), 0))) s from p),
w as (select page, line, n, w, s::bigint s, (s + length(w))::bigint e, line % 3 <> 2 and n > 0 boxed from q where not regexp_matches(w, '^(?:{SPACE})')),
i as (select page, line, sum(length(w)) + count(*) - 1 total from w group by 1, 2),
r as (select w.*, (row_number() over (partition by page, line order by s) - 1) k, coalesce(sum(length(w)) over (partition by page, line order by s rows between unbounded preceding and 1 preceding), 0) c from w),
b as (select page, line, w,
  case when boxed then (s // 7) * 7 * 10.0 else 10.0 * n / total * (c + k) end x0, case when boxed then least(((e - 1) // 7 + 1) * 7, n) * 10.0 else 10.0 * n / total * (c + k + length(w)) end x1 from r join i using (page, line))
select page, count(*) words, sum(length(w))::bigint chars, sum(round(x0 * 100)::bigint)::bigint x0, sum(round(x1 * 100)::bigint)::bigint x1, max(line * 20.0 + 15.0)::double bottom from b group by 1""",
    "text_pages": """with l as (select doc_id page, unnest(string_split(text, chr(10))) t from documents), k as (select page, t, row_number() over (partition by page) n from l where trim(t, ' ') <> '')
select page, count(*) lines, 0::bigint boxes, cast(count(*) - 1 as int) last_line, sum(length(t))::bigint chars from k group by 1""",
    "variance_agreement": "select 'value' field, count(*) n, count(*) filter (o_orderkey % 4 = 2) agree from orders",
}
