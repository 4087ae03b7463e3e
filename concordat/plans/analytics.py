"""Queries of metrics, review, export, layout and acquisition."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from concordat.functions import money
from concordat.operators import export, layout, metrics, review
from concordat.plans import derived
from concordat.session import table

MONEY = "decimal(18,2)"


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with a predictor: documents under 400 characters are taken for poor, every tenth verdict is withheld."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "source", "lang")
    return table(spark, sf_dir, "labels").join(d, "doc_id")


def pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    x = labelled(spark, sf_dir)
    guess = F.when(F.col("doc_id") % 10 != 0, F.when(F.col("n_chars") < 400, "0").otherwise("1"))
    toxic = F.when(F.col("doc_id") % 4 == 0, "1").otherwise("0")
    p = x.select("doc_id", F.lit("quality").alias("field"), guess.alias("value")).unionByName(x.select("doc_id", F.lit("toxic").alias("field"), toxic.alias("value")))
    g = x.select("doc_id", F.lit("quality").alias("field"), F.col("quality").cast("string").alias("value")).unionByName(x.select("doc_id", F.lit("toxic").alias("field"), F.col("toxic").cast("string").alias("value")))
    return p.where("value is not null"), g


def field_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.field_prf(*pairs(spark, sf_dir))


def error_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, g = pairs(spark, sf_dir)
    x = p.withColumnRenamed("value", "p").join(g.withColumnRenamed("value", "g"), ["doc_id", "field"], "full_outer")
    return metrics.error_kinds(x)


def review_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = labelled(spark, sf_dir)
    return metrics.review_safety(x.select((F.col("quality") == 1).alias("correct"), (F.col("n_chars") < 600).alias("reviewed")))


def detection_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = labelled(spark, sf_dir)
    return metrics.detection(x.select((F.col("n_chars") < 600).alias("alert"), (F.col("quality") == 0).alias("error")))


def bag_of_words_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each conversation turn against the turn before it."""
    c = table(spark, sf_dir, "conversations")
    before = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("b"))
    return metrics.bag_of_words_f1(c.join(before, ["conv_id", "turn"]).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("a"), "b"))


def batch_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    status = F.when(F.col("n_chars") < 300, "failed").when(F.col("doc_id") % 4 == 0, "needs_review").otherwise("succeeded")
    return metrics.batch_rollup(d.select("source", status.alias("status"), (F.col("n_chars") / 1000).cast("decimal(12,3)").alias("seconds")), "source")


def run_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Do all lines of an order agree on flag, status and tax?"""
    li = table(spark, sf_dir, "lineitem")
    runs = li.select(F.col("l_orderkey").alias("doc_id"), F.explode(F.create_map(F.lit("flag"), "l_returnflag", F.lit("status"), "l_linestatus", F.lit("tax"), F.col("l_tax").cast("decimal(6,2)").cast("string"))).alias("field", "value"))
    return metrics.agreement(runs)


def tier_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    a = d.select(
        F.explode(F.array(F.lit("rules"), F.lit("length"))).alias("tier"), F.col("lang").alias("truth"), "doc_id", "n_chars",
    )
    answer = F.when(F.col("tier") == "rules", F.when(F.col("doc_id") % 3 == 0, F.col("truth"))).otherwise(F.when(F.col("n_chars") > 1000, "en").otherwise("fr"))
    conf = (F.col("n_chars") % 101 / 100).cast("decimal(4,2)")
    return metrics.tiers(a.select("tier", "truth", answer.alias("answer"), conf.alias("confidence")))


def citation_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields required of orders against the fields that their lines cite."""
    need = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.explode(F.array(F.lit("A"), F.lit("N"), F.lit("R"))).alias("field"))
    cited = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_returnflag").alias("field"), F.when(F.col("l_linestatus") == "O", "unlocated").otherwise("verified").alias("status"))
    return metrics.citation_coverage(need, cited)


def vat_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = derived.lines(spark, sf_dir).select("id", F.col("unit_price").alias("net"), (F.col("tax") * 100).cast("decimal(8,2)").alias("rate"))
    return export.vat_breakdown(li)


def semantic_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Semantic totals of orders; taxes are stated right, a cent off, or wrong, and every 50th subtotal is wrong."""
    li = derived.lines(spark, sf_dir).select("id", F.col("unit_price").alias("net"), F.when(F.col("id") % 3 == 0, F.lit("10")).otherwise((F.col("tax") * 100).cast("string")).cast("decimal(8,2)").alias("rate"))
    g = export.vat_breakdown(li)
    tax = g.groupBy("id").agg(F.sum("tax").cast(MONEY).alias("tax"))
    net = li.groupBy("id").agg(F.sum("net").cast(MONEY).alias("subtotal"))
    k = F.col("id")
    h = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")).join(net, "id", "left").join(tax, "id", "left").select(
        "id", (F.col("subtotal") + F.when(k % 50 == 0, 1).otherwise(0)).cast(MONEY).alias("subtotal"), (F.col("tax") + F.when(k % 4 == 1, F.lit("0.01")).when(k % 4 == 2, F.lit("0.02")).otherwise(F.lit("0")).cast(MONEY)).cast(MONEY).alias("tax"),
        F.when(k % 20 == 0, F.lit("1.00").cast(MONEY)).alias("discount"), F.lit(None).cast(MONEY).alias("shipping"),
    )
    return export.semantic_totals(h, g, li)


def summary_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as results: status by priority, issues as an array, mapped to the summary columns."""
    o = table(spark, sf_dir, "orders")
    issue = lambda s, c: F.when(c, F.struct(F.lit("f").alias("field"), F.lit(s).alias("severity")))
    r = o.select(
        F.concat(F.lit("doc_"), "o_orderkey").alias("document_id"), F.when(F.col("o_orderkey") % 6 == 0, "needs_review").otherwise("succeeded").alias("status"),
        F.array_compact(F.array(issue("error", F.col("o_orderkey") % 6 == 0), issue("warning", F.col("o_orderkey") % 4 == 0), issue("warning", F.col("o_orderkey") % 5 == 0))).alias("issues"),
        F.when(F.col("o_orderkey") % 6 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>")).alias("reasons"),
        F.col("o_orderkey").alias("number"), F.to_date("o_orderdate").alias("day"), F.col("o_totalprice").cast(MONEY).alias("total"), F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderpriority")).alias("ref"),
    )
    return export.summary_rows(r, {"number": "number", "issue_date": "day", "total": "total", "reference": "ref"})


def line_item_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = derived.lines(spark, sf_dir).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "sku", "description", "quantity", "unit_price"))).alias("items"))
    rows = export.line_item_rows(x, "items", {c: c for c in ("description", "quantity", "unit_price", "sku")}, key="id")
    return rows.select("id", F.col("line_no").cast("long").alias("line_no"), "description", "quantity", "unit_price", "sku")


def unit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = ("pcs", "Stück", "HUR", "hours", "kg", "lump sum", "m2", "Pallets", "dozen", " box. ", "", "kWh")
    p = table(spark, sf_dir, "part")
    u = F.get(F.array(*[F.lit(x) for x in units]), (F.col("p_partkey") % len(units)).cast("int"))
    return p.select("p_partkey", export.unit_code(u).alias("code"))


def csv_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    t = F.concat(F.get(F.array(*[F.lit(x) for x in ("=", " +", "-", "@", "", "a=")]), (F.col("p_partkey") % 6).cast("int")), "p_name")
    return p.select("p_partkey", export.guarded(t).alias("cell"))


def implied_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rate that a line's tax implies, where one reproduces it to the cent."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", F.col("l_extendedprice").cast(MONEY).alias("s"), F.col("l_tax").cast("decimal(6,2)").alias("r"))
    zero = F.lit(0).cast(MONEY)
    tax = (money.cents(F.col("s") * F.col("r")) + F.when(F.col("l_partkey") % 2 == 0, F.lit("0.37").cast(MONEY)).otherwise(zero)).cast(MONEY)
    return li.select("l_orderkey", "l_partkey", "l_linenumber", "s", tax.alias("tax"), export.implied_rate(F.lit(None), F.col("s"), zero, zero, tax).alias("rate"))


def json_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.flatten_json(table(spark, sf_dir, "events"), "props", "event_id")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("page"), F.col("event_id").alias("ordinal"), F.when(F.col("event_type") == "view", "").otherwise(F.col("event_type")).alias("text"), (F.col("value") / 500).cast("decimal(6,4)").alias("confidence"), (F.col("event_id") % 2 == 0).alias("geometry"))


def first_acceptable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as readings of a page, in order of id."""
    return layout.first_acceptable(readings(spark, sf_dir), 0.9)


def escalation_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    a = li.groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("attempt")).agg(F.count_if(F.col("l_returnflag") == "R").alias("errors"))
    return layout.escalation_winner(a)


def gap_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a user: a gap over six hours opens the next."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("x0")).withColumn("x1", F.col("x0"))
    s = layout.segments(e, ["user_id"], F.lit(4 * 3600 * 1000000), order=("event_id",))
    return s.select("user_id", "event_id", "segment")


def merge_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of an order's lines, each open for a number of days, merged."""
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", F.to_date("l_shipdate").alias("lo"), F.date_add(F.to_date("l_shipdate"), F.col("l_linenumber")).alias("hi"), "l_orderkey", "l_partkey", "l_linenumber")
    return layout.merge_bands(li, ["l_suppkey"], "lo", "hi", ("hi", "l_orderkey", "l_partkey"))


def page_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("page"), F.to_date("ts").alias("line"), F.col("event_type").alias("text"), (F.col("value") / 500).cast("decimal(8,4)").alias("confidence"))
    return layout.page_confidence(e, 0.5).select("page", F.col("confidence").cast("decimal(8,6)").alias("confidence"))


def review_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a review log: by id an event queues a user's task, claims, corrects, releases, approves or rejects it."""
    e = table(spark, sf_dir, "events")
    k = F.col("event_id")
    kind = F.get(F.array(*[F.lit(x) for x in KINDS]), (k % len(KINDS)).cast("int"))
    return e.select(
        F.col("user_id").alias("task"), k.alias("seq"), F.when(k % 101 == 0, "enqueue").otherwise(kind).alias("kind"), F.concat(F.lit("r"), k % 3 % 2).alias("who"), F.col("ts").alias("at"),
        F.when(k % 29 == 0, 5).otherwise(3600).cast("int").alias("lease_s"), F.when(k % 13 == 0, 3).cast("long").alias("expected_version"),
        F.when(k % 4 == 0, F.concat(F.lit('{"v": '), k, F.lit("}"))).alias("corrections"), (k % 7 == 0).cast("int").alias("errors"),
    )


def review_queue_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.queue_state(review_log(spark, sf_dir)).select("task", "state", "version", "locked_by", "corrections", "revisions", "refused")


def review_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.revisions(review_log(spark, sf_dir)).groupBy("kind", "refusal").agg(F.count(F.lit(1)).alias("n"), F.max("version").alias("last_version"))


KINDS = ("enqueue", "claim", "corrected", "claim", "approved", "claim", "release", "corrected", "claim", "rejected", "claim")


def review_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each reason stands, over documents with planted doubts."""
    d = table(spark, sf_dir, "documents")
    k = F.col("doc_id")
    x = d.select(
        "doc_id", F.when(k % 50 == 0, "acquire").alias("error_stage"), (k % 11 != 0).alias("complete"), F.when(k % 13 == 0, "unknown").otherwise("invoice").alias("doc_type"), (k % 100 / 100).cast("decimal(4,2)").alias("confidence"),
        F.when(k % 17 == 0, F.array(F.lit(1), F.lit(3))).otherwise(F.array().cast("array<int>")).alias("degraded_pages"), (k % 19 != 0).alias("extracted"),
        F.when(k % 3 == 0, F.array(F.struct(F.lit("total").alias("field"), F.lit("error").alias("severity")), F.struct(F.lit("bic").alias("field"), F.lit("warning").alias("severity")))).otherwise(F.array().cast("array<struct<field:string,severity:string>>")).alias("issues"),
        F.when(k % 5 == 0, F.array(F.lit("issue_date"))).otherwise(F.array().cast("array<string>")).alias("weak_fields"),
    )
    x = x.withColumn("reasons", review.reasons()).withColumn("status", review.status(F.col("error_stage"), F.col("reasons")))
    return x.select("status", F.explode_outer("reasons").alias("r")).groupBy("status", F.col("r.code").alias("code")).agg(F.count(F.lit(1)).alias("n"))


def tumbling_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: hourly windows over events, as the streaming plan has them."""
    from concordat.streaming import plans

    return plans.hourly(table(spark, sf_dir, "events"))


QUERIES = {f.__name__: f for f in (
    field_prf, error_breakdown, review_safety, detection_metrics, bag_of_words_f1, batch_rollup, run_agreement, tier_benchmark, citation_coverage, vat_breakdown, semantic_totals,
    summary_rows, line_item_rows, unit_codes, csv_guard, implied_rate, json_flatten, first_acceptable, escalation_winner, gap_segments, merge_bands, page_confidence, review_queue_state, review_history,
    review_reasons, tumbling_events,
)}



def ratio(a: str, b: str) -> str:
    """Six digits, rounded half up, in whole numbers."""
    return f"cast(case when ({b}) = 0 then 0 else ((cast({a} as hugeint) * 20000000 // ({b}) + 10) // 20) / 1000000.0 end as decimal(9,6))"


def cents(amount: str, percent: str) -> str:
    """A percentage of an amount, rounded half up to cents, in whole numbers."""
    return f"cast(cast((cast({amount} * {percent} * 10000 as hugeint) + 5000) // 10000 as decimal(18,0)) * 0.01 as decimal(18,2))"


LAB = "with x as (select l.*, d.n_chars from labels l join documents d using (doc_id))"
PG = LAB + """, p as (select doc_id, 'quality' field, case when n_chars < 400 then '0' else '1' end v from x where doc_id % 10 <> 0 union all select doc_id, 'toxic', case when doc_id % 4 = 0 then '1' else '0' end from x),
g as (select doc_id, 'quality' field, cast(quality as varchar) v from x union all select doc_id, 'toxic', cast(toxic as varchar) from x),
j as (select coalesce(p.field, g.field) field, p.v p, g.v g from p full join g on p.doc_id = g.doc_id and p.field = g.field)"""
LI = "with li as (select l_orderkey id, cast(l_extendedprice as decimal(18,2)) net, cast(l_tax as decimal(6,2)) t from lineitem)"
#: The queue's rules as a recursion over each task's events in order; locks by owner and end of lease.
QUEUE_SQL = """with recursive log as (select user_id task, event_id seq, row_number() over (partition by user_id order by event_id) n, event_id k, ts moment,
  case when event_id % 101 = 0 then 'enqueue' else (['enqueue', 'claim', 'corrected', 'claim', 'approved', 'claim', 'release', 'corrected', 'claim', 'rejected', 'claim'])[event_id % 11 + 1] end kind,
  'r' || (event_id % 3 % 2) who, case when event_id % 29 = 0 then 5 else 3600 end lease, case when event_id % 13 = 0 then 3 end expected,
  case when event_id % 4 = 0 then '{"v": ' || event_id || '}' end fix, event_id % 7 = 0 bad from events),
s as (select task, n, kind, case when kind = 'enqueue' then 'pending' end state, cast(case when kind = 'enqueue' then 1 else 0 end as bigint) as version, cast(null as varchar) locked_by, cast(null as timestamp) until,
  cast(null as varchar) corrections, cast(case when kind = 'enqueue' then 1 else 0 end as bigint) revisions, cast(case when kind = 'enqueue' then 0 else 1 end as bigint) refused, case when kind <> 'enqueue' then 'missing' end refusal from log where n = 1
 union all
 select task, n, kind, case when refusal is not null then state when kind = 'enqueue' then 'pending' when kind = 'claim' then 'in_review' when kind = 'release' then case when corrections is null then 'pending' else 'corrected' end else kind end,
  case when refusal is null then version + 1 else version end,
  case when refusal is not null then locked_by when kind = 'claim' then who when kind = 'corrected' then locked_by end,
  case when refusal is not null then until when kind = 'claim' then moment + to_seconds(lease) when kind = 'corrected' then until end,
  case when refusal is not null or kind in ('claim', 'release') then corrections when kind = 'enqueue' then null else coalesce(fix, corrections) end,
  case when refusal is null then revisions + 1 else revisions end, case when refusal is null then refused else refused + 1 end, refusal
 from (select s.task, log.n, log.kind, s.state, s.version, s.locked_by, s.until, s.corrections, s.revisions, s.refused, log.who, log.moment, log.lease, log.fix,
   case when log.kind = 'enqueue' then null when s.version = 0 then 'missing'
    when log.kind = 'claim' then case when lease < 10 or lease > 3600 then 'lease' when s.until > log.moment and s.locked_by <> log.who then 'locked' end
    when s.locked_by is null or s.until <= log.moment or s.locked_by <> log.who then 'no_lock' when log.kind = 'release' then null
    when expected <> s.version then 'version' when log.kind = 'approved' and bad then 'errors' end refusal
  from s join log on log.task = s.task and log.n = s.n + 1))
"""

ORACLE = {
    "field_prf": PG + f""", c as (select case when grouping(field) = 1 then '_micro' else field end field, count(*) filter (p = g) tp, count(*) filter (p is not null and (g is null or p <> g)) fp, count(*) filter (g is not null and (p is null or p <> g)) fn from j group by grouping sets ((field), ()))
select field, tp, fp, fn, {ratio('tp', 'tp + fp')} "precision", {ratio('tp', 'tp + fn')} recall, {ratio('2 * tp', '2 * tp + fp + fn')} f1 from c""",
    "error_breakdown": PG + "select case when p is null and g is null then 'absent' when p is null then 'missing' when g is null then 'invented' when p = g then 'right' else 'wrong' end kind, count(*) n from j group by 1",
    "review_safety": LAB + "select count(*) docs, count(*) filter (quality <> 1) wrong, count(*) filter (quality <> 1 and n_chars >= 600) escaped, count(*) filter (n_chars >= 600) unreviewed from x",
    "detection_metrics": LAB + f""", c as (select count(*) filter (n_chars < 600 and quality = 0) tp, count(*) filter (n_chars < 600 and quality <> 0) fp, count(*) filter (n_chars >= 600 and quality = 0) fn from x)
select tp, fp, fn, {ratio('tp', 'tp + fp')} "precision", {ratio('tp', 'tp + fn')} recall, {ratio('2 * tp', '2 * tp + fp + fn')} f1 from c""",
    "bag_of_words_f1": f"""with t as (select a.conv_id * 1000 + a.turn id, lower(a.text) a, lower(b.text) b from conversations a join conversations b on a.conv_id = b.conv_id and a.turn = b.turn + 1),
w as (select id, unnest(regexp_split_to_array(a, '[\\x20\\x09-\\x0D]+')) w, 1 x, 0 y from t union all select id, unnest(regexp_split_to_array(b, '[\\x20\\x09-\\x0D]+')), 0, 1 from t),
n as (select id, w, sum(x) x, sum(y) y from w where w <> '' group by 1, 2), g as (select id, cast(sum(least(x, y)) as bigint) hits, sum(x) na, sum(y) nb from n group by 1)
select id, hits, {ratio('2 * hits', 'na + nb')} f1 from g""",
    "batch_rollup": """with d as (select source, n_chars, case when n_chars < 300 then 'failed' when doc_id % 4 = 0 then 'needs_review' else 'succeeded' end s from documents)
select source, count(*) n, count(*) filter (s = 'succeeded') succeeded, count(*) filter (s = 'needs_review') needs_review, count(*) filter (s = 'failed') failed,
 cast(sum(cast(n_chars / 1000.0 as decimal(12,3))) as decimal(20,3)) total_seconds, median(cast(cast(n_chars / 1000.0 as decimal(12,3)) as double)) median_seconds from d group by 1""",
    "run_agreement": """with r as (select l_orderkey d, 'flag' field, l_returnflag v from lineitem union all select l_orderkey, 'status', l_linestatus from lineitem union all select l_orderkey, 'tax', cast(cast(l_tax as decimal(6,2)) as varchar) from lineitem),
g as (select d, field, count(distinct v) k from r group by 1, 2) select field, count(*) n, count(*) filter (k = 1) agree from g group by 1""",
    "tier_benchmark": f"""with a as (select 'rules' tier, lang truth, case when doc_id % 3 = 0 then lang end answer, n_chars from documents union all select 'length', lang, case when n_chars > 1000 then 'en' else 'fr' end, n_chars from documents),
c as (select tier, count(*) n, count(answer) answered, count(*) filter (answer = truth) "right", count(*) filter (answer is not null and answer is distinct from truth and n_chars % 101 >= 80) confidently_wrong,
 sum(n_chars % 101) filter (answer = truth) rs, count(*) filter (answer = truth) rn, sum(n_chars % 101) filter (answer is not null and answer is distinct from truth) ws, count(*) filter (answer is not null and answer is distinct from truth) wn from a group by 1)
select tier, n, answered, "right", confidently_wrong, case when rn > 0 then {ratio('rs', '100 * rn')}::decimal(8,6) end mean_when_right, case when wn > 0 then {ratio('ws', '100 * wn')}::decimal(8,6) end mean_when_wrong, {ratio('"right"', 'answered')} accuracy_answered, {ratio('"right"', 'n')} accuracy_all from c""",
    "citation_coverage": """with n as (select o_orderkey d, unnest(['A', 'N', 'R']) f from orders), c as (select l_orderkey d, l_returnflag f, max(case when l_linestatus = 'O' then 0 else 1 end) l from lineitem group by 1, 2)
select count(*) required, count(l) cited, cast(coalesce(sum(l), 0) as bigint) located from n left join c using (d, f)""",
    "vat_breakdown": LI + f""", g as (select id, case when t > 0 then 'S' else 'Z' end category, cast(t * 100 as decimal(8,2)) rate, cast(sum(net) as decimal(18,2)) taxable from li group by 1, 2, 3)
select id, category, rate, taxable, {cents('taxable', 'rate')} tax from g""",
    "semantic_totals": LI + f""", l as (select id, net, cast(case when id % 3 = 0 then 10 else t * 100 end as decimal(8,2)) rate from li),
g as (select id, rate, {cents('cast(sum(net) as decimal(18,2))', 'rate')} tax from l group by 1, 2),
a as (select id, count(*) rates, sum(tax) tax_sum, any_value(rate) rate from g group by 1), b as (select id, cast(sum(net) as decimal(18,2)) line_total from l group by 1),
x as (select o_orderkey id, line_total, rates, rate, tax_sum, line_total + case when o_orderkey % 50 = 0 then 1 else 0 end subtotal, cast(tax_sum + case o_orderkey % 4 when 1 then 0.01 when 2 then 0.02 else 0 end as decimal(18,2)) tax, cast(case when o_orderkey % 20 = 0 then 1 else 0 end as decimal(18,2)) discount from orders left join a on a.id = o_orderkey left join b on b.id = o_orderkey)
select id, line_total, cast(line_total - discount as decimal(18,2)) tax_exclusive, cast(line_total - discount + tax as decimal(18,2)) payable,
 case when line_total is null then 'BR-16' when rates > 1 and discount <> 0 then 'mixed rates' when rates = 1 and abs({cents('(line_total - discount)', 'rate')} - tax) > 0.01 then 'tax' when rates > 1 and tax_sum <> tax then 'tax' when abs(line_total - subtotal) > 0.01 then 'BR-CO-10' end refusal from x""",
    "summary_rows": """select 'doc_' || o_orderkey document_id, case when o_orderkey % 6 = 0 then 'needs_review' else 'succeeded' end status, case when o_orderkey % 6 = 0 then 'a | b' else '' end review_reasons,
 cast(case when o_orderkey % 6 = 0 then 1 else 0 end as bigint) validation_error_count, cast(case when o_orderkey % 4 = 0 then 1 else 0 end + case when o_orderkey % 5 = 0 then 1 else 0 end as bigint) validation_warning_count,
 cast(o_orderkey as varchar) number, cast(cast(o_orderdate as date) as varchar) issue_date, '' counterparty, '' currency, '' subtotal, '' tax, cast(cast(o_totalprice as decimal(18,2)) as varchar) total, case when o_orderkey % 9 <> 0 then o_orderpriority else '' end reference from orders""",
    "line_item_rows": """select l_orderkey id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) line_no, ' Part ' || l_partkey description,
 cast(cast(l_quantity as decimal(18,2)) as varchar) quantity, cast(cast(l_extendedprice as decimal(18,2)) as varchar) unit_price, case when l_suppkey % 5 <> 0 then 'P-' || l_partkey else '' end sku from lineitem""",
    "unit_codes": "select p_partkey, (['C62', 'C62', 'HUR', 'HUR', 'KGM', 'LS', 'MTK', 'PF', 'C62', 'BX', 'C62', 'KWH'])[p_partkey % 12 + 1] code from part",
    "csv_guard": """with t as (select p_partkey, (['=', ' +', '-', '@', '', 'a='])[p_partkey % 6 + 1] || p_name t from part) select p_partkey, case when regexp_matches(ltrim(t), '^[=+@-]') then '''' || t else t end cell from t""",
    "implied_rate": f"""with x as (select l_orderkey, l_partkey, l_linenumber, cast(l_extendedprice as decimal(18,2)) s, cast(l_tax as decimal(6,2)) r from lineitem),
y as (select *, cast(round(s * r, 2) + case when l_partkey % 2 = 0 then 0.37 else 0 end as decimal(18,2)) tax from x),
z as (select *, cast((cast(tax * 100 as hugeint) * 20000 // cast(s * 100 as hugeint) + 1) // 2 / 100.0 as decimal(8,2)) k from y)
select l_orderkey, l_partkey, l_linenumber, s, tax, case when tax = 0 then cast(0 as decimal(8,2)) when {cents('s', 'k')} = tax then k end rate from z""",
    "first_acceptable": """with r as (select user_id page, event_id o, case when event_type = 'view' then '' else event_type end t, cast(value / 500 as decimal(6,4)) c, event_id % 2 = 0 geo from events),
g as (select page, min(o) filter (t <> '' and c >= 0.9) acc from r group by 1),
b as (select page, o from (select page, o, row_number() over (partition by page order by c desc, o) k from r where t <> '') where k = 1),
w as (select r.page, max(r.o) w from r join g on r.page = g.page where r.t <> '' and r.c < 0.9 and r.geo and (g.acc is null or r.o < g.acc) group by 1)
select g.page, coalesce(acc, b.o) ordinal, acc is null degraded, case when acc is not null then w.w end witness from g left join b on g.page = b.page left join w on g.page = w.page""",
    "escalation_winner": """with a as (select l_orderkey d, l_linenumber a, count(*) filter (l_returnflag = 'R') e from lineitem group by 1, 2)
select d doc_id, a attempt, e errors from (select *, row_number() over (partition by d order by e, a desc) k from a) where k = 1""",
    "gap_segments": """with e as (select user_id, event_id, ts, epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts, event_id) g from events)
select user_id, event_id, cast(sum(case when g > 21600000000 then 1 else 0 end) over (partition by user_id order by ts, event_id rows unbounded preceding) as bigint) segment from e""",
    "merge_bands": """with l as (select l_suppkey, cast(l_shipdate as date) lo, cast(l_shipdate as date) + l_linenumber hi, l_orderkey o, l_partkey p from lineitem),
r as (select *, max(hi) over (partition by l_suppkey order by lo, hi, o, p rows between unbounded preceding and 1 preceding) m from l),
b as (select *, sum(case when lo > m then 1 else 0 end) over (partition by l_suppkey order by lo, hi, o, p rows unbounded preceding) k from r)
select l_suppkey, min(lo) lo, max(hi) hi, count(*) n from b group by l_suppkey, k""",
    "page_confidence": """with l as (select user_id p, cast(ts as date) d, avg(cast(cast(value / 500 as decimal(8,4)) as double)) m, sum(length(event_type)) c from events group by 1, 2),
g as (select p, sum(case when m >= 0.5 then c else 0 end) a, sum(c) b from l group by 1) select p page, cast(cast(a as double) / cast(b as double) as decimal(8,6)) confidence from g""",
    "review_queue_state": QUEUE_SQL + """select task, state, version, locked_by, corrections, revisions, refused from (select *, row_number() over (partition by task order by n desc) z from s) where z = 1""",
    "review_history": QUEUE_SQL + "select kind, refusal, count(*) n, max(case when refusal is null then version end) last_version from s group by 1, 2",
    "review_reasons": """with d as (select doc_id k from documents), r as (
 select k, 'failed' code from d where k % 50 = 0 union all select k, 'incomplete' from d where k % 50 <> 0 and k % 11 = 0 union all select k, 'low_classification' from d where k % 50 <> 0 and k % 100 < 55
 union all select k, 'unknown_type' from d where k % 50 <> 0 and k % 13 = 0 union all select k, 'degraded' from d where k % 50 <> 0 and k % 17 = 0 union all select k, 'no_extraction' from d where k % 50 <> 0 and k % 19 = 0
 union all select k, 'validation_error' from d where k % 50 <> 0 and k % 3 = 0 union all select k, 'low_confidence' from d where k % 50 <> 0 and k % 5 = 0)
select case when d.k % 50 = 0 then 'failed' when code is null then 'succeeded' else 'needs_review' end status, code, count(*) n from d left join r on d.k = r.k group by 1, 2""",
    "tumbling_events": "select date_trunc('hour', ts) as window_start, event_type, count(*) n, cast(sum(cast(value as decimal(18,2))) as decimal(20,2)) total from events group by 1, 2",
    "json_flatten": """select event_id, '/' || unnest(json_keys(props)) as path, 'number' as type, cast(0 as int) part, unnest(list_transform(json_keys(props), lambda k: cast(json_extract(props, '$.' || k) as varchar))) as value from events""",
}
