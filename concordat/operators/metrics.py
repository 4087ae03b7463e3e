"""Accuracy and safety measures as conditional aggregates."""

from __future__ import annotations

import difflib
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

RATIO = "decimal(9,6)"


def ratio(a: Column, b: Column) -> Column:
    """a / b on six digits, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("decimal(18,0)"), b.cast("decimal(18,0)")).cast(RATIO), F.lit(0).cast(RATIO))


def prf(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1 from counts."""
    return ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1")


def field_prf(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """Per field and over all ('_micro'): a wrong value is a false positive and a false negative, a missing one a false negative."""
    x = predicted.select("doc_id", "field", F.col("value").alias("p")).join(gold.select("doc_id", "field", F.col("value").alias("g")), ["doc_id", "field"], "full_outer")
    right, said, due = F.col("p") == F.col("g"), F.col("p").isNotNull(), F.col("g").isNotNull()
    x = x.select("field", F.when(said & due & right, 1).otherwise(0).alias("tp"), F.when(said & ~F.coalesce(right, F.lit(False)), 1).otherwise(0).alias("fp"), F.when(due & ~F.coalesce(right, F.lit(False)), 1).otherwise(0).alias("fn"))
    g = x.groupingSets([[F.col("field")], []], F.col("field")).agg(F.grouping("field").alias("all"), F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    return g.select(F.when(F.col("all") == 1, "_micro").otherwise(F.col("field")).alias("field"), "tp", "fp", "fn", *prf(F.col("tp"), F.col("fp"), F.col("fn")))


def review_safety(docs: DataFrame) -> DataFrame:
    """One row: how many were wrong, and how many of those escaped review (columns correct, reviewed)."""
    wrong = ~F.col("correct")
    return docs.agg(F.count(F.lit(1)).alias("docs"), F.count_if(wrong).alias("wrong"), F.count_if(wrong & ~F.col("reviewed")).alias("escaped"), F.count_if(~F.col("reviewed")).alias("unreviewed"))


def detection(docs: DataFrame) -> DataFrame:
    """Alerts against errors, document by document (columns alert, error)."""
    a, e = F.col("alert"), F.col("error")
    g = docs.agg(F.count_if(a & e).alias("tp"), F.count_if(a & ~e).alias("fp"), F.count_if(~a & e).alias("fn"))
    return g.select("tp", "fp", "fn", *prf(F.col("tp"), F.col("fp"), F.col("fn")))


def error_kinds(fields: DataFrame) -> DataFrame:
    """Counts of right, wrong, missing and invented values (columns p, g)."""
    p, g = F.col("p"), F.col("g")
    kind = F.when(p.isNull() & g.isNull(), "absent").when(p.isNull(), "missing").when(g.isNull(), "invented").when(p == g, "right").otherwise("wrong")
    return fields.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def bag_of_words_f1(pairs: DataFrame) -> DataFrame:
    """id, hits, F1 of the multiset intersection of words in columns a and b. Two small aggregations a pair, no join of the texts."""
    words = lambda c: F.explode(F.filter(F.split(F.lower(c), r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    a = pairs.select("id", words(F.col("a")).alias("w"), F.lit(1).alias("x"), F.lit(0).alias("y"))
    b = pairs.select("id", words(F.col("b")).alias("w"), F.lit(0).alias("x"), F.lit(1).alias("y"))
    n = a.unionByName(b).groupBy("id", "w").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    g = n.groupBy("id").agg(F.sum(F.least("x", "y")).alias("hits"), F.sum("x").alias("na"), F.sum("y").alias("nb"))
    return g.select("id", "hits", ratio(2 * F.col("hits"), F.col("na") + F.col("nb")).alias("f1"))


def batch_rollup(results: DataFrame, by: str) -> DataFrame:
    """Counts by status, mean and exact median seconds (columns status, seconds)."""
    status = lambda s: F.count_if(F.col("status") == s).alias(s)
    return results.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), status("succeeded"), status("needs_review"), status("failed"),
        F.sum("seconds").cast("decimal(20,3)").alias("total_seconds"), F.median(F.col("seconds").cast("double")).alias("median_seconds"),
    )


def stage_seconds(results: DataFrame) -> DataFrame:
    """Summed seconds by stage from a map column ``stages``."""
    return results.select(F.explode("stages").alias("stage", "s")).groupBy("stage").agg(F.sum("s").alias("seconds"))


def agreement(runs: DataFrame) -> DataFrame:
    """Share of fields (doc_id, field) on which all runs give one value; null is a value."""
    g = runs.groupBy("doc_id", "field").agg(F.countDistinct(F.coalesce("value", F.lit("\x00null"))).alias("k"))
    return g.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("k") == 1).alias("agree"))


def tiers(answers: DataFrame, sure: str = "0.8") -> DataFrame:
    """By tier: accuracy over answered and over all, mean confidence by correctness, confidently wrong (tier, answer, truth, confidence)."""
    ok, answered = F.coalesce(F.col("answer") == F.col("truth"), F.lit(False)), F.col("answer").isNotNull()
    return answers.groupBy("tier").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(answered).alias("answered"), F.count_if(ok).alias("right"),
        F.count_if(answered & ~ok & (F.col("confidence") >= F.lit(sure).cast("decimal(4,2)"))).alias("confidently_wrong"),
        F.avg(F.when(ok, F.col("confidence"))).alias("mean_when_right"), F.avg(F.when(answered & ~ok, F.col("confidence"))).alias("mean_when_wrong"),
    ).withColumn("accuracy_answered", ratio(F.col("right"), F.col("answered"))).withColumn("accuracy_all", ratio(F.col("right"), F.col("n")))


def catch_rate(runs: DataFrame) -> DataFrame:
    """By mutation: how often it was applied and how often a rule fired (mutation, caught)."""
    return runs.groupBy("mutation").agg(F.count(F.lit(1)).alias("applied"), F.count_if("caught").alias("caught"))


def citation_coverage(required: DataFrame, citations: DataFrame) -> DataFrame:
    """Shares of required fields that are cited and that are located (status is not 'unlocated')."""
    c = citations.groupBy("doc_id", "field").agg(F.max(F.when(F.col("status") != "unlocated", 1).otherwise(0)).alias("located"))
    x = required.join(c, ["doc_id", "field"], "left")
    return x.agg(F.count(F.lit(1)).alias("required"), F.count("located").alias("cited"), F.coalesce(F.sum("located"), F.lit(0)).alias("located"))


def item_matches(predicted: DataFrame, gold: DataFrame, least: float = 0.8) -> DataFrame:
    """doc_id, pairs: one-to-one matches of items by description (ratio) with equal numbers, taken greedily from the best (doc_id, pos, description, amount)."""

    def match(key: tuple, p: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
        scored = sorted(
            ((-difflib.SequenceMatcher(None, a.description.lower(), b.description.lower()).ratio(), a.pos, b.pos) for a in p.itertuples() for b in g.itertuples() if abs(a.amount - b.amount) <= 0.01 + 1e-9)
        )
        used_p, used_g = set(), set()
        for s, a, b in scored:
            if -s >= least and a not in used_p and b not in used_g:
                used_p.add(a)
                used_g.add(b)
        return pd.DataFrame({"doc_id": [key[0]], "pairs": [len(used_p)], "predicted": [len(p)], "gold": [len(g)]})

    kind = predicted.schema["doc_id"].dataType.simpleString()
    return predicted.groupBy("doc_id").cogroup(gold.groupBy("doc_id")).applyInPandas(match, f"doc_id {kind}, pairs long, predicted long, gold long")


def table_hits(cells: DataFrame, gold: DataFrame) -> DataFrame:
    """Best cell hits of any table under row offsets -2..2 (doc_id, table, row, col, text against doc_id, row, col, text)."""
    shifted = cells.select("doc_id", "table", "row", "col", "text", F.explode(F.array(*[F.lit(i) for i in range(-2, 3)])).alias("offset"))
    x = shifted.withColumn("row", F.col("row") + F.col("offset")).join(gold.withColumnRenamed("text", "want"), ["doc_id", "row", "col"])
    hits = x.where("text = want").groupBy("doc_id", "table", "offset").agg(F.count(F.lit(1)).alias("hits"))
    return gold.select("doc_id").distinct().join(hits.groupBy("doc_id").agg(F.max("hits").alias("hits")), "doc_id", "left").select("doc_id", F.coalesce("hits", F.lit(0)).alias("hits"))

