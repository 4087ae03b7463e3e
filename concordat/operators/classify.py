"""Types of documents: a trained text classifier and the cascade of tiers, cheapest first."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, NGram, RegexTokenizer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

FLOOR = 0.65


def train(examples: DataFrame, text: str = "text", label: str = "label", features: int = 1 << 14) -> PipelineModel | None:
    """TF-IDF over words and pairs of words, and a multinomial logistic regression with balanced classes.

    None where fewer than two types have examples: the tier then abstains.
    """
    counts = {r[label]: r["n"] for r in examples.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return None
    total = sum(counts.values())
    weight = F.lit(1.0)
    for k, n in counts.items():
        weight = F.when(F.col(label) == k, total / (len(counts) * n)).otherwise(weight)
    stages = [
        StringIndexer(inputCol=label, outputCol="__y", stringOrderType="alphabetAsc"), RegexTokenizer(inputCol=text, outputCol="__w", pattern=r"[^\p{L}\p{N}]+"), NGram(n=2, inputCol="__w", outputCol="__w2"),
        HashingTF(inputCol="__w", outputCol="__t1", numFeatures=features), HashingTF(inputCol="__w2", outputCol="__t2", numFeatures=features),
        IDF(inputCol="__t1", outputCol="__i1"), IDF(inputCol="__t2", outputCol="__i2"), VectorAssembler(inputCols=["__i1", "__i2"], outputCol="__x"),
        LogisticRegression(featuresCol="__x", labelCol="__y", weightCol="__weight", regParam=0.01, maxIter=50),
    ]
    return Pipeline(stages=stages).fit(examples.withColumn("__weight", weight))


def predict(model: PipelineModel, docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, doc_type, confidence)."""
    names = F.array(*[F.lit(x) for x in model.stages[0].labels])
    rest = PipelineModel(model.stages[1:])
    p = rest.transform(docs.select(key, F.coalesce(F.col(text), F.lit("")).alias(text))).withColumn("__p", vector_to_array("probability"))
    return p.select(key, F.get(names, F.col("prediction").cast("int")).alias("doc_type"), F.array_max("__p").alias("confidence"))


def cascade(docs: DataFrame, rules: DataFrame, model: PipelineModel | None, judge: Callable[[DataFrame], DataFrame] | None = None, floor: float = FLOOR, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, doc_type, confidence, method): rules, then the model where it is sure, then ``judge`` on what is left.

    Each tier runs only on the documents that the tiers before it leave, by anti-joins on the
    key; where no judge answers, the model's answer below the floor stands, else 'unknown'.
    """
    done = rules.select(key, "doc_type", F.col("confidence").cast("double").alias("confidence"), F.lit("rules").alias("method"))
    left = docs.join(rules.select(key), key, "left_anti")
    guess = None
    if model is not None:
        guess = predict(model, left, text, key).withColumn("method", F.lit("tfidf"))
        done = done.unionByName(guess.where(F.col("confidence") >= floor))
        left = left.join(guess.where(F.col("confidence") >= floor).select(key), key, "left_anti")
    if judge is not None:
        said = judge(left).select(key, "doc_type", "confidence", F.lit("judge").alias("method"))
        done = done.unionByName(said)
        left = left.join(said.select(key), key, "left_anti")
    rest = left.select(key)
    if guess is not None:
        rest = rest.join(guess, key, "left")
        return done.unionByName(rest.select(key, F.coalesce("doc_type", F.lit("unknown")).alias("doc_type"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("method", F.lit("none")).alias("method")))
    return done.unionByName(rest.select(key, F.lit("unknown").alias("doc_type"), F.lit(0.0).alias("confidence"), F.lit("none").alias("method")))


def chunk_votes(votes: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, doc_type, confidence) of chunks' answers weighted by their confidence."""
    g = votes.groupBy(key, "doc_type").agg(F.sum("confidence").alias("w"))
    t = g.groupBy(key).agg(F.max_by("doc_type", F.struct("w", "doc_type")).alias("doc_type"), F.max("w").alias("top"), F.sum("w").alias("all"))
    return t.select(key, "doc_type", (F.col("top") / F.col("all")).alias("confidence"))
