"""Documents to packed training sequences, stage by stage.

Each stage reads what the one before it wrote. All but the last return the columns of
``documents``, with their own values and types whatever their names; n_chars follows the
text where a stage changes it. Nulls: a null text counts as empty, which the first stage
rejects; documents with a null id are no near-duplicates of others and pass like any other.
Rows that repeat an id and a text stay or go together, up to the mix, which takes each as
often as its source needs. Of equal texts the one with the smallest id stays. Texts of any
length are read whole. An empty table gives an empty result of the same columns.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from concordat.llm import line_templates, mixing, order_minhash, packing, quality_rules
from concordat.llm.catalog import read, tokenizer_files
from concordat.llm.shared import shared_dir

#: A document that loses more of its characters than this to recurring lines is a copy as a whole, and near-dedup's to judge.
WHOLE_COPY = 0.5


def apart(docs: DataFrame, *used: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with all but the ``used`` columns under private names, so that no operator's column takes the place of one,
    and a function that gives a result the names of ``docs``."""
    names = {c: c if c in used else f"__column{k}" for k, c in enumerate(docs.columns)}
    quoted = lambda c: "`" + c.replace("`", "``") + "`"
    hidden = docs.select(*[F.col(quoted(c)).alias(n) for c, n in names.items()])
    return hidden, lambda out: out.select(*[F.col(n).alias(c) for c, n in names.items()])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or the classifier reject go."""
    hidden, named = apart(docs, "doc_id", "text")
    return named(quality_rules.judge(hidden, read(spark, sf_dir, "labels"), carry=True).where("kept"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines go from the texts, but for copies as a whole; a document of which no word is left goes."""
    hidden, named = apart(docs, "doc_id", "text")
    out = line_templates.dedup(hidden, most_dropped=WHOLE_COPY).where("n_dropped = 0 or text rlike '[^\\\\x20\\\\x09-\\\\x0D]'")
    if "n_chars" in docs.columns:
        own = f"__column{docs.columns.index('n_chars')}"
        changed = F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col(own))
        out = out.withColumn(own, changed.cast(docs.schema["n_chars"].dataType))
    return named(out)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays; documents without an id all stay."""
    found = order_minhash.judged(docs)
    kept = found.where("kept and doc_id is not null").select(F.col("doc_id").alias("__id"), F.col("t1").alias("__t1"), F.col("t2").alias("__t2"))
    t1, t2 = order_minhash.text_keys(docs["text"].cast("string"))
    same = (docs["doc_id"] == kept["__id"]) & (t1 == kept["__t1"]) & (t2 == kept["__t2"])
    return docs.where("doc_id is null").unionByName(docs.join(kept, same, "left_semi"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them."""
    hidden, named = apart(docs, "doc_id", "text", "source")
    return named(mixing.repeated(mixing.mix(hidden), hidden.columns))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, **tokenizer_files())


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("MinHash near-dedup", near_dedup_stage),
    ("mixing sources to target weights", mixing_stage),
    ("packing", packing_stage),
]

#: SQL expresses neither the trained model nor the sketches; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, written under the shared folder; what the stages before it wrote is deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for k, (name, stage) in enumerate(STAGES):
        out = f"{root}/{k}-{name.replace(' ', '-')}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if before is not None:
            path = spark._jvm.org.apache.hadoop.fs.Path(before)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        before = out
    return docs
