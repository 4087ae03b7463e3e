"""Summaries of runs, jobs and comparisons: one row each from one row a document, by partial aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from concordat.operators.metrics import ratio

# Prefixes of document names by the collection they came from.
COLLECTIONS = {
    "invoice_hf": "donut", "invoice_docile": "docile", "receipt_hf": "cord", "invoice_rvlcdip": "rvl-cdip", "other_rvlcdip": "rvl-cdip",
    "form_funsd": "funsd", "contract_hf": "contract-hf", "zf_": "zugferd", "pt_": "pt-receipts",
}


def n_of(c: Column) -> Column:
    return F.count_if(F.coalesce(c, F.lit(False)))


def run_summary(rows: DataFrame, *by: str) -> DataFrame:
    """Success, accuracy, time and review figures of a run's documents.

    rows: success, needs_review (boolean), status, fields_correct, fields_total, seconds (decimal),
    pages, model_pages, model_calls, template_id. A silent success claims to need no review; a false
    one is silent and wrong.
    """
    silent = (F.col("status") == "succeeded") & ~F.col("needs_review")
    g = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("documents"), n_of(F.col("success")).alias("successes"), F.sum("fields_correct").alias("correct"), F.sum("fields_total").alias("fields_graded"),
        F.avg("seconds").cast("decimal(18,4)").alias("seconds_mean"), F.sum("model_pages").alias("mp"), F.sum("pages").alias("p"), F.sum("model_calls").alias("model_calls"),
        F.count("template_id").alias("templated"), n_of(silent).alias("silent_successes"), n_of(silent & ~F.col("success")).alias("false_successes"),
        n_of(F.col("needs_review")).alias("needs_review"), n_of(F.col("status") == "failed").alias("failed"),
    )
    return g.select(
        *by, "documents", ratio(F.col("successes"), F.col("documents")).alias("success_rate"), ratio(F.col("correct"), F.col("fields_graded")).alias("field_accuracy"), "fields_graded", "seconds_mean",
        ratio(F.col("mp"), F.col("p")).alias("model_page_share"), "model_calls", ratio(F.col("templated"), F.col("documents")).alias("template_rate"),
        "silent_successes", "false_successes", ratio(F.col("false_successes"), F.col("silent_successes")).alias("false_success_rate"), "needs_review", "failed",
    )


def templates_used(rows: DataFrame) -> DataFrame:
    return rows.where("template_id is not null").groupBy("template_id").agg(F.count(F.lit(1)).alias("documents"), F.avg("seconds").cast("decimal(18,4)").alias("seconds_mean"))


def replay_summary(rows: DataFrame) -> DataFrame:
    """A saved run checked again: fully right, reviewed, and silent or false successes (success, needs_review, fields_correct, fields_total)."""
    silent = ~F.col("needs_review")
    g = rows.agg(
        F.count(F.lit(1)).alias("documents"), n_of(F.col("success")).alias("fully_right"), F.sum("fields_correct").alias("c"), F.sum("fields_total").alias("t"), n_of(F.col("needs_review")).alias("needs_review"),
        n_of(silent).alias("silent_successes"), n_of(silent & ~F.col("success")).alias("false_successes"),
    )
    return g.select("documents", "fully_right", ratio(F.col("c"), F.greatest("t", F.lit(1))).alias("field_accuracy"), "needs_review", "silent_successes", "false_successes")


def job_counts(results: DataFrame) -> DataFrame:
    """Counts of each job by outcome, from (job, status) of its finished documents; what is neither failed nor to be reviewed succeeded."""
    s = F.col("status")
    return results.groupBy("job").agg(
        F.count(F.lit(1)).alias("done"), n_of(~s.isin("failed", "needs_review")).alias("succeeded"), n_of(s == "needs_review").alias("needs_review"), n_of(s == "failed").alias("failed"),
    )


def job_results(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """The latest result of each stored document (job, stored, seq, status), in the order of upload (job, position, stored, name)."""
    last = rows.groupBy("job", "stored").agg(F.max_by("status", "seq").alias("status"))
    return documents.join(last, ["job", "stored"], "left").select("job", "position", "name", "status").orderBy("job", "position")


def competitor_summary(rows: DataFrame) -> DataFrame:
    """Accuracy over all, over documents whose template matched, and by source (null: over all).

    rows: source, correct, total, seconds, error, template_matched (null counts as matched). Rows with an error are not graded.
    """
    good = rows.withColumn("graded", F.col("error").isNull())
    of = lambda c, w: F.sum(F.when(w, F.col(c)).otherwise(0))
    graded, matched = F.col("graded"), F.col("graded") & F.coalesce("template_matched", F.lit(True))
    g = good.groupingSets([[F.col("source")], []], F.col("source")).agg(
        F.grouping("source").alias("overall"), n_of(graded).alias("documents"), n_of(~graded).alias("errors"), of("correct", graded).alias("c"), of("total", graded).alias("fields_graded"),
        n_of(matched).alias("template_matched"), of("correct", matched).alias("mc"), of("total", matched).alias("mt"),
    )
    return g.select(
        F.when(F.col("overall") == 0, F.col("source")).alias("source"), "documents", "errors", ratio(F.col("c"), F.col("fields_graded")).alias("field_accuracy"), "fields_graded",
        "template_matched", ratio(F.col("mc"), F.col("mt")).alias("field_accuracy_on_matched"),
    )


def collection(name: Column) -> Column:
    """The collection a document's name tells, else 'golden'."""
    out = None
    for prefix, label in COLLECTIONS.items():
        out = F.when(name.startswith(prefix), label) if out is None else out.when(name.startswith(prefix), label)
    return out.otherwise("golden")


def searched(documents: DataFrame, needle: str, column: str = "name", newest: str = "created") -> DataFrame:
    """Documents whose column holds the needle, letters of ASCII in either case, newest first; % and _ stand for themselves."""
    small = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return documents.where(F.contains(small(F.col(column)), small(F.lit(needle)))).orderBy(F.desc(newest))


def upload_checks(files: DataFrame, suffixes: tuple[str, ...], most_bytes: int, most_total: int, most_pages: int) -> DataFrame:
    """(upload, name, reason) of files that an upload may not hold: upload, name, bytes, pages. A total over the limit rejects all its files."""
    total = files.groupBy("upload").agg(F.sum("bytes").alias("all_bytes"))
    suffix = F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1))
    why = F.when(~suffix.isin(*suffixes), "unsupported_document").when(F.col("bytes") > most_bytes, "file_too_large").when(F.col("all_bytes") > most_total, "upload_too_large").when(F.col("pages") > most_pages, "too_many_pages")
    return files.join(total, "upload").select("upload", "name", why.alias("reason")).where("reason is not null")


def item_numbers(docs: DataFrame, items: str, fields: tuple[str, ...], doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, path, value) of every numeric cell of a repeated list, with its place in the path."""
    x = docs.select(doc_id, F.posexplode(items).alias("pos", "x"))
    cells = F.array(*[F.struct(F.concat(F.lit(f"{items}["), F.col("pos"), F.lit(f"].{f}")).alias("path"), F.col(f"x.{f}").cast("decimal(28,6)").alias("value")) for f in fields])
    return x.select(doc_id, F.explode(cells).alias("c")).select(doc_id, "c.*").where("value is not null")
