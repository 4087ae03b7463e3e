"""Session builder and the few settings every plan here relies on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "concordat", cpus: int | None = None, **conf: str) -> SparkSession:
    """A local session for tests and benches; on a cluster the caller brings its own."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    b = (
        SparkSession.builder.appName(app)
        .master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once into the folder that ``spark.checkpoint.dir`` names; where it is unset, a local session takes a
    temporary folder and a cluster its warehouse."""
    sc, conf = df.sparkSession.sparkContext, df.sparkSession.conf
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        local = sc.master.startswith("local") and not sc.master.startswith("local-cluster")
        sc.setCheckpointDir(conf.get("spark.checkpoint.dir", None) or (tempfile.mkdtemp(prefix="concordat-") if local else conf.get("spark.sql.warehouse.dir") + "/_checkpoints"))
    return df.checkpoint(eager=True)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """``df`` dealt by key over all cores, for steps that cost much a row: a small file, and a small shuffle that Spark joins together, are
    one task otherwise. Sides that are dealt by the same key meet without another shuffle."""
    spark = df.sparkSession
    return df.repartition(max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *by)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
