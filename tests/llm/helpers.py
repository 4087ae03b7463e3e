"""Inputs that every operator must take: nulls, empties, ties, repeats, clashing names, nothing at all."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice("abcdefghijklmnop") * r.randrange(1, 3) + str(r.randrange(40)).translate(str.maketrans("0123456789", "qrstuvwxyz")) for _ in range(n))


def odd_docs(spark, extra: bool = False):
    base = prose(1, 80)
    rows = [
        (1, base, "en", "a", 1), (2, base, "en", "b", 1), (2, base, "en", "b", 1), (3, None, "en", None, None), (4, "", "en", "a", 0), (5, " \t\n\r ", "en", "a", 5),
        (None, prose(2, 60), None, "a", 3), (6, prose(3, 60000), "en", "c", 9), (7, "one", "en", "c", 3), (8, base.replace(base.split()[40], "zzz", 1), "en", "c", 1), (9, "x\x00y é😀 " * 30, "fr", "c", 2),
    ]
    df = spark.createDataFrame(rows, DOCS)
    if extra:
        for name in ("size", "kept", "sequence_id", "hash", "r1", "node", "template", "n_words", "__x", "bucket", "class_id", "ids", "start", "dropped_at", "taken"):
            from pyspark.sql import functions as F

            df = df.withColumn(name, F.lit("clash"))
    return df


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


def labels(spark, pairs=((1, 1), (2, 1), (7, 0), (4, 0), (None, 1), (9, None), (1, 0))):
    return spark.createDataFrame([(i, q, 0) for i, q in pairs], "doc_id long, quality int, toxic int")
