"""Tables and columns on small inputs."""

from pyspark.sql import functions as F

from concordat.operators import tables

SEG = "page int, row int, x0 double, x1 double, y0 double, y1 double, text string"


def grid(spark, rows, page=1, width=10.0):
    out = []
    for r, cells in enumerate(rows):
        out += [(page, r, c * width, c * width + 6.0, r * 2.0, r * 2.0 + 1.0, t) for c, t in enumerate(cells) if t]
    return spark.createDataFrame(out, SEG)


def test_aligned_tables_and_wrapped_cells(spark):
    d = grid(spark, [["Item", "Qty", "Price"], ["bolt", "2", "1.00"], ["nut", "3", "2.00"], ["a line of prose", "", ""]])
    cells = tables.aligned_tables(d)
    assert sorted((r.row, r.col, r.text) for r in cells.collect()) == [(0, 0, "Item"), (0, 1, "Qty"), (0, 2, "Price"), (1, 0, "bolt"), (1, 1, "2"), (1, 2, "1.00"), (2, 0, "nut"), (2, 1, "3"), (2, 2, "2.00")]
    w = spark.createDataFrame([(1, 0, 0, 0, "bolt"), (1, 0, 0, 1, "1.00"), (1, 0, 1, 0, "galvanised"), (1, 0, 2, 0, "nut"), (1, 0, 2, 1, "2.00")], "page int, table long, row long, col long, text string")
    assert sorted((r.row, r.col, r.text) for r in tables.merge_wrapped(w).collect()) == [(0, 0, "bolt galvanised"), (0, 1, "1.00"), (1, 0, "nut"), (1, 1, "2.00")]


def test_numeric_pairs(spark):
    assert tables.numeric_pairs(grid(spark, [["rent", "100.00"], ["water", "20,50"], ["other", "-"]])).count() == 6
    assert tables.numeric_pairs(grid(spark, [["rent:", "100.00"], ["water:", "20,50"], ["other:", "3"]])).count() == 0
    assert tables.numeric_pairs(grid(spark, [["name", "Ann"], ["town", "Ulm"], ["zip", "89073"]])).count() == 0


def test_gutter_and_reading_order(spark):
    left, right = "words on the left side", "words on the right side"
    d = grid(spark, [[left, right]] * 4)
    assert [(r.x0, r.x1) for r in tables.gutters(d).collect()] == [(6.0, 10.0)]
    order = [r.text for r in tables.reading_order(d).orderBy("position").collect()]
    assert order == [left] * 4 + [right] * 4
    assert tables.gutters(grid(spark, [[left, right]] * 3)).count() == 0


def test_words_of_long_lines_take_time_in_proportion(spark):
    import time

    from concordat.operators import tokens

    n = 12_000
    box = F.struct(*[F.lit(v).alias(c) for c, v in (("x0", 0.0), ("y0", 1.0), ("x1", 5.0 * n - 1), ("y1", 2.0))])
    lines = spark.range(2).select(F.lit(1).alias("page"), F.col("id").cast("int").alias("line"), F.array_join(F.array_repeat(F.lit("wörd"), n), " ").alias("text"), F.lit(0.9).alias("confidence"), box.alias("box"))
    pieces = F.when(F.col("line") == 1, F.regexp_extract_all("text", F.lit("(?s).{1,7}"), F.lit(0)))
    lines = lines.withColumn("tokens", pieces).withColumn("token_boxes", F.transform("tokens", lambda t, i: F.struct((i * 7.0).alias("x0"), F.lit(1.0).alias("y0"), (i * 7.0 + 7).alias("x1"), F.lit(2.0).alias("y1"))))
    began = time.time()
    got = {r.line: r for r in tokens.words_of_lines(lines).groupBy("line").agg(F.count("text").alias("n"), F.sum("x0").alias("x0"), F.sum("x1").alias("x1"), F.max("text").alias("text")).collect()}
    assert time.time() - began < 30  # a word's place found from the line's start each time took ten seconds for 4 lines of 4,000 words
    starts = [5 * k for k in range(n)]
    assert (got[0].n, got[0].x0, got[0].x1, got[0].text) == (n, sum(starts), sum(s + 4 for s in starts), "wörd")
    assert (got[1].n, got[1].x0, got[1].x1) == (n, sum(s // 7 * 7 for s in starts), sum((s + 3) // 7 * 7 + 7 for s in starts))
