"""Words from what recognisers give for a line: tokens with boxes, or the line's box alone.

A line's tokens do not end where its words do. They are cut at white space, and what stands
between two gaps is one word whose box is the union of its tokens' boxes. A line without
(fitting) token boxes shares its own box out by characters. Both are expressions over one
row, a line; pages of any number of lines need no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from concordat.functions.bind import let

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
WORD = "struct<text:string,x0:double,y0:double,x1:double,y1:double>"
GAP = r"(?U)\s+"


def joined(tokens: Column, boxes: Column) -> Column:
    """array of words from an array of texts and one of boxes, of the same length; null where a token is.

    What stands between gaps is told by numbers alone: every run of a token is written as the token's number and a comma, every gap as a
    space, so a word is the list of its tokens' numbers. Time is in proportion to the line.
    """
    marks = F.array_join(F.transform(tokens, lambda t, i: F.regexp_replace(F.regexp_replace(t, GAP, " "), F.lit("[^ ]+"), F.concat(i.cast("string"), F.lit(",")))), "")
    texts, places = full(F.split(F.array_join(tokens, ""), GAP)), full(F.split(marks, " "))

    def union(boxes: Column) -> Column:
        own = lambda place: F.transform(full(F.split(place, ",")), lambda i: F.get(boxes, i.cast("int")))
        edge = lambda f, name: lambda bs: f(F.transform(bs, lambda b: b[name])).alias(name)
        edges = (edge(F.array_min, "x0"), edge(F.array_min, "y0"), edge(F.array_max, "x1"), edge(F.array_max, "y1"))
        return F.zip_with(texts, places, lambda t, place: let(own(place), lambda bs: F.struct(t.alias("text"), *[e(bs) for e in edges]), WORD))

    return F.when(F.forall(tokens, lambda t: t.isNotNull()), let(boxes, union, f"array<{WORD}>"))


def full(texts: Column) -> Column:
    return F.filter(texts, lambda t: t != "")


def shared_out(text: Column, box: Column) -> Column:
    """array of words of a line, each with its characters' share of the line's box; one character's width lies between two. What words have
    in common is bound by ``let``: it would be found again for each of them."""
    words = f"array<{WORD}>"

    def placed(x: Column) -> Column:
        starts = F.concat(F.array(F.lit(0)), F.array_compact(F.transform(F.split(x["line"], ""), lambda c, i: F.when(c == " ", i + 1))))
        at = lambda n: x["box"]["x0"] + x["step"] * n
        word = lambda w, n: F.struct(w.alias("text"), at(n).alias("x0"), x["box"]["y0"].alias("y0"), at(n + F.length(w)).alias("x1"), x["box"]["y1"].alias("y1"))
        return F.when(x["line"] != "", F.zip_with(x["words"], starts, word)).otherwise(F.array().cast(words))

    line = lambda w: F.struct(w.alias("words"), F.array_join(w, " ").alias("line"), box.alias("box"))
    step = lambda x: F.struct(x["words"].alias("words"), x["line"].alias("line"), x["box"].alias("box"), ((x["box"]["x1"] - x["box"]["x0"]) / F.greatest(F.length(x["line"]), F.lit(1))).alias("step"))
    return let(full(F.split(text, GAP)), lambda w: let(line(w), lambda x: let(step(x), placed, words), words), words)


def words_of_lines(lines: DataFrame) -> DataFrame:
    """(page, line, word, text, x0, y0, x1, y1, confidence) from lines (page, line, text, confidence, box, tokens, token_boxes).

    ``tokens`` and ``token_boxes`` are arrays or null; where they are missing, empty or of different lengths, the line's box
    is shared out. A line without words gives none; words are numbered in line order from 0.
    """
    fits = F.coalesce((F.size("tokens") > 0) & (F.size("tokens") == F.size("token_boxes")), F.lit(False))
    box = F.col("box").cast(BOX)
    words = F.when(fits, joined(F.col("tokens"), F.col("token_boxes").cast(f"array<{BOX}>"))).otherwise(shared_out(F.col("text"), box))
    return lines.select("page", "line", "confidence", F.posexplode(words).alias("word", "w")).select("page", "line", "word", "w.*", "confidence")


def line_height(lines: DataFrame) -> DataFrame:
    """(page, height): the median height of a page's lines, 0 without any."""
    return lines.groupBy("page").agg(F.coalesce(F.median(F.col("box.y1") - F.col("box.y0")), F.lit(0.0)).alias("height"))


def text_only(pages: DataFrame) -> DataFrame:
    """Pages that came as text alone, in the shape of measured ones: no boxes, no size, full confidence (page, text)."""
    none = lambda kind: F.lit(None).cast(kind)
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.trim(x) != "")
    return pages.select("page", none("double").alias("width"), none("double").alias("height"), F.posexplode(lines).alias("line", "text")).select(
        "page", "width", "height", "line", "text", none(BOX).alias("box"), F.lit(1.0).alias("confidence")
    )
