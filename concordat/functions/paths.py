"""Paths into nested rows, ``seller.tax_ids[0].value``, compiled to column expressions.

A path is read, written or built against a schema, when the plan is made: what it says is
generated code afterwards, without a look at any row. Names that a schema lacks and places
that an array lacks read as null; writing makes what is missing on the way. Cells of a long
table, (document, path, value), become nested documents again by their schema.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F, types as T

from concordat.functions.bind import let

PART = re.compile(r"([^.\[\]]+)((?:\[\d+\])*)")
Steps = tuple[str | int, ...]


def parse(path: str) -> Steps:
    """Names and places in order; ValueError for what is no path."""
    steps: list[str | int] = []
    for part in path.split("."):
        m = PART.fullmatch(part)
        if not m:
            raise ValueError(f"no path: {path!r}")
        steps += [m[1], *map(int, re.findall(r"\d+", m[2]))]
    return tuple(steps)


def written_as(steps: Steps) -> str:
    return "".join(f"[{s}]" if isinstance(s, int) else f".{s}" for s in steps).lstrip(".")


def kind_at(kind: T.DataType, path: str) -> T.DataType | None:
    """The type at a path, None where there is none."""
    for s in parse(path):
        if isinstance(s, int):
            kind = kind.elementType if isinstance(kind, T.ArrayType) else None
        else:
            kind = kind[s].dataType if isinstance(kind, T.StructType) and s in kind.fieldNames() else None
        if kind is None:
            return None
    return kind


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def read(schema: T.StructType, path: str, root: Column | None = None) -> Column:
    """The value at ``path`` of a row, or of the struct ``root``: null where any step is missing."""
    if kind_at(schema, path) is None:
        return F.lit(None)
    first, *rest = parse(path)
    c = F.col(quoted(first)) if root is None else root[first]
    for s in rest:
        c = F.get(c, F.lit(s)) if isinstance(s, int) else c[s]
    return c


def read_variant(document: Column, path: str, kind: str = "string") -> Column:
    """The same in a document without a schema; null where a step is missing or the value is not of the kind."""
    return F.try_variant_get(document, "$" + "".join(f"[{s}]" if isinstance(s, int) else f"['{s}']" for s in parse(path)), kind)


def widened(kind: T.DataType | None, steps: Steps, leaf: T.DataType) -> T.DataType:
    """``kind`` with room for a ``leaf`` at ``steps``."""
    if not steps:
        return leaf
    step, *rest = steps
    if isinstance(step, int):
        return T.ArrayType(widened(kind.elementType if isinstance(kind, T.ArrayType) else None, tuple(rest), leaf))
    fields = {f.name: f.dataType for f in kind} if isinstance(kind, T.StructType) else {}
    fields[step] = widened(fields.get(step), tuple(rest), leaf)
    return T.StructType([T.StructField(n, k) for n, k in fields.items()])


def fitted(value: Column, old: T.DataType | None, new: T.DataType) -> Column:
    """A value of a type as one of a wider type, null staying null."""
    if old is None:
        return F.lit(None).cast(new)
    if isinstance(new, T.StructType) and isinstance(old, T.StructType):
        if old.simpleString() == new.simpleString():
            return value
        names = old.fieldNames()
        made = F.struct(*[fitted(value[f.name] if f.name in names else F.lit(None), old[f.name].dataType if f.name in names else None, f.dataType).alias(f.name) for f in new])
        return F.when(value.isNotNull(), made)
    if isinstance(new, T.ArrayType) and isinstance(old, T.ArrayType):
        if old.simpleString() == new.simpleString():
            return value
        return F.transform(value, lambda x: fitted(x, old.elementType, new.elementType))
    return value.cast(new)


def placed(old: Column | None, kind: T.DataType | None, steps: Steps, value: Column, leaf: T.DataType) -> Column:
    """``old`` with ``value`` at ``steps``."""
    if not steps:
        return value.cast(leaf)
    step, rest = steps[0], steps[1:]
    if isinstance(step, str):
        fields = {f.name: f.dataType for f in kind} if isinstance(kind, T.StructType) else {}
        below = placed(old[step] if step in fields else None, fields.get(step), rest, value, leaf)
        return F.struct(*[(below if n == step else old[n]).alias(n) for n in [*fields, *([] if step in fields else [step])]])
    inner = kind.elementType if isinstance(kind, T.ArrayType) else None
    wide = widened(inner, rest, leaf)
    if inner is None:
        return F.concat(F.array_repeat(F.lit(None).cast(wide), step), F.array(placed(None, None, rest, value, leaf).cast(wide)))
    there = F.coalesce(old, F.array().cast(kind))
    here = placed(F.get(there, F.lit(step)), inner, rest, value, leaf)
    return F.transform(F.sequence(F.lit(0), F.greatest(F.size(there), F.lit(step + 1)) - 1), lambda j: F.when(j == step, here).otherwise(fitted(F.get(there, j), inner, wide)))


def write(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """``df`` with a value at each path, in the order given. Structs, fields and places that are missing are made; places
    between are null. What stands in the way of a path and is neither struct nor array is replaced."""
    for path, value in values.items():
        steps = parse(path)
        schema, leaf = df.schema, df.select(value.alias("v")).schema["v"].dataType
        name = steps[0]
        there = name in schema.fieldNames()
        kind = schema[name].dataType if there else None
        df = df.withColumn(name, placed(F.col(quoted(name)) if there else None, kind, steps[1:], value, leaf))
    return df


def from_cells(cells: DataFrame, schema: T.StructType, key: str = "doc_id", path: str = "path", value: str = "value") -> DataFrame:
    """Documents of ``schema`` from their cells (key, path, value as string).

    Lists are as long as the highest place that a path names; a value that is not of its type, and what no path names, is
    null, and so is a struct of which no path names anything. Paths that the schema lacks are not read; of repeated paths
    the least value counts. Cells are dealt by document once; both aggregations, by path and by document, are over its own cells.
    """
    once = cells.where(F.col(path).isNotNull()).select(key, F.col(path).alias("__path"), F.col(value).cast("string").alias("__value")).repartition(key)
    once = once.groupBy(key, "__path").agg(F.min("__value").alias("__value"))
    found = once.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("__path", "__value"))).alias("__cells"))
    at = F.col("__cells")

    def build(kind: T.DataType, where: Column, names: Column) -> Column:
        if isinstance(kind, T.StructType):
            made = F.struct(*[inner(f.dataType, F.concat(where, F.lit(f".{f.name}")), names).alias(f.name) for f in kind])
            return F.when(F.size(names) > 0, made)
        places = F.transform(F.filter(names, lambda n: F.startswith(n, F.concat(where, F.lit("[")))), lambda n: F.regexp_extract(F.substr(n, F.length(where) + 1), r"^\[(\d+)\]", 1).try_cast("int"))
        element = lambda i: inner(kind.elementType, F.concat(where, F.lit("["), i.cast("string"), F.lit("]")), names)
        return let(F.array_max(places), lambda top: F.when(top.isNotNull(), F.transform(F.sequence(F.lit(0), top), element)), kind)

    def inner(kind: T.DataType, where: Column, names: Column) -> Column:
        """The names below a path are found once for all that is built from them, not once for each element of a list."""
        if not isinstance(kind, (T.StructType, T.ArrayType)):
            return F.try_element_at(at, where).try_cast(kind)
        return let(where, lambda w: let(F.filter(names, lambda n: below(n, w)), lambda own: build(kind, w, own), kind), kind)

    def below(name: Column, where: Column) -> Column:
        return F.startswith(name, where) & F.substr(name, F.length(where) + 1, F.lit(1)).isin("", ".", "[")

    names = F.map_keys(at)
    return found.select(key, *[inner(f.dataType, F.lit(f.name), names).alias(f.name) for f in schema])


def cited(cells: DataFrame, key: str = "doc_id", path: str = "path") -> DataFrame:
    """(key, field_locations: map of path to page and quote) of the cells that a quote backs, from (key, path, page, quote).

    Of a path cited twice the first page and quote in order count; a document without citations has no row.
    """
    one = cells.where(F.trim("quote") != "").repartition(key).groupBy(key, path).agg(F.min(F.struct("page", "quote")).alias("__at"))
    return one.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(path, "__at")))).alias("field_locations"))
