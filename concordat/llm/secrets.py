"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Candidates are found by pattern in every whole text, with positions in code points: the
pieces between matches (``split``) and the matches (``regexp_extract_all``) of one pattern
alternate, so running sums of their lengths are the positions; very long texts with very
many matches take work in proportion to them. Their SHA-256 hashes are
then counted over the corpus by distinct repository and owner. What many owners hold is a
copied example; what few hold looks like a live credential. Candidates of the pattern
kinds are always reported, with that verdict; long mixed tokens that no pattern kind covers
are reported only when few owners hold them.

Counting goes (hash, owner, repository), (hash, owner), (hash), each after a partial
aggregate in the map tasks, so an example that a third of all rows hold is a few rows for
each map task. The join back to the candidates has plain shuffles of tables cut off before
it on both sides, which adaptive execution can split where a hash is hot.

Nulls: a null text is empty; a null repository or owner counts as one more value. A
candidate repeated in rows of one owner counts that owner once. Spans that start together
are listed by kind. Empty tables give an empty result. Rows that repeat are reported each.
Other columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from concordat.llm.shared import cut

# The patterns of the contract, in the order in which kinds are listed, with the least length of group ``g``.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: A run of 20 or more of these with a digit, a small and a capital letter; ordinary words have no digit.
MIXED = r"[A-Za-z0-9_-]{20,}"
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "mixed")
CHUNK = 256
ANY = r"(?i:password|passwd|secret|token|api_?key)|AKIA[A-Z0-9]{14}|[0-9a-f]{16}|[A-Za-z0-9_-]{20}"


def located(text: Column, pattern: str, kind: int, group: int = 0, least: int = 0) -> Column:
    """array<struct<start, kind, end, value>> of the matches whose ``group`` has ``least`` characters.

    Lengths are summed over runs of CHUNK matches first, then inside each run, so the work is in proportion to the matches.
    """
    p = F.lit(pattern)
    found = F.arrays_zip(
        F.regexp_extract_all(text, p, F.lit(0)).alias("m"), F.regexp_extract_all(text, p, F.lit(group)).alias("v"),
        F.split(text, pattern, -1).alias("before"),
    )
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,value:string>>")
    width = lambda x: F.char_length(x["before"]) + F.coalesce(F.char_length(x["m"]), F.lit(0))

    def step(acc: Column, x: Column) -> Column:
        at = acc["at"] + F.char_length(x["before"])
        end = at + F.coalesce(F.char_length(x["m"]), F.lit(0))
        one = F.struct(at.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["v"].alias("value"))
        keep = F.coalesce(F.char_length(x["v"]) >= least, F.lit(False))
        return F.struct(end.alias("at"), F.when(keep, F.concat(acc["out"], F.array(one))).otherwise(acc["out"]).alias("out"))

    def offsets(runs: Column) -> Column:
        """Each run with the length of all before it."""
        add = lambda acc, r: F.concat(acc, F.array(F.element_at(acc, -1) + F.aggregate(r, F.lit(0).cast("long"), lambda n, x: n + width(x))))
        return F.arrays_zip(runs.alias("run"), F.aggregate(runs, F.array(F.lit(0).cast("long")), add).alias("at"))

    def spans(f: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(f) - 1) / CHUNK).cast("int")), lambda c: F.slice(f, c * CHUNK + 1, CHUNK))
        each = F.filter(offsets(runs), lambda z: z["run"].isNotNull())
        return F.flatten(F.transform(each, lambda z: F.aggregate(z["run"], F.struct(z["at"].alias("at"), none.alias("out")), step)["out"]))

    # Assignments keep their value for the count; the span is the whole match. The one-element array names ``found`` once.
    return F.coalesce(F.when(text.rlike(pattern), F.flatten(F.transform(F.array(found), spans))), none)


def scan(
    docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", repository: str = "doc_id", owner: str = "source", most_owners: int = 2,
) -> DataFrame:
    """doc_id and ``spans``: array<struct<start, kind, end, hash, owners, repositories, live>>, by start, then kind.

    ``kind`` indexes KINDS. ``live`` is true where at most ``most_owners`` owners hold the value.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,value:string>>")
    base = F.concat(located(F.col("t"), ASSIGN, 0, 2, 12), located(F.col("t"), ACCESS, 1), located(F.col("t"), HEX, 2))
    mixed = F.filter(
        located(F.col("t"), MIXED, 3),
        lambda x: x["value"].rlike("[0-9]") & x["value"].rlike("[a-z]") & x["value"].rlike("[A-Z]"),
    )
    free = F.filter(F.col("mixed"), lambda m: ~F.exists(F.col("base"), lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    hashed = lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), F.sha2(x["value"], 256).alias("hash"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(repository).cast("string").alias("repository"), F.col(owner).cast("string").alias("owner"), t.alias("t"))
    hit = F.col("t").rlike(ANY)
    rows = rows.withColumn("base", F.when(hit, base).otherwise(none)).withColumn("mixed", F.when(hit, mixed).otherwise(none))
    rows = rows.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "repository", "owner",
        F.array_sort(F.transform(F.concat("base", free), hashed)).alias("found"),
    )
    rows = cut(rows)

    each = rows.select("row", "repository", "owner", F.explode("found").alias("c")).select("row", "repository", "owner", "c.*")
    freq = (
        each.groupBy("hash", "owner", "repository").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repositories"))
        .groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories"))
    )
    marked = each.select("row", "start", "kind", "end", "hash").join(cut(freq), "hash")
    marked = marked.withColumn("live", F.col("owners") <= most_owners).where(F.col("live") | (F.col("kind") < len(BASE_KINDS)))
    spans = marked.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "hash", "owners", "repositories", "live"))).alias("spans"))
    return rows.select("row", "doc_id").join(spans, "row", "left").select(
        "doc_id", F.coalesce("spans", F.array().cast(spans.schema["spans"].dataType)).alias("spans")
    )


def written(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")


def digest(found: DataFrame) -> DataFrame:
    """The columns of the contract, and how many spans look live."""
    s = F.col("spans")
    of = lambda k: F.size(F.filter(s, lambda x: x["kind"] == k)).cast("long")
    base = F.filter(s, lambda x: x["kind"] < len(BASE_KINDS))
    return found.select(
        "doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"), F.sha2(written(base), 256).alias("base_sha256"),
        written(s).alias("spans"), F.size(F.filter(s, lambda x: x["live"])).cast("long").alias("n_live"),
        F.size(F.filter(s, lambda x: ~x["live"])).cast("long").alias("n_example"),
    )
