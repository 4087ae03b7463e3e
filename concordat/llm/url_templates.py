"""URL filter by a path-template tree per host.

Explicit rules decide first: a rule of (host, path) fits its host and all subdomains where
the url's path starts with the rule's; the longest rule wins. Urls that no rule fits are
judged by the tree.

The tree is built level by level over distinct shapes of paths with their counts. Digit
runs, long hexadecimal runs and the like are wildcards from the start. At each level a node
with more than ``WIDE`` children has its rare children generalised into one wildcard
branch, and sibling branches whose labelled shares do not differ significantly (a
two-proportion test against their siblings together) are merged into one. A template, the
path of branches of one host, is rejected if enough labelled urls fall on it and the share
of bad ones, smoothed towards the share among all labelled urls, reaches ``purity``.

Each level groups by (host, prefix, child) after a partial aggregation, never by host
alone, and joins tables that were cut off before, which adaptive execution can split: a
host that holds a third of all rows is no single task.

A node under which a single path is left is closed with all of it, and steps that all paths
of a node share are taken at once, so the levels follow the branching, not the longest path;
paths of any depth are parsed to their end. Each level's tables are files under the shared
folder, with sizes known anew, and go when the next level stands.

Labels are urls with a verdict. Without a table of them, the urls that the rules decide
are labelled, and all that hold one of ``WORDS`` as a word of the host or path are labelled
bad, also where a rule allows them; the tree then carries that to the templates. Nulls: a null url, or one without ``://``, has an empty host and
path and is judged like any other. A host is what the url says, with port or user if any.
Of rules of one length the first given wins. Empty tables give an empty result. Rows that
repeat are judged each, and count each. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from concordat.llm.shared import Gathered, cut, discard, stored

# The rules of the contract.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: Words of urls that mark them as bad where nothing else labels them; a parameter of ``judge``.
WORDS = ("adult", "ads", "bets", "casino", "cialis", "escort", "gambling", "lottery", "pills", "poker", "porn", "replica", "slots", "viagra", "xxx")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(url)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), F.coalesce(path, F.lit(""))


def ruling(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """(rule as host and path written together, verdict), both null where none fits. At equal lengths the first given wins."""
    rule = verdict = None
    for kind, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    return (F.lit(None).cast("string"),) * 2 if rule is None else (rule, verdict)


def shape(segment: Column) -> Column:
    """The segment with its variable parts as wildcards."""
    s = F.regexp_replace(segment, r"(?i)[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", "{u}")
    s = F.regexp_replace(s, r"(?i)(?<![0-9a-z])(?=[a-f]*[0-9])[0-9a-f]{8,}(?![0-9a-z])", "{h}")
    return F.regexp_replace(s, r"[0-9]+", "{n}")


def steps(path: Column) -> Column:
    """Shapes of all segments."""
    return F.transform(F.split(F.regexp_replace(path, "^/", ""), "/", -1), shape)


def suspicious(host: Column, path: Column, words: tuple[str, ...]) -> Column:
    return F.arrays_overlap(F.split(F.lower(F.concat_ws("/", host, path)), "[^a-z0-9]+"), F.array(*[F.lit(w) for w in words]).cast("array<string>"))


def templates(counted: DataFrame, *, wide: int, rare: float, same_z: float, least_labelled: int) -> DataFrame:
    """host, key, template, n, labelled, bad of each path, from host, steps, n, labelled, bad; ``key`` is the path's steps in one string.

    A node with more than ``wide`` children joins those with less than a ``rare`` share of it into one; labelled siblings
    whose share of bad ones differs by at most ``same_z`` deviations from that of the others, which have ``least_labelled``
    labels, become one.
    """
    ended = Gathered(counted.sparkSession)
    t = stored(counted.select("host", "steps", F.array_join("steps", "/").alias("key"), "n", "labelled", "bad", F.lit("").alias("template")))
    node = ["host", "template"]
    while True:
        done = F.size("steps") == 0
        # The steps that all paths of a node share: those that the least and the greatest of them share.
        nodes = stored(t.where(~done).groupBy(*node).agg(F.count(F.lit(1)).alias("paths"), F.min("steps").alias("low"), F.max("steps").alias("high")))
        ended.add(t.where(done))
        if nodes.isEmpty():
            discard(t, nodes)
            break
        size = F.least(F.size("low"), F.size("high"))
        differs = F.array_position(F.transform(F.sequence(F.lit(1), size), lambda i: F.get("low", i - 1) != F.get("high", i - 1)), True)
        shared = F.when(differs > 0, differs - 1).otherwise(size).cast("int")
        on = t.where(~done).join(nodes.select(*node, F.when(F.col("paths") > 1, shared).otherwise(F.lit(2**31 - 1)).alias("shared")), node)
        name = F.when(F.col("shared") == 0, F.col("template")).otherwise(F.concat("template", F.lit("/"), F.array_join(F.slice("steps", 1, F.col("shared")), "/")))
        at = F.least("shared", F.size("steps"))
        rest = F.when(at < F.size("steps"), F.slice("steps", at + 1, F.size("steps"))).otherwise(F.slice("steps", 1, 0))
        went = stored(on.select("host", rest.alias("steps"), "key", "n", "labelled", "bad", name.alias("template")))
        discard(t, nodes)
        ended.add(went.where(done))

        here = went.where(~done).withColumn("child", F.get("steps", F.lit(0)))
        children = stored(here.groupBy(*node, "child").agg(F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad")))
        above = stored(children.groupBy(*node).agg(F.count(F.lit(1)).alias("children"), F.sum("n").alias("all"), F.sum("labelled").alias("all_labelled"), F.sum("bad").alias("all_bad")))
        x = children.join(above, node)
        others, others_bad = F.col("all_labelled") - F.col("labelled"), F.col("all_bad") - F.col("bad")
        share = F.col("all_bad") / F.nullif(F.col("all_labelled"), F.lit(0))
        deviation = F.sqrt(share * (1 - share) * (1 / F.nullif(F.col("labelled"), F.lit(0)) + 1 / F.nullif(others, F.lit(0))))
        apart = F.abs(F.col("bad") / F.nullif(F.col("labelled"), F.lit(0)) - others_bad / F.nullif(others, F.lit(0)))
        alike = (F.col("labelled") > 0) & (others >= least_labelled) & (apart <= same_z * deviation)
        few = (F.col("children") > wide) & (F.col("n") < rare * F.col("all"))
        branch = F.when(few, "{*}").when(F.coalesce(alike, F.lit(False)), "{~}").otherwise(F.col("child"))
        made = stored(x.select(*node, "child", branch.alias("branch")))
        tail = F.slice("steps", 2, F.greatest(F.size("steps"), F.lit(1)))
        t = stored(here.join(made, [*node, "child"]).select("host", tail.alias("steps"), "key", "n", "labelled", "bad", F.concat("template", F.lit("/"), "branch").alias("template")))
        discard(went, children, above, made)
    return ended.table(t.schema).drop("steps")


def judge(
    pages: DataFrame, labels: DataFrame | None = None, *, rules: tuple = RULES, url: str = "url", page_id: str = "page_id",
    purity: float = 0.9, weight: float = 2.0, words: tuple[str, ...] = WORDS,
    wide: int = 32, rare: float = 0.05, same_z: float = 2.0, least_labelled: int = 5,
) -> DataFrame:
    """page_id, host, path, rule, verdict, template and the template's smoothed purity for every row.

    ``labels`` has a url and bad (0 or 1). ``weight`` is the number of urls that the prior counts for.
    """
    def parsed(df: DataFrame, *more: str) -> DataFrame:
        host, path = host_and_path(F.col(url).cast("string"))
        df = df.select(*more, host.alias("host"), path.alias("path"))
        rule, verdict = ruling(F.col("host"), F.col("path"), rules)
        return df.withColumn("rule", rule).withColumn("decided", verdict).withColumn("steps", steps(F.col("path")))

    rows = parsed(pages, F.col(page_id).alias("page_id"))
    marked = suspicious(F.col("host"), F.col("path"), words)
    known = F.col("decided").isNotNull() | marked if labels is None else F.lit(False)
    is_bad = marked | F.coalesce(F.col("decided") == "block", F.lit(False))
    count = rows.groupBy("host", "steps").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(known).alias("labelled"), F.count_if(known & is_bad).alias("bad")
    )
    if labels is not None:
        marked = parsed(labels.where("bad in (0, 1)"), F.col("bad").cast("long").alias("bad"))
        marked = marked.groupBy("host", "steps").agg(F.lit(0).cast("long").alias("n"), F.count(F.lit(1)).alias("labelled"), F.sum("bad").alias("bad"))
        count = count.unionByName(marked).groupBy("host", "steps").agg(F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    t = templates(count, wide=wide, rare=rare, same_z=same_z, least_labelled=least_labelled)
    total = t.agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad")).first()
    prior = total["bad"] / total["labelled"] if total["labelled"] else 0.0
    smooth = (F.col("bad") + weight * prior) / (F.col("labelled") + weight)
    worth = t.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad")).select(
        "host", "template", smooth.alias("purity"), ((F.col("labelled") >= least_labelled) & (smooth >= purity)).alias("reject")
    )
    # A template belongs to (host, steps); the shapes are one string in the join back.
    of = cut(t.join(cut(worth), ["host", "template"]).select("host", "key", "template", "purity", "reject"))
    return rows.withColumn("key", F.array_join("steps", "/")).join(of, ["host", "key"], "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("decided", F.when(F.col("reject"), "block").otherwise("allow")).alias("verdict"), "template", "purity",
    )
