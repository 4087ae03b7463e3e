"""Reading backends by name: a registry, which of them a caller gets, and the chain over pages.

A backend is a plan: it takes a table of pages and gives one of readings, so an engine that
runs in Python workers, a service's recorded answers and a text layer are all joined the same
way. Nothing runs when a backend is registered or chosen; ``available`` says beforehand why one
cannot run here.

A chain asks its backends in order. Each gets only the pages that no backend before it has read
acceptably, and the next one starts from a table, not from all plans before it.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from concordat.functions import text
from concordat.session import cut

AUTO = "auto"
READING = ("page", "text", "confidence")


class Backend(NamedTuple):
    """``read``: pages (page and any columns) to readings (page, text, confidence), at most one a page; ``missing``: why it cannot run, or None."""

    name: str
    read: Callable[[DataFrame], DataFrame]
    missing: Callable[[], str | None] = lambda: None


class BackendError(ValueError):
    """A backend that nobody registered, or that cannot run here although the caller asked for it by name."""


class Registry:
    def __init__(self) -> None:
        self.backends: dict[str, Backend] = {}

    def add(self, backend: Backend, *, replace: bool = False) -> None:
        if not backend.name or backend.name == AUTO or backend.name != backend.name.strip().lower():
            raise BackendError(f"no name for a backend: {backend.name!r}")
        if backend.name in self.backends and not replace:
            raise BackendError(f"{backend.name} is registered already")
        self.backends[backend.name] = backend

    def get(self, name: str) -> Backend:
        if name not in self.backends:
            raise BackendError(f"unknown backend {name!r}; there are {', '.join(self.backends) or 'none'}")
        return self.backends[name]

    def status(self) -> list[tuple[str, str | None]]:
        """(name, why it cannot run) in order of registration."""
        return [(n, b.missing()) for n, b in self.backends.items()]

    def chain(self, wanted: str) -> list[Backend]:
        """The backends of a setting: names between commas, of which ``auto`` stands for the first that can run.

        A name that is there twice counts once, in its first place. A backend asked for by its own name must be able to run;
        ``auto`` with none that can is an error too.
        """
        out: list[Backend] = []
        for name in [n.strip().lower() for n in wanted.split(",") if n.strip()] or [AUTO]:
            if name == AUTO:
                found = next((b for b in self.backends.values() if b.missing() is None), None)
                if found is None:
                    raise BackendError("no backend can run here: " + "; ".join(f"{n}: {why}" for n, why in self.status()))
            else:
                found = self.get(name)
                why = found.missing()
                if why is not None:
                    raise BackendError(f"{name} cannot run here: {why}")
            if found not in out:
                out.append(found)
        return out


def recorded(name: str, readings: DataFrame, missing: Callable[[], str | None] = lambda: None) -> Backend:
    """A backend that gives the readings of a table (page, text, confidence): an engine's answers as they were kept."""
    return Backend(name, lambda pages: pages.select("page").join(readings.select(*READING), "page"), missing)


def read_pages(pages: DataFrame, chain: list[Backend], acceptable: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(page, backend, text, confidence, attempts): the first acceptable reading of each page, else its most confident one.

    ``acceptable(text, confidence)`` is the quality gate of texts unless given. Between readings that are equally confident the
    earlier backend wins; a page that none reads has nulls. ``attempts`` counts the backends that were asked.
    """
    good = acceptable or (lambda t, c: text.quality_ok(t))
    asked = pages.select("page").distinct()
    left, found = pages, None
    for k, backend in enumerate(chain):
        r = backend.read(left).select("page", F.lit(k).alias("rank"), F.lit(backend.name).alias("backend"), "text", F.col("confidence").cast("double").alias("confidence"))
        r = cut(r.withColumn("ok", F.coalesce(good(F.col("text"), F.col("confidence")), F.lit(False))))
        found = r if found is None else found.unionByName(r)
        if k < len(chain) - 1:
            left = cut(left.join(r.where("ok").select("page"), "page", "left_anti"))
    if found is None:
        none = {"backend": "string", "text": "string", "confidence": "double"}
        return asked.select("page", *[F.lit(None).cast(t).alias(c) for c, t in none.items()], F.lit(0).alias("attempts"))
    order = F.struct(F.col("ok"), F.when(F.col("ok"), F.lit(0.0)).otherwise(F.coalesce("confidence", F.lit(-1.0))).alias("c"), (-F.col("rank")).alias("r"))
    best = found.groupBy("page").agg(F.max_by(F.struct("backend", "text", "confidence", "rank", "ok"), order).alias("b"))
    tried = F.when(F.col("b.ok"), F.col("b.rank") + 1).otherwise(len(chain))
    return asked.join(best, "page", "left").select("page", "b.backend", "b.text", "b.confidence", F.coalesce(tried, F.lit(len(chain))).alias("attempts"))
