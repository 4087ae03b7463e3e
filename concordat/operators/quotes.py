"""Where a quote stands on its page: every exact place, else the nearest run of characters.

A quote of n characters that a page prints with at most k = (1 - least) n errors, and that is
cut into k + 1 pieces, has one piece that the page prints as it is. So the pieces' exact places
tell where a near place can be at all, and only stretches around them are aligned: by the
bit-parallel recurrence for edit distances (Myers 1999), one step a character, with the whole
quote in one integer. A page without any piece is not aligned, however long it is.

The table has a row for each quote with its page's characters; rows are independent, so pages
are neither joined to each other nor gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

LEAST, ANCHOR = 0.8, 3


def places(text: str, part: str) -> Iterator[int]:
    """Every place of ``part``, overlapping ones too."""
    at = text.find(part)
    while at >= 0:
        yield at
        at = text.find(part, at + 1)


def stretches(quote: str, page: str, errors: int) -> list[tuple[int, int]]:
    """Parts of the page that can hold the quote with at most ``errors`` errors, apart from each other."""
    n, pieces = len(quote), errors + 1
    cuts = [i * n // pieces for i in range(pieces + 1)]
    found = sorted({(max(p - a - errors, 0), min(p - a + n + errors, len(page))) for a, b in zip(cuts, cuts[1:], strict=False) for p in places(page, quote[a:b])})
    out: list[tuple[int, int]] = []
    for a, b in found:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def ends(quote: str, part: str, *, anchored: bool = False) -> Iterator[tuple[int, int]]:
    """(place after, errors) for every end in ``part``: the least edit distance of the quote to what ends there, and, if it is
    ``anchored``, starts where ``part`` does."""
    n = len(quote)
    full, top = (1 << n) - 1, 1 << (n - 1)
    masks: dict[str, int] = {}
    for i, c in enumerate(quote):
        masks[c] = masks.get(c, 0) | 1 << i
    up, down, score = full, 0, n
    for at, c in enumerate(part, 1):
        eq = masks.get(c, 0)
        across = (((eq & up) + up) ^ up) | eq
        plus, minus = down | (full & ~(across | up)), up & across
        score += bool(plus & top) - bool(minus & top)
        plus, minus = ((plus << 1) | anchored) & full, (minus << 1) & full
        beside = eq | down
        up, down = minus | (full & ~(beside | plus)), plus & beside
        yield at, score


def nearest(quote: str, page: str, least: float = LEAST, anchor: int = ANCHOR) -> tuple[int, int, float] | None:
    """(start, end, score) of the run nearest to the quote, the first and then the longest of equals; None below ``least``.

    The score is one minus the errors' share of the quote. A quote below ``anchor`` characters has exact places only.
    """
    n = len(quote)
    room = int((1 - least) * n + 1e-9)
    if n < anchor or room == 0:
        return None
    best: tuple[int, int] | None = None
    for a, b in stretches(quote, page, room):
        for end, errors in ends(quote, page[a:b]):
            if errors <= room and (best is None or errors < best[1]):
                best = (a + end, errors)
    if best is None:
        return None
    end, errors = best
    # The start is the end of the reversed quote in the reversed stretch: its farthest one with as many errors.
    back = page[max(end - n - errors, 0) : end][::-1]
    start = max(at for at, e in ends(quote[::-1], back, anchored=True) if e == errors)
    return end - start, end, 1 - errors / n


def locate(quotes: DataFrame, least: float = LEAST, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, field, start, end, score) from (doc_id, field, quote, page_text), both in the form that quotes are looked up in.

    All exact places with score 1, else the nearest run. An empty or null quote or page has no place.
    """

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, field, quote, page in zip(pdf["doc_id"], pdf["field"], pdf["quote"], pdf["page_text"], strict=True):
                if quote and page:
                    hits = [(at, at + len(quote), 1.0) for at in places(page, quote)]
                    if not hits:
                        near = nearest(quote, page, least, anchor)
                        hits = [near] if near else []
                    out += [(key, field, *h) for h in hits]
            yield pd.DataFrame(out, columns=["doc_id", "field", "start", "end", "score"])

    kind = quotes.schema["doc_id"].dataType.simpleString()
    return quotes.select("doc_id", "field", "quote", "page_text").mapInPandas(find, f"doc_id {kind}, field string, start int, end int, score double")
