"""Every registered query with its oracle SQL."""

from __future__ import annotations

from concordat.plans import analytics, einvoices, gate, layout, matching, runs, three_way, validation

MODULES = (three_way, matching, validation, analytics, runs, gate, layout, einvoices)

QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE = {k: q for m in MODULES for k, q in m.ORACLE.items()}
