"""Registry of the queries and of their SQL twins."""

from __future__ import annotations

from pitgrid.plans import almanac, alternatives, briefs, desk, filings, landing, lineage, panel, papers, press, prices, readings, records, research, stored, track, upkeep

MODULES = (prices, filings, alternatives, panel, records, briefs, desk, upkeep, press, readings, landing, almanac, stored, lineage, papers, research, track)


def queries() -> dict:
    return {name: fn for m in MODULES for name, (fn, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
