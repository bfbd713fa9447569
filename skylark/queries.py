"""All registered queries and their SQL."""

from __future__ import annotations

from skylark.plans import cases, context, engines, feeds, flags, graphs, kernels, leads, ledger, names, network, notices, paging, relational, relations, streams, style, surveyed, texts, windows  # noqa: F401  each registers its queries
from skylark.plans.registry import QUERIES, SQL

FLAGSHIP = "g10_decay_report"


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
