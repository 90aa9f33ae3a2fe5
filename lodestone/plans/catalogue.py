"""All named queries of the library proper; importing this module registers them."""

from __future__ import annotations

from . import QUERIES, SQL, Query, admission, analytics, answers, bundles, clusters, evidence, growth, intake, knowledge, planning, relational, resolution, stores, texts, validation, views  # noqa: F401  (they register their queries)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
