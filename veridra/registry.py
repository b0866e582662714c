"""Every query of the library outside the text operators, with its oracle."""

from __future__ import annotations

from veridra.plans import base
from veridra.plans import q_audit, q_joins, q_metrics, q_models, q_select, q_tables, q_text  # noqa: F401  they register their queries


def queries() -> dict[str, base.Query]:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.SQL)
