"""All queries of the library by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import desk, directory, feeds, markets, media, pages, records, reports, scalars, stories, streams, technical, text
from tidemark.plans.views import half_up

PLANS = (technical, text, records, feeds, scalars, stories, media, pages, markets, directory, desk, reports, streams)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q[0] for plan in PLANS for name, q in plan.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: half_up(q[1]) for plan in PLANS for name, q in plan.QUERIES.items() if q[1]}
