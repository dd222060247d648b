"""Filters that every reader takes: look-back days, project, blocked domains, kinds, limits, sort keys."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions.scalars import ALL_KINDS, BUCKET_FORMATS, domain_of

CALL_TYPES = ("skill", "subagent", "tool", "cli", "make_target", "uv_script", "bun_script", "rule")


def since(days: int | None, ts: Column, now: datetime | None = None) -> Column:
    """Rows of the last ``days`` days before ``now``; no filter for None, zero or negative days."""
    if not days or days < 0:
        return F.lit(True)
    end = F.lit(now) if now else F.current_timestamp()
    return ts.cast("timestamp") >= end - F.expr(f"INTERVAL {int(days)} DAYS")


def of_project(project: str | None, column: Column) -> Column:
    return F.lit(True) if project is None else column == F.lit(project)


def not_blocked(domains: list[str], project_id: Column) -> Column:
    return F.lit(True) if not domains else ~F.coalesce(domain_of(project_id).isin(list(domains)), F.lit(False))


def require_allowed(project: str, domains: list[str]) -> None:
    """LookupError if a project lies in a blocked domain."""
    parts = project.strip("-").split("-")
    if len(parts) > 2 and parts[0] in ("Users", "home") and parts[2] in domains:
        raise LookupError(f"project {project!r} is blocked")


def of_kind(kind: str | None, column: Column) -> Column:
    """One message kind; an unknown kind is no filter."""
    return column == kind if kind in ALL_KINDS else F.lit(True)


def check_call_type(call_type: str) -> str:
    if call_type not in CALL_TYPES:
        raise ValueError(f"unknown call type {call_type!r}")
    return call_type


def clamp_limit(limit: int, most: int = 500) -> int:
    return max(1, min(limit, most))


def cutoff_bucket(grain: str, days: int, now: datetime) -> Column:
    """The bucket that the start of the look-back falls in; buckets from it on are whole."""
    start = F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {int(days)} DAYS")
    return F.date_format(F.date_trunc(grain, start), BUCKET_FORMATS[grain])


def filtered(events: DataFrame, *, days: int | None = None, project: str | None = None, blocked: list[str] | None = None, now: datetime | None = None) -> DataFrame:
    return events.where(since(days, F.col("ts"), now) & of_project(project, F.col("project_id")) & not_blocked(blocked or [], F.col("project_id")))


def sort_columns(key: str, order: str, keys: dict[str, str], tie: list[str]) -> list[Column]:
    """Sort columns for an allowed key and direction, else the first key descending; ties by ``tie``."""
    name = keys.get(key, next(iter(keys.values())))
    main = F.col(name).asc_nulls_last() if order == "asc" else F.col(name).desc_nulls_last()
    return [main, *tie]
