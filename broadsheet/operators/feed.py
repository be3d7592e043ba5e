"""Windowing and deduplication of feed rows."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, time, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import TimestampNTZType

from broadsheet.site import ITEMS_PER_PAGE, TIME_ZONE


_LARGEST = {"integer": 2**31 - 1, "long": 2**63 - 1}


class EmptyWindow(ValueError):
    """No reference lies in the window."""


def cutoff(now: datetime, days: int, tz: str = TIME_ZONE) -> datetime:
    """Local midnight ``days`` before today, as an instant; ``now`` without zone is UTC."""
    if days < 1:
        raise ValueError("days must be at least 1")
    zone = ZoneInfo(tz)
    aware = now if now.tzinfo else now.replace(tzinfo=timezone.utc)
    start = aware.astimezone(zone).date() - timedelta(days=days)
    return datetime.combine(start, time(), tzinfo=zone)


def instant(df: DataFrame, column: str, value: datetime) -> Column:
    """Literal comparable with ``column`` as stored, so that the scan can use the filter."""
    utc = value.astimezone(timezone.utc)
    if isinstance(df.schema[column].dataType, TimestampNTZType):
        return F.lit(utc.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")
    return F.lit(utc)


def last_n_days(
    df: DataFrame,
    days: int,
    now: datetime,
    tz: str = TIME_ZONE,
    published: str = "published",
) -> DataFrame:
    """Rows published since the local midnight ``days`` ago."""
    return df.filter(F.col(published) >= instant(df, published, cutoff(now, days, tz)))


def take_while_recent(
    df: DataFrame,
    order: Sequence[str],
    since: datetime,
    published: str = "published",
) -> DataFrame:
    """Rows before the first one, in ``order``, that is older than ``since``.

    The first old row is one minimum per task and comes back as a scalar. Its leading part
    is compared on its own where it is a whole number, so that the scan can skip files and
    row groups behind it.
    """
    old = df.filter(F.col(published) < instant(df, published, since))
    stop = old.agg(F.min(F.struct(*order)).alias("stop")).scalar()
    kept = df.filter(F.coalesce(F.struct(*order) < stop, F.lit(True)))
    largest = _LARGEST.get(df.schema[order[0]].dataType.typeName())
    if largest is None:
        return kept
    lead = old.agg(F.coalesce(F.min(order[0]), F.lit(largest)).alias("lead")).scalar()
    return kept.filter(F.col(order[0]) <= lead)


def take_while_in_ranges(
    df: DataFrame,
    order: Sequence[str],
    since: datetime,
    published: str = "published",
    page: str = "page_no",
    first: int = 64,
) -> DataFrame:
    """``take_while_recent`` on a long feed: pages are read in growing ranges up to the first stop.

    ``order`` begins with ``page``, a whole number from 0 on by which ``df``'s files can be skipped: a
    partition column or one with statistics. What is read follows the place of the stop and not the
    size of the feed. Each range sends one place or nothing to the driver.
    """
    if order[0] != page:
        raise ValueError("the order has to begin with the page")
    size, low = max(first, 1), 0
    is_old = F.col(published) < instant(df, published, since)
    place = F.min(F.when(is_old, F.struct(*order))).alias("stop")
    while True:
        high = low + size
        found = df.filter((F.col(page) >= low) & (F.col(page) < high)).agg(place, F.count("*").alias("n")).first()
        if found["stop"] is not None:
            named = zip(order, found["stop"])
            stop = F.struct(*[F.lit(value).cast(df.schema[name].dataType).alias(name) for name, value in named])
            return df.filter((F.col(page) <= found["stop"][0]) & (F.struct(*order) < stop))
        # Only a range without a row may be the feed's end, or a gap in its pages.
        if not found["n"] and df.filter(F.col(page) >= high).isEmpty():
            return df
        low, size = high, 4 * size


def page_horizon(
    pages: DataFrame,
    per_page: int = ITEMS_PER_PAGE,
    page_no: str = "page",
    total: str = "totalItems",
    n_items: Column | None = None,
) -> DataFrame:
    """Pages up to the last one asked for: before an empty page, or when all are seen."""
    n = F.coalesce(F.size("member") if n_items is None else n_items, F.lit(0))
    seen_all = F.col(page_no) * per_page >= F.coalesce(F.col(total), F.lit(0))
    last = F.when(n <= 0, F.col(page_no) - 1).when(seen_all, F.col(page_no))
    stop = pages.agg(F.min(last).alias("last")).scalar()
    return pages.filter(stop.isNull() | (F.col(page_no) <= stop))


def first_wins(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """First row per key in ``order``; copies of a key are reduced before the shuffle."""
    rest = [c for c in df.columns if c != key]
    kept = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    fields = [F.col(f"_row.{c}").alias(c) if c != key else F.col(c) for c in df.columns]
    return df.groupBy(key).agg(kept).select(*fields)


def require_rows(df: DataFrame, message: str) -> DataFrame:
    """``df`` itself; fails at the edge of the job when it is empty."""
    if df.isEmpty():
        raise EmptyWindow(message)
    return df
