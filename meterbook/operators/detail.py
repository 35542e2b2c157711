"""Consumption detail: projection, pricing, ordering, paging and counting."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterbook.functions.dates import lenient_date
from meterbook.operators.filters import UsageFilter, apply_filter
from meterbook.operators.pricing import drop_computed_names, grid_pricing, grid_pricing_columns
from meterbook.params import PricingParams
from meterbook.schema import COMPUTED_COLUMNS, COLUMN_GROUPS, ROW_ID, STANDARD_VIEW, UPLOAD_ID


def requested_columns(df: DataFrame, columns: Sequence[str] | None) -> list[str] | None:
    """Source columns asked for, minus computed names; ``None`` means every column.

    Names are checked against the table (no expressions are accepted)."""
    if not columns:
        return None
    computed = {c.lower() for c in COMPUTED_COLUMNS}
    wanted = [c for c in columns if c.lower() not in computed]
    unknown = [c for c in wanted if c not in df.columns]
    if unknown:
        raise ValueError(f"unknown columns: {unknown}")
    return wanted or None


def detail_order(df: DataFrame, date_column: str = "UsageDate", date_mode: str = "text") -> list[Column]:
    """Newest usage first, missing dates last, then the upload and the persisted row id (unique
    within an upload), so that pages never overlap, whether over one upload or many.

    ``date_mode="text"`` orders the date text as strings (right for ISO dates, like a VARCHAR
    column); ``"date"`` orders by the parsed date, with unreadable text last."""
    if date_mode not in ("text", "date"):
        raise ValueError("date_mode is 'text' or 'date'")
    key = F.col(date_column) if date_mode == "text" else lenient_date(date_column)
    order = [key.desc_nulls_last()]
    order += [F.col(c).asc_nulls_last() for c in (UPLOAD_ID, ROW_ID) if c in df.columns]
    return order


def priced_detail(
    df: DataFrame,
    params: PricingParams = PricingParams(),
    flt: UsageFilter | None = None,
    columns: Sequence[str] | None = None,
    on_bad_number: str = "fail",
) -> DataFrame:
    """Filtered rows with the six pricing columns; unordered (order with :func:`detail_page`)."""
    base = apply_filter(df, flt)
    wanted = requested_columns(base, columns)
    source = [F.col(c) for c in wanted] if wanted else [F.col(c) for c in drop_computed_names(base).columns]
    return base.select(*source, *grid_pricing_columns(params, on_bad_number=on_bad_number))


def detail_page(
    df: DataFrame,
    params: PricingParams = PricingParams(),
    flt: UsageFilter | None = None,
    columns: Sequence[str] | None = None,
    page: int = 1,
    page_size: int | None = 100,
    all_records: bool = False,
    on_bad_number: str = "fail",
    date_mode: str = "text",
) -> DataFrame:
    """One sorted page (``LIMIT page_size OFFSET (page-1)*page_size``).

    A page is a top-N: Spark keeps only ``offset + page_size`` rows per task before merging
    (``TakeOrderedAndProject``), so no global sort of the table happens. ``page_size`` of 0 /
    ``None`` or ``all_records`` returns every row in order, which is a range-partitioned
    sort meant to be written out, not collected. For deep paging use :func:`detail_after`.
    """
    if page < 1:
        raise ValueError("page starts at 1")
    if page_size is not None and page_size < 0:
        raise ValueError("page size is not negative")
    base = apply_filter(df, flt)
    wanted = requested_columns(base, columns)
    source = [F.col(c) for c in wanted] if wanted else [F.col(c) for c in drop_computed_names(base).columns]
    ordered = base.orderBy(*detail_order(base, date_mode=date_mode)).select(*source, *grid_pricing_columns(params, on_bad_number=on_bad_number))
    if all_records or not page_size:
        return ordered
    offset = (page - 1) * page_size
    return (ordered.offset(offset) if offset else ordered).limit(page_size)


def detail_after(
    df: DataFrame,
    last_usage_date: str | None,
    last_row_id,
    params: PricingParams = PricingParams(),
    flt: UsageFilter | None = None,
    page_size: int = 100,
    last_upload_id: int | None = None,
    columns: Sequence[str] | None = None,
    on_bad_number: str = "fail",
    date_mode: str = "text",
) -> DataFrame:
    """Keyset page: the ``page_size`` rows that follow the row with ``last_usage_date`` (its
    text), ``last_upload_id`` (needed where the table holds several uploads) and
    ``last_row_id`` in detail order. Cost does not grow with the page number, unlike an offset."""
    base = apply_filter(df, flt)
    if date_mode not in ("text", "date"):
        raise ValueError("date_mode is 'text' or 'date'")
    text = F.lit(last_usage_date).cast("string")
    day, last = (F.col("UsageDate"), text) if date_mode == "text" else (lenient_date("UsageDate"), lenient_date(text))
    later = F.col(ROW_ID) > F.lit(last_row_id)
    if UPLOAD_ID in base.columns and last_upload_id is not None:
        upload, mine = F.col(UPLOAD_ID), F.lit(int(last_upload_id))
        later = (upload > mine) | ((upload == mine) & later)
    # null days come last; a null last day leaves only them
    after = F.when(last.isNull(), day.isNull() & later).otherwise(day.isNull() | (day < last) | ((day == last) & later))
    wanted = requested_columns(base, columns)
    source = [F.col(c) for c in wanted or drop_computed_names(base).columns]
    rows = base.where(after).orderBy(*detail_order(base, date_mode=date_mode))
    return rows.select(*source, *grid_pricing_columns(params, on_bad_number=on_bad_number)).limit(page_size)


def detail_count(df: DataFrame, flt: UsageFilter | None = None) -> DataFrame:
    """Number of rows that pass the filter, as one row ``total`` (BIGINT)."""
    return apply_filter(df, flt).agg(F.count(F.lit(1)).alias("total"))


def standard_view(
    df: DataFrame,
    params: PricingParams = PricingParams(),
    flt: UsageFilter | None = None,
    hide_groups: Sequence[str] = (),
    hide_columns: Sequence[str] = (),
    on_bad_number: str = "fail",
) -> DataFrame:
    """The 22-column grid (16 source + 6 computed), optionally without some column groups."""
    hidden = set(hide_columns)
    for g in hide_groups:
        hidden.update(COLUMN_GROUPS[g])
    base = apply_filter(df, flt)
    pricing = grid_pricing(params, on_bad_number=on_bad_number)
    cols = []
    for name in STANDARD_VIEW:
        if name in hidden:
            continue
        cols.append(pricing[name] if name in pricing else F.col(name))
    return base.select(*cols)
