"""Row filters of the dashboard and invoice: search, equality, contains, non-blank.

All predicates are built-in column expressions, so they run inside whole-stage codegen
and Catalyst can push what is pushable (for example ``IsNotNull``) into the Parquet scan.
When a table carries the lower-cased copies made at ingest (``<col>_lc``), equality and
plain-substring tests are written against those, which Parquet can filter by statistics.
"""

from __future__ import annotations

import functools
import operator
from dataclasses import dataclass, field
from typing import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterbook.functions.text import contains_ci, equals_ci, like_contains_ci
from meterbook.schema import CONTAINS_FILTER_COLUMNS, EQUALITY_FILTER_COLUMNS, LOWER_SUFFIX, SEARCH_COLUMNS


def _present(value) -> bool:
    return value is not None and str(value) != ""


def _lowered(df: DataFrame, column: str) -> str | None:
    name = column + LOWER_SUFFIX
    return name if name in df.columns else None


@dataclass(frozen=True)
class UsageFilter:
    """A dashboard / invoice filter. Blank values are dropped, an empty filter keeps all rows.

    ``search``: case-insensitive LIKE-contains over ``search_columns`` (OR-ed); ``%`` and ``_``
    in the term act as wildcards. ``equals``: case-insensitive equality per column.
    ``contains``: case-insensitive substring per column (grid header filters).
    """

    search: str | None = None
    equals: Mapping[str, str] = field(default_factory=dict)
    contains: Mapping[str, str] = field(default_factory=dict)
    search_columns: tuple[str, ...] = SEARCH_COLUMNS

    def without(self, *columns: str) -> "UsageFilter":
        drop = set(columns)
        return UsageFilter(
            self.search,
            {k: v for k, v in self.equals.items() if k not in drop},
            {k: v for k, v in self.contains.items() if k not in drop},
            self.search_columns,
        )

    def predicates(self, df: DataFrame) -> list[Column]:
        cols = set(df.columns)
        preds: list[Column] = []
        if _present(self.search):
            term = str(self.search)
            preds.append(functools.reduce(operator.or_, [
                _search_one(df, c, term) for c in self.search_columns
            ]))
        for column, value in self.equals.items():
            if not _present(value):
                continue
            if column not in EQUALITY_FILTER_COLUMNS or column not in cols:
                raise ValueError(f"not a filterable column: {column!r}")
            lowered = _lowered(df, column)
            preds.append(F.col(lowered) == F.lower(F.lit(str(value))) if lowered else equals_ci(column, value))
        for column, value in self.contains.items():
            if not _present(value):
                continue
            if column not in CONTAINS_FILTER_COLUMNS or column not in cols:
                raise ValueError(f"not a contains-filter column: {column!r}")
            lowered = _lowered(df, column)
            preds.append(F.col(lowered).contains(F.lower(F.lit(str(value)))) if lowered else contains_ci(column, value))
        return preds

    def predicate(self, df: DataFrame) -> Column | None:
        preds = self.predicates(df)
        return functools.reduce(operator.and_, preds) if preds else None

    def apply(self, df: DataFrame) -> DataFrame:
        pred = self.predicate(df)
        return df if pred is None else df.where(pred)


def _search_one(df: DataFrame, column: str, term: str) -> Column:
    lowered = _lowered(df, column)
    return like_contains_ci(lowered, term, already_lower=True) if lowered else like_contains_ci(column, term)


def apply_filter(df: DataFrame, flt: UsageFilter | None) -> DataFrame:
    return df if flt is None else flt.apply(df)


def invoice_scope(customer: str, domain: str, invoice: str | None = None, search: str | None = None) -> UsageFilter:
    """The per-customer invoice filter: customer and domain required, invoice number optional."""
    if not _present(customer) or not _present(domain):
        raise ValueError("an invoice needs a customer and a domain")
    equals = {"CustomerName": customer, "CustomerDomainName": domain}
    if _present(invoice):
        equals["InvoiceNumber"] = invoice
    return UsageFilter(search=search, equals=equals)
