"""Text predicates and label expressions (all built-in column functions)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A control character used as the LIKE escape, so that a backslash in user text is an
# ordinary character while '%' and '_' keep their wildcard meaning.
_LIKE_ESCAPE = "\u0001"
# Between packed texts, in place of a missing one, and before either of them (or itself) within a text.
_BETWEEN, _MISSING, _ESCAPE = "\u001f", "\u001e", "\u001d"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def like_contains_ci(col, term: str, already_lower: bool = False) -> Column:
    """``lower(col) LIKE '%' || lower(term) || '%'``; wildcards in ``term`` stay live."""
    pattern = F.concat(F.lit("%"), F.lower(F.lit(term)), F.lit("%"))
    subject = _col(col) if already_lower else F.lower(_col(col))
    return F.like(subject, pattern, F.lit(_LIKE_ESCAPE))


def equals_ci(col, value: str) -> Column:
    """Case-insensitive equality; the literal is folded by Spark too."""
    return F.lower(_col(col)) == F.lower(F.lit(str(value)))


def contains_ci(col, value: str) -> Column:
    """Case-insensitive substring test (no wildcards); null cells never match."""
    return F.lower(_col(col)).contains(F.lower(F.lit(str(value))))


def non_blank(col) -> Column:
    """``TRIM(COALESCE(col, '')) <> ''``."""
    return F.trim(F.coalesce(_col(col), F.lit(""))) != F.lit("")


def blank_to_null(col) -> Column:
    """Trimmed text, or null when the trimmed text is empty."""
    return F.nullif(F.trim(_col(col)), F.lit(""))


def label_or(col, default: str) -> Column:
    """Null or empty text shows as ``default`` (whitespace-only text is kept)."""
    return F.coalesce(F.nullif(_col(col), F.lit("")), F.lit(default))


def first_usable(*cols, default: str = "") -> Column:
    """First non-null, non-empty of ``cols``, else ``default``."""
    return F.coalesce(*[F.nullif(_col(c), F.lit("")) for c in cols], F.lit(default))


def choice_label(value, display) -> Column:
    """Option label: the display text, with the value in brackets unless both agree ignoring case."""
    v, d = _col(value), F.trim(_col(display))
    plain = F.when(F.lower(d) == F.lower(F.trim(v)), d).otherwise(F.concat(d, F.lit(" ("), v, F.lit(")")))
    return F.when(F.coalesce(d, F.lit("")) == F.lit(""), v).otherwise(plain)


def packed(cols) -> Column:
    """Several text columns as one text, for a shuffle of wide rows: there a row takes a word for
    each column and pads every text to eight bytes, and the words differ from row to row, so that
    the shuffle's compression finds less that repeats."""
    def safe(text):
        for k, mark in enumerate((_ESCAPE, _BETWEEN, _MISSING)):
            text = F.replace(text, F.lit(mark), F.lit(f"{_ESCAPE}{k}"))
        return text

    return F.array_join(F.transform(F.array(*[_col(c) for c in cols]), safe), _BETWEEN, _MISSING)


def unpacked(df: DataFrame, col: str, names) -> DataFrame:
    """``df`` with the text columns ``names``, in the order in which :func:`packed` took them, in place of ``col``."""
    def plain(text):
        out = text
        for k, mark in ((2, _MISSING), (1, _BETWEEN), (0, _ESCAPE)):
            out = F.replace(out, F.lit(f"{_ESCAPE}{k}"), F.lit(mark))
        return F.when(text != _MISSING, F.when(F.contains(text, F.lit(_ESCAPE)), out).otherwise(text))

    parts = f"{col}_parts"
    rows = df.withColumn(parts, F.transform(F.split(col, _BETWEEN, -1), plain))
    return rows.select(*[c for c in df.columns if c != col], *[F.get(parts, F.lit(k)).alias(n) for k, n in enumerate(names)])
