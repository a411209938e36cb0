"""Severity rank, badge and category label expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import DEFAULT_EMOJI, DEFAULT_RANK, SEVERITY_EMOJI, SEVERITY_RANK


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def severity_rank(sev="severity") -> Column:
    """critical 0, high 1, medium 2, low 3; unknown, other case or null 3."""
    s = _col(sev)
    expr = F.lit(DEFAULT_RANK)
    for name, rank in reversed(list(SEVERITY_RANK.items())):
        expr = F.when(s == F.lit(name), F.lit(rank)).otherwise(expr)
    return expr.cast("int")


def shown_severity(sev="severity") -> Column:
    """A missing severity is shown as ``low``."""
    return F.coalesce(_col(sev), F.lit("low"))


def severity_emoji(sev="severity") -> Column:
    s = shown_severity(sev)
    expr = F.lit(DEFAULT_EMOJI)
    for name, emoji in reversed(list(SEVERITY_EMOJI.items())):
        expr = F.when(s == F.lit(name), F.lit(emoji)).otherwise(expr)
    return expr


def capitalize(c) -> Column:
    """Python ``str.capitalize``: first character upper, the rest lower."""
    s = _col(c)
    return F.concat(F.upper(F.left(s, F.lit(1))), F.lower(F.substring(s, 2, 1 << 30)))


def category_label(cat="category") -> Column:
    """A missing category is shown as the empty string."""
    return capitalize(F.coalesce(_col(cat), F.lit("")))


def line_label(line="line_number") -> Column:
    """A missing line number is shown as ``?``."""
    return F.coalesce(_col(line).cast("string"), F.lit("?"))
