"""Identity of an article."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _as_col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def article_id(title, link) -> Column:
    """md5 hex of title followed by link; a missing part counts as empty."""
    blank = F.lit("")
    return F.md5(F.concat(F.coalesce(_as_col(title), blank),
                          F.coalesce(_as_col(link), blank)))
