"""Dates of feed entries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Zone names of RFC 822 by their offset.
ZONE_NAMES = {"+0000": "UT|UTC|GMT|Z", "-0400": "EDT", "-0500": "EST|CDT", "-0600": "CST|MDT",
              "-0700": "MST|PDT", "-0800": "PST"}


def _rewritten(text: Column, *rules: tuple[str, str]) -> Column:
    for pattern, replacement in rules:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def parse_feed_date(value) -> Column:
    """RFC 822 or ISO 8601 text to a timestamp, null when it is neither.

    A text without a zone is taken as UTC.  Each family is first rewritten to one form,
    so that one format reads it.
    """
    text = F.trim(F.col(value) if isinstance(value, str) else value)
    rfc = _rewritten(
        text, (r"\s+", " "), (r"^[A-Za-z]{3,9},? ?(?=\d)", ""),
        *[(rf"(?i) ({names})$", f" {offset}") for offset, names in ZONE_NAMES.items()],
        (r"( \d\d?:\d\d(:\d\d)?)$", "$1 +0000"),             # no zone
        (r"([+-]\d\d):(\d\d)$", "$1$2"),
        (r"( \d\d?:\d\d) ", "$1:00 "),                        # no seconds
        (r"^(\d\d? [A-Za-z]{3}) (\d\d) ", "$1 20$2 "))        # year of two digits
    iso = _rewritten(
        F.regexp_extract(text, r"^\d{4}-\d\d-\d\d.*$", 0),
        (r"^(\d{4}-\d\d-\d\d)$", "$1T00:00:00Z"),
        (r"([T ]\d\d:\d\d(:\d\d(\.\d+)?)?)$", "$1Z"),      # no zone
        (r"([T ]\d\d:\d\d)([zZ+-])", "$1:00$2"),              # no seconds
        (r"([+-]\d\d)(\d\d)$", "$1:$2"))
    return F.coalesce(F.try_to_timestamp(F.nullif(iso, F.lit(""))),
                      F.try_to_timestamp(rfc, F.lit("d MMM yyyy HH:mm:ss Z")))


def entry_published(published, updated, fetched_at) -> Column:
    """``published``, else ``updated``, else the time the payload was fetched.

    A text that cannot be read counts as missing.  A leap second is read but is no
    valid time of day, so it ends at the fetch time without a look at ``updated``.
    """
    published = F.col(published) if isinstance(published, str) else published
    leap = published.rlike(r"\d\d:\d\d:6[01]\b")
    return F.coalesce(
        F.when(leap, F.col(fetched_at)),
        parse_feed_date(published), parse_feed_date(updated), F.col(fetched_at))
