"""Registered queries over the given tables, each with its SQL where SQL can say it."""

from . import (feed_checks, model_checks, scan_checks, search_checks, stats_checks, text_checks)

_MODULES = (scan_checks, stats_checks, search_checks, feed_checks, text_checks, model_checks)


def all_queries() -> dict:
    out = {}
    for module in _MODULES:
        out.update(module.QUERIES)
    return out


def all_oracles() -> dict:
    out = {}
    for module in _MODULES:
        out.update(module.ORACLES)
    return out
