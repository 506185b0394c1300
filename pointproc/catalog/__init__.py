"""All registered queries and their SQL."""

from __future__ import annotations


def _load():
    from pointproc.catalog import base, graphs, rates, statistics  # noqa: F401

    return base


def queries():
    return dict(_load().QUERIES)


def oracles():
    return dict(_load().ORACLES)
