"""All registered queries and their SQL checks."""

from __future__ import annotations

import importlib

from docspan.fixtures import with_fixtures

MODULES = ("notes", "versions", "diff", "drift", "access", "sources", "code", "markdown", "assembly", "streaming")


def _modules():
    return [importlib.import_module(f"docspan.plans.{m}") for m in MODULES]


def queries():
    out = {}
    for m in _modules():
        for name, fn in m.QUERIES.items():
            assert name not in out, name
            out[name] = fn
    return out


def oracle_sql():
    return {name: with_fixtures(sql) for m in _modules() for name, sql in m.ORACLES.items()}
