"""All registered queries."""

from __future__ import annotations

from . import checks, core, evaluations, ingest, inputs, live, paths, signals, streams, trees

MODULES = (core, signals, evaluations, trees, ingest, checks, streams, live, inputs, paths)


def plans() -> dict:
    return dict(core.PLANS)


def sql() -> dict:
    return dict(core.SQL)
