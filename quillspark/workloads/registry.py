"""All registered queries."""

from __future__ import annotations

from quillspark.workloads import activity, documents, evaluation, knowledge, retrieval, stored

MODULES = (retrieval, documents, activity, evaluation, knowledge, stored)


def queries() -> dict:
    return {name: fn for module in MODULES for name, fn in module.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: text for module in MODULES for name, text in module.ORACLES.items()}
