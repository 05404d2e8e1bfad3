"""Queries by name: operators applied to the driver's tables and to tables derived from them."""

from __future__ import annotations


def registries() -> list:
    from spanloom.plans import annotation, repairs, workflows

    return [annotation.R, repairs.R, workflows.R]
