"""Collects the registered queries of every catalog module."""

from __future__ import annotations

import importlib

CATALOG_MODULES = [
    "regionscore.plans.catalog",
    "regionscore.plans.catalog_profile",
    "regionscore.plans.catalog_model",
    "regionscore.plans.catalog_text",
    "regionscore.plans.catalog_rank",
    "regionscore.plans.catalog_stream",
    "regionscore.plans.catalog_spec",
    "regionscore.plans.catalog_views",
    "regionscore.plans.catalog_files",
]


def _load():
    for m in CATALOG_MODULES:
        importlib.import_module(m)
    from regionscore.plans import catalog
    return catalog


def all_queries():
    return _load().QUERIES


def all_oracles():
    return _load().ORACLE
