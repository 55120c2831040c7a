"""Collects the registered keys of every plan module."""

from __future__ import annotations

import importlib

MODULES = ["corpus", "posts", "labels", "scores", "temporal", "streams", "catalog", "subwords"]


def _mods():
    return [importlib.import_module(f"corpuslens.plans.{m}") for m in MODULES]


def all_queries():
    out = {}
    for m in _mods():
        out.update(m.QUERIES)
    return out


def all_oracle_sql():
    out = {}
    for m in _mods():
        out.update(m.ORACLE)
    return out


def flagship(spark, sf):
    from corpuslens.plans.labels import flagship_label_share
    return flagship_label_share(spark, sf)
