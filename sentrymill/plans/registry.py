"""Named queries over the driver's tables, each with the SQL that a second engine runs."""

from __future__ import annotations

from . import behaviour, decisions, evaluation, extras, features, inventory, sources

MODULES = (sources, features, behaviour, decisions, evaluation, extras, inventory)


def flagship(spark, sf_dir):
    return decisions.flagship(spark, sf_dir)


def queries():
    return {k: f for m in MODULES for k, f in m.queries().items()}


def oracle_sql():
    return {k: q for m in MODULES for k, q in m.oracle_sql().items()}
