"""All queries over the driver's tables and the SQL that checks them."""

from __future__ import annotations

from wavelattice.plans import registry


def queries():
    return registry.queries()


def oracle_sql():
    return registry.oracle_sql()
