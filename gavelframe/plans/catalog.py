"""Named queries and the SQL that checks them."""

from __future__ import annotations

from gavelframe.plans import certification, decided, gates, panels, texts

MODULES = (certification, gates, panels, decided, texts)


def queries():
    return {name: f for m in MODULES for name, f in m.Q.items()}


def oracle_sql():
    return {name: sql for m in MODULES for name, sql in m.S.items() if sql}
