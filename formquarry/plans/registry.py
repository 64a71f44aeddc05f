"""All registered queries of the core."""

from __future__ import annotations

from formquarry.plans import decoding, inventory, listings, problems

_MODULES = (problems, inventory, decoding, listings)


def queries() -> dict:
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
