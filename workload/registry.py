"""All registered queries and their SQL."""

from __future__ import annotations

from workload import basics, deaths, exposures, models, results

MODULES = (basics, deaths, exposures, models, results)

QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: text for module in MODULES for name, text in module.ORACLES.items()}
