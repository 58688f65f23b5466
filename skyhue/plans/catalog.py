"""Imports every module of queries, so that the registry is complete."""

import importlib
import pkgutil

from skyhue import plans
from skyhue.plans.registry import COVERS, QUERIES, SQL

_SUPPORT = {"catalog", "registry", "roles", "shared_sql", "output"}
for _m in sorted(m.name for m in pkgutil.iter_modules(plans.__path__)):
    if _m not in _SUPPORT:
        importlib.import_module(f"skyhue.plans.{_m}")

__all__ = ["COVERS", "QUERIES", "SQL"]
