"""All queries over the driver's tables, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import curating, files, grids, pictures, scoring, shapes, signals, spectra, streams, symbols, templating, texts

_MODULES = (scoring, grids, signals, spectra, streams, pictures, curating, symbols, texts, shapes, files, templating)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
for _m in _MODULES:
    for _name, _fn in _m.QUERIES.items():
        if _name in QUERIES:
            raise ValueError(f"two queries are named {_name}")
        QUERIES[_name] = _fn
    ORACLE_SQL.update(_m.ORACLE_SQL)
