"""All registered queries with the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexforum.plans import corpora, hearings, indicators, relational, studies, testimony, texts

_MODULES = (relational, texts, studies, indicators, testimony, hearings, corpora)
_names = [name for m in _MODULES for name in m.QUERIES]
if len(_names) != len(set(_names)):
    raise ValueError(f"registered twice: {sorted(n for n in set(_names) if _names.count(n) > 1)}")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLES: dict[str, str] = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
FLAGSHIP = "flagship"
