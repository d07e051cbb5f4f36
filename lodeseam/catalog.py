"""Every registered query of the library, with its DuckDB counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import answers, bindings, captures, contexts, corpus, graphs, isolated, maps, nested, parsing, publishing, places, retrieval, snapshots

Query = Callable[[SparkSession, str], DataFrame]

#: Modules that each offer QUERIES (name -> callable) and ORACLES (name -> SQL).
_MODULES = (retrieval, corpus, graphs, places, contexts, snapshots, maps, captures, answers, parsing, isolated, nested, publishing, bindings)


def queries() -> dict[str, Query]:
    return {name: q for module in _MODULES for name, q in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark passage."""
    return retrieval.bm25_or_topk(spark, sf_dir)
