"""The library's queries by name, each with the SQL that it is held against."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def given(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The result of SQL over the tables that it names; the same text runs in the query it is held against."""
    named = [t for t in TABLES if re.search(rf"\b{t}\b", sql)]
    if not named:
        return spark.sql(sql)
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in named}
    text = re.sub(rf"\b({'|'.join(named)})\b", r"{\1}", re.sub(r"[{}]", r"\g<0>\g<0>", sql))
    return spark.sql(text, **frames)


def duck(sql: str) -> str:
    """Spark's SQL of an input as DuckDB writes it."""
    return re.sub(r"\bsha2\((.*), 256\)", r"sha256(\1)", re.sub(r"\barray\(", "list_value(", sql))


def query(sql: str | None = None, **inputs: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """Registers a function of input frames as a query. inputs: SQL of each; in sql, their names stand for them."""

    def register(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(**{k: given(spark, sf_dir, v) for k, v in inputs.items()})
        if sql:
            SQL[f.__name__] = "WITH RECURSIVE " + ", ".join(f"{k} AS ({duck(v)})" for k, v in inputs.items()) + (f", {sql[5:]}" if sql.startswith("WITH ") else f" {sql}")
        return f

    return register


from . import collection_queries, evidence_queries, kernel_queries, lint_queries, series_queries, source_queries, text_queries, validation_queries  # noqa: E402, F401
