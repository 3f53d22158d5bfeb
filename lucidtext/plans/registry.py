"""Registry of queries: name -> (function of (spark, sf_dir), SQL for DuckDB or None)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Query, str | None]] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        if name in REGISTRY:
            raise ValueError(f"{name} is registered twice")
        REGISTRY[name] = (function, sql)
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Inline:
    """A small fixed table, the same in Spark and in DuckDB."""

    def __init__(self, schema: str, rows: Sequence[tuple]) -> None:
        self.schema, self.rows = schema, list(rows)

    def df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, self.schema)

    def sql(self) -> str:
        columns = [x.strip().split(" ", 1) for x in self.schema.split(",")]
        kinds = {"string": "VARCHAR", "int": "INTEGER", "long": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN", "array<string>": "VARCHAR[]", "array<int>": "INTEGER[]", "array<double>": "DOUBLE[]"}

        def lit(v: object) -> str:
            if v is None:
                return "NULL"
            if isinstance(v, str):
                return "'" + v.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
            if isinstance(v, bool):
                return str(v).lower()
            if isinstance(v, (list, tuple)):
                return "[" + ", ".join(map(lit, v)) + "]"
            return repr(v)

        body = ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in self.rows)
        names = [c for c, _ in columns]
        return f"(SELECT {', '.join(f'CAST({c} AS {kinds[k]}) AS {c}' for c, k in columns)} FROM (VALUES {body}) t({', '.join(names)}))"
