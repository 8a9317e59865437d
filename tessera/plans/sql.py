"""Plain SQL over the session's catalogs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def execute_query(spark: SparkSession, query: str) -> DataFrame:
    """One statement; semicolons behind it are removed."""
    return spark.sql(query.strip().rstrip("; \n"))


def get_table_schema(spark: SparkSession, table: str) -> DataFrame:
    return spark.sql("DESCRIBE TABLE IDENTIFIER(:t)", args={"t": table})


def list_catalogs(spark: SparkSession) -> DataFrame:
    return spark.sql("SHOW CATALOGS")


def list_schemas(spark: SparkSession, catalog: str | None = None) -> DataFrame:
    return spark.sql(f"SHOW SCHEMAS IN `{catalog}`" if catalog else "SHOW SCHEMAS")


def list_tables(spark: SparkSession, schema: str | None = None) -> DataFrame:
    return spark.sql(f"SHOW TABLES IN `{schema}`" if schema else "SHOW TABLES")
