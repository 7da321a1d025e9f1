"""Rule tables: read from a JSON document, or taken from the built-in catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import rules as R
from ..session import literal_table

LAYERS = {"fixed_rules": "fixed_rule", "trend_rules": "trend", "anomaly_rules": "operational_anomaly"}
CONDITIONS = ["gt", "gte", "lt", "lte", "between"]


def _fields(schema: str) -> str:
    return ", ".join(f"{n}: {k}" for n, k in (part.strip().split(" ", 1) for part in schema.split(",")))


_LIST = f"array<struct<{_fields(R.RULE_SCHEMA)}>>"
DOCUMENT_SCHEMA = ", ".join(f"{layer} {_LIST}" for layer in LAYERS)


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """One row per rule with its layer; keys absent in the document are NULL."""
    document = spark.read.schema(DOCUMENT_SCHEMA).option("multiLine", True).json(path)
    return _by_layer(document)


def builtin_rules(spark: SparkSession) -> DataFrame:
    tables = [
        literal_table(spark, R.RULE_SCHEMA, rules).withColumn("layer", F.lit(LAYERS[name]))
        for name, rules in R.rule_documents().items()
    ]
    return tables[0].unionByName(tables[1]).unionByName(tables[2])


def _by_layer(document: DataFrame) -> DataFrame:
    parts = [document.select(F.inline(name)).withColumn("layer", F.lit(layer)) for name, layer in LAYERS.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def invalid_rules(rules: DataFrame) -> DataFrame:
    """Rules whose condition is unknown or lacks its limits; the evaluation ignores these, so check them up front."""
    needs_band = F.col("condition") == "between"
    complete = F.when(needs_band, F.col("min_value").isNotNull() & F.col("max_value").isNotNull()).otherwise(F.col("threshold").isNotNull())
    return rules.where(
        (F.col("layer") != "operational_anomaly") & ~(F.coalesce(F.col("condition").isin(CONDITIONS), F.lit(False)) & F.coalesce(complete, F.lit(False)))
    )


def forecast_rules(spark: SparkSession) -> DataFrame:
    return literal_table(spark, R.FORECAST_SCHEMA, R.forecast_documents())
