"""Feature columns from tables, text and vectors; parameters as tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mixlode.functions.gaussian import Component


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_features(df: DataFrame, *columns: str | Column, name: str = "features") -> DataFrame:
    """Adds array<double> `name` from numeric columns, or from one array or vector column."""
    if len(columns) == 1 and isinstance(columns[0], str):
        kind = df.schema[columns[0]].dataType
        if isinstance(kind, T.ArrayType):
            return df.withColumn(name, F.col(columns[0]).cast("array<double>"))
        if kind.typeName() in ("udt", "vectorudt"):
            from pyspark.ml.functions import vector_to_array

            return df.withColumn(name, vector_to_array(columns[0]))
    return df.withColumn(name, F.array(*[(F.col(c) if isinstance(c, str) else c).cast("double") for c in columns]))


def read_points(spark: SparkSession, path: str, separator: str = " ") -> DataFrame:
    """Points from text files, one per line of separated numbers.

    The separator is taken as it stands; a blank one stands for any run of white space.
    Lines of white space are passed over, and a part that is no number is an error.
    """
    line = F.regexp_replace("value", r"^\s+|\s+$", "")
    parts = F.split(line, r"\s+" if not separator.strip() else f"\\Q{separator}\\E")
    numbers = F.transform(parts, lambda x: F.trim(x).cast("double"))
    return spark.read.text(path).where(F.length(line) > 0).select(numbers.alias("features"))


def local_points(spark: SparkSession, points) -> DataFrame:
    """Points from a driver-side collection."""
    rows = [(np.asarray(p, dtype=float).tolist(),) for p in points]
    return spark.createDataFrame(rows, "features array<double>")


PARAMS = "component int, weight double, s double, mu array<double>, sigma array<array<double>>"


def params_frame(spark: SparkSession, weights, components) -> DataFrame:
    rows = [(j, float(w), float(c.s), c.mu.tolist(), c.sigma.tolist()) for j, (w, c) in enumerate(zip(weights, components, strict=True))]
    return spark.createDataFrame(rows, PARAMS)


def params_from(df: DataFrame) -> tuple[list[float], list[Component]]:
    """Reads a (k-row) parameter table back."""
    rows = df.orderBy("component").collect()
    return [r["weight"] for r in rows], [Component(r["mu"], r["sigma"], r["s"]) for r in rows]
