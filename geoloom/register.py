"""SQL names: st_* functions over WKB columns, and point functions that Catalyst inlines."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import codec
from .functions import ragged

_NAMES = {f"st_{name}": name for name in ragged.OPERATORS}


def _as_text(b: ragged.Batch) -> list:
    return [codec.to_wkt(b.geometry(i)) for i in range(b.n)]


def register(spark: SparkSession) -> None:
    for name, operator in _NAMES.items():
        returns, f = ragged.OPERATORS[operator]
        spark.udf.register(name, ragged.function(f, returns))
    spark.udf.register("st_as_text", ragged.function(_as_text, "string"))

    def from_text(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else codec.to_wkb(codec.from_wkt(v)))

    @F.arrow_udf("double")
    def distance(a: pa.Array, b: pa.Array) -> pa.Array:
        return ragged.distances(a, b)

    spark.udf.register("st_geom_from_text", F.pandas_udf(from_text, "binary"))
    spark.udf.register("st_distance", distance)
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION st_point_distance(x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE) RETURNS DOUBLE RETURN sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))")
