"""Sinks: partitioned tables, CSV without geometry, GeoJSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waterspark.functions import clean as C
from waterspark.functions import geometry as G


def write_water(water: DataFrame, path: str) -> None:
    """The water table, partitioned by region, plus a CSV twin without geometry."""
    water.write.mode("overwrite").partitionBy("region").parquet(f"{path}/table")
    water.drop("geometry").write.mode("overwrite").csv(f"{path}/csv", header=True)


def write_layers(layers: DataFrame, path: str) -> None:
    """Polygon layers keyed by a file-safe id, partitioned by source and threshold, so that
    pre-generated thresholds can be listed from partitions alone."""
    out = layers.withColumns({"safe_key": C.safe_id(F.col("lake_uid")), "feature": G.geojson(F.col("geometry"))})
    out.drop("geometry").write.mode("overwrite").partitionBy("source", "threshold").parquet(path)


def feature_line(geometry: Column, properties: Column) -> Column:
    return F.concat(
        F.lit('{"type":"Feature","properties":'), F.to_json(properties), F.lit(',"geometry":'), G.geojson(geometry), F.lit("}")
    )


def write_grid(grid: DataFrame, path: str) -> None:
    """Tile grid as GeoJSON lines."""
    line = feature_line(F.col("geometry"), F.struct(F.col("tile").alias("Name")))
    grid.select(line.alias("value")).write.mode("overwrite").text(path)


def write_samples(samples: DataFrame, path: str) -> None:
    samples.write.mode("overwrite").csv(path, header=True, emptyValue="")
