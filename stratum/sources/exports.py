"""Tables out: CSV rows, cells and regions as GeoJSON, findings as Turtle, packed cell columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratum.operators import spatial


def feature(cell: Column, properties: list[str]) -> Column:
    """A GeoJSON feature of a cell's hexagon with the given columns as properties."""
    ring = F.regexp_replace(F.regexp_extract(spatial.boundary_wkt(cell), r"\(\((.*)\)\)", 1), r"(-?[\d.]+) (-?[\d.]+)", r"[$1,$2]")
    props = F.to_json(F.struct(*properties), {"ignoreNullFields": "false"})
    return F.concat(F.lit('{"type":"Feature","geometry":{"type":"Polygon","coordinates":[['), F.regexp_replace(ring, ", ", ","), F.lit(']]},"properties":'), props, F.lit("}"))


def cells_geojson(cells: DataFrame, cell: str, properties: list[str]) -> DataFrame:
    """(value): one feature a line, to be written as text; features are independent of each other."""
    return cells.select(feature(F.col(cell), properties).alias("value"))


def turtle(patterns: DataFrame, prefix: str = "http://example.org/insight/") -> DataFrame:
    """(value): triples of findings (id, label) and their cells' geometry, a block a line."""
    label = F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace("label", r"\\", r"\\\\"), '"', '\\\\"'), F.lit('"'))
    return patterns.select(F.concat(F.lit(f"<{prefix}"), F.col("id"), F.lit("> a geo:Feature ; rdfs:label "), label, F.lit(" ; geo:hasGeometry [ geo:asWKT \""), spatial.boundary_wkt(F.col("cell")), F.lit('"^^geo:wktLiteral ] .')).alias("value"))


def rows_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    df.select("row_id", *columns).write.mode("errorifexists").option("header", True).csv(path)


def packed(cells: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row a key with an array for each column, cells in id order; keys are map tiles of bounded size."""
    return cells.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("cell", *columns))).alias("a")).select(key, F.col("a")["cell"].alias("cell"), *[F.col("a")[c].alias(c) for c in columns])
