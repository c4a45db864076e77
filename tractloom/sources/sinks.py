"""Writers: partitioned tables, samples, JSON documents, GeoJSON features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cleaning import money
from ..functions.geo import in_map_view


def write_table(df: DataFrame, path: str, sort_by: list[str], partition_by: str = "year", fmt: str = "parquet") -> None:
    """Partitioned table, one shuffle by a range of the sort keys so that no partition value sits in one task."""
    ordered = df.repartitionByRange(F.col(partition_by), *[F.col(c) for c in sort_by]).sortWithinPartitions(partition_by, *sort_by)
    ordered.write.mode("overwrite").option("header", "true").partitionBy(partition_by).format(fmt).save(path)


def write_head(df: DataFrame, path: str, rows: int = 50) -> None:
    """A small readable sample next to a table."""
    df.limit(rows).coalesce(1).write.mode("overwrite").option("header", "true").csv(path)


def rounded_record(columns: list[str], digits: int = 4) -> Column:
    """One JSON object of the non-null values, rounded; NaN counts as missing."""
    def value(c: str) -> Column:
        v = F.col(c).cast("double")
        return F.round(F.when(~F.isnan(v), v), digits).alias(c)

    return F.to_json(F.struct(*[value(c) for c in columns]))


def keyed_records(df: DataFrame, key: str, columns: list[str], digits: int = 4) -> DataFrame:
    """(key, record) with records of no value left out."""
    return df.select(key, rounded_record(columns, digits).alias("record")).where(F.col("record") != "{}")


def write_json(df: DataFrame, path: str, gzip: bool = False) -> None:
    writer = df.write.mode("overwrite")
    (writer.option("compression", "gzip") if gzip else writer).json(path)


def point_features(df: DataFrame, properties: list[str], amount: str | None = None, digits: int = 5) -> DataFrame:
    """One GeoJSON point feature per located row, as JSON lines; text amounts are parsed as money."""
    lon, lat = F.round("lon", digits), F.round("lat", digits)
    props = [F.col(p) for p in properties]
    if amount:
        props.append(money(F.col(amount).cast("string")).alias(amount))
    feature = F.struct(
        F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates")).alias("geometry"),
        F.struct(*props).alias("properties"),
    )
    return df.where(in_map_view("lat", "lon")).select(F.to_json(feature).alias("value"))


#: Geometries stay variants: points, lines, polygons with holes, several parts and collections keep their own depth.
FEATURE_SCHEMA = "struct<type:string,geometry:variant,properties:map<string,string>>"


def parsed_features(collections: DataFrame) -> DataFrame:
    """One row per feature ``f`` (type, geometry, properties) of GeoJSON collections or single features in ``value``."""
    whole = F.from_json("value", f"struct<type:string,features:array<{FEATURE_SCHEMA}>>")
    single = F.from_json("value", FEATURE_SCHEMA)
    features = F.when(whole["type"] == "Feature", F.array(single)).otherwise(whole["features"])
    return collections.select(F.explode(features).alias("f"))


def attach_properties(collections: DataFrame, attributes: DataFrame, key: str, feature_key: str) -> DataFrame:
    """Join attributes onto the features of GeoJSON collections; features without attributes are dropped.

    ``collections`` has one GeoJSON text per row in ``value``. Geometries of any kind pass through as they are.
    """
    features = parsed_features(collections)
    joined = features.withColumn(key, F.try_element_at("f.properties", F.lit(feature_key)).try_cast(attributes.schema[key].dataType)).join(attributes, key)
    properties = F.struct(*[F.col(c) for c in attributes.columns])
    return joined.select(key, F.to_json(F.struct(F.lit("Feature").alias("type"), F.col("f.geometry").alias("geometry"), properties.alias("properties"))).alias("value"))
