"""Chart tables (M12, M13, A14, F13, J7): the node and edge tables behind an
arc diagram of a route's O-D flows. Rendering is left to the caller."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapflow.functions import linear_scale
from tapflow.model import EDGE_OPACITY_RANGE, EDGE_WIDTH_RANGE, ROUTE_KEY


def nodes(routes: DataFrame, name: str = "stop", index: str = "seq", order: str = "km") -> DataFrame:
    """One node per stop occurrence: name, index, order and group 1."""
    return routes.select(*ROUTE_KEY, F.col(name).alias("name"), F.col(index).alias("index"),
                         F.col(order).alias("order"), F.lit(1).alias("group"))


def edges(trips_df: DataFrame, source: str = "source_seq", target: str = "destination_seq",
          value: str = "pax") -> DataFrame:
    """M13 + F13: one edge per O-D row (source, target as bigint, value as
    double) with its stroke opacity and width scaled linearly over the
    route's edge values (domain widened to include zero)."""
    g = Window.partitionBy(*ROUTE_KEY)
    v = F.col("value")
    vmin, vmax = F.min(v).over(g), F.max(v).over(g)
    return (trips_df.select(*ROUTE_KEY, F.col(source).cast("bigint").alias("source"),
                            F.col(target).cast("bigint").alias("target"),
                            F.col(value).cast("double").alias("value"))
            .withColumn("opacity", linear_scale(v, vmin, vmax, *EDGE_OPACITY_RANGE))
            .withColumn("width", linear_scale(v, vmin, vmax, *EDGE_WIDTH_RANGE)))


def node_degree(nodes_df: DataFrame, edges_df: DataFrame) -> DataFrame:
    """Edges leaving plus edges entering each node, 0 by default."""
    out_deg = edges_df.groupBy(*ROUTE_KEY, F.col("source").alias("index")).agg(F.count(F.lit(1)).alias("_o"))
    in_deg = edges_df.groupBy(*ROUTE_KEY, F.col("target").alias("index")).agg(F.count(F.lit(1)).alias("_i"))
    return (nodes_df.join(out_deg, [*ROUTE_KEY, "index"], "left")
            .join(in_deg, [*ROUTE_KEY, "index"], "left")
            .withColumn("degree", F.coalesce("_o", F.lit(0)) + F.coalesce("_i", F.lit(0)))
            .drop("_o", "_i"))


def served_node_degree(routes: DataFrame, trips_df: DataFrame) -> DataFrame:
    """M12 + A14 of the routes that have O-D rows: nodes with their degree.
    Both ends of an O-D row are counted in one pass, and the degrees of a
    route travel as one map, so the O-D rows are referenced once."""
    degree = (trips_df.select(*ROUTE_KEY, F.explode(F.array("source_seq", "destination_seq")).alias("index"))
              .groupBy(*ROUTE_KEY, "index").agg(F.count(F.lit(1)).alias("d"))
              .groupBy(*ROUTE_KEY).agg(F.map_from_entries(F.collect_list(F.struct("index", "d"))).alias("_m")))
    return (nodes(routes).join(degree, list(ROUTE_KEY))
            .withColumn("degree", F.coalesce(F.try_element_at("_m", F.col("index")), F.lit(0).cast("bigint"))).drop("_m"))
