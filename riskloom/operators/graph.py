"""Entity relationships as edge and node tables, and neighbourhoods by bounded hops."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.plans.lineage import cut_lineage
from riskloom.plans.small import broadcast_if_small

# Relationship name and the column that holds the user's counterpart.
RELATIONSHIPS = {"transaction": ("merchant", "merchant_id"), "uses_device": ("device", "device_id"), "api_access": ("api_client", "api_client_id")}
END = ["entity_type", "entity_id"]


def graph_edges(events: DataFrame, start=None, end=None) -> DataFrame:
    """User-counterpart pairs with their interaction count and weight ln(1 + count)."""
    if start is not None:
        events = events.filter(F.col("ts") >= F.lit(start).cast("timestamp"))
    if end is not None:
        events = events.filter(F.col("ts") <= F.lit(end).cast("timestamp"))
    ends = F.array(
        *[
            F.struct(F.lit(rel).alias("relationship"), F.lit(kind).alias("to_type"), F.col(column).alias("to_id"))
            for rel, (kind, column) in RELATIONSHIPS.items()
        ]
    )
    return (
        events.filter(F.col("user_id").isNotNull())
        .select(F.col("user_id").alias("from_id"), F.explode(ends).alias("e"))
        .filter(F.col("e.to_id").isNotNull())
        .groupBy(F.lit("user").alias("from_type"), "from_id", "e.to_type", "e.to_id", "e.relationship")
        .agg(F.count("*").alias("interaction_count"))
        .withColumn("edge_weight", F.log1p("interaction_count"))
    )


def both_ways(edges: DataFrame) -> DataFrame:
    """Every edge from each of its ends."""
    ends = F.array(
        F.struct(
            F.col("from_type").alias("entity_type"), F.col("from_id").alias("entity_id"),
            F.col("to_type").alias("other_type"), F.col("to_id").alias("other_id"),
        ),
        F.struct(
            F.col("to_type").alias("entity_type"), F.col("to_id").alias("entity_id"),
            F.col("from_type").alias("other_type"), F.col("from_id").alias("other_id"),
        ),
    )
    return edges.select(F.explode(ends).alias("p"), "relationship", "interaction_count").select(
        "p.*", "relationship", "interaction_count"
    )


def graph_nodes(edges: DataFrame) -> DataFrame:
    """Distinct neighbours and summed interactions per entity."""
    pairs = both_ways(edges).groupBy(*END, "other_type", "other_id").agg(F.sum("interaction_count").alias("n"))
    return pairs.groupBy(*END).agg(F.count("*").alias("node_degree"), F.sum("n").alias("total_interactions"))


def neighbors(edges: DataFrame, entity_type: str, entity_id: str, relationship: str | None = None) -> DataFrame:
    mine = both_ways(edges).filter((F.col("entity_type") == entity_type) & (F.col("entity_id") == entity_id))
    if relationship:
        mine = mine.filter(F.col("relationship") == relationship)
    return mine.select(
        F.col("other_type").alias("entity_type"), F.col("other_id").alias("entity_id"), "relationship", "interaction_count"
    )


def community(edges: DataFrame, entity_type: str, entity_id: str, max_hops: int = 2) -> DataFrame:
    """Entities within `max_hops` of one entity, with their distance.

    Each hop expands only entities first reached in the hop before, so a hub is expanded once.
    """
    spark = edges.sparkSession
    links = both_ways(edges).select(*END, "other_type", "other_id").distinct().persist()
    frontier = spark.createDataFrame([(entity_type, entity_id)], "entity_type string, entity_id string")
    seen = frontier.withColumn("hops", F.lit(0))
    for hop in range(1, max_hops + 1):
        reached = (
            links.join(broadcast_if_small(frontier), END, "left_semi")
            .select(F.col("other_type").alias("entity_type"), F.col("other_id").alias("entity_id"))
            .distinct()
            .join(broadcast_if_small(seen.select(*END)), END, "left_anti")
        )
        frontier = cut_lineage(reached)
        seen = seen.unionByName(frontier.withColumn("hops", F.lit(hop)))
    return seen.filter(F.col("hops") > 0)
