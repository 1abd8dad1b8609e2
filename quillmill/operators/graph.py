"""Graph tools over vertices (id, name, attributes) and edges (src, dst, attributes) (survey section K)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def both_ways(edges: DataFrame) -> DataFrame:
    """Undirected edges in both directions."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *(c for c in edges.columns if c not in ("src", "dst")))
    return edges.unionByName(back)


def neighbours(edges: DataFrame, vertices: DataFrame, names: DataFrame) -> DataFrame:
    """(name, neighbour) for the names asked for (K2); an unknown name has no row."""
    asked = names.join(vertices.select(F.col("id").alias("src"), "name"), "name")
    found = both_ways(edges).join(asked, "src").select("name", F.col("dst").alias("id"))
    return found.join(vertices.select("id", F.col("name").alias("neighbour")), "id").select("name", "neighbour").distinct()


def node(vertices: DataFrame, name: str) -> DataFrame:
    """The attributes of a vertex (K3); the filter reaches the scan."""
    return vertices.where(F.col("name") == name)


def edge(edges: DataFrame, vertices: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, items): the items of the edge between two named vertices, titled; null if there is none.

    ``edges`` holds an array ``items`` of ids whose titles are vertices' names.
    """
    v = vertices.select("id", "name")
    asked = pairs.join(v.select(F.col("id").alias("src"), F.col("name").alias("a")), "a", "left").join(v.select(F.col("id").alias("dst"), F.col("name").alias("b")), "b", "left")
    found = asked.join(both_ways(edges), ["src", "dst"], "left")
    titled = found.select("a", "b", F.posexplode_outer("items").alias("pos", "id")).join(v, "id", "left")
    lists = titled.groupBy("a", "b").agg(F.sort_array(F.collect_list(F.when(F.col("name").isNotNull(), F.struct("pos", "name")))).alias("l"))
    return lists.select("a", "b", F.when(F.size("l") > 0, F.array_join(F.transform("l", lambda x: x["name"]), ", ")).alias("items"))


def usable_vertices(edges: DataFrame, vertices: DataFrame, complete: str) -> DataFrame:
    """(id, degree): vertices with complete attributes and a neighbour (K5)."""
    degree = both_ways(edges).groupBy(F.col("src").alias("id")).agg(F.countDistinct("dst").alias("degree"))
    return vertices.where(complete).join(degree, "id").select("id", "degree")
