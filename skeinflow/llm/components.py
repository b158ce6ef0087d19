"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014), all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skeinflow.llm.staging import remove, stage_path

#: Edges from which nodes with very many of them are joined by broadcast: those with more than a thousandth of all edges,
#: 1,000 nodes at most.
HOT_FROM, SHARE = 1_000_000, 1000


def _star(edges: DataFrame, total: int) -> DataFrame:
    """edges (u, v) with u's least neighbour m, itself included."""
    if total < HOT_FROM:  # a task may hold all of a node's edges
        return edges.withColumn("m", F.least("u", F.min("v").over(Window.partitionBy("u"))))
    limit = total // SHARE
    # only a minimum is kept for a node
    low = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    hot = F.broadcast(low.filter(F.col("n") > limit).select(F.col("u").alias("hot"), F.col("m").alias("hot_m")))
    marked = edges.join(hot, F.col("u") == F.col("hot"), "left")
    cold = marked.filter("hot IS NULL").select("u", "v").join(low.filter(F.col("n") <= limit).select("u", "m"), "u")
    return cold.select("u", "v", "m").unionByName(marked.filter("hot IS NOT NULL").select("u", "v", F.col("hot_m").alias("m")))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``edges`` (a, b: long); the component is its least node.

    Each step replaces edges by edges to the least known neighbour, so their number never grows. Of many edges a hot
    centre's rows stay where they are and get its minimum by broadcast, the others meet by shuffle. Steps are written to
    the shared folder, the one before is removed, and two sums tell when nothing changes. A step that changes an edge
    puts a lesser node in its place and none puts a greater one, so the rounds come to an end; their number grows with
    the square of the nodes' logarithm at most (the method's paper proves it). Self-loops and repeated edges are
    harmless; no edges give no rows.
    """
    spark = edges.sparkSession
    written: list[str] = []

    def step(df: DataFrame) -> DataFrame:
        path = stage_path(spark, "edges")
        df.write.parquet(path)
        if written:
            remove(spark, written.pop())
        written.append(path)
        return spark.read.schema("v long, u long").parquet(path)

    now = step(edges.select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).distinct())
    total, seen = 2 * now.count(), None
    while True:
        # large star: larger neighbours move to the least neighbour; loops stay
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, total).filter("v > u OR v = u").select(F.col("v").alias("u"), F.when(F.col("v") > F.col("u"), F.col("m")).otherwise(F.col("v")).alias("v"))
        now = step(large.select("v", "u").distinct())
        # small star: smaller neighbours and the node itself move to the least of them
        pairs = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))
        small = _star(now.select("u", "v"), total).select(F.inline(pairs))
        now = step(small.select("v", "u").distinct())
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    return now.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
