"""Connected components by contraction."""

from pyspark.sql import DataFrame, functions as F

from ledgerlight.llm.common import drop, written


def components(edges: DataFrame) -> DataFrame:
    """node, component for every node of ``edges`` (a, b); a component is named by one of its nodes.

    Each round ranks the nodes anew by a hash, lets every node join the lowest ranked of itself
    and its neighbours, and contracts the graph to what was joined; a path shrinks by a constant
    share a round, a star at once. The rows of a round are written, so lineage stays short.
    Neighbour minima combine before the shuffle. An empty graph has no components.
    """
    edges = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")
    edges = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
                    "edges")
    steps = []
    while not edges.isEmpty():
        seed = F.lit(len(steps))

        def rank(c):
            return F.struct(F.xxhash64(c, seed).alias("h"), F.col(c).alias("v"))

        both = edges.select(F.col("a").alias("node"), rank("a").alias("x"), rank("b").alias("y")).unionByName(
            edges.select(F.col("b").alias("node"), rank("b").alias("x"), rank("a").alias("y")))
        joined = both.groupBy("node").agg(F.min(F.least("x", "y")).alias("low")).select(
            "node", F.col("low.v").alias("to"))
        joined = written(joined, "joined")
        # ranks fall along the way, so following it twice as far merges more and cannot turn back
        further = joined.select(F.col("node").alias("to"), F.col("to").alias("next"))
        twice = written(joined.join(further, "to").select("node", F.col("next").alias("to")), "joined")
        drop(joined)
        joined = twice
        steps.append(joined)
        at_a = joined.select(F.col("node").alias("a"), F.col("to").alias("to_a"))
        at_b = joined.select(F.col("node").alias("b"), F.col("to").alias("to_b"))
        moved = edges.join(at_a, "a").join(at_b, "b").where("to_a <> to_b")
        left = written(moved.select(F.least("to_a", "to_b").alias("a"),
                                    F.greatest("to_a", "to_b").alias("b")).distinct(), "edges")
        drop(edges)
        edges = left
    if not steps:
        return written(edges.select(F.col("a").alias("node"), F.col("b").alias("component")), "components")
    found = steps[0].withColumnRenamed("to", "component")
    for step in steps[1:]:
        found = found.join(step.withColumnRenamed("node", "component"), "component", "left").select(
            "node", F.coalesce("to", "component").alias("component"))
    found = written(found, "components")
    drop(edges, *steps)
    return found
