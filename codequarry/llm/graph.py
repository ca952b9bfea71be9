"""Connected components of links between longs, by alternating large and small stars."""

from pyspark.sql import functions as F

from codequarry.llm.workspace import Table


def _large(edges):
    """Each node's larger neighbours go to its smallest neighbour (or itself)."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges):
    """Each node and its smaller neighbours go to the smallest of these.  edges: u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links):
    """(node, component): the smallest node that links (u, v) reach, for every node but the smallest of each component itself."""
    edges = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct()
    table, mark = Table(edges), None
    while True:
        new = Table(_small(_large(table.df)))
        table.drop()
        table = new
        # equal stars: the same number of edges and the same sum of their hashes
        now = table.df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            return table.df.select(F.col("u").alias("node"), F.col("v").alias("component"))
        mark = now
