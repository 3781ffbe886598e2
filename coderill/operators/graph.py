"""The call graph and bounded reachability in it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coderill.session import cut_lineage


def typed_edges(symbols: DataFrame, members: DataFrame, bases: DataFrame, imports: DataFrame, exports: DataFrame, calls: DataFrame) -> DataFrame:
    """Edges of all six kinds: repo_id, edge_kind, src, dst.

    DEFINES file to symbol, CONTAINS class to method, INHERITS class to base, IMPORTS file to module, EXPORTS file to name, CALLS
    function to function."""
    file, name = F.concat(F.lit("file:"), F.col("file_id")), lambda c: F.concat(F.lit("sym:"), F.col(c))
    parts = [
        (symbols, "DEFINES", file, name("symbol_name")), (members, "CONTAINS", name("class_name"), name("symbol_name")), (bases, "INHERITS", name("class_name"), name("base_name")),
        (imports, "IMPORTS", file, F.concat(F.lit("mod:"), "source_module")), (exports, "EXPORTS", file, name("exported_name")), (calls.filter("caller is not null"), "CALLS", name("caller"), name("callee")),
    ]
    edges = [df.select("repo_id", F.lit(kind).alias("edge_kind"), src.alias("src"), dst.alias("dst")) for df, kind, src, dst in parts]
    out = edges[0]
    for e in edges[1:]:
        out = out.unionByName(e)
    return out.distinct()


def relationship_edges(symbols: DataFrame, imports: DataFrame, calls: DataFrame) -> DataFrame:
    """Edges of three kinds: DEFINES file to symbol, IMPORTS file to module, CALLS function to function; no INHERITS, CONTAINS or EXPORTS."""
    defines = symbols.select("repo_id", F.lit("DEFINES").alias("edge_kind"), F.concat(F.lit("file:"), F.col("file_id")).alias("src"), F.concat(F.lit("sym:"), "symbol_name").alias("dst"))
    brings = imports.select("repo_id", F.lit("IMPORTS").alias("edge_kind"), F.concat(F.lit("file:"), F.col("file_id")).alias("src"), F.concat(F.lit("mod:"), "source_module").alias("dst"))
    runs = calls.filter("caller is not null").select("repo_id", F.lit("CALLS").alias("edge_kind"), F.concat(F.lit("sym:"), "caller").alias("src"), F.concat(F.lit("sym:"), "callee").alias("dst"))
    return defines.unionByName(brings).unionByName(runs).distinct()


def shortest_hops(edges: DataFrame, sources: DataFrame, most: int = 8) -> DataFrame:
    """Least number of hops from each source to what it reaches, up to ``most``: repo_id, source, node, hops.

    Breadth-first by joins of the frontier with the edges; nodes that were seen are taken out, and every few steps the lineage
    is cut by a checkpoint.  Cycles end by themselves."""
    step = edges.select("repo_id", F.col("src").alias("node"), F.col("dst").alias("_to")).distinct()
    seen = frontier = sources.select("repo_id", F.col("source"), F.col("source").alias("node")).distinct().withColumn("hops", F.lit(0))
    for hops in range(1, most + 1):
        reached = frontier.join(step, ["repo_id", "node"]).select("repo_id", "source", F.col("_to").alias("node")).distinct()
        frontier = cut_lineage(reached.join(seen, ["repo_id", "source", "node"], "left_anti").withColumn("hops", F.lit(hops)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.filter("hops > 0")


def shortest_chains(edges: DataFrame, asked: DataFrame, most: int = 8) -> DataFrame:
    """The shortest chain from each source to its target, up to ``most`` hops: repo_id, source, target, hops, chain (the nodes from source
    to target); of equally short chains the least in the order of its nodes.  A pair without a chain gives no row, a source that
    is its own target a chain of one node.

    Breadth-first as in :func:`shortest_hops`; each node keeps one chain per source, and sources that have met all of their targets
    go no further.  A chain of least length has least chains as its beginnings, so one a node is enough."""
    step = edges.select("repo_id", F.col("src").alias("node"), F.col("dst").alias("_to")).distinct()
    pairs = asked.select("repo_id", "source", "target").distinct()
    seen = frontier = pairs.select("repo_id", "source", F.col("source").alias("node"), F.array("source").alias("chain")).distinct()
    for hops in range(1, most + 1):
        met = seen.select("repo_id", "source", F.col("node").alias("target"))
        open_sources = pairs.join(met, ["repo_id", "source", "target"], "left_anti").select("repo_id", "source").distinct()
        moved = frontier.join(open_sources, ["repo_id", "source"], "left_semi").join(step, ["repo_id", "node"])
        reached = moved.groupBy("repo_id", "source", F.col("_to").alias("node")).agg(F.min(F.concat("chain", F.array("_to"))).alias("chain"))
        frontier = cut_lineage(reached.join(seen, ["repo_id", "source", "node"], "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return pairs.join(seen.withColumnRenamed("node", "target"), ["repo_id", "source", "target"]).select("repo_id", "source", "target", (F.size("chain") - 1).alias("hops"), "chain")
