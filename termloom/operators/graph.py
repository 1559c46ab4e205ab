"""Link graph: preparation and PageRank."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.plans.storage import cut


@dataclass
class PageRank:
    scores: DataFrame  # node, value
    iterations: int
    converged: bool
    residual: float


def build_graph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct (src, dst), self-links kept; an end that is no node is an error."""
    ids = nodes.select("node").distinct()
    links = edges.select("src", "dst").distinct()
    ends = links.select(F.col("src").alias("node")).unionByName(links.select(F.col("dst").alias("node"))).distinct()
    stray = ends.join(ids, "node", "left_anti").limit(1).collect()
    if stray:
        raise ValueError(f"edge end {stray[0]['node']} is no node")
    return links


def keep_known(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, int]:
    """Edges with both ends among the nodes, and how many others there were."""
    ids = nodes.select("node").distinct()
    known = edges.join(ids.withColumnRenamed("node", "src"), "src", "left_semi").join(ids.withColumnRenamed("node", "dst"), "dst", "left_semi")
    return known.select(*edges.columns), edges.count() - known.count()


def _prepared(nodes: DataFrame, links: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """Links with the degree of their source, and first ranks (node, value, hanging); both are
    written once and every step reads them."""
    degree = links.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    weighted = cut(links.join(degree, "src"), "links")
    ranks = nodes.join(degree.select(F.col("src").alias("node"), F.lit(False).alias("hanging")), "node", "left")
    return weighted, cut(ranks.select("node", F.lit(1.0 / n).alias("value"), F.coalesce("hanging", F.lit(True)).alias("hanging")), "ranks")


def pagerank_step(links: DataFrame, ranks: DataFrame, n: int, damping: float) -> DataFrame:
    """(node, value, hanging, old) after one step. ``links`` has (src, dst, degree)."""
    sent = links.join(ranks.select(F.col("node").alias("src"), "value"), "src").groupBy("dst").agg(F.sum(F.col("value") / F.col("degree")).alias("got"))
    hang = ranks.agg(F.coalesce(F.sum(F.when(F.col("hanging"), F.col("value"))), F.lit(0.0))).first()[0]
    value = F.lit((1.0 - damping) / n + damping * hang / n) + F.lit(damping) * F.coalesce("got", F.lit(0.0))
    return ranks.join(sent, ranks.node == sent.dst, "left").select("node", value.alias("value"), "hanging", F.col("value").alias("old"))


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, tolerance: float = 1e-6, max_iterations: int = 100, on_iteration=None) -> PageRank:
    """Power iteration until the change is below the tolerance; each step is written to the
    shared folder, so the plan stays small and a lost executor costs only its tasks."""
    if not 0 <= damping < 1 or tolerance <= 0 or max_iterations < 1:
        raise ValueError("damping, tolerance or max_iterations is out of range")
    nodes = nodes.select("node").distinct()
    n = nodes.count()
    if n < 1:
        raise ValueError("a graph needs a node")
    links, ranks = _prepared(nodes, build_graph(nodes, edges), n)
    residual, done = float("inf"), 0
    while done < max_iterations and residual >= tolerance:
        ranks = cut(pagerank_step(links, ranks, n, damping), "ranks")
        residual = ranks.agg(F.sum(F.abs(F.col("value") - F.col("old")))).first()[0]
        done += 1
        if on_iteration:
            on_iteration(done, residual)
    return PageRank(ranks.select("node", "value"), done, residual < tolerance, residual)


def pagerank_fixed(nodes: DataFrame, edges: DataFrame, iterations: int, damping: float = 0.85) -> DataFrame:
    """(node, value) after a fixed number of steps."""
    nodes = nodes.select("node").distinct()
    n = nodes.count()
    links, ranks = _prepared(nodes, edges.select("src", "dst").distinct(), n)
    for _ in range(iterations):
        ranks = cut(pagerank_step(links, ranks, n, damping), "ranks")
    return ranks.select("node", "value")


def map_citations(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges over corpus ids as edges over doc_ids; an end without a document is an error."""
    of = lambda c: ids.select(F.col("corpus_id").alias(c), F.col("doc_id").alias(f"{c}_doc"))
    joined = edges.join(of("src"), "src", "left").join(of("dst"), "dst", "left")
    known = lambda c: F.coalesce(F.col(f"{c}_doc"), F.raise_error(F.concat(F.lit("no document for "), F.col(c).cast("string"))).cast("long"))
    return joined.select(known("src").alias("src"), known("dst").alias("dst"))


def save_run(result: PageRank, path: str, run_id: int) -> None:
    """Append a run's scores."""
    result.scores.withColumn("run_id", F.lit(run_id)).write.mode("append").parquet(path)


def latest_run(spark, path: str) -> DataFrame:
    runs = spark.read.parquet(path)
    return runs.join(F.broadcast(runs.agg(F.max("run_id").alias("run_id"))), "run_id").select("node", "value")
