"""Whole query sets under any strategy in one plan, with the queries that can't be parsed recorded.

The set is stated, so its trees are small and live on the driver. Its terms meet the postings in
one join; what a query finds in a document is gathered in a row, at most one entry a term of the
query, and an Arrow function holds the query's tree against the row and scores it.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.operators import fuzzy, ranking
from termloom.operators.index import Index
from termloom.operators.retrieval import matches_nothing
from termloom.plans.query import Node, QueryParseError, analyzed, leaf_terms, leaves, parse, positive_terms
from termloom.plans.storage import cut

Found = dict[str, tuple[int, list[int]]]  # term: tf, positions


@dataclass
class BatchRun:
    """rows (query_id, doc_id, score, rank), queries that failed, and what was expanded."""

    rows: DataFrame
    failures: list[tuple[object, str, int]] = field(default_factory=list)
    expansions: dict[object, list[tuple[str, list[str], int]]] = field(default_factory=dict)


def phrase_found(words: tuple[str, ...], found: Found) -> bool:
    """Whether the words stand in a row."""
    if not words or any(w not in found for w in words):
        return False
    later = [set(found[w][1]) for w in words]
    return any(all(p + i in at for i, at in enumerate(later)) for p in found[words[0]][1])


def holds(node: Node, found: Found) -> bool:
    """Whether a document with these terms satisfies an analysed tree."""
    if node.kind == "not":
        return not holds(node.children[0], found)
    if node.children:
        return (all if node.kind == "and" else any)(holds(c, found) for c in node.children)
    return phrase_found(node.words, found) if node.kind == "phrase" else any(w in found for w in node.words)


def smallest_window(places: list[list[int]]) -> int:
    """Length of the smallest stretch with a place of every list."""
    events = sorted((p, i) for i, ps in enumerate(places) for p in ps)
    last: dict[int, int] = {}
    best = math.inf
    for p, i in events:
        last[i] = p
        if len(last) == len(places):
            best = min(best, p - min(last.values()) + 1)
    return int(best)


@dataclass(frozen=True)
class Scorer:
    """A strategy over an index's statistics; ``df`` has the set's terms."""

    strategy: ranking.Strategy
    n: int
    avgdl: float
    df: dict[str, int]

    def score(self, tree: Node, found: Found, dl: int, max_tf: int) -> float:
        s = self.strategy
        terms = [t for t in positive_terms(tree) if t in self.df]
        met = [(t, found[t][0]) for t in terms if t in found]
        if s.name == "boolean":
            return 0.0
        if s.name == "tfidf":
            weigh = {"raw": float, "log": lambda tf: 1.0 + math.log(tf), "augmented": lambda tf: 0.5 + 0.5 * tf / max(max_tf, tf)}[s.tf]
            return sum(math.log(self.n / self.df[t]) * weigh(tf) for t, tf in met)
        norm = s.k1 * (1.0 - s.b + s.b * (dl / self.avgdl if self.avgdl > 0 else 0.0))
        total = sum(math.log(1.0 + (self.n - self.df[t] + 0.5) / (self.df[t] + 0.5)) * tf * (s.k1 + 1.0) / (tf + norm) for t, tf in met)
        if s.name in ("bm25-phrase", "bm25-phrase-proximity"):
            total += s.phrase_bonus * sum(phrase_found(leaf.words, found) for leaf in leaves(tree, True) if leaf.kind == "phrase")
        if s.name == "bm25-phrase-proximity" and len(met) == len(positive_terms(tree)) > 1:
            total += s.proximity_k / (1.0 + smallest_window([found[t][1] for t, _ in met]) - len(met))
        return total


def parsed_set(index: Index, queries: Iterable[tuple[object, str]], implicit: str) -> tuple[dict[object, Node], list[tuple[object, str, int]]]:
    """Analysed trees by query, and (query, code, position) of those that can't be parsed."""
    trees, failures = {}, []
    for query_id, text in queries:
        try:
            trees[query_id] = analyzed(parse(text, implicit), index.config)
        except QueryParseError as e:
            failures.append((query_id, e.code, e.position))
    return trees, failures


def run_queries(
    index: Index,
    queries: Iterable[tuple[object, str]],
    strategy: ranking.Strategy | None = None,
    k: int = 1000,
    implicit: str = "or",
    pagerank: DataFrame | None = None,
    typos: fuzzy.FuzzyOptions | None = None,
) -> BatchRun:
    """The k best documents of every query of a set; ids are all whole numbers or all strings."""
    strategy = strategy or ranking.Strategy()
    spark = index.postings.sparkSession
    trees, failures = parsed_set(index, queries, implicit)
    expansions = {}
    if typos:
        results = dict(zip(trees, fuzzy.expand_all(index, list(trees.values()), typos), strict=True))
        trees = {q: r.tree for q, r in results.items()}
        expansions = {q: r.expansions for q, r in results.items() if r.expansions}
    kind = "long" if all(isinstance(q, int) for q in trees) else "string"
    wanted = [(q, t) for q, tree in trees.items() for t in leaf_terms(tree)]
    terms = sorted({t for _, t in wanted})
    df = {r["term"]: r["df"] for r in index.terms.where(F.col("term").isin(terms)).collect()} if terms else {}
    # bm25-pr fuses normalised bm25 scores afterwards
    fused = strategy.name == "bm25-pr"
    if fused and pagerank is None:
        raise ValueError("bm25-pr needs a table (doc_id, value)")
    scorer = Scorer(ranking.Strategy("bm25", strategy.k1, strategy.b) if fused else strategy, index.n_docs, index.avgdl, df)
    doc_kind = index.docs.schema["doc_id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, scores = [], []
            columns = (batch.column(c).to_pylist() for c in ("query_id", "dl", "max_tf", "found"))
            for i, (query_id, dl, max_tf, found) in enumerate(zip(*columns, strict=True)):
                terms_here = {f["term"]: (f["tf"], f["positions"]) for f in found}
                if holds(trees[query_id], terms_here):
                    keep.append(i)
                    scores.append(scorer.score(trees[query_id], terms_here, dl, max_tf))
            rows = batch.select(["query_id", "doc_id"]).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(scores, pa.float64())], names=["query_id", "doc_id", "score"])

    table = spark.createDataFrame(wanted, f"query_id {kind}, term string")
    met = index.postings.where(F.col("term").isin(terms)).join(table, "term")
    entry = F.struct("term", "tf", "positions")
    rows = met.groupBy("query_id", "doc_id").agg(F.collect_list(entry).alias("found"))
    # queries that hold for documents with none of their terms need every document
    everywhere = [q for q, tree in trees.items() if matches_nothing(tree)]
    if everywhere:
        every = index.docs.select("doc_id", F.explode(F.array(*map(F.lit, everywhere)).cast(f"array<{kind}>")).alias("query_id"))
        rows = every.join(rows, ["query_id", "doc_id"], "full").withColumn("found", F.coalesce("found", F.array().cast(rows.schema["found"].dataType)))
    rows = rows.join(index.docs, "doc_id").select("query_id", "doc_id", "dl", "max_tf", "found")
    scored = rows.mapInArrow(score, f"query_id {kind}, doc_id {doc_kind}, score double")
    if fused:
        text = ranking.normalize_scores(cut(scored, "scores"), "score", strategy.guard, ["query_id"])
        authority = ranking.normalize_scores(pagerank.select("doc_id", "value"), "value", strategy.guard).select("doc_id", F.col("norm").alias("authority"))
        joined = text.join(authority, "doc_id", "left")
        total = F.lit(1.0 - strategy.pr_weight) * F.col("norm") + F.lit(float(strategy.pr_weight)) * F.coalesce("authority", F.lit(0.0))
        scored = joined.select("query_id", "doc_id", total.alias("score"))
    return BatchRun(ranking.ranked(scored, k), failures, expansions)


def compare_strategies(index: Index, queries: list[tuple[object, str]], strategies: list[ranking.Strategy], k: int = 1000, **options) -> DataFrame:
    """(strategy, query_id, doc_id, score, rank) of a query set under several strategies."""
    runs = [run_queries(index, queries, s, k, **options).rows.withColumn("strategy", F.lit(s.engine_id)) for s in strategies]
    return reduce(DataFrame.unionByName, runs)
