"""The search facade: what a service would call."""

from __future__ import annotations

import time
from collections import deque
from dataclasses import dataclass, field
from inspect import signature

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions.web import snippets
from termloom.operators import fuzzy, ranking
from termloom.operators.index import Index
from termloom.operators.retrieval import candidates, matches_nothing
from termloom.plans.query import QueryParseError, analyzed, leaf_terms, leaves, parse, positive_terms


class ServiceError(Exception):
    """A request that can't be served: a code and a message."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


@dataclass(frozen=True)
class Limits:
    """What a request may ask for."""

    default_k: int = 10
    most_k: int = 50
    most_page: int = 1000
    longest_query: int = 512
    longest_text: int = 20_000
    implicit: str = "or"
    strategy: str = "bm25"


@dataclass
class Corpus:
    """An index with the documents it was built from: (doc_id, corpus_id, title, url, text)."""

    index: Index
    docs: DataFrame
    pagerank: DataFrame | None = None


def open_corpus(spark: SparkSession, path: str, rows: DataFrame | None = None, source: str = "") -> Corpus:
    """A saved index with its documents; INDEX_UNAVAILABLE where it can't be read."""
    try:
        index = Index.load(spark, path)
    except Exception as e:
        raise ServiceError("INDEX_UNAVAILABLE", f"no index at {path}: {e}") from e
    ids = index.ids if index.ids is not None else index.docs.select("doc_id", F.col("doc_id").cast("string").alias("corpus_id"))
    return Corpus(index, document_store(ids, rows, source))


def document_store(ids: DataFrame, rows: DataFrame | None = None, source: str = "") -> DataFrame:
    """(doc_id, corpus_id, title, url, text, source) for an index's id map.

    ``rows`` (corpus_id and any of title, url, text) are a collection, a folder of pages or a
    crawl's documents; without them, or where one is missing, the id stands for the title and
    there is no text. A missing or empty title is the id as well."""
    found = ids.select("doc_id", "corpus_id")
    if rows is not None:
        found = found.join(rows, "corpus_id", "left")
    column = lambda c: F.col(c).cast("string") if c in found.columns else F.lit(None).cast("string")
    title = F.coalesce(F.nullif(column("title"), F.lit("")), F.col("corpus_id"))
    return found.select("doc_id", "corpus_id", title.alias("title"), column("url").alias("url"), column("text").alias("text"), F.lit(source).alias("source"))


@dataclass
class Engine:
    corpora: dict[str, Corpus]
    default: str
    limits: Limits = field(default_factory=Limits)
    latencies: deque = field(default_factory=lambda: deque(maxlen=100))

    def _corpus(self, name: str | None) -> Corpus:
        if (name or self.default) not in self.corpora:
            raise ServiceError("INVALID_CORPUS", f"no corpus {name}")
        return self.corpora[name or self.default]

    def call(self, name: str, **params) -> object:
        """A service call by name: NOT_FOUND for no such call, VALIDATION for parameters that it
        does not take or of a wrong type, INTERNAL for what fails inside."""
        if name not in ("health", "config", "search", "document", "stats", "trace"):
            raise ServiceError("NOT_FOUND", f"no call {name}")
        method = getattr(self, name)
        known = signature(method).parameters
        strict = not any(p.kind is p.VAR_KEYWORD for p in known.values())
        for key, value in params.items():
            if strict and key not in known:
                raise ServiceError("VALIDATION", f"{name} takes no {key}")
            kind = {"query": str, "corpus": str, "strategy": str, "implicit": str, "k": int, "page": int, "doc_id": int, "fuzzy_edits": int}.get(key)
            if kind and value is not None and (not isinstance(value, kind) or isinstance(value, bool)):
                raise ServiceError("VALIDATION", f"{key} must be {kind.__name__}")
        missing = [p.name for p in known.values() if p.default is p.empty and p.kind is p.POSITIONAL_OR_KEYWORD and p.name not in params]
        if missing:
            raise ServiceError("VALIDATION", f"{name} needs {missing[0]}")
        try:
            return method(**params)
        except ServiceError:
            raise
        except Exception as e:
            raise ServiceError("INTERNAL", "the call failed") from e

    def health(self) -> dict:
        return {"status": "ok", "corpora": sorted(self.corpora), "default": self.default}

    def config(self) -> dict:
        return {"limits": vars(self.limits), "strategies": [*ranking.STATIC, "bm25-pr"], "fuzzy": vars(fuzzy.FuzzyOptions())}

    def _tree(self, query: str, implicit: str, corpus: Corpus):
        text = query.strip()
        if not text or len(text) > self.limits.longest_query:
            raise ServiceError("INVALID_QUERY", "the query is empty or too long")
        try:
            return analyzed(parse(text, implicit), corpus.index.config)
        except QueryParseError as e:
            raise ServiceError("QUERY_PARSE", str(e)) from e

    def search(self, query: str, corpus: str | None = None, strategy: str | None = None, k: int | None = None, page: int = 1, implicit: str | None = None, fuzzy_edits: int = 0, **params) -> tuple[DataFrame, dict]:
        """One page of results (rank, doc_id, corpus_id, title, url, score, parts, snippet) and its metadata."""
        began, lim = time.perf_counter(), self.limits
        c, k = self._corpus(corpus), k or lim.default_k
        if not 1 <= k <= lim.most_k or not 1 <= page <= lim.most_page or implicit not in (None, "and", "or"):
            raise ServiceError("INVALID_PARAMS", "k, page or implicit is out of range")
        try:
            chosen = ranking.Strategy(strategy or lim.strategy, **params)
        except (ValueError, TypeError) as e:
            raise ServiceError("INVALID_STRATEGY", str(e)) from e
        if chosen.name == "bm25-pr" and c.pagerank is None:
            raise ServiceError("STRATEGY_UNAVAILABLE", "this corpus has no link scores")
        tree = self._tree(query, implicit or lim.implicit, c)
        expanded = None
        if fuzzy_edits:
            try:
                expanded = fuzzy.expand(c.index, tree, fuzzy.FuzzyOptions(max_edits=fuzzy_edits))
            except ValueError as e:
                raise ServiceError("INVALID_FUZZY", str(e)) from e
            tree = expanded.tree
        scored = ranking.rank(c.index, tree, chosen, c.pagerank)
        total = candidates(c.index, tree).count()
        hits = ranking.top_k(scored, k, page)
        rows = hits.join(c.docs.select("doc_id", "corpus_id", "title", "url", "text"), "doc_id", "left")
        rows = rows.withColumn("title", F.coalesce(F.nullif("title", F.lit("")), F.col("corpus_id")))
        rows = rows.withColumn("snippet", snippets(F.col("text"), positive_terms(tree), c.index.config)).drop("text")
        rows = rows.orderBy(F.desc("score"), F.asc("doc_id"))
        took = (time.perf_counter() - began) * 1000
        self.latencies.append(took)
        meta = {"total": total, "page": page, "pages": ranking.total_pages(total, k), "strategy": chosen.engine_id, "terms": positive_terms(tree), "ms": took, "universe": matches_nothing(tree)}
        if expanded:
            meta["fuzzy"] = {"expansions": expanded.expansions, **expanded.counts}
        return rows, meta

    def document(self, doc_id: int, query: str | None = None, corpus: str | None = None) -> dict:
        """A document with the query's terms and phrases that it holds."""
        c = self._corpus(corpus)
        row = c.docs.where(F.col("doc_id") == doc_id).first()
        if row is None:
            raise ServiceError("DOC_NOT_FOUND", f"no document {doc_id}")
        out = {"doc_id": doc_id, "corpus_id": row["corpus_id"], "title": row["title"] or row["corpus_id"], "url": row["url"], "text": (row["text"] or "")[: self.limits.longest_text]}
        if c.pagerank is not None:
            rank = c.pagerank.where(F.col("doc_id") == doc_id).first()
            out["pagerank"] = round(rank["value"], 9) if rank else 0.0
        if query:
            tree = self._tree(query, self.limits.implicit, c)
            terms = leaf_terms(tree)
            mine = c.index.postings.where(F.col("term").isin(terms) & (F.col("doc_id") == doc_id)).join(c.index.terms, "term").collect()
            out["matched_terms"] = {r["term"]: {"tf": r["tf"], "df": r["df"]} for r in mine}
            at = {r["term"]: r["positions"] for r in mine}
            phrases = [leaf.words for leaf in leaves(tree, True) if leaf.kind == "phrase" and leaf.words]
            out["matched_phrases"] = [" ".join(p) for p in phrases if all(w in at for w in p) and any(all(s + i in at[w] for i, w in enumerate(p)) for s in at[p[0]])]
        return out

    def stats(self, corpus: str | None = None) -> dict:
        c = self._corpus(corpus)
        recent = sorted(self.latencies)
        at = lambda q: recent[min(len(recent), max(1, -(-len(recent) * q // 100))) - 1] if recent else None
        return c.index.stats().first().asDict() | {
            "strategies": {s: True for s in ranking.STATIC} | {"bm25-pr": c.pagerank is not None},
            "latency": {"count": len(recent), "avg": sum(recent) / len(recent) if recent else None, "p95": at(95)},
        }

    def trace(self, query: str, corpus: str | None = None, implicit: str | None = None) -> dict:
        """How a query is understood: terms with df, number of candidates, the best ten."""
        times, start = {}, time.perf_counter()

        def stage(name: str) -> None:
            nonlocal start
            times[name], start = (time.perf_counter() - start) * 1000, time.perf_counter()

        c = self._corpus(corpus)
        tree = self._tree(query, implicit or self.limits.implicit, c)
        stage("parse")
        df = {r["term"]: r["df"] for r in c.index.terms.where(F.col("term").isin(leaf_terms(tree))).collect()}
        postings = {r["term"]: r["n"] for r in c.index.postings.where(F.col("term").isin(leaf_terms(tree))).groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()}
        stage("lookup")
        met = candidates(c.index, tree).count()
        stage("candidates")
        best = ranking.top_k(ranking.rank(c.index, tree), 10).collect()
        stage("rank")
        return {"stages_ms": times, "postings": postings, "terms": {t: df.get(t, 0) for t in leaf_terms(tree)}, "candidates": met, "top": [(r["doc_id"], r["score"]) for r in best]}


__all__ = ["Corpus", "Engine", "Limits", "ServiceError", "document_store", "open_corpus"]
