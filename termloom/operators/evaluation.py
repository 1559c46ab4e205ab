"""Retrieval quality over whole query sets: one plan for all queries."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from termloom.functions.analysis import text_blocks

DEFAULT_KS = (1, 5, 10, 100)


#: Words of a set of items that a worker holds at once; larger sets take several readings.
SET_WORDS = 1_000_000
_WORD = re.compile(r"[^\W_]+")


def _words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


@dataclass(frozen=True)
class _Runs:
    """The runs of some items: a number for each word, and the items of each run of numbers."""

    vocabulary: pa.Array
    items: dict[tuple[int, ...], list[object]]
    hashes: np.ndarray


_STEP = np.uint64(0x9E3779B97F4A7C15)


def _hashed(numbers: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` numbers in a row."""
    n = max(len(numbers) - size + 1, 0)
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out = out * _STEP + numbers[i : i + n].astype(np.uint64)
    return out


def _runs(items: list[tuple[object, list[str]]], size: int) -> _Runs:
    number: dict[str, int] = {}
    runs: dict[tuple[int, ...], list[object]] = {}
    for key, words in items:
        coded = [number.setdefault(w, len(number)) for w in words]
        for run in {tuple(coded[i : i + size]) for i in range(max(len(coded) - size, 0) + 1)}:
            runs.setdefault(run, []).append(key)
    full = np.array([r for r in runs if len(r) == size], np.int64).reshape(-1)
    return _Runs(pa.array(list(number), pa.string()), runs, np.unique(_hashed(full, size)[::size]) if len(full) else np.empty(0, np.uint64))


def _meetings(texts: list[str | None], known: _Runs, size: int) -> list[tuple[int, object]]:
    """(place, item) for every text that shares a run with an item."""
    words = [_words(t) for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    number = pc.fill_null(pc.index_in(pa.array([w for ws in words for w in ws], pa.string()), known.vocabulary), -1).to_numpy().astype(np.int64)
    begins = np.cumsum(sizes) - sizes
    found: set[tuple[int, object]] = set()
    # a text of fewer words is one run
    for i in np.flatnonzero((sizes > 0) & (sizes < size)):
        found.update((int(i), key) for key in known.items.get(tuple(number[begins[i] : begins[i] + sizes[i]].tolist()), ()))
    if len(number) >= size and len(known.hashes):
        unknown = np.concatenate(([0], np.cumsum(number < 0)))
        at = np.flatnonzero(unknown[size:] == unknown[:-size])
        at = at[np.isin(_hashed(number, size)[at], known.hashes)]
        of = np.searchsorted(begins + sizes, at, side="right")
        for i, doc in zip(at[at + size <= (begins + sizes)[of]].tolist(), of[at + size <= (begins + sizes)[of]].tolist(), strict=True):
            found.update((doc, key) for key in known.items.get(tuple(number[i : i + size].tolist()), ()))
    return list(found)


def sharing(docs: DataFrame, items: DataFrame, size: int) -> DataFrame:
    """(query_id, doc_id) of every text of ``docs`` (doc_id, text) that shares a run of ``size``
    words, or all of fewer, with one of the stated ``items`` (query_id, text). Texts are compared
    where they are; hashes choose places, and words decide."""
    sets, block, held = [], [], 0
    for r in items.select("query_id", "text").toLocalIterator():
        if words := _words(r["text"]):
            block.append((r["query_id"], words))
            held += len(words)
        if held > SET_WORDS:
            sets, block, held = [*sets, _runs(block, size)], [], 0
    sets += [_runs(block, size)] if block or not sets else []
    query_field, doc_field = items.schema["query_id"], docs.schema["doc_id"]
    schema = f"query_id {query_field.dataType.simpleString()}, doc_id {doc_field.dataType.simpleString()}"
    kind = to_arrow_schema(StructType([query_field])).field(0).type

    def met(known: _Runs) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in text_blocks(batch, "text"):
                    pairs = _meetings(part.column("text").to_pylist(), known, size)
                    places = pa.array([i for i, _ in pairs], pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array([k for _, k in pairs], kind), part.column("doc_id").take(places)], names=["query_id", "doc_id"])

        return docs.select("doc_id", "text").mapInArrow(run, schema)

    return reduce(DataFrame.unionByName, map(met, sets)).distinct()


def judged(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """Run rows (query_id, doc_id, rank) of judged queries with their grade, 0 if not judged."""
    queries = qrels.select("query_id").distinct()
    marks = qrels.where("grade > 0").select("query_id", "doc_id", "grade")
    return run.join(queries, "query_id", "left_semi").join(marks, ["query_id", "doc_id"], "left").withColumn("grade", F.coalesce("grade", F.lit(0.0)))


def per_query(run: DataFrame, qrels: DataFrame, ks: tuple[int, ...] = DEFAULT_KS) -> DataFrame:
    """One row per judged query: p_k, r_k, f1_k, ndcg_k for each k, and ap."""
    if any(k < 1 for k in ks):
        raise ValueError("k must be at least 1")
    rows = judged(run, qrels)
    hit = (F.col("grade") > 0).cast("int")
    in_order = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("cum", F.sum(hit).over(in_order))
    gain = lambda g, rank: (F.pow(F.lit(2.0), g) - 1.0) / F.log2(rank + 1.0)
    found = [F.sum(F.when(F.col("grade") > 0, F.col("cum") / F.col("rank"))).alias("ap_sum")]
    for k in ks:
        inside = F.col("rank") <= k
        found += [F.sum(F.when(inside, hit)).alias(f"h_{k}"), F.sum(F.when(inside & (F.col("grade") > 0), gain(F.col("grade"), F.col("rank")))).alias(f"dcg_{k}")]
    got = rows.groupBy("query_id").agg(*found)
    best = qrels.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), "doc_id")))
    ideal = [F.sum(F.when((F.col("place") <= k) & (F.col("grade") > 0), gain(F.col("grade"), F.col("place")))).alias(f"idcg_{k}") for k in ks]
    base = best.groupBy("query_id").agg(F.sum(F.when(F.col("grade") > 0, 1).otherwise(0)).alias("n_rel"), *ideal)
    out = base.join(got, "query_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    columns: list[Column] = [F.col("query_id")]
    for k in ks:
        p = zero(F.col(f"h_{k}") / F.lit(float(k)))
        r = zero(F.when(F.col("n_rel") > 0, F.col(f"h_{k}") / F.col("n_rel")))
        f1 = F.when(p + r > 0, F.lit(2.0) * p * r / (p + r)).otherwise(F.lit(0.0))
        ndcg = zero(F.when(F.col(f"idcg_{k}") > 0, F.col(f"dcg_{k}") / F.col(f"idcg_{k}")))
        columns += [p.alias(f"p_{k}"), r.alias(f"r_{k}"), f1.alias(f"f1_{k}"), ndcg.alias(f"ndcg_{k}")]
    columns.append(zero(F.when(F.col("n_rel") > 0, F.col("ap_sum") / F.col("n_rel"))).alias("ap"))
    return out.select(*columns)


def summary(run: DataFrame, qrels: DataFrame, ks: tuple[int, ...] = DEFAULT_KS) -> DataFrame:
    """One row of unweighted means over the judged queries; map is the mean of ap."""
    rows = per_query(run, qrels, ks)
    names = [c for c in rows.columns if c not in ("query_id", "ap")]
    return rows.agg(F.count(F.lit(1)).alias("queries"), F.avg("ap").alias("map"), *[F.avg(c).alias(c) for c in names])


def latency_stats(times: DataFrame, column: str = "ms") -> DataFrame:
    """count, avg, median, p95, p99, min, max; percentiles by nearest rank."""
    rank = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {column})")
    c = F.col(column)
    return times.agg(
        F.count(c).alias("count"), F.avg(c).alias("avg"), F.expr(f"percentile({column}, 0.5)").alias("median"),
        rank(0.95).alias("p95"), rank(0.99).alias("p99"), F.min(c).alias("min"), F.max(c).alias("max"),
    )


def query_templates(terms: DataFrame, singles: int = 20, pairs: int = 10) -> list[tuple[str, str]]:
    """(kind, query) from the most frequent terms: single words, AND, OR, phrases and AND NOT."""
    need = max(singles, 2 * pairs)
    top = [r["term"] for r in terms.orderBy(F.desc("df"), "term").limit(need).collect()]
    couples = list(zip(top[::2], top[1::2], strict=False))[:pairs]
    out = [("single", t) for t in top[:singles]]
    for kind, form in (("and", "{} AND {}"), ("or", "{} OR {}"), ("phrase", '"{} {}"'), ("not", "{} AND NOT {}")):
        out += [(kind, form.format(*c)) for c in couples]
    return out


def corrupt(text: str, known: set[str], term_of, alphabet: str = "abcdefghijklmnopqrstuvwxyz") -> str | None:
    """One typo that makes a known word of four letters or more unknown: the first word that
    allows it, positions from the last, letters from a; None if no word does."""
    for word in text.split():
        if len(word) < 4 or not word.isalpha() or term_of(word) not in known:
            continue
        for i in range(len(word) - 1, -1, -1):
            for c in alphabet:
                typo = word[:i] + c + word[i + 1 :]
                if c != word[i].lower() and term_of(typo) not in known and term_of(typo):
                    return text.replace(word, typo, 1)
    return None
