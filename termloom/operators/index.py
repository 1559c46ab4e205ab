"""The inverted index as DataFrames: postings, terms, documents and one row of statistics."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions.analysis import AnalysisConfig, only_runs, terms_of, text_blocks
from termloom.plans.storage import cut

#: Fixed value: the largest term frequency that the reference format allows.
MAX_TF = 65_535
#: Bytes of a row group of saved postings, of which a term's are read.
SEGMENT_BLOCK = 4 << 20


def _postings(entries: DataFrame) -> DataFrame:
    return entries.select("doc_id", F.explode("entries").alias("e")).select("e.term", "doc_id", "e.tf", "e.positions")


@dataclass
class Index:
    """entries(doc_id, dl, max_tf, entries), a row a document with its terms' tf and positions;
    postings(term, doc_id, tf, positions), the same by term."""

    entries: DataFrame
    postings: DataFrame
    config: AnalysisConfig
    n_docs: int
    total_tokens: int
    ids: DataFrame | None = None  # doc_id, corpus_id
    saved_terms: DataFrame | None = None

    @cached_property
    def terms(self) -> DataFrame:
        """term, df."""
        if self.saved_terms is not None:
            return self.saved_terms
        return cut(self.postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "index-terms")

    @property
    def docs(self) -> DataFrame:
        """doc_id, dl, max_tf."""
        return self.entries.select("doc_id", "dl", "max_tf")

    @property
    def avgdl(self) -> float:
        return self.total_tokens / self.n_docs if self.n_docs else 0.0

    def stats(self) -> DataFrame:
        """num_docs, vocab_size, num_postings, total_tokens, avg_doc_length."""
        spark = self.docs.sparkSession
        counted = self.terms.agg(F.count(F.lit(1)).alias("vocab_size"), F.coalesce(F.sum("df"), F.lit(0)).alias("num_postings"))
        fixed = spark.createDataFrame([(self.n_docs, self.total_tokens, self.avgdl)], "num_docs long, total_tokens long, avg_doc_length double")
        return fixed.join(counted)

    def save(self, path: str, ids: DataFrame | None = None) -> None:
        """The documents' entries; postings in segments, each of the documents of one task and
        sorted by term, so that a term list prunes row groups and nothing is shuffled; and the map
        ``ids`` (doc_id, corpus_id), if there is one."""
        if ids is not None:
            ids.select("doc_id", F.col("corpus_id").cast("string").alias("corpus_id")).write.mode("overwrite").parquet(f"{path}/ids")
        self.entries.write.mode("overwrite").parquet(f"{path}/entries")
        self.postings.sortWithinPartitions("term", "doc_id").write.mode("overwrite").option("parquet.block.size", SEGMENT_BLOCK).parquet(f"{path}/postings")
        self.terms.write.mode("overwrite").parquet(f"{path}/terms")
        meta = json.dumps({"config": json.loads(self.config.to_json()), "n_docs": self.n_docs, "total_tokens": self.total_tokens, "ids": ids is not None})
        self.docs.sparkSession.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Index:
        meta = json.loads(spark.read.text(f"{path}/meta").first()["value"])
        read = lambda part: spark.read.parquet(f"{path}/{part}")
        index = Index(read("entries"), read("postings"), AnalysisConfig(**meta["config"]), meta["n_docs"], meta["total_tokens"], saved_terms=read("terms"))
        if index.docs.count() != index.n_docs:
            raise ValueError(f"{path} holds another number of documents than its metadata says")
        if meta.get("ids"):
            index.ids = read("ids")
            row = index.ids.agg(F.count(F.lit(1)), F.countDistinct("doc_id")).first()
            if tuple(row) != (index.n_docs, index.n_docs):
                raise ValueError(f"{path} maps another number of documents than it holds")
        return index

    def lookup(self, term: str) -> DataFrame:
        """Postings of one term."""
        return self.postings.where(F.col("term") == term)

    def debug(self) -> DataFrame:
        """Decoded postings (term, doc_id, tf, positions) in order, to be written as text or JSON."""
        return self.postings.select("term", "doc_id", "tf", "positions").orderBy("term", "doc_id")


def spread(df: DataFrame) -> DataFrame:
    """The rows over at least as many partitions as the cluster runs tasks at once: a small file
    is one partition however long its texts are. What a shuffle has dealt is left as it is."""
    plan = df._jdf.queryExecution()
    if "Exchange" in plan.executedPlan().toString():
        return df
    parallel = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(parallel) if plan.toRdd().getNumPartitions() < parallel else df


def _inverted(runs: pa.ListArray, config: AnalysisConfig) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Entries (list<term, tf, positions>), lengths and largest tf of a batch of documents' runs.

    Each different run is analysed once, and terms become numbers; one sort of (document, number,
    position) brings each document's equal terms together, so a document becomes its postings
    where it is, without a shuffle. Fails above MAX_TF."""
    lengths = pc.list_value_length(runs).to_numpy(zero_copy_only=False)
    found = runs.flatten().dictionary_encode()
    analysed = pa.array(terms_of(found.dictionary.to_pylist(), config), pa.string())
    terms = pc.unique(analysed.drop_null()).sort()
    number = pc.fill_null(pc.index_in(analysed, terms), -1).to_numpy()[found.indices.to_numpy()].astype(np.int64)
    doc = np.repeat(np.arange(len(lengths)), lengths)[number >= 0]
    number = number[number >= 0]
    dl = np.bincount(doc, minlength=len(lengths))
    at = np.arange(len(doc)) - np.repeat(np.cumsum(dl) - dl, dl)
    long = int(dl.max(initial=1)) or 1
    key = np.sort((doc * len(terms) + number) * long + at)
    key, at = np.divmod(key, long)
    cuts = np.flatnonzero(np.diff(key, prepend=-1))
    tf = np.diff(np.append(cuts, len(key))).astype(np.int32)
    of, number = np.divmod(key[cuts], max(len(terms), 1))
    if tf.max(initial=0) > MAX_TF:
        raise ValueError(f"term frequency above the limit: {terms[int(number[tf.argmax()])].as_py()}")
    most = np.zeros(len(lengths), np.int32)
    np.maximum.at(most, of, tf)
    positions = pa.ListArray.from_arrays(pa.array(np.append(cuts, len(key)), pa.int32()), pa.array(at.astype(np.int32)))
    rows = pa.StructArray.from_arrays([terms.take(pa.array(number)), pa.array(tf), positions], ["term", "tf", "positions"])
    ends = np.cumsum(np.bincount(of, minlength=len(lengths)))
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), rows), pa.array(dl, pa.int64()), pa.array(most)


def with_entries(docs: DataFrame, config: AnalysisConfig) -> DataFrame:
    """(doc_id, dl, max_tf, entries) of a table (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in text_blocks(batch, "text"):
                words = [only_runs(t or "") for t in block.column("text").to_pylist()]
                found, dl, most = _inverted(pa.array(words, pa.list_(pa.string())), config)
                yield pa.RecordBatch.from_arrays([block.column("doc_id"), dl, most, found], names=["doc_id", "dl", "max_tf", "entries"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, dl bigint, max_tf int, entries array<struct<term:string,tf:int,positions:array<int>>>")


def build_index(docs: DataFrame, config: AnalysisConfig | None = None, text: str = "text") -> Index:
    """Index a table (doc_id, text). Documents are analysed once, and their entries written to the
    shared folder; postings and lengths are read from there, and terms counted when they are
    first asked for."""
    config = config or AnalysisConfig()
    rows = cut(with_entries(spread(docs.select("doc_id", F.col(text).alias("text"))), config), "index-entries")
    row = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("t")).first()
    return Index(rows, _postings(rows), config, row["n"], row["t"])


def length_distribution(lengths: DataFrame) -> DataFrame:
    """min, p25, median, mean, p75, p95, max of document lengths (nearest rank)."""
    rank = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY dl)").cast("double")
    return lengths.agg(
        F.min("dl").alias("min_dl"), rank(0.25).alias("p25"), F.expr("percentile(dl, 0.5)").alias("median"), F.round(F.avg("dl"), 6).alias("mean"),
        rank(0.75).alias("p75"), rank(0.95).alias("p95"), F.max("dl").alias("max_dl"),
    )
