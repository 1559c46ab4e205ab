"""Graph runs, exports and small writers."""

import json

import pytest

from termloom.operators import graph
from termloom.sources import files


def test_known_edges_and_citations(spark):
    nodes = spark.createDataFrame([(i,) for i in range(3)], "node long")
    edges = spark.createDataFrame([(0, 1), (1, 9), (8, 2), (2, 2)], "src long, dst long")
    known, others = graph.keep_known(nodes, edges)
    assert sorted(map(tuple, known.collect())) == [(0, 1), (2, 2)] and others == 2
    ids = spark.createDataFrame([(0, "a"), (1, "b")], "doc_id long, corpus_id string")
    cited = spark.createDataFrame([("a", "b")], "src string, dst string")
    assert [tuple(r) for r in graph.map_citations(cited, ids).collect()] == [(0, 1)]
    with pytest.raises(Exception, match="no document for z"):
        graph.map_citations(spark.createDataFrame([("a", "z")], "src string, dst string"), ids).collect()


def test_runs_are_kept_and_the_latest_read(spark, tmp_path):
    nodes, path = spark.range(2).withColumnRenamed("id", "node"), str(tmp_path / "runs")
    for run, edges in ((1, [(0, 1)]), (2, [(1, 0)])):
        graph.save_run(graph.pagerank(nodes, spark.createDataFrame(edges, "src long, dst long"), tolerance=1e-9), path, run)
    got = {r["node"]: r["value"] for r in graph.latest_run(spark, path).collect()}
    assert got == pytest.approx({0: 1.85 / 2.85, 1: 1 / 2.85}, abs=1e-4)


def test_links_coverage_and_experiments(spark, tmp_path):
    links = spark.createDataFrame([("b", "x", 0), ("a", "y", 1), ("a", "z", 0)], "from_url string, to_url string, position int")
    files.write_links(links, str(tmp_path / "links"))
    assert [(r["from_url"], r["to_url"]) for r in spark.read.json(str(tmp_path / "links")).orderBy("from_url", "position").collect()] == [("a", "z"), ("a", "y"), ("b", "x")]
    corpus, queries = spark.createDataFrame([("d1",)], "corpus_id string"), spark.createDataFrame([("q1",)], "query_id string")
    judged = spark.createDataFrame([("q1", "d1")], "query_id string, corpus_id string")
    files.check_coverage(judged, corpus, queries)
    with pytest.raises(ValueError, match="q2"):
        files.check_coverage(judged.union(spark.createDataFrame([("q2", "d1")], judged.schema)), corpus, queries)
    files.write_experiment(spark, str(tmp_path / "run"), {"metrics": {"map": 0.5}, "strategy": {"id": "bm25"}})
    (row,) = files.artifacts_of(spark, str(tmp_path / "run")).collect()
    assert row["map"] == 0.5 and row["strategy"] == "bm25"
    assert json.loads(spark.read.text(str(tmp_path / "run")).first()["value"])["strategy"] == {"id": "bm25"}


def test_synthetic_corpus(spark):
    rows = files.synthetic_corpus(spark, 40, seed=3).collect()
    assert len(rows) == 40 and all(50 <= len(r["text"].split()) <= 600 for r in rows)
    assert rows == files.synthetic_corpus(spark, 40, seed=3).collect() != files.synthetic_corpus(spark, 40, seed=4).collect()
