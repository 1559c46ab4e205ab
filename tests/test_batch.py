"""Query sets against the same queries one by one."""

import pytest

from termloom.functions.analysis import AnalysisConfig
from termloom.operators import batch, fuzzy, ranking
from termloom.operators.index import build_index
from termloom.plans.query import analyzed, parse

PLAIN = AnalysisConfig("none", "none")
TEXTS = ["harbor storm anchor", "storm lantern storm", "lantern", "anchor anchor harbor storm storm rope", "", "rope lantern harbor", "anchor harbor storm"]
QUERIES = [
    (1, "storm"), (2, "harbor storm"), (3, '"harbor storm" rope'), (4, "anchor AND NOT rope"), (5, "NOT storm"), (6, "(lantern OR rope) AND harbor"),
    (7, "nowhere"), (8, '"storm storm"'), (9, "NOT nowhere AND rope"), (20, "(storm"), (21, 'a "b'), (22, "OR"),
]
STRATEGIES = [ranking.Strategy(n) for n in ("boolean", "bm25", "bm25-phrase", "bm25-phrase-proximity")] + [ranking.Strategy("tfidf", tf=tf) for tf in ("raw", "log", "augmented")]


@pytest.fixture(scope="module")
def index(spark):
    return build_index(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string"), PLAIN)


def rows_of(run):
    return {(r["query_id"], r["doc_id"]): r["score"] for r in run.rows.collect()}


def one_by_one(index, strategy, pr=None, queries=QUERIES[:9], widen=None):
    out = {}
    for q, text in queries:
        tree = analyzed(parse(text, "or"), PLAIN)
        tree = widen(tree) if widen else tree
        out |= {(q, r["doc_id"]): r["score"] for r in ranking.rank(index, tree, strategy, pr).collect()}
    return out


@pytest.mark.parametrize("strategy", STRATEGIES, ids=lambda s: s.engine_id)
def test_set_equals_single_queries(index, strategy):
    run = batch.run_queries(index, QUERIES, strategy)
    assert rows_of(run) == pytest.approx(one_by_one(index, strategy), abs=1e-6)
    assert run.failures == [(20, "UNBALANCED_PAREN", 0), (21, "UNBALANCED_QUOTE", 2), (22, "MISSING_OPERAND", 0)]


def test_fused_set(spark, index):
    pr = spark.createDataFrame([(i, 0.1 * (i + 1)) for i in range(7)], "doc_id long, value double")
    strategy = ranking.Strategy("bm25-pr", pr_weight=0.4)
    queries = QUERIES[:3]
    assert rows_of(batch.run_queries(index, queries, strategy, pagerank=pr)) == pytest.approx(one_by_one(index, strategy, pr, queries), abs=1e-6)
    with pytest.raises(ValueError):
        batch.run_queries(index, queries, strategy)


def test_set_with_typos_and_ranks(index):
    queries = [("x", "strom lantrn"), ("y", "harbr"), ("z", "storm")]
    typos = fuzzy.FuzzyOptions(max_edits=2)
    run = batch.run_queries(index, queries, k=2, typos=typos)
    assert set(run.expansions) == {"x", "y"} and run.expansions["y"] == [("harbr", ["harbor"], 1)]
    want = one_by_one(index, ranking.Strategy(), queries=queries, widen=lambda t: fuzzy.expand(index, t, typos).tree)
    got = run.rows.collect()
    assert all(r["score"] == pytest.approx(want[r["query_id"], r["doc_id"]], abs=1e-6) and r["rank"] <= 2 for r in got)
    for q, _ in queries:
        best = sorted(((-round(v, 6), d) for (p, d), v in want.items() if p == q))[:2]
        assert [r["doc_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == [d for _, d in best]


def test_compared_strategies(index):
    got = batch.compare_strategies(index, QUERIES[:2], STRATEGIES[1:3], 3)
    assert {r["strategy"] for r in got.collect()} == {s.engine_id for s in STRATEGIES[1:3]} and got.where("rank > 3").count() == 0


def test_empty_set(index):
    run = batch.run_queries(index, [(1, "(")])
    assert run.rows.count() == 0 and len(run.failures) == 1


def _set(spark):
    rows = [(q, t) for q, text in QUERIES[:2] + [(7, "nowhere"), (13, "rope lantern"), (14, "anchor storm harbor")] for t in text.split()]
    return spark.createDataFrame(rows, "query_id int, term string")


@pytest.mark.parametrize("scores", [ranking.bm25_batch, ranking.tfidf_batch], ids=["bm25", "tfidf"])
def test_set_is_scored_without_a_shuffle(spark, index, scores, monkeypatch):
    queries = _set(spark)
    name = "bm25" if scores is ranking.bm25_batch else "tfidf"
    texts = [(1, "storm"), (2, "harbor storm"), (13, "rope lantern"), (14, "anchor storm harbor")]
    want = one_by_one(index, ranking.Strategy(name), queries=texts)
    full = scores(index, queries)
    assert "Exchange" not in full._jdf.queryExecution().executedPlan().toString()
    got = {(r["query_id"], r["doc_id"]): r["score"] for r in full.collect()}
    assert got == {k: round(v, 6) for k, v in want.items()}
    monkeypatch.setattr(ranking, "SET_PAIRS", 2)  # several readings
    assert {(r["query_id"], r["doc_id"]): r["score"] for r in scores(index, queries).collect()} == got
    for k in (1, 2):
        best = {(r["query_id"], r["doc_id"]): r["rank"] for r in ranking.ranked(scores(index, queries, best=k), k).collect()}
        for q in {q for q, _ in got}:
            order = sorted((-v, d) for (p, d), v in got.items() if p == q)[:k]
            assert {d: r for (p, d), r in best.items() if p == q} == {d: i + 1 for i, (_, d) in enumerate(order)}
    assert scores(index, queries.where("query_id = 7")).count() == 0


def test_rounding_is_that_of_sql(spark):
    import numpy as np

    values = [0.0000005, 1.0000005, 2.1234565, 0.1234565, 1.00000049999, 123.4567895, 7.0, 0.3333333333, -0.0000015, 4.9999995]
    rows = spark.createDataFrame([(v,) for v in values], "v double").selectExpr("round(v, 6)").collect()
    assert ranking.half_up(np.array(values)).tolist() == [r[0] for r in rows]


def test_texts_that_share_runs_with_items(spark, monkeypatch):
    import random

    from termloom.operators import evaluation

    rng = random.Random(5)
    text = lambda n: ", ".join(rng.choice(["aa", "Bb", "cc", "dd"]) if rng.random() < 0.5 else rng.choice(["Aa", "bb", "cc!"]) for _ in range(n))
    docs = [(i, text(rng.randrange(0, 40))) for i in range(60)] + [(60, None), (61, "aa bb"), (62, "zz")]
    items = [(i, text(n)) for i, n in enumerate((12, 5, 9, 0, 2))] + [(5, "AA bb"), (6, None)]
    size = 4

    def runs(t):
        w = evaluation._words(t)
        return {tuple(w[i : i + size]) for i in range(max(len(w) - size, 0) + 1)} if w else set()

    want = {(q, d) for q, a in items for d, b in docs if runs(a) & runs(b)}
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "query_id int, text string")
    found = evaluation.sharing(*frames, size)
    assert len(want) > 20 and (5, 61) in want and {tuple(r) for r in found.collect()} == want
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(evaluation, "SET_WORDS", 6)
    assert {tuple(r) for r in evaluation.sharing(*frames, size).collect()} == want


@pytest.mark.parametrize("guard", [1.0, 0.95, 0.5, 0.001])
def test_quantiles_of_groups_by_ranges(spark, guard, monkeypatch):
    import math
    import random

    monkeypatch.setattr(ranking, "STEPS", 4)
    monkeypatch.setattr(ranking, "FEW", 3)
    rng = random.Random(3)
    values = {1: [rng.random() ** 9 * 1e6 for _ in range(300)], 2: [2.0] * 50, 3: [1.0, 1.0, 5.0, 5.0, 5.0, 7.0], 4: [-3.0], 5: [0.0] * 40 + [1e9, float("inf")], 6: [None]}
    df = spark.createDataFrame([(g, i, v) for g, vs in values.items() for i, v in enumerate(vs)], "g int, i int, v double")
    got = {r["g"]: r for r in ranking._with_quantile(df, "v", guard, ["g"]).collect()}
    for g, vs in values.items():
        vs = sorted(v for v in vs if v is not None)
        want = (vs[0], vs[-1], vs[max(math.ceil(guard * len(vs)), 1) - 1]) if vs else (None, None, None)
        assert (got[g]["__low"], got[g]["__high"], got[g]["__anchor"]) == want
    rows = ranking.normalize_scores(df.where("g < 5"), "v", guard, ["g"])
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "percentile" not in plan and rows.count() == 357
