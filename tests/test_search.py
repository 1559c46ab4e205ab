import math

import pytest
from pyspark.sql import functions as F

from termloom.engine import Corpus, Engine, ServiceError
from termloom.functions.analysis import AnalysisConfig
from termloom.operators import fuzzy, graph, ranking, retrieval
from termloom.operators.evaluation import corrupt, per_query, summary
from termloom.operators.index import Index, build_index, length_distribution
from termloom.plans.query import analyzed, parse

PLAIN = AnalysisConfig("none", "none")


def indexed(spark, texts, config=PLAIN):
    return build_index(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), config)


def tree(query, config=PLAIN, implicit="and"):
    return analyzed(parse(query, implicit), config)


def ids(df):
    return sorted(r["doc_id"] for r in df.collect())


def scores(df, column="score"):
    return {r["doc_id"]: r[column] for r in df.collect()}


BOATS = ["harbor storm anchor", "storm lantern storm", "lantern", "anchor anchor anchor harbor storm storm rope", "rope lantern harbor"]
GARDEN = ["green apples fall", "apples, green", "green and apples", "green pears", "ripe green apples", "green ripe apples fall"]


@pytest.fixture(scope="module")
def boats(spark):
    return indexed(spark, BOATS)


@pytest.fixture(scope="module")
def garden(spark):
    return indexed(spark, GARDEN, AnalysisConfig())


def brute_bm25(texts, terms, k1=1.2, b=0.75):
    """BM25 of the documents with any of the terms, from its formula."""
    words = [t.split() for t in texts]
    mean, out = sum(map(len, words)) / len(words), {}
    for i, w in enumerate(words):
        for t in terms:
            if t in w:
                df, tf = sum(t in other for other in words), w.count(t)
                idf = math.log(1 + (len(words) - df + 0.5) / (df + 0.5))
                out[i] = out.get(i, 0.0) + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(w) / mean))
    return out


def test_index_tables(boats):
    words = [t.split() for t in BOATS]
    assert (boats.n_docs, boats.avgdl) == (5, sum(map(len, words)) / 5)
    assert {r["term"]: r["df"] for r in boats.terms.collect()} == {t: sum(t in w for w in words) for t in set(" ".join(BOATS).split())}
    assert {r["doc_id"]: (r["dl"], r["max_tf"]) for r in boats.docs.collect()} == {i: (len(w), max(map(w.count, w))) for i, w in enumerate(words)}
    assert [r["positions"] for r in boats.lookup("storm").where("doc_id = 3").collect()] == [[4, 5]]
    assert length_distribution(boats.docs).first()["median"] == 3.0


def test_index_with_empty_documents(spark):
    index = indexed(spark, ["", "one two", None])
    assert (index.n_docs, index.total_tokens) == (3, 2) and math.isclose(index.avgdl, 2 / 3)
    empty = indexed(spark, [])
    assert empty.avgdl == 0.0 and empty.postings.count() == 0
    assert ids(ranking.rank(empty, tree("x"))) == []


def test_index_round_trip(spark, boats, tmp_path):
    boats.save(str(tmp_path / "i"))
    back = Index.load(spark, str(tmp_path / "i"))
    assert back.config == boats.config and back.avgdl == boats.avgdl
    assert sorted(back.postings.collect()) == sorted(boats.postings.collect())
    assert sorted(back.terms.collect()) == sorted(boats.terms.collect())


@pytest.mark.parametrize(
    "query, expected",
    [
        ("green AND apples", {0, 1, 2, 4, 5}), ("pears OR ripe", {3, 4, 5}), ("NOT green", set()), ("apple AND NOT ripe", {0, 1, 2}), ("plum", set()),
        ("NOT plum", set(range(6))), ("and", set()), ("NOT the", set(range(6))), ("fall AND the", set()), ("fall OR the", {0, 5}),
        ('"green apples"', {0, 2, 4}), ('"apple green"', {1}), ('"green ripe apple"', {5}), ('"green plum"', set()), ('"green apples" OR pear', {0, 2, 3, 4}),
        ('"green apples" AND NOT ripe', {0, 2}), ('"green apples falling"', {0}), ('"apples"', {0, 1, 2, 4, 5}),
    ],
)
def test_boolean_and_phrases(garden, query, expected):
    assert set(ids(retrieval.boolean_search(garden, tree(query, AnalysisConfig())))) == expected


def test_repeated_word_in_a_phrase(spark):
    index = indexed(spark, ["a a b", "a b a", "b a a"])
    assert ids(retrieval.phrase_search(index, ["a", "a"])) == [0, 2]


def test_windows(garden):
    assert scores(retrieval.window_search(garden, ["green", "appl"]), "window") == {0: 2, 1: 2, 2: 2, 4: 2, 5: 3}
    assert scores(retrieval.window_search(garden, ["green", "fall"]), "window") == {0: 3, 5: 4}
    assert scores(retrieval.window_search(garden, ["green", "plum"]), "window") == {}


def test_window_against_brute_force(spark):
    import itertools
    import random

    rnd = random.Random(7)
    texts = [" ".join(rnd.choice("abcdef") for _ in range(rnd.randint(1, 25))) for _ in range(60)]
    got = scores(retrieval.window_search(indexed(spark, texts), ["a", "b", "c"]), "window")
    for i, t in enumerate(texts):
        w = t.split()
        spans = [j - k + 1 for k, j in itertools.product(range(len(w)), repeat=2) if k <= j and {"a", "b", "c"} <= set(w[k : j + 1])]
        assert got.get(i) == (min(spans) if spans else None)


@pytest.mark.parametrize("window, n, k, expected", [(2, 2, 1, 1), (3, 2, 1, 0.5), (4, 2, 1, 1 / 3), (3, 2, 2, 1), (None, 2, 1, 0), (1, 1, 5, 0)])
def test_proximity(spark, window, n, k, expected):
    df = spark.createDataFrame([(window,)], "w int")
    assert math.isclose(df.select(retrieval.proximity(F.col("w"), n, k)).first()[0], expected)


def test_bm25_and_tfidf(boats):
    assert scores(ranking.rank(boats, tree("storm"))) == pytest.approx(brute_bm25(BOATS, ["storm"]))
    both = ranking.rank(boats, tree("storm lantern", implicit="or"), ranking.Strategy(k1=0.9, b=0.3))
    assert scores(both) == pytest.approx(brute_bm25(BOATS, ["storm", "lantern"], 0.9, 0.3))
    raw = ranking.rank(boats, tree("storm"), ranking.Strategy("tfidf"))
    idf = math.log(5 / 3)
    assert scores(raw) == pytest.approx({0: idf, 1: 2 * idf, 3: 2 * idf})
    assert [r["doc_id"] for r in ranking.top_k(raw, 3).collect()] == [1, 3, 0]
    assert scores(ranking.rank(boats, tree("storm"), ranking.Strategy("tfidf", tf="log")))[3] == pytest.approx((1 + math.log(2)) * idf)
    assert scores(ranking.rank(boats, tree("storm"), ranking.Strategy("tfidf", tf="augmented")))[3] == pytest.approx((0.5 + 0.5 * 2 / 3) * idf)
    assert scores(ranking.rank(boats, tree("storm"), ranking.Strategy("boolean"))) == {0: 0.0, 1: 0.0, 3: 0.0}
    assert scores(ranking.rank(boats, tree("NOT rope"))) == {0: 0.0, 1: 0.0, 2: 0.0}


def test_phrase_bonus_and_proximity(boats):
    plain = brute_bm25(BOATS, ["harbor", "storm"])
    row = ranking.rank(boats, tree('"harbor storm"'), ranking.Strategy("bm25-phrase")).collect()
    assert {r["doc_id"]: r["score"] for r in row} == pytest.approx({i: plain[i] + 1.2 for i in (0, 3)}) and {r["phrase"] for r in row} == {1.2}
    near = ranking.rank(boats, tree("harbor storm"), ranking.Strategy("bm25-phrase-proximity"))
    assert scores(near) == pytest.approx({i: plain[i] + 1.0 for i in (0, 3)})
    far = ranking.rank(boats, tree("anchor rope"), ranking.Strategy("bm25-phrase-proximity"))
    assert scores(far) == pytest.approx({3: brute_bm25(BOATS, ["anchor", "rope"])[3] + 1 / 4})


@pytest.mark.parametrize("weight", [0.0, 0.5, 1.0])
def test_fusion(spark, boats, weight):
    values = {0: 0.3, 1: 0.1, 2: 0.5, 3: 0.2, 4: 0.0}
    pr = spark.createDataFrame(list(values.items()), "doc_id long, value double")
    got = ranking.rank(boats, tree("storm"), ranking.Strategy("bm25-pr", pr_weight=weight), pr)
    plain = brute_bm25(BOATS, ["storm"])
    low, high = min(plain.values()), max(plain.values())
    want = {i: (1 - weight) * (v - low) / (high - low) + weight * values[i] / 0.5 for i, v in plain.items()}
    assert scores(got) == pytest.approx(want)


def test_normalisation_guard(spark):
    values = [float(i) if i != 50 else 1000.0 for i in range(100)]
    df = spark.createDataFrame(list(enumerate(values)), "doc_id long, v double")
    got = scores(ranking.normalize_scores(df, "v", 0.95), "norm")
    assert got[51] == pytest.approx(0.51) and got[90] == pytest.approx(0.90) and got[95] == pytest.approx(0.95)
    assert got[96] == pytest.approx(0.95 + 0.05 / 905) and got[50] == pytest.approx(1.0)
    flat = spark.createDataFrame([(0, 3.0), (1, 3.0)], "doc_id long, v double")
    assert set(scores(ranking.normalize_scores(flat, "v"), "norm").values()) == {0.0}


@pytest.mark.parametrize("bad", [{"k1": -1}, {"b": 1.5}, {"phrase_bonus": -1}, {"proximity_k": -1}, {"pr_weight": -0.1}, {"pr_weight": 1.5}, {"guard": 0}, {"name": "x"}, {"tf": "x"}])
def test_bad_strategies(bad):
    with pytest.raises(ValueError):
        ranking.Strategy(**bad)


def test_batch_equals_single(spark, boats):
    terms = spark.createDataFrame([(7, 0, "storm"), (7, 1, "rope"), (8, 0, "lantern")], "query_id long, ord int, term string")
    batch = {(r["query_id"], r["doc_id"]): r["score"] for r in ranking.bm25_batch(boats, terms).collect()}
    for q, text in ((7, "storm rope"), (8, "lantern")):
        single = scores(ranking.rank(boats, tree(text, implicit="or")))
        assert {d: s for (query, d), s in batch.items() if query == q} == pytest.approx(single)


TYPOS = ["search engine ranking", "full text retrieval", "aaaaab alpha", "aaaaac alpha", "aaaaad alpha", "aaaaae alpha", "aaaaae alpha beta", "quorum consensus"]


@pytest.fixture(scope="module")
def typos(spark):
    return indexed(spark, TYPOS)


def test_edit_distance_and_variants(spark):
    rows = [("cat", "car", 2, 1), ("seach", "search", 2, 1), ("flaw", "lawn", 2, 2), ("kitten", "sitting", 3, 3), ("kitten", "sitting", 2, 3), ("kitten", "sitting", 0, 1)]
    for a, b, k, expected in rows:
        assert spark.createDataFrame([(a, b)], "a string, b string").select(fuzzy.bounded_distance("a", "b", k)).first()[0] == expected
    for word in ("", "a", "seach"):
        got = spark.createDataFrame([(word,)], "t string").select(fuzzy.variants(F.col("t"))).first()[0]
        letters = fuzzy.ALPHABET
        want = {word[:i] + word[i + 1 :] for i in range(len(word))} | {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in letters}
        want |= {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in letters}
        assert sorted(got) == sorted(want - {word})


def test_expansion(typos):
    got = fuzzy.expand(typos, tree("seach"))
    assert got.tree.words == ("seach", "search") and got.expansions == [("seach", ["search"], 1)]
    assert ids(retrieval.boolean_search(typos, got.tree)) == [0]
    got = fuzzy.expand(typos, tree("alpha AND aaaaax"))
    assert ids(retrieval.boolean_search(typos, got.tree)) == [2, 3, 4, 5, 6]
    same = tree('NOT seach "seach engine"')
    assert fuzzy.expand(typos, same).tree is same
    capped = fuzzy.expand(typos, tree("aaaaax"), fuzzy.FuzzyOptions(per_term=2))
    assert capped.expansions == [("aaaaax", ["aaaaae", "aaaaab"], 1)] and capped.counts["per_term"] == 1
    few = fuzzy.expand(typos, tree("aaaaax OR seach"), fuzzy.FuzzyOptions(per_query=3))
    assert few.counts["added"] == 3 and few.counts["per_query"] == 2
    assert fuzzy.expand(typos, tree("aaaxxb")).expansions == []
    two = fuzzy.expand(typos, tree("aaaxxb"), fuzzy.FuzzyOptions(max_edits=2))
    assert "aaaaab" in two.expansions[0][1] and two.expansions[0][2] == 2
    assert fuzzy.expand(typos, tree("aaax"), fuzzy.FuzzyOptions(max_edits=2)).counts["edits2_skipped"] == 1
    assert fuzzy.expand(typos, tree("zz")).counts["too_short"] == 1


def test_corrupt():
    known = {"search", "engine"}
    typo = corrupt("my search engine", known, str.lower)
    assert typo is not None and typo.split()[1] not in known and typo.split()[1][:5] == "searc"
    assert corrupt("a bc", known, str.lower) is None


def ranked_nodes(spark, n, edges, **options):
    nodes = spark.range(n).withColumnRenamed("id", "node")
    return graph.pagerank(nodes, spark.createDataFrame(edges, "src long, dst long"), **options)


@pytest.mark.parametrize(
    "n, edges, expected",
    [
        (2, [(0, 1)], {0: 1 / 2.85, 1: 1.85 / 2.85}),
        (3, [(0, 1), (1, 2), (2, 0), (2, 0)], {0: 1 / 3, 1: 1 / 3, 2: 1 / 3}),
        (3, [(0, 2), (1, 2)], {0: 1 / 4.7 * 1.0, 1: 1 / 4.7, 2: 2.7 / 4.7}),
    ],
)
def test_pagerank(spark, n, edges, expected):
    got = ranked_nodes(spark, n, edges, tolerance=1e-9)
    assert got.converged and {r["node"]: r["value"] for r in got.scores.collect()} == pytest.approx(expected, abs=1e-4)


def test_pagerank_edges_and_errors(spark):
    alone = ranked_nodes(spark, 3, [])
    assert alone.iterations == 1 and alone.converged and {round(r["value"], 9) for r in alone.scores.collect()} == {round(1 / 3, 9)}
    assert not ranked_nodes(spark, 2, [(0, 1)], max_iterations=1).converged
    for bad in ({"damping": 1.0}, {"tolerance": 0}, {"max_iterations": 0}):
        with pytest.raises(ValueError):
            ranked_nodes(spark, 2, [(0, 1)], **bad)
    with pytest.raises(ValueError):
        ranked_nodes(spark, 2, [(0, 5)])
    with pytest.raises(ValueError):
        ranked_nodes(spark, 0, [])


def run_of(spark, rows):
    return spark.createDataFrame([(q, d, i + 1) for q, ds in rows.items() for i, d in enumerate(ds)], "query_id string, doc_id string, rank int")


def qrels_of(spark, rows):
    return spark.createDataFrame([(q, d, float(g)) for q, ds in rows.items() for d, g in ds.items()], "query_id string, doc_id string, grade double")


def test_metrics_against_their_formulas(spark):
    import random

    rnd = random.Random(12)
    runs = {f"q{i}": rnd.sample([f"d{j}" for j in range(12)], rnd.randint(1, 12)) for i in range(8)}
    judged = {f"q{i}": {f"d{j}": rnd.choice([0, 1, 1, 2]) for j in rnd.sample(range(15), 6)} for i in range(9)}
    judged = {q: js if any(js.values()) else js | {"d0": 1} for q, js in judged.items()}
    cuts = (1, 3, 10)
    want = {}
    for q, js in judged.items():
        run, good = runs.get(q, []), {d for d, g in js.items() if g > 0}
        hits = [d in good for d in run]
        row = {"ap": sum(sum(hits[: i + 1]) / (i + 1) for i, h in enumerate(hits) if h) / len(good)}
        for k in cuts:
            n = sum(hits[:k])
            gain = lambda grades, k=k: sum((2**g - 1) / math.log2(i + 2) for i, g in enumerate(grades[:k]))
            row |= {f"p_{k}": n / k, f"r_{k}": n / len(good), f"f1_{k}": 2 * n / (k + len(good)) if n else 0.0}
            row[f"ndcg_{k}"] = gain([js.get(d, 0) for d in run]) / gain(sorted(js.values(), reverse=True))
        want[q] = row
    got = {r["query_id"]: r.asDict() for r in per_query(run_of(spark, runs), qrels_of(spark, judged), cuts).collect()}
    assert set(got) == set(want)
    for q, row in want.items():
        assert {c: got[q][c] for c in row} == pytest.approx(row), q
    means = summary(run_of(spark, runs), qrels_of(spark, judged), cuts).first().asDict()
    assert means["map"] == pytest.approx(sum(r["ap"] for r in want.values()) / 9)
    assert means["ndcg_3"] == pytest.approx(sum(r["ndcg_3"] for r in want.values()) / 9)


def test_engine(spark):
    docs = spark.createDataFrame([(i, f"c{i}", "" if i else "First", f"http://x/{i}", t) for i, t in enumerate(TYPOS)], "doc_id long, corpus_id string, title string, url string, text string")
    engine = Engine({"t": Corpus(build_index(docs, AnalysisConfig()), docs)}, "t")
    rows, meta = engine.search("seach alpha", fuzzy_edits=1, k=3)
    assert meta["total"] == 6 and meta["pages"] == 2 and len(rows.collect()) == 3
    top = engine.search("search engine")[0].first()
    assert top["doc_id"] == 0 and top["title"] == "First" and top["snippet"]["matched"]
    assert engine.document(0, '"search engine"')["matched_phrases"] == ["search engin"]
    assert engine.stats()["num_docs"] == 8 and engine.health()["status"] == "ok" and engine.trace("alpha")["candidates"] == 5
    for call, code in (
        (lambda: engine.search(""), "INVALID_QUERY"), (lambda: engine.search("("), "QUERY_PARSE"), (lambda: engine.search("a", corpus="z"), "INVALID_CORPUS"),
        (lambda: engine.search("a", strategy="z"), "INVALID_STRATEGY"), (lambda: engine.search("a", strategy="bm25-pr"), "STRATEGY_UNAVAILABLE"),
        (lambda: engine.search("a", k=51), "INVALID_PARAMS"), (lambda: engine.search("a", fuzzy_edits=3), "INVALID_FUZZY"), (lambda: engine.document(99), "DOC_NOT_FOUND"),
    ):
        with pytest.raises(ServiceError) as e:
            call()
        assert e.value.code == code


def test_building_an_index_shuffles_nothing(spark, tmp_path):
    """Documents become their entries where they are, and what a set of queries reads is by document."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(BOATS * 3 + ["", "a b_c d'e don't"])], "doc_id long, text string").repartition(3)
    docs.write.parquet(str(tmp_path / "docs"))
    written = store.executionsCount()
    index = build_index(spark.read.parquet(str(tmp_path / "docs")), AnalysisConfig("none", "none"))
    plans = [store.execution(i).get().physicalPlanDescription() for i in range(written, store.executionsCount())]
    assert written > before and plans and not any("Exchange hashpartitioning" in p or "Exchange rangepartitioning" in p for p in plans)
    row = index.entries.where("doc_id = 16").first()
    assert (row["dl"], row["max_tf"]) == (5, 1) and [(e["term"], e["positions"]) for e in row["entries"]] == [("a", [0]), ("b", [1]), ("c", [2]), ("de", [3]), ("dont", [4])]
