"""The registered queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__
from termloom import catalog

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables are missing")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(map(tuple, frame[columns].astype(object).where(frame[columns].notna(), None).astype(str).values.tolist()))


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, duck, name):
    assert rows(catalog.QUERIES[name](spark, SMALL).toPandas()) == rows(duck.execute(catalog.SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_runs(spark, name):
    assert catalog.QUERIES[name](spark, SMALL).count() > 0


def test_porter_vocab_by_rules(spark):
    from termloom.functions.porter import stem

    got = {r["term"]: r["stem"] for r in catalog.QUERIES["porter_vocab"](spark, SMALL).collect()}
    assert len(got) > 1000 and all(s == stem(t) and len(s) <= len(t) + 1 for t, s in got.items())


def test_pagerank_converges_to_the_fixed_point(spark, duck):
    import numpy as np

    got = {r["node"]: r["value"] for r in catalog.QUERIES["pagerank_converged"](spark, SMALL).collect()}
    nodes = [r[0] for r in duck.execute("SELECT p_partkey FROM part ORDER BY 1").fetchall()]
    place = {n: i for i, n in enumerate(nodes)}
    edges = duck.execute(
        "SELECT DISTINCT a.l_partkey, b.l_partkey FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1"
    ).fetchall()
    m = np.zeros((len(nodes), len(nodes)))
    for a, b in edges:
        m[place[b], place[a]] = 1
    out = m.sum(axis=0)
    m = np.where(out > 0, m / np.maximum(out, 1), 1 / len(nodes))
    want = np.linalg.solve(np.eye(len(nodes)) - 0.85 * m, np.full(len(nodes), 0.15 / len(nodes)))
    assert len(got) == len(nodes) and abs(np.array([got[n] for n in nodes]) - want).sum() < 1e-5


def test_crawl_order_is_breadth_first(spark, duck):
    import re
    from urllib.parse import quote, urljoin

    pages = dict(duck.execute("SELECT url, html FROM pages").fetchall())
    got = sorted(catalog.QUERIES["frontier_bfs_order"](spark, SMALL).collect(), key=lambda r: (r["depth"], r["place"]))
    queue, seen, fetched, depth = [min(pages)], {min(pages): 0}, [], 0
    while queue and len(fetched) < 20:
        url = queue.pop(0)
        fetched.append(url)
        for href in re.findall('<a href="([^"]+)"', pages.get(url, "")):
            to = urljoin(url, quote(href.split("#")[0], safe="/,*$&%:;!|@()+='~"))
            if seen[url] < 2 and to not in seen:
                seen[to] = seen[url] + 1
                queue.append(to)
    assert [(r["url"], r["depth"]) for r in got] == list(seen.items())
    assert {r["url"] for r in got if r["status"] != "pending"} == set(fetched)


def test_snippets_hold_the_most_matches(spark, duck):
    from termloom.functions.analysis import runs

    texts = dict(duck.execute("SELECT doc_id, text FROM documents").fetchall())
    rows = catalog.QUERIES["snippets"](spark, SMALL).collect()
    assert len(rows) == 10
    for r in rows:
        text = texts[r["doc_id"]]
        marks = [(a, b) for w, a, b in runs(text) if w.lower() in catalog._TERMS]
        inside = lambda s, marks=marks: sum(a >= s and b <= s + 240 for a, b in marks)
        starts = [max(0, a - 90) for a, _ in marks]
        best = max(map(inside, starts))
        want = min(s for s in starts if inside(s) == best)
        assert (r["source_start"], r["text"], r["matched"], r["n_highlights"]) == (want, text[want : want + 240], True, best)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
