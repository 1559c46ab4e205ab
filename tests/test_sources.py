import hashlib
import json

import pytest
from pyspark.sql import functions as F

from termloom.engine import Engine, ServiceError, open_corpus
from termloom.functions import web
from termloom.functions.analysis import AnalysisConfig
from termloom.sources import files
from termloom.streaming import crawl


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_corpus_and_queries(spark, tmp_path):
    p = write(tmp_path / "c.jsonl", '{"_id":"a","title":"T","text":"x"}\n\n{"_id":"b","text":"y"}\n')
    assert [tuple(r) for r in files.read_corpus(spark, p).orderBy("doc_id").collect()] == [(0, "a", "T", "x"), (1, "b", "", "y")]
    with pytest.raises(Exception, match="line 2"):
        files.read_corpus(spark, write(tmp_path / "d.jsonl", '{"_id":"a"}\n{"_id":5}\n')).collect()
    q = write(tmp_path / "q.jsonl", '{"_id":"1","text":"old"}\n{"_id":"1","text":"new"}\n')
    assert [tuple(r) for r in files.read_queries(spark, q).collect()] == [("1", "new")]
    with pytest.raises(Exception, match="line 1"):
        files.read_queries(spark, write(tmp_path / "r.jsonl", '{"_id":"1"}\n')).collect()
    assert files.file_hash(spark, p) == hashlib.sha256((tmp_path / "c.jsonl").read_bytes()).hexdigest()


def test_qrels(spark, tmp_path):
    good = write(tmp_path / "q.tsv", "query-id\tcorpus-id\tscore\nq1\td1\t1\nq1\td2\t0.5\n")
    assert sorted(tuple(r) for r in files.read_qrels(spark, good).collect()) == [("q1", "d1", 1.0), ("q1", "d2", 0.5)]
    for i, bad in enumerate(("query-id\tother\nq\td\t1", "q\td", "q\td\t-1", "q\td\tx", "q\td\t1\nq\td\t2")):
        with pytest.raises(Exception, match="line"):
            files.read_qrels(spark, write(tmp_path / f"b{i}.tsv", bad)).collect()


def test_static_pages(spark, tmp_path):
    html = "<html><head><title>A &amp; B</title></head><body><p>One &lt;two&gt;</p>three</body></html>"
    write(tmp_path / "p.html", html)
    row = {"id": "p", "file": "p.html", "title": "other", "url": "http://x", "sha256": hashlib.sha256(html.encode()).hexdigest()}
    write(tmp_path / "documents.jsonl", json.dumps(row) + "\n")
    assert tuple(files.read_static_pages(spark, str(tmp_path)).first()) == (0, "p", "A & B", "http://x", "One <two> three")
    write(tmp_path / "documents.jsonl", json.dumps(row | {"sha256": "0"}) + "\n")
    with pytest.raises(Exception, match="wrong or missing"):
        files.read_static_pages(spark, str(tmp_path)).collect()


def test_citations_links_and_artifacts(spark, tmp_path):
    p = write(tmp_path / "g.json", json.dumps({"edges": [[0, 1], [1, 2]], "stats": {"graphHash": "h"}}))
    edges, found = files.read_citations(spark, p)
    assert found == "h" and sorted(map(tuple, edges.collect())) == [(0, 1), (1, 2)]
    with pytest.raises(ValueError):
        files.read_citations(spark, write(tmp_path / "n.json", json.dumps({"edges": []})))
    write(tmp_path / "run1.json", json.dumps({"kind": "run", "createdAt": "t", "config": {"k": "1"}, "metrics": {"map": "0.5"}}))
    write(tmp_path / "run2.json", "not json")
    assert [r["kind"] for r in files.read_artifacts(spark, str(tmp_path / "run*.json")).collect()] == ["run"]
    merged = files.merge_collections({"b": spark.createDataFrame([("1",)], "id string"), "a": spark.createDataFrame([("1",)], "id string")}, "id")
    assert sorted(r["id"] for r in merged.collect()) == ["a:1", "b:1"]


@pytest.mark.parametrize(
    "raw, base, expected",
    [
        ("HTTP://Example.COM:80/a?b=2&a=1#x", None, "http://example.com/a?a=1&b=2"),
        ("https://u:p@h.org:443", None, "https://h.org/"),
        ("https://h.org:8443/x?", None, "https://h.org:8443/x"),
        ("../b", "http://h.org/a/c", "http://h.org/b"),
        ("/p?flag&x=a b", "http://h.org", "http://h.org/p?flag=&x=a+b"),
        ("mailto:a@b", None, None),
        ("ftp://h/x", None, None),
        ("no base", None, None),
        ("http://h.org/a b", None, "http://h.org/a%20b"),
        ("http://h:bad/", None, None),
        (None, None, None),
    ],
)
def test_normalize_url(raw, base, expected):
    assert web.normalize_url(raw, base) == expected


def test_allowlist(spark):
    df = spark.createDataFrame([("http://a.org/x",), ("http://b.a.org/",), ("http://xa.org",), ("bad",)], "u string")
    got = lambda *p: [r[0] for r in df.select(web.host_allowed(web.host_of(F.col("u")), list(p))).collect()]
    assert got("a.org") == [True, False, False, False] and got("*.A.org ") == [True, True, False, False]
    assert got("*") == [True] * 4 and got() == [False] * 4
    assert web.parse_allowlist(" a, ,b") == ["a", "b"]


def test_robots():
    r = web.parse_robots("User-agent: a\nUser-agent: bot\nDisallow: /x\nAllow: /x/y\nCrawl-delay: 2\n\nUser-agent: *\nDisallow: /*.pdf$\nDisallow:\nSitemap: http://s")
    assert not r.allows("MyBot/1", "/x/z") and r.allows("mybot", "/x/y") and r.delay_for("bot") == 2.0
    assert not r.allows("other", "/q.pdf") and r.allows("other", "/q.pdfx") and r.sitemaps == ("http://s",)
    assert not web.parse_robots("Disallow: /").allows("any", "/a")
    r = web.parse_robots("Crawl-delay: 9\r\nDisallow: /p # why\r\n  USER-AGENT : Long-Bot \nSitemap: u\nUser-agent: bot\nCrawl-delay: x\nDisallow: /\nUser-agent: bot\nAllow: /q\n: none\nnonsense")
    assert [g.agents for g in r.groups] == [("*",), ("long-bot", "bot"), ("bot",)] and r.groups[0].delay is None and r.delay_for("bot") is None
    assert not r.allows("x", "/p/1") and r.allows("x", "/1") and not r.allows("the long-bot", "/q") and not r.allows("bot", "/q") and r.sitemaps == ("u",)
    assert web.parse_robots("").allows("a", "/") and web.parse_robots("Crawl-delay: 3").groups == ()
    assert web.parse_robots("User-agent: *\nDisallow: /a\nAllow: /a").allows("z", "/a")
    assert not web.robots_for(403, None).allows("z", "/") and web.robots_for(404, None).allows("z", "/") and web.robots_for(None, None).allows("z", "/")


def test_links_of_pages_in_one_worker(spark):
    rows = [(i, f"http://h.org/{i}/", f"<a href='p{i}#f'> go <b>on</b></a><p>{'x' * 50}" + "<a href='mailto:a'>m</a>" * (i % 2)) for i in range(200)] + [(200, None, "<a href='/q'>q</a>"), (201, "http://h.org/", None)]
    got = web.linked(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1))
    # one reading of a page, and one worker that resolves its links too
    assert "EvalPython" not in got._jdf.queryExecution().executedPlan().toString()
    want = {(i, u, f"{u}p{i}", 0, "go on") for i, u, _ in rows[:200]} | {(i, u, None, 1, "m") for i, u, _ in rows[:200] if i % 2} | {(200, None, None, 0, "q")}
    assert {tuple(r) for r in got.collect()} == want


def test_extract_page():
    html = """<html><head><base href="/d/"><title> A  b </title><meta name="Description" content=" m "><meta property="og:title" content="o">
    <link rel="canonical" href="c"></head><body><h1>H <i>x</i></h1><h2></h2><a href="p#f"> go </a><a>none</a><script>no</script>text &amp; more</body></html>"""
    page = web.extract_page(html, "http://h.org/q/")
    assert page["title"] == "A b" and page["meta"] == {"description": "m", "og:title": "o"} and page["canonical_url"] == "http://h.org/d/c"
    assert page["headings"] == [{"level": "h1", "text": "H x"}]
    assert page["links"] == [{"raw_href": "p#f", "href": "http://h.org/d/p#f", "anchor": "go", "position": 0}]
    assert page["text"] == "H x go nonetext & more"
    assert web.extract_page("", "http://h")["text"] == ""
    # only whole references are decoded, as in SQL: titles may be cut within one
    cut = web.extract_page("<title>A &amp;&amp</title>&am &#39;&#39 &notit; &eacute;<a href='?a=1&amp;b&copy=2'>&quo</a>", "http://h/")
    assert (cut["title"], cut["text"], cut["links"][0]["raw_href"]) == ("A &&amp", "&am '&#39 &notit; é&quo", "?a=1&b&copy=2")
    assert web.extract_page("<p>a<![foo[ x ]]>b<![>c<!-- d", "http://h")["text"] == "abc"


def test_decode_and_snippet():
    assert web.decode_body("é".encode("latin-1"), "text/html; charset=ISO-8859-1") == "é" and web.decode_body(b"a", "x; charset=zzz") == "a"
    config = AnalysisConfig()
    text = "x " * 100 + "fox and fox end"
    s = web.make_snippet(text, {"fox"}, config)
    assert s["matched"] and [text[s["source_start"] :][h["start"] : h["end"]] for h in s["highlights"]] == ["fox", "fox"]
    assert web.make_snippet("nothing", {"fox"}, config) == {"text": "nothing", "matched": False, "source_start": 0, "highlights": []}


def test_lines_are_numbered_across_blocks(spark, tmp_path):
    lines = [f"line {i}" if i % 7 else " \t"[: i % 2] for i in range(3000)]
    path = write(tmp_path / "l.txt", "\r\n".join(lines) + "\r\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = files.numbered_lines(spark, path).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r["line"], r["value"]) for r in rows) == list(enumerate(lines, 1))
    assert [r["seq"] for r in sorted(rows, key=lambda r: r["line"]) if r["value"].strip()] == list(range(sum(bool(x.strip()) for x in lines)))


def test_news_and_books(spark, tmp_path):
    group = tmp_path / "train" / "sci"
    group.mkdir(parents=True)
    (group / "1").write_bytes(b"From: a\r\nSUBJECT: Re: the\r\n  moon\r\nX: y\r\n\r\nbody\r\n\r\nend\r\n")
    (group / "2").write_bytes(b"From: b\n\n\n")
    (group / "3").write_bytes(b"Subject: alone")
    got = {r["corpus_id"]: (r["title"], r["text"]) for r in files.read_news(spark, str(tmp_path)).collect()}
    assert got == {"train/sci/1": ("Re: the moon", "body\n\nend"), "train/sci/3": ("alone", "")}
    book = ["licence", "*** START OF THE PROJECT GUTENBERG EBOOK X", "CHAPTER I", "CHAPTER II", *[""] * 8, "CHAPTER I", "One", "line.", "", "[Illustration: a", "b] Two.", *[""] * 6, "CHAPTER II", "", "Last.", "*** END OF THE PROJECT GUTENBERG EBOOK X", "CHAPTER III"]
    lines = [("x", i, v) for i, v in enumerate(book)] + [("y", i, v) for i, v in enumerate(["CHAPTER I", "all"])]
    got = files.split_books(spark.createDataFrame(lines, "book string, line int, value string"), r"^CHAPTER [IVX]+$").collect()
    assert sorted(map(tuple, got)) == [("x", 1, "CHAPTER I", "One line.\nTwo."), ("x", 2, "CHAPTER II", "Last."), ("y", 1, "CHAPTER I", "all")]


def test_recorded_experiments(spark, tmp_path):
    run = {"experiment_id": "e", "git": {"sha": 7}, "strategy": {"id": "bm25", "params": {"b": 0.5}}, "metrics": {"map": 0.25, "ndcg": {"10": 0.5}}, "fuzzy": {"enabled": True}}
    for name, value in (("1.json", run), ("2.json", {"metrics": {"map": "x"}}), ("3.json", {"metrics": {"map": 1}}), ("a-pagerank.json", {"scores": {"sum": 1.0, "top": [[1, 2]]}, "graph": {"n": 3}})):
        write(tmp_path / name, json.dumps(value))
    write(tmp_path / "4.json", "{broken")
    got = files.artifacts_of(spark, str(tmp_path / "[0-9].json")).collect()
    assert [r["file"] for r in got] == ["3.json", "1.json"] and got[0]["map"] == 1.0 and not got[0]["fuzzy"]
    one = got[1].asDict()
    assert (one["git_sha"], one["strategy"], json.loads(one["params"]), one["ndcg10"], one["recall100"], one["fuzzy"]) == (None, "bm25", {"b": 0.5}, 0.5, None, True)
    (rank,) = files.artifacts_of(spark, str(tmp_path), "-pagerank.json").collect()
    assert (rank["kind"], rank["sum"], json.loads(rank["top"]), json.loads(rank["graph"])) == ("pagerank", 1.0, [[1, 2]], {"n": 3})


def test_upsert(spark):
    known = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "url string, n int, t string")
    fresh = spark.createDataFrame([("b", 2, "z"), ("b", 3, "w"), ("c", 1, "v")], "url string, n int, t string")
    assert sorted(map(tuple, crawl.upsert(known, fresh, ["url"]).collect())) == [("a", 1, "x"), ("b", 3, "w"), ("c", 1, "v")]


def site(spark):
    def page(*links, text="t"):
        return "<html><body>" + text + "".join(f'<a href="{x}">l</a>' for x in links) + "</body></html>"

    rows = [
        ("http://s.org/", 200, "text/html", page("/a", "/b", "/a#x", "/no", "/blocked", "http://off.org/", "/plain", text="home")),
        ("http://s.org/a", 200, "text/html; charset=utf-8", page("/", "/c", text="same")),
        ("http://s.org/b", 200, "text/html", page("/", "/c", text="same")),
        ("http://s.org/c", 200, "text/html", page("/d", text="deep")),
        ("http://s.org/plain", 200, "text/plain", "x"),
        ("http://s.org/robots.txt", 200, "text/plain", "User-agent: *\nDisallow: /blocked\n"),
        ("http://s.org/blocked", 200, "text/html", page()),
    ]
    return spark.createDataFrame([(*r, r[0]) for r in rows], "url string, status int, content_type string, body string, final_url string")


def test_crawl(spark, tmp_path):
    options = crawl.CrawlOptions(("http://s.org",), ("s.org",), max_pages=20, max_depth=2)
    state = crawl.crawl(spark, site(spark), options)
    got = {r["url"].removeprefix("http://s.org"): (r["depth"], r["status"]) for r in state.urls.collect()}
    assert got == {"/": (0, "fetched"), "/a": (1, "fetched"), "/b": (1, "fetched"), "/no": (1, "failed"), "/blocked": (1, "skipped"), "/plain": (1, "skipped"), "/c": (2, "fetched")}
    assert state.counts["fetched"] == 4 and state.counts["duplicates"] == 1 and state.counts["off_allowlist"] == 1 and state.counts["too_deep"] == 1
    owners = [r["url"] for r in crawl.indexable(state.documents).collect()]
    assert owners == ["http://s.org/", "http://s.org/a", "http://s.org/c"]
    lines = sorted((r["url"], r["title"], r["text"]) for r in crawl.indexable(state.documents).collect())
    assert crawl.corpus_hash(state.documents) == hashlib.sha256("".join(f"{u}\t{t}\t{x}\n" for u, t, x in lines).encode()).hexdigest()
    few = crawl.crawl(spark, site(spark), crawl.CrawlOptions(("http://s.org",), ("s.org",), max_pages=2, max_depth=2))
    assert few.counts["fetched"] == 2 and {r["status"]: r["n"] for r in crawl.status_counts(few.urls).collect()}["pending"] > 0
    few.save(str(tmp_path / "state"))
    again = crawl.crawl(spark, site(spark), options, crawl.CrawlState.load(spark, str(tmp_path / "state")))
    assert {r["url"] for r in again.urls.where("status = 'fetched'").collect()} == {r["url"] for r in state.urls.where("status = 'fetched'").collect()}


def test_crawl_index_and_manifest(spark, tmp_path):
    state = crawl.crawl(spark, site(spark), crawl.CrawlOptions(("http://s.org",), ("s.org",), max_pages=20, max_depth=2))
    manifest = crawl.build_crawl_index(state, str(tmp_path))
    assert manifest["corpusHash"] == crawl.corpus_hash(state.documents)
    assert manifest["counts"]["indexable"] == 3 and manifest["counts"]["duplicates"] == 1 and manifest["counts"]["urls"] == {"fetched": 4, "failed": 1, "skipped": 2}
    rows = state.documents.select(F.col("url").alias("corpus_id"), "title", "url", "text")
    corpus = open_corpus(spark, f"{tmp_path}/crawled.index", rows, "crawl")
    hit = Engine({"c": corpus}, "c").call("search", query="samell")[0].first()
    assert hit["url"] == "http://s.org/a" and corpus.docs.where("source = 'crawl' and text is not null").count() == 3
    bare = open_corpus(spark, f"{tmp_path}/crawled.index")
    assert {(r["title"], r["text"]) for r in bare.docs.collect()} == {(u, None) for u in ("http://s.org/", "http://s.org/a", "http://s.org/c")}
    with pytest.raises(ServiceError, match="INDEX_UNAVAILABLE"):
        open_corpus(spark, str(tmp_path / "none"))
    for call, code in (({"name": "nothing"}, "NOT_FOUND"), ({"name": "search"}, "VALIDATION"), ({"name": "search", "query": 3}, "VALIDATION"), ({"name": "stats", "x": 1}, "VALIDATION"), ({"name": "document", "doc_id": 9}, "DOC_NOT_FOUND")):
        with pytest.raises(ServiceError, match=code):
            Engine({"c": corpus}, "c").call(**call)


def test_owner_is_the_first_arrival_after_a_resume(spark):
    # a page of the second level is met again with a hash of a page of the first that a resumed run fetches
    def page(text, *links):
        return text + "".join(f'<a href="{x}">.</a>' for x in links)

    rows = [("http://s.org/", page("home", *(f"/{i}" for i in range(1, 60))))]
    rows += [(f"http://s.org/{i}", page(f"n{i}", "/deep") if i < 59 else "same") for i in range(1, 60)] + [("http://s.org/deep", "same")]
    store = spark.createDataFrame([(u, 200, "text/html", b, u) for u, b in rows], "url string, status int, content_type string, body string, final_url string")
    options = crawl.CrawlOptions(("http://s.org",), ("s.org",), max_pages=20, max_depth=2)
    state = None
    for _ in range(4):
        state = crawl.crawl(spark, store, options, state)
    assert {r["url"]: r["duplicate_of"] for r in state.documents.where("text = 'same'").collect()} == {"http://s.org/59": None, "http://s.org/deep": "http://s.org/59"}


def test_politeness_redirects_and_size(spark):
    rows = [
        ("http://a.org/", 200, "text/html", "".join(f'<a href="http://{h}.org/{i}">x</a>' for i in range(3) for h in "ab"), None),
        ("http://b.org/robots.txt", 200, "text/plain", "User-agent: *\nCrawl-delay: 5\nDisallow: /2", None),
        *((f"http://{h}.org/{i}", 200, "text/html", f"{h}{i}", None) for i in (1, 2) for h in "ab"),
        ("http://a.org/0", 302, None, None, "/hop"), ("http://a.org/hop", 301, None, None, "http://a.org/end"), ("http://a.org/end", 200, "text/html", "moved <a href='z'>z</a>", None),
        ("http://b.org/0", 302, None, None, "/0"),
    ]
    store = spark.createDataFrame([(u, s, t, b, None, loc) for u, s, t, b, loc in rows], "url string, status int, content_type string, body string, final_url string, location string")
    options = crawl.CrawlOptions(("http://a.org",), ("a.org", "b.org"), max_pages=20, max_depth=1, delay=2, max_redirects=3)
    state = crawl.crawl(spark, store, options)
    status = {r["url"]: (r["status"], r["reason"]) for r in state.urls.collect()}
    assert status["http://b.org/2"] == ("skipped", "robots") and status["http://a.org/0"] == ("fetched", None) and status["http://b.org/0"] == ("failed", "too many redirects")
    assert state.documents.where("url = 'http://a.org/0'").first()["text"] == "moved z"
    assert state.links.where("from_url = 'http://a.org/0'").first()["to_url"] == "http://a.org/z"
    at = {r["url"]: r["at"] for r in state.requests.collect()}
    assert at == {"http://a.org/": 0, "http://a.org/0": 2, "http://a.org/1": 4, "http://a.org/2": 6, "http://b.org/0": 0, "http://b.org/1": 5}
    # a budget takes what is due first
    few = crawl.crawl(spark, store, crawl.CrawlOptions(("http://a.org",), ("a.org", "b.org"), max_pages=4, max_depth=1, delay=2))
    assert {r["url"] for r in few.requests.collect()} == {"http://a.org/", "http://b.org/0", "http://a.org/0", "http://a.org/1"}
    small = crawl.crawl(spark, store, crawl.CrawlOptions(("http://a.org",), ("a.org",), max_bytes=10))
    assert small.urls.first()["reason"] == "body too long"


@pytest.mark.parametrize("bad", [{"seeds": ()}, {"allowlist": ()}, {"max_pages": 0}, {"max_depth": -1}, {"delay": -1.0}, {"max_bytes": 0}])
def test_bad_crawl_options(bad):
    with pytest.raises(ValueError):
        crawl.CrawlOptions(**({"seeds": ("http://a",), "allowlist": ("*",)} | bad))


def test_stream_ingest(spark, tmp_path):
    rows = spark.createDataFrame([("http://a", "<title>T</title><body>x</body>")], "url string, html string")
    rows.write.parquet(str(tmp_path / "in"))
    crawl.ingest_stream(spark, str(tmp_path / "in"), "url string, html string", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert [(r["title"], r["text"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("T", "x")]
