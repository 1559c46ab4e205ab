"""Quality, extraction, toxicity, language-model scores and chat formatting."""

import json
import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from termloom.llm import chat, html_extract, lm_score, quality, toxicity
from termloom.llm.entries import QUERIES

DIR = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not os.path.isdir(DIR), reason="test tables are missing")
DOCS = "doc_id long, text string, lang string, score double, start long"
ODD = [(1, None, "a", 0.0, 1), (2, "", "a", 0.0, 1), (None, "x y z", "b", 0.0, 1), (3, "same text here", "b", 0.0, 1), (3, "same text here", "b", 0.0, 1), (4, "long " * 30_000, "c", 0.0, 1)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, i % 2, i % 2) for i in range(60)] + [(None, 1, 1), (5, None, None)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def held_out(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


@needs_tables
@pytest.mark.parametrize("name, label, least", [("op1_quality_classifier", "quality", 0.97), ("op9_toxicity", "toxic", 0.93)])
def test_held_out_accuracy(spark, name, label, least):
    got = QUERIES[name](spark, DIR).join(spark.read.parquet(f"{DIR}/labels.parquet"), "doc_id").toPandas()
    assert (got.held_out == got.doc_id.map(held_out)).all()
    assert got.score.between(0, 1).all()
    test = got[got.held_out]
    assert (test.predicted == test[label]).mean() >= least
    # clean documents are left alone
    clean = test[test[label] == (label == "quality")]
    assert (clean.predicted == clean[label]).mean() >= 0.97


@pytest.mark.parametrize("operator", [quality.classify, toxicity.toxicity, lm_score.cross_entropy_difference])
def test_scores_of_odd_rows(spark, odd, labels, operator):
    got = operator(odd, labels).toPandas()
    assert sorted(got.doc_id.fillna(-1)) == [-1, 1, 2, 3, 3, 4] and got.score.notna().all()
    same = got[got.doc_id == 3]
    assert same.score.nunique() == 1
    assert operator(odd.limit(0), labels).count() == 0
    assert operator(odd, labels.limit(0)).count() == 6


def test_discriminant_is_the_gaussian_formula():
    rnd = np.random.default_rng(1)
    x = [rnd.normal(size=(200, 3)), rnd.normal(size=(300, 3)) * 2 + 1]
    model = quality.fit(np.array([200.0, 300.0]), np.array([a.sum(0) for a in x]), np.array([a.T @ a for a in x]), 0.0)
    points = rnd.normal(size=(20, 3))
    logs = []
    for a, n in zip(x, (200, 300), strict=True):
        cov = np.cov(a.T, bias=True)
        w = 3 / (3 + n)
        cov = (1 - w) * cov + w * np.trace(cov) / 3 * np.eye(3)
        d = points - a.mean(0)
        logs.append(np.log(n / 500) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d))
    assert model.scores(points) == pytest.approx(1 / (1 + np.exp(logs[0] - logs[1])))


def test_statistics_against_brute_force():
    import re

    texts = [None, "", "One two  two\n\nTHREE 3 a!\nOne two  two\n", "Ünï € <b>", " \n", "w" * 5000]
    for t in texts:
        raw = (t or "").encode()
        n, words, lines = len(raw), raw.split(), [x for x in raw.split(b"\n") if x]
        share = lambda k, of: np.log((k + 0.5) / (of + 20))
        kinds = [b"[A-Z]", b"[a-z]", b"[0-9]", rb"[.,;:'\"()\-?]", rb"[!#$%&*+/<=>@\[\\\]^_`{|}~]"]
        want = [np.log(len(words) + 1), np.log((n + 1) / (len(words) + 1)), *(share(len(re.findall(k, raw)), n) for k in kinds)]
        want += [share(n - len(t or ""), n), np.log((len(set(words)) + 1) / (len(words) ** 0.8 + 1)), share(sum(a == b for a, b in zip(words, words[1:], strict=False)), len(words))]
        want += [share(len(lines), len(words)), share(len(lines) - len(set(lines)), len(lines)), share(sum(w.isupper() for w in words), len(words)), share(sum(len(w) == 1 for w in words), len(words))]
        assert quality.statistics(t) == pytest.approx(want), t
    assert len(want) == len(quality.STATISTICS)


def test_rejected_rows(spark, odd, labels):
    scores = {r["doc_id"]: r["score"] for r in quality.classify(odd, labels).collect()}
    numbered = odd.withColumn("n", F.monotonically_increasing_id())
    out = {r["n"] for r in quality.rejected(numbered, labels, "n").collect()}
    assert {r["n"] for r in numbered.collect() if scores[r["doc_id"]] < 0.5} == out
    assert quality.rejected(numbered.limit(0), labels, "n").count() == 0


@pytest.mark.parametrize(
    "html, text",
    [
        (None, ""),
        ("", ""),
        ("plain words", "plain words"),
        ("<body><nav>menu</nav><article><h1>T</h1><p>One  <b>two</b>\n three &amp; &#233;<br>x<p>Short.</article><footer>f</footer>", "T\nOne two three & é x\nShort."),
        ("<article><p>a</p><div class='ad'>buy</div><form>f</form><script>s</script><p>b</p><aside>c</aside></article>", "a\nb"),
        ("<div class=ad>left open<article><p>real text</p></article>", "real text"),
        ("<article><p>t &am", "t &am"),
        ("<p>a<![foo[ x ]]>b<![>c<![CDATA[d]]>e<!x>f", "abcef"),
        ("<p>a<!-- x", "a"),
        ("<p>a<!-->b<!--->c<!-- <p>d --></p>e", "abc\ne"),
        ("<p>a<b class='x", "a"),
        ("<p>a</p", "a"),
        ("<p>a <? b", "a"),
        ("<p>1 < 2 & 3 > 2</p>", "1 < 2 & 3 > 2"),
        ("<p hidden>no</p><p>yes</p>", "yes"),
        ("<article><p>A</p><section id='comments'><p>reader</p></section></article>", "A"),
    ],
)
def test_extraction(html, text):
    assert "\n".join(html_extract.main_lines(html)) == text


def test_extraction_by_density_alone():
    menu = "".join(f"<div><a href='/{i}'>item {i}</a> <a href='/x'>y</a></div>" for i in range(12))
    body = "".join(f"<p>{'A long sentence of the article that goes on and on. ' * 4}{i}</p>" for i in range(6))
    got = html_extract.main_lines(f"<body><div>{menu}</div><div>{body}</div><div>{menu}</div></body>")
    assert len(got) == 6 and all(line.startswith("A long") for line in got)


PROSE = "".join(f"<p>{'A long sentence of the article that goes on and on. ' * 4}{i}</p>" for i in range(6))


def test_density_decides_on_pages_with_an_article():
    links = "".join(f"<a href='/{i}'>item {i}</a><br><a href='/x'>y</a><hr>" for i in range(12))
    got = html_extract.main_lines(f"<article><div>{links}</div>{PROSE}<p>Short.</p><table><tr><td>12<td>34</table></article>")
    assert [g for g in got if not g.startswith("A long")] == ["Short.", "12", "34"] and len(got) == 9
    # text beside an article that holds little is found as well
    assert len(html_extract.main_lines(f"<article><p>Read on for the whole story.</p></article><div>{PROSE}</div>")) >= 6


def test_a_long_block_hides_no_short_section():
    short = "<section><p>A section of some forty characters here.</p></section>"
    got = html_extract.main_lines(f"<body>{short}<div>{PROSE * 50}</div>{short}<section>Brief.</section></body>")
    assert len(got) == 303 and got[-1] == "Brief."


@pytest.mark.parametrize("page", ["<b>{}</i>", "<li><ul><b>{}<li></li>", "<svg>{}</iframe>", "<!--{}<!--", "<a {}<a ", "</p {}</p ", "<![{}<![x", "<div>{}</p>", "<p {}>x", "&{}&#"])
def test_extraction_takes_linear_time(page):
    import time

    left, right = page.split("{}")
    start = time.process_time()
    html_extract.main_lines(left * 40_000 + right * 40_000 + "<p>end")
    assert time.process_time() - start < 5


def test_extraction_of_odd_pages(spark):
    rows = [(1, "u", None, 1), (1, "u", None, 1), (None, None, "", 2), (3, "v", "<![x[ y ]]><p>a", 3), (4, "w", "<p>" + "long " * 200_000, 4)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int").withColumn("text", F.lit("clash"))
    got = sorted(((r["page_id"] or 0, r["url"], r["text"], r["n_chars"]) for r in html_extract.extract(pages).collect()), key=str)
    assert got == sorted([(1, "u", "", 0), (1, "u", "", 0), (0, None, "", 0), (3, "v", "a", 1), (4, "w", ("long " * 200_000).strip(), 999_999)], key=str)
    assert html_extract.extract(pages.limit(0)).count() == 0


@needs_tables
def test_pages_hold_their_article(spark):
    import html as h
    import re

    got = QUERIES["op2_html_extraction"](spark, DIR).join(spark.read.parquet(f"{DIR}/pages.parquet").select("page_id", "html"), "page_id").toPandas()
    assert len(got) == 250 and (got.n_chars == got.text.map(len)).all()
    for text, html in zip(got.text, got.html, strict=True):
        blocks = re.split(r"</?(?:p|h1)\b[^>]*>", re.search(r"(?s)<article>(.*)</article>", html).group(1))
        want = [re.sub(r"\s+", " ", h.unescape(re.sub(r"<[^>]+>", "", b))).strip() for b in blocks]
        assert text == "\n".join(filter(None, want))


@pytest.fixture(scope="module")
def restorer():
    words = ("idiot moron clown stupid search engine the and of with search clown idiot stupid " * 50).strip()
    points = lm_score.code_points(words)
    symbol_of = np.full(65537, 1)
    for i, c in enumerate(sorted(set(words)), 2):
        symbol_of[ord(c)] = i
    seq, _ = lm_score.symbols([words], symbol_of, 3)
    codes = lm_score.gram_codes(seq, 3, 64)[seq[2:] != 0]
    grams, counts = np.unique(codes, return_counts=True)
    assert len(points) == len(words)
    return toxicity.Restorer(symbol_of, lm_score.log_probabilities(grams, counts, 3, 64))


@pytest.mark.parametrize("hidden, word", [("1d10t", "idiot"), ("m0r0n", "moron"), ("cl-o-wn", "clown"), ("stuuuupid", "stupid"), ("$tup!d!!", "stupid"), ("the,", "the"), ("search", "search"), ("***", "")])
def test_restoring(restorer, hidden, word):
    assert restorer.restored(hidden) == word


def test_spaced_letters_are_joined(restorer):
    assert "idiot" in restorer.words("an I d i o t here") and "idiot" in restorer.words("so a i d i o t")
    assert restorer.words("a b") == ["a", "b"] and restorer.words(None) == []


def test_words_across_spaces(restorer):
    assert "idiot" in restorer.words("u r a i d i o t") and {"stupid", "idiot"} <= {w[:k] for w in restorer.words("s t u p i d i d i o t") for k in (5, 6)}
    assert "ass" in restorer.words("a s s") and "idiot" in restorer.words("id iot") and "stupid" in restorer.words("stu pid")


def best_by_trying_all(restorer, token):
    """The best original of a token over every path through its lattice."""
    import itertools

    edge, size, logs = restorer._symbol(" "), restorer.size, restorer.logs
    choices = []
    for i, c in enumerate(token):
        found = [(c, 0.0)] + [(x, -toxicity.ACT_COST) for x in toxicity.STANDS_FOR.get(c, "")]
        if c in toxicity.SEPARATORS or c == " " or i and token[i - 1] == c:
            found.append(("", -toxicity.ACT_COST / 2))
        choices.append(found)
    best = {}
    for path in itertools.product(*choices):
        text, cost, a, b = "".join(x for x, _ in path), sum(v for _, v in path), 0, 0
        for s in [*map(restorer._symbol, text), edge]:
            cost, a, b = cost + logs[(a * size + b) * size + s], b, s
        best[text] = max(best.get(text, -np.inf), cost)
    return best


@pytest.mark.parametrize("token", ["1d10t", "m0r0n", "cl-o-wn", "stuupid", "$tup!d!!", "id iot", "s t u", "1|1", "a--b", "zz0z", "the"])
def test_decoding_against_all_paths(restorer, token):
    every = best_by_trying_all(restorer, token)
    got = restorer.decode(token)
    assert every[got] == pytest.approx(max(every.values()), abs=1e-4)


def test_repeated_rows_teach_once(spark, labels):
    words = ["idiot moron", "clown stupid", "search engine", "the and of"]
    docs = [(i, f"{words[i % 2 if i % 2 == 0 else 2]} {i}") for i in range(60)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    once = {r["doc_id"]: r["score"] for r in toxicity.toxicity(table, labels).collect()}
    many = toxicity.toxicity(table.unionByName(table.where("doc_id = 4")), labels).collect()
    assert len(many) == 61 and all(r["score"] == pytest.approx(once[r["doc_id"]], abs=0.2) for r in many)


def test_long_tokens_are_decoded_to_their_end(restorer):
    assert restorer.restored("x" + "1d10t" * 200)[-500:] == "idiot" * 100
    assert restorer.restored("cl-o-wn" * 100)[-5:] == "clown"


def test_language_model_sums_to_one_and_scores_by_hand():
    size, order = 5, 2
    grams, counts = np.array([0 * 5 + 2, 2 * 5 + 3]), np.array([3, 1])
    p = np.exp(lm_score.log_probabilities(grams, counts, order, size, 1.0)).reshape(size, size)
    assert p.sum(axis=1) == pytest.approx(np.ones(size), abs=1e-5)
    unigram = (np.array([0, 0, 3, 1, 0]) + 0.2) / 5
    assert p[0] == pytest.approx((np.array([0, 0, 3, 0, 0]) + unigram) / 4, abs=1e-6)


def test_scores_follow_brute_force(spark):
    rows = [(1, "abab"), (2, "bbbb"), (3, "abba"), (6, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    good = spark.createDataFrame([(1, 1), (3, 1)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in lm_score.cross_entropy_difference(docs, good, order=2, size=4).collect()}
    chosen = [i for i in (1, 3) if not held_out(i)]
    symbol = {"\0": 0, "b": 2, "a": 3}

    def model(texts):
        two = np.zeros((4, 4))
        for t in texts:
            for x, y in zip("\0" + t, t, strict=False):
                two[symbol[x], symbol[y]] += 1
        one = two.sum(axis=0)
        k = lm_score.SMOOTHING
        uni = (one + k / 4) / (one.sum() + k)
        return np.log((two + k * uni) / (two.sum(axis=1, keepdims=True) + k))

    target, background = model([t for i, t in rows if i in chosen]), model([t for _, t in rows])
    for i, t in rows:
        loss = [-sum(m[symbol[x], symbol[y]] for x, y in zip("\0" + t, t, strict=False)) / max(1, len(t)) for m in (target, background)]
        assert (got[i]["target_loss"], got[i]["background_loss"], got[i]["score"]) == pytest.approx((*loss, loss[1] - loss[0]), abs=1e-4)


def test_every_good_document_is_a_target(spark):
    # more good documents than once were counted; those last by the hash of their ids hold the only b
    rank = Window.orderBy(F.xxhash64("id"), "id")
    ids = spark.range(33_000).where("crc32(cast(cast(id as string) as binary)) % 3 != 1")
    docs = ids.select(F.col("id").alias("doc_id"), F.when(F.row_number().over(rank) > 20_000, "b").otherwise("a").alias("text"))
    b = docs.where("text = 'b'").count()
    got = lm_score.cross_entropy_difference(docs, docs.select("doc_id", F.lit(1).alias("quality")), order=2, size=4)
    loss = got.join(docs.where("text = 'b'"), "doc_id").agg(F.min("target_loss"), F.max("target_loss")).first()
    assert b > 1000 and list(loss) == pytest.approx([-np.log(b / (b + 20_000))] * 2, abs=1e-2)


def test_no_character_is_left_out_of_the_models(spark):
    # more characters than once were told apart, some of them above the basic plane, rare scripts among Latin
    latin = "".join(map(chr, range(97, 123))) + "0123456789.,;:!?()-+*/=%&$#@<>[]{}"
    rows = [(i, latin * 3) for i in range(20)] + [(101, "жизнь"), (102, "ничто"), (103, "\U0001d538\U0001d539"), (104, "\U0001d539\U0001d538"), (105, "жизнь")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    good = spark.createDataFrame([(i, 1) for i, _ in rows], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in lm_score.cross_entropy_difference(docs, good, block=200).collect()}
    assert len(got) == len(rows) and got[101]["background_loss"] < got[102]["background_loss"]
    assert got[101]["score"] == got[105]["score"]
    # the same against brute force, with blocks of one document and more
    chosen, order, k = {i for i, _ in rows if not held_out(i)}, lm_score.ORDER, lm_score.SMOOTHING
    size = len(set("".join(t for _, t in rows).lower())) + 2
    grams = {i: ["".join(p) for p in zip(*(("\0" * 3 + t)[n:] for n in range(order)), strict=False)] for i, t in rows}
    sides = []
    for ids in (chosen, set(grams)):
        seen = [Counter(g[order - n :] for i in ids for g in grams[i]) for n in range(1, order + 1)]
        before = [Counter(g[order - n : -1] for i in ids for g in grams[i]) for n in range(1, order + 1)]

        def p(g, n=order, seen=seen, before=before):
            g = g[-n:]
            return (seen[n - 1][g] + k * (p(g, n - 1) if n > 1 else 1 / size)) / (before[n - 1][g[:-1]] + k)

        sides.append({i: -np.mean([np.log(p(g)) for g in gs]) for i, gs in grams.items()})
    for i, _ in rows:
        assert (got[i]["target_loss"], got[i]["background_loss"]) == pytest.approx((sides[0][i], sides[1][i]), abs=1e-9)


SCHEMA = {"add": {"type": "object", "properties": {"a": {"type": "integer", "minimum": 0}, "tags": {"type": "array", "items": {"type": "string"}}}, "required": ["a"], "additionalProperties": False}}
MESSAGES = "conv_id long, turn long, role string, text string, call_id string, name string, depends_on array<string>, line string"


def test_chat_links(spark):
    rows = [
        (1, 0, "user", "hi", None, None, None, "clash"),
        (1, 1, "assistant", '{"tags":["x"],"a":1}', "c1", "add", None, ""),
        (1, 2, "tool", "2", "c1", None, None, ""),
        (1, 3, "assistant", '{"a":-1,"b":2}', "c2", "add", ["c1"], ""),
        (1, 4, "assistant", "not json", "c3", "add", ["c2", "gone"], ""),
        (1, 5, "tool", None, "zz", None, None, ""),
        (2, 0, "assistant", '{"a":1}', "c1", "add", ["c9"], ""),
        (2, 1, "assistant", '{"a":1}', "c9", "add", ["c1"], ""),
        (2, 2, "assistant", '{"a":1}', "c5", "other", None, ""),
        (None, None, None, None, None, None, None, ""),
    ]
    got = {(r["conv_id"], r["turn"]): r for r in chat.link_tool_calls(spark.createDataFrame(rows, MESSAGES), SCHEMA).collect()}
    assert len(got) == len(rows)
    status = {k: (v["kind"], v["status"], v["level"]) for k, v in got.items()}
    assert status[1, 1] == ("call", "linked", 0) and status[1, 2] == ("result", "linked", 0)
    assert status[1, 3] == ("call", "invalid", 1) and status[1, 4] == ("call", "invalid", 2) and status[1, 5][1] == "orphan"
    assert status[2, 0][1] == "cycle" and status[2, 1][1] == "cycle" and status[2, 2][1] == "invalid" and status[None, None][0] == "message"
    assert got[1, 1]["line"] == '{"role":"assistant","tool_call":{"arguments":{"a":1,"tags":["x"]},"id":"c1","name":"add"}}'
    assert "too small" in got[1, 3]["line"] and "b is not allowed" in got[1, 3]["line"]
    assert chat.link_tool_calls(spark.createDataFrame([], MESSAGES), SCHEMA).count() == 0


def call(conv, i, needs=(), text='{"a":1}', name="add"):
    return (conv, 0, "assistant", text, i, name, list(needs), "")


def test_chat_nulls_depth_and_surrogates(spark):
    deep = "[" * 100_000 + "]" * 100_000
    rows = [
        call(None, "c1"), (None, 1, "tool", "r", "c1", None, None, ""), call(3, None), (3, 1, "tool", "r", None, None, None, ""),
        call(4, "deep", text=deep), call(4, "half", text='{"a":1,"tags":["\\ud800"]}'), call(4, "nan", text='{"a":NaN}'), call(4, "inf", text='{"a":1e999}'),
        call(4, "twin"), call(4, "twin"), (4, 9, None, None, None, None, None, ""),
    ]
    got = chat.link_tool_calls(spark.createDataFrame(rows, MESSAGES), SCHEMA).collect()
    assert len(got) == len(rows)
    state = {(r["conv_id"], r["call_id"], r["kind"]): (r["status"], r["level"]) for r in got}
    assert state[None, "c1", "call"] == ("linked", 0) and state[None, "c1", "result"] == ("linked", 0)
    assert state[3, None, "call"] == ("open", 0) and state[3, None, "result"] == ("orphan", None)
    assert {i: state[4, i, "call"][0] for i in ("deep", "half", "nan", "inf", "twin")} == {"deep": "invalid", "half": "open", "nan": "invalid", "inf": "invalid", "twin": "open"}
    lines = {r["call_id"]: json.loads(r["line"]) for r in got if r["conv_id"] == 4 and r["kind"] == "call"}
    assert lines["deep"]["tool_call"]["arguments"] == deep and lines["half"]["tool_call"]["arguments"]["tags"] == ["\ud800"]


def test_chat_levels_against_brute_force(spark):
    rnd = random.Random(9)
    needs = {"n0": []}
    for i in range(1, 60):
        needs[f"n{i}"] = rnd.sample(sorted(needs), min(len(needs), rnd.choice([0, 1, 1, 1, 2, 3]))) + rnd.choice([[], ["gone"]])
    needs |= {f"k{i}": [f"k{i - 1}"] if i else ["n5"] for i in range(40)}  # a long chain
    needs |= {"x": ["y"], "y": ["x"], "above": ["x", "n1"], "higher": ["above"], "self": ["self"], "tail": ["x"], "both": ["tail", "n2"]}

    def level(i, path=()):
        found = [level(j, (*path, i)) for j in needs[i] if j in needs] if i not in path else [None]
        return None if None in found else max((f + 1 for f in found), default=0)

    got = chat.link_tool_calls(spark.createDataFrame([call(1, i, n) for i, n in needs.items()], MESSAGES), SCHEMA).collect()
    assert {r["call_id"]: r["level"] for r in got} == {i: level(i) for i in needs}
    assert {r["call_id"] for r in got if r["status"] == "cycle"} == {"x", "y", "above", "higher", "self", "tail", "both"}
    order = [(r["level"] is not None, r["level"]) for r in got]
    assert order == sorted(order)


@needs_tables
def test_chat_query_against_brute_force(spark):
    turns = {(r["conv_id"], r["turn"]): r for r in spark.read.parquet(f"{DIR}/conversations.parquet").collect()}
    got = QUERIES["op7_chat_formatting"](spark, DIR).collect()
    assert len(got) == len(turns)
    asked = {k for k, r in turns.items() if r["role"] == "user"}

    def level(conv, turn):
        before = next(((conv, turn - n) for n in (1, 2) if (conv, turn - n) in asked), None)
        return level(*before) + 1 if before else 0

    for r in got:
        at = r["conv_id"], r["turn"]
        own = turns[at]
        before, after = at[0], at[1] - 1
        answered = turns.get((at[0], at[1] + 1))
        line = json.loads(r["line"])
        if own["role"] == "user":
            want = "invalid" if not own["text"] else "linked" if answered and answered["role"] == "assistant" else "open"
            assert line["tool_call"]["arguments"] == {"prompt": own["text"]} and r["level"] == level(*at)
        elif own["role"] == "assistant":
            want = "linked" if (before, after) in asked else "orphan"
            assert r["level"] == (level(before, after) if want == "linked" else None)
        else:
            want = "message"
        assert r["status"] == want and r["line"] == chat.canonical(line)
    assert max(r["level"] or 0 for r in got) > 0
    order = [(r["conv_id"], -1 if r["level"] is None else r["level"], r["turn"]) for r in got]
    assert order == sorted(order)
