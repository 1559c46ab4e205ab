import pytest

from termloom.functions import porter
from termloom.functions.analysis import AnalysisConfig, analyze, analyzed_terms
from termloom.functions.stopwords import ENGLISH

RAW = AnalysisConfig("none", "none")


def words(text, config=RAW):
    return [t.term for t in analyze(text, config)]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("Hello, World! Search-Engine 2026.", ["hello", "world", "search", "engine", "2026"]),
        ("don't stop", ["dont", "stop"]),
        ("state-of-the-art", ["state", "of", "the", "art"]),
        ("Ｈｅｌｌｏ", ["hello"]),
        ("... --- !!!", []),
        ("", []),
    ],
)
def test_tokens(text, expected):
    assert words(text) == expected


def test_positions_are_dense_and_offsets_point_into_the_text():
    found = analyze("the quick brown fox", AnalysisConfig(stemming="none"))
    assert [(t.term, t.position) for t in found] == [("quick", 0), ("brown", 1), ("fox", 2)]
    assert all("the quick brown fox"[t.start : t.end] == t.term for t in found)


@pytest.mark.parametrize(
    "word, stem",
    [
        ("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("happy", "happi"), ("triplicate", "triplic"), ("revival", "reviv"),
        ("agreement", "agreement"), ("darcy", "darci"), ("holmes", "holm"), ("learning", "learn"), ("learned", "learn"), ("learns", "learn"),
        ("relational", "relat"), ("conditional", "condit"), ("possibly", "possibl"), ("hopping", "hop"), ("filing", "file"), ("falling", "fall"),
        ("controll", "control"), ("by", "by"), ("feed", "feed"), ("agreed", "agre"), ("plastered", "plaster"), ("sky", "sky"), ("adoption", "adopt"),
        ("generalizations", "gener"), ("oscillators", "oscil"), ("archaeology", "archaeolog"), ("rate", "rate"), ("cease", "ceas"),
    ],
)
def test_porter(word, stem):
    assert porter.stem(word) == stem


def test_stopwords_are_normalised():
    assert "cant" in ENGLISH and "shell" in ENGLISH and "can't" not in ENGLISH
    assert len(ENGLISH) == 173


@pytest.mark.parametrize("config", [AnalysisConfig(), RAW, AnalysisConfig(stemming="none", nfkc=False)])
def test_columns_agree_with_the_driver(spark, config):
    texts = ["The quick-brown foxes' dens, can't", None, "", "Été à l'école ... naïve 123", "a the of", "machine learning machines learn"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    from pyspark.sql import functions as F

    got = {r["doc_id"]: r["w"] for r in df.select("doc_id", analyzed_terms(F.col("text"), config).alias("w")).collect()}
    assert got == {i: words(t or "", config) for i, t in enumerate(texts)}


def test_bad_config():
    with pytest.raises(ValueError):
        AnalysisConfig(stemming="snowball")
