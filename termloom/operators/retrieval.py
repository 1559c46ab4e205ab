"""Boolean and positional retrieval: a query tree becomes one expression per document."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.operators.index import Index
from termloom.plans.query import Node, leaf_terms


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select("doc_id"), "doc_id", "left_semi").distinct()


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("doc_id").unionByName(b.select("doc_id")).distinct()


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select("doc_id"), "doc_id", "left_anti").distinct()


def universe(index: Index) -> DataFrame:
    return index.docs.select("doc_id")


def phrase_here(positions: list[Column]) -> Column:
    """Whether position arrays, one per slot of the phrase, hold p, p + 1, ... for some p."""
    first, *rest = positions
    if not rest:
        return first.isNotNull()
    present = reduce(lambda a, b: a & b, [p.isNotNull() for p in positions])

    def follows(p: Column) -> Column:
        return reduce(lambda a, b: a & b, [F.array_contains(q, p + i) for i, q in enumerate(rest, 1)])

    # the array search is only evaluated where all words are present
    return F.when(present, F.exists(first, follows)).otherwise(F.lit(False))


def least_window(positions: list[Column]) -> Column:
    """Length of the smallest stretch that holds every term; null where one is absent.

    The events of all terms are merged in order and folded with each term's last position."""
    n = len(positions)

    def marked(p: Column, t: int) -> Column:
        return F.transform(p, lambda x: F.struct(x.alias("at"), F.lit(t).alias("t")))

    events = F.flatten(F.array(*[marked(p, t) for t, p in enumerate(positions)]))
    start = F.struct(F.array_repeat(F.lit(-1), n).alias("last"), F.lit(None).cast("int").alias("best"))

    def step(state: Column, e: Column) -> Column:
        last = F.transform(state["last"], lambda x, i: F.when(i == e["t"], e["at"]).otherwise(x))
        low = F.array_min(last)
        span = F.when(low >= 0, e["at"] - low + 1)
        return F.struct(last.alias("last"), F.least(state["best"], span).alias("best"))

    return F.aggregate(F.array_sort(events), start, step, lambda s: s["best"])


def proximity(window: Column, n_terms: int, k: float = 1.0) -> Column:
    """k / (1 + window - number of terms); 0 without a window or with fewer than two terms."""
    if n_terms < 2:
        return F.lit(0.0)
    return F.coalesce(F.lit(float(k)) / (F.lit(1.0) + window - F.lit(float(n_terms))), F.lit(0.0))


def matches_nothing(node: Node) -> bool:
    """Whether the tree holds for a document with none of its terms."""
    if node.kind == "not":
        return not matches_nothing(node.children[0])
    if node.kind == "and":
        return all(map(matches_nothing, node.children))
    if node.kind == "or":
        return any(map(matches_nothing, node.children))
    return False


def condition(node: Node, has: dict[str, Column], at: dict[str, Column]) -> Column:
    """The tree as a two-valued expression over term flags and position arrays."""
    if node.kind == "and":
        return condition(node.children[0], has, at) & condition(node.children[1], has, at)
    if node.kind == "or":
        return condition(node.children[0], has, at) | condition(node.children[1], has, at)
    if node.kind == "not":
        return ~condition(node.children[0], has, at)
    if not node.words:
        return F.lit(False)
    if node.kind == "phrase" and len(node.words) > 1:
        return phrase_here([at[w] for w in node.words])
    return reduce(lambda a, b: a | b, [has[w] for w in node.words])


def gathered(index: Index, terms: list[str], with_universe: bool) -> tuple[DataFrame, dict[str, str]]:
    """One row per document with any of the terms (or every document): tf and positions per term.

    Only the postings of the listed terms are scanned; returns the row's column suffix by term."""
    names = {t: str(i) for i, t in enumerate(terms)}
    met = index.postings.where(F.col("term").isin(terms)) if terms else index.postings.where(F.lit(False))
    pick = lambda t, c: F.max(F.when(F.col("term") == t, F.col(c)))
    found = [pick(t, "tf").alias(f"tf_{i}") for t, i in names.items()]
    # arrays have no maximum in a hash aggregate: the one non-null row is taken
    found += [F.first(F.when(F.col("term") == t, F.col("positions")), ignorenulls=True).alias(f"at_{i}") for t, i in names.items()]
    rows = met.groupBy("doc_id").agg(*found) if found else met.select("doc_id").distinct()
    joined = index.docs.join(rows, "doc_id", "left" if with_universe else "inner")
    return joined, names


def candidates(index: Index, tree: Node) -> DataFrame:
    """Documents that satisfy an analysed tree, with tf_i and at_i per term, dl and max_tf."""
    rows, names = gathered(index, leaf_terms(tree), matches_nothing(tree))
    has = {t: F.col(f"tf_{i}").isNotNull() for t, i in names.items()}
    at = {t: F.col(f"at_{i}") for t, i in names.items()}
    return rows.where(condition(tree, has, at))


def boolean_search(index: Index, tree: Node) -> DataFrame:
    return candidates(index, tree).select("doc_id")


def phrase_search(index: Index, words: list[str]) -> DataFrame:
    """Documents that hold the words in a row."""
    return boolean_search(index, Node("phrase", words=tuple(words)))


def window_search(index: Index, words: list[str]) -> DataFrame:
    """(doc_id, window) of documents that hold all of the words."""
    terms = list(dict.fromkeys(words))
    rows, names = gathered(index, terms, False)
    window = least_window([F.col(f"at_{names[t]}") for t in terms])
    return rows.select("doc_id", window.alias("window")).where("window is not null")
