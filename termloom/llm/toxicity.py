"""Toxicity scores over text restored by a noisy-channel decoder.

Writers hide words: digits and signs for letters, letters spaced or dotted apart, letters
repeated. A token with such traces spans a lattice of what its characters may stand for, and
a Viterbi search finds the most likely original under a character trigram model counted over
all documents, with a cost for each act of the channel. Other tokens have a single path
through their lattice and stand for themselves, so the whole text is restored but only the
doubtful tokens are searched; each worker keeps what it has decoded. Spaces are in the
lattice as well: each may be kept or dropped, and the words of the best path are scored
beside the tokens; runs of pieces of one or two letters are searched as one stretch.

The scorer is learned from labelled rows outside the held-out fold (at most
``TRAINING_ROWS`` ids, the first by a hash of them, with one text each): words and word beginnings with the
highest smoothed log odds of toxic documents form the lexicon, and a logistic regression
over the strongest matches of a document gives its score.

Defined cases: null and empty texts score as texts without matches; labels with null ids or
values teach nothing; with one class only, every score is the smoothed share of label 1;
repeated rows get a row each; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import groupby
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm import lm_score
from termloom.llm.common import held_out, short

THRESHOLD = 0.7
TRAINING_ROWS = 20_000
LEXICON = 4_000
KNOWN_TOKENS = 400_000
LM_ORDER, LM_SIZE = 3, 64
PREFIXES = (4, 5, 6, 7)
LEAST_TOXIC, LEAST_ODDS = 4, 1.5
#: Letters looked at from each letter of a spelled run; features end at the longest of PREFIXES.
SPELLED = 24

#: Letters that a digit or sign stands for.
STANDS_FOR = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i",
}
#: Signs that may be put between letters.
SEPARATORS = ".-_*~'’`^,:;/\\"
ACT_COST = 1.0
_EDGES = re.compile(r"^(?:[^\w$@!]|!(?!\w))+|[^\w]+$")
_TRIPLE = re.compile(r"([^\W\d_])\1\1")


class Gaps(dict):
    """Whether the best path drops the space between two tokens of two letters or more, by the
    last two letters of one and the first two of the other: those fix the states on both
    sides, so each such space is decided by itself."""

    def __init__(self, restorer: Restorer):
        self.restorer = restorer

    def __missing__(self, ends: str) -> bool:
        if len(self) >= KNOWN_TOKENS:
            self.clear()
        self[ends] = dropped = len(ends) == 4 and ends.isalpha() and self.restorer.drops_space(ends)
        return dropped


class Restorer:
    """Decodes lower-case tokens under a trigram model given as log probabilities."""

    def __init__(self, symbol_of: np.ndarray, logs: np.ndarray, size: int = LM_SIZE):
        self.symbol_of, self.logs, self.size = symbol_of, logs.tolist(), size
        self.gaps = Gaps(self)
        self.runs: dict[str, list[str]] = {}

    def _symbol(self, c: str) -> int:
        return int(self.symbol_of[min(ord(c), 1 << 16)])

    def doubtful(self, core: str) -> bool:
        return not core.isalpha() and any(map(str.isalpha, core)) or _TRIPLE.search(core) is not None

    def decode(self, token: str) -> str:
        """The most likely original of a token."""
        logs, size = self.logs, self.size
        paths: dict[tuple[int, int, str], tuple[float, str]] = {(0, 0, ""): (0.0, "")}
        settled: list[str] = []
        for i, c in enumerate(token):
            if i % 256 == 255:
                # what all paths begin with is decided; long tokens are decoded as a stream
                begun = os.path.commonprefix([t for _, t in paths.values()])
                settled.append(begun)
                paths = {k: (v, t[len(begun) :]) for k, (v, t) in paths.items()}
            again = i > 0 and token[i - 1] == c
            choices: list[tuple[str, float]] = [(c, 0.0)]
            choices += [(letter, -ACT_COST) for letter in STANDS_FOR.get(c, "")]
            if c in SEPARATORS or c == " " or again:
                choices.append(("", -ACT_COST / 2))
            step: dict[tuple[int, int, str], tuple[float, str]] = {}
            for (a, b, last), (so_far, text) in paths.items():
                for letter, cost in choices:
                    if letter:
                        s = self._symbol(letter)
                        key, value = (b, s, letter), so_far + cost + logs[(a * size + b) * size + s]
                        grown = text + letter
                    else:
                        key, value, grown = (a, b, last), so_far + cost, text
                    if key not in step or step[key][0] < value:
                        step[key] = (value, grown)
            paths = step
        # a space ends the word: words that stop where words stop are likelier
        space = self._symbol(" ")
        return "".join(settled) + max((v + logs[(a * size + b) * size + space], t) for (a, b, _), (v, t) in paths.items())[1]

    def restored(self, token: str) -> str:
        core = token if token.isalpha() else _EDGES.sub("", token)
        return self.decode(core) if self.doubtful(core) else core

    def words(self, text: str | None) -> list[str]:
        """The restored tokens of a whole text, and the words found across its spaces."""
        tokens = (text or "").lower().split()
        return tokens + self.across(tokens)

    def drops_space(self, ends: str) -> bool:
        a, b, c, d = map(self._symbol, ends)
        space, logs, n = self._symbol(" "), self.logs, self.size
        kept = logs[(a * n + b) * n + space] + logs[(b * n + space) * n + c] + logs[(space * n + c) * n + d]
        return logs[(a * n + b) * n + c] + logs[(b * n + c) * n + d] - ACT_COST / 2 > kept

    def across(self, tokens: list[str]) -> list[str]:
        """Words that spaces break: every space of the text may be kept or dropped."""
        out: list[str] = []
        gaps = self.gaps
        heads, tails = [t[:2] for t in tokens], [t[-2:] for t in tokens]
        joins = [gaps[e] for e in map(add, tails, heads[1:])]
        if True in joins:
            word = ""
            for i in [i for i, j in enumerate(joins) if j]:
                word = word or tokens[i]
                word += tokens[i + 1]
                if i + 1 == len(joins) or not joins[i + 1]:
                    out.append(word)
                    word = ""
        sizes = list(map(len, tokens))
        if 1 in sizes:
            at = 0
            for short, run in groupby(sizes, (2).__ge__):
                n = len(list(run))
                if short and n >= 3:
                    out += self.spelled(tokens[at : at + n])
                at += n
        return out

    def spelled(self, pieces: list[str]) -> list[str]:
        """Words in a run of pieces of one or two letters: those of the best path, and, as a run
        spelled letter by letter does not tell where words begin, what begins at each letter."""
        sizes = list(map(len, pieces))
        if 1 not in sizes:
            return []
        run = " ".join(pieces)
        if run not in self.runs:
            if len(self.runs) >= KNOWN_TOKENS // 10:
                self.runs.clear()
            found = [w for w in self.decode(run).split() if w not in pieces]
            at = 0
            for single, part in groupby(sizes, (1).__eq__):
                n = len(list(part))
                if single and n >= 3:
                    letters = "".join(pieces[at : at + n])
                    found += [letters[i : i + k] for i in range(n - 2) for k in (3, SPELLED) if k == 3 or i + 3 < n]
                    found.append(letters)
                at += n
            self.runs[run] = list(dict.fromkeys(found))
        return self.runs[run]


def features(word: str) -> list[str]:
    return ["=" + word] + ["^" + word[:k] for k in PREFIXES if len(word) > k]


class Weigher(dict):
    """Token to its lexicon weight; tokens not met yet are restored and looked up."""

    def __init__(self, restorer: Restorer, lexicon: dict[str, float]):
        self.restorer, self.lexicon = restorer, lexicon

    def __missing__(self, token: str) -> float:
        word = self.restorer.restored(token)
        # the strongest of features(word)
        get, n = self.lexicon.get, len(word)
        weight = get("=" + word, 0.0)
        for k in PREFIXES:
            if n <= k:
                break
            weight = max(weight, get("^" + word[:k], 0.0))
        if weight == 0.0 and len(word) > 5 and not word.isalpha() and any(c in word for c in "/|"):
            weight = max((self[p] for p in re.split(r"[/|]+", word) if p and p != token), default=0.0)
        if len(self) >= KNOWN_TOKENS:
            self.clear()
        self[token] = weight
        return weight

    def vector(self, text: str | None) -> list[float]:
        words = self.restorer.words(text)
        found = [w for w in map(self.__getitem__, words) if w > 0.0]
        top = sorted(found, reverse=True)[:3]
        top += [0.0] * (3 - len(top))
        return [*top, np.log1p(len(found)), float(np.log1p(sum(found))), len(found) / np.sqrt(len(words) + 1.0), np.log1p(len(words))]


def choose_lexicon(counts: dict[str, tuple[int, int]], toxic: int, clean: int) -> dict[str, float]:
    """Features with the highest smoothed log odds; ``counts`` has (toxic, clean) documents."""
    scored = []
    for f, (t, c) in counts.items():
        odds = np.log((t + 0.5) / (toxic + 1)) - np.log((c + 0.5) / (clean + 1)) - 1.0 / np.sqrt(t)
        if t >= LEAST_TOXIC and odds >= LEAST_ODDS:
            scored.append((float(odds), f))
    return {f: w for w, f in sorted(scored, reverse=True)[:LEXICON]}


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ridge logistic regression by Newton steps on standardised columns: mean, scale, weights."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.c_[np.ones(len(x)), (x - mean) / scale]
    w = np.zeros(z.shape[1])
    penalty = np.r_[1e-6, np.full(z.shape[1] - 1, ridge)]
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


def logistic_scores(model: tuple[np.ndarray, np.ndarray, np.ndarray], x: np.ndarray) -> np.ndarray:
    mean, scale, w = model
    return 1 / (1 + np.exp(-np.clip(w[0] + ((x - mean) / scale) @ w[1:], -700, 700)))


_weighers: dict[str, Weigher] = {}


def toxicity(docs: DataFrame, labels: DataFrame, training_rows: int = TRAINING_ROWS) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", "text")
    symbol_of = lm_score.vocabulary(docs, LM_SIZE)
    counts = lm_score.count_grams(docs.withColumn("chosen", F.lit(False)), symbol_of, LM_ORDER, LM_SIZE).toArrow()
    logs = lm_score.log_probabilities(counts.column("gram").to_numpy(), counts.column("background").to_numpy(), LM_ORDER, LM_SIZE)
    shared = spark.sparkContext.broadcast((symbol_of, logs.astype(np.float32)))

    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    taught = docs.join(F.broadcast(usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(training_rows)), "doc_id")
    # one text of each id, so that rows that repeat an id don't add to the bounded sample
    taught = taught.groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(*shared.value)
        known: dict[str, list[str]] = {}
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in short(batches):
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found: set[str] = set()
                for token in set(restorer.words(text)):
                    if token not in known:
                        known[token] = features(restorer.restored(token))
                    found.update(known[token])
                seen[toxic].update(found)
                seen[toxic]["#"] += 1
        names = list(seen[0].keys() | seen[1].keys())
        columns = [pa.array(names, pa.string()), *(pa.array([s[f] for f in names], pa.int64()) for s in (seen[1], seen[0]))]
        yield pa.RecordBatch.from_arrays(columns, names=["feature", "toxic", "clean"])

    met = taught.select("text", "toxic").mapInArrow(count, "feature string, toxic long, clean long")
    met = met.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    # the bounded training rows bound this list; most features are in too few toxic documents to stay
    rows = met.where((F.col("toxic") >= LEAST_TOXIC) & (F.col("toxic") > 0) | (F.col("feature") == "#")).collect()
    found = {r["feature"]: (r["toxic"], r["clean"]) for r in rows}
    toxic, clean = found.pop("#", (0, 0))
    constant = (toxic + 1) / (toxic + clean + 2) if min(toxic, clean) < 2 else None
    lexicon = choose_lexicon(found, toxic, clean)
    key = uuid.uuid4().hex

    def weigher() -> Weigher:
        if key not in _weighers:
            _weighers.clear()
            _weighers[key] = Weigher(Restorer(*shared.value), lexicon)
        return _weighers[key]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vector = weigher().vector
        for batch in short(batches):
            x = pa.array([vector(t) for t in batch.column(0).to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([x, batch.column(1)], names=["x", "toxic"])

    model = None
    if constant is None:
        sample = taught.select("text", F.col("toxic").cast("long").alias("toxic")).mapInArrow(measure, "x array<double>, toxic long").toArrow()
        model = logistic(np.array(sample.column("x").to_pylist()), sample.column("toxic").to_numpy().astype(float))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vector = weigher().vector
        for batch in short(batches):
            texts = batch.column(1).to_pylist()
            scores = np.full(len(texts), constant) if model is None else logistic_scores(model, np.array([vector(t) for t in texts]).reshape(len(texts), -1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], names=["doc_id", "score"])

    scored = docs.mapInArrow(score, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
