"""Text analysis: runs of letters and digits, normalisation, stop-words, stemming.

The same rules exist twice: :func:`analyze` and :func:`terms_of` for strings and for the texts of
an index, and :func:`analyzed_terms` for columns. Without stemming, and for text that NFKC leaves alone,
the column form stays in the JVM; else one Arrow function maps each document's runs, with a
store of surface forms per worker, so tokens are not shuffled to be normalised.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.functions import porter
from termloom.functions.stopwords import ENGLISH

#: A run of letters and digits, with inner apostrophes. Fixed value: the token pattern.
RUN_PATTERN = r"[\p{L}\p{N}]+(?:['’][\p{L}\p{N}]+)*"
_RUN = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_STRIP = re.compile(r"[\W_]+")
#: Bytes of texts that a worker analyses at once.
BLOCK_BYTES = 8 << 20


@dataclass(frozen=True)
class AnalysisConfig:
    """How text becomes terms; an index keeps the one it was built with."""

    stopwords: str = "english"
    stemming: str = "porter"
    nfkc: bool = True
    version: int = 1

    def __post_init__(self) -> None:
        if self.stopwords not in ("english", "none") or self.stemming not in ("porter", "none"):
            raise ValueError(f"unknown analysis: {self}")

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)


@dataclass(frozen=True)
class Token:
    term: str
    position: int
    start: int
    end: int


def runs(text: str) -> list[tuple[str, int, int]]:
    return [(m.group(), m.start(), m.end()) for m in _RUN.finditer(text)]


@lru_cache(maxsize=1 << 18)
def term_of(run: str, config: AnalysisConfig) -> str | None:
    """The term of one run, or None for a stop-word or nothing."""
    word = _STRIP.sub("", (unicodedata.normalize("NFKC", run) if config.nfkc else run).lower())
    if not word or config.stopwords == "english" and word in ENGLISH:
        return None
    return porter.stem(word) if config.stemming == "porter" else word


def only_runs(text: str) -> list[str]:
    return _RUN.findall(text)


def terms_of(words: list[str], config: AnalysisConfig) -> list[str | None]:
    """:func:`term_of` of many runs, each given once."""
    if config.nfkc or config.stemming != "none":
        return [term_of(w, config) for w in words]
    lower = [w.lower() for w in words]
    lower = [w if w.isalnum() else _STRIP.sub("", w) for w in lower]
    stop = ENGLISH if config.stopwords == "english" else frozenset()
    return [w if w and w not in stop else None for w in lower]


def text_blocks(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with texts of at most BLOCK_BYTES together, or one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(int(np.searchsorted(ends, before + BLOCK_BYTES, side="right")), start + 1)
        yield batch.slice(start, stop - start)
        start = stop


def analyze(text: str, config: AnalysisConfig) -> list[Token]:
    """Tokens with dense positions: what is dropped takes none."""
    out: list[Token] = []
    for run, start, end in runs(text):
        term = term_of(run, config)
        if term is not None:
            out.append(Token(term, len(out), start, end))
    return out


def analyzed_terms(text: Column, config: AnalysisConfig) -> Column:
    """array<string>: the emitted terms of a text column in order."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(RUN_PATTERN), F.lit(0))
    if config.stemming == "none" and not config.nfkc:
        words = F.split(F.regexp_replace(F.lower(F.array_join(found, " ")), r"[^\p{L}\p{N} ]+", ""), " ")
        if config.stopwords == "english":
            stop = sorted(ENGLISH)
            return F.filter(words, lambda w: (w != "") & ~w.isin(stop))
        return F.filter(words, lambda w: w != "")

    @F.pandas_udf("array<string>")
    def terms(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, str | None] = {}
        for batch in batches:
            out = []
            for words in batch:
                kept = []
                for w in words:
                    if w not in known:
                        if len(known) > 500_000:
                            known.clear()
                        known[w] = term_of(w, config)
                    if known[w] is not None:
                        kept.append(known[w])
                out.append(kept)
            yield pd.Series(out)

    return terms(found)


def tokens(docs: DataFrame, config: AnalysisConfig, text: str = "text") -> DataFrame:
    """(doc_id, position, term) of every emitted token."""
    return docs.select("doc_id", F.posexplode(analyzed_terms(F.col(text), config)).alias("position", "term"))
