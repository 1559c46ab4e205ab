"""Encoding with tokenizer files of the ``tokenizers`` library, each distinct word once.

Both supported layouts cut a text into pieces that are encoded on their own, and no piece
crosses the places where texts are split into units here, so encoding the units one by one
gives the ids of the whole text. A batch's units are told apart by Arrow; workers keep the
ids of units that they have met; the store is bounded and starts anew when full.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from termloom.llm.common import short

#: Units whose ids a worker keeps, some 60 MB.
CACHE_UNITS = 300_000
#: Units of more characters are encoded anew each time, so that the store stays small.
LONGEST_KEPT = 200
#: Marks that both layouts keep together as one piece after a word.
TAIL_MARKS = ".,;:!?*$%&#|"
#: White space beyond ASCII.
_WIDE_SPACE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: ASCII white space that isn't a single space or newline between words.
_UNEVEN = ("  ", " \n", "\n ", "\n\n", "\t", "\r", "\x0b", "\x0c")
#: Letters of Latin-1, and a run of them.
_LATIN = "".join(c for c in map(chr, range(256)) if c.isalpha())
_LATIN_WORD = f"^[{_LATIN}]+$"
#: Characters of text that are encoded at once; more of them share more words.
SLICE = 3_000_000
_loaded: dict[tuple[str, str], UnitEncoder] = {}


def _byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1
    characters stand for themselves and the others for U+0100 onwards, in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    spare = (b for b in range(256) if b not in own)
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(spare)}


def _uneven(text: str) -> bool:
    """Whether words are apart by anything but single spaces and newlines."""
    if not text or text[0] in " \n" or text[-1] in " \n" or any(x in text for x in _UNEVEN):
        return True
    return not text.isascii() and _WIDE_SPACE.search(text) is not None


class _Store(dict):
    """Word, or other unit, to its ids. ``lead`` is the space before every one, or nothing."""

    def __init__(self, tokenizer, code: str, lower: bool, lead: str, most: int):
        self.most = most
        self.tokenizer, self.tokenize = tokenizer, tokenizer.model.tokenize
        self.code, self.lower, self.lead, self.mark = code, lower, lead, lead.replace(" ", "\u0120")
        self.alphabet = _byte_alphabet()
        self.tails: dict[str, bytes] = {"": b""}

    def whole(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, unit: str) -> bytes:
        if unit.isalpha() and (unit.isascii() or max(unit) < "\u0100"):
            # a run of Latin-1 letters is one piece
            piece = unit.lower() if self.lower else unit
            if not piece.isascii():
                piece = piece.encode().decode("latin1").translate(self.alphabet)
            ids = array(self.code, [t.id for t in self.tokenize(self.mark + piece)]).tobytes()
        else:
            ids = self.whole(self.lead + unit)
        if len(unit) <= LONGEST_KEPT:
            self[unit] = ids
        return ids

    def tail(self, marks: str) -> bytes:
        """Ids of the marks after a word; they are another piece."""
        if marks not in self.tails:
            self.tails[marks] = self.whole(marks)
        return self.tails[marks]

    def bound(self) -> None:
        if len(self) + len(self.tails) > self.most:
            self.clear()
            self.tails = {"": b""}


class UnitEncoder:
    """Ids of texts under one tokenizer file, as arrays of unsigned integers.

    ``layout`` is "words" where the file drops white space, and "spaced" for byte-level
    files, where a word is one piece with the space before it."""

    def __init__(self, path: str, layout: str, most: int = CACHE_UNITS):
        if layout not in ("words", "spaced"):
            raise ValueError(f"unknown layout {layout}")
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.spaced = layout == "spaced"
        self.kind, code = (np.dtype("u2"), "H") if tokenizer.get_vocab_size() <= 1 << 16 else (np.dtype("u4"), "I")
        self.store = _Store(tokenizer, code, not self.spaced, " " if self.spaced else "", most)
        self.bare = _Store(tokenizer, code, not self.spaced, "", most)

    def _units(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, pa.Array, pa.Array, np.ndarray]:
        """Of the texts' units in a row: codes of words and of the marks after them, the words
        and marks of the codes, and the texts' ends. A unit that isn't Latin-1 letters and
        marks counts as a word of its own without marks."""
        if self.spaced:
            # a newline is a unit of its own, and the word after it has no space before it
            split = pc.split_pattern(pa.array([t.replace("\n", " \n ") for t in texts], pa.large_string()), " ")
        else:
            # the file lower-cases anyway; fewer words are to be told apart so
            split = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(texts, pa.large_string())))
        flat = split.flatten().dictionary_encode()
        codes, units = flat.indices.to_numpy(zero_copy_only=False), flat.dictionary
        words = pc.utf8_rtrim(units, TAIL_MARKS)
        plain = pc.match_substring_regex(words, _LATIN_WORD)
        words = pc.if_else(plain, words, units).dictionary_encode()
        tails = pc.if_else(plain, pc.utf8_ltrim(units, _LATIN), "").dictionary_encode()
        word_of, tail_of = (x.indices.to_numpy(zero_copy_only=False) for x in (words, tails))
        return word_of[codes], tail_of[codes], words.dictionary, tails.dictionary, split.offsets.to_numpy()

    def _even(self, texts: list[str]) -> list[np.ndarray]:
        codes, tails, words, marks, ends = self._units(texts)
        words = words.to_pylist()
        found = list(map(self.store.__getitem__, words))
        if self.spaced:
            bare = np.zeros(len(codes), bool)
            bare[ends[:-1][ends[:-1] < len(codes)]] = True
            if "\n" in words:
                line = codes == words.index("\n")
                bare |= line
                bare[1:] |= line[:-1]
            some = np.unique(codes[bare])
            codes[bare] = len(words) + np.searchsorted(some, codes[bare])
            found += map(self.bare.__getitem__, map(words.__getitem__, some.tolist()))
        tails = tails + np.int32(len(found))
        found += map(self.store.tail, marks.to_pylist())
        ids = np.frombuffer(b"".join(found), self.kind)
        sizes = np.fromiter(map(len, found), np.int32, len(found)) // self.kind.itemsize
        pieces = np.stack([codes, tails], axis=1).reshape(-1)
        n = sizes[pieces]
        # one slice of texts, and its ids, are far below 2 ** 31
        stops = np.cumsum(n, dtype=np.int32)
        step = (np.cumsum(sizes, dtype=np.int32) - sizes)[pieces] - (stops - n)
        step = np.repeat(step, n)
        step += np.arange(len(step), dtype=np.int32)
        out = ids[step]
        at = np.r_[0, stops][2 * ends]
        return [out[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each whole text; null counts as empty."""
        texts = [t or "" for t in texts]
        apart = {i for i, t in enumerate(texts) if not t or self.spaced and _uneven(t)}
        self.store.bound()
        self.bare.bound()
        even = iter(self._even([t for i, t in enumerate(texts) if i not in apart]))
        return [np.frombuffer(self.store.whole(t), self.kind) if i in apart else next(even) for i, t in enumerate(texts)]


def slices(batches: Iterator[pa.RecordBatch], text: int, size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``size`` bytes of text."""
    held, n = [], 0
    for batch in short(batches):
        held.append(batch)
        n += batch.column(text).nbytes
        if n >= size:
            yield pa.concat_batches(held)
            held, n = [], 0
    if held:
        yield pa.concat_batches(held)


def encoder(path: str, layout: str, most: int = CACHE_UNITS) -> UnitEncoder:
    """The process's encoder for a file, which keeps the ids of ``most`` units; made once per Python
    worker."""
    if (path, layout) not in _loaded:
        _loaded[path, layout] = UnitEncoder(path, layout, most)
    return _loaded[path, layout]
