"""Counts of word pieces by a linear longest-match automaton.

Greedy longest match takes the longest piece of the vocabulary at a word's start,
then the longest continuation, and so on; a word that cannot be cut counts as
one unknown token. The automaton is a trie of the vocabulary with failure links:
where no edge goes on, the pieces that are certain by then are popped and the
state is what of the word is left over. Each state holds only how many pieces
its failure link pops, so counting never builds a piece and reads each character
once.
"""

from __future__ import annotations

import json
import unicodedata
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from . import words as W
from .token_ids import vocabulary_file

#: What the public vocabulary's tokenizer cuts on its own, fixed values: contractions, letters, a digit, a run of signs.
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
#: Added to the byte that ends a word.
LAST = 256
REMEMBERED = 300_000


class Automaton:
    """Trie over initial pieces, with continuations below a second root."""

    def __init__(self, initial: Iterable[str], continuing: Iterable[str]):
        self.edges: list[dict[str, int]] = [{}, {}]
        ends = [False, False]
        for root, pieces in ((0, initial), (1, continuing)):
            for piece in pieces:
                at = root
                for c in piece:
                    to = self.edges[at].get(c)
                    if to is None:
                        to = len(self.edges)
                        self.edges[at][c] = to
                        self.edges.append({})
                        ends.append(False)
                    at = to
                if piece:
                    ends[at] = True
        self.fail, self.pops = [-1] * len(ends), [0] * len(ends)
        todo = deque([0, 1])
        while todo:
            u = todo.popleft()
            for c, v in self.edges[u].items():
                if ends[v]:
                    self.fail[v], self.pops[v] = 1, 1
                else:
                    z, popped = self.fail[u], self.pops[u]
                    while z >= 0 and c not in self.edges[z]:
                        popped, z = popped + self.pops[z], self.fail[z]
                    if z >= 0:
                        self.fail[v], self.pops[v] = self.edges[z][c], popped
                todo.append(v)

    def count(self, word: str) -> int:
        """Pieces of the word, or -1 if it cannot be cut."""
        edges, fail, pops = self.edges, self.fail, self.pops
        at = n = 0
        for c in word:
            to = edges[at].get(c)
            while to is None:
                n += pops[at]
                at = fail[at]
                if at < 0:
                    return -1
                to = edges[at].get(c)
            at = to
        while at > 1:
            n += pops[at]
            at = fail[at]
        return n if at >= 0 else -1


def greedy(word: str, initial: set[str], continuing: set[str]) -> int:
    """What the automaton must give, by trying every end: for tests."""
    n = start = 0
    while start < len(word):
        for end in range(len(word), start, -1):
            if word[start:end] in (continuing if start else initial):
                break
        else:
            return -1
        n, start = n + 1, end
    return n


def letters(word: str) -> str:
    """The word as the automaton reads it: a letter a byte of UTF-8, the last one marked, since some pieces only end words."""
    read = word.encode().decode("latin-1")
    return read[:-1] + chr(ord(read[-1]) + LAST)


def public_vocabulary(path: str | None = None) -> set[str]:
    """Pieces of the tokenizer in the letters of letters(); all bytes are pieces, so every word can be cut."""
    with open(path or vocabulary_file()) as f:
        model = json.load(f)["model"]
    of = {chr(b): chr(b) for b in [*range(33, 127), *range(161, 173), *range(174, 256)]}
    of |= {chr(256 + i): chr(b) for i, b in enumerate(b for b in range(256) if not (33 <= b < 127 or 161 <= b < 173 or 174 <= b))}
    mark, found = model["end_of_word_suffix"], set()
    for name in model["vocab"]:
        ends = name.endswith(mark)
        read = "".join(of[c] for c in name.removesuffix(mark))
        found.add(read[:-1] + chr(ord(read[-1]) + LAST) if ends else read)
    return found


_loaded: dict[str, tuple[Automaton, dict]] = {}


def _of(path: str) -> tuple[Automaton, dict]:
    if path not in _loaded:
        pieces = public_vocabulary(path)
        _loaded[path] = Automaton(pieces, pieces), {}
    return _loaded[path]


def _stretch(of: Automaton, text: str) -> tuple[int, int, int]:
    words = [of.count(letters(w)) for w in PIECE.findall(unicodedata.normalize("NFC", text))]
    return len(words), sum(n if n >= 0 else 1 for n in words), sum(n < 0 for n in words)


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, known = _of(path)
        for batch in batches:
            for part, _, _ in W.chunks(batch, most=W.STRINGS):
                rows = []
                for text in part.column("text").to_pylist():
                    words = pieces = unknown = 0
                    for stretch in (text or "").lower().split():
                        got = known.get(stretch)
                        if got is None:
                            if len(known) >= REMEMBERED:
                                known.clear()
                            got = known[stretch] = _stretch(of, stretch)
                        words, pieces, unknown = words + got[0], pieces + got[1], unknown + got[2]
                    rows.append((words, pieces, unknown))
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([part.column("id"), *(pa.array(c, pa.int64()) for c in cols)], names=["id", "n_words", "n_tokens", "n_unknown"])

    return run


def count_tokens(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, n_words, n_tokens, n_unknown of the whole lower-cased text.

    A null or empty text has none; rows that repeat are counted each, other
    columns are left out. n_unknown is 0 with a vocabulary of all bytes. A text
    is read by stretches without spaces, whatever its length. No shuffle. vocabulary is the path of a
    tokenizer file that every executor can read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_count(vocabulary or vocabulary_file()), f"id {kind}, n_words long, n_tokens long, n_unknown long").withColumnRenamed("id", id_col)
