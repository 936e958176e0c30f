"""Benchmark decontamination by latent semantic retrieval.

Passages are blocks of BLOCK words; their terms are the benchmark's own words.
One pass over all documents counts, in how many passages each term is, and adds
up a sparse random sketch of the passage-term matrix (each passage goes, with a
random sign, to one of ROWS rows). Weighting the sketch's columns by the inverse
passage frequency and a small singular value decomposition give the terms'
latent vectors: a randomised SVD of the TF-IDF matrix in one pass, of which the
leading RANK dimensions are kept and the others are oversampling. A second pass
projects windows of two adjacent passages, retrieves by cosine, and checks what
is found: the share of the query's term weight in the window, the longest common
subsequence of words,
and for paraphrases the answer's words. An item longer than a passage is looked
for by segments of BLOCK words, each of which a window can hold, and one found
segment has the whole item compared.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from . import arrays, words as W
from .scratch import Scratch

BLOCK = 32
#: Rows of the sketch, and dimensions of the latent space. Items have little in common, so fewer dimensions than items tell them apart badly.
ROWS, RANK = 512, 240
#: A term of more than this share of passages has no weight, unless an item would keep fewer than KEEP terms.
COMMON, KEEP = 0.02, 5
#: Queries (items and segments of items) of one pass; a larger benchmark takes several, so what is broadcast is bounded.
ITEMS = 1_500
COSINE_LEAST = 0.33
WEIGHT_LEAST = 0.4
#: Common subsequence, as a share of the item's words: enough alone; enough with the answer's words.
SAME, PARAPHRASE, ANSWER = 0.7, 0.5, 0.8
#: Items of fewer words must be there word for word.
SHORT = 8

# Letters, digits and every byte of a longer character stay, all else separates words.
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[[i for i in range(128) if not (48 <= i < 58 or 97 <= i < 123)]] = 32


def _hashed(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, W.Words]]:
    text = pc.utf8_lower(batch.column("text").cast(pa.large_string()).fill_null(""))
    batch = pa.RecordBatch.from_arrays([batch.column("id"), text], names=["id", "text"])
    for part, offsets, data in W.chunks(batch):
        yield part, W.words(offsets, _PLAIN[data])


def word_hashes(text: str | None) -> np.ndarray:
    batch = pa.RecordBatch.from_arrays([pa.array([0]), pa.array([text], pa.string())], names=["id", "text"])
    return np.concatenate([w.hash for _, w in _hashed(batch)])


class Items:
    """Benchmark items of one pass: word hashes, the sorted vocabulary and each item's distinct terms."""

    def __init__(self, ids: list[int], texts: list[str | None], answers: list[str | None]):
        self.words = [word_hashes(t) for t in texts]
        self.sequences = [Sequence(w) for w in self.words]
        self.answers = [Sequence(word_hashes(a)) for a in answers]
        self.ids = ids
        self.vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *self.words]))
        self.present = np.zeros(1 << 20, bool)
        self.present[(self.vocabulary >> np.uint64(44)).astype(np.int64)] = True

    def terms(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, terms) of the words that are in the vocabulary."""
        at = np.flatnonzero(self.present[(hashes >> np.uint64(44)).astype(np.int64)])
        term = np.searchsorted(self.vocabulary, hashes[at])
        term[term == len(self.vocabulary)] = 0
        same = self.vocabulary[term] == hashes[at]
        return at[same], term[same]


def segments(n: int) -> list[tuple[int, int]]:
    """(start, end) of the queries for an item of n words: the item, and pieces of BLOCK words that cover it."""
    pieces = -(-n // BLOCK)
    return [(0, n)] + [(i * (n - BLOCK) // (pieces - 1), i * (n - BLOCK) // (pieces - 1) + BLOCK) for i in range(pieces) if n > BLOCK]


def last_sentence(text: str | None) -> str:
    """What stands for an item's answer where the benchmark has no column for it."""
    parts = [p for p in re.split(r"[.!?\n]+", text or "") if p.strip()]
    return parts[-1] if parts else ""


def _blocks(w: W.Words, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first block of each text, block, term, count) with a row for each term of a block."""
    sizes = np.diff(w.first)
    first = np.concatenate([[0], np.cumsum(-(-sizes // BLOCK))])
    at, term = items.terms(w.hash)
    doc = np.searchsorted(w.first, at, "right") - 1
    block = first[doc] + (at - w.first[doc]) // BLOCK
    key, count = np.unique(block * len(items.vocabulary) + term, return_counts=True)
    return first, key // len(items.vocabulary), key % len(items.vocabulary), count


def _sketch(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        n = len(items.vocabulary)
        sums = np.zeros(ROWS * n + n + 1)
        for batch in batches:
            for part, w in _hashed(batch):
                if not len(w.hash):
                    continue
                first, block, term, count = _blocks(w, items)
                own = np.add.reduceat(w.hash, w.first[:-1][np.diff(w.first) > 0]) if len(w.hash) else np.zeros(0, np.uint64)
                seed = np.zeros(len(w.first) - 1, np.uint64)
                seed[np.diff(w.first) > 0] = own
                luck = W.mix(np.repeat(seed, np.diff(first)) + np.arange(first[-1], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                row, sign = (luck % np.uint64(ROWS)).astype(np.int64), 1.0 - 2.0 * (luck >> np.uint64(63)).astype(float)
                np.add.at(sums, row[block] * n + term, count * sign[block])
                sums[ROWS * n : -1] += np.bincount(term, minlength=n)
                sums[-1] += first[-1]
        rows = list(arrays.blocks_of(sums, 1 << 15))
        if rows:
            yield arrays.record(rows)

    return run


def weights(seen: np.ndarray, passages: float, items: Items) -> np.ndarray:
    """Inverse passage frequencies of the terms; 0 for common ones, unless an item would keep fewer than KEEP."""
    weight = np.log((1 + passages) / (1 + seen))
    light = seen > COMMON * passages
    for w in items.words:
        term = items.terms(w)[1]
        if (~light[np.unique(term)]).sum() < KEEP:
            light[term] = False
    weight[light] = 0
    return weight


def latent(sketch: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Latent vectors of the terms from the weighted sketch.

    Dimensions are scaled by their singular values, or the few that common terms
    share would hide the many that tell items apart.
    """
    _, sizes, right = np.linalg.svd(sketch * weight, full_matrices=False)
    real = np.flatnonzero(sizes > 1e-6 * max(sizes[0], 1e-30))[:RANK]
    return (right[real].T * weight[:, None] / sizes[real]).astype(np.float32)


def _projected(block: np.ndarray, term: np.ndarray, count: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(blocks, their vectors); the rows of a block stand together."""
    starts = np.flatnonzero(np.diff(block, prepend=-1))
    size = np.diff(starts, append=len(block))
    order = np.argsort(-size, kind="stable")  # so that the blocks of more than j terms come first
    at, size = starts[order], size[order]
    z = np.zeros((len(starts), vectors.shape[1]), np.float32)
    for j in range(int(size[0]) if len(size) else 0):
        own = at[: np.searchsorted(-size, -j, "left")] + j
        more = vectors[term[own]]
        several = np.flatnonzero(count[own] > 1)
        more[several] *= count[own][several, None].astype(np.float32)
        z[: len(own)] += more
    return block[at], z


class Sequence:
    """A text's words, to be compared with stretches of others."""

    def __init__(self, own: np.ndarray):
        self.n, self.places = len(own), {}
        for i, x in enumerate(own.tolist()):
            self.places[x] = self.places.get(x, 0) | 1 << i

    def common(self, other: list[int]) -> int:
        """Length of the longest common subsequence: a bit a word, one addition a word of the other."""
        all_ = row = (1 << self.n) - 1
        get = self.places.get
        for x in other:
            same = row & get(x, 0)
            if same:
                row = (row + same | row - same) & all_
        return self.n - row.bit_count()


def judge(item: Sequence, answer: Sequence, region: list[int]) -> tuple[float, float]:
    """(share of the item, share of the answer) that is a common subsequence with the best stretch of the region.

    Stretches are little longer than the item, so that common words far apart don't add up.
    """
    n = item.n
    span = n if n < SHORT else n + n // 4 + 2
    best, where = 0, 0
    for at in range(0, max(1, len(region) - span + 1), 1 if n < SHORT else max(1, n // 8)):
        got = item.common(region[at : at + span])
        if got > best:
            best, where = got, at
    told = answer.common(region[max(0, where - 2) : where + span + answer.n]) / answer.n if answer.n else 0.0
    return best / n, told


def leaked(n: int, share: float, told: float) -> bool:
    if n < SHORT:
        return share >= 1
    return share >= SAME or share >= PARAPHRASE and told >= ANSWER


def asked_for(items: Items, weight: np.ndarray, vectors: np.ndarray) -> tuple:
    """What the search needs: unit vectors of the queries, their items, their terms' shares of their weight, the least weight of a window."""
    n = len(items.vocabulary)
    parts = [(i, w[a:b]) for i, w in enumerate(items.words) for a, b in segments(len(w))]
    queries, keys, shares, least = np.zeros((len(parts), vectors.shape[1]), np.float32), [], [], []
    for i, (_, w) in enumerate(parts):
        term, count = np.unique(items.terms(w)[1], return_counts=True)
        z = (vectors[term] * count[:, None]).sum(axis=0)
        queries[i] = z / max(1e-30, float(np.linalg.norm(z)))
        keys.append(i * n + term)
        least.append(weight[term].sum())
        shares.append(weight[term] / max(1e-30, least[-1]))
    most = [x for x in least if x > 0]
    return items, weight, vectors, queries, np.array([i for i, _ in parts]), np.concatenate(keys), np.concatenate(shares), WEIGHT_LEAST * min(most, default=0.0) * (1 - 1e-6)


def _places(hits: list[tuple[int, float]], size: int) -> Iterator[tuple[int, int, float]]:
    """(first block, end block, greatest cosine) of hits whose windows begin within an item's length of one another."""
    hits, at = sorted(hits, key=lambda h: (h[0], -h[1])), 0
    while at < len(hits):
        end = at + 1
        while end < len(hits) and (hits[end][0] - hits[end - 1][0]) * BLOCK < max(size, 1):
            end += 1
        yield hits[at][0], hits[end - 1][0] + 2, max(c for _, c in hits[at:end])
        at = end


def _search(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weight, vectors, queries, owner, keys, shares, least = shared.value
        n = len(items.vocabulary)
        for batch in batches:
            rows: list[tuple] = []
            for part, w in _hashed(batch):
                if not len(w.hash):
                    continue
                first, block, term, count = _blocks(w, items)
                heavy = weight[term] > 0
                block, term, count = block[heavy], term[heavy], count[heavy]
                last = np.zeros(first[-1] + 1, bool)
                last[first[1:] - 1] = True
                # Windows (a block and the next of its text) of less weight than any query asks for are left out.
                load = np.bincount(block, weight[term], minlength=first[-1] + 1)
                load[:-1] += np.where(last[:-1], 0, load[1:])
                may = load >= least
                may[1:] |= may[:-1].copy()
                some = may[block]
                block, term, count = block[some], term[some], count[some]
                if not len(block):
                    continue
                z = np.zeros((first[-1] + 1, vectors.shape[1]), np.float32)
                own, z_own = _projected(block, term, count, vectors)
                z[own] = z_own
                z[:-1] += np.where(last[:-1, None], 0, z[1:])
                z = z[:-1]
                norm = np.sqrt((z * z).sum(axis=1))
                live = np.flatnonzero((norm > 0) & (load[:-1] >= least))
                z = z[live] / norm[live, None]
                ends = np.searchsorted(block, np.arange(first[-1] + 2))
                found: dict[tuple[int, int], list] = {}
                for q in range(0, len(queries), 1024):
                    cosine = z @ queries[q : q + 1024].T
                    win, item = np.nonzero(cosine >= COSINE_LEAST)
                    cos, win, item = cosine[win, item], live[win], item + q
                    # The share of the query's weight that the window's terms have.
                    stop = np.where(last[win], ends[win + 1], ends[win + 2])
                    size = stop - ends[win]
                    pair = np.repeat(np.arange(len(win)), size)
                    t = term[np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(ends[win], size)]
                    want = item[pair].astype(np.int64) * n + t
                    k = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
                    got = np.bincount(pair, np.where(keys[k] == want, shares[k], 0.0), minlength=len(win))
                    for i in np.flatnonzero(got >= WEIGHT_LEAST):
                        doc = int(np.searchsorted(first, win[i], "right") - 1)
                        found.setdefault((doc, int(owner[item[i]])), []).append((int(win[i] - first[doc]), float(cos[i])))
                for (doc, item_), hits in found.items():
                    own, best = w.hash[w.first[doc] : w.first[doc + 1]].tolist(), None
                    size = len(items.words[item_])
                    # Each window on its own, and neighbours together with what an item has before its last segment.
                    single = [(at, at + 2, max(c for x, c in hits if x == at)) for at in sorted({x for x, _ in hits})]
                    ways = [(single, size)] if size <= BLOCK else [(single, size), (list(_places(hits, size)), size + size // 4 + 2)]
                    for places, margin in ways if size <= 2 * BLOCK else ways[::-1]:
                        for at, end, cos_ in places:
                            low, high = max(0, at * BLOCK - margin), end * BLOCK + margin
                            share, told = judge(items.sequences[item_], items.answers[item_], own[low:high])
                            if leaked(size, share, told) and (best is None or share > best[3]):
                                best = (items.ids[item_], low, cos_, share, told)
                        if best:
                            break
                    if best:
                        rows.append((part.column("id")[doc].as_py(), *best))
            if rows:
                cols = list(zip(*rows))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "item_id", "near_word", "cosine", "lcs_share", "answer_share"])

    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", answer_col: str | None = None) -> DataFrame:
    """One row per document and item it holds: doc_id, item_id, near_word, cosine, lcs_share, answer_share.

    Words are runs of letters and digits in lower case. An item without words,
    or a null one, is in no document; neither is any item in an empty text.
    Items of the same text are each reported; repeated documents as often as
    they are there. Without answer_col an item's last sentence is its answer.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    asked = benchmark.select(F.col(item_col).cast("long").alias("id"), F.col(item_text).cast("string").alias("text"), (F.col(answer_col).cast("string") if answer_col else F.lit(None).cast("string")).alias("answer")).where("id is not null and text is not null")
    schema = "doc_id long, item_id long, near_word long, cosine double, lcs_share double, answer_share double"
    out, held = None, []

    def search(held: list) -> DataFrame | None:
        items = Items([r.id for r in held], [r.text for r in held], [r.answer or last_sentence(r.text) for r in held])
        n = len(items.vocabulary)
        if not n:
            return None
        first = spark.sparkContext.broadcast(items)
        sums = arrays.total(rows.mapInArrow(_sketch(first), arrays.BLOCK_SCHEMA), ROWS * n + n + 1, 1 << 15, "float64")
        weight = weights(sums[ROWS * n : -1], sums[-1], items)
        vectors = latent(sums[: ROWS * n].reshape(ROWS, n), weight)
        second = spark.sparkContext.broadcast(asked_for(items, weight, vectors))
        return rows.mapInArrow(_search(second), schema)

    asking = 0
    for row in asked.toLocalIterator():
        held.append(row)
        asking += len(segments(len(word_hashes(row.text))))
        if asking >= ITEMS:
            found, held, asking = search(held), [], 0
            out = found if out is None else out if found is None else out.unionAll(found)
    found = search(held) if held else None
    out = found if out is None else out if found is None else out.unionAll(found)
    return spark.createDataFrame([], schema) if out is None else out


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """docs without those that hold an item; all columns and repeated rows stay, null ids too."""
    gone = find_leaks(docs, benchmark, id_col=id_col, **how).select(F.col("doc_id").alias("__gone")).distinct()
    gone = Scratch(docs.sparkSession, "leaks").save(gone, "gone")
    return docs.join(gone, F.col(id_col).cast("long") == F.col("__gone"), "left_anti")
