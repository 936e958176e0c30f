"""Language identification by multilingual mixture inference.

A language is a distribution of hashed byte trigrams of lower-cased text, learned
from all labelled documents. A word's likelihood in a language is the product
over its trigrams, bounds included. For each document, expectation-maximisation
over its words estimates the proportions of the languages; of the nested sets of
the strongest one, two, ... languages, re-estimated each, the one with the best
likelihood less a penalty for each further language is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from . import arrays, words as W

BUCKETS = 1 << 16
BLOCK = 1 << 13
ROUNDS = 8
#: Log likelihood that a further language must gain, for each word of the document and in all.
PENALTY_WORD, PENALTY = 0.02, 8.0
#: A word's log likelihood ratio is bounded, so that one odd word decides nothing.
CLIP = 12.0
#: Languages counted in one pass; all are learned, and a table of BUCKETS floats each goes to every worker.
LANGUAGES = 64


def _features(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(part, first word of each text, first trigram of each word, trigrams, has a letter)."""
    text = pc.utf8_lower(batch.column("text").cast(pa.large_string()).fill_null(""))
    letters = pc.match_substring_regex(text, r"\p{L}")
    batch = pa.RecordBatch.from_arrays([batch.column(i) if n != "text" else text for i, n in enumerate(batch.schema.names)] + [letters], names=[*batch.schema.names, "letter"])
    for part, offsets, data in W.chunks(batch, most=W.CHUNK // 2):
        plain = _LETTER[data]
        w = W.words(offsets, plain)
        # Letters of a word and the space on either side: bytes start-1 .. end.
        padded = np.concatenate([[np.uint8(32)], plain, [np.uint8(32), np.uint8(32)]])
        before, after = padded[:-2].copy(), padded[2:].copy()
        before[offsets[:-1]], after[offsets[1:] - 1] = 32, 32  # what stands in the next text is no neighbour
        code = before.astype(np.uint32) << np.uint32(16) | padded[1:-1].astype(np.uint32) << np.uint32(8) | after
        code = (code * np.uint32(2654435761)) >> np.uint32(16)
        size = w.end - w.start
        first = np.concatenate([[0], np.cumsum(size)])
        at = np.arange(first[-1]) + np.repeat(w.start - first[:-1], size)  # the trigram around each letter byte
        yield part, w.first, first, code[at], part.column("letter").to_numpy(zero_copy_only=False)


# Bytes that aren't part of a letter become spaces: ASCII other than a-z.
_LETTER = np.arange(256, dtype=np.uint8)
_LETTER[[i for i in range(128) if not 97 <= i < 123]] = 32


def _count(codes: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, place = np.zeros((len(codes), BUCKETS), np.uint64), {c: i for i, c in enumerate(codes)}
        for batch in batches:
            for part, doc_first, first, grams, _ in _features(batch):
                lang = np.array([place.get(x, -1) for x in part.column("lang").to_pylist()])
                of = np.repeat(lang, np.diff(first[doc_first]))
                for k in np.unique(lang[lang >= 0]):
                    seen[k] += np.bincount(grams[of == k], minlength=BUCKETS).astype(np.uint64)
        rows = list(arrays.blocks_of(seen, BLOCK))
        if rows:
            yield arrays.record(rows)

    return run


def held_out(id_: Column) -> Column:
    """Of documents that nothing is learned from; a null id is held out."""
    return F.coalesce(F.crc32(id_.cast("string")) % 5 == 0, F.lit(True))


class Model:
    """languages, and for each the log probability of each bucket less the mean over languages."""

    def __init__(self, languages: list[str], logs: np.ndarray):
        self.languages, self.logs = languages, logs


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Counts the trigrams of every labelled document that isn't held out. The driver gets one row of BUCKETS counts a language."""
    known = docs.where(F.col(lang_col).isNotNull() & ~held_out(F.col(id_col))).select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    codes = sorted(r[0] for r in known.select("lang").distinct().collect())
    if not codes:
        return Model([], np.zeros((0, BUCKETS), np.float32))
    counts = np.zeros((len(codes), BUCKETS))
    for at in range(0, len(codes), LANGUAGES):
        some = codes[at : at + LANGUAGES]
        rows = known if len(codes) <= LANGUAGES else known.where(F.col("lang").isin(some))
        counts[at : at + len(some)] = arrays.total(rows.mapInArrow(_count(some), arrays.BLOCK_SCHEMA), len(some) * BUCKETS, BLOCK, "uint64").reshape(len(some), BUCKETS)
    smooth = counts + 0.01 * counts.mean(axis=1, keepdims=True) + 0.01
    logs = np.log(smooth / smooth.sum(axis=1, keepdims=True))
    return Model(codes, (logs - logs.mean(axis=0)).astype(np.float32))


def _em(odds: np.ndarray, doc: np.ndarray, first: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of each text's languages and its mean log likelihood. odds: likelihoods of words, scaled; start: 0 for languages left out."""
    share = start / np.maximum(start.sum(axis=1, keepdims=True), 1e-300)
    n = np.maximum(np.diff(first), 1)[:, None]
    full = np.diff(first) > 0
    for _ in range(ROUNDS):
        part = odds * share[doc]
        part /= np.maximum(part.sum(axis=1, keepdims=True), 1e-30)
        new = np.zeros_like(share)
        new[full] = np.add.reduceat(part, first[:-1][full], axis=0)
        share = np.where(full[:, None], new / n, share)
    each = np.log(np.maximum((odds * share[doc]).sum(axis=1), 1e-30))
    gain = np.zeros(len(n))
    gain[full] = np.add.reduceat(each, first[:-1][full])
    return share, gain


def mixture(scores: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(proportions, number of languages) for each text, from the words' log likelihoods.

    Sets of any size are tried. Scaled likelihoods are at most one, so a set's
    gain is at most its penalty below zero: a text is done when that is no more
    than its best, and no larger set can win.
    """
    n_docs, k = len(first) - 1, scores.shape[1]
    sizes = np.diff(first)
    doc = np.repeat(np.arange(n_docs), sizes)
    top = scores.max(axis=1, keepdims=True) if len(scores) else scores
    odds = np.exp(np.maximum(scores - top, -CLIP)).astype(np.float32)
    share, _ = _em(odds, doc, first, np.ones((n_docs, k), np.float32))
    order = np.argsort(-share, axis=1, kind="stable")
    best = np.full(n_docs, -np.inf)
    out, used = np.zeros((n_docs, k)), np.zeros(n_docs, np.int64)
    for m in range(1, k + 1):
        cost = (m - 1) * (PENALTY + PENALTY_WORD * sizes)
        open_ = -cost > best
        own = np.flatnonzero(open_)
        if not len(own):
            break
        start = np.zeros((len(own), k), np.float32)
        np.put_along_axis(start, order[own, :m], 1, axis=1)
        words = open_[doc]
        part = odds if words.all() else odds[words]
        again, gain = _em(part, np.repeat(np.arange(len(own)), sizes[own]), np.concatenate([[0], np.cumsum(sizes[own])]), start)
        gain = gain - cost[own]
        better = gain > best[own]
        at = own[better]
        best[at], out[at], used[at] = gain[better], again[better], m
    return out, used


def _predict(languages: list[str], logs):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, names = logs.value, np.array([*languages, "und"], object)
        for batch in batches:
            for part, doc_first, first, grams, letter in _features(batch):
                n, k = len(doc_first) - 1, len(languages)
                pred, score, shares = np.full(n, k), np.zeros(n), np.zeros((n, max(k, 1)))
                if k and len(first) > 1:
                    scores = np.add.reduceat(np.ascontiguousarray(table[grams]), first[:-1], axis=0)
                    shares, _ = mixture(scores, doc_first)
                if k:
                    pred = np.where(letter, shares.argmax(axis=1), k)
                    score = np.where(letter, np.clip(shares.max(axis=1), 0, 1), 0.0)
                found = [{languages[j]: float(v) for j, v in enumerate(row) if v >= 0.005} if ok else {} for row, ok in zip(shares, letter)] if k else [{}] * n
                mixed = pa.array([list(x.items()) for x in found], pa.map_(pa.string(), pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(names[pred], pa.string()), pa.array(score), mixed], names=["id", "lang_pred", "score", "mixture"])

    return run


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, lang_pred, score, mixture (proportions of the kept languages).

    und and score 0 where the text is null or has no letter, or nothing was
    learned. No shuffle; the model is a table of languages * BUCKETS floats.
    """
    logs = docs.sparkSession.sparkContext.broadcast(np.ascontiguousarray(model.logs.T))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(_predict(model.languages, logs), f"id {kind}, lang_pred string, score double, mixture map<string,double>").withColumnRenamed("id", id_col)


def accepted(docs: DataFrame, model: Model, least_score: float = 0.5, languages: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """docs whose language is told: predicted as one of `languages` (any learned one if None) that makes up least_score of the text.

    Texts that are null or have no letter go. Where nothing was learned, all
    others stay. All columns, null ids and repeated rows stay; nothing is shuffled.
    """
    logs = docs.sparkSession.sparkContext.broadcast(np.ascontiguousarray(model.logs.T))
    of = _predict(model.languages, logs)
    wanted = set(model.languages if languages is None else languages) - {"und"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            text = batch.column(text_col).cast(pa.string())
            keep = np.zeros(n, bool)
            if model.languages:
                for found in of(iter([pa.RecordBatch.from_arrays([pa.array(np.arange(n)), text], names=["id", "text"])])):
                    told = np.array([x in wanted for x in found.column("lang_pred").to_pylist()], bool)
                    keep[found.column("id").to_numpy()] = told & (found.column("score").to_numpy() >= least_score)
            else:
                keep = pc.match_substring_regex(text.fill_null(""), r"\p{L}").to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
