"""Token ids of whole texts in bit-packed shards.

Format: a folder of Parquet files whose rows are blocks. A block holds the ids
of whole documents, each id in the fewest bits that hold every id of the
vocabulary, little-endian from the block's first bit on:

    shard int            blocks of one range of document ids
    block int            ordinal in the shard
    first long           ids of the shard before this block
    bits int             bits per id
    doc_ids array<long>  the documents, ascending
    sizes array<long>    ids of each of them, with the end id
    payload binary       ceil(sum(sizes) * bits / 8) bytes

Shards, blocks and documents follow each other in ascending document id. The
block offsets (first) and sizes give any document (read_documents) or id range
(read_range) by unpacking the wanted bytes of its blocks with numpy, no loop
over ids.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import words as W

BLOCK_IDS = 1 << 16
#: Words whose ids a worker remembers, in each of two generations.
REMEMBERED = 300_000
SCHEMA = "shard int, block int, first long, bits int, doc_ids array<long>, sizes array<long>, payload binary"


def width(vocabulary: int) -> int:
    """The fewest bits for ids 0 .. vocabulary - 1."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    ids = np.ascontiguousarray(ids, "<u4")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    each = np.unpackbits(ids.view(np.uint8).reshape(-1, 4), axis=1, count=bits, bitorder="little")
    return np.packbits(each, bitorder="little").tobytes()


def unpack(payload: bytes, bits: int, start: int, stop: int) -> np.ndarray:
    """ids start .. stop - 1 of a block; only their bytes are looked at."""
    if bits in (8, 16, 32):
        return np.frombuffer(payload, f"<u{bits // 8}", stop - start, start * bits // 8).astype("<u4")
    low = start * bits // 8
    raw = np.frombuffer(payload, np.uint8, -(-stop * bits // 8) - low, low)
    each = np.unpackbits(raw, bitorder="little")[start * bits - low * 8 :][: (stop - start) * bits].reshape(-1, bits)
    whole = np.zeros((stop - start, 32), np.uint8)
    whole[:, :bits] = each
    return np.packbits(whole, axis=1, bitorder="little").view("<u4").reshape(-1)


def vocabulary_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_SIGNED = re.compile(r"([^\W\d_]+)([!-&(-/:-@\[-`{-~]+)")
#: Byte-level vocabularies write bytes without a printable character of their own as characters from U+0100 on.
_BYTE_LEVEL = {b: 256 + i for i, b in enumerate(b for b in range(256) if not (33 <= b < 127 or 161 <= b < 173 or 174 <= b))}


# What a tokenizer file must say for its texts to be cut at spaces and line feeds, lower-cased here and remembered by word.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


class WordIds:
    """Ids of a tokenizer file.

    Of a lower-casing byte-level one that never joins text across a space or
    line feed (the two fixed values above, added pieces without such a
    character), remembered by the stretches between them; of any other, by
    encoding each text as a whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            says = json.load(file)
        self.by_word = says["normalizer"] == _NORMALIZER and says["pre_tokenizer"] == _PRE_TOKENIZER and not any(" " in a["content"] or "\n" in a["content"] or a["lstrip"] or a["rstrip"] or a["normalized"] for a in says["added_tokens"])
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.kind = "<u2" if self.vocabulary <= 1 << 16 else "<u4"
        self.code = "H" if self.kind == "<u2" else "I"
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _look(self, word: str) -> bytes:
        ids = self.new.get(word)
        if ids is not None:
            return ids
        ids = self.old.get(word)
        if ids is None:
            if not word.isalpha() and (parts := _SIGNED.fullmatch(word)) and parts[1].isalpha():  # letters and signs are never in one piece; an apostrophe may be
                ids = self._look(parts[1]) + self._look(parts[2])
                if len(parts[2]) > 1:
                    return ids
            else:
                ids = self._encoded(word)
        if len(self.new) >= REMEMBERED:
            self.old, self.new = self.new, {}
        self.new[word] = ids
        return ids

    def _encoded(self, word: str) -> bytes:
        if word.isalpha() and (word.isascii() or max(word) < "\u0130"):  # Latin letters that normalising leaves as they are, but for case
            low = word.lower()
            if low != word:
                return self._look(low)
            if not word.isascii():
                low = low.encode().decode("latin-1").translate(_BYTE_LEVEL)
            return array(self.code, [t.id for t in self.tokenizer.model.tokenize(low)]).tobytes()
        return array(self.code, self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def ids(self, text: str) -> bytes:
        if not self.by_word:
            return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        new, look = self.new.get, self._look
        return b"".join([new(w) or look(w) for w in text.replace("\n", " ").split(" ") if w])


_loaded: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _loaded:
        _loaded[path] = WordIds(path)
    return _loaded[path]


def _encode(path: str, end_id: int, bounds: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        of, small, edges = word_ids(path), zstandard.ZstdCompressor(level=1), np.array(bounds, np.int64)
        last = np.array([end_id], of.kind).tobytes()
        for batch in batches:
            for part, _, _ in W.chunks(batch, most=W.STRINGS):
                raw = [of.ids(t or "") + last for t in part.column("text").to_pylist()]
                shard = np.searchsorted(edges, part.column("id").fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False), "right")
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(shard.astype(np.int32)), pa.array([small.compress(r) for r in raw], pa.binary())], names=["id", "shard", "ids"])

    return run


def _write(kind: str, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        large = zstandard.ZstdDecompressor()
        shard, block, first, docs, parts, held = None, 0, 0, [], [], 0

        def flush() -> pa.RecordBatch:
            row = {"shard": shard, "block": block, "first": first, "bits": bits, "doc_ids": docs, "sizes": [len(p) for p in parts], "payload": pack(np.concatenate(parts), bits)}
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row.values(), kinds)], names=list(row))

        for batch in batches:
            for to, doc, raw in zip(batch.column("shard").to_pylist(), batch.column("id").to_pylist(), batch.column("ids")):
                if parts and (to != shard or held >= BLOCK_IDS):
                    yield flush()
                    block, first, docs, parts, held = block + 1, first + held, [], [], 0
                if to != shard:
                    shard, block, first = to, 0, 0
                ids = np.frombuffer(large.decompress(raw.as_py()), kind)
                docs.append(doc)
                parts.append(ids)
                held += len(ids)
        if parts:
            yield flush()

    return run


def write_ids(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes all texts' ids to `path`, in ascending document id.

    A null or empty text has the end id alone; rows with a null id come first;
    repeated ids follow each other, in no given order. Texts go through one
    shuffle, as compressed ids; shards are as many as spark.sql.shuffle.partitions.
    An empty table gives a folder without blocks.
    """
    spark, tokenizer = docs.sparkSession, tokenizer or vocabulary_file()
    of = word_ids(tokenizer)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = rows.agg(F.percentile_approx("id", F.array(*[F.lit(k / n) for k in range(1, n)]), 100 * n)).first()[0] if n > 1 else None
    bounds = sorted(set(at or []))
    encoded = rows.mapInArrow(_encode(tokenizer, end_id, bounds), "id long, shard int, ids binary")
    dealt = encoded.repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions("shard", "id")
    dealt.mapInArrow(_write(of.kind, width(max(of.vocabulary, end_id + 1))), SCHEMA).write.mode("overwrite").option("compression", "zstd").parquet(path)


def _bases(blocks: DataFrame) -> tuple[dict[int, int], int]:
    """The ids before each shard, and of all shards."""
    totals = blocks.select("shard", F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("shard").agg(F.sum("n").alias("n")).orderBy("shard").collect()
    base, at = {}, 0
    for row in totals:
        base[row.shard], at = at, at + row.n
    return base, at


def read_ids(spark: SparkSession, path: str, then: Callable[[np.ndarray], int] | None = None) -> DataFrame:
    """One row per document of a written folder: doc_id, start, n_tokens and ids, or value = then(ids).

    start counts the ids of all documents before it. Only one total for each
    shard goes to the driver.
    """
    blocks = spark.read.schema(SCHEMA).parquet(path)
    base, _ = _bases(blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ends = np.cumsum([0, *row["sizes"]])
                whole = unpack(row["payload"], row["bits"], 0, int(ends[-1]))
                each = [whole[a:b] for a, b in zip(ends, ends[1:])]
                start = pa.array(ends[:-1] + row["first"] + base[row["shard"]], pa.int64())
                out = pa.array([then(x) for x in each], pa.int64()) if then else pa.array([x.astype(np.int32) for x in each], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), start, pa.array(row["sizes"], pa.int64()), out], names=["doc_id", "start", "n_tokens", "out"])

    return blocks.mapInArrow(run, "doc_id long, start long, n_tokens long, out " + ("long" if then else "array<int>")).withColumnRenamed("out", "value" if then else "ids")


def read_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """doc_id, start, n_tokens, ids of the documents asked for, by unpacking their bytes alone.

    A document that is not there gives no row, one that is there twice two;
    documents without an id are not looked up.
    """
    wanted = frozenset(int(i) for i in doc_ids)
    blocks = spark.read.schema(SCHEMA).parquet(path)
    base, _ = _bases(blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ends = np.cumsum([0, *row["sizes"]])
                at = [k for k, doc in enumerate(row["doc_ids"]) if doc in wanted]
                ids = [unpack(row["payload"], row["bits"], int(ends[k]), int(ends[k + 1])).astype(np.int32) for k in at]
                places, sizes = [int(ends[k]) + row["first"] + base[row["shard"]] for k in at], [row["sizes"][k] for k in at]
                yield pa.RecordBatch.from_arrays([pa.array([row["doc_ids"][k] for k in at], pa.int64()), pa.array(places, pa.int64()), pa.array(sizes, pa.int64()), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "start", "n_tokens", "ids"])

    held = blocks.where(F.arrays_overlap("doc_ids", F.array(*[F.lit(i).cast("long") for i in sorted(wanted)]))) if wanted else blocks.limit(0)
    return held.mapInArrow(run, "doc_id long, start long, n_tokens long, ids array<int>")


def read_range(spark: SparkSession, path: str, start: int, stop: int) -> DataFrame:
    """The ids start .. stop - 1 of all documents in a row: start, ids, one row per block that holds some of them.

    The range is clipped to what is there. Shards outside it are left out by
    the scan, blocks outside it are not unpacked, nor is the rest of a block.
    """
    blocks = spark.read.schema(SCHEMA).parquet(path)
    base, total = _bases(blocks)
    start, stop = max(start, 0), min(stop, total)
    after = {s: at for s, at in zip(base, [*list(base.values())[1:], total])}
    shards = [s for s in base if base[s] < stop and after[s] > start]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                at = base[row["shard"]] + row["first"]
                low, high = max(start - at, 0), min(stop - at, sum(row["sizes"]))
                if low < high:
                    ids = unpack(row["payload"], row["bits"], low, high).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array([at + low], pa.int64()), pa.array([ids], pa.list_(pa.int32()))], names=["start", "ids"])

    held = blocks.where(F.col("shard").between(shards[0], shards[-1])) if shards and start < stop else blocks.limit(0)
    return held.mapInArrow(run, "start long, ids array<int>")


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())
