"""MinHash near-dedup with bottom-k sketches from one hash function.

The one 64-bit hash of a shingle orders a document's set twice: by itself, for
the sketch that estimates a similarity, and with the frequency class of the
hash's bucket before it, for the retained values that inverted lists are made
of. Retaining k = n - ceil(t*n) + 1 of n values loses no pair of similarity t
or more, whatever the order, and frequent shingles, such as those of a passage
that very many documents share, come last and are rarely retained.

Steps: sets and bucket counts; equal sets collapse to one class; inverted lists
of the classes' retained values. Members of a list of at most SHORT are compared
in place. In longer lists three members are compared to all others; in those
that hold several components even then, members outside the first component are
compared to all members they are not connected to. Pairs pass a bound from
sizes and the value's places, a bound on 64 bits, an estimate from the union of
both sketches, and the exact Jaccard similarity of full sets.

Retaining by share of the set rather than a fixed k departs from plain bottom-k:
a fixed k of the hash alone either loses links of documents that consist of
frequent passages, or pairs every two documents that share a common shingle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import arrays, graph, words as W
from .scratch import Scratch

BUCKETS = 1 << 20
BLOCK = 1 << 14
SKETCH = 32
#: Pairs whose estimate is below are dropped; at SKETCH values a pair of similarity 0.8 falls there with a chance under 1e-8. 0: none is.
ESTIMATE_LEAST = 0.3
#: Pairs whose 64 bits agree in fewer are dropped; that is six deviations below what similarity 0.8 gives. 0: none is.
BITS_LEAST = 43
BLOOM_BITS = 1 << 24
#: Members of a list that is compared in one place, and pairs looked at there at once.
SHORT, PAIRS = 64, 1 << 18


def _first_pass(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(BUCKETS, np.uint32)
        for batch in batches:
            ids, n, one, two = [], [], [], []
            for part, offsets, data in W.chunks(batch):
                ids.append(part.column("id"))
                flat = []
                for s in W.shingles(W.words(offsets, data), k):
                    n.append(len(s))
                    one.append(s.sum(dtype=np.uint64))
                    two.append(W.mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64))
                    flat.append(s)
                seen += np.bincount((np.concatenate(flat) >> np.uint64(44)).astype(np.int64), minlength=BUCKETS).astype(np.uint32)
            if n:
                m = len(n)
                cols = [pa.concat_arrays(ids), pa.array(n, pa.int64()), pa.array(np.array(one, np.uint64).view(np.int64)), pa.array(np.array(two, np.uint64).view(np.int64)), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "n", "one", "two", "block", "payload"])
        rows = list(arrays.blocks_of(seen, BLOCK))
        if rows:
            m = len(rows)
            blocks = arrays.record(rows)
            yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64())] * 4 + [blocks.column(0), blocks.column(1)], names=["id", "n", "one", "two", "block", "payload"])

    return run


def retained(n: int, percent: int) -> int:
    """How many values of a set of n are retained."""
    return n - -(-percent * n // 100) + 1


def _second_pass(k: int, percent: int, classes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = classes.value
        for batch in batches:
            ids, n, keep, sketch, bits = [], [], [], [], []
            for part, offsets, data in W.chunks(batch):
                ids.append(part.column("id"))
                for s in W.shingles(W.words(offsets, data), k):
                    n.append(len(s))
                    m = retained(len(s), percent) if len(s) else 0
                    order = np.argsort(rank[(s >> np.uint64(44)).astype(np.int64)], kind="stable")[:m]  # s ascends, so the hash decides within a class
                    keep.append(s[order].view(np.int64))
                    sketch.append((s[:SKETCH] >> np.uint64(33)).astype(np.int32))
                    bits.append(_bits(s))
            if n:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(ids), pa.array(n, pa.int64()), _lists(keep, pa.int64()), _lists(sketch, pa.int32()), pa.array(np.array(bits, np.uint64).view(np.int64))], names=["id", "n", "keep", "sketch", "bits"])

    return run


def _bits(s: np.ndarray) -> np.uint64:
    """One bit from the least hash of each 64th of the hash range; sets of similarity 0.8 agree in 58 of 64 at least, give or take 2.4."""
    bins = (s >> np.uint64(58)).astype(np.int64)
    first = np.flatnonzero(np.diff(bins, prepend=-1))
    return np.bitwise_or.reduce(((W.mix(s[first]) & np.uint64(1)) << bins[first].astype(np.uint64)), initial=np.uint64(0))


def _third_pass(k: int, bloom):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = bloom.value
        for batch in batches:
            have = batch.column("id").to_numpy(zero_copy_only=False)
            at = bloom_at(have)
            likely = packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & np.uint8(1)
            for part, offsets, data in W.chunks(batch.filter(pa.array(likely.astype(bool)))):
                sets = [s.view(np.int64) for s in W.shingles(W.words(offsets, data), k)]
                yield pa.RecordBatch.from_arrays([part.column("id"), _lists(sets, pa.int64())], names=["id", "full"])

    return run


def bloom_at(ids: np.ndarray) -> np.ndarray:
    return (W.mix(ids.astype(np.int64).view(np.uint64) + np.uint64(1)) % np.uint64(BLOOM_BITS)).astype(np.int64)


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts), kind))


def _bloom(ids: DataFrame, spark) -> np.ndarray:
    """A bit for each id's bucket: BLOOM_BITS bits in all, whatever the input. It only spares work; joins decide."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hit = np.zeros(BLOOM_BITS, bool)
        for batch in batches:
            hit[bloom_at(batch.column(0).to_numpy(zero_copy_only=False))] = True
        rows = list(arrays.blocks_of(np.packbits(hit).astype(np.uint8), 1 << 18))
        if rows:
            yield arrays.record(rows)

    def either(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack, bits = zstandard.ZstdDecompressor(), {}
        for batch in batches:
            for k, raw in zip(batch.column("block").to_pylist(), batch.column("payload")):
                part = np.frombuffer(unpack.decompress(raw.as_py()), np.uint8)
                bits[k] = part | bits[k] if k in bits else part
        if bits:
            yield arrays.record([(k, v.tobytes()) for k, v in bits.items()])

    out = np.zeros(BLOOM_BITS // 8, np.uint8)
    for row in ids.mapInArrow(run, arrays.BLOCK_SCHEMA).repartition(16, "block").mapInArrow(either, arrays.BLOCK_SCHEMA).toLocalIterator():
        out[row.block << 18 : (row.block << 18) + len(row.payload)] = np.frombuffer(row.payload, np.uint8)
    return out


def _verified(pairs: DataFrame, sketches: DataFrame, documents: DataFrame, k: int, percent: int, estimate_least: float, scratch: Scratch, name: str) -> DataFrame:
    """(u, v) of those pairs (a, b) that the estimate and then the full sets confirm."""
    spark = pairs.sparkSession
    left, right = (sketches.select(F.col("id").alias(c), F.col("sketch").alias(f"s{c}")) for c in "ab")
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, SKETCH)
    both = F.size(F.array_intersect(F.array_intersect(union, "sa"), "sb"))
    near = pairs.join(left, "a").join(right, "b").where(both >= estimate_least * F.size(union)).select("a", "b")
    near = scratch.save(near, f"{name}-near")
    ids = near.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    bloom = spark.sparkContext.broadcast(_bloom(ids, spark))
    full = documents.mapInArrow(_third_pass(k, bloom), "id long, full array<long>").join(ids, "id", "left_semi")
    full = scratch.save(full, f"{name}-sets")
    left, right = (full.select(F.col("id").alias(c), F.col("full").alias(f"f{c}")) for c in "ab")
    same = F.size(F.array_intersect("fa", "fb"))
    confirmed = near.join(left, "a").join(right, "b").where(100 * same >= percent * (F.size("fa") + F.size("fb") - same))
    out = scratch.save(confirmed.select(F.col("a").alias("u"), F.col("b").alias("v")), f"{name}-links")
    scratch.drop(near, full)
    return out


def _short_lists(percent: int, bits_least: int):
    """(id, other) of those pairs of a list's members that sizes, places and bits leave possible."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("own")
            own, ends = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            ids, at, bits = (own.field(k).to_numpy(zero_copy_only=False) for k in range(3))
            bits = bits.view(np.uint64)  # of signed numbers bitwise_count counts the absolute value's
            n, left = at >> 32, (at >> 32) - (at & 0xFFFFFFFF)
            late = (100 + percent) * left < 2 * percent * n
            found = []
            for size in np.unique(np.diff(ends)).tolist():
                one, two = np.triu_indices(size, 1)
                starts = ends[:-1][np.diff(ends) == size]
                for some in np.array_split(starts, -(-len(starts) * len(one) // PAIRS)) if size > 1 else []:
                    x, y = (some[:, None] + one).ravel(), (some[:, None] + two).ravel()
                    near = np.flatnonzero(np.bitwise_count(bits[x] ^ bits[y]) <= 64 - bits_least)
                    x, y = x[near], y[near]
                    bound = np.minimum(left[x], left[y])
                    fits = (100 * bound >= percent * (n[x] + n[y] - bound)) & ~(late[x] & late[y]) & (ids[x] != ids[y])
                    found.append(np.stack([np.minimum(ids[x], ids[y])[fits], np.maximum(ids[x], ids[y])[fits]]))
            if found:
                a, b = np.unique(np.concatenate(found, axis=1), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["id", "other"])

    return run


def _fits(a: str, b: str, percent: int) -> str:
    """SQL: whether a pair can reach the similarity if this is its first common retained value: all before it are not common."""
    bound = f"least({a}.n - {a}.pos, {b}.n - {b}.pos)"
    return f"100 * {bound} >= {percent} * ({a}.n + {b}.n - {bound})"


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, bits_least: int = BITS_LEAST, estimate_least: float = ESTIMATE_LEAST
) -> DataFrame:
    """One row per document: id_col, n_shingles, component_id, kept.

    docs: any columns; only id_col (long, distinct) and text_col are read, so
    other columns may have any names. A document's set holds its distinct
    `words`-word shingles (of fewer words, the whole sequence as one). Documents
    link if 100 * |A and B| >= percent * |A or B|; component_id is the smallest
    id reachable, kept is true for it. A null or empty text, or one of white
    space, has an empty set and links with nothing; rows with a null id are left
    out; of rows with one id an arbitrary one counts (keep_first has a way for
    both). An empty table gives an empty table. Texts are read whole, whatever
    their length. bits_least and estimate_least of 0 verify all candidate pairs.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    documents = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null")

    first = scratch.save(documents.mapInArrow(_first_pass(words), "id long, n long, one long, two long, block int, payload binary"), "sets")
    counts = arrays.total(first.where("block is not null"), BUCKETS, BLOCK, "uint32")
    classes = spark.sparkContext.broadcast(np.log2(counts + 1.0).__mul__(2).astype(np.uint8))

    sets = first.where("block is null")
    keyed = sets.where("n > 0").groupBy("n", "one", "two").agg(F.min("id").alias("rep"))
    reps = keyed.select(F.col("rep").alias("id"))
    second = documents.mapInArrow(_second_pass(words, percent, classes), "id long, n long, keep array<long>, sketch array<int>, bits long").where("n > 0")
    second = scratch.save(second.join(reps, "id", "left_semi").dropDuplicates(["id"]), "retained")
    sketches = second.select("id", "sketch")

    # A list's member is its id, its size and the value's place in it (as one number), and 64 bits. Of a pair that
    # may be similar the smaller one is early. Lists need two members, one of them early.
    at = F.shiftleft(F.col("n").cast("long"), 32) + F.col("pos")
    postings = second.select(F.posexplode("keep").alias("pos", "value"), "id", "n", "bits").select("value", "id", at.alias("at"), "bits")
    n, pos = (lambda c: F.shiftright(c, 32)), (lambda c: c.bitwiseAND(F.lit((1 << 32) - 1)))
    late = lambda c: (100 + percent) * (n(c) - pos(c)) < 2 * percent * n(c)
    lists = postings.groupBy("value").agg(F.count("*").alias("m"), F.count_if(~late(F.col("at"))).alias("heads")).where("m > 1 and heads > 0")

    # Short lists are compared in place; what is left are the members of longer ones.
    short = postings.join(lists.where(F.col("m") <= SHORT).select("value"), "value").groupBy("value").agg(F.collect_list(F.struct("id", "at", "bits")).alias("own"))
    short = short.select("own").mapInArrow(_short_lists(percent, bits_least), "id long, other long").select(F.lit(None).cast("long").alias("value"), "id", "other", F.lit(None).cast("long").alias("bits"))
    rest = postings.join(lists.where(F.col("m") > SHORT).select("value"), "value").select("value", "id", F.col("at").alias("other"), "bits")
    listed = scratch.save(short.unionAll(rest), "lists")
    short = listed.where("value is null").select(F.col("id").alias("a"), F.col("other").alias("b"))
    listed = listed.where("value is not null").select("value", "id", F.col("other").alias("at"), "bits")

    whole = lambda x: F.struct(n(x["at"]).alias("n"), pos(x["at"]).alias("pos"), x["id"].alias("id"), x["bits"].alias("bits"))
    alike = f"bit_count(x.bits ^ y.bits) <= {64 - bits_least}"
    pair = [F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")]

    # Three early members of each longer list are compared to all others of it.
    lead = lambda *by: F.min(F.struct(late(F.col("at")).alias("late"), *by, "id", "at", "bits"))
    chance = lambda seed: F.xxhash64("id", F.lit(seed)).alias("h")
    leads = listed.groupBy("value").agg(F.array(*[F.struct(*(x[c].alias(c) for c in ("id", "at", "bits"))) for x in (lead(), lead(chance(1)), lead(chance(2)))]).alias("leads"))
    stars = listed.join(leads, "value").select(F.explode(F.array_distinct("leads")).alias("lead"), F.struct("id", "at", "bits").alias("own")).select(whole(F.col("lead")).alias("x"), whole(F.col("own")).alias("y"))
    stars = stars.where("x.id <> y.id").where(alike).where(_fits("x", "y", percent)).select(*pair)
    links = _verified(stars.unionAll(short).distinct(), sketches, documents, words, percent, estimate_least, scratch, "stars")
    parts = scratch.save(graph.components(links, scratch), "parts")

    # Lists that hold several components even so: what is outside the smallest against what it isn't connected to.
    named = parts.select(F.col("node").alias("id"), "component")
    members = listed.join(named, "id", "left").select("value", "id", "at", "bits", F.coalesce("component", "id").alias("component"))
    members = scratch.save(members, "members")
    scratch.drop(listed)
    several = members.groupBy("value").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("value", "low")
    known = members.join(several, "value")
    known = scratch.save(known.select("value", "low", "component", whole(F.struct("id", "at", "bits")).alias("own"), late(F.col("at")).alias("late")), "open")
    scratch.drop(members)
    x = known.where("component <> low").select("value", "low", F.col("component").alias("cx"), F.col("own").alias("x"), F.col("late").alias("lx"))
    y = known.select("value", F.col("component").alias("cy"), F.col("own").alias("y"), F.col("late").alias("ly"))
    apart = f"cx <> cy and (cy = low or x.id < y.id) and not (lx and ly) and {alike} and {_fits('x', 'y', percent)}"
    rest = x.join(y, "value").where(apart).select(*pair).distinct()
    more = _verified(rest, sketches, documents, words, percent, estimate_least, scratch, "rest")
    scratch.drop(known)
    parts = scratch.save(graph.components(links.unionAll(more), scratch), "all-parts")

    classed = keyed.join(parts.select(F.col("node").alias("rep"), "component"), "rep", "left").select("n", "one", "two", F.coalesce("component", "rep").alias("component"))
    found = sets.join(classed, ["n", "one", "two"], "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id")
    ).dropDuplicates([id_col])
    return found.withColumn("kept", F.col(id_col) == F.col("component_id"))


def _further(rows: DataFrame, scratch: Scratch) -> DataFrame | None:
    """(id, mark, key) of what no id stands for alone: texts of null ids, second and further texts of an id; None if there are none.

    Keys are distinct and above all ids, in the order of id and mark.
    """
    several = rows.where("id is not null").groupBy("id").agg(F.min("mark").alias("first"), F.max("mark").alias("other")).where("first <> other").select("id", "first")
    more = rows.where("id is null").unionAll(rows.join(several, "id").where("mark <> first").select("id", "mark")).distinct()
    more = scratch.save(more, "further")
    if more.isEmpty():
        return None
    base = (rows.agg(F.max("id")).first()[0] or 0) + 1
    numbered = more.orderBy("id", "mark").rdd.zipWithIndex().map(lambda x: (x[0][0], x[0][1], base + x[1]))
    return scratch.save(rows.sparkSession.createDataFrame(numbered, "id long, mark string, key long"), "keys")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs without all but the smallest id of each group of near duplicates; all columns stay.

    Of rows equal in id and text one stays. Texts of null ids, and all but one
    of different texts with the same id, are compared as documents of their own
    that come after all ids; null is no id that rows have in common.
    """
    scratch = Scratch(docs.sparkSession, "minhash")
    mark = F.md5(F.coalesce(F.concat(F.lit("="), F.col(text_col).cast("string")), F.lit("")).cast("binary"))
    further = _further(docs.select(F.col(id_col).cast("long").alias("id"), mark.alias("mark")), scratch)
    own = F.col(id_col).cast("long")
    if further is None:
        keyed = docs.withColumn("__key", own)
    else:
        further = further.select(F.col("id").alias("__id"), F.col("mark").alias("__of"), F.col("key").alias("__further"))
        keyed = docs.join(further, (mark == F.col("__of")) & own.eqNullSafe(F.col("__id")), "left").withColumn("__key", F.coalesce("__further", own)).select(*docs.columns, "__key")
    gone = near_duplicates(keyed, id_col="__key", text_col=text_col, **how).where("not kept").select(F.col("__key").alias("__gone"))
    gone = scratch.save(gone, "gone")
    return keyed.join(gone, F.col("__key") == F.col("__gone"), "left_anti").dropDuplicates(["__key"]).drop("__key")
