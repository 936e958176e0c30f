"""Near-duplicate operators against brute force."""

import random
import re

import numpy as np
import pytest

from foliolake.llm import embeddings, minhash, words


def shingle_sets(rows, k):
    out = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        out[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    return out


def components(ids, link):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(ids)
    for a in range(len(ids)):
        for b in range(a):
            if link(ids[a], ids[b]):
                x, y = find(ids[a]), find(ids[b])
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def edited(rnd, words, rate):
    return [w if rnd.random() > rate else f"x{rnd.randrange(10**6)}" for w in words]


def fixture():
    """Exact and near copies by chance edits, a passage that many share, short, blank and null texts, ties."""
    rnd = random.Random(3)
    word = lambda: f"w{int(rnd.paretovariate(0.6)) % 5000}"
    passage = [word() for _ in range(55)]
    rows, n = [], 0
    for _ in range(12):
        base = [word() for _ in range(rnd.randint(3, 120))]
        for _ in range(rnd.choice([1, 2, 8, 25])):
            rows.append((n, " ".join(edited(rnd, base, rnd.choice([0, 0.02, 0.05, 0.1])))))
            n += 1
    for _ in range(40):
        rows.append((n, " ".join([word() for _ in range(rnd.randint(5, 40))] + passage)))
        n += 1
    for text in ["", None, "  \n\t", "one", "One", "one two", "ONE  two", "a b c d e", "a b c d f", "é É", "\u00a0"]:
        rows.append((n, text))
        n += 1
    return rows


@pytest.mark.parametrize("k", [2, 5])
def test_minhash(spark, k):
    rows = fixture()
    docs = spark.createDataFrame([(i, t, "z", 1, 2) for i, t in rows], "doc_id long, text string, id string, n long, value long")
    got = {r.doc_id: r for r in minhash.near_duplicates(docs, words=k).collect()}
    sets = shingle_sets(rows, k)
    link = lambda a, b: bool(sets[a]) and bool(sets[b]) and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    want = components(sets, link)
    assert {i: r.component_id for i, r in got.items()} == want
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert all(r.kept == (i == r.component_id) for i, r in got.items())
    kept = minhash.keep_first(docs, words=k)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted({c for c in want.values()})


def test_minhash_long_lists_and_exact(spark, monkeypatch):
    """Lists too long to be compared in place, and bounds set to verify all candidates, give the same."""
    rows = fixture()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, words=2).collect()}
    monkeypatch.setattr(minhash, "SHORT", 2)
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, words=2).collect()} == want
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, words=2, bits_least=0, estimate_least=0.0).collect()} == want


def test_words_in_pieces(monkeypatch):
    rnd = random.Random(0)
    texts = ["", "a", " ", "x" * 500, "é ü " * 90, " ".join("w" * rnd.randint(1, 9) for _ in range(200)), "end "]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    whole = words._words(offsets, data)
    for size in (1, 7, 64, 300):
        monkeypatch.setattr(words, "CHUNK", size)
        assert all(np.array_equal(a, b) for a, b in zip(words.words(offsets, data), whole))


def test_minhash_empty_repeated_null(spark):
    schema = "doc_id long, text string"
    assert minhash.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = spark.createDataFrame([(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (7, "a b c d e f " * 20_000)], schema)
    assert sorted((r.doc_id, r.component_id) for r in minhash.near_duplicates(rows).collect()) == [(5, 5), (7, 7)]


def test_keep_first_null_and_shared_ids(spark):
    text = lambda n: " ".join(f"t{n}x{i}" for i in range(30))
    rows = [(None, text(1)), (None, text(2)), (None, text(2)), (None, text(3)), (None, None), (None, ""), (3, text(3)), (5, text(5)), (5, text(6)), (5, text(6)), (5, text(3)), (7, text(6)), (8, text(8)), (8, text(8))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = minhash.keep_first(docs, words=5)
    assert kept.schema == docs.schema
    got = sorted(map(tuple, kept.collect()), key=str)
    texts = [t for _, t in got]
    assert sorted(texts, key=str) == sorted([text(i) for i in (1, 2, 3, 5, 6, 8)] + [None, ""], key=str) and set(got) <= set(rows)
    assert (3, text(3)) in got and {(None, text(1)), (None, text(2)), (5, text(5)), (8, text(8)), (None, None), (None, "")} <= set(got)


def test_retained_loses_no_pair():
    rnd = random.Random(1)
    for _ in range(3000):
        a = set(rnd.sample(range(60), rnd.randint(1, 40)))
        b = set(x for x in a if rnd.random() > 0.12) | set(rnd.sample(range(60, 90), rnd.randint(0, 4)))
        if b and 100 * len(a & b) >= 80 * len(a | b):
            assert set(sorted(a)[: minhash.retained(len(a), 80)]) & set(sorted(b)[: minhash.retained(len(b), 80)])


def test_embeddings(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(40, 24))
    x = np.concatenate([base, base[:5] * 3, base[0] + rng.normal(size=(60, 24)) * 0.12, base[1] + rng.normal(size=(60, 24)) * 0.3, base[2:3].repeat(30, axis=0)]).astype(np.float32)
    odd = [None, [0.0] * 24, [None] + [1.0] * 23, [float("nan")] + [1.0] * 23, [float("inf")] + [1.0] * 23, []]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(1000 + i, v, 1) for i, v in enumerate(odd)] + [(2000, [1.0, 2.0], 1), (2001, [2.0, 4.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rep int")
    got = {r.vec_id: r for r in embeddings.near_duplicates(df).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    cos = u @ u.T
    want = components(range(len(x)), lambda a, b: cos[a, b] >= 0.95)
    assert {i: got[i].component_id for i in want} == want
    assert [got[i].n_links for i in range(len(x))] == [int((cos[i] >= 0.95).sum()) - 1 for i in range(len(x))]
    assert all(got[1000 + i].n_links == 0 and got[1000 + i].kept for i in range(len(odd)))
    assert (got[2000].n_links, got[2001].component_id) == (1, 2000)
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_embeddings_of_extreme_size(spark):
    rows = [(1, [1.0, 2.0]), (2, [1e200, 2e200]), (3, [1e-200, 2e-200]), (4, [-1e300, 1e300]), (5, [5e-324, 0.0]), (6, [1.0, 0.0])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4), 5: (1, 5), 6: (1, 5)}


@pytest.mark.parametrize("least", [0.95, 0.8])
def test_plan_deals_every_link(least):
    """Each linked pair meets in exactly one leaf, pivots and cuts included."""
    rng = np.random.default_rng(1)
    y = embeddings.unit(np.concatenate([rng.normal(size=(300, 6)), rng.normal(size=(1, 6)) + rng.normal(size=(300, 6)) * 0.05]))
    plan = embeddings.Plan(np.eye(6), y[::7], 40_000, least)
    assert len(plan.boxes) > 2 and len(plan.pivots)
    met = {}
    for leaf, own, home in plan.deal(y):
        met.setdefault(leaf, ([], []))[0 if home else 1].extend(own.tolist())
    seen = {}
    for leaf, (homes, guests) in met.items():
        for i, a in enumerate(homes):
            for b in homes[i + 1 :] + guests:
                key = (min(a, b), max(a, b))
                seen[key] = seen.get(key, 0) + 1
    cos = y @ y.T
    for a, b in zip(*np.nonzero(np.triu(cos >= least, 1))):
        assert seen.get((a, b)) == 1


