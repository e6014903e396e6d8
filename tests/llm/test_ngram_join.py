import random

import pytest

from vecloom.llm import ngram_join
from vecloom.llm.components import components
from vecloom.llm.ngram_join import keep_one, near_duplicates

from .cases import edgy, none


def shingles(text, width):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    return {tuple(w[i:i + width]) for i in range(max(len(w) - width + 1, 1))} if w else set()


def brute(rows, width, num, den):
    ids = sorted({i for i, _ in rows if i is not None})
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    sets = [(i, shingles(t, width)) for i, t in rows if i is not None]
    for a, (i, x) in enumerate(sets):
        for j, y in sets[a + 1:]:
            both = len(x & y)
            if both and den * both >= num * (len(x) + len(y) - both):
                r, s = find(i), find(j)
                root[max(r, s)] = min(r, s)
    return {i: find(i) for i in ids}, {(i, len(x)) for i, x in sets}


def corpus(seed, n=160):
    """Groups of near copies around the threshold, shared passages, tiny texts, exact copies."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(400)}"
    passage = [word() for _ in range(60)]
    bases = [[word() for _ in range(rng.choice([3, 5, 20, 60, 150]))] for _ in range(12)]
    rows = []
    for i in range(n):
        t = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            t[rng.randrange(len(t))] = word()
        if rng.random() < 0.2:
            t += passage
        if rng.random() < 0.1:
            t = passage + [word() for _ in range(rng.randrange(12))]
        rows.append((i * 3, " ".join(t) if rng.random() < 0.5 else "\n".join(t).upper()))
    return rows


@pytest.mark.parametrize("seed,width,num", [(1, 4, 85), (2, 5, 80), (3, 4, 50), (4, 1, 85), (5, 3, 100)])
def test_components_against_brute_force(spark, monkeypatch, seed, width, num):
    # small bounds, so that common grams, several flushes and several buckets take part
    monkeypatch.setattr(ngram_join, "LEAST_COMMON", 3)
    monkeypatch.setattr(ngram_join, "COUNTED", 500)
    monkeypatch.setattr(ngram_join, "BUCKET_GRAMS", 16)
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = near_duplicates(df, width=width, num=num, den=100).collect()
    want, sizes = brute(rows, width, num, 100)
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert {(r["doc_id"], r["n_shingles"]) for r in got} == sizes


@pytest.mark.parametrize("seed,num", [(11, 85), (12, 60), (13, 100)])
def test_hot_grams_and_stars_in_many_cells(spark, monkeypatch, seed, num):
    """Postings of nearly every gram are dealt to several cells, stars to several places."""
    from vecloom.llm import components as stars

    monkeypatch.setattr(ngram_join, "LEAST_COMMON", 2)
    monkeypatch.setattr(ngram_join, "HOT", 2)
    monkeypatch.setattr(stars, "STAR", 3)
    monkeypatch.setattr(stars, "HELD", 5)
    rows = corpus(seed, 220)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), width=4, num=num, den=100).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == brute(rows, 4, num, 100)[0]


def test_no_pair_is_verified_twice(spark, monkeypatch):
    seen = []
    verified = ngram_join._verified

    def watched(pairs, *how):
        seen.extend((r["u"], r["v"]) for r in pairs.collect())
        return verified(pairs, *how)

    monkeypatch.setattr(ngram_join, "_verified", watched)
    rows = corpus(21, 300)
    near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=4, num=95, den=100).count()
    assert len(seen) > 10 and len(seen) == len(set(seen))


def test_links_rest_on_words_not_on_hashes(spark, monkeypatch):
    """Structured words, and every two grams under one hash: only words that are equal link."""
    a, b = "a", "b"
    for _ in range(11):
        a, b = a + b, b + a
    df = spark.createDataFrame([(1, a), (2, b), (3, a.upper()), (4, f" {b}\n"), (5, "c")], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in near_duplicates(df).collect()} == {1: 1, 2: 2, 3: 1, 4: 2, 5: 5}
    import numpy as np

    from vecloom.llm.textkernels import Shingler, same_grams

    x, y, z = (Shingler(2).detail(np.frombuffer(t.encode(), np.uint8)) for t in ("p q r s", "p Q r\ns", "k l m n"))
    assert same_grams(x, y) == 3 and same_grams(x, z) == 0
    assert same_grams(x, (x[0], *z[1:])) == 0


def test_large_group_of_near_copies(spark):
    """One group, most pairs of which don't link directly: the class still comes out whole."""
    rng = random.Random(7)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(250):
        t = list(base)
        for _ in range(rng.randrange(1, 4)):
            t[rng.randrange(120)] = f"x{i}-{rng.random()}"
        rows.append((i, " ".join(t)))
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=4, num=85).collect()}
    assert got == brute(rows, 4, 85, 100)[0]


def test_edges(spark):
    df = edgy(spark)
    got = near_duplicates(df).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == [
        (1, 8, 1), (1, 8, 1), (2, 0, 2), (3, 0, 3), (4, 0, 4), (5, 977, 5), (6, 1, 6), (7, 8, 1), (8, 3, 8)]
    kept = keep_one(df)
    assert kept.columns == df.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "1", "2", "3", "4", "5", "6", "8", "None", "None"])
    assert near_duplicates(none(spark)).collect() == [] == keep_one(none(spark)).collect()


@pytest.mark.parametrize("held,star", [(1 << 20, 1024), (40, 7)])
def test_component_steps(spark, monkeypatch, held, star):
    from vecloom.llm import components as stars

    monkeypatch.setattr(stars, "HELD", held)
    monkeypatch.setattr(stars, "STAR", star)
    rng = random.Random(2)
    chain = [(i, i + 1) for i in range(300)]
    star = [(1000, 1000 + i) for i in range(1, 200)]
    edges = chain + star + [(b, a) for a, b in star] + [(5000, 5000), (7, None), (600, 601)]
    rng.shuffle(edges)
    got = {r["u"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long").repartition(7)).collect()}
    assert got == {**{i: 0 for i in range(1, 301)}, **{1000 + i: 1000 for i in range(1, 200)}, 601: 600}
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []
