import pytest

from vecloom.llm import ngram_join
from vecloom.llm.ngram_join import link_counts, near_links

from .cases import edgy, none
from .test_ngram_join import corpus, shingles


def brute_links(rows, width, num):
    """(i, j) of all texts that link, i < j."""
    sets = [(i, shingles(t, width)) for i, t in rows]
    out = set()
    for a, (i, x) in enumerate(sets):
        for j, y in sets[a + 1:]:
            both = len(x & y)
            if both and 100 * both >= num * (len(x) + len(y) - both):
                out.add((min(i, j), max(i, j)))
    return out


@pytest.mark.parametrize("block,columns", [(256, 1 << 14), (7, 50)])
def test_every_link_of_a_large_class(spark, monkeypatch, block, columns):
    """Links inside classes too, in one block and in many."""
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "COLUMNS", columns)
    rows = corpus(6)
    rows += [(1000 + k, " ".join(f"b{i}" if i != 3 * k + 1 else f"x{k}" for i in range(120))) for k in range(40)]
    want = brute_links(rows, 4, 85)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    pairs, members = near_links(df, width=4, num=85)
    rep = {r["doc_id"]: r["representative_id"] for r in members.collect()}
    found = [(r["u"], r["v"]) for r in pairs.collect()]
    assert len(found) == len(set(found))
    assert want == {(i, j) for i in rep for j in rep if i < j and (rep[i] == rep[j] or tuple(sorted((rep[i], rep[j]))) in set(found))}
    counts = {r["doc_id"]: r["n_links"] for r in link_counts(df, width=4, num=85).collect()}
    assert counts == {i: sum(i in p for p in want) for i, _ in rows}


def test_links_of_awkward_rows(spark):
    got = sorted(tuple(r) for r in link_counts(edgy(spark)).collect())
    assert got == [(1, 1, 1), (1, 1, 1), (2, 2, 0), (3, 3, 0), (4, 4, 0), (5, 5, 0), (6, 6, 0), (7, 1, 1), (8, 8, 0)]
    assert link_counts(none(spark)).collect() == []
