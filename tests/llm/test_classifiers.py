import random
from functools import cache

import numpy as np
from pyspark.sql import functions as F

from vecloom.llm.quality import NEIGHBOURS, POWER, Profile, fit_quality, keep_good, op8_quality, score_quality
from vecloom.llm.textkernels import utf8
from vecloom.llm.toxicity import IDENTITIES, Vocabulary, counterfactuals, fit, fit_toxicity, op10_toxicity, score_toxicity

from .cases import edgy, labels, none

BIG = "/root/testdata/sf0.01"


def accuracy(got, spark, sf, label):
    known = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(r["predicted"], known[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in known]
    return sum(a == b for a, b in held) / len(held)


def test_held_out_accuracy(spark):
    got = op8_quality(spark, BIG).collect()
    assert len(got) == 1000 and all(0 <= r["score"] <= 1 for r in got) and accuracy(got, spark, BIG, "quality") >= 0.95
    got = op10_toxicity(spark, BIG).collect()
    assert len(got) == 1000 and all(0 <= r["score"] <= 1 for r in got) and accuracy(got, spark, BIG, "toxic") >= 0.93


def test_votes_are_exact(spark):
    """The blocked search gives the votes of a plain one."""
    import pyarrow as pa

    docs = spark.read.parquet(f"{BIG}/documents.parquet").select("doc_id", "text")
    voters = fit_quality(docs, spark.read.parquet(f"{BIG}/labels.parquet"), F.lit(True))
    x = Profile().rows(*utf8(pa.array([r["text"] for r in docs.limit(40).collect()])))
    z = voters.project(x)
    sims = z @ voters.vectors.T
    for row, score in zip(sims, voters.score(x)):
        top = np.argsort(-row, kind="stable")[:NEIGHBOURS]
        w = np.maximum(row[top].astype(float), 1e-3) ** POWER * voters.votes[top]
        assert abs(score - (w * voters.labels[top]).sum() / w.sum()) < 1e-4


def test_quality_edges(spark):
    df = edgy(spark)
    some = labels(spark, [(1, 1, 0), (7, 1, 0), (6, 0, 1), (8, 0, 1), (None, 1, 0), (5, None, None), (1, 1, 0), (9, 7, 7)])
    for known in (some, some.limit(0)):
        voters = fit_quality(df, known, F.lit(True))
        out = score_quality(df, voters, out="score")
        assert set(out.columns) == set(df.columns) and all(0 <= r["score"] <= 1 for r in out.collect()) and out.count() == df.count()
        same = {r["text"]: r["score"] for r in out.collect()}
        assert len({r["score"] for r in out.collect() if r["doc_id"] == 1}) == 1 and len(same) == 9
        model = fit_toxicity(df, known, F.lit(True))
        assert all(0 <= r["score"] <= 1 for r in score_toxicity(df, model).collect())
    assert keep_good(df, some).columns == df.columns
    assert score_quality(none(spark), voters).collect() == [] == keep_good(none(spark), some).collect()
    assert score_toxicity(none(spark), model).collect() == []


def toy(n=600, seed=5):
    """Texts where group names come mostly with insults, though only insults make a text toxic."""
    rng = random.Random(seed)
    plain = [f"word{i}" for i in range(150)]
    texts, y = [], []
    for _ in range(n):
        toxic = rng.random() < 0.4
        t = [rng.choice(plain) for _ in range(20)]
        if rng.random() < (0.9 if toxic else 0.05):
            t.append("muslim")
        if rng.random() < 0.2:
            t.append("christian")
        if toxic and rng.random() < 0.9:
            t.append(rng.choice(["idiot", "scum"]))
        texts.append(" ".join(t))
        y.append(float(toxic))
    return texts, np.array(y)


def test_swapping_terms_lowers_false_positives(spark):
    import pyarrow as pa

    texts, y = toy()
    vocabulary = Vocabulary()
    h, first = vocabulary.words(*utf8(pa.array(texts)))
    sets = [np.unique(h[a:b]) for a, b in zip(first[:-1], first[1:])]
    two = [np.array(x, np.uint64) for x in ([5, 9], [1], [8])]
    got = counterfactuals(two, np.array([1, 0, 0]), [[1, 2, 3], [7]], each=1)
    assert [p[:3] for p in got] == [(1, 1, 3), (0, 1, 3), (2, 1, 2), (2, 2, 3), (2, 3, 1), (0, 1, 2), (0, 2, 3), (0, 3, 1)]
    assert got[1][3] > got[0][3] and counterfactuals(two, np.array([1, 0, 0]), []) == []

    def neutral(model):
        mentions = [f"word{i} word{i + 1} a muslim neighbour" for i in range(60)]
        return model.score(*vocabulary.words(*utf8(pa.array(mentions))))

    fair, plain = fit(sets, y, IDENTITIES), fit(sets, y, ())
    assert (neutral(plain) >= 0.5).mean() > 0.9
    assert neutral(fair).mean() < neutral(plain).mean() and (neutral(fair) >= 0.5).mean() < 0.1
    a, b = (fair.score(*vocabulary.words(*utf8(pa.array([f"one {w} here"]))))[0] for w in ("muslim", "christian"))
    assert abs(a - b) < 0.1
    assert fair.score(*vocabulary.words(*utf8(pa.array(["you IDIOT, go"]))))[0] >= 0.5


def test_labels_of_held_out_rows_are_not_learnt(spark):
    """Flipping every held-out label changes no score."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    known = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    from vecloom.llm.labelled import remainder

    out = []
    for flip in (False, True):
        held = remainder(F.col("doc_id"), 4) == 2
        rows = known.withColumn("quality", F.when(held & F.lit(flip), 1 - F.col("quality")).otherwise(F.col("quality")))
        scored = score_quality(docs, fit_quality(docs, rows, remainder(F.col("doc_id"), 4) != 2))
        out.append({r["doc_id"]: r["score"] for r in scored.collect()})
    assert out[0] == out[1]


def split(text):
    """Words by the rule of the classifier: letters, and all characters beyond ASCII, A-Z folded."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return {w for w in "".join(c if c.isalpha() or ord(c) > 127 else " " for c in low).split(" ") if w}


def test_scores_against_brute_force(spark):
    """Every score is the logistic sum of the weights of the words a text has; weights come through the whole fit."""
    docs = spark.read.parquet(f"{BIG}/documents.parquet").select("doc_id", "text")
    model = fit_toxicity(docs, spark.read.parquet(f"{BIG}/labels.parquet"), F.lit(True))
    of = cache(Vocabulary().of)
    weight = dict(zip(model.words.tolist(), model.weights.tolist()))
    assert weight
    for r in score_toxicity(docs, model).collect():
        total = model.bias + sum(weight.get(of(w), 0.0) for w in split(r["text"]))
        assert abs(r["score"] - 1 / (1 + np.exp(-total))) < 1e-9


def test_words_are_chosen_alike_here_and_there(spark):
    """The aggregation and the plain count choose the same words, and so the same model."""
    docs = spark.read.parquet(f"{BIG}/documents.parquet").select("doc_id", "text")
    known = spark.read.parquet(f"{BIG}/labels.parquet")
    model = fit_toxicity(docs, known, F.lit(True))
    toxic = {r["doc_id"]: r["toxic"] for r in known.collect() if r["toxic"] is not None}
    of = cache(Vocabulary().of)
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] in toxic)
    sets = [np.array(sorted(of(w) for w in split(t)), np.uint64) for _, t in rows]
    plain = fit(sets, np.array([toxic[i] for i, _ in rows], float))
    assert plain.words.tolist() == model.words.tolist() and np.allclose(plain.weights, model.weights, atol=1e-4)


def test_group_names_carry_no_weight_after_the_query_fit(spark):
    """Labels that name no group: the counterfactual copies still hold a term's weight at nothing."""
    docs = spark.read.parquet(f"{BIG}/documents.parquet").select("doc_id", "text")
    model = fit_toxicity(docs, spark.read.parquet(f"{BIG}/labels.parquet"), F.lit(True))
    vocabulary, weight = Vocabulary(), dict(zip(model.words.tolist(), model.weights.tolist()))
    assert max(abs(weight.get(vocabulary.of(w), 0.0)) for kind in IDENTITIES for w in kind) < 0.1


def test_one_text_for_a_repeated_id(spark):
    from vecloom.llm.labelled import gathered, sample

    rows = [(1, f"text number {i}") for i in range(3000)] + [(2, "other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    chosen, _ = sample(labels(spark, [(1, 1, 0), (2, 0, 1), (3, 1, 1)]), "toxic", F.lit(True), (10, 10))
    got = gathered(docs, chosen, lambda texts: [t.encode() for t in texts.to_pylist()])
    assert [(r[0], r[2]) for r in got] == [(1, 0), (2, 1)]
    assert got == gathered(docs.repartition(7), chosen, lambda texts: [t.encode() for t in texts.to_pylist()])
