"""Operator 10: toxicity by a counterfactually regularised linear classifier.

Features are the words a text contains.  A logistic model with an L1 penalty
is fitted on a bounded labelled sample.  Counterfactual copies of the sample's
texts take part: a text that names an identity group is copied with the term
swapped for another of its kind, one that names none with a term inserted and
with another of the kind in its place.  Copies keep the label, so a group's
name is seen as often in clean as in toxic texts, and the squared change of
the score between the two of a pair, and between either and a text that named
none, is a part of the loss.  A term so gets no weight of its own and none
that another of its kind has not, and neutral mentions of a group don't raise
the score.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..workspace import WRITING, settings, shared
from .labelled import ROWS, chosen_texts, gathered, remainder, sample
from .textkernels import WordHasher, break_table, pieces, utf8

#: Bounds of the labelled sample, by label.
PER_CLASS = (5000, 3000)
#: Words of the model, at most: the most telling ones of the sample.  A word counts from LEAST_TEXTS texts on.
MOST_WORDS, LEAST_TEXTS = 2000, 4
#: Pairs of counterfactual copies of texts that name a term, at most; pairs of each label for each term that is inserted;
#: and the weight of a copy beside the texts themselves.
COPIED, EACH, COPY_WEIGHT = 1500, 10, 0.2
LASSO, RIDGE, SWAPPED, STEPS = 1e-3, 2e-6, 4.0, 1000

#: Terms that may stand for one another, by kind.
IDENTITIES = (
    ("women", "men", "girls", "boys", "transgender", "nonbinary"),
    ("gay", "lesbian", "bisexual", "straight", "queer"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "arab", "african"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("mexican", "chinese", "german", "french", "american", "russian", "turkish", "indian"),
    ("disabled", "blind", "deaf", "elderly"),
    ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"), ("noirs", "blancs"),
    ("frauen", "männer"), ("muslime", "christen", "juden"), ("schwarze", "weiße"),
    ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"), ("negros", "blancos"),
)


def letters_only() -> np.ndarray:
    """Breaks of words: every ASCII character that is no letter."""
    return break_table("".join(chr(c) for c in range(128) if not chr(c).isalpha()))


class Vocabulary:
    """Distinct words of texts, as hashes."""

    def __init__(self):
        self.hasher = WordHasher(letters_only())

    def words(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words, and for each text the index of its first."""
        starts, ends, first = self.hasher.spans(raw, off)
        return self.hasher.hashes(raw, starts, ends), first

    def of(self, word: str) -> int:
        raw = np.frombuffer(word.encode(), np.uint8)
        return int(self.words(raw, np.array([0, len(raw)]))[0][0])


@dataclass
class Linear:
    """A fitted model: sorted word hashes, their weights, the bias."""

    words: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
        n = len(first) - 1
        total = np.full(n, self.bias)
        if len(self.words) and len(hashes):
            at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
            hit = np.flatnonzero(self.words[at] == hashes)
            text = np.searchsorted(first, hit, "right") - 1
            pair = np.unique(text * len(self.words) + at[hit])
            np.add.at(total, pair // len(self.words), self.weights[pair % len(self.words)])
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def counterfactuals(sets: list[np.ndarray], y: np.ndarray, kinds: list[list[int]], most: int = COPIED, each: int = EACH) -> list[tuple[int, int, int, float]]:
    """(text, term, other, weight): a term that the text names, or gets, and what stands in its place in the copy's counterpart.

    A text gives a pair for every term it names, ``most`` pairs at most, and
    for each of them the term is given to a text of the other label that names
    none, at the weight that makes the term as frequent there.  Beside them
    every two neighbouring terms of a kind are given to ``each`` texts of
    either label, in turn, so that all terms are given to both labels alike.
    """
    kinds = [k for k in kinds if len(k) > 1]
    kind_of = {t: kind for kind in kinds for t in kind}
    terms = np.array(sorted(kind_of), np.uint64)
    count = {c: max(1, int((y == c).sum())) for c in (0, 1)}
    named, free, turn = [], {0: [], 1: []}, {0: 0, 1: 0}
    for i, s in enumerate(sets):
        own = s[np.isin(s, terms)].tolist()
        named += [(i, t, [x for x in kind_of[t] if x != t][(i + n) % (len(kind_of[t]) - 1)], COPY_WEIGHT) for n, t in enumerate(own)]
        if not own:
            free[int(y[i])].append(i)

    def next_of(c: int) -> int:
        turn[c] += 1
        return free[c][(turn[c] - 1) % len(free[c])]

    out = named[:most]
    for i, t, other, _ in named[:most]:
        c = int(y[i])
        if free[1 - c]:
            out.append((next_of(1 - c), t, other, (1 + COPY_WEIGHT) * count[1 - c] / count[c]))
    return out + [(next_of(c), t, kind[(n + 1) % len(kind)], COPY_WEIGHT) for c in (0, 1) if free[c] for kind in kinds for n, t in enumerate(kind) for _ in range(each)]


def _largest(times, size: int) -> float:
    """A bound just above the largest eigenvalue of a positive matrix, by power iteration on ``times``."""
    v = np.ones(size)
    norm = 0.0
    for _ in range(50):
        u = times(v)
        norm = float(np.linalg.norm(u))
        if norm == 0:
            return 0.0
        v = u / norm
    return 1.1 * norm


def _descend(x: np.ndarray, y: np.ndarray, balance: np.ndarray, laplacian: np.ndarray, lasso: float) -> tuple[np.ndarray, float]:
    """Accelerated proximal gradient; the bias goes unpenalised."""

    def curvature(v: np.ndarray) -> np.ndarray:
        r = balance * (x @ v[:-1].astype(np.float32) + v[-1])
        return np.append(0.25 * (x.T @ r.astype(np.float32)) + 2 * laplacian @ v[:-1].astype(np.float32), 0.25 * r.sum())

    lipschitz = _largest(curvature, x.shape[1] + 1) + 2 * RIDGE
    w, b = np.zeros(x.shape[1]), 0.0
    v, c, t = w.copy(), b, 1.0
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(x @ v.astype(np.float32) + c, -40, 40)))
        r = balance * (p - y)
        g = x.T @ r.astype(np.float32) + 2 * laplacian @ v.astype(np.float32) + 2 * RIDGE * v
        new = v - g / lipschitz
        new = np.sign(new) * np.maximum(np.abs(new) - lasso / lipschitz, 0)
        new_b = c - r.sum() / lipschitz
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = new + (t - 1) / t2 * (new - w), new_b + (t - 1) / t2 * (new_b - b)
        w, b, t = new, new_b, t2
    return w, b


def identity_words(identities=IDENTITIES) -> list[list[int]]:
    vocabulary = Vocabulary()
    return [[vocabulary.of(w) for w in kind] for kind in identities]


def _telling(df: np.ndarray, pos: np.ndarray, share: float, words: int) -> np.ndarray:
    """Likelihood ratio of a word's label counts against the overall share; negative below the bound, which grows with the
    number of words tried, so that words of a few texts don't pass by chance."""
    neg = df - pos
    z = 2 * (pos * np.log(np.maximum(pos, 1e-9) / (df * share)) + neg * np.log(np.maximum(neg, 1e-9) / (df * (1 - share))))
    return np.where((df < LEAST_TEXTS) | (z < 2 * np.log(words) + 4), -1.0, z)


def fit(sets: list[np.ndarray], y: np.ndarray, identities=IDENTITIES, words: np.ndarray | None = None, copied: int = COPIED) -> Linear:
    """Fit on texts' distinct word hashes and their labels; ``words``, if given, are the sorted hashes to choose weights for."""
    if len(y) == 0 or y.min() == y.max():
        p = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.01
        return Linear(np.zeros(0, np.uint64), np.zeros(0), float(np.log(p / (1 - p))))
    kinds = identity_words(identities)
    terms = np.array(sorted({h for k in kinds for h in k}), np.uint64)
    every = np.concatenate(sets)
    text = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    if words is None:
        known, at = np.unique(every, return_inverse=True)
        z = _telling(np.bincount(at, minlength=len(known)), np.bincount(at, y[text], len(known)), y.mean(), len(known))
        pick = np.argsort(-z, kind="stable")[:MOST_WORDS]
        words = np.sort(known[pick[z[pick] >= 0]])
    chosen = np.union1d(words, terms)
    pairs = counterfactuals(sets, y, kinds, copied)
    n, size = len(sets), len(chosen)
    x = np.zeros((n + 2 * len(pairs), size), np.float32)
    at = np.minimum(np.searchsorted(chosen, every), size - 1)
    use = chosen[at] == every
    x[text[use], at[use]] = 1
    owner = np.array([p[0] for p in pairs], np.int64)
    laplacian = np.zeros((size, size), np.float32)
    for k, (i, a, b, _) in enumerate(pairs):
        ia, ib = int(np.searchsorted(chosen, np.uint64(a))), int(np.searchsorted(chosen, np.uint64(b)))
        for row, has, not_ in ((n + 2 * k, ia, ib), (n + 2 * k + 1, ib, ia)):
            x[row] = x[i]
            x[row, not_], x[row, has] = 0, 1
        # the two copies' scores differ by the two weights, and from a text that names neither by one each
        laplacian[[ia, ib], [ia, ib]] += 1 if x[i, ia] else 2
        laplacian[[ia, ib], [ib, ia]] -= 1
    laplacian *= SWAPPED / max(1, len(pairs))
    whole = np.concatenate([y, np.repeat(y[owner], 2)])
    weight = np.concatenate([np.ones(n), np.repeat([p[3] for p in pairs], 2)])
    for c in (0, 1):
        weight[whole == c] *= 0.5 / weight[whole == c].sum()
    w, b = _descend(x, whole, weight, laplacian, LASSO)
    # the penalty that chose the words also shrinks them, so the chosen ones are fitted again without it
    live = np.flatnonzero(w)
    x, chosen, laplacian = np.ascontiguousarray(x[:, live]), chosen[live], laplacian[np.ix_(live, live)]
    w, b = _descend(x, whole, weight, laplacian, LASSO / 100)
    live = w != 0
    return Linear(chosen[live], w[live], float(b))


def telling_words(docs: DataFrame, chosen: DataFrame, share: float) -> np.ndarray:
    """Sorted hashes of the sample's most telling words, MOST_WORDS at most, counted over its whole texts by an aggregation."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary()
        for batch in batches:
            label = batch.column(1).to_numpy()
            for i, _, data, own in pieces(*utf8(batch.column(3))):
                h, first = vocabulary.words(data, own)
                for k, (a, b) in enumerate(zip(first[:-1], first[1:])):
                    words = np.unique(h[a:b])
                    yield pa.record_batch({"word": pa.array(words.view(np.int64)), "label": pa.array(np.full(len(words), label[i + k], np.int32))})

    with settings(docs.sparkSession, WRITING):
        counts = chosen_texts(docs, chosen).mapInArrow(rows, "word long, label int").groupBy("word").agg(F.count(F.lit(1)).alias("df"), F.sum("label").alias("pos"))
        words = max(1, counts.count())
        df, pos = F.col("df").cast("double"), F.col("pos").cast("double")
        near = lambda k, s: k * F.log(F.greatest(k, F.lit(1e-9)) / (df * F.lit(s)))
        z = 2 * (near(pos, share) + near(df - pos, 1 - share))
        best = counts.withColumn("z", z).where((F.col("df") >= LEAST_TEXTS) & (F.col("z") >= 2 * float(np.log(words)) + 4))
        got = best.orderBy(F.desc("z"), "word").limit(MOST_WORDS).select("word").collect()
    return np.sort(np.array([r["word"] for r in got], np.int64).view(np.uint64))


def fit_toxicity(docs: DataFrame, labels: DataFrame, train, per_class: tuple[int, int] = PER_CLASS, label: str = "toxic", identities=IDENTITIES, copied: int = COPIED) -> Linear:
    """Fit on a bounded sample of the rows that ``train`` (a condition on doc_id) allows.

    The sample's words are counted where its texts are; the driver gets, for
    each text, only those of the chosen words that it has.  Of an id with
    several texts one is learnt from.
    """
    chosen, _ = sample(labels, label, train, per_class)
    share = chosen.agg(F.avg("label")).first()[0]
    if share is None or share in (0.0, 1.0):
        return fit([], np.zeros(0) if share is None else np.array([share]), identities)
    words = telling_words(docs, chosen, share)
    wanted = np.union1d(words, np.array(sorted({h for k in identity_words(identities) for h in k}), np.uint64))

    def featurise(texts: pa.Array) -> list[bytes]:
        vocabulary, out = Vocabulary(), []
        for _, _, data, own in pieces(*utf8(texts)):
            h, first = vocabulary.words(data, own)
            out += [np.intersect1d(h[a:b], wanted).tobytes() for a, b in zip(first[:-1], first[1:])]
        return out

    rows = gathered(docs, chosen, featurise)
    return fit([np.frombuffer(r[1], np.uint64) for r in rows], np.array([r[2] for r in rows], float), identities, words, copied)


def score_toxicity(docs: DataFrame, model: Linear, *, text_col: str = "text", out: str = "score") -> DataFrame:
    """All columns of ``docs`` plus ``out``, a double from 0 to 1.

    The score depends on the text alone, so repeated rows, and rows without an
    id, are scored like any other.  Null and empty texts have no words and get
    the score of none; a very long text is read whole.  An empty table stays
    empty.  An existing column of the name ``out`` is replaced.
    """
    spark = docs.sparkSession
    sent = shared(spark, model)
    kept = [c for c in docs.columns if c != out]
    at = kept.index(text_col)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        linear, vocabulary = pickle.loads(sent.value), Vocabulary()
        for batch in batches:
            for k in range(0, len(batch), ROWS):
                part = batch.slice(k, ROWS)
                scores = [linear.score(*vocabulary.words(data, own)) for _, _, data, own in pieces(*utf8(part.column(at)))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.concatenate(scores))], names=[*batch.schema.names, out])

    body = docs.select(*[F.col(f"`{c}`") for c in kept])
    return body.mapInArrow(rows, T.StructType([*body.schema.fields, T.StructField(out, T.DoubleType())]))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document: doc_id, held_out, score, predicted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), remainder(F.col("doc_id"), 5) != 0)
    scored = score_toxicity(docs, model)
    return scored.select(
        "doc_id", F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
