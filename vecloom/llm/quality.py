"""Operator 8: quality by nearest-neighbour voting.

A text becomes the square roots of its relative frequencies of adjacent
character classes and of words that repeat one of the three before them,
weighted by how rarely labelled texts have them, and is projected on the leading singular vectors of the labelled sample (a latent
semantic space).  The labelled vectors, bounded by a parameter, are broadcast.
Exact cosine products of every document with all of them, block by block, give
its nearest neighbours; their labels vote with a power of their similarity as
weight, corrected for the sample's shares of the two labels.
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

from ..workspace import shared
from .labelled import ROWS, gathered, remainder, sample
from .textkernels import SPACES, WordHasher, break_table, pieces, trim, utf8

#: Bounds of the labelled sample, by label.
PER_CLASS = (1000, 1500)
DIMS, NEIGHBOURS, POWER, BLOCK = 48, 15, 6, 1024
CLASSES = 48


def class_table() -> np.ndarray:
    """Class of each byte: a-z one each, A-Z one, digits one, the space, line
    breaks, each common punctuation mark, other ASCII, other bytes."""
    table = np.full(256, 46, np.int64)
    table[128:] = 47
    table[97:123] = np.arange(26)
    table[65:91] = 26
    table[48:58] = 27
    table[32] = 28
    table[[10, 13, 9, 11, 12]] = 29
    for k, c in enumerate(".,;:!?'\"-()#&%$*"):
        table[ord(c)] = 30 + k
    return table


class Profile:
    """Vectors of texts before projection: float32, CLASSES squared, three repetitions and a constant."""

    def __init__(self):
        self.table = class_table()
        self.width = CLASSES * CLASSES + 4
        self.words = WordHasher(break_table(SPACES))

    def rows(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        n = len(off) - 1
        out = np.zeros((n, self.width), np.float32)
        out[:, -1] = 0.05
        if len(raw) < 2:
            return out
        cls = self.table[raw]
        text = np.repeat(np.arange(n), np.diff(off))
        inner = text[1:] == text[:-1]
        cell = text[1:] * (CLASSES * CLASSES) + cls[:-1] * CLASSES + cls[1:]
        counts = np.bincount(cell[inner], minlength=n * CLASSES * CLASSES).reshape(n, -1)
        out[:, :-4] = np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1))
        starts, ends, first = self.words.spans(raw, off)
        h = self.words.hashes(raw, starts, ends)
        n_words = np.diff(first)
        owner = np.repeat(np.arange(n), n_words)
        for lag in (1, 2, 3):
            again = (h[lag:] == h[:-lag]) & (owner[lag:] == owner[:-lag])
            out[:, -5 + lag] = np.sqrt(np.bincount(owner[lag:][again], minlength=n) / np.maximum(n_words, 1))
        return out


@dataclass
class Voters:
    """A fitted classifier: what the workers need."""

    weights: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    votes: np.ndarray

    @staticmethod
    def place(z: np.ndarray) -> np.ndarray:
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)

    def project(self, x: np.ndarray) -> np.ndarray:
        return self.place((x * self.weights) @ self.basis)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.project(x)
        k = min(NEIGHBOURS, len(self.vectors))
        best = np.full((len(z), 0), -2, np.float32)
        who = np.zeros((len(z), 0), np.int64)
        for a in range(0, len(self.vectors), BLOCK):
            sims = z @ self.vectors[a:a + BLOCK].T
            best = np.concatenate([best, sims], axis=1)
            who = np.concatenate([who, np.broadcast_to(np.arange(a, a + sims.shape[1]), sims.shape)], axis=1)
            if best.shape[1] > k:
                top = np.argpartition(-best, k - 1, axis=1)[:, :k]
                best, who = np.take_along_axis(best, top, 1), np.take_along_axis(who, top, 1)
        w = np.maximum(best.astype(np.float64), 1e-3) ** POWER * self.votes[who]
        return np.clip((w * self.labels[who]).sum(1) / w.sum(1), 0.0, 1.0)


def fit(rows: list, share: float) -> Voters:
    """Voters from (id, profile bytes, label) rows."""
    profile = Profile()
    if not rows:
        return Voters(np.ones(profile.width, np.float32), np.zeros((profile.width, 1), np.float32), np.zeros((1, 1), np.float32), np.array([share]), np.ones(1))
    x = np.stack([np.frombuffer(r[1], np.float16) for r in rows]).astype(np.float32)
    y = np.array([r[2] for r in rows], np.float64)
    df = (x > 0).mean(0)
    weights = np.log1p(1 / np.maximum(df, 1 / len(x))).astype(np.float32)
    weights[-4:] = 2, 1, 1, 1
    x *= weights
    rng = np.random.default_rng(8)
    dims = min(DIMS, len(x))
    q = np.linalg.qr(x @ rng.standard_normal((x.shape[1], dims + 8)).astype(np.float32))[0]
    for _ in range(3):
        q = np.linalg.qr(x @ (x.T @ q))[0]
    _, _, v = np.linalg.svd(q.T @ x, full_matrices=False)
    basis = np.ascontiguousarray(v[:dims].T).astype(np.float32)
    part = np.array([max(np.mean(y == c), 1e-9) for c in (0, 1)])
    votes = np.where(y == 1, share / part[1], (1 - share) / part[0])
    voters = Voters(weights, basis, np.zeros((0, dims), np.float32), y, votes)
    voters.vectors = voters.place(x @ basis).astype(np.float32)
    return voters


def fit_quality(docs: DataFrame, labels: DataFrame, train, per_class: tuple[int, int] = PER_CLASS, label: str = "quality") -> Voters:
    """Fit on a bounded sample of the rows that ``train`` (a condition on doc_id) allows."""

    def featurise(texts: pa.Array) -> list[bytes]:
        profile, out = Profile(), []
        for _, _, data, own in pieces(*utf8(texts)):
            out += [r.tobytes() for r in profile.rows(data, own).astype(np.float16)]
        return out

    chosen, share = sample(labels, label, train, per_class)
    return fit(gathered(docs, chosen, featurise), share)


def score_quality(docs: DataFrame, voters: Voters, *, text_col: str = "text", out: str = "score") -> DataFrame:
    """All columns of ``docs`` plus ``out``, a double from 0 to 1.

    The score depends on the text alone: equal texts, equal scores, so repeated
    rows and rows without an id are scored like any other.  Null and empty
    texts get the vote of the nearest labelled texts too; a very long text is
    profiled whole, by itself.  Of neighbours that tie for the last place any
    vote.  An empty table stays empty.  An existing column of the name ``out``
    is replaced.
    """
    spark = docs.sparkSession
    sent = shared(spark, voters)
    kept = [c for c in docs.columns if c != out]
    at = kept.index(text_col)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, profile = pickle.loads(sent.value), Profile()
        for batch in batches:
            for k in range(0, len(batch), ROWS):
                part = batch.slice(k, ROWS)
                scores = [model.score(profile.rows(data, own)) for _, _, data, own in pieces(*utf8(part.column(at)))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.concatenate(scores))], names=[*batch.schema.names, out])
        trim()

    body = docs.select(*[F.col(f"`{c}`") for c in kept])
    return body.mapInArrow(rows, T.StructType([*body.schema.fields, T.StructField(out, T.DoubleType())]))


def keep_good(docs: DataFrame, labels: DataFrame, *, least: float = 0.7) -> DataFrame:
    """Documents scored ``least`` or more, with their columns; rows stay as often as they are there, an empty table stays empty."""
    voters = fit_quality(docs, labels, remainder(F.col("doc_id"), 4) != 2)
    name = "score" + "_" * max(map(len, docs.columns))
    return score_quality(docs, voters, out=name).where(F.col(name) >= least).drop(name)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document: doc_id, held_out, score, predicted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    voters = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), remainder(F.col("doc_id"), 4) != 2)
    scored = score_quality(docs, voters)
    return scored.select(
        "doc_id", F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "score",
        F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))
