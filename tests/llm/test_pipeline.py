import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from vecloom.llm.mixing import mix
from vecloom.llm.ngram_join import near_duplicates
from vecloom.llm.quality import fit_quality, score_quality
from vecloom.llm.labelled import remainder

from .cases import edgy
from .test_native_operators import brute_hits, words


def test_each_stage_takes_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_duplicates", "decontamination", "mixing", "token_ids"]
    scores = {r["doc_id"]: r["score"] for r in score_quality(docs, fit_quality(docs, spark.read.parquet(f"{sf}/labels.parquet"), remainder(F.col("doc_id"), 4) != 2)).collect()}
    good = stages["quality"](spark, docs, sf)
    assert good.columns == docs.columns and {r["doc_id"] for r in good.collect()} == {i for i, s in scores.items() if s >= 0.7}
    good = good.cache()
    one = stages["near_duplicates"](spark, good, sf).cache()
    classes = {r["component_id"] for r in near_duplicates(good, width=5, num=80).collect()}
    assert one.columns == docs.columns and {r["doc_id"] for r in one.collect()} == classes
    clean = stages["decontamination"](spark, one, sf).cache()
    assert all(r["n_chars"] == len(r["text"]) for r in clean.collect())
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    before, after = {r["doc_id"]: r["text"] for r in one.collect()}, {r["doc_id"]: r["text"] for r in clean.collect()}
    for i, text in before.items():
        hit, _ = brute_hits(text, items)
        n = len(words(text))
        if not hit:
            assert after[i] == text
        elif 2 * len(hit) >= n:
            assert i not in after
        else:
            assert words(after[i]) == [w for k, w in enumerate(words(text)) if k not in hit]
    mixed = stages["mixing"](spark, clean, sf).cache()
    copies = {r["doc_id"]: r["copies"] for r in mix(clean).collect()}
    taken = {r["doc_id"]: r["n"] for r in mixed.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert mixed.columns == docs.columns and taken == {i: c for i, c in copies.items() if c}
    last = stages["token_ids"](spark, mixed, sf).collect()
    assert len(last) == mixed.count()
    from .test_media_and_tokens import own_tokenizer

    lib, start = own_tokenizer(), 0
    rows = sorted((r["doc_id"], r["text"]) for r in mixed.collect())
    for g, (i, text) in zip(sorted(last, key=lambda r: r["start"]), rows):
        ids = np.array([*lib.encode(text, add_special_tokens=False).ids, 2], "<u4")
        assert (g["doc_id"], g["start"], g["n_tokens"], g["ids_crc32"]) == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_stages_take_awkward_rows(spark, sf):
    df = edgy(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, df, sf).columns == df.columns, name
        assert stage(spark, df.limit(0), sf).collect() == []
    assert corpus_pipeline.STAGES[-1][1](spark, df, sf).count() == df.count()
