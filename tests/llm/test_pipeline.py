from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F

from tomeweave.llm._session import materialize

from .conftest import ODD
from .test_similar import brute_groups


def test_stages(spark, table):
    docs = table
    kept = corpus_pipeline.identify_language(spark, docs, "")
    assert kept.columns == docs.columns
    dropped = docs.join(kept, "doc_id", "left_anti").collect()
    assert len(dropped) <= 0.05 * docs.count() and all(len(r.text) < 30 for r in dropped)
    kept = materialize(kept)
    exact = materialize(corpus_pipeline.exact_duplicates(spark, kept, ""))
    best = {}
    for r in kept.collect():
        best[r.text] = max(best.get(r.text, r.doc_id), r.doc_id)
    assert {r.doc_id for r in exact.collect()} == set(best.values())
    near = materialize(corpus_pipeline.near_duplicates(spark, exact, ""))
    groups = brute_groups([(r.doc_id, r.text) for r in exact.collect()])
    staying = {r.doc_id for r in near.collect()}
    assert staying == set(groups.values())
    mixed = materialize(corpus_pipeline.mix_sources(spark, near, ""))
    copies = Counter(r.doc_id for r in mixed.collect())
    assert mixed.columns == docs.columns and set(copies) == {r.doc_id for r in near.collect()} and max(copies.values()) <= 3
    packed = corpus_pipeline.pack_sequences(spark, mixed, "").collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == copies


def test_odd_rows_and_empty(spark, odd, none):
    for docs, n in ((odd.select("doc_id", "text", "lang", "source", F.lit(1).alias("score")), len(ODD)), (none, 0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = materialize(stage(spark, docs, ""))
            assert out.columns == docs.columns
            docs = out
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
        assert (len(packed) > 0) == (n > 0)


def test_run(spark):
    import os

    if os.path.isdir("/root/testdata/sf0.001"):
        assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 100
