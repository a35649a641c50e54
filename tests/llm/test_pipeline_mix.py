"""The mixing stage of the pipeline keeps the order of the permutations."""

import corpus_pipeline
from clausewise.llm import mixing


def test_repeats_are_apart(spark):
    rows = [(i, f"text {i} " + "w " * 20, "big" if i % 10 else "small", 40) for i in range(1, 600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    got = [r.doc_id for r in corpus_pipeline.mix_sources(spark, docs, "").collect()]
    mixed = mixing.mix(docs, repetition=corpus_pipeline.REPETITION).collect()
    assert got == [r.doc_id for r in sorted(mixed, key=lambda r: (r.mix_block, r.mix_key))]
    assert len(got) > len(set(got)) == 599 and all(a != b for a, b in zip(got, got[1:], strict=False))
