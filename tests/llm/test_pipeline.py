"""The pipeline's stages on the smallest tables, each against brute force on its own input."""

import corpus_pipeline
from prismatch.session import stage

from . import brute


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    columns = docs.columns
    seen = []
    for k, (_, work) in enumerate(corpus_pipeline.STAGES):
        before = [(r.doc_id, r.text) for r in docs.collect()]
        docs = stage(work(spark, docs, sf), "t")
        after = {r.doc_id: r.text for r in docs.collect()}
        seen.append((before, after))
        assert docs.columns[: len(columns)] == columns
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
    before, after = seen[1]
    assert set(after) == {d for d, x in brute.groups(before).items() if x[1] == d}
    before, after = seen[2]
    for d, (n, gone, digest) in brute.repeats(before).items():
        assert brute.sha(" ".join(brute.spaced(after[d], lower=False))) == digest
    before, after = seen[3]
    assert set(after) == {x[0] for x in brute.contamination(before, items) if not x[5]}
    assert set(seen[4][1]) == {d for d, _ in seen[4][0]}
    run = corpus_pipeline.run(spark, sf)
    assert run.count() == docs.count() and {"ids", "n_tokens"} <= set(run.columns)
