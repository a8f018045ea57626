"""The pipeline's stages keep what they should, and its result equals its operators applied by hand."""

import random

from test_operators import corpus, table

import corpus_pipeline
from blockwise.llm import ngram_jaccard


def test_run(spark, tmp_path):
    rows = [(i, t) for i, t in corpus(3)] + [(3000 + i, f"you blockhead number {i} " + " ".join(random.Random(i).choices("abcdefgh", k=30))) for i in range(40)]
    rows += [(4000, "my password = abcdefghijklmnop ends")]
    docs = table(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    marks = [(i, 1, int(i is not None and 3000 <= i < 4000)) for i, _ in rows if i is not None]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, str(tmp_path))
        seen[name] = docs
        if name != "SentencePiece":
            assert docs.columns == before.columns
    ids = {r.doc_id for r in seen["toxicity"].collect()}
    assert not any(i is not None and 3000 <= i < 4000 for i in ids) and len(ids) >= len({i for i, _ in rows}) - 41
    comp = {r.doc_id: r.component_id for r in ngram_jaccard.jaccard_components(seen["toxicity"], 5, 80, 100).collect()}
    assert {r.doc_id for r in seen["n-gram Jaccard join"].collect()} == {i for i, c in comp.items() if i == c}
    assert "password" not in next(r.text for r in seen["secret scan"].collect() if r.doc_id == 4000)
    want = sorted(str(r) for r in seen["SentencePiece"].collect())
    assert sorted(str(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == want
