"""The pipeline, stage by stage, against brute force on what the stage before kept; and the registry."""

import importlib.util

import corpus_pipeline
from pointproc.llm import mixing, queries, sentencepieces, toxicity
from pointproc.session import store
from tests.llm.test_ngram_join import brute as joined
from tests.llm.test_suffixes import brute as cut

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = corpus_pipeline.table(spark, FOLDER, "documents")
    columns = docs.columns
    rejected = {r.doc_id for r in toxicity.classify(docs, corpus_pipeline.table(spark, FOLDER, "labels")).where("predicted = 1").collect()}
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.select("doc_id", "text").collect()
        docs = store(stage(spark, docs, FOLDER))
        assert docs.columns == columns
        kept[name] = (before, docs.collect())
    before, after = kept["toxicity"]
    assert {r.doc_id for r in before} - {r.doc_id for r in after} == rejected
    before, after = kept["ngram_join"]
    groups = joined([tuple(r) for r in before])
    assert {r.doc_id for r in after} == {i for i, (c, _) in groups.items() if i == c}
    before, after = kept["suffix_dedup"]
    spans = cut([tuple(r) for r in before])
    assert len(before) == len(after)
    for r in after:
        size, removed, _, _ = next(iter(spans[r.doc_id]))
        assert abs(len((r.text or "").encode()) - (size - removed)) <= 6 and r.n_chars == len(r.text or "")
    before, after = kept["source_mix"]
    assert len(after) >= 1 and {r.doc_id for r in after} <= {r.doc_id for r in before}
    tokens = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert tokens.count() == len(after)
    text = {r.doc_id: r.text for r in after}
    assert all(r.text == text[r.doc_id] for r in sentencepieces.decode(tokens).collect())


def test_registry():
    names = list(queries.queries())
    assert [int(n[2:].split("_")[0]) for n in names[:-1]] == list(range(1, 14)) and names[-1] == "pipeline"
    assert set(queries.oracles()) <= set(names)
    assert mixing.MOST == 3 and importlib.util.find_spec("__spark_entry__") is not None
