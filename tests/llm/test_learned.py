"""Toxicity and language by held-out accuracy, and on odd rows."""

import random

import numpy as np

from pointproc.llm import language, toxicity

VOCABULARY = {"en": "the of and house water time people with from this that".split(), "de": "der die und haus wasser zeit nicht auf eine sich".split(),
              "fr": "le la et maison eau temps dans pour avec une des".split()}


def corpus(spark, n=900, seed=4):
    r = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        lang = ("en", "de", "fr")[i % 3]
        words = [r.choice(VOCABULARY[lang]) for _ in range(r.randint(15, 80))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(r.randint(2, 4)):
                words.insert(r.randrange(len(words)), r.choice(["snarglet", "blorkhead", "vilmuck"]) + r.choice(["", "s", "y"]))
        rows.append((i, " ".join(words), lang))
        labels.append((i, int(toxic)))
    return (spark.createDataFrame(rows, "doc_id long, text string, lang string"),
            spark.createDataFrame(labels + [(None, 1), (5, None), (7, 0)], "doc_id long, toxic int"))


def test_toxicity_held_out(spark):
    docs, labels = corpus(spark)
    got = {r.doc_id: r for r in toxicity.classify(docs, labels).collect()}
    held = [r for r in got.values() if r.held_out]
    assert len(got) == 900 and 150 < len(held) < 300
    assert np.mean([r.predicted == int(r.doc_id % 5 == 0) for r in held]) > 0.98
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.predicted}


def test_toxicity_odd_rows(spark, odd_documents, no_documents):
    docs, labels = corpus(spark, 300)
    model = toxicity.fit(docs, labels)
    assert toxicity.score(odd_documents, model).count() == 10 and toxicity.score(no_documents, model).count() == 0
    assert {r.score for r in toxicity.score(odd_documents, model).where("doc_id IN (2, 3)").collect()} == {
        r.score for r in toxicity.score(odd_documents, model).where("doc_id = 2").collect()}
    assert toxicity.fit(docs, labels.limit(0)) is None and toxicity.fit(no_documents, labels) is None
    assert {r.score for r in toxicity.classify(odd_documents, labels.limit(0)).collect()} == {0.0}


def test_label_model_finds_accuracies_without_labels():
    rng = np.random.default_rng(1)
    y = rng.random(4000) < 0.2
    votes = np.column_stack([np.where(y, rng.random(4000) < a, rng.random(4000) < b) for a, b in ((0.8, 0.05), (0.7, 0.1), (0.6, 0.02))])
    votes = np.column_stack([votes, votes[:, 1], votes[:, 1]])  # repeats of one vote do not outvote the others
    q = toxicity.label_model(votes, np.where(votes[:, 0], 0.8, 0.1))
    assert np.mean((q > 0.5) == y) > 0.9 > np.mean((votes.sum(1) >= 3) == y)


def test_language_held_out(spark):
    docs, _ = corpus(spark)
    got = language.identify(docs).collect()
    lang = ("en", "de", "fr")
    assert np.mean([r.lang_pred == lang[r.doc_id % 3] for r in got if r.held_out]) > 0.98
    assert all(0 <= r.score <= 1 for r in got)


def test_language_odd_rows(spark, odd_documents, no_documents):
    got = {r.doc_id: r for r in language.identify(odd_documents).collect()}
    assert {i for i, r in got.items() if r.lang_pred == "und"} == {2, 3, 4, 6}
    assert all(r.score == 0 for r in got.values() if r.lang_pred == "und")
    assert language.identify(no_documents).count() == 0
    assert {r.lang_pred for r in language.predict(odd_documents, None).collect()} == {"und"}
