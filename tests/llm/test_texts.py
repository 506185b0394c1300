"""SentencePiece round trips and the quality rules against plain Python."""

import math
import random
import re
from collections import Counter

import pytest

from pointproc.llm import quality, sentencepieces

ODD = ["Hello  wörld\n tëst 日本", "", "   ", " a", "x▁y \U0001F600 z", "a     b  ", "\t\r\n", "no_blank" * 500, "the the the", None]


@pytest.fixture(scope="module")
def vocabulary():
    return sentencepieces.Vocabulary()


def best_score(word, v):
    """Greatest sum of scores by plain recursion over all ends."""
    best = [0.0] + [-math.inf] * len(word)
    for j in range(1, len(word) + 1):
        if word[j - 1] not in v.piece:
            best[j] = best[j - 1] + v.unknown
        for i in range(j):
            if word[i:j] in v.piece:
                best[j] = max(best[j], best[i] + v.piece[word[i:j]][0])
    return best[-1]


def test_shared_prefixes_give_the_best_score(vocabulary):
    words = sorted({" " + w for w in "the then there they them the a an and andes hello help helium ünder über 日本 x▁y".split()} | {"   ", "  a"})
    score = {i: s for s, i in vocabulary.piece.values()}
    for word, ids in zip(words, sentencepieces.encode_words(words, vocabulary)):
        raw = b"".join(vocabulary.raw[i] for i in ids)
        assert raw == word.encode()
        unknown = sum(1 for c in word if c not in vocabulary.piece)
        got = sum(score[i] for i in ids if i in score) + unknown * vocabulary.unknown
        assert got == pytest.approx(best_score(word, vocabulary))


def test_round_trip(spark, odd_documents, no_documents):
    docs = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string").repartition(3)
    ids = sentencepieces.encode(docs)
    back = {r.doc_id: r.text for r in sentencepieces.decode(ids).collect()}
    assert back == dict(enumerate(ODD))
    seen = {r.doc_id: r for r in sentencepieces.digests(docs).collect()}
    assert all(r.round_trip for r in seen.values()) and seen[1].n_tokens == 0 and seen[9].n_tokens == 0
    assert {r.doc_id: None if r.ids is None else len(r.ids) for r in ids.collect()} == {
        i: None if t is None else seen[i].n_tokens for i, t in enumerate(ODD)}
    assert all(r.round_trip for r in sentencepieces.digests(odd_documents).collect())
    assert sentencepieces.encode(no_documents).count() == 0


def counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    again = {k for i in range(len(w) - 4) if grams[tuple(w[i:i + 5])] > 1 for k in range(i, i + 5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(again)


def test_quality_counts(spark, odd_documents, no_documents):
    texts = ODD + ["a b c d e f a b c d e g", "line\nline\n\n \nline # $ | x", "a a a a a a a", "one two three four five " * 3 + "z",
                   "😀 b ÄÖ\x0b\x0c next"]
    docs = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "doc_id long, text string, lang string").repartition(3)
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    for i, t in enumerate(texts):
        n, chars, symbols, dup, again = counts(t)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, again), (i, t)
        assert r.base_failed == (n < 10 or 100 * again > 20 * n)
        assert r.kept == (not r.base_failed)  # no language named: only the base rules decide
    assert quality.judge(odd_documents).count() == 10 and quality.judge(no_documents).count() == 0


def test_distance(spark):
    docs = spark.createDataFrame([(1, "the of and " * 30 + "x " * 30, "en"), (2, "zzz " * 120, None), (3, "the of and " * 30 + "x " * 30, None)],
                                 "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    assert got[1].words_distance == pytest.approx(0) and got[3].chars_distance == pytest.approx(0)
    p, q = [30 / 120] * 4, [0, 0, 0, 1]
    m = [(a + b) / 2 for a, b in zip(p, q)]
    kl = lambda x: sum(a * math.log2(a / c) for a, c in zip(x, m) if a)
    assert got[2].words_distance == pytest.approx(math.sqrt((kl(p) + kl(q)) / 2))


def prose(lang, n, seed, common=0.3):
    r = random.Random(f"{lang}{seed}")
    own = ["".join(r.choice("abcdefghiklmnoprstu") for _ in range(r.randint(3, 9))) for _ in range(400)]
    words = [r.choice(quality.COMMON[lang]) if r.random() < common else r.choice(own) for _ in range(n)]
    return " ".join(w.capitalize() + "," if k % 12 == 0 else w for k, w in enumerate(words))


def test_long_text_without_common_words_fails(spark):
    rows = [(k * 100 + i, prose(lang, n, i), lang) for k, lang in enumerate(quality.COMMON) for i in range(20) for n in [40 + 20 * i]]
    rows += [(1000 + k, prose(lang, 120, 99, 0.0), lang) for k, lang in enumerate(quality.COMMON)]
    rows += [(2000, prose("en", 120, 98, 0.0), None), (2001, prose("en", 30, 97, 0.0), "en"), (2002, prose("en", 90, 96).upper(), None)]
    rows += [(3000 + i, prose("en", 100, i, 0.0), "xx") for i in range(20)]  # no common words of it are known
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.kept or r.base_failed for r in quality.judge(docs).collect() if r.doc_id != 2002}
    assert {i for i, kept in got.items() if not kept} == {1000, 1001, 1002, 1003, 2000}


def test_rare_language_is_compared_with_its_own(spark):
    r = random.Random(1)
    rare = lambda: "".join("".join(chr(0x4E00 + r.randrange(3000)) for _ in range(3)) + "，。"[k % 2] + " " for k in range(45))
    rows = [(i, prose("en", 150, i), "en") for i in range(497)] + [(1000 + i, rare(), "zh") for i in range(3)]
    docs = spark.createDataFrame([*rows, (2000, rare(), None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in quality.judge(docs).where("doc_id >= 1000").collect()}
    assert all(got[i].kept and got[i].chars_distance < 0.1 for i in (1000, 1001, 1002))
    assert got[2000].chars_distance > quality.FAR_CHARS and not got[2000].kept
