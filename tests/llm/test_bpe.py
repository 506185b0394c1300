"""The tokenization automaton against merging itself and against the public library."""

import hashlib
import itertools
import random

import numpy as np
import pytest

from pointproc.llm import bpe

ODD = ["Hello  WÖRLD\n tëst's 日本", "", "   ", "<|endoftext|>a<|startoftext|><|endoftext|", "ΑΣ ΣΑΣ İ \x1c \u0085 x", "é \U0001F600\U0001F600 12345!!''ll",
       "a" * 5000, "\U00016D43\U000105C0 new signs Ᲊ", "I'LL we'VE '''s", None, "don't\x00stop 　 ﻿"]


@pytest.fixture(scope="module")
def coder():
    return bpe.tokenizer(bpe.VOCABULARY)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.VOCABULARY)
    t.no_truncation()
    t.no_padding()
    return t


def ids_of(coder, text):
    return np.frombuffer(coder.encode(text), "<u4").tolist()


def merged(symbols, merges):
    """Merging itself: each rule in turn, from left to right."""
    for u, v, w in merges:
        out, k = [], 0
        while k < len(symbols):
            if symbols[k:k + 2] == [u, v]:
                out.append(w)
                k += 2
            else:
                out.append(symbols[k])
                k += 1
        symbols = out
    return symbols


@pytest.mark.parametrize("seed", range(12))
def test_gadgets_accept_what_merging_gives(seed):
    """Small alphabets, random merges with repeats of a sign: among all token sequences of a text only the merged one is accepted."""
    r = random.Random(seed)
    n_base, merges, spelt = 3, [], {k: (k,) for k in range(3)}
    while len(merges) < 9:
        u, v = r.randrange(len(spelt)), r.randrange(len(spelt))
        rules = [(*m, 3 + k) for k, m in enumerate(merges)]
        both = spelt[u] + spelt[v]
        if both not in spelt.values() and merged(list(both), rules) == [u, v]:
            merges.append((u, v))
            spelt[len(spelt)] = both
    table = bpe.arcs_after_merges(n_base, merges, np.zeros(len(spelt), bool))
    arc = lambda s, t: table[s >> 3, t] >> (s & 7) & 1
    rules = [(*m, 3 + k) for k, m in enumerate(merges)]

    def accepted(text):
        found = [()] if not text else []
        for t, own in spelt.items():
            if text[:len(own)] == own:
                found += [(t, *rest) for rest in accepted(text[len(own):]) if not rest or arc(t, rest[0])]
        return found

    for n in range(1, 7):
        for text in itertools.product(range(3), repeat=n):
            assert accepted(text) == [tuple(merged(list(text), rules))]


def test_equals_library(coder, library):
    r = random.Random(5)
    texts = [t for t in ODD if t is not None]
    texts += ["".join(r.choice("aaabbcdeinthso'ts  \n<|endoftext|>ÄΣ́é日\U0001F6421.,") for _ in range(r.randint(1, 60))) for _ in range(3000)]
    for t in texts:
        want = library.encode(t, add_special_tokens=False).ids
        got = ids_of(coder, t)
        assert got == want, t
        assert coder.decode(got).decode() == library.decode(want, skip_special_tokens=False)


def test_every_sign_splits_as_in_the_library(coder, library):
    for c in range(0, 0x110000, 5):
        if not 0xD800 <= c < 0xE000:
            t = f"A{chr(c)}b {chr(c)}{chr(c)}1{chr(c)}"
            assert ids_of(coder, t) == library.encode(t, add_special_tokens=False).ids, hex(c)


def test_query(spark, coder, library, odd_documents, no_documents):
    docs = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in bpe.digests(docs).collect()}
    for i, t in enumerate(ODD):
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (
            len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    ids = bpe.encode(docs)
    back = {r.doc_id: r.text for r in bpe.decode(ids).collect()}
    assert back == {i: library.decode(library.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False) for i, t in enumerate(ODD)}
    assert bpe.digests(odd_documents).count() == 10 and bpe.encode(odd_documents).count() == 10
    assert bpe.digests(no_documents).count() == 0 and bpe.encode(no_documents).count() == 0


def test_memory_starts_anew(coder, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBER", 3)
    coder.memory.clear()
    texts = ["one two three", "four five six seven", "one two eight nine", "six six one"]
    first = [ids_of(coder, t) for t in texts]
    coder.memory.clear()
    monkeypatch.setattr(bpe, "REMEMBER", 1000)
    assert first == [ids_of(coder, t) for t in texts]


def test_other_files_are_refused(tmp_path):
    import json

    spec = json.load(open(bpe.VOCABULARY, encoding="utf-8"))
    for change in ({"decoder": {"type": "ByteLevel"}}, {"normalizer": None}):
        path = tmp_path / f"{next(iter(change))}.json"
        path.write_text(json.dumps(spec | change), encoding="utf-8")
        with pytest.raises(ValueError):
            bpe.Tokenizer(str(path))


def test_words_are_encoded_together_as_alone(coder, library, monkeypatch):
    r = random.Random(8)
    words = list({"".join(r.choice("abcdeinthsoé日\U0001F600") for _ in range(r.choice([1, 2, 5, 9, 40]))) for _ in range(2000)}) + ["ab" * 3000]
    tokens, ends = coder.automaton.encode([w.encode() for w in words])
    assert len(ends) == len(words) + 1 and ends[-1] == len(tokens)
    for w, a, z in zip(words, ends, ends[1:]):
        alone, _ = coder.automaton.encode([w.encode()])
        assert tokens[a:z].tolist() == alone.tolist()
    assert [len(x) for x in coder.automaton.encode([])] == [0, 1]
    calls, inner = [], coder.automaton.encode
    monkeypatch.setattr(coder.automaton, "encode", lambda x: calls.append(len(x)) or inner(x))
    coder.memory.clear()
    texts = [f"{a} {b}<|endoftext|>{b}" for a, b in itertools.pairwise("".join(r.choice("abcde") for _ in range(7)) for _ in range(300))]
    assert [np.frombuffer(x, "<u4").tolist() for x in coder.encode_all(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(calls) == 1 and calls[0] > 250
