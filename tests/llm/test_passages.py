"""Near-duplicate passages: planted ones are found, and what is found is one."""

import random
import re

import numpy as np

from pointproc.llm import passages


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def sample(seed):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefghé") for _ in range(r.randint(2, 8))) for _ in range(2000)]

    def text(n):
        return [r.choice(vocabulary) for _ in range(n)]

    shared = [text(90) for _ in range(3)]
    rows, planted = [], {}
    for i in range(60):
        body = text(r.randint(10, 150))
        if i % 4 == 1:
            p = list(shared[i % 3])
            if i % 8 == 1:
                p[r.randrange(5, 85)] = "edited"
            at = r.randrange(len(body))
            planted[i] = (i % 3, at, at + 90)
            body[at:at] = p
        rows.append((i, " ".join(body)))
    rows += [(100 + k, rows[1][1]) for k in range(30)] + [(200, None), (201, ""), (202, "a b c")]
    return rows, planted


def jaccard(a, b):
    a, b = ({tuple(x[i:i + 5]) for i in range(len(x) - 4)} for x in (a, b))
    return len(a & b) / len(a | b)


def test_planted_and_true(spark, monkeypatch):
    monkeypatch.setattr(passages, "OFFER", 3000)
    rows, planted = sample(5)
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, pos long").repartition(3)
    text = {i: words(t) for i, t in rows}
    got = passages.near_passages(docs).collect()
    covered = {}
    for r in got:
        assert r.other_id < r.doc_id and r.end_word - r.start_word >= 50
        assert jaccard(text[r.doc_id][r.start_word:r.end_word], text[r.other_id][r.other_start:r.other_end]) >= 0.75
        covered.setdefault(r.doc_id, []).append((r.start_word, r.end_word))
    first = {}
    for i, (kind, a, z) in sorted(planted.items()):
        if kind in first:
            assert any(s <= a + 15 and e >= z - 15 for s, e in covered[i]), i
        first.setdefault(kind, i)
    assert set(covered) == {i for i, (k, _, _) in planted.items() if first[k] != i} | set(range(100, 130))


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert passages.near_passages(docs).count() == 0
    odd = spark.createDataFrame([(None, "w " * 80), (1, " ".join(map(str, range(60)))), (1, " ".join(map(str, range(60))))], "doc_id long, text string")
    assert passages.near_passages(odd).count() == 0


def test_repeated_sentence_before_the_passage(spark):
    sentence = "please read all of this page".split()
    fill = lambda name, n: [f"{name}{i}" for i in range(n)]
    passage = fill("x", 20) + sentence + fill("y", 24)
    edited = passage[:-4] + ["edited"] + passage[-3:]
    rows = [(1, sentence + fill("f", 40) + passage + fill("g", 30)), (2, fill("h", 30) + passage + fill("i", 30)), (3, fill("j", 30) + edited)]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    got = {(r.doc_id, r.other_id): r for r in passages.near_passages(docs).collect()}
    assert set(got) == {(2, 1), (3, 1)}
    assert got[2, 1].start_word <= 30 and got[2, 1].end_word >= 80 and (got[2, 1].other_start, got[2, 1].other_end) == (46, 96)
    assert got[3, 1].start_word <= 30


def test_similar_runs_against_all_stretches():
    r = random.Random(3)
    for turn in range(30):
        a = np.array([r.randrange(60) if r.random() < 0.3 else 1000 + i for i in range(60)], np.uint32)
        b = np.concatenate([np.array([r.randrange(60) for _ in range(20)], np.uint32), a[:r.randrange(40, 60)], a[5:15]])
        b[r.randrange(20, 60)] = 7
        if turn % 2:  # without shingles that repeat inside a stretch
            b[:20], b[-10:] = np.arange(20) + 5000, np.arange(10) + 6000
            b[:3] = a[12:15]
        windows = {w for s, e, _, _ in passages.similar_runs(a, b) for w in range(s, e - passages.SPAN + 1)}
        for w in range(len(a) - passages.SPAN + 1):
            x = set(a[w:w + passages.SPAN].tolist())
            best = max(len(x & y) / len(x | y) for s in range(len(b)) for e in range(s + 1, len(b) + 1) if (y := set(b[s:e].tolist())))
            assert (w in windows) == (best >= 0.8 - 1e-9)


def test_passages_from_several_places_of_one_document(spark):
    fill = lambda name, n: [f"{name}{i}" for i in range(n)]
    one, two, phrase = fill("x", 50), fill("y", 50), fill("p", 9)
    rows = [(1, phrase + fill("a", 400) + one + fill("b", 600) + two + fill("c", 300)), (2, phrase + one + two + fill("d", 20)),
            (3, fill("e", 30) + phrase + one[:20] + phrase + one[29:])]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    got = sorted((r.other_start, r.other_end) for r in passages.near_passages(docs).where("doc_id = 2").collect())
    assert len(got) == 2 and all(abs(s - p) <= 12 and abs(e - p - 50) <= 12 for (s, e), p in zip(got, (409, 1059)))


def test_meetings_link_all_cells_of_the_first_document():
    value, of, cell = np.array([5, 5, 5, 5, 9], np.uint64), np.array([1, 1, 2, 2, 2]), np.array([0, 7, 3, 3, 4])
    assert passages.meetings(value, of, cell).tolist() == [[2, 3, 1, 0], [2, 3, 1, 7]]


def test_joined_keeps_far_places_apart():
    runs = sorted([(1, 0, 60, 0, 60), (1, 5, 70, 500, 560), (1, 10, 90, 10, 90)])
    assert passages.joined(runs) == [(1, 0, 90, 0, 90), (1, 5, 70, 500, 560)]


def test_later_documents_of_a_value_are_linked(spark):
    # one shingle is the least of many windows by chance; its first document has no such passage
    fill = lambda name, n: [f"{name}{i}" for i in range(n)]
    passage = fill("x", 60)
    edited = passage[:56] + ["edited"] + passage[57:]
    rows = [(k, fill(f"a{k}_", 45) + passage[5 * k:5 * k + 9] + fill(f"b{k}_", 45)) for k in range(11)]
    rows += [(20, fill("c", 30) + passage + fill("d", 30)), (21, fill("e", 7) + edited + fill("f", 20)), (22, fill("g", 50) + passage + fill("h", 9))]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string").repartition(5)
    assert {(r.doc_id, r.other_id) for r in passages.near_passages(docs).collect()} == {(21, 20), (22, 20), (22, 21)}


def test_meetings_link_all_classes_and_copies_with_the_first_of_theirs():
    value, of, cell, near = np.full(5, 5, np.uint64), np.array([1, 2, 3, 4, 5]), np.array([0, 3, 4, 6, 7]), np.array([8, 9, 7, 9, 9])
    assert passages.meetings(value, of, cell, near).tolist() == [[2, 3, 1, 0], [3, 4, 1, 0], [3, 4, 2, 3], [4, 6, 2, 3], [5, 7, 2, 3]]


def test_repeated_words_take_one_place_a_window():
    h = np.array([7] * 5000 + list(range(100, 160)), np.uint64)
    doc = np.append(np.zeros(5040, np.int64), np.ones(20, np.int64))
    for k, (_, at) in enumerate(passages.compact_windows(h, doc)):
        v = passages.mix(h * passages._FUNCTION[k])
        assert len(at) < 5000 // passages.SPAN + 60 and (np.diff(at) > 0).all() and at.max() < 5040
        taken = np.zeros(len(h), bool)
        taken[at] = True
        for w in range(0, 5040 - passages.SPAN + 1):
            span = slice(w, w + passages.SPAN)
            assert (taken[span] & (v[span] == v[span].min())).any()


def test_windows_that_no_other_document_can_resemble_are_left_out():
    r = random.Random(4)
    n = 3
    h = np.array([r.randrange(1 << 62) if r.random() < 0.3 else r.randrange(40) << 40 for _ in range(700)], np.uint64)
    h[100:160] = h[40]  # a run of one word
    h[300:420] = np.arange(120, dtype=np.uint64) << np.uint64(50) | np.uint64(11)
    doc = np.repeat([0, 1, 2], [260, 240, 200])
    h[520:600] = h[310:390]
    _, key, head = passages.sorted_shingles(h, n)
    elsewhere = np.array([r.random() < 0.3 for _ in range(head.sum())])
    found = dict(zip(key[head].tolist(), elsewhere))
    keys = ((h % np.uint64(n)) << np.uint64(40) | h >> np.uint64(24)).tolist()
    alone = [not found[k] and not any(k == x and d != doc[i] for x, d in zip(keys, doc)) for i, k in enumerate(keys)]
    got = passages.common_windows(h, doc, n, elsewhere)
    inside = [w for w in range(len(h) - passages.SPAN + 1) if doc[w] == doc[w + passages.SPAN - 1]]
    want = [len({keys[i] for i in range(w, w + passages.SPAN) if alone[i]}) <= passages.LACK for w in inside]
    assert got[inside].tolist() == want and 0 < sum(want) < len(want)


def test_a_common_line_in_foreign_texts_offers_nothing(spark, monkeypatch):
    line = [f"line{k}" for k in range(14)]
    fill = lambda name, n: [f"{name}{i}" for i in range(n)]
    rows = [(k, " ".join((line if k % 2 else []) + fill(f"a{k}_", 60) + (line if not k % 2 else []))) for k in range(12)]
    rows += [(50, " ".join(fill("x", 70))), (51, " ".join(fill("x", 70)))]
    met, kept = [], passages.store
    monkeypatch.setattr(passages, "store", lambda df: met.append(kept(df)) or met[-1])
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {(r.doc_id, r.other_id) for r in passages.near_passages(docs).collect()} == {(51, 50)}
    monkeypatch.setattr(passages, "discard", lambda *_: None)
    met.clear()
    passages.linked_places(docs, 4000)
    assert {r.doc_id for r in met[1].collect()} <= {50, 51}


def test_stretches_of_repeated_words_are_compared_once(monkeypatch):
    seen, earlier = [], passages.earlier
    monkeypatch.setattr(passages, "earlier", lambda x: seen.append(len(x)) or earlier(x))
    r = random.Random(9)
    for _ in range(20):
        run = lambda lo, hi: [x for _ in range(r.randint(lo, hi)) for x in [r.randrange(6)] * r.randint(1, 30)]
        a, b = np.array((run(9, 12) * 3)[:120], np.uint32), np.array(run(5, 8), np.uint32)
        n = len(a) - passages.SPAN + 1
        size = np.array([len(set(a[w:w + passages.SPAN].tolist())) for w in range(n)])
        seen.clear()
        got = {w: (s, e) for w, s, e in passages.best_stretches(a, b, np.arange(n), size, 0.8)}
        assert max(seen) == 1 + (b[1:] != b[:-1]).sum()
        for w in range(n):
            x = set(a[w:w + passages.SPAN].tolist())
            best = max((len(x & y) / len(x | y), -s, -e) for s in range(len(b)) for e in range(s, len(b)) if (y := set(b[s:e + 1].tolist())))
            assert (w in got) == (best[0] >= 0.8 - 1e-9) and got.get(w, (-best[1], -best[2])) == (-best[1], -best[2])


def test_classes_of_near_copies_take_no_pairs_beyond_those_that_join_them(spark, monkeypatch):
    r = random.Random(6)
    fill = lambda name, n: [f"{name}{i}" for i in range(n)]
    one, two = fill("x", 120), fill("y", 70)

    def edited(passage, *at):
        return [f"e{r.random()}" if k in at else w for k, w in enumerate(passage)]

    rows = [(k, fill(f"a{k}_", 20) + edited(one, 60 + k) + fill(f"b{k}_", 20)) for k in range(40)]
    rows += [(100 + k, fill(f"c{k}_", 30) + edited(two, 5 * k) + fill(f"d{k}_", 9)) for k in range(5)]
    rows += [(200, fill("g", 60)), (201, edited(one, 11) + fill("f", 30) + two), (202, fill("h", 8) + one[:20])]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows] + [(300, None), (None, "w " * 90)], "doc_id long, text string").repartition(3)
    pairs = {(x.doc_id, x.other_id) for x in passages.near_passages(docs).collect()}
    least = {i: i for i, _ in rows} | {300: 300}
    for _ in rows:
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
    links, verified = [], passages.verified
    monkeypatch.setattr(passages, "verified", lambda rows, table, *x: links.append(table.count()) or verified(rows, table, *x))
    got = passages.near_classes(docs).collect()
    assert {x.doc_id: (x.component_id, x.kept) for x in got} == {i: (c, i == c) for i, c in least.items()} | {None: (None, True)}
    assert len(got) == len(rows) + 2 and least[201] == least[104] == least[39] == 0 and least[202] == 202
    assert len(pairs) > 700 and sum(links) < 200
    for x in got:
        assert x.other_id is None or (x.doc_id, x.other_id) in pairs and x.end_word - x.start_word >= 50


def test_what_may_not_resemble_has_no_similar_run():
    r = random.Random(8)
    cell = passages.CELL
    kept = 0
    for turn in range(60):
        b = np.array([r.randrange(1 << 32) if r.random() < 0.8 else r.randrange(30) for _ in range(cell + 2 * passages.STRETCH)], np.uint64)
        a = b[13:13 + passages.REACH].copy()
        for k in range(len(a)):
            if r.random() < 0.02 * (turn % 20):
                a[k] = r.randrange(1 << 32)
        if turn % 6 == 0:
            a[20:150] = b[40]
        inside = np.ones((1, len(a)), bool)
        bit, lack = passages.wanted_of(a[None] << np.uint64(32), inside)
        there = np.zeros((1, passages.WIDE), bool)
        there[0, (b % np.uint64(passages.WIDE)).astype(np.int64)] = True
        may = bool(passages.may_resemble(bit, lack, np.packbits(there, axis=1))[0])
        assert may or not passages.similar_runs(a.astype(np.uint32), b.astype(np.uint32))
        kept += may
    assert 0 < kept < 60


def test_a_run_of_one_word_is_not_taken_as_found():
    r = random.Random(9)
    a, b = (np.array([r.randrange(1 << 32) for _ in range(n)], np.uint64) for n in (passages.REACH, passages.CELL + 2 * passages.STRETCH))
    a[20:150] = a[20]
    bit, lack = passages.wanted_of(a[None] << np.uint64(32), np.ones((1, len(a)), bool))
    there = np.zeros((1, passages.WIDE), bool)
    there[0, (b % np.uint64(passages.WIDE)).astype(np.int64)] = True
    there[0, int(a[20]) % passages.WIDE] = False
    assert not passages.may_resemble(bit, lack, np.packbits(there, axis=1))[0]
    there[0, int(a[20]) % passages.WIDE] = True
    assert passages.may_resemble(bit, lack, np.packbits(there, axis=1))[0]


def test_one_link_of_each_two_classes_goes_first(spark):
    near = spark.createDataFrame([(d, o, 0, list(range(1 + (d == 12 and o == 3)))) for d in (10, 11, 12) for o in (1, 2, 3)] + [(12, 20, 0, [0])],
                                 "doc_id long, other_id long, other_cell long, cells array<long>")
    classes = spark.createDataFrame([(d, 10) for d in (10, 11, 12)] + [(o, 1) for o in (1, 2, 3)] + [(20, 20)], "doc_id long, class long")
    first = passages.one_of_classes(near, classes)
    assert first.columns == near.columns and sorted((x.doc_id, x.other_id) for x in first.collect()) == [(12, 3), (12, 20)]
    known = spark.createDataFrame([(d, 1) for d in (1, 2, 3, 10, 11, 12)], "node long, component long")
    assert [(x.doc_id, x.other_id) for x in passages.apart(near, known).collect()] == [(12, 20)]
