"""Toxicity by weak supervision.

1. Lexicon voters are mined: word beginnings that toxic training texts hold far more
   often than clean ones. Pattern voters look at how often and how densely they
   occur, at shouting and at exclamation marks.
2. A generative label model explains the votes by a hidden label: by expectation
   maximisation it estimates each voter's rates among both classes, and from what
   is left the correlations of voters, by which near-repeats of one vote count less.
3. A linear classifier learns the posterior labels from the votes, counts and
   densities; its output is calibrated on the training labels.

Mining, model and classifier use rows that are not held out, at most `FIT_ROWS` of
each label, drawn by a digest of the id. Scores look at the text alone. Missing and
empty texts are scored like texts without any vote. Without labels of both kinds
nothing can be learned and every score is 0. A row labelled twice is toxic if one
label says so; rows of labels without id or value are passed over.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointproc.llm.common import Bytes, draw, held_out, pieces

#: Training rows of each label, terms that may vote, and what a term must show.
FIT_ROWS, TERMS = 6000, 160
LEAST_TEXTS, LEAST_RATIO = 5, 12.0
LENGTHS = range(4, 9)
CUT = 0.3
_LETTER = np.arange(256, dtype=np.uint8)
_LETTER[:128] = [c if chr(c).isalpha() else 32 for c in range(128)]


def sample_labels(labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, toxic of about `rows` training rows of each label (all, if there are fewer)."""
    one = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic")) \
        .where(~held_out())
    n = {r["toxic"]: r["n"] for r in one.where("toxic IN (0, 1)").groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bound = [F.col("toxic") == F.lit(k) for k in n]
    keep = F.lit(False)
    for is_k, k in zip(bound, n):
        keep = keep | (is_k & (draw("doc_id") < int(min(1.0, rows / n[k]) * (1 << 60))))
    return one.where(keep)


def mine(train: DataFrame, terms: int = TERMS) -> list[str]:
    """Word beginnings of 4 to 8 characters that speak for the toxic label. train: text, toxic."""

    def count(batches):
        for batch in batches:
            tox, clean, n = Counter(), Counter(), [0, 0]
            for text, y in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                words = {w for w in "".join(c if c.isalpha() else " " for c in (text or "").lower()).split() if len(w) >= LENGTHS[0]}
                (tox if y else clean).update({w[:k] for w in words for k in LENGTHS if len(w) >= k})
                n[1 if y else 0] += 1
            keys = list(tox | clean) + [""]
            tox[""], clean[""] = n[1], n[0]
            yield pa.record_batch([pa.array(keys), pa.array([tox[k] for k in keys]), pa.array([clean[k] for k in keys])],
                                  names=["term", "tox", "clean"])

    found = train.mapInArrow(count, "term string, tox long, clean long").groupBy("term").agg(
        F.sum("tox").alias("tox"), F.sum("clean").alias("clean"))
    total = found.where("term = ''").first()
    if total is None or not total["tox"] or not total["clean"]:
        return []
    ratio = (F.col("tox") / total["tox"]) / ((F.col("clean") + 1) / total["clean"])
    top = found.where((F.col("term") != "") & (F.col("tox") >= LEAST_TEXTS) & (ratio >= LEAST_RATIO)).orderBy(
        F.desc("tox"), F.desc(F.length("term")), "term").limit(terms * len(LENGTHS) * 4).collect()
    chosen: list[str] = []
    for r in top:
        if len(chosen) < terms and not any(
                r["term"].startswith(c) or c.startswith(r["term"]) for c in chosen):
            chosen.append(r["term"])
    return chosen


class Voters:
    """Counts of each term and the pattern votes, for many texts at once."""

    def __init__(self, terms: list[str]):
        self.terms = terms
        self.by_length = {}
        for place, term in enumerate(terms):
            raw = np.frombuffer(term.encode(), np.uint8)
            h = Bytes(raw, np.array([0, len(raw)])).ranges(np.array([0]), np.array([len(raw)]))[0]
            self.by_length.setdefault(len(raw), []).append((h, place))

    def counts(self, text: pa.Array) -> Iterator[np.ndarray]:
        """Per text: hits of each term, then words, letters, capitals and exclamation marks."""
        text = text.cast(pa.large_string()).fill_null("")
        low = pc.utf8_lower(text)
        for lo, hi, b in pieces(low, rows=2048):
            n, k = hi - lo, len(self.terms)
            words = Bytes(_LETTER[b.data], b.offsets)
            start, end, doc = words.words()
            out = np.zeros(n * k, np.int64)
            for length, known in self.by_length.items():
                i = np.flatnonzero(end - start >= length)
                h = words.ranges(start[i], start[i] + length)
                known = sorted(known)
                keys = np.array([x for x, _ in known], np.uint64)
                places = np.array([p for _, p in known])
                j = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                hit = keys[j] == h
                out += np.bincount(doc[i][hit] * k + places[j[hit]], minlength=n * k)
            part = text.slice(lo, n)
            letters = np.bincount(doc, weights=end - start, minlength=n)
            capitals = pc.count_substring_regex(part, "[A-Z]").to_numpy(zero_copy_only=False)
            shouts = pc.count_substring(part, "!").to_numpy(zero_copy_only=False)
            yield np.column_stack([out.reshape(n, k), np.bincount(doc, minlength=n), letters, capitals, shouts])

    def votes(self, m: np.ndarray) -> np.ndarray:
        k = len(self.terms)
        hits, words, letters, capitals, shouts = m[:, :k], m[:, k], m[:, k + 1], m[:, k + 2], m[:, k + 3]
        all_hits, kinds = hits.sum(1), (hits > 0).sum(1)
        dense = all_hits / np.maximum(words, 1)
        patterns = [all_hits >= 2, all_hits >= 3, all_hits >= 5, kinds >= 2, kinds >= 4, dense >= 0.002, dense >= 0.01,
                    dense >= 0.05, capitals > 0.3 * np.maximum(letters, 20), shouts >= 3]
        return np.column_stack([hits > 0, *patterns])

    def features(self, m: np.ndarray) -> np.ndarray:
        k = len(self.terms)
        hits, words = m[:, :k].sum(1), np.maximum(m[:, k], 1)
        more = [np.log1p(hits), np.log1p((m[:, :k] > 0).sum(1)), np.minimum(hits / words * 20, 3), np.log1p(words) / 5,
                np.ones(len(m))]
        return np.column_stack([self.votes(m), *more]).astype(float)


def label_model(votes: np.ndarray, start: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Posterior of the hidden label from votes; start: first guess of it.

    Rates of each voter in both classes and the share of the class come from
    expectation maximisation. A voter's say is divided by one plus its summed
    correlation, inside the classes, with the other voters.
    """
    v = votes.astype(float)
    q = np.clip(start.astype(float), 0.02, 0.98)
    say = np.ones(v.shape[1])
    for step in range(rounds):
        n1, n0 = q.sum(), (1 - q).sum()
        p1 = (v.T @ q + 0.5) / (n1 + 1)
        p0 = (v.T @ (1 - q) + 0.5) / (n0 + 1)
        if step == 0:  # later the guess may follow repeated votes, and their correlation hides
            rest = v - np.outer(q, p1) - np.outer(1 - q, p0)
            c = rest.T @ rest / len(v)
            d = np.sqrt(np.maximum(np.diag(c), 1e-9))
            c = np.clip(c / np.outer(d, d), 0, 1)
            say = 1 / np.maximum(c.sum(1), 1.0)
        z = np.log(n1 / n0) + v @ (say * np.log(p1 / p0)) + (1 - v) @ (say * np.log((1 - p1) / (1 - p0)))
        q = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return q


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Ridge logistic regression on soft labels, by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * w
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> dict | None:
    """Terms and weights, learned from the texts of a bounded sample of training labels."""
    chosen = sample_labels(labels, rows).select(F.col("doc_id").alias("_id"), "toxic")
    # about 2 * rows ids by construction, so the sample may go to every executor
    train = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("text", "toxic")
    terms = mine(train)
    if not terms:
        return None
    voters = Voters(terms)

    def counted(batches):
        for batch in batches:
            at = 0
            for m in voters.counts(batch.column("text")):
                yield pa.record_batch([batch.column("toxic").slice(at, len(m)).cast(pa.int32()),
                                       pa.array([r.astype(np.int32).tobytes() for r in m], pa.binary())], names=["toxic", "m"])
                at += len(m)

    got = train.mapInArrow(counted, "toxic int, m binary").collect()
    m = np.array([np.frombuffer(r["m"], np.int32) for r in got]).astype(np.int64)
    y = np.array([r["toxic"] for r in got], float)
    votes = voters.votes(m)
    first = np.where(votes[:, :len(terms)].any(1), 0.8, 0.05)
    x = voters.features(m)
    w = logistic(x, label_model(votes, first))
    z = x @ w
    shape = logistic(np.column_stack([z, np.ones(len(z))]), y, ridge=0.01)
    return {"terms": terms, "weights": w, "shape": shape}


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, score in 0..1, predicted (score >= CUT)."""
    rows = docs.select("doc_id", "text")
    if model is None:
        return rows.select("doc_id", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    voters = Voters(model["terms"])

    def scored(batches):
        for batch in batches:
            at = 0
            for m in voters.counts(batch.column("text")):
                z = voters.features(m) @ model["weights"] * model["shape"][0] + model["shape"][1]
                p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                yield pa.record_batch([batch.column("doc_id").slice(at, len(m)), pa.array(p),
                                       pa.array((p >= CUT).astype(np.int32))], names=["doc_id", "score", "predicted"])
                at += len(m)

    return rows.mapInArrow(scored, f"doc_id {kind}, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from the rows that are not held out, score all: doc_id, held_out, score, predicted."""
    return score(docs, fit(docs, labels)).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted to be toxic, all columns kept; rows alike in id stand or fall by their own text."""
    model = fit(docs, labels)
    if model is None:
        return docs
    voters, names = Voters(model["terms"]), docs.columns

    def keep(batches):
        for batch in batches:
            at, clean = 0, []
            for m in voters.counts(batch.column("text")):
                z = voters.features(m) @ model["weights"] * model["shape"][0] + model["shape"][1]
                clean.append(1 / (1 + np.exp(-np.clip(z, -30, 30))) < CUT)
                at += len(m)
            if clean:
                yield batch.select(names).filter(pa.array(np.concatenate(clean)))

    return docs.mapInArrow(keep, docs.schema)
