"""Language identification by nearest centroid.

A text becomes a normalised TF-IDF vector of hashed byte 1- to 3-grams; each language
has several centroids, clustered from its training rows; the language of the nearest
centroid by cosine is predicted. A text farther from its centroid than the training
rows ever were is also marked as rejected.

Training uses rows with text and a language that are not held out. Document
frequencies are counted over all of them; centroids are fitted on a sample bounded by
`FIT_ROWS` (drawn by a digest of the id, alike on every rerun). A text that is missing
or has no letter gets `und` and score 0, as does every text if nothing could be learned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointproc.llm.common import draw, held_out, pieces

DIM_BITS = 11
DIM = 1 << DIM_BITS
#: Training rows used for clustering, over all languages together.
FIT_ROWS = 2000
CENTROIDS = 3
ROUNDS = 12
UNKNOWN = "und"


def counts(text: pa.Array) -> Iterator[np.ndarray]:
    """Matrices of hashed n-gram counts, a row per text, some rows at a time.

    Case is folded, and ASCII signs, digits and blanks all count as one separator.
    """
    fold = np.arange(256, dtype=np.uint8)
    fold[:128] = [c if chr(c).isalpha() else 32 for c in range(128)]
    low = pc.utf8_lower(text.cast(pa.large_string()).fill_null(""))
    for lo, hi, b in pieces(low, rows=512):
        x = fold[b.data].astype(np.uint32)
        row = np.repeat(np.arange(hi - lo, dtype=np.int64), np.diff(b.offsets))
        left = np.repeat(b.offsets[1:], np.diff(b.offsets)) - np.arange(len(x))
        out = np.zeros((hi - lo) * DIM, np.int64)
        gram = np.zeros(len(x), np.uint32)
        for n in (1, 2, 3):
            have = len(x) - n + 1
            if have <= 0:
                break
            gram = gram[:have] * np.uint32(257) + x[n - 1:]
            slot = (gram * np.uint32(0x9E3779B1) + np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)) >> np.uint32(32 - DIM_BITS)
            ok = left[:have] >= n
            out += np.bincount((row[:have] * DIM + slot)[ok], minlength=len(out))
        yield out.reshape(hi - lo, DIM)


def unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def vectors(n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return unit(np.log1p(n).astype(np.float32) * idf)


def document_frequency(train: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each slot occurs: DIM numbers and the count of texts, summed on the cluster."""

    def partial(batches):
        df, n = np.zeros(DIM + 1, np.int64), 0
        for batch in batches:
            for m in counts(batch.column(0)):
                df[:DIM] += (m > 0).sum(0)
                n += len(m)
        df[DIM] = n
        if n:
            yield pa.record_batch({"slot": pa.array(np.arange(DIM + 1)), "n": pa.array(df)})

    rows = train.select("text").mapInArrow(partial, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(DIM + 1, np.int64)
    for r in rows:
        df[r["slot"]] = r["n"]
    return df[:DIM], int(df[DIM])


def cluster(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means with farthest-point starts."""
    centre = [unit(x.mean(0, keepdims=True))[0]]
    while len(centre) < min(k, len(x)):
        centre.append(x[np.argmin((x @ np.array(centre).T).max(1))])
    c = np.array(centre)
    for _ in range(rounds):
        best = (x @ c.T).argmax(1)
        c = unit(np.array([x[best == j].sum(0) if (best == j).any() else c[j] for j in range(len(c))]))
    return c


def fit(train: DataFrame, rows: int = FIT_ROWS, centroids: int = CENTROIDS) -> dict | None:
    """Learn from rows (doc_id, text, lang), all of them fit for training.

    Returns idf, names and languages of centroids, and the least cosine seen for each.
    """
    train = train.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    sizes = {r["lang"]: r["n"] for r in train.groupBy("lang").agg(F.count("*").alias("n"))
             .orderBy(F.desc("n"), "lang").limit(rows).collect()}
    if not sizes:
        return None
    df, n = document_frequency(train)
    idf = np.log((1 + n) / (1 + df)).astype(np.float32) + np.float32(0.05)
    each = max(1, rows // len(sizes))
    bound = F.create_map(*[F.lit(v) for k, m in sizes.items() for v in (k, int(min(1.0, each / m) * (1 << 60)))])
    sample = train.where(draw("doc_id") < bound[F.col("lang")])

    def featured(batches):
        for batch in batches:
            at = 0
            for m in counts(batch.column("text")):
                yield pa.record_batch({
                    "lang": batch.column("lang").slice(at, len(m)),
                    "v": pa.array([r.tobytes() for r in vectors(m, idf)], pa.binary())})
                at += len(m)

    got = sample.select("text", "lang").mapInArrow(featured, "lang string, v binary").collect()
    names, centre, least = [], [], []
    for lang in sorted({r["lang"] for r in got}):
        x = np.array([np.frombuffer(r["v"], np.float32) for r in got if r["lang"] == lang])
        x = x[np.argsort(x @ x.mean(0), kind="stable")]
        c = cluster(x, centroids)
        near = x @ c.T
        for j in range(len(c)):
            own = near[near.argmax(1) == j, j]
            names.append(lang)
            centre.append(c[j])
            least.append(float(own.min()) * 0.5 if len(own) else 0.0)
    return {"idf": idf, "names": names, "centre": np.array(centre, np.float32), "least": np.array(least)} if names else None


def predict(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, lang_pred, score (cosine to the nearest centroid), rejected (farther off than any training row)."""
    rows = docs.select("doc_id", F.when(F.col("text").rlike(r"\p{L}"), F.col("text")).alias("text"))
    if model is None:
        return rows.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    names = np.array(model["names"], object)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def scored(batches):
        for batch in batches:
            text, at = batch.column("text"), 0
            for m in counts(text):
                near = vectors(m, model["idf"]) @ model["centre"].T
                best = near.argmax(1)
                score = np.clip(near[np.arange(len(m)), best].astype(float), 0.0, 1.0)
                none = np.asarray(text.slice(at, len(m)).is_null())
                yield pa.record_batch({
                    "doc_id": batch.column("doc_id").slice(at, len(m)),
                    "lang_pred": pa.array(np.where(none, UNKNOWN, names[best]).tolist(), pa.string()),
                    "score": pa.array(np.where(none, 0.0, score)),
                    "rejected": pa.array(none | (score < model["least"][best]))})
                at += len(m)

    return rows.mapInArrow(scored, f"doc_id {kind}, lang_pred string, score double, rejected boolean")


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the rows that are not held out, predict for all: doc_id, held_out, lang_pred, score, rejected."""
    model = fit(docs.where(~held_out()).select("doc_id", "text", "lang"))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
