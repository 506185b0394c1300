"""Fill-in-the-middle: texts cut in prefix, middle and suffix at token boundaries.

A text's units are words with the blanks in front of them, and the blanks at its end
(blank, tab, line feed, vertical tab, form feed, carriage return). Two numbers drawn
from a digest of the seed and the id choose the boundaries of the middle, two more
whether the text is left plain and in which order the parts are written.

Boundaries are not kept as a list. A learned index maps a boundary's rank to its
offset: straight lines are fitted to all boundaries of some texts so that none is
farther off than a bound, lines that do not keep to it are halved, and what a line
misses is stored in one byte for each boundary. A cut is predicted by its line and
set right by the stored residual, so it is exact; arithmetic is in whole numbers.

Missing and empty texts have no unit and stay plain, as do texts that hold a marker.
A missing id draws as an empty one. Equal ids draw alike. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pointproc.llm.common import Bytes, pieces

SEED, FIM_PERCENT, SPM_PERCENT = 42, 50, 80
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: A line misses no boundary by more bytes than this; the residual fits one byte.
ERROR = 127
#: Boundaries under a line before any halving.
SPAN = 4096
#: Texts are indexed about so many bytes at a time; a longer one has an index of its own.
STEP = 2 << 20


class RankIndex:
    """Rank to offset for rising offsets, by straight lines and one-byte residuals."""

    def __init__(self, offsets: np.ndarray, error: int = ERROR, span: int = SPAN):
        n = len(offsets)
        offsets = offsets.astype(np.int64)
        self.residual = np.zeros(n, np.int8)
        start = np.arange(0, n, span)
        end = np.minimum(start + span, n)
        lines = []
        while len(start):
            length = end - start
            base = offsets[start]
            rise, run = offsets[end - 1] - base, np.maximum(length - 1, 1)
            line = np.repeat(np.arange(len(start)), length)
            step = np.arange(len(line)) - np.repeat(np.cumsum(length) - length, length)
            rank = start[line] + step
            miss = offsets[rank] - (base[line] + step * rise[line] // run[line])
            good = np.maximum.reduceat(np.abs(miss), np.cumsum(length) - length) <= error
            lines.append(np.stack([start[good], base[good], rise[good], run[good]]))
            keep = good[line]
            self.residual[rank[keep]] = miss[keep]
            start, end = start[~good], end[~good]
            middle = (start + end) // 2
            start, end = np.concatenate([start, middle]), np.concatenate([middle, end])
        table = np.concatenate(lines, axis=1) if lines else np.zeros((4, 0), np.int64)
        self.start, self.base, self.rise, self.run = table[:, np.argsort(table[0])]

    def offset(self, rank: np.ndarray) -> np.ndarray:
        """Exact offsets of the ranks: the line's prediction and the stored residual."""
        line = np.searchsorted(self.start, rank, side="right") - 1
        return self.base[line] + (rank - self.start[line]) * self.rise[line] // self.run[line] + self.residual[rank]


def boundaries(b: Bytes) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of all boundaries of the texts, one text after the other, and the rank of each text's first (n + 1 of them)."""
    _, end, doc = b.words()
    n = len(b.offsets) - 1
    size = np.diff(b.offsets)
    final = b.data[b.offsets[1:] - 1] if len(b.data) else np.zeros(n, np.uint8)
    trailing = np.flatnonzero((size > 0) & ((final == 32) | ((final >= 9) & (final <= 13))))
    at = np.concatenate([b.offsets[:-1], end, b.offsets[trailing + 1]])
    owner = np.concatenate([np.arange(n), doc, trailing])
    order = np.lexsort((at, owner))
    return at[order], np.append(0, np.cumsum(np.bincount(owner, minlength=n)))


def draws(doc_id, seed: int) -> tuple[int, int, int, int]:
    text = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(text[k:k + 8], 16) for k in (0, 8, 16, 24))


def rearrange(form: str, prefix: bytes, middle: bytes, suffix: bytes) -> bytes:
    if form == "psm":
        return b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))
    return b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))


def rebuild(form: str, output: bytes) -> bytes:
    """The text from what was written. No part holds a marker, so the first of each kind is the one set."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    a, rest = output[len(first):].split(second, 1)
    z, middle = rest.split(MIDDLE, 1)
    return a + middle + z if form == "psm" else z + middle + a


def cut(text: pa.Array, ids: list, seed: int, fim_percent: int, spm_percent: int):
    """Rows lo..hi: number of units, form, code points of prefix and middle (None if plain), and output of each text."""
    for lo, hi, b in pieces(text, STEP):
        at, first = boundaries(b)
        n = np.diff(first) - 1
        index = RankIndex(at)
        drawn = np.array([draws(i, seed) for i in ids[lo:hi]], np.int64).reshape(-1, 4)
        one, two = drawn[:, 0] % (n + 1), drawn[:, 1] % (n + 1)
        left, right = index.offset(first[:-1] + np.minimum(one, two)), index.offset(first[:-1] + np.maximum(one, two))
        points = np.append(0, np.cumsum((b.data & 0xC0) != 0x80))
        before, inside = points[left] - points[b.offsets[:-1]], points[right] - points[left]
        raw = b.data.tobytes()
        forms, out = [], []
        for k, (a, x, y, z) in enumerate(zip(b.offsets[:-1].tolist(), left.tolist(), right.tolist(), b.offsets[1:].tolist())):
            whole = raw[a:z]
            if not whole or drawn[k, 2] % 100 >= fim_percent or PREFIX in whole or SUFFIX in whole or MIDDLE in whole:
                forms.append("plain")
                out.append(whole)
            else:
                forms.append("spm" if drawn[k, 3] % 100 < spm_percent else "psm")
                out.append(rearrange(forms[-1], raw[a:x], raw[x:y], raw[y:z]))
        plain = np.array([f == "plain" for f in forms], bool)
        yield lo, hi, n, forms, pa.array(before, mask=plain), pa.array(inside, mask=plain), out


def transform(docs: DataFrame, seed: int = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """doc_id, n (units), form (plain, psm, spm), prefix_chars, middle_chars, output: each text as it is trained on."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            for lo, hi, n, forms, before, inside, out in cut(batch.column("text"), ids.to_pylist(), seed, fim_percent, spm_percent):
                text = pa.array(out, pa.binary()).cast(pa.string())
                yield pa.record_batch([ids.slice(lo, hi - lo), pa.array(n), pa.array(forms), before, inside, text],
                                      names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(rows: DataFrame) -> DataFrame:
    """doc_id, text from doc_id, form, output; a missing output gives a missing text."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            out = batch.column("output").cast(pa.binary()).to_pylist()
            texts = [None if o is None else rebuild(f, o) for f, o in zip(batch.column("form").to_pylist(), out)]
            yield pa.record_batch([batch.column("doc_id"), pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "text"])

    return rows.select("doc_id", "form", "output").mapInArrow(run, f"doc_id {kind}, text string")


def digests(docs: DataFrame, seed: int = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """As `transform`, with output_sha256 and restored_sha256 (of the text rebuilt from output and form) for the output."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def sha(texts):
        return pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            for lo, hi, n, forms, before, inside, out in cut(batch.column("text"), ids.to_pylist(), seed, fim_percent, spm_percent):
                yield pa.record_batch(
                    [ids.slice(lo, hi - lo), pa.array(n), pa.array(forms), before, inside, sha(out), sha(map(rebuild, forms, out))],
                    names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"])

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string")


#: DuckDB text for `digests` over documents: units as a list, its first items joined.
SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents),
e AS (
  SELECT *, CAST(len(u) AS BIGINT) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
         CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
f AS (
  SELECT doc_id, t, n,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
              WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form,
         array_to_string(list_slice(u, 1, least(h1 % (n + 1), h2 % (n + 1))), '') AS p,
         array_to_string(list_slice(u, least(h1 % (n + 1), h2 % (n + 1)) + 1, greatest(h1 % (n + 1), h2 % (n + 1))), '') AS m,
         array_to_string(list_slice(u, greatest(h1 % (n + 1), h2 % (n + 1)) + 1, n), '') AS s FROM e)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM f
"""
