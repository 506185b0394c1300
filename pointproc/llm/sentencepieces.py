"""SentencePiece encoding and decoding by a Viterbi search that shares prefixes.

The vocabulary is a SentencePiece model file; its path is a parameter. A text is
marked (a blank in front, blanks belong to the word behind them) and cut in marked
words, which no piece crosses. The distinct words of a batch are sorted
and walked like a trie, depth first: the forward scores of a word's prefix are those
of its predecessor, so only what differs is computed. Ids come back by gathering.

The segmentation has the greatest sum of the model's scores, ties to the longer last
piece. For a model made by merging (BPE) this is not always the one that its merges
give; decoding returns the text exactly in either case. A character without a piece
costs less than any piece and becomes its UTF-8 bytes; so does the mark sign itself,
which a text may hold. Missing texts give missing ids, empty ones no ids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from pointproc.llm.common import lean, pieces

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Distinct words, and characters of them, that a task remembers before it starts anew.
REMEMBER, REMEMBER_CHARS = 200_000, 4 << 20
#: Texts are encoded about so many bytes at a time.
STEP = 1 << 20


class Vocabulary:
    """Pieces and scores of a model file, blanks written as blanks."""

    def __init__(self, path: str = MODEL):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        self.piece = {}
        self.byte = [0] * 256
        self.raw: list[bytes] = [b""] * n
        for i in range(n):
            text = m.id_to_piece(i)
            if m.is_byte(i):
                self.byte[int(text[3:5], 16)] = i
                self.raw[i] = bytes([int(text[3:5], 16)])
            elif not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i)):
                text = text.replace(MARK, " ")
                self.piece[text] = (m.get_score(i), i)
                self.raw[i] = text.encode()
        self.longest = max(map(len, self.piece))
        self.unknown = min(s for s, _ in self.piece.values() if s > -1e8) - 10.0
        for text in self.piece:
            if " " in text.lstrip(" "):
                raise ValueError(f"the piece {text!r} crosses words")
        self.lengths = np.array([len(r) for r in self.raw], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(self.raw), np.uint8)

    def spread(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of the ids, one after the other."""
        return self.bytes[ragged(self.starts[ids], self.lengths[ids])]


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Places start, start + 1, ... of each range, one range after the other."""
    return np.arange(int(length.sum())) + np.repeat(start - (np.cumsum(length) - length), length)


def encode_words(words: list[str], vocabulary: Vocabulary) -> list[list[int]]:
    """Ids of sorted distinct words. Forward scores of a common prefix are kept from word to word."""
    piece, longest, unknown = vocabulary.piece, vocabulary.longest, vocabulary.unknown
    find = piece.get
    best, back = [0.0], [(0, 0)]
    before, out = "", []
    for word in words:
        k, most = 0, min(len(word), len(before))
        while k < most and word[k] == before[k]:
            k += 1
        del best[k + 1:], back[k + 1:]
        for j in range(k + 1, len(word) + 1):
            top, how = (best[j - 1] + unknown, (j - 1, -1)) if find(word[j - 1]) is None else (-np.inf, None)
            for i in range(max(0, j - longest), j):
                found = find(word[i:j])
                if found is not None:
                    s = best[i] + found[0]
                    if s > top:
                        top, how = s, (i, found[1])
            best.append(top)
            back.append(how)
        before, j, ids = word, len(word), []
        while j:
            i, key = back[j]
            if key < 0:
                ids.extend(vocabulary.byte[b] for b in reversed(word[i:j].encode()))
            else:
                ids.append(key)
            j = i
        ids.reverse()
        out.append(ids)
    return out


class Encoder:
    """Encodes Arrow columns, remembering words between batches of a task."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.chars = 0
        self.start, self.length, self.flat = (np.empty(0, np.int64) for _ in range(3))

    def places(self, words: list[str]) -> np.ndarray:
        new = sorted({w for w in words if w not in self.place})
        if new:
            ids = encode_words(new, self.vocabulary)
            length = np.array([len(x) for x in ids], np.int64)
            self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(length) - length])
            self.length = np.concatenate([self.length, length])
            self.flat = np.concatenate([self.flat, np.fromiter((i for x in ids for i in x), np.int64, int(length.sum()))])
            n = len(self.place)
            self.place.update(zip(new, range(n, n + len(new))))
            self.chars += sum(map(len, new))
        return np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))

    def encode(self, text: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """Rows lo..hi: ids of all rows in a line, where each row's begin, and whether decoding gives the row's bytes."""
        text = text.cast(pa.large_string())
        for lo, hi, b in pieces(text, STEP):
            if len(self.place) > REMEMBER or self.chars > REMEMBER_CHARS:
                self.clear()
            part = text.slice(lo, hi - lo).fill_null("")
            split = pc.split_pattern(part, " ")
            offsets = split.offsets.to_numpy().astype(np.int64)
            offsets = offsets - offsets[0]
            words = split.flatten().dictionary_encode()
            code, spelt = words.indices.to_numpy(), words.dictionary.to_pylist()
            whole = np.diff(b.offsets) > 0
            row = np.repeat(np.arange(hi - lo), np.diff(offsets))
            last = np.append(row[1:] != row[:-1], True) if len(row) else np.zeros(0, bool)
            empty = code == (spelt.index("") if "" in spelt else -1)
            # an empty text has no word at all; between two blanks there is none either, they stay with the next word
            use = np.flatnonzero(whole[row] & (last | ~empty))
            code, row = code[use], row[use]
            begun = np.maximum(np.append(-1, use[:-1]), offsets[row] - 1) if len(use) else use
            blanks = use - begun
            at = self.places([" " + w for w in spelt])[code]
            more = np.flatnonzero(blanks > 1)
            if len(more):
                at[more] = self.places([" " * n + spelt[c] for n, c in zip(blanks[more].tolist(), code[more].tolist())])
            length = self.length[at]
            ids = self.flat[ragged(self.start[at], length)]
            ends = np.cumsum(np.bincount(row, weights=length, minlength=hi - lo).astype(np.int64))
            begin = np.append(0, ends)
            raw = self.vocabulary.spread(ids)
            sizes = np.append(0, np.cumsum(self.vocabulary.lengths[ids]))[begin]
            good = np.diff(sizes) == np.diff(b.offsets) + whole
            if good.all():  # each text with its blank in front
                want = np.full(len(raw), 32, np.uint8)
                mask = np.ones(len(raw), bool)
                mask[sizes[:-1][whole]] = False
                want[mask] = b.data
                wrong = np.flatnonzero(want != raw)
                good[np.searchsorted(sizes, wrong, side="right") - 1] = False
            yield lo, hi, ids, begin, good


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, ids: the texts' token ids (missing for missing texts)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        encoder = Encoder(Vocabulary(model))
        for batch in batches:
            text = batch.column("text")
            for lo, hi, ids, begin, _ in encoder.encode(text):
                none = np.asarray(text.slice(lo, hi - lo).is_null())
                column = pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(ids.astype(np.int32)),
                                                  mask=pa.array(none) if none.any() else None)
                yield pa.record_batch([batch.column("doc_id").slice(lo, hi - lo), column], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), f"doc_id {kind}, ids array<int>")


def decode(tokens: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, text from doc_id, ids; ids that are not of the model give an error."""
    kind = tokens.schema["doc_id"].dataType.simpleString()

    def run(batches):
        vocabulary = Vocabulary(model)
        for batch in batches:
            texts = [None if ids is None else vocabulary.spread(np.array(ids, np.int64)).tobytes()[1:].decode()
                     for ids in batch.column("ids").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(lean(run), f"doc_id {kind}, text string")


def digests(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the ids as 4-byte numbers, low byte first), round_trip (decoding gives the text).

    A missing text counts as an empty one here.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        encoder = Encoder(Vocabulary(model))
        for batch in batches:
            for lo, hi, ids, begin, good in encoder.encode(batch.column("text")):
                raw = ids.astype("<i4").tobytes()
                sha = [hashlib.sha256(raw[4 * a:4 * z]).hexdigest() for a, z in zip(begin[:-1].tolist(), begin[1:].tolist())]
                yield pa.record_batch([batch.column("doc_id").slice(lo, hi - lo), pa.array(np.diff(begin)), pa.array(sha), pa.array(good)],
                                      names=["doc_id", "n_tokens", "ids_sha256", "round_trip"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), f"doc_id {kind}, n_tokens long, ids_sha256 string, round_trip boolean")
