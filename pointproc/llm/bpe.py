"""BPE encoding and decoding by a deterministic tokenization automaton.

The automaton reads token sequences: it has a state for each token that may be
followed, an arc labelled t leads to the state of t, and the sequences it accepts
are exactly those that merging gives. It is compiled merge by merge. The gadget of
a merge (u, v) -> w

* gives w the arcs that leave v, as w ends like v,
* takes the arc v away behind u, as that pair no longer stands side by side,
* lays an arc w beside each arc u, as w begins like u.

States with equal arcs and tokens with equal entries are then folded into classes,
so that the table of arcs has (state class, token class) bits. A text has exactly
one accepted token sequence, and so has each of its prefixes; a word is encoded
from left to right by following, at each place, the spellings that begin there and
whose arc leaves the place's state. New words of many texts take each step together,
as arrays. Time is linear in the length of a word. Ids are
decoded by emitting the labels of their arcs.

The vocabulary file is a parameter. Normalising (composed characters, white space,
lower case), the split into words and the special tokens, which are found before
normalising, follow the file's declarations; a file that declares anything else is
refused. Missing texts count as empty, both give no ids. Repeated rows are encoded
each, other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import unicodedata
from pyspark.sql import DataFrame

from pointproc.llm.common import heads

VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"
#: Distinct words that a task remembers before it starts anew.
REMEMBER = 200_000
#: Words that are encoded together.
AT_ONCE = 1 << 14
#: Texts are turned into columns about so many characters at a time.
STEP = 4 << 20

# Fixed values of the file format: how it declares what is done here.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZER = {"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}


def byte_signs() -> list[str]:
    """The printable sign that stands for each byte in the file."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    signs = {b: chr(b) for b in plain}
    for k, b in enumerate(b for b in range(256) if b not in signs):
        signs[b] = chr(256 + k)
    return [signs[b] for b in range(256)]


def arcs_after_merges(n_base: int, merges: list[tuple[int, int]], ends: np.ndarray) -> np.ndarray:
    """The arc table by successive merge gadgets: bit s of column t says that the state of token s has an arc t.

    Tokens are numbered in the order in which they come to be: `n_base` symbols, then
    one for each merge. Those in `ends` finish a word and have no state; the others
    are numbered among themselves. Each merge must join tokens that exist by then.
    """
    n = n_base + len(merges)
    state = np.cumsum(~ends) - 1
    table = np.zeros((-(-(int(state[-1]) + 1) // 8), n), np.uint8)
    at, bit = (state >> 3).tolist(), (state & 7).astype(np.uint8)
    one = np.uint8(1) << bit
    ends = ends.tolist()
    for s in range(n_base):
        if not ends[s]:
            table[at[s], :n_base] |= one[s]
    for w, (u, v) in enumerate(merges, n_base):
        if u >= w or v >= w or ends[u]:
            raise ValueError("merges must be in the order in which their parts come to be")
        if not table[at[u], v] & one[u]:
            raise ValueError("a merge of tokens that never stand side by side")
        if not ends[w]:
            table[at[w], :w] |= (table[at[v], :w] >> bit[v] & np.uint8(1)) << bit[w]
        table[at[u], v] &= ~one[u]
        table[:, w] = table[:, u]
    return table


def fold(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows and the class of each."""
    keys = np.ascontiguousarray(rows).view([("", f"V{rows.shape[1]}")]).ravel()
    _, first, group = np.unique(keys, return_index=True, return_inverse=True)
    return rows[first], group


class Automaton:
    """Compiled merges: classes, arc bits by state class, and the spellings of tokens as a trie of symbols.

    A symbol is a byte, or 256 plus a byte where it ends a word.
    """

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        signs = byte_signs()
        names = signs + [s + suffix for s in signs]
        number = {name: k for k, name in enumerate(names)}
        for a, b in merges:
            if a + b in number:
                raise ValueError(f"two merges give {a + b!r}")
            number[a + b] = len(number)
            names.append(a + b)
        ends = np.array([name.endswith(suffix) for name in names])
        table = arcs_after_merges(512, [(number[a], number[b]) for a, b in merges], ends)
        self.ids = np.array([vocab[name] for name in names])
        self.n_states = int((~ends).sum())
        table = np.ascontiguousarray(table.T)
        entries, entry = fold(table)
        del table
        by_state = np.concatenate([np.packbits(np.unpackbits(entries[:, k:k + 1], axis=1, bitorder="little").T, axis=1, bitorder="little")
                                   for k in range(entries.shape[1])])[:self.n_states]
        states, group = fold(by_state)
        everything = np.full((1, states.shape[1]), 255, np.uint8)  # the start of a word
        self.states = np.concatenate([states, everything])
        self.entry = entry
        self.after = np.full(len(names), -1)
        self.after[~ends] = group
        trie: dict[int, int] = {}
        token = [-1]
        byte = {sign: b for b, sign in enumerate(signs)}
        for k, name in enumerate(names):
            spelt = [byte[c] for c in name.removesuffix(suffix)]
            if ends[k]:
                spelt[-1] += 256
            node = 0
            for symbol in spelt:
                to = trie.setdefault(node << 9 | symbol, len(token))
                if to == len(token):
                    token.append(-1)
                node = to
            token[node] = k
        self.token = np.array(token)
        self.keys, self.to = slots(np.array(list(trie)), np.array(list(trie.values())))

    def step(self, node: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The trie's nodes after a symbol each, or -1."""
        key = node << 9 | symbol
        at = spread(key, len(self.keys))
        out = np.full(len(key), -1)
        left = np.arange(len(key))
        while len(left):
            found = self.keys[at]
            hit = found == key[left]
            out[left[hit]] = self.to[at[hit]]
            on = ~hit & (found >= 0)
            left, at = left[on], (at[on] + 1) % len(self.keys)
        return out

    def spellings(self, symbol: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where a token's spelling begins and ends, and the token, for all that stand before the given ends."""
        out = [np.empty((3, 0), np.int64)]
        at = np.arange(len(symbol))
        node, end = np.zeros(len(at), np.int64), at
        while len(at):
            node = self.step(node, symbol[end])
            on = node >= 0
            at, node, end = at[on], node[on], end[on] + 1
            token = self.token[node]
            some = token >= 0
            out.append(np.stack([at[some], end[some], token[some]]))
            on = end < stop[at]
            at, node, end = at[on], node[on], end[on]
        return tuple(np.concatenate(out, 1))

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token numbers of words that are not empty, and where each word's begin; all words go from left to right at once."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        stop = np.cumsum(size)
        symbol = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        symbol[stop - 1] += 256
        word = np.repeat(np.arange(len(words)), size)
        begin, end, token = self.spellings(symbol, stop[word])
        word = word[begin]
        place = begin - (stop - size)[word]
        order = np.argsort(place, kind="stable")
        begin, end, token, place = (begin + word)[order], (end + word)[order], token[order], place[order]  # a cell before each sign and one behind the word
        byte, bit = self.entry[token] >> 3, (self.entry[token] & 7).astype(np.uint8)
        state = np.full(len(symbol) + len(words), -1)
        taken, back = state.copy(), state.copy()
        edges = np.append(np.flatnonzero(heads(place)), len(place)).tolist()
        for lo, hi in zip(edges, edges[1:]):
            arc = lo + np.flatnonzero(self.states[state[begin[lo:hi]], byte[lo:hi]] >> bit[lo:hi] & np.uint8(1))
            to = end[arc]
            state[to], taken[to], back[to] = self.after[token[arc]], token[arc], begin[arc]
        first, at = stop - size + np.arange(len(words)), stop + np.arange(len(words))
        ends = np.zeros(len(state), bool)
        while len(at):
            ends[at] = True
            at = back[at]
            on = at > first
            at, first = at[on], first[on]
        return taken[ends], np.cumsum(np.append(0, np.add.reduceat(ends, stop - size + np.arange(len(words))) if len(words) else []), dtype=np.int64)


def spread(key: np.ndarray, n: int) -> np.ndarray:
    """A slot for each key; n is a power of two."""
    return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - n.bit_length() + 1)).astype(np.int64)


def slots(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in a table, each in the first free slot from its own on, and their values; free slots hold -1."""
    n = 1 << max(1, int(len(key) * 4).bit_length())
    keys, values = np.full(n, -1), np.full(n, -1)
    at = spread(key, n)
    while len(key):
        free = keys[at] < 0
        keys[at[free]], values[at[free]] = key[free], value[free]  # of several for one slot the last stays
        left = keys[at] != key
        key, value, at = key[left], value[left], (at[left] + 1) % n
    return keys, values


class Tokenizer:
    """A vocabulary file: special tokens, normalising, split, automaton, labels."""

    def __init__(self, path: str = VOCABULARY):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        plain = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "byte_fallback": False, "ignore_merges": False}
        if spec["normalizer"] != NORMALIZER or spec["pre_tokenizer"] != PRE_TOKENIZER or spec["decoder"] is not None \
                or any(model.get(k) != v for k, v in plain.items()) or not model["end_of_word_suffix"]:
            raise ValueError(f"{path} declares steps that are not known here")
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.automaton = Automaton(model["vocab"], merges, model["end_of_word_suffix"])
        self.special = {}
        for t in spec["added_tokens"]:
            if t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"]:
                raise ValueError(f"the special token {t['content']!r} has rules that are not known here")
            self.special[t["content"]] = t["id"]
        longest = sorted(self.special, key=len, reverse=True)
        self.marks = regex.compile("|".join(map(regex.escape, longest)) or r"(?!)")
        self.labels = {i: t.encode() for t, i in (model["vocab"] | self.special).items()}
        self.split = regex.compile(SPLIT)
        self.memory: dict[str, bytes] = {}

    def __getstate__(self):
        return self.__dict__ | {"memory": {}}

    def words(self, text: str) -> list[str]:
        """Normalised words of a text without special tokens."""
        if not text.isascii():
            if newer_signs()[np.frombuffer(text.encode("utf-32-le"), np.uint32)].any():
                return split_by_library(text)
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # no form of its own at the end of a word
        return self.split.findall(text.lower())

    def learn(self, words: set[str]) -> None:
        """Remember the ids of words; what was remembered before is dropped when it is much."""
        new = words.difference(self.memory)
        if len(self.memory) + len(new) > REMEMBER:
            self.memory.clear()
            new = words
        new = list(new)
        for lo in range(0, len(new), AT_ONCE):
            part = new[lo:lo + AT_ONCE]
            tokens, ends = self.automaton.encode([w.encode() for w in part])
            raw, ends = self.automaton.ids[tokens].astype("<u4").tobytes(), (ends * 4).tolist()
            self.memory.update(zip(part, map(raw.__getitem__, map(slice, ends, ends[1:]))))

    def encode(self, text: str) -> bytes:
        """Ids of a text as 4-byte numbers, low byte first."""
        return next(self.encode_all([text]))

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of texts; words that are not remembered are encoded together."""
        split, new = [], set()
        for text in texts:
            marks = self.marks.findall(text) if "<" in text else []
            parts = [self.words(piece) for piece in (self.marks.split(text) if marks else [text])]
            new.update(*parts)
            split.append((marks, parts))
        self.learn(new)
        for marks, parts in split:
            out = list(map(self.memory.__getitem__, parts[0]))
            for mark, words in zip(marks, parts[1:]):
                out.append(self.special[mark].to_bytes(4, "little"))
                out += map(self.memory.__getitem__, words)
            yield b"".join(out)

    def decode(self, ids: list[int]) -> bytes:
        """Labels of the ids with blanks between, as UTF-8; an id that is not of the file gives an error."""
        return b" ".join(map(self.labels.__getitem__, ids))


@functools.cache
def newer_signs() -> np.ndarray:
    """For each code point whether this Python's tables do not know it."""
    return np.array([unicodedata.category(chr(c)) == "Cn" for c in range(0x110000)])


@functools.cache
def library_steps():
    from tokenizers import Regex, normalizers, pre_tokenizers

    return (normalizers.Sequence([normalizers.NFC(), normalizers.Replace(Regex(r"\s+"), " "), normalizers.Lowercase()]),
            pre_tokenizers.Split(Regex(SPLIT), "removed", invert=True))


def split_by_library(text: str) -> list[str]:
    """Normalised words of a text with signs so new that versions of the character tables differ in them."""
    normal, split = library_steps()
    return [w for w, _ in split.pre_tokenize_str(normal.normalize_str(text))]


@functools.lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


def steps(batches, *columns: str, limit: int = STEP) -> Iterator[tuple[list, ...]]:
    """Rows of Arrow batches as lists, so many at a time that their texts (the last column) stay near a limit."""
    for batch in batches:
        sizes = np.diff(np.asarray(batch.column(columns[-1]).cast(pa.large_string()).fill_null("").buffers()[1]).view(np.int64)[:len(batch) + 1]) \
            if len(batch) else np.empty(0, np.int64)
        cut = np.flatnonzero(np.diff(np.cumsum(sizes) // limit)) + 1
        for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(batch)]):
            part = batch.slice(lo, hi - lo)
            yield tuple(part.column(c).to_pylist() for c in columns)


def encode(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, ids: the texts' token ids."""
    kind, coder = docs.schema["doc_id"].dataType.simpleString(), tokenizer(path)

    def run(batches):
        for doc, text in steps(batches, "doc_id", "text"):
            raw = list(coder.encode_all([t or "" for t in text]))
            ends = np.cumsum([0, *[len(r) >> 2 for r in raw]])
            ids = pa.LargeListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(raw), "<i4")))
            yield pa.record_batch([pa.array(doc), ids.cast(pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode(tokens: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, text from doc_id, ids: the labels with blanks between; missing ids give a missing text."""
    kind, labels = tokens.schema["doc_id"].dataType.simpleString(), tokenizer(path).labels

    def run(batches):
        for batch in batches:
            texts = [None if ids is None else b" ".join(map(labels.__getitem__, ids)).decode() for ids in batch.column("ids").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def digests(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the ids as 4-byte numbers, low byte first), decoded_sha256 (of the decoded text)."""
    kind, coder = docs.schema["doc_id"].dataType.simpleString(), tokenizer(path)

    def run(batches):
        for doc, text in steps(batches, "doc_id", "text"):
            n, a, b = [], [], []
            for raw in coder.encode_all([t or "" for t in text]):
                n.append(len(raw) >> 2)
                a.append(hashlib.sha256(raw).hexdigest())
                b.append(hashlib.sha256(coder.decode(np.frombuffer(raw, "<u4").tolist())).hexdigest())
            yield pa.record_batch([pa.array(doc), pa.array(n), pa.array(a), pa.array(b)],
                                  names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
