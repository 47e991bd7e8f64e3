"""Byte-level BPE encoding and decoding with a segment tree over the ranks of adjacent pairs.

The tree's leaves hold rank and place of each adjacent pair; its root is the lowest-ranked, leftmost merge. A merge
changes three leaves, each in logarithmic time, until the root holds no rank. Distinct words of a batch are encoded
side by side, one tree a row of a matrix; words longer than LONG bytes have a tree of their own. Word results are
kept in a bounded cache.

Cases: null and empty texts have no tokens; texts and words of any length are encoded whole; the special tokens'
strings are their ids; pairs of equal rank merge from the left; ill-formed bytes decode to the replacement character, as
public libraries do; equal rows each give their row; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, IntegerType

from skein.llm.common import bounded_batches, kept_for, table, trimmed

LONG = 128
#: Words whose results are kept, and words encoded side by side.
CACHE, BATCH = 250_000, 1 << 14
#: Texts split at once, by characters.
CHUNK = 1 << 20
NONE = np.int64(1) << 40
#: The split pattern of this family of vocabularies is
#:   's|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+
#: with the white space of Unicode. For texts of no code point over U+024F a faster library does with plain ranges.
SPACE, NARROW_SPACE = r"\t-\r \x85\xa0  -     　", r"\t-\r \x85\xa0"
LETTER, NARROW_LETTER = r"\p{L}", r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
NUMBER, NARROW_NUMBER = r"\p{N}", r"0-9\xb2\xb3\xb9\xbc-\xbe"


def split_pattern(space: str, letter: str, number: str) -> str:
    return f"'(?:[stmd]|re|ve|ll)| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+"


NARROW = re.compile(split_pattern(NARROW_SPACE, NARROW_LETTER, NARROW_NUMBER))
ANY = regex.compile(split_pattern(SPACE, LETTER, NUMBER), regex.V0)
WIDE = re.compile(r"[^\0-ɏ]")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte: itself if printable, else the next of those from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def first_slot(keys: np.ndarray, size: int) -> np.ndarray:
    return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - size.bit_length())).astype(np.int64)


def hash_slots(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An open table of the keys (-1: no key) and of their places, of a power of two slots, at most an eighth in use."""
    size = 1 << max(4, (8 * len(keys)).bit_length())
    table, ranks = np.full(size, -1, np.int64), np.zeros(size, np.int64)
    at, left = first_slot(keys, size), np.arange(len(keys))
    while len(left):
        free = left[table[at[left]] < 0]
        _, one = np.unique(at[free], return_index=True)  # one key a slot and round
        won = free[one]
        table[at[won]], ranks[at[won]] = keys[won], won
        left = np.setdiff1d(left, won)
        taken = left[table[at[left]] >= 0]
        at[taken] = (at[taken] + 1) % size
    return table, ranks


class Codec:
    """Encodes and decodes by one vocabulary file. Encoded ids are decimals joined by commas or, if packed, 32-bit
    integers in a row."""

    def __init__(self, path: str, packed: bool = False):
        self.packed = packed
        told = json.load(open(path, encoding="utf-8"))
        vocab, merges = told["model"]["vocab"], told["model"]["merges"]
        letters = byte_letters()
        self.special = {x["content"]: x["id"] for x in told["added_tokens"]}
        self.bytes_of = {i: bytes(letters[c] for c in t) for t, i in vocab.items()} | {i: t.encode() for t, i in self.special.items()}
        self.of_byte = np.zeros(256, np.int64)
        for letter, b in letters.items():
            self.of_byte[b] = vocab[letter]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in merges]
        self.base = max(vocab.values()) + 1
        keys = np.array([vocab[a] * self.base + vocab[b] for a, b in pairs], np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.slot_keys, self.slot_ranks = hash_slots(keys)
        self.rank_of = dict(zip(keys.tolist(), range(len(keys)), strict=True))
        self.ids: dict[str, bytes] = {}
        self.texts: dict[str, bytes] = {}
        self.cut = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None

    def split(self, text: str) -> list[str]:
        if self.cut is None or not any(s in text for s in self.special):
            return (ANY if WIDE.search(text) else NARROW).findall(text)
        return [w for part in self.cut.split(text) for w in ([part] if part in self.special else self.split(part))]

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.base + right
        at = first_slot(key, len(self.slot_keys))
        there = self.slot_keys[at]
        out = np.where(there == key, self.slot_ranks[at], NONE)
        open_ = np.flatnonzero((there != key) & (there >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) % len(self.slot_keys)
            there = self.slot_keys[at[open_]]
            hit = there == key[open_]
            out[open_[hit]] = self.slot_ranks[at[open_[hit]]]
            open_ = open_[~hit & (there >= 0)]
        return out

    def long_word(self, data: bytes) -> list[int]:
        """One segment tree in plain Python."""
        ids = self.of_byte[np.frombuffer(data, np.uint8)].tolist()
        n, size = len(ids), 1
        while size < len(ids):
            size *= 2
        none, get, base, merged = (1 << 60, -1), self.rank_of.get, self.base, self.merged
        rank = lambda i, j: (r, i) if j < n and i >= 0 and (r := get(ids[i] * base + ids[j])) is not None else none
        tree = [none] * size + [rank(i, i + 1) for i in range(n)] + [none] * (size - n)
        for k in range(size - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while tree[1][1] >= 0:
            r, i = tree[1]
            j = after[i]
            ids[i] = int(merged[r])
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            h = before[i]
            for leaf, value in ((j, none), (i, rank(i, k)), *(((h, rank(h, i)),) if h >= 0 else ())):
                node = size + leaf
                tree[node] = value
                while node > 1:
                    node //= 2
                    tree[node] = min(tree[2 * node], tree[2 * node + 1])
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return out

    def words_side_by_side(self, words: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
        """Of words of at most size bytes (a power of two): ids end to end, and how many each has."""
        k, shift = len(words), np.int64(size.bit_length())
        n = np.fromiter(map(len, words), np.int64, k)
        flat = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        stride = size + 1  # one more place, for neighbours that don't exist
        row = np.repeat(np.arange(k), n)
        col = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
        ids = np.full(k * stride, self.base, np.int64)
        ids[row * stride + col] = flat
        place = np.tile(np.arange(stride), k)
        after, before = np.minimum(place + 1, size), place - 1
        before[before < 0] = size
        tree = np.full(k * 2 * size, NONE << shift, np.int64)
        pair = np.flatnonzero(col + 1 < n[row])
        tree[row[pair] * 2 * size + size + col[pair]] = (self.pair_ranks(flat[pair], flat[pair + 1]) << shift) | col[pair]
        grid = tree.reshape(k, 2 * size)
        level = size
        while level > 1:
            grid[:, level // 2 : level] = np.minimum(grid[:, level : 2 * level : 2], grid[:, level + 1 : 2 * level : 2])
            level //= 2
        root = 1
        active = np.flatnonzero((grid[:, root] >> shift) < NONE)
        alive = np.zeros(k * stride, bool)
        alive[row * stride + col] = True
        while len(active):
            top = tree[active * 2 * size + root]
            rank, i = top >> shift, top & ((np.int64(1) << shift) - 1)
            base = active * stride
            j = after[base + i]
            ids[base + i] = self.merged[rank]
            alive[base + j] = False
            far, back = after[base + j], before[base + i]
            after[base + i] = far
            before[base + far] = np.where(far < size, i, before[base + far])
            leaves = active * 2 * size + size
            tree[leaves + j] = NONE << shift
            right = np.where((far < size) & (ids[base + far] < self.base), self.pair_ranks(ids[base + i], ids[base + far]), NONE)
            tree[leaves + i] = (right << shift) | i
            has = back < size
            left = self.pair_ranks(ids[base[has] + back[has]], ids[base[has] + i[has]])
            tree[leaves[has] + back[has]] = (left << shift) | back[has]
            trunk = active * 2 * size
            for leaf in (j, i, np.where(has, back, i)):
                node = size + leaf
                while node[0] > 1:
                    node = node >> 1
                    at = trunk + 2 * node
                    tree[trunk + node] = np.minimum(tree[at], tree[at + 1])
            active = active[(tree[trunk + root] >> shift) < NONE]
        counts = alive.reshape(k, stride).sum(1)
        return ids[alive], counts

    def learn(self, words: list[str]) -> None:
        """Puts the words' ids and texts into the cache."""
        for word in self.special.keys() & set(words):
            self._keep(word, [self.special[word]])
        if self.special:
            words = [w for w in words if w not in self.special]
        data = [w.encode() for w in words]
        sizes = np.fromiter(map(len, data), np.int64, len(data))
        for k in np.flatnonzero(sizes > LONG).tolist():
            self._keep(words[k], self.long_word(data[k]))
        done = 0
        for size in (1 << e for e in range(1, LONG.bit_length())):
            own = np.flatnonzero((sizes > done) & (sizes <= size)).tolist()
            done = size
            for at in range(0, len(own), BATCH):
                part = own[at : at + BATCH]
                self._keep_all([words[k] for k in part], *self.words_side_by_side([data[k] for k in part], size))

    def _keep_all(self, words: list[str], flat: np.ndarray, counts: np.ndarray) -> None:
        begin, ids = 0, flat.tolist()
        for word, n in zip(words, counts.tolist(), strict=True):
            self._keep(word, ids[begin : begin + n])
            begin += n

    def _keep(self, word: str, ids: list[int]) -> None:
        self.ids[word] = array("i", ids).tobytes() if self.packed else ",".join(map(str, ids)).encode()
        self.texts[word] = b"".join([self.bytes_of[i] for i in ids])

    def encoded(self, texts: list[str | None]) -> Iterator[tuple[bytes, bytes]]:
        """For each text its ids, and the bytes that they decode to."""
        at, comma = 0, b"" if self.packed else b","
        while at < len(texts):
            split, size = [], 0
            while at < len(texts) and (size < CHUNK or not split):
                split.append(self.split(texts[at] or ""))
                size += len(texts[at] or "")
                at += 1
            if len(self.ids) > CACHE:
                self.ids.clear()
                self.texts.clear()
            ids, found = self.ids, self.texts
            self.learn(list({w for words in split for w in words if w not in ids}))
            for words in split:
                yield comma.join([ids[w] for w in words]), b"".join([found[w] for w in words])

    def encode(self, text: str | None) -> list[int]:
        joined = next(self.encoded([text]))[0]
        return np.frombuffer(joined, np.int32).tolist() if self.packed else [int(x) for x in joined.split(b",") if x]

    def decode(self, ids: list[int]) -> str:
        return b"".join([self.bytes_of[i] for i in ids]).decode("utf-8", "replace")


class IdCodec(Codec):
    """Encodes to one array of ids for many texts; words' ids are kept end to end."""

    def __init__(self, path: str):
        super().__init__(path, packed=True)
        self._clear()

    def _clear(self) -> None:
        self.place: dict[str, int] = {}
        self.new: list[tuple[np.ndarray, np.ndarray]] = []
        self.flat, self.starts = np.empty(0, np.int32), np.zeros(1, np.int64)

    def _keep(self, word: str, ids: list[int]) -> None:
        self._keep_all([word], np.array(ids), np.array([len(ids)]))

    def _keep_all(self, words: list[str], flat: np.ndarray, counts: np.ndarray) -> None:
        self.place.update(zip(words, range(len(self.place), len(self.place) + len(words)), strict=True))
        self.new.append((flat, counts))

    def ids_of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The texts' ids end to end, and how many each has."""
        split = [self.split(t or "") for t in texts]
        if len(self.place) > 4 * CACHE:
            self._clear()
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        words = list(chain.from_iterable(split))
        word = np.fromiter(map(self.place.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(word < 0)
        if len(new):
            missing = [words[k] for k in new.tolist()]
            self.learn(list(set(missing)))
            self.flat = np.concatenate([self.flat, *(ids.astype(np.int32) for ids, _ in self.new)])
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(np.concatenate([n for _, n in self.new]))])
            self.new = []
            word[new] = np.fromiter(map(self.place.__getitem__, missing), np.int64, len(missing))
        begin, n = self.starts[word], self.starts[word + 1] - self.starts[word]
        ends = np.cumsum(n)
        ids = self.flat[np.repeat(begin - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)]
        stops = np.append(0, ends)[np.cumsum(np.append(0, sizes))]
        return ids, np.diff(stops)


@functools.lru_cache(maxsize=1)
def codec(path: str, packed: bool) -> Codec:
    """One a Python worker; it stays for later tasks."""
    return Codec(path, packed)


@functools.lru_cache(maxsize=1)
def id_codec(path: str) -> IdCodec:
    return IdCodec(path)


kept_for(__name__, codec.cache_clear)
kept_for("skein.llm.training_order", id_codec.cache_clear)


def _rows(batches: Iterator[pa.RecordBatch], path: str, packed: bool):
    for whole in batches:
        for at in range(0, whole.num_rows, 1000):
            batch = whole.slice(at, 1000)
            yield batch, codec(path, packed).encoded(batch.column("text").to_pylist())


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """The columns of docs, token_ids array<int> and round_trip, whether they decode to the text."""
    kept = [c for c in docs.columns if c not in ("token_ids", "round_trip")]

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in _rows(batches, path, True):
            parts, same = [], []
            for (ids, data), text in zip(found, batch.column("text"), strict=True):
                parts.append(ids)
                same.append(data == (text.as_py() or "").encode())
            ends = np.cumsum([0, *(len(x) // 4 for x in parts)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(parts), np.int32)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), lists, pa.array(same, pa.bool_())], [*kept, "token_ids", "round_trip"])

    bounded_batches(docs.sparkSession)
    return docs.select(*kept).mapInArrow(run, docs.select(*kept).schema.add("token_ids", ArrayType(IntegerType())).add("round_trip", "boolean"))


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """The columns of encoded and decoded string, from token_ids."""
    kept = [c for c in encoded.columns if c != "decoded"]

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [codec(path, True).decode(ids or []) for ids in batch.column("token_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(texts, pa.string())], [*kept, "decoded"])

    return encoded.select(*kept).mapInArrow(run, encoded.select(*kept).schema.add("decoded", "string"))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and SHA-256 of ids and decoded text, without carrying both through the engine."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in _rows(batches, path, False):
            n, first, second = [], [], []
            for ids, data in found:
                n.append(ids.count(b",") + 1 if ids else 0)
                first.append(hashlib.sha256(ids).hexdigest())
                second.append(hashlib.sha256(data.decode("utf-8", "replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(first), pa.array(second)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), vocabulary_path())
