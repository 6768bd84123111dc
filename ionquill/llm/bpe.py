"""Byte-level BPE: merges found by a segment tree over byte positions.

A piece of text (one match of the split pattern) starts as its bytes. The
leaf at a position holds the rank of the pair that starts there, and every
inner node the least rank below it, leftmost first on ties. The root therefore
names the next merge, and a merge changes three leaves: the pair's own, the one
of the swallowed neighbour, and the pair that ends at the merged token, each
carried to the root in logarithmic time.

``encode_piece`` is that algorithm on one piece of any length. ``encode_many``
runs it on thousands of short pieces at once, one tree to a row of an array.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NONE = np.int64(1) << 40
SHORT = 32
TEXTS_AT_ONCE = 512


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class BytePairs:
    """Encoder and decoder by merge ranks; ``pattern`` splits text before merging."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, kept: int = 600_000):
        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.kept = kept
        self.token = dict(zip(ranks.values(), ranks.keys(), strict=True))
        self.byte = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        if (self.byte < 0).any():
            raise ValueError("the ranks lack single bytes, so not every text can be encoded")
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.pair_rank = pairs
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_values = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int64)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    # one piece

    def encode_piece(self, piece: bytes) -> list[int]:
        if not piece:
            return []
        n = len(piece)
        ids = self.byte[np.frombuffer(piece, np.uint8)].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        width = 1 << max(n - 1, 1).bit_length()
        far = int(NONE)
        rank = self.pair_rank.get
        tree = [(far, 0)] * (2 * width)
        for i in range(n - 1):
            tree[width + i] = (rank(ids[i] << 32 | ids[i + 1], far), i)
        for k in range(width - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

        def put(i: int, value: int) -> None:
            k = width + i
            tree[k] = (value, i)
            while k > 1:
                k >>= 1
                tree[k] = min(tree[2 * k], tree[2 * k + 1])

        while tree[1][0] < far:
            merged, i = tree[1]
            j = after[i]
            k = after[j]
            ids[i], ids[j], after[i] = merged, -1, k
            if k < n:
                before[k] = i
                put(i, rank(merged << 32 | ids[k], far))
            else:
                put(i, far)
            put(j, far)
            if before[i] >= 0:
                put(before[i], rank(ids[before[i]] << 32 | merged, far))
        return [x for x in ids if x >= 0]

    # many short pieces

    def _ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 32 | right
        at = np.searchsorted(self.pair_keys, keys)
        at[at == len(self.pair_keys)] = 0
        return np.where(self.pair_keys[at] == keys, self.pair_values[at], NONE)

    def encode_many(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece as little-endian unsigned 32-bit integers; pieces of at most ``SHORT`` bytes."""
        out: list[bytes] = [b""] * len(pieces)
        by_width: dict[int, list[int]] = {}
        for k, piece in enumerate(pieces):
            if len(piece) > 1:
                by_width.setdefault(1 << (len(piece) - 1).bit_length(), []).append(k)
            elif piece:
                out[k] = self.byte[piece[0]].astype("<u4").tobytes()
        for width, members in by_width.items():
            for at in range(0, len(members), 16384):
                part = members[at : at + 16384]
                ids, lengths = self._merged([pieces[k] for k in part], width)
                flat, ends = ids[ids >= 0].astype("<u4").tobytes(), np.cumsum(4 * lengths).tolist()
                begin = 0
                for k, end in zip(part, ends, strict=True):
                    out[k] = flat[begin:end]
                    begin = end
        return out

    def _merged(self, pieces: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        rows = len(pieces)
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(rows, width)
        size = np.array([len(p) for p in pieces])
        place = np.arange(width)
        ids = np.where(place < size[:, None], self.byte[raw], -1)
        after = np.tile(place + 1, (rows, 1))
        before = np.tile(place - 1, (rows, 1))
        tree = np.full((rows, 2 * width), NONE * width, np.int64)
        pair = np.where(place[1:] < size[:, None], self._ranks_of(ids[:, :-1], ids[:, 1:]), NONE)
        tree[:, width:-1] = pair * width + place[:-1]
        level = width
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2

        def put(row: np.ndarray, i: np.ndarray, value: np.ndarray) -> None:
            node = i + width
            tree[row, node] = value * width + i
            while node[0] > 1:
                up = node >> 1
                tree[row, up] = np.minimum(tree[row, node], tree[row, node ^ 1])
                node = up

        row = np.arange(rows)
        while True:
            top = tree[row, 1]
            live = top < NONE * width
            row, top = row[live], top[live]
            if not len(row):
                break
            merged, i = top // width, top % width
            j = after[row, i]
            k = after[row, j]
            ids[row, i], ids[row, j], after[row, i] = merged, -1, k
            put(row, j, np.full(len(row), NONE))
            more = k < size[row]
            value = np.full(len(row), NONE)
            value[more] = self._ranks_of(merged[more], ids[row[more], k[more]])
            put(row, i, value)
            before[row[more], k[more]] = i[more]
            prior = before[row, i]
            has = prior >= 0
            if has.any():
                put(row[has], prior[has], self._ranks_of(ids[row[has], prior[has]], merged[has]))
        return ids, (ids >= 0).sum(axis=1)

    # texts

    def _learn(self, words: Iterable[str]) -> None:
        short, long = [], []
        for word in words:
            ids = self.older.get(word)
            if ids is not None:
                self.known[word] = ids
            else:
                raw = word.encode("utf-8", "surrogatepass")
                (short if len(raw) <= SHORT else long).append((word, raw))
        for (word, _), ids in zip(short, self.encode_many([raw for _, raw in short]), strict=True):
            self.known[word] = ids
        for word, raw in long:
            self.known[word] = np.array(self.encode_piece(raw), "<u4").tobytes()

    def encode_texts(self, texts: list[str]) -> list[bytes]:
        """Ids of each whole text as little-endian unsigned 32-bit integers.

        Pieces already seen are looked up; the store forgets the older half of
        what it knows when it holds more than ``kept`` pieces.
        """
        if len(self.known) > self.kept:
            self.known, self.older = {}, self.known
        split = [self.split(text) for text in texts]
        self._learn({w for words in split for w in words}.difference(self.known))
        known = self.known.__getitem__
        return [b"".join(map(known, words)) for words in split]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_texts([text])[0], "<u4").tolist()

    def decode(self, ids: bytes) -> bytes:
        """Bytes of little-endian unsigned 32-bit ids."""
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_tokens`` and ``ids`` (array of long) of every whole text; null counts as empty."""
    kinds = "doc_id long, n_tokens long, ids array<long>"

    def rows(coder: BytePairs, part: pa.RecordBatch, encoded: list[bytes]) -> list[pa.Array]:
        ids = [np.frombuffer(x, "<u4").astype(np.int64) for x in encoded]
        return [pa.array([len(x) for x in ids], pa.int64()), pa.array(ids, pa.list_(pa.int64()))]

    return _run(docs, path, pattern, id_col, text_col, kinds, rows)


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of each text's ids and of the bytes decoded from them.

    Columns ``doc_id``, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``.
    Null and empty texts give no ids and the digest of nothing. Texts of any
    length are read whole; a piece of any length costs n log n. Repeated rows
    come back as often as they are there, null ids stay null, an empty table
    gives none, and other columns are not looked at.
    """
    kinds = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def rows(coder: BytePairs, part: pa.RecordBatch, encoded: list[bytes]) -> list[pa.Array]:
        return [
            pa.array([len(x) // 4 for x in encoded], pa.int64()),
            pa.array([hashlib.sha256(x).hexdigest() for x in encoded]),
            pa.array([hashlib.sha256(coder.decode(x)).hexdigest() for x in encoded]),
        ]

    return _run(docs, path, pattern, id_col, text_col, kinds, rows)


def _run(docs: DataFrame, path: str, pattern: str, id_col: str, text_col: str, kinds: str, rows) -> DataFrame:
    names = [x.split()[0] for x in kinds.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path, pattern)
        for batch in batches:
            for k in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(k, TEXTS_AT_ONCE)
                encoded = coder.encode_texts([x or "" for x in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), *rows(coder, part, encoded)], names=names)

    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return kept.mapInArrow(run, kinds)


_CODERS: dict[tuple[str, str], BytePairs] = {}


def _coder(path: str, pattern: str) -> BytePairs:
    """A Python worker keeps its coder, with the pieces that it knows, from task to task."""
    if (path, pattern) not in _CODERS:
        _CODERS[path, pattern] = BytePairs(read_ranks(path), pattern)
    return _CODERS[path, pattern]
