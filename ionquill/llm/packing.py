"""Packing documents into training sequences: dominance reduction, then best fit.

How well pieces pack depends only on how many there are of each length, and a
length is at most the capacity. So the plan is made on the driver from a table
of at most ``capacity`` counts, however many documents there are. It says which
lengths share a sequence and how often; ranks within each length then tell every
piece its sequence and its place, on the executors.

The reduction fixes sets that some optimal packing is known to hold: an item
with nothing that fits beside it, an item with a partner that fills its sequence
exactly, and an item whose best partner (or best two) can stand in for every
other choice. What it leaves goes, largest first, to the sequence that it fills
best.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionquill.llm.storage import stored

Pattern = tuple[tuple[int, int], ...]
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, shard int"


class _Stock:
    """Counts by size; sizes in ascending order."""

    def __init__(self, counts: dict[int, int]):
        self.of = {s: n for s, n in counts.items() if n > 0}
        self.sizes = sorted(self.of)

    def take(self, size: int, n: int) -> None:
        self.of[size] -= n
        if not self.of[size]:
            del self.of[size]
            self.sizes.remove(size)

    def largest(self, limit: int, used: dict[int, int]) -> int | None:
        """The largest size up to ``limit`` of which more are left than ``used``."""
        for k in range(bisect.bisect_right(self.sizes, limit) - 1, -1, -1):
            if self.of[self.sizes[k]] > used.get(self.sizes[k], 0):
                return self.sizes[k]
        return None

    def smallest(self, n: int, used: dict[int, int]) -> list[int]:
        out: list[int] = []
        for s in self.sizes:
            out += [s] * min(n - len(out), self.of[s] - used.get(s, 0))
            if len(out) == n:
                break
        return out


def _dominant(stock: _Stock, item: int, capacity: int) -> tuple[int, ...] | None:
    """Sizes beside one ``item`` in a set that dominates all others with it; None if there is none of up to three."""
    room, used = capacity - item, {item: 1}
    best = stock.largest(room, used)
    if best is None:
        return ()
    if best == room:
        return (best,)
    low = stock.smallest(3, used)
    if len(low) < 2 or low[0] + low[1] > room:
        return (best,)
    if len(low) == 3 and sum(low) <= room:
        return None
    # at most two fit beside the item: look at the best second for each first
    pairs = []
    for first in stock.sizes[: bisect.bisect_right(stock.sizes, room)]:
        second = stock.largest(min(first, room - first), {item: 1, **{first: 1 + (first == item)}})
        if second is not None and stock.of[first] > (first == item):
            pairs.append((first, second))
    if all(a + b <= best for a, b in pairs):
        return (best,)
    mate = stock.largest(room - best, {item: 1, **{best: 1 + (best == item)}})
    if mate is not None and all(b <= mate or a + b <= best for a, b in pairs):
        return (best, mate)
    return None


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> tuple[list[tuple[Pattern, int]], dict[int, int]]:
    """Sets fixed for good, each with how often, and the counts that are left."""
    stock, fixed = _Stock(counts), []
    changed = True
    while changed:
        changed = False
        for item in sorted(stock.sizes, reverse=True):
            while item in stock.of:
                beside = _dominant(stock, item, capacity)
                if beside is None:
                    break
                held: dict[int, int] = {}
                for s in (item, *beside):
                    held[s] = held.get(s, 0) + 1
                exact = sum(s * n for s, n in held.items()) == capacity or not beside
                times = min(stock.of[s] // n for s, n in held.items()) if exact else 1
                if not exact and len(held) == 1 + len(beside):
                    times = _steady(stock, item, beside, capacity)
                for s, n in held.items():
                    stock.take(s, n * times)
                fixed.append((tuple(sorted(held.items(), reverse=True)), times))
                changed = True
    return fixed, dict(stock.of)


def _steady(stock: _Stock, item: int, beside: tuple[int, ...], capacity: int) -> int:
    """How often the same choice certainly repeats: while three of each of its sizes are left, what else fits doesn't change."""
    return max(1, min(stock.of[s] for s in (item, *beside)) - 3)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing over counts: sequences with equal contents are kept as one pattern and a number."""
    open_rooms: dict[int, list[tuple[Pattern, int]]] = {}
    rooms: list[int] = []

    def put(room: int, pattern: Pattern, n: int) -> None:
        if n:
            if room not in open_rooms:
                open_rooms[room] = []
                bisect.insort(rooms, room)
            open_rooms[room].append((pattern, n))

    for size in sorted((s for s, n in counts.items() if n), reverse=True):
        left = counts[size]
        while left:
            at = bisect.bisect_left(rooms, size)
            if at < len(rooms):
                room = rooms[at]
                pattern, n = open_rooms[room].pop()
                if not open_rooms[room]:
                    del open_rooms[room], rooms[at]
            else:
                room, pattern, n = capacity, (), left
            each = room // size
            full = min(n, left // each)
            put(room - each * size, (*pattern, (size, each)), full)
            left -= full * each
            rest = n - full
            if rest and left:  # fewer than ``each`` are left
                put(room - left * size, (*pattern, (size, left)), 1)
                left, rest = 0, rest - 1
            if pattern:
                put(room, pattern, rest)
    return [x for room in rooms for x in open_rooms[room]]


def plan(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Patterns ((size, how many), ...) and the number of sequences with each."""
    if any(s > capacity or s < 1 for s, n in counts.items() if n):
        raise ValueError("every size has to be between 1 and the capacity")
    fixed, left = reduce_by_dominance(counts, capacity)
    return fixed + best_fit(left, capacity)


def places(patterns: list[tuple[Pattern, int]]) -> np.ndarray:
    """Rows size, first rank, how many a sequence, first sequence, first offset, sorted by size and rank."""
    rows, next_rank, sequence = [], {}, 0
    for pattern, times in patterns:
        offset = 0
        for size, each in pattern:
            rank = next_rank.get(size, 0)
            rows.append((size, rank, each, sequence, offset))
            next_rank[size] = rank + each * times
            offset += size * each
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def _tokenizer(path: str, ranks_path: str | None, pattern: str | None):
    """Function from text to an array of ids.

    With ``ranks_path`` the same vocabulary's rank file does the encoding, which
    gives equal ids in a fifth of the time; texts that hold a special token's
    string still go to the tokenizer at ``path``.
    """
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    special = [t.content for t in slow.get_added_tokens_decoder().values()]

    def whole(text: str) -> np.ndarray:
        return np.array(slow.encode(text, add_special_tokens=False).ids, "<u4")

    if ranks_path is None:
        return whole
    import tiktoken

    from ionquill.llm.bpe import read_ranks

    fast = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=read_ranks(ranks_path), special_tokens={})

    def quick(text: str) -> np.ndarray:
        if any(s in text for s in special):
            return whole(text)
        return fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)

    return quick


_READY: dict[tuple, object] = {}


def pieces(docs: DataFrame, path: str, capacity: int, end_id: int, shards: int, ranks_path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece of at most ``capacity`` ids; all but a document's first are full."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (path, ranks_path, pattern)
        if key not in _READY:
            _READY[key] = _tokenizer(*key)
        encode = _READY[key]
        end = np.array([end_id], "<u4")
        for batch in batches:
            rows = []
            for doc_id, text, shard in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                ids = np.concatenate([encode(text or ""), end])
                cut = len(ids) % capacity or capacity
                begin = 0
                for piece, stop in enumerate(range(cut, len(ids) + 1, capacity)):
                    rows.append((doc_id, piece, begin, stop - begin, zlib.crc32(ids[begin:stop].tobytes()), shard))
                    begin = stop
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
            columns = [list(x) for x in zip(*rows, strict=True)] or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in PIECES.split(", ")])

    text = F.col(text_col).cast("string")
    # rows are dealt by their place, not by a key, so repeated rows spread too; the written table fixes the numbers
    shard = (F.monotonically_increasing_id() % shards).cast("int")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), shard.alias("shard")).mapInArrow(run, PIECES)


def pack(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, ranks_path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> DataFrame:
    """Packs every document into sequences of at most ``capacity`` tokens.

    One row for each piece: ``doc_id``, ``piece``, ``start``, ``length``,
    ``ids_crc32``, ``sequence_id``, ``offset``. Null and empty texts are pieces
    of one token, the end id. Texts longer than a sequence are cut into full
    pieces after a first that may be shorter. Repeated rows are packed as often
    as they come; a null id stays null; an empty table gives no rows; other
    columns aren't looked at. What reaches the driver is a count for each length
    and shard; shards, if not given, are four to a shuffle partition, 4096 at most.
    """
    if shards is None:
        shards = max(64, min(4096, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    cut = stored(pieces(docs, path, capacity, end_id, shards, ranks_path, pattern, id_col, text_col), "pieces")
    tally = np.zeros((shards, capacity + 1), np.int64)
    for row in cut.groupBy("shard", "length").count().toLocalIterator():
        tally[row["shard"], row["length"]] = row["count"]
    lengths = tally.sum(axis=0)
    table = places(plan({s: int(n) for s, n in enumerate(lengths) if n}, capacity))
    before = np.cumsum(tally, axis=0) - tally
    wide = np.int64(1) << 40

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = table[:, 0] * wide + table[:, 1]
        at, seen = (-1, -1), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            shard, size = batch.column("shard").to_numpy(), batch.column("length").to_numpy()
            first = np.flatnonzero(np.r_[True, (shard[1:] != shard[:-1]) | (size[1:] != size[:-1])])
            run_of = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(size)]))
            rank = np.arange(len(size)) - first[run_of]
            if (int(shard[0]), int(size[0])) == at:
                rank[run_of == 0] += seen
            at, seen = (int(shard[-1]), int(size[-1])), int(rank[-1]) + 1
            rank = rank + before[shard, size]
            row = table[np.searchsorted(starts, size * wide + rank, side="right") - 1]
            nth = rank - row[:, 1]
            sequence, offset = row[:, 3] + nth // row[:, 2], row[:, 4] + nth % row[:, 2] * size
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(5)), pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ordered = cut.repartition("shard").sortWithinPartitions("shard", "length", "doc_id", "piece", "ids_crc32", "start")
    return ordered.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
