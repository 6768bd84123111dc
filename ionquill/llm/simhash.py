"""SimHash fingerprints and near-duplicate groups found with a Gray-order hierarchical index.

Fingerprints within three bits of each other agree on at least one of four
blocks of bits, so every distinct fingerprint is dealt to four groups. A group
that holds more than ``hot`` fingerprints is dealt again by four blocks of its
remaining bits, and once more after that, so no group depends on one block
alone. In each group the fingerprints, sorted by Gray rank, become the leaves of
a tree: a node keeps the bits on which everything below it agrees and which its
parent doesn't keep already. A search carries the differing bits counted so far
downwards and leaves a whole subtree as soon as they exceed the limit.

Links found in a group are reduced to a spanning forest there; the forests of
all groups meet in ``components``.

64 bits can't tell every pair of texts that are alike by a share of their
shingles: two sets with a Jaccard similarity of 0.8 differ in about ten bits. So
where such a similarity is asked for (``keep_one``), the links found here are
the only candidates within the limit for an exact comparison, and ``shingles``
adds those beyond it alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionquill.llm import shingles
from ionquill.llm.components import components
from ionquill.llm.shingles import TEXTS_AT_ONCE
from ionquill.llm.storage import stored

BITS = 64
FAN = 8
LEVELS = 3
FINGERPRINT_WORDS = 3


def text_fingerprint(text: str | None, words: int = FINGERPRINT_WORDS, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of one whole text; 0 where it has no words."""
    return int(_fingerprints([text], words, seed)[0])


def _majority(hashes: list[int]) -> int:
    """Bits that more than half of the hashes have."""
    if not hashes:
        return 0
    ones = np.zeros(BITS, np.int64)
    every = np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8)
    for k in range(0, len(every), 65536):
        ones += np.unpackbits(every[k : k + 65536], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def _fingerprints(texts: list[str | None], words: int, seed: int) -> np.ndarray:
    return np.array([_majority(shingles.shingle_hashes(t, words, seed)) for t in texts], np.uint64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = FINGERPRINT_WORDS, seed: int = 42) -> DataFrame:
    """``doc_id`` and ``fp`` (the fingerprint's bits as a signed long) of every row; null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(k, TEXTS_AT_ONCE)
                fps = _fingerprints(part.column(1).to_pylist(), words, seed)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return kept.mapInArrow(run, "doc_id long, fp long")


def gray_rank(fps: np.ndarray) -> np.ndarray:
    """Place of each fingerprint in the reflected Gray code's order."""
    rank = fps.astype(np.uint64, copy=True)
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """A forest over ``fps``: one tree for each run of equal ``group`` numbers, leaves in Gray order."""

    def __init__(self, fps: np.ndarray, group: np.ndarray):
        order = np.lexsort((gray_rank(fps), group))
        self.fps, self.group, self.order = fps[order], group[order], order
        n = len(fps)
        self.first: list[np.ndarray] = []  # of each node, its first child; one more at the end
        self.bits: list[np.ndarray] = []
        self.mask: list[np.ndarray] = []
        self.last: list[np.ndarray] = []  # of each node, its last fingerprint
        tree, lows, highs, last = self.group, self.fps, self.fps, np.arange(n)
        while True:
            starts = np.flatnonzero(np.r_[True, tree[1:] != tree[:-1]]) if len(tree) else np.zeros(0, int)
            place = np.arange(len(tree)) - np.repeat(starts, np.diff(np.r_[starts, len(tree)]))
            first = np.flatnonzero(place % FAN == 0)
            lows, highs = np.bitwise_and.reduceat(lows, first), np.bitwise_or.reduceat(highs, first)
            last = last[np.r_[first[1:], len(tree)] - 1]
            tree = tree[first]
            self.first.append(np.r_[first, len(place)])
            self.bits.append(lows)
            self.mask.append(~(lows ^ highs))
            self.last.append(last)
            if len(first) == len(starts):
                break
        self.roots = np.searchsorted(tree, self.group)
        for level in range(len(self.first) - 1):  # what the parent keeps goes from the child
            above = np.repeat(np.arange(len(self.bits[level + 1])), np.diff(self.first[level + 1]))
            self.mask[level] = self.mask[level] & ~self.mask[level + 1][above]
        self.own = ~self._all_above()

    def _all_above(self) -> np.ndarray:
        kept = self.mask[-1]
        for level in range(len(self.first) - 2, -1, -1):
            kept = np.repeat(kept, np.diff(self.first[level + 1])) | self.mask[level]
        return np.repeat(kept, np.diff(self.first[0]))

    def pairs(self, queries: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """(i, j) with i in ``queries``, j > i of i's tree and at most ``limit`` differing bits."""
        q, node, far = queries, self.roots[queries], np.zeros(len(queries), np.uint8)
        for level in range(len(self.first) - 1, -1, -1):
            far = far + np.bitwise_count((self.fps[q] ^ self.bits[level][node]) & self.mask[level][node])
            keep = (far <= limit) & (self.last[level][node] > q)
            q, node, far = q[keep], node[keep], far[keep]
            start, size = self.first[level][node], self.first[level][node + 1] - self.first[level][node]
            step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            q, far, node = np.repeat(q, size), np.repeat(far, size), np.repeat(start, size) + step
        keep = node > q
        q, node, far = q[keep], node[keep], far[keep]
        keep = far + np.bitwise_count((self.fps[q] ^ self.fps[node]) & self.own[node]) <= limit
        return q[keep], node[keep]


def _join_labels(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least index of each component, after links i-j join those of ``label``."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return label
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label != (deeper := label[label])).any():
            label = deeper


def forest(fps: np.ndarray, group: np.ndarray, limit: int, at_once: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Links (indices into ``fps``) that connect what pairs within ``limit`` bits connect in each group."""
    index = GrayIndex(fps, group)
    label = np.arange(len(fps))
    for k in range(0, len(fps), at_once):
        i, j = index.pairs(np.arange(k, min(k + at_once, len(fps))), limit)
        label = _join_labels(label, i, j)
    ends = np.flatnonzero(label != np.arange(len(fps)))
    return index.order[ends], index.order[label[ends]]


def _linked(limit: int):
    def links(fps: np.ndarray, group: np.ndarray) -> pa.RecordBatch:
        a, b = forest(fps, group, limit)
        return pa.RecordBatch.from_arrays([pa.array(fps[a].view(np.int64)), pa.array(fps[b].view(np.int64))], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows arrive sorted by group; the group that a batch may end within waits for the next batch."""
        held: list[np.ndarray] = [np.zeros((0, 3), np.int64)]
        for batch in batches:
            rows = np.column_stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)])
            if not len(rows):
                continue
            other = np.flatnonzero((rows[:, :2] != rows[-1, :2]).any(axis=1))
            cut = int(other[-1]) + 1 if len(other) else 0
            goes_on = len(held[-1]) and (rows[0, :2] == held[-1][-1, :2]).all()
            if cut or not goes_on:
                yield from settle(np.concatenate([*held, rows[:cut]]))
                held = [rows[cut:]]
            else:
                held.append(rows)
        yield from settle(np.concatenate(held))

    def settle(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(rows) < 2:
            return
        change = np.r_[False, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)]
        group = np.cumsum(change)
        many = np.bincount(group)[group] > 1
        if many.any():
            yield links(np.ascontiguousarray(rows[many, 2]).view(np.uint64), group[many])

    return run


def _signed(bits: int) -> int:
    return bits - (1 << BITS) if bits >> (BITS - 1) else bits


def block_masks(parts: int, levels: int = LEVELS) -> list[list[int]]:
    """Masks of each level: the bits that a group's members share. Path p of a level leads to p * parts + 0, 1, ... of the next."""

    def cut(free: list[int]) -> list[list[int]]:
        return [free[len(free) * k // parts : len(free) * (k + 1) // parts] for k in range(parts)]

    at, out = [0], []
    for _ in range(levels):
        after = []
        for mask in at:
            free = [b for b in range(BITS) if not mask >> b & 1]
            after += [mask | sum(1 << b for b in block) for block in cut(free)]
        out.append(after)
        at = after
    return out


def near_links(fps: DataFrame, limit: int = 3, hot: int = 4096) -> DataFrame:
    """Links u, v that give the same components as all pairs within ``limit`` bits; ``fps`` has each value of ``fp`` once."""
    parts = limit + 1
    masks = block_masks(parts)

    def dealt(rows: DataFrame, level: int) -> DataFrame:
        if level == 0:
            keys = F.array(*[F.struct(F.lit(p).cast("long").alias("path"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("shared")) for p, m in enumerate(masks[0])])
            return rows.select("fp", F.explode(keys).alias("key")).select("key.*", "fp")
        table = F.array(*[F.array(*[F.lit(_signed(m)) for m in masks[level][k : k + parts]]) for k in range(0, len(masks[level]), parts)])
        sub = rows.select("path", "fp", F.posexplode(F.element_at(table, (F.col("path") + 1).cast("int"))).alias("k", "mask"))
        return sub.select((F.col("path") * parts + F.col("k")).alias("path"), F.col("fp").bitwiseAND(F.col("mask")).alias("shared"), "fp")

    rows, ready = dealt(fps.select("fp"), 0), []
    for level in range(LEVELS):
        where = F.lit(level << 32) + F.col("path")
        large = None
        if level < LEVELS - 1:
            large = stored(rows.groupBy("path", "shared").count().where(F.col("count") > hot).select("path", "shared"), "large")
        if large is None or large.isEmpty():
            ready.append(rows.select(where.alias("path"), "shared", "fp"))
            break
        ready.append(rows.join(large, ["path", "shared"], "left_anti").select(where.alias("path"), "shared", "fp"))
        rows = dealt(stored(rows.join(large, ["path", "shared"], "left_semi"), "dealt"), level + 1)
    every = ready[0]
    for more in ready[1:]:
        every = every.unionByName(more)
    return every.repartition("path", "shared").sortWithinPartitions("path", "shared").mapInArrow(_linked(limit), "u long, v long")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = FINGERPRINT_WORDS, limit: int = 3, seed: int = 42, hot: int = 4096) -> DataFrame:
    """One row for each document: ``doc_id``, ``fingerprint`` (16 hex digits), ``component_id``.

    Documents are linked where their fingerprints differ in ``limit`` bits or
    fewer; ``component_id`` is the least ``doc_id`` that links reach. Null and
    empty texts have fingerprint zero and are linked like any other. Repeated
    rows are returned as often as they come. A null ``doc_id`` takes part and is
    never a component's id unless the whole component has none. Very long texts
    are read whole. An empty table gives an empty result; other columns of
    ``docs`` are not looked at.
    """
    each = stored(fingerprints(docs, id_col, text_col, words, seed), "fingerprints")
    distinct = stored(each.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = stored(components(near_links(distinct, limit, hot)), "roots")
    placed = distinct.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = placed.select("fp", "root").join(named, "root").select("fp", "component_id")
    return each.join(by_fp, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _set_rows(words: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(k, TEXTS_AT_ONCE)
                texts = part.column(2).to_pylist()
                sets = [shingles.shingle_set(t, words, seed) for t in texts]
                fps = _fingerprints(texts, FINGERPRINT_WORDS, seed).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(3), pa.array(fps), pa.array([shingles.set_key(s) for s in sets], "int64"), pa.array([len(s) for s in sets], "int64")],
                    names=["file", "at", "id", "fp", "key", "n"],
                )

    return run


def _placed(docs: DataFrame) -> tuple[DataFrame, Column, Column]:
    """The table, and expressions for the file and the place in it that name each of its rows.

    Rows that are read straight from Parquet have both; any other table is
    written first, so that a row has one name however often the table is read.
    """
    file, at = F.xxhash64("_metadata.file_path"), F.col("_metadata.row_index")
    if "_metadata" in docs.columns:
        raise ValueError("a column may not be named _metadata, which names the files that rows are from")
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation":
        try:
            docs.select(file, at)
            return docs, file, at
        except AnalysisException:  # another format than Parquet
            pass
    return stored(docs, "rows"), file, at


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = shingles.WORDS, limit: int = 3, hot: int = 4096) -> DataFrame:
    """``docs``, with all their columns, less the near duplicates: of each group the row with the least id stays.

    Rows are linked where the sets of their runs of ``words`` words have a Jaccard
    similarity of 0.8 or more; a group is what links reach. Texts whose
    fingerprints (of three-word shingles, as ``near_groups`` has them) differ in
    ``limit`` bits or fewer are candidates by the Gray-order index alone, those that
    differ in more by a rare enough run that they share; all are compared exactly. Null and empty texts are alike. Each row is known by its own place: rows with a
    null id are grouped like others, and go where their group has an id; of
    repeated rows one stays; different texts under one id all stay. Texts of any
    length are used whole. An empty table gives no rows. Other columns, whatever
    their names (``_metadata`` excepted, which is refused), pass through.
    """
    docs, file, at = _placed(docs)
    rows = docs.select(file.alias("file"), at.alias("at"), F.col(text_col).cast("string").alias("text"), F.col(id_col).cast("long").alias("id"))
    each = stored(rows.mapInArrow(_set_rows(words, 42), "file long, at long, id long, fp long, key long, n long"), "shingle_sets")
    one = each.groupBy("key").agg(F.min(F.struct("file", "at")).alias("row"), F.first("n").alias("n"), F.min("fp").alias("fp"))
    sets = stored(shingles.possible(rows.select("file", "at", "text"), one.select("key", "n", "fp", "row.file", "row.at"), ["file", "at"], words), "possible")
    least = stored(sets.groupBy("fp").agg(F.min("key").alias("least")), "distinct")
    same = sets.select("key", "fp").join(least, "fp").where("key <> least").select(F.col("key").alias("u"), F.col("least").alias("v"))
    end = lambda side: least.select(F.col("fp").alias(side), F.col("least").alias(f"{side}_key"))
    near = near_links(least.select("fp"), limit, hot).join(end("u"), "u").join(end("v"), "v").select(F.col("u_key").alias("u"), F.col("v_key").alias("v"))
    roots = components(same.unionByName(near).unionByName(shingles.rare_links(sets, limit))).select(F.col("node").alias("key"), "root")
    alike = shingles.settled(sets, roots)
    grouped = each.join(alike, "key", "left").select("file", "at", "id", F.coalesce("least", "key").alias("group"))
    first = F.min(F.struct(F.col("id").isNull().alias("unknown"), "id", "file", "at")).alias("k")
    kept = grouped.groupBy("group").agg(first).select("k.file", "k.at")
    own = [next(n for k in range(len(docs.columns) + 1) if (n := f"{name}_{k}") not in docs.columns) for name in ("file", "at")]
    return docs.withColumns(dict(zip(own, (file, at), strict=True))).join(kept.toDF(*own), own, "left_semi").drop(*own)
