"""Sets of word shingles, and the exact part of finding those with a Jaccard similarity of 0.8 or more.

A text is known by the set of hashes of its runs of five words; texts of one set
are copies and go on as one. Two steps leave out sets that can't have a partner,
neither of which loses a pair: of two sets that alike, the first common hashes
lie in the first part of both, so a set whose first part is mostly its own is
left out; of the rest, hashes are put in order of the number of sets that hold
them, and a pair has one in common among its rarest fifth. Sets that share such
a hash are linked to the least of them. What links reach is compared set by set
in one task, so that all similar pairs are seen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WORDS = 5
TEXTS_AT_ONCE = 256


def shingle_hashes(text: str | None, words: int, seed: int) -> list[int]:
    """XXH64 of every run of ``words`` words, repeats included; a shorter text is one run, one without words has none."""
    # bytes.lower() and bytes.split() touch exactly A-Z and the six ASCII white-space bytes
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return []
    digest = xxhash.xxh64_intdigest
    if len(tokens) <= words:
        return [digest(b" ".join(tokens), seed)]
    runs = zip(*(tokens[i:] for i in range(words)), strict=False)
    return [digest(run, seed) for run in map(b" ".join, runs)]


def as_set(hashes: list[int]) -> np.ndarray:
    """Sorted distinct hashes, as signed numbers."""
    return np.unique(np.array(hashes, np.uint64).view(np.int64))


def shingle_set(text: str | None, words: int = WORDS, seed: int = 42) -> np.ndarray:
    """Sorted distinct hashes of a text's runs of ``words`` words."""
    return as_set(shingle_hashes(text, words, seed))


def set_key(own: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    x = xxhash.xxh64_intdigest(own.tobytes())
    return x - (1 << 64) if x >> 63 else x


def least_common(n):
    """Hashes that a set of ``n`` has in common with any set that is similar to it, at least."""
    return (4 * n + 4) // 5


def _early(n):
    return (n + 9) // 10


def first_part(n):
    """How many of a set's hashes hold the first ``_early`` ones that it has in common with a similar set."""
    return n - least_common(n) + _early(n)


def _slices(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in batches:
        for k in range(0, batch.num_rows, TEXTS_AT_ONCE):
            part = batch.slice(k, TEXTS_AT_ONCE)
            yield part, [shingle_set(t, words) for t in part.column(1).to_pylist()]


def _first_parts(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in _slices(batches, words):
            parts = [s[: first_part(len(s))] for s in sets]
            keys = np.repeat(np.array([set_key(s) for s in sets], np.int64), [len(p) for p in parts])
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.concatenate(parts))], names=["key", "shingle"])

    return run


def _whole(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in _slices(batches, words):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64())), part.column(2)], names=["key", "own", "fp"])

    return run


def clusters(sizes: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """For each set (``sizes`` cut ``hashes`` into sets) the first set that links of similarity 0.8 or more lead to."""
    words, ids = np.unique(hashes, return_inverse=True)
    rows, start = np.repeat(np.arange(len(sizes)), sizes), np.r_[0, np.cumsum(sizes)]
    label, alive = np.arange(len(sizes)), np.ones(len(sizes), bool)

    def index() -> tuple[np.ndarray, np.ndarray]:
        kept = alive[rows]
        order = np.argsort(ids[kept], kind="stable")
        return rows[kept][order], np.searchsorted(ids[kept][order], np.arange(len(words) + 1))

    (holders, first), indexed = index(), len(sizes)
    for seed in range(len(sizes)):
        if not alive[seed]:
            continue
        alive[seed], queue = False, [seed]
        while queue:
            x = queue.pop()
            own = ids[start[x] : start[x + 1]]
            low, many = first[own], first[own + 1] - first[own]
            step = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
            common = np.bincount(holders[np.repeat(low, many) + step], minlength=len(sizes))
            near = np.flatnonzero(alive & (9 * common >= 4 * (sizes[x] + sizes)))  # common / union >= 4 / 5
            label[near], alive[near] = seed, False
            queue.extend(near.tolist())
            if 2 * (left := int(alive.sum())) < indexed:  # what has its place needn't be looked at again
                (holders, first), indexed = index(), left
    return label


def settled(sets: DataFrame, roots: DataFrame) -> DataFrame:
    """``key`` and ``least``, the first set of its cluster, of every set that ``roots`` (``key``, ``root``) names."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("key").combine_chunks()
        keys, own = table["key"].to_numpy(), pa.concat_arrays(table["own"].chunks)
        label = clusters(np.diff(own.offsets.to_numpy()), own.flatten().to_numpy())
        return pa.table({"key": keys, "least": keys[label]})

    return sets.select("key", "own").join(roots, "key").groupBy("root").applyInArrow(lambda table: run(table.select(["key", "own"])), "key long, least long")


def possible(rows: DataFrame, sets: DataFrame, place: list[str], words: int = WORDS) -> DataFrame:
    """``key``, ``own`` and ``fp`` of the sets whose first part doesn't rule out a partner.

    ``rows`` has the columns ``place`` and ``text``; ``sets`` has ``key``, ``n``,
    ``fp`` and the place of one of its rows.
    """
    counted = rows.select(F.lit(0).alias("none"), "text").mapInArrow(_first_parts(words), "key long, shingle long").groupBy("shingle").agg(F.min("key").alias("key"), F.max("key").alias("other"))
    alone = counted.where(F.col("key") == F.col("other")).groupBy("key").agg(F.count(F.lit(1)).alias("alone"))
    t = F.floor((4 * F.col("n") + 4) / 5)
    early = lambda n: F.floor((n + 9) / 10)
    known = F.col("n") - t + early(F.col("n")) - F.coalesce("alone", F.lit(0))
    left = sets.join(alone, "key", "left").where((F.col("n") > 0) & (known >= early(t))).select("key", "fp", *place)
    return rows.join(left, place).select("key", "text", "fp").mapInArrow(_whole(words), "key long, own array<long>, fp long")


def rare_links(sets: DataFrame, limit: int) -> DataFrame:
    """Links u, v of sets whose fingerprints differ in more than ``limit`` bits.

    With the links of all that differ in ``limit`` or fewer, which are for the
    caller to bring, their components hold every pair of similar sets.
    """
    each = sets.select("key", F.size("own").alias("n"), F.explode("own").alias("shingle"))
    shared = each.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("shingle"))).where(F.col("df") > 1)
    own = shared.groupBy("key").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("df", "shingle"))).alias("shared")).join(sets.select("key", "fp"), "key")
    # the rarest n - least + 1, of which those that no other set holds come first and can be left out
    take = (F.col("n") - F.floor((4 * F.col("n") + 4) / 5) + 1 - (F.col("n") - F.size("shared"))).cast("int")
    rare = own.withColumn("take", take).where(F.col("take") > 0).select("key", "fp", F.explode(F.slice("shared", 1, F.col("take"))).alias("s")).select("key", "fp", "s.shingle")
    met = rare.withColumn("least", F.min(F.struct("key", "fp")).over(Window.partitionBy("shingle")))
    far = F.bit_count(F.col("fp").bitwiseXOR(F.col("least.fp"))) > limit
    return met.where(far).select(F.col("key").alias("u"), F.col("least.key").alias("v")).distinct()
