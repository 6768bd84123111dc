"""Exact top-k inner products on a bit-sliced index.

Every attribute of a block of vectors is shifted to be non-negative and kept as
bitmaps over the rows, one for each binary digit. A query's weighted sum of
attributes is then bitmap arithmetic: each set digit of a weight adds the
attribute's slices, moved up, and carry-save adders reduce the stack of bitmaps
to one sum in binary; a negative weight adds the complement instead. The top
rows are read off from the most significant slice of the sum downwards, and
rows that tie at the boundary are resolved by their id.

An index is built once for each cell of rows and queries, in parts; a part whose
attributes' ranges can't give a sum as large as a query's k-th best so far is
passed over.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WORD = 64
#: Sums below this are worked out in 64-bit integers, larger ones in Python's.
SAFE = 1 << 62


class BitSlices:
    """Index over ``values`` (rows x attributes, integers of any size); ``ids`` in ascending order break ties."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.values = ids[order], values[order]
        self.low, self.high = self.values.min(axis=0), self.values.max(axis=0)
        above = self.values - self.low
        self.digits = max(1, int(above.max(initial=0)).bit_length())
        words = -(-len(ids) // WORD)
        self.slices = np.zeros((values.shape[1], self.digits, words), np.uint64)
        for k in range(self.digits):
            packed = np.packbits((above >> k & 1).astype(np.uint8), axis=0, bitorder="little").T
            self.slices[:, k].view(np.uint8)[:, : packed.shape[1]] = packed
        real = np.zeros(words * WORD, np.uint8)
        real[: len(ids)] = 1
        self.real = np.packbits(real, bitorder="little").view(np.uint64)

    def bound(self, query: np.ndarray):
        """No row's inner product is above this."""
        return np.maximum(query * self.low, query * self.high).sum()

    def sums(self, query: np.ndarray) -> np.ndarray:
        """Slices, least significant first, of each row's inner product less the least it could be."""
        weight = np.abs(query)
        signed = np.where((query < 0)[:, None, None], ~np.uint64(0), np.uint64(0))
        columns: dict[int, list[np.ndarray]] = {}
        for b in range(int(weight.max(initial=0)).bit_length()):
            has = np.flatnonzero((weight >> b & 1).astype(bool))
            if len(has):
                part = self.slices[has] ^ signed[has]
                for k in range(self.digits):
                    columns.setdefault(b + k, []).append(part[:, k])
        out, place = [], 0
        while place in columns or any(p > place for p in columns):
            stack = np.concatenate(columns.pop(place)) if place in columns else np.zeros((0, len(self.real)), np.uint64)
            while len(stack) > 1:
                if len(stack) == 2:
                    carry, stack = (stack[0] & stack[1])[None], (stack[0] ^ stack[1])[None]
                else:
                    n = len(stack) // 3
                    a, b, c, rest = stack[:n], stack[n : 2 * n], stack[2 * n : 3 * n], stack[3 * n :]
                    half = a ^ b
                    carry = (a & b) | (half & c)
                    stack = np.concatenate([half ^ c, rest])
                columns.setdefault(place + 1, []).append(carry)
            out.append(stack[0] if len(stack) else np.zeros(len(self.real), np.uint64))
            place += 1
        return np.array(out, np.uint64).reshape(-1, len(self.real))

    def top(self, query: np.ndarray, k: int, without: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and inner products of the k best rows whose id isn't ``without``; larger products, then smaller ids first."""
        maybe = self.real.copy()
        if without is not None:
            own = np.arange(np.searchsorted(self.ids, without), np.searchsorted(self.ids, without, side="right"))
            np.bitwise_and.at(maybe, own // WORD, ~(np.uint64(1) << (own % WORD).astype(np.uint64)))
        sure = np.zeros_like(maybe)
        for digit in self.sums(query)[::-1]:
            with_one = maybe & digit
            n = int(np.bitwise_count(sure | with_one).sum())
            if n > k:
                maybe = with_one
            else:
                sure, maybe = sure | with_one, maybe & ~digit
                if n == k:
                    maybe = np.zeros_like(maybe)
                    break
        rows = self._rows(sure)
        rows = np.concatenate([rows, self._rows(maybe)[: k - len(rows)]])
        return _best(self.ids[rows], self.values[rows] @ query, k)

    @staticmethod
    def _rows(bitmap: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def _best(ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -score))[:k]
    return ids[order], score[order]


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id`` and ``v``, the components as doubles; rows with a null or non-finite part are left out."""
    each = F.col(vector_col).cast("array<double>")
    fine = F.forall(each, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & fine)
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), each.alias("v"))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows; those that are shorter than ``width`` end in zeros."""
    column = column.combine_chunks()
    size = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(size), width))
    out[np.arange(width) < size[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def quantised(x: np.ndarray, scale: int, most: float) -> np.ndarray:
    """``x * scale`` rounded down, as 64-bit integers where ``most``, the largest part, leaves sums of products within them; else as Python's."""
    if x.shape[1] * (most * scale + 1) ** 2 < SAFE:
        return np.floor(x * scale).astype(np.int64)
    # a double of 2 ^ 53 or more is an integer, and the product may not fit one
    whole = [int(v) * scale if abs(v) >= 2.0**53 else math.floor(v * scale) for v in x.ravel().tolist()]
    return np.array(whole, dtype=object).reshape(x.shape)


def searched(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int, scale: int, part: int = 16384) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query id, row id and inner product of each query's ``k`` best rows, whose id isn't the query's own."""
    most = max(float(np.abs(a).max(initial=0)) for a in (x, q))
    values, queries = quantised(x, scale, most), quantised(q, scale, most)
    best: list[tuple[np.ndarray, np.ndarray]] = [(ids[:0], values[:0, :1].ravel())] * len(queries)
    for own_rows in np.array_split(np.arange(len(ids)), -(-len(ids) // part)):
        index = BitSlices(ids[own_rows], values[own_rows])
        for n, (own, query) in enumerate(zip(query_ids.tolist(), queries, strict=True)):
            held, score = best[n]
            # a sum that equals the k-th may still win by its id
            if len(held) == k and index.bound(query) < score[-1]:
                continue
            more = index.top(query, k, own)
            best[n] = _best(np.concatenate([held, more[0]]), np.concatenate([score, more[1]]), k)
    low, high = -(1 << 63), (1 << 63) - 1
    score = np.concatenate([np.array([min(max(int(s), low), high) for s in c], np.int64) if c.dtype == object else c for _, c in best]) if best else np.zeros(0, np.int64)
    return np.repeat(query_ids, [len(i) for i, _ in best]), np.concatenate([i for i, _ in best]) if best else ids[:0], score


def top_products(vectors: DataFrame, every: int = 20, k: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding", block: int = 65536, queries: int = 32768) -> DataFrame:
    """Each query's ``k`` best rows by inner product: ``query_id``, ``rank``, ``vec_id``, ``score``.

    Queries are the rows whose id is divisible by ``every``; they meet all rows
    but those with their own id, in cells of about ``block`` rows by ``queries``
    queries, dealt by hash, so that no cell depends on one value. A row is sent
    out once for each ``queries`` queries and a query once for each ``block``
    rows; where that makes fewer cells than the session has slots, rows are dealt
    to as many cells. Ties go to the smaller id. Vectors that are null, or hold a
    null or a non-finite component, take no part, nor do null ids; shorter
    vectors count as ending in zeros. Components of any finite size are compared
    exactly within a cell; a score that doesn't fit a long is returned as the
    least or largest long, and cells' rows that reach it tie. Repeated rows are
    candidates as often as they come; of different vectors under one query id the
    least is asked for. Without queries, or with an empty table, there are no
    rows; other columns are not looked at.
    """
    rows = usable(vectors, id_col, vector_col)
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.when(F.col("vec_id") % every == 0, F.col("vec_id"))).alias("q")).first()
    across = max(1, -(-size["q"] // queries))
    slots = vectors.sparkSession.sparkContext.defaultParallelism
    down = max(1, -(-size["n"] // block), min(-(-slots // across), -(-size["n"] // 1024)))
    lane = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(down)).cast("int")
    dealt = rows.select("vec_id", "v", lane.alias("i")).select("*", F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("j"))
    column = F.pmod(F.xxhash64("vec_id"), F.lit(across)).cast("int")
    asking = asked.select("vec_id", "v", column.alias("j")).select("*", F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("i"))

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], pa.int64())] * 3, names=names)
        width = max(1, *(int(np.diff(t["v"].combine_chunks().offsets.to_numpy()).max()) for t in (left, right)))
        found = searched(left["vec_id"].to_numpy(), _matrix(left["v"], width), right["vec_id"].to_numpy(), _matrix(right["v"], width), k, scale)
        return pa.table([pa.array(c, pa.int64()) for c in found], names=names)

    found = dealt.groupBy("i", "j").cogroup(asking.groupBy("i", "j")).applyInArrow(cell, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
