"""I-Match fingerprints over randomised lexicon subsets, in DataFrame functions alone.

A term is a lower-cased run of letters and digits, known by its 64-bit hash.
The terms whose inverse document frequency over all documents lies in a band,
ln(1 / ``MOST_SHARE``) <= idf <= ln(1 / ``LEAST_SHARE``), make the lexicon. The
band is the same at every size, and a document of d distinct terms can bring at
most d / ``LEAST_SHARE`` / (number of documents) of them in: so the lexicon holds
at most (mean distinct terms of a document) / ``LEAST_SHARE`` terms, however many
documents there are. A fingerprint is a list of signatures, each the hash of the
sorted distinct lexicon terms of the text that fall in one random subset of the
lexicon. Subsets come in several densities, so that short and long texts alike
have some that hold just a few of their terms.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: (number of subsets, one term in so many falls in each, as a power of two).
SUBSETS = ((8, 3), (16, 6), (32, 9), (32, 12))
#: Shares of documents that a lexicon term is in, and the fewest documents: a term of one alone links none.
LEAST_SHARE, MOST_SHARE, LEAST_DOCS = 0.0005, 0.01, 2
#: Ranges of ids between quantiles, each cut further into cells of equal width.
RANGES = 256


def terms(text: Column) -> Column:
    """Hashes of the distinct terms of a text; null counts as empty."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))


def _constant(values: list[int], kind: str) -> Column:
    """A constant array, which goes to the plan as one string and is read there once."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def _lexicon(docs: DataFrame, text_col: str, least_share: float, most_share: float, least_docs: int) -> DataFrame:
    """The lexicon's terms, column ``term``, by document frequencies over all rows of ``docs``."""
    total = docs.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    least = max(least_docs, math.ceil(least_share * total))
    most = max(least, int(most_share * total))
    counted = docs.select(F.explode(terms(F.col(text_col).cast("string"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return counted.where((F.col("df") >= least) & (F.col("df") <= most)).select("term")


class Lexicon:
    """A set of terms as an expression: arrays of terms in buckets by the low bits of a term, two or more to a term.

    The buckets are the value of a session variable. So they stay in the JVM, go
    to tasks as one flat array and don't fill the plan's text, as constants would.
    """

    def __init__(self, held: DataFrame):
        spark = held.sparkSession
        flat, name = self._variable(spark, "array<bigint>", held.agg(F.collect_list("term")))
        self.mask = (1 << max(6, (2 * spark.range(1).select(F.size(flat)).first()[0]).bit_length())) - 1
        filled = spark.range(1).select(F.explode(flat).alias("term")).groupBy(F.col("term").bitwiseAND(F.lit(self.mask)).alias("id")).agg(F.collect_list("term").alias("held"))
        every = spark.range(self.mask + 1).join(filled, "id", "left").agg(F.array_sort(F.collect_list(F.struct("id", "held"))).alias("all"))
        self.buckets, _ = self._variable(spark, "array<array<bigint>>", every.select(F.col("all.held")))
        spark.sql(f"DROP TEMPORARY VARIABLE {name}")

    @staticmethod
    def _variable(spark: SparkSession, kind: str, value: DataFrame) -> tuple[Column, str]:
        """A session variable of a new name, and the name, with the value of a one-row table."""
        name = f"lexicon_{uuid.uuid4().hex}"
        spark.sql(f"DECLARE VARIABLE {name} {kind}")
        spark.sql(f"SET VAR {name} = (SELECT * FROM {{value}})", value=value)
        return F.expr(f"system.session.{name}"), name

    def holds(self, term: Column) -> Column:
        return F.coalesce(F.array_contains(F.element_at(self.buckets, term.bitwiseAND(F.lit(self.mask)).cast("int") + 1), term), F.lit(False))


def lexicon(docs: DataFrame, text_col: str = "text", least_share: float = LEAST_SHARE, most_share: float = MOST_SHARE, least_docs: int = LEAST_DOCS) -> Lexicon:
    """The terms in at least ``least_share`` of all documents (and in ``least_docs``), and in at most ``most_share``."""
    return Lexicon(_lexicon(docs, text_col, least_share, most_share, least_docs))


def _once(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def signatures(own: Column, band: Lexicon) -> Column:
    """A hash, or null for a subset without terms, for each subset; ``own`` are the terms of a text."""

    def level(held: Column, count: int, power: int, shift: int) -> Column:
        place = lambda t: F.shiftright(t, shift).bitwiseAND(F.lit((1 << power) - 1)).cast("int")
        near = F.filter(held, lambda t: place(t) < count) if count < 1 << power else held
        sign = lambda part: F.when(F.size(part) > 0, F.xxhash64(part))
        subset = lambda of, k: _once(F.filter(of, lambda t: place(t) == k), sign)
        return _once(near, lambda of: F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda k: subset(of, k)))

    lex = F.filter(own, band.holds)
    shifts = [sum(power for _, power in SUBSETS[:k]) for k in range(len(SUBSETS))]
    levels = lambda held: F.concat(*[level(held, count, power, shift) for (count, power), shift in zip(SUBSETS, shifts, strict=True)])
    return _once(F.array_sort(lex), levels)


def written(signs: Column) -> Column:
    """Signatures as one string of hex numbers; subsets without terms leave their place empty."""
    return F.array_join(F.transform(signs, lambda x: F.when(x.isNull(), "").otherwise(F.lower(F.hex(x)))), ".")


def likeness(a: Column, b: Column) -> Column:
    """Equal signatures as a share of the subsets that hold terms of either text; 1 where neither text has terms."""
    both = F.zip_with(a, b, lambda x, y: F.when(x == y, 1).when(x.isNotNull() | y.isNotNull(), 0))
    held = F.filter(both, lambda x: x.isNotNull())
    same = F.size(F.filter(held, lambda x: x == 1))
    return F.when(F.size(held) == 0, 1.0).otherwise(same / F.size(held))


def _cell(docs: DataFrame, about: int, most: int) -> Column:
    """The cell of a row, rising with its id; null ids share the least id's.

    Quantiles of the ids bound ``RANGES`` ranges, so that none holds much more than
    its share wherever ids lie; a range has cells of equal width, of ``about`` ids
    each where they lie evenly, and at most ``most`` in all.
    """
    shares = [k / RANGES for k in range(1, RANGES)]
    size = docs.agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.percentile_approx("doc_id", shares, 10 * RANGES).alias("cuts")).first()
    if size["low"] is None:
        return F.lit(0).cast("long")
    lows = sorted({size["low"], *size["cuts"]})
    ends = [*lows[1:], size["high"] + 1]
    each = max(1, min(most, size["n"] // about) // len(lows))
    widths = [-(-(end - low) // each) for low, end in zip(lows, ends, strict=True)]
    starts, steps, some_id = _constant(lows, "bigint"), _constant(widths, "double"), F.coalesce("doc_id", F.lit(size["low"]))

    # in doubles, as ids may lie further apart than a long reaches; equal ids fall in one cell, and cells rise with ids
    def within(r: Column) -> Column:
        place = F.floor((some_id.cast("double") - F.element_at(starts, r).cast("double")) / F.element_at(steps, r)).cast("long")
        return r.cast("long") * each + F.least(place, F.lit(each - 1).cast("long"))

    return _once(F.size(F.filter(starts, lambda low: low <= some_id)), within)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``fingerprint`` of every row, by the lexicon of the whole table."""
    band = lexicon(docs, text_col)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), written(signatures(terms(F.col(text_col).cast("string")), band)).alias("fingerprint"))


def edit_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", about: int = 256, most: int = 100_000) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are.

    The edited text ends in the start of the next document's text, in ascending
    id order, instead of its own last half; the last document's next is the
    first. Columns ``doc_id``, ``n_chars``, ``edited_sha256``, ``fingerprint``,
    ``edited_fingerprint``, ``near_edited``, ``near_next``.

    Null texts count as empty; null ids come before all others; rows that share
    an id follow each other by their text. A single row is its own next. Texts
    are used whole. An empty table gives no rows; other columns are not looked
    at. Rows are put in order in cells of ids, at most ``most`` of them (or
    ``RANGES``), and each cell also gets the next cell's first row.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    band = lexicon(rows)
    placed = rows.select("doc_id", _cell(rows, about, most).alias("cell"), "text")

    # each cell's first row, in order, is the guest of the cell before it
    key = F.struct(F.col("doc_id").isNotNull().alias("known"), F.col("doc_id"), F.xxhash64("text").alias("mark"), F.col("text"))
    firsts = placed.groupBy("cell").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), F.col("doc_id"))).alias("first"))
    order = Window.orderBy("cell")
    ranges = firsts.select("cell", "first", F.lag("cell").over(order).alias("host"), F.max("cell").over(Window.partitionBy()).alias("last"))
    ranges = ranges.select("cell", "first", F.coalesce("host", "last").alias("host"), F.col("host").isNull().alias("wraps"))
    starts = placed.join(F.broadcast(ranges), "cell").where(F.col("doc_id").eqNullSafe(F.col("first.doc_id")))
    guests = starts.groupBy("host", "wraps").agg(F.min(key).alias("k")).select(F.col("k.doc_id").alias("doc_id"), F.col("host").alias("cell"), F.col("k.text").alias("text"), F.lit(True).alias("guest"), "wraps")

    both = placed.withColumns({"guest": F.lit(False), "wraps": F.lit(False)}).unionByName(guests)
    signed = both.withColumn("signs", signatures(terms(F.col("text")), band))
    inside = Window.partitionBy("cell").orderBy("wraps", "guest", F.asc_nulls_first("doc_id"), F.xxhash64("text"), "text")
    paired = signed.withColumn("next", F.lead(F.struct("text", "signs")).over(inside)).where(~F.col("guest"))
    n, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    edited = paired.select(
        "doc_id", n.cast("long").alias("n_chars"), F.concat(F.left(F.col("text"), n - half), F.left(F.col("next.text"), half)).alias("edited"), "signs", F.col("next.signs").alias("next_signs")
    ).withColumn("edited_signs", signatures(terms(F.col("edited")), band))
    return edited.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), written(F.col("signs")).alias("fingerprint"), written(F.col("edited_signs")).alias("edited_fingerprint"),
        likeness(F.col("signs"), F.col("edited_signs")).alias("near_edited"), likeness(F.col("signs"), F.col("next_signs")).alias("near_next"),
    )
