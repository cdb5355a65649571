"""Exact deduplication by two-pass Bloom filtering, with DataFrame functions only.

Pass one counts the 64-bit hashes of the normalised texts, merged where they are
read; nothing but a hash and a count is sent. Those that more than one row has are
entered in a Bloom filter of two probes. Pass two tests each row against it: a row
with an unmarked bit is certainly alone and passes straight through; only the others
shuffle and are grouped by their SHA-256.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import durable

#: Each of the filter's two halves has at most this many bits; both are broadcast, 256 MB in all.
MOST_BITS = 1 << 30
LEAST_BITS = 1 << 15
BITS_A_HASH = 16
#: A group with more than one of so many rows is hot; there can be no more hot groups than this.
HOT = 500


def normalised(text: Column) -> Column:
    """The text with every run of white space made one space; null is empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def _slots(text_hash: Column, bits: int) -> list[Column]:
    """The row's place in either half, from 1; the second half follows the first."""
    return [F.pmod(h, F.lit(bits)) + F.lit(1 + k * bits) for k, h in enumerate((text_hash, F.xxhash64(text_hash, F.lit(7))))]


def _marked(hashes: DataFrame) -> tuple[DataFrame, int]:
    """(bucket, bitmap) of the filter of all hashes that occur twice, and the bits of each half."""
    twice = durable(hashes.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h"))
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << math.ceil(math.log2(max(1, twice.count()) * BITS_A_HASH))))
    slots = twice.select(F.explode(F.array(*_slots(F.col("h"), bits))).alias("slot"))
    return slots.groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bitmap")), bits


def _tested(rows: DataFrame, marked: DataFrame, bits: int) -> DataFrame:
    """rows with a column maybe_twice: both of the row's bits are marked."""
    out = rows
    tests = []
    for k, slot in enumerate(_slots(F.col("h"), bits)):
        filter_k = F.broadcast(marked.select(F.col("bucket").alias(f"bucket_{k}"), F.col("bitmap").alias(f"bitmap_{k}")))
        out = out.join(filter_k, F.bitmap_bucket_number(slot) == F.col(f"bucket_{k}"), "left")
        place = F.bitmap_bit_position(slot)
        byte = F.conv(F.hex(F.substring(F.col(f"bitmap_{k}"), (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        tests.append(F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False)))
    return out.withColumn("maybe_twice", tests[0] & tests[1]).drop("bucket_0", "bitmap_0", "bucket_1", "bitmap_1")


def annotate_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, maybe_twice.

    Texts are equal when they are after every run of white space has become one
    space; a null text is empty, so null and empty texts are one group. Of equal
    texts the row with the smallest id stays (null ids come last; a group of
    null ids alone keeps them). A row given twice with the id that stays is
    reported as kept each time. Very long texts are read whole. An empty table gives
    an empty one. Other columns are not read, whatever their names.
    """
    text = normalised(F.col(f"`{text_col}`"))
    digests = durable(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.sha2(text, 256).alias("text_sha256")).withColumn("h", F.xxhash64("text_sha256")))
    tested = _tested(digests, *_marked(digests))
    alone = tested.filter(~F.col("maybe_twice")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "text_sha256", "maybe_twice")
    again = tested.filter("maybe_twice").drop("h")
    groups = durable(again.groupBy("text_sha256").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    hot = groups.filter(F.col("group_size") > digests.count() / HOT)
    in_hot = again.join(F.broadcast(hot), "text_sha256")
    in_others = again.join(F.broadcast(hot), "text_sha256", "left_anti").join(groups, "text_sha256")
    out = alone.unionByName(in_hot).unionByName(in_others)
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "maybe_twice")


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all of their columns, one for each text.

    Rows are those of annotate_duplicates() that are kept; of rows with the same
    smallest id, one stays. Copies merge where they are read, before anything
    shuffles, so a text that a third of all rows share costs one row a task. Null
    and empty texts are one group, very long ones are whole, an empty table gives an
    empty one, and columns of any name pass through.
    """
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = whole.withColumn("h", F.xxhash64(normalised(F.col(f"row.`{text_col}`"))))
    tested = _tested(rows, *_marked(rows.select("h")))
    alone = tested.filter(~F.col("maybe_twice")).select("row")
    first = F.struct(F.col(f"row.`{id_col}`").isNull().alias("a"), F.col(f"row.`{id_col}`").alias("b"), F.xxhash64("row").alias("c"))
    again = tested.filter("maybe_twice").withColumn("sha", F.sha2(normalised(F.col(f"row.`{text_col}`")), 256))
    return alone.unionByName(again.groupBy("sha").agg(F.min_by("row", first).alias("row")).select("row")).select("row.*")
