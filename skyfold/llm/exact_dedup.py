"""Exact duplicates by distributed radix partitioning on the bytes of the texts, most significant first."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyfold.llm.common import frozen, packed, text_of, unpacked

#: Bits of the table that tells tasks which first splits have more than one row: 2 ** SPLIT_BITS / 8 bytes whatever the input.
SPLIT_BITS = 26

#: The case fold of the equality.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """A to Z lower-cased and nothing else; NULL as empty."""
    return F.translate(text_of(text), UPPER, LOWER)


def _chunk(text: Column, offset: int, width: int) -> Column:
    """``width`` bytes from ``offset``, as Latin-1 so that a cut inside a character is harmless."""
    part = F.substring(text.cast("binary"), offset + 1, width)
    return F.translate(F.decode(part, "ISO-8859-1"), UPPER, LOWER)


def _shared_bits(shared: DataFrame) -> np.ndarray:
    """A bit for the low bits of each ``key``."""
    low = F.col("key").bitwiseAND(F.lit((1 << SPLIT_BITS) - 1))
    bits = F.bit_or(F.expr("shiftleft(1L, cast(key & 31 as int))"))
    out = np.zeros(1 << SPLIT_BITS >> 5, np.uint32)
    words = shared.groupBy(F.shiftright(low, 5).alias("w")).agg(bits.alias("bits")).toPandas()
    out[words["w"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).astype(np.uint32)
    return out


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", first: int = 64, growth: int = 16) -> DataFrame:
    """All rows of docs with ``keep_id``, ``group_size``, ``kept`` and ``normal_text``.

    Each text is read as its length in eight bytes followed by its bytes. The
    first split is by the length and the first bytes; every later one by the next
    bytes, each time ``growth`` times as many, until a group has one row or its
    text has ended. Rows alone in their group leave at once: a table of bits, of a
    fixed size, tells every task which first splits have more rows, so rows without
    company are neither shuffled nor written; a row that only shares a bit goes on
    and leaves later. Equality is that of all bytes; no digest takes part. Counts and survivors are partial aggregates,
    so a group of copies gives one row per task before it is shuffled, and its
    rows meet that one small row in a join whose large keys Spark splits.

    NULL and empty texts are one group. Of a group the row with the largest id
    stays, a NULL id being smallest; among repeated rows with that id exactly one
    stays. An empty table gives no rows. Columns named like an output are replaced.
    """
    text = text_of(F.col(f"_row.`{text_col}`"))
    rows = packed(docs)
    split = rows.select("_row", F.octet_length(text).alias("_len"), _chunk(text, 0, first).alias("_chunk"))
    split = split.withColumn("_key", F.xxhash64("_len", "_chunk"))
    shared = split.groupBy("_len", "_chunk").agg(F.count("*").alias("_n"), F.first("_key").alias("key")).where("_n > 1").select("key")
    shared_bits = docs.sparkSession.sparkContext.broadcast(_shared_bits(shared))

    @F.pandas_udf("boolean")
    def has_company(keys: pd.Series) -> pd.Series:
        low = keys.to_numpy(np.int64) & ((1 << SPLIT_BITS) - 1)
        return pd.Series(((shared_bits.value[low >> 5] >> (low & 31).astype(np.uint32)) & 1).astype(bool))

    # a row's number is written with it, so that all later steps see the same one
    company = split.where(has_company("_key"))
    table = frozen(company.select("_row", "_len", F.monotonically_increasing_id().alias("_id"), F.lit(0).cast("long").alias("_group")))
    alone = split.where(~has_company("_key"))
    done = [alone.select("_row", F.col(f"_row.`{id_col}`").alias("_keep"), F.lit(1).cast("long").alias("_size"), F.lit(True).alias("_kept"))]
    # the first round joins all that share length and head again by the next bytes, together with the head
    offset, width = 0, first + first * growth
    live = table
    while True:
        best = F.max(F.struct(F.col(f"_row.`{id_col}`").alias("id"), F.col("_id").alias("at"))).alias("_best")
        cut = live.withColumn("_chunk", _chunk(text, offset, width))
        groups = cut.groupBy("_group", "_len", "_chunk").agg(F.count("*").alias("_size"), best, F.min("_id").alias("_next"))
        meet = groups.select(F.col("_group").alias("_g"), F.col("_len").alias("_l"), F.col("_chunk").alias("_c"), "_size", "_best", "_next")
        joined = cut.join(meet, (F.col("_group") == F.col("_g")) & (F.col("_len") == F.col("_l")) & (F.col("_chunk") == F.col("_c")))
        ended = (F.col("_size") == 1) | (F.col("_len") <= offset + width)
        table = frozen(joined.select("_row", "_len", "_id", F.col("_next").alias("_group"), "_size", "_best", ended.alias("_ended")))
        done.append(table.where("_ended").select("_row", F.col("_best.id").alias("_keep"), "_size", (F.col("_best.at") == F.col("_id")).alias("_kept")))
        live = table.where("not _ended").select("_row", "_len", "_id", "_group")
        if live.isEmpty():
            break
        offset, width = offset + width, width * growth
    whole = done[0]
    for part in done[1:]:
        whole = whole.unionByName(part)
    return unpacked(whole, {"keep_id": F.col("_keep"), "group_size": F.col("_size"), "kept": F.col("_kept"), "normal_text": normalised(F.col(f"_row.`{text_col}`"))})
