"""Mixing sources to target weights by drawing fixed-length blocks of words."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyfold.llm.common import frozen, numbered, packed, prefix_sums, text_of, unpacked, words_of

_FULL = (1 << 64) - 1


@dataclass(frozen=True)
class Mix:
    """``weights`` repeat over the sources in code point order, NULL last; no source gives more than ``cap`` times its words.

    ``max_sources`` bounds the table of sources that the driver and every task
    hold (one name and a few numbers each); more sources raise an error.
    """

    weights: tuple[int, ...] = (5, 2, 1)
    cap: int = 3
    block: int = 256
    shards: int = 16
    seed: int = 7
    max_sources: int = 100_000


class Permutation:
    """A pseudorandom order of 0 to n-1: a four-round Feistel network over the next power of four, walked until it falls below n."""

    def __init__(self, n: int, key: int):
        self.n = n
        self.half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        rng = np.random.default_rng(key)
        self.keys = [int(k) for k in rng.integers(0, 1 << 63, 4)]

    def _round(self, x: np.ndarray, key: int) -> np.ndarray:
        h = (x + np.uint64(key)) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
        return (h >> np.uint64(29)) & np.uint64((1 << self.half) - 1)

    def _once(self, x: np.ndarray, keys: list[int], back: bool) -> np.ndarray:
        mask, h = np.uint64((1 << self.half) - 1), np.uint64(self.half)
        left, right = x >> h, x & mask
        for k in keys:
            if back:
                left, right = right ^ self._round(left, k), left
            else:
                left, right = right, left ^ self._round(right, k)
        return (left << h) | right

    def _walk(self, x: np.ndarray, keys: list[int], back: bool) -> np.ndarray:
        out = self._once(np.asarray(x, np.uint64), keys, back)
        while (far := out >= np.uint64(self.n)).any():
            out[far] = self._once(out[far], keys, back)
        return out.astype(np.int64)

    def at(self, x: np.ndarray) -> np.ndarray:
        return self._walk(x, self.keys, False)

    def where(self, y: int) -> int:
        return int(self._walk(np.array([y]), self.keys[::-1], True)[0])


def targets(sizes: list[int], weights: tuple[int, ...], cap: int) -> list[float]:
    """Shares of all sizes by weight; what a source cannot give is shared anew among the others."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    out = [0.0] * len(sizes)
    open_, rest = list(range(len(sizes))), sum(sizes)
    while open_:
        total = sum(w[i] for i in open_)
        full = [i for i in open_ if rest * w[i] > cap * sizes[i] * total]
        if not full:
            for i in open_:
                out[i] = rest * w[i] / total
            break
        for i in full:
            out[i] = float(cap * sizes[i])
            rest -= cap * sizes[i]
        open_ = [i for i in open_ if i not in set(full)]
    return out


def _key(seed: int, name: str | None, epoch: int) -> int:
    return zlib.crc32(f"{seed}/{epoch}/".encode() + (b"\0" if name is None else b"=" + name.encode())) | seed << 32


class _Source:
    """How many slots a source fills: whole passes over its blocks, then blocks until the words suffice."""

    def __init__(self, name: str | None, size: int, target: float, mix: Mix):
        self.name, self.size, self.target = name, size, target
        self.blocks = -(-size // mix.block)
        words = round(target)
        self.passes, rest = divmod(words, size) if size else (0, 0)
        self.last = size - (self.blocks - 1) * mix.block  # words of the last, shorter block
        self.tail = -(-rest // mix.block)
        self.cut = rest - (self.tail - 1) * mix.block  # words taken from the last slot
        if rest:
            at = self.order(self.passes, mix.seed).where(self.blocks - 1)
            short = mix.block - self.last
            if at < self.tail - 1:
                self.cut += short
                if self.cut > mix.block:
                    self.tail, self.cut = self.tail + 1, self.cut - mix.block
            elif at == self.tail - 1 and self.cut > self.last:
                self.tail, self.cut = self.tail + 1, self.cut - self.last
        self.slots = self.passes * self.blocks + self.tail

    def order(self, epoch: int, seed: int) -> Permutation:
        return Permutation(self.blocks, _key(seed, self.name, epoch))

    def fill(self, slot: np.ndarray, mix: Mix) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pass, block and words taken of some slots."""
        epoch, at = slot // self.blocks, slot % self.blocks
        block = np.empty(len(slot), np.int64)
        for e in np.unique(epoch):
            block[epoch == e] = self.order(int(e), mix.seed).at(at[epoch == e])
        words = np.where(block == self.blocks - 1, self.last, mix.block)
        words[(epoch == self.passes) & (at == self.tail - 1)] = self.cut
        return epoch, block, words


def shard_counts(slots: list[int], shards: int, seed: int) -> np.ndarray:
    """Slots of each source in each output shard: multinomial draws by what the sources still owe, so that all is drawn in the end."""
    rng = np.random.default_rng(seed)
    left = np.array(slots, np.int64)
    total, out = int(left.sum()), np.zeros((shards, len(slots)), np.int64)
    for j in range(shards):
        want = total * (j + 1) // shards - total * j // shards
        while want:
            draw = np.minimum(rng.multinomial(want, left / left.sum()), left)
            out[j] += draw
            left -= draw
            want -= int(draw.sum())
    return out


def _slots(spark, sources: list[_Source], mix: Mix) -> DataFrame:
    """One row for each slot of the mix: source number, pass, block, words, shard."""
    ends = np.cumsum([s.slots for s in sources])
    counts = np.cumsum(shard_counts([s.slots for s in sources], mix.shards, mix.seed), axis=0) if sources else None

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids = b["id"].to_numpy()
            which = np.searchsorted(ends, ids, side="right")
            for s in np.unique(which):
                src, slot = sources[s], ids[which == s] - (ends[s] - sources[s].slots)
                epoch, block, words = src.fill(slot, mix)
                yield pd.DataFrame({"_s": np.int32(s), "_epoch": epoch.astype(np.int32), "_block": block, "_words": words, "_shard": np.searchsorted(counts[:, s], slot, side="right").astype(np.int32)})

    n = int(ends[-1]) if sources else 0
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), n // 4096 + 1))
    return spark.range(0, n, 1, parts).mapInPandas(fill, "_s int, _epoch int, _block long, _words long, _shard int")


def mixing_pieces(rows: DataFrame, source_col: str, size_col: str, order: list[str], mix: Mix = Mix()) -> tuple[DataFrame, DataFrame]:
    """(placed, pieces) of the mix.

    The words of a source, documents laid end to end along ``order``, are cut
    into blocks of ``mix.block`` words. ``placed`` has the rows with ``before``
    (the word of its source at which a row starts), ``rank``, ``_s`` (the
    source's number), ``source_size`` and ``target``. ``pieces`` has one row for
    each stretch of a document that the mix takes: ``_s``, ``rank``, ``_epoch``,
    ``_shard``, ``lo``, ``hi`` (words of the document, from 0). Slots and
    stretches meet by source and block, so no source is one key.
    """
    spark = rows.sparkSession
    placed = frozen(prefix_sums(rows, order, size_col, [source_col]))
    found = placed.groupBy(source_col).agg(F.max("total").alias("n")).orderBy(F.col(source_col).asc_nulls_last()).limit(mix.max_sources + 1).collect()
    if len(found) > mix.max_sources:
        raise ValueError(f"more than max_sources = {mix.max_sources} sources")
    shares = targets([r["n"] for r in found], mix.weights, mix.cap)
    sources = [_Source(r[source_col], r["n"], t, mix) for r, t in zip(found, shares)]
    table = spark.createDataFrame([(s.name, i, float(s.target)) for i, s in enumerate(sources)], "_name string, _s int, target double")
    placed = placed.join(F.broadcast(table), F.col(source_col).eqNullSafe(F.col("_name"))).select(*rows.columns, "before", "rank", "_s", F.col("total").alias("source_size"), "target")
    b, size = mix.block, F.col(size_col)
    cut = placed.where(size > 0).select("_s", "rank", "before", size.alias("_size"), F.explode(F.sequence(F.expr(f"before div {b}"), F.expr(f"(before + `{size_col}` - 1) div {b}"))).alias("_block"))
    lo = F.greatest(F.col("_block") * b - F.col("before"), F.lit(0))
    met = cut.join(_slots(spark, sources, mix), ["_s", "_block"])
    hi = F.least((F.col("_block") + 1) * b - F.col("before"), F.col("_size"), F.col("_block") * b + F.col("_words") - F.col("before"))
    pieces = met.select("_s", "rank", "_epoch", "_shard", lo.alias("lo"), hi.alias("hi")).where("hi > lo")
    return placed, pieces


def mixing_counts(rows: DataFrame, source_col: str, size_col: str, order: list[str], mix: Mix = Mix()) -> DataFrame:
    """The rows with ``source_size``, ``target`` and ``taken``, the words the mix takes of each, repeats counted.

    A row of no words is never taken. NULL is a source of its own, after all
    others. Targets are reached to the word. Equal seeds give equal mixes: the
    order of the words is given by ``order``, and rows equal in all its columns
    are interchangeable. An empty table gives no rows. Columns named like an
    output are replaced; no other name can clash.
    """
    keys = [F.col(f"_row.`{c}`").alias(f"_o{i}") for i, c in enumerate(order)]
    inner = packed(rows).select("_row", *keys, F.col(f"_row.`{source_col}`").alias("_src"), F.col(f"_row.`{size_col}`").alias("_n"))
    placed, pieces = mixing_pieces(inner, "_src", "_n", [f"_o{i}" for i in range(len(order))], mix)
    taken = pieces.groupBy(F.col("_s").alias("_ts"), F.col("rank").alias("_tr")).agg(F.sum(F.col("hi") - F.col("lo")).alias("_taken"))
    joined = placed.join(taken, (F.col("_s") == F.col("_ts")) & (F.col("rank") == F.col("_tr")), "left")
    return unpacked(joined, {"source_size": F.col("source_size"), "target": F.col("target"), "taken": F.coalesce("_taken", F.lit(0)).cast("long")})


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", mix: Mix = Mix()) -> DataFrame:
    """The mix as documents: for each pass over a source one row per document it takes, with the words it takes.

    A document taken whole keeps its text; of others the taken words are joined
    by one space. ``pass`` and ``shard`` (of the first stretch) are added. Other
    columns stay as they are. Documents without words are not taken.
    """
    table = numbered(docs)
    text = text_of(F.col(f"_row.`{text_col}`"))
    rows = table.select("_id", F.col(f"_row.`{id_col}`").alias("_key"), F.crc32(text.cast("binary")).alias("_crc"), F.col(f"_row.`{source_col}`").cast("string").alias("_src"), F.size(words_of(text)).cast("long").alias("_n"))
    placed, pieces = mixing_pieces(rows, "_src", "_n", ["_key", "_crc", "_n", "_id"], mix)
    runs = pieces.groupBy("_s", "rank", "_epoch").agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "_shard"))).alias("_runs"))
    chosen = placed.select("_s", "rank", "_id", "_n").join(runs, ["_s", "rank"]).select(F.col("_id").alias("_of"), "_n", "_epoch", "_runs")
    met = table.join(chosen, F.col("_id") == F.col("_of"))
    whole = F.aggregate("_runs", F.lit(0).cast("long"), lambda a, r: a + r["hi"] - r["lo"]) == F.col("_n")
    parts = F.transform("_runs", lambda r: F.slice(F.col("_words"), (r["lo"] + 1).cast("int"), (r["hi"] - r["lo"]).cast("int")))
    some = met.withColumn("_words", F.when(whole, F.array().cast("array<string>")).otherwise(words_of(text)))
    return unpacked(some, {text_col: F.when(whole, text).otherwise(F.array_join(F.flatten(parts), " ")), "pass": F.col("_epoch"), "shard": F.col("_runs")[0]["_shard"]})
