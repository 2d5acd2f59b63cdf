"""Byte strings that also start elsewhere, found by suffix arrays of shards.

Shards are made by content, so that equal strings of ``width`` bytes meet: each
such string belongs to the least of its grams (by hash, the first of equal ones),
and the strings of neighbouring places that belong to one gram are one context.
Only contexts whose gram occurs again are cut out; equal contexts are folded and
counted, and the contexts of a gram lie in one shard. A shard's suffix array comes
from induced sorting and its common prefixes from the permuted walk (``induced``);
a place whose common prefix with a neighbour reaches ``width`` is repeated. A gram
with more contexts than a shard holds is split by content again: the strings that
lie about it are halved by their offset, and each half is told apart by all that
its strings have in common, until few contexts are left or one string is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyfold.llm.common import frozen, mix, packed, text_of, unpacked
from skyfold.llm.induced import repeated_starts


@dataclass(frozen=True)
class Strings:
    """Strings of ``width`` bytes, chosen grams of ``2 ** gram_log`` bytes, and the bytes of contexts sorted at a time."""

    width: int = 400
    gram_log: int = 6
    shard_bytes: int = 1 << 20

    @property
    def gram(self) -> int:
        return 1 << self.gram_log

    @property
    def grams(self) -> int:
        return self.width - self.gram + 1


#: Bytes hashed at a time: a place needs 18 bits beside the hash.
PIECE = 1 << 18
_LETTERS = mix(np.arange(1, 257, dtype=np.uint64))
_BASE = 0x9E3779B97F4A7C15


def gram_hashes(raw: np.ndarray, gram_log: int) -> np.ndarray:
    """A hash of the 2 ** gram_log bytes at every place; equal grams have equal hashes, others may."""
    out = _LETTERS[raw]
    for k in range(gram_log):
        step = 1 << k
        out = out[:-step] * np.uint64(pow(_BASE, step, 1 << 64)) + out[step:]
    return mix(out)


def least_grams(raw: np.ndarray, spec: Strings) -> tuple[np.ndarray, np.ndarray]:
    """For every string of some bytes the place of its least gram; and the grams' hashes. At most ``PIECE`` bytes."""
    hashes = gram_hashes(raw, spec.gram_log)
    low = np.uint64(PIECE - 1)
    least = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    have = 1
    while have * 2 <= spec.grams:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < spec.grams:
        rest = spec.grams - have
        least = np.minimum(least[:-rest], least[rest:])
    return (least & low).astype(np.int64), hashes


def _pieces(texts: Iterable[tuple[int, bytes]], spec: Strings) -> Iterator[tuple[list[tuple[int, int, int]], bytes]]:
    """Texts laid end to end in pieces of at most ``PIECE`` bytes: (number, offset in the text, bytes) of each part, and the bytes.

    A longer text comes in parts that overlap, so each string is in just one.
    """
    parts, held, size = [], [], 0
    for number, text in texts:
        if len(text) < spec.width:
            continue
        step = PIECE - spec.width + 1
        for at in range(0, len(text) - spec.width + 1, step):
            part = text[at : at + PIECE] if len(text) > PIECE else text
            if size + len(part) > PIECE:
                yield parts, b"".join(held)
                parts, held, size = [], [], 0
            parts.append((number, at, len(part)))
            held.append(part)
            size += len(part)
    if parts:
        yield parts, b"".join(held)


def contexts_of(texts: Iterable[tuple[int, bytes]], spec: Strings) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(number, first place, number of strings, gram's place in the context, gram's hash) of the contexts of some texts."""
    for parts, raw in _pieces(texts, spec):
        least, hashes = least_grams(np.frombuffer(raw, np.uint8), spec)
        sizes = np.array([n for _, _, n in parts])
        begin = np.cumsum(sizes) - sizes
        whole = np.zeros(len(raw) + 1, np.int32)
        whole[begin] += 1
        whole[begin + sizes - spec.width + 1] -= 1
        at = np.flatnonzero(np.cumsum(whole[: len(least)]))  # strings that lie in one text
        part = np.searchsorted(begin, at, side="right") - 1
        gram = least[at]
        cut = np.flatnonzero((np.diff(gram, prepend=-1) != 0) | (np.diff(part, prepend=-1) != 0))
        strings = np.diff(np.append(cut, len(at)))
        first, part = at[cut], part[cut]
        numbers, offsets = np.array([p[0] for p in parts]), np.array([p[1] for p in parts])
        yield numbers[part], first - begin[part] + offsets[part], strings, gram[cut] - first, hashes[gram[cut]].view(np.int64)


# --- rows ------------------------------------------------------------------------------------------------

_CUT = "t binary, at long, n int, off int, key long"


def _cuts(texts: DataFrame, spec: Strings) -> DataFrame:
    """Rows of ``_CUT``, one for each context of rows (t, text): its first place, its strings, its gram's place and hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0)
            for number, at, n, off, key in contexts_of(enumerate(b.column(1).to_pylist()), spec):
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(number)), pa.array(at), pa.array(n, pa.int32()), pa.array(off, pa.int32()), pa.array(key)], names=["t", "at", "n", "off", "key"])

    return texts.select("t", F.col("text").cast("binary")).mapInArrow(run, _CUT)


#: A context: its gram and the offsets of strings that the key stands for (low to high - 1 bytes before the gram), its digest and bytes.
_CONTEXT = "key long, low int, high int, off int, c binary, bytes binary"


def _digest(key: int, low: int, raw: bytes) -> bytes:
    return hashlib.sha256(b"%d:%d:" % (key, low) + raw).digest()[:16]


def _zip(texts: DataFrame) -> DataFrame:
    """(t, z, size): texts packed for the shuffle, one row for each distinct text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", compression_level=1)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                raw = part.column(1).to_pylist()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([codec.compress(x, asbytes=True) for x in raw], pa.binary()), pa.array([len(x) for x in raw], pa.int64())], names=["t", "z", "size"])

    rows = texts.select("t", F.col("text").cast("binary")).mapInArrow(run, "t binary, z binary, size long")
    return rows.groupBy("t").agg(F.first("z").alias("z"), F.first("size").alias("size"))


def _occurrences(held: DataFrame, spec: Strings, with_bytes: bool) -> DataFrame:
    """Contexts of rows (t, z, size, m, cuts): their places, or their bytes and how often they occur."""
    low, high = 0, spec.grams

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                cuts = part.column("cuts")
                owner = np.repeat(np.arange(part.num_rows), pa.compute.list_value_length(cuts).to_numpy())
                flat = cuts.flatten()
                field = {n: flat.field(flat.type.get_field_index(n)) for n in ("at", "n", "off", "key")}
                texts = [codec.decompress(z, decompressed_size=n, asbytes=True) for z, n in zip(part.column("z").to_pylist(), part.column("size").to_pylist())]
                spans = zip(owner.tolist(), field["at"].to_pylist(), field["n"].to_pylist())
                raw = [texts[o][x : x + n - 1 + spec.width] for o, x, n in spans]
                digests = pa.array([_digest(key, low, x) for key, x in zip(field["key"].to_pylist(), raw)], pa.binary())
                owner = pa.array(owner)
                if with_bytes:
                    ints = [pa.array(np.full(len(raw), v, np.int32)) for v in (low, high)]
                    yield pa.RecordBatch.from_arrays([field["key"], *ints, field["off"], digests, pa.array(raw, pa.binary()), part.column("m").take(owner)], names=["key", "low", "high", "off", "c", "bytes", "m"])
                else:
                    yield pa.RecordBatch.from_arrays([digests, part.column("t").take(owner), field["at"]], names=["c", "t", "at"])

    return held.mapInArrow(run, f"{_CONTEXT}, m long" if with_bytes else "c binary, t binary, at long")


def _folded(rows: DataFrame) -> DataFrame:
    """Equal contexts as one row with their number."""
    firsts = [F.first(c).alias(c) for c in ("low", "high", "off", "bytes")]
    return rows.groupBy("key", "c").agg(F.sum("m").alias("m"), *firsts)


def _halves(contexts: DataFrame, spec: Strings) -> DataFrame:
    """The contexts cut at the middle of their key's offsets, with keys of what all strings of a half share; ``up`` is the context cut, ``shift`` the half's place in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for row in b.to_pylist():
                raw, off, strings = row["bytes"], row["off"], len(row["bytes"]) - spec.width + 1
                middle = (row["low"] + row["high"]) // 2
                for low, high in ((row["low"], middle), (middle, row["high"])):
                    # strings start off - s bytes before the gram
                    first, last = max(0, off - high + 1), min(strings - 1, off - low)
                    if first > last:
                        continue
                    part = raw[first : last + spec.width]
                    core = raw[off - low : off - high + 1 + spec.width]
                    key = int.from_bytes(hashlib.sha256(b"%d:%d:" % (row["key"], low) + core).digest()[:8], "little", signed=True)
                    out.append((key, low, high, off - first, _digest(key, low, part), part, row["m"], row["c"], first))
            names = ["key", "low", "high", "off", "c", "bytes", "m", "up", "shift"]
            types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(zip(*out), types)] if out else [pa.array([], t) for t in types], names=names)

    return contexts.mapInArrow(run, f"{_CONTEXT}, m long, up binary, shift int")


def _sorted(contexts: DataFrame, spec: Strings) -> DataFrame:
    """(c, first, last): runs of repeated starts in each context, from the suffix arrays of shards of whole keys."""

    def shard(rows: list[tuple[bytes, bytes, int]]) -> pa.RecordBatch:
        c, first, last = [], [], []
        for (digest, raw, m), at in zip(rows, repeated_starts([r[1] for r in rows], spec.width)):
            if m > 1:  # a folded context starts elsewhere with all its strings
                at = np.arange(len(raw) - spec.width + 1)
            cut = np.flatnonzero(np.diff(at, prepend=-9) != 1)
            for x, y in zip(at[cut].tolist(), at[np.append(cut[1:], len(at)) - 1].tolist() if len(at) else []):
                c.append(digest)
                first.append(x)
                last.append(y)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.binary()), pa.array(first, pa.int32()), pa.array(last, pa.int32())], names=["c", "first", "last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held, now = [], 0, None
        for b in batches:
            for key, c, raw, m in zip(*[b.column(n).to_pylist() for n in ("key", "c", "bytes", "m")]):
                if held >= spec.shard_bytes and key != now:
                    yield shard(rows)
                    rows, held = [], 0
                rows.append((c, raw, m))
                held += len(raw)
                now = key
        if rows:
            yield shard(rows)

    return contexts.select("key", "c", "bytes", "m").repartition("key").sortWithinPartitions("key").mapInArrow(run, "c binary, first int, last int")


def _repeats(contexts: DataFrame, spec: Strings) -> DataFrame:
    """(c, first, last) of folded contexts (a frozen table): keys with more than a shard's bytes are split first."""
    sizes = contexts.groupBy("key").agg(F.sum(F.octet_length("bytes")).alias("held"), F.max(F.col("high") - F.col("low")).alias("wide"))
    hot = frozen(sizes.where((F.col("held") > spec.shard_bytes) & (F.col("wide") > 1)).select(F.col("key").alias("hot")))
    if hot.isEmpty():
        return _sorted(contexts, spec)
    calm = contexts.join(hot, F.col("key") == F.col("hot"), "left_anti")
    halves = frozen(_halves(contexts.join(hot, F.col("key") == F.col("hot"), "left_semi"), spec))
    found = _repeats(frozen(_folded(halves)), spec)
    back = halves.select("c", "up", "shift").join(found, "c")
    lifted = back.select(F.col("up").alias("c"), (F.col("first") + F.col("shift")).alias("first"), (F.col("last") + F.col("shift")).alias("last"))
    return _sorted(calm, spec).unionByName(lifted)


def repeated_bytes(texts: DataFrame, spec: Strings = Strings()) -> DataFrame:
    """(t, first, last): runs of starts of repeated strings in each distinct text, of rows (t, text) where t stands for the text."""
    cuts = frozen(_cuts(texts, spec))
    # written, so that the join below is between shuffles of its own and a key with many rows can be split
    again = frozen(cuts.groupBy(F.col("key").alias("again")).agg(F.count("*").alias("times")).where("times > 1").select("again"))
    places = cuts.join(again, F.col("key") == F.col("again")).groupBy("t", "at", "n", "off", "key").agg(F.count("*").alias("m"))
    lists = places.groupBy("t").agg(F.max("m").alias("m"), F.collect_list(F.struct("at", "n", "off", "key")).alias("cuts"))
    held = frozen(_zip(texts).join(lists, "t"))
    found = _repeats(frozen(_folded(_occurrences(held, spec, True))), spec)
    met = _occurrences(held, spec, False).join(found, "c")
    return met.select("t", (F.col("at") + F.col("first")).alias("first"), (F.col("at") + F.col("last")).alias("last"))


def suffix_dedup(docs: DataFrame, text_col: str = "text", spec: Strings = Strings()) -> DataFrame:
    """All rows of docs with ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept_bytes``: bytes left when every repeated string is taken out.

    A string of ``width`` UTF-8 bytes is repeated if it also starts at another
    place of the table, in the same row, another row or an equal row; all its
    occurrences go, and strings are judged on the input. A span is a maximal run
    of removed bytes. NULL is an empty text; texts shorter than ``width`` keep all
    bytes; what is kept may cut a character. Equal rows have equal results, rows
    may come in any order, an empty table gives no rows, and columns named like an
    output are replaced. A text is hashed in overlapping parts of 256 kB, but is
    itself one value of a row, as are its spans. Jobs run here.
    """
    text = text_of(F.col(f"_row.`{text_col}`"))
    rows = packed(docs).withColumn("_t", F.substring(F.unhex(F.sha2(text, 256)), 1, 16))
    runs = repeated_bytes(rows.select(F.col("_t").alias("t"), text.alias("text")), spec)
    spans = runs.groupBy("t").agg(F.collect_list(F.struct("first", "last")).alias("_spans"))
    met = rows.join(spans, F.col("_t") == F.col("t"), "left").withColumn("_text", text.cast("binary"))

    @F.pandas_udf("n_bytes long, n_removed long, n_spans long, kept_bytes binary")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        out = []
        for raw, found in zip(texts, spans):
            if found is None or not len(found):
                out.append((len(raw), 0, 0, raw))
                continue
            edge = np.zeros(len(raw) + 1, np.int32)
            np.add.at(edge, [s["first"] for s in found], 1)
            np.add.at(edge, [s["last"] + spec.width for s in found], -1)
            gone = np.cumsum(edge[:-1]) > 0
            out.append((len(raw), int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()), np.frombuffer(raw, np.uint8)[~gone].tobytes()))
        return pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_bytes"])

    done = met.withColumn("_cut", cut("_text", "_spans"))
    return unpacked(done, {n: F.col(f"_cut.{n}") for n in ("n_bytes", "n_removed", "n_spans", "kept_bytes")})
