"""Repeated word windows: a count-min sketch lets only windows estimated repeated go on to exact grouping."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyfold.llm.common import WordTable, byte_batches, frozen, packed, text_of, unpacked
from skyfold.llm.sketch import SLICE_BITS, Sketch, merged_sketch


@dataclass(frozen=True)
class Windows:
    """Windows of ``words`` words; each is counted at the least of its ``anchor``-word runs.

    The sketch has ``depth`` rows of up to 2 ** ``most_bits`` cells; two bits of
    each cell (twice or more, ``hot`` times or more) are all that tasks get, so
    that is depth * 2 ** most_bits / 4 bytes whatever the input. With fewer cells
    than the input fills, more windows go on; none is lost.
    """

    words: int = 20
    anchor: int = 8
    depth: int = 2
    most_bits: int = 28
    hot: int = 5_000


class _Found:
    """The windows of some texts with the anchor of each: ``at`` (first word), ``anchor`` (its first word) and both hashes."""

    def __init__(self, texts: list[bytes], win: Windows):
        self.table = WordTable(texts)
        self.at = self.table.runs(win.words)
        k = win.words - win.anchor + 1
        n = len(self.table.text) - win.anchor + 1
        if len(self.at):
            runs = self.table.run_hashes(win.anchor, np.arange(n))
            least = np.lib.stride_tricks.sliding_window_view(runs, k)[self.at].argmin(axis=1)
            self.anchor = self.at + least
            self.keys = runs[self.anchor]
        else:
            self.anchor, self.keys = self.at, np.empty(0, np.uint64)


def _sketch(table: DataFrame, win: Windows, bits: int) -> Sketch:
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for b in batches:
            for part in byte_batches((t.encode() for t in b.column(0).to_pylist()), len):
                found = _Found(part, win)
                # an occurrence counts once, whatever number of windows it serves
                yield found.keys[np.flatnonzero(np.diff(found.anchor, prepend=-1))]

    return merged_sketch(table.select("_text"), keys, bits, win.depth, [2, win.hot])


def _spans(doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, first, last) of runs of consecutive window starts; input sorted by doc and start."""
    cut = np.flatnonzero((np.diff(doc, prepend=-1) != 0) | (np.diff(at, prepend=-9) != 1))
    return doc[cut], at[cut], at[np.append(cut[1:], len(at)) - 1] if len(at) else at


_EXACT = "key long, salt int, doc long, id long, first int, mask int, wins binary, last int"


def _candidates(table: DataFrame, win: Windows, sketch) -> DataFrame:
    """Rows of ``_EXACT``: for each anchor occurrence its windows (from ``first``, those in ``mask``) that may be repeated, without ones that
    repeat inside their batch; of those only the spans (mask 0, ``first`` to ``last``) are left."""
    null = np.iinfo(np.int64).min

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = sketch.value
        for b in batches:
            ids = b.column(1).to_numpy(zero_copy_only=False)
            docs = np.array([null if x is None else x for x in b.column(2).to_pylist()], np.int64)
            order = np.lexsort((ids, docs))
            texts = b.column(0).take(pa.array(order)).to_pylist()
            at = 0
            for part in byte_batches((t.encode() for t in texts), len):
                rows = order[at : at + len(part)]
                at += len(part)
                found = _Found(part, win)
                on = np.flatnonzero(tables.test(found.keys, 0))
                if not len(on):
                    continue
                starts, keys, anchor = found.at[on], found.keys[on], found.anchor[on]
                wins = found.table.run_hashes(win.words, starts)
                doc = found.table.text[starts]
                first = starts - found.table.first[doc]  # word number inside the text
                # texts stand in the order of (id, row), so the first of equal windows is the earliest of the batch
                same = np.lexsort((np.arange(len(wins)), wins, keys))
                repeat = np.zeros(len(wins), bool)
                repeat[same[1:]] = (wins[same[1:]] == wins[same[:-1]]) & (keys[same[1:]] == keys[same[:-1]])
                sd, sf, sl = _spans(doc[repeat], first[repeat])
                keep = np.flatnonzero(~repeat)
                hot = tables.test(keys[keep], 1)
                off = (anchor[keep] - starts[keep]).astype(np.int64)
                # one row for the windows of an anchor occurrence; windows of hot anchors are dealt one by one
                group = np.flatnonzero(hot | (np.diff(anchor[keep], prepend=-1) != 0))
                base = np.zeros(len(keep), np.int64)
                base[group] = 1
                of = np.cumsum(base) - 1
                head = keep[group]
                mask = np.bitwise_or.reduceat(np.int64(1) << (first[keep] - first[head][of]), group) if len(keep) else np.empty(0, np.int64)
                ends = np.append(group[1:], len(keep))
                raw = wins[keep]
                salt = np.where(hot[group], 1 + (wins[head] >> np.uint64(48)).astype(np.int64) % 1024, 0) if len(keep) else np.empty(0, np.int64)
                n = len(head)
                del off
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([keys[head].view(np.int64), np.zeros(len(sd), np.int64)])), pa.array(np.concatenate([salt, np.zeros(len(sd), np.int64)]), pa.int32()),
                        pa.array(np.concatenate([docs[rows[doc[head]]], docs[rows[sd]]])), pa.array(np.concatenate([ids[rows[doc[head]]], ids[rows[sd]]])),
                        pa.array(np.concatenate([first[head], sf]), pa.int32()), pa.array(np.concatenate([mask, np.zeros(len(sd), np.int64)]), pa.int32()),
                        pa.array([raw[x:y].tobytes() for x, y in zip(group, ends)] + [None] * len(sd), pa.binary()), pa.array(np.concatenate([np.zeros(n, np.int64), sl]), pa.int32()),
                    ],
                    names=["key", "salt", "doc", "id", "first", "mask", "wins", "last"],
                )

    return table.select("_text", "_id", "_doc").mapInArrow(run, _EXACT)


def _later(rows: DataFrame) -> DataFrame:
    """(id, first, last): spans of window starts whose words also start earlier, of rows of ``_EXACT`` with windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key_now, seen = None, np.empty(0, np.uint64)  # windows met so far at the anchor that the last batch ended with
        for b in batches:
            col = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            keys = col["key"].to_numpy(zero_copy_only=False)
            masks = col["mask"].to_numpy(zero_copy_only=False).astype(np.int64)
            set_bits = masks[:, None] >> np.arange(31) & 1
            row, bit = np.nonzero(set_bits)
            wins = np.frombuffer(b"".join(col["wins"].to_pylist()), np.uint64)
            ids = col["id"].to_numpy(zero_copy_only=False)[row]
            first = col["first"].to_numpy(zero_copy_only=False).astype(np.int64)[row] + bit
            order = np.lexsort((np.arange(len(wins)), wins, keys[row]))
            repeat = np.zeros(len(wins), bool)
            repeat[order[1:]] = (wins[order[1:]] == wins[order[:-1]]) & (keys[row][order[1:]] == keys[row][order[:-1]])
            if key_now is not None and len(keys) and keys[0] == key_now:
                again = keys[row] == key_now
                repeat[again] |= np.isin(wins[again], seen)
            else:
                seen = seen[:0]
            if len(keys):
                if key_now != keys[-1]:
                    seen = seen[:0]
                key_now = keys[-1]
                seen = np.union1d(seen, wins[keys[row] == key_now])
            at = np.flatnonzero(repeat)
            at = at[np.lexsort((first[at], ids[at]))]
            d, f, last = _spans(ids[at], first[at])
            yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(f, pa.int32()), pa.array(last, pa.int32())], names=["id", "first", "last"])

    dealt = rows.where("mask > 0").drop("last").repartition("key", "salt").sortWithinPartitions("key", "salt", "doc", "id", "first")
    return dealt.mapInArrow(run, "id long, first int, last int")


def repeated_spans(table: DataFrame, win: Windows = Windows()) -> DataFrame:
    """(id, first, last): spans of starts of windows that start earlier too, of rows (_text, _id, _doc).

    Earlier means a smaller _doc (NULL smallest), then a smaller _id, then an
    earlier word. Windows are known by two 64-bit hashes, of their anchor and of
    all their words.
    """
    letters = table.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    bits = min(win.most_bits, max(SLICE_BITS, int(letters // 8).bit_length()))
    spark = table.sparkSession
    sketch = spark.sparkContext.broadcast(_sketch(table, win, bits))
    rows = _candidates(table, win, sketch)  # read twice rather than written: hashing a text again costs less than a table of the size
    return rows.where("mask = 0").select("id", "first", "last").unionByName(_later(rows))


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", win: Windows = Windows()) -> DataFrame:
    """All rows of docs with ``n_words``, ``n_removed`` and ``kept_text``: words left when every window that also starts earlier is taken out.

    Windows are judged on the input. Removed words are those that such a window
    covers; the others are joined by one space. A text without a repeated window
    keeps all its words. NULL and blank texts have no words. Among repeated rows
    with equal ids one, the first written, counts as earlier. An empty table
    gives no rows; columns named like an output are replaced.
    """
    table = frozen(packed(docs).withColumn("_id", F.monotonically_increasing_id()))
    rows = table.select(text_of(F.col(f"_row.`{text_col}`")).alias("_text"), "_id", F.col(f"_row.`{id_col}`").cast("long").alias("_doc"))
    spans = repeated_spans(rows, win).groupBy("id").agg(F.collect_list(F.struct("first", "last")).alias("_spans"))
    met = table.join(spans, F.col("_id") == F.col("id"), "left").withColumn("_text", text_of(F.col(f"_row.`{text_col}`")))

    @F.pandas_udf("n_words long, n_removed long, kept_text string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        out = []
        for text, found in zip(texts, spans):
            words = text.encode().split()  # bytes split at just the separators between words
            gone = np.zeros(len(words) + 1, np.int32)
            for s in found if found is not None else ():
                gone[s["first"]] += 1
                gone[s["last"] + win.words] -= 1
            kept = np.cumsum(gone[:-1]) == 0
            out.append((len(words), int((~kept).sum()), b" ".join(w for w, k in zip(words, kept) if k).decode()))
        return pd.DataFrame(out, columns=["n_words", "n_removed", "kept_text"])

    done = met.withColumn("_cut", cut("_text", "_spans"))
    return unpacked(done, {n: F.col(f"_cut.{n}") for n in ("n_words", "n_removed", "kept_text")})
