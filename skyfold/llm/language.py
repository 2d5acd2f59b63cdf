"""Language identification by unigram pieces, summed over all segmentations of each word."""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyfold.llm.common import byte_batches, frozen

#: Words whose scores a task keeps before it starts anew; bounds memory, not results.
MEMORY_WORDS = 1_000_000
_WORD = regex.compile(r"\p{L}+")


def read_pieces(path: str, longest: int) -> dict[bytes, int]:
    """Pieces of a public byte vocabulary up to ``longest`` bytes, all 256 bytes among them, to dense numbers."""
    with open(path, "rb") as lines:
        found = [base64.b64decode(x.split()[0]) for x in lines if x.strip()]
    return {p: i for i, p in enumerate(p for p in found if len(p) <= longest)}


@dataclass(frozen=True)
class Training:
    """``rounds`` of expected counts (the first from uniform pieces); ``smoothing`` is added to every count.

    Each language is fitted to its ``language_rows`` distinct texts of smallest
    hash, or to all if it has fewer, whatever its share of the rows; the bound
    keeps training at a fixed cost.
    """

    longest: int = 12
    rounds: int = 2
    smoothing: float = 0.5
    max_languages: int = 500
    language_rows: int = 2_000


@dataclass
class Model:
    """Log probabilities of each piece in each language: a table whose size is that of the vocabulary times the languages."""

    languages: list[str]
    pieces: dict[bytes, int]
    longest: int
    logs: np.ndarray = field(repr=False)  # languages x pieces

    def __post_init__(self):
        """A trie of the pieces as sorted keys (node, byte), so that all positions of many words walk it together."""
        keys, ends = {}, [-1]
        for piece, number in self.pieces.items():
            node = 0
            for byte in piece:
                key = node << 8 | byte
                if key not in keys:
                    keys[key] = len(ends)
                    ends.append(-1)
                node = keys[key]
            ends[node] = number
        self.steps = np.array(sorted(keys), np.int64)
        self.nodes = np.array([keys[k] for k in self.steps.tolist()], np.int64)
        self.ends = np.array(ends, np.int64)

    def edges(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Every piece inside every word: flat positions (a word of n bytes has n+1) of start and end, piece, and the words' first positions."""
        first = np.concatenate([[0], np.cumsum([len(w) + 1 for w in words])]).astype(np.int64)
        flat = np.frombuffer(b"\0".join(words) + b"\0", np.uint8).astype(np.int64)
        flat[first[1:] - 1] = 1 << 40  # no piece goes beyond a word
        at = np.flatnonzero(flat < 256)
        node = np.zeros(len(at), np.int64)
        start, end, piece = [], [], []
        for n in range(self.longest):
            key = node << 8 | flat[at + n]
            k = np.minimum(np.searchsorted(self.steps, key), len(self.steps) - 1)
            on = self.steps[k] == key
            at, node = at[on], self.nodes[k[on]]
            if not len(at):
                break
            p = self.ends[node]
            hit = p >= 0
            start.append(at[hit])
            end.append(at[hit] + n + 1)
            piece.append(p[hit])
        return np.concatenate(start), np.concatenate(end), np.concatenate(piece), first

    def _sweep(self, frm, to, piece, first, begins, depth) -> np.ndarray:
        """Log sums over all ways from a border to each position; positions of equal ``depth`` are ready together."""
        sums = np.full((first[-1], len(self.logs)), -np.inf)
        sums[begins] = 0.0
        order = np.argsort(depth * first[-1] + to)
        frm, to, weight, depth = frm[order], to[order], self.logs.T[piece[order]], depth[order]
        cuts = np.flatnonzero(np.diff(depth, prepend=-1))
        for a, b in zip(cuts, [*cuts[1:], len(to)]):
            x = sums[frm[a:b]] + weight[a:b]
            runs = np.flatnonzero(np.diff(to[a:b], prepend=-1))
            top = np.maximum.reduceat(x, runs, axis=0)
            counts = np.diff(np.append(runs, b - a))
            sums[to[a:b][runs]] = top + np.log(np.add.reduceat(np.exp(x - np.repeat(top, counts, axis=0)), runs, axis=0))
        return sums

    def scores(self, words: list[bytes]) -> np.ndarray:
        """Log probability of each word in each language, over all its segmentations."""
        start, end, piece, first = self.edges(words)
        depth = end - first[np.searchsorted(first, end, side="right") - 1]
        return self._sweep(start, end, piece, first, first[:-1], depth)[first[1:] - 1]

    def expected(self, words: list[bytes], counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece (languages x pieces) by words that occur ``counts`` times (words x languages)."""
        start, end, piece, first = self.edges(words)
        word = np.searchsorted(first, end, side="right") - 1
        ahead = self._sweep(start, end, piece, first, first[:-1], end - first[word])
        lasts = first[1:] - 1
        back = self._sweep(end, start, piece, first, lasts, lasts[word] - start)
        share = np.exp(ahead[start] + self.logs[:, piece].T + back[end] - ahead[lasts][word]) * counts[word]
        return np.stack([np.bincount(piece, share[:, k], len(self.pieces)) for k in range(len(self.languages))])


def _words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _sampled(rows: DataFrame, training: Training) -> tuple[list[str], DataFrame]:
    """The languages of rows (lang, text), and of each its ``language_rows`` distinct texts of smallest hash.

    A sketch of each language's distinct texts gives a hash below which about
    twice as many lie; the exact border is then found among those alone. A task
    keeps one row for each text, so copies meet before they are dealt.
    """
    rows = rows.withColumn("hash", F.xxhash64("lang", "text"))
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct("hash", 0.02).alias("n")).limit(training.max_languages + 1).collect()
    if len(sizes) > training.max_languages:
        raise ValueError(f"more than max_languages = {training.max_languages} languages")

    def below(borders: dict[str, int]) -> DataFrame:
        return rows.where(F.col("hash") <= F.create_map(*[F.lit(x) for pair in borders.items() for x in pair])[F.col("lang")])

    if not sizes:
        return [], rows
    share = {r["lang"]: min(1.0, 2 * training.language_rows / max(1, r["n"])) for r in sizes}
    some = below({k: min((1 << 63) - 1, int(v * (1 << 64)) - (1 << 63)) for k, v in share.items()}).select("lang", "hash").distinct()
    ranked = F.array_sort(F.collect_list("hash"))
    last = some.groupBy("lang").agg(F.element_at(F.slice(ranked, 1, training.language_rows), -1).alias("hash")).collect()
    borders = {r["lang"]: r["hash"] for r in last}
    return sorted(borders), below(borders).groupBy("lang", "hash").agg(F.min("text").alias("text")).select("lang", "text")


def train(labelled: DataFrame, vocabulary: str, text_col: str = "text", lang_col: str = "lang", training: Training = Training()) -> Model:
    """Piece probabilities of each language from a bounded sample of its labelled rows (rows without a letter or language teach nothing).

    Each task sums expected piece counts per language over its words; only these
    sums, one number for each language and piece of the vocabulary, are shuffled
    and reach the driver. More than ``max_languages`` languages raise an error, as
    that bounds the model.
    """
    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    names, rows = _sampled(rows, training)
    # the rows are read once for each round; what is written is bounded
    rows = frozen(rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))) if names else rows
    pieces = read_pieces(vocabulary, training.longest)
    model = Model(names, pieces, training.longest, np.full((len(names), len(pieces)), -np.log(len(pieces))))
    number = {n: i for i, n in enumerate(names)}
    for _ in range(training.rounds if names else 0):
        shared = rows.sparkSession.sparkContext.broadcast(model)

        def count(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            now, total = shared.value, None
            for b in batches:
                for part in byte_batches(zip(b.column(0).to_pylist(), b.column(1).to_pylist()), lambda r: len(r[1]), 8 << 20):
                    seen: dict[str, np.ndarray] = {}
                    for lang, text in part:
                        for w, n in Counter(_words(text)).items():
                            if w not in seen:
                                seen[w] = np.zeros(len(names))
                            seen[w][number[lang]] += n
                    for some in byte_batches(seen, len, 1 << 18):
                        sums = now.expected([w.encode() for w in some], np.array([seen[w] for w in some]))
                        total = sums if total is None else total + sums
            if total is not None:
                lang, piece = np.nonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(lang.astype(np.int32)), pa.array(piece.astype(np.int32)), pa.array(total[lang, piece])], names=["lang", "piece", "n"])

        found = rows.mapInArrow(count, "lang int, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
        counts = np.full((len(names), len(pieces)), training.smoothing)
        # sums of floats differ in their last digits with the order of the tasks; rounded, reruns agree
        counts[found["lang"], found["piece"]] += found["n"].round(3)
        model = Model(names, pieces, training.longest, np.log(counts / counts.sum(axis=1, keepdims=True)))
        shared.unpersist()
    return model


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with ``lang_pred`` and ``score``, the language's share (0 to 1) of the probability of the whole text.

    A NULL text, one without a letter, or any text under a model without
    languages gives ``und`` and score 0. Ties go to the first language in code
    point order. Columns with these names are replaced. Only the text is read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = [f for f in docs.schema.fields if f.name.lower() not in ("lang_pred", "score")]
    out = type(docs.schema)(schema).add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, number, rows = shared.value, {}, []
        k = len(now.languages)
        for b in batches:
            texts = b.column(b.schema.get_field_index(text_col)).to_pylist()
            names, scores = [], []
            for part in byte_batches(texts, lambda t: len(t or ""), 8 << 20):
                if len(number) > MEMORY_WORDS:
                    number, rows = {}, []
                words = [_words(t) if t and k else [] for t in part]
                new = list({w: None for ws in words for w in ws if w not in number})
                for some in byte_batches(new, len, 1 << 18):
                    number.update(zip(some, range(len(number), len(number) + len(some))))
                    rows.append(now.scores([w.encode() for w in some]))
                table = np.concatenate(rows) if rows else np.empty((0, k))
                rows = [table] if rows else []
                for ws in words:
                    if not ws:
                        names.append("und")
                        scores.append(0.0)
                        continue
                    logs = table[np.fromiter(map(number.__getitem__, ws), np.int64, len(ws))].sum(axis=0)
                    best = int(np.argmax(logs))
                    names.append(now.languages[best])
                    scores.append(float(1 / np.exp(logs - logs[best]).sum()))
            keep = [i for i, n in enumerate(b.schema.names) if n.lower() not in ("lang_pred", "score")]
            yield pa.RecordBatch.from_arrays([b.column(i) for i in keep] + [pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[b.schema.names[i] for i in keep] + ["lang_pred", "score"])

    return docs.mapInArrow(run, out)


def fold(id_col: str = "doc_id", of: int = 4) -> Column:
    """crc32 of an id's decimal text modulo ``of``; NULL ids count as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % of
