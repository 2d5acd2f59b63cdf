"""Personal data: fixed patterns, and a skip-chain random field that carries their labels to similar tokens."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyfold.llm.common import byte_batches

#: The kinds in their order, and their patterns.
KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HIT = re.compile(r"[0-9@]+")
_EDGE = " \t\n\x0b\x0c\r.,;:!?\"'()[]{}<>"
SHAPES = 1 << 16
#: Every table of counts is scaled to this total before it is smoothed, so that weights follow shares and not the size of the corpus.
COUNTS = 100
#: Bound of every log weight: of a pair, and of a token's shape against any label seen. A token that no pattern covers is not a proven
#: negative, so its shape weighs no more than this against it, and the labels of its repetitions can outweigh it at any size.
LIMIT = 6.0


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, read from each @: before it the longest run of local characters, after it the domain."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_SET:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the patterns' matches, by start and kind."""
    out = [(s, e, 0) for s, e in _emails(text)] if "@" in text else []
    out += [(m.start(), m.end(), 1) for m in _IP.finditer(text) if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m.group().split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = re.sub("[ -]", "", m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), 2))
    if "+" in text:
        out += [(m.start(), m.end(), 3) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2]))


@dataclass(frozen=True)
class Field:
    """``sure``: probability from which a token's label counts; ``rounds`` of messages; ``smoothing`` of every count, per COUNTS."""

    sure: float = 0.9
    rounds: int = 15
    smoothing: float = 1.0


@dataclass
class Weights:
    """Log weights of shapes (SHAPES x labels), of neighbours and of skip pairs (labels x labels); label 0 is none."""

    shape: np.ndarray = field(repr=False)
    chain: np.ndarray
    skip: np.ndarray


class Graph:
    """Tokens with a digit or @ of some texts, edges between neighbours, and skip edges between equal or similar tokens of one text.

    Similar: equal without case and border punctuation, or with the same last
    seven digits. Each token has a skip edge to the last such token before it, so
    there are no more edges than tokens.
    """

    def __init__(self, texts: list[str], spans: list[list[tuple[int, int, int]]]):
        self.text, self.start, self.end, self.shape, self.label = [], [], [], [], []
        self.chain, self.skip = [], []
        for i, (text, found) in enumerate(zip(texts, spans)):
            flat = text
            for c in "\t\n\x0b\x0c\r":
                flat = flat.replace(c, " ")
            last, span, reach = {}, 0, 0
            hit = _HIT.search(flat)
            before = -9
            while hit:
                s, e = flat.rfind(" ", 0, hit.start()) + 1, flat.find(" ", hit.start())
                e = len(flat) if e < 0 else e
                token, me = flat[s:e], len(self.start)
                # base spans are sorted by start; the first that overlaps gives the label
                while span < len(found) and found[span][1] <= s:
                    span += 1
                label = next((k + 1 for a, b, k in found[span : span + 4] if a < e and b > s), 0)
                self.text.append(i)
                self.start.append(s)
                self.end.append(e)
                self.label.append(label)
                self.shape.append(zlib.crc32(re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9]", "9", token)).encode()) % SHAPES)
                if s - before == 1:
                    self.chain.append((me - 1, me))
                before = e
                word, digits = token.strip(_EDGE).lower(), re.sub("[^0-9]", "", token)
                for key in {word, digits[-7:] if len(digits) >= 7 else word}:
                    if key in last:
                        self.skip.append((last[key], me))
                    if key:
                        last[key] = me
                hit = _HIT.search(flat, e)


def _learn(rows: DataFrame, model: Field) -> Weights:
    """Piecewise training: each factor's weights are logs of how often its labels occur together, by the base patterns, over all texts.

    A task leaves one sum for each shape and label, and for each pair of labels,
    so what is shuffled and collected is bounded by SHAPES times the labels.
    """
    n = len(KINDS) + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Counter = Counter()
        for b in batches:
            for part in byte_batches(b.column(0).to_pylist(), len):
                graph = Graph(part, [base_spans(t) for t in part])
                sums.update((0, s, k) for s, k in zip(graph.shape, graph.label))
                for what, edges in ((1, graph.chain), (2, graph.skip)):
                    sums.update((what, graph.label[a], graph.label[b]) for a, b in edges)
        if sums:
            keys = np.array(list(sums), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys[:, i], pa.int32()) for i in range(3)] + [pa.array(list(sums.values()), pa.int64())], names=["f", "a", "b", "n"])

    found = rows.mapInArrow(count, "f int, a int, b int, n long").groupBy("f", "a", "b").agg(F.sum("n").alias("n")).toPandas()
    shape, chain, skip = np.zeros((SHAPES, n)), np.zeros((n, n)), np.zeros((n, n))
    for table, f in ((shape, 0), (chain, 1), (skip, 2)):
        some = found[found["f"] == f]
        np.add.at(table, (some["a"].to_numpy(np.int64), some["b"].to_numpy(np.int64)), some["n"].to_numpy())
    return _weights(shape, chain, skip, model)


def _weights(shape: np.ndarray, chain: np.ndarray, skip: np.ndarray, model: Field) -> Weights:
    """Log weights from counts of shapes with labels and of pairs of labels; the same for any multiple of the counts."""
    n = len(KINDS) + 1
    prior = shape.sum(axis=0) / max(shape.sum(), 1)
    known = prior > 0
    share = shape * COUNTS / np.maximum(shape.sum(axis=1, keepdims=True), 1) + model.smoothing * prior
    logs = np.full(shape.shape, -30.0)  # a label that no pattern gave anywhere
    logs[:, known] = np.log(share[:, known])
    logs[:, 1:] = np.where(known[1:], np.maximum(logs[:, 1:], logs[:, :1] - LIMIT), logs[:, 1:])

    def gain(t: np.ndarray) -> np.ndarray:
        """How much more often two labels stand together than by chance; both orders count alike."""
        t = t + t.T
        t = t * COUNTS / max(t.sum(), 1) + model.smoothing * np.outer(prior, prior) * n
        p = t / max(t.sum(), 1e-300)
        chance = np.outer(p.sum(axis=0), p.sum(axis=1))
        return np.clip(np.log(np.divide(p, chance, out=np.ones_like(p), where=chance > 0)), -LIMIT, LIMIT)

    return Weights(logs, gain(chain), gain(skip))


def marginals(graph: Graph, weights: Weights, rounds: int) -> np.ndarray:
    """Label probabilities of each token after some rounds of loopy messages; tokens inside base spans keep their label."""
    label = np.array(graph.label, np.int64)
    own = weights.shape[np.array(graph.shape, np.int64)]
    own[label > 0] = -30.0
    own[label > 0, label[label > 0]] = 0.0
    edges = np.array(graph.chain + graph.skip, np.int64).reshape(-1, 2)
    pair = np.concatenate([np.repeat(weights.chain[None], len(graph.chain), 0), np.repeat(weights.skip[None], len(graph.skip), 0)])
    frm, to = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
    pair = np.concatenate([pair, pair])  # symmetric
    half = len(edges)
    sent = np.zeros((2 * half, own.shape[1]))
    belief = own.copy()
    for _ in range(rounds if half else 0):
        back = np.concatenate([sent[half:], sent[:half]])
        x = (belief[frm] - back)[:, :, None] + pair
        top = x.max(axis=1)
        new = top + np.log(np.exp(x - top[:, None, :]).sum(axis=1))
        new -= new.max(axis=1, keepdims=True)
        sent = 0.5 * sent + 0.5 * new
        belief = own.copy()
        np.add.at(belief, to, sent)
    p = np.exp(belief - belief.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def _added(graph: Graph, texts: list[str], found: list, weights: Weights, model: Field) -> list[list[tuple[int, int, int]]]:
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not graph.start:
        return out
    p = marginals(graph, weights, model.rounds)
    best = p.argmax(axis=1)
    chosen = np.flatnonzero((best > 0) & (p.max(axis=1) >= model.sure) & (np.array(graph.label) == 0))
    for v in chosen.tolist():
        i, s, e = graph.text[v], graph.start[v], graph.end[v]
        token = texts[i][s:e]
        s, e = s + len(token) - len(token.lstrip(_EDGE)), e - len(token) + len(token.rstrip(_EDGE))
        if s >= e:
            continue
        k, line = int(best[v]) - 1, out[i]
        if line and line[-1][2] == k and texts[i][line[-1][1] : s].strip(_EDGE) == "" and _follows(graph, v) and texts[i][line[-1][0] : line[-1][1]] != texts[i][s:e]:
            line[-1] = (line[-1][0], e, k)
        else:
            line.append((s, e, k))
    return out


def _follows(graph: Graph, v: int) -> bool:
    """Token v stands one separator after the token before it."""
    return v > 0 and graph.text[v - 1] == graph.text[v] and graph.start[v] - graph.end[v - 1] == 1


def find_personal_data(docs: DataFrame, text_col: str = "text", model: Field = Field()) -> DataFrame:
    """docs with ``spans``: array of (start, end, kind, base), in code points, end exclusive, by start and kind.

    Base spans are the patterns' own. The field adds spans of tokens outside
    them: its potentials are learnt from the base labels of all texts (what
    shapes they have, what stands beside, which labels equal or similar tokens
    share), and messages run until distant repetitions agree. NULL and empty
    texts have no spans. Without any base span nothing is added. A column named
    ``spans`` is replaced. Rows are independent once the weights are known.
    """
    name = text_col
    texts = docs.select(F.coalesce(F.col(f"`{name}`"), F.lit("")).alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(_learn(texts, model))
    out = type(docs.schema)([f for f in docs.schema.fields if f.name.lower() != "spans"]).add("spans", T.ArrayType(T.StructType().add("start", "integer").add("end", "integer").add("kind", "string").add("base", "boolean")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        for b in batches:
            texts = [t or "" for t in b.column(b.schema.get_field_index(name)).to_pylist()]
            rows = []
            for part in byte_batches(texts, len):
                found = [base_spans(t) for t in part]
                graph = Graph(part, found)
                for base, more in zip(found, _added(graph, part, found, weights, model)):
                    rows.append(sorted([(s, e, k, True) for s, e, k in base] + [(s, e, k, False) for s, e, k in more], key=lambda x: (x[0], x[2])))
            flat = [x for r in rows for x in r]
            struct = pa.StructArray.from_arrays([pa.array([x[0] for x in flat], pa.int32()), pa.array([x[1] for x in flat], pa.int32()), pa.array([KINDS[x[2]] for x in flat], pa.string()), pa.array([x[3] for x in flat], pa.bool_())], names=["start", "end", "kind", "base"])
            spans = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(r) for r in rows])]), pa.int32()), struct)
            keep = [i for i, n in enumerate(b.schema.names) if n.lower() != "spans"]
            yield pa.RecordBatch.from_arrays([b.column(i) for i in keep] + [spans], names=[b.schema.names[i] for i in keep] + ["spans"])

    return docs.mapInArrow(run, out)
