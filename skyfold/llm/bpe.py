"""Byte-level BPE by dynamic programming over prefixes: every byte prefix of a piece has one valid last token."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Entries that a task keeps of pieces and of token pairs before it starts anew; bounds memory, not results.
MEMORY_ENTRIES = 700_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to ranks from a file of base64 tokens and decimal ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


class PrefixBpe:
    """Encodes and decodes by ranks.

    ``last`` of a byte string has, for each prefix, the last token of that
    prefix's encoding. A token may follow another if merging the two tokens'
    bytes by rank gives just the two again; of all tokens that end a prefix,
    exactly one may follow the last token of what comes before it. As a prefix's
    entry looks only at earlier entries, appended bytes leave them valid, and
    after an edit they agree with the old ones as soon as the longest token's
    length of consecutive entries does.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split = ranks, regex.compile(pattern)
        self.tokens = {r: t for t, r in ranks.items()}
        self.longest = max(map(len, ranks))
        self.step, self.ends = {}, [-1]  # tokens read from their last byte on: (node, byte) to node, and the token that a node spells
        for token, rank in ranks.items():
            node = 0
            for byte in reversed(token):
                key = node << 8 | byte
                if key not in self.step:
                    self.step[key] = len(self.ends)
                    self.ends.append(-1)
                node = self.step[key]
            self.ends[node] = rank
        self.edges: dict[int, tuple[list, list]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}

    # --- which tokens may stand side by side

    def _parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one, when its own bytes are merged by rank."""
        data = self.tokens[token]
        if len(data) < 2:
            return None
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 2:
            rank, at = min((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 60:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return self.ranks[parts[0]], self.ranks[parts[1]]

    def _edge(self, token: int) -> tuple[list, list]:
        """For the left and the right side: the tokens that stand at this border while the token grows, each with the rank at which it is merged away."""
        found = self.edges.get(token)
        if found is None:
            sides = []
            for side in (0, 1):
                line, t, until = [], token, 1 << 60
                while True:
                    line.append((t, until))
                    parts = self._parts(t)
                    if parts is None:
                        break
                    until, t = t, parts[side]
                sides.append(line)
            found = self.edges[token] = (sides[0], sides[1])
        return found

    def may_follow(self, left: int, right: int) -> bool:
        """No merge across the border comes before the merges that build the two tokens; of equal ranks the left one comes first."""
        key = (left, right)
        known = self.pairs.get(key)
        if known is None:
            known = True
            for a, a_until in self._edge(left)[1]:
                for b, b_until in self._edge(right)[0]:
                    across = self.ranks.get(self.tokens[a] + self.tokens[b])
                    if across is not None and across < a_until and across <= b_until:
                        known = False
                        break
                if not known:
                    break
            if len(self.pairs) > MEMORY_ENTRIES:
                self.pairs.clear()
            self.pairs[key] = known
        return known

    # --- prefixes of one piece

    def extend(self, data: bytes, last: list[int]) -> list[int]:
        """Adds the entries of ``data`` beyond those that ``last`` has already."""
        step, ends, pairs = self.step.get, self.ends, self.pairs.get
        for end in range(len(last), len(data)):
            node = 0
            for start in range(end, -1, -1):
                node = step(node << 8 | data[start])
                if node is None:
                    raise ValueError(f"no token of the vocabulary ends at byte {end}")
                token = ends[node]
                if token < 0:
                    continue
                if start:
                    pair = (last[start - 1], token)
                    known = pairs(pair)
                    if not (self.may_follow(*pair) if known is None else known):
                        continue
                last.append(token)
                break
            else:
                raise ValueError(f"no token of the vocabulary ends at byte {end}")
        return last

    def edited(self, old: bytes, last: list[int], start: int, end: int, new: bytes) -> tuple[bytes, list[int]]:
        """The bytes and entries after old[start:end] became ``new``: entries before it stay, later ones are taken over once they agree."""
        data = old[:start] + new + old[end:]
        fresh, shift, same = last[:start], len(new) - (end - start), 0
        while len(fresh) < len(data):
            self.extend(data[: len(fresh) + 1], fresh)
            at = len(fresh)  # prefix length; its twin in the old text is at - shift
            same = same + 1 if at > start + len(new) and last[at - shift - 1] == fresh[-1] else 0
            if same >= self.longest:
                fresh += last[at - shift :]
                break
        return data, fresh

    def tokens_of(self, data: bytes, last: list[int]) -> list[int]:
        out, end = [], len(data)
        while end:
            out.append(last[end - 1])
            end -= len(self.tokens[last[end - 1]])
        return out[::-1]

    # --- whole texts

    def piece(self, text: str) -> tuple[int, ...]:
        found = self.pieces.get(text)
        if found is None:
            data = text.encode()
            whole = self.ranks.get(data)
            found = (whole,) if whole is not None else tuple(self.tokens_of(data, self.extend(data, [])))
            if len(text) <= 64:
                if len(self.pieces) > MEMORY_ENTRIES:
                    self.pieces.clear()
                self.pieces[text] = found
        return found

    def encode(self, text: str) -> list[int]:
        known = self.pieces.get
        return list(chain.from_iterable([known(p) or self.piece(p) for p in self.split.findall(text)]))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def append(self, text: str, ids: list[int], more: str) -> list[int]:
        """encode(text + more): only the pieces that saw the end of ``text`` are read again."""
        start = len(text)
        for m in self.split.finditer(text, self._safe(text, len(text))):
            if m.end() >= len(text) or m.start() > len(text) - 3:
                start = m.start()
                break
        keep = len(ids) - len(self.encode(text[start:]))
        return ids[:keep] + self.encode(text[start:] + more)

    def edit(self, text: str, ids: list[int], start: int, end: int, new: str) -> tuple[str, list[int]]:
        """Text and ids after text[start:end] became ``new``; read again from a piece border before the edit to one after it that both texts share."""
        changed = text[:start] + new + text[end:]
        begin, shift = self._safe(text, start), len(new) - (end - start)
        borders, old = {}, begin
        n = 0  # tokens of the old text since begin
        olds = self.split.finditer(text, begin)
        middle: list[int] = []
        for m in self.split.finditer(changed, begin):
            if m.start() >= start + len(new):
                while old < m.start() - shift and (o := next(olds, None)):
                    borders[old] = n
                    n, old = n + len(self.piece(o.group())), o.end()
                borders[old] = n
                if m.start() - shift in borders:
                    head = len(ids) - self._count(text, begin)
                    return changed, ids[:head] + middle + ids[head + borders[m.start() - shift] :]
            middle += self.piece(m.group())
        head = len(ids) - self._count(text, begin)
        return changed, ids[:head] + middle

    def _count(self, text: str, begin: int) -> int:
        return sum(len(self.piece(m.group())) for m in self.split.finditer(text, begin))

    def _safe(self, text: str, at: int) -> int:
        """A piece border at or before ``at`` that no change from ``at`` on can move: a piece sees two characters beyond its end and three from its start."""
        safe = 0
        for m in self.split.finditer(text):
            if m.end() + 2 > at or m.start() + 3 > at:
                break
            safe = m.end()
        return safe


def _spread(spark: SparkSession, path: str, pattern: str):
    """The vocabulary file is read once by the driver; its size is that of the given file, under a megabyte for 50,000 tokens."""
    shared = spark.sparkContext.broadcast((read_ranks(path), pattern))
    made: list[PrefixBpe] = []

    def coder() -> PrefixBpe:
        if not made:
            made.append(PrefixBpe(*shared.value))
        return made[0]

    return coder


def _added(docs: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([f for f in docs.schema.fields if f.name.lower() != name.lower()] + [T.StructField(name, kind)])


def _with(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    keep = [i for i, n in enumerate(batch.schema.names) if n.lower() != name.lower()]
    return pa.RecordBatch.from_arrays([batch.column(i) for i in keep] + [values], names=[batch.schema.names[i] for i in keep] + [name])


def _ids(lists: list[list[int]]) -> pa.Array:
    offsets = [0]
    for x in lists:
        offsets.append(offsets[-1] + len(x))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(list(chain.from_iterable(lists)), pa.int32()))


def bpe_encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "ids", exact_col: str | None = None) -> DataFrame:
    """docs with the token ids of each whole text (NULL: as empty, no ids). A column of the ids' name is replaced.

    With ``exact_col`` each text's ids are decoded again beside it, and that column
    says whether they give the text's bytes. Rows are independent: no shuffle; a
    lost task encodes its rows anew.
    """
    coder = _spread(docs.sparkSession, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, token = coder().encode, coder().tokens.__getitem__
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = part.column(part.schema.get_field_index(text_col)).to_pylist()
                ids = [encode(t) if t else [] for t in texts]
                out = _with(part, ids_col, _ids(ids))
                if exact_col:
                    out = _with(out, exact_col, pa.array([b"".join(map(token, i)) == (t or "").encode() for t, i in zip(texts, ids)]))
                yield out

    kind = _added(docs, ids_col, T.ArrayType(T.IntegerType(), False))
    if exact_col:
        kind = T.StructType([f for f in kind.fields if f.name.lower() != exact_col.lower()] + [T.StructField(exact_col, T.BooleanType())])
    return docs.mapInArrow(run, kind)


def bpe_decode(rows: DataFrame, path: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """Rows with the bytes of their ids (NULL: no bytes). Bytes, as ids cut anywhere may end inside a character."""
    shared = rows.sparkSession.sparkContext.broadcast({rank: token for token, rank in read_ranks(path).items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = lambda ids, get=shared.value.__getitem__: b"".join(map(get, ids))
        for b in batches:
            ids = b.column(b.schema.get_field_index(ids_col))
            yield _with(b, bytes_col, pa.array([decode(x.values.to_numpy(zero_copy_only=False).tolist()) if x.is_valid else b"" for x in ids], pa.binary()))

    return rows.mapInArrow(run, _added(rows, bytes_col, T.BinaryType()))


def bpe_append(rows: DataFrame, path: str, pattern: str, more_col: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """Rows whose text is followed by ``more_col``, with the ids of the longer text; only its end is encoded again. NULL appends nothing."""
    coder = _spread(rows.sparkSession, path, pattern)
    schema = rows.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        append = coder().append
        for b in batches:
            get = {n: b.column(b.schema.get_field_index(n)).to_pylist() for n in (text_col, ids_col, more_col)}
            joined = [((t or "") + (m or ""), append(t or "", i or [], m or "")) for t, i, m in zip(get[text_col], get[ids_col], get[more_col])]
            new = {text_col: pa.array([t for t, _ in joined], pa.string()), ids_col: _ids([i for _, i in joined])}
            yield pa.RecordBatch.from_arrays([new.get(n, b.column(k)) for k, n in enumerate(b.schema.names)], names=b.schema.names)

    return rows.mapInArrow(run, schema)
