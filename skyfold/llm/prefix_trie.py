"""The prefix trie of conversations by splitters and a skeleton.

A turn becomes a token of 16 bytes (of SHA-256 over role and text), so a
conversation is a path of tokens and the bytes' order is an order of the trie.
Paths are dealt by range; copies of one path are told apart by their id, so a
large group of copies lies in many shards. Only nodes on the path of a splitter
can have members in more than one shard: these nodes, the skeleton, are known to
every shard from two numbers, the depths it shares with its neighbours. A shard
finishes all its other nodes alone, in one pass over its sorted paths; of
skeleton nodes it gives partial aggregates, which are reduced by node and then
summed along the skeleton in preorder. Paths are cut into segments, so one
conversation may be of any length: a segment's trie hangs below the node at which
the segment before it ends.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyfold.llm.common import frozen, prefix_sums, text_of

TOKEN = 16
NO_ENDS = hashlib.sha256(b"").hexdigest()

_NODES = (
    "depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, "
    "_rep long, _size long, _key binary, _pkey binary, _ends string, _part int"
)
_NAMES = [f.split()[0] for f in _NODES.split(", ")]
_TYPES = dict(long=pa.int64(), int=pa.int32(), string=pa.string(), binary=pa.binary())
_ARROW = pa.schema([(f.split()[0], _TYPES[f.split()[1]]) for f in _NODES.split(", ")])


# --- inside one shard ------------------------------------------------------------------------------------


def shared_depth(a: bytes, b: bytes) -> int:
    """The number of leading tokens that two paths have in common."""
    most = min(len(a), len(b))
    if a[:most] == b[:most]:
        return most // TOKEN
    at = 0
    while a[at : at + TOKEN] == b[at : at + TOKEN]:
        at += TOKEN
    return at // TOKEN


class _Node:
    __slots__ = ("children", "ends", "first", "kids", "least", "leaves", "more", "n", "rep", "saved", "size")

    def __init__(self, first: bool, size: int):
        self.first, self.size = first, size
        self.n = self.children = self.leaves = self.saved = 0
        self.least = self.rep = None
        self.more = False
        self.ends: list[str] = []
        self.kids: list[int] = []


class ShardTrie:
    """The nodes of one shard's sorted paths; ``left`` and ``right`` are the depths shared with the neighbour shards."""

    def __init__(self, part: int, left: int, right: int):
        self.part, self.left, self.right = part, left, right
        self.out: dict[str, list] = {name: [] for name in _NAMES}
        self.open: list[_Node] = []
        self.path = b""

    def _emit(self, **values) -> int:
        for name in _NAMES:
            self.out[name].append(values.get(name))
        return len(self.out["depth"]) - 1

    def _close(self, at_end: bool) -> None:
        depth = len(self.open) - 1
        node = self.open.pop()
        parent = self.open[-1] if self.open else None
        spans = (node.first and depth <= self.left) or (at_end and depth <= self.right)
        joined = ",".join(node.ends)
        if spans:
            key = hashlib.sha256(self.path[: depth * TOKEN]).digest()[:TOKEN]
            above = hashlib.sha256(self.path[: (depth - 1) * TOKEN]).digest()[:TOKEN] if depth else None
            self._emit(depth=depth, conv_id=node.least, n_convs=node.n, n_children=node.children, n_leaves=node.leaves, saved_tokens=node.saved, _rep=node.rep, _size=node.size, _key=key, _pkey=above, _ends=joined, _part=self.part)
            for kid in node.kids:
                self.out["_pkey"][kid] = key
        else:
            node.saved += (node.n - 1) * node.size
            if not (node.children or node.more):
                node.leaves += 1
            digest = hashlib.sha256(joined.encode()).hexdigest() if joined else NO_ENDS
            row = self._emit(depth=depth, conv_id=node.least, n_convs=node.n, n_children=node.children, n_leaves=node.leaves, saved_tokens=node.saved, ends_sha256=digest, _rep=node.rep, _size=node.size)
            for kid in node.kids:
                self.out["parent_conv_id"][kid] = node.least
            if parent:
                parent.kids.append(row)
                parent.children += 1
        if parent:
            parent.n += node.n
            parent.least = node.least if parent.least is None else min(parent.least, node.least)
            parent.leaves += node.leaves
            parent.saved += node.saved

    def add(self, conv_id: int, path: bytes, sizes: list[int], ends: bool, below: tuple | None) -> None:
        """The next path; ``below``: children, leaves and saved bytes that hang below its end, given once for each end node."""
        first = not self.open
        if first:
            self.open.append(_Node(True, 0))
        else:
            keep = shared_depth(path, self.path)
            while len(self.open) > keep + 1:
                self._close(False)
        for depth in range(len(self.open), len(sizes) + 1):
            self.open.append(_Node(first, sizes[depth - 1]))
        self.path = path
        node = self.open[-1]
        node.n += 1
        node.least = conv_id if node.least is None else min(node.least, conv_id)
        if ends:
            node.ends.append(str(conv_id))
        else:
            node.more = True
        if below:
            node.rep = conv_id
            node.children += below[0]
            node.leaves += below[1]
            node.saved += below[2]

    def close(self) -> pa.Table:
        while self.open:
            self._close(True)
        return pa.Table.from_pydict(self.out, schema=_ARROW)


# --- shards and skeleton ---------------------------------------------------------------------------------


def _depths_at_borders(dealt: DataFrame) -> dict[int, tuple[int, int]]:
    """For each shard the depths that it shares with the shard before and after it: the splitters' trie, one row a shard."""
    edges = dealt.groupBy("_part").agg(F.min("path").alias("first"), F.max("path").alias("last"))
    before = edges.select("_part", "first", F.lag("last").over(Window.orderBy("_part")).alias("before"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("before").to_pylist(), batch.column("first").to_pylist(), strict=True)
            yield pa.record_batch([batch.column("_part"), pa.array([-1 if a is None else shared_depth(a, b) for a, b in pairs], pa.int32())], ["_part", "d"])

    depths = sorted(tuple(r) for r in before.mapInArrow(measure, "_part int, d int").collect())
    after = [d for _, d in depths[1:]] + [-1] * bool(depths)
    return {part: (left, right) for (part, left), right in zip(depths, after, strict=True)}


def _joined_ends(partial: DataFrame) -> DataFrame:
    """SHA-256 of each skeleton node's ends: the shards' lists follow each other, read as a stream."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        done: list[tuple[bytes, str]] = []
        for batch in batches:
            for k, ends in zip(batch.column("_key").to_pylist(), batch.column("_ends").to_pylist(), strict=True):
                if k != key:
                    if state:
                        done.append((key, state.hexdigest()))
                    key, state = k, hashlib.sha256(ends.encode())
                else:
                    state.update(b"," + ends.encode())
        if state:
            done.append((key, state.hexdigest()))
        yield pa.record_batch([pa.array([k for k, _ in done], pa.binary()), pa.array([d for _, d in done], pa.string())], ["_ekey", "ends"])

    lists = partial.where(F.length("_ends") > 0).select("_key", "_part", "_ends")
    return lists.repartition("_key").sortWithinPartitions("_key", "_part").mapInArrow(digest, "_ekey binary, ends string")


def _skeleton(partial: DataFrame, parts: int) -> DataFrame:
    """Skeleton nodes from the shards' partial aggregates."""
    spark = partial.sparkSession
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    extras = [F.min("_rep").alias("_rep"), F.max("_size").alias("_size"), F.min("_pkey").alias("_pkey"), F.min("_part").alias("_lo"), F.max("_part").alias("_hi")]
    nodes = frozen(partial.groupBy("depth", "_key").agg(F.min("conv_id").alias("conv_id"), *sums, *extras))
    below = nodes.where("depth > 0").groupBy(F.col("_pkey").alias("_ckey")).agg(F.count("*").alias("_below"))
    nodes = nodes.join(below, F.col("_key") == F.col("_ckey"), "left").withColumn("n_children", F.col("n_children") + F.coalesce("_below", F.lit(0)))
    own = nodes.withColumn("_saved", (F.col("n_convs") - 1) * F.col("_size")).withColumn("_leaf", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long"))
    own = frozen(own.drop("_ckey", "_below"))
    # preorder is (first shard, depth): a node's subtree is the rest of its own first shard and all first shards up to its last border
    per_part = own.groupBy(F.col("_lo").alias("_p")).agg(F.sum("_saved").alias("_s"), F.sum("_leaf").alias("_l"))
    every = spark.range(parts).select(F.col("id").cast("int").alias("_at")).join(per_part, F.col("_at") == F.col("_p"), "left")
    upto = Window.orderBy("_at")
    running = frozen(every.select("_at", F.coalesce(F.sum("_s").over(upto), F.lit(0)).alias("_s"), F.coalesce(F.sum("_l").over(upto), F.lit(0)).alias("_l")))
    lo = running.select(F.col("_at").alias("_lat"), F.col("_s").alias("_ls"), F.col("_l").alias("_ll"))
    hi = running.select(F.col("_at").alias("_hat"), F.col("_s").alias("_hs"), F.col("_l").alias("_hl"))
    rest = Window.partitionBy("_lo").orderBy(F.desc("depth"))
    whole = own.withColumn("_rs", F.sum("_saved").over(rest)).withColumn("_rl", F.sum("_leaf").over(rest))
    whole = whole.join(lo, F.col("_lo") == F.col("_lat")).join(hi, F.col("_hi") - 1 == F.col("_hat"))
    whole = whole.withColumn("saved_tokens", F.col("saved_tokens") + F.col("_rs") + F.col("_hs") - F.col("_ls"))
    whole = whole.withColumn("n_leaves", F.col("n_leaves") + F.col("_rl") + F.col("_hl") - F.col("_ll"))
    above = own.select(F.col("_key").alias("_akey"), F.col("conv_id").alias("parent_conv_id"))
    ends = _joined_ends(partial)
    whole = whole.join(above, F.col("_pkey") == F.col("_akey"), "left").join(ends, F.col("_key") == F.col("_ekey"), "left")
    return whole.withColumn("ends_sha256", F.coalesce("ends", F.lit(NO_ENDS)))


_RESULT = ["depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "_rep"]


def _trie(paths: DataFrame, shard_turns: int) -> DataFrame:
    """The nodes of (conv_id, path, sizes, ends, below) rows, with the depth inside these paths."""
    spark = paths.sparkSession
    paths = frozen(paths)
    turns = paths.agg(F.sum(F.size("sizes") + 1)).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), turns // shard_turns + 1)
    dealt = frozen(paths.repartitionByRange(parts, "path", "conv_id").withColumn("_part", F.spark_partition_id()))
    depths = _depths_at_borders(dealt)

    def finish(key: tuple, shard: pa.Table) -> pa.Table:
        part = key[0].as_py()
        trie = ShardTrie(part, *depths[part])
        for batch in shard.sort_by([("path", "ascending"), ("conv_id", "ascending")]).to_batches(max_chunksize=4096):
            below = batch.column("below").to_pylist()
            for conv, path, sizes, ends, b in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "path", "sizes", "ends")], below, strict=True):
                trie.add(conv, path, sizes, ends, b and (b["children"], b["leaves"], b["saved"]))
        return trie.close()

    found = frozen(dealt.groupBy("_part").applyInArrow(finish, _NODES))
    skeleton = frozen(_skeleton(found.where("_key is not null"), max(depths, default=0) + 1).select(*_RESULT, "_key"))
    local = found.where("_key is null")
    above = skeleton.select(F.col("_key").alias("_akey"), F.col("conv_id").alias("_above"))
    tops = local.where("_pkey is not null").join(above, F.col("_pkey") == F.col("_akey")).withColumn("parent_conv_id", F.col("_above"))
    return local.where("_pkey is null").select(*_RESULT).unionByName(tops.select(*_RESULT)).unionByName(skeleton.select(*_RESULT))


# --- conversations ---------------------------------------------------------------------------------------


def turn_token(role: str | Column, text: str | Column) -> Column:
    """16 bytes that stand for a turn; NULL role or text is empty."""
    role, text = text_of(role), text_of(text)
    return F.substring(F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)), 1, TOKEN)


def ranked_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, rank, token, size): turns numbered from 0 in their conversation by turn, NULL first, then by token; rows without conv_id are left out."""
    rows = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", turn_token("role", "text").alias("token"), F.octet_length(text_of("text")).cast("long").alias("size")
    )
    return prefix_sums(rows, ["turn", "token"], "size", ["conv_id"]).select("conv_id", "rank", "token", "size")


def grafted_turns(ranked: DataFrame, origin: Column, head: Column, longest: int) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first ``head`` turns are replaced by those of conversation ``origin``.

    ``head`` (0 to ``longest``) and ``origin`` are expressions of conv_id. Returns
    (conv_id, depth, token, size) with depth from 1 without gaps, and one row
    (conv_id) for each conversation, as some may have no turn left.
    """
    convs = ranked.select("conv_id").distinct().select("conv_id", origin.alias("_origin"), head.cast("int").alias("_head"))
    firsts = ranked.where(F.col("rank") < longest).groupBy(F.col("conv_id").alias("_oid")).agg(F.sort_array(F.collect_list(F.struct("rank", "token", "size"))).alias("_first"))
    plans = frozen(convs.join(firsts, F.col("_origin") == F.col("_oid"), "left").select("conv_id", "_head", F.expr("slice(coalesce(_first, array()), 1, _head)").alias("_first")))
    taken = plans.select("conv_id", F.posexplode("_first").alias("_at", "_t")).select("conv_id", (F.col("_at") + 1).cast("long").alias("depth"), "_t.token", "_t.size")
    shifts = plans.select(F.col("conv_id").alias("_cid"), "_head", F.size("_first").alias("_have"))
    rest = ranked.join(shifts, F.col("conv_id") == F.col("_cid")).where(F.col("rank") >= F.col("_head"))
    rest = rest.select("conv_id", (F.col("rank") - F.col("_head") + F.col("_have") + 1).cast("long").alias("depth"), "token", "size")
    return taken.unionByName(rest), plans.select("conv_id")


def prefix_trie(turns: DataFrame, convs: DataFrame, segment: int = 4096, shard_turns: int = 1 << 20) -> DataFrame:
    """One row for each distinct sequence of first turns; jobs run here.

    ``turns``: (conv_id, depth from 1 without gaps, token, size); ``convs``: the
    conv_id of every conversation, turnless ones included. Returns per node, the
    root (depth 0) included: conv_id (least member), depth, parent_conv_id (NULL
    at the root), n_convs, n_children, n_leaves, saved_tokens (over the subtree,
    the top included, (members - 1) times the last turn's size) and ends_sha256
    (of the decimal ids of the conversations that end here, ascending, joined by
    commas). No conversations, no rows. Equal turns are the same node whatever
    their row; a conversation must not have two turns of one depth. A task holds
    one shard of about ``shard_turns`` turns, or one segment of a path.
    """
    cut = turns.select("conv_id", ((F.col("depth") - 1) / segment).cast("long").alias("seg"), F.struct("depth", F.hex("token").alias("token"), "size").alias("t"))
    listed = cut.groupBy("conv_id", "seg").agg(F.sort_array(F.collect_list("t")).alias("t"))
    pieces = frozen(listed.select("conv_id", "seg", F.unhex(F.array_join("t.token", "")).alias("path"), F.col("t.size").alias("sizes")))
    levels = (pieces.agg(F.max("seg")).first()[0] or 0) + 1
    # rows of a level: conversations that reach it, with the digest of all that lies above
    rows = [convs.join(pieces.where("seg = 0").drop("seg"), "conv_id", "left").select("conv_id", F.coalesce("path", F.unhex(F.lit(""))).alias("path"), F.coalesce("sizes", F.expr("cast(array() as array<long>)")).alias("sizes"))]
    if levels > 1:
        lasts = frozen(pieces.groupBy("conv_id").agg(F.max("seg").alias("_last")))
        above = pieces.where("seg = 0").select("conv_id", F.sha2("path", 256).alias("_digest"))
        for level in range(1, levels):
            here = pieces.where(F.col("seg") == level).join(above, "conv_id")
            here = frozen(here.select("conv_id", F.concat(F.substring(F.unhex("_digest"), 1, TOKEN), F.col("path")).alias("path"), F.concat(F.expr("array(0L)"), F.col("sizes")).alias("sizes")))
            rows.append(here)
            above = here.select("conv_id", F.sha2("path", 256).alias("_digest"))
    nothing = F.lit(None).cast("struct<children:long,leaves:long,saved:long>")
    result, below, tops = None, None, None
    for level in reversed(range(levels)):
        here = rows[level]
        if levels > 1:
            here = here.join(lasts, "conv_id", "left").withColumn("ends", F.coalesce(F.col("_last") <= level, F.lit(True))).drop("_last")
        else:
            here = here.withColumn("ends", F.lit(True))
        here = here.join(below, "conv_id", "left") if below is not None else here.withColumn("below", nothing)
        found = _trie(here.select("conv_id", "path", "sizes", "ends", "below"), shard_turns)
        if levels > 1:
            found = frozen(found)
        if tops is not None:
            ups = found.where("_rep is not null").select(F.col("_rep").alias("_up"), F.col("conv_id").alias("_least"))
            fixed = tops.join(ups, F.col("parent_conv_id") == F.col("_up")).withColumn("parent_conv_id", F.col("_least")).drop("_up", "_least")
            result = result.unionByName(fixed)
        if level:
            below = found.where("depth = 1").select("conv_id", F.struct(F.col("n_children").alias("children"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved")).alias("below"))
            real = found.where("depth > 1").withColumn("depth", F.col("depth") - 1 + level * segment)
            tops = real.where(F.col("depth") == level * segment + 1)
            inner = real.where(F.col("depth") > level * segment + 1)
        else:
            inner = found
        result = inner if result is None else result.unionByName(inner)
    return result.drop("_rep")
