"""The prefix trie against a plain dictionary of prefixes."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from skyfold.llm import prefix_trie as pt
from skyfold.llm import queries

SF = "/root/testdata/sf0.001"


def rebuilt(rows):
    """(conv_id, turn, role, text) rows to {conv_id: [(role, text), ...]} after the grafts of the query."""
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    token = lambda r, t: hashlib.sha256(f"{len(r.encode())}:{r}{t}".encode()).digest()[:16]
    convs = {c: [(r, t) for _, _, _, r, t in sorted((a, b, token(r, t), r, t) for a, b, r, t in v)] for c, v in convs.items()}
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        origin = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        out[c] = convs.get(origin, [])[:h] + own[h:]
    return out


def plain(convs):
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    own = {p: (len(m) - 1) * (len(p[-1][1].encode()) if p else 0) for p, m in nodes.items()}
    children = {p: 0 for p in nodes}
    for p in nodes:
        if p:
            children[p[:-1]] += 1
    leaves, saved = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for p in nodes:
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += own[p]
    found = []
    for p, m in nodes.items():
        ends = ",".join(str(c) for c in sorted(m) if len(convs[c]) == len(p))
        parent = min(nodes[p[:-1]]) if p else None
        found.append((len(p), min(m), parent, len(m), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(found, key=str)


COLUMNS = ["depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def collected(df):
    return sorted((tuple(r) for r in df.select(COLUMNS).collect()), key=str)


def test_query_equals_plain(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert collected(queries.QUERIES["op13_conversation_trie"](spark, SF)) == plain(rebuilt(rows))


def many(seed, convs=60):
    """Few different turns, one hot conversation, copies, chains, nulls, gaps and repeated rows."""
    rng = random.Random(seed)
    rows = []
    hot = [("user", "é hot"), ("assistant", "b"), ("user", "c"), ("assistant", "dd")]
    for c in rng.sample(range(-20, 4 * convs), convs):
        turns = hot if rng.random() < 0.3 else [(rng.choice(["user", "assistant", None]), rng.choice(["a", "bb", "", None])) for _ in range(rng.randrange(1, 14))]
        rows += [(c, t if t or rng.random() < 0.5 else None, r, x) for t, (r, x) in enumerate(turns)]
    rows += [(None, 1, "user", "nobody"), rows[0], rows[0]]
    rows += [(1000 + c, t, "user", "same") for c in range(2) for t in range(23)]
    return rows


@pytest.mark.parametrize(("seed", "segment", "shard"), [(1, 4096, 1 << 20), (2, 4096, 25), (3, 3, 1 << 20), (4, 2, 10), (5, 1, 25)])
def test_hard_rows(spark, seed, segment, shard):
    rows = many(seed)
    schema = "conv_id long, turn long, role string, text string, path string, depth string"
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], schema).repartition(3)
    ranked = pt.ranked_turns(df)
    turns, convs = pt.grafted_turns(ranked, F.expr("conv_id - conv_id % 5"), F.expr("crc32(cast(cast(conv_id as string) as binary)) % 9"), 8)
    assert collected(pt.prefix_trie(turns, convs, segment, shard)) == plain(rebuilt(rows))


def test_empty_and_turnless(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    ranked = pt.ranked_turns(none)
    assert collected(pt.prefix_trie(ranked.withColumn("depth", F.col("rank") + 1), ranked.select("conv_id"))) == []
    two = spark.createDataFrame([(5,), (3,)], "conv_id long")
    ends = hashlib.sha256(b"3,5").hexdigest()
    assert collected(pt.prefix_trie(ranked.withColumn("depth", F.col("rank") + 1), two)) == [(0, 3, None, 2, 0, 1, 0, ends)]


def test_long_conversation_and_long_text(spark):
    rows = [(1, t, "user", f"t{t}") for t in range(9000)] + [(2, t, "user", f"t{t}" if t < 6000 else f"u{t}") for t in range(9000)] + [(3, 0, "user", "long " * 200_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    ranked = pt.ranked_turns(df).withColumn("depth", F.col("rank") + 1)
    found = pt.prefix_trie(ranked, ranked.select("conv_id").distinct())
    root = found.where("depth = 0").first()
    assert (root["n_convs"], root["n_children"], root["n_leaves"]) == (3, 2, 3)
    assert root["saved_tokens"] == sum(len(f"t{t}") for t in range(6000))
    assert found.count() == 1 + 6000 + 3000 * 2 + 1
