"""Induced sorting and repeated byte strings against plain versions."""

import hashlib
import random

import numpy as np
import pytest

from skyfold.llm import induced, queries, suffix_dedup
from skyfold.llm.suffix_dedup import Strings

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("places", [0, 4, 10**9])
def test_suffix_array_equals_sorting(monkeypatch, places):
    monkeypatch.setattr(induced, "PLACES", places)
    rng = random.Random(places)
    for _ in range(150):
        size = rng.choice([1, 2, 3, 5, 50])
        text = [rng.randrange(1, size + 1) for _ in range(rng.randrange(1, 80))] + [0]
        assert induced.suffix_array(np.array(text, np.int64), size + 1).tolist() == sorted(range(len(text)), key=lambda i: text[i:])


def plain_starts(strings, width):
    seen = {}
    for k, s in enumerate(strings):
        for i in range(len(s) - width + 1):
            seen.setdefault(s[i : i + width], []).append((k, i))
    out = [[] for _ in strings]
    for places in seen.values():
        for k, i in places if len(places) > 1 else ():
            out[k].append(i)
    return [sorted(o) for o in out]


def test_repeated_starts_of_a_shard():
    rng = random.Random(5)
    for _ in range(150):
        strings = [bytes(rng.choices(b"ab\x00\x01\xff", k=rng.randrange(0, 40))) for _ in range(rng.randrange(0, 6))]
        width = rng.choice([1, 2, 3, 9])
        assert [a.tolist() for a in induced.repeated_starts(strings, width)] == plain_starts(strings, width)


def plain(texts, width):
    raws = [(t or "").encode() for t in texts]
    out = []
    for raw, starts in zip(raws, plain_starts(raws, width), strict=True):
        gone = np.zeros(len(raw) + 1, bool)
        for s in starts:
            gone[s : s + width] = True
        kept = bytes(c for c, g in zip(raw, gone, strict=False) if not g)
        out.append((len(raw), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), kept))
    return out


def check(spark, texts, spec):
    rows = [(i, t, "x", "y") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, t string, kept_bytes string").repartition(3)
    found = suffix_dedup.suffix_dedup(docs, "text", spec).orderBy("doc_id").collect()
    assert [(r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept_bytes"])) for r in found] == plain(texts, spec.width)
    assert {r["t"] for r in found} <= {"x"}


def mixed(seed, width):
    """Texts with shared passages of about the width, periodic stretches, copies, nulls and blanks."""
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("abcé 漢\n") for _ in range(n))
    passages = [word(width + d) for d in (-3, -1, 0, 1, 5, 40)]
    texts = [None, "", " ", "a" * (4 * width), "ab" * (3 * width), "ab" * width]
    for _ in range(40):
        texts.append("".join(rng.choice([word(rng.randrange(0, width)), rng.choice(passages)]) for _ in range(rng.randrange(1, 5))))
    return texts + texts[8:12] + ["hot " + passages[4] + word(3) for _ in range(25)]


@pytest.mark.parametrize(("seed", "spec"), [(1, Strings(24, 2, 1 << 20)), (2, Strings(24, 2, 200)), (3, Strings(17, 4, 60)), (4, Strings(9, 3, 1))])
def test_hard_rows(spark, seed, spec):
    check(spark, mixed(seed, spec.width), spec)


def test_long_text_in_parts(spark, monkeypatch):
    rng = random.Random(9)
    long = "".join(rng.choice("abcdefgh") for _ in range(5000))
    monkeypatch.setattr(suffix_dedup, "PIECE", 1 << 10)
    spec = Strings(64, 3)
    texts = [(0, (long + long[1000:1500]).encode()), (1, b"short"), (2, long[3000:3300].encode())]
    seen = [(k, int(a) + j) for nums, at, n, off, key in suffix_dedup.contexts_of(texts, spec) for k, a, m in zip(nums, at, n, strict=True) for j in range(m)]
    assert sorted(seen) == [(k, i) for k, t in texts for i in range(len(t) - 63)]
    whole = {}
    for nums, at, n, off, key in suffix_dedup.contexts_of(texts, spec):
        for k, a, m, o, h in zip(nums, at, n, off, key, strict=True):
            for j in range(m):
                whole.setdefault(texts[k][1][a + j : a + j + 64], set()).add((int(o) - j, int(h)))
    # equal strings have the same gram at the same offset, whatever lies around them
    assert all(len(v) == 1 for v in whole.values())


def test_query_equals_plain(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    found = queries.QUERIES["op12_suffix_dedup"](spark, SF).orderBy("doc_id").collect()
    want = plain([r["text"] for r in rows], 400)
    assert [(r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in found] == [(a, b, c, hashlib.sha256(k).hexdigest()) for a, b, c, k in want]


def test_no_rows(spark, empty):
    assert suffix_dedup.suffix_dedup(empty).count() == 0
    one = suffix_dedup.suffix_dedup(empty.unionByName(spark.createDataFrame([(1, None)], "doc_id long, text string"), allowMissingColumns=True)).first()
    assert (one["n_bytes"], one["n_removed"], one["n_spans"], bytes(one["kept_bytes"])) == (0, 0, 0, b"")
    assert one["doc_id"] == 1
