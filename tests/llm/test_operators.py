"""Each document operator against a plain version of the same rules, on hard rows and on the smallest tables."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from skyfold.llm import bpe, jaccard_join, language, lm_scoring, mixing, pii, quality, queries, sharding, substring_dedup
from skyfold.llm.common import text_of, words_of
from skyfold.llm.exact_dedup import exact_duplicates

SF = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def fold_case(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return (text or "").encode().split()


@pytest.fixture(scope="session")
def coder():
    return bpe.PrefixBpe(bpe.read_ranks(RANKS), public_tokenizers.PATTERN)


@pytest.fixture(scope="session")
def judge():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


# --- 10 exact dedup


def check_exact(rows, found):
    groups = collections.defaultdict(list)
    for r in rows:
        groups[fold_case(r["text"])].append(r["doc_id"])
    assert len(found) == len(rows)
    kept = collections.Counter()
    for r in found:
        ids = groups[r["normal_text"]]
        assert r["normal_text"] == fold_case(r["text"])
        assert r["group_size"] == len(ids)
        best = max((i for i in ids if i is not None), default=None)
        assert r["keep_id"] == best
        if r["kept"]:
            assert r["doc_id"] == best
            kept[r["normal_text"]] += 1
    assert all(kept[t] == 1 for t in groups)


def test_exact_dedup(spark, hard, empty):
    found = exact_duplicates(hard, first=4, growth=3)
    assert found.columns.count("kept") == 1
    check_exact(hard.collect(), found.collect())
    assert exact_duplicates(empty).count() == 0
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check_exact(docs.collect(), exact_duplicates(docs).collect())


# --- 3 mixing


def test_targets_are_shared_anew():
    assert mixing.targets([100, 100, 100], (5, 2, 1), 3) == [187.5, 75.0, 37.5]
    assert mixing.targets([10, 100, 100], (5, 2, 1), 3) == [30.0, 120.0, 60.0]
    assert mixing.targets([0, 0], (5, 2), 3) == [0.0, 0.0]


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000])
def test_permutation(n):
    p = mixing.Permutation(n, 5)
    at = p.at(np.arange(n))
    assert sorted(at.tolist()) == list(range(n))
    assert all(p.where(int(y)) == x for x, y in enumerate(at))


def test_shard_counts_draw_all():
    counts = mixing.shard_counts([10, 0, 1000, 3], 7, 1)
    assert counts.sum(axis=0).tolist() == [10, 0, 1000, 3]
    assert counts.sum(axis=1).max() - counts.sum(axis=1).min() <= 1


def test_mixing(spark, hard, empty):
    docs = hard.select("doc_id", "source", F.size(words_of(text_of("text"))).cast("long").alias("size"), F.monotonically_increasing_id().alias("row"))
    mix = mixing.Mix(block=16, shards=3)
    rows = mixing.mixing_counts(docs, "source", "size", ["doc_id", "row"], mix).collect()
    assert len(rows) == hard.count()
    by = collections.defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
        assert 0 <= r["taken"] <= 3 * r["size"]
    names = sorted(k for k in by if k is not None) + [None]
    sizes = [sum(r["size"] for r in by[k]) for k in names]
    for name, size, target in zip(names, sizes, mixing.targets(sizes, mix.weights, mix.cap)):
        assert {r["source_size"] for r in by[name]} == {size}
        assert sum(r["taken"] for r in by[name]) == round(target)
    again = mixing.mixing_counts(docs.repartition(5), "source", "size", ["doc_id", "row"], mix).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert mixing.mixing_counts(docs.limit(0), "source", "size", ["doc_id", "row"], mix).count() == 0
    texts = mixing.mixed_documents(hard, mix=mix)
    taken = collections.Counter()
    originals = {(r["doc_id"], r["source"]): words(r["text"]) for r in hard.collect()}
    for r in texts.collect():
        own = originals[r["doc_id"], r["source"]]
        taken[r["source"]] += len(words(r["text"]))
        assert set(words(r["text"])) <= set(own) and len(words(r["text"])) <= len(own)
    assert sum(taken.values()) == sum(round(t) for t in mixing.targets(sizes, mix.weights, mix.cap))
    assert mixing.mixed_documents(empty).count() == 0


# --- 7 sharding


def test_sharding(spark, hard, empty):
    rows = hard.select("doc_id", sharding.utf8_size().alias("size"), F.crc32(text_of("text").cast("binary")).alias("crc"))
    found = sharding.byte_shards(rows, "size", ["doc_id", "crc", "size"], 4).collect()
    assert len(found) == rows.count()
    shards = collections.defaultdict(list)
    for r in found:
        shards[r["shard"]].append(r)
    for s in shards.values():
        assert sorted(r["slot"] for r in s) == list(range(len(s)))
    order = sorted(found, key=lambda r: (r["shard"], r["slot"]))
    ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in order]
    assert ids == sorted(ids)
    assert sharding.byte_shards(rows.limit(0), "size", ["doc_id"], 4).count() == 0
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", sharding.utf8_size().alias("size"))
    got = sharding.byte_shards(docs, "size", ["doc_id"], 16).collect()
    sizes = collections.Counter()
    for r in got:
        sizes[r["shard"]] += r["size"]
    assert max(abs(v - sum(sizes.values()) / 16) for v in sizes.values()) <= max(r["size"] for r in got)


# --- 6 quality


def plain_signals(text):
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if re.search(r"[^ \t-\r]", x)]
    runs = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if runs[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(len(x.decode()) for x in w), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(lines)


def binned(v):
    step = 10 ** max(0, len(str(v)) - 3)
    return v - v % step


def plain_verdicts(rows, rules):
    """The rules over all rows in memory."""
    stats = [plain_signals(r["text"]) for r in rows]
    rates = [(1000 * sy // max(c, 1), 100 * c // max(n, 1), 1000 * d // max(ln, 1)) for n, c, sy, d, _, ln in stats]
    groups = collections.defaultdict(list)
    for r, s, x in zip(rows, stats, rates):
        if s[0] >= rules.least_words:
            for key in ((r["lang"], r["source"]), (r["lang"],), ()):
                groups[key].append([binned(v) for v in x])
    out = []
    for r, s, x in zip(rows, stats, rates):
        failed = s[0] < rules.least_words or 100 * s[4] > rules.repeat_percent * s[0]
        own = groups.get((r["lang"], r["source"]))
        kept = False
        if own and not failed:
            use = next((groups[k] for k in ((r["lang"], r["source"]), (r["lang"],)) if len(groups[k]) >= rules.least_docs), groups[()])
            kept = True
            for k, (least, low) in enumerate(((rules.least_symbols, False), (rules.least_length, True), (rules.least_lines, False))):
                v = sorted(y[k] for y in use)
                q1, q3 = v[math.ceil(len(v) / 4) - 1], v[math.ceil(3 * len(v) / 4) - 1]
                reach = rules.fence * max(q3 - q1, least)
                kept = kept and x[k] <= q3 + reach and (not low or x[k] >= q1 - reach)
        out.append((r["doc_id"], *s[:5], failed, kept))
    return out


@pytest.mark.parametrize("least_docs", [1, 3, 50])
def test_quality(spark, hard, empty, least_docs):
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    rules = quality.QualityRules(least_docs=least_docs)
    for docs in (hard, spark.read.parquet(f"{SF}/documents.parquet")):
        found = [tuple(r[n] for n in names) for r in quality.quality_verdicts(docs, rules).collect()]
        assert sorted(map(str, found)) == sorted(map(str, plain_verdicts(docs.collect(), rules)))
    assert quality.quality_verdicts(empty, rules).count() == 0


def test_quality_groups_without_broadcast(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one = quality.quality_verdicts(docs).select("doc_id", "kept").collect()
    monkeypatch.setattr(quality, "BROADCAST_ROWS", 0)
    assert sorted(one) == sorted(quality.quality_verdicts(docs).select("doc_id", "kept").collect())


def test_quality_is_native(spark):
    plan = quality.quality_verdicts(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- 2 byte-level BPE


def odd_text(rng):
    return "".join(rng.choice(rng.choice(["abc xyz  '", "0123 ", "\n\t  ", "éüñ字漢🎉 ", "aaaaaa", "'re've'll ", "-=*#!?", "  \x1f\x85"])) for _ in range(rng.randint(0, 60)))


def test_bpe_equals_the_library(coder, judge):
    rng = random.Random(3)
    for _ in range(2000):
        text, more = odd_text(rng), odd_text(rng)
        ids = coder.encode(text)
        assert ids == judge.encode_ordinary(text)
        assert coder.decode(ids).decode() == text
        assert coder.append(text, ids, more) == judge.encode_ordinary(text + more)
        a = rng.randint(0, len(text))
        b = rng.randint(a, len(text))
        changed, new = coder.edit(text, ids, a, b, more)
        assert changed == text[:a] + more + text[b:] and new == judge.encode_ordinary(changed)


def test_bpe_prefix_entries(coder):
    rng = random.Random(4)
    for _ in range(500):
        data, new = odd_text(rng).encode(), odd_text(rng).encode()
        last = coder.extend(data, [])
        assert b"".join(coder.tokens[t] for t in coder.tokens_of(data, last)) == data
        assert coder.extend(data + new, list(last)) == coder.extend(data + new, [])
        a = rng.randint(0, len(data))
        b = rng.randint(a, len(data))
        changed, entries = coder.edited(data, last, a, b, new)
        assert entries == coder.extend(changed, [])


def test_bpe_tables(spark, hard, empty, judge):
    coded = bpe.bpe_encode(hard.withColumn("ids", F.lit("clash")), RANKS, public_tokenizers.PATTERN)
    rows = bpe.bpe_decode(coded, RANKS).collect()
    assert len(rows) == hard.count()
    for r in rows:
        assert list(r["ids"]) == judge.encode_ordinary(r["text"] or "")
        assert bytes(r["decoded"]) == (r["text"] or "").encode()
    longer = bpe.bpe_append(coded.withColumn("more", F.lit("'s  end")), RANKS, public_tokenizers.PATTERN, "more")
    for r in longer.collect():
        assert list(r["ids"]) == judge.encode_ordinary(r["text"])
    assert bpe.bpe_encode(empty, RANKS, public_tokenizers.PATTERN).count() == 0
    got = {r["doc_id"]: r for r in queries.op2_byte_bpe(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = judge.encode_ordinary(r["text"])
        assert got[r["doc_id"]]["n_tokens"] == len(ids)
        assert got[r["doc_id"]]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[r["doc_id"]]["decoded_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest()


# --- 1 language


def test_forward_sums_all_segmentations():
    pieces = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258}
    logs = np.log(np.random.default_rng(1).dirichlet(np.ones(259), 2))
    model = language.Model(["x", "y"], pieces, 3, logs)

    def plain(word, k):
        return 1.0 if not word else sum(math.exp(logs[k, pieces[word[:n]]]) * plain(word[n:], k) for n in (1, 2, 3) if word[:n] in pieces and len(word) >= n)

    some = [b"abcabc", b"a", b"bcab", b"zzabc"]
    assert np.allclose(model.scores(some), [[math.log(plain(w, k)) for k in (0, 1)] for w in some])
    counts = np.array([[2.0, 1.0]] * len(some))
    used = model.expected(some, counts)
    lengths = np.array([len(p) for p in pieces])
    assert np.allclose((used * lengths).sum(axis=1), [2 * sum(map(len, some)), sum(map(len, some))])


def test_language(spark, hard, empty):
    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.train(docs.where(language.fold() != 2), vocabulary)
    rows = language.predict(docs, model).where(language.fold() == 2).collect()
    assert len(rows) > 100
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)
    odd = language.predict(hard, model).collect()
    assert len(odd) == hard.count()
    for r in odd:
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or ""))
    assert language.predict(empty, model).count() == 0
    none = language.train(empty, vocabulary)
    assert {r["lang_pred"] for r in language.predict(hard, none).collect()} == {"und"}
    folds = {r["doc_id"]: r["held_out"] for r in queries.op1_language_id(spark, SF).collect()}
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in folds.items())


def test_rare_languages_are_trained(spark):
    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    words = {"aa": "stone river window", "bb": "haus wasser fenster", "cc": "каменный речной оконный"}
    rows = [("aa", f"{words['aa']} number {'x' * (i % 7)}q{i}") for i in range(3000)] + [("aa", "one copied text")] * 3000
    rows += [("bb", f"{words['bb']} nummer {chr(97 + i)}") for i in range(3)] + [("cc", "123 456")] * 5
    labelled = spark.createDataFrame(rows, "lang string, text string")
    names, sample = language._sampled(labelled, language.Training(language_rows=50))
    taken = collections.Counter(r["lang"] for r in sample.collect())
    assert taken == {"aa": 50, "bb": 3, "cc": 1} and sample.distinct().count() == 54
    everything = language._sampled(labelled, language.Training(language_rows=10_000))[1]
    assert {tuple(r) for r in everything.collect()} == set(rows)
    model = language.train(labelled, vocabulary, training=language.Training(language_rows=50))
    assert model.languages == ["aa", "bb"]  # no letter, nothing learnt: not a language of the model
    some = spark.createDataFrame([(words["aa"],), (words["bb"],)], "text string")
    assert [r["lang_pred"] for r in language.predict(some, model).collect()] == ["aa", "bb"]


# --- 5 Jaccard join


def plain_sets(texts, k):
    out = []
    for t in texts:
        w = fold_case(t).encode().split()
        out.append(frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset())
    return out


def plain_groups(sets, percent):
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * len(a | sets[j]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(i) for i in range(len(sets))]


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80)])
def test_jaccard_groups(spark, hard, empty, k, percent):
    rng = random.Random(8)
    texts = [r["text"] for r in hard.collect()] + [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    for _ in range(150):
        base = [f"v{rng.randint(0, 40)}" for _ in range(rng.randint(1, 60))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 3)):
            near = list(base)
            for _ in range(rng.randint(0, 2)):
                near[rng.randrange(len(near))] = f"n{rng.randint(0, 9)}"
            texts.append(" ".join(near))
    rows = spark.createDataFrame(list(enumerate(texts)), "_id long, _text string")
    sim = jaccard_join.Similarity(shingle=k, percent=percent)
    found = {r["_id"]: r for r in jaccard_join.jaccard_groups(rows, sim).collect()}
    sets = plain_sets(texts, k)
    assert len(found) == len(texts)
    groups = plain_groups(sets, percent)
    for i in range(len(texts)):
        assert found[i]["n_shingles"] == len(sets[i])
        assert found[i]["component_id"] == groups[i]
    assert jaccard_join.jaccard_groups(rows.limit(0), sim).count() == 0


def test_near_duplicates(spark, hard, empty):
    rows = jaccard_join.near_duplicates(hard).collect()
    assert len(rows) == hard.count()
    kept = [r["doc_id"] for r in rows if r["kept"]]
    assert sum(i in (1, 2, 3) for i in kept) == 1 and sum(i in (8, 14) for i in kept) == 1
    assert sum(r["kept"] for r in rows if r["text"] == "one two") == 1
    assert all(r["kept"] for r in rows if not words(r["text"]))
    assert jaccard_join.near_duplicates(empty).count() == 0


def test_without_near_duplicates(spark, hard, empty):
    order = lambda rows: sorted(rows, key=str)
    twice = hard.unionByName(hard)
    for docs in (hard, twice):
        kept = jaccard_join.near_duplicates(docs).where("kept").select("doc_id", "text").collect()
        stays = jaccard_join.without_near_duplicates(docs)
        assert stays.columns == docs.columns
        assert order(stays.select("doc_id", "text").collect()) == order(kept)
    assert jaccard_join.without_near_duplicates(empty).collect() == []


def test_signatures_meet_whenever_sets_link():
    rng = np.random.default_rng(2)
    sim = jaccard_join.Similarity()
    for _ in range(300):
        n = int(rng.integers(1, 120))
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.concatenate([a[rng.random(len(a)) > 0.07], rng.integers(0, 1 << 63, int(rng.integers(0, 1 + n // 14))).astype(np.uint64)])
        both = len(np.intersect1d(a, b))
        if len(b) and 100 * both >= 85 * (len(a) + len(b) - both):
            assert np.intersect1d(jaccard_join.signatures([a], sim)[0], jaccard_join.signatures([np.sort(b)], sim)[0]).size


# --- 4 substring dedup


def plain_windows(rows, k=20):
    seen, out = set(), []
    for r in rows:
        w = words(r["text"])
        gone = set()
        for i in range(len(w) - k + 1):
            x = tuple(w[i : i + k])
            if x in seen:
                gone.update(range(i, i + k))
            seen.add(x)
        out.append((r["doc_id"], len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return out


@pytest.mark.parametrize("hot", [3, 5_000])
def test_substring_dedup(spark, hard, empty, hot):
    for docs in (hard, spark.read.parquet(f"{SF}/documents.parquet")):
        rows = sorted(docs.collect(), key=lambda r: -1 if r["doc_id"] is None else r["doc_id"])
        found = substring_dedup.substring_dedup(docs, win=substring_dedup.Windows(hot=hot)).collect()
        assert sorted(str((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"])) for r in found) == sorted(map(str, plain_windows(rows)))
    assert substring_dedup.substring_dedup(empty).count() == 0


def test_full_sketch_loses_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    full = substring_dedup.substring_dedup(docs, win=substring_dedup.Windows(depth=1, most_bits=substring_dedup.SLICE_BITS, hot=2)).select("doc_id", "kept_text").collect()
    assert sorted(full) == sorted(substring_dedup.substring_dedup(docs).select("doc_id", "kept_text").collect())


# --- 8 personal data


def plain_base(text):
    text, out = text or "", []
    out += [(m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[ -]", "", m.group())
        if 12 <= len(d) <= 19 and pii.luhn(d):
            out.append((m.start(), m.end(), "card"))
    out += [(m.start(), m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


def test_base_spans():
    rng = random.Random(6)
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    parts = ["a.b@c.de", "@", "x@y", "a@b.c@d.e", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "00001.2.3.4", "4111 1111-1111 1111", "4111111111111111", "+1 (555) 555-0100", "+12", "+1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", " ", "é", "..", "-", "7", "+", "\n"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert [(s, e, pii.KINDS[k]) for s, e, k in pii.base_spans(text)] == plain_base(text), text


def test_personal_data(spark, hard, empty):
    card = "5500005555555559"
    cards = [n for n in map(str, range(4_000_000_000_000_000, 4_000_000_000_000_400, 7)) if pii.luhn(n)]
    texts = [f"pay {card} now, again {card} {card} end", "mail joe@site.example.com or +1 (555) 555-0100", "nothing here"]
    texts += [f"pay {c} now and later {c} too, with 12 items" for c in cards]
    assert len(cards) >= 5
    docs = spark.createDataFrame([(i, t, "old") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    rows = {r["doc_id"]: r for r in pii.find_personal_data(docs).collect()}
    for i, t in enumerate(texts):
        base = [(s["start"], s["end"], s["kind"]) for s in rows[i]["spans"] if s["base"]]
        assert base == plain_base(t)
    # two card numbers side by side are no match of the pattern; the field gives both the label of their equal
    assert [t[s["start"] : s["end"]] for t in texts[:1] for s in rows[0]["spans"]] == [card] * 3
    assert rows[2]["spans"] == []
    odd = pii.find_personal_data(hard).collect()
    assert len(odd) == hard.count() and all(r["spans"] == [] for r in odd)
    assert pii.find_personal_data(empty).count() == 0


def test_a_shape_is_that_of_the_whole_token():
    texts = ["x" * 300 + "1234567890", "x" * 300 + "@", "y" * 9 + "0987654321"]
    one, two, three = pii.Graph(texts, [[], [], []]).shape
    assert one == three != two


def test_copies_of_the_corpus_leave_every_span():
    bare = [f"{3_000_000_000 + 7919 * i}" for i in range(400)]
    texts = [f"call +1{b}, {b}, +1{b} today" for b in bare[:4]] + [f"call +1 {b[:3]} {b[3:]} or, tonight, +1 {b[:3]} {b[3:]}" for b in bare[4:40]]
    texts += [f"order {b} shipped, order {b} closed" for b in bare[40:]]
    found = [pii.base_spans(t) for t in texts]
    graph = pii.Graph(texts, found)
    shape, chain, skip = np.zeros((pii.SHAPES, 5)), np.zeros((5, 5)), np.zeros((5, 5))
    label = np.array(graph.label)
    np.add.at(shape, (graph.shape, label), 1)
    for table, edges in ((chain, graph.chain), (skip, graph.skip)):
        for a, b in edges:
            table[label[a], label[b]] += 1

    def added(times):
        return pii._added(graph, texts, found, pii._weights(shape * times, chain * times, skip * times, pii.Field()), pii.Field())

    once = added(1)
    # the bare number is labelled between its own repetitions, and only there
    assert [[(t[s:e], pii.KINDS[k]) for s, e, k in spans] for t, spans in zip(texts, once)] == [[(b, "phone")] for b in bare[:4]] + [[]] * 396
    assert all(added(times) == once for times in (100, 10_000, 1_000_000))


def test_messages_equal_sums_over_all_labellings():
    rng = np.random.default_rng(3)
    graph = pii.Graph(["1a 2b 3c"], [[]])
    graph.shape, graph.skip = [1, 2, 3], []
    shape = np.zeros((pii.SHAPES, 5))
    shape[1:4] = rng.normal(size=(3, 5))
    chain = rng.normal(size=(5, 5))
    chain += chain.T
    got = pii.marginals(graph, pii.Weights(shape, chain, chain), 60)
    joint = np.exp(shape[1][:, None, None] + shape[2][None, :, None] + shape[3][None, None, :] + chain[:, :, None] + chain[None, :, :])
    joint /= joint.sum()
    assert np.allclose(got, [joint.sum(axis=(1, 2)), joint.sum(axis=(0, 2)), joint.sum(axis=(0, 1))], atol=1e-6)


# --- 9 LM scoring


def plain_scores(texts, factor):
    per = [collections.Counter(t[a : a + n] for n in range(1, 5) for a in range(len(t) - n + 1)) for t in texts]
    total = sum(per, collections.Counter())
    size = sum(map(len, texts))
    out = []
    for t, own in zip(texts, per):
        s = 0.0
        for k, c in enumerate(t):
            h = t[max(0, k - 3) : k]
            while h and total[h + c] == own[h + c]:
                h, s = h[1:], s + math.log(factor)
            n = total[h + c] - own[h + c]
            s += math.log(n / (total[h] - own[h])) if h else math.log(max(n, 1) / max(size - len(t), 1))
        out.append(s)
    return out


def test_lm_scores(spark, hard, empty):
    for docs, chunk in ((hard, 500), (spark.read.parquet(f"{SF}/documents.parquet").limit(60), 8_000_000)):
        rows = lm_scoring.lm_scores(docs, model=lm_scoring.Backoff(chunk_chars=chunk)).collect()
        texts = [(r["text"] or "").replace("🎉", "") for r in rows]
        folded = "".join(map(chr, lm_scoring.codes("🎉").tolist()))
        texts = [t.replace("", folded) for t in texts]
        assert len(rows) == docs.count()
        for r, t, s in zip(rows, texts, plain_scores(texts, 0.4)):
            assert r["n_chars_scored"] == len(t)
            assert r["log_score"] == pytest.approx(s, abs=1e-6 * max(1, abs(s)))
            assert (r["mean_log_score"] is None) == (not t)
    assert lm_scoring.lm_scores(empty).count() == 0


def plain_word_scores(texts, factor):
    lists = [words(t) for t in texts]
    per = [collections.Counter(tuple(t[a : a + n]) for n in (1, 2, 3) for a in range(len(t) - n + 1)) for t in lists]
    total = sum(per, collections.Counter())
    size = sum(map(len, lists))
    out = []
    for t, own in zip(lists, per):
        s = 0.0
        for k, w in enumerate(t):
            h = tuple(t[max(0, k - 2) : k])
            while h and total[h + (w,)] == own[h + (w,)]:
                h, s = h[1:], s + math.log(factor)
            n = total[h + (w,)] - own[h + (w,)]
            s += math.log(n / (total[h] - own[h])) if h else math.log(max(n, 1) / max(size - len(t), 1))
        out.append(s)
    return out


def test_word_lm_scores(spark, hard, empty):
    order = spark.createDataFrame([(i, "the cat sat on the mat") for i in range(3)] + [(9, "mat the on sat cat the"), (10, "🎉 🎊"), (11, "🎉 🎉")], "doc_id long, text string")
    for docs, bits in ((hard, 30), (hard, 1), (order, 30), (spark.read.parquet(f"{SF}/documents.parquet").limit(60), 30)):
        rows = lm_scoring.word_lm_scores(docs, model=lm_scoring.WordBackoff(most_bits=bits)).collect()
        assert len(rows) == docs.count()
        texts = [r["text"] or "" for r in rows]
        for r, t, s in zip(rows, texts, plain_word_scores(texts, 0.4)):
            assert r["n_words_scored"] == len(words(t))
            assert r["log_score"] == pytest.approx(s, abs=1e-6 * max(1, abs(s)))
            assert (r["mean_log_score"] is None) == (not words(t))
    found = {r["doc_id"]: r["mean_log_score"] for r in lm_scoring.word_lm_scores(order).collect()}
    assert found[9] < found[0] - 1  # the same words shuffled are far from fluent
    assert lm_scoring.word_lm_scores(empty).count() == 0
    assert "n_words_scored" in queries.op9_lm_scoring(spark, SF).columns


# --- sketch and pipeline


def test_sketch_never_underestimates(spark):
    from skyfold.llm.sketch import merged_sketch

    rows = spark.createDataFrame([(i % 700,) for i in range(1000)], "k long").repartition(5)

    def keys(batches):
        for b in batches:
            yield b.column(0).to_numpy().astype(np.uint64)

    for bits in (18, 25):
        sketch = merged_sketch(rows, keys, bits, 2, [1, 2])
        some = np.arange(700, dtype=np.uint64)
        assert sketch.test(some, 0).all() and sketch.test(some[:300], 1).all()
        assert sketch.test(some[300:], 1).mean() < 0.05


def test_pipeline_equals_plain_stages(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = [r for r, v in zip(docs.collect(), plain_verdicts(docs.collect(), quality.QualityRules())) if v[-1]]
    last = {}
    for r in sorted(good, key=lambda r: r["doc_id"]):
        last[fold_case(r["text"])] = r
    once = sorted(last.values(), key=lambda r: r["doc_id"])
    groups = plain_groups(plain_sets([r["text"] for r in once], 5), 80)
    left = [r for i, r in enumerate(once) if groups[i] == i]
    sizes = collections.Counter()
    for r in left:
        sizes[r["source"]] += len(words(r["text"]))
    names = sorted(sizes)
    goal = {n: round(t) for n, t in zip(names, mixing.targets([sizes[n] for n in names], mixing.Mix().weights, 3))}
    rows = cp.run(spark, SF).collect()
    taken = collections.Counter()
    texts = {r["doc_id"]: r["text"] for r in left}
    coder = bpe.PrefixBpe(bpe.read_ranks(RANKS), public_tokenizers.PATTERN)
    for r in rows:
        taken[r["source"]] += len(words(r["text"]))
        assert r["n_chars"] == len(r["text"]) and list(r["ids"]) == coder.encode(r["text"]) and r["exact"]
        assert set(words(r["text"])) <= set(words(texts[r["doc_id"]]))
    assert dict(taken) == {n: g for n, g in goal.items() if g}


def test_pipeline_stages_on_hard_rows(spark, hard, empty):
    import corpus_pipeline as cp
    from skyfold.session import cut_lineage

    for docs in (hard, empty):
        for name, stage in cp.STAGES:
            docs = cut_lineage(stage(spark, docs, SF))
            assert docs.columns[: len(hard.columns)] == hard.columns, name


# --- names that clash


def test_mixing_takes_columns_of_any_name(spark):
    names = ["before", "rank", "total", "target", "taken", "_s", "source_size", "_part", "_own", "_block"]
    rows = spark.createDataFrame([(i, "ab"[i % 2], 10 + i, *["x"] * len(names)) for i in range(40)], "doc_id long, source string, size long, " + ", ".join(f"{n} string" for n in names))
    plain = mixing.mixing_counts(rows.select("doc_id", "source", "size"), "source", "size", ["doc_id"])
    got = mixing.mixing_counts(rows, "source", "size", ["doc_id"])
    outputs = {"target", "taken", "source_size"}
    assert sorted(got.columns) == sorted({*rows.columns, *outputs})
    assert {tuple(r) for r in got.select(plain.columns).collect()} == {tuple(r) for r in plain.collect()}
    assert {r[n] for r in got.collect() for n in names if n not in outputs} == {"x"}


# --- hashes


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_swapped_letters_throughout_a_long_word_differ(spark):
    one = thue_morse(1024)
    two = one.translate(str.maketrans("ab", "ba"))
    rest = " ".join(f"w{i}" for i in range(19))
    rows = spark.createDataFrame([(1, f"{one} {rest}"), (2, f"{two} {rest}")], "doc_id long, text string")
    assert {r["doc_id"]: r["n_removed"] for r in substring_dedup.substring_dedup(rows).collect()} == {1: 0, 2: 0}
    pair = spark.createDataFrame([(1, " ".join([one] * 3)), (2, " ".join([two] * 3))], "_id long, _text string")
    assert {r["_id"]: r["component_id"] for r in jaccard_join.jaccard_groups(pair).collect()} == {1: 1, 2: 2}


def test_byte_shards_equal_a_plain_pass(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    rows = sorted((r["doc_id"], zlib.crc32((r["text"] or "").encode()), len((r["text"] or "").encode()) + 1) for r in docs)
    total, before, slots, want = sum(r[2] for r in rows), 0, collections.Counter(), {}
    for doc, crc, size in rows:
        shard = (2 * before + size) * 16 // (2 * total)
        want[doc] = (size, crc, "bytes", shard, slots[shard], None)
        slots[shard] += 1
        before += size
    got = queries.QUERIES["op7_byte_shards"](spark, SF).collect()
    assert {r["doc_id"]: (r["size"], r["text_crc32"], r["law"], r["shard"], r["slot"], r["grown_shard"]) for r in got} == want
