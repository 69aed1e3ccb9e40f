"""Duplicates against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from anomalypool.llm import bwt, exact_dedup, simhash, suffix_dedup

SCHEMA = "doc_id long, text string, _gone string, source string"


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 7)))
    passage = " ".join(word() for _ in range(60))
    rows = []
    for i in range(260):
        words = [word() for _ in range(rng.choice([0, 1, 3, 5, 60, 200]))]
        if i % 4 == 1 and rows:
            words = (rows[rng.randrange(len(rows))][1] or "").split(" ")
            if words and i % 8 == 1:
                words[rng.randrange(len(words))] = word()
        text = " ".join(words)
        rows.append((i * 3 % 311, f"{text} {passage} {word()}" if i % 9 == 0 else text.replace(" ", "\n\t ") if i % 7 == 0 else text, "c", "s"))
    rows += [(1000, None, "c", None), (1001, "", None, "s"), (1002, " \t", "c", "s"), (1003, "abc " * 900, "c", "s"), (1004, "q" * 99, "c", "s"), (1005, "q" * 350, "c", "s"), (1006, "é日" * 80, "c", "s"), (1007, "x" + "é日" * 80, "c", "s")]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def test_exact(spark, docs):
    texts = {r["doc_id"]: normal(r["text"]) for r in docs.collect()}
    groups = {}
    for i, t in texts.items():
        groups.setdefault(t, []).append(i)
    got = exact_dedup.exact_duplicates(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        own = groups[texts[r["doc_id"]]]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (min(own), len(own), min(own) == r["doc_id"])
    left = exact_dedup.drop_exact_duplicates(docs)
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == sorted(map(min, groups.values()))
    assert exact_dedup.exact_duplicates(docs.limit(0)).count() == 0


def test_exact_with_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a\tb"), (None, "c"), (2, None), (3, "")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 1, 3, True), (1, 1, 3, True), (None, 1, 3, False), (None, None, 1, True), (2, 2, 2, True), (3, 2, 2, False)], key=str)


def _components(fp, ids, limit):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(ids)):
        for b in range(a):
            if (fp[a] ^ fp[b]).bit_count() <= limit:
                x, y = find(ids[a]), find(ids[b])
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash_components(spark, docs):
    rows = [(r["doc_id"], simhash.fingerprint(simhash.shingle_hashes((r["text"] or "").encode()))) for r in docs.collect()]
    want = _components([f for _, f in rows], [i for i, _ in rows], 4)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    assert got == {i: (f"{f:016x}", want[i]) for i, f in rows}
    one = simhash.one_of_each_group(docs)
    assert one.columns == docs.columns and sorted(r["doc_id"] for r in one.collect()) == sorted(set(want.values()))
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("at_once", [64, 1 << 21])
def test_balls_meet_for_every_near_pair(monkeypatch, at_once):
    monkeypatch.setattr(simhash, "AT_ONCE", at_once)
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 40, 12, dtype=np.uint64)
    fp = np.concatenate([base] + [base ^ np.uint64(sum(1 << int(b) for b in rng.choice(20, k, replace=False))) for k in (1, 2, 3, 4, 5, 6)])
    found = set()

    def runs(variants, rows):
        same = np.flatnonzero(variants[1:] == variants[:-1])
        found.update(zip(rows[same].tolist(), rows[same + 1].tolist()))

    simhash.meet(np.arange(len(fp)), fp, np.full(len(fp), 2), 44, runs)
    forest = simhash.Forest(len(fp))
    a, b = map(np.array, zip(*found))
    assert (np.bitwise_count(fp[a] ^ fp[b]) <= 4).all()
    forest.join(a, b)
    want = _components([int(f) for f in fp], list(range(len(fp))), 4)
    assert forest.root.tolist() == [want[i] for i in range(len(fp))]


def test_components_of_chains_and_stars(spark):
    links = [(i + 1, i) for i in range(0, 60)] + [(i, 100) for i in range(101, 160)] + [(7, 7), (300, 200), (200, 300)]
    got = {r["_node"]: r["_root"] for r in simhash.components(spark.createDataFrame(links, "_a long, _b long"), "test").collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, **{i: 100 for i in range(101, 160)}, 300: 200}


@pytest.mark.parametrize("seed", range(40))
def test_bwt_classes(seed):
    rng = random.Random(seed)
    depth, parts = rng.choice([2, 5, 20]), []
    for _ in range(rng.randint(1, 12)):
        parts.append(bytes(rng.choice(b"ab\x00\xff") for _ in range(rng.randint(0, 60))) if rng.random() < 0.5 or not parts else parts[-1][rng.randint(0, 5) :] + b"a")
    keys = np.array([1000 * i for i in rng.sample(range(len(parts)), len(parts))], dtype=np.int64)
    first = {}
    for s, k in zip(parts, keys):
        for i in range(len(s) - depth + 1):
            first[s[i : i + depth]] = min(first.get(s[i : i + depth], 1 << 60), k + i)
    got = bwt.earlier_elsewhere(parts, keys, depth)
    assert [g.tolist() for g in got] == [[i for i in range(len(s) - depth + 1) if first[s[i : i + depth]] < k + i] for s, k in zip(parts, keys)]


def _shingle_set(text, words=5):
    own = (text or "").encode().lower().split()
    return {b" ".join(own[i : i + words]) for i in range(max(1, len(own) - words + 1))} if own else set()


def near_groups_by_force(rows, similarity=0.8):
    """{id: least id of its group} of (id, text), by comparing all pairs; also the number of pairs that are linked."""
    sets = [(i, s) for i, s in ((i, _shingle_set(t)) for i, t in rows) if s]
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = 0
    for k, (a, p) in enumerate(sets):
        for b, q in sets[:k]:
            if min(len(p), len(q)) >= similarity * max(len(p), len(q)) and len(p & q) >= similarity * len(p | q) - 1e-9:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
                links += 1
    return {i: find(i) for i, _ in sets}, links


def near_corpus(seed, n):
    """Texts with edited copies of many degrees, a group of edited copies of one text, and a passage that a third share."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8)))
    base, passage, rows = [word() for _ in range(120)], [word() for _ in range(30)], []
    for i in range(n):
        words = [word() for _ in range(rng.choice([3, 12, 40, 90, 200]))]
        if i % 4 == 1:
            words = base[:]
        elif i % 4 == 2 and i > 8:
            words = rows[rng.randrange(len(rows))][1].split()
        for _ in range(rng.choice([0, 1, 1, 2, 4]) if i % 4 in (1, 2) else 0):
            words[rng.randrange(len(words))] = word()
        rows.append((i, " ".join(words + passage * (i % 3 == 0))))
    return rows


@pytest.mark.parametrize("near", [8, 2])
def test_near_groups(spark, monkeypatch, near):
    from anomalypool.llm import near_text

    monkeypatch.setattr(near_text, "NEAR", near)
    rows = [*near_corpus(6, 300), (900, ""), (901, None), (902, "One two three"), (903, "one  TWO three"), (904, "one two"), (905, "A b c d e f g h i j"), (906, "a b c d e f g h i k")]
    want, links = near_groups_by_force(rows)
    df = spark.createDataFrame([(*r, "c", 1) for r in rows] + [(None, rows[0][1], "c", 1), (0, rows[0][1], "c", 1)], "doc_id long, text string, _node string, _id int").repartition(5)
    got = {r["doc_id"]: r["group_id"] for r in near_text.near_groups(df).collect()}
    assert links > 500 and set(got) == set(want)
    assert sum(got[i] == want[i] for i in want) >= 0.99 * len(want)  # a candidate at 0.8 is missed with a probability of 0.01
    assert all(want[got[i]] == want[i] for i in want)  # nothing is joined that does not hang together
    left = near_text.one_of_each_near_group(df)
    assert left.columns == df.columns and sorted(str(r["doc_id"]) for r in left.collect()) == sorted([*(str(i) for i in got if got[i] == i), "0", "900", "901", "None"])
    assert near_text.near_groups(df.limit(0)).count() == 0


def test_blocks_of_kin_lose_no_link(spark):
    """Crowds in one block or in many: the groups of brute force among all texts of a kin."""
    from anomalypool.llm import near_text

    rows = near_corpus(8, 300)
    want, links = near_groups_by_force(rows)
    df = spark.createDataFrame(rows, "_id long, _text string")
    nodes = near_text._prints(df).groupBy("_node").agg(F.min("_id").alias("_least"))
    crowd = nodes.select("_node", "_least", F.col("_node").alias("_comp"), F.lit(7).cast("long").alias("_kin"))
    least = {r["_node"]: r["_least"] for r in nodes.collect()}
    for block_bytes in (1500, 1 << 22):
        found = [(least[r["_a"]], least[r["_b"]]) for r in near_text._among_kin(crowd, df, block_bytes).collect()]
        group = {i: i for i in least.values()}
        for a, b in found:
            x, y = group[a], group[b]
            group = {i: min(x, y) if g in (x, y) else g for i, g in group.items()}
        assert links > 500 and group == {i: want[i] for i in group}
        assert block_bytes == 1500 or len(found) < len(group)  # a forest


def _removed(rows, length=100):
    seen, out = set(), {}
    for i, raw in sorted(rows):
        gone = np.zeros(len(raw), bool)
        for a in range(len(raw) - length + 1):
            if raw[a : a + length] in seen:
                gone[a : a + length] = True
            seen.add(raw[a : a + length])
        out[i] = (bytes(np.frombuffer(raw, np.uint8)[~gone]), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()))
    return out


@pytest.mark.parametrize("block", [2000, 1 << 20])
def test_suffix_dedup(spark, docs, monkeypatch, block):
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    want = _removed([(r["doc_id"], (r["text"] or "").encode()) for r in docs.collect()])
    got = {r["doc_id"]: (bytes(r["kept"]), r["n_removed"], r["n_spans"]) for r in suffix_dedup.deduplicated(docs).collect()}
    assert got == want and sum(n for _, n, _ in want.values()) > 5000
    left = suffix_dedup.without_repeats(docs)
    assert left.columns == docs.columns and {r["doc_id"]: r["text"] for r in left.collect()} == {i: k.decode("utf-8", "ignore") for i, (k, _, _) in want.items()}
    assert suffix_dedup.deduplicated(docs.limit(0)).count() == 0


def test_frequent_anchors_change_nothing(spark, docs, monkeypatch):
    want = {r["doc_id"]: bytes(r["kept"]) for r in suffix_dedup.deduplicated(docs).collect()}
    grams = [suffix_dedup.Anchors((r["text"] or "").encode(), 100, 48).grams for r in docs.collect() if len((r["text"] or "").encode()) >= 100]
    hot = np.unique(np.concatenate(grams))[::2]
    monkeypatch.setattr(suffix_dedup, "_frequent_anchors", lambda texts: (0, hot))
    assert {r["doc_id"]: bytes(r["kept"]) for r in suffix_dedup.deduplicated(docs).collect()} == want


def test_anchors_spread_over_buckets():
    raw = bytes(np.random.default_rng(2).integers(97, 123, 1 << 19, dtype=np.uint8))
    sizes = np.bincount(suffix_dedup._bucket(suffix_dedup.Anchors(raw, 100, 48).grams, 64), minlength=64)
    assert sizes.sum() > 10_000 and sizes.max() < 1.3 * sizes.mean()


def test_an_anchor_with_very_many_surroundings():
    rng = random.Random(4)
    gram = "".join(rng.choice("abcd") for _ in range(48))
    side = lambda: "".join(rng.choice("xy") for _ in range(52))
    segments = [(side() + gram + side()).encode() for _ in range(60)]
    segments += [s[: rng.randint(100, 152)] for s in segments[:30]]
    doc, lo = np.array([rng.randint(0, 40) for _ in segments]), np.arange(len(segments)) * 500
    want = suffix_dedup._late_strings(segments, doc, lo)
    got = suffix_dedup._late_by_bytes(segments, doc, lo)
    assert [g.tolist() for g in got] == [w.tolist() for w in want] and sum(map(len, want)) > 300


def test_suffix_dedup_of_repeated_and_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(80))
    df = spark.createDataFrame([(4, text), (4, text), (9, text), (None, text)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_removed"]) for r in suffix_dedup.deduplicated(df).collect()), key=str)
    assert got == sorted([(4, 0), (4, 0), (9, len(text)), (None, 0)], key=str)


def test_simhash_of_null_and_repeated_ids(spark):
    said = "one two three four five six"
    df = spark.createDataFrame([(4, said), (4, said), (None, said), (7, None), (8, ""), (9, "quite another thing to say here")], "doc_id long, text string").repartition(3)
    got = simhash.near_duplicates(df).collect()
    assert sorted((str(r["doc_id"]), r["component_id"]) for r in got if r["doc_id"] is not None) == [("4", 4), ("4", 4), ("7", 7), ("8", 7), ("9", 9)]
    assert [r["fingerprint"] for r in got if r["doc_id"] is None] == [r["fingerprint"] for r in got if r["doc_id"] == 4][:1]
