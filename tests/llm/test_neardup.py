"""Near-duplicates against all pairs in plain Python."""

import random
import re
from collections import Counter

import numpy as np

from lumigrid.llm import neardup
from lumigrid.llm.words import shingles, words

import pyarrow as pa

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def bag(text):
    w = WORD.findall((text or "").lower())
    return Counter(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1 if w else 0)))


def similarity(a, b):
    union = sum((a | b).values())
    return sum((a & b).values()) / union if union else 0.0


def brute(docs):
    root = {i: i for i, _ in docs if i is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    bags = [(i, t or "", bag(t)) for i, t in docs if i is not None]
    for k, (i, t, x) in enumerate(bags):
        for j, s, y in bags[:k]:
            if t == s or similarity(x, y) >= 0.8:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in root}


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["É", "ß9"]
    docs = [[rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 5, 30, 120, 400]))] for _ in range(50)]
    for _ in range(120):
        d = list(rng.choice(docs))
        for _ in range(rng.choice([0, 1, 1, 2, 5])):
            d[rng.randrange(len(d))] = rng.choice(vocabulary)
        docs.append(d)
    base = [rng.choice(vocabulary) for _ in range(150)]
    for k in range(60):  # one group of near copies
        d = list(base)
        for _ in range(k % 4):
            d[rng.randrange(150)] = "x"
        docs.append(d)
    docs += [["same", "line", "again", "and", "on"] * 40, ["same", "line", "again", "and", "on"] * 45, ["same", "line", "again", "and", "on"] * 90]
    texts = [" ".join(d) for d in docs] + ["", None, "...", "...", "!!"]
    rng.shuffle(texts)
    return list(enumerate(texts)) + [(3, texts[3]), (None, "a b c d e f"), (None, None)]


def test_classes_equal_brute_force(spark):
    docs = corpus(1)
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, class_id int")
    want = brute(docs)
    for block in (neardup.BLOCK, 7):  # buckets as one block, and cut into many
        got = neardup.classes(df, block=block).collect()
        assert len(got) == len(docs)
        assert {r.doc_id: r.class_id for r in got if r.doc_id is not None} == want
        assert all(r.class_id is None for r in got if r.doc_id is None)
    kept = neardup.deduplicate(df).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted([*map(str, set(want.values())), "None", "None"])
    assert all((r.doc_id, r.text) in docs for r in kept)


def test_ids_with_several_texts(spark):
    """Rows of one id are one document, whatever the order of its rows."""
    words = lambda seed: [f"{seed}{k}" for k in range(60)]
    near = lambda w: " ".join([*w[:59], "other"])
    a, b = words("a"), words("b")
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, near(b)), (3, near(a)), (4, "alone"), (5, "x y"), (5, "alone"), (0, "x y"), (7, "z")]
    for order in (rows, rows[::-1], rows[3:] + rows[:3]):
        df = spark.createDataFrame(order, "doc_id long, text string").coalesce(1)
        got = {(r.doc_id, r.class_id) for r in neardup.classes(df).collect()}
        assert got == {(1, 1), (2, 1), (3, 1), (0, 0), (4, 0), (5, 0), (7, 7)}
        assert sorted(r.doc_id for r in neardup.deduplicate(df).collect()) == [0, 1, 7]


def test_empty_and_long(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert neardup.classes(df).count() == 0 and neardup.deduplicate(df).count() == 0
    long = " ".join(f"t{i}" for i in range(60_000))
    df = spark.createDataFrame([(1, long), (2, long + " more"), (3, "t1 t2 t3 t4 t5"), (4, "T1, t2; t3 t4 t5")], "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in neardup.classes(df).collect()} == {1: 1, 2: 1, 3: 3, 4: 3}


def test_signature_estimates_weighted_similarity():
    darts, rng = neardup.Darts(128), np.random.default_rng(0)
    error = []
    for _ in range(60):
        key = rng.integers(0, 1 << 62, 80).astype(np.uint64)
        a, b = rng.integers(0, 5, 80).astype(float), rng.integers(0, 5, 80).astype(float)
        b[:50] = a[:50]
        sets = [(key[w > 0], w[w > 0]) for w in (a, b)]
        made = darts.signatures(*[np.concatenate([s[k] for s in sets]) for k in (0, 1)], np.repeat([0, 1], [len(s[0]) for s in sets]), 2)
        error.append((made[0] == made[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(error)) < 0.02 and np.std(error) < 0.06


def test_components_of_a_path_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    random.Random(2).shuffle(edges)
    got = {r.id: r.class_id for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 140)}
    assert neardup.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_vertices_with_many_edges(spark):
    """Hubs of more edges than one task should take are joined by sending them."""
    edges = [(0, i) for i in range(1, 2500)] + [(5000, i) for i in range(5001, 7500)] + [(7, 5001), (9000, 9001)]
    random.Random(3).shuffle(edges)
    got = {r.id: r.class_id for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len(got) == 2500 + 2500 + 2 and all(c == (9000 if i >= 9000 else 0) for i, c in got.items())


def test_shingles_of_short_texts():
    key, text = shingles(words(pa.array(["a b c d e f", "a b", None, "A, b"])), 5)
    assert text.tolist() == [0, 0, 1, 3] and key[2] == key[3]


def test_one_text_of_an_id_whatever_the_order(spark):
    """Rows of one id with several texts, and repeated rows that differ elsewhere."""
    words = ["one two three four five six", "seven eight nine ten eleven twelve", "red green blue black white grey"]
    rows = [(1, words[0], "a"), (1, words[1], "b"), (2, words[2], "c"), (1, words[0], "d"), (2, words[2], "c"), (None, words[2], "e"), (1, None, "f")]
    kept = []
    for order in (rows, rows[::-1], rows[3:] + rows[:3]):
        df = spark.createDataFrame(order, "doc_id long, text string, source string").coalesce(1)
        kept.append(sorted(map(tuple, neardup.deduplicate(df).collect()), key=str))
    assert kept[0] == kept[1] == kept[2] and [r[0] for r in kept[0]] == [1, 2, None]
