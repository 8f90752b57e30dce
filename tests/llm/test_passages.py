"""Decontamination and license scans against plain Python."""

import hashlib
import random
import re
import tracemalloc

import pyarrow as pa

from lumigrid.llm import decontaminate, licenses
from lumigrid.llm.words import words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return WORD.findall((text or "").translate(LOWER))


def by_hand(text, items):
    doc, hit, found = tokens(text), set(), set()
    for item, passage in items:
        w = tokens(passage)
        n = min(10, len(w))
        for p in range(len(w) - n + 1 if n else 0):
            for at in range(len(doc) - n + 1):
                if doc[at : at + n] == w[p : p + n]:
                    hit |= set(range(at, at + n))
                    found |= {item}
    names = sorted(str(i) for i in found if i is not None)
    return len(doc), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest()


def case(seed):
    rng = random.Random(seed)
    vocabulary = ["a", "B", "ça", "x1", "é", "über", "the"]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, prose(rng.choice([0, 3, 9, 10, 11, 25]))) for i in range(12)] + [(3, None), (None, prose(12)), (100, "lone"), (7, "!!")]
    docs = [prose(rng.choice([0, 1, 5, 40, 300])) for _ in range(40)]
    docs += [f"{prose(5)}. {(t or '').upper()}, {prose(4)}-{t}" for _, t in items] + [None, "", "lone", "..", prose(30000)]
    return [(i // 2, d) for i, d in enumerate(docs)], items


def test_decontamination_equals_brute_force(spark):
    docs, items = case(1)
    docs = [(i, d) for i, d in docs if len(d or "") < 5000] * 2
    df = spark.createDataFrame([(i, d, "own") for i, d in docs], "doc_id long, text string, N_words string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for limit in (1 << 20, 300):  # one block of items, and several
        got = decontaminate.scan(df, bench, block_bytes=limit).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
        want = sorted((i, *by_hand(d, items), by_hand(d, items)[1] > 0) for i, d in docs)
        assert sorted(tuple(r) for r in got) == want


def test_decontamination_longest_match_and_edges(spark):
    item = " ".join(f"w{i}" for i in range(30))
    text = "x y " + " ".join(f"w{i}" for i in range(5, 25)) + " z"
    df = spark.createDataFrame([(1, text), (2, "w1 w2"), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(5, item)], "item_id long, text string")
    got = {r.doc_id: (r.longest_words, r.longest_at, r.longest_item) for r in decontaminate.scan(df, bench).collect()}
    assert got == {1: (20, 2, "5"), 2: (0, None, None), 3: (0, None, None)}
    assert [r.doc_id for r in decontaminate.remove(df, bench).orderBy("doc_id").collect()] == [2, 3]
    assert decontaminate.scan(df, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.scan(df.limit(0), bench).count() == 0


def test_long_text(spark):
    docs, items = case(2)
    text = docs[-1][1]
    row = decontaminate.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).first()
    assert (row.n_words, row.n_hit) == by_hand(text, items)[:2]


def plain_longest(text, items):
    """(words, first word, least item) of the longest verbatim match, by trying all."""
    doc, best = tokens(text), None
    for item, passage in items:
        w = tokens(passage)
        n = min(10, len(w))
        for p in range(len(w) - n + 1 if n else 0):
            for at in range(len(doc) - n + 1):
                k = 0
                while p + k < len(w) and at + k < len(doc) and w[p + k] == doc[at + k]:
                    k += 1
                if k >= n and item is not None and (best is None or (-k, at, item) < best):
                    best = (-k, at, item)
    return (0, None, None) if best is None else (-best[0], best[1], str(best[2]))


def test_longest_match_equals_brute_force(spark):
    docs, items = case(5)
    items = [(i, t) for i, t in items if i is not None]
    docs = [(k, d) for k, (_, d) in enumerate(docs) if len(d or "") < 900]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.longest_words, r.longest_at, r.longest_item) for r in decontaminate.scan(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert got == {i: plain_longest(d, items) for i, d in docs}


def test_repetitive_text_takes_little_memory(spark):
    """20,000 equal words against 4,000: pairs of places and suffixes would be eighty million."""
    texts, items = ["a " * 20_000, "a b " * 10_000, "b"], ["a " * 4_000, "a " * 4_000, "a b " * 2_000]
    tracemalloc.start()
    places = decontaminate.Suffixes([5, 5, 6], pa.array(items), decontaminate.WINDOW).search(words(pa.array(texts)))
    assert places.longest(places.items()) == {0: (4_000, 0, 0), 1: (4_000, 0, 2)} and places.hit().sum() == 40_000
    assert tracemalloc.get_traced_memory()[1] < 100 << 20
    tracemalloc.stop()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = decontaminate.scan(df, spark.createDataFrame(list(zip([5, 5, 6], items)), "item_id long, text string"))
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.longest_words, r.longest_at, r.longest_item) for r in found.collect()}
    assert got == {0: (20_000, 20_000, 1, 4_000, 0, "5"), 1: (20_000, 20_000, 1, 4_000, 0, "6"), 2: (1, 0, 0, 0, None, None)}


def test_license_base_equals_brute_force(spark):
    rng = random.Random(3)
    bits = ["under the MIT License", "apache license, version 2.0", "CC BY-NC 4.0", "cc by nc", "under", "the", "mit", "ünder the mit license", "licensed under cc by nc", "the MIT"]
    docs = [" ".join(rng.choice(bits) for _ in range(rng.randrange(12))) for _ in range(60)] + [None, "", "licenses!"]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    for r in licenses.scan(df).collect():
        w = tokens(docs[r.doc_id])
        at = [(i, label) for p, label in licenses.BASE_PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        starts = [i for i, _ in at]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), min(starts, default=None), max(starts, default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in at}))
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1


def test_template_regions(spark):
    template = "grant <<beginOptional>>of <<beginOptional>>full<<endOptional>> rights<<endOptional>> to <<var;name=who;words=1-3>> only"
    texts = {"Grant to Bob only": True, "grant of rights to a b c only": True, "grant of full rights to a only": True, "grant full rights to a only": False,
             "grant to only": False, "grant to a b c d only": False, "grant to a": False, "so grant, to only only": True, None: False}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = licenses.scan(df, phrases=(), templates=(("x", template),)).orderBy("doc_id").collect()
    assert [r.labels == "x" for r in got] == list(texts.values())
    assert licenses.scan(df.limit(0)).count() == 0


def filled(template):
    """A text that a template accepts: optional regions kept, replaceable ones filled."""
    text = re.sub(r"<<(?:begin|end)Optional>>", " ", template)
    return re.sub(r"<<var;name=(\w+);words=(\d+)-\d+>>", lambda m: " ".join([m[1]] * int(m[2])), text).split()


def test_whole_licenses_want_every_word():
    for label, template in licenses.TEMPLATES:
        automaton = licenses.compile_template(label, template)
        accepts = lambda w, a=automaton: a.accepts(licenses.word_hashes(" ".join(w)))
        whole = filled(template)
        # words outside all marks, by their place in the filled text
        marked = re.sub(r"<<beginOptional>>(?:(?!<<beginOptional>>).)*?<<endOptional>>", lambda m: f" {' '.join('?' * len(filled(m[0])))} ", template)
        while "<<beginOptional>>" in marked:
            marked = re.sub(r"<<beginOptional>>(?:(?!<<beginOptional>>).)*?<<endOptional>>", lambda m: f" {' '.join('?' * len(filled(m[0])))} ", marked)
        marked = re.sub(r"<<var;name=\w+;words=(\d+)-\d+>>", lambda m: f" {' '.join('?' * int(m[1]))} ", marked).split()
        assert len(marked) == len(whole)
        first = next(k for k, w in enumerate(marked) if w != "?")
        assert accepts(whole[first:]), label
        for k, w in enumerate(marked):
            if w != "?" and k > first:
                assert not accepts([*whole[first:k], "zzz", *whole[k + 1 :]]), (label, k, w)


def test_license_edges(spark):
    """Repeated rows, nulls, very long texts, and columns named as the results."""
    mit = " ".join(filled(licenses.TEMPLATES[0][1]))
    long = "word " * 200_000 + mit + " tail" * 100_000
    rows = [(1, mit, "own", 9.0), (1, mit, "own", 9.0), (None, mit.upper(), "x", None), (2, long, "x", 1.0), (3, None, "x", 1.0), (4, "", "x", 1.0), (5, mit.replace("merchantability", "value"), "x", 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, LABELS string, score double")
    got = licenses.scan(df)
    assert got.columns == ["doc_id", "text", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    found = sorted((str(r.doc_id), r.labels, r.score, r.n_words) for r in got.collect())
    n = len(mit.split())
    assert found == sorted([("1", "mit", 1.0, n), ("1", "mit", 1.0, n), ("None", "mit", 1.0, n), ("2", "mit", 1.0, n + 300_000), ("3", "", 0.0, 0), ("4", "", 0.0, 0), ("5", "", 0.0, n)])
