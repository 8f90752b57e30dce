"""The Kneser-Ney model against plain Python, SentencePiece against the library."""

import itertools
import math
import random
from collections import Counter, defaultdict

import pytest
import sentencepiece

from lumigrid.llm import quality
from lumigrid.llm import sentencepiece_lattice as lattice

MODEL = "/opt/tokenizers/piece_bpe_32k.model"


# ---- quality -----------------------------------------------------------------------


def kneser_ney(texts, order):
    """p(gram) of interpolated modified Kneser-Ney, by the book."""
    pad = [b"\0" * (order - 1) + t.encode() for t in texts]
    counts = {order: Counter(t[i : i + order] for t in pad for i in range(len(t) - order + 1))}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    off, total, kinds = {}, {}, {}
    for k, c in counts.items():
        n = Counter(c.values())
        if all(n[i] for i in (1, 2, 3, 4)):
            y = n[1] / (n[1] + 2 * n[2])
            off[k] = [min(max(d, 0), i + 1) for i, d in enumerate((1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3]))]
        else:
            off[k] = [0.5, 1.0, 1.5]
        total[k], kinds[k] = Counter(), defaultdict(Counter)
        for g, v in c.items():
            total[k][g[:-1]] += v
            kinds[k][g[:-1]][min(v, 3)] += 1

    def p(g):
        k = len(g)
        below = p(g[1:]) if k > 1 else 1 / 256
        if not total[k][g[:-1]]:
            return below
        c = counts[k][g]
        freed = sum(off[k][i - 1] * m for i, m in kinds[k][g[:-1]].items())
        return (max(c - off[k][min(c, 3) - 1], 0) * (c > 0) + freed * below) / total[k][g[:-1]]

    return p


def test_perplexity_equals_plain_python(spark, tmp_path):
    rng = random.Random(1)
    words = ["the", "of", "été", "strange", "an", "x", "y!"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 30))), rng.choice(["en", "fr", None])) for i in range(120)] + [(500, "\x01Q%$" * 9, "en"), (501, "", "en"), (502, None, "fr"), (503, "zz" * 40_000, "fr")]
    labels = [(i, 1, 0) for i in range(90)] + [(500, 0, 0), (7, 1, 1), (None, 1, 0)]
    frame = spark.createDataFrame([(*d, 1) for d in docs + docs[:3]], "doc_id long, text string, lang string, PERPLEXITY int").repartition(3)
    frame.write.parquet(str(tmp_path / "d"))
    read = spark.read.parquet(str(tmp_path / "d"))
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    import zlib

    train = [t or "" for i, t, _ in docs + docs[:3] if i < 90 and zlib.crc32(str(i).encode()) % 5]
    p = kneser_ney(train, 3)
    for source in (read, frame):  # a plain read, and rows that come from no file
        got = quality.score(source, marks, order=3).collect()
        assert len(got) == len(docs) + 3
        text = {i: t or "" for i, t, _ in docs}
        for r in got:
            b = b"\0\0" + text[r.doc_id].encode()
            if r.doc_id == 503:
                assert not r.keep
                continue
            want = -sum(math.log(p(b[i : i + 3])) for i in range(len(b) - 2))
            assert (r.perplexity is None) == (r.n_bytes == 0)
            if r.n_bytes:
                assert r.perplexity == pytest.approx(math.exp(want / r.n_bytes), rel=1e-4)
    assert {r.doc_id for r in got if not r.keep} == {500, 503}
    kept = quality.keep(read, marks, order=3)
    assert kept.columns == read.columns and kept.count() == len(docs) + 1
    assert quality.keep(read, marks.limit(0)).count() == read.count()
    assert quality.keep(frame.limit(0), marks).count() == 0


def test_decisions_equal_plain_python(spark, tmp_path):
    """Thresholds by hand: the quantile of held-out trusted documents of the language, of
    all where there are few, and nats of room over the whole text."""
    import zlib

    rng = random.Random(7)
    words = ["the", "of", "some", "strange", "an", "x", "y!", "été"]
    lang = lambda i: "en" if i % 4 else rng.choice(["fr", None])
    docs = [(i, " ".join(rng.choice(words + ["".join(rng.choices("qzjk", k=3))] * (i % 3)) for _ in range(rng.randrange(1, 40))), lang(i)) for i in range(400)] + [(900, "", "en"), (901, None, "fr")]
    labels = [(i, int(i % 5 != 4), 0) for i in range(0, 300)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3).write.parquet(str(tmp_path / "d"))
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    trusted = {i for i, q, _ in labels if q == 1}
    held = {i for i in trusted if zlib.crc32(str(i).encode()) % 5 == 0}
    p = kneser_ney([t or "" for i, t, _ in docs if i in trusted - held], 2)
    loss, size = {}, {}
    for i, t, _ in docs:
        b = b"\0" + (t or "").encode()
        loss[i], size[i] = -sum(math.log(p(b[k : k + 2])) for k in range(len(b) - 1)), len(b) - 1
    of = {i: g for i, _, g in docs}
    share, margin, room = 0.8, 1.5, 1.05

    def line(some):
        perplexities = sorted(math.exp(loss[i] / size[i]) for i in some if size[i])
        return perplexities[math.ceil(share * len(perplexities)) - 1]

    lines = {g: line(m) for g in set(of.values()) if len(m := [i for i in held if of[i] == g and size[i]]) >= quality.LEAST}
    assert "en" in lines and len(lines) < 3  # both kinds of languages occur
    want = {i: not size[i] or loss[i] <= size[i] * math.log(lines.get(of[i], line(held)) * room) + margin for i in of}
    got = quality.score(spark.read.parquet(str(tmp_path / "d")), marks, order=2, quantile=share, room=room, margin=margin).collect()
    assert {r.doc_id: r.keep for r in got} == want and 0 < sum(want.values()) < len(want)


def test_probabilities_sum_to_one(spark):
    train = Counter("abracadabra abc"[i : i + 2] for i in range(14))
    rows = [(ord(g[0]) << 8 | ord(g[1]), n) for g, n in train.items()] + [(ord("a") << 8 | k, 0) for k in range(256) if chr(k) not in {g[1] for g in train if g[0] == "a"}]
    p = quality.probabilities(spark.createDataFrame(rows, "gram long, n long"), 2).where(f"shiftright(gram, 8) = {ord('a')}")
    assert p.agg({"p": "sum"}).first()[0] == pytest.approx(1.0)


# ---- SentencePiece -----------------------------------------------------------------


def test_bpe_equals_library(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(3)
    bits = ["hello", "World", "straße", "日本語", "🎉", "  ", "\n", "\t", "...", "x²", "1234", "été", "▁", " ", "intèrnätiønål", "()", "don't", "a" * 70, " " * 40]
    texts = ["".join(rng.choice(bits) + rng.choice(["", " "]) for _ in range(rng.randrange(12))) for _ in range(150)] + [None, "", " ", "word " * 30_000, "q" * 20_000]
    df = spark.createDataFrame([(i, t, 0.5) for i, t in enumerate([*texts, texts[0]])], "doc_id long, text string, IDS double")
    pieces = lattice.Pieces.load(MODEL)
    coded = lattice.encode(df, pieces)
    assert coded.columns == ["doc_id", "text", "ids", "round_trip"]
    for r in coded.collect():
        assert r.ids == library.encode(r.text or ""), r.text
        assert r.round_trip == ("▁" not in (r.text or ""))
    for r in lattice.decode(coded, pieces).collect():
        assert r.decoded == (r.text or "").replace("▁", " ")
    assert lattice.encode(df.limit(0), pieces).count() == 0
    assert [r.decoded for r in lattice.decode(spark.createDataFrame([(None,), ([],), ([10**6, -1, None],)], "ids array<int>"), pieces).collect()] == [None, "", ""]


def test_viterbi_equals_all_segmentations(spark):
    rng = random.Random(5)
    rows = [("<unk>", 0, 0.0, 2)] + [(p, k + 1, round(-rng.uniform(1, 9), 3), 1) for k, p in enumerate(["a", "b", "ab", "ba", "aab", "bab", "▁", "▁a", "▁ab", "abab"])]
    pieces = lattice.Pieces(rows, lattice.UNIGRAM, True)
    scores = {p: s for p, _, s, t in rows if t == 1}
    lowest = min(scores.values()) - 10
    units = ["▁" + "".join(rng.choice("aabbc") for _ in range(rng.randrange(8))) for _ in range(60)]
    for r in lattice.encode_units(spark.createDataFrame([(u,) for u in sorted(set(units))], "unit string"), pieces).collect():
        best = max(
            sum(scores.get(w, lowest if len(w) == 1 else -1e9) for w in (r.unit[a:b] for a, b in itertools.pairwise((0, *cut, len(r.unit)))))
            for k in range(len(r.unit)) for cut in itertools.combinations(range(1, len(r.unit)), k)
        )
        names = {k: p for p, k, _, _ in rows}
        assert sum(scores[names[i]] if i else lowest for i in r.ids) == pytest.approx(best)
        assert sum(len(names[i]) if i else 1 for i in r.ids) == len(r.unit)


def test_plans_hold_one_order(spark):
    """However many orders: what the driver plans again after each stage is the last one."""
    rows = [(k * 7919 % (1 << 40), k % 4) for k in range(3000)]
    p = quality.probabilities(spark.createDataFrame(rows, "gram long, n long"), 5)
    assert p._jdf.queryExecution().optimizedPlan().toString().count("Join") <= 3


def test_lattice_looks_only_at_pieces_that_can_cross(spark):
    """They are bound as numbers and once for a unit, without a copy for each place."""
    pieces = lattice.Pieces.load(MODEL)
    coded = lattice.encode_units(spark.createDataFrame([("▁the",), ("▁a",), ("▁xqzÿ",)], "unit string"), pieces)
    plan = coded._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(array(") == 1
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert {r.unit: r.ids for r in coded.collect()} == {u: pieces.long_unit(library, u.replace("▁", " ")) for u in ("▁the", "▁a", "▁xqzÿ")}
