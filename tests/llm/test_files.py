"""Archives, token records and chat logs: round trips and plain Python."""

import gzip
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lumigrid.llm import chat, token_records, warc

BPE = "/opt/tokenizers/byte_bpe_50k.json"


# ---- WARC --------------------------------------------------------------------------


def page_rows():
    rng = random.Random(5)
    big = ["x" * 100, "ü" * 60, "".join(rng.choice("abc<>\n") for _ in range(5000)), gzip.compress(b"q" * 300).decode("latin1")]
    rows = [(i, f"http://h/{i}?a=b c", rng.choice([*big, "small", "", None])) for i in range(80)]
    return rows + rows[:6] + [(None, None, big[0]), (None, "u", None), (200, "é\n", "WARC/1.1\r\n\r\n" * 20)]


def expected(rows):
    out, first = [], {}
    for i, _, h in rows:
        if len((h or "").encode()) >= 100 and i is not None:
            first[h] = min(first.get(h, i), i)
    seen = set()
    for i, _, h in rows:
        b = (h or "").encode()
        again = len(b) >= 100 and (i != first[h] or h in seen)
        seen |= {h} if i == first.get(h) else set()
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[h] if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("split", [64 << 20, 700, 60])
def test_warc_round_trip(spark, tmp_path, split):
    rows = page_rows()
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, payload_bytes int")
    files = warc.write(warc.records(df), str(tmp_path / "w"), archive=3000)
    assert len(files) > 2
    got = warc.read(spark, files, split=split).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == expected(rows)
    assert {bytes(r.payload) for r in got if r.payload is not None} == {(h or "").encode() for _, _, h in rows}
    assert warc.archives_in(spark, f"{tmp_path}/w/*.warc.gz") == [(f"file:{p}", n) for p, n in files]
    for path, _ in files:  # any gzip reader sees the records in a row
        assert gzip.open(path).read().startswith(b"WARC/1.1\r\n")


def test_warc_empty_and_damaged(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read(spark, warc.write(warc.records(df), str(tmp_path / "e"))).count() == 0
    df = spark.createDataFrame([(i, "u", str(i) * 3000) for i in range(5)], "page_id long, url string, html string").coalesce(1)
    ((path, size),) = warc.write(warc.records(df).coalesce(1), str(tmp_path / "d"))
    raw = bytearray(open(path, "rb").read())
    raw[size // 2] ^= 255
    open(path, "wb").write(raw)
    with pytest.raises(Exception):
        assert warc.read(spark, [(path, size)]).count() == 5


def test_urls_come_back_as_they_were(spark, tmp_path):
    urls = ["http://a/b c", " lead", "trail\u00a0", "tab\there", "é", None, "", "line\nend\r\n", "%20", "x"]
    df = spark.createDataFrame([(i, u, f"page {i}") for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = {r.page_id: r.url for r in warc.read(spark, warc.write(warc.records(df), str(tmp_path / "u"))).collect()}
    assert got == dict(enumerate(urls))


def test_ranges_smaller_than_records(spark, tmp_path):
    """Every record is read once, however ranges cut the archive."""
    rng = random.Random(8)
    df = spark.createDataFrame([(i, "u", "".join(map(chr, rng.choices(range(32, 500), k=rng.choice([0, 10, 5000, 90_000]))))) for i in range(60)], "page_id long, url string, html string")
    archives = warc.write(warc.records(df).coalesce(2), str(tmp_path / "r"))
    for split in (700, 5_000, 1 << 30):
        got = warc.read(spark, archives, split=split, payload=False) if split > 700 else warc.read(spark, archives[:1], split=split)
        want = df.count() if split > 700 else warc.read(spark, archives[:1]).count()
        assert got.count() == got.select("page_id").distinct().count() == want


# ---- token records -----------------------------------------------------------------


def test_crc32c_known_values():
    data = np.frombuffer(b"123456789" + bytes(32) + b"123456789" * 100, np.uint8)
    got = token_records.masked_crc32c(data, np.array([0, 9, 41]), np.array([9, 41, 941]))
    mask = lambda c: (((c >> 15) | (c << 17)) + 0xA282EAD8) & 0xFFFFFFFF
    assert got[0] == mask(0xE3069283) and got[1] == mask(0x8A9136AA)
    crc = 0xFFFFFFFF
    for b in data[41:]:
        crc = int(token_records._table[(crc ^ int(b)) & 255]) ^ (crc >> 8)
    assert got[2] == mask(crc ^ 0xFFFFFFFF)


LIBRARY, OWN = Tokenizer.from_file(BPE), token_records.Encoder(BPE)
OWN.memo.most = 60  # forgets often


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\r\x85\xa0\x1c a'sé²½Ⅷ9_.!日\U0001f600"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_encoder_equals_library(text):
    ids, ends = OWN.encode(pa.array([text, None, text]))
    assert ids.tolist() == LIBRARY.encode(text, add_special_tokens=False).ids * 2 and ends.tolist() == [0, len(ids) // 2, len(ids) // 2, len(ids)]


def test_token_records_round_trip(spark, tmp_path):
    rng = random.Random(2)
    words = ["The", "  ", "naïve", "it's", "\n\n", "<|endoftext|>", "x" * 50, "日本", "12345"]
    docs = [(i // 3 - 5, " ".join(rng.choice(words) for _ in range(rng.randrange(40)))) for i in range(150)]
    docs += [(None, "none"), (4, None), (4, None), (999, ""), (998, "long text " * 40_000)]
    df = spark.createDataFrame([(i, t, 7) for i, t in docs], "doc_id long, text string, start int")
    files = token_records.write(df, str(tmp_path / "t"), BPE)
    got = token_records.read(spark, files, piece=2000).orderBy("start").collect()
    ids = lambda t: [*LIBRARY.encode(t or "", add_special_tokens=False).ids, 0]
    assert [r.doc_id for r in got] == sorted((i for i, _ in docs), key=lambda i: (i is not None, i or 0))
    at = 0
    for r in got:
        assert (r.start, r.n_tokens) == (at, len(r.ids))
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
    assert sorted((str(r.doc_id), r.ids) for r in got) == sorted((str(i), ids(t)) for i, t in docs)
    path, n = files[0][1], files[0][2]
    shuffled = rng.sample(range(n), min(n, 9))
    assert [(i, x.tolist()) for i, x in token_records.fetch(path, shuffled)] == [(got[k].doc_id, got[k].ids) for k in shuffled]
    assert token_records.read(spark, token_records.write(df.limit(0), str(tmp_path / "n"), BPE)).count() == 0
    raw = bytearray(open(path, "rb").read())
    raw[-9] ^= 1
    open(path, "wb").write(raw)
    with pytest.raises(Exception, match="checksum"):
        token_records.read(spark, files).count()


# ---- chat --------------------------------------------------------------------------


def test_chat_keeps_maximal_conversations(spark):
    rng = random.Random(4)
    logs = {}
    for i in range(200):
        base = logs[rng.randrange(i)][: rng.randrange(1, 9)] if i and rng.random() < 0.6 else []
        logs[i] = base + [(rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "", None])) for _ in range(rng.randrange(0 if base else 1, 4))]
    rows = [(i, k, role, text, "x") for i, turns in logs.items() for k, (role, text) in enumerate(turns)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n_turns string")
    got = {r.conv_id: (r.n_turns, r.n_logs, r.text) for r in chat.render(df).collect()}
    want = {}
    for i, turns in logs.items():
        same = [j for j, other in logs.items() if other == turns]
        if i == min(same) and not any(len(o) > len(turns) and o[: len(turns)] == turns for o in logs.values()):
            want[i] = (len(turns), len(same), "".join(f"<|im_start|>{r or ''}\n{t or ''}<|im_end|>\n" for r, t in turns))
    assert got == want


def test_chat_edges(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert chat.render(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, 0, "user", None), (2, 0, None, "user"), (3, 0, "user", ""), (None, 0, "user", "z"), (None, 1, "user", "z"), (4, 0, "user", "z"), (5, 0, "user", "z"), (5, 0, "user", "z"), (6, None, "w" * 100_000, "y" * 300_000)]
    got = {r.conv_id: (r.n_turns, r.n_logs) for r in chat.render(spark.createDataFrame(rows, schema)).collect()}
    # conversation 4 is a prefix of the one without an id, which equals conversation 5
    assert got == {1: (1, 1), 2: (1, 1), 3: (1, 1), 5: (2, 2), 6: (1, 1)}
