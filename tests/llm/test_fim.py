"""Fill-in-the-middle against units cut by a regular expression."""

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumigrid.llm import fim

SCHEMA = "doc_id long, text string"


def plain(doc_id, text, seed=1):
    text = text or ""
    u = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(u)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in fim.MARKS) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="aZ é<>PSM?\n😀1", max_size=40))
def test_units(text):
    scan = fim.Scanner()
    units, want = scan(text), re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    assert len(units) == len(want)
    assert [units.place(k) for k in range(len(want) + 1)] == [len("".join(want[:k])) for k in range(len(want) + 1)]
    assert units.marked == any(m in text for m in fim.MARKS)


TEXTS = [None, "", "x", "é", "ab<P", "<P>ab", "a<<S>b", "one two  three\n", "日本 語ab1", "😀a😀", "A" * 5000, "a b" * 4000, "<", "<S", ">M>"]


def test_documents(spark):
    """Null keys and texts, empty and long texts, repeated rows, clashing names."""
    rows = [(k, t, "kept", 7) for k, t in enumerate(TEXTS * 40)] + [(None, "no key here", None, 1), (3, "twice é x", "a", 2), (3, "twice é x", "a", 2)]
    docs = spark.createDataFrame(rows, SCHEMA + ", Output string, extra int")
    made = fim.transform(docs).withColumn("back", fim.restore()).repartition(3)
    assert made.columns == ["doc_id", "text", "extra", "n", "form", "prefix_chars", "middle_chars", "output", "back"]
    got = sorted(((r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in made.collect()), key=str)
    assert got == sorted(((d, t, *plain(d, t)) for d, t, *_ in rows), key=str)
    assert {r[3] for r in got} == {"plain", "psm", "spm"}
    assert made.where("back <> coalesce(text, '')").count() == 0
    assert fim.transform(docs.limit(0)).count() == 0


def test_other_marks_and_rates(spark):
    docs = spark.createDataFrame([(k, f"some words {k} and <P> more") for k in range(50)], SCHEMA)
    marks = ("<PRE>", "<SUF>", "<MID>")
    made = fim.transform(docs, percent=100, spm_percent=100, marks=marks)
    assert made.where("form <> 'spm' OR output NOT LIKE '<SUF>%<PRE>%<MID>%'").count() == 0
    assert made.where(fim.restore(marks=marks) != F.col("text")).count() == 0
    with pytest.raises(ValueError):
        fim.Scanner(("[x]",))
