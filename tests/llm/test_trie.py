"""The prefix trie against nodes made by plain Python."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lumigrid.llm import queries, trie

COLUMNS = "conv_id long, turn long, role string, text string"


def crc(c):
    import zlib

    return zlib.crc32(str(c).encode())


def plain_turns(rows):
    of = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            of[c].append(((turn is not None, turn or 0), role or "", text or ""))
    return {c: [(r, t) for _, r, t in sorted(v)] for c, v in of.items()}


def plain_rebuilt(rows):
    own = plain_turns(rows)
    out = {}
    for c in own:
        h, base = crc(c) % 9, c - (abs(c) % 5) * (1 if c >= 0 else -1)
        out[c] = own.get(base, [])[:h] + own[c][h:]
    return out


def plain_trie(convs):
    members = defaultdict(list)
    for c, said in convs.items():
        for d in range(len(said) + 1):
            members[tuple(said[:d])].append(c)
    out = {}
    for p, m in members.items():
        below = [q for q in members if q[: len(p)] == p]
        leaves = [q for q in below if not any(len(x) == len(q) + 1 and x[: len(q)] == q for x in members)]
        ends = ",".join(map(str, sorted(c for c in m if len(convs[c]) == len(p))))
        out[(len(p), min(m))] = (
            min(members[p[:-1]]) if p else None, len(m), sum(len(x) == len(p) + 1 for x in below), len(leaves),
            sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below if q), hashlib.sha256(ends.encode()).hexdigest(),
        )
    return out


def made(spark, rows, name, tmp_path, columns=COLUMNS):
    spark.createDataFrame(rows, columns).write.parquet(f"{tmp_path}/{name}/conversations.parquet")
    got = queries.op11_prefix_trie(spark, f"{tmp_path}/{name}").collect()
    found = {(r.depth, r.conv_id): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in got}
    assert len(found) == len(got)
    return found


def test_random_conversations(spark, tmp_path):
    draw = random.Random(5)
    rows = []
    for c in [*range(-7, 60), 1000, 1003]:
        for turn in range(draw.choice([1, 2, 3, 5, 9, 14])):
            rows.append((c, draw.choice([None, turn, turn, turn]), draw.choice(["user", "user", None, ""]), draw.choice(["é", "é", "", None, "hello"])))
    rows += [(70 + k, t, "user", "same") for k in range(5) for t in range(12)]  # long copies
    rows += [(80 + k, t, "user", f"snapshot {t}") for k in range(12) for t in range(2 * k + 1)]  # a growing log
    draw.shuffle(rows)
    assert made(spark, rows, "random", tmp_path) == plain_trie(plain_rebuilt(rows))


def test_odd_rows(spark, tmp_path):
    """No conv_id, repeated rows, ties of turns, a conversation that loses all its turns,
    columns with the names of results, and an empty table."""
    lost = next(c for c in range(1, 400) if c % 5 and crc(c) % 9 > 2)
    rows = [(None, 1, "a", "b", 0), (lost, 1, "user", "x", 0), (lost, 1, "user", "x", 0), (lost + 1000, None, None, None, 1), (5, 2, "b", "2", 1), (5, 2, "a", "2", 1), (5, 2, "b", "1", 1)]
    got = made(spark, rows, "odd", tmp_path, COLUMNS + ", depth long")
    assert got == plain_trie(plain_rebuilt(rows))
    assert lost in {c for d, c in got if d == 0} | {min(plain_rebuilt(rows))}
    assert made(spark, [], "none", tmp_path) == {}


def test_rounds_do_not_matter(spark):
    rows = [(c, t, "user", f"{min(t, 3)} {c % 3 if t > 4 else 0}") for c in range(9) for t in range(3 + c)]
    turns = trie.marked(trie.numbered(spark.createDataFrame(rows, COLUMNS)))
    shown = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "n_ends"]
    one, many = (sorted(map(tuple, trie.build(turns, stride=s).nodes.select(shown).collect()), key=str) for s in (1, 64))
    assert one == many


def test_texts_of_nodes(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "bot", None), (2, 0, "user", "hi"), (2, 1, None, "ho")]
    turns = trie.numbered(spark.createDataFrame(rows, COLUMNS))
    shown = trie.with_turns(trie.build(trie.marked(turns)).nodes, turns).select("conv_id", "depth", "role", "text").collect()
    assert sorted(map(tuple, shown)) == [(1, 0, None, None), (1, 1, "user", "hi"), (1, 2, "bot", ""), (2, 2, "", "ho")]


@pytest.mark.parametrize("copies", [3000])
def test_a_hot_parent_and_a_hot_end(spark, copies):
    """A node with over a thousand children takes the other way to them."""
    turns = spark.range(copies).selectExpr("id AS conv_id", "explode(array(1, 2)) AS turn").selectExpr("conv_id", "turn", "'user' AS role", "CASE WHEN turn = 2 AND conv_id % 2 = 0 THEN cast(conv_id AS string) ELSE 'x' END AS text")
    built = trie.build(trie.marked(trie.numbered(turns)))
    nodes = {(r.depth, r.conv_id): r for r in built.nodes.collect()}
    assert len(nodes) == 3 + copies // 2 and nodes[1, 0].n_children == copies // 2 + 1 and nodes[0, 0].n_leaves == copies // 2 + 1
    assert {r.parent_conv_id for r in nodes.values() if r.depth == 2} == {0} and nodes[2, 1].n_ends == copies // 2
    want = hashlib.sha256(",".join(map(str, range(1, copies, 2))).encode()).hexdigest()
    assert trie.digests(built.ends).where(F.col("ends_sha256") == want).count() == 1
