"""One query for each operator, over whole tables, and SQL where it can tell the same."""

from __future__ import annotations

import hashlib
import re

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumigrid.llm import ann, byte_bpe, chat, decontaminate, fim, licenses, neardup, quality, sentencepiece_lattice, token_records, toxicity, trie, warc
from lumigrid.llm.shared import shared_dir, table

#: Tokenizer files by name; on a cluster, every executor has the package that holds them.
TOKENIZER = public_tokenizers.path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = sentencepiece_lattice.Pieces.load(TOKENIZER("piece_bpe_32k.model"))
    coded = sentencepiece_lattice.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), pieces)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", "round_trip")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write(warc.records(_table(spark, sf_dir, "pages")), shared_dir(spark, "warc"))
    return warc.read(spark, archives, payload=False)


def op3_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    files = token_records.write(documents, shared_dir(spark, "tokens"), TOKENIZER("byte_bpe_50k.json"))
    return token_records.read(spark, files, ids=False)


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(_table(spark, sf_dir, "conversations"))


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    return ann.search(rows, rows.where("vec_id % 50 = 0"))


def op6_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(_table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(documents, _table(spark, sf_dir, "labels"))
    scored = toxicity.score(documents, model).drop("text")
    return scored.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", "predicted")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.scan(documents, _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest_words", "longest_at", "longest_item")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(trie.marked(trie.numbered(_table(spark, sf_dir, "conversations"))), "turns")
    c = F.col("conv_id")
    heads = turns.select("conv_id").distinct().select("conv_id", (c - c % 5).alias("base"), (F.crc32(c.cast("string").cast("binary")) % 9).alias("h"))
    built = trie.build(trie.spliced(turns, heads), heads.select("conv_id"))
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    shown = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    return built.nodes.join(trie.digests(built.ends), trie.KEY, "left").select(*shown, F.coalesce("ends_sha256", nothing).alias("ends_sha256"))


def op12_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.transform(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    digests = [F.sha2(x, 256).alias(name) for x, name in ((F.col("output"), "output_sha256"), (fim.restore(), "restored_sha256"))]
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = TOKENIZER("byte_bpe_50k.tiktoken")
    coded = byte_bpe.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), ranks, public_tokenizers.PATTERN).drop("text")
    back = byte_bpe.decode(coded, ranks)
    ids = F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256)
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {
    "op1_quality": op1_quality,
    "op2_warc": op2_warc,
    "op3_token_records": op3_token_records,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_ann": op5_ann,
    "op6_neardup": op6_neardup,
    "op7_decontaminate": op7_decontaminate,
    "op8_toxicity": op8_toxicity,
    "op9_chat": op9_chat,
    "op10_licenses": op10_licenses,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_fim": op12_fim,
    "op13_byte_bpe": op13_byte_bpe,
}

SQL: dict[str, str] = {
    # the records that a page must come back as; url as written into the archive's headers
    "op2_warc": """
WITH p AS (
    SELECT page_id, url, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
q AS (
    SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, url, payload_bytes, payload_digest,
    CASE WHEN payload_bytes < 100 OR page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN payload_bytes < 100 OR page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM q""",
    # prefixes compared as the turns themselves, nulls apart from empty text, not as hashes
    "op9_chat": """
WITH t AS (
    SELECT conv_id, turn, '<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS shown,
        coalesce(length(role) || ':' || role, '-') || coalesce(length(text) || ':' || text, '-') AS content,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS position,
        count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
p AS (
    SELECT conv_id, position, n, string_agg(content, '') OVER w AS prefix, string_agg(shown, '') OVER w AS text
    FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY position ROWS UNBOUNDED PRECEDING)),
whole AS (
    SELECT min(conv_id) AS conv_id, n AS n_turns, count(*) AS n_logs, prefix, any_value(text) AS text FROM p WHERE position = n GROUP BY n, prefix)
SELECT conv_id, n_turns, n_logs, text FROM whole w
WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.position < p.n AND p.position = w.n_turns AND p.prefix = w.prefix)""",
}

# ---- longer SQL --------------------------------------------------------------------

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: All windows of all items joined with all n-grams of all documents; runs of windows that
#: follow each other in both are the verbatim matches.
SQL["op7_decontaminate"] = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
item AS (SELECT item_id, w, least({decontaminate.WINDOW}, len(w)) AS n FROM b WHERE len(w) > 0),
pane AS (SELECT item_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS p FROM item)),
size AS (SELECT DISTINCT n FROM item),
gram AS (SELECT row, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM d, size)),
hit AS (SELECT row, item_id, n, i, p FROM gram JOIN pane USING (n, g)),
word AS (SELECT row, count(DISTINCT k) AS n_hit FROM (SELECT row, unnest(range(i, i + n)) AS k FROM hit) GROUP BY row),
own AS (SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT row, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY row),
run AS (SELECT row, item_id, min(i) - 1 AS place, count(*) + any_value(n) - 1 AS words
    FROM (SELECT *, i - row_number() OVER (PARTITION BY row, item_id, i - p ORDER BY i) AS k FROM hit) GROUP BY row, item_id, i - p, k),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY row ORDER BY words DESC, place, item_id) AS nth FROM run) WHERE nth = 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
    n_hit IS NOT NULL AS contaminated, coalesce(words, 0) AS longest_words, place AS longest_at, CAST(item_id AS VARCHAR) AS longest_item
FROM d LEFT JOIN word USING (row) LEFT JOIN own USING (row) LEFT JOIN best USING (row)"""


def _pattern(template: str) -> str:
    """A template as a regular expression over words that a space follows each."""
    out = ""
    for part in re.findall(r"<<.*?>>|[^<]+", template):
        if part == "<<beginOptional>>":
            out += "(?:"
        elif part == "<<endOptional>>":
            out += ")?"
        elif part.startswith("<<var"):
            low, high = re.search(r"words=(\d+)-(\d+)", part).groups()
            out += rf"(?:\S+ ){{{low},{high}}}"
        else:
            out += "".join(f"{w} " for w in part.split())
    return " " + out


_PLACES = {label: " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(phrase.split())) for phrase, label in licenses.BASE_PHRASES}
_FOUND = ", ".join(f"list_filter(range(1, len(w) - {phrase.count(' ') - 1}), lambda i: {_PLACES[label]}) AS p{k}" for k, (phrase, label) in enumerate(licenses.BASE_PHRASES))
_BASE = ", ".join(f"CASE WHEN len(p{k}) > 0 THEN '{label}' END" for k, (_, label) in enumerate(licenses.BASE_PHRASES))
_MORE = ", ".join(f"CASE WHEN regexp_matches(s, '{_pattern(t)}') THEN '{label}' END" for label, t in licenses.TEMPLATES)
_ALL = " || ".join(f"p{k}" for k in range(len(licenses.BASE_PHRASES)))

#: Templates as regular expressions over the words of a text.
SQL["op10_licenses"] = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
f AS (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS s, {_FOUND} FROM d),
l AS (SELECT doc_id, len(w) AS n_words, {_ALL} AS places, list_filter([{_BASE}], lambda x: x IS NOT NULL) AS base, list_filter([{_MORE}], lambda x: x IS NOT NULL) AS more FROM f)
SELECT doc_id, n_words, len(places) AS n_base, list_min(places) - 1 AS first_word, list_max(places) - 1 AS last_word,
    array_to_string(list_sort(list_distinct(base)), ',') AS base_labels, array_to_string(list_sort(list_distinct(base || more)), ',') AS labels,
    CASE WHEN len(more) > 0 THEN 1.0::DOUBLE WHEN len(places) > 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS score
FROM l"""


#: The checksum as its definition: eight shifts for each byte, on the polynomial's bits.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(CAST(conv_id AS VARCHAR)) + 1), lambda i: ascii(substr(CAST(conv_id AS VARCHAR), i, 1))::BIGINT)),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0::BIGINT, 1, 2, 3, 4, 5, 6, 7]), lambda v, k: xor(v >> 1, CASE WHEN v % 2 = 1 THEN 3988292384 ELSE 0 END))))"""

#: Prefixes compared as the turns themselves; a subtree is the nodes with a prefix that
#: their representative's path has.
SQL["op11_prefix_trie"] = f"""
WITH t AS (
    SELECT conv_id, strlen(coalesce(text, '')) AS bytes, length(coalesce(role, '')) || ':' || coalesce(role, '') || length(coalesce(text, '')) || ':' || coalesce(text, '') AS said,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k
    FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {_CRC} % 9 AS h FROM (SELECT DISTINCT conv_id FROM t)),
whole AS (
    SELECT ids.conv_id, 0 AS own, k, said, bytes FROM ids JOIN t ON t.conv_id = base AND k <= h
    UNION ALL SELECT ids.conv_id, 1, k, said, bytes FROM ids JOIN t ON t.conv_id = ids.conv_id AND k > h),
step AS (SELECT conv_id, said, bytes, row_number() OVER (PARTITION BY conv_id ORDER BY own, k) AS depth FROM whole),
way AS (
    SELECT conv_id, depth, bytes, string_agg(said, '') OVER (PARTITION BY conv_id ORDER BY depth ROWS UNBOUNDED PRECEDING) AS prefix FROM step
    UNION ALL SELECT conv_id, 0, 0, '' FROM ids),
path AS (SELECT *, lag(prefix) OVER w AS before, depth = max(depth) OVER (PARTITION BY conv_id) AS last FROM way WINDOW w AS (PARTITION BY conv_id ORDER BY depth)),
node AS (
    SELECT depth, prefix, any_value(before) AS before, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes, bool_and(last) AS leaf,
        coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE last), '') AS ends FROM path GROUP BY depth, prefix),
under AS (
    SELECT p.depth, p.prefix, sum(CAST(w.leaf AS BIGINT)) AS n_leaves, sum((w.n_convs - 1) * w.bytes) AS saved_tokens
    FROM node w JOIN path p ON p.conv_id = w.conv_id AND p.depth <= w.depth GROUP BY p.depth, p.prefix),
kids AS (SELECT depth - 1 AS depth, before AS prefix, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY ALL)
SELECT n.conv_id, n.depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
    CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM node n JOIN under USING (depth, prefix) LEFT JOIN kids USING (depth, prefix) LEFT JOIN node up ON up.depth = n.depth - 1 AND up.prefix = n.before"""

#: Units as list elements.
SQL["op12_fim"] = """
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
    FROM documents),
g AS (SELECT *, len(u) AS n, list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(h, i, 8))::BIGINT) AS r FROM d),
c AS (
    SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) AS a, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS b,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR r[3] % 100 >= 90 THEN 'plain' WHEN r[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
    FROM g),
p AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:n], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
    sha256(text) AS restored_sha256
FROM p"""
