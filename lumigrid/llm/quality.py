"""Quality by perplexity under an n-gram model of trusted text.

The model is interpolated modified Kneser-Ney. Its units are the bytes of UTF-8, so that
every language has the same closed alphabet of 256 and an n-gram is one number; a text's
first units follow n-1 zero bytes. Counts are rows, spread over the cluster by n-gram, and
the probability of each n-gram that occurs in the corpus comes from equi-joins with the
counts of its suffixes and contexts, order after order. What a block of documents needs of
them is then written beside the block (see blocks.py), so that texts are never shuffled.
Documents whose perplexity is above a quantile of trusted documents of their language,
with some room, are of low quality. A fifth of the trusted documents sets the quantiles
and is kept out of the counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumigrid.llm.blocks import blocked, by_block, read_beside, without, write_beside
from lumigrid.llm.shared import table
from lumigrid.llm.words import slices, small_batches, utf8

ORDER = 5
#: The quantile of trusted documents, and how far above it a perplexity may be.
QUANTILE, ROOM = 0.99, 1.0
#: Nats of loss that are no evidence: a few bytes can be unlikely by chance.
MARGIN = 6.0
#: A language with fewer trusted documents to calibrate on takes the quantile of all.
LEAST = 20
ALPHABET = 256
#: Bytes of text whose n-grams a task holds at once, at some forty bytes each.
SLICE = 1 << 18
#: N-grams of a block that go back to Spark at once.
SENT = 1 << 16


def grams(data: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """The n-gram that ends at each byte of the texts data[at[i]:at[i+1]], as one number."""
    out = data.astype(np.uint64)
    for k in range(1, n):
        before = data[:-k].astype(np.uint64)  # by one number for each byte at a time: memory is what a worker has little of
        before <<= np.uint64(8 * k)
        out[k:] |= before
    for k in range(n - 1):  # what stands before a text are zeros
        first = at[:-1][at[1:] - at[:-1] > k] + k
        out[first] &= np.uint64((1 << 8 * (k + 1)) - 1)
    return out.view(np.int64)


def _rows(docs: DataFrame, doc_id: str, text: str, lang: str) -> DataFrame:
    """block, doc, text, lang and key, which tells rows apart."""
    words = F.coalesce(F.col(text).cast("string"), F.lit(""))
    own = docs.select("block", F.col(doc_id).cast("long").alias("doc"), words.alias("text"), F.col(lang).cast("string").alias("lang"))
    return own.withColumn("key", row_key(F.col("doc"), F.col("text")))


def row_key(doc, text):
    """What tells rows apart; rows with one key have one id and text."""
    return F.xxhash64(doc.isNull(), doc, text)


def _trusted(rows: DataFrame, labels: DataFrame, doc_id: str, label: str, every: DataFrame) -> str:
    good = labels.where(F.col(label) == 1).select(F.col(doc_id).cast("long").alias("doc")).where("doc is not null").distinct()
    fold = F.crc32(F.col("doc").cast("string").cast("binary")) % 5 == 0
    return write_beside(rows.select("block", "doc").join(good, "doc").select("block", "doc", fold.alias("calibrates")), "trusted", "doc", every)


def _flags(folder: str, block: int, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether documents are trusted, and whether they calibrate."""
    found = read_beside(folder, block, "doc")
    if not found.num_rows:
        return np.zeros(len(docs), bool), np.zeros(len(docs), bool)
    ids, fold = found["doc"].to_numpy(), found["calibrates"].to_numpy(zero_copy_only=False)
    spot = np.minimum(np.searchsorted(ids, docs), len(ids) - 1)
    there = ids[spot] == docs
    return there, there & fold[spot]


def _ids(piece: pa.RecordBatch) -> np.ndarray:
    """Document ids; null as a number that is no key of a label."""
    return piece.column(piece.schema.get_field_index("doc")).fill_null(np.iinfo(np.int64).min).to_numpy()


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers of all parts, sorted, and the sums of their counts; a part is
    sorted numbers and their counts."""
    seen, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(seen, kind="stable")  # merges what is sorted
    seen = seen[order]
    first = np.flatnonzero(np.diff(seen, prepend=seen[:1] - 1))
    return seen[first], np.add.reduceat(counts[order], first) if len(first) else counts


def sent(block: int, seen: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The n-grams of a block, SENT at once: as one batch they would be tens of megabytes in
    the worker and again in the JVM that takes them."""
    for k in range(0, len(seen), SENT):
        some = seen[k : k + SENT]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), block)), pa.array(some), pa.array(counts[k : k + SENT])], names=["block", "gram", "n"])


def block_grams(rows: DataFrame, trusted: str, n: int) -> DataFrame:
    """Each n-gram of each block once: block, gram, and n, how often trusted documents that
    train have it there."""

    def run(batches):
        now, parts = None, []

        for block, whole in by_block(batches):
            if block != now:
                if now is not None:
                    yield from sent(now, *merged(parts))
                now, parts = block, [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
            for piece in slices([whole], "text", SLICE):
                data, at = utf8(piece.column(piece.schema.get_field_index("text")))
                found = grams(data, at, n)
                good, calibrates = _flags(trusted, block, _ids(piece))
                parts.append(np.unique(found[np.repeat(good & ~calibrates, np.diff(at))], return_counts=True))
                every = np.unique(found)
                parts.append((every, np.zeros(len(every), np.int64)))
                if sum(len(seen) for seen, _ in parts[1:]) > max(len(parts[0][0]), SLICE):
                    parts = [merged(parts)]
        if now is not None:
            yield from sent(now, *merged(parts))

    return rows.select("block", "doc", "text").mapInArrow(run, "block long, gram long, n long")


def discounts(counts: DataFrame) -> tuple[float, float, float]:
    """Discounts of n-grams that count 1, 2, and 3 or more, from how many count 1 to 4."""
    n1, n2, n3, n4 = counts.agg(*[F.count(F.when(F.col("n") == k, 1)) for k in (1, 2, 3, 4)]).first()
    if not (n1 and n2 and n3 and n4):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(d, 0.0), k) for d, k in zip((1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3), (1, 2, 3), strict=True))


def probabilities(corpus: DataFrame, n: int) -> DataFrame:
    """gram and p for each n-gram of `corpus` (gram, n): p of its last unit after the
    others. n is the count in trusted text, 0 for n-grams that only others have. What one
    order leaves for the next is written, so that no plan holds more than one order: the
    driver plans a deep one anew after each of its stages."""
    mask = lambda c, k: F.col(c).bitwiseAND(F.lit((1 << 8 * k) - 1))
    counts = {n: corpus.where("n > 0").select("gram", "n")}
    wanted = {n: corpus.select("gram")}
    for k in range(n - 1, 0, -1):  # below the highest order, n is of how many units precede
        counts[k] = table(counts[k + 1].groupBy(mask("gram", k).alias("gram")).agg(F.count("*").alias("n")), "counts")
        wanted[k] = table(wanted[k + 1].select(mask("gram", k).alias("gram")).distinct(), "wanted")
    lower = None
    for k in range(1, n + 1):
        d = discounts(counts[k])
        off = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        context = F.shiftright("gram", 8).alias("context")
        totals = counts[k].groupBy(context).agg(F.sum("n").alias("total"), F.sum(off).alias("freed"))
        own = counts[k].select("gram", (F.col("n") - off).alias("left"))
        t = wanted[k].join(own, "gram", "left").withColumn("context", F.shiftright("gram", 8)).join(totals, "context", "left")
        if lower is None:
            t = t.withColumn("below", F.lit(1.0 / ALPHABET))
        else:
            t = t.withColumn("suffix", mask("gram", k - 1)).join(lower.select(F.col("gram").alias("suffix"), F.col("p").alias("below")), "suffix")
        p = F.when(F.col("total").isNull(), F.col("below")).otherwise((F.coalesce("left", F.lit(0.0)) + F.col("freed") * F.col("below")) / F.col("total"))
        lower = t.select("gram", p.alias("p"))
        lower = table(lower, "below") if k < n else lower
    return lower


def block_scores(rows: DataFrame, trusted: str, model: str, n: int) -> DataFrame:
    """block, key, doc, lang, n_bytes, loss (of all bytes, in nats), trusted, calibrates."""

    def run(batches):
        now, known, cost = None, None, None
        for block, whole in by_block(batches):
            if block != now:
                found = read_beside(model, block, "gram")
                known, cost = found["gram"].to_numpy(), found["cost"].to_numpy()
                now = block
            for piece in slices([whole], "text", SLICE):
                column = lambda c, piece=piece: piece.column(piece.schema.get_field_index(c))
                data, at = utf8(column("text"))
                wanted = grams(data, at, n)
                spot = np.searchsorted(known, wanted)
                if len(wanted) and (not len(known) or (known[np.minimum(spot, len(known) - 1)] != wanted).any()):
                    raise ValueError("a block's rows have changed between two reads")
                sums = np.r_[0.0, np.cumsum(cost[spot], dtype=np.float64)]
                good, calibrates = _flags(trusted, block, _ids(piece))
                yield pa.RecordBatch.from_arrays(
                    [column("block"), column("key"), column("doc"), column("lang"), pa.array(np.diff(at)), pa.array(sums[at[1:]] - sums[at[:-1]]), pa.array(good), pa.array(calibrates)],
                    names=["block", "key", "doc", "lang", "n_bytes", "loss", "trusted", "calibrates"],
                )

    return rows.mapInArrow(run, "block long, key long, doc long, lang string, n_bytes long, loss double, trusted boolean, calibrates boolean")


def judge(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", label: str = "quality", label_id: str = "doc_id", order: int = ORDER, quantile: float = QUANTILE, room: float = ROOM, margin: float = MARGIN) -> DataFrame:
    """A row for each of the blocked `docs`: block, key, doc_id, lang, n_bytes,
    perplexity (of a byte), threshold, keep.

    A text is kept unless its perplexity is above the threshold of its language, by more
    than `margin` nats over the whole text. The threshold is `room` times the `quantile` of trusted documents that were kept out of the counts, of all
    languages where its own (a null language is one) has fewer than LEAST of them. Null
    and empty texts have no perplexity and are kept; so is everything if no document is
    trusted. Repeated rows give equal rows. All bytes of all trusted documents count and
    all bytes of each text are scored.
    """
    rows = _rows(docs, doc_id, text, lang)
    every = table(rows.select("block").distinct(), "blocks")
    trusted = _trusted(rows, labels, label_id, label, every)
    needs = table(block_grams(rows, trusted, order), "grams")
    corpus = table(needs.groupBy("gram").agg(F.sum("n").alias("n")), "corpus")
    costs = probabilities(corpus, order).select("gram", (-F.ln("p")).cast("float").alias("cost"))
    model = write_beside(needs.select("block", "gram").join(costs, "gram").select("block", "gram", "cost"), "model", "gram", every)
    scored = table(block_scores(rows, trusted, model, order), "scored")
    scored = scored.withColumn("perplexity", F.exp(F.col("loss") / F.nullif("n_bytes", F.lit(0))))
    sample = scored.where("calibrates and perplexity is not null")
    line = lambda g: g.agg(F.percentile_approx("perplexity", quantile, 10_000).alias("line"), F.count("*").alias("size"))
    overall = line(sample.groupBy()).first()
    every = float("inf") if overall.line is None else overall.line
    own = line(sample.groupBy("lang")).where(F.col("size") >= LEAST).select(F.col("lang").alias("of"), "line")
    out = scored.join(own, F.col("lang").eqNullSafe(F.col("of")), "left")
    threshold = F.coalesce("line", F.lit(every)) * room
    keep = F.coalesce(F.col("loss") <= F.col("n_bytes") * F.ln(threshold) + margin, F.lit(True))
    return out.select("block", "key", F.col("doc").alias("doc_id"), "lang", "n_bytes", "perplexity", threshold.alias("threshold"), keep.alias("keep"))


def score(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", **options) -> DataFrame:
    """judge() of any documents, without its columns of blocks and keys."""
    small_batches(docs)
    own = docs.select(*[F.col(c).alias(f"_{k}") for k, c in enumerate((doc_id, text, lang))])
    return judge(blocked(own), labels, "_0", "_1", "_2", label_id=doc_id, **options).drop("block", "key")


def keep(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", **options) -> DataFrame:
    """The documents that judge() keeps, with their own columns. Decisions go back to the
    blocks, texts stay where they are."""
    small_batches(docs)
    mine = {f.name: f"_own_{i}" for i, f in enumerate(docs.schema.fields)}
    held = blocked(docs.select(*[F.col(f"`{k}`").alias(v) for k, v in mine.items()]))
    rejected = judge(held, labels, mine[doc_id], mine[text], mine[lang], label_id=doc_id, **options).where("not keep").select("block", F.col("key").alias("_key"))
    own = held.withColumn("_key", row_key(F.col(mine[doc_id]).cast("long"), F.coalesce(F.col(mine[text]).cast("string"), F.lit(""))))
    return without(own, rejected, "_key").select(*[F.col(v).alias(k) for k, v in mine.items()])
