"""Benchmark decontamination with suffix arrays of the training text.

Each task sorts the word suffixes of its share of the documents (a shard of bounded
size) and binary-searches every suffix of every benchmark item in that order: the
interval that shares n words with an item's suffix holds all places of those n words.
Suffixes with the same first n words share an interval, which is looked at once, and
intervals are disjoint; so work grows with the text, not with the product of repetitions.
The longest verbatim match of a document lies within a run of such places. Documents never
move, only the benchmark is sent, in blocks of bounded size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumigrid.llm.append import append
from lumigrid.llm.words import Words, mix, words

#: Consecutive words that count as a verbatim passage.
WINDOW = 10
_MULTIPLIER = np.uint64(0xD1342543DE82EF95)
#: Bytes of benchmark text broadcast at once; a larger benchmark takes several passes.
BLOCK_BYTES = 32 << 20
#: Bytes of text whose suffixes a task sorts at once.
SLICE = 1 << 20


def suffix_order(found: Words, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all words in the order of the suffixes that begin there, compared up
    to `depth` words and to the end of their text; and the hashes in text order, with a
    lowest value for the end. Doubling: each round compares twice as many words, and
    only suffixes that were equal so far are sorted again."""
    n = len(found)
    end = found.first[1:][found.text]  # where the text of each word ends
    order = np.argsort(found.hash, kind="stable")
    same = np.r_[False, found.hash[order][1:] == found.hash[order][:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(same, 0, np.arange(n)))
    length = 1
    open_ = np.flatnonzero(same | np.r_[same[1:], False])
    while length < depth and len(open_):
        at = order[open_]
        ahead = at + length
        second = np.where(ahead < end[at], rank[np.minimum(ahead, n - 1)] + 1, 0)
        group = rank[at]
        by = np.argsort((group << np.int64(32)) | second, kind="stable")
        order[open_] = at = at[by]
        group, second = group[by], second[by]
        same = np.r_[False, (group[1:] == group[:-1]) & (second[1:] == second[:-1])]
        rank[at] = np.maximum.accumulate(np.where(same, 0, open_))
        open_ = open_[same | np.r_[same[1:], False]]
        length *= 2
    return order, end


class Suffixes:
    """Every suffix of the items of a block: word hashes, and where each item begins."""

    def __init__(self, ids: list, texts: pa.Array, window: int):
        found = words(texts)
        self.ids, self.hash, self.first = ids, found.hash, found.first
        self.item = found.text
        self.start = np.arange(len(found))
        self.left = found.first[1:][found.text] - self.start  # words from here to the item's end
        size = np.diff(found.first)[found.text]
        self.need = np.minimum(window, size)  # words of a window that starts here
        self.depth = int(np.diff(found.first).max(initial=1))

    def search(self, found: Words) -> Places:
        """All places of windows in the documents."""
        order, end = suffix_order(found, self.depth)
        n, m = len(order), len(self.hash)
        low, high = np.zeros(m, np.int64), np.full(m, n, np.int64)
        active = np.arange(m)
        full = [np.zeros(0, np.int64)]
        for k in range(int(self.need.max(initial=0))):
            active = active[self.left[active] > k]
            want = self.hash[self.start[active] + k]

            def seek(passed, lo, hi, k=k):
                while (todo := lo < hi).any():
                    mid = (lo + hi) >> 1
                    at = order[np.minimum(mid, n - 1)]
                    less = (at + k >= end[at]) | passed(found.hash[np.minimum(at + k, n - 1)])
                    lo, hi = np.where(todo & less, mid + 1, lo), np.where(todo & ~less, mid, hi)
                return lo

            lo = seek(lambda word, want=want: word < want, low[active], high[active])
            hi = seek(lambda word, want=want: word <= want, lo, high[active])
            active = active[lo < hi]
            low[active], high[active] = lo[lo < hi], hi[lo < hi]
            full.append(active[self.need[active] == k + 1])
        return Places(found, order, self, np.concatenate(full), low, high)


class Places:
    """Where the documents have windows of the items: intervals of the suffix order, each
    with the suffixes that begin with its window."""

    def __init__(self, found: Words, order: np.ndarray, suffixes: Suffixes, hits: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.found, self.suffixes = found, suffixes
        key, first, window = np.unique(low[hits] * (1 << 20) + suffixes.need[hits], return_index=True, return_inverse=True)
        one = hits[first]  # a suffix for each different window
        self.need, size = suffixes.need[one], high[one] - low[one]
        self.at = order[np.repeat(low[one] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        self.of = np.repeat(np.arange(len(key)), size)  # the window that stands there
        pairs = np.unique(window * len(suffixes.ids) + suffixes.item[hits])
        self.first = np.searchsorted(pairs, np.arange(len(key) + 1) * len(suffixes.ids))
        self.item = pairs % len(suffixes.ids)  # items of window w: item[first[w]:first[w + 1]]

    def hit(self) -> np.ndarray:
        """Whether each word of the documents is inside a place."""
        edge = np.bincount(self.at, minlength=len(self.found) + 1) - np.bincount(self.at + self.need[self.of], minlength=len(self.found) + 1)
        return np.cumsum(edge)[:-1] > 0

    def items(self) -> dict[int, np.ndarray]:
        """The items (numbers) with a window in each document that has one."""
        both = np.unique(self.found.text[self.at] * len(self.need) + self.of)
        out: dict[int, np.ndarray] = {}
        for doc, low, high in _runs(both // max(len(self.need), 1)):
            seen = np.zeros(0, np.int64)
            for some in np.array_split(both[low:high] % len(self.need), -(-(high - low) // 1000)):
                size = self.first[some + 1] - self.first[some]
                seen = np.union1d(seen, self.item[np.repeat(self.first[some] - (np.cumsum(size) - size), size) + np.arange(size.sum())])
            out[doc] = seen
        return out

    def longest(self, items: dict[int, np.ndarray]) -> dict[int, tuple[int, int, int]]:
        """The longest verbatim match of each document: words, first word, item."""
        order = np.argsort(self.at, kind="stable")
        out = {}
        for doc, low, high in _runs(self.found.text[self.at[order]]):
            mine = order[low:high]
            at, need = self.at[mine] - self.found.first[doc], self.need[self.of[mine]]
            words_ = self.found.hash[self.found.first[doc] : self.found.first[doc + 1]]
            begin, stop = self.suffixes.first[items[doc]], self.suffixes.first[items[doc] + 1]
            text = np.concatenate([self.suffixes.hash[a:b] for a, b in zip(begin.tolist(), stop.tolist())])
            owner = np.repeat(items[doc], stop - begin)
            begins = np.unique(at)
            run = max(b - a for _, a, b in _runs(begins - np.arange(len(begins))))
            # a match of n words has a window at each of its n - need + 1 first words
            least, most = int(need.max()), int(min(run + need.max() - 1, len(words_), (stop - begin).max()))
            best, length = None, most
            while True:
                got = _common(words_, text, owner, length)
                if got:
                    best, least = (length, *got), length
                else:
                    most = length - 1
                if best and least >= most:
                    break
                length = (least + most + 1) // 2 if best else max((least + most) // 2, least)
            out[doc] = best
        return out


def _runs(groups: np.ndarray):
    """(value, low, high) of each run of equal values."""
    edges = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1], True]) if len(groups) else np.zeros(1, np.int64)
    for low, high in zip(edges[:-1].tolist(), edges[1:].tolist()):
        yield int(groups[low]), low, high


def _common(words_: np.ndarray, text: np.ndarray, owner: np.ndarray, n: int) -> tuple[int, int] | None:
    """The first place in `words_` of n words that stand together in an item, and the least
    such item; items lie side by side in `text`."""

    def grams(x):
        total, power, base, k = np.zeros(max(len(x) - n + 1, 0), np.uint64), x, np.array([_MULTIPLIER]), n
        offset, step = 0, 1
        while k:  # n words by parts of 1, 2, 4, ... words, as the bits of n say
            if k & 1 and len(total):
                total = total * base + power[offset : offset + len(total)]
                offset += step
            k >>= 1
            if k:
                power = power[: len(power) - step] * base + power[step:] if len(power) > step else power[:0]
                base, step = base * base, step * 2
        return mix(total)

    there = grams(text)
    whole = owner[: len(there)] == owner[n - 1 :][: len(there)]
    there, whose = there[whole], owner[: len(whole)][whole]
    here = grams(words_)
    places = np.flatnonzero(np.isin(here, there))
    return (int(places[0]), int(whose[there == here[places[0]]].min())) if len(places) else None


def blocks(benchmark: DataFrame, item_id: str, text: str, limit: int) -> list[tuple[list, list]]:
    """The benchmark's items in blocks of about `limit` bytes, fetched one at a time."""
    items = benchmark.select(F.col(item_id).alias("id"), F.col(item_id).cast("string").alias("item"), F.col(text).cast("string").alias("text")).where("text is not null").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(total // limit) + 1
    part = lambda: F.pmod(F.xxhash64("item", "text"), F.lit(parts))
    while True:  # until no block is larger than it should be by more than its largest item
        sizes = items.groupBy(part().alias("part")).agg(F.sum(F.octet_length("text")).alias("n"), F.max(F.octet_length("text")).alias("one"))
        worst = sizes.agg(F.max(F.col("n") - F.col("one"))).first()[0] or 0
        if worst <= 2 * limit:
            break
        parts *= 2
    for k in range(parts):
        rows = items.where(part() == k).orderBy("id", "text").collect()
        yield [r.item for r in rows], [r.text for r in rows]


def scan(df: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """`df` with n_words, n_hit, n_items, items, items_sha256, contaminated, longest_*.

    A window is `window` consecutive words of an item; an item of fewer words, but not
    none, is one window. n_hit counts the document's words inside any place of a window.
    items are the ids of items with such places, as distinct sorted strings (a null id is
    left out), and items_sha256 the digest of their comma-joined list. longest_words,
    longest_at and longest_item tell the longest verbatim match, carried on beyond its
    window: its words, its first word in the document (from 0; of equal ones the first)
    and the item; 0, null and null without one.

    A null or empty text has no words and is clean; so is all text if the benchmark is
    empty. Rows are independent, so repeated rows give equal results. Columns of the
    result's names are replaced. No shuffle; memory is that of a slice of documents, of
    one longer document, or of one block of items.
    """
    spark = df.sparkSession
    out = df
    done: list[str] = []
    for ids, texts in blocks(benchmark, item_id, item_text, block_bytes):
        sent = spark.sparkContext.broadcast((ids, texts))
        k = len(done)

        def make(sent=sent):
            ids, texts = sent.value
            suffixes = Suffixes(ids, pa.array(texts, pa.string()), window)

            def compute(column):
                found, n = words(column), len(column)
                inside = np.zeros(len(found), bool)
                items: dict[int, set] = {}
                best: list = [None] * n
                if len(found) and len(suffixes.hash):
                    places = suffixes.search(found)
                    inside = places.hit()
                    numbers = places.items()
                    items = {d: {suffixes.ids[i] for i in some.tolist()} for d, some in numbers.items()}
                    for d, (length, place, item) in places.longest(numbers).items():
                        best[d] = {"words": length, "before": -place, "item": suffixes.ids[item]}
                edges = np.flatnonzero(np.diff(np.r_[0, inside, 0]))
                starts, ends = edges[::2], edges[1::2]
                # runs may touch across texts: cut at each text's first word
                cut = [[] for _ in range(n)]
                for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
                    while a < b:
                        d = int(found.text[a])
                        stop = min(b, int(found.first[d + 1]))
                        cut[d].append([a - int(found.first[d]), stop - int(found.first[d])])
                        a = stop
                return [np.diff(found.first), cut, [sorted(i for i in items.get(d, ()) if i is not None) for d in range(n)], best]

            return compute

        out = append(out, text, f"_n{k} long, _hit{k} array<array<int>>, _items{k} array<string>, _best{k} struct<words: long, before: long, item: string>", make, limit=SLICE)
        done.append(str(k))
    items = F.array_sort(F.array_distinct(F.concat(*[F.col(f"_items{k}") for k in done])))
    # words in any run: with one block the runs are disjoint, with more they are merged
    runs = F.array_sort(F.concat(*[F.col(f"_hit{k}") for k in done]))
    hit = F.aggregate(
        runs,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to")),
        lambda acc, r: F.struct(
            (acc["n"] + F.greatest(F.lit(0), r[1] - F.greatest(acc["to"], r[0]))).cast("long").alias("n"),
            F.greatest(acc["to"], r[1]).alias("to"),
        ),
    )["n"]
    return (
        out.withColumns({"n_words": F.col("_n0"), "n_hit": hit, "items": items})
        .withColumns({"n_items": F.size("items").cast("long"), "items_sha256": F.sha2(F.array_join("items", ","), 256), "contaminated": F.col("n_hit") > 0})
        .withColumn("_best", F.array_max(F.array(*[F.col(f"_best{k}") for k in done])))
        .withColumns({"longest_words": F.coalesce("_best.words", F.lit(0)), "longest_at": -F.col("_best.before"), "longest_item": F.col("_best.item")})
        .drop("_best", *[f"_{x}{k}" for k in done for x in ("n", "hit", "items", "best")])
    )


def remove(df: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of `df` that hold no window of the benchmark, with df's own columns."""
    mine = {f.name: f"_own_{i}" for i, f in enumerate(df.schema.fields)}
    text = options.pop("text", "text")
    held = df.select(*[F.col(f"`{n}`").alias(v) for n, v in mine.items()])
    kept = scan(held, benchmark, text=mine[text], **options).where("not contaminated")
    return kept.select(*[F.col(v).alias(n) for n, v in mine.items()])
