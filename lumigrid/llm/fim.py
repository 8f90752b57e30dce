"""Fill-in-the-middle: documents cut into prefix, middle and suffix, which change places.

Cuts fall between units: a run of ASCII letters is one, any other code point is one. One
Aho-Corasick automaton looks through a text for the places where letters begin or end and
for the marks. Between two such events a stretch of letters is one unit and a stretch of
other characters as many as it has, so positions of events alone tell how many units a
text has and where the k-th ends; no unit is ever made an object.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import chain
from string import ascii_letters

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lumigrid.llm.words import slices, small_batches

#: Before a prefix, a suffix and a middle.
MARKS = ("<P>", "<S>", "<M>")
CHANGE, MARK = 0, 1
ADDED = "n long, form string, prefix_chars long, middle_chars long, output string"


@dataclass
class Units:
    """The units of a text, as the runs of letters in it: ``begin[k]:end[k]``, in code points."""

    size: int
    begin: np.ndarray
    end: np.ndarray
    marked: bool

    def __post_init__(self):
        self.saved = np.r_[0, np.cumsum(self.end - self.begin - 1)]  # characters over units, before each run
        self.rank = self.begin - self.saved[:-1]  # units before each run

    def __len__(self) -> int:
        return int(self.size - self.saved[-1])

    def place(self, units: int) -> int:
        """The code points in the first `units` units."""
        return units + int(self.saved[np.searchsorted(self.rank, units, side="left")])


class Scanner:
    """Finds changes between letters and others, and marks, in one pass over a text."""

    def __init__(self, marks: tuple[str, ...] = MARKS):
        for m in marks:
            if not (m.isascii() and len(m) > 2 and m[0] == "<" and m[-1] == ">" and not set("<>?") & set(m[1:-1])):
                raise ValueError(f"a mark is ASCII in angle brackets, without a question mark: {m!r}")
        used = set("".join(marks))
        letters = sorted(used & set(ascii_letters)) + [next(c for c in ascii_letters if c not in used)]
        others = sorted(used - set(ascii_letters)) + ["?"]  # also what a non-ASCII character becomes
        # characters that no mark has need only their class
        self.fold = bytes(b if chr(b) in used else ord(letters[-1] if chr(b) in ascii_letters else "?") for b in range(128)) + b"?" * 128
        self.letter = set(letters)
        self.automaton = ahocorasick.Automaton()
        for a in letters:
            for b in others:
                self.automaton.add_word(a + b, CHANGE)
                self.automaton.add_word(b + a, CHANGE)
        for m in marks:
            self.automaton.add_word(m, MARK)
        self.automaton.make_automaton()

    def __call__(self, text: str) -> Units:
        plain = text.encode("ascii", "replace").translate(self.fold).decode("ascii")
        events = np.fromiter(chain.from_iterable(self.automaton.iter(plain)), np.int64).reshape(-1, 2)
        kind = events[:, 1]
        edge = [0] if plain and plain[0] in self.letter else []
        last = [len(plain)] if plain and plain[-1] in self.letter else []
        runs = np.r_[edge, events[kind == CHANGE, 0], last].astype(np.int64)
        return Units(len(plain), runs[::2], runs[1::2], bool((kind == MARK).any()))


def draws(key: Column, seed: int = 1) -> list[Column]:
    """Four unsigned numbers of 32 bits for a key and a seed; a null key is the empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def transform(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 1, percent: int = 90, spm_percent: int = 20, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """Every row of `docs` with n (units), form (plain, psm or spm), prefix_chars,
    middle_chars (code points, null if plain) and output; no shuffle.

    Cuts are drawn for the key, alike in every run. A text that is empty or holds a mark
    is plain, as is one in a hundred less `percent`; of the others `spm_percent` in a
    hundred have the suffix first. A null text is empty, a null key draws as an empty one;
    rows with equal keys draw alike. Whole texts are cut, one at a time, with 16 bytes for
    each change between letters and others. Input columns named as a new one, in any case,
    are replaced; other columns stay. An empty table gives no rows.
    """
    small_batches(docs)
    new = T.StructType.fromDDL(ADDED)
    clash = {f.name.lower() for f in new}
    kept = [f for f in docs.schema.fields if f.name.lower() not in clash]
    # by position, under names that nothing can clash with
    source = docs.select(
        *[F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(kept)],
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("_text"),
        *[h.alias(f"_h{k}") for k, h in enumerate(draws(F.col(f"`{key}`"), seed))],
    )
    types = [f.type for f in to_arrow_schema(new)]
    pre, suf, mid = marks

    def one(scan: Scanner, t: str, h: tuple[int, ...]):
        units = scan(t)
        n = len(units)
        if not t or units.marked or h[2] % 100 >= percent:
            return n, "plain", None, None, t
        a, b = (units.place(u) for u in sorted((h[0] % (n + 1), h[1] % (n + 1))))
        if h[3] % 100 < spm_percent:
            return n, "spm", a, b - a, f"{suf}{t[b:]}{pre}{t[:a]}{mid}{t[a:b]}"
        return n, "psm", a, b - a, f"{pre}{t[:a]}{suf}{t[b:]}{mid}{t[a:b]}"

    def run(batches):
        scan = Scanner(marks)
        for piece in slices(batches, "_text"):
            drawn = zip(*[piece.column(f"_h{k}").to_pylist() for k in range(4)])
            made = zip(*[one(scan, t, h) for t, h in zip(piece.column("_text").to_pylist(), drawn)])
            columns = [pa.array(list(v), k) for v, k in zip(made, types)]
            yield pa.RecordBatch.from_arrays([*[piece.column(i) for i in range(len(kept))], *columns], names=[*[f"c{i}" for i in range(len(kept))], *new.names])

    schema = T.StructType([*[T.StructField(f"c{i}", f.dataType) for i, f in enumerate(kept)], *new.fields])
    return source.mapInArrow(run, schema).toDF(*[f.name for f in kept], *new.names)


def restore(output: str = "output", form: str = "form", marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output was made from. Its marks stand in a fixed order and none is
    in a cut text, so the first of each is the one that was put in."""
    out, (pre, suf, mid) = F.col(f"`{output}`"), marks

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        at = F.position(F.lit(second), out)
        then = F.position(F.lit(mid), out, at)
        begin = len(first) + 1
        after = at + len(second)
        return F.substring(out, F.lit(begin), at - begin), F.substring(out, after, then - after), F.substring(out, then + len(mid), F.length(out))

    p, s, m = parts(pre, suf)
    s_, p_, m_ = parts(suf, pre)
    return F.when(F.col(f"`{form}`") == "psm", F.concat(p, m, s)).when(F.col(f"`{form}`") == "spm", F.concat(p_, m_, s_)).otherwise(out)
