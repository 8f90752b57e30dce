"""Byte-level BPE by a finite-state transducer that is determinised as texts need it.

Two facts make BPE a left-to-right job. The ids of a piece are the one sequence of tokens
in which any two neighbours, taken alone, would be encoded as themselves; and ids up to a
token's end do not depend on what follows that end. So after each byte a piece so far has
one last token: of the tokens that end there, the one that can follow the last token of
the place where it begins. The transducer's output for a byte is that token, and walking
back from the end by the lengths of tokens gives the ids. A token is certain, and emitted,
as soon as the walks from all places where a longer token could still begin agree on it.

A state is what the next outputs depend on: the longest ending that could go on to a
longer token, and the last tokens of the places in it. States and moves are made when a
text first needs them and kept in a bounded table. Decoding sends the bytes of ids through
a UTF-8 machine that keeps an unfinished character between ids.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumigrid.llm.append import append
from lumigrid.llm.words import small_batches

#: Moves, tested pairs of neighbours and encoded pieces that a worker keeps; beyond it, a
#: table is begun anew, which changes no result.
MOVES, PAIRS, PIECES = 1 << 19, 1 << 18, 1 << 18
#: Bytes that are read before certain tokens are looked for.
WAIT = 64
#: Beyond every rank.
NONE = 1 << 40
#: Characters of a text whose pieces are listed at once.
LISTED = 1 << 20


def load_ranks(path: str) -> dict[bytes, int]:
    """Tokens and their ranks, which are their ids, from a file of base64 and rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Transducer:
    """Ids of pieces of bytes. `feed` gives ids when they are certain, `close` the rest;
    `encode` takes a whole piece."""

    def __init__(self, ranks: dict[bytes, int], moves: int = MOVES):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"every byte needs a rank; {missing[:5]} have none")
        self.ranks, self.limit = ranks, moves
        self.token = {rank: token for token, rank in ranks.items()}
        self.size = {rank: len(token) for token, rank in ranks.items()}
        self.beginnings = {token[:k] for token in ranks for k in range(1, len(token) + 1)}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.edges: dict[int, tuple | None] = {}
        self.endings: dict[bytes, tuple] = {}
        self.longest = 0  # bytes held at most while nothing more was certain
        self._begin()

    def _begin(self) -> None:
        self.number = {(b"", None): 0}
        self.keys: list[tuple] = [(b"", None)]
        self.moves: dict[int, tuple[int, int]] = {}
        self.state, self.lasts = 0, []

    def merges(self, data: bytes) -> tuple[list[bytes], list[tuple[int, bytes, bytes]]]:
        """BPE as it is defined: the pair of least rank is merged, the first of equal ones,
        until none has any. The parts, and each merge's rank with the first and last part
        after it."""
        parts, steps = [data[k : k + 1] for k in range(len(data))], []
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, NONE), k) for k, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == NONE:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            steps.append((rank, parts[0], parts[-1]))
        return parts, steps

    def _edges(self, rank: int) -> tuple | None:
        """The merges that make a token, as ranks, first parts and last parts, with those
        before the first merge; None if merging its bytes gives another thing."""
        if rank not in self.edges:
            token = self.token[rank]
            parts, steps = self.merges(token)
            begun = [(NONE, token[:1], token[-1:]), *steps]
            self.edges[rank] = ([r for r, _, _ in steps] + [NONE], [f for _, f, _ in begun], [e for _, _, e in begun]) if parts == [token] else None
        return self.edges[rank]

    def _stands(self, left: int, right: int) -> bool:
        """Whether a token can follow another: the merges of the two are played in turn,
        and none of what then lies at their border may be merged before."""
        one, two = self._edges(left), self._edges(right)
        (ranks, _, ends), (others, firsts, _) = one, two
        i = j = 0
        while True:
            r, o = ranks[i], others[j]
            across = self.ranks.get(ends[i] + firsts[j], NONE)
            if across < r and across <= o and across != NONE:  # what is further left comes first
                return False
            if r == o == NONE:
                return True
            if r <= o:
                i += 1
            else:
                j += 1

    def _ending(self, ending: bytes) -> tuple:
        """For an ending: what of it can go on to a longer token, and the tokens that it
        ends with, longest first, as length and rank."""
        cut = next((k for k in range(len(ending)) if ending[k:] in self.beginnings), len(ending))
        tokens = [(len(ending) - k, self.ranks[ending[k:]]) for k in range(len(ending)) if ending[k:] in self.ranks]
        found = cut, ending[cut:], [(n, r) for n, r in tokens if self._edges(r)]
        if len(self.endings) < PAIRS:
            self.endings[ending] = found
        return found

    def _move(self, state: int, byte: int) -> tuple[int, int]:
        """Makes the move from a state by a byte: the next state and the last token."""
        key = self.keys[state]
        ending = key[0] + bytes((byte,))
        cut, kept, tokens = self.endings.get(ending) or self._ending(ending)
        pairs, n = self.pairs, len(key)
        for size, right in tokens:  # exactly one can be the last
            left = key[n - size]
            if left is None:
                break
            stands = pairs.get((left, right))
            if stands is None:
                if len(pairs) >= PAIRS:
                    pairs.clear()
                stands = pairs[left, right] = self._stands(left, right)
            if stands:
                break
        else:
            raise AssertionError(f"no token ends at {ending!r}")
        key = (kept, *key[cut + 1 :], right)
        to = self.number.setdefault(key, len(self.keys))
        if to == len(self.keys):
            self.keys.append(key)
        move = self.moves[state << 8 | byte] = to, right
        return move

    def _read(self, data: bytes) -> None:
        """Goes over bytes and adds the last token at each to `lasts`."""
        if len(self.moves) > self.limit:
            key, lasts = self.keys[self.state], self.lasts
            self._begin()
            self.lasts = lasts
            if key != self.keys[0]:
                self.number[key] = self.state = 1
                self.keys.append(key)
        state, moves, add = self.state, self.moves, self.lasts.append
        for byte in data:
            state, last = moves.get(state << 8 | byte) or self._move(state, byte)
            add(last)
        self.state = state

    def _walk(self, at: int) -> list[int]:
        """The tokens of the first `at` bytes in `lasts`."""
        out = []
        while at > 0:
            out.append(self.lasts[at - 1])
            at -= self.size[out[-1]]
        return out[::-1]

    def feed(self, data: bytes) -> list[int]:
        """Ids that are certain, of a piece that goes on."""
        out: list[int] = []
        for k in range(0, len(data), WAIT):
            self._read(data[k : k + WAIT])
            n = len(self.lasts)
            if n < WAIT:
                continue
            walks = [self._walk(n - back) for back in range(len(self.keys[self.state][0]) + 1)]
            sure = next((k for k, same in enumerate(zip(*walks)) if len(set(same)) > 1), min(map(len, walks)))
            out += walks[0][:sure]
            del self.lasts[: sum(self.size[r] for r in walks[0][:sure])]
            self.longest = max(self.longest, len(self.lasts))
        return out

    def close(self) -> list[int]:
        """What is left of a piece; the next bytes begin another."""
        rest = self._walk(len(self.lasts))
        self.state, self.lasts = 0, []
        return rest

    def encode(self, piece: bytes) -> list[int]:
        rank = self.ranks.get(piece)  # a piece that is a token is that token
        if rank is not None:
            return [rank]
        if len(piece) > WAIT:
            return self.feed(piece) + self.close()
        self._read(piece)
        return self.close()


class Encoder:
    """Ids of texts: each match of the split pattern goes through the transducer alone."""

    def __init__(self, path: str, pattern: str):
        self.transducer = Transducer(load_ranks(path))
        self.split = regex.compile(pattern)
        self.pieces: dict[str, tuple[int, ...]] = {}

    def _new(self, piece: str) -> tuple[int, ...]:
        ids = tuple(self.transducer.encode(piece.encode()))
        if len(self.pieces) >= PIECES:
            self.pieces.clear()
        if len(piece) <= WAIT:  # a long one hardly comes again
            self.pieces[piece] = ids
        return ids

    def __call__(self, text: str) -> list[int]:
        out: list[int] = []
        known, new = self.pieces.get, self._new
        found = self.split.findall(text) if len(text) < LISTED else (m.group() for m in self.split.finditer(text))
        for piece in found:
            out += known(piece) or new(piece)
        return out


class Utf8:
    """Text of bytes that come in parts. What cannot be a character becomes U+FFFD, once
    for each longest beginning of one, as the Unicode standard recommends."""

    def __init__(self):
        self.held = b""  # the beginning of a character
        self.need = 0  # bytes that it lacks
        self.low, self.high = 0x80, 0xBF  # where its next byte must be

    def _lead(self, byte: int) -> str:
        """Enters the state that a first byte leads to."""
        if byte < 0x80:
            return chr(byte)
        if not 0xC2 <= byte <= 0xF4:
            return "�"
        self.held = bytes([byte])
        self.need = 1 + (byte >= 0xE0) + (byte >= 0xF0)
        # not overlong, no surrogate, not beyond the last code point
        self.low = {0xE0: 0xA0, 0xF0: 0x90}.get(byte, 0x80)
        self.high = {0xED: 0x9F, 0xF4: 0x8F}.get(byte, 0xBF)
        return ""

    def feed(self, data: bytes) -> str:
        out = []
        for byte in data:
            if self.need and self.low <= byte <= self.high:
                self.held += bytes([byte])
                self.need -= 1
                self.low, self.high = 0x80, 0xBF
                if not self.need:
                    out.append(self.held.decode())
                    self.held = b""
            else:
                out.append(self.close() + self._lead(byte))
        return "".join(out)

    def close(self) -> str:
        """What an unfinished character becomes."""
        left = "�" if self.held else ""
        self.held, self.need = b"", 0
        return left


class Decoder:
    """Texts of ids. An id that no token has, or null, is U+FFFD."""

    def __init__(self, path: str):
        ranks = load_ranks(path)
        self.token: list[bytes | None] = [None] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.token[rank] = token
        self.text = [self._alone(t) for t in self.token]

    @staticmethod
    def _alone(token: bytes | None) -> str | None:
        """The text of a token that begins and ends with whole characters."""
        try:
            return None if token is None else token.decode()
        except UnicodeDecodeError:
            return None

    def __call__(self, ids: list[int]) -> str:
        machine, out = Utf8(), []
        for i in ids:
            if not 0 <= i < len(self.token) or self.token[i] is None:
                out.append(machine.close() + "�")
            elif machine.need or self.text[i] is None:
                out.append(machine.feed(self.token[i]))
            else:
                out.append(self.text[i])
        return "".join(out) + machine.close()


@lru_cache(1)
def _encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


@lru_cache(1)
def _decoder(path: str) -> Decoder:
    return Decoder(path)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """Every row of `docs` with `ids`, an array of its whole text's ids without special
    tokens; no shuffle. A null or empty text has none. Columns named ids, in any case, are
    replaced, others stay; an empty table gives no rows. A worker compiles the ranks of
    the file at `path` (on every executor) once and holds tables of a bounded size; a
    text's own ids are what grows with it."""

    def make():
        encoder = _encoder(path, pattern)

        def compute(column):
            rows = [encoder(t) if t else [] for t in column.to_pylist()]
            first = np.r_[0, np.cumsum([len(r) for r in rows])]
            flat = np.empty(int(first[-1]), np.int32)
            for low, row in zip(first.tolist(), rows):
                flat[low : low + len(row)] = row
            return [pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(flat))]

        return compute

    return append(docs, text, "ids array<int>", make)


def decode(rows: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Every row with the text of its ids; no shuffle. A null array is an empty text.
    A column named as the new one is replaced."""
    small_batches(rows)
    kept = [f for f in rows.schema.fields if f.name.lower() != out.lower()]
    source = rows.select(*[F.col(f"`{f.name}`") for f in kept])
    at = [f.name for f in kept].index(ids)

    def run(batches):
        decoder = _decoder(path)
        for batch in batches:
            column = batch.column(at)
            values = column.flatten().fill_null(-1).to_numpy().tolist()  # a null array has none
            first = np.r_[0, np.cumsum(column.value_lengths().fill_null(0).to_numpy())].tolist()
            texts = pa.array([decoder(values[low:high]) for low, high in zip(first, first[1:])], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*batch.schema.names, out])

    return source.mapInArrow(run, source.withColumn(out, F.lit("")).schema)
