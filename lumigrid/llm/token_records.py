"""Token ids as length-delimited binary records, with an offset index beside them.

A data file is a row of frames, each ``length u64 | masked crc32c(length) u32 | payload |
masked crc32c(payload) u32``, little-endian: the framing that record readers of common
training frameworks know. A payload is ``doc_id i64 | 1 if doc_id is null u8 | bytes of an
id u8 | ids``. The index file has ``offset u64, start u64`` for each frame: where it
begins, and how many ids of the file stand before it; so any record can be read alone.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumigrid.llm.shared import at, publish
from lumigrid.llm.units import Memo, Units
from lumigrid.llm.words import slices, utf8

HEAD = 10  # bytes of a payload before its ids
ROW = 256  # bytes of a checksum's row


# ---- checksums ---------------------------------------------------------------------

_table = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _table = np.where(_table & 1, (_table >> 1) ^ np.uint32(0x82F63B78), _table >> 1).astype(np.uint32)


def _zeros(crc: np.ndarray, n: int) -> np.ndarray:
    """The checksums after n more zero bytes."""
    for _ in range(n):
        crc = _table[crc & np.uint32(255)] ^ (crc >> np.uint32(8))
    return crc


_skip = [_zeros((np.arange(256, dtype=np.uint32) << np.uint32(8 * k)).astype(np.uint32), ROW) for k in range(4)]


def masked_crc32c(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Masked CRC-32C of data[begin[i]:end[i]] for all i at once; each at least 4 bytes.
    Zeros before a message do not change a checksum that begins as 0, so messages are cut
    into rows of equal length from their end, and the rows' checksums are combined."""
    size = end - begin
    rows = -(-size // ROW)
    first = np.r_[0, np.cumsum(rows)]
    grid = np.zeros((int(first[-1]), ROW), np.uint8)
    flat = grid.reshape(-1)
    for low, high, to in zip(begin.tolist(), end.tolist(), (first[1:] * ROW).tolist(), strict=True):
        flat[to - (high - low) : to] = data[low:high]
    for k in range(4):  # the usual start of all ones, as a change of the first bytes
        flat[first[1:] * ROW - size + k] ^= 255
    crc = np.zeros(len(grid), np.uint32)
    for column in np.ascontiguousarray(grid.T):
        crc = _table[(crc ^ column) & np.uint32(255)] ^ (crc >> np.uint32(8))
    total, alive, k = np.zeros(len(size), np.uint32), np.arange(len(size)), 0
    while len(alive):
        c = total[alive]
        moved = _skip[0][c & 255] ^ _skip[1][(c >> 8) & 255] ^ _skip[2][(c >> 16) & 255] ^ _skip[3][c >> 24]
        total[alive] = moved ^ crc[first[alive] + k]
        k += 1
        alive = alive[rows[alive] > k]
    total = ~total
    return ((total >> np.uint32(15)) | (total << np.uint32(17))) + np.uint32(0xA282EAD8)


# ---- tokens ------------------------------------------------------------------------


#: The split pattern of byte-level BPE, and the bytes that it shows as themselves: fixed
#: values of that tokenizer. Other bytes are shown as the characters from 256 on.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]

# classes of bytes: 0 any other, 1 letter, 2 digit, 3 mark, 4 apostrophe, 5 space
_CLASS = np.zeros(256, np.uint8)
_CLASS[33:127] = 3
_CLASS[[*range(65, 91), *range(97, 123)]] = 1
_CLASS[48:58] = 2
_CLASS[39], _CLASS[32] = 4, 5
# no piece goes on from a letter or digit to another class, nor from a mark to a letter or digit
_PARTS = np.zeros(64, bool)
_PARTS[[8 * a + b for a, b in ((1, 2), (1, 3), (1, 4), (2, 1), (2, 3), (2, 4), (3, 1), (3, 2), (4, 2))]] = True


class Encoder:
    """Ids of whole texts, as the tokenizers library gives them without special tokens.

    The split pattern of a byte-level BPE never reaches over a space that follows a
    non-space, or from a letter to a digit, and so on. Texts are cut there, and the library
    encodes the pieces of each new part once. A tokenizer of another kind, and a text with
    the string of an added token, goes to it whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, models

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        split = spec["pre_tokenizer"] or {}
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.added = [t["content"] for t in spec["added_tokens"]]
        self.byte_level = spec["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space") and spec["model"]["type"] == "BPE"
        if self.byte_level:
            # each piece comes once, so the library's own memory of pieces only costs
            how = {k: v for k, v in spec["model"].items() if v is not None and k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")}
            merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
            self.model = models.BPE(vocab=spec["model"]["vocab"], merges=merges, cache_capacity=0, **how)
        self.split = regex.compile(PATTERN).findall
        rest = [b for b in range(256) if b not in SHOWN]
        self.letters = {**{b: chr(b) for b in SHOWN}, **{b: chr(256 + k) for k, b in enumerate(rest)}}
        self.memo = Memo()

    def _whole(self, column: pa.Array) -> np.ndarray:
        """Texts that the library must see whole."""
        whole = np.full(len(column), not self.byte_level)
        for a in self.added:
            whole |= pc.match_substring(column, a).to_numpy(zero_copy_only=False).astype(bool)
        return whole

    def _single(self, kind: np.ndarray, units: Units) -> np.ndarray:
        """Whether a unit is letters, digits or marks of ASCII, maybe after a space."""
        kind, spaced = kind.copy(), units.start[(kind[units.start] == 5) & (units.end - units.start > 1)]
        kind[spaced] = kind[spaced + 1]
        low, high = np.minimum.reduceat(kind, units.start), np.maximum.reduceat(kind, units.start)
        return (low == high) & (low >= 1) & (low <= 3)

    def _shown(self, parts: list[bytes]) -> list[str]:
        """Parts without line ends, with their bytes as the model's letters."""
        return b"\n".join(parts).decode("latin1").translate(self.letters).split(self.letters[10]) if parts else []

    def _ids(self, piece: str) -> list[int]:
        return [t.id for t in self.model.tokenize(piece)]

    def _library(self, parts: list[bytes], single: np.ndarray, whole: np.ndarray) -> list[list[int]]:
        """The ids of each part. single: whether it is one piece; whole: whether the
        library must see it as it is."""
        out: list = [None] * len(parts)
        which = np.flatnonzero(single).tolist()
        for k, piece in zip(which, self._shown([parts[k] for k in which]), strict=True):
            out[k] = self._ids(piece)
        of: dict[str, list[int]] = {}
        for k in np.flatnonzero(~single).tolist():
            text = parts[k].decode()
            if whole[k]:
                out[k] = self.tokenizer.encode(text, add_special_tokens=False).ids
                continue
            pieces = self.split(text)
            for p in pieces:
                if p not in of:
                    of[p] = self._ids(p.encode().decode("latin1").translate(self.letters))
            out[k] = [i for p in pieces for i in of[p]]
        return out

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (null is empty), and the n+1 offsets of the texts in them."""
        column = pc.fill_null(column.cast(pa.string()), "")
        data, at = utf8(column)
        kind = _CLASS[data]
        cut = np.zeros(len(data), bool)
        cut[1:] = _PARTS[kind[:-1] * np.uint8(8) + kind[1:]]
        spaces = np.flatnonzero(kind == 5)
        cut[spaces] = ~_maybe_space(data, spaces)
        whole = self._whole(column)
        for k in np.flatnonzero(whole).tolist():
            cut[at[k] : at[k + 1]] = False
        units = Units(data, at, cut)
        new = self.memo.missing(units.key)
        if self.memo.full(4 * len(new)):
            self.memo.clear()
            new = self.memo.missing(units.key)
        if len(new):
            owner = np.searchsorted(units.first, new, side="right") - 1
            lists = self._library(units.texts(new), self._single(kind, units)[new] & ~whole[owner], whole[owner])
            self.memo.add(units.key[new], np.fromiter((i for x in lists for i in x), np.int32), np.array([len(x) for x in lists], np.int32))
        ids, size = self.memo.ids(units.key)
        return ids.astype(self.kind), np.r_[0, np.cumsum(size, dtype=np.int64)][units.first]


@cache
def encoder(path: str) -> Encoder:
    """A worker's encoder; it remembers parts from task to task."""
    return Encoder(path)


def _maybe_space(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character before each position can be white space or a control. Bytes
    outside ASCII are looked at with the two before them: the last bytes of the white
    space of Unicode, which are fixed values."""
    one, two, three = (data[at - k] if len(at) else data[:0] for k in (1, 2, 3))
    return (
        (one <= 32) | (one == 127)
        | (two == 0xC2) & ((one == 0x85) | (one == 0xA0))
        | (three == 0xE1) & (two == 0x9A) & (one == 0x80)
        | (three == 0xE2) & (two == 0x80) & ((one <= 0x8A) | (one == 0xA8) | (one == 0xA9) | (one == 0xAF))
        | (three == 0xE2) & (two == 0x81) & (one == 0x9F)
        | (three == 0xE3) & (two == 0x80) & (one == 0x80)
    )


# ---- files -------------------------------------------------------------------------


def frames(ids: pa.Array, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frames of some sequences data[ends[i]:ends[i+1]] in one piece, and the length of each."""
    n, width = len(ids), data.itemsize
    held = np.diff(ends) * width
    body = HEAD + held
    begin = np.cumsum(body + 16) - body - 4
    out = np.zeros(int((body + 16).sum()), np.uint8)

    def put(where, values):
        for k in range(values.dtype.itemsize):
            out[where + k] = values.view(np.uint8).reshape(n, -1)[:, k]

    put(begin - 12, body.astype("<u8"))
    put(begin - 4, masked_crc32c(out, begin - 12, begin - 4).astype("<u4"))
    put(begin, ids.fill_null(0).to_numpy().astype("<i8"))
    put(begin + 8, np.asarray(ids.is_null()).astype(np.uint8))
    put(begin + 9, np.full(n, width, np.uint8))
    raw = data.view(np.uint8)
    for to, low, size in zip((begin + HEAD).tolist(), (ends[:-1] * width).tolist(), held.tolist(), strict=True):
        out[to : to + size] = raw[low : low + size]
    put(begin + body, masked_crc32c(out, begin, begin + body).astype("<u4"))
    return out, body + 16


MANIFEST = "part long, path string, n_docs long, n_tokens long, n_bytes long"


def write(df: DataFrame, folder: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end_id: int = 0) -> list[tuple]:
    """Encodes every text, appends `end_id`, and writes records in ascending doc_id order
    (nulls first; rows of one id in the order of their text's hash). Returns for each file
    its part, path, documents, ids, bytes: file k's ids follow those of file k-1. Null
    text is empty and gives the end id alone. An empty table gives no files; other columns
    are not read. Files are written under another name and
    then renamed, so a task that runs again replaces them whole."""
    at(folder)[0].create_dir(at(folder)[1], recursive=True)
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    order = ["doc_id", F.xxhash64("text")]

    def run(batches):
        part, coder = TaskContext.get().partitionId(), encoder(tokenizer)
        docs = tokens = size = 0
        temporary, data, index = f"{folder}/.{uuid.uuid4().hex}", None, None
        for piece in slices(batches, "text", 2 << 20):
            if data is None:
                files, path = at(temporary)
                data, index = files.open_output_stream(path), files.open_output_stream(f"{path}.index")
            ids, ends = coder.encode(piece.column(1))
            ids, ends = np.insert(ids, ends[1:], end_id), ends + np.arange(len(ends))
            framed, lengths = frames(piece.column(0), ids, ends)
            index.write(np.stack([size + np.cumsum(lengths) - lengths, tokens + ends[:-1]], axis=1).astype("<u8").tobytes())
            data.write(framed.tobytes())
            docs, tokens, size = docs + len(lengths), tokens + len(ids), size + len(framed)
        if data is not None:
            data.close()
            index.close()
            path = f"{folder}/part-{part:06d}.records"
            publish(f"{path}.index", f"{temporary}.index")
            publish(path, temporary)
            yield pa.RecordBatch.from_pylist([{"part": part, "path": path, "n_docs": docs, "n_tokens": tokens, "n_bytes": size}])

    # one row for each file comes to the driver
    return sorted(tuple(r) for r in rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, MANIFEST).collect())


def _parse(data: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Checks the frames that begin at `begin` (relative to `data`); where payloads stand."""
    word = lambda where, n: sum(data[where + k].astype(np.uint64) << np.uint64(8 * k) for k in range(n))
    size = word(begin, 8).astype(np.int64)
    low, high = begin + 12, begin + 12 + size
    if (word(begin + 8, 4) != masked_crc32c(data, begin, begin + 8)).any() or (word(high, 4) != masked_crc32c(data, low, high)).any():
        raise ValueError("a record's checksum is wrong")
    return low, high


def _decode(payload: bytes) -> tuple[int | None, np.ndarray]:
    ids = np.frombuffer(payload, f"<u{payload[9]}", offset=HEAD)
    return (None if payload[8] else int.from_bytes(payload[:8], "little", signed=True)), ids


def read(spark: SparkSession, manifest: list[tuple], ids: bool = True, piece: int = 4 << 20) -> DataFrame:
    """All records of the files: doc_id, start (ids of all records before it), n_tokens,
    ids_crc32 (of all ids as little-endian u32), and the ids. A task reads one file through
    its index in pieces of about `piece` bytes; wrong checksums are an error. No files give
    no rows."""
    schema = T.StructType.fromDDL("doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids)
    base, files = 0, []
    for _, path, _, n_tokens, n_bytes in sorted(manifest):
        files.append((path, base, n_bytes))
        base += n_tokens
    if not files:
        return spark.createDataFrame([], schema)

    sent = spark.sparkContext.broadcast(files)  # a line for each file

    def run(batches: Iterator[pa.RecordBatch]):
        for name, base, n_bytes in (sent.value[k] for b in batches for k in b.column(0).to_pylist()):
            store, path = at(name)
            with store.open_input_stream(f"{path}.index") as f:
                index = np.frombuffer(f.read(), "<u8").reshape(-1, 2).astype(np.int64)
            edges, k = np.r_[index[:, 0], n_bytes], 0
            with store.open_input_stream(path) as f:
                while k < len(index):
                    stop = max(k + 1, int(np.searchsorted(edges, edges[k] + piece, side="right")) - 1)
                    raw = f.read(int(edges[stop] - edges[k]))
                    low, high = _parse(np.frombuffer(raw, np.uint8), edges[k:stop] - edges[k])
                    found = [_decode(raw[a:b]) for a, b in zip(low.tolist(), high.tolist(), strict=True)]
                    out = [
                        pa.array([d for d, _ in found], pa.int64()),
                        pa.array(base + index[k:stop, 1]),
                        pa.array([len(x) for _, x in found], pa.int64()),
                        pa.array([zlib.crc32(x.astype("<u4").tobytes()) for _, x in found], pa.int64()),
                    ]
                    if ids:
                        flat = np.concatenate([x for _, x in found]).astype(np.int32)
                        out.append(pa.ListArray.from_arrays(np.r_[0, np.cumsum([len(x) for _, x in found])].astype(np.int32), flat))
                    yield pa.RecordBatch.from_arrays(out, names=schema.names)
                    k = stop

    return spark.range(0, len(files), 1, len(files)).mapInArrow(run, schema)


def fetch(path: str, numbers: list[int]) -> list[tuple[int | None, np.ndarray]]:
    """The records of these numbers of one file, in the order asked for: two small reads
    for each, of its index entry and its frame."""
    store, local = at(path)
    out = []
    with store.open_input_file(f"{local}.index") as index, store.open_input_file(local) as data:
        for n in numbers:
            offset = int(np.frombuffer(index.read_at(8, 16 * n), "<u8")[0])
            size = int.from_bytes(data.read_at(8, offset), "little")
            raw = data.read_at(size + 16, offset)
            _parse(np.frombuffer(raw, np.uint8), np.zeros(1, np.int64))
            out.append(_decode(raw[12 : 12 + size]))
    return out
