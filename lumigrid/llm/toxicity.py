"""Toxicity by compression distance.

Two zstandard dictionaries are trained, on ordinary text and on the windows in which
toxic text concentrates. A window that compresses shorter with the toxic dictionary than
with the ordinary one speaks for toxicity, the more bytes the more. How many windows of a
document do so by how many bytes is turned into a probability by a logistic curve, fitted
to labelled documents from which no dictionary was trained.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumigrid.llm.append import append
from lumigrid.llm.words import small_batches

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Labelled rows of each class that the dictionaries and the curve are fitted to, at most.
SAMPLE = {1: 2500, 0: 5000}
#: Bytes of a dictionary. Short offsets are what makes a match of one word pay.
DICTIONARY = 4096
#: Words of a window. One suits insults, and the windows of a corpus then repeat.
WINDOW = 1
#: From this score on a document is predicted to be toxic.
THRESHOLD = 0.3
#: The matcher leaves the last bytes of its input alone; these stand there.
PAD = b"\0" * 12
STEPS = 8  # gains of 1..STEPS bytes are told apart


def tokens(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode().lower())


def windows(words: list[bytes], size: int) -> list[bytes]:
    return words if size == 1 else [b" ".join(words[k : k + size]) for k in range(0, len(words), size)]


def train_dictionary(samples: list[bytes], size: int) -> bytes:
    """A dictionary's content: the segments that the trainer chooses, and, where it leaves
    room (it passes over much that repeats), the most frequent samples it left out."""
    try:
        content = zstandard.train_dictionary(size, samples, d=6, k=32).as_bytes()
    except zstandard.ZstdError:  # too little text to choose from
        content = b""
    more = []
    room = size - len(content)
    for s, _ in sorted(Counter(samples).items(), key=lambda x: (-x[1], x[0])) if room > 0 else ():
        if len(s) <= room and s not in content:
            more.append(s)
            room -= len(s)
    return b"\0" * 8 + b"".join(more[::-1]) + content


def telling_words(toxic: list[np.ndarray], ordinary: list[np.ndarray], n_words: int, least: int = 3, odds: float = 3.5) -> np.ndarray:
    """Whether each word, by its number from 1 on, follows more different words in toxic than
    in ordinary text, so that copies of one document count once: by e**odds as often, after
    `least` words or more."""

    def after(texts):
        pairs = [np.unique(np.r_[0, t[:-1]].astype(np.int64) * n_words + t) for t in texts if len(t)]
        different = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
        return np.bincount(different % n_words, minlength=n_words), max(len(different), 1)

    (bad, n), (good, m) = after(toxic), after(ordinary)
    return (np.log((bad + 0.5) / n) - np.log((good + 0.5) / m) >= odds) & (bad >= least)


@dataclass
class Model:
    """Two dictionaries, and the curve: weights of the features and of a constant."""

    ordinary: bytes
    toxic: bytes
    weights: np.ndarray
    window: int

    def scorer(self, kept: int = 400_000):
        """A function from text to score; gains of windows seen before are remembered."""

        def compressor(content):
            made = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            how = zstandard.ZstdCompressionParameters(window_log=16, chain_log=14, hash_log=14, search_log=4, min_match=4, target_length=32, strategy=zstandard.STRATEGY_GREEDY, write_content_size=False, write_checksum=False, write_dict_id=False)
            made.precompute_compress(compression_params=how)
            return zstandard.ZstdCompressor(dict_data=made, compression_params=how).compress

        plain, bad, memory = compressor(self.ordinary), compressor(self.toxic), {}

        def features(text: str | None) -> np.ndarray:
            found = windows(tokens(text), self.window)
            new = set(found).difference(memory)
            if len(memory) + len(new) > kept:
                memory.clear()
                new = set(found)
            for w in new:
                padded = b" " + w + b" " + PAD
                memory[w] = min(max(len(plain(padded)) - len(bad(padded)), 0), STEPS)
            gains = np.bincount(np.fromiter(map(memory.__getitem__, found), np.int64, len(found)), minlength=STEPS + 1)
            least = gains[::-1].cumsum()[::-1][1:]  # windows that gain k bytes or more
            return np.r_[np.log1p(least), least / max(len(found), 1) * 10, (least > 0).sum() / STEPS, 1.0]

        def score(text: str | None) -> float:
            return float(1 / (1 + np.exp(-np.clip(features(text) @ self.weights, -30, 30))))

        score.features = features
        return score


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Weights of a logistic regression, by Newton's steps with a ridge."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge * len(y) / 100)
    penalty[-1] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def held_out(doc_id: str):
    """Rows whose labels are never learnt from: crc32 of the id's text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample: dict[int, int] = SAMPLE, size: int = DICTIONARY, window: int = WINDOW) -> Model | None:
    """A model from labelled rows that are not held out; None unless both classes occur.

    At most sample[c] rows of class c are taken, those of least hash of the id; so many
    label rows are also the bound of what is broadcast. One task trains on them, so that
    texts never come to the driver, and the model does. Of the rows two thirds train the
    dictionaries, the others the curve. Labels are the only thing learnt from them;
    language, source and id are not inputs.
    """
    rows = labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_y")).where(F.col("_id").isNotNull() & ~held_out("_id")).distinct()
    drawn = None
    for c, n in sample.items():
        part = rows.where(F.col("_y") == c).orderBy(F.xxhash64("_id"), "_id").limit(n)
        drawn = part if drawn is None else drawn.unionByName(part)
    found = docs.select(F.col(doc_id).alias("_doc"), F.col(text).cast("string").alias("_text")).join(F.broadcast(drawn), F.col("_doc") == F.col("_id"))
    found = found.groupBy("_id").agg(F.min("_y").alias("_y"), F.min("_text").alias("_text"))  # a document of each id

    def run(batches):
        got = [(r["_id"], r["_y"], r["_text"] or "") for b in batches for r in b.to_pylist()]
        model = train(got, size, window)
        if model is not None:
            yield pa.RecordBatch.from_pylist([{"ordinary": model.ordinary, "toxic": model.toxic, "weights": model.weights.tolist()}], schema=TRAINED)

    small_batches(docs)
    made = found.repartition(1).mapInArrow(run, "ordinary binary, toxic binary, weights array<double>").collect()
    return Model(bytes(made[0].ordinary), bytes(made[0].toxic), np.array(made[0].weights), window) if made else None


#: A model as a row.
TRAINED = pa.schema([("ordinary", pa.binary()), ("toxic", pa.binary()), ("weights", pa.list_(pa.float64()))])


def train(got: list[tuple], size: int = DICTIONARY, window: int = WINDOW) -> Model | None:
    """A model from rows of id, label and text; None unless both classes occur."""
    got.sort(key=str)
    check = [(y, t) for _, y, t in got[::3]]
    number: dict[bytes, int] = {b"": 0}  # texts are held as the numbers of their words
    names = lambda t: np.fromiter((number.setdefault(w, len(number)) for w in tokens(t)), np.int32)
    bad, good = ([names(t) for k, (_, y, t) in enumerate(got) if k % 3 and y == c] for c in (1, 0))
    del got
    if not bad or not good or len({y for y, _ in check}) < 2:
        return None
    known = list(number)
    told = telling_words(bad, good, len(known))
    telling = {known[k] for k in np.flatnonzero(told).tolist()}
    del number
    spelled = lambda t: [known[k] for k in t.tolist()]
    whole = [b" ".join(spelled(t)) for t in bad]
    around = [b" " + w + b" " for t in bad for w in windows(spelled(t), window) if telling.intersection(w.split(b" "))]
    plain = [b" ".join(spelled(t)) for t in good]
    del known, bad, good
    toxic = around * 4 or whole
    model = Model(train_dictionary(plain, size), train_dictionary(toxic, size), np.zeros(2 * STEPS + 2), window)
    measure = model.scorer().features
    model.weights = fit_curve(np.array([measure(t) for _, t in check]), np.array([float(y) for y, _ in check]))
    return model


def score(docs: DataFrame, model: Model | None, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """`docs` with score (0 to 1, double) and predicted (1 if score >= threshold).

    Every word of a text counts, however long it is. Null and empty texts have no windows
    and get the curve's value there. Without a model (no labels of both classes) scores
    are 0. Rows are independent, repeated ones get equal scores; columns named as a result
    are replaced. No shuffle; what is sent is two dictionaries.
    """

    def make():
        of = model.scorer() if model else lambda _: 0.0

        def compute(column):
            scores = [of(t) for t in column.to_pylist()]
            return [scores, [int(s >= threshold) for s in scores]]

        return compute

    return append(docs, text, "score double, predicted int", make)


def remove(docs: DataFrame, model: Model | None, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` that are not predicted to be toxic, with docs' own columns."""
    mine = {f.name: f"_own_{i}" for i, f in enumerate(docs.schema.fields)}
    held = docs.select(*[F.col(f"`{n}`").alias(v) for n, v in mine.items()])
    kept = score(held, model, mine[text], threshold).where("predicted = 0")
    return kept.select(*[F.col(v).alias(n) for n, v in mine.items()])
