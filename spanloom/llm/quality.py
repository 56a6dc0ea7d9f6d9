"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network, a temperature.

Tokens are runs of letters, digits or signs, next to each its shape (capitals, length of a run of signs), next to
words whether one of the four words before is the same; all are hashed into ``BUCKETS``. A bucket's index vector is sparse and random, its word vector is its index
vector plus the sum of the index vectors of its neighbours in the sample. A document is the mean of the
vectors of its tokens. The network (tanh layer, logistic output) is trained by Adam in numpy on four fifths
of the sample; the last fifth sets the temperature that its probabilities are divided by.

The sample is bounded: about ``SAMPLE`` labelled rows, drawn by a hash of the id among those that may be
learnt from, so training is one task of fixed size. Scoring is one map over all whole texts; the first layer is
folded into the word vectors, so a token costs one row of ``HIDDEN`` numbers. The model (4 MB) is broadcast.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, free_name, settle, stored

SAMPLE = 3000
BUCKETS = 1 << 15
WIDTH, NONZERO, HIDDEN = 64, 8, 32
REMEMBER = 200_000
TOKEN = re.compile(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^\x00-\x20A-Za-z0-9\x80-\xff]+")


def shape(token: bytes) -> bytes:
    if is_word(token):
        kind = b"A" if token.isupper() and len(token) > 1 else b"Aa" if token[:1].isupper() else b"a"
        return b"\x01" + kind + bytes([min(len(token), 20) // 4])
    if token.isdigit():
        return b"\x010" + bytes([min(len(token), 8)])
    return b"\x01" + bytes(sorted(set(token)))[:4] + bytes([min(len(token), 4)])


def bucket(key: bytes) -> int:
    return xxhash.xxh3_64_intdigest(key) % BUCKETS


def features(token: bytes) -> tuple[int, int]:
    return bucket(token.lower()), bucket(shape(token))


AGAIN, NEW = bucket(b"\x02again"), bucket(b"\x02new")


def is_word(token: bytes) -> bool:
    return token[0] >= 0x80 or token.isalpha()


def seen_again(words: np.ndarray) -> np.ndarray:
    """Marks words that equal one of the four words before them."""
    out = np.zeros(len(words), bool)
    for k in range(1, 5):
        out[k:] |= words[k:] == words[:-k]
    return out


def stream(text: str | None) -> np.ndarray:
    """Buckets of a text: two for each token, a third for words (whether they repeat)."""
    tokens = TOKEN.findall(as_bytes(text))
    marks = iter(seen_again(np.array([xxhash.xxh3_64_intdigest(t) for t in tokens if is_word(t)], np.uint64)).tolist())
    return np.array([b for t in tokens for b in ((*features(t), AGAIN if next(marks) else NEW) if is_word(t) else features(t))], np.int64)


def held_out(doc_id: str, rest: int = 1, parts: int = 3) -> Column:
    """Rows that may not be learnt from: crc32 of the id as text, modulo ``parts``; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts == rest, F.lit(False))


def index_vectors() -> np.ndarray:
    rng = np.random.default_rng(7)
    out = np.zeros((BUCKETS, WIDTH), np.float32)
    for k in range(NONZERO):
        out[np.arange(BUCKETS), rng.integers(0, WIDTH, BUCKETS)] += rng.choice([-1.0, 1.0], BUCKETS)
    return out


def word_vectors(streams: list[np.ndarray]) -> np.ndarray:
    """Index vector plus neighbours' index vectors, both of length 1, for the buckets of a sample."""
    index = index_vectors()
    around = np.zeros((BUCKETS, WIDTH))
    for k in range(0, len(streams), 500):
        some = streams[k : k + 500]
        left, right = np.concatenate([s[:-1] for s in some]), np.concatenate([s[1:] for s in some])
        for j in range(WIDTH):
            around[:, j] += np.bincount(left, index[right, j], BUCKETS) + np.bincount(right, index[left, j], BUCKETS)
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)
    return (unit(index) + unit(around)).astype(np.float32)


def pool(vectors: np.ndarray, streams: list[np.ndarray]) -> np.ndarray:
    empty = np.zeros(vectors.shape[1], np.float32)
    return np.array([vectors[s].mean(axis=0) if len(s) else empty for s in streams]).reshape(len(streams), len(empty))


def fit(texts: list[str], labels: np.ndarray, epochs: int = 60, batch: int = 128) -> dict[str, np.ndarray]:
    """The model of a sample. Without both labels it gives every text their mean (no labels: one half)."""
    streams = [stream(x) for x in texts]
    rng = np.random.default_rng(11)
    vectors = word_vectors(streams)
    x, y = pool(vectors, streams).astype(np.float64), labels.astype(np.float64)
    mean, scale = (x.mean(axis=0), x.std(axis=0) + 1e-6) if len(x) else (np.zeros(WIDTH), np.ones(WIDTH))
    rate = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    parts = [rng.normal(0, WIDTH**-0.5, (WIDTH, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), np.array([np.log(rate / (1 - rate))])]
    heat = 1.0
    if 0 < y.sum() < len(y):
        z = (x - mean) / scale
        order = rng.permutation(len(y))
        test, train = order[: len(y) // 5], order[len(y) // 5 :]
        moments = [[np.zeros_like(p), np.zeros_like(p)] for p in parts]
        step = 0
        for epoch in range(epochs):
            for k in range(0, len(train), batch):
                rows = rng.permutation(train)[:batch] if k == 0 else train[k : k + batch]
                step += 1
                hidden = np.tanh(z[rows] @ parts[0] + parts[1])
                off = (1 / (1 + np.exp(-(hidden @ parts[2] + parts[3]))) - y[rows]) / len(rows)
                back = np.outer(off, parts[2]) * (1 - hidden**2)
                slopes = [z[rows].T @ back + 1e-4 * parts[0], back.sum(axis=0), hidden.T @ off + 1e-4 * parts[2], np.array([off.sum()])]
                pace = 0.01 * (1 - epoch / epochs)
                for p, g, m in zip(parts, slopes, moments):
                    m[0] = 0.9 * m[0] + 0.1 * g
                    m[1] = 0.999 * m[1] + 0.001 * g * g
                    p -= pace * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)
            train = rng.permutation(train)
        logits = np.tanh(z[test] @ parts[0] + parts[1]) @ parts[2] + parts[3]
        heats = np.geomspace(0.25, 8, 101)
        signed = np.where(y[test] > 0, logits, -logits)
        heat = float(heats[np.argmin([np.logaddexp(0, -signed / h).mean() for h in heats])]) if len(test) else 1.0
    folded = (vectors / scale) @ parts[0]  # mean over tokens and first layer commute
    return {"words": folded.astype(np.float32), "bias": parts[1] - (mean / scale) @ parts[0], "out": parts[2], "out_bias": parts[3], "heat": np.array([heat])}


class Scorer:
    def __init__(self, model: dict[str, np.ndarray]):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.number: dict[bytes, int] = {}
        self.rows = np.zeros((1 << 12, HIDDEN), np.float32)
        self.words = np.zeros(1 << 12, bool)

    def look_up(self, tokens: list[bytes]) -> np.ndarray:
        number, words = self.number, self.model["words"]
        for t in dict.fromkeys(t for t in tokens if t not in number):
            n = number[t] = len(number)
            if n >= len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
                self.words = np.concatenate([self.words, np.zeros_like(self.words)])
            self.words[n] = is_word(t)
            a, b = features(t)
            self.rows[n] = words[a] + words[b]
        return np.fromiter(map(number.__getitem__, tokens), np.int64, len(tokens))

    def score(self, texts: list[str | None]) -> np.ndarray:
        if len(self.number) > REMEMBER:
            self.forget()
        pooled = np.zeros((len(texts), HIDDEN))
        for i, text in enumerate(texts):
            found = self.look_up(TOKEN.findall(as_bytes(text)))
            if len(found):
                for k in range(0, len(found), 1 << 15):
                    pooled[i] += self.rows[found[k : k + (1 << 15)]].sum(axis=0, dtype=np.float64)
                words = found[self.words[found]]
                again = int(seen_again(words).sum())
                pooled[i] += again * self.model["words"][AGAIN].astype(np.float64) + (len(words) - again) * self.model["words"][NEW]
                pooled[i] /= 2 * len(found) + len(words)
        m = self.model
        logits = np.tanh(pooled + m["bias"]) @ m["out"] + m["out_bias"]
        return 1 / (1 + np.exp(-np.clip(logits / m["heat"], -500, 500)))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", doc_id: str = "doc_id", sample: int = SAMPLE) -> dict[str, np.ndarray]:
    """Fit on about ``sample`` labelled documents that are not held out.

    Null labels, ids without document and ids labelled both ways are left out; repeated equal labels count once.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(doc_id))
    known = known.groupBy(F.col(doc_id).alias("id")).agg(F.min(label).alias("low"), F.max(label).alias("high")).where("low = high")
    known = stored(known.select("id", F.col("low").cast("int").alias("label")), "labels")
    share = min(1.0, sample / max(1, known.count()))
    drawn = known.where(F.pmod(F.xxhash64(F.lit("quality"), "id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("body")).join(F.broadcast(drawn), "id")
    one = rows.repartition(1).sortWithinPartitions("id", "body")

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        settle()
        frame = pd.concat([*frames, pd.DataFrame({"id": [], "body": [], "label": []})])
        file = io.BytesIO()
        np.savez(file, **fit(frame["body"].tolist(), frame["label"].to_numpy(np.float64)))
        del frame
        settle()
        yield pd.DataFrame({"model": [file.getvalue()]})

    found = one.mapInPandas(work, "model binary").collect()
    if not found:
        return fit([], np.zeros(0))
    with np.load(io.BytesIO(bytes(found[0]["model"]))) as saved:
        return {k: saved[k] for k in saved.files}


def score(docs: DataFrame, model: dict[str, np.ndarray], text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 added.

    Null, empty and token-less texts get the score of an empty document. Repeated rows get equal scores, an
    empty table gives an empty result, other columns pass through (a clashing name adds underscores).
    """
    out = free_name(name, docs.columns)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        scorer = Scorer(shared.value)
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                piece = batch.slice(k, 1000)
                values = scorer.score(piece.column(text).to_pylist())
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(values, pa.float64())], names=[*piece.schema.names, out])

    return docs.mapInArrow(work, T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType(), False)]))


def report(scored: DataFrame) -> DataFrame:
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
