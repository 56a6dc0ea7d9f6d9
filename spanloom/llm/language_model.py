"""Gated recurrent language model: scores of whole documents, with an add-a-half unigram score beside.

Counts. Tokens are 64-bit hashes of words whose last bits hold a class of endings. Tasks count what they read,
buckets of hashes merge the counts, so every token of the training rows counts and no task sees them all. The
most frequent tokens (a bounded number) are broadcast with their counts; for the rest, documents send their
tokens to the buckets and get sums back.

Model. The recurrent network predicts the most frequent words and, for all others, their class of endings; a
word inside its class has its relative count, and what was never seen has the class's share of words seen once
(the unseen are one type, as in the unigram score). The state is gated: h' = h + z (c - h), with z and c from the
last token and h. The softmax is factored: first one of as many frequency classes as the root of the vocabulary,
then the word in it. The vocabulary has as many words as the root of the counted types, ``WORDS`` at least. Training
is truncated backpropagation by Adam in numpy over windows of ``WINDOW`` tokens, all lanes of documents side by
side, the state carried from window to window. Each round, every partition trains on its share of the training
rows from the same parameters, and the results are averaged by tokens; the rounds together read every row (of
very few rows, several times).
Scoring carries the state through each whole document.
"""

from __future__ import annotations

import io
import math
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import parts_for, runs, settle, spread, stored, words

#: Words of the network at least, and classes of endings.
WORDS, ENDINGS = 448, 64
HIDDEN, WINDOW, LANES = 16, 16, 512
#: Steps of a scored window at most, where few lanes go on.
LONGEST = 16 * WINDOW
ROUNDS = 2
#: Tokens of a window that is learnt from at full pace, and tokens whose probabilities are computed at once.
FULL, BLOCK = 4096, 1024
#: Tokens whose counts go to every task (12 bytes each).
FREQUENT = 400_000
#: Distinct tokens of pieces that a task holds before it sends them, and tokens per bucket, about.
FLUSH, BUCKET = 2 << 20, 8 << 20
REMEMBER = 400_000
#: Windows that a round of training has at least, and bytes of text for a task of it, about.
LEAST, SHARE = 100, 8 << 20
#: Tokens of documents whose lanes advance together.
TOGETHER = 3 << 20
END = -(1 << 63)  # the end token; its class of endings is 0
STOP = b"\n"  # no word
#: Rows whose words are scored at once, over the whole vocabulary instead of class by class.
FEW = 32


def keys_of(found: list[bytes]) -> np.ndarray:
    """Hashes of words; the last six bits tell the class of a word's ending (its last two bytes)."""
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    endings = np.frombuffer(b"".join([w[-2:].ljust(2, b"\0") for w in found]), "<u2") % 61
    out = ((hashes & ~np.uint64(ENDINGS - 1)) | endings.astype(np.uint64)) ^ np.uint64(1 << 63)
    out = out.view(np.int64)
    out[[w == STOP for w in found]] = END
    return out


class Known(dict):
    """Numbers of distinct words in the order they were met; the new ones wait in ``new``."""

    def __init__(self):
        super().__init__({STOP: 0})
        self.new = [STOP]

    def __missing__(self, word: bytes) -> int:
        found = self[word] = len(self)
        self.new.append(word)
        return found


class Keys:
    """Texts as numbers of distinct words, each hashed and looked up once as long as it is remembered.

    ``derive`` gives columns for new keys; ``columns`` holds them for all words that are remembered.
    """

    def __init__(self, derive=lambda keys: ()):
        self.derive, self.known, self.columns = derive, Known(), None

    def of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words of all texts, each text followed by the end (0), and the length of each."""
        if len(self.known) > REMEMBER:
            self.known, self.columns = Known(), None
        split = [[*words(t), STOP] for t in texts]
        sizes = np.array([len(found) for found in split], np.int64)
        numbers = np.fromiter(map(self.known.__getitem__, chain.from_iterable(split)), np.int64, int(sizes.sum()))
        self.extend()
        return numbers, sizes

    def extend(self) -> None:
        if self.known.new:
            new = keys_of(self.known.new)
            self.known.new = []
            more = (new, *self.derive(new))
            self.columns = more if self.columns is None else tuple(np.concatenate([a, b]) for a, b in zip(self.columns, more))

    def counted(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys of some texts and how often each occurs."""
        if len(self.known) > REMEMBER:
            self.known, self.columns = Known(), None
        found = Counter(chain.from_iterable(map(words, texts)))
        found[STOP] = len(texts)
        numbers = np.fromiter(map(self.known.__getitem__, found), np.int64, len(found))
        self.extend()
        return self.columns[0][numbers], np.fromiter(found.values(), np.int64, len(found))


def training(doc_id: str, rest: int = 1, parts: int = 5) -> Column:
    """Rows to learn from: crc32 of the id as text, modulo ``parts``, is not ``rest`` (a null id may be learnt from)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts != rest, F.lit(True))


# --- counts ---


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    return keys[first], np.add.reduceat(counts, np.flatnonzero(first)) if len(keys) else counts


def dealt(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    to = (keys >> 6) % buckets
    order = np.argsort(to, kind="stable")
    cuts = np.searchsorted(to[order], np.arange(buckets + 1))
    for k in np.flatnonzero(np.diff(cuts)).tolist():
        yield k, order[cuts[k] : cuts[k + 1]]


def count(rows: DataFrame, buckets: int) -> DataFrame:
    """Counts of all keys of ``rows.body``: a row per bucket with its keys and counts, sorted, and their statistics."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, held, total = Keys(), [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            k, c = summed(*np.concatenate(held, axis=1))
            for to, rows in dealt(k, buckets):
                yield pa.RecordBatch.from_pydict({"bucket": pa.array([to], pa.int64()), "payload": [k[rows].tobytes() + c[rows].tobytes()]})

        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                held.append(np.stack(keys.counted(batch.column("body").slice(at, 2000).to_pylist())))
                total += held[-1].shape[1]
                if total >= FLUSH:
                    yield from flush()
                    held, total = [], 0
        if total:
            yield from flush()

    def merge(group: pd.DataFrame) -> Iterator[pd.DataFrame]:
        both = [np.frombuffer(p, np.int64).reshape(2, -1) for p in group["payload"]]
        k, c = summed(np.concatenate([b[0] for b in both]), np.concatenate([b[1] for b in both]))
        ending = k & (ENDINGS - 1)
        values, times = np.unique(c, return_counts=True)
        yield pd.DataFrame({
            "bucket": [group["bucket"].iloc[0]], "payload": [k.tobytes() + c.tobytes()], "tokens": [int(c.sum())], "types": [len(k)],
            "by_ending": [np.stack([np.bincount(ending, c, ENDINGS), np.bincount(ending, c == 1, ENDINGS)]).astype(np.int64).tobytes()],
            "spectrum": [np.stack([values, times]).astype(np.int64).tobytes()],
        })

    sent = rows.mapInArrow(local, "bucket long, payload binary").repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return sent.mapInPandas(lambda frames: runs(frames, ["bucket"], merge), "bucket long, payload binary, tokens long, types long, by_ending binary, spectrum binary")


def frequent(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys with the highest counts, at most ``most`` (all with a count or none), sorted by key."""
    spectrum: dict[int, int] = {}
    for row in counts.select("spectrum").toLocalIterator():
        for value, times in np.frombuffer(bytes(row["spectrum"]), np.int64).reshape(2, -1).T.tolist():
            spectrum[value] = spectrum.get(value, 0) + times
    least, total = 1 << 62, 0
    for value in sorted(spectrum, reverse=True):
        if total + spectrum[value] > most:
            break
        least, total = value, total + spectrum[value]

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload in batch.column("payload").to_pylist():
                k, c = np.frombuffer(payload, np.int64).reshape(2, -1)
                yield pa.RecordBatch.from_pydict({"payload": [k[c >= least].tobytes() + c[c >= least].tobytes()]})

    parts = [np.frombuffer(bytes(r["payload"]), np.int64).reshape(2, -1) for r in counts.select("payload").mapInArrow(pick, "payload binary").toLocalIterator()]
    k, c = np.concatenate([np.zeros((2, 0), np.int64), *parts], axis=1)
    order = np.argsort(k)
    return k[order], c[order]


# --- the network ---


def words_for(types: int) -> int:
    """Words that the network knows in a corpus of so many types: they grow with it."""
    return max(WORDS, math.isqrt(types))


def initial(weights: np.ndarray) -> dict[str, np.ndarray]:
    """Parameters that begin as the unigram distribution ``weights`` over the vocabulary (most frequent first)."""
    rng = np.random.default_rng(3)
    share = weights / weights.sum()
    classes = math.isqrt(len(share))
    cuts = np.unique(np.concatenate([[0], np.searchsorted(np.cumsum(share), np.arange(1, classes) / classes) + 1, [len(share)]]))
    cuts = cuts[cuts <= len(share)]
    owner = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
    by_class = np.bincount(owner, share)
    return {
        "cuts": cuts.astype(np.int64),
        "E": rng.normal(0, 0.1, (len(share), 2 * HIDDEN)).astype(np.float32),
        "U": rng.normal(0, 0.5 / HIDDEN**0.5, (HIDDEN, 2 * HIDDEN)).astype(np.float32),
        "C": rng.normal(0, 0.02, (HIDDEN, len(cuts) - 1)).astype(np.float32),
        "c": np.log(by_class).astype(np.float32),
        "W": rng.normal(0, 0.02, (HIDDEN, len(share))).astype(np.float32),
        "w": np.log(share / by_class[owner]).astype(np.float32),
    }


def states(p: dict, x: np.ndarray, fresh: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, list]:
    """States after each step of a window (steps by lanes); ``fresh`` resets the state before a step."""
    inputs = p["E"][x]
    goes_on = (~fresh).astype(np.float32)[:, :, None]
    out = np.empty((*x.shape, HIDDEN), np.float32)
    kept = []
    for t in range(len(x)):
        before = h * goes_on[t]
        a = before @ p["U"]
        a += inputs[t]
        z = np.exp(-a[:, :HIDDEN])
        z += 1
        np.reciprocal(z, out=z)
        c = np.tanh(a[:, HIDDEN:])
        h = out[t]
        np.subtract(c, before, out=h)
        h *= z
        h += before
        kept.append((before, z, c))
    return out, kept


def reaches(weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """The most that each column of ``h @ weights + bias`` can be away from 0: no state is outside [-1, 1]."""
    return np.abs(weights).sum(axis=0) + np.abs(bias)


def ones(n: int, held: np.ndarray = np.ones(1 << 14, np.float32)) -> np.ndarray:
    return held[:n] if n <= len(held) else np.ones(n, np.float32)


def exponentials(h: np.ndarray, weights: np.ndarray, bias: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Exponentials of ``h @ weights + bias``, scaled per row where they could overflow, and the sum of each row."""
    a = h @ weights
    a += bias
    if reach > 40:
        a -= a.max(axis=1, keepdims=True)
    np.exp(a, out=a)
    return a, a @ ones(a.shape[1])


def log_probabilities(p: dict, h: np.ndarray, y: np.ndarray, slopes: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Natural log of the probability of each ``y`` after state ``h``; with ``slopes``, adds gradients of their sum."""
    cuts = p["cuts"]
    classes = len(cuts) - 1
    class_of = np.repeat(np.arange(classes, dtype=np.uint8 if classes < 256 else np.int64), np.diff(cuts))
    owner = class_of[y]
    order = np.argsort(owner, kind="stable")  # words of a class stand side by side
    ends = np.cumsum(np.bincount(owner, minlength=classes))
    h, y, owner = h[order], y[order], owner[order]
    rows = np.arange(len(y))
    out = np.empty(len(y), np.float32)
    back = None if slopes is None else np.empty((len(y), HIDDEN), np.float32)
    backward = np.ascontiguousarray(p["C"].T)
    reach = float(reaches(p["C"], p["c"]).max())
    for begin in range(0, len(y), BLOCK):  # what fits in a near cache
        some = slice(begin, begin + BLOCK)
        inner, at = rows[: len(y[some])], owner[some]
        e, total = exponentials(h[some], p["C"], p["c"], reach)
        out[some] = np.log(np.maximum(e[inner, at] / total, np.float32(1e-38)))
        if slopes is not None:
            e *= (-1 / total)[:, None]
            e[inner, at] += 1
            slopes["C"] += h[some].T @ e
            slopes["c"] += ones(len(e)) @ e
            np.matmul(e, backward, out=back[some])
    reach_of = np.maximum.reduceat(reaches(p["W"], p["w"]), cuts[:-1])
    begin = 0
    if len(y) <= FEW and reach_of.max() <= 40:
        e = exponentials(h, p["W"], p["w"], 0)[0]
        e *= class_of == owner[:, None]
        total = e.sum(axis=1)
        out += np.log(np.maximum(e[rows, y] / total, np.float32(1e-38)))
        if slopes is not None:
            e *= (-1 / total)[:, None]
            e[rows, y] += 1
            slopes["W"] += h.T @ e
            slopes["w"] += e.sum(axis=0)
            back += e @ p["W"].T
        ends = ends[:0]
    for k, end in enumerate(ends.tolist()):
        low, high = int(cuts[k]), int(cuts[k + 1])
        if end > begin and high - low > 1:
            some = slice(begin, end)
            e, total = exponentials(h[some], p["W"][:, low:high], p["w"][low:high], reach_of[k])
            inner, at = rows[: end - begin], y[some] - low
            out[some] += np.log(np.maximum(e[inner, at] / total, np.float32(1e-38)))
            if slopes is not None:
                e *= (-1 / total)[:, None]
                e[inner, at] += 1
                slopes["W"][:, low:high] += h[some].T @ e
                slopes["w"][low:high] += ones(len(e)) @ e
                back[some] += e @ p["W"][:, low:high].T
        begin = end
    given = np.empty_like(out)
    given[order] = out
    if back is not None:
        unsorted = np.empty_like(back)
        unsorted[order] = back
        back = unsorted
    return given, back


def lanes(docs: list[np.ndarray], count: int) -> list[list[int]]:
    """Documents dealt to lanes of about equal length, the longest lane first."""
    load = np.zeros(max(1, min(count, len(docs))), np.int64)
    out: list[list[int]] = [[] for _ in load]
    for d in sorted(range(len(docs)), key=lambda d: -len(docs[d])):
        k = int(load.argmin())
        out[k].append(d)
        load[k] += len(docs[d])
    return [out[k] for k in np.argsort(-load, kind="stable")]


def windows(docs: list[np.ndarray], first: int, count: int, most: int = WINDOW) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Windows over documents (arrays of vocabulary numbers that end with the end token ``first``).

    Inputs, targets and fresh marks (steps by lanes; -1: past the lane's end), and the document of each target.
    A window of few lanes has more steps, for about ``FULL`` tokens, but no more than ``most``.
    """
    dealt_out = [lane for lane in lanes(docs, count) if lane]
    if not dealt_out:
        return
    targets = [np.concatenate([docs[d] for d in lane]) for lane in dealt_out]
    owner = [np.repeat(lane, [len(docs[d]) for d in lane]) for lane in dealt_out]
    longest = len(targets[0])
    y = np.full((longest, len(targets)), -1, np.int32)
    who = np.full((longest, len(targets)), -1, np.int32)
    for k, (t, o) in enumerate(zip(targets, owner)):
        y[: len(t), k], who[: len(t), k] = t, o
    x = np.full_like(y, first)
    x[1:] = np.where(y[:-1] < 0, first, y[:-1])
    fresh = np.ones_like(y, bool)
    fresh[1:] = who[1:] != who[:-1]
    t = 0
    while t < longest:
        live = int((y[t] >= 0).sum())  # lanes are sorted, so those that go on are the first ones
        end = t + min(most, max(WINDOW, FULL // live))
        yield x[t:end, :live], y[t:end, :live], fresh[t:end, :live], who[t:end, :live]
        t = end


class Trainer:
    def __init__(self, p: dict[str, np.ndarray], pace: float = 0.01):
        self.names = [k for k in p if k != "cuts"]
        cuts = np.cumsum([p[k].size for k in self.names])[:-1]
        # What is kept by name are views of one array each.
        self.all = np.concatenate([p[k].ravel() for k in self.names])
        self.all_slopes, self.all_first, self.all_second = (np.zeros_like(self.all) for _ in range(3))
        self.p, self.slopes, self.first = (
            {k: part.reshape(p[k].shape) for k, part in zip(self.names, np.split(a, cuts))} for a in (self.all, self.all_slopes, self.all_first)
        )
        self.p["cuts"] = p["cuts"].copy()
        self.steps, self.tokens, self.pace = 0, 0, pace

    def learn(self, docs: list[np.ndarray], first: int) -> None:
        h = np.zeros((0, HIDDEN), np.float32)
        for x, y, fresh, _ in windows(docs, first, LANES):
            if x.shape[1] > len(h):
                h = np.zeros((x.shape[1], HIDDEN), np.float32)
            h = self.window(x, y, fresh, h[: x.shape[1]])

    def window(self, x: np.ndarray, y: np.ndarray, fresh: np.ndarray, h: np.ndarray) -> np.ndarray:
        p = self.p
        out, kept = states(p, x, fresh, h)
        given = y.ravel() >= 0
        slopes = self.slopes
        self.all_slopes.fill(0)
        _, back = log_probabilities(p, out.reshape(-1, HIDDEN)[given], y.ravel()[given], slopes)
        whole = np.zeros((x.size, HIDDEN), np.float32)
        whole[given] = back
        whole = whole.reshape(*x.shape, HIDDEN)
        gates = np.empty((*x.shape, 2 * HIDDEN), np.float32)
        later = np.zeros_like(h)
        goes_on, recurrent = (~fresh).astype(np.float32)[:, :, None], np.ascontiguousarray(p["U"].T)
        before, z, c = (np.stack(part) for part in zip(*kept))
        stays = 1 - z
        factors = np.concatenate([stays * z * (c - before), z * (1 - c * c)], axis=2).reshape(*x.shape, 2, HIDDEN)
        split = gates.reshape(*x.shape, 2, HIDDEN)
        for t in range(len(x) - 1, -1, -1):
            d = whole[t]
            d += later
            np.multiply(d[:, None, :], factors[t], out=split[t])
            later = gates[t] @ recurrent
            d *= stays[t]
            later += d
            later *= goes_on[t]
        slopes["U"] += before.reshape(-1, HIDDEN).T @ gates.reshape(-1, 2 * HIDDEN)
        order = np.argsort(x.ravel(), kind="stable")
        seen, starts = np.unique(x.ravel()[order], return_index=True)
        slopes["E"][seen] = np.add.reduceat(gates.reshape(-1, 2 * HIDDEN)[order], starts, axis=0)
        n = int(given.sum())
        self.steps += 1
        self.tokens += n
        one, two = 1 - 0.9**self.steps, 1 - 0.99**self.steps
        pace = np.float32(self.pace * min(1.0, n / FULL))  # windows of few lanes say little
        g = self.all_slopes / n
        self.all_first *= 0.9
        self.all_first += 0.1 * g
        self.all_second *= 0.99
        self.all_second += 0.01 * g * g
        g = np.sqrt(self.all_second / two)
        g += 1e-6
        self.all += pace * (self.all_first / one) / g
        return out[-1]


def log10_of(p: dict, docs: list[np.ndarray], first: int) -> np.ndarray:
    """The network's log10 probability of each whole document."""
    out = np.zeros(len(docs))
    h = np.zeros((0, HIDDEN), np.float32)
    for x, y, fresh, who in windows(docs, first, 2 * LANES, LONGEST):
        if x.shape[1] > len(h):
            h = np.zeros((x.shape[1], HIDDEN), np.float32)
        after, _ = states(p, x, fresh, h[: x.shape[1]])
        given = y.ravel() >= 0
        found, _ = log_probabilities(p, after.reshape(-1, HIDDEN)[given], y.ravel()[given])
        out += np.bincount(who.ravel()[given], found.astype(np.float64), len(docs))
        h = after[-1]
    return out / math.log(10)


class Vocabulary:
    """The network's tokens: endings and frequent words, by falling weight."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, by_ending: np.ndarray, size: int = WORDS):
        best = np.lexsort((keys, -counts))[:size]
        if END not in keys[best]:
            best = np.append(best, np.flatnonzero(keys == END))
        chosen, weight = keys[best], counts[best]
        inside = np.bincount(chosen & (ENDINGS - 1), weight, ENDINGS)
        once = np.bincount(chosen & (ENDINGS - 1), weight == 1, ENDINGS)
        self.rest, self.once = np.maximum(by_ending[0] - inside, 0.0), np.maximum(by_ending[1] - once, 0.0)
        weights = np.concatenate([weight, self.rest + 0.5])
        tokens = np.concatenate([chosen, np.arange(ENDINGS)])
        order = np.argsort(-weights, kind="stable")
        self.weights = np.maximum(weights[order], 0.5)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        sort = np.argsort(chosen)
        self.words, self.numbers = chosen[sort], place[: len(chosen)][sort]
        self.endings = place[len(chosen) :]
        at = np.searchsorted(self.words, END)
        self.end = int(self.numbers[at]) if at < len(self.words) and self.words[at] == END else int(self.endings[0])
        #: Share of a class of endings that goes to the unseen: that of words seen once.
        self.unseen = (self.once + 0.5) / (self.rest + 1.0)

    def numbers_of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of each key, and whether it is a word of its own."""
        at = np.minimum(np.searchsorted(self.words, keys), max(0, len(self.words) - 1))
        own = self.words[at] == keys if len(self.words) else np.zeros(len(keys), bool)
        return np.where(own, self.numbers[at] if len(self.words) else 0, self.endings[keys & (ENDINGS - 1)]), own

    def inside(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """log10 of the probability of words (none of its own) inside their classes of endings."""
        b = keys & (ENDINGS - 1)
        seen = np.log10(1 - np.minimum(self.unseen[b], 0.5)) + np.log10(np.maximum(counts, 1)) - np.log10(np.maximum(self.rest[b], 1))
        return np.where(counts > 0, seen, np.log10(np.minimum(self.unseen[b], 0.5)))


# --- jobs ---


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of batches with about so much text that their tokens may be held together."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column("body")), 0).to_numpy(zero_copy_only=False) // 6 + 1)
        cuts = np.unique(np.searchsorted(sizes, np.arange(0, int(sizes[-1]) if len(sizes) else 0, TOGETHER), side="left"))
        for a, b in zip(cuts, [*cuts[1:], batch.num_rows]):
            yield batch.slice(int(a), int(b - a))


def packed(p: dict[str, np.ndarray]) -> bytes:
    file = io.BytesIO()
    np.savez(file, **p)
    return file.getvalue()


def unpacked(raw: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(raw)) as saved:
        return {k: saved[k] for k in saved.files}


def train(rows: DataFrame, vocabulary: Vocabulary, volume: int, rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    """Parameters after ``rounds`` of training on ``rows`` (doc_id, body) of ``volume`` bytes, each on its own share."""
    context = rows.sparkSession.sparkContext
    p = initial(vocabulary.weights)

    def averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, tokens = None, 0
        for batch in batches:
            for raw, n in zip(batch.column("model").to_pylist(), batch.column("tokens").to_pylist()):
                one = unpacked(raw)
                total = {k: v * float(n) + (total[k] if total else 0.0) for k, v in one.items()}
                tokens += n
        if tokens:
            yield pa.RecordBatch.from_pydict({"model": [packed({k: v / tokens for k, v in total.items()})], "tokens": pa.array([tokens], pa.int64())})

    for k in range(rounds):
        shared = context.broadcast((p, vocabulary))

        def learn(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            settle()
            begin, v = shared.value
            trainer, keys = Trainer(begin), Keys(lambda new: v.numbers_of(new)[:1])
            docs: list[np.ndarray] = []
            for batch in batches:
                for at in range(0, batch.num_rows, 500):
                    numbers, sizes = keys.of(batch.column("body").slice(at, 500).to_pylist())
                    docs += np.split(keys.columns[1][numbers].astype(np.int32), np.cumsum(sizes)[:-1])
                    if sum(map(len, docs)) >= TOGETHER:
                        trainer.learn(docs, v.end)
                        docs = []
            trainer.learn(docs, v.end)
            while docs and trainer.steps < LEAST:  # a small share is read again
                trainer.learn(docs, v.end)
            if trainer.tokens:
                yield pa.RecordBatch.from_pydict({"model": [packed(trainer.p)], "tokens": pa.array([trainer.tokens], pa.int64())})

        part = rows.where(F.pmod(F.xxhash64(F.lit("round"), F.col("doc_id"), F.col("body")), F.lit(rounds)) == k).select("body").coalesce(parts_for(volume, SHARE))
        models = part.mapInArrow(learn, "model binary, tokens long").repartition(16).mapInArrow(averaged, "model binary, tokens long")
        found = [(unpacked(bytes(r["model"])), r["tokens"]) for r in models.collect()]  # at most 16
        total = sum(n for _, n in found)
        if total:
            p = {name: (value if name == "cuts" else sum(m[name] * (n / total) for m, n in found).astype(np.float32)) for name, value in p.items()}
        shared.unpersist()
    return p


def score(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` per row.

    * null, empty and wordless texts are the end token alone; a null id is learnt from.
    * without training rows nothing is known: the base gives every token one half of one half, the network its start.
    * repeated rows count as often as they occur and get equal scores; an empty table gives an empty result.
    * other columns are not read.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("body"))
    learnt = source.where(training("doc_id"))
    volume = learnt.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    buckets = max(spread(spark), parts_for(int(volume) // 6, BUCKET))
    counts = stored(count(learnt.select("body"), buckets), "counts")
    facts = counts.select("tokens", "types", "by_ending").toLocalIterator()
    n = types = 0
    by_ending = np.zeros((2, ENDINGS), np.int64)
    for row in facts:
        n, types = n + row["tokens"], types + row["types"]
        by_ending += np.frombuffer(bytes(row["by_ending"]), np.int64).reshape(2, -1)
    top_keys, top_counts = frequent(counts, FREQUENT)
    vocabulary = Vocabulary(top_keys, top_counts, by_ending, words_for(types))
    p = train(learnt, vocabulary, int(volume)) if n else initial(vocabulary.weights)
    shared = spark.sparkContext.broadcast((p, vocabulary, top_keys, top_counts))
    below = math.log10(n + 0.5 * (types + 1))

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        model, v, known, times = shared.value
        def facts_of(new: np.ndarray) -> tuple:
            number, own = v.numbers_of(new)
            at = np.minimum(np.searchsorted(known, new), max(0, len(known) - 1))
            here = known[at] == new if len(known) else np.zeros(len(new), bool)
            c = np.where(here, times[at], 0) if len(known) else np.zeros(len(new), np.int64)
            return number.astype(np.int32), here, np.where(here, np.log10(c + 0.5), 0.0), np.where(here & ~own, v.inside(new, c), 0.0)

        keys, at_row = Keys(facts_of), TaskContext.get().partitionId() << 32
        held: list[np.ndarray] = []
        total = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, total
            k, row, often = np.concatenate(held, axis=1) if held else np.zeros((3, 0), np.int64)
            for to, rows in dealt(k, buckets):
                yield whole(bucket=[to], payload=[k[rows].tobytes() + row[rows].tobytes() + often[rows].tobytes()])
            held, total = [], 0

        for piece in pieces(batches):
            docs, seen, base, inner, sizes = [], [], [], [], []
            for start in range(0, piece.num_rows, 500):
                numbers, size = keys.of(piece.column("body").slice(start, 500).to_pylist())
                number, here, log_count, inside = (c[numbers] for c in keys.columns[1:])
                begins = np.cumsum(size) - size
                docs += np.split(number, begins[1:])
                seen.append(np.add.reduceat(here, begins, dtype=np.int64))
                base.append(np.add.reduceat(log_count, begins))
                inner.append(np.add.reduceat(inside, begins))
                sizes.append(size)
                rare = np.flatnonzero(~here)
                if len(rare):
                    row = np.repeat(np.arange(len(size)), size)[rare]
                    k = keys.columns[0][numbers[rare]]
                    order = np.lexsort((k, row))
                    row, k = row[order], k[order]
                    first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (k[1:] != k[:-1])))
                    held.append(np.stack([k[first], at_row + row[first], np.diff(np.append(first, len(k)))]))
                    total += len(first)
                at_row += len(size)
            if docs:
                join = np.concatenate
                ids = at_row - len(docs) + np.arange(len(docs))
                network = log10_of(model, docs, v.end)
                yield whole(row=ids, doc_id=piece.column("doc_id"), n_tokens=join(sizes), n_known=join(seen), base=join(base), model=network + join(inner))
            if total >= FLUSH:
                yield from flush()
        yield from flush()

    fields = pa.schema([("bucket", pa.int64()), ("payload", pa.binary()), ("row", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("model", pa.float64())])

    def whole(**values) -> pa.RecordBatch:
        size = len(next(iter(values.values())))
        return pa.RecordBatch.from_arrays([values[f.name] if isinstance(values.get(f.name), pa.Array) else pa.array(values.get(f.name, [None] * size), f.type) for f in fields], schema=fields)

    def look_up(group: pd.DataFrame) -> Iterator[pd.DataFrame]:
        v = shared.value[1]
        given = [np.frombuffer(p, np.int64) for p, kind in zip(group["payload"], group["kind"]) if kind == 0]
        asked = [np.frombuffer(p, np.int64).reshape(3, -1) for p, kind in zip(group["payload"], group["kind"]) if kind == 1]
        if not asked:
            return
        known, times = given[0].reshape(2, -1) if given else np.zeros((2, 0), np.int64)
        k, row, often = np.concatenate(asked, axis=1)
        at = np.minimum(np.searchsorted(known, k), max(0, len(known) - 1))
        c = np.where(known[at] == k, times[at], 0) if len(known) else np.zeros(len(k), np.int64)
        rows, place = np.unique(row, return_inverse=True)
        add = lambda values: np.bincount(place, values, len(rows))
        yield pd.DataFrame({"row": rows, "n_known": add(often * (c > 0)).astype(np.int64), "base": add(often * np.log10(c + 0.5)), "model": add(often * v.inside(k, c))})

    passed = stored(source.mapInArrow(first_pass, "bucket long, payload binary, row long, doc_id long, n_tokens long, n_known long, base double, model double"), "passed")
    asked = passed.where("bucket IS NOT NULL").select("bucket", "payload", F.lit(1).alias("kind"))
    both = asked.unionByName(counts.select("bucket", "payload", F.lit(0).alias("kind")))
    ordered = both.repartition(buckets, "bucket").sortWithinPartitions("bucket", "kind")
    sums = ordered.mapInPandas(lambda frames: runs(frames, ["bucket"], look_up), "row long, n_known long, base double, model double")
    own = passed.where("bucket IS NULL").select("row", "doc_id", "n_tokens", "n_known", "base", "model")
    none = F.lit(None).cast("long")
    every = own.unionByName(sums.select("row", none.alias("doc_id"), none.alias("n_tokens"), "n_known", "base", "model"))
    out = every.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.sum("base").alias("base"), F.sum("model").alias("score"))
    return out.select(
        "doc_id", (~training("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * below).alias("base_score"), "score",
    )
