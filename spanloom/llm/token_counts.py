"""Token counts without tokenising: byte-level BPE compiled into a counting transducer.

The tokenizer's words are cut first (character classes come from the library's own pre-tokenizer). Inside a
word the tokenizer is a deterministic transducer over bytes: a state knows, for every position that a longer
token could still reach back to, the last token of the encoding up to there; a transition on a byte leads to
the next state and says how many tokens more (or fewer) the encoding has. States are compiled when first met.

A text is one stream of bytes in which every word start resets the state. The stream is cut into chunks, and
all chunks advance at once from a guessed start (the reset state). Then the heads of chunks are run again, all
at once, from the end state of the chunk before, until each run meets the guessed one or a word start. No state
maps are built and no prefix scan composes them; one word that fills many chunks is run serially.

One map over the documents, no shuffle.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, free_name, kept

CHUNK = 1024
#: Above so many compiled states, a worker starts over after the current piece.
STATES = 120_000
#: Remembered answers on which token may follow which.
FITS = 800_000
PIECE = 2 << 20
LETTER, NUMBER, OTHER, BLANK, SPACE = range(5)


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


class Transducer:
    """Counting transducer of one byte-level BPE vocabulary, compiled on demand."""

    def __init__(self, vocab: dict[str, int], merges: list, states: int = STATES):
        letters = byte_letters()
        as_raw = lambda s: bytes(letters[c] for c in s)
        self.raw = {as_raw(s): i for s, i in vocab.items() if all(c in letters for c in s)}
        self.token = {i: s for s, i in self.raw.items()}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.rank = {(as_raw(a), as_raw(b)): n for n, (a, b) in enumerate(pairs)}
        self.made = {a + b: (n, (a, b)) for (a, b), n in reversed(self.rank.items())}
        #: The tokens that what is there so far can still grow into.
        self.longer: dict[bytes, list[int]] = {}
        for s, i in self.raw.items():
            for k in range(1, len(s)):
                self.longer.setdefault(s[:k], []).append(i)
        self.limit = states
        self.reset()

    def reset(self) -> None:
        self.fits: dict[int, bool] = {}
        self.spines: dict[tuple[bytes, int], list] = {}
        #: A state: bytes that may still grow into a token, last token and count at each position before them.
        self.states: list[tuple[bytes, tuple[int, ...], tuple[int, ...]]] = [(b"", (-1,), (0,))]
        self.numbers = {self.states[0]: 0}
        self.next = np.full((1024, 256), -1, np.int32)
        self.gain = np.zeros((1024, 256), np.int8)

    def encode(self, piece: bytes) -> list[bytes]:
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best = min((self.rank.get(p, 1 << 60), i) for i, p in enumerate(zip(parts, parts[1:])))
            if best[0] == 1 << 60:
                break
            pair, merged, i = (parts[best[1]], parts[best[1] + 1]), [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                    merged.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    merged.append(parts[i])
                    i += 1
            parts = merged
        return parts

    def spine(self, token: bytes, side: int) -> list[tuple[bytes, int]]:
        """The parts of ``token`` at one end while it is merged, each with the rank of the merge that ends it."""
        key = (token, side)
        if key not in self.spines:
            out, end = [], 1 << 60
            while True:
                out.append((token, end))
                if token not in self.made:
                    break
                end, pair = self.made[token]
                token = pair[side]
            self.spines[key] = out[::-1]
        return self.spines[key]

    def follows(self, before: int, token: int) -> bool:
        """Whether the encoding may have ``token`` right after ``before`` (-1: at the start of a word).

        It may not where a merge over their border comes before the merges that end both parts there.
        """
        key = (before + 1) << 24 | token
        known = self.fits.get(key)
        if known is None:
            b = self.token[token]
            known = self.encode(b) == [b] if before < 0 else self.follows(-1, token)
            if known and before >= 0:
                left, right, i, j = self.spine(self.token[before], 1), self.spine(b, 0), 0, 0
                while known and (i < len(left) and j < len(right)):
                    (x, x_end), (y, y_end) = left[i], right[j]
                    rank = self.rank.get((x, y), 1 << 60)
                    known = not (rank < x_end and rank <= y_end and rank < 1 << 60)
                    i, j = (i + 1, j) if x_end <= y_end else (i, j + 1)
            if len(self.fits) >= FITS:
                self.fits.clear()
            self.fits[key] = known
        return known

    def told_apart(self, before: int, begun: bytes) -> int:
        """Stands for ``before`` among all last tokens that let the same tokens follow that begin with ``begun``."""
        follow = self.longer.get(begun, ())
        if len(follow) > 12:
            return before
        mask = sum(1 << n for n, t in enumerate(follow) if self.follows(before, t))
        return -2 - mask  # -2: nothing can follow here

    def compile(self, state: int, byte: int) -> None:
        tail, last, count = self.states[state]
        grown = tail + bytes([byte])
        for size in range(len(grown), 0, -1):
            token = self.raw.get(grown[-size:])
            before = last[len(grown) - size]
            if token is None or before == -2:
                continue
            if before > -2:
                if self.follows(before, token):
                    break
            else:  # one of few tokens; the mask says which may follow
                begun = self.longer[grown[-size:-1]]
                if token in begun and (-2 - before) >> begun.index(token) & 1:
                    break
        now = count[len(grown) - size] + 1
        last, count = (*last, token), (*count, now)
        keep = grown
        while keep and keep not in self.longer:
            keep = keep[1:]
        size = len(keep)
        last, count = last[-size - 1 :], count[-size - 1 :]
        # Only positions from which a token can still grow tell states apart.
        kept = []
        for j in range(size):
            begun = keep[j:]
            if last[j] == -2 or begun not in self.longer:
                kept.append(-2)
            elif last[j] < -2:  # fewer tokens are possible than one byte before
                was, could = -2 - last[j], self.longer[begun[:-1]]
                here = self.longer[begun]
                kept.append(-2 - sum(1 << n for n, t in enumerate(here) if was >> could.index(t) & 1))
            else:
                kept.append(self.told_apart(last[j], begun))
        first = next((j for j in range(size) if kept[j] != -2), size)
        new = (keep[first:], (*kept[first:], token), tuple(c - now if t != -2 else 0 for c, t in zip(count[first:], (*kept[first:], token))))
        number = self.numbers.setdefault(new, len(self.states))
        if number == len(self.states):
            self.states.append(new)
            if number >= len(self.next):
                self.next = np.concatenate([self.next, np.full_like(self.next, -1)])
                self.gain = np.concatenate([self.gain, np.zeros_like(self.gain)])
        self.next[state, byte] = number
        self.gain[state, byte] = now

    def step(self, state: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        to = self.next[state, byte]
        if to.min(initial=0) < 0:
            for s, b in {(int(s), int(b)) for s, b in zip(state[to < 0], byte[to < 0])}:
                self.compile(s, b)
            to = self.next[state, byte]
        return to, self.gain[state, byte]

    def run(self, stream: np.ndarray, fresh: np.ndarray) -> np.ndarray:
        """Tokens that each byte of ``stream`` adds; ``fresh`` marks the first bytes of words."""
        n = len(stream)
        at = np.arange(0, n, CHUNK)
        width = min(CHUNK, n)
        gains = np.zeros(n, np.int8)
        seen = np.zeros(n, np.int32)
        state = np.zeros(len(at), np.int32)
        for k in range(width):
            here = at + k
            if here[-1] >= n:
                at = at[:-1]
                here, state = here[:-1], state[:-1]
                if not len(here):
                    break
            state = np.where(fresh[here], 0, state)
            state, gains[here] = self.step(state, stream[here])
            seen[here] = state
        # Repair: run the heads again from the true start, round by round until every run has met the guess.
        heads = np.arange(CHUNK, n, CHUNK)
        state = seen[heads - 1]
        while len(heads):
            live = ~fresh[heads]
            heads, state = heads[live], state[live]
            if not len(heads):
                break
            state, gain = self.step(state, stream[heads])
            met = state == seen[heads]
            gains[heads] = gain
            seen[heads] = state
            heads, state = heads[~met] + 1, state[~met]
            inside = heads < n
            heads, state = heads[inside], state[inside]
        if len(self.states) > self.limit:
            self.reset()
        return gains


class Words:
    """Where a byte-level pre-tokenizer cuts; classes of characters are asked of the library, once each."""

    def __init__(self, pre_tokenizer):
        self.pre = pre_tokenizer
        self.classes = np.full(0x110000, -1, np.int8)
        self.classes[0x20] = SPACE

    def learn(self, points: np.ndarray) -> None:
        for p in np.unique(points[self.classes[points] < 0]).tolist():
            c = chr(p)
            cuts = lambda text: len(self.pre.pre_tokenize_str(text))
            kind = LETTER if cuts(f"a{c}a") == 1 else NUMBER if cuts(f"1{c}1") == 1 else OTHER if cuts(f"!{c}!") == 1 else BLANK
            self.classes[p] = kind

    def starts(self, points: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Marks the characters that begin a word; ``begins`` marks the first character of each text."""
        n = len(points)
        self.learn(points)
        kind = np.minimum(self.classes[points], BLANK)
        space = points == 0x20
        ends = np.append(begins[1:], True)
        after = np.append(kind[1:], -1)
        before = np.append(-1, kind[:-1])
        blank = kind == BLANK
        out = (kind != before) & ~blank & ~np.append(False, space[:-1])  # a lone space belongs to what follows
        out |= blank & (before != BLANK)
        out |= blank & (before == BLANK) & ~ends & (after != BLANK)  # the last of several blanks
        out |= begins
        # After 's 't 'm 'd 're 've 'll at the start of a word, the next character begins a word.
        quote = np.flatnonzero((points == 0x27) & out)
        if len(quote):
            padded = np.append(points, [0, 0, 0])
            limit = np.append(begins, [True, True, True])
            one, two = padded[quote + 1], padded[quote + 2]
            short = np.isin(one, [ord(c) for c in "stmd"]) & ~limit[quote + 1]
            long = ((np.isin(one, [ord("r"), ord("v")]) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))) & ~limit[quote + 1] & ~limit[quote + 2]
            out[np.concatenate([quote[short], quote[long]]) + 1] = False
            out_at = np.concatenate([quote[short] + 2, quote[long] + 3])
            out[out_at[out_at < n]] = True
        return out


class Counter:
    """Counts of one tokenizer file: texts in, number of tokens out, as the library gives them."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        if model["type"] != "BPE" or spec.get("normalizer") or not plain or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError("only byte-level BPE without normalizer can be compiled")
        self.specials = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        self.words = Words(Tokenizer.from_file(path).pre_tokenizer)
        self.transducer = Transducer(model["vocab"], model["merges"])

    def pieces(self, text: str) -> tuple[list[str], int]:
        """The text between special tokens, and how many of those there are."""
        parts, found = [text], 0
        for special in self.specials:
            split = [p.split(special) for p in parts]
            found += sum(len(p) - 1 for p in split)
            parts = [x for p in split for x in p]
        return [p for p in parts if p], found

    def count(self, texts: list[str]) -> list[int]:
        out = np.zeros(len(texts), np.int64)
        parts: list[str] = []
        owner: list[int] = []
        for i, text in enumerate(texts):
            found, out[i] = self.pieces(text)
            parts += found
            owner += [i] * len(found)
        if parts:
            joined = "".join(parts)
            points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
            stream = np.frombuffer(joined.encode("utf-8", "surrogatepass"), np.uint8)
            sizes = np.array([len(p) for p in parts])
            begins = np.zeros(len(points), bool)
            begins[np.cumsum(sizes) - sizes] = True
            first = (stream & 0xC0) != 0x80
            fresh = np.zeros(len(stream), bool)
            fresh[first] = self.words.starts(points, begins)
            text_starts = np.flatnonzero(first)[begins]
            np.add.at(out, np.array(owner), np.add.reduceat(self.transducer.run(stream, fresh), text_starts, dtype=np.int64))
        return out.tolist()


def count_tokens(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with ``n_bytes`` and ``n_tokens`` added, for the tokenizer file at ``path`` on every worker.

    * null and empty texts: 0 bytes, 0 tokens; very long texts are cut into chunks that advance side by side.
    * special strings inside a text count as the one token that the library makes of them.
    * every row is counted by itself, so repeated rows repeat; an empty table gives an empty result.
    * other columns pass through, also with these names (the new ones then get underscores).
    """
    names = [free_name(n, docs.columns) for n in ("n_bytes", "n_tokens")]
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, T.LongType(), False) for n in names)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = kept(Counter, path)
        for batch in batches:
            texts = [t or "" for t in batch.column(text).to_pylist()]
            counts: list[int] = []
            piece: list[str] = []
            size = 0
            for t in texts:
                piece.append(t)
                size += len(t)
                if size >= PIECE:
                    counts += tool.count(piece)
                    piece, size = [], 0
            counts += tool.count(piece)
            sizes = [len(as_bytes(t)) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], names=[*batch.schema.names, *names]
            )

    return docs.mapInArrow(work, schema)


def report(counted: DataFrame, limit: int, doc_id: str = "doc_id") -> DataFrame:
    return counted.select(F.col(doc_id).alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
