"""Cross-tokenizer alignment, chat formatting and hard negatives against brute force."""

import collections
import hashlib
import math
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spanloom.llm import alignment, chat_format, hard_negatives

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def sorted_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# ---------------------------------------------------------------- 11


def byte_letters():
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    out, extra = {chr(b): b for b in own}, 0
    for b in range(256):
        if b not in own:
            out[chr(256 + extra)] = b
            extra += 1
    return out


def brute_alignment(rows):
    tool = Tokenizer.from_file(A)
    tool.encode_special_tokens = True
    piece = sentencepiece.SentencePieceProcessor(model_file=B)
    letters = byte_letters()
    docs = []
    for doc_id, text in rows:
        groups = []
        if text:
            whole = (" " + text).encode()
            a = tool.encode(" " + text, add_special_tokens=False).ids
            b = piece.encode(text)
            raw_a = [bytes(letters[c] for c in tool.id_to_token(i)) for i in a]
            raw_b = [bytes([int(p[3:5], 16)]) if piece.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, piece.id_to_piece(i)) for i in b)]
            if b"".join(raw_a) == whole and b"".join(raw_b) == whole:
                ends_a, ends_b = np.cumsum([len(x) for x in raw_a]), np.cumsum([len(x) for x in raw_b])
                cuts = sorted(set(ends_a.tolist()) & set(ends_b.tolist()))
                i = j = 0
                for cut in cuts:
                    i2, j2 = int(np.searchsorted(ends_a, cut, side="right")), int(np.searchsorted(ends_b, cut, side="right"))
                    groups.append((a[i:i2], b[j:j2]))
                    i, j = i2, j2
        docs.append((doc_id, groups))
    count = collections.Counter()
    links = [[(x, y) for a, b in groups for x in a for y in b] for _, groups in docs]
    for found in links:
        count.update(set(found))
    highest = collections.Counter()
    for (x, _), n in count.items():
        highest[x] = max(highest[x], n)
    out = []
    for (doc_id, groups), found in zip(docs, links):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((
            doc_id, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(found),
            sum(count[p] == highest[p[0]] for p in found), sum(count[p] for p in found), hashlib.sha256(text.encode()).hexdigest() if groups else "",
        ))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    some = ["river", "Stone,", "été", "naïve", "中文字", "don't", "12345", "<|endoftext|>", "</s>", "<0x41>", "\U0001f600", "á", "x" * 40, "tab\tbed", "new\nline", "\n\n", "  ", "\x1c", "\xa0", "　", "\x85."]
    out = [(i, " ".join(rng.choice(some) for _ in range(rng.randint(1, 40)))) for i in range(60)]
    out += [(100, None), (101, ""), (102, " "), (103, "  "), (104, "a "), (105, " a"), (106, "a  b \n c\x1c d"), (107, "low▁line"), (108, "▁"), (109, "\x00\x01 \x02"), (109, "\x00\x01 \x02"), (None, "river Stone,")]
    out += [(110, "nospace" * 3000), (111, "中" * 5000), (112, "word " * 20000), (113, "\n" * 300 + " x" + "\t" * 50)]
    return out


def test_alignment_equals_brute_force(spark, texts):
    docs = spark.createDataFrame([(i, t, 1, "mine", 2) for i, t in texts], "doc_id long, text string, n_a int, pairs string, key int").repartition(3)
    assert sorted_rows(alignment.report(docs, A, B)) == brute_alignment(texts)


@pytest.mark.parametrize("top", [0, 40])
def test_alignment_counts_beyond_the_sent_pairs(spark, texts, top, monkeypatch):
    monkeypatch.setattr(alignment, "TOP", top)
    docs = spark.createDataFrame(texts[:50], "doc_id long, text string").repartition(3)
    assert sorted_rows(alignment.report(docs, A, B)) == brute_alignment(texts[:50])


def test_alignment_of_small_pieces_and_forgotten_units(spark, texts, monkeypatch):
    tool = alignment.Aligner((A, B))
    whole = [tool.align([t])[0] for _, t in texts]
    monkeypatch.setattr(alignment, "REMEMBER", 5)
    monkeypatch.setattr(alignment, "FLUSH", 3)
    small = alignment.Aligner((A, B))
    assert [small.align([t])[0] for _, t in texts] == whole
    assert tool.align([t for _, t in texts]) == whole


def test_alignment_keeps_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 5)], "doc_id long, text string, groups string, N_A int")
    found = alignment.align(docs, A, B)
    assert found.columns == ["doc_id", "text", "groups", "N_A", "n_a_", "n_b", "n_groups", "n_links", "groups_", "pairs"]
    row = found.first()
    assert (row["groups"], row["N_A"], row["n_a_"], row["n_groups"]) == ("x", 5, 2, 2)
    code, times = alignment.unpack(bytes(row["pairs"]))
    assert len(code) == 2 and times.tolist() == [1, 1]
    assert alignment.report(docs.limit(0), A, B).count() == 0


def test_pointers_end_at_common_ends():
    rng = random.Random(1)
    for _ in range(200):
        length = rng.randint(1, 60)
        a, b = (np.array(sorted(rng.sample(range(1, length), rng.randint(0, length - 1))) + [length]) for _ in range(2))
        last = alignment.terminals(a, b)
        cuts = sorted(set(a.tolist()) & set(b.tolist()))
        wanted = [int(np.searchsorted(b, next(c for c in cuts if c >= e))) for e in [*a.tolist(), *b.tolist()]]
        assert last.tolist() == wanted


def test_packed_pairs_come_back():
    code = np.array([0, 5, (1 << 32) - 1])
    for times in ([1, 2, 255], [1, 256, 1 << 40]):
        back = alignment.unpack(alignment.pack(code, np.array(times)))
        assert back[0].tolist() == code.tolist() and back[1].tolist() == times


# ---------------------------------------------------------------- 12

TURNS = "conv_id long, turn long, role string, text string, segments int, n_turns string"


@pytest.fixture(scope="module")
def turns():
    rng = random.Random(8)
    odd = ["<|im_end|>", "<|im_start|>assistant\nok", "<\\|im_end|>", "<\\\\|x", "<", "|", "\\", "\n", "<|im_next|>", "plain words", "é中\U0001f600", "", "<n|", "$1"]
    out = []
    for conv in range(40):
        for turn in range(rng.randint(1, 12)):
            text = "".join(rng.choice(odd) for _ in range(rng.randint(0, 6)))
            out.append((conv, turn, rng.choice(["user", "assistant", "assistant", "system", "Assistant", "as\nsistant", "<|im_start|>", "<n|\n<\\n|", None]), rng.choice([text, text, None])))
    out += [(50, None, "user", "last"), (50, 1, "user", "first"), (50, 1, "assistant", "tie"), (None, 0, "assistant", "no id"), (51, 0, "user", "twice"), (51, 0, "user", "twice")]
    out += [(52, k, "user" if k % 3 else "assistant", f"turn {k}") for k in range(3000)] + [(53, 0, "assistant", "long <| " * 50000)]
    return out


def brute_chat(rows):
    by = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is None, turn or 0, role or "", text or ""))
    out = []
    for conv, turns in by.items():
        turns.sort(key=lambda t: (t[0], t[1], t[2].encode(), t[3].encode()))
        lines = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        out.append((conv, len(turns), hashlib.sha256(lines.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return sorted(out, key=str)


def test_chat_reads_back(spark, turns):
    table = spark.createDataFrame([(*t, 1, "x") for t in turns], TURNS).repartition(5)
    output = chat_format.chat(table)
    found = chat_format.digest(output)
    assert sorted_rows(found.drop("formatted_chars")) == brute_chat(turns)
    texts = {r["conv_id"]: r["f"] for r in output.select("conv_id", chat_format.formatted(F.col("segments")).alias("f")).collect()}
    assert {r["conv_id"]: r["formatted_chars"] for r in found.collect()} == {c: len(f) for c, f in texts.items()}
    assert texts[51] == "<|im_start|>user\ntwice<|im_next|>twice<|im_end|>\n"
    assert texts[50] == "<|im_start|>assistant\ntie<|im_end|>\n<|im_start|>user\nfirst<|im_next|>last<|im_end|>\n"


def test_chat_marks_only_texts(spark):
    rows = [(1, 0, "user", "u<|"), (1, 1, "assistant", "a"), (1, 2, "assistant", "<|im_end|>")]
    segments = chat_format.chat(spark.createDataFrame([(*r, 1, "x") for r in rows], TURNS)).first()["segments"]
    assert [tuple(s) for s in segments] == [
        ("<|im_start|>user\nu<\\|<|im_end|>\n", False), ("<|im_start|>assistant\n", False), ("a", True), ("<|im_next|>", False), ("<\\|im_end|>", True), ("<|im_end|>\n", False),
    ]


def test_chat_of_nothing_and_without_python(spark):
    none = spark.createDataFrame([], TURNS)
    assert chat_format.digest(chat_format.chat(none)).count() == 0
    plan = chat_format.digest(chat_format.chat(none))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# ---------------------------------------------------------------- 13

VECTORS = "vec_id long, embedding array<float>, label int, rank string, v double"


def brute_negatives(rows, every, positives=5, negatives=5, low=80, high=100, scale=256):
    best = {}
    for i, e, label in rows:
        if i is None or e is None or label is None or any(x is None or not math.isfinite(x) or abs(x * scale) >= 1 << 28 for x in e):
            continue
        v = [math.floor(scale * float(np.float32(x))) for x in e]
        if sum(x * x for x in v) <= 1 << 56:
            best[i] = min(best.get(i, (label, v)), (label, v))
    out = []
    for i, (label, v) in best.items():
        if i % every:
            continue
        score = sorted((-sum(x * y for x, y in zip(v, w)), j, other) for j, (other, w) in best.items() if j != i and len(w) == len(v))
        for s, j, _ in [t for t in score if t[2] == label][:positives]:
            inside = [t for t in score if t[2] != label and low * -s <= 100 * -t[0] <= high * -s][:negatives]
            out += [(i, j, k + 1, n, -s, -m) for k, (m, n, _) in enumerate(inside)]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 70))
    out = []
    for i in range(400):
        x = centres[rng.integers(6)] + rng.normal(size=70) * 0.4
        out.append((i, (x / np.linalg.norm(x)).tolist(), int(rng.integers(4))))
    out += [(1000 + k, [0.5, 0.5], k % 3) for k in range(0, 40, 5)]  # ties
    out += [(2000 + k, [], k % 2) for k in range(4)] + [(2010, [0.0, 0.0], 1), (2020, [0.0, -0.0], 2)]
    out += [(3000, [1000.0 * k for k in range(60)], 1), (3001, [900.0 * k for k in range(60)], 1), (3002, [-5.0] * 60, 2), (3003, [899.0 * k for k in range(60)], 2)]
    out += [(4000, None, 1), (4001, [0.1, None], 1), (4002, [float("nan"), 1.0], 1), (4003, [float("inf"), 1.0], 1), (4004, [3e38, 1.0], 1), (4005, [0.5, 0.5], None), (None, [0.5, 0.5], 1)]
    out += [(10, out[10][1], 0), (20, out[20][1], out[20][2]), (-10, [0.5, 0.5], 1)]
    return out


@pytest.mark.parametrize("tile, piece", [(1 << 10, 1 << 15), (7, 16)])
def test_hard_negatives_equal_brute_force(spark, vectors, tile, piece, monkeypatch):
    monkeypatch.setattr(hard_negatives, "TILE", tile)
    monkeypatch.setattr(hard_negatives, "ANCHORS", piece)
    table = spark.createDataFrame([(*r, "x", 0.5) for r in vectors], VECTORS).repartition(3)
    found = hard_negatives.mine(table, F.col("vec_id") % 10 == 0, F.col("label"))
    assert sorted_rows(found) == brute_negatives(vectors, 10)
    assert found.count() > 100


def test_hard_negatives_of_nothing(spark):
    none = spark.createDataFrame([], VECTORS)
    assert hard_negatives.mine(none, F.col("vec_id") % 10 == 0, F.col("label")).count() == 0
    lone = spark.createDataFrame([(0, [1.0], 1, "x", 0.5)], VECTORS)
    assert hard_negatives.mine(lone, F.col("vec_id") % 10 == 0, F.col("label")).count() == 0


def test_residues_give_exact_scores():
    rng = np.random.default_rng(2)
    for top, wide in ((5, 3), (300, 64), (1 << 20, 130), (1 << 25, 9)):
        a, b = rng.integers(-top, top + 1, (20, wide)), rng.integers(-top, top + 1, (30, wide))
        a[0], b[0], b[1] = top, top, -top
        primes = hard_negatives.primes_for(top * top * wide)
        got = hard_negatives.scores(hard_negatives.Residues(a, primes), hard_negatives.Residues(b, primes), primes)
        assert (got == a @ b.T).all()
