"""Each operator against a brute-force version, with nulls, empty and long texts, ties, repeated rows, empty tables
and columns whose names clash."""

import base64
import collections
import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spanloom.llm import decontaminate, graph, jaccard_join, language_model, mixing, pivots, quality, repeats, token_counts, token_files, warc
from spanloom.llm.common import words

DOCS = "doc_id long, text string, source string, score double, n_words long, size long, hit_spans string"
WORD = "the of and to in that river stone seven light carry under winter paper glass".split()


def prose(rng, n):
    return " ".join(rng.choice(WORD) + str(rng.randint(0, 60)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = [(i, prose(rng, rng.randint(1, 60)), rng.choice(["a", "b", "é", "", None])) for i in range(120)]
    base = prose(rng, 120)
    for k in range(30):  # near copies and copies
        w = base.split()
        w[rng.randrange(len(w))] = "changed"
        out.append((200 + k, " ".join(w) if k % 3 else base, "a"))
    out += [(300, None, None), (301, "", "b"), (302, " \t\r\n\x0b\x0c", "b"), (303, "One", "b"), (304, "one", "b"), (305, "one two", "c")]
    out += [(306, prose(rng, 9000), "c"), (307, "x" * 50000, "c"), (308, "ab" * 700, "c"), (308, "ab" * 700, "c"), (None, "the of and", "c")]
    out += [(309, "don't  I'LL<|endoftext|>stop <|startoftext|> é é 　 \xa0 中文 123 4.5 \x1f \x85", "c")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, 0.5, 7, 9, "mine") for i, t, s in rows], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def sorted_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# ---------------------------------------------------------------- 1


def brute_components(rows, size, num, den):
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and den * len(a & b) >= num * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(((i, len(sets[k]), least.get(find(k))) for k, (i, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("size,num,block", [(3, 90, 1024), (5, 80, 8), (3, 50, 8), (1, 80, 1024)])
def test_jaccard_join(docs, rows, monkeypatch, size, num, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "WIDE", block)
    found = sorted_rows(jaccard_join.classes(docs, size, num, 100))
    assert found == brute_components([(i, t) for i, t, _ in rows], size, num, 100)


def test_jaccard_keeps_one_of_each_group(docs, rows, none):
    kept = jaccard_join.keep_one(docs, 5, 80, 100)
    assert kept.columns == docs.columns
    component = {i: c for i, _, c in brute_components([(i, t) for i, t, _ in rows], 5, 80, 100)}
    expected = sorted((i for i, c in component.items() if i is not None and i == c))
    assert sorted(r.doc_id for r in kept.where("doc_id IS NOT NULL").collect()) == expected
    assert jaccard_join.keep_one(none).count() == 0 and jaccard_join.classes(none).count() == 0


def test_jaccard_keeps_texts_that_share_an_id(spark):
    rng = random.Random(8)
    a, b, c, d = (prose(rng, 60) for _ in range(4))
    given = [(1, a), (2, b), (2, c), (3, a + " end"), (3, d), (3, d), (4, d.upper()), (5, ""), (5, " "), (5, b + " end"), (6, c), (6, c + " end"), (None, a)]
    given += [(7, prose(rng, 60)) for _ in range(2)]
    near = prose(rng, 60)
    given += [(8, near), (8, near + " end")]  # one component of one id
    kept = jaccard_join.keep_one(spark.createDataFrame(given, "doc_id long, text string"))
    found = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    one = [r for r in found if r[0] == 8]
    assert len(one) == 1 and one[0] in given
    assert [r for r in found if r[0] != 8] == sorted([(1, a), (2, b), (2, c), (3, d), (5, ""), (5, " "), (None, a), *(r for r in given if r[0] == 7)], key=str)


@pytest.mark.parametrize("num", [50, 80, 90, 95])
def test_segments_never_miss_a_pair(num):
    sizes, rng = jaccard_join.Sizes(num, 100), np.random.default_rng(num)
    for _ in range(400):
        n = int(rng.integers(1, 400))
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        drop = int(rng.integers(0, 1 + len(a) * (100 - num) // 100))
        b = np.unique(np.concatenate([rng.permutation(a)[drop:], rng.integers(0, 1 << 63, int(rng.integers(0, 1 + drop)), dtype=np.uint64)]))
        common = np.sort(rng.permutation(a)[: int(rng.integers(0, len(a) + 1))])
        if len(b) and jaccard_join.similar(a, b, sizes):
            assert np.intersect1d(sizes.segments(a, common), sizes.segments(b, common)).size


@pytest.mark.parametrize("near,share", [(300, 0.3), (340, 0.3), (300, 0.5), (340, 0.5), (380, 0.5)])
def test_segments_meet_where_differences_hit_the_large_ones(near, share):
    sizes, rng = jaccard_join.Sizes(80, 100), np.random.default_rng(near)
    a = np.unique(rng.integers(0, 1 << 64, 2 * near, dtype=np.uint64))
    a = np.sort(rng.permutation(a)[: min(low for low in sizes.low if low >= near) + 2])
    common = np.sort(rng.permutation(a)[: int(len(a) * share)])
    mine = sizes.segments(a, common)
    lost = {int(s): set(np.setdiff1d(mine, sizes.segments(a[a != s], common)).tolist()) for s in a}
    b = a[np.isin(a, common[:3], invert=True)]  # of the smaller class, so they meet in the cuts of one class only
    while jaccard_join.similar(a, b, sizes):
        met = set(np.intersect1d(mine, sizes.segments(b, common)).tolist())
        assert met
        hit = [s for s in b.tolist() if lost.get(s, set()) & met]
        if not hit:
            break
        b = b[b != hit[0]]


@pytest.mark.parametrize("num", [50, 80, 90])
def test_sketches_differ_in_no_more_bits_than_sets_in_shingles(num):
    sizes, rng = jaccard_join.Sizes(num, 100), np.random.default_rng(num)
    for _ in range(300):
        a, b = (np.unique(rng.integers(0, 1 << 64, int(rng.integers(1, 600)), dtype=np.uint64)) for _ in range(2))
        b = np.unique(np.concatenate([a[int(rng.integers(0, len(a))) :], b[: int(rng.integers(0, 9))]]))
        x, y = (jaccard_join.parity(s, sizes.bits(sizes.own(len(s))))[None] for s in (a, b))
        width = min(x.shape[1], y.shape[1])
        assert (jaccard_join.folded(x, width)[0] == jaccard_join.parity(a, 64 * width)).all()
        apart = np.bitwise_count(jaccard_join.folded(x, width) ^ jaccard_join.folded(y, width)).sum()
        assert apart <= len(np.setxor1d(a, b))
        if jaccard_join.similar(a, b, sizes):
            assert abs(sizes.own(len(a)) - sizes.own(len(b))) <= 1


@pytest.mark.parametrize("table", [1, 1 << 20])
def test_near_sketches_connect_similar_sets_and_part_strangers(monkeypatch, table):
    monkeypatch.setattr(jaccard_join, "TABLE", table)
    sizes, rng = jaccard_join.Sizes(80, 100), np.random.default_rng(7)
    passage = rng.integers(0, 1 << 64, 100, dtype=np.uint64)  # strangers share half of their shingles
    bases = [np.unique(np.append(passage, rng.integers(0, 1 << 64, 100, dtype=np.uint64))) for _ in range(20)]
    sets = [np.unique(np.append(rng.permutation(b)[k:], rng.integers(0, 1 << 64, k, dtype=np.uint64))) for b in bases for k in (0, 3, 9)]
    sketches, lengths = np.stack([jaccard_join.parity(s, 256) for s in sets]), np.array([len(s) for s in sets])

    def label(links):
        return pivots.labels(len(sets), np.array([i for i, _ in links], np.int64), np.array([j for _, j in links], np.int64)).tolist()

    every = [(i, j) for i in range(len(sets)) for j in range(i) if jaccard_join.similar(sets[i], sets[j], sizes)]
    assert label(jaccard_join.near_links(sketches, lengths, None, lengths, sizes)) == label(every)
    across = [(i, j) for i, j in every if (i < 31) != (j < 31)]
    assert label(jaccard_join.near_links(sketches[:31], lengths[:31], sketches[31:], lengths[31:], sizes)) == label(across)


def test_tree_links_connect_what_all_pairs_connect():
    sizes, rng = jaccard_join.Sizes(80, 100), np.random.default_rng(2)
    bases = [np.unique(rng.integers(0, 1 << 63, int(rng.integers(2, 80)), dtype=np.uint64)) for _ in range(6)]
    sets = [np.unique(np.append(rng.permutation(b)[int(rng.integers(0, 3)) :], rng.integers(0, 1 << 63, int(rng.integers(0, 5)), dtype=np.uint64))) for b in bases for _ in range(30)]
    sets = [s for s in sets if len(s)]

    def label(n, links):
        return pivots.labels(n, np.array([i for i, _ in links], np.int64), np.array([j for _, j in links], np.int64)).tolist()

    every = [(i, j) for i in range(len(sets)) for j in range(i) if jaccard_join.similar(sets[i], sets[j], sizes)]
    assert label(len(sets), jaccard_join.tree_links(sets, None, sizes)) == label(len(sets), every)
    half = len(sets) // 2
    across = [(i, j) for i, j in every if (i < half) != (j < half)]
    assert label(len(sets), jaccard_join.tree_links(sets[:half], sets[half:], sizes)) == label(len(sets), across)


def brute_links(rows, size, num, den):
    sets = [{tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if (w := words(t)) else set() for _, t in rows]
    return [sum(1 for j, b in enumerate(sets) if i != j and a and b and den * len(a & b) >= num * len(a | b)) for i, a in enumerate(sets)]


@pytest.mark.parametrize("size,num,block,side", [(3, 90, 1024, 1 << 21), (5, 80, 8, 300), (3, 50, 8, 1 << 21), (1, 80, 1024, 300)])
def test_jaccard_counts_all_links(docs, rows, none, monkeypatch, size, num, block, side):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "SIDE", side)
    found = jaccard_join.classes(docs, size, num, 100, counted=True)
    given = [(i, t) for i, t, _ in rows]
    links = sorted(((i, n) for (i, _), n in zip(given, brute_links(given, size, num, 100))), key=str)
    assert sorted_rows(found.select("doc_id", "n_links")) == links
    assert sorted_rows(found.drop("n_links")) == brute_components(given, size, num, 100)
    assert jaccard_join.classes(none, counted=True).count() == 0


def test_tree_pairs_are_all_similar_pairs():
    sizes, rng = jaccard_join.Sizes(80, 100), np.random.default_rng(4)
    base = np.unique(rng.integers(0, 1 << 63, 60, dtype=np.uint64))
    sets = [np.unique(np.append(rng.permutation(base)[int(rng.integers(0, 8)) :], rng.integers(0, 1 << 63, 3, dtype=np.uint64))) for _ in range(150)]
    every = {(j, i) for i in range(150) for j in range(i) if jaccard_join.similar(sets[i], sets[j], sizes)}
    pairs = [(min(i, j), max(i, j)) for i, near in jaccard_join.tree_pairs(sets, None, sizes) for j in near.tolist()]
    assert len(pairs) == len(every) > 150 and set(pairs) == every  # a connecting forest has 149 at most
    for cut in (1, 9, 70):
        across = [(i, j) for i, near in jaccard_join.tree_pairs(sets[:cut], sets[cut:], sizes) for j in near.tolist()]
        assert len(across) == len(set(across)) and set(across) == {(i, j) for i, j in every if i < cut <= j}


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)]
    found = {r.id: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


# ---------------------------------------------------------------- 2, 4


def test_token_files(spark, docs, rows, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    tool, expected, every = Tokenizer.from_file(path), [], []
    for i, t, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*tool.encode(t or "", add_special_tokens=False).ids, 2]
        expected.append((i, len(every), len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        every += ids
    to = token_files.scratch_path(spark, "tokens")
    token_files.write(docs, path, to, 2)
    assert sorted_rows(token_files.documents(spark, to)) == sorted(expected, key=str)
    for a, b in ((0, 5), (len(every) // 2, len(every) // 2 + 999), (len(every) - 3, len(every)), (4, 4)):
        assert token_files.ids_between(spark, to, a, b).tolist() == every[a:b]
    assert token_files.round_trip(none, path).count() == 0


@pytest.mark.parametrize("bits", [1, 3, 8, 11, 16, 17, 24, 32])
def test_bit_packing(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1001).astype(np.uint32)
    packed = token_files.pack(ids, bits)
    assert len(packed) == -(-1001 * bits // 8)
    for a, b in ((0, 1001), (5, 6), (333, 777), (9, 9)):
        assert token_files.unpack(packed, bits, a, b).tolist() == ids[a:b].tolist()


def awkward(n):
    rng = random.Random(n)
    parts = [*"aabcdest'''  \t\n\x0b\x0c\r 　lmvrdABÉßẞİΣ1239!?.-_é中ñ́K😀\x1c\x85\xa0", "'s", "'ll", "'RE", "  ", "<|endoftext|>", "<|start", "don't ", "the ", " hello", "tion,", "straße."]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 50))) for _ in range(1500)] + ["a" * 5000, "ab" * 4000, " " * 3000, "!" * 2500 + "x", "the" * 2000]


def test_encoder_gives_what_the_library_gives():
    path = public_tokenizers.path("word_bpe_49k.json")
    texts, tool = awkward(1), Tokenizer.from_file(path)
    expected = [e.ids for e in tool.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in token_files.Encoder(path).encode(texts)] == expected


def test_encoder_sends_runs_of_letters_to_the_model_alone():
    path = public_tokenizers.path("word_bpe_49k.json")
    encoder, tool, asked = token_files.Encoder(path), Tokenizer.from_file(path), []

    class Asked:
        model = encoder.tool.model

        def encode_batch_fast(self, texts, **how):
            asked.extend(texts)
            return tool.encode_batch_fast(texts, **how)

    encoder.tool = Asked()
    texts = ["Paper lantern, 12 rivers... carry", "ungewöhnlich größe straße", "zzzqqxv " * 3, "", "don't"]
    assert [x.tolist() for x in encoder.encode(texts)] == [tool.encode(t, add_special_tokens=False).ids for t in texts]
    assert asked and not any(w.isascii() and w.isalpha() for t in asked for w in t.split())


def test_counter_gives_what_the_library_gives():
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts, tool = awkward(2), Tokenizer.from_file(path)
    expected = [len(e.ids) for e in tool.encode_batch(texts, add_special_tokens=False)]
    counter = token_counts.Counter(path)
    assert counter.count(texts) == expected
    counter.transducer.limit = 50  # states are forgotten and compiled again
    assert [n for k in range(0, len(texts), 100) for n in counter.count(texts[k : k + 100])] == expected


def test_token_counts(docs, rows, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tool = Tokenizer.from_file(path)
    expected = [(i, len((t or "").encode()), len(tool.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in rows]
    clash = docs.withColumn("n_bytes", F.lit("mine"))
    found = token_counts.count_tokens(clash, path)
    assert found.columns == [*clash.columns, "n_bytes_", "n_tokens"]
    assert sorted_rows(found.select("doc_id", "n_bytes_", "n_tokens")) == sorted(expected, key=str)
    assert token_counts.report(token_counts.count_tokens(none, path), 512).count() == 0


# ---------------------------------------------------------------- 3


def test_suffix_array_sorts_suffixes():
    rng = np.random.default_rng(0)
    for _ in range(300):
        s = rng.integers(1, int(rng.integers(2, 6)), int(rng.integers(0, 60))).astype(np.int64)
        assert repeats.suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


def brute_repeats(rows, length):
    seen = collections.Counter(b[i : i + length] for b in ((t or "").encode() for _, t in rows) for i in range(len(b) - length + 1))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        kept = bytes(x for x, y in zip(b, gone) if not y)
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("most,piece", [(2000, 1 << 20), (1, 1 << 20), (2000, 500)])
def test_repeats(spark, rows, none, monkeypatch, most, piece):
    monkeypatch.setattr(repeats, "MOST", most)
    monkeypatch.setattr(repeats, "PIECE", piece)
    rng = random.Random(3)
    passage = ["".join(rng.choice("abcdefgh ") for _ in range(90)) for _ in range(3)]
    more = [(400, "x" + passage[0] + "y"), (401, passage[0]), (402, passage[1][:49]), (403, passage[1][:49]), (404, passage[1][:50]), (405, passage[1][:50]), (406, "é" * 40 + passage[2] + "ü" + passage[2][:70]), (None, passage[2][5:66]), (407, "z" * 60 + "b" + "a" * 80)]
    given = [(i, t) for i, t, _ in rows if t is None or len(t) < 3000] + more
    found = repeats.remove(spark.createDataFrame(given, "doc_id long, text string"), length=50, gram=12)
    assert sorted_rows(repeats.report(found)) == brute_repeats(given, 50)
    if piece == 500:
        assert repeats.remove(none).count() == 0


def test_repeats_joins_texts_alike_at_every_size(spark, capsys):
    given = [(i, "".join(random.Random(i % 3).choice("abcdefgh ") for _ in range(300))) for i in range(6)]
    found = repeats.remove(spark.createDataFrame(given, "doc_id long, text string"))
    found.explain()
    plan = capsys.readouterr().out
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
    assert plan.count("Exchange hashpartitioning") == 1  # the spans alone: texts stay in their buckets
    assert sorted_rows(repeats.report(found)) == brute_repeats(given, 200)


def test_contexts_are_cut_to_what_they_share():
    rng = random.Random(8)
    any_of = lambda n: bytes(rng.randrange(256) for _ in range(n))
    gram, left, right = any_of(12), any_of(20), any_of(25)
    contexts = [any_of(18) + left + gram + any_of(38), any_of(18) + left + gram + right + any_of(13), any_of(38) + gram + right + any_of(13), any_of(38) + any_of(12) + any_of(38)]
    sizes = np.array([len(c) for c in contexts])
    first = np.cumsum(sizes) - sizes
    low, high = repeats.trimmed(np.frombuffer(b"".join(contexts), np.uint8), first, first + sizes, first + 38, 50, 12)
    for k, (begin, end) in enumerate([(18, 50), (18, 75), (38, 75)]):  # what another context has too is kept
        assert low[k] - first[k] <= begin and high[k] - first[k] >= end
    assert (high - low)[0] < 50 and (high - low)[3] < 50 and (high - low)[1] >= 50


# ---------------------------------------------------------------- 5


PAGES = [
    (1, "http://A.example.com:80/x y\r\nz", None), (2, None, ""), (None, None, "q"), (None, "::", "q"), (4, "http://[bad", "WARC/1.1\r\n\r\n\r\n\r\nContent-Length: 5\r\n\r\n"),
    (4, "http://[bad", "WARC/1.1\r\n\r\n\r\n\r\nContent-Length: 5\r\n\r\n"), (5, "http://é.fr/ü?ñ=1#f", "q"), (6, "h", "ü" * 90000), (7, "http://b.example.com/", "same"), (8, "http://b.example.com/", "same"), (9, "http://b.example.com/", "other"),
]


@pytest.mark.parametrize("least,lines", [(0, 3000), (5, 2)])
def test_warc(spark, monkeypatch, least, lines):
    monkeypatch.setattr(warc, "LINES", lines)
    pages = spark.createDataFrame([(*p, "extra") for p in PAGES], "page_id long, url string, html string, payload string")
    top, expected = {}, []
    for i, _, t in PAGES:
        b = (t or "").encode()
        top[b] = max((x for x in (top.get(b), i) if x is not None), default=None)
    for i, _, t in PAGES:
        b = (t or "").encode()
        first = top[b] if len(b) >= least else None
        response = first is None or i == first
        expected.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if response else "revisit", None if response else first))
    assert sorted_rows(warc.round_trip(pages, least)) == sorted(expected, key=str)
    archive = warc.scratch_path(spark, "archive")
    warc.write(pages, archive, least)
    for c in warc.read(spark, archive).where("record_type = 'response'").collect():
        headers, block = warc.fetch(spark, c.file, c.offset, c.length)
        payload = block.partition(b"\r\n\r\n")[2]
        assert len(payload) == c.payload_bytes and headers["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_surt():
    assert warc.surt("https://www.Example.org/a?b=1") == "org,example,www)/a?b=1"
    assert warc.surt("http://x.org:8080") == "org,x:8080)/" and warc.surt(None) == ")" and warc.surt("::") == ")::"


# ---------------------------------------------------------------- 6


@pytest.mark.parametrize("block", [1024, 7])
def test_pivots(spark, monkeypatch, block):
    monkeypatch.setattr(pivots, "BLOCK", block)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16))
    given = [(int(i), (centres[i % 12] + rng.normal(size=16) * (0.05 if i % 2 else 0.6)).astype(float).tolist()) for i in range(240)]
    given += [(500, None), (501, []), (502, [0.0] * 16), (503, [math.nan] * 16), (504, [1.0, None]), (505, given[0][1]), (505, given[0][1]), (506, given[0][1][:8]), (507, [-x for x in given[0][1]]), (508, [1e300] * 16), (509, [1e-300] * 16), (None, given[0][1])]
    unit = [pivots.unit(v) for _, v in given]
    n = len(given)
    links = [(i, j) for i in range(n) for j in range(i) if unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.95]
    root = pivots.labels(n, np.array([i for i, _ in links]), np.array([j for _, j in links]))
    least, degree = {}, collections.Counter(k for pair in links for k in pair)
    for k, (i, _) in enumerate(given):
        if i is not None:
            least[root[k]] = min(i, least.get(root[k], i))
    expected = sorted(((i, degree[k], least.get(root[k]), i == least.get(root[k])) for k, (i, _) in enumerate(given)), key=str)
    table = spark.createDataFrame([(i, v, "x") for i, v in given], "vec_id long, embedding array<double>, weight string")
    found = sorted_rows(pivots.near_duplicates(table))
    recall = sum(min(f[1], e[1]) for f, e in zip(found, expected)) / max(1, sum(e[1] for e in expected))
    assert recall >= 0.9 and all(f[1] <= e[1] for f, e in zip(found, expected))
    assert found == expected
    assert pivots.near_duplicates(table.limit(0)).count() == 0


def test_pivots_find_partners_near_the_threshold(spark):
    rng = np.random.default_rng(12)
    one = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    a = one(rng.normal(size=(3000, 64)))
    away = rng.normal(size=a.shape)
    away = one(away - (away * a).sum(axis=1, keepdims=True) * a)
    cosine = rng.uniform(0.95, 0.97, (3000, 1))
    x = np.concatenate([a, cosine * a + np.sqrt(1 - cosine**2) * away])
    unit = np.stack([pivots.unit(v) for v in x])
    i, j = np.nonzero(np.triu(unit @ unit.T >= 0.95, 1))
    degree = np.bincount(np.concatenate([i, j]), minlength=len(x))
    assert len(pivots.choose(list(unit[: pivots.SAMPLE]))) == 256 and len(i) > 2900
    table = spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    found = {r.vec_id: r.n_links for r in pivots.near_duplicates(table).select("vec_id", "n_links").collect()}
    assert all(found[k] <= degree[k] for k in range(len(x)))
    recall = sum(found.values()) / degree.sum()
    print(f"recall {recall:.4f} of {len(i)} pairs")
    assert recall >= 0.9


# ---------------------------------------------------------------- 7


def test_quality(spark):
    rng = random.Random(1)
    given = [(i, prose(rng, 60) if i % 3 else " ".join(w.upper() + "!!" for w in prose(rng, 60).split()), i % 3) for i in range(900)]
    docs = spark.createDataFrame([(i, t, 0.1) for i, t, _ in given] + [(1000, None, 0.1), (1001, "", 0.1), (None, "the of", 0.1)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, int(y > 0)) for i, _, y in given] + [(5, 0), (None, 1), (7, None)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    scored = quality.score(docs, model)
    assert scored.columns == ["doc_id", "text", "score", "score_"]
    found = {r.doc_id: r for r in quality.report(scored.drop("score").withColumnRenamed("score_", "score")).collect()}
    held = [(r, int(y > 0)) for (i, _, y) in given if (r := found[i]).held_out]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in found.items() if i is not None)
    assert np.mean([r.predicted == y for r, y in held]) > 0.95
    assert found[1000].score == found[1001].score and 0 <= found[1000].score <= 1 and not found[None].held_out
    # labels of held-out rows change nothing
    flipped = labels.withColumn("quality", F.when(quality.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert all(np.array_equal(a, model[k]) for k, a in quality.train(docs, flipped).items())
    assert quality.score(docs.limit(0), quality.train(docs.limit(0), labels.limit(0))).count() == 0


# ---------------------------------------------------------------- 8


def test_shares():
    sizes = np.array([100.0, 10.0, 50.0, 0.0])
    found = mixing.shares(sizes, np.array([1.0, 2.0, 3.0, 1.0]))
    target, open_ = np.zeros(4), np.ones(4, bool)
    left = sizes.sum()
    while True:  # reshare the excess round by round
        target = np.where(open_, left * np.array([1, 2, 3, 1]) / (np.array([1, 2, 3, 1]) * open_).sum(), sizes * 3)
        over = open_ & (target > sizes * 3)
        if not over.any():
            break
        open_ &= ~over
        left = sizes.sum() - (sizes * 3)[~open_].sum()
    assert np.allclose(found, target) and math.isclose(found.sum(), sizes.sum())


@pytest.mark.parametrize("units", [1000, 20])
def test_mixing(docs, rows, none, units):
    found = mixing.mix(docs, units=units)
    assert found.columns == [*docs.columns, "size_", "source_size", "target", "copies", "taken"]
    out = found.collect()
    assert sorted((r.doc_id, r.size_) for r in out if r.doc_id is not None) == sorted((i, len(words(t))) for i, t, _ in rows if i is not None)
    assert all(r.taken == r.copies * r.size_ <= 3 * r.size_ for r in out)
    by = collections.defaultdict(list)
    for r in out:
        by[r.source].append(r)
    names = sorted((s for s in by if s is not None), key=lambda s: s.encode()) + [None]
    sizes = np.array([sum(r.size_ for r in by[s]) for s in names], float)
    goal = mixing.shares(sizes, np.array([1.0 + k % 3 for k in range(len(names))]))
    for s, size, target in zip(names, sizes, goal):
        assert {r.source_size for r in by[s]} == {size} and all(math.isclose(r.target, target, abs_tol=1e-6) for r in by[s])
        assert abs(sum(r.taken for r in by[s]) - target) <= max(0.02 * target, max(r.size_ for r in by[s]))
    assert sorted_rows(mixing.mix(docs, units=units)) == sorted((tuple(r) for r in out), key=str)
    assert mixing.mix(none).count() == 0


def test_mixing_a_task_in_several_batches(spark):
    sized = spark.range(0, 3000, 1, 4).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"), F.pmod(F.xxhash64("id"), F.lit(400)).alias("words"))
    whole = mixing.mix(sized, size="words", units=100).collect()
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    try:
        for rows in (64, 7):
            spark.conf.set(key, rows)
            assert sorted(mixing.mix(sized, size="words", units=100).collect()) == sorted(whole)
    finally:
        spark.conf.set(key, was)
    assert sorted(r.doc_id for r in whole) == list(range(3000))
    for s in {r.source for r in whole}:
        own = [r for r in whole if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 400


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(0)
    for _ in range(300):
        p, x = rng.uniform(0.05, 0.95, 3).tolist(), rng.integers(0, 9, 3).astype(float).tolist()
        moved = mixing.move(p, x, float(rng.uniform()))
        assert any(a in (0.0, 1.0) for a in moved)
        assert math.isclose(sum(moved), sum(p), abs_tol=1e-6) and math.isclose(np.dot(moved, x), np.dot(p, x), abs_tol=1e-5)


# ---------------------------------------------------------------- 9


@pytest.mark.parametrize("frequent", [400_000, 20])
def test_language_model(docs, rows, none, monkeypatch, frequent):
    monkeypatch.setattr(language_model, "FREQUENT", frequent)
    tokens = lambda t: [*words(t), None]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    count = collections.Counter(w for i, t, _ in rows if not held(i) for w in tokens(t))
    n, below = sum(count.values()), math.log10(sum(count.values()) + 0.5 * (len(count) + 1))
    found = language_model.score(docs).collect()
    expected = sorted((str(i), held(i), len(tokens(t)), sum(count[w] > 0 for w in tokens(t)), n, round(sum(math.log10(count[w] + 0.5) - below for w in tokens(t)), 6)) for i, t, _ in rows)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found) == expected
    assert all(r.score < 0 for r in found)
    if frequent == 20:
        assert language_model.score(none).count() == 0


def test_language_model_learns_context(spark):
    rng = random.Random(9)
    vocabularies = [[f"{c}{k}" for k in range(40)] for c in "ab"]
    given = [(i, " ".join(rng.choice(vocabularies[i % 2]) for _ in range(80))) for i in range(600)]
    found = language_model.score(spark.createDataFrame(given, "doc_id long, text string")).where("held_out").collect()
    gain = sum(r.score - r.base_score for r in found) / sum(r.n_tokens for r in found)
    assert gain > 0.1  # one of two vocabularies is worth log10(2) per token


@pytest.mark.parametrize("types,own", [(1000, 448), (250_000, 500), (4_000_000, 2000)])
def test_vocabulary_follows_the_counted_types(types, own):
    keys = language_model.keys_of([b"w%d" % k for k in range(3000)])
    counts = np.arange(3000, 0, -1) ** 2
    ending = np.bincount(keys & (language_model.ENDINGS - 1), counts, language_model.ENDINGS)
    v = language_model.Vocabulary(keys, counts, np.stack([ending, np.zeros(language_model.ENDINGS)]), language_model.words_for(types))
    assert v.numbers_of(keys)[1].tolist() == [k < own for k in range(3000)]
    assert len(set(v.numbers_of(keys[:own])[0].tolist())) == own
    size = own + language_model.ENDINGS
    assert 0.7 * size**0.5 < len(language_model.initial(v.weights)["cuts"]) - 1 <= size**0.5


def test_gradients_of_the_network():
    rng = np.random.default_rng(1)
    p = language_model.initial(np.arange(40, 0, -1.0))
    docs = [np.append(rng.integers(0, 40, int(n)), 0).astype(np.int32) for n in (9, 14, 3)]
    x, y, fresh, _ = next(language_model.windows(docs, 0, 4))
    seen = {}

    class Probe(language_model.Trainer):
        def window(self, *a):
            self.p = {k: v.astype(np.float64) if v.dtype == np.float32 else v for k, v in self.p.items()}
            return super().window(*a)

    probe = Probe(p)
    h = np.zeros((x.shape[1], language_model.HIDDEN), np.float32)
    probe.window(x, y, fresh, h)
    n = int((y >= 0).sum())

    def loss(q):
        out, _ = language_model.states(q, x, fresh, h)
        given = y.ravel() >= 0
        return float(language_model.log_probabilities(q, out.reshape(-1, language_model.HIDDEN)[given], y.ravel()[given])[0].sum()) / n

    for name in probe.names:
        slope = probe.first[name] / 0.1
        at = np.unravel_index(int(np.abs(slope).argmax()), slope.shape)
        up, down = ({k: v.astype(np.float64) if v.dtype == np.float32 else v.copy() for k, v in p.items()} for _ in range(2))
        up[name][at] += 1e-2
        down[name][at] -= 1e-2
        seen[name] = (slope[at], (loss(up) - loss(down)) / 2e-2)
    assert all(math.isclose(a, b, rel_tol=0.05, abs_tol=1e-3) for a, b in seen.values()), seen


def test_probabilities_sum_to_one():
    p = language_model.initial(np.arange(50, 0, -1.0))
    h = np.random.default_rng(0).normal(size=(1, language_model.HIDDEN)).astype(np.float32)
    found, _ = language_model.log_probabilities(p, np.repeat(h, 50, axis=0), np.arange(50))
    assert math.isclose(float(np.exp(found).sum()), 1.0, rel_tol=1e-4)


def test_few_lanes_are_scored_in_long_windows(monkeypatch):
    rng = np.random.default_rng(2)
    p = language_model.initial(np.arange(90, 0, -1.0))
    docs = [rng.integers(0, 90, n).astype(np.int32) for n in (3000, 40, 17, 1)]
    seen, states = [], language_model.states
    monkeypatch.setattr(language_model, "states", lambda p, x, fresh, h: seen.append(x.shape) or states(p, x, fresh, h))
    found = language_model.log10_of(p, docs, 0)
    assert len(seen) <= 20  # 3000 steps of one lane were 188 windows
    monkeypatch.setattr(language_model, "LONGEST", language_model.WINDOW)
    monkeypatch.setattr(language_model, "FEW", 0)
    assert np.allclose(language_model.log10_of(p, docs, 0), found, rtol=1e-5)


def test_few_rows_have_the_slopes_of_many(monkeypatch):
    rng = np.random.default_rng(4)
    p = language_model.initial(np.arange(90, 0, -1.0))
    p["W"] = rng.normal(0, 0.5, p["W"].shape).astype(np.float32)
    h, y = rng.uniform(-1, 1, (20, language_model.HIDDEN)).astype(np.float32), rng.integers(0, 90, 20)
    results = []
    for few in (32, 0):
        monkeypatch.setattr(language_model, "FEW", few)
        slopes = {k: np.zeros_like(v) for k, v in p.items() if k != "cuts"}
        results.append([*language_model.log_probabilities(p, h, y, slopes), *slopes.values()])
    assert all(np.allclose(a, b, atol=1e-5) for a, b in zip(*results))


# ---------------------------------------------------------------- 10


@pytest.mark.parametrize("piece_bytes", [1 << 20, 300])
def test_decontaminate(spark, docs, rows, none, piece_bytes):
    texts = [t for _, t, _ in rows if t and len(t.split()) > 30]
    bench = [(k, " ".join(t.split()[5:19]).upper()) for k, t in enumerate(texts[:6])] + [(20, None), (21, ""), (22, "!!"), (23, "one"), (24, "One, TWO"), (25, "no such passage in any of the documents at all here"), (25, "one"), (None, "ab")]
    table = spark.createDataFrame([(i, t, "x") for i, t in bench], "item_id long, text string, n_words string")
    pattern = collections.defaultdict(set)
    for i, t in bench:
        w = decontaminate.fold(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            if i is not None:
                pattern[tuple(w[k : k + 10])].add(str(i))
    expected = []
    for i, t, _ in rows:
        w, hit, items = decontaminate.fold(t), set(), set()
        for p, owners in pattern.items():
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k : k + len(p)]) == p:
                    hit.update(range(k, k + len(p)))
                    items |= owners
        expected.append((i, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)))
    found = decontaminate.search(docs.drop("n_words", "hit_spans"), table, piece_bytes=piece_bytes)
    assert sorted_rows(decontaminate.report(found)) == sorted(expected, key=str)
    assert decontaminate.search(docs, table).columns == [*docs.columns, "n_words_", "hit_spans_", "hit_items"]
    assert decontaminate.search(none.drop("n_words", "hit_spans"), table).count() == 0
    assert decontaminate.search(docs, table.limit(0)).where("hit_items <> array()").count() == 0


def test_payloads_are_packed_for_the_shuffle(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 1000)
    bodies = [None, "", "é事" * 9, "a" * 5000, "b" * 400, "c" * 700, None]
    rows = spark.createDataFrame([(k, b) for k, b in enumerate(bodies)], "id long, body string").coalesce(1)
    small = warc.packed(rows)
    assert small.schema["body"].dataType.typeName() == "binary" and max(len(r.body or b"") for r in small.collect()) < 200
    assert [tuple(r) for r in warc.unpacked(small).orderBy("id").collect()] == list(enumerate(bodies))
