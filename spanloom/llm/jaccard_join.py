"""N-gram Jaccard join: documents linked by the similarity of their word shingles, and their components.

Equal sets are one vertex (a 64-bit hash of the set). Candidates meet by segments: a set is cut by hash into so
many segments that two sets which differ as much as the threshold allows still agree in some of them; the number
depends on the size, so a set emits its segments for its own class of sizes and for the next larger one. Shingles
that are common (by a sample) are left out of segments that hold others, so shared passages link nobody. Each
task combines equal segments before the shuffle (a segment that a third of all documents share leaves a task
once) and links their owners; what meets after the shuffle is linked too. The components of these links are
families: no similar pair lies across two of them, but passages that a few documents share chain strangers.

So families are cut before any set is sent. Each set has a parity sketch, a bit per hash range that says whether it
holds an odd number of shingles there. Every shingle that only one of two sets has flips one bit, so sketches of
similar sets differ in no more bits than the sets may differ in shingles, while those of strangers differ in many.
Sketches, a sixtieth of the sets, meet in pairs of blocks of one class of sizes or of neighbouring ones; the
components of sketches that are near enough are the families that remain.

Inside a family, signature trees find the similar pairs. A leaf holds a set's size and a bitmap of its hashed
shingles, a node the size range and the OR of its children. Two trees are descended together; a pair of nodes is
dropped when the sizes cannot match or when the bits that both have are too few for the overlap that the
smallest sizes need. Leaves that are left are compared exactly: all of them where links are counted, and where
only components are wanted all but those already linked through others. Families above ``BLOCK`` sets are cut into
blocks and joined as pairs of blocks, each a task of bounded size; no pairs leave it, only link counts per vertex
and a spanning forest of the links.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, parts_for, runs, sent, settle, spread, stored, words
from .graph import components

BLOCK = 1024
#: Sketches of a block, and words of sketches that are compared at once.
WIDE, TABLE = 4096, 1 << 20
#: Segments that a task holds before it combines and sends them.
FLUSH = 1 << 20
#: Segments of one bucket after the shuffle, about.
BUCKET = 1 << 21
#: Shingles of the sample that shows which are common, about, and in how many of its sets a common one is.
SAMPLE, COMMON = 4 << 20, 3
FAN = 8
#: Shingles of the leaves that one leaf is compared with at once, about.
SIDE = 1 << 21


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the ``size``-word shingles; of fewer words, the whole sequence as one."""
    found = words(text)
    if not found:
        return np.zeros(0, np.uint64)
    if len(found) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(found), seed=len(found))], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    n = len(h) - size + 1
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
    return np.unique(out)


def vertex(hashes: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(hashes.tobytes()) - (1 << 63)


class Sizes:
    """Classes of set sizes for a similarity of ``num / den``: similar sets lie in one class or in two neighbours."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.low, self.allowed, self.cuts = [], [], []
        low = 1
        while low < 1 << 33:
            high = low * den // num
            self.low.append(low)
            k = 2 * high * (den - num) // (den + num)
            empty = (k + 2) * math.exp(-low / (k + 2))
            self.allowed.append(k)
            # Two similar sets agree in all but k segments; so many more that hardly any set is empty in all the others.
            self.cuts.append(k + 2 + math.ceil(empty + 4 * math.sqrt(empty) - 1e-3))
            low = high + 1

    def needed(self, a, b):
        """Least overlap of two similar sets."""
        return -(-self.num * (a + b) // (self.num + self.den))

    def segments(self, hashes: np.ndarray, common: np.ndarray) -> np.ndarray:
        """Hashes of the segments of one set, in the cuts of its own class and of the next.

        Sets that agree in a segment agree in its shingles that are not ``common``, so those are hashed. Where a
        set has so many segments without any that all its agreements may lie there, these go with all shingles.
        Of more than ``allowed`` segments with some, one more than ``allowed`` are enough, those with most shingles,
        as any shared passage fills the small ones. Their order depends on what they hold alone, so of two similar sets
        the one whose last segment ranks higher agrees with the other in one that both send.
        """
        own = self.own(len(hashes))
        out = []
        mixed = mix(hashes + np.uint64(0xA0761D6478BD642F))
        rare = np.ones(len(hashes), bool)
        if len(common):
            rare = common[np.minimum(np.searchsorted(common, hashes), len(common) - 1)] != hashes
        start = np.zeros(1, np.uint64)
        some, every = np.concatenate([start, np.cumsum(np.where(rare, mixed, start))]), np.concatenate([start, np.cumsum(mixed)])
        number = np.concatenate([[0], np.cumsum(rare)])
        for c in (own, own + 1):
            k, m = self.allowed[c], self.cuts[c]
            cuts = np.append(np.searchsorted(hashes, np.arange(m, dtype=np.uint64) * np.uint64((1 << 64) // m)), len(hashes))
            salt = mix((np.uint64(2 * c + 2) << np.uint64(40)) + np.arange(m, dtype=np.uint64))
            held = number[cuts[1:]] - number[cuts[:-1]]
            full = held > 0
            sent = mix((some[cuts[1:]] - some[cuts[:-1]] + salt)[full])
            out.append(sent if len(sent) <= k + 1 else sent[np.lexsort((sent, held[full]))[-k - 1 :]])
            if m - int(full.sum()) >= m - k:
                rest = ~full
                if int((cuts[1:] == cuts[:-1]).sum()) < m - k:
                    rest &= cuts[1:] > cuts[:-1]  # not all agreements are empty
                out.append(mix((every[cuts[1:]] - every[cuts[:-1]] + mix(salt))[rest]))
        return np.concatenate(out)


    def own(self, size: int) -> int:
        """Class of a set of ``size`` shingles."""
        return bisect_right(self.low, size) - 1

    def bits(self, c: int) -> int:
        """Width of the sketches of a class: a power of two, about as many bits as shingles."""
        return 1 << min(16, max(6, self.low[c].bit_length()))


@lru_cache
def sizes_for(num: int, den: int) -> Sizes:
    return Sizes(num, den)


def meet(segments: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct segments with their smallest owners, and links of all their other owners to those."""
    order = np.lexsort((owners, segments))
    segments, owners = segments[order], owners[order]
    first = np.ones(len(segments), bool)
    first[1:] = segments[1:] != segments[:-1]
    hub = owners[first][np.cumsum(first) - 1] if len(segments) else owners
    apart = owners != hub
    links = np.unique(np.stack([owners[apart], hub[apart]], axis=1), axis=0) if apart.any() else np.zeros((0, 2), np.int64)
    return segments[first], owners[first], links


def _segments(text: str, size: int, num: int, den: int, buckets: int, common):
    schema = pa.schema([("bucket", pa.int64()), ("linked", pa.bool_()), ("payload", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        sizes, often = sizes_for(num, den), common.value
        held: list[np.ndarray] = []
        owner: list[tuple[int, int]] = []
        total = sent = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, owner, total, sent
            if not total:
                return
            segments, owners, links = meet(np.concatenate(held), np.repeat(*np.array(owner, np.int64).T))
            rows = []
            if len(links):
                sent += 1
                rows.append(((int(links[0, 0]) + sent) % buckets, True, links.tobytes()))
            to = (segments >> np.uint64(8)) % np.uint64(buckets)
            order = np.argsort(to, kind="stable")
            cuts = np.searchsorted(to[order], np.arange(buckets + 1, dtype=np.uint64))
            for k in np.flatnonzero(np.diff(cuts)).tolist():
                part = order[cuts[k] : cuts[k + 1]]
                rows.append((k, False, segments[part].tobytes() + owners[part].tobytes()))
            held, owner, total = [], [], 0
            for k in range(0, len(rows), 64):
                yield pa.RecordBatch.from_pydict({n: [r[i] for r in rows[k : k + 64]] for i, n in enumerate(schema.names)}, schema=schema)

        for batch in batches:
            for body in batch.column(text).to_pylist():
                hashes = shingles(body, size)
                if len(hashes):
                    held.append(sizes.segments(hashes, often))
                    owner.append((vertex(hashes), len(held[-1])))
                    total += len(held[-1])
                    if total >= FLUSH:
                        yield from flush()
        yield from flush()
        settle()

    return work


def _meetings(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    settle()

    def work(group: pd.DataFrame) -> Iterator[pd.DataFrame]:
        given = [np.frombuffer(p, np.int64).reshape(-1, 2) for p, linked in zip(group["payload"], group["linked"]) if linked]
        rest = [np.frombuffer(p, np.int64).reshape(2, -1) for p, linked in zip(group["payload"], group["linked"]) if not linked]
        if rest:
            given.append(meet(np.concatenate([r[0] for r in rest]).view(np.uint64), np.concatenate([r[1] for r in rest]))[2])
        links = np.concatenate(given)
        yield pd.DataFrame({"a": links[:, 0], "b": links[:, 1]})

    yield from runs(frames, ["bucket"], work)


def _common(source: DataFrame, total: int, size: int) -> np.ndarray:
    """Shingles that at least ``COMMON`` sets of a sample of about ``SAMPLE`` shingles have, sorted.

    Only the number of candidates depends on them, never the result.
    """
    share = int(min(1.0, SAMPLE / max(1, total)) * (1 << 30))
    drawn = source.where(F.pmod(F.xxhash64(F.lit("common"), F.col("body")), F.lit(1 << 30)) < share).select("body").distinct()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [h for h in (shingles(t, size) for t in batch.column("body").to_pylist()) if len(h)]
            yield pa.RecordBatch.from_pydict({"vertex": pa.array([vertex(h) for h in sets], pa.int64()), "hashes": pa.array([h.tobytes() for h in sets], pa.binary())})

    def often(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = {v: h for frame in frames for v, h in zip(frame["vertex"], frame["hashes"])}
        found, count = np.unique(np.frombuffer(b"".join(rows.values()), np.uint64), return_counts=True)
        yield pd.DataFrame({"hashes": [found[count >= COMMON].tobytes()]})

    sets = drawn.mapInArrow(gather, "vertex long, hashes binary").repartition(1)
    rows = sets.mapInPandas(often, "hashes binary").collect()
    return np.sort(np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(bytes(r["hashes"]), np.uint64) for r in rows)]))


class Tree:
    """Signature tree over sets that are ordered by size; level 0 holds the leaves."""

    def __init__(self, sets: list[np.ndarray], bits: int):
        sizes = np.array([len(s) for s in sets], np.int64)
        maps = np.zeros((len(sets), bits // 64), np.uint64)
        for i, s in enumerate(sets):
            at = (s >> np.uint64(20)) % np.uint64(bits)
            np.bitwise_or.at(maps[i], (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        # More shingles than bits: so many may hide behind bits that are counted once.
        hidden = sizes - np.bitwise_count(maps).sum(axis=1).astype(np.int64)
        self.levels = [(maps, sizes, sizes, hidden)]
        while len(maps) > 1:
            cuts = np.arange(0, len(maps), FAN)
            low, high, hidden = np.minimum.reduceat(self.levels[-1][1], cuts), np.maximum.reduceat(self.levels[-1][2], cuts), np.maximum.reduceat(hidden, cuts)
            maps = np.bitwise_or.reduceat(maps, cuts, axis=0)
            self.levels.append((maps, low, high, hidden))


def possible(a: Tree, b: Tree, level: int, x: np.ndarray, y: np.ndarray, sizes: Sizes) -> np.ndarray:
    """Which node pairs may hold a similar pair: by size ranges, then by the greatest overlap that their bits allow."""
    maps_a, low_a, high_a, hidden_a = a.levels[level]
    maps_b, low_b, high_b, hidden_b = b.levels[level]
    ok = (high_a[x] * sizes.den >= low_b[y] * sizes.num) & (high_b[y] * sizes.den >= low_a[x] * sizes.num)
    live = np.flatnonzero(ok)
    step = max(1, (1 << 22) // maps_a.shape[1])
    for k in range(0, len(live), step):
        rows = live[k : k + step]
        u, v = x[rows], y[rows]
        shared = np.bitwise_count(maps_a[u] & maps_b[v]).sum(axis=1, dtype=np.int64) + np.minimum(hidden_a[u], hidden_b[v])
        ok[rows] = shared >= sizes.needed(low_a[u], low_b[v])
    return ok


def similar(a: np.ndarray, b: np.ndarray, sizes: Sizes) -> bool:
    overlap = len(np.intersect1d(a, b, assume_unique=True))
    return sizes.den * overlap >= sizes.num * (len(a) + len(b) - overlap)


class Descent:
    """Node pairs of two trees (or of one with itself) that may hold similar pairs, down to the parents of leaves.

    Sets of ``right`` are numbered on from those of ``left``.
    """

    def __init__(self, left: list[np.ndarray], right: list[np.ndarray] | None, sizes: Sizes):
        self.sets = sets = left + (right or [])
        mean = sum(map(len, sets)) / len(sets)
        bits = 64
        while bits < 64 * mean and bits < 1 << 16:
            bits *= 2
        by_size = lambda part: sorted(range(len(part)), key=lambda i: (len(part[i]), part[i][0]))
        self.order_a = np.array(by_size(left))
        self.a = Tree([left[i] for i in self.order_a], bits)
        self.order_b, self.b = self.order_a, self.a
        if right is not None:
            self.order_b = np.array(by_size(right)) + len(left)
            self.b = Tree([sets[i] for i in self.order_b], bits)
        self.own = right is None
        depth = max(len(self.a.levels), len(self.b.levels))
        for t in (self.a, self.b):
            t.levels += [t.levels[-1]] * (depth - len(t.levels))
        self.leaves = depth == 1  # no level above the leaves
        self.x, self.y = np.zeros(1, np.int64), np.zeros(1, np.int64)
        if self.leaves:
            if self.own:
                self.x, self.y = self.x[:0], self.y[:0]
            return
        for level in range(depth - 2, 0, -1):
            x, y = self.expand(level, self.x, self.y)
            keep = possible(self.a, self.b, level, x, y, sizes)
            self.x, self.y = x[keep], y[keep]

    @staticmethod
    def children(tree: Tree, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First child of each node and the number of its children."""
        count = len(tree.levels[level][1])
        if count == len(tree.levels[level + 1][1]):  # a short tree waits at its root
            return nodes, np.ones(len(nodes), np.int64)
        return nodes * FAN, np.minimum(FAN, count - nodes * FAN)

    def expand(self, level: int, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        (x0, nx), (y0, ny) = self.children(self.a, level, x), self.children(self.b, level, y)
        total = nx * ny
        at = np.arange(total.sum()) - np.repeat(np.cumsum(total) - total, total)
        wide = np.repeat(ny, total)
        u, v = np.repeat(x0, total) + at // wide, np.repeat(y0, total) + at % wide
        if self.own:
            keep = u < v if level == 0 else u <= v
            u, v = u[keep], v[keep]
        return u, v


def tree_links(left: list[np.ndarray], right: list[np.ndarray] | None, sizes: Sizes) -> list[tuple[int, int]]:
    """Links that connect whatever the similar pairs connect: inside ``left``, or between ``left`` and ``right``.

    Numbers of ``right`` continue those of ``left``.
    """
    d = Descent(left, right, sizes)
    sets, order_a, order_b = d.sets, d.order_a, d.order_b
    label = np.arange(len(sets))
    out: list[tuple[int, int]] = []
    leaves = [(d.x, d.y)] if d.leaves else (d.expand(0, d.x[k : k + 64], d.y[k : k + 64]) for k in range(0, len(d.x), 64))
    for u, v in leaves:
        apart = label[order_a[u]] != label[order_b[v]]
        u, v = u[apart], v[apart]
        keep = possible(d.a, d.b, 0, u, v, sizes)
        for i, j in zip(order_a[u[keep]].tolist(), order_b[v[keep]].tolist()):
            if label[i] != label[j] and similar(sets[i], sets[j], sizes):
                label[label == label[j]] = label[i]
                out.append((i, j))
    return out


def tree_pairs(left: list[np.ndarray], right: list[np.ndarray] | None, sizes: Sizes) -> Iterator[tuple[int, np.ndarray]]:
    """All similar pairs, each once: a set and the numbers of those that it is similar to. Numbers as in ``tree_links``.

    The leaves below a node are compared with all leaves that the descent left to it: of each, the shingles that the
    one leaf has are counted.
    """
    d = Descent(left, right, sizes)
    lengths = np.array([len(s) for s in d.sets], np.int64)
    numbers = np.unique(np.concatenate(d.sets), return_inverse=True)[1].astype(np.int32)
    parts = np.split(numbers, np.cumsum(lengths)[:-1])
    has = np.zeros(int(numbers.max()) + 1, np.uint8)
    order = np.argsort(d.x, kind="stable")
    x, y = d.x[order], d.y[order]
    for node in np.unique(x).tolist():
        others = np.sort(y[np.searchsorted(x, node) : np.searchsorted(x, node, side="right")])
        if d.leaves:
            mine, theirs = np.array([node]), others
        else:
            (first,), (count,) = d.children(d.a, 0, np.array([node]))
            mine = np.arange(first, first + count)
            begins, counts = d.children(d.b, 0, others)
            theirs = np.repeat(begins - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        ends = np.cumsum(lengths[d.order_b[theirs]])
        cuts = np.unique(np.searchsorted(ends, np.arange(0, int(ends[-1]), SIDE), side="left"))
        for p, q in zip(cuts, [*cuts[1:], len(theirs)]):
            v = theirs[p:q]
            b = d.order_b[v]
            held = np.concatenate([parts[k] for k in b])
            starts = np.cumsum(lengths[b]) - lengths[b]
            for u in mine.tolist():
                i = int(d.order_a[u])
                has[parts[i]] = 1
                overlap = np.add.reduceat(has[held], starts, dtype=np.int64)
                has[parts[i]] = 0
                near = sizes.den * overlap >= sizes.num * (lengths[i] + lengths[b] - overlap)
                if d.own:
                    near &= v > u
                if near.any():
                    yield i, b[near]


def tree_counts(left: list[np.ndarray], right: list[np.ndarray] | None, sizes: Sizes, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per set, the weights of all sets that it is similar to, and the smallest number that links connect it with."""
    count, root = np.zeros(len(weight), np.int64), np.arange(len(weight))
    for i, near in tree_pairs(left, right, sizes):
        count[i] += weight[near].sum()
        count[near] += weight[i]
        met = np.unique(np.append(root[near], root[i]))
        if len(met) > 1:
            root[np.isin(root, met)] = met[0]
    return count, root


def parity(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Bit by bit whether a set holds an odd number of the hashes that are equal modulo ``bits``, in 64-bit words."""
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def folded(sketches: np.ndarray, width: int) -> np.ndarray:
    """The sketches (a row each) that ``width`` words would have given."""
    while sketches.shape[1] > width:
        half = sketches.shape[1] // 2
        sketches = sketches[:, :half] ^ sketches[:, half:]
    return sketches


def near_links(left: np.ndarray, a: np.ndarray, right: np.ndarray | None, b: np.ndarray, sizes: Sizes) -> list[tuple[int, int]]:
    """Links that connect whatever sketches near enough connect, inside ``left`` or between it and ``right``.

    ``a`` and ``b`` are the sizes of the sets; numbers of ``right`` continue those of ``left``.
    """
    shift = 0 if right is None else len(left)
    right, b = (left, a) if right is None else (right, b)
    label = np.arange(len(left) + (len(right) if shift else 0))
    theirs = np.arange(len(right)) + shift
    out: list[tuple[int, int]] = []
    step = max(1, TABLE // max(1, right.size))
    for k in range(0, len(left), step):
        x, n = left[k : k + step], a[k : k + step, None]
        fits = (sizes.den * n >= sizes.num * b) & (sizes.den * b >= sizes.num * n)
        fits &= np.bitwise_count(x[:, None, :] ^ right).sum(axis=2, dtype=np.int64) <= n + b - 2 * sizes.needed(n, b)
        for i in np.flatnonzero(fits.any(axis=1)).tolist():
            near = theirs[fits[i]]
            met, first = np.unique(label[near], return_index=True)
            apart = met != label[k + i]
            if apart.any():
                out += [(k + i, int(j)) for j in near[first[apart]]]
                label[np.isin(label, met[apart])] = label[k + i]
    return out


def _near(num: int, den: int):
    def work(group: pd.DataFrame) -> Iterator[pd.DataFrame]:
        sizes = sizes_for(num, den)
        vertices, lengths = group["vertex"].to_numpy(), group["n_shingles"].to_numpy()
        kind, own = group["class"].to_numpy(), group["own"].to_numpy()
        low, i, j = (int(group[n].iloc[0]) for n in ("low", "i", "j"))
        mine = (kind == low) & (own == i)
        if mine.all() and (group["step"].iloc[0] or i != j) or not mine.any():
            return
        sides = [np.flatnonzero(mine)] + ([np.flatnonzero(~mine)] if not mine.all() else [])
        tables = [np.stack([np.frombuffer(s, np.uint64) for s in group["sketch"].iloc[at]]) for at in sides]
        width = min(t.shape[1] for t in tables)
        tables = [folded(t, width) for t in tables]
        ids = vertices[np.concatenate(sides)]
        links = near_links(tables[0], lengths[sides[0]], tables[1] if len(sides) > 1 else None, lengths[sides[-1]], sizes)
        yield pd.DataFrame({"a": [ids[x] for x, _ in links], "b": [ids[y] for _, y in links]}, dtype="int64")

    def near(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        settle()
        yield from runs(frames, ["family", "low", "step", "i", "j"], work)

    return near


def _cut(members: DataFrame, family: DataFrame, num: int, den: int) -> DataFrame:
    """``(vertex, family)`` of families cut by sketches; similar sets stay together, and sets with no near sketch go."""
    found = members.where("vertex IS NOT NULL").join(family, "vertex").dropDuplicates(["vertex"])
    found = stored(found.select("vertex", "family", "n_shingles", "class", "sketch"), "sketches")
    counts = found.groupBy("family", "class").agg(F.count(F.lit(1)).alias("n"))
    # A family has a few dozen classes of sizes at most.
    counts = counts.groupBy("family").agg(F.map_from_entries(F.collect_list(F.struct("class", "n"))).alias("rows"))

    def blocks(kind: str) -> str:
        return f"cast(ceil(try_element_at(rows, {kind}) / {WIDE}) AS int)"

    def across(kind: str, low: str, step: int, i: str, j: str) -> str:
        pair = f"struct({low} AS low, {step} AS step, {i} AS i, {j} AS j)"
        return f"if({blocks(kind)} IS NULL, array(), transform(sequence(0, coalesce({blocks(kind)}, 1) - 1), w -> {pair}))"

    pairs = f"""concat({across('class', 'class', 0, 'least(own, w)', 'greatest(own, w)')},
        {across('class + 1', 'class', 1, 'own', 'w')}, {across('class - 1', 'class - 1', 1, 'w', 'own')})"""
    dealt = found.join(counts, "family").withColumn("own", F.expr(f"cast(pmod(xxhash64(vertex), {blocks('class')}) AS int)"))
    dealt = dealt.withColumn("pair", F.explode(F.expr(pairs))).where("pair.step = 1 OR rows[class] > 1")
    keys = ["family", "low", "step", "i", "j"]
    dealt = dealt.select("vertex", "n_shingles", "class", "own", "sketch", "family", "pair.low", "pair.step", "pair.i", "pair.j")
    links = dealt.repartition(spread(members.sparkSession), *keys).sortWithinPartitions(*keys).mapInPandas(_near(num, den), "a long, b long")
    return components(links).select(F.col("id").alias("vertex"), F.col("component").alias("family"))


def _families(num: int, den: int, counted: bool):
    def work(group: pd.DataFrame) -> Iterator[pd.DataFrame]:
        sizes = sizes_for(num, den)
        ids = group["id"].to_numpy()
        first, keep = np.unique(ids, return_index=True)
        group = group.iloc[keep]
        sets = [np.frombuffer(s, np.uint64) for s in group["hashes"]]
        if group["i"].iloc[0] == group["j"].iloc[0]:
            order, left, right = np.arange(len(sets)), sets, None
            if len(sets) < 2:
                return
        else:
            mine = group["own"].to_numpy() == group["i"].to_numpy()
            order = np.concatenate([np.flatnonzero(mine), np.flatnonzero(~mine)])
            left, right = [sets[k] for k in np.flatnonzero(mine)], [sets[k] for k in np.flatnonzero(~mine)]
            if not left or not right:
                return
        ids = first[order]
        if counted:
            count, root = tree_counts(left, right, sizes, group["weight"].to_numpy()[order])
            linked = np.flatnonzero(count)
            yield pd.DataFrame({"vertex": ids[linked], "links": count[linked], "root": ids[root[linked]]})
        else:
            links = tree_links(left, right, sizes)
            yield pd.DataFrame({"a": [ids[i] for i, _ in links], "b": [ids[j] for _, j in links]}, dtype="int64")

    return lambda frames: runs(frames, ["family", "i", "j"], work)


def join(docs: DataFrame, size: int = 3, num: int = 90, den: int = 100, text: str = "text", doc_id: str = "doc_id", counted: bool = False) -> tuple[DataFrame, DataFrame]:
    """Membership and links of the join: ``num * union <= den * overlap`` over sets of ``size``-word shingles.

    Returns ``(doc_id, n_shingles, vertex)`` with one row per row of ``docs``, and ``(a, b)``: similar pairs of
    vertices, as many as connect what all similar pairs connect. With ``counted``, all similar pairs are found, and the
    second is ``(vertex, links, root)``: parts of the number of rows with another set that a vertex is similar to, which
    add up to it, and a vertex that it is connected with.

    * null, empty and wordless texts have no shingles, no vertex and no links.
    * fewer words than ``size`` are one shingle, linked with equal sequences only.
    * equal texts and repeated rows share a vertex; an empty table gives two empty results.
    * only ``doc_id`` and ``text`` are read, whatever the other columns are called.
    """
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("body"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        sizes = sizes_for(num, den)
        for batch in batches:
            rows = []
            for text in batch.column("body").to_pylist():
                found = shingles(text, size)
                c = sizes.own(len(found))
                rows.append((len(found), vertex(found), c, parity(found, sizes.bits(c)).tobytes()) if len(found) else (0, None, None, None))
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "n_shingles", "vertex", "class", "sketch"])

    members = stored(source.mapInArrow(describe, "doc_id long, n_shingles long, vertex long, class int, sketch binary"), "members")
    total = members.agg(F.sum("n_shingles")).first()[0] or 0
    spark = docs.sparkSession
    share = 5.2 * (den - num) / (den + num)  # segments per shingle, about
    buckets = max(spread(spark), parts_for(int(total * share), BUCKET))
    common = spark.sparkContext.broadcast(_common(source, int(total), size))
    segments = source.select("body").mapInArrow(_segments("body", size, num, den, buckets, common), "bucket long, linked boolean, payload binary")
    met = segments.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInPandas(_meetings, "a long, b long")
    family = components(met).select(F.col("id").alias("vertex"), F.col("component").alias("family"))
    family = _cut(members, family, num, den)
    counts = family.groupBy("family").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    # One document stands for each vertex; its shingles are made again from its text.
    stands = members.where("vertex IS NOT NULL").groupBy("vertex").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("weight"))
    wanted = stored(family.join(counts, "family").join(stands, "vertex").select("doc_id", "vertex", "weight", "family", "blocks"), "families")

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                piece = batch.slice(k, 500)
                found = [shingles(t, size) for t in piece.column("body").to_pylist()]
                keep = pa.array([len(h) > 0 and vertex(h) == v for h, v in zip(found, piece.column("vertex").to_pylist())])
                columns = [piece.column(n).filter(keep) for n in ("vertex", "weight", "family", "blocks")]
                hashes = pa.array([h.tobytes() for h, ok in zip(found, keep.to_pylist()) if ok], pa.binary())
                yield pa.RecordBatch.from_arrays([*columns, hashes], names=["id", "weight", "family", "blocks", "hashes"])

    sets = source.join(sent(wanted, 72), source["doc_id"].eqNullSafe(wanted["doc_id"])).select("body", "vertex", "weight", "family", "blocks")
    sets = sets.mapInArrow(rebuild, "id long, weight long, family long, blocks long, hashes binary")
    sets = sets.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")))
    other = sets.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    other = other.select("id", "weight", "family", "hashes", "own", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"))
    keys = ["family", "i", "j"]
    schema = "vertex long, links long, root long" if counted else "a long, b long"
    links = other.repartition(spread(spark), *keys).sortWithinPartitions(*keys).mapInPandas(_families(num, den, counted), schema)
    return members.drop("class", "sketch"), links


def classes(docs: DataFrame, size: int = 3, num: int = 90, den: int = 100, text: str = "text", doc_id: str = "doc_id", counted: bool = False) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id``: the smallest doc_id reachable by links, itself included.

    With ``counted`` also ``n_links``, the number of other rows that a row is similar to, equal texts among them.
    """
    found = _classes(docs, size, num, den, text, doc_id, counted)
    return found.select("doc_id", "n_shingles", "component_id", *(["n_links"] if counted else []))


def _classes(docs: DataFrame, size: int, num: int, den: int, text: str, doc_id: str, counted: bool = False) -> DataFrame:
    """``classes`` with the ``vertex`` of each row and the ``component`` of the vertex."""
    members, links = join(docs, size, num, den, text, doc_id, counted)
    stands = members.where("vertex IS NOT NULL").groupBy("vertex").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("weight"))
    more = ["n_links"] if counted else []
    if counted:
        links = stored(links, "links")
        counts = links.groupBy("vertex").agg(F.sum("links").alias("links"))
        stands = stands.join(counts, "vertex", "left").withColumn("n_links", F.coalesce("links", F.lit(0).cast("long")) + F.col("weight") - 1)
        links = links.select(F.col("vertex").alias("a"), F.col("root").alias("b"))
    found = components(links).select(F.col("id").alias("vertex"), "component")
    named = stands.join(found, "vertex", "left").withColumn("component", F.coalesce("component", "vertex"))
    smallest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    named = stored(named.join(smallest, "component").select("vertex", "component", "component_id", *more), "named")
    alone = members.where("vertex IS NULL").withColumns({"component": F.lit(None).cast("long"), "component_id": F.col("doc_id"), "n_links": F.lit(0).cast("long")})
    columns = ["doc_id", "n_shingles", "vertex", "component", "component_id", *more]
    return members.where("vertex IS NOT NULL").join(named, "vertex").select(*columns).unionByName(alone.select(*columns))


def keep_one(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with one document of each component: that with the smallest id (of repeated rows, one of them).

    Documents without words are linked with nothing and stay, as do rows without id. An id on rows with different
    texts goes by row: each stays or goes with the component of its own text.
    """
    found = _classes(docs, size, num, den, text, doc_id)
    left = stored(found.where("doc_id <> component_id").select(F.col("doc_id").alias("gone")).distinct(), "gone")
    again = found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("twice"))
    again = stored(again, "twice")
    if not again.head(1):
        return docs.join(sent(left, 32), docs[doc_id] == left["gone"], "left_anti")
    whole = docs.join(again, docs[doc_id] == again["twice"], "left_anti")
    whole = whole.join(sent(left, 32), whole[doc_id] == left["gone"], "left_anti")
    # Ids on several rows: of each component that such an id stands for, one vertex stays, with one row.
    stays = found.where("doc_id = component_id AND vertex IS NOT NULL").join(again, F.col("doc_id") == again["twice"], "left_semi")
    stays = stored(stays.groupBy("component").agg(F.min("doc_id").alias("stays"), F.min("vertex").alias("as")).select("stays", "as"), "stays")

    @F.pandas_udf("long")
    def vertices(texts: pd.Series) -> pd.Series:
        return pd.Series([vertex(h) if len(h) else None for h in (shingles(t, size) for t in texts)], dtype="Int64")

    of, mark = free_name("vertex", docs.columns), free_name("row_number", docs.columns)
    some = docs.join(again, docs[doc_id] == again["twice"], "left_semi").withColumn(of, vertices(F.col(text).cast("string")))
    ordered = some.where(F.col(of).isNotNull()).withColumn(mark, F.row_number().over(_by(doc_id, of, text)))
    first = ordered.where(F.col(mark) == 1)
    first = first.join(stays, (first[doc_id] == stays["stays"]) & (first[of] == stays["as"]), "left_semi")
    wordless = some.where(F.col(of).isNull())
    return whole.unionByName(first.drop(of, mark)).unionByName(wordless.drop(of))


def _by(doc_id: str, of: str, text: str):
    from pyspark.sql.window import Window

    return Window.partitionBy(doc_id, of).orderBy(F.xxhash64(text))


def report(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_shingles", "component_id", "n_links")
