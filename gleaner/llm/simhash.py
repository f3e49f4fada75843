"""SimHash near-duplicates: fingerprints, exact pairs by vantage-point trees,
and connected components.

All work after the fingerprints is on distinct fingerprints, so copies cost
nothing. A vantage-point tree partitions them by their Hamming distance to
vantage points: those within a cut go to the near side, the others to the far
side, and those at the boundary, within ``radius`` inside the cut, to both. By
the triangle inequality no linked pair is parted, as a partner on the far side
is at most ``radius`` further from the vantage point; all other branches are
pruned. The upper levels of the tree, built on samples, deal the fingerprints
to shards that overlap at their boundaries; inside a shard the tree goes on
down to leaves, which are compared directly.

Distances to a vantage point lie near 32 of 64 bits with a deviation of 4, so a
level copies about a quarter of the fingerprints for a radius of 2, and halves the
rest: shards of 1/64 take nine levels, and 235,850 fingerprints of the check data
became 1,750,431 rows.

Fingerprints of texts that share four fifths of their shingles differ in some 4
to 14 bits, where no tree can prune. ``keep_first`` with a ``similarity`` thus
adds links between texts that share a shingle of their prefixes, which similar ones
do without exception, confirmed on the whole shingle sets.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import cut, made, remove, small_batches, tidy

BITS, SEED = 64, 42
SHINGLE, RADIUS = 3, 2
#: Fingerprints of a shard: a 64th of all, within these bounds (8 bytes each).
SHARD, MOST_SHARD = 2048, 1 << 20
#: Fingerprints of a leaf; levels of the tree that one round of dealing takes, and
#: sampled fingerprints for each shard to be that its vantage points and cuts come from.
LEAF, LEVELS, SAMPLE = 64, 10, 32
#: What is left of a shard on one side of a balanced cut, about.
SHRINK = 0.6
#: Least words of parity bits of a text; texts that share a shingle and are compared at once
#: without more ado; texts that one of many is compared with, by their common shingles;
#: texts of a task that compares the others.
WORDS, FEW, HEADS, MOST_TEXTS = 16, 32, 8, 1024
#: Texts of the sample that tells frequent shingles, and such shingles that tasks are told.
TEXTS_SAMPLED, MOST_FREQUENT = 10_000, 100_000
#: Names of rows to fetch or keep that go to every task at most.
MOST_BROADCAST = 1_000_000
#: Shingles that are looked up at once in those of another text.
SKETCH = 1 << 15
#: What rounding may add to a bound, which then lets a pair more through.
SLACK = 1e-6
_UPPER = bytes(range(0x41, 0x5B))
_TABLE = bytes.maketrans(_UPPER, _UPPER.lower())


def shingle_hashes(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of the word shingles, repeats included; fewer words are one shingle."""
    from xxhash import xxh64_intdigest

    words = text.translate(_TABLE).split()
    n = len(words)
    if not n:
        return np.zeros(0, "<u8")
    line = b" ".join(words)
    if n <= shingle:
        return np.array([xxh64_intdigest(line, SEED)], "<u8")
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    spans = zip(starts[: n - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)
    return np.array([xxh64_intdigest(line[a:b], SEED) for a, b in spans], "<u8")


def majority(h: np.ndarray) -> int:
    """The bits set in over half of the hashes; 0 for none."""
    if len(h) < 2:
        return int(h[0]) if len(h) else 0
    counts = np.zeros(BITS, np.int64)
    for k in range(0, len(h), 1 << 16):  # bounds the unpacked bits of long texts
        part = np.unpackbits(h[k : k + (1 << 16)].view(np.uint8), bitorder="little").reshape(-1, BITS)
        counts += part.sum(0, dtype=np.uint32)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Majority bits of the XXH64 of the word shingles, repeats included."""
    return majority(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of each row: fp as signed long. Null texts have no words and
    the fingerprint 0; texts of fewer words are one shingle as a whole."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").cast(pa.binary()).to_pylist()
            fp = np.array([fingerprint(t or b"", shingle) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp)], names=["doc_id", "fp"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(tidy(run), "doc_id long, fp long")


def best_cut(d: np.ndarray, radius: int) -> tuple[int, float]:
    """The cut of distances ``d`` whose larger side is smallest, and that side's share."""
    upto = np.concatenate([np.zeros(radius + 1, np.int64), np.cumsum(np.bincount(d, minlength=BITS + 1))])
    near, far = upto[radius + 1 :], len(d) - upto[1 : BITS + 2]  # d <= cut, d > cut - radius
    larger = np.maximum(near, far)
    cut_at = int(larger.argmin())
    return cut_at, larger[cut_at] / max(1, len(d))


class VantageTree:
    """Upper levels of a tree: vantage points and cuts in heap order; a cut of -1
    ends a branch. Any points and cuts are right; a sample only balances them."""

    def __init__(self, vantages: np.ndarray, cuts: np.ndarray):
        self.vantages, self.cuts = vantages, cuts

    @classmethod
    def build(cls, sample: np.ndarray, levels: int, radius: int) -> VantageTree:
        size = (1 << levels) - 1
        vantages, cuts = np.zeros(size, np.uint64), np.full(size, -1, np.int64)
        held = {0: sample}
        for k in range(size):
            own = held.pop(k, None)
            if own is None or len(own) < 4:
                continue
            d = np.bitwise_count(own ^ own[0])
            c, share = best_cut(d, radius)
            if share > 0.95:
                continue
            vantages[k], cuts[k] = own[0], c
            held[2 * k + 1], held[2 * k + 2] = own[d <= c], own[d > c - radius]
        return cls(vantages, cuts)

    def deal(self, points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of the point, branch that it ends in); points at a boundary more than once."""
        at, branch = [], []
        stack = [(0, np.arange(len(points)))]
        while stack:
            k, own = stack.pop()
            if not len(own):
                continue
            if k >= len(self.cuts) or self.cuts[k] < 0:
                at.append(own)
                branch.append(np.full(len(own), k, np.int64))
                continue
            d = np.bitwise_count(points[own] ^ self.vantages[k]).astype(np.int64)
            stack += [(2 * k + 1, own[d <= self.cuts[k]]), (2 * k + 2, own[d > self.cuts[k] - radius])]
        return (np.concatenate(at), np.concatenate(branch)) if at else (np.zeros(0, np.int64), np.zeros(0, np.int64))


class Search:
    """All pairs of a shard within ``radius``. Counts the nodes that it splits, the
    branches of points that the triangle bound prunes, and the pairs compared."""

    def __init__(self, points: np.ndarray, radius: int, leaf: int = LEAF):
        self.points, self.radius, self.leaf = points, radius, leaf
        self.nodes = self.pruned = self.compared = 0

    def _compare(self, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        own, step = self.points[at], max(1, (1 << 22) // len(at))
        self.compared += len(at) * (len(at) - 1) // 2
        for k in range(0, len(at), step):
            d = np.bitwise_count(own[k : k + step, None] ^ own[None, k + 1 :])
            a, b = np.nonzero(d <= self.radius)
            later = b >= a  # column b is point k + 1 + b
            if later.any():
                yield at[k + a[later]], at[k + 1 + b[later]]

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(i, j) of different points; a pair at a boundary may come twice."""
        stack = [np.arange(len(self.points))]
        while stack:
            at = stack.pop()
            if len(at) < 2:
                continue
            if len(at) > self.leaf:
                d = np.bitwise_count(self.points[at] ^ self.points[at[0]])
                c, share = best_cut(d, self.radius)
                if share <= 0.95:  # else points too close to each other for a bound
                    near, far = at[d <= c], at[d.astype(np.int64) > c - self.radius]
                    self.nodes += 1
                    self.pruned += 2 * len(at) - len(near) - len(far)
                    stack += [near, far]
                    continue
            yield from self._compare(at)

    def forest(self) -> np.ndarray:
        """For each point the least index that it reaches by links within the shard."""
        root = np.arange(len(self.points))
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def join() -> None:
            if not held:
                return
            a, b = np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held])
            held.clear()
            while True:
                ra, rb = root[a], root[b]
                if (ra == rb).all():
                    return
                low = np.minimum(ra, rb)
                np.minimum.at(root, ra, low)
                np.minimum.at(root, rb, low)
                while (root[root] != root).any():
                    root[:] = root[root]

        n = 0
        for pair in self.pairs():
            held.append(pair)
            n += len(pair[0])
            if n > 1 << 21:
                join()
                n = 0
        join()
        return root


def _groups(batches: Iterator[pa.RecordBatch], key: str, value: str) -> Iterator[tuple[int, pa.Array]]:
    """Runs of equal keys over batches that are sorted by the key."""
    last, held = None, []
    for b in batches:
        keys = b.column(key).to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
        for a, z in zip(edges, edges[1:], strict=False):
            if z == a:
                continue
            if held and keys[a] != last:
                yield last, pa.concat_arrays(held)
                held = []
            last = keys[a]
            held.append(b.column(value).slice(a, z - a))
    if held:
        yield last, pa.concat_arrays(held)


def _searcher(radius: int, report: bool):
    """Links of each shard as a spanning forest, or what the search took."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, fps in _groups(batches, "shard", "fp"):
            points = np.sort(fps.to_numpy(zero_copy_only=False).view(np.uint64))
            search = Search(points, radius)
            root = search.forest()
            moved = np.flatnonzero(root != np.arange(len(points)))
            if report:
                rows = [[int(shard)], [len(points)], [search.nodes], [search.pruned], [search.compared], [len(moved)]]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in rows], names=_REPORT)
            elif len(moved):
                yield pa.RecordBatch.from_arrays([pa.array(points[root[moved]].view(np.int64)), pa.array(points[moved].view(np.int64))], names=["a", "b"])

    return run


_REPORT = ["shard", "points", "nodes", "pruned", "compared", "links"]


def _levels(n: int, shard: int) -> int:
    return max(1, min(LEVELS, math.ceil(math.log(max(1.0, n / shard)) / -math.log(SHRINK))))


def deal(fps: DataFrame, radius: int = RADIUS, shard: int | None = None) -> DataFrame:
    """(shard, fp): each distinct ``fps.fp`` in every shard that a linked one may be in.

    Each round samples the shards that are still too large, SAMPLE fingerprints for
    every shard to be, builds upper levels of a vantage-point tree for each on an
    executor, and deals their fingerprints by these. Only vantage points and cuts
    reach the driver. Points too close to each other for a tree stay one shard.
    """
    spark = fps.sparkSession
    small_batches(spark)
    n = fps.count()
    shard = shard or min(MOST_SHARD, max(SHARD, n // 64))
    rows, large, done = fps.select(F.lit(0).cast("long").alias("shard"), "fp"), {0: n} if n > shard else {}, []
    while large:
        share = spark.createDataFrame([(k, SAMPLE * 2 ** _levels(m, shard) / m, _levels(m, shard)) for k, m in large.items()], "shard long, share double, levels int")
        seed = F.pmod(F.xxhash64("fp", "shard"), F.lit(1 << 30)) / float(1 << 30)
        sample = rows.join(F.broadcast(share), "shard").where(seed < F.col("share")).groupBy("shard", "levels").agg(F.sort_array(F.collect_list("fp")).alias("fps"))
        trees = {r["shard"]: (np.array(r["vantages"], np.int64).view(np.uint64), np.array(r["cuts"], np.int64)) for r in sample.mapInArrow(tidy(_builder(radius)), "shard long, vantages array<long>, cuts array<long>").collect()}
        shared = spark.sparkContext.broadcast(trees)  # at most 2 ** LEVELS nodes for each large shard
        dealt = cut(rows.mapInArrow(tidy(_dealer(shared, radius)), "parent long, shard long, fp long"), "simhash-shards")
        sizes = dealt.groupBy("parent", "shard").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 4 * shard).collect()  # a row for each shard still too large
        large = {r["shard"]: r["n"] for r in sizes if r["n"] < 0.9 * large.get(r["parent"], 0)}
        rows = dealt.select("shard", "fp")
        if large:
            listed = spark.createDataFrame([(k,) for k in large], "shard long")
            done.append(rows.join(F.broadcast(listed), "shard", "left_anti"))
            rows = rows.join(F.broadcast(listed), "shard", "left_semi")
    for more in done:
        rows = rows.unionAll(more)
    return rows


def _builder(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, levels, fps in zip(b.column("shard").to_pylist(), b.column("levels").to_pylist(), b.column("fps"), strict=True):
                points = fps.values.to_numpy(zero_copy_only=False).view(np.uint64)
                mixed = points[np.random.default_rng(SEED).permutation(len(points))]
                tree = VantageTree.build(mixed, levels, radius)
                yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([tree.vantages.view(np.int64)], pa.list_(pa.int64())), pa.array([tree.cuts], pa.list_(pa.int64()))], names=["shard", "vantages", "cuts"])

    return run


def _dealer(shared, radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = {k: VantageTree(*v) for k, v in shared.value.items()}
        for b in batches:
            shards, points = b.column("shard").to_numpy(zero_copy_only=False), b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for k in np.unique(shards).tolist():
                own = points[shards == k]
                at, branch = trees[k].deal(own, radius) if k in trees else (np.arange(len(own)), np.zeros(len(own), np.int64))
                # Branches have numbers of their own below each shard.
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k)), pa.array((k << (LEVELS + 1)) + branch + 1), pa.array(own[at].view(np.int64))], names=["parent", "shard", "fp"])

    return run


def links(fps: DataFrame, radius: int = RADIUS, shard: int | None = None) -> DataFrame:
    """Edges (a, b) that join all distinct ``fps.fp`` within ``radius`` bits: a spanning
    forest of each shard, so no more than a row for each fingerprint and shard, and
    no link lost. Fingerprints must be distinct.
    """
    rows = deal(fps, radius, shard)
    found = rows.repartition("shard").sortWithinPartitions("shard").mapInArrow(tidy(_searcher(radius, False)), "a long, b long")
    return cut(found.distinct(), "simhash-links")


def report(fps: DataFrame, radius: int = RADIUS, shard: int | None = None) -> DataFrame:
    """What the search of each shard takes: its points, the nodes split, the branches
    that the triangle bound pruned, pairs compared, and links of its forest."""
    rows = deal(fps, radius, shard)
    return rows.repartition("shard").sortWithinPartitions("shard").mapInArrow(tidy(_searcher(radius, True)), ", ".join(f"{c} long" for c in _REPORT))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b): root is the least node,
    in signed order, that it reaches.

    Alternates large-star and small-star steps: every node links its larger
    neighbours, then itself and its smaller ones, to the least of them. Both are
    a minimum for each node, pre-aggregated, and a join that AQE can split where
    a node has very many links. Each round is written to the shared folder.
    """
    pairs = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "cc")
    before = None
    while True:
        both = pairs.unionAll(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        pairs = cut(small.where("u <> v").distinct(), "cc")
        now = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.countDistinct("u")).first()
        if not now[0] or now[0] == now[2] and now == before:
            break
        before = now
    roots = pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionAll(roots.select(F.col("root").alias("node"), "root").distinct())


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id, copies) for each row of ``docs``.

    component_id is the least doc_id that the row reaches over fingerprints
    within ``radius`` bits; ``copies`` counts the rows with its fingerprint.
    Rows with a null doc_id take part; a component of such rows only has a null
    id. Null and empty texts have the fingerprint 0; very long ones are taken
    whole. Repeated rows stay repeated. An empty table gives no rows.
    """
    rows = cut(fingerprints(docs, shingle), "simhash-fp")
    classes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies")), "simhash-classes")
    roots = components(links(classes.select("fp"), radius))
    rooted = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "copies", "least", F.coalesce("root", "fp").alias("root"))
    best = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    rooted = cut(rooted.join(best, "root").select("fp", "copies", "component_id"), "simhash-components")
    return rows.join(rooted, "fp").select("doc_id", "fp", "component_id", "copies")


# Links by similarity


def parity_bits(h: np.ndarray) -> np.ndarray:
    """The number of distinct shingles ``h``, then bits: how many of them fall on each,
    modulo 2. Two texts differ in at least as many shingles as in bits.

    There are no fewer bits than shingles, as about half of the bits of texts with many
    more differ, whatever the texts. The upper half follows the two halves' XOR, which is
    the list of half as many bits, in the same form: a prefix is as good as a short list."""
    words = WORDS
    while words * 64 < len(h):
        words *= 2
    counts = np.bincount((h % np.uint64(words * 64)).astype(np.int64), minlength=words * 64)
    bits, upper = np.packbits((counts & 1).astype(np.uint8), bitorder="little").view("<i8"), []
    while len(bits) > WORDS:
        low, high = np.split(bits, 2)
        bits = low ^ high
        upper.append(high)
    return np.concatenate([np.array([len(h)], np.int64), bits, *upper[::-1]])


def signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, text_hash, fp, keys) of each row: its fingerprint and parity bits."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes = [shingle_hashes(t or b"", shingle) for t in b.column("text").cast(pa.binary()).to_pylist()]
            fp = np.array([majority(h) for h in hashes], np.uint64).view(np.int64)
            keys = pa.array([parity_bits(np.unique(h)) for h in hashes], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), pa.array(fp), keys], names=["doc_id", "text_hash", "fp", "keys"])

    return _texts(docs).mapInArrow(tidy(run), "doc_id long, text_hash long, fp long, keys array<long>")


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def _rows_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``docs`` with the doc_id and text of a row of ``wanted`` (__d, __t), which
    goes to every task up to MOST_BROADCAST rows; texts move only beyond."""
    wanted = cut(wanted.withColumn("__k", F.xxhash64("__d", "__t")), "simhash-wanted")
    text = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    own = docs["doc_id"].cast("long")
    same = (F.xxhash64(own, text) == wanted["__k"]) & own.eqNullSafe(wanted["__d"]) & (text == wanted["__t"])
    return docs.join(F.broadcast(wanted) if wanted.count() <= MOST_BROADCAST else wanted, same, "left_semi")


def similar_pairs(sets: list[np.ndarray], similarity: float, pairs: list[tuple[int, int]] | None = None) -> list[tuple[int, int]]:
    """Of ``pairs``, all by default, those whose sorted sets have a Jaccard similarity of
    ``similarity`` or more."""
    out = []
    for i, j in itertools.combinations(range(len(sets)), 2) if pairs is None else pairs:
        x, y = (sets[i], sets[j]) if len(sets[i]) <= len(sets[j]) else (sets[j], sets[i])
        if not len(x) or len(x) < similarity * len(y) - SLACK:
            continue
        common = 0
        for k in range(0, len(x), SKETCH):
            part = x[k : k + SKETCH]
            at = np.minimum(np.searchsorted(y, part), len(y) - 1)
            common += int((y[at] == part).sum())
        if common >= similarity * (len(x) + len(y) - common):
            out.append((i, j))
    return out


def prefix_sizes(n: int, similarity: float) -> tuple[int, int]:
    """(probed, indexed): two sets share one of their first elements in any common order,
    one of the probed of the larger with one of the indexed of the other."""
    return n - math.ceil(similarity * n - SLACK) + 1, n - math.ceil(2 * similarity / (1 + similarity) * n - SLACK) + 1


def _frequent(texts: DataFrame, n: int, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles found three times or more in a sample of the ``n`` texts, with their
    counts. They only order shingles: any order gives the same links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = [np.unique(shingle_hashes(t, shingle)) for b in batches for t in b.column("text").cast(pa.binary()).to_pylist()]
        if hashes:
            h, counts = np.unique(np.concatenate(hashes), return_counts=True)
            for k in range(0, len(h), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(h[k : k + (1 << 16)].view(np.int64)), pa.array(counts[k : k + (1 << 16)])], names=["h", "n"])

    part = F.pmod(F.xxhash64("text_hash"), F.lit(1 << 30)) / float(1 << 30)
    sample = texts.where(part < min(1.0, TEXTS_SAMPLED / max(1, n))).mapInArrow(tidy(run), "h long, n long")
    rows = sample.groupBy("h").agg(F.sum("n").alias("n")).where("n > 2").orderBy(F.desc("n"), "h").limit(MOST_FREQUENT).collect()
    h, counts = np.array([r["h"] for r in rows], np.int64).view(np.uint64), np.array([r["n"] for r in rows], np.int64)
    order = np.argsort(h)
    return h[order], counts[order]


def _prefixes(shared, shingle: int, similarity: float):
    """The prefix of each text, rarest shingles first; copies within a task once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, counts = shared.value
        seen: set[int] = set()
        for b in batches:
            keys, names, sizes, indexed = [], [], [], []
            for name, text in zip(b.column("text_hash").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), strict=True):
                if name in seen:
                    continue
                if len(seen) > 1 << 18:
                    seen.clear()
                seen.add(name)
                h = np.unique(shingle_hashes(text, shingle))
                if not len(h):
                    continue
                probe, index = prefix_sizes(len(h), similarity)
                if len(frequent):
                    at = np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)
                    h = h[np.argsort(np.where(frequent[at] == h, counts[at], 0), kind="stable")]
                keys.append(h[:probe].view(np.int64))
                names.append(np.full(probe, name))
                sizes.append(np.full(probe, len(h)))
                indexed.append(np.arange(probe) < index)
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, names, sizes, indexed)], names=["key", "text_hash", "n", "indexed"])

    return run


def _repeated(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """``batches``, sorted by the key, without rows whose key is seen to be alone."""
    for b in batches:
        keys = b.column(key).to_numpy(zero_copy_only=False)
        same, keep = keys[1:] == keys[:-1], np.ones(len(keys), bool)
        keep[1:-1] = same[:-1] | same[1:]
        yield b.filter(pa.array(keep))


def _may_link(n: np.ndarray, indexed: np.ndarray, a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """Which of the pairs (a, b) with a shared shingle their sizes and prefixes allow."""
    low, high = np.minimum(n[a], n[b]), np.maximum(n[a], n[b])
    return (low >= similarity * high - SLACK) & ((n[a] <= n[b]) & indexed[a] | (n[b] <= n[a]) & indexed[b])


def _meeting(similarity: float, few: int):
    """Pairs (a, b) of texts that share a shingle of their prefixes: all where no more than
    ``few`` share it; else those with one of the texts, and a row for each text."""
    names = ["a", "b", "key", "n", "indexed", "size"]

    def batch(held: list[tuple]) -> pa.RecordBatch:
        a, b, key, n, indexed, size = (np.concatenate(x) for x in zip(*held, strict=True))
        lone = n > 0  # a text, not a pair
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, mask=lone), pa.array(key), pa.array(n), pa.array(indexed), pa.array(size)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for key, own in _groups(_repeated(batches, "key"), "key", "x"):
            texts, first = np.unique(own.field("text_hash").to_numpy(zero_copy_only=False), return_index=True)
            m = len(texts)
            if m < 2:
                continue
            n, indexed = (own.field(x).to_numpy(zero_copy_only=False)[first] for x in ("n", "indexed"))
            if m <= few:
                a, b = np.triu_indices(m, 1)
                ok = _may_link(n, indexed, a, b, similarity)
            else:
                # Keys of the same texts take a few heads between them.
                mixed = (texts.view(np.uint64) ^ np.uint64(int(key) % HEADS)) * np.uint64(0x9E3779B97F4A7C15)
                b = np.arange(m)
                a = np.full(m, int((mixed ^ (mixed >> np.uint64(29))).argmin()))
                ok = (a != b) & (np.minimum(n[a], n[b]) >= similarity * np.maximum(n[a], n[b]) - SLACK)
                held.append((texts, texts, np.full(m, key), n, indexed, np.full(m, m)))
                rows += m
            a, b = texts[a[ok]], texts[b[ok]]
            none = np.zeros(len(a), np.int64)
            held.append((np.minimum(a, b), np.maximum(a, b), none, none, none > 0, none))
            rows += len(a)
            if rows > 1 << 15:
                yield batch(held)
                held, rows = [], 0
        if held:
            yield batch(held)

    return run


def _most_bits(n: np.ndarray, similarity: float) -> np.ndarray:
    """Shingles that texts of ``n`` shingles between them may differ in."""
    return n * ((1 - similarity) / (1 + similarity)) + SLACK


def _sizes(column: pa.Array) -> np.ndarray:
    return pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)


def _bits_of(column: pa.Array, words: int = WORDS) -> np.ndarray:
    """Of each text the number of shingles and ``words`` words of parity bits."""
    ends = np.cumsum(sizes := _sizes(column))
    # Unsigned: bitwise_count takes the absolute value of negative numbers.
    return column.flatten().to_numpy(zero_copy_only=False).view(np.uint64)[(ends - sizes)[:, None] + np.arange(words + 1)]


def _differ(x: pa.Array, y: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of each pair, the shingles of both and the bits that differ of as many as both have."""
    n, bits = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    words = np.minimum(_sizes(x), _sizes(y)) - 1
    for w in np.unique(words).tolist():
        at = np.flatnonzero(words == w)
        p, q = (_bits_of(z.take(pa.array(at)), w) for z in (x, y))
        apart, k = p[:, 1:] ^ q[:, 1:], WORDS
        while k < w:
            apart[:, :k] ^= apart[:, k : 2 * k]  # the lower half from the XOR of both
            k *= 2
        n[at], bits[at] = p[:, 0] + q[:, 0], np.bitwise_count(apart).sum(1, dtype=np.int64)
    return n, bits


def _sifter(similarity: float):
    """The pairs that parity bits allow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, bits = _differ(b.column("x"), b.column("y"))
            ok = pa.array(bits <= _most_bits(n, similarity))
            yield pa.RecordBatch.from_arrays([b.column(c).filter(ok) for c in ("a", "b")], names=["a", "b"])

    return run


def _crosser(similarity: float):
    """Of two blocks of texts with a common shingle, all pairs that are not joined yet and
    that sizes, prefixes and parity bits allow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, own in _groups(batches, "task", "x"):
            texts, n, indexed, root, block = (own.field(c).to_numpy(zero_copy_only=False) for c in ("a", "n", "indexed", "root", "block"))
            bits = _bits_of(own.field("keys"))[:, 1:]
            roots, at, sizes = np.unique(root, return_inverse=True, return_counts=True)
            if len(roots) < 2:
                continue
            two = block.min() != block.max()
            # Those of the largest component need not meet each other.
            rest, everyone = np.flatnonzero(at != sizes.argmax()), np.arange(len(texts))
            largest = at == sizes.argmax()
            step = max(1, (1 << 16) // len(texts))
            for k in range(0, len(rest), step):
                i = np.repeat(rest[k : k + step], len(texts))
                j = np.tile(everyone, len(i) // len(texts))
                ok = (root[i] != root[j]) & (largest[j] | (i < j)) & _may_link(n, indexed, i, j, similarity)
                if two:
                    ok &= block[i] != block[j]
                i, j = i[ok], j[ok]
                ok = np.bitwise_count(bits[i] ^ bits[j]).sum(1, dtype=np.int64) <= _most_bits(n[i] + n[j], similarity)
                a, b = texts[i[ok]], texts[j[ok]]
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return run


def _sifted(classes: DataFrame, pairs: DataFrame, similarity: float, name: str) -> DataFrame:
    """The distinct ``pairs`` (a, b) of text_hash that the parity bits in ``classes`` allow."""
    x, y = classes.select(F.col("text_hash").alias("a"), F.col("keys").alias("x")), classes.select(F.col("text_hash").alias("b"), F.col("keys").alias("y"))
    both = pairs.select("a", "b").distinct().join(x, "a").join(y, "b").select("a", "b", "x", "y")
    return cut(both.mapInArrow(tidy(_sifter(similarity)), "a long, b long"), name)


def _confirmed(docs: DataFrame, classes: DataFrame, pairs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The ``pairs`` (a, b) of text_hash whose whole shingle sets are similar."""
    ends = pairs.select(F.col("a").alias("text_hash")).unionAll(pairs.select("b")).distinct()
    names = classes.join(ends, "text_hash", "left_semi").select(F.col("least").alias("__d"), F.col("text_hash").alias("__t"))
    texts = _rows_of(_texts(docs), names).select("text_hash", "text")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = [np.unique(shingle_hashes(t, shingle)).tobytes() for t in b.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("text_hash"), pa.array(data, pa.binary())], names=["text_hash", "shingles"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.frombuffer(x.as_buffer(), "<u8") for c in ("x", "y") for x in b.column(c)]
            n = b.num_rows
            at = pa.array([i for i, _ in similar_pairs(sets, similarity, [(i, n + i) for i in range(n)])], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(c).take(at) for c in ("a", "b")], names=["a", "b"])

    # Repeated rows of one id and text give the same set.
    sets = cut(texts.mapInArrow(tidy(whole), "text_hash long, shingles binary").groupBy("text_hash").agg(F.first("shingles").alias("shingles")), "simhash-shingles")
    x, y = sets.select(F.col("text_hash").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("text_hash").alias("b"), F.col("shingles").alias("y"))
    return cut(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(tidy(compare), "a long, b long"), "simhash-similar")


def similar_links(docs: DataFrame, classes: DataFrame, shingle: int, similarity: float, most: int = MOST_TEXTS) -> DataFrame:
    """Edges (a, b) of text_hash that join all different texts of ``similarity`` or more.

    ``classes`` has a row (text_hash, keys, least) for each distinct text, ``least`` a
    doc_id that has it. Similar texts share a shingle of their prefixes, whatever the
    order of shingles (``prefix_sizes``); rarest first, few others do. Where more than
    FEW texts share one, each first meets one of them. Texts that this leaves in
    different components then meet all others, in tasks of two blocks of about
    ``most`` / 2 texts: no pair is left out but those that are joined already or that sizes,
    prefixes or parity bits rule out.
    """
    spark, few = docs.sparkSession, min(FEW, most)
    small_batches(spark)
    shared = spark.sparkContext.broadcast(_frequent(_texts(docs), classes.count(), shingle))
    postings = _texts(docs).select("text_hash", "text").mapInArrow(tidy(_prefixes(shared, shingle, similarity)), "key long, text_hash long, n long, indexed boolean")
    grouped = postings.select("key", F.struct("text_hash", "n", "indexed").alias("x")).repartition("key").sortWithinPartitions("key")
    met = cut(grouped.mapInArrow(tidy(_meeting(similarity, few)), "a long, b long, key long, n long, indexed boolean, size long"), "simhash-met")
    found = _confirmed(docs, classes, _sifted(classes, met.where("b is not null"), similarity, "simhash-pairs"), shingle, similarity)
    large = met.where("b is null")
    if large.isEmpty():
        return found
    rows = large.join(components(found), F.col("a") == F.col("node"), "left").select("key", "a", "n", "indexed", "size", F.coalesce("root", "a").alias("root"))
    rows = cut(rows, "simhash-large")
    parted = rows.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    blocks = F.ceil(F.col("size") * 2 / most)
    rows = rows.join(parted, "key", "left_semi").withColumn("block", F.pmod(F.xxhash64("a", "key"), blocks))
    # Each block meets each, itself included.
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    rows = rows.withColumn("task", F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")))
    # Tasks get the least words of bits; the pairs that these allow are sifted by all.
    rows = rows.join(classes.select(F.col("text_hash").alias("a"), F.slice("keys", 1, WORDS + 1).alias("keys")), "a").select("task", F.struct("a", "n", "indexed", "root", "block", "keys").alias("x"))
    crossed = rows.repartition("task").sortWithinPartitions("task").mapInArrow(tidy(_crosser(similarity)), "a long, b long")
    return found.unionAll(_confirmed(docs, classes, _sifted(classes, crossed, similarity, "simhash-crossed"), shingle, similarity))


def keep_first(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, similarity: float | None = None) -> DataFrame:
    """``docs`` with one row of each component: that with the least doc_id.

    Rows are linked if their fingerprints are within ``radius`` bits or, with
    ``similarity``, if their shingle sets have that Jaccard similarity or more; no such
    link is lost. Among rows with the least doc_id, that with the least hash of its text
    stays; of rows that repeat id and text, one. A null id counts as largest. Null and
    empty texts are copies of each other; very long ones are taken whole. All columns
    stay, whatever their names; an empty table gives an empty one.
    """
    spark, began = docs.sparkSession, made()
    rows = cut(signatures(docs, shingle), "simhash-signatures")
    order = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash"))
    classes = rows.groupBy("text_hash").agg(F.first("fp").alias("fp"), F.first("keys").alias("keys"), order.alias("least"), F.count(F.lit(1)).alias("copies"))
    classes = cut(classes, "simhash-classes")
    # Nodes are texts: equal fingerprints hang on the least text that has them.
    heads = cut(classes.groupBy("fp").agg(F.min("text_hash").alias("head")), "simhash-heads")
    near = links(heads.select("fp"), radius)
    a, b = heads.select(F.col("fp").alias("a"), F.col("head").alias("u")), heads.select(F.col("fp").alias("b"), F.col("head").alias("v"))
    edges = near.join(a, "a").join(b, "b").select(F.col("u").alias("a"), F.col("v").alias("b"))
    edges = edges.unionAll(classes.join(heads, "fp").where(F.col("head") != F.col("text_hash")).select(F.col("head").alias("a"), F.col("text_hash").alias("b")))
    if similarity is not None:
        edges = edges.unionAll(similar_links(docs, classes.select("text_hash", F.col("least.doc_id").alias("least"), "keys"), shingle, similarity))
    roots = components(edges)
    rooted = classes.join(roots, classes["text_hash"] == roots["node"], "left").select("least", "copies", F.coalesce("root", "text_hash").alias("root"))
    best = cut(rooted.groupBy("root").agg(F.min("least").alias("least"), F.max("copies").alias("copies")), "simhash-kept")
    first = best.select(F.col("least.doc_id").alias("__d"), F.col("least.text_hash").alias("__t"))
    kept = _rows_of(docs, first)
    twice = rows.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    alone = twice.isEmpty()
    remove(spark, [p for p in made() if p not in began and p != made()[-1]])  # the last is the list of rows to keep
    if alone:
        return kept
    text = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    return kept.withColumn("__text", text).dropDuplicates(["doc_id", "__text"]).drop("__text")
