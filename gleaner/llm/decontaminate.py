"""Benchmark decontamination by a generalised suffix automaton over words.

One automaton holds all substrings of all test items. Streaming a document's
words through it gives, at each word, the longest match that ends there; a
match of ten words or more hits all its words, as each ten-word window inside
it is a window of an item. Items of fewer words are windows as a whole, found
on the suffix links of the state.

Most words of clean text follow each other in no item. A vectorised test of
adjacent word pairs leaves the stretches in which a window can lie at all, and
only those run through the automaton.
"""

from __future__ import annotations

import pickle
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import file_system, parts, publish, scratch, small_batches, tidy

WINDOW = 10
#: Text bytes of one automaton, about; bytes of automata that a worker keeps; and of
#: the texts whose words it holds at once.
BLOCK_BYTES, CACHE_BYTES, PART_BYTES = 1 << 20, 128 << 20, 2 << 20
#: Fixed value of the contract: bytes that separate words, and A-Z in lower case.
_SEPARATORS = [*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]
_TABLE = bytearray(range(256))
for _b in _SEPARATORS:
    _TABLE[_b] = _b + 32 if 0x41 <= _b <= 0x5A else 0x20
_TABLE = bytes(_TABLE)


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased words: runs of digits, letters and code points beyond ASCII."""
    return (text or b"").translate(_TABLE).split()


class SuffixAutomaton:
    """Of several sequences of small positive integers, while it is built."""

    def __init__(self, items: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: dict[int, set[int]] = {}
        for k, item in enumerate(items):
            last = 0
            for x in item:
                last = self._extend(last, x)
                self.ends.setdefault(last, set()).add(k)

    def _extend(self, last: int, x: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if x in nxt[last]:
            q = nxt[last][x]
            return q if length[q] == length[last] + 1 else self._split(last, x, q)
        cur = len(length)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and x not in nxt[p]:
            nxt[p][x] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][x]
            link[cur] = q if length[q] == length[p] + 1 else self._split(p, x, q)
        return cur

    def _split(self, p: int, x: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        copy = len(length)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        while p != -1 and nxt[p].get(x) == q:
            nxt[p][x] = copy
            p = link[p]
        link[q] = copy
        return copy


class Block:
    """Some items of the benchmark: their words and word pairs, and an automaton in
    flat arrays, some 20 bytes for each byte of text, that files hold as they are."""

    INTS = ("link", "length", "at_window", "at_short", "short_length", "item_starts", "items", "to")
    LONGS = ("pairs", "keys")

    @classmethod
    def build(cls, items: list[tuple[str | None, bytes]], window: int) -> Block:
        self = cls()
        lists = [words_of(t) for _, t in items]
        ids: dict[bytes, int] = {}
        coded = [[ids.setdefault(w, len(ids) + 1) for w in x] for x in lists]
        self.names, self.words, self.window = [k for k, _ in items], list(ids), window
        v = self.v = len(ids) + 1
        # Shortest stretch of following words that can hold a window; an item of one word is found by the word alone.
        self.shortest = min([window, *(len(x) for x in coded if x)])
        self.pairs = np.unique(np.array([a * v + b for x in coded for a, b in zip(x, x[1:], strict=False)], np.int64))
        built = SuffixAutomaton(coded)
        n = len(built.length)
        link, length = built.link, built.length
        order = sorted(range(1, n), key=length.__getitem__)
        owners: list[set[int]] = [built.ends.get(s, set()) for s in range(n)]
        for s in reversed(order):
            up = link[s]
            if length[up] >= window:
                owners[up] = owners[up] | owners[s]
        short: dict[int, set[int]] = {}
        for k, item in enumerate(coded):
            if item and len(item) < window:
                s = 0
                for x in item:
                    s = built.next[s][x]
                short.setdefault(s, set()).add(k)
        at_window, at_short, short_length = [-1] * n, [-1] * n, [0] * n
        held: list[list[int]] = [[] for _ in range(n)]
        for s in order:
            # The state of a state's last `window` words, and the nearest one up the links, itself included, that is a short item.
            if length[s] >= window:
                at_window[s] = at_window[link[s]] if length[link[s]] >= window else s
                if at_window[s] == s:
                    held[s] = sorted(k for k in owners[s] if len(coded[k]) >= window)
            at_short[s] = s if s in short else at_short[link[s]]
            if s in short:
                held[s] = sorted({*held[s], *short[s]})
                short_length[s] = len(coded[next(iter(short[s]))])
        as_ints = lambda x: np.array(x, np.int32)
        self.link, self.length, self.at_window, self.at_short, self.short_length = map(as_ints, (link, length, at_window, at_short, short_length))
        self.item_starts = as_ints(np.concatenate([[0], np.cumsum([len(x) for x in held])]))
        self.items = as_ints([k for x in held for k in x])
        keys = np.array([s * v + x for s, own in enumerate(built.next) for x in own], np.int64)
        to = as_ints([t for own in built.next for t in own.values()])
        by_key = np.argsort(keys)
        self.keys, self.to = keys[by_key], to[by_key]
        return self

    def dump(self) -> bytes:
        return pickle.dumps({k: v for k, v in self.__dict__.items() if not k.startswith("_")})

    @classmethod
    def load(cls, data: bytes) -> Block:
        self = cls()
        self.__dict__ |= pickle.loads(data)
        # Plain sequences: single elements of numpy arrays are slow to read.
        for name in (*cls.INTS, "keys"):
            own = getattr(self, name)
            setattr(self, name, array("i" if own.dtype == np.int32 else "q", own.tobytes()))
        return self

    def scan(self, seq: list[int], base: int, hit: np.ndarray, found: set[int], seen: set[int]) -> None:
        """Mark the hit words of ``seq`` from ``base`` on and add the items found; ``seen``
        holds the states whose items ``found`` has."""
        s, n, v = 0, 0, self.v
        keys, to, link, length, window = self.keys, self.to, self.link, self.length, self.window
        for i, x in enumerate(seq):
            while True:
                key = s * v + x
                at = bisect_left(keys, key)
                if at < len(keys) and keys[at] == key:
                    s = to[at]
                    n += 1
                    break
                if not s:
                    n = 0
                    break
                s = link[s]
                n = length[s]
            if n >= window:
                # Windows that end earlier in this match have been marked at their ends.
                hit[base + i - window + 1 : base + i + 1] = True
                self._add(self.at_window[s], found, seen)
            t = self.at_short[s] if s else -1
            while t != -1:
                m = self.short_length[t]
                if m <= n:
                    hit[base + i - m + 1 : base + i + 1] = True
                    self._add(t, found, seen)
                t = self.at_short[link[t]] if link[t] > 0 else -1

    def _add(self, state: int, found: set[int], seen: set[int]) -> None:
        if state not in seen:
            seen.add(state)
            found.update(self.items[self.item_starts[state] : self.item_starts[state + 1]])


def _stretches(code: np.ndarray, doc: np.ndarray, pairs: np.ndarray, v: int, shortest: int) -> list[tuple[int, int]]:
    """Runs of known words, each pair of neighbours known, of ``shortest`` words or more."""
    n = len(code)
    follows = np.zeros(n + 1, bool)  # word i continues the stretch of word i - 1
    if n > 1 and len(pairs):
        both = np.flatnonzero((code[:-1] > 0) & (code[1:] > 0) & (doc[:-1] == doc[1:]))
        key = code[both] * v + code[both + 1]
        at = np.minimum(np.searchsorted(pairs, key), len(pairs) - 1)
        follows[both[pairs[at] == key] + 1] = True
    heads = np.flatnonzero((code > 0) & ~follows[:n])
    stops = np.flatnonzero((code > 0) & ~follows[1:]) + 1
    long = stops - heads >= shortest
    return list(zip(heads[long].tolist(), stops[long].tolist(), strict=True))


class Matcher:
    """All blocks of a benchmark. Words and pairs of all stay in memory; automata are
    loaded when a text has a stretch for them, and as many kept as CACHE_BYTES hold."""

    def __init__(self, folder: str, files: list[str]):
        self.store, self.root = file_system(folder)
        self.files, self.held, self.held_bytes = files, {}, 0
        self.ids: dict[bytes, int] = {}
        self.local: list[tuple[np.ndarray, np.ndarray, int, int]] = []  # of each block: its words' ids by ours, pairs, v, shortest
        parts = []
        for f in files:
            own = pickle.loads(self._read(f, ".words"))
            known = np.array([self.ids.setdefault(w, len(self.ids) + 1) for w in own["words"]], np.int64)
            self.local.append((known, own["pairs"], own["v"], own["shortest"]))
        v = self.v = len(self.ids) + 1
        for known, pairs, own_v, _ in self.local:
            if len(pairs):
                parts.append(known[pairs // own_v - 1] * v + known[pairs % own_v - 1])
        self.pairs = np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.int64)
        self.shortest = min((x[3] for x in self.local), default=1)
        self.loads = 0

    def _read(self, name: str, end: str) -> bytes:
        with self.store.open_input_file(f"{self.root}/{name}{end}") as f:
            return f.read()

    def block(self, k: int) -> Block:
        if k not in self.held:
            data = self._read(self.files[k], ".block")
            self.loads += 1
            while self.held and self.held_bytes + len(data) > CACHE_BYTES:
                _, size = self.held.pop(next(iter(self.held)))
                self.held_bytes -= size
            self.held[k] = Block.load(data), len(data)
            self.held_bytes += len(data)
        return self.held[k][0]

    def match(self, words: list[bytes], sizes: list[int]) -> tuple[np.ndarray, list[list[str]]]:
        """Whether each word is hit, and the items found in each text."""
        n = len(words)
        hit = np.zeros(n, bool)
        names: list[set[str]] = [set() for _ in sizes]
        if not n or not self.ids:
            return hit, [[] for _ in sizes]
        get = self.ids.get
        code = np.fromiter((get(w, 0) for w in words), np.int64, n)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        spans = _stretches(code, doc, self.pairs, self.v, self.shortest)
        if not spans:
            return hit, [[] for _ in sizes]
        one = len(self.local) == 1
        if not one:  # what is left of the batch, a gap between any two stretches
            at = np.concatenate([np.arange(a, b) for a, b in spans])
            gap = np.cumsum(np.concatenate([[0], np.diff(at) > 1]))
        for k, (known, pairs, v, shortest) in enumerate(self.local):
            if one:
                own, where, group, runs = code, None, doc, spans
            else:
                to_own = np.zeros(self.v, np.int64)
                to_own[known] = np.arange(1, len(known) + 1)
                own, where, group = to_own[code[at]], at, gap
                runs = _stretches(own, group, pairs, v, shortest)
            if not runs:
                continue
            block, found, seen = self.block(k), {}, {}
            marked = hit if one else np.zeros(len(own), bool)
            for a, b in runs:
                d = int(doc[a if one else where[a]])
                block.scan(own[a:b].tolist(), a, marked, found.setdefault(d, set()), seen.setdefault(d, set()))
            if not one:
                hit[where[marked]] = True
            for d, items in found.items():
                names[d].update(block.names[x] for x in items if block.names[x] is not None)
        return hit, [sorted(x) for x in names]


def _build_blocks(benchmark: DataFrame, item_column: str, window: int, most: int) -> tuple[str, list[str]]:
    """The folder and the names of files with the benchmark's blocks, of about ``most``
    bytes of text each. Executors build them; only names reach the driver."""
    spark = benchmark.sparkSession
    small_batches(spark)
    rows = benchmark.select(F.col(item_column).cast("string").alias("k"), F.col("text").cast("string").alias("t")).where(F.col("t").isNotNull())
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    folder = scratch(spark, "benchmark-blocks")
    store, root = file_system(folder)
    store.create_dir(root, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        items = [(k, t.encode()) for b in batches for k, t in zip(b.column("k").to_pylist(), b.column("t").to_pylist(), strict=True)]
        if not items:
            return
        context = TaskContext.get()
        name = f"part-{context.partitionId():06d}"
        block = Block.build(sorted(items, key=lambda x: (x[0] is not None, x)), window)
        own, root = file_system(folder)
        words = pickle.dumps({"words": block.words, "pairs": block.pairs, "v": block.v, "shortest": block.shortest})
        del block.words, block.pairs
        for end, data in ((".words", words), (".block", block.dump())):
            temporary = f"{root}/.{name}{end}-{context.taskAttemptId()}"
            with own.open_output_stream(temporary) as f:
                f.write(data)
            publish(own, temporary, f"{root}/{name}{end}")
        yield pa.RecordBatch.from_arrays([pa.array([name])], names=["name"])

    blocks = max(1, -(-total // most))
    found = rows.repartition(blocks, F.xxhash64("t")).mapInArrow(tidy(run), "name string").collect()
    return folder, sorted({r["name"] for r in found})


def _runs(hit: np.ndarray) -> list[int]:
    """Starts and ends in turn of the stretches of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return edge.tolist()


def find_leaks(docs: DataFrame, benchmark: DataFrame, item_column: str = "item_id", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, prefix: str = "") -> DataFrame:
    """``docs`` with n_words, hit_runs (word offsets: start, end, start, ...) and items.

    ``items`` holds the sorted distinct ids of test items of which a window occurs; an
    item with a null id hits words like any other, but cannot be named there. Null
    and empty texts have no words; items without words have no windows. Very long
    texts are taken whole, and a match costs the same for each of its words however
    long it is. Every row gives one row, repeated ones too; empty tables give no rows
    or no hits. Columns of ``docs`` with these names are replaced; ``prefix`` goes
    before them.

    Executors build an automaton for each ``block_bytes`` of the benchmark and write
    it to the shared folder; documents are passed over once, whatever the number of
    blocks.
    """
    folder, files = _build_blocks(benchmark, item_column, window, block_bytes)
    added = [prefix + c for c in ("n_words", "hit_runs", "items")]
    docs = docs.drop(*added)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    schema = f"{fields}, `{added[0]}` bigint, `{added[1]}` array<int>, `{added[2]}` array<string>"
    return docs.mapInArrow(tidy(_finder(folder, files, added)), schema)


#: The matcher that this worker used last, for its next task.
_built: dict[str, Matcher] = {}


def _matcher(folder: str, files: list[str]) -> Matcher:
    if folder not in _built:
        _built.clear()
        _built[folder] = Matcher(folder, files)
    return _built[folder]


def _finder(folder: str, files: list[str], added: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(folder, files)
        for batch in parts(batches, "text", PART_BYTES):
            texts = batch.column("text").cast(pa.string()).cast(pa.binary()).to_pylist()
            words: list[bytes] = []
            sizes = []
            for t in texts:
                own = words_of(t)
                words += own
                sizes.append(len(own))
            hit, items = matcher.match(words, sizes)
            bounds = np.concatenate([[0], np.cumsum(sizes)]).tolist()
            runs = [_runs(hit[a:b]) if hit[a:b].any() else [] for a, b in zip(bounds, bounds[1:], strict=False)]
            extra = [pa.array(np.array(sizes, np.int64)), pa.array(runs, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(batch.columns + extra, names=[*batch.schema.names, *added])

    return run


def hit_words() -> F.Column:
    """Words inside hit_runs."""
    runs = F.col("hit_runs")
    halves = F.transform(F.when(F.size(runs) > 0, F.sequence(F.lit(0), F.size(runs) - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.when(i % 2 == 1, F.get(runs, i)).otherwise(-F.get(runs, i)))
    return F.aggregate(halves, F.lit(0).cast("long"), lambda a, x: a + x)


def _cutter(columns: list[str], most_share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        word = regex.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
        for batch in batches:
            texts, all_runs, n = batch.column("text").to_pylist(), batch.column("__leak_hit_runs").to_pylist(), batch.column("__leak_n_words").to_pylist()
            keep, new = [], []
            for t, runs, words in zip(texts, all_runs, n, strict=True):
                hits = sum(b - a for a, b in zip(runs[::2], runs[1::2], strict=True))
                keep.append(not hits or hits <= most_share * words)
                if hits and keep[-1]:
                    at = [m.span() for m in word.finditer(t)]
                    pieces, last = [], 0
                    for a, b in zip(runs[::2], runs[1::2], strict=True):
                        pieces.append(t[last : at[a][0]])
                        last = at[b - 1][1]
                    t = "".join([*pieces, t[last:]])
                new.append(t)
            cols = [pa.array(new, pa.string()) if c == "text" else batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays(cols, names=columns).filter(pa.array(keep))

    return run


def remove_leaks(docs: DataFrame, benchmark: DataFrame, most_share: float = 0.3, **options) -> DataFrame:
    """``docs`` without the passages of ``benchmark``.

    Every hit span is cut from its text (length limit: a whole window). A text
    of which more than ``most_share`` of the words are hit goes as a whole, as
    what is left of it makes no document. Texts without hits, null and empty ones
    too, stay as they are, as do all other columns; n_chars, if there, follows the
    new text. Empty tables give an empty one, or all documents.
    """
    columns = docs.columns
    out = find_leaks(docs, benchmark, prefix="__leak_", **options)
    out = out.mapInArrow(tidy(_cutter(columns, most_share)), docs.schema)
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*columns)
