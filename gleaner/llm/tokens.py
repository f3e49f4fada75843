"""Token ids in binary files, coded by a static range asymmetric numeral system.

One frequency table, counted over all documents, is shared by all blocks and
stands in every file, so that a file can be read with nothing but itself. The ids
of a block are dealt to interleaved lanes, each an rANS state of its own, which
numpy steps together. Every block can be decoded alone, and so can its parts: its
header has sizes, checksums and checkpoints, which are all lane states before
every PART_IDS ids and the place in the coded words where decoding goes on. A
document longer than a block goes on in the next.

File: magic; uint32 bytes and CRC-32 of the table, the table (zlib, little-endian
uint32 for each id); blocks; footer (uint64 offset, documents that start, ids of
each block), uint64 number of blocks, uint64 offset of the footer, magic.
Block: see ``pack_block``. All numbers are little-endian.
"""

from __future__ import annotations

import itertools
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import cut, file_system, parts, publish, scratch, small_batches, tidy

MAGIC = b"GLTOK2\0\0"
END_ID = 1
#: Bits of the frequency table's total; states lie in [2**31, 2**63).
SCALE = 20
LOW = 1 << 31
#: Lanes, ids of one block at most, and ids between its checkpoints.
LANES = 4096
BLOCK_IDS, PART_IDS = 1 << 20, 1 << 18
MANIFEST_FILES = 8
#: Bytes of text that are split into words at once.
PART_BYTES = 8 << 20
#: The same where tokens are only counted, and words in the table of each worker.
COUNT_BYTES, COUNT_MOST = 4 << 20, 400_000
#: Ids are held as uint16 between the stages.
MOST_IDS = 1 << 16


def scale_counts(counts: np.ndarray, bits: int = SCALE) -> np.ndarray:
    """Frequencies that sum to 2**bits, at least 1 for every id that occurs."""
    total, want = int(counts.sum()), 1 << bits
    freq = np.zeros(len(counts), np.int64)
    if not total:
        return freq
    seen = counts > 0
    if int(seen.sum()) > want:
        raise ValueError("more distinct ids than slots")
    freq[seen] = np.maximum(1, counts[seen].astype(np.float64) * want / total).astype(np.int64)
    while (over := int(freq.sum()) - want) > 0:  # take from the largest, which lose least
        top = np.argsort(-freq, kind="stable")[: max(1, min(over, int((freq > 1).sum()) // 2 or 1))]
        cut_by = np.minimum(freq[top] - 1, -(-over // len(top)))
        cut_by = np.where(np.cumsum(cut_by) <= over, cut_by, np.maximum(0, over - (np.cumsum(cut_by) - cut_by)))
        freq[top] -= cut_by
    freq[int(np.argmax(freq))] += want - int(freq.sum())
    return freq


class Coder:
    def __init__(self, freq: np.ndarray, bits: int = SCALE):
        self.bits = bits
        self.freq = freq.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
        self.slots = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)

    def encode(self, ids: np.ndarray, lanes: int = LANES, part: int = PART_IDS) -> tuple[list[tuple[int, int, np.ndarray]], np.ndarray]:
        """(checkpoints, 32-bit words in the order in which decoding takes them). A
        checkpoint: the id that decoding goes on with, the word, the lane states."""
        k, s32 = np.uint64(self.bits), np.uint64(32)
        x = np.full(lanes, LOW, np.uint64)
        words, made, points = [], 0, []
        room = np.uint64(63 - self.bits)
        for at in range((len(ids) - 1) // lanes * lanes if len(ids) else -1, -1, -lanes):
            sym = ids[at : at + lanes]
            m = len(sym)
            f, c, y = self.freq[sym], self.start[sym], x[:m]
            full = (y >> room) >= f  # the state would leave its range
            if full.any():
                words.append((y[full] & np.uint64(0xFFFFFFFF)).astype("<u4"))
                made += len(words[-1])
                y = np.where(full, y >> s32, y)
            q = y // f
            x[:m] = (q << k) + (y - q * f) + c
            if at % part == 0:
                points.append((at, made, x.copy()))
        words.reverse()
        points.reverse()
        return [(at, made - before, states) for at, before, states in points], np.concatenate(words) if words else np.zeros(0, "<u4")

    def decode(self, n: int, states: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(ids, lane states after them, words taken) of ``n`` ids from a checkpoint on."""
        k, s32, mask = np.uint64(self.bits), np.uint64(32), np.uint64((1 << self.bits) - 1)
        out = np.empty(n, np.uint32)
        x = states.astype(np.uint64)
        lanes, at = len(x), 0
        for i in range(0, n, lanes):
            m = min(lanes, n - i)
            y = x[:m]
            slot = y & mask
            sym = self.slots[slot]
            y = self.freq[sym] * (y >> k) + slot - self.start[sym]
            low = y < np.uint64(LOW)
            if c := int(low.sum()):
                y[low] = (y[low] << s32) | words[at : at + c].astype(np.uint64)
                at += c
            x[:m] = y
            out[i : i + m] = sym
        return out, x, at


_HEAD = "<QQQQQBBII"


def pack_block(coder: Coder, doc_ids: list[int | None], sizes: list[int], ids: np.ndarray, goes_on: bool = False, open_end: bool = False, lanes: int = LANES, part: int = PART_IDS) -> bytes:
    """Header (pieces, ids, lanes, words, checkpoints as uint64; whether the first piece
    goes on with a document of the block before, and the last in the next one, as
    bytes; CRC-32 of the ids as uint32 and of the body); body: a byte for each
    piece, 1 if its doc_id is known; doc_ids; sizes; ids and words before each
    checkpoint; lane states of each; coded words as uint32."""
    points, words = coder.encode(ids, lanes, part)
    known = np.array([d is not None for d in doc_ids], np.uint8).tobytes()
    names = np.array([d or 0 for d in doc_ids], "<i8").tobytes()
    places = np.array([p[:2] for p in points], "<u8").reshape(-1, 2).tobytes()
    states = np.array([p[2] for p in points], "<u8").tobytes()
    body = known + names + np.array(sizes, "<u8").tobytes() + places + states + words.tobytes()
    ids_crc = zlib.crc32(ids.astype("<u4").tobytes())
    return struct.pack(_HEAD, len(doc_ids), len(ids), lanes, len(words), len(points), goes_on, open_end, ids_crc, zlib.crc32(body)) + body


@dataclass
class Pieces:
    """What a block holds: pieces of documents with their sizes, and the ids."""

    doc_ids: list[int | None]
    sizes: np.ndarray
    ids: np.ndarray
    goes_on: bool
    open_end: bool


def unpack_block(coder: Coder, data: bytes, most_ids: int | None = None) -> Pieces:
    """Decodes from each checkpoint on its own, those of the first ``most_ids`` ids only
    if given. Checks the body's checksum, the states between checkpoints, and the
    checksum of the ids if all are decoded."""
    n_docs, n_ids, lanes, n_words, n_points, goes_on, open_end, ids_crc, body_crc = struct.unpack_from(_HEAD, data)
    at = struct.calcsize(_HEAD)
    if zlib.crc32(data[at:]) != body_crc:
        raise ValueError("a block's checksum is wrong")
    known = np.frombuffer(data, np.uint8, n_docs, at)
    names = np.frombuffer(data, "<i8", n_docs, at + n_docs)
    sizes = np.frombuffer(data, "<u8", n_docs, at + 9 * n_docs).astype(np.int64)
    at += 17 * n_docs
    places = np.frombuffer(data, "<u8", 2 * n_points, at).reshape(-1, 2).astype(np.int64)
    states = np.frombuffer(data, "<u8", n_points * lanes, at + 16 * n_points).reshape(-1, lanes)
    words = np.frombuffer(data, "<u4", n_words, at + 16 * n_points + 8 * n_points * lanes)
    ends = np.append(places[1:, 0], n_ids)
    parts = []
    for k in range(n_points):
        if most_ids is not None and places[k, 0] >= most_ids:
            break
        ids, left, taken = coder.decode(int(ends[k] - places[k, 0]), states[k], words[places[k, 1] :])
        last = k + 1 == n_points
        if places[k, 1] + taken != (n_words if last else places[k + 1, 1]) or (left != (np.uint64(LOW) if last else states[k + 1])).any():
            raise ValueError("a block does not end at its first state" if last else "a part does not end at the next checkpoint")
        parts.append(ids)
    ids = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
    if len(ids) == n_ids and zlib.crc32(ids.astype("<u4").tobytes()) != ids_crc:
        raise ValueError("decoded ids have another checksum")
    return Pieces([int(d) if k else None for d, k in zip(names, known, strict=True)], sizes, ids, bool(goes_on), bool(open_end))


def pack_table(freq: np.ndarray) -> bytes:
    data = zlib.compress(freq.astype("<u4").tobytes(), 6)
    return struct.pack("<II", len(data), zlib.crc32(data)) + data


#: Coders by the checksum of their table, for each Python worker.
_coders: dict[int, Coder] = {}


def read_coder(f) -> Coder:
    """The coder of a file by the table at its start."""
    head = f.read_at(len(MAGIC) + 8, 0)
    if head[: len(MAGIC)] != MAGIC:
        raise ValueError("no token file")
    size, crc = struct.unpack_from("<II", head, len(MAGIC))
    if crc not in _coders:
        data = f.read_at(size, len(head))
        if zlib.crc32(data) != crc:
            raise ValueError("a frequency table's checksum is wrong")
        _coders.clear()
        _coders[crc] = Coder(np.frombuffer(zlib.decompress(data), "<u4").astype(np.int64))
    return _coders[crc]


def read_footer(f) -> np.ndarray:
    """(offset, end, documents that start, ids) of each block."""
    tail = f.read_at(16 + len(MAGIC), f.size() - 16 - len(MAGIC)) if f.size() >= 16 + 2 * len(MAGIC) else b""
    if tail[16:] != MAGIC:
        raise ValueError("a token file is not whole")
    n, at = struct.unpack_from("<QQ", tail)
    index = np.frombuffer(f.read_at(24 * n, at), "<u8").reshape(-1, 3).astype(np.int64)
    return np.column_stack([index[:, 0], np.append(index[1:, 0], at), index[:, 1:]])


class Tokens:
    """Ids of whole texts. White space splits tokens in this vocabulary, so a
    stretch without blanks has the same ids wherever it stands; each is encoded
    once and then looked up in a table of bounded size.

    A stretch that is letters, then stops, has the ids of the letters in lower
    case followed by those of the stops, and the table holds only these. Letters
    are one word for the model: they skip the normaliser and the regex, many in
    one call, and the vocabulary's word-end mark tells their ids apart.
    """

    MOST = 600_000
    STOPS = ".,;:!?"
    #: Letters that NFC leaves alone and that have one lower case wherever they stand.
    LETTERS = "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+$"

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > MOST_IDS:
            raise ValueError("ids do not fit 16 bits")
        self.letters = Tokenizer(self.tokenizer.model)  # one vocabulary in memory
        self.letters.normalizer = normalizers.Sequence([])
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ends = np.zeros(MOST_IDS, bool)
        for token, k in self.tokenizer.get_vocab().items():
            self.ends[k] = token.endswith("</w>")
        self.marked = self.tokenizer.model.end_of_word_suffix == "</w>"
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {"": 0}  # place in the table
        self.entries = 1
        self.sizes = np.zeros(1024, np.int64)
        self.starts = np.zeros(1024, np.int64)
        self.flat = np.zeros(1 << 16, np.uint16)
        self.filled = 0

    def _append(self, sizes: np.ndarray, ids: np.ndarray) -> int:
        """Add entries to the table and return the place of the first."""
        first, n = self.entries, len(sizes)
        self.entries += n
        if first + n > len(self.sizes):
            grow = max(len(self.sizes), n)
            self.sizes, self.starts = np.append(self.sizes, np.zeros(grow, np.int64)), np.append(self.starts, np.zeros(grow, np.int64))
        if self.filled + len(ids) > len(self.flat):
            self.flat = np.append(self.flat, np.zeros(max(len(self.flat), len(ids)), np.uint16))
        self.sizes[first : first + n] = sizes
        self.starts[first : first + n] = self.filled + np.cumsum(sizes) - sizes
        self.flat[self.filled : self.filled + len(ids)] = ids
        self.filled += len(ids)
        return first

    def _learn(self, words: list[str], encoded: list[list[int]]) -> None:
        first = self._append(np.array([len(x) for x in encoded], np.int64), np.fromiter(itertools.chain.from_iterable(encoded), np.uint16))
        self.at.update(zip(words, range(first, first + len(words)), strict=True))

    def _plain(self, words: list[str]) -> None:
        """Learn through the whole tokenizer."""
        for k in range(0, len(words), 10_000):
            some = words[k : k + 10_000]
            self._learn(some, [e.ids for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)])

    def _words(self, words: list[str]) -> None:
        """Learn letters in lower case, one word each for the model."""
        for k in range(0, len(words), 20_000):
            some = words[k : k + 20_000]
            lines = [" ".join(some[i : i + 200]) for i in range(0, len(some), 200)]
            ids = np.concatenate([np.array(e.ids, np.uint16) for e in self.letters.encode_batch_fast(lines, add_special_tokens=False)])
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(some):  # not one end for each word: encode them as they are
                self._plain(some)
                continue
            first = self._append(np.diff(ends, prepend=0), ids)
            self.at.update(zip(some, range(first, first + len(some)), strict=True))

    def _places(self, keys: pa.Array) -> np.ndarray:
        """Places of distinct keys, learnt where they are new."""
        words = keys.to_pylist()
        place = self._look_up(words)
        missing = np.flatnonzero(place < 0)
        if len(missing):
            if len(self.at) + len(missing) > self.MOST:
                self.clear()
                missing = np.flatnonzero(self._look_up(words) < 0)
                place[:] = 0
            new = keys.take(pa.array(missing))
            letters = pc.match_substring_regex(new, self.LETTERS).to_numpy(zero_copy_only=False) & self.marked
            self._words(new.filter(pa.array(letters)).to_pylist())
            self._plain(new.filter(pa.array(~letters)).to_pylist())
            place[missing] = self._look_up(new.to_pylist())
        return place

    def _look_up(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.at.get, words, itertools.repeat(-1)), np.int64, len(words))

    def _parts(self, texts: pa.Array) -> tuple[pa.ListArray, pa.DictionaryArray, np.ndarray]:
        """The stretches of each text, their numbers, and the two table places of each
        distinct one (letters, then stops)."""
        lists = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary
        cores = pc.utf8_rtrim(words, self.STOPS)
        letters = pc.and_(pc.match_substring_regex(cores, self.LETTERS), self.marked)
        stops = pc.if_else(letters, pc.replace_substring_regex(words, "[^.,;:!?]+", ""), "").dictionary_encode()
        keys = pc.if_else(letters, pc.utf8_lower(cores), words).dictionary_encode()
        known = pa.concat_arrays([keys.dictionary, stops.dictionary]).dictionary_encode()
        place = self._places(known.dictionary)[known.indices.to_numpy(zero_copy_only=False)]
        parts = np.empty(2 * len(words), np.int64)
        parts[::2] = place[keys.indices.to_numpy(zero_copy_only=False)]
        parts[1::2] = place[len(keys.dictionary) :][stops.indices.to_numpy(zero_copy_only=False)]
        return lists, coded, parts

    def count(self, texts: pa.Array) -> np.ndarray:
        """Ids of each text, without making them."""
        lists, coded, parts = self._parts(texts)
        sizes = self.sizes[parts].reshape(-1, 2).sum(1)[coded.indices.to_numpy(zero_copy_only=False)]
        return np.diff(np.concatenate([[0], np.cumsum(sizes)])[lists.offsets.to_numpy()])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, ids of each text).

        Arrow splits the texts, numbers their distinct words and takes these
        apart; Python sees each distinct key of a batch once.
        """
        lists, coded, parts = self._parts(texts)
        # A table of the batch's distinct words, then the texts from it.
        sizes = self.sizes[parts]
        flat = _ragged(self.flat, self.starts[parts], sizes)
        sizes = sizes.reshape(-1, 2).sum(1)
        starts = np.cumsum(sizes) - sizes
        order = coded.indices.to_numpy(zero_copy_only=False)
        sizes = sizes[order]
        ids = _ragged(flat, starts[order], sizes)
        ends = np.concatenate([[0], np.cumsum(sizes)])[lists.offsets.to_numpy()]
        return ids, np.diff(ends)


def _ragged(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of ``flat`` one after the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, len(flat)) < 1 << 31 else np.int64
    at = np.repeat((starts - (ends - sizes)).astype(kind), sizes)
    at += np.arange(total, dtype=kind)
    return flat[at]


_tokens: dict[str, Tokens] = {}


def tokens(path: str) -> Tokens:
    """One for each Python worker."""
    if path not in _tokens:
        _tokens[path] = Tokens(path)
    return _tokens[path]


def tokenize(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """(doc_id, n_tokens, ids): ids as packed little-endian uint16, ``end_id``
    last. Null texts are empty."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        own = tokens(path)
        own.MOST = Tokens.MOST
        for part in parts(batches, "text", PART_BYTES):
            ids, sizes = own.encode(part.column("text"))
            ends = np.cumsum(sizes)
            data = np.insert(ids, ends, end_id).astype("<u2")
            offsets = np.concatenate([[0], 2 * (ends + np.arange(1, len(ends) + 1))]).astype(np.int32)
            packed = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes + 1), packed], names=["doc_id", "n_tokens", "ids"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(tidy(run), "doc_id long, n_tokens long, ids binary")


def count_tokens(docs: DataFrame, path: str, end_ids: int = 1, most: int = COUNT_MOST, keep: bool = True) -> DataFrame:
    """(doc_id, n_tokens) of each row: the ids of its text and ``end_ids`` more. Null
    texts are empty; repeated rows stay. A worker remembers ``most`` words, for later
    tasks too if ``keep``; without, it holds less beside other stages and learns more."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        own = tokens(path)
        own.MOST = most
        for part in parts(batches, "text", COUNT_BYTES if keep else COUNT_BYTES // 2):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(own.count(part.column("text")) + end_ids, pa.int64())], names=["doc_id", "n_tokens"])
        if not keep:
            own.clear()
            _tokens.clear()

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(tidy(run), "doc_id long, n_tokens long")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(MOST_IDS, np.int64)
    for b in batches:
        counts += np.bincount(np.frombuffer(b"".join(b.column("ids").to_pylist()), "<u2"), minlength=MOST_IDS)
    seen = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen])], names=["id", "n"])


def _writer(shared, base: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        freq = shared.value
        coder = Coder(freq)
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        name = f"part-{part:06d}.gltok"
        table = MAGIC + pack_table(freq)
        out, index, at = None, [], len(table)
        docs: list[int | None] = []
        held: list[np.ndarray] = []
        sizes: list[int] = []
        total, goes_on = 0, False

        def flush(open_end: bool) -> None:
            nonlocal at, total, goes_on
            block = pack_block(coder, docs, sizes, np.concatenate(held), goes_on, open_end)
            out.write(block)
            index.append((at, len(docs) - goes_on, total))
            at += len(block)
            docs.clear(), held.clear(), sizes.clear()
            total, goes_on = 0, open_end

        for b in batches:
            for d, x in zip(b.column("doc_id").to_pylist(), b.column("ids"), strict=True):
                if out is None:
                    store, root = file_system(base)
                    temporary = f"{root}/.{name}-{attempt}"
                    out = store.open_output_stream(temporary)
                    out.write(table)
                ids = np.frombuffer(x.as_buffer(), "<u2")
                if total and total + len(ids) > BLOCK_IDS:
                    flush(False)
                for k in range(0, len(ids), BLOCK_IDS):
                    piece = ids[k : k + BLOCK_IDS]
                    docs.append(d)
                    held.append(piece)
                    sizes.append(len(piece))
                    total += len(piece)
                    if k + BLOCK_IDS < len(ids):
                        flush(True)
        if out is None:
            return
        flush(False)
        out.write(np.array(index, "<u8").tobytes() + struct.pack("<QQ", len(index), at) + MAGIC)
        out.close()
        publish(store, temporary, f"{root}/{name}")  # complete files only, under one name
        yield pa.RecordBatch.from_arrays([pa.array([name])], names=["file"])

    return run


def write_tokens(docs: DataFrame, path: str, base: str | None = None, end_id: int = END_ID) -> str:
    """Write the ids of all ``docs`` in doc_id order to token files; returns their folder.

    Null texts are empty; each document ends with ``end_id``, so none has no ids;
    very long ones go over several blocks. Null doc_ids come first; rows with one
    doc_id are in the order of their ids, and repeated rows stay. Other columns are
    not read. An empty table gives a folder without files. Files are whole or
    absent, so tasks may run again.
    """
    spark = docs.sparkSession
    base = base or scratch(spark, "token-files")
    store, root = file_system(base)
    store.create_dir(root, recursive=True)
    ids = cut(tokenize(docs, path, end_id), "token-ids")
    rows = ids.select("ids").mapInArrow(tidy(_count), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()  # at most the vocabulary
    counts = np.zeros(MOST_IDS, np.int64)
    for r in rows:
        counts[r["id"]] = r["n"]
    shared = spark.sparkContext.broadcast(scale_counts(counts))  # bounded by the vocabulary
    ordered = ids.repartitionByRange("doc_id", "n_tokens", F.crc32("ids")).sortWithinPartitions("doc_id", "n_tokens", F.crc32("ids"))
    ordered.select("doc_id", "ids").mapInArrow(tidy(_writer(shared, base)), "file string").agg(F.count(F.lit(1))).collect()
    return base


def _footers(base: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = file_system(base)
        for b in batches:
            for name in b.column("file").to_pylist():
                with store.open_input_file(f"{root}/{name}") as f:
                    index = read_footer(f)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(index)), pa.array(np.arange(len(index))), pa.array(index[:, 3])], names=["file", "block", "ids"])

    return run


def _reader(base: str, with_ids: bool):
    """Documents that start in a block; one that goes on is read to its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = file_system(base)
        for b in batches:
            for name, k, before in zip(*(b.column(c).to_pylist() for c in ("file", "block", "before")), strict=True):
                with store.open_input_file(f"{root}/{name}") as f:
                    coder, index = read_coder(f), read_footer(f)
                    own = unpack_block(coder, f.read_at(int(index[k, 1] - index[k, 0]), int(index[k, 0])))
                    if len(own.doc_ids) - own.goes_on != index[k, 2] or len(own.ids) != index[k, 3]:
                        raise ValueError(f"block {k} of {name} is not as listed")
                    raw = own.ids.astype("<u4")
                    ends = np.cumsum(own.sizes)
                    at = list(zip(ends - own.sizes, ends, strict=True))[own.goes_on :]
                    crc = [zlib.crc32(raw[a:z]) for a, z in at]
                    data = [[raw[a:z].tobytes()] if with_ids else [] for a, z in at]
                    sizes = own.sizes[own.goes_on :].copy()
                    more = k + 1 if own.open_end and at else len(index)
                    while more < len(index):
                        rest = unpack_block(coder, f.read_at(int(index[more, 1] - index[more, 0]), int(index[more, 0])), most_ids=int(BLOCK_IDS))
                        piece = rest.ids[: rest.sizes[0]].astype("<u4")
                        crc[-1] = zlib.crc32(piece, crc[-1])
                        sizes[-1] += len(piece)
                        if with_ids:
                            data[-1].append(piece.tobytes())
                        more = more + 1 if rest.open_end and len(rest.sizes) == 1 else len(index)
                packed = [b"".join(x) if with_ids else None for x in data]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own.doc_ids[own.goes_on :], pa.int64()), pa.array([before + int(a) for a, _ in at], pa.int64()), pa.array(sizes), pa.array(crc, pa.int64()), pa.array(packed, pa.binary())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
                )

    return run


def read_tokens(spark: SparkSession, base: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of each document in the files of a folder.

    Nothing but the files is needed. Executors read the footers; ``start`` comes from
    prefix sums over them, which have a row for each million ids; then a task decodes
    whole blocks from their checkpoints. A folder without files gives no rows.
    """
    from pyspark.sql import Window as W

    small_batches(spark)
    store, root = file_system(base)
    listed = [(f.base_name,) for f in store.get_file_info(pafs.FileSelector(root)) if f.base_name.endswith(".gltok") and not f.base_name.startswith(".")]
    parts = max(1, min(len(listed), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    files = spark.createDataFrame(sorted(listed), "file string").repartition(parts, "file")
    blocks = cut(files.mapInArrow(tidy(_footers(base)), "file string, block long, ids long").coalesce(MANIFEST_FILES), "token-blocks")
    # Totals of files first: the one-task window sees a row for each file only.
    totals = blocks.groupBy("file").agg(F.sum("ids").alias("file_ids"))
    earlier = totals.select("file", F.coalesce(F.sum("file_ids").over(W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("file_before"))
    inside = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    plan = blocks.join(earlier, "file").select("file", "block", (F.col("file_before") + F.coalesce(F.sum("ids").over(inside), F.lit(0))).alias("before"))
    plan = plan.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "file", "block")
    return plan.mapInArrow(tidy(_reader(base, with_ids)), "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")
