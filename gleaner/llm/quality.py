"""Quality rules as a short-circuit cascade.

Rules run one after the other over Arrow batches, each only on the texts that are
still kept, and a count is taken when the first rule asks for it: a text that is
rejected early never pays for the costly counts. A bounded sample gives every
rule's cost, by the counts it needs and the bytes of the texts, and its share of
rejections; the rules run by rejections per cost, highest first. The order
changes the work, never the verdict. No clock is read, so it is the same again.
"""

from __future__ import annotations

import itertools
import random
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gleaner.llm.common import parts, small_batches, tidy

#: Fixed values of the contract.
SPACE_BYTES = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
CONTINUATION = bytes(range(0x80, 0xC0))
MIN_WORDS, REPEAT_PERCENT = 50, 50

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Words of one vectorised pass; a longer text makes a pass of its own.
CHUNK_WORDS = 1 << 20
#: Bytes of text whose words are held at once, and texts drawn from a sampled partition.
PART_BYTES, SAMPLE_ROWS = 2 << 20, 64

#: Limits of the rules beside the base, chosen on labelled rows: over half of
#: the words repeat or a third as many symbols as words mark junk, while rows
#: labelled good stay far below.
LIMITS = {"symbols_per_word": 0.3, "dup_lines_per_word": 0.2, "longest_mean_word": 16.0, "letters_share": 0.2}


def repeat_words(words: list[bytes], sizes: list[int]) -> np.ndarray:
    """For each text, its words in 3-word windows found twice or more in it."""
    out = np.zeros(len(sizes), np.int64)
    n = len(words)
    if n < 4:
        return out
    ids: defaultdict[bytes, int] = defaultdict(itertools.count().__next__)
    code = np.fromiter(map(ids.__getitem__, words), np.int64, n)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    at = np.flatnonzero(doc[:-2] == doc[2:])
    if not len(at):
        return out
    v = len(ids)
    _, pair = np.unique((doc[at] * v + code[at]) * v + code[at + 1], return_inverse=True)
    key = pair * v + code[at + 2]
    order = np.argsort(key)
    key = key[order]
    same = np.zeros(len(key) + 1, bool)
    same[1:-1] = key[1:] == key[:-1]
    twice = at[order[same[1:] | same[:-1]]]
    hit = np.zeros(n, bool)
    for k in range(3):
        hit[twice + k] = True
    np.add.at(out, doc[hit], 1)
    return out


def lines_of(text: bytes) -> list[bytes]:
    return [x for x in text.split(b"\n") if x and not x.isspace()]


def letters_share(text: bytes) -> float:
    """Letters, and all code points beyond ASCII, per code point that is no white space."""
    solid = text.translate(None, SPACE_BYTES + CONTINUATION)
    other = solid.translate(None, b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ" + bytes(range(0xC0, 0x100)))
    return 1 - len(other) / max(1, len(solid))


class Counts:
    """Counts of some texts, each taken for a text when it is first asked for."""

    def __init__(self, texts: list[bytes]):
        self.texts = texts
        self.words: dict[int, list[bytes]] = {}
        self.known: dict[str, dict[int, float]] = defaultdict(dict)
        #: Texts for which each count was taken.
        self.taken: defaultdict[str, int] = defaultdict(int)

    def of(self, name: str, at: list[int]) -> np.ndarray:
        """The count ``name`` of the texts ``at``."""
        known = self.known[name]
        new = [i for i in at if i not in known]
        if new:
            self.taken[name] += len(new)
            known.update(zip(new, getattr(self, "_" + name)(new), strict=True))
        return np.array([known[i] for i in at], float if name == "letters" else np.int64)

    def _split(self, at: list[int]) -> list[list[bytes]]:
        return [self.words.setdefault(i, self.texts[i].split()) if i not in self.words else self.words[i] for i in at]

    def _n_words(self, at: list[int]) -> list[int]:
        return [len(w) for w in self._split(at)]

    def _n_repeat_words(self, at: list[int]) -> list[int]:
        out: list[int] = []
        words: list[bytes] = []
        sizes: list[int] = []
        for own in self._split(at):
            if words and len(words) + len(own) > CHUNK_WORDS:
                out += repeat_words(words, sizes).tolist()
                words, sizes = [], []
            words += own
            sizes.append(len(own))
        return out + repeat_words(words, sizes).tolist()

    def _word_chars(self, at: list[int]) -> list[int]:
        drop = SPACE_BYTES + CONTINUATION
        return [len(self.texts[i].translate(None, drop)) for i in at]

    def _n_symbols(self, at: list[int]) -> list[int]:
        return [len(self.texts[i]) - len(self.texts[i].translate(None, SYMBOLS)) for i in at]

    def _n_lines(self, at: list[int]) -> list[int]:
        return [len(lines_of(self.texts[i])) for i in at]

    def _n_dup_lines(self, at: list[int]) -> list[int]:
        lines = [lines_of(self.texts[i]) for i in at]
        return [len(x) - len(set(x)) for x in lines]

    def _letters(self, at: list[int]) -> list[float]:
        return [letters_share(self.texts[i]) for i in at]


#: Nanoseconds a byte that each count takes, as measured once on documents; fixed, so
#: that the order of the rules depends on the sample alone.
UNIT = {"n_words": 6.0, "n_repeat_words": 70.0, "word_chars": 1.5, "n_symbols": 1.0, "n_lines": 1.0, "n_dup_lines": 1.5, "letters": 3.0}


@dataclass(frozen=True)
class Rule:
    """Rejects texts by some counts: ``test`` gets them as arrays, in the order of ``needs``."""

    needs: tuple[str, ...]
    test: Callable[..., np.ndarray]

    def rejects(self, counts: Counts, at: list[int]) -> np.ndarray:
        return self.test(*[counts.of(n, at) for n in self.needs])


RULES: dict[str, Rule] = {
    "few_words": Rule(("n_words",), lambda n: n < MIN_WORDS),
    "repeats": Rule(("n_repeat_words", "n_words"), lambda r, n: 100 * r > REPEAT_PERCENT * n),
    "symbols": Rule(("n_symbols", "n_words"), lambda s, n: s > LIMITS["symbols_per_word"] * np.maximum(1, n)),
    "long_words": Rule(("word_chars", "n_words"), lambda c, n: c > LIMITS["longest_mean_word"] * np.maximum(1, n)),
    "dup_lines": Rule(("n_lines", "n_dup_lines", "n_words"), lambda k, d, n: (k > 3) & (2 * d > k) & (d > LIMITS["dup_lines_per_word"] * n)),
    "letters": Rule(("letters",), lambda x: x < LIMITS["letters_share"]),
}


def order_rules(sizes: np.ndarray, rejected: np.ndarray, rules: dict[str, Rule] = RULES) -> list[str]:
    """Rule names, next always that with the most rejections per cost among the sampled
    texts that are left. ``sizes``: their bytes; ``rejected``: a column for each rule. A
    count costs its unit for each byte, and nothing once another rule has taken it."""
    names, order = list(rules), []
    left, paid = np.ones(len(sizes), bool), set()
    while len(order) < len(names):

        def score(name: str) -> float:
            unit = sum(UNIT.get(c, 1.0) for c in rules[name].needs if c not in paid) + 0.01
            return (float(rejected[left, names.index(name)].sum()) + 0.01) / (unit * max(1.0, float(sizes[left].sum())))

        best = max((n for n in names if n not in order), key=score)
        order.append(best)
        paid |= set(rules[best].needs)
        left &= ~rejected[:, names.index(best)]
    return order


def cascade(counts: Counts, order: list[str], rules: dict[str, Rule] = RULES) -> list[str | None]:
    """The first rule in ``order`` that rejects each text, or None."""
    out: list[str | None] = [None] * len(counts.texts)
    left = list(range(len(counts.texts)))
    for name in order:
        if not left:
            break
        hit = rules[name].rejects(counts, left)
        for i in itertools.compress(left, hit):
            out[i] = name
        left = list(itertools.compress(left, ~hit))
    return out


def sample_rules(docs: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, rejections by rule) of randomly drawn texts, whatever their length.

    Partitions are drawn so that their number grows with the logarithm of all, and
    ``rows`` texts from each, by reservoir; others are not read. Rules run on the
    executors: a few numbers for each text reach the driver.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        draw = random.Random(part)
        if draw.random() * max(1, part // 8) >= 1:
            return
        held: list[bytes] = []
        seen = 0
        for batch in batches:
            for t in batch.column("text"):
                seen += 1
                k = len(held) if len(held) < rows else draw.randrange(seen)
                if k < rows:
                    held[k : k + 1] = [t.as_buffer().to_pybytes()]
        counts = Counts(held)
        hits = [rule.rejects(counts, list(range(len(held)))) for rule in RULES.values()]
        yield pa.RecordBatch.from_arrays([pa.array([len(t) for t in held], pa.int64()), pa.array([[bool(h[i]) for h in hits] for i in range(len(held))], pa.list_(pa.bool_()))], names=["size", "rejected"])

    got = docs.select(docs["text"].cast("string").alias("text")).where("text is not null").mapInArrow(tidy(run), "size long, rejected array<boolean>").collect()
    return np.array([r["size"] for r in got], float), np.array([r["rejected"] for r in got], bool).reshape(-1, len(RULES))


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in batch.column("text").cast(pa.string()).cast(pa.binary()).to_pylist()]


def rate(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, prefix: str = "") -> DataFrame:
    """``docs`` with the five counts, base_failed, kept and rejected_by added.

    Null and empty texts have no words; very long ones are taken whole. ``rejected_by``
    names the first rule that rejected the text in the order taken, or is null;
    ``kept`` is false if base_failed (under 50 words or over half of them in repeated
    windows). Every row, repeated ones too, gives one; an empty table gives none. All
    columns of ``docs`` stay, but for those with these names, which are replaced;
    ``prefix`` goes before the added names. Counts that no rule needed are taken at
    the end, for all texts; ``keep`` leaves them out.
    """
    order = order_rules(*sample_rules(docs, sample_rows))
    added = [prefix + c for c in (*COUNTS, "base_failed", "kept", "rejected_by")]
    docs = docs.drop(*added)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    kinds = ["bigint"] * len(COUNTS) + ["boolean", "boolean", "string"]
    schema = fields + "".join(f", `{c}` {kind}" for c, kind in zip(added, kinds, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, "text", PART_BYTES):
            counts = Counts(_texts(part))
            why = cascade(counts, order)
            every = list(range(len(why)))
            own = {c: counts.of(c, every) for c in COUNTS}
            failed = RULES["few_words"].rejects(counts, every) | RULES["repeats"].rejects(counts, every)
            kept = np.array([w is None for w in why], bool) & ~failed
            extra = [pa.array(own[c]) for c in COUNTS] + [pa.array(failed), pa.array(kept), pa.array(why, pa.string())]
            yield pa.RecordBatch.from_arrays(part.columns + extra, names=part.schema.names + added)

    return docs.mapInArrow(tidy(run), schema)


def keep(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` that ``rate`` keeps, in all columns as they are.

    A text that a rule rejects pays for no count that only later rules need. Null
    and empty texts have no words and go; an empty table gives an empty one.
    """
    order = order_rules(*sample_rules(docs, sample_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, "text", PART_BYTES):
            why = cascade(Counts(_texts(part)), order)
            yield part.filter(pa.array([w is None for w in why], pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)
