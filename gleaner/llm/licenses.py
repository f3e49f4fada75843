"""Licence notices by a trained paragraph classifier [native].

A paragraph is a line of text with the lines that it is wrapped on. Every one is
classified by a multinomial logistic regression over word n-grams. An L1 penalty
leaves few n-grams with weights, so words and neighbours are looked up in tables
that are constants of the plan, and a score is a sum over the few that are
known. A class ``unknown`` takes what licenses nothing; temperature and limit are
calibrated on templates and lines that were held out as a whole. A prediction
stands only if the paragraph also shares enough n-grams with a template of that
family.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from gleaner.llm.common import find_spans, let, text_of
from gleaner.llm.license_texts import TEMPLATES, UNKNOWN

#: A line of at most this many characters that does not end a sentence goes on in the next.
WRAP = 100
PARAGRAPH = rf"(?:[^\n]{{0,{WRAP - 1}}}[^\n\r.!?]\r?\n(?=[^\n]*[^\s]))*+[^\n]++"
TOKEN = r"[a-z0-9]+(?:[.-][a-z0-9]+)*+"
SLOTS = 1 << 16
#: Share of n-grams that a paragraph and a template must have in common, of the shorter.
CONFIRM = 0.6
#: N-grams that a paragraph counts at least: one word alone confirms a template of one word only.
LEAST = 3
#: Share of held-out unknown lines that may pass the calibrated limit.
FALSE_RATE = 0.02
FOLDS, STEPS, RATE, L1, L2 = 4, 150, 1.0, 2e-4, 1e-4


def tokens_of(text: str) -> list[str]:
    return re.findall(TOKEN, text.lower())


def grams_of(text: str) -> list[str]:
    """Distinct words and pairs of neighbours."""
    words = tokens_of(text)
    return list(dict.fromkeys([*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))]))


@dataclass(frozen=True)
class Model:
    families: tuple[str, ...]  # the last is unknown
    grams: dict[str, int]  # with weights -> row
    weights: np.ndarray  # rows x families
    bias: np.ndarray
    temperature: float
    limit: float

    def scores(self, text: str) -> np.ndarray:
        rows = [self.grams[g] for g in grams_of(text) if g in self.grams]
        return self.weights[rows].sum(0) + self.bias

    def predict(self, text: str) -> tuple[str, float]:
        p = softmax(self.scores(text)[None] / self.temperature)[0]
        k = int(p[:-1].argmax())
        return (self.families[k], float(p[k])) if p[k] >= self.limit else ("unknown", float(p[-1]))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def variants(line: str) -> list[str]:
    """A line as it appears in files: comment marks, names, cut ends, no stops."""
    words = line.split()
    out = [line, line.rstrip("."), f"# {line}", f"{line} See LICENSE for details.", f"(c) 2020 The Authors. {line}", f"Note: {line}"]
    if len(words) > 12:
        out += [" ".join(words[: len(words) // 2]), " ".join(words[len(words) // 3 :])]
    return out


def _fit(x: np.ndarray, y: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias by accelerated proximal gradient steps; each class counts the same."""
    x = np.hstack([x, np.ones((len(x), 1))]).astype(np.float32)  # the bias is the last column, without penalty
    goal = np.eye(classes, dtype=np.float32)[y]
    share = (1 / np.bincount(y, minlength=classes)[y])[:, None].astype(np.float32) / classes
    w = np.zeros((classes, x.shape[1]), np.float32)
    ahead, t = w, 1.0
    for _ in range(STEPS):
        d = ((softmax(x @ ahead.T) - goal) * share).T @ x + np.float32(L2) * ahead
        new = ahead - np.float32(RATE) * d
        new[:, :-1] = np.sign(new[:, :-1]) * np.maximum(0, np.abs(new[:, :-1]) - np.float32(RATE * L1))
        t, before = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        ahead = new + np.float32((before - 1) / t) * (new - w)
        w = new
    return w[:, :-1].astype(float), w[:, -1].astype(float)


def lines() -> list[tuple[str, int]]:
    """All templates with their family's index, then the unknown lines with the last."""
    return [(t, k) for k, f in enumerate(TEMPLATES) for t in TEMPLATES[f]] + [(t, len(TEMPLATES)) for t in UNKNOWN]


def held_out() -> tuple[np.ndarray, np.ndarray]:
    """(scores, class) of each line by a model that saw neither it nor its variants."""
    every = lines()
    # Folds run through each class in turn, so that none is left without templates.
    fold = np.array([sum(k == j for _, j in every[:i]) % FOLDS for i, (_, k) in enumerate(every)])
    z = np.zeros((len(every), len(TEMPLATES) + 1))
    for f in range(FOLDS):
        names, x, y = _matrix([every[i] for i in np.flatnonzero(fold != f)])
        w, b = _fit(x, y, z.shape[1])
        for i in np.flatnonzero(fold == f):
            rows = [names[g] for g in grams_of(every[i][0]) if g in names]
            z[i] = w[:, rows].sum(1) + b
    return z, np.array([k for _, k in every])


def _matrix(some: list[tuple[str, int]]) -> tuple[dict[str, int], np.ndarray, np.ndarray]:
    every = [(v, k) for t, k in some for v in variants(t)]
    names: dict[str, int] = {}
    rows = [[names.setdefault(g, len(names)) for g in grams_of(t)] for t, _ in every]
    x = np.zeros((len(every), len(names)))
    for i, own in enumerate(rows):
        x[i, own] = 1
    return names, x, np.array([k for _, k in every])


@functools.cache
def train() -> Model:
    """Fit on all templates and unknown lines. Temperature and limit come from scores of
    lines held out with all their variants. Deterministic, and independent of the corpus."""
    names, x, y = _matrix(lines())
    w, b = _fit(x, y, len(TEMPLATES) + 1)
    z, own = held_out()

    def loss(t: float) -> float:
        return -np.log(np.maximum(1e-12, softmax(z / t)[np.arange(len(z)), own])).mean()

    temperature = float(round(min(np.geomspace(0.1, 5, 60), key=loss), 6))
    wrong = softmax(z / temperature)[own == len(TEMPLATES)][:, :-1].max(1)
    limit = max(0.5, float(np.quantile(wrong, 1 - FALSE_RATE)))
    used = [g for g, k in names.items() if np.abs(w[:, k]).max() > 1e-3]
    weights = np.round(w[:, [names[g] for g in used]].T, 5)
    return Model((*TEMPLATES, "unknown"), {g: i for i, g in enumerate(used)}, weights, np.round(b, 5), temperature, round(limit, 6))


def _constant(values, kind: str) -> Column:
    """An array that folds into one constant of the plan."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


class Tables:
    """What the plan looks up: words by a hash without collisions, and for each word
    those that may follow it. A gram's number is the word's, or ``n_words`` and the pair's."""

    def __init__(self, model: Model):
        templates = [[grams_of(t) for t in TEMPLATES[f]] for f in model.families[:-1]]
        grams = list(dict.fromkeys([*model.grams, *(g for family in templates for t in family for g in t)]))
        words = sorted({w for g in grams for w in g.split()})
        hashes = [xxh64_intdigest(w.encode(), 42) for w in words]
        signed = [h - (1 << 64) if h >> 63 else h for h in hashes]
        self.slots = next(m for m in range(SLOTS, 2 * SLOTS) if len({h % m for h in signed}) == len(words))
        slot = np.zeros(self.slots, np.int64)
        number: dict[str, int] = {}
        for i, (w, h) in enumerate(zip(words, signed, strict=True)):
            slot[h % self.slots], number[w] = i + 1, i + 1
        pairs = sorted({(number[a], number[b]) for g in grams if " " in g for a, b in [g.split()]})
        number |= {f"{words[a - 1]} {words[b - 1]}": len(words) + k + 1 for k, (a, b) in enumerate(pairs)}
        starts = np.searchsorted([a for a, _ in pairs], np.arange(1, len(words) + 2)) + 1
        row = np.zeros(len(words) + len(pairs), np.int64)
        for g, k in model.grams.items():
            row[number[g] - 1] = k + 1
        self.n_words, self.n_families = len(words), len(model.families)
        self.slot, self.starts = _constant(slot, "int"), _constant(starts, "int")
        self.names = F.split(F.lit("\n".join(words)), "\n")
        self.followers, self.row = _constant([b for _, b in pairs] or [0], "int"), _constant(row, "int")
        self.weights = _constant([f"{v:g}" for v in model.weights.ravel()], "double")
        self.bias = _constant([f"{v:g}" for v in model.bias], "double")
        self.templates = [[_constant([number[g] for g in t], "int") for t in family] for family in templates]

    def codes(self, words: Column) -> Column:
        """The number of each word, 0 if it is not known."""
        found = F.transform(words, lambda w: F.element_at(self.slot, F.pmod(F.xxhash64(w), F.lit(self.slots)).cast("int") + 1))
        return F.zip_with(words, found, lambda w, k: F.when((k > 0) & (F.get(self.names, k - 1) == w), k).otherwise(0))

    def pair(self, a: Column, b: Column) -> Column:
        """The number of a pair of known words, 0 if it is not known."""
        first = F.element_at(self.starts, a)
        k = F.array_position(F.slice(self.followers, first, F.element_at(self.starts, a + 1) - first), b).cast("int")
        return F.when((a > 0) & (b > 0), F.when(k > 0, F.lit(self.n_words - 1) + first + k).otherwise(0)).otherwise(0)


def _classify(text: Column, model: Model, t: Tables) -> Column:
    """struct<family, p, similarity> of a paragraph; family is an index from 1. The
    similarity is taken for predictions over the limit only, else 0."""

    def read(words: Column) -> Column:
        return let(t.codes(words), lambda codes: let(known(codes), lambda grams: scored(grams, F.size(codes))))

    def known(codes: Column) -> Column:
        pairs = F.zip_with(codes, F.slice(codes, 2, F.greatest(F.size(codes) - 1, F.lit(0))), lambda a, b: F.when(F.coalesce(b, F.lit(0)) > 0, t.pair(a, b)).otherwise(0))
        return F.array_distinct(F.filter(F.concat(codes, F.when(F.size(codes) > 0, pairs).otherwise(codes)), lambda g: g > 0))

    def scored(grams: Column, n: Column) -> Column:
        rows = F.filter(F.transform(grams, lambda g: F.element_at(t.row, g)), lambda r: r > 0)
        add = lambda acc, r: F.zip_with(acc, F.slice(t.weights, (r - 1) * t.n_families + 1, t.n_families), lambda a, w: a + w)
        return let(F.transform(F.aggregate(rows, t.bias, add), lambda v: v / model.temperature), lambda z: let(F.transform(z, lambda v: F.exp(v - F.array_max(z))), lambda e: best(e, grams, n)))

    def best(e: Column, grams: Column, n: Column) -> Column:
        named = F.slice(e, 1, t.n_families - 1)
        total = F.aggregate(e, F.lit(0.0), lambda a, v: a + v)
        found = F.struct(F.array_position(named, F.array_max(named)).cast("int").alias("family"), (F.array_max(named) / total).alias("p"))
        return let(found, lambda f: F.struct(f["family"].alias("family"), f["p"].alias("p"), F.when(f["p"] >= model.limit, similarity(f["family"], grams, n)).otherwise(0.0).alias("similarity")))

    def similarity(family: Column, grams: Column, n: Column) -> Column:
        share = lambda own: F.size(F.array_intersect(own, grams)) / F.least(F.size(own), F.greatest(2 * n - 1, F.lit(LEAST)))
        out = F.lit(0.0)
        for i, group in enumerate(t.templates):
            out = F.when(family == i + 1, F.greatest(*[share(own) for own in group], F.lit(0.0))).otherwise(out)
        return out

    return let(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)), read)


def rated(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, rated): array<struct<s,e,c>> of all paragraphs, ``c`` as in ``_classify``."""
    model = model or train()
    tables = Tables(model)
    paragraphs = find_spans(text_of(docs), PARAGRAPH, 0)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), paragraphs.alias("paragraphs"))
    return rows.select("doc_id", F.transform("paragraphs", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), _classify(x["m"], model, tables).alias("c"))).alias("rated"))


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, notices): array<struct<s,e,family,p,similarity>> of each row.

    Notices are paragraphs, in order, with code point offsets; ``p`` is calibrated
    and rounded. Those under the limit or without a like template are left out.
    Every paragraph is scored, however long the text. Null and empty texts have
    none. Every row gives one row, repeated ones too; an empty table gives none;
    other columns are not read.
    """
    model = model or train()
    names = F.array(*[F.lit(f) for f in model.families])
    good = F.filter("rated", lambda x: (x["c"]["p"] >= model.limit) & (x["c"]["similarity"] >= CONFIRM))
    notices = F.transform(good, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.element_at(names, x["c"]["family"]).alias("family"), F.round(x["c"]["p"], 4).alias("p"), F.round(x["c"]["similarity"], 4).alias("similarity")))
    return rated(docs, model).select("doc_id", notices.alias("notices"))
