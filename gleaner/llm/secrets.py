"""Secret scans: fixed patterns and windowed entropy [native].

Beside the fixed patterns, candidate strings (long stretches of token
characters that mix letters and digits) are searched by a window that slides
over their characters. Each step takes one character out of the window's counts
and one in, which changes the entropy by four terms; nothing is summed again.
A candidate counts if the highest entropy of a window exceeds the limit of its
character class, unless the allow-list names it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import apart, find_spans, let, replace_spans, text_of

#: Fixed values of the contract.
ASSIGN = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}+"
KINDS = ["assign", "access", "hex", "entropy"]

#: Candidates, and the classes with the window's length and its limit in bits:
#: about the 1 % quantile of a window of random characters of 16, 36, 36 and 64.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
WINDOW = 20
CLASSES = (("hex", r"^[0-9A-Fa-f]+$", 2.9), ("upper", r"^[A-Z0-9]+$", 3.4), ("lower", r"^[a-z0-9]+$", 3.4), ("mixed", r"^[A-Za-z0-9+/_=-]+$", 3.65))
#: Characters that candidates have.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Never secrets: UUIDs, paths and slugs of words, placeholders, counting runs.
ALLOW = (
    r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$"
    r"|^[/_=-]*[A-Za-z]{0,24}[0-9]{0,6}(?:[/_=-]+[A-Za-z]{0,24}[0-9]{0,6})+$"
    r"|(?i:example|placeholder|changeme|your[_-]?|xxxx|0123456789|abcdefgh)"
)


def _plogp(n: Column) -> Column:
    """n * log2(n), 0 at 0, from a table of the counts a window can have."""
    table = F.array(*[F.lit(0.0 if k < 2 else k * math.log2(k)) for k in range(WINDOW + 1)])
    return F.element_at(table, n + 1)


def most_entropy(word: Column, window: int = WINDOW) -> Column:
    """The highest Shannon entropy, in bits, of a window over a string of at least
    ``window`` token characters.

    The window's counts by character are kept: a step lowers the count of the
    character that leaves and raises that of the one that comes.
    """
    codes = F.transform(F.split(word, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    return let(codes, lambda own: _most_entropy(own, window))


def _most_entropy(codes: Column, window: int) -> Column:
    of = lambda counts, c: F.element_at(counts, c)
    symbols = F.array(*[F.lit(k + 1) for k in range(len(ALPHABET))])

    def step(acc: Column, i: Column) -> Column:
        move = F.struct(F.element_at(codes, i - 1).alias("old"), F.element_at(codes, i + window - 1).alias("new"), acc.alias("a"))
        return let(move, moved)

    def moved(m: Column) -> Column:
        a, old, new = m["a"], m["old"], m["new"]
        gone, come = of(a["n"], old), of(a["n"], new) + 1  # before the one leaves, after the other has come
        s = a["s"] - _plogp(gone) + _plogp(gone - 1) - _plogp(come - 1) + _plogp(come)
        counts = F.zip_with(a["n"], symbols, lambda v, k: v - (k == old).cast("int") + (k == new).cast("int"))
        after = F.struct(counts.alias("n"), s.alias("s"), F.least(a["low"], s).alias("low"))
        return F.when(old == new, a).otherwise(after)

    counts = let(F.slice(codes, 1, window), lambda own: F.transform(symbols, lambda k: F.size(F.filter(own, lambda x: x == k))))
    start = let(counts, lambda n: let(F.aggregate(n, F.lit(0.0), lambda a, v: a + _plogp(v)), lambda s: F.struct(n.alias("n"), s.alias("s"), s.alias("low"))))
    last = F.size(codes) - window + 1
    steps = F.when(last > 1, F.sequence(F.lit(2), F.greatest(last, F.lit(2)))).otherwise(F.array().cast("array<int>"))
    return F.lit(math.log2(window)) - F.aggregate(steps, start, step, lambda a: a["low"]) / window


def _entropy_spans(text: Column) -> Column:
    def secret(m: Column) -> Column:
        h = most_entropy(m)
        over = F.lit(False)
        for _, pattern, limit in reversed(CLASSES):
            over = F.when(m.rlike(pattern), h > limit).otherwise(over)
        return m.rlike("[0-9]") & m.rlike("[A-Za-z]") & ~m.rlike(ALLOW) & over

    return find_spans(text, CANDIDATE, 3, secret)


def secret_spans(text: Column) -> tuple[Column, Column]:
    """(base spans, entropy spans) of a text as arrays of struct<s,k,e,m>."""
    value_of = lambda m: F.char_length(F.regexp_extract(m, ASSIGN, 1)) >= 8
    base = F.concat(find_spans(text, ASSIGN, 0, value_of), find_spans(text, ACCESS, 1), find_spans(text, HEX, 2))
    return base, _entropy_spans(text)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, ``base`` and ``hits``: arrays of struct<s,k,e,m>, in order.

    ``k`` indexes KINDS. Base spans are those of the fixed patterns, leftmost
    non-overlapping for each kind; ``hits`` adds the entropy spans that touch no
    base span. Null texts are empty; very long ones, and those with very many
    matches, take time in proportion. Every row gives one row, repeated ones too;
    an empty table gives none; other columns are not read.
    """
    base, more = secret_spans(text_of(docs))
    out = docs.select(docs["doc_id"].cast("long").alias("doc_id"), base.alias("base"), more.alias("more"))
    return out.select("doc_id", F.array_sort("base").alias("base"), F.array_sort(F.concat("base", apart(F.col("base"), F.col("more")))).alias("hits"))


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``mark``.

    Overlapping spans are replaced as one. All columns stay, whatever their names;
    n_chars, if there, follows the new text; texts without secrets, null and empty
    ones too, stay as they are, and so do repeated rows. Time grows with the text,
    however many spans it has. An empty table gives an empty one.
    """
    base, more = secret_spans(text_of(docs))
    out = docs.withColumn("__hits", F.array_sort(F.concat(base, more)))
    out = out.withColumn("text", F.when(F.size("__hits") > 0, replace_spans(F.col("text"), F.col("__hits"), lambda x: F.lit(mark))).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("__hits") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars").cast("long")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
