"""Delimited and JSON text: sniffing, loose quoting, flattening.

Files go through Spark's own readers, with every column as text. Small texts
that come as strings are parsed on the driver with the loose quoting rules and
then have the same form.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.functions.coerce import NULL_TOKENS, without_null_tokens

#: Candidate separators in order of preference, and keys of record lists.
SEPARATORS = [",", ";", "\t", "|"]
RECORD_KEYS = ["data", "rows", "records", "items", "results"]
SNIFF_LINES = 20
MAX_BYTES, MAX_ROWS = 64 << 20, 500_000
FLATTEN_DEPTH = 2


class IngestError(ValueError):
    pass


@dataclass
class Parsed:
    columns: list[str]
    rows: list[list[str | None]]
    warnings: list[str] = field(default_factory=list)


def fields_of(line: str, sep: str) -> int:
    """Fields of a line; separators inside quotes do not count."""
    return len(re.sub(r'"[^"]*"?', "", line).split(sep))


def sniff(text: str) -> str:
    """The separator with the steadiest number of fields; comma if none has two."""
    lines = [x for x in re.split(r"\r\n|\r|\n", text) if x.strip()][:SNIFF_LINES]
    best, score = ",", 0.0
    for sep in SEPARATORS:
        counts = [fields_of(x, sep) for x in lines]
        if counts and counts[0] >= 2:
            s = 10 * counts.count(counts[0]) / len(counts) + 0.1 * min(counts[0], 30)
            if s > score:
                best, score = sep, s
    return best


def records(text: str, sep: str) -> list[list[str]]:
    """Records of loosely quoted text: a quote anywhere in a field switches
    quoting, two inside quotes are one; line ends may be LF, CRLF or CR."""
    out: list[list[str]] = [[]]
    token = re.compile(rf'""|"|\r\n|\r|\n|{re.escape(sep)}|[^"\r\n{re.escape(sep)}]+')
    quoted, value = False, ""
    for m in token.finditer(text):
        t = m[0]
        if quoted:
            if t == '""':
                value += '"'
            elif t == '"':
                quoted = False
            else:
                value += t
        elif t == '"':
            quoted = True
        elif t == '""':
            continue  # an empty quoted part
        elif t == sep:
            out[-1].append(value)
            value = ""
        elif t in ("\r\n", "\r", "\n"):
            out[-1].append(value)
            out.append([])
            value = ""
        else:
            value += t
    out[-1].append(value)
    return [r for r in out if not (len(r) == 1 and not r[0].strip())]


def header(names: list[str]) -> tuple[list[str], list[str]]:
    """Trimmed names, ``column_N`` for blank ones, numbered repeats; warnings."""
    base = [n.strip() or f"column_{i}" for i, n in enumerate(names, 1)]
    used, out, warnings = set(), [], []
    seen: dict[str, int] = {}
    for n in base:
        seen[n] = seen.get(n, 0) + 1
        name, k = n, max(2, seen[n])
        while name in used or (seen[n] > 1 and name == n):
            name = f"{n}_{k}"
            k += 1
        if name != n:
            warnings.append(f"Repeated header '{n}' was renamed to '{name}'.")
        used.add(name)
        out.append(name)
    return out, warnings


def missing(v: str | None) -> str | None:
    t = v.strip() if v is not None else ""
    return None if t in NULL_TOKENS else t


def parse_delimited(text: str, sep: str | None = None) -> Parsed:
    text = text.removeprefix("﻿")
    sep = sep or sniff(text)
    found = records(text, sep)
    if not found:
        return Parsed([], [], ["There are no rows."])
    names, warnings = header(found[0])
    rows, ragged = [], 0
    for r in found[1:]:
        ragged += len(r) != len(names)
        rows.append([missing(v) for v in (r + [None] * len(names))[: len(names)]])
    if ragged:
        warnings.append(f"{ragged} rows have another number of fields; they were filled up or cut.")
    return Parsed(names, rows, warnings)


def as_text(v: Any) -> str | None:
    if v is None or isinstance(v, str):
        return v
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, float) and v.is_integer() and abs(v) < 1e15:
        return str(int(v))
    return json.dumps(v, ensure_ascii=False) if isinstance(v, (dict, list)) else str(v)


def flatten(obj: dict, prefix: str = "", depth: int = 0) -> dict[str, str | None]:
    """Dotted names for two levels below the record, JSON text beyond; lists are joined."""
    out: dict[str, str | None] = {}
    for k, v in obj.items():
        name = f"{prefix}{k}"
        if isinstance(v, dict) and depth < FLATTEN_DEPTH:
            out |= flatten(v, f"{name}.", depth + 1)
        elif isinstance(v, list):
            out[name] = "; ".join(as_text(x) or "" for x in v)
        else:
            out[name] = as_text(v)
    return out


def parse_json(text: str) -> Parsed:
    warnings: list[str] = []
    try:
        top = json.loads(text)
        if isinstance(top, dict):
            key = next((k for k in RECORD_KEYS if isinstance(top.get(k), list)), None)
            if key:
                warnings.append(f"Records were taken from '{key}'.")
            found = top[key] if key else [top]
        elif isinstance(top, list):
            found = top
        else:
            raise ValueError("neither object nor list")
    except ValueError:
        try:
            found = [json.loads(x) for x in re.split(r"\r?\n", text) if x.strip()]
        except ValueError:
            raise IngestError("The text is neither JSON nor one JSON value a line.") from None
        warnings.append("The text was read as one JSON value a line.")
    flat = [flatten(r) for r in found if isinstance(r, dict)]
    if len(flat) < len(found):
        warnings.append(f"{len(found) - len(flat)} entries are no objects and were left out.")
    names = list(dict.fromkeys(k for r in flat for k in r))
    return Parsed(names, [[None if r.get(k) is None or r[k].strip() in NULL_TOKENS else r[k] for k in names] for r in flat], warnings)


def parse(text: str, hint: str | None = None) -> Parsed:
    """JSON by hint or by its first character, else delimited text."""
    start = text.removeprefix("﻿").lstrip()[:1]
    if hint in ("json", "ndjson") or (hint is None and start in ("[", "{")):
        return parse_json(text.removeprefix("﻿").strip())
    return parse_delimited(text, "\t" if hint == "tsv" else None)


def to_frame(spark: SparkSession, parsed: Parsed) -> DataFrame:
    schema = T.StructType([T.StructField(c, T.StringType()) for c in parsed.columns])
    return spark.createDataFrame(parsed.rows, schema)


# Files


def read_delimited(spark: SparkSession, path: str, sep: str | None = None, encoding: str = "UTF-8", multi_line: bool = False, count_ragged: bool = True) -> tuple[DataFrame, list[str]]:
    """(frame of text columns, warnings) of delimited files of any size.

    The first lines give the separator and the names; Spark splits and parses
    the rest in parallel. ``multi_line`` reads quoted line ends, a file a task.
    ``count_ragged`` takes a pass to warn of rows with other numbers of fields. A
    quote inside a field that does not start with one is a character like any other.
    """
    head = [r["value"] for r in spark.read.text(path).where(F.trim("value") != "").limit(SNIFF_LINES).collect()]
    if not head:
        raise IngestError(f"{path} has no rows")
    head[0] = head[0].removeprefix("﻿")
    sep = sep or sniff("\n".join(head))
    names, warnings = header(records(head[0], sep)[0])
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
    # The schema has the files' width, so short rows are filled with null and long ones cut.
    options = dict(sep=sep, header=True, enforceSchema=True, quote='"', escape='"', multiLine=multi_line, encoding=encoding, mode="PERMISSIVE", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    df = spark.read.schema(schema).csv(path, **options)
    if count_ragged:
        marked = T.StructType([*schema.fields, T.StructField("__ragged", T.StringType())])
        rows = spark.read.schema(marked).csv(path, columnNameOfCorruptRecord="__ragged", **options)
        # All columns are asked for, so that none is pruned before fields are counted.
        n = rows.agg(F.count_if(F.col("__ragged").isNotNull()).alias("n"), F.max(F.hash(*[f"c{i}" for i in range(len(names))]))).first()["n"]
        if n:
            warnings.append(f"{n} rows have another number of fields than the header.")
    return df.select(*[without_null_tokens(F.col(f"c{i}")).alias(n) for i, n in enumerate(names)]), warnings


def flat_columns(df: DataFrame) -> list[Column]:
    """Text columns with dotted names for structs, joined lists, JSON beyond two levels."""
    out: list[Column] = []

    def walk(path: list[str], kind: T.DataType, depth: int) -> None:
        c = F.col(".".join(f"`{p}`" for p in path))
        name = ".".join(path)
        if isinstance(kind, T.StructType) and depth <= FLATTEN_DEPTH:
            for f in kind.fields:
                walk([*path, f.name], f.dataType, depth + 1)
        elif isinstance(kind, T.ArrayType):
            nested = isinstance(kind.elementType, (T.StructType, T.ArrayType, T.MapType))
            part = (lambda x: F.to_json(x)) if nested else (lambda x: x.cast("string"))
            out.append(F.array_join(F.transform(c, part), "; ", "").alias(name))
        elif isinstance(kind, (T.StructType, T.MapType)):
            out.append(F.to_json(c).alias(name))
        else:
            out.append(c.cast("string").alias(name))

    for f in df.schema.fields:
        walk([f.name], f.dataType, 1)
    return out


def read_json(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Text columns of JSON files: one value a line, or whole files."""
    df = spark.read.json(path, multiLine=multi_line, primitivesAsString=True)
    key = next((k for k in RECORD_KEYS if k in df.columns and isinstance(df.schema[k].dataType, T.ArrayType) and isinstance(df.schema[k].dataType.elementType, T.StructType)), None)
    if multi_line and key:
        df = df.select(F.inline(F.col(key)))
    flat = df.select(*flat_columns(df))
    cell = lambda c: flat[f"`{c}`"]
    return flat.select(*[F.when(~F.trim(cell(c)).isin(NULL_TOKENS), cell(c)).alias(c) for c in flat.columns])


def flatten_json(df: DataFrame, column: str, schema: str) -> DataFrame:
    """``df`` with a JSON text column taken apart into dotted text columns."""
    parsed = df.select(*[c for c in df.columns if c != column], F.from_json(F.col(column), schema).alias(column))
    keep = [F.col(f"`{c}`") for c in parsed.columns if c != column]
    return parsed.select(*keep, *flat_columns(parsed.select(column)))
