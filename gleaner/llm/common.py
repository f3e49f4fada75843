"""What several corpus operators share: scratch tables and match spans."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Iterator

import gleaner
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words in the contracts.
SPACES = " \t\n\x0b\x0c\r"
#: Bytes and rows of an Arrow batch between Spark and a worker.
BATCH_BYTES = 4 << 20
BATCH_ROWS = 1000
#: Names that Spark and Arrow give to the same kinds of stores.
SCHEMES = {"s3a": "s3", "s3n": "s3", "wasbs": "abfss", "wasb": "abfs"}
WORD = r"[^\x20\x09-\x0D]+"
#: Spans of a text, with the index of their kind and the match.
SPANS = "array<struct<s:int,k:int,e:int,m:string>>"
#: Elements of a block of prefix sums, and code points of a chunk of text.
SPAN_BLOCK, CHUNK = 32, 512


#: Folders that this thread of the driver has made, oldest first.
_own = threading.local()


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder of the session.

    A machine-local folder is set up only in local mode where the session names
    none; on a cluster, whose executors would each see their own, that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="gleaner-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _own.made = [*made(), path]
    return path


def made() -> list[str]:
    """Folders that this thread made so far and did not remove, oldest first."""
    return list(getattr(_own, "made", []))


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders that ``scratch`` gave, once nothing reads them any more."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        own = jvm.org.apache.hadoop.fs.Path(path)
        own.getFileSystem(conf).delete(own, True)
    _own.made = [p for p in made() if p not in paths]


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again, so that lost
    executors cost at most the stages after this point."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once a session: they
    need not have it installed."""
    context = spark.sparkContext
    if getattr(context, "_gleaner_shipped", False):
        return
    top = os.path.dirname(os.path.abspath(gleaner.__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="gleaner-"), "gleaner.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(top):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.join("gleaner", os.path.relpath(path, top)))
    context.addPyFile(target)
    context._gleaner_shipped = True


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python workers hold (texts can be long).

    The bounds are the same for all operators, so that a plan run later, after
    another operator was called, keeps them."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def tidy(run):
    """``run`` for ``mapInArrow``, after which the worker gives freed memory back: it
    waits for its next task beside a JVM that needs it."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            import ctypes
            import gc

            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
            if trim:
                trim(0)

    return tidied


def slices(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Parts of ``batch`` with about ``most`` bytes of text each, a row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    groups = np.cumsum(sizes) // most
    edges = [0, *(np.flatnonzero(np.diff(groups)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def parts(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """``batches`` put together and taken apart to about ``most`` bytes of text each."""
    held, size = [], 0
    for b in batches:
        for own in slices(b, column, most):
            held.append(own)
            size += own.nbytes
            if size >= most:
                yield _joined(held)
                held, size = [], 0
    if held:
        yield _joined(held)


def _joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """A store that the executors share, with the path in it, by the URI that Spark uses."""
    uri = uri if "://" in uri else "file://" + uri.removeprefix("file:")
    scheme, rest = uri.split("://", 1)
    return pafs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}://{rest}")


def publish(store: pafs.FileSystem, temporary: str, path: str) -> None:
    """Give a whole file its name. Another attempt of a task writes the same bytes, so
    where a store refuses to replace the file, the one that is there stands."""
    try:
        store.move(temporary, path)
    except OSError:
        if store.get_file_info(path).type != pafs.FileType.File:
            raise
        store.delete_file(temporary)


def text_of(df: DataFrame, column: str = "text") -> Column:
    """The text with null as the empty string."""
    return F.coalesce(df[column].cast("string"), F.lit(""))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value taken once, not at every use."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _scan(xs: Column, start: Column, merge) -> Column:
    """Of each int in ``xs``, the merge of ``start`` and all before it. The list
    grows by copies, so this is for short arrays."""
    first = F.struct(start.alias("at"), F.expr("cast(array() as array<int>)").alias("out"))
    return F.aggregate(xs, first, lambda a, x: F.struct(merge(a["at"], x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])


def prefixes(xs: Column, start: int, merge) -> Column:
    """Of each int in ``xs``, the merge of ``start`` and all before it, by blocks:
    totals of blocks first, then inside each, so that work grows by little more
    than the length (SPAN_BLOCK ** 2 elements cost twice their number in blocks)."""
    zero = F.lit(start)

    def by_blocks(own: Column) -> Column:
        last = F.floor((F.size(own) - 1) / SPAN_BLOCK).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(own, i * SPAN_BLOCK + 1, SPAN_BLOCK))
        return let(blocks, lambda bs: F.flatten(F.zip_with(bs, _scan(F.transform(bs, lambda b: F.aggregate(b, zero, merge)), zero, merge), lambda b, z: _scan(b, z, merge))))

    return let(xs, lambda own: F.when(F.size(own) <= SPAN_BLOCK, _scan(own, zero, merge)).otherwise(by_blocks(own)))


def _add(a: Column, x: Column) -> Column:
    return a + x


def find_spans(text: Column, pattern: str, kind: int, keep=None) -> Column:
    """Leftmost non-overlapping matches as array<struct<s,k,e,m>>.

    ``s`` and ``e`` are code point offsets, end exclusive, and ``m`` the match.
    The pieces between matches come from ``split``, so all offsets follow by
    prefix sums over lengths, and work grows with the length of the text however
    many matches it has. ``keep`` tests a match; what it refuses is left out
    without another try inside the match.
    """
    size = lambda c: F.coalesce(F.char_length(c), F.lit(0))
    # One gap more than matches: the last has a null match and goes below.
    pairs = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda g, h: F.struct(size(g).alias("g"), size(h).alias("n"), h.alias("m")))

    def placed(own: Column) -> Column:
        at = prefixes(F.transform(own, lambda x: x["g"] + x["n"]), 0, _add)
        spans = F.zip_with(own, at, lambda x, o: F.struct((o + x["g"]).alias("s"), F.lit(kind).alias("k"), (o + x["g"] + x["n"]).alias("e"), x["m"].alias("m")))
        return F.filter(spans, (lambda y: y["m"].isNotNull()) if keep is None else (lambda y: F.when(y["m"].isNotNull(), keep(y["m"])).otherwise(F.lit(False))))

    return F.when(text.rlike(pattern), let(pairs, placed)).otherwise(F.expr(f"cast(array() as {SPANS})"))


def apart(base: Column, more: Column) -> Column:
    """The spans of ``more`` that touch no span of ``base``, sorted. Both are merged by
    their starts; running bounds of the base spans before and after decide each."""
    far = (1 << 31) - 1
    own_of = lambda x, kind, i: F.struct(x["s"].cast("int").alias("s"), F.lit(kind).alias("own"), x["e"].cast("int").alias("e"), i.cast("int").alias("i"))

    def decided(own: Column, given: Column) -> Column:
        before = prefixes(F.transform(own, lambda y: F.when(y["own"] == 0, y["e"]).otherwise(0)), 0, lambda a, x: F.greatest(a, x))
        after = F.reverse(prefixes(F.reverse(F.transform(own, lambda y: F.when(y["own"] == 0, y["s"]).otherwise(far))), far, lambda a, x: F.least(a, x)))
        rated = F.zip_with(F.zip_with(own, before, lambda y, b: F.struct(y.alias("y"), b.alias("b"))), after, lambda z, a: F.struct(z["y"]["i"].alias("i"), ((z["y"]["own"] == 1) & (z["b"] <= z["y"]["s"]) & (a >= z["y"]["e"])).alias("ok")))
        return F.transform(F.filter(rated, lambda r: r["ok"]), lambda r: F.get(given, r["i"]))

    def merged(given: Column) -> Column:
        both = F.concat(F.transform(base, lambda x: own_of(x, 0, F.lit(-1))), F.transform(given, lambda x, i: own_of(x, 1, i)))
        return let(F.array_sort(both), lambda own: decided(own, given))

    return F.when((F.size(base) == 0) | (F.size(more) == 0), F.array_sort(more)).otherwise(let(more, merged))


def join_spans(spans: Column, kinds: list[str]) -> Column:
    """``kind:start:end`` by start, then kind as listed, comma-joined."""
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(
        F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ","
    )


def chunks(text: Column) -> Column:
    """``text`` in pieces of CHUNK code points, for ``piece``."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def piece(parts: Column, a: Column, b: Column) -> Column:
    """Code points ``a`` to ``b`` of the text that ``parts`` are the chunks of; only
    the chunks that it touches are read."""
    first, last = F.floor(a / CHUNK).cast("int"), F.floor((b - 1) / CHUNK).cast("int")
    head = F.substring(F.get(parts, first), a - first * CHUNK + 1, F.least(b - a, F.lit(CHUNK)))
    rest = F.concat(head, F.array_join(F.slice(parts, first + 2, F.greatest(last - first - 1, F.lit(0))), ""), F.substring(F.get(parts, last), F.lit(1), b - last * CHUNK))
    return F.when(b <= a, F.lit("")).when(first == last, head).otherwise(rest)


def rebuild(text: Column, spans: Column, fill) -> Column:
    """``text`` with ``fill(span, covered)`` in place of each of the sorted ``spans``;
    ``covered`` is the end of what earlier spans replace. Linear in the text."""

    def built(parts: Column, own: Column, n: Column) -> Column:
        ends = prefixes(F.transform(own, lambda x: x["e"]), 0, lambda a, x: F.greatest(a, x))
        out = F.zip_with(own, ends, lambda x, at: F.concat(piece(parts, at, x["s"]), fill(x, at)))
        return F.concat(F.array_join(out, ""), piece(parts, F.array_max(F.transform(own, lambda x: x["e"])), n))

    whole = F.struct(chunks(text).alias("parts"), spans.alias("own"), F.char_length(text).alias("n"))
    return F.when(F.size(spans) == 0, text).otherwise(let(whole, lambda w: built(w["parts"], w["own"], w["n"])))


def replace_spans(text: Column, spans: Column, mark) -> Column:
    """``text`` with each span of the sorted ``spans`` replaced by ``mark(span)``;
    spans that overlap an earlier one go with it."""
    return rebuild(text, spans, lambda x, at: F.when(x["s"] >= at, mark(x)).otherwise(F.lit("")))


def blank_spans(text: Column, spans: Column) -> Column:
    """``text`` with blanks, as many, in place of the sorted ``spans``."""
    return rebuild(text, spans, lambda x, at: F.repeat(F.lit(" "), F.greatest(x["e"] - F.greatest(at, x["s"]), F.lit(0))))
