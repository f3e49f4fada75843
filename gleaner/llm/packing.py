"""Best-fit packing into sequences of several permitted lengths.

Documents longer than the largest capacity are cut into full sequences and a
rest. Packing then needs only how many pieces have each length, and there are
no more lengths than the largest capacity: the plan is made on this histogram, by
best-fit decreasing over groups of like bins, and is exact for all pieces. The
permitted lengths are chosen jointly: the plan is priced for every set of them
that bins may be opened with, and the cheapest stands. A piece finds its bin by its rank among the pieces of its length,
from prefix counts; no task gathers the pieces of one length.
"""

from __future__ import annotations

import itertools
from bisect import bisect_left, insort
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleaner.llm.common import WORD, cut

CAPACITIES = (512, 1024, 2048, 4096)
#: Cost of a bin beside its tokens: what one more sequence costs, in tokens.
BIN_COST = 16
#: Rows of the plan that may be broadcast, some 50 bytes each.
MOST_BROADCAST = 500_000
#: Equal steps that the pieces of one length are cut into.
RANK_STEPS = 16


@dataclass(frozen=True)
class Slots:
    """``bins`` following bins from ``first`` take ``each`` pieces of ``length``
    apiece, at ``offset``; the pieces have the ranks from ``rank`` on."""

    length: int
    rank: int
    count: int
    each: int
    first: int
    offset: int


def bin_cost(capacity: int) -> int:
    return capacity + BIN_COST


def best_capacity(length: int, count: int, capacities: tuple[int, ...]) -> int:
    """The bin size of least cost for each token that ``count`` pieces fill."""

    def per_token(c: int) -> float:
        n = min(c // length, count)
        return bin_cost(smallest(n * length, capacities) if n == count else c) / (n * length)

    return min((c for c in capacities if c >= length), key=lambda c: (per_token(c), -c))


def smallest(content: int, capacities: tuple[int, ...]) -> int:
    return next(c for c in capacities if c >= content)


def plan(histogram: dict[int, int], capacities: tuple[int, ...] = CAPACITIES, opened: tuple[int, ...] | None = None) -> tuple[list[Slots], list[tuple[int, int, int, int]]]:
    """Slots of all pieces, and runs of like bins: (first bin, bins, content, capacity).

    Lengths go from the largest down. A piece goes to the open bin with the
    least room that still holds it, so a bin takes all it can of one length
    before the next bin does; like bins move together. Where no open bin fits,
    the bin size of least cost among ``opened`` (else all) is opened. At the end
    each bin is downsized to the smallest capacity that holds its contents.
    """
    capacities = tuple(sorted(capacities))
    opened = opened or capacities
    room: dict[int, list[tuple[int, int, int]]] = {}  # room left -> runs (first bin, bins, content)
    rooms: list[int] = []  # keys of ``room``, ascending
    slots: list[Slots] = []
    bins = 0

    def put(left: int, run: tuple[int, int, int]) -> None:
        if left not in room:
            room[left] = []
            insort(rooms, left)
        room[left].append(run)

    for length in sorted((x for x, n in histogram.items() if n > 0), reverse=True):
        if not 0 < length <= opened[-1]:
            raise ValueError(f"no bin holds a piece of length {length}")
        rank, todo = 0, histogram[length]

        def fill(left: int, first: int, n: int, content: int, length: int = length) -> None:
            """Put pieces into ``n`` like bins, as many as fit and are left."""
            nonlocal rank, todo
            each = left // length
            for k, per in ((min(n, todo // each), each), (1, todo % each if todo // each < n else 0)):
                if k and per:
                    slots.append(Slots(length, rank, k * per, per, first, content))
                    put(left - per * length, (first, k, content + per * length))
                    rank, todo, first, n = rank + k * per, todo - k * per, first + k, n - k
            if n:
                put(left, (first, n, content))

        while todo and (at := bisect_left(rooms, length)) < len(rooms):
            left = rooms.pop(at)
            # All runs with this room are tried before what they leave, which is smaller than ``length``.
            for first, n, content in room.pop(left):
                if todo:
                    fill(left, first, n, content)
                else:
                    put(left, (first, n, content))
        while todo:
            c = best_capacity(length, todo, opened)
            n = max(1, todo // (c // length))
            first, bins = bins, bins + n
            fill(c, first, n, 0)
    runs = [(first, n, content, smallest(content, capacities)) for left in room for first, n, content in room[left]]
    return slots, sorted(runs)


def cost(runs: list[tuple[int, int, int, int]]) -> int:
    return sum(n * bin_cost(capacity) for _, n, _, capacity in runs)


def best_plan(histogram: dict[int, int], capacities: tuple[int, ...] = CAPACITIES) -> tuple[list[Slots], list[tuple[int, int, int, int]]]:
    """The cheapest plan over all sets of permitted lengths that may be opened, the
    largest always among them: what a length costs depends on how it fills up with
    pieces that come later, which only the whole plan shows. No set of one fixed
    length is cheaper. Histograms are small, so all sets are tried."""
    *others, top = sorted(set(capacities))
    sets = [(*few, top) for k in range(len(others), -1, -1) for few in itertools.combinations(others, k)]
    return min((plan(histogram, capacities, own) for own in sets), key=lambda p: cost(p[1]))


def pack(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, length: str | None = None, partitions: int | None = None, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """(doc_id, piece, piece_start, n_tokens, bin_id, bin_offset, bin_capacity).

    One row for each piece of each row of ``docs``. The length is the column
    ``length`` if named (null or negative: 0), else the white-space words of
    ``text`` plus one for the end mark. A length of 0 takes no room: such rows
    have one piece without bin. Texts longer than the largest capacity, however
    long, are cut into full sequences and a rest. Bins are numbered from 0, each
    holds at most its capacity, and pieces in a bin do not overlap. Repeated rows
    are pieces of their own; null doc_ids are kept. An empty table gives no rows;
    other columns are not read.
    """
    spark = docs.sparkSession
    top = max(capacities)
    n = F.greatest(F.coalesce(docs[length].cast("long"), F.lit(0)), F.lit(0)) if length else (F.regexp_count(F.coalesce(docs["text"].cast("string"), F.lit("")), F.lit(WORD)) + 1).cast("long")
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    lengths = cut(docs.select(docs["doc_id"].cast("long").alias("doc_id"), n.alias("size")), "pack-lengths")  # taken once; the exchange below reads its input twice
    sized = cut(lengths.repartitionByRange(parts, "doc_id", "size").withColumn("part", F.spark_partition_id()), "pack-sizes")
    full = F.floor(F.col("size") / top).cast("long")
    rest = (F.col("size") % top).cast("int")
    # Full sequences need no plan: they are counted for each part and numbered by prefix sums.
    per_part = cut(sized.groupBy("part", rest.alias("length")).agg(F.count(F.lit(1)).alias("n"), F.sum(full).alias("full")), "pack-histogram")
    histogram = {r["length"]: r["n"] for r in per_part.where("length > 0").groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `top` rows
    slots, runs = best_plan(histogram, capacities)
    planned = max((first + k for first, k, _, _ in runs), default=0)
    # The ranks of a length are cut into RANK_STEPS equal steps, so that a piece meets its slot by an equal key of few rows.
    steps = {x: -(-k // RANK_STEPS) for x, k in histogram.items()}
    slot_list = [(s.length, b, s.rank, s.rank + s.count, s.each, s.first, s.offset) for s in slots for b in range(s.rank // steps[s.length], (s.rank + s.count - 1) // steps[s.length] + 1)]
    slot_rows = spark.createDataFrame(slot_list, "length int, step long, rank_from long, rank_to long, each long, first long, at long")
    run_rows = spark.createDataFrame([(first, first + k, c) for first, k, _, c in runs], "bin_from long, bin_to long, capacity int")
    # Ranks: pieces of the length in earlier parts, then in this part.
    earlier = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    by_part = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row for each part
    fulls = per_part.groupBy("part").agg(F.sum("full").alias("f")).select("part", F.coalesce(F.sum("f").over(by_part), F.lit(0)).alias("full_before"))
    step = F.ceil(F.sum("n").over(W.partitionBy("length")) / RANK_STEPS)
    ranks = per_part.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("rank_before"), step.alias("step_size"))
    inside = W.partitionBy("part").orderBy("doc_id", "size")
    rows = sized.select(
        "*", rest.alias("length"), full.alias("full"),
        (F.row_number().over(W.partitionBy("part", rest).orderBy("doc_id", "size")) - 1).alias("local"),
        F.coalesce(F.sum(full).over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("full_local"),
    )
    rows = rows.join(ranks, ["part", "length"]).join(F.broadcast(fulls), "part")
    rows = rows.withColumns({"rank": F.col("rank_before") + F.col("local"), "first_full": F.lit(planned) + F.col("full_before") + F.col("full_local")})
    rows = rows.withColumn("step", F.floor(F.col("rank") / F.col("step_size")))
    own_slot = (rows["length"] == slot_rows["length"]) & (rows["step"] == slot_rows["step"]) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to"))
    rows = rows.join(_small(slot_rows, len(slot_list), most_broadcast), own_slot, "left").drop(slot_rows["length"])
    j = F.col("rank") - F.col("rank_from")
    rest_piece = F.struct(
        F.col("full").alias("piece"), (F.col("full") * top).alias("piece_start"), F.col("length").alias("n_tokens"),
        (F.col("first") + F.floor(j / F.col("each"))).alias("bin_id"), (F.col("at") + (j % F.col("each")) * F.col("length")).alias("bin_offset"),
    )
    full_piece = lambda i: F.struct(
        i.alias("piece"), (i * top).alias("piece_start"), F.lit(top).alias("n_tokens"), (F.col("first_full") + i).alias("bin_id"), F.lit(0).cast("long").alias("bin_offset"),
    )
    zero = F.lit(0).cast("long")
    fulls_of = F.when(F.col("full") > 0, F.transform(F.sequence(zero, F.greatest(F.col("full") - 1, zero)), full_piece))
    none = F.expr("cast(array() as array<struct<piece:bigint,piece_start:bigint,n_tokens:int,bin_id:bigint,bin_offset:bigint>>)")
    pieces = F.concat(F.coalesce(fulls_of, none), F.when((F.col("length") > 0) | (F.col("full") == 0), F.array(rest_piece)).otherwise(none))
    out = rows.select("doc_id", F.explode(pieces).alias("p")).select("doc_id", "p.*")
    return _with_capacity(out, run_rows, len(runs), planned, top, most_broadcast)


def _small(plan_rows: DataFrame, n: int, most: int) -> DataFrame:
    """The plan's size follows the capacities, not the rows; beyond this check
    Spark picks another join, by keys of few rows each."""
    return F.broadcast(plan_rows) if n <= most else plan_rows


def _with_capacity(pieces: DataFrame, runs: DataFrame, n: int, planned: int, top: int, most: int) -> DataFrame:
    """Capacities by bin: runs are cut at equal steps so that a step and the few
    runs that touch it meet by an equal key."""
    step = max(1, planned // 4096)
    keyed = runs.select("*", F.explode(F.sequence(F.floor(F.col("bin_from") / step), F.floor((F.col("bin_to") - 1) / step))).alias("step"))
    own = pieces.withColumn("step", F.when(F.col("bin_id") < planned, F.floor(F.col("bin_id") / step)))
    joined = own.join(_small(keyed, n + 4096, most), (own["step"] == keyed["step"]) & (F.col("bin_id") >= F.col("bin_from")) & (F.col("bin_id") < F.col("bin_to")), "left")
    capacity = F.when(F.col("bin_id") >= planned, F.lit(top)).otherwise(F.col("capacity"))
    return joined.select("doc_id", "piece", "piece_start", "n_tokens", "bin_id", "bin_offset", capacity.alias("bin_capacity"))
