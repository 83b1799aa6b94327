"""Problem 7: fill containers of fixed capacity with items of varying length.

Method: length-histogram planning. Only the counts by length reach the driver,
at most three rows for each length up to the capacity, however large the corpus.
Best-fit decreasing runs over those counts: whole runs of equal containers are
filled at a time. The plan says, for each length, which container takes the item
of rank r among the items of that length. Items then get their rank (salted, so
that one hot length is never ranked in one task) and look their slot up.

An item over the capacity has to be cut anyway: into pieces of the capacity and a
rest. These are planned after all whole items, rests first, and are cut again
where that fills the gaps left so far; otherwise they get new containers.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from ..session import scratch_table

#: More budgets than this in one call are refused, as the plan is held by the driver.
MAX_BUDGETS = 1000
#: A piece of a cut item is cut again into at most so many parts, none smaller than MIN_PART tokens.
MAX_PARTS = 6
MIN_PART = 16
#: Numbers of a plan that is broadcast (some 160 MB); a plan has about three for each length
#: up to the capacity and each budget, whatever the number of items.
MAX_PLAN = 20_000_000


class _Gaps:
    """Free space by size: residual -> runs (first container, how many)."""

    def __init__(self):
        self.sizes: list[int] = []
        self.runs: dict[int, list[tuple[int, int]]] = {}

    def put(self, residual: int, first: int, many: int) -> None:
        if residual > 0 and many > 0:
            if residual not in self.runs:
                self.runs[residual] = []
                insort(self.sizes, residual)
            self.runs[residual].append((first, many))

    def take(self, at: int) -> tuple[int, int, int]:
        residual = self.sizes[at]
        first, many = self.runs[residual].pop()
        if not self.runs[residual]:
            del self.runs[residual]
            self.sizes.pop(at)
        return residual, first, many


def plan_containers(whole: dict[int, int], rests: dict[int, int], full_pieces: int, capacity: int) -> tuple[list[tuple[int, int, int, list[tuple[int, int, int]]]], int]:
    """Best-fit decreasing over counts.

    ``whole`` and ``rests`` give how many uncuttable items and rests of cut items
    there are of each length, within 1..capacity; ``full_pieces`` how many pieces
    of the capacity. Returns segments (class, length, first rank, parts) and the
    number of containers; the classes are 0, 1, 2 in that order. The items of one class and length with ranks from a segment's first rank on have
    its parts, each (first container, items per container, size): the item n-th in
    the segment puts that part in container first + n // per."""
    segments: list[tuple[int, int, int, list[tuple[int, int, int]]]] = []
    gaps = _Gaps()
    used = 0
    for cls, histogram in ((0, whole), (1, rests), (2, {capacity: full_pieces} if full_pieces else {})):
        for length in sorted(histogram, reverse=True):
            left, rank = histogram[length], 0
            if not 1 <= length <= capacity:
                raise ValueError(f"length {length} is outside 1..{capacity}")
            while left > 0:
                at = bisect_left(gaps.sizes, length)
                if at == len(gaps.sizes):
                    if cls and (parts := _split(gaps, length)):
                        many = min(left, *(m for _, _, m, _ in parts))
                        segments.append((cls, length, rank, [(first, 1, size) for _, first, _, size in parts]))
                        for residual, first, m, size in parts:
                            gaps.put(residual - size, first, many)
                            gaps.put(residual, first + many, m - many)
                        rank += many
                        left -= many
                        continue
                    per = capacity // length
                    residual, first, many = capacity, used, -(-left // per)
                    used += many
                else:
                    residual, first, many = gaps.take(at)
                    per = residual // length
                full = min(many, left // per)
                if full:
                    segments.append((cls, length, rank, [(first, per, length)]))
                    gaps.put(residual - per * length, first, full)
                    rank += full * per
                    left -= full * per
                if full < many and left and left < per:
                    segments.append((cls, length, rank, [(first + full, left, length)]))
                    gaps.put(residual - left * length, first + full, 1)
                    full, left = full + 1, 0
                gaps.put(residual, first + full, many - full)
    return segments, used


def _split(gaps: _Gaps, length: int) -> list[tuple[int, int, int, int]]:
    """Runs of gaps, largest first, that together hold ``length``, as (residual,
    first container, how many, size of the part); they are taken out of ``gaps``.
    Empty, with nothing taken, if MAX_PARTS gaps don't suffice."""
    taken: list[tuple[int, int, int, int]] = []
    left = length
    while left and len(taken) < MAX_PARTS and gaps.sizes:
        at = bisect_left(gaps.sizes, left)
        at = at if at < len(gaps.sizes) else len(gaps.sizes) - 1
        residual, first, many = gaps.take(at)
        size = min(residual, left)
        if 0 < left - size < MIN_PART:
            size -= MIN_PART
        if size < MIN_PART:
            gaps.put(residual, first, many)
            break
        taken.append((residual, first, many, size))
        left -= size
    if left:
        for residual, first, many, _ in taken:
            gaps.put(residual, first, many)
        return []
    return taken


def pack(sizes: DataFrame, budgets: DataFrame, key: str = "doc_id", size: str = "n_tokens") -> DataFrame:
    """(budget_id, container_id, doc_id, start_token, piece_tokens).

    ``sizes`` has one row per item; items of null or zero size need no container
    and give no row. An item over the capacity is cut into pieces that cover it
    without gap or overlap; any other item is one piece. Repeated rows are items
    of their own; a null key is an item like any other. Budgets with null or
    non-positive capacity give no rows, repeated ones count once."""
    spark = sizes.sparkSession
    rows = budgets.select("budget_id", "capacity_tokens").where("capacity_tokens > 0").distinct().limit(MAX_BUDGETS + 1).collect()
    if len(rows) > MAX_BUDGETS:
        raise ValueError(f"more than {MAX_BUDGETS} budgets in one call")
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0], r[1]))
    kind = budgets.schema["budget_id"].dataType
    caps = F.array(*[F.struct(F.lit(i).alias("b"), F.lit(r[0]).cast(kind).alias("budget_id"), F.lit(int(r[1])).cast("bigint").alias("c")) for i, r in enumerate(rows)])
    if not rows:
        return sizes.select(
            F.lit(None).cast(kind).alias("budget_id"), F.lit(0).cast("bigint").alias("container_id"), F.col(key),
            F.lit(0).cast("bigint").alias("start_token"), F.lit(0).cast("bigint").alias("piece_tokens"),
        ).where("false")

    n, c = F.col("n"), F.col("c")
    over = (n > c).cast("int")
    pieces = (
        sizes.select(F.col(key).alias("k"), F.col(size).cast("bigint").alias("n"))
        .where("n > 0")
        .select("k", "n", F.inline(caps))
        .select("k", "n", "b", "budget_id", "c", F.explode(F.expr("sequence(0L, (n - 1) div c)")).alias("piece"))
        .withColumn("len", F.least(c, n - F.col("piece") * c))
        .withColumn("cls", F.when((over == 1) & (F.col("len") == c), 2).otherwise(over))
    )
    counts: dict[int, tuple[dict[int, int], ...]] = {}
    for r in pieces.groupBy("b", "cls", "len").count().collect():  # three rows at most for each length up to the capacity
        counts.setdefault(r["b"], ({}, {}, {}))[r["cls"]][r["len"]] = r["count"]
    plan = _plan_arrays(counts, [int(r[1]) for r in rows])
    size_of_plan = sum(len(x) for x in plan)
    if size_of_plan > MAX_PLAN:
        raise ValueError(f"a plan of {size_of_plan} numbers; use smaller capacities or fewer budgets in a call")
    plan = spark.sparkContext.broadcast(plan)

    salts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("k", "piece"), F.lit(salts)).cast("int"))
    offsets = salted.groupBy("b", "cls", "len", "salt").agg(F.count(F.lit(1)).alias("m"))
    before = Window.partitionBy("b", "cls", "len").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = offsets.select("b", "cls", "len", "salt", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("off"))
    ranked = salted.withColumn("r", F.row_number().over(Window.partitionBy("b", "cls", "len", "salt").orderBy("k", "piece")) - 1)
    ranked = ranked.join(offsets.hint("merge"), ["b", "cls", "len", "salt"]).select(
        F.col("b").cast("bigint"), F.col("cls").cast("bigint"), F.col("len").cast("bigint"), (F.col("off") + F.col("r")).cast("bigint").alias("rank"), (F.col("piece") * c).alias("from"), "k", "budget_id",
    )
    schema = StructType([StructField("k", sizes.schema[key].dataType), StructField("budget_id", kind), *(StructField(x, LongType()) for x in ("container_id", "start_token", "piece_tokens"))])
    arrow = to_arrow_schema(schema)

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, base, starts, ranks, ends, first, per, at, part = plan.value
        for batch in batches:
            b, cls, length, rank, begin = (batch.column(i).to_numpy() for i in range(5))
            group = np.searchsorted(groups, _group_key(b, cls, length))
            # ranks of one group follow those of another, so that one search finds the segment
            seg = np.searchsorted(starts, base[group] + rank, side="right") - 1
            many = ends[seg + 1] - ends[seg]
            row = np.repeat(np.arange(batch.num_rows), many)
            which = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + ends[seg][row]
            nth = (base[group] + rank - starts[seg])[row]
            cols = [batch.column(i).take(pa.array(row)).cast(arrow.field(i - 5).type) for i in (5, 6)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(first[which] + nth // per[which]), pa.array(begin[row] + at[which]), pa.array(part[which])], schema=arrow)

    return ranked.mapInArrow(slots, schema).select("budget_id", "container_id", F.col("k").alias(key), "start_token", "piece_tokens")


def _group_key(b, cls, length):
    """One number for a budget (fewer than MAX_BUDGETS), class and length (below 2**48)."""
    return (b * 3 + cls) * (1 << 48) + length


def _plan_arrays(counts: dict[int, tuple[dict[int, int], ...]], capacities: list[int]) -> tuple[np.ndarray, ...]:
    """The plan of all budgets as arrays: keys of the groups of items (budget, class, length)
    in order and how many items the groups before have; where each segment starts in
    that numbering of items, its first rank; where its parts begin; of each part the
    first container, items a container, its place within the piece, and its size."""
    sizes: dict[int, int] = {}
    found = []
    for b, (whole, rests, fulls) in counts.items():
        for cls, histogram in enumerate((whole, rests, fulls)):
            sizes.update((_group_key(b, cls, n), m) for n, m in histogram.items())
        for cls, length, rank, parts in plan_containers(whole, rests, sum(fulls.values()), capacities[b])[0]:
            found.append((_group_key(b, cls, length), rank, parts))
    groups = sorted(sizes)
    base = np.cumsum([0] + [sizes[g] for g in groups])[: len(groups)].astype(np.int64)
    at = dict(zip(groups, base.tolist(), strict=True))
    found.sort(key=lambda x: (x[0], x[1]))
    parts = [(first, per, sum(q[2] for q in ps[:i]), size) for _, _, ps in found for i, (first, per, size) in enumerate(ps)]
    columns = np.array(parts, np.int64).reshape(-1, 4).T
    return (
        np.array(groups, np.int64), base, np.array([at[g] + r for g, r, _ in found], np.int64), np.array([r for _, r, _ in found], np.int64),
        np.cumsum([0] + [len(ps) for _, _, ps in found]).astype(np.int64), *(np.ascontiguousarray(x) for x in columns),
    )


def pack_documents(docs: DataFrame, budgets: DataFrame, key: str = "doc_id", text: str = "text", **tokenizer) -> DataFrame:
    """``pack`` over the token counts of the texts, which are written once to scratch."""
    from .tokens import count_tokens

    return pack(scratch_table(count_tokens(docs, key, text, "n_tokens", **tokenizer), "sizes"), budgets, key, "n_tokens")
