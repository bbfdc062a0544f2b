"""Mixing sources to target weights by Pfair scheduling of source blocks.

Each source's documents are cut into blocks of ``block`` documents, in the order of a hash
of doc_id.  Block k of a source of weight w is released at slot ``floor(k / w)`` and due
by ``ceil((k + 1) / w)``; each slot takes the released block of the earliest deadline
(ties: larger weight, then name), which keeps every source within one block of its share
at every slot.  Weights are exact: floats are ratios of integers, and releases and
deadlines are computed in integers.  Each slot depends on the one before, so one task deals
the slots and streams a row a block; it holds a few numbers a source, never the blocks, and
its time grows with the blocks.  Blocks find their slots by a join.

Every document is kept.  When a source has no block left, the phase ends and the other
sources go on with their weights scaled up, so n sources make at most n phases, each of
which starts anew with the sources left: time also grows with the square of n.  A source's
last block may be short.

A null source is a source of its own, named as ''.  A null doc_id sorts first.  Repeated
rows are scheduled as rows.  Empty tables give empty results.  Extra columns are carried.
Ranks within a source are counts over hash ranges plus a rank inside a range: a source
with a third of all rows is dealt over as many tasks as the table needs.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from fractions import Fraction
from itertools import islice
from math import ceil, lcm, sqrt

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hostwatch.llm.common import fresh, table, written

PARTS, BLOCK, RANGE_ROWS, BATCH, BROADCAST_SOURCES = 1000, 16, 2000, 10_000, 100_000


def whole_parts(weights: dict[str, float], parts: int = PARTS) -> dict[str, int]:
    """Weights as whole parts of ``parts``, at least 1 each, by largest remainders; not for
    ``mix``, which takes exact_parts."""
    if not weights:
        return {}
    if len(weights) > parts or min(weights.values()) <= 0:
        raise ValueError("weights must be positive, and as many as there are parts at most")
    total, free = sum(weights.values()), parts - len(weights)
    share = {s: free * w / total for s, w in weights.items()}
    out = {s: 1 + int(x) for s, x in share.items()}
    for s in sorted(share, key=lambda s: (int(share[s]) - share[s], s))[: parts - sum(out.values())]:
        out[s] += 1
    return out


def exact_parts(weights: dict[str, float]) -> dict[str, int]:
    """Weights as integers in the very same ratios."""
    if any(w <= 0 for w in weights.values()):
        raise ValueError("weights must be positive")
    ratios = {s: Fraction(w) for s, w in weights.items()}
    unit = lcm(*(r.denominator for r in ratios.values()))
    return {s: int(r * unit) for s, r in ratios.items()}


def dealt(parts: dict[str, int]) -> Iterator[tuple[str, int]]:
    """``(source, k)`` slot by slot: earliest deadline first among released blocks."""
    n, slot = sum(parts.values()), 0
    release = [(0, s, 0) for s in parts]
    heapq.heapify(release)
    ready: list = []
    while True:
        while release and release[0][0] <= slot:
            _, s, k = heapq.heappop(release)
            heapq.heappush(ready, (-(-(k + 1) * n // parts[s]), -parts[s], s, k))
        _, _, s, k = heapq.heappop(ready)
        yield s, k
        heapq.heappush(release, ((k + 1) * n // parts[s], s, k + 1))
        slot += 1


def period(parts: dict[str, int]) -> list[tuple[str, int, int]]:
    """``(source, k, slot)`` of the first ``sum(parts)`` slots, after which all repeats."""
    return [(s, k, slot) for slot, (s, k) in enumerate(islice(dealt(parts), sum(parts.values())))]


def schedule(blocks: dict[str, int], parts: dict[str, int]) -> Iterator[tuple[str, int, int, int]]:
    """``(source, block, phase, slot)`` of all blocks.  A phase ends with the first source
    that has none left, so there is no empty slot."""
    left, used, slot, phase = {s: n for s, n in blocks.items() if n > 0}, dict.fromkeys(blocks, 0), 0, 0
    while left:
        for s, _ in dealt({s: parts[s] for s in left}):
            yield s, used[s], phase, slot
            slot += 1
            used[s] += 1
            left[s] -= 1
            if not left[s]:
                del left[s]
                break
        phase += 1


def _scheduled(block: int, weights: dict[str, float] | None):
    """Rows ``(s, n)`` of all sources, in one task, to ``(s, b, phase, slot)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = {s: n for b in batches for s, n in zip(b.column("s").to_pylist(), b.column("n").to_pylist())}
        if weights is not None and (missing := sizes.keys() - weights.keys()):
            raise ValueError(f"sources without a weight: {sorted(missing)[:5]}")
        target = {s: sqrt(n) if weights is None else weights[s] for s, n in sizes.items()}
        rows = schedule({s: ceil(n / block) for s, n in sizes.items()}, exact_parts(target))
        while part := list(islice(rows, BATCH)):
            kinds = pa.string(), pa.int64(), pa.int32(), pa.int64()
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part), kinds)], ["s", "b", "phase", "slot"])

    return run


def source_sizes(docs: DataFrame) -> DataFrame:
    """``(s, n)``: documents of each source, written."""
    return written(docs.groupBy(F.coalesce("source", F.lit("")).alias("s")).agg(F.count("*").alias("n")), "mixing-sizes")


def ranked(docs: DataFrame, sizes: DataFrame, source: str, rank: str) -> DataFrame:
    """``docs`` with their source (not null) and 0-based rank in the order of a hash of
    doc_id, as columns of the given names."""
    order, n, part, count, before = fresh(docs, "order", "n", "range", "count", "before")
    keyed = docs.withColumns({source: F.coalesce("source", F.lit("")), order: F.xxhash64("doc_id")})
    sizes = F.broadcast(sizes.toDF(source, n)) if sizes.count() <= BROADCAST_SOURCES else sizes.toDF(source, n)
    # Ranges of the hash, as many as leave about RANGE_ROWS rows each; hashes are even.
    ranges = F.ceil(F.col(n) / RANGE_ROWS)
    keyed = keyed.join(sizes, source).withColumn(part, F.floor((F.shiftrightunsigned(order, 33)) * ranges / F.lit(float(1 << 31))).cast("long")).drop(n)
    counts = keyed.groupBy(source, part).agg(F.count("*").alias(count))
    earlier = Window.partitionBy(source).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn(before, F.coalesce(F.sum(count).over(earlier), F.lit(0))).drop(count)
    others = [F.col(c) for c in docs.columns if c not in ("doc_id", "source")]
    inside = Window.partitionBy(source, part).orderBy(F.shiftrightunsigned(order, 33), order, "doc_id", F.xxhash64(*others) if others else F.lit(0))
    return keyed.join(counts, [source, part]).withColumn(rank, F.col(before) + F.row_number().over(inside) - 1).drop(before, part, order)


def mix(docs: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK) -> DataFrame:
    """``docs`` with ``phase``, ``slot`` (long) and ``place`` (in the block), which replace
    columns of these names.

    weights: by source, positive; a source without one is an error.  None: the square root
    of each source's number of documents.  Sort by (slot, place) for the mixture's order.
    """
    docs = docs.drop("phase", "slot", "place")
    source, rank, s, b = fresh(docs, "of", "rank", "s", "b")
    sizes = source_sizes(docs)
    slots = written(sizes.repartition(1).mapInArrow(_scheduled(block, weights), "s string, b long, phase int, slot long"), "mixing-slots")
    blocks = ranked(docs, sizes, source, rank)
    at = blocks.join(slots.withColumnsRenamed({"s": s, "b": b}), (F.col(source) == F.col(s)) & (F.floor(F.col(rank) / block) == F.col(b)))
    return at.select(*docs.columns, "phase", "slot", (F.col(rank) % block).cast("int").alias("place"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "source"))


SQL: dict[str, str] = {}
