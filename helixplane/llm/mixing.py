"""Mixing sources to target weights by Pfair scheduling.

A source's documents form blocks of BLOCK. Block j of a source with weight w (its share of all weights)
is released at slot floor(j / w) and due before slot ceil((j + 1) / w), in whole numbers without
rounding; in each slot the released block with the earliest deadline runs. As the weights sum to 1,
every deadline is met, so after any number of slots of a phase each source is less than one block from
its share. When a source has no blocks left, the weights of the others are scaled to sum to 1, and a
new schedule, the next phase, begins there.

Documents of a source are dealt into blocks in the order of a hash of their id: counted in ranges of
that hash first, so no task ranks a whole source. Every row gets one place; nothing is dropped or
repeated. A null source is a source of its own. Sources without a target weight, or with weight 0 or
less, follow when all others are through, in the order of their names. Rows with a null doc_id, and
rows that repeat, get a place each (equal rows in any order). An empty table gives an empty one; other
columns are carried. The driver works out the schedule block by block and holds a number for each
block and a row for each source; so that this has a bound, blocks are larger than asked for where there
would be more than MOST_BLOCKS of them, by the same rule for all sources.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Mapping
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

BLOCK = 32
#: Rows in a range of hash values of a source; blocks of a source in a row of the plan; most sources whose plan is broadcast, and most blocks.
RANGE_ROWS, PIECE, MOST_SOURCES, MOST_BLOCKS = 1000, 1024, 2000, 2_000_000


def whole_weights(weights: Mapping[int, float], slots: int) -> dict[int, int]:
    """Slots of each source by largest remainders, 1 at least."""
    slots = max(slots, len(weights))
    total = math.fsum(weights.values())
    exact = {k: w / total * slots for k, w in weights.items()}
    out = {k: max(1, math.floor(x)) for k, x in exact.items()}
    by_rest = sorted(exact, key=lambda k: (out[k] - exact[k], k))
    while (left := slots - sum(out.values())) != 0:
        if left > 0:
            for k in by_rest[:left]:
                out[k] += 1
        else:
            k = max((k for k in out if out[k] > 1), key=lambda k: (out[k] - exact[k], k))
            out[k] -= 1
    return out


def exact_weights(weights: Mapping[int, float]) -> dict[int, int]:
    """Whole numbers in the proportions of the weights, without rounding."""
    exact = {k: Fraction(w) for k, w in weights.items()}
    scale = math.lcm(*(x.denominator for x in exact.values()))
    out = {k: int(x * scale) for k, x in exact.items()}
    shared = math.gcd(*out.values())
    return {k: x // shared for k, x in out.items()}


def period(weights: Mapping[int, int], left: Mapping[int, int] | None = None) -> dict[int, np.ndarray]:
    """Each source's slots by earliest deadline first, ties to the heavier, then the smaller key: one period, or until a source has run all its blocks that are left."""
    n = sum(weights.values())
    # a source's next block only; the one after it is due later and can't run before
    ready = [(-(-n // w), -w, k) for k, w in weights.items()]
    heapq.heapify(ready)
    later: list[tuple] = []
    out: dict[int, list[int]] = {k: [] for k in weights}
    t = 0
    while left is not None or t < n:
        while later and later[0][0] <= t:
            heapq.heappush(ready, heapq.heappop(later)[1])
        due, _, k = heapq.heappop(ready)
        if due <= t:
            raise AssertionError("a deadline was missed")
        out[k].append(t)
        t += 1
        j, w = len(out[k]), weights[k]
        if left is not None and j == left[k]:
            break
        release, job = j * n // w, (-(-(j + 1) * n // w), -w, k)
        if release <= t:
            heapq.heappush(ready, job)
        else:
            heapq.heappush(later, (release, job))
    return {k: np.array(v, np.int64) for k, v in out.items()}


def phases(blocks: Mapping[int, int], weights: Mapping[int, float], resolution: int | None = None) -> list[tuple]:
    """(source, first block, first slot, slots, the source's slots among them) of each phase in which it runs; sources without weight follow one by one."""
    left = {k: n for k, n in blocks.items() if n > 0}
    done, slot, out = dict.fromkeys(left, 0), 0, []
    while True:
        live = {k: weights[k] for k in left if weights.get(k, 0) > 0}
        if not live:
            break
        plan = period(exact_weights(live) if resolution is None else whole_weights(live, resolution), left)
        n = sum(map(len, plan.values()))
        for k, p in plan.items():
            if len(p):
                out.append((k, done[k], slot, n, p))
            done[k] += len(p)
            left[k] -= len(p)
        left = {k: x for k, x in left.items() if x > 0}
        slot += n
    for k in sorted(left):
        out.append((k, 0, slot, left[k], np.arange(left[k])))
        slot += left[k]
    return out


def pieces(plan: list[tuple], names: Mapping[int, str]) -> pa.Table:
    """(s, piece, slots): the slots of every PIECE blocks of each source."""
    whole: dict[int, list[np.ndarray]] = {}
    for k, _, first, _, own in plan:
        whole.setdefault(k, []).append(first + own)
    rows = [(names[k], j // PIECE, x[j : j + PIECE]) for k, parts in whole.items() for x in [np.concatenate(parts)] for j in range(0, len(x), PIECE)]
    return pa.table([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.int64()))], ["s", "piece", "slots"])


def mix(docs: DataFrame, weights: Mapping[str | None, float] | None = None, block: int = BLOCK, resolution: int | None = None) -> DataFrame:
    """doc_id, source, block (of the source), slot (of the block in the mix), place (of the document in its block), and carried, the other columns as a struct.

    weights: of sources, to any sum; if None, the square root of each source's number of documents, which
    lifts small sources and holds back large ones. resolution: rounds the weights to so many slots a
    period, 1 at least for a source; None takes them as they are.
    """
    spark = docs.sparkSession
    others = [c for c in docs.columns if c not in ("doc_id", "source")]
    carried = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.lit(0)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), carried.alias("carried"))
    key = F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(-1)), F.lit(11)), 1)
    n = rows.count()
    block = max(block, math.ceil(n / MOST_BLOCKS))
    ranges = max(1, math.ceil(n / RANGE_ROWS))
    # equality of names that hold for null too, so the window's partitioning serves the join
    rows = rows.withColumn("name", F.concat(F.when(F.col("source").isNull(), "n").otherwise("s"), F.coalesce("source", F.lit(""))))
    keyed = rows.withColumn("key", key).withColumn("range", F.floor(F.shiftright("key", 32).cast("double") / 2**31 * ranges).cast("int"))
    counts = materialise(keyed.groupBy("name", "range").agg(F.first("source").alias("source"), F.count(F.lit(1)).alias("n")), "counts")
    total = counts.groupBy("name").agg(F.first("source").alias("source"), F.sum("n").alias("n")).orderBy("name").collect()  # a row for each source
    number = {r.source: k for k, r in enumerate(total)}
    sizes = {number[r.source]: -(-r.n // block) for r in total}
    share = {number[s]: w for s, w in weights.items() if s in number} if weights is not None else {number[r.source]: math.sqrt(r.n) for r in total}
    plan = spark.createDataFrame(pieces(phases(sizes, share, resolution), {k: r["name"] for k, r in enumerate(total)}))
    before = Window.partitionBy("name").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("name", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("name", "range").orderBy("key", "doc_id")
    placed = keyed.withColumn("rank", F.row_number().over(inside) - 1).join(offsets, ["name", "range"])
    at = F.col("before") + F.col("rank")
    placed = placed.select("doc_id", "source", "name", "carried", F.floor(at / block).alias("block"), F.pmod(at, F.lit(block)).cast("int").alias("place"))
    plan = F.broadcast(plan) if len(total) <= MOST_SOURCES else plan
    out = placed.join(plan, (F.col("name") == F.col("s")) & (F.floor(F.col("block") / PIECE) == F.col("piece")))
    slot = F.element_at("slots", (F.pmod(F.col("block"), F.lit(PIECE)) + 1).cast("int"))
    return out.select("doc_id", "source", "block", slot.cast("long").alias("slot"), "place", "carried")
