"""Mixing sources to target weights by Pfair scheduling of document blocks."""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.common import stored

#: A schedule repeats after as many slots as its weights need, but after no more than so many.
MAX_PERIOD = 100_000
#: Documents in a block, and documents in the pieces in which a source is numbered.
BLOCK, PIECE = 16, 4_096
#: Sources that have a weight of their own at most; more are an error.
MAX_SOURCES = 500
RESULTS = ("source_rank", "block", "slot", "mix_order")


def exact(weight: float) -> Fraction:
    """The fraction of least denominator that is the same double; 0.9 / 19 is 9/190."""
    whole = Fraction(weight)
    for digits in range(1, 16):
        near = whole.limit_denominator(10**digits)
        if float(near) == weight:
            return near
    return whole


def shares(weights: dict[str | None, Fraction | float], limit: int = MAX_PERIOD) -> dict[str | None, int]:
    """Slots of each source in a period; as proportions they are exactly the weights where their period is within the limit.

    Other weights are rounded to `limit` shares in all, one at least, largest remainders first: then a source drifts from
    its weight by half a slot in a period at most.
    """
    given = {k: w if isinstance(w, Fraction) else exact(w) for k, w in weights.items()}
    scale = sum(given.values())
    parts = {k: w / scale for k, w in given.items()}
    period = math.lcm(*(p.denominator for p in parts.values()))
    if period <= limit:
        return {k: int(p * period) for k, p in parts.items()}
    out = {k: max(1, math.floor(p * limit)) for k, p in parts.items()}
    left = limit - sum(out.values())
    order = sorted(parts, key=lambda k: (out[k] - parts[k] * limit, str(k)))
    while left > 0:
        out[order.pop(0)] += 1
        left -= 1
    while left < 0:  # sources that were raised to one share
        k = max(out, key=lambda k: (out[k] - parts[k] * limit if out[k] > 1 else -math.inf, str(k)))
        out[k] -= 1
        left += 1
    return out


def pfair(share: dict[str | None, int]) -> list[str | None]:
    """The source of each slot of one period.

    Block j (from 0) of a source of weight w is released at floor(j / w) and due by ceil((j + 1) / w); each slot takes
    the released block that is due first. Weights sum to one, so every block is in time, and after any number t of slots
    a source has had more than w t - 1 and fewer than w t + 1 blocks. A period is as many slots as there are shares.
    """
    total = sum(share.values())
    waiting = [(0, -(-total // a), str(k), k, 0) for k, a in share.items()]
    heapq.heapify(waiting)
    ready: list = []
    slots = []
    for t in range(total):
        while waiting and waiting[0][0] <= t:
            _, due, name, k, j = heapq.heappop(waiting)
            heapq.heappush(ready, (due, name, k, j))
        due, name, k, j = heapq.heappop(ready)
        slots.append(k)
        if due <= t or j + 1 > share[k]:
            raise AssertionError("a block missed its deadline")
        heapq.heappush(waiting, ((j + 1) * total // share[k], -(-(j + 2) * total // share[k]), name, k, j + 1))
    return slots


def plan(blocks: dict[str | None, int], weights: dict[str | None, Fraction]) -> list[tuple]:
    """Rows (source, first block, slot of the phase, blocks a period, slots a period, places in the period).

    weights: fractions. They hold until a source has no block left for its next slot; from then on the others share its part in
    proportion to their weights, in a schedule of their own (a phase), until all blocks have a slot.
    """
    left = {k: n for k, n in blocks.items() if n > 0}
    done = dict.fromkeys(left, 0)
    rows, slot = [], 0
    while left:
        share = shares({k: weights[k] for k in left})
        period = pfair(share)
        places: dict = {k: [] for k in left}
        for t, k in enumerate(period):
            places[k].append(t)
        size = len(period)
        stop = min(left[k] // share[k] * size + places[k][left[k] % share[k]] for k in left)
        for k in list(left):
            rows.append((k, done[k], slot, share[k], size, places[k]))
            took = stop // size * share[k] + sum(t < stop % size for t in places[k])
            done[k] += took
            left[k] -= took
            if not left[k]:
                del left[k]
        slot += stop
    return rows


def placed(docs: DataFrame, weights: dict[str, float] | None = None, rest: float | None = None, block: int = BLOCK, seed: int = 11) -> DataFrame:
    """(doc: the row as it was given, source_rank, block, slot, mix_order), as in `mixed`."""
    spark = docs.sparkSession
    given = [F.col(f"`{c}`") for c in docs.columns]
    if weights is None:
        names = docs.where("source is not null").select("source").distinct().limit(MAX_SOURCES + 1).collect()
        weights = {r.source: 1.0 for r in names}
    weights = {k: float(w) for k, w in weights.items() if w > 0}
    if len(weights) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources with weights of their own")
    own = {k: exact(w) for k, w in weights.items()} | {None: exact(float(rest or min(weights.values(), default=1.0)))}
    names = [k for k in own if k is not None]
    lane = F.when(F.col("source").isin(names), F.col("source")) if names else F.lit(None).cast("string")
    rows = docs.select(F.struct(*given).alias("doc"), lane.cast("string").alias("lane"), F.col("doc_id").alias("tie"), F.xxhash64(F.col("doc_id"), F.lit(seed)).alias("draw"))
    counts = {r["lane"]: r["count"] for r in rows.groupBy("lane").count().collect()}  # a row for each weight
    if not counts:
        return rows.select("doc", *[F.lit(0).cast("long").alias(c) for c in RESULTS])
    # A source is numbered in pieces of about PIECE documents, so that none has to fit into one task.
    many = F.lit(1)
    for k, n in counts.items():
        many = F.when(F.col("lane").eqNullSafe(F.lit(k)), F.lit(max(1, -(-n // PIECE)))).otherwise(many)
    rows = rows.withColumn("piece", F.pmod(F.shiftright("draw", 8), many.cast("long")))
    held = rows.groupBy("lane", "piece").count()
    before = Window.partitionBy("lane").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)  # a row for each piece
    held = stored(held.select(F.col("lane").alias("l"), F.col("piece").alias("p"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base")), "pieces")
    inside = Window.partitionBy("lane", "piece").orderBy("draw", "tie")
    rows = rows.withColumn("inside", F.row_number().over(inside) - 1)
    rows = rows.join(held, F.col("lane").eqNullSafe(F.col("l")) & (F.col("piece") == F.col("p"))).withColumn("source_rank", (F.col("base") + F.col("inside")).cast("long"))
    rows = rows.withColumn("block", F.floor(F.col("source_rank") / block).cast("long")).select("doc", "lane", "source_rank", "block")
    table = plan({k: -(-n // block) for k, n in counts.items()}, own)
    phases = spark.createDataFrame(table, "p_lane string, first long, phase_slot long, share long, size long, places array<int>")
    last = Window.partitionBy("p_lane").orderBy("first")  # a row for each source and phase
    phases = phases.groupBy("p_lane", "first").agg(*[F.max_by(c, "phase_slot").alias(c) for c in ("phase_slot", "share", "size", "places")])
    phases = phases.withColumn("next", F.lead("first").over(last))
    # At most MAX_SOURCES phases of MAX_PERIOD places in all each: bounded, whatever the documents.
    hit = F.col("lane").eqNullSafe(F.col("p_lane")) & (F.col("block") >= F.col("first")) & (F.col("next").isNull() | (F.col("block") < F.col("next")))
    rows = rows.join(F.broadcast(phases), hit)
    turn = F.col("block") - F.col("first")
    slot = F.col("phase_slot") + F.floor(turn / F.col("share")).cast("long") * F.col("size") + F.element_at("places", (turn % F.col("share") + 1).cast("int"))
    rows = rows.withColumn("slot", slot.cast("long"))
    return rows.select("doc", "source_rank", "block", "slot", (F.col("slot") * block + F.col("source_rank") % block).alias("mix_order"))


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, rest: float | None = None, block: int = BLOCK, seed: int = 11) -> DataFrame:
    """Adds source_rank, block, slot and mix_order (all long) to docs; every row gets a place, none is dropped or repeated.

    Documents of a source are put in an order that the seed draws and cut into blocks; `plan` gives each block its slot.
    mix_order sorts the mixture: by slot, then by rank in the block. Sources that have no weight in `weights`, and rows
    without a source, share the weight `rest` (default: the least weight given) as one source. No weights at all: every
    source weighs the same; more than MAX_SOURCES are an error. Equal rows, and rows of equal or null doc_id, get ranks
    one after the other. Texts are not looked at. Empty docs give empty results. Columns of docs that have one of the
    four names come back as <name>_given.
    """
    back = [F.col(f"doc.`{c}`").alias(f"{c}_given" if c in RESULTS else c) for c in docs.columns]
    return placed(docs, weights, rest, block, seed).select(*back, *RESULTS)
