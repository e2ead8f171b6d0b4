"""Best of a growing pool: pick k is the best candidate not yet taken among the first k * n.

Picks depend on each other in order, but the set of them can be found without going through it. Cut the
picks into blocks with the candidates that come in during them. Which candidates a run of blocks picks when
nothing is carried into it, its *own* picks, has two properties:

* a run of two halves has the own picks of its left half, and for the right half the best among its own picks
  and what the left half passed over: a candidate passed over inside the right half is still worse;
* given what is carried in and picked in the run, the left half picks the best among these and
  its own picks, and the right half the rest.

So runs of blocks are merged pair by pair upwards, which finds what is picked at all, and cut in halves
downwards, which finds the block of each pick; inside a block a heap puts them in order. Each step is one
ranking within groups of blocks, which no single task does for a large group.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqlab.operators.scale import number_rows
from seqlab.session import discard, written

#: Ranks that lie in one bucket where a large group is ranked.
BUCKET = 1 << 16


def _simulate(pdf: pd.DataFrame, first: int, slots: int, n: int) -> pd.DataFrame:
    """Picks of one block: at each slot ``n`` candidates come in and the best is taken."""
    rows = pdf.sort_values("at", kind="stable")
    at, place = rows["at"].to_numpy(), rows["place"].to_numpy()
    heap: list[tuple[int, int]] = []
    taken, slot_of = 0, [-1] * len(rows)
    i = 0
    for slot in range(first, first + slots):
        while i < len(rows) and at[i] < (slot + 1) * n:
            heapq.heappush(heap, (int(place[i]), i))
            i += 1
        if heap:
            _, j = heapq.heappop(heap)
            slot_of[j] = slot
            taken += 1
    return rows.assign(pick=slot_of)


def best_with_carry(df: DataFrame, order: list[str], score: str, n: int, block: int = 4096) -> DataFrame:
    """The picks from ``df`` in ``order``: its columns and ``pick``, counted from 0.

    Pick k is taken when (k + 1) * n candidates have come in; a last group of fewer than ``n`` gives none. Scores are
    compared to nine places; of equal ones the earlier candidate is taken; null scores are worst. ``block`` picks
    are simulated in one task.
    """
    key = -F.round(F.coalesce(F.col(score).cast("double"), F.lit(float("-inf"))), 9)
    row = F.struct(*[F.col(c) for c in df.columns]).alias("row")
    by = [f"order{i}" for i in range(len(order))]
    rows = df.select(row, key.alias("key"), *[F.col(c).alias(b) for c, b in zip(order, by)])
    rows = number_rows(rows, [], by, None, "at").select("row", "key", "at")
    rows = number_rows(rows, [], ["key", "at"], None, "place").select("row", "at", "place")
    total = rows.count() // n  # picks in all
    if not total:
        return df.limit(0).withColumn("pick", F.lit(0).cast("long"))
    rows = written(rows.where(F.col("at") < total * n), "candidates")
    n_blocks = -(-total // block)
    levels = max(0, (n_blocks - 1).bit_length())
    # Only the numbers go through the steps below.
    state = rows.select("at", "place", F.floor(F.col("at") / (n * block)).cast("long").alias("block"))

    def slots(first: Column, blocks: int) -> Column:
        """Picks of a run of blocks."""
        return F.greatest(F.lit(0), F.least(F.lit(total) - first * block, F.lit(blocks * block)))

    def ranked(part: DataFrame, group: Column) -> DataFrame:
        return number_rows(part.withColumn("group", group), ["group"], ["place"], F.floor(F.col("place") / BUCKET), "rank")

    def simulate():
        def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
            first = int(key[0]) * block
            return _simulate(pdf, first, min(block, total - first), n)

        return run

    # Own picks of each block, then of runs of 2, 4, ... blocks: bit k of `own` is for runs of 2^k.
    alone = state.groupBy("block").applyInPandas(simulate(), "at long, place long, block long, pick long")
    state = written(alone.select("at", "place", "block", F.when(F.col("pick") >= 0, 1).otherwise(0).cast("long").alias("own")), "own_picks")
    for level in range(levels):
        run = F.shiftright("block", level)
        right = run.bitwiseAND(F.lit(1)) == 1
        mine = F.col("own").bitwiseAND(F.lit(1 << level)) > 0
        asks = (right & mine) | (~right & ~mine)  # who contends for the picks of the right half
        group = F.shiftright("block", level + 1)
        free = slots((F.col("group") * 2 + 1) * (1 << level), 1 << level)
        won = ranked(state.where(asks), group).withColumn("yes", F.col("rank") < free).drop("group", "rank")
        rest = state.where(~asks).withColumn("yes", ~right)
        after = won.unionByName(rest)
        bit = F.when(F.col("yes"), F.lit(1 << (level + 1))).otherwise(F.lit(0)).cast("long")
        after = written(after.select("at", "place", "block", F.col("own").bitwiseOR(bit).alias("own")), "own_picks")
        discard(state)
        state = after
    # From all blocks down to each: `run` is the run in which a candidate is picked.
    picked = state.where(F.col("own").bitwiseAND(F.lit(1 << levels)) > 0).withColumn("run", F.lit(0).cast("long"))
    for level in range(levels - 1, -1, -1):
        left = F.col("run") * 2
        comes = F.shiftright("block", level)
        mine = F.col("own").bitwiseAND(F.lit(1 << level)) > 0
        asks = (comes < left) | ((comes == left) & mine)
        free = slots(F.col("group") * 2 * (1 << level), 1 << level)
        won = ranked(picked.where(asks), F.col("run")).withColumn("yes", F.col("rank") < free).drop("group", "rank")
        rest = picked.where(~asks).withColumn("yes", F.lit(False))
        side = F.col("run") * 2 + F.when(F.col("yes"), 0).otherwise(1)
        after = won.unionByName(rest).select("at", "place", "block", "own", side.cast("long").alias("run"))
        picked = written(after, "picked")
    placed = picked.select("at", "place", F.col("run").alias("block")).groupBy("block").applyInPandas(
        simulate(), "at long, place long, block long, pick long"
    )
    return rows.join(placed.select("at", "pick"), "at").select("row.*", "pick")
