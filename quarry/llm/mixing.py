"""Operator 6, mixing sources to target weights by Pfair scheduling. DataFrame functions only.

A source's rows, by id, form blocks of ``BLOCK`` rows. Block j of a source with the share w of all weights may
be sent from slot floor(j / w) on and must be sent before slot ceil((j + 1) / w); at each slot, of the sources
whose next block is released, that with the earliest deadline goes. The number of a source's blocks sent is
then within one block of its share of the slots, at any time. Weights are taken as they are, as whole numbers
in their lowest terms, so the order repeats in frames of as many slots as these sum up to: one frame is worked
out from the weights alone, and a row finds its slot by its block's number. When a source runs out, the others'
shares are scaled up and a new phase begins, measured from there.

Where the sum passes ``most`` (1,000, or ``MOST_SLOTS`` over the number of sources if that is more), weights are
first rounded to multiples of 1 / most of their sum, and the bound holds for these: the given ones are missed
by another half block for each ``most`` slots at worst. Without given weights, a source's weight is its number of
rows to the power ``TEMPERATURE``, in whole thousandths of the sum.

Only one number per source is brought to the driver; at most ``MOST_SOURCES`` are allowed, since each
needs a weight. The plan has at most MOST_SOURCES * most slots, whatever the number of rows. Odd input: a null
source is a source; sources of no, zero or unknown weight are sent after all others, by equal weights, so that no
row is lost; equal ids are separate rows; an empty table is empty.
"""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm import common

BLOCK = 32
SHARES = 1_000
MOST_SOURCES = 500
MOST_SLOTS = 1 << 18
TEMPERATURE = 0.5


def shares_of(weights: dict[str, float], total: int = SHARES) -> dict[str, int]:
    """Whole shares, at least one each, that sum to total (or to the number of sources), by largest remainder."""
    total = max(total, len(weights))
    sum_ = sum(weights.values()) or 1.0
    exact = {s: max(1.0, w / sum_ * total) for s, w in weights.items()}
    spare = total - len(exact)
    over = sum(x - 1 for x in exact.values()) or 1.0
    exact = {s: 1 + (x - 1) / over * spare for s, x in exact.items()}
    found = {s: math.floor(x) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (found[s] - exact[s], s))[: total - sum(found.values())]:
        found[s] += 1
    return found


def whole(weights: dict[str, float], most: int) -> dict[str, int]:
    """The positive weights as whole numbers of the same proportions, in lowest terms; rounded if they sum to more than most."""
    exact = {s: Fraction(str(w)) for s, w in weights.items() if 0 < w < math.inf}
    scale = math.lcm(*(f.denominator for f in exact.values()))
    found = {s: int(f * scale) for s, f in exact.items()}
    divisor = math.gcd(*found.values()) or 1
    found = {s: n // divisor for s, n in found.items()}
    return found if sum(found.values()) <= most else shares_of({s: float(f) for s, f in exact.items()}, most)


def frame(shares: dict[str, int]) -> list[str]:
    """The source of each slot of one frame: earliest deadline first among released blocks."""
    total, out = sum(shares.values()), []
    waiting = [(0, s, 0) for s in sorted(shares)]  # release, source, block
    ready: list[tuple[int, str, int]] = []
    heapq.heapify(waiting)
    for slot in range(total):
        while waiting and waiting[0][0] <= slot:
            _, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * total // shares[s]), s, j))
        deadline, s, j = heapq.heappop(ready)
        assert deadline > slot, "a block missed its deadline"
        out.append(s)
        if j + 1 < shares[s]:
            heapq.heappush(waiting, ((j + 1) * total // shares[s], s, j + 1))
    return out


def plan(blocks: dict[str, int], weights: dict[str, float], most: int | None = None) -> list[dict]:
    """The phases, for each source that takes part: its first block, its number of blocks, the phase's first
    slot and frame length, and the slots of a frame that are its own."""
    most = most or max(SHARES, MOST_SLOTS // max(1, len(blocks)))
    sent, start, phases = dict.fromkeys(blocks, 0), 0, []
    while left := [s for s, n in blocks.items() if n > sent[s]]:
        active = whole({s: weights.get(s, 0) for s in left}, most) or dict.fromkeys(left, 1)
        order = frame(active)
        frames = min((blocks[s] - sent[s]) // n for s, n in active.items())
        took = {s: frames * n for s, n in active.items()}
        length = frames * len(order)
        if all(sent[s] + took[s] < blocks[s] for s in active):
            for s in order:  # the frame in which the first source runs out
                took[s] += 1
                length += 1
                if sent[s] + took[s] == blocks[s]:
                    break
        own: dict[str, list[int]] = {s: [] for s in active}
        for i, s in enumerate(order):
            own[s].append(i)
        phases += [{"source": s, "first": sent[s], "n": took[s], "start": start, "frame": len(order), "slots": own[s]} for s in active if took[s]]
        for s in active:
            sent[s] += took[s]
        start += length
    return phases


def _numbered(rows: DataFrame) -> DataFrame:
    """rows (_q_key, _q_source, ...) with ``_q_rank``, from 0, within the source by key. Rows are dealt out by ranges
    of (source, key), so that a source of any size spreads over many tasks; only their counts are summed up."""
    at = F.monotonically_increasing_id()  # partition number and place, which the checkpoint fixes
    rows = common.pinned(rows.repartitionByRange("_q_source", "_q_key").sortWithinPartitions("_q_source", "_q_key").withColumn("_q_at", at))
    counts = rows.groupBy(F.col("_q_source").alias("_q_of"), F.shiftright("_q_at", 33).alias("_q_part")).agg(F.count("*").alias("n"), F.min("_q_at").alias("_q_first"))
    before = Window.partitionBy("_q_of").orderBy("_q_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    starts = counts.select("_q_of", "_q_part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("_q_first")).alias("_q_base"))
    found = rows.join(common.small(starts), (F.col("_q_source") == F.col("_q_of")) & (F.shiftright("_q_at", 33) == F.col("_q_part")))
    return found.withColumn("_q_rank", F.col("_q_at") + F.col("_q_base")).drop("_q_of", "_q_part", "_q_base", "_q_at")


def mix(rows: DataFrame, weights: dict[str | None, float] | None = None, block: int = BLOCK, most: int | None = None) -> DataFrame:
    """rows (with _q_key and source) plus ``slot`` and ``place`` in the slot's block: together the mixed order."""
    name = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("null"))
    columns, rows = rows.columns, rows.withColumn("_q_source", name)
    counts = {r[0]: r[1] for r in rows.groupBy("_q_source").count().limit(MOST_SOURCES + 1).collect()}
    if len(counts) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources: give them in groups that have weights")
    if weights is None:
        target = shares_of({s: n**TEMPERATURE for s, n in counts.items()}) if counts else {}
    else:
        target = {"null" if s is None else f"={s}": w for s, w in weights.items()}
    phases = common.literal(rows.sparkSession, plan({s: -(-n // block) for s, n in counts.items()}, target, most), "source string, first long, n long, start long, frame long, slots array<long>")
    phases = phases.select(F.col("source").alias("_q_of"), F.struct("first", "n", "start", "frame", "slots").alias("_q_phase"))
    numbered = _numbered(rows).withColumn("_q_block", F.floor(F.col("_q_rank") / block).cast("long"))
    done = F.col("_q_block") - F.col("_q_phase.first")
    # at most MOST_SOURCES phases of each source, and most slots a phase
    found = numbered.join(F.broadcast(phases), (F.col("_q_source") == F.col("_q_of")) & (done >= 0) & (done < F.col("_q_phase.n")))
    share = F.size("_q_phase.slots")
    slot = F.col("_q_phase.start") + F.floor(done / share) * F.col("_q_phase.frame") + F.get("_q_phase.slots", (done % share).cast("int"))
    return found.select(*[found[c] for c in columns], slot.cast("long").alias("slot"), (F.col("_q_rank") % block).cast("long").alias("place"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.keyed(common.read(spark, sf_dir, "documents"), ["doc_id", "source"])
    return mix(rows).select(F.col("doc_id").cast("long").alias("doc_id"), "source", "slot", "place")


@common.shielded
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, written in the mixed order."""
    rows = common.keyed(docs, docs.columns)
    order = mix(rows.select("_q_key", "source")).select("_q_key", F.col("slot").alias("_q_slot"), F.col("place").alias("_q_place"))
    return rows.join(order, "_q_key").repartitionByRange("_q_slot", "_q_place").sortWithinPartitions("_q_slot", "_q_place").select(*docs.columns)
