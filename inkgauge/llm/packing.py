"""Best-fit packing with exact complements.

A document becomes its token ids and an end id, cut only where it is longer than a sequence. The
plan works on the number of pieces of each length, which is a table of at most `capacity` rows
whatever the data: for a length, the gap it leaves is filled exactly by one, two or three other
lengths as often as their counts allow; what has no exact complement is placed by best fit,
longest first. The plan then tells for each (length, number within the length) its sequence and
offset, so pieces are placed where they are, without moving token ids.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkgauge.llm.common import map_arrow, stored, take, texts_of
from inkgauge.llm.encoding import default_path, encoder

CAPACITY = 2048
END = b"\0\0\0\0"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, number long"


class Availability:
    """Counts of pieces by length, with the search for exact complements."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.n = np.zeros(capacity + 1, dtype=np.int64)
        for length, count in counts.items():
            self.n[length] += count

    def take(self, lengths: list[int], times: int) -> None:
        for length in lengths:
            self.n[length] -= times

    def times(self, lengths: list[int]) -> int:
        return int(min(self.n[x] // k for x, k in Counter(lengths).items()))

    def single(self, gap: int) -> list[int] | None:
        return [gap] if self.n[gap] > 0 else None

    def pair(self, gap: int) -> list[int] | None:
        half = np.arange(1, gap // 2 + 1)
        ok = (self.n[half] > 0) & (self.n[gap - half] > 0) & ((2 * half != gap) | (self.n[half] > 1))
        found = np.flatnonzero(ok)
        return [int(gap - half[found[0]]), int(half[found[0]])] if len(found) else None

    def triple(self, gap: int) -> list[int] | None:
        for first in np.flatnonzero(self.n[: max(gap - 1, 0)] > 0)[::-1]:
            first = int(first)
            if first * 3 < gap:
                return None
            self.n[first] -= 1
            rest = self.pair(gap - first)
            self.n[first] += 1
            if rest:
                return [first, *rest]
        return None

    def complement(self, gap: int) -> list[int] | None:
        return self.single(gap) or self.pair(gap) or self.triple(gap)


BATCH_BYTES = 4 << 20  # of texts that a task holds at once, about
BROADCAST_ROWS = 500_000  # of three numbers each
Plan = list[tuple[list[tuple[int, int]], int]]


def make_plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """[(lengths of a sequence as (length, how many of it), number of such sequences)].

    Lengths just above a third of `capacity` can fit worse after exact complements than by best fit
    alone, so both plans are made and the one of fewer sequences is taken, of equal ones the first.
    Each step uses up at least one length, so the number of patterns is a small multiple of
    `capacity` and doesn't grow with the number of pieces.
    """
    whole = {length: n for length, n in counts.items() if n > 0}
    return min(by_complements(whole, capacity), best_fit(whole, capacity), key=lambda plan: sum(n for _, n in plan))


def by_complements(counts: dict[int, int], capacity: int) -> Plan:
    """Sequences filled exactly, then best fit of the rest."""
    free, plan, rest = Availability(counts, capacity), [], {}
    if free.n[capacity]:
        plan.append(([(capacity, 1)], int(free.n[capacity])))
        free.n[capacity] = 0
    for length in range(capacity - 1, 0, -1):
        while free.n[length] > 0:
            free.n[length] -= 1
            fill = free.complement(capacity - length)
            free.n[length] += 1
            if not fill:
                break
            lengths = [length, *fill]
            times = free.times(lengths)
            free.take(lengths, times)
            plan.append((sorted(Counter(lengths).items(), reverse=True), times))
        if free.n[length] > 0:
            rest[length] = int(free.n[length])
            free.n[length] = 0
    return plan + best_fit(rest, capacity)


def best_fit(rest: dict[int, int], capacity: int) -> Plan:
    """Longest first, each into the smallest gap: open sequences of equal content are one group, sorted by their gap."""
    gaps: list[tuple[int, int]] = []
    groups: list[list] = []

    def open_group(content: list, times: int, gap: int) -> None:
        groups.append([content, times])
        if gap and times:
            bisect.insort(gaps, (gap, len(groups) - 1))

    for length in sorted(rest, reverse=True):
        left = rest[length]
        while left:
            at = bisect.bisect_left(gaps, (length, -1))
            if at < len(gaps):
                gap, group = gaps.pop(at)
                content, times = groups[group]
            else:
                gap, group, content, times = capacity, None, [], left
            each = gap // length
            filled = min(times, left // each)
            used = filled
            if filled:
                open_group([*content, (length, each)], filled, gap - each * length)
                left -= filled * each
            if left and left < each and used < times:
                open_group([*content, (length, left)], 1, gap - left * length)
                used, left = used + 1, 0
            if group is not None:
                groups[group][1] -= used
                if groups[group][1] > 0:
                    bisect.insort(gaps, (gap, group))
    return [(sorted(c, reverse=True), n) for c, n in groups if n > 0]


def as_runs(plan: list, capacity: int) -> dict[str, np.ndarray]:
    """The plan as runs of consecutive numbers within a length, sorted by (length, first number)."""
    rows, seen, base = [], Counter(), 0
    for content, times in plan:
        offset = 0
        for length, each in content:
            rows.append((length, seen[length], each, base, offset))
            seen[length] += each * times
            offset += each * length
        base += times
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return {k: table[:, i].copy() for i, k in enumerate(("length", "first", "each", "base", "offset"))}


def cut(docs: DataFrame, tokenizer: str, capacity: int, keep_ids: bool) -> DataFrame:
    """One row per piece, numbered within its length and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen, part = encoder(tokenizer).encode, Counter(), TaskContext.get().partitionId()
        wide = 4 * capacity
        for batch in batches:
            names = batch.column(0)
            for begin, texts in texts_of(batch, chars=1 << 20):
                at, piece, start, length, crc, number, ids = [], [], [], [], [], [], []
                for i, text in enumerate(texts, begin):
                    tokens = encode(text or "") + END
                    for k, lo in enumerate(range(0, len(tokens), wide)):
                        chunk = tokens[lo : lo + wide]
                        n = len(chunk) // 4
                        at.append(i)
                        piece.append(k)
                        start.append(lo // 4)
                        length.append(n)
                        crc.append(zlib.crc32(chunk))
                        number.append(seen[n])
                        seen[n] += 1
                        if keep_ids:
                            ids.append(chunk)
                columns = [names.take(pa.array(at, pa.int64())), pa.array(piece, pa.int32())]
                columns += [pa.array(x, pa.int64()) for x in (start, length, crc)]
                columns += [pa.array([part] * len(at), pa.int32()), pa.array(number, pa.int64())]
                if keep_ids:
                    columns.append(pa.array(ids, pa.binary()))
                fields = [x.split()[0] for x in schema.split(", ")]
                yield pa.RecordBatch.from_arrays(columns, names=fields)

    schema = PIECES + (", ids binary" if keep_ids else "")
    return map_arrow(docs, run, schema)


def pack_documents(
    docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, keep_ids: bool = False
) -> DataFrame:
    """Pieces with their sequence: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and `ids`).

    A null or empty text is the single end id. A null `doc_id` is kept, repeated rows are packed
    each for itself, an empty table gives no rows. Only `doc_id` and `text` are read of `docs`.
    """
    docs = take(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    pieces = stored(cut(docs, tokenizer or default_path(), capacity, keep_ids), "pieces", BATCH_BYTES)
    by_task = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    totals = by_task.groupBy("length").agg(F.sum("n").alias("n"), F.count("*").alias("tasks")).collect()
    counts = {r["length"]: r["n"] for r in totals}
    runs = as_runs(make_plan(counts, capacity), capacity)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = by_task.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    if sum(r["tasks"] for r in totals) <= BROADCAST_ROWS:  # pieces, with their ids, stay where they are
        shift = F.broadcast(shift)
    numbered = pieces.join(shift, ["length", "part"]).withColumn("number", F.col("number") + F.col("shift"))
    out = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids]
    low = np.searchsorted(runs["length"], np.arange(capacity + 2))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = (batch.column(n).to_numpy() for n in ("length", "number"))
            order = np.lexsort((number, length))
            run = np.empty(len(length), dtype=np.int64)
            bounds = np.searchsorted(length[order], np.unique(length), side="left").tolist() + [len(length)]
            for lo, hi in zip(bounds, bounds[1:]):
                size = length[order[lo]]
                first = runs["first"][low[size] : low[size + 1]]
                run[order[lo:hi]] = low[size] + np.searchsorted(first, number[order[lo:hi]], side="right") - 1
            within = number - runs["first"][run]
            sequence = runs["base"][run] + within // runs["each"][run]
            offset = runs["offset"][run] + within % runs["each"][run] * length
            columns = [batch.column(n) for n in out] + [pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, names=[*out, "sequence_id", "offset"])

    ids = ", ids binary" if keep_ids else ""
    schema = f"doc_id long, piece int, start long, length long, ids_crc32 long{ids}, sequence_id long, offset long"
    return map_arrow(numbered.select(*out, "number"), place, schema)
