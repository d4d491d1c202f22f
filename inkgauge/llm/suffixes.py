"""Removal of repeated passages by longest-previous-factor arrays over suffixes.

A byte goes if a string of `span` bytes round it also starts in a document with a smaller id. All
suffixes of a corpus can't meet in one place, so they are dealt by content: a window of `span`
bytes is assigned to the smallest hash among its runs of `gram` bytes (its anchor). Equal windows
have equal anchors wherever they stand, and an anchor that occurs in one document only needs no
further look. Shared anchors that are too many for one filter, or whose blocks are most of the corpus,
are worked off in slices.
Neighbouring windows of one anchor form a block; the blocks of an anchor are brought
together and the suffixes of their windows, each up to the end of its block, are sorted. The common
prefixes of neighbours in that order and, for each suffix, the nearest positions before and after it
that belong to a smaller document give its longest previous factor: the longest prefix that starts
in a smaller document as well. Bytes of factors of `span` or more go. Later copies of a whole block
are settled by its first document without sorting.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgauge.llm.common import map_arrow, spent, stored, take, text_key

SPAN = 50
GRAM = 20
RUN = 128  # windows of a block at most, for texts that repeat themselves
CHUNK = 1 << 21  # bytes worked on at once
CACHED = 1 << 15  # windows hashed at once, few enough for the processor's cache
SETTLED = 400_000  # bytes of blocks sorted at once, if their groups allow
HOT_BLOCKS = 4096  # blocks of an anchor from which its windows are dealt one by one
FILTER_BITS = 27  # size of the filter of shared anchors, whatever the data
FILLED = 4  # bits of the filter per shared anchor of a slice, at least
SHARE = 0.4  # of all blocks that a slice works on, about, if they are more than FEW
FEW = 1 << 24
SLICES = 1 << 10  # slices at most
LAST = (1 << 63) - 1  # place of documents without an id in the order
BASE = 0x9E3779B97F4A7C15


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Mixed hash of every run of `gram` bytes, by doubling."""
    power, width, total, done = BASE, 1, None, 0
    level = data.astype(np.uint64) + np.uint64(1)
    left = gram
    while left:
        if left & 1:
            if total is None:
                total, done = level, width
            else:
                n = len(data) - done - width + 1
                total, done = total[:n] * np.uint64(power) + level[done : done + n], done + width
        left >>= 1
        if left:
            n = len(level) - width
            level = level[:n] * np.uint64(power) + level[width : width + n]
            power, width = power * power % 2**64, width * 2
    out = total ^ (total >> np.uint64(29))
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out


def sliding_min(values: np.ndarray, window: int) -> np.ndarray:
    width, least = 1, values
    while width * 2 <= window:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = window - width
    return np.minimum(least[:-rest], least[rest:]) if rest else least


def least_hashes(data: np.ndarray, span: int, gram: int) -> np.ndarray:
    """Smallest hash of each window of `span` bytes."""
    out = np.empty(len(data) - span + 1, dtype=np.uint64)
    for lo in range(0, len(out), CACHED):
        out[lo : lo + CACHED] = sliding_min(gram_hashes(data[lo : lo + CACHED + span - 1], gram), span - gram + 1)
    return out


def blocks_of(data: np.ndarray, bounds: np.ndarray, span: int, gram: int):
    """(document number, first byte in `data`, windows, anchor) of the blocks of documents at `bounds`."""
    for begin in range(0, max(len(data) - span + 1, 0), CHUNK):
        part = data[begin : begin + CHUNK + span - 1]
        if len(part) < span:
            return
        least = least_hashes(part, span, gram)
        first_doc, last_doc = np.searchsorted(bounds, [begin, begin + len(least) - 1], side="right") - 1
        docs = np.arange(first_doc, last_doc + 1)
        lo = np.maximum(bounds[docs] - begin, 0)
        hi = np.minimum(bounds[docs + 1] - span + 1 - begin, len(least))  # end of its windows
        docs, lo, hi = docs[hi > lo], lo[hi > lo], hi[hi > lo]
        if not len(docs):
            continue
        change = np.zeros(len(least) + 1, dtype=bool)
        change[1:-1] = least[1:] != least[:-1]
        change[lo] = True
        change[hi] = True
        at = np.flatnonzero(change)
        doc = np.searchsorted(lo, at, side="right") - 1
        inside = (doc >= 0) & (at < hi[np.maximum(doc, 0)])
        start, doc = at[inside], doc[inside]
        end = np.append(at, len(least))[np.flatnonzero(inside) + 1]
        while (long := end - start > RUN).any():
            more = start[long] + RUN
            start, end, doc = (
                np.concatenate([start, more]),
                np.concatenate([np.where(long, start + RUN, end), end[long]]),
                np.concatenate([doc, doc[long]]),
            )
        yield docs[doc], begin + start, end - start, least[start].view(np.int64)


def _flat(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a binary column without nulls, one after the other, and their bounds."""
    array = batch.column(column)
    bounds = np.frombuffer(array.buffers()[1], dtype=np.int32)[array.offset : array.offset + len(array) + 1]
    data = array.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[bounds[0] : bounds[-1]], (bounds - bounds[0]).astype(np.int64)


def anchors(docs: DataFrame, span: int, gram: int) -> DataFrame:
    """(anchor, doc, n): of each anchor the smallest and largest document of a batch; n adds up to its blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc").to_numpy()
            data, bounds = _flat(batch, "bytes")
            for doc, _, _, anchor in blocks_of(data, bounds, span, gram):
                own = ids[doc]
                order = np.lexsort((own, anchor))
                anchor, own = anchor[order], own[order]
                new = np.append(True, anchor[1:] != anchor[:-1])
                last = np.append(new[1:], True)
                keep = new | (last & (own != np.minimum.reduceat(own, np.flatnonzero(new))[np.cumsum(new) - 1]))
                n = np.zeros(len(new), dtype=np.int32)
                n[new] = np.diff(np.flatnonzero(new), append=len(new))
                yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (anchor, own, n)], names=["anchor", "doc", "n"])

    return map_arrow(docs.select("doc", "bytes"), run, "anchor long, doc long, n int")


def bit_places(anchor: Column, bits: int) -> Column:
    """Two places in the filter, from two parts of the hash."""
    mask = F.lit((1 << bits) - 1).cast("long")
    return F.array(anchor.bitwiseAND(mask), F.shiftrightunsigned(anchor, 64 - bits).bitwiseAND(mask))


def anchor_filter(shared: DataFrame, bits: int) -> np.ndarray:
    """Bit table with two bits per shared anchor: 2**bits bits, whatever the number of anchors.

    It only spares work: an anchor that passes by chance is compared like any other.
    """
    place = shared.select(F.explode(bit_places(F.col("anchor"), bits)).alias("p"))
    word = F.expr("shiftleft(1L, cast(p & 63L AS int))")
    words = place.groupBy(F.shiftright("p", 6).alias("at")).agg(F.bit_or(word).alias("w")).toArrow()
    table = np.zeros(1 << (bits - 6), dtype=np.int64)
    table[words.column("at").to_numpy()] = words.column("w").to_numpy()
    return table.view(np.uint64)


def passes(table: np.ndarray, anchor: np.ndarray, bits: int) -> np.ndarray:
    value, mask = anchor.view(np.uint64), np.uint64((1 << bits) - 1)
    found = np.ones(len(value), dtype=bool)
    for place in (value & mask, value >> np.uint64(64 - bits)):
        found &= (table[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1
    return found


def slice_of(anchor: Column, slices: int) -> Column:
    """Slice of an anchor, from bits of the hash that a filter of FILTER_BITS does not use."""
    return F.shiftrightunsigned(anchor, FILTER_BITS).bitwiseAND(F.lit(SLICES - 1).cast("long")) % slices


def shared_blocks(
    docs: DataFrame, table, span: int, gram: int, bits: int, slices: int = 1, number: int = 0, once: bool = False
) -> DataFrame:
    """(anchor, doc, text_key, at, block): the blocks of a slice's anchors that pass the filter.

    With `once` equal blocks of the bytes that are worked on at once are given once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column("doc").to_numpy(), batch.column("text_key").to_numpy()
            data, bounds = _flat(batch, "bytes")
            whole = data.tobytes()
            for doc, at, n, anchor in blocks_of(data, bounds, span, gram):
                keep = passes(table.value, anchor, bits)
                if slices > 1:
                    keep &= (anchor.view(np.uint64) >> np.uint64(FILTER_BITS)) % np.uint64(SLICES) % np.uint64(slices) == number
                doc, at, n, anchor = doc[keep], at[keep], n[keep], anchor[keep]
                block = [whole[a:b] for a, b in zip(at.tolist(), (at + n + span - 1).tolist())]
                if once:
                    first = {b: i for i, b in zip(range(len(block) - 1, -1, -1), reversed(block))}
                    some = np.fromiter(first.values(), np.int64, len(first))
                    doc, at, anchor, block = doc[some], at[some], anchor[some], list(first)
                columns = [pa.array(x) for x in (anchor, ids[doc], keys[doc], at - bounds[doc])]
                names = ["anchor", "doc", "text_key", "at", "block"]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(block, pa.binary())], names=names)

    return map_arrow(docs, run, "anchor long, doc long, text_key long, at long, block binary")


def common_prefixes(words: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Bytes that each row of a sorted, zero-padded table shares with the row before; 0 for the first."""
    out = np.zeros(len(words), dtype=np.int64)
    differs = words[1:] != words[:-1]
    some = differs.any(axis=1)
    word = differs.argmax(axis=1)
    at = np.arange(len(differs))
    apart = (words[at + 1, word] ^ words[at, word]).view(np.uint8).reshape(-1, 8) != 0  # bytes in the order of the text
    shared = np.where(some, word * 8 + apart.argmax(axis=1), words.shape[1] * 8)
    out[1:] = np.minimum(shared, np.minimum(size[1:], size[:-1]))
    return out


def previous_factors(shared: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Longest previous factor of each suffix in sorted order, where `shared` is its common prefix with the one before.

    That factor is the longer of the common prefixes with the previous and with the next position of
    a smaller document. Both are found for all suffixes at once, by halving steps over minima of runs
    of 1, 2, 4 ... positions.
    """
    n = len(doc)
    least_doc, least_shared = [doc], [shared]  # of 2**k positions from each one on
    while (width := 1 << (len(least_doc) - 1)) * 2 <= n:
        for table in (least_doc, least_shared):
            table.append(np.minimum(table[-1][:-width], table[-1][width:]))
    none = np.iinfo(np.int64).max
    before, left = np.arange(n), np.full(n, none)  # all from `before` to the suffix are no smaller; least common prefix
    after, right = np.arange(n), np.full(n, none)
    for k in range(len(least_doc) - 1, -1, -1):
        width, last = 1 << k, len(least_doc[k]) - 1
        start = before - width
        step = (start >= 0) & (least_doc[k][np.clip(start, 0, last)] >= doc)
        left = np.where(step, np.minimum(left, least_shared[k][np.clip(start + 1, 0, last)]), left)
        before = np.where(step, start, before)
        start = after + 1
        step = (start <= last) & (least_doc[k][np.minimum(start, last)] >= doc)
        right = np.where(step, np.minimum(right, least_shared[k][np.minimum(start, last)]), right)
        after = np.where(step, after + width, after)
    left = np.where(before > 0, np.minimum(left, shared[before]), 0)
    right = np.where(after < n - 1, np.minimum(right, shared[np.minimum(after + 1, n - 1)]), 0)
    return np.maximum(left, right)


def sorted_suffixes(data: np.ndarray, start: np.ndarray, size: np.ndarray, anchor: np.ndarray, doc: np.ndarray):
    """(order, shared): suffixes sorted by anchor, bytes and document, and what each shares with the one before."""
    width = -(-int(size.max(initial=1)) // 8) * 8
    rows = np.lib.stride_tricks.sliding_window_view(np.append(data, np.zeros(width, dtype=np.uint8)), width)[start]
    rows[np.arange(width) >= size[:, None]] = 0
    words = rows.view(np.uint64)
    order = np.lexsort((doc, size, *words.byteswap().T[::-1], anchor))
    shared = common_prefixes(words[order], size[order])
    shared[1:][anchor[order][1:] != anchor[order][:-1]] = 0
    return order, shared


def longest_earlier(
    data: np.ndarray, start: np.ndarray, size: np.ndarray, anchor: np.ndarray, doc: np.ndarray, span: int
) -> np.ndarray:
    """Length of the longest prefix of each suffix that starts a suffix of the same anchor in a smaller document.

    A suffix is `size` bytes from `start` on. Lengths below `span` are given as 0: suffixes that share
    less with both neighbours in the order of their first `span` bytes are not sorted any further.
    """
    order, shared = sorted_suffixes(data, start, np.minimum(size, span), anchor, doc)
    near = order[(shared >= span) | np.append(shared[1:] >= span, False)]
    order, shared = sorted_suffixes(data, start[near], size[near], anchor[near], doc[near])
    factor = np.zeros(len(start), dtype=np.int64)
    found = previous_factors(shared, doc[near][order])
    factor[near[order]] = np.where(found >= span, found, 0)
    return factor


def settle(blocks: DataFrame, span: int) -> DataFrame:
    """(anchor, code, spans): bytes of the first copy of a block that an earlier document has, as (lo, hi).

    `blocks` has the rows of one (anchor, part) next to each other.
    """

    def work(rows: pa.Table) -> pa.RecordBatch | None:
        """None if there is nothing."""
        data, bounds = _flat(rows.combine_chunks().to_batches()[0], "block")
        n = np.diff(bounds) - span + 1
        row = np.repeat(np.arange(len(n)), n)
        within = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        anchor, doc = (rows.column(c).to_numpy() for c in ("anchor", "first"))
        size = n[row] - within + span - 1
        factor = longest_earlier(data, bounds[row] + within, size, anchor[row], doc[row], span)
        earlier = factor >= span
        hit, lo, factor = row[earlier], within[earlier], factor[earlier]
        if not len(hit):
            return None
        # factors that touch become one span
        far = hit.astype(np.int64) * (int(n.max()) + span)
        end = np.maximum.accumulate(far + lo + factor) - far
        new = np.append(True, (hit[1:] != hit[:-1]) | (lo[1:] > end[:-1]))
        last = np.append(new[1:], True)
        shift = rows.column("shift").to_numpy()[hit[new]]
        ends = [pa.array((shift + x).astype(np.int32)) for x in (lo[new], end[last])]
        some, begin = np.unique(hit[new], return_index=True)
        bounds = pa.array(np.append(begin, new.sum()), pa.int32())
        spans = pa.ListArray.from_arrays(bounds, pa.StructArray.from_arrays(ends, names=["lo", "hi"]))
        columns = [rows.column(c).combine_chunks().take(pa.array(some)) for c in ("anchor", "code")]
        return pa.RecordBatch.from_arrays([*columns, spans], names=["anchor", "code", "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            kept += [batch] * (batch.num_rows > 0)
            size += batch.column("block").nbytes
            if size < SETTLED:
                continue
            table = pa.Table.from_batches(kept)
            key, part = table.column("anchor").to_numpy(), table.column("part").to_numpy()
            same = (key == key[-1]) & (part == part[-1])
            ready = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            if ready and (found := work(table.slice(0, ready))):
                yield found
            kept = table.slice(ready).combine_chunks().to_batches()
            size = sum(b.column("block").nbytes for b in kept)
        if size and (found := work(pa.Table.from_batches(kept))):
            yield found

    return map_arrow(blocks, run, "anchor long, code long, spans array<struct<lo: int, hi: int>>")


def removed_spans(docs: DataFrame, span: int = SPAN, gram: int = GRAM, bits: int = FILTER_BITS) -> DataFrame:
    """(doc, text_key, marks): bytes of each document to be removed, as an unmerged array of (lo, hi).

    `docs` has (doc, text_key, bytes) without nulls. Blocks travel as hashes; only those of anchors
    with several different blocks are fetched as bytes. Slices of the shared anchors are worked off
    one after the other, so that neither the filter fills up nor the blocks of all meet on disk.
    """
    seen = anchors(docs, span, gram)
    shared = seen.repartition("anchor").groupBy("anchor")
    shared = shared.agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.sum("n").alias("n"))
    shared = stored(shared.where("lo < hi").select("anchor", "n"), "shared-anchors")
    size = shared.agg(F.count("*").alias("anchors"), F.coalesce(F.sum("n"), F.lit(0)).alias("blocks")).first()
    most = FEW
    if size["blocks"] > FEW:
        # the smallest of the hashes of a window changes every (runs of a window + 1) / 2 bytes
        every = docs.agg(F.sum(F.octet_length("bytes"))).first()[0] / ((span - gram + 2) / 2)
        most = max(FEW, SHARE * every)
    slices = min(SLICES, max(1, math.ceil(size["blocks"] / most), math.ceil(size["anchors"] * FILLED / (1 << bits))))
    marks = [_marks(docs, shared, span, gram, bits, slices, number) for number in range(slices)]
    spent(shared)
    if slices == 1:
        return marks[0]
    together = reduce(DataFrame.unionByName, marks).groupBy("doc", "text_key")
    out = stored(together.agg(F.flatten(F.collect_list("marks")).alias("marks")), "marks")
    spent(*marks)
    return out


def _marks(docs: DataFrame, shared: DataFrame, span: int, gram: int, bits: int, slices: int, number: int) -> DataFrame:
    """(doc, text_key, marks) by the blocks of one slice of the shared anchors, stored."""
    broadcast = docs.sparkSession.sparkContext.broadcast
    own = shared.where(slice_of(F.col("anchor"), slices) == number)
    code = F.xxhash64("block").alias("code")
    table = broadcast(anchor_filter(own, bits))
    rows = shared_blocks(docs, table, span, gram, bits, slices, number)
    rows = stored(rows.select("anchor", code, "doc", "text_key", "at", F.octet_length("block").alias("size")), "blocks")
    table.destroy()
    kinds = rows.groupBy("anchor", "code").agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
    kinds = stored(kinds.select("anchor", "code", "first", (F.col("first") < F.col("last")).alias("again")), "kinds")
    counts = kinds.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1")
    several = stored(kinds.join(counts, "anchor").select("anchor", "code", "first", "n"), "several")

    table = broadcast(anchor_filter(several.select("anchor").distinct(), bits))
    found = shared_blocks(docs, table, span, gram, bits, slices, number, once=True)
    # dealt once for the join and for equal blocks
    found = found.select("anchor", code, "block").repartition("anchor", "code").groupBy("anchor", "code")
    found = found.agg(F.first("block").alias("block")).join(several, ["anchor", "code"])
    hot = F.col("n") > HOT_BLOCKS
    windows = F.octet_length("block") - span + 1
    cuts = F.when(hot, F.sequence(F.lit(0), windows - 1)).otherwise(F.array(F.lit(0)))
    width = F.when(hot, F.lit(span)).otherwise(F.octet_length("block"))
    pieces = found.select("anchor", "code", "first", "block", hot.alias("hot"), width.alias("w"), F.explode(cuts).alias("shift"))
    pieces = pieces.select(
        "anchor", "code", "first", "shift", "hot", F.substring("block", F.col("shift") + 1, F.col("w")).alias("block")
    )
    part = F.when(F.col("hot"), F.xxhash64("block")).otherwise(F.lit(0).cast("long"))
    dealt = pieces.withColumn("part", part).drop("hot").repartition("anchor", "part").sortWithinPartitions("anchor", "part")
    settled = settle(dealt, span).groupBy("anchor", "code").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    settled = stored(settled, "settled")
    table.destroy()
    spent(several)

    verdict = kinds.join(settled, ["anchor", "code"], "left").where(F.col("again") | F.col("spans").isNotNull())
    marked = rows.join(verdict.drop("again"), ["anchor", "code"])
    whole = F.array(F.struct(F.col("at").alias("lo"), (F.col("at") + F.col("size")).alias("hi")))
    some = F.transform("spans", lambda s: F.struct((F.col("at") + s["lo"]).alias("lo"), (F.col("at") + s["hi"]).alias("hi")))
    spans = F.when(F.col("doc") > F.col("first"), whole).otherwise(some)
    marks = marked.select("doc", "text_key", F.explode(spans).alias("s")).groupBy("doc", "text_key")
    marks = stored(marks.agg(F.collect_list("s").alias("marks")), "marks")
    spent(rows, kinds, settled)
    return marks


def drop_repeats(
    docs: DataFrame, span: int = SPAN, gram: int = GRAM, bits: int = FILTER_BITS, keep_text: bool = True
) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (array of struct lo, hi), kept_sha256 and `kept` (bytes).

    One row per row of `docs`. A null text is empty. Documents with the same id never remove each
    other; those without an id count as later than all others. Only `doc_id` and `text` are read.
    """
    plain = take(docs, "doc_id", "text").select(
        "doc_id",
        F.coalesce("doc_id", F.lit(LAST)).cast("long").alias("doc"),
        text_key(F.col("text")).alias("text_key"),
        F.coalesce("text", F.lit("")).cast("binary").alias("bytes"),
    )
    marks = removed_spans(plain.select("doc", "text_key", "bytes"), span, gram, bits)
    rows = plain.join(marks, ["doc", "text_key"], "left").select("doc_id", "bytes", "marks")
    schema = "doc_id long, n_bytes long, n_removed long, spans array<struct<lo: long, hi: long>>, kept_sha256 string"
    schema += ", kept binary" if keep_text else ""

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, removed, spans, digest, kept = [], [], [], [], []
            for text, marks in zip(batch.column("bytes"), batch.column("marks")):
                text, merged = text.as_py(), []
                if marks.is_valid:
                    lo, hi = (marks.values.field(i).to_numpy() for i in (0, 1))
                    order = np.argsort(lo, kind="stable")
                    lo, end = lo[order], np.maximum.accumulate(hi[order])
                    new = np.append(True, lo[1:] > end[:-1])
                    merged = list(zip(lo[new].tolist(), end[np.append(new[1:], True)].tolist()))
                edges = [0, *(x for s in merged for x in s), len(text)]
                rest = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])) if merged else text
                size.append(len(text))
                removed.append(len(text) - len(rest))
                spans.append([{"lo": a, "hi": b} for a, b in merged])
                digest.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest)
            columns = [batch.column("doc_id").cast(pa.int64()), pa.array(size, pa.int64()), pa.array(removed, pa.int64())]
            kind = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
            columns += [pa.array(spans, kind), pa.array(digest, pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "spans", "kept_sha256"]
            if keep_text:
                columns, names = [*columns, pa.array(kept, pa.binary())], [*names, "kept"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return map_arrow(rows, finish, schema)
