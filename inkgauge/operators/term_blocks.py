"""Counting terms in blocks of texts: words meet as codes, only different terms of a block travel, packed by part."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgauge.functions.stopwords import ENGLISH_STOP_WORDS
from inkgauge.operators import ngram_blocks
from inkgauge.session import ship

BLOCK_TOKENS = 1 << 20  # tokens of a block
PARTS = 1024  # parts that terms are dealt to, by hash
CELL_BYTES = 1 << 22  # packed terms, about, that are added up at once
ROWS = 1 << 16  # terms given back at once


def _flat(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(row, code, words) of the tokens, nulls left out."""
    lists = rows.column("tokens").chunks
    length = np.concatenate([np.diff(c.offsets.to_numpy()) for c in lists])
    coded = pa.concat_arrays([c.flatten() for c in lists]).dictionary_encode()
    code = coded.indices.fill_null(-1).to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(length)), length)
    return row[code >= 0], code[code >= 0], coded.dictionary


def _groups(rows: pa.Table, by: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(group of each row, a row of each group) by the columns `by`."""
    number = np.zeros(rows.num_rows, np.int64)
    for name in by:
        column = rows.column(name).combine_chunks()
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        codes = column.dictionary_encode(null_encoding="encode").indices.to_numpy().astype(np.int64)
        number = np.unique(number * (codes.max(initial=0) + 1) + codes, return_inverse=True)[1]
    groups, first = np.unique(number, return_index=True)
    return number, first


def _counted(key: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, total, rows that have it) of each different key."""
    keys = None
    if len(key) and (int(key.max()) + 1) * rows >= 1 << 62:
        keys, key = np.unique(key, return_inverse=True)
    both = np.sort(key * rows + row)
    at = np.flatnonzero(ngram_blocks._new(both))
    n = np.diff(at, append=len(both))
    key = both[at] // rows
    first = np.flatnonzero(ngram_blocks._new(key))
    total = np.add.reduceat(n, first) if len(first) else n
    key, df = key[first], np.diff(first, append=len(key))
    return key if keys is None else keys[key], total, df


def _cells(p: np.ndarray, text: pa.Array, total: np.ndarray, has: np.ndarray, group: np.ndarray | None) -> Iterator[tuple]:
    """(part, packed terms, groups of them) of terms with their parts."""
    order = np.argsort(p, kind="stable")
    p, total, has = p[order], total[order], has[order]
    text = text.take(pa.array(order)).cast(pa.large_binary())
    ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    letters = np.frombuffer(text.buffers()[2], np.uint8) if len(text) and text.buffers()[2] else np.empty(0, np.uint8)
    sizes = np.diff(ends)
    for part, at in ngram_blocks._slices(p):
        own = {} if group is None else dict(zip(("groups", "group"), np.unique(group[order[at]], return_inverse=True)))
        groups = own.pop("groups", None)
        planes = {"letters": letters[ends[at.start] : ends[at.stop]], "sizes": sizes[at], "total": total[at], "df": has[at], **own}
        yield part, ngram_blocks._packed(**planes), groups


def _added(rows: pa.Table, keys: list[str]) -> Iterator[pa.RecordBatch]:
    """(by, term, total, df) of the cells of whole parts."""
    found = [ngram_blocks._unpacked(cell.as_py()) for cell in rows.column("cell")]
    sizes = np.concatenate([x["sizes"] for x in found])
    letters = np.concatenate([x["letters"] for x in found])
    ends = np.r_[np.int64(0), np.cumsum(sizes)].astype(np.int64)
    coded = pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(ends), pa.py_buffer(letters)).dictionary_encode()
    key, first, values = coded.indices.to_numpy().astype(np.int64), np.zeros(1, np.int64), None
    if keys:
        # the groups of all cells, one after the other
        values = pa.table({k: pa.chunked_array([c.flatten() for c in rows.column(k).chunks]) for k in keys})
        base = np.cumsum([0, *(len(x) for x in rows.column(keys[0]))])
        number, first = _groups(values, keys)
        key = key * len(first) + number[np.concatenate([x["group"] + base[i] for i, x in enumerate(found)])]
    order = np.argsort(key, kind="stable")
    key = key[order]
    at = np.flatnonzero(ngram_blocks._new(key))
    total, has = (np.add.reduceat(np.concatenate([x[c] for x in found])[order], at) for c in ("total", "df"))
    term, group = key[at] // len(first), first[key[at] % len(first)]
    for lo in range(0, len(at), ROWS):
        part = slice(lo, lo + ROWS)
        own = [values.column(k).take(pa.array(group[part])).combine_chunks() for k in keys]
        own = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in own]
        text = coded.dictionary.take(pa.array(term[part])).cast(pa.string())
        yield pa.RecordBatch.from_arrays([*own, text, pa.array(total[part]), pa.array(has[part])], names=[*keys, "term", "total", "df"])


def count_terms(df: DataFrame, by: list[str], terms: Column, pairs: bool = False) -> DataFrame:
    """(by, term, total, df): occurrences and rows of each term.

    With `pairs`, `terms` are words; stop words are left out, and pairs of adjacent ones are terms too.
    A block sends its different terms, packed, to the part where the hash of their words puts them.
    """
    ship(df.sparkSession)
    size = min(BLOCK_TOKENS, ngram_blocks.BLOCK_TOKENS)
    stop = pa.array(sorted(ENGLISH_STOP_WORDS))
    keys = [f"_by{i}" for i in range(len(by))]
    rows = df.select(*[F.col(c).alias(k) for c, k in zip(by, keys)], terms.alias("tokens"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in ngram_blocks._batches(batches, size):
            row, code, words = _flat(block)
            group, first = _groups(block, keys)
            if pairs:
                use = ~pc.is_in(words, value_set=stop.cast(words.type)).to_numpy(zero_copy_only=False)[code]
                row, code = row[use], code[use]
            n, v = len(first), len(words)
            hashes = ngram_blocks._word_hashes(words)
            found = [(False, *_counted(code * n + group[row], row, block.num_rows))]
            if pairs:
                same = np.flatnonzero(row[1:] == row[:-1])
                key = (code[same] * v + code[same + 1]) * n + group[row[same]]
                found.append((True, *_counted(key, row[same], block.num_rows)))
            for two, key, total, has in found:
                if not len(key):
                    continue
                at = key // n
                if two:
                    a, b = at // v, at % v
                    part = ngram_blocks._part(ngram_blocks._pair_keys(hashes[a], hashes[b]), PARTS)
                    text = pc.binary_join_element_wise(words.take(pa.array(a)), words.take(pa.array(b)), " ")
                else:
                    part = ngram_blocks._part(ngram_blocks._mixed(hashes[at]), PARTS)
                    text = words.take(pa.array(at))
                part, cells, groups = zip(*_cells(part, text, total, has.astype(np.int64), key % n if keys else None))
                arrays = [pa.array(part, pa.int32()), pa.array(cells, pa.binary())]
                if keys:
                    ends, of = np.r_[0, np.cumsum([len(g) for g in groups])], pa.array(first[np.concatenate(groups)])
                    for k in keys:
                        own = block.column(k).take(of).combine_chunks()
                        own = own.combine_chunks() if isinstance(own, pa.ChunkedArray) else own
                        arrays.append(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), own))
                yield pa.RecordBatch.from_arrays(arrays, names=["part", "cell", *keys])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Cells come part by part; some whole parts are added up at once."""
        held, held_bytes = [], 0
        for batch in batches:
            held.append(batch)
            held_bytes += batch.nbytes
            part = batch.column("part").to_numpy()
            if held_bytes < CELL_BYTES or not len(part):
                continue
            table = pa.Table.from_batches(held)
            ready = int(np.searchsorted(table.column("part").to_numpy(), part[-1]))
            yield from _in_turn(table.slice(0, ready), keys)
            held = [b for b in table.slice(ready).to_batches() if len(b)]
            held_bytes = sum(b.nbytes for b in held)
        if any(len(b) for b in held):
            yield from _in_turn(pa.Table.from_batches(held), keys)

    kinds = {k: rows.schema[k].dataType.simpleString() for k in keys}
    lists = "".join(f", {k} array<{t}>" for k, t in kinds.items())
    cells = rows.mapInArrow(split, "part int, cell binary" + lists).repartition("part").sortWithinPartitions("part")
    counted = cells.mapInArrow(add, ", ".join([*(f"{k} {t}" for k, t in kinds.items()), "term string, total long, df long"]))
    return counted.select(*[F.col(k).alias(c) for c, k in zip(by, keys)], "term", "total", "df")


def _in_turn(table: pa.Table, keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Sums of cells in the order of their parts, as many whole parts at once as are about CELL_BYTES."""
    if not len(table):
        return
    size = np.cumsum(pc.binary_length(table.column("cell")).to_numpy().astype(np.int64))
    part, lo = table.column("part").to_numpy(), 0
    while lo < len(part):
        hi = int(np.searchsorted(size, (size[lo - 1] if lo else 0) + CELL_BYTES))
        hi = int(np.searchsorted(part, part[min(hi, len(part) - 1)], side="right"))
        yield from _added(table.slice(lo, hi - lo), keys)
        lo = hi
