"""Counting and looking up n-grams in blocks of texts.

A block holds whole texts of about `BLOCK_TOKENS` tokens. It sends each different n-gram once, packed, to
the part of the count tables where a hash of its words puts it, so what moves grows with the different
n-grams of the blocks and not with rows of strings.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgauge.session import ship, stored

BLOCK_TOKENS = 1 << 21
PART_KEYS = 1 << 22  # n-grams, asked or counted, that one part holds, about
PART_CHARACTERS = 1 << 24  # characters of text whose pairs one part counts, about
UNIGRAM, PREFIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
NO_FOLD = -1


def _packed(**arrays: np.ndarray) -> bytes:
    """Arrays of any lengths, byte by byte of their numbers, compressed."""
    planes = {
        k: (a.dtype.str, np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()) for k, a in arrays.items()
    }
    plain = pickle.dumps(planes)
    return len(plain).to_bytes(8, "little") + pa.compress(plain, "zstd", asbytes=True)


def _unpacked(cell: bytes) -> dict[str, np.ndarray]:
    planes = pickle.loads(pa.decompress(cell[8:], int.from_bytes(cell[:8], "little"), "zstd", asbytes=True))
    out = {}
    for name, (kind, plain) in planes.items():
        size = np.dtype(kind).itemsize
        out[name] = np.ascontiguousarray(np.frombuffer(plain, np.uint8).reshape(size, -1).T).view(kind).ravel()
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    """Bijection of 64 bits that spreads every bit over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _pair_keys(prev: np.ndarray, term: np.ndarray) -> np.ndarray:
    """Of the hashes of two words."""
    return _mixed(_mixed(prev) + _mixed(term ^ UNIGRAM) * np.uint64(3))


def _part(keys: np.ndarray, parts: int) -> np.ndarray:
    """Ranges of keys, in their order."""
    part = ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    return part.astype(np.uint16 if parts <= 1 << 16 else np.int64)


def _word_hashes(words: pa.Array) -> np.ndarray:
    return pd.util.hash_array(words.to_numpy(zero_copy_only=False).astype(object), categorize=False)


def _batches(parts: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """Rows with `tokens` (list of strings) in tables of about `size` tokens, texts whole."""
    held, tokens = [], 0
    for part in parts:
        lengths = np.diff(part.column("tokens").offsets.to_numpy())
        number = np.cumsum(lengths, dtype=np.int64) // size
        for n in np.unique(number):
            at = np.flatnonzero(number == n)
            held.append(part.slice(at[0], len(at)))
            tokens += int(lengths[at].sum())
            if tokens >= size:
                yield pa.Table.from_batches(held)
                held, tokens = [], 0
    if held:
        yield pa.Table.from_batches(held)


@dataclass
class Block:
    """Texts as codes of words; the words are `words` or, in a stored block, their hashes."""

    fold: np.ndarray  # by text
    length: np.ndarray  # tokens by text
    codes: np.ndarray
    words: pa.Array | np.ndarray

    @classmethod
    def of(cls, rows: pa.Table) -> Block:
        lists = [c for c in rows.column("tokens").chunks]
        flat = pa.chunked_array([c.flatten() for c in lists], lists[0].type.value_type).combine_chunks()
        coded = (pa.concat_arrays(flat.chunks) if isinstance(flat, pa.ChunkedArray) else flat).dictionary_encode()
        fold = rows.column("fold").cast(pa.int32()).fill_null(NO_FOLD).to_numpy()
        length = np.concatenate([np.diff(c.offsets.to_numpy()) for c in lists])
        return cls(fold, length, coded.indices.to_numpy(), coded.dictionary)

    def pairs(self, start: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, code before, code) of the pairs; `start` adds the first tokens, with the code -1 before."""
        text = np.repeat(np.arange(len(self.length)), self.length)
        before = np.r_[np.int32(-1), self.codes[:-1]][: len(self.codes)].astype(np.int64)
        first = np.ones(len(text), bool)
        first[1:] = text[1:] != text[:-1]
        before[first] = -1
        use = slice(None) if start else ~first
        return text[use], before[use], self.codes[use].astype(np.int64)


def _slices(part: np.ndarray) -> Iterator[tuple[int, slice]]:
    """(part, rows) of a sorted array of parts."""
    if len(part):
        at = np.r_[0, np.flatnonzero(np.diff(part)) + 1, len(part)]
        for lo, hi in zip(at[:-1].tolist(), at[1:].tolist()):
            yield int(part[lo]), slice(lo, hi)


# counting


def _new(*sorted_columns: np.ndarray) -> np.ndarray:
    """Where a row of sorted columns differs from the one before."""
    new = np.ones(len(sorted_columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in sorted_columns])
    return new


def _counted(prev: np.ndarray, term: np.ndarray, fold: np.ndarray, words: int, n: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(prev, term, fold, n) of codes below `words`, `prev` from -1, with equal rows added up, sorted."""
    folds, at_fold = np.unique(fold, return_inverse=True)
    row = ((prev + 1) * words + term) * len(folds) + at_fold
    if n is None:
        row.sort()
        at = np.flatnonzero(_new(row))
        n = np.diff(at, append=len(row))
    else:
        order = np.argsort(row)
        row = row[order]
        at = np.flatnonzero(_new(row))
        n = np.add.reduceat(n[order], at)
    row = row[at]
    pair = row // len(folds)
    prev = pair // words
    return prev - 1, pair - prev * words, folds[row - pair * len(folds)], n


def count_pairs(df: DataFrame, tokens: Column, characters: int, folds: int | None = None, start: bool = False) -> DataFrame:
    """(fold, prev, term, n), or with `folds` (prev, term, bi, bi_by_fold), of `df` (fold, ...) and its tokens.

    `characters` is the length of all texts, from which the number of parts follows. `start` counts the
    first token of a text as a pair with a null `prev`.
    """
    spark, size = df.sparkSession, BLOCK_TOKENS
    ship(spark)
    parts = max(spark.sparkContext.defaultParallelism, -(-characters // PART_CHARACTERS))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _batches(batches, size):
            block = Block.of(rows)
            text, prev, term = block.pairs(start)
            fold = block.fold[text].astype(np.int64)
            if not len(prev):
                continue
            prev, term, fold, n = _counted(prev, term, fold, len(block.words))
            hashes = np.r_[_word_hashes(block.words), np.uint64(0)]  # the last one is that of no word
            part = _part(_pair_keys(hashes[prev], hashes[term]), parts)
            order = np.argsort(part, kind="stable")
            part, prev, term, fold, n = part[order], prev[order], term[order], fold[order], n[order]
            for p, at in _slices(part):
                used, codes = np.unique(np.r_[prev[at], term[at]], return_inverse=True)
                known = used[used >= 0]
                shift, half = len(used) - len(known), at.stop - at.start
                codes = (codes - shift).astype(np.int32)
                words = block.words.take(pa.array(known)).cast(pa.large_binary())
                ends = np.frombuffer(words.buffers()[1], np.int64)[: len(words) + 1]
                letters = np.frombuffer(words.buffers()[2], np.uint8)[ends[0] : ends[-1]]
                cell = _packed(
                    letters=letters, sizes=np.diff(ends), prev=np.diff(codes[:half], prepend=np.int32(0)), term=codes[half:], fold=fold[at], n=n[at]
                )
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([cell], pa.binary())], names=["part", "cell"])

    wide = folds is not None
    counts = "bi long, bi_by_fold array<long>" if wide else "fold int, n long"

    def add(rows: pa.Table) -> pa.Table:
        words, found, base = [], [], 0
        for cell in rows.column("cell"):
            x = _unpacked(cell.as_py())
            ends = np.r_[np.int64(0), np.cumsum(x["sizes"])].astype(np.int64)
            words.append(pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), pa.py_buffer(x["letters"])))
            prev = np.cumsum(x["prev"])
            found.append((np.where(prev < 0, -1, prev + base), x["term"] + np.int64(base), x["fold"], x["n"]))
            base += len(ends) - 1
        coded = pa.concat_arrays(words).dictionary_encode()
        code = np.r_[coded.indices.to_numpy().astype(np.int64), -1]
        prev, term, fold, n = (np.concatenate(c) for c in zip(*found))
        prev, term, fold, n = _counted(code[prev], code[term], fold, len(coded.dictionary), n)
        texts = coded.dictionary.cast(pa.string())
        if wide:
            new = _new(prev, term)
            at = np.flatnonzero(new)
            row = np.cumsum(new) - 1
            by_fold, own = np.zeros((len(at), folds), np.int64), (fold >= 0) & (fold < folds)
            by_fold[row[own], fold[own]] = n[own]
            prev, term = prev[at], term[at]
            lists = pa.ListArray.from_arrays(np.arange(len(at) + 1, dtype=np.int32) * folds, pa.array(by_fold.ravel()))
            last = {"bi": pa.array(np.add.reduceat(n, at)), "bi_by_fold": lists}
        else:
            last = {"fold": pa.array(fold.astype(np.int32), mask=fold < 0), "n": pa.array(n)}
        return pa.table({"prev": texts.take(pa.array(prev, mask=prev < 0)), "term": texts.take(pa.array(term)), **last})

    cells = df.select("fold", tokens.alias("tokens")).mapInArrow(split, "part int, cell binary")
    return cells.groupBy("part").applyInArrow(add, f"prev string, term string, {counts}")


# looking up


def text_blocks(df: DataFrame, key: str, tokens: Column) -> DataFrame:
    """(block, keys, n, cell) of `df` (key, fold), stored: texts as codes of words with their hashes."""
    ship(df.sparkSession)
    size = BLOCK_TOKENS
    kind = df.schema[key].dataType.simpleString()

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        for i, rows in enumerate(_batches(batches, size)):
            # here, because Spark would match the pattern again for a condition on tokens
            rows = rows.filter(pc.greater(pc.list_value_length(rows.column("tokens")), 1))
            if not len(rows):
                continue
            block = Block.of(rows)
            cell = _packed(fold=block.fold, length=block.length, codes=block.codes, words=_word_hashes(block.words))
            keys = rows.column("key").combine_chunks()
            keys = keys.combine_chunks() if isinstance(keys, pa.ChunkedArray) else keys
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([(TaskContext.get().partitionId() << 32) + i], pa.int64()),
                    pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys),
                    pa.array([len(block.codes)], pa.int64()),
                    pa.array([cell], pa.binary()),
                ],
                names=["block", "keys", "n", "cell"],
            )

    rows = df.select(F.col(key).alias("key"), "fold", tokens.alias("tokens"))
    return stored(rows.mapInArrow(code, f"block long, keys array<{kind}>, n long, cell binary"), "lm-blocks")


def _asked(x: dict[str, np.ndarray], parts: int) -> dict[str, np.ndarray]:
    """What a block asks for, sorted by part and key, and where its pairs find the answers."""
    block = Block(x["fold"], x["length"], x["codes"], x["words"])
    text, prev, term = block.pairs()
    folds, fold = np.unique(block.fold, return_inverse=True)
    fold, v = fold[text].astype(np.int64), len(block.words)
    pairs, of_pair = np.unique((fold * v + prev) * v + term, return_inverse=True)
    before = pairs // v  # with the fold
    fold = before // v
    prev, term = before - fold * v, pairs - before * v
    terms, of_term = _numbered(fold * v + term, len(folds) * v)
    prevs, of_prev = _numbered(before, len(folds) * v)
    h = _mixed(block.words)
    keys = np.r_[_pair_keys(block.words[prev], block.words[term]), _mixed(h ^ UNIGRAM)[terms % v], _mixed(h ^ PREFIX)[prevs % v]]
    own = folds.astype(np.int32)[np.r_[fold, terms // v, prevs // v]]
    order = np.argsort(keys)
    keys = keys[order]
    return {
        "text": text, "of_pair": of_pair, "order": order, "part": _part(keys, parts), "keys": keys, "fold": own[order],
        "pair_fold": folds[fold], "of_term": len(pairs) + of_term, "of_prev": len(pairs) + len(terms) + of_prev,
    }


def _numbered(x: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Different values of `x`, which are below `limit`, and the place of each among them."""
    seen = np.zeros(limit, bool)
    seen[x] = True
    return np.flatnonzero(seen), (np.cumsum(seen) - 1)[x]


def _differences(keys: np.ndarray) -> np.ndarray:
    return np.diff(keys, prepend=np.uint64(0))


_CELLS = "part int, block long, cell binary"


def _row(part: int, block: int | None, cell: bytes) -> pa.RecordBatch:
    arrays = [pa.array([part], pa.int32()), pa.array([block], pa.int64()), pa.array([cell], pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, names=["part", "block", "cell"])


def _count_cells(table: DataFrame, words: list[str], total: str, salt: np.uint64 | None, parts: int) -> DataFrame:
    """(part, null, cell) of the counts of one table of a model."""

    def pack(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held)
        hashes = []
        for name in words:
            coded = pa.chunked_array(rows.column(name).chunks).combine_chunks()
            coded = (coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded).dictionary_encode()
            hashes.append(_word_hashes(coded.dictionary)[coded.indices.to_numpy()])
        keys = _pair_keys(*hashes) if salt is None else _mixed(_mixed(hashes[0]) ^ salt)
        order = np.argsort(keys)
        count = rows.column("total").to_numpy()[order]
        by_fold = np.concatenate([c.flatten().to_numpy() for c in rows.column("by_fold").chunks]).reshape(len(keys), -1)[order]
        keys = keys[order]
        for p, at in _slices(_part(keys, parts)):
            cell = _packed(keys=_differences(keys[at]), total=count[at], by_fold=by_fold[at].ravel())
            yield _row(p, None, cell)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= BLOCK_TOKENS:
                yield from pack(held)
                held, n = [], 0
        if n:
            yield from pack(held)

    rows = table.select(*words, F.col(total).alias("total"), F.col(f"{total}_by_fold").alias("by_fold"))
    return rows.mapInArrow(run, _CELLS)


def with_counts(blocks: DataFrame, model, key_type: str, score: Callable, columns: str) -> DataFrame:
    """(key, columns) of the stored texts: `score(fold, bi, pre, uni)` of their pairs, added up by text, and `n`.

    The counts are those of `model` without the fold of the text, 0 where it has none. N-grams are told
    apart by 64 bits; two n-grams of the model with the same bits are an error.
    """
    spark = blocks.sparkSession
    ship(spark)
    asked = blocks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    rows = asked + model.distinct_pairs + 2 * model.vocabulary
    parts = max(spark.sparkContext.defaultParallelism, -(-rows // PART_KEYS))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, cell in zip(batch.column("block").to_pylist(), batch.column("cell")):
                x = _asked(_unpacked(cell.as_py()), parts)
                for p, at in _slices(x["part"]):
                    yield _row(p, block, _packed(keys=_differences(x["keys"][at]), fold=x["fold"][at]))

    def answer(rows: pa.Table) -> pa.Table:
        counts, questions = [], []
        for block, cell in zip(rows.column("block").to_pylist(), rows.column("cell")):
            if block is None:
                counts.append(_unpacked(cell.as_py()))
            else:
                questions.append((block, cell))
        keys = np.concatenate([np.cumsum(c["keys"], dtype=np.uint64) for c in counts]) if counts else np.empty(0, np.uint64)
        order = np.argsort(keys)
        keys = keys[order]
        if (keys[1:] == keys[:-1]).any():
            raise ValueError("two n-grams of the model have the same hash")
        if len(keys):
            total = np.concatenate([c["total"] for c in counts])[order]
            by_fold = np.concatenate([c["by_fold"].reshape(len(c["keys"]), -1) for c in counts])[order]
        out = []
        for block, cell in questions:
            x = _unpacked(cell.as_py())
            wanted, fold, others = np.cumsum(x["keys"], dtype=np.uint64), x["fold"], np.zeros(len(x["keys"]), np.int64)
            if len(keys):
                at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                own = np.where((fold >= 0) & (fold < by_fold.shape[1]), by_fold[at, np.clip(fold, 0, by_fold.shape[1] - 1)], 0)
                others = np.where(keys[at] == wanted, total[at] - own, 0)
            out.append((rows.column("part")[0].as_py(), block, _packed(others=others)))
        return pa.table([list(c) for c in zip(*out)] if out else [[], [], []], schema=cells)

    cells = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("cell", pa.binary())])

    def finish(rows: pa.Table) -> pa.Table:
        order = np.argsort(rows.column("part").to_numpy())
        texts, *answers = [rows.column("cell")[int(i)].as_py() for i in order]  # the texts have the part -1
        keys = rows.column("keys")[int(order[0])].values
        x = _unpacked(texts)
        q = _asked(x, parts)
        found = np.empty(len(q["order"]), np.int64)
        found[q["order"]] = np.concatenate([_unpacked(a)["others"] for a in answers])
        scores = score(q["pair_fold"], found[: len(q["pair_fold"])], found[q["of_prev"]], found[q["of_term"]])
        n = len(keys)
        sums = [np.bincount(q["text"], s[q["of_pair"]], n) for s in scores]
        return pa.table([keys, *sums, np.bincount(q["text"], minlength=n)], names=names)

    names = ["key", *[c.split()[0] for c in columns.split(", ")], "n"]
    counted = [
        _count_cells(model.bigrams, ["prev", "term"], "bi", None, parts),
        _count_cells(model.prefixes, ["prev"], "pre", PREFIX, parts),
        _count_cells(model.unigrams, ["term"], "uni", UNIGRAM, parts),
    ]
    meeting = blocks.select("block", "cell").mapInArrow(ask, _CELLS)
    for c in counted:
        meeting = meeting.unionByName(c)
    answers = meeting.groupBy("part").applyInArrow(answer, _CELLS)
    none = F.lit(None).cast(f"array<{key_type}>").alias("keys")
    both = answers.select("part", "block", "cell", none).unionByName(
        blocks.select(F.lit(-1).alias("part"), "block", "cell", "keys")
    )
    return both.groupBy("block").applyInArrow(finish, f"key {key_type}, {columns}, n long")
