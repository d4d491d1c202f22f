"""Log probabilities of texts under a Katz backoff model of the corpus.

Good-Turing discounted n-gram counts; what the discount frees is given to unseen continuations in
proportion to the next shorter history, with the weight that makes the probabilities of every history
sum to one. The shortest history has the discounted word counts, and one unknown word that takes what
their discount frees.

    P(w|h) = disc(c(hw)) / c(h)         if hw occurs in the training texts
           = weight(h) * P(w|h')        otherwise; h' is h without its first word, weight(h) 1 if h is new
    weight(h) = (1 - sum of P(w|h)) / (1 - sum of P(w|h')), both sums over the w seen after h

The texts become batches of word numbers, about BATCH bytes of text each. Per order, every batch sends
its different n-grams once, as sorted keys, to the parts of the count table; each part adds them up,
keeps its piece of the table and replies with the totals. So a frequent n-gram is one entry per batch
and no part or batch grows beyond its size. Of the batches that hold an n-gram one is its owner, which
adds it to the sums of its history; those parts make the weights that held-out texts ask for. N-grams
are told apart by 64 bits of a hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgauge.llm.common import map_arrow, ship, spent, stored, take
from inkgauge.llm.shingles import FACTORS, mix, word_hashes

ORDER = 3
CUT = 5  # counts up to this are discounted by Good-Turing, higher ones lose as much as this one does
BATCH = 6 << 20  # bytes of text
PART = 2 << 20  # n-grams of a part, about, counted once per batch
PIECE = 2 << 20  # bytes hashed at once
BEGIN, END = np.uint64(0x1F3A5C7E9B2D4F61), np.uint64(0x6B8DAFC1E3052749)


# packed columns


def planes(values: np.ndarray) -> bytes:
    """Whole numbers as planes of their bytes, empty high planes left out."""
    values = np.ascontiguousarray(values, dtype=np.uint64)
    n = (int(values.max()).bit_length() + 7) // 8 if len(values) else 0
    return values.view(np.uint8).reshape(-1, 8)[:, :n].T.tobytes()


def unplanes(blob: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    if blob:
        data = np.frombuffer(blob, np.uint8).reshape(-1, n)
        out[:, : len(data)] = data.T
    return out.view(np.uint64).ravel()


def pack_keys(keys: np.ndarray) -> bytes:
    """Ascending keys as steps."""
    return planes(np.diff(keys, prepend=np.uint64(0)))


def unpack_keys(blob: bytes, n: int) -> np.ndarray:
    return np.cumsum(unplanes(blob, n), dtype=np.uint64)


def pack_bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def unpack_bits(blob: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(blob, np.uint8), count=n).astype(bool)


def pack_counts(values: np.ndarray) -> bytes:
    """Whole numbers, most of them zero or small: how many planes, then these compressed."""
    data = planes(values.ravel())
    return bytes([len(data) // values.size]) + pa.compress(data, codec="zstd", asbytes=True) if data else b""


def unpack_counts(blob: bytes, *shape: int) -> np.ndarray:
    n = int(np.prod(shape))
    data = pa.decompress(blob[1:], blob[0] * n, codec="zstd", asbytes=True) if blob else b""
    return unplanes(data, n).astype(np.int64).reshape(shape)


def part_bounds(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each of `parts` equal ranges of keys begins among ascending `keys`."""
    at = np.array([i * 2**64 // parts for i in range(1, parts)], dtype=np.uint64)
    return np.r_[0, np.searchsorted(keys, at), len(keys)]


# batches


def hashed_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first byte) of all words, in pieces that end between words."""
    found, lo = [], 0
    view = np.frombuffer(data, np.uint8)
    gaps = np.flatnonzero((view == 32) | ((view >= 9) & (view <= 13)))
    while lo < len(data):
        at = np.searchsorted(gaps, lo + PIECE)
        hi = int(gaps[at]) if at < len(gaps) else len(data)
        hashes, start = word_hashes(view[lo:hi])
        found.append((hashes, start + lo))
        lo = hi + 1
    if not found:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def token_batches(docs: DataFrame, size: int) -> DataFrame:
    """(batch, doc_id, held, length, words, tokens): different words as hashes, texts as numbers of them.

    `length` counts the words of a text and its end; `tokens` holds every text's words, then its end.
    The most frequent words come first, which leaves small numbers.
    """

    def made(batch: int, ids: list, held: list, texts: list[bytes]) -> pa.RecordBatch:
        hashes, start = hashed_words(b" ".join(texts))
        edge = np.cumsum([len(t) + 1 for t in texts])
        count = np.diff(np.searchsorted(start, edge), prepend=0)
        length = count + 1
        stream = np.empty(len(hashes) + len(texts), np.uint64)
        last = np.cumsum(length) - 1
        word = np.ones(len(stream), bool)
        word[last] = False
        stream[word], stream[last] = hashes, END
        words, tokens = np.unique(stream, return_inverse=True)
        frequent = np.argsort(-np.bincount(tokens), kind="stable")
        number = np.empty(len(words), np.int64)
        number[frequent] = np.arange(len(words))
        arrays = [
            pa.array([batch], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([held], pa.list_(pa.bool_())),
            pa.array([length], pa.list_(pa.int64())), pa.array([words[frequent].tobytes()]),
            pa.array([pa.compress(planes(number[tokens]), codec="zstd", asbytes=True)]),
        ]
        return pa.RecordBatch.from_arrays(arrays, names=["batch", "doc_id", "held", "length", "words", "tokens"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        ids, held, texts, held_bytes = [], [], [], 0
        for batch in batches:
            column = pc.cast(batch.column("text"), pa.binary())
            names, out = batch.column("doc_id"), batch.column("held")
            for i in range(batch.num_rows):
                text = column[i].as_py() or b""
                ids.append(names[i].as_py()), held.append(out[i].as_py()), texts.append(text)
                held_bytes += len(text) + 1
                if held_bytes >= size:
                    yield made(number, ids, held, texts)
                    ids, held, texts, held_bytes, number = [], [], [], 0, number + 1
        if ids:
            yield made(number, ids, held, texts)

    schema = "batch long, doc_id array<long>, held array<boolean>, length array<long>, words binary, tokens binary"
    return stored(map_arrow(docs, run, schema), "batches")


@dataclass
class Level:
    """The different n-grams of one order in a batch, ascending by key."""

    keys: np.ndarray
    gram: np.ndarray  # number of the n-gram that ends at each place, -1 for none
    place: np.ndarray  # a place where the n-gram ends


def _level(key: np.ndarray, ends: np.ndarray) -> Level:
    """`key` of the n-gram that ends at each place where `ends` holds."""
    at = np.flatnonzero(ends)
    bits = np.uint64(len(key).bit_length())
    # places in the low bits of their keys: sorting whole numbers is several times faster than their places
    by = (np.sort((key[at] >> bits << bits) | at.astype(np.uint64)) & np.uint64((1 << int(bits)) - 1)).astype(np.int64)
    ordered = key[by]
    if (ordered[1:] < ordered[:-1]).any():  # two keys that differ in those bits only
        by = at[np.argsort(key[at])]
        ordered = key[by]
    new = np.r_[True, ordered[1:] != ordered[:-1]] if len(by) else np.empty(0, bool)
    gram = np.full(len(key), -1, np.int64)
    gram[by] = np.cumsum(new) - 1
    return Level(ordered[new], gram, by[new])


class Batch:
    """One row of the batch table, its texts with a begin mark before each."""

    def __init__(self, row: dict):
        self.length = np.array(row["length"], dtype=np.int64)
        self.held_text = np.array(row["held"], dtype=bool)
        stored_words = np.frombuffer(row["words"], np.uint64)
        ascending = np.argsort(stored_words)
        words = stored_words[ascending]
        self.text = np.repeat(np.arange(len(self.length)), self.length + 1)
        first = np.cumsum(self.length + 1) - self.length - 1
        self.word = np.ones(len(self.text), bool)
        self.word[first] = False
        self.hash = np.full(len(self.text), BEGIN, np.uint64)
        total = int(self.length.sum())
        size = (max(len(words) - 1, 0).bit_length() + 7) // 8 * total
        place_of = np.empty(len(words), np.int64)
        place_of[ascending] = np.arange(len(words))
        tokens = place_of[unplanes(pa.decompress(row["tokens"], size, codec="zstd", asbytes=True), total).view(np.int64)]
        self.hash[self.word] = words[tokens]
        self.held = self.held_text[self.text]
        # the words are in order already, the begin mark goes between them
        at = int(np.searchsorted(words, BEGIN))
        place = np.zeros(len(words) + 1, np.int64)
        gram = np.full(len(self.text), at)
        gram[self.word] = tokens + (tokens >= at)
        place[gram] = np.arange(len(gram))
        self.levels = [Level(np.insert(words, at, BEGIN), gram, place)]
        self.key, self.ends = self.hash, np.ones(len(self.text), bool)

    def grow(self, order: int) -> Batch:
        while len(self.levels) < order:
            # an n-gram ends where a word follows an n-gram that is one shorter
            key = np.zeros(len(self.key), np.uint64)
            key[1:] = mix(self.key[:-1] * np.uint64(FACTORS[0]) + self.hash[1:] * np.uint64(FACTORS[1]) + np.uint64(len(self.levels)))
            self.key, self.ends = key, self.word & np.r_[False, self.ends[:-1]]
            self.levels.append(_level(self.key, self.ends))
        return self

    def history(self, order: int) -> np.ndarray:
        """By n-gram of `order`: number of the n-gram without its last word."""
        return self.levels[order - 2].gram[self.levels[order - 1].place - 1]

    def shorter(self, order: int) -> np.ndarray:
        """By n-gram of `order`: number of the n-gram without its first word."""
        return self.levels[order - 2].gram[self.levels[order - 1].place]


def _row(batch: pa.RecordBatch | pa.Table, i: int) -> dict:
    return {name: batch.column(name)[i].as_py() for name in batch.schema.names}


# counts


def send_counts(batches: DataFrame, order: int, parts: int, asking: bool) -> DataFrame:
    """(part, batch, n, keys, counts, asked): a batch's n-grams, how often training texts hold them, held-out histories."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for i in range(batch.num_rows):
                row = _row(batch, i)
                b = Batch(row).grow(order)
                level = b.levels[-1]
                some = level.gram >= 0
                count = np.bincount(level.gram[some & ~b.held], minlength=len(level.keys))
                asked = np.zeros(len(level.keys), bool)
                if asking:
                    before = np.r_[b.word[1:], False] & b.held & some  # a word of the same text follows
                    asked[level.gram[before]] = True
                bounds = part_bounds(level.keys, parts)
                out: list[list] = [[], [], [], [], [], []]
                for p, (lo, hi) in enumerate(zip(bounds.tolist(), bounds[1:].tolist())):
                    if hi > lo:
                        values = p, row["batch"], hi - lo, pack_keys(level.keys[lo:hi]), pack_counts(count[lo:hi]), pack_bits(asked[lo:hi])
                        for column, value in zip(out, values):
                            column.append(value)
                kinds = pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()
                names = ["part", "batch", "n", "keys", "counts", "asked"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=names)

    return map_arrow(batches, run, "part int, batch long, n long, keys binary, counts binary, asked binary")


COUNTED = "part int, batch long, n long, keys binary, counts binary, owned binary, wanted binary, of_counts array<long>, total long"


def add_counts(rows: pa.Table, tables: bool) -> pa.Table:
    """One part: its piece of the count table (`batch` null), and the reply to each batch in the order of its keys.

    Without `tables` the piece has its totals only.
    """
    rows = rows.sort_by("batch")
    sizes = rows.column("n").to_pylist()
    keys = np.concatenate([unpack_keys(k.as_py(), n) for k, n in zip(rows.column("keys"), sizes)])
    counts = np.concatenate([unpack_counts(c.as_py(), n) for c, n in zip(rows.column("counts"), sizes)])
    asked = np.concatenate([unpack_bits(a.as_py(), n) for a, n in zip(rows.column("asked"), sizes)])
    own, at = np.unique(keys, return_inverse=True)
    total = np.zeros(len(own), np.int64)
    np.add.at(total, at, counts)
    wanted = np.zeros(len(own), bool)
    wanted[at[asked]] = True
    first = np.full(len(own), len(keys), np.int64)
    trained = np.flatnonzero(counts)
    np.minimum.at(first, at[trained], trained)
    owned = np.zeros(len(keys), bool)
    owned[first[first < len(keys)]] = True
    seen = total > 0
    plain = total[seen & (own != BEGIN)]  # the begin mark is no word
    low = np.bincount(plain[plain <= CUT + 1], minlength=CUT + 2)[1:]
    part = rows.column("part")[0].as_py()
    piece = (pack_keys(own[seen]), pack_counts(total[seen])) if tables else (None, None)
    out = [(part, None, int(seen.sum()), *piece, None, None, [*low.tolist(), len(plain)], int(plain.sum()))]
    lo = 0
    for batch, n in zip(rows.column("batch").to_pylist(), sizes):
        own_at = at[lo : lo + n]
        out.append((part, batch, n, None, pack_counts(total[own_at]), pack_bits(owned[lo : lo + n]), pack_bits(wanted[own_at]), None, None))
        lo += n
    kinds = pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.int64()
    return pa.table([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)], names=[c.split()[0] for c in COUNTED.split(", ")])


@dataclass(frozen=True)
class Discount:
    """Good-Turing discounts of one order.

    `ratios[r - 1]` is the share of a count r up to CUT that stays, Katz's formula where it lies between
    0 and 1 and an absolute discount elsewhere, as counts of copied texts need not be smooth. Higher
    counts lose what CUT loses, so every history has some mass left for unseen words.
    """

    ratios: tuple[float, ...]

    @classmethod
    def of(cls, n: list[int]) -> Discount:
        """`n[r - 1]`: how many n-grams occur r times, up to CUT + 1."""
        lost = (n[0] + 0.5) / (n[0] + 2 * n[1] + 1)
        ratios = []
        for r in range(1, CUT + 1):
            ratio = 0.0
            if n[0] and n[r - 1]:
                rest = (CUT + 1) * n[CUT] / n[0]
                ratio = ((r + 1) * n[r] / (r * n[r - 1]) - rest) / (1 - rest) if rest < 1 else 0.0
            ratios.append(ratio if 0 < ratio < 1 else (r - lost) / r)
        return cls(tuple(ratios))

    @property
    def losses(self) -> np.ndarray:
        """What a count of 0, 1, ... CUT loses."""
        return np.array([0.0, *[r * (1 - x) for r, x in enumerate(self.ratios, 1)]])

    def lost(self, counts: np.ndarray) -> np.ndarray:
        return self.losses[np.minimum(counts, CUT)]

    def kept(self, counts: np.ndarray) -> np.ndarray:
        return counts - self.lost(counts)


@dataclass(frozen=True)
class Model:
    """Discounts by order, training tokens, different words, and what the word discount frees."""

    discounts: tuple[Discount, ...]
    tokens: int
    words: int
    freed: float

    def word_probability(self, counts: np.ndarray) -> np.ndarray:
        if not self.tokens:
            return np.ones(len(counts))
        return np.where(counts > 0, self.discounts[0].kept(counts), self.freed) / self.tokens

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.5) / (self.tokens + 0.5 * (self.words + 1)))


def count_table(batches: DataFrame, order: int, parts: int, asking: bool, tables: bool) -> DataFrame:
    def run(rows: pa.Table) -> pa.Table:
        return add_counts(rows, tables)

    sent = send_counts(batches, order, parts, asking)
    return stored(sent.groupBy("part").applyInArrow(run, COUNTED), f"counts-{order}")


def _statistics(table: DataFrame) -> tuple[list[int], int, int]:
    """(how many n-grams occur 1, 2, ... CUT + 1 times, different n-grams, occurrences)"""
    sums = [F.sum(F.get("of_counts", F.lit(i))).alias(str(i)) for i in range(CUT + 2)]
    *low, different, total = [x or 0 for x in table.where("batch IS NULL").agg(*sums, F.sum("total").alias("total")).first()]
    return low, different, total


# weights


def _replies(rows: pa.Table, order: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(counts, owned, wanted) of a batch's n-grams of one order."""
    some = rows.filter(pc.equal(rows.column("order"), order)).sort_by("part")
    sizes = some.column("n").to_pylist()
    assert sum(sizes) == n, "a part's reply is missing"
    join = lambda name, of: [of(x.as_py(), k) for x, k in zip(some.column(name), sizes)]
    if not sizes:
        return np.empty(0, np.int64), np.empty(0, bool), np.empty(0, bool)
    counts = np.concatenate(join("counts", unpack_counts))
    return counts, np.concatenate(join("owned", unpack_bits)), np.concatenate(join("wanted", unpack_bits))


class Counted:
    """A batch with the counts of its n-grams."""

    def __init__(self, row: dict, replies: pa.Table, order: int):
        self.b = Batch(row).grow(order)
        got = [_replies(replies, k, len(level.keys)) for k, level in enumerate(self.b.levels, 1)]
        self.counts, self.owned, self.wanted = ([g[i] for g in got] for i in range(3))

    def of_history(self, order: int) -> np.ndarray:
        return self.counts[order - 2][self.b.history(order)]

    def asks(self, order: int) -> np.ndarray:
        """Histories of `order` - 1 words that held-out texts go on from in an unseen way."""
        level = self.b.levels[order - 1]
        at = np.flatnonzero((level.gram >= 0) & self.b.held)
        at = at[self.counts[order - 1][level.gram[at]] == 0]
        histories = np.unique(self.b.levels[order - 2].gram[at - 1])
        return histories[self.counts[order - 2][histories] > 0]


WEIGHED = "order int, part int, batch long, n long, keys binary, weights binary"


def send_masses(batches: DataFrame, replies: DataFrame, model: Model, order: int, parts: int) -> DataFrame:
    """(order, part, batch, n, keys, of_counts, sums; asking, asked, counts, below)

    Per history with owned n-grams: how many of them occur 1, 2, ... CUT or more times, the same of
    what they are one order below, and the sum of the counts there. From these whole numbers the
    discounts give what is left over and what is seen below, the same in whatever order they are added.
    Per history that the batch asks for: its count and that of the one a word shorter.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = _row(left, 0)
        c = Counted(row, right, order)
        out: list[tuple] = []
        for k in range(2, order + 1):
            own = np.flatnonzero(c.owned[k - 1])
            history = c.b.history(k)[own]
            use = c.wanted[k - 2][history]
            own, history = own[use], history[use]
            count, below = c.counts[k - 1][own], c.counts[k - 2][c.b.shorter(k)[own]]
            n = len(c.b.levels[k - 2].keys)
            table = np.zeros((2 * CUT, n), np.int64)
            for row_, of in enumerate((count, below)):
                for r in range(CUT):
                    table[row_ * CUT + r] = np.bincount(history[np.minimum(of, CUT) == r + 1], minlength=n)
            sums = np.bincount(history, below, n).astype(np.int64)
            given, asked = np.unique(history), c.asks(k)
            keys = c.b.levels[k - 2].keys
            shorter = np.full(n, model.tokens) if k == 2 else c.counts[k - 3][c.b.shorter(k - 1)]
            cut = part_bounds(keys, parts)
            for p in range(parts):
                g, a = (x[np.searchsorted(x, cut[p]) : np.searchsorted(x, cut[p + 1])] for x in (given, asked))
                if len(g) or len(a):
                    sent = pack_keys(keys[g]), pack_counts(table[:, g]), pack_counts(sums[g])
                    wish = pack_keys(keys[a]), pack_counts(c.counts[k - 2][a]), pack_counts(shorter[a])
                    out.append((k - 1, p, row["batch"], len(g), *sent, len(a), *wish))
        kinds = pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 3, pa.int64(), *[pa.binary()] * 3
        names = ["order", "part", "batch", "n", "keys", "of_counts", "sums", "asking", "asked", "counts", "below"]
        return pa.table([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)], names=names)

    ship(batches.sparkSession)
    schema = "order int, part int, batch long, n long, keys binary, of_counts binary, sums binary, "
    schema += "asking long, asked binary, counts binary, below binary"
    return batches.groupBy("batch").cogroup(replies.groupBy("batch")).applyInArrow(run, schema)


def add_masses(rows: pa.Table, model: Model, tables: bool) -> pa.Table:
    """One part: its piece of the weight table (`batch` null) if `tables`, and the weights that each batch asked for."""
    rows = rows.sort_by("batch")
    sizes = rows.column("n").to_pylist()
    keys = np.concatenate([unpack_keys(k.as_py(), n) for k, n in zip(rows.column("keys"), sizes)])
    few = np.concatenate([unpack_counts(x.as_py(), 2 * CUT, n) for x, n in zip(rows.column("of_counts"), sizes)], axis=1)
    sums = np.concatenate([unpack_counts(x.as_py(), n) for x, n in zip(rows.column("sums"), sizes)])
    asking = rows.column("asking").to_pylist()
    asked, counts, below = (
        [of(x.as_py(), n) for x, n in zip(rows.column(c), asking)]
        for c, of in (("asked", unpack_keys), ("counts", unpack_counts), ("below", unpack_counts))
    )
    wanted = np.concatenate(asked)
    own, first = np.unique(wanted, return_index=True)
    counts, below = np.concatenate(counts)[first].astype(float), np.concatenate(below)[first].astype(float)
    at = np.searchsorted(own, keys)
    use = np.flatnonzero(at < len(own))
    use = use[own[at[use]] == keys[use]]
    few = np.array([np.bincount(at[use], x[use], len(own)) for x in few])
    order, part = rows.column("order")[0].as_py(), rows.column("part")[0].as_py()
    left = model.discounts[order].losses[1:] @ few[:CUT]
    low = np.bincount(at[use], sums[use], len(own)) - model.discounts[order - 1].losses[1:] @ few[CUT:]
    # below: at least the unknown word is left over
    weights = left / counts / np.maximum(1 - low / below, 1e-12)
    out = [(order, part, None, len(own), pack_keys(own), weights.tobytes())] if tables else []
    for batch, mine in zip(rows.column("batch").to_pylist(), asked):
        if len(mine):
            out.append((order, part, batch, len(mine), None, weights[np.searchsorted(own, mine)].tobytes()))
    kinds = pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()
    return pa.table([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)], names=[c.split()[0] for c in WEIGHED.split(", ")])


# scores


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_batches(batches: DataFrame, replies: DataFrame, model: Model, order: int) -> DataFrame:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = _row(left, 0)
        c = Counted(row, right.filter(pc.is_null(right.column("weights"))), order)
        b, texts = c.b, len(c.b.length)
        count = c.counts[0][b.levels[0].gram]
        logs = np.log10(model.word_probability(count))
        for k in range(2, order + 1):
            level, shorter = b.levels[k - 1], b.levels[k - 2]
            weight = np.zeros(len(shorter.keys))  # of a logarithm: a new history leaves the shorter one as it is
            mine = right.filter(pc.and_(pc.is_valid(right.column("weights")), pc.equal(right.column("order"), k - 1))).sort_by("part")
            given = np.frombuffer(b"".join(mine.column("weights").to_pylist()), np.float64)
            weight[c.asks(k)] = np.log10(given)
            at = np.flatnonzero(level.gram >= 0)
            n = c.counts[k - 1][level.gram[at]]
            seen, history = n > 0, shorter.gram[at - 1]
            direct = np.log10(model.discounts[k - 1].kept(n[seen]) / c.counts[k - 2][history[seen]])
            logs[at[seen]] = direct
            logs[at[~seen]] += weight[history[~seen]]
        text = b.text[b.word]
        arrays = [
            pa.array(row["doc_id"], pa.int64()), pa.array(row["held"], pa.bool_()), pa.array(b.length, pa.int64()),
            pa.array(np.bincount(text, count[b.word] > 0, texts).astype(np.int64)), pa.array(np.full(texts, model.tokens)),
            pa.array(np.bincount(text, model.base(count[b.word]), texts)), pa.array(np.bincount(text, logs[b.word], texts)),
        ]
        return pa.table(arrays, names=[x.split()[0] for x in SCORED.split(", ")])

    ship(batches.sparkSession)
    return batches.groupBy("batch").cogroup(replies.groupBy("batch")).applyInArrow(run, SCORED)


def held_out(doc_id: Column, remainder: int = 1, of: int = 5) -> Column:
    """True for ids whose crc32 leaves `remainder`; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % of == remainder, F.lit(False))


@dataclass(frozen=True)
class Fitted:
    """The stored tables: batches, counts by order, weights by order, and the numbers of the model.

    `counts[k - 1]` and `weights` hold the pieces of the tables by part where `batch` is null, with all
    keys if `fit` was asked for `tables`, and the replies to the batches elsewhere.
    Weights are there for the histories that held-out texts go on from in an unseen way.
    """

    batches: DataFrame
    counts: tuple[DataFrame, ...]
    weights: DataFrame | None
    model: Model


def fit(docs: DataFrame, order: int = ORDER, batch: int = BATCH, part: int = PART, tables: bool = False) -> Fitted:
    """Learn from the rows of `docs` (doc_id, text, held) that are not held out."""
    ship(docs.sparkSession)
    batches = token_batches(docs, batch)
    size = batches.agg(F.sum(F.aggregate("length", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    parts = max(1, -(-size // part))
    counts, discounts = [], []
    tokens = words = 0
    freed = 0.0
    for k in range(1, order + 1):
        counts.append(count_table(batches, k, parts, k < order, tables))
        low, different, total = _statistics(counts[-1])
        discounts.append(Discount.of(low))
        if k == 1:
            tokens, words = total, different
            lost = discounts[0].lost(np.arange(1, CUT + 1))
            freed = float(np.dot(lost, low[:CUT]) + lost[-1] * (different - sum(low[:CUT])))
    model = Model(tuple(discounts), tokens, words, freed)
    weights = None
    if order > 1:
        masses = send_masses(batches, _all_replies(counts), model, order, parts)

        def run(rows: pa.Table) -> pa.Table:
            return add_masses(rows, model, tables)

        weights = stored(masses.groupBy("order", "part").applyInArrow(run, WEIGHED), "weights")
    return Fitted(batches, tuple(counts), weights, model)


def _all_replies(counts: list[DataFrame] | tuple[DataFrame, ...], weights: DataFrame | None = None) -> DataFrame:
    none = F.lit(None).cast("binary").alias("weights")
    out = None
    for k, table in enumerate(counts, 1):
        rows = table.where("batch IS NOT NULL").select(F.lit(k).alias("order"), "part", "batch", "n", "counts", "owned", "wanted", none)
        out = rows if out is None else out.unionByName(rows)
    if weights is not None:
        out = out.unionByName(weights.where("batch IS NOT NULL").select("order", "part", "batch", "n", "weights"), allowMissingColumns=True)
    return out


def score_texts(docs: DataFrame, held: Column | None = None, order: int = ORDER, batch: int = BATCH, part: int = PART) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    `held` (default: by `held_out`) names the rows that are not learned from. A null or empty text is its
    end alone. Rows that repeat a text or id are texts of their own; a row without an id is learned
    from by default. Without training texts every word is the unknown one, with probability one. The
    scores are log10 probabilities, `base_score` under single words with 0.5 added to their counts.
    Only `doc_id`, `text` and the columns of `held` are read.
    """
    rows = take(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.withColumn("held", held_out(F.col("doc_id")) if held is None else held)
    fitted = fit(rows, order, batch, part)
    out = stored(score_batches(fitted.batches, _all_replies(fitted.counts, fitted.weights), fitted.model, order), "scores")
    spent(fitted.batches, *fitted.counts, *([fitted.weights] if fitted.weights is not None else []))
    return out
