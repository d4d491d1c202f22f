"""Secret scan: fixed patterns and a character Markov comparison.

Two first-order Markov models over characters are trained from labelled samples of the corpus:
what the fixed patterns find counts as random strings, other long words as ordinary identifiers. A
token is reported if the models' log-likelihood ratio speaks for a random string, also where a
fixed pattern finds only a part of it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgauge.llm.common import map_arrow, take, texts_of

KINDS = ("assign", "access", "hex", "random")
# fixed patterns with the least length of what they must hold
ASSIGN = re.compile(
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_ASSIGNED = 12
KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")  # no ASSIGN match without one of them

TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
# letters with a short number at most: strings that mix both must not teach what is ordinary
IDENTIFIER = re.compile(r"(?<![A-Za-z0-9+/=-])[A-Za-z_]{8,}[0-9]{0,4}(?![A-Za-z0-9+/=-])")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
N = len(ALPHABET) + 1  # and the edge of a string
CODE = {c: i + 1 for i, c in enumerate(ALPHABET)}
LEAST_RATIO = 12.0  # nats for a random string


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, secret) of the fixed patterns, each kind leftmost and without overlap."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        for m in ASSIGN.finditer(text):
            if len(m.group(2)) >= LEAST_ASSIGNED:
                found.append((m.start(), m.end(), "assign", m.group(2)))
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access", m.group()) for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex", m.group()) for m in HEX.finditer(text)]
    return found


def _outside(matches: list[re.Match], taken: list[tuple[int, int, str, str]]) -> list[re.Match]:
    """The matches that touch no span of `taken`."""
    if not taken:
        return matches
    spans = sorted((s[0], s[1]) for s in taken)
    starts = np.array([s[0] for s in spans])
    ends = np.maximum.accumulate([s[1] for s in spans])
    out = []
    for m in matches:
        i = int(np.searchsorted(starts, m.end())) - 1  # the last span that starts before its end
        if i < 0 or ends[i] <= m.start():
            out.append(m)
    return out


def _not_held(matches: list[re.Match], taken: list[tuple[int, int, str, str]]) -> list[re.Match]:
    """The matches that reach out of every span they touch, and touch no `assign` span.

    An assigned value has every character of a token, so it always holds the token's end.
    """
    out, i = [], 0
    taken = sorted(taken)
    for m in matches:
        while i < len(taken) and taken[i][1] <= m.start():
            i += 1
        held, j = False, i
        while j < len(taken) and taken[j][0] < m.end():
            start, end, kind, _ = taken[j]
            held |= end > m.start() and (kind == "assign" or (start <= m.start() and m.end() <= end))
            j += 1
        if not held:
            out.append(m)
    return out


def _codes(token: str) -> np.ndarray:
    return np.array([0, *(CODE.get(c, 0) for c in token), 0])


@dataclass(frozen=True)
class SecretModel:
    """Log-likelihood ratio of each transition, random over ordinary; None without samples of either kind."""

    ratio: np.ndarray | None

    def score(self, token: str) -> float:
        if self.ratio is None:
            return float("-inf")
        code = _codes(token)
        return float(self.ratio[code[:-1], code[1:]].sum())

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """All spans (start, end, kind): those of the fixed patterns, and random tokens not held by them."""
        base = base_spans(text)
        more = []
        for m in _not_held(list(TOKEN.finditer(text)), base):
            token = m.group()
            if not token.isalpha() and any(map(str.isdigit, token)) and self.score(token) >= LEAST_RATIO:
                more.append((m.start(), m.end(), "random"))
        every = [s[:3] for s in base] + more
        return sorted(every, key=lambda s: (s[0], KINDS.index(s[2])))


def fit(docs: DataFrame) -> SecretModel:
    """Transition counts of both kinds over all documents; a word counts once per document."""
    docs = take(docs, "text").where("text IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, N, N), dtype=np.int64)
        for batch in batches:
            for _, texts in texts_of(batch):
                for text in texts:
                    base = base_spans(text)
                    ordinary = Counter(m.group() for m in _outside(list(IDENTIFIER.finditer(text)), base))
                    for kind, tokens in ((0, ordinary), (1, Counter(s[3] for s in base))):
                        if tokens:
                            code = np.concatenate([_codes(t) for t in tokens])
                            np.add.at(total[kind], (code[:-1], code[1:]), 1)
        total[:, 0, 0] = 0  # from one string to the next
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], names=["at", "n"])

    # a table of 2 * N * N rows at most
    found = map_arrow(docs, run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(2 * N * N)
    total[found.column("at").to_numpy()] = found.column("n").to_numpy()
    total = total.reshape(2, N, N)
    if not total.sum(axis=(1, 2)).all():
        return SecretModel(None)
    log_p = []
    for counts in total:
        marginal = (counts.sum(axis=0) + 1.0) / (counts.sum() + N)
        log_p.append(np.log((counts + 4.0 * marginal) / (counts.sum(axis=1, keepdims=True) + 4.0)))
    return SecretModel(log_p[1] - log_p[0])


def find_secrets(docs: DataFrame, model: SecretModel) -> DataFrame:
    """doc_id and spans (array of struct start, end, kind): one row per row of `docs`.

    Positions are code points, ends exclusive; spans are ordered by start, then kind. A null or
    empty text has none, a null id is kept. Only `doc_id` and `text` are read.
    """
    docs = take(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [
                [dict(zip(("start", "end", "kind"), s)) for s in model.spans(t or "")]
                for _, texts in texts_of(batch)
                for t in texts
            ]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, kind)], names=["doc_id", "spans"])

    return map_arrow(docs, run, "doc_id long, spans array<struct<start: long, end: long, kind: string>>")


def redact(docs: DataFrame, model: SecretModel, mark: str = "[secret]") -> DataFrame:
    """`docs` with every span replaced in `text`; a column `n_chars` is brought up to date."""
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    at = names.index("text")

    def clean(text: str | None) -> str | None:
        if not text:
            return text
        out, end = [], 0
        for start, stop, _ in model.spans(text):
            if start >= end:
                out += [text[end:start], mark]
            end = max(end, stop)
        return "".join([*out, text[end:]]) if out else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [clean(t) for _, part in texts_of(batch, f"c{at}") for t in part]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    out = map_arrow(plain, run, plain.schema)
    if "n_chars" in names:
        count = f"c{names.index('n_chars')}"
        out = out.withColumn(count, F.char_length(f"c{at}").cast(out.schema[count].dataType))
    return out.toDF(*names)
