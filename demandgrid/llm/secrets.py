"""Secrets in texts: fixed patterns, and random-looking strings by two Markov models.

One model has the letter transitions of random strings, the other those of ordinary
identifiers. Samples of the first are values that the patterns label as secrets, and drawn
strings; samples of the second are the other long tokens of the corpus, and drawn words. A token
whose log-likelihood ratio is high enough is a secret without any pattern around it; length and
letters decide through the ratio alone.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandgrid.llm.common import free_name, released, slices, widened

# The base patterns, the order of kinds and the least lengths.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "markov")
ASSIGN_LEAST, ACCESS_LEAST = 12, 18
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

ALPHABET = string.ascii_letters + string.digits + "+/_=-"
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
RATIO_LEAST, RATIO_EACH = 12.0, 0.35  # log-likelihood ratio of a secret, in all and per letter
DRAWN = 4000
# Words that drawn ordinary identifiers are made of.
WORDS = (
    "account address amount array buffer cache client column config content count create current data date "
    "default delete device document element error event file filter first format group handler header image "
    "index input item key last length level line list loader local manager message method model name network "
    "number object option order output package page parent path point process product query random record "
    "request response result schema server service session source state status stream string table target "
    "test time title total type update user value version view width window worker"
).split()
SLICE_BYTES = 4 << 20
_CODE = np.full(128, len(ALPHABET), np.int64)
_CODE[[ord(c) for c in ALPHABET]] = range(len(ALPHABET))

Span = tuple[int, int, int]  # start, index of the kind, end


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns by start, then kind; positions are code points."""
    out: list[Span] = []
    lower = text.lower() if not text.isascii() else text.casefold()
    if any(k in lower for k in KEYWORDS):
        out += [
            (m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= ASSIGN_LEAST
        ]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _transitions(token: str) -> np.ndarray:
    codes = _CODE[np.frombuffer(token.encode("ascii"), np.uint8)]
    size = len(ALPHABET) + 1
    return codes[:-1] * size + codes[1:]


def _tokens(text: str, base: list[Span]) -> Iterator[tuple[re.Match, list[tuple[int, int]]]]:
    """Long tokens that base spans do not cover whole, each with its stretches outside of them."""
    at = 0
    covers: list[list[int]] = []
    for start, _, end in base:
        if covers and start <= covers[-1][1]:
            covers[-1][1] = max(covers[-1][1], end)
        else:
            covers.append([start, end])
    for m in TOKEN.finditer(text):
        while at < len(covers) and covers[at][1] <= m.start():
            at += 1
        free, left, k = [], m.start(), at
        while k < len(covers) and covers[k][0] < m.end():
            if covers[k][0] > left:
                free.append((left, covers[k][0]))
            left = covers[k][1]
            k += 1
        if left < m.end():
            free.append((left, m.end()))
        if free:
            yield m, free


def _random(token: re.Match, free: list[tuple[int, int]], table: np.ndarray) -> bool:
    """Whether the whole token and, for each letter, what no base span covers of it look random."""
    whole = table[_transitions(token.group())]
    if whole.sum() < RATIO_LEAST:
        return False
    first = token.start()
    # a stretch counts with the transitions into its letters; the token's first letter has none
    got = sum(float(whole[max(s - first - 1, 0) : e - first - 1].sum()) for s, e in free)
    return got >= RATIO_EACH * sum(e - s for s, e in free)


def sample_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Transitions of labelled tokens in all texts: [ordinary, random] x letters x letters.

    Random: what the base patterns catch. Ordinary: long tokens that they do not touch and that
    models of the drawn samples alone do not call random, so that hidden secrets hardly teach the
    ordinary model.
    """
    cells = (len(ALPHABET) + 1) ** 2
    first = ratios(np.zeros((2, cells)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, cells), np.int64)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                if not t:
                    continue
                base = base_spans(t)
                for start, kind, end in base:
                    value = t[start:end]
                    if kind == 0:
                        value = ASSIGN.match(value).group(2)
                    np.add.at(total[1], _transitions(value), 1)
                for m, free in _tokens(t, base):
                    if free == [m.span()] and not _random(m, free, first):
                        np.add.at(total[0], _transitions(m.group()), 1)
        at = np.flatnonzero(total.ravel())
        yield pa.RecordBatch.from_pydict({"cell": at, "n": total.ravel()[at]})

    rows = docs.select(text).mapInArrow(released(run), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    out = np.zeros(2 * cells)
    for r in rows.collect():  # letters x letters x 2 at most
        out[r["cell"]] = r["n"]
    return out.reshape(2, -1)


def ratios(counts: np.ndarray) -> np.ndarray:
    """Log-likelihood ratio of each transition, random over ordinary.

    Drawn samples (random hexadecimal, alphanumeric and base64 strings; words joined as in
    identifiers; a fixed seed) stand beside those of the corpus with the same weight, so a
    corpus without any sample works too.
    """
    size = len(ALPHABET) + 1
    rng = np.random.default_rng(5)
    drawn = np.zeros((2, size * size))
    for letters in ("0123456789abcdef", string.ascii_letters + string.digits, ALPHABET[:64]):
        for _ in range(DRAWN // 3):
            np.add.at(drawn[1], _transitions("".join(rng.choice(list(letters), 32))), 1)
    for _ in range(DRAWN):
        words = [str(w) for w in rng.choice(WORDS, rng.integers(2, 5))]
        style = rng.integers(5)
        if style == 0:
            words = [w.capitalize() for w in words]
        elif style == 4:
            words = [w.upper() for w in words]
        token = ("", "_", "-", "/", "_")[style].join(words)
        if rng.random() < 0.3:
            token += str(rng.integers(0, 3000))
        np.add.at(drawn[0], _transitions(token), 1)
    both = [d + c * (d.sum() / c.sum() if c.sum() else 0) for d, c in zip(drawn, counts, strict=True)]
    tables = []
    for table in (both[1], both[0]):
        table = table.reshape(size, size)
        single = table.sum(axis=0) + 1.0
        single = single / single.sum()
        # unseen transitions fall back on how frequent their second letter is
        tables.append((table + 8.0 * single) / (table.sum(axis=1, keepdims=True) + 8.0))
    return np.log(tables[0] / tables[1]).ravel()


def markov_spans(text: str, base: list[Span], table: np.ndarray) -> list[Span]:
    """Random tokens, each as a whole: one that a base span covers in part overlaps with it."""
    return [(m.start(), 3, m.end()) for m, free in _tokens(text, base) if _random(m, free, table)]


def find_secrets(docs: DataFrame, counts: np.ndarray, text: str = "text", masked: str | None = None) -> DataFrame:
    """All columns of ``docs`` and secrets, array<struct<kind, start, end>>, by start, then kind.

    Positions are code points, ends exclusive. A null or empty text has none. Spans of different
    kinds may overlap; the models add no token that base spans cover whole. With ``masked`` a
    further column has the text with each covered stretch replaced by its first kind in
    brackets (null stays null). Columns of the new names are replaced. Rows stay in place.
    """
    docs = docs.drop("secrets", *([masked] if masked else []))
    table = ratios(counts)
    raw, kept = free_name(docs, "_raw"), docs.columns
    kind = "secrets array<struct<kind:string,start:int,end:int>>"
    schema = widened(docs, kind + (f", `{masked}` string" if masked else ""))
    item = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, len(kept), SLICE_BYTES):
                found, clean = [], []
                for t in part.column(len(kept)).to_pylist():
                    base = base_spans(t or "")
                    spans = sorted([*base, *markov_spans(t or "", base, table)])
                    found.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans])
                    if masked:
                        clean.append(t if t is None or not spans else mask(t, spans))
                cols = [*(part.column(i) for i in range(len(kept))), pa.array(found, pa.list_(item))]
                if masked:
                    cols.append(pa.array(clean, pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return docs.select(*kept, F.col(text).alias(raw)).mapInArrow(released(run), schema)


def mask(text: str, spans: list[Span]) -> str:
    out, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            out.append(f"{text[at:start]}[{KINDS[kind]}]")
        at = max(at, end)
    return "".join([*out, text[at:]])
