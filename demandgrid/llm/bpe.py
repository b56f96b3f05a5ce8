"""Byte-level BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash over the bytes of a text cuts it into chunks, so a passage that occurs in many
documents gives the same chunks wherever it stands. The inner part of a chunk, between its
first and its last cut that no token can cross, is encoded once for each cache of a task and
reused. What is left on both sides of a chunk boundary is the join: it is re-encoded from the
last such cut on the left to the first on the right, growing over chunks without any cut,
so both ends agree with the reused ids exactly.

No token crosses the place between a visible character and a space: the pre-tokeniser lets a
space start a token, but never follow a visible character inside one.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandgrid.llm.common import free_name, released, slices, widened

PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
WINDOW = 16  # bytes that decide about a chunk boundary
MEAN_CHUNK = 512  # bytes, a power of two
CACHE_BYTES = 48 << 20
SLICE_BYTES = 4 << 20

_CUT = re.compile(r"(?<=\S)(?= )")
#: Unicode white space, in runs that are too long for the pre-tokeniser's look-ahead
_LONG_RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{10000,}")
_GEAR = np.random.default_rng(20240229).integers(0, 2**63, 256, dtype=np.uint64)


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """A byte-level BPE vocabulary read from the text of a tokenizer file."""

    def __init__(self, content: str):
        spec = json.loads(content)
        letters = _byte_letters()
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        ranks = {
            bytes(letters[c] for c in token): i
            for token, i in spec["model"]["vocab"].items()
            if token not in self.special
        }
        merged = [
            i
            for pair in spec["model"]["merges"]
            if (i := spec["model"]["vocab"]["".join(pair.split(" ") if isinstance(pair, str) else pair)])
            is not None
        ]
        if merged != sorted(merged):
            raise ValueError("ids of the vocabulary are not in the order of its merges")
        self.tokens = {i: t for t, i in ranks.items()}
        self.tokens |= {i: s.encode() for s, i in self.special.items()}
        self.core = tiktoken.Encoding(
            "corpus", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
        self.splitter = (
            re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        )


class Encoder:
    """Encodes whole texts; one per Python worker and vocabulary."""

    _made: dict[int, Encoder] = {}

    def __init__(self, content: str):
        self.vocabulary = Vocabulary(content)
        self.chunks: dict[bytes, tuple[str, bytes, str] | None] = {}
        self.chunk_bytes = 0

    @classmethod
    def of(cls, content: str) -> Encoder:
        key = hash(content)
        if key not in cls._made:
            cls._made = {key: cls(content)}
        return cls._made[key]

    def span(self, text: str) -> bytes:
        """Little-endian 32-bit ids of a text that starts and ends at a safe cut, or is whole."""
        core = self.vocabulary.core
        found, at = [], 0
        for run in _LONG_RUN.finditer(text):
            # one word without its last character, which belongs to what follows, if anything does
            end = run.end() - (run.end() < len(text))
            found += core.encode_ordinary(text[at : run.start()])
            found += core._encode_single_piece(text[run.start() : end])
            at = end
        found += core.encode_ordinary(text[at:])
        return np.array(found, dtype="<u4").tobytes()

    def plain(self, text: str, encode) -> bytes:
        """Ids of a whole text, its special tokens apart."""
        split = self.vocabulary.splitter
        if split is None or not split.search(text):
            return encode(text)
        out = []
        for part in split.split(text):
            i = self.vocabulary.special.get(part)
            out.append(encode(part) if i is None else np.array([i], dtype="<u4").tobytes())
        return b"".join(out)

    def ids(self, text: str | None) -> bytes:
        """Ids without chunks: for readers that need each text once only."""
        return self.plain(text or "", self.span)

    def chunked_ids(self, text: str | None) -> bytes:
        return self.plain(text or "", self._by_chunks)

    def _by_chunks(self, text: str) -> bytes:
        data = text.encode()
        out, left, at = [], "", 0
        for end in [*chunk_ends(data), len(data)]:
            piece, at = data[at:end], end
            known = self._chunk(piece)
            if known is None:  # no safe cut inside: the join grows over it
                left += piece.decode()
                continue
            head, ids, tail = known
            out.append(self.span(left + head))
            out.append(ids)
            left = tail
        out.append(self.span(left))
        return b"".join(out)

    def _chunk(self, piece: bytes) -> tuple[str, bytes, str] | None:
        if piece in self.chunks:
            return self.chunks[piece]
        text = piece.decode()
        first = _CUT.search(text)
        if first is None:
            got = None
        else:
            f, last = first.start(), text.rfind(" ")
            while last > f and text[last - 1].isspace():
                last = text.rfind(" ", 0, last)
            last = max(last, f)
            got = (text[:f], self.span(text[f:last]), text[last:])
        size = 2 * len(piece) + 4 * (len(got[1]) if got else 0) + 300
        if self.chunk_bytes + size > CACHE_BYTES:
            self.chunks.clear()
            self.chunk_bytes = 0
        self.chunks[piece] = got
        self.chunk_bytes += size
        return got


def chunk_ends(data: bytes) -> list[int]:
    """Boundaries where the hash of the last ``WINDOW`` bytes is 0 modulo the mean size.

    They depend on those bytes alone and are moved on to the start of a character.
    """
    if len(data) <= MEAN_CHUNK:
        return []
    b = np.frombuffer(data, np.uint8)
    g = _GEAR[b]
    h = g.copy()
    step = 1
    while step < WINDOW:  # doubling: h covers 2, 4, ... bytes, the older ones shifted further
        older = h[:-step] << np.uint64(3 * step)
        h[step:] += older
        step *= 2
    h ^= h >> np.uint64(29)
    ends = np.flatnonzero(h[WINDOW:] % np.uint64(MEAN_CHUNK) == 0) + WINDOW + 1
    ends = ends[ends < len(data)]
    for _ in range(3):
        inside = (b[np.minimum(ends, len(data) - 1)] & 0xC0) == 0x80
        ends = ends + inside
    return np.unique(ends[ends < len(data)]).tolist()


def vocabulary_text(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def shared_vocabulary(df: DataFrame, path: str) -> Broadcast:
    """The vocabulary file, read on the driver; its size does not depend on the data."""
    return df.sparkSession.sparkContext.broadcast(vocabulary_text(path))


def encode(
    docs: DataFrame,
    tokenizer: str,
    text: str = "text",
    ids: str = "ids",
    decoded: str | None = "decoded",
) -> DataFrame:
    """All columns of ``docs`` and the token ids of each whole text.

    Ids are those of the tokenizer file's library without added special tokens; the strings of
    special tokens inside a text become their ids. A null text counts as empty. With ``decoded``
    the ids are decoded as well. New columns replace columns of the same name. Rows stay in
    place: no shuffle, and repeated rows or ids, ties and empty tables need no care.
    """
    shared = shared_vocabulary(docs, tokenizer)
    kept = [c for c in docs.columns if c not in (ids, decoded)]
    more = f"`{ids}` array<int>" + (f", `{decoded}` string" if decoded else "")
    schema = widened(docs.select(*kept), more)
    raw = free_name(docs, "_raw")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(shared.value)
        tokens = encoder.vocabulary.tokens
        for batch in batches:
            for part in slices(batch, batch.num_columns - 1, SLICE_BYTES):
                found, back = [], []
                for t in part.column(part.num_columns - 1).to_pylist():
                    got = np.frombuffer(encoder.chunked_ids(t), "<u4")
                    found.append(got)
                    if decoded:
                        back.append(b"".join(map(tokens.__getitem__, got.tolist())))
                ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
                values = np.concatenate(found).astype(np.int32)
                cols = [part.column(i) for i in range(part.num_columns - 1)]
                cols.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(values)))
                names = [*kept, ids]
                if decoded:
                    cols.append(pa.array([x.decode("utf-8", "replace") for x in back], pa.string()))
                    names.append(decoded)
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.select(*kept, F.col(text).alias(raw)).mapInArrow(released(run), schema)


def decode(
    docs: DataFrame, tokenizer: str, ids: str = "ids", decoded: str = "decoded"
) -> DataFrame:
    """Texts of token ids, special tokens included; null ids give a null text."""
    shared = shared_vocabulary(docs, tokenizer)
    kept = [c for c in docs.columns if c != decoded]
    schema = widened(docs.select(*kept), f"`{decoded}` string")
    at = kept.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Encoder.of(shared.value).vocabulary.tokens
        for batch in batches:
            texts = [
                None
                if row is None
                else b"".join(tokens.get(i, b"") for i in row).decode("utf-8", "replace")
                for row in batch.column(at).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(texts, pa.string())], names=[*kept, decoded]
            )

    return docs.select(*kept).mapInArrow(released(run), schema)
