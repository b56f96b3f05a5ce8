"""Language identification by compression.

Each language has a raw-content zstandard dictionary of sample text. A text is cut into blocks,
every block is compressed with each dictionary, and the language with the fewest bytes in all
wins. Unless its lead over the second is clear, the text is compressed again at a higher level;
a lead that stays narrow is a rejection, whatever the length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandgrid.llm.common import free_name, released, slices, widened

SAMPLE_TEXTS = 120  # labelled texts a language's dictionary is made of, at most
DICTIONARY_BYTES = 96 << 10
BLOCK = 4096
LEVEL, THOROUGH = 3, 12  # compression levels of the first and the second look
CLEAR = 0.1  # lead that needs no second look
NARROW = 0.01
STRETCHES = 16  # of a text that is longer than its share of a dictionary
SLICE_BYTES = 4 << 20

_LETTERS = bytes(
    b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256)
)


def letters_of(text: str) -> bytes:
    """Lower case letters with one space for all that stands between them."""
    return b" ".join(text.lower().encode().translate(_LETTERS).split())


def learn(docs: DataFrame, use: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> dict[str, bytes]:
    """Dictionary content per language from at most ``SAMPLE_TEXTS`` rows of it where ``use`` holds.

    The rows are those with the smallest digest of id and text. Rows without text or language
    teach nothing. A text over an eighth of ``DICTIONARY_BYTES`` gives ``STRETCHES`` pieces spread
    evenly over all of it, so what reaches the driver is bounded for each language. Languages come
    in the order of how usual they are.
    """
    share = DICTIONARY_BYTES // 8
    piece, size = share // STRETCHES, F.length(text)
    spread = F.transform(
        F.sequence(F.lit(0), F.lit(STRETCHES - 1)),
        lambda k: F.substring(F.col(text), (k * (size - piece) / (STRETCHES - 1)).cast("int") + 1, F.lit(piece)),
    )
    sampled = F.when(size <= share, F.col(text)).otherwise(F.array_join(spread, " "))
    digest = F.xxhash64(F.col(doc_id), F.col(text))
    rows = docs.where(use & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).alias("lang"), digest.alias("digest"), sampled.alias("text")
    )
    first = Window.partitionBy("lang").orderBy("digest")
    picked = rows.withColumn("n", F.row_number().over(first)).where(F.col("n") <= SAMPLE_TEXTS)
    usual = docs.where(use & F.col(lang).isNotNull()).groupBy(lang).count().collect()  # a row a language
    made: dict[str, list[bytes]] = {r[0]: [] for r in sorted(usual, key=lambda r: (-r[1], r[0]))}
    for row in picked.orderBy("lang", "digest").toLocalIterator():
        made[row["lang"]].append(letters_of(row["text"]))
    return {
        k: content
        for k, texts in made.items()
        if (content := b" ".join(texts)[:DICTIONARY_BYTES].strip())
    }


class Classifier:
    """Compressors of all languages; one per Python worker and set of dictionaries."""

    _made: dict[int, Classifier] = {}

    def __init__(self, dictionaries: dict[str, bytes]):
        self.langs = list(dictionaries)
        self.quick = [_compressor(d, LEVEL) for d in dictionaries.values()]
        self.thorough = [_compressor(d, THOROUGH) for d in dictionaries.values()]
        self.plain = zstandard.ZstdCompressor(level=THOROUGH, write_content_size=False)

    @classmethod
    def of(cls, dictionaries: dict[str, bytes]) -> Classifier:
        key = hash(tuple(dictionaries.items()))
        if key not in cls._made:
            cls._made = {key: cls(dictionaries)}
        return cls._made[key]

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        letters = letters_of(text or "")
        # marks above ASCII are letters to the compressor, but alone they make no language
        if not letters or not any(c.isalpha() for c in text):
            return "und", 0.0, bool(self.langs)
        if not self.langs:
            return "und", 0.0, False
        blocks = [letters[i : i + BLOCK] for i in range(0, len(letters), BLOCK)]
        best, lead = self._lead(blocks, self.quick)
        if lead < CLEAR:
            best, lead = self._lead(blocks, self.thorough)
        return self.langs[best], lead, lead < NARROW

    def _lead(self, blocks: list[bytes], coders: list) -> tuple[int, float]:
        """The language with the fewest bytes, and how far the second is behind."""
        sizes = [sum(len(c.compress(b)) for b in blocks) for c in coders]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        rest = [s for i, s in enumerate(sizes) if i != best]
        second = min(rest) if rest else sum(len(self.plain.compress(b)) for b in blocks)
        return best, max(0.0, (second - sizes[best]) / second)


def _compressor(content: bytes, level: int) -> zstandard.ZstdCompressor:
    held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    held.precompute_compress(level=level)
    return zstandard.ZstdCompressor(
        level=level, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False
    )


def identify(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text") -> DataFrame:
    """All columns of ``docs`` and lang_pred, lang_score, lang_rejected.

    The score is the winner's lead over the second in parts of the second's bytes. Rejected are
    texts whose lead is under ``NARROW`` (a tie in a short one), and texts without any letter
    (``und``; null and empty ones too). Equal sizes fall to the more usual language. Without
    dictionaries all is ``und`` and nothing is rejected. Columns of the new names are replaced.
    """
    docs = docs.drop("lang_pred", "lang_score", "lang_rejected")
    raw, kept = free_name(docs, "_raw"), docs.columns
    schema = widened(docs, "lang_pred string, lang_score double, lang_rejected boolean")
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)  # bounded for each language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = Classifier.of(shared.value)
        for batch in batches:
            for part in slices(batch, len(kept), SLICE_BYTES):
                found = [classifier.predict(t) for t in part.column(len(kept)).to_pylist()]
                lang, score, rejected = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(i) for i in range(len(kept))),
                        pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_()),
                    ],
                    names=schema.names,
                )

    return docs.select(*kept, F.col(text).alias(raw)).mapInArrow(released(run), schema)
