"""Document fingerprints by Order MinHash, in column expressions only.

The k-mers are pairs of neighbouring words, numbered by occurrence: the third time a pair appears it
is another element than the first. A joint hash of pair and number deals the elements into ``BINS``
bins; in each bin the two least are selected, put back into the order of the text, and the tuple is
hashed. Both must survive an edit, and in the same order, for the bin to agree, so likeness falls
with the edit distance, with moved text and with a changed number of repeats.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandgrid.llm.common import free_name

BINS = 64
_PLACE = 30  # low bits of a packed k-mer: its position
_BIN = 63 - 6  # where the bin's bits begin: BINS is 2^6


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def fingerprint(text: Column) -> Column:
    """array<int>, one entry (bin, 16 bits of the tuple's hash) for each bin that has an element.

    Words end at ASCII white space. The last word pairs with nothing, so one word is a k-mer
    too. Null, empty and blank texts have an empty fingerprint.
    """

    def packed(digest: Column, place: Column) -> Column:  # 33 bits of the hash above the position
        return F.shiftleft(F.shiftrightunsigned(digest, 31), _PLACE) + place

    def place(x: Column) -> Column:
        return x.bitwiseAND(F.lit((1 << _PLACE) - 1).cast("long"))

    def above(x: Column) -> Column:
        return F.shiftright(x, _PLACE)

    def numbered(kmers: Column) -> Column:
        """Elements of the sorted k-mers: a run of equal ones is numbered from 0 in text order."""
        new = F.transform(
            kmers, lambda x, i: F.when(above(F.get(kmers, i - 1)).eqNullSafe(above(x)), F.lit(-1)).otherwise(i)
        )

        def elements(starts: Column) -> Column:
            def run(start: Column, k: Column) -> Column:
                end = F.coalesce(F.get(starts, k + 1), F.size(kmers))
                return F.transform(
                    F.slice(kmers, start + 1, end - start),
                    lambda x, n: packed(F.xxhash64(above(x), n), place(x)),
                )

            return F.sort_array(F.flatten(F.transform(starts, run)))

        return _let(F.filter(new, lambda i: i >= 0), elements)

    def leading(found: Column) -> Column:  # the first two of each bin: theirs is not the bin two back
        return F.filter(
            found,
            lambda x, i: ~F.shiftright(F.get(found, i - 2), _BIN).eqNullSafe(F.shiftright(x, _BIN)),
        )

    def entries(chosen: Column) -> Column:
        def entry(x: Column, i: Column) -> Column:
            bin_ = F.shiftright(x, _BIN)
            first = ~F.shiftright(F.get(chosen, i - 1), _BIN).eqNullSafe(bin_)

            def tuple_hash(other: Column) -> Column:
                a, b = above(x), above(other)
                return (
                    F.when(other.isNull() | (F.shiftright(other, _BIN) != bin_), F.xxhash64(a))
                    .when(place(other) < place(x), F.xxhash64(b, a)).otherwise(F.xxhash64(a, b))
                )

            digest = _let(F.get(chosen, i + 1), tuple_hash).bitwiseAND(F.lit(0xFFFF).cast("long"))
            return F.when(first, (bin_ * 65536 + digest).cast("int")).otherwise(F.lit(-1))

        return F.filter(F.transform(chosen, entry), lambda e: e >= 0)

    # cutting at the runs and leaving out the empty ends is linear; trimming by a pattern is not
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"[ \t\n\x0B\f\r]+"), lambda w: w != "")
    kmers = _let(words, lambda w: F.sort_array(
        F.transform(w, lambda x, i: packed(F.xxhash64(x, F.get(w, i + 1)), i))
    ))
    return _let(_let(_let(kmers, numbered), leading), entries)


def likeness(a: Column, b: Column) -> Column:
    """Share of equal entries among the bins that either fingerprint fills; 1 if none does."""

    def bins(x: Column) -> Column:
        return F.transform(x, lambda e: F.shiftright(e, 16))

    filled = F.size(F.array_union(bins(a), bins(b)))
    return F.when(filled == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / filled)


def as_text(prints: Column) -> Column:
    """Six hexadecimal digits for each filled bin."""
    return F.array_join(F.transform(prints, lambda e: F.lower(F.lpad(F.hex(e.cast("long")), 6, "0"))), "")


def fingerprints(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """All columns of ``docs`` and the fingerprint array; a column of that name is replaced."""
    return docs.withColumn(name, fingerprint(F.col(text)))


def with_next(docs: DataFrame, columns: dict[str, Column], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows with each of ``columns`` taken from the next row by descending id.

    The last row's next is the first. Null ids come last; rows of one id are ordered by text,
    downwards. Rows are dealt by ranges of ids, one exchange; the first rows of a range are
    also sent to the range before it, so no range needs to see another.
    """
    spark = docs.sparkSession
    ranges = 2 * int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    part, guest = free_name(docs, "_range"), free_name(docs, "_guest")
    shares = F.array(*(F.lit(k / ranges) for k in range(1, ranges)))
    cuts = sorted(set(docs.agg(F.percentile_approx(doc_id, shares, 10000)).first()[0] or ()))
    id_ = F.col(doc_id)
    bounds = F.array(*(F.lit(c) for c in cuts)) if cuts else F.array().cast("array<long>")
    above = F.size(F.filter(bounds, lambda c: c >= id_))
    placed = docs.withColumn(part, F.when(id_.isNull(), F.lit(len(cuts))).otherwise(above))
    tops = placed.groupBy(part).agg(F.max(doc_id).alias("top")).orderBy(part).collect()  # one row a range
    if not tops:
        return docs.withColumns({n: c for n, c in columns.items()})
    before = {r["top"]: tops[k - 1][part] for k, r in enumerate(tops)}
    known = [t for t in before if t is not None]
    firsts, places = (F.array(*map(F.lit, x)) for x in (known, [before[t] for t in known]))
    to = F.get(places, F.array_position(firsts, id_).cast("int") - 1) if known else F.lit(None).cast("int")
    first = F.array_contains(firsts, id_) if known else F.lit(False)
    if None in before:
        to = F.when(id_.isNull(), F.lit(before[None])).otherwise(to)
        first = F.coalesce(first, F.lit(False)) | id_.isNull()
    sent = docs.where(first).withColumn(part, to)
    both = placed.withColumn(guest, F.lit(0)).union(sent.withColumn(guest, F.lit(1)))
    order = Window.partitionBy(part).orderBy(guest, id_.desc_nulls_last(), F.col(text).desc_nulls_last())
    return (
        both.withColumns({n: F.lead(c, 1).over(order) for n, c in columns.items()})
        .where(F.col(guest) == 0).drop(part, guest)
    )
