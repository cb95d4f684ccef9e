"""Benchmark decontamination by winnowing: passages that documents share with benchmark items.

Of every window of ``span`` words, documents and items keep one fingerprint: the least hash of the
k-word grams inside it. Equal windows have equal fingerprints, so a passage of ``span`` words or more
that both sides hold is never missed, while one fingerprint stands for several windows. Document
fingerprints meet those of the items, hits are extended to the whole windows around them, and windows
that agree, too, are joined to the items that hold them.

What goes to all tasks are two tables of bits of a fixed size, one of the items' fingerprints and one
of their windows; they only spare the join what can't match. The join itself is by fingerprint and
window, broadcast where a count shows that the items are few and else shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, cut, map_rows
from .jaccard import U, WordHashes, mix

#: Words of a window, and of the grams of which each window keeps the least.
SPAN, GRAM = 10, 5
#: Bits of a table of fingerprints or windows, as a power of two (8 MB).
BITS = 26
#: Texts that a task holds at a time.
PIECE = 500
#: Letters A-Z become small; what is no letter, digit or character from 0x80 on parts words.
FOLD = bytes(32 if b < 0x30 or 0x3A <= b < 0x41 or 0x5B <= b <= 0x60 or 0x7B <= b < 0x80 else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def word_hashes(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Hashes of the words of a whole text, in order."""
    found = text.encode("utf-8", "replace").translate(FOLD).split() if text else []
    return np.fromiter(map(hashes.__getitem__, found), U, len(found))


def rolled(columns: list[np.ndarray]) -> np.ndarray:
    """A hash of each row of words; the columns hold the rows' first, second ... words."""
    with np.errstate(over="ignore"):
        out = np.full(len(columns[0]), len(columns), U)
        for c in columns:
            out = mix(out * U(0x9E3779B97F4A7C15) + c)
    return out


def fingerprints(h: np.ndarray, length: int) -> np.ndarray:
    """The fingerprint of each window of ``length`` words: the least hash of the grams in it."""
    k = min(GRAM, length)
    if len(h) < length:
        return np.zeros(0, U)
    grams = rolled([h[i : len(h) - k + 1 + i] for i in range(k)])
    n = len(h) - length + 1
    out = grams[:n].copy()
    for i in range(1, length - k + 1):
        np.minimum(out, grams[i : n + i], out=out)
    return out


def windows(h: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the whole windows that begin at the places ``at``."""
    return rolled([h[at + i] for i in range(length)])


def bit_table(hashes: DataFrame, column: str) -> np.ndarray:
    """One bit for each of the first ``BITS`` bits that a hash of the column begins with. Tasks and
    shuffles put bits together 64 at a time; the driver gets at most 2^BITS / 64 numbers."""
    slot = F.shiftrightunsigned(F.col(column), 64 - BITS)
    one = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(`{column}`, {64 - BITS}) & 63 AS INT))")
    rows = hashes.groupBy(F.shiftrightunsigned(slot, 6).alias("at")).agg(F.bit_or(one).alias("bits")).toArrow()
    table = np.zeros(1 << (BITS - 6), np.int64)
    table[rows["at"].to_numpy()] = rows["bits"].to_numpy()
    return table.view(np.uint8)


def has(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    at = (x >> U(62 - len(table).bit_length())).astype(np.int64)  # as many bits as number the table's
    return (table[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def longs(parts: list[np.ndarray]) -> pa.ListArray:
    flat = np.concatenate([np.zeros(0, U), *parts])
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]).astype(np.int32)), pa.array(flat.view(np.int64)))


def item_windows(items: DataFrame, span: int, key: str, text: str) -> DataFrame:
    """(item, length, print, wind) of all windows of all items, each once; an item of fewer words
    than ``span`` is one window, one without words has none. Items of equal keys are one item."""

    def read(batches):
        hashes = WordHashes()
        for batch in batches:
            for item, t in zip(batch[key], batch[text], strict=True):
                h = word_hashes(t, hashes)
                if len(h):
                    length = min(span, len(h))
                    wind = windows(h, np.arange(len(h) - length + 1), length)
                    wind, first = np.unique(wind, return_index=True)
                    prints = fingerprints(h, length)[first]
                    yield {"item": [item] * len(wind), "length": pa.array(np.full(len(wind), length, np.int32)), "print": pa.array(prints.view(np.int64)), "wind": pa.array(wind.view(np.int64))}

    kind = items.schema[key].dataType.simpleString()
    return map_rows(items, [key, text], read, f"item {kind}, length int, print long, wind long", PIECE).distinct()


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", span: int = SPAN) -> DataFrame:
    """(key, n_words, n_hit, n_items, items) of every row of ``docs``: its words, those of them inside
    any occurrence of an item's window, and the keys of the items with such windows as a sorted array
    of strings.

    * Words are runs of letters, digits and characters from 0x80 on, in which only A-Z are lower-cased;
      windows are ``span`` consecutive words of an item, or all of them if it has fewer.
    * Null and empty texts, and texts without words, have no words and are never hit; items without
      words hit nothing. Without items nothing is hit; an empty table gives an empty result.
    * Rows with equal or null keys are kept and counted each. Items with equal keys count once; an item
      without a key hits words but isn't among the items.
    * Whole texts of any length count, other columns are ignored. Windows are equal if two 64-bit hashes
      of them are.

    A passage that many documents hold, and documents that hold the same passages, cost the join one row
    for each window and each such set of windows, not one for each pair of document and item.
    """
    winds = cut(item_windows(items, span, item_key, item_text))
    context = docs.sparkSession.sparkContext
    lengths = [r.length for r in winds.select("length").distinct().collect()]  # at most ``span`` numbers
    tables = context.broadcast((bit_table(winds, "print"), bit_table(winds, "wind")))

    def read(batches):
        hashes = WordHashes()
        known_prints, known_winds = tables.value
        for batch in batches:
            n, marks, at, prints, winds_of = [], [], [], [], []
            for t in batch[text]:
                h = word_hashes(t, hashes)
                spots = []
                for length in lengths:
                    f = fingerprints(h, length)
                    hit = np.flatnonzero(has(known_prints, f))
                    if len(hit):
                        w = windows(h, hit, length)
                        ok = has(known_winds, w)
                        spots.append((hit[ok].astype(U), f[hit[ok]], w[ok]))
                places = [np.concatenate(x) for x in zip(*spots, strict=True)] if spots else [np.zeros(0, U)] * 3
                n.append(len(h))
                marks.append(xxhash.xxh3_128_hexdigest(np.unique(places[2]).tobytes()) if len(places[0]) else None)
                for held, x in zip((at, prints, winds_of), places, strict=True):
                    held.append(x)
            yield {key: batch[key], "n_words": pa.array(np.array(n, np.int64)), "mark": marks, "at": longs(at), "print": longs(prints), "wind": longs(winds_of)}

    kind = docs.schema[key].dataType.simpleString()
    fields = f"`{key}` {kind}, n_words long, mark string, at array<long>, print array<long>, wind array<long>"
    known = cut(map_rows(docs, [key, text], read, fields, PIECE).withColumn("row", F.monotonically_increasing_id()))
    clean = known.filter(F.col("mark").isNull()).select(key, "n_words", F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"))
    hit = known.filter(F.col("mark").isNotNull())

    # words inside hits: windows in the order of their places, each adds what no earlier one covers
    spots = hit.select("row", F.explode(F.arrays_zip("at", "print", "wind")).alias("s")).select("row", "s.*")
    spans = spots.join(bounded(winds.groupBy("print", "wind").agg(F.first("length").alias("length"))), ["print", "wind"])
    before = Window.partitionBy("row").orderBy("at", "length").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("row", "at", "length", F.coalesce(F.max(F.col("at") + F.col("length")).over(before), F.lit(0)).alias("covered"))
    words = spans.groupBy("row").agg(F.sum(F.greatest(F.lit(0), F.col("at") + F.col("length") - F.greatest("at", "covered"))).alias("n_hit"))

    # items by the set of windows that a document holds, each such set once
    sets = hit.groupBy("mark").agg(F.first(F.arrays_zip("print", "wind")).alias("s"))
    sets = sets.select("mark", F.explode(F.array_distinct("s")).alias("s")).select("mark", "s.*")
    names = winds.filter(F.col("item").isNotNull()).select("print", "wind", F.col("item").cast("string").alias("item"))
    found = sets.join(bounded(names), ["print", "wind"]).groupBy("mark").agg(F.array_sort(F.collect_set("item")).alias("items"))
    dirty = hit.select("row", key, "n_words", "mark").join(words, "row", "left").join(found, "mark", "left")
    none = F.array().cast("array<string>")
    dirty = dirty.select(key, "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", none).alias("items"))
    return clean.unionByName(dirty).select(key, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items")


def digest(items: Column) -> Column:
    return F.sha2(F.concat_ws(",", items).cast("binary"), 256)
