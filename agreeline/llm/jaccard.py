"""Similarity join on n-gram sets: exact, by blocks of a sparse document by n-gram product.

Candidates come from a bound on sizes. Two sets with Jaccard similarity of t or more have at least
t * |a| elements in common, so if all n-grams stand in one order, the least common element is among
the first |a| - ceil(t * |a|) + 1 elements of a, and likewise of b. Any order is right; rare n-grams
come first, so that passages which many documents share seldom tie them. How frequent an n-gram is
comes from a table of counts of fixed width over all documents. Documents that share one of these
first n-grams are candidates. In a large corpus that happens by chance, so a candidate pair stays only if
its sketches, of a fixed size and no farther apart than the sets are, are as near as the threshold
asks. What stays ties documents to blocks; for each block the product of the document by n-gram
incidence matrix with its transpose is accumulated row by row, only over documents whose sizes can
reach the threshold, and pairs below the overlap that their sizes ask for are discarded. What is left
of a block is a spanning forest of its links, so a group of copies never becomes all of its pairs.

Long sets have many first n-grams and would meet by chance. Their n-grams are dealt by hash into
more parts than two sets over the threshold can differ in, so such sets are equal on some parts,
and the whole content of a part takes the place of a single n-gram: of all parts the rarest come
first, as many as the bound asks for. A part of a long set holds several n-grams, which unrelated
documents do not share by chance, however many there are.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, cut, map_rows

#: Documents and n-grams of a block side; larger candidate groups become a grid of pairs of sides.
SIDE, SIDE_GRAMS = 2048, 1 << 20
KEPT_WORDS = 300_000
#: Texts that a task holds at a time.
PIECE = 500
#: Counts of n-grams: slots of the table (8 MB when broadcast), slots of a row of it, and tasks whose
#: rows are added up first.
SLOTS, CHUNK, FAN_IN = 1 << 22, 1 << 16, 64
#: Sets of this many n-grams and more meet by parts. Ways to deal n-grams into parts, tried in turn by
#: sets to which a way leaves more empty parts than they may leave out.
LONG, WAYS = 1024, 4
#: Buckets of a sketch, and the largest count that one holds.
BUCKETS, FULL = 128, 15
#: Pairs that share a signature, and are no near copies, are made while they are at most the signatures
#: divided by this.
PAIRS = 2
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x.astype(U, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> U(30)
        x *= U(0xBF58476D1CE4E5B9)
        x ^= x >> U(27)
        x *= U(0x94D049BB133111EB)
        x ^= x >> U(31)
    return x


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > KEPT_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str | None, n: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles of a text in which A-Z are lower case; the
    whole sequence if it has fewer words; empty without words."""
    found = text.encode().lower().split() if text else []  # of bytes: A-Z and ASCII white space only
    if not found:
        return np.zeros(0, U)
    h = np.fromiter(map(hashes.__getitem__, found), U, len(found))
    k = min(n, len(h))
    with np.errstate(over="ignore"):
        out = np.full(len(h) - k + 1, k, U)
        for i in range(k):
            out = mix(out * U(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i])
    return np.unique(out)


def class_key(grams: np.ndarray) -> int:
    """The same number for equal sets."""
    return int(mix(grams.sum(dtype=U, keepdims=True)).view(np.int64)[0])


def second_key(grams: np.ndarray) -> int:
    """Another such number."""
    return int(mix(grams).sum(dtype=U, keepdims=True).view(np.int64)[0])


def packed(counts: np.ndarray) -> bytes:
    """Counts in one byte each if they fit, compressed."""
    return zlib.compress(counts.astype(np.uint8 if counts.max(initial=0) < 256 else np.int64).tobytes(), 1)


def unpacked(row: bytes) -> np.ndarray:
    raw = zlib.decompress(row)
    return np.frombuffer(raw, np.uint8 if len(raw) == CHUNK else np.int64).astype(np.int64)


def added_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of the rows of one chunk, a batch at a time."""
    total, at = np.zeros(CHUNK, np.int64), None
    for batch in batches:
        at = batch.column("chunk")[0].as_py()
        for row in batch.column("counts").to_pylist():
            total += unpacked(row)
    yield pa.RecordBatch.from_pydict({"chunk": pa.array([at], pa.int32()), "counts": pa.array([packed(total)], pa.binary())})


def frequencies(docs: DataFrame, n: int, text: str) -> np.ndarray:
    """How frequent the n-grams of each slot are, on a logarithmic scale: ``SLOTS`` 16-bit numbers,
    whatever the size of ``docs``. Every document counts; equal sets count once in a task."""

    def count(batches):
        hashes, counts, seen = WordHashes(), np.zeros(SLOTS, np.int64), set()
        for batch in batches:
            for t in batch[text]:
                grams = shingles(t, n, hashes)
                if len(grams) and (h := class_key(grams)) not in seen:
                    seen.add(h)
                    np.add.at(counts, slots(grams), 1)
            if len(seen) > 1_000_000:
                seen.clear()
        full = [c for c in range(SLOTS // CHUNK) if counts[c * CHUNK : (c + 1) * CHUNK].any()]
        task = TaskContext.get().partitionId() // FAN_IN
        yield {"chunk": full, "tasks": [task] * len(full), "counts": [packed(counts[c * CHUNK : (c + 1) * CHUNK]) for c in full]}

    rows = map_rows(docs, [text], count, "chunk int, tasks int, counts binary", PIECE)
    for keys in (["chunk", "tasks"], ["chunk"]):
        rows = rows.groupBy(*keys).applyInArrow(added_up, "chunk int, counts binary")
    table = np.zeros(SLOTS, np.int64)
    for row in rows.collect():  # at most SLOTS / CHUNK rows of a fixed size
        table[row.chunk * CHUNK : (row.chunk + 1) * CHUNK] = unpacked(row.counts)
    return (1024 * np.log2(1.0 + table)).astype(np.uint16)


def slots(grams: np.ndarray) -> np.ndarray:
    return (mix(grams) & U(SLOTS - 1)).astype(np.int64)


def first_grams(spread: np.ndarray, frequency: np.ndarray, num: int, den: int) -> np.ndarray:
    """The first elements of a set, rare ones first: sets over the threshold share one. An element
    is its place in the order, 16 bits of frequency before 48 of its hash; equal places are shared
    whichever element has them, so no pair is lost to them."""
    place = frequency << U(48) | spread >> U(16)
    k = len(spread) + (-num * len(spread)) // den + 1
    return np.partition(place, k - 1)[:k]


def long_levels(size: int, num: int, den: int) -> list[tuple[int, int]]:
    """(number, largest size) of the levels of sizes, from LONG on, in which the smaller set of a pair
    with a set of ``size`` can lie. A level ends where a set of its first size has no partner any more."""
    out, first, at = [], LONG, 0
    while first <= size:
        last = first * den // num
        if last * den >= size * num:
            out.append((at, last))
        first, at = last + 1, at + 1
    return out


def first_parts(spread: np.ndarray, frequency: np.ndarray, num: int, den: int) -> list[np.ndarray]:
    """The first parts of a long set for each level of sizes: long sets over the threshold share one.

    Sets that differ in at most ``differ`` elements are equal on all parts but so many. Of ``differ``
    + 1 + ``spare`` parts, they share ``spare`` + 1, so the first ``differ`` + 1 of each, in one order
    of all parts and contents, have one in common. Empty parts come last and are never given: a set
    with no more of them than ``spare`` doesn't need them, and two sets that both have more meet
    by the next way to deal the parts. After all ways, their empty parts count, too.
    """
    out = []
    for level, largest in long_levels(len(spread), num, den):
        differ = largest * (den - num) // num
        parts = differ + 2 + differ // 12
        for way in range(WAYS):
            salt = mix(np.array([level * WAYS + way + 1], U))
            dealt = mix(spread ^ salt)
            part = (dealt % U(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            named, starts = np.unique(part[order], return_index=True)
            content = np.add.reduceat(mix(dealt[order] + salt), starts)
            rarest = np.minimum.reduceat(frequency[order], starts)
            place = rarest << U(48) | mix(content ^ mix(named.astype(U) + salt)) >> U(16)
            out.append(place if len(place) <= differ + 1 else np.partition(place, differ)[: differ + 1])
            if len(place) > differ:
                break
        else:
            empty = np.setdiff1d(np.arange(parts), named)
            out.append(mix(empty.astype(U) + salt) >> U(16) | U(0xFFFF) << U(48))
    return out


def signatures(grams: np.ndarray, frequency: np.ndarray, num: int, den: int) -> np.ndarray:
    """What a set may share with others: all sets over the threshold share a signature. Pairs of
    which the smaller set is long meet by parts, others by their first n-grams."""
    if not len(grams):
        return grams
    spread = mix(grams)
    often = frequency[(spread & U(SLOTS - 1)).astype(np.int64)].astype(U)
    short = num * len(grams) < den * LONG
    return np.concatenate([*([first_grams(spread, often, num, den)] if short else []), *(first_parts(spread, often, num, den) if len(grams) >= LONG else [])])


def sketch(grams: np.ndarray) -> bytes:
    """How many elements of a set fall into each bucket, in half a byte each. What the counts of two sets
    differ by, added up, is at most the number of elements that only one of them has."""
    counts = np.bincount((mix(grams) % U(BUCKETS)).astype(np.int64), minlength=BUCKETS)
    counts = np.minimum(counts, FULL).astype(np.uint8)
    return (counts[::2] << 4 | counts[1::2]).tobytes()


def differences(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """What the sketches of each pair differ by, added up."""
    a, b = (np.frombuffer(b"".join(s), np.uint8).reshape(len(s), -1).astype(np.int16) for s in (left, right))
    return (np.abs((a >> 4) - (b >> 4)) + np.abs((a & FULL) - (b & FULL))).sum(1, dtype=np.int64)


def near_pairs(pairs: DataFrame, sketches: DataFrame, num: int, den: int) -> DataFrame:
    """(k1, lead): the pairs of classes x and y, of nx and ny n-grams, without those that their sizes or
    sketches show to be below the threshold."""
    pairs = pairs.filter((F.col("x") != F.col("y")) & (F.col("nx") * num <= F.col("ny") * den) & (F.col("ny") * num <= F.col("nx") * den))
    pairs = pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), (F.col("nx") + F.col("ny")).alias("both")).distinct()
    for c in "xy":
        pairs = pairs.join(sketches.select(F.col("k1").alias(c), F.col("sketch").alias(f"s{c}")), c)

    def check(batches):
        for batch in batches:
            if batch["x"]:
                apart = differences(batch["sx"], batch["sy"])
                near = np.flatnonzero(apart * (den + num) <= np.array(batch["both"], np.int64) * (den - num))
                yield {"k1": np.array(batch["x"], np.int64)[near], "lead": np.array(batch["y"], np.int64)[near]}

    return map_rows(pairs, ["x", "y", "both", "sx", "sy"], check, "k1 long, lead long", 20 * PIECE)


def connected(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, label): the least node that each node reaches. By large and small stars in turn: every
    node is tied to the least of its neighbours until nothing changes. Each round is joins and
    minima over the edges, written to the shared folder."""
    edge = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct())
    while True:
        both = edge.union(edge.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        new = cut(small.filter("u <> v").distinct())
        # every node is tied to one node, and that one to none: all trees are stars
        state = new.groupBy().agg(F.count(F.lit(1)), F.count_distinct("u")).first()
        crossing = 0 if state[0] != state[1] else new.join(new.select(F.col("u").alias("x")).distinct(), F.col("v") == F.col("x"), "left_semi").limit(1).count()
        edge = new
        if state[0] == state[1] and not crossing:
            return edge.select(F.col("u").alias("node"), F.col("v").alias("label"))


def block_links(left: list[np.ndarray], right: list[np.ndarray] | None, num: int, den: int) -> list[tuple[int, int]]:
    """A spanning forest of the links in one block (or between two): pairs of positions, the right
    side's counted after the left side's. Rows of the sparse product are accumulated one by one and
    only while a document has others that it isn't yet linked with."""
    sets = left + (right or [])
    n, cross = len(sets), len(left) if right is not None else 0
    size = np.fromiter(map(len, sets), np.int64, n)
    order = np.argsort(size, kind="stable")
    flat = np.concatenate([sets[i] for i in order]) if n else np.zeros(0, U)
    _, gram, times = np.unique(flat, return_inverse=True, return_counts=True)
    doc = np.repeat(np.arange(n), size[order])
    shared = times[gram] > 1  # an n-gram of one document adds to no pair
    gram, doc = gram[shared], doc[shared]
    by_gram = np.argsort(gram, kind="stable")
    posting, starts = doc[by_gram], np.concatenate([[0], np.cumsum(np.bincount(gram, minlength=len(times)))])
    row = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=n))])
    sizes, side = size[order], order >= cross if cross else None
    root = np.arange(n)
    out: list[tuple[int, int]] = []
    for i in range(n):
        high = np.searchsorted(sizes, sizes[i] * den // num, "right")
        other = root[i + 1 : high] != root[i]
        if side is not None:
            other &= side[i + 1 : high] != side[i]
        if not other.any():
            continue
        own = gram[row[i] : row[i + 1]]
        overlap = np.bincount(np.concatenate([posting[starts[g] : starts[g + 1]] for g in own]), minlength=n)[i + 1 : high] if len(own) else np.zeros(high - i - 1, np.int64)
        near = np.flatnonzero(other & (overlap * den >= num * (sizes[i] + sizes[i + 1 : high] - overlap))) + i + 1
        for j in near.tolist():
            if root[i] != root[j]:
                root[root == root[j]] = root[i]
                out.append((int(order[i]), int(order[j])))
    return out


def jaccard_components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id) of every row: documents of a component reach each other by
    links, which join sets with den * |a & b| >= num * |a | b|.

    * A null text or one without words has no shingles (n_shingles 0) and is linked with nothing.
    * A text of fewer than n words is one shingle, its whole sequence of words.
    * component_id is the least key of the component, the row's own if it has no link. Rows with
      equal keys are kept each, and each of their texts has its own links. Rows without a key link like
      others, also where only they tie two documents together, but name no component: their own is null.
    * Equal sets are one class from the start, so copies of any number cost one comparison. Sets are
      of 64-bit hashes: the result is exact but for their collisions.
    * Whole texts count, and other columns are ignored. An empty table gives an empty result.
    """
    kind = docs.schema[key].dataType.simpleString()
    order = docs.sparkSession.sparkContext.broadcast(frequencies(docs, n, text))

    def read(batches):
        hashes = WordHashes()
        seen: set[int] = set()
        for batch in batches:
            sets = [shingles(t, n, hashes) for t in batch[text]]
            k1 = np.fromiter(map(class_key, sets), np.int64, len(sets))
            k2 = np.fromiter(map(second_key, sets), np.int64, len(sets))
            new = []  # a class that the task has met has been given its signatures
            for i, h in enumerate(k1.tolist()):
                if len(sets[i]) and h not in seen:
                    new.append(i)
                    seen.add(h)
            if len(seen) > 1_000_000:
                seen.clear()
            firsts = [signatures(sets[i], order.value, num, den) for i in new]
            count = np.zeros(len(sets), np.int64)
            count[np.array(new, np.int64)] = [*map(len, firsts)]
            sig = np.concatenate([np.zeros(0, U), *firsts])
            sketched: list[bytes | None] = [None] * len(sets)
            for i in new:
                sketched[i] = sketch(sets[i])
            yield {
                key: batch[key], "n_shingles": pa.array(np.fromiter(map(len, sets), np.int64, len(sets))), "k1": pa.array(k1), "k2": pa.array(k2),
                "sigs": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), pa.array(sig.view(np.int64))),
                "sketch": sketched,
            }

    known = cut(map_rows(docs, [key, text], read, f"`{key}` {kind}, n_shingles long, k1 long, k2 long, sigs array<long>, sketch binary", PIECE))

    # signatures are shuffled once; those of one class go
    given = known.filter("n_shingles > 0")
    sketches = given.filter(F.col("sketch").isNotNull()).select("k1", "sketch").dropDuplicates(["k1"])
    by_sig = Window.partitionBy("sig")
    parts = given.select(F.explode("sigs").alias("sig"), "k1", F.col("n_shingles").alias("n"))
    parts = parts.withColumns({"lead": F.min("k1").over(by_sig), "most": F.max("k1").over(by_sig)}).filter("lead < most")
    level = F.floor(F.log("n") / math.log(1.05)).cast("int").alias("level")
    together = cut(parts.select("sig", "k1", "n").distinct().select("*", level, F.count(F.lit(1)).over(by_sig).alias("members")))

    # stars: classes of a signature with the least class of it and of nearly their size, and these, in the
    # order of sizes, with one another; a gap of sizes that no link spans parts them
    leads = together.groupBy("sig", "level").agg(F.min(F.struct("k1", "n")).alias("lead"), F.min("n").alias("least"), F.max("n").alias("most"), F.max("members").alias("m"))
    by_size = by_sig.orderBy("level")  # a few hundred levels of a signature at most
    steps = leads.select("lead", F.lag("lead").over(by_size).alias("to"), "least", F.lag("most").over(by_size).alias("below"), "m")
    steps = steps.filter(F.col("least") * num <= F.col("below") * den).select("lead", "to", "m")
    same = together.join(leads.select("sig", "level", F.col("lead").alias("to")), ["sig", "level"]).select(F.struct("k1", "n").alias("lead"), "to", "members")
    stars = same.union(steps).select(F.col("lead.k1").alias("x"), F.col("lead.n").alias("nx"), F.col("to.k1").alias("y"), F.col("to.n").alias("ny"), "members")

    # near copies are tied by near pairs of the stars alone. Pairs of a signature that these leave apart are
    # made while they are few beside all signatures, from the least shared ones on, and the near ones tied;
    # of signatures that more share, the stars are
    copies = connected(near_pairs(stars, sketches, num, den), "k1", "lead")
    apart = together.join(copies, F.col("k1") == F.col("node"), "left").select("sig", "k1", "n", "members", F.coalesce("label", "k1").alias("group"))
    apart = apart.withColumn("others", F.col("members") - F.count(F.lit(1)).over(Window.partitionBy("sig", "group")))
    apart = cut(apart.filter("others > 0"))
    tally = apart.groupBy(F.length(F.bin(F.col("members") - 1)).alias("bits")).agg((F.sum("others") / 2).alias("pairs"))
    left, few = given.agg(F.coalesce(F.sum(F.size("sigs")), F.lit(0))).first()[0] / PAIRS, 1
    for row in tally.orderBy("bits").collect():  # one row for each number of bits
        if (left := left - row.pairs) < 0:
            break
        few = 1 << row.bits
    else:
        few = 1 << 62
    one, two = (apart.filter(F.col("members") <= few).select("sig", F.col("k1").alias(c), F.col("n").alias(f"n{c}"), F.col("group").alias(f"g{c}")) for c in "xy")
    pairs = near_pairs(one.join(two, "sig").filter("x < y and gx <> gy"), sketches, num, den)
    more = stars.filter(F.col("members") > few).select("x", "y")
    ties = copies.union(pairs).union(more).toDF("k1", "lead").filter("k1 <> lead").distinct()
    near = connected(ties, "k1", "lead")
    near = near.union(near.select(F.col("label").alias("node"), "label").distinct())

    # one document of each class to compare, with the class's group of candidates; a group of more
    # than one side is split by sizes, each document among those of its size and those it can reach
    reps = known.filter("n_shingles > 0").groupBy("k1", "k2", "n_shingles").agg(F.min(key).alias("rep"))
    reps = cut(reps.join(near, F.col("k1") == F.col("node")).select("rep", "k1", "k2", "label", "n_shingles"))
    held = F.greatest(F.ceil(F.count(F.lit(1)) / SIDE), F.ceil(F.sum("n_shingles") / SIDE_GRAMS)).cast("int").alias("sides")
    groups = reps.groupBy(F.col("label").alias("l")).agg(F.count(F.lit(1)).alias("members"), held).filter("members > 1")
    low, high = (F.floor(F.log(F.col("n_shingles") * r) / math.log(1.02 * den / num) + e).cast("int") for r, e in ((1, 0), (den / num, 1e-9)))
    level = F.when(F.col("sides") > 1, F.sequence(low, high)).otherwise(F.array(F.lit(0)))
    reps = cut(reps.join(groups, F.col("label") == F.col("l")).select("rep", "k1", "k2", "label", "n_shingles", F.explode(level).alias("level")))
    sizes = reps.groupBy(F.col("label").alias("l"), F.col("level").alias("v")).agg(F.count(F.lit(1)).alias("members"), held).filter("members > 1")
    reps = reps.join(sizes, (F.col("label") == F.col("l")) & (F.col("level") == F.col("v")))
    place = F.struct("level", "sides", F.pmod(F.xxhash64("k1"), F.col("sides")).cast("int").alias("side"))
    reps = cut(reps.groupBy("rep", "k1", "k2", "label").agg(F.collect_list(place).alias("places")))  # two at most
    members = docs.select(F.col(key).alias("rep"), F.col(text).alias("t")).join(bounded(reps.filter(F.col("rep").isNotNull())), "rep").filter(F.length("t") > 0)

    def sets_of(batches):
        hashes = WordHashes()
        for batch in batches:
            sets = [shingles(t, n, hashes) for t in batch["t"]]
            own = [i for i, s in enumerate(sets) if class_key(s) == batch["k1"][i]]  # a key may have other texts, too
            yield {c: [batch[c][i] for i in own] for c in ("k1", "label", "places")} | {"grams": [sets[i].tobytes() for i in own]}

    def sets_of_all(batches):
        hashes, seen = WordHashes(), set()
        for batch in batches:
            sets = [s for t in batch[text] if len(s := shingles(t, n, hashes))]
            new = {class_key(s): s for s in sets}
            sets = [s for k, s in new.items() if k not in seen]  # copies once in a task
            seen.update(new)
            yield {"c1": pa.array([class_key(s) for s in sets], pa.int64()), "c2": pa.array([second_key(s) for s in sets], pa.int64()), "grams": [s.tobytes() for s in sets]}
            if len(seen) > 1_000_000:
                seen.clear()

    rows = map_rows(members, ["rep", "k1", "label", "places", "t"], sets_of, "k1 long, label long, places array<struct<level: int, sides: int, side: int>>, grams binary", PIECE)
    nameless = reps.filter(F.col("rep").isNull()).select("k1", "k2", "label", "places")
    if not nameless.isEmpty():  # classes that only rows without a key have are found by their sets
        sets = map_rows(docs.filter(F.col(key).isNull()), [text], sets_of_all, "c1 long, c2 long, grams binary", PIECE)
        sets = sets.join(bounded(nameless), (F.col("c1") == F.col("k1")) & (F.col("c2") == F.col("k2")))
        rows = rows.union(sets.select("k1", "label", "places", "grams"))
    rows = rows.select("k1", "label", "grams", F.inline("places")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)))
    rows = rows.select(
        "k1", "label", "level", "grams", F.least("side", "with").alias("a"), F.greatest("side", "with").alias("b"), (F.col("side") <= F.col("with")).alias("left")
    )

    def compare(table: pa.Table) -> pa.Table:
        name, left = table.column("k1").to_pylist(), table.column("left").to_pylist()
        sets = {r: np.frombuffer(g, U) for r, g in zip(name, table.column("grams").to_pylist(), strict=True)}
        one = table.column("a")[0].as_py() == table.column("b")[0].as_py()
        names = [sorted({r for r, ok in zip(name, left, strict=True) if ok == want}) for want in ((True, False) if not one else (True,))]
        flat = [*chain.from_iterable(names)]
        found = block_links([sets[r] for r in names[0]], None if one else [sets[r] for r in names[1]], num, den)
        return pa.table({"x": pa.array([flat[i] for i, _ in found], pa.int64()), "y": pa.array([flat[j] for _, j in found], pa.int64())})

    links = rows.groupBy("label", "level", "a", "b").applyInArrow(compare, "x long, y long")
    joined = connected(links, "x", "y")

    # back to all documents: class -> component -> its least key
    classes = known.filter("n_shingles > 0").groupBy("k1", "k2").agg(F.min(key).alias("rep"))
    classes = cut(classes.join(bounded(joined), F.col("k1") == F.col("node"), "left").select(F.col("k1").alias("c1"), F.col("k2").alias("c2"), "rep", "label"))
    linked = classes.select(F.coalesce("label", "c1").alias("l"), "rep").groupBy("l").agg(F.min("rep").alias("component"))
    classes = classes.join(linked, F.coalesce("label", "c1") == F.col("l")).select("c1", "c2", "component")
    out = known.select(key, "n_shingles", "k1", "k2").join(classes, (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")) & (F.col("n_shingles") > 0), "left")
    return out.select(key, "n_shingles", F.when(F.col(key).isNotNull(), F.coalesce("component", F.col(key))).alias("component_id"))
