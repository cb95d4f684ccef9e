"""Alignment of two tokenizers: which tokens of one stand for which tokens of the other.

Both encode the same bytes, so a place where tokens of both end cuts them into groups. Cuts are found
by divide and conquer: of an interval between two cuts, the end of the middle token of the one
tokenizer is looked up among the ends of the other by bisection, then its neighbours in widening
steps to both sides; at the common end nearest to the middle the interval is halved, and one without
any is a group. All intervals of many texts take a step together.

Corpus-wide counts of linked tokens need all documents before any of them can be judged. So texts are
encoded and aligned once, their links are written, and counted from there. The most frequent pairs,
of a bounded number, go to all tasks; what is left of each document, rare pairs only, is joined by pair.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import slices, spans, vocabulary
from .common import cut, map_rows, new_path, share_vocabulary
from .tokens import LONG_PIECE, LONG_RUN, PATTERN, PIECES

#: Pairs whose counts go to all tasks, at most (17 bytes each); rarer ones are joined by a shuffle.
HEAD_PAIRS = 1_000_000
#: Different pairs that a counting task holds.
KEPT_PAIRS = 2_000_000
#: Texts that a task holds at a time.
PIECE = 500


class ByteLevel:
    """Ids by a byte-level vocabulary file; its special tokens' strings are plain text."""

    def __init__(self, path: str):
        self.vocab = vocabulary(path)
        special = set(self.vocab.special.values())
        self.bytes = self.vocab.bytes
        ranks = {b: i for i, b in enumerate(self.bytes) if b and i not in special}
        made = [new for _, new in sorted(self.vocab.merges.values())]
        if made != sorted(made):
            raise ValueError("ids must be in the order of the merges")
        self.coder = tiktoken.Encoding("aligned", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.one(" " + t) for t in texts]

    def one(self, text: str) -> list[int]:
        if not LONG_RUN.search(text):
            return self.coder.encode_ordinary(text)
        known: dict[str, list[int]] = {}
        out: list[int] = []
        for p in PIECES.findall(text):  # a piece falls into itself, so each may be encoded alone
            if p not in known:
                known[p] = self.coder.encode_ordinary(p) if len(p) <= LONG_PIECE else self.vocab.merge(p.encode())
            out += known[p]
        return out


class Pieces:
    """Ids by a sentencepiece model, which adds the blank before a text itself."""

    def __init__(self, path: str):
        self.coder = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.coder.get_piece_size()
        self.bytes = [bytes([int(p[3:5], 16)]) if self.coder.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(self.coder.id_to_piece, range(n)))]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.coder.encode(texts, num_threads=1)


class Joined:
    """Ids of many texts in one array, with the ends of texts and of tokens."""

    def __init__(self, ids: list[list[int]]):
        self.n = np.fromiter(map(len, ids), np.int64, len(ids))
        self.ids = np.concatenate([np.zeros(0, np.int64), *(np.array(x, np.int64) for x in ids)])

    def sized(self, sizes: np.ndarray) -> Joined:
        self.last = np.cumsum(self.n)
        self.ends = np.cumsum(sizes[self.ids])
        return self


@lru_cache(2)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(ByteLevel(path_a), Pieces(path_b))


def common_ends(a: np.ndarray, b: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Places in ``a`` whose values are in ``b``, too; both ascend. ``high`` are such places already, and
    what is looked for lies between a ``low`` and its ``high``."""
    found = [high]
    while True:
        inner = high - low > 1
        low, high = low[inner], high[inner]
        if not len(low):
            return np.sort(np.concatenate(found))
        middle, best = (low + high) // 2, np.full(len(low), -1)
        rest, near, far = np.arange(len(low)), 0, 1
        while len(rest):  # places of a distance from near to far - 1 from the middle
            m, left, right = middle[rest], low[rest] + 1, high[rest] - 1
            first = np.concatenate([np.maximum(left, m - far + 1), m + max(near, 1)])
            last = np.concatenate([m - near, np.minimum(right, m + far - 1)])
            size = np.maximum(last - first + 1, 0)
            at, owner = spans(first, size), np.repeat(np.tile(np.arange(len(rest)), 2), size)
            place = np.minimum(np.searchsorted(b, a[at]), len(b) - 1)
            ok = b[place] == a[at]
            at, owner = at[ok], owner[ok]
            score = np.full(len(rest), np.iinfo(np.int64).max)
            np.minimum.at(score, owner, 2 * np.abs(at - m[owner]) + (at > m[owner]))
            hit = score < np.iinfo(np.int64).max
            gap = score[hit] // 2
            best[rest[hit]] = np.where(score[hit] % 2 == 1, m[hit] + gap, m[hit] - gap)
            rest = rest[~hit & ((m - far >= left) | (m + far <= right))]
            near, far = far, 2 * far
        split = best >= 0
        at, low, high = best[split], low[split], high[split]
        found.append(at)
        low, high = np.concatenate([low, at]), np.concatenate([at, high])


class Aligner:
    def __init__(self, a: ByteLevel, b: Pieces):
        self.a, self.b = a, b
        self.sizes = [np.fromiter(map(len, x.bytes), np.int64, len(x.bytes)) for x in (a, b)]
        #: A group is written as ids of a, a bar, ids of b; groups are parted by semicolons.
        self.signs = [f"{i}{s}".encode() for n, last in ((len(a.bytes), "|"), (len(b.bytes), ";")) for i in range(n) for s in (",", last)]

    def same_bytes(self, text: str, ids: list[int], tokens: list[bytes]) -> bool:
        return b"".join(map(tokens.__getitem__, ids)) == b" " + text.encode()

    def align(self, texts: list[str | None]) -> dict[str, list | np.ndarray]:
        """n_a, n_b, n_groups, digest of the groups, and the links' codes, in order, of every text."""
        rows = [i for i, t in enumerate(texts) if t]
        given = [texts[i] for i in rows]
        ids_a, ids_b = self.a.encode(given), self.b.encode(given)
        ok = [self.same_bytes(t, x, self.a.bytes) and self.same_bytes(t, y, self.b.bytes) for t, x, y in zip(given, ids_a, ids_b, strict=True)]
        rows = np.array([i for i, k in zip(rows, ok, strict=True) if k], np.int64)
        a = Joined([x for x, k in zip(ids_a, ok, strict=True) if k]).sized(self.sizes[0])
        b = Joined([x for x, k in zip(ids_b, ok, strict=True) if k]).sized(self.sizes[1])
        cut_a = common_ends(a.ends, b.ends, np.concatenate([[-1], a.last[:-1] - 1]) if len(rows) else rows, a.last - 1)
        cut_b = np.searchsorted(b.ends, a.ends[cut_a])
        out = {k: np.zeros(len(texts), np.int64) for k in ("n_a", "n_b", "n_groups")}
        out["n_a"][rows], out["n_b"][rows] = a.n, b.n
        until = np.searchsorted(cut_a, a.last)  # cuts up to the end of each text
        out["n_groups"][rows] = np.diff(until, prepend=0)
        out["groups"] = self.digests(len(texts), rows, a, b, cut_a, cut_b)
        out["links"] = a.ids[cut_a] * len(self.b.bytes) + b.ids[cut_b]
        return out

    def digests(self, n: int, rows: np.ndarray, a: Joined, b: Joined, cut_a: np.ndarray, cut_b: np.ndarray) -> list[str]:
        signs = np.empty(len(a.ids) + len(b.ids), np.int64)
        for side, other, own, against, first in ((a, 0, cut_a, cut_b, 0), (b, 1, cut_b, cut_a, 2 * len(self.a.bytes))):
            ends = np.zeros(len(side.ids), np.int64)
            ends[own] = 1
            group = np.cumsum(ends) - ends
            # before a token stand all earlier ones of its side and those of the other side's groups before it
            before = np.concatenate([[0], against + 1])[group + other]
            signs[np.arange(len(side.ids)) + before] = first + 2 * side.ids + ends
        out, table, at = [""] * n, self.signs, 0
        for row, size in zip(rows.tolist(), (a.n + b.n).tolist(), strict=True):
            out[row] = hashlib.sha256(b"".join(map(table.__getitem__, signs[at : at + size].tolist()))[:-1]).hexdigest()
            at += size
        return out


def lists(values: np.ndarray, size: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(values))


def aligned(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_a, n_b, n_groups, groups_sha256, pairs, times) of every row, written once; pairs are the codes
    id_a * ids_b + id_b of the different linked ids, ids_b being the number of ids of the second tokenizer,
    and times says how often they are linked in the text."""

    names = [share_vocabulary(docs.sparkSession, p) for p in (path_a, path_b)]

    def run(batches):
        own = aligner(*map(SparkFiles.get, names))
        radix = len(own.a.bytes) * len(own.b.bytes)
        for batch in batches:
            keys, at = batch[key], 0
            for texts in slices([t or "" for t in batch[text]]):
                found, every = own.align(texts), np.arange(len(texts))
                codes, times = np.unique(np.repeat(every, found["n_groups"]) * radix + found["links"], return_counts=True)
                size = np.bincount(codes // radix, minlength=len(texts))
                yield {
                    key: keys[at : at + len(texts)], **{c: pa.array(found[c]) for c in ("n_a", "n_b", "n_groups")}, "groups_sha256": found["groups"],
                    "pairs": lists(codes % radix, size), "times": lists(times, size),
                }
                at += len(texts)

    kind = docs.schema[key].dataType.simpleString()
    out = map_rows(docs, [key, text], run, f"`{key}` {kind}, n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<long>, times array<long>", PIECE)
    path = new_path(docs.sparkSession, "aligned")
    out.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.parquet(path)


def flat(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False)


def pair_counts(links: DataFrame) -> DataFrame:
    """(pair, n) of all links of all documents: summed in each task, then by pair."""

    def summed(pairs: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        named, at = np.unique(np.concatenate(pairs), return_inverse=True)
        n = np.zeros(len(named), np.int64)
        np.add.at(n, at, np.concatenate(times))
        return named, n

    def count(batches):
        pairs, times, held = [], [], 0
        for batch in batches:
            pairs.append(flat(batch, "pairs"))
            times.append(flat(batch, "times"))
            held += len(pairs[-1])
            if held > 2 * KEPT_PAIRS:
                named, n = summed(pairs, times)
                if len(named) > KEPT_PAIRS:
                    yield pa.RecordBatch.from_arrays([pa.array(named), pa.array(n)], ["pair", "n"])
                    pairs, times, held = [], [], 0
                else:
                    pairs, times, held = [named], [n], len(named)
        if held:
            yield pa.RecordBatch.from_arrays([*map(pa.array, summed(pairs, times))], ["pair", "n"])

    return links.select("pairs", "times").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def head_of(counts: DataFrame, size: int = HEAD_PAIRS) -> int:
    """The least count of the pairs that are among the first ``size``: of all pairs that occur as often as some
    power of two or more, the most that are no more than ``size``."""
    by = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("order")).agg(F.count(F.lit(1)).alias("pairs"))
    least, left = 1 << 62, size
    for r in by.orderBy(F.desc("order")).collect():  # one for each bit of n
        left -= r.pairs
        if left < 0:
            return least
        least = 1 << r.order
    return 1


def judged(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text", head: int = HEAD_PAIRS) -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of ``docs``.

    Links are pairs of a token of the first and one of the second tokenizer that end together; no token
    is empty, so every group has one, of its last tokens. n_best counts the links whose pair of ids is, of
    all pairs with that second id, linked most often in all documents (ties included), and count_sum adds
    up how often the links' pairs are linked there.

    * Texts that are null or empty, and texts whose bytes aren't those of the tokens of both sides (the
      second tokenizer may normalise), have no tokens: zeros, and '' for the digest.
    * Rows with equal or null keys are kept and counted each; an empty table gives an empty result.
      Whole texts of any length are encoded, other columns are ignored.
    """
    spark = docs.sparkSession
    links = aligned(docs, path_a, path_b, key, text).withColumn("row", F.monotonically_increasing_id())
    ids_b = sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
    counts = cut(pair_counts(links).withColumn("b", F.col("pair") % ids_b))
    most = counts.groupBy(F.col("b").alias("of")).agg(F.max("n").alias("most"))  # at most one row for each id of a vocabulary
    counts = cut(counts.join(F.broadcast(most), F.col("b") == F.col("of")).select("pair", "n", (F.col("n") == F.col("most")).alias("best")))
    least = head_of(counts, head)
    top = counts.filter(F.col("n") >= least).orderBy("pair").toArrow()
    shared = spark.sparkContext.broadcast(tuple(top[c].to_numpy() for c in ("pair", "n", "best")))
    rare = counts.filter(F.col("n") < least)
    kept = [key, "n_a", "n_b", "n_groups", "groups_sha256", "row"]

    def look(batches):
        known, n, best = shared.value
        for batch in batches:
            size = np.diff(batch.column("pairs").offsets.to_numpy())
            doc, pairs, times = np.repeat(np.arange(batch.num_rows), size), flat(batch, "pairs"), flat(batch, "times")
            at = np.minimum(np.searchsorted(known, pairs), max(0, len(known) - 1))
            there = known[at] == pairs if len(known) else np.zeros(len(pairs), bool)
            sums = [np.zeros(batch.num_rows, np.int64) for _ in range(2)]
            np.add.at(sums[0], doc[there], (times * best[at] if len(known) else times)[there])
            np.add.at(sums[1], doc[there], (times * n[at] if len(known) else times)[there])
            left = np.bincount(doc[~there], minlength=batch.num_rows)
            columns = [batch.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, sums), lists(pairs[~there], left), lists(times[~there], left)], [*kept, "n_best", "count_sum", "pairs", "times"])

    kind = docs.schema[key].dataType.simpleString()
    fields = f"`{key}` {kind}, n_a long, n_b long, n_groups long, groups_sha256 string, row long, n_best long, count_sum long, pairs array<long>, times array<long>"
    out = links.select(*kept, "pairs", "times").mapInArrow(look, fields)
    if not rare.isEmpty():
        out = cut(out)
        left = out.filter(F.size("pairs") > 0)
        apart = left.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
        more = apart.join(rare, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
        whole = left.drop("pairs", "times").join(more, "row").withColumns({"n_best": F.col("n_best") + F.col("more_best"), "count_sum": F.col("count_sum") + F.col("more_sum")})
        out = out.filter(F.size("pairs") == 0).select(*kept, "n_best", "count_sum").union(whole.select(*kept, "n_best", "count_sum"))
    return out.select(key, "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256")
