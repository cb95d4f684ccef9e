"""Token counts: the exact histogram of encoded lengths, and what follows from it for every limit."""

from __future__ import annotations

import base64
import heapq
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, map_rows

#: How a text falls into pieces before the merges of the rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PIECES = regex.compile(PATTERN)
#: Pieces of more characters than this are merged here: the library's search for pieces and its merges
#: take too long, or fail, on a million equal signs.
LONG_PIECE = 2000
LONG_RUN = re.compile(rf"\s{{{LONG_PIECE}}}|[^\s]{{{LONG_PIECE}}}")
#: Lengths of a bucket; suffix sums run inside buckets and over the totals of buckets.
BUCKET = 1024


@lru_cache(2)
def encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def merged(piece: bytes, ranks: dict[bytes, int]) -> int:
    """Tokens of one piece: the pair of least rank, the leftmost first, is merged until none is left."""
    n = len(piece)
    end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    left = n
    while heap:
        _, i, middle, stop = heapq.heappop(heap)
        if end[i] != middle or middle >= n or end[middle] != stop:
            continue  # one of the two has been merged since
        end[i], end[middle], after[i] = stop, 0, stop
        left -= 1
        if stop < n:
            before[stop] = i
            if (r := ranks.get(piece[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, stop, end[stop]))
        if (j := before[i]) >= 0 and (r := ranks.get(piece[j:stop])) is not None:
            heapq.heappush(heap, (r, j, i, stop))
    return left


def count_tokens(text: str | None, coder: tiktoken.Encoding) -> int:
    """Tokens of a whole text; null has none."""
    if not text:
        return 0
    if not LONG_RUN.search(text):
        return len(coder.encode_ordinary(text))
    pieces = PIECES.findall(text)
    long = [p for p in pieces if len(p) > LONG_PIECE]
    # a piece falls into itself, so the short ones may be counted alone
    each = Counter(p for p in pieces if len(p) <= LONG_PIECE)
    return sum(n * len(coder.encode_ordinary(p)) for p, n in each.items()) + sum(merged(p.encode(), coder._mergeable_ranks) for p in long)


def with_token_counts(docs: DataFrame, vocab_path: str, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns and n_tokens (long) of every row; null texts have 0 tokens. Whole texts of any
    length are encoded; special tokens in a text are text."""

    def run(batches):
        coder = encoding(vocab_path)
        for batch in batches:
            n = np.fromiter((count_tokens(t, coder) for t in batch[text]), np.int64, len(batch[text]))
            yield {c: batch[c] for c in keep} | {"n_tokens": pa.array(n)}

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return map_rows(docs, [*keep, text], run, f"{fields}{', ' if keep else ''}n_tokens long")


def length_histogram(lengths: DataFrame, by: str | None = None, column: str = "n_tokens") -> DataFrame:
    """One row for each group and length: docs, tokens, and from the sums over all longer ones

    * docs_ge, tokens_ge: documents of at least this length and their tokens,
    * docs_total, tokens_total: of the whole group,
    * truncated_tokens: what is left of the group if every document is cut to this length,
    * share_le: share of the group's documents that are no longer; the p quantile is the least
      length with share_le >= p.

    For a context limit L between two lengths, take the row of the least length a > L:
    tokens_total - tokens_ge + L * docs_ge. Groups may be null; an empty table gives no rows.
    Only lengths are shuffled, after counts within each task, so no group meets in one task.
    """
    group = [F.col(by).alias("grp")] if by else [F.lit(None).cast("string").alias("grp")]
    counts = lengths.groupBy(*group, F.col(column).alias("n_tokens")).agg(F.count(F.lit(1)).alias("docs"))
    counts = cut(counts.withColumn("tokens", F.col("docs") * F.col("n_tokens")).withColumn("bucket", F.floor(F.col("n_tokens") / BUCKET)))
    buckets = counts.groupBy("grp", "bucket").agg(F.sum("docs").alias("b_docs"), F.sum("tokens").alias("b_tokens"))
    above = Window.partitionBy("grp").orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("grp")
    buckets = buckets.select(
        F.col("grp").alias("g"), F.col("bucket").alias("b"),
        F.coalesce(F.sum("b_docs").over(above), F.lit(0)).alias("docs_above"),
        F.coalesce(F.sum("b_tokens").over(above), F.lit(0)).alias("tokens_above"),
        F.sum("b_docs").over(whole).alias("docs_total"), F.sum("b_tokens").over(whole).alias("tokens_total"),
    )
    inside = Window.partitionBy("grp", "bucket").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    out = counts.withColumns({"d": F.sum("docs").over(inside), "t": F.sum("tokens").over(inside)})
    out = out.join(buckets, F.col("grp").eqNullSafe(F.col("g")) & (F.col("bucket") == F.col("b")))
    docs_ge, tokens_ge = F.col("d") + F.col("docs_above"), F.col("t") + F.col("tokens_above")
    return out.select(
        "grp", "n_tokens", "docs", "tokens", docs_ge.alias("docs_ge"), tokens_ge.alias("tokens_ge"), "docs_total", "tokens_total",
        (F.col("tokens_total") - tokens_ge + docs_ge * F.col("n_tokens")).alias("truncated_tokens"),
        (1 - (docs_ge - F.col("docs")) / F.col("docs_total")).alias("share_le"),
    )


def limits(histogram: DataFrame, contexts: list[int]) -> DataFrame:
    """For each group and context limit: documents over it, tokens kept and tokens cut off."""
    at = histogram.withColumn("context", F.explode(F.array(*[F.lit(c).cast("long") for c in contexts])))
    longer = F.col("n_tokens") > F.col("context")
    return at.groupBy("grp", "context").agg(
        F.sum(F.when(longer, F.col("docs")).otherwise(0)).alias("docs_over"),
        F.sum(F.col("docs") * F.least("n_tokens", "context")).alias("tokens_kept"),
        F.sum(F.when(longer, F.col("docs") * (F.col("n_tokens") - F.col("context"))).otherwise(0)).alias("tokens_cut"),
    )
