"""Pooled text error rates: edits of all rows over reference lengths of all rows.

Texts are brought to one form first: compatibility characters to plain ones, lower case, one kind of
apostrophe, and a table of characters folded through its chains. A character error rate counts letters,
marks and numbers; a mixed one counts Latin words and numbers, with the apostrophes inside them, as
one token each and every other letter, mark or number by itself.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from agreeline.sources.shared import ship

KEPT = r"\p{L}\p{M}\p{N}"
WORD = r"[\p{IsLatin}0-9&&[\p{L}0-9]]"
#: Groups are possessive, which Java's engine runs through in a loop, however long a word is.
TOKEN = rf"{WORD}++(?:'++{WORD}++)*+|[{KEPT}]"
# fixed values: characters that stand for an apostrophe, and the steps of a chain of folds that are followed
APOSTROPHES = {"\u2019": "'", "\u2018": "'", "\u02bc": "'"}
CHAIN = 4
#: Rows of the table of edits that are worked out at once.
BLOCK = 8192


def flat_folds(folds: dict[str, str]) -> dict[str, str]:
    """Every character of the table to the end of its chain, of four steps at most."""
    out = {}
    for c in folds:
        to = c
        for _ in range(CHAIN):
            if folds.get(to, to) == to:
                break
            to = folds[to]
        out[c] = to
    return out


def normal_form(text: Column, folds: dict[str, str] | None = None) -> Column:
    """The one form of a text; null stays null. Plain ASCII has it in lower case, but for folds, by Spark's
    own functions. Others go through one small function in Arrow batches, since Spark has no such one; of
    ASCII texts, only nulls go there."""
    flat = flat_folds(folds or {})
    table, more = str.maketrans(APOSTROPHES), str.maketrans(flat)

    @pandas_udf("string")
    def form(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).lower().translate(table).translate(more))

    plain = {c: to for c, to in flat.items() if c.isascii()}
    if any(len(c) != 1 or len(to) != 1 for c, to in plain.items()):
        return form(text)
    ascii_only = text.rlike("^[\\x00-\\x7F]*+\\z")
    lower = F.lower(text)
    if plain:
        lower = F.translate(lower, "".join(plain), "".join(plain.values()))
    return F.coalesce(F.when(ascii_only, lower), form(F.when(~ascii_only, text)))


def characters(normal: Column) -> Column:
    """A text in its one form without all but letters, marks and numbers."""
    return F.regexp_replace(normal, f"[^{KEPT}]", "")


def tokens(normal: Column) -> Column:
    """Words and single characters of a text in its one form."""
    return F.regexp_extract_all(normal, F.lit(TOKEN), F.lit(0))


def edit_distance(a: Sequence, b: Sequence, width: int = BLOCK) -> int:
    """Edit distance of two sequences, unit costs. A column of the table is held as two numbers of ``width``
    bits, its steps up and its steps down, and all of its cells are worked out at once; more than
    ``width`` rows are done block by block, each handing its lowest row's steps to the next."""
    first, last_a, last_b = 0, len(a), len(b)
    while first < min(last_a, last_b) and a[first] == b[first]:
        first += 1
    while first < min(last_a, last_b) and a[last_a - 1] == b[last_b - 1]:
        last_a, last_b = last_a - 1, last_b - 1
    a, b = a[first:last_a], b[first:last_b]
    if not len(a) or not len(b):
        return len(a) + len(b)
    steps = [1] * len(b)  # of the row above, from one column to the next
    for at in range(0, len(a), width):
        part = a[at : at + width]
        where: dict = {}
        for i, x in enumerate(part):
            where[x] = where.get(x, 0) | 1 << i
        mask, low = (1 << len(part)) - 1, 1 << (len(part) - 1)
        up, down = mask, 0
        for j, y in enumerate(b):
            equal, step = where.get(y, 0), steps[j]
            vertical = equal | down
            if step < 0:
                equal |= 1
            diagonal = (((equal & up) + up) ^ up) | equal
            more, less = down | (mask & ~(diagonal | up)), up & diagonal
            steps[j] = 1 if more & low else -1 if less & low else 0
            more, less = more << 1 | (step > 0), less << 1 | (step < 0)
            up, down = (less | ~(vertical | more)) & mask, more & vertical & mask
    return len(a) + sum(steps)


def token_edits(a: Column, b: Column) -> Column:
    """Edit distance of two arrays of tokens, unit costs; null if one is null. Arrow batches go through
    ``edit_distance``, which Spark has for texts only."""

    @pandas_udf("long")
    def edits(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for left, right in batches:
            yield pd.Series([None if x is None or y is None else edit_distance(x.tolist(), y.tolist()) for x, y in zip(left, right, strict=True)], dtype="Int64")

    ship(SparkSession.getActiveSession())
    return edits(a, b)


def character_error(pairs: DataFrame, ref: str, hyp: str, by: list[str] | None = None, folds: dict[str, str] | None = None) -> DataFrame:
    """(n_pairs, edits, n_ref, cer_pm) pooled over rows."""
    p = pairs.withColumns({"_r": normal_form(F.col(ref), folds), "_h": normal_form(F.coalesce(F.col(hyp), F.lit("")), folds)})
    p = p.withColumns({"_r": characters(F.col("_r")), "_h": characters(F.col("_h"))})
    return _pool(p, F.levenshtein("_r", "_h"), F.length("_r"), by, "cer_pm")


def mixed_error(pairs: DataFrame, ref: str, hyp: str, by: list[str] | None = None, folds: dict[str, str] | None = None) -> DataFrame:
    p = pairs.withColumns({"_r": normal_form(F.col(ref), folds), "_h": normal_form(F.coalesce(F.col(hyp), F.lit("")), folds)})
    p = p.withColumns({"_r": tokens(F.col("_r")), "_h": tokens(F.col("_h"))})
    return _pool(p, token_edits(F.col("_r"), F.col("_h")), F.size("_r"), by, "mer_pm")


def scored(references: DataFrame, predictions: DataFrame, metric: str, folds: dict[str, str] | None = None) -> DataFrame:
    """One row of (n_pairs, edits, n_ref, rate) of predictions (id, hyp) against references (id, ref). Both
    must have each id once, and the same ids, and every reference must have something to count;
    otherwise it fails."""
    units = {"cer": characters, "mer": tokens}[metric]
    lengths = references.select("id", F.length(characters(normal_form(F.col("ref"), folds))).alias("n"))
    r = lengths.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("d"), F.count_if(F.coalesce(F.col("n"), F.lit(0)) == 0).alias("empty")).first()
    h = predictions.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("d")).first()
    both = references.join(predictions.select(F.col("id").alias("_id"), "hyp"), F.col("id") == F.col("_id"))
    met = both.count()
    wrong = {"repeated references": r.n - r.d, "repeated predictions": h.n - h.d, "empty references": r["empty"], "missing": r.n - met, "extra": h.n - met}
    if any(wrong.values()) or not r.n:
        raise ValueError(f"references and predictions don't match: {wrong}")
    if metric == "mer" and both.filter(F.size(units(normal_form(F.col("ref"), folds))) == 0).count():
        raise ValueError("a reference has no tokens")
    return (character_error if metric == "cer" else mixed_error)(both, "ref", "hyp", None, folds)


def _pool(p: DataFrame, edits: Column, size: Column, by: list[str] | None, name: str) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("n_pairs"), F.sum(edits).cast("long").alias("edits"), F.sum(size).cast("long").alias("n_ref")]
    out = p.groupBy(*by).agg(*aggs) if by else p.agg(*aggs)
    return out.withColumn(name, F.round(1000 * F.try_divide(F.col("edits").cast("double"), F.col("n_ref").cast("double")), 6))
