"""Batch prediction: one text per segment, a labeller over batches, one row per unit."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sequences(units: DataFrame, segment: str, pos: str, unit: str, token: str) -> DataFrame:
    """(segment, ids, tokens, ordered): the units of each segment in order; ordered is false where
    positions repeat."""
    rows = units.groupBy(segment).agg(F.sort_array(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(unit).alias("i"), F.col(token).alias("t")))).alias("_s"))
    return rows.select(
        segment, F.transform("_s", lambda x: x["i"]).alias("ids"), F.transform("_s", lambda x: x["t"]).alias("tokens"),
        (F.size(F.array_distinct(F.transform("_s", lambda x: x["p"]))) == F.size("_s")).alias("ordered"),
    )


def predict(seqs: DataFrame, segment: str, labeller: Callable[[list[list[str]]], list[list[str]]], missing: str = "?", batch: int = 200) -> DataFrame:
    """(segment, ids, labels): ``labeller`` gets batches of token lists and must give a label for each
    token; empty labels become ``missing``."""
    kind, ids = seqs.schema[segment].dataType.simpleString(), seqs.schema["ids"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), batch):
                part = f.iloc[at : at + batch]
                given = [list(t) for t in part["tokens"]]
                got = labeller(given)
                if [len(g) for g in got] != [len(g) for g in given]:
                    raise ValueError("a label is missing or too many")
                yield pd.DataFrame({segment: part[segment], "ids": part["ids"], "labels": [[x or missing for x in g] for g in got]})

    return seqs.select(segment, "ids", "tokens").mapInPandas(run, f"`{segment}` {kind}, ids {ids}, labels array<string>")


def streamed(
    units: DataFrame, segment: str, pos: str, unit: str, token: str, step: Callable[[object, list[str]], tuple[object, list[str]]], missing: str = "?", batch: int = 10_000
) -> DataFrame:
    """(id, hyp) of all units, where a segment may be of any length: its units come in order, by position and id,
    at most ``batch`` at a time, and ``step`` gets what it gave last (None at a segment's beginning)
    and the tokens, and gives what it needs next time and a label for each token. A task holds one batch and that
    state; units of null segments are one segment, empty labels become ``missing``."""
    kind = units.schema[unit].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = object(), None
        for f in frames:
            ends = [*(f["g"] != f["g"].shift()).to_numpy().nonzero()[0], len(f)]
            for first, until in zip(ends, ends[1:], strict=False):
                for at in range(first, until, batch):
                    part = f.iloc[at : min(at + batch, until)]
                    if part["g"].iat[0] != last:
                        last, state = part["g"].iat[0], None
                    state, labels = step(state, part["t"].tolist())
                    if len(labels) != len(part):
                        raise ValueError("a label is missing or too many")
                    yield pd.DataFrame({"id": part["i"].to_numpy(), "hyp": [x or missing for x in labels]})

    # null and text are told apart by the first character
    g = F.when(F.col(segment).isNull(), "0").otherwise(F.concat(F.lit("1"), F.col(segment).cast("string")))
    rows = units.select(g.alias("g"), F.col(pos).alias("p"), F.col(unit).alias("i"), F.col(token).alias("t"))
    return rows.repartition("g").sortWithinPartitions("g", "p", "i").select("g", "i", "t").mapInPandas(run, f"id {kind}, hyp string")


def by_unit(predicted: DataFrame) -> DataFrame:
    """(id, hyp) rows."""
    return predicted.select(F.explode(F.arrays_zip("ids", "labels")).alias("x")).select(F.col("x.ids").alias("id"), F.col("x.labels").alias("hyp"))


def per_character(label_words: Callable[[str], list[tuple[str, list[str] | None]]], missing: str = "?") -> Callable[[list[list[str]]], list[list[str]]]:
    """A labeller of single characters from one of words. ``label_words`` gives the words of a text, each
    with a label for every character or none. Words whose labels don't fit are asked for again one
    character at a time; what has no label then, or more than one, is ``missing``. Words that don't make up
    the text fail."""

    def one(text: str) -> list[str]:
        words = label_words(text)
        if "".join(w for w, _ in words) != text:
            raise ValueError("the words don't make up the text")
        out: list[str] = []
        for word, labels in words:
            if labels is None:
                out += [missing] * len(word)
            elif len(labels) == len(word):
                out += [x or missing for x in labels]
            else:
                for c in word:
                    again = label_words(c)
                    fits = len(again) == 1 and again[0][0] == c and again[0][1] is not None and len(again[0][1]) == 1
                    out.append(again[0][1][0] if fits else missing)
        return out

    def labeller(batch: list[list[str]]) -> list[list[str]]:
        return [one("".join(tokens)) for tokens in batch]

    return labeller
