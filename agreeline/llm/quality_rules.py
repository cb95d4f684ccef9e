"""Quality rules with verdicts by host.

Rules are measured on whole texts. Failures are added up by host, and each host's failure rate is
shrunk by a beta prior that is fitted to all hosts' rates, so that a host of few documents needs
clear evidence. Documents of hosts whose shrunk rate is too high are dropped with them.
"""

from __future__ import annotations

import re
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, cut, map_rows

BLANKS = " \t\n\x0b\x0c\r"
SIGNS = re.compile(r"[#*$%&|<>]")
#: A host fails if its shrunk rate of failing documents is above this.
HOST_LIMIT = 0.5


def repeated_words(words: list, n: int = 5) -> int:
    """Words that lie in n-word windows which occur twice or more in the text."""
    if len(words) <= n:
        return 0
    number = dict(zip(dict.fromkeys(words), count()))
    w = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    mixed, windows = w[: len(w) - n + 1], w[: len(w) - n + 1]
    for i in range(1, n):
        mixed = mixed * 6364136223846793005 + w[i : len(w) - n + 1 + i]
    mixed = np.sort(mixed)
    if not (mixed[1:] == mixed[:-1]).any():  # equal windows have equal mixes
        return 0
    bound = len(number)
    for i in range(1, n):  # pairs of (window so far, next word) get new numbers
        if bound * len(number) >= 1 << 62:
            held, windows = np.unique(windows, return_inverse=True)
            bound = len(held)
        windows, bound = windows * len(number) + w[i : len(w) - n + 1 + i], bound * len(number)
    _, windows, times = np.unique(windows, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(times[windows] > 1)
    marked = np.zeros(len(w) + 1, np.int64)
    np.add.at(marked, starts, 1)
    np.add.at(marked, starts + n, -1)
    return int((np.cumsum(marked) > 0).sum())


def measures(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each whole text."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def of(t: str | None) -> tuple[int, int, int, int, int]:
        words = t.encode().split() if t else []  # of bytes: only ASCII white space parts them
        if not words:
            return 0, 0, 0, 0, 0
        lines = t.split("\n")
        dup = 0
        if len(set(lines)) < len(lines):
            full = [x for x in lines if x.strip(BLANKS)]
            dup = len(full) - len(set(full))
        return len(words), len(t) - sum(map(t.count, BLANKS)), len(SIGNS.findall(t)), dup, repeated_words(words)

    def run(batches):
        for batch in batches:
            rows = np.array([of(t) for t in batch[text]], np.int64).reshape(-1, len(names))
            yield {c: batch[c] for c in keep} | {n: pa.array(rows[:, i]) for i, n in enumerate(names)}

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return map_rows(docs, [*keep, text], run, f"{fields}, " + ", ".join(f"{n} long" for n in names))


#: The rules of the verdict: name and what fails. The first two are the base.
RULES = {
    "too_short": lambda: F.col("n_words") < 10,
    "repeats": lambda: 100 * F.col("n_repeat_words") > 20 * F.col("n_words"),
    "signs": lambda: 10 * F.col("n_symbols") > F.col("n_words"),
    "same_lines": lambda: 10 * F.col("n_dup_lines") > F.col("n_words"),
    "word_length": lambda: (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 15 * F.col("n_words")),
}


def host_rates(flagged: DataFrame, host: str, failed: str) -> DataFrame:
    """(host, docs, failures, rate, shrunk) with one row for each host, null among them.

    The prior is fitted by moments, over hosts weighed by documents: mean m, variance v of the rates,
    strength m (1 - m) / v - 1, between 1 and the documents of all hosts. shrunk is (failures +
    strength * m) / (docs + strength). One host alone gets its own rate.
    """
    hosts = cut(flagged.groupBy(F.col(host).alias("host")).agg(F.count(F.lit(1)).alias("docs"), F.count_if(failed).alias("failures")))
    rate = F.col("failures") / F.col("docs")
    n, m, second = hosts.agg(F.sum("docs"), F.sum("failures") / F.sum("docs"), F.sum(F.col("docs") * rate * rate) / F.sum("docs")).first()
    if not n:
        return hosts.withColumns({"rate": rate, "shrunk": rate})
    v = max(second - m * m, 0.0)
    strength = min(float(n), max(1.0, m * (1 - m) / v - 1)) if v > 0 else float(n)
    return hosts.withColumns({"rate": rate, "shrunk": (F.col("failures") + strength * m) / (F.col("docs") + strength)})


def judge(docs: DataFrame, host: str = "source", key: str = "doc_id", text: str = "text", limit: float = HOST_LIMIT) -> DataFrame:
    """(key, measures, base_failed, failed_rules, host, host_docs, host_failures, host_shrunk, kept).

    kept is false for documents that fail a base rule or whose host's shrunk rate of documents
    failing any rule is above ``limit``. A null text has no words and fails; a null host is a host
    of its own; repeated rows count and are judged each; an empty table gives an empty result.
    Counts by host are added up within tasks first, and verdicts come back by a broadcast of checked
    size or a join whose hot hosts adaptive execution splits.
    """
    rows = measures(docs.select(F.col(key), F.col(host).alias("host"), F.col(text).alias("t")), [key, "host"], "t")
    failing = F.filter(F.array(*[F.when(rule(), F.lit(name)) for name, rule in RULES.items()]), lambda x: x.isNotNull())
    rows = rows.withColumn("base_failed", RULES["too_short"]() | RULES["repeats"]()).withColumn("failed_rules", failing)
    rows = cut(rows)
    hosts = host_rates(rows.withColumn("any", F.size("failed_rules") > 0), "host", "any")
    hosts = hosts.select(F.col("host").alias("h"), F.col("docs").alias("host_docs"), F.col("failures").alias("host_failures"), F.col("shrunk").alias("host_shrunk"))
    out = rows.join(bounded(hosts), F.col("host").eqNullSafe(F.col("h"))).drop("h")
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("host_shrunk") <= limit))
