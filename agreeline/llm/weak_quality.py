"""A quality classifier without labels: heuristic labellers, their accuracies, and a linear scorer.

Labellers vote high, low or not at all on each document. Documents are good, or bad in one of several
ways, one for each labeller: defects seldom come together, so a single bad kind, whose votes were
independent, would not fit them. Expectation-maximisation over the counts of vote patterns estimates
how often each labeller votes what on documents of each kind, and with it the probability that a
document is good. Where votes alone can't tell a rare defect from a labeller's false alarm, the belief
that EM starts from decides, the same for all labellers: most low votes are right. These posteriors train a linear scorer on hashed words and word shapes, which reads
what no labeller looks at.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows
from .quality_rules import SIGNS, repeated_words

#: Documents, by hash of the text, that the scorer is fitted to, at most about so many.
SAMPLE_DOCS = 8000
BUCKETS = 1 << 17
KEPT_TOKENS = 300_000
#: How likely a document without a low vote is held to be good, and one with a low vote bad, at first.
TRUST = 0.8
#: What that belief weighs against the votes once it is no more than a prior: just enough to decide where
#: votes can't. Chosen on made-up labellers, whose accuracies it lets EM find again; see the tests.
PRIOR = 0.05
END = re.compile(r"[.!?](?=\s|$)")


def signs(words, text):
    share = len(SIGNS.findall(text)) / len(words)
    return 0 if share > 0.1 else 1 if share < 0.02 else 2


def repeats(words, text):
    return 0 if 5 * repeated_words(words) > len(words) else 2


def same_lines(words, text):
    lines = [x for x in text.split("\n") if x.strip()]
    return 0 if len(lines) >= 3 and 2 * len(set(lines)) < len(lines) else 2


def length(words, text):
    return 0 if len(words) < 10 else 1 if len(words) > 40 else 2


def variety(words, text):
    if len(words) < 20:
        return 2
    share = len(set(words)) / len(words) ** 0.8
    return 0 if share < 0.5 else 1 if share > 1.0 else 2


def loudness(words, text):
    share = (text.count("!!") + text.count("??")) / len(words)
    return 0 if share > 0.2 else 1 if share < 0.02 else 2


def sentences(words, text):
    share = len(END.findall(text)) / len(words)
    return 0 if share < 0.004 and len(words) > 60 else 1 if 0.02 < share < 0.3 else 2


#: The labellers: 0 low, 1 high, 2 no vote. They overlap, and each may be wrong.
LABELLERS = (signs, repeats, same_lines, length, variety, loudness, sentences)


def votes(text: str | None) -> int:
    """The pattern of all votes as one number in base 3; a text without words gets low from ``length``."""
    words = text.split() if text else []
    if not words:
        return sum((0 if f is length else 2) * 3**i for i, f in enumerate(LABELLERS))
    return sum(f(words, text) * 3**i for i, f in enumerate(LABELLERS))


def digits(patterns: np.ndarray) -> np.ndarray:
    return patterns[:, None] // 3 ** np.arange(len(LABELLERS)) % 3


def belief(patterns: np.ndarray) -> np.ndarray:
    """Probabilities of the kinds, good first, that each pattern is held to have before any count: good
    without a low vote, and bad in the way of those who vote low, with TRUST for either."""
    low = digits(patterns) == 0
    fine, m = ~low.any(1)[:, None], low.shape[1]
    bad = np.where(fine, (1 - TRUST) / m, TRUST * np.where(low, 1 / np.maximum(1, low.sum(1))[:, None], 1e-3))
    return np.concatenate([np.where(fine, TRUST, 1 - TRUST), bad], 1)


def estimate(patterns: np.ndarray, n: np.ndarray, rounds: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """(share of each kind, table [kind, labeller, vote] of probabilities) by EM from the counts of vote
    patterns. It starts from the belief, which stays as a weak prior of each pattern's kinds."""
    v = digits(patterns)
    votes_are = np.stack([v == x for x in range(3)], -1).astype(float)
    post = belief(patterns)
    post /= post.sum(1, keepdims=True)
    shares, table = np.zeros(post.shape[1]), np.zeros((post.shape[1], v.shape[1], 3))
    for _ in range(rounds):
        held = post * n[:, None]
        shares = (held.sum(0) + 1) / (n.sum() + post.shape[1])
        table = np.einsum("pk,pjx->kjx", held, votes_are) + 1.0
        table /= table.sum(-1, keepdims=True)
        new = kind_posteriors(patterns, shares, table)
        if np.abs(new - post).max(initial=0) < 1e-7:
            break
        post = new
    return shares, table


def kind_posteriors(patterns: np.ndarray, shares: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Probabilities of the kinds, for each pattern."""
    v = digits(patterns)
    logs = np.log(shares) + np.log(table)[:, np.arange(v.shape[1]), v].sum(-1).T + PRIOR * np.log(belief(patterns))
    out = np.exp(logs - logs.max(1, keepdims=True))
    return out / out.sum(1, keepdims=True)


def posterior(patterns: np.ndarray, shares: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The probability that a document of each pattern is good."""
    return kind_posteriors(patterns, shares, table)[:, 0]


#: Letters and digits to their kind, for shapes of words.
SHAPE = str.maketrans({c: ("A" if c.isupper() else "a" if c.isalpha() else "9") for c in map(chr, range(0x250)) if c.isalnum()})


def token_features(token: str) -> tuple[int, ...]:
    """Hashed features of a token: the word, its end, and the kinds of characters in it."""
    shape = "".join(dict.fromkeys(token.translate(SHAPE)))
    return tuple(xxhash.xxh3_64_intdigest(k + x) % BUCKETS for k, x in (("w", token.lower()), ("e", token[-3:]), ("s", shape)))


class TokenWeights(dict):
    """Tokens to the sum of their features' weights; a bounded number is kept."""

    def __init__(self, weights: np.ndarray):
        super().__init__()
        self.weights = weights

    def __missing__(self, token: str) -> float:
        if len(self) > KEPT_TOKENS:
            self.clear()
        w = self.weights
        self[token] = found = float(sum(w[f] for f in token_features(token)))
        return found


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(features, shares of the tokens that have them) of a text."""
    tokens = text.split() if text else []
    at, n = np.unique(np.array([f for t in tokens for f in token_features(t)], np.int64), return_counts=True)
    return at, n / max(1, len(tokens))


def train(rows: list[tuple[np.ndarray, np.ndarray, float]], epochs: int = 30, seed: int = 1) -> tuple[np.ndarray, float]:
    """(weights, intercept) of logistic regression on soft labels, by AdaGrad over small batches."""
    w, b, g, gb = np.zeros(BUCKETS), 0.0, np.full(BUCKETS, 1e-8), 1e-8
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // 64)):
            if not len(part):
                continue
            at = np.concatenate([rows[i][0] for i in part])
            x = np.concatenate([rows[i][1] for i in part])
            doc = np.repeat(np.arange(len(part)), [len(rows[i][0]) for i in part])
            y = np.array([rows[i][2] for i in part])
            miss = 1 / (1 + np.exp(-np.clip(np.bincount(doc, x * w[at], len(part)) + b, -30, 30))) - y
            used, back = np.unique(at, return_inverse=True)
            step = np.bincount(back, x * miss[doc], len(used)) / len(part) + 1e-6 * w[used]
            g[used] += step**2
            w[used] -= 0.5 * step / np.sqrt(g[used])
            gb += miss.mean() ** 2
            b -= 0.5 * miss.mean() / np.sqrt(gb)
    return w, b


def label_model(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, np.ndarray, int]:
    """(shares of kinds, table of votes, number of documents) from the vote patterns of all
    documents; their number is bounded by the labellers."""

    def vote(batches):
        for batch in batches:
            yield {"pattern": [votes(t) for t in batch[text]]}

    counts = map_rows(docs, [text], vote, "pattern int").groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).collect()
    n = np.array([float(r.n) for r in counts])
    return *estimate(np.array([r.pattern for r in counts], np.int64), n), int(n.sum())


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE_DOCS) -> DataFrame:
    """(key, score) of every row: the scorer's probability that the document is good.

    Vote patterns are counted over all documents; their number is bounded by the labellers. The
    scorer is fitted to at most about ``sample`` documents, chosen by hash of the text, so copies
    come together or not at all. Null and empty texts have no words: the labellers call them low,
    and the scorer gives its intercept. Repeated rows are scored each; an empty table gives none. Whole
    texts are read, however long; other columns, whatever their names, are ignored.
    """
    spark = docs.sparkSession

    kind = docs.schema[key].dataType.simpleString()
    shares, table, texts = label_model(docs, text)
    limit = int(min(1.0, sample / max(1, texts)) * (1 << 40))
    known = spark.sparkContext.broadcast((shares, table))

    def pick(batches):
        seen = set()
        for batch in batches:
            for t in batch[text]:
                h = xxhash.xxh3_64_intdigest(t or "") >> 24
                if h < limit and h not in seen:
                    seen.add(h)
                    at, x = features(t)
                    p = float(posterior(np.array([votes(t)]), *known.value)[0])
                    yield {"draw": [h], "f": [at.astype(np.int32).tobytes()], "x": [x.astype(np.float32).tobytes()], "p": [p]}

    few = map_rows(docs, [text], pick, "draw long, f binary, x binary, p double").dropDuplicates(["draw"]).orderBy("draw").collect()
    weights, base = train([(np.frombuffer(r.f, np.int32).astype(np.int64), np.frombuffer(r.x, np.float32).astype(float), r.p) for r in few])
    model = spark.sparkContext.broadcast((weights.astype(np.float32), base))

    def run(batches):
        weights, base = model.value
        known = TokenWeights(weights)
        for batch in batches:
            found = [t.split() if t else [] for t in batch[text]]
            z = np.array([sum(map(known.__getitem__, x)) / max(1, len(x)) for x in found], float) + base
            yield {key: batch[key], "score": pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))}

    return map_rows(docs, [key, text], run, f"`{key}` {kind}, score double")
