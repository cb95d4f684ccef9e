"""Toxicity by a noisy channel: hidden spellings are restored, then the restored words are scored.

A character model (trigrams of all documents, smoothed) says which letters are likely, words that
mark toxic documents are learnt from labelled rows, and a channel says how letters get hidden: other
signs for letters, letters set apart, letters repeated. A token becomes a lattice of what each of
its signs may stand for. Viterbi decoding finds the likeliest string under the character model and
the likeliest learnt words along the lattice under their frequencies; a learnt word is restored where
it is likelier than any other reading. Only restored text is scored: a document's evidence is the
weights of its different restored words, turned into a probability by a logistic fit.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, cut, map_rows

#: What a sign may stand for. Fixed values.
STANDS_FOR = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l",
}
#: Log probabilities of the channel: a sign for a letter, a sign that stays, a repeated letter that
#: is left out, or that is meant.
HIDDEN, STAYS, DROPPED, MEANT = math.log(0.3), math.log(0.02), math.log(0.5), math.log(0.05)
#: Of a letter that stands twice and is meant once.
DOUBLED = math.log(0.2)
#: And of a sign between letters that sets them apart, or that ends a word.
GAP, BORDER = math.log(0.8), math.log(0.2)
#: How much rarer signs hide other words than learnt ones.
RARELY = math.log(0.01)
SYMBOLS = 61
#: Characters whose trigrams are counted at a time.
COUNT_CHARS = 1_000_000
KEPT_TOKENS = 300_000
#: A word needs this much evidence, in different contexts, to count.
LEAST_CONTEXTS, LEAST_RATIO, LEAST_Z, LEAST_ODDS = 4, 0.5, 3.0, 2.0

INNER = r"[\s.\-_*~]"
SET_APART = frozenset(" .-_*~")
LETTER = r"[^\W_]|[@$!|+(€£]"
#: Three single letters or more, or signs for them, set apart; the character before them comes along.
SPACED = re.compile(rf"[\W_]((?:{LETTER})(?:{INNER}+(?:{LETTER})){{2,}})(?![^\W_])")
SEPARATORS = re.compile(rf"{INNER}+")
#: Letters beside signs, a letter three times in a row, or letters on both sides of a separator.
SUSPECT = re.compile(r"[^\W\d_][0-9@$!|+(€£]|[0-9@$!|+(€£][^\W\d_]|([^\W\d_])\1\1|[^\W\d_][.\-_*~]+[^\W\d_]")
REPEATS = re.compile(r"(.)\1+", re.S)
#: Punctuation around a word that stands for no letter.
PLAIN_EDGES = re.compile(r"[^\w@$!|+(€£]*([^\W\d_]+)[^\w@$!|+(€£]*")

def symbol_table() -> np.ndarray:
    """Code points to the symbols of the character model: 0 for all that is no letter, the lower-case
    letters a to z and those of Latin-1, and one for all other letters."""
    table = np.zeros(0x110000, np.uint8)
    for p in range(0x30000):
        c = chr(p)
        if c.isalpha():
            low = ord(c.lower()[0])
            table[p] = low - 96 if 97 <= low <= 122 else low - 0xDF + 27 if 0xDF <= low <= 0xFF else 60
    return table


class Tables:
    symbols: np.ndarray | None = None

    @classmethod
    def get(cls) -> np.ndarray:
        if cls.symbols is None:
            cls.symbols = symbol_table()
        return cls.symbols


def trigram_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(gram, n) over all whole texts; there are at most SYMBOLS**3 grams."""

    def count(batches):
        table, total = Tables.get(), np.zeros(SYMBOLS**3, np.int64)
        held, size = [], 0
        for batch in batches:
            for t in batch[text]:
                if t:
                    s = table[np.frombuffer(("  " + t + " ").encode("utf-32-le", "replace"), np.uint32)].astype(np.int32)
                    held.append((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:])
                    size += len(t)
                if size > COUNT_CHARS:
                    total += np.bincount(np.concatenate(held), minlength=len(total))
                    held, size = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=len(total))
        at = np.flatnonzero(total)
        yield {"gram": pa.array(at), "n": pa.array(total[at])}

    return map_rows(docs, [text], count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def character_model(counts: DataFrame) -> np.ndarray:
    """Log probability of a symbol after two others, from (gram, n); shorter contexts smooth longer ones."""
    n = np.zeros(SYMBOLS**3)
    for r in counts.collect():
        n[r.gram] = r.n
    n = n.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    one = (n.sum((0, 1)) + 1) / (n.sum() + SYMBOLS)
    two = (n.sum(0) + 5 * one) / (n.sum(0).sum(-1, keepdims=True) + 5)
    return np.log((n + 5 * two) / (n.sum(-1, keepdims=True) + 5)).astype(np.float32)


def runs_of(token: str) -> list[tuple[str, int]]:
    """Characters of a token, each with how often it stands in a row."""
    runs: list[list] = []
    for c in token:
        if runs and runs[-1][0] == c:
            runs[-1][1] += 1
        else:
            runs.append([c, 1])
    return [(c, n) for c, n in runs]


def options(c: str, times: int, edge: bool) -> list[tuple[str, float]]:
    """What a run may stand for, with log probabilities: the letters that a sign hides or itself, and of
    repeats one, two or all. A separator goes, or is a blank that ends a word; other signs at the
    ``edge`` of a token may be just punctuation and go."""
    if c in SET_APART:
        return [(" ", 0.0)] if edge else [("", GAP), (" ", BORDER)]
    ways = [(x, HIDDEN) for x in STANDS_FOR.get(c, "")]
    out = [(" ", 0.0)] if edge and not c.isalnum() else []
    if not out:
        ways.append((c, 0.0 if c.isalpha() else STAYS))
    for x, p in ways:
        if times == 1:
            out.append((x, p))
        elif times == 2:
            out += [(x * 2, 2 * p), (x, p + DOUBLED)]
        else:
            out += [(x, p + DROPPED), (x * 2, 2 * p + DROPPED), (x * times, times * p + MEANT)]
    return out


class Decoder:
    """Viterbi decoding of one token at a time. States of the lattice are the last two symbols."""

    def __init__(self, model: np.ndarray):
        self.model, self.table, self.known = model.ravel().tolist(), Tables.get(), {}

    def symbol(self, c: str) -> int:
        found = self.known.get(c)
        if found is None:
            found = self.known[c] = int(self.table[ord(c)])
        return found

    def best(self, runs: list[tuple[str, int]], edges: bool = True) -> tuple[float, str]:
        """(log probability, text) of the likeliest reading of the runs of a token; with ``edges``, signs
        at its edges are punctuation."""
        model, symbol = self.model, self.symbol
        inner = [i for i, (c, _) in enumerate(runs) if c.isalnum() or not edges] or [0]
        # of each state the best score and, as a chain of pieces back to the start, its reading
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for i, (c, times) in enumerate(runs):
            spelled = [(piece, [symbol(x) for x in piece], p) for piece, p in options(c, times, not inner[0] <= i <= inner[-1])]
            new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (score, chain) in states.items():
                for piece, symbols, p in spelled:
                    u, v, s = a, b, score + p
                    for w in symbols:
                        s += model[(u * SYMBOLS + v) * SYMBOLS + w]
                        u, v = v, w
                    if (u, v) not in new or new[u, v][0] < s:
                        new[u, v] = (s, (chain, piece))
            states = new
        (a, b), (score, chain) = max(states.items(), key=lambda x: x[1][0] + model[(x[0][0] * SYMBOLS + x[0][1]) * SYMBOLS])
        pieces = []
        while chain:
            chain, piece = chain
            pieces.append(piece)
        return score + model[(a * SYMBOLS + b) * SYMBOLS], "".join(reversed(pieces))

    def restore(self, token: str) -> str:
        """The likeliest words behind a token of signs, letters and repeats."""
        return self.best(runs_of(token))[1].strip()


class Lexicon:
    """Learnt words with their log probabilities, as a tree of letters, and their weights."""

    def __init__(self, words: dict[str, tuple[float, float]]):
        self.weights = {w: weight for w, (weight, _) in words.items()}
        self.once = {once(w) for w in words}
        self.next: list[dict[str, int]] = [{}]
        self.end: list[tuple[str, float] | None] = [None]
        for word, (_, prior) in sorted(words.items()):
            at = 0
            for c in word:
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.end.append(None)
                at = self.next[at][c]
            self.end[at] = (word, prior)

    def along(self, runs: list[tuple[str, int]]) -> dict[tuple[str, int, int], float]:
        """The best log probability of each learnt word at each stretch of runs that it can be read from.
        A word begins at the start or behind a sign and ends at the end or before a sign."""
        found: dict[tuple[str, int, int], float] = {}
        active: dict[tuple[int, int], float] = {}
        for i, (c, times) in enumerate([*runs, (" ", 1)]):
            sign = not c.isalnum()
            if sign:
                for (node, start), score in active.items():
                    if self.end[node]:
                        word, prior = self.end[node]
                        at = (word, start, i)
                        if score + prior > found.get(at, -math.inf):
                            found[at] = score + prior
            if i == len(runs):
                break
            if i == 0 or not runs[i - 1][0].isalnum():
                active[0, i] = 0.0
            new: dict[tuple[int, int], float] = {}
            if active:
                ways = [x for x in options(c, times, False) if x[0] != " "]
                for (node, start), score in active.items():
                    if c in SET_APART and start == i:
                        continue  # no word begins with a separator
                    for piece, p in ways:
                        at: int | None = node
                        for x in piece:
                            at = self.next[at].get(x)
                            if at is None:
                                break
                        else:
                            if score + p > new.get((at, start), -math.inf):
                                new[at, start] = score + p
            active = new
        return found

    def spelled(self, token: str, decoder: Decoder) -> list[str]:
        """The learnt words that a token is restored to: those that are what the character model reads
        from their signs, too, or likelier than that."""
        runs, out = runs_of(token), set()
        for (word, start, end), score in self.along(runs).items():
            if word not in out:
                other, read = decoder.best(runs[start:end], False)
                signs = any(not c.isalpha() for c, _ in runs[start:end])
                if score >= other + (RARELY if signs else 0.0) or read == word:
                    out.add(word)
        return sorted(out)


def once(word: str) -> str:
    """A word without repeats of a letter."""
    return REPEATS.sub(r"\1", word)


def bare(token: str) -> str:
    """A token without the punctuation around it."""
    start, end = 0, len(token)
    while end and not token[end - 1].isalnum():
        end -= 1
    while start < end and not token[start].isalnum():
        start += 1
    return token[start:end]


def set_apart(text: str) -> set[str]:
    """Runs of single letters set apart, with one blank between them."""
    return {" ".join(SEPARATORS.split(m)) for m in SPACED.findall(f" {text}")}


def tokens_of(text: str | None) -> set[str]:
    low = text.lower() if text else ""
    found = set(low.split())
    return found.union(set_apart(low)) if found else found


class Restorer:
    """Words of tokens; keeps a bounded number of tokens with their words. Before there is a lexicon, as
    when one is learnt, suspect tokens are what the character model says; with one, only the learnt
    words behind a token matter."""

    def __init__(self, model: np.ndarray, lexicon: Lexicon | None = None):
        self.decoder, self.lexicon = Decoder(model), lexicon
        self.known: dict[str, tuple[str, ...]] = {}

    def words(self, token: str) -> tuple[str, ...]:
        found = self.known.get(token)
        if found is None:
            if len(self.known) > KEPT_TOKENS:
                self.known.clear()
            found = self.known[token] = self._words(token)
        return found

    def _words(self, token: str) -> tuple[str, ...]:
        if self.lexicon is not None:
            plain = PLAIN_EDGES.fullmatch(token)
            word = plain[1] if plain else bare(token)
            if word in self.lexicon.weights and plain:
                return (word,)
            # letters alone are a learnt word only if they are so without repeats
            if plain and once(word) not in self.lexicon.once:
                return ()
            also = (word,) if word in self.lexicon.weights else ()
            return tuple(dict.fromkeys((*also, *self.lexicon.spelled(token, self.decoder))))
        word = bare(token)
        if " " in token or (not word.isalpha() or len(word) > 2) and SUSPECT.search(token):
            return tuple(w for w in dict.fromkeys(map(bare, self.decoder.restore(token).split())) if w)
        return (word,) if word else ()

    def evidence(self, text: str | None) -> float:
        """The weights of the different restored words, added up by their cubes: one strong mark says
        more than a few weak ones."""
        best = {w for t in tokens_of(text) for w in self.words(t)}
        return sum(self.lexicon.weights[w] ** 3 for w in best) ** (1 / 3)


def learn(docs: DataFrame, model: np.ndarray, text: str = "text", label: str = "label") -> tuple[dict[str, tuple[float, float]], float]:
    """({word: (weight, log probability)}, log odds of label 1) from rows with a text and a label 0 or 1.

    Words are counted by document; those that favour label 1 are counted again by context, so that
    copies of a document count once. Two passes over the labelled rows; what comes back are the words
    that clearly favour label 1. Without rows of both labels nothing is learnt.
    """

    def by_document(batches):
        restorer = Restorer(model)
        n: dict[str, list[int]] = {}
        rows, seen = [0, 0], 0

        def flush():
            out = {"word": [*n], "neg": [v[0] for v in n.values()], "pos": [v[1] for v in n.values()]}
            n.clear()
            return out

        for batch in batches:
            for t, y in zip(batch[text], batch[label], strict=True):
                rows[y] += 1
                found = {w for x in tokens_of(t) for w in restorer.words(x)}
                seen += len(found)
                for w in found:
                    if w in n:
                        n[w][y] += 1
                    else:
                        n[w] = [1 - y, y]
                if len(n) > KEPT_TOKENS:
                    yield flush()
        yield flush()
        # no word is empty or a blank: these rows carry the totals
        yield {"word": ["", " "], "neg": [rows[0], seen], "pos": [rows[1], 0]}

    counts = cut(map_rows(docs, [text, label], by_document, "word string, neg long, pos long").groupBy("word").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos")))
    totals = {r.word: r for r in counts.filter("word in ('', ' ')").collect()}
    rows = totals.get("")
    if rows is None or not rows.pos or not rows.neg:
        return {}, math.log(((rows.pos if rows else 0) + 0.5) / ((rows.neg if rows else 0) + 0.5))
    prior = math.log(rows.pos / rows.neg)

    def odds(pos, neg):
        return F.log((pos + 0.5) / (rows.pos + 1)) - F.log((neg + 0.5) / (rows.neg + 1))

    clear = odds(F.col("pos"), F.col("neg"))
    strong = counts.filter(~F.col("word").isin("", " ") & (F.col("pos") >= LEAST_CONTEXTS)).filter((clear > LEAST_ODDS) & (clear / F.sqrt(1 / (F.col("pos") + 0.5) + 1 / (F.col("neg") + 0.5)) > LEAST_Z))
    first = {r.word: (r.pos, r.neg) for r in strong.collect()}
    keep = docs.sparkSession.sparkContext.broadcast((model, frozenset(first)))

    def by_context(batches):
        model, wanted = keep.value
        restorer = Restorer(model)
        known: dict[str, tuple[str, ...]] = {}
        seen: set[tuple[str, int, int]] = set()

        def own(token: str) -> tuple[str, ...]:
            found = known.get(token)
            if found is None:
                if len(known) > KEPT_TOKENS:
                    known.clear()
                found = known[token] = tuple(w for w in restorer.words(token) if w in wanted)
            return found

        def flush():
            out = {"word": [x[0] for x in seen], "y": [x[1] for x in seen], "around": [x[2] for x in seen]}
            seen.clear()
            return out

        for batch in batches:
            for t, y in zip(batch[text], batch[label], strict=True):
                low = t.lower() if t else ""
                found = low.split()
                if any(map(own, set(found))):
                    for i, x in enumerate(found):
                        for w in own(x):
                            seen.add((w, y, xxhash.xxh3_64_intdigest(" ".join(found[max(0, i - 2) : i]) + "|" + " ".join(found[i + 1 : i + 3])) >> 24))
                for x in set_apart(low) if found else ():
                    for w in own(x):
                        seen.add((w, y, xxhash.xxh3_64_intdigest(t) >> 24))
            if len(seen) > 200_000:
                yield flush()
        yield flush()

    around = map_rows(docs, [text, label], by_context, "word string, y int, around long").distinct()
    around = around.groupBy("word").agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg"))
    words = {}
    for r in around.collect():
        pos, neg = min(r.pos, first[r.word][0]), max(r.neg, first[r.word][1])
        w = math.log((pos + 0.5) / (rows.pos + 1)) - math.log((neg + 0.5) / (rows.neg + 1))
        if pos >= LEAST_CONTEXTS and pos >= LEAST_RATIO * first[r.word][0] and w > LEAST_ODDS and w / math.sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5)) > LEAST_Z:
            words[r.word] = (w, math.log(sum(first[r.word]) / max(1, totals[" "].neg)))
    return words, prior


def logistic(rows: list[tuple[float, int, int]]) -> tuple[float, float]:
    """(slope, intercept) for (x, label, count) rows, with a weak pull to slope 1."""
    x, y, n = (np.array(v, float) for v in zip(*rows, strict=True))
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(w[0] * x + w[1], -30, 30)))
        g = np.array([(n * (p - y) * x).sum() + (w[0] - 1), (n * (p - y)).sum() + 0.01 * w[1]])
        q = n * p * (1 - p)
        h = np.array([[(q * x * x).sum() + 1, (q * x).sum()], [(q * x).sum(), q.sum() + 0.01]])
        step = np.linalg.solve(h, g)
        w = w - np.clip(step, -2, 2)
        w[0] = max(w[0], 0.05)
    return float(w[0]), float(w[1])


def score(docs: DataFrame, labels: DataFrame, where: Column | None = None, key: str = "doc_id", text: str = "text", label: str = "toxic", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, score) of every row, with the columns ``keep`` between them: the probability of label 1, from the text alone.

    ``labels`` has ``key`` and ``label``; what is learnt comes from the rows of ``docs`` that pass ``where``
    (all, if None) and whose key has a label of 0 or 1. Other labels, null keys and keys without a
    document teach nothing; a key with both labels teaches both; rows of one key teach each. The
    character model is counted over all of ``docs``. Null and empty texts get the score of a text
    without evidence, as every text does if nothing was learnt; repeated rows are scored each; an empty
    table gives an empty result. Whole texts are read, of any length, in time that grows with them.
    Other columns of both tables, whatever their names, are ignored.
    """
    spark = docs.sparkSession
    model = character_model(trigram_counts(docs, text))
    named = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).distinct()
    named = bounded(named)
    own = docs if where is None else docs.filter(where)
    words, prior = learn(own.select(F.col(key).alias("id"), F.col(text).alias("t")).join(named, F.col("id") == F.col("k")), model, "t", "y")
    shared = spark.sparkContext.broadcast((model, words))

    def run(batches):
        model, words = shared.value
        restorer = Restorer(model, Lexicon(words))
        for batch in batches:
            yield {c: batch[c] for c in kept} | {"x": pa.array([restorer.evidence(t) for t in batch["t"]], pa.float64())}

    learnt = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    more = [F.col(f"`{c}`").alias(f"keep{i}") for i, c in enumerate(keep)]
    rows = docs.select(F.col(key).alias("id"), learnt.alias("learnt"), *more, F.col(text).alias("t"))
    kept = rows.columns[:-1]
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept)
    found = cut(map_rows(rows, [*kept, "t"], run, f"{kinds}, x double"))
    table = found.filter("learnt").join(named, F.col("id") == F.col("k")).groupBy(F.round(4 * F.least("x", F.lit(64.0))).cast("int").alias("at"), "y").agg(F.count(F.lit(1)).alias("n")).collect()
    slope, base = logistic([(r["at"] / 4, r.y, r.n) for r in table]) if words else (1.0, prior)
    return found.select(F.col("id").alias(key), *[F.col(f"keep{i}").alias(c) for i, c in enumerate(keep)], (1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), slope * F.col("x") + base))))).alias("score"))
