"""Language by cross-parsing: the language whose text explains a document in the fewest phrases.

For each language a suffix automaton is built from a bounded sample of labelled texts, whole ones. A
document is parsed greedily against each automaton: a phrase is the longest match from where the last
one ended. Phrases, weighed by the log of the sample's length, over the letters read estimate the
cross entropy, and the language with the least wins.

The automata are built once, on the driver, from the sample, and packed without empty arcs into arrays
of a few megabytes that all tasks share. Blocks of a text are parsed at once, each as if a phrase began
with it; then every block is parsed again from the state in which the one before has left off, up to
the first phrase that begins where one of the first parse does, since from there on both are the same.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_rows

#: Bound of the sample: rows of a language, by hash of the key, and characters that such a row's text
#: has at most. Texts are learnt whole.
ROWS, MOST_CHARS = 40, 4096
#: Places that are tried for a state before the search moves on.
SEARCH = 64
#: Letters of a block, and characters that are parsed at a time.
BLOCK = 256
SLICE_CHARS = 1_500_000


def training_text(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", seed: int = 7) -> dict[str, list[str]]:
    """The texts of at most ROWS rows for each language, those of least hash of the key among the rows
    of at most MOST_CHARS characters. A language that has only longer texts is learnt from the shortest.

    The threshold on the hash follows from each language's number of rows, so that few rows beyond
    the bound meet; the exact cut is a rank among those."""
    place = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 40))
    rows = labelled.filter(F.col(lang).isNotNull() & (F.length(text) > 0)).select(F.col(lang).alias("l"), F.col(text).alias("t"), place.alias("p"), F.col(key).alias("k"))
    short = F.length("t") <= MOST_CHARS
    sizes = rows.groupBy("l").agg(F.count_if(short).alias("n"), F.min(F.length("t")).alias("least")).collect()
    if not sizes:
        return {}
    of = lambda f: F.element_at(F.create_map(*[F.lit(x) for r in sizes for x in (r.l, f(r))]), F.col("l"))
    limit = of(lambda r: int(min(1.0, 4 * ROWS / max(1, r.n)) * (1 << 40)))
    shortest = of(lambda r: MOST_CHARS if r.n else r.least)
    few = rows.filter((F.length("t") <= shortest) & (F.col("p") < limit))
    order = Window.partitionBy("l").orderBy("p", "k", "t")
    held = of(lambda r: ROWS if r.n else 1)
    out: dict[str, list[str]] = {}
    for r in few.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= held).orderBy("l", "r").collect():
        out.setdefault(r.l, []).append(r.t)
    return out


class Alphabet:
    """Letters of the samples as numbers: 1 for all that is no letter, 0 for letters that no sample has."""

    def __init__(self, letters: list[str]):
        self.letters = letters
        self.table = np.zeros(0x110000, np.uint16)
        number = {c: i + 2 for i, c in enumerate(letters)}
        for p in range(0x110000):
            c = chr(p)
            if not c.isalpha():
                self.table[p] = 1
            elif (low := c.lower()) in number:
                self.table[p] = number[low]

    @property
    def size(self) -> int:
        return len(self.letters) + 2

    def read(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of all texts, how many of each): runs of what is no letter are read as one."""
        codes = self.table[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)]
        doc = np.repeat(np.arange(len(texts)), np.fromiter(map(len, texts), np.int64, len(texts)))
        keep = np.ones(len(codes), bool)
        keep[1:] = (codes[1:] != 1) | (codes[:-1] != 1) | (doc[1:] != doc[:-1])
        return codes[keep], np.bincount(doc[keep], minlength=len(texts))


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Arcs of the suffix automaton by state: state 0 is dead, 1 the root; from the root each substring
    of ``codes``, and nothing else, leads to a live state. Zeros in ``codes`` part texts."""
    link, length, arcs = [0, 0], [0, 0], [{}, {}]
    last = 1
    for c in codes:
        if c == 0:  # nothing runs over the border of texts
            last = 1
            continue
        if c in arcs[last]:  # another text has led here
            q = arcs[last][c]
            if length[q] == length[last] + 1:
                last = q
                continue
            clone = len(arcs)
            arcs.append(dict(arcs[q]))
            length.append(length[last] + 1)
            link.append(link[q])
            link[q] = clone
            p = last
            while p and arcs[p].get(c) == q:
                arcs[p][c] = clone
                p = link[p]
            last = clone
            continue
        new = len(arcs)
        arcs.append({})
        length.append(length[last] + 1)
        link.append(1)
        p = last
        while p and c not in arcs[p]:
            arcs[p][c] = new
            p = link[p]
        if p:
            q = arcs[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                clone = len(arcs)
                arcs.append(dict(arcs[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = link[new] = clone
                while p and arcs[p].get(c) == q:
                    arcs[p][c] = clone
                    p = link[p]
        last = new
    return arcs


def packed(arcs: list[dict[int, int]], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shift of each state, owner and target of each place): the arc of state s with letter c is at
    shift[s] + c if s owns that place, and there is none otherwise. States with several arcs are laid
    first, where their arcs fall between those of others, and the search moves on where that takes
    long; states with one arc then take the places that are left free."""
    shift = np.zeros(len(arcs), np.int32)
    room = 3 * size + 2 * sum(map(len, arcs))
    owner, target = [0] * room, [0] * room
    start = end = size
    for s in sorted((s for s in range(1, len(arcs)) if len(arcs[s]) > 1), key=lambda s: -len(arcs[s])):
        letters = sorted(arcs[s])
        first = letters[0]
        at = start
        while owner[at] or any(owner[at + c - first] for c in letters):
            at += 1
            if at + size >= len(owner):
                owner += [0] * len(owner)
                target += [0] * len(target)
        if at - start > SEARCH:
            start = at - SEARCH // 2
        shift[s] = at - first
        for c in letters:
            owner[at - first + c], target[at - first + c] = s, arcs[s][c]
        end = max(end, at - first + letters[-1] + 1)
    free = (p for p in range(size, len(owner)) if not owner[p])
    for s, out in enumerate(arcs):
        if len(out) == 1:
            ((c, to),) = out.items()
            at = next(free)
            shift[s] = at - c
            owner[at], target[at] = s, to
            end = max(end, at + 1)
    end += size
    return shift, np.array((owner + [0] * size)[:end], np.int32), np.array((target + [0] * size)[:end], np.int32)


class Languages:
    """The automata of all languages in one set of arrays; states and places of a language are counted
    on after those of the one before."""

    def __init__(self, samples: dict[str, list[str]]):
        self.names = sorted(samples)
        self.alphabet = Alphabet(sorted({x for ss in samples.values() for s in ss for c in s if c.isalpha() and len(x := c.lower()) == 1}))
        shifts, owners, targets, self.bits, states, places = [], [], [], [], 0, 0
        self.dead, self.root = [], []
        for name in self.names:
            codes, sizes = self.alphabet.read(samples[name])
            parts = np.split(codes, np.cumsum(sizes)[:-1])
            shift, owner, target = packed(suffix_automaton([c for p in parts for c in [*p.tolist(), 0]]), self.alphabet.size)
            shifts.append(shift + places)
            owners.append(np.where(owner > 0, owner + states, -1))
            targets.append(target + states)
            self.dead.append(states)
            self.root.append(states + 1)
            self.bits.append(math.log2(max(2, len(codes))))
            states += len(shift)
            places += len(owner)
        whole = lambda parts: np.concatenate(parts).astype(np.int32) if parts else np.zeros(1, np.int32)
        self.shift, self.owner, self.target = whole(shifts), whole(owners), whole(targets)

    def follow(self, state: np.ndarray, dead: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Where the arcs of letters ``c`` lead, or the dead states of the same languages."""
        at = self.shift[state] + c
        return np.where(self.owner[at] == state, self.target[at], dead)

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(phrases of each text against each language, letters of each text)."""
        codes, size = self.alphabet.read(texts)
        letters = np.bincount(np.repeat(np.arange(len(texts)), size)[codes != 1], minlength=len(texts))
        blocks = -(-size // BLOCK)
        doc = np.repeat(np.arange(len(texts)), blocks)
        inside = np.arange(len(doc)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        start = (np.cumsum(size) - size)[doc] + inside * BLOCK
        length = np.minimum(BLOCK, size[doc] - inside * BLOCK)
        order = np.argsort(-length, kind="stable")
        k, n_blocks = len(self.names), len(doc)
        dead, root = np.array(self.dead, np.int32)[:, None], np.array(self.root, np.int32)[:, None]
        # every block as if a phrase began with it
        state = np.repeat(dead, n_blocks, 1)  # in the order of lengths
        begins = np.zeros((k, len(codes)), bool)
        live = np.searchsorted(-length[order], -np.arange(BLOCK), "left")  # blocks longer than each step
        first = start[order]
        for step in range(int(length.max(initial=0))):
            n = live[step]
            at = first[:n] + step
            c = codes[at].astype(np.int32)
            new = self.follow(state[:, :n], dead, c)
            cold = new == dead
            begins[:, at] = cold
            state[:, :n] = np.where(cold, self.follow(root, dead, c), new)
        exits = np.empty_like(state)
        exits[:, order] = state
        met_exits = exits.copy()
        count = np.add.reduceat(begins, start, axis=1, dtype=np.int64) if n_blocks else np.zeros((k, 0), np.int64)
        own = count.copy()
        # again from where the block before has left off, until both parses begin a phrase
        lang, block = np.nonzero(np.broadcast_to(inside > 0, (k, n_blocks)))
        while len(lang):
            state = exits[lang, block - 1]
            gained = np.zeros(len(lang), np.int64)
            open_, unmet = np.arange(len(lang)), np.ones(len(lang), bool)
            for step in range(BLOCK):
                open_ = open_[step < length[block[open_]]]
                if not len(open_):
                    break
                la, at = lang[open_], start[block[open_]] + step
                c = codes[at].astype(np.int32)
                new = self.follow(state[open_], dead[la, 0], c)
                cold = new == dead[la, 0]
                state[open_] = np.where(cold, self.follow(root[la, 0], dead[la, 0], c), new)
                there = begins[la, at]
                gained[open_] += cold.astype(np.int64) - there
                unmet[open_[cold & there]] = False
                open_ = open_[~(cold & there)]
            count[lang, block] = own[lang, block] + gained
            # a block whose parses never meet leaves off in another state
            now = np.where(unmet, state, met_exits[lang, block])
            changed = exits[lang, block] != now
            exits[lang, block] = now
            lang, block = lang[changed], block[changed] + 1
            ok = (block < n_blocks) & (inside[np.minimum(block, n_blocks - 1)] > 0)
            lang, block = lang[ok], block[ok]
        total = np.zeros((len(texts), k), np.int64)
        np.add.at(total, doc, count.T)
        return total, letters


def identify(docs: DataFrame, labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(key, lang_pred, score) of every whole text, from the text alone.

    ``labelled`` has key, text and lang; its rows without a text or a language teach nothing. The
    language is ``und`` with score 0 where the text is null or has no letter, or nothing was learnt.
    Ties go to the smaller name. score is the winner's share of the languages' likelihoods, for the
    estimated cross entropy of 40 letters. Repeated rows are judged each, an empty table gives none.
    Phrases run through the whole text, however long; other columns, whatever their names, are ignored.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(Languages(training_text(labelled, text, lang, key)))

    def run(batches):
        known = shared.value
        bits = np.array(known.bits)
        for batch in batches:
            names, scores = [], []
            texts = [t or "" for t in batch[text]]
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end]) <= SLICE_CHARS):
                    size += len(texts[end])
                    end += 1
                total, letters = known.phrases(texts[at:end])
                at = end
                if not known.names:
                    names += ["und"] * len(total)
                    scores += [0.0] * len(total)
                    continue
                entropy = total * bits / np.maximum(letters, 1)[:, None]
                win = entropy.argmin(1)
                share = np.exp2(-np.minimum(letters, 40)[:, None] * (entropy - entropy.min(1, keepdims=True)))
                none = letters == 0
                names += ["und" if x else known.names[i] for x, i in zip(none, win, strict=True)]
                scores += np.where(none, 0.0, 1 / share.sum(1)).tolist()
            yield {key: batch[key], "lang_pred": names, "score": pa.array(scores, pa.float64())}

    return map_rows(docs, [key, text], run, f"`{key}` {docs.schema[key].dataType.simpleString()}, lang_pred string, score double")
