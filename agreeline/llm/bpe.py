"""Byte-pair encoding by a lexicon of frequent words, with exact merges for the rest, and decoding.

The frequent words of the whole corpus are compiled into a minimal acyclic transducer: words share
their beginnings and their ends, and the numbers on the arcs of a word's path add up to its place
in a table of token ids. The automaton is written once to the shared folder, fetched once by each
executor and memory-mapped by its workers; words that it lacks are merged pair by pair, by rank, as the vocabulary file says.
"""

from __future__ import annotations

import gc
import heapq
import json
import os
from collections import Counter
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_rows, share_file

#: How a text falls into pieces before the merges, as the vocabulary file's pre-tokenizer has it.
PIECES = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
#: Runs of white space that a cut before each blank would break in the wrong place.
INSIDE_RUN = regex.compile(r"\s \s|\s \Z")
#: Words of the lexicon, at most. They are the most frequent ones of all documents.
LEXICON_WORDS = 100_000
#: Longest word of the lexicon in bytes; longer ones are merged.
LEXICON_BYTES = 64
#: Words that a worker keeps with their ids, and words that a counting task keeps, at most.
KEPT_WORDS = 300_000
#: Characters that are encoded and decoded at a time; the arrays of a step take about 30 bytes for each.
SLICE_CHARS = 500_000


def byte_chars() -> dict[int, str]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Vocabulary:
    """Ids, merges and special tokens of a byte-level vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        chars = byte_chars()
        back = {c: b for b, c in chars.items()}
        ids = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes: list[bytes] = [b""] * (max([*ids.values(), *self.special.values()]) + 1)
        for token, i in ids.items():
            self.bytes[i] = bytes(back[c] for c in token)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.single = [ids[chars[b]] for b in range(256)]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[ids[a], ids[b]] = (rank, ids[a + b])
        self.radix = len(self.bytes)
        keys = np.fromiter((a * self.radix + b for a, b in self.merges), np.int64, len(self.merges))
        order = np.argsort(keys)
        self.pair_keys = keys[order]
        self.rank_ids = np.fromiter((new for _, new in self.merges.values()), np.int64, len(self.merges))
        self.pair_ranks = np.fromiter((r for r, _ in self.merges.values()), np.int32, len(self.merges))[order]
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece: the pair of least rank, the leftmost first, is merged until none is left."""
        ids = [self.single[b] for b in piece]
        if len(ids) > 48:
            return self._merge_long(ids)
        merges = self.merges
        while len(ids) > 1:
            best = min(((r, i) for i, pair in enumerate(zip(ids, ids[1:], strict=False)) if (r := merges.get(pair))), default=None)
            if best is None:
                break
            (_, new), i = best
            ids[i : i + 2] = [new]
        return ids

    def merge_all(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """``merge`` of many pieces: the number of ids of each, and the ids of all; short pieces of like length are
        merged together, a pair each a step."""
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        places, lengths, ids = [], [], []
        for low, high in ((0, 8), (8, 12), (12, 16), (16, 24), (24, 40)):
            at = np.flatnonzero((size > low) & (size <= high))
            for part in np.array_split(at, -(-len(at) // 20_000)) if len(at) else ():
                left, found = self._merge_rows([pieces[i] for i in part.tolist()], size[part], high)
                places.append(part)
                lengths.append(left)
                ids.append(found)
        for i in np.flatnonzero(size > 40).tolist():
            ids.append(np.array(self.merge(pieces[i]), np.int64))
            places.append([i])
            lengths.append([len(ids[-1])])
        if not ids:
            return np.zeros(len(pieces), np.int64), np.zeros(0, np.int64)
        order, n = np.concatenate(places), np.zeros(len(pieces), np.int64)
        n[order] = found = np.concatenate(lengths)
        start = np.zeros(len(pieces), np.int64)
        start[order] = np.cumsum(found) - found
        return n, np.concatenate(ids)[spans(start, n)]

    def _merge_rows(self, pieces: list[bytes], size: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        n, none = len(pieces), np.iinfo(np.int32).max
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        ids = np.array(self.single, np.int64)[raw]
        ids[np.arange(width) >= size[:, None]] = -1

        def look(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            key = a * self.radix + b
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            return np.where((self.pair_keys[at] == key) & (a >= 0) & (b >= 0), self.pair_ranks[at], none)

        rank = np.full((n, width), none, np.int32)
        rank[:, :-1] = look(ids[:, :-1], ids[:, 1:])
        places, live = np.arange(width), np.arange(n)
        while len(live):
            best = rank[live].argmin(1)
            least = rank[live, best]
            live, best, least = live[ok := least < none], best[ok], least[ok]
            take = np.minimum(places + (places > best[:, None]), width - 1)
            row = np.take_along_axis(ids[live], take, 1)
            row[:, -1] = -1
            ranks = np.take_along_axis(rank[live], take, 1)
            ranks[:, -1] = none
            every = np.arange(len(live))
            row[every, best] = self.rank_ids[least]
            before, after = np.maximum(best - 1, 0), np.minimum(best + 1, width - 1)
            ranks[every, best] = np.where(after > best, look(row[every, best], row[every, after]), none)
            ranks[every, before] = np.where(best > 0, look(row[every, before], row[every, best]), ranks[every, before])
            ids[live], rank[live] = row, ranks
        there = ids >= 0  # the first ones of a row
        return there.sum(1), ids[there]

    def _merge_long(self, ids: list[int]) -> list[int]:
        merges, n = self.merges, len(ids)
        left, right, alive = list(range(-1, n - 1)), [*range(1, n), -1], [True] * n
        heap = [(r[0], i, ids[i], ids[i + 1], r[1]) for i in range(n - 1) if (r := merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = right[i] if alive[i] else -1
            if j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], right[i] = new, False, right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y >= 0 and (r := merges.get((ids[x], ids[y]))):
                    heapq.heappush(heap, (r[0], x, ids[x], ids[y], r[1]))
        return [t for t, ok in zip(ids, alive, strict=True) if ok]

    def pieces(self, word: str) -> list[str]:
        """What the merges never join, of a part that ``words`` gave."""
        if word[:1] == "\0":
            word = word[1:]
            return [word] if word in self.special else PIECES.findall(word)
        if word.isalpha():
            return [" " + word]
        if word[:-1].isalpha() and word[-1] in ".,":
            return [" " + word[:-1], word[-1]]
        return PIECES.findall(" " + word)

    def ids(self, piece: str) -> list[int]:
        return [self.special[piece]] if piece in self.special else self.merge(piece.encode())


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def words(text: str, vocab: Vocabulary) -> list[str]:
    """The text in parts that are encoded apart from each other: what stands after each blank, with
    that blank left out, and marked by a leading zero character what has no blank before it: the
    beginning, special tokens, and, where a run of white space would be cut wrongly or zeros occur
    in the text, all pieces. ``Vocabulary.pieces`` gives the real pieces of a part."""
    if "\0" not in text and not any(s in text for s in vocab.special) and not INSIDE_RUN.search(text):
        out = text.split(" ")
        if out[0]:
            out[0] = "\0" + out[0]
            return out
        return out[1:]
    out = []
    for part in vocab.split.split(text) if vocab.split else [text]:
        out.extend(["\0" + part] if part in vocab.special else ["\0" + p for p in PIECES.findall(part)])
    return out


class Lexicon:
    """A minimal acyclic transducer from words to rows of token ids, held in flat arrays."""

    NAMES = ("first", "keys", "target", "skip", "final", "offset", "ids")

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.a, self.keys = arrays, arrays["keys"]

    @classmethod
    def build(cls, entries: dict[bytes, list[int]]) -> Lexicon:
        """States are added in the order of the sorted words; a state whose arcs and finality equal
        those of an earlier one is replaced by it as soon as no later word can change it."""
        register: dict[tuple, int] = {}
        arcs: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
        path: list[list] = [[False, {}]]  # unfinished states along the last word

        def freeze(state: list) -> int:
            key = (state[0], tuple(sorted(state[1].items())))
            if key not in register:
                register[key] = len(arcs)
                arcs.append(key)
            return register[key]

        def close(depth: int, word: bytes) -> None:
            while len(path) > depth + 1:
                done = freeze(path.pop())
                path[-1][1][word[len(path) - 1]] = done

        order, last = sorted(entries), b""
        for word in order:
            common = len(os.path.commonprefix([word, last]))
            close(common, last)
            path.extend([False, {}] for _ in word[common:])
            path[-1][0] = True
            last = word
        close(0, last)
        root = freeze(path[0])
        count = [0] * len(arcs)  # words below each state; arcs lead to smaller numbers
        for s, (final, out) in enumerate(arcs):
            count[s] = final + sum(count[t] for _, t in out)
        number = [len(arcs) - 1 - s for s in range(len(arcs))]
        assert number[root] == 0
        first, label, target, skip, finals = [0], [], [], [], []
        for final, out in reversed(arcs):
            below = int(final)
            for byte, t in out:
                label.append(byte)
                target.append(number[t])
                skip.append(below)
                below += count[t]
            first.append(len(label))
            finals.append(final)
        ids = [entries[w] for w in order]
        return cls({
            "first": np.array(first, np.int64), "keys": np.repeat(np.arange(len(first) - 1), np.diff(first)) * 256 + np.array(label, np.int64), "target": np.array(target, np.int64),
            "skip": np.array(skip, np.int64), "final": np.array(finals, bool),
            "offset": np.cumsum([0, *map(len, ids)]).astype(np.int64), "ids": np.fromiter(chain.from_iterable(ids), np.int64),
        })

    def rows(self, found: list[bytes]) -> np.ndarray:
        """The row of each word, -1 where the lexicon lacks it. All words walk the arcs together."""
        n = len(found)
        row, state, alive = np.zeros(n, np.int64), np.zeros(n, np.int64), np.arange(n)
        length = np.fromiter(map(len, found), np.int64, n)
        out = np.full(n, -1, np.int64)
        if not n or not len(self.keys):
            return out
        width = min(int(length.max()), LEXICON_BYTES)
        alive = alive[(length <= LEXICON_BYTES) & (length > 0)]
        table = np.frombuffer(b"".join(w[:width].ljust(width, b"\0") for w in found), np.uint8).reshape(n, width) if width else np.zeros((n, 0), np.uint8)
        for step in range(width):
            key = state[alive] * 256 + table[alive, step]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[at] == key
            alive, at = alive[ok], at[ok]
            row[alive] += self.a["skip"][at]
            state[alive] = self.a["target"][at]
            ended = length[alive] == step + 1
            done = alive[ended]
            out[done] = np.where(self.a["final"][state[done]], row[done], -1)
            alive = alive[~ended]
        return out

    def save(self) -> bytes:
        head = json.dumps({k: [str(self.a[k].dtype), len(self.a[k])] for k in self.NAMES}).encode()
        head += b" " * (-(len(head) + 8) % 8)
        body = [np.ascontiguousarray(self.a[k]).tobytes() for k in self.NAMES]
        return len(head).to_bytes(8, "little") + head + b"".join(b + b"\0" * (-len(b) % 8) for b in body)

    @classmethod
    def load(cls, buffer) -> Lexicon:
        """From a memory map or bytes; the arrays are views of it."""
        size = int.from_bytes(bytes(buffer[:8]), "little")
        spec, at, arrays = json.loads(bytes(buffer[8 : 8 + size])), 8 + size, {}
        for name, (kind, n) in spec.items():
            arrays[name] = np.frombuffer(buffer, kind, n, at)
            at += -(-n * arrays[name].itemsize // 8) * 8
        return cls(arrays)


def word_counts(docs: DataFrame, vocab_path: str, text: str = "text") -> DataFrame:
    """(word, n) of all texts, words being the pieces that are merged apart: counted in each task,
    then summed by word."""

    def count(batches):
        vocab, seen = vocabulary(vocab_path), Counter()

        def flush():
            pieces: dict[str, int] = {}
            get = pieces.get
            for word, n in seen.items():
                if word.isalpha():  # as ``pieces`` has it; most words
                    piece = " " + word
                    pieces[piece] = get(piece, 0) + n
                else:
                    for piece in vocab.pieces(word):
                        pieces[piece] = get(piece, 0) + n
            seen.clear()
            return {"word": [*pieces], "n": [*pieces.values()]}

        for batch in batches:
            for t in batch[text]:
                if t:
                    seen.update(words(t, vocab))
                    if len(seen) > KEPT_WORDS:
                        yield flush()
        if seen:
            yield flush()

    short = map_rows(docs, [text], count, "word string, n long").filter(F.octet_length("word") <= LEXICON_BYTES)
    return short.groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, vocab_path: str, text: str = "text", size: int = LEXICON_WORDS) -> Lexicon:
    """The lexicon of the most frequent words of all documents: of all words that occur as often as some
    number, twice at least, the most that are no more than ``size``. Only these and counts of counts,
    first by orders of magnitude, then within the one that matters, come to the driver."""
    vocab = vocabulary(vocab_path)
    counts = cut(word_counts(docs, vocab_path, text).filter("n > 1").withColumn("order", F.floor(8 * F.log2("n")).cast("int")))
    left, most = size, None
    for r in counts.groupBy("order").agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("order")).collect():  # 8 for each bit of n
        if r.words > left:
            most = r.order
            break
        left -= r.words
    least = 2
    if most is not None:
        last = None
        for r in counts.filter(F.col("order") == most).groupBy("n").agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("n")).collect():
            if r.words > left:
                last = r.n
                break
            left -= r.words
        least = last + 1
    top = counts.filter(F.col("n") >= least).select("word").collect()
    return Lexicon.build({r.word.encode(): vocab.ids(r.word) for r in top})


class Numbers(dict):
    """Words by number; one that is looked up for the first time gets the next number and is noted as ``new``."""

    def __init__(self, words=()):
        super().__init__(zip(words, range(len(words)), strict=True))
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        self[word] = n = len(self)
        return n


class Encoder:
    """Ids of texts by the lexicon and the merges; keeps a bounded number of words with their ids."""

    def __init__(self, vocab: Vocabulary, lexicon: Lexicon):
        self.vocab, self.lexicon = vocab, lexicon
        sizes = np.fromiter(map(len, vocab.bytes), np.int64, len(vocab.bytes))
        self.token_at, self.token_len = np.cumsum(sizes) - sizes, sizes
        self.token_bytes = np.frombuffer(b"".join(vocab.bytes), np.uint8)
        self.reset()

    def reset(self) -> None:
        self.known = Numbers()
        self.forget_pieces()
        self.start, self.length, self.uses = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.int64)

    def forget(self) -> None:
        """Forgets all but the most used third of the words it keeps."""
        kept = np.zeros(len(self.uses), bool)
        kept[np.argsort(-self.uses, kind="stable")[: KEPT_WORDS // 3]] = True
        stays = kept.tolist()
        self.known = Numbers([w for w, i in self.known.items() if stays[i]])
        self.pool = self.pool[spans(self.start[kept], self.length[kept])]
        self.length, self.uses = self.length[kept], self.uses[kept] // 2
        self.start = np.cumsum(self.length) - self.length
        self.forget_pieces()

    def forget_pieces(self) -> None:
        self.known_pieces = Numbers()
        self.piece_start, self.piece_length, self.piece_pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def learn(self, new: list[str]) -> None:
        """Ids of new words, those of their pieces one after another."""
        parts = [[" " + w] if w.isalpha() else self.vocab.pieces(w) for w in new]  # most are plain words
        n_parts = np.fromiter(map(len, parts), np.int64, len(parts))
        at = np.fromiter(map(self.known_pieces.__getitem__, chain.from_iterable(parts)), np.int64, int(n_parts.sum()))
        if self.known_pieces.new:
            self.learn_pieces(self.known_pieces.new)
            self.known_pieces.new = []
        lengths = self.piece_length[at]
        sizes = np.diff(np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(n_parts)])])
        self.start = np.concatenate([self.start, len(self.pool) + np.cumsum(sizes) - sizes])
        self.length = np.concatenate([self.length, sizes])
        self.pool = np.concatenate([self.pool, self.piece_pool[spans(self.piece_start[at], lengths)]])
        self.uses = np.concatenate([self.uses, np.zeros(len(new), np.int64)])

    def learn_pieces(self, new: list[str]) -> None:
        """Ids of new pieces: the lexicon has those of frequent ones, the others are merged."""
        raw, special = [p.encode() for p in new], self.vocab.special
        row, offset = self.lexicon.rows(raw), self.lexicon.a["offset"]
        found, lacking = np.flatnonzero(row >= 0), np.flatnonzero(row < 0)
        whole = [i for i in lacking.tolist() if new[i] in special]
        if whole:
            lacking = np.setdiff1d(lacking, whole)
        n, merged = self.vocab.merge_all([raw[i] for i in lacking.tolist()])
        size = np.ones(len(new), np.int64)
        size[found], size[lacking] = offset[row[found] + 1] - offset[row[found]], n
        parts = [self.lexicon.a["ids"][spans(offset[row[found]], size[found])], merged, np.array([special[new[i]] for i in whole], np.int64)]
        order, base = np.concatenate([found, lacking, np.array(whole, np.int64)]), len(self.piece_pool)
        start = np.empty(len(new), np.int64)
        start[order] = base + np.cumsum(size[order]) - size[order]
        self.piece_start = np.concatenate([self.piece_start, start])
        self.piece_length = np.concatenate([self.piece_length, size])
        self.piece_pool = np.concatenate([self.piece_pool, *parts])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each text, ids of all texts)."""
        parts = [words(t, self.vocab) for t in texts]
        if len(self.known) > KEPT_WORDS:
            self.forget()
        known = self.known
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        at = np.fromiter(map(known.__getitem__, chain.from_iterable(parts)), np.int64, int(sizes.sum()))
        if known.new:
            self.learn(known.new)
            known.new = []
        self.uses += np.bincount(at, minlength=len(self.uses))
        lengths = self.length[at]
        before = np.concatenate([[0], np.cumsum(lengths)])
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return np.diff(before[ends]), self.pool[spans(self.start[at], lengths)]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, bytes]:
        """(bytes of each id, bytes of all ids)."""
        return self.token_len[ids], self.token_bytes[spans(self.token_at[ids], self.token_len[ids])].tobytes()


def spans(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each span, one span after another."""
    shift = np.repeat(start - (np.cumsum(length) - length), length)
    return shift + np.arange(len(shift))


def slices(values: list, chars: int = SLICE_CHARS):
    """Stretches of a list of texts with at most ``chars`` characters, or one text."""
    rest = iter(values)
    held: list[str] = []
    size = 0
    for v in rest:
        held.append(v)
        size += len(v)
        if size > chars:
            yield held
            held, size = [], 0
    if held:
        yield held


def encode_decode(docs: DataFrame, vocab_path: str, key: str = "doc_id", text: str = "text", size: int = LEXICON_WORDS) -> DataFrame:
    """(key, n_tokens, ids, decoded) of every text; other columns are left to the caller.

    A null text counts as empty: no ids, decoded to the empty string. An empty table gives an empty
    result. Rows that repeat, with equal or null keys, are encoded each. Bytes that form no valid
    UTF-8 are decoded to the replacement character, which can't happen for ids of a valid text.
    """
    name = share_file(docs.sparkSession, "lexicon", build_lexicon(docs, vocab_path, text, size).save())

    def run(batches):
        mapped = np.memmap(SparkFiles.get(name), np.uint8, "r")
        encoder = Encoder(vocabulary(vocab_path), Lexicon.load(mapped))
        gc.disable()  # what it makes has no cycles, and the collector would walk all kept words again and again
        try:
            yield from encoded(encoder, batches)
        finally:
            gc.enable()

    def encoded(encoder, batches):
        for batch in batches:
            keys = iter(batch[key])
            for texts in slices([t or "" for t in batch[text]]):
                n, ids = encoder.encode(texts)
                wide, raw = encoder.decode(ids)
                ends = np.concatenate([[0], np.cumsum(n)])
                cuts = np.concatenate([[0], np.cumsum(wide)])[ends].tolist()
                yield {
                    key: [*islice(keys, len(texts))],
                    "n_tokens": pa.array(n),
                    "ids": pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32))),
                    "decoded": [raw[a:b].decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:], strict=False)],
                }

    kind = docs.schema[key].dataType.simpleString()
    return map_rows(docs, [key, text], run, f"`{key}` {kind}, n_tokens long, ids array<int>, decoded string")
