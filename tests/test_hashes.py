"""MD5 of many texts at once against hashlib."""

import hashlib
import random

import numpy as np
import pytest

from agreeline.functions import hashes


@pytest.mark.parametrize("few", [0, 10**9])
def test_numbers_equal_hashlib(monkeypatch, few):
    monkeypatch.setattr(hashes, "FEW", few)
    rng = random.Random(3)
    texts = [rng.randbytes(n) for n in (0, 1, 2, 3, 4, 5, 8, 30, 53, 54, 55, 56, 70, 200) for _ in range(3)]
    prefixes = [rng.randbytes(n) for n in (0, 1, 1, 1, 2, 3, 4, 4, 11, 12, 13, 55, 56, 0)]
    seen = 0
    for at_once in (1, 7, 1000):
        for places, tails in hashes.by_length(texts):
            for start, block in tails.md5(prefixes, at_once):
                for p in range(block.shape[1]):
                    for t, i in enumerate(places):
                        want = hashlib.md5(prefixes[start + p] + texts[i]).hexdigest()
                        assert [f"{x:08x}" for x in block[:, p, t].tolist()] == [want[k : k + 8] for k in range(0, 32, 8)]
                        seen += 1
    assert seen == 3 * len(texts) * len(prefixes)


def test_numerals():
    found = hashes.numerals(7, 1003)
    assert [first for first, _ in found] == [7, 10, 100, 1000]
    assert [row.tobytes() for _, tails in found for row in tails.texts] == [str(k).encode() for k in range(7, 1003)]
    assert np.ndim(found[0][1].texts) == 2
