import random

import numpy as np
import pytest

from foliant.llm import bwt


def brute(shards):
    """Suffixes of all shards in order: (suffix, shard, text), ends by shard and text."""
    rows = [(t[i:] + b"\0", s, k) for s, texts in enumerate(shards) for k, t in enumerate(texts) for i in range(len(t) + 1)]
    return sorted(rows, key=lambda r: (r[0], r[1], r[2]))


@pytest.mark.parametrize("seed", range(6))
def test_merge(seed):
    r = random.Random(seed)
    shards = [[bytes(r.choice(b"ab") for _ in range(r.randint(0, 25))) for _ in range(r.randint(1, 4))] for _ in range(3)]
    z, prefix, _ = bwt.merge([bwt.transform(t)[0] for t in shards])
    rows = brute(shards)
    assert z.tolist() == [s for _, s, _ in rows]

    def common(a, b):
        n = 0
        while a[n : n + 1] == b[n : n + 1] and a[n] != 0:
            n += 1
        return n

    assert prefix.tolist() == [0] + [common(a[0], b[0]) for a, b in zip(rows, rows[1:])]
    hit = bwt.repeated(prefix, 5)
    count = {}
    for s, *_ in rows:
        if len(s) > 5:
            count[s[:5]] = count.get(s[:5], 0) + 1
    assert hit.tolist() == [len(s) > 5 and count[s[:5]] > 1 for s, *_ in rows]


def test_nothing():
    assert bwt.merge([np.zeros(0, np.uint8)])[2] == 0
