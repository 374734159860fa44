"""The pair search of one cell against all pairs one by one."""

import numpy as np

from sensemill.llm import jaccard_join as J


def test_cell_with_many_partners_equals_pair_by_pair():
    rng = np.random.default_rng(5)
    m, percent = 300, 80
    n = np.sort(rng.integers(90, 120, m))
    pos, group = rng.integers(0, 20, m), np.arange(m)
    base = rng.integers(0, 2, (6, J.BITMAP), dtype=np.uint8)
    bits = base[rng.integers(0, 6, m)]
    for row in bits:
        row[rng.integers(0, J.BITMAP, rng.integers(0, 20))] ^= 1
    bits = np.packbits(bits, axis=1).view(np.uint64)
    i, j, d = J._passing(n, pos, group, bits, np.zeros(m, int), False, None, percent)
    want = set()
    for a in range(m):
        for b in range(a + 1, m):
            both = int(n[a] + n[b])
            need = -(-percent * both // (100 + percent))
            most = min(pos[a], pos[b]) + min(n[a] - pos[a], n[b] - pos[b])
            differ = int(np.bitwise_count(bits[a] ^ bits[b]).sum())
            if 100 * n[a] >= percent * n[b] and most >= need and differ <= both - 2 * need:
                want.add((a, b, differ))
    assert want and set(zip(i.tolist(), j.tolist(), d.tolist(), strict=True)) == want
