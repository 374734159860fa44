"""Wide bitmaps of long sets: folding and the bound on set differences."""

import numpy as np

from sensemill.llm import jaccard_join as J


def test_bits_never_exceed_members():
    rng = np.random.default_rng(3)
    for _ in range(40):
        common = rng.integers(0, 2**63, int(rng.integers(1000, 3000))).astype(np.uint64)
        a, b = (np.unique(np.concatenate([common, rng.integers(0, 2**63, int(rng.integers(0, 1200))).astype(np.uint64)])) for _ in range(2))
        x, y = (J.parity_bitmap(s, 1 << len(s).bit_length()) for s in (a, b))
        assert J.differing_bits(x, y) <= len(np.setxor1d(a, b))
        assert J.differing_bits(x, J.parity_bitmap(a, 2048)) == 0


def test_long_near_copies_link(spark):
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in rng.integers(0, 10**6, 2500)]
    near = [*words[:-20], *(f"x{k}" for k in range(20))]
    other = [f"w{k}" for k in rng.integers(0, 10**6, 2500)]
    half = words[:1250] + other[1250:]
    rows = [(3, " ".join(words)), (1, " ".join(near)), (2, " ".join(other)), (4, " ".join(half))]
    got = {r.doc_id: r.component_id for r in J.jaccard_components(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {3: 1, 1: 1, 2: 2, 4: 4}
