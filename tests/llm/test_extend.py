"""Seed and extend, and the family of suffix indexes, against brute force on texts made to be awkward."""

import hashlib
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from sensemill.llm import extend as X
from sensemill.llm import jaccard_join, seed_extend, suffix_index
from sensemill.llm.shared import Workspace, documents, setting

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def awkward(seed):
    """A shared passage between many beginnings and ends, near copies, repeats inside a text, one word over and over."""
    rng = np.random.default_rng(seed)
    part = lambda n, k=500: [f"v{x}" for x in rng.integers(0, k, n)]
    passage, base = part(75), part(160)
    texts = [" ".join(part(int(rng.integers(0, 12))) + passage + part(int(rng.integers(0, 12)))) for _ in range(12)]
    for _ in range(12):
        copy = list(base)
        for at in rng.integers(0, len(copy), int(rng.integers(1, 4))):
            copy[at] = f"x{rng.integers(0, 3)}"
        texts.append(" ".join(copy))
    twice = part(60)
    texts += [" ".join(part(5) + twice + part(9) + twice + part(4)), "la " * 130, "la " * 90 + "lo " + "la " * 70, " ".join(part(70, 2)), " ".join(part(90, 2)), "", None, "é" * 300, "é" * 301]
    ids = [int(x) for x in rng.permutation(len(texts))]
    ids[3] = ids[4]  # two rows under one id
    rows = list(zip(ids, texts)) + [(None, texts[0]), (None, texts[14]), (ids[5], texts[5])]
    return rows, "doc_id long, text string"


@pytest.mark.parametrize(("seed", "most"), [(1, 1), (2, 3), (3, 128)])
def test_seed_extend_by_brute_force(spark, seed, most):
    rows, schema = awkward(seed)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in seed_extend.remove_repeats(spark, spark.createDataFrame(rows, schema), most=most).collect())
    words = [(2**63 - 1 if i is None else i, WORD.findall(t or "")) for i, t in rows]
    first = {}
    for i, w in words:
        for k in range(len(w) - 49):
            first[tuple(w[k : k + 50])] = min(i, first.get(tuple(w[k : k + 50]), i))
    want = []
    for i, w in words:
        gone = {q for k in range(len(w) - 49) if first[tuple(w[k : k + 50])] < i for q in range(k, k + 50)}
        want.append((-1 if i == 2**63 - 1 else i, len(w), len(gone), hashlib.sha256(" ".join(t for q, t in enumerate(w) if q not in gone).encode()).hexdigest()))
    assert got == sorted(want) and sum(w[2] > 0 for w in want) > 10


@pytest.mark.parametrize(("seed", "most", "batches"), [(4, 1, 5), (5, 3, 3), (6, 128, 1)])
def test_suffix_index_by_brute_force(spark, seed, most, batches):
    rows, schema = awkward(seed)
    rows = [(i, None if t is None else t.encode()[:900].decode(errors="ignore")) for i, t in rows]
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_index.remove_repeated_bytes(spark, spark.createDataFrame(rows, schema), most=most, batches=batches).collect())
    raw = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(b[k : k + 400] for _, b in raw for k in range(len(b) - 399))
    want = []
    for i, b in raw:
        gone = [False] * len(b)
        for k in range(len(b) - 399):
            if count[b[k : k + 400]] > 1:
                gone[k : k + 400] = [True] * 400
        spans = sum(g and (p == 0 or not gone[p - 1]) for p, g in enumerate(gone))
        want.append((-1 if i is None else i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    assert got == sorted(want) and sum(w[2] > 0 for w in want) > 10


def thue_morse(n, a="a", b="b"):
    return "".join((a, b)[bin(k).count("1") % 2] for k in range(n))


def test_words_that_collide_as_polynomials(spark):
    """Thue-Morse words differ though their plain polynomials modulo 2**64 are equal."""
    same = " ".join(f"w{k}" for k in range(49))
    rows = [(1, f"{same} {thue_morse(1024)}"), (2, f"{same} {thue_morse(1024, 'b', 'a')}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in seed_extend.remove_repeats(spark, docs).collect()} == {1: 0, 2: 0}
    short = spark.createDataFrame([(1, thue_morse(1024)), (2, thue_morse(1024, "b", "a"))], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(spark, short).collect()} == {1: 1, 2: 2}
    # 2048 letters hold the 400-byte strings of both, but for those around the middle
    assert {r.doc_id: r.n_removed > 0 for r in suffix_index.remove_repeated_bytes(spark, short).collect()} == {1: True, 2: True}


def test_levels_are_neither_exchanged_nor_sorted_again(spark):
    work = Workspace(spark, "levels")
    rows, schema = awkward(7)
    docs = X.versioned(documents(spark.createDataFrame(rows, schema)))
    index = suffix_index.SuffixIndex(work, 4)
    with suffix_index.in_place(spark), setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"), setting(spark, "spark.sql.adaptive.coalescePartitions.enabled", "false"):
        for b in range(7):
            new = index.array(X.scan_segments(docs.where(f"pmod(version, 7) = {b}"), X.BYTES, 400, 96))
            for level in index.levels:
                for keys, how in ((["anchor"], "left_semi"), (X.KIND, "left_semi"), (X.KIND, "full_outer")):
                    plan = level.table.join(new.table.select(*keys), keys, how)._jdf.queryExecution().executedPlan().toString()
                    assert "Exchange" not in plan and "Sort [" not in plan and "SortMergeJoin" in plan
            index.add(new)
            files = [f.name for f in Path(work.path(index.levels[-1].name).removeprefix("file:")).glob("*.parquet")]
            assert len({f.rpartition("_")[2] for f in files}) == len(files)  # a bucket is one file
        assert [x.batches for x in index.levels] == [4, 2, 1]
        whole = X.kinds_of(X.scan_segments(docs.where("pmod(version, 7) < 4"), X.BYTES, 400, 96))
        assert sorted(map(tuple, index.levels[0].table.collect())) == sorted(map(tuple, whole.collect()))
    index.close()
    assert not index.levels
