"""Seeds and their extension: shared machinery of the two exact substring operators.

A text is a sequence of units (words or bytes); a window is ``window`` consecutive
units of one text.  Every window has an anchor, the leftmost of the smallest
fingerprints of ``seed`` units in it, so equal windows have equal anchors at equal
places, and texts need to be joined on anchors only.  What can be extended around an
anchor is its segment: the run of windows that have this anchor.

Segments of equal content are one kind: they match from end to end.  Kinds that share
an anchor are extended against each other, unit by unit, both ways from the anchor, and
keep the maximal repeats of a window or more.  Groups of more than MOST kinds are parted
by longer seeds first: what all windows of a block of places have in common, and then
the windows themselves, each joined on its own; so no group is written out pair by pair
and none is left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .shared import Workspace, fields, maybe_needed

#: Kinds of one anchor that are extended pair by pair.
MOST = 128
#: Windows of a block, by which larger groups are parted.
BLOCK = 16
#: Low bits of an anchor's key that hold its place in the run of texts.
PLACE_BITS = 31
#: Stands for a null id: larger than all others.
NO_ID = 2**63 - 1
#: Rows of kinds whose pairs are extended in one go, and pairs compared at once.
ROWS, PAIRS = 4096, 2048

SEGMENTS = fields(doc_id="long", version="long", first="int", last="int", gap="int", anchor="long", c1="long", c2="long")
CONTEXTS = fields(anchor="long", c1="long", c2="long", n="long", k="long", d="long", gap="int", span="int", content="binary")
BLOCKS = fields(anchor="long", c1="long", c2="long", n="long", d="long", near="int", far="int", key="long", e1="long", e2="long")
WINDOWS = fields(key="long", e1="long", e2="long", n="long", d="long", at="int", h1="long", h2="long")
HITS = fields(key="long", c1="long", c2="long", near="int", far="int")
KIND = ["anchor", "c1", "c2"]


@dataclass(frozen=True)
class Units:
    """How texts become units: ``split`` gives a value for each unit and where texts begin, ``gram`` units speak through one value.

    ``kind`` is a unit in a context; ``context`` gives what contexts are cut from.
    """

    split: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
    gram: int
    kind: str

    def values(self, contents: np.ndarray) -> np.ndarray:
        """The values of the units of contexts laid end to end."""
        return contents if self.gram == 1 else K.byte_eights(contents)

    def context(self, buf: np.ndarray, values: np.ndarray) -> np.ndarray:
        return values if self.gram == 1 else buf


def _words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start, end, cuts = K.word_spans(buf, off)
    return K.word_values(buf, start, end), cuts


#: Words, told apart by their 64-bit values; and bytes, compared as they are.
WORDS = Units(_words, 1, "<u8")
BYTES = Units(lambda buf, off: (K.byte_eights(buf), off), K.EIGHT, "u1")


def own_id(name: str = "doc_id") -> Column:
    return F.coalesce(F.col(name), F.lit(NO_ID))


def versioned(df: DataFrame) -> DataFrame:
    """A fingerprint of each row's id and text: equal rows have equal results."""
    return df.withColumn("version", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))


# ------------------------------------------------------------------- segments


def segments(x: np.ndarray, cuts: np.ndarray, window: int, seed: int, gram: int = 1) -> tuple[np.ndarray, ...]:
    """Text, first and last window (in units of the text), way to the anchor, anchor and two content fingerprints of all segments."""
    n = len(x)
    none = np.empty(0, np.int64)
    size = np.diff(cuts)
    if n < window or not (size >= window).any():
        return none, none, none, none, *[none.astype(np.uint64)] * 3
    one = K.Rolling(x, 0)
    grams = one.every(seed - gram + 1)[: n - seed + 1]
    low = np.uint64((1 << PLACE_BITS) - 1)
    key = K.sliding_min((grams & ~low) | np.arange(len(grams), dtype=np.uint64), window - seed + 1)
    begin, stop = cuts[:-1][size >= window], cuts[1:][size >= window] - window + 1
    change = np.ones(len(key) + 1, bool)
    change[1:-1] = key[1:] != key[:-1]
    change[begin] = True
    change[stop] = True
    edges = np.flatnonzero(change)
    first, after = edges[:-1], edges[1:]
    text = np.searchsorted(begin, first, side="right") - 1
    inside = (text >= 0) & (first < stop[np.maximum(text, 0)])
    first, after, text = first[inside], after[inside], np.flatnonzero(size >= window)[text[inside]]
    place = (key[first] & low).astype(np.int64)
    end = after - 1 + window - gram + 1
    return text, first - cuts[text], after - 1 - cuts[text], place - first, grams[place], one.of(first, end), K.Rolling(x, 1).of(first, end)


def scan_segments(docs: DataFrame, units: Units, window: int, seed: int) -> DataFrame:
    """All segments of ``docs`` (doc_id, text, version)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, _j, buf, off in K.runs(batch.column(1)):
                text, *places, anchor, c1, c2 = segments(*units.split(buf, off), window, seed, units.gram)
                if len(text):
                    rows = pa.array(text + i)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(rows), batch.column(2).take(rows), *(pa.array(p.astype(np.int32)) for p in places), *(pa.array(K.as_signed(p)) for p in (anchor, c1, c2))], names=SEGMENTS.names
                    )

    return docs.select("doc_id", "text", "version").mapInArrow(scan, SEGMENTS)


def kinds_of(segments: DataFrame) -> DataFrame:
    """Kinds: how often each stands, its first place (by id), and its shape."""
    lead = F.min(F.struct(own_id().alias("d"), F.col("version").alias("v"), F.col("first").alias("f"))).alias("lead")
    shape = (F.min("gap").alias("gap"), F.min(F.col("last") - F.col("first")).alias("span"))
    return segments.groupBy(*KIND).agg(F.count("*").alias("n"), lead, *shape).select(*KIND, "n", F.col("lead.d").alias("d"), F.col("lead.v").alias("v"), F.col("lead.f").alias("f"), "gap", "span")


def in_groups(kinds: DataFrame) -> DataFrame:
    """Kinds whose anchor stands twice or more, with ``k``, the kinds of that anchor."""
    # all columns take part, so both sides of the join read one and the same exchange of the kinds
    every = F.max(F.struct("d", "v", "f", "gap", "span")).alias("_every")
    groups = kinds.groupBy("anchor").agg(F.sum("n").alias("_n"), F.count("*").alias("k"), every).where("_n > 1 and _every is not null")
    return kinds.join(groups.select("anchor", "k"), "anchor")


# ------------------------------------------------------------------- contexts


def scan_contexts(docs: DataFrame, kinds: DataFrame, units: Units, window: int) -> DataFrame:
    """What surrounds the anchor at the first place of each kind: its segment's units.

    Only texts that hold such a place move; each comes together with its own places.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, off in K.runs(batch.column(0)):
                lists = batch.column(1).slice(i, j - i)
                row = np.repeat(np.arange(j - i), lists.value_lengths().to_numpy())
                places = pa.RecordBatch.from_struct_array(lists.flatten())
                x, cuts = units.split(buf, off)
                flat = units.context(buf, x)
                at = cuts[row] + places["f"].to_numpy()
                content = [flat[a:b].tobytes() for a, b in zip(at.tolist(), (at + places["span"].to_numpy() + window).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(places[c] for c in CONTEXTS.names[:-1]), pa.array(content, pa.binary())], names=CONTEXTS.names)

    lists = kinds.groupBy("d", "v").agg(F.collect_list(F.struct(*CONTEXTS.names[:-1], "f")).alias("places"))
    texts = maybe_needed(docs, kinds.select("v"))
    met = texts.join(lists.hint("merge"), (F.col("version") == F.col("v")) & (own_id() == F.col("d")))
    # repeated rows stand together after the join, so this needs no exchange
    return met.dropDuplicates(["v", "d"]).select("text", "places").mapInArrow(scan, CONTEXTS)


# -------------------------------------------------------------- pairs of a group


def _aligned(flat: np.ndarray, at: np.ndarray, length: np.ndarray, step: int) -> np.ndarray:
    """One row for each stretch of ``flat`` that leaves ``at`` in steps of 1 or -1; what lies beyond its length is no matter."""
    width = max(1, int(length.max()))
    return flat[np.clip(at[:, None] + step * np.arange(width), 0, len(flat) - 1)]


def _common(rows: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many leading units rows i and j have in common."""
    differ = rows[i] != rows[j]
    return np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])


def extend_pairs(key: np.ndarray, d: np.ndarray, gap: np.ndarray, near: np.ndarray, far: np.ndarray, flat: np.ndarray, off: np.ndarray, window: int, directed: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, near, far) of the windows that rows share with others of their group, as ways to the anchor.

    Rows are sorted by key and d.  Every pair is extended left
    and right of the anchor; what is a window or longer counts, for the later one
    alone (and only if its d is larger) or for both.
    """
    m = len(key)
    before = _aligned(flat, off[:-1] + gap - 1, gap, -1)
    after = _aligned(flat, off[:-1] + gap, np.diff(off) - gap, 1)
    later = np.searchsorted(key, key, side="right") - np.arange(m) - 1
    i = np.repeat(np.arange(m), later)
    j = np.arange(later.sum()) - np.repeat(np.cumsum(later) - later, later) + i + 1
    if directed:
        i, j = i[d[i] < d[j]], j[d[i] < d[j]]
    delta = np.zeros((m, window + 2), np.int32)
    for at in range(0, len(i), PAIRS):
        a, b = i[at : at + PAIRS], j[at : at + PAIRS]
        left = np.minimum(_common(before, a, b), np.minimum(far[a], far[b]))
        right = np.minimum(_common(after, a, b), np.minimum(np.diff(off)[a] - gap[a], np.diff(off)[b] - gap[b]))
        least = np.maximum(window - right, np.maximum(near[a], near[b]))
        long = left >= least
        for rows in (b,) if directed else (a, b):
            np.add.at(delta, (rows[long], least[long]), 1)
            np.add.at(delta, (rows[long], left[long] + 1), -1)
    inside = np.zeros((m, window + 3), np.int8)
    inside[:, 1:] = np.cumsum(delta, axis=1) > 0
    edge = np.diff(inside, axis=1)
    row, begin = np.nonzero(edge == 1)
    return row, begin, np.nonzero(edge == -1)[1] - 1


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole groups, ROWS rows or one group each; input is sorted by key, a group has MOST rows at most."""
    rest: pa.Table | None = None
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            table = pa.Table.from_batches([batch.slice(at, ROWS)])
            table = table if rest is None else pa.concat_tables([rest, table]).combine_chunks()
            key = table["key"].to_numpy()
            cut = int(np.flatnonzero(key[1:] != key[:-1])[-1]) + 1 if (key[1:] != key[:-1]).any() else 0
            if cut:
                yield table.slice(0, cut)
            rest = table.slice(cut)
    if rest is not None and len(rest):
        yield rest


def pair_hits(rows: DataFrame, units: Units, window: int, directed: bool) -> DataFrame:
    """Hits of kinds (key, c1, c2, d, gap, near, far, content) in groups of MOST at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches):
            col = {c: table[c].to_numpy() for c in ("key", "d", "gap", "near", "far")}
            content = table["content"].combine_chunks()
            _, off, data = content.buffers()
            off = np.frombuffer(off, np.int32)[content.offset : content.offset + len(content) + 1].astype(np.int64)
            flat = np.frombuffer(data, np.uint8)[off[0] : off[-1]].view(units.kind)
            col = {c: v.astype(np.int64) for c, v in col.items()}
            row, near, far = extend_pairs(col["key"], col["d"], col["gap"], col["near"], col["far"], flat, (off - off[0]) // flat.itemsize, window, directed)
            if len(row):
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([*(table[c].combine_chunks().take(at) for c in ("key", "c1", "c2")), pa.array(near.astype(np.int32)), pa.array(far.astype(np.int32))], names=HITS.names)

    rows = rows.select("key", "c1", "c2", "d", "gap", "near", "far", "content").repartition("key").sortWithinPartitions("key", "d")
    return rows.mapInArrow(run, HITS)


# ------------------------------------------------------------------ large groups


def _prints(content: pa.Array, units: Units) -> tuple[K.Rolling, K.Rolling, np.ndarray]:
    """Fingerprints over contexts laid end to end, and where each begins."""
    _, off, data = content.buffers()
    off = np.frombuffer(off, np.int32)[content.offset : content.offset + len(content) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8)[off[0] : off[-1]].view(units.kind)
    x = units.values(flat)
    return K.Rolling(x, 0), K.Rolling(x, 1), (off - off[0]) // flat.itemsize


def _ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of all values from low to high, both included."""
    count = high - low + 1
    row = np.repeat(np.arange(len(low)), count)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + low[row]


def scan_blocks(contexts: DataFrame, units: Units, window: int, block: int) -> DataFrame:
    """Kinds cut by the way to the anchor, in blocks; a block's key is what all its windows have in common, around one anchor."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                one, two, off = _prints(part["content"], units)
                gap, least = (x.astype(np.int64) for x in (part["gap"].to_numpy(), part["gap"].to_numpy() - part["span"].to_numpy()))
                row, b = _ranges(least // block, gap // block)
                far, near = np.minimum(b * block + block - 1, gap[row]), np.maximum(b * block, least[row])
                place, short = off[row] + gap[row], units.gram - 1
                core = one.of(place - b * block, place - b * block - block + 1 + window - short)
                key = K.mix(core ^ K.mix(part["anchor"].to_numpy().view(np.uint64)[row] + b.astype(np.uint64)))
                ends = place - far, place - near + window - short
                rows = pa.array(row)
                yield pa.RecordBatch.from_arrays([*(part[c].take(rows) for c in (*KIND, "n", "d")), pa.array(near.astype(np.int32)), pa.array(far.astype(np.int32)), *(pa.array(K.as_signed(p)) for p in (key, one.of(*ends), two.of(*ends)))], names=BLOCKS.names)

    return contexts.select(*KIND, "n", "d", "gap", "span", "content").mapInArrow(scan, BLOCKS)


def scan_windows(rows: DataFrame, units: Units, window: int) -> DataFrame:
    """Every window of kinds (key, e1, e2, n, d, gap, near, far, content), with two fingerprints."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                one, two, off = _prints(part["content"], units)
                row, t = _ranges(part["near"].to_numpy().astype(np.int64), part["far"].to_numpy().astype(np.int64))
                at = off[row] + part["gap"].to_numpy()[row] - t
                ends, rows = (at, at + window - units.gram + 1), pa.array(row)
                yield pa.RecordBatch.from_arrays([*(part[c].take(rows) for c in ("key", "e1", "e2", "n", "d")), pa.array(t.astype(np.int32)), *(pa.array(K.as_signed(p.of(*ends))) for p in (one, two))], names=WINDOWS.names)

    return rows.select("key", "e1", "e2", "n", "d", "gap", "near", "far", "content").mapInArrow(scan, WINDOWS)


def _large_hits(work: Workspace, contexts: DataFrame, units: Units, window: int, directed: bool, most: int, block: int) -> DataFrame:
    """Hits of the kinds of large groups: groups of blocks, pair by pair where these are small, else window by window."""
    cut = ["key", "e1", "e2"]
    blocks = work.keep(scan_blocks(contexts, units, window, block), "blocks", few=True)
    lead = F.min(F.struct("d", *KIND)).alias("lead")
    parts = blocks.groupBy(*cut).agg(F.sum("n").alias("n"), lead, F.min("near").alias("near"), F.min("far").alias("far"))
    parts = work.keep(parts, "block-kinds", few=True)
    groups = parts.groupBy("key").agg(F.count("*").alias("k")).where("k > 1")
    differing = parts.join(groups, "key").select(*cut, "n", "k", F.col("lead.d").alias("d"), *(F.col(f"lead.{c}").alias(c) for c in KIND), "near", "far")
    met = work.keep(differing.join(contexts.select(*KIND, "gap", "content"), KIND), "block-contexts", few=True)
    small = pair_hits(met.where(F.col("k") <= most).drop(*KIND).withColumnsRenamed({"e1": "c1", "e2": "c2"}), units, window, directed)
    windows = scan_windows(met.where(F.col("k") > most), units, window)  # made twice: that costs less than a table of it
    same = windows.groupBy("h1", "h2").agg(F.min("d").alias("least"), F.max("d").alias("most"), F.sum("n").alias("times"))
    same = same.where("least < most" if directed else "times > 1").drop("most", "times")
    single = windows.join(same, ["h1", "h2"]).where("d > least" if directed else "true").select("key", F.col("e1").alias("c1"), F.col("e2").alias("c2"), F.col("at").alias("near"), F.col("at").alias("far"))
    hits = small.unionByName(single).withColumnsRenamed({"c1": "e1", "c2": "e2", "near": "_near", "far": "_far"})
    placed = blocks.join(parts.select(*cut, F.col("n").alias("times"), F.col("lead.d").alias("least")), cut)
    whole = F.col("d") > F.col("least") if directed else F.col("times") > 1
    full = placed.where(whole).select(F.col("anchor").alias("key"), "c1", "c2", "near", "far")
    rest = placed.where(~whole).join(hits, cut).select(F.col("anchor").alias("key"), "c1", "c2", F.col("_near").alias("near"), F.col("_far").alias("far"))
    return full.unionByName(rest)


def find_hits(work: Workspace, docs: DataFrame, kinds: DataFrame, units: Units, window: int, directed: bool, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """For each kind (with ``k``) that has any: its hits, windows shared with other kinds of its anchor, as ways to the anchor."""
    contexts = work.keep(scan_contexts(docs, kinds.where("k > 1"), units, window), "contexts", few=True)
    rows = contexts.where(F.col("k") <= most).withColumns({"near": F.col("gap") - F.col("span"), "far": F.col("gap"), "key": F.col("anchor")})
    hits = pair_hits(rows, units, window, directed)
    large = contexts.where(F.col("k") > most)
    if not large.isEmpty():
        hits = hits.unionByName(_large_hits(work, large, units, window, directed, most, block))
    return hits.groupBy(F.col("key").alias("anchor"), "c1", "c2").agg(F.collect_set(F.struct("near", "far")).alias("hits"))


def find_repeats(work: Workspace, docs: DataFrame, segments: DataFrame, kinds: DataFrame, units: Units, window: int, directed: bool, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """doc_id, text, and ``hits``: first and last windows of runs that repeat.

    ``kinds`` come from ``in_groups``.  ``directed``: a window counts if it stands under
    a smaller id; else if it stands anywhere else.
    """
    hits = find_hits(work, docs, kinds, units, window, directed, most, block)
    known = kinds.join(hits, KIND, "left").where("n > 1 or hits is not null").select(*KIND, "n", "d", "hits")
    # a plain table: the segments of a frequent kind can be split in the join
    met = segments.join(work.keep(known, "known", few=True), KIND)
    whole = own_id() > F.col("d") if directed else F.col("n") > 1
    place = F.col("first") + F.col("gap")
    runs = F.transform("hits", lambda h: F.struct((place - h["far"]).alias("first"), (place - h["near"]).alias("last")))
    found = met.select("doc_id", "version", F.when(whole, F.array(F.struct("first", "last"))).otherwise(runs).alias("hits")).where("hits is not null")
    lists = found.groupBy(own_id().alias("d"), F.col("version").alias("v")).agg(F.flatten(F.collect_list("hits")).alias("hits"))
    none = F.array().cast("array<struct<first:int,last:int>>")
    met = docs.join(lists.hint("merge"), (docs["version"] == F.col("v")) & (F.coalesce(docs["doc_id"], F.lit(NO_ID)) == F.col("d")), "left")
    return work.gathered(met.select("doc_id", "text", F.coalesce("hits", none).alias("hits")))


def covered_units(hits: pa.Array, cuts: np.ndarray, n: int, window: int) -> np.ndarray:
    """Which of n units the hits of consecutive texts cover."""
    spans = hits.flatten()
    base = np.repeat(cuts[:-1], hits.value_lengths().to_numpy())
    first, last = (spans.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
    delta = np.bincount(base + first, minlength=n + 1)[: n + 1] - np.bincount(base + last + window, minlength=n + 1)[: n + 1]
    return np.cumsum(delta[:n]) > 0
