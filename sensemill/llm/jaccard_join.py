"""N-gram Jaccard join by grouped prefixes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel as K
from .components import components
from .shared import Workspace, documents, fields, maybe_needed

SHINGLE = 3
#: Two sets link when their Jaccard similarity is PERCENT / 100 or more.
PERCENT = 90
#: Cells of the frequency sketch that orders shingles: bounded, whatever the corpus.
SKETCH_BITS = 18
#: One shingle in so many is ranked by frequency and comes before all others; a prefix rarely needs more.
RANKED = 4
BITMAP = 512
#: A row with more partners than this narrows them by the bitmap's first words before it looks at whole bitmaps.
MANY = 64
HEAD_WORDS = 4
#: Documents of one block of a token; a larger token's documents are compared block by block.
BLOCK = 2048

SETS = fields(doc_id="long", version="long", n="int", f1="long", f2="long", prefix="array<long>", bitmap="binary", wide="binary")
PAIRS = fields(u="long", v="long", d="int")
EDGES = fields(u="long", v="long")


def shingle_sets(buf: np.ndarray, off: np.ndarray, shingle: int) -> Iterator[np.ndarray]:
    """Each text's distinct shingles, sorted; a text of fewer words is one shingle."""
    start, end, cuts = K.word_spans(buf, off)
    roll = K.Rolling(K.word_values(buf, start, end, lower=True), 0)
    grams = roll.every(shingle)
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if hi - lo >= shingle:
            yield np.unique(grams[lo : hi - shingle + 1])
        elif hi > lo:
            yield roll.of(np.array([lo]), np.array([hi]))
        else:
            yield np.empty(0, np.uint64)


def _cell(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _ranked(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(RANKED - 1)) == 0


def prefix_of(s: np.ndarray, rarity: np.ndarray, p: int) -> np.ndarray:
    """The first p shingles of a set in the global order: ranked ones by frequency, then the rest, ties by value."""
    first = _ranked(s)
    ranked = s[first]
    ranked = ranked[np.lexsort((ranked, rarity[_cell(ranked)]))]
    return ranked[:p] if len(ranked) >= p else np.concatenate([ranked, s[~first][: p - len(ranked)]])


def frequency_sketch(docs: DataFrame, shingle: int) -> np.ndarray:
    """How many documents' ranked shingles fall into each cell; 2**SKETCH_BITS numbers reach the driver."""
    schema = fields(cell="int", n="long")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            for *_, buf, off in K.runs(batch.column(1)):
                every = np.concatenate([*shingle_sets(buf, off, shingle)])
                np.add.at(total, _cell(every[_ranked(every)]), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=schema.names)

    got = docs.select("doc_id", "text").mapInArrow(count, schema).groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << SKETCH_BITS, np.int64)
    out[got["cell"].to_numpy()] = got["n"].to_numpy()
    return out


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def parity_bitmap(s: np.ndarray, bits: int) -> bytes:
    """Bit k tells whether an odd number of members end in k; two sets' bitmaps differ in no more bits than the sets in members."""
    return np.packbits((np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def differing_bits(a: bytes, b: bytes) -> int:
    """Bits in which two parity bitmaps differ; the longer one is folded to the length of the other."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    size = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(z.reshape(-1, size), axis=0) for z in (x, y))
    return int(np.bitwise_count(x ^ y).sum(dtype=np.int64))


def _describe(spark: SparkSession, docs: DataFrame, sketch: np.ndarray, shingle: int, percent: int) -> DataFrame:
    """Per row: set size, fingerprints of the set, its prefix (rarest shingles first) and its parity bitmap."""
    shared = spark.sparkContext.broadcast(sketch)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarity = shared.value
        for batch in batches:
            for i, j, buf, off in K.runs(batch.column(1)):
                size, f1, f2, prefixes, bitmaps, wide = [], [], [], [], [], []
                for s in shingle_sets(buf, off, shingle):
                    p = prefix_length(len(s), percent) if len(s) else 0
                    prefixes.append(prefix_of(s, rarity, p))
                    size.append(len(s))
                    f1.append(int(K.mix(s).sum()) if len(s) else 0)
                    f2.append(int(K.mix(s ^ np.uint64(K.BASE[1])).sum()) if len(s) else 0)
                    bitmaps.append(parity_bitmap(s, BITMAP))
                    wide.append(parity_bitmap(s, 1 << len(s).bit_length()) if len(s) > BITMAP else None)
                prefix = K.list_array(K.as_signed(np.concatenate(prefixes)), np.array([len(p) for p in prefixes]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array(size, pa.int32()), *(pa.array(K.as_signed(np.array(f, np.uint64))) for f in (f1, f2)), prefix, pa.array(bitmaps, pa.binary()), pa.array(wide, pa.binary())],
                    names=SETS.names,
                )

    return docs.select("doc_id", "text", "version").mapInArrow(scan, SETS)


# -------------------------------------------------------------- pairs of a cell


def _narrowed(heads: np.ndarray, i: int, j: np.ndarray, most: int) -> np.ndarray:
    """Those of j whose first bitmap words differ from i's in at most so many bits; exact, as whole bitmaps differ in no fewer."""
    differ = np.zeros(len(j), np.int64)
    for word in heads:
        differ = differ + np.bitwise_count(word[j] ^ word[i])
        near = differ <= most
        j, differ = j[near], differ[near]
    return j


def _passing(n: np.ndarray, pos: np.ndarray, group: np.ndarray, bits: np.ndarray, block: np.ndarray, cross: bool, apart: np.ndarray | None, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (i, j, distance) of rows sorted by size and group that no filter rules out.

    Size and position are tested on groups (equal prefix and size); pairs of groups
    that pass are expanded to members, whose bitmaps must differ in few enough bits.
    """
    m = len(n)
    heads = np.ascontiguousarray(bits[:, :HEAD_WORDS].T)
    lead = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (n[1:] != n[:-1])]))
    stop = np.append(lead[1:], m)
    gn, gp = n[lead], pos[lead]
    limit = np.searchsorted(gn, gn * 100 // percent, side="right")
    out = []
    for a in range(len(lead)):
        b = np.arange(a, limit[a])
        need = -(-percent * (gn[a] + gn[b]) // (100 + percent))
        most = 1 + np.minimum(gp[a], gp[b]) + np.minimum(gn[a] - gp[a], gn[b] - gp[b]) - 1
        b = b[most >= need]
        if not len(b):
            continue
        lengths = stop[b] - lead[b]
        columns = np.repeat(lead[b] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
        for i in range(lead[a], stop[a]):
            j = columns[np.searchsorted(columns, i, side="right") :]
            if cross:
                j = j[block[j] != block[i]]
            if apart is not None:
                j = j[apart[j] != apart[i]]
            if len(j) > MANY:
                j = _narrowed(heads, i, j, (n[i] + n[j[-1]]) * (100 - percent) // (100 + percent))
            if not len(j):
                continue
            differ = np.bitwise_count(bits[j] ^ bits[i]).sum(axis=1, dtype=np.int32)
            both = n[i] + n[j]
            ok = differ <= both - 2 * -(-percent * both // (100 + percent))
            if ok.any():
                out.append((np.full(int(ok.sum()), i), j[ok], differ[ok]))
    if not out:
        return (np.empty(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def spanning_pairs(m: int, i: np.ndarray, j: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Indexes of pairs that form a minimum spanning forest (Boruvka's rounds)."""
    if len(i) == 1:
        return np.zeros(1, np.int64)
    order = np.argsort(d, kind="stable")
    label, chosen = np.arange(m), []
    while len(order):
        a, b = label[i[order]], label[j[order]]
        order, a, b = order[a != b], a[a != b], b[a != b]
        if not len(order):
            break
        ends = np.concatenate([a, b])
        _, at = np.unique(ends, return_index=True) if len(order) == 1 else _first_of_each(a, b)
        at = np.unique(at % len(order))
        for k in at.tolist():
            x, y = int(i[order[k]]), int(j[order[k]])
            while label[x] != x:
                x = int(label[x])
            while label[y] != y:
                y = int(label[y])
            if x != y:
                label[max(x, y)] = min(x, y)
                chosen.append(order[k])
        while (label[label] != label).any():
            label = label[label]
    return np.array(chosen, np.int64)


def _first_of_each(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every label the first pair that has it at either end."""
    n = len(a)
    ends, place = np.concatenate([a, b]), np.concatenate([np.arange(n), np.arange(n)])
    order = np.lexsort((place, ends))
    ends, place = ends[order], place[order]
    first = np.concatenate([[True], ends[1:] != ends[:-1]])
    return ends[first], place[first]


def _columns(table: pa.Table) -> dict[str, np.ndarray]:
    out = {k: table[k].to_numpy() for k in ("token", "one", "two", "node", "n", "pos", "grp", "block", "comp")}
    out |= {k: out[k].astype(np.int64) for k in ("n", "pos")}
    out["bits"] = np.frombuffer(b"".join(table["bitmap"].to_pylist()), np.uint64).reshape(len(table), BITMAP // 64)
    return out


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """Columns of each cell of two rows or more in turn; input is sorted by token, one and two."""
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table]).combine_chunks()
        if not len(table):
            continue
        columns = _columns(table)
        new = np.flatnonzero(np.any([columns[k][1:] != columns[k][:-1] for k in ("token", "one", "two")], axis=0)) + 1
        edges = [0, *new.tolist()]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            if hi - lo > 1:
                yield {k: c[lo:hi] for k, c in columns.items()}
        rest = table.slice(edges[-1])
    if rest is not None and len(rest) > 1:
        yield _columns(rest)


def _pairs(percent: int, forest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(p)) for p in zip(*parts, strict=True)], names=PAIRS.names)

        for cell in _cells(batches):
            node, comp = cell["node"], cell["comp"]
            if not forest and (comp == comp[0]).all():
                continue
            cross = bool(cell["one"][0] != cell["two"][0])
            i, j, d = _passing(cell["n"], cell["pos"], cell["grp"], cell["bits"], cell["block"], cross, None if forest else comp, percent)
            if forest and len(i):
                k = spanning_pairs(len(node), i, j, d)
                i, j, d = i[k], j[k], d[k]
            if len(i):
                parts.append((np.minimum(node[i], node[j]), np.maximum(node[i], node[j]), d.astype(np.int32)))
                held += len(i)
                if held > 1 << 18:
                    yield flush()
                    parts, held = [], 0
        if parts:
            yield flush()

    return run


def _candidates(hits: DataFrame, kinds: DataFrame, percent: int, forest: bool) -> DataFrame:
    """Distinct pairs of kinds that share a prefix token and pass all filters.

    ``hits`` has node, token, pos, blocks (of the token) and comp.  A token with one
    block is one cell; with more, every pair of its blocks is a cell.
    """
    rows = hits.join(kinds.select("node", "n", "grp", "bitmap"), "node")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node", "token"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumns({"one": F.least("block", F.col("other").cast("int")), "two": F.greatest("block", F.col("other").cast("int"))}).drop("other", "blocks")
    # a stated count: adaptive merging goes by bytes, and here a few bytes make much work
    tasks = int(hits.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(tasks, "token", "one", "two").sortWithinPartitions("token", "one", "two", "n", "grp", "node")
    return rows.mapInArrow(_pairs(percent, forest), PAIRS).groupBy("u", "v").agg(F.min("d").alias("d"))


def _narrow_long(pairs: DataFrame, kinds: DataFrame, percent: int) -> DataFrame:
    """Pairs without those of two long sets whose wide bitmaps differ in too many bits.

    BITMAP bits are full for sets far larger than that and rule nothing out; wide ones
    grow with the set.  Exact: no pair that is similar enough goes.
    """

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for n, a, m, b in zip(*(batch.column(k).to_pylist() for k in range(3, 7)), strict=True):
                keep.append(a is None or b is None or differing_bits(a, b) <= n + m - 2 * -(-percent * (n + m) // (100 + percent)))
            yield batch.select([0, 1, 2]).filter(pa.array(keep, pa.bool_()))

    long = kinds.where("wide is not null")
    met = pairs
    for end, size, bits in (("u", "n1", "w1"), ("v", "n2", "w2")):
        met = met.join(long.select(F.col("node").alias(end), F.col("n").alias(size), F.col("wide").alias(bits)), end, "left")
    return met.select("u", "v", "d", "n1", "w1", "n2", "w2").mapInArrow(check, PAIRS)


def _verified(work: Workspace, docs: DataFrame, kinds: DataFrame, pairs: DataFrame, shingle: int, percent: int, name: str) -> DataFrame:
    """The pairs whose sets really are similar enough."""
    schema = fields(node="long", members="binary")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, off in K.runs(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([s.tobytes() for s in shingle_sets(buf, off, shingle)], pa.binary())], names=schema.names)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (a, b))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))  # u, v

    needed = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
    needed = needed.join(kinds.select("node", "lead"), "node").select("node", F.col("lead.d").alias("d"), F.col("lead.v").alias("v"))
    texts = maybe_needed(docs, needed).join(needed.hint("merge"), (F.col("version") == F.col("v")) & (F.coalesce("doc_id", F.lit(2**63 - 1)) == F.col("d")))
    # repeated rows stand together after the join, so this needs no exchange
    texts = texts.dropDuplicates(["v", "d"]).select("node", "text")
    members = work.keep(texts.mapInArrow(sets, schema), f"{name}-members", few=True)
    met = pairs.join(members.select(F.col("node").alias("u"), F.col("members").alias("a")), "u").join(members.select(F.col("node").alias("v"), F.col("members").alias("b")), "v")
    edges = work.keep(met.select("u", "v", "a", "b").mapInArrow(check, EDGES), f"{name}-edges", few=True)
    work.drop(f"{name}-members")
    return edges


class Links:
    """Verified links so far and the components they make."""

    def __init__(self, work: Workspace, docs: DataFrame, kinds: DataFrame, shingle: int, percent: int):
        self.work, self.docs, self.kinds, self.shingle, self.percent = work, docs, kinds, shingle, percent
        self.steps = 0
        self.edges: DataFrame | None = None
        self.tried: DataFrame | None = None
        self.roots = kinds.select("node", F.col("node").alias("root")).limit(0)

    def _apart(self, pairs: DataFrame) -> DataFrame:
        """Pairs not tried whose ends are in different components yet, with these."""
        if self.tried is None:
            return pairs.withColumns({"a": F.col("u"), "b": F.col("v")})
        pairs = pairs.join(self.tried, ["u", "v"], "left_anti")
        for end, name in (("u", "a"), ("v", "b")):
            roots = self.roots.select(F.col("node").alias(end), F.col("root").alias(name))
            pairs = pairs.join(roots, end, "left").withColumn(name, F.coalesce(name, end))
        return pairs.where("a <> b")

    def try_pairs(self, pairs: DataFrame, rounds: int) -> None:
        """Verify pairs until no untried one joins two components.

        In the first rounds each component tries its nearest partner only: most others
        are then inside a component and need no look.
        """
        for r in range(rounds + 1):
            rest = self._apart(pairs)
            if self.tried is not None:
                rest = self.work.keep(rest, f"apart-{self.steps}", few=True)
            if rest.isEmpty():
                return
            if r < rounds:
                ends = rest.select(F.col("a").alias("c"), "u", "v", "d").unionByName(rest.select(F.col("b").alias("c"), "u", "v", "d"))
                chosen = ends.groupBy("c").agg(F.min(F.struct("d", "u", "v")).alias("p")).select("p.u", "p.v").distinct()
            else:
                chosen = rest.select("u", "v")
            chosen = self.work.keep(chosen, f"chosen-{self.steps}", few=True)
            edges = _verified(self.work, self.docs, self.kinds, chosen, self.shingle, self.percent, f"step-{self.steps}")
            self.edges = edges if self.edges is None else self.edges.unionByName(edges)
            self.tried = chosen if self.tried is None else self.tried.unionByName(chosen)
            self.roots = components(self.work, self.edges, f"components-{self.steps}")
            self.steps += 1


def jaccard_components(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """Connected components of documents linked by the similarity of their shingle sets.

    Sets hold the distinct ``shingle``-word sequences, A-Z lower-cased; a text with
    fewer words is one sequence.  Two documents link when the Jaccard similarity is
    ``percent`` or more; those without words link with nothing.

    Documents of equal sets are one kind.  Each kind's prefix holds so many of its
    rarest shingles that similar sets must share one; the order comes from a sketch
    of bounded size.  For each shared token, kinds of equal prefix and size form a
    group; pairs of groups are filtered by size and position and expanded to
    members.  Of the pairs that pass, spanning forests are verified first, nearest
    partners before others, then all pairs between components that are still apart,
    so no link is lost and no group is written out pair by pair.

    Returns doc_id, version, n_shingles, component_id (smallest id reachable).  Null
    texts are empty; null ids count as larger than all others (a component of such
    alone has a null id); repeated rows are documents of their own.  Very long texts
    are read whole, with memory in proportion to the longest one.
    """
    work = Workspace(spark, "jaccard-join", docs)
    read = documents(docs, id_col, text_col).withColumn("version", F.xxhash64(F.coalesce("text", F.lit(""))))
    known = work.keep(_describe(spark, read, frequency_sketch(read, shingle), shingle, percent), "sets", few=True)
    kind = ["f1", "f2", "n"]  # 128 bits and the size tell sets apart; a written number stands for them from here on
    lead = F.min(F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("d"), F.col("version").alias("v"))).alias("lead")
    kinds = known.where("n > 0").groupBy(*kind).agg(lead, *(F.first(c).alias(c) for c in ("prefix", "bitmap", "wide")))
    kinds = work.keep(kinds.withColumns({"grp": F.xxhash64("n", "prefix"), "node": F.monotonically_increasing_id()}), "kinds", few=True)

    tokens = kinds.select("node", F.posexplode("prefix").alias("pos", "token"))
    common = tokens.groupBy("token").agg(F.count("*").alias("n")).where("n > 1").select("token", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    hits = work.keep(tokens.join(common, "token"), "hits", few=True)
    links = Links(work, read, kinds, shingle, percent)
    links.try_pairs(work.keep(_narrow_long(_candidates(hits.withColumn("comp", F.col("node")), kinds, percent, True), kinds, percent), "pairs-1", few=True), 1)

    placed = hits.join(links.roots, "node", "left").select("node", "token", "pos", "blocks", F.coalesce("root", "node").alias("comp"))
    split = placed.groupBy("token").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a < b").select("token")
    placed = placed.join(split, "token")
    links.try_pairs(work.keep(_narrow_long(_candidates(placed, kinds, percent, False), kinds, percent), "pairs-2", few=True), 0)
    roots = links.roots

    named = kinds.select("node", *kind, F.col("lead.d").alias("d")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("d").alias("least"))
    # a plain table: the rows of a frequent kind can be split in the join
    named = work.keep(named.join(least, "root").select(*kind, F.nullif(F.col("least"), F.lit(2**63 - 1)).alias("least"), F.lit(True).alias("linked")), "named", few=True)
    out = known.select("doc_id", "version", *kind).join(named, kind, "left")
    return work.gathered(out).select("doc_id", "version", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("linked"), F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of one document of each component, that with the smallest id, with all their columns.

    Documents without words (null, empty and blank texts) link with nothing and stay.
    Rows that repeat the kept id and text all stay; columns may have any names.
    """
    found = jaccard_components(spark, docs, id_col, text_col, shingle, percent)
    mark = uuid.uuid4().hex
    d, v = f"d_{mark}", f"v_{mark}"
    keep = found.where("n_shingles = 0 or doc_id <=> component_id").select(F.col("doc_id").alias(d), F.col("version").alias(v)).distinct()
    keep = Workspace(spark, "keep-one", docs).keep(keep, "kept", few=True)
    mine = F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit("")))
    return docs.join(keep.hint("shuffle_hash"), docs[id_col].cast("long").eqNullSafe(F.col(d)) & (mine == F.col(v)), "left_semi")
