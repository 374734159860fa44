"""Substring dedup by seed and extend: what a document repeats from one with a smaller id is removed."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import kernel as K
from . import extend as X
from .shared import Workspace, documents, fields

WINDOW = 50
#: Words of an anchor; one is chosen in each WINDOW words.
SEED = 12

KEPT = fields(doc_id="long", n_words="long", n_removed="long", kept_sha256="string", kept_text="string")


def remove_repeats(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, seed: int = SEED, keep_text: bool = True, most: int = X.MOST) -> DataFrame:
    """Remove words that windows shared with a document of smaller id cover.

    Seeds are winnowed word n-grams, one in every window.  Documents are joined on
    them; what surrounds a shared seed is extended word by word both ways, and maximal
    repeats of ``window`` words or more count (see ``extend``: equal surroundings are
    one kind, and crowded seeds are parted by longer ones first, so hot passages
    neither meet in one task nor pair by pair).  Windows are judged on the input.

    Returns doc_id, n_words, n_removed, kept_sha256 and kept_text (kept words joined
    by blanks; null unless ``keep_text``).  Null and empty texts have no words.  Null
    ids count as larger than all others and not as different from each other; rows
    with equal ids don't repeat from one another.  Very long texts are scanned whole,
    with memory in proportion to the longest one.
    """
    work = Workspace(spark, "seed-extend", docs)
    read = X.versioned(documents(docs, id_col, text_col))
    table = work.keep(X.scan_segments(read, X.WORDS, window, seed), "segments", few=True)
    kinds = work.keep(X.in_groups(X.kinds_of(table)), "kinds", few=True)
    found = X.find_repeats(work, read, table, kinds, X.WORDS, window, directed=True, most=most)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, off in K.runs(batch.column(1)):
                start, end, cuts = K.word_spans(buf, off)
                gone = X.covered_units(batch.column(2).slice(i, j - i), cuts, len(start), window)
                total = np.concatenate([[0], np.cumsum(gone)])
                # kept words, each followed by a blank, in one buffer
                keep = ~gone
                delta = np.zeros(len(buf) + 1, np.int64)
                delta[start[keep]] += 1
                delta[end[keep]] -= 1
                inside = np.cumsum(delta[:-1]) > 0
                length = np.where(keep, end - start + 1, 0)
                place = np.concatenate([[0], np.cumsum(length)])
                out = np.full(place[-1], 0x20, np.uint8)
                if len(start):
                    mark = np.ones(place[-1], bool)
                    mark[place[1:][keep] - 1] = False
                    out[mark] = buf[inside]
                data = out.tobytes()
                texts = [data[a : max(a, b - 1)] for a, b in zip(place[cuts[:-1]].tolist(), place[cuts[1:]].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i),
                        pa.array(np.diff(cuts)),
                        pa.array(total[cuts[1:]] - total[cuts[:-1]]),
                        pa.array([hashlib.sha256(t).hexdigest() for t in texts]),
                        pa.array([t.decode() for t in texts], pa.string()) if keep_text else pa.nulls(j - i, pa.string()),
                    ],
                    names=KEPT.names,
                )

    return found.mapInArrow(cut, KEPT)
