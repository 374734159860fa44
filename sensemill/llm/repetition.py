"""Quality rules from a suffix array over the words of each text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernel as K
from .shared import documents, fields

#: A maximal repeated substring counts from so many words; lines that return in good labelled texts are shorter (13 words at most on 10,000 documents).
MIN_REPEAT = 15
#: Share of words, in percent, that maximal repeats may cover.
MAX_COVERED_PERCENT = 10
#: Longest repeat, in words, that a kept text may have.
MAX_LONGEST = 50

SCHEMA = fields(doc_id="long", n_words="long", word_chars="long", n_symbols="long", n_dup_lines="long", n_repeat_words="long", n_covered_words="long", longest_repeat="long", base_failed="boolean", kept="boolean")

_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1


def suffix_repeats(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """For each word, the longest run of words from it that stands elsewhere in its text too.

    One suffix array over all texts of a run, by prefix doubling; a text's number
    leads each suffix's key, so suffixes of different texts never meet.  Only
    suffixes that are still tied are sorted again.  Neighbours' common prefixes
    are found by doubling steps over fingerprints, so only a few numbers a word are
    held, however long a repeat is.  The result is the depth of the deepest
    longest-common-prefix interval that holds the suffix.
    """
    n = len(values)
    best = np.zeros(n, np.int64)
    if n < 2:
        return best
    text = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
    last = cuts[1:][text]
    _, code = np.unique(values, return_inverse=True)
    key = text * (int(code.max()) + 1) + code
    order = np.argsort(key, kind="stable")

    rank = np.zeros(n + 1, np.int64)

    def regroup(pos: np.ndarray, keys: np.ndarray, base: np.ndarray) -> np.ndarray:
        """Give sorted positions the index of their group's first member; those still tied."""
        new = np.ones(len(pos), bool)
        new[1:] = keys[1:] != keys[:-1]
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(pos)))
        rank[pos] = np.repeat(base[first], size)
        return pos[np.repeat(size > 1, size)]

    active = regroup(order, key[order], np.arange(1, n + 1))
    one, h = rank.copy(), 1
    while len(active):
        ahead = active + h
        second = np.where(ahead < last[active], rank[np.minimum(ahead, n)], 0)
        key = rank[active] * (n + 2) + second
        order = np.argsort(key, kind="stable")
        active, key = active[order], key[order]
        # members of a group stand together; each keeps the group's first index plus its place
        lead = rank[active]
        fresh = np.ones(len(active), bool)
        fresh[1:] = lead[1:] != lead[:-1]
        begin = np.flatnonzero(fresh)
        place = np.arange(len(active)) - np.repeat(begin, np.diff(np.append(begin, len(active))))
        active = regroup(active, key, lead + place)
        h *= 2

    suffix = np.empty(n, np.int64)
    suffix[rank[:n] - 1] = np.arange(n)
    near = np.flatnonzero(one[suffix[:-1]] == one[suffix[1:]])
    a, b = suffix[near].copy(), suffix[near + 1].copy()
    stop = np.minimum(last[a] - a, last[b] - b)  # past the end of a text nothing is in common
    common = np.zeros(len(near), np.int64)
    roll = K.Rolling(values, 0)
    while h:
        fits = np.flatnonzero(common + h <= stop)
        x, y = a[fits] + common[fits], b[fits] + common[fits]
        common[fits] += h * (roll.of(x, x + h) == roll.of(y, y + h))
        h //= 2
    np.maximum.at(best, suffix[near], common)
    np.maximum.at(best, suffix[near + 1], common)
    return best


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n units lie in any of the spans."""
    delta = np.zeros(n + 1, np.int64)
    np.add.at(delta, starts, 1)
    np.add.at(delta, starts + lengths, -1)
    return np.cumsum(delta[:n]) > 0


def _sums(x: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    total = np.zeros(len(x) + 1, np.int64)
    np.cumsum(x, out=total[1:])
    return total[cuts[1:]] - total[cuts[:-1]]


def _repeated_lines(buf: bytes, off: list[int]) -> list[int]:
    out = []
    for i, j in zip(off[:-1], off[1:], strict=True):
        lines = [x for x in buf[i:j].split(b"\n") if x.strip()]
        out.append(len(lines) - len(set(lines)))
    return out


def measures(buf: np.ndarray, off: np.ndarray, min_repeat: int) -> dict[str, np.ndarray]:
    start, end, cuts = K.word_spans(buf, off)
    best = suffix_repeats(K.word_values(buf, start, end), cuts)
    n = len(start)
    fives = np.flatnonzero(best >= 5)
    long = np.flatnonzero(best >= min_repeat)
    longest = np.zeros(len(off) - 1, np.int64)
    np.maximum.at(longest, np.searchsorted(cuts, np.arange(n), side="right") - 1, best) if n else None
    chars = (buf & 0xC0) != 0x80
    return {
        "n_words": np.diff(cuts),
        "word_chars": _sums(chars & K.WORD_SPACE[buf], off),
        "n_symbols": _sums(_SYMBOL[buf], off),
        "n_dup_lines": np.array(_repeated_lines(buf.tobytes(), off.tolist()), np.int64),
        "n_repeat_words": _sums(covered(fives, np.full(len(fives), 5), n), cuts),
        "n_covered_words": _sums(covered(long, best[long], n), cuts),
        "longest_repeat": longest,
    }


def repetition_quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_repeat: int = MIN_REPEAT, max_covered_percent: int = MAX_COVERED_PERCENT, max_longest: int = MAX_LONGEST) -> DataFrame:
    """Counts and a verdict for each row: is it free of heavy repetition?

    Words are runs of characters other than blank and 09-0D.  ``n_repeat_words``
    counts words in 5-word windows that stand twice or more in the text;
    ``n_covered_words`` those in maximal repeats of ``min_repeat`` words or more,
    ``longest_repeat`` the longest repeat.  ``base_failed``: under 10 words, or over
    20 % repeated words.  ``kept``: not failed, covered share and longest repeat
    within the limits.

    Null and empty texts have no words and fail.  Rows with equal ids are judged
    each on its own; a null id stays null; other columns don't matter.  A very long
    text is judged whole, with memory in proportion to it.  No exchange.
    """

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, off in K.runs(batch.column(1)):
                m = measures(buf, off, min_repeat)
                failed = (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])
                kept = ~failed & (100 * m["n_covered_words"] <= max_covered_percent * m["n_words"]) & (m["longest_repeat"] <= max_longest)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *(pa.array(m[k]) for k in SCHEMA.names[1:-2]), pa.array(failed), pa.array(kept)], names=SCHEMA.names)

    return documents(df, id_col, text_col).mapInArrow(judge, SCHEMA)
