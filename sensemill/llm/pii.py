"""Personal data, also where it is disguised, found at its offsets in the source text.

Transducers rewrite a text step by step (look-alike characters, spelled digits,
"at" and "dot" in words) and keep for every character the span of the source
that it came from.  The plain detectors then run on the rewritten text, and what
they find is mapped back.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import re
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import documents, fields

KINDS = ("email", "ip", "card", "phone")
SCHEMA = fields(doc_id="long", n_email="long", n_ip="long", n_card="long", n_phone="long", base_sha256="string", spans="string", n_disguised="long")

Span = tuple[str, int, int]

# ------------------------------------------------------------ plain detectors

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: Figures joined by dots, whole; addresses are cut from these, so long runs of digits are read once.
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def detect(text: str) -> list[Span]:
    """Spans of the plain rules, by start, then by kind in the order of KINDS."""
    out: list[Span] = [("email", s, e) for s, e in _emails(text)] if "@" in text else []
    for m in _CARD.finditer(text):
        digits = re.sub(r"[^0-9]", "", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    for m in (m for chain in _DOTTED.finditer(text) if chain[0].count(".") >= 3 for m in _IP.finditer(text, chain.start(), chain.end())):
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in (p.lstrip("0") for p in m[0].split("."))):
            out.append(("ip", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", m.start(), m.end()))
    out.sort(key=lambda x: (x[1], KINDS.index(x[0])))
    return out


# ---------------------------------------------------------------- transducers

# Letters of other alphabets that look like Latin ones.
LOOK_ALIKES = {
    "а": "a", "в": "b", "с": "c", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "У": "Y", "Х": "X",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "χ": "x",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "ո": "n", "օ": "o", "ս": "u", "հ": "h", "ɡ": "g", "ı": "i",
    "。": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", " ": " ",
}

# Digits spelled in English, German, French and Spanish.
SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
# Words for the signs @ . + in these languages.
AT_WORDS, DOT_WORDS, PLUS_WORDS = ("at", "ät", "arobase", "arroba"), ("dot", "punkt", "point", "punto"), ("plus", "más")

_WORD, _DOT, _AT, _PLUS = ("|".join(w) for w in (SPELLED, DOT_WORDS, AT_WORDS, PLUS_WORDS))
#: At least four spelled digits in a row, single figures among them allowed.
_SPELLED_RUN = re.compile(rf"(?i)\b(?:(?:{_PLUS})[ -]+)?(?:(?:{_WORD})|[0-9])(?:[ .,-]*[ .,-](?:{_WORD}|[0-9]|{_DOT})\b){{3,}}")
_SPELLED_TOKEN = re.compile(rf"(?i)(?:{_PLUS}|{_WORD}|{_DOT}|[0-9])\b")
#: A sign in brackets; blanks around it go too.
_BRACKETED = re.compile(rf"(?i)[\[({{<]\s*(?:(?P<at>{_AT}|@)|{_DOT}|\.)\s*[\])}}>]")
# Last labels that an address spelled in bare words may end with.
BARE_ENDS = ("com", "org", "net", "edu", "gov", "info", "biz", "io", "co", "eu", "uk", "de", "fr", "es", "it", "nl", "us", "ca", "au", "jp", "ru", "ch", "at", "be", "se")

# Words that begin no host before an unknown last label, and words that are none.
_NO_HOST = "a|an|the|this|that|these|those|each|every|any|some|one|no|its|his|her|their|our|your|my|which|what"
_NO_END = "and|or|on|of|the|an|for|with|from|that|this|these|those|was|were|are|has|had|have|but|not|than|then|into|onto|over|under|near|which|who|when|where|while|one|two"

_MORE = rf"(?:\s+(?:{_DOT})\s+|\.)"
_END = rf"(?!(?:{_NO_END})\b)[a-z]{{2,}}+(?![a-z0-9_-])"
_LABELS = rf"[a-z0-9-]++(?:{_MORE}[a-z0-9-]++)*?"
#: Labels joined by dots, spelled or not: every text is one sequence of these, so each is read once as a name.
_CHAIN = re.compile(rf"(?i)[a-z0-9_%+-]++(?:{_MORE}[a-z0-9_%+-]++)*+")
_NAMELIKE = re.compile(rf"(?i)[0-9_%+]|{_MORE}")
_BARE_AT = re.compile(rf"(?i)(?P<word>\s+(?:{_AT})\s+)|@")
#: Bare words count only together: "name at host dot label", the label of letters, and the
#: host's first word and the label no common words of prose unless the label is a known end.
_SPELLED_HOST = re.compile(rf"(?i)(?:{_LABELS}\s+(?:{_DOT})\s+(?:{'|'.join(BARE_ENDS)})\b|(?!(?:{_NO_HOST})\b){_LABELS}\s+(?:{_DOT})\s+{_END})(?:{_MORE}{_END})*")
#: A spelled "at" alone counts before a dotted host, behind a name that is no mere word: one
#: with a letter and a dot (spelled or not), underscore, per cent sign, plus or figure.
_PLAIN_HOST = re.compile(rf"(?i)[a-z0-9-]++(?:\.[a-z0-9-]++)*?\.{_END}(?:{_MORE}{_END})*")
#: What every address in bare words holds.
_BARE_CORE = re.compile(rf"(?i)\s(?:{_DOT})\s|\s(?:{_AT})\s+[a-z0-9-]+\.[a-z0-9-]")
_BARE_TOKEN = re.compile(rf"(?i)\s+(?:(?P<at>{_AT})|{_DOT})\s+")


def _bare_addresses(text: str) -> Iterator[tuple[int, int]]:
    """Spans of addresses in bare words; a chain is read as a name once and as a host once."""
    done = 0
    while chain := _CHAIN.search(text, done):
        done = chain.end()
        at = _BARE_AT.match(text, done)
        if not at:
            continue
        host = _SPELLED_HOST.match(text, at.end())
        if not host and at["word"] and any(c.isalpha() for c in chain[0]) and _NAMELIKE.search(chain[0]):
            host = _PLAIN_HOST.match(text, at.end())
        if host:
            yield chain.start(), host.end()
            done = host.end()


class Aligned:
    """A rewritten text; each character knows its source span and whether it was rewritten."""

    def __init__(self, text: str):
        self.text, self.start, self.end, self.changed = text, list(range(len(text))), list(range(1, len(text) + 1)), [False] * len(text)

    def rewrite(self, edits: Iterable[tuple[int, int, str]]) -> None:
        """Replace ranges, given in order and apart, each by one character or none."""
        text, start, end, changed, at = [], [], [], [], 0
        for s, e, new in edits:
            text.append(self.text[at:s])
            start += self.start[at:s]
            end += self.end[at:s]
            changed += self.changed[at:s]
            if new:
                text.append(new)
                start.append(self.start[s])
                end.append(self.end[e - 1])
                changed.append(True)
            at = e
        if at:
            self.text = "".join([*text, self.text[at:]])
            self.start, self.end, self.changed = start + self.start[at:], end + self.end[at:], changed + self.changed[at:]


@functools.cache
def plain_character(c: str) -> str:
    """The ASCII character that a look-alike stands for; empty for invisible ones; else itself."""
    if c in LOOK_ALIKES:
        return LOOK_ALIKES[c]
    if unicodedata.category(c) == "Cf":
        return ""
    digit = unicodedata.decimal(c, None)
    if digit is not None:
        return str(digit)
    folded = unicodedata.normalize("NFKC", c)
    return folded if len(folded) == 1 and folded.isascii() else c


def _look_alikes(a: Aligned) -> Iterator[tuple[int, int, str]]:
    for m in re.finditer(r"[^\x00-\x7f]", a.text):
        if (new := plain_character(m[0])) != m[0]:
            yield m.start(), m.end(), new


def _digits(a: Aligned) -> Iterator[tuple[int, int, str]]:
    for run in _SPELLED_RUN.finditer(a.text):
        at = run.start()
        for m in _SPELLED_TOKEN.finditer(a.text, run.start(), run.end()):
            word = m[0].lower()
            new = "+" if word in PLUS_WORDS else "." if word in DOT_WORDS else SPELLED.get(word, word)
            if m.start() > at:
                yield at, m.start(), ""
            yield m.start(), m.end(), new
            at = m.end()


def _brackets(a: Aligned) -> Iterator[tuple[int, int, str]]:
    done = 0
    for m in _BRACKETED.finditer(a.text):
        s, e = m.span()
        while s > done and a.text[s - 1].isspace():
            s -= 1
        while e < len(a.text) and a.text[e].isspace():
            e += 1
        yield s, e, "@" if m["at"] else "."
        done = e


def _bare(a: Aligned) -> Iterator[tuple[int, int, str]]:
    if not _BARE_CORE.search(a.text):
        return
    for s, e in _bare_addresses(a.text):
        for m in _BARE_TOKEN.finditer(a.text, s, e):
            yield m.start(), m.end(), "@" if m["at"] else "."


#: What the inner words of a spelled run are, and what an address in bare words holds.
_SPELLING = frozenset((*SPELLED, *DOT_WORDS, *"0123456789"))
_SIGNS = frozenset((*AT_WORDS, *DOT_WORDS))


def _worth_it(text: str) -> bool:
    """Does any transducer rewrite something?  As long as none does, each sees the text itself.

    Words alone rule most texts out, before any pattern is tried on them: the inner
    words of a spelled run stand side by side, and bare addresses hold a sign's name.
    """
    if not text.isascii() and any(plain_character(c) != c for c in set(text)):
        return True
    if _BRACKETED.search(text):
        return True
    words = text.casefold().replace(".", " ").replace(",", " ").replace("-", " ").split()
    if not _SPELLING.isdisjoint(words) and any(a in _SPELLING and b in _SPELLING for a, b in itertools.pairwise(words)) and _SPELLED_RUN.search(text):
        return True
    return not _SIGNS.isdisjoint(words) and bool(_BARE_CORE.search(text)) and any(True for _ in _bare_addresses(text))


def detect_disguised(text: str, base: list[Span]) -> list[Span]:
    """Spans that show only after rewriting, in source offsets; those that a base span of their kind covers are left out."""
    if not _worth_it(text):
        return []
    a = Aligned(text)
    for step in (_look_alikes, _digits, _brackets, _bare):
        a.rewrite(step(a))
    if a.text == text:
        return []
    out = []
    for kind, s, e in detect(a.text):
        source = a.start[s], a.end[e - 1]
        if (any(a.changed[s:e]) or source[1] - source[0] > e - s) and not any(k == kind and x <= source[0] and source[1] <= y for k, x, y in base):
            out.append((kind, *source))
    return out


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def _both(text: str) -> tuple[list[Span], list[Span]]:
    base = detect(text)
    more = detect_disguised(text, base)
    return base, sorted(base + more, key=lambda x: (x[1], KINDS.index(x[0]), x[2])) if more else base


def _texts(column: pa.Array, step: int = 256) -> Iterator[list[str | None]]:
    for i in range(0, len(column), step):
        yield column.slice(i, step).to_pylist()


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: plain spans counted by kind and hashed, and all spans as text.

    ``n_email``, ``n_ip``, ``n_card``, ``n_phone`` and ``base_sha256`` come from the
    plain rules; ``spans`` has these and the disguised ones (``n_disguised``), as
    kind:start:end in code points.  Null and empty texts have none; repeated rows and
    null ids are treated each on their own; other columns don't matter.  No rule reads a
    stretch of text more than a few times, so time follows the length of the longest text.
    No exchange.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for texts in _texts(batch.column(1)):
                for text in texts:
                    base, every = _both(text or "")
                    kinds = [k for k, _, _ in base]
                    rows.append((*(kinds.count(k) for k in KINDS), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(every), len(every) - len(base)))
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()], strict=True))], names=SCHEMA.names)

    return documents(df, id_col, text_col).mapInArrow(find, SCHEMA)


def mask(text: str) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans as one."""
    out, at = [], 0
    for kind, s, e in _both(text)[1]:
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]]) if out else text


def redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows and columns with personal data masked in the text; null stays null.

    Empty, repeated and very long texts are masked like others, each row alone; columns
    may have any names.
    """
    where = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([None if t is None else mask(t) for part in _texts(batch.column(where)) for t in part], pa.string())
            yield pa.RecordBatch.from_arrays([texts if i == where else batch.column(i) for i in range(batch.num_columns)], names=batch.schema.names)

    return df.mapInArrow(run, df.schema)
