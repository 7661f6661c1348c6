"""Operator 2: secret scans through a trigram inverted index.

Every rule is a regular expression. :func:`trigram_query` derives from it the Boolean query over trigrams that each
match must satisfy; a bounded segment of documents gets an inverted index (trigram -> sorted postings) over the
trigrams that any rule asks for; postings are intersected and united by the query, and only the candidates are
verified with the expression itself. Rules without mandatory trigrams scan the whole segment. A segment is indexed
inside its task, so no text is shuffled and a lost executor costs only its own segments.

Defined results: a null text is empty (no spans); an empty table gives no rows; repeated rows give repeated results;
equal starts are ordered by the order of the rules, then by end. Only the id and text columns are read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, per_batch, slices

#: At most so many literal alternatives are followed through a concatenation.
MAX_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    """``kind`` of the spans that ``pattern`` finds, leftmost and not overlapping; a match counts if its ``group`` has
    at least ``least`` characters. ``skip`` is the name of what replaces it in :func:`redact`."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1

    @property
    def regex(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII)


#: The base rules first, in the order that breaks ties.
BASE = (
    Rule("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    # The runs of [0-9a-f]+ that have 24 characters or more.
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
RULES = BASE + (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
)


# -- from a regular expression to a Boolean trigram query --------------------------------------------------------
# A query is True (no condition), a trigram (str), ("and", [...]) or ("or", [...]).

def _join(kind: str, parts: list) -> object:
    flat = []
    for p in parts:
        if p is True:
            if kind == "or":
                return True
        elif p not in flat:
            flat.append(p)
    return True if not flat else flat[0] if len(flat) == 1 else (kind, flat)


def _of_strings(strings: set[str]) -> object:
    """What holds for a text with one of these strings in it."""
    return _join("or", [_join("and", [s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _walk(nodes) -> tuple[set[str] | None, object]:
    """(all strings that these nodes can match, or None if too many; the query that holds for each match). Letters
    are folded to lower case."""
    run, found, whole = {""}, [], True
    for op, arg in nodes:
        strings, query = _one(str(op), arg)
        if strings is not None and len(run) * len(strings) <= MAX_STRINGS:
            run = {a + b for a, b in product(run, strings)}
            continue
        found += [_of_strings(run), query if strings is None else _of_strings(strings)]
        run, whole = {""}, False
    if whole:
        return run, _of_strings(run)
    return None, _join("and", [*found, _of_strings(run)])


def _one(op: str, arg) -> tuple[set[str] | None, object]:
    if op == "LITERAL":
        return ({chr(arg).lower()} if arg < 128 else {chr(arg)}), True
    if op == "IN":
        chars: set[str] = set()
        for kind, v in arg:
            if str(kind) == "LITERAL":
                chars.add(chr(v).lower())
            elif str(kind) == "RANGE" and v[1] - v[0] < MAX_STRINGS:
                chars |= {chr(c).lower() for c in range(v[0], v[1] + 1)}
            else:
                return None, True
        return (chars, True) if len(chars) <= 8 else (None, True)
    if op == "SUBPATTERN":
        return _walk(arg[3])
    if op == "BRANCH":
        each = [_walk(b) for b in arg[1]]
        if all(s is not None for s, _ in each):
            union = set().union(*(s for s, _ in each))
            return (union, _of_strings(union)) if len(union) <= MAX_STRINGS else (None, _of_strings(union))
        return None, _join("or", [q for _, q in each])
    if op in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
        least, most, inner = arg
        strings, query = _walk(inner)
        if least == 0:
            return ({""} | strings if most == 1 and strings is not None else None), True
        if least == most == 1:
            return strings, query
        return None, query
    if op in ("AT", "ASSERT", "ASSERT_NOT"):
        return {""}, True
    return None, True


def trigram_query(pattern: str) -> object:
    """The Boolean query over lower-case trigrams that every match of ``pattern`` satisfies; True if there is none."""
    return _walk(re._parser.parse(pattern))[1]


def trigrams(query: object) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*(trigrams(q) for q in query[1]))


# -- the index of one segment ------------------------------------------------------------------------------------

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


class Segment:
    """Postings of the wanted trigrams over a few documents."""

    def __init__(self, texts: list[str], wanted: list[str]):
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        self.n = len(texts)
        slot = np.zeros(1 << 24, np.uint8 if len(wanted) < 255 else np.uint16)
        codes = [t.encode() for t in wanted]
        slot[[c[0] << 16 | c[1] << 8 | c[2] for c in codes]] = np.arange(1, len(codes) + 1)
        b = _FOLD[np.frombuffer(b"\n\n".join(raw) + b"\n\n", np.uint8)].astype(np.uint32)
        got = slot[b[:-2] << 16 | b[1:-1] << 8 | b[2:]]
        at = np.flatnonzero(got)
        doc = np.searchsorted(np.cumsum([len(r) + 2 for r in raw]), at, side="right")
        pairs = np.unique(got[at].astype(np.int64) << 32 | doc)
        cut = np.searchsorted(pairs >> 32, np.arange(1, len(wanted) + 2))
        self.postings = {t: (pairs[cut[i] : cut[i + 1]] & 0xFFFFFFFF) for i, t in enumerate(wanted)}

    def find(self, query: object) -> np.ndarray:
        """The documents that satisfy the query, ascending."""
        if query is True:
            return np.arange(self.n)
        if isinstance(query, str):
            return self.postings[query]
        each = [self.find(q) for q in query[1]]
        return reduce(np.intersect1d if query[0] == "and" else np.union1d, sorted(each, key=len))


def spans_of(texts: list[str], rules=RULES) -> list[list[tuple[str, int, int]]]:
    """The spans (kind, start, end) of each text: offsets in code points, end exclusive, by start, then rule."""
    queries = [trigram_query(r.pattern) for r in rules]
    queries = [q if all(t.isascii() for t in trigrams(q)) else True for q in queries]
    wanted = sorted(set().union(*map(trigrams, queries)))
    found: list[list] = [[] for _ in texts]
    index = Segment(texts, wanted)
    for order, (rule, query) in enumerate(zip(rules, queries, strict=True)):
        regex = rule.regex
        for d in index.find(query):
            for m in regex.finditer(texts[d]):
                if m.end(rule.group) - m.start(rule.group) >= rule.least:
                    found[d].append((m.start(), order, m.end(), rule.kind))
    return [[(kind, start, end) for start, _, end, kind in sorted(f)] for f in found]


def scan(docs: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans array<struct<kind, start, end>>) of every row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def find(part):
        spans = spans_of([t or "" for t in part["_text"]], rules)
        return {"id": part["_id"], "spans": [[{"kind": k, "start": s, "end": e} for k, s, e in f] for f in spans]}

    cols = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return per_batch(cols, find, f"`{id_col}` {kind}, spans array<struct<kind: string, start: bigint, end: bigint>>")


def redact(docs: DataFrame, rules=RULES, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``docs`` with each span (overlapping ones united) replaced by ``<kind>`` of its first rule, and the length
    column, if there is one, made to fit. Rows without spans, and all other columns, stay as they are."""
    names = docs.columns
    at = names.index(text_col)
    length = names.index(length_col) if length_col in names else None

    def run(batches):
        for whole in batches:
            for lo, hi in slices(whole):
                batch = whole.slice(lo, hi - lo)
                texts = batch.column(at).to_pylist()
                spans = spans_of([t or "" for t in texts], rules)
                clean = [cut_out(t, s) if s else t for t, s in zip(texts, spans, strict=True)]
                cols = list(batch.columns)
                cols[at] = pa.array(clean, cols[at].type)
                if length is not None:
                    was = cols[length].to_pylist()
                    cols[length] = pa.array([len(t) if s else n for t, s, n in zip(clean, spans, was, strict=True)], cols[length].type)
                yield pa.RecordBatch.from_arrays(cols, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)


def cut_out(text: str, spans: list[tuple[str, int, int]]) -> str:
    out, done = [], 0
    for kind, start, end in spans:
        if start >= done:
            out += [text[done:start], f"<{kind}>"]
        done = max(done, end)
    return "".join(out) + text[done:]


assert SLICE_BYTES < 1 << 32  # document numbers of a segment fit in the low half of a posting
