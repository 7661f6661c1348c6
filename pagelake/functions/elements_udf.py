"""Where elements end: one pass with a stack over the tag names of a page (kept in a module without postponed
annotations: Spark reads the type hints)."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Start tags that end an open paragraph.
ENDS_P = frozenset(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: Start tags that end an open element of these names, but not beyond those.
ENDS = {"li": (("li",), ("ul", "ol")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
        "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table"))}


def ends_of(keys, whole: bool) -> list[int]:
    """For keys like ``div``, ``/div`` or '' (no tag): the place where what starts at each key ends. With ``whole`` an element
    includes its end tag, otherwise it stops before it. An element without an end tag ends with its parent."""
    n = len(keys)
    end = list(range(1, n + 1))
    stack: list[tuple[str, int]] = []
    open_: dict[str, int] = {}

    def close(names, stop, at, own) -> None:
        """End the innermost open element of ``names`` and all inside it, unless a ``stop`` element lies between."""
        if not any(open_.get(x) for x in names):
            return
        depth = len(stack) - 1
        while stack[depth][0] not in names:
            if stack[depth][0] in stop:
                return
            depth -= 1
        for tag, i in stack[depth:]:
            end[i] = at
            open_[tag] -= 1
        end[stack[depth][1]] = own
        del stack[depth:]

    for i, key in enumerate(keys):
        if not key:
            continue
        if key[0] == "/":
            close((key[1:],), (), i, i + 1 if whole else i)
            continue
        if key in ENDS_P:
            close(("p",), ("td", "th", "button"), i, i)
        if key in ENDS:
            close(*ENDS[key], i, i)
        if key not in VOID:
            stack.append((key, i))
            open_[key] = open_.get(key, 0) + 1
    for _, i in stack:
        end[i] = n
    return end


#: Pages whose names are looked up at once; the rest of a batch stays in Arrow's buffers, and a page's names are a list while it is gone through.
PAGES_AT_ONCE = 64


def ends_of_pages(keys: pa.Array, whole: bool) -> pa.Array:
    """``ends_of`` for each page of a batch, a few pages at a time, into one buffer; a tag name is one object, however often it occurs."""
    sizes = np.asarray(keys.value_lengths().fill_null(0))
    starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    out = np.empty(starts[-1], np.int32)  # the one copy of the result
    for at in range(0, len(keys), PAGES_AT_ONCE):
        some = keys.slice(at, PAGES_AT_ONCE)
        coded = some.flatten().fill_null("").dictionary_encode()
        names, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        base = starts[at]
        for i in range(at, at + len(some)):
            own = codes[starts[i] - base : starts[i + 1] - base].tolist()
            out[starts[i] : starts[i + 1]] = ends_of([names[c] for c in own], whole)
    return pa.ListArray.from_arrays(pa.array(starts), pa.array(out), mask=keys.is_null() if keys.null_count else None)


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def element_ends(keys: pa.Array) -> pa.Array:
    """Ends of the elements of a page's tokens, end tags included."""
    return ends_of_pages(keys, True)


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def piece_ends(keys: pa.Array) -> pa.Array:
    """Ends of the elements of a page's block-level pieces, end tags left out."""
    return ends_of_pages(keys, False)
