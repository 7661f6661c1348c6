"""Canonical JSON of content blocks (V10), content hash (X1) and stored length
(X2), all as Column expressions.

The canonical text is ``json.dumps(blocks, sort_keys=True, ensure_ascii=False)``:
keys in alphabetical order (content, items, language, level, type), separators
``", "`` and ``": "``. Spark's ``to_json`` is compact, so the text is built
with ``concat``; string values are quoted by ``to_json`` itself.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK_TYPE = "struct<type:string,content:string,level:int,language:string,items:array<string>>"


def q(s: Column) -> Column:
    """JSON string literal of ``s`` (quotes and escapes from to_json)."""
    # the value starts after {"v": and ends in a quote, which the brace follows
    return F.when(s.isNull(), F.lit("{")).otherwise(F.rtrim(F.substring(F.to_json(F.struct(s.alias("v"))), 6, 1 << 30), F.lit("}")))


def block_json(b: Column) -> Column:
    """Canonical JSON of one block struct; NULL fields are absent."""
    items = F.concat(F.lit("["), F.array_join(F.transform(b["items"], q), ", "), F.lit("]"))
    parts = F.array(
        F.when(b["content"].isNotNull(), F.concat(F.lit('"content": '), q(b["content"]))),
        F.when(b["items"].isNotNull(), F.concat(F.lit('"items": '), items)),
        F.when(b["language"].isNotNull(), F.concat(F.lit('"language": '), q(b["language"]))),
        F.when(b["level"].isNotNull(), F.concat(F.lit('"level": '), b["level"].cast("string"))),
        F.when(b["type"].isNotNull(), F.concat(F.lit('"type": '), q(b["type"]))),
    )
    return F.concat(F.lit("{"), F.array_join(parts, ", "), F.lit("}"))


def canonical_json(blocks: Column) -> Column:
    """Canonical JSON of a block array."""
    return F.concat(F.lit("["), F.array_join(F.transform(blocks, block_json), ", "), F.lit("]"))


def content_hash(blocks: Column) -> Column:
    """SHA-256 of the canonical JSON; NULL for NULL or empty content."""
    return F.when(F.coalesce(F.size(blocks), F.lit(0)) > 0, F.sha2(canonical_json(blocks), 256))


def content_length(blocks: Column) -> Column:
    """Length of the ASCII-escaped JSON: every char above U+007F counts 6
    (a surrogate pair, 12, above U+FFFF); 0 for empty content."""
    txt = canonical_json(blocks)
    non_ascii = F.length(F.regexp_replace(txt, r"[\x{0000}-\x{007F}]", ""))
    astral = F.length(F.regexp_replace(txt, r"[^\x{10000}-\x{10FFFF}]", ""))
    n = F.length(txt) + non_ascii * 5 + astral * 6
    return F.when(F.coalesce(F.size(blocks), F.lit(0)) > 0, n).otherwise(F.lit(0))


# ---------------------------------------------------------------------------
# DuckDB twins (paragraph-shaped blocks {type, content}).
# ---------------------------------------------------------------------------
def sql_block_json(b: str) -> str:
    return f"('{{\"content\": ' || to_json({b}.content) || ', \"type\": ' || to_json({b}.type) || '}}')"


def sql_canonical_json(blocks: str) -> str:
    return f"('[' || array_to_string(list_transform({blocks}, lambda bj: {sql_block_json('bj')}), ', ') || ']')"


def sql_content_hash(blocks: str) -> str:
    return f"CASE WHEN coalesce(len({blocks}), 0) > 0 THEN sha256({sql_canonical_json(blocks)}) END"


def sql_content_length(blocks: str) -> str:
    t = sql_canonical_json(blocks)
    return (f"CASE WHEN coalesce(len({blocks}), 0) > 0 THEN CAST(length({t}) + "
            f"5 * length(regexp_replace({t}, '[\\x00-\\x7F]', '', 'g')) + "
            f"6 * length(regexp_replace({t}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')) AS INTEGER) ELSE 0 END")
