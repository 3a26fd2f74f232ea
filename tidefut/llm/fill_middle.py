"""Fill-in-middle examples by repeated-capture matching.

One ``fullmatch`` of ``(unit)*`` by the regex library keeps every repetition of the captured unit; their
ends give the number of units and the offset of any cut at once, without a loop over the text. A text
is cut at two of those offsets into prefix, middle and suffix, which sentinels mark and order anew:
``psm`` (prefix, suffix, middle) or ``spm`` (suffix, prefix, middle). Cuts and form come from a digest of the
seed and the identifier alone, so a repeated task gives the same rows.

A text stays ``plain`` if it is empty (null counts as empty), contains a sentinel, isn't made of
units throughout, or by chance. ``restore`` gets the text back from output and form by column expressions.

Whole texts are cut, very long ones too; one text at a time is matched. Rows that repeat an identifier
are cut at the same shares of their own texts; a null identifier counts as empty; an empty table gives an
empty result. Columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, texts_of

# fixed values: the sentinels before prefix, suffix and middle
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SENTINEL = regex.compile("<[PSM]>")

SCHEMA = "n long, form string, prefix_chars long, middle_chars long, output string"


def draws(seed: int, doc_id) -> list[int]:
    """Four numbers below 2^32 for an identifier."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4)]


def transform(text: str, units: regex.Pattern, h: list[int], rewritten: int, spm: int) -> tuple:
    """Number of units, form, code points of prefix and middle, and the output of one text."""
    match = units.fullmatch(text)
    if match is None:
        return None, "plain", None, None, text
    ends = match.ends(1)
    n = len(ends)
    if not n or SENTINEL.search(text) or h[2] % 100 >= rewritten:
        return n, "plain", None, None, text
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b = (ends[k - 1] if k else 0 for k in (low, high))
    prefix, middle, suffix = PREFIX + text[:a], MIDDLE + text[a:b], SUFFIX + text[b:]
    if h[3] % 100 < spm:
        return n, "spm", a, b - a, suffix + prefix + middle
    return n, "psm", a, b - a, prefix + suffix + middle


def fill_in_middle(docs: DataFrame, unit: str = ".", seed: int = 1, rewritten: int = 90, spm: int = 20) -> DataFrame:
    """doc_id, n (units; null if the text isn't made of them), form, prefix_chars, middle_chars (null if plain) and output of every row.

    ``rewritten`` of 100 texts are cut, ``spm`` of 100 cut ones have the suffix first. ``unit`` is a pattern
    (a dot is any code point) that no empty string matches.
    """
    if regex.compile(unit).fullmatch(""):
        raise ValueError("a unit must not be empty")
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", *(c.split()[0] for c in SCHEMA.split(", "))]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def cut(batches):
        units = regex.compile(f"({unit})*", regex.DOTALL)
        for batch in batches:
            for a, b in small_batches(batch.column(1)):
                ids = batch.column(0).slice(a, b - a)
                rows = [transform(t, units, draws(seed, i), rewritten, spm) for i, t in zip(ids.to_pylist(), texts_of(batch.column(1), a, b), strict=True)]
                yield pa.RecordBatch.from_arrays([ids, *map(pa.array, zip(*rows, strict=True), kinds)], names=names)

    return docs.select("doc_id", "text").mapInArrow(cut, f"doc_id {kind}, {SCHEMA}")


def restore(output: Column, form: Column) -> Column:
    """The text that an output was made from."""
    part = F.split(output, "<[PSM]>", -1)
    return F.when(form == "psm", F.concat(part[1], part[3], part[2])).when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output)


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256(concat('1:', CAST(doc_id AS VARCHAR))) AS x FROM documents),
h AS (SELECT *, CAST(concat('0x', substr(x, 1, 8)) AS UBIGINT) % (n + 1) AS a, CAST(concat('0x', substr(x, 9, 8)) AS UBIGINT) % (n + 1) AS b,
  CAST(concat('0x', substr(x, 17, 8)) AS UBIGINT) % 100 AS c, CAST(concat('0x', substr(x, 25, 8)) AS UBIGINT) % 100 AS e FROM d),
f AS (SELECT doc_id, t, n, CAST(least(a, b) AS BIGINT) AS p, CAST(greatest(a, b) AS BIGINT) AS q,
  CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR c >= 90 THEN 'plain' WHEN e < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
s AS (SELECT *, substr(t, 1, p) AS pre, substr(t, p + 1, q - p) AS mid, substr(t, q + 1, n - q) AS suf FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN p END AS prefix_chars, CASE WHEN form <> 'plain' THEN q - p END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN concat('<P>', pre, '<S>', suf, '<M>', mid) ELSE concat('<S>', suf, '<P>', pre, '<M>', mid) END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM s
"""
