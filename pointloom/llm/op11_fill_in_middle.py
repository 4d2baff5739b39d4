"""Fill-in-middle transformation of whole texts by a two-pass streaming matcher.

A text is cut into units, the matches of a pattern over code points (lines, unless told otherwise). The first pass runs
the lazy match iterator to its end and only counts, which gives n. The two cuts are ranks from 0 to n, drawn from the document's key.
The second pass starts a fresh iterator and advances it to the lesser rank, then to the greater one, and notes where these
matches end. No list of units or offsets is ever held, so beside the text itself a document costs the same few numbers
whether it has one unit or millions. The pieces are hashed and written from the text; the whole text is restored from the
output and its form by Spark's own functions (see restored).

Draws: h1 to h4 are the first four 8-digit hexadecimal groups of the sha256 of "seed:doc_id". The prefix ends after
min(h1 % (n+1), h2 % (n+1)) units, the middle after max of both, the suffix is the rest. Form is plain if the text is empty, or holds a
sentinel, or h3 % 100 >= rate; else spm if h4 % 100 < spm_share, else psm. A rerun of a lost task draws the same.

Null texts are empty: n 0, form plain, output empty. An empty prefix, middle or suffix is kept as such. Texts without a
line break are one unit; a text of line breaks alone has a unit for each. Characters that the pattern does not match between two units go with the
later one, those behind the last unit with the suffix. Null ids are drawn from "seed:". Repeated rows, and rows that share an id, each
give a row: equal texts of one id give equal rows. There are no ties: equal ranks leave the middle empty. Very long texts stay
whole within one task, in pieces of about a megabyte of rows. Empty tables give an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.llm.common import docs_of, row_chunks

LINES = r"[^\n]*\n|[^\n]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SENTINELS = "<P>|<S>|<M>"


@dataclass(frozen=True)
class Transformation:
    """Units, seed of the draws, and the shares (of 100) of texts that are transformed and, among these, put suffix first."""

    units: str = LINES
    seed: str = "7"
    rate: int = 100
    spm_share: int = 50


def draws(seed: str, doc_id: object) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def count_units(pattern: re.Pattern, text: str) -> int:
    """First pass: how many units there are; nothing of a match is kept."""
    return sum(1 for _ in pattern.finditer(text))


def cuts(pattern: re.Pattern, text: str, first: int, second: int) -> tuple[int, int]:
    """Second pass: the ends of the units of rank first <= second, 0 for rank 0; the iterator stops at the second."""
    matches = pattern.finditer(text)

    def advance(steps: int, end: int) -> int:
        last = deque(islice(matches, steps), maxlen=1)
        return last[0].end() if last else end

    a = advance(first, 0)
    return a, advance(second - first, a)


def transform(text: str, doc_id: object, how: Transformation, pattern: re.Pattern, sentinel: re.Pattern) -> tuple[int, str, int | None, int | None, str]:
    """(n, form, prefix_chars, middle_chars, output) of one text."""
    n = count_units(pattern, text)
    h1, h2, h3, h4 = draws(how.seed, doc_id)
    if not text or h3 % 100 >= how.rate or sentinel.search(text):
        return n, "plain", None, None, text
    a, b = cuts(pattern, text, *sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < how.spm_share:
        return n, "spm", a, b - a, "".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    return n, "psm", a, b - a, "".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))


def fill_in_middle(docs: DataFrame, how: Transformation = Transformation()) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output (the transformed text) of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern, sentinel = re.compile(how.units), re.compile(SENTINELS)
        for batch in batches:
            sizes = pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False)
            for lo, hi in row_chunks(sizes):
                rows = batch.slice(lo, hi - lo)
                out = [transform(t, d, how, pattern, sentinel) for t, d in zip(rows.column("text").to_pylist(), rows.column("key").to_pylist(), strict=True)]
                n, form, a, b, text = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(text, pa.string())],
                    names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    keyed = docs_of(docs).select("doc_id", F.col("doc_id").cast("string").alias("key"), "text")
    return keyed.mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: str = "output", form: str = "form") -> Column:
    """The exact text, from an output and its form alone. No text that is transformed holds a sentinel, and none can arise where pieces meet, so the three split it."""
    parts = F.split(output, SENTINELS, -1)
    return F.when(F.col(form) == "psm", F.concat(F.get(parts, 1), F.get(parts, 3), F.get(parts, 2))).when(F.col(form) == "spm", F.concat(F.get(parts, 2), F.get(parts, 3), F.get(parts, 1))).otherwise(F.col(output))


def digests(docs: DataFrame) -> DataFrame:
    """The transformation with the digests of its output and of the text restored from it."""
    out = fill_in_middle(docs)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"))


ORACLE = r"""
WITH u AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS us,
    sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
),
r AS (
  SELECT *, len(us) AS n, ('0x' || h[1:8])::BIGINT % (len(us) + 1) AS r1, ('0x' || h[9:16])::BIGINT % (len(us) + 1) AS r2,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 100 THEN 'plain'
         WHEN ('0x' || h[25:32])::BIGINT % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u
),
c AS (
  SELECT doc_id, t, n, form, array_to_string(us[1:least(r1, r2)], '') AS p, array_to_string(us[least(r1, r2) + 1:greatest(r1, r2)], '') AS m,
    array_to_string(us[greatest(r1, r2) + 1:n], '') AS s FROM r
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM c
"""
