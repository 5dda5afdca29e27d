"""Fill-in-middle: a document is cut at two points that its id decides, and its parts change places.

Each Arrow batch is registered in a DuckDB connection of the task, one SQL statement cuts, joins and
hashes it, and Arrow goes back; no Python code sees a row.  A text is first cut into pieces of PIECE
code points (regexp_extract_all), and only the pieces that hold a cut into single ones, so a very long
text costs a list of its pieces, not of its characters.  Batches go in slices of SLICE_BYTES of text.

Cuts and form come from sha256 of "seed:id".  Texts that are empty (or null) or contain a mark stay
plain.  A null id counts as an empty one.  Repeated rows get equal results.  Other columns are not
looked at, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textcore import buffers

PIECE = 64  # longer repetitions leave the fast path of the expression library
SLICE_BYTES = 2 << 20
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

_UNITS = "regexp_extract_all(coalesce(pieces[{0} // {piece} + 1], ''), '(?s).')"
_PART = "array_to_string(list_slice({0}, {1}, {2}), '')"

# Pieces are numbered from 1; a cut c lies in piece c // PIECE + 1, behind c % PIECE of its characters.
TRANSFORM = f"""
WITH hashed AS (
  SELECT id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n,
         sha256($seed || ':' || coalesce(CAST(id AS VARCHAR), '')) AS hex
  FROM batch),
drawn AS (
  SELECT *, CAST('0x' || substr(hex, 1, 8) AS UBIGINT) AS h1, CAST('0x' || substr(hex, 9, 8) AS UBIGINT) AS h2,
         CAST('0x' || substr(hex, 17, 8) AS UBIGINT) AS h3, CAST('0x' || substr(hex, 25, 8) AS UBIGINT) AS h4
  FROM hashed),
formed AS (
  SELECT *, CAST(least(h1 % (n + 1), h2 % (n + 1)) AS BIGINT) AS a, CAST(greatest(h1 % (n + 1), h2 % (n + 1)) AS BIGINT) AS b,
         CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}')
                   OR h3 % 100 >= 100 - $plain THEN 'plain'
              WHEN h4 % 100 < $spm THEN 'spm' ELSE 'psm' END AS form
  FROM drawn),
pieced AS (
  SELECT *, CASE WHEN form <> 'plain' THEN regexp_extract_all(text, '(?s).{{1,{PIECE}}}') END AS pieces FROM formed),
cut AS (
  SELECT *, {_UNITS.format("a", piece=PIECE)} AS at_a, {_UNITS.format("b", piece=PIECE)} AS at_b FROM pieced),
parted AS (
  SELECT id, text, n, form, a, b,
         {_PART.format("pieces", "1", f"a // {PIECE}")} || {_PART.format("at_a", "1", f"a % {PIECE}")} AS prefix,
         CASE WHEN a // {PIECE} = b // {PIECE} THEN {_PART.format("at_a", f"a % {PIECE} + 1", f"b % {PIECE}")}
              ELSE {_PART.format("at_a", f"a % {PIECE} + 1", "len(at_a)")}
                   || {_PART.format("pieces", f"a // {PIECE} + 2", f"b // {PIECE}")}
                   || {_PART.format("at_b", "1", f"b % {PIECE}")} END AS middle,
         {_PART.format("at_b", f"b % {PIECE} + 1", "len(at_b)")} || {_PART.format("pieces", f"b // {PIECE} + 2", "len(pieces)")} AS suffix
  FROM cut),
joined AS (
  SELECT id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
         CASE form WHEN 'plain' THEN text
                   WHEN 'psm' THEN '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle
                   ELSE '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle END AS output
  FROM parted)
"""
# What is between the marks, told apart by the marks alone: a text without marks can't complete one at a seam.
RESTORE = f""",
split AS (
  SELECT *, string_split(output[{len(PREFIX) + 1}:], CASE form WHEN 'psm' THEN '{SUFFIX}' ELSE '{PREFIX}' END) AS outer_parts FROM joined),
parts AS (
  SELECT *, string_split(outer_parts[2], '{MIDDLE}') AS inner_parts FROM split),
restored AS (
  SELECT *, CASE form WHEN 'plain' THEN output
                      WHEN 'psm' THEN outer_parts[1] || inner_parts[2] || inner_parts[1]
                      ELSE inner_parts[1] || inner_parts[2] || outer_parts[1] END AS restored
  FROM parts)
"""
DIGESTS = TRANSFORM + RESTORE + "SELECT id, CAST(n AS BIGINT) AS n, form, prefix_chars, middle_chars, sha256(output) AS output_sha256, sha256(restored) AS restored_sha256 FROM restored"
TEXTS = TRANSFORM + "SELECT id, CAST(n AS BIGINT) AS n, form, prefix_chars, middle_chars, output FROM joined"


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, plain: int = 10, spm: int = 20, digests: bool = False) -> DataFrame:
    """id, n, form, prefix_chars, middle_chars and the output text of every document.

    plain: share in a hundred that is left as it is; spm: share of the rest whose suffix comes first.
    digests: sha256 of the output and of the text rebuilt from it, in place of the output.
    """
    last = "output_sha256 string, restored_sha256 string" if digests else "output string"
    statement = DIGESTS if digests else TEXTS
    given = {"seed": str(seed), "plain": plain, "spm": spm}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        with duckdb.connect(":memory:", config={"threads": 1, "temp_directory": ""}) as db:
            for batch in batches:
                at = buffers(batch.column(1))[1]
                lo = 0
                while lo < len(batch):
                    hi = max(lo + 1, int(at.searchsorted(at[lo] + SLICE_BYTES, "right")) - 1)
                    db.register("batch", pa.Table.from_batches([batch.slice(lo, hi - lo)]))
                    yield from db.execute(statement, given).to_arrow_table().to_batches()
                    db.unregister("batch")
                    lo = hi

    id_type = docs.schema[id_col].dataType.simpleString()
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return found.mapInArrow(run, f"id {id_type}, n bigint, form string, prefix_chars bigint, middle_chars bigint, {last}")
