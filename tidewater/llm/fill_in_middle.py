"""Operator 11, fill-in-middle transformation in DuckDB inside mapInArrow.

A text is cut into units, runs of the letters A-Z and a-z or single other code points, so that no cut falls inside a word.
Four numbers from the SHA-256 of the seed and the doc_id choose two cuts and the form: the output is the text itself (plain),
prefix, suffix and middle behind their marks (psm), or suffix, prefix and middle (spm). Each Arrow batch is registered in
DuckDB, whose SQL does all of it; no Python touches a row. restored() goes back from output and form alone: a text that
holds a mark stays plain, and no mark has a border, so that the first place of each mark is where it was put.

Very long texts are transformed whole, alone in a statement. Nulls: a null text is empty, and an empty text is plain; a
null doc_id is hashed as no digits. Repeated rows and rows that share a doc_id are transformed each by itself; there are no
ties. Empty tables give no rows. Columns besides doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import map_batches, read_table
from tidewater.llm.duck import answers, connection, slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 1
#: Of 100 texts, so many are transformed; of 100 of these, so many have the suffix first.
RATE, SPM_RATE = 90, 20

FORMED = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])
RESTORED = pa.schema([*FORMED, ("restored", pa.string())])

CUT = """
WITH units AS (
    SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS unit,
        sha256('{seed}:' || coalesce(doc_id::VARCHAR, '')) AS hash FROM docs
), hashed AS (
    SELECT doc_id, text, unit, len(unit) AS n, list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(hash, i, 8))::UINTEGER::BIGINT) AS h FROM units
), chosen AS (
    SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
        CASE WHEN n = 0 OR contains(text, '{p}') OR contains(text, '{s}') OR contains(text, '{m}') OR h[3] % 100 >= {rate} THEN 'plain'
            WHEN h[4] % 100 < {spm} THEN 'spm' ELSE 'psm' END AS form FROM hashed
), parts AS (
    SELECT doc_id, text, n, form, CASE WHEN form <> 'plain' THEN array_to_string(list_slice(unit, 1, a), '') END AS prefix,
        CASE WHEN form <> 'plain' THEN array_to_string(list_slice(unit, a + 1, b), '') END AS middle,
        CASE WHEN form <> 'plain' THEN array_to_string(list_slice(unit, b + 1, n), '') END AS suffix FROM chosen
)
SELECT doc_id, n, form, length(prefix) AS prefix_chars, length(middle) AS middle_chars,
    CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{p}' || prefix || '{s}' || suffix || '{m}' || middle
        ELSE '{s}' || suffix || '{p}' || prefix || '{m}' || middle END AS output FROM parts
"""

#: Both forms begin with a mark, and their text up to the second mark and the third is what the marks name.
BACK = """
WITH marks AS (
    SELECT *, length('{p}') + 1 AS first, CASE form WHEN 'psm' THEN position('{s}' IN output) WHEN 'spm' THEN position('{p}' IN output) END AS second, position('{m}' IN output) AS third FROM docs
), parts AS (
    SELECT *, substr(output, first, second - first) AS one, substr(output, second + length('{s}'), third - second - length('{s}')) AS two, substr(output, third + length('{m}')) AS middle FROM marks
)
SELECT doc_id, n, form, prefix_chars, middle_chars, output,
    CASE form WHEN 'psm' THEN one || middle || two WHEN 'spm' THEN two || middle || one ELSE output END AS restored FROM parts
"""


def _marked(sql: str, **more) -> str:
    return sql.format(p=PREFIX, s=SUFFIX, m=MIDDLE, **more)


def _kernel(sql: str, column: str, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with connection() as con:
            for b in batches:
                for part in slices(b, column):
                    yield from answers(con, sql, schema, docs=part)

    return kernel


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """doc_id, n (units), form, prefix_chars and middle_chars (code points; null if plain) and output of every document."""
    of = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(of, _kernel(_marked(CUT, seed=seed, rate=rate, spm=spm_rate), "text", FORMED), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(formed: DataFrame) -> DataFrame:
    """The rows of fill_in_middle with restored, the text rebuilt from output and form."""
    return map_batches(formed.select(*FORMED.names), _kernel(_marked(BACK), "output", RESTORED), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string, restored string")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = restored(fill_in_middle(read_table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


#: The same by code points: lengths of units are summed and the text itself is cut.
SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || doc_id) AS x FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS w FROM d),
h AS (SELECT *, len(w) AS n, ('0x' || x[1:8])::UINTEGER::BIGINT AS h1, ('0x' || x[9:16])::UINTEGER::BIGINT AS h2, ('0x' || x[17:24])::UINTEGER::BIGINT AS h3, ('0x' || x[25:32])::UINTEGER::BIGINT AS h4 FROM u),
e AS (SELECT *, list_transform(w, lambda s: length(s)) AS lens, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR t LIKE '%<P>%' OR t LIKE '%<S>%' OR t LIKE '%<M>%' OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
c AS (SELECT *, coalesce(list_sum(lens[1:a]), 0)::BIGINT AS p, coalesce(list_sum(lens[a + 1:b]), 0)::BIGINT AS m FROM e)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN p END AS prefix_chars, CASE WHEN form <> 'plain' THEN m END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || substr(t, 1, p) || '<S>' || substr(t, p + m + 1) || '<M>' || substr(t, p + 1, m)
        ELSE '<S>' || substr(t, p + m + 1) || '<P>' || substr(t, 1, p) || '<M>' || substr(t, p + 1, m) END) AS output_sha256,
    sha256(t) AS restored_sha256 FROM c
"""
