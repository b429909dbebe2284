"""Inputs that the queries derive from `documents` and `labels`, once as DataFrames and once as DuckDB SQL.

Documents stand for reports. Decisions, reasons and raw answers follow fixed formulas of the id, so that every rule,
repair and edge of the engine occurs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reportlake.schema import CATEGORIES, LABELS

BANK = [
    "This EEG is abnormal", "no evidence of epileptiform discharges", "sharp waves in the left temporal region", "normal background rhythm",
    "background slowing was seen", "patient was awake", "No Explanation Given", "generalized spike and wave activity", "nan", "no focal epileptiform abnormalities",
    "Temporal dysrhythmia; phase reversal", "abnormal theta and delta waveforms", "the record was within normal limits", ";", "no clear asymmetry, but triphasic transients", "   ",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("report_id"), F.col("text").alias("report"), F.col("doc_id").alias("pos"))


def decision(c: Column | int, doc: Column) -> Column:
    n = doc + c
    return F.when(n % 13 == 0, F.lit(None)).otherwise(n % 4 + 1).cast("int")


def bank(i: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in BANK]), (i % len(BANK) + 1).cast("int"))


def long_rows(spark: SparkSession, sf_dir: str, **facts: Column) -> DataFrame:
    """doc_id, report_id, report, facts of the report, c, category, decision, reason."""
    kinds = F.array(*[F.struct(F.lit(i).alias("c"), F.lit(c).alias("category")) for i, c in enumerate(CATEGORIES)])
    rows = reports(spark, sf_dir).withColumns(facts).select("*", F.explode(kinds).alias("p")).select("doc_id", "report_id", "report", *facts, "p.*")
    d, c = F.col("doc_id"), F.col("c")
    own = F.translate(F.replace(F.substring("report", 11, 40), F.lit("."), F.lit(" - ")), "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    two = F.concat(bank(d + c), F.lit("; "), bank(d * 3 + c))
    reason = F.when((d * 5 + c) % 17 == 0, F.lit(None)).when(d % 3 == 0, own).when(d % 7 == 1, two).otherwise(bank(d * 7 + c * 3))
    return rows.withColumn("decision", decision(c, d)).withColumn("reason", reason)


LONG_SQL = f"""
bank AS (SELECT [{", ".join("'" + x + "'" for x in BANK)}] AS b),
cats AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{c}')" for i, c in enumerate(CATEGORIES))}) v(c, category)),
long AS (
  SELECT doc_id, CAST(doc_id AS VARCHAR) AS report_id, text AS report, c, category,
    CASE WHEN (doc_id + c) % 13 = 0 THEN NULL ELSE CAST((doc_id + c) % 4 + 1 AS INTEGER) END AS decision,
    CASE WHEN (doc_id * 5 + c) % 17 = 0 THEN NULL
      WHEN doc_id % 3 = 0 THEN translate(replace(substr(text, 11, 40), '.', ' - '), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')
      WHEN doc_id % 7 = 1 THEN b[(doc_id + c) % {len(BANK)} + 1] || '; ' || b[(doc_id * 3 + c) % {len(BANK)} + 1]
      ELSE b[(doc_id * 7 + c * 3) % {len(BANK)} + 1] END AS reason
  FROM documents, cats, bank)"""


def raw_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """report_id, classifications, explanations: JSON text with the damage that doc_id % 11 names."""
    d = F.col("doc_id")
    kind = d % 11
    value = lambda c: F.when(kind == 7, "7").when(kind == 8, '"3"').otherwise(F.coalesce(decision(c, d).cast("string"), F.lit("null")))
    keys = list(LABELS)
    name = lambda k: F.when(kind == 3, k.replace("_", "\\_")).otherwise(k)
    pairs = [F.concat(F.lit('"'), name(k), F.lit('": '), value(i)) for i, k in enumerate(keys)]
    said = F.when(kind == 9, "brace } inside").when(kind == 10, "été slow").when(kind == 4, 'ends.""').otherwise("slow waves")
    said = F.when(kind == 4, F.lit('["ends.""]')).when(kind == 5, F.lit("[]")).when(kind == 6, F.lit("null")).otherwise(F.concat(F.lit('["'), said, F.lit('", " ", null, "b "]')))
    entries = [F.concat(F.lit('"'), name(k), F.lit('": {"decision": '), value(i), F.lit(', "reasons": '), said, F.lit("}")) for i, k in enumerate(keys)]

    def damaged(parts: list[Column]) -> Column:
        body = F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.when(kind == 2, ",}").otherwise("}"))
        return F.when(kind == 1, F.concat(F.lit("Sure! "), body, F.lit(" Hope this helps"))).when(kind == 4, F.concat(body, F.lit("} extra }"))).when(kind == 5, F.substring(body, 1, 60)).when(kind == 6, F.lit(None)).otherwise(body)

    return table(spark, sf_dir, "documents").select(d.cast("string").alias("report_id"), damaged(pairs).alias("classifications"), damaged(entries).alias("explanations"))


def _raw_sql() -> str:
    keys = list(LABELS)
    value = lambda c: f"CASE WHEN k = 7 THEN '7' WHEN k = 8 THEN '\"3\"' ELSE coalesce(CASE WHEN (doc_id + {c}) % 13 = 0 THEN NULL ELSE CAST((doc_id + {c}) % 4 + 1 AS VARCHAR) END, 'null') END"
    name = lambda k: f"CASE WHEN k = 3 THEN '{k.replace('_', chr(92) + '_')}' ELSE '{k}' END"
    said = """CASE WHEN k = 4 THEN '["ends.""]' WHEN k = 5 THEN '[]' WHEN k = 6 THEN 'null' ELSE '["' || CASE WHEN k = 9 THEN 'brace } inside' WHEN k = 10 THEN 'été slow' ELSE 'slow waves' END || '", " ", null, "b "]' END"""
    pairs = " || ', ' || ".join(f"'\"' || {name(k)} || '\": ' || {value(i)}" for i, k in enumerate(keys))
    entries = " || ', ' || ".join(f"'\"' || {name(k)} || '\": {{\"decision\": ' || {value(i)} || ', \"reasons\": ' || {said} || '}}'" for i, k in enumerate(keys))
    damage = lambda b: f"CASE WHEN k = 1 THEN 'Sure! ' || {b} || ' Hope this helps' WHEN k = 4 THEN {b} || '}} extra }}' WHEN k = 5 THEN substr({b}, 1, 60) WHEN k = 6 THEN NULL ELSE {b} END"
    close = "CASE WHEN k = 2 THEN ',}' ELSE '}' END"
    return f"""
bodies AS (SELECT doc_id, k, '{{' || {pairs} || {close} AS cb, '{{' || {entries} || {close} AS eb FROM (SELECT doc_id, doc_id % 11 AS k FROM documents)),
raw AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS report_id, {damage("cb")} AS classifications, {damage("eb")} AS explanations FROM bodies)"""


RAW_SQL = _raw_sql()


def repaired_sql(column: str) -> str:
    """CTEs that repair raw.column into fixed(doc_id, report_id, raw, rep)."""
    return f"""
blk AS (SELECT doc_id, report_id, {column} AS raw, strpos({column}, '{{') AS f, length({column}) - strpos(reverse({column}), '}}') + 1 AS l, strpos({column}, '}}') AS h FROM raw),
b1 AS (SELECT *, CASE WHEN f > 0 AND h > 0 AND l > f THEN substr(raw, f, l - f + 1) ELSE raw END AS b FROM blk),
b2 AS (SELECT *, list_filter(range(1, length(b) + 1), lambda i: substr(b, i, 1) IN ('{{', '}}')) AS bp FROM b1),
b3 AS (SELECT *, list_reduce(bp, lambda a, i: CASE WHEN a < 0 THEN a
      ELSE CASE WHEN substr(b, i, 1) = '{{' THEN a + 1 WHEN a % 1000 = 1 THEN i * 1000 WHEN a % 1000 = 0 THEN -(a + 1) ELSE a - 1 END END, 0::BIGINT) AS w FROM b2),
b4 AS (SELECT *, CASE WHEN w < 0 THEN (-w - 1) // 1000 ELSE w // 1000 END AS ok FROM b3),
b5 AS (SELECT *, regexp_replace(CASE WHEN ok > 0 THEN substr(b, 1, ok) ELSE b END, ',(\\s*[}}\\]])', '\\1', 'g') AS c FROM b4),
b6 AS (SELECT *, regexp_replace(replace(replace(replace(c, '\\\\_', '_'), '\\_', '_'), '\\''', ''''), '\\.\\s*""\\s*([\\]}}])', '."\\1', 'g') AS d FROM b5),
fixed AS (SELECT doc_id, report_id, raw, regexp_replace(regexp_replace(d, ',(\\s*[}}\\]])', '\\1', 'g'), '[^\\t\\n\\x20-\\x7E]', '', 'g') AS rep FROM b6)"""


def normalized_sql(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower(coalesce({x}, '')), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


def probability(c: Column, d: Column) -> Column:
    return ((d * 37 + c * 11) % 1001) / F.lit(1000.0)


def comparable_sql(x: str) -> str:
    plain = f"regexp_replace({x}, '[\u0080-\u00ff]', '', 'g')"
    return f"array_to_string(list_sort(string_split({normalized_sql(plain)}, ' ')), ' ')"
