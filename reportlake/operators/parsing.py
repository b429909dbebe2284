"""Raw answers to typed tables: repair, parse, decisions, reasons, and a table of errors.

Rows are parsed by the engine's own JSON parser. A row goes to Python's strict parser only if the engine refuses it or if
text may follow its first value; that parser also gives the error's message.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reportlake.functions.decisions import coerced
from reportlake.functions.jsonrepair import block, repaired, returns
from reportlake.functions.text import is_blank, let, strip
from reportlake.schema import LABELS, NO_REASON


def _strict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Adds the value as plain JSON, or the parser's complaint, to rows with `repaired`."""
    for batch in batches:
        values, errors = [], []
        for t in batch["repaired"]:
            try:
                values.append(json.dumps(json.loads(t, parse_constant=lambda _: None)))
                errors.append(None)
            except ValueError as e:
                values.append(None)
                errors.append(str(e))
        yield batch.assign(plain_json=values, error=errors)


def parsed(raw: DataFrame, column: str) -> DataFrame:
    """raw with `repaired`, `value` (variant) and `error` for a column of JSON text; a null or blank text is neither."""
    again = let(F.coalesce(block(F.col(column)), F.col(column)), returns)
    odd = lambda r, v: r.isNotNull() & (v.isNull() | (again > 1) | ~F.contains(r, F.lit("{")))
    facts = lambda r: let(F.try_parse_json(r), lambda v: F.struct(r.alias("repaired"), v.alias("value"), odd(r, v).alias("_odd")))
    # a generator of one row: what it computes is not computed again above it
    rows = raw.select("*", F.inline(F.array(let(F.when(~is_blank(F.col(column)), repaired(F.col(column))), facts))))
    plain = rows.where("NOT _odd").select(*raw.columns, "repaired", "value", F.lit(None).cast("string").alias("error"))
    odd = rows.where("_odd").select(*raw.columns, "repaired")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in odd.schema.fields)
    strict = odd.mapInPandas(_strict, f"{kinds}, plain_json string, error string").select(*raw.columns, "repaired", F.try_parse_json("plain_json").alias("value"), "error")
    return plain.unionByName(strict)


def _is_object(v: Column) -> Column:
    return F.startswith(F.schema_of_variant(v), F.lit("OBJECT"))


def classifications(raw: DataFrame, column: str = "classifications") -> DataFrame:
    """A row per report and category: the value as JSON text and the coerced decision."""
    return classified(parsed(raw, column))


def classified(rows: DataFrame) -> DataFrame:
    """classifications() of rows that are parsed already."""
    entries = F.array(*[F.struct(F.lit(label).alias("category"), F.try_variant_get("value", f"$.{key}", "variant").alias("v")) for key, label in LABELS.items()])
    each = rows.select("report_id", F.explode(entries).alias("e")).select("report_id", "e.*")
    return each.select("report_id", "category", F.to_json("v").alias("raw_value"), coerced(F.col("v")).alias("decision"))


def cleaned_reasons(v: Column) -> Column:
    """A JSON array's texts, stripped, without blank ones, joined; the default for anything else."""
    texts = F.filter(F.transform(F.try_variant_get(v, "$", "array<string>"), lambda x: strip(x)), lambda x: x.isNotNull() & (x != ""))
    text = F.when(F.startswith(F.schema_of_variant(v), F.lit("ARRAY")), F.array_join(texts, "; "))
    return F.when(F.coalesce(text, F.lit("")) == "", NO_REASON).otherwise(text)


def explanations(raw: DataFrame, column: str = "explanations") -> DataFrame:
    """A row per report and category: decision and reason. A bare value in an entry's place is taken as the decision."""
    return explained(parsed(raw, column))


def explained(rows: DataFrame) -> DataFrame:
    """explanations() of rows that are parsed already."""
    entries = F.array(*[F.struct(F.lit(label).alias("category"), F.try_variant_get("value", f"$.{key}", "variant").alias("v")) for key, label in LABELS.items()])
    each = rows.select("report_id", F.explode(entries).alias("e")).select("report_id", "e.*")
    is_entry = _is_object(F.col("v"))
    decision = F.when(is_entry, coerced(F.try_variant_get("v", "$.decision", "variant"))).otherwise(coerced(F.col("v")))
    reason = F.when(is_entry, cleaned_reasons(F.try_variant_get("v", "$.reasons", "variant"))).otherwise(F.lit(NO_REASON))
    return each.select("report_id", "category", decision.alias("decision"), reason.alias("reason"))


def errors(raw: DataFrame, column: str) -> DataFrame:
    """A row per text that isn't JSON after repair, or whose classifications aren't an object."""
    return complaints(parsed(raw, column), column)


def complaints(rows: DataFrame, column: str) -> DataFrame:
    """errors() of rows that are parsed already."""
    kind = f"{column.capitalize()} JSON Decode"
    wrong = F.when(F.col("error").isNotNull(), F.col("error"))
    if column == "classifications":
        wrong = wrong.when(F.col("value").isNotNull() & ~_is_object(F.col("value")), F.lit("not an object"))
    return rows.withColumn("m", wrong).where("m IS NOT NULL").select("report_id", F.lit(kind).alias("error_type"), F.col("m").alias("error_message"), F.col(column).alias("problematic_json"))
