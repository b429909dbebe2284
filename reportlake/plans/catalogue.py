"""Every query of the engine's own operators, with its DuckDB equivalent where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reportlake.functions import decisions, jsonrepair, polarity, text
from reportlake.operators import alignment, annotate, baseline, encoders, factuality, metrics, parsing, reshape, selection, terms
from reportlake.plans import derived
from reportlake.plans.derived import LONG_SQL, RAW_SQL, long_rows, normalized_sql, raw_answers, repaired_sql, reports, table
from reportlake.schema import CATEGORIES, LABELS, NO_REASON, NO_REASON_GIVEN, REPORTS, conform

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# ---- scans, projections, joins, selection ----

@query("SELECT CAST(doc_id AS VARCHAR) AS report_id, md5(text) AS report_md5, doc_id AS pos FROM documents")
def reports_projection(spark, sf_dir):
    rows = conform(table(spark, sf_dir, "documents").withColumnsRenamed({"doc_id": "Hashed ID", "text": "Report"}).withColumn("pos", F.col("Hashed ID")), REPORTS, {"Hashed ID": "report_id", "Report": "report"})
    return rows.select("report_id", F.md5(F.col("report").cast("binary")).alias("report_md5"), "pos")


@query("SELECT CAST(doc_id AS VARCHAR) AS report_id, lang, source, n_chars FROM documents")
def private_projection(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("report_id"), "lang", "source", "n_chars", F.col("text").alias("report"))
    return reshape.private(rows)


@query("SELECT DISTINCT CAST(doc_id AS VARCHAR) AS report_id FROM labels WHERE doc_id IS NOT NULL")
def completed_ids(spark, sf_dir):
    return selection.completed_ids(table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("report_id")))


@query("SELECT CAST(doc_id AS VARCHAR) AS report_id, doc_id AS pos FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL) ORDER BY doc_id LIMIT greatest(0, 600 - (SELECT count(DISTINCT doc_id) FROM labels))")
def pending_reports(spark, sf_dir):
    done = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("report_id"))
    return selection.pending(reports(spark, sf_dir).select("report_id", "pos"), done, 600)


@query("SELECT CAST(doc_id AS VARCHAR) AS report_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents")
def scan_positions(spark, sf_dir):
    return selection.positioned(table(spark, sf_dir, "documents").select("doc_id"), "doc_id").select(F.col("doc_id").cast("string").alias("report_id"), F.col("pos").cast("long").alias("pos"))


@query("SELECT CAST(doc_id AS VARCHAR) AS report_id, doc_id AS pos FROM documents WHERE doc_id >= 0 AND doc_id < 100")
def report_slice(spark, sf_dir):
    return selection.clamped(reports(spark, sf_dir), -5, 100).select("report_id", "pos")


@query("""
SELECT doc_id, pos, decision_0, decision_1 FROM (SELECT doc_id, doc_id AS pos,
  CASE WHEN doc_id % 13 = 0 THEN NULL ELSE CAST(doc_id % 4 + 1 AS INTEGER) END AS decision_0, CASE WHEN (doc_id + 1) % 13 = 0 THEN NULL ELSE CAST((doc_id + 1) % 4 + 1 AS INTEGER) END AS decision_1 FROM documents)
WHERE pos >= 10 AND pos < 150 AND decision_0 IS NOT NULL AND decision_1 IS NOT NULL""")
def report_slice_complete(spark, sf_dir):
    rows = reports(spark, sf_dir)
    cut = selection.strict(rows, 10, 150)
    cut = cut.select("doc_id", "pos", *[derived.decision(c, F.col("doc_id")).alias(f"decision_{c}") for c in (0, 1)])
    return selection.complete(cut, ["decision_0", "decision_1"])


@query("""
SELECT CAST(l.doc_id AS VARCHAR) AS report_id, md5(CASE WHEN l.doc_id % 13 <> 0 THEN 'embedded ' || l.doc_id ELSE d.text END) AS text_md5, l.doc_id % 13 = 0 AS filled
FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id""")
def coalesced_report_text(spark, sf_dir):
    d = F.col("doc_id")
    rows = table(spark, sf_dir, "labels").select(d.cast("string").alias("report_id"), F.when(d % 13 != 0, F.concat(F.lit("embedded "), d.cast("string"))).alias("report"), (d % 13 == 0).alias("filled"))
    return reshape.with_report_text(rows, reports(spark, sf_dir)).select("report_id", F.md5(F.col("report_text").cast("binary")).alias("text_md5"), "filled")


@query("SELECT count(*) FILTER (d.text IS NULL) AS n_missing FROM (SELECT doc_id + (doc_id % 3) * 1000000 AS doc_id FROM labels) l LEFT JOIN documents d ON d.doc_id = l.doc_id")
def missing_report_texts(spark, sf_dir):
    d = F.col("doc_id")
    rows = table(spark, sf_dir, "labels").select((d + d % 3 * 1000000).cast("string").alias("report_id"), F.lit(None).cast("string").alias("report"))
    return reshape.missing_texts(reshape.with_report_text(rows, reports(spark, sf_dir)))


@query("SELECT CAST(doc_id AS VARCHAR) AS report_id, lang, NULL::VARCHAR AS source FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT CAST(doc_id AS VARCHAR), NULL, source FROM documents WHERE doc_id % 2 = 1")
def results_union(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").withColumn("report_id", F.col("doc_id").cast("string"))
    return reshape.appended(rows.where("doc_id % 2 = 0").select("report_id", "lang"), rows.where("doc_id % 2 = 1").select("report_id", "source"))


@query(f"WITH {LONG_SQL} SELECT report_id, category, decision, md5(reason) AS reason_md5 FROM long")
def labels_long(spark, sf_dir):
    rows = long_rows(spark, sf_dir)
    wide = rows.groupBy("report_id").pivot("category", CATEGORIES).agg(F.first("decision").alias("d"), F.first("reason").alias("r"))
    wide = wide.withColumnsRenamed({f"{c}_d": c for c in CATEGORIES} | {f"{c}_r": f"{c} Reasons" for c in CATEGORIES})
    return reshape.long_form(wide, ["report_id"]).select("report_id", "category", "decision", F.md5(F.col("reason").cast("binary")).alias("reason_md5"))


@query(f"WITH {LONG_SQL} SELECT report_id, " + ", ".join(f"max(decision) FILTER (category = '{c}') AS \"{c}\"" for c in CATEGORIES) + " FROM long GROUP BY report_id")
def labels_wide(spark, sf_dir):
    return reshape.wide_form(long_rows(spark, sf_dir), ["report_id"])


@query(f"WITH {LONG_SQL} SELECT count(decision) > 0 AS decision, count(reason) > 0 AS reason, count(nothing) > 0 AS nothing FROM (SELECT *, NULL AS nothing FROM long)")
def any_value(spark, sf_dir):
    return reshape.any_value(long_rows(spark, sf_dir).withColumn("nothing", F.lit(None).cast("string")), ["decision", "reason", "nothing"])


# ---- text and polarity ----

@query(f"SELECT CAST(doc_id AS VARCHAR) AS report_id, md5({normalized_sql('text')}) AS norm_md5 FROM documents")
def normalized_text(spark, sf_dir):
    return reports(spark, sf_dir).select("report_id", F.md5(text.normalized(F.col("report")).cast("binary")).alias("norm_md5"))


@query(f"WITH {LONG_SQL}, p AS (SELECT report_id, category, unnest(list_filter(list_transform(string_split(coalesce(reason, ''), ';'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')) AS phrase FROM long) SELECT report_id, category, phrase FROM p")
def phrase_explode(spark, sf_dir):
    return long_rows(spark, sf_dir).select("report_id", "category", F.explode(text.phrases(F.col("reason"))).alias("phrase"))


@query("SELECT CAST(doc_id AS VARCHAR) AS report_id, md5(regexp_replace(replace(text, chr(10), ' '), '^\\s+|\\s+$', '', 'g')) AS line_md5 FROM documents")
def one_line_text(spark, sf_dir):
    return reports(spark, sf_dir).select("report_id", F.md5(text.one_line(F.col("report")).cast("binary")).alias("line_md5"))


@query(f"SELECT CAST(doc_id AS VARCHAR) AS report_id, md5({derived.comparable_sql('text')}) AS sorted_md5 FROM documents")
def sorted_tokens_text(spark, sf_dir):
    return reports(spark, sf_dir).select("report_id", F.md5(factuality.comparable(F.col("report")).cast("binary")).alias("sorted_md5"))


def _polarity_sql(x: str) -> str:
    q = lambda ps: "|".join(f"(?:{p})" for p in ps).replace("(?<!ab)", "").replace("'", "''")
    s = f"regexp_replace(lower(coalesce({x}, '')), '^\\s+|\\s+$', '', 'g')"
    stated = " OR ".join(f"contains({s}, '{t}')" for t in polarity.STATEMENTS)
    return f"CASE WHEN {s} = '' THEN 0 WHEN {stated} THEN 1 WHEN regexp_matches({s}, '{q(polarity.AGAINST)}') THEN -1 WHEN regexp_matches({s}, '{q(polarity.FOR)}') THEN 1 ELSE -1 END"


JUDGED = f"{LONG_SQL}, judged AS (SELECT *, {_polarity_sql('reason')} AS reason_polarity, CASE WHEN decision IN (1, 2) THEN -1 WHEN decision IN (3, 4) THEN 1 ELSE 0 END AS label_polarity FROM long)"


@query(f"WITH {JUDGED} SELECT report_id, category, reason_polarity, CASE reason_polarity WHEN 1 THEN '+1' WHEN -1 THEN '-1' ELSE ' 0' END AS shown FROM judged")
def reason_polarity(spark, sf_dir):
    rows = long_rows(spark, sf_dir).withColumn("reason_polarity", polarity.reason_polarity(F.col("reason")))
    return rows.select("report_id", "category", "reason_polarity", decisions.signed(F.col("reason_polarity")).alias("shown"))


@query(f"WITH {JUDGED} SELECT category, count(*) FILTER (reason_polarity = 1) AS positive, count(*) FILTER (reason_polarity = -1) AS negative, count(*) FILTER (reason_polarity = 0) AS unclear FROM judged GROUP BY category")
def polarity_distribution(spark, sf_dir):
    return alignment.distribution(alignment.judged(long_rows(spark, sf_dir)))


STATS = f"{JUDGED}, stats AS (SELECT category, count(*) AS n_labeled, count(*) FILTER (reason_polarity = label_polarity) AS agree, count(*) FILTER (reason_polarity <> label_polarity) AS disagree FROM judged WHERE label_polarity <> 0 GROUP BY category)"


@query(f"WITH {STATS} SELECT * FROM stats")
def alignment_stats(spark, sf_dir):
    return alignment.agreement(alignment.judged(long_rows(spark, sf_dir)))


@query(f"""WITH {STATS} SELECT coalesce(category, '(all)') AS category, CAST(sum(n_labeled) AS BIGINT) AS n_labeled, CAST(sum(agree) AS BIGINT) AS agree, CAST(sum(disagree) AS BIGINT) AS disagree,
  coalesce(100.0::DOUBLE * sum(agree) / nullif(sum(n_labeled), 0), 0) AS accuracy FROM stats GROUP BY ROLLUP (category)""")
def alignment_overall(spark, sf_dir):
    return alignment.overall(alignment_stats(spark, sf_dir))


@query(f"WITH {JUDGED} SELECT report_id, category, coalesce(reason, '') AS explanation, reason_polarity, label_polarity FROM judged WHERE label_polarity <> 0 AND reason_polarity <> label_polarity")
def alignment_disagreements(spark, sf_dir):
    return alignment.disagreements(alignment.judged(long_rows(spark, sf_dir)))


# ---- JSON ----

@query(f"WITH {RAW_SQL}, {repaired_sql('explanations')} SELECT report_id, rep AS repaired FROM fixed")
def json_repair(spark, sf_dir):
    return raw_answers(spark, sf_dir).select("report_id", jsonrepair.repaired(F.col("explanations")).alias("repaired"))


def _coerce_sql(j: str) -> str:
    t = f"json_type({j})"
    return f"""CASE WHEN {t} IN ('UBIGINT', 'BIGINT') AND CAST({j} AS BIGINT) BETWEEN 1 AND 4 THEN CAST({j} AS INTEGER)
      WHEN {t} = 'VARCHAR' AND regexp_full_match({j} ->> '$', '\\s*[0-9]+\\s*') AND CAST(trim({j} ->> '$') AS BIGINT) BETWEEN 1 AND 4 THEN CAST(trim({j} ->> '$') AS INTEGER) WHEN {t} = 'BOOLEAN' AND {j} = 'true' THEN 1 END"""


def _entries_sql(column: str) -> str:
    keys = ", ".join(f"('{k}', '{v}')" for k, v in LABELS.items())
    return f"WITH {RAW_SQL}, {repaired_sql(column)}, keys AS (SELECT * FROM (VALUES {keys}) v(key, category)), e AS (SELECT report_id, category, json_extract(CASE WHEN json_valid(rep) THEN rep END, '$.' || key) AS j FROM fixed, keys)"


@query(f"{_entries_sql('classifications')} SELECT report_id, category, {_coerce_sql('j')} AS decision FROM e")
def parsed_classifications(spark, sf_dir):
    return parsing.classifications(raw_answers(spark, sf_dir)).select("report_id", "category", "decision")


@query(f"""{_entries_sql("explanations")}, x AS (SELECT *, json_extract(j, '$.decision') AS d, CASE WHEN json_type(j, '$.reasons') = 'ARRAY' THEN
    array_to_string(list_filter(list_transform(CAST(json_extract(j, '$.reasons') AS VARCHAR[]), lambda s: trim(s)), lambda s: s IS NOT NULL AND s <> ''), '; ') END AS r FROM e)
SELECT report_id, category, {_coerce_sql("d")} AS decision, coalesce(nullif(r, ''), '{NO_REASON}') AS reason FROM x""")
def parsed_explanations(spark, sf_dir):
    return parsing.explanations(raw_answers(spark, sf_dir))


@query(f"WITH {RAW_SQL}, {repaired_sql('explanations')} SELECT report_id, 'Explanations JSON Decode' AS error_type, raw AS problematic_json FROM fixed WHERE rep IS NOT NULL AND NOT json_valid(rep)")
def json_errors(spark, sf_dir):
    return parsing.errors(raw_answers(spark, sf_dir), "explanations").select("report_id", "error_type", "problematic_json")


# ---- factuality ----

INSTANCES = f"""{LONG_SQL}, inst AS (SELECT report_id, category, reason, trim(regexp_replace(coalesce(reason, ''), '\\s+', ' ', 'g')) = '' AS blank, {normalized_sql("report")} AS rn,
  list_filter(list_transform(string_split(coalesce(reason, ''), ';'), lambda x: {normalized_sql("x")}), lambda x: x <> '') AS ph FROM long WHERE decision IN (3, 4)),
audit AS (SELECT report_id, category, CASE WHEN blank THEN '{NO_REASON_GIVEN}' ELSE reason END AS reason, NOT blank AND coalesce(list_bool_or(list_transform(ph, lambda x: contains(rn, x))), false) AS matched FROM inst)"""


def _audit_rows(spark, sf_dir, **facts):
    """Reports are normalised, and other facts of theirs found, before their categories are set apart."""
    return long_rows(spark, sf_dir, report_norm=text.normalized(F.col("report")), **facts).withColumnRenamed("report", "report_text")


def _instances(spark, sf_dir):
    return factuality.instances(_audit_rows(spark, sf_dir))


@query(f"WITH {INSTANCES} SELECT * FROM audit")
def factuality_substring(spark, sf_dir):
    return factuality.substring_stage(_instances(spark, sf_dir))


@query(f"WITH {INSTANCES} SELECT count(*) FILTER (matched) AS matched, count(*) FILTER (NOT matched) AS unmatched, count(*) AS total_checked, coalesce(100.0::DOUBLE * count(*) FILTER (matched) / nullif(count(*), 0), 0) AS match_rate FROM audit")
def factuality_summary(spark, sf_dir):
    return factuality.summary(factuality_substring(spark, sf_dir))


@query()
def factuality_fuzzy(spark, sf_dir):
    """Reasons here are worded like their whole reports, with every twelfth word left out and the others in reverse order, so that the second stage decides."""
    words = F.filter(F.split("report", " "), lambda w, i: i % 12 != 11)
    rows = _audit_rows(spark, sf_dir, worded=F.array_join(F.reverse(words), " "))
    rows = rows.drop("reason").withColumnRenamed("worded", "reason")
    return factuality.fuzzy_stage(factuality.instances(rows))


@query()
def factuality_audit(spark, sf_dir):
    return factuality.audited(_audit_rows(spark, sf_dir), encoders.encoder("hashing"))


#: Every instance's reason by its number: words of the report in reverse order, the report itself, other words, or nothing.
STAGED = """words AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS report_id, text AS report, replace(text, ';', ' ') AS flat FROM documents),
staged AS (SELECT report_id, 'Abnormality' AS category, report, 
  CASE doc_id % 4 WHEN 0 THEN array_to_string(list_reverse(string_split(flat, ' ')), ' ') WHEN 1 THEN flat WHEN 2 THEN 'qqqq zzzz; xxxx' END AS reason FROM words)"""


@query(f"""WITH {STAGED}, n AS (SELECT *, {normalized_sql("report")} AS rn, list_filter(list_transform(string_split(coalesce(reason, ''), ';'), lambda x: {normalized_sql("x")}), lambda x: x <> '') AS ph FROM staged),
o AS (SELECT *, coalesce(list_bool_or(list_transform(ph, lambda x: contains(rn, x))), false) AS direct, {derived.comparable_sql("rn")} AS b FROM n)
SELECT report_id, category, md5(CASE WHEN trim(regexp_replace(coalesce(reason, ''), '\\s+', ' ', 'g')) = '' THEN '{NO_REASON_GIVEN}' ELSE reason END) AS reason_md5,
  direct OR coalesce(list_bool_or(list_transform(ph, lambda x: b <> '' AND {derived.comparable_sql("x")} = b)), false) AS matched,
  CASE WHEN direct THEN 'substring' WHEN coalesce(list_bool_or(list_transform(ph, lambda x: b <> '' AND {derived.comparable_sql("x")} = b)), false) THEN 'fuzzy' END AS stage FROM o""")
def factuality_stages(spark, sf_dir):
    """The audit without an encoder where the second stage's outcome is plain: a reason has the report's very words in another order, or no word of it."""
    flat = F.replace("report", F.lit(";"), F.lit(" "))
    d = F.col("doc_id") % 4
    reason = F.when(d == 0, F.array_join(F.reverse(F.split(flat, " ")), " ")).when(d == 1, flat).when(d == 2, "qqqq zzzz; xxxx")
    rows = reports(spark, sf_dir).select("report_id", F.lit("Abnormality").alias("category"), F.lit(4).alias("decision"), reason.alias("reason"), F.col("report").alias("report_text"))
    return factuality.audited(rows).select("report_id", "category", F.md5(F.col("reason").cast("binary")).alias("reason_md5"), "matched", "stage")


@query("""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
s AS (SELECT * FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0)
SELECT a.vec_id AS phrase_id, b.vec_id AS report_id, round(list_cosine_similarity(a.e, b.e), 6) AS similarity
FROM s a JOIN s b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0 AND list_cosine_similarity(a.e, b.e) >= 0.2""")
def semantic_support(spark, sf_dir):
    """Every hundredth vector stands for a phrase; all other vectors stand for reports."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    rows = factuality.supported(v.where("id % 100 = 0"), v, 0.2)
    return rows.select("phrase_id", "report_id", F.round("similarity", 6).alias("similarity"))


# ---- labels, folds, metrics ----

@query("SELECT doc_id, CASE WHEN (doc_id % 6) IN (1, 2) THEN 0 WHEN (doc_id % 6) IN (3, 4) THEN 1 END AS y, CASE WHEN (doc_id % 6) IN (1, 2) THEN -1 WHEN (doc_id % 6) IN (3, 4) THEN 1 ELSE 0 END AS polarity FROM documents")
def binary_labels(spark, sf_dir):
    d = (F.col("doc_id") % 6).cast("int")
    return table(spark, sf_dir, "documents").select("doc_id", decisions.binary(d).alias("y"), decisions.polarity(d).alias("polarity"))


@query("WITH p AS (SELECT doc_id, c, ((doc_id * 37 + c * 11) % 1001) / 1000.0::DOUBLE AS probability FROM documents, (VALUES (0), (1), (2), (3), (4)) v(c)) SELECT doc_id, c, probability, CASE WHEN probability < 0.4::DOUBLE THEN 1 WHEN probability < 0.5 THEN 2 WHEN probability < 0.6::DOUBLE THEN 3 ELSE 4 END AS decision, CASE WHEN probability > 0.5 THEN 'yes' ELSE 'no' END AS answer FROM p")
def confidence_levels(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("c"))
    p = F.col("probability")
    return rows.withColumn("probability", derived.probability(F.col("c"), F.col("doc_id"))).select("doc_id", "c", "probability", decisions.confidence(p).alias("decision"), decisions.yes(p).alias("answer"))


FOLDS = """
r AS (SELECT doc_id AS pos, quality AS y FROM labels), s AS (SELECT y, count(*) AS n, min(pos) AS f FROM r GROUP BY y),
t AS (SELECT y, coalesce(sum(n) OVER (ORDER BY f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a, n FROM s),
k AS (SELECT y, i, sum(floor((a + n - 1 - i + 5) / 5) - floor((a - 1 - i + 5) / 5)) OVER (PARTITION BY y ORDER BY i) AS c FROM t, (VALUES (0), (1), (2), (3), (4)) v(i)),
q AS (SELECT pos, y, row_number() OVER (PARTITION BY y ORDER BY pos) - 1 AS rk FROM r),
folds AS (SELECT q.pos, q.y, CAST(count(*) FILTER (k.c <= q.rk) AS INTEGER) AS fold FROM q JOIN k ON k.y = q.y GROUP BY q.pos, q.y, q.rk)"""


def _folds(spark, sf_dir):
    return selection.stratified_folds(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("pos"), F.col("quality").alias("y")))


@query(f"WITH {FOLDS} SELECT * FROM folds")
def stratified_folds(spark, sf_dir):
    return _folds(spark, sf_dir)


@query(f"""WITH {FOLDS}, p AS (SELECT *, CASE WHEN (pos * 37) % 10 < 7 THEN y ELSE 1 - y END AS g FROM folds),
m AS (SELECT fold, count(*) FILTER (y = g) AS ok, count(*) AS n, count(*) FILTER (y = 1 AND g = 1) AS tp, count(*) FILTER (y = 0 AND g = 1) AS fp, count(*) FILTER (y = 1 AND g = 0) AS fn FROM p GROUP BY fold)
SELECT 'quality' AS category, fold, ok / n AS accuracy, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM m""")
def cv_metrics(spark, sf_dir):
    y = F.col("y")
    rows = _folds(spark, sf_dir).withColumn("predicted", F.when(F.col("pos") * 37 % 10 < 7, y).otherwise(1 - y)).withColumn("category", F.lit("quality"))
    return metrics.fold_metrics(rows)


@query(f"WITH c AS ({SQL['cv_metrics']}) SELECT category, avg(accuracy) AS accuracy, avg(precision) AS precision, avg(recall) AS recall, avg(f1) AS f1 FROM c GROUP BY category")
def cv_means(spark, sf_dir):
    return metrics.mean_metrics(cv_metrics(spark, sf_dir))


# ---- terms ----

STOP = ["and", "die", "for", "les", "que", "the", "und"]
TOKENS = "list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), lambda w: regexp_full_match(w, '[a-z]{3,}') AND w NOT IN (" + ", ".join(f"'{s}'" for s in STOP) + "))"
COUNTS = f"tok AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS report_id, {TOKENS} AS t FROM documents), counts AS (SELECT report_id, term, count(*) AS n FROM (SELECT report_id, unnest(t) AS term FROM tok) GROUP BY report_id, term)"


@query(f"WITH {COUNTS} SELECT * FROM counts")
def term_counts(spark, sf_dir):
    return terms.term_counts(reports(spark, sf_dir), STOP)


@query(f"WITH {COUNTS}, v AS (SELECT term, CAST(sum(n) AS BIGINT) AS n FROM counts GROUP BY term ORDER BY 2 DESC, 1 LIMIT 1000) SELECT term, n, CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS idx FROM v")
def bow_vocabulary(spark, sf_dir):
    return terms.vocabulary(reports(spark, sf_dir), STOP, 1000)


def _grams_sql() -> str:
    each = ["SELECT report_id, unnest(t) AS term FROM tok"]
    for n in range(2, baseline.LONGEST + 1):
        words = " || ' ' || ".join(f"t[i + {k}]" for k in range(n))
        each.append(f"SELECT report_id, unnest(list_transform(range(1, len(t) - {n - 2}), lambda i: {words})) FROM tok")
    return " UNION ALL ".join(each)


@query(f"WITH {COUNTS}, g AS ({_grams_sql()}) SELECT term, count(*) AS n FROM g GROUP BY term HAVING count(*) >= 5")
def ngram_counts(spark, sf_dir):
    return terms.frequent_ngrams(reports(spark, sf_dir), STOP, baseline.LONGEST, 5)


@query(f"""WITH {COUNTS}, v AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS idx FROM (SELECT term FROM counts GROUP BY term ORDER BY sum(n) DESC, term LIMIT 1000))
SELECT c.report_id, CAST(v.idx AS INTEGER) AS idx, CAST(c.n AS DOUBLE) AS n FROM counts c JOIN v ON v.term = c.term""")
def bow_vectors(spark, sf_dir):
    words = [r.term for r in terms.vocabulary(reports(spark, sf_dir), STOP, 1000).orderBy("idx").collect()]
    rows = terms.vectors(reports(spark, sf_dir), STOP, words)
    return rows.select("report_id", F.posexplode(vector_to_array("features")).alias("idx", "n")).where("n <> 0")


@query(f"WITH {COUNTS} SELECT avg(len(t)) AS avg_len, CAST(max(len(t)) AS INTEGER) AS max_len, CAST(min(len(t)) AS INTEGER) AS min_len FROM tok")
def token_length_stats(spark, sf_dir):
    return metrics.token_lengths(reports(spark, sf_dir).select(terms.kept_terms(F.col("report"), STOP).alias("t")), "t")


WEIGHTS = f"""{COUNTS}, voc AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS idx FROM (SELECT term FROM counts GROUP BY term ORDER BY sum(n) DESC, term LIMIT 10000)),
w AS (SELECT c.report_id, k.category, c.term, voc.idx, c.n * ((ascii(c.term) * 7 + length(c.term) * 13 + k.c * 5) % 41 - 20) / 16.0::DOUBLE AS weight
  FROM counts c JOIN voc ON voc.term = c.term, (VALUES (0, 'Focal Epi'), (4, 'Abnormality')) k(c, category))"""


def _attributed(spark, sf_dir):
    counts = term_counts(spark, sf_dir)
    kinds = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(CATEGORIES[c]).alias("category")) for c in (0, 4)])
    vocabulary = terms.vocabulary_of(counts, baseline.VOCABULARY).select("term", "idx")
    weights = vocabulary.select("term", "idx", F.explode(kinds).alias("k")).select("term", "idx", "k.category", (((F.ascii("term") * 7 + F.length("term") * 13 + F.col("k.c") * 5) % 41 - 20) / F.lit(16.0)).alias("coef"))
    return terms.attributions(counts, weights, 2 * baseline.VOCABULARY)


@query(f"WITH {WEIGHTS} SELECT report_id, category, round(sum(weight), 6) AS logit FROM w GROUP BY report_id, category")
def linear_attribution(spark, sf_dir):
    return _attributed(spark, sf_dir).groupBy("report_id", "category").agg(F.round(F.sum("weight"), 6).alias("logit"))


@query(f"WITH {WEIGHTS}, k AS (SELECT *, CAST(row_number() OVER (PARTITION BY report_id, category ORDER BY abs(weight) DESC, idx) AS INTEGER) AS rank FROM w WHERE weight <> 0) SELECT report_id, category, term, weight, rank FROM k WHERE rank <= 20")
def top_terms(spark, sf_dir):
    return terms.top_terms(_attributed(spark, sf_dir), 20, nonzero=True).select("report_id", "category", "term", "weight", "rank")


@query(f"""WITH {WEIGHTS}, s AS (SELECT report_id, category, sum(weight) AS logit FROM w GROUP BY report_id, category),
p AS (SELECT t.report_id, k.category, 1 / (1 + exp(-(k.base + coalesce(s.logit, 0) / 8))) AS p FROM tok t CROSS JOIN (VALUES ('Focal Epi', -0.5::DOUBLE), ('Abnormality', 0.25::DOUBLE)) k(category, base) LEFT JOIN s ON s.report_id = t.report_id AND s.category = k.category)
SELECT report_id, category, round(p, 6) AS probability, CASE WHEN p < 0.4::DOUBLE THEN 1 WHEN p < 0.5 THEN 2 WHEN p < 0.6::DOUBLE THEN 3 ELSE 4 END AS decision FROM p""")
def label_inference(spark, sf_dir):
    """Linear models of two labels decide every report."""
    weights = _attributed(spark, sf_dir).withColumn("weight", F.col("weight") / 8)
    out = terms.linear_decisions(reports(spark, sf_dir), weights, {"Focal Epi": -0.5, "Abnormality": 0.25})
    return out.withColumn("probability", F.round("probability", 6))


@query(f"""WITH {LONG_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY doc_id) AS k FROM long WHERE reason IS NOT NULL AND decision BETWEEN 1 AND 4)
SELECT report_id, category, CASE WHEN decision >= 3 THEN 1 ELSE 0 END AS y FROM r WHERE k <= 200""")
def polarity_training_rows(spark, sf_dir):
    rows = long_rows(spark, sf_dir).withColumn("pos", F.col("doc_id")).drop("report")
    return baseline.polarity_rows(rows).select("report_id", "category", "y")


@query()
def baseline_inference(spark, sf_dir):
    """Trains on labelled documents with hashed-encoder features, then decides every document."""
    rows = baseline.encoded(reports(spark, sf_dir), encoders.encoder("hashing"))
    labels = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") * 3 + 1).alias("Abnormality"))
    fitted = baseline.trained(rows.join(labels, "doc_id").select("pos", "features", "Abnormality").dropDuplicates(["pos"]), ["Abnormality"])
    return baseline.inferred(rows, fitted.models)


# ---- annotation ----

@query(f"SELECT CAST(doc_id AS VARCHAR) AS report_id, md5('{annotate.CLASSIFY.replace(chr(39), chr(39) * 2)}' || chr(10) || chr(10) || text) AS classify_md5, md5('{annotate.EXPLAIN.replace(chr(39), chr(39) * 2)}' || chr(10) || chr(10) || text || chr(10) || chr(10) || 'answer') AS explain_md5 FROM documents")
def prompt_fingerprints(spark, sf_dir):
    r = F.col("report")
    return reports(spark, sf_dir).select("report_id", F.md5(annotate.classify_prompt(r).cast("binary")).alias("classify_md5"), F.md5(annotate.explain_prompt(r, F.lit("answer")).cast("binary")).alias("explain_md5"))


@query(f"WITH {RAW_SQL} SELECT report_id, regexp_full_match(coalesce(classifications, ''), '{annotate.CLASSIFY_GRAMMAR[2:-2]}') AS valid, regexp_full_match(coalesce(explanations, ''), '{annotate.EXPLAIN_GRAMMAR[2:-2]}') AS valid_explanation FROM raw")
def grammar_validity(spark, sf_dir):
    none = F.lit("")
    return raw_answers(spark, sf_dir).select("report_id", annotate.is_classification(F.coalesce("classifications", none)).alias("valid"), annotate.is_explanation(F.coalesce("explanations", none)).alias("valid_explanation"))


@query("SELECT doc_id, (greatest(doc_id % 4 + 1, (doc_id + 1) % 4 + 1, (doc_id + 2) % 3 + 1, (doc_id + 3) % 2 + 1) >= 3) = ((doc_id + 4) % 4 + 1 >= 3) AS consistent FROM documents")
def label_consistency(spark, sf_dir):
    d = F.col("doc_id")
    four = [d % 4 + 1, (d + 1) % 4 + 1, (d + 2) % 3 + 1, (d + 3) % 2 + 1]
    return table(spark, sf_dir, "documents").select("doc_id", decisions.consistent(four, (d + 4) % 4 + 1).alias("consistent"))


def _stub_sql() -> str:
    """What the stub answers, as SQL: `stub` with the report's length, its finding, decision and reason, and the errors of prompts that are too long."""
    finding = "|".join(f"(?:{p})" for p in polarity.FOR).replace("'", "''")
    fixed = annotate.Sampling()
    room = lambda template, more: f"{fixed.context} - ceil((length(report) + {len(template) + 2}{more}) / 4.0::DOUBLE)::BIGINT"
    said = "replace(replace(replace(CASE WHEN f = '' THEN substr(report, 1, 40) ELSE f END, chr(34), chr(39)), chr(10), ' '), chr(92), '/')"
    level = lambda i: f"CASE WHEN f <> '' AND (length(report) >> {i}) & 1 = 1 THEN 4 ELSE 1 END"
    first = " || ', ' || ".join(f"'\"{k}\": ' || d{i}" for i, k in enumerate(LABELS))
    second = " || ', ' || ".join(f"'\"{k}\": {{\"decision\": ' || d{i} || ', \"reasons\": [' || to_json(said) || ']}}'" for i, k in enumerate(LABELS))
    return f"""
texts AS (SELECT doc_id, coalesce(text, '') AS report, regexp_extract(lower(coalesce(text, '')), '{finding}') AS f FROM documents),
levels AS (SELECT *, {", ".join(f"{level(i)} AS d{i}" for i in range(4))}, {said} AS said, {room(annotate.CLASSIFY, "")} AS room FROM texts),
firsts AS (SELECT *, greatest(d0, d1, d2, d3) AS d4 FROM levels),
told AS (SELECT *, CASE WHEN room >= {annotate.ROOM} THEN '{{' || {first} || '}}' END AS classifications FROM firsts),
rooms AS (SELECT *, {room(annotate.EXPLAIN, " + 2 + length(classifications)")} AS room2 FROM told),
stub AS (SELECT *, CAST(doc_id AS VARCHAR) AS report_id, CASE WHEN room2 >= {annotate.ROOM} THEN '{{' || {second} || '}}' END AS explanations,
  CASE WHEN room < {annotate.ROOM} THEN 'classifications: prompt leaves ' || room || ' of {fixed.context} tokens' WHEN room2 < {annotate.ROOM} THEN 'explanations: prompt leaves ' || room2 || ' of {fixed.context} tokens' END AS error FROM rooms)"""


STUB_SQL = _stub_sql()


@query(f"WITH {STUB_SQL} SELECT report_id, classifications, explanations, error FROM stub")
def annotate_stub(spark, sf_dir):
    return annotate.answered(reports(spark, sf_dir))


@query(f"""WITH {STUB_SQL}, cats AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{c}')" for i, c in enumerate(CATEGORIES))}) v(c, category)),
kept AS (SELECT *, trim(regexp_replace(said, '[^\\t\\n\\x20-\\x7E]', '', 'g')) AS r FROM stub),
long AS (SELECT report_id, category, CASE WHEN explanations IS NOT NULL THEN [d0, d1, d2, d3, d4][c + 1] END AS decision, CASE WHEN explanations IS NOT NULL AND r <> '' THEN r ELSE '{NO_REASON}' END AS reason FROM kept, cats)
SELECT *, {_polarity_sql("reason")} AS reason_polarity, CASE WHEN decision IN (1, 2) THEN -1 WHEN decision IN (3, 4) THEN 1 ELSE 0 END AS label_polarity FROM long""")
def annotate_and_parse(spark, sf_dir):
    """The whole way: annotate by the stub, repair, parse, and judge alignment."""
    answers = annotate.annotated(reports(spark, sf_dir))
    return alignment.judged(parsing.explanations(answers))


@query("""
WITH n AS (SELECT doc_id, CASE WHEN doc_id % 5 = 4 THEN 'other_' || doc_id || '.csv' ELSE 'raw_zoe_reports_' || lang || '_mistral_' || n_chars || '_v' || doc_id % 7 || '_run' || doc_id % 11 || '.csv' END AS name FROM documents),
m AS (SELECT *, regexp_extract(name, '^raw_(.+)_(.+)_(\\d+)_v(\\d+)_run(\\d+)\\.csv$', ['dataset', 'model', 'num_reports', 'version', 'run']) AS r FROM n)
SELECT name, nullif(r.dataset, '') AS dataset, nullif(r.model, '') AS model, TRY_CAST(r.num_reports AS INTEGER) AS num_reports, TRY_CAST(r.version AS INTEGER) AS version, TRY_CAST(r.run AS INTEGER) AS run FROM m""")
def run_filename_fields(spark, sf_dir):
    from reportlake.sources.runs import name_fields

    d = F.col("doc_id")
    name = F.when(d % 5 == 4, F.concat(F.lit("other_"), d.cast("string"), F.lit(".csv"))).otherwise(F.concat(F.lit("raw_zoe_reports_"), F.col("lang"), F.lit("_mistral_"), F.col("n_chars").cast("string"), F.lit("_v"), (d % 7).cast("string"), F.lit("_run"), (d % 11).cast("string"), F.lit(".csv")))
    return name_fields(table(spark, sf_dir, "documents").select(name.alias("name")), "name")


@query(f"WITH f AS ({SQL['run_filename_fields']}) SELECT dataset, model, count(DISTINCT version) AS versions, max(version) + 1 AS next_version FROM f WHERE version IS NOT NULL GROUP BY dataset, model")
def next_versions(spark, sf_dir):
    rows = run_filename_fields(spark, sf_dir).where("version IS NOT NULL")
    return rows.groupBy("dataset", "model").agg(F.count_distinct("version").alias("versions"), (F.max("version") + 1).alias("next_version"))
