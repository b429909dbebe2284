"""Golden cases, properties and round trips of the engine's own operators."""

from __future__ import annotations

import json
import math
import random
import re
import sqlite3
import string
import time
from difflib import SequenceMatcher

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from reportlake.functions import decisions, jsonrepair, polarity, text
from reportlake.operators import alignment, annotate, baseline, encoders, factuality, metrics, numbering, parsing, reshape, selection, terms
from reportlake.plans import catalogue
from reportlake.schema import CATEGORIES, LABELS, REPORTS, conform, has_all_labels, id_column, require
from reportlake.sources import readers, runs, sinks, sqlite
from reportlake.streaming.annotation import annotate_stream, supervised

SMALL = "/root/testdata/sf0.001"


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.select("i", f(F.col("v")).alias("r")).orderBy("i").select("r").collect()]


# ---- JSON repair ----

GOLDEN = [
    ('{"abnormality": 4}', '{"abnormality": 4}'),
    ('Sure! {"abnormality": 4} Hope this helps', '{"abnormality": 4}'),
    ('{"abnormality": 4,}', '{"abnormality": 4}'),
    ('{"a": [1, 2, ], }', '{"a": [1, 2 ] }'),
    ('{"focal\\_epileptiform\\_activity": 1}', '{"focal_epileptiform_activity": 1}'),
    ('{"r": ["patient\\\'s eye"]}', '{"r": ["patient\'s eye"]}'),
    ('{"r": ["été slow"]}', '{"r": ["t slow"]}'),
    ('{"r": ["ends.""]}', '{"r": ["ends."]}'),
    ('{"abnormality": 4}} extra }', '{"abnormality": 4}'),
    ('{"r": ["brace } inside"], "d": 1}', '{"r": ["brace }'),
    ('{"d": 1', '{"d": 1'),
    ("}{", "}{"),
    ("", ""),
    ("nan", "nan"),
    ('{"a":1} {"b":2}', '{"a":1} {"b":2}'),
    ('{"r": ["line\nbreak"]}', '{"r": ["line\nbreak"]}'),
]


def test_repair_golden(spark):
    assert column(spark, [g[0] for g in GOLDEN], jsonrepair.repaired) == [g[1] for g in GOLDEN]


def model_balanced(s):
    depth, ok = 0, 0
    for i, c in enumerate(s):
        depth += {"{": 1, "}": -1}.get(c, 0)
        if c == "}" and depth == 0:
            ok = i + 1
        if depth < 0:
            break
    return s[:ok] if ok else s


def test_balanced_is_the_model(spark):
    rng = random.Random(3)
    values = ["".join(rng.choices("{}{}a \né", k=rng.randint(0, 24))) for _ in range(600)]
    assert column(spark, values, jsonrepair.balanced) == [model_balanced(v) for v in values]


def test_parsing(spark):
    key = list(LABELS)[0]
    values = ['{"%s": %s}' % (key, v) for v in ("3", "0", '" 3 "', '"3.0"', "3.0", "true", "null", "7", '"x"', "[1]", "NaN")] + [f'{{"{key}": 1, "{key}": 2}}', "[1]", '{"a":1} {"b":2}', "nan", None, "  "]
    raw = spark.createDataFrame([(str(i), v, v) for i, v in enumerate(values)], "report_id string, classifications string, explanations string")
    got = {int(r.report_id): r.decision for r in parsing.classifications(raw).where(F.col("category") == CATEGORIES[0]).collect()}
    assert [got[i] for i in range(len(values))] == [3, None, 3, None, None, 1, None, None, None, None, None, 2, None, None, None, None, None]
    wrong = {int(r.report_id): r.error_message for r in parsing.errors(raw, "classifications").collect()}
    assert sorted(wrong) == [12, 13, 14] and "Extra data" in wrong[13] and wrong[12] == "not an object"
    assert sorted(int(r.report_id) for r in parsing.errors(raw, "explanations").collect()) == [13, 14]


def test_reasons(spark):
    key = list(LABELS)[4]
    entries = ['{"decision": 2, "reasons": ["a", " ", null, "b "]}', '{"decision": 2, "reasons": []}', '{"decision": 2, "reasons": "x"}', "3", "{}", "null"]
    raw = spark.createDataFrame([(str(i), f'{{"{key}": {e}}}') for i, e in enumerate(entries)], "report_id string, explanations string")
    rows = {int(r.report_id): (r.decision, r.reason) for r in parsing.explanations(raw).where(F.col("category") == "Abnormality").collect()}
    none = "No Explanation Given"
    assert [rows[i] for i in range(6)] == [(2, "a; b"), (2, none), (2, none), (3, none), (None, none), (None, none)]


# ---- text, polarity, decisions ----

def test_text(spark):
    assert column(spark, ["  Sharp-Waves,  LEFT!", None, "Été x"], text.normalized) == ["sharp waves left", "", "été x"]
    assert column(spark, ["a; b;;c ", ";", None], text.phrases) == [["a", "b", "c"], [], []]
    assert column(spark, [" \ta\n"], text.strip) == ["a"]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(max_size=20), min_size=1, max_size=20))
def test_normalized_twice_is_once(spark, values):
    values = [v.replace("\x00", "").encode("utf-8", "ignore").decode() for v in values]
    once = column(spark, values, text.normalized)
    assert column(spark, once, text.normalized) == once


def model_polarity(s):
    s = (s or "").strip().lower()
    if not s:
        return 0
    if any(x in s for x in polarity.STATEMENTS):
        return 1
    if any(re.search(p, s) for p in polarity.AGAINST):
        return -1
    return 1 if any(re.search(p, s) for p in polarity.FOR) else -1


def test_polarity(spark):
    golden = {None: 0, "": 0, "  ": 0, "This EEG is abnormal": 1, "normal background with sharp wave": -1, "abnormal activity": 1, "spike discharges": 1, "No Explanation Given": -1, "patient was awake": -1, "nan": -1}
    assert column(spark, list(golden), polarity.reason_polarity) == list(golden.values())
    rng = random.Random(4)
    parts = ["no", "normal", "abnormal", "eeg", "was", "epileptiform", "discharges", "clear", "sharp wave", "theta", "and", "benign", "seen", "\n", "é", "  ", "slowing", "frontal", "features", "suggestive of", "consistent with", "epilepsy"]
    values = [" ".join(rng.choices(parts, k=rng.randint(1, 7))) for _ in range(500)]
    assert column(spark, values, polarity.reason_polarity) == [model_polarity(v) for v in values]


def test_decisions(spark):
    assert column(spark, [1, 2, 3, 4, 0, 5, None], decisions.polarity, "int") == [-1, -1, 1, 1, 0, 0, 0]
    assert column(spark, [1, 2, 3, 4, 0, None], decisions.binary, "int") == [0, 0, 1, 1, None, None]
    assert column(spark, [0.39, 0.40, 0.49, 0.50, 0.59, 0.60], decisions.confidence, "double") == [1, 2, 2, 3, 3, 4]


# ---- selection ----

def model_folds(y, k=5):
    codes = {}
    for v in y:
        codes.setdefault(v, len(codes))
    laid = sorted(codes[v] for v in y)
    alloc = {c: [sum(1 for p in range(i, len(laid), k) if laid[p] == c) for i in range(k)] for c in codes.values()}
    out, used = [], dict.fromkeys(codes.values(), 0)
    for v in y:
        c, r = codes[v], used[codes[v]]
        used[c] += 1
        f = 0
        while r >= alloc[c][f]:
            r -= alloc[c][f]
            f += 1
        out.append(f)
    return out


def test_folds(spark):
    rng = random.Random(5)
    y = [int(rng.random() < 0.3) for _ in range(83)]
    rows = spark.createDataFrame(list(enumerate(y)), "pos long, y int").repartition(3)
    assert [r.fold for r in selection.stratified_folds(rows).orderBy("pos").collect()] == model_folds(y)


def test_selection(spark):
    reports = spark.createDataFrame([(str(i), i) for i in range(20)], "report_id string, pos long").repartition(4)
    done = spark.createDataFrame([("3",), ("4",), ("4",), ("gone",), (None,)], "report_id string")
    assert sorted(r.pos for r in selection.pending(reports, done, 10).collect()) == [0, 1, 2, 5, 6, 7, 8]
    assert selection.pending(reports, done, 2).count() == 0
    assert selection.clamped(reports, -5, 999).count() == 20
    for bad in ((-1, 3), (3, 3), (0, 21)):
        with pytest.raises(ValueError):
            selection.strict(reports, *bad)
    ids = spark.createDataFrame([(i * 7 - 30,) for i in range(50)], "id long").repartition(3)
    assert [(r.id, r.pos) for r in selection.positioned(ids, "id").orderBy("pos").collect()] == [(i * 7 - 30, i) for i in range(50)]
    plan = selection.pending(reports, done, 10)._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" in plan and "TakeOrdered" in plan


def test_schema(spark):
    df = spark.createDataFrame([(1, "x")], "`Hashed ID` long, Report string")
    got = conform(df, REPORTS, {"Hashed ID": "report_id", "Report": "report"})
    assert got.schema == REPORTS and got.first() == ("1", "x", None)
    assert id_column(["a", "Hashed ID"]) == "Hashed ID" and not has_all_labels(df)
    with pytest.raises(ValueError):
        id_column(["a"])
    with pytest.raises(KeyError):
        require(df, ["b"])


def test_reshape(spark):
    wide = spark.createDataFrame([("a", 4, "x")], "report_id string, `Focal Epi` int, `Focal Epi Reasons` string")
    long = reshape.long_form(wide, ["report_id"])
    assert long.count() == 5 and long.where("decision = 4").first().reason == "x"
    assert reshape.wide_form(long, ["report_id"]).columns == ["report_id", *CATEGORIES]
    assert reshape.appended(wide, spark.createDataFrame([("b", 1)], "report_id string, z int")).count() == 2


# ---- factuality ----

def test_factuality(spark):
    report = "sharp waves seen over the left temporal region during sleep"
    rows = [("1", "A", 4, "Left TEMPORAL; nothing", report), ("2", "A", 3, "during sleep the left temporal region over seen sharp waves", report), ("3", "A", 4, "quite another matter", report), ("4", "A", 4, "  ", report), ("5", "A", 2, "x", report), ("6", "A", 4, ";", report), ("7", "A", 4, None, None)]
    long = spark.createDataFrame(rows, "report_id string, category string, decision int, reason string, report_text string")
    got = {r.report_id: (r.matched, r.stage, r.reason) for r in factuality.audited(long).collect()}
    none = "(No explanation provided)"
    assert got == {"1": (True, "substring", rows[0][3]), "2": (True, "fuzzy", rows[1][3]), "3": (False, None, rows[2][3]), "4": (False, None, none), "6": (False, None, ";"), "7": (False, None, none)}
    total = factuality.summary(factuality.audited(long)).first()
    assert (total.matched, total.unmatched, total.total_checked) == (2, 4, 6)
    assert factuality.summary(factuality.audited(long).limit(0)).first().match_rate == 0.0
    near = factuality.audited(long, encoders.encoder("hashing"))
    assert near.where("matched").count() >= 2


def test_audit_where_a_vector_is_zero(spark):
    """A report without words has the zero vector, and so has a phrase whose words' signed counts cancel out: no cosine, and so no match."""
    lone = next(f"w{i} w{j}" for i in range(200) for j in range(i) if not encoders.encoder("hashing").encode_batch([f"w{i} w{j}"]).any())
    rows = [("1", "A", 4, "sharp waves", ""), ("2", "A", 3, "sharp waves", " ... !"), ("3", "A", 3, "sharp waves", None), ("4", "A", 4, lone, "sharp waves seen over the left temporal region"), ("5", "A", 4, f"{lone}; over region sharp left waves", "sharp waves over the left region of it")]
    long = spark.createDataFrame(rows, "report_id string, category string, decision int, reason string, report_text string")
    got = {r.report_id: (r.matched, r.stage) for r in factuality.audited(long, encoders.encoder("hashing")).collect()}
    assert [got[k] for k in "1234"] == [(False, None)] * 4 and got["5"][0]


def test_hashing_encoder_reads_whole_texts():
    near, far = encoders.encoder("hashing").encode_batch(["same " * 600, "same " * 600 + "other words " * 400])
    assert near @ far < 0.95


def test_fuzzy_query_reads_whole_reports(spark, tmp_path):
    words = [f"{a}{b}ona{c}" for a in "bdfg" for b in "aei" for c in "xy"]
    spark.createDataFrame([(i, " ".join(words), "en", "s", 0) for i in range(12)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = catalogue.QUERIES["factuality_fuzzy"](spark, str(tmp_path)).collect()
    assert got and all(set(r.phrase.split()) == {w for i, w in enumerate(words) if i % 12 != 11} and 70 <= r.ratio < 100 for r in got)


@settings(max_examples=40, deadline=None)
@given(st.text("ab cd", min_size=1, max_size=40), st.text("ab cd", min_size=1, max_size=40))
def test_length_bound_drops_no_match(a, b):
    if factuality.ratio(a, b) >= factuality.FUZZY:
        assert min(len(a), len(b)) >= factuality.LEAST_ALIKE * max(len(a), len(b))
        assert factuality.alike(a, b)


def test_matched_is_as_difflib_matches():
    rng = random.Random(5)
    kinds = ["ab", "abcdefghij ", string.ascii_lowercase + " " * 6, "eeeeeeeetttttaaaaooonnnniiis    rhqxzjkv0123456789", "".join(map(chr, range(0x4E00, 0x5000))) + "  "]
    for n in range(400):
        kind = rng.choice(kinds)
        b = "".join(rng.choices(kind, k=rng.randint(200, 900)))
        words = b.split(" ")
        rng.shuffle(words)
        a = rng.choice([b[: rng.randint(1, len(b))] + "qx0", " ".join(sorted(words[: 1 + len(words) * 9 // 10])), "".join(rng.choices(kind, k=rng.randint(1, 900))), b.replace(b[5], "")])
        b = b if n % 2 else " ".join(sorted(b.split(" ")))
        if len(b) >= factuality.AUTOJUNK:
            assert factuality.matched(a, b) == sum(x.size for x in SequenceMatcher(None, a, b).get_matching_blocks()), (a, b)


def test_ratio_of_long_texts_takes_about_linear_time():
    rng = random.Random(6)
    words = ["".join(rng.choices("eeeeeeeetttttaaaaooonnnniiisssrrhhlldcumfpgwybvkxjqz", k=rng.randint(3, 9))) for _ in range(20_000)]
    began = time.process_time()
    assert 0 <= factuality.ratio(" ".join(sorted(words[::2] + words[1:18_000:2])), " ".join(sorted(words))) < 100
    assert time.process_time() - began < 20


def test_fuzzy_query_finds_ratios_once(spark):
    plan = catalogue.QUERIES["factuality_fuzzy"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"ArrowEvalPython", plan)) == 1


def test_no_python_before_the_first_stage(spark):
    plan = catalogue.QUERIES["factuality_substring"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# ---- alignment, metrics, terms ----

@pytest.mark.parametrize("longest", [1, 2, 3, 4, 5, 6])
def test_frequent_ngrams_are_counted_whole(spark, monkeypatch, longest):
    rng = random.Random(longest)
    texts = [" ".join(rng.choices(["alpha", "beta", "gamma", "delta", "the", "x1"] + [f"rare{c}" for c in "abcdefgh"], weights=[9, 5, 3, 2, 2, 1] + [0.2] * 8, k=rng.randint(0, 30))) for _ in range(200)] + [None, "", "alpha " * 300]
    docs = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "report_id string, report string").repartition(3)
    monkeypatch.setattr(terms, "TOKENS", 50)
    want = terms.term_counts(docs, ["the"], longest).groupBy("term").agg(F.sum("n").alias("n")).where("n >= 3")
    got = terms.frequent_ngrams(docs, ["the"], longest, 3)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_ngrams_are_shuffled_in_packed_blocks(spark):
    plan = catalogue.QUERIES["ngram_counts"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "HashAggregate" not in plan


def test_alignment(spark):
    rows = spark.createDataFrame([("1", "A", 4, "spike discharges"), ("2", "A", 1, "spike discharges"), ("3", "A", None, "benign"), ("4", "B", None, None)], "report_id string, category string, decision int, reason string")
    j = alignment.judged(rows)
    assert {r.category: tuple(r)[1:] for r in alignment.distribution(j).collect()} == {"A": (2, 1, 0), "B": (0, 0, 1)}
    assert [tuple(r) for r in alignment.agreement(j).collect()] == [("A", 2, 1, 1)]
    assert alignment.overall(alignment.agreement(j)).where("category = '(all)'").first().accuracy == 50.0
    assert [r.report_id for r in alignment.disagreements(j).collect()] == ["2"]


def test_metrics_without_positives(spark):
    rows = spark.createDataFrame([("A", 0, 0, 0)], "category string, fold int, y int, predicted int")
    assert tuple(metrics.fold_metrics(rows).first()) == ("A", 0, 1.0, 0.0, 0.0, 0.0)


def test_terms(spark):
    docs = spark.createDataFrame([("1", "The cat's cat, élan ab the dog"), ("2", "dog"), ("3", None)], "report_id string, report string")
    got = sorted(tuple(r) for r in terms.term_counts(docs, ["the"], 2).collect())
    assert got == [("1", "cat", 2), ("1", "cat cat", 1), ("1", "cat dog", 1), ("1", "dog", 1), ("2", "dog", 1)]
    assert [(r.term, r.n, r.idx) for r in terms.vocabulary(docs, ["the"], 1).collect()] == [("cat", 2, 0)]


def test_baseline(spark):
    rng = random.Random(6)
    rows = [(str(i), i, " ".join(rng.choices(["spike", "wave"] if i % 2 else ["calm", "rest"], k=8) + rng.choices(["and", "the", "left"], k=3)), 4 if i % 2 else 1, None) for i in range(60)]
    df = spark.createDataFrame(rows, "report_id string, pos long, report string, Abnormality int, `Focal Epi` int")
    steps = baseline.features(longest=2, vocabulary=50).fit(df)
    df = steps.transform(df)
    got = baseline.trained(df, ["Abnormality", "Focal Epi"])
    assert got.missing == ["Focal Epi"] and metrics.mean_metrics(got.metrics).first().accuracy == 1.0
    out = baseline.inferred(df, got.models)
    assert out.where("decision >= 3").count() == 30
    top = baseline.attributed(df, got.models, steps.stages[-1].vocabulary, k=3)
    assert top.groupBy("report_id").count().agg(F.max("count")).first()[0] == 3
    vocabulary = steps.stages[-1].vocabulary
    words = baseline.with_top_words(out, top).where("report_id = '1'").first().top_words
    assert words.count("(") == 3 and "spike" in words + "wave"
    told = baseline.explained(df, got.models, vocabulary, 1000).groupBy("report_id", "base", "log_odds").agg(F.sum("value").alias("s")).collect()
    assert len(told) == 60 and all(abs(r.base + r.s - r.log_odds) < 1e-9 for r in told)
    chance = {r.report_id: r.probability for r in out.collect()}
    assert all(abs(1 / (1 + math.exp(-r.log_odds)) - chance[r.report_id]) < 1e-9 for r in told)
    few = df.select("pos", F.lit("A").alias("category"), F.col("Abnormality").alias("decision"), F.col("report").alias("reason"), "features")
    models = baseline.polarity_models(few, ["A", "B"])
    assert list(models) == ["A"]
    long = df.select("report_id", F.when(F.col("pos") < 50, "A").otherwise("B").alias("category"), F.col("Abnormality").alias("decision"), F.col("report").alias("reason"), F.when(F.col("pos") > 1, F.col("features")).alias("features"))
    judged = alignment.judged(baseline.model_polarity(long, models)).collect()
    assert len(judged) == 60 and all(r.reason_polarity == (0 if int(r.report_id) in (0, 1) or r.category == "B" else r.label_polarity) for r in judged)
    assert baseline.trained(df, ["Focal Epi"]).metrics is None


def test_masked_tokens(spark):
    rows = [(str(i), i, "spike wave here" if i % 2 else "calm rest here", 4 if i % 2 else 1) for i in range(30)] + [("x", 99, "", None)]
    df = spark.createDataFrame(rows, "report_id string, pos long, report string, Abnormality int")
    encode = encoders.encoder("hashing", dim=32)
    models = baseline.trained(baseline.encoded(df, encode), ["Abnormality"], folds=3).models
    got = baseline.masked(df.where("report_id IN ('1', 'x')"), models, encode).orderBy("place").collect()
    assert [(r.report_id, r.token) for r in got] == [("1", "spike"), ("1", "wave"), ("1", "here")]
    assert got[0].effect + got[1].effect > abs(got[2].effect)


def test_folds_of_rows_without_a_class(spark):
    rows = spark.createDataFrame([(i, None if i % 3 == 0 else i % 2) for i in range(30)], "pos long, y int")
    got = selection.stratified_folds(rows, folds=5).collect()
    assert len(got) == 30 and {(r.y, r.fold) for r in got} == {(y, f) for y in (None, 0, 1) for f in range(5)}


def test_numbers_over_many_parts(spark):
    values = [i * 7919 % 1009 for i in range(900)] + [None, None]
    for parts in (1, 2, 5, 64, 300):
        got = numbering.numbered(spark.createDataFrame([(v,) for v in values], "k long").repartition(3), ["k"], "at", parts=parts).collect()
        assert sorted(r["at"] for r in got) == list(range(902)) and [r.k for r in sorted(got, key=lambda r: r["at"])][2:] == sorted(values[:900])


# ---- annotation ----

def test_grammars(spark):
    good = "{" + ", ".join(f'"{k}": 1' for k in LABELS) + "}"
    tight = "{" + ",".join(f'"{k}":1' for k in LABELS) + "}"
    assert column(spark, [good, tight, good.replace("1", "5"), good + " "], annotate.is_classification) == [True, False, False, False]
    entry_ = '{"decision": 1, "reasons": ["a\nb", "c"]}'
    full = "{" + ", ".join(f'"{k}": {entry_}' for k in LABELS) + "}"
    assert column(spark, [full, full.replace('["a\nb", "c"]', "[ ]"), good], annotate.is_explanation) == [True, True, False]


def test_annotation(spark):
    df = spark.createDataFrame([("1", "sharp wave and spike discharges"), ("2", 'calm "quiet" \\ night'), ("3", None), ("4", "x" * 20_000)], "report_id string, report string")
    rows = {r.report_id: r for r in annotate.annotated(df).collect()}
    for k in "123":
        assert set(json.loads(rows[k].classifications)) == set(LABELS)
    assert rows["4"].classifications is None
    wrong = annotate.unanswered(annotate.answered(df)).collect()
    assert [(r.report_id, r.error_type) for r in wrong] == [("4", "Annotation")] and "tokens" in wrong[0].error_message
    ok = annotate.annotated(df.where("report_id < '4'")).select(annotate.is_classification(F.col("classifications")).alias("a"), annotate.is_explanation(F.col("explanations")).alias("b"))
    assert {tuple(r) for r in ok.collect()} == {(True, True)}
    with pytest.raises(ValueError):
        annotate.annotated(df, "other")
    assert {"stub", "mistral", "deepseek", "deepseek-chat", "hermes-mistral", "hermes-llama2"} <= set(annotate.available())
    with pytest.raises(Exception, match="no model file"):
        annotate.annotated(df, "mistral", folder="/nowhere").collect()


class Rude(annotate.Backend):
    def answer(self, prompt, sampling, grammar):
        return "Sure! {}" if grammar == annotate.CLASSIFY_GRAMMAR else str(sampling.max_tokens)


def test_answers_are_held_against_their_grammar(spark, monkeypatch):
    monkeypatch.setitem(annotate.BACKENDS, "rude", Rude)
    (r,) = annotate.answered(spark.createDataFrame([("1", "x" * 8000)], "report_id string, report string"), "rude").collect()
    assert r.classifications == "Sure! {}" and r.error == "classifications: answer breaks its grammar; explanations: answer breaks its grammar"
    # the room that is left bounds the answer
    assert annotate.ROOM <= int(r.explanations) < 4096 - 2000


def test_encoders_of_local_models():
    for name in encoders.MODELS:
        with pytest.raises(FileNotFoundError, match="model.onnx"):
            encoders.encoder(name, "/nowhere")
    with pytest.raises(ValueError):
        encoders.encoder("other")


def test_support_is_brute_force(spark, monkeypatch):
    monkeypatch.setattr(factuality, "PHRASES", 7)
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(120)] + [(200, None), (201, [0.0] * 6), (202, [float("nan")] * 6), (203, [1.0, None]), (204, [1.0, 2.0]), (205, [2.0, 4.0]), (206, [])]
    v = spark.createDataFrame(rows, "id long, v array<double>").repartition(3)
    cos = lambda a, b: float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))
    good = [(i, x) for i, x in rows if i < 120 or i in (204, 205)]
    want = {(a, b) for a, x in good for b, y in good if (a % 3 == 0 or a == 204) and a != b and len(x) == len(y) and cos(x, y) >= 0.6}
    got = factuality.supported(v.where("id % 3 = 0 OR id = 204"), v, 0.6).collect()
    assert {(r.phrase_id, r.report_id) for r in got} == want and len(got) == len(want)
    assert factuality.supported(v.limit(0), v).count() == 0


def test_stream(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "check"))
    rows = lambda a, b: spark.createDataFrame([(str(i), f"report {i}", i) for i in range(a, b)], REPORTS)
    rows(0, 5).coalesce(1).write.mode("append").parquet(source)
    annotate_stream(spark, source, target, checkpoint)
    rows(3, 9).coalesce(1).write.mode("append").parquet(source)
    annotate_stream(spark, source, target, checkpoint)
    assert sorted(r.report_id for r in spark.read.parquet(target).collect()) == [str(i) for i in range(9)]


def test_supervised():
    tries = []

    def work():
        tries.append(1)
        if len(tries) < 3:
            raise OSError
        return "done"

    assert supervised(work) == "done"
    with pytest.raises(OSError):
        tries.clear()
        supervised(work, most=2)


# ---- sources, sinks, runs ----

def test_sqlite_and_csv_round_trip(spark, tmp_path):
    path = tmp_path / "r.db"
    with sqlite3.connect(path) as db:
        db.execute('CREATE TABLE reports ("Hashed ID" TEXT, Report TEXT)')
        db.executemany("INSERT INTO reports VALUES (?, ?)", [(f"h{i}", None if i == 2 else f"text {i}") for i in range(9)])
    got = readers.reports(spark, str(path))
    assert [(r.report_id, r.report) for r in got.orderBy("pos").collect()] == [(f"h{i}", None if i == 2 else f"text {i}") for i in range(9)]
    assert sqlite.sqlite_table(spark, path, "reports", ["Report"]).columns == ["Report"]
    odd = spark.createDataFrame([("1", '{"a": "x,\n\\"y\\""}', None, "secret")], "report_id string, classifications string, explanations string, report string")
    out = sinks.single_csv(odd, tmp_path / "o" / "raw.csv")
    back, ids = readers.completed(spark, str(out))
    assert back.first().classifications == '{"a": "x,\n\\"y\\""}' and ids.count() == 1 and "secret" not in out.read_text()
    assert readers.completed(spark, None)[1].count() == 0
    sinks.sqlite({"t": odd.drop("report")}, tmp_path / "t.db")
    assert readers.read_table(spark, str(tmp_path / "t.db"), "t").count() == 1
    assert sinks.errors(odd.limit(0), tmp_path / "e.csv") is None
    with pytest.raises(ValueError):
        readers.read_table(spark, "x.docx")


def test_workbooks(spark, tmp_path):
    rows = [("a<b>&\"c\" \n é👍", 4, None, 1.5, True), (None, -7, "  x ", None, None), ("\x0b]]>", 0, "", 2.0, False)]
    df = spark.createDataFrame(rows, "t string, i int, `Focal Epi Reasons` string, d double, b boolean").withColumn("report", F.lit("secret"))
    out = sinks.excel({"explanations": df.coalesce(1), "two & more": df.limit(0)}, tmp_path / "w.xlsx")
    back = readers.read_table(spark, str(out), "explanations")
    assert back.columns == ["t", "i", "Focal Epi Reasons", "d", "b"]
    assert [tuple(r) for r in back.collect()] == [(rows[0][0], "4", None, "1.5", "True"), (None, "-7", "  x ", None, None), ("]]>", "0", "", "2.0", "False")]
    assert readers.read_table(spark, str(out), "two & more").count() == 0
    with pytest.raises(ValueError):
        readers.read_table(spark, str(out), "absent")


def test_explanations_wide_and_long(spark, tmp_path):
    long = spark.createDataFrame([("1", c, i % 4 + 1, f"reason {i}") for i, c in enumerate(CATEGORIES)], "report_id string, category string, decision int, reason string")
    wide = reshape.wide_reasons(long).withColumnRenamed("report_id", "Hashed ID").withColumn("Report", F.lit("text"))
    sinks.excel({"explanations": wide.drop("Report")}, tmp_path / "e.xlsx")
    wide.write.parquet(str(tmp_path / "folder"))
    want = sorted(map(tuple, long.collect()))
    for path in ("e.xlsx", "folder"):
        assert sorted(tuple(r)[:4] for r in readers.explanations(spark, str(tmp_path / path)).collect()) == want
    assert {r.report for r in readers.explanations(spark, str(tmp_path / "folder")).collect()} == {"text"}


def test_reports(spark, tmp_path):
    catalogued = catalogue.QUERIES["factuality_substring"](spark, SMALL)
    text_ = sinks.factuality_report(catalogued, factuality.summary(catalogued), tmp_path / "f.txt").read_text()
    assert "rate:" in text_ and " | " in text_
    rows = alignment.judged(catalogue.long_rows(spark, SMALL))
    assert "Agreement" in sinks.alignment_report(alignment.distribution(rows), alignment.overall(alignment.agreement(rows)), alignment.disagreements(rows), tmp_path / "a.txt").read_text()
    assert sinks.first_free(tmp_path, "x").name == "x_v1.csv"
    assert sinks.top_words([("a", 0.03125)]) == "a (0.0312)"


def test_runs(tmp_path):
    for name in ("raw_d_m_5_v1_run2.csv", "raw_d_m_5_v1_run10.csv", "raw_d_m_9_v2_run1.csv", "raw_e_m_9_v2_run1.csv"):
        (tmp_path / name).touch()
    have = runs.existing(tmp_path, "d", "m")
    assert [r.name for r in have] == ["raw_d_m_5_v1_run2.csv", "raw_d_m_5_v1_run10.csv", "raw_d_m_9_v2_run1.csv"]
    ten = have[1]
    plan = lambda n, **k: runs.plan_run(have, "d", "m", n, runs.Choice(**k))
    assert runs.plan_run([], "d", "m", 5)[0].name == "raw_d_m_5_v1_run1.csv"
    assert plan(5, base=ten)[0].run == 11 and plan(5, base=ten, overwrite=True)[0] == ten
    assert plan(8, base=ten) == (runs.Run(1, 1, 8, "d", "m"), ten)
    assert plan(5)[0].version == 3 and plan(5, reuse_version=1)[0].run == 11
    with pytest.raises(ValueError):
        plan(3, base=ten)
    r = runs.parsed_name("raw_zoe_reports_sample_mistral_5_v1_run1.csv")
    assert (r.dataset, r.model, r.num_reports, r.version, r.run) == ("zoe_reports_sample", "mistral", 5, 1, 1)


# ---- the driver's contract ----

def test_every_query_has_columns_and_sql_has_queries(spark):
    found, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(found)
    assert entry.entry(spark).count() == 6
    for name in catalogue.QUERIES:
        df = found[name](spark, SMALL)
        assert len(set(df.columns)) == len(df.columns) > 0
