"""The commands, end to end on a small table of reports."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from reportlake import cli
from reportlake.operators import annotate, baseline
from reportlake.schema import CATEGORIES
from reportlake.sources import readers


def test_commands(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(baseline, "ITERATIONS", 5)
    monkeypatch.setattr(baseline, "LONGEST", 2)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 60")
    labels = [(F.col("doc_id") % 4 + 1).cast("int").alias(c) for c in CATEGORIES]
    reports = str(tmp_path / "reports.parquet")
    docs.select(F.col("doc_id").cast("string").alias("Hashed ID"), F.substring("text", 1, 300).alias("Report"), *labels).coalesce(1).write.parquet(reports)
    run = lambda line: cli.main(line.replace("$", str(tmp_path)).split())
    run("annotate --reports $/reports.parquet --out $/out --num-reports 20")
    run("annotate --reports $/reports.parquet --out $/out --num-reports 30 --auto")
    assert {p.name for p in (tmp_path / "out").glob("raw*.csv")} == {"raw_reports_stub_20_v1_run1.csv", "raw_reports_stub_30_v1_run1.csv"}
    run("process --results raw_reports_stub_30_v1_run1.csv --input-dir $/out --out $/proc --excel-name p.xlsx --sqlite-name p.db")
    rows = spark.read.parquet(str(tmp_path / "proc" / "explanations"))
    assert rows.count() == 150 and rows.select("report_id").distinct().count() == 30
    told = []
    for source in ("explanations", "p.xlsx", "p.db"):
        run(f"factuality --explanations $/proc/{source} --reports $/reports.parquet --out $/f.txt")
        run(f"alignment --explanations $/proc/{source} --out $/a.txt")
        told.append(((tmp_path / "f.txt").read_text(), (tmp_path / "a.txt").read_text()))
    assert "rate:" in told[0][0] and "Agreement" in told[0][1] and told[0] == told[1] == told[2]
    run("alignment --explanations $/proc/explanations --method hashing --train-data $/proc/p.xlsx --out $/m.txt")
    assert "Polarity" in (tmp_path / "m.txt").read_text()
    # two labels are enough to see training through
    monkeypatch.setattr(cli, "CATEGORIES", CATEGORIES[1:3])
    run("train --reports $/reports.parquet --out $/models --end 60")
    run("infer --reports $/reports.parquet --models $/models --out $/inferred --end 5")
    (out,) = (tmp_path / "inferred").glob("*_v1.csv")
    assert out.read_text().startswith("report_id,category,decision,probability,top_words") and len(out.read_text().splitlines()) == 1 + 2 * 5
    names = (tmp_path / "models" / "bag_of_words" / "feature_names.txt").read_text().splitlines()
    assert spark.read.parquet(str(tmp_path / "models" / "bag_of_words" / "coefficients")).count() == 2 * len(names)
    run("explain --reports $/reports.parquet --models $/models --out $/why --end 3")
    assert spark.read.parquet(str(tmp_path / "why")).where("value <> 0").count() > 0
    run("train --reports $/reports.parquet --out $/models --end 60 --model hashing")
    run("infer --reports $/reports.parquet --models $/models --out $/inferred --end 5 --model hashing")
    assert len(list((tmp_path / "inferred").glob("*_hashing_*_v1.csv"))) == 1


def test_annotation_goes_on_after_a_crash(spark, tmp_path, monkeypatch):
    reports = spark.createDataFrame([(f"r{i:02}", f"report {i}" if i != 13 else "x" * 20_000) for i in range(25)], "report_id string, report string")
    reports.coalesce(1).write.parquet(str(tmp_path / "d.parquet"))
    line = f"annotate --reports {tmp_path}/d.parquet --out {tmp_path}/out --num-reports 22 --flush-every 5 --attempts 1".split()
    real, lots = annotate.answered, []

    def failing(rows, *args, **kwargs):
        lots.append(rows.count())
        if len(lots) == 3:
            raise OSError("the model went away")
        return real(rows, *args, **kwargs)

    monkeypatch.setattr(annotate, "answered", failing)
    with pytest.raises(OSError):
        cli.main(line)
    assert not list((tmp_path / "out").glob("*.csv")) and "restart=1" in (tmp_path / "out" / "restarts.log").read_text()
    cli.main(line)
    assert lots == [5, 5, 5, 5, 5, 2]
    (out,) = (tmp_path / "out").glob("raw*.csv")
    assert readers.raw_results(spark, str(out)).select("report_id").distinct().count() == 22
    (wrong,) = (tmp_path / "out").glob("errors*.csv")
    assert "r13" in wrong.read_text() and len(wrong.read_text().splitlines()) == 2


def test_training_without_two_classes(spark, tmp_path):
    labels = [F.lit(1).alias(c) for c in CATEGORIES]
    spark.range(12).select(F.col("id").cast("string").alias("report_id"), F.lit("some words here").alias("report"), *labels).coalesce(1).write.parquet(str(tmp_path / "r.parquet"))
    cli.main(f"train --reports {tmp_path}/r.parquet --out {tmp_path}/m --end 12".split())
    assert (tmp_path / "m" / "training_bag_of_words.txt").read_text().count("not trained") == 5


def test_embedded_reports_are_used(spark, tmp_path):
    spark.createDataFrame([("1", "other text")], "report_id string, report string").write.parquet(str(tmp_path / "r.parquet"))
    spark.createDataFrame([("1", "Abnormality", 4, "sharp waves", "sharp waves seen")], "report_id string, category string, decision int, reason string, report string").write.parquet(str(tmp_path / "e.parquet"))
    cli.main(f"factuality --explanations {tmp_path}/e.parquet --reports {tmp_path}/r.parquet --out {tmp_path}/f.txt".split())
    assert "matched: 1" in (tmp_path / "f.txt").read_text()
