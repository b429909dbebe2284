"""Writers: distributed tables, and small driver-side files that appear whole or not at all."""

from __future__ import annotations

import csv
import json
import os
import sqlite3
from collections.abc import Iterable
from contextlib import closing
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportlake.functions.text import one_line
from reportlake.sources import xlsx


def _whole(path: Path, write) -> Path:
    path.parent.mkdir(parents=True, exist_ok=True)
    new = path.with_name(path.name + ".tmp")
    write(new)
    os.replace(new, path)
    return path


def parquet(df: DataFrame, path: str) -> None:
    """The main sink: a job either commits all of its files or none."""
    df.drop("report").write.mode("overwrite").parquet(path)


def single_csv(df: DataFrame, path: str | Path) -> Path:
    """One CSV file without the report's text, written row by row from the driver."""
    rows = df.drop("report")

    def write(new: Path) -> None:
        with new.open("w", newline="", encoding="utf-8") as f:
            out = csv.writer(f)
            out.writerow(rows.columns)
            out.writerows(rows.toLocalIterator())

    return _whole(Path(path), write)


def sqlite(tables: dict[str, DataFrame], path: str | Path) -> Path:
    """Tables into a new SQLite file; the file is replaced."""

    def write(new: Path) -> None:
        new.unlink(missing_ok=True)
        with closing(sqlite3.connect(new)) as db, db:
            for name, df in tables.items():
                cols = ", ".join(f'"{c}"' for c in df.columns)
                db.execute(f'CREATE TABLE "{name}" ({cols})')
                db.executemany(f'INSERT INTO "{name}" VALUES ({", ".join("?" * len(df.columns))})', (tuple(r) for r in df.toLocalIterator()))

    return _whole(Path(path), write)


def excel(tables: dict[str, DataFrame], path: str | Path) -> Path:
    """Tables as the sheets of a new workbook, row by row from the driver; reports' texts stay out."""
    return _whole(Path(path), lambda new: xlsx.write({name: (df.drop("report").columns, map(tuple, df.drop("report").toLocalIterator())) for name, df in tables.items()}, new))


def lines(path: str | Path, values: Iterable[str]) -> Path:
    """A text file with a value a line."""
    return _lines(path, values)


def manifest(target: str | Path, /, **facts) -> Path:
    return _whole(Path(target), lambda new: new.write_text(json.dumps(facts, indent=2, sort_keys=True)))


def breadcrumb(path: str | Path, count: int, exit_code: int, resume: str | None) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with Path(path).open("a") as f:
        f.write(f"{datetime.now(UTC).isoformat()} restart={count} exit={exit_code} resume={resume}\n")


def errors(df: DataFrame, path: str | Path) -> Path | None:
    """A file of errors for this run, only if there are any."""
    return None if df.isEmpty() else single_csv(df, path)


def _lines(path: str | Path, lines: Iterable[str]) -> Path:
    def write(new: Path) -> None:
        with new.open("w", encoding="utf-8") as f:
            f.writelines(f"{x}\n" for x in lines)

    return _whole(Path(path), write)


def factuality_report(audit: DataFrame, totals: DataFrame, path: str | Path) -> Path:
    """Summary and the two lists `id | category | reason`, read in order a partition at a time."""
    t = totals.first()

    def lines():
        yield "Factuality of reasons"
        yield f"checked: {t.total_checked}  matched: {t.matched}  unmatched: {t.unmatched}  rate: {t.match_rate:.2f}%"
        for title, want in (("Matched", True), ("Unmatched", False)):
            yield f"\n{title}"
            for r in audit.where(F.col("matched") == want).orderBy("report_id", "category").select("report_id", "category", one_line(F.col("reason")).alias("reason")).toLocalIterator():
                yield f"{r.report_id} | {r.category} | {r.reason}"

    return _lines(path, lines())


def alignment_report(distribution: DataFrame, overall: DataFrame | None, disagreements: DataFrame | None, path: str | Path) -> Path:
    def lines():
        yield "Polarity of reasons"
        for r in distribution.orderBy("category").collect():
            n = max(r.positive + r.negative + r.unclear, 1)
            yield f"{r.category}: positive {r.positive} ({100 * r.positive / n:.1f}%)  negative {r.negative} ({100 * r.negative / n:.1f}%)  unclear {r.unclear} ({100 * r.unclear / n:.1f}%)"
        if overall is not None:
            yield "\nAgreement with decisions"
            for r in overall.orderBy("category").collect():
                yield f"{r.category}: {r.agree} of {r.n_labeled} ({r.accuracy:.1f}%)"
        if disagreements is not None:
            yield "\nDisagreements"
            shown = {1: "+1", -1: "-1", 0: " 0"}
            for r in disagreements.withColumn("explanation", one_line(F.col("explanation"))).orderBy("report_id", "category").toLocalIterator():
                yield f"{r.report_id} | {r.category} | {shown[r.reason_polarity]} | {shown[r.label_polarity]} | {r.explanation}"

    return _lines(path, lines())


def training_report(folds: DataFrame | None, means: DataFrame | None, lengths: DataFrame, missing: list[str], path: str | Path, **facts) -> Path:
    """Facts of the run, token lengths, each label's folds and means, and the labels that couldn't be trained."""

    def lines():
        for name, value in facts.items():
            yield f"{name}: {value}"
        n = lengths.first()
        yield f"tokens: average {n.avg_len:.4f}  longest {n.max_len}  shortest {n.min_len}"
        scores: dict[str, list] = {}
        for r in folds.orderBy("category", "fold").collect() if folds is not None else ():
            scores.setdefault(r.category, []).append(f"{r.accuracy:.4f}")
        for r in means.orderBy("category").collect() if means is not None else ():
            yield f"{r.category}: accuracy {r.accuracy:.4f} ({', '.join(scores[r.category])})  precision {r.precision:.4f}  recall {r.recall:.4f}  f1 {r.f1:.4f}"
        for label in missing:
            yield f"{label}: not trained, its rows are all of one class"

    return _lines(path, lines())


def first_free(folder: str | Path, stem: str, suffix: str = ".csv") -> Path:
    """The first of stem_v1, stem_v2, ... that doesn't exist."""
    k = 1
    while (p := Path(folder) / f"{stem}_v{k}{suffix}").exists():
        k += 1
    return p


def top_words(pairs: list[tuple[str, float]]) -> str:
    return ", ".join(f"{word} ({weight:.4f})" for word, weight in pairs)
