"""Names of result files and the choice of the next run: metadata on the driver, no data."""

from __future__ import annotations

import re
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed value: the form of a result file's name
NAME = r"raw_(.+)_(.+)_(\d+)_v(\d+)_run(\d+)\.csv"


def name_fields(names: DataFrame, column: str) -> DataFrame:
    """names(column) with dataset, model, num_reports, version, run; nulls where a name has another form."""
    part = lambda i: F.nullif(F.regexp_extract(column, f"^{NAME}$", i), F.lit(""))
    number = lambda i: part(i).try_cast("int")
    return names.select(column, part(1).alias("dataset"), part(2).alias("model"), number(3).alias("num_reports"), number(4).alias("version"), number(5).alias("run"))


@dataclass(frozen=True, order=True)
class Run:
    """A result file's place: ordered by version and run as numbers, so run 10 follows run 2."""

    version: int
    run: int
    num_reports: int
    dataset: str = ""
    model: str = ""

    @property
    def name(self) -> str:
        return f"raw_{self.dataset}_{self.model}_{self.num_reports}_v{self.version}_run{self.run}.csv"


def parsed_name(name: str) -> Run | None:
    m = re.fullmatch(NAME, name)
    return Run(int(m[4]), int(m[5]), int(m[3]), m[1], m[2]) if m else None


def dataset_name(path: str | Path) -> str:
    return Path(path).stem


def existing(folder: str | Path, dataset: str, model: str, num_reports: int | None = None, version: int | None = None) -> list[Run]:
    """Runs in a folder, by version and run."""
    runs = (parsed_name(p.name) for p in Path(folder).glob(f"raw_{dataset}_{model}_*_v*_run*.csv"))
    return sorted(r for r in runs if r and (r.dataset, r.model) == (dataset, model) and num_reports in (None, r.num_reports) and version in (None, r.version))


def latest(folder: str | Path, dataset: str, model: str) -> Run | None:
    return max(existing(folder, dataset, model), default=None)


@dataclass(frozen=True)
class Choice:
    """What to do about existing runs: continue one (`base`), write over it, or start afresh in its version or a new one."""

    base: Run | None = None
    overwrite: bool = False
    reuse_version: int | None = None


def plan_run(runs: list[Run], dataset: str, model: str, num_reports: int, choice: Choice | None = None) -> tuple[Run, Run | None]:
    """The run to write and the run whose results seed it. Never asks; a choice that makes no sense is an error."""
    choice = choice or Choice()
    new = lambda version, run: Run(version, run, num_reports, dataset, model)
    last = lambda version: max((r.run for r in runs if r.version == version and r.num_reports == num_reports), default=0)
    if not runs:
        return new(1, 1), None
    if choice.base is not None:
        if num_reports < choice.base.num_reports:
            raise ValueError(f"{num_reports} reports are fewer than the {choice.base.num_reports} of the run to continue")
        if num_reports > choice.base.num_reports:
            return new(choice.base.version, last(choice.base.version) + 1), choice.base
        return (choice.base, None) if choice.overwrite else (new(choice.base.version, last(choice.base.version) + 1), None)
    if choice.reuse_version is not None:
        return new(choice.reuse_version, last(choice.reuse_version) + 1), None
    return new(max(r.version for r in runs) + 1, 1), None


def is_result(c: Column) -> Column:
    return F.rlike(c, F.lit(f"^{NAME}$"))
