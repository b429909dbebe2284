"""Command line: annotate, process, factuality, alignment, train, infer, explain."""

from __future__ import annotations

import argparse
import logging
import shutil
from pathlib import Path

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reportlake.operators import alignment, annotate, baseline, encoders, factuality, metrics, parsing, reshape, selection
from reportlake.schema import CATEGORIES, RAW_RESULTS, conform
from reportlake.shipping import shipped
from reportlake.sources import readers, runs, sinks
from reportlake.streaming.annotation import supervised

BAG = "bag_of_words"


def _session() -> SparkSession:
    return shipped(SparkSession.builder.appName("reportlake").getOrCreate())


def _planned(args, dataset: str) -> tuple[runs.Run, str | None]:
    """The run to write and the results to start from."""
    have = runs.existing(args.out, dataset, args.model)
    base = runs.latest(args.out, dataset, args.model) if args.auto or args.overwrite else None
    run, seed = runs.plan_run(have, dataset, args.model, args.num_reports, runs.Choice(base, args.overwrite, args.version))
    return run, args.resume or (str(Path(args.out) / seed.name) if seed else None)


def annotate_reports(args) -> None:
    """Annotates pending reports, --flush-every at a time. Each lot is appended to a folder of Parquet beside the run's CSV, so a crash
    loses one lot at the most, and a run that is started again goes on from that folder; the CSV appears when all are done."""
    spark = _session()
    reports = readers.reports(spark, args.reports)
    dataset = args.dataset_id or runs.dataset_name(args.reports)
    run, resume = _planned(args, dataset)
    before, _ = readers.completed(spark, resume)
    sampling = annotate.Sampling(args.temperature, args.top_k, args.top_p, args.max_tokens)
    target = Path(args.out) / run.name
    lots = str(target.with_suffix(".parquet"))
    if args.overwrite and target.exists():
        shutil.rmtree(lots, ignore_errors=True)

    def answers() -> DataFrame | None:
        return spark.read.parquet(lots) if Path(lots, "_SUCCESS").exists() else None

    def work():
        while True:
            new = answers()
            done = before if new is None else reshape.appended(before, new.drop("error"))
            todo = selection.pending(reports, done, args.num_reports, args.flush_every)
            if todo.isEmpty():
                return
            annotate.answered(todo, args.model, sampling, folder=args.model_dir).write.mode("append").parquet(lots)

    supervised(work, args.attempts, lambda n, e: sinks.breadcrumb(Path(args.out) / "restarts.log", n, 1, lots))
    new = answers()
    rows = before if new is None else reshape.appended(before, new.drop("error"))
    sinks.single_csv(rows.withColumnRenamed("report_id", "Hashed_ReportURN"), target)
    if new is not None:
        sinks.errors(annotate.unanswered(new), target.with_name(f"errors_{target.name}"))
    sinks.manifest(target.with_suffix(".json"), dataset=dataset, path=args.reports, model=args.model, comment=args.comment, classify=annotate.CLASSIFY, explain=annotate.EXPLAIN, **vars(sampling))
    logging.info("wrote %s", target)


def process(args) -> None:
    path = Path(args.input_dir, args.results) if args.input_dir else Path(args.results)
    if path.is_dir():
        raw = conform(readers.read_table(_session(), str(path)), RAW_RESULTS, {"Hashed_ReportURN": "report_id"})
    else:
        raw = readers.raw_results(_session(), str(path))
    if args.num_reports:
        # a file is read in its order
        raw = raw.limit(args.num_reports)
    out = Path(args.out)
    rows = {c: parsing.parsed(raw, c).persist(StorageLevel.DISK_ONLY) for c in ("classifications", "explanations")}
    tables = {"classifications": parsing.classified(rows["classifications"]), "explanations": parsing.explained(rows["explanations"])}
    for name, df in tables.items():
        sinks.parquet(df, str(out / name))
    wide = {
        "classifications": reshape.wide_form(tables["classifications"], ["report_id"], F.col("raw_value")),
        "explanations": reshape.wide_reasons(tables["explanations"]),
    }
    wide = {name: df.withColumnRenamed("report_id", "Hashed_ReportURN") for name, df in wide.items()}
    if args.excel_name:
        try:
            sinks.excel(wide, out / args.excel_name)
        except (OSError, ValueError):
            logging.exception("no workbook %s", args.excel_name)
    if args.sqlite_name:
        sinks.sqlite(wide, out / args.sqlite_name)
    wrong = parsing.complaints(rows["classifications"], "classifications").unionByName(parsing.complaints(rows["explanations"], "explanations"))
    sinks.errors(wrong, out / f"errors_{path.stem}.csv")
    for df in rows.values():
        df.unpersist()


def check_factuality(args) -> None:
    spark = _session()
    rows = reshape.with_report_text(readers.explanations(spark, args.explanations), readers.reports(spark, args.reports))
    audit = factuality.audited(rows, encoders.encoder(args.encoder, args.model_dir) if args.encoder else None).persist(StorageLevel.DISK_ONLY)
    sinks.factuality_report(audit, factuality.summary(audit), args.out)
    audit.unpersist()


def check_alignment(args) -> None:
    spark = _session()
    long = readers.explanations(spark, args.explanations).drop("report")
    if args.method != "rule":
        if not args.train_data:
            raise SystemExit(f"--method {args.method} needs --train-data, labelled explanations")
        encode = encoders.encoder(args.method, args.model_dir)
        learn = selection.positioned(readers.explanations(spark, args.train_data).drop("report"), "report_id")
        vectors = lambda df: baseline.encoded(df.withColumn("report", F.col("reason")), encode).withColumn("features", F.when(F.col("reason").isNotNull(), F.col("features"))).drop("report")
        models = baseline.polarity_models(vectors(learn), CATEGORIES)
        if absent := [c for c in CATEGORIES if c not in models]:
            logging.warning("too few reasons to learn from for %s", ", ".join(absent))
        long = baseline.model_polarity(vectors(long), models)
    rows = alignment.judged(long)
    sinks.alignment_report(alignment.distribution(rows), alignment.overall(alignment.agreement(rows)), alignment.disagreements(rows), args.out)


def _features(rows: DataFrame, args, steps=None):
    """rows with features of the model that args names, and the fitted steps of a bag of words."""
    if args.model != BAG:
        return baseline.encoded(rows, encoders.encoder(args.model, args.model_dir)), None
    steps = steps or baseline.features().fit(rows)
    return steps.transform(rows), steps


def train(args) -> None:
    spark = _session()
    labels = selection.complete(readers.labelled(spark, args.reports), CATEGORIES)
    rows = selection.strict(readers.reports(spark, args.reports), max(args.start, 0), args.end).join(labels, "report_id")
    rows, steps = _features(rows, args)
    fitted = baseline.trained(rows, CATEGORIES, refit=args.refit)
    folder = f"{args.out}/{args.model}"
    if steps is not None:
        vocabulary = steps.stages[-1].vocabulary
        steps.write().overwrite().save(f"{folder}/features")
        sinks.lines(f"{folder}/feature_names.txt", vocabulary)
        if fitted.models:
            baseline.coefficients(rows, fitted.models, vocabulary).write.mode("overwrite").parquet(f"{folder}/coefficients")
    for label, model in fitted.models.items():
        model.write().overwrite().save(f"{folder}/{label}")
    lengths = metrics.token_lengths(rows if steps is not None else rows.withColumn("g1", F.split("report", " ")), "g1")
    means = metrics.mean_metrics(fitted.metrics) if fitted.metrics is not None else None
    sinks.training_report(fitted.metrics, means, lengths, fitted.missing, Path(args.out) / f"training_{args.model}.txt", model=args.model, reports=rows.count(), iterations=baseline.ITERATIONS)


def _loaded(args, reports: DataFrame):
    """Reports with features, the models of the labels that have one, and a bag's vocabulary."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.classification import LogisticRegressionModel

    folder, steps = Path(args.models, args.model), None
    if args.model == BAG:
        if not (folder / "features").exists():
            raise FileNotFoundError(f"no features in {folder}")
        steps = PipelineModel.load(str(folder / "features"))
    models = {c: LogisticRegressionModel.load(str(folder / c)) for c in CATEGORIES if (folder / c).exists()}
    if missing := [c for c in CATEGORIES if c not in models]:
        logging.warning("no model for %s", ", ".join(missing))
    if not models:
        raise FileNotFoundError(f"no models in {folder}")
    rows, steps = _features(reports, args, steps)
    return rows, models, steps.stages[-1].vocabulary if steps is not None else None


def infer(args) -> None:
    spark = _session()
    rows, models, vocabulary = _loaded(args, selection.clamped(readers.reports(spark, args.reports), args.start, args.end))
    out = baseline.inferred(rows, models, args.epsilon)
    if vocabulary is not None:
        out = baseline.with_top_words(out, baseline.attributed(rows, models, vocabulary))
    dataset = args.dataset_id or runs.dataset_name(args.reports)
    sinks.single_csv(out.orderBy("report_id", "category"), sinks.first_free(args.out, f"{dataset}_inference_results_{args.model}_ep={args.epsilon}"))


def explain(args) -> None:
    """The tables behind attribution plots: Shapley values of a bag's terms, or, for an encoder, the effect of leaving tokens out."""
    spark = _session()
    rows, models, vocabulary = _loaded(args, selection.clamped(readers.reports(spark, args.reports), args.start, args.end))
    if vocabulary is not None:
        table = baseline.explained(rows, models, vocabulary)
    else:
        table = baseline.masked(rows, models, encoders.encoder(args.model, args.model_dir))
    sinks.parquet(table, args.out)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="reportlake")
    sub = top.add_subparsers(required=True)

    def command(name, run, *options):
        p = sub.add_parser(name)
        p.set_defaults(run=run)
        for flags, kw in (*options, (("-v", "--verbose"), {"action": "count", "default": 1})):
            p.add_argument(*([flags] if isinstance(flags, str) else flags), **kw)

    number = lambda d: {"type": int, "default": d}
    real = lambda d: {"type": float, "default": d}
    needed, switch = {"required": True}, {"action": "store_true"}
    reports = (("--reports", "--dataset-path"), needed)
    out = (("--out", "--outdir"), needed)
    folder = ("--model-dir", {"help": "folder of local model files"})
    model = ("--model", {"default": BAG, "choices": [BAG, "hashing", *encoders.MODELS]})
    command(
        "annotate", annotate_reports, reports, out, ("--model", {"default": "stub", "choices": annotate.available()}), folder, ("--dataset-id", {}), ("--num-reports", number(10)),
        (("--resume", "--completed-csv"), {"help": "results to start from"}), ("--auto", switch | {"help": "go on from the latest run"}), ("--overwrite", switch | {"help": "write over the latest run"}),
        ("--version", {"type": int, "help": "start a new run in this version"}), ("--flush-every", number(1000)), ("--attempts", number(3)),
        ("--temperature", real(0.0)), ("--top-k", number(40)), ("--top-p", real(0.95)), ("--max-tokens", number(3000)), ("--comment", {"default": ""}),
    )
    command("process", process, ("--results", needed), ("--input-dir", {}), out, (("--num-reports", "--num-rows"), number(0)), ("--excel-name", {}), ("--sqlite-name", {}))
    command("factuality", check_factuality, ("--explanations", needed), reports, ("--encoder", {"choices": ["hashing", *encoders.MODELS]}), folder, out)
    command("alignment", check_alignment, ("--explanations", needed), ("--method", {"default": "rule", "choices": ["rule", "hashing", *encoders.MODELS]}), ("--train-data", {}), folder, out)
    command("train", train, reports, out, model, folder, ("--start", number(0)), ("--end", number(100)), ("--refit", switch))
    command("infer", infer, reports, ("--models", needed), out, model, folder, ("--dataset-id", {}), ("--start", number(0)), ("--end", number(10)), ("--epsilon", real(0.1)))
    command("explain", explain, reports, ("--models", needed), out, model, folder, ("--start", number(0)), ("--end", number(10)))
    return top


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    logging.basicConfig(level=logging.DEBUG if args.verbose > 2 else logging.INFO if args.verbose else logging.WARNING)
    args.run(args)


if __name__ == "__main__":
    main()
