"""Command line: the statement workloads over files and a store folder.  Exit code 2 for a user's mistake."""

from __future__ import annotations

import argparse
import json
import os
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import fixed
from .operators import cascade, ngram_model, profile, scoring, vote
from .operators.learning import Store
from .shipping import ship
from .sources import export
from .sources.models import fetch, provenance
from .sources.statement import UnresolvedHeaders, parse, read_files, read_statement, scan


class UserError(Exception):
    """Something that the user can put right."""


def session() -> SparkSession:
    return ship(SparkSession.builder.appName("khatasort").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate())


def _store(args) -> Store:
    return Store(session(), args.store)


#: Values of KHATASORT_MODEL, KHATASORT_MINILM and KHATASORT_FUZZY that switch a layer off.
OFF = ("0", "off", "false")


def _on(layer: str) -> bool:
    return os.environ.get(f"KHATASORT_{layer}", "").strip().lower() not in OFF


def _embed(folder: str):
    return lambda names: vote.embed_with_onnx(names, folder)


def _layers(args) -> dict:
    """The layers that the arguments name and the environment leaves on."""
    out = {} if _on("FUZZY") else {"fuzzy": False}
    if (folder := getattr(args, "model", None)) and _on("MODEL"):
        out["predict"] = ngram_model.model_layer(*ngram_model.load(session(), folder))
    if (folder := getattr(args, "minilm", None)) and _on("MINILM"):
        out["vote"] = vote.neighbour_layer(_embed(folder), vote.read_index(session(), f"{folder}/index"))
    return out


def _categorized(args, dedupe: bool):
    overrides, learned, _ = _store(args).state()
    found = parse(scan(read_files(session(), args.statement)), dedupe)
    return export.categorized(found, overrides, learned, **_layers(args))


def cmd_categorize(args) -> None:
    found = _categorized(args, args.dedupe).persist()
    first = found.select("headers").first()
    export.write_csv(export.export_rows(found, first.headers if first else []), args.out)
    print(json.dumps(export.export_summary(found).first().asDict()))


def cmd_merchants(args) -> None:
    overrides, learned, _ = _store(args).state()
    rows = export.merchant_map(read_statement(session(), args.statement, dedupe=False).rows, overrides, learned, **_layers(args))
    export.write_csv(rows.select("merchant", "category"), args.out)
    print(json.dumps(rows.agg(F.count("*").alias("merchants"), F.count_if("needs_review").alias("needs_review")).first().asDict()))


def cmd_report(args) -> None:
    rows = _categorized(args, True).where("status = 'ok'").persist()
    print(profile.text_report(rows))
    if args.json:
        Path(args.json).write_text(json.dumps(profile.payload(rows), indent=2, default=str), encoding="utf-8")


def cmd_classify(args) -> None:
    print(json.dumps(_store(args).classify(args.text, args.credit, args.direction, **_layers(args)), ensure_ascii=False))


def cmd_import(args) -> None:
    print(json.dumps(_store(args).import_transactions(read_statement(session(), args.statement).rows, learn=not args.no_learn, **_layers(args))))


def cmd_review(args) -> None:
    for r in _store(args).review_queue(args.limit).collect():
        print(f"{r.amount:>14,.2f}  {r.category:<22}{r.raw_counterparty}")


def cmd_correct(args) -> None:
    print(json.dumps(_store(args).record_correction(args.counterparty, args.category)))


def cmd_rule(args) -> None:
    _store(args).add_rule(args.pattern, args.category, args.kind, args.priority, args.note)


def cmd_reclassify(args) -> None:
    print(json.dumps(_store(args).reclassify_all(**_layers(args))))


def cmd_train(args) -> None:
    overrides, learned, _ = _store(args).state()
    statement = read_statement(session(), args.statement).rows
    examples = ngram_model.training_set(cascade.classify_native(statement, None, learned), overrides, learned).persist()
    model, labels = ngram_model.fit(examples)
    ngram_model.save(model, labels, args.out)
    ngram_model.check_saved(model, labels, args.out, examples.select("text").orderBy("text").limit(200))
    if args.minilm:
        vote.write_index(examples, _embed(args.minilm), f"{args.minilm}/index")
    report = {"examples": examples.count(), "labels": labels} | ngram_model.training_report(statement, examples, ngram_model.model_layer(model, labels), learned) | (ngram_model.cross_validated(examples).first().asDict() if args.cross_validate else {})
    print(json.dumps(report))


def cmd_setup_minilm(args) -> None:
    for url, digest in zip(args.url, args.sha256, strict=True):
        print(fetch(url, args.out, digest))


def cmd_label_sheet(args) -> None:
    export.write_csv(scoring.label_sheet(read_statement(session(), args.statement).rows), args.out)


def _labels(path: str):
    rows = session().read.option("header", True).option("escape", '"').csv(path)
    return scoring.read_labels(rows.withColumn("line", F.monotonically_increasing_id() + 2).fillna(""))


def cmd_evaluate(args) -> None:
    overrides, learned, _ = _store(args).state()
    rows, labels = read_statement(session(), args.statement).rows, _labels(args.labels)
    seen = scoring.keyed(read_statement(session(), args.train).rows).select("key") if args.train else None
    found = scoring.labelled(cascade.classify(rows, overrides, learned, **_layers(args)), labels, seen).persist()
    out = {"frozen": provenance(args.statement, args.labels), "score": scoring.score(found).first().asDict(), "per_layer": [r.asDict() for r in scoring.per_layer(found).collect()], "per_category": [r.asDict() for r in scoring.per_category(found).collect()], "confusions": [r.asDict() for r in scoring.confusions(found).collect()], "silent_errors": [r.asDict() for r in scoring.silent_errors(found).limit(20).collect()]}
    if seen is not None:
        out["seen_vs_new"] = [r.asDict() for r in scoring.score(found, "seen").collect()]
    print(json.dumps(out, indent=2))


def cmd_serve(args) -> None:
    from .serve import serve

    serve(_store(args), args.host, args.port, **_layers(args))


def cmd_categories(args) -> None:
    print("\n".join(fixed.CATEGORIES))


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="khatasort", description="Categorize bank and wallet statements.")
    sub = top.add_subparsers(dest="command", required=True)

    def add(name: str, run, *arguments, store: bool = True, model: bool = False):
        one = sub.add_parser(name)
        for flags, options in arguments:
            one.add_argument(*flags, **options)
        if store:
            one.add_argument("--store", default="khatasort-store", help="folder of the learned state")
        if model:
            one.add_argument("--model", help="folder of a trained model")
            one.add_argument("--minilm", help="folder of a sentence model and its index")
        one.set_defaults(run=run)

    arg = lambda *flags, **options: (flags, options)
    statement, out = arg("statement"), arg("-o", "--out", required=True)
    add("categorize", cmd_categorize, statement, out, arg("--dedupe", action="store_true"), model=True)
    add("merchants", cmd_merchants, statement, out, model=True)
    add("report", cmd_report, statement, arg("--json"), model=True)
    add("classify", cmd_classify, arg("text"), arg("--credit", action="store_true"), arg("--direction", default=""), model=True)
    add("import", cmd_import, statement, arg("--no-learn", action="store_true"), model=True)
    add("review", cmd_review, arg("--limit", type=int, default=30))
    add("correct", cmd_correct, arg("counterparty"), arg("category"))
    add("rule", cmd_rule, arg("pattern"), arg("category"), arg("--kind", choices=("phrase", "token"), default="phrase"), arg("--priority", type=int, default=100), arg("--note", default=""))
    add("reclassify", cmd_reclassify, model=True)
    add("train", cmd_train, statement, out, arg("--cross-validate", action="store_true"), arg("--minilm"))
    add("setup-minilm", cmd_setup_minilm, out, arg("--url", nargs="+", required=True), arg("--sha256", nargs="+", required=True), store=False)
    add("label-sheet", cmd_label_sheet, statement, out, store=False)
    add("evaluate", cmd_evaluate, statement, arg("labels"), arg("--train"), model=True)
    add("serve", cmd_serve, arg("--host", default="127.0.0.1"), arg("--port", type=int, default=8765), model=True)
    add("categories", cmd_categories, store=False)
    return top


def main(arguments: list[str] | None = None) -> int:
    args = parser().parse_args(arguments)
    try:
        if getattr(args, "statement", None) and "://" not in args.statement and not Path(args.statement).exists():
            raise UserError(f"no such file: {args.statement}")
        if getattr(args, "category", None) and fixed.FROM_LEGACY.get(args.category.strip().lower()) is None and args.category.strip().upper().replace(" ", "_").replace("-", "_") not in fixed.CATEGORIES:
            raise UserError(f"unknown category: {args.category}")
        args.run(args)
    except (UserError, UnresolvedHeaders, scoring.LabelError) as err:
        print(f"error: {err}", file=sys.stderr)
        return 2
    except Exception as err:
        if "UnresolvedHeaders" in str(err):
            print("error: the statement has no date or counterparty column", file=sys.stderr)
            return 2
        raise
    return 0


if __name__ == "__main__":
    sys.exit(main())
