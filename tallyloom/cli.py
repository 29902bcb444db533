"""Command line: names in a CSV or text file in, the same rows with predictions out."""

from __future__ import annotations

import argparse
import shutil
import sys
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

from .plans.extractor import Extractor, encoder_batches, load_model
from .plans.predict import predict
from .sources.tables import InputError, read_csv, read_lines, read_lookup, text_column, write_csv


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tallyloom", description="Adds predictions to a file of organisation names.")
    p.add_argument("input", nargs="?", default="-", help="file, - for standard input")
    p.add_argument("--no-header", action="store_true", help="the input has one name a line and no header")
    p.add_argument("-c", "--column", help="column with the names, where there are several")
    p.add_argument("-o", "--output", default="-", help="CSV file, - for standard output")
    p.add_argument("--batch-size", type=int, default=256, help="rows in a batch of the encoder")
    p.add_argument("--model", required=True, help="JSON file of centroids, with the path of a bundle for a trained model")
    p.add_argument("--lookup", help="Parquet table (aff, desig, fnums)")
    p.add_argument("--union-threshold", type=float, default=0.5)
    p.add_argument("--affiliation-threshold", type=float, default=0.80)
    return p


def run(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    if args.no_header and args.column is not None:
        print("error: --no-header cannot be used with -c/--column", file=sys.stderr)
        return 2
    spark = spark or SparkSession.builder.appName("tallyloom").getOrCreate()
    work = Path(tempfile.mkdtemp(prefix="tallyloom-"))  # for standard input and the one output file, on the driver alone
    try:
        path = args.input
        if path == "-":
            path = str(work / "input")
            Path(path).write_bytes(sys.stdin.buffer.read())
        rows = read_lines(spark, path) if args.no_header else read_csv(spark, path)
        names = rows.columns[1:]
        text = names[0] if args.no_header else text_column(names, args.column)
        extractor = Extractor(load_model(args.model), args.union_threshold, args.affiliation_threshold)
        done = predict(rows, extractor, read_lookup(spark, args.lookup) if args.lookup else None, text)
        with encoder_batches(spark, args.batch_size):
            write_csv(done, str(work / "out"))
        parts = sorted((work / "out").glob("part-*"))
        if args.output == "-":
            for part in parts:
                sys.stdout.write(part.read_text())
        else:
            with open(args.output, "wb") as out:
                for part in parts:
                    out.write(part.read_bytes())
    except InputError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    finally:
        shutil.rmtree(work, ignore_errors=True)
    return 0
