"""Command line: python -m siftstone.cli dedup|inspect ..."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from siftstone.cluster import ship_package
from siftstone.params import PLAIN, STRIPPED
from siftstone.plans import report
from siftstone.plans.dedup import deduplicate, deduplicate_stripped
from siftstone.sources.tables import inspect, limited, read_documents, require_unique, write_pairs_csv, write_parquet


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="siftstone")
    sub = p.add_subparsers(dest="command", required=True)
    d = sub.add_parser("dedup", help="remove near-duplicate documents")
    look = sub.add_parser("inspect", help="schema, columns, three rows, row count")
    for s in (d, look):
        s.add_argument("--input", required=True, help="paths or globs, separated by commas")
        s.add_argument("--input-format", choices=["parquet", "jsonl"], default="parquet")
        s.add_argument("--id-column", default="id")
        s.add_argument("--text-column", default="text")
    d.add_argument("--output", required=True)
    d.add_argument("--preset", choices=["plain", "stripped"], default="plain")
    d.add_argument("--threshold", type=float)
    d.add_argument("--num-perm", type=int)
    d.add_argument("--ngram-size", type=int)
    d.add_argument("--seed", type=int)
    d.add_argument("--bands", type=int, help="with --rows; else both follow from threshold and permutations")
    d.add_argument("--rows", type=int)
    d.add_argument("--keep-case", action="store_true", help="do not lower-case")
    d.add_argument("--ignore-pattern", help="regular expression; what it matches is deleted before hashing")
    d.add_argument("--tokenizer", choices=["character", "punctuation", "space"])
    d.add_argument("--short-docs", choices=["merge", "keep"])
    d.add_argument("--id-order", choices=["native", "string"])
    d.add_argument("--max-cc-iterations", type=int)
    d.add_argument("--limit", type=int)
    d.add_argument("--parallelism", type=int, help="shuffle partitions; AQE merges small ones")
    d.add_argument("--band-checkpoint", help="folder to read bands from, or to write them to")
    d.add_argument("--check-unique", action="store_true")
    d.add_argument("--dump-pairs", help="folder for a CSV of links")
    d.add_argument("--cluster-samples", action="store_true")
    d.add_argument("--size-distribution", action="store_true")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("siftstone").getOrCreate()
    ship_package(spark)
    docs = read_documents(spark, args.input, args.input_format, args.id_column, args.text_column)
    if args.command == "inspect":
        for key, value in inspect(docs, args.id_column).items():
            print(f"{key}: {value}")
        return 0
    if args.parallelism:
        spark.conf.set("spark.sql.shuffle.partitions", args.parallelism)
    if (args.bands is None) != (args.rows is None):
        raise SystemExit("--bands and --rows go together")
    named = {
        "threshold": args.threshold, "num_perm": args.num_perm, "ngram": args.ngram_size, "seed": args.seed, "tokenizer": args.tokenizer, "short_docs": args.short_docs, "id_order": args.id_order,
        "max_iterations": args.max_cc_iterations, "bands": args.bands, "rows": args.rows, "ignore_pattern": args.ignore_pattern, "lowercase": False if args.keep_case else None,
    }
    params = (PLAIN if args.preset == "plain" else STRIPPED).with_(**{k: v for k, v in named.items() if v is not None})
    docs = limited(docs, args.id_column, args.limit)
    if args.check_unique:
        require_unique(docs, args.id_column)
    run = deduplicate if args.preset == "plain" else deduplicate_stripped
    result = run(docs, args.id_column, args.text_column, params, args.band_checkpoint)
    write_parquet(result.kept, args.output)
    if args.dump_pairs:
        write_pairs_csv(result.links, args.dump_pairs)
    if args.size_distribution:
        report.cluster_sizes(result.clusters).orderBy("cluster_size").show(1000)
    if args.cluster_samples:
        report.cluster_samples(result.clusters).orderBy("root", "doc_id").show(1000)
    report.metrics(docs, result.removed).show()
    return 0


if __name__ == "__main__":
    sys.exit(main())
