"""Command line: run a registered query to Parquet or TSV, skip it if done, or validate output lists.

    python -m linkweave.cli run met_macro --data /data/sf0.1 --out /data/out/met_macro
    python -m linkweave.cli check --matches matches.tsv --candidates candidates.tsv --records s1.tsv --pool s2.tsv s3.tsv
"""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from linkweave.operators import validate
from linkweave.plans import registry
from linkweave.sources import tsv


def done(spark: SparkSession, out: str, settings: dict) -> bool:
    """True if ``out`` has a manifest with these settings."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/manifest.json")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return False
    kept = json.loads("".join(r.value for r in spark.read.text(f"{out}/manifest.json").collect()))
    return kept.get("settings") == settings


def _manifest(spark: SparkSession, out: str, content: dict) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/manifest.json")
    stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
    stream.write(bytearray(json.dumps(content).encode()))
    stream.close()


def run(spark: SparkSession, name: str, data: str, out: str, as_tsv: bool = False) -> bool:
    """Writes a query's rows with a manifest of settings, seconds and row count; False where that was done before."""
    settings = {"query": name, "data": data, "tsv": as_tsv}
    if done(spark, out, settings):
        return False
    began = time.time()
    df = registry.queries()[name](spark, data)
    if as_tsv:
        tsv.write_tsv(df, f"{out}/rows")
    else:
        df.write.mode("overwrite").parquet(f"{out}/rows")
    rows = spark.read.text(f"{out}/rows").count() - 1 if as_tsv else spark.read.parquet(f"{out}/rows").count()
    _manifest(spark, out, {"settings": settings, "seconds": round(time.time() - began, 3), "rows": rows})
    return True


def stages(spark: SparkSession, names: list[str], data: str, out: str) -> list[tuple[str, bool]]:
    """Runs queries in order, each to its own folder; (name, whether it ran) of each."""
    return [(name, run(spark, name, data, f"{out}/{name}")) for name in names]


def compare(spark: SparkSession, left: str, right: str) -> tuple[int, int]:
    """Rows that only one of two outputs of a query has."""
    a, b = spark.read.parquet(f"{left}/rows"), spark.read.parquet(f"{right}/rows")
    return a.exceptAll(b).count(), b.exceptAll(a).count()


def check(spark: SparkSession, matches: str, candidates: str, records: str, pool: list[str], header: str | None = None) -> list[tuple[str, int]]:
    """Every broken rule with its number; matches outside the candidates are a warning and named so. ``header``: expected of both files, else each one's first line."""
    ids = lambda p: spark.read.text(p).select(F.split("value", "\t")[0].alias("entity_id")).filter("entity_id <> 'entity_id'")
    known = ids(pool[0])
    for p in pool[1:]:
        known = known.unionByName(ids(p))
    parts = F.split("value", "\t", 2)
    lines = spark.read.text(candidates)
    pairs = lines.select(parts[0].alias("s1"), F.explode(F.split(F.get(parts, F.lit(1)), ",")).alias("cand"))
    found = []
    for name, path, allowed in (("matches", matches, pairs), ("candidates", candidates, None)):
        rows = spark.read.text(path)
        first = rows.first()
        for r in validate.check(rows, header or (first[0] if first else ""), ids(records), known, allowed).collect():
            if r.n:
                found.append(("warning: matches outside the candidates" if r.rule == "outside" else f"{name}: {r.rule}", r.n))
    return found


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="linkweave")
    sub = p.add_subparsers(dest="what", required=True)
    r = sub.add_parser("run")
    r.add_argument("query")
    r.add_argument("--data", required=True)
    r.add_argument("--out", required=True)
    r.add_argument("--tsv", action="store_true")
    g = sub.add_parser("stages")
    g.add_argument("queries", nargs="+")
    g.add_argument("--data", required=True)
    g.add_argument("--out", required=True)
    o = sub.add_parser("compare")
    o.add_argument("left")
    o.add_argument("right")
    v = sub.add_parser("check")
    for name in ("matches", "candidates", "records"):
        v.add_argument(f"--{name}", required=True)
    v.add_argument("--pool", nargs="+", required=True)
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("linkweave").getOrCreate()
    if a.what == "run":
        print("written" if run(spark, a.query, a.data, a.out, a.tsv) else "done before")
        return 0
    if a.what == "stages":
        for name, ran in stages(spark, a.queries, a.data, a.out):
            print(f"{name}: {'written' if ran else 'done before'}")
        return 0
    if a.what == "compare":
        only = compare(spark, a.left, a.right)
        print(f"only left: {only[0]}, only right: {only[1]}")
        return int(any(only))
    found = check(spark, a.matches, a.candidates, a.records, a.pool)
    for rule, n in found:
        print(f"{rule}: {n}")
    errors = [f for f in found if not f[0].startswith("warning")]
    print("FAIL" if errors else "PASS")
    return 1 if errors else 0


if __name__ == "__main__":
    sys.exit(main())
