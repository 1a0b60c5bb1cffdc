"""Command line: python -m relspark.cli COMMAND ... Inputs are JSON lines of records or Parquet tables, outputs Parquet tables."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import catalog, report, staging, workflow
from .functions import text as T
from .operators import containment, reliability, splits, studies, variants, vectors
from .session import session
from .sources import records

#: Command -> its arguments; "--x" are options (a value follows), "--x?" flags.
COMMANDS = {
    "list-queries": "", "query": "name sf_dir", "run-all": "config",
    "scan-contamination": "benchmark corpus output --ngram --union?", "scan-lexical": "benchmark corpus output --top-k", "scan-embedding": "benchmark corpus output --top-k --dims",
    "load-benchmark": "benchmark output --limit --max-per-parent", "load-corpus": "corpus output --limit",
    "score-generations": "benchmark generations output", "check-generations": "generations output", "check-termination": "generations output --min-rate",
    "attribute": "containment scores output", "attribute-embedding": "benchmark corpus output --top-k",
    "make-variants": "benchmark output --types --no-original? --max-variants", "validate-variants": "variants output", "make-resample-suite": "benchmark output --n-samples",
    "export-templates": "variants output --per-template", "apply-template-review": "variants review output",
    "calibrate": "scored output --thresholds", "validate-reliability": "scores genuine output",
    "accuracy-gap": "scores labels output --no-per-benchmark? --no-per-model?", "atlas": "scores labels output --markdown?", "emergence": "scores small large output",
    "memorization": "scores output --n-bootstrap", "build-splits": "pool per_arm output", "report": "table title",
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="relspark")
    sub = p.add_subparsers(dest="command", required=True)
    for name, args in COMMANDS.items():
        one = sub.add_parser(name)
        for a in args.split():
            one.add_argument(a.rstrip("?"), **({"action": "store_true"} if a.endswith("?") else {}))
    return p


def embedded(df: DataFrame, text: str, dims: int) -> DataFrame:
    """(id long, name, embedding) of a text column by hashed character grams."""
    own = df.select(F.xxhash64("id").alias("id"), F.col("id").alias("name"), F.col(text).alias("text"))
    return staging.staged(vectors.embedded_texts(own, dims).join(own.select("id", "name"), "id"), "embedded")


def neighbours(items: DataFrame, docs: DataFrame, k: int, dims: int) -> DataFrame:
    """item, doc, cosine, overlap, label: nearest documents by embedding, reranked by their share of the item's grams."""
    q, x = embedded(items, "prompt", dims), embedded(docs, "text", dims)
    near = vectors.top_k(q, x, k).join(q.select(F.col("id").alias("query"), F.col("name").alias("item")), "query").join(x.select(F.col("id").alias("neighbor"), F.col("name").alias("doc")), "neighbor")
    shared = containment.matches(containment.grams(items, "prompt"), docs, short=True).select("item", "doc", (F.col("n_shared") / F.col("n_grams")).alias("overlap"))
    near = near.join(shared, ["item", "doc"], "left").withColumn("overlap", F.coalesce("overlap", F.lit(0.0)))
    return near.select("item", "doc", "cosine", "overlap", workflow.R.contamination_label(F.col("cosine"), F.col("overlap")).alias("label"))


def result(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """The table that a command writes."""
    lines = lambda path, schema: records.read_lines(spark, path, schema)
    items = lambda: records.benchmark_items(lines(a.benchmark, records.ITEM))
    docs = lambda: records.corpus_documents(lines(a.corpus, records.DOCUMENT))
    gens = lambda: records.generations(lines(a.generations, records.GENERATION))
    table, number = spark.read.parquet, lambda v, default: default if v is None else type(default)(v)
    match a.command:
        case "scan-contamination":
            return (containment.containment_union if a.union else containment.containment_max)(items(), docs(), number(a.ngram, 13))
        case "scan-lexical":
            return containment.lexical_scan(items(), docs(), number(a.top_k, 5))
        case "scan-embedding":
            return neighbours(items(), docs(), number(a.top_k, 20), number(a.dims, vectors.DIMS)).where("label <> 'clean'")
        case "attribute-embedding":
            n = neighbours(items(), docs(), number(a.top_k, 20), vectors.DIMS)
            return n.groupBy("item").agg(F.count(F.lit(1)).alias("n_neighbors"), F.avg("cosine").alias("mean_cosine"), F.max("cosine").alias("top1_cosine"), F.avg((F.col("cosine") >= 0.85).cast("int")).alias("near_duplicate_share"))
        case "load-benchmark":
            own = items()
            own = records.capped(own, "parent_id", "id", int(a.max_per_parent)) if a.max_per_parent else own
            return own.orderBy("id").limit(int(a.limit)) if a.limit else own
        case "load-corpus":
            return docs().orderBy("id").limit(int(a.limit)) if a.limit else docs()
        case "score-generations":
            return workflow.score(items(), gens())
        case "check-generations":
            return gens().select("benchmark_id", T.degenerate(F.col("completion")).alias("q")).select("benchmark_id", "q.*").where("degenerate")
        case "check-termination":
            g = gens().withColumns({"finished": T.finished(F.col("completion"), T.after_hash(F.col("completion")).isNotNull() | T.boxed_balanced(F.col("completion")).isNotNull(), 0), "value": F.length("completion")})
            return studies.termination(g, "value", number(a.min_rate, studies.RATE))
        case "attribute":
            return workflow.attribution(table(a.containment), table(a.scores))
        case "make-variants":
            kinds = a.types.split(",") if a.types else None
            out = variants.suite(items())
            keep = F.lit(True) if kinds is None else F.col("variant_type").isin("original", *kinds)
            out = out.where(keep & ((F.col("variant_type") != "original") | F.lit(not a.no_original)))
            return records.capped(out, "parent_id", "id", int(a.max_variants)) if a.max_variants else out
        case "validate-variants":
            return studies.validated_variants(table(a.variants))
        case "make-resample-suite":
            return variants.resample(items(), number(a.n_samples, 5))
        case "apply-template-review":
            sheet = records.reviewed(records.read_sheet(spark, a.review, "parent_id string, id string, prompt string, answer string, verdict string").withColumnRenamed("parent_id", "parent"))
            bad = sheet.where("rejected").select(F.col("parent").alias("parent_id"))
            return table(a.variants).join(bad, "parent_id", "left_anti")
        case "calibrate":
            return studies.calibrated(table(a.scored), [float(x) for x in (a.thresholds or "0.5,0.6,0.7,0.8,0.9").split(",")])
        case "validate-reliability":
            known = table(a.genuine).select("parent_id").distinct().withColumn("known", F.lit(True))
            return studies.metric_validation(table(a.scores).join(known, "parent_id", "left").withColumn("parent_id", F.concat(F.when(F.col("known"), "+").otherwise("-"), "parent_id")), F.col("parent_id").startswith("+"))
        case "accuracy-gap":
            labelled = reliability.with_labels(table(a.scores), reliability.strongest_labels(table(a.labels)))
            return reliability.accuracy_gap(labelled, not a.no_per_benchmark, not a.no_per_model)
        case "atlas":
            return reliability.atlas(table(a.scores), reliability.strongest_labels(table(a.labels)))
        case "emergence":
            return workflow.emergence(table(a.scores), a.small, a.large)
        case "memorization":
            return reliability.did(table(a.scores), ["model"], number(a.n_bootstrap, 4000))
        case "build-splits":
            return splits.matched(table(a.pool), int(a.per_arm))
    raise ValueError(a.command)


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "list-queries":
        print("\n".join(catalog.queries()))
        return 0
    spark = session()
    match a.command:
        case "query":
            catalog.queries()[a.name](spark, a.sf_dir).show(50, truncate=False)
        case "run-all":
            workflow.run(spark, workflow.Config.load(a.config))
        case "report":
            print(report.report(a.title, {"Rows": spark.read.parquet(a.table)}))
        case "export-templates":
            w = F.row_number().over(reliability.Window.partitionBy("parent_id").orderBy("id"))
            rows = spark.read.parquet(a.variants).where("variant_type <> 'original'").withColumn("_k", w).where(F.col("_k") <= int(a.per_template or 3))
            records.write_sheet(rows.select("parent_id", "id", "prompt", "answer", F.lit("").alias("verdict")), a.output)
        case _:
            result(spark, a).write.mode("overwrite").parquet(a.output)
            rows = spark.read.parquet(a.output)
            if a.command == "build-splits" and rows.isEmpty() or a.command == "check-termination" and not rows.where("not passes").isEmpty():
                return 1
            if a.command == "atlas" and a.markdown:
                print(report.atlas_report(rows))
    return 0


if __name__ == "__main__":
    sys.exit(main())
