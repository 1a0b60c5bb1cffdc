"""The whole study over DataFrames: scan, quality and accuracy gates, scores, gaps, atlas, memorisation, attribution and emergence.

Each stage is a table, so a run resumes where it stopped.
"""

from __future__ import annotations

import hashlib
import json
import platform
import subprocess
from collections.abc import Callable
from dataclasses import asdict, dataclass, fields
from pathlib import Path

import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import answers as A
from .functions import rules as R
from .functions import text as T
from .operators import containment, reliability, variants
from .report import report
from .sources import records


@dataclass(frozen=True)
class Config:
    benchmark: str
    corpus: str
    generations: str
    output: str
    ngram: int = 13
    bootstrap: int = reliability.REPS
    seed: int = reliability.SEED
    per_benchmark: bool = True
    per_model: bool = True
    max_degenerate: float = 0.5
    min_accuracy: float = 0.0
    expand_variants: bool = False
    small_model: str | None = None
    large_model: str | None = None

    @classmethod
    def load(cls, path: str | Path) -> Config:
        """From YAML or JSON, flat or with one level of sections; unknown keys raise."""
        text = Path(path).read_text()
        try:
            import yaml

            raw = yaml.safe_load(text) or {}
        except ImportError:
            raw = json.loads(text)
        flat: dict[str, object] = {}
        for k, v in raw.items():
            flat |= v if isinstance(v, dict) else {k: v}
        if unknown := set(flat) - {f.name for f in fields(cls)}:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return cls(**flat)


def provenance(config: Config) -> dict:
    """What a run was made with."""
    git = subprocess.run(["git", "rev-parse", "HEAD"], capture_output=True, text=True, cwd=Path(__file__).parent)
    digest = hashlib.sha256(json.dumps(asdict(config), sort_keys=True).encode()).hexdigest()
    return {"config": asdict(config), "config_sha256": digest, "commit": git.stdout.strip() or None, "python": platform.python_version(), "spark": pyspark.__version__}


def _files(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def fingerprint(spark: SparkSession, config: Config) -> str:
    """What a run's stages depend on: the settings and the inputs' files with their lengths and times."""
    found = []
    for path in (config.benchmark, config.corpus, config.generations):
        p, fs = _files(spark, path)
        found += [(str(f.getPath()), f.getLen(), f.getModificationTime()) for f in fs.globStatus(p) or []]
    return hashlib.sha256(json.dumps([asdict(config), found], sort_keys=True).encode()).hexdigest()


def stage(spark: SparkSession, path: str, make: Callable[[], DataFrame], key: str = "") -> DataFrame:
    """The table at path, made once for each key; one that stands for another key, or was not ended, is made again."""
    mark = f"{path}.key"
    ended = all(fs.exists(p) for p, fs in (_files(spark, f"{path}/_SUCCESS"), _files(spark, f"{mark}/_SUCCESS")))
    if not ended or [r[0] for r in spark.read.text(mark).collect()] != [key or "-"]:
        p, fs = _files(spark, mark)
        fs.delete(p, True)
        make().write.mode("overwrite").parquet(path)
        spark.createDataFrame([(key or "-",)], "value string").coalesce(1).write.text(mark)
    return spark.read.parquet(path)


def score(items: DataFrame, generations: DataFrame) -> DataFrame:
    """Evaluation records: answers extracted by the item's kind and compared; a generation without an item raises.

    Items may name their benchmark, skill, arm and stratum; those that do not are of benchmark and skill "all", no arm and stratum 0.
    """
    has = lambda c, default: F.coalesce(F.col(c), F.lit(default)) if c in items.columns else F.lit(default)
    arm = F.col("arm") if "arm" in items.columns else F.lit(None).cast("string")
    own = items.select(F.col("id").alias("benchmark_id"), "answer", F.coalesce("parent_id", "id").alias("parent_id"), "variant_type", has("benchmark", "all").alias("benchmark"), has("skill", "all").alias("skill"), arm.alias("arm"), has("stratum", 0).cast("int").alias("stratum"))
    df = generations.join(own.withColumn("_known", F.lit(True)), "benchmark_id", "left")
    known = F.coalesce("_known", F.lit(False)) | F.raise_error(F.lit("a generation without an item")).cast("boolean")
    choices = F.lit(False)
    pred = T.extract_answer(F.col("completion"), T.extractor_for(F.col("benchmark"), F.col("skill"), F.col("answer"), choices))
    right = A.equivalent(F.col("answer"), pred, F.when(F.col("benchmark") == "all", "numeric").otherwise(A.answer_kind(F.col("benchmark"), F.col("skill"), F.col("answer"), choices)))
    return df.where(known).select("benchmark_id", "parent_id", "variant_type", "model", "benchmark", "skill", R.record_arm(F.col("arm")).alias("arm"), T.normalize_answer_text(pred).alias("normalized_predicted"), right.alias("correct"), F.xxhash64("benchmark_id", "completion").alias("seq"), "stratum")


def attribution(hits: DataFrame, scores: DataFrame) -> DataFrame:
    """Influence proxy of each item's containment: 0.8 of its value and 0.2 for a correct answer."""
    ok = scores.groupBy("benchmark_id", "model").agg(F.bool_or("correct").alias("correct"))
    influence = 0.8 * F.col("containment") + 0.2 * F.coalesce(F.col("correct").cast("int"), F.lit(0))
    return hits.withColumnRenamed("item", "benchmark_id").join(ok, "benchmark_id", "left").select("benchmark_id", "model", "containment", influence.alias("influence"))


def emergence(scores: DataFrame, small: str, large: str) -> DataFrame:
    """skill, small, large, delta, transition: how each skill's accuracy moves between two models; a skill that one lacks counts as 0 there."""
    by = lambda m, name: scores.where(F.col("model") == m).groupBy("skill").agg(F.avg(F.col("correct").cast("int")).alias(name))
    both = by(small, "small").join(by(large, "large"), "skill", "full_outer").fillna(0.0, ["small", "large"])
    return both.select("skill", "small", "large", (F.col("large") - F.col("small")).alias("delta"), R.transition_class(F.col("small"), F.col("large")).alias("transition"))


def run(spark: SparkSession, config: Config) -> dict[str, DataFrame]:
    """All stages of a study; tables and a report under config.output. A stage is made again when settings or inputs have changed."""
    key = fingerprint(spark, config)
    at = lambda name: f"{config.output.rstrip('/')}/{name}"
    step = lambda name, make: stage(spark, at(name), make, key)
    raw = records.read_lines(spark, config.benchmark, records.ITEM + ", benchmark string, skill string, arm string, stratum int")
    items = records.benchmark_items(raw, ["benchmark", "skill", "arm", "stratum"])
    docs = records.corpus_documents(records.read_lines(spark, config.corpus, records.DOCUMENT))
    gens = records.generations(records.read_lines(spark, config.generations, records.GENERATION))
    out = {"containment": step("containment", lambda: containment.containment_max(items, docs, config.ngram))}
    if config.expand_variants:
        out["variants"] = step("variants", lambda: variants.suite(items))
    out["quality"] = step("quality", lambda: gens.select("benchmark_id", "model", T.degenerate(F.col("completion")).alias("q")).select("benchmark_id", "model", "q.*"))
    bad = out["quality"].agg(F.avg(F.col("degenerate").cast("int"))).first()[0] or 0.0
    if bad > config.max_degenerate:
        raise ValueError(f"{bad:.0%} of the generations are degenerate")
    out["scores"] = scores = step("scores", lambda: score(items, gens))
    low = [r["model"] for r in scores.groupBy("model").agg(F.avg(F.col("correct").cast("int")).alias("a")).where(F.col("a") < config.min_accuracy).collect()]  # a row a model
    if low:
        raise ValueError(f"accuracy under {config.min_accuracy} suggests that answers are not read: {sorted(low)}")
    labels = out["containment"].select(F.col("item").alias("benchmark_id"), F.when(F.col("verdict") == "seen", "contaminated").when(F.col("verdict") == "ambiguous", "partial").otherwise("clean").alias("label"))
    labelled = reliability.with_labels(scores, labels)
    out |= {
        "reliability": step("reliability", lambda: reliability.clusters(scores)),
        "gap": step("gap", lambda: reliability.accuracy_gap(labelled, config.per_benchmark, config.per_model)),
        "stratified_gap": step("stratified_gap", lambda: reliability.stratified_gap(labelled, ["model"], config.bootstrap, config.seed)),
        "atlas": step("atlas", lambda: reliability.atlas(scores, labels, config.bootstrap, config.seed)),
        "memorization": step("memorization", lambda: reliability.did(scores, ["model"], config.bootstrap, config.seed)),
        "attribution": step("attribution", lambda: attribution(out["containment"], scores)),
    }
    if config.small_model and config.large_model:
        out["emergence"] = step("emergence", lambda: emergence(scores, config.small_model, config.large_model))
    text = report("Study", {k: out[k] for k in ("gap", "stratified_gap", "atlas", "memorization", "reliability", "emergence") if k in out}, ["clean means not detected", json.dumps(provenance(config), sort_keys=True)])
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(at("report"))
    return out
