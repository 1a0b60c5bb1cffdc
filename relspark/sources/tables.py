"""The driver's tables as the domain's records; each mapping is one list of expressions that Spark and the oracle SQL both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import dealt


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_VALUE = "cast(floor(o_totalprice) as bigint)"
SCORES = {
    "benchmark_id": "cast(o_orderkey as string)",
    "parent_id": "concat('c', cast(o_custkey as string))",
    "variant_type": "case o_orderkey % 6 when 0 then 'original' when 1 then 'entity_substitution' when 2 then 'rephrasing' when 3 then 'resample' when 4 then 'numeric_perturbation' else 'gsm_symbolic' end",
    "model": "concat('m', cast(cast(floor(o_orderkey / 6) as bigint) % 3 as string))",
    "benchmark": "o_orderpriority",
    "skill": "c_mktsegment",
    "arm": "case when c_nationkey % 3 = 0 then 'seen' when c_nationkey % 3 = 1 then 'unseen' end",
    "normalized_predicted": f"cast({_VALUE} % 3 as string)",
    "correct": f"({_VALUE} % 3) <> 0",
    "magnitude_ratio": "case when o_orderkey % 6 >= 4 then 0.5e0 + cast(o_custkey % 100 as double) / 100e0 end",
    "seq": "o_orderkey",
    "value": "cast(o_totalprice as double)",
    "stratum": "cast(o_custkey % 3 as int)",
    "finished": "o_orderstatus <> 'P'",
}
JUDGE = {
    "benchmark_id": "cast(o_orderkey as string)",
    "parent_id": "concat('c', cast(o_custkey as string))",
    "arm": "case when o_custkey % 2 = 0 then 'seen' else 'unseen' end",
    "judge": "concat('j', cast(o_orderkey % 2 as string))",
    "verdict": f"case when o_orderkey % 17 <> 0 then ({_VALUE} % 4) <> 0 end",
    "truth": f"({_VALUE} % 3) <> 0",
    "condition": "case when o_orderkey % 4 < 2 then 'pruned' else 'control' end",
    "stratum": "cast(o_custkey % 5 as int)",
}
HITS = {
    "benchmark_id": "concat('c', cast(c_custkey as string))",
    "label": "case c_custkey % 5 when 0 then 'contaminated' when 1 then 'partial' when 2 then 'clean' when 3 then 'paraphrase_candidate' else 'none' end",
    "source": "cast(c_nationkey as string)",
    "score": "cast(c_custkey % 101 as double) / 100e0",
}
MORE_HITS = HITS | {"label": "case when c_custkey % 7 = 0 then 'near_duplicate' else 'none' end"}
COMPLETIONS = {
    "benchmark_id": "cast(doc_id as string)",
    "gold": "cast(doc_id % 50 as string)",
    "kind": "case doc_id % 4 when 0 then 'numeric' when 1 then 'boxed' when 2 then 'multiple_choice' else 'yes_no' end",
    "completion": r"""concat(text, case doc_id % 8 when 0 then concat(chr(10), '#### ', cast(doc_id % 50 as string)) when 1 then concat('. The answer is $', cast(doc_id % 50 as string), '.') when 2 then concat(' so ', chr(92), 'boxed{', cast(doc_id % 49 as string), '}') when 3 then '. So yes' when 4 then concat('. Final answer: ', cast(doc_id % 50 as string), ',000') when 5 then '. We have not enough information' when 6 then concat(chr(10), 'Question: another 3/4') else '. Option B fits' end)""",
    "lang": "lang",
}


def _mapped(df: DataFrame, exprs: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{e} as {a}" for a, e in exprs.items()])


def _sql(exprs: dict[str, str], source: str) -> str:
    return "(SELECT " + ", ".join(f"{e} AS {a}" for a, e in exprs.items()) + f" FROM {source})"


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", "o_orderstatus")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation records: an order is a scored variant, its customer the parent item."""
    parents = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "c_nationkey")
    return _mapped(orders(spark, sf_dir).join(parents, "o_custkey"), SCORES)


def judge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mapped(orders(spark, sf_dir), JUDGE)


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    parents = table(spark, sf_dir, "customer")
    return _mapped(parents, HITS).unionAll(_mapped(parents, MORE_HITS))


def completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mapped(dealt(table(spark, sf_dir, "documents")), COMPLETIONS)


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("id"), F.col("text").alias("prompt"))


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(table(spark, sf_dir, "documents")).select(F.col("doc_id").cast("string").alias("id"), "text", "source")


SQL = {
    "scores": _sql(SCORES, "orders JOIN customer ON o_custkey = c_custkey"),
    "judge": _sql(JUDGE, "orders"),
    "hits": f"({_sql(HITS, 'customer')} UNION ALL {_sql(MORE_HITS, 'customer')})",
    "completions": _sql(COMPLETIONS, "documents"),
    "items": "(SELECT cast(item_id AS string) AS id, text AS prompt FROM benchmark)",
    "docs": "(SELECT cast(doc_id AS string) AS id, text, source FROM documents)",
}


def sql(body: str) -> str:
    """Oracle SQL with {scores}, {judge}, {hits}, {completions}, {items} and {docs} filled in."""
    for k, v in SQL.items():
        body = body.replace("{" + k + "}", v)
    return body
