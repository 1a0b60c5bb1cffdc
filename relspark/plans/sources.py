"""SRC queries: the readers and adapters over JSON made from the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import ledger
from ..operators import quantised as Q
from ..sources import records as S
from ..sources.tables import hits, table
from ..staging import own_folder
from .reliability import query


def parsed(df: DataFrame, value, schema: str) -> DataFrame:
    """Records of JSON; texts of any length (the parser would stop at 20 million characters)."""
    return df.select(F.from_json(value, schema, {"mode": "FAILFAST", "maxStringLen": str(2**31 - 1)}).alias("r")).select("r.*")


@query("src01_src04_corpus_reader", "SELECT cast(doc_id AS string) AS id, text, CASE WHEN doc_id % 3 = 0 THEN 'unknown' ELSE source END AS source FROM documents")
def _(s, d):
    """JSON lines with text under any of its names; empty and null texts stay, under any id or none."""
    k, t = F.coalesce(F.pmod("doc_id", F.lit(3)), F.lit(2)), F.col("text")
    j = F.to_json(F.struct(F.when(k != 1, F.col("doc_id").cast("string")).alias("id"), F.when(k == 1, F.col("doc_id").cast("string")).alias("doc_id"), F.when(k == 0, t).when((k == 1) & t.isNotNull(), "").alias("text"), F.when(k == 1, t).alias("content"), F.when(k == 2, t).alias("document"), F.when(k != 0, F.col("source")).alias("source")))
    return S.corpus_documents(parsed(table(s, d, "documents"), j, S.DOCUMENT), required=False)


@query("src03_benchmark_reader", "SELECT cast(item_id AS string) AS id, text AS prompt, cast(NULL AS string) AS answer, cast(NULL AS string) AS parent_id, 'original' AS variant_type FROM benchmark")
def _(s, d):
    k, t = F.col("item_id") % 3, F.col("text")
    j = F.to_json(F.struct(F.col("item_id").cast("string").alias("uid"), F.when(k == 0, t).alias("prompt"), F.when(k == 1, t).alias("question"), F.when(k == 2, t).alias("input")))
    return S.benchmark_items(parsed(table(s, d, "benchmark"), j, S.ITEM))


@query("src05_generation_reader", "SELECT cast(doc_id AS string) AS benchmark_id, text AS completion, 'unknown' AS model FROM documents WHERE text <> ''")
def _(s, d):
    k, t = F.col("doc_id") % 2, F.col("text")
    j = F.to_json(F.struct(F.col("doc_id").cast("string").alias("id"), F.when(k == 0, t).alias("prediction"), F.when(k == 1, t).alias("response")))
    return S.generations(parsed(table(s, d, "documents").where("text <> ''"), j, S.GENERATION))


def folder(s: SparkSession) -> str:
    """A folder of its own among the shared ones."""
    return f"{own_folder(s)}/files-{uuid.uuid4().hex}"


@query("src02_jsonl_sink_source", "SELECT n_nationkey::BIGINT AS k, n_name AS name FROM nation")
def _(s, d):
    """Written as sorted JSON lines to the shared folder and read again."""
    path = folder(s)
    S.write_lines(table(s, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("k"), F.col("n_name").alias("name")), path)
    return S.read_lines(s, path, "k bigint, name string")


@query("src06_strict_loader", "SELECT benchmark_id, label, score, CASE WHEN benchmark_id LIKE '%7' THEN source END AS source FROM {hits}")
def _(s, d):
    """Hits from JSON lines by a strict reader: every field known, every required one there."""
    h = hits(s, d).withColumn("source", F.when(F.col("benchmark_id").endswith("7"), F.col("source")))
    lines = h.select(F.to_json(F.struct("benchmark_id", "label", "score", "source")).alias("value"))
    return S.strict(lines, {"benchmark_id": "string", "label": "string", "score": "double"}, {"source": "string"})


@query("src23_shard_stream", "SELECT lang, count(*) AS n, sum(CASE WHEN lang < 'f' THEN n_chars ELSE 0 END)::BIGINT AS chars FROM documents GROUP BY 1")
def _(s, d):
    """Compressed shards by language, some of which lack a field, read line by line."""
    path, t = folder(s), table(s, d, "documents")
    line = F.to_json(F.struct("doc_id", F.when(F.col("lang") < "f", F.col("n_chars")).alias("n_chars")))
    t.select("lang", line.alias("value")).write.partitionBy("lang").option("compression", "gzip").text(path)
    rows = S.read_shards(s, f"{path}/*/*.gz", "doc_id long, n_chars long")
    langs = t.select("doc_id", "lang")
    return rows.join(langs, "doc_id").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n_chars"), F.lit(0)).alias("chars"))


@query("src07_score_union", "SELECT r_name AS id, 'all' AS model, 0::BIGINT AS n FROM region UNION ALL SELECT n_name, 'm', n_regionkey::BIGINT FROM nation")
def _(s, d):
    a = table(s, d, "region").select(F.col("r_name").alias("id"))
    b = table(s, d, "nation").select(F.col("n_name").alias("id"), F.lit("m").alias("model"), F.col("n_regionkey").cast("bigint").alias("n"))
    return S.score_union([b, a], {"model": "all", "n": 0})


def payloads(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "conversations")
    m = F.struct("turn", F.col("role"), F.when(F.col("turn") % 3 != 1, F.col("text")).alias("content"), F.when(F.col("turn") % 3 == 1, F.col("text")).alias("value"), F.lit(None).cast("string").alias("text"))
    return c.groupBy("conv_id").agg(F.sort_array(F.collect_list(m)).alias("messages"))


@query("src08_chat_text", "SELECT conv_id, coalesce(string_agg(text, ' ' ORDER BY turn) FILTER (WHERE turn % 3 <> 1 AND text <> ''), '') AS text FROM conversations GROUP BY 1")
def _(s, d):
    return payloads(s, d).select("conv_id", S.chat_text(F.col("messages")).alias("text"))


@query("src09_row_text", "SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) FILTER (WHERE text <> '') AS text FROM conversations GROUP BY 1")
def _(s, d):
    return payloads(s, d).select("conv_id", S.row_text(F.col("messages"), F.lit("none")).alias("text"))


@query("src10_flt08_corpus_rows", """WITH r AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN trim(left(text, 20) || ' ' || right(text, 20)) ELSE trim(' ' || lower(left(text, 30))) END AS t FROM documents), n AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS n FROM r WHERE t <> '')
SELECT 'org_set_' || CASE WHEN n < 10000000 THEN lpad(n::VARCHAR, 7, '0') ELSE n::VARCHAR END AS id, t AS text, 'org/set' AS source FROM n WHERE n < 300""")
def _(s, d):
    """A prefix of a dataset whose rows have their text, a problem and a solution, or chat messages."""
    k, t = F.col("doc_id") % 3, F.col("text")
    said = F.array(F.struct(F.lit("user").alias("role"), F.lit("").alias("content")), F.struct(F.lit("assistant").alias("role"), F.lower(F.left(t, F.lit(30))).alias("content")))
    raw = table(s, d, "documents").select("doc_id", F.when(k == 0, t).alias("text"), F.when(k == 1, F.left(t, F.lit(20))).otherwise("").alias("problem"), F.when(k == 1, F.right(t, F.lit(20))).otherwise("").alias("solution"), F.when(k == 2, said).alias("messages"))
    raw = raw.withColumns({"problem": F.nullif("problem", F.lit("")), "solution": F.nullif("solution", F.lit(""))})
    return S.corpus_rows(raw, "org/set", "doc_id", limit=300)


@query("src27_append_resume", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 2 END AS round FROM orders")
def _(s, d):
    """A sink that was stopped after a third of its rows and started again with all of them, twice each."""
    path, o = folder(s), table(s, d, "orders").select(F.col("o_orderkey").alias("id"))
    ledger.append_once(o.where("id % 3 = 0").withColumn("round", F.lit(1)), path, "id")
    return ledger.append_once(o.union(o).withColumn("round", F.lit(2)), path, "id")


@query("src11_benchmark_registry", "SELECT * FROM (VALUES ('gsm8k', 'arithmetic'), ('gsm8k_train', 'arithmetic'), ('gsm_symbolic', 'arithmetic'), ('gsm_symbolic_p1', 'arithmetic'), ('gsm_symbolic_p2', 'arithmetic'), ('math', 'mathematical'), ('arc_challenge', 'scientific'), ('logiqa2', 'logical'), ('bbh', 'multi_step'), ('reclor', 'logical'), ('humaneval', 'code')) t(name, skill)")
def _(s, d):
    return s.createDataFrame([(b.name, b.skill) for b in S.BENCHMARKS.values()], "name string, skill string")


@query("src13_gsm8k_adapter", "SELECT 'gsm8k_' || printf('%05d', row_number() OVER (ORDER BY item_id) - 1) AS id, (item_id * 1000)::VARCHAR AS answer FROM benchmark")
def _(s, d):
    raw = table(s, d, "benchmark").withColumn("a", F.concat(F.col("text"), F.lit("\n#### "), F.format_number(F.col("item_id") * 1000, 0)))
    return S.numbered(raw, ["item_id"], "gsm8k_").select("id", S.gsm8k_answer(F.col("a")).alias("answer"))


@query("src14_win09_interleave", "SELECT place, lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (ORDER BY n, lang) - 1 AS place FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n FROM documents)) WHERE place < 70")
def _(s, d):
    return S.interleaved(table(s, d, "documents").select("lang", "doc_id"), "lang", "doc_id", 70).select(F.col("place").cast("bigint"), "lang", "doc_id")


@query("src15_src16_src18_options", "SELECT p_partkey, 'A. ' || p_name || chr(10) || 'B. ' || lower(p_type) AS rendered, CASE WHEN p_partkey % 5 > 0 THEN chr((64 + p_partkey % 5)::INT) END AS answer FROM part")
def _(s, d):
    """A label under zero has no answer."""
    p = table(s, d, "part")
    return p.select("p_partkey", S.options(F.array("p_name", F.lower("p_type"))).alias("rendered"), S.letter(F.col("p_partkey") % 5 - 1).alias("answer"))


@query("src17_src19_src21_plain_adapters", "SELECT 'bbh_' || printf('%05d', row_number() OVER (ORDER BY item_id) - 1) AS id, text AS prompt, cast(NULL AS string) AS answer FROM benchmark")
def _(s, d):
    return S.numbered(table(s, d, "benchmark"), ["item_id"], "bbh_").select("id", F.col("text").alias("prompt"), F.lit(None).cast("string").alias("answer"))


@query("src20_templates", "SELECT 't' || o_custkey AS id, o_custkey AS template_id, 'original' AS variant_type FROM orders GROUP BY o_custkey UNION ALL SELECT 't' || o_custkey || '_' || o_orderkey, o_custkey, 'gsm_symbolic_official' FROM orders")
def _(s, d):
    return S.templates(table(s, d, "orders").select(F.col("o_custkey").alias("template_id"), F.col("o_orderkey").alias("instance")))


@query("src22_cap_per_parent", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderkey % 6 = 0 ORDER BY o_orderkey) AS n FROM orders) WHERE o_orderkey % 6 = 0 OR n <= 2")
def _(s, d):
    o = table(s, d, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 6 == 0, "original").otherwise("v").alias("variant_type"))
    return S.capped(o, "o_custkey", "o_orderkey", 2).select("o_custkey", "o_orderkey")


@query("src24_column_scan", "SELECT source, count(*) AS n, sum(length(text))::BIGINT AS chars FROM documents GROUP BY 1")
def _(s, d):
    return table(s, d, "documents").select("source", "text").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@query("src25_review_sample", "SELECT parent, id, verdict, note FROM (SELECT o_custkey AS parent, o_orderkey AS id, '' AS verdict, o_orderpriority || ', \"quoted\"' AS note, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders) WHERE k <= 3")
def _(s, d):
    """At most three rows of each parent as a CSV sheet for reviewers, read back as they will send it."""
    w = Window.partitionBy("parent").orderBy("id")
    o = table(s, d, "orders").select(F.col("o_custkey").alias("parent"), F.col("o_orderkey").alias("id"), F.lit("").alias("verdict"), F.concat("o_orderpriority", F.lit(', "quoted"')).alias("note"))
    path = folder(s)
    S.write_sheet(o.withColumn("k", F.row_number().over(w)).where("k <= 3").drop("k"), path)
    return S.read_sheet(s, path, f"parent {dict(o.dtypes)['parent']}, id {dict(o.dtypes)['id']}, verdict string, note string")


@query("flt14_template_review", "SELECT o_custkey AS parent, bool_or(o_orderkey % 7 = 0) AS rejected FROM orders GROUP BY 1")
def _(s, d):
    """Reviewers' sheets: one bad verdict rejects the parent."""
    path = folder(s)
    S.write_sheet(table(s, d, "orders").select(F.col("o_custkey").alias("parent"), F.when(F.col("o_orderkey") % 7 == 0, " Bad").otherwise("good").alias("verdict")), path)
    return S.reviewed(S.read_sheet(s, path, "parent bigint, verdict string"))


@query("src26_vector_index_roundtrip", "SELECT vec_id AS query, x AS neighbor, rank FROM (SELECT q.vec_id, n.vec_id AS x, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], n.embedding::DOUBLE[]), 9) DESC, n.vec_id)::INT AS rank FROM embeddings q, embeddings n WHERE q.vec_id % 100 = 0) WHERE rank <= 3")
def _(s, d):
    """An index saved with its lists, loaded again, and searched through the loaded codes of all lists; the best three stand exactly."""
    e = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    path = folder(s)
    Q.save(e, Q.fit(e), path)
    index, codec = Q.load(s, path)
    return Q.search(e.where("id % 100 = 0"), index, codec, 3, rerank=40).select("query", "neighbor", "rank")


@query("num09_safe_arithmetic", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE round((o_custkey + o_orderkey * 2) / 4.0::DOUBLE - (o_custkey // 7) + (o_orderkey % 11), 6) END AS value FROM orders")
def _(s, d):
    """Expressions read and computed without running them; every fifth one is no arithmetic."""
    from ..operators.variants import evaluated

    c, k = F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string")
    e = F.concat(F.lit("("), c, F.lit(" + "), k, F.lit("*2)/4 - "), c, F.lit("//7 + "), k, F.lit("%11"))
    o = table(s, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("print("), k, F.lit(")"))).otherwise(e).alias("e"))
    return o.select("o_orderkey", evaluated(F.col("e")).alias("value"))
