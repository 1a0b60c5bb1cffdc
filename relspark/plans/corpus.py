"""CON, JOIN, ATT, IDX and corpus-side AGG and FLT queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions import rules as R
from ..functions import text as T
from ..operators import containment as C
from ..operators import quantised as Q
from ..operators import vectors as V
from ..operators.ranks import running
from ..sources.tables import docs, items, table
from ..staging import dealt, staged
from .reliability import query
from .text_functions import norm_sql, tokens_sql


def grams_sql(x: str, n: int, plain: bool, short: bool = False) -> str:
    """short: fewer than n words are one gram."""
    w = f"regexp_extract_all(lower({x}), '[a-z0-9]+')" if plain else tokens_sql(x)
    return f"list_distinct(list_transform(range(1, greatest(len(w) - {n - 2}, {'least(len(w), 1) + 1' if short else 1})), lambda i: array_to_string(w[i:i+{n - 1}], ' '))) FROM (SELECT *, {w} AS w FROM "


def inverted(plain: bool, n: int = 13, short: bool = False) -> str:
    return f"""WITH ig AS (SELECT id AS item, {grams_sql('prompt', n, plain, short)}{{items}}) t(id, prompt, w)), i AS (SELECT * FROM ig g(item, g)), d AS (SELECT * FROM (SELECT id, {grams_sql('text', n, plain, short)}{{docs}}) t(id, text, source, w)) g(doc, g)),
u AS (SELECT item, unnest(g) AS gram FROM i), v AS (SELECT doc, unnest(g) AS gram FROM d)"""


VERDICT = "CASE WHEN n = 0 THEN 'too_short' WHEN m / n >= 0.8 THEN 'seen' WHEN m / n <= 0.1 THEN 'unseen' ELSE 'ambiguous' END"
MAX = inverted(False) + f", p AS (SELECT item, doc, count(*) AS k FROM u JOIN v USING (gram) GROUP BY ALL), c AS (SELECT item, len(g) AS n, coalesce((SELECT max(k) FROM p WHERE p.item = i.item), 0) AS m FROM i)"
UNION = inverted(True) + ", c AS (SELECT item, len(g) AS n, coalesce((SELECT count(DISTINCT gram) FROM u JOIN v USING (gram) WHERE u.item = i.item), 0) AS m FROM i)"


@query("con04_containment_max", MAX + f" SELECT item, n AS n_grams, m AS n_matched, round(m / n, 6) AS containment, {VERDICT} AS verdict FROM c")
def _(s, d):
    return C.containment_max(items(s, d), docs(s, d))


@query("con03_containment_union", UNION + f" SELECT item, n AS n_grams, m AS n_matched, round(m / n, 6) AS containment, {VERDICT} AS verdict FROM c")
def _(s, d):
    return C.containment_union(items(s, d), docs(s, d))


@query("join05_inverted_index", inverted(False) + " SELECT item, doc, count(*) AS n_shared FROM u JOIN v USING (gram) GROUP BY ALL")
def _(s, d):
    return C.matches(C.grams(items(s, d), "prompt"), docs(s, d), short=True).select("item", "doc", "n_shared")


SHARDED = inverted(False) + ", p AS (SELECT item, doc, count(*) AS k FROM u JOIN v USING (gram) GROUP BY ALL)"


@query("con05_namespaced_sharded", SHARDED + " SELECT 'benchmark:' || item AS item, max(k) AS n_matched, count(DISTINCT lang) AS n_shards FROM p JOIN documents ON doc = cast(doc_id AS string) GROUP BY 1")
def _(s, d):
    """Item sets under their own name space; one pass over all shards (here: languages), merged by maximum."""
    own = C.grams(items(s, d).withColumn("id", F.concat(F.lit("benchmark:"), F.col("id"))), "prompt")
    shard = table(s, d, "documents").select(F.col("doc_id").cast("string").alias("doc"), "lang")
    return C.matches(own, docs(s, d), short=True).join(shard, "doc").groupBy("item").agg(F.max("n_shared").alias("n_matched"), F.count_distinct("lang").alias("n_shards"))


@query("con05_arms_audit", MAX + ", a AS (SELECT *, CASE WHEN item::INT % 2 = 0 THEN 'seen' ELSE 'unseen' END AS arm FROM c) SELECT arm, count(*) AS n, count(*) FILTER (WHERE m / n >= 0.8) AS seen, count(*) FILTER (WHERE m / n <= 0.1) AS unseen, count(*) FILTER (WHERE (arm = 'seen' AND m / n < 0.8) OR (arm = 'unseen' AND m / n > 0.1)) AS misplaced FROM a GROUP BY 1")
def _(s, d):
    """Items of the two arms whose measured containment does not fit the arm they were put in."""
    c = C.containment_max(items(s, d), docs(s, d)).withColumn("arm", F.when(F.col("item").cast("int") % 2 == 0, "seen").otherwise("unseen"))
    high, low = F.col("containment") >= 0.8, F.col("containment") <= 0.1
    misplaced = ((F.col("arm") == "seen") & ~high) | ((F.col("arm") == "unseen") & ~low)
    return c.groupBy("arm").agg(F.count(F.lit(1)).alias("n"), F.count_if(high).alias("seen"), F.count_if(low).alias("unseen"), F.count_if(misplaced).alias("misplaced"))


BANDS = ", ".join(f"count(*) FILTER (WHERE m / n >= {c}) AS {k}" for k, c in (("ge_999", 0.999), ("ge_900", 0.9), ("ge_800", 0.8), ("ge_500", 0.5), ("ge_300", 0.3), ("ge_100", 0.1)))


@query("agg16_containment_bands", MAX + f" SELECT count(*) AS n, {BANDS}, round(max(m / n), 6) AS max, round((SELECT x FROM (SELECT m / n AS x, row_number() OVER (ORDER BY m / n DESC) AS r, count(*) OVER () AS k FROM c) WHERE r = k // 2 + 1), 6) AS median FROM c")
def _(s, d):
    return C.bands(C.containment_max(items(s, d), docs(s, d)))


@query("src30_containment_rows", MAX + " SELECT item, round(m / n, 6) AS containment FROM c WHERE m > 0")
def _(s, d):
    return C.containment_max(items(s, d), docs(s, d)).where("containment > 0").select("item", "containment")


@query("agg17_route_attribution", inverted(False, short=True) + """, p AS (SELECT item, doc, count(*) AS k FROM u JOIN v USING (gram) GROUP BY ALL),
r AS (SELECT source, item_set, count(DISTINCT item) AS n_items FROM (SELECT *, 'set' || (item::INT % 3) AS item_set FROM p) JOIN i USING (item) JOIN {docs} x ON x.id = doc WHERE k / len(g) >= 0.8 GROUP BY ALL), z AS (SELECT 'set' || (id::INT % 3) AS item_set, count(*) AS n FROM {items} GROUP BY 1)
SELECT source, item_set, n_items, round(n_items / n, 6) AS share, n_rows FROM r JOIN z USING (item_set) JOIN (SELECT source, count(*) AS n_rows FROM documents GROUP BY 1) USING (source)""")
def _(s, d):
    """Distinct items that each source holds, by item set, beside the set's share and the source's rows."""
    x, i = docs(s, d), items(s, d).withColumn("item_set", F.concat(F.lit("set"), (F.col("id").cast("int") % 3).cast("string")))
    return C.route_attribution(i, x)


@query("con06_flt06_scan_manifest", "SELECT source, count(*) AS rows_scanned, count(*) FILTER (WHERE length(text) < 40) AS rows_skipped, count(*) FILTER (WHERE length(text) < 40) > 0.5 * count(*) AS suspect, count(*) >= 100 AS sampled, CASE WHEN count(*) >= 100 THEN 'a prefix of the source' ELSE 'the whole source' END AS coverage FROM documents GROUP BY 1")
def _(s, d):
    """By source; a scan that met its limit is a sample of what it read from."""
    return C.scan_manifest(docs(s, d), limit=100)


@query("agg21_detector_false_positives", MAX + """, t AS (SELECT unnest([0.5, 0.6, 0.7, 0.8, 0.9])::DOUBLE AS t), q AS (SELECT quantile_cont(m / n, 0.5) AS p50, quantile_cont(m / n, 0.9) AS p90, quantile_cont(m / n, 0.99) AS p99, max(m / n) AS max FROM c)
SELECT t AS threshold, count(*) FILTER (WHERE m / n >= t) AS flagged, round(any_value(p50), 6) AS p50, round(any_value(p90), 6) AS p90, round(any_value(p99), 6) AS p99, round(any_value(max), 6) AS max FROM c, t, q GROUP BY 1""")
def _(s, d):
    """Flagged items at each threshold, all read off one pass, beside the values' percentiles."""
    v, cuts = F.col("containment"), (0.5, 0.6, 0.7, 0.8, 0.9)
    one = C.containment_max(items(s, d), docs(s, d)).agg(*[F.count_if(v >= t).alias(f"t{i}") for i, t in enumerate(cuts)], *[F.percentile(v, p).alias(k) for k, p in (("p50", 0.5), ("p90", 0.9), ("p99", 0.99))], F.max(v).alias("max"))
    rows = F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"t{i}").alias("flagged")) for i, t in enumerate(cuts)]))
    return one.select(rows.alias("r"), "p50", "p90", "p99", "max").select("r.*", "p50", "p90", "p99", "max")


@query("join15_con07_crosstab", MAX + ", b AS (SELECT *, item::INT % 2 = 0 AS placebo FROM c) SELECT placebo, count(*) FILTER (WHERE m / n >= 0.8) AS high, count(*) FILTER (WHERE m / n < 0.8) AS low FROM b GROUP BY 1")
def _(s, d):
    c = C.containment_max(items(s, d), docs(s, d)).withColumn("placebo", F.col("item").cast("int") % 2 == 0)
    return c.groupBy("placebo").agg(F.count_if(F.col("containment") >= 0.8).alias("high"), F.count_if(F.col("containment") < 0.8).alias("low"))


@query("flt07_win13_filler", inverted(False) + """, ok AS (SELECT doc_id, length(text) AS n FROM documents WHERE length(text) >= 200 AND cast(doc_id AS string) NOT IN (SELECT doc FROM v JOIN u USING (gram)))
SELECT doc_id FROM (SELECT doc_id, sum(n) OVER (ORDER BY doc_id) AS total FROM ok) WHERE total <= 200000""")
def _(s, d):
    """Long documents without a gram of the items, in order, up to a budget of characters."""
    x = docs(s, d).where(F.length("text") >= 200)
    hit = C.matches(C.grams(items(s, d), "prompt"), x, short=True).select(F.col("doc").alias("id")).distinct()
    ok = x.join(hit, "id", "left_anti").select(F.col("id").cast("long").alias("doc_id"), F.length("text").cast("long").alias("n"))
    return running(ok, "doc_id", "n", "total").where("total <= 200000").select("doc_id")


W = tokens_sql


def char_grams_sql(x: str) -> str:
    return f"list_distinct(list_transform(range(1, greatest(length({x}) - 3, 2)), lambda k: substr({x}, k, 5)))"


@query("con01_join06_lexical_scan", f"""
WITH i AS (SELECT item, t, string_split(t, ' ') AS w FROM (SELECT id AS item, {norm_sql('prompt')} AS t FROM {{items}}) WHERE t <> ''),
d AS (SELECT doc, t, string_split(t, ' ') AS w FROM (SELECT id AS doc, {norm_sql('text')} AS t FROM {{docs}}) WHERE t <> ''),
ic AS (SELECT item, unnest({char_grams_sql('t')}) AS g FROM i), dc AS (SELECT doc, unnest({char_grams_sql('t')}) AS g FROM d),
iw AS (SELECT item, v, count(*) AS n FROM (SELECT item, unnest(w) AS v FROM i) GROUP BY ALL), dw AS (SELECT doc, v, count(*) AS n FROM (SELECT doc, unnest(w) AS v FROM d) GROUP BY ALL),
c AS (SELECT item, doc, count(*) AS c FROM ic JOIN dc USING (g) GROUP BY ALL),
m AS (SELECT item, doc, count(*) AS k, sum(least(iw.n, dw.n)) AS m FROM iw JOIN dw USING (v) GROUP BY ALL),
icn AS (SELECT item, count(*) AS n FROM ic GROUP BY 1), dcn AS (SELECT doc, count(*) AS n FROM dc GROUP BY 1), iwn AS (SELECT item, count(*) AS n, sum(n) AS total FROM iw GROUP BY 1), dwn AS (SELECT doc, count(*) AS n FROM dw GROUP BY 1),
p AS (SELECT item, doc, greatest(coalesce(k, 0)::DOUBLE / (iwn.n + dwn.n - coalesce(k, 0)), coalesce(c, 0)::DOUBLE / (icn.n + dcn.n - coalesce(c, 0)), coalesce(m, 0)::DOUBLE / iwn.total) AS score, i.t AS it, d.t AS dt
 FROM c FULL JOIN m USING (item, doc) JOIN i USING (item) JOIN d USING (doc) JOIN icn USING (item) JOIN dcn USING (doc) JOIN iwn USING (item) JOIN dwn USING (doc)),
s AS (SELECT item, doc, score, CASE WHEN it = dt OR contains(dt, it) OR score >= 0.98 THEN 'exact' WHEN score >= 0.72 THEN 'near_duplicate' WHEN score >= 0.45 THEN 'paraphrase_candidate' ELSE 'none' END AS label FROM p)
SELECT item, doc, round(score, 6) AS score, label FROM s WHERE label <> 'none' QUALIFY row_number() OVER (PARTITION BY item ORDER BY round(score, 9) DESC, doc) <= 5""")
def _(s, d):
    """Every item against every whole document: best of word Jaccard, character Jaccard and weighted overlap, five hits an item."""
    return C.lexical_scan(items(s, d), docs(s, d)).select("item", "doc", F.round("score", 6).alias("score"), "label")


COS = "list_cosine_similarity(q.embedding::DOUBLE[], x.embedding::DOUBLE[])"
KNN = f"SELECT q.vec_id AS query, x.vec_id AS neighbor, x.label AS label, {COS} AS cosine, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({COS}, 9) DESC, x.vec_id) AS rank FROM embeddings q, embeddings x WHERE q.vec_id % 100 = 0 AND q.vec_id <> x.vec_id"


def neighbors(s: SparkSession, d: str, k: int = 20) -> DataFrame:
    """Every vector whose id is divisible by 100 as a query against all vectors but itself."""
    e = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return V.top_k(e.where("id % 100 = 0"), e, k, exclude_self=True)


@query("join07_idx01_knn", f"SELECT query, neighbor, round(cosine, 5) AS cosine, rank::INT AS rank FROM ({KNN}) WHERE rank <= 20", 5)
def _(s, d):
    return neighbors(s, d)


@query("idx01_ivf_recall")
def _(s, d):
    """Recall of the inverted lists against the exact top ten."""
    e = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    q = e.where("id % 100 = 0")
    c = V.fit_lists(e)
    got = V.top_k_lists(q, e, c, 10, max(1, round(0.75 * len(c)))).select("query", "neighbor").withColumn("hit", F.lit(1))
    return V.top_k(q, e, 10).join(got, ["query", "neighbor"], "left").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))


@query("idx01_pq_recall")
def _(s, d):
    """Recall of the quantised index against the exact top ten, the bytes of a code for each byte of a vector, and the rows reranked."""
    e = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    q, codec = e.where("id % 100 = 0"), Q.fit(e)
    got = Q.search(q, staged(Q.coded(e, codec), "coded"), codec, 10).select("query", "neighbor").withColumn("hit", F.lit(1))
    size = e.agg(F.max(F.size("embedding") * 4).alias("bytes"), F.count(F.lit(1)).alias("n"))
    recall = V.top_k(q, e, 10).join(got, ["query", "neighbor"], "left").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
    return recall.crossJoin(size).select("recall", (F.lit(len(codec.words)) / F.col("bytes")).alias("bytes_read"), F.least(F.lit(1.0), F.lit(10.0 * Q.RERANK) / F.col("n")).alias("reranked"))


NB = f"(SELECT * FROM ({KNN}) WHERE rank <= 20)"


def profiles(s: SparkSession, d: str) -> DataFrame:
    labels = table(s, d, "embeddings").select(F.col("vec_id").alias("neighbor"), F.col("label").alias("source"))
    n = neighbors(s, d).join(labels, "neighbor")
    w = Window.partitionBy("query").orderBy("cosine")
    pos = F.greatest("cosine", F.lit(0.0))
    n = n.withColumn("_i", F.row_number().over(w)).withColumn("pos", pos)
    return n.groupBy("query").agg(
        F.count(F.lit(1)).alias("n_neighbors"), F.avg("cosine").alias("mean_cosine"), F.max("cosine").alias("top1_cosine"), F.avg((F.col("cosine") >= 0.85).cast("int")).alias("near_duplicate_share"),
        F.coalesce(F.try_divide(2 * F.sum(F.col("_i") * F.col("pos")), F.count(F.lit(1)) * F.sum("pos")) - (F.count(F.lit(1)) + 1) / F.count(F.lit(1)), F.lit(0.0)).alias("gini"),
    )


PROFILE = f"SELECT query, count(*) AS n_neighbors, avg(cosine) AS mean_cosine, max(cosine) AS top1_cosine, avg((cosine >= 0.85)::INT) AS near_duplicate_share, 2 * sum(i * greatest(cosine, 0)) / (count(*) * sum(greatest(cosine, 0))) - (count(*) + 1) / count(*) AS gini FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY cosine) AS i FROM {NB}) GROUP BY 1"


@query("agg13_agg14_att02_profiles", f"SELECT query, n_neighbors, round(mean_cosine, 4) AS mean_cosine, round(top1_cosine, 4) AS top1_cosine, round(near_duplicate_share, 4) AS near_duplicate_share, round(gini, 4) AS gini, CASE WHEN near_duplicate_share >= 0.3 THEN 'concentrated' ELSE 'diverse' END AS concentration FROM ({PROFILE})", 4)
def _(s, d):
    p = profiles(s, d)
    return p.withColumn("concentration", F.when(F.col("near_duplicate_share") >= 0.30, "concentrated").otherwise("diverse"))


@query("agg13_source_shares", f"SELECT query, label AS source, round(sum(greatest(cosine, 0)) / sum(sum(greatest(cosine, 0))) OVER (PARTITION BY query), 4) AS share FROM {NB} GROUP BY query, label", 4)
def _(s, d):
    labels = table(s, d, "embeddings").select(F.col("vec_id").alias("neighbor"), F.col("label").alias("source"))
    per = neighbors(s, d).join(labels, "neighbor").groupBy("query", "source").agg(F.sum(F.greatest("cosine", F.lit(0.0))).alias("w"))
    return per.select("query", "source", (F.col("w") / F.sum("w").over(Window.partitionBy("query"))).alias("share"))


@query("agg15_by_skill", f"SELECT query % 5 AS skill, count(*) AS n_items, round(avg(near_duplicate_share), 4) AS mean_near_duplicate_share, round(avg(gini), 4) AS mean_gini, round(avg((near_duplicate_share >= 0.3)::INT), 4) AS concentrated_share FROM ({PROFILE}) GROUP BY 1", 4)
def _(s, d):
    p = profiles(s, d).groupBy((F.col("query") % 5).alias("skill"))
    return p.agg(F.count(F.lit(1)).alias("n_items"), F.avg("near_duplicate_share").alias("mean_near_duplicate_share"), F.avg("gini").alias("mean_gini"), F.avg((F.col("near_duplicate_share") >= 0.3).cast("int")).alias("concentrated_share"))


@query("con02_embedding_scan", f"""WITH t AS (SELECT doc_id, {norm_sql('text')} AS t, {tokens_sql('text')} AS w FROM documents), g AS (SELECT doc_id, list_distinct(list_transform(range(1, greatest(len(w) - 11, 1)), lambda i: array_to_string(w[i:i+12], ' '))) AS g FROM t),
c AS (SELECT doc_id, unnest(CASE WHEN length(t) > 4 THEN list_distinct(list_transform(range(1, length(t) - 2), lambda i: substr(t, i, 4))) ELSE [t] END) AS c FROM t WHERE t <> ''),
p AS (SELECT doc_id, h % 64 AS i, sum(CASE WHEN h // 64 % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE AS v FROM (SELECT doc_id, {A.hashed_sql('c')} AS h FROM c) GROUP BY ALL), n AS (SELECT doc_id, sqrt(sum(v * v)) AS n FROM p GROUP BY 1),
s AS (SELECT a.doc_id AS query, b.doc_id AS neighbor, sum(a.v * b.v) AS dot FROM p a JOIN p b USING (i) WHERE a.doc_id % 100 = 0 AND a.doc_id <> b.doc_id GROUP BY ALL), k AS (SELECT query, neighbor, dot / (x.n * y.n) AS cosine FROM s JOIN n x ON x.doc_id = query JOIN n y ON y.doc_id = neighbor QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(dot / (x.n * y.n), 9) DESC, neighbor) <= 20),
o AS (SELECT query, neighbor, cosine, CASE WHEN len(a.g) > 0 THEN len(list_intersect(a.g, b.g)) / len(a.g) ELSE 0 END AS overlap FROM k JOIN g a ON a.doc_id = query JOIN g b ON b.doc_id = neighbor)
SELECT query, neighbor, round(cosine, 4) AS cosine, round(overlap, 4) AS overlap, CASE WHEN cosine > 0.90 OR overlap > 0.6 THEN 'contaminated' ELSE 'partial' END AS label FROM o WHERE cosine > 0.75 OR overlap > 0.3""", 4)
def _(s, d):
    """Documents with an id divisible by 100 against all: top twenty by embedding, reranked by 13-gram overlap, labelled, clean ones dropped."""
    t = dealt(table(s, d, "documents")).select(F.col("doc_id").alias("id"), "text")
    e = staged(V.embedded_texts(t, 64), "embedded")
    n = staged(V.top_k(e.where("id % 100 = 0"), e, 20, exclude_self=True).select("query", "neighbor", "cosine"), "near")
    # Grams are made of the documents that are in some pair.
    some = n.select(F.col("query").alias("id")).union(n.select("neighbor")).distinct()
    g = t.join(some, "id", "left_semi").select("id", T.word_grams(T.tokens(F.col("text")), short=False).alias("g"))
    n = n.join(g.select(F.col("id").alias("query"), F.col("g").alias("a")), "query").join(g.select(F.col("id").alias("neighbor"), F.col("g").alias("b")), "neighbor")
    n = n.select("query", "neighbor", "cosine", T.overlap(F.col("a"), F.col("b")).alias("overlap"))
    return n.withColumn("label", R.contamination_label(F.col("cosine"), F.col("overlap"))).where("label <> 'clean'")


def only(df: DataFrame, column: str) -> Column:
    """The one vector of that name as a scalar subquery, which fails where there are two."""
    return df.select(column).scalar()


@query("att03_tracin", "SELECT vec_id, round(list_inner_product(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) + 2 * list_inner_product(list_reverse(embedding::DOUBLE[]), (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 4) AS score FROM embeddings", 4)
def _(s, d):
    """Sum over checkpoints of learning rate times the product of gradients; two checkpoints of rates 1 and 2."""
    e = table(s, d, "embeddings")
    return e.withColumn("g", only(e.where("vec_id = 0"), "embedding")).select("vec_id", (A.dot(F.col("embedding"), F.col("g")) + 2.0 * A.dot(F.reverse("embedding"), F.col("g"))).alias("score"))


@query("att04_concept_similarity", "SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 1)), 4) AS similarity FROM embeddings", 4)
def _(s, d):
    e = table(s, d, "embeddings")
    return e.withColumn("g", only(e.where("vec_id = 1"), "embedding")).select("vec_id", A.cosine(F.col("embedding"), F.col("g")).alias("similarity"))


@query("agg40_influence_concentration", "SELECT o_custkey, round(max(v) / sum(v), 6) AS top1, round(sum(v) FILTER (WHERE r <= 3) / sum(v), 6) AS top3 FROM (SELECT o_custkey, o_totalprice AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS r FROM orders) GROUP BY 1")
def _(s, d):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"))
    o = table(s, d, "orders").select("o_custkey", "o_totalprice", F.row_number().over(w).alias("r"))
    return o.groupBy("o_custkey").agg((F.max("o_totalprice") / F.sum("o_totalprice")).alias("top1"), (F.sum(F.when(F.col("r") <= 3, F.col("o_totalprice"))) / F.sum("o_totalprice")).alias("top3"))
