"""TXT, NUM and CLS queries: each function over a table of texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import register
from ..functions import answers as A
from ..functions import rules as R
from ..functions import text as T
from ..sources.tables import completions, docs, items, scores, sql, table
from ..staging import staged

NORM = r"trim(regexp_replace(regexp_replace(lower({x}), '[!-/:-@\[-`{-~]', ' ', 'g'), '\s+', ' ', 'g'))"


def norm_sql(x: str) -> str:
    return NORM.replace("{x}", x)


def tokens_sql(x: str) -> str:
    return f"list_filter(string_split({norm_sql(x)}, ' '), lambda w: w <> '')"


def first_sql(x: str, pattern: str, group: int = 1) -> str:
    return f"(CASE WHEN regexp_matches({x}, '{pattern}') THEN regexp_extract({x}, '{pattern}', {group}) END)"


def last_sql(x: str, pattern: str) -> str:
    return f"regexp_extract_all({x}, '{pattern}', 1)[-1]"


def q(pattern: str) -> str:
    return pattern.replace("'", "''")


def _over(name: str, source, source_sql: str, key: str, cols: Callable[[], dict[str, Column]], exprs: dict[str, str]) -> None:
    """A query of scalar columns over one source, and its SQL."""
    @register(name, sql(f"SELECT {key}, " + ", ".join(f"{e} AS {a}" for a, e in exprs.items()) + f" FROM {source_sql}"))
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return source(spark, sf_dir).select(key, *[c.alias(a) for a, c in cols().items()])


def on_docs(name: str, col: Callable[[], Column], expr: str) -> None:
    _over(name, docs, "{docs}", "id", lambda: {"value": col()}, {"value": expr})


def on_answers(name: str, col: Callable[[], Column], expr: str) -> None:
    _over(name, completions, "{completions}", "benchmark_id", lambda: {"value": col()}, {"value": expr})


# Columns can only be made while a session is up, so queries make them when they run.
def x() -> Column:
    return F.col("text")


def c() -> Column:
    return F.col("completion")


def e() -> Column:
    return F.col("embedding")


def p1() -> Column:
    return (F.floor("value") % 100) / 100.0


def p2() -> Column:
    return (F.floor("value") % 89) / 89.0


def stated_difficulty() -> tuple[Column, Column]:
    return R.difficulty(F.repeat(F.lit("<<1+1=2>>"), (F.col("id").cast("int") % 3)), F.when(F.col("id").cast("int") % 2 == 0, F.concat(F.lit("Level "), F.col("id"))), F.col("prompt"))


def VERDICT() -> Column:
    return F.concat(F.when(F.col("verdict"), "This is CORRECT. ").when(~F.col("verdict"), "Incorrect! ").otherwise("unsure "), F.when(F.col("stratum") == 4, "correct or incorrect").otherwise(""))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", "html", "url")


on_docs("txt01_normalize_text", lambda: T.normalize_text(x()), norm_sql("text"))
on_docs("txt04_token_set_size", lambda: F.size(T.token_set(x())), f"len(list_distinct({tokens_sql('text')}))")
_over("txt05_char_grams", items, "{items}", "id", lambda: {"n": F.size(T.char_grams(F.col("prompt")))}, {"n": f"len(list_distinct(list_transform(range(1, length({norm_sql('prompt')}) - 3), lambda i: substr({norm_sql('prompt')}, i, 5))))"})
_over("txt06_word_grams", items, "{items}", "id", lambda: {"n": F.size(T.word_grams(T.tokens(F.col("prompt")))), "first_gram": F.get(T.word_grams(T.tokens(F.col("prompt"))), 0)},
      {"n": f"len(list_distinct(list_transform(range(1, len({tokens_sql('prompt')}) - 11), lambda i: array_to_string(({tokens_sql('prompt')})[i:i+12], ' '))))", "first_gram": f"array_to_string(({tokens_sql('prompt')})[1:13], ' ')"})
on_docs("txt09_excerpt", lambda: T.excerpt(x()), r"CASE WHEN length(trim(regexp_replace(text, '\s+', ' ', 'g'))) <= 320 THEN trim(regexp_replace(text, '\s+', ' ', 'g')) ELSE rtrim(left(trim(regexp_replace(text, '\s+', ' ', 'g')), 317)) || '...' END")
on_docs("txt10_plain_tokens", lambda: F.array_join(T.plain_tokens(x()), " "), "array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ')")
FINAL = f"coalesce(trim({first_sql('completion', r'####\s*([^\n]+)')}), trim({first_sql('completion', T.PHRASE)}), {first_sql('completion', r'(?i)^\s*(yes|no)\b')}, {last_sql('completion', T.NUMBER)}, trim(completion))"
on_answers("txt03_final_answer", lambda: T.final_answer(c()), FINAL)
on_answers("txt02_normalize_answer", lambda: T.normalize_answer(c()), f"coalesce(list_aggregate(list_filter(string_split({norm_sql(FINAL)}, ' '), lambda w: w NOT IN ('the', 'a', 'an', '')), 'string_agg', ' '), '')")
NAT = r"list_aggregate(list_filter(string_split(rtrim(trim(regexp_replace(replace(lower(trim({x})), '$', ''), '\s+', ' ', 'g')), '.'), ' '), lambda w: w NOT IN ('the', 'a', 'an', '')), 'string_agg', ' ')"
on_answers("txt11_normalize_answer_text", lambda: T.normalize_answer_text(c()), f"coalesce({NAT.replace('{x}', 'completion')}, '')")
on_answers("txt12_normalize_final", lambda: T.normalize_final(c()), f"coalesce(list_aggregate(list_filter({tokens_sql('completion')}, lambda w: w NOT IN ('the', 'a', 'an')), 'string_agg', ' '), '')")
CLEAN = "rtrim(trim(regexp_replace({x}, '[,$]', '', 'g')), '.')"
clean_sql = lambda e: CLEAN.replace("{x}", e)
on_answers("txt13_clean_number", lambda: T.clean_number(F.concat(F.col("gold"), F.lit(",000. "))), clean_sql("gold || ',000. '"))
HASH = f"trim({last_sql('completion', r'(?m)####\s*(.+?)\s*$')})"
on_answers("txt14_after_hash", lambda: T.after_hash(c()), HASH)
NUM = f"coalesce(CASE WHEN coalesce({HASH}, '') <> '' THEN {clean_sql(f'coalesce({last_sql(HASH, T.GROUPED)}, {HASH})')} END, {clean_sql(last_sql(first_sql('completion', T.ANSWER_IS), T.GROUPED))}, {clean_sql(last_sql('completion', T.GROUPED))}, trim(completion))"
on_answers("txt15_extract_numeric", lambda: T.extract_numeric(c()), NUM)
BOXED = rf"coalesce(trim({last_sql('completion', r'\\boxed\{([^{}]+)\}')}), nullif({HASH}, ''), {NUM})"
on_answers("txt16_extract_boxed", lambda: T.extract_boxed(c()), BOXED)
SPACE = f"coalesce(nullif({HASH}, ''), {first_sql('completion', T.ANSWER_IS)}, completion)"
CHOICE = rf"coalesce({last_sql(f'upper({SPACE})', r'\b([A-E])\b')}, {last_sql(SPACE, T.GROUPED)}, trim({SPACE}))"
YESNO = f"lower(coalesce({first_sql(f'coalesce(nullif({HASH}, ' + chr(39) * 2 + '), completion)', r'(?i)\b(yes|no|true|false)\b')}, trim(coalesce(nullif({HASH}, ''), completion))))"
ANSWER = f"CASE kind WHEN 'boxed' THEN {BOXED} WHEN 'multiple_choice' THEN {CHOICE} WHEN 'yes_no' THEN {YESNO} ELSE {NUM} END"
_over("txt17_extract_choice", completions, "{completions}", "benchmark_id", lambda: {"value": T.extract_choice(c())}, {"value": CHOICE})
_over("txt18_extract_yes_no", completions, "{completions}", "benchmark_id", lambda: {"value": T.extract_yes_no(c())}, {"value": YESNO})
_over("txt19_extract_answer", completions, "{completions}", "benchmark_id", lambda: {"value": T.extract_answer(c(), F.col("kind"))}, {"value": ANSWER})
_over("txt19_extractor_for", scores, "{scores}", "benchmark_id", lambda: {"value": T.extractor_for(F.col("benchmark"), F.when(F.col("skill") == "MACHINERY", "mathematical").otherwise(F.col("skill")), F.col("normalized_predicted"), F.col("arm") == "seen")},
      {"value": "CASE WHEN skill = 'MACHINERY' THEN 'boxed' WHEN coalesce(arm, '') = 'seen' THEN 'multiple_choice' ELSE 'numeric' END"})
on_answers("txt22_canonical_number", lambda: T.canonical_number(F.concat(F.lit("\\text{"), F.col("gold"), F.lit(".00}"))), "gold")
on_answers("txt23_cut_at_exemplar", lambda: T.cut_at_exemplar(c()), r"regexp_replace(completion, '(?s)\n\s*(?:Question|Q)\s*:.*', '')")
on_answers("txt23_finished", lambda: T.finished(c(), F.col("gold") == "7", 4), r"gold = '7' OR regexp_matches(completion, '\n\s*(?:Question|Q)\s*:')")
on_docs("txt24_sentences", lambda: F.size(T.sentences(x())), r"len(list_filter(regexp_extract_all(text, '([^.!?]*[.!?]+\s*|[^.!?]+$)', 1), lambda s: trim(s) <> ''))")
on_docs("txt25_sentence_parts", lambda: F.size(T.sentence_parts(x())), r"len(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(31), 'g'), chr(31)))")
on_answers("txt27_is_question", lambda: T.is_question(F.concat(c(), F.when(F.col("gold") < "3", "?").otherwise(""))), rf"regexp_matches(lower(trim(completion || CASE WHEN gold < '3' THEN '?' ELSE '' END)), '{q(T.QUESTION)}')")
on_answers("txt29_order_safe", lambda: T.order_safe(c()), " AND ".join(rf"NOT regexp_matches(lower(completion), '{q(p)}')" for p in (T.PRONOUN, T.TEMPORAL, T.BACK)))
_over("txt30_abstains", completions, "{completions}", "benchmark_id", lambda: {"value": T.abstains(c())}, {"value": rf"regexp_matches(completion, '{q(T.ABSTAIN)}')"})


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.tables import judge

    return judge(spark, sf_dir).withColumn("raw", VERDICT())


_over("txt31_judge_verdict", judged, "(SELECT *, upper((CASE WHEN verdict THEN 'This is CORRECT. ' WHEN NOT verdict THEN 'Incorrect! ' ELSE 'unsure ' END) || (CASE WHEN stratum = 4 THEN 'correct or incorrect' ELSE '' END)) AS raw FROM {judge})", "benchmark_id",
      lambda: {"value": T.judge_verdict(F.col("raw"))}, {"value": "CASE WHEN contains(replace(raw, 'INCORRECT', ''), 'CORRECT') AND NOT contains(raw, 'INCORRECT') THEN true WHEN contains(raw, 'INCORRECT') AND NOT contains(replace(raw, 'INCORRECT', ''), 'CORRECT') THEN false END"})
on_answers("txt32_judge_prompt", lambda: F.format_string("Reference: %s\nAnswer (tail): %s\nReply CORRECT or INCORRECT.", F.col("gold"), F.right(c(), F.lit(1200))), r"'Reference: ' || gold || chr(10) || 'Answer (tail): ' || right(completion, 1200) || chr(10) || 'Reply CORRECT or INCORRECT.'")
on_answers("txt33_build_prompt", lambda: F.concat(F.col("gold"), F.when(F.col("kind") == "multiple_choice", "\nThink step by step, then answer with the single letter of the correct option after '####'.").when(F.col("kind") == "yes_no", "\nThink step by step, then answer 'yes' or 'no' after '####'.").otherwise("\nLet's think step by step, then give the final answer after '####'.")),
           "gold || chr(10) || CASE kind WHEN 'multiple_choice' THEN 'Think step by step, then answer with the single letter of the correct option after ''####''.' WHEN 'yes_no' THEN 'Think step by step, then answer ''yes'' or ''no'' after ''####''.' ELSE 'Let''s think step by step, then give the final answer after ''####''.' END")
on_answers("txt35_stage2_doc", lambda: F.concat_ws("\n", c(), F.lit("Answer:"), F.col("gold")), "completion || chr(10) || 'Answer:' || chr(10) || gold")
on_answers("txt37_chain_length", lambda: T.chain_length(F.concat(c(), F.repeat(F.lit("<<1+2=3>>"), F.col("gold").cast("int") % 5))), "cast(gold AS int) % 5")
_over("txt38_numbers", completions, "{completions}", "benchmark_id", lambda: {"n": F.size(T.numbers(c())), "total": F.round(F.aggregate(T.numbers(c()), F.lit(0.0), lambda a, v: a + v), 6)},
      {"n": r"len(list_distinct(list_transform(regexp_extract_all(completion, '-?\d+(?:\.\d+)?'), lambda v: v::DOUBLE)))", "total": r"round(coalesce(list_sum(list_distinct(list_transform(regexp_extract_all(completion, '-?\d+(?:\.\d+)?'), lambda v: v::DOUBLE))), 0), 6)"})


# Without looking around: characters between numbers are doubled, so that a match leaves its neighbour one of them.
@register("txt39_int_occurrences", sql(r"SELECT benchmark_id, len(regexp_extract_all(regexp_replace(completion, '([^0-9.,])', '\1\1', 'g'), '(?:^|[^0-9.,])' || gold || '(?:[^0-9.,]|[.,](?:[^0-9]|$)|$)')) AS n FROM {completions}"))
def int_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return completions(spark, sf_dir).select("benchmark_id", T.int_occurrences(c(), F.col("gold")).alias("n"))


@register("txt28_domain_noun", sql(r"""
WITH w AS (SELECT benchmark_id, unnest(regexp_extract_all(lower(completion), '[a-z]{4,}')) AS word, generate_subscripts(regexp_extract_all(lower(completion), '[a-z]{4,}'), 1) AS pos FROM {completions}),
n AS (SELECT benchmark_id, word, count(*) AS n, min(pos) AS first FROM w WHERE word NOT IN ({stop}) GROUP BY ALL)
SELECT benchmark_id, word AS noun FROM (SELECT *, row_number() OVER (PARTITION BY benchmark_id ORDER BY n DESC, (CASE WHEN word LIKE '%s' THEN 0 ELSE 1 END), first) AS r FROM n) WHERE r = 1""".replace("{stop}", ", ".join(repr(w) for w in T.STOP))))
def domain_noun(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most frequent longer word, plurals before others, then the earliest."""
    return nouns(completions(spark, sf_dir))


def nouns(df: DataFrame) -> DataFrame:
    """benchmark_id, noun of completions: words are counted where their row is; only those of ids with several rows are shuffled."""
    often = df.groupBy("benchmark_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("benchmark_id")
    if often.isEmpty():
        return T.frequent_nouns(df, "benchmark_id", "completion")
    often = staged(often, "repeated")
    alone = T.frequent_nouns(df.join(often, "benchmark_id", "left_anti"), "benchmark_id", "completion")
    words = df.join(often, "benchmark_id", "left_semi").select("benchmark_id", F.posexplode(F.regexp_extract_all(F.lower(c()), F.lit("([a-z]{4,})"), F.lit(1))).alias("pos", "word"))
    n = words.where(~F.col("word").isin(*T.STOP)).groupBy("benchmark_id", "word").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))
    return alone.unionByName(n.groupBy("benchmark_id").agg(F.min_by("word", F.struct(-F.col("n"), F.when(F.col("word").endswith("s"), 0).otherwise(1), "first", "word")).alias("noun")))


@register("txt07_word_overlap", sql(rf"""
WITH i AS (SELECT item, list_distinct(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k+4], ' '))) AS g FROM (SELECT id AS item, {tokens_sql('prompt')} AS w FROM {{items}})),
d AS (SELECT doc, unnest(list_distinct(list_transform(range(1, greatest(len(w) - 3, 1)), lambda k: array_to_string(w[k:k+4], ' ')))) AS g FROM (SELECT id AS doc, {tokens_sql('text')} AS w FROM {{docs}})),
u AS (SELECT item, len(g) AS m, unnest(g) AS g FROM i)
SELECT item, doc, round(count(*) / any_value(m), 6) AS overlap FROM u JOIN d USING (g) GROUP BY ALL"""))
def word_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directional 5-gram overlap of every item and document that share a gram, by an inverted index."""
    from ..operators.containment import matches

    i = items(spark, sf_dir).select("id", T.word_grams(T.tokens(F.col("prompt")), 5).alias("g"))
    return matches(i, docs(spark, sf_dir), 5, short=True).select("item", "doc", F.round(F.col("n_shared") / F.col("n_grams"), 6).alias("overlap"))


HEAD, TAIL = "left(text, length(text) // 2)", "substr(text, length(text) // 2 + 1)"


def halves() -> tuple[Column, Column]:
    """The two halves of a whole text, as two texts to be compared."""
    n = F.floor(F.length(x()) / 2).cast("int")
    return F.left(x(), n), F.substr(x(), n + 1)


_over("set01_jaccard", docs, f"(SELECT id, list_distinct({tokens_sql(HEAD)}) AS a, list_distinct({tokens_sql(TAIL)}) AS b FROM {{docs}})", "id", lambda: {"value": F.round(T.jaccard(*map(T.token_set, halves())), 6)},
      {"value": "round(CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1.0::DOUBLE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) END, 6)"})
@register("txt08_weighted_overlap", sql(f"""
WITH q AS (SELECT id, w, count(*) AS n FROM (SELECT id, unnest({tokens_sql(HEAD)}) AS w FROM {{docs}}) GROUP BY ALL), d AS (SELECT id, w, count(*) AS n FROM (SELECT id, unnest({tokens_sql(TAIL)}) AS w FROM {{docs}}) GROUP BY ALL),
m AS (SELECT id, sum(least(q.n, d.n))::DOUBLE AS m FROM q JOIN d USING (id, w) GROUP BY 1), t AS (SELECT id, sum(n) AS t FROM q GROUP BY 1)
SELECT id, round(coalesce(m / t, 0), 6) AS value FROM {{docs}} LEFT JOIN m USING (id) LEFT JOIN t USING (id)"""))
def weighted_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("id", F.round(T.weighted_overlap(*map(T.tokens, halves())), 6).alias("value"))


QUAL = r"(SELECT id, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS w FROM {docs})"


@register("txt34_qual01_degenerate", sql(rf"""
WITH w AS {QUAL},
g AS (SELECT id, unnest(list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: array_to_string(w[i:i+2], ' '))) AS gram FROM w),
t AS (SELECT id, max(n) / sum(n) AS top FROM (SELECT id, gram, count(*) AS n FROM g GROUP BY ALL) GROUP BY id),
p AS (SELECT id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM w),
k AS (SELECT id, word, pos - row_number() OVER (PARTITION BY id, word ORDER BY pos) AS k FROM p),
r AS (SELECT id, max(n) AS run FROM (SELECT id, word, k, count(*) AS n FROM k GROUP BY ALL) GROUP BY id),
a AS (SELECT w.id, len(w) AS n_tokens, coalesce(len(list_distinct(w)) / nullif(len(w), 0), 0) AS ratio, coalesce(top, 0) AS top, coalesce(run, 0) AS run FROM w LEFT JOIN t USING (id) LEFT JOIN r USING (id))
SELECT id, n_tokens, round(ratio, 6) AS distinct_ratio, round(top, 6) AS top_trigram, run AS longest_run,
 n_tokens = 0 OR (n_tokens >= 20 AND (ratio < 0.35 OR top > 0.25)) OR run >= 12 AS degenerate FROM a"""))
def qual01(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = docs(spark, sf_dir).select("id", T.degenerate(x()).alias("q"))
    return df.select("id", "q.n_tokens", F.round("q.distinct_ratio", 6).alias("distinct_ratio"), F.round("q.top_trigram", 6).alias("top_trigram"), "q.longest_run", "q.degenerate")


@register("agg27_quality_report", sql(rf"""
WITH w AS {QUAL} SELECT count(*) AS n, count(*) FILTER (WHERE len(w) = 0 OR (len(w) >= 20 AND len(list_distinct(w)) / len(w) < 0.35)) AS n_repetitive FROM w"""))
def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    q_ = docs(spark, sf_dir).select(T.degenerate(x()).alias("q"))
    return q_.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.array_contains("q.reasons", "empty") | F.array_contains("q.reasons", "low_distinct_token_ratio")).alias("n_repetitive"))


NV = r"""(SELECT benchmark_id, CASE cast(benchmark_id AS bigint) % 6 WHEN 0 THEN gold WHEN 1 THEN '$1,' || lpad(gold, 3, '0') WHEN 2 THEN gold || '%' WHEN 3 THEN gold || '/4' WHEN 4 THEN chr(92) || 'frac{' || gold || '}{8}' ELSE 'about ' || gold END AS a, gold FROM {completions})"""


def number_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, g = F.col("benchmark_id").cast("long") % 6, F.col("gold")
    a = F.when(k == 0, g).when(k == 1, F.concat(F.lit("$1,"), F.lpad(g, 3, "0"))).when(k == 2, F.concat(g, F.lit("%"))).when(k == 3, F.concat(g, F.lit("/4"))).when(k == 4, F.concat(F.lit("\\frac{"), g, F.lit("}{8}"))).otherwise(F.concat(F.lit("about "), g))
    return completions(spark, sf_dir).select("benchmark_id", a.alias("a"), "gold")


NVE = "CASE cast(benchmark_id AS bigint) % 6 WHEN 0 THEN gold::DOUBLE WHEN 1 THEN 1000 + gold::DOUBLE WHEN 2 THEN gold::DOUBLE / 100 WHEN 3 THEN gold::DOUBLE / 4 WHEN 4 THEN gold::DOUBLE / 8 END"
_over("num01_numeric_value", number_forms, NV, "benchmark_id", lambda: {"value": F.round(A.numeric_value(F.col("a")), 6)}, {"value": f"round({NVE}, 6)"})
_over("num02_numeric_equal", number_forms, NV, "benchmark_id", lambda: {"value": A.close(A.numeric_value(F.col("a")), A.numeric_value(F.col("gold")))}, {"value": f"coalesce(abs(({NVE}) - gold::DOUBLE) <= 1e-9 + 1e-6 * greatest(abs({NVE}), gold::DOUBLE), false)"})
_over("num04_answers_equivalent", number_forms, NV, "benchmark_id", lambda: {"text": A.equivalent(F.col("gold"), F.col("a"), F.lit("text")), "numeric": A.equivalent(F.col("gold"), F.col("a"), F.lit("numeric"))},
      {"text": "a = gold", "numeric": f"coalesce(abs(({NVE}) - gold::DOUBLE) <= 1e-9 + 1e-6 * greatest(abs({NVE}), gold::DOUBLE), false)"})
#: A quadratic of each item's number K (J is K^2 - 1): factored, expanded, one term changed, over a common denominator, under a root, broken off.
FORMULAS = (r"(Kx-1)(x+K)", r"Kx^2+Jx-K", r"Kx^2+Jx-K+1", r"\frac{(Kx-1)(x^2-K^2)}{x-K}", r"\sqrt{(Kx-1)^2}\cdot(x+K)", r"Kx^2+(")


def formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, a, b: the factored form of each benchmark item's formula beside each of the six forms."""
    k = (F.length("text") % 50 + 2).cast("long")
    form = lambda p: F.replace(F.replace(F.lit(p), F.lit("K"), k.cast("string")), F.lit("J"), (k * k - 1).cast("string"))
    forms = F.array(*[F.struct(F.lit(i).alias("form"), form(p).alias("b")) for i, p in enumerate(FORMULAS)])
    return table(spark, sf_dir, "benchmark").select("item_id", form(FORMULAS[0]).alias("a"), F.explode(forms).alias("f")).select("item_id", "a", "f.*")


@register("num03_symbolic_equal", sql("SELECT item_id, form, form IN (0, 1, 3) AS equal FROM benchmark, range(6) AS f(form)"))
def symbolic_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which forms are the formula itself: a root of a square need not have the sign of what was squared."""
    return formulas(spark, sf_dir).select("item_id", F.col("form").cast("long").alias("form"), A.symbolic_equal(F.col("a"), F.col("b")).alias("equal"))


_over("num16_int_or_none", number_forms, NV, "benchmark_id", lambda: {"value": F.coalesce(A.int_or_none(F.col("a")), F.lit(-1))}, {"value": "CASE WHEN cast(benchmark_id AS bigint) % 6 = 0 THEN gold::BIGINT ELSE -1 END"})
_over("num04_answer_kind", scores, "{scores}", "benchmark_id", lambda: {"value": A.answer_kind(F.col("benchmark"), F.when(F.col("skill") == "BUILDING", "arithmetic").otherwise(F.col("skill")), F.col("normalized_predicted"), F.col("arm") == "seen")},
      {"value": "CASE WHEN coalesce(arm, '') = 'seen' THEN 'multiple_choice' WHEN skill = 'BUILDING' THEN 'numeric' ELSE 'text' END"})


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


_over("num10_norm_dot_cosine", vectors, "embeddings", "vec_id", lambda: {"norm": F.round(A.norm(e()), 5), "cosine_with_reversed": F.round(A.cosine(e(), F.reverse(e())), 5), "unit_norm": F.round(A.norm(A.unit(e())), 5)},
      {"norm": "round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5)", "cosine_with_reversed": "round(list_cosine_similarity(embedding::DOUBLE[], list_reverse(embedding::DOUBLE[])), 5)", "unit_norm": "1.0::DOUBLE"})


@register("num11_hashing_embedder", sql(f"""WITH t AS (SELECT id, {norm_sql('prompt')} AS t FROM {{items}}), g AS (SELECT id, unnest(CASE WHEN length(t) > 4 THEN list_distinct(list_transform(range(1, length(t) - 2), lambda i: substr(t, i, 4))) ELSE [t] END) AS g FROM t WHERE t <> ''),
p AS (SELECT id, h % 256 AS i, sum(CASE WHEN h // 256 % 2 = 0 THEN 1 ELSE -1 END) AS v FROM (SELECT id, {A.hashed_sql('g')} AS h FROM g) GROUP BY ALL)
SELECT id, 256 AS dims, round(sum(i * v) / sqrt(sum(v * v)), 6) AS weighted, round(greatest(max(v), 0) / sqrt(sum(v * v)), 6) AS most FROM p GROUP BY 1"""))
def hashing_embedder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embedding of each item, by its places weighted with their number and its greatest value."""
    from ..operators.vectors import hashed_embedding

    e = items(spark, sf_dir).select("id", hashed_embedding(F.col("prompt")).alias("e"))
    weighted = F.aggregate(F.transform("e", lambda v, i: v * i), F.lit(0.0), lambda acc, v: acc + v)
    return e.select("id", F.size("e").alias("dims"), F.round(weighted, 6).alias("weighted"), F.round(F.array_max("e"), 6).alias("most"))


# CLS
P, S2 = "(cast(floor(value) AS bigint) % 100) / 100e0", "(cast(floor(value) AS bigint) % 89) / 89e0"
_over("cls02_contamination_label", scores, "{scores}", "benchmark_id", lambda: {"value": R.contamination_label(p1(), p2())}, {"value": f"CASE WHEN {P} > 0.90 OR {S2} > 0.60 THEN 'contaminated' WHEN {P} > 0.75 OR {S2} > 0.30 THEN 'partial' ELSE 'clean' END"})
_over("cls03_containment_verdict", scores, "{scores}", "benchmark_id", lambda: {"value": R.containment_verdict(p1(), F.col("stratum"))}, {"value": f"CASE WHEN stratum = 0 THEN 'too_short' WHEN {P} >= 0.8 THEN 'seen' WHEN {P} <= 0.1 THEN 'unseen' ELSE 'ambiguous' END"})
_over("cls05_transition_class", scores, "{scores}", "benchmark_id", lambda: {"value": R.transition_class(p1(), p2()), "rl": R.rl_verdict(p1() - p2(), p2() - 0.5)},
      {"value": f"CASE WHEN {P} >= 0.5 AND {S2} >= 0.5 THEN 'scale_independent' WHEN {S2} >= 0.5 AND {P} < 0.1 THEN 'emergent' WHEN {S2} < 0.3 AND {P} < 0.3 THEN 'scale_resistant' ELSE 'amplified' END", "rl": f"CASE WHEN {P} - {S2} > 0.02 AND {S2} - 0.5 > 0.02 THEN 'genuine_improvement' WHEN {P} - {S2} > 0.02 THEN 'accuracy_only' WHEN {P} - {S2} < -0.02 OR {S2} - 0.5 < -0.02 THEN 'regression' ELSE 'no_change' END"})
_over("cls06_quadrant", scores, "{scores}", "benchmark_id", lambda: {"value": R.quadrant(p1(), p2())}, {"value": f"CASE WHEN {P} >= 0.5 AND {S2} >= 0.5 THEN 'genuine' WHEN {P} >= 0.5 THEN 'fragile' WHEN {S2} >= 0.5 THEN 'consistent_gap' ELSE 'random' END"})
_over("cls07_difficulty", items, "{items}", "id", lambda: dict(zip(("score", "method"), stated_difficulty(), strict=True)),
      {"score": r"CASE WHEN cast(id AS int) % 3 > 0 THEN (cast(id AS int) % 3)::DOUBLE WHEN cast(id AS int) % 2 = 0 THEN id::DOUBLE ELSE len(list_filter(regexp_split_to_array(prompt, '\s+'), lambda w: w <> '')) + 5.0::DOUBLE * len(regexp_extract_all(prompt, '-?\d+(?:\.\d+)?')) END", "method": "CASE WHEN cast(id AS int) % 3 > 0 THEN 'gsm8k_steps' WHEN cast(id AS int) % 2 = 0 THEN 'math_level' ELSE 'length_quantity' END"})
_over("cls09_probe_label", completions, "{completions}", "benchmark_id", lambda: {"recall_first": R.probe_label(F.coalesce(T.extract_numeric(c()) == F.col("gold"), F.lit(False)), T.abstains(c())), "abstain_first": R.probe_label(F.coalesce(T.extract_numeric(c()) == F.col("gold"), F.lit(False)), T.abstains(c()), False)},
      {"recall_first": rf"CASE WHEN {NUM} = gold THEN 'recall' WHEN regexp_matches(completion, '{q(T.ABSTAIN)}') THEN 'abstain' ELSE 'other' END", "abstain_first": rf"CASE WHEN regexp_matches(completion, '{q(T.ABSTAIN)}') THEN 'abstain' WHEN {NUM} = gold THEN 'recall' ELSE 'other' END"})
_over("cls10_canonical_label", scores, "{scores}", "benchmark_id", lambda: {"value": R.canonical_label(F.element_at(F.array(F.lit("exact"), F.lit("partial"), F.lit("paraphrase_candidate"), F.lit("none")), (F.floor(F.col("value")) % 4 + 1).cast("int")))}, {"value": "CASE cast(floor(value) AS bigint) % 4 WHEN 0 THEN 'contaminated' WHEN 3 THEN 'clean' ELSE 'partial' END"})
_over("flt01_answer_changing", scores, "{scores}", "benchmark_id", lambda: {"value": R.answer_changing(F.col("variant_type"), F.col("correct") & (F.col("stratum") == 2))}, {"value": "variant_type IN ('gsm_symbolic', 'numeric_perturbation') OR (correct AND stratum = 2)"})
_over("flt02_record_arm", scores, "{scores}", "benchmark_id", lambda: {"value": R.record_arm(F.col("arm"))}, {"value": "arm"})
_over("flt03_record_condition", scores, "{scores}", "benchmark_id", lambda: {"value": R.record_condition(F.col("variant_type"))}, {"value": "CASE WHEN variant_type IN ('gsm_symbolic', 'numeric_perturbation') THEN 'perturbed' ELSE 'original' END"})
_over("num05_num06_num07_proportions", scores, "{scores}", "benchmark_id",
      lambda: {"z": F.round(A.two_proportions(F.lit(90), F.lit(100), F.col("stratum") + 40, F.lit(100))[0], 6), "p": F.round(A.two_proportions(F.col("stratum") + 45, F.lit(100), F.lit(50), F.lit(100))[1], 6), "low": F.round(A.wilson(F.col("stratum") + 50, F.lit(100))[0], 6), "h": F.round(A.cohens_h(p1(), p2()), 6)},
      {"z": "round((0.9e0 - (stratum + 40) / 100e0) / sqrt((130 + stratum) / 200e0 * (1 - (130 + stratum) / 200e0) * 0.02e0), 6)", "p": f"round(least(1, 2 * {A.normal_sf_sql('abs((stratum - 5) / 100e0 / sqrt((95 + stratum) / 200e0 * (1 - (95 + stratum) / 200e0) * 0.02e0))')}), 6)",
       "low": "round(greatest(0, ((stratum + 50) / 100e0 + 3.8414588206941227e0 / 200 - 1.959963984540054e0 * sqrt((stratum + 50) / 100e0 * (1 - (stratum + 50) / 100e0) / 100 + 3.8414588206941227e0 / 40000)) / (1 + 3.8414588206941227e0 / 100)), 6)", "h": f"round(2 * asin(sqrt({P})) - 2 * asin(sqrt({S2})), 6)"})


# Worked answers in boxes, some with nested braces, some after a marker.
WORKED = r"(SELECT benchmark_id, gold, completion || CASE gold::INT % 5 WHEN 0 THEN ' \boxed{\frac{' || gold || '}{7}}' WHEN 1 THEN ' \boxed{\text{' || gold || '}} then \boxed{x' WHEN 2 THEN chr(10) || '#### ' || gold WHEN 3 THEN ' \boxed{' || gold || '} or #### 9' ELSE '' END AS t FROM {completions})"
NESTING = 8  # deep enough for the texts below; SQL has no way to count braces


def boxed_pattern(possessive: str = "+") -> str:
    r"""For SQL: \boxed{...} with braces balanced, nested up to NESTING deep; group 1 is what the box holds."""
    inner = rf"[^{{}}]*{possessive}"
    for _ in range(NESTING):
        inner = rf"[^{{}}]*{possessive}(?:\{{{inner}\}}[^{{}}]*{possessive})*{possessive}"
    return rf"\\boxed\{{({inner})\}}"


BALANCED = f"trim(regexp_extract_all(t, '{q(boxed_pattern(''))}', 1)[-1])"


def worked(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = F.col("gold")
    more = F.when(g % 5 == 0, F.concat(F.lit(r" \boxed{\frac{"), g, F.lit("}{7}}"))).when(g % 5 == 1, F.concat(F.lit(r" \boxed{\text{"), g, F.lit(r"}} then \boxed{x"))).when(g % 5 == 2, F.concat(F.lit("\n#### "), g)).when(g % 5 == 3, F.concat(F.lit(r" \boxed{"), g, F.lit("} or #### 9"))).otherwise("")
    return completions(spark, sf_dir).select("benchmark_id", "gold", F.concat("completion", more).alias("t"))


@register("txt20_boxed_balanced", sql(f"SELECT benchmark_id, {BALANCED} AS value FROM {WORKED}"))
def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return worked(spark, sf_dir).select("benchmark_id", T.boxed_balanced(F.col("t")).alias("value"))


MARKED, LASTN = r"trim(regexp_extract_all(t, '####\s*([^\n]+)', 1)[-1])", f"trim(regexp_extract_all(t, '{q(T.LAST_NUMBER)}', 1)[-1])"


@register("txt21_extract_styled", sql(f"""SELECT benchmark_id, coalesce(b, m, n) AS boxed_answer, CASE WHEN b IS NOT NULL THEN 'boxed' WHEN m IS NOT NULL THEN 'hash' WHEN n IS NOT NULL THEN 'last_number' ELSE 'none' END AS boxed_tier,
 coalesce(m, b, n) AS hash_answer, CASE WHEN m IS NOT NULL THEN 'hash' WHEN b IS NOT NULL THEN 'boxed' WHEN n IS NOT NULL THEN 'last_number' ELSE 'none' END AS hash_tier FROM (SELECT benchmark_id, {BALANCED} AS b, {MARKED} AS m, {LASTN} AS n FROM {WORKED})"""))
def styled(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = worked(spark, sf_dir).select("benchmark_id", T.extract_styled(F.col("t"), "boxed").alias("b"), T.extract_styled(F.col("t"), "hash").alias("h"))
    return w.select("benchmark_id", F.col("b.answer").alias("boxed_answer"), F.col("b.tier").alias("boxed_tier"), F.col("h.answer").alias("hash_answer"), F.col("h.tier").alias("hash_tier"))


@register("scr02_correct_unwrapped", sql(rf"SELECT benchmark_id, gold::INT % 3 <> 1 AS correct FROM {{completions}}"))
def unwrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Golds that still carry their solution in a box; a third of the predictions is off by one."""
    g = F.col("gold")
    gold = F.concat(F.lit(r"so it is \boxed{\text{"), g, F.lit("}} indeed"))
    pred = F.when(g % 3 == 0, F.concat(g, F.lit(".00"))).when(g % 3 == 1, (g + 1).cast("int").cast("string")).otherwise(F.concat(F.lit("$"), g))
    return completions(spark, sf_dir).select("benchmark_id", A.correct(pred, gold).alias("correct"))


PARTS = r"list_filter(string_split(regexp_replace(trim(text), '([.!?])\s+', '\1' || chr(2), 'g'), chr(2)), lambda p: trim(p) <> '')"


@register("txt26_whole_sentences", sql(f"SELECT doc_id, len(p) - len(list_filter(p[:-2], lambda y: regexp_matches(y, '{q(T.RUNS_ON)}'))) AS n FROM (SELECT doc_id, {PARTS} AS p FROM documents)"))
def whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.whole_sentences(x())).alias("n"))


@register("num14_minimum_detectable_effect", sql(f"""WITH RECURSIVE g AS (SELECT skill, count(*) FILTER (WHERE arm = 'seen') AS n, avg(correct::INT) AS p FROM {{scores}} GROUP BY 1), b AS (SELECT skill, n, p, 0::DOUBLE AS lo, 1 - p AS hi, 0 AS it FROM g
 UNION ALL SELECT skill, n, p, CASE WHEN ok THEN lo ELSE mid END, CASE WHEN ok THEN mid ELSE hi END, it + 1 FROM (SELECT *, {A.normal_sf_sql('(1.959963984540054 * sqrt(2 * ((2 * p + mid) / 2) * (1 - (2 * p + mid) / 2) / n) - mid) / sqrt((p * (1 - p) + (p + mid) * (1 - p - mid)) / n)').replace('::DOUBLE', '')} >= 0.8 AS ok FROM (SELECT *, (lo + hi) / 2 AS mid FROM b WHERE it < 40)))
SELECT skill, n, round(p, 6) AS base, round(p + hi, 5) AS detectable FROM b WHERE it = 40"""))
def detectable(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = scores(spark, sf_dir).groupBy("skill").agg(F.count_if(F.col("arm") == "seen").alias("n"), F.avg(F.col("correct").cast("int")).alias("p"))
    return g.select("skill", "n", F.round("p", 6).alias("base"), F.round(A.detectable(F.col("p"), F.col("n")), 5).alias("detectable"))
