"""Queries for analytics over records; labels, documents, events and conversations stand for records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemill.operators import compare, records
from tablemill.plans.base import Book, Tables

BOOK = Book()
add = BOOK.add


def samples(t: Tables) -> DataFrame:
    """Events as samples: twenty tasks, the sample's number, and whether it is right."""
    return t.events.select((F.col("user_id") % 20).alias("task"), (F.col("event_id") % 7).alias("sample"), (F.col("value") > 100).alias("correct"), "event_id", "value", "user_id", "event_type")


SAMPLES = "(SELECT user_id % 20 AS task, event_id % 7 AS sample, value > 100 AS correct, event_id, value, user_id, event_type FROM events)"


def scored(t: Tables) -> DataFrame:
    return t.labels.join(t.documents.select("doc_id", "n_chars", "lang"), "doc_id")


SCORED = "labels JOIN documents USING (doc_id)"
COUNTS = lambda t: t.lineitem.select("l_returnflag", "l_quantity")
SHUFFLED = lambda t: t.lineitem.select("l_returnflag", "l_quantity").orderBy("l_quantity")

add("cmp_bird_set", lambda t: compare.same_set(COUNTS(t), SHUFFLED(t).distinct()), "SELECT true AS equal")
add("cmp_bird_set_differs", lambda t: compare.same_set(COUNTS(t), COUNTS(t).filter("l_quantity < 50")), "SELECT false AS equal")
add("cmp_multiset", lambda t: compare.multiset(COUNTS(t), SHUFFLED(t)), "SELECT true AS equal")
add("cmp_multiset_differs", lambda t: compare.multiset(COUNTS(t), COUNTS(t).distinct()), "SELECT count(*) = count(DISTINCT (l_returnflag, l_quantity)) AS equal FROM lineitem")
add("cmp_similarity", lambda t: compare.similarity(t.documents.select("doc_id"), t.labels.select("doc_id")), "SELECT 0.8::DOUBLE * ((SELECT count(*) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)) / (SELECT count(*) FROM (SELECT doc_id FROM documents UNION SELECT doc_id FROM labels))) + 0.1::DOUBLE + 0.1::DOUBLE * ((SELECT count(*) FROM labels) / (SELECT count(*) FROM documents)) AS similarity")
add("cmp_projection", lambda t: compare.projection(t.customer, t.customer.select("C_NAME", "c_custkey")), "SELECT c_name AS \"C_NAME\", c_custkey FROM customer")
add("fingerprint_set", lambda t: t.spark.range(1).select((compare.fingerprint_set(COUNTS(t)).scalar() == compare.fingerprint_set(SHUFFLED(t).distinct()).scalar()).alias("same"), (compare.fingerprint_set(COUNTS(t)).scalar() == compare.fingerprint_set(COUNTS(t).filter("l_quantity < 50")).scalar()).alias("other")), "SELECT true AS same, false AS other")
add("fingerprint_schema", lambda t: t.spark.range(1).select(F.lit(compare.fingerprint_schema({"a": t.region}) == compare.fingerprint_schema({"a": t.region.limit(1)})).alias("same")), "SELECT true AS same")


def cells(t: Tables) -> DataFrame:
    """All events: each user is a candidate, eight of them for one question."""
    return t.events.select(F.floor(F.col("user_id") / 8).alias("task"), F.col("user_id").alias("candidate"), F.lit("type").alias("place"), F.col("event_type").alias("value"))


PAIRS = """WITH k AS (SELECT user_id // 8 AS task, user_id AS c, event_type AS v, count(*) AS n FROM events GROUP BY ALL),
s AS (SELECT task, c, sum(n) AS size FROM k GROUP BY ALL),
p AS (SELECT x.task AS task, x.c AS a, y.c AS b, sum(least(x.n, y.n)) AS same FROM k x JOIN k y ON x.task = y.task AND x.v = y.v GROUP BY ALL),
r AS (SELECT p.task AS task, a, b, CAST(same / (s1.size + s2.size - same) AS DOUBLE) AS similarity FROM p JOIN s s1 ON s1.task = p.task AND s1.c = a JOIN s s2 ON s2.task = p.task AND s2.c = b) """
MEDOIDS = "SELECT task, a AS candidate FROM r GROUP BY task, a QUALIFY row_number() OVER (PARTITION BY task ORDER BY round(sum(similarity), 12) DESC, a) = 1"
add("soft_similarity", lambda t: records.soft_similarity(cells(t), "candidate", "place", "value", "task"), PAIRS + "SELECT * FROM r")
add("majority_medoid", lambda t: records.medoids(cells(t), "candidate", "place", "value", "task"), PAIRS + MEDOIDS)


def task_cells(t: Tables) -> DataFrame:
    """All events: each user is a candidate of one of the twenty tasks of ``samples``."""
    return t.events.select((F.col("user_id") % 20).alias("task"), F.col("user_id").alias("candidate"), F.lit("type").alias("place"), F.col("event_type").alias("value"))


TASK_PAIRS = """WITH k AS (SELECT user_id % 20 AS task, user_id AS c, event_type AS v, count(*) AS n FROM events GROUP BY ALL),
s AS (SELECT task, c, sum(n) AS size FROM k GROUP BY ALL),
p AS (SELECT x.task AS task, x.c AS a, y.c AS b, sum(least(x.n, y.n)) AS same FROM k x JOIN k y ON x.task = y.task AND x.v = y.v GROUP BY ALL),
r AS (SELECT p.task AS task, a, b, CAST(same / (s1.size + s2.size - same) AS DOUBLE) AS similarity FROM p JOIN s s1 ON s1.task = p.task AND s1.c = a JOIN s s2 ON s2.task = p.task AND s2.c = b) """
add("soft_similarity_by_task", lambda t: records.soft_similarity(task_cells(t), "candidate", "place", "value", "task"), TASK_PAIRS + "SELECT * FROM r")
add("majority_medoid_by_task", lambda t: records.medoids(task_cells(t), "candidate", "place", "value", "task"), TASK_PAIRS + "SELECT task, a AS candidate FROM r GROUP BY task, a QUALIFY row_number() OVER (PARTITION BY task ORDER BY round(sum(similarity), 12) DESC, a) = 1")
add("pass_at_k", lambda t: records.pass_at_k(samples(t), 3), f"SELECT CAST(sum(ok) AS BIGINT) AS passed, count(*) AS tasks, avg(ok) AS rate FROM (SELECT task, max(CASE WHEN sample < 3 AND correct THEN 1 ELSE 0 END) AS ok FROM {SAMPLES} GROUP BY task)")
add("group_advantage", lambda t: records.group_advantage(samples(t).select("event_id", "task", "value"), "task", "value").withColumn("advantage", F.round("advantage", 6)), f"SELECT event_id, task, value, round(CASE WHEN min(value) OVER w = max(value) OVER w THEN 0.0 ELSE (value - avg(value) OVER w) / (stddev_pop(value) OVER w + 1e-6) END, 6) AS advantage FROM {SAMPLES} WINDOW w AS (PARTITION BY task)")
add("return_to_go", lambda t: records.return_to_go(t.conversations.select("conv_id", "turn", F.length("text").alias("reward")), "conv_id", "turn", "reward", 0.5).withColumn("return_to_go", F.round("return_to_go", 6)), "SELECT a.conv_id, a.turn, CAST(length(a.text) AS INTEGER) AS reward, round(sum(length(b.text) * pow(0.5, b.turn - a.turn)), 6) AS return_to_go FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn >= a.turn GROUP BY a.conv_id, a.turn, a.text")
add("ambiguity_mask", lambda t: records.ambiguity_mask(samples(t).select("event_id", "user_id", "event_type", "correct"), ["user_id", "event_type"]), f"SELECT event_id, user_id, event_type, correct, CASE WHEN bool_and(correct) OVER w <> bool_or(correct) OVER w THEN 0 ELSE 1 END AS mask FROM {SAMPLES} WINDOW w AS (PARTITION BY user_id, event_type)")
add("reward_ladder", lambda t: scored(t).select("doc_id", records.result_reward(F.col("quality") == 1, F.col("toxic") == 1, "four-level").alias("reward")), f"SELECT doc_id, CAST(CASE WHEN quality = 1 THEN CASE WHEN toxic = 1 THEN 1.0 ELSE 1.5 END WHEN toxic = 1 THEN -1.0 ELSE -0.5 END AS DOUBLE) AS reward FROM {SCORED}")
add("reward_execution", lambda t: scored(t).select("doc_id", records.execution_reward(F.col("quality") == 1, F.col("n_chars") > 500).alias("reward")), f"SELECT doc_id, CAST(CASE WHEN quality = 1 THEN 1 WHEN n_chars > 500 THEN 0.2 ELSE 0 END AS DOUBLE) AS reward FROM {SCORED}")
add("search_reduction", lambda t: t.orders.groupBy("o_custkey").agg(records.search_reduction(F.count("*") + 10, F.count("*"), F.count_if(F.col("o_totalprice") > 200000)).alias("gain")).withColumn("gain", F.round("gain", 9)), "SELECT o_custkey, round(CASE WHEN count(*) FILTER (WHERE o_totalprice > 200000) > 0 THEN (ln(count(*) + 1) - ln(count(*) FILTER (WHERE o_totalprice > 200000) + 1)) / ln(count(*) + 11) ELSE 0 END, 9) AS gain FROM orders GROUP BY o_custkey")
add("percentile_linear", lambda t: records.percentile(t.orders, "o_totalprice", 0.9), "SELECT quantile_cont(o_totalprice, 0.9) AS value FROM orders")
add("percentile_nearest", lambda t: records.percentile(t.orders, "o_totalprice", 0.9, "nearest"), "SELECT quantile_disc(o_totalprice, 0.9) AS value FROM orders")
add("percentile_floor", lambda t: records.percentile(t.orders, "o_totalprice", 0.37, "floor"), "SELECT o_totalprice AS value FROM orders ORDER BY o_totalprice LIMIT 1 OFFSET (SELECT CAST(floor(0.37::DOUBLE * count(*)) AS BIGINT) FROM orders)")
add("distribution", lambda t: records.distribution(t.documents, "n_chars"), "SELECT count(n_chars) AS n, avg(n_chars) AS mean, quantile_cont(n_chars, 0.5) AS median, quantile_cont(n_chars, 0.75) AS p75, quantile_cont(n_chars, 0.9) AS p90, CAST(max(n_chars) AS DOUBLE) AS max FROM documents")
RANKS = f"(SELECT *, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2 AS r FROM {SCORED})"
add("roc_auc", lambda t: records.roc_auc(scored(t), "n_chars", "quality").select(F.round("auc", 9).alias("auc")), f"SELECT round((sum(r) FILTER (WHERE quality = 1) - p * (p + 1) / 2) / (p * (n - p)), 9) AS auc FROM {RANKS}, (SELECT count(*) FILTER (WHERE quality = 1) AS p, count(*) AS n FROM {SCORED}) GROUP BY p, n")
add("pearson", lambda t: records.pearson(scored(t), "n_chars", "quality").select(F.round("correlation", 9).alias("correlation")), f"SELECT round(corr(n_chars, quality), 9) AS correlation FROM {SCORED}")
TWO = "(SELECT rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2 AS a, rank() OVER (ORDER BY o_custkey) + (count(*) OVER (PARTITION BY o_custkey) - 1) / 2 AS b FROM orders)"
add("spearman", lambda t: records.spearman(t.orders, "o_totalprice", "o_custkey").select(F.round("correlation", 9).alias("correlation")), f"SELECT round(corr(a, b), 9) AS correlation FROM {TWO}")


def arm(t: Tables, i: int) -> DataFrame:
    return t.customer.select("c_custkey", (F.col("c_custkey") % (i + 3) != 0).alias("correct"))


#: The two-sided chance of a split of a + b fair throws, to nine digits.
P_VALUE = "round(least(1.0, 2 * list_sum(list_transform(range(0, least({a}, {b}) + 1), lambda i: exp(lgamma({a} + {b} + 1) - lgamma(i + 1) - lgamma({a} + {b} - i + 1) - ({a} + {b}) * ln(2))))), 9) AS p_value"
add("mcnemar_exact", lambda t: records.mcnemar_exact(arm(t, 0), arm(t, 1), "c_custkey").withColumn("p_value", F.round("p_value", 9)), f"SELECT gains, losses, {P_VALUE.format(a='gains', b='losses')} FROM (SELECT count(*) FILTER (WHERE c_custkey % 3 = 0 AND c_custkey % 4 <> 0) AS gains, count(*) FILTER (WHERE c_custkey % 3 <> 0 AND c_custkey % 4 = 0) AS losses FROM customer)")
add("sign_test", lambda t: records.sign_test(t.lineitem, "l_tax", "l_discount").withColumn("p_value", F.round("p_value", 9)), f"SELECT higher, lower, {P_VALUE.format(a='higher', b='lower')} FROM (SELECT count(*) FILTER (WHERE l_discount > l_tax) AS higher, count(*) FILTER (WHERE l_discount < l_tax) AS lower FROM lineitem)")
add("sign_test_even", lambda t: records.sign_test(t.events.select(F.col("event_id") % 101, F.col("event_id") % 103).toDF("x", "y"), "x", "y").withColumn("p_value", F.round("p_value", 7)), f"SELECT higher, lower, round({P_VALUE.format(a='higher', b='lower').removesuffix(' AS p_value')}, 7) AS p_value FROM (SELECT count(*) FILTER (WHERE event_id % 103 > event_id % 101) AS higher, count(*) FILTER (WHERE event_id % 103 < event_id % 101) AS lower FROM events)")
add("wilson_ci", lambda t: records.wilson_ci(t.labels, "quality").select("n", *(F.round(c, 9).alias(c) for c in ("rate", "low", "high"))), "SELECT n, round(p, 9) AS rate, round((p + z * z / (2 * n)) / (1 + z * z / n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n), 9) AS low, round((p + z * z / (2 * n)) / (1 + z * z / n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n), 9) AS high FROM (SELECT count(quality) AS n, avg(quality) AS p, 1.96::DOUBLE AS z FROM labels)")
add("bootstrap_ci", lambda t: records.bootstrap_ci(t.labels, "quality", rounds=200, key="doc_id"))
add("bootstrap_cluster_ci", lambda t: records.bootstrap_ci(samples(t), "value", rounds=200, cluster="task"))
add("cohens_d", lambda t: records.cohens_d(scored(t), "quality", "n_chars", 1, 0).select(F.round("effect", 9).alias("effect")), f"SELECT round((m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)), 9) AS effect FROM (SELECT avg(n_chars) FILTER (WHERE quality = 1) AS m1, avg(n_chars) FILTER (WHERE quality = 0) AS m0, var_samp(n_chars) FILTER (WHERE quality = 1) AS v1, var_samp(n_chars) FILTER (WHERE quality = 0) AS v0, count(*) FILTER (WHERE quality = 1) AS n1, count(*) FILTER (WHERE quality = 0) AS n0 FROM {SCORED})")
SHARES = "(SELECT coalesce(x.s, 0) AS p, coalesce(y.s, 0) AS q FROM (SELECT lang, count(*) / (SELECT count(*) FROM documents) AS s FROM documents GROUP BY lang) x FULL JOIN (SELECT lang, count(*) / sum(count(*)) OVER () AS s FROM " + SCORED + " GROUP BY lang) y USING (lang))"
add("js_divergence", lambda t: records.js_divergence(t.documents, scored(t), "lang").select(F.round("divergence", 9).alias("divergence")), f"SELECT round(sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2, 9) AS divergence FROM {SHARES}")
add("total_variation", lambda t: records.total_variation(t.documents, scored(t), "lang").select(F.round("distance", 9).alias("distance")), f"SELECT round(sum(abs(p - q)) / 2, 9) AS distance FROM {SHARES}")


def runs(t: Tables) -> DataFrame:
    return scored(t).select("doc_id", "lang", (F.col("quality") == 1).alias("correct"), (F.col("toxic") == 0).alias("legal"), (F.col("n_chars") % 9).alias("n_steps"))


add("arm_metrics", lambda t: records.arm_metrics(runs(t), ["lang"]), f"SELECT lang, count(*) AS runs, avg(quality) AS accuracy, avg(1 - toxic) AS legal_rate, avg(n_chars % 9) AS mean_steps FROM {SCORED} GROUP BY lang")
add("eval_summary", lambda t: records.arm_metrics(runs(t), []), f"SELECT count(*) AS runs, avg(quality) AS accuracy, avg(1 - toxic) AS legal_rate, avg(n_chars % 9) AS mean_steps FROM {SCORED}")
add("adjacent_repeats", lambda t: records.adjacent_repeats(t.events, "user_id", "event_id", "event_type"), "SELECT user_id, count(*) FILTER (WHERE same) AS repeats FROM (SELECT user_id, event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS same FROM events) GROUP BY user_id")
add("arm_compare", lambda t: records.paired_counts(arm(t, 0), arm(t, 1), "c_custkey"), "SELECT count(*) FILTER (WHERE c_custkey % 3 <> 0 AND c_custkey % 4 <> 0) AS both, count(*) FILTER (WHERE c_custkey % 3 = 0 AND c_custkey % 4 <> 0) AS gains, count(*) FILTER (WHERE c_custkey % 3 <> 0 AND c_custkey % 4 = 0) AS losses, count(*) FILTER (WHERE c_custkey % 12 = 0) AS neither FROM customer")
add("sequence_distance", lambda t: records.edit_distances(t.part.select("p_partkey", F.split("p_name", "").alias("a"), F.split("p_type", "").alias("b")), "a", "b").select("p_partkey", "edit_distance", "common_prefix"), "SELECT p_partkey, CAST(levenshtein(p_name, p_type) AS INTEGER) AS edit_distance, CAST(coalesce(list_position(list_transform(range(1, least(length(p_name), length(p_type)) + 1), lambda i: p_name[i] <> p_type[i]), true) - 1, least(length(p_name), length(p_type))) AS INTEGER) AS common_prefix FROM part")
add("tool_usage", lambda t: records.tool_usage(t.events, "user_id", "event_type"), "SELECT event_type AS tool, count(*) AS calls, count(DISTINCT user_id) AS runs, count(DISTINCT user_id) / (SELECT count(DISTINCT user_id) FROM events) AS run_share FROM events GROUP BY event_type")
add("usage_profile", lambda t: records.usage_profile(t.events, "user_id", "event_type"), "SELECT event_type AS tool, CAST(sum(n) AS BIGINT) AS calls, sum(n) / (SELECT count(*) FROM events) AS call_share, count(*) AS runs, count(*) / (SELECT count(DISTINCT user_id) FROM events) AS run_share, quantile_cont(n, 0.5) AS p50, quantile_cont(n, 0.9) AS p90 FROM (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL) GROUP BY event_type")
add("run_summary", lambda t: records.run_summary(runs(t).withColumn("elapsed", F.col("n_steps") * 2).withColumn("failure", F.when(~F.col("legal"), "toxic")), ["lang"], "elapsed", "failure"), f"SELECT lang, count(*) AS runs, avg(quality) AS accuracy, avg(1 - toxic) AS legal_rate, avg(n_chars % 9) AS mean_steps, avg(n_chars % 9 * 2) AS mean_elapsed, count(*) FILTER (WHERE toxic <> 0) AS failures FROM {SCORED} GROUP BY lang")
add("failure_buckets", lambda t: records.failure_buckets(scored(t), [("toxic", F.col("toxic") == 1), ("poor", F.col("quality") == 0), ("short", F.col("n_chars") < 200)]), f"SELECT CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 0 THEN 'poor' WHEN n_chars < 200 THEN 'short' ELSE 'other' END AS bucket, count(*) AS n FROM {SCORED} GROUP BY 1")
add("stratified_quota", lambda t: records.stratified_quota(t.documents.select("doc_id", "lang"), "lang", "doc_id", 40), """
    WITH n AS (SELECT lang, count(*) AS k, count(*) * 40 // (SELECT count(*) FROM documents) AS low, count(*) * 40 % (SELECT count(*) FROM documents) AS rest FROM documents GROUP BY lang),
    q AS (SELECT lang, low + CASE WHEN row_number() OVER (ORDER BY rest DESC, lang DESC) <= 40 - sum(low) OVER () THEN 1 ELSE 0 END AS quota FROM n)
    SELECT doc_id, lang FROM documents JOIN q USING (lang) QUALIFY row_number() OVER (PARTITION BY lang ORDER BY sha256(chr(0) || chr(0) || CAST(doc_id AS VARCHAR))) <= max(quota) OVER (PARTITION BY lang)""")
add("quantile_bins", lambda t: records.quantile_bins(t.documents.select("doc_id", "n_chars"), "n_chars"), "WITH c AS (SELECT quantile_disc(n_chars, [0.2, 0.4, 0.6, 0.8]) AS cuts FROM documents) SELECT doc_id, n_chars, 'q' || (len(list_filter(cuts, lambda x: x < n_chars)) + 1) AS bin FROM documents, c")
add("weighted_interleave", lambda t: records.weighted_interleave(t.documents.select("doc_id", "lang"), "lang", "doc_id"), """
    WITH RECURSIVE n AS (SELECT lang, count(*) AS k FROM documents GROUP BY lang),
    z AS (SELECT list(k ORDER BY lang) AS sizes, list(lang ORDER BY lang) AS names, CAST(sum(k) AS BIGINT) AS total FROM n),
    s AS (
      SELECT CAST(0 AS BIGINT) AS step, list_transform(sizes, lambda x: CAST(0 AS BIGINT)) AS used, CAST(0 AS BIGINT) AS won FROM z
      UNION ALL
      SELECT step + 1, list_transform(used, lambda u, i: u + CASE WHEN i = w THEN 1 ELSE 0 END), w FROM (
        SELECT step, used, CAST(list_position(behind, list_max(behind)) AS BIGINT) AS w FROM (
          SELECT step, used, list_transform(sizes, lambda x, i: CASE WHEN used[i] < x THEN CAST(x * (step + 1) AS DOUBLE) / total - used[i] ELSE -1e300 END) AS behind FROM s, z WHERE step < total)))
    SELECT doc_id, d.lang, step AS place FROM (SELECT step, names[won] AS lang, used[won] AS number FROM s, z WHERE won > 0) t
    JOIN (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS number FROM documents) d ON d.lang = t.lang AND d.number = t.number""")
add("round_robin_shard", lambda t: records.round_robin_shard(t.documents.select("doc_id"), "doc_id", 7), "SELECT doc_id, CAST((row_number() OVER (ORDER BY doc_id) - 1) % 7 AS INTEGER) AS shard FROM documents")
add("merge_disjoint", lambda t: records.merge_disjoint([t.labels.filter("doc_id % 2 = 0"), t.labels.filter("doc_id % 2 = 1")], "doc_id"), "SELECT * FROM labels")
add("merge_attempts", lambda t: records.merge_attempts(t.labels.withColumn("complete", F.lit(True)), "doc_id", "complete").select("doc_id"), "SELECT doc_id FROM labels")
add("nonempty_gate", lambda t: t.spark.range(1).select(F.lit(records.nonempty_gate(t.labels.filter("quality = 0"))).alias("some"), F.lit(records.nonempty_gate(t.labels.filter("quality = 7"))).alias("none")), "SELECT true AS some, false AS none")
add("leak_partition", lambda t: t.customer.select("c_custkey", records.leak_partition(F.col("c_custkey")).alias("part")), "SELECT c_custkey, CAST(('0x' || substr(sha256(CAST(c_custkey AS VARCHAR)), 1, 8))::BIGINT % 5 AS INTEGER) AS part FROM customer")


# -- arms, runs and attempts in more depth ---------------------------------------------------------
def _half(t: Tables, odd: int) -> DataFrame:
    """One arm's run for each user: every other of the user's events."""
    own = t.events.filter(F.col("event_id") % 2 == odd)
    return own.groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("event_id", F.substring("event_type", 1, 1).alias("tool")))), lambda x: x["tool"]).alias("actions"), (F.max("value") > 150).alias("correct"), F.count("*").alias("steps"))


def _pairs(t: Tables) -> DataFrame:
    return records.arm_pairs(_half(t, 0), _half(t, 1), "user_id", "actions", "correct", "steps")


HALF = "(SELECT user_id, string_agg(event_type[1], '' ORDER BY event_id) AS actions, max(value) > 150 AS correct, count(*) AS steps FROM events WHERE event_id % 2 = {} GROUP BY user_id)"
PAIRS = f"""(SELECT b.user_id, b.correct AS baseline_correct, c.correct AS candidate_correct, b.steps AS baseline_steps, c.steps AS candidate_steps, c.steps - b.steps AS step_delta,
    CAST(levenshtein(b.actions, c.actions) AS INTEGER) AS edit_distance, levenshtein(b.actions, c.actions) / greatest(length(b.actions), length(c.actions)) AS normalized_distance,
    CAST(coalesce(list_position(list_transform(range(1, least(length(b.actions), length(c.actions)) + 1), lambda i: b.actions[i] <> c.actions[i]), true) - 1, least(length(b.actions), length(c.actions))) AS INTEGER) AS common_prefix,
    b.actions[1] <> c.actions[1] AS first_changed, b.actions <> c.actions AS changed FROM {HALF.format(0)} b JOIN {HALF.format(1)} c USING (user_id))"""
add("arm_pairs", _pairs, f"SELECT * FROM {PAIRS}")
add("arm_distances", lambda t: records.arm_distances(_pairs(t)).select("pairs", "gains", "regressions", *(F.round(c, 9).alias(c) for c in ("mean_distance", "mean_normalized", "mean_step_delta", "first_changed", "changed"))),
    f"SELECT count(*) AS pairs, count(*) FILTER (WHERE candidate_correct AND NOT baseline_correct) AS gains, count(*) FILTER (WHERE baseline_correct AND NOT candidate_correct) AS regressions, round(avg(edit_distance), 9) AS mean_distance, round(avg(normalized_distance), 9) AS mean_normalized, round(avg(step_delta), 9) AS mean_step_delta, round(avg(CAST(first_changed AS INTEGER)), 9) AS first_changed, round(avg(CAST(changed AS INTEGER)), 9) AS changed FROM {PAIRS}")
add("arm_tools", lambda t: records.arm_tools({"baseline": t.events.filter("event_id % 2 = 0"), "candidate": t.events.filter("event_id % 2 = 1")}, "event_type"), "SELECT event_type AS tool, count(*) FILTER (WHERE event_id % 2 = 0) AS baseline, count(*) FILTER (WHERE event_id % 2 = 1) AS candidate FROM events GROUP BY event_type")
add("run_lengths", lambda t: records.run_lengths(t.events, "user_id"), "SELECT count(*) AS runs, CAST(sum(n) AS BIGINT) AS calls, avg(n) AS mean, min(n) AS min, max(n) AS max, " + ", ".join(f"list_sort(list(n))[CAST(floor({q}::DOUBLE * (count(*) - 1)) AS BIGINT) + 1] AS p{round(100 * q)}" for q in records.LENGTHS) + " FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id)")
TAGS = {"high_value": "value > 150", "low_value": "value < 0.01", "error_at_cost": "event_type = 'error' AND value > 20", "never": "value < 0"}
add("usage_features", lambda t: records.usage_features(t.events, "user_id", {n: F.expr(c) for n, c in TAGS.items()}), " UNION ALL ".join(f"SELECT '{n}' AS feature, count(DISTINCT user_id) FILTER (WHERE {c}) AS runs, count(DISTINCT user_id) FILTER (WHERE {c}) / count(DISTINCT user_id) AS run_share FROM events" for n, c in TAGS.items()))
add("partition_labels", lambda t: records.partition_labels(t.part.select("p_partkey", "p_brand", "p_type"), ["p_brand", "p_type"], t.part.filter("p_size > 45")), r"""
    WITH k AS (SELECT *, sha256(trim(regexp_replace(lower(p_brand), '\s+', ' ', 'g')) || chr(0) || trim(regexp_replace(lower(p_type), '\s+', ' ', 'g'))) AS key FROM part)
    SELECT p_partkey, p_brand, p_type, CASE WHEN key IN (SELECT key FROM k WHERE p_size > 45) THEN 'reviewed_development' WHEN ('0x' || substr(key, 1, 8))::BIGINT % 5 = 0 THEN 'reserved_unread' ELSE 'discovery' END AS partition FROM k""".replace("\\\\", "\\"))


def _attempts(t: Tables) -> DataFrame:
    """An order's lines are attempts at it; the one that was shipped last, if it was returned, is the complete one."""
    last = t.lineitem.groupBy("l_orderkey").agg(F.max(F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")).alias("k"))
    own = t.lineitem.join(last, "l_orderkey").withColumn("complete", (F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice") == F.col("k")) & (F.col("l_returnflag") == "R"))
    tries = own.select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "complete")
    out = records.attempts_merged(tries, "o_orderkey", "complete", t.orders.select("o_orderkey"))
    return out.select("o_orderkey", "attempts", "status", F.col("attempt.l_partkey").alias("l_partkey"))


add("attempts_merged", _attempts, """
    WITH a AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_linenumber DESC, l_extendedprice DESC) = 1 AND l_returnflag = 'R' AS complete FROM lineitem)
    SELECT o_orderkey, count(l_orderkey) AS attempts, CASE WHEN bool_or(complete) THEN 'complete' WHEN count(l_orderkey) > 0 THEN 'incomplete' ELSE 'missing' END AS status, max(l_partkey) FILTER (WHERE complete) AS l_partkey
    FROM orders LEFT JOIN a ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
