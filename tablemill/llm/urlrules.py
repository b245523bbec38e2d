"""URL filters by association rules, in DataFrame code alone.

Transactions are the tokens of labelled urls (labels of the host, its suffixes, segments of the
path, names of query parameters) with the label as one more item. Spark's FP-growth mines the
frequent combinations; those that point to ``block`` with enough support, confidence and lift become
rules, of which each that contains a smaller one is pruned. Rules are matched through an
inverted index: a rule is posted under its rarest token alone, so that common tokens fetch
no rules, and the fetched ones are verified on all their tokens.

Listed rules (a host suffix with the start of a path) come first and the longest wins.

Edge cases: a null url, or one without ``://``, has empty host and path, fits no rule and
is allowed; rows with equal urls get equal verdicts and each its row; labels without a url,
or without a value, are left out; without labels nothing is mined; repeated and very long urls are urls like any
other; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemill.llm.common import ascii_lower, written

#: (host, start of the path, verdict)
LISTED = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
BLOCK = "label=block"
#: ``support`` is a share of the labelled urls; a rule needs at least ``LEAST`` of them in any case.
SUPPORT, CONFIDENCE, LIFT, LEAST = 0.002, 0.6, 1.5, 5


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return ascii_lower(F.regexp_extract(rest, "^([^/?#]*)", 1)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def _suffixes(labels: Column) -> Column:
    """A hash of each suffix of a host, the last label's first: labels are hashed with their places from the right and XORed up.

    Doubling steps make the running XOR, so that a host of n labels takes about n log n steps and no suffix is written out.
    """
    each = F.transform(F.reverse(labels), lambda x, i: F.xxhash64(x, i))
    doublings = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(labels), F.lit(2)).cast("double"))).cast("int") - 1)
    return F.aggregate(doublings, each, lambda acc, k: F.transform(acc, lambda x, i: x.bitwiseXOR(F.coalesce(F.get(acc, i - F.pow(F.lit(2.0), k).cast("int")), F.lit(0).cast("long")))))


def tokens(url: Column) -> Column:
    """The distinct tokens of a url, each marked by the part it comes from (suffixes of the host by their hashes); empty for null."""
    host, path = host_and_path(url)
    labels = F.filter(F.split(host, "\\."), lambda x: x != "")
    tail = F.transform(_suffixes(labels), lambda x: F.concat(F.lit("suffix:"), F.hex(x)))
    steps = F.filter(F.split(ascii_lower(path), "/"), lambda x: x != "")
    query = F.regexp_extract_all(F.coalesce(url, F.lit("")), F.lit("[?&]([^=&#]+)"), F.lit(1))
    parts = [
        F.transform(labels, lambda x: F.concat(F.lit("host:"), x)),
        tail,
        F.transform(F.filter(steps, lambda x: ~x.rlike("[0-9]")), lambda x: F.concat(F.lit("path:"), x)),
        F.transform(query, lambda x: F.concat(F.lit("query:"), x)),
        F.when(F.instr(url, "://") > 0, F.array(F.concat(F.lit("scheme:"), F.substring_index(url, "://", 1)))).otherwise(F.array().cast("array<string>")),
    ]
    return F.array_distinct(F.concat(*parts))


def listed_rule(host: Column, path: Column, rules: tuple = LISTED) -> tuple[Column, Column]:
    """(rule, verdict) of the longest listed rule that fits, else nulls."""
    name = verdict = F.lit(None).cast("string")
    for own, start, what in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == own) | F.endswith(host, F.lit(f".{own}"))) & F.startswith(path, F.lit(start))
        name, verdict = F.when(fits, own + start).otherwise(name), F.when(fits, what).otherwise(verdict)
    return name, verdict


def mine_items(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, lift: float = LIFT) -> tuple[DataFrame, DataFrame]:
    """Pruned rules that point to ``block`` over items, (rule, antecedent, support, confidence, lift), and which tokens an item stands for, (item, token).

    ``labelled`` has url and blocked (boolean). FP-growth enumerates combinations, so what would only
    multiply them is taken out before, which changes no rule: tokens that are rules by themselves (a rule with such
    a token and others is pruned anyway), tokens too rare among blocked urls, and all but one of tokens that occur in
    the same urls (an item stands for all of them, and a rule is held once).
    """
    rows = labelled.filter("url IS NOT NULL AND blocked IS NOT NULL").select(tokens(F.col("url")).alias("tokens"), "blocked").filter("blocked OR size(tokens) > 0")
    rows = written(rows.withColumn("id", F.monotonically_increasing_id()), "url-transactions")
    total = rows.agg(F.count("*").alias("n"), F.count_if("blocked").alias("blocked")).first()
    least = min(1.0, max(support, LEAST / max(1, total.n)))
    base = total.blocked / total.n if total.n else 0.0
    posts = rows.select("id", "blocked", F.explode("tokens").alias("token"))
    stats = posts.groupBy("token").agg(F.count("*").alias("n"), F.count_if("blocked").alias("hits"), *(F.sum(F.xxhash64("id", F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}") for i in range(2)))
    stats = stats.filter(F.col("hits") >= F.ceil(F.lit(least * total.n))).withColumn("confidence", F.col("hits") / F.col("n"))
    stats = written(stats.withColumn("lift", F.col("confidence") / F.lit(base or 1.0)), "url-tokens")
    alone = (F.col("confidence") >= confidence) & (F.col("lift") >= lift)
    singles = stats.filter(alone).select(F.array("token").alias("antecedent"), (F.col("hits") / F.lit(max(1, total.n))).alias("support"), "confidence", "lift")
    # Tokens of the same urls: their numbers and sums of hashes agree. There are at most as many as a url has tokens.
    merged = stats.filter(~alone).groupBy("n", "s0", "s1").agg(F.min("token").alias("item"), F.sort_array(F.collect_list("token")).alias("members"))
    merged = written(merged.select("item", "members"), "url-items")
    items = posts.join(merged.select(F.col("item").alias("token")), "token").groupBy("id").agg(F.collect_set("token").alias("items"))
    label = F.when(F.col("blocked"), F.array(F.lit(BLOCK))).otherwise(F.array().cast("array<string>"))
    baskets = rows.join(items, "id", "left").select(F.concat(F.coalesce("items", F.array().cast("array<string>")), label).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=least, minConfidence=confidence).fit(written(baskets, "url-baskets"))
    found = model.associationRules.filter(F.expr(f"consequent = array('{BLOCK}')") & (F.col("lift") >= lift))
    found = written(found.select(F.sort_array("antecedent").alias("antecedent"), "support", "confidence", "lift"), "url-rules")
    # A rule with all the items of a smaller one fits nothing that the smaller doesn't. Smaller ones are fetched by their rarest item.
    found = found.withColumn("rule", F.xxhash64("antecedent"))
    parts = written(found.select("rule", F.size("antecedent").alias("size"), F.explode("antecedent").alias("item")), "url-rule-items")
    rare = parts.join(parts.groupBy("item").agg(F.count("*").alias("n")), "item").groupBy("rule", "size").agg(F.min_by("item", F.struct("n", "item")).alias("item"))
    pairs = parts.select("rule", "item", "size").join(rare.select(F.col("rule").alias("small"), F.col("size").alias("less"), "item"), "item").filter("less < size").select("rule", "small", "less")
    common = pairs.join(parts.select(F.col("rule").alias("small"), "item"), "small").join(parts.select("rule", "item"), ["rule", "item"])
    covered = common.groupBy("rule", "small", "less").agg(F.count("*").alias("n")).filter("n = less").select("rule").distinct()
    kept = found.join(covered, "rule", "left_anti").select("rule", "antecedent", "support", "confidence", "lift")
    alone_ = singles.withColumn("rule", F.xxhash64("antecedent")).select("rule", "antecedent", "support", "confidence", "lift")
    rules = written(alone_.unionByName(kept), "url-pruned-rules")
    names = merged.select("item", F.explode("members").alias("token")).unionByName(singles.select(F.col("antecedent")[0].alias("item"), F.col("antecedent")[0].alias("token")))
    return rules, written(names, "url-item-tokens")


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, lift: float = LIFT) -> DataFrame:
    """(rule, antecedent, support, confidence, lift): the rules of ``mine_items`` written out over tokens, for reading; a rule of several items that stand for several tokens each has a row for every choice."""
    rules, names = mine_items(labelled, support, confidence, lift)
    members = names.groupBy("item").agg(F.sort_array(F.collect_list("token")).alias("members"))
    each = rules.select("rule", "support", "confidence", "lift", F.posexplode("antecedent").alias("i", "item")).join(members, "item")
    lists = each.groupBy("rule", "support", "confidence", "lift").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "members"))), lambda x: x["members"]).alias("lists"))
    ways = F.aggregate("lists", F.array(F.array().cast("array<string>")), lambda acc, own: F.flatten(F.transform(acc, lambda a: F.transform(own, lambda m: F.concat(a, F.array(m))))))
    wide = lists.select(F.explode(ways).alias("antecedent"), "support", "confidence", "lift").withColumn("antecedent", F.sort_array("antecedent"))
    return written(wide.withColumn("rule", F.xxhash64("antecedent")), "url-written-rules")


def matched(urls: DataFrame, rules: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """The distinct urls of ``urls`` (url) that some rule fits; with ``names`` (item, token) rules are over items, any of whose tokens will do.

    A url's tokens are rows of its number, so that a long url is never written out beside each of them. Rules are fetched by their
    rarest item, and those of several items are verified by counting the items that the url has.
    """
    own = written(urls.filter("url IS NOT NULL").distinct().withColumn("id", F.monotonically_increasing_id()), "distinct-urls")
    posts = own.select("id", F.explode(tokens(F.col("url"))).alias("token"))
    posts = posts.withColumnRenamed("token", "item") if names is None else posts.join(names, "token").select("id", "item").distinct()
    parts = rules.select("rule", F.size("antecedent").alias("size"), F.explode("antecedent").alias("item"))
    posts = written(posts.join(parts.select("item").distinct(), "item", "left_semi"), "url-posts")
    seen = posts.groupBy("item").agg(F.count("*").alias("n"))
    index = written(parts.join(seen, "item").groupBy("rule", "size").agg(F.min_by("item", F.struct("n", "item")).alias("item")), "url-index")
    fetched = written(posts.join(index, "item").select("id", "rule", "size"), "fetched-rules")
    several = fetched.filter("size > 1")
    held = several.join(parts.select("rule", "item"), "rule").join(posts, ["id", "item"]).groupBy("id", "rule", "size").agg(F.count("*").alias("n")).filter("n = size")
    hits = fetched.filter("size = 1").select("id").unionByName(held.select("id")).distinct()
    return own.join(hits, "id", "left_semi").select("url")


def judge(pages: DataFrame, rules: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, and whether mined rules fit (``mined``), for every row of ``pages``."""
    blocked = written(matched(pages.select("url"), rules, names).withColumn("hit", F.lit(True)), "url-blocked")
    host, path = host_and_path(F.col("url"))
    out = pages.select("page_id", "url").join(blocked, "url", "left").withColumn("host", host).withColumn("path", path)
    name, verdict = listed_rule(F.col("host"), F.col("path"))
    mined = F.coalesce("hit", F.lit(False))
    return out.select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, F.when(mined, "block").otherwise("allow")).alias("verdict"), mined.alias("mined"))


def labelled_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, blocked): a page is labelled through the document of the same id; bad or toxic ones are to be blocked."""
    own = labels.filter("doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL)")
    bad = (F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)
    return pages.select("page_id", "url").join(own, F.col("page_id") == F.col("doc_id")).select("url", bad.alias("blocked"))


def op9(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict, mined."""
    return judge(pages, *mine_items(labelled_urls(pages, labels)))
