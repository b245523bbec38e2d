from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tablemill.llm import urlrules


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = lambda s, stops: s[: min((s.find(c) for c in stops if c in s), default=len(s))]
    host = cut(rest, "/?#")
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), cut(rest[len(host) :], "?#")


def plain_rule(url):
    host, path = plain_parts(url)
    fits = [(h + p, v) for h, p, v in urlrules.LISTED if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda x: len(x[0]), default=(None, None))


URLS = ["http://a.example.NET/en/1", "https://example.com/de/x?y=1", "http://x.org/fr/", "http://net", "http://net/", "http://fnet/", "http://b.net/de/",
        None, "", "no scheme", "x://", "http://é.Example.com/de/é#f", "http://example.com?q=/de/", "http://a.org/en://net/", "http://u\nv.net/\nx"]


def test_listed_rules(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").withColumn("rule", F.lit("clash"))
    found = urlrules.judge(pages, spark.createDataFrame([], "rule long, antecedent array<string>")).collect()
    assert len(found) == len(URLS)
    for r in found:
        name, verdict = plain_rule(URLS[r.page_id])
        assert (r.host, r.path, r.rule, r.verdict) == (*plain_parts(URLS[r.page_id]), name, verdict or "allow")


@pytest.fixture
def labelled(spark):
    rows = [(f"http://{'spam' if i % 4 == 0 else 'good'}{i % 3}.example.{'org' if i % 2 else 'info'}/{'win' if i % 5 == 0 else 'news'}/{i}?{'aff' if i % 3 == 0 else 'id'}={i}", i % 4 == 0 or (i % 15 == 0 and i % 7 != 0)) for i in range(300)]
    return spark.createDataFrame([*rows, (None, True), ("http://x.info/", None)], "url string, blocked boolean")


def test_rules_and_matches_by_brute_force(spark, labelled):
    rows = [(set(r.t), r.blocked) for r in labelled.filter("url IS NOT NULL AND blocked IS NOT NULL").select(urlrules.tokens(F.col("url")).alias("t"), "blocked").collect()]
    support, confidence, lift, share = 0.05, 0.6, 1.2, sum(b for _, b in rows) / len(rows)
    good = []
    for combo in sorted({c for t, _ in rows for k in range(1, len(t) + 1) for c in combinations(sorted(t), k)}, key=len):
        own = [b for t, b in rows if t >= set(combo)]
        if sum(own) >= support * len(rows) and sum(own) / len(own) >= confidence and sum(own) / len(own) / share >= lift:
            if not any(set(g) < set(combo) for g in good):
                good.append(combo)
    rules = urlrules.mine(labelled, support, confidence, lift)
    assert sorted(tuple(r.antecedent) for r in rules.collect()) == sorted(good)
    hit = {r.url for r in urlrules.matched(labelled.select("url"), rules).collect()}
    tokens = {r.url: set(r.t) for r in labelled.filter("url IS NOT NULL").select("url", urlrules.tokens(F.col("url")).alias("t")).collect()}
    assert hit == {u for u, t in tokens.items() if any(t >= set(g) for g in good)} and hit


def test_empty_tables(spark):
    pages, labels = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.verdict for r in urlrules.op9(pages, labels).collect()] == ["allow"]
    assert urlrules.op9(pages.limit(0), labels).count() == 0


def test_suffixes_are_told_apart(spark):
    hosts = ["a.b.c", "x.a.b.c", "b.c", "c.b", "b.b.c", "a.a", "a", "a.a.a", ""]
    got = {h: spark.createDataFrame([(f"http://{h}/",)], "url string").select(urlrules.tokens(F.col("url")).alias("t")).first().t for h in hosts}
    by_suffix = {}
    for h, t in got.items():
        labels, own = h.split(".") if h else [], [x for x in t if x.startswith("suffix:")]
        assert len(own) == len(labels)
        for n, token in enumerate(own, 1):
            by_suffix.setdefault(".".join(labels[-n:]), set()).add(token)
    assert all(len(x) == 1 for x in by_suffix.values()) and len(set.union(*by_suffix.values())) == len(by_suffix)


def test_a_url_of_a_megabyte(spark):
    """Half a million labels, and a path and a query as long: in seconds, as nothing grows with the square."""
    import time

    urls = [("http://" + "a." * 500_000 + "spam.net/x", True), ("http://spam.net/" + "b/" * 250_000 + "?" + "c=1&" * 100_000, True), ("http://good.org/", False)] + [(f"http://s{i}.spam.net/{i}", True) for i in range(20)] + [(f"http://g{i}.good.org/{i}", False) for i in range(20)]
    df = spark.createDataFrame(urls, "url string, blocked boolean")
    start = time.monotonic()
    rules, names = urlrules.mine_items(df)
    hit = {u.url for u in urlrules.matched(df.select("url"), rules, names).collect()}
    assert hit == {u for u, b in urls if b} and time.monotonic() - start < 100


def test_rules_of_items_fit_what_written_out_rules_fit(spark, labelled):
    rules, names = urlrules.mine_items(labelled, 0.05, 0.6, 1.2)
    whole = urlrules.mine(labelled, 0.05, 0.6, 1.2)
    urls = labelled.select("url")
    assert {r.url for r in urlrules.matched(urls, rules, names).collect()} == {r.url for r in urlrules.matched(urls, whole).collect()}


def test_tokens_of_the_same_urls_multiply_nothing(spark):
    """24 segments that always come together, in rules with others: their 2 ** 24 combinations are one item."""
    long = "/".join(f"seg{chr(97 + i)}" for i in range(24))
    urls = [(f"http://h{i % 5}.com/{long}/{'win' if i % 2 else 'news'}/", bool(i % 2)) for i in range(200)] + [(f"http://h{i % 5}.com/{'win' if i % 2 else 'news'}/", False) for i in range(200)]
    rules, names = urlrules.mine_items(spark.createDataFrame(urls, "url string, blocked boolean"))
    assert 1 <= rules.count() < 50 and names.groupBy("item").count().agg(F.max("count")).first()[0] >= 24
    hit = {r.url for r in urlrules.matched(spark.createDataFrame(urls, "url string, blocked boolean").select("url"), rules, names).collect()}
    assert hit == {u for u, b in urls if b}
