"""Queries over ordered groups of any size and over intervals: as-of and interval joins, frames, lags, running figures, tiles and ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemill.operators import intervals, ranges
from tablemill.plans.base import Book, Tables

BOOK = Book()
add = BOOK.add


def _by_time() -> list:
    return [F.col("ts").asc(), F.col("event_id").asc()]


def _of_type(t: Tables, kind: str, **names: str) -> DataFrame:
    return t.events.filter(F.col("event_type") == kind).select("user_id", "ts", *(F.col(c).alias(n) for n, c in names.items()))


# -- as-of joins -------------------------------------------------------------------------------
add("join_asof", lambda t: ranges.asof_join(_of_type(t, "purchase", event_id="event_id"), _of_type(t, "view", view_id="event_id", view_value="value"), ["user_id"], "ts", "ts", {"view_id": "view_id", "view_value": "view_value"}, tie="view_id").drop("ts", "user_id"),
    "SELECT p.event_id, v.event_id AS view_id, v.value AS view_value FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts")
add("join_asof_forward", lambda t: ranges.asof_join(_of_type(t, "signup", event_id="event_id"), _of_type(t, "purchase", bought="event_id"), ["user_id"], "ts", "ts", {"bought": "bought", "ts": "at"}, strict=True, tie="bought", forward=True, tolerance=F.col("at") - F.col("ts") <= F.expr("INTERVAL 12 HOURS")).select("event_id", "bought"),
    "SELECT s.event_id, CASE WHEN p.ts - s.ts <= INTERVAL 12 HOURS THEN p.event_id END AS bought FROM (SELECT * FROM events WHERE event_type = 'signup') s ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON s.user_id = p.user_id AND s.ts < p.ts")


def _latest_of_another_type(t: Tables) -> DataFrame:
    """Events of one type follow each other in runs; what came before a run came before all its events."""
    rows = t.events.select("event_id", "user_id", "ts", "event_type")
    before = ranges.shifted(rows.withColumn("last", F.struct("event_id", "event_type")), ["user_id"], _by_time(), "last", 1, "prior")
    starts = before.filter("prior IS NULL OR prior.event_type != event_type").select("user_id", "event_id", F.col("prior.event_id").alias("prior_id"))
    return ranges.asof_join(rows.drop("ts"), starts, ["user_id"], "event_id", "event_id", {"prior_id": "prior_id"}).select("event_id", "prior_id")


add("join_asof_other_type", _latest_of_another_type, "SELECT e.event_id, max(o.event_id) AS prior_id FROM events e LEFT JOIN events o ON e.user_id = o.user_id AND o.event_id < e.event_id AND o.event_type <> e.event_type GROUP BY e.event_id")


# -- intervals -----------------------------------------------------------------------------------
def _in_transit(t: Tables) -> DataFrame:
    shipped = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_orderkey", F.col("o_orderdate").alias("since"), F.col("l_shipdate").alias("upto"))
    found = intervals.point_join(t.orders.select("o_custkey", "o_orderkey", "o_orderdate"), shipped, ["o_custkey"], "o_orderdate", "since", "upto", {"l_orderkey": "shipping"}, how="left")
    return found.groupBy("o_orderkey").agg(F.count("shipping").alias("lines"), F.max("shipping").alias("last_order"))


TRANSIT = "(SELECT o_custkey, l_orderkey, o_orderdate AS since, l_shipdate AS upto FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
add("join_interval", _in_transit, f"SELECT o.o_orderkey, count(s.l_orderkey) AS lines, max(s.l_orderkey) AS last_order FROM orders o LEFT JOIN {TRANSIT} s ON s.o_custkey = o.o_custkey AND o.o_orderdate BETWEEN s.since AND s.upto GROUP BY o.o_orderkey")


def _open_together(t: Tables) -> DataFrame:
    spans = t.orders.join(t.lineitem.groupBy("l_orderkey").agg(F.max("l_shipdate").alias("upto")), F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", "o_orderkey", F.col("o_orderdate").alias("since"), "upto")
    pairs = intervals.overlap_join(spans, spans, ["o_custkey"], ("since", "upto"), ("since", "upto"), {"o_orderkey": "other"}, closed=False)
    return pairs.filter("other != o_orderkey").groupBy("o_orderkey").agg(F.count("*").alias("together"), F.min("other").alias("first_other"))


SPANS = "(SELECT o_custkey, o_orderkey, o_orderdate AS since, (SELECT max(l_shipdate) FROM lineitem WHERE l_orderkey = o_orderkey) AS upto FROM orders)"
add("join_overlap", _open_together, f"SELECT a.o_orderkey, count(*) AS together, min(b.o_orderkey) AS first_other FROM {SPANS} a JOIN {SPANS} b ON a.o_custkey = b.o_custkey AND a.o_orderkey <> b.o_orderkey AND a.since < b.upto AND b.since < a.upto AND a.since < a.upto AND b.since < b.upto GROUP BY a.o_orderkey")


def _bands(t: Tables) -> DataFrame:
    """Customers between a supplier's balance and the next higher one; bands don't overlap, so each customer is in one at most."""
    own = t.supplier.select("s_suppkey", "s_acctbal")
    bands = ranges.shifted(own, [], [F.col("s_acctbal").asc(), F.col("s_suppkey").asc()], "s_acctbal", -1, "upto")
    return intervals.point_join(t.customer.select("c_custkey", "c_acctbal"), bands, [], "c_acctbal", "s_acctbal", "upto", {"s_suppkey": "s_suppkey"}, closed=False, how="left").select("c_custkey", "s_suppkey")


add("join_range_bands", _bands, "SELECT c_custkey, s_suppkey FROM customer LEFT JOIN (SELECT s_suppkey, s_acctbal, lead(s_acctbal) OVER (ORDER BY s_acctbal, s_suppkey) AS upto FROM supplier) ON s_acctbal <= c_acctbal AND c_acctbal < upto")

# -- frames --------------------------------------------------------------------------------------
CENTS = "(SELECT *, CAST(round(value * 100) AS BIGINT) AS cents FROM events)"  # whole numbers, so that sums don't depend on their order


def _cents():
    return F.round(F.col("value") * 100).cast("long").alias("cents")


EVENTS = "OVER (PARTITION BY user_id ORDER BY ts, event_id"
add("frame_moving", lambda t: ranges.framed(t.events.select("event_id", "user_id", "ts", _cents()), ["user_id"], _by_time(), {"total": ("sum", "cents"), "most": ("max", "cents"), "n": ("count", "cents")}, 5).select("event_id", "total", "most", "n"),
    f"SELECT event_id, CAST(sum(cents) {EVENTS} ROWS 5 PRECEDING) AS BIGINT) AS total, max(cents) {EVENTS} ROWS 5 PRECEDING) AS most, count(cents) {EVENTS} ROWS 5 PRECEDING) AS n FROM {CENTS}")
add("frame_centred", lambda t: ranges.framed(t.events.select("event_id", "event_type", _cents()), ["event_type"], [F.col("event_id").asc()], {"mean": ("avg", "cents"), "least": ("min", "cents")}, 3, 3).select("event_id", "mean", "least"),
    f"SELECT event_id, avg(cents) OVER w AS mean, min(cents) OVER w AS least FROM {CENTS} WINDOW w AS (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)")
add("frame_lag", lambda t: ranges.shifted(t.events.select("event_id", "user_id", "ts", "event_type"), ["user_id"], _by_time(), "event_type", 2, "before", "none").select("event_id", "before"), f"SELECT event_id, lag(event_type, 2, 'none') {EVENTS}) AS before FROM events")
add("frame_lead", lambda t: ranges.shifted(t.events.select("event_id", "user_id", "ts", "value"), ["user_id"], _by_time(), "value", -1, "next").select("event_id", "next"), f"SELECT event_id, lead(value) {EVENTS}) AS next FROM events")
add("frame_running", lambda t: ranges.running(t.events.select("event_id", "event_type", _cents()), ["event_type"], [F.col("event_id").asc()], {"total": ("sum", "cents"), "n": ("count", "cents"), "least": ("min", "cents"), "most": ("max", "cents"), "mean": ("avg", "cents")}).select("event_id", "total", "n", "least", "most", "mean"),
    f"SELECT event_id, CAST(sum(cents) OVER w AS BIGINT) AS total, count(cents) OVER w AS n, min(cents) OVER w AS least, max(cents) OVER w AS most, (sum(cents) OVER w)::DOUBLE / count(cents) OVER w AS mean FROM {CENTS} WINDOW w AS (PARTITION BY event_type ORDER BY event_id)")
add("frame_ntile", lambda t: ranges.ntile(t.orders.select("o_orderkey", "o_totalprice"), [], [F.col("o_totalprice").asc(), F.col("o_orderkey").asc()], 10).select("o_orderkey", "tile"), "SELECT o_orderkey, CAST(ntile(10) OVER (ORDER BY o_totalprice, o_orderkey) AS INTEGER) AS tile FROM orders")
LINES = ("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
for _fn in ("rank", "dense_rank", "percent_rank", "cume_dist"):
    _whole = _fn in ("rank", "dense_rank")
    add(f"frame_{_fn}", lambda t, fn=_fn, whole=_whole: ranges.rank(t.lineitem.select(*LINES), ["l_returnflag"], [F.col("l_quantity").desc()], fn, [F.col("l_quantity")]).withColumn("rank", F.col("rank") if whole else F.round("rank", 9)),
        f"SELECT {', '.join(LINES)}, {'' if _whole else 'round('}{_fn}() OVER (PARTITION BY l_returnflag ORDER BY l_quantity DESC){'' if _whole else ', 9)'} AS rank FROM lineitem")
