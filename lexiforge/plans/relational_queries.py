"""Queries of the relational operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexiforge.functions import text as T
from lexiforge.operators import relational as R
from lexiforge.operators.components import connected_components
from lexiforge.operators.search import top_per
from lexiforge.plans.query import query, table


@query("SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def q_latest_order_per_customer(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return R.latest(o, ["o_custkey"], "o_orderdate", "o_orderkey")


@query(
    """SELECT d.doc_id, d.lang, d.source, s.n AS source_docs FROM documents d JOIN (SELECT source, count(*) AS n FROM documents GROUP BY source) s USING (source)
    WHERE d.lang = 'en' AND d.n_chars BETWEEN 300 AND 60000 AND EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)"""
)
def q_curation(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    from lexiforge.sources.feeds import curation_scan

    found = curation_scan(docs, table(spark, d, "labels").where("quality = 1"), "doc_id", "source", F.col("lang") == "en", "n_chars")
    return found.select("doc_id", "lang", "source", "source_docs")


@query("SELECT c.c_custkey, c.c_mktsegment FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)")
def q_semi_orders(spark: SparkSession, d: str) -> DataFrame:
    big = table(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(big, "c_custkey", "left_semi").select("c_custkey", "c_mktsegment")


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 100000")
def q_optional_filter(spark: SparkSession, d: str) -> DataFrame:
    from lexiforge.operators.rules import optional_filters

    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    found = optional_filters(o, o_orderstatus="F", o_orderpriority=None).where("o_totalprice >= 100000")
    return found.select("o_orderkey", "o_orderstatus", "o_totalprice")


@query(
    """SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN d.doc_id IS NULL THEN 'MISSING_LEFT' WHEN l.doc_id IS NULL THEN 'MISSING_RIGHT' ELSE 'DIFFERENT' END AS issue
    FROM (SELECT doc_id, n_chars % 2 AS c FROM documents) d FULL OUTER JOIN (SELECT doc_id, quality AS c FROM labels) l USING (doc_id) WHERE d.doc_id IS NULL OR l.doc_id IS NULL OR d.c IS DISTINCT FROM l.c"""
)
def q_full_outer_check(spark: SparkSession, d: str) -> DataFrame:
    left = table(spark, d, "documents").select("doc_id", (F.col("n_chars") % 2).alias("c"))
    return R.mismatches(left, table(spark, d, "labels").select("doc_id", F.col("quality").cast("bigint").alias("c")), "doc_id", "c")


@query("SELECT d.doc_id, d.source, CASE WHEN l.quality IS NULL THEN 'unknown' WHEN l.quality = 1 THEN 'ok' ELSE 'poor' END AS status FROM documents d LEFT JOIN labels l USING (doc_id)")
def q_left_status(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return rows.select("doc_id", "source", F.when(F.col("quality").isNull(), "unknown").when(F.col("quality") == 1, "ok").otherwise("poor").alias("status"))


@query("SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = '1-URGENT') OR EXISTS (SELECT 1 FROM events e WHERE e.user_id = c.c_custkey AND e.event_type = 'purchase')")
def q_semi_or(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    b = table(spark, d, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey").join(a.unionByName(b), "c_custkey", "left_semi")


@query("SELECT c_custkey, coalesce((SELECT max(ts) FROM events e WHERE e.user_id = c.c_custkey), TIMESTAMP '1970-01-01') AS last_activity FROM customer c")
def q_last_activity(spark: SparkSession, d: str) -> DataFrame:
    last = table(spark, d, "events").groupBy(F.col("user_id").alias("c_custkey")).agg(F.max("ts").alias("ts"))
    kind = last.schema["ts"].dataType
    return table(spark, d, "customer").join(last, "c_custkey", "left").select("c_custkey", F.coalesce("ts", F.lit("1970-01-01 00:00:00").cast(kind)).alias("last_activity"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def q_anti_customers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").join(table(spark, d, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("SELECT n_nationkey, p_partkey, CAST(p_size - n_nationkey AS INTEGER) AS margin FROM nation n, part p WHERE p_size - n_nationkey >= 35 + n_regionkey")
def q_theta_topics(spark: SparkSession, d: str) -> DataFrame:
    from lexiforge.operators.alerts import score_join

    topics = table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    pairs = score_join(topics, table(spark, d, "part").select("p_partkey", "p_size"), F.col("p_size") - F.col("n_nationkey"), 35 + F.col("n_regionkey"), "margin")
    return pairs.select("n_nationkey", "p_partkey", F.col("margin").cast("int").alias("margin"))


@query("SELECT o.o_custkey, l.l_orderkey, l.l_linenumber FROM lineitem l JOIN (SELECT DISTINCT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 450000) o ON o.o_orderkey = l.l_orderkey")
def q_expand_orders(spark: SparkSession, d: str) -> DataFrame:
    keys = table(spark, d, "orders").where("o_totalprice > 450000").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey").distinct()
    return table(spark, d, "lineitem").join(keys, "l_orderkey").select("o_custkey", "l_orderkey", "l_linenumber")


@query(
    """WITH u AS (SELECT l_orderkey, 'p-' || l_partkey AS id, min(l_linenumber) AS f FROM lineitem GROUP BY l_orderkey, l_partkey)
    SELECT l_orderkey, id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY f, id) AS INTEGER) AS position FROM u"""
)
def q_bridge(spark: SparkSession, d: str) -> DataFrame:
    refs = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", F.col("l_linenumber").alias("position"))
    return R.bridge(refs, "l_orderkey", ["l_partkey"], F.concat(F.lit("p-"), F.col("l_partkey").cast("string")))[1].select("l_orderkey", "id", "position")


@query("SELECT s_suppkey, coalesce(n.n_regionkey, -1) AS region FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN -1 ELSE s_nationkey END AS k FROM supplier) s LEFT JOIN nation n ON n.n_nationkey = s.k")
def q_update_from(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 4 == 0, -1).otherwise(F.col("s_nationkey")).alias("n_nationkey"), F.lit(-1).alias("region"))
    return R.update_from(s, table(spark, d, "nation").select("n_nationkey", F.col("n_regionkey").alias("region")), "n_nationkey", "region").select("s_suppkey", "region")


@query(
    """SELECT k, 'missing' AS state FROM (SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 300000) UNION ALL
    SELECT k, 'stale' AS state FROM (SELECT user_id AS k FROM events EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 300000) WHERE k IN (SELECT c_custkey FROM customer)"""
)
def q_reconcile(spark: SparkSession, d: str) -> DataFrame:
    c, o = table(spark, d, "customer").select(F.col("c_custkey").alias("k")), table(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("k"))
    missing = R.reconcile(c, o, "k").where("state = 'missing'")
    return missing.unionByName(R.reconcile(o, table(spark, d, "events").select(F.col("user_id").alias("k")), "k", c).where("state = 'stale'"))


@query(
    """WITH s AS (SELECT o_orderkey AS k, CAST(o_orderkey % 5 AS INTEGER) AS v, 'server' AS side FROM orders WHERE o_orderkey % 3 <> 0), l AS (SELECT o_orderkey AS k, CAST(o_orderkey % 7 AS INTEGER) AS v, 'local' AS side FROM orders WHERE o_orderkey % 2 = 0)
    SELECT coalesce(s.k, l.k) AS k, CASE WHEN s.k IS NULL OR l.v > s.v THEN l.v ELSE s.v END AS v, CASE WHEN s.k IS NULL OR l.v > s.v THEN l.side ELSE s.side END AS side FROM s FULL OUTER JOIN l ON s.k = l.k"""
)
def q_merge_versions(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"))
    server = o.where("k % 3 <> 0").select("k", (F.col("k") % 5).cast("int").alias("v"), F.lit("server").alias("side"))
    local = o.where("k % 2 = 0").select("k", (F.col("k") % 7).cast("int").alias("v"), F.lit("local").alias("side"))
    return R.merge_versions(server, local, "k", "v")


@query("SELECT s_suppkey, CASE WHEN n.n_nationkey IS NULL THEN NULL ELSE s_nationkey END AS s_nationkey, 'kept' AS how FROM supplier s LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) n ON n.n_nationkey = s.s_nationkey UNION ALL SELECT s_suppkey, s_nationkey, 'deleted' FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)")
def q_cascade(spark: SparkSession, d: str) -> DataFrame:
    s, live = table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), table(spark, d, "nation").where("n_regionkey < 3")
    kept = R.cascade(s, live, "s_nationkey", "n_nationkey", delete=False).withColumn("how", F.lit("kept"))
    return kept.unionByName(R.cascade(s, live, "s_nationkey", "n_nationkey", delete=True).withColumn("how", F.lit("deleted")))


@query("SELECT d.doc_id, coalesce(l.quality, 1) AS quality, coalesce(l.toxic, 0) AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def q_left_defaults(spark: SparkSession, d: str) -> DataFrame:
    return R.with_defaults(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id", {"quality": F.lit(1), "toxic": F.lit(0)})


@query("SELECT o_orderpriority, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS BIGINT) AS n_f, CAST(count(*) FILTER (WHERE o_orderstatus = 'O') AS BIGINT) AS n_o, CAST(count(*) FILTER (WHERE o_orderstatus = 'P') AS BIGINT) AS n_p FROM orders GROUP BY o_orderpriority")
def q_status_counts(spark: SparkSession, d: str) -> DataFrame:
    return R.status_counts(table(spark, d, "orders"), ["o_orderpriority"], "o_orderstatus", ["F", "O", "P"])


@query("SELECT CAST(user_id AS BIGINT) AS g, event_type AS s, CAST(count(*) AS BIGINT) AS n FROM events WHERE value > 5 GROUP BY GROUPING SETS ((user_id), (event_type), ())")
def q_unread_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    return R.unread_counts(table(spark, d, "events").where("value > 5"), "user_id", "event_type")


@query("SELECT conv_id, max(turn) AS latest_turn FROM conversations WHERE role = 'user' AND trim(text) <> '' GROUP BY conv_id")
def q_latest_turn(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").where("role = 'user' and trim(text) <> ''").groupBy("conv_id").agg(F.max("turn").alias("latest_turn"))


@query("SELECT n.n_nationkey, coalesce((SELECT string_agg(CAST(s_suppkey AS VARCHAR), ',' ORDER BY s_acctbal DESC, s_suppkey DESC) FROM supplier s WHERE s.s_nationkey = n.n_nationkey), '') AS suppliers FROM nation n")
def q_group_children(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").withColumnRenamed("s_nationkey", "n_nationkey")
    rows = R.children_of(table(spark, d, "nation").select("n_nationkey"), s, "n_nationkey", "s_suppkey", F.struct("s_acctbal", "s_suppkey"))
    return rows.select("n_nationkey", F.array_join(F.transform("children", lambda x: x.cast("string")), ",").alias("suppliers"))


@query("SELECT l_partkey, l_suppkey, n_lines FROM (SELECT l_partkey, l_suppkey, CAST(count(*) AS BIGINT) AS n_lines, row_number() OVER (PARTITION BY l_partkey ORDER BY count(*) DESC, l_suppkey) AS k FROM lineitem GROUP BY l_partkey, l_suppkey) WHERE k = 1")
def q_best_supplier(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n_lines"))
    return R.latest(n.withColumn("tie", -F.col("l_suppkey")), ["l_partkey"], "n_lines", "tie").drop("tie")


@query(
    """WITH RECURSIVE e AS (SELECT DISTINCT p_partkey AS a, p_partkey + 37 AS b FROM part WHERE p_size % 3 = 0 AND p_partkey + 37 IN (SELECT p_partkey FROM part)),
    u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a AS node, a AS reach FROM u UNION SELECT r.node, u.b FROM r JOIN u ON u.a = r.reach)
    SELECT node, min(reach) AS component FROM r GROUP BY node"""
)
def q_components(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    e = p.where("p_size % 3 = 0").select(F.col("p_partkey").alias("a"), (F.col("p_partkey") + 37).alias("b")).join(p.select(F.col("p_partkey").alias("b")), "b", "left_semi")
    return connected_components(e)


@query(
    """SELECT r_regionkey, CAST(count(s_suppkey) AS BIGINT) AS claims, CASE WHEN count(s_suppkey) > 0 THEN 'ANSWERED' ELSE 'MISSING' END AS status
    FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 9000) ON s_nationkey = n_nationkey GROUP BY r_regionkey"""
)
def q_coverage(spark: SparkSession, d: str) -> DataFrame:
    from lexiforge.operators.claims import requirement_coverage

    claims = table(spark, d, "supplier").where("s_acctbal > 9000").join(table(spark, d, "nation").withColumnRenamed("n_nationkey", "s_nationkey"), "s_nationkey").select(F.col("n_regionkey").alias("r_regionkey"), F.col("s_suppkey").alias("claim"))
    return requirement_coverage(table(spark, d, "region").select("r_regionkey"), claims, "r_regionkey", "claim").select("r_regionkey", "claims", "status")


@query("SELECT event_type, CAST(quantile_disc(value, 0.5) AS DOUBLE) AS p50, CAST(quantile_disc(value, 0.95) AS DOUBLE) AS p95 FROM events GROUP BY event_type")
def q_p50_p95(spark: SparkSession, d: str) -> DataFrame:
    from lexiforge.operators.relational import nearest_ranks

    return nearest_ranks(table(spark, d, "events"), ["event_type"], "value", {"p50": 50, "p95": 95})


@query("SELECT conv_id, sha256(string_agg(turn || ':' || role || ':' || sha256(text), chr(10) ORDER BY turn)) AS signature FROM conversations GROUP BY conv_id")
def q_signature(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("place"), "turn", "role", F.sha2("text", 256).alias("hash"))
    return R.signature(c, "conv_id", "place", "turn", "role", "hash")


@query("SELECT conv_id, turn, role FROM (SELECT *, min(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id) AS f FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 3) WHERE turn >= f")
def q_history_window(spark: SparkSession, d: str) -> DataFrame:
    return R.history_window(table(spark, d, "conversations"), "conv_id", "turn", "role", 3).select("conv_id", "turn", "role")


@query("SELECT user_id, event_id, CAST(n AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE event_type = 'click') WHERE n <= 5")
def q_recent_n(spark: SparkSession, d: str) -> DataFrame:
    return top_per(table(spark, d, "events").where("event_type = 'click'"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 5).select("user_id", "event_id", "rank")


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY user_id, event_type")
def q_first_seen(spark: SparkSession, d: str) -> DataFrame:
    return R.first_seen(table(spark, d, "events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], "event_id")


@query(
    """WITH f AS (SELECT l_orderkey, l_suppkey, min(l_linenumber) AS f FROM lineitem GROUP BY l_orderkey, l_suppkey), n AS (SELECT l_orderkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY f, l_suppkey) AS n FROM f)
    SELECT l.l_orderkey, l.l_linenumber, l.l_suppkey, 'S' || n AS label FROM lineitem l JOIN n USING (l_orderkey, l_suppkey)"""
)
def q_renumber(spark: SparkSession, d: str) -> DataFrame:
    return R.renumber(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey"), "l_orderkey", "l_suppkey", "l_linenumber")


@query(
    """WITH p AS (SELECT o_custkey, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS place, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
    a AS (SELECT *, greatest(0, least(coalesce(min(CASE WHEN o_orderstatus = 'P' THEN place END) OVER (PARTITION BY o_custkey) - 2, 0), n - 1)) AS at_ FROM p)
    SELECT o_custkey, o_orderkey, CAST(place AS INTEGER) AS place, at_ > 0 AS has_previous, at_ + 6 < n AS has_next FROM a WHERE place >= at_ AND place < at_ + 6"""
)
def q_page(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")
    return R.page(o, "o_custkey", [F.asc("o_orderdate"), F.asc("o_orderkey")], 6, focus=F.col("o_orderstatus") == "P").select("o_custkey", "o_orderkey", F.col("place").cast("int").alias("place"), "has_previous", "has_next")


@query("SELECT event_id, user_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 200")
def q_newest(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", "user_id", "ts").orderBy(F.desc("ts"), F.desc("event_id")).limit(min(200, max(1, 500)))


@query("SELECT e.event_id, e.user_id, CAST(g.group_place AS INTEGER) AS group_place FROM events e JOIN (SELECT user_id, row_number() OVER (ORDER BY max(ts) DESC, user_id) AS group_place FROM events GROUP BY user_id) g USING (user_id)")
def q_group_order(spark: SparkSession, d: str) -> DataFrame:
    return R.newest_groups(table(spark, d, "events").select("event_id", "user_id", "ts"), "user_id", "ts", "event_id").select("event_id", "user_id", "group_place")


@query(
    """WITH b AS (SELECT user_id, event_type, max(value) AS value FROM events GROUP BY user_id, event_type), t AS (SELECT *, max(value) OVER (PARTITION BY user_id) AS top FROM b),
    r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_type) AS rank FROM t WHERE top >= 20 AND value >= greatest(20, top * 0.88)),
    n AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM r WHERE rank <= 3) SELECT user_id, event_type, value, CAST(rank AS INTEGER) AS rank FROM n WHERE n >= 2"""
)
def q_ties(spark: SparkSession, d: str) -> DataFrame:
    return R.close_ties(table(spark, d, "events"), "user_id", "event_type", "value", least=20.0, ratio=0.88).select("user_id", "event_type", "value", "rank")


@query("SELECT o_custkey AS k, 'orders' AS channel, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY o_custkey UNION ALL SELECT user_id, 'events', CAST(count(*) AS BIGINT) FROM events GROUP BY user_id")
def q_union_channels(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n")).withColumn("channel", F.lit("orders"))
    return a.unionByName(table(spark, d, "events").groupBy(F.col("user_id").alias("k")).agg(F.count("*").alias("n")).withColumn("channel", F.lit("events")))


@query("SELECT c_custkey AS k FROM customer EXCEPT ALL SELECT user_id FROM events")
def q_except(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k")).exceptAll(table(spark, d, "events").select(F.col("user_id").alias("k")))


@query("SELECT 'documents-labels' AS pair, NOT EXISTS (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) AND NOT EXISTS (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents) AS equal UNION ALL SELECT 'orders-lines', NOT EXISTS (SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem) AND NOT EXISTS (SELECT l_orderkey FROM lineitem EXCEPT SELECT o_orderkey FROM orders)")
def q_set_equal(spark: SparkSession, d: str) -> DataFrame:
    def one(name: str, a: DataFrame, b: DataFrame) -> DataFrame:
        both = a.distinct().withColumn("l", F.lit(1)).join(b.distinct().withColumn("r", F.lit(1)), "k", "full_outer")
        return both.agg((F.count_if(F.col("l").isNull() | F.col("r").isNull()) == 0).alias("equal")).select(F.lit(name).alias("pair"), "equal")

    k = lambda t, c: table(spark, d, t).select(F.col(c).alias("k"))
    return one("documents-labels", k("documents", "doc_id"), k("labels", "doc_id")).unionByName(one("orders-lines", k("orders", "o_orderkey"), k("lineitem", "l_orderkey")))


@query(
    """WITH a AS (SELECT user_id, list_sort(list(DISTINCT event_type) FILTER (WHERE value > 8)) AS x, list_sort(list(DISTINCT event_type) FILTER (WHERE value < 3)) AS y FROM events GROUP BY user_id)
    SELECT user_id, array_to_string(list_sort(list_filter(coalesce(x, []), lambda e: list_contains(coalesce(y, []), e))), ',') AS both, array_to_string(list_sort(list_filter(coalesce(x, []), lambda e: NOT list_contains(coalesce(y, []), e))), ',') AS only_x FROM a"""
)
def q_array_sets(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "events").groupBy("user_id").agg(F.collect_set(F.when(F.col("value") > 8, F.col("event_type"))).alias("x"), F.collect_set(F.when(F.col("value") < 3, F.col("event_type"))).alias("y"))
    join = lambda c: F.array_join(F.array_sort(c), ",")
    return a.select("user_id", join(F.array_intersect("x", "y")).alias("both"), join(F.array_except("x", "y")).alias("only_x"))


@query("SELECT DISTINCT user_id, event_type FROM events WHERE value > 10 AND (user_id, event_type) NOT IN (SELECT user_id, event_type FROM events WHERE event_id < 2000)")
def q_insert_if_absent(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return R.insert_if_absent(e.where("event_id < 2000").select("user_id", "event_type"), e.where("value > 10").select("user_id", "event_type"), ["user_id", "event_type"])


@query("SELECT user_id FROM events GROUP BY user_id HAVING max(CASE WHEN event_type = 'search' OR event_type = 'click' THEN ts END) > coalesce(max(CASE WHEN event_type = 'purchase' THEN ts END), TIMESTAMP '1970-01-01')")
def q_needs_refresh(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return R.needs_refresh(e.where("event_type in ('search', 'click')"), e.where("event_type = 'purchase'"), "user_id", "ts")


@query(
    """WITH g AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g) SELECT user_id, CAST(session AS BIGINT) AS session, CAST(count(*) AS BIGINT) AS n, min(ts) AS started, max(ts) AS ended FROM s GROUP BY user_id, session"""
)
def q_sessions(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    new = F.when(F.col("ts") - F.lag("ts").over(w) <= F.expr("interval 12 hours"), 0).otherwise(1)
    rows = table(spark, d, "events").withColumn("new", new).withColumn("session", F.sum("new").over(w))
    return rows.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("ts").alias("started"), F.max("ts").alias("ended"))


@query("SELECT event_id, CASE WHEN nxt IS NULL OR nxt > ts + INTERVAL 300 MINUTE THEN 'GENERATION_INTERRUPTED' ELSE 'COMPLETED' END AS outcome FROM (SELECT event_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events)")
def q_expired(spark: SparkSession, d: str) -> DataFrame:
    """Each event as an attempt that the user's next event completes, if it comes in time."""
    from lexiforge.streaming.stateful import chat_turns

    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, d, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), F.lag("event_id").over(w).alias("before"))
    both = F.array(F.struct(F.lit("complete").alias("kind"), F.col("before").alias("turn"), F.lit("0").alias("id")), F.struct(F.lit("start").alias("kind"), F.col("event_id").alias("turn"), F.lit("1").alias("id")))
    events = rows.select("user_id", "ts", "event_id", F.explode(both).alias("e")).where("e.turn is not null")
    events = events.select("user_id", "ts", F.concat(F.lpad(F.col("event_id").cast("string"), 12, "0"), "e.id").alias("id"), "e.kind", "e.turn", F.when(F.col("e.kind") == "start", F.col("e.turn")).alias("request"), F.lit(None).cast("bigint").alias("version"), F.lit("x").alias("text"))
    done = chat_turns(events, "user_id", expiry_ms=300 * 60_000, now=1 << 62).where("outcome in ('COMPLETED', 'INTERRUPTED')")
    return done.select(F.col("turn").cast("bigint").alias("event_id"), F.when(F.col("outcome") == "COMPLETED", "COMPLETED").otherwise("GENERATION_INTERRUPTED").alias("outcome"))


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def q_latest_state(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", "value", "ts")
    return R.latest(e, ["user_id"], "ts", "event_id").drop("ts")


@query("SELECT user_id, round(greatest(0.6, max(value) + 0.01), 6) AS threshold FROM events WHERE event_type = 'error' GROUP BY user_id")
def q_thresholds(spark: SparkSession, d: str) -> DataFrame:
    from lexiforge.operators.alerts import raised_thresholds

    dismissed = table(spark, d, "events").where("event_type = 'error'").select("user_id", F.col("value").alias("score"))
    return raised_thresholds(dismissed, ["user_id"], F.lit(0.6)).select("user_id", F.round("threshold", 6).alias("threshold"))


@query("SELECT conv_id, min_by(text, turn) AS prompt, CASE WHEN length(s) <= 50 THEN s ELSE rtrim(substr(s, 1, 50), ' ') END AS name FROM (SELECT *, regexp_replace(trim(first_value(text) OVER (PARTITION BY conv_id ORDER BY turn), ' '), '\\s+', ' ', 'g') AS s FROM conversations WHERE role = 'user') GROUP BY conv_id, s")
def q_first_prompt(spark: SparkSession, d: str) -> DataFrame:
    return R.auto_names(table(spark, d, "conversations").where("role = 'user'"), "conv_id", "turn", "text")


@query("SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev_role, sha256(coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '')) AS prev_hash FROM conversations")
def q_prev_turn(spark: SparkSession, d: str) -> DataFrame:
    rows = R.previous(table(spark, d, "conversations"), "conv_id", "turn", "role", "text")
    return rows.select("conv_id", "turn", "role", "prev_role", F.sha2(F.coalesce("prev_text", F.lit("")), 256).alias("prev_hash"))


@query("SELECT conv_id, turn, part, sha256(CASE WHEN part = 'prompt' THEN text ELSE coalesce(answer, '') END) AS body FROM (SELECT conv_id, turn, role, text, lead(CASE WHEN role = 'assistant' THEN text END) OVER (PARTITION BY conv_id ORDER BY turn) AS answer FROM conversations), (VALUES ('prompt'), ('answer')) v(part) WHERE role = 'user'")
def q_turns(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, d, "conversations").withColumn("answer", F.lead(F.when(F.col("role") == "assistant", F.col("text"))).over(w)).where("role = 'user'")
    cites = "array<struct<document_id:string,title:string,url:string,outdated:boolean>>"
    turns = rows.select("conv_id", "turn", F.col("text").alias("prompt"), F.col("answer").alias("text"), F.lit(None).cast("array<string>").alias("flags"), F.lit(None).cast(cites).alias("citations"), F.lit(None).cast("array<struct<title:string,link:string>>").alias("documents"))
    return R.turn_messages(turns, "conv_id", "turn").select("conv_id", "turn", F.when(F.col("part") == 0, "prompt").otherwise("answer").alias("part"), F.sha2("content", 256).alias("body"))


@query(
    """WITH c AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 4 > 0 THEN o_orderstatus END AS subject, 'Order ' || o_orderstatus AS label, o_totalprice AS score FROM orders WHERE o_custkey % 7 > 0),
    b AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, coalesce(subject, o_orderkey::VARCHAR) ORDER BY score DESC, o_orderkey) AS k FROM c),
    t AS (SELECT *, coalesce(subject, o_orderkey::VARCHAR) AS s, max(score) OVER (PARTITION BY o_custkey) AS top FROM b WHERE k = 1),
    r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY score DESC, s) AS rank, count(*) OVER (PARTITION BY o_custkey) AS n FROM t WHERE top >= 100000 AND score >= greatest(100000, top * 0.9)),
    p AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, label ORDER BY rank) AS again FROM r WHERE rank <= 3 AND n >= 2)
    SELECT o_custkey, CAST(rank AS INTEGER) AS rank, o_orderkey AS document_id, CASE WHEN again > 1 THEN left(label, 100) || ' (' || right(o_orderkey::VARCHAR, 6) || ')' ELSE label END AS label FROM p"""
)
def q_choices(spark: SparkSession, d: str) -> DataFrame:
    """What each customer may have meant: orders of about the same price, some without a subject; one in seven asks for all."""
    o = table(spark, d, "orders")
    items = o.select("o_custkey", F.col("o_orderkey").alias("document_id"), F.when(F.col("o_orderkey") % 4 > 0, F.col("o_orderstatus")).alias("subject"), F.concat(F.lit("Order "), "o_orderstatus").alias("label"), F.col("o_totalprice").alias("score"), (F.col("o_custkey") % 7 == 0).alias("multiple_projects"))
    return R.clarification_choices(items, "o_custkey", least=100_000.0, ratio=0.9)


@query(
    """WITH e AS (SELECT user_id, event_id, event_type AS subject, CASE WHEN event_id % 5 = 0 THEN 'other' ELSE event_type END AS label FROM events),
    c AS (SELECT DISTINCT user_id, CASE user_id % 4 WHEN 0 THEN 'click' WHEN 1 THEN 'nothing like it' WHEN 2 THEN 'other' END AS chosen FROM events),
    n AS (SELECT DISTINCT user_id, subject FROM e JOIN c USING (user_id) WHERE label = chosen)
    SELECT user_id, event_id FROM e WHERE (user_id, subject) IN (SELECT user_id, subject FROM n) OR user_id NOT IN (SELECT user_id FROM n)"""
)
def q_kept_subject(spark: SparkSession, d: str) -> DataFrame:
    """Events as evidence of questions that chose a label, none, or one that nothing has."""
    e = table(spark, d, "events").select("user_id", "event_id", F.col("event_type").alias("subject"), F.when(F.col("event_id") % 5 == 0, "other").otherwise(F.col("event_type")).alias("label"))
    chosen = e.select("user_id", F.element_at(F.array(F.lit("click"), F.lit("nothing like it"), F.lit("other"), F.lit(None).cast("string")), (F.col("user_id") % 4 + 1).cast("int")).alias("chosen")).distinct()
    return R.keep_chosen(e, "user_id", chosen).select("user_id", "event_id")


@query(
    """WITH d AS (SELECT l_suppkey % 30 AS run, CASE WHEN l_suppkey % 30 < 10 THEN 'READY' WHEN l_returnflag = 'R' THEN 'ERROR' WHEN l_returnflag = 'A' THEN 'WARNING' ELSE 'READY' END AS status FROM lineitem WHERE l_suppkey % 30 < 25),
    c AS (SELECT run, count(*) AS total, count(*) FILTER (WHERE status = 'READY') AS ready, count(*) FILTER (WHERE status = 'WARNING') AS warning, count(*) FILTER (WHERE status = 'ERROR') AS error FROM d GROUP BY run),
    r AS (SELECT DISTINCT s_suppkey % 30 AS run FROM supplier)
    SELECT run AS run_id, coalesce(total, 0) AS total, coalesce(ready, 0) AS ready, coalesce(warning, 0) AS warning, coalesce(error, 0) AS error,
      CASE WHEN run % 6 = 0 OR run % 10 = 3 THEN 'FAILED' WHEN coalesce(warning, 0) + coalesce(error, 0) > 0 THEN 'PARTIAL_SUCCESS' ELSE 'SUCCESS' END AS run_status, run = max(run) FILTER (WHERE run % 7 > 0) OVER () AS latest FROM r LEFT JOIN c USING (run)"""
)
def q_review(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as runs, their lines as documents; some runs fail as a whole, some have no document."""
    from lexiforge.sources.feeds import latest_run, review_reports

    run, flag = F.col("l_suppkey") % 30, F.col("l_returnflag")
    docs = table(spark, d, "lineitem").where(run < 25).select(run.alias("run_id"), F.col("l_orderkey").alias("document_id"), F.when((run < 10) | (flag == "N"), "READY").when(flag == "R", "ERROR").otherwise("WARNING").alias("status"), F.array().cast("array<struct<severity:string,code:string,stage:int,message:string>>").alias("issues"))
    k = F.col("run_id")
    runs = table(spark, d, "supplier").select((F.col("s_suppkey") % 30).alias("run_id")).distinct().select("run_id", (k % 6 != 0).alias("consistent"), F.when(k % 10 == 3, "broken").alias("global_error"), F.when(k % 7 > 0, F.timestamp_seconds(k)).alias("completed_at"))
    reports, _ = review_reports(docs, runs)
    last = latest_run(reports).select(k.alias("last"))
    return reports.join(F.broadcast(last), k == F.col("last"), "left").select("run_id", "total", "ready", "warning", "error", "run_status", F.col("last").isNotNull().alias("latest"))


@query("SELECT conv_id, sha256(string_agg(text, chr(10) || chr(10) ORDER BY turn)) AS document_hash FROM conversations GROUP BY conv_id")
def q_conversation_hash(spark: SparkSession, d: str) -> DataFrame:
    from lexiforge.operators.corpus import document_hash

    return document_hash(table(spark, d, "conversations"), "conv_id", "turn", "text")


@query("SELECT conv_id, sha256(string_agg(text, ' ' ORDER BY turn)) AS section_hash, CAST(count(*) AS BIGINT) AS fragments FROM conversations GROUP BY conv_id")
def q_reassemble(spark: SparkSession, d: str) -> DataFrame:
    from lexiforge.operators.corpus import reassemble

    return reassemble(table(spark, d, "conversations"), ["conv_id"], "turn", "text").select("conv_id", F.sha2("section", 256).alias("section_hash"), "fragments")
