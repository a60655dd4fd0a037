"""Queries of job queues, logs, limits and sessions, over orders, lineitem, events and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from quire.operators import jobs, relational
from quire.plans.registry import query
from quire.session import table
from quire.streaming import states
from quire.sources import tables

STAMP = "yyyy-MM-dd HH:mm:ss"


@query("""SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.latest(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderstatus")


STATUS_SQL = """WITH j AS (SELECT o_custkey, CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'F' THEN 'done' ELSE 'rolled_back' END AS status, CASE WHEN o_orderkey % 17 = 0 THEN 'accept' ELSE 'retake' END AS kind FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1),
s AS (SELECT c_custkey, CASE WHEN kind = 'accept' THEN 'accepted' WHEN status = 'running' THEN 'in_progress' WHEN status = 'done' THEN CASE WHEN c_acctbal < 0 THEN 'still_flagged' ELSE 'done' END ELSE 'flagged' END AS status
FROM customer LEFT JOIN j ON c_custkey = o_custkey WHERE c_acctbal < 0 OR j.status IS NOT NULL)"""


def statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    job = relational.latest(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"])
    state = F.when(F.col("o_orderstatus") == "O", "running").when(F.col("o_orderstatus") == "F", "done").otherwise("rolled_back")
    job = job.select(F.col("o_custkey").alias("c_custkey"), state.alias("state"), F.when(F.col("o_orderkey") % 17 == 0, "accept").otherwise("retake").alias("kind"))
    flagged = F.col("c_acctbal") < 0
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal").join(job, "c_custkey", "left").filter(flagged | F.col("state").isNotNull())
    return rows.select("c_custkey", jobs.queue_status(flagged, F.col("kind"), F.col("state")).alias("status"))


@query(STATUS_SQL + " SELECT c_custkey, status FROM s")
def queue_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statuses(spark, sf_dir)


@query(STATUS_SQL + " SELECT b.status, count(s.c_custkey) AS n FROM (SELECT unnest(['flagged', 'in_progress', 'done', 'still_flagged', 'accepted', 'lost']) AS status) b LEFT JOIN s USING (status) GROUP BY 1")
def queue_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.counters(statuses(spark, sf_dir), "status", ["flagged", "in_progress", "done", "still_flagged", "accepted", "lost"])


@query("SELECT o_orderkey, o_custkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R')")
def not_exists_txn(spark: SparkSession, sf_dir: str) -> DataFrame:
    other = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").join(other, "o_orderkey", "left_anti").select("o_orderkey", "o_custkey")


@query("""SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O') AS n_open FROM customer""")
def scalar_count_subquery(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "O").alias("n_open"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(n, "c_custkey", "left").na.fill(0, ["n", "n_open"])


@query("SELECT o_custkey, count(*) AS n_open FROM orders WHERE o_orderstatus IN ('O', 'P') GROUP BY 1 HAVING count(*) >= 12")
def open_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").filter(F.col("o_orderstatus").isin("O", "P")).groupBy("o_custkey").agg(F.count("*").alias("n_open")).filter("n_open >= 12")


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'done' WHEN o_orderstatus = 'F' THEN 'done' ELSE 'uploaded' END AS status, CASE WHEN o_orderstatus <> 'O' THEN 'cannot finish from ' || CASE o_orderstatus WHEN 'F' THEN 'done' ELSE 'uploaded' END END AS error FROM orders""")
def state_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("o_orderstatus") == "O", "running").when(F.col("o_orderstatus") == "F", "done").otherwise("uploaded")
    return jobs.moved(table(spark, sf_dir, "orders").select("o_orderkey", state.alias("status")), F.lit("finish")).select("o_orderkey", "status", "error")


UNIT_SQL = """WITH j AS (SELECT o_orderkey::VARCHAR AS id, (o_custkey % 7)::VARCHAR AS book, CASE WHEN o_orderkey % 11 = 0 THEN 'rollback' ELSE 'retake' END AS kind, CASE WHEN o_orderkey % 5 = 0 THEN (o_custkey % 100)::VARCHAR END AS txn, CASE WHEN o_orderkey % 2 = 0 THEN (o_custkey % 50)::VARCHAR END AS batch, o_totalprice / 1000000 AS estimate, o_orderdate FROM orders)
SELECT unit, book, count(*) AS jobs, round(sum(estimate), 4) AS estimate, strftime(min(o_orderdate), '%Y-%m-%d %H:%M:%S') AS created FROM (SELECT *, CASE WHEN kind = 'rollback' THEN 'rb:' || id WHEN txn IS NOT NULL THEN 'txn:' || txn WHEN batch IS NOT NULL THEN 'b:' || book || ':' || batch ELSE 'j:' || id END AS unit FROM j) GROUP BY unit, book"""


@query(UNIT_SQL)
def job_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, s = table(spark, sf_dir, "orders"), "string"
    rows = o.select(F.col("o_orderkey").cast(s).alias("id"), (F.col("o_custkey") % 7).cast(s).alias("book"), F.when(F.col("o_orderkey") % 11 == 0, "rollback").otherwise("retake").alias("kind"), F.when(F.col("o_orderkey") % 5 == 0, (F.col("o_custkey") % 100).cast(s)).alias("txn"), F.when(F.col("o_orderkey") % 2 == 0, (F.col("o_custkey") % 50).cast(s)).alias("batch"), (F.col("o_totalprice") / 1_000_000).alias("estimate"), F.col("o_orderdate").alias("created"), F.col("o_orderkey").alias("page"))
    return jobs.units(rows).select("unit", "book", "jobs", "estimate", F.date_format("created", STAMP).alias("created"))


@query("SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM orders) WHERE before IS DISTINCT FROM o_orderstatus")
def change_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.lag("o_orderstatus").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    rows = table(spark, sf_dir, "orders").withColumn("before", before).filter(~F.col("before").eqNullSafe(F.col("o_orderstatus")))
    return rows.select("o_custkey", "o_orderkey", "o_orderstatus")


LIMIT_SQL = """WITH e AS (SELECT event_id, user_id, ts, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS attempts,
lag(ts, 2) OVER (PARTITION BY user_id ORDER BY ts) AS old FROM events WHERE event_type = 'error')
SELECT event_id, attempts, greatest(0, epoch_us(old) + 86400000000 - epoch_us(ts))::BIGINT AS wait_us FROM e WHERE attempts >= 3"""


@query(LIMIT_SQL)
def login_limiter(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = table(spark, sf_dir, "events").filter("event_type = 'error'")
    return relational.attempts_window(failed, "user_id", 86_400, 3).filter("attempts >= 3").select("event_id", "attempts", "wait_us")


@query("""WITH g AS (SELECT user_id, event_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 1 DAY THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, session::BIGINT AS session, count(*) AS n, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started FROM s GROUP BY user_id, session""")
def session_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = relational.sessions(table(spark, sf_dir, "events"), "user_id", "ts", 86_400)
    return rows.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.date_format(F.min("ts"), STAMP).alias("started"))


SPENT_SQL = "spent AS (SELECT ts::DATE AS day, round(sum(coalesce(value, 0)), 4) AS spent FROM events WHERE event_type = 'purchase' GROUP BY 1)"


def day_spent(rows: DataFrame) -> DataFrame:
    """What was really spent on each day, over all books."""
    return rows.filter("event_type = 'purchase'").groupBy("day").agg(F.round(F.sum(F.coalesce("value", F.lit(0.0))), 4).alias("spent"))


def dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))


@query(f"WITH {SPENT_SQL} SELECT strftime(day, '%Y-%m-%d') AS day, spent FROM spent")
def spent_today(spark: SparkSession, sf_dir: str) -> DataFrame:
    return day_spent(dated(spark, sf_dir))


@query(f"""WITH {SPENT_SQL}, g AS (SELECT event_id, ts, ts::DATE AS day, coalesce(value, 0) AS estimate, event_id % 7 = 0 AS back, event_id % 3 <> 0 AS fresh FROM events WHERE event_type = 'click'),
m AS (SELECT g.*, coalesce(spent, 0) AS spent, NOT back AND fresh AND coalesce(spent, 0) + estimate > 2000 AS waits FROM g LEFT JOIN spent USING (day))
SELECT event_id, spent, waits, NOT waits AND row_number() OVER (PARTITION BY day, waits ORDER BY ts, event_id) = 1 AS claimed FROM m""")
def daily_budget_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks as confirmed work, purchases as money spent: which must wait for the next day, and which starts next."""
    rows = dated(spark, sf_dir)
    kind = F.when(F.col("event_id") % 7 == 0, "rollback").otherwise("retake")
    groups = rows.filter("event_type = 'click'").select("event_id", "ts", "day", F.col("value").alias("estimate"), kind.alias("kind"), (F.col("event_id") % 3 != 0).alias("fresh"))
    return relational.admission(groups, day_spent(rows), 2000.0, ["day"], ["ts", "event_id"]).select("event_id", "spent", "waits", "claimed")


@query("""WITH RECURSIVE o AS (SELECT event_id, user_id, epoch_us(ts) / 1e6 AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
w AS (SELECT event_id, user_id, r, s AS last, true AS touched FROM o WHERE r = 1 UNION ALL SELECT o.event_id, o.user_id, o.r, CASE WHEN o.s - w.last > 86400 THEN o.s ELSE w.last END, o.s - w.last > 86400 FROM w JOIN o ON o.user_id = w.user_id AND o.r = w.r + 1)
SELECT event_id, touched FROM w""")
def session_touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uses of a session that renew it: no more than one a day here."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("s"))
    return relational.touches(rows, ["user_id"], "s", 86_400).select("event_id", "touched")


@query(STATUS_SQL + """ SELECT c_custkey, c_nationkey AS book, s.status, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey DESC) AS place FROM customer JOIN s USING (c_custkey)
WHERE s.status IN ('flagged', 'still_flagged', 'in_progress') AND list_contains(string_split(c_mktsegment, 'I'), 'BU') AND c_nationkey IN (3, 5, 7)""")
def queue_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the queue shows for some books, one issue and open work, last pages first."""
    rows = statuses(spark, sf_dir).join(table(spark, sf_dir, "customer"), "c_custkey").select("c_custkey", F.col("c_nationkey").alias("book"), "status", F.split("c_mktsegment", "I").alias("issues"))
    return jobs.shown(rows, [3, 5, 7], "BU", "open", "c_custkey", descending=True).select("c_custkey", "book", "status", "place")


@query("SELECT round(median(value), 3) AS median, count(*) AS n FROM (SELECT value FROM events WHERE event_type = 'purchase' AND value IS NOT NULL ORDER BY ts DESC LIMIT 300)")
def median_last_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.median_of_last(table(spark, sf_dir, "events").filter("event_type = 'purchase'"), "value", [F.desc("ts")])


@query("SELECT user_id, event_type, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS done_at FROM events GROUP BY 1, 2")
def tick_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks = tables.first_ticks(table(spark, sf_dir, "events"), ["user_id", "event_type"], "ts")
    return ticks.select("user_id", "event_type", F.date_format("ts", STAMP).alias("done_at"))


@query("SELECT event_id, user_id, json_extract_string(props, '$.k')::INT AS k FROM events WHERE json_extract_string(props, '$.k')::INT > 50")
def json_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("int")
    return table(spark, sf_dir, "events").select("event_id", "user_id", k.alias("k")).filter("k > 50")


@query("SELECT event_id, event_type FROM events WHERE event_id > 100 ORDER BY event_id LIMIT 500")
def event_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").filter("event_id > 100").orderBy("event_id").limit(500).select("event_id", "event_type")


@query("""SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 8""")
def last_log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.top_n(table(spark, sf_dir, "events"), ["user_id"], [F.desc("event_id")], 8).select("user_id", "event_id")


PRICES = [("cl", 1.0, 5.0), ("click", 3.0, 15.0), ("view", 0.5, 2.5), ("purch", 15.0, 75.0)]


@query("""WITH p(prefix, a, b) AS (VALUES ('cl', 1.0, 5.0), ('click', 3.0, 15.0), ('view', 0.5, 2.5), ('purch', 15.0, 75.0)),
m AS (SELECT event_type, prefix, a, b FROM (SELECT DISTINCT event_type FROM events) JOIN p ON starts_with(event_type, prefix) QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY length(prefix) DESC) = 1)
SELECT event_type, prefix, round(sum((value * 1000 * a::DOUBLE + value * 10 * a * 0.1 + value * a * 1.25 + value * 100 * b) / 1e6), 4) AS usd FROM events JOIN m USING (event_type) GROUP BY 1, 2""")
def cost_longest_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.functions.numbers import cost_usd

    rows = table(spark, sf_dir, "events")
    priced = relational.longest_prefix(rows.select("event_type").distinct(), spark.createDataFrame(PRICES, "prefix string, a double, b double"), "event_type").filter("prefix is not null")
    v = F.col("value")
    usd = cost_usd(v * 1000, v * 100, v * 10, v, F.col("a"), F.col("b"))
    return rows.join(F.broadcast(priced), "event_type").groupBy("event_type", "prefix").agg(F.round(F.sum(usd), 4).alias("usd"))


@query("""WITH u AS (SELECT s_suppkey AS id, s_nationkey AS team, s_acctbal > 6000 AS admin, s_suppkey % 5 = 0 AS disabled, s_suppkey % 3 AS actor FROM supplier)
SELECT id, team, (admin AND NOT disabled AND count(*) FILTER (admin AND NOT disabled) OVER (PARTITION BY team) <= 1) OR id = actor AS guarded FROM u""")
def guarded_admins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as users of teams by nation, each changed by one of three actors."""
    key = F.col("s_suppkey")
    users = table(spark, sf_dir, "supplier").select(key.alias("id"), F.col("s_nationkey").alias("team"), F.when(F.col("s_acctbal") > 6000, "admin").otherwise("editor").alias("role"), (key % 5 == 0).alias("disabled"), (key % 3).alias("actor"))
    return jobs.guarded_admins(users).select("id", "team", "guarded")


LOG_SQL = """WITH log AS (SELECT event_id AS seq, user_id AS page, 'v' || (event_id % 40) AS version, event_type, ts FROM events),
r AS (SELECT * FROM log WHERE event_type = 'purchase'), b AS (SELECT DISTINCT page, version FROM log WHERE event_type = 'error')"""


def image_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    version = F.concat(F.lit("v"), F.col("event_id") % 40)
    action = F.when(F.col("event_type") == "purchase", "retake").when(F.col("event_type") == "error", "rollback")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("page"), version.alias("version"), version.alias("restored"), action.alias("action"), F.col("ts").cast("timestamp").alias("at")).filter("action is not null")


@query(LOG_SQL + " SELECT count(DISTINCT page) AS pages FROM r WHERE ts > TIMESTAMP '2024-01-20 00:00:00' AND NOT EXISTS (SELECT 1 FROM b WHERE b.page = r.page AND b.version = r.version)")
def replaced_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.replaced_pages(image_log(spark, sf_dir), "2024-01-20 00:00:00")


@query(LOG_SQL + " SELECT page, version, seq FROM r WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.page = r.page AND b.version = r.version) QUALIFY row_number() OVER (PARTITION BY page ORDER BY seq DESC) = 1")
def rollback_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.rollback_targets(image_log(spark, sf_dir)).select("page", "version", "seq")


TICK_SQL = """WITH j AS (SELECT o_orderkey AS id, o_orderdate AS created, o_custkey AS book, o_orderkey % 11 = 0 AS rollback, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey // 6 END AS txn,
CASE WHEN o_orderkey % 5 = 0 THEN 'abandoned' END AS stage, o_totalprice AS estimate,
CASE o_orderstatus WHEN 'P' THEN CASE WHEN o_orderkey // 6 % 2 = 0 THEN 'discarded' ELSE 'done' END WHEN 'F' THEN CASE WHEN o_orderkey % 5 = 0 THEN 'uploaded' ELSE 'confirmed' END ELSE CASE WHEN o_orderkey % 29 < 12 THEN 'running' ELSE 'declined' END END AS status FROM orders),
s AS (SELECT book, id, created, CASE
WHEN status = 'running' AND txn IS NOT NULL AND book NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 1000) THEN 1
WHEN status = 'discarded' AND txn IS NOT NULL AND stage IS DISTINCT FROM 'abandoned' AND NOT EXISTS (SELECT 1 FROM j o WHERE o.txn = j.txn AND o.status <> 'discarded') THEN 2
WHEN status = 'uploaded' AND NOT rollback THEN 3
WHEN status = 'confirmed' AND id = (SELECT arg_min(c.id, (c.created, c.id)) FROM j c WHERE c.book = j.book AND c.status = 'confirmed' AND (c.rollback OR c.txn IS NOT NULL OR c.estimate <= 150000)) THEN 4 END AS n FROM j)
SELECT book, id, ['requeue', 'abandon', 'validate', 'run'][n] AS step FROM s WHERE n IS NOT NULL QUALIFY n = min(n) OVER (PARTITION BY book) AND (n <> 3 OR row_number() OVER (PARTITION BY book, n ORDER BY created, id) = 1)"""


@query(TICK_SQL)
def next_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the worker of each book takes up next; orders as jobs of customers, poor ones locked."""
    key, state = F.col("o_orderkey"), F.col("o_orderstatus")
    status = F.when(state == "P", F.when(F.floor(key / 6) % 2 == 0, "discarded").otherwise("done")).when(state == "F", F.when(key % 5 == 0, "uploaded").otherwise("confirmed")).otherwise(F.when(key % 29 < 12, "running").otherwise("declined"))
    all_ = table(spark, sf_dir, "orders").select(key.alias("id"), F.col("o_orderdate").alias("created"), F.col("o_custkey").alias("book"), F.when(key % 11 == 0, "rollback").otherwise("retake").alias("kind"), F.when(key % 3 == 0, F.floor(key / 6)).alias("txn"), F.when(key % 5 == 0, "abandoned").alias("stage"), F.col("o_totalprice").alias("estimate"), status.alias("status"))
    waiting = all_.filter("status = 'confirmed'").withColumn("fresh", F.col("txn").isNull())
    spent = waiting.select("book", F.lit(0.0).alias("spent")).limit(0)
    claimed = relational.admission(waiting, spent, 150_000.0, ["book"], ["created", "id"]).filter("claimed")
    locked = table(spark, sf_dir, "customer").filter("c_acctbal < 1000").select(F.col("c_custkey").alias("book"))
    return jobs.next_work(all_, locked, claimed, ["book"])


@query("""WITH e AS (SELECT user_id // 2 AS answer, event_id AS seq, CASE WHEN event_id = max(event_id) OVER (PARTITION BY user_id // 2) THEN CASE WHEN user_id % 2 = 0 THEN 'fail' ELSE 'done' END WHEN event_type IN ('view', 'purchase') THEN 'text' WHEN event_type = 'signup' THEN 'stop' ELSE 'cite' END AS kind FROM events),
b AS (SELECT *, count(*) FILTER (kind = 'stop') OVER (PARTITION BY answer ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS block, count(*) FILTER (kind = 'stop') OVER (PARTITION BY answer) AS blocks, bool_or(kind = 'fail') OVER (PARTITION BY answer) AS failed, count(*) FILTER (kind = 'text') OVER (PARTITION BY answer) AS texts FROM e)
SELECT answer, row_number() OVER (PARTITION BY answer ORDER BY kind IN ('done', 'fail'), block, kind = 'cite', seq) AS place, seq, kind FROM b WHERE kind <> 'stop' AND NOT (kind = 'cite' AND failed AND block >= blocks) AND NOT (kind = 'fail' AND texts = 0)""")
def answer_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as pieces of answers, two users' to an answer, citations behind the text that they support."""
    answer = F.floor(F.col("user_id") / 2)
    last = F.col("event_id") == F.max("event_id").over(Window.partitionBy(answer))
    kind = F.when(last, F.when(F.col("user_id") % 2 == 0, "fail").otherwise("done")).when(F.col("event_type").isin("view", "purchase"), "text").when(F.col("event_type") == "signup", "stop").otherwise("cite")
    return jobs.answer_events(table(spark, sf_dir, "events").select(answer.alias("answer"), F.col("event_id").alias("seq"), kind.alias("kind")))


# Extensions: the usual windows of event time, which page services do not need but logs of this kind have.
@query("SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS started, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.date_format("w.start", STAMP).alias("started"), "event_type", "n", "total")


@query("""SELECT c.c_custkey, count(*) AS live FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_acctbal >= 0 AND o.o_orderdate >= (SELECT max(o_orderdate) - INTERVAL 30 DAY FROM orders) GROUP BY 1""")
def live_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that have not expired, of users that are not disabled."""
    sessions = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate")
    now = sessions.agg((F.max("o_orderdate") - F.expr("INTERVAL 30 DAYS")).alias("since"))
    users = table(spark, sf_dir, "customer").filter("c_acctbal >= 0").select("c_custkey")
    live = sessions.join(F.broadcast(now), F.col("o_orderdate") >= F.col("since"))
    return live.join(users, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_custkey").agg(F.count("*").alias("live"))


@query("""WITH g AS (SELECT coalesce(CASE WHEN o_orderkey % 3 = 0 THEN 'b' || (o_custkey % 40) END, o_orderkey::VARCHAR) AS grp, o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O')
SELECT grp, count(*) AS jobs, array_to_string(list_slice(list_sort(list(o_orderkey)), 1, 6), ',') AS shown, round(sum(o_totalprice), 2) AS total FROM g GROUP BY grp""")
def approval_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Submitted jobs by batch or alone: the first six pages shown, and the sum of estimates."""
    jobs_ = table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'")
    batch = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("b"), F.col("o_custkey") % 40))
    rows = jobs_.select(F.coalesce(batch, F.col("o_orderkey").cast("string")).alias("grp"), "o_orderkey", "o_totalprice")
    six = relational.top_n(rows, ["grp"], [F.asc("o_orderkey")], 6).groupBy("grp").agg(F.array_join(F.array_sort(F.collect_list("o_orderkey")), ",").alias("shown"))
    return rows.groupBy("grp").agg(F.count("*").alias("jobs"), F.round(F.sum("o_totalprice"), 2).alias("total")).join(six, "grp").select("grp", "jobs", "shown", "total")


WAITS_SQL = """WITH e AS (SELECT event_id AS id, (epoch_us(ts) // 500) / 1e6 AS t, user_id, event_type = 'purchase' AS ok FROM events),
k AS (SELECT id, t, ok, 'u:' || user_id AS key, 5 AS most, true AS clears FROM e UNION ALL SELECT id, t, ok, 'a:' || (user_id % 10), 20, false FROM e),
r AS (SELECT *, coalesce(sum((ok AND clears)::INT) OVER (PARTITION BY key ORDER BY t, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS era FROM k),
n AS (SELECT *, CASE WHEN NOT ok THEN CASE WHEN most = 5 THEN lag(t, 4) OVER f ELSE lag(t, 19) OVER f END END AS nth FROM r WINDOW f AS (PARTITION BY key, era, ok ORDER BY t, id)),
w AS (SELECT id, key, last_value(nth IGNORE NULLS) OVER (PARTITION BY key, era ORDER BY t, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 900 - t AS rest FROM n)
SELECT id, key, CASE WHEN rest > 0 THEN ceil(rest)::BIGINT ELSE 0 END AS wait FROM w"""


@query(WAITS_SQL)
def login_waits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long each attempt must wait, by user and by address; events as attempts (purchases succeed), 500 times as fast."""
    quick = F.timestamp_micros(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 500))
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), quick.alias("ts"), F.col("user_id").cast("string").alias("user"), (F.col("user_id") % 10).alias("address"), (F.col("event_type") == "purchase").alias("ok"))
    return states.login_waits(rows)


@query(LOG_SQL + """, n AS (SELECT user_id % 10 AS book, count(DISTINCT user_id) AS pages FROM events GROUP BY 1),
c AS (SELECT page % 10 AS book, count(DISTINCT page) AS replaced FROM r WHERE ts > TIMESTAMP '2024-01-20 00:00:00' AND NOT EXISTS (SELECT 1 FROM b WHERE b.page = r.page AND b.version = r.version) GROUP BY 1)
SELECT book, coalesce(replaced, 0) AS replaced, pages, coalesce(replaced, 0) > pages * 0.2 AS suggested FROM n LEFT JOIN c USING (book)""")
def rebuild_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books of which more than a fifth was replaced since their last build; users as pages of ten books."""
    log = image_log(spark, sf_dir).withColumn("book", F.col("page") % 10)
    pages = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 10).alias("book")).agg(F.countDistinct("user_id").alias("pages"))
    return jobs.rebuild_suggestions(log, pages.withColumn("built", F.lit("2024-01-20 00:00:00").cast("timestamp")))
