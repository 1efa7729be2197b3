"""Queries over event ledgers: spend, admission, rate limits, repeats, breakers and event windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import guards, relate
from ..sources.tables import table

PRICES = {"default": (1.0, 2.0), "view": (15.0, 75.0), "click": (3.0, 15.0)}
LIMITS = {"view": (10, 3), "error": (5, 2)}
HOURLY, DAILY = 0.02, 0.3


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as calls: the user spends, the type is the model, the value gives the tokens."""
    events = table(spark, sf_dir, "events")
    tokens = F.floor(F.abs("value") * 10)
    return events.withColumn("cost", F.round(guards.cost(F.col("event_type"), tokens, tokens, PRICES), 9))


def q_rolling_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    spend = guards.rolling_spend(ledger(spark, sf_dir), "user_id", "ts", "cost")
    return spend.select("event_id", F.round("cost", 6).alias("cost"), F.round("hourly", 6).alias("hourly"), F.round("daily", 6).alias("daily"))


def q_budget_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rounded = guards.rolling_spend(ledger(spark, sf_dir), "user_id", "ts", "cost")
    rounded = rounded.withColumn("hourly", F.round("hourly", 9)).withColumn("daily", F.round("daily", 9))
    found = guards.budget_status(rounded, HOURLY, DAILY)
    return found.select("event_id", "hourly_percent", "daily_percent", "hourly_left", "daily_left", "warnings")


def q_repeated_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompt = F.concat(F.lit("  run "), F.col("event_type"), F.lit("\n for  user "), F.pmod("user_id", F.lit(3)).cast("string"))
    prompts = table(spark, sf_dir, "events").withColumn("digest", guards.prompt_hash(prompt))
    return guards.repeated_prompts(prompts, "digest", "ts", 2, 1800).select("event_id", "digest", "earlier", "blocked")


def q_token_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = table(spark, sf_dir, "events").withColumn("subsystem", F.concat_ws(":", "event_type", F.pmod("user_id", F.lit(5))))
    limit = lambda k: F.coalesce(*[F.when(F.col("event_type") == t, v[k] / 100) for t, v in LIMITS.items()], F.lit((10, 3)[k] / 100))
    return guards.token_bucket(calls, "subsystem", "ts", "event_id", limit(0), F.lit(1.0))


def q_budget_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guards.budget_admission(ledger(spark, sf_dir), "user_id", "ts", "event_id", "cost", HOURLY, 0.05)


LIMIT_TABLES = [{"view": {"per_minute": 10, "burst_allowance": 3}, "error": {"per_hour": 120}, "general": {"per_minute": 20, "burst_allowance": 1}}, {"click": {"burst_allowance": 5}}]


def q_limit_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    (full, rate), (other_full, other_rate) = (guards.limit_of(F.col("event_type"), limits) for limits in LIMIT_TABLES)
    return kinds.select("event_type", full.alias("full"), F.round(rate, 9).alias("rate"), other_full.alias("other_full"), F.round(other_rate, 9).alias("other_rate"))


def q_rate_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    limit = lambda k: F.coalesce(*[F.when(F.col("subsystem").startswith(t), v[k] / 100) for t, v in LIMITS.items()], F.lit((10, 3)[k] / 100))
    timed = q_token_bucket(spark, sf_dir).join(table(spark, sf_dir, "events").select("event_id", "ts"), "event_id")
    return guards.rate_status(timed, "subsystem", "event_id", "ts", F.lit("2024-01-31 00:00:00").cast("timestamp"), limit(0) + 1.0, limit(0) / 60)


GUARD_COLUMNS = ("user_id", "caller", "ts", "event_id", "cost", "digest")


def q_guarded_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = ledger(spark, sf_dir).withColumn("caller", F.lit("any")).withColumn("digest", F.col("event_type"))
    return guards.guarded(calls, *GUARD_COLUMNS, HOURLY, 0.05, F.lit(3.0), F.lit(1 / 86400), 2, 200000)


def q_hash_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts of the last day before a time, after a reset of one subsystem, that are close to a loop."""
    prompt = F.concat(F.lit("run "), F.pmod("user_id", F.lit(40)).cast("string"))
    prompts = table(spark, sf_dir, "events").select("ts", F.col("event_type").alias("subsystem"), guards.prompt_hash(prompt).alias("digest"))
    kept = guards.without_subsystem(guards.recent(prompts, "ts", F.lit("2024-01-15 12:00:00").cast("timestamp"), guards.DAY), "subsystem", "click")
    return guards.near_repeats(kept, "digest", 3)


def q_audit_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources import files

    calls = table(spark, sf_dir, "events").select("event_id", (F.col("event_type") != "error").alias("success"))
    kept = [files.audit(calls, level).agg(F.count("*").alias("n")).select(F.lit(level).alias("level"), "n") for level in ("none", "errors_only", "all")]
    return kept[0].unionByName(kept[1]).unionByName(kept[2])


def q_circuit_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = table(spark, sf_dir, "events").withColumn("failed", F.col("event_type").isin("error", "view"))
    found = guards.circuit_breaker(calls, "user_id", "event_id", "failed")
    return found.select("event_id", F.col("failures").cast("long"), "cooldown", "open")


def dialogs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    events = table(spark, sf_dir, "events")
    logs = events.where("event_type = 'error'").select("event_id", "ts")
    sessions = events.where("event_type = 'purchase'").select(F.col("event_id").alias("session_id"), F.col("ts").alias("session_ts"))
    return logs, sessions


def q_dialog_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relate.interval_match(*dialogs(spark, sf_dir), [], "event_id", "session_id", "ts", "session_ts", 600)


def q_dialog_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs, _ = dialogs(spark, sf_dir)
    return relate.unmatched(logs, q_dialog_match(spark, sf_dir), "event_id").select("event_id")


def q_run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day"))
    counted = events.agg(F.count("*").alias("pulses"), F.sum((F.col("event_type") == "error").cast("long")).alias("failed"))
    status = F.when(F.col("failed") == F.col("pulses"), "failed").when(F.col("failed") > 0, "degraded").otherwise("completed")
    return counted.withColumn("status", status)


def q_event_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    subsystems = spark.createDataFrame(
        [("alerts", 10, ["error"]), ("billing", 20, ["purchase", "signup"]), ("audit", None, ["error", "purchase", "view"]), ("growth", 50, ["signup", "view"])],
        "subsystem string, priority int, triggers array<string>",
    )
    found = relate.dispatched(table(spark, sf_dir, "events").select("event_id", "event_type"), subsystems, "event_type")
    return found.select("event_id", "subsystem", F.col("place").cast("int"))


def q_tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type")
    return events.agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def q_sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour", "30 minutes").alias("w"))
    return events.agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total")).select(F.col("w.start").alias("start"), "n", "total")


def q_session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").groupBy(F.session_window("ts", "2 hours").alias("w"), "user_id")
    return events.agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def oracles() -> dict[str, str]:
    rate = lambda k: "CASE event_type " + " ".join(f"WHEN '{m}' THEN {p[k]}" for m, p in PRICES.items() if m != "default") + f" ELSE {PRICES['default'][k]} END::DOUBLE"
    led = f"l AS (SELECT *, epoch_us(ts) AS us, round((floor(abs(value) * 10) / 1e6::DOUBLE) * ({rate(0)}) + (floor(abs(value) * 10) / 1e6::DOUBLE) * ({rate(1)}), 9) AS cost FROM events)"
    spend = f"{led}, s AS (SELECT *, sum(cost) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS hourly, sum(cost) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS daily FROM l)"
    warn = lambda n, c, limit: f"CASE WHEN {c} > 0.75::DOUBLE * {limit} THEN '{n} budget at ' || round({c} / {limit} * 100)::INT || '%' END"
    matched = "m AS (SELECT e.event_id, min(s.event_id) AS session_id FROM events e JOIN events s ON abs(epoch_us(e.ts) - epoch_us(s.ts)) < 600000000 WHERE e.event_type = 'error' AND s.event_type = 'purchase' GROUP BY e.event_id)"
    order = "row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id)"
    spent = lambda width: f"coalesce(list_sum(list_transform(list_filter(f.kept, lambda k: k.t > x.us - {width}000000), lambda k: k.c)), 0)"
    nano = f"{led}, x AS MATERIALIZED (SELECT user_id, event_id, event_type, epoch_us(ts) AS us, round(cost * 1e9)::BIGINT AS c, {order} AS i FROM l)"
    hourly, daily = f"{spent(3600)} + x.c > {round(HOURLY * 1e9)}", f"{spent(86400)} + x.c > {round(0.05 * 1e9)}"
    limit = "CASE event_type WHEN 'view' THEN 0.1 WHEN 'error' THEN 0.05 ELSE 0.1 END::DOUBLE"
    found = {
        "rolling_spend": f"WITH {spend} SELECT event_id, round(cost, 6) AS cost, round(hourly, 6) AS hourly, round(daily, 6) AS daily FROM s",
        "budget_status": f"WITH {spend}, r AS (SELECT event_id, round(hourly, 9) AS h, round(daily, 9) AS d FROM s) SELECT event_id, round(h / {HOURLY} * 100, 3) AS hourly_percent, round(d / {DAILY} * 100, 3) AS daily_percent, round(greatest(0, {HOURLY}::DOUBLE - h), 6) AS hourly_left, round(greatest(0, {DAILY}::DOUBLE - d), 6) AS daily_left, concat_ws('; ', {warn('Hourly', 'h', HOURLY)}, {warn('Daily', 'd', DAILY)}) AS warnings FROM r",
        "repeated_prompts": "WITH p AS (SELECT event_id, epoch_us(ts) AS us, substr(sha256('run ' || event_type || ' for user ' || (user_id % 3)), 1, 16) AS digest FROM events), c AS (SELECT *, count(*) OVER (PARTITION BY digest ORDER BY us RANGE BETWEEN 1799999999 PRECEDING AND 1 PRECEDING) AS earlier FROM p) SELECT event_id, digest, earlier, earlier >= 2 AS blocked FROM c",
        "token_bucket": f"""WITH RECURSIVE e AS MATERIALIZED (SELECT event_id, event_type || ':' || (user_id % 5) AS subsystem, epoch_us(ts) / 1e6::DOUBLE AS sec, {limit} AS lim, row_number() OVER (PARTITION BY event_type || ':' || (user_id % 5) ORDER BY epoch_us(ts), event_id) AS i FROM events),
f AS (SELECT subsystem, event_id, i, sec, (lim + 1) AS have, CASE WHEN lim + 1 >= 1 THEN lim ELSE lim + 1 END AS t, lim FROM e WHERE i = 1
UNION ALL SELECT x.subsystem, x.event_id, x.i, x.sec, least(x.lim + 1, f.t + (x.sec - f.sec) * (x.lim / 60)), CASE WHEN least(x.lim + 1, f.t + (x.sec - f.sec) * (x.lim / 60)) >= 1 THEN least(x.lim + 1, f.t + (x.sec - f.sec) * (x.lim / 60)) - 1 ELSE least(x.lim + 1, f.t + (x.sec - f.sec) * (x.lim / 60)) END, x.lim FROM f JOIN e x ON x.subsystem = f.subsystem AND x.i = f.i + 1)
SELECT subsystem, event_id, have >= 1 AS allowed, round(t, 6) AS tokens, CASE WHEN have >= 1 THEN 0 ELSE round((1 - have) / (lim / 60), 6) END AS wait FROM f""",
        "budget_admission": f"""WITH RECURSIVE {nano}, f AS (SELECT user_id, event_id, i, CASE WHEN c > {round(HOURLY * 1e9)} THEN 'Hourly' ELSE 'ok' END AS verdict, CASE WHEN c > {round(HOURLY * 1e9)} THEN [] ELSE [{{t: us, c: c}}] END AS kept FROM x WHERE i = 1
UNION ALL SELECT x.user_id, x.event_id, x.i, CASE WHEN {hourly} THEN 'Hourly' WHEN {daily} THEN 'Daily' ELSE 'ok' END, CASE WHEN {hourly} OR {daily} THEN f.kept ELSE list_append(list_filter(f.kept, lambda k: k.t > x.us - 86400000000), {{t: x.us, c: x.c}}) END FROM f JOIN x ON x.user_id = f.user_id AND x.i = f.i + 1)
SELECT user_id, event_id, verdict FROM f""",
        "guarded_calls": f"""WITH RECURSIVE {nano}, f AS (SELECT user_id, event_id, i, us, CASE WHEN c > {round(HOURLY * 1e9)} THEN 'hourly' ELSE '' END AS errors, CASE WHEN c > {round(HOURLY * 1e9)} THEN 3.0::DOUBLE ELSE 2 END AS tokens, CASE WHEN c > {round(HOURLY * 1e9)} THEN [] ELSE [{{t: us, c: c}}] END AS kept, CASE WHEN c > {round(HOURLY * 1e9)} THEN [] ELSE [{{t: us, d: event_type}}] END AS prompts FROM x WHERE i = 1
UNION ALL SELECT user_id, event_id, i, us, errors, CASE WHEN errors = '' THEN have - 1 ELSE have END, CASE WHEN errors = '' THEN list_append(kept, {{t: us, c: c}}) ELSE kept END, CASE WHEN errors = '' THEN list_append(prompts, {{t: us, d: event_type}}) ELSE prompts END FROM
(SELECT x.user_id, x.event_id, x.i, x.us, x.c, x.event_type, f.kept, f.prompts, least(3, f.tokens + (x.us / 1e6::DOUBLE - f.us / 1e6::DOUBLE) * (1 / 86400::DOUBLE)) AS have,
concat_ws(',', CASE WHEN {hourly} THEN 'hourly' WHEN {daily} THEN 'daily' END, CASE WHEN least(3, f.tokens + (x.us / 1e6::DOUBLE - f.us / 1e6::DOUBLE) * (1 / 86400::DOUBLE)) < 1 THEN 'rate' END,
CASE WHEN len(list_filter(f.prompts, lambda k: k.t > x.us - 200000000000 AND k.d = x.event_type)) >= 2 THEN 'loop' END) AS errors FROM f JOIN x ON x.user_id = f.user_id AND x.i = f.i + 1))
SELECT user_id, event_id, errors = '' AS allowed, errors FROM f""",
        "limit_lookup": "SELECT event_type, CASE event_type WHEN 'view' THEN 13.0 WHEN 'error' THEN 120 ELSE 21 END::DOUBLE AS \"full\", round(CASE event_type WHEN 'view' THEN 10 / 60::DOUBLE WHEN 'error' THEN 120 / 3600::DOUBLE ELSE 20 / 60::DOUBLE END, 9) AS rate, CASE event_type WHEN 'click' THEN 15.0 ELSE 10 END::DOUBLE AS other_full, round(10 / 60::DOUBLE, 9) AS other_rate FROM (SELECT DISTINCT event_type FROM events)",
        "hash_histogram": "WITH p AS (SELECT substr(sha256('run ' || (user_id % 40)), 1, 16) AS digest FROM events WHERE ts <= TIMESTAMP '2024-01-15 12:00:00' AND epoch_us(TIMESTAMP '2024-01-15 12:00:00') - epoch_us(ts) < 86400000000 AND event_type <> 'click') SELECT digest, count(*) AS n FROM p GROUP BY digest HAVING count(*) >= 2",
        "audit_levels": "SELECT 'none' AS level, 0::BIGINT AS n UNION ALL SELECT 'errors_only', count(*) FROM events WHERE event_type = 'error' UNION ALL SELECT 'all', count(*) FROM events",
        "circuit_breaker": "WITH c AS (SELECT *, event_type IN ('error', 'view') AS failed, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events), f AS (SELECT event_id, i - coalesce(max(CASE WHEN NOT failed THEN i END) OVER (PARTITION BY user_id ORDER BY event_id), 0) AS failures FROM c) SELECT event_id, failures, CASE WHEN failures < 2 THEN 0 ELSE least(48, 3 * 2 ** least(10, failures - 2)) END::INT AS cooldown, failures >= 2 AS open FROM f",
        "dialog_match": f"WITH {matched} SELECT event_id, session_id FROM m",
        "dialog_unmatched": f"WITH {matched} SELECT event_id FROM events WHERE event_type = 'error' AND event_id NOT IN (SELECT event_id FROM m)",
        "run_status": "SELECT user_id, ts::DATE AS day, count(*) AS pulses, count(*) FILTER (event_type = 'error') AS failed, CASE WHEN count(*) FILTER (event_type = 'error') = count(*) THEN 'failed' WHEN count(*) FILTER (event_type = 'error') > 0 THEN 'degraded' ELSE 'completed' END AS status FROM events GROUP BY user_id, day",
        "event_dispatch": "WITH s(subsystem, priority, event_type) AS (VALUES ('alerts', 10, 'error'), ('billing', 20, 'purchase'), ('billing', 20, 'signup'), ('audit', 50, 'error'), ('audit', 50, 'purchase'), ('audit', 50, 'view'), ('growth', 50, 'signup'), ('growth', 50, 'view')), p AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY priority, subsystem)::INT AS place FROM s) SELECT event_id, subsystem, place FROM events JOIN p USING (event_type)",
        "tumbling_windows": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL",
        "sliding_windows": "WITH w AS (SELECT time_bucket(INTERVAL '30 minutes', ts) - INTERVAL '30 minutes' * k AS start, value FROM events, range(2) r(k)) SELECT start, count(*) AS n, round(sum(value), 6) AS total FROM w GROUP BY start",
        "session_windows": "WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '2 hours' THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '2 hours' AS \"end\", count(*) AS n FROM s GROUP BY user_id, k",
    }
    found["rate_status"] = f"""WITH b AS ({found['token_bucket']}), l AS (SELECT subsystem, arg_max(tokens, event_id) AS t, max(event_id) AS event_id FROM b GROUP BY subsystem), e AS (SELECT l.*, epoch_us(ts) / 1e6::DOUBLE AS sec, {limit} AS lim FROM l JOIN events USING (event_id)),
h AS (SELECT subsystem, lim + 1 AS f, least(lim + 1, t + (epoch_us(TIMESTAMP '2024-01-31') / 1e6::DOUBLE - sec) * (lim / 60)) AS have FROM e) SELECT subsystem, round(have, 6) AS available, round(have / f * 100, 3) AS percent FROM h"""
    return found
