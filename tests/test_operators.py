from __future__ import annotations

import hashlib
import html.parser
import re
import statistics

import pytest
from pyspark.sql import functions as F

from quillstream.functions import text as T
from quillstream.operators import chunking, classify, feels, guards, parsers, relate, retrieval, sampling, signals, temporal
from quillstream.sources import files
from quillstream.sources.tables import table
from quillstream.streaming import windows


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_boost_and_recency(spark):
    assert one(spark, sampling.salience_boost(F.lit(6.0))) == pytest.approx(1.18)
    assert one(spark, sampling.salience_boost(F.lit(100.0))) == pytest.approx(1.3)
    assert one(spark, sampling.salience_boost(F.lit(6.0), factor=0)) == 1.0
    on = F.lit("2024-03-01").cast("date")
    age = lambda n: one(spark, sampling.recency(F.date_sub(on, n), on, 30.0))
    assert age(30) == pytest.approx(0.5)
    assert age(60) == pytest.approx(0.436, abs=1e-3)
    assert age(-5) == 1.0
    assert one(spark, sampling.recency(F.lit(None).cast("date"), on, 30.0)) == 1.0


def test_softmax(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 1.0), (1, 1.0), (2, 1.0), (2, 10.0), (2, 1.0)], "g int, v double")
    even = sampling.with_softmax(df.where("g = 1"), "g", "v", 1.0).collect()
    assert [r["probability"] for r in even] == pytest.approx([1 / 3] * 3)
    assert max(r["probability"] for r in sampling.with_softmax(df.where("g = 2"), "g", "v", 0.01).collect()) > 0.99


def test_weighted_sample_follows_weights(spark):
    df = spark.range(2000).select("id", F.when(F.col("id") % 2 == 0, 3.0).otherwise(1.0).alias("w"))
    chosen = [r["id"] for r in sampling.weighted_sample(df, "w", ["id"], 400, 5).collect()]
    assert len(set(chosen)) == 400
    assert 0.65 < sum(i % 2 == 0 for i in chosen) / 400 < 0.82
    assert chosen == [r["id"] for r in sampling.weighted_sample(df.repartition(7), "w", ["id"], 400, 5).collect()]


def test_draw_with_replacement(spark):
    df = spark.createDataFrame([(1, 0.75), (2, 0.25)], "id int, p double")
    drawn = sampling.draw_with_replacement(df, "p", ["id"], 200, 3).groupBy("id").count().collect()
    counts = {r["id"]: r["count"] for r in drawn}
    assert sum(counts.values()) == 200
    assert 120 < counts[1] < 180


def test_cost_and_turns(spark):
    price = {"a": (15.0, 75.0), "default": (1.0, 2.0)}
    assert one(spark, guards.cost(F.lit("a"), F.lit(1000000), F.lit(1000000), price)) == pytest.approx(90.0)
    assert one(spark, guards.cost(F.lit("x"), F.lit(1000000), F.lit(0), price)) == pytest.approx(1.0)
    assert [one(spark, temporal.turn_budget(F.lit(b))) for b in (0.0, 0.3, 0.65, 1.0)] == [30, 30, 38, 45]


def test_prompt_hash(spark):
    assert one(spark, guards.prompt_hash(F.lit("  a\n b  "))) == hashlib.sha256(b"a b").hexdigest()[:16]


def test_cooldown(spark):
    df = spark.createDataFrame([("s", i, i != 3) for i in range(11)], "s string, i int, failed boolean")
    found = {r["i"]: (r["failures"], r["cooldown"]) for r in guards.circuit_breaker(df, "s", "i", "failed").collect()}
    assert [found[i] for i in (0, 1, 2, 3, 4, 5)] == [(1, 0), (2, 3), (3, 6), (0, 0), (1, 0), (2, 3)]
    assert found[10] == (7, 48)


def test_budget_admission_against_a_plain_loop(spark, sf):
    calls = table(spark, sf, "events").withColumn("cost", F.abs("value") / 1000)
    got = {r["event_id"]: r["verdict"] for r in guards.budget_admission(calls, "user_id", "ts", "event_id", "cost", 0.05, 0.06).collect()}
    kept, wanted = {}, {}
    for r in calls.orderBy("ts", "event_id").collect():
        at, c = r["ts"].timestamp(), r["cost"]
        mine = kept.setdefault(r["user_id"], [])
        hour, day = sum(v for t, v in mine if t > at - 3600), sum(v for t, v in mine if t > at - 86400)
        wanted[r["event_id"]] = "Hourly" if hour + c > 0.05 else "Daily" if day + c > 0.06 else "ok"
        if wanted[r["event_id"]] == "ok":
            mine.append((at, c))
    assert got == wanted
    assert len(set(wanted.values())) == 3


def test_suppression_lasts_five_pulses(spark):
    offers = spark.createDataFrame([("q", 0)], "query string, pulse int")
    state = [retrieval.suppression(offers, "query", "pulse", n).first() for n in (0, 5, 6, 30)]
    assert [s["suppressed"] if s else None for s in state] == [True, True, False, None]


def test_coalesced_turns(spark):
    rows = [(1, 0, "user", " a "), (1, 1, "user", "a"), (1, 2, "user", "b"), (1, 3, "system", "x"), (1, 4, "assistant", "c"), (1, 5, "assistant", None)]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string").where("text IS NOT NULL")
    turns = chunking.coalesced_turns(chunking.speaker_turns(df))
    assert [(r["role"], r["text"]) for r in turns.orderBy("run").collect()] == [("Human", "a\n\nb"), ("Assistant", "c")]
    assert chunking.turn_pairs(turns).count() == 1


def test_windows_follow_stride(spark):
    pairs = spark.range(6).select(F.lit(1).alias("conv_id"), F.col("id").cast("int").alias("pair"), F.lit("q").alias("voice_a"), F.lit("a").alias("voice_b"))
    sizes = chunking.chunk_windows(pairs).groupBy("pair_count").count().collect()
    assert {r["pair_count"]: r["count"] for r in sizes} == {1: 6, 2: 5, 3: 2, 5: 1}


def test_nearest_rank_rounds_half_to_even(spark):
    df = spark.createDataFrame([(1, float(i)) for i in range(6)], "g int, v double")
    cut = lambda p: feels.nearest_rank(df, ["g"], "v", p, "c").first()["c"]
    assert [cut(p) for p in (0.0, 0.5, 0.7, 1.0)] == [0.0, 2.0, 4.0, 5.0]


def test_population_deviation(spark):
    numbers = [3, 9, 4, 4, 12]
    got = one(spark, T.population_deviation(F.array(*[F.lit(n) for n in numbers])))
    assert got == pytest.approx(statistics.pstdev(numbers))


def test_feels_score_by_hand(spark):
    df = spark.createDataFrame([("Maybe. You can rest now, no need to hurry.", ["meta-commentary"], 2)], "text string, tags array<string>, pair_count int")
    row = feels.with_feels(df).first()
    # 3 open + 2 meta + 1 hedge + 3 permission and lift + 3 liminal, times 1.2
    assert row["feels_score"] == pytest.approx((3 + 2 + 1 + 3 + 3) * 1.2)
    assert set(row["feels_components"]) == {"nonterminal", "meta", "hedging", "permission", "liminal_meta", "pair_weight"}


def test_blank_texts_have_no_signals(spark, sf):
    df = spark.createDataFrame([(1, ""), (2, "   "), (3, None)], "id int, text string")
    row = signals.with_behaviours(df).where("id < 3").collect()
    assert all(r[f"behavioral_{b}"] == 0.0 for r in row for b in signals.BEHAVIOURS)
    assert signals.with_linguistic(df).count() == 3


def test_feeling_overrides(spark):
    zero = {b: F.lit(0.0) for b in signals.BEHAVIOURS}
    label = lambda v, a, c="exploratory", **b: one(spark, classify.feeling(F.lit(v), F.lit(a), F.lit(c), zero | {k: F.lit(x) for k, x in b.items()}))["type"]
    assert label(0.5, 0.5, frustration=0.3) == "frustrated"
    assert label(0.0, 0.3) == "neutral"
    assert label(-0.3, 0.6, "infrastructure") == "frustrated"
    assert label(-0.3, 0.6, "philosophical") == "engaged_critical"
    assert label(0.4, 0.6) == "delighted"
    assert label(0.2, 0.2, warmth=0.4) == "peaceful"
    assert label(0.0, 0.6, "companion") == "alert"


def test_html_text_equals_a_parser(spark, sf):
    class Reader(html.parser.HTMLParser):
        def __init__(self):
            super().__init__()
            self.parts = []

        def handle_data(self, data):
            self.parts.append(data)

    pages = table(spark, sf, "pages").select("html", parsers.html_text(F.col("html")).alias("got")).collect()
    same = 0
    for row in pages:
        reader = Reader()
        reader.feed(row["html"])
        reader.close()
        same += re.sub(r"\s+", " ", " ".join(reader.parts)).strip() == re.sub(r"\s+", " ", row["got"]).strip()
    assert same == len(pages)


def test_decayed_peak_forms_agree(spark, sf):
    events = table(spark, sf, "events").select("user_id", "event_id", F.coalesce("value", F.lit(0.0)).alias("value"))
    fold = temporal.decayed_peaks(events, "user_id", "event_id", {"value": 0.0})
    closed = temporal.decayed_peaks_closed(events, "user_id", "event_id", "value")
    gap = fold.join(closed, ["user_id", "event_id"]).agg(F.max(F.abs(F.col("d_value") - F.col("peak"))).alias("gap")).first()["gap"]
    assert gap < 0.005


@pytest.mark.parametrize("decay", [0.5, 0.85, 0.999])
def test_decayed_peak_of_a_long_stream(spark, decay):
    """Past the 4,367th step, where 0.85 to the minus t leaves the range of doubles; zeros, nulls and negatives too."""
    values = [None if i % 11 == 3 else (-1.0, 0.0, 0.0, 0.25, 0.0, 1e-3, 0.0)[i % 7] * (1 + i % 13) if i < 8_000 else 0.0 for i in range(12_000)]
    df = spark.createDataFrame([("s", i, v) for i, v in enumerate(values)], "s string, i int, v double")
    got = [r["peak"] for r in temporal.decayed_peaks_closed(df, "s", "i", "v", decay).orderBy("i").collect()]
    wanted, last = [], 0.0
    for v in values:
        wanted.append(last := max(v or 0.0, last * decay))
    assert got == pytest.approx(wanted, rel=1e-9, abs=1e-290)


def test_stream_equals_batch(spark, sf, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", windows.ROCKSDB)
    got = windows.drained(windows.decayed_peaks(windows.event_stream(spark, sf)), str(tmp_path), "append")
    events = table(spark, sf, "events").select("user_id", "event_id", F.coalesce("value", F.lit(0.0)).alias("value"))
    fold = temporal.decayed_peaks(events, "user_id", "event_id", {"value": 0.0})
    both = got.join(fold, ["user_id", "event_id"])
    assert both.count() == events.count() == got.count()
    assert both.agg(F.max(F.abs(F.col("peak") - F.col("d_value")))).first()[0] < 0.0015


def test_interval_match_is_strict(spark):
    logs = spark.createDataFrame([(1, "2024-01-01 00:10:00"), (2, "2024-01-01 00:09:59"), (3, "2024-01-02 00:00:00")], "log int, t string").withColumn("t", F.to_timestamp("t"))
    sessions = spark.createDataFrame([(9, "2024-01-01 00:00:00"), (8, "2024-01-01 00:15:00")], "s int, u string").withColumn("u", F.to_timestamp("u"))
    got = relate.interval_match(logs, sessions, [], "log", "s", "t", "u", 600)
    assert {(r["log"], r["s"]) for r in got.collect()} == {(1, 8), (2, 8)}
    assert [r["log"] for r in relate.unmatched(logs, got, "log").collect()] == [3]


def test_file_sources(spark, tmp_path):
    folder = tmp_path / "2_2024-05-01_talk"
    folder.mkdir()
    (folder / "conversation.md").write_text("# Conversation: A talk\n=== H ===\nhi\n")
    (tmp_path / "x.jsonl").write_text('{"a": 1}\nbroken\n\n{"a": 2, "b": "y"}\n')
    (tmp_path / "2024-01-02_note.md").write_text("First\nsecond")
    row = files.transcripts(spark, str(tmp_path)).select("*", files.conversation_name(F.col("text")).alias("name"), files.folder_date(F.col("path")).alias("date")).first()
    assert (row["name"], row["date"]) == ("A talk", "2024-05-01")
    assert {(r["a"], r["b"]) for r in files.json_lines(spark, str(tmp_path / "x.jsonl"), "a int, b string").collect()} == {(1, None), (2, "y")}
    note = files.notes(spark, str(tmp_path)).where("path LIKE '2024%'").first()
    assert (note["date"], note["lines"], note["first_line"]) == ("2024-01-02", 2, "First")
    found = files.transcripts(spark, str(tmp_path))
    assert files.discover(found, found.limit(0)).count() == 1
    assert files.discover(found, found).count() == 0
    assert files.discover(found, found.withColumn("size", F.col("size") + 1), reprocess=True).count() == 1
    names = spark.createDataFrame([("2024-05-01_120000_ab",), ("2024-05-01_120001_cd",), ("bad",)], "name string")
    assert files.in_range(names, "name", "2024-05-01 12:00:00", "2024-05-01 12:00:00").count() == 1


def test_hint_strips_spaces_only(spark):
    """The number of a line is no set of characters to strip: the first line may begin with 0, the second with 1."""
    assert one(spark, retrieval.hint(F.lit("  0997523947200 a line  "))) == "0997523947200 a line"
    assert one(spark, retrieval.hint(F.lit("short\n 1234567890 of 111"))) == "1234567890 of 111"


def test_bm25_adds_scores_up_where_a_text_lies(spark):
    """No shuffle of (query, text) pairs, which are many times the postings."""
    docs = spark.createDataFrame([(1, "red fox"), (2, "red red hen"), (3, "hen")], "k int, text string")
    asked = spark.createDataFrame([(7, "red"), (8, "a hen")], "q int, text string")
    found = retrieval.bm25(asked, docs, "q", "k", 2)
    assert not re.search(r"hashpartitioning\(q#\w+, k#", found._jdf.queryExecution().executedPlan().toString())
    assert [(r["q"], r["k"], r["rank"]) for r in found.orderBy("q", "rank").collect()] == [(7, 2, 1), (7, 1, 2), (8, 3, 1), (8, 2, 2)]


def test_guards_and_one_search_change_no_count(spark):
    assert T.needed_literals(r"(token|weight).{0,5}(oh|yes)") == ["token", "weight"]
    assert T.needed_literals(r"\bi('m| am) (here|present)\b") == ["i'm", "i am"]
    assert T.needed_literals(r"(I am [^.]+\. ?){2,}") == ["i am "]
    assert T.needed_literals(r"(a|b)?x|y") == []
    assert T.needed_literals(r"^\d+\.\s.*\n\d") == ["."]
    patterns = [r"(token|weight).{0,5}(oh|yes)", r"(I am [^.]+\. ?){2,}", r"\bx\b"]
    texts = [("The WEIGHT, oh. I am one. I am two.",), ("x token",), ("",), (None,), ("token yes x X",)]
    seen = T.Searched("has")
    counted = T.matches(F.col("t"), patterns, lowered=seen)
    df = spark.createDataFrame(texts, "t string").withColumn("has", seen.flags(F.lower("t")))
    assert [r[0] for r in df.select(counted).collect()][:3] == [2, 1, 0]
    plain = sum((F.regexp_count("t", T.python_regex(p)) for p in patterns), F.lit(0))
    assert [r[0] for r in df.where("t IS NOT NULL").select(counted).collect()] == [r[0] for r in df.where("t IS NOT NULL").select(plain).collect()]


def test_measures_are_evaluated_once(spark, sf):
    """Every pattern of a behaviour stands in the plan once, not in every condition that reads its count."""
    from quillstream.plans.signals import q_output_type, q_signals_behavioral

    for query, pattern in ((q_signals_behavioral, "mechanism).{0,50}"), (q_output_type, "cross-model")):
        assert query(spark, sf)._jdf.queryExecution().optimizedPlan().toString().count(pattern) <= 2
