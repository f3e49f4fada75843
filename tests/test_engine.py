import io

import pytest
from gleaner.api import Engine, event_frame, render_report, render_table, to_csv
from gleaner.model import Filter, Metric, Query
from gleaner.operators import profile, segments
from gleaner.operators.dataset import Dataset
from gleaner.operators.quality import assess
from gleaner.plans import agent, query, semantic
from gleaner.sources import samples

FIVE = "order_id,date,region,revenue,margin_rate\nA1,2025-01-01,Север,100,0.2\nA2,2025-01-02,Юг,200,0.3\nA3,2025-01-03,Север,300,0.25\nA4,2025-01-04,Юг,400,0.2\nA5,2025-01-05,Север,500,0.3\n"


@pytest.fixture(scope="module")
def five(spark):
    engine = Engine(spark)
    return engine, engine.upload_dataset(FIVE, "five")


def test_classification(five):
    engine, key = five
    m = engine.get_semantic_model(key)
    assert m.identifiers == ["order_id"] and [t.name for t in m.times] == ["date"] and [d.name for d in m.dimensions] == ["region"]
    by = {x.name: x for x in m.measures}
    assert by["revenue"].additive and by["revenue"].aggregation == "sum" and not by["margin_rate"].additive and by["margin_rate"].aggregation == "avg"
    assert m.measures[0].column == "*" and "MEASURES" in engine.describe_semantic_model(key)


def test_group_sum(five):
    engine, key = five
    r = engine.query_data(key, Query([Metric("revenue")], ["region"]))
    assert dict(r.rows) == {"Север": 900, "Юг": 600} and r.columns == ["region", "sum(revenue)"] and r.rows[0][0] == "Север"


def test_filter_before_aggregation(five):
    engine, key = five
    r = engine.query_data(key, Query([Metric("revenue")], filters=[Filter("revenue", "gte", 300)]))
    assert r.rows == [(1200,)] and r.rows_scanned == 3 and r.rows_total == 5


def test_rate_is_never_summed(five):
    engine, key = five
    r = engine.query_data(key, Query([Metric("margin_rate", "sum")]))
    assert r.columns == ["avg(margin_rate)"] and r.rows == [(0.25,)] and "not additive" in r.explanation


def test_unknown_names(five):
    engine, key = five
    with pytest.raises(semantic.QueryError) as e:
        engine.query_data(key, Query([Metric("revenu")]))
    assert "revenue" in e.value.suggestions
    for q in (Query([Metric("revenue")], ["place"]), Query([Metric("revenue")], filters=[Filter("x", "eq", 1)]), Query([Metric("revenue")], filters=[Filter("revenue", "like", 1)]), Query([Metric("revenue")], order_by=[("x", "asc")]), Query([])):
        with pytest.raises(semantic.QueryError):
            engine.query_data(key, q)


def test_filters_on_text_and_time(five):
    engine, key = five
    count = lambda f: engine.query_data(key, Query([Metric("row_count")], filters=[f])).rows
    assert count(Filter("region", "contains", "СЕВ")) == [(3,)] and count(Filter("date", "gt", "2025-01-03")) == [(2,)]
    assert count(Filter("date", "between", ["2025-01-04", "2025-01-02"])) == [(3,)] and count(Filter("region", "eq", "x")) == []
    assert count(Filter("region", "in", "Юг")) == [(2,)] and count(Filter("revenue", "gt", "abc")) == []


def test_limit_order_render(five):
    engine, key = five
    r = engine.query_data(key, Query([Metric("revenue")], ["date"], "day", limit=2))
    assert r.truncated and [x[0] for x in r.rows] == ["2025-01-01", "2025-01-02"]
    assert "sum(revenue)" in render_table(r) and "cut" in render_table(r)
    down = engine.query_data(key, Query([Metric("revenue")], ["date"], "day", order_by=[("sum(revenue)", "desc")]))
    assert down.rows[0][1] == 500 and to_csv(["a"], [(None,), ("x,y",)]) == 'a\n\n"x,y"\n'.replace("a\n\n", 'a\n""\n')
    assert io.StringIO(to_csv(r.columns, r.rows)).readline().strip() == "date,sum(revenue)"


def test_patch_and_ask(spark):
    engine = Engine(spark, planner=lambda ds, q: {"metrics": [{"measure": "margin_rate", "aggregation": "sum"}], "group_by": ["region"], "filters": [{"field": "region", "op": "in", "value": "Север, Юг"}], "top": 1})
    key = engine.upload_dataset(FIVE)
    assert engine.update_semantic_model(key, {"revenue": {"aggregation": "avg", "additive": False}, "nope": {}}, reviewed=True) == ["nope"]
    assert engine.query_data(key, Query([Metric("revenue", "sum")])).columns == ["avg(revenue)"] and engine.get_semantic_model(key).reviewed
    with pytest.raises(ValueError):
        engine.update_semantic_model(key, {"revenue": {"aggregation": "mode"}})
    r = engine.ask(key, "Which region has the best margin?")
    assert len(r.rows) == 1 and r.columns == ["region", "avg(margin_rate)"]
    with pytest.raises(RuntimeError):
        Engine(spark).ask(key, "?")


def test_persistence(spark, tmp_path):
    home = f"file://{tmp_path}"
    engine = Engine(spark, home)
    key = engine.upload_dataset(FIVE, "five")
    engine.update_semantic_model(key, {}, reviewed=True)
    again = Engine(spark, home)
    assert again.reload() == [key] and again.get_semantic_model(key).reviewed
    assert again.query_data(key, Query([Metric("revenue")])).rows == [(1500,)] and again.list_datasets()[0]["rows"] == 5
    assert [p.name for p in again.profile_dataset(key, ["revenue"])] == ["revenue"] and again.describe(key)["columns"]
    assert again.delete_dataset(key) and not Engine(spark, home).reload()


def test_findings_and_profiles_survive_a_reload(spark, tmp_path):
    from gleaner.api import render_report

    home = f"file://{tmp_path}"
    engine = Engine(spark, home)
    first = engine.add_frame(samples.SAMPLES["retail"](spark), "retail")
    second = engine.add_frame(spark.range(5).toDF("x"), "later")
    profiles = engine.profile_dataset(first)
    summary = engine.analyze_dataset(first)
    again = Engine(spark, home)
    assert again.reload() == [first, second] and [x["id"] for x in again.list_datasets()] == [second, first]
    assert len(summary.insights) > 3 and again.get_insights(first) == engine.get_insights(first)
    assert again.dataset(first).profiles == profiles and again.profile_dataset(first) == profiles
    assert render_report(summary)


def test_quality(spark):
    dirty = Engine(spark)
    d = dirty.datasets[dirty.upload_dataset("id,value,category\n1,10,a\n2,,b\n3,,a\n4,40,b\n4,,a\n4,,a\n")]
    report = assess(d, d.profiles)
    assert {"nulls", "duplicates"} <= {i.kind for i in report.issues} and report.score < 1 and all(len(x.narrative) > 40 for x in report.insights)
    rows = "\n".join(f"{i},{3 * i},{'a' if i % 3 == 0 else 'b'}" for i in range(1, 61))
    c = dirty.datasets[dirty.upload_dataset("id,value,category\n" + rows)]
    clean = assess(c, c.profiles)
    assert clean.score > 0.85 and not [i for i in clean.issues if i.severity == "high"]


def analysed(spark, df, focus=""):
    ds = Dataset("sample", df)
    agent.prepare(ds)
    ds = ds.materialised()
    return ds, agent.run_all(ds, focus)


@pytest.fixture(scope="module")
def saas(spark):
    return analysed(spark, samples.saas(spark))


def test_saas_effects(saas):
    _, s = saas
    titles = " ".join(x.title for x in s.insights)
    assert s.hypotheses > 50 and len(s.insights) >= 5 and "EMEA" in titles and "Партнёры" in titles
    assert any(x.kind == "quality" for x in s.insights)
    assert any(x.kind == "trend" and {"mrr", "seats", "row_count"} & set(x.subjects) for x in s.insights)


def test_invariants(saas):
    _, s = saas
    for x in s.insights:
        assert x.title and len(x.narrative) > 40 and x.trace and x.evidence.facts and x.next_steps
        assert 0 <= x.confidence <= 1 and 0 <= x.impact <= 1
        assert x.kind != "correlation" or any("causality" in c for c in x.caveats)
    assert s.headline in render_report(s) and s.steps and s.jobs < s.hypotheses


def test_retail_effects(spark):
    _, s = analysed(spark, samples.retail(spark))
    titles = " ".join(x.title for x in s.insights)
    assert "Почта" in titles and any(x.kind == "correlation" for x in s.insights) and (any(x.kind == "concentration" for x in s.insights) or "Электроника" in titles)


def test_noise_stays_quiet(spark):
    found = []
    for seed in (12345, 2, 3):
        _, s = analysed(spark, samples.noise(spark, seed=seed))
        real = [x for x in s.insights if x.kind != "quality"]
        found.append(len(real))
        assert s.hypotheses > 60 and all(x.confidence < 0.75 or x.kind == "anomaly" for x in real)
    assert sum(found) <= 2.5 * len(found)  # of over 60 questions each


def test_degenerate(spark):
    _, s = analysed(spark, spark.createDataFrame([(str(i),) for i in range(1, 6)], "value string"))
    assert s.headline and not [x for x in s.insights if x.kind != "quality"]


def test_focus_changes_order_only(saas):
    ds, _ = saas
    plain, focused = agent.hypotheses(ds), agent.hypotheses(ds, "mrr please")
    assert len(plain) == len(focused) and [h.question for h in plain] != [h.question for h in focused] and "mrr" in focused[0].question


def test_events_and_insight_frame(spark):
    engine = Engine(spark, narrator=lambda ds, found: "told")
    key = engine.upload_dataset(FIVE)
    events = list(engine.analyze_events(key))
    assert [e.phase for e in events][:5] == ["ingest", "profile", "semantic", "quality_gate", "hypothesize"] and events[-1].phase == "done" and events[-1].message == "told"
    assert event_frame(events[0]).startswith("data: {") and all(a.progress <= b.progress for a, b in zip(events, events[1:], strict=False))
    assert engine.insight_frame(key).count() == len(engine.get_insights(key))


def test_null_time_rows_and_labels(spark):
    df = spark.createDataFrame([("2025-01-01", None, 1.0), (None, "a", 2.0), ("2025-01-02", "a", None)], "d string, g string, v double")
    ds = Dataset("x", df.selectExpr("to_timestamp(d) as d", "g", "v"))
    agent.prepare(ds)
    ds.model.times[0].grain = "day"
    ds.model.dimensions = [semantic.Dimension("g", "g", 1)]
    r = query.run(ds, Query([Metric("row_count")], ["d"]))
    assert r.rows == [("2025-01-01", 1), ("2025-01-02", 1)] and r.rows_scanned == 3
    assert dict(query.run(ds, Query([Metric("row_count")], ["g"])).rows) == {"(empty)": 1, "a": 2}


def test_profile_matches_python(spark):
    p = {x.name: x for x in profile.profile(Dataset("n", samples.noise(spark)))}
    assert p["date"].logical_type == "date" and p["date"].temporal.grain == "day" and p["date"].temporal.gaps == 0 and p["segment"].distinct_count == 4
    assert p["value_a"].logical_type == "number" and p["value_a"].numeric.count == 1197 and len(p["tier"].top_values) == 5
    assert profile.type_histogram(list(p.values()))["category"] == 3


def test_split_moment_is_an_element(spark):
    rows = [(f"2025-01-{1 + i % 9:02d} {i % 24:02d}:00:00",) for i in range(101)]
    ds = Dataset("t", spark.createDataFrame(rows, "t string").selectExpr("to_timestamp(t) as t"))
    want = sorted(r["t"] for r in ds.df.collect())
    assert segments.split_moment(ds, "t") == (want[50], 101)


def test_moments_frame_against_collected_values(spark):
    from gleaner.functions.stats import Moments

    ds = Dataset("n", samples.noise(spark))
    agent.prepare(ds)
    m = [x for x in ds.model.measures if x.column == "value_a"]
    got = segments.collect_segments(ds, ds.model.dimensions, m)
    rows = ds.df.select("segment", "value_a").collect()
    for s in got["segment"]:
        want = Moments.from_values([float(r["value_a"]) for r in rows if r["segment"] == s.value])
        mine = s.total[m[0].name]
        assert (mine.n, mine.mean, mine.var) == (want.n, pytest.approx(want.mean), pytest.approx(want.var))


def test_quantiles_match_percentile(spark):
    import random

    from gleaner.functions import stats
    from gleaner.functions.quantiles import quantiles

    rng = random.Random(4)
    values = {0: [rng.choice([1.0, 2.0, 2.0, 7.5]) for _ in range(301)], 1: [rng.random() for _ in range(1000)], 2: [5.0], 3: [1.0, 2.0]}
    df = spark.createDataFrame([(c, x) for c, xs in values.items() for x in xs] + [(4, None)], "c int, x double").repartition(7)
    qs = [0.0, 0.05, 0.5, 0.95, 1.0]
    got = {r["c"]: list(r[1:]) for r in quantiles(df, qs).collect()}
    assert set(got) == set(values)
    for c, xs in values.items():
        assert got[c] == pytest.approx([stats.percentile(xs, q) for q in qs])


def test_large_sums_are_kept_and_shares_are_of_all(spark):
    """Values with few rows and a large sum stay; concentration is exact beyond what is listed."""
    import random

    from gleaner.functions import stats
    from gleaner.model import Dimension, Measure

    rng = random.Random(3)
    rows = [(f"k{i:03d}", round(rng.paretovariate(1.1), 3)) for i in range(300) for _ in range(2)] + [("rare", 9000.0)] + [(f"k{i:03d}", 1.0) for i in range(5) for _ in range(9)]
    ds = Dataset("t", spark.createDataFrame(rows, "k string, v double"))
    d, m = Dimension("k", "k", 301), Measure("v", "v", "sum", True)
    kept = {x.value for x in segments.collect_segments(ds, [d], [m], most=5)["k"]}
    assert "rare" in kept and {f"k{i:03d}" for i in range(5)} <= kept and len(kept) <= 10
    sums: dict[str, float] = {}
    for k, v in rows:
        sums[k] = sums.get(k, 0.0) + v
    values = sorted(sums.values(), reverse=True)
    total, n, run = sum(values), len(values), 0.0
    got = segments.concentration_frame(segments.sums_by_segment(ds, d, m)).first().asDict()
    to_80 = next(i + 1 for i in range(n) if (run := run + values[i]) >= 0.8 * total)
    want = {"segments": n, "total": total, "top_share": sum(values[: -(-n // 10)]) / total, "hhi": sum((v / total) ** 2 for v in values), "gini": stats.gini(values), "to_80": to_80}
    assert got == {k: pytest.approx(v) for k, v in want.items()}
    same = spark.createDataFrame([(str(i), 2.0) for i in range(40)], "segment string, v double")
    even = segments.concentration_frame(same).first()
    assert (even["segments"], even["top_share"], even["to_80"]) == (40, pytest.approx(0.1), 32) and even["gini"] == pytest.approx(0)
    assert segments.concentration_frame(same.where("v > 5")).first()["segments"] == 0


def test_medians_and_equality(spark, tmp_path):
    """Grouped medians without a reducer that holds a group; equality on numbers reaches the scan."""
    import statistics

    from gleaner.model import Dimension, Filter, Measure, Metric, Query, SemanticModel
    from gleaner.plans.query import Plan

    rows = [(i % 3 if i % 7 else None, i * 37 % 101 / 4, i % 5) for i in range(400)] + [(9, None, 1)]
    spark.createDataFrame(rows, "g int, x double, k int").write.parquet(f"{tmp_path}/t")
    model = SemanticModel([Measure("x", "x", "avg", False), Measure("row_count", "*", "count")], [Dimension("g", "g", 4), Dimension("k", "k", 5)])
    ds = Dataset("t", spark.read.parquet(f"{tmp_path}/t"), model=model)
    plan = Plan(ds, Query([Metric("x", "median"), Metric("row_count")], ["g"]))
    got = {r[0]: (r[1], r[2]) for r in plan.frame.collect()}
    for g in (0, 1, 2, None):
        own = [x for a, x, _ in rows if a == g]
        assert got[str(g) if g is not None else "(empty)"] == (pytest.approx(statistics.median(own)), len(own))
    assert got["9"][0] is None and "percentile" not in plan.frame._jdf.queryExecution().toString()
    assert Plan(ds, Query([Metric("x", "median")])).frame.first()[0] == pytest.approx(statistics.median([x for _, x, _ in rows if x is not None]))
    for f, where in ((Filter("k", "eq", 3), "k = 3"), (Filter("k", "in", [1, "2"]), "k in (1, 2)"), (Filter("x", "eq", "2.5"), "x = 2.5"), (Filter("k", "eq", "3.0"), "false"), (Filter("k", "eq", "x"), "false")):
        plan = Plan(ds, Query([Metric("row_count")], [], None, [f]))
        assert sum(r[0] for r in plan.frame.collect()) == ds.df.where(where).count()
        if where not in ("false",):
            assert "PushedFilters: [" in (text := plan.frame._jdf.queryExecution().executedPlan().toString()) and "(k," in text + "(k," and ("EqualTo" in text or "In(" in text)


def test_lazy_queries_have_no_limit(spark):
    from gleaner.model import Metric, Query

    engine = Engine(spark)
    key = engine.add_frame(spark.range(6000).selectExpr("cast(id as string) as name", "1.5 as v"), "wide")
    model = engine.get_semantic_model(key)
    from gleaner.model import Dimension

    model.dimensions = [Dimension("name", "name", 6000)]
    assert engine.query_frame(key, Query([Metric("row_count")], ["name"])).count() == 6000
    assert engine.query_frame(key, Query([Metric("row_count")], ["name"], limit=7)).count() == 7 and engine.query_data(key, Query([Metric("row_count")], ["name"])).truncated


def test_rows_have_drivers(spark):
    """A segment that grows between the halves of the calendar moves the count of rows."""
    rows = [(f"2025-{1 + d // 28:02d}-{1 + d % 28:02d}", seg, 1.0 + (d * 7 + k) % 5) for d in range(112) for seg in ("a", "b", "c") for k in range(12 if seg == "a" and d >= 56 else 3)]
    ds, s = analysed(spark, spark.createDataFrame(rows, "day string, segment string, value double").selectExpr("to_date(day) as day", "segment", "value"))
    found = [x for x in s.insights if x.kind == "driver" and x.subjects[0] == "row_count"]
    assert found and found[0].subjects[2] == "a" and found[0].evidence.p_value < 0.01


def test_stride_sample(spark):
    df = spark.range(1000)
    assert segments.stride_sample(df, "id", 400).count() == 400 and segments.stride_sample(spark.range(10), "id", 400).count() == 10


def test_streaming_buckets(spark, tmp_path):
    from gleaner.streaming import buckets

    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(f"2025-01-0{d} {h:02d}:30:00", "a", 1.0 * d) for d in range(1, 6) for h in (1, 1, 5)], "ts string, k string, v double").selectExpr("to_timestamp(ts) as ts", "k", "v").write.parquet(src)
    stream = spark.readStream.schema("ts timestamp, k string, v double").parquet(src)
    q = buckets.write(buckets.bucketed(stream, "ts", "v", "day", "1 hour", ["k"]), out, str(tmp_path / "cp"), once=True)
    q.awaitTermination()
    rows = spark.read.parquet(out).orderBy("bucket").collect()
    assert [(r["rows"], r["total"]) for r in rows] == [(3, 3.0 * d) for d in range(1, 5)]
    months = buckets.rolled_up(spark.read.parquet(out), "month", ["k"]).collect()
    assert months[0]["rows"] == 12 and months[0]["mean"] == pytest.approx(2.5)
    with pytest.raises(ValueError):
        buckets.bucketed(stream, "ts", "v", "month")


def test_entry_without_corpus_operators(tmp_path):
    """The engine stands without the subpackage and the pipeline."""
    import os
    import shutil
    import subprocess
    import sys

    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(top, "gleaner"), tmp_path / "gleaner", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(top, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and len(q) > 50 and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
