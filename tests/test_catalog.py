import os
import re
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from tests.compare import differences, rows, same
from tidemark.operators import history, reports
from tidemark.plans import adapters, catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", catalog.QUERIES)
def test_query_equals_its_sql(spark, name):
    assert not differences(catalog.QUERIES[name](spark, SF), catalog.SQL[name], SF)


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.SQL)
    assert set(catalog.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_entry_without_the_training_data_operators(tmp_path):
    root = Path(entry.__file__).resolve().parent
    copy = tmp_path / "copy"
    shutil.copytree(root, copy, ignore=lambda folder, names: [n for n in names if n in (".git", "__pycache__") or n == "llm" and Path(folder).name in ("tidemark", "tests")])
    code = "import __spark_entry__ as e; from tidemark.plans import catalog; assert set(e.queries()) == set(catalog.QUERIES) == set(e.oracle_sql())"
    for _ in range(2):  # with the pipeline's module, then without
        subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env={**os.environ, "PYTHONPATH": str(copy)})
        (copy / "corpus_pipeline.py").unlink(missing_ok=True)


def test_approximate_counts(spark):
    g = adapters.golden(spark, SF)
    exact, near = ({r["category_title"]: r["hist_channels"] for r in history.engagement_history(reports.channel_engagement(g), exact=e).collect()} for e in (True, False))
    assert set(exact) == set(near) and all(abs(near[k] - n) <= 0.15 * n for k, n in exact.items())


def test_message_files_hold_their_texts_packed(spark, tmp_path):
    stream = catalog._messages(spark, str(tmp_path), SF, adapters.events, "timestamp long, source string, data struct<description string>")
    assert stream.isStreaming
    back = spark.read.parquet(f"{tmp_path}/in")
    size = sum(f.stat().st_size for f in (tmp_path / "in").glob("*.parquet"))
    assert back.count() == adapters.events(spark, SF).count() and size < back.selectExpr("sum(octet_length(value))").first()[0] / 2


def test_messages_of_one_text_lie_side_by_side(spark, tmp_path):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for limit in ("64m", "-1"):  # with the texts small enough to be broadcast, or not
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        try:
            catalog._messages(spark, f"{tmp_path}/{limit}", SF, adapters.events, "timestamp long")
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        files = list((tmp_path / limit / "in").glob("*.parquet"))
        rows = spark.read.parquet(f"{tmp_path}/{limit}/in").selectExpr("_metadata.file_name AS f", "get_json_object(value, '$.data.description') AS d").collect()
        runs = sum(i == 0 or r != rows[i - 1] for i, r in enumerate(rows))
        # copies of a text are texts of their own
        assert files and runs <= adapters.table(spark, SF, "documents").count() < len(rows)


@pytest.mark.parametrize("name", ["h2_category_benchmarks_merged", "h3_channel_intelligence_merged", "h4_tag_history_merged"])
def test_a_report_checked_for_its_ranks_is_worked_out_once(spark, name):
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "kll_merge" not in plan


def test_line_items_are_dealt_out_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(adapters, "TASK_ROWS", 500)
    g = adapters.golden(spark, SF)
    wide = -(-adapters.table(spark, SF, "lineitem").count() // 500)
    assert wide > 4 and f"hashpartitioning(l_orderkey" in g._jdf.queryExecution().toString() and f", {wide})" in g._jdf.queryExecution().toString()
    assert not differences(history.channel_history(g, "full"), catalog.SQL["h2_channel_history"], SF)


@pytest.mark.parametrize("name", ["s3_channel_anomaly", "s3_channel_viral", "s3_category_comparison"])
def test_channel_histories_of_streams_are_grouped_in_partitions_by_their_rows(spark, monkeypatch, name):
    plans, write = [], catalog.io.write
    monkeypatch.setattr(adapters, "TASK_ROWS", 500)
    monkeypatch.setattr(catalog.io, "write", lambda df, path, **k: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, path, **k))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert not differences(catalog.QUERIES[name](spark, SF), catalog.SQL[name], SF)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    wide = -(-adapters.table(spark, SF, "lineitem").count() // 500)
    dealt = [(set(re.findall(r"([a-z_]+)#", keys)), int(n)) for p in plans for keys, n in re.findall(r"hashpartitioning\((.*), (\d+)\)", p)]
    many = ({"l_partkey"}, {"p_partkey"}, {"l_orderkey"}, {"o_orderkey"}, {"o_custkey"}, {"c_custkey"}, {"channel_title", "trending_full_date"})
    assert all((keys, wide) in dealt for keys in many)
    assert all(n == wide for keys, n in dealt if keys in many or "trending_full_date" in keys)


def test_a_history_does_the_work_of_the_figures_asked_for_alone(spark):
    golden = adapters.golden(spark, SF).select("channel_title", "trending_full_date", "views", "likes", "comment_count")
    full = history.channel_intelligence(golden, "channel")
    for figures in (["batch_videos", "batch_avg_views", "batch_like_rate"], ["batch_trending_days"]):
        some = history.channel_intelligence(golden, "channel", figures)
        # means may differ in their last digits
        _, got = rows(some.columns, [tuple(r) for r in some.collect()])
        names, want = rows(some.columns, [tuple(r) for r in full.select(*some.columns).collect()])
        assert names == sorted(["channel_title", *figures]) and len(got) == len(want) and all(all(map(same, a, b)) for a, b in zip(got, want))


def test_title_strategy_makes_no_figures_that_it_does_not_read(spark, monkeypatch):
    plans, write = [], catalog.io.write
    monkeypatch.setattr(catalog.io, "write", lambda df, path, **k: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or write(df, path, **k))
    assert not differences(catalog.QUERIES["s4_title_strategy"](spark, SF), catalog.SQL["s4_title_strategy"], SF)
    assert len(plans) == 1 and "percentile_approx" not in plans[0] and plans[0].count("Aggregate ") == 1


@pytest.mark.parametrize("name", ["s2_category_performance", "s2_category_changes"])
def test_category_histories_store_the_rows_they_read_and_rank_nothing(spark, monkeypatch, name):
    written, write = {}, catalog.io.write

    def kept(df, path, **k):
        write(df, path, **k)
        written[Path(path).name] = (df._jdf.queryExecution().optimizedPlan().toString(), path)

    monkeypatch.setattr(catalog.io, "write", kept)
    assert not differences(catalog.QUERIES[name](spark, SF), catalog.SQL[name], SF)
    golden, path = written["golden"]
    rows, every = spark.read.parquet(path), adapters.golden(spark, SF)
    assert 0 < rows.count() == every.filter("assignable").count() < every.count() and rows.filter("assignable").count() == rows.count()
    # customers are filtered where they are read, so that orders of others don't move, and their segments don't either
    assert re.search(r"Filter .*c_mktsegment#\d+ = MACHINERY", golden) and not re.search(r"Project \[[^\n]*o_orderkey#\d+L[^\n]*c_mktsegment", golden)
    assert list(Path(path).glob("*.zstd.parquet")) and not any("Window" in written[h][0] for h in ("cats", "eng"))


def test_engagement_without_top_is_that_of_all_channels(spark):
    g = adapters.golden(spark, SF)
    ranked, plain = reports.channel_engagement(g, top=1_000_000_000).drop("rank_in_category"), reports.channel_engagement(g, top=None)
    _, got = rows(plain.columns, [tuple(r) for r in plain.collect()])
    _, want = rows(ranked.columns, [tuple(r) for r in ranked.collect()])
    assert plain.columns == ranked.columns and got == want
