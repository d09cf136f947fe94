"""The registered queries over the test tables, and the same in DuckDB SQL."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import cleaning, daily, history, reports, tags
from tidemark.plans import adapters
from tidemark.sources import ingest, io, versions
from tidemark.streaming import runner, seen, trends

DAY = "1 day"
#: How files of messages and of what is stored for several passes are packed.
PACKED = {"compression": "zstd"}


def _golden(f: Callable[[DataFrame], DataFrame], description: bool = False, by: tuple[str, ...] = ()) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(adapters.golden(spark, sf_dir, description, by))


def _kept(f: Callable[[DataFrame], DataFrame], *columns: str) -> Callable[[SparkSession, str], DataFrame]:
    """The same for reports that read the golden relation several times: the columns they need are worked out and stored once."""
    return lambda spark, sf_dir: f(_store(spark, adapters.golden(spark, sf_dir).select(*columns), scratch(spark)))


def _store(spark: SparkSession, df: DataFrame, folder: str) -> DataFrame:
    io.write(df, f"{folder}/golden", options=PACKED)
    return io.read(spark, f"{folder}/golden")


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors share."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        top = tempfile.mkdtemp(prefix="spark-")
    return f"{top.rstrip('/')}/stream-{uuid.uuid4().hex}"


#: The test messages lie in their files in no order of time, so that no row may count as late.
DELAY = "100 days"
#: Files of one micro-batch.
FILES = 16
#: Messages of one file, about.
FILE_ROWS = 200_000
#: Epochs of a state that are folded into a snapshot.
EPOCHS = 3


def _files(spark: SparkSession, sf_dir: str) -> int:
    """Files of the messages: as many as their number asks for."""
    return max(FILES, -(-adapters.table(spark, sf_dir, "events").count() // FILE_ROWS))


def _messages(spark: SparkSession, folder: str, *of) -> DataFrame:
    """Messages written as files, and the stream that reads them.

    ``of`` is their data, dealt out to as many files, and its schema; or, in
    place of the data, the tables' folder and the adapter that makes it. Messages
    repeat whole texts, so they are packed, with those of one text side by side.
    """
    *made, schema = of
    if len(made) == 2:
        sf_dir, make = made
        made = [make(spark, sf_dir, _files(spark, sf_dir))]
    io.to_envelope(*made, "test", "timestamp").write.options(**PACKED).parquet(f"{folder}/in")
    return io.read_stream(spark, "parquet", {"path": f"{folder}/in", "maxFilesPerTrigger": FILES}, schema)


def _streamed(prepare, finish, keys: list[str], past: dict | None = None, outputs: dict | None = None, details: bool = False, output: str | None = None, columns: tuple[str, ...] = (), by: tuple[str, ...] = (), where: str = "true") -> Callable[[SparkSession, str], DataFrame]:
    """A query that runs a stream to its end and makes its report from the last state of each key.

    ``prepare`` makes the streaming aggregate of the features; ``past``, from
    the golden relation, is worked out and stored once, before the stream
    starts; ``outputs`` (micro-batch, past) are written for each micro-batch,
    of which the first is the state; ``finish`` (state, past) is the report, of
    the state or of what still holds of another ``output``. ``columns`` of the
    golden relation are stored, where several passes of ``past`` read them, and
    of its rows those that all of these read (``where``); ``by`` are those that
    it is dealt out by.
    """

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        folder = scratch(spark)
        golden = adapters.golden(spark, sf_dir, by=by) if past else None
        if columns:
            golden = _store(spark, golden.filter(where).select(*columns), folder)
        kept = {}
        for name, make in (past or {}).items():
            io.write(make(golden), f"{folder}/{name}")
            kept[name] = io.read(spark, f"{folder}/{name}")
        if details:
            features = trends.details_features(_messages(spark, folder, adapters.details(spark, sf_dir, _files(spark, sf_dir)), trends.DETAILS))
        else:
            features = trends.trending_features(_messages(spark, folder, adapters.events(spark, sf_dir, _files(spark, sf_dir)), trends.MESSAGE))
        stream = prepare(features)
        written = {name: (lambda b, f=f: f(b, **kept)) for name, f in (outputs or {"state": lambda b, **_: b}).items()}
        first, f = next(iter(written.items()))
        runner.run(stream, written, f"{folder}/out", f"{folder}/checkpoint", compacted={first: keys}, epochs=EPOCHS).awaitTermination()
        none = history.empty_like(spark, stream.schema)
        if output:
            epochs = runner.last_epochs(spark, f"{folder}/out/{first}", keys, f(none).schema)
            rows = runner.current(spark, f"{folder}/out/{output}", keys, written[output](none).schema, epochs)
        else:
            rows = runner.state(spark, f"{folder}/out/{first}", keys, f(none).schema)
        return finish(rows, **kept)

    return query


def _start(df: DataFrame) -> DataFrame:
    return df.withColumn("start", F.unix_seconds("window.start")).drop("window")


def _cleaned(videos: DataFrame, categories: DataFrame) -> DataFrame:
    df = cleaning.clean_content(videos, categories)
    return df.select(
        "video_id", "video_title", "views", "dislikes", "category_id", "category_title", "assignable", F.array_join("tags_list", "|").alias("tags"), "comments_disabled", "trending_date_fixed", "trending_full_date", "trending_month",
        "trending_year", "publish_date", "publish_month", "publish_year", "region", "region_id",
    )


def t0_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cleaned(adapters.raw_videos(spark, sf_dir), adapters.raw_categories(spark, sf_dir))


def t1_ingest_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings and category documents as files by region, ingested, read from the raw zone and cleaned."""
    folder = scratch(spark)
    videos = adapters.raw_videos(spark, sf_dir).withColumn("file_region", F.col("region")).drop("region")
    io.write_parts(videos, f"{folder}/listings", "csv", ("file_region",), {"header": True, "escape": '"'})
    item = F.struct(F.col("category_id").alias("id"), F.struct("title", "assignable").alias("snippet"))
    docs = adapters.raw_categories(spark, sf_dir).groupBy(F.col("region").alias("file_region")).agg(F.to_json(F.struct(F.collect_list(item).alias("items"))).alias("value"))
    docs.write.partitionBy("file_region").text(f"{folder}/documents")
    of = {kind: [f"{folder}/{kind}/file_region={r}" for r in ("CA", "US")] for kind in ("listings", "documents")}
    # one region at first; the second load skips it
    for n in (1, 2):
        ingest.ingest_raw(spark, of["listings"][:n], of["documents"][:n], f"{folder}/raw", "parquet", region="file_region=([A-Z]{2})", of="file_path")
    return _cleaned(*(ingest.read_raw(spark, f"{folder}/raw", kind, "parquet") for kind in ("videos", "categories")))


def _gates() -> dict:
    """Conditions, and the rows that must meet each at least; no row meets the last."""
    return {"golden_rows": (F.lit(True), 1), "assignable_rows": (F.col("assignable"), 1), "impossible_rows": (F.col("views") < 0, 1)}


def dq_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.gates_of(adapters.golden(spark, sf_dir), _gates())


def dq_publish(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gates counted while versions are written, of which one passes and the next doesn't; and the rows of the version that counts, by region."""
    path = f"{scratch(spark)}/golden"
    golden = adapters.golden(spark, sf_dir).select("video_id", "views", "assignable", "region")
    tables = [f"{sf_dir}/{name}.parquet" for name in ("lineitem", "orders")]
    results = versions.publish(golden, path, {k: v for k, v in _gates().items() if k != "impossible_rows"}, tables, ("region",))
    try:
        versions.publish(golden.limit(0), path, _gates(), tables)
    except versions.GateError as e:
        results += [(f"second_{name}", value, passed) for name, value, passed in e.gates]
    by_region = versions.read(spark, path).groupBy(F.concat(F.lit("region_"), "region").alias("check_name")).agg(F.count("*").alias("value"))
    return spark.createDataFrame(results, "check_name string, value long, passed boolean").unionByName(by_region.withColumn("passed", F.lit(True)))


def st_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each message that the stream passes on, which is one for each video."""
    folder = scratch(spark)
    rows = _messages(spark, folder, adapters.events(spark, sf_dir, _files(spark, sf_dir)), trends.MESSAGE).select(F.col("data.videoId").alias("video_id"), "ts")
    with io.settings(spark, seen.ROCKSDB):
        stream = seen.unseen(rows, "video_id", DELAY, limit=1_000_000)
        query = runner.run(stream, {"out": lambda b: b}, folder, f"{folder}/checkpoint", mode="append")
        query.awaitTermination()
    return runner.appended(spark, f"{folder}/out", stream.schema).select("video_id")


def st_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages written as JSON envelopes and parsed again."""
    m = io.to_envelope(adapters.events(spark, sf_dir), "test", "timestamp").select(F.from_json("value", trends.MESSAGE).alias("m"))
    return m.groupBy("m.source", "m.data.type").agg(F.count("*").alias("n"), F.sum("m.timestamp").alias("seconds"), F.count_distinct("m.data.videoId").alias("videos"))


def _tops(golden: DataFrame) -> DataFrame:
    return history.top_channels(reports.channel_engagement(golden))


#: The events' categories as the history's, without their numbers' case and padding.
_S2_HISTORY = {
    "cats": lambda g: history.category_history(reports.daily_views(g), exact=True),
    "eng": lambda g: history.engagement_history(reports.channel_engagement(g, top=None), exact=True),
}


#: Figures from KLL and HyperLogLog sketches may be off by so much: some two of the published standard errors and more.
RANK_ERROR, COUNT_ERROR = 0.03, 0.05


def _kept_up(make, finish, of=lambda g: g, columns=("channel_title", "category_title", "region", "trending_full_date", "views", "likes", "comment_count")):
    """A history from a stored table: all months before that of the last order at first, then the others alone, as new days come in.

    ``make`` gives the figures of some of the rows, ``finish`` (store, rows) the
    report; ``of`` makes the rows from the golden relation, whose ``columns``
    are worked out and stored once, since each part and the check of errors reads them.
    """

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        folder = scratch(spark)
        path = f"{folder}/history"
        rows = of(_store(spark, adapters.golden(spark, sf_dir).select(*columns), folder))
        last = adapters.table(spark, sf_dir, "orders").agg(F.trunc(F.max("o_orderdate").cast("date"), "MM")).first()[0]
        for new in (F.col("trending_full_date") < F.lit(last), F.col("trending_full_date") >= F.lit(last)):
            daily.add(make(rows.filter(new)), path)
        return finish(daily.read(spark, path), rows)

    return query


def _with_rank_error(df: DataFrame, rows: DataFrame, keys: list[str], value: str, share: float) -> DataFrame:
    """df with a column that tells whether the quantile's rank is near enough, instead of the quantile; df is read twice and so stored."""
    df = _store(df.sparkSession, df, scratch(df.sparkSession))
    e = daily.rank_error(rows, keys, df, value, share).select(*[F.col(k).alias(f"_{k}") for k in keys], (F.col("rank_error") <= RANK_ERROR).alias(f"{value}_within"))
    return df.join(e, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]).drop(value, *[f"_{k}" for k in keys])


def _with_count_error(df: DataFrame, rows: DataFrame, keys: list[str], name: str, column: str) -> DataFrame:
    """df with a column that tells whether the estimate of different values is near enough, instead of the estimate."""
    n = rows.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.count_distinct(column).alias("_n"))
    near = F.abs(F.col(name) - F.col("_n")) <= F.ceil(F.col("_n") * COUNT_ERROR)
    return df.join(n, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]).withColumn(f"{name}_within", near).drop(name, "_n", *[f"_{k}" for k in keys])


_S1_KEYS = ["window", "channel_title", "popularity_tier", "description_category", "content_type"]


def _s1(finish, output: str | None = None):
    """Scored rows and, as in every micro-batch of the report, its anomalies in order."""
    return _streamed(
        lambda f: trends.dominance_agg(f, DAY, DELAY), lambda s, top: finish(s), _S1_KEYS, {"top": _tops},
        {"scored": lambda b, top: trends.dominance_score(b, top), "anomalies": lambda b, top: trends.dominance_anomalies(trends.dominance_score(b, top), keys=_S1_KEYS).orderBy(F.desc("anomaly_score"))}, output=output,
    )


def _s2(finish, output: str | None = None):
    return _streamed(
        lambda f: trends.category_agg(f, DAY, "12 hours", DELAY), lambda s, cats, eng: finish(s), ["window", "category"], _S2_HISTORY,
        {"compared": lambda b, cats, eng: trends.category_vs_history(b, cats, eng), "changes": lambda b, cats, eng: trends.category_compared(trends.category_vs_history(b, cats, eng), keys=["window"])}, details=True, output=output, columns=("category_title", "region", "channel_title", "trending_full_date", "comments_disabled", "assignable", "views", "likes", "dislikes", "comment_count"), where="assignable",
    )


#: Channel histories count days apart, so that their groups are nearly as many as their rows; without the day one channel would fill a task.
_DAYS = ("channel_title", "trending_full_date")


def _s3(finish):
    return _streamed(lambda f: trends.channel_agg(f, DAY, DELAY), lambda s, h: finish(trends.channel_anomaly(s, h)), ["window", "channel_title"], {"h": history.channel_history}, by=_DAYS)


_TAGGED_COLUMNS = ("category_title", "channel_title", "trending_full_date", "views", "likes", "comment_count", "tags_list")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "b1_daily_views": _golden(reports.daily_views),
    "b2_channel_engagement": _golden(reports.channel_engagement),
    "b3_fast_lasting": _golden(reports.fast_and_lasting),
    "b3_fast_lasting_as_coded": _golden(lambda g: reports.fast_and_lasting(g, share=0.3, as_coded=True)),
    "b4_common_problem": _golden(reports.common_problem),
    "b5_tag_rank": _golden(lambda g: tags.tag_rank(tags.tag_metrics(tags.tag_base(g)))),
    "b6_tag_power": _golden(lambda g: tags.tag_power(tags.tag_metrics(tags.tag_base(g)))),
    "b7_fast_channels": _golden(reports.fast_channels),
    "b8_description_thumbnail": _golden(reports.description_thumbnail, True),
    "b9_launch_timing": _golden(reports.launch_timing),
    "b10_mega_hits": _golden(reports.mega_hits),
    "tg_tag_base": _golden(tags.tag_base),
    "t0_clean": t0_clean,
    "t1_ingest_raw": t1_ingest_raw,
    "dq_gates": dq_gates,
    "dq_publish": dq_publish,
    "h1_regional_context": _golden(lambda g: history.regional_context(reports.daily_views(g))),
    "h1_category_history": _golden(lambda g: history.category_history(reports.daily_views(g), exact=True)),
    "h1_engagement_history": _golden(lambda g: history.engagement_history(reports.channel_engagement(g), exact=True)),
    "h2_channel_history": _golden(lambda g: history.channel_history(g, "full"), by=_DAYS),
    "h2_category_benchmarks": _kept(history.category_benchmarks, "category_title", "region", "views", "likes"),
    "h3_channel_intelligence": _golden(history.channel_intelligence),
    "h4_tag_history": _kept(tags.tag_history, *_TAGGED_COLUMNS),
    "h4_tag_pairs": _kept(tags.tag_pair_history, *_TAGGED_COLUMNS),
    "h1_category_history_merged": _kept_up(lambda g: daily.daily_partials(g, "month"), lambda d, g: _with_count_error(daily.category_history(d), g.filter("assignable"), ["category_title"], "hist_channels", "channel_title"), columns=("channel_title", "category_title", "region", "trending_full_date", "comments_disabled", "assignable", "views", "comment_count")),
    "h2_channel_history_merged": _kept_up(lambda g: daily.partials(g, daily.CHANNELS, "month"), lambda d, g: daily.channel_history(d)),
    "h2_category_benchmarks_merged": _kept_up(lambda g: daily.partials(g, daily.CHANNELS, "month"), lambda d, g: _with_rank_error(daily.category_benchmarks(d), g, ["category_title", "region"], "top_10_percent_threshold", 0.9)),
    "h3_channel_intelligence_merged": _kept_up(lambda g: daily.partials(g, daily.CHANNELS, "month"), lambda d, g: _with_rank_error(daily.channel_intelligence(d), g, list(daily.CHANNELS.keys), "batch_p75_views", 0.75)),
    "h4_tag_history_merged": _kept_up(
        lambda t: daily.partials(t, daily.TAGS, "month"),
        lambda d, t: _with_count_error(_with_rank_error(daily.tag_history(d), t, list(daily.TAGS.keys), "p90_views", 0.9), t, list(daily.TAGS.keys), "unique_channels", "channel_title"), daily.tag_rows, _TAGGED_COLUMNS,
    ),
    "s1_dominance": _s1(lambda s: _s1_rows(s)),
    "s1_anomalies": _s1(lambda s: s.drop("window", "description_category", "content_type"), "anomalies"),
    "s2_category_performance": _s2(lambda s: trends.category_all(s).drop("current_unique_channels")),
    "s2_category_changes": _s2(lambda s: s.drop("window"), "changes"),
    "s3_channel_anomaly": _s3(lambda s: _start(s).select("start", "channel_title", "current_trending_videos", "current_avg_views", "hist_avg_views", "top_tier", F.round("anomaly", 2).alias("anomaly_x"), "performance_vs_history", "growth_indicator", "channel_tier")),
    "s3_channel_viral": _s3(lambda s: trends.channel_viral(s)),
    "s3_category_comparison": _streamed(
        lambda f: trends.channel_views(f, DAY, None, DELAY),
        lambda s, c, m: trends.windows_by_category(s, c, m).select("category_title", "region", "streaming_channels", F.round("category_stream_avg", 2).alias("category_stream_avg"), "category_avg_views", "category_performance_vs_batch"),
        ["window", "channel_title"], {"c": lambda g: history.channel_history(adapters.dealt(g, *_DAYS), "full"), "m": history.category_benchmarks}, columns=("channel_title", "category_title", "region", "trending_full_date", "views", "likes", "comment_count"),
    ),
    "s4_title_strategy": _streamed(
        lambda f: trends.title_agg(trends.title_features(f), DAY, DELAY),
        lambda s, h: _start(trends.title_vs_history(s, h)).select("start", "channel_title", "video_count", "avg_views", "avg_title_length", "avg_word_count", "avg_emotional_score", "avg_optimization_score", "numbers_avg_views", "viral_keywords_avg_views", "question_avg_views", "title_strategy_grade", F.round("viral_potential_score", 4).alias("viral_potential_score"), "batch_avg_views", "batch_videos", "performance_trend", "strategy_effectiveness", "improvement_vs_batch"),
        ["window", "channel_title"], {"h": lambda g: history.channel_intelligence(g, "channel", ("batch_videos", "batch_avg_views", "batch_like_rate"))},
    ),
    "s5_tag_momentum": _streamed(
        lambda f: trends.tag_channels(trends.tag_features(f), DAY, DELAY),
        lambda s, h: _start(trends.momentum_vs_history(trends.momentum_of(s), h)).select("start", "current_tag", "current_usage", "current_avg_views", "current_total_views", "channels_using_tag", F.round("tag_momentum_score", 4).alias("tag_momentum_score"), "change_pct", "trend_status"),
        ["window", "current_tag", "channel_title"], {"h": tags.tag_averages},
    ),
    "s5_tag_combinations": _streamed(lambda f: trends.tag_combinations(trends.tag_features(f), size=DAY, watermark=DELAY), _start, ["window", "tag_combo"]),
    "s5_channel_tagging": _streamed(lambda f: trends.channel_tagging(trends.tag_features(f), DAY, DELAY), _start, ["window", "channel_title"]),
    "st_dedup": st_dedup,
    "st_envelope": st_envelope,
}


def _s1_rows(s: DataFrame) -> DataFrame:
    keys = ("popularity_tier", "description_category", "content_type")
    return s.select(
        F.unix_seconds("window.start").alias("start"), "channel_title", *keys, F.when(F.col("established"), "ESTABLISHED").otherwise("EMERGING").alias("status"), "trending_videos_count", F.round("avg_views_per_video", 0).alias("avg_views"),
        F.round("anomaly", 2).alias("viral_score"), F.round("velocity", 2).alias("velocity"), F.round("consistency", 2).alias("consistency"), F.round("score", 1).alias("intelligent_score"),
    )


def _g(body: str, *more: str) -> str:
    return "WITH " + ", ".join([adapters.GOLDEN_SQL, *more]) + body


def _e(body: str, *more: str) -> str:
    return "WITH " + ", ".join([adapters.GOLDEN_SQL, adapters.EVENTS_SQL, *more]) + body


_DAILY = """daily AS (
    SELECT category_title, region, trending_full_date, comments_disabled, count(*) AS video_count, round(avg(views), 2) AS avg_views, round(avg(comment_count), 2) AS avg_comments
    FROM golden WHERE assignable GROUP BY ALL
), b1 AS (
    SELECT *, rank() OVER (PARTITION BY category_title, region ORDER BY avg_views DESC) AS views_rank,
        round(avg(avg_views) OVER (PARTITION BY category_title, region, comments_disabled ORDER BY trending_full_date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS moving_avg_views_3d
    FROM daily
)"""
_ENGAGEMENT = """eng AS (
    SELECT category_title, channel_title, count(*) AS total_videos, CAST(sum(likes) AS BIGINT) AS total_likes, CAST(sum(dislikes) AS BIGINT) AS total_dislikes, CAST(sum(comment_count) AS BIGINT) AS total_comments,
        CAST(sum(likes + comment_count) AS BIGINT) AS engagement_score, round(sum(likes + comment_count) / count(*), 2) AS avg_engagement_per_video,
        round(sum(likes) / nullif(sum(dislikes), 0), 2) AS like_dislike_ratio
    FROM golden WHERE assignable GROUP BY ALL
), ranked AS (SELECT *, rank() OVER (PARTITION BY category_title ORDER BY engagement_score DESC) AS rank_in_category FROM eng
), b2 AS (SELECT * FROM ranked WHERE rank_in_category <= 5)"""
_B3 = """v AS (
    SELECT category_title AS category, region, publish_date, video_id, date_diff('day', publish_date, min(trending_full_date)) AS days, count(DISTINCT trending_full_date) AS lasted
    FROM golden GROUP BY category_title, region, publish_date, video_id
), m AS (SELECT category, region, round(avg(days), 2) AS avg_days_to_trend, round(avg(lasted), 2) AS avg_trend_days FROM v GROUP BY ALL
), r AS (
    SELECT *, percent_rank() OVER (PARTITION BY category ORDER BY avg_days_to_trend) AS fast, percent_rank() OVER (PARTITION BY category ORDER BY avg_trend_days DESC) AS long FROM m
)"""
_B3_OUT = " SELECT category, region, avg_days_to_trend, avg_trend_days, round(fast * 100, 2) AS pct_rank_fastest, round(long * 100, 2) AS pct_rank_longest FROM r WHERE "
_TAGS = """raw_tags AS (SELECT video_id, likes, views, comment_count, category_title, region, lower(trim(unnest(tags_list))) AS tag FROM golden
), tg AS (SELECT * FROM raw_tags WHERE length(tag) > 2 AND tag NOT IN ('uncategorized', 'no-tags', 'unknown')
), tm AS (
    SELECT tag, count(*) AS video_count, count(DISTINCT region) AS regions_count, count(DISTINCT category_title) AS categories_count, round(avg(likes), 0) AS avg_likes, round(avg(views), 0) AS avg_views,
        round(count_if(likes > 100000) * 100.0::DOUBLE / count(*), 2) AS viral_success_rate, count(*) * 0.3::DOUBLE + avg(likes) * 0.0001::DOUBLE + count_if(likes > 100000) * 50 AS viral_score
    FROM tg GROUP BY tag HAVING count(*) >= 10
), ts AS (SELECT * FROM tm WHERE viral_score > 100)"""
_FIGURES = """count(*) AS usage_count, avg(views) AS avg_views, avg(likes) AS avg_likes, avg(likes::DOUBLE / views) AS avg_like_rate, avg(comment_count::DOUBLE / views) AS avg_comment_rate,
    quantile_disc(views, 0.9) AS p90_views, count(DISTINCT channel_title) AS unique_channels, count(DISTINCT trending_full_date) AS trending_days"""
_LEVEL = "CASE WHEN viral_success_rate > 50 AND video_count > 50 THEN '{}' WHEN viral_success_rate > 30 AND avg_likes > 500000 THEN '{}' WHEN video_count > 100 AND avg_likes > 100000 THEN '{}' WHEN viral_success_rate > 20 THEN '{}' ELSE '{}' END"
_TIER = "CASE WHEN avg(views) >= 10000000 THEN 'Mega Channel' WHEN avg(views) >= 1000000 THEN 'Popular Channel' WHEN avg(views) >= 100000 THEN 'Growing Channel' ELSE 'Small Channel' END"
_TAG_LIST = "[x FOR x IN [" + ", ".join(f"CASE WHEN regexp_matches(lower(title), '({'|'.join(words)})') THEN '{label}' END" for label, words in trends.LEXICON.items()) + "] IF x IS NOT NULL]"
_TAGGED = f"tagged AS (SELECT *, {_TAG_LIST} AS tags FROM features)"

_S1 = """, top AS (SELECT channel_title, min(rank_in_category) AS r FROM b2 GROUP BY channel_title
), a AS (
    SELECT day AS start, channel_title, popularity_tier, description_category, content_type, count(*) AS n, avg(views) AS mean, stddev_samp(views) AS sd, avg(duration_seconds) AS dur FROM features GROUP BY ALL
), s AS (
    SELECT a.*, r, CASE WHEN popularity_tier = 'Viral (1M+)' AND r IS NULL THEN mean / 1000000 ELSE 0 END AS anomaly, n / greatest(dur / 60, 1) AS velocity, coalesce(1 / (1 + sd / mean), 1) AS consistency FROM a LEFT JOIN top USING (channel_title)
)"""
_S2 = """, hc AS (SELECT upper(trim(category_title)) AS key, CAST(sum(video_count) AS BIGINT) AS hist_videos, avg(avg_views) AS hist_avg_views FROM b1 GROUP BY ALL
), he AS (SELECT upper(trim(category_title)) AS key, avg(avg_engagement_per_video) AS hist_eng, count(DISTINCT channel_title) AS hist_channels FROM eng GROUP BY ALL
), w AS (SELECT *, t // 43200 * 43200 - 43200 * unnest([0, 1]) AS start FROM features
), a AS (SELECT start, category, count(*) AS n, CAST(sum(views) AS BIGINT) AS total, avg(views) AS mean, CAST(sum(likes) AS BIGINT) AS likes FROM w GROUP BY ALL
), c AS (
    SELECT a.*, hist_videos, hist_channels, hist_avg_views, hist_eng, round(likes / greatest(total, 1) * 100, 2) AS curr_eng_pct, round(likes / greatest(n, 1), 2) AS per_video
    FROM a LEFT JOIN hc ON hc.key = upper(trim(category)) LEFT JOIN he ON he.key = upper(trim(category))
), d AS (SELECT *, CASE WHEN hist_avg_views > 0 THEN round((mean - hist_avg_views) * 100.0::DOUBLE / hist_avg_views, 2) END AS v, CASE WHEN hist_eng > 0 THEN round((per_video - hist_eng) * 100.0::DOUBLE / hist_eng, 2) END AS e FROM c)"""
_S3 = f""", h AS (SELECT channel_title, avg(views) AS hist_avg_views, {_TIER} AS channel_tier FROM golden GROUP BY channel_title
), a AS (SELECT day AS start, channel_title, count(*) AS current_trending_videos, avg(views) AS current_avg_views, arg_max(popularity_tier, views) AS top_tier FROM features GROUP BY ALL
), j AS (SELECT a.*, hist_avg_views, channel_tier, coalesce(current_avg_views / hist_avg_views, 0) AS x FROM a LEFT JOIN h USING (channel_title))"""
_GROWTH = "CASE WHEN x >= 3 THEN 'VIRAL EXPLOSION' WHEN x >= 2 THEN 'Strong Growth' WHEN x >= 1.5::DOUBLE THEN 'Moderate Growth' WHEN x >= 0.8::DOUBLE THEN 'Stable' ELSE 'Declining' END"

SQL: dict[str, str] = {
    "b1_daily_views": _g(" SELECT * FROM b1", _DAILY),
    "b2_channel_engagement": _g(" SELECT * FROM b2", _ENGAGEMENT),
    "b3_fast_lasting": _g(_B3_OUT + "fast <= 0.10 AND long <= 0.10", _B3),
    "b3_fast_lasting_as_coded": _g(_B3_OUT + "fast <= 0.3 AND long >= 1 - 0.3::DOUBLE", _B3),
    "b4_common_problem": _g(
        """, p AS (
    SELECT category_title, region, CASE WHEN video_error_or_removed THEN 'Removed' WHEN comments_disabled AND ratings_disabled THEN 'All Interactions Disabled'
        WHEN comments_disabled THEN 'Comments Disabled Only' WHEN ratings_disabled THEN 'Ratings Disabled Only' ELSE 'No Issue' END AS problem_type, count(video_id) AS num_videos
    FROM golden GROUP BY ALL
), s AS (SELECT *, round(num_videos::DOUBLE / sum(num_videos) OVER (PARTITION BY category_title, region) * 100, 1) AS pct FROM p WHERE problem_type <> 'No Issue'
), r AS (SELECT *, row_number() OVER (PARTITION BY category_title, region ORDER BY pct DESC, problem_type) AS n FROM s)
SELECT category_title, region, problem_type, num_videos, CAST(pct AS VARCHAR) || '%' AS pct_of_local FROM r WHERE n = 1"""
    ),
    "b5_tag_rank": _g(
        """, t AS (SELECT tag, video_count, avg_likes, viral_success_rate, regions_count, categories_count, round(viral_score, 0) AS viral_score FROM ts ORDER BY viral_score DESC, tag LIMIT 30)
SELECT *, row_number() OVER (ORDER BY viral_score DESC, tag) AS overall_rank FROM t""",
        _TAGS,
    ),
    "b6_tag_power": _g(
        f""", l AS (
    SELECT *, {_LEVEL.format("MAGIC", "POWERFUL", "RELIABLE", "PROMISING", "AVERAGE")} AS tag_power_level, {_LEVEL.format("MUST USE", "HIGHLY RECOMMENDED", "SAFE CHOICE", "EMERGING", "CONSIDER")} AS recommendation,
        CASE WHEN viral_success_rate > 90 THEN 'TOP FREQUENCY' WHEN avg_likes > 1000000 THEN 'TOP PERFORMANCE' WHEN viral_success_rate > 40 THEN 'HIGH SUCCESS' ELSE 'GOOD' END AS tip_taga
    FROM ts
), w AS (
    SELECT *, rank() OVER (PARTITION BY tag_power_level ORDER BY viral_score DESC) AS rank_within_power_level, percent_rank() OVER (PARTITION BY tag_power_level ORDER BY viral_success_rate) AS pct,
        round(avg(viral_score) OVER (PARTITION BY tag_power_level ORDER BY viral_score DESC, tag ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 0) AS smoothed_viral_score
    FROM l
), t AS (
    SELECT tag, regions_count AS active_regions, categories_count, tag_power_level, tip_taga, recommendation, viral_success_rate, avg_likes, round(viral_score, 0) AS viral_score, rank_within_power_level,
        round(pct * 100, 1) AS success_percentile, CASE WHEN pct >= 0.9 THEN 'TOP 10%' WHEN pct >= 0.75 THEN 'TOP 25%' WHEN pct >= 0.5 THEN 'TOP 50%' ELSE 'STANDARD' END AS market_position, smoothed_viral_score
    FROM w ORDER BY round(w.viral_score, 0) DESC, tag LIMIT 30
)
SELECT *, row_number() OVER (ORDER BY viral_score DESC, tag) AS global_rank FROM t""",
        _TAGS,
    ),
    "b7_fast_channels": _g(
        """, d AS (
    SELECT *, date_diff('day', publish_date, trending_full_date) AS days FROM golden
), t AS (
    SELECT *, avg(views) OVER (PARTITION BY channel_title ORDER BY trending_full_date, video_id, views ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS momentum FROM d WHERE days >= 0
)
SELECT channel_title, category_title, count(*) AS total_viral_videos, round(avg(days), 1) AS avg_days_to_viral, round(avg(momentum), 0) AS avg_momentum, round(count_if(days <= 3) * 100.0::DOUBLE / count(*), 1) AS fast_viral_percentage
FROM t WHERE days <= 30 GROUP BY ALL HAVING count(*) >= 5 ORDER BY fast_viral_percentage DESC, avg_momentum DESC, channel_title, category_title LIMIT 20"""
    ),
    "b8_description_thumbnail": _g(
        """, c AS (
    SELECT category_title, views, likes,
        CASE WHEN length(text) = 0 THEN 'No Description' WHEN length(text) < 100 THEN 'Very Short' WHEN length(text) < 300 THEN 'Short' WHEN length(text) < 1000 THEN 'Medium' WHEN length(text) < 2000 THEN 'Long' ELSE 'Very Long' END AS description_length_category,
        CASE WHEN contains(thumbnail_link, 'maxresdefault') THEN 'High Quality' WHEN contains(thumbnail_link, 'hqdefault') THEN 'Medium Quality' ELSE 'Standard Quality' END AS thumbnail_quality
    FROM golden JOIN documents ON doc_key = doc_id WHERE assignable
), a AS (
    SELECT category_title, description_length_category, thumbnail_quality, count(*) AS video_count, round(avg(views), 0) AS avg_views, round(avg(likes), 0) AS avg_likes FROM c GROUP BY ALL HAVING count(*) >= 10
)
SELECT *, rank() OVER (PARTITION BY category_title ORDER BY avg_views DESC) AS performance_rank, percent_rank() OVER (PARTITION BY category_title ORDER BY avg_views) AS performance_percentile FROM a"""
    ),
    "b9_launch_timing": _g(
        """, m AS (
    SELECT category_title, region, trending_month, trending_year, count(*) AS n, avg(views) AS avg_views FROM golden WHERE assignable GROUP BY ALL
), s AS (
    SELECT *, lag(avg_views) OVER w AS before, avg(n) OVER (PARTITION BY category_title, region ORDER BY trending_year, trending_month ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS trend
    FROM m WINDOW w AS (PARTITION BY category_title, region ORDER BY trending_year, trending_month)
), u AS (SELECT *, avg(trend) OVER (PARTITION BY category_title, region) AS usual FROM s
), a AS (
    SELECT category_title, region, trending_month, usual, round(avg(trend), 1) AS trend_strength, coalesce(CASE WHEN avg(before) > 0 THEN round((avg(avg_views) - avg(before)) * 100.0::DOUBLE / avg(before), 1) END, 0.0::DOUBLE) AS mom_growth_pct, sum(n) AS videos
    FROM u GROUP BY ALL HAVING sum(n) >= 15
)
SELECT category_title, region, trending_month, trend_strength, mom_growth_pct, CASE WHEN trend_strength > usual * 1.2::DOUBLE THEN 'OPTIMAL LAUNCH TIME' WHEN trend_strength > usual THEN 'GOOD TIME' ELSE 'AVOID' END AS launch_recommendation,
    CASE WHEN videos >= 50 THEN 'HIGH CONFIDENCE' WHEN videos >= 20 THEN 'MEDIUM CONFIDENCE' WHEN videos >= 10 THEN 'LOW CONFIDENCE' ELSE 'VERY LOW CONFIDENCE' END AS data_confidence,
    rank() OVER (PARTITION BY category_title, region ORDER BY trend_strength DESC) AS month_rank
FROM a"""
    ),
    "b10_mega_hits": _g(
        """, r AS (
    SELECT *, row_number() OVER (PARTITION BY channel_title ORDER BY views DESC, video_title DESC, region DESC, category_title DESC) AS n, avg(views) OVER (PARTITION BY channel_title) AS mean FROM golden
)
SELECT channel_title, video_title AS top_video, category_title AS top_video_category, views AS max_views, region AS top_region, publish_year, round(mean, 0) AS avg_views_per_channel FROM r WHERE n = 1 AND views >= 100000000"""
    ),
    "tg_tag_base": _g(" SELECT * FROM tg", _TAGS),
    "t0_clean": """
WITH raw AS (
    SELECT 'v' || l_orderkey || '-' || l_linenumber AS video_id, CAST(l_shipdate AS DATE) AS shipped, l_linenumber AS n, l_orderkey AS key, CAST(l_suppkey % 5 AS INTEGER) AS category_id,
        CASE WHEN l_orderkey % 11 = 0 THEN NULL WHEN l_orderkey % 7 = 0 THEN 'é ' || repeat(p_name, 9) ELSE p_name || '   ok' END AS title,
        CASE WHEN l_orderkey % 13 = 0 THEN NULL ELSE CAST(floor(l_extendedprice) AS BIGINT) END AS views, CASE WHEN l_linenumber % 2 = 1 THEN 'US' ELSE 'CA' END AS region
    FROM lineitem JOIN part ON l_partkey = p_partkey
), titled AS (SELECT *, trim(regexp_replace(title, '[^\\x20-\\x7E]', '', 'g')) AS t FROM raw)
SELECT video_id, regexp_replace(CASE WHEN length(t) > 100 THEN substring(t, 1, 97) || '...' ELSE t END, '\\s+', ' ', 'g') AS video_title, views, CAST(NULL AS BIGINT) AS dislikes, category_id, n_name AS category_title, n_nationkey % 2 = 0 AS assignable,
    CASE n WHEN 1 THEN 'uncategorized' WHEN 2 THEN 'a|b' WHEN 3 THEN 'unknown' WHEN 4 THEN 'one' ELSE 'uncategorized' END AS tags, n = 1 AS comments_disabled,
    strftime(shipped, '%d.%m.%y') AS trending_date_fixed, shipped AS trending_full_date,
    (['Januar', 'Februar', 'Mart', 'April', 'Maj', 'Jun', 'Jul', 'Avgust', 'Septembar', 'Oktobar', 'Novembar', 'Decembar'])[month(shipped)] AS trending_month,
    CAST(year(shipped) AS INTEGER) AS trending_year, DATE '2017-11-13' AS publish_date, 11 AS publish_month, 2017 AS publish_year, region, CASE region WHEN 'CA' THEN 1 ELSE 10 END AS region_id
FROM titled LEFT JOIN nation ON n_nationkey = category_id AND n_nationkey < 4 WHERE t IS NOT NULL AND views > 0""".replace("shipped AS trending_full_date", "CASE WHEN year(shipped) < 2000 THEN shipped + INTERVAL 100 YEAR ELSE shipped END::DATE AS trending_full_date").replace("CAST(year(shipped) AS INTEGER)", "CAST(year(shipped) + CASE WHEN year(shipped) < 2000 THEN 100 ELSE 0 END AS INTEGER)"),
    "dq_gates": _g(
        """ SELECT 'golden_rows' AS check_name, count(*) AS value, count(*) >= 1 AS passed FROM golden
UNION ALL SELECT 'assignable_rows', count(*), count(*) >= 1 FROM golden WHERE assignable UNION ALL SELECT 'impossible_rows', count(*), count(*) >= 1 FROM golden WHERE views < 0"""
    ),
    "dq_publish": _g(
        """ SELECT 'golden_rows' AS check_name, count(*) AS value, true AS passed FROM golden
UNION ALL SELECT 'assignable_rows', count(*), true FROM golden WHERE assignable
UNION ALL SELECT 'second_' || c, 0, false FROM (VALUES ('golden_rows'), ('assignable_rows'), ('impossible_rows')) t(c)
UNION ALL SELECT 'region_' || region, count(*), true FROM golden GROUP BY region"""
    ),
    "h1_regional_context": _g(" SELECT category_title, region, avg(avg_views) AS hist_avg_views, avg(avg_comments) AS hist_avg_comments, avg(moving_avg_views_3d) AS hist_trend FROM b1 GROUP BY ALL", _DAILY),
    "h1_category_history": _g(" SELECT category_title, CAST(sum(video_count) AS BIGINT) AS hist_videos, avg(avg_views) AS hist_avg_views, count(DISTINCT region) AS hist_regions FROM b1 GROUP BY ALL", _DAILY),
    "h1_engagement_history": _g(" SELECT category_title, CAST(sum(engagement_score) AS BIGINT) AS hist_engagement, avg(avg_engagement_per_video) AS hist_avg_engagement, count(DISTINCT channel_title) AS hist_channels FROM b2 GROUP BY ALL", _ENGAGEMENT),
    "h2_channel_history": _g(
        f""" SELECT channel_title, category_title, region, count(*) AS hist_videos, avg(views) AS hist_avg_views, max(views) AS hist_max_views, avg(likes) AS hist_avg_likes, avg(comment_count) AS hist_avg_comments, stddev_samp(views) AS hist_stddev_views,
    count(DISTINCT trending_full_date) AS trending_days, avg(likes) / avg(views) * 100 AS like_rate, avg(comment_count) / avg(views) * 100 AS comment_rate, {_TIER} AS channel_tier FROM golden GROUP BY channel_title, category_title, region"""
    ),
    "h2_category_benchmarks": _g(" SELECT category_title, region, avg(views) AS category_avg_views, quantile_disc(views, 0.9) AS top_10_percent_threshold, count(*) AS category_videos, avg(likes) AS category_avg_likes FROM golden GROUP BY ALL"),
    "h3_channel_intelligence": _g(
        """ SELECT category_title, region, channel_title, count(*) AS batch_videos, avg(views) AS batch_avg_views, CAST(sum(views) AS BIGINT) AS batch_total_views, max(views) AS batch_max_views, quantile_disc(views, 0.75) AS batch_p75_views, avg(likes) AS batch_avg_likes,
    avg(comment_count) AS batch_avg_comments, avg(likes::DOUBLE / views) AS batch_like_rate, avg(comment_count::DOUBLE / views) AS batch_comment_rate, count(DISTINCT trending_full_date) AS batch_trending_days FROM golden GROUP BY ALL"""
    ),
    "h4_tag_history": _g(f", x AS (SELECT *, unnest(tags_list) AS tag FROM golden) SELECT tag, category_title, {_FIGURES} FROM x WHERE tag NOT IN ('uncategorized', 'no-tags', 'unknown') GROUP BY tag, category_title HAVING count(*) >= 10"),
    "h4_tag_pairs": _g(
        f""", i AS (SELECT *, unnest(range(1, len(tags_list))) AS k FROM golden), x AS (SELECT *, tags_list[k] AS tag1, tags_list[k + 1] AS tag2 FROM i)
SELECT tag1, tag2, category_title, {_FIGURES} FROM x WHERE tag1 NOT IN ('uncategorized', 'no-tags', 'unknown') AND tag2 NOT IN ('uncategorized', 'no-tags', 'unknown') GROUP BY tag1, tag2, category_title HAVING count(*) >= 5"""
    ),
    "s1_dominance": _e(
        _S1
        + """
SELECT start, channel_title, popularity_tier, description_category, content_type, CASE WHEN r IS NOT NULL THEN 'ESTABLISHED' ELSE 'EMERGING' END AS status, n AS trending_videos_count, CAST(round(CAST(mean AS DECIMAL(38, 12)), 0) AS DOUBLE) AS avg_views, CAST(round(CAST(anomaly AS DECIMAL(38, 12)), 2) AS DOUBLE) AS viral_score,
    CAST(round(CAST(velocity AS DECIMAL(38, 12)), 2) AS DOUBLE) AS velocity, CAST(round(CAST(consistency AS DECIMAL(38, 12)), 2) AS DOUBLE) AS consistency,
    CAST(round(CAST(n * log10(greatest(mean, 1)) * (1 + anomaly * 0.5::DOUBLE) * (1 + velocity * 0.3::DOUBLE) * consistency * CASE WHEN r <= 2 THEN 1.2::DOUBLE WHEN r <= 5 THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END AS DECIMAL(38, 12)), 1) AS DOUBLE) AS intelligent_score
FROM s""",
        _ENGAGEMENT,
    ),
    "s1_anomalies": _e(
        _S1
        + """
SELECT channel_title, n AS trending_videos_count, CAST(round(CAST(mean AS DECIMAL(38, 12)), 0) AS DOUBLE) AS avg_views, CAST(round(CAST(anomaly AS DECIMAL(38, 12)), 2) AS DOUBLE) AS anomaly_score, popularity_tier FROM s WHERE anomaly > 0.5""",
        _ENGAGEMENT,
    ),
    "s2_category_performance": _e(
        _S2
        + """
SELECT start, category, n AS current_videos_count, coalesce(hist_videos, 0) AS hist_videos, coalesce(hist_channels, 0) AS hist_channels, total AS current_views, round(mean, 0) AS current_avg, round(coalesce(hist_avg_views, 0), 0) AS hist_avg,
    v AS views_change_pct, curr_eng_pct, coalesce(hist_eng, 0) AS hist_eng, e AS eng_change_pct,
    CASE WHEN v > 25 THEN 'HOT_CATEGORY' WHEN v > 0 THEN 'GROWING_CATEGORY' WHEN v > -25 THEN 'STABLE_CATEGORY' WHEN v IS NOT NULL THEN 'DECLINING_CATEGORY' ELSE 'NEW_CATEGORY' END AS category_trend_indicator,
    CASE WHEN total > 10000000 THEN 'DOMINANT' WHEN total > 5000000 THEN 'STRONG' WHEN total > 1000000 THEN 'MODERATE' ELSE 'EMERGING' END AS market_position
FROM d""",
        _DAILY,
        _ENGAGEMENT,
    ),
    "s2_category_changes": _e(
        _S2
        + """
SELECT category, v AS views_change_pct, e AS eng_change_pct, total AS current_total_views,
    CASE WHEN v > 25 THEN 'HOT_CATEGORY' WHEN v > 0 THEN 'GROWING_CATEGORY' WHEN v > -25 THEN 'STABLE_CATEGORY' WHEN v IS NOT NULL THEN 'DECLINING_CATEGORY' ELSE 'NEW_CATEGORY' END AS category_trend_indicator
FROM d WHERE hist_avg_views IS NOT NULL""",
        _DAILY,
        _ENGAGEMENT,
    ),
    "s3_channel_anomaly": _e(
        _S3
        + f"""
SELECT start, channel_title, current_trending_videos, current_avg_views, hist_avg_views, top_tier, round(x, 2) AS anomaly_x,
    CASE WHEN hist_avg_views IS NULL THEN 'New Channel' WHEN current_avg_views > hist_avg_views * 2 THEN 'Breakout Performance' WHEN current_avg_views > hist_avg_views * 1.5::DOUBLE THEN 'Above Average' WHEN current_avg_views > hist_avg_views * 0.8::DOUBLE THEN 'Normal Range' ELSE 'Below Average' END AS performance_vs_history,
    {_GROWTH} AS growth_indicator, channel_tier
FROM j"""
    ),
    "s3_channel_viral": _e(
        _S3
        + f"""
SELECT channel_title, current_trending_videos, format('{{:,}}', CAST(round_even(current_avg_views, 0) AS BIGINT)) AS current_views, format('{{:,}}', CAST(round_even(hist_avg_views, 0) AS BIGINT)) AS hist_avg_views,
    round(x, 1) AS viral_multiplier, {_GROWTH} AS growth_indicator, coalesce(channel_tier, 'New Channel') AS tier FROM j WHERE x >= 1.5::DOUBLE"""
    ),
    "s3_category_comparison": _e(
        """, w AS (SELECT day, channel_title, avg(views) AS mean FROM features GROUP BY ALL
), c AS (SELECT DISTINCT channel_title, category_title FROM golden
), a AS (SELECT category_title, count(*) AS streaming_channels, avg(mean) AS m FROM w JOIN c USING (channel_title) GROUP BY ALL
), b AS (SELECT category_title, region, avg(views) AS category_avg_views FROM golden GROUP BY ALL)
SELECT category_title, region, streaming_channels, round(m, 2) AS category_stream_avg, category_avg_views,
    CASE WHEN category_avg_views IS NULL THEN 'No Historical Data' WHEN m > category_avg_views * 1.3::DOUBLE THEN 'Outperforming' WHEN m > category_avg_views * 0.8::DOUBLE THEN 'Normal' ELSE 'Underperforming' END AS category_performance_vs_batch
FROM a LEFT JOIN b USING (category_title)"""
    ),
    "s4_title_strategy": _e(
        f""", f AS (
    SELECT *, length(title) AS len, len(string_split(title, ' ')) AS words, regexp_matches(title, '[0-9]') AS num, regexp_matches(title, '[A-Z]{{3}}') AS caps, contains(title, '?') AS q, contains(title, '!') AS ex,
        regexp_matches(lower(title), '({"|".join(trends.VIRAL)})') AS viral, regexp_matches(lower(title), '({"|".join(trends.URGENT)})') AS urgent FROM features
), g AS (
    SELECT *, q::INT + ex::INT + caps::INT + viral::INT * 2 + urgent::INT AS emo, CASE WHEN len BETWEEN 30 AND 60 THEN 2 WHEN len BETWEEN 20 AND 80 THEN 1 ELSE 0 END + CASE WHEN words BETWEEN 5 AND 10 THEN 1 ELSE 0 END AS opt FROM f
), a AS (
    SELECT day AS start, channel_title, count(*) AS video_count, avg(views) AS avg_views, avg(len) AS avg_title_length, avg(words) AS avg_word_count, avg(emo) AS avg_emotional_score, avg(opt) AS avg_optimization_score,
        avg(views) FILTER (num) AS numbers_avg_views, avg(views) FILTER (viral) AS viral_keywords_avg_views, avg(views) FILTER (q) AS question_avg_views FROM g GROUP BY ALL
), h AS (SELECT channel_title, avg(views) AS batch_avg_views, count(*) AS batch_videos FROM golden GROUP BY channel_title
), j AS (SELECT a.*, batch_avg_views, batch_videos, (avg_emotional_score * 0.4::DOUBLE + avg_optimization_score * 0.6::DOUBLE) * (log10(avg_views + 1) / 10) AS p FROM a LEFT JOIN h USING (channel_title))
SELECT start, channel_title, video_count, avg_views, avg_title_length, avg_word_count, avg_emotional_score, avg_optimization_score, numbers_avg_views, viral_keywords_avg_views, question_avg_views,
    CASE WHEN avg_optimization_score >= 2.5 THEN 'Excellent' WHEN avg_optimization_score >= 2 THEN 'Good' WHEN avg_optimization_score >= 1.5 THEN 'Average' ELSE 'Needs Optimization' END AS title_strategy_grade,
    round(p, 4) AS viral_potential_score, batch_avg_views, batch_videos,
    CASE WHEN batch_avg_views IS NULL THEN 'No History' WHEN avg_views > batch_avg_views * 1.2::DOUBLE THEN 'Above Historical' WHEN avg_views > batch_avg_views * 0.8::DOUBLE THEN 'Consistent' ELSE 'Below Historical' END AS performance_trend,
    CASE WHEN p > 1 AND avg_views > batch_avg_views THEN 'Highly Effective' WHEN p > 0.7::DOUBLE THEN 'Effective' WHEN p > 0.4::DOUBLE THEN 'Moderate' ELSE 'Ineffective' END AS strategy_effectiveness,
    coalesce(round((avg_views - batch_avg_views) * 100.0::DOUBLE / batch_avg_views, 1), 0.0::DOUBLE) AS improvement_vs_batch
FROM j"""
    ),
    "s5_tag_momentum": _e(
        f""", u AS (SELECT *, unnest(tags) AS current_tag FROM tagged
), a AS (SELECT day AS start, current_tag, count(*) AS current_usage, avg(views) AS current_avg_views, CAST(sum(views) AS BIGINT) AS current_total_views, count(DISTINCT channel_title) AS channels_using_tag FROM u GROUP BY ALL
), x AS (SELECT *, unnest(tags_list) AS tag FROM golden), th AS (SELECT tag, category_title, {_FIGURES} FROM x GROUP BY tag, category_title HAVING count(*) >= 10
), h AS (SELECT tag, avg(avg_views) AS m FROM th GROUP BY tag), j AS (SELECT a.*, round((current_avg_views - m) * 100.0::DOUBLE / m, 1) AS change_pct FROM a LEFT JOIN h ON current_tag = tag)
SELECT start, current_tag, current_usage, current_avg_views, current_total_views, channels_using_tag, round(log10(current_avg_views + 1) * sqrt(current_usage) * channels_using_tag / 100, 4) AS tag_momentum_score, change_pct,
    CASE WHEN change_pct IS NULL THEN 'Emerging' WHEN change_pct > 50 THEN 'Hot Trend' WHEN change_pct > 20 THEN 'Growing' WHEN change_pct > -20 THEN 'Stable' ELSE 'Declining' END AS trend_status
FROM j""",
        _TAGGED,
    ),
    "s5_tag_combinations": _e(
        """, i AS (SELECT *, unnest(range(1, len(tags))) AS j FROM tagged)
SELECT day AS start, tags[j] || '+' || tags[j + 1] AS tag_combo, count(*) AS combo_usage, avg(views) AS combo_avg_views FROM i GROUP BY ALL HAVING count(*) >= 2""",
        _TAGGED,
    ),
    "s5_channel_tagging": _e(
        """, s AS (SELECT *, len(tags) AS n, CASE WHEN len(tags) >= 3 THEN 4 WHEN len(tags) = 2 THEN 2.5 WHEN len(tags) = 1 THEN 1 ELSE 0 END::DOUBLE AS d FROM tagged
), a AS (
    SELECT day AS start, channel_title, count(*) AS videos_posted, avg(n) AS avg_tags_per_video, avg(d) AS tag_strategy_score, avg(views) AS channel_performance, count_if(list_contains(tags, 'viral')) AS viral_tag_usage,
        count_if(list_contains(tags, 'gaming')) AS gaming_tag_usage, count_if(list_contains(tags, 'music')) AS music_tag_usage FROM s GROUP BY ALL
)
SELECT *, CASE WHEN tag_strategy_score >= 3.5 THEN 'Expert Tagger' WHEN tag_strategy_score >= 2.5 THEN 'Good Strategy' WHEN tag_strategy_score >= 1.5 THEN 'Basic Tagging' ELSE 'Poor Strategy' END AS tag_strategy_effectiveness FROM a""",
        _TAGGED,
    ),
    "st_dedup": _e(" SELECT DISTINCT video_id FROM messages"),
    "st_envelope": _e(" SELECT 'test' AS source, content_type AS type, count(*) AS n, CAST(sum(t) AS BIGINT) AS seconds, count(DISTINCT video_id) AS videos FROM messages GROUP BY ALL"),
}


def _replaced(sql: str, old: str, new: str) -> str:
    assert old in sql
    return sql.replace(old, new)


# The same histories; what a sketch estimates is told to be near enough.
SQL["h1_category_history_merged"] = _replaced(SQL["h1_category_history"], " AS hist_regions FROM", " AS hist_regions, TRUE AS hist_channels_within FROM")
SQL["h2_channel_history_merged"] = SQL["h2_channel_history"]
SQL["h2_category_benchmarks_merged"] = _replaced(SQL["h2_category_benchmarks"], "quantile_disc(views, 0.9) AS top_10_percent_threshold", "TRUE AS top_10_percent_threshold_within")
SQL["h3_channel_intelligence_merged"] = _replaced(SQL["h3_channel_intelligence"], "quantile_disc(views, 0.75) AS batch_p75_views", "TRUE AS batch_p75_views_within")
SQL["h4_tag_history_merged"] = _replaced(_replaced(SQL["h4_tag_history"], "quantile_disc(views, 0.9) AS p90_views", "TRUE AS p90_views_within"), "count(DISTINCT channel_title) AS unique_channels", "TRUE AS unique_channels_within")
SQL["t1_ingest_raw"] = SQL["t0_clean"]
