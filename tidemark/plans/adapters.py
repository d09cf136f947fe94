"""Maps the test tables to the canonical relations that the reports read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import exprs as x

# Beginnings of stream titles, by event.
PREFIXES = ("Why? ", "Wow! ", "BIG DAY ", "Top 10 ", "Epic game music review ", "Breaking music news ", "Plain talk ")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _number(docs: DataFrame) -> int:
    return max(1, docs.count())


#: Line items that a task joins and groups, about, where there are more than the session's partitions take.
TASK_ROWS = 500_000


def _dealing(counted: DataFrame) -> Callable[..., DataFrame]:
    """Deals a relation out by keys that it is joined or grouped by, in more partitions than the session's if the counted rows ask for them, so that no task's memory grows with the input."""
    parts = -(-counted.count() // TASK_ROWS)
    more = parts > int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return lambda df, *keys: df.repartition(parts, *keys) if more and keys else df


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Stored rows, which are counted without reading them, dealt out by the columns that they are grouped by."""
    return _dealing(rows)(rows, *keys)


def golden(spark: SparkSession, sf_dir: str, description: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """One row for each line item; ``description`` adds the length of a document's text by a join.

    ``by`` deals the rows out by columns that a report groups them by, where
    there are too many for the session's partitions. Document ids run from 0 without gaps, so that a key modulo their number
    falls on one of them; only lengths are joined, never texts.
    """
    t = lambda name: table(spark, sf_dir, name)
    big = lambda e: F.floor(e).cast("bigint")
    deal = _dealing(t("lineitem"))
    # a customer's segment is told by a flag, which takes less to move
    customers = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_name", "n_name", (F.col("c_mktsegment") != "MACHINERY").alias("assignable"))
    # orders meet their customers before their line items, which so move twice and narrow the first time; the
    # small side of a join is dealt out, so that the large one follows in a merge join and stays in a broadcast one
    owners = t("orders").join(deal(customers, "c_custkey"), F.col("o_custkey") == F.col("c_custkey"))
    df = deal(t("lineitem").join(deal(t("part"), "p_partkey"), F.col("l_partkey") == F.col("p_partkey")), "l_orderkey").join(owners, F.col("l_orderkey") == F.col("o_orderkey"))
    published = F.col("o_orderdate").cast("date")
    cols = {
        "video_id": F.concat(F.lit("v"), F.col("l_orderkey").cast("string")),
        "video_title": F.col("p_name"),
        "channel_title": F.col("c_name"),
        "category_title": F.col("o_orderpriority"),
        "region": F.col("n_name"),
        "views": big(F.col("l_extendedprice") * 2000),
        "likes": big(F.col("l_quantity") * 4000),
        "dislikes": big(F.col("l_tax") * 100000),
        "comment_count": big(F.col("l_quantity") * F.col("p_size")),
        "comments_disabled": F.col("l_returnflag") == "R",
        "ratings_disabled": F.col("l_linestatus") == "F",
        "video_error_or_removed": F.col("l_linenumber") == 7,
        "assignable": F.col("assignable"),
        "tags_list": F.concat(F.split("p_name", " "), F.array(F.lower("p_brand"), F.lower("p_type"))),
        "thumbnail_link": F.element_at(F.array(F.lit("default.jpg"), F.lit("maxresdefault.jpg"), F.lit("hqdefault.jpg")), (F.col("l_linenumber") % 3 + 1).cast("int")),
        "publish_date": published,
        "trending_full_date": F.date_add(published, (F.col("l_partkey") % 40).cast("int")),
    }
    if description:
        docs = t("documents").select(F.col("doc_id").alias("_d"), F.length("text").alias("_length"))
        df = df.join(docs, F.col("l_orderkey") % _number(docs) == F.col("_d"))
        cols["description_length"] = F.col("_length")
    df = df.select(*[c.alias(k) for k, c in cols.items()])
    return deal(df, *by).withColumns({"publish_year": F.year("publish_date"), "trending_month": F.month("trending_full_date"), "trending_year": F.year("trending_full_date")})


GOLDEN_SQL = """
golden AS (
    SELECT 'v' || l_orderkey AS video_id, p_name AS video_title, c_name AS channel_title, o_orderpriority AS category_title, n_name AS region,
        CAST(floor(l_extendedprice * 2000) AS BIGINT) AS views, CAST(floor(l_quantity * 4000) AS BIGINT) AS likes,
        CAST(floor(l_tax * 100000) AS BIGINT) AS dislikes, CAST(floor(l_quantity * p_size) AS BIGINT) AS comment_count,
        l_returnflag = 'R' AS comments_disabled, l_linestatus = 'F' AS ratings_disabled, l_linenumber = 7 AS video_error_or_removed,
        c_mktsegment <> 'MACHINERY' AS assignable,
        list_concat(string_split(p_name, ' '), [lower(p_brand), lower(p_type)]) AS tags_list,
        (['default.jpg', 'maxresdefault.jpg', 'hqdefault.jpg'])[l_linenumber % 3 + 1] AS thumbnail_link,
        CAST(o_orderdate AS DATE) AS publish_date, CAST(o_orderdate AS DATE) + CAST(l_partkey % 40 AS INTEGER) AS trending_full_date,
        l_orderkey % (SELECT count(*) FROM documents) AS doc_key,
        year(CAST(o_orderdate AS DATE)) AS publish_year, month(CAST(o_orderdate AS DATE) + CAST(l_partkey % 40 AS INTEGER)) AS trending_month,
        year(CAST(o_orderdate AS DATE) + CAST(l_partkey % 40 AS INTEGER)) AS trending_year
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey
)"""


def events(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """Event rows as the data of trending messages, with ``timestamp`` in epoch seconds.

    Four neighbouring events are of one video, and each has a document's whole
    text as its description. One in forty has many views, as beside history.
    ``parts`` deals the events out before they get their texts, which are many
    times their size, and puts those of one text side by side, so that they pack well.
    """
    t = lambda name: table(spark, sf_dir, name)
    texts = t("documents").select(F.col("doc_id").alias("_d"), "text", "lang")
    df = t("events").join(t("customer").select("c_custkey", "c_name", "c_mktsegment"), F.col("user_id") == F.col("c_custkey")).withColumn("_key", F.col("event_id") % _number(texts))
    # a merge join sorts by the key; a sort put before a join is left out by the planner
    df = (df.repartition(parts, "_key").join(texts.hint("merge"), F.col("_key") == F.col("_d")) if parts else df.join(texts, F.col("_key") == F.col("_d")))
    k = F.get_json_object("props", "$.k").cast("int")
    pick = lambda values, i: F.element_at(F.array(*[F.lit(v) for v in values]), (i + 1).cast("int"))
    e = F.col("event_id")
    # seconds since 1970 of the wall-clock value, whatever the session's time zone
    seconds = F.expr("timestampdiff(SECOND, timestamp_ntz '1970-01-01 00:00:00', ts)")
    return df.select(
        seconds.cast("bigint").alias("timestamp"),
        F.concat(F.lit("v"), F.floor(e / 4).cast("string")).alias("videoId"),
        F.col("event_type").alias("type"),
        F.concat(pick(PREFIXES, e % 7), F.col("event_type"), F.lit(" in "), F.col("lang"), F.lit(" from "), F.lower("c_mktsegment")).alias("title"),
        F.col("c_name").alias("channelTitle"),
        F.col("text").alias("description"),
        F.concat(F.format_number(F.floor(F.col("value") * F.when(e % 40 == 0, 20_000_000).otherwise(50_000)), 0), F.lit(" views")).alias("viewCount"),
        F.floor(F.col("value") * 1000).cast("string").alias("likeCount"),
        pick((" 1-urgent", "2-High ", "3-MEDIUM", " 4-not specified ", "5-low"), e % 5).alias("category"),
        F.when(k % 3 == 0, F.concat(F.lit("1:"), (k % 60).cast("string"), F.lit(":05"))).otherwise(F.concat(k.cast("string"), F.lit(":30"))).alias("lengthText"),
    )


EVENTS_SQL = f"""
messages AS (
    SELECT CAST(floor(epoch(ts)) AS BIGINT) AS t, 'v' || (event_id // 4) AS video_id, event_type AS content_type,
        ([{", ".join(f"'{p}'" for p in PREFIXES)}])[event_id % 7 + 1] || event_type || ' in ' || lang || ' from ' || lower(c_mktsegment) AS title, c_name AS channel_title, text AS description,
        CAST(floor(value * CASE WHEN event_id % 40 = 0 THEN 20000000 ELSE 50000 END) AS BIGINT) AS views, CAST(floor(value * 1000) AS BIGINT) AS likes,
        ([' 1-urgent', '2-High ', '3-MEDIUM', ' 4-not specified ', '5-low'])[event_id % 5 + 1] AS category,
        CAST(props->>'$.k' AS INTEGER) AS k
    FROM (SELECT *, event_id % (SELECT count(*) FROM documents) AS doc_key FROM events) e JOIN customer ON user_id = c_custkey JOIN documents ON doc_key = doc_id
), features AS (
    SELECT *, CASE WHEN k % 3 = 0 THEN 3600 + (k % 60) * 60 + 5 ELSE k * 60 + 30 END AS duration_seconds, t // 86400 * 86400 AS day,
        CASE WHEN views >= 10000000 THEN 'Mega Hit (10M+)' WHEN views >= 1000000 THEN 'Viral (1M+)' WHEN views >= 100000 THEN 'Popular (100K+)' WHEN views >= 10000 THEN 'Rising (10K+)' ELSE 'New/Small' END AS popularity_tier,
        CASE WHEN length(description) = 0 THEN 'No Description' WHEN length(description) < 100 THEN 'Very Short' WHEN length(description) < 300 THEN 'Short' WHEN length(description) < 1000 THEN 'Medium' WHEN length(description) < 2000 THEN 'Long' ELSE 'Very Long' END AS description_category
    FROM messages WHERE views > 0
)"""


def details(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """Event rows as the data of details messages: plain digits as text, flags and countries."""
    e = events(spark, sf_dir, parts)
    return e.select(
        "timestamp", F.col("videoId").alias("id"), "title", x.duration_seconds("lengthText").cast("string").alias("lengthSeconds"), F.col("channelTitle").alias("channelId"), "channelTitle", "description",
        (F.col("type") == "view").alias("isLiveContent"), F.lit(True).alias("allowRatings"), F.regexp_replace("viewCount", "[^0-9]", "").alias("viewCount"), "likeCount", F.array(F.lit("US"), F.lit("CA")).alias("availableCountries"), "category",
    )


def raw_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as raw, all-text listings with faults: bad numbers, blank and piped tags, odd titles."""
    t = lambda name: table(spark, sf_dir, name)
    df = t("lineitem").join(t("part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    n, s = F.col("l_linenumber"), lambda c: F.col(c).cast("string")
    key = F.col("l_orderkey")
    return df.select(
        F.concat(F.lit("v"), s("l_orderkey"), F.lit("-"), n.cast("string")).alias("video_id"),
        F.date_format(F.col("l_shipdate").cast("date"), "yy.dd.MM").alias("trending_date"),
        F.when(key % 11 == 0, F.lit(None)).when(key % 7 == 0, F.concat(F.lit("é "), F.repeat(F.col("p_name"), 9))).otherwise(F.concat(F.col("p_name"), F.lit("   ok"))).alias("title"),
        F.lit("channel").alias("channel_title"), (F.col("l_suppkey") % 5).cast("string").alias("category_id"),
        F.lit("2017-11-13T17:13:01.000Z").alias("publish_time"),
        F.when(n == 1, "").when(n == 2, "a|||b").when(n == 3, " | ").when(n == 4, "one").otherwise(F.lit(None)).alias("tags"),
        F.when(key % 13 == 0, "abc").otherwise(F.floor("l_extendedprice").cast("bigint").cast("string")).alias("views"),
        F.lit("1").alias("likes"), F.lit("").alias("dislikes"), F.lit("2").alias("comment_count"), F.lit("x").alias("thumbnail_link"),
        F.when(n == 1, "True").otherwise("False").alias("comments_disabled"), F.lit("False").alias("ratings_disabled"), F.lit("False").alias("video_error_or_removed"), F.lit("d").alias("description"),
        F.element_at(F.array(F.lit("CA"), F.lit("US")), (n % 2 + 1).cast("int")).alias("region"),
    )


def raw_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories by region from the nations; number 4 has none."""
    t = table(spark, sf_dir, "nation").filter("n_nationkey < 4")
    return t.select(F.col("n_nationkey").cast("string").alias("category_id"), F.col("n_name").alias("title"), (F.col("n_nationkey") % 2 == 0).alias("assignable"), F.explode(F.array(F.lit("CA"), F.lit("US"))).alias("region"))
