import datetime
import json

from pyspark.sql import functions as F

from tidemark.functions import exprs as x
from tidemark.operators import cleaning
from tidemark.plans import adapters
from tidemark.sources import io


def column(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(expr).first()[0]


def test_text_expressions(spark):
    for text, n in (("1,234 views", 1234), ("0", 0), ("", None), (None, None), ("no", None)):
        assert column(spark, text, x.count_text("c")) == n
    for text, n in (("4:05", 245), ("1:02:03", 3723), ("", 0), ("x", 0), (None, 0)):
        assert column(spark, text, x.duration_seconds("c")) == n
    for text, tags in ((None, ["uncategorized"]), ("  ", ["uncategorized"]), ("a|||b", ["a", "b"]), (" | ", ["unknown"]), ("one", ["one"])):
        assert column(spark, text, x.clean_tags("c")) == tags
    assert column(spark, "a" * 100, x.clean_title("c")) == "a" * 100
    assert column(spark, "a" * 101, x.clean_title("c")) == "a" * 97 + "..."
    assert column(spark, "é", x.clean_title("c")) == ""
    assert column(spark, " a   b ", x.clean_title("c")) == "a b"
    assert column(spark, [], x.adjacent_pairs("c"), "array<string>") == []
    assert [tuple(p) for p in column(spark, ["a", "b", "c"], x.adjacent_pairs("c"), "array<string>")] == [("a", "b"), ("b", "c")]
    assert column(spark, "Funny game review", x.lexicon_tags("c", {"g": ("game",), "f": ("funny", "laugh"), "z": ("zoo",)})) == ["g", "f"]
    assert column(spark, "known", x.lexicon_tags("c", {"u": ("now",)}, word_boundary=True)) == []


def test_labels_at_their_bounds(spark):
    for n, label in ((9, "low"), (10, "mid"), (11, "mid"), (99, "mid"), (100, "high"), (None, "low")):
        assert column(spark, n, x.at_least("c", ((100, "high"), (10, "mid")), "low"), "int") == label
    for n, label in ((10, "low"), (11, "mid"), (100, "mid"), (101, "high")):
        assert column(spark, n, x.above("c", ((100, "high"), (10, "mid")), "low"), "int") == label
    for n, label in ((0, "No Description"), (99, "Very Short"), (100, "Short"), (299, "Short"), (300, "Medium"), (999, "Medium"), (1000, "Long"), (1999, "Long"), (2000, "Very Long")):
        assert column(spark, "a" * n, x.description_bucket("c")) == label
    assert column(spark, None, x.description_bucket("c")) == "Very Long"


def test_files_to_clean_rows(spark, tmp_path):
    head = ",".join(io.VIDEO_COLUMNS)
    good = 'v1,17.14.11,"He said ""hi""\nthere",ch,10,2017-11-13T17:13:01.000Z,"a|b",100,1,2,3,t,True,False,False,d'
    bad = "v2,zz,title,ch,99,x,,abc,1,2,3,t,False,False,False,d"
    zero = "v3,17.14.11,title,ch,10,2017-11-13,,0,1,2,3,t,False,False,False,d"
    (tmp_path / "CAvideos.csv").write_text("\n".join([head, good, bad, zero]) + "\n")
    (tmp_path / "CA_category_id.json").write_text(json.dumps({"items": [{"id": "10", "snippet": {"title": "Music", "assignable": True}}, {"id": "11", "snippet": {"title": "None", "assignable": False}}]}, indent=1))
    videos = io.read_videos(spark, [str(tmp_path / "CAvideos.csv")])
    cats = io.read_categories(spark, [str(tmp_path / "CA_category_id.json")])
    assert cats.count() == 2 and videos.count() == 3
    rows = cleaning.clean_content(videos, cats).collect()
    assert [r["video_id"] for r in rows] == ["v1"]
    r = rows[0]
    assert (r["video_title"], r["category_title"], r["assignable"], r["region"], r["region_id"]) == ('He said "hi"there', "Music", True, "CA", 1)
    assert r["trending_full_date"] == datetime.date(2017, 11, 14) and r["trending_month"] == "Novembar" and r["comments_disabled"]


def test_gates(spark):
    df = spark.range(3)
    assert {r["check_name"]: (r["value"], r["passed"]) for r in cleaning.gates({"a": (df, 1), "b": (df.filter("id < 0"), 1)}).collect()} == {"a": (3, True), "b": (0, False)}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "CA"), (2, "US")], "n int, region string")
    io.write(df, str(tmp_path / "t"), partition_by=("region",))
    io.write(df.filter("n = 2").withColumn("n", F.lit(5)), str(tmp_path / "t"), partition_by=("region",), dynamic=True)
    assert sorted(tuple(r) for r in io.read(spark, str(tmp_path / "t")).collect()) == [(1, "CA"), (5, "US")]
    for _ in range(2):  # a replayed epoch replaces itself
        io.write_epoch(df, str(tmp_path / "e"), 0)
    assert spark.read.parquet(str(tmp_path / "e")).count() == 2
    url = f"jdbc:derby:memory:t{tmp_path.name.replace('-', '')};create=true"
    driver = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    io.write_jdbc(df, url, "report", driver)
    assert io.read_jdbc(spark, url, "report", driver, ("N", 0, 10, 2)).count() == 2
    io.register(df, "listing")
    assert spark.sql("select sum(n) from listing").first()[0] == 3


def test_titles_are_cleaned_once(spark):
    sf = "/root/testdata/sf0.001"
    plan = cleaning.clean_content(adapters.raw_videos(spark, sf), adapters.raw_categories(spark, sf)).select("video_title")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[^\\x20-\\x7E]") <= 3  # once for each branch of the cut and its condition
