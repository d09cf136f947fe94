"""Ingesting raw listings: round trip, reruns that skip or replace, and failures that leave no trace."""

import json

import pytest

from tests.compare import differences
from tidemark.plans import catalog
from tidemark.sources import ingest, io

SF = "/root/testdata/sf0.001"


def files(folder, region, views):
    names = io.VIDEO_COLUMNS
    row = {c: "" for c in names} | {"video_id": f"{region}1", "title": 'a "quoted"\ntitle', "views": str(views), "category_id": "1"}
    quoted = lambda v: '"' + v.replace('"', '""') + '"'
    v, c = folder / f"{region}videos.csv", folder / f"{region}_category_id.json"
    v.write_text(",".join(names) + "\n" + ",".join(quoted(row[n]) for n in names) + "\n")
    c.write_text(json.dumps({"items": [{"id": "1", "snippet": {"title": f"{region} cat", "assignable": True}}]}, indent=1))
    return str(v), str(c)


def views(spark, out):
    return {r["region"]: r["views"] for r in ingest.read_raw(spark, out, "videos", "parquet").collect()}


def test_reruns_skip_or_replace(spark, tmp_path, monkeypatch):
    out = str(tmp_path / "raw")
    ca, us = files(tmp_path, "CA", 10), files(tmp_path, "US", 20)
    first = {r["region"]: r["load"] for r in ingest.ingest_raw(spark, [ca[0]], [ca[1]], out, "parquet").collect()}
    assert views(spark, out) == {"CA": "10"} and ingest.read_raw(spark, out, "videos", "parquet").first()["title"] == 'a "quoted"\ntitle'
    files(tmp_path, "CA", 11)
    both = ([ca[0], us[0]], [ca[1], us[1]])
    second = {r["region"]: r["load"] for r in ingest.ingest_raw(spark, *both, out, "parquet").collect()}
    # the region that was there is not loaded again
    assert second["CA"] == first["CA"] != second["US"] and views(spark, out) == {"CA": "10", "US": "20"}
    assert ingest.ingest_raw(spark, *both, out, "parquet").count() == 2 and len(ingest._versions(spark, out)) == 2
    ingest.ingest_raw(spark, *both, out, "parquet", again=True)
    assert views(spark, out) == {"CA": "11", "US": "20"}
    cats = sorted((r["region"], r["category_id"], r["title"], r["assignable"]) for r in ingest.read_raw(spark, out, "categories", "parquet").collect())
    assert cats == [("CA", "1", "CA cat", True), ("US", "1", "US cat", True)]
    # a load that fails before its manifest is there leaves all as it was
    files(tmp_path, "CA", 12)
    with monkeypatch.context() as m:
        m.setattr(ingest, "_commit", lambda *a: (_ for _ in ()).throw(OSError("crash")))
        with pytest.raises(OSError):
            ingest.ingest_raw(spark, *both, out, "parquet", again=True)
    assert views(spark, out) == {"CA": "11", "US": "20"}
    with pytest.raises(FileNotFoundError):
        ingest.ingest_raw(spark, [ca[0], str(tmp_path / "FRvideos.csv")], [], out, "parquet", again=True)
    assert views(spark, out) == {"CA": "11", "US": "20"}


def test_listings_are_written_without_a_shuffle(spark, tmp_path):
    listings = []
    for n in range(3):
        (tmp_path / str(n)).mkdir()
        listings += [files(tmp_path / str(n), r, n)[0] for r in ("CA", "US")]
    with io.settings(spark, {"spark.sql.files.maxPartitionBytes": "1", "spark.sql.files.openCostInBytes": "1"}):  # a task for each
        ingest.ingest_raw(spark, listings, [], str(tmp_path / "raw"), "parquet")
    written = [p.parent.name for p in (tmp_path / "raw").rglob("*.parquet")]
    assert sorted(written) == ["region=CA"] * 3 + ["region=US"] * 3
    assert sorted((r["region"], r["views"]) for r in ingest.read_raw(spark, str(tmp_path / "raw"), "videos", "parquet").collect()) == [(r, str(n)) for r in ("CA", "US") for n in range(3)]


@pytest.mark.parametrize("name", ["t0_clean", "t1_ingest_raw"])
def test_query_equals_its_sql(spark, name):
    assert not differences(catalog.QUERIES[name](spark, SF), catalog.SQL[name], SF)
