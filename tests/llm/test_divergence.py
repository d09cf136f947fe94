import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.compare import differences
from tidemark.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, total int, shard int"


def held(df, rows, tmp_path):
    """Compare the audit of rows with the SQL over the same rows as a table."""
    import duckdb

    path = str(tmp_path / "documents.parquet")
    df.write.mode("overwrite").parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    cur = con.execute(entry.oracle_sql()["op12_divergence"])
    names = [d[0] for d in cur.description]
    assert sorted(map(tuple, rows.select(*names).collect())) == sorted(cur.fetchall())


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_equals_sql(spark, sf):
    folder = f"/root/testdata/sf{sf}"
    assert not differences(entry.queries()["op12_divergence"](spark, folder), entry.oracle_sql()["op12_divergence"], folder)


def rows():
    rng = np.random.default_rng(3)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)] + ["ÄÖ", "äö", "ÀB", "x" * 5000, "\u0085n", "日本"]
    out = [(i, "-".join(rng.choice(words, 60)), "ab"[i % 2], f"s{i % 7}" if i % 11 else None, 1, 2) for i in range(400)]
    out += [(None, None, None, None, 1, 2), (1, "", "a", "silent", 1, 2), (1, "", "a", "silent", 1, 2), (5, "only here", "c", "x", 1, 2), (6, "only here", "c", "y", 1, 2), (7, "WA Wa wa " * 20000, "a", "s1", 1, 2)]
    return out


def test_odd_rows_and_small_limits(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame(rows(), SCHEMA)
    held(df, divergence.audit(df), tmp_path)
    # many shards, tiles, chunks and passes, and counts that tasks pass on early
    for name, v in {"SHARD": 8, "SENT": 600, "TILE": 2, "CHUNK": 3, "HELD_TERMS": 50, "HELD_SLOTS": 60}.items():
        monkeypatch.setattr(divergence, name, v)
    held(df, divergence.audit(df), tmp_path)
    held(df.limit(0), divergence.audit(df.limit(0)), tmp_path)


def test_perfect_hash_is_minimal_and_verified(spark):
    for n in (1, 2, 3, 17, 1000, 4000):
        keys = [b"k%d" % i for i in range(n)]
        _, slot = divergence.perfect(keys, divergence._digests(keys))
        assert sorted(slot) == list(range(n))
    kept = spark.createDataFrame([("a", f"t{i}") for i in range(3000)], "lang string, term string")
    shards = divergence.hashes(kept).collect()
    assert len(shards) == 3 and sum(r["n"] for r in shards) == 3000
    found = divergence.Lookup(shards)
    at, slot = found.of_terms([b"t%d" % i for i in range(0, 6000, 2)] + [b"", b"other"])
    assert at.tolist() == list(range(1500)) and len(set(slot)) == 1500
    # without some of the shards, their terms are not found, and none is taken for another
    part = divergence.Lookup(shards[:2])
    at, slot = part.of_terms([b"t%d" % i for i in range(3000)])
    assert len(at) == len(set(slot)) == sum(r["n"] for r in shards[:2])
    # Spark's hash deals terms out as the lookup does
    assert spark.range(1).select(F.xxhash64(F.lit("äb"))).first()[0] == np.uint64(xxhash.xxh64_intdigest("äb".encode(), 42)).view(np.int64)


def test_shares_are_exact():
    c = np.array([0, 1, 7, 10**12, 4 * 10**15 - 8])
    n = int(c.sum())
    assert divergence.shares(c, n, 9).tolist() == [1 + 10**9 * (int(x) + 5) // (n + 45) for x in c]
    with pytest.raises(OverflowError):
        divergence.shares(c, 10**16, 9)
