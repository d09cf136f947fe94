import collections
import re

import corpus_pipeline
from tokenizers import Tokenizer

import public_tokenizers
from tests.llm.test_simhash import brute
from tidemark.llm import mixing, pii
from tidemark.llm.common import table

SF = "/root/testdata/sf0.001"


def linked(ids, fps, sets):
    up = {i: i for i in ids}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in sorted(ids):
        for j in sorted(ids):
            d = (fps[i] ^ fps[j]).bit_count()
            if j < i and (d <= 4 or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])):
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def test_stages_match_brute_force(spark):
    docs = table(spark, SF, "documents")
    columns, out = docs.columns, {}
    rows = {r["doc_id"]: r.asDict() for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        path = spark.conf.get("spark.checkpoint.dir") + f"/stage-{name}"
        stage(spark, docs, SF).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        out[name] = [r.asDict() for r in docs.collect()]
        if name != "tokenize":
            assert docs.columns == columns

    words = {i: re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "") for i, r in rows.items()}
    kept = {r["doc_id"] for r in out["quality"]}
    assert kept <= {i for i, w in words.items() if len(w) >= 50} and len(kept) > len(rows) // 3
    fps = {i: brute(rows[i]["text"]) for i in kept}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i in kept for w in [(rows[i]["text"] or "").encode().lower().split()]}
    alone = {i for i, top in linked(kept, fps, sets).items() if i == top}
    assert {r["doc_id"] for r in out["near_duplicates"]} == alone
    masked = {r["doc_id"]: r for r in out["mask_personal_data"]}
    assert set(masked) == alone
    for r in masked.values():
        assert not [s for s in pii.proposed(r["text"]) if s[0] in pii.BASE] and r["n_chars"] == len(r["text"])
        if "@" not in rows[r["doc_id"]]["text"] and not re.search("[0-9]", rows[r["doc_id"]]["text"]):
            assert r["text"] == rows[r["doc_id"]]["text"]
    times = collections.Counter(r["doc_id"] for r in out["mix_sources"])
    took = {r["doc_id"]: r for r in mixing.mix(spark.createDataFrame([(r["doc_id"], r["text"], r["source"]) for r in masked.values()], "doc_id long, text string, source string")).collect()}
    # Spark rounds halves up
    assert times == collections.Counter({i: n for i, r in took.items() if (n := int(r["taken"] / r["size"] + 0.5))})
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in out["tokenize"]:
        want = t.encode(masked[r["doc_id"]]["text"], add_special_tokens=False).ids
        assert r["ids"] == want and r["n_tokens"] == len(want) and r["decoded"] == t.decode(want, skip_special_tokens=False)
    assert collections.Counter(r["doc_id"] for r in out["tokenize"]) == times


def test_odd_documents(spark):
    odd = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "word " * 60, "en", "a", 300), (3, "word " * 60, "en", "a", 300), (None, "other " * 70, None, "b", 420)]
    docs = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long")
    clash = docs.selectExpr("*", "1 AS kept", "2 AS size", "3 AS _quality", "4 AS n_words", "5 AS fp", "6 AS taken")
    for rows in (docs, docs.limit(0), clash):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, SF)
            out.collect()
            if name != "tokenize":
                assert out.columns == rows.columns
