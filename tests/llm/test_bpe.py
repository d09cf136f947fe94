import random

import pytest
from tokenizers import Tokenizer

import public_tokenizers
from tidemark.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
VOCAB = open(PATH, encoding="utf-8").read()
TEXTS = [
    None, "", "  ", "Hello World's it'll don't", "ΣΑΣ final Σ", "İstanbul ŞĞ é é ﬁ Å", "a<|endoftext|>B <|startoftext|>c <|EndOfText|>", "x" * 5000, "ab" * 700 + "!!!???...", "漢字かな交じり文 emoji 😀👍🏽 ٣٤ ½ Ⅷ", "tab\there\nnew\r\nline\x0b\x0c\x1c\x1d\x85\xa0 end", "1234567 12.5% $3", "naïve coöperation — “quotes”", "\x00\x01 control", "'s 't 're'VE",
]


def library(texts):
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return [(e.ids, t.decode(e.ids, skip_special_tokens=False)) for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@pytest.mark.parametrize("size", [0, 20, 5000])
def test_equals_the_library(spark, size):
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choice("aàBcΣ'd 1.\t eﬀ漢́") for _ in range(rng.randrange(60))) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, ids int")
    lex = bpe.lexicon(docs, VOCAB, size) if size else bpe.compiled([], [])
    got = {r["doc_id"]: (r["ids"], r["decoded"]) for r in bpe.encoded(docs, VOCAB, lex).collect()}
    for i, want in enumerate(library(texts)):
        assert got[i] == want, texts[i]


def test_lexicon_holds_its_words_and_no_others():
    words = sorted({"".join(random.Random(k).choices("abcé", k=k % 7 + 1)) for k in range(900)})
    lex = bpe.Lexicon(bpe.compiled(words, [[k, k + 1][: k % 3] for k in range(len(words))]))
    places = lex.places(words).tolist()
    assert sorted(places) == list(range(len(words)))
    for k, (w, p) in enumerate(zip(words, places)):
        assert lex.ids[lex.offset[p] : lex.offset[p + 1]].tolist() == [k, k + 1][: k % 3], w
    others = [w + "x" for w in words] + ["", "zz"]
    assert set(lex.places(others).tolist()) == {-1}
    assert len(lex.final) < sum(map(len, words)) // 3  # suffixes are shared


def test_a_first_class_larger_than_the_lexicon_gives_a_part(spark):
    words = ["".join(random.Random(k).choices("abcdefgh", k=9)) for k in range(400)]
    docs = spark.createDataFrame([(k, w) for k, w in enumerate(words)], "doc_id long, text string")
    lex = bpe.Lexicon(bpe.lexicon(docs, VOCAB, 60))
    assert sum(p >= 0 for p in lex.places(sorted(set(words))).tolist()) == 60


def test_long_words_stay_out_of_the_lexicon_and_are_merged_all_the_same(spark):
    texts = ["".join(random.Random(k).choices("abcdefgh", k=30_000)) for k in range(4)] * 3 + ["short words"] * 5
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    lex = bpe.lexicon(docs, VOCAB)
    assert len(lex) < 20_000
    assert {r["doc_id"]: (r["ids"], r["decoded"]) for r in bpe.encoded(docs, VOCAB, lex).collect()} == dict(enumerate(library(texts)))


def test_null_ids_repeated_rows_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b"), (2, None)], "doc_id long, text string")
    rows = sorted((r["doc_id"] or -1, r["n_tokens"]) for r in bpe.report(docs, VOCAB).collect())
    n = len(library(["a b"])[0][0])
    assert rows == [(-1, n), (1, n), (1, n), (2, 0)]
    assert bpe.report(docs.limit(0), VOCAB).collect() == []
