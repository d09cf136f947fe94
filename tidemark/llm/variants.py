"""Grouping of spelling variants by bidirectional FM-index search schemes.

Words that differ by one inserted, deleted or replaced code point share a half:
the error lies in the other one. Two searches find them all, and each starts
with a half that matches exactly and goes on across the other with one error
allowed: from the left half rightwards, and from the right half leftwards.

Each direction needs the index of that side alone, so the two sides of the
bidirectional index are dealt out apart: the words by their last ``ANCHOR`` code
points, which the right half holds, and the reversed words by theirs. Anchors are
hashed into shards of about ``SHARD`` words, and an anchor of too many words has
shards of its own, each of which all words of the anchor search. A task sorts
the suffixes of its delimited words, takes the Burrows-Wheeler text, and runs the
searches of all its words together: a state is an interval of suffix ranks, how
far the pattern has matched, and whether the error is spent; a step to the left
is a binary search among the places of a symbol.

A pair can be found by both searches and is counted once. Roots follow forms by
pointer doubling, which ends since a form has five times the word's count.

Edge cases: null texts have no words; documents with a null id hash like an empty
id; repeated rows count as often; very long runs are words like any other; ties
between forms go to the smaller word in code-point order; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ship, stored

#: Code points at a word's end that pick its shard; halves of words of LEAST code points have as many.
LEAST, ANCHOR = 6, 3
#: Words of a shard, about; an anchor of more than twice as many is cut up.
SHARD = 4000
#: One document and run in so many loses a code point.
SLIPS = 199
#: Distinct words and bytes of text that a task counts before it passes its counts on.
HELD_TERMS, HELD_BYTES = 200_000, 64 << 20
#: Interval members that one step unfolds at once.
UNFOLDED = 1 << 21

_RUN = re.compile("[A-Za-zÀ-ÿ]{%d,}" % LEAST)


def slipped(doc_id, run: str) -> str:
    """The run as the document has it: some documents lose one of its code points."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    at = h % len(run)
    return run if h % SLIPS else run[:at] + run[at + 1 :]


def counted(docs: DataFrame, least: int) -> DataFrame:
    """word and n of the words of at least so many occurrences."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            words, n = list(held), list(held.values())
            held.clear()
            for at in range(0, len(words), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(words[at : at + 20_000], pa.string()), pa.array(n[at : at + 20_000], pa.int64())], names=["word", "n"])

        for b in batches:
            for doc_id, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                # bytes.lower knows just A-Z
                own = Counter(_RUN.findall(raw.lower().decode()))
                for w, n in own.items():
                    if len(w := slipped(doc_id, w)) >= LEAST:
                        held[w] += n
                size += len(raw)
                if size > HELD_BYTES or len(held) > HELD_TERMS:
                    yield from flush()
                    size = 0
        yield from flush()

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("raw"))
    return texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


class Index:
    """An FM-index over words as ``^word$``, whose suffixes end with their ``$``."""

    def __init__(self, words: list[str]) -> None:
        size = np.fromiter(map(len, words), np.int64, len(words)) + 2
        flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        self.letters = np.unique(flat)  # symbols 2 and on; 0 is $, 1 is ^
        start = np.cumsum(size) - size
        inner = np.ones(int(size.sum()), bool)
        inner[start] = inner[start + size - 1] = False
        text = np.zeros(len(inner), np.int64)
        text[start] = 1
        text[inner] = np.searchsorted(self.letters, flat) + 2
        owner, end = np.repeat(np.arange(len(words)), size), np.repeat(start + size - 1, size)
        # ranks by 1, 2, 4, ... symbols; what lies beyond the word's end is equal
        rank, step, longest = text, 1, int(size.max())
        while step < longest:
            at = np.arange(len(text)) + step
            ahead = np.where(at <= end, rank[np.minimum(at, len(text) - 1)] + 1, 0)
            rank = np.unique(rank * (int(rank.max()) + 3) + ahead, return_inverse=True)[1]
            step *= 2
        # equal suffixes by their place, which a step to the left keeps
        order = np.argsort(rank, kind="stable")
        self.word = owner[order]
        before = text[order - 1]  # the last word's $ stands before the first ^, where no search goes on
        self.before, self.symbols, self.size = before, len(self.letters) + 2, len(text)
        # places of each symbol: a symbol's first rank and its count up to a place are one search
        self.places = np.sort(before * (self.size + 1) + np.arange(self.size))
        self.text, self.start, self.length = text, start, size - 2

    def left(self, symbol: np.ndarray, rank: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.places, symbol * (self.size + 1) + rank)

    def codes(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols of the words, where each starts, and lengths; letters that the index lacks are -1."""
        flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        at = np.minimum(np.searchsorted(self.letters, flat), len(self.letters) - 1)
        size = np.fromiter(map(len, words), np.int64, len(words))
        return np.where(self.letters[at] == flat, at + 2, -1), np.cumsum(size) - size, size

    def grown(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """State and symbol of each letter that stands before some suffix of a state's interval."""
        wide = hi - lo > self.symbols
        few, many = np.flatnonzero(~wide), np.flatnonzero(wide)
        n = (hi - lo)[few]
        at = np.repeat(lo[few], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        near = np.unique(np.repeat(few, n) * self.symbols + self.before[at])
        every = (many[:, None] * self.symbols + np.arange(2, self.symbols)[None, :]).ravel()
        both = np.concatenate([near, every])
        both = both[both % self.symbols >= 2]
        return both // self.symbols, both % self.symbols


def near(index: Index, words: list[str], larger: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (k, w): word w of the index is words[k] with one error in front of its exact last half.

    Of an odd length the half in front is the smaller one, or else the ``larger``.
    """
    flat, first, size = index.codes(words)
    q = np.arange(len(words))
    lo, hi = index.left(np.zeros(len(q), np.int64), np.zeros(len(q), np.int64)), index.left(np.zeros(len(q), np.int64), np.full(len(q), index.size))
    # the interval of $ itself, then leftwards; j symbols of the pattern are left
    j, spent = size.copy(), np.zeros(len(q), bool)
    front = (size + larger) // 2  # symbols in front of the exact half
    found_q, found_w = [], []
    while len(q):
        here = np.where(j > 0, flat[first[q] + np.maximum(j - 1, 0)], 1)
        done = spent & (j == 0)
        grow = ~spent & (j <= front[q])
        # all of the pattern matched with the error spent: the word begins here
        if done.any():
            a, b = index.left(np.ones(int(done.sum()), np.int64), lo[done]), index.left(np.ones(int(done.sum()), np.int64), hi[done])
            n = b - a
            at = np.repeat(a, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            found_q.append(np.repeat(q[done], n))
            found_w.append(index.word[at])
        parts = []
        # the symbol as it is
        go = np.flatnonzero((j > 0) & (here >= 0))
        parts.append((q[go], index.left(here[go], lo[go]), index.left(here[go], hi[go]), j[go] - 1, spent[go]))
        # the pattern's symbol left out
        go = np.flatnonzero(grow & (j > 0))
        parts.append((q[go], lo[go], hi[go], j[go] - 1, np.ones(len(go), bool)))
        # another symbol in its place, or one more in front of it
        go = np.flatnonzero(grow)
        total = np.cumsum(np.minimum(hi[go] - lo[go], index.symbols))
        cut = 0
        while cut < len(go):
            end = max(cut + 1, int(np.searchsorted(total, (total[cut - 1] if cut else 0) + UNFOLDED)))
            own = go[cut:end]
            cut = end
            state, symbol = index.grown(lo[own], hi[own])
            own = own[state]
            a, b = index.left(symbol, lo[own]), index.left(symbol, hi[own])
            for left_out, ok in ((0, b > a), (1, (b > a) & (j[own] > 0) & (symbol != here[own]))):
                parts.append((q[own][ok], a[ok], b[ok], j[own][ok] - left_out, np.ones(int(ok.sum()), bool)))
        q, lo, hi, j, spent = (np.concatenate(x) for x in zip(*parts))
        # an exact match of the whole pattern without an error goes on, since one more symbol may stand in front of it
        ok = (hi > lo) & (spent | (j >= 0))
        q, lo, hi, j, spent = q[ok], lo[ok], hi[ok], j[ok], spent[ok]
    if not found_q:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    both = np.unique(np.concatenate(found_q) * len(index.start) + np.concatenate(found_w))
    return both // len(index.start), both % len(index.start)


def pairs(words: DataFrame) -> DataFrame:
    """word, near and near_n: each two words with one error between them, once for each search that finds them."""
    ship(words.sparkSession)
    sided = words.select("word", "n", F.explode(F.array(*[F.struct(F.lit(k).alias("side"), x.alias("own")) for k, x in enumerate((F.col("word"), F.reverse("word")))])).alias("s")).select("n", "s.side", "s.own")
    sided = sided.withColumn("anchor", F.substring("own", -ANCHOR, ANCHOR))
    full = stored(sided.groupBy("side", "anchor").agg(F.count("*").alias("size")).filter(F.col("size") > 2 * SHARD))
    shards = max(1, -(-words.count() // SHARD))
    cut = sided.join(full, ["side", "anchor"], "left").withColumn("cuts", F.coalesce(F.ceil(F.col("size") / SHARD), F.lit(1)))
    cut = cut.withColumn("own_cut", F.pmod(F.xxhash64("own", F.lit(5)), F.col("cuts"))).withColumn("cut", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1)))
    # an anchor that is cut up has shards of its own
    shard = F.when(F.col("cuts") == 1, F.pmod(F.xxhash64("anchor", F.lit(6)), F.lit(shards)).cast("string")).otherwise(F.concat_ws(":", "anchor", "cut"))
    cut = cut.select("side", shard.alias("shard"), "own", "n", (F.col("own_cut") == F.col("cut")).alias("held"))

    def run(key, t):
        own, n = t.column("own").to_pylist(), t.column("n").to_numpy()
        at = np.flatnonzero(t.column("held").to_numpy(zero_copy_only=False)) if t.num_rows else np.zeros(0, np.int64)
        a = b = np.zeros(0, np.int64)
        if len(at):
            # both sides cut a word of odd length at the same place
            a, b = near(Index([own[k] for k in at]), own, bool(key[0].as_py()))
            b = at[b]
        turned = (lambda w: w[::-1]) if key[0].as_py() else (lambda w: w)
        return pa.table({"word": pa.array([turned(own[k]) for k in a], pa.string()), "near": pa.array([turned(own[k]) for k in b], pa.string()), "near_n": pa.array(n[b], pa.int64())})

    return cut.groupBy("side", "shard").applyInArrow(run, "word string, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """word and root: the last word that forms(word, form) lead to."""
    at = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        # a root that leads nowhere is the last
        at_next = stored(at.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if at_next.filter("moved").isEmpty():
            return at
        at = at_next.select("word", "root")


def grouped(docs: DataFrame, least: int = 5, times: int = 5) -> DataFrame:
    """word, n, form, form_n, n_near and root of each word."""
    words = stored(counted(docs, least))
    found = pairs(words).groupBy("word", "near").agg(F.max("near_n").alias("near_n"))
    # the largest count, then the smallest word, whose order in UTF-8 is that of code points
    best = found.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best"))
    each = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "best")
    is_form = -F.col("best.less") >= times * F.col("n")
    each = stored(each.select("word", "n", "n_near", F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n")))
    return each.join(roots(each.filter("form is not null")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
