"""Audit of how sources of a language differ in their words, by a recount through minimal perfect hashes.

1. *Frequency filter.* Every text's terms are counted once for each document of
   its language; Spark adds the tasks' partial counts, and terms of too few
   documents go. This is exact.
2. *Perfect hashes.* The kept terms of a language are cut into shards of about
   ``SHARD`` by their XXH64. For each a task builds a minimal perfect hash by
   displacement: a term's bucket holds a seed, and the seed leads each of the
   bucket's terms to a slot that no other term has. The terms themselves lie in
   slot order beside it.
3. *Recount.* Shards are broadcast, at most ``SENT`` bytes at once: a larger
   vocabulary takes several passes over the texts, each with another part of it.
   A term of a text finds its slot, the term stored there tells whether it is
   that one, and a dense vector for the text's group counts it. Vectors of tasks
   are added, one pending at a time.
4. *Comparison.* Vectors of a language are compared in tiles of sources and
   chunks of shards; Spark adds the chunks' sums. All arithmetic is on integers.

Edge cases: null texts, languages and sources count as ''; each row is a
document, so repeated rows count as often; a group without kept terms has its
rows all the same; with one source a language has no pairs; extra columns are
ignored; an empty table gives no rows. Totals beyond 9e15 words of a group,
where integers would not hold the products, are refused.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import ship, stored

#: Terms of a shard, about.
SHARD = 1024
#: Bytes of hashes and terms that are broadcast at once, at most, unless a single shard has more.
SENT = 32 << 20
#: Distinct terms, bytes of text and slots that a task holds before it passes its counts on.
HELD_TERMS, HELD_BYTES, HELD_SLOTS = 200_000, 64 << 20, 4 << 20
#: Sources of a tile and shards of a chunk, about.
TILE, CHUNK = 48, 16
#: A denominator up to which thousandfold remainders fit 63 bits.
MOST = 9 * 10**15

#: A-Z as a-z, other letters and everything beyond ASCII as they are, the rest as spaces.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9))


def terms(raw: bytes) -> list[bytes]:
    """The terms of a text in UTF-8: runs of letters and of characters beyond ASCII, A-Z lower-cased."""
    return raw.translate(_FOLD).split()


def _packed(x: np.ndarray) -> bytes:
    return zlib.compress(x.astype("<i8").tobytes(), 1)


def _unpacked(x: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(x), "<i8")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")], F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("raw"))


def _strings(x: list[bytes]) -> pa.Array:
    return pa.array(x, pa.binary()).cast(pa.string())


def document_frequencies(texts: DataFrame, least: int) -> DataFrame:
    """lang and term of the terms that at least so many documents of the language hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, c in held.items():
                words, n = list(c), list(c.values())
                for at in range(0, len(words), 20_000):
                    part = words[at : at + 20_000]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), _strings(part), pa.array(n[at : at + 20_000], pa.int64())], names=["lang", "term", "n"])
            held.clear()

        for b in batches:
            for lang, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held.setdefault(lang, Counter()).update(set(terms(raw)))
                size += len(raw)
                if size > HELD_BYTES or sum(map(len, held.values())) > HELD_TERMS:
                    yield from flush()
                    size = 0
        yield from flush()

    counted = texts.select("lang", "raw").mapInArrow(run, "lang string, term string, n long")
    return counted.groupBy("lang", "term").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("lang", "term")


def _slots(h: np.ndarray, seed: np.ndarray, n) -> np.ndarray:
    x = (h ^ (seed.astype(np.uint64) * _MIX[0])) * _MIX[1]
    x ^= x >> np.uint64(31)
    x *= _MIX[0]
    return ((x >> np.uint64(32)) % np.asarray(n).astype(np.uint64)).astype(np.int64)


def _buckets(h: np.ndarray, n) -> np.ndarray:
    return ((h >> np.uint64(40)) % np.asarray(n).astype(np.uint64)).astype(np.int64)


def perfect(keys: list[bytes], h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seeds of the buckets and the slot of each key, all different and less than their number.

    Large buckets choose first; one of a single key takes a free slot, which
    its seed names as -1 - slot.
    """
    n = len(keys)
    if len(np.unique(h)) < n:
        raise ValueError("two terms of a shard have one 64-bit hash")
    count = n // 4 + 1
    bucket = _buckets(h, count)
    order = np.argsort(bucket, kind="stable")
    size = np.bincount(bucket, minlength=count)
    start = np.cumsum(size) - size
    seeds, slot, free = np.zeros(count, np.int64), np.empty(n, np.int64), np.ones(n, bool)
    for b in np.argsort(-size, kind="stable"):
        own = order[start[b] : start[b] + size[b]]
        if len(own) == 1:
            seeds[b] = -1 - (at := int(np.argmax(free)))
            slot[own] = at
            free[at] = False
        first = 1
        while len(own) > 1:
            tried = np.arange(first, first + 256)
            at = np.sort(to := _slots(h[own][None, :], tried[:, None], n), axis=1)
            good = free[to].all(axis=1) & (at[:, 1:] != at[:, :-1]).all(axis=1)
            if good.any():
                k = int(np.argmax(good))
                seeds[b], slot[own] = tried[k], to[k]
                free[to[k]] = False
                break
            first += 256
    return seeds, slot


def _digests(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in words), np.uint64, len(words))


def hashes(kept: DataFrame) -> DataFrame:
    """lang, shard, of (the language's shards), n (its terms), seeds and keys in slot order, packed."""
    ship(kept.sparkSession)
    shards = kept.groupBy("lang").agg(F.ceil(F.count("*") / SHARD).alias("of"))

    def run(key, t):
        words = [w.encode() for w in t.column("term").to_pylist()]
        seeds, slot = perfect(words, _digests(words))
        keys = [words[k] for k in np.argsort(slot)]
        return pa.table({"lang": [key[0].as_py()], "shard": [key[1].as_py()], "of": [t.column("of")[0].as_py()], "n": [len(words)], "seeds": [_packed(seeds)], "keys": [b" ".join(keys)]})

    dealt = kept.join(shards, "lang").withColumn("shard", F.pmod(F.xxhash64("term"), F.col("of")))
    return dealt.repartition("lang", "shard").groupBy("lang", "shard").applyInArrow(run, "lang string, shard long, of long, n long, seeds binary, keys binary")


class Lookup:
    """Slots of a language's terms in the shards at hand, all in one row."""

    def __init__(self, shards: list) -> None:
        of = shards[0]["of"]
        self.of, self.n, self.buckets = of, np.zeros(of, np.int64), np.ones(of, np.int64)
        self.slot, self.bucket = np.zeros(of, np.int64), np.zeros(of, np.int64)
        self.shards = [r["shard"] for r in shards]
        seeds, keys, at = [], [], 0
        for r in shards:
            s, own = _unpacked(bytes(r["seeds"])), bytes(r["keys"]).split(b" ")
            self.n[r["shard"]], self.buckets[r["shard"]], self.slot[r["shard"]], self.bucket[r["shard"]] = len(own), len(s), len(keys), at
            seeds.append(s)
            keys += own
            at += len(s)
        self.seeds, self.keys = np.concatenate(seeds), np.array([*keys, None], object)[:-1]

    def of_terms(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Which of the terms are there, and their slots."""
        h = _digests(words)
        shard = np.mod(h.view(np.int64), self.of)
        at = np.flatnonzero(self.n[shard])
        h, shard = h[at], shard[at]
        seed = self.seeds[self.bucket[shard] + _buckets(h, self.buckets[shard])]
        # a named slot can be that of another shard's size for a term that isn't there
        slot = np.where(seed < 0, np.minimum(-1 - seed, self.n[shard] - 1), _slots(h, np.maximum(seed, 0), self.n[shard])) + self.slot[shard]
        own = np.array([*words, None], object)[:-1][at]
        same = self.keys[slot] == own
        return at[same], slot[same]

    def parts(self, counts: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        for s in self.shards:
            yield s, counts[self.slot[s] : self.slot[s] + self.n[s]]


def recounted(texts: DataFrame, shards: DataFrame) -> DataFrame:
    """lang, shard, source, n and counts: a packed vector of occurrences by slot, where there are any."""
    spark = texts.sparkSession
    narrow = shards.select("lang", "shard", (F.length("keys") + F.length("seeds") + 100).alias("bytes"))
    total = narrow.agg(F.count("*").alias("shards"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    passes = max(1, -(-total["bytes"] // SENT))
    by = lambda k: F.pmod(F.xxhash64("lang", "shard"), F.lit(k))
    while passes < total["shards"] and narrow.groupBy(by(passes).alias("p")).agg(F.sum("bytes").alias("b")).agg(F.max("b")).first()[0] > SENT:
        passes *= 2
    out = None
    for k in range(passes):
        # at most SENT bytes, as was just seen
        sent: dict[str, list] = {}
        for r in shards.filter(by(passes) == k).collect():
            sent.setdefault(r["lang"], []).append(r)
        part = _counted(texts, spark.sparkContext.broadcast(sent))
        out = part if out is None else out.unionByName(part)
    return _added(out, ["lang", "shard", "source"])


def _counted(texts: DataFrame, sent) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {lang: Lookup(shards) for lang, shards in sent.value.items()}
        words: dict[tuple[str, str], Counter] = {}
        slots: dict[tuple[str, str], np.ndarray] = {}
        size = 0

        def settle() -> None:
            for (lang, source), c in words.items():
                at, slot = found[lang].of_terms(list(c))
                v = slots.setdefault((lang, source), np.zeros(len(found[lang].keys), np.int64))
                v[slot] += np.fromiter(c.values(), np.int64, len(c))[at]
            words.clear()

        def flush() -> Iterator[pa.RecordBatch]:
            rows = [(lang, s, source, int(v.sum()), _packed(v)) for (lang, source), all_ in slots.items() for s, v in found[lang].parts(all_) if v.any()]
            slots.clear()
            for at in range(0, len(rows), 1000):
                yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows[at : at + 1000]], schema=schema)

        for b in batches:
            for lang, source, raw in zip(*(b.column(k).to_pylist() for k in range(3))):
                if lang not in found:
                    continue
                words.setdefault((lang, source), Counter()).update(terms(raw))
                size += len(raw)
                if size > HELD_BYTES or sum(map(len, words.values())) > HELD_TERMS:
                    settle()
                    size = 0
                    if sum(map(len, slots.values())) > HELD_SLOTS:
                        yield from flush()
        settle()
        yield from flush()

    names = ["lang", "shard", "source", "n", "counts"]
    schema = pa.schema([("lang", pa.string()), ("shard", pa.int64()), ("source", pa.string()), ("n", pa.int64()), ("counts", pa.binary())])
    return texts.mapInArrow(run, "lang string, shard long, source string, n long, counts binary")


def _added(df: DataFrame, keys: list[str]) -> DataFrame:
    """The vectors of equal keys added up, in order and one at a time."""
    names = [*keys, "n", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total, schema = None, None, None
        row = lambda: pa.RecordBatch.from_pylist([{**dict(zip(keys, key)), "n": int(total.sum()), "counts": _packed(total)}], schema=schema)
        for b in batches:
            schema = b.schema
            for *k, _, counts in zip(*(c.to_pylist() for c in b.columns)):
                v = _unpacked(counts)
                if k == key:
                    total = total + v
                    continue
                if key is not None:
                    yield row()
                key, total = k, v
        if key is not None:
            yield row()

    dealt = df.select(*names).repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, dealt.schema)


def shares(counts: np.ndarray, n: int, v: int) -> np.ndarray:
    """1 + floor(10 ** 9 * (count + 5) / (n + 5 v)), three digits at a time."""
    low = n + 5 * v
    if low > MOST:
        raise OverflowError(f"{n} words are too many")
    rest, out = counts + 5, np.zeros(counts.shape, np.int64)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // low
        rest = rest % low
    return out + 1


def _pairs(groups: DataFrame, vectors: DataFrame, shards: DataFrame) -> DataFrame:
    """lang, source, item and value: the distance of each two sources of a language."""
    tiles = groups.groupBy("lang").agg(F.ceil(F.count("*") / TILE).alias("tiles"))
    chunks = shards.groupBy("lang", F.floor(F.col("shard") / CHUNK).alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("shard", "n"))).alias("sizes"))
    # a row for each group, without counts, tells a chunk's task of the group and the shards
    each = groups.join(tiles, "lang").withColumn("tile", F.pmod(F.xxhash64("source"), F.col("tiles")))
    stubs = each.join(chunks, "lang", "left").select("lang", "source", "total", "terms", "tile", "tiles", F.coalesce("chunk", F.lit(-1)).alias("chunk"), "sizes", F.lit(None).cast("long").alias("shard"), F.lit(None).cast("binary").alias("counts"))
    full = vectors.join(each, ["lang", "source"]).select("lang", "source", "total", "terms", "tile", "tiles", F.floor(F.col("shard") / CHUNK).alias("chunk"), F.lit(None).cast(stubs.schema["sizes"].dataType).alias("sizes"), "shard", "counts")
    both = stubs.unionByName(full).withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    both = both.select("lang", "chunk", F.least("tile", "with").alias("i"), F.greatest("tile", "with").alias("j"), "tile", "source", "total", "terms", "sizes", "shard", "counts")

    def run(key, t):
        lang, _, i, j = (k.as_py() for k in key)
        rows = t.to_pylist()
        sources = sorted({(r["tile"], r["source"]): r for r in rows if r["shard"] is None}.items())
        place = {s: k for k, (s, _) in enumerate(sources)}
        dist = np.zeros((len(sources), len(sources)), np.int64)
        sizes = {x["shard"]: x["n"] for x in (rows and next((r["sizes"] for r in rows if r["sizes"]), None) or ())}
        counts: dict[int, list] = {}
        for r in rows:
            if r["shard"] is not None:
                counts.setdefault(r["shard"], []).append((place[r["tile"], r["source"]], r["counts"]))
        for shard, n in sizes.items():
            c = np.zeros((len(sources), n), np.int64)
            for k, x in counts.get(shard, ()):
                c[k] = _unpacked(x)
            p = np.stack([shares(c[k], r["total"], r["terms"]) for k, (_, r) in enumerate(sources)])
            for k in range(len(sources)):
                dist[k] += np.abs(p - p[k]).sum(axis=1)
        a, b = np.nonzero(~np.eye(len(sources), dtype=bool))
        if i != j:  # pairs inside one tile belong to that tile's own task
            tile = np.array([s[0] for s, _ in sources], np.int64)
            a, b = (x[tile[a] != tile[b]] for x in (a, b))
        name = [s[1] for s, _ in sources]
        return pa.table({"lang": pa.array([lang] * len(a), pa.string()), "source": pa.array([name[k] for k in a], pa.string()), "item": pa.array([name[k] for k in b], pa.string()), "value": pa.array(dist[a, b], pa.int64())})

    # without this the planner leaves a whole language in one task, as the joins dealt it
    parts = both.repartition("lang", "chunk", "i", "j").groupBy("lang", "chunk", "i", "j").applyInArrow(run, "lang string, source string, item string, value long")
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def _outstanding(groups: DataFrame, vectors: DataFrame, shards: DataFrame, top: int) -> DataFrame:
    """lang, source, item and value of terms that a group uses more than its language: the foremost of each shard."""
    whole = _added(vectors.select("lang", "shard", "n", "counts"), ["lang", "shard"]).select("lang", "shard", F.col("counts").alias("all"))
    totals = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    rows = vectors.join(whole, ["lang", "shard"]).join(shards.select("lang", "shard", "keys"), ["lang", "shard"]).join(groups, ["lang", "source"]).join(totals, "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 200):
                out: list[tuple] = []
                for lang, source, counts, all_, keys, total, lang_total, v in zip(*(c.to_pylist() for c in b.slice(at, 200).columns)):
                    c = _unpacked(counts)
                    more = shares(c, total, v) - shares(_unpacked(all_), lang_total, v)
                    words = keys.split(b" ")
                    best = sorted((-int(more[k]), words[k]) for k in np.flatnonzero((c > 0) & (more > 0)))[:top]
                    out += [(lang, source, w, -x) for x, w in best]
                cols = list(zip(*out)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), _strings(list(cols[2])), pa.array(cols[3], pa.int64())], names=["lang", "source", "item", "value"])

    return rows.select("lang", "source", "counts", "all", "keys", "total", "lang_total", "terms").mapInArrow(run, "lang string, source string, item string, value long")


def audit(docs: DataFrame, least: int = 30, top: int = 50) -> DataFrame:
    """lang, source, part, item, value and rank: distances to the language's other sources, and foremost terms."""
    texts = _texts(docs)
    ship(docs.sparkSession)
    shards = stored(hashes(document_frequencies(texts, least)))
    vectors = stored(recounted(texts, shards))
    terms_ = shards.groupBy("lang").agg(F.sum("n").alias("terms"))
    totals = vectors.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = texts.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(terms_, "lang", "left")
    groups = stored(groups.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("terms", F.lit(0)).alias("terms")))
    both = _pairs(groups, vectors, shards).withColumn("part", F.lit("pair")).unionByName(_outstanding(groups, vectors, shards, top).withColumn("part", F.lit("term")))
    w = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), F.asc("item"))
    ranked = both.withColumn("rank", F.row_number().over(w)).filter((F.col("part") == "pair") | (F.col("rank") <= top))
    return ranked.select("lang", "source", "part", "item", "value", "rank")
