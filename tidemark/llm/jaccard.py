"""Jaccard join of documents by word shingles: a size-aware heavy-light join.

A document's set holds its distinct shingles. Two sets of n and m link if their
overlap is large enough, so each shares at least c(n) shingles with the other,
where c(n) is the threshold times n, rounded up.

1. *Cut.* Of each set the n - c(n) + k(n) shingles of the smallest hashes are
   kept; two linked sets have k of the smaller one among those of both. Equal sets
   are one from here on. Sets that share fewer kept shingles with others than any
   partner asks for are out; most documents are.
2. *Order.* The kept shingles of what is left stand rarest first. Of these again
   all but the last few suffice: linked sets share two among the first size - need
   + 2, and one among the first size - need + 1.
3. *Anchors.* A set is compared with the one document of its lists that it meets
   most often, and with other ones while long lists of several components are left.
   That joins groups of near copies, however large, by as many comparisons as they
   have members.
4. *Light and heavy.* A light set enumerates all pairs of its shingles: light sets
   that link share a pair. A heavy set scans the lists of its single shingles, in
   which light sets stand too where their size comes near. The boundary is the size
   at which pairs and scanned rows together cost least, counted from all sets.
   Lists whose members are of one component already are closed before that.
   A list of two is its pair at once and needs neither.
5. *Check.* Pairs of short lists are compared by their kept shingles, then by all.
   Lists of more than ``SHORT`` members become one where much the same sets
   stand in them, and are cut into blocks. Each pair of blocks is a task's work,
   which compares what isn't joined yet and emits one row for each two components
   that it joins. Large components have blocks of their own, of which no two are
   compared with each other.

All steps keep every link; shingles are told apart by 64 bits of hashes. Components
come from alternating star rounds.

Edge cases: a null or wordless text has no shingles and links with nothing; fewer
words than a shingle make one of all; rows with a null id are dropped; rows that
repeat an id are rows of their own, each with its own text's links; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import ship, stored
from tidemark.llm.simhash import components

#: One in so many shingles is kept on top of those that make linked sets meet.
SPARE = 16
#: Sets and shingles of one block of a list.
BLOCK_SETS, BLOCK_SHINGLES = 400, 1 << 20
#: Members of a list whose pairs are enumerated, at most.
SHORT = 100
#: Hash seeds, one for each time that similar long lists become one.
MERGES = (21, 22, 23)
#: Rounds of anchors, at most.
MOST_ROUNDS = 4
#: Size classes for each doubling of size, by which costs are added up.
CLASSES = 8

_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def shingles(raw: bytes, words: int) -> np.ndarray:
    """The distinct hashes of a text's word shingles, in order."""
    import xxhash

    # bytes.lower and bytes.split know just A-Z and the six ASCII white-space bytes
    w = raw.lower().split()
    if len(w) < words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(w), 1)] if w else [], np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, w), np.uint64, len(w))
    n = len(w) - words + 1
    x = np.zeros(n, np.uint64)
    for k in range(words):
        x += (h[k : k + n] ^ (h[k : k + n] >> np.uint64(29 + k))) * _FACTORS[k % 8]
        x *= _FACTORS[(k + 3) % 8]
    x ^= x >> np.uint64(32)
    x *= _FACTORS[0]
    x ^= x >> np.uint64(29)
    return np.unique(x)


def least(n: int, percent: int) -> int:
    """The overlap that a set of n has with any that it links with."""
    return -(-percent * n // 100)


def spare(n: int, percent: int) -> int:
    """The shared shingles that are kept on purpose: more of them cut more sets off, and cost more to move."""
    return max(min(2, least(n, percent)), n // SPARE)


def need(n: Column, percent: int) -> Column:
    """The kept shingles that a set of n shares at least with one that it links with: those spared for its smallest partner."""
    low = lambda c: F.floor((F.lit(percent) * c + 99) / 100).cast("long")
    smallest = low(n)
    return F.greatest(F.least(F.lit(2), low(smallest)), F.floor(smallest / SPARE).cast("long"))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("raw"))


def _digest(h: np.ndarray) -> tuple[int, int]:
    import xxhash

    return tuple(np.frombuffer(xxhash.xxh3_128_digest(h.tobytes()), np.int64).tolist())


def sketches(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, n, a digest of the set, and the shingles that are kept of it."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 200):  # bounds the hashes held at once
                x = b.slice(at, 200)
                sets = [shingles(raw, words) for raw in x.column(1).to_pylist()]
                d = [_digest(h) for h in sets]
                # the upper 48 bits travel lighter, and what they take for equal is told apart later
                kept = [(h[: len(h) - least(len(h), percent) + spare(len(h), percent)] >> np.uint64(16)).view(np.int64) for h in sets]
                yield pa.RecordBatch.from_arrays([x.column(0), pa.array([len(h) for h in sets], pa.int64()), pa.array([k for k, _ in d], pa.int64()), pa.array([k for _, k in d], pa.int64()), pa.array(kept, pa.list_(pa.int64()))], names=["doc_id", "n", "d1", "d2", "kept"])

    return _texts(docs).mapInArrow(run, "doc_id long, n long, d1 long, d2 long, kept array<long>")


def _whole(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, digest and all shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 200):
                x = b.slice(at, 200)
                sets = [shingles(raw, words) for raw in x.column(1).to_pylist()]
                d = [_digest(h) for h in sets]
                yield pa.RecordBatch.from_arrays([x.column(0), pa.array([k for k, _ in d], pa.int64()), pa.array([k for _, k in d], pa.int64()), pa.array([h.view(np.int64) for h in sets], pa.list_(pa.int64()))], names=["doc_id", "d1", "d2", "set"])

    return _texts(docs).mapInArrow(run, "doc_id long, d1 long, d2 long, set array<long>")


def _candidates(sets: DataFrame, percent: int) -> DataFrame:
    """row, n and own: the kept shingles that other sets keep too, rarest first, of the sets that share enough."""

    sizes = sets.select("row", "n")

    def shared(rows: DataFrame) -> DataFrame:
        df = rows.groupBy("h").agg(F.count("*").alias("df")).filter("df > 1")
        own = rows.join(df, "h").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("own"))
        return stored(own.join(sizes, "row").filter(F.size("own") >= need(F.col("n"), percent)))

    first = shared(sets.filter("n > 1").select("row", F.explode("kept").alias("h")))
    # what shared its shingles with sets that are out by now
    return shared(first.select("row", F.explode("own.h").alias("h")))


def _spans(each: DataFrame, seed: int) -> DataFrame:
    """h, many, first and last row, and anchor of the lists with members of several components."""
    to = F.min(F.struct(F.xxhash64("row", F.lit(seed)).alias("by"), "row", "component")).alias("to")
    span = each.groupBy("h").agg(F.count("*").alias("many"), F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("row").alias("a"), F.max("row").alias("b"), to)
    return stored(span.filter("lo < hi").select("h", "many", "a", "b", F.col("to.row").alias("anchor"), F.col("to.component").alias("its")))


def _anchored(each: DataFrame, span: DataFrame, whole: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of sets with the anchor that they meet most often in lists of several, where that is of another component."""
    met = each.join(span.filter("many > 2").select("h", "anchor", "its"), "h").filter("component <> its")
    best = met.groupBy("row", "anchor").agg(F.count("*").alias("times")).groupBy("row").agg(F.max_by("anchor", F.struct("times", "anchor")).alias("anchor"))
    return _compared(stored(best.select(F.col("row").alias("a"), F.col("anchor").alias("b"))), whole, percent)


def _compared(pairs: DataFrame, whole: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) of sets that link, by all their shingles.

    Pairs are narrow rows: where they are few the planner sends them to the
    sets; otherwise it splits the large partitions of a set with many partners.
    """
    both = pairs.join(whole.select(F.col("row").alias("a"), F.col("set").alias("x")), "a").join(whole.select(F.col("row").alias("b"), F.col("set").alias("y")), "b")
    n, m = F.size("x"), F.size("y")
    near = (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (F.size(F.array_intersect("x", "y")) * (100 + percent) >= percent * (n + m))
    return both.filter(near).select("a", "b")


def boundary(costs: list[tuple[int, int, int]]) -> int:
    """The largest class of light sets: (class, pairs, scanned rows) of light classes cost pairs, of the others rows."""
    costs = sorted(costs)
    best, light, heavy = None, 0, sum(c[2] for c in costs)
    at = -1
    for k, pairs, scanned in [(-1, 0, 0), *costs]:
        light, heavy = light + pairs, heavy - scanned
        if best is None or light + heavy < best:
            best, at = light + heavy, k
    return at


def _dealt(each: DataFrame, span: DataFrame, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs (a, b) of sets that a list has by themselves; key, row, component and weight of short lists; those of long ones.

    Lists whose members are of one component are closed. A pair that shares a
    list of two is one of the first result whatever else it shares; others
    share a long list or two short ones, so that these alone are enumerated or
    scanned. A weight of two makes a pair worth comparing.
    """
    twos = span.filter("many = 2").select("a", "b")
    # whoever shares a long list is compared there
    long = each.join(span.filter(F.col("many") > SHORT).select("h"), "h").select(F.col("h").alias("key"), "row", "component")
    own = each.join(span.filter((F.col("many") > 2) & (F.col("many") <= SHORT)).select("h", "many"), "h").groupBy("row").agg(F.first("n").alias("n"), F.first("component").alias("component"), F.sort_array(F.collect_list(F.struct("h", "last", "many"))).alias("own"))
    own = stored(own.withColumn("class", F.floor(F.log2("n") * CLASSES).cast("int")))
    # a class's row for each eighth of a doubling of size: some hundred rows whatever the table's size
    scanned = F.aggregate("own", F.lit(0).cast("long"), lambda s, x: s + F.when(x["last"], 0).otherwise(x["many"]))
    cost = own.groupBy("class").agg(F.sum(F.size("own").cast("decimal(38,0)") * (F.size("own") - 1) / 2).cast("decimal(38,0)").alias("pairs"), F.sum(scanned.cast("decimal(38,0)")).alias("rows")).collect()
    light = boundary([(r["class"], int(r["pairs"]), int(r["rows"])) for r in cost])
    at = F.sequence(F.lit(1), F.size("own"))
    pair = F.flatten(F.transform(at, lambda i: F.transform(F.slice("own", i + 1, F.size("own")), lambda y: F.xxhash64(F.lit(2), F.element_at("own", i)["h"], y["h"]))))
    single = F.transform("own", lambda x: F.xxhash64(F.lit(1), x["h"]))
    by_pairs = own.filter(F.col("class") <= light).select("row", "component", F.explode(pair).alias("key"), F.lit(2).alias("weight"))
    # light sets that some heavy one can link with stand in the lists too
    reach = 2.0 ** ((light + 1) / CLASSES) * percent / 100 - 1 if any(r["class"] > light for r in cost) else float("inf")
    by_lists = own.filter(F.col("n") >= reach).select("row", "component", F.explode(single).alias("key"), F.lit(1).alias("weight"))
    return twos, by_pairs.unionByName(by_lists), long


def _joined(rows: Iterator[tuple], percent: int) -> Iterator[tuple[int, int]]:
    """Pairs of components that linked sets join; rows are (key, i, j, block, component, set) in order of the first three."""
    for (_, i, j), group in groupby(rows, lambda r: r[:3]):
        sets = sorted((r[3:] for r in group), key=lambda r: len(r[2]))
        block, member = np.array([s[0] for s in sets]), np.array([s[1] for s in sets])
        size = np.array([len(s[2]) for s in sets], np.int64)
        flat, flat_at = np.unique(np.concatenate([s[2] for s in sets]), return_inverse=True)
        ends = np.cumsum(size)
        seen = np.zeros(len(flat), np.int64)
        for k in range(len(sets) - 1):
            # partners that are not too large, of another component; a pair inside one block belongs to that block's own task
            most = int(np.searchsorted(size, 100 * size[k] // percent, side="right"))
            at = np.arange(k + 1, most)
            at = at[(member[at] != member[k]) & ((i == j) | (block[at] != block[k]))]
            if not len(at):
                continue
            own = flat_at[ends[k] - size[k] : ends[k]]
            seen[own] = 1
            n = size[at]
            places = np.repeat(ends[at] - n, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            both = np.add.reduceat(seen[flat_at[places]], np.cumsum(n) - n)
            seen[own] = 0
            for other in at[(100 + percent) * both >= percent * (size[k] + n)]:
                a, b = member[k], member[other]
                if a != b:
                    yield int(a), int(b)
                    member[member == max(a, b)] = min(a, b)


def _open(keyed: DataFrame, weight: Column) -> DataFrame:
    """key and weight of the lists with members of several components: lists of the same members are one, with the weight of all."""
    one, other = (F.bit_xor(F.xxhash64("row", F.lit(k))) for k in (8, 9))
    lists = keyed.groupBy("key").agg(F.count("*").alias("many"), F.min("component").alias("lo"), F.max("component").alias("hi"), one.alias("x"), other.alias("y"), F.first(weight).alias("weight")).filter("lo < hi")
    return stored(lists.groupBy("many", "x", "y").agg(F.min("key").alias("key"), F.sum("weight").alias("weight")).select("key", "weight"))


def _paired(keyed: DataFrame) -> DataFrame:
    """Pairs (a, b) that share enough short lists; a row of a list has SHORT partners there at most."""
    short = stored(keyed.select("key", "row", "component").join(_open(keyed, F.col("weight")), "key"))
    a, b = (short.select("key", F.col("row").alias(k), F.col("component").alias(f"{k}_in"), "weight") for k in ("a", "b"))
    return a.join(b.drop("weight"), "key").filter("a < b and a_in <> b_in").groupBy("a", "b").agg(F.sum("weight").alias("weight")).filter("weight > 1").select("a", "b")


def _merged(long: DataFrame) -> DataFrame:
    """Lists whose first member by a hash is the same are one, where the blocks of all their members take fewer rows than theirs.

    The shingles of a passage that many sets hold have much the same lists; one
    list of all their members compares no pair less.
    """
    rows = lambda n: F.col(n) * F.ceil(F.col(n) / BLOCK_SETS)
    for seed in MERGES:
        lists = long.groupBy("key").agg(F.count("*").alias("many"), F.min(F.xxhash64("row", F.lit(seed))).alias("to"))
        lists = stored(lists)
        members = long.join(lists, "key").select("to", "row").distinct().groupBy("to").agg(F.count("*").alias("all"))
        better = lists.groupBy("to").agg(F.sum(rows("many")).alias("rows")).join(members, "to").filter(rows("all") < F.col("rows"))
        to = lists.join(better.select("to"), "to").select("key", "to")
        long = stored(long.join(to, "key", "left").select(F.coalesce("to", "key").alias("key"), "row", "component").distinct())
    return long


def _in_blocks(long: DataFrame, whole: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of components that linked sets of one long list join."""
    sized = stored(_merged(long).join(whole.select("row", F.size("set").cast("long").alias("n")), "row"))
    # a component that fills half a block has blocks of its own, which aren't compared with each other; the rest of a list shares its blocks
    parts = sized.groupBy("key", "component").agg(F.count("*").alias("many"), F.sum("n").alias("n")).withColumn("pool", F.when(2 * F.col("many") >= BLOCK_SETS, F.col("component")))
    parts = stored(parts)
    pools = parts.groupBy("key", "pool").agg(F.greatest(F.ceil(F.sum("many") / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("blocks"))
    whose = Window.partitionBy("key")
    pools = pools.withColumn("total", F.sum("blocks").over(whose)).withColumn("from", F.sum("blocks").over(whose.orderBy("pool")) - F.col("blocks"))
    pools = pools.select(F.col("key").alias("_key"), F.col("pool").alias("_pool"), "blocks", "total", "from")
    at = parts.join(pools, (F.col("key") == F.col("_key")) & F.col("pool").eqNullSafe(F.col("_pool"))).select("key", "component", "pool", "blocks", "total", "from")
    dealt = sized.join(stored(at), ["key", "component"]).withColumn("block", F.col("from") + F.pmod(F.xxhash64("row", F.lit(7)), F.col("blocks")))
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("total") - 1), lambda k: F.col("pool").isNull() | (k < F.col("from")) | (k >= F.col("from") + F.col("blocks")))
    dealt = dealt.withColumn("with", F.explode(others))
    dealt = stored(dealt.select("key", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "component", "row"))
    dealt = dealt.join(whole, "row").select("key", "i", "j", "block", "component", "set").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each_row() -> Iterator[tuple]:
            for b in batches:
                flat, ends = b.column(5).values.to_numpy(), b.column(5).offsets.to_numpy()
                for k, r in enumerate(zip(*(b.column(c).to_pylist() for c in range(5)))):
                    yield (*r, flat[ends[k] : ends[k + 1]])

        pairs = np.array(list(_joined(each_row(), percent)), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long").distinct()


def _checked(twos: DataFrame, keyed: DataFrame, long: DataFrame, kept: DataFrame, whole: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join components, of all sets that share a list."""
    pairs = stored(twos.unionByName(_paired(stored(keyed))).distinct())
    both = pairs.join(kept.toDF("a", "n", "x"), "a").join(kept.toDF("b", "m", "y"), "b")
    # up to the smaller of the last hashes both sets are known in full, and no more may differ there than may in all
    end = F.least(F.element_at("x", -1), F.element_at("y", -1))
    apart = F.size(F.filter("x", lambda h: h <= end)) + F.size(F.filter("y", lambda h: h <= end)) - 2 * F.size(F.array_intersect("x", "y"))
    fits = 100 * F.least("n", "m") >= percent * F.greatest("n", "m")
    near = both.filter(fits).filter(apart * (100 + percent) <= (F.col("n") + F.col("m")) * (100 - percent)).select("a", "b")
    return _compared(stored(near), whole, percent).unionByName(_in_blocks(long, whole, percent))


def linked(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id, the smallest doc_id that links reach."""
    if not 50 < percent <= 100:
        raise ValueError("sets must share more than half of all that they hold")
    sets = stored(sketches(docs, words, percent).withColumn("row", F.monotonically_increasing_id()))
    narrow = sets.select("row", "doc_id", "n", "d1", "d2")
    # equal sets: the row that stands for each, and those that it stands for
    same = narrow.filter("n > 0").groupBy("d1", "d2").agg(F.min("row").alias("first"), F.count("*").alias("many")).filter("many > 1")
    same = stored(narrow.join(same.select("d1", "d2", "first"), ["d1", "d2"]).select("row", "first"))
    # as a table of its own, it is broadcast where the planner's size check allows
    gone = stored(same.filter("row <> first").select("row"))
    one_each = sets.select("row", "n", "kept").join(gone, "row", "left_anti")
    left = _candidates(one_each, percent)
    rows = stored(left.select("row"))
    sets_left = rows.count()
    keys = stored(narrow.join(rows, "row").select("row", "doc_id", "d1", "d2"))
    ids = stored(keys.select(F.col("doc_id").alias("_id")).distinct())
    texts = docs.join(ids, F.col("doc_id").cast("long") == F.col("_id"), "left_semi")
    # a row of an id and text that are repeated may stand here twice, which changes no link
    whole = stored(_whole(texts, words).join(keys, ["doc_id", "d1", "d2"]).select("row", "set"))
    # two of the shingles are needed from these for a pair, one from all but the last of them
    prefix = F.slice("own", 1, (F.size("own") - need(F.col("n"), percent) + 2).cast("int"))
    lists = left.select("row", "n", F.size(prefix).alias("size"), F.posexplode(prefix).alias("at", "x"))
    lists = stored(lists.select("row", "n", F.col("x.h").alias("h"), (F.col("at") == F.col("size") - 1).alias("last")))
    edges, found, k = None, None, 0
    while True:
        group = rows if found is None else rows.join(found.withColumnRenamed("node", "row"), "row", "left")
        each = stored(lists.join(group.select("row", F.coalesce(*([] if found is None else ["component"]), "row").alias("component")), "row"))
        span = _spans(each, k)
        # again while what stands in long lists is more than the sets, since blocks would cost more than anchors
        if k == MOST_ROUNDS or k and (span.filter(F.col("many") > SHORT).agg(F.sum("many")).first()[0] or 0) <= sets_left:
            break
        new = stored(_anchored(each, span, whole, percent))
        edges = new if edges is None else edges.unionByName(new)
        found, k = components(edges), k + 1
    kept = stored(sets.select("row", "n", "kept").join(rows, "row", "left_semi"))
    joined = stored(_checked(*_dealt(each, span, percent), kept, whole, percent))
    found = components(joined if edges is None else edges.unionByName(joined))
    # every row that is not alone, and the smallest id that it reaches
    members = same.unionByName(found.select(F.col("node").alias("row"), F.col("node").alias("first"))).distinct()
    members = members.join(found, F.col("first") == F.col("node"), "left").select("row", F.coalesce("component", "first").alias("group")).distinct()
    members = stored(members.join(narrow.select("row", "doc_id"), "row"))
    smallest = members.groupBy("group").agg(F.min("doc_id").alias("component_id"))
    reached = members.select("row", "group").join(smallest, "group").select("row", "component_id")
    return narrow.join(reached, "row", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
