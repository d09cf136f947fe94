"""SimHash near duplicates by a binary trie self-join.

``fingerprints`` gives every text a 64-bit SimHash. ``links`` joins the
distinct fingerprints with themselves: three tries, each with another third of
the bits in front, are cut at their first bits into groups, as many bits as keep
the groups' size as the table grows; a group that is larger all the same is cut
into blocks, each pair of which is a task's work. Inside a group pairs of trie nodes are walked together, level by level, with the
differing bits added up, and a pair of nodes goes as soon as it exceeds the
error budget. Four differing bits leave one of the first two thirds with at
most one, or the last with none, so each trie walks its first third with that
smaller budget and the rest with the whole one: no link is lost. ``components``
joins the links to groups by alternating large-star and small-star rounds.

``near_duplicates`` can look further than the budget that is a link by itself:
texts then count as linked if their sets of word shingles are as similar as
asked for. Texts that share one of 40 bands of four MinHash values are looked
at, which a pair similar to 0.8 fails to do with a chance of 7e-10 and more
similar ones far more seldom; the similarity is worked out from the whole sets,
for each pair that nothing has linked yet. Buckets of many texts are cut into
blocks, and each pair of blocks is a task's work.

Copies share a fingerprint, so a group of any size is one leaf; a task joins
what it links as it goes, leaves out node pairs that are one component already,
and passes on one edge for each fingerprint at most, never all pairs of a group.

Edge cases: a null or wordless text has fingerprint zero and is linked like
any other; fewer words than a shingle make one shingle of all; rows with a
null id are dropped, repeated ids collapse to one row; an empty table gives no
rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import hex64, ship, stored

#: MinHash bands and values in each: 0.8 ** 4 of the pairs similar to 0.8 share a given band, so (1 - 0.8 ** 4) ** 40 = 7e-10 share none.
BANDS, ROWS = 40, 4

#: Texts and shingles of one block of a bucket.
BLOCK_TEXTS, BLOCK_SHINGLES = 400, 1 << 20

#: First bit and length of the part of the fingerprint that stands in front of each trie.
PARTS = ((0, 21), (21, 21), (42, 22))


def allowed(budget: int) -> list[int]:
    """The differing bits allowed in each part: with one more in all three the budget would be exceeded."""
    total = max(0, budget - 2)
    return [total // 3 + (k < total % 3) for k in range(3)]


def _simhash(texts: list, words: int) -> np.ndarray:
    import xxhash

    digest = xxhash.xxh64_intdigest
    hashes: list[int] = []
    sizes = np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        # bytes.lower and bytes.split know just A-Z and the six ASCII white-space bytes
        w = (text or "").encode("utf-8", "surrogatepass").lower().split()
        n = len(w)
        if not n:
            continue
        if n <= words:
            own = [digest(b" ".join(w), 42)]
        else:
            flat, at = b" ".join(w), 0
            ends = np.cumsum(np.fromiter(map(len, w), np.int64, n) + 1) - 1
            starts = np.concatenate(([0], ends[:-1] + 1))[: n - words + 1].tolist()
            own = [digest(flat[a:b], 42) for a, b in zip(starts, ends[words - 1 :].tolist())]
        hashes += own
        sizes[k] = len(own)
    out = np.zeros(len(texts), np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        bits = np.unpackbits(np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        starts = np.concatenate(([0], np.cumsum(sizes[full])[:-1]))
        ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        out[full] = np.packbits(ones * 2 > sizes[full, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """doc_id and fp, the SimHash of lower-cased word shingles as a signed long."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 200):  # bounds the hashes held at once
                x = b.slice(at, 200)
                fp = _simhash(x.column(1).to_pylist(), words)
                yield pa.RecordBatch.from_arrays([x.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return _texts(docs).mapInArrow(run, "doc_id long, fp long")


def _rotated(x: np.ndarray, first: int) -> np.ndarray:
    """Fingerprints with the bits from ``first`` on (counted from the top) in front."""
    return x if not first else (x << np.uint64(first)) | (x >> np.uint64(64 - first))


class Joined:
    """Components of leaves that grow by links: ``up`` has the smallest leaf of each one's component."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)
        self.changes: np.ndarray | None = None

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        u, v = self.up[i], self.up[j]
        while len(at := np.flatnonzero(u != v)):
            low, high = np.minimum(u[at], v[at]), np.maximum(u[at], v[at])
            # a component hangs on the smallest of those it meets; the others meet that one in the next round
            np.minimum.at(self.up, high, low)
            while not np.array_equal(top := self.up[self.up], self.up):
                self.up = top
            u, v = self.up[low], self.up[high]
            self.changes = None

    def settled(self, a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> np.ndarray:
        """Whether all leaves of both ranges are of one component."""
        if self.changes is None:
            self.changes = np.concatenate(([0], np.cumsum(self.up[1:] != self.up[:-1])))
        c = self.changes
        return (c[a1 - 1] == c[a0]) & (c[b1 - 1] == c[b0]) & (self.up[a0] == self.up[b0])


def _walk(leaves: np.ndarray, home: tuple[int, int], guest: tuple[int, int], front: int, length: int, most: int, budget: int, joined: Joined, block: int = 1 << 20) -> None:
    """Link the leaves of two ranges, or of one with itself, that are within the budget.

    Each range is sorted and shares its first bits. A frontier holds pairs of
    trie nodes as ranges of leaves. Each step splits one node pair by the next
    bit into up to four, adds the differing bit, and drops pairs beyond the
    budget; small pairs are compared.
    """
    same = home == guest
    start = int(np.bitwise_count((leaves[home[0]] ^ leaves[guest[0]]) >> np.uint64(64 - front))) if front else 0
    stack = [(front, np.array([[*home, *guest, start]], np.int64))]
    while stack:
        bit, nodes = stack.pop()
        if len(nodes) > block:  # depth first over blocks, so that the frontier stays bounded
            stack += [(bit, nodes[i : i + block]) for i in range(0, len(nodes), block)]
            continue
        nodes = nodes[~joined.settled(*nodes[:, :4].T)]
        size = (nodes[:, 1] - nodes[:, 0]) * (nodes[:, 3] - nodes[:, 2])
        done = (size <= 64) | (bit == 64)
        if done.any():
            _compared(leaves, nodes[done], same, length, most, budget, joined)
            nodes = nodes[~done]
        if not len(nodes):
            continue
        mask = np.uint64(1 << (63 - bit))
        # the first leaf of each node that has the bit set: leaves are sorted
        cut_a = _cut(leaves, nodes[:, 0], nodes[:, 1], mask)
        cut_b = _cut(leaves, nodes[:, 2], nodes[:, 3], mask)
        limit = most if bit < length else budget
        kids = []
        for low_a in (True, False):
            for low_b in (True, False):
                a0, a1 = (nodes[:, 0], cut_a) if low_a else (cut_a, nodes[:, 1])
                b0, b1 = (nodes[:, 2], cut_b) if low_b else (cut_b, nodes[:, 3])
                d = nodes[:, 4] + (low_a != low_b)
                ok = (a1 > a0) & (b1 > b0) & (d <= limit)
                if same:  # each unordered pair of nodes once
                    ok &= a0 <= b0
                kids.append(np.stack([a0, a1, b0, b1, d], axis=1)[ok])
        stack.append((bit + 1, np.concatenate(kids)))


def _cut(leaves: np.ndarray, lo: np.ndarray, hi: np.ndarray, mask: np.uint64) -> np.ndarray:
    """The first leaf of each range, whose leaves share all bits above the mask's, that has the mask's bit."""
    lo, end = lo.copy(), hi
    hi = hi.copy()
    while len(at := np.flatnonzero(lo < hi)):
        mid = (lo[at] + hi[at]) >> 1
        one = (leaves[mid] & mask) != 0
        hi[at[one]] = mid[one]
        lo[at[~one]] = mid[~one] + 1
    return np.minimum(lo, end)


def _compared(leaves, nodes, same, length, most, budget, joined, block: int = 1 << 16) -> None:
    total = np.cumsum((nodes[:, 1] - nodes[:, 0]) * (nodes[:, 3] - nodes[:, 2]))
    lo = 0
    while lo < len(nodes):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + block)))
        x = nodes[lo:hi]
        lo = hi
        x = x[~joined.settled(*x[:, :4].T)]
        n, m = x[:, 1] - x[:, 0], x[:, 3] - x[:, 2]
        size = n * m
        k = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        wide = np.repeat(m, size)
        i, j = np.repeat(x[:, 0], size) + k // wide, np.repeat(x[:, 2], size) + k % wide
        if same:
            i, j = i[i < j], j[i < j]
        d = leaves[i] ^ leaves[j]
        ok = (np.bitwise_count(d) <= budget) & (np.bitwise_count(d >> np.uint64(64 - length)) <= most)
        joined.add(i[ok], j[ok])


#: Fingerprints of a group, and of a block of a group, about.
GROUP, BLOCK = 256, 20_000


def links(nodes: DataFrame, budget: int = 4, front: int | None = None, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) of node ids for nodes(node, fp) that join all distinct fingerprints that ``budget`` bits or fewer part.

    ``front`` bits of each trie pick the group, so there are 3 * 2 ** front
    groups; a fingerprint visits the groups within the budget of that trie's
    first part. Without it the number of nodes sets it.
    """
    from itertools import combinations

    ship(nodes.sparkSession)
    limits = allowed(budget)
    if front is None:
        front = min(20, max(4, (nodes.count() // GROUP).bit_length()))
    ups = []
    for k, ((first, _), most) in enumerate(zip(PARTS, limits)):
        turned = F.col("fp") if not first else F.call_function("shiftleft", F.col("fp"), F.lit(first)).bitwiseOR(F.call_function("shiftrightunsigned", F.col("fp"), F.lit(64 - first)))
        key = F.call_function("shiftrightunsigned", turned, F.lit(64 - front)).cast("int")
        masks = [sum(1 << i for i in c) for n in range(1, most + 1) for c in combinations(range(front), n)]
        # itself at home, and as a guest with each neighbour of a smaller key
        keyed = nodes.select("node", "fp", key.alias("key"))
        near = F.filter(F.transform(F.array(*[F.lit(m) for m in masks]) if masks else F.array().cast("array<int>"), lambda m: m.bitwiseXOR(F.col("key"))), lambda x: x < F.col("key"))
        where = F.concat(F.array(F.struct(F.col("key").alias("home"), F.lit(-1).alias("guest"))), F.transform(near, lambda x: F.struct(x.alias("home"), F.col("key").alias("guest"))))
        ups.append(keyed.select("node", "fp", F.lit(k).alias("trie"), F.explode(where).alias("w")).select("trie", "w.home", "w.guest", "node", "fp"))
    both = ups[0].unionByName(ups[1]).unionByName(ups[2])
    # the few groups that are larger than a block
    full = stored(both.groupBy("trie", "home").agg(F.ceil(F.count("*") / block).alias("blocks")).filter("blocks > 1"))
    both = both.join(full, ["trie", "home"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    both = both.withColumn("own", F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks"))).withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    both = both.withColumns({"i": F.least("own", "with"), "j": F.greatest("own", "with")}).select("trie", "home", "i", "j", "own", "guest", "node", "fp")

    def run(key, t):
        (first, length), most = PARTS[key[0].as_py()], limits[key[0].as_py()]
        fp, node, by, own = (t.column(c).to_numpy() for c in ("fp", "node", "guest", "own"))
        turned = _rotated(fp.view(np.uint64), first)
        order = np.lexsort((turned, by, own))
        turned, node, by, own = turned[order], node[order], by[order], own[order]
        # ranges of one block and one guest key (or none, at home)
        cuts = np.flatnonzero((np.diff(by) != 0) | (np.diff(own) != 0)) + 1
        ranges = list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(by)]))
        joined = Joined(len(node))
        apart = key[2].as_py() != key[3].as_py()
        homes = [x for x in ranges if by[x[0]] == -1]
        for n, home in enumerate(homes):
            for guest in [*homes[n:], *(x for x in ranges if by[x[0]] != -1)]:
                # blocks of their own are compared inside by their own task
                if not apart or own[home[0]] != own[guest[0]]:
                    _walk(turned, home, guest, front, length, most, budget, joined)
        at = np.flatnonzero(joined.up != np.arange(len(node)))
        a, b = node[joined.up[at]], node[at]
        return pa.table({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})

    return both.groupBy("trie", "home", "i", "j").applyInArrow(run, "a long, b long")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node and component, the smallest node it reaches, for each node of edges(a, b).

    Large-star, then small-star: each round links a node's larger neighbours,
    then itself and its smaller ones, to the smallest. Rounds are O(log^2 n).
    """
    def smallest(e: DataFrame, key: str) -> DataFrame:
        return e.groupBy(key).agg(F.min("m").alias("m"))

    e = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct())
    seen = None
    for _ in range(rounds):
        # large star
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).filter("a <> b").distinct()
        # small star: a < b in each edge, so the neighbours a of b are its smaller ones
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").select(F.col("m").alias("a"), F.when(F.col("a") == F.col("m"), F.col("b")).otherwise(F.col("a")).alias("b"))
        e = stored(small.filter("a <> b").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(e.select("a", F.col("a").alias("component")).distinct().toDF("node", "component"))


def _shingles(text: str | None, words: int) -> np.ndarray:
    """The distinct hashes of a text's word shingles, sorted; fewer words make one shingle of all."""
    import xxhash

    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return np.unique(np.array([xxhash.xxh64_intdigest(b" ".join(w[k : k + words]), 43) for k in range(max(1, len(w) - words + 1))], np.uint64))


def _bands(h: np.ndarray, masks: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The keys of a set's MinHash bands; equal keys of different bands are as good as impossible."""
    low = np.full(len(masks), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(h), 2048):
        np.minimum(low, ((h[None, at : at + 2048] ^ masks[:, None]) * factors[:, None]).min(axis=1), out=low)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in low.reshape(BANDS, ROWS).T:
        key = (key ^ column) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key


def sketches(docs: DataFrame, words: int, shingle: int) -> DataFrame:
    """doc_id, fp, the hash ``own`` and the size of the set of word shingles, and the keys of its bands."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        rng = np.random.default_rng(42)
        masks, factors = rng.integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64, endpoint=False)
        factors |= np.uint64(1)
        for b in batches:
            for at in range(0, b.num_rows, 200):  # bounds the hashes held at once
                x = b.slice(at, 200)
                texts = x.column(1).to_pylist()
                sets = [_shingles(t, shingle) for t in texts]
                own = np.array([xxhash.xxh64_intdigest(h.tobytes()) for h in sets], np.uint64).view(np.int64)
                keys = np.concatenate([_bands(h, masks, factors) for h in sets]).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(keys) + 1, BANDS), pa.int32()), pa.array(keys))
                fp = _simhash(texts, words).view(np.int64)
                yield pa.RecordBatch.from_arrays([x.column(0), pa.array(fp), pa.array(own), pa.array(map(len, sets), pa.int32()), lists], names=["doc_id", "fp", "own", "size", "keys"])

    return _texts(docs).mapInArrow(run, "doc_id long, fp long, own long, size int, keys array<long>")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _shingled(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, own and the set of hashes of the text's word shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            for at in range(0, b.num_rows, 200):
                x = b.slice(at, 200)
                sets = [_shingles(t, words) for t in x.column(1).to_pylist()]
                own = np.array([xxhash.xxh64_intdigest(h.tobytes()) for h in sets], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([x.column(0), pa.array(own), pa.array([h.view(np.int64) for h in sets], pa.list_(pa.int64()))], names=["doc_id", "own", "set"])

    return _texts(docs).mapInArrow(run, "doc_id long, own long, set array<long>")


def _verified(rows: Iterator[tuple], similarity: float, wide: int) -> Iterator[tuple[int, int]]:
    """Pairs of components that similar texts join; rows are (bucket, i, j, block, component, fp, set) in order of the first three."""
    for (_, i, j), group in groupby(rows, lambda r: r[:3]):
        texts = sorted(((*r[3:6], set(r[6].tolist())) for r in group), key=lambda r: len(r[3]))
        left = len({r[1] for r in texts})
        up: dict[int, int] = {}

        def top(u: int) -> int:
            while (p := up.get(u, u)) != u:
                up[u] = up.get(p, p)
                u = p
            return u

        for n, (block, a, fp, p) in enumerate(texts):
            for other, b, fq, q in texts[n + 1 :]:
                # with one component left nothing can be joined
                if left == 1 or len(p) < similarity * len(q):
                    break
                # a pair inside one block belongs to that block's own task
                if i != j and block == other or (u := top(a)) == (v := top(b)) or ((fp ^ fq) & (1 << 64) - 1).bit_count() > wide:
                    continue
                both = len(p & q)
                if both >= similarity * (len(p) + len(q) - both):
                    up[max(u, v)] = min(u, v)
                    left -= 1
                    yield a, b


def similar(docs: DataFrame, sketched: DataFrame, known: DataFrame, similarity: float, words: int, wide: int = 64) -> DataFrame:
    """Edges (a, b) of components that texts join whose sets of word shingles have the Jaccard similarity.

    sketched is what ``sketches`` gives; known(fp, component) has each fingerprint's component so far.
    """
    # texts of equal shingles and fingerprints are one, joined after that
    each = sketched.groupBy("fp", "own").agg(F.min("doc_id").alias("doc_id"), F.first("size").alias("size"), F.first("keys").alias("keys"))
    each = stored(each.join(known, "fp").select("fp", "own", "doc_id", "component", "size", "keys"))
    # most buckets hold one text; narrow rows find the others, and texts' other figures are added to those alone
    rows = each.select("doc_id", "component", F.explode("keys").alias("key"))
    keys = stored(rows.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("key"))
    met = stored(rows.join(keys, "key").select("key", "doc_id").distinct())
    found = met.join(each.select("doc_id", "own", "fp", "component", "size"), "doc_id")
    buckets = found.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("shingles"), F.sum(F.xxhash64("fp", "own").cast("decimal(38,0)")).alias("members"))
    # buckets of the same texts are one
    buckets = buckets.groupBy("n", "members").agg(F.min("key").alias("key"), F.max("shingles").alias("shingles"))
    buckets = stored(buckets.select("key", F.greatest(F.ceil(F.col("n") / BLOCK_TEXTS), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).alias("blocks")))
    found = found.join(buckets, "key").withColumn("block", F.pmod(F.xxhash64("fp", "own", F.lit(7)), F.col("blocks")))
    found = stored(found.select("key", "block", "blocks", "doc_id", "own", "fp", "component"))
    # as tables of their own, ids are broadcast where the planner's size check allows, so that texts need not move
    ids = stored(found.select(F.col("doc_id").alias("_id")).distinct())
    sets = docs.join(ids, F.col("doc_id").cast("long") == F.col("_id"), "left_semi")
    sets = stored(_shingled(sets, words).dropDuplicates(["doc_id", "own"]))
    dealt = found.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"i": F.least("block", "with"), "j": F.greatest("block", "with")}).join(sets, ["doc_id", "own"])
    dealt = dealt.select("key", "i", "j", "block", "component", "fp", "set").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each_row() -> Iterator[tuple]:
            for b in batches:
                flat, ends = b.column(6).values.to_numpy(), b.column(6).offsets.to_numpy()
                for k, r in enumerate(zip(*(b.column(c).to_pylist() for c in range(6)))):
                    yield (*r, flat[ends[k] : ends[k + 1]])

        pairs = np.array(list(_verified(each_row(), similarity, wide)), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(pairs.min(axis=1)), pa.array(pairs.max(axis=1))], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, words: int = 4, budget: int = 4, wide: int | None = None, similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """doc_id, fp and component_id, the smallest doc_id that links reach.

    Fingerprints at most ``budget`` bits apart are linked. With ``wide`` so are
    those up to that many bits apart (64: any) whose texts have the similarity,
    by shingles of ``shingle`` words.
    """
    seen = stored(fingerprints(docs, words) if wide is None else sketches(docs, words, shingle))
    fps = seen.select("doc_id", "fp")
    nodes = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("node")))
    found = components(links(nodes, budget))
    if wide is not None:
        group = nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component"))
        edges = stored(similar(docs, seen, group, similarity, shingle, wide))
        found = components(found.toDF("a", "b").filter("a <> b").unionByName(edges))
    group = nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return fps.distinct().join(group, "fp")


def report(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", hex64(F.col("fp")).alias("fingerprint"), "component_id")
