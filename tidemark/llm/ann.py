"""Nearest neighbours by inner product: an inverted file with product-quantised residuals.

``fit`` learns coarse centroids and residual codebooks from a bounded sample
with the longest vectors among it. ``calibrated`` then searches some of the
queries by brute force over all vectors and takes as many probed lists and
reranked candidates as their true neighbours need, whatever the distribution. Every vector is then indexed under its centroid with the codes of its
residual. Lists are packed into shards of bounded size, and a query goes once
to each shard that holds a list it probes. There its lists are scanned by
asymmetric distance tables, the best candidates are reranked by exact products
of the original vectors in double precision, and one row goes on: the ``k + 1``
best. What a query sends and yields so grows with the shards it probes, never
with the entries in them, and vectors are moved once.

Beyond a thousand lists the centroids have two levels, a coarse one and a
shared one for what is left of it, so that lists keep their size as the table
grows; both are learned from the bounded sample.

Equal vectors form one class: a class is indexed once and stands for its
``k + 1`` smallest ids, which are all that any answer can hold, so that a vector
shared by a third of all rows is one entry. A list larger than a shard is cut
by a hash; the queries of a hot shard are cut into parts.

Edge cases: vectors that are null, empty, zero, of another length than most, or
hold null or non-finite components take no part; null ids neither; repeated
rows count once; fewer than k candidates give all of them; ties go to the
smaller id; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import ship, stored


@dataclass(frozen=True)
class AnnParams:
    k: int = 20
    #: Bound on the vectors that the index is fitted on; a hash of the id picks them.
    max_sample: int = 20_000
    #: Coarse lists: half the square root of the number of distinct vectors, within this bound.
    max_lists: int = 1024
    #: Beyond that bound a list is cut by second-level centroids, so that it holds so many vectors on average.
    list_size: int = 4096
    subvectors: int = 16
    codes: int = 256
    #: Candidates of each query and shard that are reranked, as a multiple of k + 1.
    rerank: int = 12
    #: Recall on the sample from which the number of probed lists is taken.
    recall: float = 0.985
    #: The longest vectors that the sample holds besides, and the queries that are searched by brute force.
    longest: int = 1000
    tried: int = 64
    #: Entries of a shard, and queries of a part of a shard, at most, about.
    shard: int = 16_384
    part: int = 20_000


@dataclass(frozen=True)
class Index:
    coarse: np.ndarray
    fine: np.ndarray  # of what the coarse centroid leaves; one row of zeros without a second level
    books: np.ndarray  # subvector, code, dimension
    probes: int
    scale: float = 1.0  # by which vectors are divided, so that squares stay finite
    reranked: int = 0  # candidates of each query and shard, at least

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return (x.astype(np.float64) / self.scale).astype(np.float32)

    def __len__(self) -> int:
        return len(self.coarse) * len(self.fine)

    def centroid(self, lists: np.ndarray) -> np.ndarray:
        return self.coarse[lists // len(self.fine)] + self.fine[lists % len(self.fine)]

    def lists(self, x: np.ndarray) -> np.ndarray:
        """The list of each vector: the nearest centroid of either level."""
        at = _nearest(x, self.coarse)
        return at * len(self.fine) + _nearest(x - self.coarse[at], self.fine)

    def encode(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        r = (x - self.centroid(at)).reshape(len(x), len(self.books), -1)
        return np.stack([_nearest(r[:, j], book).astype(np.uint8) for j, book in enumerate(self.books)], axis=1)

    def products(self, q: np.ndarray) -> np.ndarray:
        """The product of each query and each list's centroid."""
        return ((q @ self.coarse.T)[:, :, None] + (q @ self.fine.T)[:, None, :]).reshape(len(q), -1)

    def probed(self, q: np.ndarray) -> np.ndarray:
        """The lists of the largest products of query and centroid."""
        out = [np.zeros((0, self.probes), np.int64)]
        step = max(1, (1 << 22) // len(self))  # bounds the products held at once
        for at in range(0, len(q), step):
            s = -self.products(q[at : at + step])
            out.append(np.argpartition(s, self.probes - 1, axis=1)[:, : self.probes])
        return np.concatenate(out)


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmax(x @ c.T - 0.5 * (c**2).sum(1), axis=1)


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        at = _nearest(x, c)
        order = np.argsort(at, kind="stable")
        ids, start = np.unique(at[order], return_index=True)
        c[ids] = np.add.reduceat(x[order], start, axis=0) / np.diff([*start, len(x)])[:, None]
        empty = np.setdiff1d(np.arange(k), ids)
        if len(empty):
            c[empty] = x[rng.choice(len(x), len(empty))]
    return c


def fit(x: np.ndarray, n: int, params: AnnParams) -> Index:
    """An index for n vectors from a sample x of them."""
    rng = np.random.default_rng(0)
    n_lists = int(min(params.max_lists, max(1, round(n**0.5 / 2)), len(x)))
    coarse = _kmeans(x, n_lists, 10, rng)
    left = x - coarse[_nearest(x, coarse)]
    n_fine = int(min(params.max_lists, max(1, n // (n_lists * params.list_size)), len(x)))
    fine = _kmeans(left, n_fine, 10, rng) if n_fine > 1 else np.zeros((1, x.shape[1]), np.float32)
    m = max(d for d in range(1, min(params.subvectors, x.shape[1]) + 1) if x.shape[1] % d == 0)
    r = (left - fine[_nearest(left, fine)]).reshape(len(x), m, -1)
    books = np.stack([_kmeans(np.ascontiguousarray(r[:, j]), min(params.codes, len(x)), 8, rng) for j in range(m)])
    # probes: how deep in its order of lists a sample query meets its neighbours within the sample
    ix, depth = Index(coarse, fine, books, 1), []
    at = ix.lists(x)
    for one in rng.choice(len(x), min(300, len(x)), replace=False):
        near = np.argsort(-(x @ x[one]))[1 : params.k + 1]
        s = ix.products(x[one : one + 1])[0]
        depth.append(len(s) - np.searchsorted(np.sort(s), s[at[near]], "right"))
    met = np.sort(np.concatenate(depth))
    probes = int(met[min(len(met) - 1, int(len(met) * params.recall))]) + 1 if len(met) else 1
    return Index(coarse, fine, books, probes)


def _unit(q: np.ndarray) -> np.ndarray:
    """Queries of greatest component 1, which have the same neighbours."""
    q = q.astype(np.float64)
    return (q / np.abs(q).max(axis=1, keepdims=True)).astype(np.float32)


def _estimates(index: Index, batch: pa.RecordBatch, q: np.ndarray) -> np.ndarray:
    """The products of a batch of entries, as their lists and codes have them, with each query."""
    code = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
    near = index.centroid(batch.column(0).to_numpy()) + index.books[np.arange(len(index.books)), code].reshape(batch.num_rows, -1)
    return near @ _unit(q).T


def calibrated(index: Index, entries: DataFrame, q: np.ndarray, params: AnnParams) -> Index:
    """The index with the probes and candidates that the true neighbours of the queries q need, found by brute force over all entries."""
    k = params.k + 1

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                s = _matrix(b.column(3)).astype(np.float64) @ q.astype(np.float64).T
                top = np.argpartition(-s, min(k, len(s)) - 1, axis=0)[:k]
                one = np.tile(np.arange(len(q)), (len(top), 1))
                near = _estimates(index, b, q)
                yield pa.RecordBatch.from_arrays([pa.array(one.ravel(), pa.int32()), pa.array(-s[top, one].ravel()), pa.array(near[top, one].ravel().astype(np.float64)), b.column(0).take(pa.array(top.ravel()))], names=["one", "away", "near", "list"])

    found = entries.mapInArrow(best, "one int, away double, near double, list int")
    # k rows of each of the tried queries
    found = found.groupBy("one").agg(F.slice(F.array_sort(F.collect_list(F.struct("away", "near", "list"))), 1, k).alias("b")).select("one", F.inline("b")).toArrow()
    one, near, lists = (found.column(c).to_numpy() for c in ("one", "near", "list"))
    s = index.products(_unit(q))
    depth = np.array([(s[o] > s[o, at]).sum() for o, at in zip(one, lists)])

    def beyond(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(one), np.int64)
        for b in batches:
            if b.num_rows:
                e = np.sort(_estimates(index, b, q), axis=0)
                for o in range(len(q)):
                    n[one == o] += len(e) - np.searchsorted(e[:, o], near[one == o], "right")
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(one)), pa.int32()), pa.array(n)], names=["at", "n"])

    ahead = entries.mapInArrow(beyond, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow().column("n").to_numpy()
    deep = lambda n: int(np.quantile(n, params.recall, method="higher")) + 1
    return replace(index, probes=min(len(index), max(index.probes, deep(depth))), reranked=deep(ahead))


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column whose rows have one length as a matrix."""
    if not len(column):
        return np.zeros((0, 0), np.float32)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (array<float>) of the rows that take part, each once."""
    e = F.col("embedding")
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.cast("array<float>").alias("embedding")).filter(F.col("vec_id").isNotNull() & (F.size("embedding") > 0))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    v = v.filter(~F.exists("embedding", bad) & F.exists("embedding", lambda x: x != 0))
    most = v.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return v.filter(F.size("embedding") == (most["d"] if most else 0))


def packed(sizes: dict[int, int], shard: int) -> list[tuple[int, int, int]]:
    """(list, number of its pieces, first shard) for each list: lists in order fill shards of about the size; a larger list has shards of its own."""
    out, at, held = [], 0, 0
    for one, n in sorted(sizes.items()):
        pieces = max(1, -(-n // shard))
        if held and (pieces > 1 or held + n > shard):
            at, held = at + 1, 0
        out.append((one, pieces, at))
        at, held = (at + pieces, 0) if pieces > 1 else (at, held + n)
    return out


class Shard:
    """The entries of one shard, by list, and the search of queries among them."""

    def __init__(self, index: Index, lists: np.ndarray, cls: np.ndarray, code: np.ndarray, x: np.ndarray, params: AnnParams) -> None:
        order = np.lexsort((cls, lists))
        self.ix, self.p = index, params
        self.cls, self.code, self.x = cls[order], code[order], x[order]
        self.lists, start = np.unique(lists[order], return_index=True)
        self.bounds = np.append(start, len(lists))
        self.centroids = index.centroid(self.lists)

    def search(self, q: np.ndarray, probed: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(scores, classes) of each query's k + 1 best, best first; probed has the lists that each query scans."""
        kept = min(len(self.cls), max((self.p.k + 1) * self.p.rerank, self.ix.reranked))
        step = max(1, min(128, (1 << 21) // len(self.cls), (1 << 22) // (kept * q.shape[1])))  # bounds the sums and products held at once
        for at in range(0, len(q), step):
            yield from self._some(q[at : at + step], probed[at : at + step])

    def _some(self, q: np.ndarray, probed: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        books, keep, best = self.ix.books, max((self.p.k + 1) * self.p.rerank, self.ix.reranked), self.p.k + 1
        scaled = _unit(q)
        near = np.full((len(q), len(self.cls)), -np.inf, np.float32)
        tables = np.einsum("qjd,jcd->qjc", scaled.reshape(len(q), len(books), -1), books).transpose(1, 0, 2)
        first = scaled @ self.centroids.T
        for k, one in enumerate(self.lists):
            rows = np.flatnonzero([one in p for p in probed])
            if not len(rows):
                continue
            a, b = self.bounds[k], self.bounds[k + 1]
            sums = np.repeat(first[rows, k][:, None], b - a, axis=1)
            for j in range(len(books)):
                sums += np.take(tables[j][rows], self.code[a:b, j], axis=1)
            near[rows, a:b] = sums
        top = np.argpartition(-near, keep - 1, axis=1)[:, :keep] if near.shape[1] > keep else np.tile(np.arange(near.shape[1]), (len(q), 1))
        seen = np.take_along_axis(near, top, axis=1) > -np.inf
        exact = (self.x[top].astype(np.float64) * q[:, None, :].astype(np.float64)).sum(axis=2)
        exact[~seen] = -np.inf
        order = np.lexsort((self.cls[top], -exact), axis=1)[:, :best]
        for row in range(len(q)):
            o = order[row][seen[row, order[row]]]
            yield exact[row, o], self.cls[top[row, o]]


def search(vectors: DataFrame, is_query, params: AnnParams = AnnParams()) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest of each row for which the condition ``is_query`` holds."""
    spark = vectors.sparkSession
    ship(spark)
    k = params.k
    v = usable(vectors).withColumn("vh", F.xxhash64("embedding"))
    w = Window.partitionBy("vh", "embedding").orderBy("vec_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # rank and filter side by side: each task passes on k + 1 rows of a class at most
    members = v.distinct().withColumn("rn", F.row_number().over(w)).withColumn("cls", F.first("vec_id").over(w)).filter(F.col("rn") <= k + 1)
    members = stored(members.select("cls", "vec_id", "vh", F.when(F.col("rn") == 1, F.col("embedding")).alias("embedding"), "rn"))
    classes = members.filter("rn = 1").select("cls", "vh", "embedding")
    n = classes.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    queries = v.filter(is_query).select(F.col("vec_id").alias("query_id"), "vh", "embedding").distinct()
    queries = stored(queries.join(classes, ["vh", "embedding"]).select("query_id", "cls"))
    asked = queries.select("cls").distinct().join(classes, "cls").select(F.col("cls").alias("q"), "embedding")

    part = min(1.0, params.max_sample / n)
    sample = classes.filter(F.pmod(F.xxhash64("cls", F.lit(5)), F.lit(1_000_000)) < max(1, round(part * 1_000_000))).select("cls", "embedding").toArrow()  # bounded by max_sample
    if not sample.num_rows:
        sample = classes.select("cls", "embedding").limit(1000).toArrow()
    length = F.aggregate("embedding", F.lit(0.0), lambda a, c: a + c.cast("double") * c)
    longest = classes.orderBy(F.desc(length), "cls").limit(params.longest).select("cls", "embedding").toArrow()
    sample = pa.concat_tables([sample, longest])
    sample = sample.take(np.unique(sample.column("cls").to_numpy(), return_index=True)[1])
    x = _matrix(sample.column("embedding").combine_chunks())
    scale = float(np.abs(x.astype(np.float64)).max())
    # of fixed size: the centroids of both levels and the codebooks
    sent = spark.sparkContext.broadcast(replace(fit((x.astype(np.float64) / scale).astype(np.float32), n, params), scale=scale))

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = sent.value.scaled(_matrix(b.column(1)))
                at = sent.value.lists(x)
                code = sent.value.encode(x, at)
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), b.column(0), pa.array([c.tobytes() for c in code], pa.binary()), b.column(1)], names=["list", "id", "code", "x"])

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                at = tuned.value.probed(_unit(_matrix(b.column(1))))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, at.size + 1, at.shape[1]), pa.int32()), pa.array(at.ravel(), pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists], names=["id", "x", "lists"])

    index = stored(classes.select("cls", "embedding").mapInArrow(entries, "list int, id long, code binary, x array<float>"))
    tried = asked.orderBy(F.xxhash64("q", F.lit(7)), "q").limit(params.tried).toArrow()
    if not tried.num_rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    tuned = spark.sparkContext.broadcast(calibrated(sent.value, index, _matrix(tried.column("embedding").combine_chunks()), params))
    probing = stored(asked.mapInArrow(probes, "id long, x array<float>, lists array<int>"))
    # one row for each list, of which the index has a bounded number
    sizes = {r["list"]: r["n"] for r in index.groupBy("list").agg(F.count("*").alias("n")).collect()}
    places = spark.createDataFrame(packed(sizes, params.shard), "list int, pieces int, first int")
    at_home = index.join(places, "list").withColumn("shard", F.col("first") + F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int"))
    # a query visits each of its shards once, with the lists it probes there
    visits = probing.select("id", F.explode("lists").alias("list")).join(places, "list").select("id", "list", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("pieces") - 1)).alias("shard"))
    visits = visits.groupBy("id", "shard").agg(F.collect_list("list").alias("lists"))
    loads = stored(visits.groupBy("shard").agg(F.ceil(F.count("*") / params.part).cast("int").alias("parts")))
    guests = visits.join(probing.select("id", "x"), "id").join(loads, "shard").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    at_home = at_home.join(loads, "shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    both = at_home.select("shard", "part", F.lit(0).alias("kind"), "id", "list", "code", "x", F.lit(None).cast("array<int>").alias("lists"))
    both = both.unionByName(guests.select("shard", "part", F.lit(1).alias("kind"), "id", F.lit(0).alias("list"), F.lit(None).cast("binary").alias("code"), "x", "lists"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held, shard = None, [], None
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy() for c in range(3)], axis=1)
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)]):
                if a == b:
                    continue
                rows = batch.slice(a, b - a)
                if here != tuple(key[a, :2]):
                    here, held, shard = tuple(key[a, :2]), [], None
                if not key[a, 2]:
                    held.append(rows)
                    continue
                if shard is None:
                    t = pa.Table.from_batches(held).combine_chunks()
                    code = np.frombuffer(b"".join(t.column("code").to_pylist()), np.uint8).reshape(t.num_rows, -1)
                    shard, held = Shard(tuned.value, t.column("list").to_numpy(), t.column("id").to_numpy(), code, _matrix(t.column("x").combine_chunks()), params), []
                found = list(shard.search(_matrix(rows.column("x")), [np.array(p) for p in rows.column("lists").to_pylist()]))
                ends = np.cumsum([0, *(len(s) for s, _ in found)])
                best = pa.StructArray.from_arrays([pa.array(-np.concatenate([s for s, _ in found])), pa.array(np.concatenate([c for _, c in found]))], names=["away", "cls"])
                yield pa.RecordBatch.from_arrays([rows.column("id"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), best)], names=["q", "best"])

    dealt = both.repartition("shard", "part").sortWithinPartitions("shard", "part", "kind")
    found = dealt.mapInArrow(scan, "q long, best array<struct<away: double, cls: long>>")
    # k + 1 from each probed shard at most
    found = found.groupBy("q").agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k + 1).alias("best"))
    exact = found.select("q", F.explode("best").alias("b")).select("q", "b.cls", (-F.col("b.away")).alias("score"))
    rows = exact.join(members.select("cls", "vec_id"), "cls")
    ordered = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    rows = rows.withColumn("n", F.row_number().over(ordered)).filter(F.col("n") <= k + 1)
    # at most k + 1 rows of a class of queries
    answer = rows.groupBy(F.col("q").alias("cls")).agg(F.sort_array(F.collect_list(F.struct("n", "vec_id", "score"))).alias("found"))
    own = queries.join(answer, "cls").withColumn("found", F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k))
    return own.select("query_id", F.posexplode("found").alias("at", "x")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")
