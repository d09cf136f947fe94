"""Mixing sources to target weights by a low-discrepancy schedule of token blocks.

``targets`` shares a token budget over the sources by weight, filling each up
to a cap and sharing the excess anew. ``schedule`` draws slot t = 0, 1, ... at
the golden-ratio point frac((t + 1) * phi) and maps it through the cumulative
target shares to a source; the rank of a slot among its source's slots says
which block of that source it takes. Each source's documents, shuffled by a
hash of their id, form one stream of words, repeated as often as the cap
allows and cut into blocks of ``block`` words. ``mix`` joins slots to the
documents' pieces of these blocks and adds up the words that each document
gives. One closing slot for each source takes what its target still lacks, or
its last slots stop where the target ends, so that targets are met to a word.

All of it is DataFrame work; hot sources are spread over buckets, and ranks
and offsets, also those over all sources, come from bucket totals and sums
inside a bucket.

Edge cases: a null text has size 0 and is never taken; documents of size 0 add
nothing; null sources form one source, the last; an empty table gives no
rows; repeated rows are mixed as documents of their own, in a fixed order, so
reruns agree. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, stored


@dataclass(frozen=True)
class MixParams:
    #: Weights in the sources' order, repeated over them.
    weights: tuple[int, ...] = (3, 1, 2)
    #: Tokens shared out, as a multiple of all tokens.
    share: float = 1.5
    #: A source gives at most so many times its size.
    cap: int = 2
    #: Rows of a bucket, over which offsets are summed in one task.
    bucket_rows: int = 2_000
    #: Slots for each document, on average; this sets the block size.
    slots_per_doc: float = 1.0


def size_of(text: str = "text") -> Column:
    """The number of words of a text; each is counted at its last character."""
    t = F.coalesce(F.col(text), F.lit(""))
    return F.regexp_count(t, F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """source, source_size, n_docs, target and rank from sizes(source, size, ...).

    Water filling in one pass: with the sources in order of size by weight,
    those up to some point are full and the rest share what remains by weight.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    # one row for each source, in the order of their bytes, which is that of code points
    by = by.withColumns({"_null": F.col("source").isNull(), "_bytes": F.encode("source", "utf-8"), "_one": F.lit(1).cast("long")})
    by = _prefix(_ranged(by, ["_null", "_bytes"]), [], "bucket", ["_null", "_bytes"], "_one", "rank")
    w = F.array(*[F.lit(float(x)) for x in params.weights])
    by = by.withColumns({"weight": F.get(w, (F.col("rank") % len(params.weights)).cast("int")), "full": params.cap * F.col("source_size")})
    order = ["full_at", "rank"]
    by = _ranged(by.withColumn("full_at", F.col("full") / F.col("weight")).select("source", "source_size", "n_docs", "rank", "weight", "full", "full_at"), order)
    by = _prefix(_prefix(by, [], "bucket", order, "full", "full_before"), [], "bucket", order, "weight", "weight_before")
    sums = by.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    # the water level if this source and all later ones are not full
    level = (F.lit((sums["size"] or 0) * params.share) - F.col("full_before")) / (F.lit(sums["weight"] or 0.0) - F.col("weight_before"))
    top = by.agg(F.max(F.when(F.col("full_at") >= level, level)).alias("level")).first()["level"]
    full = F.col("full").cast("double")
    return by.select("source", "source_size", "n_docs", "rank", (full if top is None else F.least(full, F.lit(top) * F.col("weight"))).alias("target"))


def _ranged(df: DataFrame, order: list[str]) -> DataFrame:
    """df as a table with ``bucket``: in the given order, rows of lower buckets come first."""
    return stored(df.repartitionByRange(*order).withColumn("bucket", F.spark_partition_id()))


def _prefix(df: DataFrame, keys: list[str], bucket: str, order: list, amount: str, out: str) -> DataFrame:
    """df with ``out``, the sum of ``amount`` over the rows before, by keys and order; rows of lower buckets come first."""
    sums = df.groupBy(*keys, bucket).agg(F.sum(amount).alias("_own"))
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_own").over(before), F.lit(0))).drop("_own")
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn(out, F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    return df.join(sums, [*keys, bucket]).withColumn(out, F.col(out) + F.col("_before")).drop("_before")


def schedule(spark, goals: DataFrame, block: int, n_slots: int, params: MixParams = MixParams()) -> DataFrame:
    """rank, slot, lo, hi: the words [lo, hi) of a source's repeated stream that the slot takes."""
    # shares in whole parts of a word, so that each one ends exactly where the next begins
    cuts = goals.filter("target > 0").select("rank", "target", F.round(F.col("target") * 1024).cast("long").alias("own"))
    cuts = _prefix(_ranged(cuts, ["rank"]), [], "bucket", ["rank"], "own", "before")
    sums = cuts.agg(F.sum("own").alias("own"), F.count("*").alias("n")).first()
    whole = F.lit(float(max(1, sums["own"] or 0)))
    cuts = cuts.select("rank", "target", (F.col("before") / whole).alias("start"), ((F.col("before") + F.col("own")) / whole).alias("end"))
    # the slot points are dealt out by their leading digits, so that the join with the sources is an
    # equality; the cells are finer where sources are many, and a share's cells are listed in two steps
    coarse, fine = 4096, min(4096, sums["n"] // 1024 + 1)
    grid = coarse * fine
    phi = 0.6180339887498949
    x = (F.col("id") + 1) * F.lit(phi)
    points = spark.range(n_slots).select(F.col("id").alias("t"), (x - F.floor(x)).alias("u")).withColumn("cell", F.floor(F.col("u") * grid).cast("int"))
    cuts = cuts.withColumns({"lo": F.least(F.floor(F.col("start") * grid), F.lit(grid - 1)).cast("int"), "hi": F.least(F.floor(F.col("end") * grid), F.lit(grid - 1)).cast("int")})
    parts = cuts.withColumn("part", F.explode(F.sequence(F.floor(F.col("lo") / fine).cast("int"), F.floor(F.col("hi") / fine).cast("int"))))
    cells = parts.withColumn("cell", F.explode(F.sequence(F.greatest("lo", F.col("part") * fine), F.least("hi", F.col("part") * fine + fine - 1)))).drop("lo", "hi", "part")
    drawn = points.join(cells, "cell").filter("u >= start and u < end").select("rank", "t", "target").withColumn("bucket", F.floor(F.col("t") / params.bucket_rows)).withColumn("one", F.lit(1).cast("long"))
    ranked = _prefix(drawn, ["rank"], "bucket", ["t"], "one", "slot")
    whole = F.round("target").cast("long")
    slots = ranked.select("rank", "slot", (F.col("slot") * block).alias("lo"), F.least((F.col("slot") + 1) * block, whole).alias("hi")).filter("lo < hi")
    drawn_to = drawn.groupBy("rank").agg(F.count("*").alias("n"))
    closing = goals.filter("target > 0").join(drawn_to, "rank", "left").select("rank", F.coalesce("n", F.lit(0)).alias("slot"), (F.coalesce("n", F.lit(0)) * block).alias("lo"), whole.alias("hi")).filter("lo < hi")
    # a closing slot of several blocks counts as one slot for each of them
    first, last = F.floor(F.col("lo") / block), F.floor((F.col("hi") - 1) / block)
    closing = closing.withColumn("slot", F.explode(F.sequence(first, last))).select("rank", "slot", (F.col("slot") * block).alias("lo"), F.least((F.col("slot") + 1) * block, F.col("hi")).alias("hi"))
    return slots.unionByName(closing)


def mix(docs: DataFrame, params: MixParams = MixParams(), carried: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target and taken for each row of docs(doc_id, text, source), with the ``carried`` columns of its row."""
    spark = docs.sparkSession
    sizes = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size_of().alias("size"), *carried))
    goals = stored(targets(sizes, params))
    total = goals.agg(F.sum("source_size").alias("size"), F.sum("n_docs").alias("docs"), F.sum("target").alias("target")).first()
    n_docs, words, wanted = total["docs"] or 0, total["size"] or 0, total["target"] or 0
    block = max(1, round(wanted / max(1, n_docs * params.slots_per_doc)))
    n_slots = int(wanted // block)

    mixed = F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.lit("mix"))
    rows = sizes.join(goals.select(F.col("source").alias("_s"), "rank", "source_size", "n_docs", "target"), F.col("source").eqNullSafe(F.col("_s")))
    rows = rows.select("doc_id", "size", "rank", "source_size", "target", "n_docs", mixed.alias("h"), *carried)
    n_buckets = F.ceil(F.col("n_docs") / params.bucket_rows)
    # buckets are ranges of the hash's upper bits, so that a source's rows are in order of (bucket, hash)
    rows = rows.withColumn("bucket", F.floor(F.call_function("shiftrightunsigned", "h", F.lit(33)) * n_buckets / F.lit(float(1 << 31))).cast("long"))
    rows = stored(_prefix(rows, ["rank"], "bucket", ["h", "doc_id", "size", *carried], "size", "at").withColumn("row", F.monotonically_increasing_id()))
    if not words:
        return rows.select("doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"), *carried)
    slots = schedule(spark, goals, block, n_slots, params)
    # a document's pieces: where it lies in each repetition of its source's stream, cut at blocks
    lo, hi = F.col("at") + F.col("epoch") * F.col("source_size"), F.col("at") + F.col("size") + F.col("epoch") * F.col("source_size")
    pieces = rows.filter("size > 0").withColumn("epoch", F.explode(F.array(*[F.lit(e) for e in range(params.cap)]))).select("row", "rank", "target", lo.alias("x"), hi.alias("y")).filter("x < target")
    pieces = pieces.withColumn("slot", F.explode(F.sequence(F.floor(F.col("x") / block), F.floor((F.col("y") - 1) / block))))
    words_in = F.greatest(F.least("y", "hi") - F.greatest("x", "lo"), F.lit(0))
    taken = pieces.join(slots, ["rank", "slot"]).groupBy("row").agg(F.sum(words_in).cast("long").alias("taken"))
    return rows.join(taken, "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"), *carried)


def mixed(docs: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """docs repeated as the mix takes them: round(taken / size) times each, whole."""
    cols = [F.col(f"`{c}`") for c in docs.columns]
    # ids may be null or repeat, so that rows get keys of their own; the text's hash in front keeps reruns alike
    keyed = stored(docs.withColumns({"_tie": F.xxhash64("text"), "_key": F.monotonically_increasing_id()}))
    took = mix(keyed, params, ("_tie", "_key")).filter("taken > 0").select(F.col("_key").alias("_took"), F.round(F.col("taken") / F.col("size")).cast("int").alias("_n")).filter("_n > 0")
    return keyed.join(took, F.col("_key") == F.col("_took")).withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_n")))).select(*cols)
