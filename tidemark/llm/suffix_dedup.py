"""Removal of repeated byte strings through distributed suffix sorting by difference covers.

A byte goes if a string of ``length`` bytes that also starts earlier (in a
smaller document, or before in the same one) covers it. Two steps find all such
strings without sorting every suffix of the corpus at once:

1. *Partition.* Each string of ``length`` bytes picks one of its 32-byte grams,
   by the smallest hash, so that equal strings pick equal grams at equal
   offsets. Neighbouring strings that pick the same gram form a block, about one
   for each 35 bytes. Blocks are dealt out by gram. Of equal blocks all but the
   first are removed whole; blocks whose gram no other block picks are kept; the
   first blocks of grams with several different blocks go on to the sort.
2. *Suffix sort.* Inside each group of grams the blocks' text is suffix-sorted
   by difference cover modulo 3: the suffixes at positions 1 and 2 modulo 3 are
   sorted by triples, the triples' names form a text of two thirds the size that
   is sorted likewise, and the remaining suffixes are merged in. Five levels name
   243 bytes, more than any string has, so deeper ones aren't needed. Adjacent
   suffixes with ``length`` equal bytes are copies; all but the earliest go.

Equal strings always share a gram, so they meet in one task; blocks are told
apart by 128 bits of hashes, strings of the sort by their bytes. Rows of blocks
pass by in order, one pending at a time, however many pick one gram. A gram of
more than ``HOT`` different blocks would make too large a sort: its strings are
dealt out one by one, by 128 bits of their own hash, and the first of each is
found by an aggregation that combines before it shuffles.

Edge cases: a null text is empty; documents shorter than ``length`` lose
nothing; null ids are dropped; repeated rows give repeated results; an empty
table gives no rows; extra columns are ignored; a ``length`` beyond what five
levels of names tell apart is refused.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ship, stored

GRAM = 32
#: Texts are worked on in pieces of so many strings, whose positions fit the low bits of a hash.
PIECE = 1 << 22
#: Characters that one suffix sort takes at once, unless a single gram has more.
SORTED = 1_200_000
#: Different blocks of one gram that go to one suffix sort at most.
HOT = 1000
LEVELS = 5
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_LOW = np.uint64((1 << 23) - 1)


def _grams(b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of GRAM bytes."""
    n = len(b) - GRAM + 1
    v = np.lib.stride_tricks.as_strided(b, shape=(len(b) - 7, 8), strides=(1, 1))
    v = np.ascontiguousarray(v).view(np.uint64).ravel()
    h = v[:n] * _M1
    for k in range(8, GRAM, 8):
        h ^= h >> np.uint64(29)
        h += v[k : k + n]
        h *= _M2
    h ^= h >> np.uint64(32)
    h *= _M3
    h ^= h >> np.uint64(29)
    return h


def _smallest(x: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each run of w values, by prefix and suffix minima of blocks of w."""
    n = len(x) - w + 1
    y = np.concatenate([x, np.full(-len(x) % w, ~np.uint64(0))]).reshape(-1, w)
    ahead = np.minimum.accumulate(y, axis=1).ravel()
    back = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


class Blocks:
    """Cuts texts into blocks of strings that pick the same gram."""

    def __init__(self, length: int) -> None:
        self.length, self.width = length, length - GRAM + 1
        if not GRAM <= length <= 3**LEVELS:
            raise ValueError(f"strings must have {GRAM} to {3**LEVELS} bytes")
        self.powers = self.inverse = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.powers) < n:
            size = max(n, 1 << 16)
            for name, base in (("powers", int(_M2)), ("inverse", pow(int(_M2), -1, 1 << 64))):
                x = np.full(size, base, np.uint64)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))

    def of(self, raw: bytes) -> list[tuple[np.ndarray, ...]]:
        """For each piece: gram hash, block hash, position of the gram, bytes before it and from it on."""
        out = []
        for base in range(0, len(raw) - self.length + 1, PIECE):
            b = np.frombuffer(raw, np.uint8, min(len(raw) - base, PIECE + self.length - 1), base)
            h = _grams(b)
            packed = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
            at = (_smallest(packed, self.width) & _LOW).astype(np.int64)
            cut = np.flatnonzero(np.diff(at)) + 1
            first, last = np.concatenate(([0], cut)), np.concatenate((cut - 1, [len(at) - 1]))
            gram = at[first]
            self._powers(len(h) + 1)
            total = np.concatenate(([np.uint64(0)], np.cumsum(h * self.powers[: len(h)], dtype=np.uint64)))
            block = (total[last + self.width] - total[first]) * self.inverse[first]
            block = (block ^ (block >> np.uint64(31))) * _M3 + ((gram - first).astype(np.uint64) << np.uint64(32)) + (last - first).astype(np.uint64)
            out.append((h[gram], block, gram + base, gram - first, last + self.length - gram))
        return out


def _blocks(docs: DataFrame, length: int) -> DataFrame:
    names = ["g", "b", "doc", "pos", "lo", "hi", "late"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Blocks(length)
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                x = batch.slice(at, 2048)
                rows: list[list] = [[] for _ in names[:-1]]
                for doc, text in zip(x.column(0).to_pylist(), x.column(1).to_pylist()):
                    for g, b, pos, lo, hi in cutter.of((text or "").encode("utf-8", "surrogatepass")):
                        for to, v in zip(rows, (g.view(np.int64), b.view(np.int64), np.full(len(g), doc), pos.astype(np.int32), lo.astype(np.int32), hi.astype(np.int32))):
                            to.append(v)
                if rows[0]:
                    c = [np.concatenate(r) for r in rows]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, c), pa.array(_late(*c[:4]))], names=names)

    return docs.mapInArrow(run, "g long, b long, doc long, pos int, lo int, hi int, late boolean")


def _late(g: np.ndarray, b: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Whether an equal block stands earlier among these ones, which settles a block."""
    order = np.lexsort((b, g))
    same = (g[order[1:]] == g[order[:-1]]) & (b[order[1:]] == b[order[:-1]])
    late = np.zeros(len(g), bool)
    if same.any():
        run = np.cumsum(np.concatenate(([True], ~same)))
        some = np.flatnonzero(np.concatenate((same, [False])) | np.concatenate(([False], same)))
        at = order[some]
        by = np.lexsort((pos[at], doc[at], run[some]))
        at, run = at[by], run[some][by]
        first = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))[np.cumsum(np.concatenate(([True], run[1:] != run[:-1]))) - 1]
        late[at] = (doc[at] != doc[at[first]]) | (pos[at] != pos[at[first]])
    return late


def _copies(blocks: DataFrame) -> DataFrame:
    """Of blocks in order of (g, b, doc, pos): those removed whole (kind 0), and those that the sort must compare (kind 1).

    Blocks that a task has found late are spread over all tasks, so that a gram
    of a third of all blocks brings just a few from each task to its own.
    """

    names = ("g", "b", "doc", "pos", "lo", "hi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: dict | None = None  # the first block of the gram at hand, until another one shows that the sort must see it
        gram = block = first = None
        for batch in batches:
            if not batch.num_rows:
                continue
            c = {k: batch.column(k).to_numpy() for k in names}
            late = batch.column("late").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_pydict({"kind": np.zeros(int(late.sum()), np.int32), **{k: c[k][late] for k in names if k != "b"}})
            c = {k: v[~late] for k, v in c.items()}
            g, b, doc, pos = c["g"], c["b"], c["doc"], c["pos"]
            n = len(g)
            if not n:
                continue
            new_g = np.concatenate(([g[0] != gram], g[1:] != g[:-1]))
            new = new_g | np.concatenate(([b[0] != block], b[1:] != b[:-1]))
            # the first row of each row's block, which may have come with an earlier batch
            at = np.maximum.accumulate(np.where(new, np.arange(n), -1))
            d0, p0 = np.where(at < 0, first[0] if first else 0, doc[at]), np.where(at < 0, first[1] if first else 0, pos[at])
            copy = (doc != d0) | (pos != p0)
            # a block that opens its gram waits; any other new one calls the waiting one in
            other = new & ~new_g
            group = np.cumsum(new_g)
            called = np.zeros(group[-1] + 1, bool)
            called[group[other]] = True
            keep = copy | other | (new_g & called[group])
            out = {"kind": (~copy[keep]).astype(np.int32), **{k: c[k][keep] for k in names if k != "b"}}
            if pending is not None and called[0]:
                out = {k: np.concatenate(([pending[k]], v)).astype(v.dtype) for k, v in out.items()}
                pending = None
            yield pa.RecordBatch.from_pydict(out)
            if new_g.any():
                last = int(np.flatnonzero(new_g)[-1])
                pending = None if called[group[last]] else {"kind": 1, **{k: c[k][last] for k in names}}
            gram, block, first = g[-1], b[-1], (d0[-1], p0[-1])

    spread = F.when(F.col("late"), F.xxhash64("doc", "pos")).otherwise(F.col("g"))
    sorted_ = blocks.repartition(spread).sortWithinPartitions("g", "b", "doc", "pos")
    return sorted_.mapInArrow(run, "kind int, g long, doc long, pos int, lo int, hi int")


def _whole_groups(batches: Iterator[pa.RecordBatch], names: tuple, size, most: int) -> Iterator[dict]:
    """Batches in order of g as column dicts that hold whole groups of g, of at least ``most`` by ``size`` but for the last."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += size({k: batch.column(k) for k in ("g", *(["bytes"] if "bytes" in names else []))})
        if n < most:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        g = t.column("g").to_numpy()
        cut = int(np.searchsorted(g, g[-1]))
        if cut:
            yield _columns(t.slice(0, cut), names)
            held, n = t.slice(cut).to_batches(), 0
    if held:
        yield _columns(pa.Table.from_batches(held).combine_chunks(), names)


def _columns(t: pa.Table, names: tuple) -> dict:
    return {k: t.column(k).combine_chunks() if k == "bytes" else t.column(k).to_numpy(zero_copy_only=False) if k == "late" else t.column(k).to_numpy() for k in names}


def suffix_order(text: np.ndarray, depth: int = LEVELS) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of a text of small non-negative integers, and each suffix's name.

    Suffixes are in order of their first 3 ** depth characters at least; the
    text is taken as followed by zeros. Equal names mean equal so far.
    """
    n = len(text)
    t = np.concatenate([text, np.zeros(3, text.dtype)]).astype(np.int64)
    if n < 4:
        order = np.array(sorted(range(n), key=lambda i: t[i:].tolist()), np.int64)
        return order, np.argsort(order)
    one, two = np.arange(1, n, 3), np.arange(2, n, 3)
    sample = np.concatenate([one, two])
    name = _names(t[sample], t[sample + 1], t[sample + 2])
    if depth > 1 and name.max() + 1 < len(sample):
        # the names of all positions 1 modulo 3, an end mark, then those of 2 modulo 3
        inner = np.concatenate([name[: len(one)] + 1, [0], name[len(one) :] + 1])
        _, rank = suffix_order(inner, depth - 1)
        name = np.concatenate([rank[: len(one)], rank[len(one) + 1 :]])
    r = np.zeros(n + 3, np.int64)
    r[sample] = name + 1
    by_name = sample[np.argsort(name, kind="stable")]
    zero = np.arange(0, n, 3)
    wide = int(r.max()) + 1
    ones, twos = by_name[by_name % 3 == 1], by_name[by_name % 3 == 2]
    # suffixes at 0 and 1 modulo 3 compare by a character and the rest's name, those at 0 and 2 by two characters
    short = lambda i: t[i] * wide + r[i + 1]
    zero = zero[np.argsort(short(zero), kind="stable")]
    low = int(t.max()) + 1
    before = np.searchsorted(short(ones), short(zero))
    if low * low * wide < 1 << 62:
        long = lambda i: (t[i] * low + t[i + 1]) * wide + r[i + 2]
        before += np.searchsorted(long(twos), long(zero))
    else:
        both = np.concatenate([twos, zero])
        named = _names(t[both], t[both + 1], r[both + 2])
        before += np.searchsorted(named[: len(twos)], named[len(twos) :])
    # suffixes that are equal as far as names go can be counted out of turn
    place = np.maximum.accumulate(before) + np.arange(len(zero))
    order = np.empty(n, np.int64)
    free = np.ones(n, bool)
    free[place] = False
    order[place], order[free] = zero, by_name
    # a suffix has the name of the one before it if they are equal as far as they were compared
    k = np.empty(n, np.int64)
    k[by_name[1:]] = r[by_name[1:]] != r[by_name[:-1]]
    k[by_name[:1]] = 1
    same_zero = np.concatenate(([True], short(zero[1:]) != short(zero[:-1]))) if len(zero) else np.zeros(0, bool)
    k[zero] = same_zero
    step = k[order]
    step[1:] |= (order[1:] % 3 == 0) != (order[:-1] % 3 == 0)
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(step)
    return order, rank


def _names(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The dense rank of each triple."""
    wide = int(max(a.max(initial=0), b.max(initial=0), c.max(initial=0))) + 1
    if wide**3 < 8 * len(a):  # small alphabets need no sort
        key = (a * wide + b) * wide + c
        used = np.zeros(wide**3, bool)
        used[key] = True
        return (np.cumsum(used) - 1)[key]
    if wide < 1 << 21:
        return np.unique((a * wide + b) * wide + c, return_inverse=True)[1]
    order = np.lexsort((c, b, a))
    new = (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0) | (np.diff(c[order]) != 0)
    out = np.empty(len(a), np.int64)
    out[order] = np.concatenate(([0], np.cumsum(new)))
    return out


def repeated(texts: list[bytes], doc: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """doc and start of each string of the texts that also starts earlier; text k is at start[k] of doc[k]."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    flat = np.frombuffer(b"\0".join(texts) + b"\0" * 8, np.uint8)
    offset = np.cumsum(size + 1) - size - 1
    # bytes by their ranks among those in use, from 1 on
    used = np.zeros(256, bool)
    used[flat] = True
    char = np.cumsum(used)[flat[: offset[-1] + size[-1]]]
    char[offset[1:] - 1] = 0
    order, _ = suffix_order(char)
    # just the suffixes at which a whole string starts
    owner = np.full(len(char), -1, np.int64)
    many = size - length + 1
    at = np.repeat(offset, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    owner[at] = np.repeat(np.arange(len(texts)), many)
    order = order[owner[order] >= 0]
    a, b = order[1:], order[:-1]
    words = np.ascontiguousarray(np.lib.stride_tricks.as_strided(flat, shape=(len(flat) - 7, 8), strides=(1, 1))).view(np.uint64).ravel()
    equal = np.ones(len(a), bool)
    for k in [*range(0, length - 7, 8), length - 8]:
        equal &= words[a + k] == words[b + k]
    run = np.concatenate(([0], np.cumsum(~equal)))
    d, s = doc[owner[order]], start[owner[order]] + order - offset[owner[order]]
    by = np.lexsort((s, d, run))
    run, d, s = run[by], d[by], s[by]
    new = np.concatenate(([True], run[1:] != run[:-1]))
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    late = (d != d[first]) | (s != s[first])
    return d[late], s[late]


def _singly(residual: DataFrame, length: int) -> DataFrame:
    """Spans that repeat, from blocks' bytes, each string dealt out by its own hash."""
    names = ["k1", "k2", "doc", "start"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            for at in range(0, b.num_rows, 1000):
                x = b.slice(at, 1000)
                texts = x.column("bytes").to_pylist()
                many = np.array([len(t) - length + 1 for t in texts], np.int64)
                digests = b"".join(xxhash.xxh3_128_digest(t[k : k + length]) for t in texts for k in range(len(t) - length + 1))
                keys = np.frombuffer(digests, np.int64).reshape(-1, 2)
                start = np.repeat(x.column("start").to_numpy(), many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                yield pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(np.repeat(x.column("doc").to_numpy(), many)), pa.array(start, pa.int32())], names=names)

    each = stored(residual.mapInArrow(cut, "k1 long, k2 long, doc long, start int"))
    first = each.groupBy("k1", "k2").agg(F.min(F.struct("doc", "start")).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    late = each.join(first, ["k1", "k2"]).filter(F.struct("doc", "start") != F.col("first"))
    return late.select("doc", "start", (F.col("start") + length).cast("int").alias("end"))


def _compared(residual: DataFrame, length: int) -> DataFrame:
    """Spans that repeat, from blocks' bytes in order of g."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in _whole_groups(batches, ("g", "doc", "start", "bytes"), lambda c: c["bytes"].nbytes, SORTED):
            d, s = repeated(c["bytes"].to_pylist(), c["doc"], c["start"].astype(np.int64), length)
            if len(d):
                by = np.lexsort((s, d))
                d, s = d[by], s[by]
                new = np.concatenate(([True], (d[1:] != d[:-1]) | (s[1:] > s[:-1] + 1)))
                last = np.concatenate((np.flatnonzero(new)[1:] - 1, [len(d) - 1]))
                yield pa.RecordBatch.from_arrays([pa.array(d[new], pa.int64()), pa.array(s[new], pa.int32()), pa.array(s[last] + length, pa.int32())], names=["doc", "start", "end"])

    return residual.repartition("g").sortWithinPartitions("g").mapInArrow(run, "doc long, start int, end int")


def spans(docs: DataFrame, length: int = 100) -> DataFrame:
    """doc, start and end of spans whose union is what repeats; spans may overlap."""
    ship(docs.sparkSession)
    texts = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text"))
    found = stored(_copies(_blocks(texts, length)))
    # a document's blocks that go on, at most one for each of its bytes
    wanted = found.filter("kind = 1").groupBy("doc").agg(F.collect_set(F.struct("g", "pos", "lo", "hi")).alias("want"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, text, want in zip(*(b.column(k).to_pylist() for k in ("doc", "text", "want"))):
                raw = (text or "").encode("utf-8", "surrogatepass")
                rows += [(w["g"], doc, w["pos"] - w["lo"], raw[w["pos"] - w["lo"] : w["pos"] + w["hi"]]) for w in want]
            g, d, s, x = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(d, pa.int64()), pa.array(s, pa.int32()), pa.array(x, pa.binary())], names=["g", "doc", "start", "bytes"])

    residual = texts.join(wanted, "doc").select("doc", "text", "want").mapInArrow(cut, "g long, doc long, start int, bytes binary")
    hot = stored(found.filter("kind = 1").groupBy("g").agg(F.count("*").alias("n")).filter(F.col("n") > HOT).select(F.col("g").alias("_hot")))
    residual = stored(residual.join(hot, F.col("g") == F.col("_hot"), "left"))
    singly = _singly(residual.filter("_hot is not null"), length)
    residual = residual.filter("_hot is null").drop("_hot")
    whole = found.filter("kind = 0").select("doc", (F.col("pos") - F.col("lo")).alias("start"), (F.col("pos") + F.col("hi")).alias("end"))
    return whole.unionByName(stored(_compared(residual, length))).unionByName(stored(singly))


def kept(raw: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int]:
    """What is left of a text, and the number of maximal removed runs."""
    out, end, n = [], 0, 0
    for a, b in sorted(spans):
        if a > end or n == 0:
            out.append(raw[end:a])
            n += 1
        end = max(end, b)
    return b"".join([*out, raw[end:]]), n


def deduplicated(docs: DataFrame, length: int = 100) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (binary) of each row of docs(doc_id, text)."""
    own = spans(docs, length).groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("gone"))
    rows = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                x = b.slice(at, 256)
                out = []
                for text, gone in zip(x.column(1).to_pylist(), x.column(2).to_pylist()):
                    raw = (text or "").encode("utf-8", "surrogatepass")
                    left, n = kept(raw, [(g["start"], g["end"]) for g in gone or ()])
                    out.append((len(raw), len(raw) - len(left), n, left))
                cols = list(zip(*out)) or [()] * 4
                yield pa.RecordBatch.from_arrays([x.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    both = rows.join(own, rows.doc_id == own.doc, "left").select("doc_id", "text", "gone")
    return both.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def digest(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


def report(docs: DataFrame) -> DataFrame:
    return deduplicated(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
