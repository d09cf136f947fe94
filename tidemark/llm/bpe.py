"""BPE encoding and decoding through a minimal acyclic transducer lexicon.

Spark counts the words of all texts; the most frequent ones are encoded once
and compiled into a minimal acyclic transducer: states with equal futures are
shared, and the numbers on the arcs of a word's path add up to its place in a
table of id sequences. The transducer is three flat arrays, broadcast once and
memory-mapped by each Python worker. A batch's distinct words walk it together,
byte by byte; words that it doesn't hold are merged exactly by merge ranks.

The vocabulary file is one of the tokenizers library's JSON files with a BPE
model and word ends; its path is a parameter. Ids and decoded text equal those
of the library without special tokens added.

Edge cases: a null or empty text has no ids and decodes to an empty text;
special tokens that stand in a text are kept as such; an empty table gives an
empty lexicon, so that all words are merged; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import mmap
import re
import struct
import tempfile
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ship, stored


@lru_cache(maxsize=4)
def _model(text: str) -> Model:
    return Model(text)


def _latin(split: str) -> str:
    """The splitting pattern with its classes spelt out for characters up to U+00FF, for the standard library's faster engine.

    Letters are tried first: no other branch starts with one.
    """
    kinds = {k: "".join(re.escape(chr(c)) for c in range(256) if unicodedata.category(chr(c))[0] == k) for k in "LN"}
    space = r"\t-\r \x85\xa0"
    whole = {r"[^\s\p{L}\p{N}]": f"[^{space}{kinds['L']}{kinds['N']}]", r"[\p{L}]": f"[{kinds['L']}]", r"[\p{N}]": f"[{kinds['N']}]"}
    parts = split.split("|")
    if any("[" in x and x.rstrip("+") not in whole for x in parts):
        raise ValueError(f"unknown classes in the pattern {split}")
    parts = [whole.get(x.rstrip("+"), x.rstrip("+")) + "+" * x.endswith("+") for x in parts]
    return "|".join(sorted(parts, key=lambda x: not x.startswith(f"[{kinds['L']}")))


class Model:
    """Normalisation, splitting, merges and token strings of a vocabulary file."""

    def __init__(self, text: str) -> None:
        import regex

        d = json.loads(text)
        m = d["model"]
        if m["type"] != "BPE" or d.get("decoder") or not m.get("end_of_word_suffix"):
            raise ValueError("a BPE model with word ends and no decoder is needed")
        self.vocab: dict[str, int] = m["vocab"]
        pairs = [x if isinstance(x, list) else x.split(" ") for x in m["merges"]]
        self.end: str = m["end_of_word_suffix"]
        self.special = {x["content"]: x["id"] for x in d.get("added_tokens", ())}
        names = sorted(self.special, key=len, reverse=True)
        self.at_special = regex.compile("|".join(map(regex.escape, names))) if names else None
        split = next(x["pattern"]["Regex"] for x in d["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        # in the file's dialect \s is Unicode's White_Space, which lacks U+001C to U+001F
        self.words = regex.compile(split.replace(r"^\s", r"^\p{White_Space}")).findall
        self.latin = re.compile(_latin(split)).findall
        self.name = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        # bytes that print stand for themselves, the others for the characters from U+0100 on, in order
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(own)]
        char = {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}
        # the same by ids: bytes inside and at the end of a word, a pair's rank, and what a rank's pair becomes
        self.byte = [self.vocab[char[b]] for b in range(256)]
        self.last = [self.vocab[char[b] + self.end] for b in range(256)]
        self.rank = {self.vocab[a] << 20 | self.vocab[b]: k for k, (a, b) in enumerate(pairs)}
        self.joined = [self.vocab[a + b] for a, b in pairs]
        self.no = len(pairs)

    def split(self, text: str) -> Iterator[list[str] | int]:
        """Lists of words, and the ids of special tokens between them."""
        at = 0
        for m in self.at_special.finditer(text) if self.at_special and "<" in text else ():
            yield self.normal(text[at : m.start()])
            yield self.special[m[0]]
            at = m.end()
        yield self.normal(text[at:] if at else text)

    def normal(self, text: str) -> list[str]:
        # the library lower-cases each character alone, so a final sigma is a sigma like any other
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        try:
            text.isascii() or text.encode("latin-1")
        except UnicodeEncodeError:
            return self.words(text)
        return self.latin(text)

    def merged(self, word: str) -> list[int]:
        """The ids of one word: the pair of lowest rank merges first, from the left."""
        raw = word.encode("utf-8", "replace")
        ids = [self.byte[b] for b in raw[:-1]] + [self.last[raw[-1]]] if raw else []
        if len(ids) > 200:
            return self._long(ids)
        rank, joined, no = self.rank, self.joined, self.no
        near = [rank.get(a << 20 | b, no) for a, b in zip(ids, ids[1:])]
        while near and (best := min(near)) != no:
            i = near.index(best)
            ids[i] = new = joined[best]
            del ids[i + 1], near[i]
            if i:
                near[i - 1] = rank.get(ids[i - 1] << 20 | new, no)
            if i < len(near):
                near[i] = rank.get(new << 20 | ids[i + 1], no)
        return ids

    def _long(self, ids: list[int]) -> list[int]:
        """The same merges through a heap over a linked list, for very long words."""
        import heapq

        n, rank = len(ids), self.rank
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank.get(ids[i] << 20 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = self.joined[r], False, after[j]
            if after[j] < n:
                before[after[j]] = i
            for x in (before[i], i):
                if x >= 0 and (y := after[x]) < n and (r := rank.get(ids[x] << 20 | ids[y])) is not None:
                    heapq.heappush(heap, (r, x, ids[x], ids[y]))
        return [t for t, ok in zip(ids, alive) if ok]


def compiled(words: list[str], ids: list[list[int]]) -> bytes:
    """The minimal acyclic transducer of the words, as the bytes of flat arrays.

    Words come in order of their bytes. Arcs are sorted by state and byte; the
    number on an arc is the count of words that leave its state before it.
    """
    keyed = sorted((w.encode("utf-8", "surrogatepass"), i) for w, i in zip(words, ids))
    register: dict[tuple, int] = {}
    arcs: list[tuple] = []  # of each finished state: (final, ((byte, state), ...))
    path: list[tuple[bool, list]] = [(False, [])]  # states not yet shared: final, arcs
    last = b""

    def shared(state: tuple[bool, list]) -> int:
        key = (state[0], tuple(state[1]))
        if key not in register:
            register[key] = len(arcs)
            arcs.append(key)
        return register[key]

    def close(upto: int) -> None:
        while len(path) > upto + 1:
            s = shared(path.pop())
            path[-1][1].append((last[len(path) - 1], s))

    for w, _ in keyed:
        k = 0
        while k < min(len(w), len(last)) and w[k] == last[k]:
            k += 1
        close(k)
        for _ in range(k, len(w)):
            path.append((False, []))
        path[-1] = (True, path[-1][1])
        last = w
    close(0)
    root = shared(path[0])
    count = np.zeros(len(arcs) + 1, np.int64)
    for s, (final, out) in enumerate(arcs):  # a state's targets are finished before it
        count[s] = final + sum(count[t] for _, t in out)
    rows = []
    for s, (final, out) in enumerate(arcs):
        before = int(final)
        for byte, t in out:
            rows.append((s * 256 + byte, t, before))
            before += int(count[t])
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 3)
    final = np.array([f for f, _ in arcs], np.uint8)
    sizes = np.array([len(i) for _, i in keyed], np.int64)
    flat = np.array([x for _, i in keyed for x in i], "<u4")
    parts = [np.array([root], np.int64), table[:, 0].copy(), table[:, 1].astype(np.int32), table[:, 2].astype(np.int32), final, np.concatenate(([0], np.cumsum(sizes))), flat]
    head = json.dumps([(p.dtype.str, len(p)) for p in parts]).encode()
    return len(head).to_bytes(8, "little") + head + b"".join(p.tobytes() + b"\0" * (-p.nbytes % 8) for p in parts)


class Lexicon:
    """A compiled transducer, memory-mapped from an unnamed file of this worker."""

    def __init__(self, data: bytes) -> None:
        with tempfile.TemporaryFile() as f:
            f.write(data)
            f.flush()
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        n = int.from_bytes(self.map[:8], "little")
        at, parts = 8 + n, []
        for kind, size in json.loads(self.map[8 : 8 + n]):
            dtype = np.dtype(kind)
            parts.append(np.frombuffer(self.map, dtype, size, at) if size else np.zeros(0, dtype))
            at += size * dtype.itemsize + -(size * dtype.itemsize) % 8
        root, self.key, self.to, self.add, self.final, self.offset, self.ids = parts
        self.root = int(root[0])

    def places(self, words: list[str]) -> np.ndarray:
        """Each word's place, or -1: all words take a step together."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        start = np.cumsum(size) - size
        flat = np.frombuffer(b"".join(raw) + b"\0", np.uint8)
        state, place = np.full(len(raw), self.root, np.int64), np.zeros(len(raw), np.int64)
        live = np.arange(len(raw)) if len(self.key) else np.zeros(0, np.int64)
        if not len(self.key):
            return np.full(len(raw), -1)
        for k in range(int(size.max(initial=0))):
            live = live[size[live] > k]
            want = state[live] * 256 + flat[start[live] + k]
            arc = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
            ok = self.key[arc] == want
            state[live[~ok]] = -1
            live, arc = live[ok], arc[ok]
            state[live], place[live] = self.to[arc], place[live] + self.add[arc]
            if not len(live):
                break
        found = (state >= 0) & (self.final[np.maximum(state, 0)] == 1)
        return np.where(found, place, -1)


@lru_cache(maxsize=2)
def _coder(vocab: str, lex: bytes) -> Coder:
    """One for each worker, which keeps what it knows from task to task."""
    return Coder(_model(vocab), Lexicon(lex))


class Coder:
    """Encodes and decodes texts; remembers words, those outside the lexicon up to a bound."""

    def __init__(self, model: Model, lexicon: Lexicon, most: int = 400_000) -> None:
        self.model, self.lexicon, self.most = model, lexicon, most
        self.bytes: dict[str, bytes] = {}
        self.text: dict[str, str] = {}
        self.merged: list[str] = []

    def learn(self, words: set[str]) -> None:
        if len(self.merged) > self.most:
            for w in self.merged:
                del self.bytes[w], self.text[w]
            self.merged.clear()
        new = [w for w in words if w not in self.bytes]
        if not new:
            return
        name, lex, tab, txt = self.model.name, self.lexicon, self.bytes, self.text
        places = lex.places(new)
        at, to = lex.offset[places].tolist(), lex.offset[places + 1].tolist()
        for w, p, a, b in zip(new, places.tolist(), at, to):
            if p >= 0:
                part = lex.ids[a:b]
                tab[w], ids = part.tobytes(), part.tolist()
            else:
                ids = self.model.merged(w)
                tab[w] = struct.pack(f"<{len(ids)}I", *ids)
                self.merged.append(w)
            txt[w] = name[ids[0]] if len(ids) == 1 else " ".join([name[i] for i in ids])

    def encode(self, texts: list[str]) -> Iterator[tuple[bytes, str]]:
        """Each text's ids as little-endian bytes, and its decoded text."""
        parts = [list(self.model.split(t)) for t in texts]
        seen: set[str] = set()
        for x in parts:
            for p in x:
                if not isinstance(p, int):
                    seen.update(p)
        self.learn(seen)
        tab, txt, name = self.bytes, self.text, self.model.name
        for x in parts:
            ids = b"".join([p.to_bytes(4, "little") if isinstance(p, int) else b"".join([tab[w] for w in p]) for p in x])
            decoded = [s for p in x for s in ([name[p]] if isinstance(p, int) else [txt[w] for w in p]) if s]
            yield ids, " ".join(decoded)


def word_counts(docs: DataFrame, vocab: str) -> DataFrame:
    """word and n over all texts; each task adds up its own words first."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, got = _model(sent.value), Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                for p in model.split(t or ""):
                    if not isinstance(p, int):
                        got.update(p)
                if len(got) > 300_000:
                    yield pa.RecordBatch.from_pydict({"word": list(got), "n": pa.array(got.values(), pa.int64())})
                    got.clear()
        yield pa.RecordBatch.from_pydict({"word": pa.array(got, pa.string()), "n": pa.array(got.values(), pa.int64())})

    counts = docs.select(F.col("text").cast("string")).mapInArrow(run, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n"))


def lexicon(docs: DataFrame, vocab: str, size: int = 50_000, longest: int = 64) -> bytes:
    """The transducer of the most frequent words of the texts, ``size`` at most, of ``longest`` bytes at most.

    Both bound what the driver holds and sends; longer words are merged exactly
    where they occur, as all words outside the transducer are.

    Words are taken by classes of like frequency, 64 for each factor of e, down
    to the last class that still fits, so that the driver gets no more than
    ``size`` words, and from no partition more than that partition has of them.
    Of a first class that is larger, a part is taken by a hash of the word.
    """
    counts = stored(word_counts(docs, vocab).filter(F.octet_length("word") <= longest)).withColumn("level", F.floor(F.log("n") * 64))
    levels = sorted(((r["level"], r["words"]) for r in counts.groupBy("level").agg(F.count("*").alias("words")).collect()), reverse=True)
    total, cut = 0, None
    for level, words in levels:
        if (total := total + words) > size:
            break
        cut = level
    if cut is None and levels:
        # a share by hash that is some times too large, so that few words reach the one task that cuts it
        level, n = levels[0]
        share = F.pmod(F.xxhash64("word"), F.lit(1 << 20)) <= int(min(1.0, 4 * size / n) * (1 << 20))
        picked = counts.filter((F.col("level") == level) & share).orderBy(F.xxhash64("word"), "word").limit(size)
    else:
        picked = counts.filter(F.col("level") >= cut) if levels else counts
    words = sorted(r["word"] for r in picked.select("word").collect())
    model = _model(vocab)
    return compiled(words, [model.merged(w) for w in words])


def _coded(docs: DataFrame, vocab: str, lex: bytes | None, out, schema: str) -> DataFrame:
    ship(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    sent, sent_lex = sc.broadcast(vocab), sc.broadcast(lexicon(docs, vocab) if lex is None else lex)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(sent.value, sent_lex.value)
        for b in batches:
            for at in range(0, b.num_rows, 200):  # bounds the words held at once
                x = b.slice(at, 200)
                yield out(x, coder)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def encoded(docs: DataFrame, vocab: str, lex: bytes | None = None) -> DataFrame:
    """doc_id, ids (array<long>) and decoded of each text; ``vocab`` is the JSON text of a vocabulary file."""

    def out(x: pa.RecordBatch, coder: Coder) -> pa.RecordBatch:
        rows = list(coder.encode([t or "" for t in x.column(1).to_pylist()]))
        ids = pa.array([np.frombuffer(i, "<u4").astype(np.int64) for i, _ in rows], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([x.column(0), ids, pa.array([d for _, d in rows], pa.string())], names=["doc_id", "ids", "decoded"])

    return _coded(docs, vocab, lex, out, "doc_id long, ids array<long>, decoded string")


def report(docs: DataFrame, vocab: str, lex: bytes | None = None) -> DataFrame:
    """The counts and digests that the registered query returns."""

    def out(x: pa.RecordBatch, coder: Coder) -> pa.RecordBatch:
        sha = lambda b: hashlib.sha256(b).hexdigest()
        rows = [(len(i) // 4, sha(i), sha(d.encode("utf-8", "surrogatepass"))) for i, d in coder.encode([t or "" for t in x.column(1).to_pylist()])]
        n, a, b = zip(*rows) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([x.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _coded(docs, vocab, lex, out, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
