"""Personal data: patterns propose spans, checksums confirm them, context words move their score.

Base kinds, leftmost and non-overlapping within a kind: email, ip (parts at
most 255), card (16 to 19 digits that pass Luhn), phone (8 to 15 digits after a
plus sign). A proposed span that fails its validator is dropped, with no other
try inside it. Added kinds: iban (mod-97), private keys and access keys of
published formats and, where a nearby word raises the score over the threshold,
ssn, national phone numbers without a plus sign, and secrets: runs of 16 to 512
letters, digits and ``+/_-`` that are as mixed as random ones. An added span
that lies inside another span, or crosses one, is left out; one that holds
smaller spans stays beside them.

Offsets are code points, the end exclusive. Edge cases: a null or empty text
has no spans; a null id keeps its row; repeated rows each get their own;
extra columns pass through ``redacted`` and are left out by ``spans``.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import ship

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "phone_local", "ssn", "key", "secret")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# a later start inside the same run of digits fails as the first one does, so the
# lookbehinds change no match and keep long runs linear
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+(.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])")

# Published formats of private keys and access keys.
_KEY = re.compile(
    r"-----BEGIN (?:[A-Z0-9]+ ){0,3}PRIVATE KEY-----[^-]++-----END (?:[A-Z0-9]+ ){0,3}PRIVATE KEY-----"
    r"|(?<![A-Za-z0-9_-])(?:A(?:KIA|SIA)[A-Z0-9]{16}|gh[opsur]_[A-Za-z0-9]{36,255}|xox[abeprs]-[A-Za-z0-9-]{10,250}|AIza[A-Za-z0-9_-]{35}"
    r"|[rs]k_(?:live|test)_[A-Za-z0-9]{16,250}|eyJ[A-Za-z0-9_-]{8,2000}\.eyJ[A-Za-z0-9_-]{8,4000}\.[A-Za-z0-9_-]{16,2000})(?![A-Za-z0-9_-])"
)
# the whole run is taken, so that long runs stay linear; its length is judged after
_RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}+={0,2}")
_TURN = re.compile(r"[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])")


@dataclass(frozen=True)
class PiiParams:
    #: Added spans need this score; base spans stay whatever their score.
    min_score: float = 0.6
    #: Code points before and after a span in which context words count.
    window: int = 48
    #: Scores that patterns start from; a passed checksum is most of the evidence.
    prior: tuple[tuple[str, float], ...] = (("email", 0.9), ("ip", 0.6), ("card", 0.8), ("phone", 0.75), ("iban", 0.85), ("phone_local", 0.35), ("ssn", 0.4), ("key", 0.9), ("secret", 0.3))
    #: Words that raise (positive) or lower the score of a kind.
    context: tuple[tuple[str, str, float], ...] = (
        ("card", r"card|visa|mastercard|credit|debit|karte|carte|tarjeta", 0.15),
        ("card", r"isbn|order|invoice|tracking|serial", -0.3),
        ("phone", r"phone|tel|call|mobile|fax|telefon|téléphone|teléfono", 0.2),
        ("phone_local", r"phone|tel|call|mobile|fax|telefon|téléphone|teléfono", 0.35),
        ("ip", r"ip|address|host|server|client", 0.2),
        ("ip", r"version|release|build|section", -0.4),
        ("iban", r"iban|account|konto|compte|cuenta|bank", 0.1),
        ("ssn", r"ssn|social|security", 0.4),
        ("secret", r"(?:\w*_)?(?:token|secret|passwor[dt]|passwd|pwd|credentials?|bearer|contraseña|api[_ -]?key|apikey|access[_ -]?key|auth[_ -]?key|secret[_ -]?key)", 0.4),
        ("secret", r"sha1|sha256|md5|digest|checksum|commit|uuid", -0.3),
        ("email", r"mail|contact|write", 0.05),
    )


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def random_like(s: str) -> bool:
    """Whether letters and digits of a run alternate, with nearly as many bits a character as random hex of its length."""
    if len(_TURN.findall(s)) < 4:
        return False
    bits = -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())
    return bits >= min(3.0, 0.75 * math.log2(len(s)))


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(t: str) -> Iterator[tuple[int, int]]:
    """From each @ back over the local part and on over the domain: linear, where a pattern alone is not."""
    end, at = 0, t.find("@")
    while at >= 0:
        m = _DOMAIN.match(t, at + 1)
        start = at
        if m:
            while start > end and t[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                yield start, m.end()
                end = m.end()
        at = t.find("@", max(at + 1, end))


def proposed(t: str) -> Iterator[tuple[str, int, int]]:
    """All spans that pass their validators, by kind and start."""
    for a, b in _emails(t) if "@" in t else ():
        yield "email", a, b
    if not any(c in t for c in "0123456789"):
        return
    for m in _IP.finditer(t):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            yield "ip", *m.span()
    for m in _CARD.finditer(t):
        if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            yield "card", *m.span()
    for m in _PHONE.finditer(t) if "+" in t else ():
        if 8 <= len(_digits(m[0])) <= 15:
            yield "phone", *m.span()
    for m in _IBAN.finditer(t):
        if mod97(m[0]):
            yield "iban", *m.span()
    for kind, pattern in (("phone_local", _LOCAL_PHONE), ("ssn", _SSN), ("key", _KEY)):
        for m in pattern.finditer(t):
            yield kind, *m.span()
    for m in _RUN.finditer(t):
        if m.end() - m.start() <= 512 and random_like(m[0]):
            yield "secret", *m.span()


class Taken:
    """Spans taken so far. Those of one kind come in order and apart, so that bisection finds what a new span meets."""

    def __init__(self) -> None:
        self.of: dict[str, tuple[list[int], list[int]]] = {}

    def add(self, kind: str, a: int, b: int) -> None:
        starts, ends = self.of.setdefault(kind, ([], []))
        starts.append(a)
        ends.append(b)

    def bars(self, a: int, b: int) -> bool:
        """Whether a span is there that is the same, or reaches over the start or the end of this one."""
        for starts, ends in self.of.values():
            before, last = bisect_left(starts, a) - 1, bisect_left(starts, b) - 1
            if before >= 0 and ends[before] > a or last >= 0 and ends[last] > b:
                return True
            if before + 1 < len(starts) and starts[before + 1] == a and ends[before + 1] == b:
                return True
        return False


def scored(t: str, params: PiiParams, rules: list) -> list[tuple[str, int, int, float]]:
    """Spans with scores; added spans under the threshold, inside another span or across its end go."""
    prior = dict(params.prior)
    out: list[tuple[str, int, int, float]] = []
    taken = Taken()
    for kind, a, b in proposed(t):
        score = prior[kind]
        near = t[max(0, a - params.window) : a] + " " + t[b : b + params.window]
        for k, pattern, by in rules:
            if k == kind and pattern.search(near):
                score += by
        score = min(1.0, max(0.0, score))
        if kind in ADDED and (score < params.min_score or taken.bars(a, b)):
            continue
        taken.add(kind, a, b)
        out.append((kind, a, b, score))
    return out


def spans(docs: DataFrame, params: PiiParams = PiiParams()) -> DataFrame:
    """doc_id and spans, an array of (kind, start, end, score)."""
    return _with_spans(docs.select("doc_id", "text"), params).drop("text")


def _with_spans(docs: DataFrame, params: PiiParams) -> DataFrame:
    ship(docs.sparkSession)
    at = docs.columns.index("text")
    found = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())]))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = [(k, re.compile(rf"(?i)\b(?:{p})\b"), by) for k, p, by in params.context]
        for b in batches:
            got = [[dict(zip(("kind", "start", "end", "score"), x)) for x in scored(t or "", params, rules)] for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, kind)], names=[*b.schema.names, "spans"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("spans", found)]))


def redacted(docs: DataFrame, params: PiiParams = PiiParams()) -> DataFrame:
    """docs with each span of the text replaced by its kind in angle brackets, overlapping spans as one."""
    ship(docs.sparkSession)
    at, schema = docs.columns.index("text"), docs.schema

    def hidden(t: str | None, rules: list) -> str | None:
        if not t:
            return t
        out, end = [], 0
        for a, b, kind in sorted((a, b, kind) for kind, a, b, _ in scored(t, params, rules)):
            if a >= end:
                out += [t[end:a], f"<{kind.upper()}>"]
            end = max(end, b)
        return "".join([*out, t[end:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = [(k, re.compile(rf"(?i)\b(?:{p})\b"), by) for k, p, by in params.context]
        for b in batches:
            new = pa.array([hidden(t, rules) for t in b.column(at).to_pylist()], pa.string())
            yield b.set_column(at, b.schema.names[at], new)

    return docs.mapInArrow(run, schema)


def report(docs: DataFrame) -> DataFrame:
    """The counts and digests that the registered query returns."""
    ship(docs.sparkSession)
    params = PiiParams()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = [(k, re.compile(rf"(?i)\b(?:{p})\b"), by) for k, p, by in params.context]
        order = {k: n for n, k in enumerate((*BASE, *ADDED))}
        for b in batches:
            rows = []
            for t in b.column(1).to_pylist():
                found = sorted(((k, x, y) for k, x, y, _ in scored(t or "", params, rules)), key=lambda s: (order[s[0]], s[1]))
                base = ",".join(f"{k}:{x}:{y}" for k, x, y in found if k in BASE)
                rows.append([*(sum(k == kind for k, _, _ in found) for kind in BASE), hashlib.sha256(base.encode()).hexdigest(), ",".join(f"{k}:{x}:{y}" for k, x, y in found)])
            cols = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols[:4]), *(pa.array(c, pa.string()) for c in cols[4:])], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    ids = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return ids.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
