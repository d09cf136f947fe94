"""Quality rules: learned decision lists over native text statistics.

``with_stats`` computes interpretable figures of a text with built-in
expressions. ``learn`` runs sequential covering: it grows a conjunction of
thresholds from grouped counts of labelled rows, prunes it on held-back rows,
removes what it covers and goes on. The list becomes one ordered ``CASE``
expression. Only counts by feature and bin reach the driver.

Edge cases: a null text has no words (all figures 0); null labels and labels
of unknown documents are not learned from; an empty or one-sided label set
gives an empty list, which rejects nothing; rows with null or repeated ids are
judged one by one; extra columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE, WORD, let, stored

#: Features that rules may test, as SQL over the columns of with_stats.
FEATURES: dict[str, str] = {
    "n_words": "cast(n_words as double)",
    "chars_per_word": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
    "digits_per_char": "n_digits / greatest(word_chars, 1)",
    "upper_per_char": "n_upper / greatest(word_chars, 1)",
    "stops_per_word": "n_stops / greatest(n_words, 1)",
}
_STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_digits", "n_upper", "n_stops")


@dataclass(frozen=True)
class RuleParams:
    min_words: int = 50
    max_repeat_pct: int = 50
    #: Bound on the labelled rows that are learned from; a hash of the id picks them.
    max_labelled: int = 10_000
    bins: int = 24
    max_rules: int = 8
    max_terms: int = 3
    #: A rule stays if so large a share of what it rejects is labelled bad, on growing and on pruning rows.
    min_precision: float = 0.9
    min_covered: int = 12


@dataclass(frozen=True)
class Rule:
    """A conjunction: feature, '<=' or '>', threshold."""

    terms: tuple[tuple[str, str, float], ...]
    stats: dict = field(default_factory=dict, compare=False)

    def sql(self) -> str:
        return " and ".join(f"({FEATURES[f]}) {op} {t!r}D" for f, op, t in self.terms)


def with_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with one struct column ``_stats`` of counts, by built-in expressions only."""
    t = F.coalesce(F.col(text), F.lit(""))

    words = F.array_remove(F.split(t, SPACE, -1), "")
    lines = let(
        F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD)),
        lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")),
    )
    # by what is left without them: nothing is listed, however long a text is
    count = lambda chars: (F.length(t) - F.length(F.translate(t, chars, ""))).cast("long")
    out = docs.withColumn("_words", words).withColumn("_n", F.size("_words")).withColumn("_bits", F.ceil(F.log2(F.greatest("_n", F.lit(2)).cast("double"))).cast("int"))
    # an expression that depends on the partition keeps filters above this projection: pushed
    # below it, they would work out the words anew for each window
    here = (F.spark_partition_id() * 0).cast("long")
    out = out.withColumn("_hashes", _hashes(F.col("_words"), F.col("_n"))).withColumn("_sorted", _sorted(F.col("_hashes"), F.col("_bits")))
    out = out.withColumn("_windows", _windows(F.col("_hashes"), F.col("_sorted"), F.col("_bits")))
    return out.withColumns(
        {
            "_lines": lines,
            "_stats": F.struct(
                (F.col("_n") + here).alias("n_words"),
                (F.length(t) - count(" \t\n\x0b\x0c\r")).cast("long").alias("word_chars"),
                count("#*$%&|<>").alias("n_symbols"),
                _covered(F.col("_windows")).alias("n_repeat_words"),
                count("0123456789").alias("n_digits"),
                count("ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_upper"),
                count(".!?").alias("n_stops"),
            ),
        }
    ).withColumn("_stats", F.struct("_stats.*", "_lines.*")).drop("_words", "_lines", "_n", "_bits", "_hashes", "_sorted", "_windows")


def _hashes(w: Column, n: Column) -> Column:
    """A hash for each 3-word window of w."""
    return F.transform(F.slice(w, 1, F.greatest(n - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))


def _sorted(h: Column, bits: Column) -> Column:
    """Windows as longs in order, or none where no hash occurs twice: part of the hash above, the window's place in the low bits."""
    place = F.transform(h, lambda x, i: F.call_function("shiftleft", x, bits).bitwiseOR(i.cast("long")))
    return F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(place)).otherwise(F.array().cast("array<bigint>"))


def _windows(h: Column, s: Column, bits: Column) -> Column:
    """Whole hashes and places, in order, of the windows that share their part of the hash with a neighbour in s.

    Equal windows then stand side by side whatever the text's length: all 64
    bits of the hash are compared, so that two different windows of a text of n
    words pass for equal with a chance of n * n / 2 ** 65.
    """
    same = lambda x, y: F.call_function("shiftrightunsigned", x.bitwiseXOR(y), bits) == 0
    low = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
    near = F.filter(s, lambda x, i: same(x, F.get(s, i + 1)) | same(x, F.get(s, i - 1)))
    return F.sort_array(F.transform(near, lambda x: F.struct(F.get(h, x.bitwiseAND(low).cast("int")).alias("h"), x.bitwiseAND(low).alias("i"))))


def _covered(s: Column) -> Column:
    """Words inside windows that occur twice or more; s has the windows in order."""
    same = lambda x, k: F.get(s, k)["h"] == x["h"]
    at = F.sort_array(F.transform(F.filter(s, lambda x, i: same(x, i + 1) | same(x, i - 1)), lambda x: x["i"]))
    # each window adds three words, or fewer where the next one overlaps it
    gaps = let(at, lambda p: F.transform(p, lambda x, k: F.least(F.lit(3).cast("long"), F.coalesce(F.get(p, k + 1) - x, F.lit(3).cast("long")))))
    return F.aggregate(gaps, F.lit(0).cast("long"), lambda acc, x: acc + x)


def base_failed(params: RuleParams = RuleParams()) -> Column:
    s = F.col("_stats")
    return (s["n_words"] < params.min_words) | (100 * s["n_repeat_words"] > params.max_repeat_pct * s["n_words"])


def _features(df: DataFrame) -> DataFrame:
    return df.select("_bad", "_prune", *[F.expr(e).alias(f) for f, e in FEATURES.items()])


def learn(docs: DataFrame, labels: DataFrame, params: RuleParams = RuleParams()) -> list[Rule]:
    """Ordered rejecting rules from labels(doc_id, quality), where quality 0 is bad."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("_quality"))
    n = known.count()
    part = min(1.0, params.max_labelled / max(n, 1))
    picked = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(part * 1_000_000))
    # bounded by max_labelled, so that the texts of other rows never move
    rows = with_stats(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id"))
    rows = rows.filter(~base_failed(params)).select("_stats.*", (F.col("_quality") == 0).alias("_bad"), (F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(3)) == 0).alias("_prune"))
    rows = stored(_features(rows))
    cuts = rows.select([F.percentile_approx(f, [k / params.bins for k in range(1, params.bins)], 2000).alias(f) for f in FEATURES]).first()
    cuts = {f: sorted(set(cuts[f] or ())) for f in FEATURES}
    binned = stored(rows.select("_bad", "_prune", *FEATURES, *[_bin(f, cuts[f]).alias(f"_b_{f}") for f in FEATURES]))

    rules: list[Rule] = []
    left = binned
    while len(rules) < params.max_rules:
        rule = _grow(left, cuts, params)
        if rule is None:
            break
        rules.append(rule)
        left = left.filter(~F.coalesce(_test(rule.terms), F.lit(False)))
    return rules


def _bin(f: str, cuts: list[float]) -> Column:
    """The number of thresholds below the value: bin b holds values in (cuts[b-1], cuts[b]]."""
    return sum((F.when(F.col(f) > c, 1).otherwise(0) for c in cuts), F.lit(0)).cast("int")


def _test(terms) -> Column:
    out = F.lit(True)
    for f, op, t in terms:
        out = out & ((F.col(f) <= t) if op == "<=" else (F.col(f) > t))
    return out


def _grow(rows: DataFrame, cuts: dict, params: RuleParams) -> Rule | None:
    terms: list = []
    while len(terms) < params.max_terms:
        now = rows.filter(_test(terms) & ~F.col("_prune"))
        flat = now.select("_bad", F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f"_b_{f}").alias("b")) for f in FEATURES])).alias("x"))
        counts = flat.groupBy("x.f", "x.b").agg(F.sum(F.col("_bad").cast("int")).alias("bad"), F.count("*").alias("n")).collect()
        best = _best(counts, cuts, params)
        if best is None:
            break
        terms.append(best[:3])
        if best[3] >= 0.995:
            break
    if not terms:
        return None
    # prune: drop final terms while that does not lower the precision on the rows kept back
    shorter = [tuple(terms[:k]) for k in range(1, len(terms) + 1)]
    row = rows.select(*[F.sum(F.when(_test(t) & p, F.col("_bad").cast("int")).otherwise(0)).alias(f"bad{k}_{s}") for k, t in enumerate(shorter) for s, p in (("g", ~F.col("_prune")), ("p", F.col("_prune")))], *[F.count_if(_test(t) & p).alias(f"n{k}_{s}") for k, t in enumerate(shorter) for s, p in (("g", ~F.col("_prune")), ("p", F.col("_prune")))]).first()
    best = None
    for k, t in enumerate(shorter):
        bad, n, bad_g, n_g = (row[f"{c}{k}_{s}"] or 0 for s in "pg" for c in ("bad", "n"))
        # one added good row on either side keeps tiny rules from passing
        p, g = bad / (n + 1), bad_g / (n_g + 1)
        if n_g >= params.min_covered and min(p, g) >= params.min_precision and (best is None or p > best[0] + 0.005):
            best = (p, t, {"covered": n + n_g, "bad": bad + bad_g})
    return best and Rule(best[1], best[2])


def _best(counts: list, cuts: dict, params: RuleParams) -> tuple | None:
    """The threshold of the largest weighted relative accuracy gain, by FOIL's measure."""
    import math

    out = None
    for f in FEATURES:
        by = {r["b"]: (r["bad"], r["n"]) for r in counts if r["f"] == f}
        bad, n = (sum(v[i] for v in by.values()) for i in (0, 1))
        if not bad or bad == n:
            continue
        low_bad = low_n = 0
        for b, cut in enumerate(cuts[f]):
            low_bad, low_n = low_bad + by.get(b, (0, 0))[0], low_n + by.get(b, (0, 0))[1]
            for op, p, m in (("<=", low_bad, low_n), (">", bad - low_bad, n - low_n)):
                if m >= params.min_covered and m < n and p:
                    gain = p * (math.log2(p / (m + 1)) - math.log2(bad / n))
                    if gain > 1e-9 and (out is None or gain > out[4]):
                        out = (f, op, cut, p / m, gain)
    return out


def verdict(rules: list[Rule]) -> Column:
    """The number of the first rule that rejects the row, or null: one ordered CASE expression."""
    if not rules:
        return F.lit(None).cast("int")
    return F.expr("case " + " ".join(f"when {r.sql()} then {k}" for k, r in enumerate(rules)) + " end")


def judged(docs: DataFrame, rules: list[Rule], params: RuleParams = RuleParams()) -> DataFrame:
    """docs with ``_stats``, ``base_failed``, ``rule`` and ``kept``."""
    df = with_stats(docs).withColumn("base_failed", base_failed(params))
    cols = [c for c in df.columns if c not in _STATS]
    rule = df.select(*[F.col(f"`{c}`") for c in cols], "_stats.*").withColumn("rule", verdict(rules))
    return rule.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull()).drop(*[s for s in _STATS if s not in docs.columns])
