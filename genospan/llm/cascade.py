"""Quality rules as a short-circuit cascade, in DataFrame functions only.

A rule rejects a text by its features.  On a bounded sample every rule is timed alone and every
sampled text meets all rules; the cascade then asks, again and again, for the rule that rejects
most of what is left per second; the base rules come before the others.  The rules are joined by "or", so that
their order changes the time a text takes and never the verdict.  Nothing is shuffled: a row's verdict follows from its text.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genospan.llm.runtime import cut
from genospan.llm.words import WORD_PATTERN
from genospan.scale import all_of

SAMPLE_ROWS = 2_000  # of which costs and selectivities are estimated
LEAST_WORDS = 50
MOST_REPEATED = 50  # per cent of the words

REPEATS = "n_repeat_words"  # the feature that needs steps of its own
_TEXT, _WORDS, _REPEATS = "__cascade_text", "__cascade_words", "__cascade_repeats"

# Characters that count as symbols.
SYMBOLS = "[#*$%&|<>]"


def _n_words() -> Column:
    return F.size(_WORDS)


def _word_chars() -> Column:
    return F.char_length(F.array_join(_WORDS, ""))


def _n_symbols() -> Column:
    return F.regexp_count(F.col(_TEXT), F.lit(SYMBOLS))


def _full_lines() -> Column:
    return F.filter(F.split(_TEXT, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))


def _n_dup_lines() -> Column:
    lines = F.when(F.instr(_TEXT, "\n") > 0, _full_lines())
    return F.coalesce(F.size(lines) - F.size(F.array_distinct(lines)), F.lit(0))


def _with_repeats(frame: DataFrame, wanted: Column) -> DataFrame:
    """``frame`` with the words in windows of three words that occur twice or more, where ``wanted`` holds (else null).

    Each window's hash, its low bits replaced by its place, sorts equal windows side by side; neighbours are then
    compared word by word.  Where unequal windows share a hash, the windows themselves are sorted.
    One step a projection: each array is made once, and sorted as an array of plain longs.
    """
    n = F.size(_WORDS)
    own = [F.col(c) for c in frame.columns]
    mask, keys, twins = (F.col(f"__cascade_{c}") for c in ("mask", "keys", "twins"))
    low_bits = F.expr(f"shiftleft(1L, length(bin(size({_WORDS})))) - 1L")
    first = frame.select(*own, F.when(wanted, low_bits).alias("__cascade_mask"))

    def key(word: Column, k: Column) -> Column:
        hashed = F.xxhash64(word, F.get(_WORDS, k + 1), F.get(_WORDS, k + 2))
        return hashed.bitwiseAND(F.bitwise_not(F.coalesce(mask, F.lit(0).cast("long")))).bitwiseOR(k.cast("long"))

    windows = F.when(mask.isNotNull() & (n >= 4), F.slice(F.transform(_WORDS, key), 1, n - 2))
    second = first.select(*own, mask, F.sort_array(windows).alias("__cascade_keys"))
    step = lambda i: F.get(keys, i).bitwiseXOR(F.get(keys, i - 1))
    found = F.filter(F.sequence(F.lit(1), F.size(keys) - 1), lambda i: step(i).between(0, mask))
    third = second.select(*own, mask, keys, F.when(keys.isNotNull(), found).alias("__cascade_twins"))
    place = lambda i: F.get(keys, i).bitwiseAND(mask).cast("int")
    near = lambda i: F.array(*[p + k for p in (place(i), place(i - 1)) for k in range(3)])
    same = lambda i: all_of([F.get(_WORDS, place(i) + k) == F.get(_WORDS, place(i - 1) + k) for k in range(3)])
    covered = F.size(F.array_distinct(F.flatten(F.transform(twins, near))))
    count = F.when(mask.isNull(), F.lit(None)).when(F.coalesce(F.size(twins), F.lit(0)) <= 0, F.lit(0))
    count = count.when(F.forall(twins, same), covered).otherwise(_by_windows())
    return third.select(*own, count.cast("long").alias(_REPEATS))


def _by_windows() -> Column:
    """Words in repeated windows of three, by sorting the windows of words themselves."""
    n = F.size(_WORDS)
    part = lambda k: F.slice(_WORDS, k, n - 2)
    windows = F.sort_array(F.arrays_zip(part(1), part(2), part(3), F.sequence(F.lit(0), n - 3)))

    def covered(s: Column) -> Column:
        pairs = F.arrays_zip(F.slice(s, 1, F.size(s) - 1), F.slice(s, 2, F.size(s) - 1))
        twins = F.filter(pairs, lambda p: all_of([p["0"][str(k)] == p["1"][str(k)] for k in range(3)]))
        near = lambda p: F.array(*[p[side]["3"] + k for side in "01" for k in range(3)])
        return F.size(F.array_distinct(F.flatten(F.transform(twins, near))))

    return F.when(n >= 4, F.transform(F.array(windows), covered)[0]).otherwise(F.lit(0))


FEATURES: dict[str, Callable[[], Column]] = {
    "n_words": _n_words,
    "word_chars": _word_chars,
    "n_symbols": _n_symbols,
    "n_dup_lines": _n_dup_lines,
    "n_lines": lambda: F.size(_full_lines()),
    REPEATS: lambda: F.col(_REPEATS),
}


@dataclass(frozen=True)
class Rule:
    """A reason to reject: ``fails`` gets a function that gives each feature as a column of whole numbers."""

    name: str
    fails: Callable[[Callable[[str], Column]], Column]


RULES = (
    Rule("few_words", lambda f: f("n_words") < LEAST_WORDS),
    Rule("repeated_words", lambda f: 100 * f("n_repeat_words") > MOST_REPEATED * f("n_words")),
    Rule("odd_word_length", lambda f: (f("word_chars") < 2 * f("n_words")) | (f("word_chars") > 12 * f("n_words"))),
    Rule("symbols", lambda f: 10 * f("n_symbols") > f("n_words")),
    Rule("duplicate_lines", lambda f: 2 * f("n_dup_lines") > f("n_lines")),
)
BASE = ("few_words", "repeated_words")


@dataclass(frozen=True)
class Estimate:
    """A rule's seconds a row and, in the order chosen, the share of the sample that it rejects after the rules before it."""

    rule: Rule
    seconds: float
    rejects: float


def _prepared(docs: DataFrame, text: str) -> DataFrame:
    """The rows with their text (null as empty) and its words beside their own columns."""
    filled = docs.withColumn(_TEXT, F.coalesce(F.col(text).cast("string"), F.lit("")))
    return filled.withColumn(_WORDS, F.regexp_extract_all(_TEXT, F.lit(WORD_PATTERN), F.lit(0)))


def _asks(rule: Rule) -> set[str]:
    """The features that a rule asks for."""
    asked: set[str] = set()
    rule.fails(lambda name: (asked.add(name), F.lit(0))[1])
    return asked


def _timed(frame: DataFrame, value: Column) -> float:
    seconds = []
    for _ in range(2):
        began = time.perf_counter()
        frame.agg(F.count_if(value)).collect()
        seconds.append(time.perf_counter() - began)
    return min(seconds)


def plan_cascade(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES, *, sample_rows: int = SAMPLE_ROWS) -> list[Estimate]:
    """``rules`` in the order of rejection per cost, estimated on about ``sample_rows`` rows.

    Each next rule is the one with the most rows, among those no earlier rule rejects, per second; equal
    ones stay in the order given.  An empty table leaves the order as it is.
    """
    total = docs.count()
    if not total:
        return [Estimate(r, 0.0, 0.0) for r in rules]
    picked = docs.select(F.col(text).alias("text")).sample(min(1.0, 1.2 * sample_rows / total), seed=11).limit(sample_rows)
    sample = cut(_prepared(picked, "text").select(_TEXT, _WORDS))
    feature = lambda name: FEATURES[name]()
    rows = max(sample.count(), 1)
    idle = _timed(sample, F.size(_WORDS) < 0)
    repeats = _with_repeats(sample, F.lit(True))
    costs = [max(_timed(repeats if REPEATS in _asks(r) else sample, r.fails(feature)) - idle, 1e-4) / rows for r in rules]
    bits = [F.when(r.fails(feature), F.lit(1 << k)).otherwise(F.lit(0)) for k, r in enumerate(rules)]
    seen = repeats.select(sum(bits, F.lit(0)).alias("fails")).groupBy("fails").agg(F.count(F.lit(1)).alias("n"))
    left = {r["fails"]: r["n"] for r in seen.collect()}  # at most one row for each set of rules
    order, waiting = [], list(range(len(rules)))
    while waiting:
        rejects = {k: sum(n for fails, n in left.items() if fails >> k & 1) for k in waiting}
        k = max(waiting, key=lambda k: (rejects[k] / costs[k], -k))
        order.append(Estimate(rules[k], costs[k], rejects[k] / rows))
        left = {fails: n for fails, n in left.items() if not fails >> k & 1}
        waiting.remove(k)
    return order


def quality_cascade(
    docs: DataFrame,
    text: str = "text",
    *,
    rules: Sequence[Rule] = RULES,
    base: Sequence[str] = BASE,
    features: Sequence[str] = (),
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """``docs`` with ``features``, ``base_failed`` (one of the ``base`` rules rejects) and ``kept`` (no rule rejects).

    A feature asked for is computed for every row, any other only where the cascade comes to its rule.
    A null text counts as empty: no words, so that the first base rule rejects it.  Repeated rows get
    equal verdicts, an empty table gives an empty one, columns of the same names as the new ones are replaced.
    """
    made = [*features, "base_failed", "kept"]
    own = [c for c in docs.columns if c not in made]
    order = [e.rule for e in plan_cascade(docs, text, rules, sample_rows=sample_rows)]
    renamed = docs.select(*[F.col(c).alias(f"__cascade_own_{k}") for k, c in enumerate(own)], F.col(text).alias("__cascade_source"))
    order = [r for r in order if r.name in base] + [r for r in order if r.name not in base]
    asked = {name: f"__cascade_{name}" for name in features}

    def fails_any(chosen: Sequence[Rule], feature: Callable[[str], Column]) -> Column:
        out = F
        for rule in chosen:
            out = out.when(rule.fails(feature), F.lit(True))
        return out.otherwise(F.lit(False)) if chosen else F.lit(False)

    plain = lambda name: FEATURES[name]()
    frame = _prepared(renamed, "__cascade_source").drop("__cascade_source")
    late = next((k for k, r in enumerate(order) if REPEATS in _asks(r)), None)
    if REPEATS in features or late is not None:
        wanted = F.lit(True) if REPEATS in features else ~fails_any(order[:late], plain)
        frame = _with_repeats(frame, wanted)
    own_features = [FEATURES[name]().cast("long").alias(c) for name, c in asked.items()]
    known = frame.select(*frame.columns, *own_features)
    feature = lambda name: F.col(asked[name]) if name in asked else FEATURES[name]()
    judged = known.withColumn("__cascade_base", fails_any([r for r in order if r.name in base], feature))
    rest = fails_any([r for r in order if r.name not in base], feature)
    return judged.select(
        *[F.col(f"__cascade_own_{k}").alias(c) for k, c in enumerate(own)],
        *[F.col(c).alias(name) for name, c in asked.items()],
        F.col("__cascade_base").alias("base_failed"),
        F.when(F.col("__cascade_base"), F.lit(False)).otherwise(~rest).alias("kept"),
    )
