"""Toxicity by weak supervision: many voters, a label model, a linear classifier.

Voters are lexicons and patterns.  A lexicon is a list of terms: whole words, or beginnings of
words (written with a star).  Besides the given lists, terms are mined from a
bounded sample of labelled rows.  Every document votes; the label model estimates by
expectation maximisation how often each voter fires on toxic and on clean documents, and how far
voters agree beyond that, so that voters who repeat each other share their weight.
A logistic regression on the terms and voters is trained on the posterior labels of the sample.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genospan.llm.runtime import cut
from genospan.session import ship_by_value

ship_by_value(__name__)

SAMPLE = 40_000
THRESHOLD = 0.3
UNLABELLED_WEIGHT = 0.1  # of a row without a label in the classifier's fit; one with a label weighs 1
MINED_VOTERS = 16
MOST_TERMS = 4_096
LEAST_TOXIC = 4
LEAST_LOG_ODDS = 1.5  # of the lower end of a term's 95 % interval
GIVEN_LABEL_ODDS = math.log(0.98 / 0.02)
PREFIXES = (3, 4, 5, 6, 7, 8)
KNOWN_WORDS = 60_000  # words without any term that a worker remembers
SLICE_ROWS = 256
COUNTED_ROWS = 2_048  # whose terms a worker counts before it hands them on

# Given lists, common words of insult in four languages.
LEXICONS = {
    "insult_en": ["idiot", "moron", "stupid", "loser", "scum", "trash", "pathetic", "worthless", "disgusting", "clown", "dumb", "jerk", "fool", "pig"],
    "insult_de": ["idiot", "dumm*", "blöd*", "trottel", "depp", "abschaum", "versager", "wertlos*", "widerlich*", "erbärmlich*"],
    "insult_fr": ["idiot*", "stupide*", "imbécile*", "crétin*", "abruti*", "minable*", "ordure*", "dégoûtant*"],
    "insult_es": ["idiota*", "estúpid*", "imbécil*", "tont*", "basura", "patétic*", "asqueros*", "escoria"],
}
PATTERNS = {
    "shouting": r"!{3,}",
    "capitals": r"\b[A-ZÀ-Þ]{4,}(?: [A-ZÀ-Þ]{3,}){2,}",
    "stretched": r"([^\W\d_])\1{3,}",
    "masked": r"\b[^\W\d_]+[*@#$]{2,}[^\W\d_]*",
}
_WORD = re.compile(r"[^\W\d_]+")


def terms_of(word: str) -> list[str]:
    """A word and its beginnings."""
    return [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) > n)]


def training_row(doc_id: Column) -> Column:
    """Whether labels of a document may be learnt from; the rest is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2, F.lit(True))


class Terms:
    """Finds the numbered terms of a text; words without any are remembered, up to a bound."""

    def __init__(self, terms: list[str]) -> None:
        self.index = {t: i for i, t in enumerate(terms)}
        self.plain: set[str] = set()

    def of(self, text: str) -> set[int]:
        found: set[int] = set()
        for word in set(_WORD.findall(text.lower())).difference(self.plain):
            hits = [self.index[t] for t in terms_of(word) if t in self.index]
            if hits:
                found.update(hits)
            elif len(self.plain) < KNOWN_WORDS:
                self.plain.add(word)
        return found


def _texts(column: pa.Array) -> Iterator[str]:
    for lo in range(0, len(column), SLICE_ROWS):
        for t in column.slice(lo, SLICE_ROWS).to_pylist():
            yield t or ""


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for lo in range(0, whole.num_rows, COUNTED_ROWS):
            seen: Counter[str] = Counter()
            for text in _texts(whole.column(0).slice(lo, COUNTED_ROWS)):
                seen.update({t for w in set(_WORD.findall(text.lower())) for t in terms_of(w)})
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["term", "n"])


def mined_terms(sample: DataFrame, text: str, label: str, most_terms: int) -> list[str]:
    """Terms of toxic sample rows that are rare in clean ones, at most ``most_terms``, best first.

    Every term with enough toxic rows is judged by the lower end of its log odds' 95 % interval; the bound takes the best.
    """
    sizes = {r[0]: r["count"] for r in sample.groupBy(label).count().collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        return []

    def counted(value: int, name: str) -> DataFrame:
        counts = sample.where(F.col(label) == value).select(text).mapInArrow(_count_terms, "term string, n long")
        return counts.groupBy("term").agg(F.sum("n").alias(name))

    both = counted(1, "toxic").where(F.col("toxic") >= LEAST_TOXIC).join(counted(0, "clean"), "term", "left")
    a, b = F.col("toxic") + 0.5, F.coalesce("clean", F.lit(0)) + 0.5
    odds = F.log(a / (n_toxic + 1)) - F.log(b / (n_clean + 1)) - 1.96 * F.sqrt(1 / a + 1 / b)
    good = both.select("term", "toxic", odds.alias("odds")).where(F.col("odds") >= LEAST_LOG_ODDS)
    return [r["term"] for r in good.orderBy(F.desc(F.col("toxic") * F.col("odds")), "term").limit(most_terms).select("term").collect()]


def voter_names(mined: list[str]) -> tuple[list[str], dict[str, list[int]]]:
    """All voters, and for each term the lexicon voters that hold it.

    A mined term goes to a voter by its rank and kind, so that a word and its own beginnings vote
    in different voters; the label model finds out that they repeat each other.
    """
    names = [*LEXICONS, *PATTERNS, *(f"mined_{k}" for k in range(MINED_VOTERS)), "no_term"]
    at = {n: i for i, n in enumerate(names)}
    holders: dict[str, list[int]] = {}
    for name, terms in LEXICONS.items():
        for t in terms:
            holders.setdefault(t, []).append(at[name])
    for rank, t in enumerate(mined):
        kind = len(t) % 4 if t.endswith("*") else 0
        holders.setdefault(t, []).append(at[f"mined_{4 * kind + rank % 4}"])
    return names, holders


class Voters:
    """The terms and the voters of a text; ``masks`` holds the voters of each term as bits."""

    def __init__(self, terms: list[str], masks: list[int], none_bit: int, patterns: list[tuple[str, int]]) -> None:
        self.finder, self.masks, self.none_bit = Terms(terms), masks, none_bit
        self.patterns = [(re.compile(p), bit) for p, bit in patterns]

    def of(self, text: str) -> tuple[set[int], int]:
        hits, mask = self.finder.of(text), 0
        for i in hits:
            mask |= self.masks[i]
        if not hits:
            mask |= self.none_bit
        for pattern, bit in self.patterns:
            if pattern.search(text):
                mask |= bit
        return hits, mask


def _fired(mask: int) -> list[int]:
    return [k for k in range(mask.bit_length()) if mask >> k & 1]


def _vote(voters: tuple):
    """Adds to each row of (rest, text) its votes and the numbers of its terms, a slice of rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        panel = Voters(*voters)
        for whole in batches:
            for lo in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(lo, SLICE_ROWS)
                votes, found = [], []
                for text in _texts(batch.column(batch.num_columns - 1)):
                    hits, mask = panel.of(text)
                    votes.append(mask)
                    found.append(np.array(sorted(hits), np.int32))
                columns = [*batch.columns, pa.array(votes, pa.int64()), pa.array(found, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "votes", "terms"])

    return run


def _vote_alone(voters: tuple):
    """``_vote`` without the text."""
    vote = _vote(voters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in vote(batches):
            at = batch.num_columns - 3
            yield pa.RecordBatch.from_arrays([c for k, c in enumerate(batch.columns) if k != at], names=[n for k, n in enumerate(batch.schema.names) if k != at])

    return run


class LabelModel:
    """Class-conditional firing rates of voters, their correlations, and posteriors."""

    def __init__(self, voters: int) -> None:
        self.prior = 0.1
        self.fires = np.full((2, voters), 0.1)
        self.share = np.ones(voters)

    def log_odds(self, votes: Column, label: Column) -> Column:
        """Log odds of toxic: prior, discounted evidence of the voters that fire, and the given label where there is one.

        A voter that does not fire abstains; that no term was found is a vote of its own.
        """
        out = F.lit(math.log(self.prior / (1 - self.prior)))
        for k in range(self.fires.shape[1]):
            clean, toxic = self.fires[:, k]
            fired = F.shiftright(votes, k).bitwiseAND(F.lit(1)) == 1
            out = out + F.when(fired, F.lit(self.share[k] * math.log(toxic / clean))).otherwise(0.0)
        return out + F.when(label == 1, GIVEN_LABEL_ODDS).when(label == 0, -GIVEN_LABEL_ODDS).otherwise(0.0)

    def posterior(self, votes: Column, label: Column) -> Column:
        return 1 / (1 + F.exp(-F.greatest(F.least(self.log_odds(votes, label), F.lit(30.0)), F.lit(-30.0))))

    def fit(self, patterns: DataFrame, rounds: int = 4) -> LabelModel:
        """``patterns``: votes, label (or null), n.  First from labelled rows, then from all rows."""
        voters = self.fires.shape[1]
        fired = [F.shiftright("votes", k).bitwiseAND(F.lit(1)) for k in range(voters)]
        for step in range(rounds + 1):
            known = F.col("label").isNotNull()
            p = F.col("label").cast("double") if step == 0 else self.posterior(F.col("votes"), F.col("label"))
            rows = (patterns.where(known) if step == 0 else patterns).withColumn("p", p)
            sums = rows.agg(
                F.sum("n").alias("n"),
                F.sum(F.col("n") * F.col("p")).alias("toxic"),
                *[F.sum(F.col("n") * F.col("p") * f).alias(f"t{k}") for k, f in enumerate(fired)],
                *[F.sum(F.col("n") * f).alias(f"a{k}") for k, f in enumerate(fired)],
            ).first()
            if not sums["n"]:
                continue
            toxic, clean = sums["toxic"], sums["n"] - sums["toxic"]
            self.prior = min(max((toxic + 0.5) / (sums["n"] + 1), 1e-4), 0.5)
            for k in range(voters):
                on = sums[f"t{k}"]
                self.fires[1, k] = (on + 0.5) / (toxic + 1)
                self.fires[0, k] = (sums[f"a{k}"] - on + 0.5) / (clean + 1)
            self.fires = np.clip(self.fires, 1e-5, 1 - 1e-5)
            if step < rounds:
                self.share = self._shares(rows)
        return self

    def _shares(self, rows: DataFrame) -> np.ndarray:
        """1 / (1 + correlations with other voters inside a class), so that voters who agree anyway count once."""
        voters = self.fires.shape[1]
        on = F.filter(F.array(*[F.when(F.shiftright("votes", k).bitwiseAND(F.lit(1)) == 1, F.lit(k)) for k in range(voters)]), lambda x: x.isNotNull())
        each = rows.select("n", "p", on.alias("on")).select("n", "p", "on", F.explode("on").alias("j")).select("n", "p", "j", F.explode("on").alias("k")).where("j < k")
        pairs = each.groupBy("j", "k").agg(F.sum(F.col("n") * F.col("p")).alias("toxic"), F.sum(F.col("n") * (1 - F.col("p"))).alias("clean"))
        size = rows.agg(F.sum(F.col("n") * F.col("p")).alias("toxic"), F.sum(F.col("n") * (1 - F.col("p"))).alias("clean")).first()
        both = np.zeros((2, voters, voters))
        for r in pairs.collect():  # at most voters squared rows
            both[0, r["j"], r["k"]] = both[0, r["k"], r["j"]] = r["clean"]
            both[1, r["j"], r["k"]] = both[1, r["k"], r["j"]] = r["toxic"]
        extra = np.zeros(voters)
        total = np.array([size["clean"] or 0.0, size["toxic"] or 0.0])
        for c in (0, 1):
            rate = self.fires[c]
            spread = np.sqrt(rate * (1 - rate))
            r = (both[c] / max(total[c], 1.0) - np.outer(rate, rate)) / np.outer(spread, spread)
            np.fill_diagonal(r, 0.0)
            extra = np.maximum(extra, np.clip(r, 0.0, 1.0).sum(axis=1))
        return 1 / (1 + extra)


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    *,
    sample: int = SAMPLE,
    most_terms: int = MOST_TERMS,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """Per document: ``doc_id``, ``held_out``, ``score``, ``predicted``; see ``with_toxicity``."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    learnt = _learnt_rows(rows, labels, doc_id, label, sample)
    panel, names = _panel(learnt, most_terms)
    voted = cut(rows.mapInArrow(_vote_alone(panel), "doc_id long, votes long, terms array<int>"))
    unlabelled = _unlabelled(voted, F.col("doc_id"), learnt, sample)
    scored = voted.mapInArrow(_classifier(voted, learnt, unlabelled, panel, names), "doc_id long, score double")
    return scored.select(
        "doc_id",
        (~training_row(F.col("doc_id"))).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def with_toxicity(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", *, into: str = "toxicity", sample: int = SAMPLE, most_terms: int = MOST_TERMS
) -> DataFrame:
    """``docs`` with the column ``into``, a score from 0 to 1; a column of that name is replaced.

    Terms are mined and the classifier is fitted on at most ``sample`` labelled rows that are
    not held out and as many without a label; at most ``most_terms`` terms are mined; the label model covers all documents.  A null text counts as empty and gets the
    score of a text without terms; rows without an id are scored and never learnt from; with no toxic or no clean
    label every score is the share of toxic labels (0 without labels).
    """
    ids = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    learnt = _learnt_rows(ids, labels, doc_id, label, sample)
    panel, names = _panel(learnt, most_terms)
    kept = [c for c in docs.columns if c != into]
    others = F.struct(F.lit(1).alias("__one"), *[c for c in kept if c != text])
    rows = docs.select(others.alias("rest"), F.col(text).alias("text"))
    rest = rows.schema["rest"].dataType.simpleString()
    # The rows are written with their votes, so that no text is read twice for its terms.
    voted = cut(rows.mapInArrow(_vote(panel), f"rest {rest}, text string, votes long, terms array<int>"))
    unlabelled = _unlabelled(voted, F.col("rest")[doc_id] if doc_id != text else F.col("text"), learnt, sample)
    scored = voted.mapInArrow(_classifier(voted, learnt, unlabelled, panel, names), f"rest {rest}, text string, score double")
    return scored.select(*[F.col("text").alias(c) if c == text else F.col("rest")[c].alias(c) for c in kept], F.col("score").alias(into))


def _learnt_rows(docs: DataFrame, labels: DataFrame, doc_id: str, label: str, sample: int) -> DataFrame:
    """(id, label, text) of at most ``sample`` labelled documents that are not held out."""
    ids = docs.select(F.col("doc_id").alias("id"), "text")
    known = labels.where(F.col(doc_id).isNotNull() & F.col(label).isin(0, 1) & training_row(F.col(doc_id)))
    chosen = known.groupBy(F.col(doc_id).cast("long").alias("id")).agg(F.max(F.col(label).cast("int")).alias("label"))
    chosen = cut(chosen.orderBy(F.xxhash64("id"), "id").limit(sample))
    # At most ``sample`` pairs of numbers: small enough for every executor.
    return cut(ids.join(F.broadcast(chosen), "id").select("id", "label", "text"))


def _panel(learnt: DataFrame, most_terms: int) -> tuple[tuple, list[str]]:
    """The voters (terms, their voters as bits, the bit for no term, patterns) and their names."""
    names, holders = voter_names(mined_terms(learnt, "text", "label", most_terms))
    bit = {n: 1 << i for i, n in enumerate(names)}
    terms = sorted(holders)
    masks = [sum(1 << v for v in set(holders[t])) for t in terms]
    return (terms, masks, bit["no_term"], [(p, bit[n]) for n, p in PATTERNS.items()]), names


def _unlabelled(voted: DataFrame, doc_id: Column, learnt: DataFrame, sample: int) -> DataFrame:
    """(votes, terms) of at most ``sample`` documents that are not held out and have no label that was learnt from."""
    free = voted.select(doc_id.cast("long").alias("id"), "votes", "terms").where(F.col("id").isNotNull() & training_row(F.col("id")))
    return cut(free.join(learnt.select("id"), "id", "left_anti").orderBy(F.xxhash64("id"), "id").limit(sample).select("votes", "terms"))


def _classifier(voted: DataFrame, learnt: DataFrame, unlabelled: DataFrame, panel: tuple, names: list[str]):
    """A function over batches of (anything, votes, terms) that gives (anything, score); learnt from the votes of all rows and the labels."""
    terms = panel[0]
    sample = cut(learnt.select("label", "text").mapInArrow(_vote_alone(panel), "label int, votes long, terms array<int>"))
    counted = voted.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).select("votes", F.lit(None).cast("int").alias("label"), "n")
    given = sample.groupBy("votes", "label").agg(F.count(F.lit(1)).alias("n"))
    patterns = cut(counted.union(given.select("votes", "label", "n")))
    sizes = {r["label"]: r["s"] for r in given.groupBy("label").agg(F.sum("n").alias("s")).collect()}
    if not sizes.get(0) or not sizes.get(1):
        flat = 1.0 if sizes.get(1) else 0.0
        weights, bias = np.zeros(len(terms) + len(names)), math.log((flat + 1e-6) / (1 - flat + 1e-6))
    else:
        model = LabelModel(len(names)).fit(patterns)
        # Rows without a label count by their posterior alone.
        taken = sample.select("label", "votes", "terms").union(unlabelled.select(F.lit(None).cast("int"), "votes", "terms"))
        soft = taken.withColumn("p", model.posterior(F.col("votes"), F.col("label")))
        trust = F.when(F.col("label").isNull(), F.lit(UNLABELLED_WEIGHT)).otherwise(F.lit(1.0))
        sides = [F.struct(F.lit(y).alias("y"), (trust * p).alias("w")) for y, p in ((1.0, F.col("p")), (0.0, 1 - F.col("p")))]
        halves = F.explode(F.array(*sides))
        rows = soft.withColumn("half", halves).select("votes", "terms", "half.y", "half.w").where("w > 1e-6")
        # A row's features: the numbers of its terms, then of the voters that fire.
        fired = F.filter(F.sequence(F.lit(0), F.lit(len(names) - 1)), lambda k: F.getbit(F.col("votes"), k) == 1)
        on = F.concat(F.col("terms"), F.transform(fired, lambda k: k + len(terms)))
        numbered = rows.select("y", "w", F.transform(on, lambda k: k.cast("string")).alias("on"))
        features = [str(k) for k in range(len(terms) + len(names))]
        vectors = CountVectorizerModel.from_vocabulary(features, inputCol="on", outputCol="x", minTF=0.0).setBinary(True).transform(numbered)
        fitted = LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", maxIter=40, regParam=1e-4).fit(vectors)
        bias, weights = float(fitted.intercept), fitted.coefficients.toArray()
    by_term, by_voter = weights[: len(terms)], weights[len(terms) :]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.num_columns - 2
            votes = batch.column(at).to_numpy(zero_copy_only=False)
            found = batch.column(at + 1)
            edge = found.offsets.to_numpy().astype(np.int64)
            held, z = edge[1:] > edge[:-1], np.full(batch.num_rows, bias)
            z[held] += np.add.reduceat(by_term[found.values.to_numpy()[: edge[-1]]], edge[:-1][held]) if held.any() else 0.0
            for k, w in enumerate(by_voter.tolist()):
                z = z + np.where(votes >> k & 1, w, 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40))))], names=[*batch.schema.names[:at], "score"])

    return score
