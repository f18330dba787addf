"""Ranked search, spelling forms and the rule cascade against brute force, with the awkward rows."""

import collections
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from genospan.llm import ranking
from genospan.llm.cascade import RULES, Rule, plan_cascade, quality_cascade
from genospan.llm.ranking import rank_documents
from genospan.llm.spelling import Acceptor, near_words, spelling_forms

SCHEMA = "doc_id long, text string, lang string, n long, kept boolean, rank int, word string, term string, base_failed boolean"
UPPER = {c: c + 32 for c in range(65, 91)}


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, "en", 1, True, 2, "w", "t", False) for i, t in rows], SCHEMA).repartition(parts)


def prose(n=120, seed=5):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdeé", k=rng.randrange(3, 9))) for _ in range(150)]
    texts = [" ".join(rng.choices(words, weights=range(150, 0, -1), k=rng.randrange(1, 90))) for _ in range(n)]
    texts += [texts[0], texts[0].upper(), None, "", "  \n ", "x" * 70_000, "one line\none line\n\none line", "# # $ a|b", "A-b_c9 ½ 日本 é"]
    return list(enumerate(texts)) + [(None, texts[1]), (3, texts[3])]


# Ranked search


def ranked(docs, items, top):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(UPPER))
    counts = [(i, collections.Counter(terms(t))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in counts]
    n, total = sum(s > 0 for s in sizes), sum(sizes)
    df = collections.Counter(t for _, c in counts for t in c)
    asked = collections.defaultdict(set)
    for item, text in items:
        asked[item] |= set(terms(text))
    out = set()
    for item, wanted in asked.items():
        scored = []
        for (i, c), size in zip(counts, sizes, strict=True):
            score = 0
            for t in wanted & set(c):
                w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                score += w * ((10**9 * c[t]) // (1000 * c[t] + 20 * (50 + (50 * size * n) // total)))
            if score > 0 and i is not None:
                scored.append((-score, i))
        out |= {(item, k, i, -s) for k, (s, i) in enumerate(sorted(scored)[:top], 1)}
    return out


@pytest.mark.parametrize(("top", "at_once", "docs", "first"), [(5, 2048, 8192, 64), (50, 3, 7, 1), (1, 1, 1, 2)])
def test_ranking_equals_brute_force(spark, monkeypatch, top, at_once, docs, first):
    monkeypatch.setattr(ranking, "BLOCK_DOCS", docs)
    monkeypatch.setattr(ranking, "FIRST_STEP", first)
    rows = prose()
    items = [(k, rows[k * 7][1]) for k in range(8)] + [(8, None), (9, ""), (None, rows[2][1]), (1, "abc unheard"), (1, rows[7][1]), (10, "nowhere found")]
    item_rows = spark.createDataFrame([(i, t, 7) for i, t in items], "item_id long, text string, doc_id long")
    got = [tuple(r) for r in rank_documents(frame(spark, rows), item_rows, top=top, items_at_once=at_once).collect()]
    # Rows that repeat a document are ranked each, in either order.
    assert len(got) == len({(r[0], r[1]) for r in got})
    assert set(got) == ranked(rows, items, top)


def test_ranking_with_many_ties(spark):
    rows = [(i, "same words here") for i in range(300)] + [(i, f"other text {i}") for i in range(300, 700)]
    items = [(1, "same words here"), (2, "here")]
    got = {tuple(r) for r in rank_documents(frame(spark, rows, 5), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == ranked(rows, items, 50)
    assert [r[2] for r in sorted(got) if r[0] == 1] == list(range(50))


def test_ranking_of_empty_tables(spark):
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert rank_documents(frame(spark, [(1, "a")]).where("false"), items).count() == 0
    empty = rank_documents(frame(spark, [(1, "a")]), items.where("false"))
    assert empty.columns == ["item_id", "rank", "doc_id", "score"] and empty.count() == 0


# Spelling forms


def forms(docs, least=3):
    counts = collections.Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{i}:{run}".encode())
            if i is not None and h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= least}

    def apart(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    near = {w: [x for x in words if apart(w, x)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 2 * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return out


@pytest.mark.parametrize("most", [20_000, 3, 1])
def test_spelling_equals_brute_force(spark, most):
    rng = random.Random(2)
    base = ["".join(rng.choices("abé", k=rng.randrange(5, 10))) for _ in range(60)]
    rows = []
    for i in range(150):
        words = rng.choices(base, k=40)
        for k in range(0, 40, 4):
            w, at = words[k], rng.randrange(len(words[k]))
            words[k] = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice("abéà") + w[at:], w[:at] + "c" + w[at + 1 :]])
        rows.append((i, rng.choice([" ", ", ", "-", "Œ"]).join(w.capitalize() if rng.random() < 0.2 else w for w in words)))
    rows += [(200, None), (201, ""), (None, rows[0][1]), (5, rows[5][1]), (202, "aaaaa " * 9 + "z" * 30_000), (203, "×÷×÷× Straße STRASSE straße strasse")]
    got = [tuple(r) for r in spelling_forms(frame(spark, rows), most_in_group=most).collect()]
    want = forms(rows)
    assert len(got) == len(want) and set(got) == want
    assert any(r[1] for r in want) and any(r[2] != (r[1] or r[0]) for r in want)


def test_very_long_words_and_empty_table(spark):
    rows = [(k, " ".join(["q" * 3000, "q" * 3001, "q" * 1500 + "r" + "q" * 1500])) for k in range(9)]
    # The planted deletion changes some runs; what is left agrees with brute force.
    assert {tuple(r) for r in spelling_forms(frame(spark, rows)).collect()} == forms(rows)
    empty = spelling_forms(frame(spark, rows).where("false"))
    assert empty.columns == ["word", "form", "root", "n", "n_near", "form_n"] and empty.count() == 0


def test_acceptor_is_minimal_and_pairs_come_once(spark):
    words = sorted(["aba", "abb", "bba", "bbb", "ab", "bb", "abab"])
    found = list(Acceptor(words).one_edit(True))
    assert len(found) == len(set(found))
    # Two states for each of two left letters share everything that follows.
    assert len(Acceptor(sorted(x + y for x in "abcd" for y in ("xy", "xz"))).arcs) == 4
    one_letter = spark.createDataFrame([(f"pre{c}fix", 1) for c in "abcdefghijklmnop"], "word string, n long")
    assert near_words(one_letter, 2).count() == 16 * 15 // 2


# Rule cascade


def features(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    counts = collections.Counter(windows)
    covered = {p for k, w in enumerate(windows) if counts[w] > 1 for p in (k, k + 1, k + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n, chars = len(words), sum(map(len, words))
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    dup = len(lines) - len(set(lines))
    base = n < 50 or 100 * len(covered) > 50 * n
    kept = not (base or chars < 2 * n or chars > 12 * n or 10 * symbols > n or 2 * dup > len(lines))
    return n, chars, symbols, dup, len(covered), base, kept


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judged_texts():
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefg", k=rng.randrange(1, 9))) for _ in range(40)]
    texts = []
    for _ in range(80):
        t = rng.choices(words, k=rng.randrange(0, 140))
        t[3:3] = rng.choice([[], ["#"] * 20, ["a b c d e f"] * 9, ["x\ny\nx\n"] * 5])
        texts.append(rng.choice([" ", "\n", "\t ", "\x0b"]).join(t))
    texts += [None, "", " \n\n ", "a b c", "a a a a", "a a a", "\x1c \x85 é", "w " * 30_000, "\n".join(["same line here"] * 40), "日本 " * 60, "y" * 40_000]
    return list(enumerate(texts)) + [(None, texts[0]), (1, texts[1])]


@pytest.mark.parametrize("asked", [NAMES, ("n_words",), ()])
def test_cascade_equals_brute_force(spark, asked):
    rows = judged_texts()
    docs = frame(spark, rows)
    got = quality_cascade(docs, features=asked)
    assert got.columns == [c for c in docs.columns if c not in ("kept", "base_failed")] + [*asked, "base_failed", "kept"]
    have = collections.Counter((r["doc_id"], *(r[c] for c in asked), r["base_failed"], r["kept"]) for r in got.collect())
    want = collections.Counter()
    for i, t in rows:
        f = features(t)
        want[(i, *(f[NAMES.index(c)] for c in asked), f[5], f[6])] += 1
    assert have == want
    assert any(k[-1] for k in want) and any(not k[-1] and not k[-2] for k in want)


def test_hash_collisions_do_not_count(spark, monkeypatch):
    monkeypatch.setattr(F, "xxhash64", lambda *c: F.lit(0).cast("long"))
    rows = judged_texts()
    got = {r["doc_id"]: r["n_repeat_words"] for r in quality_cascade(frame(spark, rows), features=("n_repeat_words",), sample_rows=5).collect()}
    assert got == {i: features(t)[4] for i, t in rows}


def test_order_of_rules(spark):
    docs = frame(spark, judged_texts())
    order = plan_cascade(docs)
    assert {e.rule for e in order} == set(RULES) and all(e.seconds > 0 for e in order)
    # Two rules of equal cost: the one that rejects more comes first; what it rejects does not count for the other.
    two = [Rule("few", lambda f: f("n_words") < 5), Rule("many", lambda f: f("n_words") < 500)]
    plan = plan_cascade(docs, rules=two)
    assert [e.rule.name for e in plan][0] == "many" or plan[0].seconds < plan[1].seconds
    assert plan[[e.rule.name for e in plan].index("few")].rejects in (0.0, plan[0].rejects)
    assert [e.rule for e in plan_cascade(docs.where("false"))] == list(RULES)
    assert quality_cascade(docs.where("false"), features=NAMES).count() == 0


def test_cascade_uses_native_functions_only(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = quality_cascade(docs, features=NAMES)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "Exchange"))
