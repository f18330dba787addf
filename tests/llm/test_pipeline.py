"""The corpus pipeline and each of its stages on awkward documents."""

import collections
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from test_llm_operators import shingles

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, toxicity double, entities string, copies long, size long, rate double, kept boolean, rest string"
LABELS = "doc_id long, quality int, toxic int"


def awkward(n=90, seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choices(words, k=rng.randrange(20, 60))) for _ in range(n)]
    texts = [t + " you worthless idiot scum" * 3 if i % 6 == 5 else t for i, t in enumerate(texts)]
    base = rng.choices(words, k=120)
    for k in range(8):
        near = list(base)
        near[k * 9] = "changed"
        texts.append(" ".join(near))
    texts += [texts[1], texts[2], "Mr John Smith wrote to ann@mail.com. Smith left.", "call +1 555 123 4567 now", None, "", "  \n", "one", "z" * 20_000, "long " * 15_000]
    rows = [(i, t, "en", None if i % 11 == 0 else f"s{i % 3}", None if t is None else len(t), 0.5, "e", 7, 8, 0.1, False, "r") for i, t in enumerate(texts)]
    return rows + [(None, texts[1], "en", "s1", 3, 0.5, "e", 7, 8, 0.1, False, "r"), rows[4], (4, "another text under the same id", "en", "s1", 30, 0.5, "e", 7, 8, 0.1, False, "r")]


@pytest.fixture()
def sf_dir(spark, tmp_path):
    def write(rows, labels):
        spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
        spark.createDataFrame(labels, LABELS).write.parquet(f"{tmp_path}/labels.parquet")
        return str(tmp_path)

    return write


def labels_of(rows):
    return [(r[0], 1, int("idiot" in (r[1] or ""))) for r in rows if r[0] is not None and r[0] < 90]


def plain(df):
    return collections.Counter(tuple(r) for r in df.collect())


def test_stages(spark, sf_dir):
    rows = awkward()
    folder = sf_dir(rows, labels_of(rows))
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    all_rows = plain(docs)
    stages = dict(corpus_pipeline.STAGES)

    clean = stages["toxicity"](spark, docs, folder)
    left = plain(clean)
    assert clean.columns == docs.columns and not left - all_rows
    assert sum("idiot" in (r[1] or "") for r in left) < sum("idiot" in (r[1] or "") for r in all_rows)
    assert all(left[r] == n for r, n in all_rows.items() if "idiot" not in (r[1] or ""))

    once = stages["minhash_near_dedup"](spark, docs, folder)
    kept = plain(once)
    assert once.columns == docs.columns and not kept - all_rows
    # One row an id; of each group of alike texts the smallest id stays; rows without an id stay.
    known = {}
    for r in all_rows:
        if r[0] is not None:
            known.setdefault(r[0], []).append(shingles(r[1], 5))
    group = {i: i for i in known}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    ids = sorted(known)
    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in known[a] for y in known[b]):
                group[max(root(a), root(b))] = min(root(a), root(b))
    assert collections.Counter(r[0] for r in kept) == collections.Counter({i: 1 for i in ids if root(i) == i} | {None: 1})

    hidden = stages["pii"](spark, docs, folder)
    texts = {r["doc_id"]: r for r in hidden.collect() if r["doc_id"] != 4}
    assert hidden.columns == docs.columns and hidden.count() == docs.count()
    told = next(r for r in rows if r[1] and r[1].startswith("Mr John"))
    assert not any(x in texts[told[0]]["text"] for x in ("Smith", "John", "ann@mail")) and texts[told[0]]["n_chars"] == len(texts[told[0]]["text"])
    assert all(texts[r[0]]["text"] == r[1] and texts[r[0]]["n_chars"] == r[4] for r in rows[:90] if r[0] != 4)

    mixed = stages["source_mixing"](spark, docs, folder)
    assert mixed.columns == docs.columns and all(n <= 2 * all_rows[r] for r, n in plain(mixed).items()) and not set(plain(mixed)) - set(all_rows)

    packed = stages["packing"](spark, docs, folder)
    lengths = {(r["sequence_id"], r["offset"]): r["length"] for r in packed.collect()}
    assert sum(lengths.values()) == packed.agg(F.sum("length")).first()[0]
    per_document = packed.groupBy("doc_id", "doc_tokens").agg(F.sum("length").alias("n"), F.count_if(F.col("start") == 0).alias("rows"))
    assert per_document.where(F.col("n") != F.col("doc_tokens") * F.col("rows")).count() == 0
    assert packed.where("start = 0").count() == len(rows)


def test_run_is_the_stages_in_order(spark, sf_dir):
    rows = awkward()
    folder = sf_dir(rows, labels_of(rows))
    got = corpus_pipeline.run(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), docs.schema)
    taken = docs.count()
    assert 0 < taken < len(rows)
    mixed = corpus_pipeline.mix(spark, docs, folder).count()
    assert got.where("start = 0").count() == mixed


def test_empty_tables(spark, sf_dir):
    folder = sf_dir([], [])
    assert corpus_pipeline.run(spark, folder).count() == 0
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and out.count() == 0
