"""Jaccard join, components, decontamination and the pipeline."""

import random

import pytest
from pyspark.sql import functions as F

from copse.llm import decontam, jaccard


def _shingles(t):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def _components(rows):
    sets, parent = [_shingles(t) for _, t in rows], list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least.setdefault(find(i), []).append(d)
    return sorted((d, len(sets[i]), min((x for x in least[find(i)] if x is not None), default=None)) for i, (d, _) in enumerate(rows) if d is not None)


def _corpus(seed=1, n=120):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    passage = " ".join(rng.choices(words, k=60))
    base = [rng.choices(words, k=rng.randint(20, 120)) for _ in range(12)]
    rows = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4, 8])):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((i, " ".join(w) + (" " + passage if i % 4 == 0 else "")))
    return rows + [(900, None), (901, ""), (902, "one two"), (903, "ONE\ttwo"), (904, "x " * 30_000), (905, "one two three four five"), (906, "one two three four five"), (7, rows[7][1])]


@pytest.mark.parametrize("part,usual", [(128, 16), (3, 1)])
def test_join_against_brute_force(docs, monkeypatch, part, usual):
    monkeypatch.setattr(jaccard, "PART", part)
    monkeypatch.setattr(jaccard, "USUAL", usual)
    rows = _corpus()
    got = jaccard.jaccard_components(docs(rows)).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == _components(rows)


def test_join_empty_null_ids_and_representatives(docs):
    assert jaccard.jaccard_components(docs([])).isEmpty()
    rows = [(None, "a b c d e f g h i j"), (4, "a b c d e f g h i j"), (3, "k l m n o"), (3, "p q r s t"), (None, "z"), (8, None), (8, None)]
    got = sorted((r["n_shingles"], r["doc_id"] or -1, r["component_id"] or -1) for r in jaccard.jaccard_components(docs(rows)).collect())
    assert got == [(0, 8, 8), (0, 8, 8), (1, -1, -1), (1, 3, 3), (1, 3, 3), (6, -1, 4), (6, 4, 4)]
    df = docs(rows)
    kept = jaccard.keep_representatives(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] or -1, r["text"] or "") for r in kept.collect()) == [(-1, "z"), (3, "k l m n o"), (3, "p q r s t"), (4, "a b c d e f g h i j"), (8, ""), (8, "")]


def test_representatives_of_components(docs):
    rows = [r for r in _corpus(3) if r[1]][:-1]
    want = {c for _, _, c in _components(rows)}
    kept = [r["doc_id"] for r in jaccard.keep_representatives(docs(rows)).collect()]
    assert len(kept) == len(set(kept)) == len(want) and set(kept) == want


def test_long_chain_settles(spark):
    links = spark.range(300).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    roots = jaccard.components(links).collect()
    assert len(roots) == 300 and {r["root"] for r in roots} == {0}


def test_signature_bounds_overlap():
    from copse.llm.texts import shingle_set

    rng = random.Random(2)
    for _ in range(30):
        w = [str(rng.randrange(50)) for _ in range(rng.randint(5, 300))]
        a, b = shingle_set(" ".join(w)), shingle_set(" ".join(w[: rng.randint(5, len(w))] + ["q"] * rng.randint(0, 3)))
        left, _ = jaccard.qualifying([(len(a), jaccard.signature(a))], [(len(b), jaccard.signature(b))])
        inter = len(set(a.tolist()) & set(b.tolist()))
        assert left or 100 * inter < 80 * (len(a) + len(b) - inter)


def test_leaks_against_brute_force(spark, docs):
    rng = random.Random(8)
    words = [f"v{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([6, 14, 30, 59, 200])))) for i in range(40)] + [(100, "tiny item here"), (101, None), (102, ""), (3, "again the same id but different words in it")]
    rows = []
    for i in range(80):
        w = rng.choices(words, k=rng.randint(0, 400))
        for _ in range(i % 4):
            t = rng.choice(items[:40])[1].split()
            t = t[: rng.choice([len(t), int(len(t) * 0.9), len(t) // 2])]
            k = rng.randint(0, len(w))
            w[k:k] = t
        rows.append((i, " ".join(w)))
    rows += [(200, None), (201, "tiny item"), (202, "a Tiny ITEM here b"), (203, "y " * 50_000 + items[5][1]), (5, rows[5][1])]
    bench = spark.createDataFrame([(*x, "e") for x in items], "item_id long, text string, doc_id string")
    want = []
    for d, t in rows:
        w = (t or "").lower().split()
        for i, q in items:
            qw = (q or "").lower().split()
            k = min(5, len(qw))
            if not k:
                continue
            grams = {tuple(qw[j : j + k]) for j in range(len(qw) - k + 1)}
            have = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
            if 100 * len(grams & have) >= 80 * len(grams):
                want.append((d, i))
    got = decontam.find_leaks(docs(rows), bench, block_items=17)
    assert sorted((r["doc_id"], r["item_id"]) for r in got.collect()) == sorted(want)
    clean = decontam.drop_leaks(docs(rows), bench)
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(d for d, _ in rows if d not in {x for x, _ in want}) and clean.columns == docs(rows).columns
    assert decontam.find_leaks(docs([]), bench).isEmpty() and decontam.find_leaks(docs(rows), bench.where("false")).isEmpty()


def test_pipeline_stages(spark, docs, tmp_path):
    import corpus_pipeline

    rng = random.Random(9)
    words = [f"t{c}{d}" for c in "abcdefghij" for d in "klmnopqrst"]
    good = [(i, " ".join(rng.choices(words, k=60)), "en") for i in range(40)]
    near = (50, good[0][1] + " extra", "en")
    leak = "one passage that a benchmark asks for in just these words and no others at all"
    rows = [*good, (60, good[1][1], "en"), near, (70, good[2][1] + " " + leak, "en"), (80, "12 !!", "en"), (81, None, "en")]
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs(rows, clash=False).write.parquet(str(tmp_path / "documents.parquet"))
    out, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        seen.append(sorted({r["doc_id"] for r in out.select("doc_id").collect()}))
    ids = [i for i, *_ in good]
    assert seen[0] == sorted([*ids, 50, 60, 70]) and seen[1] == sorted([*(i for i in ids if i != 1), 50, 60, 70])
    assert seen[2] == sorted([*(i for i in ids if i != 1), 60, 70]) and seen[3] == seen[4] == sorted([*(i for i in ids if i != 1), 60])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
