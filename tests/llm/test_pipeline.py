import random
import re

import corpus_pipeline
from docquarry.llm.exact_dedup import drop_exact_duplicates, exact_duplicates
from docquarry.llm.near_dedup import near_duplicates


def plain(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def test_exact_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([None, "", " ", "a b", "ab", "a\tb ", " ab", "é e", "e é", "x" * 500, "long " * 300])) for i in range(300)]
    rows += [(None, "ab"), (None, "only me"), (7, rows[7][1])]
    df = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, sha string")
    groups = {}
    for i, t in rows:
        groups.setdefault(plain(t), []).append((-len(t or ""), i if i is not None else 2**63, i))
    got = sorted(map(str, [(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_duplicates(df).collect()]))
    want = sorted(map(str, [(i, min(groups[plain(t)])[2], len(groups[plain(t)]), min(groups[plain(t)])[2] == i) for i, t in rows]))
    assert got == want
    kept = drop_exact_duplicates(df)
    assert kept.columns == df.columns and sorted(map(str, [r.doc_id for r in kept.collect()])) == sorted(str(min(g)[2]) for g in groups.values())
    assert exact_duplicates(df.limit(0)).count() == 0


def test_stages(spark, tmp_path):
    rng = random.Random(8)
    vocab = [a + b for a in ("th", "er", "on", "an", "re", "in") for b in ("ea", "st", "ou", "ing", "ly", "ha")]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    rows, labels = [], []
    for i in range(300):
        bad = i % 4 == 0
        t = text(40) + (" idiot moron " + text(5) + " idiot" if bad else "")
        rows.append((i, t))
        if i % 5:
            labels.append((i, 1, int(bad)))
    clean = text(60)
    near = clean.split()
    near[0] = "zz"
    rows += [(1000, clean), (1001, clean + " "), (1002, " ".join(near)), (1003, "my token = " + "f0" * 20 + " " + text(30)), (1004, None), (1005, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    at, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, at, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = {r.doc_id: r for r in at.collect()}
        if name != "packing":
            assert at.columns == docs.columns
    assert set(seen["toxicity"]) == {i for i, t in rows if "idiot" not in (t or "")}
    assert set(seen["toxicity"]) - set(seen["exact_dedup"]) == {1000, 1005}  # the longer copy stays; null before empty by id
    assert set(seen["exact_dedup"]) - set(seen["near_dedup"]) == {1002}
    assert "f0f0" not in seen["secrets"][1003].text and seen["secrets"][1003].n_chars == len(seen["secrets"][1003].text)
    assert set(seen["packing"]) == set(seen["secrets"]) == set(seen["near_dedup"])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == at.count()


def test_null_ids_in_near_dedup(spark, tmp_path):
    """Documents without an id are told apart by their texts: clean ones stay, near copies go."""
    rng = random.Random(5)
    text = lambda: " ".join(f"w{rng.randrange(900)}" for _ in range(60))
    a, b, c, d = (text() for _ in range(4))
    near = lambda t: t.rsplit(" ", 1)[0] + " zz"
    rows = [(1, a), (None, near(a)), (None, b), (None, near(b)), (None, c), (None, c), (None, None), (2, d)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.near_dedup_stage(spark, docs, str(tmp_path)).collect()]
    assert {(1, a), (2, d), (None, c), (None, None)} <= set(kept) and len(kept) == 5
    assert sum(t in (b, near(b)) for _, t in kept) == 1
    found = near_duplicates(docs).collect()
    assert len(found) == len(rows) and sum(r.doc_id is None for r in found) == 6
    assert [r.component_id for r in found if r.doc_id is None and r.n_shingles and r.component_id == 1] == [1]
