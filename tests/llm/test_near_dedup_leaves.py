import numpy as np

from docquarry.llm import near_dedup
from docquarry.llm.shared import among, sieve


def test_sieve_holds_its_ids_and_few_others(spark):
    ids = [*range(0, 40_000, 4), -5, 2**63 - 1, None]
    holds = sieve(spark.createDataFrame([(i,) for i in ids], "id long").repartition(3))
    assert holds(np.array(ids[:-1], np.int64)).all()
    assert holds(np.arange(1, 40_000, 4)).mean() < 0.05
    rows = spark.createDataFrame([(4, "a"), (5, None), (8, "b"), (6, "c")], "id long, x string")
    kept, left = ({r.id for r in among(rows, holds, w).collect()} for w in (True, False))
    assert {4, 8} <= kept and kept | left == {4, 5, 6, 8} and not kept & left
    assert not sieve(spark.createDataFrame([], "id long"))(np.arange(9)).any()


def test_leaves_are_rows_of_ids_and_lone_texts_stay_behind(spark, monkeypatch):
    """A leaf is one row, however many classes meet in it; texts that share no node are not kept for comparing."""
    held, real = {}, near_dedup.written

    def counted(df, name, arrow_rows=None):
        held[name] = real(df, name, arrow_rows)
        return held[name]

    monkeypatch.setattr(near_dedup, "written", counted)
    g = np.random.default_rng(2)
    lone = [(i, " ".join(f"w{x}" for x in g.integers(0, 10**9, 30))) for i in range(300)]
    base = [f"v{i}" for i in range(60)]
    alike = [(1000 + i, " ".join([*base, f"x{i}"])) for i in range(5)]
    found = near_dedup.near_duplicates(spark.createDataFrame(lone + alike, "doc_id long, text string"))
    assert {r.doc_id for r in found.filter("kept").collect()} == {*range(300), 1000}
    leaves = held["leaves"].collect()
    assert max(len(r.ids) for r in leaves) == 5 and len({tuple(r.ids) for r in leaves}) == len(leaves)
    assert held["texts"].count() < 40


def _classes(spark, tokens):
    rows = [(i, 100, [int(x) for x in t], bytes(near_dedup.PLANES * near_dedup.BINS // 8)) for i, t in enumerate(tokens)]
    return spark.createDataFrame(rows, "id long, n long, tokens array<int>, sketch binary")


def test_family_inside_a_family_leaves_out_what_met_in_a_leaf(spark, monkeypatch):
    """300 classes share half of their tokens, 100 of them three more; groups of 20 share ten others, which are leaves once."""
    paths, real = [], near_dedup.written

    def counted(df, name, arrow_rows=None):
        out = real(df, name, arrow_rows)
        if name == "paths":
            paths.append(out.count())
        return out

    monkeypatch.setattr(near_dedup, "written", counted)
    g = np.random.default_rng(5)
    tokens = g.integers(1, 2**30, (300, near_dedup.TOKENS))
    tokens[:, :45] = 7
    tokens[:100, 45:48] = 8
    tokens[:, 50:60] = (np.arange(300) // 20)[:, None]
    leaves, families, _ = near_dedup._nodes(_classes(spark, tokens), 4)
    met = {(a, b) for r in leaves.collect() for a in r.ids for b in r.ids}
    assert all((a, b) in met for a in range(300) for b in range(300) if a // 20 == b // 20)
    assert families.count() >= 300 + 100
    assert sum(paths) < 9_000, paths
