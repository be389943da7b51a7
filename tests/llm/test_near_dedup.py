import random

from docquarry.llm.components import components
from docquarry.llm.near_dedup import near_duplicates, trees_for


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, s) in enumerate(sets):
        for j, t in sets[:k]:
            if s and t and 100 * len(s & t) >= 75 * len(s | t):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return sorted((i, len(s), find(i), find(i) == i) for i, s in sets)


def test_against_brute_force(spark):
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(500)]
    rows = []
    passage = [rng.choice(vocab) for _ in range(30)]
    for g in range(25):
        base = [rng.choice(vocab) for _ in range(rng.choice([6, 40, 150]))]
        for _ in range(rng.choice([1, 2, 3, 12])):
            w = list(base)
            for _ in range(rng.randrange(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append(" ".join(w))
    hub = [rng.choice(vocab) for _ in range(200)]
    for _ in range(150):  # a family around the threshold, larger than a leaf
        w = list(hub)
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        rows.append(" ".join(w).upper() if rng.random() < 0.3 else " ".join(w))
    rows += [" ".join(passage + [rng.choice(vocab) for _ in range(60)]) for _ in range(100)]
    rows += ["a b", "A  b", "a b c", None, "", None, "  "]
    rows = list(enumerate(rows))
    rng.shuffle(rows)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, id string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df).collect())
    assert got == brute(sorted(rows))


def test_edges(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    text = " ".join(f"x{i}" for i in range(30))
    rows = near_duplicates(spark.createDataFrame([(4, text), (4, text), (None, text), (5, None)], "doc_id long, text string")).collect()
    assert sorted(map(str, [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in rows])) == sorted(map(str, [(4, 26, 4, True), (4, 26, 4, True), (None, 26, 4, False), (5, 0, 5, True)]))


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 95), (200, 300), (7, 7)]
    random.Random(1).shuffle(chain)
    got = {r.id: r.label for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[i] == 1 for i in range(1, 41)) and got[100] == got[95] == 90 and got[300] == 200
    assert trees_for(0.75, 0.9999) == 4 or trees_for(0.75, 0.9999) == 5


def _template_family(rows: int, seed: int, shared: int = 140, own: int = 35) -> list[tuple[int, str]]:
    g = random.Random(seed)
    common = [f"t{i}" for i in range(shared)]
    return [(i, " ".join(common[: shared // 2] + [f"w{g.randrange(10**9)}" for _ in range(own)] + common[shared // 2 :])) for i in range(rows)]


def test_families_around_the_threshold_equal_brute_force(spark):
    g = random.Random(11)
    rows = _template_family(150, 1)
    for start in range(0, 120, 3):  # further texts of one family: some linked to the one they come from, some not
        words = rows[start][1].split()
        for at in range(70, 70 + g.randrange(2, 34)):
            words[at] = f"v{g.randrange(10**9)}"
        rows.append((1000 + start, " ".join(words)))
    rows += [(2000 + i, t.replace("t1 ", "u1 ")) for i, t in _template_family(100, 2, 150, 12)]  # similar to one another
    g.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs).collect()) == brute(sorted(rows))


def test_template_family_work_grows_with_rows(spark, monkeypatch):
    """Texts that share a template, but not three quarters, are not compared with all others."""
    from docquarry.llm import near_dedup

    handed = {}
    real = near_dedup.written

    def counted(df, name, arrow_rows=None):
        out = real(df, name, arrow_rows)
        if name in ("paths", "pairs", "core"):
            handed[size] += out.count()
        return out

    monkeypatch.setattr(near_dedup, "written", counted)
    for size in (500, 2000):
        handed[size] = 0
        docs = spark.createDataFrame(_template_family(size, 3), "doc_id long, text string")
        assert near_duplicates(docs).filter("not kept").isEmpty()
    assert handed[2000] < 6 * handed[500]


def test_repeated_ids_let_the_larger_set_speak(spark):
    long = " ".join(f"a{i}" for i in range(40))
    rows = [(1, long), (1, "few words"), (2, long), (3, "few words"), (3, "few words")]
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in found.collect()) == [
        (1, 1, 1, True), (1, 36, 1, True), (2, 36, 1, False), (3, 1, 3, True), (3, 1, 3, True)
    ]
