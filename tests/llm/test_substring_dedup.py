import hashlib
import random

from docquarry.llm.substring_dedup import remove_repeated_passages


def brute(rows, width):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in words:
        for p in range(len(w) - width + 1):
            k = tuple(w[p : p + width])
            first[k] = min(first.get(k, i), i)
    out = []
    for i, w in words:
        gone = set()
        for p in range(len(w) - width + 1):
            if first[tuple(w[p : p + width])] < i:
                gone.update(range(p, p + width))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def result(df):
    return sorted((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in df.collect())


def test_against_brute_force(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(60)] + ["é", "ü x"]
    passages = [[rng.choice(vocab) for _ in range(rng.choice([11, 12, 13, 20, 70]))] for _ in range(6)]
    rows = []
    for i in range(120):
        w = [rng.choice(vocab) for _ in range(rng.randrange(0, 60))]
        for _ in range(rng.randrange(0, 3)):
            at = rng.randrange(0, len(w) + 1)
            p = list(rng.choice(passages))
            if rng.random() < 0.4:
                p[rng.randrange(len(p))] = "edit"
            w[at:at] = p
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(w)))
    rows += [(200, rows[7][1]), (201, rows[7][1]), (202, None), (203, ""), (204, " \n "), (205, "the " * 90), (206, "the " * 40), (207, "a the " * 50 + "the " * 30)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = remove_repeated_passages(df, width=12).cache()
    assert result(found) == brute(rows, 12)
    words = {i: (t or "").encode().split() for i, t in rows}
    for r in found.collect():
        covered, last = set(), -1
        for f in r.factors:
            assert f.ref_id < r.doc_id and f.length >= 12 and f.start > last  # in order, each a true copy of its reference
            assert words[r.doc_id][f.start : f.start + f.length] == words[f.ref_id][f.ref_start : f.ref_start + f.length]
            last = f.start
            covered.update(range(f.start, f.start + f.length))
        assert covered == {x for s in r.spans for x in range(s.start, s.end)}


def test_parse_is_greedy(spark):
    """A factor grows while its reference goes on, however many blocks it spans; a whole copy is one factor."""
    long = [f"x{i % 977}y{i}" for i in range(5000)]
    rows = [(1, " ".join(long)), (2, " ".join(long)), (3, " ".join(["a", "b", *long[100:400], "c", *long[1000:1060]]))]
    found = {r.doc_id: [tuple(f) for f in r.factors] for r in remove_repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {1: [], 2: [(0, 5000, 1, 0)], 3: [(2, 300, 1, 100), (303, 60, 1, 1000)]}


def test_edges(spark):
    assert remove_repeated_passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    long = " ".join(f"x{i}" for i in range(400))
    df = spark.createDataFrame([(1, long, "k"), (1, long, "k"), (None, long, None), (2, long + " tail", "z")], "doc_id long, text string, words string")
    got = {(r.doc_id, r.n_removed, r.kept_text) for r in remove_repeated_passages(df).collect()}
    assert got == {(1, 0, long), (None, 400, ""), (2, 400, "tail")}
