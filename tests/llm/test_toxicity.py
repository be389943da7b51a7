import random
import zlib

from docquarry.llm.toxicity import Lexicon, fit, keep_clean, quoted, toxicity


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_equals_edit_distance():
    rng = random.Random(2)
    terms = ["idiot", "moron", "losers", "worthless", "scumbag", "aabab", "ababa"]
    lexicon = Lexicon([(t, False, 1.0 + i) for i, t in enumerate(terms)])
    for _ in range(8000):
        w = list(rng.choice(terms))
        for _ in range(rng.randrange(0, 3)):
            k = rng.randrange(len(w) + 1)
            edit = rng.randrange(3)
            if edit == 0:
                w.insert(k, rng.choice("abiodrs"))
            elif k < len(w):
                w[k : k + 1] = [] if edit == 1 else [rng.choice("abiodrs")]
        word = "".join(w)
        want = max((1.0 + i for i, t in enumerate(terms) if distance(word, t) <= 1), default=0.0)
        assert lexicon.misspelled(word) == want, word


def test_context():
    assert quoted('he wrote " you idiot " there'.split(), 4)
    assert quoted("the word idiot is old".split(), 2)
    assert quoted("a b c d e f g “such idiot they” b c".split(), 8)
    assert not quoted("you are an idiot and more".split(), 3)


def corpus(n=900):
    rng = random.Random(4)
    vocab = [a + b for a in ("th", "er", "on", "an", "re", "in") for b in ("ea", "st", "ou", "ing", "ly", "ha")]
    rows, labels = [], []
    for i in range(n):
        w = [rng.choice(vocab) for _ in range(rng.randrange(15, 80))]
        bad = rng.random() < 0.25
        if bad:
            for _ in range(rng.randrange(2, 5)):
                w[rng.randrange(len(w))] = rng.choice(["idiot", "moron,", "Worthless", "zwevu" + rng.choice(vocab)])
        rows.append((i, " ".join(w), "en"))
        if rng.random() < 0.8:
            labels.append((i, int(rng.random() < 0.5), int(bad)))
    truth = {i: any(x in t for x in ("idiot", "moron", "Worthless", "zwevu")) for i, t, _ in rows}
    return rows, labels, truth


def test_held_out_accuracy(spark):
    rows, labels, truth = corpus()
    docs = spark.createDataFrame(rows + [(5000, None, "en"), (5001, "", None), (None, "you moron and idiot", "en"), (5002, "you idi0t and mor0n and wortless", "x")], "doc_id long, text string, score string")
    model = fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    out = {r.doc_id: r for r in toxicity(docs, model).collect()}
    assert len(out) == len(rows) + 4
    held = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(out[i].held_out for i in held) and sum(r.held_out for i, r in out.items() if i is not None and i < 5000) == len(held)
    assert sum(out[i].predicted == truth[i] for i in held) >= 0.98 * len(held)
    assert out[5000].score == out[5001].score < 0.2 and out[None].predicted == 1 and not out[None].held_out
    assert out[5002].predicted == 1
    kept = keep_clean(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in out.items() if not r.predicted}


def test_edges(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [tuple(r)[2:] for r in toxicity(docs, fit(docs, none)).collect()] == [(0.0, 0)]
    assert toxicity(docs.limit(0), fit(docs, none)).count() == 0
