import hashlib
import random
import re

from docquarry.llm.queries import op6_secrets
from docquarry.llm.secrets import RULES, Scanner, find_secrets, redact_secrets, trigram_query, trigrams

AK = "AKIA" + "Q7" * 8
TEXTS = [
    None, "", "nothing", f"key {AK} é {AK}ZZ", "AKIASHORT1", "Password : 'abc-12', token=abcde;", 'api_key = "ffff"; API-KEY=1', 'apikey="a.b/c+d=="',
    "é🙂 deadbeefdeadbeefdeadbeef 0123456789abcdef0123456789abcdef", "token = \"" + "ab12" * 10 + "\"", "secret==abcdefg passwd: x secret:yyyyyy", "ghp_" + "a1B2" * 9, "xoxb-123456789012-abc",
    "-----BEGIN RSA PRIVATE KEY-----", "https://joe:hunter2@host.example/x", "toKEN:ſecret99", "deadbeef" * 2000, "password\n=abcdefgh password  =  'q1q1q1q1",
]


def base(text):
    """The contract's own words, on code points."""
    found = []
    for k, (kind, rx, flag) in enumerate([("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), ("access", r"AKIA[A-Z0-9]+", 0), ("hex", r"[0-9a-f]+", 0)]):
        for m in re.finditer(rx, text or "", flag):
            if (len(m[2]) >= 6) if kind == "assign" else len(m[0]) >= (20 if kind == "access" else 24):
                found.append((m.start(), k, kind, m.end()))
    return [(kind, s, e) for s, _, kind, e in sorted(found)]


def test_against_plain_expressions(spark, tmp_path):
    rng = random.Random(9)
    bits = ["password", "Token", "api_key", "apikey", "secret", " ", "=", ":", '"', "'", "abc123", "x", "é", "🙂", AK, "AKIA", "0a1b2c3d" * 3, "beef", "\n", "-----BEGIN PRIVATE KEY-----"]
    texts = TEXTS + ["".join(rng.choice(bits) for _ in range(rng.randrange(25))) for _ in range(400)]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in find_secrets(df).collect()}
    for i, t in enumerate(texts):
        assert [s for s in got[i] if s[0] in ("assign", "access", "hex")] == base(t), (t, got[i])
    assert [s[0] for s in got[11]] == ["github"] and [s[0] for s in got[13]] == ["private_key"] and ("url_login", 0, 20) in got[14]
    df.write.parquet(f"{tmp_path}/documents.parquet")
    for r in op6_secrets(spark, str(tmp_path)).collect():
        want = base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in want).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for k, _, _ in want) for x in ("assign", "access", "hex"))


def test_index_never_loses_a_match():
    scanner = Scanner()
    texts = [(t or "").encode() for t in TEXTS]
    for rule, expression, ok in zip(RULES, scanner.expressions, scanner.candidates(texts), strict=True):
        assert all(ok[i] or not expression.search(t) for i, t in enumerate(texts)), rule.kind
    assert trigram_query(r"[0-9a-f]{24,}") is True
    assert trigrams(trigram_query("AKIA[A-Z0-9]+")) == {b"aki", b"kia"}
    assert trigrams(trigram_query("api_?key")) >= {b"api", b"key"}
    assert trigram_query("ab|cde") is True and trigram_query("x*") is True


def test_redaction(spark):
    df = spark.createDataFrame([(1, f"a {AK} b", "k"), (2, None, None), (3, "token=deadbeefdeadbeefdeadbeef!", "z")], "doc_id long, text string, n_chars string")
    assert [tuple(r) for r in redact_secrets(df).orderBy("doc_id").collect()] == [(1, "a [SECRET] b", "k"), (2, None, None), (3, "[SECRET]!", "z")]
    assert find_secrets(df.limit(0)).count() == 0
