import hashlib
import random
import re
from datetime import date

from docquarry.llm.pii import PATTERN, pseudonymise

KEY = "k'1"


def f(kind, i, value, m):
    return int(hashlib.sha256(f"{KEY}|{kind}|{i}|{value}".encode()).hexdigest()[:15], 16) % m


def network(left, right, a, b, kind):
    for i in range(1, 17):
        if i % 2:
            left = (left + f(kind, i, right, a)) % a
        else:
            right = (right + f(kind, i, left, b)) % b
    return left, right


def permuted(text, kind):
    def split(s):
        radix = [10 if c.isdigit() else 26 if c.isalpha() else 1 for c in s]
        first = [ord("0" if c.isdigit() else "a" if c.islower() else "A") if c.isalnum() else ord(c) for c in s]
        n, m = 0, 1
        for c, r, o in zip(s, radix, first):
            n, m = n * r + ord(c) - o, m * r
        return n, m, radix, first

    def spell(n, radix, first):
        out = []
        for r, o in zip(reversed(radix), reversed(first)):
            out.append(chr(o + n % r))
            n //= r
        return "".join(reversed(out))

    done = ""
    for k in range(0, max(len(text), 1), 24):
        s = text[k : k + 24]
        (a, am, ar, ao), (b, bm, br, bo) = split(s[: len(s) // 2]), split(s[len(s) // 2 :])
        a, b = network(a, b, am, bm, kind)
        done += spell(a, ar, ao) + spell(b, br, bo)
    return done


def luhn(s):
    return sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(map(int, reversed(s)))) % 10


def one(m):
    if "@" in m:
        return "email", permuted(m.split("@")[0], "email") + "@" + m.split("@")[1]
    for rx, order in ((r"(\d{4})([-/])(\d\d)\2(\d\d)", "y-md"), (r"(\d\d)(\.)(\d\d)\.(\d{4})", "d.my"), (r"(\d\d)(/)(\d\d)/(\d{4})", "m/dy")):
        if g := re.fullmatch(rx, m):
            part = dict(zip(order.replace(g[2] if order[1] != "-" else "-", ""), (int(g[1]), int(g[3]), int(g[4]))))
            try:
                n = (date(part["y"], part["m"], part["d"]) - date(1800, 1, 1)).days
            except ValueError:
                return None, m
            first, ways, width = date(1800, 1, 1).toordinal() + n // 146097 * 146097, 189, 773
            if part["y"] < 200:
                first, ways, width = 1, 13, 5591
            if part["y"] >= 9800:
                first, ways, width = date(9800, 1, 1).toordinal(), 184, 397
            at = date(part["y"], part["m"], part["d"]).toordinal() - first
            a, b = network(at // width, at % width, ways, width, "date")
            d = date.fromordinal(first + a * width + b)
            v = {"y": f"{d.year:04}", "m": f"{d.month:02}", "d": f"{d.day:02}"}
            return "date", g[2].join(v[c] for c in order if c in "ymd")
    if re.fullmatch(r"\d{3}-\d\d-\d{4}", m):
        a, g, s = map(int, m.split("-"))
        if not (1 <= a <= 899 and a != 666 and g and s):
            return None, m
        x, y = network(a - (2 if a > 666 else 1), (g - 1) * 9999 + s - 1, 898, 989901, "ssn")
        return "ssn", f"{x + (2 if x >= 665 else 1):03}-{y // 9999 + 1:02}-{y % 9999 + 1:04}"
    if re.fullmatch(r"\d{1,3}(\.\d{1,3}){3}", m):
        o = list(map(int, m.split(".")))
        if max(o) > 255 or m != ".".join(map(str, o)):
            return None, m
        a, b = network(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, "ip")
        return "ip", f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"
    if re.fullmatch(r"\d([ -]?\d){12,18}", m):
        if luhn(re.sub("[ -]", "", m)):
            return None, m
        body = permuted(re.sub("[ -]", "", m)[:-1], "card")
        return "card", filled(m, body + str((10 - luhn(body + "0")) % 10))
    if not 8 <= len(re.sub(r"\D", "", m)) <= 15:
        return None, m
    code = (re.match(r"\+[0-9]{1,3}[ .-]", m) or re.match(r"\+.|", m))[0]
    return "phone", code + filled(m[len(code) :], permuted(re.sub(r"\D", "", m[len(code) :]), "phone"))


def filled(shape, digits):
    digits = iter(digits)
    return "".join(next(digits) if c.isdigit() else c for c in shape)


def brute(text):
    out, at, found = [], 0, []
    for g in re.finditer(PATTERN, text or "", re.A):
        kind, new = one(g[0])
        out += [text[at : g.start()], new]
        at = g.end()
        if kind:
            found.append((kind, g[0], new))
    return ("".join(out) + text[at:] if text is not None else None), found


TEXTS = [
    None, "", "no data 12 3.4", "call +1 (017) 555-7713 or (020) 555-1234.", "4041894974608795 and 4041 8949 7460 8795, not 4041894974608796", "ip 97.51.17.173, bad 999.1.1.1 and 1.2.3.4.5",
    "born 1999-02-28, 2024/02/29, 29.02.2023 (none), 31.12.1850 and 12/31/2001; 2150-01-01", "mail und.34@mail7.example.com A.b-C+9@x.org é@y.de", "ssn 123-45-6789 000-12-3456 666-11-1111",
    "averyveryverylongmailboxname.with.many.parts99@mail.example.org", "+442071838750 x4041894974608795 4041894974608795x 20230101", "same 97.51.17.173 97.51.17.173",
    "0001-01-01 0199-12-31 0200-01-01 9799-12-31 9800-01-01 9999-12-31 0000-01-01", "010.001.002.003 10.1.2.3 0.0.0.0",
]


def test_against_brute_force(spark):
    rng = random.Random(6)
    bits = ["4041894974608795", "4041 8949 7460 8795", "0001-01-02", "9999-12-31", "01.2.3.4", "+1 (017) 555-7713", "97.51.17.173", "1999-02-28", "31.12.1850", "a.b9@c.de", "123-45-6789", " ", " ", ".", ",", "x", "é", "12", "-", "(", "020) 555-1234"]
    texts = TEXTS + ["".join(rng.choice(bits) for _ in range(rng.randrange(12))) for _ in range(150)]
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, matches string")
    for r in pseudonymise(df, KEY).collect():
        assert (r.text, [tuple(x) for x in r.findings]) == brute(texts[r.doc_id]), texts[r.doc_id]


def test_permutation_and_format(spark):
    ips = [f"10.{i}.{j}.7" for i in range(40) for j in range(40)]
    got = pseudonymise(spark.createDataFrame(list(enumerate(ips)), "doc_id long, text string"), KEY).collect()
    assert len({r.text for r in got}) == len(ips)
    assert all(luhn(re.sub(r"\D", "", x.new)) == 0 for r in pseudonymise(spark.createDataFrame([(1, TEXTS[4])], "doc_id long, text string"), KEY).collect() for x in r.findings)
    assert pseudonymise(spark.createDataFrame([], "doc_id long, text string"), KEY).count() == 0


def test_every_day_of_the_cut_cycles_has_its_own(spark):
    for first, last in (("0001-01-01", "0199-12-31"), ("9800-01-01", "9999-12-31")):
        days = spark.sql(f"SELECT explode(sequence(DATE'{first}', DATE'{last}', INTERVAL 53 DAY)) AS d").selectExpr("CAST(row_number() OVER (ORDER BY d) AS BIGINT) AS doc_id", "date_format(d, 'yyyy-MM-dd') AS text")
        new = [r.text for r in pseudonymise(days, KEY).collect()]
        assert len(set(new)) == len(new) and all(first <= x <= last for x in new)


def test_separators_do_not_part_equal_values(spark):
    got = [r.text for r in pseudonymise(spark.createDataFrame([(1, "4041894974608795"), (2, "4041 8949 7460 8795"), (3, "+1 (017) 555-7713"), (4, "+1 017 555 7713")], "doc_id long, text string"), KEY).orderBy("doc_id").collect()]
    assert re.sub(r"\D", "", got[0]) == re.sub(r"\D", "", got[1]) != "4041894974608795" and got[1][4] == " "
    assert re.sub(r"\D", "", got[2]) == re.sub(r"\D", "", got[3])
