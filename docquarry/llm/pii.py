"""Personal data: format-preserving pseudonyms by keyed Feistel permutations, in SQL expressions only.

Values are found by one regular expression, validated, and replaced by another
value of the same format, so that equal values stay linked across documents and
different ones stay different:

* card: 13-19 digits with a valid Luhn sum; all but the last digit are permuted,
  the last is the new check digit; separators are put back, so a card is linked however it is spaced;
* phone: an international or bracketed number of 8-15 digits; the country code (as far as
  a separator tells it, else one digit) stays, separators are put back;
* ip: four octets of at most 255 without leading zeros, permuted as two 16-bit halves;
* ssn: ddd-dd-dddd with an assignable area, group and serial, permuted among those;
* date: an existing day as yyyy-mm-dd, yyyy/mm/dd, dd.mm.yyyy or mm/dd/yyyy,
  permuted among the 146097 days of its 400-year cycle (from 1 January 1800); the first and
  the last cycle are cut to the years 0001 to 0199 and 9800 to 9999;
* email: letters and digits before the @ are permuted within their class.

The network works on a pair (L, R) of Z_a x Z_b for any a and b:
L += f(round, R) mod a, then R += g(round, L) mod b, eight rounds; f and g are
SHA-256 of key, kind, round and value.  Each round is invertible, so the whole is a
permutation of exactly the format's values and needs no cycle walking.

Only built-in expressions run, so nothing is shuffled and texts stay in the JVM.

Defined results: null text stays null and has no findings; what fails validation
stays as it is; repeated rows each get a row; columns other than the two named are
not read.  The key is a parameter: who has it can undo the permutation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("card", "phone", "ip", "ssn", "date", "email")
ROUNDS = 8
CYCLE_DAYS = 146097  # 400 Gregorian years = 189 * 773 days
#: Whole cycles and the two cut ones: days from 1800-01-01 before which each ends, first day, and days as a product.
CYCLES = {"-584388": ("-657071", 13, 5591), "2921940": (f"n - pmod(n, {CYCLE_DAYS})", 189, 773), "9999999": ("2921940", 184, 397)}

_NOT_IN = r"(?<![A-Za-z0-9_.+/@-])"
_END = r"(?![A-Za-z0-9_@]|[./-][0-9])"
#: Fixed patterns, tried in this order at each place.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}",
    "date": r"(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})" + _END,
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}" + _END,
    "ip": r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}" + _END,
    "card": r"[0-9](?:[ -]?[0-9]){12,18}" + _END,
    "phone": r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3,4}[ .-]?[0-9]{3,4}" + _END + r"|\+[0-9]{8,15}" + _END,
}
PATTERN = _NOT_IN + "(?:" + "|".join(PATTERNS.values()) + ")"


def _quote(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def feistel(left: str, right: str, a: str, b: str, key: str, kind: str) -> str:
    """SQL of struct(l, r): the permuted pair of Z_a x Z_b."""

    def mixed(value: str, modulus: str) -> str:
        digest = f"sha2(concat_ws('|', {_quote(key)}, '{kind}', i, {value}), 256)"
        return f"pmod(CAST(conv(substr({digest}, 1, 15), 16, 10) AS BIGINT), {modulus})"

    return (
        f"aggregate(sequence(1, {2 * ROUNDS}), named_struct('l', CAST({left} AS BIGINT), 'r', CAST({right} AS BIGINT)), (s, i) -> "
        f"IF(i % 2 = 1, named_struct('l', pmod(s.l + {mixed('s.r', a)}, {a}), 'r', s.r), named_struct('l', s.l, 'r', pmod(s.r + {mixed('s.l', b)}, {b}))))"
    )


#: An ASCII code's class: how many values it has, and its first. Other characters have one value, themselves.
_RADIX = "CASE WHEN c BETWEEN 48 AND 57 THEN 10L WHEN c BETWEEN 97 AND 122 OR c BETWEEN 65 AND 90 THEN 26L ELSE 1L END"
_FIRST = "CASE WHEN c BETWEEN 48 AND 57 THEN 48 WHEN c BETWEEN 97 AND 122 THEN 97 WHEN c BETWEEN 65 AND 90 THEN 65 ELSE c END"


def permuted(text: str, key: str, kind: str) -> str:
    """SQL: ``text`` with letters and digits permuted within their classes, in blocks of 24 characters."""
    codes = "transform(filter(split(substr({t}, k, 24), ''), x -> x <> ''), x -> ascii(x))"
    whole = f"""
    aggregate(sequence(1, greatest(length({text}), 1), 24), '', (done, k) -> concat(done,
      element_at(transform(array({codes.format(t=text)}), cs ->
        element_at(transform(array(slice(cs, 1, CAST(size(cs) DIV 2 AS INT))), lo ->
          element_at(transform(array(slice(cs, 1 + CAST(size(cs) DIV 2 AS INT), size(cs))), hi ->
            element_at(transform(array({feistel(_number('lo'), _number('hi'), _values('lo'), _values('hi'), key, kind)}), p ->
              concat({_spelled('lo', 'p.l')}, {_spelled('hi', 'p.r')})), 1)), 1)), 1)), 1)))"""
    return " ".join(whole.split())


def _number(codes: str) -> str:
    return f"aggregate({codes}, 0L, (n, c) -> n * ({_RADIX}) + (c - ({_FIRST})))"


def _values(codes: str) -> str:
    return f"aggregate({codes}, 1L, (n, c) -> n * ({_RADIX}))"


def _spelled(codes: str, number: str) -> str:
    later = f"aggregate(slice({codes}, j + 2, size({codes})), 1L, (n, c) -> n * ({_RADIX}))"
    return f"array_join(transform({codes}, (c, j) -> chr(CAST(({_FIRST}) + pmod({number} DIV {later}, {_RADIX}) AS INT))), '')"


def _luhn(digits: str, doubled_from: int) -> str:
    """SQL: Luhn sum of a digit string; the digit at the end is doubled if ``doubled_from`` is 0, else the one before."""
    d = "CAST(x AS INT)"
    return (
        f"aggregate(transform(reverse(filter(split({digits}, ''), x -> x <> '')), (x, j) -> "
        f"IF(j % 2 = {doubled_from}, IF({d} > 4, 2 * {d} - 9, 2 * {d}), {d})), 0, (t, x) -> t + x)"
    )


def _filled(shape: str, digits: str) -> str:
    """SQL: ``shape`` with its digits replaced by ``digits``, one after another."""
    return (
        f"element_at(transform(array({digits}), d -> aggregate(filter(split({shape}, ''), x -> x <> ''), named_struct('s', '', 'k', 1), "
        "(a, c) -> IF(c RLIKE '[0-9]', named_struct('s', concat(a.s, substr(d, a.k, 1)), 'k', a.k + 1), named_struct('s', concat(a.s, c), 'k', a.k)), a -> a.s)), 1)"
    )


def _card(key: str) -> str:
    digits = "regexp_replace(m, '[ -]', '')"
    body = permuted(f"substr({digits}, 1, length({digits}) - 1)", key, "card")
    whole = f"element_at(transform(array({body}), b -> concat(b, CAST(pmod(10 - {_luhn('b', 0)} % 10, 10) AS STRING))), 1)"
    return f"IF({_luhn(digits, 1)} % 10 = 0, {_filled('m', whole)}, NULL)"


def _phone(key: str) -> str:
    n = "length(regexp_replace(m, '[^0-9]', ''))"
    code = r"regexp_extract(m, '^(\\+[0-9]{1,3}[ .-])', 1)"
    code = f"IF({code} = '' AND substr(m, 1, 1) = '+', substr(m, 1, 2), {code})"
    rest = f"substr(m, 1 + length({code}))"
    digits = permuted(f"regexp_replace({rest}, '[^0-9]', '')", key, "phone")
    return f"IF({n} BETWEEN 8 AND 15, concat({code}, {_filled(rest, digits)}), NULL)"


def _ip(key: str) -> str:
    o = lambda i: f"CAST(split(m, '[.]')[{i}] AS INT)"
    pair = feistel(f"{o(0)} * 256 + {o(1)}", f"{o(2)} * 256 + {o(3)}", "65536L", "65536L", key, "ip")
    return (
        "IF(forall(split(m, '[.]'), x -> CAST(x AS INT) <= 255 AND x = CAST(CAST(x AS INT) AS STRING)), "
        f"element_at(transform(array({pair}), p -> concat_ws('.', p.l DIV 256, p.l % 256, p.r DIV 256, p.r % 256)), 1), NULL)"
    )


def _ssn(key: str) -> str:
    part = lambda i: f"CAST(split(m, '-')[{i}] AS INT)"
    valid = f"{part(0)} BETWEEN 1 AND 899 AND {part(0)} <> 666 AND {part(1)} > 0 AND {part(2)} > 0"
    area = f"{part(0)} - IF({part(0)} > 666, 2, 1)"
    pair = feistel(area, f"({part(1)} - 1) * 9999 + {part(2)} - 1", "898L", "989901L", key, "ssn")
    return (
        f"IF({valid}, element_at(transform(array({pair}), p -> "
        "format_string('%03d-%02d-%04d', p.l + IF(p.l >= 665, 2, 1), p.r DIV 9999 + 1, p.r % 9999 + 1)), 1), NULL)"
    )


def _date(key: str, shape: str) -> str:
    origin = "DATE'1800-01-01'"
    day = f"CAST(try_to_timestamp(m, '{shape}') AS DATE)"
    day_in = lambda first, a, b: f"element_at(transform(array({feistel(f'(n - ({first})) DIV {b}', f'(n - ({first})) % {b}', f'{a}L', f'{b}L', key, 'date')}), p -> {first} + p.l * {b} + p.r), 1)"
    moved = " ".join(f"WHEN n < {end} THEN {day_in(*cycle)}" for end, cycle in CYCLES.items())
    shown = f"date_format(date_add({origin}, CAST(CASE {moved} END AS INT)), '{shape}')"
    return f"IF({day} IS NULL OR year({day}) < 1, NULL, element_at(transform(array(datediff({day}, {origin})), n -> {shown}), 1))"


def _email(key: str) -> str:
    return f"concat({permuted("substring_index(m, '@', 1)", key, 'email')}, '@', substring_index(m, '@', -1))"


def _finding(key: str) -> str:
    """SQL of struct(kind, new) for a match ``m``; kind is null where validation fails."""
    said = lambda kind, sql: f"element_at(transform(array({sql}), v -> named_struct('kind', IF(v IS NULL, NULL, '{kind}'), 'new', coalesce(v, m))), 1)"
    shape = lambda rx: f"m RLIKE {_quote('^' + rx + '$')}"
    return f"""CASE
      WHEN contains(m, '@') THEN {said("email", _email(key))}
      WHEN {shape("[0-9]{4}-[0-9]{2}-[0-9]{2}")} THEN {said("date", _date(key, "yyyy-MM-dd"))}
      WHEN {shape("[0-9]{4}/[0-9]{2}/[0-9]{2}")} THEN {said("date", _date(key, "yyyy/MM/dd"))}
      WHEN {shape("[0-9]{2}[.][0-9]{2}[.][0-9]{4}")} THEN {said("date", _date(key, "dd.MM.yyyy"))}
      WHEN {shape("[0-9]{2}/[0-9]{2}/[0-9]{4}")} THEN {said("date", _date(key, "MM/dd/yyyy"))}
      WHEN {shape("[0-9]{3}-[0-9]{2}-[0-9]{4}")} THEN {said("ssn", _ssn(key))}
      WHEN {shape("[0-9]{1,3}([.][0-9]{1,3}){3}")} THEN {said("ip", _ip(key))}
      WHEN {shape("[0-9]([ -]?[0-9]){12,18}")} THEN {said("card", _card(key))}
      ELSE {said("phone", _phone(key))} END"""


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text (with pseudonyms), findings (kind, old, new) in the text's order."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pattern = _quote(PATTERN)
    found = rows.withColumn("matches", F.expr(f"regexp_extract_all(text, {pattern}, 0)"))
    found = found.withColumn("changes", F.expr(f"IF(size(matches) > 0, transform(matches, m -> {_finding(key)}), NULL)"))
    joined = f"array_join(zip_with(split(text, {pattern}, -1), changes, (gap, x) -> concat(gap, coalesce(x.new, ''))), '')"
    pairs = "zip_with(matches, changes, (m, x) -> named_struct('kind', x.kind, 'old', m, 'new', x.new))"
    none = "CAST(array() AS array<struct<kind:string,old:string,new:string>>)"
    return found.select(
        "doc_id",
        F.expr(f"IF(size(matches) > 0, {joined}, text)").alias("text"),
        F.expr(f"IF(size(matches) > 0, filter({pairs}, x -> x.kind IS NOT NULL), {none})").alias("findings"),
    )
