"""Format-preserving pseudonyms for personal data, in Spark SQL alone.

Cards, account numbers, phone and social security numbers, IPv4 addresses and
dates are numbers in a domain of a * b values, permuted by a keyed Feistel
network over Z_a x Z_b: ten rounds add a hash of one half to the other. Equal
values get equal pseudonyms in all documents, different values of a kind different
ones, and each keeps its layout; check digits are made anew. E-mail addresses have no
such domain: a keyed hash names them.

All of it is one projection: no shuffle, whatever the text's source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10

#: In this order: what one alternation of the pattern finds.
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+(?<=\.[A-Za-z]{2,24})"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
DATE = r"(?<![\d/.-])(?:(?:19|20)\d\d-\d\d-\d\d|\d{1,2}/\d{1,2}/(?:19|20)\d\d|\d{1,2}\.\d{1,2}\.(?:19|20)\d\d)(?![\d/-]|\.\d)"
IPV4 = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\d|\.\d)"
SSN = r"(?<![\d-])(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}(?![\d-])"
#: 3-3-4 digits; a country code and digits in groups, 8 to 15 in all; with a leading zero 2-4, 3-4 and 4 digits, five pairs, or an area and 5 to 7.
PHONE = (
    r"(?<![\d+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)|\d{3})[ .-]?\d{3}[ .-]\d{4}(?!\d)"
    r"|(?<![\d+])\+(?:\d(?:[ .-]?\(0\)[ .-]?|[ .-]\(?|\)[ .-]?)?){7,14}\d(?!\d)"
    r"|(?<![\d+.,/-])(?:\(0\d{1,3}\) ?|0\d{1,3}[ .-])\d{3,4}[ .-]\d{4}(?![\d-]|[.,]\d)"
    r"|(?<![\d+.,/-])0\d(?:[ .-]\d\d){4}(?![\d-]|[.,]\d)"
    r"|(?<![\d+.,/-])(?:\(0\d{2,4}\) ?|0\d{2,4}[ /-])\d{5,7}(?![\d-]|[.,]\d)"
)
CARD = r"(?<![A-Za-z0-9])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}|\d{4}([ -])\d{6}\2\d{5})(?!\d)"
PATTERN = "|".join((EMAIL, IBAN, DATE, IPV4, SSN, PHONE, CARD))
KINDS = ("email", "iban", "date", "ipv4", "ssn", "phone", "card", "account")


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


#: Luhn sum of digits d, the last one being the check digit.
_LUHN = "aggregate(sequence(1, length({d})), 0, (s, i) -> s + case when (length({d}) - i) % 2 = 0 then int(substr({d}, i, 1)) else int(substr({d}, i, 1)) * 2 - case when int(substr({d}, i, 1)) > 4 then 9 else 0 end end)"
#: Remainder by 97 of an account number, read from its fifth character on, letters as 10 to 35.
_MOD97 = "aggregate(split({d}, ''), 0, (s, c) -> case when c rlike '[0-9]' then (s * 10 + int(c)) % 97 else (s * 100 + ascii(c) - 55) % 97 end)"


def feistel(x: str, a: str, b: str, tweak: str, key: str) -> str:
    """SQL for the keyed permutation of 0 <= x < a * b; a and b of 1e9 at most."""
    f = f"cast(conv(substr(sha2(concat_ws('|', {_sql(key)}, {tweak}, i, {{half}}), 256), 1, 15), 16, 10) as bigint)"
    return f"""aggregate(sequence(0, {ROUNDS - 1}), named_struct('l', ({x}) div ({b}), 'r', ({x}) % ({b})),
      (h, i) -> case when i % 2 = 0 then named_struct('l', (h.l + {f.format(half="h.r")}) % ({a}), 'r', h.r)
                     else named_struct('l', h.l, 'r', (h.r + {f.format(half="h.l")}) % ({b})) end,
      h -> h.l * ({b}) + h.r)"""


def _pseudonyms(found: str, key: str) -> str:
    """SQL: array of (t, kind, r) from an array of matches, r being what stands in for t."""
    steps = f"transform({found}, t -> struct(t as t, regexp_replace(t, '[^0-9]', '') as d, upper(regexp_replace(t, ' ', '')) as u))"
    shape = f"""case when contains(m.t, '@') then 'email' when rlike(m.t, '^[A-Z]') then 'iban'
      when rlike(m.t, {_sql(r'^(?:\d{4}-\d\d-\d\d|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})$')}) then 'date' when rlike(m.t, {_sql(r'^(?:\d{1,3}\.){3}\d{1,3}$')}) then 'ipv4'
      when rlike(m.t, {_sql(r'^\d{3}-\d\d-\d{4}$')}) then 'ssn' when length(m.d) between 13 and 19 and not rlike(m.t, '^[+(]') then 'card' else 'phone' end"""
    steps = f"transform({steps}, m -> struct(m.t as t, m.d as d, m.u as u, {shape} as shape))"
    # the day number of a date; null if there is no such day
    day = """case when m.shape = 'date' then case when m.t like '____-%' then try_to_date(m.t, 'yyyy-MM-dd') when m.t like '%/%' then coalesce(try_to_date(m.t, 'd/M/yyyy'), try_to_date(m.t, 'M/d/yyyy')) else try_to_date(m.t, 'd.M.yyyy') end end"""
    valid = f"case when m.shape = 'card' then {_LUHN.format(d='m.d')} % 10 = 0 when m.shape = 'iban' then {_MOD97.format(d='concat(substr(m.u, 5), substr(m.u, 1, 4))')} = 1 end"
    steps = f"transform({steps}, m -> struct(m.t as t, m.d as d, m.u as u, m.shape as shape, {day} as day, coalesce({valid}, true) as valid))"
    kind = "case when m.shape = 'card' and not m.valid then 'account' when m.shape = 'iban' and (not m.valid or length(m.u) < 15) then null when m.shape = 'date' and m.day is null then null else m.shape end"
    # digits that stay in front, digits that are permuted, digits made anew at the end
    head = """case m.shape when 'card' then 1 when 'phone' then case when m.t like '+%' then least(length(regexp_extract(m.t, '^[+]([0-9]{1,3})[^0-9]', 1)) + 1, length(m.d) - 7) else 1 end
      when 'iban' then 0 else 0 end"""
    steps = f"transform({steps}, m -> struct(m.t as t, m.d as d, m.u as u, m.shape as shape, m.day as day, {kind} as kind, int({head}) as head, case when m.shape = 'card' and m.valid then 1 else 0 end as tail))"
    body = """case when m.kind is null or m.kind = 'email' then null when m.kind = 'ipv4' then '0' when m.kind = 'date' then '0'
      when m.kind = 'iban' then right(regexp_replace(substr(m.u, 5), '[^0-9]', ''), 18) else substr(m.d, m.head + 1, length(m.d) - m.head - m.tail) end"""
    steps = f"transform({steps}, m -> struct(m.t as t, m.d as d, m.u as u, m.day as day, m.kind as kind, m.head as head, m.tail as tail, {body} as body))"
    century = "year(m.day) div 100"
    x = f"""case m.kind when 'ipv4' then aggregate(split(m.t, '[.]'), 0L, (s, o) -> s * 256 + bigint(o))
      when 'date' then bigint(datediff(m.day, make_date({century} * 100, 1, 1))) else cast(nullif(m.body, '') as bigint) end"""
    # 1900-1999 has 36524 = 92 * 397 days, 2000-2099 36525 = 75 * 487
    a = f"case m.kind when 'ipv4' then 65536L when 'date' then case when {century} = 19 then 92L else 75L end else cast(pow(10, length(m.body) - length(m.body) div 2) as bigint) end"
    b = f"case m.kind when 'ipv4' then 65536L when 'date' then case when {century} = 19 then 397L else 487L end else cast(pow(10, length(m.body) div 2) as bigint) end"
    steps = f"transform({steps}, m -> struct(m.t as t, m.d as d, m.u as u, m.day as day, m.kind as kind, m.head as head, m.tail as tail, m.body as body, {x} as x, {a} as a, {b} as b))"
    y = feistel("m.x", "m.a", "m.b", "concat(case m.kind when 'account' then 'card' else m.kind end, ':', length(m.body), ':', coalesce(string(year(m.day) div 100), ''), ':', m.tail, ':', substr(m.d, 1, m.head))", key)
    steps = f"transform({steps}, m -> struct(m.t as t, m.d as d, m.u as u, m.day as day, m.kind as kind, m.head as head, m.tail as tail, m.body as body, case when m.x is not null then {y} end as y))"
    digits = """case when m.kind in ('card', 'account', 'phone', 'ssn') then concat(substr(m.d, 1, m.head), lpad(string(m.y), length(m.body), '0'))
      when m.kind = 'iban' then lpad(string(m.y), length(m.body), '0') end"""
    # an account number's other digits and its letters are permuted too: blocks of a size that fits a number, by the block before
    high = "case when m.kind = 'iban' then regexp_extract(regexp_replace(substr(m.u, 5), '[^0-9]', ''), '^([0-9]*)[0-9]{18}$', 1) else '' end"
    letters = "case when m.kind = 'iban' then regexp_replace(substr(m.u, 5), '[^A-Z]', '') else '' end"
    steps = f"transform({steps}, m -> struct(m.t as t, m.u as u, m.day as day, m.kind as kind, m.tail as tail, m.y as y, {digits} as n, m.body as body, {high} as high, substr({letters}, 1, 12) as first, substr({letters}, 13) as second))"
    power = lambda base, n: f"cast(pow({base}, {n}) as bigint)"
    halves = lambda base, x: (power(base, f"length({x}) - length({x}) div 2"), power(base, f"length({x}) div 2"))
    y_high = f"lpad(string({feistel('cast(m.high as bigint)', *halves(10, 'm.high'), "concat('iban:high:', m.body)", key)}), length(m.high), '0')"
    number = "aggregate(split({x}, ''), 0L, (s, c) -> s * 26 + ascii(c) - 65)"
    # a number as so many letters
    spelt = "aggregate(sequence(1, length({x})), named_struct('o', '', 'v', {y}), (s, i) -> named_struct('o', concat(char(65 + s.v % 26), s.o), 'v', s.v div 26), s -> s.o)"
    word = lambda x, tweak: f"case when {x} = '' then '' else {spelt.format(x=x, y=feistel(number.format(x=x), *halves(26, x), tweak, key))} end"
    n = f"case when m.kind = 'iban' and m.high <> '' then concat({y_high}, m.n) else m.n end"
    steps = f"transform({steps}, m -> struct(m.t as t, m.u as u, m.day as day, m.kind as kind, m.tail as tail, m.y as y, {n} as n, concat({word('m.first', "concat('iban:letters:', length(m.first))")}, {word('m.second', "concat('iban:letters:', m.first)")}) as letters))"
    # the check digit makes the Luhn sum of all digits a multiple of ten
    check = f"case when m.tail = 1 then concat(m.n, string((10 - ({_LUHN.format(d="concat(m.n, '0')")}) % 10) % 10)) else m.n end"
    # an account number's digits and letters from its fifth character on are replaced in order
    fill = """aggregate(split(substr(m.u, 5), ''), named_struct('o', '', 'i', 1, 'j', 1),
      (s, c) -> case when c rlike '[0-9]' then named_struct('o', concat(s.o, substr(m.n, s.i, 1)), 'i', s.i + 1, 'j', s.j) else named_struct('o', concat(s.o, substr(m.letters, s.j, 1)), 'i', s.i, 'j', s.j + 1) end, s -> s.o)"""
    steps = f"transform({steps}, m -> struct(m.t as t, m.u as u, m.day as day, m.kind as kind, m.y as y, {check} as n, case when m.kind = 'iban' then {fill} end as rest))"
    steps = f"transform({steps}, m -> struct(m.t as t, m.day as day, m.kind as kind, m.y as y, case when m.kind = 'iban' then concat(substr(m.u, 1, 2), lpad(string(98 - {_MOD97.format(d="concat(m.rest, substr(m.u, 1, 2), '00')")}), 2, '0'), m.rest) else m.n end as n))"
    # the new characters take the places of the old ones, spaces and punctuation stay
    laid = """aggregate(split(m.t, ''), named_struct('o', '', 'i', 1), (s, c) -> case when c rlike (case when m.kind = 'iban' then '[A-Z0-9]' else '[0-9]' end)
      then named_struct('o', concat(s.o, substr(m.n, s.i, 1)), 'i', s.i + 1) else named_struct('o', concat(s.o, c), 'i', s.i) end, s -> s.o)"""
    new_day = "date_add(make_date(year(m.day) div 100 * 100, 1, 1), int(m.y))"
    out = f"""case when m.kind is null then m.t
      when m.kind = 'email' then concat('user-', substr(sha2(concat_ws('|', {_sql(key)}, 'email', lower(m.t)), 256), 1, 16), '@mail.invalid')
      when m.kind = 'ipv4' then concat_ws('.', string(m.y div 16777216), string(m.y div 65536 % 256), string(m.y div 256 % 256), string(m.y % 256))
      when m.kind = 'date' then date_format({new_day}, case when m.t like '____-%' then 'yyyy-MM-dd' else regexp_replace(concat(case when m.t like '%.%' then 'd.M.yyyy' when try_to_date(m.t, 'd/M/yyyy') is null then 'M/d/yyyy' else 'd/M/yyyy' end), if(m.t rlike '^..[./]..[./]', '([dM])(?=[./])', '$^'), '$1$1') end)
      else {laid} end"""
    return f"transform({steps}, m -> struct(m.t as t, m.kind as kind, {out} as r))"


def with_pseudonyms(docs: DataFrame, key: str, text_col: str = "text", found_col: str = "pii") -> DataFrame:
    """``docs`` with personal data in ``text_col`` replaced, and ``found_col``: array of (t, kind, r).

    ``t`` is what was found, ``r`` what stands in its place. Kinds: email, iban
    (by its remainder; all digits and letters after the country are permuted), date (a day of 1900 to 2099), ipv4, ssn, phone, card (by
    its Luhn sum) and account (13 to 19 digits that fail it). A match that fails
    its check stays as it is, with kind null.

    Phones: the layouts at ``PHONE``; national numbers need a leading zero unless
    they are of 3-3-4 digits, so 612 345 678 without +34 stays. Dates: yyyy-mm-dd,
    dd.mm.yyyy and dd/mm/yyyy (one digit will do), or mm/dd/yyyy where that is the only day; the
    pseudonym has the layout of its date, without leading zeros if the day or the
    month is of one digit. A text is one row of one projection, however long it is.

    Null text stays null with an empty array; text without matches is returned
    unchanged. All other columns stay; ``found_col`` is replaced if it exists.
    The key is the caller's secret: whoever holds it can undo the permutation.
    """
    text = F.col(f"`{text_col}`")
    some = F.coalesce(text.rlike("[0-9@]"), F.lit(False))
    found = F.when(some, F.regexp_extract_all(text, F.lit(PATTERN), 0)).otherwise(F.array().cast("array<string>"))
    # two projections: what is found must not be computed anew for each of its uses
    step = docs.drop(found_col).withColumn("_found", found)
    step = step.withColumn(found_col, F.when(F.size("_found") > 0, F.expr(_pseudonyms("_found", key))).otherwise(F.expr("cast(array() as array<struct<t:string,kind:string,r:string>>)")))
    return step.withColumn(text_col, _replaced(text_col, found_col)).drop("_found")


def _replaced(text_col: str, found_col: str) -> Column:
    parts = f"zip_with(split(`{text_col}`, {_sql(PATTERN)}, -1), `{found_col}`, (a, m) -> concat(a, coalesce(m.r, '')))"
    return F.when(F.size(found_col) > 0, F.expr(f"array_join({parts}, '')")).otherwise(F.col(f"`{text_col}`"))
