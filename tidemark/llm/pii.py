"""Format-preserving pseudonyms for personal data, in Spark expressions only.

A validated value is a number pair (left, right) in a domain given by its format; a keyed Feistel network P permutes the
domain, and the pseudonym is P^-1(P(x) + 1): again a keyed permutation within the format, and one that leaves no value
as it was.  Equal values get equal pseudonyms in every document.  Local parts of e-mail addresses go through the same
network with halves of characters, each shifted within its class; a single letter or digit is a pair of its own domain.

Kinds (all others stay):

* card numbers of 13 to 19 digits that pass the Luhn check (and the pseudonym does);
* IBANs of the listed countries, compact or in groups of four, whose check digits are right (and the pseudonym's are);
  country and letters stay;
* phone numbers of ten digits: bare ones need an area code and an exchange that begin with 2 to 9, as the North American
  plan has it; a country code with a plus sign before a bracketed area code marks a number as one whatever its digits.
  Either sort is permuted within itself;
* social security numbers, IPv4 addresses, dates from 1900 to 2099 (yyyy-mm-dd, yyyy/mm/dd, dd.mm.yyyy, dd/mm/yyyy);
* e-mail addresses with a local part of at most 64 characters, after any leading punctuation (it and the domain stay).

Every pattern reads a run of characters once, so time is linear in the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of, unused, without

# Lengths of IBANs by country.
IBAN = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS", 23: "AE GI IL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "PT", 26: "IS TR", 27: "FR GR IT MC SM", 28: "AL AZ CY DO GT HU LB PL", 29: "BR PS QA UA", 30: "JO KW MU", 31: "MT",
}


def _iban_pattern() -> str:
    """Both ways of writing, by length, so that a word behind the number is not taken for a group of it."""
    each = []
    for size, lands in IBAN.items():
        full, rest = divmod(size - 4, 4)
        spaced = f"(?: [A-Z0-9]{{4}}){{{full}}}" + (f" [A-Z0-9]{{{rest}}}" if rest else "")
        each.append(f"(?:{lands.replace(' ', '|')})\\d\\d(?:[A-Z0-9]{{{size - 4}}}|{spaced})")
    return rf"(?<!\w)(?=[A-Z][A-Z]\d\d)(?:{'|'.join(each)})(?!\w)"


#: Fixed formats, in the order in which they are tried.
FORMATS = {
    "email": r"(?<![A-Za-z0-9._%+-])[._%+-]*+[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d)",
    "date": r"(?<![\w/.-])(?:(?:19|20)\d\d([-/])\d\d\1\d\d|\d\d([./])\d\d\2(?:19|20)\d\d)(?![\w/-]|\.\d)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "phone": r"(?<![\w+])(?:\+?\d{1,2}[ .-])?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\w)",
    "card": r"(?<!\w)(?:\d{13,19}|\d{4}([ -])\d{4}\3\d{4}\3\d{4}|\d{4}([ -])\d{6}\4\d{5})(?!\w)",
    "iban": _iban_pattern(),
}
ANY = "|".join(FORMATS.values())
#: Any text that has a value has one of these; a quick look.
HINT = r"[0-9]\.?[0-9]|@"
ROUNDS = 8
DAYS = (319, 229)  # 319 * 229 days from 1900-01-01 to 2099-12-31
#: A phone number that says so itself.
MARKED = r"\A\+\d{1,2}[ .-]\("
#: Halves of phone numbers in the plan, and of all others: area code and exchange, then the last four digits.
PLANNED, UNPLANNED = 800 * 800, 1_000_000 - 800 * 800


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, r"\D", "")


def _is(m: Column, kind: str) -> Column:
    shape = {"email": "@", "ip": r"\A\d{1,3}(?:\.\d{1,3}){3}\z", "date": r"\A(?:\d{4}[-/]\d\d[-/]\d\d|\d\d[./]\d\d[./]\d{4})\z", "ssn": r"\A\d{3}-\d{2}-\d{4}\z", "card": r"\A(?:\d{13,19}|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|\d{4}[ -]\d{6}[ -]\d{5})\z", "iban": r"\A[A-Z]{2}"}
    return m.rlike(shape[kind])


def luhn_sum(digits: Column, odd: int) -> Column:
    """Luhn sum of a digit string; the digits whose place from the right is even (odd=0) or odd (odd=1) are doubled."""
    chars = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    values = F.transform(chars, lambda c, i: F.when(i % 2 == odd, (c.cast("int") * 2) % 10 + F.floor(c.cast("int") * 2 / 10)).otherwise(c.cast("int")).cast("int"))
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def mod97(text: Column) -> Column:
    """A string of digits and capital letters (A is 10) as a number, modulo 97."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    value = lambda c: F.instr(F.lit(letters), c) + 9
    add = lambda a, c: F.when(F.instr(F.lit(letters), c) > 0, (a * 100 + value(c)) % 97).otherwise((a * 10 + c.cast("int")) % 97)
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0), add)


def _date(m: Column) -> Column:
    y4 = m.rlike(r"\A\d{4}")
    return F.try_to_date(F.when(y4, F.regexp_replace(m, "/", "-")).otherwise(F.concat_ws("-", F.substring(m, 7, 4), F.substring(m, 4, 2), F.substring(m, 1, 2))), "yyyy-MM-dd")


def domain(m: Column) -> Column:
    """Struct (kind, a, b, left, right) of a value: 0 <= left < a, 0 <= right < b; kind null if it isn't valid."""
    d = _digits(m)
    n = F.length(d)
    long = lambda c: c.cast("long")
    make = lambda kind, a, b, left, right: F.struct(kind.alias("kind"), long(a).alias("a"), long(b).alias("b"), long(left).alias("left"), long(right).alias("right"))

    def halves(kind: Column, digits: Column) -> Column:
        k = F.length(digits)
        left = F.ceil(k / 2).cast("int")
        return make(kind, F.pow(F.lit(10.0), left), F.pow(F.lit(10.0), k - left), F.substr(digits, F.lit(1), left), F.substr(digits, left + 1, k - left))

    none = make(F.lit(None).cast("string"), F.lit(1), F.lit(1), F.lit(0), F.lit(0))
    octets = F.split(m, r"\.")
    octet = lambda i: F.get(octets, F.lit(i)).cast("int")
    valid_ip = F.aggregate(octets, F.lit(True), lambda a, o: a & (o.cast("int") <= 255))
    day = F.datediff(_date(m), F.lit("1900-01-01").cast("date"))
    area, group, serial = F.substring(m, 1, 3).cast("int"), F.substring(m, 5, 2).cast("int"), F.substring(m, 8, 4).cast("int")
    valid_ssn = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    area_index = area - F.when(area > 666, 2).otherwise(1)
    ten = F.right(d, F.lit(10))
    first, exchange, last = F.substring(ten, 1, 3).cast("int"), F.substring(ten, 4, 3).cast("int"), F.substring(ten, 7, 4).cast("int")
    planned = make(F.lit("phone"), F.lit(PLANNED), F.lit(10_000), (first - 200) * 800 + exchange - 200, last)
    unplanned = make(F.lit("marked phone"), F.lit(UNPLANNED), F.lit(10_000), F.when(first < 200, first * 1000 + exchange).otherwise(200_000 + (first - 200) * 200 + exchange), last)
    compact = F.replace(m, F.lit(" "))
    bban = F.substr(compact, F.lit(5))
    form = F.concat(F.lit("iban"), F.substring(m, 1, 2), F.regexp_replace(bban, r"\d", "9"))
    valid_iban = (mod97(F.concat(bban, F.substring(compact, 1, 4))) == 1) & bban.rlike(r"\d\D*\d")
    return (
        F.when(_is(m, "ip"), F.when(valid_ip, make(F.lit("ip"), F.lit(65536), F.lit(65536), octet(0) * 256 + octet(1), octet(2) * 256 + octet(3))).otherwise(none))
        .when(_is(m, "date"), F.when(day.isNotNull(), make(F.lit("date"), F.lit(DAYS[0]), F.lit(DAYS[1]), F.floor(day / DAYS[1]), day % DAYS[1])).otherwise(none))
        .when(_is(m, "ssn"), F.when(valid_ssn, make(F.lit("ssn"), F.lit(898 * 99), F.lit(9999), area_index * 99 + group - 1, serial - 1)).otherwise(none))
        .when(_is(m, "card"), F.when(luhn_sum(d, 1) % 10 == 0, halves(F.concat(F.lit("card"), n.cast("string")), F.substr(d, F.lit(1), n - 1))).otherwise(none))
        .when(_is(m, "iban"), F.when(valid_iban, halves(form, _digits(bban))).otherwise(none))
        .otherwise(F.when((first >= 200) & (exchange >= 200), planned).when(m.rlike(MARKED), unplanned).otherwise(none))
    )


def _random(key: str, kind: Column, i: Column, half: Column) -> Column:
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), kind, i.cast("string"), half.cast("string")), 256), 1, 13), 16, 10).cast("long")


def permute(x: Column, key: str) -> Column:
    """(left, right) of the pseudonym of a domain() struct."""
    pair = lambda left, right: F.struct(left.alias("left"), right.alias("right"))

    def step(sign: int):
        def run(acc: Column, i: Column) -> Column:
            f = F.when(i % 2 == 0, _random(key, x["kind"], i, acc["right"])).otherwise(_random(key, x["kind"], i, acc["left"]))
            return F.when(i % 2 == 0, pair(F.pmod(acc["left"] + sign * (f % x["a"]), x["a"]), acc["right"])).otherwise(pair(acc["left"], F.pmod(acc["right"] + sign * (f % x["b"]), x["b"])))

        return run

    there = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), pair(x["left"], x["right"]), step(1), lambda p: pair((p["left"] + 1) % x["a"], p["right"]))
    return F.aggregate(F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1)), there, step(-1))


def _fill(m: Column, digits: Column) -> Column:
    """m with its digits replaced, one by one from the right end of the digit string's length."""
    gaps = F.split(m, r"\d", -1)
    return F.array_join(F.zip_with(gaps, F.filter(F.split(digits, ""), lambda c: c != ""), lambda g, d: F.concat(g, F.coalesce(d, F.lit("")))), "")


def _written(m: Column, x: Column, p: Column) -> Column:
    """The pseudonym p in the format of m."""
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    d = _digits(m)
    wide = lambda c, a: F.lpad(c.cast("string"), (F.length(a.cast("string")) - 1).cast("int"), "0")
    number = F.concat(wide(p["left"], x["a"]), wide(p["right"], x["b"]))
    check = ((10 - luhn_sum(number, 0) % 10) % 10).cast("string")
    ip = F.concat_ws(".", F.floor(p["left"] / 256), p["left"] % 256, F.floor(p["right"] / 256), p["right"] % 256)
    day = F.date_add(F.lit("1900-01-01").cast("date"), (p["left"] * DAYS[1] + p["right"]).cast("int"))
    date = F.when(m.rlike(r"\A\d{4}"), F.date_format(day, "yyyyMMdd")).otherwise(F.date_format(day, "ddMMyyyy"))
    area = F.floor(p["left"] / 99) + 1
    ssn = F.concat(pad(area + F.when(area >= 666, 1).otherwise(0), 3), pad(p["left"] % 99 + 1, 2), pad(p["right"] + 1, 4))
    low, code = p["left"] - 200_000, F.floor(p["left"] / 800)
    planned = F.concat(pad(code + 200, 3), pad(p["left"] % 800 + 200, 3))
    unplanned = F.when(low < 0, pad(p["left"], 6)).otherwise(F.concat(pad(F.floor(low / 200) + 200, 3), pad(low % 200, 3)))
    phone = F.concat(F.substr(d, F.lit(1), F.length(d) - 10), F.when(x["kind"] == "phone", planned).otherwise(unplanned), pad(p["right"], 4))
    bban = _fill(F.substr(F.replace(m, F.lit(" ")), F.lit(5)), number)
    iban = F.concat(pad(98 - mod97(F.concat(bban, F.substring(m, 1, 2), F.lit("00"))), 2), number)
    return (
        F.when(x["kind"] == "ip", ip).when(x["kind"] == "date", _fill(m, date)).when(x["kind"] == "ssn", _fill(m, ssn))
        .when(x["kind"].endswith("phone"), _fill(m, phone)).when(x["kind"].startswith("iban"), _fill(m, iban))
        .otherwise(_fill(m, F.concat(number, check)))
    )


_CLASSES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789")


def _shift(c: Column, by: Column) -> Column:
    """The character moved by a number of places within its class."""
    out = c
    for letters in _CLASSES:
        out = F.when(F.instr(F.lit(letters), c) > 0, F.substr(F.lit(letters), (F.pmod(F.instr(F.lit(letters), c) - 1 + by, F.lit(len(letters))) + 1).cast("int"), F.lit(1))).otherwise(out)
    return out


def _single(c: Column, key: str) -> Column:
    """The pseudonym of a letter or digit that stands alone, within its class."""
    out = c
    for letters in _CLASSES:
        at = F.instr(F.lit(letters), c) - 1
        long = lambda v: v.cast("long")
        x = F.struct(F.lit(f"single {letters[0]}").alias("kind"), F.lit(len(letters) // 2).cast("long").alias("a"), F.lit(2).cast("long").alias("b"), long(F.floor(at / 2)).alias("left"), long(at % 2).alias("right"))
        # In an array of one, so that the permuted pair is made once.
        new = F.get(F.transform(F.array(permute(x, key)), lambda p: F.substr(F.lit(letters), (p["left"] * 2 + p["right"] + 1).cast("int"), F.lit(1))), F.lit(0))  # noqa: B023
        out = F.when(at >= 0, new).otherwise(out)
    return out


def email(m: Column, key: str) -> Column:
    """The pseudonym of an address: letters and digits of its local part permuted among those of the same form."""
    local = F.substring_index(m, "@", 1)
    plain = F.filter(F.split(local, ""), lambda c: c.rlike("[A-Za-z0-9]"))
    half = F.ceil(F.size(plain) / 2).cast("int")
    pair = lambda left, right: F.struct(left.alias("left"), right.alias("right"))
    start = pair(F.slice(plain, F.lit(1), half), F.slice(plain, half + 1, F.size(plain)))

    def step(sign: int):
        def run(acc: Column, i: Column) -> Column:
            other = lambda a: F.array_join(a, "")
            moved = lambda a, b: F.transform(a, lambda c, j: _shift(c, sign * (_random(key, F.lit("email"), i * 1000 + j, other(b)) % 2600)))
            return F.when(i % 2 == 0, pair(moved(acc["left"], acc["right"]), acc["right"])).otherwise(pair(acc["left"], moved(acc["right"], acc["left"])))

        return run

    there = F.aggregate(F.sequence(F.lit(0), F.lit(5)), start, step(1), lambda p: pair(F.transform(p["left"], lambda c, j: F.when(j == 0, _shift(c, F.lit(1))).otherwise(c)), p["right"]))
    back = F.aggregate(F.sequence(F.lit(5), F.lit(0), F.lit(-1)), there, step(-1), lambda p: F.concat(p["left"], p["right"]))
    new = F.when(F.size(plain) == 1, F.transform(plain, lambda c: _single(c, key))).otherwise(back)
    gaps = F.split(local, "[A-Za-z0-9]", -1)
    return F.concat(F.array_join(F.zip_with(gaps, new, lambda g, c: F.concat(g, F.coalesce(c, F.lit("")))), ""), F.lit("@"), F.substring_index(m, "@", -1))


def pseudonymise(df: DataFrame, key: str, text: str = "text", count: str = "n_replaced") -> DataFrame:
    """Replace the personal data in ``text`` and add ``count`` (long), how many values were replaced.

    Everything outside the values stays as it was, and so does a text without any; a null text stays null with count
    0.  A value that isn't valid in its format stays.  Repeated rows and equal values get equal results; a column named
    like ``count`` is replaced; ``key`` is the only secret and belongs in the session's configuration, not in a source.
    """
    df = without(df, count)
    names = df.columns
    m_, v_, p_, n_ = (unused(df, x) for x in ("matches", "values", "permuted", "written"))
    found = df.withColumn(m_, F.when(F.col(text).rlike(HINT), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))))
    found = found.withColumn(v_, F.when(F.size(m_) > 0, F.transform(m_, lambda m: F.struct(m.alias("m"), F.when(~_is(m, "email"), domain(m)).alias("x")))))
    found = found.withColumn(p_, F.when(F.size(v_) > 0, F.transform(v_, lambda v: F.struct(v["m"].alias("m"), v["x"].alias("x"), F.when(v["x"]["kind"].isNotNull(), permute(v["x"], key)).alias("p")))))
    found = found.withColumn(n_, F.when(F.size(p_) > 0, F.transform(p_, lambda v: F.when(_is(v["m"], "email"), email(v["m"], key)).when(v["x"]["kind"].isNull(), v["m"]).otherwise(_written(v["m"], v["x"], v["p"])))))
    new = F.when(F.size(n_) > 0, F.array_join(F.zip_with(F.split(text, ANY, -1), n_, lambda g, n: F.concat(g, F.coalesce(n, F.lit("")))), "")).otherwise(F.col(text))
    changed = F.coalesce(F.size(F.filter(F.zip_with(m_, n_, lambda m, n: m != n), lambda x: x)), F.lit(0))
    return found.select(*(new.alias(text) if c == text else F.col(f"`{c}`") for c in names), F.when(F.size(n_) > 0, changed).otherwise(0).cast("long").alias(count))
