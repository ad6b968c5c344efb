"""Pseudonyms by brute force: a plain Python Feistel network over every value of every text."""

import datetime as dt
import hashlib
import re
import time

from data import SF
from tidemark.llm import pii, queries

CLASSES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789")
EPOCH = dt.date(1900, 1, 1)


def noise(key: str, kind: str, i: int, half) -> int:
    return int(hashlib.sha256(f"{key}|{kind}|{i}|{half}".encode()).hexdigest()[:13], 16)


def permute(key: str, kind: str, a: int, b: int, left: int, right: int) -> tuple[int, int]:
    def forward(x, y, sign, rounds):
        for i in rounds:
            if i % 2 == 0:
                x = (x + sign * noise(key, kind, i, y)) % a
            else:
                y = (y + sign * noise(key, kind, i, x)) % b
        return x, y

    x, y = forward(left, right, 1, range(8))
    return forward((x + 1) % a, y, -1, range(7, -1, -1))


def luhn(d: str) -> bool:
    return sum(int(c) if i % 2 == 0 else sum(divmod(int(c) * 2, 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def number(key: str, kind: str, digits: str) -> str:
    k = (len(digits) + 1) // 2
    rest = len(digits) - k
    x, y = permute(key, kind, 10**k, 10**rest, int(digits[:k]), int(digits[k:]))
    return f"{x:0{k}d}{y:0{rest}d}"


def fill(m: str, digits: str) -> str:
    it = iter(digits)
    return re.sub(r"[0-9]", lambda _: next(it), m)


def residue(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


def one(key: str, m: str) -> str:
    d = re.sub(r"[^0-9]", "", m)
    if "@" in m:
        local, _, home = m.partition("@")
        plain = [c for c in local if c.isascii() and c.isalnum()]
        if len(plain) == 1:
            letters = next(x for x in CLASSES if plain[0] in x)
            x, y = permute(key, f"single {letters[0]}", len(letters) // 2, 2, *divmod(letters.index(plain[0]), 2))
            new = [letters[2 * x + y]]
        else:
            half = (len(plain) + 1) // 2
            parts = [plain[:half], plain[half:]]

            def shift(c, by):
                letters = next(x for x in CLASSES if c in x)
                return letters[(letters.index(c) + by) % len(letters)]

            def run(sign, rounds):
                for i in rounds:
                    mine, other = i % 2, "".join(parts[1 - i % 2])
                    parts[mine] = [shift(c, sign * (noise(key, "email", i * 1000 + j, other) % 2600)) for j, c in enumerate(parts[mine])]

            run(1, range(6))
            parts[0][0] = shift(parts[0][0], 1)
            run(-1, range(5, -1, -1))
            new = parts[0] + parts[1]
        it = iter(new)
        return re.sub("[A-Za-z0-9]", lambda _: next(it), local) + "@" + home
    if re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}", m):
        o = [int(x) for x in m.split(".")]
        if max(o) > 255:
            return m
        x, y = permute(key, "ip", 65536, 65536, o[0] * 256 + o[1], o[2] * 256 + o[3])
        return f"{x // 256}.{x % 256}.{y // 256}.{y % 256}"
    if re.fullmatch(r"[0-9]{4}[-/][0-9]{2}[-/][0-9]{2}|[0-9]{2}[./][0-9]{2}[./][0-9]{4}", m):
        first = m[4] in "-/"
        try:
            day = (dt.date(int(d[:4]), int(d[4:6]), int(d[6:])) if first else dt.date(int(d[4:]), int(d[2:4]), int(d[:2]))) - EPOCH
        except ValueError:
            return m
        x, y = permute(key, "date", 319, 229, *divmod(day.days, 229))
        return fill(m, (EPOCH + dt.timedelta(x * 229 + y)).strftime("%Y%m%d" if first else "%d%m%Y"))
    if re.fullmatch(r"[0-9]{3}-[0-9]{2}-[0-9]{4}", m):
        area, group, serial = (int(x) for x in m.split("-"))
        if not (1 <= area <= 899 and area != 666 and group and serial):
            return m
        x, y = permute(key, "ssn", 898 * 99, 9999, (area - (2 if area > 666 else 1)) * 99 + group - 1, serial - 1)
        area = x // 99 + 1
        return fill(m, f"{area + (area >= 666):03d}{x % 99 + 1:02d}{y + 1:04d}")
    if re.match("[A-Z]{2}", m):
        compact = m.replace(" ", "")
        land, bban = compact[:2], compact[4:]
        if residue(bban + compact[:4]) != 1:
            return m
        new = number(key, "iban" + land + re.sub("[0-9]", "9", bban), re.sub("[A-Z]", "", bban))
        return fill(m, f"{98 - residue(fill(bban, new) + land + '00'):02d}" + new)
    if re.fullmatch(r"[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5}", m):
        if not luhn(d):
            return m
        new = number(key, f"card{len(d)}", d[:-1])
        return fill(m, new + next(c for c in "0123456789" if luhn(new + c)))
    area, exchange, last = int(d[-10:-7]), int(d[-7:-4]), int(d[-4:])
    if area >= 200 and exchange >= 200:
        x, y = permute(key, "phone", 640_000, 10_000, (area - 200) * 800 + exchange - 200, last)
        return fill(m, f"{d[:-10]}{x // 800 + 200:03d}{x % 800 + 200:03d}{y:04d}")
    if re.match(r"\+[0-9]{1,2}[ .-]\(", m):
        x, y = permute(key, "marked phone", 360_000, 10_000, area * 1000 + exchange if area < 200 else 200_000 + (area - 200) * 200 + exchange, last)
        code = f"{x:06d}" if x < 200_000 else f"{(x - 200_000) // 200 + 200:03d}{(x - 200_000) % 200:03d}"
        return fill(m, f"{d[:-10]}{code}{y:04d}")
    return m


def brute(key: str, text: str) -> tuple[str, int]:
    count = 0

    def swap(m):
        nonlocal count
        new = one(key, m[0])
        count += new != m[0]
        return new

    return re.sub(pii.ANY, swap, text, flags=re.ASCII), count


AWKWARD = [
    "DE89370400440532013000 or DE89 3704 0044 0532 0130 00 EURO, BE68 5390 0754 7034 PAID; GB29 NWBK 6016 1331 9268 19.", "DE88370400440532013000", "NL91ABNA0417164300 XNL91ABNA0417164300",
    "call 000 123 4567 or 111.222.3333 or (212) 155-0100", "212 555 0100, 212.555.0100, (212) 555-0100, +1 (212) 555-0100, +1 212-555-0100", "+1 (017) 555-7713; +1 (999) 017-0000", "a@x.org b@x.org z@x.org A@x.org 7@x.org _q@x.org", "--ann@x.org ann@x.org .a.n.n.@x.org",
    "l" * 64 + "@x.org", "l" * 65 + "@x.org", "a@b@c.org", "8.8.8.8", "4111 1111 1111 1111 5500-0000-0000-0004 378282246310005", "1999-12-31 31/12/1999 29.02.2000 29.02.1900", "078-05-1120 666-12-3456 899-99-9999 665-01-0001",
]


def test_by_brute_force(spark):
    df = spark.createDataFrame(list(enumerate(AWKWARD)), "doc_id long, text string")
    for key in ("k", "another"):
        for r in pii.pseudonymise(df, key).collect():
            assert (r.text, r.n_replaced) == brute(key, AWKWARD[r.doc_id]), AWKWARD[r.doc_id]
    assert [brute("k", t)[1] for t in AWKWARD] == [4, 0, 1, 0, 5, 2, 6, 3, 1, 0, 1, 1, 3, 3, 3]


def test_query_by_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = queries.op2_pii(spark, SF).collect()
    assert len(got) == len(texts) and sum(r.n_replaced for r in got) > 0
    for r in got:
        assert (r.text, r.n_replaced) == brute(queries.DEMO_KEY, texts[r.doc_id])


def test_single_letters_follow_the_key(spark):
    letters = [f"{c}@x.org" for c in CLASSES[0] + CLASSES[1] + CLASSES[2]]
    df = spark.createDataFrame(list(enumerate(letters)), "doc_id long, text string")
    maps = [tuple(r.text for r in pii.pseudonymise(df, key).orderBy("doc_id").collect()) for key in ("k1", "k2", "k3")]
    assert len(set(maps)) == 3
    for new in maps:
        assert sorted(new) == sorted(letters) and not any(a == b for a, b in zip(new, letters))
        steps = {(ord(b[0]) - ord(a[0])) % 26 for a, b in zip(letters[:26], new[:26])}
        assert len(steps) > 5


def test_long_runs_are_read_once(spark):
    """A run of letters, digits or signs costs time in proportion to its length."""
    n = 1_000_000
    runs = ["x" * n + " 11", "x1" * (n // 2), "a." * (n // 2) + " 11", "a@" * (n // 2), "+" * n + "11", "11" + "-" * n, "AB12" * (n // 4), "DE89 3704 " * (n // 10), "a@" + "b" * n]
    for text in runs:
        df = spark.createDataFrame([(1, text)], "doc_id long, text string")
        began = time.time()
        assert pii.pseudonymise(df, "k").first().text is not None
        assert time.time() - began < 15, text[:10]
