import datetime
import hashlib
import random
import re

from pyspark.sql import functions as F

from lectern.llm.pii import RESULT, Pseudonyms, permute_digits, pseudonymize


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def run(spark, *texts, key="k"):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_cards int")
    return pseudonymize(docs, Pseudonyms(key=key)).orderBy("doc_id").collect()


def test_permutation_and_back(spark):
    config = Pseudonyms(key="s")
    for n in (2, 3, 5):
        digits = spark.range(10**n).select(F.lpad(F.col("id").cast("string"), n, "0").alias("d"))
        moved = digits.select("d", permute_digits(F.col("d"), "t", config).alias("e"))
        back = moved.select("d", "e", permute_digits(F.col("e"), "t", config, True).alias("b"))
        row = back.agg(F.countDistinct("e").alias("n"), F.count_if(F.col("d") != F.col("b")).alias("bad")).first()
        assert (row["n"], row["bad"]) == (10**n, 0)


def test_formats(spark):
    card, a, b, c, d = run(
        spark, "pay 4111-1111-1111-1111 or 4111111111111111, not 4111111111111112", "from 10.1.2.3 to 999.1.1.1",
        "born 2000-02-29, 30.02.2020, 01/12/1999", "call +1 (988) 555-2485", "to John.Doe7@mail.example.com now",
    )
    first, second, third = re.findall(r"[\d-]{16,}", card["text"])
    assert luhn(first.replace("-", "")) and first.replace("-", "") == second and second != "4111111111111111"
    assert third == "4111111111111112" and card["n_cards"] == 2
    ip = re.search(r"from (\S+) to 999\.1\.1\.1", a["text"])[1]
    assert all(0 <= int(x) < 256 for x in ip.split(".")) and ip != "10.1.2.3" and a["n_addresses"] == 1
    iso, kept, slashed = re.fullmatch(r"born (\S+), (\S+), (\S+)", b["text"]).groups()
    assert datetime.date.fromisoformat(iso) and kept == "30.02.2020" and datetime.datetime.strptime(slashed, "%d/%m/%Y") and b["n_dates"] == 2
    assert re.fullmatch(r"call \+1 \(\d{3}\) \d{3}-\d{4}", c["text"]) and c["text"] != "call +1 (988) 555-2485"
    assert re.fullmatch(r"to [A-Z][a-z]{3}\.[A-Z][a-z]{2}\d@mail\.example\.com now", d["text"]) and d["n_mails"] == 1


def test_neighbours(spark):
    row = run(spark, "4111111111111111 10.1.2.3 4111111111111111 +1 (988) 555-2485 123456 4111 1111 1111 1111 7")[0]
    assert (row["n_cards"], row["n_addresses"], row["n_phones"]) == (3, 1, 1) and "4111" not in row["text"] and "10.1.2.3" not in row["text"]
    assert row["text"].endswith(" 7") and " 123456 " in row["text"]


def test_equal_values_stay_linked(spark):
    one, two = run(spark, "x 10.1.2.3 y", "10.1.2.3")
    assert two["text"] in one["text"]
    assert run(spark, "10.1.2.3", key="other")[0]["text"] != two["text"]


def test_cases(spark):
    null, empty, plain, long = run(spark, None, "", "no data", "word " * 50_000 + "10.1.2.3")
    assert null["text"] is None and empty["text"] == "" and plain["text"] == "no data" and long["n_addresses"] == 1
    assert all(null[c] == 0 for c in RESULT)
    assert pseudonymize(spark.createDataFrame([], "doc_id long, text string"), Pseudonyms(key="s")).count() == 0


def plain_feistel(value, left, right, size, kind, key="k"):
    def seed(i, half):
        return int(hashlib.sha256(f"{key}|{kind}|{size}|{i}|{half}".encode()).hexdigest()[:13], 16)

    a, b = divmod(value, right)
    for i in range(8):
        if i % 2 == 0:
            a = (a + seed(i, b) % left) % left
        else:
            b = (b + seed(i, a) % right) % right
    return a * right + b


def plain_digits(digits, kind):
    n = len(digits)
    return str(plain_feistel(int(digits), 10 ** (n - n // 2), 10 ** (n // 2), n, kind)).zfill(n)


def refill(shape, digits):
    left = iter(digits)
    return "".join(next(left) if c in "0123456789" else c for c in shape)


def plain_card(found):
    digits = re.sub("[^0-9]", "", found)
    if not luhn(digits):
        return found
    body = plain_digits(digits[:-1], "card")
    return refill(found, body + next(c for c in "0123456789" if luhn(body + c)))


def plain_address(found):
    value = 0
    for part in found.split("."):
        value = value * 256 + int(part)
    return ".".join(str(b) for b in plain_feistel(value, 65536, 65536, 32, "address").to_bytes(4, "big"))


def plain_phone(found):
    code = (re.match(r"\+[0-9]{1,3}[ -]?", found) or re.match("", found))[0]
    rest = found[len(code) :]
    return code + refill(rest, plain_digits(re.sub("[^0-9]", "", rest), "phone"))


def plain_date(found):
    shape = "%Y-%m-%d" if "-" in found else "%d/%m/%Y" if "/" in found else "%d.%m.%Y"
    try:
        day = datetime.datetime.strptime(found, shape).date()
    except ValueError:
        return found
    first = datetime.date(day.year // 400 * 400 or 1, 1, 1)
    new = first + datetime.timedelta(plain_feistel((day - first).days, 189, 773, 400, "date"))
    return shape.replace("%Y", f"{new.year:04}").replace("%m", f"{new.month:02}").replace("%d", f"{new.day:02}")


def test_against_plain_python(spark):
    rng = random.Random(3)
    number = lambda n: "".join(rng.choices("0123456789", k=n))
    found = []
    for _ in range(60):
        body = number(rng.choice((14, 15)))
        found.append((body + next(c for c in "0123456789" if luhn(body + c)), plain_card))
        found.append((".".join(str(rng.randrange(256)) for _ in range(4)), plain_address))
        found.append((f"+{rng.randint(1, 99)} ({number(3)}) {number(3)}-{number(4)}", plain_phone))
        found.append((f"{rng.randint(2000, 2399)}-{rng.randint(1, 12):02}-{rng.randint(1, 31):02}", plain_date))
        found.append((f"{rng.randint(1, 28):02}.{rng.randint(1, 12):02}.{rng.randint(2000, 2399)}", plain_date))
        found.append((f"({number(3)}) {number(3)}-{number(4)}", plain_phone))
        found.append((f"{number(3)}.{number(3)}.{number(4)}", plain_phone))
        found.append((f"+{rng.randint(1, 9)}{number(10)}", lambda x: x[:4] + plain_digits(x[4:], "phone")))
    got = run(spark, *[f"see {x} there" for x, _ in found])
    for (x, plain), r in zip(found, got):
        assert r["text"] == f"see {plain(x)} there", x


def plain_mail(found):
    local, domain = found.split("@", 1)

    def sweep(chars, salt, shape):
        out = ""
        for c in chars:
            key = int(hashlib.sha256(f"k|mail|{salt}|{shape}|{out}".encode()).hexdigest()[:8], 16)
            for first, n in (("0", 10), ("a", 26), ("A", 26)):
                if 0 <= ord(c) - ord(first) < n and c.isalnum():
                    c = chr(ord(first) + (ord(c) - ord(first) + key % n) % n)
                    break
            out += c
        return out

    parts = []
    for block in re.findall(".{1,64}", local):
        shape = re.sub("[A-Z]", "A", re.sub("[a-z]", "a", re.sub("[0-9]", "0", block)))
        parts.append(sweep(sweep(block, 0, shape)[::-1], 1, shape)[::-1])
    return "".join(parts) + "@" + domain


def test_mails_against_plain_python(spark):
    rng = random.Random(6)
    mails = ["".join(rng.choices("abcXYZ019._%+-", k=rng.randint(1, 150))) + "@mail.example.com" for _ in range(30)]
    for old, r in zip(mails, run(spark, *mails)):
        assert r["text"] == plain_mail(old)


def test_month_first_dates_and_long_mails(spark):
    dates = [f"{m:02}/{d:02}/{y}" for y in (2024, 1999) for m in (1, 2, 12) for d in (13, 28, 29, 30, 31)]
    rows = run(spark, *dates, "a" * 100 + "9@mail.example.com", "B" * 70_000 + "@x.org")
    out = [r["text"] for r in rows[: len(dates)]]
    assert len(set(out)) == len(dates)
    for old, new in zip(dates, out):
        try:
            datetime.datetime.strptime(old, "%m/%d/%Y")
        except ValueError:
            assert new == old
            continue
        assert datetime.datetime.strptime(new, "%m/%d/%Y") and int(new[3:5]) > 12
    assert not rows[-2]["text"].startswith("aaaa") and re.fullmatch(r"[a-z]{100}[0-9]@mail\.example\.com", rows[-2]["text"])
    assert re.fullmatch(r"[A-Z]{70000}@x\.org", rows[-1]["text"]) and "B" * 100 not in rows[-1]["text"]
