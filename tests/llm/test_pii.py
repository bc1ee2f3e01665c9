import re

import pytest

from terralign.llm import pii


def luhn(s):
    t = 0
    for i, ch in enumerate(reversed(s)):
        x = int(ch) * (1 + i % 2)
        t += x - 9 if x > 9 else x
    return t % 10 == 0


def changed(spark, rows, secret="k"):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id int, text string").selectExpr("*", "'own' as other")
    return [r.text for r in sorted(pii.pseudonymized(df, secret).collect())]


def test_formats_and_links(spark):
    rows = [
        "mail bosbt.42@mail8.example.com, ip 42.144.35.254. card 4041894974608795 or 4041-8949-7460-8795, bad 4041894974608796",
        "again 4041894974608795 and bosbt.42@mail8.example.com",
        "phone +1 (988) 555-2485 or 988-555-2485; +49 30 1234 5678",
        "ssn 123-45-6789 000-12-3456 date 2024-02-29 2024-02-30 31.12.1999 12/31/2001 31/12/2001",
        "iban DE89 3704 0044 0532 0130 00 GB82WEST12345698765432 x",
        "",
        None,
        "no 5 hits",
        "999.1.1.1",
        "4041894974608795",
    ]
    got = changed(spark, rows)
    card = re.search(r"card (\d{16})", got[0])[1]
    assert card != "4041894974608795" and luhn(card)
    assert re.search(r"or ([\d-]+)", got[0])[1].replace("-", "") == card and "4041894974608796" in got[0]
    mail = re.search(r"\S+@\S+(?=,)", got[0])[0]
    assert mail in got[1] and card in got[1] and got[9] == card
    assert re.fullmatch(r"[a-z]{5}\.\d\d@mail8\.example\.com", mail) and not mail.startswith("bosbt.42")
    assert all(int(x) < 256 for x in re.search(r"ip ([\d.]+)\. ", got[0])[1].split("."))
    a, b = re.search(r"\+1 \((\d{3})\) (\d{3}-\d{4}) or (\d{3})-(\d{3}-\d{4})", got[2]).group(1, 2), re.search(r"or (\d{3})-(\d{3}-\d{4})", got[2]).group(1, 2)
    assert a == b and a[0][0] in "23456789"
    assert "000-12-3456" in got[3] and "2024-02-30" in got[3] and "2024-02-29" not in got[3] and "123-45-6789" not in got[3]
    import datetime

    datetime.datetime.strptime(re.search(r"(\d\d\.\d\d\.\d{4})", got[3])[1], "%d.%m.%Y")
    slashed = re.findall(r"\d\d/\d\d/\d{4}", got[3])
    assert datetime.datetime.strptime(slashed[0], "%m/%d/%Y") == datetime.datetime.strptime(slashed[0], "%m/%d/%Y")
    for iban in re.findall(r"DE[0-9 ]{20,25}(?= )|GB[0-9]{2}[A-Z]{4}[0-9]{14}", got[4]):
        plain = iban.replace(" ", "")
        assert int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1
    assert got[5:9] == ["", None, "no 5 hits", "999.1.1.1"]
    assert changed(spark, rows, "another")[1] != got[1]


@pytest.mark.parametrize("kind", ["ip", "date"])
def test_permutation(spark, kind):
    """No two values share a pseudonym."""
    values = [f"10.{i // 256}.{i % 256}.7" for i in range(600)] if kind == "ip" else [f"{1950 + i // 300}-{1 + i % 12:02d}-{1 + i % 28:02d}" for i in range(600)]
    values = sorted(set(values))
    got = changed(spark, values)
    assert len(set(got)) == len(values)


def test_empty(spark):
    assert pii.pseudonymized(spark.createDataFrame([], "doc_id int, text string"), "k").count() == 0


def test_text_behind_ibans_and_country_codes(spark):
    ibans = ["AT61 1904 3002 3457 3201", "BE68 5390 0754 7034", "ES91 2100 0418 4502 0005 1332", "PL61 1090 1014 0000 0712 1981 2874", "LU280019400644750000", "NO93 8601 1117 947"]
    words = ["BIC", "EUR", "SWFT", "A", "FOR", "IBAN"]
    got = changed(spark, [f"pay {i} {w} now" for i, w in zip(ibans, words, strict=True)])
    for iban, word, text in zip(ibans, words, got, strict=True):
        assert iban not in text and text.endswith(f" {word} now")
        new = text[4 : 4 + len(iban)]
        plain = new.replace(" ", "")
        assert [c == " " for c in new] == [c == " " for c in iban] and new[:2] == iban[:2]
        assert int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1
    numbers = {"+353 1 234 5678": "+353 ", "+358 40 1234567": "+358 ", "+7 495 123-45-67": "+7 ", "+33 1 23 45 67 89": "+33 ", "+49 30 1234 5678": "+49 "}
    for (number, code), text in zip(numbers.items(), changed(spark, [f"call {n}, or write" for n in numbers]), strict=True):
        assert number not in text and text.startswith(f"call {code}") and re.sub(r"\d", "0", text) == re.sub(r"\d", "0", f"call {number}, or write")


def test_round_trip_of_every_format(spark):
    import random

    rng = random.Random(4)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card(n):
        body = digits(n - 1)
        return next(body + c for c in "0123456789" if luhn(body + c))

    def iban(country, bare):
        value = int("".join(str(int(c, 36)) for c in bare + country + "00"))
        return f"{country}{98 - value % 97:02d}{bare}"

    rows = []
    for i in range(40):
        rows.append(f"{rng.choice(['Ann', 'b', 'x.Y-9_z'])}{digits(i % 5)}@a.b-{i}.org; {card(13 + i % 7)}, {card(16)[:4]}")
        rows.append(f"{iban('DE', digits(18))} {iban('GB', 'WEST' + digits(14))} BIC {iban('BE', digits(12))}")
        rows.append(f"+1 ({rng.randint(200, 999)}) {rng.randint(200, 999)}-{digits(4)}, {rng.randint(200, 999)}.{rng.randint(200, 999)}.{digits(4)} +353 1 {digits(3)} {digits(4)} +49 30 {digits(4)} {digits(4)}")
        rows.append(f"{rng.randint(1, 665):03d}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d} {rng.randint(0, 255)}.{rng.randint(0, 255)}.0.9, {rng.randint(1900, 2099)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}")
        rows.append(f"{rng.randint(1, 12):02d}/{rng.randint(1, 28):02d}/{rng.randint(1900, 2099)} {rng.randint(13, 31):02d}/{rng.choice([1, 3, 5, 7, 8, 10, 12]):02d}/{rng.randint(1900, 2099)} 30/04/1987 29/02/2004 29/06/1999 31.12.1999 30/02/2001")
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id int, text string").selectExpr("*", "1 as _hits", "2 as _NEW")
    made = pii.pseudonymized(df, "s")
    assert made.columns == [*df.columns, "n_changed"]
    made.write.mode("overwrite").parquet(path := f"{spark.sparkContext.getConf().get('spark.checkpoint.dir')}/pii")
    made = spark.read.parquet(path)
    got = {r.doc_id: r for r in made.collect()}
    assert all(got[i].text != t and got[i].n_changed > 0 and re.sub(r"\d", "0", got[i].text.lower())[-4:] == re.sub(r"\d", "0", t.lower())[-4:] for i, t in enumerate(rows))
    again = {r.doc_id: r.text for r in pii.pseudonymized(made.drop("n_changed"), "s", back=True).collect()}
    assert [again[i] for i in range(len(rows))] == rows


def test_days_above_twelve_are_permuted_among_themselves(spark):
    import datetime

    first = datetime.date(1900, 1, 1)
    days = [first + datetime.timedelta(n) for n in range(73049)]
    late = [d.strftime("%d/%m/%Y") for d in days if d.day > 12 and d.year < 1912]
    got = changed(spark, late)
    assert len(set(got)) == len(late) and got != late
    assert all(int(t[:2]) > 12 and datetime.datetime.strptime(t, "%d/%m/%Y") for t in got)


def test_feistel_against_a_plain_one(spark):
    import hashlib

    import xxhash
    from pyspark.sql import functions as F

    def plain(values, radices, secret, tweak):
        state, middle = list(values), len(values) // 2
        for r in range(pii.ROUNDS):
            even = r % 2 == 0
            other = ",".join(str(v) for j, v in enumerate(state) if (j < middle) != even)
            digest = hashlib.sha256(f"{secret}|{tweak}|{r}|{other}".encode()).hexdigest()
            start = xxhash.xxh64_intdigest(digest, 42)
            for i in range(len(state)):
                if (i < middle) == even:
                    by = xxhash.xxh64_intdigest(i.to_bytes(4, "little"), start)
                    state[i] = (state[i] + (by - (1 << 64) if by >> 63 else by)) % radices[i]
        return state

    cases = [([3, 1, 4, 1, 5], [10] * 5), ([0], [7]), ([12, 0, 898], [17, 1, 899]), ([25, 9] * 20, [26, 10] * 20)]
    for values, radices in cases:
        column = F.array(*map(F.lit, values)), F.array(*map(F.lit, radices))
        there = pii.feistel(*column, pii.Cipher(F.lit("k")), F.lit("t"))
        back = pii.feistel(there, column[1], pii.Cipher(F.lit("k"), back=True), F.lit("t"))
        row = spark.range(1).select(there.alias("there"), back.alias("back")).first()
        assert row.there == plain(values, radices, "k", "t") and row.back == values


def test_long_runs(spark):
    """Very long dotted names, digits, signs and words neither overflow the matcher's stack nor take long."""
    rows = ["a@" + "b." * 2000 + "com", "a@" + "b." * 100_000 + "com", "a@b." * 20_000, "9" * 100_000, "1-" * 50_000, "@" * 100_000, "x" * 300_000 + "@y.org", "+49 " + "30 " * 30_000, "GB82" * 20_000, "Z9" * 100_000, "mail " * 40_000 + "bob@x.org"]
    got = changed(spark, rows)
    assert [len(t) for t in got] == [len(t) for t in rows]
    assert "bob@x.org" not in got[-1] and got[3] == rows[3]


def test_mail_names_beyond_ascii(spark):
    """A name keeps none of its letters' places open, whatever its script up to Cyrillic; it comes back; long unspaced scripts before it don't hide it."""
    names = ["José.x", "Иван.Петров7", "Ærøskøbing", "Ελένη", "Łukasz", "zoë", "müller-lüdenscheidt"]
    rows = [(n, f"an {n}@ex.org, or 联系我们{'请' * 80}{n}@ex.org") for n in names]
    df = spark.createDataFrame(rows, "name string, text string")
    made = pii.pseudonymized(df, "k")
    out = {r.name: r for r in made.collect()}
    for n in names:
        one, two = re.findall(r"(?:an |请)([^ 请@]+)@ex\.org", out[n].text)
        assert one == two != n and out[n].n_changed == 2 and len(one) == len(n)
        assert sum(a != b for a, b in zip(n, one, strict=True)) >= len(n) // 2
        assert [c.isupper() for c in one if c.isascii()] == [c.isupper() for c in n if c.isascii()]
    back = {r.name: r.text for r in pii.pseudonymized(made.drop("n_changed"), "k", back=True).collect()}
    assert back == dict(rows)
