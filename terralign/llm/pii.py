"""Format-preserving pseudonyms of personal data by a keyed Feistel network, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralign.llm.common import spare

#: Length of an IBAN by country.
IBANS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _of_length(n: int, countries: str) -> str:
    groups, rest = divmod(n - 4, 4)
    tail = f" ?[A-Z0-9]{{{rest}}}" if rest else ""
    return f"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{groups}}}{tail}"


#: A country code of the telephone: of one digit, of three, or else of two.
THREE = "(?:2[1-69]|3[578]|42|5[09]|6[789]|8[0578]|9[679])[0-9]"
CALLED = rf"\+(?:[17]|{THREE}|(?!{THREE}|[17])[0-9]{{2}})"

#: What is looked for, in this order. Formats only; the functions below decide what is valid. No group repeats without
#: a bound: Java's matcher recurses for each turn. A domain has 253 characters at most.
FORMATS = {
    "email": r"(?<![A-Za-z0-9._%+\u00C0-\u04FF-])[A-Za-z0-9._%+\u00C0-\u04FF-]{1,64}@[A-Za-z0-9-][A-Za-z0-9.-]{0,252}(?<=[A-Za-z0-9-])\.[A-Za-z]{2,24}",
    "iban": r"(?<![\p{L}\p{N}])(?:(?:" + "|".join(_of_length(*x) for x in IBANS.items()) + r")(?![\p{L}\p{N}])|[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}]))",
    "card": r"(?<![\p{L}\p{N}.-])(?:[0-9]{13,19}|[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{4}|[0-9]{4} [0-9]{4} [0-9]{4} [0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![\p{L}\p{N}])",
    "phone": r"(?<![\p{L}\p{N}])(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![\p{L}\p{N}])",
    "abroad": rf"(?<![\p{{L}}\p{{N}}])(?:{CALLED}(?:(?:[ .-]?[0-9]{{2,4}}){{2,4}}|[ .-]?[0-9](?:[ .-]?[0-9]{{2,4}}){{2,5}})|\+[0-9]{{2}}(?:[ .-]?[0-9]{{2,4}}){{2,4}})(?![\p{{L}}\p{{N}}])",
    "ssn": r"(?<![\p{L}\p{N}-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}-])",
    "ip": r"(?<![\p{L}\p{N}.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![\p{L}\p{N}]|\.[0-9])",
    "date": r"(?<![\p{L}\p{N}/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![\p{L}\p{N}/-])",
}
ANY = "|".join(f"(?:{p})" for p in FORMATS.values())
ROUNDS = 10
#: Dates from 1900-01-01 through 2099-12-31 are 73,049 = 17 x 4,297 days.
DAY_RADICES = (17, 4297)


@dataclass(frozen=True)
class Cipher:
    """The secret as a column, and whether to encipher or to go back."""

    key: Column
    back: bool = False


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once for all places where it stands."""
    return F.element_at(F.transform(F.array(value), use), 1)


def feistel(values: Column, radices: Column, cipher: Cipher, tweak: Column, rounds: int = ROUNDS) -> Column:
    """Keyed permutation of symbols: value k, of 0 to radix k - 1, stays within its radix.

    The symbols are cut into halves; each round moves every symbol of one half,
    modulo its radix, by a hash of its place and of the round's SHA-256 of key,
    tweak, round and the other half. Going back, the rounds run in reverse.
    """

    def run(given: Column) -> Column:
        middle, radix = given["middle"], lambda i: F.get(given["radices"], i)

        def step(state: Column, r: Column) -> Column:
            even = r % 2 == 0
            other = F.array_join(F.transform(F.filter(state, lambda _, j: (j < middle) != even), lambda x: x.cast("string")), ",")

            def moved(digest: Column) -> Column:
                def one(v: Column, i: Column) -> Column:
                    by = F.pmod(F.xxhash64(digest, i), radix(i))
                    return F.when(((i < middle) == even) & (radix(i) > 1), F.pmod(v - by if cipher.back else v + by, radix(i))).otherwise(v)

                return F.transform(state, one)

            return _let(F.sha2(F.concat_ws("|", cipher.key, tweak, r.cast("string"), other), 256), moved)

        turns = F.sequence(F.lit(rounds - 1), F.lit(0)) if cipher.back else F.sequence(F.lit(0), F.lit(rounds - 1))
        return F.aggregate(turns, given["values"], step)

    longs = lambda x: F.transform(x, lambda v: v.cast("long"))
    return _let(F.struct(longs(values).alias("values"), longs(radices).alias("radices"), F.floor(F.size(values) / 2).cast("int").alias("middle")), run)


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


#: First and last of the kinds of characters that are permuted: digits, small and capital letters of ASCII, Latin-1, Latin Extended-A, Greek and Cyrillic.
KINDS = ("09", "az", "AZ", "àö", "øÿ", "ÀÖ", "ØÞ", "Āſ", "αω", "ΑΡ", "ΣΩ", "ая", "АЯ", "ѐџ", "ЀЏ")


def _alphabet(c: Column) -> Column:
    """(base, radix) of a character: those of its kind; others stand for themselves."""
    code = F.ascii(c)

    def of(base: int, radix: int) -> Column:
        return F.struct(F.lit(base).alias("base"), F.lit(radix).alias("radix"))

    out, more = of(0, 1), of(0, 1)
    for first, last in reversed(KINDS[3:]):
        more = F.when(code.between(ord(first), ord(last)), of(ord(first), ord(last) - ord(first) + 1)).otherwise(more)
    out = F.when(code > 127, more).otherwise(out)
    for first, last in reversed(KINDS[:3]):
        out = F.when(code.between(ord(first), ord(last)), of(ord(first), ord(last) - ord(first) + 1)).otherwise(out)
    return out


def _char(code: Column) -> Column:
    return F.when(code < 256, F.chr(code)).otherwise(F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE"))


def _letters(text: Column, key: Cipher, tweak: Column) -> Column:
    """Letters and digits permuted, each within its kind; the rest stays."""
    chars = _chars(text)
    radices = F.transform(chars, lambda c: _alphabet(c)["radix"])
    values = F.transform(chars, lambda c: F.when(_alphabet(c)["radix"] > 1, F.ascii(c) - _alphabet(c)["base"]).otherwise(0))
    return F.array_join(F.zip_with(chars, feistel(values, radices, key, tweak), lambda c, v: F.when(_alphabet(c)["radix"] > 1, _char(_alphabet(c)["base"] + v)).otherwise(c)), "")


def luhn_sum(digits: Column) -> Column:
    """Luhn's sum of a digit string."""
    twice = F.transform(F.reverse(_chars(digits)), lambda c, i: (F.ascii(c) - 48) * (1 + i % 2))
    return F.aggregate(twice, F.lit(0), lambda s, x: s + F.when(x > 9, x - 9).otherwise(x))


def mod_97(account: Column) -> Column:
    """Remainder of ISO 13616 of letters and digits already moved into order."""
    return F.aggregate(_chars(account), F.lit(0).cast("long"), lambda s, c: F.when(F.ascii(c) < 58, s * 10 + F.ascii(c) - 48).otherwise(s * 100 + F.ascii(c) - 55) % 97)


def _into(shape: Column, digits: Column) -> Column:
    """The digits in place of those of shape."""
    return F.array_join(F.zip_with(F.split(shape, "[0-9]", -1), _chars(digits), lambda s, d: F.concat(s, F.coalesce(d, F.lit("")))), "")


def _card(hit: Column, key: Cipher) -> Column:
    digits = _digits(hit)
    body = F.substring(digits, F.lit(1), F.length(digits) - 1)
    new = _letters(body, key, F.concat(F.lit("card"), F.length(digits).cast("string")))
    check = (10 - luhn_sum(F.concat(new, F.lit("0"))) % 10) % 10
    return F.when(luhn_sum(digits) % 10 == 0, _into(hit, F.concat(new, check.cast("string")))).otherwise(hit)


def _phone(hit: Column, key: Cipher) -> Column:
    """North American number: the last ten digits; the first of area and exchange stays within 2-9 (or within 0-1)."""
    digits = _digits(hit)
    body = _chars(F.substring(digits, -10, 10))
    lead = lambda c, i: i.isin(0, 3) & (F.ascii(c) >= 50)
    low = lambda c, i: i.isin(0, 3) & (F.ascii(c) < 50)
    values = F.transform(body, lambda c, i: F.when(lead(c, i), F.ascii(c) - 50).otherwise(F.ascii(c) - 48))
    radices = F.transform(body, lambda c, i: F.when(lead(c, i), 8).when(low(c, i), 2).otherwise(10))
    new = F.transform(F.arrays_zip(body.alias("c"), feistel(values, radices, key, F.lit("phone")).alias("v")), lambda x, i: F.chr(F.when(lead(x["c"], i), 50).otherwise(48) + x["v"]))
    kept = F.substring(digits, F.lit(1), F.length(digits) - 10)
    return _into(hit, F.concat(kept, F.array_join(new, "")))


def _abroad(hit: Column, key: Cipher) -> Column:
    """The country code stays."""
    code = F.regexp_extract(hit, f"^{CALLED}", 0)
    rest = F.substring(hit, F.length(code) + 1, F.length(hit))
    return F.concat(code, _into(rest, _letters(_digits(rest), key, F.concat(F.lit("abroad"), code))))


def _ssn(hit: Column, key: Cipher) -> Column:
    area, group, serial = (F.substring(hit, a, n).cast("int") for a, n in ((1, 3), (5, 2), (8, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    new = feistel(F.array(F.when(area < 666, area - 1).otherwise(area - 2), group - 1, serial - 1), F.array(F.lit(898), F.lit(99), F.lit(9999)), key, F.lit("ssn"))

    def shown(v: Column) -> Column:
        area = F.when(v[0] < 665, v[0] + 1).otherwise(v[0] + 2)
        return F.concat_ws("-", F.lpad(area.cast("string"), 3, "0"), F.lpad((v[1] + 1).cast("string"), 2, "0"), F.lpad((v[2] + 1).cast("string"), 4, "0"))

    return F.when(valid, F.element_at(F.transform(F.array(new), shown), 1)).otherwise(hit)


def _ip(hit: Column, key: Cipher) -> Column:
    parts = F.transform(F.split(hit, r"\."), lambda p: p.cast("int"))
    new = feistel(parts, F.transform(parts, lambda _: F.lit(256)), key, F.lit("ip"))
    return F.when(F.forall(parts, lambda p: p < 256), F.array_join(F.transform(new, lambda v: v.cast("string")), ".")).otherwise(hit)


def _shown(shape: str, days: Column) -> Column:
    return F.date_format(F.date_add(F.lit("1900-01-01").cast("date"), days.cast("int")), shape)


def _any_day(shape: str, hit: Column, key: Cipher) -> Column:
    """Another day of 1900 to 2099; null if hit is none."""
    day = F.datediff(F.try_to_timestamp(hit, F.lit(shape)).cast("date"), F.lit("1900-01-01").cast("date"))
    new = feistel(F.array(F.floor(day / DAY_RADICES[1]), day % DAY_RADICES[1]), F.array(*map(F.lit, DAY_RADICES)), key, F.lit("date"))
    shown = _let(new, lambda v: _shown(shape, v[0] * DAY_RADICES[1] + v[1]))
    return F.when(day.between(0, DAY_RADICES[0] * DAY_RADICES[1] - 1), shown)


def _late_day(hit: Column, key: Cipher) -> Column:
    """For day/month/year with a day above 12, which reads in no other way: a day that does so too; null if hit is none.

    Days to the 28th change day and month; the others keep the day and change to a
    month that has it, the 29th of February to that of another leap year.
    """
    day, month, year = (F.substring(hit, a, n).cast("int") for a, n in ((1, 2), (4, 2), (7, 4)))
    real = F.try_to_timestamp(hit, F.lit("dd/MM/yyyy")).isNotNull() & year.between(1900, 2099)
    years = year - 1900
    long, short = [1, 3, 5, 7, 8, 10, 12], [m for m in range(1, 13) if m != 2]
    place = lambda months: F.array_position(F.array(*map(F.lit, months)), month) - 1
    as_text = lambda d, m, y: F.concat_ws("/", F.lpad(d.cast("string"), 2, "0"), F.lpad(m.cast("string"), 2, "0"), y.cast("string"))

    def turned(values: list[Column], radices: list[int], back: Callable[[Column], Column]) -> Column:
        return _let(feistel(F.array(*values), F.array(*map(F.lit, radices)), key, F.lit("late" + ",".join(map(str, radices)))), back)

    def of(months: list[int]) -> Column:
        at = lambda v: F.element_at(F.array(*map(F.lit, months)), (v[1] + 1).cast("int"))
        return turned([years, place(months)], [200, len(months)], lambda v: as_text(day, at(v), v[0] + 1900))

    leap = (year - 1904) / 4
    early = turned([years * 12 + month - 1, day - 13], [2400, 16], lambda v: as_text(v[1] + 13, v[0] % 12 + 1, F.floor(v[0] / 12) + 1900))
    february = turned([F.floor(leap / 7), leap % 7], [7, 7], lambda v: as_text(day, month, (v[0] * 7 + v[1]) * 4 + 1904))
    return F.when(real, F.when(day <= 28, early).when(month == 2, february).when(day == 31, of(long)).otherwise(of(short)))


def _date(hit: Column, key: Cipher) -> Column:
    """A date of 1900 to 2099, as year-month-day, day.month.year, or with slashes as month/day/year, else day/month/year."""
    new = F.when(hit.rlike(r"^\d{4}-"), _any_day("yyyy-MM-dd", hit, key)).when(hit.rlike(r"^\d{2}\."), _any_day("dd.MM.yyyy", hit, key))
    new = new.when(hit.rlike(r"^(0[1-9]|1[0-2])/"), _any_day("MM/dd/yyyy", hit, key)).otherwise(_late_day(hit, key))
    return F.coalesce(new, hit)


def _iban(hit: Column, key: Cipher) -> Column:
    plain = F.replace(hit, F.lit(" "), F.lit(""))
    turned = lambda body, check: F.concat(body, F.substring(plain, 1, 2), check)
    bare = F.substring(plain, F.lit(5), F.length(plain))
    new = _letters(bare, key, F.concat(F.lit("iban"), F.substring(plain, 1, 2)))
    check = F.lpad((98 - mod_97(turned(new, F.lit("00")))).cast("string"), 2, "0")
    chars = _chars(F.concat(F.substring(plain, 1, 2), check, new))
    spaced = F.array_join(F.zip_with(F.split(hit, "[A-Z0-9]", -1), chars, lambda s, c: F.concat(s, F.coalesce(c, F.lit("")))), "")
    return F.when(mod_97(turned(bare, F.substring(plain, 3, 2))) == 1, spaced).otherwise(hit)


def _email(hit: Column, key: Cipher) -> Column:
    at = F.instr(hit, "@")
    local = F.substring(hit, F.lit(1), at - 1)
    return F.concat(_letters(local, key, F.concat(F.lit("email"), F.length(local).cast("string"))), F.substring(hit, at, F.length(hit)))


def pseudonym(hit: Column, key: Cipher) -> Column:
    """The pseudonym of one value in one of FORMATS; a value that isn't valid in any stays as it is."""
    whole = {k: hit.rlike(f"^(?:{p})$") for k, p in FORMATS.items()}
    made = {"email": _email, "iban": _iban, "card": _card, "phone": _phone, "abroad": _abroad, "ssn": _ssn, "ip": _ip, "date": _date}
    out = hit
    for kind in reversed(FORMATS):
        out = F.when(whole[kind], made[kind](hit, key)).otherwise(out)
    return out


def pseudonymized(docs: DataFrame, secret: str | Column, text: str = "text", changed: str = "n_changed", back: bool = False) -> DataFrame:
    """docs with the personal data in text replaced, and changed: how many values are others now.

    E-mail addresses (their local part; the domain stays, and so do letters beyond Cyrillic,
    before which a name begins), IBANs (mod 97), payment cards (Luhn),
    telephone numbers, US social security numbers, IPv4 addresses and dates (1900 to
    2099) that are valid get a pseudonym of the same format, valid as well. It
    depends on secret and the value alone, so equal values stay equal everywhere and
    different ones differ; back=True restores the values, given the secret. A literal
    secret is seen in Spark's plans; a column (say, of a joined table) is not.
    Null texts stay null with 0 changes, empty texts and texts without such values
    stay as they are; very long texts are whole; repeated rows, empty tables and
    nulls elsewhere don't matter; other columns pass through, whatever their names
    (one named as changed is replaced).
    """
    key, column = Cipher(secret if isinstance(secret, Column) else F.lit(secret), back), F.col(text)
    hits, new = spare(docs, "_hits"), spare(docs, "_new")
    found = docs.withColumn(hits, F.when(column.rlike("[0-9@]"), F.regexp_extract_all(column, F.lit(ANY), F.lit(0))))
    found = found.withColumn(new, F.when(F.size(hits) > 0, F.transform(hits, lambda h: pseudonym(h, key))))
    joined = F.array_join(F.zip_with(F.split(column, ANY, -1), new, lambda s, h: F.concat(s, F.coalesce(h, F.lit("")))), "")
    count = F.coalesce(F.size(F.filter(F.zip_with(hits, new, lambda a, b: a != b), lambda x: x)), F.lit(0))
    out = found.withColumn(changed, F.when(F.col(new).isNull(), 0).otherwise(count))
    return out.withColumn(text, F.when(F.col(new).isNotNull(), joined).otherwise(column)).drop(hits, new)


def query(spark, sf_dir: str) -> DataFrame:
    """op5: every document with pseudonyms; production jobs pass their own secret."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pseudonymized(docs, "a secret for the registered query alone")
