"""PII pseudonyms in DataFrame functions: keyed Feistel permutations that keep each value's format.

A text is split at the matches of one pattern; each match is validated and mapped inside the row,
and the pieces are joined again, so text outside matches stays as it is. Numbers and dates are
permuted within their own format, one-to-one for a key: equal values get equal pseudonyms in every
document, different values different ones.

    card       13 to 19 digits, perhaps grouped; the digits before the last are permuted, and the last
               keeps its distance from the Luhn digit: valid numbers stay valid, others invalid
    iban       digits are permuted among digits and letters among letters; the check digits keep their
               distance from the right ones. Invalid ones with fewer than eight digits stay
    phone      + and a country code, North American and German national forms: the digits after the
               country code or leading zero are permuted; punctuation stays
    ssn        numbers that can be are permuted among those (area 001 to 899 but 666, group and serial not
               zero); of others the parts that can't be stay so, and what is left is permuted
    ip         the 32 bits of an address are permuted; of IPv6 both halves of 64 bits, written in full
    date       days from 1900-01-01 on, DAYS of them, are permuted; the form of writing stays, and the
               same day written in two forms maps to the same day. In day/month/year with a day over 12
               that day stays over 12: months and days to the 28th are permuted, for later days the year

E-mail addresses and hexadecimal secrets of 32 digits or more are no numbers: they become keyed
digests of the same form (an address with 128 bits, as many hexadecimal digits), linked across
documents too.

Runs of ten digits without a separator are taken for no phone number. A phone number, address, date or
social security number is found after a letter too (SSN123-45-6789), the other forms aren't.

Defined cases: null stays null and has no entities; an empty text stays empty. A date that doesn't
exist or lies outside the range stays. Texts of any length are handled whole. Rows are never
dropped; columns other than the text stay as they are, and the added count, of the matches that were
replaced by another text, takes a name that is free.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table

#: For tests and examples; give a secret of your own.
EXAMPLE_KEY = "tessera example key"
ROUNDS = 8
#: 270 days by 270: both halves of a permuted day have the same modulus.
DAY_SIDE = 270
DAYS = DAY_SIDE * DAY_SIDE
FIRST_DAY = "1900-01-01"

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_GROUPS = r"[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})"
FORMS = {
    "email": r"(?<![0-9A-Za-z._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}",
    "secret": r"(?<![0-9A-Za-z])(?=[A-Fa-f]*[0-9])(?=[0-9]*[A-Fa-f])(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?![0-9A-Za-z])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "ip6": rf"(?<![0-9A-Za-z:])(?=[A-Fa-f:]*\d)(?:{_GROUPS}{{7}}|(?:{_GROUPS}{{0,5}})?::(?:{_GROUPS}{{0,5}})?)(?![0-9A-Za-z:]|\.\d)",
    "phone": r"(?<![0-9+.-])(?:\+(?=(?:[ ./()-]{0,2}\d){7})\d{1,3}(?:[ ./-]?\(?\d{1,5}\)?){2,6}(?!\d)|(?:1[ .-])?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)|(?:\(0\d{2,4}\) ?|0\d{2,4}[ /-])\d{5,8}(?!\d))",
    "ip": rf"(?<![0-9.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?\d)",
    "date": r"(?<![0-9./-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}/\d{1,2}/\d{4})(?![\d/-])",
    "ssn": r"(?<![0-9-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<![0-9A-Za-z.])(?:(?:\d{4}[ -]){3}\d{4}(?:[ -]\d{3})?|\d{4}[ -]\d{6}[ -]\d{5}|\d{13,19})(?!\d)",
}
#: Each form looks behind itself: names, keys and runs of digits begin at no letter or digit, but phones,
#: addresses, dates and social security numbers may follow a letter. The last group begins with one of few characters.
_WORDS, _NUMBERS = ("secret", "iban", "ip6"), ("phone", "ip", "date", "ssn", "card")
PATTERN = "|".join([FORMS["email"], "(?=[0-9A-Fa-f:A-Z])(?:" + "|".join(FORMS[k] for k in _WORDS) + ")", r"(?=[0-9(+])(?:" + "|".join(FORMS[k] for k in _NUMBERS) + ")"])
#: The area numbers of no social security number, besides all from 900.
NO_AREA = (0, 666)
#: Country codes of one and two digits; all others have three.
COUNTRY_CODE = r"^\+(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
#: Months of the range that are permuted for day/month/year.
MONTHS = 2376


def let(value: Column, body) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def noise(key: str, kind: str, number: Column, half: Column) -> Column:
    """60 keyed bits for a round."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), number.cast("string"), half.cast("string")), 256), 1, 15), 16, 10).cast("long")


def feistel(key: str, kind: str, left: Column, right: Column, left_size: Column, right_size: Column) -> Column:
    """Permute the pair (left below left_size, right below right_size); returns struct(a, b) of the same ranges."""
    start = F.struct(left.cast("long").alias("a"), right.cast("long").alias("b"))

    def step(pair, i):
        size = F.when(i % 2 == 0, left_size).otherwise(right_size)
        return F.struct(pair["b"].alias("a"), F.pmod(pair["a"] + F.pmod(noise(key, kind, i, pair["b"]), size), size).alias("b"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def permute_digits(key: str, kind: str, digits: Column) -> Column:
    """Permute a string of 2 to 36 digits among the strings of that length."""
    n = F.length(digits)
    half = F.floor(n / 2).cast("int")
    a, b = F.substr(digits, F.lit(1), half), F.substr(digits, half + 1, n)
    power = lambda k: F.rpad(F.lit("1"), k + 1, F.lit("0")).cast("long")
    out = feistel(key, kind, a, b, power(half), power(n - half))
    # ROUNDS is even: the halves are back in place
    return let(out, lambda p: F.concat(F.lpad(p["a"].cast("string"), half, F.lit("0")), F.lpad(p["b"].cast("string"), n - half, F.lit("0"))))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def luhn_digit(body: Column) -> Column:
    """The check digit of a string of digits."""
    n = F.length(body)

    def doubled(i):
        d = F.substr(body, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when((n - i) % 2 == 0, twice).otherwise(d)

    total = F.aggregate(F.transform(F.sequence(F.lit(1), n), doubled), F.lit(0), lambda s, x: s + x)
    return F.pmod(10 - F.pmod(total, F.lit(10)), F.lit(10)).cast("string")


def filled(form: Column, digits: Column) -> Column:
    """form with its digits replaced, from left to right, by those of a string as long."""
    start = F.struct(F.lit(1).alias("i"), F.lit("").alias("s"))
    step = lambda acc, c: F.when(c.rlike(r"\d"), F.struct((acc["i"] + 1).alias("i"), F.concat(acc["s"], F.substr(digits, acc["i"], F.lit(1))).alias("s"))).otherwise(F.struct(acc["i"].alias("i"), F.concat(acc["s"], c).alias("s")))
    return F.aggregate(F.split(form, ""), start, step, lambda acc: acc["s"])


def mod97(digits: Column) -> Column:
    """Remainder by 97 of a string of digits of any length."""
    return F.aggregate(F.split(digits, ""), F.lit(0), lambda s, c: F.when(c == "", s).otherwise((s * 10 + c.cast("int")) % 97))


def letter_number(letters: Column) -> Column:
    """A string of up to 12 capital letters as a number to base 26."""
    return F.aggregate(F.split(letters, ""), F.lit(0).cast("long"), lambda n, c: F.when(c == "", n).otherwise(n * 26 + F.ascii(c) - 65))


def permute_letters(key: str, kind: str, letters: Column) -> Column:
    """Permute a string of up to 24 capital letters among the strings of that length."""
    n = F.length(letters)
    half = F.floor(n / 2).cast("int")
    a, b = letter_number(F.substr(letters, F.lit(1), half)), letter_number(F.substr(letters, half + 1, n))
    power = lambda k: F.aggregate(F.array_repeat(F.lit(26), k), F.lit(1).cast("long"), lambda p, x: p * x)
    out = feistel(key, kind, a, b, power(half), power(n - half))
    written = lambda number, k: F.aggregate(F.array_repeat(F.lit(0), k), F.struct(number.alias("n"), F.lit("").alias("s")), lambda acc, _: F.struct(F.floor(acc["n"] / 26).cast("long").alias("n"), F.concat(F.char((acc["n"] % 26 + 65)), acc["s"]).alias("s")), lambda acc: acc["s"])
    return F.when(n == 0, letters).otherwise(let(out, lambda p: F.concat(written(p["a"], half), written(p["b"], n - half))))


def filled_both(form: Column, digits: Column, letters: Column) -> Column:
    """form with its digits and its capital letters replaced, each from left to right."""
    start = F.struct(F.lit(1).alias("i"), F.lit(1).alias("j"), F.lit("").alias("s"))

    def step(acc, c):
        digit = F.struct((acc["i"] + 1).alias("i"), acc["j"].alias("j"), F.concat(acc["s"], F.substr(digits, acc["i"], F.lit(1))).alias("s"))
        letter = F.struct(acc["i"].alias("i"), (acc["j"] + 1).alias("j"), F.concat(acc["s"], F.substr(letters, acc["j"], F.lit(1))).alias("s"))
        return F.when(c.rlike(r"\d"), digit).when(c.rlike("[A-Z]"), letter).otherwise(F.struct(acc["i"].alias("i"), acc["j"].alias("j"), F.concat(acc["s"], c).alias("s")))

    return F.aggregate(F.split(form, ""), start, step, lambda acc: acc["s"])


def iban_check(country: Column, body: Column) -> Column:
    """The right check digits, as a number; letters count from A = 10."""
    turned = F.transform(F.split(F.concat(body, country), ""), lambda c: F.when(c.rlike("[A-Z]"), (F.ascii(c) - 55).cast("string")).otherwise(c))
    return 98 - mod97(F.concat(F.array_join(turned, ""), F.lit("00")))


def iban(key: str, match: Column) -> Column:
    flat = F.regexp_replace(match, " ", "")
    country, body = F.substring(flat, 1, 2), F.substr(flat, F.lit(5), F.length(flat))
    digits, letters = _digits(body), F.regexp_replace(body, r"\d", "")
    off = F.pmod(F.substring(flat, 3, 2).cast("int") - iban_check(country, body), F.lit(100))
    # bodies have 8 letters or fewer where they are permuted with fewer than two digits
    moved = F.struct(F.when(F.length(digits) > 1, permute_digits(key, "iban", digits)).otherwise(digits).alias("d"), permute_letters(key, "iban letters", letters).alias("l"), off.alias("off"))

    def written(new):
        form = F.substr(match, F.lit(5), F.length(match))
        after = filled_both(form, new["d"], new["l"])
        check = F.pmod(iban_check(country, F.regexp_replace(after, " ", "")) + new["off"], F.lit(100))
        return F.concat(country, F.lpad(check.cast("string"), 2, "0"), after)

    return F.when((off == 0) | (F.length(digits) >= 8), let(moved, written)).otherwise(match)


def card(key: str, match: Column) -> Column:
    digits = _digits(match)
    body = F.substr(digits, F.lit(1), F.length(digits) - 1)
    off = F.substring(digits, -1, 1).cast("int") - luhn_digit(body).cast("int")
    last = lambda new: F.pmod(luhn_digit(new["body"]).cast("int") + new["off"], F.lit(10)).cast("string")
    return let(F.struct(permute_digits(key, "card", body).alias("body"), off.alias("off")), lambda new: filled(match, F.concat(new["body"], last(new))))


def phone(key: str, match: Column) -> Column:
    digits = _digits(match)
    n = F.length(digits)
    code = F.length(F.regexp_extract(match, COUNTRY_CODE, 1))
    national = F.when(match.rlike(r"^\(?0\d{2,4}[) /-] ?\d{5,8}$"), 1).otherwise(n - 10)
    kept = F.when(F.startswith(match, F.lit("+")), code).otherwise(national)
    return filled(match, F.concat(F.substr(digits, F.lit(1), kept), permute_digits(key, "phone", F.substr(digits, kept + 1, n))))


def ip6(key: str, match: Column) -> Column:
    side = lambda i: F.filter(F.split(F.coalesce(F.get(F.split(match, "::"), F.lit(i)), F.lit("")), ":"), lambda g: g != "")
    groups = F.concat(side(0), F.array_repeat(F.lit("0"), 8 - F.size(side(0)) - F.size(side(1))), side(1))

    def half(all_, first):
        word = lambda i: F.conv(F.get(all_, F.lit(i)), 16, 10).cast("long") * 65536 + F.conv(F.get(all_, F.lit(i + 1)), 16, 10).cast("long")
        out = feistel(key, f"ip6 {first}", word(first), word(first + 2), F.lit(1 << 32), F.lit(1 << 32))
        hexed = lambda x: F.lower(F.hex(x))
        return let(out, lambda p: F.concat_ws(":", *[hexed(F.floor(p[c] / 65536).cast("long") if high else p[c] % 65536) for c in "ab" for high in (True, False)]))

    return let(groups, lambda g: F.concat_ws(":", half(g, 0), half(g, 4)))


def ip(key: str, match: Column) -> Column:
    o = F.split(match, r"\.")
    part = lambda i: F.get(o, F.lit(i)).cast("long")
    out = feistel(key, "ip", part(0) * 256 + part(1), part(2) * 256 + part(3), F.lit(65536), F.lit(65536))
    return let(out, lambda p: F.concat_ws(".", F.floor(p["a"] / 256), p["a"] % 256, F.floor(p["b"] / 256), p["b"] % 256))


def date(key: str, match: Column) -> Column:
    """ISO dates, day.month.year, and month/day/year (day/month/year where only that exists)."""
    # each form: a pattern, and the groups of year, month and day
    forms = [(r"^(\d{4})-(\d{2})-(\d{2})$", (1, 2, 3)), (r"^(\d{4})/(\d{2})/(\d{2})$", (1, 2, 3)), (r"^(\d{1,2})\.(\d{1,2})\.(\d{4})$", (3, 2, 1)), (r"^(\d{1,2})/(\d{1,2})/(\d{4})$", (3, 1, 2))]
    result = day_first(key, match)
    for pattern, groups in reversed(forms):
        y, m, d = (F.lpad(F.regexp_extract(match, pattern, g), 4 if k == 0 else 2, "0") for k, g in enumerate(groups))
        day = F.datediff(F.try_to_timestamp(F.concat_ws("-", y, m, d), F.lit("yyyy-MM-dd")).cast("date"), F.lit(FIRST_DAY).cast("date"))
        out = feistel(key, "date", F.floor(day / DAY_SIDE), day % DAY_SIDE, F.lit(DAY_SIDE), F.lit(DAY_SIDE))

        def written(pair):
            new = F.date_add(F.lit(FIRST_DAY).cast("date"), (pair["a"] * DAY_SIDE + pair["b"]).cast("int"))
            parts = {groups[0]: F.date_format(new, "yyyy"), groups[1]: F.date_format(new, "MM"), groups[2]: F.date_format(new, "dd")}
            return F.concat_ws("-" if "-" in pattern else r"/" if "/" in pattern else ".", parts[1], parts[2], parts[3])

        result = F.when(match.rlike(pattern) & day.between(0, DAYS - 1), let(out, written)).otherwise(result)
    return result


def day_first(key: str, match: Column) -> Column:
    """day/month/year that isn't month/day/year: the day is over 12, and so is the new one."""
    d, m, y = (F.regexp_extract(match, r"^(\d{1,2})/(\d{1,2})/(\d{4})$", g).try_cast("int") for g in (1, 2, 3))
    real = F.try_to_timestamp(F.format_string("%04d-%02d-%02d", y, m, d), F.lit("yyyy-MM-dd")).isNotNull()
    months = (y - 1900) * 12 + m - 1
    early = feistel(key, "date early", F.floor(months / 12), months % 12 * 16 + d - 13, F.lit(MONTHS // 12), F.lit(12 * 16))
    late = feistel(key, "date late", F.floor((y - 1900) / 10), (y - 1900) % 10, F.lit(20), F.lit(10))
    new_early = let(early, lambda p: F.format_string("%02d/%02d/%04d", p["b"] % 16 + 13, F.floor(p["b"] / 16) + 1, p["a"] + 1900))
    new_late = let(late, lambda p: F.format_string("%02d/%02d/%04d", d, m, p["a"] * 10 + p["b"] + 1900))
    return F.when(real & d.between(13, 28) & months.between(0, MONTHS - 1), new_early).when(real & (d > 28) & (m != 2) & y.between(1900, 2099), new_late).otherwise(match)


def ssn(key: str, match: Column) -> Column:
    """Area, group and serial number; each of the four kinds (area that can be or not, group zero, serial zero) is permuted within itself."""
    a, g, n = (F.regexp_extract(match, r"^(\d{3})-(\d{2})-(\d{4})$", i).try_cast("int") for i in (1, 2, 3))
    low, high = NO_AREA
    real = (a != low) & (a != high) & (a < 900)
    place = F.when(a < high, a - 1).otherwise(a - 2)  # among the 898 areas that can be
    area = lambda i: F.when(i < high - 1, i + 1).otherwise(i + 2)
    odd_place = F.when(a == low, 0).when(a == high, 1).otherwise(a - 898)
    odd_area = lambda i: F.when(i == 0, low).when(i == 1, high).otherwise(i + 898)
    text = lambda x, y, z: F.format_string("%03d-%02d-%04d", x.cast("int"), y.cast("int"), z.cast("int"))
    whole = feistel(key, "ssn", place * 99 + g - 1, n - 1, F.lit(898 * 99), F.lit(9999))
    no_area = feistel(key, "ssn area", odd_place * 100 + g, n, F.lit(102 * 100), F.lit(10_000))
    no_group = feistel(key, "ssn group", place, n, F.lit(898), F.lit(10_000))
    no_serial = feistel(key, "ssn serial", place, g - 1, F.lit(898), F.lit(99))
    return (
        F.when(~real, let(no_area, lambda p: text(odd_area(F.floor(p["a"] / 100)), p["a"] % 100, p["b"])))
        .when(g == 0, let(no_group, lambda p: text(area(p["a"]), F.lit(0), p["b"])))
        .when(n == 0, let(no_serial, lambda p: text(area(p["a"]), p["b"] + 1, F.lit(0))))
        .otherwise(let(whole, lambda p: text(area(F.floor(p["a"] / 99)), p["a"] % 99 + 1, p["b"] + 1)))
    )


def secret(key: str, match: Column) -> Column:
    n = F.length(match)
    own = F.sha2(F.concat_ws("|", F.lit(key), F.lit("secret"), F.lower(match)), 256)
    out = F.substr(F.repeat(own, F.ceil(n / 64).cast("int")), F.lit(1), n)
    return F.when(match.rlike("[a-f]"), out).otherwise(F.upper(out))


def email(key: str, match: Column) -> Column:
    own = lambda s, what, n: F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(what), F.lower(s)), 256), 1, n)
    return F.concat(F.lit("u"), own(match, "email", 32), F.lit("@d"), own(F.substring_index(match, "@", -1), "domain", 8), F.lit(".example"))


def pseudonym(key: str, match: Column) -> Column:
    """A match's pseudonym, by the first form that it has as a whole."""
    whole = lambda kind: match.rlike(r"^(?:" + FORMS[kind] + ")$")
    makers = {"email": email, "secret": secret, "iban": iban, "ip6": ip6, "phone": phone, "ip": ip, "date": date, "card": card}
    result = ssn(key, match)
    for kind in reversed(list(makers)):
        result = F.when(whole(kind), makers[kind](key, match)).otherwise(result)
    return result


def free_name(name: str, df: DataFrame) -> str:
    """name, with underscores added until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def pseudonymise(docs: DataFrame, key: str, column: str = "text", count: str = "n_pii") -> DataFrame:
    """docs with the column's matches replaced, and the number of those replaced (null text: 0) as count, or count with underscores added where docs has that name."""
    found, fresh, count = free_name("_found", docs), free_name("_fresh", docs), free_name(count, docs)
    df = docs.withColumn(found, F.regexp_extract_all(F.col(column), F.lit(PATTERN), F.lit(0)))
    df = df.withColumn(fresh, F.transform(found, lambda m: pseudonym(key, m)))
    changed = F.filter(F.zip_with(found, fresh, lambda m, new: m != new), lambda x: x)
    gaps = F.split(F.col(column), PATTERN, -1)
    joined = F.array_join(F.flatten(F.zip_with(gaps, fresh, lambda g, m: F.array(g, F.coalesce(m, F.lit(""))))), "")
    df = df.withColumn(count, F.coalesce(F.size(changed), F.lit(0)).cast("long"))
    return df.withColumn(column, F.when(F.size(found) > 0, joined).otherwise(F.col(column))).drop(found, fresh)


def op8_pii_feistel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text with pseudonyms."""
    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), EXAMPLE_KEY)


QUERIES = {"op8_pii_feistel": op8_pii_feistel}
