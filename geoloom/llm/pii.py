"""PII: format-preserving Feistel pseudonyms, in SQL functions only.

Found values are validated; a valid one is permuted within its format by a keyed Feistel network, so
equal values have equal pseudonyms in all documents and different ones stay different:

    email      letters and digits of the local part, each within its kind; the domain stays
    phone      the ten digits, with the area code in parentheses or, if area and exchange begin with
               2 to 9, without; or '+', country code and 6 to 18 digits; code and punctuation stay
    ip         four octets up to 255, as a 32-bit number
    ipv6       eight groups, or fewer around '::', with a digit, as hexadecimal digits
    date       YYYY-MM-DD, DD/MM/YYYY or DD.MM.YYYY, a real day of 1900 to 2099, as a day number;
               MM/DD/YYYY or MM.DD.YYYY with a day above 12, as its rank among such days
    ssn        valid area-group-serial, as its rank among the valid ones
    card       13 to 19 digits (also 4-4-4-4 or 4-6-5) with a right Luhn digit, which is made anew
    secret     32 to 64 hexadecimal digits with a letter and a digit, as hexadecimal digits
    key        AKIA, ASIA, AIza, gh?_, github_pat_, xox?-, glpat-, sk- and rk- keys (these with a
               digit): letters and digits after the prefix, each within its kind

Not treated: dates with one-digit or written months, phones without '+' in other groups than 3-3-4,
IPv6 that begins or ends with '::', secrets of other forms.

Invalid look-alikes stay as they are. The round function is SHA-256 of key, kind, round and other half.

Defined cases: a null text stays null, an empty one empty; texts without a digit, '@' or AWS prefix pass unread;
rows are treated one by one, so repeated rows and ties do not matter; other columns stay as they are
(but pii_found and pii_replaced, where counts are asked for, hold the counts).
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

ROUNDS = 8
KEY = "geoloom-demo-key"  # for demonstrations and tests
KEY_SETTING = "spark.geoloom.pii.key"  # the session's secret

# Fixed patterns; the first alternative that fits wins. An address is tried only where its run of characters
# begins and gives no character back, and all repetitions of groups are bounded, so matching is linear in the text.
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@(?:[A-Za-z0-9-]{1,63}\.){1,20}[A-Za-z]{2,63}"
PHONE = r"(?:\+\d{1,3}[ .-]?)?\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}\b"
BARE = r"\b(?:1[ .-])?[2-9]\d{2}[ .-][2-9]\d{2}[ .-]\d{4}\b"
ABROAD = r"\+[1-9]\d{7,14}\b|\+1[ .-]\d{3}[ .-]\d{3}[ .-]\d{4}\b|\+[1-9]\d{0,2}[ .-]\d{1,2}(?:[ .-]\d{2}){4}\b|\+[1-9]\d{0,2}(?:[ .-]\d{2,8}){1,3}\b"
CODE = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"  # after removal of punctuation
IP = r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"
IPV6 = r"\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b|\b(?:[0-9a-fA-F]{1,4}:){1,6}(?::[0-9a-fA-F]{1,4}){1,6}\b"
DATE = r"\b\d{4}-\d{2}-\d{2}\b"
DAY = r"\b(?:\d{2}/\d{2}/|\d{2}\.\d{2}\.)\d{4}\b"
SSN = r"\b\d{3}-\d{2}-\d{4}\b"
CARD = r"\b(?:\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|\d{4}[ -]\d{6}[ -]\d{5}|\d{13,19})\b"
SECRET = r"\b[0-9a-fA-F]{32,64}\b"
TOKEN = r"\b(?:(?:AKIA|ASIA)[0-9A-Z]{16}\b|AIza[0-9A-Za-z_-]{35}|gh[pousr]_[0-9A-Za-z]{36,255}\b|github_pat_[0-9A-Za-z_]{22,255}|xox[abeprs]-[0-9A-Za-z-]{10,255}|glpat-[0-9A-Za-z_-]{20,255}|[sr]k[-_][0-9A-Za-z_-]{16,255})"
PREFIX = r"^(?:AKIA|ASIA|AIza|gh[pousr]_|github_pat_|xox[abeprs]-|glpat-|[sr]k[-_](?:[a-z]+[-_])*)"
ANY = "|".join((EMAIL, TOKEN, PHONE, ABROAD, BARE, IPV6, IP, DATE, DAY, SSN, CARD, SECRET))


def _digest(key: str, kind: str, i: Column, half: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), half.cast("string")).cast("binary"), 256)


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def permuted(x: Column, a: Column | int, b: Column | int, key: str, kind: str) -> Column:
    """Keyed permutation of 0 .. a*b - 1: x = left * b + right; rounds add to the halves by turns."""
    a, b = (v if isinstance(v, Column) else F.lit(v) for v in (a, b))
    start = F.struct(((x - F.pmod(x, b)) / b).cast("decimal(20,0)").cast("long").alias("l"), F.pmod(x, b).cast("long").alias("r"))

    def one(acc, i):
        odd = i % 2 == 1
        f = F.conv(F.substring(_digest(key, kind, i, F.when(odd, acc["l"]).otherwise(acc["r"])), 1, 12), 16, 10).cast("long")
        return F.struct(F.when(odd, acc["l"]).otherwise(F.pmod(acc["l"] + f, a)).cast("long").alias("l"), F.when(odd, F.pmod(acc["r"] + f, b)).otherwise(acc["r"]).cast("long").alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, one, lambda acc: acc["l"] * b + acc["r"])


def _chars(s: Column) -> Column:
    return F.when(F.length(s) > 0, F.transform(F.sequence(F.lit(1), F.length(s)), lambda p: s.substr(p, F.lit(1)))).otherwise(F.array().cast("array<string>"))


def _turn(c: Column, k: Column, alphabets: tuple[str, ...]) -> Column:
    """Character c moved by k within its alphabet; others stay."""
    out = c
    for letters in alphabets:
        at = F.instr(F.lit(letters), c)
        out = F.when(at > 0, F.lit(letters).substr(((at - 1 + k) % len(letters) + 1).cast("int"), F.lit(1))).otherwise(out)
    return out


def permuted_text(s: Column, key: str, kind: str, alphabets: tuple[str, ...]) -> Column:
    """Keyed permutation of strings: each half's characters are moved within their alphabets by a digest of the other half."""
    cut = F.floor(F.length(s) / 2).cast("int")
    start = F.struct(s.substr(F.lit(1), cut).alias("l"), s.substr(cut + 1, F.length(s)).alias("r"))

    def one(acc, i):
        odd = i % 2 == 1
        moved, other = F.when(odd, acc["r"]).otherwise(acc["l"]), F.when(odd, acc["l"]).otherwise(acc["r"])

        def turned(h):
            shift = lambda p: F.conv(h.substr((p * 2 % 64 + 1).cast("int"), F.lit(2)), 16, 10).cast("int")
            return F.array_join(F.transform(_chars(moved), lambda c, p: _turn(c, shift(p), alphabets)), "")

        new = _let(_digest(key, kind, i, other), turned)
        return F.struct(F.when(odd, acc["l"]).otherwise(new).alias("l"), F.when(odd, new).otherwise(acc["r"]).alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, one, lambda acc: F.concat(acc["l"], acc["r"]))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _filled(form: Column, digits: Column) -> Column:
    """form with its digits replaced by the given ones, in order."""
    return F.array_join(F.transform(_chars(form), lambda c, p: F.when(c.between("0", "9"), digits.substr(F.length(_digits(form.substr(F.lit(1), p + 1))), F.lit(1))).otherwise(c)), "")


def luhn_sum(digits: Column, first_doubled: bool) -> Column:
    """Luhn sum from the right; first_doubled: the last digit is doubled (a payload without check digit)."""
    def worth(c, p):
        d = c.cast("int") * F.when(p % 2 == (0 if first_doubled else 1), 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.transform(_chars(F.reverse(digits)), worth), F.lit(0), lambda acc, d: acc + d)


def _number(digits: Column, key: str, kind: str) -> Column:
    """A digit string (up to 18) permuted among those of its length."""
    low = F.floor(F.length(digits) / 2)
    power = lambda n: F.concat(F.lit("1"), F.repeat(F.lit("0"), n.cast("int"))).cast("long")
    return F.lpad(permuted(digits.cast("long"), power(low), power(F.length(digits) - low), key, kind).cast("string"), F.length(digits), F.lit("0"))


_FIRST_DAY = "1900-01-01"
_DAYS = (17, 4297)  # product: days from 1900-01-01 to 2099-12-31


def _day(date: Column, key: str) -> Column:
    return F.date_add(F.lit(_FIRST_DAY).cast("date"), permuted(F.datediff(date, F.lit(_FIRST_DAY).cast("date")).cast("long"), *_DAYS, key, "date").cast("int"))


def _real_day(s: Column, form: str) -> Column:
    day = F.try_to_date(s, form)
    return F.when(day.between(F.lit(_FIRST_DAY).cast("date"), F.lit("2099-12-31").cast("date")) & (F.date_format(day, form) == s), day)


_LATE = 44249  # days above the 12th of a month, from 1900 to 2099


def _late_day(day: Column, key: str) -> Column:
    """A day above the 12th, permuted among those: 44250 is a product, and what meets its last number goes on once."""
    first = F.lit(_FIRST_DAY).cast("date")
    before = lambda month: F.datediff(F.add_months(first, month), first).cast("long") - 12 * month
    month = ((F.year(day) - 1900) * 12 + F.month(day) - 1).cast("int")
    step = lambda x: permuted(x, 150, 295, key, "late day")
    rank = _let(step(before(month) + F.dayofmonth(day) - 13), lambda x: F.when(x == _LATE, step(F.lit(_LATE).cast("long"))).otherwise(x))

    def found(x):
        about = F.floor(x * 2400 / _LATE).cast("int")
        at = F.array_max(F.filter(F.sequence(F.greatest(about - 2, F.lit(0)), about + 2), lambda m: before(m) <= x))
        return _let(at, lambda m: F.date_add(F.add_months(first, m), (x - before(m) + 12).cast("int")))

    return _let(rank, found)


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of a found value; null if it is not valid."""
    part = lambda n, sep: F.split(m, sep)[n].cast("long")
    octet = lambda n: part(n, r"\.")
    ip = F.when((octet(0) < 256) & (octet(1) < 256) & (octet(2) < 256) & (octet(3) < 256), _let(permuted(((octet(0) * 256 + octet(1)) * 256 + octet(2)) * 256 + octet(3), 65536, 65536, key, "ip"), lambda x: F.concat_ws(".", *[F.pmod(F.shiftright(x, s), F.lit(256)).cast("string") for s in (24, 16, 8, 0)])))
    area, group, serial = (part(n, "-") for n in range(3))
    ok = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    rank = (area - F.when(area > 666, 2).otherwise(1)) * (99 * 9999) + (group - 1) * 9999 + serial - 1
    ssn = F.when(ok, _let(permuted(rank, 898, 99 * 9999, key, "ssn"), lambda x: F.concat_ws("-", *[F.lpad(v.cast("long").cast("string"), n, "0") for v, n in ((_let((x - x % (99 * 9999)) / (99 * 9999), lambda y: F.when(y >= 665, y + 2).otherwise(y + 1)), 3), ((x % (99 * 9999) - x % (99 * 9999) % 9999) / 9999 + 1, 2), (x % (99 * 9999) % 9999 + 1, 4))])))
    payload = _digits(m).substr(F.lit(1), F.length(_digits(m)) - 1)
    card = F.when(luhn_sum(_digits(m), False) % 10 == 0, _let(_number(payload, key, "card"), lambda p: _filled(m, F.concat(p, F.pmod(-luhn_sum(p, True), F.lit(10)).cast("string")))))
    phone = _let(_digits(m), lambda d: _filled(m, F.concat(d.substr(F.lit(1), F.length(d) - 10), _number(d.substr(F.length(d) - 9, F.lit(10)), key, "phone"))))
    plain = F.regexp_replace(m, "[ .-]", "")
    code = F.regexp_extract(plain, CODE, 0)
    national = plain.substr(F.length(code) + 1, F.length(plain))
    abroad = F.when((F.length(code) > 0) & F.length(national).between(6, 18), _filled(m, F.concat(code.substr(F.lit(2), F.length(code)), _number(national, key, "phone"))))
    kinds = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789")
    hexa = ("0123456789", "abcdef", "ABCDEF")
    ipv6 = F.when(m.rlike("[0-9]") & (~m.contains("::") | (F.size(F.split(m, ":+")) <= 7)), permuted_text(m, key, "ipv6", hexa))
    prefix = F.regexp_extract(m, PREFIX, 0)
    token = F.when(~m.rlike("^[sr]k") | m.rlike("[0-9]"), F.concat(prefix, permuted_text(m.substr(F.length(prefix) + 1, F.length(m)), key, "key", kinds)))
    local = F.substring_index(m, "@", 1)
    email = F.concat(permuted_text(local, key, "email", kinds), F.lit("@"), F.substring_index(m, "@", -1))
    secret = F.when(m.rlike("[0-9]") & m.rlike("[a-fA-F]"), permuted_text(m, key, "secret", hexa))
    iso = "yyyy-MM-dd"

    def either(dmy, mdy):
        return F.coalesce(F.date_format(_day(_real_day(m, dmy), key), dmy), F.date_format(_late_day(_real_day(m, mdy), key), mdy))

    return (
        F.when(F.instr(m, "@") > 0, email)
        .when(m.rlike(PREFIX), token)
        .when((F.instr(m, "(") > 0) | m.rlike(f"^{BARE}$"), phone)
        .when(m.startswith("+"), abroad)
        .when(F.instr(m, ":") > 0, ipv6)
        .when(m.rlike(r"^\d{2}\.\d{2}\.\d{4}$"), either("dd.MM.yyyy", "MM.dd.yyyy"))
        .when(F.instr(m, ".") > 0, ip)
        .when(F.instr(m, "/") > 0, either("dd/MM/yyyy", "MM/dd/yyyy"))
        .when(m.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.date_format(_day(_real_day(m, iso), key), iso))
        .when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), ssn)
        .when(m.rlike(r"^[\d -]+$") & (F.length(_digits(m)) <= 19), card)
        .otherwise(secret)
    )


def session_key(spark: SparkSession) -> str:
    """The secret of the session; without one the demonstration key, with a warning, as its pseudonyms are no protection."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        warnings.warn(f"{KEY_SETTING} is not set; pseudonyms are made with the published demonstration key", stacklevel=2)
    return key or KEY


def pseudonymise(docs: DataFrame, key: str = KEY, column: str = "text", counts: bool = True) -> DataFrame:
    """docs with the text's personal data replaced, and (with counts) pii_found and pii_replaced (long)."""
    text = F.col(column)
    found, made = common.fresh(docs, "found"), common.fresh(docs, "made")
    maybe = text.rlike("[0-9@]|AKIA|ASIA")
    rows = docs.withColumn(found, F.when(maybe, F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn(made, F.transform(found, lambda m: pseudonym(m, key)))
    between = F.split(text, ANY, -1)
    filled = F.array_join(F.zip_with(between, F.zip_with(made, found, lambda a, b: F.coalesce(a, b)), lambda x, y: F.concat(x, F.coalesce(y, F.lit("")))), "")
    rows = rows.withColumn(column, F.when(F.size(found) > 0, filled).otherwise(text))
    if counts:
        rows = rows.withColumns({"pii_found": F.size(found).cast("long"), "pii_replaced": F.size(F.filter(made, lambda x: x.isNotNull())).cast("long")})
    return rows.drop(found, made)
