"""Format-preserving Feistel pseudonyms of validated numbers and dates (operator 5).

Built-in DataFrame functions only. Candidates are cut out of a text by one
pattern, validated (Luhn digits of cards, octets of addresses, calendar dates,
ranges of social security numbers, area and exchange codes), permuted by a keyed Feistel network within
their own format, and put back. The permutation is a bijection of the format's
domain, so equal values get equal pseudonyms in all documents and different
values stay different; a network's round function is SHA-256 under the key.

===========  ====================================================  =====================
kind         domain                                                halves
===========  ====================================================  =====================
card         digits between the first and the Luhn digit           powers of ten
phone        numbers whose area and exchange codes open alike      100n x 10^6 m
             (with 2 to 9, as such a code must, or with 0 or 1)    (n, m: 8 or 2)
address      IPv4 as 32 bits                                       2^16 x 2^16
ssn          898 areas x 99 groups x 9999 serials                  29634 x 29997
date         the 146,097 days of the years 1800 to 2199            189 x 773
mail         letters and digits of the local part, class by class  front and back half
===========  ====================================================  =====================

Phone numbers that no exchange can have (codes that open with 0 or 1) get
pseudonyms of the same kind, and possible ones possible ones. Account numbers
with a check by remainder of 97 and numbers of other countries' forms stay. The
key is a literal of the plan, so a log of plans holds it.

Defined results: null stays null with no replacement; a candidate that fails
its validation, and any other text, stays unchanged to the character; repeated
rows give repeated rows; other columns are kept, whatever their names: the count
comes last and has underscores appended to its name where that is taken (in any
case of letters); an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

ROUNDS = 8
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]++[.])+[A-Za-z]{2,}"
PHONE = r"(?:[+]1[ -]?)?(?:[(][0-9]{3}[)] ?|[0-9]{3}[ .-])[0-9]{3}[.-][0-9]{4}"
DATE = r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}[.][0-9]{2}[.][0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4}"
SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"
IPV4 = r"(?:[0-9]{1,3}[.]){3}[0-9]{1,3}"
CARD = r"[0-9]{4}(?: [0-9]{4}){3}|[0-9]{4}(?:-[0-9]{4}){3}|[0-9]{4} [0-9]{6} [0-9]{5}|[0-9]{4}-[0-9]{6}-[0-9]{5}|[0-9]{13,19}"
NUMBER = rf"(?=[0-9+(])(?<![A-Za-z0-9+])(?<![0-9][.-])(?:{PHONE}|{DATE}|{SSN}|{IPV4}|{CARD})(?![A-Za-z0-9])(?![.-][0-9])"
CANDIDATE = rf"{EMAIL}|{NUMBER}"
#: Set around candidates; texts that hold it are cut another way.
MARK = "\u0001"
#: Characters of a mail name that one digest shifts.
AT_ONCE = 20

#: Days from 1800-01-01 to 1970-01-01, and in 400 years.
EPOCH, DAYS = 62_091, 146_097


def _digest(key: str, tweak: Column, turn: Column, value: Column) -> Column:
    """60 bits of a keyed digest."""
    text = F.concat_ws("|", F.lit(key), tweak, turn.cast("string"), value.cast("string"), F.lit(key))
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def _div(a: Column, b: Column | int) -> Column:
    """Whole-number division, which doubles would blur above 2^53."""
    return F.call_function("div", a, F.lit(b) if isinstance(b, int) else b)


def feistel(value: Column, a: Column, b: Column, key: str, tweak: Column) -> Column:
    """Keyed permutation of the whole numbers below ``a * b``: the halves are shifted in turn by a digest of the other."""
    start = F.struct(_div(value, b).alias("l"), (value % b).cast("long").alias("r"))

    def turn(s: Column, i: Column) -> Column:
        left = F.struct(((s["l"] + _digest(key, tweak, i, s["r"])) % a).alias("l"), s["r"].alias("r"))
        right = F.struct(s["l"].alias("l"), ((s["r"] + _digest(key, tweak, i, s["l"])) % b).alias("r"))
        return F.when(i % 2 == 0, left).otherwise(right)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda s: s["l"] * b + s["r"])


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _bound(value: Column, use) -> Column:
    """``use(value)``, with the value worked out once."""
    return F.transform(F.array(value), use)[0]


def _refill(form: Column, digits: Column) -> Column:
    """``form`` with its digits replaced in order."""
    start = F.struct(F.lit("").alias("text"), F.lit(1).alias("next"))

    def put(s: Column, c: Column) -> Column:
        digit = F.struct(F.concat(s["text"], F.substr(digits, s["next"], F.lit(1))).alias("text"), (s["next"] + 1).alias("next"))
        return F.when(c.between("0", "9"), digit).otherwise(F.struct(F.concat(s["text"], c).alias("text"), s["next"].alias("next")))

    return F.aggregate(F.split(form, "", -1), start, put, lambda s: s["text"])


def _padded(value: Column, width: Column | int) -> Column:
    return F.lpad(value.cast("string"), width, "0")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, n - i + 1, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10


def _power_of_ten(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, "0").cast("long")


def card(text: Column, key: str) -> Column:
    d = _digits(text)
    n = F.length(d)
    first, body = F.substr(d, F.lit(1), F.lit(1)), F.substr(d, F.lit(2), n - 2)
    half = F.floor((n - 2) / 2).cast("int")
    mixed = _padded(feistel(body.cast("long"), _power_of_ten(n - 2 - half), _power_of_ten(half), key, F.concat(F.lit("card"), n.cast("string"), first)), n - 2)
    last = (10 - _luhn(F.concat(first, mixed, F.lit("0")))) % 10
    return F.when(_luhn(d) == 0, _refill(text, F.concat(first, mixed, last.cast("string")))).otherwise(text)


def phone(text: Column, key: str) -> Column:
    """Ten digits: area, exchange, line; an area or exchange code that opens with 2 to 9 keeps to these, another to 0 and 1."""
    d = _digits(text)
    part = lambda a, n: F.substr(d, F.length(d) - 10 + a, F.lit(n)).cast("long")
    area, exchange, line = part(1, 3), part(4, 3), part(7, 4)
    least = lambda code: F.when(code >= 200, 200).otherwise(0).cast("long")
    codes = lambda code: F.when(code >= 200, 800).otherwise(200).cast("long")
    width = codes(exchange) * 10_000
    index = (area - least(area)) * width + (exchange - least(exchange)) * 10_000 + line
    mixed = feistel(index, codes(area), width, key, F.concat(F.lit("phone"), least(area).cast("string"), F.lit("-"), least(exchange).cast("string")))
    new = _bound(mixed, lambda m: F.concat(_padded(_div(m, width) + least(area), 3), _padded(_div(m % width, 10_000) + least(exchange), 3), _padded(m % 10_000, 4)))
    return _refill(text, F.concat(F.substr(d, F.lit(1), F.length(d) - 10), new))


def address(text: Column, key: str) -> Column:
    octets = F.transform(F.split(text, "[.]"), lambda o: o.cast("long"))
    number = F.aggregate(octets, F.lit(0).cast("long"), lambda t, o: t * 256 + o)
    mixed = feistel(number, F.lit(65_536), F.lit(65_536), key, F.lit("ipv4"))
    out = F.array_join(F.transform(F.array(*(F.lit(s) for s in (1 << 24, 1 << 16, 1 << 8, 1))), lambda w: (_div(mixed, w) % 256).cast("string")), ".")
    return F.when(F.forall(octets, lambda o: o <= 255), out).otherwise(text)


def social_security(text: Column, key: str) -> Column:
    area, group, serial = (F.substr(text, F.lit(a), F.lit(n)).cast("long") for a, n in ((1, 3), (5, 2), (8, 4)))
    valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    index = (area - F.when(area > 666, 2).otherwise(1)) * (99 * 9999) + (group - 1) * 9999 + serial - 1
    mixed = F.transform(F.array(feistel(index, F.lit(29_634), F.lit(29_997), key, F.lit("ssn"))), lambda m: F.concat_ws("-", _padded(_div(m, 99 * 9999) + F.when(m >= 665 * 99 * 9999, 2).otherwise(1), 3), _padded(_div(m, 9999) % 99 + 1, 2), _padded(m % 9999 + 1, 4)))
    return F.when(valid, mixed[0]).otherwise(text)


def date(text: Column, key: str) -> Column:
    """Years stand first where the fifth character is a separator; with slashes months stand before days."""
    year_first = F.substr(text, F.lit(5), F.lit(1)).isin("-", "/")
    part = lambda a, n: F.substr(text, F.lit(a), F.lit(n)).cast("int")
    day_first = text.contains(".")
    year = F.when(year_first, part(1, 4)).otherwise(part(7, 4))
    month = F.when(year_first, part(6, 2)).when(day_first, part(4, 2)).otherwise(part(1, 2))
    day = F.when(year_first, part(9, 2)).when(day_first, part(1, 2)).otherwise(part(4, 2))
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    most = F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)
    valid = year.between(1800, 2199) & month.between(1, 12) & (day >= 1) & (day <= most)
    number = (F.unix_date(F.make_date(year, month, day)) + EPOCH).cast("long")
    mixed = F.date_from_unix_date((feistel(number, F.lit(189), F.lit(773), key, F.lit("date")) - EPOCH).cast("int"))
    form = F.when(year_first, F.date_format(mixed, "yyyyMMdd")).when(day_first, F.date_format(mixed, "ddMMyyyy")).otherwise(F.date_format(mixed, "MMddyyyy"))
    return F.when(valid, _refill(text, form)).otherwise(text)


def mail(text: Column, key: str) -> Column:
    """The local part's halves are shifted in turn, each character within lower case, upper case or digits."""
    local, domain = F.substring_index(text, "@", 1), F.substring_index(text, "@", -1)
    half = F.floor(F.length(local) / 2).cast("int")

    def shifted(part: Column, other: Column, turn: Column) -> Column:
        n = F.length(part)
        digest = lambda b: F.sha2(F.concat_ws("|", F.lit(key), F.lit("mail"), n.cast("string"), b.cast("string"), turn.cast("string"), other, F.lit(key)), 256)

        def letters(digests: Column) -> Column:
            def letter(j: Column) -> Column:
                c = F.substr(part, j + 1, F.lit(1))
                by = F.conv(F.substr(digests[_div(j, AT_ONCE).cast("int")], 3 * (j % AT_ONCE) + 1, F.lit(3)), 16, 10).cast("int")
                move = lambda base, n: F.char(base + (F.ascii(c) - base + by) % n)
                return F.when(c.between("a", "z"), move(97, 26)).when(c.between("A", "Z"), move(65, 26)).when(c.between("0", "9"), move(48, 10)).otherwise(c)

            return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), letter), "")

        blocks = F.transform(F.sequence(F.lit(0), _div(n - 1, AT_ONCE).cast("int")), digest)
        return F.when(n > 0, _bound(blocks, letters)).otherwise(part)

    start = F.struct(F.substr(local, F.lit(1), half).alias("l"), F.substr(local, half + 1, F.length(local)).alias("r"))

    def turn(s: Column, i: Column) -> Column:
        return F.when(i % 2 == 0, F.struct(s["l"].alias("l"), shifted(s["r"], s["l"], i).alias("r"))).otherwise(F.struct(shifted(s["l"], s["r"], i).alias("l"), s["r"].alias("r")))

    return F.concat(F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda s: F.concat(s["l"], s["r"])), F.lit("@"), domain)


def pseudonym(text: Column, key: str) -> Column:
    """Pseudonym of one candidate."""
    return (
        F.when(text.contains("@"), mail(text, key))
        .when(text.rlike(f"^(?:{DATE})$"), date(text, key))
        .when(text.rlike(f"^(?:{IPV4})$"), address(text, key))
        .when(text.rlike(f"^(?:{SSN})$"), social_security(text, key))
        .when(text.rlike(f"^(?:{PHONE})$"), phone(text, key))
        .otherwise(card(text, key))
    )


def pseudonymise(df: DataFrame, key: str, *, text_col: str = "text", count_col: str = "n_replaced") -> DataFrame:
    """``df`` with pseudonyms in ``text_col`` and, in a last column ``count_col``, how many values were replaced."""
    parts, new, count = (common.fresh_name(df, c) for c in ("__parts", "__new", count_col))
    text = F.col(f"`{text_col}`")
    pattern = F.when(text.contains("@"), F.lit(CANDIDATE)).otherwise(F.lit(NUMBER))
    marked = F.split(F.regexp_replace(text, pattern, F.lit(f"{MARK}$0{MARK}")), MARK, -1)
    gaps, found = F.split(text, CANDIDATE, -1), F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))
    # gaps and candidates in turn
    other = F.flatten(F.zip_with(gaps, found, lambda g, e: F.when(e.isNull(), F.array(g)).otherwise(F.array(g, e))))
    cut = F.when(text.rlike("[0-9@]"), F.when(text.contains(MARK), other).otherwise(marked))
    own = F.transform(parts, lambda e, k: F.when(k % 2 == 1, pseudonym(e, key)).otherwise(e))
    changed = F.size(F.filter(F.zip_with(parts, new, lambda a, b: a != b), lambda x: x))
    kept = [F.col(f"`{c}`") if c != text_col else F.when(F.size(parts) > 1, F.array_join(new, "")).otherwise(text).alias(c) for c in df.columns]
    replaced = F.greatest(F.coalesce(changed, F.lit(0)), F.lit(0)).cast("long").alias(count)
    return df.withColumn(parts, cut).withColumn(new, F.when(F.size(parts) > 1, own)).select(*kept, replaced)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 5 over all documents."""
    docs = common.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymise(docs, "demonstration key")
