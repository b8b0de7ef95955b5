"""Format-preserving pseudonyms of personal data by keyed Feistel permutations. DataFrame functions only.

Permuted within their format, so that all places, marks and letters stay and the result is valid again:

* card-like numbers (13 to 19 digits, in one run or in the usual groups) with a valid Luhn sum, IBANs with a valid check number,
* telephone numbers: three, three and four digits, or ten in one run that follow the North American plan, or ``+``, a country code and
  further digits in groups (8 to 15 in all); the country code stays, and numbers of that plan become such numbers,
* social security numbers (area, group and serial number in use), IPv4 and IPv6 addresses,
* calendar dates: year, month, day with ``-`` or ``/``; day, month, year with ``.`` or ``/``; month, day, year with ``/`` where the other
  order gives no date; days and years around the name of a month (English, German, French, Spanish; before the day English only).

The permutation depends on the key and the kind only, so equal values get equal pseudonyms in all documents and different ones different
pseudonyms; a date is the same value in each format, but for those with the month first, which are permuted among themselves by walking the
cycles of the permutation. Mail addresses get a keyed token as local part. What fails validation (a number with a wrong check digit, an
octet over 255, 31 February) stays as it is; so do ten digits in a run that follow no plan, and addresses of one digit (``::1``).

Dates from 1900 to 2100 are permuted among themselves, so are those before and those after. Nulls stay null and empty texts empty.
Long texts are treated whole. Repeated rows give repeated results. Columns of the table named like a result replace nothing: the result has the id,
the text and the counts only. An empty table gives an empty table. The key comes as a value of a subquery, so that no plan shows it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
_FIRST = "0001-01-01"
#: (first day number, days as a product) of the years up to 1899, 1900 to 2100, and from 2101 to 9999.
_SPANS = ((0, 745, 931), (693595, 142, 517), (767009, 350, 8243))
_WALK = 200

# The shapes of personal data, names of months, and country codes of one and two digits.
MONTHS = (
    "January February March April May June July August September October November December".split(),
    "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split(),
    "Januar Februar März April Mai Juni Juli August September Oktober November Dezember".split(),
    "janvier février mars avril mai juin juillet août septembre octobre novembre décembre".split(),
    "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split(),
)
COUNTRY = r"^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
DATE = r"(?<!\d)(?<!\d[.\-/])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}/\d{1,2}/\d{4})(?!\d)(?![\-/]\d)"
_MONTH = "|".join(sorted({m for names in MONTHS for m in names}, key=lambda m: (-len(m), m)))
_FIRST_MONTH = "|".join(sorted({m for names in MONTHS[:2] for m in names}, key=lambda m: (-len(m), m)))
DAY_MONTH = rf"(\d{{1,2}})(\.? (?:de )?)({_MONTH})((?:,| de)? )(\d{{4}})"
MONTH_DAY = rf"({_FIRST_MONTH})( )(\d{{1,2}})(,? )(\d{{4}})"
DAY_MONTH_YEAR = rf"(?<![\d.])\d{{1,2}}\.? (?:de )?(?:{_MONTH})(?:,| de)? \d{{4}}(?!\d)"
MONTH_DAY_YEAR = rf"(?=[A-Z][a-z]{{2,8}} \d)(?<!\p{{L}})(?:{_FIRST_MONTH}) \d{{1,2}},? \d{{4}}(?!\d)"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: \d[A-Z0-9]{0,2})?)(?![A-Za-z0-9])"
IPV6 = r"(?<![A-Za-z0-9:.])(?=[0-9A-Fa-f:]*\d)(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}|(?:[0-9A-Fa-f]{1,4}:){1,7}:|:(?::[0-9A-Fa-f]{1,4}){1,7})(?![A-Za-z0-9:])(?!\.\d)"
IPV4 = r"(?<!\d)(?<!\d\.)\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)"
PHONE = r"(?<![\d+])(?:\+\d{1,3}[ .-]?)?\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}(?!\d)|(?<![\d+])(?<!\d[ .-])(?:\+\d{1,3}[ .-])?\d{3}[ .-]\d{3}[ .-]\d{4}(?!\d)"
ABROAD = r"(?<![\d+])\+\d{1,3}(?:[ .-]?\(?\d{1,4}\)?){2,6}(?!\d)"
TEN = r"(?<![\w.,/+-])[2-9]\d{2}[2-9]\d{6}(?![\w/-]|[.,]\d)"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
CARD = r"(?<!\d)(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}(?:[ -]\d{1,3})?|\d{4}[ -]\d{6}[ -]\d{5})(?!\d)"
#: What begins with a digit, a plus or a bracket is tried there only; the rest has gates of its own.
ANY = "|".join([f"(?=[0-9+(])(?:{'|'.join([DATE, DAY_MONTH_YEAR, IPV4, PHONE, ABROAD, SSN, CARD, TEN])})", f"(?=[A-Z][A-Z][0-9][0-9]){IBAN}", MONTH_DAY_YEAR, f"(?=[0-9A-Fa-f]{{0,4}}:){IPV6}", EMAIL])
KINDS = ("email", "date", "ipv4", "phone", "card", "iban", "ipv6", "ssn")


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, also where the body uses it in a lambda function."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _mac(key: Column | str, kind: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), *(p.cast("string") for p in parts)), 256)


def _round_value(key: Column | str, kind: str, i: Column, x: Column, modulus: Column) -> Column:
    """A keyed pseudo-random number below the modulus."""
    mac = _mac(key, kind, i, modulus, x)
    return F.conv(F.substring(mac, 1, 15), 16, 10).cast("bigint") % modulus


def feistel(a: Column, b: Column, even: Column, odd: Column, key: Column | str, kind: str) -> Column:
    """Struct (a, b): the permuted pair; a stays below ``even`` and b below ``odd`` (``ROUNDS`` is an even number)."""
    start = F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b"))

    def step(s, i):
        modulus = F.when(i % 2 == 0, even).otherwise(odd).cast("bigint")
        return F.struct(s["b"].alias("a"), ((s["a"] + _round_value(key, kind, i, s["b"], modulus)) % modulus).alias("b"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def permute_digits(digits: Column, key: Column | str, kind: str) -> Column:
    """A string of 2 to 36 digits permuted among those of its length."""
    n = F.char_length(digits)
    u = (n / 2).cast("int")
    power = lambda k: F.pow(F.lit(10.0), k).cast("bigint")
    pair = feistel(F.substr(digits, F.lit(1), u), F.substr(digits, u + 1, n - u), power(u), power(n - u), key, kind)
    return _let(pair, lambda p: F.concat(F.lpad(p["a"].cast("string"), u, F.lit("0")), F.lpad(p["b"].cast("string"), n - u, F.lit("0"))))


def luhn_sum(digits: Column, doubled: int) -> Column:
    """Luhn sum; counted from the right, digits at places with remainder ``doubled`` by 2 are doubled (the last is at place 0)."""
    places = F.sequence(F.lit(1), F.char_length(digits))

    def add(s, p):
        d = F.substr(digits, F.char_length(digits) - p + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return s + F.when((p - 1) % 2 == doubled, twice).otherwise(d)

    return F.aggregate(places, F.lit(0), add)


def permute_card(digits: Column, key: Column | str) -> Column:
    """The number without its check digit permuted, with a check digit that makes it valid."""
    body = permute_digits(F.substr(digits, F.lit(1), F.char_length(digits) - 1), key, "card")
    return _let(body, lambda x: F.concat(x, F.pmod(-luhn_sum(x, 0), F.lit(10)).cast("string")))


def _refill(shape: Column, digits: Column) -> Column:
    """The shape with its digits replaced in order."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("k"))

    def step(s, c):
        is_digit = c.between("0", "9")
        return F.struct(F.concat(s["out"], F.when(is_digit, F.substr(digits, s["k"] + 1, F.lit(1))).otherwise(c)).alias("out"), (s["k"] + is_digit.cast("int")).alias("k"))

    return F.aggregate(F.split(shape, ""), start, step, lambda s: s["out"])


def _card(m: Column, key: Column | str) -> Column:
    digits = F.regexp_replace(m, r"[^0-9]", "")
    return _let(digits, lambda d: F.when(luhn_sum(d, 1) % 10 == 0, _refill(m, permute_card(d, key))).otherwise(m))


def _in_plan(digits: Column) -> Column:
    return F.rlike(digits, F.lit(r"^[2-9]\d\d[2-9]\d{6}$"))


def _national(digits: Column, key: Column | str) -> Column:
    """Ten digits: numbers of the North American plan permuted among such, others among others."""
    pair = feistel(F.substr(digits, F.lit(1), F.lit(3)).cast("int") - 200, F.substr(digits, F.lit(4), F.lit(7)).cast("int") - 2_000_000, F.lit(800), F.lit(8_000_000), key, "phone")
    planned = _let(pair, lambda p: F.concat((p["a"] + 200).cast("string"), (p["b"] + 2_000_000).cast("string")))
    other = F.aggregate(F.sequence(F.lit(1), F.lit(_WALK)), permute_digits(digits, key, "phone"), lambda s, _: F.when(_in_plan(s), permute_digits(s, key, "phone")).otherwise(s))
    return F.when(_in_plan(digits), planned).otherwise(other)


def _phone(m: Column, key: Column | str) -> Column:
    """All but the country code is permuted."""
    digits = F.regexp_replace(m, r"[^0-9]", "")
    code = F.when(F.startswith(m, F.lit("+")), F.regexp_extract(digits, COUNTRY, 0)).otherwise(F.lit(""))

    def body(d):
        rest, n = d["rest"], F.char_length(d["rest"])
        new = F.when(n == 10, _national(rest, key)).otherwise(permute_digits(rest, key, "phone"))
        return F.when((n >= 4) & (n + F.char_length(d["code"])).between(8, 15), _refill(m, F.concat(d["code"], new))).otherwise(m)

    return _let(F.struct(code.alias("code"), F.substr(digits, F.char_length(code) + 1, F.char_length(digits)).alias("rest")), body)


def _ipv4(m: Column, key: Column | str) -> Column:
    o = F.transform(F.split(m, r"\."), lambda x: x.cast("int"))

    def body(v):
        pair = feistel(F.get(v, F.lit(0)) * 256 + F.get(v, F.lit(1)), F.get(v, F.lit(2)) * 256 + F.get(v, F.lit(3)), F.lit(65536), F.lit(65536), key, "ipv4")
        text = _let(pair, lambda p: F.concat_ws(".", *((F.floor(p[h] / 256) if k == 0 else p[h] % 256).cast("string") for h in ("a", "b") for k in (0, 1))))
        return F.when(F.forall(v, lambda x: x <= 255), text).otherwise(m)

    return _let(o, body)


def _nibbles(hexed: Column, key: Column | str) -> Column:
    """A string of 2 to 32 lower-case hexadecimal digits permuted among those of its length."""
    n = F.char_length(hexed)
    u = (n / 2).cast("int")

    def bits(x):
        return F.conv(x, 16, -10).cast("bigint")

    def step(s, i):
        width = F.when(i % 2 == 0, u).otherwise(n - u)
        mac = F.substr(_mac(key, "ipv6", i, n, s["b"]), F.lit(1), width)
        return F.struct(s["b"].alias("a"), s["a"].bitwiseXOR(bits(mac)).alias("b"))

    start = F.struct(bits(F.substr(hexed, F.lit(1), u)).alias("a"), bits(F.substr(hexed, u + 1, n - u)).alias("b"))
    pair = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)
    return _let(pair, lambda p: F.lower(F.concat(F.lpad(F.hex(p["a"]), u, F.lit("0")), F.lpad(F.hex(p["b"]), n - u, F.lit("0")))))


def _ipv6(m: Column, key: Column | str) -> Column:
    """The written digits are permuted; colons stay, and letters are lower-case unless all of the address's are upper-case."""
    hexed = F.lower(F.regexp_replace(m, r"[^0-9A-Fa-f]", ""))
    low = _refill(F.regexp_replace(m, "[A-Fa-f]", "0"), _nibbles(hexed, key))
    shown = F.when((F.upper(m) == m) & (F.lower(m) != m), F.upper(low)).otherwise(low)
    groups = F.size(F.filter(F.split(m, ":"), lambda x: x != ""))
    return F.when((F.char_length(hexed) >= 2) & ((groups <= 7) | ~F.contains(m, F.lit("::"))), shown).otherwise(m)


def _ssn(m: Column, key: Column | str) -> Column:
    area, group, serial = (F.get(F.split(m, "-"), F.lit(k)).cast("int") for k in range(3))
    used = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    pair = feistel(area - F.when(area > 666, 2).otherwise(1), (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999), key, "ssn")

    def text(p):
        number = p["a"] + F.when(p["a"] >= 665, 2).otherwise(1)
        return F.concat_ws("-", *(F.lpad(x.cast("string"), n, "0") for x, n in ((number, 3), (F.floor(p["b"] / 9999) + 1, 2), (p["b"] % 9999 + 1, 4))))

    return F.when(used, _let(pair, text)).otherwise(m)


def _mod97(chars: Column) -> Column:
    """A string of digits and capitals, which count from 10 for A, as a number modulo 97."""
    return F.aggregate(F.split(chars, ""), F.lit(0), lambda r, c: F.when(c == "", r).when(c.between("0", "9"), (r * 10 + c.try_cast("int")) % 97).otherwise((r * 100 + F.ascii(c) - 55) % 97))


def _iban(m: Column, key: Column | str) -> Column:
    whole = F.replace(m, F.lit(" "), F.lit(""))
    size = F.char_length(whole)

    def body(w):
        rest, check = F.substr(w, F.lit(5), F.char_length(w)), F.substr(w, F.lit(3), F.lit(2))
        digits = F.regexp_replace(rest, "[^0-9]", "")
        valid = (size <= 34) & check.between("02", "98") & (F.char_length(digits) >= 2) & (_mod97(F.concat(rest, F.substr(w, F.lit(1), F.lit(4)))) == 1)

        def text(new):
            number = 98 - _mod97(F.concat(_refill(rest, new), F.substr(w, F.lit(1), F.lit(2)), F.lit("00")))
            return _refill(m, F.concat(F.lpad(number.cast("string"), 2, "0"), new))

        return F.when(valid, _let(permute_digits(digits, key, "iban"), text)).otherwise(m)

    return _let(whole, body)


def _day_number(iso: Column) -> Column:
    return F.date_diff(F.try_to_date(iso, "yyyy-MM-dd"), F.lit(_FIRST).cast("date"))


def _date_of(day: Column) -> Column:
    return F.date_add(F.lit(_FIRST).cast("date"), day.cast("int"))


def _permute_day(day: Column, key: Column | str) -> Column:
    """A day number permuted within its span of years; null outside of all."""
    out = F.lit(None).cast("bigint")

    def number(first, b):
        return lambda p: p["a"] * b + p["b"] + first

    for first, a, b in _SPANS:
        x = day - first
        pair = feistel(F.floor(x / b), x % b, F.lit(a), F.lit(b), key, "date")
        out = F.when(x.between(0, a * b - 1), _let(pair, number(first, b))).otherwise(out)
    return out


def _numeric_date(m: Column, key: Column | str) -> Column:
    p = F.split(m, r"[./-]")
    one, two, three = (F.get(p, F.lit(k)) for k in range(3))
    year_first = F.char_length(one) == 4
    two_digits = lambda x: F.lpad(x, 2, "0")
    mark = F.when(F.contains(m, F.lit("/")), "/").when(F.contains(m, F.lit(".")), ".").otherwise("-")
    padded = (F.char_length(one) == 2) & (F.char_length(two) == 2)
    d, mo = F.when(padded, "dd").otherwise("d"), F.when(padded, "MM").otherwise("M")
    usual = _day_number(F.when(year_first, F.concat_ws("-", one, two, three)).otherwise(F.concat_ws("-", three, two_digits(two), two_digits(one))))
    swapped = F.when(~year_first & (mark == "/"), _day_number(F.concat_ws("-", three, two_digits(one), two_digits(two))))

    def body(s):
        straight = _permute_day(s["usual"], key)
        walked = F.aggregate(F.sequence(F.lit(1), F.lit(_WALK)), _permute_day(s["swapped"], key), lambda x, _: F.when(F.day(_date_of(x)) <= 12, _permute_day(x, key)).otherwise(x))
        join = lambda *x: F.concat(x[0], mark, x[1], mark, x[2])
        usual_form = F.when(year_first, join(F.lit("yyyy"), F.lit("MM"), F.lit("dd"))).otherwise(join(d, mo, F.lit("yyyy")))
        show = lambda day, form: F.call_function("date_format", _date_of(day), form)
        return F.when(s["usual"].isNotNull(), show(straight, usual_form)).when(s["swapped"].isNotNull(), show(walked, join(mo, d, F.lit("yyyy")))).otherwise(m)

    return F.coalesce(_let(F.struct(usual.alias("usual"), swapped.alias("swapped")), body), m)


def _named_date(m: Column, key: Column | str) -> Column:
    day_first = F.rlike(m, F.lit(r"^\d"))
    part = lambda k, j: F.when(day_first, F.regexp_extract(m, f"^{DAY_MONTH}$", k)).otherwise(F.regexp_extract(m, f"^{MONTH_DAY}$", j))
    names = F.array(*(F.lit(x) for month in MONTHS for x in month))
    fields = F.struct(part(1, 3).alias("day"), F.array_position(names, part(3, 1)).cast("int").alias("at"), part(5, 5).alias("year"), part(2, 2).alias("s"), part(4, 4).alias("t"))

    def body(x):
        iso = F.concat_ws("-", x["year"], F.lpad(((x["at"] - 1) % 12 + 1).cast("string"), 2, "0"), F.lpad(x["day"], 2, "0"))

        def text(day):
            new = _date_of(day)
            month = F.get(names, (x["at"] - 1 - (x["at"] - 1) % 12 + F.month(new) - 1).cast("int"))
            number = F.when(F.startswith(x["day"], F.lit("0")), F.lpad(F.day(new).cast("string"), 2, "0")).otherwise(F.day(new).cast("string"))
            year = F.lpad(F.year(new).cast("string"), 4, "0")
            return F.when(day_first, F.concat(number, x["s"], month, x["t"], year)).otherwise(F.concat(month, x["s"], number, x["t"], year))

        return F.when(_day_number(iso).isNotNull(), _let(_permute_day(_day_number(iso), key), text))

    return F.coalesce(_let(fields, body), m)


def _email(m: Column, key: Column | str) -> Column:
    token = F.substring(F.sha2(F.concat(F.lit(key), F.lit("|email|"), F.lower(m)), 256), 1, 12)
    return F.concat(F.lit("u"), token, F.lit("@"), F.substring_index(m, "@", -1))


def _shape(m: Column) -> Column:
    """The kind of a match, where dates with a month's name are a kind of their own."""
    return (
        F.when(F.contains(m, F.lit("@")), "email")
        .when(F.contains(m, F.lit(":")), "ipv6")
        .when(F.rlike(m, F.lit(r"^[A-Z]{2}\d{2}")), "iban")
        .when(F.rlike(m, F.lit(r"\p{L}")), "named date")
        .when(F.rlike(m, F.lit(r"^\d+(\.\d+){3}$")), "ipv4")
        .when(F.rlike(m, F.lit(f"^(?:{DATE})$")), "date")
        .when(F.rlike(m, F.lit(r"^\d{3}-\d{2}-\d{4}$")), "ssn")
        .when(F.rlike(m, F.lit(r"^[+(]|^\d{3}[ .-]\d{3}[ .-]\d{4}$|^\d{10}$")), "phone")
        .otherwise("card")
    )


def kind_of(m: Column) -> Column:
    return _let(_shape(m), lambda k: F.when(k == "named date", "date").otherwise(k))


def pseudonym(m: Column, key: Column | str) -> Column:
    ways = {"email": _email, "date": _numeric_date, "named date": _named_date, "iban": _iban, "ipv6": _ipv6, "ipv4": _ipv4, "phone": _phone, "ssn": _ssn}

    def body(kind):
        out = _card(m, key)
        for name, way in ways.items():
            out = F.when(kind == name, way(m, key)).otherwise(out)
        return out

    return _let(_shape(m), body)


def _is(kind: str):
    return lambda k: k == kind


def pseudonymise(df: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, n_<kind> ...) of each row: the text with its personal data replaced, and how many of each kind were."""
    secret = df.sparkSession.sql("SELECT k FROM VALUES (:k) AS t(k)", args={"k": key}).scalar()
    d = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).withColumn("_key", secret)
    d = d.withColumn("_m", F.when(F.rlike("_t", F.lit("[0-9@]")), F.regexp_extract_all("_t", F.lit(ANY), 0)))
    d = d.withColumn("_p", F.when(F.size("_m") > 0, F.transform("_m", lambda m: F.struct(pseudonym(m, F.col("_key")).alias("new"), m.alias("old"), kind_of(m).alias("kind")))))
    pieces = F.split("_t", ANY)
    # a text is its pieces with the replacements between them; the last piece has none after it
    whole = F.array_join(F.zip_with(pieces, F.concat(F.transform("_p", lambda x: x["new"]), F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    changed = F.filter(F.coalesce("_p", F.array()), lambda x: x["new"] != x["old"])
    d = d.select("_id", F.when(F.size("_m") > 0, whole).otherwise(F.col("_t")).alias("_t"), F.transform(changed, lambda x: x["kind"]).alias("_k"))
    return d.select(F.col("_id").alias(id_col), F.col("_t").alias(text_col), *(F.size(F.filter("_k", _is(kind))).cast("bigint").alias(f"n_{kind}") for kind in KINDS))
