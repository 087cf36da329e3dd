"""Format-preserving Feistel pseudonyms for personal data, in DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed patterns of what is looked for. Each begins where no longer number or name could.
EMAIL = r"(?<![\w.+%-])[A-Za-z0-9][\w.+%-]*+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++){1,126}+"  # as many labels as a name may have, so that matching needs bounded stack
IP = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\d]|\.\d)"
PHONE = r"(?<![\w(])(?:(?:(?:\+?1[ .-]?)?\(\d{3}\) ?|\+1[ .-]?\d{3}[ .-])\d{3}|(?:1[ .-]?)?[2-9]\d\d[ .-][2-9]\d\d)[ .-]\d{4}(?!\w)"
SSN = r"(?<![\w-])(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}(?![\w-])"
CARD = r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-])"
DATE = r"(?<![\w-])(?:19|20)\d\d-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])(?![\w-])"
SECRET = r"(?i:(?<=password=)|(?<=passwd=)|(?<=token = \x22)|(?<=token=)|(?<=secret=)|(?<=api_key=))[A-Za-z0-9]{6,}"
#: In this order, as the first that matches at a place is taken.
KINDS = {"email": EMAIL, "secret": SECRET, "ip": IP, "date": DATE, "ssn": SSN, "phone": PHONE, "card": CARD}
ANY = "|".join(f"(?:{p})" for p in KINDS.values())

#: Dates are permuted among this many days from 1900-01-01, as two digits of these radices.
FIRST_DAY, RADICES = "1900-01-01", (250, 292)
STATE = "struct<a: array<int>, b: array<int>, ra: array<int>, rb: array<int>>"


def let(value: Column, use) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def feistel(values: Column, radices: Column, key: Column, rounds: int = 8) -> Column:
    """A keyed permutation of the arrays of digits below `radices`, digit by digit.

    The array is cut in two; in each round one half is shifted, each digit modulo its own radix, by digits of a
    SHA-256 of the key, the round and the other half, and the halves change places. Radix 1 keeps a place as it is.
    """
    cut = F.floor(F.size(values) / 2).cast("int")
    left, right = (lambda x: F.slice(x, F.lit(1), cut)), (lambda x: F.slice(x, cut + 1, F.size(values) - cut))
    start = F.struct(left(values).alias("a"), right(values).alias("b"), left(radices).alias("ra"), right(radices).alias("rb")).cast(STATE)

    def turn(s: Column, i: Column) -> Column:
        stream = F.sha2(F.concat_ws("|", key, i.cast("string"), F.array_join(s["b"].cast("array<string>"), ",")).cast("binary"), 256)
        shift = lambda hexes, j: F.conv(F.substring(hexes, F.pmod(j * 5, F.lit(60)) + 1, 5), 16, 10).cast("int")
        moved = let(stream, lambda hexes: F.transform(s["a"], lambda v, j: F.pmod(v + shift(hexes, j), F.element_at(s["ra"], j + 1))))
        return F.struct(s["b"].alias("a"), moved.alias("b"), s["rb"].alias("ra"), s["ra"].alias("rb")).cast(STATE)

    # an even number of rounds leaves the halves in place
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, turn, lambda s: F.concat(s["a"], s["b"]))


def _letters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _shuffled(text: Column, key: Column, alphabets: tuple[str, ...]) -> Column:
    """Each character permuted within the first alphabet that has it; others stay."""
    chars = _letters(text)

    def pick(c: Column, get) -> Column:
        out = F
        for a in alphabets:
            hit = F.position(c, F.lit(a))
            out = out.when(hit > 0, get(a, hit))
        return out.otherwise(get("", F.lit(1)))

    values = F.transform(chars, lambda c: pick(c, lambda a, hit: (hit - 1).cast("int")))
    radices = F.transform(chars, lambda c: pick(c, lambda a, hit: F.lit(max(1, len(a)))))
    new = feistel(values, radices, key)
    zipped = F.zip_with(chars, new, lambda c, v: pick(c, lambda a, hit: F.substr(F.lit(a), v + 1, F.lit(1)) if a else c))
    return F.array_join(zipped, "")


def _checked(digits: Column) -> Column:
    """Whether the Luhn sum of a string of digits is a multiple of ten."""
    turned = F.transform(_letters(F.reverse(digits)), lambda c: c.cast("int"))
    parts = F.transform(turned, lambda d, i: F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0)))
    return F.aggregate(parts, F.lit(0), lambda s, d: s + d) % 10 == 0


def _card(text: Column, key: Column) -> Column:
    """All digits but the last are permuted, and the last made to fit again; separators stay where they are."""
    digits = F.regexp_replace(text, "[ -]", "")
    head = _shuffled(F.substr(digits, F.lit(1), F.length(digits) - 1), key, ("0123456789",))
    tried = lambda h: F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: F.concat(h, d.cast("string")))
    new = F.element_at(F.filter(let(head, tried), _checked), 1)
    before = lambda i: F.length(F.regexp_replace(F.substr(text, F.lit(1), i), "[ -]", ""))
    back = lambda n: F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.when(F.substr(text, i, F.lit(1)).isin(" ", "-"), F.substr(text, i, F.lit(1))).otherwise(F.substr(n, before(i), F.lit(1))))
    return F.array_join(let(new, back), "")


def _numbers(values: list[Column], radices: list[int | Column], key: Column) -> Column:
    return feistel(F.array(*values), F.array(*(F.lit(r) for r in radices)), key)


def _ip(text: Column, key: Column) -> Column:
    octets = F.transform(F.split(text, r"\."), lambda x: x.cast("int"))
    return F.array_join(feistel(octets, F.transform(octets, lambda _: F.lit(256)), key).cast("array<string>"), ".")


def _ssn(text: Column, key: Column) -> Column:
    """Areas 001 to 899 without 666, groups 01 to 99, serials 0001 to 9999."""
    parts = F.transform(F.split(text, "-"), lambda x: x.cast("int"))
    area = parts[0] - 1 - F.when(parts[0] > 666, 1).otherwise(0)

    def told(new: Column) -> Column:
        area = new[0] + 1 + F.when(new[0] + 1 >= 666, 1).otherwise(0)
        return F.concat_ws("-", F.lpad(area.cast("string"), 3, "0"), F.lpad((new[1] + 1).cast("string"), 2, "0"), F.lpad((new[2] + 1).cast("string"), 4, "0"))

    return let(_numbers([area, parts[1] - 1, parts[2] - 1], [898, 99, 9999], key), told)


def _phone(text: Column, key: Column) -> Column:
    """The ten digits are permuted, those that begin area and exchange within 0 to 1 or 2 to 9; all else stays.

    The network sees the digits alone, so that one number is one pseudonym in every format.
    """
    lead = F.regexp_extract(text, r"^(?:\+?1[ .-]?)?", 0)
    rest = F.substr(text, F.length(lead) + 1, F.length(text))
    chars = _letters(F.regexp_replace(rest, r"\D", ""))
    first = lambda i: i.isin(0, 3)
    high = lambda c, i: first(i) & ~c.isin("0", "1")
    values = F.transform(chars, lambda c, i: c.cast("int") - F.when(high(c, i), 2).otherwise(0))
    radices = F.transform(chars, lambda c, i: F.when(high(c, i), 8).when(first(i), 2).otherwise(10))
    told = lambda new: F.zip_with(chars, F.transform(new, lambda v, i: F.struct(v.alias("v"), i.alias("i"))), lambda c, n: (n["v"] + F.when(high(c, n["i"]), 2).otherwise(0)).cast("string"))
    nth = lambda i: F.length(F.regexp_replace(F.substr(rest, F.lit(1), i + 1), r"\D", ""))
    out = lambda new: F.transform(_letters(rest), lambda c, i: F.when(c.rlike("[0-9]"), F.element_at(new, nth(i))).otherwise(c))
    return F.concat(lead, F.array_join(let(let(feistel(values, radices, key), told), out), ""))


def _date(text: Column, key: Column) -> Column:
    """Days from FIRST_DAY are permuted; what is no date, or outside, stays."""
    high, low = RADICES
    day = F.date_diff(F.try_to_date(text), F.lit(FIRST_DAY).cast("date"))
    told = lambda new: F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), new[0] * low + new[1]), "yyyy-MM-dd")
    return F.when((day >= 0) & (day < high * low), let(_numbers([F.floor(day / low).cast("int"), (day % low).cast("int")], [high, low], key), told)).otherwise(text)


def pseudonym(found: Column, key: str = "fringelake") -> Column:
    """The pseudonym of one match of ANY; equal matches have equal ones, different matches different ones."""
    of = lambda kind: F.lit(f"{key}|{kind}")
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    name = F.substring_index(found, "@", 1)
    whole = lambda p: found.rlike(f"^(?:{p})$")
    secret = F.when(found.rlike("^[0-9a-f]+$"), _shuffled(found, of("hex"), (digits + "abcdef",))).otherwise(_shuffled(found, of("secret"), (lower, upper, digits)))
    return (
        F.when(found.contains("@"), F.concat(_shuffled(name, of("email"), (lower, upper, digits)), F.substr(found, F.length(name) + 1, F.length(found))))
        .when(whole(IP), _ip(found, of("ip")))
        .when(whole(DATE), _date(found, of("date")))
        .when(whole(SSN), _ssn(found, of("ssn")))
        .when(whole(PHONE), _phone(found, of("phone")))
        .when(whole(CARD) & _checked(F.regexp_replace(found, "[^0-9]", "")), _card(found, of("card")))
        .when(whole(CARD), found)
        .otherwise(secret)
    )


def pseudonymise(docs: DataFrame, key: str = "fringelake") -> DataFrame:
    """Every row of `docs`, all columns, with personal data in text replaced; and n_replaced (long).

    E-mail addresses (the name part), IPv4 addresses, North American phone and social security numbers, dates, card
    numbers with a right check digit, and values of passwords and tokens are permuted by a keyed Feistel network within
    their own format: a card passes its check again, an address stays an address, and the same value becomes the same
    pseudonym in every document. A phone number with brackets or +1 may have any area code and exchange; a bare one needs
    both to begin with 2 to 9. Numbers that fail validation stay as they are. `key` is a secret to be given in use.

    The text is cut at the matches and put together again in one pass, so a pseudonym is never replaced a second time.
    Texts without a match, empty and null ones pass unchanged with n_replaced 0; very long ones are read whole. Rows are worked on one by one: ties,
    repeated rows and empty tables need nothing special. A column named n_replaced is replaced.
    """
    rest = [c for c in docs.columns if c != "n_replaced"]
    held = F.col("text").rlike("[0-9@=]") & F.col("text").rlike(ANY)  # every kind needs one of these, and most texts have none
    out = docs.select(*rest, F.when(held, F.regexp_extract_all("text", F.lit(ANY), F.lit(0))).alias("__found"))
    out = out.select(*rest, "__found", F.transform("__found", lambda m: pseudonym(m, key)).alias("__new"))
    parts = F.split("text", ANY, -1)
    joined = F.array_join(F.zip_with(parts, F.concat("__new", F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    text = F.when(F.col("__new").isNull(), F.col("text")).otherwise(joined).alias("text")
    count = F.size(F.filter(F.arrays_zip("__found", "__new"), lambda z: z["__found"] != z["__new"]))
    return out.select(*(text if c == "text" else F.col(c) for c in rest), F.when(F.col("__new").isNull(), 0).otherwise(count).cast("long").alias("n_replaced"))
