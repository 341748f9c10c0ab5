"""Format-preserving pseudonyms for private numbers, dates, addresses and secrets. DataFrame functions only.

One pattern finds candidates in the whole text; each is validated by its kind, and what is not valid stays:

card    13 to 19 digits of a card issuer's range       same issuer, Luhn sum right again; if a candidate is no card, the longest
        with a right Luhn sum                          piece between separators that is one, the first of equals
iban    country, mod-97 sum right                      same country, sum right again; the longest part up to a space that is one
phone   7 to 15 digits, with + or in a national form   same country code
ssn     ddd-dd-dddd, no part of zeros only             another such number
ip      four numbers of at most 255                    another such address
date    yyyy-mm-dd, dd.mm.yyyy, dd/mm/yyyy, mm/dd/yyyy of 1800 to 2199   another such day, same layout
email   name and domain                                same layout, same top-level domain
secret  the value after token =, password: and the like, or 32 to 64 hex digits   same layout

Digits are permuted apart from their separators, so a number has one pseudonym in all its layouts, and the pseudonym has the
value's own layout. A candidate that is not valid is searched again for the kinds that come later: a card beside what looks like
the head of an IBAN is found.

A pseudonym is a keyed permutation, so equal values get equal pseudonyms in all documents and different ones different
pseudonyms, and who has the key can undo it. It is an alternating Feistel network of ROUNDS rounds: one half of the value is
moved by a stream drawn by SHA-512 from the key, the round and the other half; each character moves within its own kind
(digits, small letters, capitals), a day or an address within its numbers (189 x 773 days are the 400 years; 65,536 x 65,536).

Cases: null texts stay null, empty ones empty; texts without candidates are not touched; a text of any length is searched
whole; repeated rows give equal rows; other columns pass through, and columns of the output's names are replaced.
"""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import fresh

ROUNDS = 8
#: A derived key begins so in plans, where REDACTION hides it.
KEY_MARK = "pii-key-"
REDACTION = "spark.sql.redaction.string.regex"

_SECRET_NAME = r"(?i:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key|private[_-]?key)"
#: The patterns of each kind, in the order in which they are tried. A run of characters is entered at its beginning only, so a search is linear.
#: What repeats without a bound is one character wide (or possessive): the engine repeats that in a loop, anything else in recursion.
KINDS = {
    "secret": rf"(?<![A-Za-z0-9]){_SECRET_NAME}[\"']?\s{{0,3}}[=:]\s{{0,3}}[\"']?[A-Za-z0-9+/_-]{{8,}}+|(?<![A-Za-z0-9])(?:[0-9a-f]{{32,64}}|[0-9A-F]{{32,64}})(?![A-Za-z0-9])",
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-](?:(?!\.\.)[A-Za-z0-9.-])*\.[A-Za-z]{2,}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9]|[/.-][0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])",
    "phone": r"(?<![0-9A-Za-z+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){1,4}(?![0-9])|(?<![0-9])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])|(?<![0-9.-])[0-9]{3}([.-])[0-9]{3}\1[0-9]{4}(?![0-9]|[.-][0-9])",
    "card": r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])",
}
#: Country calling codes, and the issuer ranges of payment cards with their lengths.
CALLING_CODE = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
ISSUERS = (
    "4(?:[0-9]{12}|[0-9]{15}|[0-9]{18})",
    "5[1-5][0-9]{14}",
    "2(?:22[1-9]|2[3-9][0-9]|[3-6][0-9]{2}|7[01][0-9]|720)[0-9]{12}",
    "3[47][0-9]{13}",
    "3(?:0[0-5]|[689][0-9])[0-9]{11}",
    "35(?:2[89]|[3-8][0-9])[0-9]{12}",
    "6(?:011|4[4-9][0-9]|5[0-9]{2})[0-9]{12,15}",
    "62[0-9]{14,17}",
    "(?:50(?:18|20|38)|5[6-8][0-9]{2}|6304|6759|676[1-3]|639[0-9])[0-9]{9,15}",
)


def _either(kinds) -> str:
    return "|".join(f"(?:{KINDS[k]})" for k in kinds)


PATTERN = _either(KINDS)
#: What a candidate that is no IBAN is searched for.
LATER = ("ip", "date", "ssn", "phone", "card")
#: The 400 years of days, from DAY_ZERO on.
DAYS, DAY_ZERO = (189, 773), "1800-01-01"


def _each(n: Column, f) -> Column:
    """f of 1 to n, as an array; empty for 0."""
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), f)).otherwise(F.array().cast("array<string>"))


def _moved(c: Column, by: Column) -> Column:
    """A character moved within its kind; others stay."""
    code = F.ascii(c)

    def within(first: int, size: int) -> Column:
        return F.char(first + F.pmod(code - first + by, F.lit(size)))

    return F.when(code.between(48, 57), within(48, 10)).when(code.between(97, 122), within(97, 26)).when(code.between(65, 90), within(65, 26)).otherwise(c)


def _hex_moved(c: Column, by: Column) -> Column:
    """As _moved, with letters among the six of hex digits."""
    code = F.ascii(c)
    return F.when(code.between(97, 102), F.char(97 + F.pmod(code - 97 + by, F.lit(6)))).when(code.between(65, 70), F.char(65 + F.pmod(code - 65 + by, F.lit(6)))).otherwise(_moved(c, by))


def _drawn(key: str, round_: Column, other: Column, block: Column | None = None) -> Column:
    """128 hex digits; longer streams take one block for each 64 characters."""
    at = [] if block is None else [block.cast("string"), F.lit(":")]
    return F.sha2(F.concat(F.lit(f"{key}:"), round_.cast("string"), F.lit(":"), *at, other), 512)


def permuted(value: Column, key: str, moved=_moved, sign: int = 1) -> Column:
    """The Feistel network over a text; sign -1 undoes it."""

    def half(x: Column, other: Column, round_: Column) -> Column:
        # 64 characters and their part of the stream at a time, so that each part is drawn once.
        block = lambda b: F.struct(F.substring(x, b * 64 + 1, F.lit(64)).alias("x"), _drawn(key, round_, other, b).alias("s"))
        step = lambda t, i: moved(F.substring(t["x"], i, F.lit(1)), sign * F.conv(F.substring(t["s"], i * 2 - 1, F.lit(2)), 16, 10).cast("int"))
        last = F.greatest(F.ceil(F.length(x) / 64), F.lit(1)).cast("int") - 1
        return F.array_join(F.transform(F.transform(F.sequence(F.lit(0), last), block), lambda t: F.array_join(_each(F.length(t["x"]), lambda i: step(t, i)), "")), "")

    def step(a: Column, i: Column) -> Column:
        even = i % 2 == 0
        left = F.when(even, half(a["l"], a["r"], i)).otherwise(a["l"])
        right = F.when(even, a["r"]).otherwise(half(a["r"], a["l"], i))
        return F.struct(left.alias("l"), right.alias("r"))

    cut = F.floor(F.length(value) / 2).cast("int")
    start = F.struct(F.substring(value, F.lit(1), cut).alias("l"), F.substring(value, cut + 1, F.length(value)).alias("r"))
    rounds = list(range(ROUNDS)) if sign > 0 else list(range(ROUNDS - 1, -1, -1))
    return F.aggregate(F.array(*map(F.lit, rounds)), start, step, lambda a: F.concat(a["l"], a["r"]))


def permuted_number(n: Column, sizes: tuple[int, int], key: str, sign: int = 1) -> Column:
    """The Feistel network over the numbers below the product of two sizes."""

    def draw(other: Column, round_: Column) -> Column:
        return sign * F.conv(F.substring(_drawn(key, round_, other.cast("string")), 1, 12), 16, 10).cast("long")

    def step(a: Column, i: Column) -> Column:
        even = i % 2 == 0
        left = F.when(even, F.pmod(a["l"] + draw(a["r"], i), F.lit(sizes[0]))).otherwise(a["l"])
        right = F.when(even, a["r"]).otherwise(F.pmod(a["r"] + draw(a["l"], i), F.lit(sizes[1])))
        return F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

    start = F.struct(F.floor(n / sizes[1]).cast("long").alias("l"), F.pmod(n, F.lit(sizes[1])).cast("long").alias("r"))
    rounds = list(range(ROUNDS)) if sign > 0 else list(range(ROUNDS - 1, -1, -1))
    return F.aggregate(F.array(*map(F.lit, rounds)), start, step, lambda a: a["l"] * sizes[1] + a["r"])


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """The Luhn sum, the last digit counting once."""
    n = F.length(digits)

    def add(a: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
        return a + F.when((n - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), add)


def _laid_out(v: Column, new: Column) -> Column:
    """The letters and digits of `new` in the places of those of v, which has as many."""
    bare = lambda i: F.length(F.regexp_replace(F.substring(v, F.lit(1), i), "[^0-9A-Za-z]", ""))
    each = _each(F.length(v), lambda i: F.when(F.substring(v, i, F.lit(1)).rlike("[0-9A-Za-z]"), F.substring(new, bare(i), F.lit(1))).otherwise(F.substring(v, i, F.lit(1))))
    return F.array_join(each, "")


def _once(value: Column, f) -> Column:
    """f of a value that is computed once."""
    return F.aggregate(F.array(value), F.lit(""), lambda _, x: f(x))


def _is_card(digits: Column) -> Column:
    return digits.rlike(f"^(?:{'|'.join(ISSUERS)})$") & (_luhn(digits) % 10 == 0)


def _card(v: Column, key: str) -> Column:
    """The digits between the issuer's and the last are permuted; the last makes the sum right."""
    digits = _digits(v)
    head = F.when(digits.startswith("4"), 1).otherwise(4)
    body = F.concat(F.substring(digits, F.lit(1), head), permuted(F.substring(digits, head + 1, F.length(digits) - head - 1), f"{key}:card"))
    return _once(body, lambda b: _laid_out(v, F.concat(b, F.pmod(-_luhn(F.concat(b, F.lit("0"))), F.lit(10)).cast("string"))))


def _card_within(v: Column, key: str) -> Column:
    """The candidate with its longest valid piece replaced; itself if it has none. Pieces begin and end at separators."""
    at = F.sequence(F.lit(1), F.length(v))
    split = lambda p: F.substring(v, p, F.lit(1)).isin(" ", "-")
    begins = F.filter(at, lambda p: ~split(p) & ((p == 1) | split(p - 1)))
    ends = F.filter(at, lambda p: ~split(p) & ((p == F.length(v)) | split(p + 1)))
    pieces = F.flatten(F.transform(begins, lambda p: F.transform(ends, lambda e: F.struct((e - p + 1).alias("n"), (-p).alias("p")))))
    piece = lambda x: F.substring(v, -x["p"], x["n"])
    valid = F.filter(pieces, lambda x: F.when(x["n"] >= 13, _is_card(_digits(piece(x)))).otherwise(F.lit(False)))
    longest = F.array_max(F.transform(valid, lambda x: F.struct(F.length(_digits(piece(x))).alias("size"), x["p"].alias("p"), x["n"].alias("n"))))
    put = lambda x: F.concat(F.substring(v, F.lit(1), -x["p"] - 1), _card(piece(x), key), F.substring(v, x["n"] - x["p"], F.length(v)))
    return F.aggregate(F.array(longest), v, lambda a, x: F.when(x.isNull(), a).otherwise(put(x)))


def _mod97(v: Column) -> Column:
    """The IBAN sum of a value without spaces: its first four characters last, letters as 10 to 35."""
    turned = F.concat(F.substring(v, F.lit(5), F.length(v)), F.substring(v, 1, 4))

    def add(a: Column, i: Column) -> Column:
        code = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(code < 65, a * 10 + code - 48).otherwise(a * 100 + code - 55) % 97

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(v), F.lit(1))), F.lit(0), add)


def _iban(v: Column, key: str) -> Column:
    flat = F.replace(v, F.lit(" "), F.lit(""))
    country = F.substring(flat, 1, 2)
    sum_ = lambda b: F.lpad((98 - _mod97(F.concat(country, F.lit("00"), b))).cast("string"), 2, "0")
    return _once(permuted(F.substring(flat, F.lit(5), F.length(flat)), f"{key}:iban"), lambda b: _laid_out(v, F.concat(country, sum_(b), b)))


def _ssn(v: Column, key: str) -> Column:
    """Permuted again while a part is of zeros only; that walks the permutation's cycle."""
    zeros = "^000|^...00|0000$"
    return _laid_out(v, F.aggregate(F.array(*map(F.lit, range(8))), _digits(v), lambda a, i: F.when((i > 0) & ~a.rlike(zeros), a).otherwise(permuted(a, f"{key}:ssn"))))


def _phone(v: Column, key: str) -> Column:
    """The digits after the country code are permuted."""
    digits = F.regexp_replace(v, "[^0-9+]", "")
    return _laid_out(v, F.replace(_after(digits, rf"(?:{CALLING_CODE})?", "phone", key), F.lit("+"), F.lit("")))


def _ip_number(v: Column) -> Column:
    return F.aggregate(F.split(v, r"\."), F.lit(0).cast("long"), lambda a, x: a * 256 + x.cast("long"))


def _ip(v: Column, key: str) -> Column:
    new = F.array(permuted_number(_ip_number(v), (65_536, 65_536), f"{key}:ip"))
    part = lambda n, shift: F.pmod(F.shiftright(n, shift), F.lit(256)).cast("string")
    return F.aggregate(new, F.lit(""), lambda _, n: F.concat_ws(".", part(n, 24), part(n, 16), part(n, 8), part(n, 0)))


_DATE_FORMATS = ("yyyy-MM-dd", "dd.MM.yyyy", "dd/MM/yyyy", "MM/dd/yyyy")


def _days(v: Column, fmt: str) -> Column:
    """Days since DAY_ZERO, null if it is no such date."""
    n = F.datediff(F.try_to_timestamp(v, F.lit(fmt)).cast("date"), F.lit(DAY_ZERO).cast("date"))
    return F.when(n.between(0, DAYS[0] * DAYS[1] - 1), n.cast("long"))


def _date_format(v: Column) -> Column:
    """The format in which v is a day; null if it is none."""
    found = F.lit(None).cast("string")
    for fmt in reversed(_DATE_FORMATS):
        found = F.when(_days(v, fmt).isNotNull(), fmt).otherwise(found)
    return found


def _date(v: Column, key: str) -> Column:
    days = F.coalesce(*(_days(v, f) for f in _DATE_FORMATS))
    new = F.date_add(F.lit(DAY_ZERO).cast("date"), permuted_number(days, DAYS, f"{key}:date").cast("int"))
    return F.call_function("date_format", new.cast("timestamp"), _date_format(v))


def _is_date(v: Column) -> Column:
    return _date_format(v).isNotNull()


def _after(v: Column, head: str, kind: str, key: str, moved=_moved) -> Column:
    """The value with what follows `head` permuted."""
    first = F.regexp_extract(v, head, 0)
    return F.concat(first, permuted(F.substring(v, F.length(first) + 1, F.length(v)), f"{key}:{kind}", moved))


def _email(v: Column, key: str) -> Column:
    """Name and domain apart, so that addresses of one domain stay so; the top-level domain stays."""
    name, domain = F.substring_index(v, "@", 1), F.substring_index(v, "@", -1)
    top = F.substring_index(domain, ".", -1)
    inner = F.substring(domain, F.lit(1), F.length(domain) - F.length(top) - 1)
    return F.concat(permuted(name, f"{key}:name"), F.lit("@"), permuted(inner, f"{key}:domain"), F.lit("."), top)


def _secret(v: Column, key: str) -> Column:
    head = rf"^(?:{_SECRET_NAME}[\"']?\s*[=:]\s*[\"']?)?"
    value = F.regexp_replace(v, head, "")
    hex_ = value.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")
    return F.when(hex_, _after(v, head, "secret", key, _hex_moved)).otherwise(_after(v, head, "secret", key))


def _is(v: Column, kind: str) -> Column:
    return v.rlike(f"^(?:{KINDS[kind]})$")


def _all(text: Column, kinds) -> Column:
    """All candidates in the text. The pattern's own group is the second here."""
    return F.regexp_extract_all(text, F.lit(f"({_either(kinds).replace(chr(92) + '1', chr(92) + '2')})"), 1)


def _segment(v: Column, candidate: bool) -> Column:
    return F.struct(v.alias("v"), F.lit(candidate).alias("candidate"))


def _segments(v: Column) -> Column:
    """A candidate as itself; of one that looks like an IBAN, the longest part from its beginning up to a space or its end that is
    one, and the candidates of LATER kinds in the rest with what stands between them."""
    part = lambda e: F.replace(F.substring(v, F.lit(1), e), F.lit(" "), F.lit(""))
    ends = F.filter(F.sequence(F.lit(1), F.length(v)), lambda e: (F.substring(v, e, F.lit(1)) != " ") & ((e == F.length(v)) | (F.substring(v, e + 1, F.lit(1)) == " ")))
    end = F.coalesce(F.array_max(F.filter(ends, lambda e: F.when(F.length(part(e)) >= 15, _mod97(part(e)) == 1).otherwise(F.lit(False)))), F.lit(0))
    rest = F.substring(v, end + 1, F.length(v))
    later = F.transform(_all(rest, LATER), lambda x: _segment(x, True))
    between = F.transform(F.split(rest, _either(LATER), -1), lambda x: _segment(x, False))
    last = F.array(_segment(F.lit(""), False))
    mixed = F.flatten(F.zip_with(between, F.concat(later, last), lambda a, b: F.array(a, b)))
    return F.when(_is(v, "iban"), F.concat(F.array(_segment(F.substring(v, F.lit(1), end), True)), mixed)).otherwise(F.array(_segment(v, True)))


def pseudonym(v: Column, key: str) -> Column:
    """What a candidate becomes; itself if no kind finds it valid."""
    n = F.length(_digits(v))
    return (
        F.when(_is(v, "secret"), _secret(v, key))
        .when(_is(v, "email"), _email(v, key))
        .when(_is(v, "iban"), _iban(v, key))
        .when(_is(v, "ip"), F.when(F.forall(F.split(v, r"\."), lambda x: x.cast("int") <= 255), _ip(v, key)).otherwise(v))
        .when(_is(v, "date"), F.when(_is_date(v), _date(v, key)).otherwise(v))
        .when(_is(v, "ssn"), F.when(~v.rlike("000-|-00-|-0000"), _ssn(v, key)).otherwise(v))
        .when(_is(v, "phone") & n.between(7, 15), _phone(v, key))
        .when(n >= 13, _card_within(v, key))
        .otherwise(v)
    )


def pseudonymise(docs: DataFrame, key: str, text: str = "text", found: str = "n_private") -> DataFrame:
    """Replaces the text's private values by pseudonyms; adds how many were replaced."""
    spark = docs.sparkSession
    if not spark.conf.get(REDACTION, None):  # plans hold the derived key
        spark.conf.set(REDACTION, KEY_MARK + "[0-9a-f]+")
    key = KEY_MARK + hmac.new(key.encode(), b"pii", hashlib.sha256).hexdigest()
    # Every kind has one of these characters, so a text without them is not searched; one without candidates is searched once.
    has = F.coalesce(F.col(text).rlike("[0-9@=:]") & F.col(text).rlike(PATTERN), F.lit(False))
    met = F.transform(_all(F.col(text), KINDS), _segments)
    own_met, own_new = fresh(docs.columns, "_met", "_new")
    docs = docs.withColumn(own_met, F.when(has, met))
    docs = docs.withColumn(own_new, F.transform(own_met, lambda p: F.transform(p, lambda x: F.when(x["candidate"], pseudonym(x["v"], key)).otherwise(x["v"]))))
    joined = F.zip_with(F.split(F.col(text), PATTERN, -1), F.concat(F.transform(own_new, lambda n: F.array_join(n, "")), F.array(F.lit(""))), lambda a, b: F.concat(a, b))
    changed = F.zip_with(F.flatten(own_met), F.flatten(own_new), lambda a, b: a["v"] != b)
    return docs.withColumns({text: F.when(has, F.array_join(joined, "")).otherwise(F.col(text)), found: F.when(has, F.size(F.filter(changed, lambda x: x))).otherwise(0).cast("long")}).drop(own_met, own_new)
