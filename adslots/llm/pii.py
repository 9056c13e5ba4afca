"""Format-preserving pseudonyms by keyed Feistel permutations.

E-mail addresses, phone, card, account (IBAN), social-security and IP numbers, dates and hexadecimal secrets are found
in the text, validated, and replaced by other values of the same format under a key. Each replacement is a permutation
of its format, so different values stay different and equal values stay linked, in any document, while without
the key they can't be undone. The round function is SHA-256 of key, kind, round and half.

* A number in a domain of a * b values is a pair (left, right); rounds add a keyed function of one half to the
  other, modulo a or b. That permutes the domain exactly, without walking cycles. Addresses use 2^16 * 2^16;
  phones all digits behind the country or trunk code; cards split their payload and get a new Luhn digit; social
  security numbers use the valid areas, groups and serials; dates the 146,097 days of a Gregorian cycle, 1800 to 2199.
  A date that can only be read month first walks its cycle to the next such date.
* The parts of an e-mail address (but for the top-level domain), IPv6 addresses, secrets and the account part of an IBAN
  (which gets new check digits) are permuted character by character inside their classes (digits, letters of a case,
  accented Latin-1 letters); other characters stay.

Numbers that fail validation (Luhn sum, IBAN checksum, octets over 255, impossible dates and areas, phones of fewer
than 8 or more than 15 digits) are not personal data and stay. A run of digit groups that is no card as a whole is
searched for whole groups that are one. Everything is DataFrame functions inside the row: no shuffle, and texts without
digits are not searched.

Not found, and left in clear: dates of one-digit days or months or two-digit years, numbers that letters touch
(`Visa4111...`, `tel415...`), hosts that end in letters outside ASCII. A number with a calling code and the same one with a
trunk zero are different values.

Defined cases: a null text stays null with zero counts; texts and values of any length are searched whole; overlapping
finds go to the first in the order of the text; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
_NOT_BEFORE, _NOT_AFTER = "(?<![0-9A-Za-z])", "(?![0-9A-Za-z])"
_HEX4, _NATIONAL = "[0-9A-Fa-f]{1,4}", r"(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}"
#: A host's labels, as far as one follows that may end the host: a possessive group, as others recurse for every label.
#: Where that label doesn't, the hosts of at most 127 labels (more can't be resolved) are tried from the longest on.
_LABELS = r"(?:(?:[0-9A-Za-z-]++\.(?=[A-Za-z]{2}|[0-9A-Za-z-]++\.))++|(?:[0-9A-Za-z-]++\.){1,127})"
#: (kind, format), in the order in which they are tried at a place.
FORMATS = (
    ("email", r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@" + _LABELS + "[A-Za-z]{2,24}"),
    ("secret", _NOT_BEFORE + "(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+)" + _NOT_AFTER),
    ("ip", r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z]|\.[0-9])"),
    ("ipv6", f"(?<![0-9A-Za-z:.])(?:(?:{_HEX4}:){{7}}{_HEX4}|(?:{_HEX4}:){{1,6}}(?::{_HEX4}){{1,6}}|::{_HEX4}(?::{_HEX4}){{1,6}})(?![0-9A-Za-z:])"),
    ("iban", _NOT_BEFORE + "[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?" + _NOT_AFTER),
    ("date", _NOT_BEFORE + r"(?:[0-9]{4}-[0-9]{2}-[0-9]{2}(?=T[0-9]{2}:|(?![0-9A-Za-z]))|[0-9]{2}[./-][0-9]{2}[./-][0-9]{4}" + _NOT_AFTER + ")"),
    ("ssn", _NOT_BEFORE + "[0-9]{3}-[0-9]{2}-[0-9]{4}" + _NOT_AFTER),
    ("card", _NOT_BEFORE + "(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){2}[ -][0-9]{1,7}(?:[ -][0-9]{3})?|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5})" + _NOT_AFTER),
    ("phone", r"(?<![0-9A-Za-z+])(?:\+[0-9](?:[ ./()-]{0,2}[0-9]){7,14}|" + _NATIONAL + r"|0[1-9][0-9]{0,3}[ /-][0-9]{2,8}(?:[ -][0-9]{2,8}){0,4})" + _NOT_AFTER),
    ("card", _NOT_BEFORE + "[0-9](?:[ -]?[0-9]){12,18}" + _NOT_AFTER),
)
KINDS = tuple(dict.fromkeys(kind for kind, _ in FORMATS))
PATTERN = "|".join(pattern for _, pattern in FORMATS)
#: The classes in which characters are permuted.
LETTERS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ")
HEX, CAPITALS = ("0123456789", "abcdef", "ABCDEF"), ("0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
#: The calling codes of one and of two digits; all others have three.
CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
#: Steps that a walk along a cycle may take; it ends sooner but for one in 10^25.
WALK = 64


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _keyed(key: str, kind: str, *parts: Column) -> Column:
    """A number below 2^52 fixed by key, kind and parts."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), *[p.cast("string") for p in parts]), 256)
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")


def _div(x: Column, n: Column) -> Column:
    return ((x - F.pmod(x, n)) / n).cast("long")


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a string of digits, the last one the check digit."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: _let(c.cast("int") * (1 + i % 2), lambda d: F.when(d > 9, d - 9).otherwise(d)))
    return F.aggregate(each, F.lit(0), lambda s, d: s + d)


def _refill(form: Column, digits: Column) -> Column:
    """`form` with its digits replaced in turn."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"))

    def put(s: Column, c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), F.struct(F.concat(s["out"], F.substr(digits, s["k"], F.lit(1))).alias("out"), (s["k"] + 1).alias("k"))).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["k"].alias("k")))

    return F.aggregate(F.split(form, ""), start, put, lambda s: s["out"])


def _characters(value: Column, classes: tuple[str, ...], key: str, kind: str, tweak: Column) -> Column:
    """Permutes the characters of `value` inside their classes: halves shift each other, each by a digest of the other
    and the tweak, so the work is in proportion to the length."""

    def shifted(own: Column, other: Column, i: Column) -> Column:
        def by(digest: Column) -> Column:
            def one(c: Column, at: Column) -> Column:
                out = c
                for letters in classes:
                    place = F.instr(F.lit(letters), c)
                    out = F.when(place > 0, F.substr(F.lit(letters), (F.pmod(place - 1 + _keyed(key, kind, digest, at), F.lit(len(letters))) + 1).cast("int"), F.lit(1))).otherwise(out)
                return out

            return F.transform(own, one)

        return _let(F.sha2(F.concat_ws("|", i.cast("string"), tweak, F.array_join(other, "")), 256), by)

    def turn(s: Column, i: Column) -> Column:
        return F.when(i % 2 == 0, F.struct(shifted(s["l"], s["r"], i).alias("l"), s["r"].alias("r"))).otherwise(F.struct(s["l"].alias("l"), shifted(s["r"], s["l"], i).alias("r")))

    def run(chars: Column) -> Column:
        half = (F.size(chars) / 2).cast("int")
        start = F.struct(F.slice(chars, F.lit(1), half).alias("l"), F.slice(chars, half + 1, F.size(chars) - half).alias("r"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(3)), start, turn, lambda s: F.concat(F.array_join(s["l"], ""), F.array_join(s["r"], "")))

    return _let(F.split(value, ""), run)


def _spaced(form: Column, letters: Column) -> Column:
    """`form` with its characters, but for spaces, replaced in turn."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"))

    def put(s: Column, c: Column) -> Column:
        return F.when(c == " ", F.struct(F.concat(s["out"], c).alias("out"), s["k"].alias("k"))).otherwise(F.struct(F.concat(s["out"], F.substr(letters, s["k"], F.lit(1))).alias("out"), (s["k"] + 1).alias("k")))

    return F.aggregate(F.split(form, ""), start, put, lambda s: s["out"])


def mod97(letters: Column) -> Column:
    """The remainder by 97 of digits and capitals, a capital standing for 10 to 35."""

    def add(s: Column, c: Column) -> Column:
        return _let(F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1, lambda v: F.when(v < 10, s * 10 + v).otherwise(s * 100 + v) % 97)

    return F.aggregate(F.split(letters, ""), F.lit(0), add)


def _number(digits: Column, a: Column, b: Column, width: Column, key: str, kind: str) -> Column:
    return _let(digits.try_cast("long"), lambda x: F.lpad(feistel(x, a, b, key, kind, width).cast("string"), width, "0"))


def feistel(x: Column, a: Column, b: Column, key: str, kind: str, tweak: Column) -> Column:
    """The permutation of 0 .. a*b-1; a and b are columns of longs."""

    def turn(s: Column, i: Column) -> Column:
        return F.when(
            i % 2 == 0, F.struct(F.pmod(s["l"] + _keyed(key, kind, tweak, i, s["r"]), a).alias("l"), s["r"].alias("r"))
        ).otherwise(F.struct(s["l"].alias("l"), F.pmod(s["r"] + _keyed(key, kind, tweak, i, s["l"]), b).alias("r")))

    start = F.struct(_div(x, b).alias("l"), F.pmod(x, b).alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda s: s["l"] * b + s["r"])


def _split_number(digits: Column, key: str, kind: str) -> Column:
    """A permutation of the strings of digits of this length."""
    n = F.length(digits)
    half = (n / 2).cast("int")
    a, b = F.pow(F.lit(10.0), n - half).cast("long"), F.pow(F.lit(10.0), half).cast("long")
    return _number(digits, a, b, n, key, kind)


def _card(d: Column, key: str) -> Column:
    n = F.greatest(F.length(d) - 1, F.lit(2))  # a find that isn't a card may come here too
    return _let(_split_number(F.left(d, n), key, "card"), lambda p: F.concat(p, F.pmod(10 - luhn_sum(F.concat(p, F.lit("0"))), F.lit(10)).cast("string")))


def _card_at(m: Column) -> Column:
    """(start, length) in digits of the first and longest run of whole digit groups that is a card, or null."""
    groups = F.transform(F.split(m, "[ -]"), lambda g: F.length(g))
    ends = F.transform(groups, lambda g, i: F.aggregate(F.slice(groups, 1, i + 1), F.lit(0), lambda s, x: s + x))
    runs = F.flatten(F.transform(groups, lambda g, i: F.transform(ends, lambda e: F.struct((F.get(ends, i) - g).alias("start"), (e - F.get(ends, i) + g).alias("length")))))
    digits = F.regexp_replace(m, "[^0-9]", "")
    valid = F.filter(runs, lambda r: (r["length"] >= 13) & (r["length"] <= 19) & (F.pmod(luhn_sum(F.substr(digits, r["start"] + 1, F.greatest(r["length"], F.lit(0)))), F.lit(10)) == 0))
    return F.get(F.array_sort(valid, lambda x, y: F.when(x["start"] != y["start"], x["start"] - y["start"]).otherwise(y["length"] - x["length"])), F.lit(0))


def pseudonym(m: Column, key: str) -> Column:
    """(kind, text) of one find; kind is null, and the text as it was, where validation fails."""
    long = lambda n: F.lit(n).cast("long")
    digits = F.regexp_replace(m, "[^0-9]", "")
    none = F.lit("")

    octets = F.transform(F.split(m, r"\."), lambda o: o.try_cast("long"))
    ip_ok = F.forall(octets, lambda o: o < 256)
    ip_number = F.aggregate(octets, long(0), lambda s, o: s * 256 + o)
    ip = _let(_let(ip_number, lambda x: feistel(x, long(65536), long(65536), key, "ip", F.lit(4))), lambda x: F.concat_ws(".", *[F.pmod(_div(x, long(256**k)), long(256)).cast("string") for k in (3, 2, 1, 0)]))
    ipv6_ok = m.rlike("[0-9]") & (F.size(F.filter(F.split(m, ":"), lambda g: g != "")) <= F.when(m.contains("::"), F.lit(7)).otherwise(F.lit(8))) & (F.size(F.split(m, ":")) > 3)

    iso = m.rlike("^[0-9]{4}-")
    plain = F.translate(m, "/-", "..")
    by_day, by_month = F.try_to_date(plain, "dd.MM.yyyy"), F.try_to_date(plain, "MM.dd.yyyy")
    day = F.when(iso, F.try_to_date(m, "yyyy-MM-dd")).otherwise(F.coalesce(by_day, by_month))
    first = F.lit("1800-01-01").cast("date")
    offset = F.datediff(day, first).cast("long")
    date_ok = F.coalesce((offset >= 0) & (offset < 146097), F.lit(False))
    step = lambda x: feistel(x, long(189), long(773), key, "date", F.lit(0))
    late = lambda x: F.dayofmonth(F.date_add(first, x.cast("int"))) > 12
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), F.struct(offset.alias("x"), F.lit(False).alias("there")), lambda s, _: F.when(s["there"], s).otherwise(_let(step(s["x"]), lambda y: F.struct(y.alias("x"), late(y).alias("there")))), lambda s: s["x"])
    to_date = lambda x: F.date_add(first, x.cast("int"))
    date = (
        F.when(iso, F.date_format(to_date(_let(offset, step)), "yyyy-MM-dd"))
        .when(by_day.isNotNull(), _refill(m, F.date_format(to_date(_let(offset, step)), "ddMMyyyy")))
        .otherwise(_refill(m, F.date_format(to_date(walked), "MMddyyyy")))
    )

    # the calling code or the trunk zero stays, however the number is spaced
    code = F.when(m.startswith("+"), F.when(F.left(digits, F.lit(1)).isin(CODES), F.lit(1)).when(F.left(digits, F.lit(2)).isin(CODES), F.lit(2)).otherwise(F.lit(3))).when(m.startswith("0") & ~m.rlike("^" + _NATIONAL + "$"), F.lit(1)).otherwise(F.lit(0))
    phone_ok = F.length(digits).between(8, 15)
    phone = _refill(m, F.concat(F.left(digits, code), _let(F.substr(digits, code + 1, F.length(digits)), lambda d: _split_number(d, key, "phone"))))

    card_at = _card_at(m)
    card = _let(card_at, lambda r: _refill(m, F.concat(F.left(digits, r["start"]), _card(F.substr(digits, r["start"] + 1, r["length"]), key), F.substr(digits, r["start"] + r["length"] + 1, F.length(digits)))))

    area, group, serial = (F.substring(digits, p, n).try_cast("long") for p, n in ((1, 3), (4, 2), (6, 4)))
    ssn_ok = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    rank = (F.when(area > 666, area - 2).otherwise(area - 1) * 99 + group - 1) * 9999 + serial - 1
    ssn_number = _let(rank, lambda x: feistel(x, long(898), long(99 * 9999), key, "ssn", F.lit(0)))

    def ssn_text(x: Column) -> Column:
        s, g, r = F.pmod(x, long(9999)) + 1, F.pmod(_div(x, long(9999)), long(99)) + 1, _div(x, long(99 * 9999)) + 1
        area = F.when(r >= 666, r + 1).otherwise(r)
        return F.concat_ws("-", *[F.lpad(v.cast("string"), w, "0") for v, w in ((area, 3), (g, 2), (s, 4))])

    account = F.translate(m, " ", "")
    rest = F.substr(account, F.lit(5), F.length(account))
    iban_ok = F.length(account).between(15, 34) & (mod97(F.concat(rest, F.left(account, F.lit(4)))) == 1)

    def iban_of(bban: Column) -> Column:
        country = F.left(account, F.lit(2))
        check = F.lpad((98 - mod97(F.concat(bban, country, F.lit("00")))).cast("string"), 2, "0")
        return _spaced(m, F.concat(country, check, bban))

    iban = _let(_characters(rest, CAPITALS, key, "iban", F.left(account, F.lit(2))), iban_of)
    host = F.substring_index(m, "@", -1)
    top = F.substring_index(host, ".", -1)
    name = F.left(host, F.length(host) - F.length(top))
    email = F.concat(_characters(F.substring_index(m, "@", 1), LETTERS, key, "email", host), F.lit("@"), _characters(name, LETTERS, key, "domain", top), top)

    def as_(kind: str, text: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), text.alias("text"))

    is_ = lambda kind: m.rlike("^(?:" + "|".join(p for k, p in FORMATS if k == kind) + ")$")
    keep = F.struct(F.lit(None).cast("string").alias("kind"), m.alias("text"))
    return (
        F.when(is_("email"), as_("email", email))
        .when(is_("secret") & m.rlike("[0-9]") & m.rlike("[A-Fa-f]"), as_("secret", _characters(m, HEX, key, "secret", none)))
        .when(is_("ip"), F.when(ip_ok, as_("ip", ip)).otherwise(keep))
        .when(is_("ipv6"), F.when(ipv6_ok, as_("ipv6", _characters(m, HEX, key, "ipv6", none))).otherwise(keep))
        .when(is_("iban"), F.when(iban_ok, as_("iban", iban)).otherwise(keep))
        .when(is_("date"), F.when(date_ok, as_("date", date)).otherwise(keep))
        .when(is_("ssn"), F.when(ssn_ok, as_("ssn", _let(ssn_number, ssn_text))).otherwise(keep))
        .when(is_("card") & card_at.isNotNull(), as_("card", card))
        .when(is_("phone"), F.when(phone_ok, as_("phone", phone)).otherwise(keep))
        .otherwise(keep)
    )


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, text with pseudonyms, and the number of replaced values of each kind, of docs(doc_id, text)."""
    text = F.col("text")
    none = F.array().cast("array<struct<kind:string,text:string>>")
    found = F.when(text.rlike("[0-9@]"), F.transform(F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0)), lambda m: pseudonym(m, key))).otherwise(none)
    rows = docs.select("doc_id", "text", F.coalesce(found, none).alias("found"))
    pieces = F.split("text", PATTERN, -1)
    put = F.when(F.size("found") > 0, F.array_join(_let(pieces, lambda p: F.zip_with(p, F.concat(F.transform("found", lambda f: f["text"]), F.array(F.lit(""))), lambda a, b: F.concat(a, b))), "")).otherwise(text)

    def of(kind: str) -> Column:
        return F.size(F.filter("found", lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return rows.select("doc_id", put.alias("text"), *[of(kind) for kind in KINDS])
