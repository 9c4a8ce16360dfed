"""Format-preserving Feistel pseudonyms for personal data, with DataFrame functions only.

Cards are found first, the other kinds in the text between them.  Candidates are validated for their kind and replaced,
inside their row, by a keyed permutation of their own format, so the same value gets the same pseudonym in every document
and no join or shuffle is needed.  A card may stand beside other numbers (an expiry date, an item's number): in a run of
digits, single spaces and hyphens each part from one group to another of 13 to 19 digits is tried, those grouped as
cards are (FIXED) first, then the longest from the left that don't have another kind's number in them.

kind     valid if                                   permuted
card     13 to 19 digits with a right Luhn digit    all digits but the last, which is made right again
iban     15 to 34 characters with right check       letters and digits after the check digits, which are made right again
ipv4     four numbers to 255                        the 32-bit address (two 16-bit halves)
ipv6     eight groups, or fewer around ::, a digit         the groups' hexadecimal digits, as they are written
phone    the pattern's shape                        the ten digits after the country code, area and exchange codes within the
                                                    class of those that may or may not begin with 0 or 1; in other
                                                    groupings all digits after the country code (or trunk 0)
ssn      area not 000, 666 or 9xx, no zero part     the 898 * 99 * 9999 valid numbers
date     a calendar day of 1800 to 2199             the day among the 146,097 = 27 * 5411 of a 400-year cycle
email    the pattern's shape                        letters and digits before the @, each within its class, alike in upper and lower case
secret   keys by their issuers' prefixes, JSON web  letters and digits after the prefix or name, each within its class
         tokens, private key blocks, and what is
         assigned to password, token, key, ...

A Feistel network of ROUNDS rounds: the value is cut in halves (l, r), and (l, r) becomes (r, l + F(r)) with F from
SHA-256 of the key, the kind, the round and r.  Addition is modulo each character's class (10 digits, 26 letters, 16 hexadecimal
digits) or modulo the half's size (65,536; 27 and 5,411; 88,902 and 9,999; ...), so each round and the whole are one-to-one
within the valid values of the format: a pseudonym is valid wherever its value is.  Candidates that aren't valid (a 16-digit
number with a wrong Luhn digit, a date of month 13) stay.

The key is a parameter without a default.  Query and pipeline take spark.tempograph.pseudonym.key, and DEMO_KEY, with a
warning, where it isn't set: pseudonyms by a public key can be undone by anyone.

Nulls: null text stays null with no kinds; empty texts are ordinary, very long ones are read whole within their row; repeated
values and rows get equal pseudonyms; of overlapping candidates the one that begins first counts (cards go before the others).  All
other columns pass unchanged, whatever their names; a column named as kinds_col is replaced.  Empty tables give empty results.
"""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

ROUNDS = 8
KEY_SETTING, DEMO_KEY = "spark.tempograph.pseudonym.key", "demonstration only"
#: names to which secrets are assigned
NAMED = r"(?=[AaPpSsTt])(?i:passwords?|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|secret[_-]?key|private[_-]?key)"
#: ten digits in the groups 3, 3, 4, with or without a country code
TEN = r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9])"
#: what of a secret stays: an issuer's prefix, the head of a key block, a name and its sign
STAYS = r"^(?:AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|sk-|pk_live_|sk_live_|xox[abeprs]-|AIza|eyJ|-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----|" + NAMED + r"[\"']?[ ]{0,2}[=:][ ]{0,2}[\"']?(?:(?i:bearer) )?)"
#: alternatives in the order in which they are tried; none has a capturing group
PATTERNS = {
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "phone": TEN + r"|\+[0-9]{1,3}(?:[ .-]\(?[0-9]{1,5}\)?){2,5}(?![0-9])|\+[0-9]{8,15}(?![0-9])|(?<![0-9+.-])\(?0[0-9]{2,4}\)?[ -][0-9]{3,4}[ -][0-9]{3,4}(?![0-9-])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "date": r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9])",
    "ipv4": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])",
    "ipv6": r"(?<![0-9A-Za-z:.])(?=[A-Fa-f:]{0,34}[0-9])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Za-z:])",
    "card": r"(?<![0-9])[0-9][0-9 -]{11,}[0-9]",
    "secret": r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])|(?:gh[pousr]_|github_pat_|glpat-|sk-|pk_live_|sk_live_)[A-Za-z0-9_-]{20,}|xox[abeprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]{4,}(?:\.[A-Za-z0-9_-]*)?)"
    r"|-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[^-]+(?=-----END)"
    "|" + NAMED + r"[\"']?[ ]{0,2}(?:=[ ]{0,2}[\"']?(?:(?i:bearer) )?[^\s\"',;&]{4,}|:[ ]{0,2}(?:[\"'](?:(?i:bearer) )?[^\s\"']{4,}(?=[\"'])|(?=[^\s\"',;]*[0-9])[^\s\"',;]{6,}))",
}
FOUND = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: the same but for cards
REST = "|".join(f"(?:{p})" for k, p in PATTERNS.items() if k != "card")
#: numbers that a card of an unusual grouping can't have in it
NUMBERS = "|".join(f"(?:{p})" for p in (TEN, PATTERNS["ssn"], PATTERNS["date"]))
#: the groups in which cards are written, and the first digits of payment cards
FIXED = r"^(?=[2-6])(?:[0-9]{16}|[0-9]{15}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5})$"
#: what every candidate has: a digit or @, or an issuer's prefix, or what is assigned
DIGITS, PREFIXES = "[0-9@]", ("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "sk-", "k_live_", "xox", "AIza", "eyJ", "PRIVATE KEY")
ASSIGNED = NAMED + r"[\"']?[ ]{0,2}[=:]"
MARK = "\x01"
CYCLE = "1800-01-01"
DAY_RADIX = (27, 5411)


def keyed(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts]), 256)


def shifted(s: Column, digest: Column, hexadecimal: bool = False) -> Column:
    """s with every letter and digit (or hexadecimal digit) moved within its class by the digest's bytes; other characters stay."""

    def one(c: Column, i: Column) -> Column:
        by = F.conv(F.substr(digest, i % 32 * 2 + 1, F.lit(2)), 16, 10).cast("int") + i  # 32 bytes serve any length
        move = lambda first, n: F.char((F.ascii(c) - ord(first) + by) % n + ord(first))
        if hexadecimal:
            digit = F.lower(F.conv(((F.conv(c, 16, 10).cast("int") + by) % 16).cast("string"), 10, 16))
            return F.when(c.rlike("[0-9A-Fa-f]"), digit).otherwise(c)
        return F.when(c.between("0", "9"), move("0", 10)).when(c.between("a", "z"), move("a", 26)).when(c.between("A", "Z"), move("A", 26)).otherwise(c)

    return F.array_join(F.transform(F.filter(F.split(s, ""), lambda c: c != ""), one), "")


def feistel_text(s: Column, key: str, kind: str, hexadecimal: bool = False) -> Column:
    """s permuted; the moves don't depend on letters' case, so values that differ in case only get pseudonyms that do."""
    half = F.floor(F.length(s) / 2).cast("int")
    start = F.struct(F.substr(s, F.lit(1), half).alias("l"), F.substr(s, half + 1, F.length(s)).alias("r"))
    step = lambda a, i: F.struct(a["r"].alias("l"), shifted(a["l"], keyed(key, F.lit(kind), i, F.lower(a["r"])), hexadecimal).alias("r"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda a: F.concat(a["l"], a["r"]))


def feistel_number(left: Column, right: Column, radix: tuple[int, int], key: str, kind: str) -> tuple:
    """The pair (left, right) permuted among radix[0] * radix[1] pairs, as a struct (l, r)."""
    draw = lambda i, x, n: F.conv(F.substring(keyed(key, F.lit(kind), i, x), 1, 14), 16, 10).cast("long") % n

    def step(a: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(
            F.when(even, (a["l"] + draw(i, a["r"], radix[0])) % radix[0]).otherwise(a["l"]).alias("l"),
            F.when(even, a["r"]).otherwise((a["r"] + draw(i, a["l"], radix[1])) % radix[1]).alias("r"),
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), step)


def luhn_digit(digits: Column) -> Column:
    """The digit that makes digits followed by it a valid number."""
    n = F.length(digits)
    odd = lambda i: (n - i) % 2 == 1  # noqa: E731  counted from the right, the last is doubled
    value = lambda c, i: F.when(odd(i), c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int"))
    total = F.aggregate(F.transform(F.filter(F.split(digits, ""), lambda c: c != ""), value), F.lit(0), lambda a, x: a + x)
    return ((F.lit(10) - total % 10) % 10).cast("string")


def refill(shape: Column, digits: Column) -> Column:
    """shape with its digits replaced by digits, in order."""
    step = lambda a, c: F.when(
        c.between("0", "9"), F.struct(F.concat(a["s"], F.substr(digits, a["n"] + 1, F.lit(1))).alias("s"), (a["n"] + 1).alias("n"))
    ).otherwise(F.struct(F.concat(a["s"], c).alias("s"), a["n"].alias("n")))
    start = F.struct(F.lit("").alias("s"), F.lit(0).alias("n"))
    return F.aggregate(F.filter(F.split(shape, ""), lambda c: c != ""), start, step, lambda a: a["s"])


def digits_of(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def iban_rest(m: Column) -> Column:
    """The remainder modulo 97 of a number in the order of its check: first four characters last, letters as 10 to 35."""
    turned = F.concat(F.substr(m, F.lit(5), F.length(m)), F.substr(m, F.lit(1), F.lit(4)))
    step = lambda a, c: F.when(c.between("0", "9"), a * 10 + c.cast("int")).otherwise(a * 100 + F.ascii(c) - 55) % 97
    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step)


def kind_of(m: Column) -> Column:
    """The kind of a candidate, null if it isn't valid."""
    whole = lambda kind: m.rlike(f"^(?:{PATTERNS[kind]})$")
    octets = F.forall(F.split(m, r"\."), lambda x: x.cast("int") <= 255)
    ssn = ~m.rlike(r"^(?:000|666|9)") & ~m.rlike(r"-00-|-0000$")
    close = F.replace(m, F.lit(" "), F.lit(""))
    iban = F.length(close).between(15, 34) & (iban_rest(close) == 1)
    phone = m.rlike(f"^(?:{TEN})$") | F.length(digits_of(m)).between(8, 15)
    ipv6 = F.size(F.filter(F.split(m, ":"), lambda g: g != "")) <= 8
    return (
        F.when(whole("email"), "email").when(whole("iban"), F.when(iban, "iban")).when(whole("phone"), F.when(phone, "phone")).when(whole("ssn"), F.when(ssn, "ssn")).when(whole("date"), F.when(day_of(m).isNotNull(), "date"))
        .when(whole("ipv4"), F.when(octets, "ipv4")).when(whole("ipv6"), F.when(ipv6, "ipv6")).otherwise("secret")
    )


def is_card(m: Column) -> Column:
    d = digits_of(m)
    return F.length(d).between(13, 19) & (luhn_digit(F.substr(d, F.lit(1), F.length(d) - 1)) == F.substr(d, F.length(d), F.lit(1)))


def card_spans(groups: Column) -> Column:
    """(first, end) of the cards, in order, among groups of digits, each with the spaces and hyphens after it."""
    none = F.array().cast("array<struct<first:int,end:int,m:string>>")

    def of(i: Column) -> Column:
        """The parts from group i on that are cards, the longest first."""
        part = lambda n: F.struct(i.alias("first"), (i + n).alias("end"), F.regexp_replace(F.array_join(F.slice(groups, i + 1, n), ""), "[ -]+$", "").alias("m"))
        parts = F.transform(F.sequence(F.least(F.lit(19), F.size(groups) - i), F.lit(1)), part)
        return F.filter(parts, lambda x: F.length(x["m"]).between(13, 37) & ~x["m"].rlike("[ -]{2}") & is_card(x["m"]))

    def kept(found: Column) -> Column:
        """The spans that don't overlap an earlier one."""
        take = lambda a, x: F.when(x["first"] >= a["end"], F.struct(x["end"].alias("end"), F.concat(a["s"], F.array(x)).alias("s"))).otherwise(a)
        return F.aggregate(found, F.struct(F.lit(0).alias("end"), none.alias("s")), take, lambda a: a["s"])

    def chosen(cards: Column) -> Column:
        free = lambda f: F.filter(cards, lambda x: ~F.exists(f, lambda y: (x["first"] < y["end"]) & (y["first"] < x["end"])) & ~x["m"].rlike(NUMBERS))
        return once(kept(F.filter(cards, lambda x: x["m"].rlike(FIXED))), lambda f: F.array_sort(F.concat(f, kept(free(f)))))

    cards = F.flatten(F.transform(F.sequence(F.lit(0), F.size(groups) - 1), of))
    return once(cards, lambda c: F.when(F.size(c) > 0, chosen(c)).otherwise(none))


def once(x: Column, f) -> Column:
    """f(x), with x computed once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def cut(run: Column) -> Column:
    """A run as pieces (card, m) in order: its cards and what is between them."""
    piece = lambda m, card: F.struct(F.lit(card).alias("card"), m.alias("m"))

    def of(groups: Column, spans: Column) -> Column:
        joined = lambda first, end: F.array_join(F.slice(groups, first + 1, end - first), "")
        before = lambda i: F.coalesce(F.get(spans, i - 1)["end"], F.lit(0))
        after = lambda x: F.regexp_extract(F.get(groups, x["end"] - 1), "[ -]*$", 0)
        both = F.transform(spans, lambda x, i: F.array(piece(joined(before(i), x["first"]), False), piece(x["m"], True), piece(after(x), False)))
        return F.concat(F.flatten(both), F.array(piece(joined(before(F.size(spans)), F.size(groups)), False)))

    return once(F.regexp_extract_all(run, F.lit("[0-9]+[ -]*"), F.lit(0)), lambda g: once(card_spans(g), lambda s: of(g, s)))


#: date formats by the shape that tells them
DATES = ((r"^[0-9]{4}-", "yyyy-MM-dd"), (r"^[0-9]{4}/", "yyyy/MM/dd"), (r"^[0-9]{2}/", "MM/dd/yyyy"), (r"^[0-9]{2}\.", "dd.MM.yyyy"))


def day_of(m: Column) -> Column:
    """Days since the cycle's first, null for what isn't a day of the cycle."""
    day = reduce(lambda c, f: c.when(m.rlike(f[0]), F.datediff(F.try_to_timestamp(m, F.lit(f[1])).cast("date"), F.lit(CYCLE).cast("date"))), DATES, F.when(F.lit(False), 0))
    return F.when(day.between(0, DAY_RADIX[0] * DAY_RADIX[1] - 1), day)


def new_date(m: Column, key: str) -> Column:
    pair = feistel_number(F.floor(day_of(m) / DAY_RADIX[1]), day_of(m) % DAY_RADIX[1], DAY_RADIX, key, "date")
    day = F.date_add(F.lit(CYCLE).cast("date"), F.aggregate(F.array(pair), F.lit(0), lambda a, p: (p["l"] * DAY_RADIX[1] + p["r"]).cast("int")))
    return reduce(lambda c, f: c.when(m.rlike(f[0]), F.date_format(day, f[1])), DATES, F.when(F.lit(False), ""))


def new_ipv4(m: Column, key: str) -> Column:
    octet = lambda k: F.element_at(F.split(m, r"\."), k).cast("int")
    pair = feistel_number(octet(1) * 256 + octet(2), octet(3) * 256 + octet(4), (65536, 65536), key, "ipv4")
    parts = lambda p: F.concat_ws(".", *[x.cast("string") for x in (F.shiftright(p["l"], 8), p["l"] % 256, F.shiftright(p["r"], 8), p["r"] % 256)])
    return F.aggregate(F.array(pair), F.lit(""), lambda a, p: parts(p))


def new_card(m: Column, key: str) -> Column:
    d = digits_of(m)
    body = feistel_text(F.substr(d, F.lit(1), F.length(d) - 1), key, "card")
    full = F.aggregate(F.array(body), F.lit(""), lambda a, b: F.concat(b, luhn_digit(b)))
    return refill(m, full)


def number(pair: Column, back) -> Column:
    """back(l, r) of a pair from feistel_number, computed once."""
    return once(pair, lambda p: back(p["l"], p["r"]))


def padded(x: Column, n: int) -> Column:
    return F.lpad(x.cast("string"), n, "0")


def new_ssn(m: Column, key: str) -> Column:
    part = lambda at, n: F.substring(digits_of(m), at, n).cast("int")
    area = part(1, 3) - F.when(part(1, 3) > 666, 2).otherwise(1)  # 0 to 897
    pair = feistel_number(area * 99 + part(4, 2) - 1, part(6, 4) - 1, (898 * 99, 9999), key, "ssn")

    def back(l: Column, r: Column) -> Column:
        low = F.floor(l / 99)
        return F.concat(padded(low + F.when(low >= 665, 2).otherwise(1), 3), padded(l % 99 + 1, 2), padded(r + 1, 4))

    return refill(m, number(pair, back))


def new_ten(d: Column, key: str) -> Column:
    """Ten digits: area and exchange codes stay in their class (first digit over 1 or not)."""
    area, exchange, line = (F.substring(d, at, n).cast("int") for at, n in ((1, 3), (4, 3), (7, 4)))
    of = lambda left, size, kind: feistel_number(left, line, (size, 10_000), key, f"phone {kind}")
    plain = number(of((area - 200) * 800 + exchange - 200, 640_000, "a"), lambda l, r: F.concat(padded(F.floor(l / 800) + 200, 3), padded(l % 800 + 200, 3), padded(r, 4)))
    low = number(of((area - 200) * 200 + exchange, 160_000, "b"), lambda l, r: F.concat(padded(F.floor(l / 200) + 200, 3), padded(l % 200, 3), padded(r, 4)))
    other = number(of(area * 1000 + exchange, 200_000, "c"), lambda l, r: F.concat(padded(F.floor(l / 1000), 3), padded(l % 1000, 3), padded(r, 4)))
    return F.when(area < 200, other).when(exchange < 200, low).otherwise(plain)


def new_phone(m: Column, key: str) -> Column:
    """The country code stays; so does a trunk 0."""
    d = digits_of(m)
    ten = F.concat(F.substr(d, F.lit(1), F.length(d) - 10), new_ten(F.right(d, F.lit(10)), key))
    code = digits_of(F.regexp_extract(m, r"^(?:\+[0-9]{1,3}(?=[ .-])|\+[0-9]{2}|\(?0)", 0))
    free = F.concat(code, feistel_text(F.substr(d, F.length(code) + 1, F.length(d)), key, "phone"))
    return refill(m, F.when(m.rlike(f"^(?:{TEN})$"), ten).otherwise(free))


def new_iban(m: Column, key: str) -> Column:
    close = F.replace(m, F.lit(" "), F.lit(""))
    country = F.substring(close, 1, 2)

    def checked(body: Column) -> Column:
        full = F.concat(country, padded(98 - iban_rest(F.concat(country, F.lit("00"), body)), 2), body)
        step = lambda a, c: F.when(c == " ", F.struct(F.concat(a["s"], c).alias("s"), a["n"].alias("n"))).otherwise(F.struct(F.concat(a["s"], F.substr(full, a["n"] + 1, F.lit(1))).alias("s"), (a["n"] + 1).alias("n")))
        return F.aggregate(F.filter(F.split(m, ""), lambda c: c != ""), F.struct(F.lit("").alias("s"), F.lit(0).alias("n")), step, lambda a: a["s"])

    return once(feistel_text(F.substr(close, F.lit(5), F.length(close)), key, "iban"), checked)


def new_secret(m: Column, key: str) -> Column:
    """The issuer's prefix, or the name to which it is assigned, stays; the same secret gets the same pseudonym under any name."""
    stays = F.regexp_extract(m, STAYS, 0)
    return F.concat(stays, feistel_text(F.substr(m, F.length(stays) + 1, F.length(m)), key, "secret"))


def pseudonym(kind: Column, m: Column, key: str) -> Column:
    at = F.instr(m, "@")
    email = F.concat(feistel_text(F.substr(m, F.lit(1), at - 1), key, "email"), F.substr(m, at, F.length(m)))
    return (
        F.when(kind == "email", email).when(kind == "iban", new_iban(m, key)).when(kind == "phone", new_phone(m, key)).when(kind == "ssn", new_ssn(m, key))
        .when(kind == "date", new_date(m, key)).when(kind == "ipv4", new_ipv4(m, key)).when(kind == "ipv6", feistel_text(m, key, "ipv6", True))
        .when(kind == "card", new_card(m, key)).when(kind == "secret", new_secret(m, key)).otherwise(m)
    )


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", out_col: str | None = None, kinds_col: str | None = "pii_kinds") -> DataFrame:
    """docs with the text (or out_col) pseudonymised and kinds_col, if named: the kinds found, in the order of the text."""
    name = lambda c: F.col(f"`{c}`")
    out_col = out_col or text_col
    df = docs.select(F.struct(*map(name, docs.columns)).alias("_row"), name(text_col).alias("_text"))
    text = F.col("_text")
    assigned = (F.contains(text, F.lit("=")) | F.contains(text, F.lit(":"))) & text.rlike(ASSIGNED)
    has = F.coalesce(text.rlike(DIGITS) | reduce(Column.__or__, [F.contains(text, F.lit(x)) for x in PREFIXES]) | assigned, F.lit(False))
    runs = F.transform(F.regexp_extract_all(text, F.lit(FOUND), F.lit(0)), lambda m: F.when(m.rlike(f"^(?:{PATTERNS['card']})$"), cut(m)).otherwise(F.array(F.struct(F.lit(False).alias("card"), m.alias("m")))))
    df = df.withColumn("_runs", F.when(text.rlike(PATTERNS["card"]), runs).otherwise(F.array().cast("array<array<struct<card:boolean,m:string>>>")))
    df = df.withColumn("_cards", F.transform(F.filter(F.flatten("_runs"), lambda x: x["card"]), lambda x: x["m"]))
    # the text with MARK b in the place of each card, cut there; a MARK of its own is followed by a
    own = lambda t: F.replace(t, F.lit(MARK), F.lit(MARK + "a"))
    marked = F.zip_with(F.split(text, FOUND, -1), F.col("_runs"), lambda a, r: F.concat(own(a), F.coalesce(F.array_join(F.transform(r, lambda x: F.when(x["card"], MARK + "b").otherwise(own(x["m"]))), ""), F.lit(""))))
    around = F.transform(F.split(F.array_join(marked, ""), MARK + "b", -1), lambda t: F.replace(t, F.lit(MARK + "a"), F.lit(MARK)))
    df = df.withColumn("_around", F.when(F.size("_cards") > 0, around).when(has, F.array(text)).otherwise(F.array().cast("array<string>")))
    found = lambda t: F.transform(F.regexp_extract_all(t, F.lit(REST), F.lit(0)), lambda m: F.struct(kind_of(m).alias("kind"), m.alias("m")))
    card = lambda i: F.coalesce(F.transform(F.slice("_cards", i + 1, F.lit(1)), lambda m: F.struct(F.lit("card").alias("kind"), m.alias("m"))), F.array().cast("array<struct<kind:string,m:string>>"))
    df = df.withColumn("_found", F.flatten(F.transform("_around", lambda t, i: F.concat(found(t), card(i)))))
    df = df.withColumn("_new", F.transform("_found", lambda x: pseudonym(x["kind"], x["m"], key)))
    between = F.flatten(F.transform("_around", lambda t: F.split(t, REST, -1)))
    joined = F.array_join(F.zip_with(between, F.col("_new"), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    new = {out_col: F.when(F.size("_new") > 0, joined).otherwise(text)}
    if kinds_col:
        new[kinds_col] = F.filter(F.transform("_found", lambda x: x["kind"]), lambda k: k.isNotNull())
    columns = [new.pop(c).alias(c) if c in new else F.col("_row").getField(c).alias(c) for c in docs.columns]
    return df.select(*columns, *[v.alias(c) for c, v in new.items()])


def key_of(spark: SparkSession) -> str:
    """The key that the session names."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        warnings.warn(f"{KEY_SETTING} isn't set: pseudonyms are made with a public key", stacklevel=2)
    return key or DEMO_KEY


def op6_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), key_of(spark))
    return out.select("doc_id", "text", F.size("pii_kinds").cast("long").alias("n_found"), F.array_join("pii_kinds", ",").alias("kinds"))
