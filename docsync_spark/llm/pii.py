"""Personal data replaced by format-preserving pseudonyms, with DataFrame functions only.

Validated numbers and dates are permuted within their format by a keyed Feistel network over mixed
radices: a value is a pair (left, right), and ten rounds add in turn to one half a SHA-256 of the
key, the kind, the round and the other half, modulo that half's size. That is a bijection of the
kind's values, so equal values stay equal in all documents and different ones different, without any
table of values and without a shuffle. Nothing is looked up or gathered; each row stands alone.

=========  =====================================================  ==================================
kind       accepted                                               permuted
=========  =====================================================  ==================================
card       13 to 19 digits, blanks or dashes between, Luhn holds  all but the last; Luhn holds again
iban       country, check digits, 10 to 30 more, mod 97 is 1      the digits; the check is made anew
ssn        ddd-dd-dddd in the ranges that are given out           all, within these ranges
phone      North American, area and exchange from 2 on and not    ten digits, area and exchange likewise
           x11, set apart by signs or after +1
ip         four numbers to 255, the first 1 to 223, not after     all four, within these ranges
           version, release or section
date       yyyy-mm-dd, dd.mm.yyyy, mm/dd/yyyy; 1800 to 2199       the 146,097 days = 189 x 773
email      local part, @, domain of 128 labels at most            a keyed name at a domain that can't exist
=========  =====================================================  ==================================
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsync_spark.llm.common import let, table, unused

#: The session setting with the key; KEY, which is no secret, serves where it is unset.
KEY_SETTING, KEY = "spark.docsync.pii.key", "docsync"
ROUNDS = 10
KINDS = {
    "email": r"(?<![\w.%+-])[A-Za-z0-9_%+-][\w.%+-]*+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++){0,126}\.[A-Za-z]{2,}+(?![\w-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<![\w.])(?<!(?i:version|release|section) )(?:22[0-3]|2[01]\d|1\d\d|[1-9]\d?)\.(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){2}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\w]|\.\d)",
    "date": r"(?<![\w./-])(?:\d{4}-\d{2}-\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})(?![\w/-])",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "card": r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-])",
    "phone": r"(?<![\w+.-])(?:(?:\+?1[ .-]?)?(?:\([2-9]\d{2}\) ?|[2-9]\d{2}[ .-])|\+1[2-9]\d{2})[2-9]\d{2}[ .-]?\d{4}(?![\w-])",
}
#: Cards in their usual shapes; and maximal runs of groups, in which an IBAN or a card may stand beside other numbers.
CARD = r"(?<![\w.-])(?:\d{13,19}|\d{4}-\d{4}-\d{4}-\d{4}|\d{4} \d{4} \d{4} \d{4}|\d{4}-\d{6}-\d{5}|\d{4} \d{6} \d{5})(?![\w-])"
CARD_CHAIN = r"(?<![\w.-])(?=\d(?:[ -]?\d){12})\d++(?:[ -]\d++(?!\w|-(?!\d)))*+(?![\w-])"
IBAN_CHAIN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}[A-Z0-9]*+(?: [A-Z0-9]++(?![A-Za-z0-9]))*+(?![A-Za-z0-9])"
#: Characters of an IBAN by country; others may have any length.
IBAN_LENGTHS = {c: n for n, cs in {15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "PT LY", 26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO EG GT HU LB PL SV", 29: "BR PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC"}.items() for c in cs.split()}


def _round(key: str, kind: str, i: Column, half: Column, size: Column) -> Column:
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), half.cast("string")), 256)
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), size)


def feistel(left: Column, right: Column, a: Column, b: Column, key: str, kind: str) -> Column:
    """(l, r): the pair permuted within [0, a) x [0, b)."""

    def step(x: Column, i: Column) -> Column:
        l, r = x["l"], x["r"]
        even = i % 2 == 0
        return F.struct(
            F.when(even, F.pmod(l + _round(key, kind, i, r, a), a)).otherwise(l).alias("l"),
            F.when(even, r).otherwise(F.pmod(r + _round(key, kind, i, l, b), b)).alias("r"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), step)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "\\D", "")


def _part(x: Column, start, length) -> Column:
    return F.substring(x, start, length).cast("long")


def _pad(x: Column, n) -> Column:
    return F.lpad(x.cast("string"), n, "0")


def _power(n: Column) -> Column:
    return F.concat(F.lit("1"), F.repeat(F.lit("0"), n)).cast("long")


def _poured(shape: Column, digits: Column) -> Column:
    """shape with its digits replaced, in order, by those given; all else stays."""
    letters = F.split(shape, "")
    put = lambda c, i: F.when(c.rlike("^\\d$"), F.substring(digits, F.length(_digits(F.substring(shape, F.lit(1), i + 1))), F.lit(1))).otherwise(c)
    return F.array_join(F.transform(letters, put), "")


def _luhn_sum(payload: Column) -> Column:
    """The Luhn sum of the digits before the check digit."""
    digits = F.transform(F.split(F.reverse(payload), ""), lambda c, i: let(c.cast("int") * F.when(i % 2 == 0, 2).otherwise(1), lambda d: F.when(d > 9, d - 9).otherwise(d)))
    return F.aggregate(digits, F.lit(0), lambda s, d: s + d)


def _check_digit(payload: Column) -> Column:
    return F.pmod(-_luhn_sum(payload), F.lit(10)).cast("string")


def _card(m: Column, key: str) -> Column:
    def new(d: Column) -> Column:
        payload = F.substring(d, F.lit(1), F.length(d) - 1)
        valid = (F.right(d, F.lit(1)) == _check_digit(payload)) & ~d.rlike("^(\\d)\\1*$")

        def permuted(p: Column) -> Column:
            u = F.floor(F.length(p) / 2).cast("int")
            v = F.length(p) - u
            halves = feistel(_part(p, F.lit(1), u), _part(p, u + 1, v), _power(u), _power(v), key, "card")
            return let(halves, lambda h: let(F.concat(_pad(h["l"], u), _pad(h["r"], v)), lambda q: F.concat(q, _check_digit(q))))

        return F.when(valid, _poured(m, let(payload, permuted)))

    return let(_digits(m), new)


def _mod97(x: Column) -> Column:
    """Letters count as 10 to 35."""
    number = lambda c: F.when(c.rlike("\\d"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(x, ""), F.lit(0), lambda s, c: let(number(c), lambda n: (F.when(n > 9, s * 100).otherwise(s * 10) + n) % 97))


def _iban(m: Column, key: str) -> Column:
    def new(x: Column) -> Column:
        head, body = F.substring(x, 1, 2), F.substring(x, F.lit(5), F.length(x) - 4)
        valid = _mod97(F.concat(body, F.substring(x, 1, 4))) == 1

        def permuted(d: Column) -> Column:
            u = F.floor(F.length(d) / 2).cast("int")
            v = F.length(d) - u
            halves = feistel(_part(d, F.lit(1), u), _part(d, u + 1, v), _power(u), _power(v), key, "iban")
            return let(halves, lambda h: F.concat(F.when(u > 0, _pad(h["l"], u)).otherwise(F.lit("")), _pad(h["r"], v)))

        def whole(b: Column) -> Column:
            check = _pad(98 - _mod97(F.concat(b, head, F.lit("00"))), 2)
            return _poured(m, F.concat(check, _digits(b)))

        digits = _digits(body)
        # a longer run of digits than two longs hold does not occur: an IBAN has 30 at most
        return F.when(valid & (F.length(digits) > 1), let(_poured(body, let(digits, permuted)), whole))

    return let(F.replace(m, F.lit(" "), F.lit("")), new)


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = _part(m, 1, 3), _part(m, 5, 2), _part(m, 8, 4)
    valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    place = F.when(area > 666, area - 2).otherwise(area - 1)
    halves = feistel(place * 99 + group - 1, serial - 1, F.lit(898 * 99), F.lit(9999), key, "ssn")

    def text(h: Column) -> Column:
        a = F.floor(h["l"] / 99)
        return F.concat_ws("-", _pad(F.when(a >= 665, a + 2).otherwise(a + 1), 3), _pad(h["l"] % 99 + 1, 2), _pad(h["r"] + 1, 4))

    return F.when(valid, let(halves, text))


def _phone(m: Column, key: str) -> Column:
    """Area and exchange codes are 200 to 999 without 211, 311, ..., 911: 792 each."""
    place = lambda x: x - 200 - F.floor((x - 111) / 100)
    code = lambda n: n + 200 + F.floor((n + 88) / 99)

    def new(d: Column) -> Column:
        area, exchange, line = _part(F.right(d, F.lit(10)), 1, 3), _part(F.right(d, F.lit(7)), 1, 3), F.right(d, F.lit(4)).cast("long")
        halves = feistel(place(area), place(exchange) * 10000 + line, F.lit(792), F.lit(7920000), key, "phone")
        ten = let(halves, lambda h: F.concat(code(h["l"]).cast("string"), code(F.floor(h["r"] / 10000)).cast("string"), _pad(h["r"] % 10000, 4)))
        return F.when((area % 100 != 11) & (exchange % 100 != 11), _poured(m, F.concat(F.substring(d, F.lit(1), F.length(d) - 10), ten)))

    return let(_digits(m), new)


def _ip(m: Column, key: str) -> Column:
    def new(p: Column) -> Column:
        number = lambda i: p[i].cast("long")
        halves = feistel((number(0) - 1) * 256 + number(1), number(2) * 256 + number(3), F.lit(223 * 256), F.lit(65536), key, "ip")
        return let(halves, lambda h: F.concat_ws(".", (F.floor(h["l"] / 256) + 1).cast("string"), (h["l"] % 256).cast("string"), F.floor(h["r"] / 256).cast("string"), (h["r"] % 256).cast("string")))

    return let(F.split(m, "\\."), new)


def _date(m: Column, key: str) -> Column:
    first = F.to_date(F.lit("1800-01-01"))
    formats = {"-": "yyyy-MM-dd", ".": "dd.MM.yyyy", "/": "MM/dd/yyyy"}

    def read(sign: str) -> Column:
        iso = {"-": m, ".": F.concat_ws("-", F.substring(m, 7, 4), F.substring(m, 4, 2), F.substring(m, 1, 2)), "/": F.concat_ws("-", F.substring(m, 7, 4), F.substring(m, 1, 2), F.substring(m, 4, 2))}[sign]
        return F.datediff(iso.try_cast("date"), first)

    def new(sign: str) -> Column:
        def text(n: Column) -> Column:
            halves = feistel(F.floor(n / 773), n % 773, F.lit(189), F.lit(773), key, "date")
            return F.when((n >= 0) & (n < 189 * 773), let(halves, lambda h: F.date_format(F.date_add(first, (h["l"] * 773 + h["r"]).cast("int")), formats[sign])))

        return let(read(sign), text)

    return F.when(m.contains("-"), new("-")).when(m.contains("."), new(".")).otherwise(new("/"))


def _email(m: Column, key: str) -> Column:
    return F.concat(F.lit("user-"), F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(m)), 256), 1, 12), F.lit("@private.invalid"))


def _segment(s: Column, n: int) -> Column:
    """A part of a text: n is 0 while open, 1 for a pseudonym, 2 for what stays as it is."""
    return F.struct(s.alias("s"), F.lit(n).alias("n"))


def _none() -> Column:
    return F.array().cast("array<struct<s:string,n:int>>")


def _replacement(m: Column, key: str, kinds: tuple[str, ...], invalid: int = 0) -> Column:
    """The pseudonym of a match of the kinds as one segment, or the match itself where it is not valid, then with n invalid."""
    made = {"email": _email, "ip": _ip, "date": _date, "ssn": _ssn, "card": _card, "phone": _phone}
    shape = {
        "email": m.contains("@"), "ip": m.rlike("^\\d+\\.\\d+\\.\\d+\\.\\d+$"), "date": m.rlike("^(\\d{4}-\\d\\d-\\d\\d|\\d\\d[./]\\d\\d[./]\\d{4})$"),
        "ssn": m.rlike("^\\d{3}-\\d\\d-\\d{4}$"), "card": F.length(_digits(m)) > 11, "phone": F.lit(True),
    }
    out = None
    for kind in kinds:
        out = F.when(shape[kind], made[kind](m, key)) if out is None else out.when(shape[kind], made[kind](m, key))
    return let(out, lambda new: F.array(F.when(new.isNotNull(), _segment(new, 1)).otherwise(_segment(m, invalid))))


def _runs(chain: Column, most: int, starts, fits, new) -> Column:
    """Segments of a chain of groups: from the left, at each group the run of whole groups that new() accepts.

    Of several, the first in the order of fits, a number for each run (null: none), ties to the longer.
    """

    def scan(groups: Column) -> Column:
        def step(state: Column, i: Column) -> Column:
            group = F.get(groups, i)

            def best() -> Column:
                runs = F.transform(F.sequence(F.lit(1), F.least(F.lit(most), F.size(groups) - i)), lambda k: F.struct(k.alias("k"), F.rtrim(F.array_join(F.slice(groups, i + 1, k), "")).alias("r")))
                runs = F.transform(runs, lambda x: F.struct(x["k"].alias("k"), F.regexp_replace(x["r"], "-$", "").alias("r")))
                good = F.filter(F.transform(runs, lambda x: F.struct(fits(x["r"]).alias("f"), (-x["k"]).alias("k"), x["r"].alias("r"))), lambda x: x["f"].isNotNull())
                made = F.transform(F.array_sort(good), lambda x: F.struct(x["k"], x["r"], new(x["r"]).alias("new")))
                return F.get(F.filter(made, lambda x: x["new"].isNotNull()), F.lit(0))

            def added(x: Column) -> Column:
                took = F.struct(i.alias("i"), (-x["k"]).alias("k"), x["new"].alias("new"))
                return F.when(x.isNotNull(), F.struct((i - x["k"]).alias("next"), F.concat(state["out"], F.array(took)).alias("out"))).otherwise(state)

            return F.when(i < state["next"], state).otherwise(let(F.when(starts(group), best()), added))

        none = F.array().cast("array<struct<i:int,k:int,new:string>>")
        taken = F.aggregate(F.sequence(F.lit(0), F.size(groups) - 1), F.struct(F.lit(0).alias("next"), none.alias("out")), step)["out"]
        return let(taken, lambda took: written(groups, took))

    def written(groups: Column, took: Column) -> Column:
        """What was taken as pseudonyms, and the groups between as they are; took is small."""
        between = lambda a, b: _segment(F.array_join(F.slice(groups, a + 1, b - a), ""), 0)
        end = lambda x: x["i"] + x["k"]

        def pair(x: Column, j: Column) -> Column:
            sign = F.substring(F.get(groups, end(x) - 1), -1, 1)
            before = F.when(j > 0, end(F.get(took, j - 1))).otherwise(0)
            return F.array(between(before, x["i"]), _segment(x["new"], 1), _segment(F.when(sign.isin(" ", "-"), sign).otherwise(""), 0))

        last = F.when(F.size(took) > 0, end(F.get(took, F.size(took) - 1))).otherwise(0)
        return F.concat(F.flatten(F.transform(took, pair)), F.array(between(last, F.size(groups))))

    return let(F.regexp_extract_all(chain, F.lit("[A-Z0-9]+[ -]?"), F.lit(0)), scan)


def _cards(chain: Column, key: str) -> Column:
    return _runs(chain, 19, lambda g: F.lit(True), lambda r: F.when(F.length(_digits(r)).between(13, 19), 0), lambda r: _card(r, key))


def _ibans(chain: Column, key: str) -> Column:
    lengths = F.create_map(*[F.lit(x) for kv in IBAN_LENGTHS.items() for x in kv])

    def fits(r: Column) -> Column:
        own = F.length(F.replace(r, F.lit(" "), F.lit(""))) == F.try_element_at(lengths, F.substring(r, 1, 2))
        return F.when(r.rlike(f"^{KINDS['iban']}$"), F.when(own, 0).otherwise(1))

    return _runs(chain, 35, lambda g: g.rlike("^[A-Z]{2}\\d{2}"), fits, lambda r: _iban(r, key))


def _swept(segments: Column, pattern: str, new) -> Column:
    """Segments (s, n) after the open ones (n = 0) have had their matches replaced by new(match), an array of segments.

    What new() leaves open is joined with the text beside it, so that a later sweep sees it in its place.
    """

    def joined(pieces: Column, strings: Column, closed: Column) -> Column:
        """The pieces with each stretch of open ones as one; closed has the places of the others. Each piece is copied once."""
        between = lambda a, b: _segment(F.array_join(F.slice(strings, a + 1, b - a), ""), 0)
        after = lambda j: F.coalesce(F.get(closed, j) + 1, F.lit(0))
        pairs = F.transform(closed, lambda x, j: F.array(between(after(j - 1), x), F.get(pieces, x)))
        return F.concat(F.flatten(pairs), F.array(between(after(F.size(closed) - 1), F.size(pieces))))

    def swept(s: Column) -> Column:
        def mixed(found: Column, parts: Column) -> Column:
            pieces = F.flatten(F.zip_with(parts, found, lambda p, f: F.concat(F.array(_segment(p, 0)), F.when(f.isNotNull(), new(f)).otherwise(_none()))))
            places = lambda x: F.filter(F.sequence(F.lit(0), F.size(x) - 1), lambda i: F.get(x, i)["n"] != 0)
            return let(pieces, lambda x: let(x["s"], lambda strings: let(places(x), lambda closed: joined(x, strings, closed))))

        return let(F.regexp_extract_all(s, F.lit(pattern), F.lit(0)), lambda found: let(F.split(s, pattern, -1), lambda parts: mixed(found, parts)))

    return F.flatten(F.transform(segments, lambda x: F.when((x["n"] == 0) & x["s"].rlike(pattern), swept(x["s"])).otherwise(F.array(x))))


def _sweeps(key: str) -> list[tuple]:
    """(pattern, new) of each sweep: kinds of a firm shape go first, each on what the ones before left.

    E-mail and IBANs, then IP addresses, dates and SSNs, cards in their usual shapes, cards in any run
    of whole groups, phones. What has the shape of a date or an SSN is no part of a card, valid or not.
    """
    firm = ("ip", "date", "ssn")
    return [
        (KINDS["email"], lambda m: _replacement(m, key, ("email",))),
        (IBAN_CHAIN, lambda m: _ibans(m, key)),
        ("|".join(KINDS[k] for k in firm), lambda m: _replacement(m, key, firm, 2)),
        (CARD, lambda m: _replacement(m, key, ("card",))),
        (CARD_CHAIN, lambda m: _cards(m, key)),
        (KINDS["phone"], lambda m: _replacement(m, key, ("phone",))),
    ]


def pseudonymize(docs: DataFrame, text_col: str = "text", key: str | None = None, count_col: str | None = "n_private") -> DataFrame:
    """docs with the text's personal data replaced, and count_col, how many were.

    Null texts stay null, texts without valid personal data stay as they are to the byte. All rows and
    other columns stay, repeated rows each on their own; a column named count_col is replaced. An empty
    table stays empty. ``key`` is a secret: who has it can undo all kinds but email. Without one,
    the session's KEY_SETTING counts.
    """
    text, key = F.col(text_col), key or docs.sparkSession.conf.get(KEY_SETTING, KEY)
    sweeps = _sweeps(key)
    own = unused(docs, "segments")
    # most texts have neither digit nor @ and end at the first test; their segments are null
    seen = text.rlike("[0-9@]") & text.rlike("|".join(p for p, _ in sweeps))
    out = docs.withColumn(own, F.when(seen, F.array(_segment(text, 0))))
    for pattern, new in sweeps:  # a column each: nested in one expression they exceed the analyzer's iterations
        out = out.withColumn(own, _swept(F.col(own), pattern, new))
    total = F.aggregate(own, F.lit(0).cast("long"), lambda n, x: n + (x["n"] == 1).cast("long"))
    out = out.withColumn(text_col, F.when(F.col(own).isNull(), text).otherwise(F.array_join(F.col(own)["s"], "")))
    if count_col:
        out = out.withColumn(count_col, F.coalesce(total, F.lit(0).cast("long")))
    return out.drop(own)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with pseudonyms for personal data."""
    return pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op3_pii": op3_pii}
SQL: dict[str, str] = {}
