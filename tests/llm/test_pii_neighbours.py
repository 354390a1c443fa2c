"""Numbers directly before and after a card or an IBAN, and other kinds beside them."""

from docsync_spark.llm import pii
from tests.llm.test_pii import replace


class Match:
    def __init__(self, x):
        self.x = x

    def __getitem__(self, _):
        return self.x


CARD, SPACED, IBAN, LONG, PHONE, SSN = "4785380592391139", "4785 3805 9239 1139", "ES9121000418450200051332", "DE89 3704 0044 0532 0130 00", "743-555-3824", "123-45-6789"
SHAPES = ["card {} 12/27", "{} 123", "12 {}", "2024 12 {} end", "{} 12-abc", "{} 12th", "7 {} 8 9", "{}"]
IBANS = ["{} 2024", "AB12 {}", "{} CALL NOW", "{} 12 2024.", "{}"]


def cases():
    out = [(s.format(x), s.format(replace(Match(x))), 1) for s in SHAPES for x in (CARD, SPACED)]
    out += [(s.format(x), s.format(replace(Match(x))), 1) for s in IBANS for x in (IBAN, LONG)]
    for a, b in [(CARD, PHONE), (PHONE, CARD), (CARD, SSN), (IBAN, CARD), (CARD, "1990-02-28"), (LONG, SPACED)]:
        out.append((f"{a} {b}", f"{replace(Match(a))} {replace(Match(b))}", 2))
    return out


def test_neighbours_do_not_hide_numbers(spark):
    want = cases()
    docs = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(want)], "doc_id long, text string")
    got = {r["doc_id"]: (r["text"], r["n_private"]) for r in pii.pseudonymize(docs).collect()}
    assert [(t, *got[i]) for i, (t, _, _) in enumerate(want)] == want
