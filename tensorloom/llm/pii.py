r"""Personal data: patterns propose spans, checksums confirm them, nearby words move the score.

Every span has a score of 100: its kind's own, ``CONTEXT`` more if a word of the kind's context is
near (40 code points before it, 24 after, not beyond the neighbouring matches of its kind), and as
much less if a word is near that speaks against it. Kinds ``email``, ``ip``, ``card`` and ``phone``
are the base: every match that passes its check is a span, whatever its score, which tells the sure
ones (``LEAST`` and more) from the others. ``iban`` and ``ssn`` are added: an IBAN must have its
country's length and a remainder of 1 by 97, and an added span needs a score of ``LEAST``, so an
``ssn`` is one by its context alone. Every place where an IBAN could start is tried, so what stands
before or after an IBAN cannot hide it.

All on DataFrame functions, in one pass over the text without a shuffle. A cheap test (a character
or a short pattern) goes before each full pattern, so most texts are only looked at once. The
patterns run in linear time: they start only where a run of their first class starts.

Defined results: a null text counts as empty and has no spans. Rows are independent, so repeated
rows get equal results; an empty table gives an empty one. Places are code points, end exclusive.
A text of any length is read whole. Extra columns are not read by :func:`scan`; :func:`redact` hands
them on whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tensorloom.llm.scratch import blank
from tensorloom.llm.spans import AFTER, bind, masked, matches, nothing

SPAN = "array<struct<kind:string,start:int,end:int,text:string,score:int>>"
#: The score that an added span needs, of 100.
LEAST = 70
#: What a context word adds to the score, or takes off it.
CONTEXT = 30

_LOCAL = r"[A-Za-z0-9._%+-]"
_OCTET = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
#: IBAN lengths by country (fixed values of the public registry).
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18,
    "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IS": 26,
    "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28,
    "PT": 25, "RO": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TR": 26,
}


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def step(acc: Column, i: Column) -> Column:
        d = digits.substr(F.length(digits) - i, F.lit(1)).cast("int")
        twice = d * 2
        return acc + F.when(F.pmod(i, F.lit(2)) == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.pmod(F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), step), F.lit(10)) == 0


def mod97(iban: Column) -> Column:
    """The remainder by 97 of an IBAN without blanks, its first four characters moved to the end."""
    turned = F.concat(iban.substr(F.lit(5), F.length(iban)), iban.substr(F.lit(1), F.lit(4)))

    def step(acc: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, F.pmod(acc * 100 + code - 55, F.lit(97))).otherwise(F.pmod(acc * 10 + code - 48, F.lit(97)))

    return bind(turned, lambda s: F.aggregate(F.split(s, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise(step(a, c))))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _card(m: Column) -> Column:
    return bind(F.translate(m, " -", ""), lambda d: F.when(F.length(d).between(16, 19), luhn(d)).otherwise(F.lit(False)))


def _iban(m: Column) -> Column:
    return bind(F.translate(m, " ", ""), lambda s: F.when(s == "", F.lit(False)).otherwise(mod97(s) == 1))


def _ibans(form: str) -> str:
    """One alternative for each length of ``IBAN_LENGTHS``; ``form`` has ``{of}`` countries and ``{n}`` characters after the check digits."""
    by_length = {n: "|".join(sorted(c for c in IBAN_LENGTHS if IBAN_LENGTHS[c] == n)) for n in sorted(set(IBAN_LENGTHS.values()))}
    return "|".join(form.format(of=of, n=n - 4) for n, of in by_length.items())


_REST = r"(?:\x20?[A-Z0-9]){{{n}}}+(?![A-Za-z0-9])"


@dataclass(frozen=True)
class Kind:
    """``hint`` is a cheap test that every text with a match passes; ``start`` is the score of a
    match that passed ``valid``; ``context`` and ``against`` hold words that raise and lower it when
    near. With ``whole``,
    ``pattern`` only finds the starts, and ``whole`` is matched from each of them."""

    name: str
    pattern: str
    hint: Callable[[Column], Column]
    valid: Callable[[Column], Column]
    start: int
    context: str
    against: str
    base: bool = True
    whole: str | None = None


KINDS = (
    Kind(
        "email", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        lambda t: t.contains("@"), lambda m: F.lit(True), 70, "mail|contact|write", "example|no-?reply",
    ),
    Kind(
        "ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        lambda t: t.rlike(r"[0-9]\.[0-9]"), lambda m: m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"), 60, r"(?:^|[^a-z0-9])ip(?:[^a-z0-9]|$)|address|server|host", "version|release|chapter",
    ),
    Kind(
        "card", r"[0-9](?:[\x20-]?[0-9]){15,}+",
        lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"), _card, 70, "card|visa|credit|pay", "order|serial|tracking",
    ),
    Kind(
        "phone", r"\+[0-9][\x20().0-9-]+[0-9]",
        lambda t: t.contains("+"), lambda m: F.length(_digits(m)).between(8, 15), 60, "call|phone|mobil|tel", "order|serial|tracking",
    ),
    Kind(
        "iban", rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{_ibans('(?:{of})[0-9]{{2}}(?=' + _REST + ')')})",
        lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]"), _iban, 80, "iban|account|bank", "sample|serial", base=False,
        whole=rf"^(?:{_ibans('(?:{of})[0-9]{{2}}' + _REST)})",
    ),
    Kind(
        "ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
        lambda t: t.rlike(r"[0-9]-[0-9]{2}-[0-9]"), lambda m: ~m.rlike("^(?:000|666|9)|-00-|-0000$"), 50, r"(?:^|[^a-z0-9])ssn(?:[^a-z0-9]|$)|social security", "order|serial|tracking", base=False,
    ),
)
BASE = tuple(k.name for k in KINDS if k.base)


#: Code points in which a ``whole`` match ends, with the one after it: the longest IBAN with a blank before each character.
_REACH = 2 * max(IBAN_LENGTHS.values())


def _wholes(text: Column, kind: Kind) -> Column:
    """The matches of a kind; those of ``whole`` may overlap."""
    found = matches(text, kind.pattern)
    if kind.whole is None:
        return found

    def from_start(m: Column) -> Column:
        def one(w: Column) -> Column:
            end = m["start"] + F.length(w)
            after = text.substr(end + 1, F.lit(AFTER))
            return F.struct(m["start"].alias("start"), end.alias("end"), w.alias("text"), m["before"].alias("before"), after.alias("after"))

        return bind(F.regexp_extract(text.substr(m["start"] + 1, F.lit(_REACH)), kind.whole, 0), one)

    return F.transform(found, from_start)


def _spans(text: Column, kind: Kind) -> Column:
    def scored(m: Column) -> Column:
        near = F.lower(F.concat_ws(" ", m["before"], m["after"]))
        moved = lambda words: F.when(near.rlike(words), F.lit(CONTEXT)).otherwise(F.lit(0))
        return F.struct(
            F.lit(kind.name).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), m["text"].alias("text"),
            (F.lit(kind.start) + moved(kind.context) - moved(kind.against)).alias("score"),
        )

    found = F.transform(F.filter(_wholes(text, kind), lambda m: kind.valid(m["text"])), scored)
    found = found if kind.base else F.filter(found, lambda s: s["score"] >= LEAST)
    return F.when(kind.hint(text), found.cast(SPAN)).otherwise(nothing(SPAN))


def spans(text: Column) -> Column:
    """All spans of a text: array of (kind, start, end, text, score) by kind as listed, then start."""
    return bind(blank(text), lambda t: F.concat(*[_spans(t, k) for k in KINDS]))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and ``spans``: one row per row of ``docs``."""
    return docs.select(F.col(key), spans(F.col(text)).alias("spans"))


def redact(docs: DataFrame, text: str = "text", length: str | None = None) -> DataFrame:
    """``docs`` with each span in ``text`` replaced by its kind, as in ``<EMAIL>``.

    A null text stays null. ``length`` names a column that holds the text's length in code points
    and is set anew in rows that changed.
    """
    row = F.struct(*[docs[c].alias(c) for c in docs.columns])
    found = docs.select(row.alias("row"), spans(docs[text]).alias("spans"))
    old = F.col("row").getField(text)
    found = found.select("row", F.when(F.size("spans") > 0, masked(old, F.col("spans"))).otherwise(old).alias("new"), (F.size("spans") > 0).alias("changed"))
    field = {text: F.col("new")}
    if length in docs.columns:
        field[length] = F.when(F.col("changed"), F.length("new").cast(docs.schema[length].dataType)).otherwise(F.col("row").getField(length))
    return found.select(*[field.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
