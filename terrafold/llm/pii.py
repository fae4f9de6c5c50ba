"""Personal data by anchor expansion (op2).

One Aho-Corasick automaton finds anchors: at-signs, schemes, plus signs, digits and cue words.  At each anchor a local
parser expands to the left and right and validates the boundary.  Base kinds (email, ip, card, phone) are the leftmost
non-overlapping matches of their patterns, where a match that fails validation is dropped and not retried.  Every such
match begins at an anchor: an e-mail's at-sign, a plus sign, or the first digit of a run, as no match can begin later in
a run of digits where it can't begin at its first.

Added kinds.  address: street lines in the forms of four languages (number, names and a street word; street and number;
number, street word and names; street word, names and number), with a postcode and town that follow.  account: IBANs of
their country's length with valid check digits; after a cue, bank accounts of 6 to 17 digits, routing numbers with a
valid check sum, passport and social security numbers of their form.  A number is taken whole or not at all: one that is
longer, or runs on into a letter, is none, and words between cue and number other than those that lead to it end the
search.  handle: credentials in urls, and e-mails written with (at) and (dot).  secret: values assigned to a cue such as
token or password, with letters and digits.

Parsers never look back behind the previous match of their kind, and each reads a run of characters a fixed number of
times, so the work is linear in the text.  Defined results: null or empty text has no spans; rows are judged one by
one, so repeated ids and ties need no rule; offsets are code points of the original text, end exclusive.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "address", "account", "handle", "secret")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = frozenset("0123456789")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_USERINFO = re.compile(r"[A-Za-z0-9._~%!$&'*+-]++(?::[^\s/@?#]*+)?@[A-Za-z0-9.-]+")
_SPELLED = re.compile(r"[A-Za-z0-9-]+(?: ?[(\[]dot[)\]] ?[A-Za-z0-9-]{2,}|\.[A-Za-z0-9-]{2,})+(?![A-Za-z0-9])", re.I)

#: The length of an IBAN by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28,
    "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26,
    "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30,
    "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23,
    "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}

#: Cue words and what follows them.
_CUES = {"account": "bank", "acct": "bank", "konto": "bank", "kontonummer": "bank", "compte": "bank", "cuenta": "bank", "routing": "routing", "aba": "routing", "passport": "passport", "reisepass": "passport", "passeport": "passport", "pasaporte": "passport", "ssn": "social", "social security": "social"}
_LEADS = re.compile(r"(?:\s{0,3}(?:number|nummer|num[ée]ro|número|num|no|nr|n[°º]|is|ist|est|es|[:#=])(?![a-z])\.?){0,3}\s{0,3}", re.I)
_NUMBER = {
    "bank": re.compile(r"[0-9](?:[ -]?[0-9])*+(?![A-Za-z0-9])"),
    "routing": re.compile(r"[0-9]{9}(?![A-Za-z0-9])"),
    "passport": re.compile(r"(?:[A-Z]{1,2}[0-9]{6,8}|[0-9]{9})(?![A-Za-z0-9])"),
    "social": re.compile(r"(?!000|666|9)[0-9]{3}([ -]?)(?!00)[0-9]{2}\1(?!0000)[0-9]{4}(?![A-Za-z0-9])"),
}
_SECRETS = ("token", "secret", "password", "passwd", "pwd", "api_key", "api-key", "api key", "apikey", "access_key", "access key", "private_key")
_VALUE = re.compile(r"""["'`]?\s{0,3}(?:=>|:=|[=:])\s{0,3}["'`]?([^\s"'`,;<>]{8,}+)""")

#: Words of street addresses.
_STREETS = ("Street", "St", "Avenue", "Ave", "Road", "Rd", "Boulevard", "Blvd", "Lane", "Ln", "Drive", "Dr", "Court", "Ct", "Square", "Sq", "Place", "Pl", "Terrace", "Way", "Highway", "Hwy", "Parkway", "Pkwy", "Crescent", "Close")
_ENDINGS = ("straße", "strasse", "str.", "weg", "platz", "allee", "gasse", "ring", "damm", "ufer")
_VOIES = ("rue", "avenue", "boulevard", "place", "chemin", "impasse", "allée", "quai", "route", "cours", "passage")
_VIAS = ("Calle", "C/", "Avenida", "Avda.", "Av.", "Plaza", "Paseo", "Camino", "Carretera", "Ronda")
_NAME = r"[A-ZÀ-ÖØ-Þ][\w'’.-]*+"
_PART = r"(?:de la|de los|de las|del|des|de|du|la|le|les|los|las|y|et) |(?:de l|d|l)['’]"
_TOWN = rf"(?:, ?[0-9]{{4,5}} {_NAME}(?: {_NAME}){{0,2}})?"
_AFTER_STREET = re.compile(rf"\.?(?![\w])(?:,? (?:Apt|Apartment|Suite|Ste|Unit|Floor)\.? ?[A-Za-z0-9-]{{1,6}}(?!\w))?(?:, {_NAME}(?: {_NAME}){{0,2}}, [A-Z]{{2}} [0-9]{{5}}(?:-[0-9]{{4}})?(?!\w))?")
_HOUSE = re.compile(rf" [0-9]{{1,4}}(?: ?[a-z](?!\w))?(?:-[0-9]{{1,4}})?(?!\w){_TOWN}")
_AFTER_VOIE = re.compile(rf" (?:{_PART}){{0,3}}{_NAME}(?:[ -](?:{_PART})?{_NAME}){{0,3}}{_TOWN}")
_AFTER_VIA = re.compile(rf" ?(?:{_PART}){{0,3}}{_NAME}(?: (?:{_PART})?{_NAME}){{0,3}},? (?:n\.?[º°] ?|núm\. ?|número )?[0-9]{{1,4}}(?!\w){_TOWN}")
_NUMBER_BEFORE = re.compile(r"(?<![\w.,-])[0-9]{1,6}(?:[A-Za-z]| bis| ter)?,? $")
_ORDINAL = re.compile(r"[0-9]{1,4}(?:st|nd|rd|th)$")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def iban_end(text: str, at: int) -> int | None:
    """The end of the IBAN that begins at its country's letters, single spaces allowed; None if none does."""
    length = IBAN_LENGTHS.get(text[at : at + 2])
    if length is None or (at and text[at - 1].isalnum()):
        return None
    code, end = [], at
    while len(code) < length and end < len(text):
        c = text[end]
        if c.isascii() and (c.isdigit() or c.isupper()):
            code.append(c)
        elif c != " " or text[end - 1] == " ":
            return None
        end += 1
    if len(code) < length or text[end : end + 1].isalnum():
        return None
    return end if int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1 else None


def numbered_after(text: str, at: int, kind: str) -> tuple[int, int] | None:
    """The number that a cue ending at `at` leads to, if it has the form of its kind."""
    m = _NUMBER[kind].match(text, _LEADS.match(text, at).end())
    if not m:
        return None
    digits = [int(c) for c in m[0] if c in _DIGITS]
    if kind == "bank" and not 6 <= len(digits) <= 17:
        return None
    if kind == "routing" and sum(d * w for d, w in zip(digits, (3, 7, 1) * 3, strict=True)) % 10:
        return None
    return m.span()


def street_before(text: str, at: int, least: int) -> int | None:
    """Where an address begins whose street word follows the space at `at`: a number and one to four names."""
    names = 0
    while names < 5:
        begin = text.rfind(" ", max(least, at - 41), at) + 1
        if begin <= least and not (begin == 0 and least == 0 and text[:1].isdigit() and names):
            begin = max(begin, least)
        word = text[begin:at]
        if not word or len(word) > 40:
            return None
        if names and re.fullmatch(r"[0-9]{1,6}[A-Za-z]?,?", word):
            return begin
        if not (word[0].isupper() or _ORDINAL.match(word)) or begin <= least:
            return None
        names, at = names + 1, begin - 1
    return None


def address_at(text: str, what: str, a: int, b: int, least: int) -> tuple[int, int] | None:
    """The address around a street word at a to b (exclusive)."""
    if what == "street":
        m = _AFTER_STREET.match(text, b)
        start = street_before(text, a - 1, least) if m and a and text[a - 1] == " " else None
        return None if start is None else (start, m.end())
    if what == "ending":
        m = _HOUSE.match(text, b)
        if not m:
            return None
        begin = text.rfind(" ", max(least, a - 41), b) + 1
        begin = max(begin, least)
        if not text[begin].isupper():
            return None
        if begin == a:  # the ending is a word of its own: one name before it belongs to it
            before = max(text.rfind(" ", max(least, begin - 42), begin - 1) + 1, least)
            if before >= begin - 1 or not text[before].isupper():
                return None
            begin = before
        return begin, m.end()
    if what == "voie":
        m = _AFTER_VOIE.match(text, b)
        before = _NUMBER_BEFORE.search(text, max(least, a - 13), a) if m and a and text[a - 1] == " " else None
        return (before.start(), m.end()) if before else None
    m = _AFTER_VIA.match(text, b)
    return (a, m.end()) if m and not (a and text[a - 1].isalnum()) else None


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for c in "0123456789":
        a.add_word(c, ("digit", 1, None))
    a.add_word("@", ("at", 1, None))
    a.add_word("+", ("plus", 1, None))
    a.add_word("://", ("scheme", 3, None))
    for what, words in (("street", _STREETS), ("ending", _ENDINGS), ("voie", _VOIES), ("via", _VIAS)):
        for word in words:
            for form in {word, word.capitalize()} if what in ("ending", "voie") else (word,):
                follows = " " if what != "street" else ""
                a.add_word(form + follows if what != "via" else form, ("address", len(form + follows) if what != "via" else len(form), what))
    for word, kind in _CUES.items():
        for form in (word, word.capitalize(), word.upper()):
            a.add_word(form, ("account", len(form), kind))
    for word in _SECRETS:
        for form in (word, word.capitalize(), word.upper()):
            a.add_word(form, ("secret", len(form), None))
    for word in ("(at)", "[at]", "(AT)", "[AT]"):
        a.add_word(word, ("spelled", 4, None))
    a.make_automaton()
    return a


def find(text: str, anchors: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind as listed."""
    spans = []
    past = dict.fromkeys(KINDS, 0)  # the end of the last match of a kind, kept or failed
    run = -2  # the last digit seen, to tell where runs begin

    def put(kind, a, b, good=True):
        past[kind] = b
        if good:
            spans.append((a, b, kind))

    for last, (what, n, of) in anchors.iter(text):
        at = last - n + 1
        if what == "digit":
            begins, run = last != run + 1, last
            if not begins:
                continue
            if at >= past["ip"] and (m := _IP.match(text, at)):
                put("ip", at, m.end(), all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")))
            if at >= past["card"] and (m := _CARD.match(text, at)):
                digits = m[0].replace(" ", "").replace("-", "")
                put("card", at, m.end(), 12 <= len(digits) <= 19 and luhn(digits))
            if at - 2 >= past["account"] and text[at - 2 : at].isupper() and (end := iban_end(text, at - 2)):
                put("account", at - 2, end)
        elif what == "at":
            a = at
            while a > past["email"] and text[a - 1] in _LOCAL:
                a -= 1
            if a < at and (m := _DOMAIN.match(text, at + 1)):
                put("email", a, m.end())
        elif what == "plus":
            if at >= past["phone"] and (m := _PHONE.match(text, at)):
                put("phone", at, m.end(), 9 <= sum(c in _DIGITS for c in m[0]) <= 15)
        elif what == "scheme":
            if at >= past["handle"] and (m := _USERINFO.match(text, last + 1)):
                put("handle", last + 1, m.end())
        elif what == "address":
            end = last + 1 if of in ("street", "via") else last
            if at >= past["address"] and (span := address_at(text, of, at, end, past["address"])):
                put("address", *span)
        elif what == "account":
            if at >= past["account"] and not (at and text[at - 1].isalnum()) and (span := numbered_after(text, last + 1, of)):
                put("account", *span)
        elif what == "secret":
            if at >= past["secret"] and not (at and text[at - 1].isalnum()) and (m := _VALUE.match(text, last + 1)):
                put("secret", *m.span(1), any(c in _DIGITS for c in m[1]) and any(c.isalpha() for c in m[1]))
        else:
            a = at - (text[at - 1 : at] == " ")
            start = a
            while start > past["handle"] and text[start - 1] in _LOCAL:
                start -= 1
            after = last + 1 + (text[last + 1 : last + 2] == " ")
            if start < a and (m := _SPELLED.match(text, after)):
                put("handle", start, m.end())
    spans.sort(key=lambda s: (s[0], KINDS.index(s[2])))
    return spans


def _joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


_OUT = pa.schema([("doc_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in BASE], ("base_sha256", pa.string()), ("spans", pa.string()), ("n_spans", pa.int64())])


def personal_data(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256 (digest of the base spans), spans (all), n_spans (how many)."""
    small_batches(docs.sparkSession)

    def scan(batches):
        anchors = automaton()
        for b in batches:
            rows = []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                spans = find(text, anchors) if text else []
                base = [s for s in spans if s[2] in BASE]
                counts = [sum(s[2] == k for s in base) for k in BASE]
                rows.append([i, *counts, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans), len(spans)])
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_OUT)], schema=_OUT)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scan, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")
