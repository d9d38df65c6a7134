"""Personal data: format-preserving Feistel pseudonyms for validated values.

Found are e-mail addresses, payment cards (Luhn), phone numbers, social security numbers, IBANs (mod 97), IPv4
addresses, calendar dates and long hexadecimal secrets that follow a key word. Each value that passes its
validation is replaced by one of the same format: its digits or letters, read as a number, go through a keyed
Feistel permutation of the values of that format, walked on until the result is valid again; separators, lengths of
every part, letter case and check digits fit. Equal values have equal pseudonyms in all documents, different values
different ones, and the holder of the key can invert them (``inverse``). Values that fail validation stay as they are.

A date's format is its order (year first, day first, or month first, which is only known where the day is above 12)
and the number of digits of month and day; an address' is the number of digits of its parts. Dates of the formats that hold all
days (two digits, year or day first) share one permutation, so that a day has one pseudonym in both.

Defined results: a null text stays null with nothing found; rows that repeat are treated alike; other
columns pass through, but for n_found and kinds, which are replaced; an empty table gives no rows; texts are read whole.
"""

from __future__ import annotations

import datetime
import functools
import hashlib
import math
import re
from collections import Counter
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnower.llm.shared import free_name, small_batches


@dataclass(frozen=True)
class Pseudonyms:
    """The secret key, and whether pseudonyms are made or turned back."""

    key: bytes
    inverse: bool = False
    rounds: int = 10

    def __post_init__(self) -> None:
        if not self.key:
            raise ValueError("pseudonyms need a secret key")


def permute(value: int, size: int, tweak: str, p: Pseudonyms) -> int:
    """A keyed permutation of range(size): Feistel over two halves, walked on while the result is out of range."""
    inverse = p.inverse
    if size < 2:
        return value
    low = math.isqrt(size - 1) + 1
    while True:
        a, b = divmod(value, low)
        for i in reversed(range(p.rounds)) if inverse else range(p.rounds):
            if inverse:
                a, b = (b - _mix(a, i, tweak, p)) % low, a
            else:
                a, b = b, (a + _mix(b, i, tweak, p)) % low
        value = a * low + b
        if value < size:
            return value


def _mix(half: int, i: int, tweak: str, p: Pseudonyms) -> int:
    return int.from_bytes(hashlib.blake2b(f"{i}|{tweak}|{half}".encode(), key=p.key[:64], digest_size=32).digest(), "big")


def _string(text: str, alphabet: str, tweak: str, p: Pseudonyms) -> str:
    n = len(alphabet)
    value = 0
    for c in text:
        value = value * n + alphabet.index(c)
    value = permute(value, n ** len(text), f"{tweak}|{n}|{len(text)}", p)
    out = []
    for _ in text:
        value, r = divmod(value, n)
        out.append(alphabet[r])
    return "".join(reversed(out))


_LETTERS, _DIGITS, _HEX = "abcdefghijklmnopqrstuvwxyz", "0123456789", "0123456789abcdef"


def _fill(form: str, chars: str) -> str:
    """``chars`` in place of the letters and digits of ``form``, in its case."""
    rest = iter(chars)
    return "".join((c2.upper() if c.isupper() else c2) if c.isalnum() and (c2 := next(rest)) else c for c in form)


def luhn(digits: str) -> int:
    """The sum that is divisible by 10 for a valid number."""
    return sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits)))


def _card(m: str, p: Pseudonyms) -> str | None:
    digits = re.sub(r"\D", "", m)
    if not 13 <= len(digits) <= 19 or luhn(digits) % 10 or len(set(digits)) == 1:
        return None
    body = digits[0] + _string(digits[1:-1], _DIGITS, f"card{digits[0]}", p)
    return _fill(m, body + str(-luhn(body + "0") % 10))


def _valid_national(d: str) -> bool:
    return d[0] in "23456789" and d[3] in "23456789"


def _phone(m: str, p: Pseudonyms) -> str | None:
    """A prefix or brackets mark a phone number; bare groups of digits need valid area and exchange codes."""
    digits = re.sub(r"\D", "", m)
    head, tail = digits[:-10], digits[-10:]
    if len(tail) < 10 or len(head) > 3 or not (m[0] == "+" or "(" in m or _valid_national(tail)):
        return None
    new = _string(tail, _DIGITS, "phone", p)
    while _valid_national(new) != _valid_national(tail):  # valid codes stay valid, others stay what they are
        new = _string(new, _DIGITS, "phone", p)
    return _fill(m, head + new)


def _valid_ssn(d: str) -> bool:
    return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"


def _ssn(m: str, p: Pseudonyms) -> str | None:
    new = re.sub(r"\D", "", m)
    if not _valid_ssn(new):
        return None
    new = _string(new, _DIGITS, "ssn", p)
    while not _valid_ssn(new):
        new = _string(new, _DIGITS, "ssn", p)
    return _fill(m, new)


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


#: Lengths by country. Other countries' numbers may have any length from 15 to 34.
_IBAN_LENGTHS = {
    x[:2]: int(x[2:])
    for x in (
        "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 "
        "GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 "
        "PS29 PT25 QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20"
    ).split()
}


def _iban_part(m: str) -> str:
    """The start of ``m``, up to the end of a word, that is valid: of its country's length if one is, else the longest; empty if none is."""
    parts = [m[:i] for i in range(len(m), 0, -1) if m[i : i + 1] in ("", " ")]
    parts.sort(key=lambda x: len(x.replace(" ", "")) != _IBAN_LENGTHS.get(x[:2]))
    return next((x for x in parts if 15 <= len(x.replace(" ", "")) <= 34 and _mod97(x.replace(" ", "")) == 1), "")


def _iban(m: str, p: Pseudonyms) -> str | None:
    text = m.replace(" ", "")
    body, at = list(text[4:].lower()), text[4:]
    for alphabet in (_LETTERS, _DIGITS):
        places = [i for i, c in enumerate(body) if c in alphabet]
        for i, c in zip(places, _string("".join(body[i] for i in places), alphabet, f"iban{text[:2]}", p) if places else "", strict=True):
            body[i] = c
    new = text[:2] + "00" + "".join(body).upper()
    return _fill(m, new[:2] + f"{98 - _mod97(new):02d}" + new[4:]) if at else None


#: The values of an address' parts of one, two and three digits.
_OCTETS = {1: range(10), 2: range(10, 100), 3: range(100, 256)}


def _ip(m: str, p: Pseudonyms) -> str | None:
    parts = m.split(".")
    spans = [_OCTETS[len(x)] for x in parts]
    if any(int(x) not in span for x, span in zip(parts, spans, strict=True)):
        return None
    value, size = 0, 1
    for x, span in zip(parts, spans, strict=True):
        value, size = value * len(span) + int(x) - span[0], size * len(span)
    value = permute(value, size, "ip" + "".join(str(len(x)) for x in parts), p)
    out = []
    for span in reversed(spans):
        value, r = divmod(value, len(span))
        out.append(str(span[r]))
    return ".".join(reversed(out))


_FIRST, _DAYS = datetime.date(1900, 1, 1).toordinal(), datetime.date(2100, 1, 1).toordinal() - datetime.date(1900, 1, 1).toordinal()


def _date(m: str, p: Pseudonyms) -> str | None:
    a, sign, b, _, c = re.split(r"([-/.])", m)
    month_first = len(a) != 4 and sign == "/" and int(b) > 12
    y, mo, d = (a, b, c) if len(a) == 4 else (c, a, b) if month_first else (c, b, a)
    try:
        at = datetime.date(int(y), int(mo), int(d)).toordinal() - _FIRST
    except ValueError:
        return None
    if not 0 <= at < _DAYS:
        return None
    while True:  # on to a day that is written in the same format
        at = permute(at, _DAYS, "date", p)
        new = datetime.date.fromordinal(at + _FIRST)
        if (len(mo) == 2 or new.month < 10) and (len(d) == 2 or new.day < 10) and (not month_first or new.day > 12):
            break
    y2, mo2, d2 = str(new.year), f"{new.month:0{len(mo)}d}", f"{new.day:0{len(d)}d}"
    return sign.join((y2, mo2, d2) if len(a) == 4 else (mo2, d2, y2) if month_first else (d2, mo2, y2))


def _email(m: str, p: Pseudonyms) -> str:
    local, _, domain = m.partition("@")
    names = domain.split(".")
    parts = []
    for what, part in (("local", local), *(("domain", x) for x in names[:-1])):
        low = part.lower()
        new = list(part)
        for alphabet in (_LETTERS, _DIGITS):
            places = [i for i, c in enumerate(low) if c in alphabet]
            if places:
                for i, c in zip(places, _string("".join(low[i] for i in places), alphabet, f"{what}|{re.sub('[a-z]', 'a', re.sub('[0-9]', '0', low))}", p), strict=True):
                    new[i] = c.upper() if part[i].isupper() else c
        parts.append("".join(new))
    return parts[0] + "@" + ".".join([*parts[1:], names[-1]])


def _secret(m: str, p: Pseudonyms) -> str:
    return _fill(m, _string(m.lower(), _HEX, "secret", p))


_EMAIL = r"(?P<email>(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,})"
_SECRET = r"(?:\b(?:token|secret|passw(?:or)?d|api[_ -]?key|access[_ -]?key)[\"']?\s*[=:]\s*[\"']?)(?P<secret>[0-9a-f]{16,128})\b"
_NUMBERS = (
    r"(?P<ip>(?<![\w.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\w]|\.\d))"
    r"|(?P<date>(?<![\w./-])(?:\d{4}(?P<s1>[-/.])\d{1,2}(?P=s1)\d{1,2}|\d{1,2}(?P<s2>[-/.])\d{1,2}(?P=s2)\d{4})(?![\w]|[-/.]\d))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w]|-\d))"
    r"|(?P<card>(?<![\w])(?:\d{4}[ -]?){3}\d{1,7}(?![\w]))"
    r"|(?P<phone>(?<![\w.+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\w])|(?<![\w])\+\d{11,13}(?![\w]))"
    r"|(?P<iban>(?-i:\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b))"
)
_KEY_WORD = re.compile(r"token|secret|passw|api|access", re.IGNORECASE | re.ASCII)
#: Every value of these kinds holds two digits that follow each other, or one behind a sign that joins its parts.
_NUMBER = re.compile(r"[0-9][0-9]|[0-9][./-][0-9]", re.ASCII)


@functools.cache
def _finder(email: bool, secret: bool, numbers: bool) -> re.Pattern | None:
    """The values that a text can hold, by what it has: an at sign, a key word, digits."""
    parts = [p for p, there in ((_EMAIL, email), (_SECRET, secret), (_NUMBERS, numbers)) if there]
    return re.compile("|".join(parts), re.IGNORECASE | re.ASCII) if parts else None


_MAKERS = {"email": _email, "secret": _secret, "ip": _ip, "date": _date, "ssn": _ssn, "card": _card, "phone": _phone, "iban": _iban}


def pseudonymise(text: str, p: Pseudonyms) -> tuple[str, Counter]:
    """The text with its personal data replaced, and the number of values by kind."""
    found: Counter = Counter()
    out, done, at = [], 0, 0
    finder = _finder("@" in text, _KEY_WORD.search(text) is not None, _NUMBER.search(text) is not None)
    while finder and (m := finder.search(text, at)):
        kind = next(k for k, value in m.groupdict().items() if value and k in _MAKERS)
        value = _iban_part(m.group(kind)) if kind == "iban" else m.group(kind)
        new = _MAKERS[kind](value, p) if value else None
        if new is None:  # a valid value may begin inside a candidate that is none
            at = m.start() + 1
            continue
        found[kind] += 1
        at = m.start(kind) + len(value)
        out += text[done : m.start(kind)], new
        done = at
    return "".join(out) + text[done:], found


def hide_personal_data(docs: DataFrame, p: Pseudonyms) -> DataFrame:
    """``docs`` with its text replaced, and the columns n_found and kinds (such as ``card:1,email:2``)."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("text string, n_found long, kinds string")
    def hidden(texts: pd.Series) -> pd.DataFrame:
        out, n, kinds = list(texts), [0] * len(texts), [""] * len(texts)
        for i, text in enumerate(out):
            if text:
                out[i], found = pseudonymise(text, p)
                n[i], kinds[i] = found.total(), ",".join(f"{k}:{c}" for k, c in sorted(found.items()))
        return pd.DataFrame({"text": pd.Series(out, dtype=object), "n_found": pd.Series(n, dtype="int64"), "kinds": pd.Series(kinds, dtype=object)})

    rest, made = [c for c in docs.columns if c not in ("text", "n_found", "kinds")], free_name(docs, "_hidden")
    return docs.select(*rest, hidden(F.col("text").cast("string")).alias(made)).select(*rest, f"{made}.*")
