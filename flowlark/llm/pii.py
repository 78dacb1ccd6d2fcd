"""Personal data replaced by format-preserving pseudonyms from a keyed Feistel network."""

from __future__ import annotations

import datetime as dt
import functools
import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .scratch import small_batches

ROUNDS = 8
#: A round mixes at most 256 bits of each half: up to so many bits a text is one number, a longer one goes in pieces of so many characters.
WHOLE_BITS, PIECE = 512, 64
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _letters(first: int, last: int, without: str = "") -> str:
    return "".join(chr(i) for i in range(first, last + 1) if chr(i) not in without)


#: Characters that become each other: digits, small and capital letters, each alphabet for itself. The rest stays.
SORTS = [
    _DIGITS, _LOWER, _UPPER, _letters(0xDF, 0xFF, "÷"), _letters(0xC0, 0xDE, "×"), _letters(0x100, 0x17F), _letters(0x3B1, 0x3C9), _letters(0x391, 0x3A9, "\u03a2"),
    _letters(0x430, 0x45F), _letters(0x400, 0x42F),
]
_SORT_OF = {c: i for i, s in enumerate(SORTS) for c in s}
#: Letters of addresses beside A to z: Latin with marks, Greek, Cyrillic, and marks that stand alone.
_MORE = "\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u0300-\u036f\u0370-\u03ff\u0400-\u04ff"


class Feistel:
    """A keyed permutation of ``range(size)`` for any size; ``kind`` sets ranges of one size apart."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, kind: str, size: int, i: int, half: int) -> int:
        text = f"{kind}|{size}|{i}|{half}".encode()
        return int.from_bytes(hashlib.blake2b(text, key=self.key, digest_size=32).digest(), "big")

    def permute(self, value: int, size: int, kind: str, back: bool = False) -> int:
        """Cycle-walks in the next power of four, so the result is in the range again; ``back`` inverts."""
        if size < 2:
            return value
        bits = max(1, ((size - 1).bit_length() + 1) // 2)
        mask = (1 << bits) - 1
        while True:
            left, right = value >> bits, value & mask
            for i in range(ROUNDS - 1, -1, -1) if back else range(ROUNDS):
                if back:
                    left, right = right ^ (self._round(kind, size, i, left) & mask), left
                else:
                    left, right = right, left ^ (self._round(kind, size, i, right) & mask)
            value = left << bits | right
            if value < size:
                return value

    def mixed(self, digits: list[int], bases: list[int], kind: str, back: bool = False) -> list[int]:
        """Permutes the number that ``digits`` spell in mixed ``bases``."""
        value, size = 0, 1
        for d, b in zip(digits, bases, strict=True):
            value, size = value * b + d, size * b
        value, out = self.permute(value, size, kind, back), []
        for b in reversed(bases):
            value, d = divmod(value, b)
            out.append(d)
        return out[::-1]

    def pieces(self, digits: list[int], bases: list[int], kind: str, back: bool = False) -> list[int]:
        """``mixed`` for any length: PIECE by PIECE, each in a way that depends on all plain digits before it."""
        out, before = [], hashlib.blake2b(kind.encode(), digest_size=32)
        for at in range(0, len(digits), PIECE):
            old = digits[at : at + PIECE]
            new = self.mixed(old, bases[at : at + PIECE], f"piece{before.hexdigest()}", back)
            before.update(bytes(new if back else old))
            out += new
        return out

    def characters(self, text: str, kind: str, back: bool = False) -> str:
        """Each digit, small or capital letter becomes one of its sort; the rest stays."""
        sorts = [_SORT_OF.get(c) for c in text]
        known = [(SORTS[s].index(c), len(SORTS[s])) for c, s in zip(text, sorts, strict=True) if s is not None]
        if not known:
            return text
        shape = "".join("-dlu3456789"[0 if s is None else 1 + s] for s in sorts)
        size = 1
        for _, b in known:
            size *= b
            if size >> WHOLE_BITS:
                break
        change = self.pieces if size >> WHOLE_BITS else self.mixed
        new = iter(change([d for d, _ in known], [b for _, b in known], f"{kind}{shape}", back))
        return "".join(c if s is None else SORTS[s][next(new)] for c, s in zip(text, sorts, strict=True))


def luhn_digit(digits: str) -> int:
    """The check digit behind ``digits``."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (2 if i % 2 == 0 else 1)
        total += x - 9 if x > 9 else x
    return -total % 10


def _fill(shape: str, digits: str) -> str:
    """``shape`` with its digits replaced, one by one."""
    new = iter(digits)
    return "".join(next(new) if c in _DIGITS else c for c in shape)


def _card(f: Feistel, text: str, back: bool) -> str | None:
    digits = re.sub(r"[ -]", "", text)
    if luhn_digit(digits[:-1]) != int(digits[-1]):
        return None
    # The first digit, which names the scheme, stays; the last one follows from the others.
    body = digits[0] + f.characters(digits[1:-1], "card" + digits[0], back)
    return _fill(text, body + str(luhn_digit(body)))


def _iban_check(country: str, account: str) -> str:
    number = "".join(str(int(c, 36)) for c in account + country + "00")
    return f"{98 - int(number) % 97:02d}"


def _iban(f: Feistel, text: str, back: bool) -> str | None:
    plain = text.replace(" ", "")
    country, check, account = plain[:2], plain[2:4], plain[4:]
    if _iban_check(country, account) != check:
        return None
    account = f.characters(account, "iban" + country, back)
    new = iter(country + _iban_check(country, account) + account)
    return "".join(c if c == " " else next(new) for c in text)


def _ssn(f: Feistel, text: str, back: bool) -> str | None:
    area, group, serial = (int(x) for x in text.split("-"))
    if area in (0, 666) or area > 899 or not group or not serial:
        return None
    area, group, serial = f.mixed([area - 1 - (area > 666), group - 1, serial - 1], [898, 99, 9999], "ssn", back)
    return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"


# Country codes of one and of two digits; all others have three.
_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
#: Digits of an international number, country code included.
_PHONE_DIGITS = range(8, 16)


def _international(f: Feistel, text: str, back: bool) -> str | None:
    """The country code stays, and whether the number behind it begins with a zero."""
    digits = re.sub(r"\D", "", text)
    code = next((digits[:n] for n in (1, 2) if digits[:n] in _CODES), digits[:3])
    number = digits[len(code) :]
    if len(digits) not in _PHONE_DIGITS or len(number) < 6:
        return None
    low = [int(number[0] != "0"), *[0] * (len(number) - 1)]
    bases = [9 if low[0] else 1, *[10] * (len(number) - 1)]
    new = f.mixed([int(c) - x for c, x in zip(number, low, strict=True)], bases, f"phone{code}", back)
    return _fill(text, code + "".join(str(d + x) for d, x in zip(new, low, strict=True)))


def _phone(f: Feistel, text: str, back: bool) -> str | None:
    digits = re.sub(r"\D", "", text)
    if text[0] == "+" and digits[0] != "1":
        return _international(f, text, back)
    country, number = digits[:-10], digits[-10:]
    if number[0] in "01" or number[3] in "01" or country not in ("", "1"):
        return None
    low = [2, 0, 0, 2, 0, 0, 0, 0, 0, 0]
    new = f.mixed([int(c) - x for c, x in zip(number, low, strict=True)], [10 - x for x in low], "phone", back)
    return _fill(text, country + "".join(str(d + x) for d, x in zip(new, low, strict=True)))


def _ip(f: Feistel, text: str, back: bool) -> str | None:
    parts = [int(x) for x in text.split(".")]
    if max(parts) > 255 or any(len(x) > 1 and x[0] == "0" for x in text.split(".")):
        return None
    return ".".join(map(str, f.mixed(parts, [256] * 4, "ip", back)))


def _ip_as_long(f: Feistel, text: str, back: bool) -> str:
    """Each number keeps how many digits it has."""
    parts = text.split(".")
    low, base = zip(*({1: (0, 10), 2: (10, 90), 3: (100, 156)}[len(x)] for x in parts), strict=True)
    new = f.mixed([int(x) - y for x, y in zip(parts, low, strict=True)], list(base), f"ip{[len(x) for x in parts]}", back)
    return ".".join(str(x + y) for x, y in zip(new, low, strict=True))


#: Dates are permuted among the days of these years.
_FIRST_DAY, _LAST_DAY = dt.date(1900, 1, 1), dt.date(2099, 12, 31)


@functools.cache
def _days(month_width: int, day_width: int) -> tuple[list[dt.date], dict[dt.date, int]]:
    """The days that can be written with so many digits (two with a zero in front), in order, and the number of each."""
    every = (_FIRST_DAY + dt.timedelta(i) for i in range((_LAST_DAY - _FIRST_DAY).days + 1))
    days = [d for d in every if (month_width == 2 or d.month < 10) and (day_width == 2 or d.day < 10)]
    return days, {d: i for i, d in enumerate(days)}


def _date(f: Feistel, text: str, back: bool) -> str | None:
    mark = re.search(r"[-/.]", text)[0]
    parts = text.split(mark)
    if len(parts) != 3:
        return None
    year_first = len(parts[0]) == 4
    # 1999-12-31; 31.12.1999; 12/31/1999, with a slash the month comes first.
    order = (0, 1, 2) if year_first else (2, 0, 1) if mark == "/" else (2, 1, 0)
    try:
        day = dt.date(*(int(parts[i]) for i in order))
    except ValueError:
        return None
    widths = len(parts[order[1]]), len(parts[order[2]])
    days, number_of = _days(*widths)
    if day not in number_of:
        return None
    day = days[f.permute(number_of[day], len(days), f"date{widths[0]}{widths[1]}", back)]
    new = {order[0]: f"{day.year:04d}", order[1]: f"{day.month:0{widths[0]}d}", order[2]: f"{day.day:0{widths[1]}d}"}
    return mark.join(new[i] for i in range(3))


def _email(f: Feistel, text: str, back: bool) -> str | None:
    local, _, domain = text.partition("@")
    host, dot, top = domain.rpartition(".")
    if not host or ".." in text:
        return None
    return f.characters(local, "local", back) + "@" + f.characters(host, "host", back) + dot + top


def _secret(f: Feistel, text: str, back: bool) -> str | None:
    head = re.match(r"(?:AKIA|[^:=]*[:=]\s*[\"']?)", text)[0]
    body = text[len(head) :]
    if head != "AKIA" and not re.search(r"\d", body):
        return None  # prose behind an equals sign
    return head + f.characters(body, "secret", back)


#: Kind, pattern and pseudonym of each sort of personal data; the first that fits at a place is taken.
KINDS: list[tuple[str, str, Callable[[Feistel, str, bool], str | None]]] = [
    ("secret", r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])|(?<![A-Za-z0-9])(?:password|passwd|token|secret|api_key)\s?[:=]\s?[\"']?[A-Za-z0-9+/_-]{8,}", _secret),
    ("email", rf"(?<![A-Za-z0-9{_MORE}._%+-])[A-Za-z0-9{_MORE}._%+-]+@(?:[A-Za-z0-9{_MORE}-]+\.)+[A-Za-z{_MORE}]{{2,}}(?![A-Za-z0-9{_MORE}])", _email),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", _iban),
    ("phone", r"(?<![\w.+-])(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\w-])|(?<![\w.+-])\+[2-9]\d{0,2}(?:[ .-]?\(?\d{1,4}\)?){2,7}(?![\w-])", _phone),
    ("ssn", r"(?<![\w.-])\d{3}-\d{2}-\d{4}(?![\w-])", _ssn),
    ("date", r"(?<![\w./-])(?:\d{4}-\d{1,2}-\d{1,2}|\d{4}/\d{1,2}/\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.]\d{4})(?![\w/-]|\.\d)", _date),
    ("ip", r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)", _ip),
    ("card", r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-])", _card),
]
_PATTERN = re.compile("|".join(f"(?P<{kind}>{pattern})" for kind, pattern, _ in KINDS), re.ASCII)
_SINGLE = [(kind, re.compile(pattern, re.ASCII), make) for kind, pattern, make in KINDS]
_AT = {kind: i for i, (kind, _, _) in enumerate(KINDS)}
_EMAIL = _SINGLE[_AT["email"]][1]
#: Digits of cards by their first digit, and characters of account numbers by country; others have any length.
_CARD_LENGTHS = {"2": (16,), "3": (14, 15, 16), "4": (13, 16, 19), "5": (16,)}
_IBAN_LENGTHS = {x[:2]: (int(x[2:]),) for x in (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 "
    "KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30"
).split()}
#: All that the patterns find holds one of these.
_HINT = re.compile(r"[0-9@]|AKIA|(?:password|passwd|token|secret|api_key)\s?[:=]")


def _ends(kind: str, text: str) -> list[int]:
    """Where a value of ``kind`` may end within a match: behind groups that make a usual length, shortest first, and at its end."""
    if kind == "card":
        lengths = _CARD_LENGTHS.get(text[0], range(13, 20))
    elif kind == "iban":
        lengths = _IBAN_LENGTHS.get(text[:2], range(15, 35))
    elif kind == "phone" and text[0] == "+":
        # The longest that is a number, before what may follow it.
        groups = [i for i, c in enumerate(text) if c in " .-"]
        return [i for i in [len(text), *groups[::-1]] if len(re.sub(r"\D", "", text[:i])) in _PHONE_DIGITS] or [len(text)]
    else:
        return [len(text)]
    inner = [i for i, c in enumerate(text) if c in " -" and len(re.sub("[ -]", "", text[:i])) in lengths]
    return [*inner, len(text)]


def _candidates(text: str, m: re.Match) -> Iterator[tuple[str, int, Callable]]:
    """(kind, end, pseudonym) of all that may be personal data from the start of ``m`` on, in the order of trial."""
    start = m.start()
    for kind, pattern, make in _SINGLE[_AT[m.lastgroup] :]:
        if not (one := pattern.match(text, start)):
            continue
        if kind == "secret" and not one[0].startswith("AKIA"):
            body = start + len(re.match(r"[^:=]*[:=]\s*[\"']?", one[0])[0])
            if (mail := _EMAIL.match(text, body)) and ".." not in mail[0]:
                continue  # an address, of which the secret would be a part
        for end in _ends(kind, one[0]):
            yield kind, start + end, make


#: What reaches into an IP address and depends on how long its numbers are begins at most so far before it and ends no further behind it.
_REACH = 64
#: Stands before an IP address that would be part of a phone number with a few more digits: hardly any other address fits there.
_DIALLED = re.compile(r"(?<![\w.+-])\+[2-9]\d{0,2}(?:[ .-]?\(?\d{1,4}\)?){0,6}[ .-]?\(?\Z", re.ASCII)
#: Ends what is of any length: e-mail addresses and secrets.
_BREAK = re.compile(rf"[^A-Za-z0-9{_MORE}._%+/@-]")


def _next(text: str, at: int, feistel: Feistel, back: bool) -> tuple[tuple[int, int, str, Callable, str] | None, list[tuple[int, int, Callable]]]:
    """((start, end, kind, how, pseudonym) of the first personal data from ``at`` on, what looked alike before and wasn't valid)."""
    failed = []
    while m := _PATTERN.search(text, at):
        for kind, end, make in _candidates(text, m):
            made = make(feistel, text[m.start() : end], back)
            if made is not None:
                return (m.start(), end, kind, make, made), failed
            failed.append((m.start(), end, make))
        at = m.start() + 1
    return None, failed


def _found_again(text: str, taken: list[tuple[int, int, str]], start: int, end: int, made: str, feistel: Feistel, back: bool) -> bool:
    """Whether a search finds ``made`` where it stands instead of the IP address ``text[start:end]``, and shortly before it what was ``taken``.

    Its numbers may be longer or shorter, so that others reach further into it, or not as far.
    """
    low, want = max(start - _REACH, 0), [(start, start + len(made), "ip")]
    for one in reversed(taken):
        if one[0] < low:
            low = max(low, one[1])
            break
        want.append(one)
    base, stop = max(low - 1, 0), _BREAK.search(text, end + _REACH)
    near, at = text[base:start] + made + text[end : stop.end() if stop else len(text)], low - base
    for first, last, kind in reversed(want):
        one, _ = _next(near, at, feistel, back)
        if one is None or one[:3] != (first - base, last - base, kind):
            return False
        at = one[1]
    return True


def pseudonymise(text: str, feistel: Feistel, back: bool = False) -> tuple[str, dict[str, int]]:
    """(the text with pseudonyms, how many of each kind); ``back`` restores a text that this made."""
    found: dict[str, int] = {}
    if not _HINT.search(text):
        return text, found
    out, at = [], 0
    failed: list[tuple[int, int, Callable]] = []  # what looked alike, wasn't valid and may reach into what comes
    taken: list[tuple[int, int, str]] = []
    while True:
        one, alike = _next(text, at, feistel, back)
        if one is None:
            return "".join(out) + text[at:], found
        start, end, kind, make, made = one
        failed = [x for x in [*failed, *alike] if x[1] > start]
        if kind == "ip":
            if _DIALLED.search(text, max(start - _REACH, 0), start):
                make = _ip_as_long
                made = make(feistel, text[start:end], back)
            while not _found_again(text, taken, start, end, made, feistel, back):
                made = make(feistel, made, back)
        # What failed must fail beside the pseudonym too, or the way back would take it; all others are as long as what they stand for.
        while kind != "ip" and any(x < end and y > start and other(feistel, text[x:start] + made[: max(y - start, 0)] + text[end:y], back) is not None for x, y, other in failed):
            made = make(feistel, made, back)
        found[kind] = found.get(kind, 0) + 1
        out += [text[at:start], made]
        taken.append((start, end, kind))
        at = end


def protect(docs: DataFrame, key: bytes, columns: list[str] | None = None) -> DataFrame:
    """``columns`` (by default ``doc_id``) with the ``text`` rewritten, ``n_found`` and ``found`` (counts by kind).

    E-mail and IP addresses, phone, card, account and security numbers, dates and
    secrets are found by pattern; numbers and dates must also be valid (checksums,
    ranges, the calendar).  Addresses may hold letters of Latin, Greek and Cyrillic; phone numbers are those of North America in their usual
    forms and international ones behind a plus, whose country code stays.  Each value is mapped within its own format by a keyed
    permutation: equal values are equal in every document, different ones stay
    different, and the holder of the key can go back.  What looks alike but isn't
    valid stays, but all that starts within it is tried; a card or account number
    ends behind the first groups that make a valid one of a usual length.  Only where
    a pseudonym would make such a text around it valid is it permuted again, and an IP address behind the beginning of a phone number keeps how long
    its numbers are, so there a value may differ from its pseudonym elsewhere.  (Where what looks alike spans two values and more, the way back may miss them.)
    Values of any length go as a whole up to 512 bits, else in pieces of 64 characters.  Dates keep how many digits day and month have, so ``1/2/1999``
    and ``01/02/1999`` have pseudonyms of their own.  A null text stays null, an empty one empty; texts of any length are
    read whole; repeated rows and rows without a doc_id are rewritten alike and kept.  Columns named like a
    new one are replaced.
    """
    small_batches(docs.sparkSession)
    columns = [c for c in columns or ["doc_id"] if c not in ("n_found", "found")]
    base = docs.select(*dict.fromkeys([*columns, "text"]))
    names = [c for c in base.columns if c in columns and c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        feistel = Feistel(key)
        for batch in batches:
            texts, many, kinds = [], [], []
            for t in batch.column("text").to_pylist():
                new, found = pseudonymise(t, feistel) if t else (t, {})
                texts.append(new)
                many.append(sum(found.values()))
                kinds.append(list(found.items()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(texts, pa.string()), pa.array(many, pa.int64()), pa.array(kinds, pa.map_(pa.string(), pa.int64()))], names=[*names, "text", "n_found", "found"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema if f.name in names] + ["text string, n_found long, found map<string, bigint>"])
    return base.mapInArrow(run, schema)
