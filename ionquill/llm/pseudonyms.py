"""Format-preserving pseudonyms for personal data.

A value found in a text is read as a number in the set of all valid values of
its format, that number is permuted by a keyed Feistel network with cycle
walking, and the result is written in the same format: the same length, the
same separators, valid check digits. One key gives one permutation, so equal
values get equal pseudonyms in every document, and ``restore`` inverts it.
"""

from __future__ import annotations

import bisect
import datetime
import hashlib
import ipaddress
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
TEXTS_AT_ONCE = 256
KINDS = ["secret", "token", "email", "iban", "ip", "ip6", "date", "phone", "card", "ssn"]

_FOUND = re.compile(
    r"""
    (?P<secret> (?i:\b(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)\b) \s* [=:] \s* ["']? (?P<value> [A-Za-z0-9_+/.\-]{8,} ) )
  | (?P<token> (?<![\w\-])(?: (?:AKIA|ASIA)[A-Z0-9]{16} | gh[pousr]_[A-Za-z0-9]{36,} | sk-[A-Za-z0-9_\-]{20,} | xox[abprs]-[A-Za-z0-9\-]{10,} )(?![\w\-]) )
  | (?P<email> [^\W_][\w.+\-]*@[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?)*\.[A-Za-z]{2,} )
  | (?P<iban> \b[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?\b )
  | (?P<ip> (?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?\w) )
  | (?P<ip6> (?<![\w:.])(?: (?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4} | (?=[0-9A-Fa-f:]*[0-9A-Fa-f]{2})(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})? )(?![\w:.]*[\w:]) )
  | (?P<date> (?<![\w\-/.])(?: [0-9]{4}(?P<s1>[\-/.])[0-9]{2}(?P=s1)[0-9]{2} | [0-9]{2}(?P<s2>[\-/.])[0-9]{2}(?P=s2)[0-9]{4} )(?![\-/]?\w) )
  | (?P<phone> (?<![\w+])(?:
        \+1[ .\-]?(?:\([0-9]{3}\)|[0-9]{3})[ .\-]?[0-9]{3}[ .\-]?[0-9]{4}
      | \+(?!1[ .\-(])[0-9]{1,3}[ .\-]?\(?[0-9]{1,4}\)?(?:[ .\-]?[0-9]{2,4}){2,4}
      | \+[0-9]{10,15}
      | \([0-9]{3}\)[ ]?[0-9]{3}[\-. ][0-9]{4} | [0-9]{3}[\-.][0-9]{3}[\-.][0-9]{4}
      | 0[0-9]{2,4}[ \-][0-9]{3,4}[ \-][0-9]{3,4} | \(0[0-9]{2,4}\)[ ]?[0-9]{3,4}[ \-]?[0-9]{3,4}
    )(?![\w\-]) )
  | (?:(?i:\b(?:phone|mobile|tel|telephone|cell|fax|call|whatsapp)\b) [ ]? (?:(?i:number|no\.?|us|me)[ ])? (?:at[ ])? [:.]? [ ]? (?P<plain> [0-9]{10} (?![\w\-]) ) )
  | (?P<card> (?<![\w.\-])(?: [0-9]{13,19} | [0-9]{4}(?P<s3>[ \-])[0-9]{4}(?P=s3)[0-9]{4}(?P=s3)[0-9]{1,7} | [0-9]{4}(?P<s4>[ \-])[0-9]{6}(?P=s4)[0-9]{5} )(?![\w\-]) )
  | (?P<ssn> (?<![\w\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w\-]) )
    """,
    re.VERBOSE,
)
_MAYBE = re.compile(r"[0-9@]|(?i:token|secret|passw|key)|sk-|xox")


class Feistel:
    """Keyed permutation of the numbers 0 ... n - 1, for any n and any tweak."""

    def __init__(self, key: bytes):
        self.key = hashlib.sha256(key).digest()

    def _mix(self, tweak: str, n: int, turn: int, half: int, size: int) -> int:
        data = f"{tweak}|{n}|{turn}|{half}".encode()
        out = b"".join(hashlib.blake2b(data, key=self.key, salt=bytes([k])).digest() for k in range(-(-size // 512)))
        return int.from_bytes(out, "big") & ((1 << size) - 1)

    def permute(self, x: int, n: int, tweak: str, back: bool = False) -> int:
        if n < 2:
            return x
        size = -(-(n - 1).bit_length() // 2)
        while True:
            left, right = x >> size, x & ((1 << size) - 1)
            for turn in reversed(range(ROUNDS)) if back else range(ROUNDS):
                if back:
                    left, right = right ^ self._mix(tweak, n, turn, left, size), left
                else:
                    left, right = right, left ^ self._mix(tweak, n, turn, right, size)
            x = left << size | right
            if x < n:
                return x


Permute = Callable[[int, int, str], int]


def _mixed(chars: str, sets: list[str | None], permute: Permute, tweak: str) -> str:
    """``chars`` permuted among all strings whose character k is in ``sets[k]``; where that is None it stays."""
    x, n = 0, 1
    for c, own in zip(chars, sets, strict=True):
        if own:
            x, n = x * len(own) + own.index(c), n * len(own)
    x = permute(x, n, tweak)
    out = []
    for c, own in zip(reversed(chars), reversed(sets), strict=True):
        if own:
            x, k = divmod(x, len(own))
            c = own[k]
        out.append(c)
    return "".join(reversed(out))


DIGITS, LETTERS, HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef"


def _kind_of(c: str) -> str | None:
    return DIGITS if c in DIGITS else LETTERS if c in LETTERS else None


def _cased(old: str, new: str) -> str:
    return "".join(n.upper() if o.isupper() else n for o, n in zip(old, new, strict=True))


def _refilled(shape: str, digits: str) -> str:
    rest = iter(digits)
    return "".join(next(rest) if c in DIGITS else c for c in shape)


def luhn_digit(digits: str) -> str:
    """The check digit that goes after ``digits``."""
    total = sum(sum(divmod(2 * int(d), 10)) if k % 2 == 0 else int(d) for k, d in enumerate(reversed(digits)))
    return str(-total % 10)


def iban_check(country: str, rest: str) -> str:
    number = "".join(str(int(c, 36)) for c in rest + country + "00")
    return f"{98 - int(number) % 97:02d}"


def _secret(value: str, permute: Permute) -> str | None:
    low = value.lower()
    if all(c in HEX for c in low):
        new = _mixed(low, [HEX] * len(low), permute, "hex")
        return new.upper() if any(c.isupper() for c in value) else new
    sets = [_kind_of(c) for c in low]
    return _cased(value, _mixed(low, sets, permute, "secret")) if sum(map(bool, sets)) >= 6 else None


def _email(value: str, permute: Permute) -> str | None:
    low, end = "".join(c.lower() if c.isascii() else c for c in value), value.rindex(".")
    new = _mixed(low[:end], [_kind_of(c) for c in low[:end]], permute, "email") + low[end:]
    return "".join(n.upper() if o.isascii() and o.isupper() else n for o, n in zip(value, new, strict=True))


def _iban(value: str, permute: Permute) -> str | None:
    solid = value.replace(" ", "")
    country, check, rest = solid[:2], solid[2:4], solid[4:]
    if not 15 <= len(solid) <= 34 or iban_check(country, rest) != check:
        return None
    low = rest.lower()
    new = _mixed(low, [_kind_of(c) for c in low], permute, "iban" + country).upper()
    filled = iter(country + iban_check(country, new) + new)
    return "".join(c if c == " " else next(filled) for c in value)


def _ip(value: str, permute: Permute) -> str | None:
    parts = value.split(".")
    if any(int(p) > 255 or p != str(int(p)) for p in parts):
        return None
    spans = [{1: (0, 10), 2: (10, 90), 3: (100, 156)}[len(p)] for p in parts]
    x, n = 0, 1
    for p, (low, size) in zip(parts, spans, strict=True):
        x, n = x * size + int(p) - low, n * size
    x, out = permute(x, n, "ip" + ".".join(str(len(p)) for p in parts)), []
    for low, size in reversed(spans):
        x, k = divmod(x, size)
        out.append(str(low + k))
    return ".".join(reversed(out))


def _ip6(value: str, permute: Permute) -> str | None:
    """An address of version 6: the digits of each group are permuted, the first of a group among those that keep its length."""
    try:
        ipaddress.IPv6Address(value)
    except ValueError:
        return None
    low = value.lower()
    sets = [None if c == ":" else HEX[1:] if c != "0" and (k == 0 or low[k - 1] == ":") else HEX if k and low[k - 1] != ":" else None for k, c in enumerate(low)]
    new = _mixed(low, sets, permute, "ip6")
    return new.upper() if any(c.isupper() for c in value) else new


def _token(value: str, permute: Permute) -> str | None:
    """A key whose beginning tells what it is; that stays."""
    head = re.match(r"AKIA|ASIA|gh[pousr]_|sk-|xox[abprs]-", value)[0]
    low = value[len(head) :].lower()
    return head + _cased(value[len(head) :], _mixed(low, [_kind_of(c) for c in low], permute, "token" + head))


FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
#: All days, apart by whether the day of the month can be taken for a month: each kind is permuted within itself, so a layout that was clear stays clear.
_BY_KIND_OF_DAY = [[d for d in range(FIRST_DAY, LAST_DAY + 1) if (datetime.date.fromordinal(d).day > 12) == late] for late in (False, True)]


def _date(value: str, permute: Permute) -> str | None:
    """A day in any layout; one day has one pseudonym, whatever the layout."""
    mark = next(c for c in value if c not in DIGITS)
    a, b, c = value.split(mark)
    if len(a) == 4:
        order = "ymd"
    else:
        order = "mdy" if mark == "/" and int(a) <= 12 else "dmy"
    field = dict(zip(order, map(int, (a, b, c)), strict=True))
    try:
        day = datetime.date(field["y"], field["m"], field["d"])
    except ValueError:
        return None
    if not FIRST_DAY <= day.toordinal() <= LAST_DAY:
        return None
    days = _BY_KIND_OF_DAY[day.day > 12]
    new = datetime.date.fromordinal(days[permute(bisect.bisect_left(days, day.toordinal()), len(days), f"date {day.day > 12}")])
    text = {"y": f"{new.year:04d}", "m": f"{new.month:02d}", "d": f"{new.day:02d}"}
    return mark.join(text[k] for k in order)


def _phone(value: str, permute: Permute) -> str | None:
    """A number's country code, or the 0 that it begins with at home, stays; so do its separators."""
    digits = "".join(c for c in value if c in DIGITS)
    if not 10 <= len(digits) <= 15:
        return None
    head = re.match(r"\+(1(?=[0-9]{10}$|[^0-9])|[0-9]{1,3}(?=[^0-9]))", value)
    fixed = len(head[1]) if head else 2 if value[0] == "+" else 1 if digits[0] == "0" else 0
    own = digits[fixed:]
    return _refilled(value, digits[:fixed] + _mixed(own, [DIGITS] * len(own), permute, "phone"))


def _card(value: str, permute: Permute) -> str | None:
    digits = "".join(c for c in value if c in DIGITS)
    if digits[0] == "0" or luhn_digit(digits[:-1]) != digits[-1]:
        return None
    own = digits[0] + _mixed(digits[1:-1], [DIGITS] * (len(digits) - 2), permute, "card" + digits[0])
    return _refilled(value, own + luhn_digit(own))


_AREAS = [a for a in range(1, 900) if a != 666]


def _ssn(value: str, permute: Permute) -> str | None:
    area, group, serial = map(int, value.split("-"))
    if area not in _AREAS or not group or not serial:
        return None
    x = permute((_AREAS.index(area) * 99 + group - 1) * 9999 + serial - 1, len(_AREAS) * 99 * 9999, "ssn")
    x, serial = divmod(x, 9999)
    area, group = divmod(x, 99)
    return f"{_AREAS[area]:03d}-{group + 1:02d}-{serial + 1:04d}"


_BY_KIND = {"secret": _secret, "token": _token, "email": _email, "iban": _iban, "ip": _ip, "ip6": _ip6, "date": _date, "phone": _phone, "card": _card, "ssn": _ssn}


class Pseudonyms:
    """Replaces personal values of the given kinds in texts, under one key."""

    def __init__(self, key: bytes, kinds: list[str] | None = None):
        self.cipher = Feistel(key)
        self.kinds = set(KINDS if kinds is None else kinds)

    def _all(self, text: str, permute: Permute) -> tuple[str, Counter]:
        found: Counter = Counter()
        if not _MAYBE.search(text):
            return text, found

        def new(m: re.Match) -> str:
            kind = next((k for k in KINDS if m[k] is not None), "phone")
            if kind not in self.kinds:
                return m[0]
            part = "value" if kind == "secret" else "plain" if m["plain"] else 0
            made = _BY_KIND[kind](m[part], permute)
            if made is None:
                return m[0]
            found[kind] += 1
            return m[0][: m.start(part) - m.start()] + made

        return _FOUND.sub(new, text), found

    def replace(self, text: str) -> tuple[str, Counter]:
        """The text with pseudonyms, and how many there are of each kind."""
        return self._all(text, self.cipher.permute)

    def restore(self, text: str) -> str:
        """The text that ``replace`` made this one from."""
        return self._all(text, lambda x, n, tweak: self.cipher.permute(x, n, tweak, back=True))[0]


def pseudonymised(docs: DataFrame, key: bytes, text_col: str = "text", kinds: list[str] | None = None, count_col: str | None = None) -> DataFrame:
    """``docs`` with pseudonyms in ``text_col``; ``count_col`` adds how many each text holds.

    Null texts stay null and count none. Pseudonyms are as long as what they
    stand for, so lengths stored beside a text stay right. Numbers that fail
    their check (card, IBAN, address, date) are left alone, and so is every text
    without a value. Rows are taken one by one, so repeats, an empty table, nulls
    and other columns pass through unchanged; a text of any length is read whole.
    A ``count_col`` that the table has already is refused.
    """
    names = docs.columns
    if count_col in names:
        raise ValueError(f"there is a column {count_col} already")
    at = names.index(text_col)
    schema = docs.schema if count_col is None else docs.select("*", F.lit(0).cast("long").alias(count_col)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = Pseudonyms(key, kinds)
        for batch in batches:
            for k in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(k, TEXTS_AT_ONCE)
                done = [(None, Counter()) if t is None else tool.replace(t) for t in part.column(at).to_pylist()]
                columns = part.columns
                columns[at] = pa.array([t for t, _ in done], part.schema.field(at).type)
                added = [] if count_col is None else [pa.array([sum(c.values()) for _, c in done], pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, *added], names=[*names, *([] if count_col is None else [count_col])])

    return docs.mapInArrow(run, schema)
