"""Phone and identity numbers: read in any notation, and replaced by others of the same format (problem 9).

A number is read as what stays (its kind, country and first digit, or the class of an identity number) and as free parts,
each a whole number below a base. A keyed Feistel network permutes the free parts together; they are written back in the
notation of the text, with trunk zeros, separators and check characters as the format asks. So the pseudonym is a valid
number of the same format, and all notations of one number get the same one.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import date, timedelta
from functools import lru_cache
from math import prod

# fixed forms of phone and identity numbers
_EXT = r"(?:,?[ ]?(?:ext\.?|x|extension|Durchwahl|poste)[ ]?\d{1,6})?"
EXTENSION = re.compile(r",?[ ]?(?:ext\.?|x|extension|Durchwahl|poste)[ ]?(\d{1,6})$")
NUMBER = re.compile(
    rf"""(?<![\w./])(?<![\w)]-)(?:
    (?P<phone>
      \+1[ .-]?(?:\([2-9]\d\d\)|[2-9]\d\d)[ .-]?[2-9]\d\d[ .-]?\d{{4}}{_EXT}
    | \+[2-9]\d{{0,2}}(?:\ \(0\))?(?:[ ]\d{{1,6}}){{2,6}}{_EXT}
    | \+[2-9]\d{{0,2}}(?:[-.]\d{{1,6}}){{2,6}}{_EXT}
    | \+[2-9]\d{{8,13}}{_EXT}
    | 00[1-9]\d{{0,2}}(?:[ ]\d{{1,6}}){{2,5}}{_EXT}
    | (?:\([2-9]\d\d\)[ ]?|[2-9]\d\d[-.])[2-9]\d\d[-.]\d{{4}}{_EXT}
    | 0\d{{4}}[ ]\d{{6}}{_EXT} | 0\d\d[ ]\d{{4}}[ ]\d{{4}}{_EXT} | 0\d{{3}}[ ]\d{{3}}[ ]\d{{4}}{_EXT}
    | 0[1-9](?P<pair>[ .])\d\d(?:(?P=pair)\d\d){{3}}{_EXT}
    | 0[67]\d{{8}}{_EXT} )
  | (?P<ssn> \d{{3}}(?P<sep>[- ])\d\d(?P=sep)\d{{4}} )
  | (?P<personal> \d{{6}}[-+]\d{{4}} )
  | (?P<tax> \d\d[ ]\d{{3}}[ ]\d{{3}}[ ]\d{{3}} )
  | (?P<insurance> [A-Z]{{2}}(?:[ ]\d\d){{3}}[ ][A-D] | [A-Z]{{2}}\d{{6}}[A-D] )
  | (?P<card> \d{{8}}-?[A-Z] | [XYZ]-?\d{{7}}-?[A-Z] )
  | (?P<passport> [A-Z]\d{{8}} )
  )(?![\w@]|[-./+]\w)""",
    re.X,
)
# where a number may begin: the cheap part of NUMBER, told by the characters around
NUMBER_START = re.compile(r"[+(\dA-Z](?<![\w./].)(?<![\w)]-.)(?=[\d .()A-Z-]{5})(?:(?<=[+(\d])|(?=[A-Z]?[- ]?\d))")
KINDS = ("phone", "ssn", "personal", "tax", "insurance", "card", "passport")
CARD_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
# country codes of two digits; 1 and 7 have one, all others three
TWO_DIGIT_COUNTRIES = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
FRENCH_PAIRS = re.compile(r"0[1-9](?:[ .]\d\d){4}|0[67]\d{8}")
FIRST_DAY, LAST_DAY = date(2000, 1, 1), date(2099, 12, 31)  # of two-digit years; 2000 is a leap year


def numbers(text: str) -> Iterator[re.Match]:
    """The matches of NUMBER, from left to right."""
    end = 0
    for start in NUMBER_START.finditer(text):
        m = NUMBER.match(text, start.start()) if start.start() >= end else None
        if m:
            end = m.end()
            yield m


@dataclass(frozen=True)
class Reading:
    """A valid number: what stays, its free parts with their bases, and how to write it with other parts."""

    kind: str  # 'phone' or 'id_number'
    stays: str
    parts: tuple[int, ...]
    bases: tuple[int, ...]
    write: Callable[[tuple[int, ...]], str]
    extension: str = ""  # its digits, which don't belong to the number


def _filled(text: str, characters: str) -> str:
    """text with its letters and digits replaced by characters, in order."""
    it = iter(characters)
    return re.sub(r"[0-9A-Z]", lambda _: next(it), text)


def _bare(text: str) -> str:
    return re.sub(r"[^0-9A-Z]", "", text)


def _country(digits: str) -> str:
    return digits[:1] if digits[0] in "17" else digits[:2] if digits[:2] in TWO_DIGIT_COUNTRIES else digits[:3]


def _phone(text: str) -> Reading | None:
    ext = EXTENSION.search(text)
    main, tail = (text[: ext.start()], text[ext.start() :]) if ext else (text, "")
    if len(main) < 9 or sum(c.isdigit() for c in text) > 21:
        return None
    shape = main.replace("(0)", "(\0)")  # the trunk zero in brackets is no digit of the number
    digits = re.sub(r"[^0-9]", "", shape)
    if main.startswith(("+", "00")):
        abroad = digits[2:] if main[0] == "0" else digits
        country = _country(abroad)
        own = abroad[len(country) :]
    elif main.startswith("0"):
        country, own = "33" if FRENCH_PAIRS.fullmatch(main) else "44", digits[1:]
    else:
        country, own = "1", digits
    if not own:
        return None
    lead = digits[: len(digits) - len(own)]
    if country == "1" and len(own) == 10 and own[0] in "23456789" and own[3] in "23456789":
        parts, bases, first = (int(own[:3]) - 200, int(own[3:6]) - 200, int(own[6:])), (800, 800, 10_000), ""
        joined = lambda p: f"{p[0] + 200}{p[1] + 200}{p[2]:04d}"
    else:
        n, first = len(own) - 1, own[0]
        parts, bases = (int(own[1:] or 0),), (10**n,)
        joined = lambda p: first + (f"{p[0]:0{n}d}" if n else "")
    write = lambda p: _filled(shape, lead + joined(p)).replace("\0", "0") + tail
    return Reading("phone", f"phone:{country}:{first}:{len(own)}", parts, bases, write, ext[1] if ext else "")


def _ssn(text: str) -> Reading | None:
    area, group, serial = (int(x) for x in re.split("[- ]", text))
    if area >= 900:  # never issued: tax numbers of the same form, and made-up ones; they stay among themselves
        write = lambda p: _filled(text, f"9{p[0]:08d}")
        return Reading("id_number", "ssn:never issued", (int(_bare(text)[1:]),), (10**8,), write)
    if area in (0, 666) or group == 0 or serial == 0:
        return None

    def issued(p: tuple[int, ...]) -> str:
        return _filled(text, f"{p[0] + 1 + (p[0] + 1 >= 666):03d}{p[1] + 1:02d}{p[2] + 1:04d}")

    return Reading("id_number", "ssn", (area - 1 - (area > 666), group - 1, serial - 1), (898, 99, 9999), issued)


def day(digits: str) -> date | None:
    """The day of six digits yymmdd."""
    try:
        return date(2000 + int(digits[:2]), int(digits[2:4]), int(digits[4:6]))
    except ValueError:
        return None


def _by_tens(digits: str) -> int:
    """Check digit: every second digit from the last one twice, the sum of all digits filled up to a ten."""
    twice = [int(c) * 2 if k % 2 == 0 else int(c) for k, c in enumerate(reversed(digits))]
    return -sum(x // 10 + x % 10 for x in twice) % 10


def _by_elevens(digits: str) -> int:
    """Check digit modulo 11 and 10 in turn."""
    state = 10
    for c in digits:
        state = ((int(c) + state) % 10 or 10) * 2 % 11
    return (11 - state) % 10


def _with_check(stays: str, text: str, body: str, check: int, parts: tuple[int, ...], bases: tuple[int, ...], body_of: Callable, right: Callable) -> Reading:
    """A number with a check digit: right ones stay right, wrong ones (numbers without checking, or fictitious) wrong."""
    off = (check - right(body)) % 10
    if off == 0:
        return Reading("id_number", f"{stays}:right", parts, bases, lambda p: _filled(text, body_of(p) + str(right(body_of(p)))))
    write = lambda p: _filled(text, body_of(p[:-1]) + str((right(body_of(p[:-1])) + p[-1] + 1) % 10))
    return Reading("id_number", f"{stays}:wrong", (*parts, off - 1), (*bases, 9), write)


def _personal(text: str) -> Reading | None:
    digits = _bare(text)
    born = day(digits[:6])
    if not born:
        return None
    body_of = lambda p: (FIRST_DAY + timedelta(p[0])).strftime("%y%m%d") + f"{p[1]:03d}"
    bases = ((LAST_DAY - FIRST_DAY).days + 1, 1000)
    return _with_check("personal", text, digits[:9], int(digits[9]), ((born - FIRST_DAY).days, int(digits[6:9])), bases, body_of, _by_tens)


def _tax(text: str) -> Reading:
    digits = _bare(text)
    return _with_check("tax", text, digits[:10], int(digits[10]), (int(digits[:10]),), (10**10,), lambda p: f"{p[0]:010d}", _by_elevens)


def _insurance(text: str) -> Reading:
    bare = _bare(text)
    write = lambda p: _filled(text, f"{bare[:2]}{p[0]:06d}{'ABCD'[p[1]]}")
    return Reading("id_number", f"insurance:{bare[:2]}", (int(bare[2:8]), "ABCD".index(bare[8])), (10**6, 4), write)


def _card(text: str) -> Reading | None:
    bare = _bare(text)
    foreign = bare[0] in "XYZ"
    number = int(str("XYZ".index(bare[0])) + bare[1:-1] if foreign else bare[:-1])
    if CARD_LETTERS[number % 23] != bare[-1]:
        return None

    def write(p: tuple[int, ...]) -> str:
        digits = f"{p[0]:08d}"
        return _filled(text, ("XYZ"[int(digits[0])] + digits[1:] if foreign else digits) + CARD_LETTERS[p[0] % 23])

    return Reading("id_number", f"card:{foreign}", (number,), (3 * 10**7 if foreign else 10**8,), write)


def _passport(text: str) -> Reading | None:
    number = int(text[1:])
    if number == 0:
        return None
    write = lambda p: chr(ord("A") + p[0]) + f"{p[1] + 1:08d}"
    return Reading("id_number", "passport", (ord(text[0]) - ord("A"), number - 1), (26, 10**8 - 1), write)


READERS = dict(zip(KINDS, (_phone, _ssn, _personal, _tax, _insurance, _card, _passport), strict=True))


def read(m: re.Match) -> Reading | None:
    """The number of a match of NUMBER, or None if it isn't valid."""
    kind = next(k for k in KINDS if m[k] is not None)
    return READERS[kind](m[0])


@lru_cache(1 << 10)
def _own_key(key: bytes, stays: str) -> bytes:
    return hashlib.blake2b(stays.encode(), digest_size=32, key=key).digest()


def _round(key: bytes, number: int, value: int, other: int) -> int:
    data = f"{number}:{other}:{value}".encode()
    return int.from_bytes(hashlib.blake2b(data, digest_size=8, key=key).digest(), "big")


def permute(value: int, size: int, key: bytes) -> int:
    """A keyed permutation of 0..size-1: a Feistel network over two digits of a mixed base, walked until in range."""
    a = max(1, int(size**0.5))
    b = -(-size // a)
    while True:
        left, right = divmod(value, b)
        for k in range(0, 8, 2):
            left = (left + _round(key, k, right, size)) % a
            right = (right + _round(key, k + 1, left, size)) % b
        value = left * b + right
        if value < size:
            return value


def pseudonym_of(reading: Reading, key: bytes) -> str:
    value = 0
    for part, base in zip(reading.parts, reading.bases, strict=True):
        value = value * base + part
    value = permute(value, prod(reading.bases), _own_key(key, reading.stays))
    moved: list[int] = []
    for base in reversed(reading.bases):
        value, part = divmod(value, base)
        moved.append(part)
    out = reading.write(tuple(reversed(moved)))
    if reading.extension:  # permuted on its own, so that the number is linked with and without it
        n = len(reading.extension)
        out = out[:-n] + f"{permute(int(reading.extension), 10**n, _own_key(key, f'extension:{n}')):0{n}d}"
    return out


@lru_cache(1 << 14)
def pseudonym(text: str, key: bytes) -> str:
    """Another number of the same format, the same for all notations of text; text must be a valid number as a whole."""
    m = NUMBER.fullmatch(text)
    reading = m and read(m)
    if not reading:
        raise ValueError("not a valid phone or identity number")
    return pseudonym_of(reading, key)
