"""Format-preserving pseudonyms for personal numbers, dates and addresses.

Each validated value is mapped to a number of a finite domain, that of all valid values of
its format, permuted there by a keyed Feistel network with cycle walking, and written back
in the same format.  A permutation keeps different values apart and equal values linked,
in every document and every run with the same key; with the key it can be undone.
"""

from __future__ import annotations

import datetime
import functools
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

ROUNDS = 10
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
# Names of months, beginnings of access tokens.
MONTHS = "january february march april may june july august september october november december".split()
TOKEN_START = r"gh[pousr]_|github_pat_|(?:sk|pk|rk)_(?:live|test)_|xox[abprs]-|AIza"
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1), datetime.date(2099, 12, 31)


def permute(value: int, size: int, key: bytes, tweak: str, inverse: bool = False) -> int:
    """The place of ``value`` in a keyed permutation of ``range(size)``; ``tweak`` picks the permutation."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask, width = (1 << half) - 1, (half + 7) // 8
    keyed = hashlib.blake2b(tweak.encode(), key=key, digest_size=32).digest()

    def f(number: int, part: int) -> int:
        block = bytes([number]) + part.to_bytes(width, "big")
        if width <= 64:
            return int.from_bytes(hashlib.blake2b(block, key=keyed, digest_size=width).digest(), "big") & mask
        return int.from_bytes(hashlib.shake_256(keyed + block).digest(width), "big") & mask

    while True:
        left, right = value >> half, value & mask
        if inverse:
            for number in reversed(range(ROUNDS)):
                left, right = right ^ f(number, left), left
        else:
            for number in range(ROUNDS):
                left, right = right, left ^ f(number, right)
        value = left << half | right
        if value < size:  # else walk on along the cycle, which leads back into the domain
            return value


def luhn_digit(body: str) -> str:
    total = 0
    for place, digit in enumerate(reversed(body)):
        value = int(digit) * (2 if place % 2 == 0 else 1)
        total += value - 9 if value > 9 else value
    return str(-total % 10)


def refill(shape: str, digits: str) -> str:
    """``shape`` with its digits replaced one by one."""
    left = iter(digits)
    return "".join(next(left) if c in DIGITS else c for c in shape)


class Pseudonyms:
    """Pseudonyms of single values under one key; None from a method means: not valid, leave it."""

    def __init__(self, key: bytes, inverse: bool = False):
        self.key, self.inverse = key, inverse

    def _permute(self, value: int, size: int, tweak: str) -> int:
        return permute(value, size, self.key, tweak, self.inverse)

    def characters(self, text: str, tweak: str) -> str:
        """Letters of either case and digits, each position within its own alphabet."""
        bases, value, size = [], 0, 1
        for c in text:
            kind = next((a for a in (DIGITS, LOWER, UPPER) if c in a), None)
            if kind:
                value, size = value * len(kind) + kind.index(c), size * len(kind)
            bases.append(kind)
        if size == 1:
            return text
        value, out = self._permute(value, size, f"{tweak}:{size}"), []
        for c, kind in zip(reversed(text), reversed(bases)):
            if kind:
                value, place = divmod(value, len(kind))
                c = kind[place]
            out.append(c)
        return "".join(reversed(out))

    def card(self, text: str) -> str | None:
        """13 to 19 digits with a right Luhn digit: the first digit stays, the check digit is renewed."""
        digits = re.sub(r"\D", "", text)
        if not 13 <= len(digits) <= 19 or digits[0] not in "23456" or luhn_digit(digits[:-1]) != digits[-1]:
            return None
        size = 10 ** (len(digits) - 2)
        body = digits[0] + str(self._permute(int(digits[1:-1]), size, f"card{digits[0]}:{size}")).zfill(len(digits) - 2)
        return refill(text, body + luhn_digit(body))

    def phone(self, text: str) -> str | None:
        """North American numbers keep area and exchange codes that may be assigned, or may not;
        others keep their first two digits."""
        digits = re.sub(r"\D", "", text)
        north = digits[1:] if len(digits) == 11 and digits[0] == "1" else digits
        if len(north) == 10 and (len(digits) == 11 or not text.startswith("+")):
            valid = self._assignable(north)
            if not valid and len(digits) == 10:
                return None  # without the country code it may be any number
            while True:  # along the cycle to the next number of the same kind
                north = f"{self._permute(int(north), 10**10, 'phone'):010d}"
                if self._assignable(north) == valid:
                    return refill(text, digits[:-10] + north)
        if not text.startswith("+") or not 8 <= len(digits) <= 15 or digits[0] == "0":
            return None
        size = 10 ** (len(digits) - 2)
        rest = self._permute(int(digits[2:]), size, f"phone{digits[:2]}:{size}")
        return refill(text, digits[:2] + str(rest).zfill(len(digits) - 2))

    @staticmethod
    def _assignable(north: str) -> bool:
        """Area and exchange codes of North American numbers begin with 2 to 9."""
        return north[0] not in "01" and north[3] not in "01"

    def ip(self, text: str) -> str | None:
        """Dotted quads; each part keeps its number of digits."""
        parts = text.split(".")
        if max(map(int, parts)) > 255 or any(len(p) > 1 and p[0] == "0" for p in parts):
            return None
        first = {1: 0, 2: 10, 3: 100}
        sizes = [{1: 10, 2: 90, 3: 156}[len(p)] for p in parts]
        value, size = 0, 1
        for part, count in zip(parts, sizes):
            value, size = value * count + int(part) - first[len(part)], size * count
        value, out = self._permute(value, size, f"ip{sizes}"), []
        for part, count in zip(reversed(parts), reversed(sizes)):
            value, place = divmod(value, count)
            out.append(str(place + first[len(part)]))
        return ".".join(reversed(out))

    def social(self, text: str) -> str | None:
        """US social security numbers: area 001 to 899 without 666, group from 01, serial from 0001."""
        mark = text[3]
        area, group, serial = map(int, text.split(mark))
        if area in (0, 666) or area > 899 or not group or not serial:
            return None
        value = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
        value, serial = divmod(self._permute(value, 898 * 99 * 9999, "social"), 9999)
        area, group = divmod(value, 99)
        area += 1
        return f"{area + (area >= 666):03d}{mark}{group + 1:02d}{mark}{serial + 1:04d}"

    def iban(self, text: str) -> str | None:
        """Country and layout stay, the account part is permuted, the check digits are renewed."""
        plain = text.replace(" ", "")
        if not 15 <= len(plain) <= 34 or self._mod97(plain[4:] + plain[:4]) != 1:
            return None
        account = self.characters(plain[4:], f"iban{plain[:2]}")
        check = 98 - self._mod97(f"{account}{plain[:2]}00")
        fresh = iter(f"{plain[:2]}{check:02d}{account}")
        return "".join(c if c == " " else next(fresh) for c in text)

    @staticmethod
    def _mod97(text: str) -> int:
        return int("".join(str(int(c, 36)) for c in text)) % 97

    def date(self, text: str) -> str | None:
        """Dates from 1900 to 2099, permuted among those that are written alike."""
        a, mark, b, _, c = re.split(r"([-./])", text)
        if len(a) == 4:
            order, parts = "ymd", (a, b, c)
        elif mark == "." or int(a) > 12:
            order, parts = "dmy", (c, b, a)
        else:
            order, parts = "mdy", (c, a, b)
        try:
            day = datetime.date(*map(int, parts))
        except ValueError:
            return None
        if not FIRST_DAY <= day <= LAST_DAY:
            return None
        # Day-first dates with slashes are told from month-first ones by a day over 12 and keep one.
        late = order == "dmy" and mark != "."
        wide = {part: len(value) for part, value in zip(order, (a, b, c))}
        days, places = _days_written(late, wide["m"], wide["d"])
        tweak = ("late" if late else "date") + ("" if wide["m"] == wide["d"] == 2 else f"{wide['m']}{wide['d']}")
        day = days[self._permute(places[day], len(days), tweak)]
        y, m, d = f"{day.year:04d}", f"{day.month:0{wide['m']}d}", f"{day.day:0{wide['d']}d}"
        return mark.join({"y": y, "m": m, "d": d}[part] for part in order)

    def short_date(self, text: str) -> str | None:
        """Dates with slashes and two digits of the year, read as 1950 to 2049."""
        a, b, c = text.split("/")
        late = int(a) > 12
        month, day = (b, a) if late else (a, b)
        year = int(c) + (2000 if int(c) < 50 else 1900)
        try:
            days, places = _days_written(late, len(month), len(day), 1950, 2049)
            place = places[datetime.date(year, int(month), int(day))]
        except (ValueError, KeyError):
            return None
        found = days[self._permute(place, len(days), f"short{late}{len(month)}{len(day)}")]
        m, d = f"{found.month:0{len(month)}d}", f"{found.day:0{len(day)}d}"
        return "/".join((d, m) if late else (m, d)) + f"/{found.year % 100:02d}"

    def long_date(self, text: str) -> str | None:
        """Dates with a month's name, permuted among those with names and days of equal length."""
        name = re.search(r"[A-Za-z]{3,}", text)[0]
        day, year = re.findall(r"\d+", text)
        month = next(n for n, full in enumerate(MONTHS, 1) if name.lower() in (full, full[:3]))
        short = len(name) == 3
        days, places = _days_named(short, len(name), len(day))
        try:
            place = places[datetime.date(int(year), month, int(day))]
        except (ValueError, KeyError):
            return None
        found = days[self._permute(place, len(days), f"named{short}{len(name)}{len(day)}")]
        fresh = MONTHS[found.month - 1][: 3 if short else None]
        fresh = fresh.upper() if name.isupper() else fresh.capitalize() if name[0].isupper() else fresh
        numbers = iter((f"{found.day:0{len(day)}d}", f"{found.year:04d}"))
        return re.sub(r"\d+", lambda _: next(numbers), text.replace(name, fresh))

    def ip6(self, text: str) -> str | None:
        """Colon-separated groups, their hexadecimal digits permuted; the head of local ones stays."""
        groups, local = text.split(":"), text[:6].lower() == "fe80::"
        if "::" in text:
            # Scope operators look alike: an address has a decimal digit and more than two groups.
            if len(groups) > 8 or not re.search(r"\d", text) or not local and len(list(filter(None, groups))) < 3:
                return None
        at = 6 if local else 0
        digits = text[at:].replace(":", "")
        if digits.isdecimal():
            alphabet = DIGITS
        else:
            alphabet = DIGITS + ("ABCDEF" if digits.upper() == digits else "abcdef")
            digits = digits if alphabet[-1] == "F" else digits.lower()
        tweak = "-".join(str(len(g)) for g in text[at:].split(":"))
        while True:  # along the cycle to the next address of the same kind
            digits = self._digits(digits, alphabet, f"ip6{tweak}")
            fresh = iter(digits)
            found = text[:at] + "".join(c if c == ":" else next(fresh) for c in text[at:])
            whole = alphabet == DIGITS or not digits.isdecimal() and ("::" not in text or re.search(r"\d", found))
            if whole and (found[:6].lower() == "fe80::") == local:
                return found

    def marked_phone(self, text: str) -> str | None:
        """Ten digits in a row after a word such as "phone", which stays."""
        number = self.phone(text[-10:])
        return None if number is None else text[:-10] + number

    def token(self, text: str) -> str | None:
        """Access tokens with a known beginning, which stays."""
        at = re.match(TOKEN_START, text).end()
        return text[:at] + self.characters(text[at:], "token")

    def email(self, text: str) -> str | None:
        name, domain = text.rsplit("@", 1)
        labels = domain.split(".")
        return f"{self.characters(f'{name}@{labels[0]}', 'email')}." + ".".join(labels[1:])

    def secret(self, text: str) -> str | None:
        """Access keys and hexadecimal secrets; the marker before them stays."""
        if text.startswith("AKIA"):
            return "AKIA" + self._digits(text[4:], DIGITS + UPPER, "key")
        at = re.search(r"[0-9a-fA-F]{16,}$", text).start()
        value = text[at:]
        # One case only: a mixed value is written in lower case.
        alphabet = DIGITS + ("ABCDEF" if value.upper() == value else "abcdef")
        return text[:at] + self._digits(value if alphabet[-1] == "F" else value.lower(), alphabet, "hex")

    def _digits(self, text: str, alphabet: str, tweak: str) -> str:
        base, value = len(alphabet), 0
        for c in text:
            value = value * base + alphabet.index(c)
        value = self._permute(value, base ** len(text), f"{tweak}{base}:{len(text)}")
        out = []
        for _ in text:
            value, place = divmod(value, base)
            out.append(alphabet[place])
        return "".join(reversed(out))


def _every_day() -> Iterator[datetime.date]:
    return (FIRST_DAY + datetime.timedelta(n) for n in range((LAST_DAY - FIRST_DAY).days + 1))


@functools.cache
def _days_written(
    late: bool, month: int, day: int, first: int = FIRST_DAY.year, last: int = LAST_DAY.year
) -> tuple[list[datetime.date], dict[datetime.date, int]]:
    """The days that can be written with so many digits of month and day, and their places."""
    days = [
        d
        for d in _every_day()
        if d.month < 10**month and d.day < 10**day and (not late or d.day > 12) and first <= d.year <= last
    ]
    return days, {d: place for place, d in enumerate(days)}


@functools.cache
def _days_named(short: bool, name: int, day: int) -> tuple[list[datetime.date], dict[datetime.date, int]]:
    """The days whose month's name, or its beginning, and day of the month have so many characters.

    "May" is a beginning like the others.
    """
    days = [
        d
        for d in _every_day()
        if (short or len(MONTHS[d.month - 1]) == name) and (day == 2 or d.day < 10)
    ]
    return days, {d: place for place, d in enumerate(days)}


# Kinds in order of precedence; the name is that of the method that validates and replaces.  Values
# of written-out length end where their pattern ends; cards and IBANs are cut from what it matches.
_MONTH = "(?:" + "|".join(f"{name}|{name[:3]}" for name in MONTHS) + ")"
KINDS = {
    "email": r"(?<![\w.%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "secret": r"\bAKIA[0-9A-Z]{16}\b|(?i:\b(?:password|passwd|secret|token|api_?key)[\"']?\s*[=:]\s*[\"']?)[0-9a-fA-F]{16,}(?![0-9A-Za-z])",
    "token": rf"(?<![A-Za-z0-9_])(?:{TOKEN_START})[A-Za-z0-9_-]{{16,}}",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]){11,30}",
    "date": r"(?<![\d./-])(?:\d{4}(?P<m1>[-./])\d{1,2}(?P=m1)\d{1,2}|\d{1,2}(?P<m2>[./-])\d{1,2}(?P=m2)\d{4})(?![\d/-]|\.\d)",
    "short_date": r"(?<![\w./-])\d{1,2}/\d{1,2}/\d{2}(?![\w/-]|\.\d)",
    "long_date": rf"(?<![A-Za-z0-9])(?i:{_MONTH}\.? \d{{1,2}},? \d{{4}}|\d{{1,2}} {_MONTH}\.?,? \d{{4}})(?![A-Za-z0-9])",
    "social": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])|(?<![\d-])(?<!\d )\d{3} \d{2} \d{4}(?! ?\d|-)",
    "ip6": r"(?<![\w:.])(?:(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}|(?:[0-9a-fA-F]{1,4}:){1,6}(?::[0-9a-fA-F]{1,4}){1,6})(?![\w:])",
    "ip": r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d]|\.\d)",
    "card": r"(?<![\d+])[2-6](?:[ .-]?\d){12,18}",
    "marked_phone": r"(?i:(?<!\w)(?:phone|telephone|tel|mobile|cell|fax|whatsapp)(?: (?:number|no))?[.:]{0,2} (?:is )?)[2-9]\d{9}(?!\w)",
    "phone": r"(?<![\w+(])(?:\+1[ .-]?)?\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}(?!\d)"
    r"|(?<![\w+])(?:\+1[ .-]?)?\d{3}[ .-]\d{3}[ .-]\d{4}(?![\d-])"
    r"|(?<![\w+])\+\d(?:[ .-]?(?:\(\d{1,4}\)|\d)){7,14}(?!\d)",
}
PATTERN = re.compile("|".join(f"(?P<{kind}>{pattern})" for kind, pattern in KINDS.items()))
_ALONE = {kind: re.compile(pattern) for kind, pattern in KINDS.items()}
_AFTER = {kind: list(KINDS)[place:] for place, kind in enumerate(KINDS)}
_MAYBE = re.compile(rf"[0-9]|@[A-Za-z0-9-]+\.|{TOKEN_START}")

# How cards are written: in one run, or in these groups with one mark between them.
CARD_GROUPS = ([4, 4, 4, 4], [4, 6, 5], [4, 6, 4], [4, 4, 4, 4, 3])
IBAN_LENGTHS = {
    country: int(length)
    for country, length in re.findall(
        r"([A-Z]{2})(\d\d)",
        "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29"
        " ES24 FI18 FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20"
        " LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29"
        " PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20"
        " YE30",
    )
}


@functools.lru_cache(64)
def iban_cuts(found: str) -> tuple[list[int], list[int]]:
    """Where an IBAN at the start of ``found`` may end, before a character that isn't part of a word:
    at its country's length; of an unknown country, anywhere, the longest first."""
    country, length, cuts = IBAN_LENGTHS.get(found[:2]), 0, []
    for place, c in enumerate(found[:-1]):
        length += c != " "
        if c != " " and length >= 15 and not (found[place + 1].isalnum() or found[place + 1] == "_"):
            if country in (None, length):
                cuts.append(place + 1)
    return (cuts, []) if country else ([], cuts[::-1])


@functools.lru_cache(64)
def card_cuts(found: str) -> tuple[list[int], list[int]]:
    """Where a card at the start of ``found`` may end: after the usual groups; after other whole runs.

    Single digits in a row are rather a list of numbers: of those only the longest cut is tried.
    """
    runs = [(m.start(), m.end()) for m in re.finditer(r"\d+", found[:-1])]
    usual, other, digits = [], [], 0
    for number, (_, end) in enumerate(runs):
        digits += end - runs[number][0]
        if 13 <= digits <= 19 and found[end] not in DIGITS:
            marks = {found[e] for _, e in runs[:number]}
            one_way = number == 0 or len(marks) == 1 and [e - s for s, e in runs[: number + 1]] in CARD_GROUPS
            if one_way:
                usual.append(end)
            elif "." not in found[:end]:  # else rather decimal numbers in a row
                other.append(end)
    if any(end - start == 1 for start, end in runs):
        other = other[-1:]
    return usual, other[::-1]


CUTS = {"iban": iban_cuts, "card": card_cuts}


def _found(text: str, at: int, kind: str, names: Pseudonyms, usual: bool = True) -> tuple[int, str] | None:
    """End and pseudonym of the value of a kind that starts at ``at``; ``usual`` picks the ways to cut it."""
    match = _ALONE[kind].match(text, at)
    if match is None:
        return None
    if kind in CUTS:
        cuts = CUTS[kind](f"{text[at : match.end() + 1]} ")[0 if usual else 1]
    else:
        cuts = [match.end() - at]
    for cut in cuts:
        value = getattr(names, kind)(text[at : at + cut])
        if value is not None:
            return at + cut, value
    return None


def _unusual(text: str, at: int, names: Pseudonyms) -> tuple[int, str] | None:
    """An IBAN of an unknown country or a card in other groups, unless a value of usual form starts
    inside: such a match is more likely to be chance."""
    for kind in CUTS:
        found = _found(text, at, kind, names, usual=False)
        if found:
            starts = (at + m.end() for m in re.finditer(r"[ -](?=[A-Z0-9])", text[at : found[0]]))
            if not any(_found(text, start, other, names) for start in starts for other in _AFTER["iban"]):
                return found
    return None


def replaced(text: str, names: Pseudonyms) -> tuple[str, int]:
    """``text`` with its personal values replaced, and how many there were.

    Where a value doesn't validate the next kinds are tried at the same place, then all
    from the next character on: what stands beside a value doesn't hide it.
    """
    out, done, at = [], 0, 0
    while (match := PATTERN.search(text, at)) is not None:
        at = match.start()
        tries = (_found(text, at, kind, names) for kind in _AFTER[match.lastgroup])
        found = next(filter(None, tries), None) or _unusual(text, at, names)
        if found is None:
            at += 1
            continue
        out += text[done:at], found[1]
        done = at = found[0]
    return "".join((*out, text[done:])), len(out) // 2


def pseudonymise(
    docs: DataFrame, key: bytes, text: str = "text", count: str = "n_pseudonyms", inverse: bool = False
) -> DataFrame:
    """``docs`` with ``text`` rewritten and a column ``count`` of replaced values, one row per row.

    Length and layout of a text stay.  A null text stays null with count 0, an empty one
    empty; other columns pass through, one named like ``count`` is replaced.  Values that
    don't validate (a wrong check digit, an impossible date) are left alone.
    """
    keep = [c for c in docs.columns if c != count]
    place = keep.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Pseudonyms(key, inverse)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts, counts = [], []
                for value in part.column(place).to_pylist():
                    n = 0
                    if value and _MAYBE.search(value):
                        value, n = replaced(value, names)
                    texts.append(value)
                    counts.append(n)
                columns = part.columns
                columns[place] = pa.array(texts, columns[place].type)
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(counts, pa.int64())], names=[*part.schema.names, count]
                )

    schema = docs.select(keep).schema.add(count, "long")
    return docs.select(keep).mapInArrow(run, schema)
