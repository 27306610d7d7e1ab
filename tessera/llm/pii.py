"""Format-preserving pseudonyms for personal data, by a keyed Feistel network.

Numbers and dates that pass their own validity rules are replaced by other valid
ones of the same format: payment cards (Luhn), IBANs (mod 97), IPv4 addresses,
phone numbers, US social security numbers and calendar dates. E-mail addresses and
assigned secrets keep their lengths, separators and kinds of characters. The
replacement is a permutation of the format's values under a key, so equal values
have equal pseudonyms in all documents and different values never meet; a document
is changed on its own, and nothing is shuffled.

The permutation of 0 .. n - 1 is a balanced Feistel network over the two halves of
the value in a square that covers n. Its round function is keyed BLAKE2b in counter
mode, as wide as the half and 64 bits more, so a half of any length is mixed whole;
values that leave the range go through it again (cycle walking). The same network
run backwards with the key gives the values back.

A card, a phone number or an IBAN may stand among other groups of digits or letters (an expiry date,
a word), so a find that fails its check is tried again at every shorter end, and
then from every later start, that lies between groups. Secrets are found by their assignment: quoted ones of any
characters of their alphabet, others only if they hold letters and digits both.

Defined cases: null stays null, and empty texts stay empty; texts without valid
personal data come back as they are; digits within longer runs of digits or of
letters are no numbers; overlapping finds go to the first kind of KINDS; repeated
rows are changed alike; a very long text is one value in memory, and its finds are
looked for kind by kind; ids are carried whatever their type; other columns, also
ones named like a result, are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect
from collections.abc import Iterator
from datetime import date, timedelta
from functools import lru_cache
from ipaddress import IPv4Address
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame

#: For tests and examples; a deployment passes its own.
KEY = b"example key: replace it"
ROUNDS = 8


class Feistel:
    """A keyed permutation of 0 .. n - 1."""

    def __init__(self, key: bytes, tweak: str, n: int) -> None:
        self.key = hashlib.blake2b(key, digest_size=32, person=b"pseudonyms").digest()
        self.tweak, self.n, self.side = tweak.encode(), n, isqrt(max(0, n - 1)) + 1

    def _f(self, i: int, half: int) -> int:
        data = self.tweak + b"\0" + bytes([i]) + half.to_bytes((half.bit_length() + 7) // 8 or 1, "big")
        blocks = -(-(self.side.bit_length() + 64) // 512)
        wide = b"".join(hashlib.blake2b(data, key=self.key, salt=b.to_bytes(16, "big")).digest() for b in range(blocks))
        return int.from_bytes(wide, "big") % self.side

    def apply(self, x: int) -> int:
        while True:
            a, b = divmod(x, self.side)
            for i in range(ROUNDS):
                a, b = b, (a + self._f(i, b)) % self.side
            x = a * self.side + b
            if x < self.n:
                return x

    def undo(self, x: int) -> int:
        while True:
            a, b = divmod(x, self.side)
            for i in reversed(range(ROUNDS)):
                a, b = (b - self._f(i, a)) % self.side, a
            x = a * self.side + b
            if x < self.n:
                return x


def luhn(digits: str) -> int:
    """The sum that a valid number makes a multiple of ten."""
    return sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(map(int, reversed(digits)))) % 10


def iban_rest(value: str) -> int:
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97


def _refill(shape: str, digits: str) -> str:
    """Digits in the places of the shape's digits."""
    new = iter(digits)
    return "".join(next(new) if c.isdigit() else c for c in shape)


def is_hex(value: str) -> bool:
    return not value.isdigit() and re.fullmatch("[0-9a-f]+", value) is not None


#: Classes of characters: digits, lower and upper case.
CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
FIRST_DAY, DAYS = date(1900, 1, 1), (date(2100, 1, 1) - date(1900, 1, 1)).days

#: Lengths of IBANs by country, as the IBAN registry has them (fixed values).
IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY":
    28, "CZ": 24, "DE": 22, "DJ": 27, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22,
    "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HN": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ":
    20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MN": 20, "MR": 27, "MT": 31,
    "MU": 30, "NI": 28, "NL": 18, "NO": 15, "OM": 23, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24, "SC":
    31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "SO": 23, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24,
    "XK": 20, "YE": 30,
}


class Pseudonyms:
    """Pseudonyms under a key; each method takes a valid value or returns None."""

    def __init__(self, key: bytes = KEY, back: bool = False) -> None:
        self.key, self.back = key, back
        self.of = lru_cache(maxsize=200_000)(self._of)

    def permute(self, kind: str, n: int, x: int) -> int:
        f = Feistel(self.key, kind, n)
        return f.undo(x) if self.back else f.apply(x)

    def digits(self, kind: str, value: str) -> str:
        return f"{self.permute(f'{kind}{len(value)}', 10 ** len(value), int(value)):0{len(value)}d}" if value else value

    def classed(self, kind: str, value: str) -> str:
        """Characters permuted together, each within its class; hexadecimal secrets stay so, and no others become so."""
        hexadecimal = kind == "secret" and is_hex(value)
        while True:
            if hexadecimal:
                value = f"{self.permute(f'hex{len(value)}', 16 ** len(value), int(value, 16)):0{len(value)}x}"
            else:
                value = self._classed(kind, value)
            if kind != "secret" or is_hex(value) == hexadecimal:
                return value

    def _classed(self, kind: str, value: str) -> str:
        sets = [next((s for s in CLASSES if c in s), None) for c in value]
        n, x = 1, 0
        for c, s in zip(value, sets, strict=True):
            if s:
                n, x = n * len(s), x * len(s) + s.index(c)
        x = self.permute(f"{kind}{''.join(s[0] if s else '-' for s in sets)}", n, x)
        out = []
        for c, s in zip(reversed(value), reversed(sets), strict=True):
            if s:
                x, k = divmod(x, len(s))
                c = s[k]
            out.append(c)
        return "".join(reversed(out))

    def card(self, m: re.Match) -> str | None:
        plain = re.sub(r"[ -]", "", m[0])
        if not 13 <= len(plain) <= 19 or luhn(plain) or len(set(plain)) == 1:
            return None
        body = self.digits("card", plain[:-1])
        return _refill(m[0], body + str(-luhn(body + "0") % 10))

    def iban(self, m: re.Match) -> str | None:
        plain = m[0].replace(" ", "")
        if IBAN_LENGTH.get(plain[:2]) != len(plain) or iban_rest(plain) != 1:
            return None
        body = self.classed(f"iban{plain[:2]}", plain[4:])
        new = iter(plain[:2] + f"{98 - iban_rest(plain[:2] + '00' + body):02d}" + body)
        return "".join(c if c == " " else next(new) for c in m[0])

    def ip(self, m: re.Match) -> str | None:
        parts = m[0].split(".")
        if any(len(p) > 1 and p[0] == "0" or int(p) > 255 for p in parts):
            return None
        return str(IPv4Address(self.permute("ip", 1 << 32, int(IPv4Address(m[0])))))

    def ssn(self, m: re.Match) -> str | None:
        area, group, serial = map(int, m[0].split("-"))
        if area in (0, 666) or area > 899 or not group or not serial:
            return None
        areas = [a for a in range(1, 900) if a != 666]
        x = self.permute("ssn", len(areas) * 99 * 9999, (areas.index(area) * 99 + group - 1) * 9999 + serial - 1)
        x, serial = divmod(x, 9999)
        area, group = divmod(x, 99)
        return f"{areas[area]:03d}-{group + 1:02d}-{serial + 1:04d}"

    def phone(self, m: re.Match) -> str | None:
        plain = re.sub(r"\D", "", m[0])
        if not 7 <= len(plain) <= 15:
            return None
        keep = len(re.match(r"\+?(\d{0,3})", m[0])[1]) if m[0][0] == "+" else 0  # the country stays
        return _refill(m[0], plain[:keep] + self.digits(f"phone{plain[:keep]}", plain[keep:]))

    def day(self, m: re.Match) -> str | None:
        a, b, c = re.split(r"[-/.]", m[0])
        order = "ymd" if len(a) == 4 else ("mdy" if "/" in m[0] and int(a) <= 12 else "dmy")
        parts = dict(zip(order, map(int, (a, b, c)), strict=True))
        try:
            x = (date(parts["y"], parts["m"], parts["d"]) - FIRST_DAY).days
        except ValueError:
            return None
        if not 0 <= x < DAYS:
            return None
        if order == "ymd" or "." in m[0] or "-" in m[0]:
            new = FIRST_DAY + timedelta(days=self.permute("day", DAYS, x))
        else:  # with a slash the order is read from the month, so months first and days first permute apart
            days = _slashed(order)
            new = days[self.permute(f"day{order}", len(days), days.index(FIRST_DAY + timedelta(days=x)))]
        parts = {"y": f"{new.year:04d}", "m": f"{new.month:02d}", "d": f"{new.day:02d}"}
        mark = re.search(r"[-/.]", m[0])[0]
        return mark.join(parts[p] for p in order)

    def mail(self, m: re.Match) -> str | None:
        return f"{self.classed('mail', m[1])}@{m[2]}"

    def secret(self, m: re.Match) -> str | None:
        kind = "quoted" if m["quoted"] else "plain"
        value, a, b = m[kind], m.start(kind) - m.start(), m.end(kind) - m.start()
        new = self.classed("secret", value)
        if kind == "plain":  # letters and digits both, so that it is found again; the way back goes through the same values
            while new.isdigit() or not any(c.isdigit() for c in new) or not any(c.isalpha() for c in new):
                new = self.classed("secret", new)
        return m[0][:a] + new + m[0][b:]

    def _of(self, kind: str, value: str) -> str | None:
        m = KINDS[kind].fullmatch(value)
        return getattr(self, kind)(m) if m else None

    def replace(self, text: str) -> tuple[str, list[tuple[int, int, str]]]:
        """The text with pseudonyms, and (start, end, kind) of each in the text given."""
        if not ANY.search(text):
            return text, []
        found: list[tuple[int, int, str, str]] = []
        for kind, pattern in KINDS.items():
            earlier = sorted(found)
            starts = [f[0] for f in earlier]
            at = 0
            while m := pattern.search(text, at):
                at = m.end()
                k = bisect(starts, m.start())
                if k and earlier[k - 1][1] > m.start():
                    continue
                room = starts[k] - m.start() if k < len(starts) else len(m[0])
                for value in _ends(kind, m[0]):
                    if len(value) <= room and (new := self.of(kind, value)) is not None:
                        at = m.start() + len(value)
                        found.append((m.start(), at, kind, new))
                        break
                else:
                    if kind in GROUPED and (gap := GAP.search(m[0])):
                        at = m.start() + gap.end()
        found.sort()
        out, at = [], 0
        for a, b, _, new in found:
            out += [text[at:a], new]
            at = b
        return "".join([*out, text[at:]]), [(a, b, k) for a, b, k, _ in found]


def _ends(kind: str, value: str) -> Iterator[str]:
    """The find, and for numbers in groups what is left of it without the last groups."""
    yield value
    if kind in GROUPED:
        for m in reversed(list(GAP.finditer(value))):
            yield value[: m.start()]


@lru_cache(maxsize=2)
def _slashed(order: str) -> list[date]:
    """Dates that are written in this order with slashes: days first only where the first number is no month."""
    days = (FIRST_DAY + timedelta(days=i) for i in range(DAYS))
    return [d for d in days if order == "mdy" or d.day > 12]


#: Kinds that are written in groups, and what lies between these.
GROUPED, GAP = ("card", "iban", "phone"), re.compile("[ -]")
#: Cheap test that a text can hold anything below.
ANY = re.compile(r"[0-9@]|[=:>] ?[\"']")
#: Kinds by precedence.
KINDS = {
    "mail": re.compile(r"(?<![A-Za-z0-9._%+-])([A-Za-z0-9._%+-]{1,64})@((?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24})(?![A-Za-z0-9-])"),
    "secret": re.compile(
        r"(?i:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|private[_-]?key|credentials?)[\"']? ?(?:[=:]|=>) ?"
        r"(?:[\"'](?P<quoted>[!#-&(-~]{8,8192})[\"']|(?P<plain>(?=[A-Za-z+/_=.-]{0,8192}[0-9])(?=[0-9+/_=.-]{0,8192}[A-Za-z])[A-Za-z0-9+/_=.-]{7,8191}[A-Za-z0-9+/_=]))"
    ),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])"),
    "ip": re.compile(r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z]|\.[0-9])"),
    "day": re.compile(r"(?<![0-9A-Za-z/.-])(?:[0-9]{4}([-/.])[0-9]{2}\1[0-9]{2}|[0-9]{2}([-/.])[0-9]{2}\2[0-9]{4})(?![0-9A-Za-z]|[-/.][0-9])"),
    "ssn": re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])"),
    "card": re.compile(r"(?<![0-9A-Za-z+.-])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z]|[-.][0-9])"),
    "phone": re.compile(
        r"(?:(?<![0-9A-Za-z+.-])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,14}(?:[ .-][0-9]{2,10}){0,5}|"
        r"(?<![0-9A-Za-z+(.-])(?:\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}([.-])[0-9]{3}\1[0-9]{4}))(?![0-9A-Za-z]|[-.][0-9])"
    ),
}

RESULT = "text string, n_replaced long, kinds map<string,int>, spans array<struct<start:int,end:int,kind:string>>"


def pseudonymised(docs: DataFrame, key: bytes = KEY, id_col: str = "doc_id", text_col: str = "text", back: bool = False) -> DataFrame:
    """(id, text, n_replaced, kinds, spans) for each row; spans are places in the text given. back: undo it with the key."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Pseudonyms(key, back)
        for b in batches:
            texts, spans, kinds = [], [], []
            for t in b.column(1):
                text = t.as_py()
                new, found = names.replace(text) if text else (text, [])
                texts.append(new)
                spans.append([{"start": a, "end": z, "kind": k} for a, z, k in found])
                count: dict[str, int] = {}
                for *_, k in found:
                    count[k] = count.get(k, 0) + 1
                kinds.append(list(count.items()))
            span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())])
            columns = [b.column(0), pa.array(texts, pa.string()), pa.array(map(len, spans), pa.int64()), pa.array(kinds, pa.map_(pa.string(), pa.int32())), pa.array(spans, pa.list_(span))]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "text", "n_replaced", "kinds", "spans"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, {RESULT}")
