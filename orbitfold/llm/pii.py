"""Format-preserving pseudonyms for personal numbers, dates and addresses.

Found values are validated (check digits, calendar, ranges), turned into an integer of their format's domain, permuted
there by a keyed Feistel network with cycle walking, and written back in the same format, so that the result is valid
too and equal values get equal pseudonyms in every document. With the key the permutation can be inverted.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ship, slices

ROUNDS = 8
#: Characters of an address that are permuted together.
PIECE = 64
KINDS = ("card", "iban", "ssn", "phone", "date", "ip", "email")

#: Days of 1900 to 2099: those up to the 12th of a month, and the others. Only the first can be read in two orders.
_DAYS = [datetime.date.fromordinal(d) for d in range(datetime.date(1900, 1, 1).toordinal(), datetime.date(2100, 1, 1).toordinal())]
_HALVES = [[d for d in _DAYS if (d.day > 12) == late] for late in (False, True)]
_PLACE = {d: k for half in _HALVES for k, d in enumerate(half)}

_ANY = re.compile(r"[0-9@]")
#: What follows the local part of an address.
_AT = re.compile(r"@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+")
_FIND = re.compile(
    r"(?<![\w.])(?P<iban>[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?!\w)"
    r"|(?P<phone>(?<![\w+])\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}(?!\w)|(?<![\w(])\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?!\w)|(?<![\w.+-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![\w-]))"
    r"|(?<![\w.])(?P<ip>[0-9]{1,3}(?:\.[0-9]{1,3}){3})(?!\w|\.[0-9])"
    r"|(?<![\w./-])(?P<date>[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}[./-][0-9]{2}[./-][0-9]{4})(?![\w/-]|\.[0-9])"
    r"|(?<![\w-])(?P<ssn>[0-9]{3}-[0-9]{2}-[0-9]{4})(?![\w-])"
    r"|(?<![\w.+-])(?P<card>[0-9](?:[ -]?[0-9]){12,18})(?![\w-]|\.[0-9])"
)

#: Characters of an IBAN of each country.
_IBAN = dict(re.findall(r"([A-Z]{2})([0-9]{2})", "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30"))


class Feistel:
    """Keyed permutations of 0 .. n - 1 for any n."""

    def __init__(self, key: bytes, rounds: int = ROUNDS):
        if rounds < 4:
            raise ValueError("too few rounds")
        self.key, self.rounds = hashlib.blake2b(key, digest_size=32).digest(), rounds

    def _f(self, kind: str, n: int, i: int, x: int) -> int:
        return int.from_bytes(hashlib.blake2b(f"{kind}|{n}|{i}|{x}".encode(), key=self.key, digest_size=16).digest(), "big")

    def permute(self, kind: str, x: int, n: int) -> int:
        a = isqrt(n - 1) + 1 if n > 1 else 1
        while True:
            left, right = divmod(x, a)
            for i in range(self.rounds):
                left, right = right, (left + self._f(kind, n, i, right)) % a
            x = left * a + right
            if x < n:
                return x

    def invert(self, kind: str, y: int, n: int) -> int:
        a = isqrt(n - 1) + 1 if n > 1 else 1
        while True:
            left, right = divmod(y, a)
            for i in reversed(range(self.rounds)):
                left, right = (right - self._f(kind, n, i, left)) % a, left
            y = left * a + right
            if y < n:
                return y


def luhn(digits: str) -> int:
    """The sum that is 0 modulo 10 for a valid number."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10


def _refill(shape: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c in "0123456789" else c for c in shape)


def _mod97(s: str) -> int:
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97


def _iban_end(s: str) -> int | None:
    """Where the IBAN of its country ends if a space follows there."""
    left = int(_IBAN.get(s[:2], 99))
    for i, c in enumerate(s):
        if not left:
            return i if c == " " else None
        left -= c != " "
    return None


def _ends(kind: str, s: str) -> list[int]:
    """Ends of what may be a value in a match, best first: it may have taken in what follows the value."""
    if kind == "iban" and (end := _iban_end(s)):
        return [end, len(s)]
    out = [len(s)]
    if kind == "card":
        groups = [(g.end(), len(g[0])) for g in re.finditer("[0-9]+", s)]
        for k in range(len(groups) - 1, 0, -1):
            n = [size for _, size in groups[:k]]
            even = n[0] > 2 and len({*n[:-1]}) <= 1 and n[-1] <= n[0]
            if 13 <= sum(n) <= 19 and (even or n in ([4, 6, 5], [4, 6, 4], [4, 3, 3, 3])):
                out.append(groups[k - 1][0])
    return out


def addresses(text: str) -> list[tuple[int, int]]:
    """Where mail addresses are: from each sign back over the local part, however long, so that each text is read once."""
    out, last = [], 0
    for m in _AT.finditer(text):
        begin = m.start()
        while begin > last and (text[begin - 1].isalnum() or text[begin - 1] in "_.+-"):
            begin -= 1
        while begin < m.start() and not text[begin].isalnum():
            begin += 1
        if begin < m.start() and text[m.start() - 1].isalnum():
            out.append((begin, m.end()))
        last = m.end()
    return out


def _ssn_ok(d: str) -> bool:
    return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"


class Pseudonyms:
    """Finds and replaces; ``forward`` false inverts."""

    def __init__(self, key: bytes, forward: bool = True, kinds: tuple[str, ...] = KINDS):
        f = Feistel(key)
        self.move, self.kinds = (f.permute if forward else f.invert), frozenset(kinds)
        self.value = lru_cache(100_000)(self._value)

    def _digits(self, kind: str, d: str) -> str:
        return str(self.move(kind, int(d), 10 ** len(d))).zfill(len(d))

    def _value(self, kind: str, s: str) -> str | None:
        """The pseudonym, or None if ``s`` is not valid."""
        d = "".join(c for c in s if c in "0123456789")
        if kind == "card":
            if luhn(d) or len(set(d)) == 1:
                return None
            shifted = luhn(d + "0")  # kept, so that a number with the digits after it stays as invalid as it was
            while True:  # numbers of one digit are not valid cards: walked past
                body = self._digits(kind, d[:-1])
                d = body + str(-luhn(body + "0") % 10)
                if len(set(d)) > 1 and luhn(d + "0") == shifted:
                    return _refill(s, d)
        if kind == "phone":
            if not 8 <= len(d) <= 15:
                return None
            keep = len(re.match(r"\+?([0-9]{1,3})?", s)[1] or "") if s[0] == "+" else 0
            return _refill(s, d[:keep] + self._digits(kind, d[keep:]))
        if kind == "ssn":
            if not _ssn_ok(d):
                return None
            while True:
                d = self._digits(kind, d)
                if _ssn_ok(d):
                    return _refill(s, d)
        if kind == "ip":
            parts = [int(p) for p in s.split(".")]
            if any(p > 255 for p in parts) or any(p != "0" and p[0] == "0" for p in s.split(".")):
                return None
            x = self.move(kind, int.from_bytes(bytes(parts), "big"), 1 << 32)
            return ".".join(map(str, x.to_bytes(4, "big")))
        if kind == "date":
            for order in ("ymd",) if s[4] in "-/" else ("dmy", "mdy"):
                p = [int(x) for x in re.split(r"[./-]", s)]
                try:
                    day = datetime.date(*(p[order.index(c)] for c in "ymd"))
                except ValueError:
                    continue
                if day not in _PLACE:
                    return None
                half = _HALVES[day.day > 12]  # one domain for all notations, in which none changes the order it is read in
                new = half[self.move(f"{kind}{day.day > 12}", _PLACE[day], len(half))]
                text = {"y": f"{new.year:04d}", "m": f"{new.month:02d}", "d": f"{new.day:02d}"}
                return _refill(s, "".join(text[c] for c in order))
            return None
        if kind == "iban":
            flat = s.replace(" ", "")
            if not 15 <= len(flat) <= 34 or _mod97(flat) != 1:
                return None
            short = _iban_end(s)
            while True:  # walked past where the country's IBAN would be read in it
                bban = flat[4:]
                flat = flat[:4] + self._mixed(kind + flat[:2], bban)
                check = 98 - _mod97(flat[:2] + "00" + flat[4:])
                it = iter(f"{flat[:2]}{check:02d}{flat[4:]}")
                new = "".join(c if c == " " else next(it) for c in s)
                if not short or _mod97(new[:short].replace(" ", "")) != 1:
                    return new
        local, _, domain = s.partition("@")  # an address: letters and digits of the local part
        return self._mixed(f"{kind}|{domain.lower()}", local) + "@" + domain

    def _mixed(self, kind: str, s: str) -> str:
        """Digits go to digits, letters a-z to such of the same case; the domain is that of the places of both.

        Strings of more than PIECE characters are permuted piece by piece, so that their length costs no more than itself.
        """
        if len(s) > PIECE:
            return "".join(self._mixed(f"{kind}|{i}", s[i : i + PIECE]) for i in range(0, len(s), PIECE))
        size = [26 if c.isascii() and c.isalpha() else 10 if c in "0123456789" else 1 for c in s]
        base = [ord("a") if k == 26 and c.islower() else ord("A") if k == 26 else ord("0") if k == 10 else ord(c) for c, k in zip(s, size, strict=True)]
        x, n = 0, 1
        for c, b, k in zip(s, base, size, strict=True):
            x, n = x * k + (ord(c) - b), n * k
        x, out = self.move(f"{kind}|{','.join(map(str, size))}", x, n), []
        for b, k in zip(reversed(base), reversed(size), strict=True):
            x, r = divmod(x, k)
            out.append(chr(b + r))
        return "".join(reversed(out))

    def replace(self, text: str) -> tuple[str, list[tuple[str, int, int]]]:
        """The text with pseudonyms, and (kind, begin, end) of each value in the original."""
        if not _ANY.search(text):
            return text, []
        out, at, spans, pos = [], 0, [], 0
        mails = iter(addresses(text) if "email" in self.kinds else ())
        mail = next(mails, None)
        m = _FIND.search(text)
        while m or mail:
            while m and m.start() < pos:
                m = _FIND.search(text, pos)
            if mail and mail[0] < pos:
                mail = next(mails, None)
                continue
            if mail and (not m or mail[0] < m.end()):  # an address takes in numbers that overlap it
                begin, end = mail
                out += [text[at:begin], self.value("email", text[begin:end])]
                at = pos = end
                spans.append(("email", begin, end))
                mail = next(mails, None)
                continue
            if not m:
                break
            kind = m.lastgroup
            new = None
            for n in _ends(kind, m[0]) if kind in self.kinds else ():
                if (new := self.value(kind, m[0][:n])) is not None:
                    break
            if new is None:
                pos = m.start() + 1
                while pos < len(text) and text[pos - 1] in "0123456789" and text[pos] in "0123456789":
                    pos += 1
                m = _FIND.search(text, pos)
                continue
            out += [text[at : m.start()], new]
            at = pos = m.start() + n
            spans.append((kind, m.start(), at))
            m = _FIND.search(text, pos)
        out.append(text[at:])
        return "".join(out), spans


def pseudonymise(docs: DataFrame, key: bytes, text_col: str = "text", id_col: str = "doc_id", forward: bool = True, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """Per document: id, text with pseudonyms, n_found, and n_<kind> for each kind.

    Null text stays null and has nothing found. Values that do not validate stay as they are. Repeated rows each give a
    row; other columns are ignored; an empty table gives an empty result; very long texts are read whole, in linear time.
    ``forward=False`` restores the texts. A date has one pseudonym in all notations, and keeps whether it is after the
    12th of its month; letters of account numbers and addresses become other letters. Numbers without any separator are
    taken for cards only, as nine digits alone do not tell what they are.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Pseudonyms(key, forward, kinds)
        for b in slices(batches, "__text"):
            done = [(None, []) if t is None else p.replace(t) for t in b.column(1).to_pylist()]
            counts = [[sum(x[0] == k for x in spans) for _, spans in done] for k in KINDS]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t for t, _ in done], pa.string()), pa.array([len(x) for _, x in done], pa.int64()), *(pa.array(c, pa.int64()) for c in counts)], [id_col, "text", "n_found", *(f"n_{k}" for k in KINDS)])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, text string, n_found long, " + ", ".join(f"n_{k} long" for k in KINDS)
    return docs.select(id_col, docs[text_col].alias("__text")).mapInArrow(run, schema)
