"""Format-preserving pseudonyms: personal numbers, dates and addresses are replaced by keyed permutations within their format."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import date, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from veridra.llm.common import slices

ROUNDS = 8
_FIRST_DAY, _DAYS = date(1900, 1, 1), (date(2100, 1, 1) - date(1900, 1, 1)).days


class Feistel:
    """Keyed permutation of 0..size-1: a balanced Feistel network over the next even number of bits, walked until the value
    falls inside. `label` keeps the formats' permutations apart."""

    def __init__(self, key: bytes, label: str, size: int):
        self.size, self.half = size, max(1, ((size - 1).bit_length() + 1) // 2)
        self.mask = (1 << self.half) - 1
        self.key = hashlib.blake2b(label.encode(), key=key[:64], digest_size=32).digest()

    def _round(self, i: int, half: int) -> int:
        data = i.to_bytes(1, "big") + half.to_bytes((self.half + 7) // 8, "big")
        return int.from_bytes(hashlib.blake2b(data, key=self.key, digest_size=(self.half + 7) // 8).digest(), "big") & self.mask

    def forward(self, x: int) -> int:
        while True:
            left, right = x >> self.half, x & self.mask
            for i in range(ROUNDS):
                left, right = right, left ^ self._round(i, right)
            x = left << self.half | right
            if x < self.size:
                return x

    def backward(self, x: int) -> int:
        while True:
            left, right = x >> self.half, x & self.mask
            for i in reversed(range(ROUNDS)):
                left, right = right ^ self._round(i, left), left
            x = left << self.half | right
            if x < self.size:
                return x


# The stretches of characters that replace each other.
CLASSES = (("0", 10), ("a", 26), ("A", 26), ("à", 23), ("ø", 8), ("À", 23), ("Ø", 7))


def _class(c: str) -> tuple[str, int] | None:
    return next(((first, n) for first, n in CLASSES if ord(first) <= ord(c) < ord(first) + n), None)


def permute_characters(text: str, key: bytes, label: str, back: bool = False) -> str:
    """Permute all texts of this shape: digits stay digits, letters letters of their case, the rest stays as it is."""
    classes = [_class(c) for c in text]
    value, size = 0, 1
    for c, k in zip(text, classes):
        if k:
            value, size = value * k[1] + ord(c) - ord(k[0]), size * k[1]
    if size == 1:
        return text
    shape = "".join(k[0] if k else c for c, k in zip(text, classes))
    network = Feistel(key, f"{label}:{shape}", size)
    value = network.backward(value) if back else network.forward(value)
    out = []
    for c, k in zip(reversed(text), reversed(classes)):
        if k:
            value, digit = divmod(value, k[1])
            c = chr(ord(k[0]) + digit)
        out.append(c)
    return "".join(reversed(out))


def luhn_digit(body: str) -> str:
    """The check digit that makes body + digit valid."""
    doubled = (2 * int(c) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(body)))
    return str(-sum(d - 9 if d > 9 else d for d in doubled) % 10)


def _card(text: str, key: bytes) -> str | None:
    digits = re.sub(r"\D", "", text)
    if luhn_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
        return None
    body = permute_characters(digits[:-1], key, "card")
    return _respelled(text, body + luhn_digit(body))


def _octets(text: str, key: bytes) -> str | None:
    parts = [int(p) for p in text.split(".")]
    if any(p > 255 for p in parts) or any(p != "0" and p[0] == "0" for p in text.split(".")):
        return None
    x = Feistel(key, "ip", 2**32).forward(int.from_bytes(bytes(parts), "big"))
    return ".".join(map(str, x.to_bytes(4, "big")))


def _respelled(spelling: str, digits: str) -> str:
    """The digits in the places of the spelling's digits."""
    new = iter(digits)
    return re.sub(r"\d", lambda _: next(new), spelling)


# Calling codes of one and two digits; all others have three.
_SHORT_CODES = re.compile(r"[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]")


def _phone(text: str, key: bytes) -> str | None:
    """The calling code stays, and so do the signs; the number's digits are permuted whatever the signs between them."""
    digits = re.sub(r"\D", "", text)
    if not 9 <= len(digits) <= 15:
        return None
    short = _SHORT_CODES.match(digits)
    code = short[0] if short else digits[:3]
    return _respelled(text, code + permute_characters(digits[len(code) :], key, f"phone {code}"))


def _email(text: str, key: bytes) -> str | None:
    """The name is permuted in lower case and gets its capitals back where it had them; the host stays."""
    name, _, host = text.rpartition("@")
    small = "".join(chr(ord(c) + 32) if (k := _class(c)) and k[0] in "AÀØ" else c for c in name)
    new = permute_characters(small, key, "email")
    return "".join(n if c == s else n.upper() for n, c, s in zip(new, name, small)) + "@" + host


_AREAS = [a for a in range(1, 900) if a != 666]
_AREA_AT = {a: i for i, a in enumerate(_AREAS)}


def _ssn(text: str, key: bytes) -> str | None:
    """Valid numbers, counted from 0, are permuted among themselves: area 001 to 899 without 666, group 01 to 99, serial 0001 to 9999."""
    area, group, serial = map(int, text.split("-"))
    if area not in _AREA_AT or not group or not serial:
        return None
    x = Feistel(key, "ssn", len(_AREAS) * 99 * 9999).forward((_AREA_AT[area] * 99 + group - 1) * 9999 + serial - 1)
    return f"{_AREAS[x // 9999 // 99]:03d}-{x // 9999 % 99 + 1:02d}-{x % 9999 + 1:04d}"


def _date(year: int, month: int, day: int, key: bytes) -> date | None:
    try:
        n = (date(year, month, day) - _FIRST_DAY).days
    except ValueError:
        return None
    return _FIRST_DAY + timedelta(Feistel(key, "date", _DAYS).forward(n)) if 0 <= n < _DAYS else None


def _iso_date(text: str, key: bytes) -> str | None:
    d = _date(*map(int, text.split("-")), key)
    return d and d.isoformat()


def _day_first(text: str, key: bytes) -> str | None:
    sign = text[2]
    day, month, year = map(int, text.split(sign))
    d = _date(year, month, day, key)
    return d and d.strftime(f"%d{sign}%m{sign}%Y")


#: a run that may hold an address's name, where a name can begin in it, and the two forms of host after its @: any address's, and that of one
#: whose name is the digits after a dot
_RUN, _FIRST, _NUMBER = re.compile(r"[\w.+-]+"), re.compile(r"[^\W_]"), re.compile(r"(?<=\.)\d+\Z")
_HOST = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
_LOOSE_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
#: characters that an address's name has at most
NAME = 64

#: kind, pattern, rule: pseudonym or None where the value is not valid. The first kind that matches a place has it; addresses come before all.
KINDS: tuple[tuple[str, str, Callable[[str, bytes], str | None]], ...] = (
    ("phone", r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)", _phone),
    ("iso_date", r"(?<![\d-])\d{4}-\d{2}-\d{2}(?![\d-])", _iso_date),
    ("day_date", r"(?<![\d./])\d{2}(?P<sep>[./])\d{2}(?P=sep)\d{4}(?![\d/])", _day_first),
    ("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])", _ssn),
    ("ip", r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)", _octets),
    ("card", r"(?<!\d)(?<!\d[ -])\d(?:[ -]?\d){12,18}(?!\d)|(?<!\d)\d{13,19}(?!\d)", _card),
)


@dataclass(frozen=True)
class PiiConfig:
    """`key` is secret in use; equal values get equal pseudonyms under one key."""

    key: bytes = b"demonstration key"


_NUMBERS = re.compile("|".join(f"(?P<{kind}>{pattern})" for kind, pattern, _ in KINDS))
_RULES = {kind: rule for kind, _, rule in KINDS}
_HINT = re.compile(r"\d[\d ().@/+-]{5,}\d|@")


def _addresses(text: str) -> Iterator[tuple[int, int, int, bool]]:
    """(start of the run before an @, the @, end of the host, whether any name will do), in order. Each run and each host is read once."""
    if "@" not in text:
        return
    for run in _RUN.finditer(text):
        at = run.end()
        if text[at : at + 1] == "@":
            host = _HOST.match(text, at + 1)
            loose = host or _LOOSE_HOST.match(text, at + 1)
            if loose:
                yield max(run.start(), at - NAME), at, loose.end(), host is not None


def _name(text: str, address: tuple[int, int, int, bool], done: int) -> int:
    """Where the address's name begins, not before `done`; -1 if there is no room for one."""
    begin, at, _, free = address
    begin = max(begin, done)
    found = _FIRST.search(text, begin, at) if free else _NUMBER.search(text, begin, at)
    return found.start() if found else -1


def _values(text: str) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of what looks like a value, from left to right without overlaps; where two begin at one place an address goes first."""
    done, addresses, number = 0, _addresses(text), _NUMBERS.search(text)
    address = next(addresses, None)
    while address or number:
        if number and number.start() < done:
            number = _NUMBERS.search(text, done)
            continue
        begin = _name(text, address, done) if address else -1
        if address and begin < 0:
            address = next(addresses, None)
        elif address and (number is None or begin <= number.start()):
            yield "email", begin, address[2]
            done, address = address[2], next(addresses, None)
        elif number:
            yield next(k for k, v in number.groupdict().items() if v is not None and k != "sep"), number.start(), number.end()
            done = number.end()


def pseudonymise(text: str, cfg: PiiConfig) -> tuple[str, list[str]]:
    """The text with its valid values replaced, and their kinds in order. Time grows with the text's length, whatever it holds."""
    found: list[str] = []
    if not _HINT.search(text):
        return text, found
    out, done = [], 0
    for kind, begin, end in _values(text):
        value = text[begin:end]
        new = _email(value, cfg.key) if kind == "email" else _RULES[kind](value, cfg.key)
        if new is None and kind == "card" and " " in value:
            # neighbouring numbers, not one number in groups: each stands for itself
            parts = [(_card(p, cfg.key) if 13 <= len(p) <= 19 else None, p) for p in value.split(" ")]
            found.extend("card" for p, _ in parts if p is not None)
            new = " ".join(old if p is None else p for p, old in parts)
        elif new is not None:
            found.append(kind)
        out += [text[done:begin], value if new is None else new]
        done = end
    return "".join([*out, text[done:]]), found


def pseudonyms(docs: DataFrame, text_col: str = "text", cfg: PiiConfig = PiiConfig()) -> DataFrame:
    """Replace the values in `text_col` of every row, whole text; every other column stays. Adds `pii_found` (long) and
    `pii_kinds` (distinct kinds, comma-joined), replacing columns of these names.

    Cards must pass the check digit (and the pseudonym does), dates exist between 1900 and 2099, octets stay below 256, and social security
    numbers give such as can be valid; numbers that fail stay as they are. A value keeps its pseudonym in another spelling: a card or phone
    number with other signs, a date in another order, an address in other capitals. Of an address's name the last 64 characters
    count. Very long texts are read whole, in time that grows with their length. A null text stays null with 0 found. Repeated rows get equal results, an empty table
    stays empty. Rows stay where they are: no shuffle.
    """
    kept = docs.drop("pii_found", "pii_kinds")
    at = kept.columns.index(text_col)
    schema = T.StructType([*kept.schema, T.StructField("pii_found", T.LongType()), T.StructField("pii_kinds", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, 1000, at):
                out = [(None, []) if t is None else pseudonymise(t, cfg) for t in piece.column(at).to_pylist()]
                columns = list(piece.columns)
                columns[at] = pa.array([t for t, _ in out], pa.string())
                counts, kinds = pa.array([len(k) for _, k in out], pa.int64()), pa.array([",".join(sorted(set(k))) for _, k in out], pa.string())
                yield pa.RecordBatch.from_arrays([*columns, counts, kinds], names=schema.names)

    return kept.mapInArrow(run, schema)
