"""Personal data: format-preserving Feistel pseudonyms.

Values are found by pattern and validated (check digits, calendar, ranges); what fails stays as it
is. A valid value becomes a number of its format's range, a keyed Feistel network with cycle walking
permutes that range, and the result is written back in the same format with check digits computed
anew. Equal values get equal pseudonyms in all documents, no value is its own pseudonym, and
:func:`restore` undoes it with the key. Each row is worked on where it is read.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from tsreg.llm.common import map_arrow, texts_of

ROUNDS = 8
FIRST_DAY = dt.date(1900, 1, 1).toordinal()
DAYS = dt.date(2100, 1, 1).toordinal() - FIRST_DAY
KEY_SETTING = "spark.tsreg.pseudonyms.key"


def _round(key: bytes, tweak: str, number: int, half: int, bits: int) -> int:
    data = f"{tweak}|{number}|{half}".encode()
    digest = hashlib.blake2b(data, key=key, digest_size=max(8, bits // 8 + 1)).digest()
    return int.from_bytes(digest, "big") & ((1 << bits) - 1)


def _feistel(value: int, bits: int, key: bytes, tweak: str, inverse: bool) -> int:
    """Balanced Feistel network on ``2 * bits`` bits."""
    left, right = value >> bits, value & ((1 << bits) - 1)
    for number in reversed(range(ROUNDS)) if inverse else range(ROUNDS):
        if inverse:
            left, right = right ^ _round(key, tweak, number, left, bits), left
        else:
            left, right = right, left ^ _round(key, tweak, number, right, bits)
    return left << bits | right


def _walk(value: int, size: int, key: bytes, tweak: str, inverse: bool) -> int:
    """The network restricted to 0 .. size-1: repeated until the value is inside."""
    bits = max(1, ((size - 1).bit_length() + 1) // 2)
    while True:
        value = _feistel(value, bits, key, tweak, inverse)
        if value < size:
            return value


@lru_cache(maxsize=4096)
def permute(value: int, size: int, key: bytes, tweak: str, inverse: bool = False) -> int:
    """Keyed permutation of 0 .. size-1 without fixed points (for a size above 1).

    The Feistel network hides a shift by a keyed amount: it is walked there, shifted, and walked back.
    """
    if size < 2:
        return value
    tweak = f"{tweak}|{size}"
    shift = 1 + _round(key, tweak, ROUNDS, 0, 64) % (size - 1)
    there = _walk(value, size, key, tweak, False)
    return _walk((there + (-shift if inverse else shift)) % size, size, key, tweak, True)


def permute_valid(value: int, size: int, valid: Callable[[int], bool], *how) -> int:
    """:func:`permute` within the valid numbers of a range: repeated until one comes up."""
    value = permute(value, size, *how)
    while not valid(value):
        value = permute(value, size, *how)
    return value


def luhn_digit(payload: str) -> str:
    total = 0
    for place, char in enumerate(reversed(payload)):
        digit = int(char) * (2 - place % 2)
        total += digit - 9 if digit > 9 else digit
    return str(-total % 10)


def _digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def _refill(shape: str, digits: str) -> str:
    """``shape`` with its digits replaced in order."""
    source = iter(digits)
    return "".join(next(source) if c in "0123456789" else c for c in shape)


def card(text: str, how) -> str | None:
    digits = _digits(text)
    if luhn_digit(digits[:-1]) != digits[-1] or not digits.strip("0"):
        return None
    n = len(digits) - 1
    payload = f"{permute_valid(int(digits[:-1]), 10**n, bool, *how):0{n}d}"
    return _refill(text, payload + luhn_digit(payload))


ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
ALPHABETS += ("ßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ")
ALPHABET_OF = {char: alphabet for alphabet in ALPHABETS for char in alphabet}


def characters(text: str, how) -> str:
    """Every letter and digit permuted within its alphabet, all together as one mixed-radix number."""
    value, size = 0, 1
    for char in text:
        alphabet = ALPHABET_OF.get(char, char)
        value, size = value * len(alphabet) + alphabet.index(char), size * len(alphabet)
    value, out = permute(value, size, *how), []
    for char in reversed(text):
        alphabet = ALPHABET_OF.get(char, char)
        value, place = divmod(value, len(alphabet))
        out.append(alphabet[place])
    return "".join(reversed(out))


def email(text: str, how) -> str | None:
    local, _, domain = text.rpartition("@")
    return f"{characters(local, how)}@{domain}"


def _iban_check(country: str, account: str) -> str:
    number = int("".join(str(int(c, 36)) for c in account + country + "00"))
    return f"{98 - number % 97:02d}"


def iban(text: str, how) -> str | None:
    plain = text.replace(" ", "")
    country, check, account = plain[:2], plain[2:4], plain[4:]
    if not 11 <= len(account) <= 30 or _iban_check(country, account) != check:
        return None
    account = characters(account, (*how[:1], f"{how[1]}|{country}", *how[2:]))
    source = iter(country + _iban_check(country, account) + account)
    return "".join(c if c == " " else next(source) for c in text)


def phone(text: str, how) -> str | None:
    country = re.match(r"\+[0-9]{1,3}(?=[ .(-])", text)
    begin = country.end() if country else 0
    digits = _digits(text[begin:])
    n = len(digits)
    if not 7 <= n <= 12:
        return None
    # a bare number keeps to the range that is read as one
    bare = begin == 0 and text[0] != "("
    number = permute_valid(int(digits), 10**n, lambda k: not bare or k >= 2 * 10 ** (n - 1), *how)
    return text[:begin] + _refill(text[begin:], f"{number:0{n}d}")


def address(text: str, how) -> str | None:
    parts = [int(p) for p in text.split(".")]
    if max(parts) > 255:
        return None
    number = permute(int.from_bytes(bytes(parts), "big"), 1 << 32, *how)
    return ".".join(map(str, number.to_bytes(4, "big")))


def social(text: str, how) -> str | None:
    def valid(number: int) -> bool:
        area, group, serial = number // 10**6, number // 10**4 % 100, number % 10**4
        return 0 < area < 900 and area != 666 and group > 0 and serial > 0

    number = int(_digits(text))
    if not valid(number):
        return None
    return _refill(text, f"{permute_valid(number, 10**9, valid, *how):09d}")


def _day(form: str, text: str) -> int | None:
    try:
        day = dt.datetime.strptime(text, form).date().toordinal() - FIRST_DAY
    except ValueError:
        return None
    return day if 0 <= day < DAYS else None


def date(text: str, how) -> str | None:
    """Dates of 1900 to 2099: year first, day first with points, month first with strokes (else day first)."""
    if text[4] == "-":
        forms = ["%Y-%m-%d"]
    else:
        forms = ["%d.%m.%Y"] if text[2] == "." else ["%m/%d/%Y", "%d/%m/%Y"]
    for k, form in enumerate(forms):
        day = _day(form, text)
        if day is None:
            continue
        write = lambda n: dt.date.fromordinal(n + FIRST_DAY).strftime(form)
        # a date that only reads day first stays one
        valid = lambda n: k == 0 or _day(forms[0], write(n)) is None
        return write(permute_valid(day, DAYS, valid, *how))
    return None


class Kind(NamedTuple):
    name: str
    pattern: re.Pattern
    replace: Callable[[str, tuple], str | None]


# in order of precedence where matches overlap
KINDS = (
    Kind("email", re.compile(r"(?<![\w.%+-])[\w%+-][\w.%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"), email),
    Kind("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"), iban),
    Kind(
        "card",
        re.compile(
            r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5})(?![0-9A-Za-z])"
        ),
        card,
    ),
    Kind("address", re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])"), address),
    Kind("date", re.compile(r"(?<![0-9.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}([./])[0-9]{2}\1[0-9]{4})(?![0-9-]|\.[0-9])"), date),
    Kind("social", re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"), social),
    Kind(
        "phone",
        re.compile(
            r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-][0-9]{3,4}"
            r"|\+[0-9]{1,3}[ .-]?[0-9]{2,4}(?:[ .-][0-9]{2,4}){1,3}"
            r"|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}"
            r"|(?<![0-9][.-])[2-9][0-9]{2}([.-])[0-9]{3}\1[0-9]{4})(?![0-9]|[.-][0-9])"
        ),
        phone,
    ),
)


DIGIT = re.compile("[0-9]")


def _apply(text: str, key: bytes, inverse: bool) -> tuple[str, list[tuple[int, int, str]]]:
    found: list[tuple[int, int, str, str]] = []
    digits = DIGIT.search(text) is not None
    for kind in KINDS:
        if not ("@" in text if kind.name == "email" else digits):
            continue
        # spans of earlier kinds, in order and apart from each other
        begins, ends = [a for a, _, _, _ in found], [b for _, b, _, _ in found]
        for match in kind.pattern.finditer(text):
            begin, end = match.span()
            after = bisect_right(ends, begin)
            if after < len(ends) and begins[after] < end:
                continue
            new = kind.replace(match[0], (key, kind.name, inverse))
            if new is not None:
                found.append((begin, end, kind.name, new))
        found.sort()
    out, at = [], 0
    for begin, end, _, new in found:
        out += [text[at:begin], new]
        at = end
    return "".join([*out, text[at:]]), [(a, b, name) for a, b, name, _ in found]


def replace(text: str, key: bytes) -> tuple[str, list[tuple[int, int, str]]]:
    """The text with pseudonyms, and where in the given text (start, end, kind) they stand."""
    return _apply(text, key, False)


def restore(text: str, key: bytes) -> str:
    """The text that :func:`replace` was given."""
    return _apply(text, key, True)[0]


def pseudonymise(docs: DataFrame, key: str | None = None) -> DataFrame:
    """``doc_id``, ``text`` with pseudonyms, ``n_found`` and ``spans`` of every row.

    ``spans`` lists ``kind:start:end`` of the given text in characters, joined by commas. Null text
    stays null, with nothing found. The key comes from the argument or the setting
    ``spark.tsreg.pseudonyms.key``; without any the call fails. Repeated rows come back as often as they
    come, null ids stay null, other columns are ignored, an empty table gives none. A text's time follows its
    length, whatever it holds.
    """
    given = key or docs.sparkSession.conf.get(KEY_SETTING, None)
    if not given:
        raise ValueError(f"pseudonyms need a secret key: pass one or set {KEY_SETTING}")
    secret = hashlib.blake2b(given.encode(), digest_size=32).digest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new, counts, spans = [], [], []
            for text, is_null in zip(texts_of(batch.column(1)), batch.column(1).is_null().to_pylist()):
                changed, places = replace(text.decode("utf-8", "replace"), secret)
                new.append(None if is_null else changed)
                counts.append(len(places))
                spans.append(",".join(f"{name}:{a}:{b}" for a, b, name in places))
            columns = [batch.column(0), pa.array(new, pa.string()), pa.array(counts, pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(spans, pa.string())], names=["doc_id", "text", "n_found", "spans"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, text string, n_found bigint, spans string"
    return map_arrow(docs.select("doc_id", "text"), run, schema)
