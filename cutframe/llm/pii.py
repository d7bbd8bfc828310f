"""Personal data: format-preserving Feistel pseudonyms.

Numbers and dates are found, validated, and permuted with a key inside their own format: a card number stays a card
number of the same length with a right check digit, a date stays a date. Values are permuted without their separators,
so equal values keep equal pseudonyms across documents and spellings, and the holder of the key can undo them. (Dates with
one-digit days or months, month-first ones and those with the month's name keep that form, and so pseudonyms of their own.)

Phones keep their country's code, and cards their check digit. Runs of 12 to 19 digits that are no cards count as account
numbers, which have no check digit of their own: every one is replaced.

Not found: months named in other languages than English, years of two digits, phones of seven digits or fewer.

A Feistel network of alternating modular additions is a permutation of [0, a * b); walking its cycle until the value falls below n
makes it a permutation of [0, n) for any n.

Defined results: null texts stay null, empty ones empty; matches that fail validation are kept unless a
wider kind takes them; repeated rows get equal texts; other columns pass through untouched.
"""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
from collections.abc import Callable
from datetime import date
from functools import lru_cache
from secrets import token_hex

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, unused

#: The session setting that holds the secret, and the key of tests and local runs where it is unset: it is public.
SETTING, KEY = "spark.cutframe.pii.key", "cutframe-pseudonyms"
ROUNDS = 8
# Names of months; shapes of the kinds, tried in this order at each place.
MONTHS = "January February March April May June July August September October November December".split()
_MONTH = "(?:" + "|".join(y(m) for m in [*MONTHS, "Sept", *(m[:3] for m in MONTHS)] for y in (str, str.upper, str.lower)) + ")"
PATTERN = re.compile(
    r"""
    (?<![\w.+-])(?P<email>[\w.+-]++@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,})
  | (?<![\w.])(?P<ip>[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3})(?![\w]|\.[0-9])
  | (?<![\w-])(?P<ymd>[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}(?:(?=[Tt][0-9])|(?![\w-]))|(?<!/)[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}(?:(?=[Tt][0-9])|(?![\w/-])))
  | (?<![\w/.])(?P<dmy>[0-9]{1,2}[/.][0-9]{1,2}[/.][0-9]{4}(?:(?=[Tt][0-9])|(?![\w/]|\.[0-9]))|(?<!-)[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}(?![\w-]))
  | (?<![\w/.-])(?P<written>MONTH\.?\x20[0-9]{1,2}(?:st|nd|rd|th)?,?\x20[0-9]{4}|[0-9]{1,2}(?:st|nd|rd|th)?\.?\x20MONTH\.?,?\x20[0-9]{4})(?!\w)
  | (?<!\w)(?P<iban>[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?)(?!\w)
  | (?<![\w-])(?P<ssn>[0-9]{3}-[0-9]{2}-[0-9]{4})(?![\w-])
  | (?<!\w)(?P<phone>\+1[\x20.-]?\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{4}|\+[0-9](?:[\x20.-]?\(?[0-9]\)?){6,14})(?!\w|\.[0-9])
  | (?<!\w)(?P<card>[0-9]{4}(?:\x20[0-9]{4}){3}|[0-9]{4}(?:-[0-9]{4}){3})(?!\w)
  | (?<!\w)(?P<number>[0-9](?:[\x20-]?[0-9]){11,18})(?!\w)
  | (?<![\w.-])(?P<national>(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}|(?:\(0[1-9][0-9]{0,4}\)\x20?|0[1-9][0-9]{0,4}[\x20/-])[0-9]{2,8}(?:[\x20/-][0-9]{2,8}){0,4}|0[1-9][0-9]{7,9})(?!\w|\.[0-9])
    """.replace("MONTH", _MONTH),
    re.VERBOSE,
)
#: Country codes of phones of one and two digits; all others have three.
ONE_DIGIT, TWO_DIGITS = "1 7".split(), "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
#: Every value has one of these, and none goes over a line break.
_SIGN = re.compile(r"[@0-9]")
FIRST_DAY, LAST_DAY = date(1900, 1, 1).toordinal(), date(2099, 12, 31).toordinal()
#: Counted kinds. A card in groups of four has a pattern of its own, so that no digits after it are taken in, and counts as a number;
#: a date with the month's name counts as dmy, a phone without a country's code as a phone.
COUNTED = {"card": "number", "written": "dmy", "national": "phone"}
KINDS = ("email", "ip", "ymd", "dmy", "iban", "ssn", "phone", "number")
LOWER_LATIN = "ßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", LOWER_LATIN)


def _round(key: bytes, tweak: str, r: int, half: int) -> int:
    return int.from_bytes(hashlib.blake2b(f"{tweak}|{r}|{half}".encode(), key=key, digest_size=16).digest(), "big")


def feistel(value: int, n: int, key: bytes, tweak: str, undo: bool = False) -> int:
    """Keyed permutation of [0, n)."""
    if n < 2:
        return value
    a = math.isqrt(n - 1) + 1
    b = -(-n // a)
    while True:
        left, right = divmod(value, b)
        for r in reversed(range(ROUNDS)) if undo else range(ROUNDS):
            sign = -1 if undo else 1
            if r % 2:
                right = (right + sign * _round(key, tweak, r, left)) % b
            else:
                left = (left + sign * _round(key, tweak, r, right)) % a
        value = left * b + right
        if value < n:
            return value


def luhn_digit(body: str) -> str:
    total = sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(body))))
    return str(-total % 10)


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


def _refill(shape: str, chars: str) -> str:
    """`chars` in the places of the letters and digits of `shape`."""
    it = iter(chars)
    return "".join(next(it) if c.isalnum() else c for c in shape)


@lru_cache(10_000)
def _alphabet(c: str) -> str | None:
    """Letters and digits of the same block of 256 and the same category, for those outside ALPHABETS."""
    if not c.isalnum():
        return None
    block, kind = ord(c) & ~255, unicodedata.category(c)
    return "".join(x for x in map(chr, range(block, block + 256)) if x.isalnum() and unicodedata.category(x) == kind and not any(x in a for a in ALPHABETS))


def _permute_chars(text: str, key: bytes, tweak: str, undo: bool) -> str:
    """Every letter or digit stays in its alphabet; all of them are one mixed-radix number. Others stay."""
    value, n, places = 0, 1, []
    for i, c in enumerate(text):
        if alphabet := next((x for x in ALPHABETS if c in x), None) or _alphabet(c):
            value, n = value * len(alphabet) + alphabet.index(c), n * len(alphabet)
            places.append((i, alphabet))
    value, out = feistel(value, n, key, f"{tweak}|{n}", undo), list(text)
    for i, alphabet in reversed(places):
        value, at = divmod(value, len(alphabet))
        out[i] = alphabet[at]
    return "".join(out)


def _digits(text: str) -> str:
    return re.sub(r"[^0-9]", "", text)


def _email(text: str, key: bytes, undo: bool) -> str:
    local, _, domain = text.rpartition("@")
    return f"{_permute_chars(local, key, 'email', undo)}@{domain}"


def _ip(text: str, key: bytes, undo: bool) -> str | None:
    parts = text.split(".")
    if any(int(p) > 255 or p != str(int(p)) for p in parts):
        return None
    value = feistel(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, key, "ip", undo)
    return ".".join(map(str, value.to_bytes(4, "big")))


def _move(day: date, fits: Callable[[date], bool], key: bytes, undo: bool) -> date | None:
    """The date's pseudonym among the dates that fit, as it does."""
    if not FIRST_DAY <= day.toordinal() <= LAST_DAY:
        return None
    while True:
        day = date.fromordinal(FIRST_DAY + feistel(day.toordinal() - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, key, "date", undo))
        if fits(day):
            return day


def _date(text: str, order: str, key: bytes, undo: bool) -> str | None:
    """Day first; month first where that is no date: its pseudonym is no date day first either. Short days and months stay as short."""
    parts = re.split(r"[-/.]", text)
    short = min(map(len, parts)) == 1
    for form in ("ymd",) if order == "ymd" else ("dmy", "mdy"):
        try:
            old = date(*(int(parts[form.index(x)]) for x in "ymd"))
        except ValueError:
            continue
        fits = lambda d: (form != "mdy" or d.day > 12) and not (short and ((d.day > 9) != (old.day > 9) or (d.month > 9) != (old.month > 9)))
        if (new := _move(old, fits, key, undo)) is None:
            return None
        values = {"y": new.year, "m": new.month, "d": new.day}
        return _refill(text, "".join(f"{values[x]:0{len(p)}d}" for x, p in zip(form, parts)))
    return None


def _ordinal(day: int) -> str:
    return "th" if 10 < day < 20 else {1: "st", 2: "nd", 3: "rd"}.get(day % 10, "th")


def _written(text: str, key: bytes, undo: bool) -> str | None:
    """A date with the month's name: a full name stays full, a short one short; May and Sept are both or neither, so they stay."""
    name, day, year = re.search(r"[A-Za-z]{3,}", text)[0], re.search(r"[0-9]{1,2}(?![0-9])", text), text[-4:]
    month = next(i for i, m in enumerate(MONTHS, 1) if m[:3].lower() == name[:3].lower())
    suffix = re.match(r"(?:st|nd|rd|th)?", text[day.end() :])[0]
    try:
        old = date(int(year), month, int(day[0]))
    except ValueError:
        return None
    if suffix and suffix != _ordinal(old.day):
        return None
    held = month == 5 or len(name) == 4 and month == 9
    fits = lambda d: (d.month == month if held else d.month != 5) and (d.day > 9) == (old.day > 9) and (not suffix or _ordinal(d.day) == suffix)
    if (new := _move(old, fits, key, undo)) is None:
        return None
    full = MONTHS[new.month - 1]
    named = name if held else full if len(name) > 3 else full[:3]
    named = named.upper() if name.isupper() else named.lower() if name.islower() else named
    swaps = {name: named, day[0]: f"{new.day:0{len(day[0])}d}"}
    head = re.sub(rf"{name}|(?<![0-9]){day[0]}(?![0-9])", lambda m: swaps[m[0]], text[:-4])
    return f"{head}{new.year}"


def _iban(text: str, key: bytes, undo: bool) -> str | None:
    flat = text.replace(" ", "")
    if not 15 <= len(flat) <= 34 or _mod97(flat[4:] + flat[:4]) != 1:
        return None
    body = _permute_chars(flat[4:], key, f"iban{flat[:2]}", undo)
    return _refill(text, flat[:2] + f"{98 - _mod97(body + flat[:2] + '00'):02d}" + body)


def _ssn(text: str, key: bytes, undo: bool) -> str | None:
    area, group, serial = map(int, text.split("-"))
    if not (1 <= area <= 899 and area != 666 and group and serial):
        return None
    value = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    value = feistel(value, 898 * 99 * 9999, key, "ssn", undo)
    value, serial = divmod(value, 9999)
    area, group = divmod(value, 99)
    return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"


def _phone(text: str, key: bytes, undo: bool) -> str | None:
    """A phone with its country's code, which stays: all spellings of a number have it, with or without separators."""
    flat = _digits(text)
    if not 7 <= len(flat) <= 15:
        return None
    code = flat[: 1 if flat[:1] in ONE_DIGIT else 2 if flat[:2] in TWO_DIGITS else 3]
    return _refill(text, code + _permute_chars(flat[len(code) :], key, f"phone+{code}", undo))


def _national(text: str, key: bytes, undo: bool) -> str | None:
    """A phone without a country's code: ten digits in the American groups, or 9 to 11 after a trunk 0, which stays with the digit after it."""
    flat = _digits(text)
    if re.fullmatch(r"\(?[0-9]{3}[^0-9]{1,2}[0-9]{3}[^0-9][0-9]{4}", text):
        return _refill(text, _permute_chars(flat, key, "phone", undo))
    if not 9 <= len(flat) <= 11:
        return None
    return _refill(text, flat[:2] + _permute_chars(flat[2:], key, f"phone{flat[:2]}", undo))


def _number(text: str, key: bytes, undo: bool) -> str | None:
    flat = _digits(text)
    if luhn_digit(flat[:-1]) == flat[-1]:  # a card: stays one
        body = _permute_chars(flat[:-1], key, "card", undo)
        return _refill(text, body + luhn_digit(body))
    while True:  # an account number: never turns into a card, so that it can be told apart when undone
        flat = _permute_chars(flat, key, "number", undo)
        if luhn_digit(flat[:-1]) != flat[-1]:
            return _refill(text, flat)


def pseudonym(kind: str, text: str, key: bytes, undo: bool = False) -> str | None:
    """The value's pseudonym in its own format, or None if the value is not valid for its kind."""
    if kind in ("ymd", "dmy"):
        return _date(text, kind, key, undo)
    return {"email": _email, "ip": _ip, "iban": _iban, "ssn": _ssn, "phone": _phone, "number": _number, "written": _written, "national": _national}[kind](text, key, undo)


def replacer(key: str, undo: bool = False) -> Callable[[str], tuple[str, dict[str, int]]]:
    """A function of a text that gives it with pseudonyms, and how many of each kind."""
    secret = hashlib.blake2b(key.encode(), digest_size=32).digest()
    cached = lru_cache(100_000)(lambda kind, text: pseudonym(kind, text, secret, undo))

    def run(text: str) -> tuple[str, dict[str, int]]:
        counts: dict[str, int] = {}

        def swap(m: re.Match) -> str:
            kind, whole, end = "number" if m.lastgroup == "card" else m.lastgroup, m[0], len(m[0])
            new = cached(kind, whole)
            while new is None and kind in ("iban", "national") and (end := whole.rfind(" ", 0, end)) > 0:  # capitals after the number may look like more of it
                new = cached(kind, whole[:end])
            if new is None:
                return whole
            counted = COUNTED.get(kind, kind)
            counts[counted] = counts.get(counted, 0) + 1
            return new + whole[end:]

        if not _SIGN.search(text):
            return text, counts
        return "\n".join(PATTERN.sub(swap, line) if _SIGN.search(line) else line for line in text.split("\n")), counts

    return run


def session_key(spark: SparkSession) -> str:
    """The secret of the session's setting; without one, a random key that is made once and kept in the shared folder, beside the intermediate tables.

    Whoever may read that folder can undo the pseudonyms, so a setting is better. In local mode the key of the tests serves, which hides nothing.
    """
    if given := spark.conf.get(SETTING, None):
        return given
    if spark.sparkContext.master.startswith("local"):
        return KEY
    path = f"{shared_dir(spark)}/pii-key"
    spark.range(1).select(F.lit(token_hex(32)).alias("key")).coalesce(1).write.mode("ignore").parquet(path)
    return spark.read.schema("key string").parquet(path).agg(F.min("key")).first()[0]


def pseudonymize(docs: DataFrame, text: str = "text", key: str = KEY, undo: bool = False, counts: str | None = None) -> DataFrame:
    """`docs` with pseudonyms in `text`; with `counts`, also a struct column of that name with the number of each kind."""
    schema = "text string, " + ", ".join(f"n_{k} int" for k in KINDS)

    @F.pandas_udf(schema)
    def swapped(texts: pd.Series) -> pd.DataFrame:
        run = replacer(key, undo)
        done = [(None, {}) if t is None else run(t) for t in texts]
        out = {"text": pd.Series([t for t, _ in done], dtype=object)}
        return pd.DataFrame(out | {f"n_{k}": pd.Series([c.get(k, 0) for _, c in done], dtype="int32") for k in KINDS})

    new = unused(docs, "_swapped")
    found = docs.withColumn(new, swapped(F.col(f"`{text}`")))
    if counts:
        found = found.withColumn(counts, F.struct(*(F.col(f"{new}.n_{k}").alias(k) for k in KINDS)))
    return found.withColumn(text, F.col(f"{new}.text")).drop(new)
