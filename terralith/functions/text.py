"""Value filters and label functions, as columns over strings."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lengths, weights and speeds in terms of a base unit of their kind. Fixed values.
UNITS = {
    "m": ("length", 1.0), "km": ("length", 1000.0), "ft": ("length", 0.3048), "feet": ("length", 0.3048), "mi": ("length", 1609.344),
    "kg": ("weight", 1.0), "t": ("weight", 1000.0), "lb": ("weight", 0.45359237),
    "kmh": ("speed", 1.0), "km/h": ("speed", 1.0), "mph": ("speed", 1.609344),
}
#: A number with its unit. Fixed value.
NUMBER = r"^[^0-9.\-]*(-?[0-9.]+)[ \t]*(.*)$"


def number(value: Column) -> Column:
    """The first number in a string as a decimal; null if there is none or it is malformed."""
    found = F.regexp_extract(value, r"[ \t]*(-?[0-9.]+)[ \t]*(.*)", 1)
    return F.when(found != "", found.try_cast("decimal(38,12)"))


def default(value: Column, text: str) -> Column:
    return F.when(value.isNull() | (value == ""), F.lit(text)).otherwise(value)


def rounded(x: Column) -> Column:
    """Half up, also below zero."""
    return F.floor(x + 0.5).cast("long")


def converted(value: Column, source: str, target: str) -> Column:
    """The number in another unit; a unit in the value overrides the source. A value that has
    no number or no known unit of that kind stays as it is."""
    unit = F.trim(F.regexp_extract(value, NUMBER, 2))
    kind, size = UNITS[target]
    factors = [(u, f / size) for u, (k, f) in UNITS.items() if k == kind]
    factor = F.lit(None).cast("double")
    for u, f in factors:
        factor = F.when(unit == u, F.lit(f)).otherwise(factor)
    own = UNITS[source][1] / size if UNITS.get(source, ("",))[0] == kind else None
    factor = F.when(unit == "", F.lit(own).cast("double")).otherwise(factor)
    x = number(value).cast("double")
    return F.when(x.isNull() | factor.isNull(), value).otherwise(rounded(x * factor).cast("string"))


def substring(value: Column, start: int, end: int | None = None) -> Column:
    size = F.length(value)
    stop = F.least(F.lit(end), size) if end is not None else size
    return F.when(size >= start, F.substring(value, F.lit(start + 1), F.greatest(stop - start, F.lit(0)).cast("int")))


def _parts(value: Column, separator: str) -> Column:
    """Items between separators, without empty ones at the end."""
    bare = F.regexp_replace(value, f"(?:{_quoted(separator)})+$", "")
    return F.split(bare, _quoted(separator), -1)


def _quoted(s: str) -> str:
    return "".join("\\" + c if not c.isalnum() else c for c in s)


def part(value: Column, n: int, separator: str = ";") -> Column:
    """The n-th item, from the end if n is negative; null if there are too few."""
    items = _parts(value, separator)
    return F.when((F.size(items) >= abs(n)) & F.lit(n != 0), F.trim(F.element_at(items, n or 1)))


def _around(value: Column, n: int, separator: str, after: bool) -> Column:
    items = _parts(value, separator)
    place = F.lit(n) if n > 0 else F.size(items) + (n + 1)
    taken = F.slice(items, place + 1, F.size(items)) if after else F.slice(items, 1, place - 1)
    joined = F.array_join(F.transform(taken, lambda s: F.concat(s, F.lit(separator))), "")
    return F.when(F.size(items) >= abs(n), joined)


def parts_before(value: Column, n: int, separator: str = ";") -> Column:
    """The items before the n-th, each with its separator; null if there is no n-th."""
    return _around(value, n, separator, after=False)


def parts_after(value: Column, n: int, separator: str = ";") -> Column:
    """The items after the n-th, each with its separator; null if there is no n-th."""
    return _around(value, n, separator, after=True)


#: Signs of shields and separators by name. Fixed values.
SYMBOLS = {"ele": "\x1f", "interstate": "\x01", "shield": "\x02", "round": "\x03", "boxx": "\x04", "box": "\x05", "oval": "\x06"}


def prefix_of(name: str) -> str:
    """A named sign, a character by its hexadecimal number, or the text itself."""
    if name in SYMBOLS:
        return SYMBOLS[name]
    try:
        return chr(int(name, 16))
    except (ValueError, OverflowError):
        return name


def substituted(value: Column, old: str, new: str = "", pattern: bool = False) -> Column:
    return F.regexp_replace(value, old, new) if pattern else F.replace(value, F.lit(old), F.lit(new))


def not_equal(value: Column, other: Column) -> Column:
    return F.when(~F.coalesce(value == other, F.lit(False)), value)


def not_contained(value: Column, other: Column, separator: str = ";") -> Column:
    inside = F.array_contains(F.split(other, _quoted(separator), -1), value)
    return F.when(~F.coalesce(inside, F.lit(False)), value)


def highway_symbol(value: Column, symbol: str, longest: int = 8, longest_word: int | None = None) -> Column:
    """A road number behind its shield if it is short enough, else as it was.

    longest_word holds for numbers without any digit.
    """
    short = F.replace(F.replace(value, F.lit(" "), F.lit("")), F.lit(";"), F.lit("/"))
    most = F.when(short.rlike("[0-9]"), longest).otherwise(longest if longest_word is None else longest_word)
    sign = SYMBOLS.get(symbol, f"[{symbol}]")
    return F.when(F.length(short) <= most, F.concat(F.lit(sign), short)).otherwise(value)


def squashed(value: Column) -> Column:
    """Trimmed, runs of blanks as one, without control characters of labels."""
    clean = F.regexp_replace(F.regexp_replace(value, "[\\x01-\\x06\\x7f]", ""), "[\\x1b-\\x1f]", " ")
    return F.trim(F.regexp_replace(clean, r"[ \t]{2,}", " "))


def house_number(value: Column) -> Column:
    """The number of a house, 0 to 1,000,000; null where there is none."""
    found = F.regexp_extract(value, r"^\D*(\d{1,7})\D?.*$", 1)
    n = F.when(found != "", found.cast("long"))
    return F.when(n <= 1_000_000, n)


def transliterated(value: Column, table: dict[str, str], unknown: str = "?") -> Column:
    """Characters by a table; others beyond ASCII become the unknown sign."""
    known = reduce(lambda v, kv: F.replace(v, F.lit(kv[0]), F.lit(kv[1])), table.items(), value)
    return F.regexp_replace(known, r"[^\x00-\x7f]", unknown)


def _plain(c: str) -> str:
    """A character without its accents; '' if nothing is left."""
    return "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))


#: Letters that are no other letter with an accent. Fixed values.
LETTERS = {
    "ß": "ss", "æ": "ae", "Æ": "AE", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "þ": "th", "Þ": "Th", "ł": "l", "Ł": "L", "œ": "oe", "Œ": "OE",
    "ħ": "h", "Ħ": "H", "ı": "i", "ŋ": "ng", "Ŋ": "NG", "–": "-", "—": "-", "‘": "'", "’": "'", "“": '"', "”": '"', "…": "...",
}


def _table(upto: int) -> dict[str, str]:
    """What the letters from U+0080 on become, by their decomposition: the parts up to the last code point allowed."""
    out = {}
    for n in [*range(0x80, 0x250), *range(0x1E00, 0x1F00), *map(ord, LETTERS)]:
        c = chr(n)
        plain = LETTERS.get(c) or _plain(c)
        composed = next((x for x in (unicodedata.normalize("NFC", plain), plain) if x and all(ord(y) <= upto for y in x)), None)
        if n > upto and composed:
            out[c] = composed
    return out


def _mapped(value: Column, upto: int) -> Column:
    table = _table(upto)
    single = {k: v for k, v in table.items() if len(v) == 1}
    known = F.translate(F.replace(value, F.lit("\x00"), F.lit("")), "".join(single), "".join(single.values()))
    known = reduce(lambda v, kv: F.replace(v, F.lit(kv[0]), F.lit(kv[1])), [(k, v) for k, v in table.items() if len(v) > 1], known)
    return F.regexp_replace(known, rf"[^\x00-\x{upto:02x}]", "?")


def to_ascii(value: Column) -> Column:
    """Letters without accents, special letters spelt out, any other sign as '?'."""
    return _mapped(value, 0x7F)


def to_latin1(value: Column) -> Column:
    """Signs up to U+00FF as they are, other letters without accents, any other sign as '?'."""
    return _mapped(value, 0xFF)


#: Names of countries and their codes of three letters. Fixed values.
COUNTRIES = {
    "algeria": "DZA", "argentina": "ARG", "australia": "AUS", "austria": "AUT", "belgium": "BEL", "brazil": "BRA", "canada": "CAN", "china": "CHN", "denmark": "DNK",
    "deutschland": "DEU", "egypt": "EGY", "españa": "ESP", "ethiopia": "ETH", "finland": "FIN", "france": "FRA", "germany": "DEU", "greece": "GRC", "india": "IND",
    "indonesia": "IDN", "iran": "IRN", "iraq": "IRQ", "ireland": "IRL", "italia": "ITA", "italy": "ITA", "japan": "JPN", "jordan": "JOR", "kenya": "KEN", "mexico": "MEX",
    "morocco": "MAR", "mozambique": "MOZ", "nederland": "NLD", "netherlands": "NLD", "norway": "NOR", "österreich": "AUT", "peru": "PER", "poland": "POL", "portugal": "PRT",
    "romania": "ROU", "russia": "RUS", "saudi arabia": "SAU", "schweiz": "CHE", "south africa": "ZAF", "spain": "ESP", "sweden": "SWE", "switzerland": "CHE", "turkey": "TUR",
    "ukraine": "UKR", "united kingdom": "GBR", "united states": "USA", "united states of america": "USA", "vietnam": "VNM",
}


def country_iso(value: Column, names: dict[str, str] | None = None) -> Column:
    """The code of a country by its name, whatever the case; other values stay as they are."""
    names = names or COUNTRIES
    codes = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    key = F.lower(F.trim(value))
    return F.when(F.upper(F.trim(value)).isin(sorted(set(names.values()))), F.upper(F.trim(value))).otherwise(F.coalesce(F.try_element_at(codes, key), value))


def name_parts(value: Column, prefixes: list[str], suffixes: list[str]) -> Column:
    """A street name with marks behind a known beginning and before a known ending, the longest first.

    The blank between them gives way to 0x1e or 0x1f; without a blank 0x1b or 0x1c is put in.
    A name that begins with a shield gets no mark in front.
    """
    longest = lambda words: sorted(set(words), key=lambda w: (-len(w), w))
    out = value
    front = F.lit(False)
    head = value
    for p in longest(prefixes):
        new = F.concat(F.lit(p[:-1] + "\x1e" if p.endswith(" ") else p + "\x1b"), F.substring(value, len(p) + 1, 1 << 30))
        is_ = ~front & (F.lower(F.substring(value, 1, len(p))) == p.lower()) & ~value.rlike("^[\\x00-\\x06]")
        head, front = F.when(is_, new).otherwise(head), front | is_
    out = head
    for s in reversed(longest(suffixes)):
        cut = F.substring(head, F.lit(1), F.length(head) - len(s))
        new = F.concat(cut, F.lit("\x1f" + s[1:] if s.startswith(" ") else "\x1c" + s))
        out = F.when((F.length(head) >= len(s)) & (F.lower(F.right(head, F.lit(len(s)))) == s.lower()), new).otherwise(out)
    return out


def encoded(value: Column, charset: str) -> Column:
    """The bytes of a label in a character set, its letters mapped to the set before."""
    of = {"US-ASCII": to_ascii, "ISO-8859-1": to_latin1}.get(charset, lambda v: v)
    return F.encode(of(value), charset)


#: The signs of base64 in order. Fixed value.
BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def encoded6(value: Column) -> Column:
    """A label in six bits a sign, as hex: letters, digits and blank; others go. It ends with 0x3f.

    Blank is 0, letters follow from 1 and digits from 0x20; bits are packed from the left.
    """
    signs = " ABCDEFGHIJKLMNOPQRSTUVWXYZ" + "\0" * 5 + "0123456789"
    used = [i for i, c in enumerate(signs) if c != "\0"]
    clean = F.regexp_replace(F.upper(to_ascii(value)), "[^ A-Z0-9]", "")
    # The same packing as base64, by other signs; its "A" is six bits of nothing.
    coded = F.concat(F.translate(clean, "".join(signs[i] for i in used), "".join(BASE64[i] for i in used)), F.lit("/"))
    packed = F.unbase64(F.rpad(coded, (F.ceil(F.length(coded) / 4) * 4).cast("int"), "A"))
    return F.substring(F.hex(packed), F.lit(1), (F.ceil(F.length(coded) * 6 / 8) * 2).cast("int"))


def speed_kmh(value: Column) -> Column:
    """A maximum speed in km/h; miles by 1.61, as the rules' functions count them."""
    n = F.regexp_extract(value, r"^\s*(\d+)\s*(mph|kmh|km/h)?\s*$", 1)
    miles = F.regexp_extract(value, r"^\s*(\d+)\s*(mph|kmh|km/h)?\s*$", 2) == "mph"
    x = F.when(n != "", n.cast("double"))
    return F.when(miles, x * 1.61).otherwise(x)
