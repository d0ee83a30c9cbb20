"""Format-preserving pseudonyms for personal data by keyed Feistel permutations.

Each value is validated, numbered among all values of its format, permuted there, and written back in its own format:
card numbers keep length and a right check digit, IBANs their country and check digits, addresses of the internet the
width of each part, telephone numbers and dates their punctuation, e-mail addresses their domain. A permutation depends
on the key, the kind and the format only, so equal values get equal pseudonyms in all documents, and different ones
different. The domain is any size: a balanced Feistel network over the next even number of bits, walked until it hits.
A value of more than ``LONG`` free characters goes through a Feistel network over its two halves instead, whose digits
and letters are moved one by one, so the work is in proportion to its length.
"""

from __future__ import annotations

import calendar
import datetime
import functools
import hashlib
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame

from sieveline.llm.columns import map_last, quoted

ROUNDS, LONG = 8, 128
#: A stand-in for tests; production passes its own secret.
KEY = b"sieveline"


def permute(x: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed bijection of range(size)."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        left, right = x >> half, x & mask
        for r in range(ROUNDS):
            data = f"{tweak}:{size}:{r}:{right}".encode()
            f = int.from_bytes(hashlib.blake2b(data, key=key[:64], digest_size=(half + 7) // 8 + 1).digest()) & mask
            left, right = right, left ^ f
        x = left << half | right
        if x < size:
            return x


def _stream(seed: bytes, key: bytes, n: int) -> bytes:
    """n keyed bytes."""
    start = hashlib.blake2b(seed, key=key[:64]).digest()
    return b"".join(hashlib.blake2b(i.to_bytes(8, "big"), key=start).digest() for i in range(-(-n // 64)))[:n]


def permute_cells(values: list[int], sizes: list[int], key: bytes, tweak: str) -> list[int]:
    """A keyed bijection of the lists with each value in range(its size, at most 26)."""
    half = len(values) // 2
    out = [values[:half], values[half:]]
    spans = [sizes[:half], sizes[half:]]
    for r in range(ROUNDS):
        a, b = r % 2, 1 - r % 2
        moves = _stream(f"{tweak}:{r}:".encode() + bytes(out[b]), key, 4 * len(out[a]))
        out[a] = [(v + int.from_bytes(moves[4 * i : 4 * i + 4])) % n for i, (v, n) in enumerate(zip(out[a], spans[a]))]
    return out[0] + out[1]


def luhn_digit(payload: str) -> str:
    total = sum(d if i % 2 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(payload))))
    return str(-total % 10)


def _refill(shape: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if "0" <= c <= "9" else c for c in shape)


def _digits(s: str) -> str:
    return re.sub("[^0-9]", "", s)


def _card(m: re.Match, key: bytes) -> str | None:
    d = _digits(m[0])
    if not 13 <= len(d) <= 19 or luhn_digit(d[:-1]) != d[-1] or len(set(d)) == 1:
        return None
    new = d[0] + str(permute(int(d[1:-1]), 10 ** (len(d) - 2), key, "card" + d[0])).zfill(len(d) - 2)
    return _refill(m[0], new + luhn_digit(new))


def _phone(m: re.Match, key: bytes) -> str | None:
    country, rest = _digits(m["country"]), _digits(m["rest"])
    if not 8 <= len(country + rest) <= 15 or len(rest) < 7:
        return None
    first = int(rest[0] or 0)
    low = 2 if first >= 2 else 0
    span = (10 if first >= 2 else 2) - low
    tail = 10 ** (len(rest) - 1)
    x = permute((first - low) * tail + int(rest[1:]), span * tail, key, f"phone{country}:{low}")
    return m["country"] + _refill(m["rest"], str(x // tail + low) + str(x % tail).zfill(len(rest) - 1))


def _ip(m: re.Match, key: bytes) -> str | None:
    parts = m[0].split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    ranges = [((0, 10), (10, 90), (100, 156))[len(p) - 1] for p in parts]
    x, size = 0, 1
    for p, (low, n) in zip(parts, ranges):
        x, size = x * n + int(p) - low, size * n
    x = permute(x, size, key, "ip" + "".join(str(len(p)) for p in parts))
    out = []
    for low, n in reversed(ranges):
        x, r = divmod(x, n)
        out.append(str(low + r))
    return ".".join(reversed(out))


def _ssn(m: re.Match, key: bytes) -> str | None:
    area, group, serial = int(m[1]), int(m[2]), int(m[3])
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    areas = [a for a in range(1, 900) if a != 666]
    x = permute((areas.index(area) * 99 + group - 1) * 9999 + serial - 1, len(areas) * 99 * 9999, key, "ssn")
    x, s = divmod(x, 9999)
    a, g = divmod(x, 99)
    return f"{areas[a]:03}-{g + 1:02}-{s + 1:04}"


def _mixed(text: str, key: bytes, tweak: str) -> str:
    """Digits among digits, small and large letters among their own; the rest stays."""
    kinds = [(10, "0") if "0" <= c <= "9" else (26, "a") if "a" <= c <= "z" else (26, "A") if "A" <= c <= "Z" else (1, c) for c in text]
    values, sizes = [ord(c) - ord(zero) for c, (_, zero) in zip(text, kinds)], [n for n, _ in kinds]
    tweak += "".join(zero for _, zero in kinds)
    free = [i for i, n in enumerate(sizes) if n > 1]
    if len(free) > LONG:
        moved = permute_cells([values[i] for i in free], [sizes[i] for i in free], key, tweak)
        for i, v in zip(free, moved):
            values[i] = v
    else:
        x, size = 0, 1
        for v, n in zip(values, sizes):
            x, size = x * n + v, size * n
        x = permute(x, size, key, tweak)
        for i in reversed(range(len(values))):
            x, values[i] = divmod(x, sizes[i])
    return "".join(chr(ord(zero) + v) for v, (_, zero) in zip(values, kinds))


def _iban_check(country: str, body: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in body + country + '00')) % 97:02}"


def _iban(m: re.Match, key: bytes) -> str | None:
    flat = m[0].replace(" ", "")
    if not 15 <= len(flat) <= 34 or _iban_check(flat[:2], flat[4:]) != flat[2:4]:
        return None
    body = _mixed(flat[4:], key, "iban" + flat[:2])
    it = iter(flat[:2] + _iban_check(flat[:2], body) + body)
    return "".join(c if c == " " else next(it) for c in m[0])


def _email(m: re.Match, key: bytes) -> str | None:
    return _mixed(m["local"], key, "mail" + m["domain"].lower()) + "@" + m["domain"]


FIRST, DAYS = datetime.date(1900, 1, 1), (datetime.date(2100, 1, 1) - datetime.date(1900, 1, 1)).days


def _date(m: re.Match, key: bytes) -> str | None:
    """Year first, or last after a day (with points) or a month (with strokes, unless only a day fits there)."""
    a, b, c = (int(m[k]) for k in ("a", "b", "c"))
    sep, year_first = m["sep"], len(m["a"]) == 4
    year, month, day = (a, b, c) if year_first else (c, b, a) if sep != "/" or a > 12 else (c, a, b)
    if not (1900 <= year < 2100 and 1 <= month <= 12 and 1 <= day <= calendar.monthrange(year, month)[1]):
        return None
    day_first = not year_first and (sep != "/" or a > 12)
    x, order = (datetime.date(year, month, day) - FIRST).days, "dmy" if day_first else "ymd" if year_first else "mdy"
    tweak = f"date{sep}{order}{len(m['a'])}{len(m['b'])}{len(m['c'])}"
    while True:
        x = permute(x, DAYS, key, tweak)
        d = FIRST + datetime.timedelta(x)
        parts = (d.year, d.month, d.day) if year_first else (d.day, d.month, d.year) if day_first else (d.month, d.day, d.year)
        widths = [len(m[k]) for k in ("a", "b", "c")]
        fits = all(w == 4 or (len(str(n)) == w or w == 2) for n, w in zip(parts, widths))
        if fits and not (sep == "/" and day_first and d.day <= 12):
            return sep.join(str(n).zfill(w) for n, w in zip(parts, widths))


#: Kind, pattern and rewriter; where patterns overlap, the earlier kind wins. A rewriter gives None for what isn't valid.
NUMBERS: list[tuple[str, str, Callable[[re.Match, bytes], str | None]]] = [
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", _iban),
    ("ip", r"(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![\w]|\.[0-9])", _ip),
    ("card", r"(?<![\w.+-])(?:[0-9]{13,19}|[0-9]{4}(?P<s>[ -])[0-9]{4}(?P=s)[0-9]{4}(?P=s)[0-9]{1,7}|[0-9]{4}(?P<a>[ -])[0-9]{6}(?P=a)[0-9]{4,5})(?![\w-])", _card),
    ("ssn", r"(?<![\w-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![\w-])", _ssn),
    ("date", r"(?<![\w./-])(?P<a>[0-9]{4}|[0-9]{1,2})(?P<sep>[-/.])(?P<b>[0-9]{1,2})(?P=sep)(?P<c>[0-9]{4}|[0-9]{1,2})(?![\w/-]|\.[0-9])", _date),
    ("phone", r"(?<![\w+])(?P<country>\+1[ .-]?|(?=\())(?P<rest>\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-][0-9]{4})(?!\w)", _phone),
    ("phone", r"(?<![\w+])(?P<country>\+[0-9]{1,3}[ .-]?)(?P<rest>(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){1,4})(?!\w)", _phone),
]
EMAIL = ("email", r"(?<![\w.+-])(?P<local>[A-Za-z0-9][\w.+-]*)@(?P<domain>[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})(?![\w-])", _email)


@functools.lru_cache
def _compiled() -> tuple:
    return tuple((kind, re.compile(p), f) for kind, p, f in NUMBERS), (EMAIL[0], re.compile(EMAIL[1]), EMAIL[2]), re.compile("[0-9]")


def pseudonymise(text: str, key: bytes = KEY) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and (kind, start, end) of what was replaced, in the given text's code points."""
    numbers, mail, digit = _compiled()
    found: list[tuple[int, int, str, str]] = []
    wanted = [mail] if "@" in text else []
    if digit.search(text):
        wanted += numbers
    left = text
    for kind, pattern, rewrite in wanted:
        hits = [(m.start(), m.end(), kind, new) for m in pattern.finditer(left) if (new := rewrite(m, key)) is not None]
        if hits:
            # what is settled can't be part of another kind's match
            parts, at = [], 0
            for start, end, *_ in hits:
                parts += [left[at:start], "\0" * (end - start)]
                at = end
            left = "".join([*parts, left[at:]])
            found += hits
    if not found:
        return text, []
    out, at = [], 0
    for start, end, _, new in sorted(found):
        out += [text[at:start], new]
        at = end
    return "".join([*out, text[at:]]), [(kind, start, end) for start, end, kind, _ in sorted(found)]


def _replacer(key: bytes):
    def run(batches):
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            done = [(None, []) if t is None else pseudonymise(t, key) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(k) for k in range(batch.num_columns - 1)],
                    pa.array([t for t, _ in done], pa.string()),
                    pa.array([",".join(f"{k}:{a}:{b}" for k, a, b in s) for _, s in done], pa.string()),
                ],
                [*batch.schema.names[:-1], "_new", "_found"],
            )

    return run


def pseudonymise_documents(documents: DataFrame, key: bytes = KEY, text_col: str = "text", spans_col: str = "pii_spans") -> DataFrame:
    """``documents`` with personal data in text_col replaced, and spans_col: kind:start:end of each, joined by commas.

    Null texts stay null and empty ones empty, without spans; rows and other columns stay as they are, and repeated rows
    stay equal; a column named spans_col is replaced; an empty table gives an empty result.
    """
    done = map_last(documents, text_col, _replacer(key), {"_new": (text_col, "string"), "_found": (spans_col, "string")})
    return done.select(*[quoted(c) for c in documents.columns if c != spans_col], quoted(spans_col))
