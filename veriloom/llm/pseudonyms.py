"""PII: format-preserving Feistel pseudonyms for validated numbers, dates, addresses and keys."""

from __future__ import annotations

import datetime as dt
import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
LOWER, UPPER, DIGITS, HEX = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"
BASE32 = UPPER + "234567"
FIRST_DAY, LAST_DAY = dt.date(1900, 1, 1).toordinal(), dt.date(2099, 12, 31).toordinal()


class Feistel:
    """Keyed permutations of [0, n): a balanced binary Feistel network, walked until it is back in the domain."""

    def __init__(self, key: bytes):
        self.key = key

    def _round(self, tweak: bytes, r: int, half: int, bits: int) -> int:
        size = (bits + 7) // 8
        digest = hashlib.blake2b(half.to_bytes(size, "big"), key=self.key, salt=bytes([r]), person=tweak[:16], digest_size=min(64, size)).digest()
        return int.from_bytes(digest, "big") & ((1 << bits) - 1)

    def permute(self, value: int, n: int, tweak: str) -> int:
        if n <= 1:
            return value
        bits = max(1, ((n - 1).bit_length() + 1) // 2)
        mask, mark = (1 << bits) - 1, hashlib.blake2b(f"{tweak}:{n}".encode(), digest_size=16).digest()
        while True:
            left, right = value >> bits, value & mask
            for r in range(ROUNDS):
                left, right = right, left ^ self._round(mark, r, right, bits)
            value = left << bits | right
            if value < n:
                return value

    def within(self, value: int, n: int, tweak: str, ok: Callable[[int], bool]) -> int:
        """As permute, walked until `ok`: a permutation of the values of [0, n) that are ok, if `value` is."""
        value = self.permute(value, n, tweak)
        while not ok(value):
            value = self.permute(value, n, tweak)
        return value

    def symbols(self, text: str, tweak: str, alphabets: tuple[str, ...] = (DIGITS, LOWER, UPPER)) -> str:
        """Each character becomes one of its own alphabet; others stay.  The pattern of alphabets tweaks the permutation."""
        classes = [next((a for a in alphabets if c in a), c) for c in text]
        value = n = 0
        for c, a in zip(text, classes):
            if len(a) > 1:
                value, n = value * len(a) + a.index(c), max(n, 1) * len(a)
        pattern = "".join(a[0] for a in classes)
        value, out = self.permute(value, n, f"{tweak}:{pattern}"), []
        for c, a in zip(reversed(text), reversed(classes)):
            if len(a) > 1:
                value, i = divmod(value, len(a))
                c = a[i]
            out.append(c)
        return "".join(reversed(out))


def luhn_digit(body: str) -> str:
    total = sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(int(c) for c in reversed(body)))
    return str(-total % 10)


def refill(shape: str, symbols: str, kept: str = DIGITS) -> str:
    """`shape` with its characters of `kept` replaced in order."""
    left = iter(symbols)
    return "".join(next(left) if c in kept else c for c in shape)


def _digits(s: str) -> str:
    return "".join(c for c in s if c in DIGITS)


def card(s: str, f: Feistel) -> str | None:
    """13 to 19 digits with a valid check digit: the first stays, the check digit is made anew."""
    d = _digits(s)
    if not 13 <= len(d) <= 19 or d[0] == "0" or luhn_digit(d[:-1]) != d[-1]:
        return None
    n = 10 ** (len(d) - 2)
    body = d[0] + str(f.permute(int(d[1:-1]), n, "card")).zfill(len(d) - 2)
    return refill(s, body + luhn_digit(body))


def iban(s: str, f: Feistel) -> str | None:
    """Check digits are valid modulo 97: digits and letters of the account move within their alphabets."""
    flat = s.replace(" ", "")
    if not 15 <= len(flat) <= 34 or int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 != 1:
        return None
    account = f.symbols(flat[4:], "iban" + flat[:2], (DIGITS, UPPER))
    check = 98 - int("".join(str(int(c, 36)) for c in account + flat[:2] + "00")) % 97
    return refill(s, flat[:2] + f"{check:02d}" + account, DIGITS + UPPER)


def phone(s: str, f: Feistel) -> str | None:
    """North American numbers (area and exchange from 2 to 9), others with + and 8 to 15 digits keep their first two."""
    d = _digits(s)
    if (s[0] == "+" and d[0] == "1" and len(d) == 11 and d[1] in "23456789" and d[4] in "23456789") or (s[0] != "+" and len(d) == 10 and d[0] in "23456789" and d[3] in "23456789"):
        own = d[-10:]
        v = f.within(int(own), 10**10, "phone", lambda x: (t := f"{x:010d}")[0] in "23456789" and t[3] in "23456789")
        return refill(s, d[:-10] + f"{v:010d}")
    if s[0] == "+" and 8 <= len(d) <= 15 and d[0] not in "01":
        return refill(s, d[:2] + str(f.permute(int(d[2:]), 10 ** (len(d) - 2), "phone")).zfill(len(d) - 2))
    return None


def ssn(s: str, f: Feistel) -> str | None:
    ok = lambda t: t[:3] not in ("000", "666") and t[0] != "9" and t[3:5] != "00" and t[5:] != "0000"
    d = _digits(s)
    return refill(s, f"{f.within(int(d), 10**9, 'ssn', lambda x: ok(f'{x:09d}')):09d}") if ok(d) else None


def ipv4(s: str, f: Feistel) -> str | None:
    parts = s.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    v = f.permute(int.from_bytes(bytes(map(int, parts)), "big"), 2**32, "ipv4")
    return ".".join(map(str, v.to_bytes(4, "big")))


def _date(fields: list[str], order: str) -> int | None:
    try:
        day = dt.date(*(int(fields[order.index(k)]) for k in "ymd")).toordinal()
    except ValueError:
        return None
    return day if FIRST_DAY <= day <= LAST_DAY else None


def date(s: str, f: Feistel) -> str | None:
    """Days of 1900 to 2099 as y-m-d, d-m-y or else m-d-y with - / or . between.

    One permutation serves all formats, so that a day keeps its pseudonym in whichever it is written.  Days up to the
    12th, which read as d-m-y and as m-d-y, stay among themselves, so that a pseudonym reads as its day did.
    """
    fields = re.split(r"[-/.]", s)
    orders = ("ymd",) if len(fields[0]) == 4 else ("dmy", "mdy")
    order = next((o for o in orders if _date(fields, o) is not None), None)
    if order is None:
        return None

    def write(x: int) -> list[str]:
        t = dt.date.fromordinal(FIRST_DAY + x)
        by = {"y": f"{t.year:04d}", "m": f"{t.month:02d}", "d": f"{t.day:02d}"}
        return [by[k] for k in order]

    day = _date(fields, order) - FIRST_DAY
    early = lambda x: dt.date.fromordinal(FIRST_DAY + x).day <= 12
    new = write(f.within(day, LAST_DAY - FIRST_DAY + 1, "date", lambda x: early(x) == early(day)))
    seps = re.findall(r"[-/.]", s)
    return new[0] + seps[0] + new[1] + seps[1] + new[2]


def email(s: str, f: Feistel) -> str | None:
    local, _, domain = s.partition("@")
    return f.symbols(local, "email") + "@" + domain


def access_key(s: str, f: Feistel) -> str | None:
    return s[:4] + f.symbols(s[4:], "access-key", (BASE32,)) if all(c in BASE32 for c in s[4:]) else f.symbols(s, "access-key")


def secret(s: str, f: Feistel) -> str | None:
    """A secret after password, token, secret or key and = or :; hexadecimal ones stay hexadecimal."""
    m = re.fullmatch(r"(.*?[=:]\s*[\"']?)([A-Za-z0-9+/_\-]+)", s, re.S)
    body = m[2]
    if not any(c in DIGITS for c in body):
        return None
    return m[1] + f.symbols(body, "secret", (HEX,) if all(c in HEX for c in body) else (DIGITS, LOWER, UPPER))


# Kinds in order of precedence at one place; each has a pattern and a validating permutation.
KINDS: tuple[tuple[str, str, Callable[[str, Feistel], str | None]], ...] = (
    ("email", r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]{1,64}@(?:[A-Za-z0-9\-]{1,63}\.){1,8}[A-Za-z]{2,24}\b", email),
    ("secret", r"(?i:\b(?:password|passwd|token|secret|api_?key)\s{0,3}[=:]\s{0,3}[\"']?)[A-Za-z0-9+/_\-]{8,200}", secret),
    ("access_key", r"\bAKIA[A-Z0-9]{16}\b", access_key),
    ("iban", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", iban),
    ("date", r"(?<![\d./\-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}/\d{2}/\d{4}|\d{2}-\d{2}-\d{4}|\d{2}\.\d{2}\.\d{4})(?![\d/\-]|\.\d)", date),
    ("ssn", r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])", ssn),
    ("ipv4", r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d)", ipv4),
    ("phone", r"(?<![\w+])(?:\+\d{1,3}[ .\-]?)?(?:\(\d{3}\)[ .\-]?|\d{3}[ .\-])\d{3}[ .\-]\d{4}(?!\d)|(?<![\w+])\+\d(?:[ .\-]?\d){7,14}(?!\d)", phone),
    ("card", r"(?<![\w.])\d(?:[ \-]?\d){12,18}(?!\w)", card),
)
_PATTERN = re.compile("|".join(f"(?P<{k}>{p})" for k, p, _ in KINDS))
_KINDS = [(k, re.compile(p), code) for k, p, code in KINDS]
_PLACE = {k: i for i, (k, _, _) in enumerate(KINDS)}
_ENDS = {"iban", "phone", "card"}  # their patterns may take in symbols that follow a value
_END = re.compile(r"(?<=\w)(?!\w)")
_GROUPED = re.compile(r"(?<![\w.])(?=(?P<card>\d{13,19}|\d{4}(?P<sep>[ \-])\d{4}(?P=sep)\d{4}(?P=sep)\d{4}(?:(?P=sep)\d{3})?|\d{4}(?P<gap>[ \-])\d{6}(?P=gap)\d{4,5})(?!\w))")
_MAYBE = re.compile(r"[0-9@]")


class Pseudonymizer:
    def __init__(self, key: bytes):
        self.feistel, self.known = Feistel(key), {}

    def replace(self, text: str) -> tuple[str, list[str]]:
        """The text with every validated value replaced, and the kinds replaced in order."""
        if not _MAYBE.search(text):
            return text, []
        kinds: list[str] = []

        out, done, at = [], 0, 0
        while m := _PATTERN.search(text, at):
            found = self._at(text, m)
            if found is None:
                at = m.start() + 1
                continue
            k, end, new = found
            kinds.append(k)
            out += text[done : m.start()], new
            done = at = end
        return "".join(out) + text[done:], kinds

    def _at(self, text: str, m: re.Match) -> tuple[str, int, str] | None:
        """(kind, end, pseudonym) of the first kind with a valid value where `m` starts: the longest match, or a shorter one
        that ends before a symbol of no word."""
        lo = m.start()
        for k, pattern, _ in _KINDS[_PLACE[m.lastgroup] :]:
            if not (whole := pattern.match(text, lo)):
                continue
            ends = [e.start() for e in _END.finditer(text, lo + 1, whole.end())] if k in _ENDS else []
            for end in (whole.end(), *reversed(ends)):
                if end == whole.end() or pattern.fullmatch(text, lo, end):
                    new = self._coded(k, text[lo:end])
                    if new is not None and not (k == "card" and self._cuts_card(text, lo, end)):
                        return k, end, new
        return None

    def _cuts_card(self, text: str, lo: int, end: int) -> bool:
        """Whether digits without a card's usual groups fit by chance: a valid card that has them starts within and goes on behind."""
        if (own := _GROUPED.match(text[lo:end])) and own.end("card") == end - lo:
            return False
        return any(g.end("card") > end and self._coded("card", g["card"]) for g in _GROUPED.finditer(text, lo + 1, end + 24) if g.start() < end)

    def _coded(self, k: str, s: str) -> str | None:
        if (k, s) not in self.known:
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[k, s] = _KINDS[_PLACE[k]][2](s, self.feistel)
        return self.known[k, s]


def pseudonymize(docs: DataFrame, *, key: bytes, text_col: str = "text", found_col: str | None = "pii_kinds") -> DataFrame:
    """All columns of `docs`, with personal values of the whole `text_col` replaced by keyed pseudonyms.

    A pseudonym has its value's format and passes the same validation; equal values get equal pseudonyms in every
    document, whatever their separators.  Values that fail validation stay; a valid one is found whatever symbols follow it,
    or stand before it and fail.  Null texts stay null, empty ones empty.
    `found_col` (if named) is added: array<string> with the kind of each replaced value in order; where a column so
    named exists, it is replaced.  Each row stands alone: no shuffle, and ties or repeated rows change nothing.
    """
    add = [f for f in (found_col,) if f]
    rows = docs.drop(*add) if add else docs
    names = rows.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = Pseudonymizer(key)
        for batch in batches:
            done = [worker.replace(t) if t is not None else (None, []) for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array([t for t, _ in done], batch.schema.field(at).type)
            if add:
                columns.append(pa.array([k for _, k in done], pa.list_(pa.string())))
            yield pa.RecordBatch.from_arrays(columns, names=names + add)

    schema = rows.schema
    if add:
        from pyspark.sql.types import ArrayType, StringType, StructField, StructType

        schema = StructType([*schema.fields, StructField(found_col, ArrayType(StringType()))])
    return rows.mapInArrow(run, schema)


def pseudonym_report(docs: DataFrame, *, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_found, kinds (distinct, sorted, comma-joined) and the text with pseudonyms."""
    rows = pseudonymize(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), key=key)
    return rows.select("doc_id", F.size("pii_kinds").cast("bigint").alias("n_found"), F.array_join(F.array_sort(F.array_distinct("pii_kinds")), ",").alias("kinds"), "text")
