"""Format-preserving pseudonyms for personal data.

Numbers and dates that pass their own check (Luhn, mod 97, octet and calendar ranges, numbering
plans) are replaced by another valid value of the same format.  A keyed Feistel network permutes each
format's values, walking on until it meets a valid one, so equal values get equal pseudonyms in all
documents, however they are written, and different values different ones.  E-mail names and hex
secrets are permuted character class by character class in the same way.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspan.llm.words import in_chunks

ROUNDS = 10
FIRST_DAY, DAYS = dt.date(1900, 1, 1).toordinal(), dt.date(2100, 1, 1).toordinal() - dt.date(1900, 1, 1).toordinal()


class Permutation:
    """A keyed permutation of 0..size-1."""

    def __init__(self, key: bytes, label: str, size: int) -> None:
        self.size = size
        self.half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
        self.mask = (1 << self.half) - 1
        self.octets = -(-self.half // 8)
        self.seed = hashlib.blake2b(f"{label}:{size}".encode(), key=key[:64], digest_size=32).digest()

    def _turn(self, x: int, step: int) -> int:
        n, out = self.octets, b""
        block = 0
        while len(out) < n:
            out += hashlib.blake2b(step.to_bytes(2, "big") + block.to_bytes(4, "big") + x.to_bytes(n, "big"), key=self.seed).digest()
            block += 1
        return int.from_bytes(out[:n], "big") & self.mask

    def __call__(self, value: int, valid: Callable[[int], bool] = lambda _: True) -> int:
        """The next valid value on the cycle of value, which must be valid itself."""
        while True:
            left, right = value >> self.half, value & self.mask
            for step in range(ROUNDS):
                left, right = right, left ^ self._turn(right, step)
            value = left << self.half | right
            if value < self.size and valid(value):
                return value


def _refill(shape: str, digits: str) -> str:
    """shape with its digits replaced in turn."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _valid_ssn(n: int) -> bool:
    area, group, serial = n // 1_000_000, n // 10_000 % 100, n % 10_000
    return area not in (0, 666) and area < 900 and group > 0 and serial > 0


def _valid_phone(n: int) -> bool:
    return n // 1_000_000_000 >= 2 and n // 1_000_000 % 10 >= 2


def _mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


# The country codes of two digits; those that begin with 1 or 7 have one, all others three.
TWO_DIGIT_CODES = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())


class Pseudonyms:
    """Replaces what it finds in a text; kinds() are those it knows."""

    KINDS = ("email", "secret", "iban", "card", "ssn", "phone", "ip", "date")
    # what may start inside a run of digits is told by its validator
    FOUND = re.compile(
        r"(?P<email>(?<![\w.+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,24})"
        r"|(?P<secret>(?<![0-9A-Za-z])(?:[0-9a-f]{64}|[0-9a-f]{40}|[0-9a-f]{32}|[0-9A-F]{64}|[0-9A-F]{40}|[0-9A-F]{32})(?![0-9A-Za-z]))"
        r"|(?P<iban>(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z]))"
        r"|(?P<ip>(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[0-9]))"
        r"|(?P<date>(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})(?![0-9]|[./-][0-9]))"
        r"|(?P<ssn>(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?!-?[0-9]))"
        r"|(?P<card>(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9]))"
        r"|(?P<phone>(?<![0-9])(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9A-Za-z])\+[0-9](?:[ -]?[0-9]){7,14}(?![0-9]))"
    )
    MAY = re.compile(r"[0-9@]|[a-f]{32}")

    def __init__(self, key: bytes) -> None:
        self.key = key
        self.held: dict[tuple[str, int], Permutation] = {}
        self.known: dict[tuple[str, str], str | None] = {}

    def _permute(self, label: str, size: int, value: int, valid: Callable[[int], bool] = lambda _: True) -> int:
        p = self.held.get((label, size))
        if p is None:
            p = self.held[label, size] = Permutation(self.key, label, size)
        return p(value, valid)

    def _digits(self, label: str, digits: str, valid: Callable[[int], bool] = lambda _: True) -> str:
        return f"{self._permute(label, 10 ** len(digits), int(digits), valid):0{len(digits)}d}"

    def _classes(self, label: str, text: str) -> str:
        """Letters and digits permuted within their classes, all of the text as one number."""
        bases = [("0", 10) if "0" <= c <= "9" else ("a", 26) if "a" <= c <= "z" else ("A", 26) if "A" <= c <= "Z" else ("", 1) for c in text]
        value, size = 0, 1
        for c, (zero, base) in zip(text, bases, strict=True):
            if zero:
                value, size = value * base + ord(c) - ord(zero), size * base
        if size == 1:
            return text
        shape = "".join(z or c for c, (z, _) in zip(text, bases, strict=True))
        value, out = self._permute(f"{label}:{shape}", size, value), []
        for c, (zero, base) in zip(reversed(text), reversed(bases), strict=True):
            if zero:
                value, at = divmod(value, base)
                c = chr(ord(zero) + at)
            out.append(c)
        return "".join(reversed(out))

    def email(self, s: str) -> str | None:
        name, _, host = s.partition("@")
        return f"{self._classes('email@' + host.lower(), name)}@{host}"

    def secret(self, s: str) -> str | None:
        if not re.search("[0-9]", s) or not re.search("[a-fA-F]", s):
            return None
        new = f"{self._permute('secret', 16 ** len(s), int(s, 16)):0{len(s)}x}"
        return new.upper() if s.upper() == s else new

    def iban(self, s: str) -> str | None:
        whole = s.replace(" ", "")
        if not 15 <= len(whole) <= 34 or _mod97(whole) != 1:
            return None
        bban = self._classes("iban" + whole[:2], whole[4:])
        check = 98 - _mod97(whole[:2] + "00" + bban)
        new = iter(f"{whole[:2]}{check:02d}{bban}")
        return "".join(c if c == " " else next(new) for c in s)

    def card(self, s: str) -> str | None:
        digits = re.sub("[ -]", "", s)
        if not luhn(digits) or not digits.strip("0"):
            return None
        body = self._digits("card", digits[:-1])
        check = next(c for c in "0123456789" if luhn(body + c))
        return _refill(s, body + check)

    def ssn(self, s: str) -> str | None:
        digits = s.replace("-", "")
        return _refill(s, self._digits("ssn", digits, _valid_ssn)) if _valid_ssn(int(digits)) else None

    def phone(self, s: str) -> str | None:
        digits = re.sub("[^0-9]", "", s)
        if len(digits) in (10, 11) and (not s.startswith("+") or digits[0] == "1" and len(digits) == 11):
            lead, body = digits[:-10], digits[-10:]
            fits = _valid_phone(int(body))
            if lead not in ("", "1") or not fits and "(" not in s and "+" not in s:
                return None  # written as a phone number, it is one even outside of the numbering plan
            return _refill(s, lead + self._digits("phone", body, lambda n: _valid_phone(n) == fits))
        if s.startswith("+") and 8 <= len(digits) <= 15:
            n = 1 if digits[0] in "17" else 2 if digits[:2] in TWO_DIGIT_CODES else 3
            return _refill(s, digits[:n] + self._digits(f"phone+{digits[:n]}", digits[n:]))
        return None

    def ip(self, s: str) -> str | None:
        octets = [int(x) for x in s.split(".")]
        if max(octets) > 255:
            return None
        n = self._permute("ip", 1 << 32, int.from_bytes(bytes(octets), "big"))
        return ".".join(map(str, n.to_bytes(4, "big")))

    def date(self, s: str) -> str | None:
        parts = [int(x) for x in re.split("[-/.]", s)]
        orders = [(0, 1, 2)] if "-" in s else [(2, 1, 0)] if "." in s else [(2, 0, 1), (2, 1, 0)]
        for order in orders:
            try:
                day = dt.date(*(parts[i] for i in order)).toordinal() - FIRST_DAY
            except ValueError:
                continue
            if not 0 <= day < DAYS:
                continue
            # days up to the 12th stay such, so that what can be read in either order stays so; all notations
            # that name a day for certain share one permutation, the others have one for each order
            early = lambda n: (dt.date.fromordinal(n + FIRST_DAY).day <= 12) == (parts[order[2]] <= 12)  # noqa: B023,E731
            certain = "/" not in s or max(parts[:2]) > 12
            new = dt.date.fromordinal(self._permute("date" if certain else f"date{order}", DAYS, day, early) + FIRST_DAY)
            values = (new.year, new.month, new.day)
            text = {order[k]: v for k, v in enumerate(values)}
            sep = next(c for c in s if not c.isdigit())
            wide = all(len(x) >= 2 for x in s.split(sep))
            return sep.join(f"{text[i]:0{4 if order[0] == i else 2 if wide else 1}d}" for i in range(3))
        return None

    def __call__(self, text: str | None) -> tuple[str | None, list[tuple[str, int, int]]]:
        """The text with pseudonyms, and (kind, start, end) of each in it."""
        if not text or not self.MAY.search(text):
            return text, []
        out, spans, at, size, pos = [], [], 0, 0, 0
        while m := self.FOUND.search(text, pos):
            kind, said = m.lastgroup, m[0]
            new = self.known.get((kind, said), "")
            if new == "":
                new = getattr(self, kind)(said)
                if len(self.known) < 200_000:
                    self.known[kind, said] = new
            if new is None:  # not valid: something else may start further on
                pos = m.start() + max(1, len(re.match("[0-9A-Za-z]*", said)[0])) if kind in ("secret", "iban", "ip", "date", "ssn", "phone") else m.start() + 1
                continue
            out += [text[at : m.start()], new]
            size += m.start() - at
            spans.append((kind, size, size + len(new)))
            size += len(new)
            at = pos = m.end()
        return "".join([*out, text[at:]]), spans


def pseudonymise(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """All rows and columns of docs; in text_col values are replaced, and pii lists them as
    (kind, start, end) in characters of the new text.

    A cycle of a permutation may be of length one, so a value can, rarely, stand for itself; in formats
    with few values that is less rare.  The host of an address stays, as it tells no person apart on
    common hosts; give a host that names a person to a redaction step first.

    A null text stays null, with an empty list.  Very long texts are read whole; repeated rows and
    equal values come out alike.  A column of docs named pii is replaced.  An empty table gives an
    empty result.
    """
    src = docs.drop("pii")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        swap = Pseudonyms(key)
        for t in batches:
            texts = t.column(1).to_pylist()
            for lo, hi in in_chunks(texts, 8 << 20):
                done = [swap(x) for x in texts[lo:hi]]
                spans = pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in d[1]] for d in done], pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))
                yield pa.RecordBatch.from_arrays([t.column(0).slice(lo, hi - lo), pa.array([d[0] for d in done], pa.string()), spans], ["__row", "__text", "pii"])

    rest = F.struct(F.lit(None).cast("int").alias("__none"), *(F.col(f"`{c}`") for c in src.columns if c != text_col))
    whole = src.select(rest.alias("__row"), F.col(f"`{text_col}`").alias("__text"))
    spans = T.StructField("pii", T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))
    done = whole.mapInArrow(run, T.StructType([*whole.schema.fields, spans]))
    return done.select(*(F.col("__text").alias(c) if c == text_col else F.col("__row").getField(c).alias(c) for c in src.columns), "pii")


def kinds_found(done: DataFrame) -> DataFrame:
    """done, as pseudonymise gives it, with one column a kind, pii_<kind>: how many it had of that kind.
    Columns that have these names already are replaced."""
    count = lambda kind: F.size(F.filter("pii", lambda p: p["kind"] == kind)).cast("long").alias(f"pii_{kind}")
    return done.drop(*(f"pii_{k}" for k in Pseudonyms.KINDS)).select("*", *(count(k) for k in Pseudonyms.KINDS))
