"""Personal data become format-preserving pseudonyms (operator 5).

Validated numbers (payment cards by their check digit, account numbers by their remainder of 97,
telephone numbers, IPv4 addresses, US social security numbers), dates, the letters and digits of mail
addresses and secret keys are permuted by a keyed Feistel network inside their own format. The permutation is a
bijection of the format, so equal values stay linked across documents and different ones stay apart, and
the holder of the key can undo it. The key comes from the session (spark.mailward.pii.key); without one, each call makes its own.

A format is a list of radices, one for each changeable place; separators stay. The network halves the
list, and each round adds a keyed function of one half to the other, modulo its radix product. Cycle
walking repeats the permutation until the result passes the same validation.

Undoing goes by the recorded finds (``restored``) and is exact. ``back`` searches the text anew, which may
read digits beside a value differently: a card number before a free group of digits may pass with it.

Defined results. A null text stays null and an empty one empty. Of overlapping finds the earliest counts; at
one place the first valid one of: the whole pattern, the other kinds' patterns, and shorter readings, longest
first. After a place without a valid one the search goes on behind its first token. A date with two leading digits is day first where it can be, else month first; the time
of a timestamp stays. Values that fail validation stay as they are. All other columns pass through.
"""

from __future__ import annotations

import hashlib
import re
import secrets
from datetime import date, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pieces, table

#: Setting that holds the key of the permutations.
KEY_SETTING = "spark.mailward.pii.key"
ROUNDS = 10
KINDS = ("email", "iban", "card", "ssn", "phone", "ipv4", "date", "secret")


class Feistel:
    """A keyed permutation of mixed-radix numbers; tweak separates kinds."""

    def __init__(self, key: bytes):
        self.key = key

    def _f(self, tweak: str, r: int, other: int, size: int) -> int:
        data = f"{tweak}|{r}|{other}".encode()
        wide = hashlib.blake2b(data, key=self.key[:64], digest_size=64).digest()
        while 8 * len(wide) < size.bit_length() + 64:
            wide += hashlib.blake2b(wide + data, key=self.key[:64], digest_size=64).digest()
        return int.from_bytes(wide, "big") % size

    def permute(self, places: list[int], radices: list[int], tweak: str, back: bool = False) -> list[int]:
        half = (len(radices) + 1) // 2
        sizes, halves = [], []
        for part, rs in ((places[:half], radices[:half]), (places[half:], radices[half:])):
            value, size = 0, 1
            for p, r in zip(part, rs, strict=True):
                value, size = value * r + p, size * r
            halves.append(value)
            sizes.append(size)
        tweak = f"{tweak}|{radices}"
        for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
            i = r % 2
            step = self._f(tweak, r, halves[1 - i], sizes[i])
            halves[i] = (halves[i] - step if back else halves[i] + step) % sizes[i]
        out = []
        for value, rs in zip(halves, (radices[:half], radices[half:]), strict=True):
            digits = []
            for r in reversed(rs):
                digits.append(value % r)
                value //= r
            out += digits[::-1]
        return out

    def walk(self, places, radices, tweak, valid, back=False):
        """Cycle walking: repeated until valid, which keeps the map a bijection of the valid values."""
        while True:
            places = self.permute(places, radices, tweak, back)
            if valid(places):
                return places


def luhn(digits: list[int]) -> bool:
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits))) % 10 == 0


def _digits(text: str) -> list[int]:
    return [ord(c) - 48 for c in text if "0" <= c <= "9"]


def _filled(text: str, digits: list[int]) -> str:
    it = iter(digits)
    return "".join(str(next(it)) if "0" <= c <= "9" else c for c in text)


def _letters(text: str, feistel: Feistel, tweak: str, back: bool, sets=("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")) -> str:
    at = [(i, s) for i, c in enumerate(text) for s in sets if c in s]
    new = feistel.permute([s.index(text[i]) for i, s in at], [len(s) for _, s in at], tweak, back)
    out = list(text)
    for (i, s), v in zip(at, new, strict=True):
        out[i] = s[v]
    return "".join(out)


def _email(m, f, back):
    local, domain = m.group().rsplit("@", 1)
    return f"{_letters(local, f, 'email|' + domain.lower(), back)}@{domain}"


def _card(m, f, back):
    d = _digits(m.group())
    if not luhn(d) or len(set(d)) == 1:
        return None

    def whole(body):
        return [*body, next(c for c in range(10) if luhn([*body, c]))]

    # The first places are permuted and the check digit follows from them. A leading zero stays one.
    if d[0]:
        body = f.walk(d[:-1], [10] * (len(d) - 1), "card", lambda p: p[0] != 0 and len(set(whole(p))) > 1, back)
    else:
        body = [0, *f.walk(d[1:-1], [10] * (len(d) - 2), "card0", lambda p: any(p), back)]
    return _filled(m.group(), whole(body))


def _iban(m, f, back):
    text = m.group()
    flat = text.replace(" ", "")

    def rest(s):
        return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97

    if not 15 <= len(flat) <= 34 or rest(flat) != 1:
        return None
    body = _letters(flat[4:], f, f"iban|{flat[:2]}", back)
    new = f"{flat[:2]}{98 - rest(flat[:2] + '00' + body):02d}{body}"
    it = iter(new)
    return "".join(c if c == " " else next(it) for c in text)


def _ssn(m, f, back):
    def valid(p):
        area = p[0] * 100 + p[1] * 10 + p[2]
        return area not in (0, 666) and area < 900 and p[3:5] != [0, 0] and p[5:] != [0, 0, 0, 0]

    d = _digits(m.group())
    return _filled(m.group(), f.walk(d, [10] * 9, "ssn", valid, back)) if valid(d) else None


#: A country code: up to its separator, or by the leading digits that tell its length.
_COUNTRY = re.compile(r"\+(?:[0-9]{1,3}[ .-]|[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})")


def _phone(m, f, back):
    text = m.group()
    cut = _COUNTRY.match(text)
    head = cut.group() if cut else ""
    d = _digits(text[len(head) :])
    if not 7 <= len(d) <= 14:
        return None
    # The last seven places are one value in every notation, so a number stays linked with or without its area.
    tail = f.permute(d[-7:], [10] * 7, "phone", back)
    area = f.permute(d[:-7], [10] * (len(d) - 7), "area", back) if len(d) > 8 else d[:-7]
    return head + _filled(text[len(head) :], area + tail)


def _ipv4(m, f, back):
    parts = [int(p) for p in m.group().split(".")]
    if any(p > 255 for p in parts) or any(p != str(int(p)) for p in m.group().split(".")):
        return None
    return ".".join(map(str, f.permute(parts, [256] * 4, "ipv4", back)))


_FIRST, _DAYS = date(1900, 1, 1), (date(2100, 1, 1) - date(1900, 1, 1)).days


def _date(m, f, back):
    parts = re.split(r"([-/.])", m.group())

    def day_of(order):
        try:
            day = (date(*(int(parts[i]) for i in order)) - _FIRST).days
        except ValueError:
            return None
        return day if 0 <= day < _DAYS else None

    # Month first only where day first is no date; such dates, with days above 12, are a domain of their own.
    order = (0, 2, 4) if len(parts[0]) == 4 else (4, 2, 0)
    day, least = day_of(order), 1
    if day is None and order[0] == 4:
        order, least = (4, 0, 2), 13
        day = day_of(order)
    if day is None:
        return None

    def valid(p):
        n = p[0] * 256 + p[1]
        return n < _DAYS and (least == 1 or (_FIRST + timedelta(n)).day >= least)

    a, b = f.walk([day // 256, day % 256], [_DAYS // 256 + 1, 256], "date", valid, back)
    new = _FIRST + timedelta(a * 256 + b)
    for i, v in zip(order, (new.year, new.month, new.day), strict=True):
        parts[i] = f"{v:0{4 if i == order[0] else 2}d}"
    return "".join(parts)


_HEX, _HEX_UPPER = "0123456789abcdef", "0123456789ABCDEF"


def _secret(m, f, back):
    text = m.group()
    if re.fullmatch("[0-9a-f]+", text):
        return _letters(text, f, "secret", back, (_HEX,))
    if len(text) in (32, 40, 64) and re.fullmatch("[0-9A-F]+", text):
        # At least one letter stays, as a text of digits alone counts as lower case.
        new = f.walk([_HEX_UPPER.index(c) for c in text], [16] * len(text), "secret", lambda p: max(p) > 9, back)
        return "".join(_HEX_UPPER[v] for v in new)
    if len(text) in (32, 40, 64) and re.fullmatch("[0-9A-Fa-f]+", text):
        return _letters(text, f, "secret", back, ("0123456789", "abcdef", "ABCDEF"))
    return _letters(text, f, "secret", back)


_RULES = {"email": _email, "iban": _iban, "card": _card, "ssn": _ssn, "phone": _phone, "ipv4": _ipv4, "date": _date, "secret": _secret}

def _patterns() -> dict[str, str]:
    edge, end = r"(?<![0-9A-Za-z.+/-])", r"(?![0-9A-Za-z])"
    return {
        "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,6}\.[A-Za-z]{2,24}(?![A-Za-z0-9])",
        "secret": rf"(?<![A-Za-z0-9])(?:[0-9A-Fa-f]{{64}}|[0-9A-Fa-f]{{40}}|[0-9A-Fa-f]{{32}}){end}|(?<=\bAKIA)[A-Z0-9]{{16}}{end}|(?<=\bghp_)[A-Za-z0-9]{{36}}{end}|(?<=\bsk-)[A-Za-z0-9]{{20,64}}{end}",
        "iban": rf"(?<![A-Za-z0-9])[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,4}})?{end}",
        "ipv4": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])",
        "date": rf"{edge}(?:[0-9]{{4}}(?P<s1>[-/.])[0-9]{{2}}(?P=s1)[0-9]{{2}}(?:(?=T[0-9]{{2}}:?[0-9]{{2}})|(?![0-9A-Za-z/-]))|[0-9]{{2}}(?P<s2>[-/.])[0-9]{{2}}(?P=s2)[0-9]{{4}}(?![0-9A-Za-z/-]))",
        "ssn": rf"{edge}[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}(?![0-9A-Za-z-])",
        "phone": rf"{edge}(?:\+[0-9]{{1,3}}[ .-](?:\([0-9]{{1,4}}\)[ .-]?)?[0-9]{{2,4}}(?:[ .-][0-9]{{2,4}}){{1,4}}|\+[0-9]{{1,3}}[ .-]?[0-9]{{7,12}}|(?:\([0-9]{{3}}\) ?|[0-9]{{3}}[-.])?[0-9]{{3}}-[0-9]{{4}})(?![0-9A-Za-z-])",
        "card": rf"{edge}[0-9](?:[ -]?[0-9]){{12,18}}{end}",
    }


_PATTERNS = _patterns()
_FOUND = re.compile("|".join(f"(?P<{k}>{p})" for k, p in _PATTERNS.items()), re.ASCII)
_ONE = {k: re.compile(p, re.ASCII) for k, p in _PATTERNS.items()}
#: Kinds whose pattern may run on into what follows a value.
_OPEN = ("iban", "phone", "card")
_TOKEN = re.compile(r"[0-9A-Za-z]+")
_MAYBE = re.compile(r"[0-9@]")


def _shorter(kind: str, text: str, m: re.Match):
    """Readings of the kind at the start of m that end at an earlier token of it, longest first."""
    for end in reversed([t.end() for t in _TOKEN.finditer(text, m.start(), m.end())][:-1]):
        part = _ONE[kind].fullmatch(text, m.start(), end)
        if part and not (kind == "phone" and text[end] == "-"):
            yield kind, part


def _card_inside(text: str, m: re.Match) -> int:
    """Where a valid card number starts inside m, behind its first token, and runs on beyond its end; else 0."""
    for t in list(_TOKEN.finditer(text, m.start(), m.end()))[1:]:
        card = _ONE["card"].match(text, t.start())
        if card and any(p.end() > m.end() and luhn(_digits(p.group())) for _, p in [("card", card), *_shorter("card", text, card)]):
            return t.start()
    return 0


def _readings(text: str, m: re.Match):
    """(kind, match) of what may stand at the start of m: its own kind, then the others, then shorter values."""
    start, first = m.start(), next(k for k in KINDS if m.group(k) is not None)
    if first == "phone" and text[start] == "+" and (cut := _card_inside(text, m)):
        # A telephone number has no check digit, so it ends before a card number that it would cut.
        yield from (r for r in _shorter("phone", text, m) if r[1].end() <= cut)
    yield first, m
    whole = {first: m} | {k: o for k in _PATTERNS if k != first and (o := _ONE[k].match(text, start))}
    yield from list(whole.items())[1:]
    for kind in _OPEN:
        if kind in whole:
            yield from _shorter(kind, text, whole[kind])


def _next_find(text: str, at: int, feistel: Feistel, back: bool):
    """(kind, match, permuted value) of the first valid value from at onwards, or None."""
    while m := _FOUND.search(text, at):
        for kind, part in _readings(text, m):
            new = _RULES[kind](part, feistel, back)
            if new is not None:
                return kind, part, new
        at = _TOKEN.search(text, m.start()).end()
    return None


_ANY = re.compile(".*", re.DOTALL)


def restored(text: str | None, spans: list[tuple[str, int, int]], feistel: Feistel) -> str | None:
    """The original of a pseudonymised text by its recorded finds."""
    out, at = [], 0
    for kind, start, end in spans:
        out += [text[at:start], _RULES[kind](_ANY.fullmatch(text, start, end), feistel, True)]
        at = end
    return "".join([*out, text[at:]]) if spans else text


def pseudonymise(text: str | None, feistel: Feistel, back: bool = False) -> tuple[str | None, list[tuple[str, int, int]]]:
    """The text with all finds permuted, and (kind, start, end) of each in the result."""
    if not text or not _MAYBE.search(text):
        return text, []
    out, spans, at, size = [], [], 0, 0
    while found := _next_find(text, at, feistel, back):
        kind, m, new = found
        out += [text[at : m.start()], new]
        size += m.start() - at + len(new)
        spans.append((kind, size - len(new), size))
        at = m.end()
    return "".join([*out, text[at:]]), spans


def session_key(spark: SparkSession) -> bytes:
    """The key of the session's setting. Without one, a new key that nobody holds: values stay linked within the call, and cannot be undone."""
    found = spark.conf.get(KEY_SETTING, None)
    if found is not None and len(found.encode()) < 16:
        raise ValueError(f"{KEY_SETTING} needs 16 bytes or more")
    return found.encode() if found else secrets.token_bytes(32)


def pseudonymise_texts(docs: DataFrame, key: bytes | None = None, back: bool = False, spans_as: str = "pii") -> DataFrame:
    """docs with text replaced and the finds (array of kind, start, end) added, in place of a column of that name.

    Without a key the session's is taken; undoing needs the key.
    """
    if back and key is None:
        raise ValueError("undoing needs the key")
    key = key or session_key(docs.sparkSession)
    own = [c for c in docs.columns if c != spans_as]
    docs = docs.select(*[docs[c] for c in own])
    schema = T.StructType([*docs.schema.fields, T.StructField(spans_as, T._parse_datatype_string("array<struct<kind:string,start:int,end:int>>"))])
    at = own.index("text")
    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        feistel = Feistel(key)
        for batch in pieces(batches):
            texts, found = [], []
            for t in batch.column(at).to_pylist():
                new, where = pseudonymise(t, feistel, back)
                texts.append(new)
                found.append([{"kind": k, "start": a, "end": b} for k, a, b in where])
            columns = [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, spans)], names=[*batch.schema.names, spans_as])

    return docs.mapInArrow(run, schema)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pseudonymise_texts(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kinds = F.col("pii.kind")
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.size("pii").cast("long").alias("n_replaced"), *counts)


QUERIES = {"op5_pii": op5_pii}
ORACLES: dict[str, str] = {}
