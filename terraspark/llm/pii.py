"""PII: format-preserving Feistel pseudonyms.

Candidates are found by pattern and kept if they are valid: card numbers by their check digit, account numbers by
their check digits, dates by the calendar, IPv4 addresses by their octets, social security numbers by their ranges;
phone numbers, e-mail addresses and access secrets by their form. A value is written as a number below the size of its
format's domain and permuted there by a keyed Feistel network with cycle walking. The result has the same form and is
valid again (check digits are made anew), and equal values get equal pseudonyms in every document, however they are
punctuated. The key alone can turn them back (reveal=True).

A card or account number may stand next to other digits or words that its pattern takes in. Where the longest match is
not valid, the other starts and ends at its groups are tried (the longest from the leftmost start first), and what is
behind the start of a match that fails is searched again.

Domains: card and account digits but the check digits; days of 1900 to 2099 (day first, and month first only where that alone is a date); 2**32 addresses; ten phone digits; letters
and digits of an e-mail's local part and of a secret, each within its class.

Defined cases: a null text stays null, an empty one empty. Repeated rows are treated each. Input columns named n_found or
kinds are replaced; other columns stay.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import plus

ROUNDS = 10
#: Pseudonyms that a task remembers.
REMEMBERED = 100_000
_DAY0, _DAYS = dt.date(1900, 1, 1).toordinal(), dt.date(2099, 12, 31).toordinal() - dt.date(1900, 1, 1).toordinal() + 1
_DIGIT, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

NUMBERS = re.compile(
    rb"(?<![0-9A-Za-z.])(?:"
    rb"(?P<phone>(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|(?<![0-9]-)[0-9]{3}[.-])[0-9]{3}[ .-][0-9]{4}(?![0-9]|-[0-9]))"
    rb"|(?P<ssn>[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9]))"
    rb"|(?P<date>(?:[0-9]{4}(?P<s>[-/.])[0-9]{2}(?P=s)[0-9]{2}|[0-9]{1,2}(?P<t>[-/.])[0-9]{1,2}(?P=t)[0-9]{4})(?![0-9]|[-/.][0-9]))"
    rb"|(?P<ip>[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9]))"
    rb"|(?P<card>[0-9](?:[ -]?[0-9]){12,18}(?![0-9]|-[0-9]))"
    rb")"
)
STARTS = re.compile(rb"[+(0-9]")
IBAN = re.compile(rb"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]){11,30}(?![0-9A-Za-z])")
SECRET = re.compile(rb"(?<![0-9A-Za-z])(?:(?:AKIA|ASIA)(?P<a>[0-9A-Z]{16})(?![0-9A-Za-z])|(?i:token|password|passwd|secret|api_?key)[\"']?[ ]?[=:][ ]?[\"']?(?P<b>[0-9A-Za-z+/_-]{8,}))")
LOCAL = re.compile(rb"[A-Za-z0-9._%+-]+\Z")
DOMAIN = re.compile(rb"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)*\.[A-Za-z]{2,}")


def luhn(digits: str) -> int:
    """The check digit that belongs behind these digits."""
    total = sum(int(d) if i % 2 else (2 * int(d) - 9 if d > "4" else 2 * int(d)) for i, d in enumerate(reversed(digits)))
    return -total % 10


class Feistel:
    """A keyed permutation of range(size) for any size, and its inverse."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, kind: bytes, i: int, half: int, bits: int) -> int:
        return int.from_bytes(hashlib.blake2b(half.to_bytes(40, "big") + bytes([i]) + kind, key=self.key, digest_size=40).digest(), "big") & ((1 << bits) - 1)

    def _once(self, x: int, bits: int, kind: bytes, back: bool) -> int:
        low = bits // 2
        sizes = [low, bits - low]
        a, b = x >> low, x & ((1 << low) - 1)  # a has bits - low bits, b has low
        if not back:
            for i in range(ROUNDS):
                width = sizes[(i + 1) % 2]
                a, b = b, a ^ self._round(kind, i, b, width)
        else:
            for i in reversed(range(ROUNDS)):
                width = sizes[(i + 1) % 2]
                a, b = b ^ self._round(kind, i, a, width), a
        return a << low | b

    def permute(self, x: int, size: int, kind: bytes, back: bool = False) -> int:
        if size < 2:
            return x
        bits = max(2, (size - 1).bit_length())
        tag = kind + size.to_bytes(40, "big")
        while True:
            x = self._once(x, bits, tag, back)
            if x < size:
                return x

    def digits(self, s: str, kind: bytes, back: bool) -> str:
        return str(self.permute(int(s), 10 ** len(s), kind, back)).zfill(len(s))

    def letters(self, s: str, kind: bytes, back: bool) -> str:
        """Letters and digits within their class (or as hexadecimal where all are), everything else as it is."""
        kinds = [next((c for c in (_DIGIT, _LOWER, _UPPER) if ch in c), "") for ch in s]
        for hexes in (_DIGIT + _LOWER[:6], _DIGIT + _UPPER[:6]):
            if len(s) >= 16 and all(ch in hexes for ch in s):
                kinds = [hexes] * len(s)
        form = "".join("." if not k else "x" if len(k) == 16 else k[0] for k in kinds).encode()
        value, size = 0, 1
        for ch, k in zip(s, kinds, strict=True):
            if k:
                value, size = value * len(k) + k.index(ch), size * len(k)
        if size.bit_length() > 300:
            return "".join(self.letters(s[i : i + 40], kind + bytes([i // 40 % 256]), back) for i in range(0, len(s), 40))
        value = self.permute(value, size, kind + form, back)
        out = []
        for ch, k in zip(reversed(s), reversed(kinds), strict=True):
            if k:
                value, r = divmod(value, len(k))
                out.append(k[r])
            else:
                out.append(ch)
        return "".join(reversed(out))


def _spread(form: str, digits: str) -> str:
    """form with its digits replaced in turn."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in form)


def _card_ok(s: str) -> bool:
    d = re.sub(r"\D", "", s)
    return 13 <= len(d) <= 19 and luhn(d[:-1]) == int(d[-1]) and len(set(d)) > 1


def _card(f: Feistel, s: str, back: bool) -> str | None:
    if not _card_ok(s):
        return None
    d = re.sub(r"\D", "", s)
    body = f.digits(d[:-1], b"card", back)
    return _spread(s, body + str(luhn(body)))


def _phone(f: Feistel, s: str, back: bool) -> str | None:
    d = re.sub(r"\D", "", s)
    return _spread(s, d[:-10] + f.digits(d[-10:], b"phone", back))


def _ssn_ok(d: str) -> bool:
    return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"


def _ssn(f: Feistel, s: str, back: bool) -> str | None:
    d = s.replace("-", "")
    if not _ssn_ok(d):
        return None
    while True:
        d = f.digits(d, b"ssn", back)
        if _ssn_ok(d):
            return _spread(s, d)


def _ip(f: Feistel, s: str, back: bool) -> str | None:
    parts = [int(x) for x in s.split(".")]
    if max(parts) > 255:
        return None
    x = f.permute(int.from_bytes(bytes(parts), "big"), 1 << 32, b"ip", back)
    return ".".join(map(str, x.to_bytes(4, "big")))


def _date(f: Feistel, s: str, back: bool) -> str | None:
    parts = re.split(r"[-/.]", s)
    sep = re.search(r"[-/.]", s)[0]
    for order in ("ymd",) if len(parts[0]) == 4 else ("dmy", "mdy"):
        v = dict(zip(order, map(int, parts), strict=True))
        try:
            day = dt.date(v["y"], v["m"], v["d"]).toordinal() - _DAY0
        except ValueError:
            continue
        if not 0 <= day < _DAYS:
            return None
        new = dt.date.fromordinal(_DAY0 + f.permute(day, _DAYS, b"date", back))
        values = {"y": new.year, "m": new.month, "d": new.day}
        return sep.join(str(values[c]).zfill(4 if c == "y" else 2 if len(s) == 10 else 1) for c in order)
    return None


def _iban_check(body: str, country: str) -> str:
    n = int("".join(str(int(c, 36)) for c in body + country + "00"))
    return f"{98 - n % 97:02d}"


def _iban_ok(s: str) -> bool:
    """Valid by check digits, and of its country's length where that is known."""
    d = s.replace(" ", "")
    return re.match("[A-Z]{2}[0-9]{2}", d) is not None and 15 <= len(d) <= 34 and len(d) == IBAN_LENGTHS.get(d[:2], len(d)) and _iban_check(d[4:], d[:2]) == d[2:4]


def _iban(f: Feistel, s: str, back: bool) -> str | None:
    if not 15 <= len(d := s.replace(" ", "")) <= 34 or _iban_check(d[4:], d[:2]) != d[2:4]:
        return None
    body = f.letters(d[4:], b"iban", back)
    it = iter(d[:2] + _iban_check(body, d[:2]) + body)
    return "".join(c if c == " " else next(it) for c in s)


def _email(f: Feistel, s: str, back: bool) -> str | None:
    local, at, domain = s.rpartition("@")
    return f.letters(local, b"email", back) + at + domain


def _secret(f: Feistel, s: str, back: bool) -> str | None:
    return f.letters(s, b"secret", back)


#: Length of the account numbers of a country.
IBAN_LENGTHS = {c: int(n) for n, cs in (x.split(":") for x in "15:NO 16:BE 18:DK,FI,FK,FO,GL,NL,SD 19:MK,SI 20:AT,BA,EE,KZ,LT,LU,MN,XK 21:CH,HR,LI,LV 22:BG,BH,CR,DE,GB,GE,IE,ME,RS,VA 23:AE,GI,IL,IQ,OM,SO,TL 24:AD,CZ,ES,MD,PK,RO,SA,SE,SK,TN,VG 25:LY,PT,ST 26:IS,TR 27:BI,DJ,FR,GR,IT,MC,MR,SM 28:AL,AZ,BY,CY,DO,GT,HU,LB,NI,PL,SV 29:BR,EG,PS,QA,UA 30:JO,KW,MU,YE 31:MT,SC 32:LC 33:RU".split()) for c in cs.split(",")}
GROUPS = {"card": re.compile(rb"[0-9]+"), "iban": re.compile(rb"[0-9A-Z]+")}
#: The run of groups that a card may be part of: card numbers one after another, too.
RUN = re.compile(rb"[0-9]+(?:[ -][0-9]+)*")
RUN_LAST = re.compile(rb"[0-9]+\Z")
_GLUED = frozenset(b".0123456789" + _LOWER.encode() + _UPPER.encode())
ALNUM = frozenset(b"0123456789" + _LOWER.encode() + _UPPER.encode())


def _within(raw: bytes, a: int, b: int, kind: str) -> Iterator[tuple[int, int, str]]:
    """Spans of whole groups in raw[a:b] that are valid cards or account numbers, from the left and without overlap."""
    spans = [(m.start() + a, m.end() + a) for m in GROUPS[kind].finditer(raw[a:b])]
    i = 0
    while i < len(spans):
        found, size = None, 0
        for j in range(i, len(spans)):
            size += spans[j][1] - spans[j][0]
            if size > (19 if kind == "card" else 34):
                break
            if size >= (13 if kind == "card" else 15):
                value = raw[spans[i][0] : spans[j][1]].decode("latin-1")
                # What hyphens join is parted only in numbers written with hyphens throughout.
                parted = (spans[i][0] > a and raw[spans[i][0] - 1] == 45) or (j + 1 < len(spans) and raw[spans[j][1]] == 45)
                if (_card_ok(value) if kind == "card" else _iban_ok(value)) and not (parted and " " in value):
                    found = j
        if found is None:
            i += 1
        else:
            yield spans[i][0], spans[found][1], kind
            i = found + 1


MAKERS: dict[str, Callable[[Feistel, str, bool], str | None]] = {"card": _card, "phone": _phone, "ssn": _ssn, "ip": _ip, "date": _date, "iban": _iban, "email": _email, "secret": _secret}


def candidates(raw: bytes) -> Iterator[tuple[int, int, str]]:
    """(start, end, kind) of everything that has the form of one of the kinds; spans may overlap."""
    for m in SECRET.finditer(raw):
        yield *m.span("a" if m["a"] else "b"), "secret"
    at = raw.find(b"@")
    while at >= 0:
        left, right = LOCAL.search(raw, max(0, at - 64), at), DOMAIN.match(raw, at + 1)
        if left and right:
            yield left.start(), right.end(), "email"
        at = raw.find(b"@", at + 1)
    pos = 0
    while m := IBAN.search(raw, pos):
        whole = m[0].decode("latin-1").replace(" ", "")
        if _iban_check(whole[4:], whole[:2]) == whole[2:4]:
            yield *m.span(), "iban"
            pos = m.end()
        else:
            inner = list(_within(raw, *m.span(), "iban"))
            yield from inner
            # A number may begin inside a match that fails and go on behind it.
            pos = inner[-1][1] if inner else m.start() + 4
    pos = done = 0
    while m := STARTS.search(raw, pos):
        pos = m.start()
        found = NUMBERS.match(raw, pos)
        if found and found["card"] and not _card_ok(found[0].decode("latin-1")):
            found = None  # what is in it comes with its run
        run = RUN.match(raw, pos) if not found and pos >= done and (pos == 0 or raw[pos - 1] not in _GLUED) else None
        if run and run.end() - pos >= 13:
            # Cards at other groups of the run; each run is searched once.
            done = run.end()
            yield from _within(raw, pos, done - (done < len(raw) and raw[done] in ALNUM and len(RUN_LAST.search(run[0])[0])), "card")
        if found:
            yield *found.span(), next(k for k in ("phone", "ssn", "date", "ip", "card") if found[k])
            pos = found.end()
        else:
            pos += 1
            while pos < len(raw) and 48 <= raw[pos] <= 57:
                pos += 1


def pseudonymise_text(raw: bytes, f: Feistel, known: dict, reveal: bool = False) -> tuple[bytes, Counter]:
    """The text with valid candidates replaced, and how many of each kind there were. Of overlapping ones the first counts."""
    out, upto, kinds = [], 0, Counter()
    for a, b, kind in sorted(candidates(raw), key=lambda x: (x[0], -x[1])):
        if a < upto:
            continue
        value = (kind, raw[a:b])
        if value not in known:
            if len(known) >= REMEMBERED:
                known.clear()
            known[value] = MAKERS[kind](f, raw[a:b].decode("latin-1"), reveal)
        if known[value] is not None:
            out += [raw[upto:a], known[value].encode("latin-1")]
            upto = b
            kinds[kind] += 1
    return b"".join([*out, raw[upto:]]) if out else raw, kinds


def pseudonymise(documents: DataFrame, key: bytes, text_col: str = "text", reveal: bool = False) -> DataFrame:
    """documents with text_col rewritten, n_found, and kinds (map of kind to count)."""
    keep = [c for c in documents.columns if c.lower() not in ("n_found", "kinds")]
    base = documents.select(*[F.col(f"`{c}`") for c in keep])
    at = keep.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, known = Feistel(key), {}
        for batch in batches:
            texts, counts = [], []
            for v in batch.column(at).cast(pa.large_binary()):
                raw = v.as_py()
                new, kinds = pseudonymise_text(raw, f, known, reveal) if raw else (raw, Counter())
                texts.append(None if new is None else new.decode())
                counts.append(sorted(kinds.items()))
            cols = [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([sum(n for _, n in c) for c in counts], pa.int64()), pa.array(counts, pa.map_(pa.string(), pa.int64()))], names=[*keep, "n_found", "kinds"])

    return base.mapInArrow(run, plus(base, n_found="long", kinds="map<string,bigint>"))
