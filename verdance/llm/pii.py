"""PII (operator 7): format-preserving Feistel pseudonyms for validated numbers, dates, addresses and secrets."""

from __future__ import annotations

import datetime
import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

_DAY0, _DAYS = datetime.date(1900, 1, 1).toordinal(), 73049  # to 2099-12-31


def permute(value: int, size: int, key: bytes, kind: str, rounds: int = 8) -> int:
    """Keyed permutation of 0..size-1: a balanced Feistel network over the next even number of bits, walked until the
    value lies in the range again. One permutation for each kind of value and size."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask, width = (1 << half) - 1, (half + 7) // 8
    while True:
        left, right = value >> half, value & mask
        for r in range(rounds):
            h = hashlib.blake2b(right.to_bytes(width, "big"), key=key, person=f"{kind}{r}".encode()[:16], salt=size.bit_length().to_bytes(4, "big"), digest_size=min(64, width + 8))
            left, right = right, left ^ (int.from_bytes(h.digest(), "big") & mask)
        value = left << half | right
        if value < size:
            return value


def luhn(digits: str) -> int:
    """The check digit for the digits before it."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 - i % 2)
        total += d - 9 if d > 9 else d
    return -total % 10


def _refill(shape: str, digits: str) -> str:
    """shape with its digits replaced in order."""
    new = iter(digits)
    return "".join(next(new) if c in "0123456789" else c for c in shape)


def _digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def _number(digits: str, key: bytes, kind: str) -> str:
    return str(permute(int(digits), 10 ** len(digits), key, f"{kind}{len(digits)}")).zfill(len(digits))


def card(text: str, key: bytes) -> str | None:
    """13 to 19 digits whose last is their Luhn check digit; the others are permuted and the check digit made anew."""
    d = _digits(text)
    if not 13 <= len(d) <= 19 or int(d[-1]) != luhn(d[:-1]) or len(set(d)) == 1:
        return None
    body = _number(d[:-1], key, "card")
    return _refill(text, body + str(luhn(body)))


def phone(text: str, key: bytes) -> str | None:
    """7 to 15 digits; a country code after + stays."""
    code = re.match(r"\+[0-9]{1,3}(?=[ .(-])", text)
    head = code[0] if code else "+" if text[0] == "+" else ""
    d = _digits(text[len(head) :])
    if not 7 <= len(d) + len(_digits(head)) <= 15 or len(d) < 6:
        return None
    return head + _refill(text[len(head) :], _number(d, key, "phone"))


def ssn(text: str, key: bytes) -> str | None:
    """Area not 000, 666 or 9xx, group not 00, serial not 0000; permuted among the valid ones."""
    a, g, s = (int(x) for x in re.split("[ -]", text))
    if a in (0, 666) or a >= 900 or not g or not s:
        return None
    area = a - 1 - (a > 666)
    v = permute((area * 99 + g - 1) * 9999 + s - 1, 898 * 99 * 9999, key, "ssn")
    area, g, s = v // 9999 // 99, v // 9999 % 99 + 1, v % 9999 + 1
    area += 1 + (area >= 665)
    return _refill(text, f"{area:03d}{g:02d}{s:04d}")


def ip(text: str, key: bytes) -> str | None:
    """Four numbers of 0 to 255, permuted among all addresses."""
    parts = text.split(".")
    if any(int(x) > 255 or x != str(int(x)) for x in parts):
        return None
    v = permute(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, key, "ip")
    return ".".join(map(str, v.to_bytes(4, "big")))


def iban(text: str, key: bytes) -> str | None:
    """Country, check digits and account; valid modulo 97. The account's digits are permuted, the check digits made anew."""
    check = lambda s: int("".join(str(int(c, 36)) for c in s[4:] + s[:4]))
    plain = text.replace(" ", "")
    if not 15 <= len(plain) <= 34 or check(plain) % 97 != 1:
        return None
    d = _digits(plain[4:])
    new = plain[:2] + "00" + _refill(plain[4:], _number(d, key, "iban")) if d else plain
    new = f"{new[:2]}{98 - check(new) % 97:02d}{new[4:]}"
    fill = iter(new)
    return "".join(c if c == " " else next(fill) for c in text)


def date(text: str, key: bytes) -> str | None:
    """A day of 1900 to 2099 as y-m-d, d-m-y or (if that is no day) m-d-y with -, / or dots; permuted among those days. What is
    read as m-d-y has a day over 12, and so has what is written for it: the permutation is walked until it comes to one, so
    different days have different pseudonyms and each can be undone."""
    sep = re.search("[-/.]", text)[0]
    p = text.split(sep)
    orders = ("ymd",) if len(p[0]) == 4 else ("dmy", "mdy")
    for order in orders:
        at = dict(zip(order, p, strict=True))
        try:
            day = datetime.date(int(at["y"]), int(at["m"]), int(at["d"])).toordinal() - _DAY0
        except ValueError:
            continue
        if not 0 <= day < _DAYS:
            continue
        while True:
            day = permute(day, _DAYS, key, "date")
            new = datetime.date.fromordinal(day + _DAY0)
            if order != "mdy" or new.day > 12:
                break
        value = {"y": f"{new.year:04d}", "m": f"{new.month:02d}", "d": f"{new.day:02d}"}
        return sep.join(value[c] for c in order)
    return None


def _alphabet(text: str, key: bytes, kind: str, sets: tuple[str, ...]) -> str:
    """Each character that lies in one of sets is permuted within its set, all of them as one number."""
    at = [next((s for s in sets if c in s), "") for c in text]
    value, size = 0, 1
    for c, s in zip(text, at, strict=True):
        if s:
            value, size = value * len(s) + s.index(c), size * len(s)
    value = permute(value, size, key, kind) if size > 1 else value
    out = []
    for c, s in zip(reversed(text), reversed(at), strict=True):
        if s:
            value, i = divmod(value, len(s))
            c = s[i]
        out.append(c)
    return "".join(reversed(out))


_DIGITS, _LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"


def email(text: str, key: bytes) -> str | None:
    """ASCII letters and digits change within their kind, but for the last domain label."""
    head, _, tail = text.rpartition(".")
    return f"{_alphabet(head, key, 'mail', (_DIGITS, _LOWER, _LOWER.upper()))}.{tail}"


def secret(text: str, key: bytes) -> str | None:
    """32 to 128 hex digits with a letter and a digit; permuted among such strings."""
    if not re.search("[0-9]", text) or not re.search("[a-fA-F]", text):
        return None
    return _alphabet(text, key, "hex", (_DIGITS + "abcdef",) if text.lower() == text else (_DIGITS + "ABCDEF",))


_MAIL = re.compile(r"(?<![\w.%+-])[\w.%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![\w-])")
_REST = re.compile(
    r"(?P<secret>(?<![0-9A-Za-z])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![0-9A-Za-z]))"
    r"|(?P<iban>(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,4})?)(?![0-9A-Za-z]))"
    r"|(?P<ip>(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9]|[^\W\d_]))"
    r"|(?P<date>(?<![\w/.-])(?:[0-9]{4}(?P<s1>[-/.])[0-9]{1,2}(?P=s1)[0-9]{1,2}|[0-9]{1,2}(?P<s2>[-/.])[0-9]{1,2}(?P=s2)[0-9]{4})(?:(?=[Tt][0-9]{2})|(?![\w/-]|\.[0-9])))"
    r"|(?P<ssn>(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-]))"
    r"|(?P<card>(?<![\w.+-])[0-9](?:[ -]?[0-9]){12,18}(?![\w-]|\.[0-9]))"
    r"|(?P<phone>(?<![\w+.-])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){1,4}|(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4})(?![\w-]|\.[0-9]))"
)
_ANY = re.compile("[0-9]")
RULES: dict[str, Callable[[str, bytes], str | None]] = {"secret": secret, "iban": iban, "ip": ip, "date": date, "ssn": ssn, "card": card, "phone": phone}
_KINDS = {kind: re.compile(next(x for x in re.split(r"(?:^|\|)(?=\(\?P<(?:%s)>)" % "|".join(RULES), _REST.pattern) if x.startswith(f"(?P<{kind}>"))) for kind in RULES}


_GROUP, _ON = re.compile("[0-9]+"), re.compile("[ -][0-9]")
_STUCK = re.compile(r"[\w-]|\.[0-9]")
_PART = re.compile("[^0-9A-Za-z]*[0-9A-Za-z]+")
#: Groups that cards are printed in.
_PRINTED = {(4, 4, 4, 4), (4, 6, 5), (4, 6, 4), (4, 4, 4, 4, 3), (4, 3, 3, 3), (4, 4, 5)}


def _cards(at: int, text: str, end: int, key: bytes) -> tuple[tuple[int, int, str] | None, int]:
    """Start, end and pseudonym of a card among the groups of digits from `at` on, and where the first valid span begins
    (without one, the end of the groups). Of the spans of groups that meet the first valid one, all groups go before
    groups as they are printed or one alone, and these before the first and longest."""
    groups, last, first, best, i = [], False, None, None, 0
    while True:
        while not last and (len(groups) < i + 19):  # as many groups as a card can have
            lo = groups[-1][1] + 1 if groups else at
            groups.append(_GROUP.match(text, lo, end).span())
            last = not _ON.match(text, groups[-1][1], end)
        if i >= len(groups) or first and groups[i][0] >= first[1]:
            break
        n = 0
        for j in range(i, min(i + 19, len(groups))):
            n += groups[j][1] - groups[j][0]
            ends = last and j == len(groups) - 1
            if n > 19 or ends and _STUCK.match(text, groups[j][1], end):  # too long, or the last group goes on as something else
                break
            part = text[groups[i][0] : groups[j][1]]
            d = _digits(part)
            if n < 13 or int(d[-1]) != luhn(d[:-1]) or len(set(d)) == 1:
                continue
            first = first or (groups[i][0], groups[j][1])
            shape = tuple(y - x for x, y in groups[i : j + 1])
            rank = (i > 0 or not ends, len(shape) > 1 and shape not in _PRINTED, part[0] not in "3456", i, -n)
            best = min(best or (rank, groups[i][0], part), (rank, groups[i][0], part))
        i += 1
    if best is None:
        return None, groups[-1][1]
    return (best[1], best[1] + len(best[2]), card(best[2], key)), first[0]


def _ibans(m: re.Match, key: bytes) -> tuple[int, int, str] | None:
    """Start, end and pseudonym of the longest valid IBAN that begins with m and ends with one of its groups."""
    part = m[0]
    while part:
        if new := iban(part, key):
            return m.start(), m.start() + len(part), new
        part = part.rpartition(" ")[0]
    return None


def _rest(text: str, at: int, end: int, key: bytes, found: Counter, clear: int = 0) -> str:
    """text[at:end] with its values but e-mail addresses replaced. Where a match fails, the other kinds and spans that
    begin there are tried, and then what comes after its first group. No card begins before clear."""
    parts = []
    while m := _REST.search(text, at, end):
        kind, span = m.lastgroup if m.lastgroup in RULES else "date", None
        for k in list(RULES)[list(RULES).index(kind) :]:
            if one := m if k == kind else _KINDS[k].match(text, m.start(), end):
                if k == "card":
                    span, clear = _cards(m.start(), text, end, key) if m.start() >= clear else (None, clear)
                elif k == "iban":
                    span = _ibans(one, key)
                elif new := RULES[k](one[0], key):
                    span = one.start(), one.end(), new
            if span:
                break
        if span:
            found[k] += 1
            parts += [text[at : m.start()], _rest(text, m.start(), span[0], key, found, clear), span[2]]
            at = span[1]
        else:
            stop = min(m.end(), _PART.match(text, m.start(), end).end())
            parts.append(text[at:stop])
            at = stop
    return "".join([*parts, text[at:end]])


def pseudonymise(text: str, key: bytes) -> tuple[str, Counter]:
    """The text with every validated value replaced, and how many of each kind; values that fail validation stay."""
    found: Counter = Counter()
    if not _ANY.search(text):
        return (_mail(text, key, found) if "@" in text else text), found
    if "@" not in text:
        return _rest(text, 0, len(text), key, found), found
    parts, at = [], 0
    for m in _MAIL.finditer(text):
        parts += [_rest(text[at : m.start()], 0, m.start() - at, key, found), email(m[0], key)]
        found["email"] += 1
        at = m.end()
    return "".join([*parts, _rest(text[at:], 0, len(text) - at, key, found)]), found


def _mail(text: str, key: bytes, found: Counter) -> str:
    def one(m: re.Match) -> str:
        found["email"] += 1
        return email(m[0], key)

    return _MAIL.sub(one, text)


def protect(docs: DataFrame, key: str | bytes, text: str = "text", count: bool = True) -> DataFrame:
    """docs with the text pseudonymised under the key and, with count, n_replaced and kinds (`kind:n`, sorted,
    comma-joined). The same value gets the same pseudonym in every document, with another key another one. A null text
    stays null with 0 replaced. Other columns stay as they are; columns named n_replaced or kinds are replaced."""
    secret_key = hashlib.blake2b(key.encode() if isinstance(key, str) else key, digest_size=32).digest()
    keep = [c for c in docs.columns if not (count and c.lower() in ("n_replaced", "kinds"))]
    schema = docs.select(*keep).schema
    if count:
        schema = schema.add("n_replaced", "long").add("kinds", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                batch = whole.slice(lo, 1000)
                col = batch.column(keep.index(text)).to_pylist()
                done = [(None, Counter()) if t is None else pseudonymise(t, secret_key) for t in col]
                cols = [pa.array([t for t, _ in done], pa.string()) if c == text else batch.column(i) for i, c in enumerate(keep)]
                if count:
                    cols += [pa.array([sum(f.values()) for _, f in done], pa.int64()), pa.array([",".join(f"{k}:{n}" for k, n in sorted(f.items())) for _, f in done], pa.string())]
                yield pa.record_batch(cols, schema.names)

    return docs.select(*keep).mapInArrow(run, schema)
