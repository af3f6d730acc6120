"""Personal data by anchor expansion.

One Aho-Corasick automaton runs over each whole text and reports anchors: at
signs, the ``://`` of schemes, plus signs before digits, pairs of digits, digits
around a dot, and words that announce an account, a secret or an identifier.
Deterministic local parsers expand each anchor to the left and right and
validate what they find; the text between anchors is read by nothing else.

Base kinds, each leftmost and non-overlapping within its kind; a match that
fails its check is dropped and not tried again:

- email: local part, at sign, domain of two labels or more;
- ip: four numbers, each at most 255;
- card: digits with single blanks or hyphens between, 14 to 19, Luhn sum right;
- phone: plus sign and digits with blanks, dots, hyphens, brackets, 10 to 15.

Added kinds:

- login: the user and password that a URL carries before its host;
- iban: country letters and check digits with a right remainder by 97, after
  the word IBAN; of the blanks and other ends where the account may stop, the
  one that gives its country's length is tried first, then from long to short;
- account: after a word for an account or identifier, a run of 6 to 18 digits;
- secret: after a word for a token, key or password and ``=`` or ``:``, a value of
  16 characters or more with letters and digits.

Words count in any mixture of capitals and small letters.

Spans are code points, end exclusive. Defined cases: a null or empty text has
no spans; bytes that are not valid UTF-8 count as replacement characters;
repeated rows get the same answer; an empty table gives an empty result;
columns other than the id and the text are not read.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import text_of

#: The base kinds, in the order of ties.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "login", "iban", "account", "secret")

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOGIN = re.compile(r"([A-Za-z0-9._~%+-]+:[^\s@/:\"'<>]+)@")
_IBAN = re.compile(r"[\s:#]{0,3}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})(?![A-Za-z0-9])")
#: The characters of an account number by country.
_IBAN_LENGTHS = {
    c: n
    for n, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
        23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
        28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for c in countries.split()
}
_ACCOUNT = re.compile(r"(?:\x20(?:no|nr|number|id)\b\.?)?\s{0,2}[:#=]?\s{0,2}([0-9](?:[\x20-]?[0-9]){5,17})(?![0-9])", re.I)
_SECRET = re.compile(r"\s{0,2}[=:]\s{0,2}[\"']?([A-Za-z0-9_+/.-]{16,})")
_NOT_DIGIT = re.compile(r"[^0-9]")
#: Words that announce an account or identifier, and a secret.
_ACCOUNT_CUES = ("account", "acct", "passport", "tax id", "ssn", "konto", "compte", "cuenta")
_SECRET_CUES = ("token", "api_key", "apikey", "secret", "password", "passwd", "access_key")


def _cases(word: str) -> set[str]:
    return set(map("".join, itertools.product(*({c, c.upper()} for c in word))))


def automaton() -> ahocorasick.Automaton:
    """The anchors; each value is the kind of parser and how far the anchor's start lies before its last character."""
    out = ahocorasick.Automaton()
    digits = "0123456789"
    anchors = {"@": "email", "://": "login"}
    anchors |= {"+" + a: "phone" for a in digits}
    anchors |= {a + "." + b: "ip" for a in digits for b in digits}
    anchors |= {a + s + b: "card" for a in digits for s in ("", " ", "-") for b in digits}
    anchors |= {x: "iban" for x in _cases("iban")}
    anchors |= {x: "account" for w in _ACCOUNT_CUES for x in _cases(w)}
    anchors |= {x: "secret" for w in _SECRET_CUES for x in _cases(w)}
    for text, kind in anchors.items():
        out.add_word(text, (kind, len(text) - 1))
    out.make_automaton()
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _iban(run: str) -> int:
    """How many characters of ``run``, blanks included, are an account number; 0 if none."""
    ends = []
    for end in (i for i in range(len(run), 0, -1) if i == len(run) or run[i] == " "):
        code = run[:end].replace(" ", "")
        if 15 <= len(code) <= 34:
            ends.append((len(code) != _IBAN_LENGTHS.get(code[:2]), -end, code))
    for _, end, code in sorted(ends):
        if int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1:
            return -end
    return 0


def _left(text: str, end: int, low: int, chars: str) -> int:
    """Where the run of ``chars`` that ends at ``end`` begins, not before ``low``; looks back in steps, never over the whole text."""
    at = end
    while at > low:
        start = max(low, at - 64)
        part = text[start:at]
        at = start + len(part.rstrip(chars))
        if at > start:
            break
    return at


def find(text: str, anchors: ahocorasick.Automaton) -> list[tuple[int, int, int]]:
    """All spans as (start, index of kind, end), sorted."""
    found: list[tuple[int, int, int]] = []
    done = dict.fromkeys(KINDS, 0)
    for last, (kind, back) in anchors.iter(text):
        at, low = last - back, done[kind]
        if at < low:
            continue
        span = None
        if kind == "card":
            m = _CARD.match(text, at)
            done[kind] = m.end()
            digits = _NOT_DIGIT.sub("", m.group())
            if 14 <= len(digits) <= 19 and luhn(digits):
                span = m.span()
        elif kind == "ip":
            m = _IP.match(text, _left(text, at + 1, low, "0123456789"))
            if m:
                done[kind] = m.end()
                if all(len(x) <= 3 and int(x or "0") <= 255 for x in (p.lstrip("0") for p in m.group().split("."))):
                    span = m.span()
        elif kind == "email":
            start = _left(text, at, low, _LOCAL)
            m = _DOMAIN.match(text, at + 1) if start < at else None
            if m:
                done[kind] = m.end()
                span = (start, m.end())
        elif kind == "phone":
            m = _PHONE.match(text, at)
            if m:
                done[kind] = m.end()
                if 10 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                    span = m.span()
        elif kind == "login":
            m = _LOGIN.match(text, last + 1)
            if m:
                span = m.span(1)
        elif kind == "iban":
            m = _IBAN.match(text, last + 1)
            if m and (n := _iban(m.group(1))):
                span = (m.start(1), m.start(1) + n)
        else:
            before = text[at - 1] if at else " "
            m = None if before.isalnum() else (_ACCOUNT if kind == "account" else _SECRET).match(text, last + 1)
            if m and (kind == "account" or (any(c.isdigit() for c in m.group(1)) and any(c.isalpha() for c in m.group(1)))):
                span = m.span(1)
                done[kind] = m.end()
        if span:
            found.append((span[0], KINDS.index(kind), span[1]))
    found.sort()
    return found


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


_FIELDS = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def pii_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: doc_id, counts of the base kinds, base_sha256 and spans (kind:start:end, comma-joined, by start)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = automaton()
        for batch in batches:
            cols: list[list] = [[] for _ in range(6)]
            for v in batch.column(1).cast(pa.binary()):
                spans = find((v.as_py() or b"").decode("utf-8", "replace"), anchors)
                base = [s for s in spans if s[1] < len(BASE)]
                counts = [sum(s[1] == k for s in base) for k in range(len(BASE))]
                for c, x in zip(cols, (*counts, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans))):
                    c.append(x)
            types = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types))], names=[x.split()[0] for x in _FIELDS.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(run, _FIELDS)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, with every span replaced by its kind in square brackets; of overlapping spans the first rules."""
    where = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = automaton()
        for batch in batches:
            out = []
            for v in batch.column(where).cast(pa.binary()):
                raw = v.as_py()
                text = (raw or b"").decode("utf-8", "replace")
                parts, at = [], 0
                for a, k, b in find(text, anchors):
                    if a >= at:
                        parts += [text[at:a], f"[{KINDS[k]}]"]
                        at = b
                out.append(raw if not parts else ("".join(parts) + text[at:]).encode())
            field = batch.schema.field(where)
            yield batch.set_column(where, field, pa.array(out, pa.binary()).view(pa.string()).cast(field.type))

    return docs.mapInArrow(run, docs.schema)
