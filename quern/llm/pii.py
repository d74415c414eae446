"""Personal data by anchor expansion.

One Aho-Corasick pass over a whole text finds anchors: at-signs, plus-signs,
digits round a dot, digit pairs, ``://`` and identifier cues. A deterministic
parser for each kind grows the span from its anchor, never left of the previous
span of that kind, and validates it:

* ``email`` grows left over local-part characters and right over labels;
* ``ip`` four dotted numbers of at most 255;
* ``card`` 16 to 19 digits, single blanks or hyphens between, passing Luhn;
* ``phone`` from a plus-sign, 8 to 15 digits;
* ``iban`` (check digits mod 97) after its cue or a digit pair, ``ssn`` and
  ``account`` after their cues, ``url`` with user and password in it, and
  ``secret`` (values after password, token and key cues) are added spans.

The first four are the base; added spans never remove or change one. Spans are
in code points, end exclusive.

Defined cases: a null or empty text has no span; overlapping spans of different
kinds are all kept; repeated rows are judged alike; an empty table gives an empty
result; other columns are ignored. A text is scanned once, and each parser only moves on from the last span's end,
so work and memory are linear in the text, however long.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern import storage

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "account", "url", "secret")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = "0123456789"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?:[ \t:#.=]|no|number|is)*((?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4})(?![0-9-])", re.I)
_ACCOUNT = re.compile(r"(?:[ \t:#.=]|no|number|is)*([0-9](?:[ -]?[0-9]){5,19})(?![0-9])", re.I)
_URL_REST = re.compile(r"://[^\s/?#@:<>\"']+:[^\s/?#@<>\"']+@[A-Za-z0-9.-]+[^\s<>\"']*")
_SECRET = re.compile(r"[\"']?[ \t]*[=:][ \t]*([\"']?)([A-Za-z0-9_+/.=-]{8,})\1")
_KEY_ID = re.compile(r"AKIA[A-Z0-9]{16}(?![A-Za-z0-9])")

# The cues and the parser each leads to.
CUES = {"ssn": "ssn", "SSN": "ssn", "social security": "ssn", "Social Security": "ssn", "account": "account", "Account": "account", "acct": "account", "Acct": "account", "IBAN": "iban", "iban": "iban", "password": "secret", "Password": "secret", "passwd": "secret", "token": "secret", "Token": "secret", "api_key": "secret", "secret": "secret", "AKIA": "key"}


def automaton() -> ahocorasick.Automaton:
    """Anchors; a value is the parser's name and the anchor's length."""
    a = ahocorasick.Automaton()
    for cue, kind in CUES.items():
        a.add_word(cue, (kind, len(cue)))
    a.add_word("@", ("email", 1))
    a.add_word("+", ("phone", 1))
    a.add_word("://", ("url", 3))
    for x in _DIGITS:
        for y in _DIGITS:
            for between, kind in (("", "card"), (" ", "card"), ("-", "card"), (".", "ip")):
                a.add_word(x + between + y, (kind, 2 + len(between)))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _left(text: str, at: int, least: int, allowed) -> int:
    while at > least and text[at - 1] in allowed:
        at -= 1
    return at


def find(text: str | None, anchors: ahocorasick.Automaton) -> dict[str, list[tuple[int, int]]]:
    """The spans of each kind, in order, none overlapping another of its kind."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    past = dict.fromkeys(KINDS, 0)  # where the parser of a kind may start: the end of its last match, valid or not

    def done(kind: str, start: int, end: int, good: bool = True) -> None:
        past[kind] = end
        if good:
            found[kind].append((start, end))

    for last, (kind, n) in anchors.iter(text) if text else ():
        at = last + 1 - n
        if kind == "card":
            if at >= past["card"] and (at == past["card"] or not _continues(text, at, past["card"])):
                m = _CARD.match(text, at)
                digits = m[0].replace(" ", "").replace("-", "")
                done("card", at, m.end(), 16 <= len(digits) <= 19 and luhn(digits))
            if n == 2 and at >= past["iban"] + 2 and text[at - 2 : at].isalpha():
                _iban(text, at - 2, done)
        elif kind == "ip":
            if at >= past["ip"]:
                start = _left(text, at, past["ip"], _DIGITS)
                if m := _IP.match(text, start):
                    done("ip", start, m.end(), all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")))
        elif kind == "email":
            start = _left(text, at, past["email"], _LOCAL)
            if start < at and (m := _DOMAIN.match(text, at)):
                done("email", start, m.end())
        elif kind == "phone":
            if at >= past["phone"] and (m := _PHONE.match(text, at)):
                done("phone", at, m.end(), 8 <= sum(map(m[0].count, _DIGITS)) <= 15)
        elif kind == "url":
            start = _left(text, at, past["url"], _SCHEME)
            if start < at and text[start].isalpha() and (m := _URL_REST.match(text, at)):
                done("url", start, m.end())
        elif kind == "key":
            if at >= past["secret"] and (m := _KEY_ID.match(text, at)):
                done("secret", at, m.end())
        elif kind == "iban":
            continue  # its check digits are an anchor themselves
        elif at + n > past[kind] and (m := {"ssn": _SSN, "account": _ACCOUNT, "secret": _SECRET}[kind].match(text, at + n)):
            group = 2 if kind == "secret" else 1
            if m.start(group) >= past[kind]:
                done(kind, m.start(group), m.end(group))
    return found


_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")


def _continues(text: str, at: int, least: int) -> bool:
    """Whether the digit at ``at`` belongs to a chain that began before it."""
    if text[at - 1] in _DIGITS:
        return at - 1 >= least
    return text[at - 1] in " -" and at - 2 >= least and text[at - 2] in _DIGITS


def _iban(text: str, at: int, done) -> None:
    m = _IBAN.match(text, at)
    if m:
        plain = m[0].replace(" ", "")
        if 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1:
            done("iban", at, m.end())


def joined(found: dict[str, list[tuple[int, int]]], kinds=KINDS) -> str:
    return ",".join(f"{k}:{s}:{e}" for k in kinds for s, e in found[k])


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``found`` (array of kind, start, end, value) of every row."""
    kind = docs.schema[id_col].dataType.simpleString()
    shape = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("value", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = automaton()
        for b in batches:
            out = []
            for cell in b.column(1):
                text = cell.as_py()
                out.append([{"kind": k, "start": s, "stop": e, "value": text[s:e]} for k, v in find(text, anchors).items() for s, e in v])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, shape)], ["doc_id", "found"])

    storage.small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, found array<struct<kind:string,start:bigint,stop:bigint,value:string>>")


def redact(text: str | None, found: list[tuple[str, int, int]]) -> str | None:
    """``text`` without any character of a span: overlapping spans are replaced
    together, by the kind of the one that begins first (the longest of those)."""
    if not found:
        return text
    out, past = [], 0
    joined_spans: list[list] = []
    for kind, s, e in sorted(found, key=lambda x: (x[1], -x[2])):
        if joined_spans and s < joined_spans[-1][2]:
            joined_spans[-1][2] = max(joined_spans[-1][2], e)
        else:
            joined_spans.append([kind, s, e])
    for kind, s, e in joined_spans:
        out += [text[past:s], f"<{kind}>"]
        past = e
    return "".join([*out, text[past:]])


def op7_pii(spark, sf_dir: str) -> DataFrame:
    """Personal data of every document, as digest columns."""
    found = spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    written = lambda kinds: F.array_join(F.transform(F.filter("found", lambda s: s["kind"].isin(*kinds)), lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
    number = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *[number(k).alias(f"n_{k}") for k in BASE], F.sha2(written(BASE), 256).alias("base_sha256"), written(KINDS).alias("spans"))
