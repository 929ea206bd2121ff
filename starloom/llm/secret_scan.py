"""Secrets in texts: keywords by Aho-Corasick, anchored patterns at their hits, checksums that tokens carry."""

from __future__ import annotations

import base64
import binascii
import functools
import hashlib
import json
import re
import zlib
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.llm.common import text_pass


def _anything(match: re.Match[bytes]) -> bool:
    return True


def longer(group: int, least: int) -> Callable[[re.Match[bytes]], bool]:
    """Holds for matches whose ``group`` has at least so many characters."""
    return lambda match: match.end(group) - match.start(group) >= least


_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"


def crc_token(match: re.Match[bytes]) -> bool:
    """Group 1 is followed by its crc32 in six base-62 digits (group 2)."""
    value = zlib.crc32(match[1])
    digits = ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        digits = _BASE62[digit] + digits
    return digits.encode() == match[2]


def base58_check(match: re.Match[bytes]) -> bool:
    """The last four bytes of the base-58 number are the head of the doubled sha256 of those before."""
    number = functools.reduce(lambda sum_, c: sum_ * 58 + _BASE58.index(chr(c)), match[0], 0)
    data = number.to_bytes(max(4, (number.bit_length() + 7) // 8), "big")
    return hashlib.sha256(hashlib.sha256(data[:-4]).digest()).digest()[:4] == data[-4:]


def json_token(match: re.Match[bytes]) -> bool:
    """Both leading parts are base-64 JSON objects; the first names its algorithm."""
    try:
        head, body = (json.loads(base64.urlsafe_b64decode(match[g] + b"=" * (-len(match[g]) % 4))) for g in (1, 2))
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and "alg" in head and isinstance(body, dict)


def der_length(match: re.Match[bytes]) -> bool:
    """The body is base 64 of one DER sequence that is as long as its own length field says."""
    try:
        data = base64.b64decode(b"".join(match[1].split()), validate=True)
    except binascii.Error:
        return False
    if len(data) < 2 or data[0] != 0x30:
        return False
    size, at = data[1], 2
    if size >= 0x80:
        at += size & 0x7F
        size = int.from_bytes(data[2:at], "big")
    return len(data) == at + size


@dataclass(frozen=True)
class Rule:
    """A kind of secret: ``pattern`` is tried where one of the ``keywords`` (in lower case) begins, ``valid`` confirms.

    Texts are matched as bytes, one for each code point, with ``?`` for those above U+00FF; so no pattern may take a ``?``
    or a byte above 0x7F. Without keywords a rule begins at each run of ``run`` characters that ``alphabet`` holds.
    Matches of one kind are the leftmost ones that don't overlap; ``valid`` drops some of these.
    """

    kind: str
    pattern: bytes
    keywords: tuple[str, ...] = ()
    flags: int = 0
    valid: Callable[[re.Match[bytes]], bool] = _anything
    alphabet: bytes = b""
    run: int = 0


BASE = (
    Rule(
        "assign",
        rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        ("password", "passwd", "secret", "token", "apikey", "api_key"),
        re.IGNORECASE,
        longer(2, 8),
    ),
    Rule("access", rb"AKIA[A-Z0-9]+", ("akia",), 0, longer(0, 16)),
    Rule("hex", rb"[0-9a-f]+", alphabet=b"0123456789abcdef", run=32),
)
CHECKED = (
    Rule("github", rb"gh[oprsu]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])", ("gho_", "ghp_", "ghr_", "ghs_", "ghu_"), 0, crc_token),
    Rule("npm", rb"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])", ("npm_",), 0, crc_token),
    Rule("jwt", rb"(eyJ[A-Za-z0-9_-]+)\.(eyJ[A-Za-z0-9_-]+)\.[A-Za-z0-9_-]+", ("eyj",), 0, json_token),
    Rule("xprv", rb"xprv[1-9A-HJ-NP-Za-km-z]{107}(?![1-9A-HJ-NP-Za-km-z])", ("xprv",), 0, base58_check),
    Rule(
        "pem",
        rb"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----\s([A-Za-z0-9+/=\s]+)-----END (?:[A-Z]+ )*PRIVATE KEY-----",
        ("-----begin",),
        0,
        der_length,
    ),
)
RULES = BASE + CHECKED


class Scanner:
    """Finds the spans of ``rules``, each (start, rule's place, end), in one text at a time."""

    def __init__(self, rules: Sequence[Rule]):
        self.patterns = [re.compile(r.pattern, r.flags) for r in rules]
        self.rules = rules
        self.runs = [(at, bytes(120 if b in r.alphabet else 46 for b in range(256)), b"x" * r.run) for at, r in enumerate(rules) if r.run]
        wanted: dict[str, list[int]] = {}
        for at, rule in enumerate(rules):
            for word in rule.keywords:
                wanted.setdefault(word, []).append(at)
        self.automaton = ahocorasick.Automaton()
        for word, places in wanted.items():
            self.automaton.add_word(word, (len(word), places))
        self.automaton.make_automaton()
        self.keyed = bool(wanted)

    def _starts(self, image: bytes) -> Iterable[tuple[int, int]]:
        """(start, rule's place) of every keyword hit, by start."""
        if not self.keyed:
            return []
        hits = self.automaton.iter(image.lower().decode("latin-1"))
        return sorted((end + 1 - size, at) for end, (size, places) in hits for at in places)

    def spans(self, text: str | None) -> list[tuple[int, int, int]]:
        image = (text or "").encode("latin-1", "replace")
        found, free = [], [0] * len(self.rules)

        def attempt(at: int, start: int) -> None:
            match = self.patterns[at].match(image, start)
            if match:
                free[at] = match.end()
                if self.rules[at].valid(match):
                    found.append((start, at, match.end()))

        for start, at in self._starts(image):
            if start >= free[at]:
                attempt(at, start)
        for at, classes, run in self.runs:
            marks = image.translate(classes)
            start = marks.find(run)
            while start >= 0:
                attempt(at, start)
                start = marks.find(run, max(free[at], start + 1))
        return sorted(found)


SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


def find_secrets(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """doc_id and secrets (kind, start, end in code points, end exclusive; by start, then by the order of rules) of every row.

    Rows are read by themselves and whole, without a shuffle: a null or empty text has an empty list, repeated rows and
    null ids give rows like any other, an empty table gives none. Other columns are ignored.
    """
    kinds = [r.kind for r in rules]

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        # Made on the worker: an automaton is built from a few words.
        scanner = _scanner(tuple(rules))
        rows = [[{"kind": kinds[at], "start": start, "end": end} for start, at, end in scanner.spans(text)] for text in part.column(1).to_pylist()]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, kind)], ["doc_id", "secrets"])

    return text_pass(docs, ["doc_id", F.col("text").cast("string")], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, secrets {SPANS}", work)


@functools.lru_cache(maxsize=8)
def _scanner(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


def redact(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """``docs`` with each secret in ``text`` replaced by its kind in square brackets; overlapping ones become one, of the first kind.

    Keeps rows and columns, and null texts as they are.
    """
    place = docs.columns.index("text")

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        scanner, out = _scanner(tuple(rules)), []
        for text in part.column(place).to_pylist():
            pieces, upto = [], 0
            for start, at, end in scanner.spans(text):
                if start >= upto:
                    pieces += [text[upto:start], f"[{rules[at].kind}]"]
                upto = max(upto, end)
            out.append(text if text is None else "".join(pieces) + text[upto:])
        return part.set_column(place, part.schema.field(place), pa.array(out, part.schema.field(place).type))

    return text_pass(docs, docs.columns, docs.schema, work)


def _listed(secrets: Column) -> Column:
    return F.concat_ws(",", F.transform(secrets, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def secrets_digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of their spans, and all spans as text, from what :func:`find_secrets` returns."""
    of = lambda *kinds: F.filter("secrets", lambda s: s["kind"].isin(*kinds))
    counts = [F.size(of(r.kind)).cast("long").alias(f"n_{r.kind}") for r in BASE]
    base = F.sha2(_listed(of(*[r.kind for r in BASE])).cast("binary"), 256)
    return found.select("doc_id", *counts, base.alias("base_sha256"), _listed(F.col("secrets")).alias("spans"))
