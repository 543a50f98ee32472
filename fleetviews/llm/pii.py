"""Personal data by anchor expansion.

One Aho-Corasick automaton finds the anchors: at-signs, digits, plus signs before digits,
``://`` and cue words of identifiers. From each anchor a small parser expands to both sides,
decides where the address, number or account ends, and validates it. No parser looks at text
that an anchor does not lead to.

Base kinds (email, ip, card, phone) are leftmost and do not overlap within their kind; a match
that fails its check is passed over whole. Added kinds: ``account`` (an IBAN up to three words after
a cue, as long as its country's are, check digits 97), ``url`` (an address that carries a user's
password) and ``secret`` (a quoted or bare value of 16 or more characters after ``token``, ``secret``,
``password`` or ``api_key``, their name's other parts and ``=`` or ``:``; slashes and plus signs belong to
it if it has digits, upper and lower case; or an access key that its own prefix tells). Added spans never
change base spans.

Null and empty texts have no spans. Positions are code points, ends exclusive. Rows are judged
one by one, so repeated rows give repeated results and an empty table an empty one; other
columns do not matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common

#: Base kinds in the order of ties.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "account", "url", "secret")
SECRET_CUES = ("token", "secret", "password", "passwd", "api_key", "apikey")
ACCOUNT_CUES = ("iban",)
KEY_CUES = ("AKIA", "ASIA")
# Characters of an IBAN by country, from the public registry of ISO 13616.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29,
    "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29,
    "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28,
    "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20,
    "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22,
    "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25,
    "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27,
    "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_CHAIN = re.compile(r"[0-9](?:[ -]?[0-9])+")
_DOTTED = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"\W{1,4}(?:[^\W\d_]{1,20}\W{1,4}){0,3}?(?=([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,28}))")
_USERINFO = re.compile(r"://[^\s/@:]+:[^\s/@]+@[A-Za-z0-9.-]+[^\s\"'<>]*")
_NAMED = r"(?:[_-][A-Za-z0-9]{1,16}){0,3}[\"']?\s{0,3}[=:]\s{0,3}[\"']?"
_SECRET = re.compile(_NAMED + r"([A-Za-z0-9_\-]{16,})")
_SECRET_MIXED = re.compile(_NAMED + r"([A-Za-z0-9_\-/+]{16,}={0,2})")
_KEY = re.compile(r"[0-9A-Z]{16}(?![A-Za-z0-9])")
_SCHEME = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+.-")


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for digit in "0123456789":
        found.add_word(digit, ("digit", 1))
    found.add_word("@", ("at", 1))
    found.add_word("://", ("scheme", 3))
    for cue in SECRET_CUES:
        for form in {cue, cue.upper(), cue.capitalize()}:
            found.add_word(form, ("secret", len(form)))
    for cue in ACCOUNT_CUES:
        for form in {cue, cue.upper(), cue.capitalize()}:
            found.add_word(form, ("account", len(form)))
    for cue in KEY_CUES:
        found.add_word(cue, ("key", len(cue)))
    found.make_automaton()
    return found


def _digits(text: str) -> list[int]:
    return [ord(c) - 48 for c in text if "0" <= c <= "9"]


def luhn(digits: list[int]) -> bool:
    """Doubles every second digit from the right; the sum must end in zero."""
    doubled = (2 * d - 9 * (d > 4) for d in digits[-2::-2])
    return (sum(digits[-1::-2]) + sum(doubled)) % 10 == 0


def iban(text: str) -> bool:
    plain = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def _varied(text: str) -> bool:
    """Has a slash or plus sign, digits, upper and lower case."""
    return all(any(test(c) for c in text) for test in ("/+".__contains__, str.isdigit, str.isupper, str.islower))


class Finder:
    """All spans of a text; keeps no state between texts."""

    def __init__(self):
        self.anchors = automaton()

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, kind) by start, then kind."""
        found: list[tuple[int, int, str]] = []
        done = dict.fromkeys(("email", "chain", "dotted", "secret", "account", "url"), 0)
        for last, (kind, length) in self.anchors.iter(text):
            start = last + 1 - length
            if kind == "digit":
                self._number(text, start, found, done)
            elif kind == "at":
                self._email(text, start, found, done)
            elif kind == "scheme":
                self._url(text, start, found, done)
            elif kind == "secret":
                self._secret(text, last + 1, found, done)
            elif kind == "key":
                self._key(text, start, found, done)
            else:
                self._account(text, last + 1, found, done)
        found.sort(key=lambda x: (x[0], KINDS.index(x[2]), x[1]))
        return found

    @staticmethod
    def _number(text, start, found, done) -> None:
        if start and text[start - 1] == "+" and (phone := _PHONE.match(text, start - 1)):
            if 9 <= len(_digits(phone.group())) <= 15:
                found.append((phone.start(), phone.end(), "phone"))
        if start >= done["chain"] and (chain := _CHAIN.match(text, start)):
            done["chain"] = chain.end()
            digits = _digits(chain.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((start, chain.end(), "card"))
        if start >= done["dotted"]:
            if dotted := _DOTTED.match(text, start):
                done["dotted"] = dotted.end()
                parts = [x.lstrip("0") for x in dotted.group().split(".")]
                if all(len(x) <= 3 and int(x or 0) <= 255 for x in parts):
                    found.append((start, dotted.end(), "ip"))
            else:  # no later digit of this run begins a match either
                end = start + 1
                while end < len(text) and "0" <= text[end] <= "9":
                    end += 1
                done["dotted"] = end

    @staticmethod
    def _email(text, at, found, done) -> None:
        start = at
        while start > done["email"] and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (domain := _DOMAIN.match(text, at)):
            done["email"] = domain.end()
            found.append((start, domain.end(), "email"))

    @staticmethod
    def _url(text, at, found, done) -> None:
        start = at
        while start > done["url"] and text[start - 1] in _SCHEME:
            start -= 1
        if start < at and (rest := _USERINFO.match(text, at)):
            done["url"] = rest.end()
            found.append((start, rest.end(), "url"))

    @staticmethod
    def _secret(text, at, found, done) -> None:
        wide = _SECRET_MIXED.match(text, at)
        value = wide if wide and _varied(wide.group(1)) else _SECRET.match(text, at)
        if value and value.start(1) >= done["secret"]:
            done["secret"] = value.end(1)
            found.append((value.start(1), value.end(1), "secret"))

    @staticmethod
    def _key(text, at, found, done) -> None:
        bare = at == 0 or not (text[at - 1].isascii() and text[at - 1].isalnum())
        if bare and at >= done["secret"] and (rest := _KEY.match(text, at + 4)):
            done["secret"] = rest.end()
            found.append((at, rest.end(), "secret"))

    @staticmethod
    def _account(text, at, found, done) -> None:
        cue = _IBAN.match(text, at)
        if not cue or cue.start(1) < done["account"]:
            return
        start, left = cue.start(1), IBAN_LENGTHS.get(cue.group(1)[:2], 0)
        end = start
        while left and end < cue.end(1):
            left -= text[end] != " "
            end += 1
        if left or end == start or text[end : end + 1].isalnum() or not iban(text[start:end]):
            return
        done["account"] = end
        found.append((start, end, "account"))


def _listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first counts."""
    out, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


SCHEMA = "doc_id long, spans array<struct<kind: string, start: long, end: long>>, redacted string"


def personal_data(docs: DataFrame, redact: bool = True) -> DataFrame:
    """doc_id, the spans and, if asked for, the redacted text of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder()
        for batch in batches:
            found, clean = [], []
            for value in batch.column("text"):
                text = value.as_py()
                spans = finder.spans(text)
                found.append([{"kind": k, "start": a, "end": b} for a, b, k in spans])
                clean.append(redacted(text, spans) if redact else None)
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(found, kind), pa.array(clean, pa.string())],
                ["doc_id", "spans", "redacted"],
            )

    return docs.select(F.col("doc_id").cast("long"), common.text_of().alias("text")).mapInArrow(run, SCHEMA)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(common.documents(spark, sf_dir), redact=False)

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in BASE]
    return found.select(
        "doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans")
    )
