"""Operator 12: personal data by patterns, checksums and context.

Each kind proposes spans by a pattern, confirms them by a validator (Luhn for cards, mod 97 for IBANs, ranges for
the rest) and scores what is left: the kind's own score, more if words near the span name the kind, less if they
name something else. Spans that score 0.5 or more are found. Four kinds are base: whatever their pattern matches,
leftmost and without overlaps, and their validator confirms stays, with a score of 0.5 at least. The others are
added where no earlier kind has a span.

Patterns run in time linear in a text: an address is looked for from its @, and runs of digits or letters are
entered at their beginning only.

Defined results: a null text is as an empty one and has no spans; places are code points, ends exclusive; spans are
ordered by their beginning, then by kind as listed in KINDS; equal rows and null ids are kept; very long texts are
searched whole; an empty table gives no rows; other columns are ignored, or carried.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import carried, carried_of, sliced, text_or_empty, with_carried

THRESHOLD, STEP = 0.5, 0.35
#: Code points before and after a span in which words count.
BEFORE, AFTER = 40, 20

#: Words that speak for a kind, and those that speak against any.
CARD_WORDS = "amex card carta carte credit debit karte kreditkarte mastercard payment tarjeta visa zahlung"
IBAN_WORDS = "account bank bic compte cuenta iban konto swift transfer"
PHONE_WORDS = "anruf appeler call cell contact fax mobile phone tel telefon telefono telephone whatsapp"
SECRET_WORDS = "api apikey auth authorization bearer credential credentials key passwd password pwd secret token"
SSN_WORDS = "security social ssn taxpayer tin"
AGAINST = "build checksum commit dummy ean example isbn md sample serial sha sku test uuid version"

Span = tuple[int, int]

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])++")
GROUP = re.compile(r"[0-9]+")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
WORD = re.compile(r"[^\W\d_]+")


def matches(pattern: str) -> Callable[[str], Iterator[Span]]:
    find = re.compile(pattern).finditer
    return lambda text: (m.span() for m in find(text))


def emails(text: str) -> Iterator[Span]:
    """As the pattern's leftmost matches, looked for from each @."""
    last, at = 0, text.find("@")
    while at >= 0:
        start, found = at, DOMAIN.match(text, at + 1)
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < at and found:
            last = found.end()
            yield start, last
        at = text.find("@", max(last, at + 1))


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(GROUP.findall(text))


def is_card(text: str) -> bool:
    digits = digits_of(text)
    return 14 <= len(digits) <= 19 and luhn(digits)


def is_ip(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))


def is_phone(text: str) -> bool:
    return 10 <= len(digits_of(text)) <= 15


def card_parts(text: str) -> Iterator[Span]:
    """Whole groups of digits that are a card, in longer runs that aren't one."""
    for run in DIGITS.finditer(text):
        if is_card(run.group()):
            continue
        groups, i = [m.span() for m in GROUP.finditer(text, *run.span())], 0
        while i < len(groups):
            n, j, stop = 0, i, None
            while j < len(groups) and n + groups[j][1] - groups[j][0] <= 19:
                n += groups[j][1] - groups[j][0]
                if n >= 14 and text[groups[i][0]] in "23456" and luhn(digits_of(text[groups[i][0] : groups[j][1]])):
                    stop = j  # the longest
                j += 1
            if stop is None:
                i += 1
            else:
                yield groups[i][0], groups[stop][1]
                i = stop + 1


def mod97(text: str) -> bool:
    code = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def ibans(text: str) -> Iterator[Span]:
    """The longest confirmed reading from each beginning; what follows one in capitals may not be part of it."""
    at = 0
    while found := IBAN.search(text, at):
        start, end = found.span()
        at = start + 4
        while end - start >= 15:
            if text[end - 1] != " " and not text[end : end + 1].isalnum() and mod97(text[start:end]):
                yield start, end
                at = end
                break
            end -= 1


def is_ssn(text: str) -> bool:
    area, group, serial = text.split("-")
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


def is_secret(text: str) -> bool:
    return any(c.isdigit() for c in text) and any(c.isalpha() for c in text) and len(set(text)) >= 8


@dataclass(frozen=True)
class Kind:
    name: str
    propose: Callable[[str], Iterator[Span]]
    valid: Callable[[str], bool]
    score: float
    words: str = ""
    base: bool = False


KINDS = (
    Kind("email", emails, lambda x: True, 0.9, base=True),
    Kind("ip", matches(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"), is_ip, 0.6, "address host ip server", base=True),
    Kind("card", matches(DIGITS.pattern), is_card, 0.6, CARD_WORDS, base=True),
    Kind("phone", matches(r"\+[0-9][ ().0-9-]+[0-9]"), is_phone, 0.6, PHONE_WORDS, base=True),
    Kind("iban", ibans, lambda x: True, 0.85, IBAN_WORDS),
    Kind("pan", card_parts, lambda x: True, 0.5, CARD_WORDS),
    Kind("ssn", matches(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"), is_ssn, 0.3, SSN_WORDS),
    Kind("tel", matches(r"(?<![0-9+(])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"), lambda x: True, 0.3, PHONE_WORDS),
    Kind("secret", matches(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}+={0,2}(?![A-Za-z0-9+/_=-])"), is_secret, 0.3, SECRET_WORDS),
)
WORDS = {k.name: frozenset(k.words.split()) for k in KINDS}
NOT_WORDS = frozenset(AGAINST.split())


def near(text: str, start: int, end: int) -> set[str]:
    """The whole words in lower case that begin or end near a span."""
    low, high = max(0, start - BEFORE), end + AFTER
    while 0 < low < start and text[low - 1].isalpha() and text[low].isalpha():
        low += 1  # a word cut in two is none
    words = WORD.findall(text, low, start) + WORD.findall(text, end, high)
    return {w.lower() for w in words}


def score(kind: Kind, text: str, start: int, end: int) -> float:
    words = near(text, start, end)
    found = kind.score + STEP * bool(words & WORDS[kind.name]) - STEP * bool(words & NOT_WORDS)
    return round(min(1.0, max(THRESHOLD if kind.base else 0.0, found)), 2)


def spans(text: str) -> list[dict]:
    """kind, start, end, score and base of each span found."""
    found, taken = [], []
    for i, kind in enumerate(KINDS):
        if not kind.base and not taken and found:
            taken = covers([(s["start"], s["end"]) for _, s in found])
        for start, end in kind.propose(text):
            if not kind.valid(text[start:end]) or not kind.base and meets(taken, start, end):
                continue
            value = score(kind, text, start, end)
            if value >= THRESHOLD:
                found.append((i, {"kind": kind.name, "start": start, "end": end, "score": value, "base": kind.base}))
                if not kind.base:
                    taken.insert(bisect_left(taken, (start, end)), (start, end))
    return [s for _, s in sorted(found, key=lambda x: (x[1]["start"], x[0]))]


def covers(places: list[Span]) -> list[Span]:
    """Places as ascending ones that don't overlap."""
    out: list[Span] = []
    for start, end in sorted(places):
        if out and start < out[-1][1]:
            out[-1] = out[-1][0], max(end, out[-1][1])
        else:
            out.append((start, end))
    return out


def meets(taken: list[Span], start: int, end: int) -> bool:
    at = bisect_left(taken, (start, end))
    return at < len(taken) and taken[at][0] < end or at > 0 and taken[at - 1][1] > start


def redacted(text: str, found: list[dict]) -> str:
    """text with each span replaced by its kind in angle brackets; of overlapping ones the first stands for all."""
    out, at, kinds = [], 0, {s["start"]: s["kind"] for s in reversed(found)}
    for start, end in covers([(s["start"], s["end"]) for s in found]):
        out += [text[at:start], f"<{kinds[start]}>"]
        at = end
    return "".join(out) + text[at:]


SPANS = "array<struct<kind string, start int, end int, score double, base boolean>>"
ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("base", pa.bool_())]))


def find(docs: DataFrame, redact: bool = False, carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, spans, with redact the redacted text, and the columns of carry in one struct."""
    rows = docs.select("doc_id", text_or_empty(), *carried(docs, carry))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = batch.column("text").to_pylist()
            found = [spans(t) for t in texts]
            out = {"doc_id": batch.column("doc_id"), "spans": pa.array(found, ARROW)}
            if redact:
                out["redacted"] = pa.array([redacted(t, f) for t, f in zip(texts, found)], pa.string())
            out |= carried_of(batch)
            yield pa.record_batch(list(out.values()), list(out))

    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, spans {SPANS}" + (", redacted string" if redact else "")
    return rows.mapInArrow(scan, with_carried(rows, schema))


def joined(found: Column) -> Column:
    """kind:start:end of each, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def counted(found: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    base = F.filter("spans", lambda s: s["base"])
    number = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [number(k.name) for k in KINDS if k.base]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
