"""Operator 12 against the patterns as they stand, and what checksums and context decide."""

import hashlib
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.cases import ROWS, clashing, documents
from tidemark.llm import pii
from tidemark.llm.queries import QUERIES

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_luhn(digits):
    doubled = [sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(digits[::-1])]
    return sum(doubled) % 10 == 0


def plain(text):
    """Base spans by the patterns as they are given."""
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else 0,
                  "card": 14 <= len(digits) <= 19 and plain_luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(out)]


def found(text):
    return [f"{s['kind']}:{s['start']}:{s['end']}" for s in pii.spans(text)]


def base(text):
    return [f"{s['kind']}:{s['start']}:{s['end']}" for s in pii.spans(text) if s["base"]]


@settings(max_examples=1500, deadline=None)
@given(st.text("aZ.@@%+-_ 0123459()+", max_size=60))
def test_base_spans_are_the_patterns_matches(text):
    assert base(text) == plain(text)


@settings(max_examples=500, deadline=None)
@given(st.text("0459. -", max_size=70))
def test_base_spans_of_digits(text):
    assert base(text) == plain(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["4111 1111 1111 1111", "4111111111111111", "+1 (743) 555-3824", "a.b@c.de", "1.2.3.4", "DE89 3704 0044 0532 0130 00", "078-05-1120", "token", "é", " ", "\n", ", ", "555 123 4567", "ssn", "call"]), max_size=12).map("".join))
def test_added_spans_meet_no_others(text):
    spans = pii.spans(text)
    assert base(text) == plain(text)
    assert spans == sorted(spans, key=lambda s: (s["start"], [k.name for k in pii.KINDS].index(s["kind"])))
    for s in spans:
        assert 0.5 <= s["score"] <= 1
        assert s["base"] or not [o for o in spans if o is not s and o["start"] < s["end"] and s["start"] < o["end"]]


@pytest.mark.parametrize(
    "text, want",
    [
        ("IBAN DE89 3704 0044 0532 0130 00 BIC COBADEFF", ["iban:5:32"]),
        ("IBAN DE88 3704 0044 0532 0130 00", []),
        ("GB82WEST12345698765432.", ["iban:0:22"]),
        ("XX00 AAAA GB82WEST12345698765432", ["iban:10:32"]),
        ("4111111111111111 4111111111111111", ["pan:0:16", "pan:17:33"]),
        ("4111 1111 1111 1111 12", ["pan:0:19"]),
        ("9111 1111 1111 1112 12", []),
        ("my ssn is 078-05-1120", ["ssn:10:21"]),
        ("part 078-05-1120", []),
        ("ssn 000-05-1120, ssn 666-05-1120, ssn 912-05-1120", []),
        ("call (743) 555-3824 now", ["tel:5:19"]),
        ("number (743) 555-3824 now", []),
        ("telephonic 743 555 3824", []),
        ("call +1 (743) 555-3824 now", ["phone:5:22"]),
        ('token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', ["secret:9:49"]),
        ('commit token "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', []),
        ('hash "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', []),
        ("key abcdefghijklmnopqrstuvwxyz", []),
        ("test card 4111 1111 1111 1111", ["card:10:29"]),
    ],
)
def test_checksums_and_context(text, want):
    assert found(text) == want


def test_words_near_a_span_move_its_score():
    number = "4111 1111 1111 1111"
    scores = [pii.spans(t)[0]["score"] for t in (f"card {number}", number, f"sample {number}", f"discard {number}", "card " + " " * 60 + number, f"{number} visa")]
    assert scores == [0.95, 0.6, 0.5, 0.6, 0.6, 0.95]
    assert pii.near("x" * 30 + "key " + "y " * 17 + "1", 68, 69) == {"y"}  # half a word is none


def test_redacted_text():
    text = "mail a.b@c.de or +1 (743) 555-3824, é"
    assert pii.redacted(text, pii.spans(text)) == "mail <email> or <phone>, é"
    assert pii.redacted("1.2.3.4", []) == "1.2.3.4"
    overlapping = [{"start": 0, "end": 5, "kind": "a"}, {"start": 3, "end": 8, "kind": "b"}]
    assert pii.redacted("0123456789", overlapping) == "<a>89"


def test_long_texts_take_linear_time():
    for piece in ("a", "1", "1.", "a@", "+1 ", "AB12", "1-", "A1", "@a.", "(", "1111-"):
        began = time.time()
        pii.spans(piece * 200_000)
        assert time.time() - began < 10, piece


def test_awkward_documents(spark):
    docs = clashing(documents(spark)).drop("start")
    rows = pii.find(docs, redact=True, carry=["lang", "score"]).collect()
    assert len(rows) == len(ROWS) and {r["carried"]["score"] for r in rows} == {"extra score"}
    assert all(r["redacted"] == next(t or "" for i, t, *_ in ROWS if i == r["doc_id"]) for r in rows)
    assert pii.find(documents(spark, [])).count() == 0
    said = "me@x.org, 4111-1111-1111-1111, 1.2.3.4"
    (row,) = pii.counted(pii.find(documents(spark, [(None, said, None, None, None)]))).collect()
    assert tuple(row)[:5] == (None, 1, 1, 1, 0) and row["spans"] == ",".join(plain(said))


def test_op12_by_brute_force(spark, small):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = QUERIES["op12_pii"](spark, small).collect()
    assert len(rows) == len(texts) and sum(r["n_phone"] + r["n_email"] + r["n_card"] + r["n_ip"] for r in rows) > 10
    for r in rows:
        want = plain(texts[r["doc_id"]])
        kinds = [x.split(":")[0] for x in want]
        assert [r[f"n_{k}"] for k in PATTERNS] == [kinds.count(k) for k in PATTERNS]
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(r["spans"].split(",")) | {""} and r["spans"] == ",".join(found(texts[r["doc_id"]]))
