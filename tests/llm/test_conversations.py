"""Operator 13 against the cheapest of all edit sequences, and its chunks against whole conversations."""

import hashlib
import heapq
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.support import duck, same
from tidemark.llm import conversations as conv
from tidemark.llm.queries import ORACLE_SQL, QUERIES

LEGAL = re.compile("(s?(ua)+)?")


def cheapest(rows):
    """Cost, edits and messages of the cheapest legal conversation, of equal ones the edits that sort first. rows: role, text, gone, truncated."""
    after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, edits, t, state, said = heapq.heappop(heap)
        if (t, state) in done:
            continue
        done.add((t, state))
        if t == len(rows) and state in ("", "a"):
            return cost, edits, list(said)
        for name in ("user", "assistant"):
            if to := after.get((state, name[0])):
                heapq.heappush(heap, (cost + 5, edits + "I", t, to, (*said, f"{name}:")))
        if t < len(rows):
            role, text, gone, truncated = rows[t]
            heapq.heappush(heap, (cost + 2, edits + "D", t + 1, state, said))
            for letter, more, names in (("K", 0, (role,)), ("R", 1, ("user", "assistant"))):
                for name in names:
                    to = after.get((state, name[:1]))
                    if to and not gone:
                        heapq.heappush(heap, (cost + more + 5 * truncated, edits + letter, t + 1, to, (*said, f"{name}:{text}")))


def plain(rows):
    """The reports of rows of conv_id, turn, role, text, as they come."""
    out = []
    for c in {r[0] for r in rows}:
        mine = []
        for _, turn, role, text in (r for r in rows if r[0] == c):
            code = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            role, text = "user" if code == 4 else role, "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
            mine += [(turn, role, text)] * {0: 0, 3: 2}.get(code, 1)
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        seen, judged, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in mine:
            core = text.strip(conv.BLANKS)
            fault = "blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            judged.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        turns = [t for t, _, _ in mine if t is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        cost, edits, said = cheapest(judged)
        assert LEGAL.fullmatch("".join(s[0] for s in said))
        out.append((c, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *counts.values(), illegal, cost, edits, hashlib.sha256("\n".join(said).encode()).hexdigest()))
    return sorted(out, key=repr)


def frame_of(spark, rows, parts=3):
    named = [(*r, "x", 1, b"", 2) for r in rows]
    return spark.createDataFrame(named, "conv_id long, turn long, role string, text string, part string, n long, left binary, edge int").repartition(parts)


def reports(spark, rows):
    return sorted(map(tuple, conv.audited(conv.damage(frame_of(spark, rows))).collect()), key=repr)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", ""]), st.booleans(), st.booleans()), max_size=12), st.integers(1, 5))
def test_edits_are_the_cheapest_and_first(rows, chunk):
    """Chunk by chunk, from true vectors on the right."""
    rows = [(role, str(i), gone, cut) for i, (role, gone, cut) in enumerate(rows)]
    parts = []
    for at in range(0, len(rows), chunk):
        c = conv.Chunk(1, 0, at)
        for role, _, gone, cut in rows[at : at + chunk]:
            c.add({"n": 1, "turn": 0, "role": role, "blank": gone, "new": True, "truncated": cut})
        parts.append(c.closed(True))
    right, state, edits = conv.END, 0, ""
    for p in reversed(parts):
        fixed, left = conv.backward(p["symbols"], right, p["vectors"])
        assert not p["symbols"] or (fixed, left) == conv.backward(p["symbols"], right)  # stopping early changes nothing
        p["true"], right = (fixed, right), left if p["symbols"] else right
    for p in parts:
        letters, state = conv.forward(p["symbols"], *p["true"], p["forced"], p["tail"], state)
        edits += letters
    cost, want, _ = cheapest(rows)
    assert edits + conv.ending(state) == want
    assert sum(sum(p["true"][0][4::5]) for p in parts) + right[0] + 2 * sum(r[2] for r in rows) == cost


def random_rows(seed, n, conversations, texts, roles=("user", "assistant", "system", "tool", None, "")):
    rnd = np.random.default_rng(seed)
    turns = [None, *range(n)]
    out = []
    for _ in range(n):
        text = rnd.choice(texts)
        out.append((int(rnd.integers(conversations)), turns[rnd.integers(len(turns))], roles[rnd.integers(len(roles))], None if text == "null" else str(text)))
    return out


TEXTS = ["Fine.", "And you?", "cut off", "", " \n", "null", "é!", "Done.\t"] + [f"Sentence {i}." for i in range(30)] + [f"clause {i}" for i in range(6)]


@pytest.mark.parametrize("chunk", [2, 7, 4096])
def test_by_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(conv, "CHUNK", chunk)
    rows = random_rows(1, 400, 12, TEXTS) + [(None, 1, "user", "No id."), (None, None, "assistant", "None."), (77, 5, None, None)] + [(50, 3, "user", "Same.")] * 9
    assert reports(spark, rows) == plain(rows)


def alternating(n, text, conv_id=5):
    return [(conv_id, i, ("user", "assistant")[i % 2], text.format(i)) for i in range(n)]


def test_long_conversations_over_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(conv, "CHUNK", 4)
    rows = alternating(300, "Line {}.") + alternating(200, "line {}", 6) + alternating(150, "Same.", 7) + random_rows(2, 200, 1, TEXTS)
    assert reports(spark, rows) == plain(rows)


def test_fix_up_passes_are_few(spark, monkeypatch):
    """Truncated rows are best deleted, so what comes at the end passes through all chunks."""
    monkeypatch.setattr(conv, "CHUNK", 2)
    rows = [(1, i, "assistant", f"cut {i}") for i in range(400)] + [(1, 400, "assistant", "End.")]
    chunks = conv.chunked(conv.judged(conv.usable(frame_of(spark, rows)))).persist()
    turns = list(conv.passes(chunks.where("edge and length(symbols) > 0")))
    assert chunks.count() > 150 and len(turns) <= 6
    assert turns[-1].where("right != unhex('000A0500')").count() > 100  # they didn't converge to what was assumed


def test_messages_and_extra_columns(spark):
    rows = [(1, 0, "assistant", "Hello."), (1, 1, "user", "Well,"), (1, 2, "user", "Yes?"), (1, 3, "assistant", "No."), (2, 0, "system", "Be kind.")]
    got = [tuple(r) for r in conv.repaired(frame_of(spark, rows)).orderBy("conv_id", "position").collect()]
    assert got == [(1, 1, "user", "Yes?", 2, "K"), (1, 2, "assistant", "No.", 3, "K")]
    one = [(1, 0, "user", "Hello."), (1, 1, "assistant", "Hm."), (1, 2, "assistant", "So?"), (1, 3, "user", "Eh?"), (1, 4, "user", "Eh!"), (1, 5, "assistant", "Ah.")]
    edits = "".join(r["edit"] for r in conv.repaired(frame_of(spark, one)).orderBy("position").collect())
    assert edits.replace("D", "") == cheapest([(r[2], r[3], False, False) for r in one])[1].replace("D", "")


def test_empty_table(spark):
    assert conv.audited(conv.damage(frame_of(spark, []))).collect() == []
    assert conv.repaired(frame_of(spark, [])).collect() == []


def test_dropped_conversations_stay_in_the_report(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    assert reports(spark, [(gone, 0, "user", "Hi.")]) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_same_as_sql_with_odd_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(conv, "CHUNK", 5)
    rows = random_rows(4, 500, 9, TEXTS) + alternating(120, "Line {}.", 99)
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    same(QUERIES["op13_conversations"](spark, str(tmp_path)), duck(tmp_path).execute(ORACLE_SQL["op13_conversations"]).df())


def test_op13_same_as_sql(spark, small):
    same(QUERIES["op13_conversations"](spark, small), duck(small).execute(ORACLE_SQL["op13_conversations"]).df())
