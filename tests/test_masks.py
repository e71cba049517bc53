"""Masked spans against a scanner of whole texts, at chunk sizes that cut markers anywhere."""

import numpy as np
import pyarrow as pa
import pytest

from tidemark.operators import masks

PARTS = ["<!--", "-->", "<", ">", "<a ", "</a>", '"', "'", "<script", " ", "</script>", "</SCRIPT>", "<style>", "</style>", "-", "!", "x", "é", "😀", "\n", masks.MARK, "<scripts", "--", "</", "t"]


def whole(text):
    """kind, begin, end of each span, a character at a time."""
    found, mode, i, begin = [], "text", 0, 0
    low = "".join(c.lower() if c.isascii() else c for c in text)
    word = lambda j: j < len(text) and (text[j] == "_" or (text[j].isascii() and text[j].isalnum()))
    while i < len(text):
        if mode == "text" or mode == "tag":
            if text[i] == masks.MARK:
                found.append(("mark", i, i + 1))
                i += 1
            elif mode == "text" and low.startswith("<!--", i):
                mode, begin, i = "comment", i, i + 4
            elif mode == "text" and low.startswith("<script", i) and not word(i + 7):
                mode, begin, i = "script", i, i + 7
            elif mode == "text" and low.startswith("<style", i) and not word(i + 6):
                mode, begin, i = "style", i, i + 6
            elif mode == "text" and text[i] == "<" and i + 1 < len(text) and (low[i + 1] in "/!" or "a" <= low[i + 1] <= "z"):
                mode, i = "tag", i + 2
            elif mode == "tag" and text[i] in "\"'":
                mode, begin, i = text[i], i, i + 1
            else:
                mode = "text" if mode == "tag" and text[i] == ">" else mode
                i += 1
            continue
        mark = {"comment": "-->", "script": "</script>", "style": "</style>"}.get(mode, mode)
        end = low.find(mark, i)
        kind = mode if len(mode) > 1 else "quoted"
        if end < 0:
            return [*found, (kind, begin, len(text))]
        i = end + len(mark)
        found.append((kind, begin, i))
        mode = "tag" if len(mode) == 1 else "text"
    return found if mode in ("text", "tag") else [*found, (mode if len(mode) > 1 else "quoted", begin, len(text))]


@pytest.mark.parametrize("chunk", [10, 11, 17, 1000])
def test_same_as_a_scan_of_the_whole(spark, chunk):
    rnd = np.random.default_rng(5)
    texts = {i: "".join(rnd.choice(PARTS, rnd.integers(1, 60))) for i in range(300)} | {900: "", 901: None, 902: "<!--" * 40, 903: 'a<b "' + "y" * 50}
    frame = spark.createDataFrame([*texts.items(), (None, "<!-- nameless -->")], "page int, html string")
    parts = masks.pieces(frame, "page", "html", chunk).persist()
    got = {}
    for r in masks.spans(parts).collect():
        got.setdefault(r["key"], []).append((r["kind"], r["begin"], r["end"]))
        assert texts[r["key"]][r["begin"] : r["end"]] == r["text"]
    want = {k: v for k, t in texts.items() if t and (v := whole(t))}
    assert {k: sorted(v, key=lambda s: s[1]) for k, v in got.items()} == want
    shown = masks.masked(parts)
    back = {r["key"]: r["text"] for r in masks.unmasked(shown, masks.spans(parts)).collect()}
    assert back == {k: t for k, t in texts.items() if t}
    for r in shown.collect():
        assert r["masked"].count(masks.MARK) == len(want.get(r["key"], []))


def test_edits_between_marks_keep_spans(spark):
    frame = spark.createDataFrame([(1, 'x old <a href="old">old</a><!-- old -->')], "page int, html string")
    parts = masks.pieces(frame, "page", "html")
    edited = masks.masked(parts).selectExpr("key", "replace(masked, 'old', 'new') as masked")
    assert masks.unmasked(edited, masks.spans(parts)).first()["text"] == 'x new <a href="old">new</a><!-- old -->'


def test_no_texts(spark):
    parts = masks.pieces(spark.createDataFrame([], "page int, html string"), "page", "html")
    assert masks.spans(parts).count() == masks.masked(parts).count() == 0


def test_a_chunk_holds_a_marker(spark):
    with pytest.raises(ValueError):
        masks.pieces(spark.createDataFrame([], "page int, html string"), "page", "html", masks.AHEAD)


def test_pieces_of_many_pages_come_out_a_few_at_a_time():
    n = 2000
    columns = {"key": pa.array(range(n)), "start": pa.array([0] * n, pa.int32()), "body": pa.array(['<a b="c">d<!-- e -->' * 5] * n), "size": pa.array([100] * n, pa.int32()), "entry": pa.array([0] * n, pa.int32()), "open_at": pa.array([-1] * n, pa.int32())}
    batches = list(masks.cut_pieces(iter([pa.RecordBatch.from_pydict(columns)])))
    assert max(b.num_rows for b in batches) < 1000
    keys = [k for b in batches for k in b["key"].to_pylist()]
    assert keys == sorted(keys) and len(set(keys)) == n
    text: dict[int, str] = {}
    for b in batches:
        for k, t in zip(b["key"].to_pylist(), b["text"].to_pylist()):
            text[k] = text.get(k, "") + t
    assert text == dict(enumerate(columns["body"].to_pylist()))
