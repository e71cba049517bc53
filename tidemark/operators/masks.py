"""Spans of markup that are no text to edit (comments, scripts, styles, quoted attributes), masked and put back.

A scanner of few states goes through a text from left to right. Long texts are cut into chunks that spread over
tasks: each chunk tells for every state that it could be entered in which state it is left in, these functions are
composed in order, and only then is each chunk read from the one state that it is really entered in. A marker that
begins in a chunk may end in the next, so a state also holds how many characters of the next chunk are already read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a chunk. Any size above AHEAD gives the same rows.
CHUNK = 65_536
#: What stands in a masked text for a span; a text's own are spans themselves.
MARK = "\ue000"
#: The longest marker and the character after it.
AHEAD = 9
TEXT, TAG, COMMENT, SCRIPT, STYLE, DOUBLE, SINGLE = range(7)
KINDS = {COMMENT: "comment", SCRIPT: "script", STYLE: "style", DOUBLE: "quoted", SINGLE: "quoted"}
OPENS = re.compile(rf"(?P<comment><!--)|(?P<script><script\b)|(?P<style><style\b)|(?P<tag><[a-z/!])|{MARK}", re.I | re.A)
OPENED = {"comment": COMMENT, "script": SCRIPT, "style": STYLE, "tag": TAG}
IN_TAG = re.compile(f">|\"|'|{MARK}")
CLOSES = {COMMENT: re.compile("-->"), SCRIPT: re.compile("</script>", re.I | re.A), STYLE: re.compile("</style>", re.I | re.A), DOUBLE: re.compile('"'), SINGLE: re.compile("'")}
ENTRIES = [(mode, skip) for mode in range(7) for skip in range(AHEAD)]

State = tuple[int, int]


def step(text: str, size: int, mode: int, at: int) -> tuple[int, int, int] | None:
    """The next marker that begins among the first size characters: the mode after it, where it begins and ends."""
    found = (OPENS if mode == TEXT else IN_TAG if mode == TAG else CLOSES[mode]).search(text, at)
    if not found or found.start() >= size:
        return None
    if mode == TEXT:
        after = OPENED.get(found.lastgroup or "", TEXT)
    elif mode == TAG:
        after = {">": TEXT, '"': DOUBLE, "'": SINGLE}.get(found[0], TAG)
    else:
        after = TAG if mode in (DOUBLE, SINGLE) else TEXT
    return after, found.start(), found.end()


def passage(text: str, size: int) -> tuple[list[int], list[int]]:
    """For each entry the exit, both as numbers of ENTRIES, and where the span begins that is open there (-1: before this chunk, or none)."""
    known: dict[State, tuple[State, int]] = {}
    for entry in ENTRIES:
        path, state = [], entry
        while state not in known:
            found = step(text, size, *state)
            if found is None:
                known[state] = (state[0], max(0, state[1] - size)), -1
                break
            after = (found[0], found[2])
            path.append((state, after, found[1]))
            state = after
        end, begun = known[state]
        for before, after, at in reversed(path):
            if begun < 0 and after[0] in KINDS and end[0] in KINDS:
                begun = at
            known[before] = end, begun
    ends = [known[e][0] for e in ENTRIES]
    return [mode * AHEAD + skip for mode, skip in ends], [known[e][1] for e in ENTRIES]


def cut_up(text: str, size: int, entry: int, begun: int) -> Iterator[tuple[int, str | None, int, str]]:
    """at, kind (null: kept), begin (its span's, or its own; below 0 in an earlier chunk) and the text of each piece of a chunk.

    A span's closing marker is its own whole, also what the next chunk holds of it.
    """
    mode, at = ENTRIES[entry]
    done, begin = (at if mode == TEXT else 0), begun
    while found := step(text, size, mode, at):
        after, start, end = found
        if mode in KINDS:
            yield done, KINDS[mode], begin, text[done:end]
            done = end
        elif after in KINDS or text[start] == MARK:
            if start > done:
                yield done, None, done, text[done:start]
            done = begin = start
            if text[start] == MARK:
                yield start, "mark", start, MARK
                done = end
        mode, at = after, end
    if size > done:
        yield done, KINDS.get(mode), begin if mode in KINDS else done, text[done:size]


#: Chunks at a time of which a task holds Python objects, so they don't add up over a whole batch.
ROWS = 16


def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, chunk, start, ends and begun, of key, chunk, start, body and size."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            found = [passage(t, n) for t, n in zip(part["body"].to_pylist(), part["size"].to_pylist())]
            ends, begun = (pa.array([f[i] for f in found], pa.list_(pa.int32())) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([part["key"], part["chunk"], part["start"], ends, begun], ["key", "chunk", "start", "ends", "begun"])


def cut_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, at, kind, begin and text of each piece, of key, start, body, size, entry and open_at."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part, row, out = batch.slice(at, ROWS), [], {"at": [], "kind": [], "begin": [], "text": []}
            for i, (start, body, size, entry, open_at) in enumerate(zip(*(part[c].to_pylist() for c in ("start", "body", "size", "entry", "open_at")))):
                for place, kind, begin, text in cut_up(body, size, entry, open_at - start):
                    row.append(i)
                    for c, v in zip(out, (start + place, kind, start + begin, text)):
                        out[c].append(v)
            kinds = {"at": pa.int32(), "kind": pa.string(), "begin": pa.int32(), "text": pa.string()}
            yield pa.RecordBatch.from_arrays([part["key"].take(pa.array(row, pa.int32())), *(pa.array(v, kinds[c]) for c, v in out.items())], ["key", *out])


def entered(parts: pd.DataFrame) -> pd.DataFrame:
    """key, chunk, entry and where the open span begins, of one text's chunks; they are few, as a text is one value."""
    parts, entry, open_at, rows = parts.sort_values("chunk"), 0, -1, []
    for r in parts.itertuples(index=False):
        rows.append((r.key, r.chunk, entry, open_at))
        if r.begun[entry] >= 0:
            open_at = r.start + r.begun[entry]
        entry = int(r.ends[entry])
    return pd.DataFrame(rows, columns=["key", "chunk", "entry", "open_at"])


def pieces(texts: DataFrame, key: str, text: str, chunk: int | None = None) -> DataFrame:
    """key, at, kind (null: kept), begin, text: each text in order, cut where spans begin and end; a long span comes in several pieces.

    key: a column that tells texts apart; texts without one have no pieces, nor do null and empty texts. A span that isn't closed ends with its
    text; what looks like markup within a span is part of it. Offsets count code points.
    """
    size = chunk or CHUNK
    if size <= AHEAD:
        raise ValueError(f"chunk must be more than {AHEAD} characters")
    cut = lambda group: F.regexp_extract_all(F.col(text), F.lit(rf"(?s)(.{{1,{size}}})(?=(.{{0,{AHEAD}}}))"), F.lit(group))
    rows = texts.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.posexplode(F.arrays_zip(cut(1).alias("body"), cut(2).alias("ahead"))).alias("chunk", "part"))
    size_of = F.length("part.body")
    rows = rows.select("key", "chunk", (F.col("chunk") * size).alias("start"), F.concat("part.body", "part.ahead").alias("body"), size_of.alias("size"), (F.length("part.ahead") > 0).alias("more"))
    # Long texts spread over tasks by chunk.
    rows = rows.repartition("key", "chunk")
    # A text of one chunk is entered at its begin, so only others have functions to compose.
    named = f"key {texts.schema[key].dataType.simpleString()}"
    long = rows.where(F.col("more") | (F.col("chunk") > 0)).select("key", "chunk", "start", "body", "size").mapInArrow(passages, f"{named}, chunk int, start int, ends array<int>, begun array<int>")
    entries = long.groupBy("key").applyInPandas(entered, f"{named}, chunk int, entry int, open_at int")
    rows = rows.join(entries, ["key", "chunk"], "left").select("key", "start", "body", "size", F.coalesce("entry", F.lit(0)).alias("entry"), F.coalesce("open_at", F.lit(-1)).alias("open_at"))
    return rows.mapInArrow(cut_pieces, f"{named}, at int, kind string, begin int, text string")


def spans(parts: DataFrame) -> DataFrame:
    """key, kind, begin, end (exclusive), text of each span."""
    ordered = F.sort_array(F.collect_list(F.struct("at", "text")))
    found = parts.where("kind is not null").groupBy("key", "kind", "begin").agg(F.array_join(F.transform(ordered, lambda p: p["text"]), "").alias("text"))
    return found.select("key", "kind", "begin", (F.col("begin") + F.length("text")).alias("end"), "text")


def masked(parts: DataFrame) -> DataFrame:
    """key, masked: texts with one MARK in place of each span."""
    shown = F.when(F.col("kind").isNull(), F.col("text")).when(F.col("at") == F.col("begin"), MARK)
    ordered = F.sort_array(F.collect_list(F.struct("at", shown.alias("shown"))))
    return parts.groupBy("key").agg(F.array_join(F.transform(ordered, lambda p: F.coalesce(p["shown"], F.lit(""))), "").alias("masked"))


def unmasked(texts: DataFrame, found: DataFrame) -> DataFrame:
    """key, text: masked texts, edited or not, with their spans put back in order; what stands between marks may change, marks may not."""
    ordered = found.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("begin", "text"))).alias("spans"))
    rows = texts.join(ordered, "key", "left")
    texts_of = F.transform(F.coalesce("spans", F.array().cast("array<struct<begin:int,text:string>>")), lambda s: s["text"])
    whole = F.zip_with(F.split("masked", MARK, -1), texts_of, lambda kept, span: F.concat(kept, F.coalesce(span, F.lit(""))))
    return rows.select("key", F.array_join(whole, "").alias("text"))
