"""Operator 13: conversation structure repair by rank-convergence parallel Viterbi.

A conversation's rows, by turn, become one whose role initials read `(s?(ua)+)?` at the least cost: rows are kept
(0), given another role (1) or deleted (2, as blank rows and repetitions must be), messages are inserted (5), and a
row that stays truncated costs 5 more. The states are what may come next: at the beginning, after s, after u and
after a. The cost to go from a place is a vector of four numbers.

Rows without text, sorted by conversation and turn over all tasks, are cut into chunks of at most CHUNK rows that
aren't deleted anyhow; so a chunk never waits for a long run of those. Each chunk is run backwards from a
speculative vector, that of a conversation's end, which is true for conversations within one chunk. Where a longer
one's chunk began from another vector than its right neighbour ends with, fix-up passes run it again, until a
vector differs from the stored one by a constant only; there the rest stands. A pass goes through runs of
neighbouring chunks, each RUN times as long as before, as a stream; so passes are few even where vectors never
converge. The constants that vectors left out add up to costs, and each chunk traces its edits forward by the
stored vectors, preferring what sorts first. A chunk inside a longer conversation traces from each of the four
states; the state that the chunk before ends in chooses.

A conversation's audit is one value of the result and its digest runs over its whole text in order, so these alone
stream through one task for each conversation, holding its audit but none of its texts.

Defined results: a null conv_id is a conversation of its own; null turns come first; rows of one turn go by role,
then by the SHA-256 of their texts, equal ones side by side; a null role or text is one space; an empty role has no
initial; equal texts are those of equal SHA-256; very long texts are hashed whole; conversations that the input
names but that have no rows get zeros, an empty audit and the digest of the empty text; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.llm.common import staged

CHUNK, RUN = 4096, 8
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
BLANKS = " \t\n\x0b\f\r"

#: States: 0 the beginning, 1 after s, 2 after u, 3 after a; to which a message of the one fitting role leads.
NEXT = (2, 2, 3, 2)
ROLE = ("user", "user", "assistant", "user")
INITIALS = {"s": 1, "u": 2, "a": 3}
#: By state and initial, where a kept row leads.
KEEP = {(0, 1): 1, (0, 2): 2, (1, 2): 2, (3, 2): 2, (2, 3): 3}
LEGAL = frozenset(("su", "ua", "au"))

Vector = tuple[int, int, int, int]
#: The costs to go at a conversation's end.
END: Vector = (0, 2 * INSERT, INSERT, 0)


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: rows as crc32 of `conv_id:turn` damages them; dropped ones have no copies."""
    named = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    code = F.crc32(named.cast("binary")) % 20
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("text", "role"))
    return conversations.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.when(code == 4, "user").otherwise(role).alias("role"),
        F.when(code == 1, "").when(code == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(code == 0, 0).when(code == 3, 2).otherwise(1).alias("copies"),
    )


def usable(rows: DataFrame) -> DataFrame:
    """With a digest of each text, and without nulls in roles and texts; one copy of each row unless copies says how many."""
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("text", "role"))
    copies = F.col("copies") if "copies" in rows.columns else F.lit(1)
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("digest"), copies.cast("long").alias("copies"))


def judged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, digest, n, blank, truncated, new: equal rows as one, and whether a turn is the first to say a thing."""
    core = F.rtrim("text", F.lit(BLANKS))
    light = rows.select("conv_id", "turn", "role", "digest", "copies", (core == "").alias("blank"), (~F.right(core, F.lit(1)).isin(".", "!", "?")).alias("truncated"))
    light = light.groupBy("conv_id", "turn", "role", "digest").agg(F.sum("copies").alias("n"), F.max("blank").alias("blank"), F.max("truncated").alias("truncated"))
    order = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    firsts = light.where("n > 0").groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(F.min(order).alias("first"))
    same = light["conv_id"].eqNullSafe(firsts["c"]) & (light["role"] == firsts["r"]) & (light["digest"] == firsts["d"])
    new = F.coalesce(F.col("first") == order, F.lit(False)) | (F.col("first.turn").isNull() & F.col("turn").isNull() & F.col("first").isNotNull())
    return light.join(firsts, same, "left").select(*light.columns, new.alias("new"))


@lru_cache(None)
def costs(v: Vector, symbol: int) -> Vector:
    """The costs to go before a row, given those after it. symbol: its initial's number, and 4 more if it is truncated."""
    more, r = TRUNCATED * (symbol >> 2), []
    for q in range(4):
        kept = KEEP.get((q, symbol & 3))
        r.append(min(DELETE + v[q], REROLE + more + v[NEXT[q]], *(() if kept is None else (more + v[kept],))))
    u, a = min(r[2], INSERT + r[3]), min(r[3], INSERT + r[2])
    return min(r[0], INSERT + u), min(r[1], INSERT + u), u, a


@lru_cache(None)
def before(v: Vector, symbol: int) -> tuple[Vector, int]:
    """The vector before a row without its constant, and the constant."""
    found = costs(v, symbol)
    low = min(found)
    return tuple(x - low for x in found), low


@lru_cache(None)
def edit(v: Vector, symbol: int, state: int) -> tuple[str, int]:
    """A row's edit after what is inserted before it, the cheapest that sort first, and the state behind it."""
    found, more = costs(v, symbol), TRUNCATED * (symbol >> 2)
    if DELETE + v[state] == found[state]:
        return "D", state
    if INSERT + found[NEXT[state]] == found[state]:
        rest, after = edit(v, symbol, NEXT[state])
        return "I" + rest, after
    kept = KEEP.get((state, symbol & 3))
    if kept is not None and more + v[kept] == found[state]:
        return "K", kept
    return "R", NEXT[state]


def ending(state: int) -> str:
    return ("", "II", "I", "")[state]


def backward(symbols: bytes, right: Vector, stored: bytes | None = None) -> tuple[bytes, Vector]:
    """Five bytes a row, its vector and constant, and the first row's vector.

    From where a vector is the stored one, stored stands.
    """
    out, v = bytearray(stored or 5 * len(symbols)), right
    for t in range(len(symbols) - 1, -1, -1):
        v, low = before(v, symbols[t])
        out[5 * t + 4] = low
        if stored and bytes(v) == stored[5 * t : 5 * t + 4]:
            return bytes(out), tuple(out[:4])
        out[5 * t : 5 * t + 4] = v
    return bytes(out), v


def forward(symbols: bytes, vectors: bytes, right: Vector, forced: list[int], tail: int, state: int) -> tuple[str, int]:
    """A chunk's edits from a state on, and the state behind it. forced: how many rows before each one must go."""
    out, last = [], len(symbols) - 1
    for t, symbol in enumerate(symbols):
        if forced[t]:
            out.append("D" * forced[t])
        letters, state = edit(right if t == last else tuple(vectors[5 * t + 5 : 5 * t + 9]), symbol, state)
        out.append(letters)
    return "".join(out) + "D" * tail, state


LONGS = ("seq", "first_turn", "last_turn", "least_turn", "most_turn", "turns", "n", "blank", "duplicate", "truncated", "illegal", "tail")
KNOWN = "part int, " + ", ".join(f"{c} long" for c in LONGS) + ", first_initial string, last_initial string, edge boolean, left binary"
CHUNKS = KNOWN + ", forced array<long>, symbols binary, right binary, vectors binary"
TRACED = KNOWN + ", base long, audits array<string>, ends array<int>"
REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
MESSAGE = "position long, role string, text string, turn long, edit string"


def schema_of(rows: DataFrame, rest: str) -> T.StructType:
    return T.StructType([rows.schema["conv_id"], *T.StructType.fromDDL(rest).fields])


def records(rows: Iterator[dict], schema: T.StructType, size: int = 512) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    types = {f.name: to_arrow_type(f.dataType) for f in schema}

    def out() -> pa.RecordBatch:
        return pa.record_batch([pa.array([r[c] for r in held], t) for c, t in types.items()], list(types))

    for row in rows:
        held.append(row)
        if len(held) == size:
            yield out()
            held = []
    if held:
        yield out()


def rows_of(batches: Iterator[pa.RecordBatch], size: int = 256) -> Iterator[dict]:
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield from batch.slice(at, size).to_pylist()


class Chunk:
    """What is known of neighbouring rows of one conversation."""

    def __init__(self, conv_id: object, part: int, seq: int) -> None:
        self.row = {"conv_id": conv_id, "part": part, "seq": seq, "first_initial": None, "last_initial": None} | dict.fromkeys(LONGS[1:5]) | dict.fromkeys(LONGS[5:], 0)
        self.forced: list[int] = []
        self.symbols = bytearray()

    def add(self, r: dict) -> None:
        """n equal rows; the first is no repetition if it is new."""
        row, n, turn, initial = self.row, r["n"], r["turn"], r["role"][:1]
        if not n:
            return
        if not row["n"]:
            row["first_turn"], row["first_initial"] = turn, initial
            row["turns"] += turn is not None
        else:
            row["turns"] += turn is not None and turn != row["last_turn"]
            row["illegal"] += row["last_initial"] + initial not in LEGAL
        if turn is not None:
            row["least_turn"] = turn if row["least_turn"] is None else row["least_turn"]
            row["most_turn"] = turn
        row["last_turn"], row["last_initial"] = turn, initial
        row["n"] += n
        row["illegal"] += n - 1  # equal initials
        if r["blank"]:
            row["blank"] += n
        elif not r["new"]:
            row["duplicate"] += n
        else:
            row["truncated"] += r["truncated"]
            row["duplicate"] += n - 1
            self.forced.append(row["tail"])
            self.symbols.append(INITIALS.get(initial, 0) + 4 * r["truncated"])
            row["tail"], n = 0, n - 1
        row["tail"] += n

    def closed(self, edge: bool) -> dict:
        vectors, left = backward(bytes(self.symbols), END)
        return self.row | {"edge": edge, "forced": self.forced, "symbols": bytes(self.symbols), "right": bytes(END), "vectors": vectors, "left": bytes(left)}


def chunked(rows: DataFrame) -> DataFrame:
    """Chunks by conversation, in order of part and seq; edge: others of the conversation may be elsewhere."""
    schema, order = schema_of(rows, CHUNKS), ("conv_id", "turn", "role", "digest")

    def cut(rows: Iterator[dict]) -> Iterator[dict]:
        part, seq, chunk, edge = TaskContext.get().partitionId(), 0, None, True  # the first one's conversation may begin elsewhere
        for r in rows:
            if chunk:
                same = r["conv_id"] == chunk.row["conv_id"]
                if not same or len(chunk.symbols) >= CHUNK:
                    yield chunk.closed(edge or same)
                    chunk, seq, edge = None, seq + 1, same
            chunk = chunk or Chunk(r["conv_id"], part, seq)
            chunk.add(r)
        if chunk:
            yield chunk.closed(True)

    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return placed.mapInArrow(lambda batches: records(cut(rows_of(batches)), schema), schema)


def fixed(placed: DataFrame, run: int) -> DataFrame:
    """One fix-up pass, from right to left through runs of so many chunks. placed: chunks, their place from the right and what their right neighbour ends with."""
    schema = schema_of(placed, CHUNKS)

    def fix(rows: Iterator[dict]) -> Iterator[dict]:
        last = {}
        for r in rows:
            same = last and r["conv_id"] == last["conv_id"] and r["run"] == last["run"]
            right = last["left"] if same else r["neighbour"]
            if right != r["right"]:
                vectors, left = backward(r["symbols"], tuple(right), r["vectors"])
                r |= {"right": right, "vectors": vectors, "left": bytes(left)}
            yield r
            last = r

    runs = placed.withColumn("run", F.floor(F.col("place") / run))
    runs = runs.repartition("conv_id", "run").sortWithinPartitions("conv_id", "run", "place")
    return runs.mapInArrow(lambda batches: records(fix(rows_of(batches)), schema), schema)


def passes(edges: DataFrame) -> Iterator[DataFrame]:
    """Chunks of longer conversations after each pass, until every one has begun from what its right neighbour ends with."""
    from_right = Window.partitionBy("conv_id").orderBy(F.desc("part"), F.desc("seq"))
    run = 1
    while True:
        yield edges
        neighbour = F.coalesce(F.lag("left").over(from_right), F.lit(bytearray(END)))
        placed = edges.withColumns({"place": F.row_number().over(from_right) - 1, "neighbour": neighbour})
        if placed.where(F.col("right") != F.col("neighbour")).isEmpty():
            return
        edges, run = staged(fixed(placed, run), "fixed"), run * RUN


def traced(chunks: DataFrame) -> DataFrame:
    """Each chunk's edits, and the states behind them, by the state before it; only the first where nothing is before it."""
    schema = schema_of(chunks, TRACED)

    def trace(rows: Iterator[dict]) -> Iterator[dict]:
        for r in rows:
            found = [forward(r["symbols"], r["vectors"], tuple(r["right"]), r["forced"], r["tail"], q) for q in range(4 if r["edge"] else 1)]
            yield r | {"base": sum(r["vectors"][4::5]), "audits": [a for a, _ in found], "ends": [q for _, q in found], "left": r["left"] if r["symbols"] else None}

    return chunks.mapInArrow(lambda batches: records(trace(rows_of(batches)), schema), schema)


class Conversation:
    """Puts a conversation's chunks together, then walks through its messages."""

    def __init__(self, conv_id: object) -> None:
        self.conv_id, self.chunks, self.state = conv_id, [], 0
        self.parts: list[str] = []
        self.audit, self.at, self.walked, self.position = "", 0, 0, 0
        self.digest = hashlib.sha256()

    def add(self, chunk: dict) -> None:
        self.parts.append(chunk["audits"][self.state])
        self.state = chunk["ends"][self.state]
        self.chunks.append({c: v for c, v in chunk.items() if c != "audits"})

    def begin(self) -> None:
        self.audit, self.parts = "".join(self.parts) + ending(self.state), []

    def message(self, role: str, text: str, turn: int | None, edit: str) -> dict:
        self.digest.update(("\n" * (self.position > 0) + f"{role}:{text}").encode())
        self.position += 1
        return {"conv_id": self.conv_id, "position": self.position, "role": role, "text": text, "turn": turn, "edit": edit}

    def inserted(self) -> Iterator[dict]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield self.message(ROLE[self.walked], "", None, "I")
            self.walked = NEXT[self.walked]

    def walk(self, r: dict) -> Iterator[dict]:
        for _ in range(r["copies"]):
            yield from self.inserted()
            letter = self.audit[self.at]
            self.at += 1
            if letter != "D":
                role = r["role"] if letter == "K" else ROLE[self.walked]
                self.walked = KEEP[self.walked, INITIALS[role[:1]]]
                yield self.message(role, r["text"], r["turn"], letter)

    def report(self) -> dict:
        full = [c for c in self.chunks if c["n"]]
        sums = {k: sum(c[k] for c in full) for k in ("turns", "blank", "duplicate", "truncated", "illegal", "base")}
        for one, two in zip(full, full[1:]):
            sums["turns"] -= one["last_turn"] is not None and one["last_turn"] == two["first_turn"]
            sums["illegal"] += one["last_initial"] + two["first_initial"] not in LEGAL
        least, most = [c["least_turn"] for c in full if c["turns"]], [c["most_turn"] for c in full if c["turns"]]
        lefts = [c["left"] for c in full if c["left"]]
        return {
            "conv_id": self.conv_id, "gaps": max(most) - min(least) + 1 - sums["turns"] if most else 0, **{k: sums[k] for k in ("blank", "duplicate", "truncated", "illegal")},
            "cost": sums["base"] + (lefts[0][0] if lefts else 0) + DELETE * (sums["blank"] + sums["duplicate"]), "audit": self.audit, "repaired_sha256": self.digest.hexdigest(),
        }


def assembled(chunks: DataFrame, rows: DataFrame, messages: bool) -> DataFrame:
    """Each conversation's repaired messages, or its report."""
    schema = schema_of(rows, MESSAGE if messages else REPORT)

    def put_together(rows: Iterator[dict]) -> Iterator[dict]:
        now = None

        def end() -> Iterator[dict]:
            if not now.audit:
                now.begin()
            left = list(now.inserted())
            yield from left if messages else [now.report()]

        for r in rows:
            if now is None or r["conv_id"] != now.conv_id:
                if now:
                    yield from end()
                now = Conversation(r["conv_id"])
            if r["text"] is None:
                now.add(r)
            else:
                if not now.audit:
                    now.begin()
                for m in now.walk(r):
                    if messages:
                        yield m
        if now:
            yield from end()

    texts = rows.where("copies > 0").select("conv_id", "turn", "role", "digest", "copies", "text")
    both = chunks.unionByName(texts, allowMissingColumns=True)
    both = both.repartition("conv_id").sortWithinPartitions("conv_id", F.col("text").isNotNull(), "part", "seq", "turn", "role", "digest")
    return both.drop("digest").mapInArrow(lambda batches: records(put_together(rows_of(batches)), schema), schema)


def prepared(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Traced chunks, and the rows."""
    rows = usable(conversations)
    chunks = staged(chunked(judged(rows)), "chunks")
    longer = F.col("edge") & (F.length("symbols") > 0)
    for edges in passes(chunks.where(longer)):  # noqa: B007
        pass
    return traced(chunks.where(~longer).unionByName(edges)), rows


def repaired(conversations: DataFrame) -> DataFrame:
    """conv_id, position, role, text, turn, edit (Kept, Reroled or Inserted): the messages that stand, in order."""
    return assembled(*prepared(conversations), messages=True)


def audited(conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    return assembled(*prepared(conversations), messages=False)
