"""Operator 2: SentencePiece encoding and decoding by a weighted finite-state transducer.

Three machines are compiled from a model file: a normaliser, whose arcs rewrite characters (a blank as U+2581)
and which puts one U+2581 before the text; the pieces, as a trie whose ends are arcs back to its root, each
with a piece's id and its weight, the negated score; and, for characters that no piece covers, arcs for their
bytes. Composed with an input, a state is a position and the machine's memory; weights add up along a path,
and of paths that meet in a state the one of least weight stays (the tropical semiring). The path of least
weight through the whole input gives the ids.

What the machine must remember depends on the model. Where weights alone decide, it is nothing. A model that
merges pairs in the order of its scores does not choose the path of least total weight (README); there the
memory is the last piece, and a piece has an arc after another only if merging the text of the two by itself
leaves just these two. Merging never crosses a boundary whose sides keep it in isolation, so the paths left
are the segmentations that merging leaves. Such arcs are compiled when two pieces first meet.

Composition is by parts that no piece can span (before a blank after a non-blank, at a line break, between
neighbours that no piece holds). Each worker keeps the paths of short parts in two generations of KEEP_BYTES: when
the younger is full it becomes the older, which goes; what is met again moves to the younger. Decoding runs the inverse: ids to
bytes, blanks back, first one off.

Defined results: a null or empty text has no ids; equal rows each keep theirs; very long texts are encoded
whole, part by part; an empty table gives no rows; other columns are ignored. Ids outside the vocabulary are
an error; control pieces decode to nothing.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import sliced

BLANK, END = "▁", ""
#: What a worker keeps: parts of so many characters at most, twice so many bytes of them, so many ends of parts, and so many pairs of pieces.
KEEP_CHARS, KEEP_BYTES, KEEP_ENDS, KEEP_PAIRS = 48, 160 << 20, 300_000, 500_000
ENTRY = 260  # bytes that Python takes for a kept part besides its characters and ids


class Merging:
    """Which pieces may be neighbours, in a model that merges pairs in the order of its scores."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.pairs: dict[tuple[str, str], bool] = {}

    def merged(self, text: str) -> list[str]:
        """What merging leaves of a short text: the best-scored neighbours first, leftmost of equals."""
        symbols = list(text)
        while len(symbols) > 1:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                score = self.scores.get(symbols[i] + symbols[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def may_follow(self, last: str, piece: str) -> bool:
        found = self.pairs.get((last, piece))
        if found is None:
            if len(self.pairs) > KEEP_PAIRS:
                self.pairs.clear()
            found = self.pairs[last, piece] = self.merged(last + piece) == [last, piece]
        return found


class Transducer:
    """pieces: id and weight by text; byte_arcs: id and weight by byte; follows: whether a piece has an arc after another, None if always.

    single: that follows leaves one path to each position, as merging does; further arcs there need no look.
    """

    def __init__(self, pieces: dict[str, tuple[int, float]], byte_arcs: dict[int, tuple[int, float]], follows: Callable[[str, str], bool] | None = None, single: bool = False):
        self.pieces, self.byte_arcs, self.follows, self.single = pieces, byte_arcs, follows, single
        self.normaliser = {" ": BLANK}
        #: A state of the trie holds the next states by character and, under END, the piece that ends there and its weight.
        self.trie: dict = {}
        for piece, (_, weight) in pieces.items():
            state = self.trie
            for c in piece:
                state = state.setdefault(c, {})
            state[END] = (piece, weight)
        self.held = {x[i : i + 2] for x in pieces for i in range(len(x) - 1)}
        most = max((i for i, _ in [*pieces.values(), *byte_arcs.values()]), default=0)
        self.dtype = "<u2" if most < 1 << 16 else "<u4"
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.kept_bytes = 0
        self.ends: dict[tuple[str, str], bytes | None] = {}
        self.coded: dict[str, bytes] = {}
        self.out = [b""] * (most + 1)
        for piece, (i, _) in pieces.items():
            self.out[i] = piece.replace(BLANK, " ").encode()
        for b, (i, _) in byte_arcs.items():
            self.out[i] = bytes([b])

    def normalised(self, text: str) -> str:
        for before, after in self.normaliser.items():  # one state, and the arcs don't meet
            text = text.replace(before, after)
        return BLANK + text if text else ""

    def bytes_of(self, character: str) -> tuple[str, float]:
        return character, sum(self.byte_arcs[b][1] for b in character.encode())

    def shortest(self, text: str) -> list[str]:
        """The pieces along the path of least weight; of equals, the one that begins with the longer arc.

        back[position][memory] is the least weight of a path to that state, where its last arc began and what
        the machine remembered there.
        """
        if self.single:
            return self.only_path(text)
        root, follows, n = self.trie, self.follows, len(text)

        def relax(here: dict, there: dict, piece: str, weight: float, at: int) -> None:
            for last, (cost, _, _) in here.items():
                if not last or not follows or follows(last, piece):
                    memory, total = piece if follows else "", cost + weight
                    if memory not in there or total < there[memory][0]:
                        there[memory] = (total, at, last)

        back: list[dict[str, tuple[float, int, str]]] = [{} for _ in range(n + 1)]
        back[0][""] = (0.0, -1, "")
        for at in range(n):
            if not (here := back[at]):
                continue
            state, i, covered = root, at, False
            while i < n and (state := state.get(text[i])) is not None:
                i += 1
                if END in state:
                    covered = covered or i == at + 1
                    relax(here, back[i], *state[END], at)
            if not covered:
                relax(here, back[at + 1], *self.bytes_of(text[at]), at)
        memory, at, found = min(back[n], key=lambda m: back[n][m][0]), n, []
        while at:
            _, before, last = back[at][memory]
            found.append(text[before:at])
            at, memory = before, last
        return found[::-1]

    def arcs(self, text: str, at: int) -> list[str]:
        """The pieces that begin at a place, the longest last."""
        state, i, n, found = self.trie, at, len(text), []
        while i < n:
            state = state.get(text[i])
            if state is None:
                break
            i += 1
            if END in state:
                found.append(state[END][0])
        if not found or len(found[0]) > 1:
            found.insert(0, text[at])  # by its bytes
        return found

    def only_path(self, text: str) -> list[str]:
        """The same where a position has one path at most, composed depth first: longer arcs first, and no position twice."""
        if text in self.pieces:
            return [text]  # merging leaves it whole, so no other path goes through
        follows, n, at, path = self.follows, len(text), 0, [""]
        met, ahead = {0}, [self.arcs(text, 0)]
        while at < n:
            arcs = ahead[-1]
            if not arcs:  # no path goes through here
                ahead.pop()
                at -= len(path.pop())
                continue
            piece = arcs.pop()
            to = at + len(piece)
            if to not in met and (not at or follows(path[-1], piece)):
                met.add(to)
                path.append(piece)
                at = to
                if at < n:
                    ahead.append(self.arcs(text, at))
        return path[1:]

    def ids_of(self, piece: str) -> list[int]:
        found = self.pieces.get(piece)
        return [self.byte_arcs[b][0] for b in piece.encode()] if found is None else [found[0]]

    def cuts(self, part: str) -> list[str]:
        """The part cut between neighbours that no piece holds; no piece spans such a cut."""
        held, found, start = self.held, [], 0
        for i in range(1, len(part)):
            if part[i - 1 : i + 1] not in held:
                found.append(part[start:i])
                start = i
        return [*found, part[start:]]

    def keep(self, part: str, ids: bytes) -> None:
        if len(part) <= KEEP_CHARS and part not in self.known:
            self.known[part] = ids
            self.kept_bytes += ENTRY + 2 * len(part) + len(ids)
            if self.kept_bytes > KEEP_BYTES:
                self.known, self.older, self.kept_bytes = {}, self.known, 0

    def kept(self, part: str) -> bytes | None:
        ids = self.known.get(part)
        if ids is None and (ids := self.older.get(part)) is not None:
            self.keep(part, ids)
        return ids

    def code(self, piece: str) -> bytes:
        found = self.coded.get(piece)
        if found is None:
            found = np.asarray(self.ids_of(piece), self.dtype).tobytes()
            if piece in self.pieces:
                self.coded[piece] = found
        return found

    def end(self, last: str, text: str) -> bytes | None:
        """The ids along the only path from the state (last piece) through a short rest of a part; None if there is none.

        Parts end alike more often than they are alike, so these are kept by state and rest.
        """
        key = last, text
        if key in self.ends:
            return self.ends[key]
        found, follows = None, self.follows
        for piece in reversed(self.arcs(text, 0)):
            if not last or follows(last, piece):
                rest = self.end(piece, text[len(piece) :]) if len(piece) < len(text) else b""
                if rest is not None:
                    found = self.code(piece) + rest
                    break
        if last:
            if len(self.ends) >= KEEP_ENDS:
                self.ends.clear()
            self.ends[key] = found
        return found

    def look_up(self, part: str) -> bytes:
        if (found := self.kept(part)) is not None:
            return found
        if self.single and len(part) <= KEEP_CHARS:
            found = self.code(part) if part in self.pieces else self.end("", part)
        else:
            found = b"".join(self.code(piece) for cut in self.cuts(part) for piece in self.shortest(cut))
        self.keep(part, found)
        return found

    #: Parts that no piece spans, as blanks begin pieces and line breaks are none's.
    parts = staticmethod(re.compile(f"{BLANK}*[^{BLANK}\n]+|{BLANK}+|\n+").findall)

    def encode(self, text: str) -> np.ndarray:
        words = self.parts(self.normalised(text))
        found = list(map(self.known.get, words))
        if None in found:
            for i, ids in enumerate(found):
                if ids is None:
                    found[i] = self.look_up(words[i])
        return np.frombuffer(b"".join(found), self.dtype)

    def decode(self, ids: np.ndarray) -> str:
        raw = b"".join(map(self.out.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return raw.removeprefix(" ")


@lru_cache(maxsize=1)
def transducer(path: str) -> Transducer:
    """Compiled from a model file that merges pairs; one per worker process and model."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    text = [model.id_to_piece(i) for i in range(size)]
    plain = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    byte_arcs = {int(text[i][3:5], 16): (i, -model.get_score(i)) for i in range(size) if model.is_byte(i)}
    if len(byte_arcs) != 256 or any(BLANK in text[i].lstrip(BLANK) or "\n" in text[i] for i in plain):
        raise ValueError("only models with byte fallback, whose pieces hold blanks at their start alone and no line break")
    if model.normalize("a  ﬁ Å") != f"{BLANK}a{BLANK}{BLANK}ﬁ{BLANK}Å":
        raise ValueError("only models that keep all characters and put a blank first")
    merging = Merging({text[i]: model.get_score(i) for i in plain})
    met = {text[i]: (i, -model.get_score(i)) for i in plain if merging.merged(text[i]) == [text[i]]}  # others are never met
    compiled = Transducer(met, byte_arcs, merging.may_follow, single=True)
    compiled.out += [b""] * (size - len(compiled.out))
    for i in plain:  # any id can be decoded
        compiled.out[i] = text[i].replace(BLANK, " ").encode()
    return compiled


def encoded(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, ids."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = transducer(model).encode
        for batch in sliced(batches):
            ids = pa.array([run(t or "").astype(np.int32) for t in batch.column("text").to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "ids": ids})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(encode, "doc_id long, ids array<int>")


def decoded(rows: DataFrame, model: str) -> DataFrame:
    """doc_id, text, from doc_id and ids."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = transducer(model).decode
        for batch in sliced(batches):
            lists = batch.column("ids").to_pylist()
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text": pa.array([run(np.array(x or [], np.int64)) for x in lists], pa.string())})

    return rows.select("doc_id", "ids").mapInArrow(decode, "doc_id long, text string")


def checked(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (ids as little-endian unsigned 32-bit integers), round_trip.

    Encodes and decodes in one pass, so that whole id lists and texts don't move twice. round_trip: decoding
    gives the text back, with any U+2581 in it as a blank.
    """
    import zlib

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = transducer(model)
        for batch in sliced(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            found = []
            for t in texts:
                ids = run.encode(t)
                found.append((len(ids), zlib.crc32(ids.astype("<u4").tobytes()), run.decode(ids) == t.replace(BLANK, " ")))
            columns = {k: pa.array([f[i] for f in found], kind) for i, (k, kind) in enumerate((("n_pieces", pa.int64()), ("ids_crc32", pa.int64()), ("round_trip", pa.bool_())))}
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id")} | columns)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(check, "doc_id long, n_pieces long, ids_crc32 long, round_trip boolean")
