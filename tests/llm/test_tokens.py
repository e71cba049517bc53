"""Operators 2, 4 and 6: exact against the libraries and by round trip."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.cases import ROWS, clashing, collected, documents
from tidemark.llm import id_codec, id_files, packing, pieces, tokens
from tidemark.llm.common import new_path
from tidemark.llm.queries import QUERIES
from tidemark.llm.tokens import BLANKS_DROPPED, BLANKS_KEPT, encoder, vocabulary

ODD = [" ", "  ", "\n", "a", "The", " t", "é", "☃", "ing", "10", "\t", "..", ".", "'s", "日本", "ﬁ", "\xa0", "\x1c", " ", "\x85", "é", ",", "<|endoftext|>", "Σ", "İ", "क़", "\r\n", "▁", "\x00", "𝒳"]


def texts(n, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(ODD) for _ in range(rnd.randint(0, 12))) for _ in range(n)]


@pytest.mark.parametrize("name, parts", [("byte_bpe_50k.json", BLANKS_KEPT), ("word_bpe_49k.json", BLANKS_DROPPED)])
def test_ids_are_the_library_s(name, parts):
    from tokenizers import Tokenizer

    library, ours = Tokenizer.from_file(vocabulary(name)), encoder(vocabulary(name), parts)
    some = texts(4000, 1)
    for _ in range(2):  # from the library, then from memory
        for text, ids in zip(some, ours.encode(some)):
            assert library.encode(text, add_special_tokens=False).ids == ids.tolist(), repr(text)


PLAIN = [" ", " ", " ", "\n", "a", "The", "\u00c9t\u00e9", "\xff", "10", ".", ",", "!!", "'", "'s", "'S", "'ll", "(", "-", "zz", "|", "\x85", "\u2019"]
VOCABULARIES = pytest.mark.parametrize("name, parts", [("byte_bpe_50k.json", BLANKS_KEPT), ("word_bpe_49k.json", BLANKS_DROPPED)])


@VOCABULARIES
def test_plain_and_odd_texts_together_with_a_full_memory(name, parts, monkeypatch):
    monkeypatch.setattr(tokens, "KEEP", 100)
    monkeypatch.setattr(tokens, "TOGETHER_CHARS", 500)
    rnd, ours = random.Random(3), tokens.Encoder(vocabulary(name), parts)
    some = ["".join(rnd.choice(PLAIN[: rnd.choice((20, 22))]) for _ in range(rnd.randint(0, 14))) for _ in range(4000)]
    for text, ids in zip(some, ours.encode(some)):
        assert ours.library.encode(text, add_special_tokens=False).ids == ids.tolist(), repr(text)
    assert len(ours.known) + len(ours.known_before) < 1000
    assert [len(x) for x in ours.encode([])] == [] and [len(x) for x in ours.encode(["", ""])] == [0, 0]


@VOCABULARIES
def test_a_word_is_encoded_once_whatever_signs_follow(name, parts, monkeypatch):
    monkeypatch.setattr(tokens, "KEEP", 10)
    ours = tokens.Encoder(vocabulary(name), parts)
    ours.encode(["x thtion. thtion, thtion!! thtion\nx thtion"])
    assert sum("thtion" in part for part in ours.known) == 1
    for i in range(3):  # a word that comes again stays, though the memory was full
        ours.encode(["x thtion " + " ".join("abcdefghijkl"[i:] + x for x in "abcdefghijkl")])
        assert "x" in ours.known and " thtion" in ours.known and len(ours.known) + len(ours.known_before) < 40


def test_capital_and_small_letters_share_a_part_where_case_is_dropped():
    ours = tokens.Encoder(vocabulary("word_bpe_49k.json"), BLANKS_DROPPED)
    ids = ours.encode(["x Thtion thtion. THTION \u00c9t \u00e9t"])[0]
    assert ours.library.encode("x thtion thtion. thtion \u00e9t \u00e9t", add_special_tokens=False).ids == ids.tolist()
    assert sum("thtion" in part.lower() for part in ours.known) == 1 and sum("t" in part.lower() for part in ours.known) == 2


def test_pieces_are_the_library_s():
    from sentencepiece import SentencePieceProcessor

    path = vocabulary("piece_bpe_32k.model")
    library, ours = SentencePieceProcessor(model_file=path), pieces.transducer(path)
    for text in [*texts(4000, 2), *(t for _, t, *_ in ROWS if t)]:
        ids = ours.encode(text)
        assert ids.tolist() == library.encode(text), repr(text)
        assert ours.decode(ids) == library.decode(ids.tolist()), repr(text)


#: A toy model where weights decide: two pieces of "ab" are cheaper than the longest one, and é has bytes alone.
TOY = {"▁": 1.0, "a": 3.0, "b": 3.0, "ab": 5.0, "▁a": 1.5, "▁ab": 9.0, "bb": 2.0, "abb": 4.5}


def plain_shortest(text, pieces, byte_weight):
    """Least weight over all segmentations."""
    best = {"": (0.0, [])}
    for end in range(1, len(text) + 1):
        for start in range(end):
            piece, before = text[start:end], best.get(text[:start])
            weight = pieces.get(piece, byte_weight * len(piece.encode()) if end - start == 1 else None)
            if before and weight is not None and (text[:end] not in best or before[0] + weight < best[text[:end]][0] - 1e-9):
                best[text[:end]] = (before[0] + weight, [*before[1], piece])
    return best[text]


@settings(max_examples=200, deadline=None)
@given(st.text("ab é", max_size=9))
def test_the_path_of_least_weight_is_taken(text):
    machine = pieces.Transducer({p: (256 + i, w) for i, (p, w) in enumerate(TOY.items())}, {b: (b, 2.5) for b in range(256)})
    found = machine.shortest(machine.normalised(text))
    weight = sum(TOY[p] if p in TOY else 2.5 * len(p.encode()) for p in found)
    assert weight == pytest.approx(plain_shortest(machine.normalised(text), TOY, 2.5)[0]) and "".join(found) == machine.normalised(text)
    assert machine.decode(machine.encode(text)) == text


def test_weights_decide_and_memory_forbids():
    ids = {p: (256 + i, w) for i, (p, w) in enumerate(TOY.items())}
    free = pieces.Transducer(ids, {})
    assert free.shortest("▁abb") == ["▁a", "bb"]  # 3.5, where ▁ and abb weigh 5.5
    bound = pieces.Transducer(ids, {}, lambda last, piece: (last, piece) != ("▁a", "bb"))
    assert bound.shortest("▁abb") == ["▁", "abb"]
    fixed = pieces.Transducer({p: (i, 0.0) for p, (i, _) in ids.items()}, {})
    assert free.shortest("abb") == ["abb"] and len(fixed.shortest("abb")) <= 3


def test_op2_by_the_library(spark, small):
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    want = []
    for r in spark.read.parquet(f"{small}/documents.parquet").collect():
        ids = library.encode(r["text"] or "")
        want.append((r["doc_id"], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), True))
    assert collected(QUERIES["op2_pieces"](spark, small), "doc_id", "n_pieces", "ids_crc32", "round_trip") == sorted(want, key=repr)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=300))
def test_codec_round_trip(ids):
    ids = np.array(ids, "<u4")
    assert (id_codec.decode(*id_codec.encode(ids), len(ids)) == ids).all()


def test_codec_is_short_for_frequent_ids():
    ids = np.array([40_000] * 1000 + list(range(300)), "<u2")
    table, control, data = id_codec.encode(ids)
    assert np.frombuffer(table, "<u4")[0] == 40_000
    assert len(control) == 325 and len(data) == 1000 + 255 + 2 * (len(table) // 4 - 256)  # ranks to 255 take a byte


def by_brute_force(rows, name, end):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary(name))
    return [(d, library.encode(t or "", add_special_tokens=False).ids + [end]) for d, t, *_ in rows]


def test_id_files(spark, monkeypatch):
    monkeypatch.setattr(id_files, "BLOCK_IDS", 500)
    path = new_path(spark, "ids")
    id_files.write_ids(clashing(documents(spark)), path, vocabulary("byte_bpe_50k.json"), BLANKS_KEPT, 2)
    got = sorted(((r["start"], r["doc_id"], r["ids"]) for r in id_files.read_ids(spark, path).collect()), key=lambda r: r[0])
    assert sorted(((d, i) for _, d, i in got), key=repr) == sorted(by_brute_force(ROWS, "byte_bpe_50k.json", 2), key=repr)
    assert [d for _, d, _ in got] == sorted((r[0] for r in ROWS), key=lambda d: (d is not None, d))
    at = 0
    for start, _, ids in got:
        assert start == at
        at += len(ids)


def test_id_files_of_nothing(spark):
    path = new_path(spark, "ids")
    id_files.write_ids(documents(spark, []), path, vocabulary("byte_bpe_50k.json"), BLANKS_KEPT, 2)
    assert id_files.read_ids(spark, path).count() == 0


def test_op4(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").collect()
    at, want = 0, []
    for d, ids in by_brute_force([(r["doc_id"], r["text"]) for r in docs], "byte_bpe_50k.json", 2):
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert collected(QUERIES["op4_token_ids"](spark, small), "doc_id", "start", "n_tokens", "ids_crc32") == sorted(want, key=repr)


def plain_best_fit(lengths, capacity):
    room, out = [], []
    for n in lengths:
        fits = [(r, i) for i, r in enumerate(room) if r >= n]
        if not fits:
            room.append(capacity)
            fits = [(capacity, len(room) - 1)]
        tightest = min(r for r, _ in fits)
        out.append(tightest)
        room[next(i for r, i in fits if r == tightest)] -= n
    return out, sorted(room)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120), st.sampled_from([40, 64]))
def test_best_fit_decreasing(lengths, capacity):
    lengths = np.array(sorted(lengths, reverse=True), np.int64)
    windows, offsets = packing.best_fit_decreasing(lengths, capacity)
    room, seen = [], {}
    for n, w, o in zip(lengths, windows, offsets):
        assert seen.get(w, 0) == o
        room.append(capacity - seen.get(w, 0))
        seen[w] = o + n
    assert (room, sorted(capacity - x for x in seen.values())) == plain_best_fit(lengths.tolist(), capacity)


def test_packing(spark):
    cut = packing.pieces(clashing(documents(spark)), vocabulary("word_bpe_49k.json"), BLANKS_DROPPED, 1, 256)
    packed = packing.pack(cut, 256, group=50)
    rows = packed.collect()
    whole = {}
    for r in rows:
        whole.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert len(r["ids"]) == r["length"]
    for parts in whole.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    once = {}
    for r in rows:
        if r["doc_id"] not in (1, None):
            once.setdefault(r["doc_id"], []).append((r["start"], r["ids"]))
    want = dict(by_brute_force([r for r in ROWS if r[0] not in (1, None)], "word_bpe_49k.json", 1))
    assert {d: [i for _, ids in sorted(p) for i in ids] for d, p in once.items()} == want
    made = packing.sequences(packed).collect()
    assert sum(len(r["ids"]) for r in made) == sum(r["length"] for r in rows) and len(made) == len(whole)


def test_packing_of_nothing(spark):
    cut = packing.pieces(documents(spark, []), vocabulary("word_bpe_49k.json"), BLANKS_DROPPED, 1, 256)
    assert packing.pack(cut, 256).count() == 0


def test_op6_by_brute_force(spark, small):
    """Every piece's ids, its document's and its place."""
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    ids = dict(by_brute_force(docs, "word_bpe_49k.json", 1))
    rows = QUERIES["op6_packing"](spark, small).collect()
    covered, places = {}, {}
    for r in rows:
        piece = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert (len(piece), zlib.crc32(np.array(piece, "<u4").tobytes()), len(ids[r["doc_id"]])) == (r["length"], r["ids_crc32"], r["doc_tokens"])
        covered.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans, total in [(covered[d], len(x)) for d, x in ids.items()] + [(p, None) for p in places.values()]:
        at = 0
        for start, length in sorted(spans):
            assert start == at
            at += length
        assert at == total if total is not None else at <= 2048


def test_packing_keeps_columns_of_any_name(spark):
    cut = packing.pieces(documents(spark), vocabulary("word_bpe_49k.json"), BLANKS_DROPPED, 1, 256)
    odd = cut.selectExpr("*", "'a' as _row", "'b' as _group", "'c' as sequence_id", "'d' as offset", "'e' as __group")
    packed = packing.pack(odd, 256)
    assert sorted(packed.columns) == sorted({*odd.columns})
    rows = packed.collect()
    assert {(r["_row"], r["_group"], r["__group"]) for r in rows} == {("a", "b", "e")} and all(r["offset"] != "d" for r in rows)


def test_op6_pads_little(spark, small):
    rows = QUERIES["op6_packing"](spark, small).groupBy("sequence_id").sum("length").toPandas()["sum(length)"]
    assert rows.max() <= 2048 and rows.sum() > 0.95 * 2048 * (len(rows) - 1)


def test_pieces_of_awkward_documents(spark):
    path = vocabulary("piece_bpe_32k.model")
    ids = pieces.encoded(clashing(documents(spark)), path)
    assert ids.count() == len(ROWS) and pieces.encoded(documents(spark, []), path).count() == 0
    back = pieces.decoded(ids, path)
    assert collected(back, "doc_id", "text") == sorted(((d, (t or "").replace("▁", " ")) for d, t, *_ in ROWS), key=repr)
    assert all(r["round_trip"] for r in pieces.checked(documents(spark), path).collect())
