"""Token ids of whole texts from a public tokenizer file, with the work for a repeated word done once.

Both vocabularies merge only inside pre-tokens, so a text may be cut between pre-tokens and its parts
encoded one by one. Each worker process keeps the ids of the short parts it has met last, at most twice KEEP of
them and so about a hundred megabytes (of two halves the older goes when the newer is full; parts that are met
again move to the newer). Plain texts are cut by their bytes, many at once, and Arrow finds their distinct parts, so
that Python sees each only once. The library's model encodes the new words of a batch in one call, the library the rest.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa

KEEP, KEEP_CHARS = 300_000, 48
#: Characters of texts that are cut at once.
TOGETHER_CHARS = 1 << 21

#: The characters with Unicode's White_Space property.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
BLANKS = ("\t", "\x0b", "\x0c", "\r", " ", "\x85", "\xa0", "\u1680", *map(chr, range(0x2000, 0x200B)), "\u2028", "\u2029", "\u202f", "\u205f", "\u3000")
#: Where leading blanks belong to a token, a part may end only where a blank follows a non-blank.
BLANKS_KEPT = f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+"
#: Where blanks are dropped, parts may end at any of them.
BLANKS_DROPPED = ""
#: What keeps a text from being cut at each blank and line break: blanks of other kinds or side by side.
UNEVEN = ("  ", "\n\n", " \n", "\n ", *(b for b in BLANKS if b != " "))
#: How special tokens begin; a text that has it is cut at blanks alone.
SPECIAL = "<|"
LETTERS, SIGNS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff", r"!-/:-@\[-`{-~"
#: Words, ASCII signs and the rest of a text of even blanks; a part also ends where a sign follows a letter or digit, as a pre-token does.
PARTS = f"[{LETTERS}0-9]++(?![^ \n{SIGNS}])|[{SIGNS}]++(?![^ \n])|[^ \n]+?(?:(?<=[{LETTERS}0-9])(?=[{SIGNS}])|(?![^ \n]))"
#: A text with none of these has blanks, line breaks, digits, ASCII signs and Latin-1 letters only.
OTHER = re.compile(f"[^\n -~{LETTERS}]").search
#: Of such a text in UTF-8, the class of each byte, and before which class (second) a part begins after which (first).
BLANK, BREAK, SIGN, OF_WORDS = range(4)
CLASSES = np.full(256, OF_WORDS, np.uint8)
CLASSES[[c for c in range(128) if re.match(f"[{SIGNS}]", chr(c))]] = SIGN
CLASSES[[ord(" "), ord("\n")]] = BLANK, BREAK
BEGINS = np.zeros((4, 4), bool)
BEGINS[:, BLANK] = BEGINS[:, BREAK] = BEGINS[BREAK] = BEGINS[OF_WORDS, SIGN] = True
#: A word of Latin-1 letters: one pre-token, and no special token.
WORD = re.compile(f" ?[{LETTERS}]+").fullmatch
#: Words that the library's model encodes in one text.
TOGETHER = 1000
#: How byte-level vocabularies write bytes: printable ones as themselves, the others from U+0100 on, in order.
PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTES = np.arange(256, dtype="<u2")
BYTES[[b for b in range(256) if b not in PRINTABLE]] = np.arange(256, 512 - len(PRINTABLE))


def byte_level(text: str) -> str:
    return BYTES[np.frombuffer(text.encode(), np.uint8)].tobytes().decode("utf-16-le")


class Encoder:
    def __init__(self, path: str, parts: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import Split

        self.library = Tokenizer.from_file(path)
        self.dtype, self.code = ("<u2", "H") if self.library.get_vocab_size() <= 1 << 16 else ("<u4", "I")
        self.even_parts = re.compile(f" ?(?:{PARTS})|\n" if parts else PARTS).findall
        self.uneven_parts = re.compile(parts or "[^ \n]+").findall
        self.known: dict[str, bytes] = {}
        self.known_before: dict[str, bytes] = {}
        self.keeps_blanks = bool(parts)
        # The library's model on words that are pre-tokens, without the search for what they are; a line break ends each.
        self.words = Tokenizer(self.library.model)
        self.words.pre_tokenizer = Split(byte_level("\n"), "isolated")
        self.ends = self.words.encode(byte_level("\n"), add_special_tokens=False).ids
        some = ["The", "\u00c9t\u00e9s", "qqx", *[" the", " \u00dcber"] * self.keeps_blanks]
        self.direct = len(self.ends) == 1 and self.of_words(some) == self.of_others(some)

    def uneven(self, text: str) -> bool:
        return SPECIAL in text or (self.keeps_blanks and (text[-1:] in (" ", "\n") or any(x in text for x in UNEVEN)))

    def parts(self, text: str) -> list[str] | None:
        """The parts of a text; None for a plain one, which is cut by its bytes."""
        if self.uneven(text):
            return self.uneven_parts(text)
        return self.even_parts(text) if OTHER(text) else None

    def plain_parts(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """The parts of all texts, one after the other, and how many each has."""
        written = [(t if self.keeps_blanks else t.lower()).encode() for t in texts]
        data, bounds = b"".join(written), np.cumsum([0, *map(len, written)])
        classes = CLASSES[np.frombuffer(data, np.uint8)]
        begins = np.zeros(len(data) + 1, bool)
        begins[1:-1] = BEGINS[classes[:-1], classes[1:]]
        begins[bounds] = True
        offsets = np.flatnonzero(begins)
        parts = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(data))
        return parts, np.diff(np.searchsorted(offsets, bounds))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as an unsigned array."""
        found, at, size = [], 0, 0
        for i, text in enumerate(texts, 1):
            size += len(text)
            if size >= TOGETHER_CHARS or i == len(texts):
                found += self.encode_together(texts[at:i])
                at, size = i, 0
        return found

    def encode_together(self, texts: list[str]) -> list[np.ndarray]:
        cut = list(map(self.parts, texts))
        plain, counts = self.plain_parts([t for t, parts in zip(texts, cut) if parts is None])
        others = [parts for parts in cut if parts is not None]
        parts = pa.concat_arrays([plain, pa.array(chain.from_iterable(others), pa.large_string())]).dictionary_encode()
        ids = self.ids_of(parts.dictionary.to_numpy(zero_copy_only=False).tolist())
        sizes, flat = np.fromiter(map(len, ids), np.int64, len(ids)), np.frombuffer(b"".join(ids), self.dtype)
        sizes //= flat.itemsize
        which = parts.indices.to_numpy()
        # Where each part's ids lie in flat, moved to where they come in the texts.
        size, starts = sizes[which], (np.cumsum(sizes) - sizes)[which]
        ends = np.cumsum(size)
        found = flat[np.repeat(starts - ends + size, size) + np.arange(size.sum())]
        bounds = np.append(0, ends)[np.cumsum([0, *counts, *map(len, others)])]
        in_order = [i for i, parts in enumerate(cut) if parts is None] + [i for i, parts in enumerate(cut) if parts is not None]
        placed = dict(zip(in_order, (found[a:b] for a, b in zip(bounds, bounds[1:]))))
        return [placed[i] for i in range(len(texts))]

    def ids_of(self, parts: list[str]) -> list[bytes]:
        """The ids of distinct parts, from memory or the library."""
        if len(self.known) > KEEP:
            self.known_before, self.known = self.known, {}
        found = list(map(self.known.get, parts))
        unknown = [p for p, ids in zip(parts, found) if ids is None]
        new = dict(zip(unknown, map(self.known_before.get, unknown)))
        absent = [p for p, ids in new.items() if ids is None]
        words = list(filter(WORD, absent)) if self.direct else []
        rest = list(set(absent).difference(words))
        new.update(zip(words, self.of_words(words)))
        new.update(zip(rest, self.of_others(rest)))
        self.known.update((p, ids) for p, ids in new.items() if len(p) <= KEEP_CHARS)
        return [new[p] if ids is None else ids for p, ids in zip(parts, found)]

    def of_words(self, words: list[str]) -> list[bytes]:
        words = words if self.keeps_blanks else [w.lower().lstrip(" ") for w in words]
        texts = ["\n".join([*words[i : i + TOGETHER], ""]) for i in range(0, len(words), TOGETHER)]
        found = self.words.encode_batch_fast([byte_level(t) for t in texts], add_special_tokens=False)
        ids = np.array([i for x in found for i in x.ids], self.dtype)
        ends, raw = np.flatnonzero(ids == self.ends[0]) * ids.itemsize, ids.tobytes()
        return [raw[a:b] for a, b in zip([0, *(ends + ids.itemsize).tolist()], ends.tolist())]

    def of_others(self, parts: list[str]) -> list[bytes]:
        found = self.library.encode_batch_fast(parts, add_special_tokens=False)
        return [array(self.code, x.ids).tobytes() for x in found]


@lru_cache(maxsize=1)
def encoder(path: str, parts: str) -> Encoder:
    """One per worker process and vocabulary."""
    return Encoder(path, parts)


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
