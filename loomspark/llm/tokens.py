"""Token ids of whole texts, by the `tokenizers` library.

A byte-level BPE never merges across a pre-token.  A blank or newline after a non-space
character starts one, and so does punctuation after a letter or digit.  A text can be cut
there and each distinct piece encoded once by the library: the joined ids are those of the
whole text.  Words repeat, so most pieces are found in a memo of bounded size; texts are cut,
and pieces told apart, by Arrow's kernels, and ids are put together by array operations.
"""

from __future__ import annotations

import os
import re
from itertools import chain, repeat, takewhile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces kept by one Python worker; about 150 bytes each.
MEMO_PIECES = 400_000

_CUT = re.compile(r"(?<=\S)(?=[ \n])")
#: What starts a pre-token after a letter or digit, and is a piece of its own there.
_TAIL = ".,;:!?*$%&#|)]}\""
_IN_TAIL = np.isin(np.arange(256), list(_TAIL.encode()))
#: The letters by which byte-level vocabularies spell bytes: printable ones as they are,
#: the others by the code points from 256 on.
_PRINTABLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_LETTERS = np.array([b if b in _PRINTABLE else 256 + sum(x not in _PRINTABLE for x in range(b)) for b in range(256)], "<u4")
_encoders: dict[str, Encoder] = {}


def _letters(texts: list[str]) -> list[str]:
    """The texts as byte-level vocabularies spell them."""
    return [_LETTERS[np.frombuffer(t.encode(), np.uint8)].tobytes().decode("utf-32-le") for t in texts]


def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All ids one after the other, and how many each list has."""
    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum())), sizes


def _spans(flat: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Spans of an array, one after the other."""
    upto = np.cumsum(sizes)
    return flat[np.repeat(begins - upto + sizes, sizes) + np.arange(upto[-1] if len(upto) else 0)]


def _last_bytes(texts: pa.Array, among: np.ndarray) -> np.ndarray:
    """Whether each text's last byte is among these; False for empty ones."""
    sizes = pc.binary_length(texts).to_numpy()
    out = sizes > 0
    if out.any():
        ends = np.frombuffer(texts.buffers()[1], np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset + 1 : texts.offset + len(texts) + 1]
        out[out] = among[np.frombuffer(texts.buffers()[2], np.uint8)[ends[out] - 1]]
    return out


def _strings(texts: pa.Array) -> list[str]:
    return texts.to_numpy(zero_copy_only=False).tolist()  # an order faster than to_pylist


class Memo:
    """Slots of pieces in order of arrival, by two names (AFTER a blank, or WHOLE): each is a span
    of one array of ids, or hard where its piece can't be encoded by itself."""

    def __init__(self, most: int) -> None:
        self._most, self._n = most, 0
        self.named: tuple[dict[str, int], dict[str, int]] = {}, {}
        self._flat, self._ends, self._hard = np.zeros(1 << 16, np.uint32), np.zeros((1 << 14) + 1, np.int64), np.zeros(1 << 14, bool)

    def add(self, kind: int, pieces: list[str], ids: np.ndarray, sizes: np.ndarray, hard: bool = False) -> None:
        at, n, total = int(self._ends[self._n]), self._n + len(pieces), len(ids)
        while n > len(self._hard):
            self._ends, self._hard = np.concatenate([self._ends, np.zeros_like(self._hard, np.int64)]), np.concatenate([self._hard, np.zeros_like(self._hard)])
        while at + total > len(self._flat):
            self._flat = np.concatenate([self._flat, np.zeros_like(self._flat)])
        self._flat[at : at + total] = ids
        self._ends[self._n + 1 : n + 1] = at + np.cumsum(sizes)
        self._hard[self._n : n] = hard
        self.named[kind].update(zip(pieces, range(self._n, n), strict=True))
        self._n = n

    def bound(self) -> None:
        """Beyond the limit, the half met first stays: the frequent pieces are among them."""
        if self._n > self._most:
            n = self._n = self._most // 2
            self.named = tuple(dict(takewhile(lambda x: x[1] < n, d.items())) for d in self.named)

    def find(self, kind: int, pieces: list[str]) -> np.ndarray:
        """Slots, -1 where there is none."""
        return np.fromiter(map(self.named[kind].get, pieces, repeat(-1)), np.int64, len(pieces))

    def is_hard(self, slots: np.ndarray) -> np.ndarray:
        return self._hard[slots]

    def joined(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the slots in order, and how many each has."""
        begins = self._ends[slots]
        sizes = self._ends[slots + 1] - begins
        return _spans(self._flat, begins, sizes), sizes


AFTER, WHOLE = 0, 1
#: Words joined for the model.
JOINED = 64


class Encoder:
    """Encodes texts to unsigned 32-bit ids.  An empty or null text has none.

    The memo has pieces WHOLE, as they are, and by the word alone those AFTER a blank (or after
    a newline, if the word starts with one).  A word after which the next blank would not start
    a pre-token is hard there, and texts that hold one are cut by the slower pattern.
    """

    def __init__(self, path: str, memo_pieces: int = MEMO_PIECES) -> None:
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True  # their strings are ordinary text
        self._model = Tokenizer(self._tokenizer.model)  # it alone: texts are spelled by letters, and not cut
        vocabulary = self._model.get_vocab()
        self._spelled = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)  # letters of each id
        for token, i in vocabulary.items():
            self._spelled[i] = len(token)
        self._memo = Memo(memo_pieces)
        self._memo.add(WHOLE, [""], np.zeros(0, np.uint32), np.zeros(1, np.int64))
        self._nothing = 0  # the slot of the empty piece, the first one

    def _learn(self, kind: int, missing: list[str]) -> None:
        blank = " " if kind == AFTER else ""
        words = [p for p in missing if p.isalpha()]  # a single pre-token: the model alone will do
        others = [p for p in missing if not p.isalpha()]
        hard = [p for p in others if not p or p[-1].isspace()] if blank else []
        others = [p for p in others if p and not p[-1].isspace()] if blank else others
        self._memo.add(kind, hard, np.zeros(0, np.uint32), np.zeros(len(hard), np.int64), hard=True)
        for k in range(0, len(words), 20_000):
            some = words[k : k + 20_000]
            self._memo.add(kind, some, *self._words(blank, some))
        for k in range(0, len(others), 20_000):
            some = others[k : k + 20_000]
            self._memo.add(kind, some, *_flat(self._ids([w if w[:1] == "\n" else blank + w for w in some])))

    def _words(self, blank: str, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words of letters one after the other, and how many each has.

        Words after blanks are merged many at once.  What a word's merges are does not depend on
        its neighbours unless an id goes over a word's end, which the letters of the ids show; then,
        or where the model looks up whole words first, each is merged by itself."""
        if blank and not self._model.model.ignore_merges:
            ids, _ = _flat(self._merged([blank + blank.join(words[k : k + JOINED]) for k in range(0, len(words), JOINED)]))
            ends = np.cumsum(pc.binary_length(pa.array(words, pa.string())).to_numpy() + np.int64(len(blank)))
            upto = np.concatenate([[0], np.cumsum(self._spelled[ids])])
            at = upto.searchsorted(ends)
            if len(words) and upto[-1] == ends[-1] and (upto[at] == ends).all():
                return ids, np.diff(at, prepend=0)
        return _flat(self._merged([blank + w for w in words]))

    def _merged(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self._model.encode_batch_fast(_letters(texts), add_special_tokens=False)]

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _slots(self, kind: int, pieces: list[str]) -> np.ndarray:
        slots = self._memo.find(kind, pieces)
        if len(new := np.flatnonzero(slots < 0)):
            missing = [pieces[k] for k in new.tolist()]
            self._learn(kind, list(dict.fromkeys(missing)))
            slots[new] = self._memo.find(kind, missing)
        return slots

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and where each begins (one more at the end)."""
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        self._memo.bound()
        texts = texts.fill_null("")
        cut = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        first = cut.offsets.to_numpy().astype(np.int64)
        coded = cut.values.slice(first[0], first[-1] - first[0]).dictionary_encode()
        first, code = first - first[0], coded.indices.to_numpy().astype(np.int64)
        opening = np.zeros(len(code), bool)
        opening[first[:-1]] = True  # no blank comes before what opens a text
        used = np.zeros(len(coded.dictionary), bool)
        used[code[~opening]] = True
        table = np.full((len(used), 2), self._nothing)  # slots of a piece and of its tail
        table[used] = self._pairs(AFTER, coded.dictionary.filter(pa.array(used)))
        opens = coded.dictionary.take(pa.array(code[opening]))
        hard = self._memo.is_hard(table[:, 0])[code] & ~opening
        hard[opening] = np.fromiter((p[-1:].isspace() for p in _strings(opens)), bool, len(opens))
        code[opening] = len(table) + np.arange(len(opens))
        table = np.concatenate([table, self._pairs(WHOLE, opens)])
        if hard.any():
            code, first, table = self._recut(texts, code, first, table, np.add.reduceat(hard, first[:-1], dtype=np.int64) > 0)
        flat, sizes = self._memo.joined(table.ravel())  # once for each different piece, then by place
        sizes = sizes.reshape(-1, 2).sum(axis=1)
        counts = sizes[code]
        return _spans(flat, (np.cumsum(sizes) - sizes)[code], counts), np.concatenate([[0], np.cumsum(counts)])[first]

    def _pairs(self, kind: int, pieces: pa.Array) -> np.ndarray:
        """By piece, the slots of its stem and of the tail that may follow a letter or digit."""
        out = np.full((len(pieces), 2), self._nothing)
        some = np.flatnonzero(_last_bytes(pieces, _IN_TAIL))
        ending = pieces.take(pa.array(some))
        stems = pc.ascii_rtrim(ending, characters=_TAIL)
        letter = np.fromiter((e.isalnum() for e in _strings(pc.utf8_slice_codeunits(stems, -1))), bool, len(stems))
        sizes, at = pc.utf8_length(stems).to_numpy()[letter], some[letter]
        plain = np.ones(len(pieces), bool)
        plain[at] = False
        out[plain, 0] = self._slots(kind, _strings(pieces.filter(pa.array(plain))))
        out[at, 0] = self._slots(kind, _strings(stems.filter(pa.array(letter))))
        out[at, 1] = self._slots(WHOLE, [p[n:] for p, n in zip(_strings(ending.filter(pa.array(letter))), sizes.tolist(), strict=True)])
        return out

    def _recut(self, texts: pa.Array, code: np.ndarray, first: np.ndarray, table: np.ndarray, hard: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pieces of all texts by their rows of the table, which has more for those of hard texts,
        that are cut by the slower pattern."""
        parts, tables, n = np.split(code, first[1:-1]), [table], len(table)
        for k in np.flatnonzero(hard).tolist():
            slots = self._slots(WHOLE, [p for p in _CUT.split(texts[k].as_py()) if p])
            tables.append(np.column_stack([slots, np.full_like(slots, self._nothing)]))
            parts[k] = n + np.arange(len(slots))
            n += len(slots)
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])]), np.concatenate(tables)

    def encode_ended(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Like `encode`, with an end id after each text."""
        ids, first = self.encode(texts)
        return np.insert(ids, first[1:], end_id), first + np.arange(len(first))


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file, made once."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has a task on each core
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
