"""Token ids of whole texts, by the tokenizers library, with a memory of frequent stretches.

Both vocabularies cut a text into pieces before they merge anything, and no merge crosses a piece.  So a text is cut
at places that are always piece borders, each different stretch is encoded once per worker, and ids are gathered from
that memory.  A stretch of plain Latin letters, digits and ASCII marks is cut into its pieces here and goes straight
to the library's merge model; any other stretch, and a text whose cut could differ from the tokenizer's own, is
encoded by the whole tokenizer.

Many texts are encoded at once: Arrow finds their distinct words.  Where white space counts, those that are not
remembered go joined through the whole tokenizer, each once; where it does not, they are cut into pieces together, and
each different piece that is not remembered goes through the merge model once.
"""

from __future__ import annotations

import os
import re
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import claim_memory

#: Stretches, and pieces, that a Python worker remembers: the first ones, among them the frequent ones.  Later ones are
#: encoded whenever they occur.
KEPT = 500_000

#: Words that go joined through the tokenizer, and bytes of texts (one text at least) that are encoded at once.
JOINED, AT_ONCE = 100, 8_000_000

#: A space before further white space: there the cut at spaces could differ from the tokenizer's.
_ODD_SPACE = re.compile(r" \s")
#: Letters that are composed already, have one lower case letter, and need no look at their neighbours.
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
_GRAPHIC = re.compile("[ -~]+")
_PLAIN = re.compile(rf"[!-~{_LETTER[6:]}]+")
#: A word, as RE2 finds it, that is not plain or may hold a special token.
_NOT_PLAIN = rf"[^!-~{_LETTER[6:]}]|<\|"
_PLAIN_SPACED = re.compile(rf"[ -~\n{_LETTER[6:]}]+")
#: Fixed patterns: the piece rules of the two vocabularies, for plain stretches.
_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[0-9]|[^{_LETTER}0-9]+")
_PIECES_OF_LINES = re.compile(rf"\n|'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[0-9]|[^\n{_LETTER}0-9]+")  # a word in each line
_PIECES_SPACED = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[0-9]+| ?[^\s{_LETTER}0-9]+|\s+(?!\S)|\s+")


def vocabulary(name: str) -> str:
    """The path of one of the public vocabularies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _visible_bytes() -> dict[int, str]:
    """Byte-level vocabularies write each byte as a visible character: itself, or the next one from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class _Numbers(dict):
    """Numbers of stretches; an unknown one is encoded on first sight."""

    def __init__(self, learn):
        super().__init__()
        self.learn = learn

    def __missing__(self, key):
        return self.learn(key)


class Encoder:
    """encode(text) gives the ids of a text.  spaces_count: white space is part of the ids, and so is case."""

    def __init__(self, path: str, spaces_count: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.spaces_count = self.tokenizer.model, spaces_count
        self.visible = {chr(b): c for b, c in _visible_bytes().items()}
        self.piece_ids: dict[str, bytes] = {}  # ids of four bytes each, a third of the memory of lists
        self.number = _Numbers(self._learn)
        self.ids, self.start, self.length = array("i"), array("q"), array("q")
        if spaces_count:
            vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
            self.opens = np.zeros(max(vocabulary.values()) + 1, bool)  # ids of tokens that begin with a space
            self.opens[[i for token, i in vocabulary.items() if token.startswith(self.visible[" "])]] = True

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _of_piece(self, piece: str) -> bytes:
        ids = self.piece_ids.get(piece)
        if ids is None:
            shown = piece.replace(" ", self.visible[" "]) if _GRAPHIC.fullmatch(piece) else "".join(map(self.visible.__getitem__, piece.encode().decode("latin-1")))
            ids = array("i", [t.id for t in self.model.tokenize(shown)]).tobytes()
            if len(self.piece_ids) < KEPT:
                self.piece_ids[piece] = ids
        return ids

    def stretch(self, text: str) -> list[int] | array:
        plain, pieces = (_PLAIN_SPACED, _PIECES_SPACED) if self.spaces_count else (_PLAIN, _PIECES)
        if not plain.fullmatch(text) or "<|" in text:
            return self.whole(text)
        return array("i", b"".join(map(self._of_piece, pieces.findall(text if self.spaces_count else text.lower()))))

    def _learn(self, key: bytes | str) -> int:
        ids, k = self.stretch(" " + key if self.spaces_count else key.decode()), len(self.start)
        self.start.append(len(self.ids))
        self.length.append(len(ids))
        self.ids.extend(ids)
        if k < KEPT:
            self.number[key] = k
        return k

    def encode(self, text: str) -> np.ndarray:
        first: list[int] | array = []
        if self.spaces_count:
            if _ODD_SPACE.search(text):
                return np.array(self.whole(text), np.int32)
            head, *parts = text.split(" ")  # each later part stands for itself with the space before it
            first = self.stretch(head) if head else []
        else:
            parts = text.encode().split()  # only white space that both sides drop
        at = np.fromiter(map(self.number.__getitem__, parts), np.int64, len(parts))
        if not len(at):
            return np.array(first, np.int32)
        starts, length = np.frombuffer(self.start, np.int64)[at], np.frombuffer(self.length, np.int64)[at]
        ends = np.cumsum(length)
        ids = np.frombuffer(self.ids, np.int32)[np.arange(ends[-1]) + np.repeat(starts - (ends - length), length)]
        if len(self.start) > KEPT:  # what is not remembered
            del self.ids[self.start[KEPT] :], self.length[KEPT:], self.start[KEPT:]
        return np.concatenate([np.array(first, np.int32), ids]) if first else ids

    def _spaced(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, each with a space before it, and how many each has.  No word holds a space, so its first
        token, and no other, begins with one: there the ids of joined words are parted."""
        texts = [" " + " ".join(words[k : k + JOINED]) for k in range(0, len(words), JOINED)]
        ids = np.concatenate([np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
        starts = np.flatnonzero(self.opens[ids])
        if len(starts) == len(words) and starts[0] == 0:
            return ids, np.diff(starts, append=len(ids))
        each = [self.whole(" " + w) for w in words]
        return np.concatenate([np.array(x, np.int32) for x in each]), np.array([len(x) for x in each])

    def _merged(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces from the merge model, and how many each has.  No piece holds a space."""
        shown = " ".join(pieces).encode().decode("latin-1").translate(str.maketrans(self.visible)).split(self.visible[" "])
        each = [[t.id for t in self.model.tokenize(p)] for p in shown]
        return np.fromiter(chain.from_iterable(each), np.int32), np.fromiter(map(len, each), np.int64, len(each))

    def _numbered(self, words: list[str]) -> np.ndarray:
        """Numbers of different words, or of pieces where white space does not count; the first KEPT are remembered."""
        found, known = list(map(self.number.get, words)), len(self.start)
        new = [k for k, n in enumerate(found) if n is None and words[k]]
        if new:
            fresh = [words[k] for k in new]
            ids, length = self._spaced(fresh) if self.spaces_count else self._merged(fresh)
            self.start.frombytes((len(self.ids) + np.cumsum(length) - length).astype(np.int64).tobytes())
            self.length.frombytes(length.astype(np.int64).tobytes())
            self.ids.frombytes(ids.tobytes())
            self.number.update(zip(fresh[: max(0, KEPT - known)], range(known, KEPT)))
            for n, k in enumerate(new, known):
                found[k] = n
        # left: no word after the space at a text's end; joined, that space would meet the next one
        return np.array([self._learn("") if n is None else n for n in found], np.int64)

    def encode_spaced(self, texts: list[str]) -> list[np.ndarray]:
        """encode of each text, where white space counts: their distinct words are looked up once for all of them."""
        odd = [bool(_ODD_SPACE.search(t)) for t in texts]
        parts = pc.split_pattern(pa.array([t for t, o in zip(texts, odd) if not o], pa.string()), " ")
        first = parts.offsets.to_numpy().astype(np.int64)
        later = np.ones(first[-1], bool)
        later[first[:-1]] = False  # a text's first word has no space before it, and is encoded for itself
        words = parts.flatten().filter(pa.array(later)).dictionary_encode()
        ids, ends = np.empty(0, np.int32), np.empty(0, np.int64)
        if len(words):
            at = self._numbered(words.dictionary.to_numpy(zero_copy_only=False).tolist())[words.indices.to_numpy()]
            starts, length = np.frombuffer(self.start, np.int64)[at], np.frombuffer(self.length, np.int64)[at]
            ends = np.cumsum(length)
            ids = np.frombuffer(self.ids, np.int32)[np.arange(ends[-1]) + np.repeat(starts - (ends - length), length)]
        bounds = iter(np.append(0, ends)[first - np.arange(len(first))].tolist())
        if len(self.start) > KEPT:  # what is not remembered
            del self.ids[self.start[KEPT] :], self.length[KEPT:], self.start[KEPT:]
        out, lo = [], next(bounds)
        for text, whole in zip(texts, odd):
            if whole:
                out.append(np.array(self.whole(text), np.int32))
                continue
            head, hi = text.partition(" ")[0], next(bounds)
            out.append(np.append(np.array(self.stretch(head) if head else [], np.int32), ids[lo:hi]))
            lo = hi
        return out

    def _of_words(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids, and where in them those of each word start and how many they are, where white space does not count."""
        odd = pc.match_substring_regex(words, _NOT_PLAIN).to_numpy(zero_copy_only=False)
        plain = words.filter(pa.array(~odd))
        lines = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(plain)], pa.int32()), plain), "\n")[0].as_py().lower()
        pieces = pa.array(_PIECES_OF_LINES.findall(lines + "\n" if len(plain) else ""), pa.string()).dictionary_encode()
        each, at = pieces.dictionary.to_numpy(zero_copy_only=False).tolist(), pieces.indices.to_numpy()
        whole = [self.number[w.encode()] for w in words.filter(pa.array(odd)).to_pylist()]
        numbers = np.append(self._numbered(each)[at], np.array(whole, np.int64))
        starts, length = np.frombuffer(self.start, np.int64)[numbers], np.frombuffer(self.length, np.int64)[numbers]
        line = np.flatnonzero(np.fromiter((p == "\n" for p in each), bool, len(each))[at])
        length[line] = 0
        ids, ends = _gathered(np.frombuffer(self.ids, np.int32), starts, length)
        ends = ends[np.append(line, np.arange(len(at), len(numbers)))]  # of the plain words, then of the others
        order = np.argsort(np.append(np.flatnonzero(~odd), np.flatnonzero(odd)))
        size = np.diff(ends, prepend=0)
        return ids, (ends - size)[order], size[order]

    def encode_unspaced(self, texts: pa.StringArray) -> list[np.ndarray]:
        """encode of each text, where white space does not count: their distinct words are cut and looked up once for all."""
        parts = pc.ascii_split_whitespace(texts)  # only white space that both sides drop; an empty word has no ids
        words = parts.flatten().dictionary_encode()
        if not len(words):
            return [np.empty(0, np.int32) for _ in range(len(texts))]
        ids, start, size = self._of_words(words.dictionary)
        at = words.indices.to_numpy()
        ids, ends = _gathered(ids, start[at], size[at])
        if len(self.start) > KEPT:  # what is not remembered
            del self.ids[self.start[KEPT] :], self.length[KEPT:], self.start[KEPT:]
        offsets = parts.offsets.to_numpy()
        bounds = np.append(0, ends)[offsets - offsets[0]].tolist()
        return [ids[lo:hi] for lo, hi in zip(bounds, bounds[1:])]


def _gathered(ids: np.ndarray, starts: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of runs one after another, and where each run ends."""
    ends = np.cumsum(length)
    return ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - length), length)], ends


def at_once(texts: pa.Array) -> list[tuple[int, int]]:
    """(from, to) of rows whose texts are encoded at once."""
    block = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)) // AT_ONCE
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(texts)]
    return list(zip(cuts, cuts[1:]))


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, spaces_count: bool) -> Encoder:
    """The worker's encoder of this vocabulary; spaces_count: whether white space is part of the ids."""
    key = path, spaces_count
    claim_memory(key, _encoders.clear)
    if key not in _encoders:
        _encoders[key] = Encoder(path, spaces_count)
    return _encoders[key]
