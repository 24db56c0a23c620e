"""Token ids of whole texts by the tokenizers library, each distinct piece of a slice given to it once.

Byte-level BPE never merges across a pre-token, and in this vocabulary's pattern a
space before a non-space always starts a pre-token, as a lone line feed between
non-spaces is one. So texts are cut before such spaces and line feeds, a slice of texts
is reduced to its distinct pieces, the library encodes these, and their ids are put in
the pieces' places by array operations. Pieces of letters, or of letters and signs, are
cut into their pre-tokens here and go to the library's model in its byte alphabet. Texts
with other runs of white space go to the library whole. Added tokens written in a text
(as <|endoftext|>) get their own id, as the plain library call gives it; none has white
space, so they lie within pieces.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .arrow import slices, text_buffers

END_ID = 0
SLICE_BYTES = 16 << 20
RUN_PIECES = 2000

# Letters and signs of which the pattern surely makes one pre-token each; all are in its letter class, or out of it.
LETTERS = "[A-Za-z\\x{c0}-\\x{d6}\\x{d8}-\\x{f6}\\x{f8}-\\x{24f}]+"
SIGNS = "[!-/:-@\\[-`{-~]+"
SIMPLE = f"^\n?{LETTERS}({SIGNS})?$"
FORMS = ((f"^({LETTERS})$", "\x01\\1"), (f"^\n({LETTERS})$", "\x02 \\1"), (f"^({LETTERS})({SIGNS})$", "\x01\\1 \\2"), (f"^\n({LETTERS})({SIGNS})$", "\x02 \\1 \\2"))
#: The byte-level alphabet: printable bytes stand for themselves, the others are numbered from 256 on; 1 and 2 mark a space and a line feed.
PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
ALPHABET = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in PRINTABLE)}
ALPHABET = {b: c for b, c in ALPHABET.items() if b > 127} | {1: ALPHABET[32], 2: ALPHABET[10]}

# White space besides the space and the line feed.
OTHER_SPACE = "[\\t\\x0b\\x0c\\r\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
#: Classes of bytes: 1 a space or a line feed, 2 other ASCII white space, 4 what other white space can start with.
BYTE_CLASS = np.zeros(256, np.uint8)
BYTE_CLASS[[32, 10]] = 1
BYTE_CLASS[[9, 11, 12, 13, 28, 29, 30, 31]] = 2
BYTE_CLASS[[0xC2, 0xE1, 0xE2, 0xE3]] = 4


def default_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def irregular(texts: pa.Array) -> np.ndarray:
    """Whether texts have white space besides single spaces and line feeds between non-spaces."""
    data, offsets = text_buffers(texts)
    kind = BYTE_CLASS[data]
    odd = np.zeros(len(texts), bool)
    full = np.flatnonzero(np.diff(offsets))
    odd[full] = (kind[offsets[full]] | kind[offsets[full + 1] - 1]) & 1
    some = np.flatnonzero((kind[:-1] & kind[1:] & 1) | (kind[:-1] & 2)) if len(kind) else full[:0]
    odd[np.searchsorted(offsets, some, side="right") - 1] = True
    wide = np.unique(np.searchsorted(offsets, np.flatnonzero(kind & 4), side="right") - 1)
    if len(wide):
        odd[wide] |= pc.match_substring_regex(texts.take(pa.array(wide)), OTHER_SPACE).to_numpy(zero_copy_only=False)
    if len(kind) and kind[-1] & 2:
        odd[full[-1]] = True
    return odd


def joined(pieces: pa.Array) -> list[str]:
    """Runs of pieces, a space between them."""
    ends = np.append(np.arange(0, len(pieces), RUN_PIECES), len(pieces)).astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), pieces), " ").to_pylist() if len(pieces) else []


def in_alphabet(text: str) -> str:
    raw = text.encode().decode("latin-1")
    for b, c in ALPHABET.items():
        raw = raw.replace(chr(b), chr(c))
    return raw


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks are the parallelism
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.tokenizer = Tokenizer.from_file(path)
        # the same model behind a split at spaces alone, for texts that are cut into pre-tokens and written in its alphabet already
        self.cut = Tokenizer(self.tokenizer.model)
        self.cut.pre_tokenizer = CharDelimiterSplit(" ")
        if any(set(t.content) & set(" \n") or t.lstrip or t.rstrip for t in self.tokenizer.get_added_tokens_decoder().values()):
            raise ValueError("an added token reaches over white space")
        size = self.tokenizer.get_vocab_size()
        if size > 65536:
            raise ValueError("ids need more than 16 bits")
        self.starts_piece = np.zeros(size, dtype=bool)
        for piece, i in self.tokenizer.get_vocab().items():
            self.starts_piece[i] = piece[0] in "ĠĊ"  # how the byte-level alphabet writes a space and a line feed

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, dtype=np.uint16) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _apart(self, coded: list, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, first id of each): ids that start with a space or a line feed tell pieces apart."""
        ids = np.concatenate([*(np.asarray(e.ids, dtype=np.uint16) for e in coded), np.zeros(0, np.uint16)])
        first = np.flatnonzero(self.starts_piece[ids])
        if len(first) != n:
            raise ValueError("pieces and ids don't match")
        return ids, first

    def _distinct(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first id of each piece, how many); an empty piece has none."""
        simple = pc.match_substring_regex(pieces, SIMPLE)
        marked = pieces.filter(simple)
        for form, to in FORMS:
            marked = pc.replace_substring_regex(marked, form, to)
        runs = [in_alphabet(run) for run in joined(marked)]
        ids_1, first_1 = self._apart(self.cut.encode_batch_fast(runs, add_special_tokens=False), len(marked))
        rest = pc.and_(pc.invert(simple), pc.greater(pc.binary_length(pieces), 0))
        others = pieces.filter(rest)
        runs = [(" " + run).replace(" \n", "\n") for run in joined(others)]
        ids_2, first_2 = self._apart(self.tokenizer.encode_batch_fast(runs, add_special_tokens=False), len(others))
        first, sizes = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        for mask, at, base, end in ((simple, first_1, 0, len(ids_1)), (rest, first_2, len(ids_1), len(ids_2))):
            own = mask.to_numpy(zero_copy_only=False)
            first[own], sizes[own] = at + base, np.diff(np.append(at, end))
        return np.concatenate([ids_1, ids_2]), first, sizes

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, first id of each text and one more)."""
        texts = texts.fill_null("")
        odd = irregular(texts)
        plain = texts.filter(pa.array(~odd & (pc.binary_length(texts).to_numpy(zero_copy_only=False) > 0)))
        where = np.flatnonzero(~odd & (pc.binary_length(texts).to_numpy(zero_copy_only=False) > 0))
        marked = pc.replace_substring(pc.binary_join_element_wise("\n", plain, ""), "\n", " \n")  # each text starts with a space and a line feed
        split = pc.split_pattern(marked, " ")
        bounds = split.offsets.to_numpy()
        coded = split.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
        index, bounds = coded.indices.to_numpy(), bounds - bounds[0]
        ids, first, sizes = self._distinct(coded.dictionary)
        length = sizes[index]
        ends = np.cumsum(length)
        total = int(ends[-1]) if len(ends) else 0
        flat = ids[np.repeat(first[index] - (ends - length), length) + np.arange(total)]
        at = np.append(0, ends)[bounds]
        counts = np.zeros(len(texts), np.int64)
        counts[where] = np.diff(at) - 1  # without the line feed put before
        whole = dict(zip(np.flatnonzero(odd).tolist(), self._whole(texts.filter(pa.array(odd)).to_pylist()), strict=True))
        for k, own in whole.items():
            counts[k] = len(own)
        offsets = np.append(0, np.cumsum(counts))
        keep = np.ones(total, bool)
        keep[at[:-1]] = False
        out = flat[keep]
        if whole:
            every, mine = np.empty(offsets[-1], np.uint16), np.repeat(~odd, counts)
            every[mine] = out
            for k, own in whole.items():
                every[offsets[k] : offsets[k + 1]] = own
            out = every
        return out, offsets

    def documents(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """encode() with the end id after each text."""
        ids, offsets = self.encode(texts)
        n = len(offsets) - 1
        out = np.full(len(ids) + n, END_ID, np.uint16)
        out[np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(offsets))] = ids
        return out, offsets + np.arange(n + 1)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def document_slices(texts: pa.Array, path: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, ids with end ids, first id of each document and one more) for slices of a column."""
    own = encoder(path)
    for first, last in slices(text_buffers(texts)[1], SLICE_BYTES):
        yield (first, *own.documents(texts.slice(first, last - first)))
