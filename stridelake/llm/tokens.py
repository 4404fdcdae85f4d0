"""Exact encoding of whole texts with a cache of the pieces that no token crosses.

Both tokenizers split a text before they merge, and never merge over the edge of a piece that a run of
non-space characters gives. So each distinct piece is encoded once by the tokenizers library and looked up after that; when the cache is full,
pieces that it lacks are encoded anew with each batch.
Where pieces keep their space, Arrow finds the distinct ones of a batch, so that only these are looked up, and words that differ only
in the marks at their end share one encoding.
Texts with white space on which libraries disagree are encoded whole.
"""

from __future__ import annotations

import json
import os
import re
from itertools import chain
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"
#: White space and joiners that Python and the tokenizers' patterns may treat apart; texts that hold any are encoded whole.
ODD_RE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]")
#: The same among the ASCII characters.
ODD_ASCII = "\x1c\x1d\x1e\x1f"
SPACED_RE = re.compile(r" ?\S+|\s+(?!\S)|\s+")
#: Marks before a piece that no space leads; a text that holds one of them is encoded whole.
FIRST, LINE = "\x1c", "\x1d"
#: Parts the pieces of marked texts; a text that holds it is encoded whole.
PARTED = "\x1e"
#: Marks that are cut from the end of a word, and the last characters of words from which they are cut: letters and digits by any
#: library's tables. The tokenizer's pattern has no match with a letter or digit before another mark, so no token crosses the cut.
END_MARKS = ".,;:!?*#$%&+-=/|~^_@<>()[]{}\""
WORD_END = "[A-Za-z0-9À-ÖØ-öø-ɏ]$"
#: Pieces that a worker keeps.
CACHED = 800_000
#: New pieces that are encoded as one text.
JOINED = 256


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: One encoder of each kind in a worker process, so that tasks that follow each other share its cache.
_encoders: dict = {}


def encoder(path: str, with_spaces: bool) -> Encoder:
    if (path, with_spaces) not in _encoders:
        _encoders[path, with_spaces] = Encoder(path, with_spaces)
    return _encoders[path, with_spaces]


class _Index(dict):
    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, piece):
        n = self[piece] = len(self)
        self.new.append(piece)
        return n


def laid(flat: np.ndarray, offsets: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The stretches of flat, one after the other."""
    ends = np.cumsum(lengths)
    return flat[np.repeat(offsets - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)]


class Encoder:
    """path: a tokenizers JSON file. with_spaces: pieces keep their leading space (byte-level BPE) or white space is dropped."""

    def __init__(self, path: str, with_spaces: bool):
        from tokenizers import Tokenizer

        # A worker has one core: more threads of the library only wait for each other, and each holds memory of its own.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.with_spaces = with_spaces
        self.index, self.flat = _Index(), np.zeros(0, np.uint32)
        self.lengths, self.offsets = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.cuts = True
        if with_spaces:
            kind = json.loads(self.tokenizer.to_str())
            before = kind["pre_tokenizer"] or {}
            # The pieces are those of this pattern; texts of other tokenizers are encoded whole.
            self.cuts = kind["normalizer"] is None and before.get("type") == "ByteLevel" and not before["add_prefix_space"] and before.get("use_regex", True)
            vocabulary = self.tokenizer.get_vocab()
            # A character of a byte-level token stands for one byte of the text.
            self.token_bytes = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
            self.token_bytes[list(vocabulary.values())] = [len(x) for x in vocabulary]

    @staticmethod
    def _marked(text: str) -> str:
        """The text's pieces, with PARTED between them; they start where the tokenizer's own do: FIRST or LINE before a text's first
        piece or a line's, else a space is meant.

        Between single spaces and single line ends that is a plain cut; texts with other white space are cut by the pattern.
        """
        if "  " in text or "\n\n" in text or "\n " in text or " \n" in text or "\t" in text or "\r" in text or "\x0b" in text or "\x0c" in text:
            return PARTED.join([x[1:] if x[0] == " " else FIRST + x for x in SPACED_RE.findall(text)])
        return FIRST + text.replace(" ", PARTED).replace("\n", PARTED + LINE)

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _add(self, ids: np.ndarray, n: np.ndarray) -> None:
        self.offsets = np.concatenate([self.offsets, len(self.flat) + np.cumsum(n) - n])
        self.lengths = np.concatenate([self.lengths, n])
        self.flat = np.concatenate([self.flat, ids])

    def _learn(self) -> None:
        """Encodes the new words, many to a text: the offsets of the tokens tell where a word ends."""
        new = self.index.new
        groups = [new[at : at + JOINED] for at in range(0, len(new), JOINED)]
        n, together = [], []
        for group, e in zip(groups, self.tokenizer.encode_batch([" ".join(group) for group in groups], add_special_tokens=False), strict=True):
            ends = np.cumsum([len(x) + 1 for x in group])
            starts = np.fromiter(map(itemgetter(0), e.offsets), np.int64, len(e.ids))
            n.append(np.bincount(np.searchsorted(ends, starts, "right"), minlength=len(group)))
            together += e.ids
        self._add(np.array(together, np.uint32), np.concatenate(n))

    def _learn_spaced(self) -> None:
        """Encodes the new pieces: those that are a word and END_MARKS from the ids of both, all others by the library."""
        known = len(self.offsets)
        pieces = pa.array(self.index.new, pa.large_string())
        stems = pc.ascii_rtrim(pieces, END_MARKS)
        sizes, cuts = pc.binary_length(pieces).to_numpy(), pc.binary_length(stems).to_numpy()
        ending = (cuts < sizes) & pc.match_substring_regex(stems, WORD_END).to_numpy(zero_copy_only=False)
        two = np.flatnonzero(ending)
        words = stems.filter(pa.array(ending)).to_numpy(zero_copy_only=False).tolist()
        marks = [FIRST + self.index.new[k][len(word) :] for k, word in zip(two.tolist(), words, strict=True)]
        look = self.index.__getitem__  # words and marks that are new themselves join index.new
        parts = np.stack([np.fromiter(map(look, words), np.int64, len(words)), np.fromiter(map(look, marks), np.int64, len(marks))], 1)
        new = self.index.new
        single = np.ones(len(new), bool)
        single[two] = False
        single = np.flatnonzero(single)
        ids, n_single = self._encoded([new[k] for k in single.tolist()])
        n = np.zeros(len(new), np.int64)
        n[single] = n_single
        lengths, offsets = np.concatenate([self.lengths, n]), np.concatenate([self.offsets, np.zeros(len(new), np.int64)])
        offsets[known + single] = len(self.flat) + np.cumsum(n_single) - n_single
        flat = np.concatenate([self.flat, ids])
        joined = laid(flat, offsets[parts.ravel()], lengths[parts.ravel()])
        n[two] = lengths[parts].sum(1)
        offsets[known + two] = len(flat) + np.cumsum(n[two]) - n[two]
        self._add(laid(np.concatenate([flat, joined]), offsets[known:], n), n)

    def _encoded(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The library's ids of marked pieces. All but white space go many to a text: the bytes of the tokens tell where a piece ends.
        A piece that no space leads follows a line end there, which is a piece of its own. Where the bytes do not fit (a vocabulary
        that lacks some), each piece is encoded alone."""
        bare = [x[1:] if x[:1] in (FIRST, LINE) else " " + x for x in pieces]
        rest = [k for k, x in enumerate(bare) if x and not x.isspace() and pieces[k] != LINE]
        led = ["\n" + bare[k] if pieces[k][:1] in (FIRST, LINE) else bare[k] for k in rest]
        texts = ["".join(led[at : at + JOINED]) for at in range(0, len(led), JOINED)]
        together = np.fromiter(chain.from_iterable(e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)), np.uint32)
        token_ends = np.concatenate([[0], np.cumsum(self.token_bytes[together])])
        ends = np.cumsum(pc.binary_length(pa.array(led, pa.large_string())).to_numpy().astype(np.int64))
        starts = np.concatenate([[0], ends])[: len(ends)] + np.fromiter((pieces[k][:1] == FIRST for k in rest), bool, len(led))
        first, last = np.searchsorted(token_ends, starts), np.searchsorted(token_ends, ends)
        if rest and not (token_ends[-1] == ends[-1] and (token_ends[first] == starts).all() and (token_ends[last] == ends).all()):
            rest, first, last = [], first[:0], last[:0]
        single = np.ones(len(pieces), bool)
        single[rest] = False
        alone = np.flatnonzero(single)
        lines = ["\n" + bare[k] if pieces[k][:1] == LINE else bare[k] for k in alone.tolist()]
        whole = [e.ids for e in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)]
        n, at = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        n[rest], at[rest] = last - first, first
        n[alone] = [len(x) for x in whole]
        at[alone] = len(together) + np.cumsum(n[alone]) - n[alone]
        return laid(np.concatenate([together, np.fromiter(chain.from_iterable(whole), np.uint32)]), at, n), n

    def _forget(self) -> None:
        """Drops the pieces beyond CACHED, all of which are new in the batch."""
        for piece in self.index.new[CACHED - len(self.index) :]:
            del self.index[piece]
        self.flat = self.flat[: self.offsets[CACHED]]
        self.offsets, self.lengths = self.offsets[:CACHED], self.lengths[:CACHED]

    def _places(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The index of each word, and the number of words of each text."""
        look, at, sizes = self.index.__getitem__, [], []
        for text in texts:
            words = text.split()
            at.extend(map(look, words))
            sizes.append(len(words))
        return np.array(at, np.int64), np.array(sizes, np.int64)

    def _places_spaced(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The index of each piece, and the number of pieces of each text. Each distinct piece is looked up once."""
        lists = pc.split_pattern(pa.array(map(self._marked, texts), pa.large_string()), PARTED)
        pieces = lists.flatten().dictionary_encode()
        found = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        at = np.fromiter(map(self.index.__getitem__, found), np.int64, len(found))
        return at[pieces.indices.to_numpy()], pc.list_value_length(lists).to_numpy().astype(np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and the number of ids of each text."""
        whole = {k: self._whole(x) for k, x in enumerate(texts) if not self.cuts or (any(c in x for c in ODD_ASCII) if x.isascii() else ODD_RE.search(x))}
        cut = ["" if k in whole else x for k, x in enumerate(texts)] if whole else texts
        at, sizes = self._places_spaced(cut) if self.with_spaces else self._places(cut)
        if self.index.new:
            self._learn_spaced() if self.with_spaces else self._learn()
        n = self.lengths[at]
        ends = np.cumsum(n)
        ids = laid(self.flat, self.offsets[at], n)
        if len(self.index) > CACHED:
            self._forget()
        self.index.new = []
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes)])]
        counts = np.diff(bounds)
        if not whole:
            return ids, counts
        parts = [whole[k] if k in whole else ids[bounds[k] : bounds[k + 1]] for k in range(len(texts))]
        return np.concatenate(parts), np.array([len(x) for x in parts], np.int64)
