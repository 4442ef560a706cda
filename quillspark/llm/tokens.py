"""Token ids of whole texts, with what the tokenizer makes of a word remembered.

Only for tokenizers that drop white space and never join ids across it, which Encoder checks on the file: then a text's ids are
those of its words, one after another.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


#: ASCII punctuation that may end a word; no apostrophe, which has rules of its own.
PUNCTUATION = b".,!?;:*$%#&|"
# one thread a task: Spark gives each task a core
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


class _Index(dict):
    """Numbers words as they come, and notes the new ones."""

    def __init__(self, *a: object):
        super().__init__(*a)
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        return n


def _ends_in_letter(core: bytes) -> bool:
    """Whether the last character is a letter when normalised too: some lower-case or composed forms end in a mark, which joins punctuation."""
    return unicodedata.normalize("NFC", core.decode("utf-8", "replace")).lower()[-1].isalpha()


class Encoder:
    """A tokenizer file of the tokenizers library, over UTF-8 texts.

    A word is a core and the punctuation that ends it; the ids of cores are what is remembered. At most about most_words
    words and as many cores stay in memory: the words met once since the last look go first, then those met least.
    """

    def __init__(self, path: str, most_words: int = 400_000):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            kind = json.load(f)
        split = (kind["pre_tokenizer"].get("pretokenizers") or [kind["pre_tokenizer"]])[0]
        if split.get("type") != "Split" or split.get("behavior") != "Removed" or "\\s" not in json.dumps(split.get("pattern")):
            raise ValueError("this tokenizer doesn't drop white space")
        self.tokenizer, self.most = Tokenizer.from_file(path), most_words
        self.lower = "Lowercase" in json.dumps(kind["normalizer"])
        self.byte_level = kind["model"]["type"] == "BPE" and (kind["pre_tokenizer"].get("pretokenizers") or [{}])[-1].get("type") == "ByteLevel" and "\\p{L}]+" in json.dumps(split)
        self.byte_level &= not (kind["pre_tokenizer"].get("pretokenizers") or [{}])[-1].get("add_prefix_space", True)
        digit = self._ids(["7"])[0]
        # a word of this one id can stand between others, in texts that have no 7
        self.bar = digit[0] if len(digit) == 1 else None
        self.words, self.cores, self.met = _Index(), _Index(), np.zeros(0, np.int64)
        self.core_of, self.end_of = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.starts, self.lengths, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self.cores[b""]

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self) -> None:
        """Cores and ends of the words noted as new, then the ids of new cores."""
        core_of, end_of = [], []
        for w in self.words.new:
            core = w.rstrip(PUNCTUATION)
            if core and core != w and (core[-1:].isalnum() or core[-1] > 127 and _ends_in_letter(core)) and b"<|" not in w:
                core_of.append(self.cores[core])
                end_of.append(self.cores[w[len(core) :]])
            else:
                core_of.append(self.cores[w])
                end_of.append(0)
        self.words.new = []
        self.core_of, self.end_of = np.append(self.core_of, np.array(core_of, np.int64)), np.append(self.end_of, np.array(end_of, np.int64))
        new, self.cores.new = [w.decode("utf-8", "replace") for w in self.cores.new], []
        if not new:
            return
        # words of small letters alone go straight to the model, which is all that the tokenizer does with them
        bare = np.array([self.byte_level and w.isascii() and w.isalpha() and w.islower() for w in new])
        easy = np.array([self.bar is not None and w != "" and w.isprintable() and "7" not in w and "<|" not in w for w in new]) & ~bare
        plain, small = np.flatnonzero(easy).tolist(), np.flatnonzero(bare).tolist()
        # many in one call, each followed by the bar, which none of them has
        ids = self._ids([" 7 ".join([*(new[i] for i in plain[at : at + 200]), ""]) for at in range(0, len(plain), 200)])
        ids = np.fromiter(itertools.chain.from_iterable(ids), np.uint32)
        bars = np.flatnonzero(ids == self.bar) if plain else np.zeros(0, np.int64)
        other = np.flatnonzero(~(easy | bare)).tolist()
        rest = [[t.id for t in self.tokenizer.model.tokenize(new[i])] for i in small] + self._ids([new[i] for i in other])
        lengths = np.zeros(len(new), np.int64)
        lengths[plain] = np.diff(bars, prepend=-1) - 1
        lengths[small + other] = [len(x) for x in rest]
        starts, order = np.zeros(len(new), np.int64), np.array(plain + small + other, np.int64)
        starts[order] = len(self.flat) + np.cumsum(lengths[order]) - lengths[order]
        self.starts, self.lengths = np.append(self.starts, starts), np.append(self.lengths, lengths)
        self.flat = np.concatenate([self.flat, np.delete(ids, bars), np.fromiter(itertools.chain.from_iterable(rest), np.uint32)])

    def _trim(self) -> None:
        """Forgets words met once, and then the rarest, until half is free."""
        if max(len(self.words), len(self.cores)) <= self.most:
            return
        keep = np.flatnonzero(self.met > 1)
        if len(keep) > self.most // 2:
            keep = np.sort(keep[np.argsort(-self.met[keep], kind="stable")[: self.most // 2]])
        names = list(self.words)
        self.words = _Index(zip([names[i] for i in keep.tolist()], range(len(keep)), strict=True))
        # the empty core is number 0
        used, at = np.unique(np.concatenate([[0], self.core_of[keep], self.end_of[keep]]), return_inverse=True)
        self.core_of, self.end_of, self.met = at[1 : len(keep) + 1], at[len(keep) + 1 :], self.met[keep]
        names = list(self.cores)
        self.cores = _Index(zip([names[i] for i in used.tolist()], range(len(used)), strict=True))
        starts, self.lengths = self.starts[used], self.lengths[used]
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = self.flat[np.repeat(starts - self.starts, self.lengths) + np.arange(int(self.lengths.sum()))]

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of all texts, each closed by end_id; where each text ends). Texts are strings or null."""
        self._trim()
        texts = texts.fill_null("")
        if self.lower:
            texts = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
        # a blank at either end leaves an empty word, which has no ids
        split = pc.ascii_split_whitespace(texts)
        n = np.diff(split.offsets.to_numpy()).astype(np.int64)
        found = split.flatten().dictionary_encode()
        names = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(found.dictionary)], pa.int32()), found.dictionary.cast(pa.binary())), b"\n")[0].as_py().split(b"\n") if len(found) else []
        at = np.fromiter(map(self.words.__getitem__, names), np.int64, len(names))[found.indices.to_numpy()]
        self._learn()
        self.met = np.append(self.met, np.zeros(len(self.words) - len(self.met), np.int64)) + np.bincount(at, minlength=len(self.words))
        parts = np.empty(2 * len(at), np.int64)
        parts[::2], parts[1::2] = self.core_of[at], self.end_of[at]
        lengths = self.lengths[parts]
        token_ends = np.concatenate([[0], np.cumsum(lengths)])
        ends = token_ends[2 * np.cumsum(n)] + np.arange(1, len(n) + 1)
        out = np.full(int(token_ends[-1]) + len(n), end_id, np.uint32)
        spots = np.ones(len(out), bool)
        spots[ends - 1] = False
        begin = np.repeat(self.starts[parts] - token_ends[:-1], lengths)
        begin += np.arange(len(begin))
        out[spots] = self.flat[begin]
        return out, ends


@functools.cache
def encoder(path: str) -> Encoder:
    """One for each Python worker, which serves many tasks."""
    return Encoder(path)
