"""Token ids of whole texts by a word-level BPE file, each different word encoded once per worker.

White space ends every pre-token of these tokenizers, so a text's ids are its words' ids in a row.
Words are looked up by a 64-bit hash; unknown words are normalised, cut into pre-tokens and given
to the file's BPE model, again only those pre-tokens that are new. What a worker remembers is
bounded by `REMEMBERED` words and never changes a result.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import regex
from tokenizers import Tokenizer
from tokenizers.models import BPE
from tokenizers.pre_tokenizers import WhitespaceSplit

from veriframe.llm.arrays import U64, Chunk, Rolling, find, memory

REMEMBERED = 1_500_000
BLANK = np.zeros(256, bool)
BLANK[[0x20, 0x0A]] = True  # only these two cut a text here; the pattern sees all other white space


def _byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    out.update({b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in out)})
    return out


def gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """flat[start:start+size] of all slices, in a row."""
    stops = np.cumsum(sizes)
    return flat[np.repeat(starts - (stops - sizes), sizes) + np.arange(stops[-1] if len(stops) else 0)]


class WordEncoder:
    """ids(chunk) -> (ids, first id of each document)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        suffix = model["end_of_word_suffix"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.bpe = Tokenizer(BPE(model["vocab"], merges, end_of_word_suffix=suffix))
        self.bpe.pre_tokenizer = WhitespaceSplit()
        self.last = np.zeros(max(model["vocab"].values()) + 1, bool)
        self.last[[i for token, i in model["vocab"].items() if token.endswith(suffix)]] = True
        self.pattern = regex.compile(r"\n|" + split["pattern"]["Regex"])
        self.letters = _byte_characters()
        self.forget()

    def forget(self) -> None:
        self.pretokens: dict[str, int] = {"\n": 0}  # number of each pre-token; 0 ends a word
        self.token_starts = self.token_sizes = np.zeros(1, np.int64)
        self.hashes = np.zeros(0, U64)
        self.starts = self.sizes = np.zeros(0, np.int64)
        self.token_flat = self.flat = np.zeros(0, np.int32)

    def _learn_pretokens(self, found: list[str]) -> None:
        known = self.pretokens
        new = [t for t in dict.fromkeys(found) if t not in known]
        if not new:
            return
        known.update(zip(new, range(len(known), len(known) + len(new))))
        ids = []
        for at in range(0, len(new), 2000):
            part = new[at:at + 2000]
            text = " ".join(part)
            if not text.isascii():
                text = " ".join(t.encode().decode("latin-1").translate(self.letters) for t in part)
            ids.append(np.array(self.bpe.encode(text, add_special_tokens=False).ids, np.int32))
        ids = np.concatenate(ids)
        stops = np.flatnonzero(self.last[ids]) + 1
        starts = np.r_[0, stops[:-1]]
        self.token_starts = np.r_[self.token_starts, starts + len(self.token_flat)]
        self.token_sizes = np.r_[self.token_sizes, stops - starts]
        self.token_flat = np.concatenate([self.token_flat, ids])

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        text = unicodedata.normalize("NFC", "\n".join(words)).replace("Σ", "σ").lower()
        found = self.pattern.findall(text + "\n")
        self._learn_pretokens(found)
        known = self.pretokens
        number = np.array([known[t] for t in found], np.int64)
        stops = np.flatnonzero(number == 0)
        sizes = self.token_sizes[number]
        per_word = np.add.reduceat(sizes, np.r_[0, stops[:-1] + 1])
        starts = len(self.flat) + np.cumsum(per_word) - per_word
        self.flat = np.concatenate([self.flat, gather(self.token_flat, self.token_starts[number], sizes)])
        order = np.argsort(hashes)
        at = np.searchsorted(self.hashes, hashes[order])
        self.hashes = np.insert(self.hashes, at, hashes[order])
        self.starts = np.insert(self.starts, at, starts[order])
        self.sizes = np.insert(self.sizes, at, per_word[order])

    def ids(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
        data, starts, ends, owner = chunk.words(BLANK, lower=False)
        n = len(chunk.ends)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
        words, first, inverse = np.unique(Rolling(data).of(starts, ends), return_index=True, return_inverse=True)
        if len(self.hashes) > REMEMBERED:
            self.forget()
        _, known = find(self.hashes, words)
        if not known.all():
            raw, new = data.tobytes(), first[~known]
            self._learn(words[~known], [raw[a:b].decode() for a, b in zip(starts[new].tolist(), ends[new].tolist())])
        at, _ = find(self.hashes, words)
        at = at[inverse]
        sizes = self.sizes[at]
        ids = gather(self.flat, self.starts[at], sizes)
        per_doc = np.bincount(owner, weights=sizes, minlength=n).astype(np.int64)
        return ids, np.r_[0, np.cumsum(per_doc)]


def encoder(path: str) -> WordEncoder:
    """This worker's encoder of a file."""
    own = memory("encoder")
    if path not in own:
        own[path] = WordEncoder(path)
    return own[path]
