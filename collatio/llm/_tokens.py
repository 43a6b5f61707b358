"""Token ids of whole texts, by a fixed public vocabulary."""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np

#: Words, and stems of words, kept with their ids in each worker; beyond its number a cache keeps what the last texts used.
WORDS, STEMS = 800_000, 400_000
#: What may follow a stem. None of it joins the letter or digit before it in the vocabulary's splitter.
TAIL = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
LOT = 4096
#: Letters of Latin-1 beyond ASCII, in UTF-8: their lower case and composed form are Latin-1 too.
LATIN = re.compile(rb"(?:[a-zA-Z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
#: The normaliser and splitter that `Tokens` relies on.
NORMALISER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on; a space stays one."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return {b: chr(b if b in own else next(rest)) for b in range(256)} | {0x20: " "}


class Plain:
    """Ids of texts by any vocabulary, each text encoded whole."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """For each text (UTF-8) its ids, packed."""
        return [np.array(self.tokenizer.encode(t.decode(), add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


class Tokens:
    """Ids of texts, encoded word by word.

    The vocabulary's normaliser and splitter never join what white space separates, so a text's ids are those of its
    white-space-delimited words in turn. Words repeat, so most come from a cache, as packed little-endian unsigned
    32-bit ids. A word that ends in ASCII punctuation after a letter or digit is split there too, and its stem, in
    lower case as the normaliser would make it, has a cache of its own. Only new stems and tails are encoded.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer, self.light = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.light.normalizer, self.light.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.WhitespaceSplit()
        self.letters = _letters()
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.words: dict[bytes, bytes] = {}
        self.stems: dict[bytes, bytes] = {b"": b""}

    def _one_by_one(self, stems: list[bytes]) -> None:
        for s, e in zip(stems, self.tokenizer.encode_batch([s.decode() for s in stems], add_special_tokens=False), strict=True):
            self.stems[s] = np.array(e.ids, "<u4").tobytes()

    def _learn(self, new: list[bytes]) -> None:
        """Encode new stems: those of letters alone together, as each of them ends with its first id that ends a word.

        ASCII and Latin-1 letters are put in lower case and spelt in the vocabulary's own alphabet here, and skip its normaliser and splitter.
        """
        latin, plain, other = [], [], []
        for s in new:
            if s.isascii():
                (latin if s.isalpha() else other).append(s)
            else:
                (latin if LATIN.fullmatch(s) else plain if s.decode().isalpha() else other).append(s)
        for own, spell in ((latin, self._spelt), (plain, self._whole)):
            for a in range(0, len(own), LOT):
                part = own[a : a + LOT]
                ids = spell(b" ".join(part).decode())
                stops = np.flatnonzero(self.ends[ids]) + 1
                if len(stops) != len(part) or (len(stops) and stops[-1] != len(ids)):
                    other += part
                    continue
                data, last = ids.tobytes(), 0
                for s, stop in zip(part, (4 * stops).tolist(), strict=True):
                    self.stems[s] = data[last:stop]
                    last = stop
        for a in range(0, len(other), LOT):
            self._one_by_one(other[a : a + LOT])

    def _spelt(self, s: str) -> np.ndarray:
        return np.array(self.light.encode_batch_fast([s.lower().encode().decode("latin-1").translate(self.letters)], add_special_tokens=False)[0].ids, "<u4")

    def _whole(self, s: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([s], add_special_tokens=False)[0].ids, "<u4")

    def _new(self, words: list[bytes]) -> None:
        """Take words into the cache, each as a stem and a tail."""
        heads, tails = [], []
        for w in words:
            low = w.lower() if w.isascii() else w
            stem = low.rstrip(TAIL)
            if b"<|" in w:  # a special token may be in it: it stays whole
                stem = low = w
            elif len(stem) != len(low):
                last = stem[-1:]
                if last and not (last.isalnum() if last < b"\x80" else stem.decode().lower()[-1].isalnum()):
                    stem = low  # so does a word whose stem ends in a mark
                else:
                    heads.append(stem)
                    tails.append(low[len(stem) :])
                    continue
            heads.append(stem)
            tails.append(b"")
        self._learn(list(set(heads).union(tails).difference(self.stems)))
        stems = self.stems
        self.words.update((w, stems[h] + stems[t] if t else stems[h]) for w, h, t in zip(words, heads, tails, strict=True))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """For each text (UTF-8) its ids, packed."""
        split = [t.split() for t in texts]
        whole = set().union(*split)
        if len(self.words) > WORDS:
            self.words = {w: self.words[w] for w in whole.intersection(self.words)}
        if len(self.stems) > STEMS:
            self.stems = {b"": b""}
        self._new(list(whole.difference(self.words)))
        known = self.words.__getitem__
        return [b"".join(map(known, t)) for t in split]


@lru_cache(1)
def tokens(path: str) -> Tokens | Plain:
    """One for each worker process: by words where the vocabulary's normaliser and splitter allow it."""
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    by_word = made["normalizer"] == NORMALISER and made["pre_tokenizer"] == SPLITTER and made["model"].get("end_of_word_suffix") == "</w>" and all("<|" in t["content"] for t in made["added_tokens"])
    return Tokens(path) if by_word else Plain(path)
