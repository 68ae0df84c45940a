"""Token ids of whole texts, with a bounded cache of the ids of words.

The tokenizer normalises (NFC, white space, lower case), cuts a text into words by a fixed
pattern and encodes each word for itself; white space is dropped. So the ids of a text are
the ids of its words, one after another. A batch of texts is cut into words by the same
pattern, each distinct word of it is looked up once, and those that are new go through the
tokenizers library. Texts of other than Latin characters, and those with "<|", which may
begin a special token, are cut at spaces alone, and their pieces go through the library as
they are.

All this holds for tokenizers that normalise and cut like that one. Texts of any other
tokenizer go through the library whole.
"""

from __future__ import annotations

import json
import os
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words, and pieces of texts cut at spaces alone, whose ids a worker keeps, and the longest that is kept.
CACHE_WORDS, CACHE_CHARS = 1_000_000, 48
#: The tokenizer's own pattern (a fixed value) for what stands between letters in lower-case texts without ``OTHER``.
LETTERS = "a-zªµºß-öø-ɏ"
BETWEEN = rf"('s|'t|'re|'ve|'m|'ll|'d|[0-9]|[^{LETTERS}0-9 \t\n\r]+)"
#: Characters whose class or lower case may differ between libraries, and the start of special tokens.
OTHER = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\xa0²³¹¼½¾İ" + "\u0250-\U0010ffff" + r"]|<\|"
DEFAULT_VOCABULARY = "word_bpe_49k.json"
#: How a tokenizer normalises and cuts whose texts may be cut into words here (fixed values of its file).
NORMALISES = ["NFC", "Replace", "Lowercase"]
CUTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_VOCABULARY)


def _cuts_into_words(settings: dict) -> bool:
    normaliser, cutter = settings.get("normalizer") or {}, settings.get("pre_tokenizer") or {}
    steps = [x.get("type") for x in normaliser.get("normalizers", [])]
    cuts = [(x.get("type"), x.get("pattern", {}).get("Regex")) for x in cutter.get("pretokenizers", [])]
    added = all(x["content"].startswith("<|") for x in settings.get("added_tokens", []))
    return added and steps == NORMALISES and cuts == [("Split", CUTS), ("ByteLevel", None)] and settings["model"].get("type") == "BPE"


class WordEncoder:
    """``encode(texts)``: for each text its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or default_path())
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.by_word = _cuts_into_words(json.loads(self.tokenizer.to_str()))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if not self.by_word:
            return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
        lower = [t.lower() if t else "" for t in texts]
        found = pa.array(lower, pa.large_string())
        unlike = pc.match_substring_regex(found, OTHER)
        spaced = pc.replace_substring_regex(pc.if_else(unlike, "", found), BETWEEN, r" \1 ")
        lists = pc.ascii_split_whitespace(spaced)
        words = lists.flatten().dictionary_encode()
        # of each word its ids, one after another, picked from those of the distinct ones
        own = pa.array(self._looked_up(self.words, words.dictionary.to_pylist(), self._together), pa.large_binary())
        ids = own.take(words.indices)
        out = [b""] * len(texts)
        if len(ids):
            _, offsets, data = ids.buffers()
            cuts = np.frombuffer(offsets, "<i8")[lists.offsets.to_numpy()].tolist()
            out = [data[i:j].to_pybytes() for i, j in zip(cuts, cuts[1:])]
        for i in np.flatnonzero(unlike.to_numpy(zero_copy_only=False)).tolist():
            pieces = texts[i].replace("\n", " ").split(" ")
            distinct = list(dict.fromkeys(pieces))
            ids_of = dict(zip(distinct, self._looked_up(self.pieces, distinct, self._apart)))
            out[i] = b"".join(map(ids_of.__getitem__, pieces))
        return out

    def _together(self, words: list[str], size: int = 64) -> None:
        """Learns words that the pattern cuts, many in one text: each ends with the one token that ends words."""
        groups = [words[i : i + size] for i in range(0, len(words), size)]
        for own, e in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            ends = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(ends) == len(own):
                raw = ids.tobytes()
                self.words.update(zip(own, [raw[i:j] for i, j in zip([0, *ends], ends)]))
            else:
                for word, one in zip(own, self.tokenizer.encode_batch_fast(own, add_special_tokens=False)):
                    self.words[word] = array("I", one.ids).tobytes()

    def _apart(self, pieces: list[str]) -> None:
        """Learns pieces of any characters, each as a text."""
        for piece, e in zip(pieces, self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)):
            self.pieces[piece] = array("I", e.ids).tobytes()

    def _looked_up(self, known: dict[str, bytes], parts: list[str], learn) -> list[bytes]:
        """Ids of distinct ``parts`` from the cache ``known``; before it grows too large it starts anew, with those at hand."""
        if len(known) + len(parts) > CACHE_WORDS:
            kept = {p: known[p] for p in parts if p in known}
            known.clear()
            known.update(kept)
        missing = [p for p in parts if p not in known]
        if missing:
            learn(missing)
        out = list(map(known.__getitem__, parts))
        for p in missing:
            if len(p) > CACHE_CHARS:
                del known[p]
        return out


_encoders: dict[str | None, WordEncoder] = {}


def encoder(path: str | None = None) -> WordEncoder:
    """This worker's encoder; made once, its cache serves later tasks too."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
