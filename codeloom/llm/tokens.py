"""Token ids of whole texts for byte-level BPE tokenizers, as their library gives them."""

from __future__ import annotations

import functools
import hashlib
import json

import numpy as np

from .bpe import CACHE_WORDS, Automaton

#: The public split pattern of byte-level pre-tokenizers (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes: printable Latin-1 for itself, all others from 256 on in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(rest)}


@functools.lru_cache(4)
def by_rank(spec_json: str) -> bool:
    """Whether merging by the rank of the whole gives what the merge list gives.

    It does if no token can arise from two neighbours other than those of its rule: the automaton
    tells, for every other split of every token, whether its parts can be neighbours then.
    """
    spec = json.loads(spec_json)
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    if spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or model.get("ignore_merges") or model.get("end_of_word_suffix") or model.get("continuing_subword_prefix"):
        return False
    a = Automaton(spec)
    if any(a.made[t] + 256 != t for t in a.made):
        return False
    for token, i in a.vocab.items():
        for k in range(1, len(token)):
            x, y = a.vocab.get(token[:k]), a.vocab.get(token[k:])
            if x is not None and y is not None and i in a.parts and (x, y) != a.parts[i] and a._arc(x, y, a.made[i]):
                return False
    return True


class Ids:
    """Ids of whole texts as bytes of `dtype`; each new word goes to a library once, then to a table."""

    def __init__(self, spec_json: str, ranked: bool):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_str(spec_json)
        self.lib.no_truncation()
        self.lib.no_padding()
        vocab = self.lib.get_vocab(with_added_tokens=True)
        self.dtype = "<u2" if max(vocab.values()) < 1 << 16 else "<u4"
        self.special = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.words: dict[str, bytes] = {}
        self.odd: set[str] = set()
        self.ranked = None
        if ranked:
            import tiktoken

            letters = byte_letters()
            ranks = {bytes(letters[c] for c in t): i for t, i in json.loads(spec_json)["model"]["vocab"].items()}
            self.ranked = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def ids(self, text: str) -> bytes:
        """The ids of one text."""
        if self.ranked is None or "  " in text or "\n\n" in text or " \n" in text or "\n " in text or ("<|" in text and any(s in text for s in self.special)):
            return self._whole(text)
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
            self.odd.clear()
        first, *words = text.replace("\n", " \n").split(" ")
        known = self.words
        for w in set(words).difference(known):
            bare = w[1:] if w[:1] == "\n" else w
            if bare != bare.strip():
                self.odd.add(w)  # other white space at an edge: its neighbours matter
            known[w] = np.array(self.ranked(w if w[:1] == "\n" else " " + w), self.dtype).tobytes()
        if first != first.rstrip() or (self.odd and not self.odd.isdisjoint(words)):
            return self._whole(text)
        head = np.array(self.ranked(first), self.dtype).tobytes() if first else b""
        return head + b"".join(map(known.__getitem__, words))

    def _whole(self, text: str) -> bytes:
        return np.array(self.lib.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()


_made: dict[str, Ids] = {}


def worker_ids(spec_json: str, ranked: bool) -> Ids:
    """The worker's table for this tokenizer; a worker keeps it from task to task."""
    key = hashlib.md5(spec_json.encode()).hexdigest()
    if key not in _made:
        _made.clear()
        _made[key] = Ids(spec_json, ranked)
    return _made[key]


def shared_spec(spark, tokenizer: str):
    """(broadcast JSON, ranked) of a tokenizer file, read on the driver; its size is that of the file."""
    with open(tokenizer, encoding="utf-8") as f:
        text = f.read()
    return spark.sparkContext.broadcast(text), by_rank(text)
