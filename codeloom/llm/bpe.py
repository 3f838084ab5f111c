"""BPE encoding and decoding by a tokenization automaton.

The automaton reads token symbols and accepts exactly the sequences that the merge list yields. It
starts with one state from which every base symbol leads back to it, and takes in the merges one
after another. The gadget of rule number T, a + b -> c: wherever an arc a leads to a state with an
arc b, an arc c is added beside a, leading where b leads; and the state that a leads to loses its
arc b. (If a = b, no arc c is added to the state behind a, as pairs are merged from the left.) The
state that a symbol leads to depends on that symbol alone, so a state is named by the last token
read. Arcs are not listed: `arc(x, y)` unrolls the gadgets for one pair, backwards through the
rules that made x and y, and the answers are kept in a transition table that fills on demand.

A word is encoded from left to right: at each place, the automaton has exactly one state that the
symbols so far can lead to, found among the tokens that end there (a trie of reversed tokens) by
their arcs. The path back gives the tokens. Decoding emits the label of each arc.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import small_batches

#: A worker forgets its words, and its pre-split pieces, beyond these numbers, so that its memory stays bounded.
CACHE_WORDS, CACHE_PIECES = 400_000, 600_000

ASCII = re.compile("\n?[!-~]*")
#: How the lower-casing word tokenizer splits printable ASCII (fixed values).
ASCII_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")


class Automaton:
    """Compiled from the JSON of a BPE tokenizer with an end-of-word suffix or none."""

    def __init__(self, spec: dict):
        model = spec["model"]
        vocab = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.label = {i: t for t, i in vocab.items()}
        self.rule: dict[tuple[int, int], int] = {}
        self.made: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.vocab = vocab
        for n, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            whole = vocab[a + b]
            x, y = vocab[a], vocab[b]
            self.rule[x, y] = n
            self.made.setdefault(whole, n)
            self.parts.setdefault(whole, (x, y))
        symbols = set()
        self.spelling: dict[int, tuple[int, ...]] = {}
        for t in vocab.values():
            self._spell(t)
        for s in self.spelling.values():
            symbols.update(s)
        self.symbols = symbols
        self.trie: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        for t, s in self.spelling.items():
            at = 0
            for x in reversed(s):
                if x not in self.trie[at]:
                    self.trie[at][x] = len(self.trie)
                    self.trie.append({})
                    self.token.append(-1)
                at = self.trie[at][x]
            self.token[at] = t
        by_spelling = {x: t for t, x in self.spelling.items()}
        #: Token and symbol -> the token that is one symbol longer.
        self.longer = {by_spelling[x[:-1]] << 20 | x[-1]: t for t, x in self.spelling.items() if x[:-1] in by_spelling}
        self.table: dict[int, bool] = {}

    def _spell(self, t: int) -> tuple[int, ...]:
        """The base symbols of a token."""
        if t not in self.spelling:
            stack = [t]
            while stack:
                x = stack[-1]
                if x in self.parts:
                    todo = [p for p in self.parts[x] if p not in self.spelling]
                    if todo:
                        stack += todo
                        continue
                    a, b = self.parts[x]
                    self.spelling[x] = self.spelling[a] + self.spelling[b]
                else:
                    self.spelling[x] = (x,)
                stack.pop()
        return self.spelling[t]

    def arc(self, x: int, y: int) -> bool:
        """Whether the finished automaton has an arc y in the state behind x."""
        k = x << 20 | y
        found = self.table.get(k)
        if found is None:
            found = self.table[k] = self._arc(x, y, 1 << 40)
        return found

    def _arc(self, x: int, y: int, before: int) -> bool:
        """The same for the automaton of the rules numbered under `before`."""
        while True:
            if self.rule.get((x, y), before) < before:
                return False  # a gadget took this arc away
            tx, ty = self.made.get(x, -1), self.made.get(y, -1)
            if tx < 0 and ty < 0:
                return True  # an arc of the first automaton
            if tx > ty:
                x, before = self.parts[x][1], tx  # the state behind x was copied from the one behind its right part
            else:
                a, b = self.parts[y]
                if x == y and ty >= 0:
                    # c beside c: c was added where a was allowed behind b
                    x, y, before = b, a, ty
                    continue
                if a == b and x == a:
                    return False  # pairs of equals are merged from the left
                y, before = a, ty  # arc y was added beside its left part

    def encode(self, symbols: list[int]) -> list[int]:
        """Token ids of one word, given as base symbols."""
        n = len(symbols)
        last, back = [-1] * (n + 1), [0] * (n + 1)
        trie, token, table, longer = self.trie, self.token, self.table, self.longer
        before, start = -1, 0
        for end in range(1, n + 1):
            # most often the last token grows by a symbol; the state is unique, so if that is a path it is the path
            t = longer.get(before << 20 | symbols[end - 1]) if before >= 0 else None
            if t is not None:
                if not start:
                    last[end] = before = t
                    continue
                k = last[start] << 20 | t
                ok = table.get(k)
                if ok is None:
                    ok = self.arc(last[start], t)
                if ok:
                    last[end] = before = t
                    back[end] = start
                    continue
            at, i = 0, end
            while i:
                at = trie[at].get(symbols[i - 1])
                if at is None:
                    break
                i -= 1
                t = token[at]
                if t >= 0:
                    if not i:
                        last[end], back[end] = t, 0
                        break
                    k = last[i] << 20 | t
                    ok = table.get(k)
                    if ok is None:
                        ok = self.arc(last[i], t)
                    if ok:
                        last[end], back[end] = t, i
                        break
            before, start = last[end], back[end]
        out = []
        at = n
        while at:
            out.append(last[at])
            at = back[at]
        return out[::-1]

    def word(self, piece: str) -> list[int]:
        """Token ids of one pre-split word in the vocabulary's byte letters; symbols outside the vocabulary are dropped."""
        v = self.vocab
        if not self.suffix:
            return self.encode([v[c] for c in piece if c in v])
        s = [v[c] for c in piece[:-1] if c in v]
        if (z := piece[-1:] + self.suffix) in v:
            s.append(v[z])
        return self.encode(s)


class Coder:
    """Whole texts to ids and back, with the tokenizer's own normaliser and pre-tokenizer for each new word.

    Words are cut at single spaces and before newlines, which no normalised token crosses.
    """

    def __init__(self, spec_json: str):
        from tokenizers import Tokenizer

        spec = json.loads(spec_json)
        self.lib = Tokenizer.from_str(spec_json)
        self.auto = Automaton(spec)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.labels = self.auto.label | {i: t for t, i in self.special.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        probe = "\nThey'll've don't'S #12..ab'r3_x"  # printable ASCII can skip the library if it splits as ASCII_PIECES does
        norm = self.lib.normalizer.normalize_str(probe) if self.lib.normalizer else probe
        self.plain_ascii = [x for x, _ in self.lib.pre_tokenizer.pre_tokenize_str(norm)] == ASCII_PIECES.findall(probe.lower())
        self.id_bytes = {i: i.to_bytes(4, "little") for i in self.labels}
        self.label_bytes = {i: (" " + t).encode("utf-8") for i, t in self.labels.items()}
        self.pieces: dict[str, tuple[bytes, bytes]] = {}
        self.words: dict[str, bytes] = {}
        self.decoded: dict[str, bytes] = {}

    def _split(self, word: str) -> list[str]:
        """The word's pre-split pieces, in the vocabulary's byte letters."""
        if self.plain_ascii and ASCII.fullmatch(word):
            return ASCII_PIECES.findall(word.lower())
        norm = self.lib.normalizer.normalize_str(word) if self.lib.normalizer else word
        return [piece for piece, _ in self.lib.pre_tokenizer.pre_tokenize_str(norm)]

    def _new(self, word: str) -> None:
        ids, out = b"", b""
        for piece in self._split(word):
            got = self.pieces.get(piece)
            if got is None:
                path = self.auto.word(piece)
                got = self.pieces[piece] = b"".join(map(self.id_bytes.__getitem__, path)), b"".join(map(self.label_bytes.__getitem__, path))
            ids += got[0]
            out += got[1]
        self.words[word] = ids
        self.decoded[word] = out

    def code(self, text: str) -> tuple[bytes, bytes]:
        """(ids as little-endian uint32, the decoded text in UTF-8)."""
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
            self.decoded.clear()
        if len(self.pieces) > CACHE_PIECES:
            self.pieces.clear()
            self.auto.table.clear()
        if self.cut is None or "<|" not in text or not self.cut.search(text):
            ids, out = self._plain(text)
        else:
            all_ids, all_out = [], []
            for part in self.cut.split(text):
                if part in self.special:
                    all_ids.append(np.array([self.special[part]], "<u4").tobytes())
                    all_out.append((" " + part).encode("utf-8"))
                elif part:
                    ids, out = self._plain(part)
                    all_ids.append(ids)
                    all_out.append(out)
            ids, out = b"".join(all_ids), b"".join(all_out)
        return ids, out[1:]

    def _plain(self, text: str) -> tuple[bytes, bytes]:
        words = text.replace("\n", " \n").split(" ")
        known = self.words
        for w in set(words).difference(known):
            self._new(w)
        return b"".join(map(known.__getitem__, words)), b"".join(map(self.decoded.__getitem__, words))


_coders: dict[str, Coder] = {}


def coder(spec_json: str) -> Coder:
    """The worker's coder of this tokenizer; a worker keeps it from task to task."""
    key = hashlib.md5(spec_json.encode()).hexdigest()
    if key not in _coders:
        _coders.clear()
        _coders[key] = Coder(spec_json)
    return _coders[key]


def coded(docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", digests: bool = True) -> DataFrame:
    """Encode each row's whole text and decode it again.

    tokenizer: path of a tokenizer JSON, read on the driver. Null texts count as empty and give no
    ids. Out: the key and n_tokens, with ids_sha256 and decoded_sha256 (digests), or with ids
    (array) and decoded. Rows with equal keys give a row each; other columns are left behind.
    """
    spark = docs.sparkSession
    small_batches(spark)
    with open(tokenizer, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())

    def run(batches):
        c = coder(spec.value)
        for batch in batches:
            got = [c.code(x) for x in K.column(batch, "text").to_pylist()]
            n = pa.array([len(i) // 4 for i, _ in got], pa.int64())
            if digests:
                cols = [pa.array([hashlib.sha256(x[k]).hexdigest() for x in got], pa.string()) for k in (0, 1)]
            else:
                cols = [pa.array([np.frombuffer(i, "<u4").astype(np.int32) for i, _ in got], pa.list_(pa.int32())), pa.array([t.decode("utf-8") for _, t in got], pa.string())]
            yield pa.RecordBatch.from_arrays([K.column(batch, "key"), n, *cols], ["key", "n_tokens", *names])

    names = ["ids_sha256", "decoded_sha256"] if digests else ["ids", "decoded"]
    kind = docs.select(F.col(key)).schema[0].dataType.simpleString()
    src = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    out = src.mapInArrow(run, f"key {kind}, n_tokens bigint, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"))
    return out.withColumnRenamed("key", key)


def decoded(ids: DataFrame, tokenizer: str, column: str = "ids") -> DataFrame:
    """Rows of token ids with a column `decoded`: the labels of their arcs, joined by spaces; null ids give null."""
    with open(tokenizer, encoding="utf-8") as f:
        spec = json.loads(f.read())
    labels = {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
    names = ids.sparkSession.sparkContext.broadcast(labels)

    @F.pandas_udf("string")
    def label(col):
        return col.map(lambda x: None if x is None else " ".join(names.value[int(i)] for i in x))

    return ids.withColumn("decoded", label(F.col(column)))
