"""BPE encoding and decoding with a public vocabulary file (operator 3).

Each word's symbols form a doubly linked list. A priority queue holds the merges that
are possible, by rank and then by place; an entry whose symbols have changed since it
was pushed is stale and is skipped. Decoding concatenates the vocabulary's strings.

The work is row-local, so the plan is one scan with one Arrow stage and no shuffle.

Defined results: a null text counts as empty and has no tokens; repeated rows give
repeated results; extra columns are ignored. Letters and digits are what the ``regex``
module calls so; for characters assigned after Unicode 15.1 libraries differ.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from gleaner.llm.common import lean, small_batches

#: Words that a task remembers; at this many it starts anew, so memory is bounded.
CACHED_WORDS = 300_000


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(spare)) for b in range(256)]


def merge_word(ids: list[int], ranks: dict[int, int], made: list[int]) -> list[int]:
    """Merge neighbours, lowest rank first and leftmost among equals, until none is left.

    ``ranks`` has the rank of a pair ``left << 20 | right``, ``made`` the id that each rank
    makes. A queue entry is ``rank << 32 | place``; it is stale if the pair now at its place
    has another rank, which a pair with other symbols always has.
    """
    rank = ranks.get
    queue = []
    for i in range(len(ids) - 1):
        r = rank(ids[i] << 20 | ids[i + 1])
        if r is not None:
            queue.append(r << 32 | i)
    if not queue:
        return ids
    if len(queue) > 1:
        heapq.heapify(queue)
    n = len(ids)
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    right[-1] = -1
    pop, push = heapq.heappop, heapq.heappush
    while queue:
        entry = pop(queue)
        r, i = entry >> 32, entry & 0xFFFFFFFF
        j = right[i]
        if ids[i] < 0 or j < 0 or rank(ids[i] << 20 | ids[j]) != r:
            continue  # stale
        ids[i], ids[j] = made[r], -1
        after = right[i] = right[j]
        if after >= 0:
            left[after] = i
            r = rank(ids[i] << 20 | ids[after])
            if r is not None:
                push(queue, r << 32 | i)
        before = left[i]
        if before >= 0:
            r = rank(ids[before] << 20 | ids[i])
            if r is not None:
                push(queue, r << 32 | before)
    return [s for s in ids if s >= 0]


class WordBpe:
    """A tokenizer file with a BPE model, word-end marks and no decoder."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model.get("end_of_word_suffix") or ""
        pairs = (tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"])
        self.ranks: dict[int, int] = {}
        self.made: list[int] = []
        for rank, (a, b) in enumerate(pairs):
            self.ranks[self.vocab[a] << 20 | self.vocab[b]] = rank
            self.made.append(self.vocab[a + b])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in [*self.vocab.items(), *self.special.items()]}
        alphabet = byte_alphabet()
        self.inner, self.last = ([self.vocab[c + end] for c in alphabet] for end in ("", self.end))
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"]).findall
        names = sorted(self.special, key=len, reverse=True)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        #: What all added tokens have, if they have it: a text without it has none of them.
        self.hint = "<|" if all("<|" in n for n in names) else ""
        self.cache: dict[str, tuple[str, int, str]] = {}

    def normal(self, text: str) -> str:
        """The file's normalizers: composed form, runs of space as one, each letter lowered alone."""
        text = text if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def word_ids(self, word: str) -> list[int]:
        data = word.encode()
        inner = self.inner
        ids = [inner[b] for b in data]
        ids[-1] = self.last[data[-1]]
        return merge_word(ids, self.ranks, self.made)

    def word(self, word: str) -> tuple[str, int, str]:
        """Ids and vocabulary strings of a word, each joined by a space, and their number."""
        ids = self.word_ids(word)
        if len(self.cache) >= CACHED_WORDS:
            self.cache.clear()
        got = self.cache[word] = (" ".join(map(str, ids)), len(ids), " ".join(self.strings[i] for i in ids))
        return got

    def pieces(self, text: str) -> list[tuple[str, int, str]]:
        get, word = self.cache.get, self.word
        if not (self.marks and self.hint in text):
            return [get(w) or word(w) for w in self.words(self.normal(text))]
        out: list[tuple[str, int, str]] = []
        for part in self.marks.split(text):
            if part in self.special:
                out.append((str(self.special[part]), 1, part))
            else:
                out += [get(w) or word(w) for w in self.words(self.normal(part))]
        return out

    def encode(self, text: str) -> list[int]:
        return [int(i) for ids, _, _ in self.pieces(text) for i in ids.split()]

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.strings[i] for i in ids)


_loaded: dict[str, WordBpe] = {}


def loaded(path: str) -> WordBpe:
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


def encode(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per document: key, ``n_tokens``, ``ids`` array<int> and ``decoded_sha256``, of the text that the ids give back."""
    small_batches(docs.sparkSession)

    def run(batches):
        bpe = loaded(path)
        for batch in batches:
            n, ids, decoded = [], [], []
            for t in batch.column(1).to_pylist():
                found = bpe.encode(t or "")
                n.append(len(found))
                ids.append(found)
                decoded.append(hashlib.sha256(bpe.decode(found).encode()).hexdigest())
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())], names=[key, "n_tokens", "ids", "decoded_sha256"])
        bpe.cache.clear()

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(lean(run), f"`{key}` {kind}, n_tokens long, ids array<int>, decoded_sha256 string")


def digests(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per document: key, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``; ids stay in the worker."""
    small_batches(docs.sparkSession)

    def run(batches):
        bpe = loaded(path)
        for batch in batches:
            n, ids, decoded = [], [], []
            for t in batch.column(1).to_pylist():
                found = bpe.pieces(t or "")
                n.append(sum([p[1] for p in found]))
                ids.append(hashlib.sha256(" ".join([p[0] for p in found]).encode()).hexdigest())
                decoded.append(hashlib.sha256(" ".join([p[2] for p in found]).encode()).hexdigest())
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])
        bpe.cache.clear()

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(lean(run), f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
