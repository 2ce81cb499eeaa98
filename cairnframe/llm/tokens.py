"""Token counts by heap-and-linked-list byte-pair merging (operator 1).

A word is a linked list of symbols and a heap of its adjacent pairs by merge rank.  The lowest-rank pair is popped and
merged until none is left; the count is the initial symbols minus the merges.  No identifiers are made.  The count of a
space-delimited piece of text does not depend on what stands around it, so pieces are counted once per worker and
remembered in two generations of a table of bounded size.  Letters beyond ASCII are normalised and split by the
library's own tables, whatever Unicode version they are; merging is done here.

Defined results: null or empty text has 0 bytes and 0 tokens; a special string inside a text is one token, as the
vocabulary file says; of pairs with equal rank the leftmost is merged first; equal rows give equal results; very long
texts are counted whole; a null doc_id stays null; other columns are ignored, whatever their names; an empty table gives
no rows.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

LIMIT = 2048
#: Pieces remembered by a worker in each of two generations.
REMEMBER = 400_000


def byte_symbols() -> list[str]:
    """The printable symbol of each byte in byte-level vocabularies: itself where printable, else from 256 on in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def count_merges(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """The symbols left of a word after all merges."""
    n = len(symbols)
    if n < 2:
        return n
    text, right, left = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    heap = [(r, i, text[i], text[i + 1]) for i in range(n - 1) if (r := ranks.get((text[i], text[i + 1]))) is not None]
    heapq.heapify(heap)
    merges = 0
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = right[i]
        if not alive[i] or j >= n or text[i] != a or text[j] != b:
            continue  # one side has changed since
        text[i] = a + b
        alive[j] = False
        right[i] = k = right[j]
        if k < n:
            left[k] = i
            if (r := ranks.get((text[i], text[k]))) is not None:
                heapq.heappush(heap, (r, i, text[i], text[k]))
        if (h := left[i]) >= 0 and (r := ranks.get((text[h], text[i]))) is not None:
            heapq.heappush(heap, (r, h, text[h], text[i]))
        merges += 1
    return n - merges


class Counter(dict):
    """Tokens of each space-delimited piece, counted on first sight."""

    def __init__(self, path: str, remember: int = REMEMBER):
        import regex
        from tokenizers import Tokenizer

        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        library = Tokenizer.from_file(path)
        self.normal, self.split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        model = spec["model"]
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.ranks = {(a, b): r for r, (a, b) in enumerate(pairs)}
        self.suffix = model["end_of_word_suffix"] or ""
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        splits = [p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        self.pattern = regex.compile(splits[0])
        self.symbols = byte_symbols()
        self.remember = remember
        self.words: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def __missing__(self, piece: str) -> int:
        if (n := self.older.get(piece)) is not None:
            self[piece] = n
            return n
        if len(self) >= self.remember:
            self.older = dict(self)
            self.clear()
        if self.special and "<|" in piece and (found := self.special.findall(piece)):
            n = len(found) + sum(map(self._plain, self.special.split(piece)))
        else:
            n = self._plain(piece)
        if len(piece) <= 64:
            self[piece] = n
        return n

    def _plain(self, piece: str) -> int:
        if not piece:
            return 0
        if not piece.isascii():
            return sum(self._word(w) for w, _ in self.split(self.normal(piece)))
        return sum(self._word("".join([self.symbols[b] for b in w.encode()])) for w in self.pattern.findall(piece.lower()))

    def _word(self, word: str) -> int:
        """Tokens of a word, given as the symbols of its bytes."""
        if (n := self.words.get(word)) is None:
            n = count_merges([*word[:-1], word[-1] + self.suffix], self.ranks)
            if len(self.words) >= self.remember:
                self.words.clear()
            if len(word) <= 64:
                self.words[word] = n
        return n

    def count(self, text: str) -> int:
        return sum(map(self.__getitem__, text.replace("\n", " ").split(" ")))


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """The counter of this worker; what it remembers outlives a task."""
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def token_counts(docs: DataFrame, vocabulary: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each document."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(vocabulary)
        for batch in batches:
            n_bytes, n_tokens = [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                n_bytes.append(len(text.encode()))
                n_tokens.append(own.count(text))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
