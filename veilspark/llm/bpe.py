"""Problem 6: the whole corpus as ids of a public byte-level BPE tokenizer.

Merge replay. The words of a block of the corpus (all documents of an Arrow block, each distinct word once) lie in one
symbol array; an inverted index leads from a token pair, named by the rank of its merge, to the places where it stands.
The merges are applied in rank order, each to all its places at once, and only the neighbours of a merged place are
indexed anew. A merge can only form pairs of higher rank than its own, so one pass over the ranks gives what a search
for the lowest pair word by word gives. Words are independent, so a corpus splits into blocks without any exchange.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.forms import blocks

#: Folder of the vocabulary files, which are not part of this repository.
TOKENIZERS = os.environ.get("VEILSPARK_TOKENIZERS", "/opt/tokenizers")
#: Fixed value: how this tokenizer cuts a text into words before merging.
WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "byte_bpe_50k"


class MergeReplay:
    """Encoder of distinct words by replaying the merges over an inverted index of pairs."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        self.rank = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.token = {rank: token for token, rank in self.rank.items()}
        self.of_byte = np.array([self.rank[bytes([b])] for b in range(256)], np.int64)
        self.first = np.array([[self.rank.get(bytes([a, b]), -1) for b in range(256)] for a in range(256)], np.int64)
        self.joined: dict[int, int] = {}

    def _join(self, a: int, b: int) -> int:
        key = a << 20 | b
        found = self.joined.get(key)
        if found is None:
            if len(self.joined) > 500_000:  # keeps the memory of a worker bounded
                self.joined.clear()
            found = self.joined[key] = self.rank.get(self.token[a] + self.token[b], -1)
        return found

    def encode(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word, none of which may be empty."""
        if not words:
            return []
        raw = np.frombuffer(b"".join(words), np.uint8)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        last = np.cumsum(lengths) - 1
        rank = np.full(len(raw), -1, np.int64)
        rank[:-1] = self.first[raw[:-1], raw[1:]]
        rank[last] = -1
        at = np.nonzero(rank >= 0)[0]
        at = at[np.argsort(rank[at], kind="stable")]
        ranks, cuts = np.unique(rank[at], return_index=True)
        index = dict(zip(ranks.tolist(), (part.tolist() for part in np.split(at, cuts[1:])), strict=True)) if len(ranks) else {}
        symbol = self.of_byte[raw].tolist()
        after = np.arange(1, len(raw) + 1)
        after[last] = -1
        before = np.arange(-1, len(raw) - 1)
        before[np.concatenate([[0], last[:-1] + 1])] = -1
        after, before, current = after.tolist(), before.tolist(), rank.tolist()
        queue = list(index)
        heapify(queue)
        join = self._join
        while queue:
            merged = heappop(queue)
            for i in sorted(index.pop(merged)):
                # current[i] is the rank of the pair that starts at i now; a touched or swallowed place no longer has this one.
                if current[i] != merged:
                    continue
                j = after[i]
                symbol[i] = merged
                k = after[i] = after[j]
                current[j] = -1
                symbol[j] = -1
                if k >= 0:
                    before[k] = i
                    new = current[i] = join(merged, symbol[k])
                    if new >= 0:
                        places = index.get(new)
                        if places is None:
                            index[new] = [i]
                            heappush(queue, new)
                        else:
                            places.append(i)
                else:
                    current[i] = -1
                h = before[i]
                if h >= 0:
                    new = current[h] = join(symbol[h], merged)
                    if new >= 0:
                        places = index.get(new)
                        if places is None:
                            index[new] = [h]
                            heappush(queue, new)
                        else:
                            places.append(h)
        flat = np.array(symbol, np.int64)
        kept = flat >= 0
        ends = np.cumsum(kept)[last]
        return [part.tolist() for part in np.split(flat[kept], ends[:-1])]


@cache
def replay(folder: str, name: str) -> MergeReplay:
    return MergeReplay(os.path.join(folder, f"{name}.tiktoken"))


def encode_block(texts: list[str | None], folder: str = TOKENIZERS, name: str = VOCABULARY) -> list[list[int]]:
    """Ids of each text of a block; the merges run once over its distinct words."""
    import regex

    cut = regex.compile(WORDS)
    number: dict[str, int] = {}
    split = [[number.setdefault(w, len(number)) for w in cut.findall(t)] if t else [] for t in texts]
    ids = replay(folder, name).encode([w.encode("utf-8", "surrogatepass") for w in number])
    return [[x for w in words for x in ids[w]] for words in split]


def token_ids(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """Columns ``doc_id, ids array<int>``: one row per input row; an empty or null text has an empty list.

    Text that spells a special token is ordinary text. Other columns, whatever their names, are not read.
    """
    source = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            ids = encode_block(b.column("text").to_pylist(), folder, name)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, ids array<int>")


def token_counts(df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = (), folder: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """The columns ``keep`` and ``tokens bigint``, the length of a text in ids; null and empty texts count 0."""
    source = df.select(F.struct(*[F.col(k) for k in keep]).alias("kept"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            n = [len(x) for x in encode_block(b.column("text").to_pylist(), folder, name)]
            yield pa.RecordBatch.from_arrays([b.column("kept"), pa.array(n, pa.int64())], ["kept", "tokens"])

    kind = source.schema["kept"].dataType.simpleString()
    return source.mapInArrow(run, f"kept {kind}, tokens bigint").select("kept.*", "tokens")
