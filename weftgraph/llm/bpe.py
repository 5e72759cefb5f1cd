"""Byte-level BPE encoding and decoding by backtracking over longest matches.

The vocabulary's byte strings are mapped to Latin-1 text, one character a byte, and put into an Aho-Corasick automaton
whose leftmost-longest match gives the longest token at a position. A token sequence is what the merges would produce
exactly if every two neighbours are compatible, that is, if merging their joint bytes would keep the boundary between
them. The encoder takes the longest match, steps to shorter prefixes where a neighbour is not compatible, and marks
positions from which no encoding goes on, so each position is left at most once: linear time. Compatibility is memoised.

Defined cases: null is the empty text (no ids); special-token strings are ordinary text.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import SLICE_ROWS, slices
from weftgraph.llm.pretokens import splitter

#: Pieces kept in a worker's memo before it is emptied.
MEMO = 200_000


class BytePairCoder:
    """Encoder and decoder for ranks in the tiktoken text format (base64 bytes, rank)."""

    def __init__(self, ranks: bytes, pattern: str):
        lines = (line.split() for line in ranks.splitlines() if line)
        self.ids = {base64.b64decode(a).decode("latin-1"): int(b) for a, b in lines}
        self.strings = {i: s for s, i in self.ids.items()}
        self.bytes = {str(i): s.encode("latin-1") for s, i in self.ids.items()}
        self.find = splitter(pattern)
        self.trie = ahocorasick.Automaton()
        for s, i in self.ids.items():
            self.trie.add_word(s, i)
        self.trie.make_automaton()
        self.shorter: dict[int, int | None] = {i: self._longest_proper_prefix(s) for s, i in self.ids.items()}
        self.merged: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.memo_pairs: dict[tuple[int, int], bool] = {}
        for i in sorted(self.strings):
            self._learn(i)
        self.memo_pairs.clear()
        self.memo: dict[str, str] = {}

    def _longest_proper_prefix(self, s: str) -> int | None:
        return next((self.ids[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in self.ids), None)

    def _learn(self, i: int) -> None:
        """The two tokens whose merge makes token i: the only compatible pair of lower ranks that spells it."""
        s, left = self.strings[i], self.shorter[i]
        while left is not None:
            right = self.ids.get(s[len(self.strings[left]) :])
            if right is not None and left < i and right < i and self._boundary_holds(left, right):
                self.merged[left, right], self.halves[i] = i, (left, right)
                return
            left = self.shorter[left]

    def _boundary_holds(self, left: int, right: int) -> bool:
        """Whether no merge goes across the boundary of two adjacent tokens.

        Their merges are undone latest first. A token across the boundary would have been made if its rank precedes
        the merge that is undone next on either side.
        """
        before = float("inf")
        while True:
            across = self.merged.get((left, right))
            if across is not None and across < before:
                return False
            undo_left, undo_right = left in self.halves, right in self.halves
            if not (undo_left or undo_right):
                return True
            if undo_left and (not undo_right or left > right):
                before, left = left, self.halves[left][1]
            else:
                # Of merges with one rank the left one comes first, so one across still wins against its equal at right.
                before, right = right + 1, self.halves[right][0]

    def compatible(self, left: int, right: int) -> bool:
        known = self.memo_pairs.get((left, right))
        if known is None:
            if len(self.memo_pairs) >= MEMO:
                self.memo_pairs.clear()
            known = self.memo_pairs[left, right] = self._boundary_holds(left, right)
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        s = piece.decode("latin-1")
        whole = self.ids.get(s)
        if whole is not None:
            return [whole]
        size, strings, shorter, longest = len(s), self.strings, self.shorter, self.trie.iter_long
        dead, out, at = bytearray(size + 1), [], 0
        token = next(longest(s))[1]
        while at < size:
            end = at + len(strings[token])
            if not dead[end] and (not out or self.compatible(out[-1], token)):
                out.append(token)
                at = end
                if at < size:
                    token = next(longest(s, at))[1]
                continue
            token = shorter[token]
            if token is None:
                dead[at] = 1
                token = out.pop()
                at -= len(strings[token])
        return out

    def _piece(self, piece: str) -> str:
        if len(self.memo) >= MEMO:
            self.memo.clear()
        known = " ".join(map(str, self.encode_piece(piece.encode())))
        if len(piece) <= 64:
            self.memo[piece] = known
        return known

    def encode(self, text: str) -> str:
        """Decimal ids of a text, joined by one space."""
        memo, miss = self.memo, self._piece
        return " ".join([memo.get(p) or miss(p) for p in self.find(text)])

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids.split(" "))) if ids else b""


@functools.lru_cache(maxsize=2)
def coder(ranks: bytes, pattern: str) -> BytePairCoder:
    """One per Python worker."""
    return BytePairCoder(ranks, pattern)


def ranks_bytes(path: str | None = None) -> bytes:
    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return f.read()


def encode_documents(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, ids (decimal, joined by one space), decoded (binary), one row per input row."""
    shipped = docs.sparkSession.sparkContext.broadcast(ranks_bytes(path))  # the vocabulary file, under 1 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with_ranks = coder(shipped.value, pattern)
        for batch in slices(batches, SLICE_ROWS):
            ids = [with_ranks.encode(t) if t else "" for t in batch.column(1).to_pylist()]
            yield pa.record_batch({"doc_id": batch.column(0), "ids": pa.array(ids, pa.string()), "decoded": pa.array([with_ranks.decode(x) for x in ids], pa.binary())})

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, ids string, decoded binary")


def op5(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Digests of the ids and of the decoded bytes."""
    shipped = docs.sparkSession.sparkContext.broadcast(ranks_bytes(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with_ranks = coder(shipped.value, public_tokenizers.PATTERN)
        for batch in slices(batches, SLICE_ROWS):
            n, a, b = [], [], []
            for t in batch.column(1).to_pylist():
                ids = with_ranks.encode(t) if t else ""
                n.append(ids.count(" ") + 1 if ids else 0)
                a.append(hashlib.sha256(ids.encode()).hexdigest())
                b.append(hashlib.sha256(with_ranks.decode(ids)).hexdigest())
            yield pa.record_batch({"doc_id": batch.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(a, pa.string()), "decoded_sha256": pa.array(b, pa.string())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
