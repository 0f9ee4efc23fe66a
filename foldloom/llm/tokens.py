"""A whole corpus as token ids of a public byte-level BPE (problem 7).

The encoding of a word is settled by the last token of each of its prefixes: a token may end a prefix if it can follow
the last token of the rest, which holds exactly where the two alone encode to themselves. So the distinct words of a
batch are walked as a trie, depth first in sorted order, and what was settled for a shared prefix is kept for all words
that begin with it. Nothing is shuffled: each task encodes the documents it reads.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
# fixed by the vocabulary: how it cuts text into words
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ASCII_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"
KNOWN_WORDS = 1 << 19  # words whose encoding a worker keeps
KNOWN_PAIRS = 1 << 20  # pairs of tokens of which it keeps whether the second may follow the first


class Encoder:
    """Words to token ids, with the words seen so far."""

    def __init__(self, path: str, known_words: int = KNOWN_WORDS):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
        self.longest, self.tokens = max(map(len, self.ranks)), {rank: token for token, rank in self.ranks.items()}
        self.known_words, self.known = known_words, {}
        self.follows: dict[int, bool] = {}
        self.cut_any, self.cut_ascii = regex.compile(PATTERN).findall, re.compile(ASCII_PATTERN, re.ASCII).findall

    def may_follow(self, a: int, b: int) -> bool:
        """Whether merging the bytes of the tokens a and b by rank ends in just these two."""
        key = a << 32 | b
        seen = self.follows.get(key)
        if seen is None:
            ranks, first, second = self.ranks, self.tokens[a], self.tokens[b]
            parts = [bytes([x]) for x in first + second]
            while len(parts) > 1:
                rank, i = min((ranks.get(parts[i] + parts[i + 1], 1 << 32), i) for i in range(len(parts) - 1))
                if rank == 1 << 32:
                    break
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            if len(self.follows) >= KNOWN_PAIRS:
                self.follows.clear()
            seen = self.follows[key] = parts == [first, second]
        return seen

    def learn(self, words: list[str]) -> None:
        """Encodes words, sorted as bytes; the state of a prefix that the next word shares is kept."""
        rank_of, longest, known, tokens, follows = self.ranks.get, self.longest, self.known, self.tokens, self.may_follow
        path, last = b"", [-1]  # last[i]: last token of path[:i]
        for raw, word in sorted((w.encode(), w) for w in words):
            whole = rank_of(raw)
            if whole is not None:
                known[word] = (whole,)
                continue
            shared, most = 0, min(len(path), len(raw))
            while shared < most and path[shared] == raw[shared]:
                shared += 1
            del last[shared + 1 :]
            for end in range(shared + 1, len(raw) + 1):
                for begin in range(max(0, end - longest), end):
                    token = rank_of(raw[begin:end])
                    if token is not None and (not begin or follows(last[begin], token)):
                        last.append(token)
                        break
            path, ids, end = raw, [], len(raw)
            while end:
                ids.append(last[end])
                end -= len(tokens[last[end]])
            known[word] = tuple(reversed(ids))

    def words(self, text: str) -> list[str]:
        return (self.cut_ascii if text.isascii() else self.cut_any)(text)

    def cut(self, texts: list[str | None]) -> list[list[str]]:
        """The words of each text, all of them known by then."""
        if len(self.known) > self.known_words:
            self.known.clear()
        cut = [self.words(t) if t else [] for t in texts]
        self.learn(list(set(chain.from_iterable(cut)).difference(self.known)))
        return cut

    def ids(self, texts: list[str | None]) -> list[list[int]]:
        cut = self.cut(texts)
        get = self.known.__getitem__
        return [list(chain.from_iterable(map(get, words))) for words in cut]


@lru_cache(2)
def encoder(folder: str, vocabulary: str) -> Encoder:
    """One for each Python worker, kept over tasks."""
    return Encoder(str(Path(folder) / vocabulary))


def encode_corpus(df: DataFrame, doc_id: str, text: str, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id and ids, the token ids of the whole text without special tokens; empty for null and empty texts.

    Strings that look like special tokens are ordinary text. Rows with repeated or null doc_id each give a row; an
    empty table gives no rows; other columns are ignored. The vocabulary file is read on the executors from folder.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(folder, vocabulary)
        for batch in batches:
            cut = e.cut(batch.column("text").to_pylist())
            get = e.known.__getitem__
            parts = [list(map(get, words)) for words in cut]
            sizes = np.fromiter((sum(map(len, p)) for p in parts), np.int64, len(parts))
            offsets = np.zeros(len(parts) + 1, np.int32)
            np.cumsum(sizes, out=offsets[1:])
            flat = np.fromiter(chain.from_iterable(chain.from_iterable(parts)), np.int32, int(offsets[-1]))
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], names=["doc_id", "ids"])

    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def count_tokens(df: DataFrame, doc_id: str, text: str, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id and n_tokens, in the way of encode_corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(folder, vocabulary)
        for batch in batches:
            cut = e.cut(batch.column("text").to_pylist())
            get = e.known.__getitem__
            n = pa.array([sum(map(len, map(get, words))) for words in cut], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), n], names=["doc_id", "n_tokens"])

    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens bigint")
