"""Greedy word-piece counts in linear time: a trie with failure links, run as an automaton over bytes.

A word's pieces are the longest known word beginning, then again and again the longest known continuation; a word
that can't be cut so counts as one unknown token. A node of the trie that has no edge for the next byte falls back along
its failure link, and what it has matched so far is popped as a fixed number of pieces; these numbers are worked out
once, when the automaton is built, so that a text costs one table look-up for each byte and no piece is ever built.
All words of a batch run in step; the few that are longer than LONG bytes are then run to their ends one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.arrow import Words, slices, small_batches, sums_by

MARK = "▁"
LONG = 256


@lru_cache(maxsize=2)
def pieces(path: str) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """(word beginnings, continuations) of a vocabulary file.

    *.model: a SentencePiece vocabulary, whose beginnings carry its word mark. Else a text file with a piece a line,
    whose continuations begin with ##.
    """
    if path.endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        found = [sp.id_to_piece(i) for i in plain]
        begin = [p[1:] for p in found if p.startswith(MARK)]
        rest = [p for p in found if not p.startswith(MARK)]
    else:
        with open(path, encoding="utf-8") as f:
            found = [line.rstrip("\r\n") for line in f]
        begin = [p for p in found if not p.startswith("##")]
        rest = [p[2:] for p in found if p.startswith("##")]
    usable = lambda p: p and MARK not in p and not any(c in " \t\n\x0b\x0c\r" for c in p)
    return tuple(sorted({p for p in begin if usable(p)})), tuple(sorted({p for p in rest if usable(p)}))


class Automaton:
    """follow[state * 256 + byte] is the next state and pops[...] the pieces popped on the way; at_end[state] is the
    number popped at a word's end, -1 where the word has no cut. State 0 is dead, 1 begins a word, 2 a continuation."""

    DEAD, BEGIN, REST = 0, 1, 2

    def __init__(self, begin: tuple[str, ...], rest: tuple[str, ...]):
        edges: list[dict[int, int]] = [{}, {}, {}]
        whole = [False] * 3
        for root, words in ((self.BEGIN, begin), (self.REST, rest)):
            for word in words:
                at = root
                for b in word.encode():
                    to = edges[at].get(b)
                    if to is None:
                        to = edges[at][b] = len(edges)
                        edges.append({})
                        whole.append(False)
                    at = to
                whole[at] = True
        n = len(edges)
        self.fail, self.popped = np.zeros(n, np.int32), np.zeros(n, np.int16)
        self.follow, self.pops = np.zeros((n, 256), np.int32), np.zeros((n, 256), np.int16)
        self.at_end = np.full(n, -1, np.int16)
        self.at_end[self.REST] = 0
        level = [self.REST, self.BEGIN]
        while level:
            below = []
            for at in level:  # shallow nodes first: a failure link leads to a shallower one
                back = self.fail[at]
                if back:
                    self.follow[at], self.pops[at] = self.follow[back], self.pops[back] + self.popped[at]
                    if self.at_end[back] >= 0:
                        self.at_end[at] = self.at_end[back] + self.popped[at]
                for b, to in edges[at].items():
                    if whole[to]:
                        self.fail[to], self.popped[to] = self.REST, 1
                    elif back:
                        self.fail[to], self.popped[to] = self.follow[back, b], self.pops[back, b] + self.popped[at]
                    below.append(to)
                for b, to in edges[at].items():
                    self.follow[at, b], self.pops[at, b] = to, 0
            level = below
        self.follow, self.pops = self.follow.ravel(), self.pops.ravel()

    def count(self, words: Words) -> np.ndarray:
        """Pieces of each word; -1 for a word without a cut."""
        size = words.end - words.start
        order = np.argsort(-size, kind="stable")
        start, left = words.start[order], np.bincount(size, minlength=1)
        state, seen = np.full(len(order), self.BEGIN, np.int32), np.zeros(len(order), np.int64)
        live = len(order)
        for k in range(min(int(size.max()), LONG) if len(size) else 0):
            live -= left[k]  # words of k bytes end here
            at = state[:live].astype(np.int64) * 256 + words.data[start[:live] + k]
            seen[:live] += self.pops[at]
            state[:live] = self.follow[at]
        follow, pops, data = memoryview(self.follow), memoryview(self.pops), memoryview(words.data)
        for i in range(int((size > LONG).sum())):
            at, popped, begin = int(state[i]), 0, int(start[i])
            for b in data[begin + LONG : begin + int(size[order[i]])]:
                edge = at * 256 + b
                popped += pops[edge]
                at = follow[edge]
                if not at:  # dead: no cut
                    break
            state[i], seen[i] = at, seen[i] + popped
        end = self.at_end[state]
        out = np.empty(len(order), np.int64)
        out[order] = np.where(end < 0, -1, seen + end)
        return out


@lru_cache(maxsize=2)
def automaton(path: str) -> Automaton:
    return Automaton(*pieces(path))


def count_tokens(spark: SparkSession, df: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_words, n_tokens (an unknown word is one), n_unknown of every row of df.

    Words are what white space of ASCII parts. A null or empty text has none of them; repeated rows each give a row;
    other columns are left out. The vocabulary is read on the executors from `path`, once in each worker.
    """
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(path)
        for part, texts in slices(batches, "t"):
            words = Words(texts)
            n = machine.count(words)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(words.counts()), pa.array(sums_by(words.first, np.maximum(n, 1))), pa.array(sums_by(words.first, (n < 0).astype(np.int64)))],
                ["k", "n_words", "n_tokens", "n_unknown"],
            )

    thin = df.select(df[key].alias("k"), df[text].alias("t"))
    out = thin.mapInArrow(run, f"k {thin.schema['k'].dataType.simpleString()}, n_words long, n_tokens long, n_unknown long")
    return out.withColumnRenamed("k", key)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word-piece counts of all documents under the vocabulary of the public 32k piece model."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_tokens(spark, docs, public_tokenizers.path("piece_bpe_32k.model"))
