"""Token counts by a linear longest-match automaton.

The pieces of a vocabulary form a trie over bytes. Each node has a failure link and
the number of pieces that greedy longest match has finished when it follows the
link, both computed once breadth first. Counting a word then moves one byte at a
time and adds those numbers: time is linear in the bytes, and no piece is built.
A word is a run without white space and counts with one space before it, as
byte-level vocabularies have it. All single bytes are pieces, so any text has a
count.

Words are run together, one step of the automaton being a few array operations on
all words that are long enough; words met before are looked up. Words of more than
``_LONG`` bytes are too few for that and are walked one by one.
"""

from __future__ import annotations

import base64
import os
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.names import fresh

VOCABULARY = os.environ.get("WEFTLINE_RANKS", "/opt/tokenizers/byte_bpe_50k.tiktoken")
_CACHE_WORDS = 200_000
_CACHED_LENGTH = 48
_LONG = 96


def read_vocabulary(path: str = VOCABULARY) -> list[bytes]:
    """Pieces of a file with a base64 piece and a rank on each line."""
    with open(path, "rb") as file:
        return [base64.b64decode(line.split()[0]) for line in file if line.strip()]


class Automaton:
    def __init__(self, pieces: Iterable[bytes]) -> None:
        children: list[dict[int, int]] = [{}]
        ends = [False]
        for piece in (*pieces, *(bytes([b]) for b in range(256))):
            node = 0
            for byte in piece:
                down = children[node].get(byte)
                if down is None:
                    down = children[node][byte] = len(children)
                    children.append({})
                    ends.append(False)
                node = down
            ends[node] = ends[node] or node > 0
        n = len(children)
        fail, pops, rest = np.zeros(n, np.int32), np.zeros(n, np.int32), np.zeros(n, np.int32)
        queue = deque([0])
        while queue:
            up = queue.popleft()
            for byte, node in children[up].items():
                if ends[node]:
                    pops[node] = 1  # the node's whole string is a piece
                else:
                    at, popped = fail[up], pops[up]
                    while byte not in children[at]:
                        popped += pops[at]
                        at = fail[at]
                    fail[node], pops[node] = children[at][byte], popped
                rest[node] = pops[node] + rest[fail[node]]
                queue.append(node)
        keys = np.array([node * 256 + b for node, c in enumerate(children) for b in c], np.int64)
        to = np.array([x for c in children for x in c.values()], np.int32)
        order = np.argsort(keys)
        self.keys, self.to, self.fail, self.pops, self.rest = keys[order], to[order], fail, pops, rest
        self.steps: dict[int, int] | None = None
        self.failing: list[tuple[int, int]] = []

    def walk(self, word: bytes) -> int:
        """Pieces of one word, byte by byte."""
        if self.steps is None:
            self.steps = dict(zip(self.keys.tolist(), self.to.tolist()))
            self.failing = list(zip(self.fail.tolist(), self.pops.tolist()))
        steps, failing, state, total = self.steps, self.failing, 0, 0
        for byte in word:
            down = steps.get(state * 256 + byte)
            while down is None:
                state, popped = failing[state]
                total += popped
                down = steps.get(state * 256 + byte)
            state = down
        return total + int(self.rest[state])

    def count(self, words: list[bytes]) -> np.ndarray:
        """Pieces of each word by greedy longest match."""
        long = [k for k, w in enumerate(words) if len(w) > _LONG]
        if long:
            out = np.empty(len(words), np.int64)
            rest = np.ones(len(words), bool)
            rest[long] = False
            out[long] = [self.walk(words[k]) for k in long]
            out[rest] = self.count([words[k] for k in np.flatnonzero(rest).tolist()])
            return out
        lengths = np.array([len(w) for w in words], np.int64)
        order = np.argsort(-lengths, kind="stable")
        data = np.frombuffer(b"".join(words), np.uint8)
        starts = (np.cumsum(lengths) - lengths)[order]
        lengths = lengths[order]
        state, total = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        live = len(words)
        for step in range(int(lengths[0]) if len(words) else 0):
            live = int(np.searchsorted(-lengths[:live], -step))  # words longer than step come first
            byte = data[starts[:live] + step]
            todo = np.arange(live)
            while len(todo):
                key = state[todo] * 256 + byte[todo]
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                found = self.keys[at] == key
                state[todo[found]] = self.to[at[found]]
                todo = todo[~found]
                total[todo] += self.pops[state[todo]]
                state[todo] = self.fail[state[todo]]
        total += self.rest[state]
        out = np.empty(len(words), np.int64)
        out[order] = total
        return out


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, automaton: Automaton | None = None) -> DataFrame:
    """(id, n_words bigint, n_tokens bigint), a row for each row of ``docs``.

    Null texts give nulls; empty texts, and white space alone, give 0. Texts and
    words count whole, of any length. Repeated rows and null ids are counted each.
    An empty table gives an empty result; other columns are ignored."""
    shared = docs.sparkSession.sparkContext.broadcast(automaton or Automaton(read_vocabulary(vocabulary)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, known = shared.value, {}
        for batch in batches:
            texts = [None if t is None else t.split() for t in batch.column(1).to_pylist()]
            if len(known) > _CACHE_WORDS:
                known.clear()
            new = list(set().union(*(w for w in texts if w)).difference(known)) if batch.num_rows else []
            counts = dict(zip(new, machine.count([b" " + w.encode("utf-8", "replace") for w in new]).tolist()))
            known.update(counts)
            get = known.__getitem__
            n_words = [None if w is None else len(w) for w in texts]
            n_tokens = [None if w is None else sum(map(get, w)) for w in texts]
            for w in new:
                if len(w) > _CACHED_LENGTH:
                    del known[w]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], [id_col, "n_words", "n_tokens"])

    narrow = docs.select(F.col(id_col), F.col(text_col).cast("string").alias(fresh([id_col], "text")[0]))
    return narrow.mapInArrow(run, f"`{id_col}` {narrow.schema[0].dataType.simpleString()}, n_words bigint, n_tokens bigint")
