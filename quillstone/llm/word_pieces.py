"""Token counts by a linear longest-match automaton.

The vocabulary is a trie over bytes. A node that has no edge for the next byte falls back along its failure link: the
node reached after the longest pieces at the front of its string have been popped off greedily. How many pieces that pops
is counted beforehand, so a word's number of greedy longest-match pieces is a walk over its bytes that adds numbers and
never builds a piece. A batch's new words walk in step, one byte at a time; words seen before are remembered.

Words are runs of anything but ASCII white space. A word is matched with a space before it, as pieces that begin words
have one in the vocabulary; a word that the pieces can't spell counts as one token.

Nulls: a null text has no words. Empty texts have no tokens. Only ids and texts are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, pieces, texts

REMEMBER = 400_000


class Automaton:
    """Edges as one sorted array of node * 256 + byte; failure links and popped counts by node. Node 0 is the root."""

    def __init__(self, vocabulary: list[bytes]):
        edges: dict[int, int] = {}
        token, parent, byte, nodes = [False], [0], [0], 1
        for piece in sorted({p for p in vocabulary if p}):
            at = 0
            for b in piece:
                to = edges.get(at << 8 | b)
                if to is None:
                    to = edges[at << 8 | b] = nodes
                    nodes += 1
                    token.append(False)
                    parent.append(at)
                    byte.append(b)
                at = to
            token[at] = True
        # Failure links: -1 where the string can't be spelt; breadth first, as a link leads to a shorter string.
        depth = [0] * nodes
        for v in range(1, nodes):
            depth[v] = depth[parent[v]] + 1
        fail, popped = [-1] * nodes, [0] * nodes
        for v in sorted(range(1, nodes), key=depth.__getitem__):
            if token[v]:
                fail[v], popped[v] = 0, 1
                continue
            u, n = fail[parent[v]], popped[parent[v]]
            while u >= 0 and (u << 8 | byte[v]) not in edges:
                n += popped[u]
                u = fail[u]
            if u >= 0:
                fail[v], popped[v] = edges[u << 8 | byte[v]], n
        keys = np.fromiter(edges, np.int64, len(edges))
        order = np.argsort(keys)
        self.keys, self.to = keys[order], np.fromiter(edges.values(), np.int64, len(edges))[order]
        self.fail, self.popped = np.array(fail, np.int64), np.array(popped, np.int64)

    def _step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The edges' ends; -1 where there is none."""
        key = node << 8 | byte
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (node >= 0), self.to[at], -1)

    def lengths(self, words: list[bytes]) -> np.ndarray:
        """The number of pieces of each word; 1 for those that can't be spelt, 0 for empty ones."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-size, kind="stable")  # the longest first: words that have ended are at the end
        flat = np.frombuffer(b"".join(words[i] for i in order), np.uint8)
        ends = np.cumsum(size[order])
        start, size = ends - size[order], size[order]
        node, count = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        if len(self.keys):
            for i in range(int(size[0]) if len(size) else 0):
                n = int(np.searchsorted(-size, -i, "left"))  # words of more than i bytes
                at, byte = np.arange(n), flat[start[:n] + i].astype(np.int64)
                to = self._step(node[:n], byte)
                missing = np.flatnonzero((to < 0) & (node[:n] >= 0))
                while len(missing):
                    count[missing] += self.popped[node[missing]]
                    node[missing] = self.fail[node[missing]]
                    to[missing] = self._step(node[missing], byte[missing])
                    missing = missing[(to[missing] < 0) & (node[missing] >= 0)]
                node[at] = to
        else:
            node[:] = -1
        # The rest of a word that has been read pops until the root is reached.
        open_ = np.flatnonzero(node > 0)
        while len(open_):
            count[open_] += self.popped[node[open_]]
            node[open_] = self.fail[node[open_]]
            open_ = open_[node[open_] > 0]
        count[node < 0] = 1
        out = np.zeros(len(words), np.int64)
        out[order] = np.where(size > 0, count, 0)
        return out


def token_counts(docs: DataFrame, vocabulary: list[bytes], before: bytes = b" ") -> DataFrame:
    """One row per document: doc_id, n_words, n_tokens. before: what stands before a word when it is matched."""
    automaton = Automaton(vocabulary)  # its size is bounded by the vocabulary's

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in pieces(batches):
            split = [t.split() for t in texts(batch.column("text"))]
            if len(known) > REMEMBER:
                known.clear()
            new = list(set(chain.from_iterable(split)) - known.keys())
            known.update(zip(new, automaton.lengths([before + w for w in new]).tolist(), strict=True))
            counts = [sum(map(known.__getitem__, words)) for words in split]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(list(map(len, split)), pa.int64()), pa.array(counts, pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    return id_text(docs).mapInArrow(run, "doc_id long, n_words long, n_tokens long")
