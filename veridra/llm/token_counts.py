"""Token counts by a unigram model: distinct pre-tokens share their prefixes' best scores in a trie."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridra.llm.common import slices, text_bytes


class Trie:
    """Byte strings as paths from node 0, in arrays: every node's `parent` and `letter`, every string's last node in `ends`, and in
    `levels` where each depth's nodes begin. Nodes are numbered level by level, in the order of (parent, letter)."""

    def __init__(self, strings: list[bytes]):
        lengths = np.fromiter(map(len, strings), np.int64, len(strings))
        flat, starts = np.frombuffer(b"".join(strings), np.uint8), np.cumsum(lengths) - lengths
        self.ends = np.zeros(len(strings), np.int64)
        parents, letters, self.levels = [np.zeros(1, np.int64)], [np.zeros(1, np.uint8)], [0, 1]
        live, depth = np.flatnonzero(lengths), 0
        while len(live):
            steps, which = np.unique(self.ends[live] << 8 | flat[starts[live] + depth], return_inverse=True)
            self.ends[live] = self.levels[-1] + which
            parents.append(steps >> 8)
            letters.append((steps & 255).astype(np.uint8))
            self.levels.append(self.levels[-1] + len(steps))
            depth += 1
            live = live[lengths[live] > depth]
        self.parent, self.letter = np.concatenate(parents), np.concatenate(letters)


class Unigram:
    """Scores of a vocabulary's pieces and the best segmentation of pre-tokens under them.

    A piece of rank r scores -log(r + 2), a Zipf prior over the vocabulary; single bytes that are missing score far below every piece,
    so every text has a segmentation. Ties go to fewer pieces. The pieces stand backwards in a trie of their own, so that those which end at
    a byte are found by one walk back from it.
    """

    #: bytes of a pre-token that goes into the shared trie; longer ones are scored on their own
    deep = 64

    def __init__(self, ranks_path: str):
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.score = dict(zip(ranks, (-np.log(np.array(list(ranks.values())) + 2.0)).tolist()))
        self.worst = float(-2 * np.log(len(ranks) + 2.0))
        back = Trie([token[::-1] for token in ranks])
        #: steps (node, letter) that exist, ascending; step i leads to node i + 1
        self.steps = back.parent[1:] << 8 | back.letter[1:]
        self.piece = np.full(len(back.parent), -np.inf)
        self.piece[back.ends] = list(self.score.values())
        first = self._searched(np.zeros(256, np.int64), np.arange(256))
        self.pairs = np.where(np.repeat(first, 256) < 0, -1, self._searched(np.repeat(np.maximum(first, 0), 256), np.tile(np.arange(256), 256)))

    def _searched(self, state: np.ndarray, letter: np.ndarray) -> np.ndarray:
        key = state << 8 | letter
        at = np.minimum(np.searchsorted(self.steps, key), len(self.steps) - 1)
        return np.where(self.steps[at] == key, at + 1, -1)

    def _back(self, depth: int, state: np.ndarray, last: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The nodes that a further letter leads to, -1 for none. `last` holds the letters before."""
        return self.pairs[last.astype(np.int64) << 8 | letter] if depth == 1 else self._searched(state, letter)

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Pieces of every word's best segmentation. Words that begin alike share their prefixes' scores; each word's last node has its count."""
        long = [i for i, w in enumerate(words) if len(w) > self.deep]
        trie = Trie([w if len(w) <= self.deep else b"" for w in words] if long else words)
        out = self._forward(trie)[trie.ends]
        for i in long:
            out[i] = self._alone(words[i])
        return out

    def _forward(self, trie: Trie) -> np.ndarray:
        """Pieces at every node, from the best (score, fewest pieces) of its prefixes, one level after the other."""
        score, pieces = np.zeros(len(trie.parent)), np.zeros(len(trie.parent), np.int64)
        for lo, hi in zip(trie.levels[1:], trie.levels[2:]):
            above = trie.parent[lo:hi]
            best, fewest = score[above] + self.worst, pieces[above] + 1
            rows, last, state, node, depth = np.arange(hi - lo), trie.letter[lo:hi], np.zeros(hi - lo, np.int64), above, 0
            first = self._searched(state, last)
            rows = np.flatnonzero(first >= 0)
            state, last, node = first[rows], last[rows], node[rows]
            while True:
                total, n = score[node] + self.piece[state], pieces[node] + 1
                better = np.flatnonzero((total > best[rows]) | (total == best[rows]) & (n < fewest[rows]))
                best[rows[better]], fewest[rows[better]] = total[better], n[better]
                depth += 1
                keep = np.flatnonzero(node)
                rows, state, last, node = rows[keep], state[keep], last[keep], node[keep]
                letter = trie.letter[node]
                state = self._back(depth, state, last, letter)
                keep = np.flatnonzero(state >= 0)
                if not len(keep):
                    break
                rows, state, last, node = rows[keep], state[keep], letter[keep], trie.parent[node[keep]]
            score[lo:hi], pieces[lo:hi] = best, fewest
        return pieces

    def _alone(self, data: bytes, stretch: int = 65_536) -> int:
        """The same for one long word: the pieces that end in a stretch of it are found all at once, then read in order."""
        letters, path = np.frombuffer(data, np.uint8), [(0.0, 0)]
        for a in range(0, len(data), stretch):
            here = np.arange(a, min(a + stretch, len(data)))
            state, length, found = self._searched(np.zeros(len(here), np.int64), letters[here]), 1, []
            while True:
                keep = np.flatnonzero(state >= 0)
                here, state = here[keep], state[keep]
                hits = np.flatnonzero(self.piece[state] > -np.inf)
                found.append((here[hits], np.full(len(hits), length), self.piece[state[hits]]))
                inside = np.flatnonzero(here >= length)
                here, state = here[inside], state[inside]
                if not len(here):
                    break
                state, length = self._searched(state, letters[here - length]), length + 1
            ends, lengths, scores = (np.concatenate(x) for x in zip(*found))
            order = np.argsort(ends, kind="stable")
            bounds = np.searchsorted(ends[order], np.arange(a, min(a + stretch, len(data)) + 1)).tolist()
            lengths, scores = lengths[order].tolist(), scores[order].tolist()
            for i, (lo, hi) in enumerate(zip(bounds, bounds[1:]), a):
                best, fewest = path[i][0] + self.worst, path[i][1] + 1
                for length, s in zip(lengths[lo:hi], scores[lo:hi]):
                    before, n = path[i + 1 - length]
                    if before + s > best or before + s == best and n + 1 < fewest:
                        best, fewest = before + s, n + 1
                path.append((best, fewest))
        return path[-1][1]


@lru_cache(maxsize=2)
def unigram(ranks_path: str) -> Unigram:
    """One vocabulary per worker process."""
    return Unigram(ranks_path)


def token_counts(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Unigram token counts of every whole text, one row per row: (doc_id, n_pretokens, n_distinct, n_tokens).

    Null and empty text has none. Repeated rows get equal rows, an empty table none; other columns are not looked at. A task reads some
    megabytes of text at a time: their distinct pre-tokens go into one trie, and each text adds up its pre-tokens' counts. Nothing is
    shuffled, no key can be hot, and what a worker holds does not depend on the table.
    """
    names = ["doc_id", "n_pretokens", "n_distinct", "n_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, pieces = unigram(ranks_path), regex.compile(pattern)
        for batch in batches:
            for part in slices(batch, 5000, text=1):
                known: dict[str, int] = {}
                of_text, n_words, n_distinct = [], [], []
                for text in part.column(1):
                    words = pieces.findall(text.as_py() or "")
                    mine = set(words)
                    for w in mine:
                        if w not in known:
                            known[w] = len(known)
                    of_text.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))
                    n_words.append(len(words))
                    n_distinct.append(len(mine))
                counts = model.counts([text_bytes(w) for w in known])
                n_tokens = [int(counts[ids].sum()) for ids in of_text]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, pa.int64()) for c in (n_words, n_distinct, n_tokens))], names=names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"))
    return rows.mapInArrow(run, "doc_id long, n_pretokens long, n_distinct long, n_tokens long")
