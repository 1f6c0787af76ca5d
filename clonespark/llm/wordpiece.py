"""Token counts by greedy longest match in linear time.

Words ``[^\\x20\\x09-\\x0D]+`` are cut into the longest piece of the vocabulary that begins them, then the longest
continuing piece, and so on; a word that can't be cut is one unknown token. One pass over a word's bytes finds
the number of pieces without building any (Song et al., 2021): a trie over the pieces has a root for words and a root for
continuing pieces; where a node has no child for the next byte, its failure link leads to the node of what
is left after the longest pieces have been popped, and the node stores how many were popped.

The automaton is flat arrays, and all distinct words of a batch go through it in lockstep; the last few of them, which are the longest,
go on one by one, so a very long word costs its own bytes alone.

Null and empty texts have no words and no tokens. Repeated rows are rows of their own. Texts and words are handled whole, whatever their
length. Other columns are dropped unless named in ``keep``, which may not name those that are made (ValueError).
"""

from __future__ import annotations

import hashlib
import json
from collections import deque
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clonespark.llm import arrowtext as A
from clonespark.llm.bpe import _byte_letters, vocabulary_path

CHUNK = 1 << 23
#: Words that are still going, below which they leave the lockstep.
FEW = 64
COUNTS = "n_words long, n_tokens long, n_unknown long"


class MatchAutomaton:
    """Pieces as bytes: those that begin a word, and those that continue one."""

    def __init__(self, initial: Iterable[bytes], continuing: Iterable[bytes]) -> None:
        child: list[dict[int, int]] = [{}, {}]  # node 0: words, node 1: continuing pieces
        is_piece = [False, False]
        for root, pieces in ((0, initial), (1, continuing)):
            for piece in pieces:
                node = root
                for b in piece:
                    if b not in child[node]:
                        child[node][b] = len(child)
                        child.append({})
                        is_piece.append(False)
                    node = child[node][b]
                is_piece[node] = is_piece[node] or node > 1
        fail, pops = [-1] * len(child), [0] * len(child)
        todo = deque([0, 1])
        while todo:
            up = todo.popleft()
            for b, node in child[up].items():
                todo.append(node)
                if is_piece[node]:
                    fail[node], pops[node] = 1, 1
                    continue
                at, popped = fail[up], pops[up]
                while at >= 0 and b not in child[at]:
                    popped += pops[at]
                    at = fail[at]
                if at >= 0:
                    fail[node], pops[node] = child[at][b], popped
        self.fail, self.pops = np.array(fail), np.array(pops)
        edges = sorted((node << 8 | b, to) for node, own in enumerate(child) for b, to in own.items())
        self._edge = np.array([e for e, _ in edges] or [-1], np.int64)
        self._to = np.array([t for _, t in edges] or [-1], np.int64)
        self._goto, self._fail_list, self._pops_list = dict(edges), fail, pops  # for single words

    def _step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        key = node << 8 | byte
        at = np.minimum(np.searchsorted(self._edge, key), len(self._edge) - 1)
        return np.where(self._edge[at] == key, self._to[at], -1)

    def _alone(self, data: bytes, node: int, total: int) -> tuple[int, int]:
        """(node, popped pieces) after the bytes, from a node."""
        fail, pops, goto = self._fail_list, self._pops_list, self._goto
        for b in data:
            to = goto.get(node << 8 | b)
            while to is None:
                total += pops[node]
                node = fail[node]
                if node < 0:
                    return -1, total
                to = goto.get(node << 8 | b)
            node = to
        return node, total

    def counts(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of pieces of each word; 0 for a word that can't be cut."""
        n = np.zeros(len(starts), np.int64)
        order = np.argsort(starts - ends, kind="stable")  # longest first: the words still going are a prefix
        at, size = starts[order], (ends - starts)[order]
        node = np.zeros(len(at), np.int64)
        total = np.zeros(len(at), np.int64)
        shorter = -size
        for i in range(int(size[0]) if len(size) else 0):
            live = np.flatnonzero(node[: int(np.searchsorted(shorter, -i, "left"))] >= 0)
            if len(live) < FEW:  # the last few, longest words go on by themselves
                for k in live.tolist():
                    node[k], total[k] = self._alone(data[at[k] + i : at[k] + size[k]].tobytes(), int(node[k]), int(total[k]))
                break
            byte = data[at[live] + i].astype(np.int64)
            while len(live):
                to = self._step(node[live], byte)
                got = to >= 0
                node[live[got]] = to[got]
                live, byte = live[~got], byte[~got]
                total[live] += self.pops[node[live]]
                node[live] = self.fail[node[live]]
                going = node[live] >= 0
                live, byte = live[going], byte[going]
        live = np.flatnonzero(node >= 0)
        while len(live):
            live = live[node[live] > 1]
            total[live] += self.pops[node[live]]
            node[live] = self.fail[node[live]]
            live = live[node[live] >= 0]
        n[order] = np.where(node == 1, total, 0)
        return n


def byte_level_pieces(path: str) -> tuple[list[bytes], list[bytes]]:
    """(initial, continuing) pieces of a byte-level vocabulary file: those with a leading space begin words, the others continue them."""
    byte = {c: b for b, c in enumerate(_byte_letters())}
    tokens = [bytes(byte[c] for c in t) for t in json.loads(Path(path).read_text(encoding="utf-8"))["model"]["vocab"]]
    return [t[1:] for t in tokens if t[:1] == b" " and len(t) > 1], [t for t in tokens if t[:1] != b" "]


_automata: dict[str, MatchAutomaton] = {}


def count_tokens(docs: DataFrame, initial: list[bytes], continuing: list[bytes], text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns with n_words, n_tokens (an unknown word is one) and n_unknown of each row."""
    if clash := set(keep) & {c.split()[0] for c in COUNTS.split(", ")}:
        raise ValueError(f"keep has columns that are made: {sorted(clash)}")
    pieces = docs.sparkSession.sparkContext.broadcast((list(initial), list(continuing)))
    key = hashlib.sha256(repr(pieces.value).encode()).hexdigest()
    slim = docs.select(*keep, F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            automaton = _automata.get(key) or _automata.setdefault(key, MatchAutomaton(*pieces.value))
            data, offsets = A.column_bytes(b.column(b.num_columns - 1))
            out = []
            for i, j in A.chunks(offsets, CHUNK):
                words = A.split_words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                example, which = A.distinct_spans(words.data, words.starts, words.ends)
                got = automaton.counts(words.data, words.starts[example], words.ends[example])
                sums = np.concatenate([[0], np.cumsum(np.maximum(got, 1)[which])])[words.first]
                lost = np.concatenate([[0], np.cumsum((got == 0)[which])])[words.first]
                out.append(np.stack([words.counts, np.diff(sums), np.diff(lost)]))
            new = np.concatenate([np.zeros((3, 0), np.int64), *out], 1)
            yield pa.RecordBatch.from_arrays(list(b.columns[:-1]) + [pa.array(x) for x in new], names=[*keep, *(c.split()[0] for c in COUNTS.split(", "))])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:-1])
    return slim.mapInArrow(run, f"{kept}, {COUNTS}")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), *byte_level_pieces(vocabulary_path("byte_bpe_50k.json")))


def brute_force(rows: list[tuple], initial: list[bytes], continuing: list[bytes]) -> list[tuple]:
    """(doc_id, n_words, n_tokens, n_unknown) by trying the longest piece first, for tests."""
    import re

    sets, longest = (set(initial), set(continuing)), max(map(len, [*initial, *continuing]))
    known: dict[bytes, int] = {}

    def cut(word: bytes) -> int:
        at = n = 0
        while at < len(word):
            size = next((k for k in range(min(longest, len(word) - at), 0, -1) if word[at : at + k] in sets[at > 0]), 0)
            if not size:
                return 0
            at, n = at + size, n + 1
        return n

    out = []
    for i, t in rows:
        words = re.findall(b"[^\x20\x09-\x0d]+", (t or "").encode())
        got = [known[w] if w in known else known.setdefault(w, cut(w)) for w in words]
        out.append((i, len(words), sum(max(1, g) for g in got), sum(g == 0 for g in got)))
    return out
