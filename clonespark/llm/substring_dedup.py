"""Removal of word passages that occur more than once, by level-wise doubling.

The windows of ``BASE`` words that repeat anywhere are found first. A window of twice that length is a candidate only where both of its
halves repeat, so each level asks about survivors alone, until the wanted length is reached; where no candidate survives a level, the
following ones ask about nothing. The last doublings overlap their halves so that they end at exactly ``window`` words. Each level is one exact
look-up over the whole corpus (exchange.py) of 64-bit window hashes. A false match of a level before the last
merely makes a candidate more. At the last level windows are equal only if a digest of 128 further bits is too, which is made from
other hashes of their words' bytes.

Null and empty texts have no words. A window lies within one document; windows are judged on the
input. Rows that repeat (same id or not) count as separate occurrences. Texts are handled whole, whatever their length. Other columns are kept as they are,
but for those of the names that are made.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clonespark.llm import arrowtext as A
from clonespark.llm import exchange as X
from clonespark.llm.columns import rest, slim, whole

WINDOW, BASE = 35, 9


def levels(window: int, base: int = BASE) -> list[int]:
    """Window lengths from the base (or less) to the window, each at most twice the one before.

    >>> levels(35), levels(35, 5)
    ([9, 18, 35], [5, 9, 18, 35])
    """
    sizes = [window]
    while sizes[0] > base:
        sizes.insert(0, (sizes[0] + 1) // 2)
    return sizes


class _Block:
    """A block's words, their hashes, and its windows."""

    def __init__(self, docs: pa.Table) -> None:
        self.words = A.split_words(*A.column_bytes(docs["text"]))
        self.sums = A.prefix_sums(A.hash_spans(self.words.data, self.words.starts, self.words.ends))

    def windows(self, size: int, level: int, among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(first words, hashes) of the windows of a level, or of those that start at the words ``among``."""
        if among is None:
            at = A.window_starts(self.words.first, size)
        else:
            at = np.flatnonzero(among)
            at = at[at + size <= self.words.first[np.searchsorted(self.words.first, at, "right")]]
        return at, A.window_values(self.sums, at, size, seed=level + 1)

    def digests(self, size: int, at: np.ndarray) -> np.ndarray:
        """Two more hashes of the windows that start at the words ``at``, (windows, 2), from the words that these cover."""
        out = np.empty((len(at), 2), np.uint64)
        starts, ends = self.words.starts, self.words.ends
        edge = np.zeros(len(starts) + 1, np.int32)
        edge[at] += 1
        np.add.at(edge, at + size, -1)
        covered = np.cumsum(edge[:-1]) > 0
        place = (np.cumsum(covered) - 1)[at]
        for k, seed in enumerate((0x5851F42D, 0x14057B7E)):
            h = A.hash_spans(self.words.data, starts[covered], ends[covered], seed)
            out[:, k] = A.window_values(A.prefix_sums(h, seed), place, size, seed)
        return out


def _same(keys: np.ndarray, more: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(order by key and digest, whether each equals the one before it in that order)."""
    order = np.argsort(keys, kind="stable") if more is None else np.lexsort((more[:, 1], more[:, 0], keys))
    keys = keys[order]
    same = np.zeros(len(keys), bool)
    same[1:] = keys[1:] == keys[:-1]
    if more is not None:
        more = more[order]
        same[1:] &= (more[1:] == more[:-1]).all(1)
    return order, same


class _Passes:
    """What a block does at each level. It asks for its distinct candidates in the order of their keys, and an answer is one bit for each of them;
    so a block makes its candidates again from the first level on, as the answers so far tell which survived."""

    def __init__(self, sizes: list[int]) -> None:
        self.sizes = sizes

    def _last(self, level: int) -> bool:
        return level == len(self.sizes) - 1

    def repeats(self, block: _Block, answers: pa.Table) -> np.ndarray:
        """By word, whether the window of the last answered level that starts there repeats."""
        among = None
        for level, rows in X.by_level(answers).items():
            if level:
                among = self._candidates(found, level)
            at, keys = block.windows(self.sizes[level], level, among)
            found = np.zeros(len(block.words.starts) + 1, bool)
            if self._last(level):
                order, same = _same(keys, block.digests(self.sizes[level], at))
                hot = self._bits(keys[order][~same], rows) > 0
                found[at[order][hot[np.cumsum(~same) - 1]]] = True
            else:
                distinct, _ = _distinct(keys)
                hot = distinct[self._bits(distinct, rows) > 0]
                found[at[_among(keys, hot)]] = True
        return found

    def _bits(self, keys: np.ndarray, rows: list[dict]) -> np.ndarray:
        """The answers' bits, as the keys are ordered."""
        counts = np.diff(X.by_bucket(keys, len(rows))).tolist()
        return np.concatenate([_Repeats().told(r["x"], c) for r, c in zip(rows, counts, strict=True)])

    def _candidates(self, repeated: np.ndarray, level: int) -> np.ndarray:
        """By word, whether both halves of the window of a level that starts there repeat."""
        step = self.sizes[level] - self.sizes[level - 1]
        second = np.zeros_like(repeated)
        second[: max(len(repeated) - step, 0)] = repeated[step:]
        return repeated & second

    def request(self, block: _Block, level: int, answers: pa.Table | None = None) -> X.Runs:
        """The distinct candidates of a level, with a: whether each is there more than once in the block, b: at the last level the digests."""
        at, keys = block.windows(self.sizes[level], level, self._candidates(self.repeats(block, answers), level) if level else None)
        if not self._last(level):
            distinct, n = _distinct(keys)
            return [(distinct, {"a": (n > 1).astype(np.uint8)})]
        more = block.digests(self.sizes[level], at)
        order, same = _same(keys, more)
        n = np.diff(np.append(np.flatnonzero(~same), len(keys)))
        return [(keys[order][~same], {"a": (n > 1).astype(np.uint8), "b": np.ascontiguousarray(more[order][~same]).view("V16").ravel()})]


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the distinct keys, sorted; how often each is there)."""
    ranked = np.sort(keys)
    fresh = np.ones(len(ranked), bool)
    fresh[1:] = ranked[1:] != ranked[:-1]
    return ranked[fresh], np.diff(np.append(np.flatnonzero(fresh), len(ranked)))


def _among(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of the keys that are among the wanted (sorted) ones."""
    bit = np.zeros(1 << 20, bool)  # by the upper 20 bits, most others are told at once
    bit[(wanted >> np.uint64(44)).astype(np.int64)] = True
    at = np.flatnonzero(bit[(keys >> np.uint64(44)).astype(np.int64)])
    return at[wanted[np.minimum(np.searchsorted(wanted, keys[at]), max(len(wanted) - 1, 0))] == keys[at]] if len(at) else at


class _Repeats:
    """Replies with one bit for each key, and digest where there is one: whether it repeats, within a block or between blocks."""

    def merge(self, keys: list[np.ndarray], rows: list[dict]) -> tuple[np.ndarray, dict[str, np.ndarray], list[np.ndarray]]:
        own = np.concatenate([np.frombuffer(r["a"], np.uint8) > 0 for r in rows])
        digests = [np.ascontiguousarray(X.unpack(r["b"], "V16")).view(np.uint64).reshape(-1, 2) for r in rows if r["b"]]
        every, more = np.concatenate(keys), np.concatenate(digests) if digests else None
        order, same = _same(every, more)
        group = np.cumsum(~same) - 1
        n = np.bincount(group)
        hot = (n > 1) | (np.bincount(group, own[order], len(n)) > 0)
        place = np.empty(len(order), np.int64)
        place[order] = group
        payload = {"a": hot.astype(np.uint8)}
        if more is not None:
            payload["b"] = np.ascontiguousarray(more[order][~same]).view("V16").ravel()
        return every[order][~same], payload, np.split(place, np.cumsum([len(k) for k in keys])[:-1])

    def totals(self, keys: np.ndarray, values: np.ndarray) -> tuple[int, int]:
        return 0, 0

    def tell(self, values: np.ndarray) -> bytes:
        return np.packbits(values).tobytes()

    def told(self, x: bytes, count: int) -> np.ndarray:
        return np.unpackbits(np.frombuffer(x, np.uint8), count=count)


def remove_repeats(docs: DataFrame, window: int = WINDOW, base: int = BASE) -> DataFrame:
    """docs with kept_text (kept words, one space between), n_words and n_removed, for a column ``text``; other columns stay (but for any of these names)."""
    sizes = levels(window, base)
    passes = _Passes(sizes)
    names = [c for c in ("doc_id", "text") if c in docs.columns]
    n = X.blocks_for(docs)
    rows = slim(docs, *names)
    route = X.Route.of(n)
    blocks = X.in_blocks(rows, n)
    answers = X.look_up(X.ask(blocks, lambda docs: passes.request(_Block(docs), 0), route.first), _Repeats(), route)
    for level in range(1, len(sizes)):

        def following(docs: pa.Table, known: pa.Table, level: int = level) -> X.Runs:
            return passes.request(_Block(docs), level, known)

        answers = answers.unionByName(X.look_up(X.ask_again(blocks, answers, following, route.first), _Repeats(), route, level)).repartitionById(n, "block")
    more = [T.StructField("kept_text", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())]
    kept = list(rows.schema.fields)

    def make(table: pa.Table, known: pa.Table) -> pa.Table:
        block = _Block(table)
        words = block.words
        found = passes.repeats(block, known)
        total = len(words.starts)
        starts = np.flatnonzero(found[:total])
        edge = np.zeros(total + 1, np.int64)
        np.add.at(edge, starts, 1)
        np.add.at(edge, np.minimum(starts + window, total), -1)
        stays = np.cumsum(edge[:-1]) == 0
        left = np.concatenate([[0], np.cumsum(stays)])[words.first]
        text = A.string_array(*A.joined_words(words, stays))
        new = [text, pa.array(words.counts, pa.int64()), pa.array(words.counts - np.diff(left), pa.int64())]
        return pa.table([table[f.name] for f in kept] + new, [f.name for f in kept] + [m.name for m in more])

    out = X.finish(blocks, answers, make, T.StructType(kept + more))
    own = [m.name for m in more]
    return whole(out, [c for c in docs.columns if c not in own] + own)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """documents whose texts have lost their repeated passages; a text that loses none is unchanged. All rows stay."""
    out = remove_repeats(slim(docs, "doc_id", "text"), window)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    return whole(out.select("doc_id", text.alias("text"), *rest(out)), docs.columns, n_chars=F.length("text").cast("long"))


def brute_force(rows: list[tuple], window: int = WINDOW) -> list[tuple]:
    """The same by dictionaries, for tests."""
    import re
    from collections import Counter

    words = [re.findall("[^\x20\x09-\x0d]+", t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (doc_id, _), w in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((doc_id, len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    return out


#: DuckDB SQL of op4_substring_dedup. Words hold no spaces, so windows are equal where their joined words are.
ORACLE = f"""
with d as (select row_number() over () r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') ws from documents),
windows as (select r, i, md5(array_to_string(ws[i:i + {WINDOW - 1}], ' ')) h from (select r, ws, unnest(range(1, len(ws) - {WINDOW - 2})) i from d where len(ws) >= {WINDOW})),
repeated as (select r, i from windows where h in (select h from windows group by h having count(*) > 1)),
gone as (select distinct r, i + k p from repeated, range({WINDOW}) o(k)),
words as (select r, generate_subscripts(ws, 1) p, unnest(ws) word from d),
kept as (select r, string_agg(word, ' ' order by p) kept, count(*) n from words anti join gone using (r, p) group by r)
select doc_id, cast(len(ws) as bigint) n_words, cast(len(ws) - coalesce(n, 0) as bigint) n_removed, sha256(coalesce(kept, '')) kept_sha256 from d left join kept using (r)
"""
