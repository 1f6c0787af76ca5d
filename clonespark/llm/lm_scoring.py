"""Language-model scores of texts: a weighted backoff automaton over smoothed n-grams.

The model has n-grams of ``ORDER`` = 3 words, smoothed by a hierarchy of Dirichlet priors (MacKay and Peto, 1995):

    p(w)   = (c(w) + 0.5) / (N + 0.5 (V + 1))
    p(w|h) = (c(hw) + m p(w|h')) / (c(h) + m)     h' is h without its first word, m = PRIOR of h's length

It is laid out as a backoff automaton. Every context h of one or two words that was seen in training is a state; a state has one arc for each word that
followed it, whose weight is log10 p(w|h), and a failure arc to the state h' of the weight log10 m / (c(h) + m), which is what p(w|h) leaves
of p(w|h') for a word without an arc. The root's arcs are p(w), with one class for all unseen words, so each state's
distribution sums to one. A text is traversed once from left to right, from the state of its beginning. At each token the traversal takes the
carried state's arc, or else failure arcs until a state has one, adding up the weights; the arc leads to the state of the longest
context that ends in the token and was seen, which is carried on. Arcs and failure arcs hold the states that they lead to, and the traversal reads nothing
of the text but its words' numbers.

Counts are over all training documents and all of their tokens, with no cut-off. The automaton grows with
the corpus, so no task holds it: a block of documents asks for the counts of its own n-grams (exchange.py),
which gives it the part of the automaton that its texts traverse. N-grams are known by 63-bit hashes, which are not verified: two of the
same hash would count as one.

Null and empty texts have only the end token. A null doc_id counts as the empty string for the split,
so that row trains. With no training row at all, every token has the unseen class's probability 1. Repeated rows train as often as they are there, and
get equal scores. Texts are scored whole, whatever their length. ``keep`` may name any columns but those that are made (ValueError).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clonespark.llm import arrowtext as A
from clonespark.llm import exchange as X

U64 = np.uint64
_END, _BEGIN = U64(0x452821E638D01377), U64(0xBE5466CF34E90C6C)
_TRAIN, _TEXT = "_train", "_text"
SCORES = "n_tokens long, n_known long, train_tokens long, base_score double, score double"
ORDER = 3
#: The prior's weight, in tokens, by the number of words of the context.
PRIOR = {1: 400.0, 2: 4.0, 3: 2.0, 4: 2.0}
#: Bytes of texts in a block: larger blocks ask for the n-grams that their texts share but once, and take more memory.
BLOCK = 12 << 20
#: Tokens of a text that are traversed in one go; a longer text is several stretches, each run in over the tokens before it.
STRETCH = 1024


@dataclass
class _Grams:
    """The n-grams of a block's documents, each document's tokens followed by one end.

    keys[k - 1]: by token, the hash of the k tokens that end there (0 where the text has fewer, counting one beginning). The lowest
    bit of a single word's hash is 1, that of others 0.
    """

    keys: list[np.ndarray]
    first: np.ndarray
    train: np.ndarray

    @classmethod
    def of(cls, docs: pa.Table, order: int) -> _Grams:
        words = A.split_words(*A.column_bytes(docs[_TEXT]), lower=True)
        docs_n = docs.num_rows
        first = words.first + np.arange(docs_n + 1)
        token = np.empty(first[-1], U64)
        ends = np.zeros(len(token), bool)
        ends[first[1:] - 1] = True
        token[ends] = _END
        token[~ends] = A.hash_spans(words.data, words.starts, words.ends)
        del words, ends
        at = np.arange(len(token)) - np.repeat(first[:-1], np.diff(first))
        keys, gram = [token | U64(1)], token
        for k in range(2, order + 1):  # one word more on the left: the gram before, and this token
            longer = np.empty_like(gram)
            longer[1:] = gram[:-1]
            longer[:1] = 0
            if k == 2:
                longer[at == 0] = _BEGIN
            gram = A.mix64(longer * U64(0x9E3779B97F4A7C15) + (token ^ U64(0x3F84D5B5B5470917)))
            key = gram & ~U64(1)
            key[key == 0] = 2
            key[at < k - 2] = 0
            keys.append(key)
        train = np.repeat(np.asarray(docs[_TRAIN].combine_chunks().fill_null(True)), np.diff(first))
        return cls(keys, first, train)

    def distinct(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """By order: (distinct keys, sorted, without 0; the place of each token's gram among them, -1 for none)."""
        out = []
        while self.keys:
            keys = self.keys.pop(0)
            order = np.argsort(keys)
            ranked = keys[order]
            fresh = np.ones(len(keys), bool)
            fresh[1:] = ranked[1:] != ranked[:-1]
            own = ranked[fresh]
            none = int(len(own) > 0 and own[0] == 0)
            place = np.empty(len(keys), np.int64)
            place[order] = np.cumsum(fresh) - 1 - none
            out.append((own[none:], place.astype(np.int32)))
        return out


def _ask(order: int):
    def request(docs: pa.Table) -> X.Runs:
        grams = _Grams.of(docs, order)
        runs = []
        for keys, place in grams.distinct():
            seen = np.bincount(place[grams.train & (place >= 0)], minlength=len(keys))
            runs.append((keys, {"a": seen.astype(np.uint32)}))
        return runs

    return request


class _Counts:
    """Replies with the training count of each n-gram; m, n: training tokens and distinct words of a bucket."""

    def merge(self, keys: list[np.ndarray], rows: list[dict]) -> tuple[np.ndarray, dict[str, np.ndarray], list[np.ndarray]]:
        counts = [X.unpack(r["a"], f"<u{len(r['a']) // max(len(k), 1) or 4}") for k, r in zip(keys, rows, strict=True)]  # a relay's have 8 bytes
        distinct, sums, places = X.totals(keys, counts)
        return distinct, {"a": sums.astype("<u8")}, places

    def totals(self, keys: np.ndarray, values: np.ndarray) -> tuple[int, int]:
        word = (keys & U64(1)) > 0
        return int(values[word].sum()), int((values[word] > 0).sum())

    def tell(self, values: np.ndarray) -> bytes:
        return X.pack(values)

    def told(self, x: bytes, count: int) -> np.ndarray:
        return X.unpack(x, "<u8")


@dataclass
class BackoffAutomaton:
    """The part of the automaton that a block's texts traverse: states with arcs and failure arcs.

    State 0 is the root; then come the words, the beginning (``begin``), the grams of two words, and so on. An arc is known by its state and word:
    arcs: state * span + word, sorted; the root comes first and has an arc for each word.
    weight, to: by arc, its log10 weight and the state that it leads to.
    lead: by state, its first arc, and the end.
    failure, fallback: by state, the log10 weight of its failure arc and the state that this leads to (the root has none).
    """

    arcs: np.ndarray
    weight: np.ndarray
    to: np.ndarray
    lead: np.ndarray
    failure: np.ndarray
    fallback: np.ndarray
    begin: int
    span: int
    order: int

    @classmethod
    def of(cls, counts: dict[int, np.ndarray], last: dict[int, np.ndarray], context: dict[int, np.ndarray], suffix: dict[int, np.ndarray], begins: int, total: int, distinct: int, prior: dict[int, float] = PRIOR) -> BackoffAutomaton:
        """counts[k]: by gram of k words, from 1; last, context, suffix: for grams of two words and more, the last word, and as grams the first k - 1 and the last k - 1 words.

        The context of a gram that starts with the beginning is the number after the last word's. begins: documents in training.
        """
        order, words = max(counts), len(counts[1])
        span = words + 1
        occurs = {k: np.append(counts[k], begins) if k == 1 else counts[k] for k in range(1, order)}
        state, base = {0: 0}, 1
        for k, seen in occurs.items():
            state[k], base = base, base + len(seen)
        p = (counts[1] + 0.5) / (total + 0.5 * (distinct + 1))
        starts = np.where(counts[1] > 0, state.get(1, 0) + np.arange(words), 0) if order > 1 else np.zeros(words)
        arcs, weight, to = [np.arange(words)], [np.log10(p)], [starts.astype(np.int32)]
        failure, fallback = np.zeros(base), np.zeros(base, np.int32)
        for k in range(2, order + 1):
            before = occurs[k - 1][context[k]]
            p = p[suffix[k]]  # of the shorter context
            p = np.where(before > 0, (counts[k] + prior[k - 1] * p) / (before + prior[k - 1]), p)
            del before
            seen = np.flatnonzero(counts[k] > 0).astype(np.int32)
            key = (state[k - 1] + context[k][seen].astype(np.int64)) * span + last[k][seen]
            by_key = np.argsort(key)  # the states of more words come later, so levels follow one another
            arcs.append(key[by_key])
            seen = seen[by_key]
            del key, by_key
            weight.append(np.log10(p[seen]))
            # the longest context that ends in the word: the gram itself, or, of the longest grams, all but its first word
            to.append((state[k] + seen if k < order else state[k - 1] + suffix[k][seen]).astype(np.int32))
            own = slice(state[k - 1], state[k - 1] + len(occurs[k - 1]))
            failure[own] = np.log10(prior[k - 1] / (occurs[k - 1] + prior[k - 1]))
            if k > 2:
                fallback[own] = state[k - 2] + suffix[k - 1]
        del p
        arcs, weight, to = np.concatenate(arcs), np.concatenate(weight), np.concatenate(to)
        lead = np.searchsorted(arcs, np.arange(base + 1) * span).astype(np.int32)
        return cls(arcs, weight, to, lead, failure, fallback, state.get(1, 0) + words if order > 1 else 0, span, order)

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(weights, states) after one token each: the state's arc, or failure arcs until a state has one."""
        state, weight, going = state.copy(), np.zeros(len(state)), np.arange(len(state))
        while len(going):
            at, arc = state[going].astype(np.int64), word[going]
            key, lead = at * self.span + arc, self.lead[at]
            arc = np.where(at > 0, np.minimum(lead, len(self.arcs) - 1), arc)  # most states have one arc; the root's are the words
            found = self.arcs[arc] == key
            more = np.flatnonzero(~found & (self.lead[at + 1] > lead + 1))
            arc[more] = np.minimum(np.searchsorted(self.arcs, key[more]), len(self.arcs) - 1)
            found[more] = self.arcs[arc[more]] == key[more]
            weight[going] += np.where(found, self.weight[arc], self.failure[at])
            state[going] = np.where(found, self.to[arc], self.fallback[at])
            going = going[~found]
        return weight, state

    def traverse(self, word: np.ndarray, first: np.ndarray, stretch: int = STRETCH) -> np.ndarray:
        """The weight of each token. word: the texts' tokens, one text after another; first: the texts' first tokens, and the end.

        A text is traversed from its beginning. Of a text of more than ``stretch`` tokens several stretches are traversed side by side; the later
        ones run in from the root over the order - 1 tokens before, after which the state no longer depends on where it began.
        """
        tokens = int(first[-1])
        out = np.zeros(tokens)
        lanes = -(-np.diff(first) // stretch)
        text = np.repeat(first[:-1], lanes)
        start = text + stretch * (np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes))
        stop = np.minimum(start + stretch, np.repeat(first[1:], lanes))
        run_in = np.maximum(start - (self.order - 1), text)
        by_size = np.argsort(run_in - stop, kind="stable")  # lanes that are still going are a prefix
        text, start, run_in, stop = text[by_size], start[by_size], run_in[by_size], stop[by_size]
        state = np.where(run_in == text, self.begin, 0)
        for step in range(int((stop - run_in).max(initial=0))):
            n = int(np.searchsorted(run_in - stop, -step, "left"))
            t = run_in[:n] + step
            weight, state = self.step(state[:n], word[t])
            own = t >= start[:n]
            out[t[own]] = weight[own]
        return out


def _score(names: list[str], order: int):
    new = [c.split()[0] for c in SCORES.split(", ")]

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        grams = _Grams.of(docs, order)
        first, found = grams.first, grams.distinct()
        rows = X.by_level(answers)[0]
        total, distinct = sum(r["m"] for r in rows), sum(r["n"] for r in rows)
        answered = X.in_bucket_order([(keys, {}) for keys, _ in found], [X.unpack(r["x"], "<i8") for r in rows], len(rows))
        counts = dict(enumerate(answered, 1))
        local = {k: place for k, (_, place) in enumerate(found, 1)}
        word = local[1]
        words, begins = len(counts[1]), int(counts[1][word[first[1] - 1]])
        is_first = np.zeros(int(first[-1]), bool)
        is_first[first[:-1]] = True
        last, context, suffix = {}, {}, {}
        for k in range(2, order + 1):
            some = np.flatnonzero(local[k] >= 0)
            example = np.zeros(len(counts[k]), np.int32)
            example[local[k][some]] = some
            before = local[k - 1][example - 1]
            context[k] = np.where(is_first[example], words, before) if k == 2 else before
            suffix[k], last[k] = local[k - 1][example], word[example]
        del found, answered, local, is_first
        automaton = BackoffAutomaton.of(counts, last, context, suffix, begins, total, distinct)
        del last, context, suffix
        counts = {1: counts[1]}
        at = first[:-1]
        known = np.add.reduceat((counts[1] > 0).astype(np.int64)[word], at)
        base = np.add.reduceat(np.log10(counts[1] + 0.5)[word], at) - np.diff(first) * math.log10(total + 0.5 * (distinct + 1))
        score = np.add.reduceat(automaton.traverse(word, first), at)
        columns = [np.diff(first), known, np.full(docs.num_rows, total), base, score]
        return pa.table([docs[c] for c in names] + [pa.array(x) for x in columns], names + new)

    return run


def score_texts(docs: DataFrame, train: Column, text: str = "text", keep: tuple[str, ...] = ("doc_id",), order: int = ORDER) -> DataFrame:
    """keep columns with n_tokens, n_known, train_tokens, base_score and score of each row; the rows where ``train`` holds make the model."""
    if clash := set(keep) & {*(c.split()[0] for c in SCORES.split(", ")), _TEXT, _TRAIN}:
        raise ValueError(f"keep has columns that are made: {sorted(clash)}")
    n = X.blocks_for(docs, text, BLOCK)
    slim = docs.select(*keep, F.col(text).alias(_TEXT), F.coalesce(train, F.lit(True)).alias(_TRAIN))
    route = X.Route.of(n)
    blocks = X.in_blocks(slim, n)
    answers = X.look_up(X.ask(blocks, _ask(order), route.first), _Counts(), route)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields if f.name in keep)
    return X.finish(blocks, answers, _score(list(keep), order), f"{kept}, {SCORES}")


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(5))


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = score_texts(docs.withColumn("held_out", fold() == 1), ~F.col("held_out"), keep=("doc_id", "held_out"))
    return scored.select("doc_id", "held_out", *[c.split()[0] for c in SCORES.split(", ")])


def brute_force(rows: list[tuple], order: int = ORDER, prior: dict[int, float] = PRIOR) -> list[tuple]:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) by dictionaries and the recursive formula, for tests."""
    import re
    import zlib
    from collections import Counter

    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    texts = [[*re.findall("[^\x20\x09-\x0d]+", (t or "").translate(lower)), None] for _, t in rows]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1 for i, _ in rows]
    count, context = Counter(), Counter()
    for t, h in zip(texts, held, strict=True):
        padded = ["<s>", *t]
        for i in range(0 if h else len(t)):
            for k in range(1, min(order, i + 2) + 1):
                gram = tuple(padded[i + 2 - k : i + 2])
                count[gram] += 1
                context[gram[:-1]] += 1
    total, distinct = context[()], sum(len(g) == 1 for g in count)

    def p(h: tuple, w) -> float:
        if not h:
            return (count[w,] + 0.5) / (total + 0.5 * (distinct + 1))
        lower_p = p(h[1:], w)
        m = prior[len(h)]
        return (count[*h, w] + m * lower_p) / (context[h] + m) if context[h] else lower_p

    out = []
    for (doc_id, _), t, h in zip(rows, texts, held, strict=True):
        padded = ["<s>", *t]
        score = sum(math.log10(p(tuple(padded[max(0, i + 2 - order) : i + 1]), w)) for i, w in enumerate(t))
        base = sum(math.log10(p((), w)) for w in t)
        out.append((doc_id, h, len(t), sum(count[w,] > 0 for w in t), total, base, score))
    return out
