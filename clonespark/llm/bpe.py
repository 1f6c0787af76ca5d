"""Exact BPE encoding and decoding by dynamic programming over prefixes.

Every prefix of a word has one encoding, hence one last token. A suffix automaton over the vocabulary
(Aho-Corasick) gives all tokens that end at a position; the last token is the one of them that is compatible with
the last token of the prefix before it. Back-pointers from the word's end then give the ids.

Two adjacent tokens are compatible if no merge across their border would have come first. A merge's rank is
its time: on the right edge of the left token stands a chain of its right parts, each from the time it was
merged until it was merged into the next, and likewise on the left edge of the right token. A merge of two parts
that stand at its time breaks the pair. Of equal ranks the leftmost merge goes first.

All distinct pieces of a chunk go through the table in lockstep: one run of the automaton over all of them, then one step for
each place, in which the matches that end there are tested against the last tokens before them. Pieces beyond ``LONG``
bytes go through the same recurrence one by one.

Around that: special tokens are cut out first; the rest is normalised (NFC, lower case) and cut into pieces by the
file's pattern, none of which ever joins what white space separates, so distinct words are encoded once per chunk. What is a
letter or a number, its composed form and its lower case follow the ``tokenizers`` library's own Unicode tables, which are of several versions and
none of them Python's; only these tables come from there.

Null and empty texts, and texts of white space only, have no ids and decode to the empty text. Repeated rows are rows of their own with equal
results. A text is handled whole, whatever its length. ``keep`` may name any columns but those that are made (ValueError).
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clonespark.llm import arrowtext as A

#: Bytes of text handled at once, of ids and decoded texts returned at once, and of a piece that goes with the others.
CHUNK, OUT, LONG = 1 << 22, 1 << 21, 64
#: Slots (a power of two) of a worker's cache of tested pairs.
PAIRS = 1 << 21
#: The pattern of files of this kind (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SIGN, _SPACE, _LETTER, _NUMBER = range(4)


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: itself, or the next free one from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


@cache
def unicode_classes() -> bytes:
    """The class of each code point (sign, white space, letter, number) as the library's patterns have it, compressed."""
    from tokenizers import Regex, pre_tokenizers

    table = np.zeros(0x110000, np.uint8)
    for kind, name in ((_SPACE, r"\s+"), (_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+")):
        split = pre_tokenizers.Split(Regex(name), "removed", invert=True)
        for start in range(0, 0x110000, 2048):
            text = "".join(map(chr, range(start, start + 2048))) if not 0xD800 <= start < 0xE000 else ""
            for found, _ in split.pre_tokenize_str(text):
                table[np.frombuffer(found.encode("utf-32-le"), "<u4")] = kind
    return zlib.compress(table.tobytes(), 1)


class _Pairs:
    """Whether two tokens can stand side by side: chains of parts and a cache of answers, for arrays of pairs."""

    def __init__(self, tokens: int, merges: list[tuple[int, int, int]]) -> None:
        """merges: (left, right, made) in the order of their ranks."""
        left, right, made = (np.array([m[k] for m in merges], np.int64) for k in range(3))
        self._shift = max(1, int(tokens).bit_length())
        order = np.argsort(left << self._shift | right, kind="stable")
        self._merge, self._rank = (left << self._shift | right)[order], order
        self._parts = np.full((2, tokens), -1, np.int64)
        self._parts[0, made], self._parts[1, made] = left, right
        self._born = np.full(tokens, -1, np.int64)
        self._born[made] = np.arange(len(merges))
        if any((self._born[side] > np.arange(len(merges))).any() for side in (left, right)):
            raise ValueError("a merge comes before its parts")
        self._keys, self._found = np.full(PAIRS, -1, np.int64), np.zeros(PAIRS, bool)

    def _chain(self, token: np.ndarray, side: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(part, born, gone) of the chains on the tokens' left (0) or right (1) edges, whole tokens first; part -1 beyond a chain's end."""
        gone = np.full(len(token), np.iinfo(np.int64).max)
        while (token >= 0).any():
            born = np.where(token >= 0, self._born[token], -1)
            yield token, born, gone
            token, gone = np.where(token >= 0, self._parts[side, token], -1), born

    def _test(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        ok = np.ones(len(left), bool)
        rights = list(self._chain(right, 0))
        for x, x_born, x_gone in self._chain(left, 1):
            for y, y_born, y_gone in rights:
                some = np.flatnonzero(ok & (x >= 0) & (y >= 0))
                key = x[some] << self._shift | y[some]
                at = np.minimum(np.searchsorted(self._merge, key), len(self._merge) - 1)
                hit = self._merge[at] == key
                some, rank = some[hit], self._rank[at[hit]]
                ok[some[(x_born[some] < rank) & (rank < x_gone[some]) & (y_born[some] < rank) & (rank <= y_gone[some])]] = False
        return ok

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << self._shift | right
        slot = (A.mix64(key.astype(np.uint64)) & np.uint64(PAIRS - 1)).astype(np.int64)
        out = self._found[slot]
        new = np.flatnonzero(self._keys[slot] != key)
        if len(new):
            fresh, back = np.unique(key[new], return_inverse=True)
            got = self._test(fresh >> self._shift, fresh & ((1 << self._shift) - 1)) if len(self._merge) else np.ones(len(fresh), bool)
            out[new] = got[back]
            at = (A.mix64(fresh.astype(np.uint64)) & np.uint64(PAIRS - 1)).astype(np.int64)
            self._keys[at], self._found[at] = fresh, got
            self._found[at] = got[np.searchsorted(fresh, self._keys[at])]  # of two keys of one slot the one that is there
        return out


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start..start + size of each run, one run after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


class BpeCodec:
    """The encoder and decoder of a tokenizer file of the word-end BPE kind; other kinds raise ValueError."""

    def __init__(self, text: str, classes: bytes | None = None) -> None:
        from tokenizers import Regex, normalizers, pre_tokenizers

        spec = json.loads(text)
        model, steps, pre = spec["model"], spec["normalizer"]["normalizers"], spec["pre_tokenizer"]["pretokenizers"]
        shape = [s["type"] for s in steps], [p["type"] for p in pre], bool(model["end_of_word_suffix"]), spec["decoder"], spec["post_processor"]
        if shape != (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"], True, None, None) or pre[0]["pattern"]["Regex"] != PATTERN or pre[1]["use_regex"] or pre[1]["add_prefix_space"]:
            raise ValueError("not a tokenizer of this kind")
        self._class = np.frombuffer(zlib.decompress(classes or unicode_classes()), np.uint8)
        compose, lower = normalizers.NFC(), normalizers.Lowercase()
        self._normal = lambda text: lower.normalize_str(compose.normalize_str(text))
        split = pre_tokenizers.Split(Regex(PATTERN), "removed", invert=True)
        self._split = lambda text: [piece for piece, _ in split.pre_tokenize_str(text)]
        self._special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        end, ids = model["end_of_word_suffix"], model["vocab"]
        names = {i: t for t, i in ids.items()} | {i: t for t, i in self._special.items()}
        self._tokens = max(names) + 1
        self._names = pa.array([f"{names.get(i, '')} ".encode() for i in range(self._tokens)], pa.large_binary())
        byte = {c: chr(b) for b, c in enumerate(_byte_letters())}
        self._automaton, self._size = ahocorasick.Automaton(ahocorasick.STORE_INTS), np.zeros(self._tokens, np.int64)
        for token, i in ids.items():
            body = token.removesuffix(end)
            symbols = "".join(byte[c] for c in body)
            if token != body:
                symbols = symbols[:-1] + chr(256 + ord(symbols[-1]))
            self._size[i] = len(symbols)
            self._automaton.add_word(symbols, i)
        self._automaton.make_automaton()
        self._pairs = _Pairs(self._tokens, [(ids[a], ids[b], ids[a + b]) for a, b in model["merges"]])

    # -- pieces to ids --

    def _last_tokens(self, symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The last token of the encoding of every prefix of every piece, by the place of the prefix's last symbol."""
        last = np.full(len(symbols), -1, np.int64)
        text = symbols.astype("<u4").tobytes().decode("utf-32-le")
        # no token has a word's last symbol but at its end, so no match reaches over the border of two pieces
        found = np.fromiter(self._automaton.iter(text), np.dtype([("stop", np.int64), ("token", np.int64)]))
        stop, token = found["stop"], found["token"]
        first = np.repeat(starts, ends - starts)
        place = stop - first[stop]
        order = np.argsort(place.astype(np.uint8), kind="stable")  # pieces of at most LONG symbols
        stop, token = stop[order], token[order]
        before = stop - self._size[token]
        whole = before < first[stop]
        at = np.searchsorted(place[order], np.arange(int(place.max()) + 2 if len(place) else 1))
        for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            ok = whole[i:j].copy()
            rest = np.flatnonzero(~ok)
            ok[rest] = self._pairs.compatible(last[before[i:j][rest]], token[i:j][rest])
            last[stop[i:j][ok]] = token[i:j][ok]
        return last

    def _last_tokens_of_one(self, symbols: np.ndarray) -> np.ndarray:
        """The same for a single (long) piece, place by place."""
        last = [-1] * len(symbols)
        known: dict[tuple[int, int], bool] = {}
        for stop, token in self._automaton.iter(symbols.astype("<u4").tobytes().decode("utf-32-le")):
            if last[stop] < 0:
                before = stop - int(self._size[token])
                pair = (last[before], token) if before >= 0 else None
                if pair is not None and pair not in known:
                    known[pair] = bool(self._pairs.compatible(np.array([pair[0]]), np.array([token]))[0])
                if pair is None or known[pair]:
                    last[stop] = token
        return np.array(last, np.int64)

    def encode_pieces(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of pieces, spans of at least one byte."""
        sizes = ends - starts
        symbols = data[ragged(starts, sizes)].astype(np.int64)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        symbols[ends - 1] += 256
        long = np.flatnonzero(sizes > LONG)
        if len(long):
            last = np.full(len(symbols), -1, np.int64)
            short = np.flatnonzero(sizes <= LONG)
            places = ragged(starts[short], sizes[short])
            stops = np.cumsum(sizes[short])
            last[places] = self._last_tokens(symbols[places], stops - sizes[short], stops)
            for k in long:
                last[starts[k] : ends[k]] = self._last_tokens_of_one(symbols[starts[k] : ends[k]])
        else:
            last = self._last_tokens(symbols, starts, ends)
        # back-pointers, from all pieces' ends at once
        own, at, steps = np.arange(len(starts)), ends - 1, []
        while len(own):
            token = last[at]
            steps.append((own, token))
            at = at - self._size[token]
            going = at >= starts[own]
            own, at = own[going], at[going]
        n = np.zeros(len(starts), np.int64)
        for own, _ in steps:
            n[own] += 1
        offsets = np.concatenate([[0], np.cumsum(n)])
        ids = np.zeros(offsets[-1], np.int64)
        for i, (own, token) in enumerate(steps):
            ids[offsets[own + 1] - 1 - i] = token
        return ids, offsets

    # -- words to pieces --

    def _odd(self, word: str) -> list[str | int]:
        """The pieces of a word that may hold special tokens (as ids) or apostrophes."""
        at = [(i, t) for t in self._special if (i := word.find(t)) >= 0]
        if at:
            i, t = min(at, key=lambda x: (x[0], -len(x[1])))
            return [*self._odd(word[:i]), self._special[t], *self._odd(word[i + len(t) :])]
        return self._split(self._normal(word)) if word else []

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of words: texts without line ends."""
        if not words:
            return np.zeros(0, np.int64), np.zeros(1, np.int64)
        joined = np.frombuffer(b"\n".join(words) + b"\n", np.uint8)
        limits = np.concatenate([[0], np.flatnonzero(joined == 0x0A) + 1])
        having = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[limits]) > 0
        odd = having((joined == 0x27) | (joined == 0x3C))
        high = having(joined >= 0x80) & ~odd
        plain, others, rare = (np.flatnonzero(x) for x in (~odd & ~high, high, odd))
        text = b"".join(words[i] + b"\n" for i in plain).lower().decode()
        text += self._normal(b"".join(words[i] + b"\n" for i in others).decode()) if len(others) else ""
        code = np.frombuffer(text.encode("utf-32-le"), "<u4")
        kind = self._class[code]
        width = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
        place = np.concatenate([[0], np.cumsum(width)])
        begins = np.flatnonzero((kind != _SPACE) & ((kind == _NUMBER) | (kind != np.concatenate([[_SPACE], kind[:-1]]))))
        stops = np.flatnonzero((kind != _SPACE) & ((kind == _NUMBER) | (kind != np.concatenate([kind[1:], [_SPACE]])))) + 1
        word = np.concatenate([plain, others])[(np.cumsum(code == 0x0A) - (code == 0x0A))[begins]] if len(begins) else begins
        data, starts, ends = text.encode(), place[begins], place[stops]
        fixed = np.full(len(starts), -1, np.int64)
        if len(rare):  # their pieces follow the others
            more = [(i, p) for i in rare.tolist() for p in self._odd(words[i].decode())]
            raw = [b"" if isinstance(p, int) else p.encode() for _, p in more]
            stop = len(data) + np.cumsum([len(x) for x in raw])
            data, starts, ends = data + b"".join(raw), np.concatenate([starts, stop - [len(x) for x in raw]]).astype(np.int64), np.concatenate([ends, stop]).astype(np.int64)
            word = np.concatenate([word, [i for i, _ in more]]).astype(np.int64)
            fixed = np.concatenate([fixed, [p if isinstance(p, int) else -1 for _, p in more]]).astype(np.int64)
        raw = np.frombuffer(data, np.uint8)
        example, which = A.distinct_spans(raw, starts, ends)
        normal = ends[example] > starts[example]
        ids, offsets = self.encode_pieces(raw, starts[example][normal], ends[example][normal])
        n = np.zeros(len(example), np.int64)
        n[normal] = np.diff(offsets)
        first = np.concatenate([[0], np.cumsum(n)])[:-1]
        order = np.argsort(word, kind="stable")  # a word's pieces are already in order
        n, first, fixed, word = n[which][order], first[which][order], fixed[order], word[order]
        n[fixed >= 0] = 1
        places = ragged(first, n)
        out = ids[np.minimum(places, max(len(ids) - 1, 0))] if len(ids) else np.zeros(len(places), np.int64)
        out[(np.cumsum(n) - n)[fixed >= 0]] = fixed[fixed >= 0]
        return out, np.concatenate([[0], np.cumsum(np.bincount(word, n, len(words)).astype(np.int64))])

    # -- texts --

    def encode_texts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of texts. Each distinct word is encoded once."""
        words = A.split_words(data, offsets)
        example, which = A.distinct_spans(words.data, words.starts, words.ends)
        raw = words.data.tobytes()
        ids, first = self.encode_words([raw[s:e] for s, e in zip(words.starts[example].tolist(), words.ends[example].tolist(), strict=True)])
        n = np.diff(first)[which]
        return ids[ragged(first[:-1][which], n)], np.concatenate([[0], np.cumsum(n)])[words.first]

    def decode_texts(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, offsets) of the decoded texts, each with one space after its end: a file without a decoder has its tokens joined by spaces."""
        data, at = A.column_bytes(self._names.take(pa.array(ids)))
        return data, at[offsets]

    def encode(self, text: str) -> list[int]:
        """The ids of a text."""
        data = np.frombuffer(text.encode(), np.uint8)
        return self.encode_texts(data, np.array([0, len(data)]))[0].tolist()

    def decode(self, ids: list[int]) -> str:
        """The text of ids."""
        return self.decode_texts(np.array(ids, np.int64), np.array([0, len(ids)]))[0].tobytes()[:-1].decode()


_codecs: dict[str, BpeCodec] = {}


def codec(text: str, classes: bytes | None = None) -> BpeCodec:
    key = hashlib.sha256(text.encode()).hexdigest()
    if key not in _codecs:
        _codecs[key] = BpeCodec(text, classes)
    return _codecs[key]


def _digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    view = memoryview(np.ascontiguousarray(data)).cast("B") if len(data) else memoryview(b"")
    return pa.array([hashlib.sha256(view[i:j]).hexdigest() for i, j in zip(starts.tolist(), ends.tolist(), strict=True)], pa.string())


def encode_texts(docs: DataFrame, path: str | None = None, text: str = "text", keep: tuple[str, ...] = ("doc_id",), digests: bool = False) -> DataFrame:
    """keep columns with n_tokens, ids (array<long>) and decoded (string); with digests, ids_sha256 and decoded_sha256 in their place."""
    new_columns = ["n_tokens long", "ids_sha256 string", "decoded_sha256 string"] if digests else ["n_tokens long", "ids array<long>", "decoded string"]
    made = [c.split()[0] for c in new_columns]
    if set(keep) & set(made):
        raise ValueError(f"keep has columns that are made: {sorted(set(keep) & set(made))}")
    spec = docs.sparkSession.sparkContext.broadcast((Path(path or vocabulary_path()).read_text(encoding="utf-8"), unicode_classes()))
    slim = docs.select(*keep, F.col(text).alias("_text"))
    names = [*keep, *made]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(*spec.value)
        for b in batches:
            data, offsets = A.column_bytes(b.column(b.num_columns - 1))
            for i, j in A.chunks(offsets, CHUNK):
                ids, first = bpe.encode_texts(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                # ids and decoded texts take more room than texts, so a chunk's are returned in several batches
                for p, q in A.chunks(first * 16, OUT):
                    own, at = ids[first[p] : first[q]], first[p : q + 1] - first[p]
                    decoded, limits = bpe.decode_texts(own, at)
                    n = np.diff(at)
                    if digests:
                        new = [_digests(own.astype("<u4"), 4 * at[:-1], 4 * at[1:]), _digests(decoded, limits[:-1], limits[1:] - (n > 0))]
                    else:
                        stays = np.ones(len(decoded), bool)
                        stays[limits[1:][n > 0] - 1] = False
                        new = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(own)), A.string_array(decoded[stays], limits - np.concatenate([[0], np.cumsum(n > 0)]))]
                    yield pa.RecordBatch.from_arrays([c.slice(i + p, q - p) for c in b.columns[:-1]] + [pa.array(n, pa.int64()), *new], names=names)
                    del own, at, decoded, limits, new
                del ids, first
        A.release()

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:-1])
    return slim.mapInArrow(run, ", ".join([kept, *new_columns]))


def op7_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), digests=True)
