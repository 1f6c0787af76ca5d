"""Fill-in-middle: texts rearranged so that a model learns to write what lies between a prefix and a suffix.

A text of n units is cut at two drawn places. The output has the three pieces, each led by its sentinel: prefix, suffix, middle (``psm``) or suffix,
prefix, middle (``spm``); or it is the text itself (``plain``), as drawn, or where the text is empty or has a sentinel in it.

One Aho-Corasick automaton scans each text once and finds its events: the ASCII characters that change the class (the six that
separate words) and the sentinels. What lies between two events is of one class, so its number of units follows from its length: a code point
each, or one word. Running sums over the events hold the units before each gap, so the place of any unit is a binary search among the events and
one addition; no table of a text's units is made. The same automaton finds the sentinels of an output when the text is built again from it.

``units``: ``chars`` are code points; ``words`` are words with the separators after them (and those before the first word), one unit for a
text of separators alone. Draws are four numbers of a hash of the seed and the id, so reruns agree and partitions do not matter.

A null text is empty. A null id is hashed as an empty one. Rows that repeat an id share its draws, and equal rows have equal results. Texts are
scanned one at a time, whatever their length; a task holds one text, its output, its events and the rows of one Arrow batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clonespark.llm import arrowtext as A

#: Sentinels of prefix, suffix and middle; the characters that separate words; percent of the texts that are rearranged, and of these those that are spm.
SENTINELS, SEPARATORS = ("<P>", "<S>", "<M>"), "\t\n\x0b\x0c\r "
REARRANGED, SPM = 90, 20
#: Bytes of text in one batch of results.
CHUNK = 1 << 22
MADE = "n long, form string, prefix_units long, middle_units long, output string"


@dataclass
class Events:
    """A text's events, in order, and the units before each of the gaps that they leave (one more than the separators)."""

    gaps: np.ndarray
    before: np.ndarray
    inside: np.ndarray
    units: int
    sentinels: list[tuple[int, int]]
    length: int

    def place(self, rank: int) -> int:
        """Where the unit with this rank begins; the text's end for a rank beyond the last."""
        if rank <= 0 or rank >= self.units:
            return 0 if rank <= 0 else self.length
        gap = int(np.searchsorted(self.before + self.inside, rank, "right"))
        return int(self.gaps[gap] + rank - self.before[gap])


class EventScan:
    """The automaton of separators and sentinels, for one kind of unit."""

    def __init__(self, sentinels: tuple[str, str, str] = SENTINELS, units: str = "chars"):
        if units not in ("chars", "words"):
            raise ValueError(f"units are chars or words, not {units}")
        for s in sentinels:
            for t in sentinels:
                # otherwise a sentinel could begin in a piece and end in the sentinel after it
                if not s or any(s.endswith(t[:k]) for k in range(1, len(t))) or (s != t and s in t):
                    raise ValueError(f"sentinels must not be empty, hold or overlap each other: {s!r}, {t!r}")
        if len(set(sentinels)) < 3 or any(s in SEPARATORS for s in sentinels):
            raise ValueError("three sentinels, none of them a separator")
        self.sentinels, self.units = sentinels, units
        self.automaton = ahocorasick.Automaton()
        for c in SEPARATORS:
            self.automaton.add_word(c, 0)
        for k, s in enumerate(sentinels):
            self.automaton.add_word(s, k + 1)
        self.automaton.make_automaton()

    def events(self, text: str) -> Events:
        found = np.fromiter((end << 2 | kind for end, kind in self.automaton.iter(text)), np.int64) if text else np.zeros(0, np.int64)
        kind, end = found & 3, found >> 2
        marks = [(int(e) + 1 - len(self.sentinels[k - 1]), int(k) - 1) for e, k in zip(end[kind > 0], kind[kind > 0], strict=True)]
        breaks = end[kind == 0]
        gaps = np.concatenate([[0], breaks + 1])
        size = np.concatenate([breaks, [len(text)]]) - gaps
        inside = size if self.units == "chars" else (size > 0).astype(np.int64)
        each = inside + (1 if self.units == "chars" else 0)  # a separator is a unit of its own, or belongs to the word before it
        before = np.concatenate([[0], np.cumsum(each)[:-1]])
        units = int(before[-1] + inside[-1]) or int(bool(text))
        return Events(gaps, before, inside, units, marks, len(text))

    def rearranged(self, text: str, draws: tuple[int, int, int, int], share: int = REARRANGED, spm: int = SPM) -> tuple:
        """(units, form, units of the prefix, of the middle, output)."""
        e = self.events(text)
        if not text or e.sentinels or draws[2] % 100 >= share:
            return e.units, "plain", None, None, text
        first, last = sorted(d % (e.units + 1) for d in draws[:2])
        i, j = e.place(first), e.place(last)
        p, s, m = (mark + piece for mark, piece in zip(self.sentinels, (text[:i], text[j:], text[i:j]), strict=True))
        form = "spm" if draws[3] % 100 < spm else "psm"
        return e.units, form, first, last - first, (s + p if form == "spm" else p + s) + m

    def restored(self, output: str, form: str | None) -> str:
        """The text of an output; a ValueError if a form's sentinels are not there in its order."""
        if form == "plain":
            return output
        marks = self.events(output).sentinels
        order = {"psm": [0, 1, 2], "spm": [1, 0, 2]}.get(form)
        if [k for _, k in marks] != order or marks[0][0]:
            raise ValueError(f"no output of the form {form}")
        stops = [at for at, _ in marks[1:]] + [len(output)]
        piece = {k: output[at + len(self.sentinels[k]) : stop] for (at, k), stop in zip(marks, stops, strict=True)}
        return piece[0] + piece[2] + piece[1]


def _each(df: DataFrame, kept: int, make: Callable[[list, list], list[pa.Array]], schema: str, names: list[str]) -> DataFrame:
    """The first ``kept`` columns and what make() gives of the two that follow, of which the last is a text; by ranges of rows of CHUNK bytes of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, offsets = A.column_bytes(b.column(b.num_columns - 1))
            for i, j in A.chunks(offsets, CHUNK):
                part = b.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns[:kept], *make(part.column(kept).to_pylist(), part.column(kept + 1).to_pylist())], names=names)
        A.release()

    return df.mapInArrow(run, schema)


def _kept(df: DataFrame, keep: tuple[str, ...], made: str) -> str:
    if clash := set(keep) & {c.split()[0] for c in made.split(", ")}:
        raise ValueError(f"keep has columns that are made: {sorted(clash)}")
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.select(*[F.col(f"`{c}`") for c in keep]).schema.fields) + made


def fill_in_middle(docs: DataFrame, seed: str = "1", share: int = REARRANGED, spm: int = SPM, sentinels: tuple[str, str, str] = SENTINELS, units: str = "chars", doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns with n (units), form, prefix_units and middle_units (null if plain) and the output of each row."""
    schema = _kept(docs, keep, MADE)
    names = [*keep, *(c.split()[0] for c in MADE.split(", "))]
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit(""))).cast("binary"), 256)
    EventScan(sentinels, units)  # settings are checked here rather than by tasks

    def make(digests: list[str], texts: list[str | None]) -> list[pa.Array]:
        scan = EventScan(sentinels, units)
        rows = [scan.rearranged(t or "", tuple(int(h[k : k + 8], 16) for k in range(0, 32, 8)), share, spm) for h, t in zip(digests, texts, strict=True)]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        return [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]

    return _each(docs.select(*[F.col(f"`{c}`") for c in keep], digest.alias("_digest"), F.col(f"`{text}`").alias("_text")), len(keep), make, schema, names)


def restore(made: DataFrame, sentinels: tuple[str, str, str] = SENTINELS, form: str = "form", output: str = "output", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns with the text (``restored``) that each row's output and form stand for."""
    schema = _kept(made, keep, "restored string")
    EventScan(sentinels)

    def make(forms: list[str], outputs: list[str | None]) -> list[pa.Array]:
        scan = EventScan(sentinels)
        return [pa.array([scan.restored(t or "", f) for f, t in zip(forms, outputs, strict=True)], pa.string())]

    return _each(made.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{form}`").alias("_form"), F.col(f"`{output}`").alias("_output")), len(keep), make, schema, [*keep, "restored"])


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's form, and digests of its output and of the text built again from that."""
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    made = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    made = made.withColumnsRenamed({"prefix_units": "prefix_chars", "middle_units": "middle_chars"}).withColumn("output_sha256", sha("output"))
    back = restore(made, keep=("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256"))
    return back.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", sha("restored").alias("restored_sha256"))


#: DuckDB SQL of op12_fill_in_middle. Its restored text is the input, as a right one is.
ORACLE = """
with d as (select doc_id, coalesce(text, '') t, length(coalesce(text, '')) n, sha256('1:' || coalesce(cast(doc_id as varchar), '')) h from documents),
k as (select *, ('0x' || h[1:8])::bigint % (n + 1) a, ('0x' || h[9:16])::bigint % (n + 1) b, ('0x' || h[17:24])::bigint h3, ('0x' || h[25:32])::bigint h4 from d),
f as (select *, least(a, b) i, greatest(a, b) j, case when n = 0 or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end form from k),
o as (select *, substring(t, 1, i) p, substring(t, i + 1, j - i) m, substring(t, j + 1) s from f)
select doc_id, n, form, case when form <> 'plain' then i end prefix_chars, case when form <> 'plain' then j - i end middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) output_sha256, sha256(t) restored_sha256 from o
"""
