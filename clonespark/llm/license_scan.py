"""License texts in documents by diagonal voting, with DataFrame operations only.

A template is a phrase, a statement or a notice of a license. The k-grams of words of all documents are hashed and joined with the hashes of the templates' k-grams; a
match at word p of a document and word t of a template is a vote for the diagonal p - t. Votes are summed up by (document, template, diagonal) as a bit for each
template word that they cover. Diagonals no further apart than the template's slack are merged, as words left out or put in shift the rest of a text
by a few places. What remains are spans, which are verified: twice the template words that a span covers, over the template's length and the span's, has to
reach ``LEAST`` (of the merged diagonals, or of one of them alone). Phrases have no slack and must be covered as a whole, so theirs are exact
places. The words of matching k-grams are compared, so hashes that agree by chance do not count.

The join is of the documents' k-grams, as they are made, with a local table of the templates' (some hundreds of rows, which Spark broadcasts by its size); only
matches are shuffled. These are found again by the document's id and the SHA-256 of its text: rows that are equal in both vote for the same bits, are summed up
before they are shuffled, and have the same result, each of them once. A task holds one text's words.

A null text is empty. A document without a match has no labels (an empty text) and the score 0. Null ids are as any other. Ties: a span's score is its best one.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clonespark.plans.lineage import stored

#: Letters, digits and all that is not ASCII make words, after A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words in a k-gram at most, in a template at most (a bit for each; longer ones are cut), and what verifies a span of a notice.
GRAM, MOST, LEAST = 3, 60, 0.8
#: Phrases whose places are the base, by label (fixed values).
PHRASES = [("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")]
#: Names and statements of licenses, which have to be there word for word, by label (fixed values).
STATEMENTS = [
    ("mit", "Released under the MIT License"),
    ("apache-2.0", "Apache License, Version 2.0"),
    ("gpl-3.0", "GNU General Public License, version 3"),
    ("gpl-2.0", "GNU General Public License, version 2"),
    ("lgpl", "GNU Lesser General Public License"),
    ("agpl", "GNU Affero General Public License"),
    ("mpl-2.0", "Mozilla Public License, v. 2.0"),
    ("cc-by-4.0", "CC BY 4.0"),
    ("cc-by-4.0", "Creative Commons Attribution 4.0"),
    ("cc-by-sa-4.0", "CC BY-SA 4.0"),
    ("cc-by-sa-4.0", "Creative Commons Attribution-ShareAlike 4.0"),
    ("cc-by-nc-4.0", "CC BY-NC 4.0"),
    ("cc-by-nc-4.0", "Creative Commons Attribution-NonCommercial 4.0"),
    ("all-rights-reserved", "All rights reserved"),
]
#: Running text of licenses, of which some words may differ, by label (fixed values, the public texts themselves).
NOTICES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]


@dataclass(frozen=True)
class Template:
    """Words that stand for a label. base: its places are counted; whole: it has to be there word for word. slack: how far apart diagonals of one span may be."""

    label: str
    words: tuple[str, ...]
    base: bool = False
    whole: bool = False

    @property
    def slack(self) -> int:
        return 0 if self.whole else len(self.words) // 4

    @property
    def grams(self) -> list[tuple[int, tuple[str, ...]]]:
        k = min(GRAM, len(self.words))
        return [(t, self.words[t : t + k]) for t in range(len(self.words) - k + 1)]


def templates(phrases: list[tuple[str, str]] = PHRASES, statements: list[tuple[str, str]] = STATEMENTS, notices: list[tuple[str, str]] = NOTICES) -> list[Template]:
    """Templates of (label, text); a notice of more than MOST words becomes several."""
    out = []
    for base, whole, pairs in ((True, True, phrases), (False, True, statements), (False, False, notices)):
        for label, text in pairs:
            words = re.findall(WORD, text.translate(str.maketrans(UPPER, LOWER)))
            if not re.fullmatch(r"[\w.+-]+", label) or len(words) < 2 or whole and len(words) > MOST:
                raise ValueError(f"a label of letters, digits and .+-_, and two words or more (at most {MOST} that have to be there word for word): {label!r}, {text!r}")
            n = -(-len(words) // MOST)
            cuts = [i * len(words) // n for i in range(n + 1)]
            out += [Template(label, tuple(words[i:j]), base, whole) for i, j in zip(cuts, cuts[1:], strict=False)]
    return out


def _values(rows: list[str], columns: str) -> str:
    return f"(select * from values {', '.join(rows)} as t({columns}))"


def _tables(spark: SparkSession, known: list[Template]) -> tuple[DataFrame, DataFrame]:
    """(k-grams: tid, t, k, known, mask and hash h; templates: tid, label, base, whole, n, slack), both local."""
    grams = [f"({i}, {t}, {len(g)}, array({', '.join(f"'{w}'" for w in g)}), {sum(1 << (t + k) for k in range(len(g)))}L)" for i, x in enumerate(known) for t, g in x.grams]
    names = [f"({i}, '{x.label}', {str(x.base).lower()}, {str(x.whole).lower()}, {len(x.words)}, {x.slack})" for i, x in enumerate(known)]
    table = spark.sql(f"select * from {_values(grams, 'tid, t, k, known, mask')}").withColumn("h", F.xxhash64("known"))
    return table, spark.sql(f"select * from {_values(names, 'tid, label, base, whole, n, slack')}")


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def word_count(text: Column) -> Column:
    """The number of words, without making them."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD.replace(r"\x60", r"\x40\x5B-\x60"))).cast("long")


def digest_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def votes(docs: DataFrame, known: list[Template], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, digest, tid, diagonal, mask, first, stop): the template words that a diagonal covers, and where in the document."""
    grams, _ = _tables(docs.sparkSession, known)
    sizes = sorted({len(g) for x in known for _, g in x.grams})
    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), digest_of(F.col(f"`{text}`")).alias("digest"), words_of(F.col(f"`{text}`")).alias("words"))
    at = rows.select("id", "digest", "words", F.posexplode("words").alias("p", "_word"))
    hashes = F.array(*[F.when(F.col("p") + k <= F.size("words"), F.xxhash64(F.slice("words", F.col("p") + 1, k))) for k in sizes])
    each = at.select("id", "digest", "words", "p", F.posexplode(hashes).alias("_k", "h"))
    each = each.select("id", "digest", "p", "h", F.slice("words", F.col("p") + 1, F.element_at(F.array(*map(F.lit, sizes)), F.col("_k") + 1)).alias("gram"))
    found = each.join(grams, "h").where("gram = known")
    return found.groupBy("id", "digest", "tid", (F.col("p") - F.col("t")).alias("diagonal")).agg(F.bit_or("mask").alias("mask"), F.min("p").alias("first"), F.max(F.col("p") + F.col("k")).alias("stop"))


def spans(docs: DataFrame, known: list[Template] | None = None, least: float = LEAST, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, digest, label, base, first, stop, score): verified spans of words; digest is the SHA-256 of the text."""
    known = known or templates()
    _, names = _tables(docs.sparkSession, known)
    alike = lambda mask, size: 2.0 * F.bit_count(mask) / (F.col("n") + size)
    one = Window.partitionBy("id", "digest", "tid").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(one) > F.col("slack"), F.lit(True))
    lines = votes(docs, known, doc_id, text).join(names, "tid").withColumn("_apart", apart.cast("int")).withColumn("_span", F.sum("_apart").over(one))
    lines = lines.withColumn("_alone", alike(F.col("mask"), F.col("stop") - F.col("first")))
    merged = lines.groupBy("id", "digest", "tid", "_span", "label", "base", "whole", "n").agg(F.bit_or("mask").alias("mask"), F.min("first").alias("first"), F.max("stop").alias("stop"), F.max("_alone").alias("_alone"))
    merged = merged.withColumn("score", F.greatest(alike(F.col("mask"), F.col("stop") - F.col("first")), "_alone"))
    return merged.where(F.col("score") >= F.when(F.col("whole"), 1.0).otherwise(least)).select("id", "digest", "label", "base", "first", "stop", "score")


def scanned(found: DataFrame) -> DataFrame:
    """(id, digest, n_base, first_word, last_word, base_labels, labels, score) of the documents that have spans."""
    base = lambda c: F.when(F.col("base"), F.col(c))
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return found.groupBy("id", "digest").agg(
        F.count(base("first")).alias("n_base"), F.min(base("first")).cast("long").alias("first_word"), F.max(base("first")).cast("long").alias("last_word"),
        listed(base("label")).alias("base_labels"), listed(F.col("label")).alias("labels"), F.max("score").alias("score"),
    )


def scan_licenses(docs: DataFrame, known: list[Template] | None = None, least: float = LEAST, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row."""
    found, _ = stored(scanned(spans(docs, known, least, doc_id, text)).withColumnsRenamed({"id": "_id", "digest": "_digest"}), "licenses")
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), digest_of(F.col(f"`{text}`")).alias("digest"), word_count(F.col(f"`{text}`")).alias("n_words"))
    both = rows.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left")
    empty = {"n_base": F.lit(0).cast("long"), "base_labels": F.lit(""), "labels": F.lit(""), "score": F.lit(0.0)}
    return both.select("doc_id", "n_words", *[F.coalesce(c, empty[c]).alias(c) if c in empty else F.col(c) for c in ("n_base", "first_word", "last_word", "base_labels", "labels", "score")])


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _oracle() -> str:
    known = templates()
    grams = ", ".join(f"({i}, {t}, {len(g)}, '{' '.join(g)}', {sum(1 << (t + k) for k in range(len(g)))}::bigint)" for i, x in enumerate(known) for t, g in x.grams)
    names = ", ".join(f"({i}, '{x.label}', {str(x.base).lower()}, {str(x.whole).lower()}, {len(x.words)}, {x.slack})" for i, x in enumerate(known))
    return rf"""
with g(tid, t, k, gram, mask) as (values {grams}), n(tid, label, base, whole, n, slack) as (values {names}),
d as (select row_number() over () r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') w from documents),
p as (select r, i - 1 p, w[i] a, w[i + 1] b, w[i + 2] c from d, unnest(range(1, len(w) + 1)) t(i)),
v as (select r, tid, p - t diagonal, bit_or(mask) mask, min(p) first, max(p + k) stop from (select r, p, 2 k, a || ' ' || b gram from p union all select r, p, 3, a || ' ' || b || ' ' || c from p) join g using (k, gram) group by all),
l as (select *, coalesce(diagonal - lag(diagonal) over (partition by r, tid order by diagonal) > slack, true)::int apart, 2.0::double * bit_count(mask) / (n + stop - first) alone from v join n using (tid)),
m as (select *, sum(apart) over (partition by r, tid order by diagonal) span from l),
s as (select r, label, base, whole, min(first) first, greatest(2.0::double * bit_count(bit_or(mask)) / (n + max(stop) - min(first)), max(alone)) score from m group by r, tid, span, label, base, whole, n),
o as (select r, count(*) filter (base) n_base, min(first) filter (base) first_word, max(first) filter (base) last_word, string_agg(distinct label, ',' order by label) filter (base) base_labels,
  string_agg(distinct label, ',' order by label) labels, max(score) score from s where score >= case when whole then 1.0 else {LEAST} end group by r)
select doc_id, len(w) n_words, coalesce(n_base, 0) n_base, first_word, last_word, coalesce(base_labels, '') base_labels, coalesce(labels, '') labels, coalesce(score, 0)::double score from d left join o using (r)
"""


#: DuckDB SQL of op13_license_scan.
ORACLE = _oracle()
