"""Single linkage of CDR3s within a class at distance thresholds of the class.

Texts at most t letters apart that are cut into t + 1 parts have an equal part. Where these parts would be shorter than ``SHORT`` letters, half as many
are cut, one of which differs in at most one letter; such a part stands once for each of its letters, with that letter left out. So the distinct CDR3s of a
class are exploded into parts, joined on (class, place, part), verified by packed comparison, and linked. Where even half as many parts would be too short (t is about two
thirds of the length, and most texts are linked) budgets grow until a class hangs together, and texts walk tries (``trie.py``). The links' least spanning forest (``spanning.py``) is cut at any number of
thresholds. Classes of few distinct CDR3s are linked where they lie (``pieces.py``), so their texts are not shuffled once for each part; larger ones are never gathered in one task, and
adaptive execution splits the partitions of parts that are frequent.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clonespark.functions import sequences as S
from clonespark.operators.components import connected_components
from clonespark.operators.numbering import numbered
from clonespark.operators.pieces import LOCAL, local_forest, local_labels
from clonespark.operators.spanning import cut, minimum_forest
from clonespark.operators.trie import trie_links
from clonespark.plans.lineage import stored
from clonespark.schema import CLASS

SHORT = 3
#: Rows of small classes for each task, and classes whose thresholds are sent to all tasks.
TASK, FEW = 1 << 18, 1 << 18


def _keys(text: Column, n: Column, t: Column) -> Column:
    """The parts that a text is found by, each with its place; texts at most t letters apart share one."""
    half = F.floor((t + 2) / 2)

    def cut(k: Column) -> Column:
        start, stop = F.floor(k["at"] * n / k["of"]).cast("int"), F.floor((k["at"] + 1) * n / k["of"]).cast("int")
        return F.struct(k["at"].alias("at"), F.substring(text, start + 1, stop - start).alias("part"))

    def parts(of: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), of.cast("int") - 1), lambda i: cut({"at": i, "of": of}))

    def without(p: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(p["part"])), lambda i: F.concat_ws("|", p["at"].cast("string"), F.overlay(p["part"], F.lit("_"), i, F.lit(1))))

    equal = F.transform(parts(t + 1), lambda p: F.concat_ws("|", p["at"].cast("string"), p["part"]))
    near = F.flatten(F.transform(parts(half), without))
    return F.when(n >= SHORT * (t + 1), equal).when(n >= SHORT * half, near)


def links(nodes: DataFrame, words: int, inclusive: bool = True) -> DataFrame:
    """(src, dst, w, within): links between nodes (node, within, text, t) of a group whose texts differ in w letters, at most t (less than t, if not inclusive).

    Nodes are longs, no less than their group's ``within``, best in the texts' order. A link is there once for each part that its texts share. Where there is a boolean column
    ``asked``, links without an asked node are left out.
    """
    t = F.col("t") if inclusive else F.col("t") - 1
    e = [f"_e{i}" for i in range(words)]
    nodes = nodes if "asked" in nodes.columns else nodes.withColumn("asked", F.lit(True))
    nodes = nodes.withColumn("t", t.cast("int")).where("t > 0").withColumn("_keys", _keys(F.col("text"), F.length("text"), F.col("t")))
    split = nodes.where("_keys is not null").withColumns(dict(zip(e, S.packed(F.col("text"), words), strict=True))).withColumn("_plain", S.plain(F.col("text")))
    split = split.withColumn("_part", F.explode("_keys")).drop("_keys")
    a, b = split.where("asked").alias("a"), split.alias("b")
    fast = S.packed_distance([F.col(f"a.{c}") for c in e], [F.col(f"b.{c}") for c in e])
    d = F.when(F.col("a._plain") & F.col("b._plain"), fast).otherwise(S.letter_distance(F.col("a.text"), F.col("b.text")))
    same = F.expr("a.within = b.within and a._part = b._part and (a.node < b.node or a.node > b.node and not b.asked)")
    near = a.join(b, same & (d <= F.col("a.t"))).select(F.least("a.node", "b.node").alias("src"), F.greatest("a.node", "b.node").alias("dst"), d.cast("int").alias("w"), F.col("a.within").alias("within"))
    return near.unionByName(trie_links(nodes.where("_keys is null")))


#: The first budget of groups with large thresholds, what each round adds, and the largest budget for which texts are joined on parts.
BUDGET, BY_PARTS = 2, 4


def spanning_links(nodes: DataFrame, words: int, inclusive: bool = True, known: DataFrame | None = None) -> DataFrame:
    """Links (src, dst, w, within) that hold a least spanning forest of all links: for thresholds at which most texts are linked, so that links are as many as pairs.

    Budgets grow from round to round, up to a group's threshold. A group that hangs together is finished, as heavier links only close circles; in the others
    only the texts outside the largest component ask for more. known: a forest of the links between nodes that are not asked.
    """
    t = F.col("t") if inclusive else F.col("t") - 1
    asked = F.col("asked") if "asked" in nodes.columns else F.lit(True)
    left, _ = stored(nodes.select("node", "within", "text", t.cast("int").alias("t"), asked.alias("asked")).where("t > 0"), "far")
    found, budget = known, BUDGET
    while not left.isEmpty():
        now = left.withColumn("t", F.least("t", F.lit(budget)))
        new = links(now, words) if budget <= BY_PARTS else trie_links(now)
        found = minimum_forest(new if found is None else new.unionByName(found))
        roots, _ = stored(left.join(connected_components(found.where(F.col("w") <= budget).select("src", "dst", "within"), within="within"), "node", "left").withColumn("root", F.coalesce("root", "node")), "roots")
        sizes = roots.groupBy("within", "root").agg(F.count("*").alias("n")).groupBy("within").agg(F.count("*").alias("_parts"), F.max(F.struct("n", "root"))["root"].alias("_largest"))
        going = roots.join(sizes, "within").where((F.col("_parts") > 1) & (F.col("t") > budget))
        left, _ = stored(going.select("node", "within", "text", "t", (F.col("root") != F.col("_largest")).alias("asked")), "far")
        budget += BUDGET
    return nodes.select(F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(0).alias("w"), "within").limit(0) if found is None else found


def forest_links(texts: DataFrame, words: int, inclusive: bool = True, known: DataFrame | None = None) -> DataFrame:
    """Links that hold a least spanning forest, by parts where these are long enough, and else by growing budgets; see the two."""
    joined = _keys(F.col("text"), F.length("text"), F.col("t")).isNotNull()
    return links(texts.where(joined), words, inclusive).unionByName(spanning_links(texts.where(~joined), words, inclusive, known))


@dataclass
class Linkage:
    """Single linkage of a repertoire's distinct CDR3s at several thresholds of each class, from one table of links.

    nodes: (class, cdr3, node, within, least, thresholds); forest: the least spanning forest of the links up to the largest threshold.
    """

    nodes: DataFrame
    forest: DataFrame
    columns: list[str]
    inclusive: bool

    def labels(self, names: dict[str, str]) -> DataFrame:
        """(class, cdr3, and for each name the label of a threshold's column): the least sequence_id of the node's cluster; null for a threshold below zero."""
        used = list(names.values())
        limit = self.nodes.groupBy("within").agg(*[(F.first(c) if self.inclusive else F.first(c) - 1).alias(c) for c in used])
        roots = cut(self.forest, limit, used)
        named = self.nodes.join(roots.withColumnsRenamed({c: f"_r{i}" for i, c in enumerate(used)}), "node", "left")
        out = named.select(*CLASS, "cdr3", "least", *used, *[F.coalesce(f"_r{i}", "node").alias(f"_r{i}") for i in range(len(used))])
        out, _ = stored(out, "rooted")
        for i in range(len(used)):
            least = out.groupBy(f"_r{i}").agg(F.min("least").alias(f"_l{i}"))
            out = out.join(least, f"_r{i}")
        return out.select(*CLASS, "cdr3", *[F.when(F.col(c) >= 0, F.col(f"_l{i}")).alias(name) for i, (name, c) in enumerate(names.items())])


def linkage(records: DataFrame, thresholds: DataFrame, columns: list[str], inclusive: bool = True) -> Linkage:
    """The linkage of records' CDR3s for thresholds (class, columns), one value for each class; links are made once, at the largest of the columns.

    Distinct CDR3s and classes are numbered, so that links and components are of longs.
    """
    t = thresholds.select(*CLASS, *columns)
    most = F.greatest(*[F.coalesce(c, F.lit(-1)) for c in columns], F.lit(-1))
    distinct = records.groupBy(*CLASS, "cdr3").agg(F.min("sequence_id").alias("least")).join(t, CLASS).where(most >= 0)
    nodes, _ = stored(numbered(distinct, [*CLASS, "cdr3"], "node", 0), "nodes")
    # the numbers of a class's nodes follow each other, so its least one stands for it
    length = F.length("cdr3")
    within = nodes.groupBy(*CLASS).agg(F.min("node").alias("within"), ((F.count("*") <= LOCAL) & (F.min(length) == F.max(length))).alias("_small"))
    nodes, _ = stored(nodes.join(within, CLASS), "numbered")
    texts = nodes.select("node", "within", F.col("cdr3").alias("text"), most.alias("t"), (F.col("_small") & (length >= SHORT * F.floor((most + 2) / 2))).alias("_small"))
    return Linkage(nodes.drop("_small"), whole_forest(texts, S.word_count(records, "cdr3"), inclusive), columns, inclusive)


def whole_forest(texts: DataFrame, words: int, inclusive: bool = True) -> DataFrame:
    """(src, dst, w, within), stored: the least forest of the links of texts (node, within, text, t, _small), those of small classes in tasks that have a class as a whole (``pieces.py``)."""
    t = F.col("t") if inclusive else F.col("t") - 1
    near, _ = stored(local_forest(texts.where("_small").withColumn("t", t.cast("int")).where("t > 0")), "forest")
    rest = texts.where("not _small").drop("_small")
    return near if rest.isEmpty() else near.unionByName(minimum_forest(forest_links(rest, words, inclusive)))


def class_sizes(records: DataFrame) -> DataFrame:
    """(class, _n, _least, _most), stored: the rows of each class, and its least and largest CDR3 length."""
    length = F.length("cdr3")
    return stored(records.groupBy(*CLASS).agg(F.count("*").alias("_n"), F.min(length).alias("_least"), F.max(length).alias("_most")), "sizes")[0]


def clusters(records: DataFrame, thresholds: DataFrame, names: dict[str, str], inclusive: bool = True, sizes: DataFrame | None = None, keep: list[str] | None = None) -> DataFrame:
    """records with labels {label: threshold column}, each the least sequence_id of the row's cluster, for thresholds (class, columns).

    A negative threshold leaves every row alone, and zero links equal CDR3s. Rows of classes without a threshold get null. sizes: class_sizes(records), where they are known; keep: the
    columns of the records that are wanted, so that others need not be moved.
    """
    t, keep = [f"_t{k}" for k in range(len(names))], records.columns if keep is None else keep
    limits = thresholds.select(*CLASS, *[F.col(c).cast("double").alias(k) for k, c in zip(t, names.values(), strict=True)])
    most = F.greatest(F.lit(-1.0), *[F.coalesce(k, F.lit(-1.0)) for k in t])
    sizes = (class_sizes(records) if sizes is None else sizes).join(limits, CLASS, "left")
    near = F.expr(f"_n <= {LOCAL} and _least = _most") & (F.col("_least") >= SHORT * F.floor((most + 2) / 2))
    sizes, _ = stored(sizes.select(*CLASS, "_n", *t, near.alias("_near"), F.monotonically_increasing_id().alias("_class")), "limits")
    rows, classes, far = sizes.agg(F.sum(F.when(F.col("_near"), F.col("_n"))), F.count("*"), F.count_if(~F.col("_near"))).first()
    small = sizes.where("_near").select(*CLASS, *t, "_class")
    parts = max(int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")), (rows or 0) // TASK)
    out = local_labels(records.join(F.broadcast(small) if classes <= FEW else small, CLASS), list(names), inclusive, parts, keep)
    return out if not far else out.unionByName(_joined(records.join(sizes.where("not _near").select(*CLASS), CLASS, "left_semi"), thresholds, names, inclusive).select(*keep, *names))


def _joined(records: DataFrame, thresholds: DataFrame, names: dict[str, str], inclusive: bool) -> DataFrame:
    """clusters() of classes that no task holds: CDR3s are linked by joins, and their labels joined back."""
    columns = list(dict.fromkeys(names.values()))
    found = linkage(records, thresholds, columns, inclusive).labels(names)
    t = thresholds.select(*CLASS, *[F.col(c).alias(f"_t_{c}") for c in columns])
    labels = found.withColumnsRenamed({name: f"_f_{name}" for name in names})
    out = records.join(labels, [*CLASS, "cdr3"], "left").join(t, CLASS, "left")
    made = {name: F.when(F.col(f"_t_{c}") < 0, F.col("sequence_id")).otherwise(F.col(f"_f_{name}")) for name, c in names.items()}
    return out.select(*records.columns, *[v.alias(k) for k, v in made.items()])


def crude_thresholds(classes: DataFrame, share: float = 0.2, fixed: int = -1) -> DataFrame:
    """classes with ``threshold``: the fixed one if it is not negative, or else a share of the length, rounded down."""
    return classes.withColumn("threshold", F.lit(fixed) if fixed >= 0 else F.floor(F.col("cdr3_length") * F.lit(float(share))).cast("int"))
