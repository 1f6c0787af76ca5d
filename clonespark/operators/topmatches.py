"""The k best cosine matches of every text in another set, exactly, from as few postings as its bounds allow.

A posting is (n-gram, text of the other set, weight). A text's n-grams are taken rarest first, in slices. What the n-grams not yet read can add to any product is bounded: by the
sum of the text's weights times the largest weight that the other set has for them, and by the length of what is left of the text's (unit) vector. Sums over
the slices read so far are lower bounds of products, so the k-th best of them is a bound that the k best products reach. A text is
finished when what is unread cannot lift a new candidate to its k-th best sum; and a candidate is dropped when it cannot reach that sum. Only the few candidates left are compared as a whole. Texts that
have fewer than k matches are finished when all their postings are read.

The n-grams of the other set with very many texts are dealt to several tasks, by the texts that ask for them. Between rounds only sums of pairs are stored.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clonespark.plans.lineage import stored

#: Shares of a text's whole bound that its slices leave; postings of an n-gram for each task that it is dealt to, and such tasks at most.
SLICES, EACH, SALTS = (0.5, 0.25, 0.1, 0.0), 1 << 14, 64
#: Products that differ by less are equal, and then the lesser id comes first.
ALIKE = 1e-9
log = logging.getLogger(__name__)


def _planned(left: DataFrame, right: DataFrame) -> DataFrame:
    """(i, gram, w, n, salts, slice, before): the left side's n-grams that the right side has, by slice, with the bound of what is unread before each."""
    heads = right.groupBy("gram").agg(F.count("*").alias("n"), F.max("w").alias("_most"))
    heads = heads.withColumn("salts", F.least(F.ceil(F.col("n") / EACH), F.lit(SALTS)).cast("int"))
    rows = left.select(F.col("id").alias("i"), "gram", "w").join(heads, "gram")
    later = Window.partitionBy("i").orderBy("n", "gram").rowsBetween(0, Window.unboundedFollowing)  # a text has as many rows as n-grams
    bound = F.least(F.sum(F.col("w") * F.col("_most")).over(later), F.sqrt(F.sum(F.col("w") * F.col("w")).over(later)))
    rows = rows.withColumn("before", bound).withColumn("_all", F.max("before").over(Window.partitionBy("i")))
    place = sum(((F.col("before") <= share * F.col("_all")).cast("int") for share in SLICES[:-1]), F.lit(0))
    return rows.select("i", "gram", "w", "n", "salts", place.alias("slice"), "before")


def top_matches(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """(i, j, sim): the k best texts j of the right side for each text i of the left one, of those with a product above zero; ties go to the lesser j.

    Both sides are stored weights (id, gram, w, ...) of unit vectors from one idf table; weights are positive. The postings read are logged by round.
    """
    plan, _ = stored(_planned(left, right), "plan")
    salts = plan.select("gram", "salts").distinct()
    postings = right.select(F.col("id").alias("j"), "gram", F.col("w").alias("_w")).join(salts, "gram")
    postings, _ = stored(postings.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts"), "postings")
    rest = plan.groupBy("i").agg(*[F.coalesce(F.max(F.when(F.col("slice") > s, F.col("before"))), F.lit(0.0)).alias(f"r{s}") for s in range(len(SLICES))])
    rest, _ = stored(rest, "rest")
    going, sums, finished = rest.select("i"), None, []
    best = Window.partitionBy("i").orderBy(F.col("sum").desc())
    for s in range(len(SLICES)):
        own = plan.where(F.col("slice") == s).join(going, "i", "left_semi").withColumn("_salt", F.pmod(F.xxhash64("i"), F.col("salts")).cast("int"))
        new = own.join(postings, ["gram", "_salt"]).select("i", "j", (F.col("w") * F.col("_w")).alias("sum"))
        new = new.groupBy("i", "j").agg(F.sum("sum").alias("sum"))
        if sums is not None:
            new = new.unionByName(sums).groupBy("i", "j").agg(F.sum("sum").alias("sum"))
        sums, _ = stored(new, "sums")
        least = sums.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= k).groupBy("i").agg(F.min("sum").alias("_k"), F.count("*").alias("_n"))
        left_over = F.col(f"r{s}")
        # a sum of k candidates at least; without as many, any text can still be among the best
        state = rest.join(going, "i", "left_semi").join(least, "i", "left").select("i", left_over.alias("left"), F.when(F.col("_n") >= k, F.col("_k")).otherwise(0.0).alias("least"))
        state, _ = stored(state.withColumn("done", (F.col("left") == 0) | (F.col("left") < F.col("least") - 2 * ALIKE)), "state")
        log.info("slice %d: %s postings for %s texts", s, *own.agg(F.sum("n"), F.countDistinct("i")).first()) if log.isEnabledFor(logging.INFO) else None
        kept = sums.join(state, "i").where(F.col("sum") + F.col("left") >= F.col("least") - 2 * ALIKE)
        finished.append(kept.where("done").select("i", "j", F.when(F.col("left") == 0, F.col("sum")).alias("sum")))
        going, sums = state.where("not done").select("i"), kept.where("not done").select("i", "j", "sum")
    found = finished[0]
    for more in finished[1:]:
        found = found.unionByName(more)
    found, _ = stored(found, "candidates")
    x, y = left.select(F.col("id").alias("i"), "gram", "w"), right.select(F.col("id").alias("j"), "gram", F.col("w").alias("_w"))
    whole = found.where("sum is null").select("i", "j").join(x, "i").join(y, ["j", "gram"]).groupBy("i", "j").agg(F.sum(F.col("w") * F.col("_w")).alias("sim"))
    sims = whole.unionByName(found.where("sum is not null").select("i", "j", F.col("sum").alias("sim")))
    rank = F.row_number().over(Window.partitionBy("i").orderBy(F.round("sim", 9).desc(), "j"))
    return sims.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")
