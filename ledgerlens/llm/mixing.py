"""Mixing sources to target weights by iterative proportional fitting.

Token weights of the cells (source, language, topic) are raked until their
sums match the target share of every source, language and topic.  Documents
are then sampled with a probability proportional to their cell's raked weight
per token.  No cell can give more tokens than it has: raking keeps each weight
under that bound (``rake_within``), and what a full cell cannot give the others
of its class give, so the expected tokens of the sample have the target shares.
A class that has too few tokens for its share of the budget gives all it has,
and the other classes of its dimension share the rest by their targets;
``marginals`` tells both shares of every class.

The cell table stays distributed: one row for each combination found,
pre-aggregated before its shuffle.  Each sweep is one window over it per
dimension, so a class's cells are sorted in one task: with very many sources
those of one language are as many rows, whatever the number of documents.

Defined cases: null attributes are classes of their own (the empty text
stands for null in targets).  Target shares of classes without tokens are
void and the others scaled up; classes without a target keep their observed
share.  Texts without words weigh nothing: they are kept with their cell's
probability, or with probability one if the cell has no words at all.  An
empty table gives an empty sample.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .common import aside, words

DIMENSIONS = ("source", "lang", "topic")
TOPICS = ("shouting", "tabular", "symbolic", "numeric", "prose", "none")


def topic_of(text: str | None) -> str:
    """Form class of a text: the first of TOPICS that its characters show."""
    if not text or not text.strip():
        return "none"
    n = len(text)
    if text.count("|") * 40 > n:
        return "tabular"
    if len(re.findall(r"[#$%&*{}<>=\\^~]", text)) * 25 > n:
        return "symbolic"
    if len(re.findall(r"[0-9]", text)) * 10 > n:
        return "numeric"
    if len(re.findall(r"[A-Z]", text)) * 3 > n:
        return "shouting"
    return "prose"


@F.arrow_udf(T.StructType([T.StructField("n_words", T.LongType()), T.StructField("topic", T.StringType())]))
def text_facts(texts: pa.Array) -> pa.Array:
    plain = [t.as_py() for t in texts]
    return pa.StructArray.from_arrays([pa.array([len(words(t)) for t in plain], pa.int64()), pa.array([topic_of(t) for t in plain], pa.string())], ["n_words", "topic"])


def tempered(cells: DataFrame, alpha: float = 0.7) -> DataFrame:
    """Targets (dim, value, share): observed token shares to the power alpha,
    scaled to one.  Large classes shrink, small ones grow."""
    out = None
    for d in DIMENSIONS:
        t = (cells.groupBy(F.col(d).alias("value")).agg(F.sum("tokens").alias("t")).where("t > 0")
             .select(F.lit(d).alias("dim"), "value", F.pow("t", F.lit(alpha)).alias("raw")))
        out = t if out is None else out.unionByName(t)
    total = out.groupBy("dim").agg(F.sum("raw").alias("total"))
    return out.join(total, "dim").select("dim", "value", (F.col("raw") / F.col("total")).alias("share"))


def rake(cells: DataFrame, targets: DataFrame, sweeps: int = 12) -> DataFrame:
    """``cells`` (source, lang, topic, tokens) with ``weight``, which sums to
    one and meets the target shares of the last dimension exactly and of the
    others to the accuracy reached after ``sweeps`` sweeps."""
    full = cells.where("tokens > 0")
    now = full.withColumn("weight", F.col("tokens").cast("double"))
    for d in DIMENSIONS:        # targets of classes present; classes without a target keep their share
        seen = full.groupBy(F.col(d).alias("_value")).agg(F.sum("tokens").alias("_t"))
        own = seen.join(targets.where(F.col("dim") == d).select(F.col("value").alias("_value"), "share"), "_value", "left")
        sums = own.agg(F.sum("_t").alias("_all"), F.sum(F.when(F.col("share").isNull(), F.col("_t"))).alias("_free"),
                       F.sum("share").alias("_named"))
        own = (own.crossJoin(F.broadcast(sums))         # one row
               .select("_value", F.when(F.col("share").isNull(), F.col("_t") / F.col("_all"))
                       .otherwise(F.col("share") / F.col("_named") * (1 - F.coalesce("_free", F.lit(0)) / F.col("_all"))).alias(f"_share_{d}")))
        now = now.join(own, F.col(d) == F.col("_value")).drop("_value")
    now = cut_lineage(now, "cells")
    for i in range(sweeps):
        for d in DIMENSIONS:
            held = F.sum("weight").over(Window.partitionBy(d))
            now = now.withColumn("weight", F.try_divide(F.col("weight") * F.col(f"_share_{d}"), held))
        if i % 2:
            now = cut_lineage(now, "cells")
    return now.drop(*[f"_share_{d}" for d in DIMENSIONS]).withColumn("weight", F.coalesce("weight", F.lit(0.0)))


def filled(want: str, most: str, total, key: str):
    """Factor f for which the sum over ``key`` of min(most, f * want) is ``total``.

    With the rows in order of most / want, the f that fills the rows before one
    and scales the others is never too large, and it is right for one row."""
    order = F.when(F.col(want) > 0, F.col(most) / F.col(want)).otherwise(F.lit(float("inf")))
    w = Window.partitionBy(key).orderBy(order)
    before = F.coalesce(F.sum(most).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum(want).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    return F.try_divide(total - before, rest)


def shares_within(full: DataFrame, targets: DataFrame, budget: float) -> DataFrame:
    """(dim, value, target, share, most) of every class that has tokens: its target,
    scaled to the classes present (its observed share if it has none), the share it
    gets, and the share it would have if it gave all its tokens."""
    out = None
    for d in DIMENSIONS:
        own = full.groupBy(F.lit(d).alias("dim"), F.col(d).alias("value")).agg(F.sum("tokens").cast("double").alias("_t"))
        out = own if out is None else out.unionByName(own)
    each = Window.partitionBy("dim")
    over = lambda c: F.coalesce(F.sum(c).over(each), F.lit(0.0))
    named = out.join(targets.select("dim", "value", F.col("share").alias("_asked")), ["dim", "value"], "left")
    free = F.when(F.col("_asked").isNull(), F.col("_t"))
    wanted = named.withColumns({"_all": over("_t"), "_free": over(free), "_named": over("_asked")}).select(
        "dim", "value", (F.col("_t") / F.col("_all") / F.lit(budget)).alias("most"),
        F.when(F.col("_asked").isNull(), F.col("_t") / F.col("_all"))
        .otherwise(F.coalesce(F.try_divide("_asked", "_named"), F.lit(0.0)) * (1 - F.col("_free") / F.col("_all"))).alias("target"))
    scaled = wanted.withColumn("_f", filled("target", "most", F.lit(1.0), "dim")).withColumn("_f", F.max("_f").over(each))
    return scaled.select("dim", "value", "target", F.least("most", F.col("_f") * F.col("target")).alias("share"), "most")


def rake_within(cells: DataFrame, targets: DataFrame, budget: float, sweeps: int = 60, tolerance: float = 1e-5) -> DataFrame:
    """``cells`` (source, lang, topic, tokens) with ``weight``, no more than the
    cell's part of the sample if it gave all its tokens.  The weights of a class
    sum to its share in ``shares_within``, to ``tolerance`` or, where the bounds
    of the cells leave no such weights, as near as ``sweeps`` sweeps come."""
    full = cells.where("tokens > 0")
    shares = cut_lineage(shares_within(full, targets, budget), "shares")
    now = full.withColumn("_w", F.col("tokens").cast("double"))
    now = now.crossJoin(F.broadcast(full.agg(F.sum("tokens").alias("_all")))).withColumn("_most", F.col("tokens") / F.col("_all") / F.lit(budget)).drop("_all")      # one row
    for d in DIMENSIONS:
        now = now.join(shares.where(F.col("dim") == d).select(F.col("value").alias("_value"), F.col("share").alias(f"_share_{d}")), F.col(d) == F.col("_value")).drop("_value")
    now = cut_lineage(now, "cells")
    weight = F.least("_w", "_most")
    for i in range(sweeps):
        for d in DIMENSIONS:
            now = now.withColumn("_f", filled("_w", "_most", F.col(f"_share_{d}"), d)).withColumn("_f", F.max("_f").over(Window.partitionBy(d)))
            now = now.withColumn("_w", F.coalesce(F.least(F.col("_w") * F.col("_f"), F.lit(1e100)), F.lit(0.0))).drop("_f")
        if i % 2:
            now = cut_lineage(now, "cells")
            off = [now.groupBy(d).agg(F.abs(F.sum(weight) - F.first(f"_share_{d}")).alias("off")).select("off") for d in DIMENSIONS]
            worst = off[0].unionByName(off[1]).unionByName(off[2]).agg(F.max("off")).first()[0]
            if worst is None or worst <= tolerance:
                break
    return now.withColumn("weight", weight).drop("_w", "_most", *[f"_share_{d}" for d in DIMENSIONS])


def marginals(rows: DataFrame, names: list[str], targets: DataFrame | None = None, alpha: float = 0.7, budget: float = 0.5) -> DataFrame:
    """(dim, value, target, share, most, expected) of every class with tokens for
    the rows that ``calibrated`` returns: target, the share that the class's own
    tokens allow, and its share of the sample's expected tokens.  Where share is
    less than target the class gives all it has."""
    _, _, lang, source = names
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    cells = cut_lineage(rows.groupBy(text_of(source).alias("source"), text_of(lang).alias("lang"), F.col("_topic").alias("topic"))
                        .agg(F.sum("_n_words").alias("tokens"), F.sum(F.col("_n_words") * F.col("_prob")).alias("_given")).where("tokens > 0"), "cells")
    given = None
    for d in DIMENSIONS:
        own = cells.groupBy(F.lit(d).alias("dim"), F.col(d).alias("value")).agg(F.sum("_given").alias("_given"))
        given = own if given is None else given.unionByName(own)
    given = given.select("dim", "value", (F.col("_given") / F.sum("_given").over(Window.partitionBy("dim"))).alias("expected"))
    return shares_within(cells, targets if targets is not None else tempered(cells, alpha), budget).join(given, ["dim", "value"])


def scale_to_budget(rate: DataFrame, budget: float, rounds: int = 3, points: int = 16) -> float:
    """Factor s for which sum(tokens * min(1, s * _rate)) comes nearest to
    ``budget`` of all tokens from below, to half a hundredth: each round sums
    for a grid of factors at once and narrows it to one step."""
    low, high = -10.0, 10.0         # powers of two
    for _ in range(rounds):
        grid = [low + (high - low) * i / points for i in range(points + 1)]
        sums = [F.sum(F.col("tokens") * F.least(F.lit(1.0), F.lit(2.0 ** g) * F.col("_rate"))).alias(f"s{i}") for i, g in enumerate(grid)]
        got = rate.agg(F.sum("tokens").alias("all"), *sums).first()
        fit = [i for i in range(points) if got["all"] and got[f"s{i}"] <= budget * got["all"]]
        at = max(fit, default=0)
        low, high = grid[at], grid[at + 1]
    return 2.0 ** low


def calibrated(docs: DataFrame, targets: DataFrame | None = None, alpha: float = 0.7, sweeps: int = 12,
               budget: float = 0.5, bounded: bool = True) -> tuple[DataFrame, list[str]]:
    """(all rows under safe names plus _n_words, _topic, _prob; the safe names of
    doc_id, text, lang, source).

    A document's probability is its cell's raked weight per token, scaled so
    that the expected sample holds ``budget`` of all tokens, and one at most.
    ``bounded``: rake under that bound; otherwise ``sweeps`` sweeps rake without
    it, and what is cut off at one is missing from the target shares.
    """
    safe, (doc_id, text, lang, source) = aside(docs, "doc_id", "text", "lang", "source")
    facts = (safe.withColumn("_f", text_facts(F.col(text)))
             .withColumns({"_n_words": F.col("_f.n_words"), "_topic": F.col("_f.topic"),
                           "_source": F.coalesce(F.col(source).cast("string"), F.lit("")),
                           "_lang": F.coalesce(F.col(lang).cast("string"), F.lit(""))}).drop("_f"))
    cells = cut_lineage(facts.groupBy(F.col("_source").alias("source"), F.col("_lang").alias("lang"), F.col("_topic").alias("topic"))
                        .agg(F.sum("_n_words").alias("tokens"), F.count("*").alias("n_docs")), "cells")
    targets = targets if targets is not None else tempered(cells, alpha)
    raked = rake_within(cells, targets, budget) if bounded else rake(cells, targets, sweeps)
    total = cells.agg(F.sum("tokens").alias("_total"))
    rate = cut_lineage(raked.crossJoin(F.broadcast(total))          # one row
                       .withColumn("_rate", F.col("weight") / F.col("tokens") * F.col("_total")).drop("_total"), "rates")
    s = scale_to_budget(rate, budget)
    prob = rate.select(F.col("source").alias("_s"), F.col("lang").alias("_l"), F.col("topic").alias("_t"),
                       F.least(F.lit(1.0), F.lit(s) * F.col("_rate")).alias("_prob"))
    out = (facts.join(prob, (F.col("_source") == F.col("_s")) & (F.col("_lang") == F.col("_l")) & (F.col("_topic") == F.col("_t")), "left")
           .drop("_source", "_lang", "_s", "_l", "_t").withColumn("_prob", F.coalesce("_prob", F.lit(1.0))))
    return out, [doc_id, text, lang, source]


def draw(id_col, seed: int = 8) -> F.Column:
    """Uniform in [0, 1) that depends on the id and the seed only; a null id
    draws as the empty text."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(2 ** 52)


def mix(docs: DataFrame, targets: DataFrame | None = None, alpha: float = 0.7, sweeps: int = 12, budget: float = 0.5,
        seed: int = 8, bounded: bool = True) -> DataFrame:
    """The sampled documents, with the columns of ``docs``."""
    rows, (doc_id, *_) = calibrated(docs, targets, alpha, sweeps, budget, bounded)
    kept = rows.where(draw(F.col(doc_id), seed) < F.col("_prob"))
    return kept.select(*[f"_in{i}" for i in range(len(docs.columns))]).toDF(*docs.columns)
