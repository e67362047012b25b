"""Documents of several sources in target shares of tokens, each at most a capped number of times.

Tokens of the eligible documents are summed into cells of source, language and topic. Per mix, the cells' weights are raked (iterative
proportional fitting) in turn to the languages' and the topics' own shares and to the target shares of the sources, no cell above
max_repeats times its tokens; the sources come last, so their targets are met exactly wherever their documents suffice. A cell's
weight by its tokens is the expected number of copies of each of its documents: the whole part is given to all, the rest
by systematic sampling over the documents in order of size, so that each has its probability and the tokens of a source keep within
one document (of each part of 200,000) of the target.

The size of a mix is the tokens of its sources' documents, unless size_tokens says another, or REACHABLE: the largest size at which every source with
documents reaches its target under its cap. Otherwise a source that cannot reach its target even at max_repeats comes out at that, and is named; the others
keep their targets. Shares are judged by what was reached: `met` within `tolerance` of the target, `short` below, `over` above (where others
fall short or have no documents).

Languages are two letters or `und`. Topics are a column of the caller, or clusters of the texts' words, fitted on all texts and given to every document by its whole text (see
topics). So a mix has a bounded number of cells per source whatever the data hold; cells are raked in one task per mix. Running sums are taken
within parts of bounded size and offset by the sums of the parts before, so a source with a third of all documents is no hot task.

Cases. Sources are compared in lower case and without surrounding white space; documents of null or other sources are in no mix. Documents
without tokens are never drawn. Shares are divided by their sum; a negative or null share is 0, a null max_repeats is 1. A source that is
listed twice in a mix has the sum of its shares and the larger cap. A source without documents is reported with 0 tokens. Repeated
documents are separate rows with separate ids. Sampling is by hash of the id: the same in every run.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.keys import plain_key
from tidemark.llm import topics
from tidemark.llm.bpe import token_counts
from tidemark.shipping import shipped
from tidemark.storage import table_bytes, written

REACHABLE = "reachable"
ROUNDS = 60
UNIT = 10_000_000
#: Documents of one part of a running sum, about.
PART_ROWS = 200_000
BROADCAST_BYTES = 8 << 20


def _small(df: DataFrame) -> DataFrame:
    """df with a broadcast hint where its measured size allows."""
    return F.broadcast(df) if table_bytes(df) <= BROADCAST_BYTES else df


def targets(mix_targets: DataFrame) -> DataFrame:
    """(mix_name, source, target_share, max_repeats), shares normalised to 1 in each mix."""
    share = F.greatest(F.coalesce(F.col("target_share"), F.lit(0.0)), F.lit(0.0))
    rows = mix_targets.select("mix_name", plain_key("source").alias("source"), share.alias("share"), F.coalesce("max_repeats", F.lit(1)).alias("max_repeats"))
    rows = rows.filter("mix_name is not null and source is not null").groupBy("mix_name", "source").agg(F.sum("share").alias("share"), F.max("max_repeats").alias("max_repeats"))
    whole = rows.groupBy("mix_name").agg(F.sum("share").alias("whole"))
    return rows.join(whole, "mix_name").select("mix_name", "source", F.coalesce(F.try_divide("share", "whole"), F.lit(0.0)).alias("target_share"), "max_repeats")


def sized(documents: DataFrame, goals: DataFrame, path: str | None = None, topic: Column | None = None) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens) of the documents that any mix names. topic: an integer of the caller's for each document."""
    lang = plain_key("lang")
    docs = documents.select(
        "doc_id", "text", plain_key("source").alias("source"), F.when(lang.rlike("^[a-z]{2}$"), lang).otherwise("und").alias("lang"),
        *([] if topic is None else [F.coalesce(topic, F.lit(-1)).cast("int").alias("topic")]),
    )
    docs = docs.join(_small(goals.select("source").distinct()), "source", "left_semi")
    if topic is not None:
        return token_counts(docs, "text", ["doc_id", "source", "lang", "topic"], path)
    rows = token_counts(docs, "text", ["doc_id", "source", "lang"], path, label=topics.fitted(docs))
    return rows.select("doc_id", "source", "lang", F.col("label").alias("topic"), "n_tokens")


def cells(docs: DataFrame, goals: DataFrame, size_tokens: int | str | None = None) -> DataFrame:
    """(mix_name, source, lang, topic, rate): the expected copies of each document of the cell."""
    shipped(docs.sparkSession)
    sums = docs.groupBy("source", "lang", "topic").agg(F.sum("n_tokens").alias("tokens")).filter("tokens > 0")
    return sums.join(goals, "source").groupBy("mix_name").applyInPandas(lambda rows: _rake(rows, size_tokens), "mix_name string, source string, lang string, topic int, rate double")


def _rake(cells: pd.DataFrame, size_tokens: int | str | None = None) -> pd.DataFrame:
    cells = cells.sort_values(["source", "lang", "topic"], ignore_index=True)
    tokens = cells.tokens.to_numpy(float)
    most = tokens * cells.max_repeats.to_numpy(float)
    source, lang, topic = (pd.factorize(cells[c])[0] for c in ("source", "lang", "topic"))
    total = tokens.sum()
    share, limit = cells.groupby(source).target_share.first().to_numpy(float), np.bincount(source, most)
    if size_tokens == REACHABLE:
        asked = np.min(np.divide(limit, share, out=np.full_like(share, np.inf), where=share > 0))
        asked = asked if np.isfinite(asked) else 0.0
    else:
        asked = size_tokens or total
    goal = np.minimum(share * asked, limit)
    size = goal.sum()
    weight = tokens.copy()
    for _ in range(ROUNDS):
        for axis in (lang, topic):
            weight = _scaled(weight, axis, np.bincount(axis, tokens) / total * size, most)
        last, weight = weight, _exact(weight, source, goal, most)
        if np.abs(weight - last).max() <= 1e-6 * max(size, 1.0):
            break
    return cells[["mix_name", "source", "lang", "topic"]].assign(rate=np.minimum(weight / tokens, cells.max_repeats))


def _scaled(weight: np.ndarray, axis: np.ndarray, goal: np.ndarray, most: np.ndarray) -> np.ndarray:
    have = np.bincount(axis, weight)
    return np.minimum(weight * np.divide(goal, have, out=np.zeros_like(have), where=have > 0)[axis], most)


def _exact(weight: np.ndarray, axis: np.ndarray, goal: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Weights scaled to the goals, where what is cut off above `most` goes to the other cells of the same axis value."""
    weight = np.maximum(weight, most * 1e-12)
    for _ in range(50):
        full = weight >= most
        rest = np.maximum(goal - np.bincount(axis, np.where(full, most, 0.0)), 0.0)
        have = np.bincount(axis, np.where(full, 0.0, weight))
        factor = np.divide(rest, have, out=np.ones_like(have), where=have > 0)
        over = np.bincount(axis, np.where(full, most, 0.0)) > goal * (1 + 1e-12)
        if over.any():  # the full cells alone exceed the goal: scale all
            factor_all = np.divide(goal, np.bincount(axis, np.minimum(weight, most)), out=np.zeros_like(goal), where=goal > 0)
            weight = np.where(over[axis], np.minimum(weight, most) * factor_all[axis], weight)
            full &= ~over[axis]
            factor = np.where(over, 1.0, factor)
        new = np.where(full, most, np.minimum(weight * factor[axis], most))
        if np.allclose(new, weight, rtol=1e-12, atol=0):
            return new
        weight = new
    return weight


def drawn(docs: DataFrame, rates: DataFrame) -> DataFrame:
    """(mix_name, source, lang, topic, doc_id, n_tokens, copies) of every document that is drawn at least once. docs and rates: written tables."""
    salts = max(1, -(-docs.count() // PART_ROWS))
    rows = docs.filter("n_tokens > 0").join(_small(rates), ["source", "lang", "topic"])
    rows = rows.withColumn("whole", F.floor("rate")).withColumn("part_units", F.round((F.col("rate") - F.col("whole")) * UNIT).cast("bigint"))
    place = ["mix_name", "source", "salt"]
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
    sums = written(rows.groupBy(*place).agg(F.sum("part_units").alias("units")), "parts")
    before = Window.partitionBy("mix_name", "source").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*place, F.coalesce(F.sum("units").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy(*place).orderBy("n_tokens", "lang", "topic", F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(offsets, place).withColumn("sum", F.col("offset") + F.sum("part_units").over(within) + UNIT // 2)
    extra = F.expr(f"(sum div {UNIT}) - ((sum - part_units) div {UNIT})")
    return rows.select("mix_name", "source", "lang", "topic", "doc_id", "n_tokens", (F.col("whole") + extra).cast("int").alias("copies")).filter("copies > 0")


def shares(copies: DataFrame, docs: DataFrame, goals: DataFrame, size_tokens: int | str | None = None, tolerance: float | None = None) -> DataFrame:
    """What each source was to reach and reached.

    reached_share is of the mix as it came out, target_tokens of the size asked for. attainable_share is the target among the sources that have
    documents. status goes by reached against target share if there is a tolerance (a part of the target): `met`, `short`, `over` or `no documents`. Without
    one it says whether the documents at max_repeats suffice for target_tokens: `met`, `short` or `no documents`."""
    have = docs.groupBy("source").agg(F.sum("n_tokens").alias("available"))
    got = copies.groupBy("mix_name", "source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("reached_tokens"), F.max("copies").alias("most_copies"))
    rows = goals.join(have, "source", "left").join(got, ["mix_name", "source"], "left").na.fill(0, ["available", "reached_tokens", "most_copies"])
    whole, some = Window.partitionBy("mix_name"), (F.col("available") > 0) & (F.col("target_share") > 0)
    if size_tokens == REACHABLE:
        size = F.coalesce(F.min(F.when(some, F.col("available") * F.col("max_repeats") / F.col("target_share"))).over(whole), F.lit(0.0))
    else:
        size = F.lit(size_tokens) if size_tokens else F.sum("available").over(whole)
    rows = rows.withColumn("target_tokens", F.col("target_share") * size)
    rows = rows.withColumn("reached_share", F.coalesce(F.try_divide("reached_tokens", F.sum("reached_tokens").over(whole)), F.lit(0.0)))
    rows = rows.withColumn("attainable_share", F.when(some, F.col("target_share") / F.sum(F.when(some, F.col("target_share"))).over(whole)).otherwise(F.lit(0.0)))
    none = F.when((F.col("available") == 0) & (F.col("target_share") > 0), "no documents")
    if tolerance is None:
        status = none.when(F.col("available") * F.col("max_repeats") < F.col("target_tokens"), "short")
    else:
        status = none.when(F.col("reached_share") < F.col("target_share") * (1 - tolerance), "short").when(F.col("reached_share") > F.col("target_share") * (1 + tolerance), "over")
    return rows.select(
        "mix_name", "source", "target_share", "attainable_share", "reached_share", "target_tokens", "reached_tokens", "available", "max_repeats", "most_copies", status.otherwise("met").alias("status")
    )


def marginals(copies: DataFrame, docs: DataFrame, goals: DataFrame) -> DataFrame:
    """(mix_name, axis, value, target_share, reached_share, residual): the languages' and topics' shares of tokens among the documents of a mix's
    sources, and what the drawn copies reached under the sources' targets and caps. residual is reached less target."""
    axes = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).cast("string").alias("value")) for a in ("lang", "topic")])).alias("at")
    own = docs.groupBy("source", "lang", "topic").agg(F.sum("n_tokens").alias("own")).join(goals.select("mix_name", "source"), "source")
    got = copies.groupBy("mix_name", "lang", "topic").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("got"))
    zero = F.lit(0).cast("bigint")
    both = own.select("mix_name", "lang", "topic", "own", zero.alias("got")).unionByName(got.select("mix_name", "lang", "topic", zero.alias("own"), "got"))
    sums = both.select("mix_name", axes, "own", "got").groupBy("mix_name", "at.axis", "at.value").agg(F.sum("own").alias("own"), F.sum("got").alias("got"))
    whole = Window.partitionBy("mix_name", "axis")
    share = lambda c: F.coalesce(F.try_divide(F.col(c), F.sum(c).over(whole)), F.lit(0.0))
    rows = sums.select("mix_name", "axis", "value", share("own").alias("target_share"), share("got").alias("reached_share"))
    return rows.withColumn("residual", F.col("reached_share") - F.col("target_share"))


@dataclass(frozen=True)
class Mixture:
    """Written tables of mixes: goals, sized documents and drawn copies."""

    goals: DataFrame
    docs: DataFrame
    copies: DataFrame


def mixture(documents: DataFrame, mix_targets: DataFrame, path: str | None = None, size_tokens: int | str | None = None, topic: Column | None = None) -> Mixture:
    goals = written(targets(mix_targets), "goals")
    docs = written(sized(documents, goals, path, topic), "sized")
    return Mixture(goals, docs, written(drawn(docs, written(cells(docs, goals, size_tokens), "rates")), "copies"))


def mixed(documents: DataFrame, mix_targets: DataFrame, path: str | None = None, size_tokens: int | str | None = None) -> tuple[DataFrame, DataFrame]:
    """The drawn documents and the shares of every mix."""
    m = mixture(documents, mix_targets, path, size_tokens)
    return m.copies.drop("lang", "topic"), shares(m.copies, m.docs, m.goals, size_tokens)
