"""Mixing sources to target weights by hierarchical budgeting, with DataFrame functions only.

The leaves of a tree domain > language > source hold documents.  A leaf's capacity is its tokens times ``max_epochs``, an inner
node's that of its leaves.  A budget goes down the tree by weights: among siblings, those whose share is beyond their
capacity get their capacity, and what they leave is shared by weight among the others, until no share is too large.  Because a
node's capacity is that of its whole subtree, a shortage stays with siblings as long as they can take it and only then
reaches the siblings of an ancestor.  Shares are rounded down, so a node may hand down up to one token a child less.

A leaf then takes whole epochs of its documents, and of the last epoch the longest run of documents, in the order of
md5(seed : epoch : doc_id), whose tokens fit what is left (rows without a doc_id go by the MD5 of their text, rows of one doc_id
by their tokens and a hash of their text).  The order is cut into hash slices: sums over slices find the one
slice in which the run ends, and only that slice's documents are put in order, so no leaf is sorted in one task.

Tokens are words (runs of other than white space).  Weights are whole numbers.

Defined results: null text has no tokens; a null lang or source is a leaf of its own ("?"); documents without tokens come with
every epoch they precede the end of; a tree without tokens gives no rows; rows equal in doc_id and text stand side by
side, each counted.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .quality import words_of

_log = logging.getLogger(__name__)

LEVELS = ("domain", "lang", "source")
SEED, MAX_EPOCHS = 20240229, 2
#: Hex digits of the slices of a leaf's order.
SLICE = 3


def domain_of(source: Column) -> Column:
    """The domain of a source where a corpus names none: one of four groups, by the first digit of its name's MD5."""
    return F.concat(F.lit("d"), (F.instr(F.lit("0123456789abcdef"), F.substring(F.md5(source), 1, 1)) - 1) % 4)


def weight_of(level: str, name: Column) -> Column:
    """The target weight of a node among its siblings where none is given: domains weigh 40, 30, 20 and 10, English as much as
    three other languages, sources alike."""
    if level == "domain":
        return F.when(name == "d0", 40).when(name == "d1", 30).when(name == "d2", 20).otherwise(10).cast("long")
    if level == "lang":
        return F.when(name == "en", 3).otherwise(1).cast("long")
    return F.lit(1).cast("long")


def leaf_rows(docs: DataFrame, *more: Column) -> DataFrame:
    """(doc_id, domain, lang, source, tokens, order_key, tie, *more): the leaf and the tokens of each document, and what it is ordered by."""
    text = common.text_or_empty()
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("-"), F.md5(text.cast("binary"))))
    source, lang = F.coalesce("source", F.lit("?")), F.coalesce("lang", F.lit("?"))
    return docs.select("doc_id", domain_of(source).alias("domain"), lang.alias("lang"), source.alias("source"), F.size(words_of(text)).cast("long").alias("tokens"), key.alias("order_key"), F.xxhash64(text).alias("tie"), *more)


def _shares(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """nodes (parent columns, name, weight, capacity, budget of the parent) with ``share``.

    In the order of capacity / weight, a node is full if the ones before it are and its capacity is at most its share of what
    they leave; the rest share that by weight."""
    order = [F.col("capacity") / F.col("weight"), F.col("name")]
    before = Window.partitionBy(*parent).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.partitionBy(*parent).orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    nodes = nodes.withColumn("taken", F.coalesce(F.sum("capacity").over(before), F.lit(0))).withColumn("weights", F.sum("weight").over(rest))
    nodes = nodes.withColumn("full", F.col("capacity").cast("decimal(20,0)") * F.col("weights").cast("decimal(18,0)") <= (F.col("budget") - F.col("taken")).cast("decimal(20,0)") * F.col("weight").cast("decimal(18,0)"))
    # Full nodes are the first ones in this order; what they leave and who shares it are sums over the rest.
    of = Window.partitionBy(*parent)
    filled = F.coalesce(F.sum(F.when(F.col("full"), F.col("capacity"))).over(of), F.lit(0))
    sharing = F.sum(F.when(~F.col("full"), F.col("weight"))).over(of)
    nodes = nodes.withColumn("left", F.col("budget") - filled).withColumn("sharing", sharing)
    return nodes.withColumn("share", F.when(F.col("full"), F.col("capacity")).otherwise(F.expr("cast(cast(left as decimal(20,0)) * cast(weight as decimal(18,0)) div sharing as bigint)"))).drop("taken", "weights", "full", "left", "sharing")


def budgets(leaves: DataFrame, budget: Column, max_epochs: int | Column = MAX_EPOCHS, weight=weight_of) -> DataFrame:
    """(domain, lang, source, tokens, share) of the leaves (domain, lang, source, tokens): budget is an expression over their
    total ``all_tokens``.  A row a leaf; nothing here grows with the documents."""
    leaves = leaves.where("tokens > 0").withColumn("capacity", F.col("tokens") * max_epochs)
    top = leaves.agg(F.sum("tokens").alias("all_tokens"), F.sum("capacity").alias("all_capacity"))
    root = top.select(F.least(F.floor(budget).cast("long"), F.col("all_capacity")).alias("budget"))
    shares = root
    for depth, level in enumerate(LEVELS):
        parent = list(LEVELS[:depth])
        nodes = leaves.groupBy(*parent, F.col(level).alias("name")).agg(F.sum("capacity").alias("capacity"))
        nodes = nodes.withColumn("weight", weight(level, F.col("name")))
        nodes = nodes.join(shares, parent) if parent else nodes.crossJoin(F.broadcast(shares))  # shares is one row at the root
        shares = _shares(nodes, parent or [F.lit(0)]).select(*parent, F.col("name").alias(level), F.col("share").alias("budget"))
    return leaves.join(shares, list(LEVELS)).select(*LEVELS, "tokens", F.col("budget").alias("share"))


def with_epochs(leaves: DataFrame, budget: Column, weight=weight_of) -> DataFrame:
    """leaves with ``epochs``: as many as their domain needs in order to have its share of the budget by weight."""
    domains = leaves.where("tokens > 0").groupBy("domain").agg(F.sum("tokens").alias("n")).withColumn("weight", weight("domain", F.col("domain")))
    top = domains.agg(F.sum("n").alias("all_tokens"), F.sum("weight").alias("weights")).select(F.floor(budget).alias("budget"), "weights")
    epochs = F.greatest(F.lit(1), F.ceil(F.col("budget") * F.col("weight") / F.col("weights") / F.col("n"))).cast("long")
    return leaves.join(domains.crossJoin(F.broadcast(top)).select("domain", epochs.alias("epochs")), "domain")


def achieved(leaves: DataFrame, shares: DataFrame, weight=weight_of) -> DataFrame:
    """(domain, lang, source, target, achieved): the share of all tokens that weights ask for at each leaf, and that of its budget."""
    nodes, target = leaves.where("tokens > 0").select(*LEVELS), F.lit(1.0)
    for depth, level in enumerate(LEVELS):
        parent = list(LEVELS[:depth])
        siblings = nodes.select(*parent, level).distinct().withColumn("w", weight(level, F.col(level)))
        of = Window.partitionBy(*parent or [F.lit(0)])
        siblings = siblings.select(*parent, level, (F.col("w") / F.sum("w").over(of)).alias(f"{level}_share"))
        nodes, target = nodes.join(siblings, [*parent, level]), target * F.col(f"{level}_share")
    total = shares.agg(F.sum("share").alias("all_shares"))
    nodes = nodes.select(*LEVELS, target.alias("target")).join(shares.select(*LEVELS, "share"), list(LEVELS)).crossJoin(F.broadcast(total))
    return nodes.select(*LEVELS, "target", (F.col("share") / F.col("all_shares")).alias("achieved"))


def _order(epoch: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), epoch.cast("string"), F.lit(":"), F.col("order_key")))


def selection(rows: DataFrame, shares: DataFrame, seed: int = SEED) -> DataFrame:
    """A row for each document and epoch that is selected: the columns of rows (as ``leaf_rows`` gives them) and ``epoch``, from 0."""
    leaf = list(LEVELS)
    plan = shares.select(*[F.col(c).alias(f"leaf_{c}") for c in leaf], F.expr("cast(share div tokens as int)").alias("whole"), F.expr("share % tokens").alias("left"))
    plan = common.written(plan, "mix-plan")

    def at_leaf(table: DataFrame, what: DataFrame, prefix: str, how: str) -> DataFrame:
        return table.join(what, [F.col(c) == F.col(f"{prefix}_{c}") for c in leaf], how).drop(*[f"{prefix}_{c}" for c in leaf])

    def ordered(table: DataFrame) -> DataFrame:
        found = at_leaf(table, plan, "leaf", "inner").withColumn("order", _order(F.col("whole"), seed))
        return found.withColumn("slice", F.substring("order", 1, SLICE))

    slices = ordered(rows.select("order_key", *leaf, "tokens")).groupBy(*leaf, "slice").agg(F.sum("tokens").alias("n"), F.first("left").alias("left"))
    slices = slices.withColumn("end", F.sum("n").over(Window.partitionBy(*leaf).orderBy("slice")))
    cut = slices.where("end > left").groupBy(*leaf).agg(F.min(F.struct("slice", (F.col("left") - F.col("end") + F.col("n")).alias("room"))).alias("cut"))
    cut = common.written(cut.select(*[F.col(c).alias(f"cut_{c}") for c in leaf], F.col("cut.slice").alias("cut_slice"), F.col("cut.room").alias("room")), "mix-cuts")
    found = at_leaf(ordered(rows), cut, "cut", "left")
    # With something left of a leaf's share there is a slice in which it ends; whole epochs leave nothing and cut at once.
    wholes = F.when(F.col("whole") > 0, F.sequence(F.lit(0), F.col("whole") - 1)).otherwise(F.array().cast("array<int>"))
    epochs = F.when(F.col("slice") < F.col("cut_slice"), F.concat(wholes, F.array("whole"))).otherwise(wholes)
    run = Window.partitionBy(*leaf).orderBy("order", "doc_id", "tokens", "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = found.where("slice = cut_slice").withColumn("upto", F.sum("tokens").over(run)).where("upto <= room")
    return found.select(*rows.columns, F.explode(epochs).alias("epoch")).unionByName(ends.select(*rows.columns, F.col("whole").alias("epoch")))


def mixed(docs: DataFrame, budget: Column, max_epochs: int | None = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """The rows of docs that a mix selects, once an epoch, with the columns of docs.  Without ``max_epochs``, each
    domain has as many as its weight needs, and the shares that domains get are logged with their targets."""
    narrow = common.written(leaf_rows(docs).select(*LEVELS, "tokens"), "mix-rows")
    leaves = common.written(narrow.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens")), "mix-leaves")
    shares = common.written(budgets(leaves, budget, max_epochs) if max_epochs else budgets(with_epochs(leaves, budget), budget, F.col("epochs")), "mix-shares")
    if max_epochs is None:
        for x in achieved(leaves, shares).groupBy("domain").agg(F.sum("target").alias("target"), F.sum("achieved").alias("achieved")).orderBy("domain").collect():
            _log.info("mix: domain %s has %.4f of the tokens, target %.4f", x.domain, x.achieved or 0, x.target)
    return selection(leaf_rows(docs, F.struct(*docs.columns).alias("row")), shares, seed).select("row.*")


def mix(docs: DataFrame, budget: Column | None = None, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """The selected documents of a mix of docs (doc_id, text, lang, source); the budget is half of all tokens unless given."""
    rows = common.written(leaf_rows(docs), "mix-rows")
    leaves = rows.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"))
    shares = budgets(leaves, F.col("all_tokens") * 0.5 if budget is None else budget, max_epochs)
    return selection(rows, shares, seed).drop("order_key", "tie")
