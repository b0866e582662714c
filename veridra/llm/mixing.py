"""Mixing sources to target weights: a budget runs down a domain-language-source tree, leaves are filled from seeded epochs."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridra.llm.common import fresh, written

LEVELS = ("domain", "lang", "source")


@dataclass(frozen=True)
class MixConfig:
    """`weights` gives (level, value) -> weight, 1 where not listed; `share` of the corpus's tokens is the budget; a document is
    taken `epochs` times at most. `slots` are the hash ranges in which a leaf's prefix is looked for."""

    weights: dict[tuple[str, str], float] = field(default_factory=dict)
    share: float = 0.5
    epochs: int = 2
    seed: int = 42


def word_count(text: Column) -> Column:
    """Words between blanks; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def domain_of(source: Column, domains: int = 4) -> Column:
    """Sources numbered alike modulo `domains` form a domain; those without a number one of their own."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), r"(\d{1,9})\D*$", 1)
    return F.when(number == "", F.lit("d-")).otherwise(F.concat(F.lit("d"), (number.try_cast("int") % domains).cast("string")))


def _water_fill(nodes: DataFrame, above: list[str], weight: Column) -> DataFrame:
    """Split each parent's `budget` among its children by weight, none above its `cap`; what full ones leave goes to their
    siblings. Children are filled in the order of cap / weight: the first whose share at the running level fits sets the level."""
    within = Window.partitionBy(*above) if above else Window.partitionBy(F.lit(0))
    ordered = within.orderBy("ratio", *[c for c in nodes.columns if c not in ("cap", "budget", "w", "ratio")])
    rows = nodes.withColumn("w", weight).withColumn("ratio", F.when(F.col("w") > 0, F.col("cap") / F.col("w")).otherwise(F.lit(float("inf"))))
    rows = rows.withColumn("filled", F.coalesce(F.sum("cap").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("open", F.sum("w").over(ordered.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    rows = rows.withColumn("level", F.when(F.col("open") > 0, (F.col("budget") - F.col("filled")) / F.col("open")))
    stop = F.max(F.when(F.col("ratio") > F.col("level"), F.col("level"))).over(within)
    rows = rows.withColumn("stop", stop)
    # without a stop every weighted child is full; children of weight 0 get nothing
    got = F.when(F.col("w") <= 0, F.lit(0.0)).otherwise(F.when(F.col("stop").isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.col("stop") * F.col("w"))))
    return rows.withColumn("budget", got).drop("w", "ratio", "filled", "open", "level", "stop")


def budgets(leaves: DataFrame, levels: tuple[str, ...], cfg: MixConfig) -> DataFrame:
    """(levels..., tokens, budget) for (levels..., tokens) leaves, top down. A node's cap is what its leaves hold in all epochs, so a
    shortage first meets its siblings under the same parent and only what they cannot take reaches the parent's siblings."""
    caps = leaves.withColumn("cap", F.col("tokens") * cfg.epochs)
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    above, got = [], None
    for i, level in enumerate(levels):
        here = [*above, level]
        nodes = caps.groupBy(*here).agg(F.sum("cap").alias("cap"))
        joined = nodes.join(got.hint("merge"), above) if above else nodes.withColumn("budget", F.lit(float(total * cfg.share)))
        weight = reduce(lambda c, kv: F.when(F.col(level).eqNullSafe(F.lit(kv[0][1])), F.lit(float(kv[1]))).otherwise(c), [x for x in cfg.weights.items() if x[0][0] == level], F.lit(1.0))
        filled = _water_fill(joined, above, weight)
        got = filled.select(*here, "budget")
        above = here
    return leaves.join(got.hint("merge"), list(levels))


def _order(epoch: Column, doc: Column, cfg: MixConfig) -> Column:
    """The document's place in an epoch: a hash of seed, epoch and id, as hex."""
    return F.md5(F.concat_ws(":", F.lit(str(cfg.seed)), epoch.cast("string"), F.coalesce(doc.cast("string"), F.lit("null"))))


@dataclass(frozen=True)
class Columns:
    """The columns that `mix` reads."""

    id: str = "doc_id"
    text: str = "text"
    lang: str = "lang"
    source: str = "source"


def _leaf_of(c: Columns) -> dict[str, Column]:
    return {"domain": domain_of(F.col(c.source)), "lang": F.coalesce(F.col(c.lang), F.lit("-")), "source": F.coalesce(F.col(c.source), F.lit("-"))}


def plan(docs: DataFrame, c: Columns = Columns(), cfg: MixConfig = MixConfig()) -> DataFrame:
    """What each leaf is to give: (domain, lang, source, leaf_budget, whole, last), the epochs it gives in full and the hash at
    which the next one ends (null: not begun).

    That hash is found in two steps, sums per leaf and hash range, then the rows of the one range in which the budget ends, so
    a source with a third of all rows never meets in one task.
    """
    rows = docs.select(F.col(c.id).cast("long").alias("id"), word_count(F.col(c.text)).alias("n"), *(v.alias(k) for k, v in _leaf_of(c).items()))
    rows = written(rows, "mix-rows")
    leaves = budgets(rows.groupBy(*LEVELS).agg(F.sum("n").alias("tokens")), LEVELS, cfg)
    full = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens") + 1e-9)).otherwise(F.lit(0))
    leaves = leaves.withColumn("whole", F.least(full, F.lit(cfg.epochs)).cast("int"))
    leaves = written(leaves.withColumn("rest", F.greatest(F.col("budget") - F.col("whole") * F.col("tokens"), F.lit(0.0))), "mix-leaves")

    begun = leaves.filter((F.col("rest") > 0) & (F.col("whole") < cfg.epochs))
    placed = rows.join(begun.select(*LEVELS, "whole", "rest").hint(_how(begun)), list(LEVELS))
    placed = placed.withColumn("h", _order(F.col("whole"), F.col("id"), cfg)).withColumn("slot", F.substring("h", 1, 3))
    sums = placed.groupBy(*LEVELS, "rest", "slot").agg(F.sum("n").alias("s"))
    running = Window.partitionBy(*LEVELS).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("s").over(running), F.lit(0)))
    edge = sums.filter((F.col("before") < F.col("rest")) & (F.col("before") + F.col("s") >= F.col("rest"))).select(*LEVELS, "slot", "before")
    near = placed.join(edge.hint("merge"), [*LEVELS, "slot"]).groupBy(*LEVELS, "rest", "before", "h").agg(F.sum("n").alias("s"))
    inside = Window.partitionBy(*LEVELS).orderBy("h").rowsBetween(Window.unboundedPreceding, -1)
    upto = F.col("before") + F.coalesce(F.sum("s").over(inside), F.lit(0))
    last = near.filter("s > 0").withColumn("upto", upto).filter(F.col("upto") < F.col("rest")).groupBy(*LEVELS).agg(F.max("h").alias("last"))
    return written(leaves.join(last.hint("merge"), list(LEVELS), "left").select(*LEVELS, F.round("budget", 3).alias("leaf_budget"), "whole", "last"), "mix-plan")


def _how(leaves: DataFrame, most: int = 100_000) -> str:
    """Leaves are broadcast up to a checked number."""
    return "broadcast" if leaves.count() <= most else "merge"


def mix(docs: DataFrame, c: Columns = Columns(), cfg: MixConfig = MixConfig()) -> DataFrame:
    """Every row with its leaf and how often it is taken: adds domain, n_tokens, leaf_budget and copies, replacing such columns.

    A leaf's budget buys whole epochs first; in the last one rows come in the order of a seeded hash until the row that crosses
    the budget, which is still taken. Null languages and sources are values of their own. Rows of equal id share their place and
    are taken together; rows without words cost nothing. A leaf without words gives nothing. An empty table stays empty. The
    rows themselves are not shuffled as long as the leaves fit the broadcast limit.
    """
    made = ("domain", "n_tokens", "leaf_budget", "copies")
    goal = plan(docs, c, cfg)
    own = {k: fresh(f"leaf_{k}", docs.columns) for k in (*LEVELS, "whole", "last", "n")}
    keys = goal.select(*(F.col(k).alias(own[k]) for k in (*LEVELS, "whole", "last")), "leaf_budget")
    rows = docs.withColumns({own[k]: v for k, v in _leaf_of(c).items()} | {own["n"]: word_count(F.col(c.text))})
    more = F.coalesce(_order(F.col(own["whole"]), F.col(c.id).cast("long"), cfg) <= F.col(own["last"]), F.lit(False))
    copies = (F.col(own["whole"]) + more.cast("int")).cast("long")
    # the results of the same names go after they were read
    rows = rows.withColumnsRenamed({x: fresh(f"old_{x}", docs.columns) for x in docs.columns if x.lower() == "leaf_budget"})
    rows = rows.join(keys.hint(_how(keys)), [own[k] for k in LEVELS])
    kept = [F.col(x) for x in docs.columns if x.lower() not in made]
    return rows.select(*kept, F.col(own["domain"]).alias("domain"), F.col(own["n"]).alias("n_tokens"), "leaf_budget", copies.alias("copies"))
