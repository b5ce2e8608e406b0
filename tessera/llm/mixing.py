"""Mixing sources to target weights by hierarchical budgeting, in DataFrame operations.

The corpus is a tree: domain, language, source.  A token budget is handed down from the root by the
weights of the children; a child that cannot use its share (its supply times the epochs allowed)
takes what it can, and the shortage goes to its siblings, so it leaves a subtree only when the whole
subtree is used up.  Each leaf fills its budget with whole seeded epochs and a prefix of the next:
documents in the order of a hash of seed, epoch and id, up to the budget.

Leaf tables are aggregates; the documents themselves are shuffled once, by leaf and hash range, so
a leaf with a third of all rows is spread over as many ranges as any other.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize

MAX_EPOCHS = 4
SEED = 17
LEVELS = ("domain", "lang", "source")
#: domain of a source: its number modulo 4 (the tables carry no domain of their own)
DOMAINS = ("web", "books", "code", "forums")
#: weights of children by level; a child without one weighs 1
WEIGHTS = {"domain": {"web": 4, "books": 2}, "lang": {"en": 3}, "source": {}}
#: share of the corpus's tokens that the mixture holds
BUDGET_SHARE = 0.5


def domain_of(source: Column) -> Column:
    number = F.regexp_extract(source, "([0-9]{1,9})$", 1)
    at = F.when(number == "", 0).otherwise(F.expr("try_cast(regexp_extract(source, '([0-9]{1,9})$', 1) as int)") % len(DOMAINS))
    return F.element_at(F.array(*[F.lit(d) for d in DOMAINS]), (at + 1).cast("int"))


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def _weight(level: str, weights: dict) -> Column:
    out = F.lit(1.0)
    for name, w in sorted(weights.get(level, {}).items()):
        out = F.when(F.col(level) == name, float(w)).otherwise(out)
    return out


def _share(children: DataFrame, parent: list[str]) -> DataFrame:
    """Hand ``given`` (of the parent, at most the sum of ``cap``) to the children by ``weight``,
    none above its ``cap``: adds ``budget``.  Children fill up in the order of cap / weight; the
    first that does not sets the level for the rest."""
    order = Window.partitionBy(*parent).orderBy(F.col("cap") / F.col("weight"), "name")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("given") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    at = (children.withColumn("level", level)
          .withColumn("open", F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))))
    first = F.first("open", ignorenulls=True).over(Window.partitionBy(*parent).orderBy(F.col("cap") / F.col("weight"), "name")
                                                   .rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return (at.withColumn("level", first)
            .withColumn("budget", F.coalesce(F.least("cap", F.col("level") * F.col("weight")), F.col("cap")))
            .drop("level", "open"))


def plan(leaves: DataFrame, budget: float, weights: dict = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(domain, lang, source, supply, budget) for leaves with a positive supply of tokens."""
    leaves = leaves.where("supply > 0").withColumn("cap", (F.col("supply") * max_epochs).cast("double"))
    given = None
    for depth, level in enumerate(LEVELS):
        path = list(LEVELS[:depth + 1])
        parent = path[:-1]
        nodes = leaves.groupBy(*path).agg(F.sum("cap").alias("cap"))
        if given is None:
            whole = nodes.agg(F.sum("cap")).first()[0] or 0.0
            nodes = nodes.withColumn("given", F.lit(float(min(budget, whole)))).withColumn("root", F.lit(0))
            parent = ["root"]
        else:
            nodes = nodes.join(given, parent)
        nodes = nodes.withColumn("weight", _weight(level, weights)).withColumn("name", F.col(level))
        given = _share(nodes, parent).select(*path, F.col("budget").alias("given"))
    return leaves.join(given, list(LEVELS)).select(*LEVELS, "supply", F.col("given").alias("budget"))


def select(docs: DataFrame, weights: dict = WEIGHTS, budget_share: float = BUDGET_SHARE, max_epochs: int = MAX_EPOCHS,
           seed: int = SEED, keep: list[str] = ()) -> DataFrame:
    """(doc_id, domain, lang, source, n_tokens, copies) of the documents in the mixture; ``copies``
    is how often each is drawn: the leaf's whole epochs, and once more if the document begins inside
    the prefix of the next epoch (so a leaf exceeds its budget by less than one document).

    Tokens are words; the budget is ``budget_share`` of all tokens of ``docs``.  A null language or
    source is the empty name, a source without a number is of the first domain.  Documents without
    words (null and empty texts) cost nothing and are drawn never.  Rows with equal doc_id are drawn
    as rows of their own, in the order (hash, doc_id, tokens); a null doc_id sorts by the hash of an
    empty id.  Other columns are ignored but for those named in ``keep``; an empty table gives no
    rows."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), name("lang").alias("lang"), name("source").alias("source"),
                       n_tokens(F.col("text")).alias("n_tokens"), *keep)
    rows = materialize(rows.withColumn("domain", domain_of(F.col("source"))).where("n_tokens > 0"), "mix-docs")
    leaves = materialize(rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("supply")), "mix-leaves")
    total = leaves.agg(F.sum("supply")).first()[0] or 0
    leaf = (plan(leaves, total * budget_share, weights, max_epochs)
            .withColumn("whole", F.floor(F.col("budget") / F.col("supply")))
            .withColumn("left", F.col("budget") - F.col("whole") * F.col("supply"))
            .select(*LEVELS, "whole", "left"))
    leaf = materialize(leaf, "mix-plan")
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("whole").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    drawn = materialize(rows.join(leaf, list(LEVELS)).withColumn("h", h).withColumn("range", F.substring("h", 1, 3)), "mix-order")
    ranges = drawn.groupBy(*LEVELS, "range").agg(F.sum("n_tokens").alias("t"))
    first = ranges.select(*LEVELS, "range", (F.sum("t").over(Window.partitionBy(*LEVELS).orderBy("range")) - F.col("t")).alias("first"))
    inside = Window.partitionBy(*LEVELS, "range").orderBy("h", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    at = drawn.withColumn("inside", F.sum("n_tokens").over(inside) - F.col("n_tokens"))
    copies = F.col("whole") + (F.col("first") + F.col("inside") < F.col("left")).cast("int")
    return (at.join(first, [*LEVELS, "range"]).withColumn("copies", copies.cast("long")).where("copies > 0")
            .select("doc_id", *LEVELS, "n_tokens", "copies", *keep))


#: DuckDB SQL for the rows of ``select`` with its default parameters, over a view ``documents``
SQL = f"""
WITH rows_ AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens FROM documents),
d AS (
  SELECT *, ['web', 'books', 'code', 'forums'][CASE WHEN regexp_extract(source, '([0-9]{{1,9}})$', 1) = '' THEN 0
         ELSE regexp_extract(source, '([0-9]{{1,9}})$', 1)::INT % 4 END + 1] AS domain FROM rows_ WHERE n_tokens > 0),
leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS supply, (sum(n_tokens) * {MAX_EPOCHS})::DOUBLE AS cap FROM d GROUP BY ALL),
a0 AS (SELECT domain, sum(cap) AS cap, CASE domain WHEN 'web' THEN 4.0::DOUBLE WHEN 'books' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
       least((SELECT sum(supply) FROM leaves)::DOUBLE * {BUDGET_SHARE}::DOUBLE, (SELECT sum(cap) FROM leaves)) AS given FROM leaves GROUP BY domain),
a1 AS (SELECT *, (given - coalesce(sum(cap) OVER (ORDER BY cap / weight, domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
       / sum(weight) OVER (ORDER BY cap / weight, domain ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM a0),
a2 AS (SELECT arg_min(lv, struct_pack(r := cap / weight, n := domain)) AS z FROM a1 WHERE lv * weight <= cap),
a AS (SELECT domain, coalesce(least(cap, z * weight), cap) AS given FROM a0, a2),
b0 AS (SELECT domain, lang, sum(cap) AS cap, CASE lang WHEN 'en' THEN 3.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, any_value(given) AS given
       FROM leaves JOIN a USING (domain) GROUP BY domain, lang),
b1 AS (SELECT *, (given - coalesce(sum(cap) OVER (PARTITION BY domain ORDER BY cap / weight, lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
       / sum(weight) OVER (PARTITION BY domain ORDER BY cap / weight, lang ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM b0),
b2 AS (SELECT domain, arg_min(lv, struct_pack(r := cap / weight, n := lang)) AS z FROM b1 WHERE lv * weight <= cap GROUP BY domain),
b AS (SELECT domain, lang, coalesce(least(cap, z * weight), cap) AS given FROM b0 LEFT JOIN b2 USING (domain)),
c0 AS (SELECT domain, lang, source, cap, supply, 1.0::DOUBLE AS weight, given FROM leaves JOIN b USING (domain, lang)),
c1 AS (SELECT *, (given - coalesce(sum(cap) OVER (PARTITION BY domain, lang ORDER BY cap / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
       / sum(weight) OVER (PARTITION BY domain, lang ORDER BY cap / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM c0),
c2 AS (SELECT domain, lang, arg_min(lv, struct_pack(r := cap / weight, n := source)) AS z FROM c1 WHERE lv * weight <= cap GROUP BY domain, lang),
c AS (SELECT domain, lang, source, supply, coalesce(least(cap, z * weight), cap) AS budget FROM c0 LEFT JOIN c2 USING (domain, lang)),
leaf AS (SELECT domain, lang, source, floor(budget / supply)::BIGINT AS whole, budget - floor(budget / supply)::BIGINT * supply AS rest FROM c),
o AS (SELECT d.*, whole, rest, sum(n_tokens) OVER (PARTITION BY domain, lang, source
      ORDER BY md5(concat('{SEED}:', whole, ':', coalesce(doc_id::VARCHAR, ''))), doc_id, n_tokens ROWS UNBOUNDED PRECEDING) - n_tokens AS before
      FROM d JOIN leaf USING (domain, lang, source))
SELECT doc_id, domain, lang, source, n_tokens, whole + (before < rest)::INT::BIGINT AS copies FROM o WHERE whole + (before < rest)::INT > 0
"""
