"""Mixing sources to target weights by hierarchical budgeting.

Rows belong to leaves of a domain-language-source tree. A token budget flows down: at each node the children share the
node's budget by their weights; a child whose supply (its tokens times ``max_epochs``) is too small gets all it has,
and what is missing goes to its siblings by their weights. A node never receives more than its whole subtree can
supply, so a shortage is made up among siblings first and reaches the ancestors' siblings only when the whole subtree
is spent. All shares are integers: the remainder of a division goes to the largest fractions, ties by name.

A leaf's budget is then taken as a token prefix of seeded epochs: each epoch is a permutation of the leaf's rows by a
hash of (seed, epoch, id). Whole epochs give every row once each; of the last epoch the rows are taken in order until
the budget is met, the last one in part.

Weights are whole numbers from 1 up; names without a weight have 1. Null domains, languages and sources are the
empty name; null texts have no tokens and are never taken; repeated rows are taken independently; rows without an id
share the place of the id "null". Extra columns are ignored unless carried; an empty table gives an empty one.

Only the leaf table (one row per domain, language and source) is shaped by windows over a parent; rows are
dealt by (leaf, slice of the hash). Slices are as many as keep ``SLICE`` tokens of the input in one, 4096 at least, so a
leaf with a third of all rows is spread; what is ahead of a slice is summed in two steps, within groups of slices.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import chain

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import materialize

LEVELS = ("domain", "lang", "source")
SALTS = 16
SLICE = 10_000_000  # tokens


@dataclass(frozen=True)
class Mix:
    """Weights by name for each level, the budget as a share of all tokens, and the most epochs of one leaf."""

    domain: dict = field(default_factory=dict)
    lang: dict = field(default_factory=dict)
    source: dict = field(default_factory=dict)
    budget_percent: int = 90
    max_epochs: int = 3
    seed: str = "mix-1"

    def weight(self, level: str) -> Column:
        table = getattr(self, level)
        named = F.create_map(*map(F.lit, chain.from_iterable(table.items())))[F.col(level)] if table else F.lit(None).cast("int")
        return F.coalesce(named, F.lit(1)).cast("decimal(38,0)")


PRODUCTION = Mix(domain={"web": 5, "books": 3, "forum": 2}, lang={"en": 4, "de": 2, "fr": 2, "es": 1}, source={"src0": 3}, budget_percent=90, max_epochs=3)


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def domain_of(source: str = "source") -> Column:
    """The tables have no domain: sources are dealt to three by their number."""
    n = F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(source, "([0-9]{1,9})$", 1), F.lit("")), F.lit("999999999")).cast("int"), F.lit(0)) % 3
    return F.element_at(F.array(F.lit("web"), F.lit("books"), F.lit("forum")), n.cast("int") + 1)


def _whole(c: Column) -> Column:
    return c.cast("decimal(38,0)")


def share(children: DataFrame, level: str, weight: Column) -> DataFrame:
    """``children`` has the columns of upper levels, ``level``, ``cap`` and the parent's ``budget``; replaces ``budget``
    by each child's share."""
    upper = LEVELS[: LEVELS.index(level)]
    parent = Window.partitionBy(*upper) if upper else Window.partitionBy(F.lit(0))
    by_need = parent.orderBy(F.col("cap").cast("double") / F.col("w").cast("double"), level)
    d = children.withColumn("w", weight)
    before, after = by_need.rowsBetween(Window.unboundedPreceding, -1), by_need.rowsBetween(0, Window.unboundedFollowing)
    d = d.withColumn("p", _whole(F.coalesce(F.sum("cap").over(before), F.lit(0)))).withColumn("q", _whole(F.sum("w").over(after)))
    d = d.withColumn("full", _whole(F.col("cap")) * F.col("q") <= F.col("w") * _whole(F.col("budget") - F.col("p")))
    open_w, spent = F.when(~F.col("full"), F.col("w")), F.when(F.col("full"), F.col("cap"))
    d = d.withColumn("rest", _whole(F.col("budget") - F.coalesce(F.sum(spent).over(parent), F.lit(0)))).withColumn("ws", _whole(F.sum(open_w).over(parent)))
    d = d.withColumn("base", F.when(F.col("full"), F.col("cap")).otherwise(F.expr("cast((w * rest) div ws as bigint)")))
    d = d.withColumn("frac", F.when(F.col("full"), _whole(F.lit(-1))).otherwise(F.col("w") * F.col("rest") - _whole(F.col("base")) * F.col("ws")))
    d = d.withColumn("left", F.col("budget") - F.sum("base").over(parent)).withColumn("rank", F.row_number().over(parent.orderBy(F.desc("frac"), level)))
    d = d.withColumn("budget", (F.col("base") + F.when(~F.col("full") & (F.col("rank") <= F.col("left")), 1).otherwise(0)).cast("long"))
    return d.drop("w", "p", "q", "full", "rest", "ws", "base", "frac", "left", "rank")


def leaf_budgets(leaves: DataFrame, mix: Mix, total: int) -> DataFrame:
    """(domain, lang, source, supply, budget) from (domain, lang, source, supply)."""
    leaves = leaves.withColumn("cap", F.col("supply") * mix.max_epochs)
    want = total * mix.budget_percent // 100
    nodes = None
    for i, level in enumerate(LEVELS):
        caps = leaves.groupBy(*LEVELS[: i + 1]).agg(F.sum("cap").alias("cap"))
        if nodes is None:
            caps = caps.withColumn("budget", F.least(F.lit(want).cast("long"), F.sum("cap").over(Window.partitionBy(F.lit(0)))))
        else:
            caps = caps.join(nodes.select(*LEVELS[:i], "budget"), list(LEVELS[:i]))
        nodes = share(caps, level, mix.weight(level))
    return leaves.select(*LEVELS, "supply").join(nodes.select(*LEVELS, "budget"), list(LEVELS))


def select_prefixes(rows: DataFrame, mix: Mix) -> DataFrame:
    """``rows`` has ``doc_id``, the levels, ``n_tokens`` and columns to carry. Adds ``copies`` (whole epochs) and
    ``taken`` (tokens taken in all) and keeps the rows that are taken at all."""
    rows = rows.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in LEVELS})
    leaves = materialize(rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("supply")), "leaves")
    total = leaves.agg(F.sum("supply")).first()[0] or 0
    digits = 3
    while total > SLICE * 16**digits:
        digits += 1
    budgets = materialize(leaf_budgets(leaves, mix, total).where("budget > 0"), "budgets")
    salted = budgets.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    d = rows.where("n_tokens > 0").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted, [*LEVELS, "salt"])
    d = d.withColumn("copies", F.expr("budget div supply")).withColumn("rest", F.expr("budget % supply"))
    d = d.withColumn("h", F.md5(F.concat_ws(":", F.lit(mix.seed), F.col("copies").cast("string"), name).cast("binary"))).withColumn("slice", F.substring("h", 1, digits))
    sums = d.groupBy(*LEVELS, "slice").agg(F.sum("n_tokens").alias("m")).withColumn("group", F.substring("slice", 1, (digits + 1) // 2))
    before = lambda key, by: F.sum("m").over(Window.partitionBy(*key).orderBy(by)) - F.col("m")
    groups = sums.groupBy(*LEVELS, "group").agg(F.sum("m").alias("m")).select(*LEVELS, "group", before(LEVELS, "group").alias("first"))
    offsets = sums.select(*LEVELS, "group", "slice", before((*LEVELS, "group"), "slice").alias("then")).join(groups, [*LEVELS, "group"])
    offsets = offsets.select(*LEVELS, "slice", (F.col("first") + F.col("then")).alias("ahead"))
    d = d.join(offsets, [*LEVELS, "slice"])
    inside = Window.partitionBy(*LEVELS, "slice").orderBy("h", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    start = F.col("ahead") + F.sum("n_tokens").over(inside) - F.col("n_tokens")
    d = d.withColumn("prefix_tokens", F.greatest(F.lit(0), F.least(F.col("n_tokens"), F.col("rest") - start)).cast("long"))
    d = d.withColumn("taken", (F.col("copies") * F.col("n_tokens") + F.col("prefix_tokens")).cast("long")).where("taken > 0")
    return d.drop("salt", "supply", "budget", "rest", "h", "slice", "ahead")


def mix_documents(docs: DataFrame, mix: Mix = PRODUCTION) -> DataFrame:
    """(doc_id, domain, lang, source, n_tokens, copies, prefix_tokens, taken) of the rows that are taken."""
    rows = docs.select("doc_id", domain_of().alias("domain"), "lang", "source", word_count().alias("n_tokens"))
    return select_prefixes(rows, mix)


def mixed_copies(docs: DataFrame, mix: Mix = PRODUCTION) -> DataFrame:
    """The rows of ``docs`` as the mixture has them: a row comes once for each whole epoch, and once more where its
    beginning lies in the last epoch's prefix."""
    keep = docs.columns
    rows = docs.select(*[docs[c].alias(f"_{c}") for c in keep], docs["doc_id"], domain_of().alias("domain"), docs["lang"], docs["source"], word_count().alias("n_tokens"))
    chosen = select_prefixes(rows, mix).withColumn("n", (F.col("copies") + F.when(F.col("prefix_tokens") > 0, 1).otherwise(0)).cast("int"))
    return chosen.withColumn("copy", F.explode(F.sequence(F.lit(1), "n"))).select(*[F.col(f"_{c}").alias(c) for c in keep])


def oracle_sql(mix: Mix = PRODUCTION) -> str:
    """``mix_documents`` in DuckDB SQL."""

    def weight(level: str) -> str:
        table = getattr(mix, level)
        return f"CASE {level} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in table.items()) + " ELSE 1 END" if table else "1"

    def shared(level: str, name: str) -> str:
        i = LEVELS.index(level)
        part = "PARTITION BY " + ", ".join(LEVELS[:i]) if i else ""
        return f"""{name}_a AS (SELECT *, ({weight(level)})::HUGEINT AS w FROM {name}_in),
{name}_b AS (SELECT *, coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS p,
  sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::HUGEINT AS q FROM {name}_a
  WINDOW o AS ({part} ORDER BY cap::DOUBLE / w::DOUBLE, {level})),
{name}_c AS (SELECT *, cap * q <= w * (budget - p) AS filled FROM {name}_b),
{name}_d AS (SELECT *, (budget - coalesce(sum(CASE WHEN filled THEN cap END) OVER ({part}), 0))::HUGEINT AS rest,
  sum(CASE WHEN NOT filled THEN w END) OVER ({part})::HUGEINT AS ws FROM {name}_c),
{name}_e AS (SELECT *, CASE WHEN filled THEN cap ELSE (w * rest) // ws END AS base FROM {name}_d),
{name}_f AS (SELECT *, CASE WHEN filled THEN -1 ELSE w * rest - base * ws END AS frac FROM {name}_e),
{name}_g AS (SELECT *, budget - sum(base) OVER ({part}) AS remains, row_number() OVER ({part} ORDER BY frac DESC, {level}) AS rank FROM {name}_f),
{name} AS (SELECT * EXCLUDE (budget), (base + CASE WHEN NOT filled AND rank <= remains THEN 1 ELSE 0 END)::HUGEINT AS budget FROM {name}_g)"""

    return f"""WITH docs AS (SELECT doc_id, (['web', 'books', 'forum'])[coalesce(try_cast(nullif(regexp_extract(source, '([0-9]{{1,9}})$', 1), '') AS INT), 0) % 3 + 1] AS domain,
  coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS n_tokens FROM documents),
leaves AS (SELECT domain, lang, source, sum(n_tokens)::HUGEINT AS supply, sum(n_tokens)::HUGEINT * {mix.max_epochs} AS cap FROM docs GROUP BY ALL),
total AS (SELECT sum(supply)::HUGEINT AS t FROM leaves),
n1_in AS (SELECT domain, sum(cap)::HUGEINT AS cap, least((SELECT t * {mix.budget_percent} // 100 FROM total), (SELECT sum(cap) FROM leaves))::HUGEINT AS budget FROM leaves GROUP BY domain),
{shared("domain", "n1")},
n2_in AS (SELECT l.domain, l.lang, sum(l.cap)::HUGEINT AS cap, any_value(n1.budget)::HUGEINT AS budget FROM leaves l JOIN n1 USING (domain) GROUP BY l.domain, l.lang),
{shared("lang", "n2")},
n3_in AS (SELECT l.domain, l.lang, l.source, l.cap, n2.budget FROM leaves l JOIN n2 ON n2.domain = l.domain AND n2.lang = l.lang),
{shared("source", "n3")},
placed AS (SELECT d.*, n3.budget // l.supply AS copies, n3.budget % l.supply AS rest FROM docs d JOIN leaves l USING (domain, lang, source) JOIN n3 USING (domain, lang, source) WHERE n_tokens > 0),
hashed AS (SELECT *, md5('{mix.seed}:' || copies::VARCHAR || ':' || coalesce(doc_id::VARCHAR, 'null')) AS h FROM placed),
ordered AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY h, doc_id, n_tokens ROWS UNBOUNDED PRECEDING) - n_tokens AS start FROM hashed)
SELECT doc_id, domain, lang, source, n_tokens, copies::BIGINT AS copies, greatest(0, least(n_tokens, rest - start))::BIGINT AS prefix_tokens,
  (copies * n_tokens + greatest(0, least(n_tokens, rest - start)))::BIGINT AS taken FROM ordered WHERE copies * n_tokens + greatest(0, least(n_tokens, rest - start)) > 0"""
