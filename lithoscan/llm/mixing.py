"""Mixing sources to target weights by hierarchical budgets.

A budget of tokens goes down a tree of domains, languages and sources by weight.
A node that holds less than its share gives the shortage to its siblings, by
their weights; only what all of them can't hold was never given to their parent.
Each leaf then takes its documents in seeded order: whole epochs, and a prefix
of the next one.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import fresh, materialize, packed, table, unpacked, utf8

WORD = "[^\\x20\\x09-\\x0D]+"
#: Leaves up to which their table is broadcast; beyond, it is joined.
BROADCAST_LEAVES = 20_000


@dataclass(frozen=True)
class Mix:
    """``levels``: (name, SQL expression) from the domain down to the source.
    ``weights``: by level, SQL expressions of integer weights over the names of
    that level and those above; 0 leaves a node out. ``budget``: tokens; None:
    as many as there are. ``most_epochs``: how often a document may be taken."""

    levels: tuple[tuple[str, str], ...] = (
        ("domain", "CASE WHEN source = 'src0' THEN 'bulk' WHEN length(source) = 4 THEN 'web' ELSE 'archive' END"),
        ("lang", "coalesce(lang, '')"),
        ("source", "coalesce(source, '')"),
    )
    weights: tuple[str, ...] = (
        "CASE domain WHEN 'bulk' THEN 20 WHEN 'web' THEN 30 ELSE 50 END",
        "CASE lang WHEN 'en' THEN 55 WHEN 'de' THEN 15 WHEN 'fr' THEN 15 WHEN 'es' THEN 10 ELSE 5 END",
        "1",
    )
    budget: int | None = None
    most_epochs: int = 4
    seed: int = 17
    names: tuple[str, ...] = field(init=False, default=())

    def __post_init__(self) -> None:
        object.__setattr__(self, "names", tuple(n for n, _ in self.levels))


def token_count(text: Column) -> Column:
    """Words of a text; a null one has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def _share(nodes: DataFrame, parents: list[str], name: str) -> DataFrame:
    """``nodes`` with ``given``: their parent's ``budget`` dealt by ``weight`` up to ``cap``.

    Nodes of a parent are ranked by the share at which they are full. Those are
    full, first to last, whose part of what is left is at least their cap; the
    others divide the rest by weight. All sums are integers.
    """
    order = [F.col("cap") / F.when(F.col("weight") > 0, F.col("weight")), F.col(name)]
    live = nodes.where("weight > 0")
    before = W.partitionBy(*parents).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    after = W.partitionBy(*parents).orderBy(*order).rowsBetween(W.currentRow, W.unboundedFollowing)
    d = live.withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("weight_left", F.sum("weight").over(after))
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    d = d.withColumn("rest", F.greatest(F.col("budget") - F.col("cap_before"), F.lit(0)))
    d = d.withColumn("full", wide("cap") * wide("weight_left") <= wide("weight") * wide("rest"))
    whole = W.partitionBy(*parents)
    d = d.withColumn("cap_full", F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(whole), F.lit(0)))
    d = d.withColumn("weight_rest", F.sum(F.when(~F.col("full"), F.col("weight"))).over(whole))
    d = d.withColumn("over", F.greatest(F.col("budget") - F.col("cap_full"), F.lit(0)))
    part = F.expr("cast((cast(weight as decimal(19,0)) * cast(over as decimal(19,0))) div weight_rest as bigint)")
    return d.withColumn("given", F.when(F.col("full"), F.col("cap")).otherwise(F.least("cap", part))).select(*nodes.columns, "given")


def budgets(rows: DataFrame, mix: Mix) -> DataFrame:
    """Leaves of ``rows(*names, tokens)`` with ``leaf_tokens``, ``given``, ``epochs`` (whole ones), ``rest`` and
    ``bits``: half the bits of the leaf's number of rows."""
    names = list(mix.names)
    leaves = materialize(rows.groupBy(*names).agg(F.sum("tokens").alias("leaf_tokens"), F.count(F.lit(1)).alias("leaf_rows")), "mix-leaves")
    total = leaves.agg(F.sum("leaf_tokens")).first()[0] or 0
    budget = min(mix.budget if mix.budget is not None else total, total * mix.most_epochs)
    # capacities go up: what a node of weight 0 holds counts for nobody
    caps = leaves.drop("leaf_rows").withColumn("cap", F.col("leaf_tokens") * mix.most_epochs)
    up = {}
    for k in range(len(names), 0, -1):
        caps = caps.withColumn("weight", F.expr(mix.weights[k - 1]).cast("long"))
        up[k] = caps.select(*names[:k], "cap", "weight")
        caps = caps.where("weight > 0").groupBy(*names[: k - 1]).agg(F.sum("cap").alias("cap")) if k > 1 else caps
    down = None
    for k in range(1, len(names) + 1):
        if down is None:
            nodes = up[k].withColumn("budget", F.lit(budget).cast("long"))
        else:
            above = down.select(*[F.col(n).alias(f"__{n}") for n in names[: k - 1]], F.col("given").alias("budget"))
            on = [F.col(n).eqNullSafe(F.col(f"__{n}")) for n in names[: k - 1]]
            nodes = up[k].join(above, on).select(*up[k].columns, "budget")
        down = _share(nodes, names[: k - 1] or [F.lit(1)], names[k - 1])
    taken = down.select(*[F.col(n).alias(f"__{n}") for n in names], "given")
    found = leaves.join(taken, [F.col(n).eqNullSafe(F.col(f"__{n}")) for n in names]).where("leaf_tokens > 0")
    return found.select(*names, "leaf_tokens", "given", F.expr("given div leaf_tokens").alias("epochs"), F.expr("given % leaf_tokens").alias("rest"), F.least(F.ceil(F.log2("leaf_rows") / 2), F.lit(31)).cast("int").alias("bits"))


def _draw(seed: int) -> Column:
    """A document's place in the seeded order of the epoch ``epochs``."""
    return F.md5(F.concat_ws(":", F.lit(seed), F.col("epochs"), F.coalesce(F.col("doc").cast("string"), F.lit(""))))


def _own_column(columns: list[str], name: str, expression: str) -> str | None:
    """The column of ``docs`` that a level of that name is made from, if there is one: it stands for the level."""
    found = [c for c in columns if c.lower() == name.lower()]
    return found[0] if found and re.search(rf"\b{re.escape(name)}\b", expression, re.I) else None


def mix(docs: DataFrame, spec: Mix = Mix()) -> DataFrame:
    """``docs`` with the level columns, ``tokens`` and ``copies``: how many epochs take the row.

    Rows that no epoch takes are left out. Within a leaf, the epoch that isn't
    whole takes the longest prefix of its order that fits. Order is dealt to
    parts, about the root of the leaf's rows in number, so neither the parts nor
    the one in which the budget ends, the only one that is sorted, are more than
    that many rows; only the keys are sorted, and the row where the prefix ends
    is what the texts are held against. Columns of ``docs`` stay; the levels that
    aren't made from a column of their name come after them, then tokens and
    copies, with underscores where they clash. A null text
    has no tokens and is taken with its place in the order; null languages and
    sources count as empty names; a null doc_id is drawn as an empty one; rows
    of one doc_id have one place and are taken in order of their text's digest;
    equal rows are taken as far as they fit; an empty table gives an empty
    result. Eager up to the budgets.
    """
    names = list(spec.names)
    digest = F.md5(utf8(F.col("text")))
    base = docs.select(
        packed(docs), *[F.expr(e).alias(n) for n, e in spec.levels], token_count(F.col("text")).alias("tokens"), F.col("doc_id").alias("doc"), digest.alias("digest")
    )
    slim = materialize(base.select(*names, "doc", "digest", "tokens"), "mix-rows")
    leaves = materialize(budgets(slim, spec), "mix-budgets")
    few = leaves.count() <= BROADCAST_LEAVES
    small = lambda d: F.broadcast(d) if few else d
    draw = _draw(spec.seed)
    part = F.expr("shiftright(cast(conv(substring(draw, 1, 8), 16, 10) as bigint), 32 - bits)")

    drawn = slim.join(small(leaves), names).withColumn("draw", draw).withColumn("part", part)
    parts = drawn.groupBy(*names, "part").agg(F.sum("tokens").alias("part_tokens"), F.first("rest").alias("rest"))
    run = W.partitionBy(*names).orderBy("part").rowsBetween(W.unboundedPreceding, W.currentRow)
    ends = parts.withColumn("upto", F.sum("part_tokens").over(run)).where("upto > rest")
    ends = ends.groupBy(*names).agg(F.min("part").alias("end_part"), F.min_by(F.col("upto") - F.col("part_tokens"), "part").alias("before"))
    ends = materialize(ends, "mix-ends")

    order = W.partitionBy(*names).orderBy("draw", "digest").rowsBetween(W.unboundedPreceding, W.currentRow)
    edge = drawn.drop("rest").join(small(ends.join(leaves.select(*names, "rest"), names)), names).where("part = end_part")
    fits = edge.withColumn("sum", F.col("before") + F.sum("tokens").over(order)).where("sum <= rest")
    last = fits.groupBy(*names, "draw", "digest").agg(F.count(F.lit(1)).alias("n")).groupBy(*names).agg(F.max(F.struct("draw", "digest", "n")).alias("cut"))
    keep = materialize(leaves.join(ends.select(*names, "end_part"), names, "left").join(last, names, "left").select(*names, "epochs", "rest", "bits", "end_part", "cut"), "mix-keep")

    rows = base.join(small(keep), names).withColumn("draw", draw).withColumn("part", part)
    once_more = lambda fits: F.col("epochs") + (F.coalesce(fits, F.lit(False)) & (F.col("rest") > 0)).cast("long")
    at_end = F.coalesce(F.col("part") == F.col("end_part"), F.lit(False))
    at_cut = F.coalesce(at_end & (F.col("draw") == F.col("cut.draw")) & (F.col("digest") == F.col("cut.digest")), F.lit(False))
    before = F.when(at_end, F.struct("draw", "digest") < F.struct("cut.draw", "cut.digest")).otherwise(F.col("end_part").isNull() | (F.col("part") < F.col("end_part")))
    sure = rows.where(~at_cut).withColumn("copies", once_more(before))
    # equal rows where the prefix ends, of which not all may fit
    same = rows.where(at_cut).withColumn("copies", once_more(F.row_number().over(W.partitionBy(*names).orderBy("draw")) <= F.col("cut.n")))
    taken, new = list(docs.columns), []
    for n, e in spec.levels:
        if _own_column(docs.columns, n, e) is None:
            taken.append(fresh(taken, n))
            new.append(F.col(n).alias(taken[-1]))
    for n in ("tokens", "copies"):
        taken.append(fresh(taken, n))
        new.append(F.col(n).cast("long").alias(taken[-1]))
    return sure.unionByName(same).where("copies > 0").select(*unpacked(docs.columns), *new)


def mixed_documents(docs: DataFrame, spec: Mix = Mix()) -> DataFrame:
    """The rows of ``docs`` that the mix takes, once per epoch that takes them."""
    found = mix(docs, spec)
    times = F.explode(F.array_repeat(F.lit(0), F.col(found.columns[-1]).cast("int"))).alias("times")
    return found.select(packed(docs), times).select(*unpacked(docs.columns))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = [F.coalesce(F.col(n), F.lit("")).alias(n) for n in ("domain", "lang", "source")]
    return mix(table(spark, sf_dir, "documents")).select("doc_id", *named, "tokens", "copies")


def oracle(spec: Mix = Mix(), docs: str = "documents") -> str:
    """The same rows in DuckDB's SQL."""
    n1, n2, n3 = spec.names
    e1, e2, e3 = (e for _, e in spec.levels)
    w1, w2, w3 = spec.weights
    total = f"(SELECT coalesce(sum(leaf_tokens), 0) FROM leaf) * {spec.most_epochs}"
    budget = f"least({spec.budget}, {total})" if spec.budget is not None else "(SELECT coalesce(sum(leaf_tokens), 0) FROM leaf)"

    def share(src: str, out: str, parent: str, name: str) -> str:
        by = f"PARTITION BY {parent}" if parent else ""
        order = f"ORDER BY cap::DOUBLE / weight, {name}"
        return f"""{out}_a AS (SELECT *, coalesce(sum(cap) OVER ({by} {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
             sum(weight) OVER ({by} {order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left FROM {src} WHERE weight > 0),
{out}_b AS (SELECT *, cap::HUGEINT * weight_left <= weight::HUGEINT * greatest(budget - cap_before, 0) AS is_full FROM {out}_a),
{out}_c AS (SELECT *, coalesce(sum(CASE WHEN is_full THEN cap END) OVER ({by}), 0) AS cap_full, sum(CASE WHEN NOT is_full THEN weight END) OVER ({by}) AS weight_rest FROM {out}_b),
{out} AS (SELECT *, CASE WHEN is_full THEN cap ELSE least(cap, weight::HUGEINT * greatest(budget - cap_full, 0) // weight_rest) END AS given FROM {out}_c)"""

    return f"""
WITH d AS (SELECT doc_id, text, {e1} AS {n1}, {e2} AS {n2}, {e3} AS {n3}, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS tokens FROM {docs}),
leaf AS (SELECT {n1}, {n2}, {n3}, sum(tokens)::BIGINT AS leaf_tokens FROM d GROUP BY ALL),
u3 AS (SELECT *, leaf_tokens * {spec.most_epochs} AS cap, {w3} AS weight FROM leaf),
u2 AS (SELECT *, {w2} AS weight FROM (SELECT {n1}, {n2}, sum(cap) AS cap FROM u3 WHERE weight > 0 GROUP BY ALL)),
u1 AS (SELECT *, {w1} AS weight FROM (SELECT {n1}, sum(cap) AS cap FROM u2 WHERE weight > 0 GROUP BY ALL)),
b1 AS (SELECT *, {budget} AS budget FROM u1),
{share("b1", "s1", "", n1)},
b2 AS (SELECT u2.*, s1.given AS budget FROM u2 JOIN s1 USING ({n1})),
{share("b2", "s2", n1, n2)},
b3 AS (SELECT u3.*, s2.given AS budget FROM u3 JOIN s2 USING ({n1}, {n2})),
{share("b3", "s3", f"{n1}, {n2}", n3)},
e AS (SELECT {n1}, {n2}, {n3}, given // leaf_tokens AS epochs, given % leaf_tokens AS rest FROM s3 WHERE leaf_tokens > 0),
r AS (SELECT d.*, epochs, rest, md5('{spec.seed}:' || epochs || ':' || coalesce(doc_id::VARCHAR, '')) AS u FROM d JOIN e USING ({n1}, {n2}, {n3})),
c AS (SELECT *, sum(tokens) OVER (PARTITION BY {n1}, {n2}, {n3} ORDER BY u, md5(coalesce(text, '')) ROWS UNBOUNDED PRECEDING) AS upto FROM r)
SELECT doc_id, {n1}, {n2}, {n3}, tokens::BIGINT AS tokens, (epochs + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END)::BIGINT AS copies
FROM c WHERE epochs + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END > 0"""
