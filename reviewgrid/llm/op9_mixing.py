"""Operator 9: mix sources to target weights by hierarchical budgeting.

The tree is domain > language > source. A budget of tokens (``fraction`` of the corpus)
flows down from the root. At every node it is shared among the children by weight, but
no child gets more than its capacity (the tokens below it times ``max_epochs``); what a
child cannot take is shared among its siblings by weight, and only what all siblings
together cannot take stays with the level above. Because capacities are those of whole
subtrees, a shortage is made good by siblings before it reaches an ancestor.

A leaf's budget covers E whole epochs and a rest. Its documents come E times, and of
epoch E+1 the prefix, in the seeded order of that epoch, that makes up the rest; the last
document of the prefix gives only ``take_tokens`` of its words: where text is kept it
ends after them, and ``n_chars``, if kept, follows. Tokens are words
``[^\\x20\\x09-\\x0D]+``.

Scale. Leaf totals are combined before the shuffle. The running sum over a leaf is split
by the first three hex digits of the order key: 4,096 buckets per leaf are summed, then
rows are ordered only inside their bucket, so a source with a third of all rows is spread
over thousands of window groups. Leaf budgets are window sums over the small leaf table;
it is broadcast to the rows only up to ``BROADCAST_LEAVES`` leaves (counted).

Defined cases: null domain, language or source is the leaf ``unknown``; documents without
a word count no tokens, come with whole epochs only; weights of 0 or below give nothing;
a node without listed weights uses 1 for each child; a null doc_id orders as ``null``;
repeated rows each count; an empty table gives an empty result; extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import spill, unused

SEED = 17
FRACTION = 0.5
MAX_EPOCHS = 3
BROADCAST_LEAVES = 50_000
TREE = ("domain", "lang", "source")

# Production parameters: domains of sources, and weights of domains and languages.
DOMAINS = {"web": [f"src{i}" for i in range(8)], "news": [f"src{i}" for i in range(8, 14)],
           "books": [f"src{i}" for i in range(14, 18)]}
DOMAIN_WEIGHTS = {"web": 4.0, "news": 3.0, "books": 2.0, "unknown": 1.0}
LANG_WEIGHTS = {"en": 5.0, "de": 2.0, "fr": 2.0, "es": 1.0}
WORD = r"[^\x20\x09-\x0D]+"


def domain_of(source: Column, domains: dict[str, list[str]] = DOMAINS) -> Column:
    out = F.lit("unknown")
    for name, sources in sorted(domains.items()):
        out = F.when(source.isin(*sources), name).otherwise(out)
    return out


def _weight(name: Column, weights: dict[str, float]) -> Column:
    out = F.lit(1.0)
    for k, w in sorted(weights.items()):
        out = F.when(name == k, float(w)).otherwise(out)
    return F.greatest(out, F.lit(0.0))


def _share(nodes: DataFrame, parents: list[str], name: str) -> DataFrame:
    """Share ``budget`` among the children (rows: name, w, cap) of each parent; replaces budget by the child's."""
    family = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(1))
    inf = F.lit(float("inf"))
    rank = family.orderBy(F.when(F.col("w") > 0, F.col("cap") / F.col("w")).otherwise(inf), name)
    before = F.coalesce(F.sum("cap").over(rank.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    ahead = F.sum("w").over(rank.rowsBetween(0, Window.unboundedFollowing))
    full = (F.col("w") > 0) & (F.col("cap") * F.col("_ahead") <= F.col("w") * (F.col("budget") - F.col("_before")))
    out = nodes.withColumn("_before", before).withColumn("_ahead", ahead).withColumn("_full", full)
    out = (out.withColumn("_used", F.sum(F.when(F.col("_full"), F.col("cap")).otherwise(0.0)).over(family))
           .withColumn("_open", F.sum(F.when(F.col("_full"), 0.0).otherwise(F.col("w"))).over(family)))
    return out.withColumn("budget", F.when(F.col("_full"), F.col("cap")).when(
        F.col("_open") > 0, F.greatest(F.lit(0.0), F.col("w") * (F.col("budget") - F.col("_used")) / F.col("_open"))).otherwise(0.0)).drop(
        "_before", "_ahead", "_full", "_used", "_open")


def leaf_budgets(leaves: DataFrame, total: float, max_epochs: int, domain_weights: dict[str, float],
                 lang_weights: dict[str, float], source_weights: dict[str, float]) -> DataFrame:
    """``leaves`` (domain, lang, source, tokens) with ``budget``, whole ``epochs`` and ``rest`` tokens."""
    cap = F.sum("tokens").cast("double") * max_epochs
    level = leaves.groupBy("domain").agg(cap.alias("cap")).withColumn("w", _weight(F.col("domain"), domain_weights))
    level = _share(level.withColumn("budget", F.lit(float(total))), [], "domain").select("domain", "budget")
    below = leaves.groupBy("domain", "lang").agg(cap.alias("cap")).withColumn("w", _weight(F.col("lang"), lang_weights))
    level = _share(below.join(level, "domain"), ["domain"], "lang").select("domain", "lang", "budget")
    below = leaves.withColumn("cap", F.col("tokens").cast("double") * max_epochs).withColumn(
        "w", _weight(F.col("source"), source_weights))
    level = _share(below.join(level, ["domain", "lang"]), ["domain", "lang"], "source")
    want = F.floor(F.col("budget") + 1e-6).cast("long")
    epochs = F.when(F.col("tokens") > 0, F.floor(want / F.col("tokens")).cast("long")).otherwise(F.lit(0).cast("long"))
    return level.select("domain", "lang", "source", "tokens", want.alias("budget"), epochs.alias("epochs"),
                        (want - epochs * F.col("tokens")).alias("rest"))


def _taken(docs: DataFrame, keep: list[str]) -> Column:
    """The kept columns ``row``; a text of more words than ``take`` ends after these, ``n_chars`` is brought up to date."""
    at = {c.lower(): c for c in keep}
    row = F.col("row")
    if "text" not in at:
        return row
    pieces = F.regexp_extract_all(row[at["text"]].cast("string"), F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    text = F.array_join(F.slice(pieces, F.lit(1), F.col("take").cast("int")), "")
    out = row.withField(at["text"], text.cast(docs.schema[at["text"]].dataType))
    if "n_chars" in at:
        out = out.withField(at["n_chars"], F.length(text).cast(docs.schema[at["n_chars"]].dataType))
    return F.when(F.col("take") < F.col("tokens"), out).otherwise(row)


def mix(docs: DataFrame, fraction: float = FRACTION, max_epochs: int = MAX_EPOCHS, seed: int = SEED,
        domains: dict[str, list[str]] = DOMAINS, domain_weights: dict[str, float] = DOMAIN_WEIGHTS,
        lang_weights: dict[str, float] = LANG_WEIGHTS, source_weights: dict[str, float] | None = None, keep: list[str] | None = None) -> DataFrame:
    """Selected rows of ``docs`` with its columns (or those in ``keep``) and ``mix_domain``, ``mix_epoch``, ``n_tokens``, ``take_tokens``
    (new columns are prefixed by ``_`` where ``docs`` has one of that name)."""
    keep = docs.columns if keep is None else keep
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("unknown"))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"),
        F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("id"),
        domain_of(F.col("source"), domains).alias("domain"), name("lang").alias("lang"), name("source").alias("source"),
        F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(WORD)).cast("long").alias("tokens"))
    leaves = spill(rows.groupBy(*TREE).agg(F.sum("tokens").alias("tokens")), "leaves")
    size = leaves.agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("t")).first()
    total = int(fraction * (size["t"] or 0))
    plan = spill(leaf_budgets(leaves, total, max_epochs, domain_weights, lang_weights, source_weights or {}), "leaf-budgets")
    plan = plan.select(*TREE, "epochs", "rest").filter("epochs > 0 or rest > 0")
    placed = rows.join(F.broadcast(plan) if size["n"] <= BROADCAST_LEAVES else plan, list(TREE))

    whole = placed.filter("epochs > 0").withColumn("epoch", F.explode(F.sequence(F.lit(1).cast("long"), F.col("epochs"))))
    whole = whole.withColumn("take", F.col("tokens"))
    key = F.md5(F.concat_ws(":", F.lit(seed), (F.col("epochs") + 1).cast("string"), "id"))
    part = placed.filter("rest > 0 and tokens > 0").withColumn("epoch", F.col("epochs") + 1).withColumn("key", key)
    part = part.withColumn("bucket", F.substring("key", 1, 3))
    sums = part.groupBy(*TREE, "bucket").agg(F.sum("tokens").alias("s"))
    sums = sums.withColumn("base", F.coalesce(F.sum("s").over(
        Window.partitionBy(*TREE).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # a bucket that opens at or beyond the rest has nothing to give: its rows never reach the window
    sums = sums.join(plan.select(*TREE, F.col("rest").alias("r")), list(TREE)).filter("base < r").select(*TREE, "bucket", "base")
    part = part.join(sums, [*TREE, "bucket"])
    order = Window.partitionBy(*TREE, "bucket").orderBy("key", "id", "tokens").rowsBetween(Window.unboundedPreceding, -1)
    part = part.withColumn("at", F.col("base") + F.coalesce(F.sum("tokens").over(order), F.lit(0))).filter("at < rest")
    part = part.withColumn("take", F.least("tokens", F.col("rest") - F.col("at")))
    part = part.withColumn("row", _taken(docs, keep))
    cols = ["row", "domain", "epoch", "tokens", "take"]
    out = whole.select(*cols).union(part.select(*cols))
    named = [F.col("row")[c].alias(c) for c in keep]
    return out.select(*named, F.col("domain").alias(unused(docs, "mix_domain")), F.col("epoch").alias(unused(docs, "mix_epoch")),
                      F.col("tokens").alias(unused(docs, "n_tokens")), F.col("take").alias(unused(docs, "take_tokens")))


def _case(col: str, weights: dict[str, float]) -> str:
    return f"CASE {col} " + " ".join(f"WHEN '{k}' THEN {max(w, 0.0)}" for k, w in sorted(weights.items())) + " ELSE 1.0 END"


def _sql_share(src: str, parents: str, name: str) -> str:
    p = f"PARTITION BY {parents}" if parents else ""
    return f"""
  (SELECT * EXCLUDE (budget, bef, ahead, full_), CASE WHEN full_ THEN cap WHEN sum(CASE WHEN full_ THEN 0.0 ELSE w END) OVER ({p}) > 0
     THEN greatest(0.0, w * (budget - sum(CASE WHEN full_ THEN cap ELSE 0.0 END) OVER ({p}))
       / sum(CASE WHEN full_ THEN 0.0 ELSE w END) OVER ({p})) ELSE 0.0 END AS budget
   FROM (SELECT *, w > 0 AND cap * ahead <= w * (budget - bef) AS full_ FROM (
     SELECT *, coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS bef,
       sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ahead
     FROM {src} WINDOW o AS ({p} ORDER BY CASE WHEN w > 0 THEN cap / w ELSE 'inf'::DOUBLE END, {name}))))"""


def oracle(documents: str = "documents", columns: str = "doc_id, lang, source") -> str:
    """DuckDB SQL for ``mix`` with the production parameters over a table or subquery."""
    domain = "CASE " + " ".join(f"WHEN source IN ({', '.join(repr(x) for x in v)}) THEN '{k}'" for k, v in sorted(DOMAINS.items())) + " ELSE 'unknown' END"
    return f"""
WITH base AS (SELECT *, row_number() OVER () AS rid, {domain} AS dom, coalesce(lang, 'unknown') AS lng, coalesce(source, 'unknown') AS srce,
    coalesce(doc_id::VARCHAR, 'null') AS id, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS tokens FROM {documents}),
leaves AS (SELECT dom, lng, srce, sum(tokens)::BIGINT AS tokens FROM base GROUP BY ALL),
total AS (SELECT floor({FRACTION} * coalesce(sum(tokens), 0)) AS t FROM leaves),
l1 AS (SELECT dom, sum(tokens)::DOUBLE * {MAX_EPOCHS} AS cap, ({_case('dom', DOMAIN_WEIGHTS)})::DOUBLE AS w, (SELECT t FROM total)::DOUBLE AS budget FROM leaves GROUP BY dom),
b1 AS (SELECT dom, budget FROM {_sql_share('l1', '', 'dom')}),
l2 AS (SELECT dom, lng, cap, ({_case('lng', LANG_WEIGHTS)})::DOUBLE AS w, budget FROM
    (SELECT dom, lng, sum(tokens)::DOUBLE * {MAX_EPOCHS} AS cap FROM leaves GROUP BY ALL) JOIN b1 USING (dom)),
b2 AS (SELECT dom, lng, budget FROM {_sql_share('l2', 'dom', 'lng')}),
l3 AS (SELECT dom, lng, srce, tokens, tokens::DOUBLE * {MAX_EPOCHS} AS cap, 1.0::DOUBLE AS w, budget FROM leaves JOIN b2 USING (dom, lng)),
b3 AS (SELECT dom, lng, srce, tokens AS lt, floor(budget + 1e-6)::BIGINT AS want FROM {_sql_share('l3', 'dom, lng', 'srce')}),
plan AS (SELECT *, CASE WHEN lt > 0 THEN want // lt ELSE 0 END AS epochs, want - CASE WHEN lt > 0 THEN want // lt ELSE 0 END * lt AS rest FROM b3),
placed AS (SELECT * FROM base JOIN plan USING (dom, lng, srce)),
part AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY dom, lng, srce ORDER BY md5(concat({SEED}, ':', epochs + 1, ':', id)), id, tokens
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM placed WHERE rest > 0 AND tokens > 0),
picked AS (
  SELECT rid, e AS epoch, tokens AS take FROM (SELECT *, unnest(range(1, epochs + 1)) AS e FROM placed)
  UNION ALL SELECT rid, epochs + 1, least(tokens, rest - pos) FROM part WHERE pos < rest)
SELECT {columns}, dom AS mix_domain, epoch::BIGINT AS mix_epoch, tokens::BIGINT AS n_tokens, take::BIGINT AS take_tokens
FROM picked JOIN base USING (rid)"""
