"""Mixing sources to target weights by hierarchical budgeting, in DataFrame operations only.

Leaves are (domain, lang, source).  A node can use at most what its documents hold in
`max_epochs` epochs.  A budget is handed down from the root: children share their
parent's in proportion to their weights, and what a child can't use goes to its siblings (water-filling:
those that can't use their share get all they can use, the rest one common rate).  As what a node can
use is the sum over its children, a shortage reaches an ancestor's siblings only when
all siblings are full.  Each leaf then takes whole epochs and, of one more, a prefix of the epoch's
seeded order up to the rest of its budget.

The prefix sums are never taken over a whole leaf: documents are dealt by the first digits of
their order key, the totals by digit tell where the prefix ends, and only the documents with the
digits in which it ends are summed one by one.  All amounts are whole tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import save

#: Leaf tables of up to so many rows are broadcast (some 100 bytes each); larger ones are joined by key.
BROADCAST_LEAVES = 100_000
DIGITS = 3

#: Production weights: by domain, language and source; what isn't listed weighs 1.
DOMAIN_WEIGHTS = {"d0": 5, "d1": 3, "d2": 2}
LANG_WEIGHTS = {"en": 6, "de": 2, "fr": 2, "es": 2}
SOURCE_WEIGHTS = {"src0": 2, "src1": 3}


def domain_of(source: Column) -> Column:
    """Domain of a source that has none of its own: d0, d1 or d2 by the first digit of its md5."""
    digit = F.substring(F.md5(F.coalesce(source, F.lit("")).cast("binary")), 1, 1)
    return F.concat(F.lit("d"), (F.instr(F.lit("0123456789abcdef"), digit) % 3).cast("string"))


def token_count(text: Column) -> Column:
    """Words between spaces, as a cheap stand-in for a tokenizer's count: one more than the spaces; 0 if null or empty."""
    return F.when(F.length(text) > 0, F.length(text) - F.length(F.replace(text, F.lit(" "))) + 1).otherwise(0).cast("long")


def order_key(seed: int, epoch: Column, doc_id: Column) -> Column:
    """Place in an epoch's order: an md5, as hexadecimal digits."""
    return F.md5(F.concat(F.lit(f"{seed}:"), epoch.cast("string"), F.lit(":"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def _weight(column: str, weights: dict[str, int]) -> Column:
    out = F.lit(1)
    for k, v in weights.items():
        out = F.when(F.col(column) == k, v).otherwise(out)
    return out.cast("long")


def _fill(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Share each parent's `budget` among its children: adds `share`.  nodes: parent columns, name, weight, usable, budget."""
    order = Window.partitionBy(*parent).orderBy(F.col("usable") / F.col("weight"), name)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*parent)
    full = nodes.withColumns(
        {
            "_left": F.col("budget") - F.coalesce(F.sum("usable").over(before), F.lit(0)),
            "_weights": F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
        }
    ).withColumn("_rate", F.when(F.col("_left") / F.col("_weights") < F.col("usable") / F.col("weight"), F.col("_left") / F.col("_weights")))
    # the first child (in this order) that can use more than the common rate sets it for all that follow
    full = full.withColumn("_common", F.first("_rate", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    share = F.when(F.col("_common").isNull(), F.col("usable")).otherwise(F.least(F.col("usable"), F.floor(F.col("_common") * F.col("weight")).cast("long")))
    return full.withColumn("share", share).drop("_left", "_weights", "_rate", "_common")


def leaf_budgets(docs: DataFrame, total: int | None, max_epochs: int, domain_weights: dict, lang_weights: dict, source_weights: dict) -> DataFrame:
    """docs: (domain, lang, source, tokens) -> domain, lang, source, available, quota.  total None: all tokens there are."""
    leaf = ["domain", "lang", "source"]
    leaves = docs.groupBy(*leaf).agg(F.sum("tokens").alias("available")).withColumn("usable", F.col("available") * max_epochs)
    langs = leaves.groupBy("domain", "lang").agg(F.sum("usable").alias("usable"), F.sum("available").alias("available"))
    domains = langs.groupBy("domain").agg(F.sum("usable").alias("usable"), F.sum("available").alias("available"))
    # one row per domain: the only window over all rows
    budget = F.sum("available").over(Window.partitionBy(F.lit(0))) if total is None else F.lit(total).cast("long")
    domains = _fill(domains.withColumn("weight", _weight("domain", domain_weights)).withColumn("budget", budget).withColumn("root", F.lit(0)), ["root"], "domain")
    langs = langs.select("domain", "lang", "usable").withColumn("weight", _weight("lang", lang_weights)).join(domains.select("domain", F.col("share").alias("budget")), "domain")
    langs = _fill(langs, ["domain"], "lang")
    leaves = leaves.withColumn("weight", _weight("source", source_weights))
    leaves = leaves.join(langs.select("domain", "lang", F.col("share").alias("budget")), ["domain", "lang"])
    return _fill(leaves, ["domain", "lang"], "source").select(*leaf, "available", F.col("share").alias("quota"))


def mix_sources(
    docs: DataFrame,
    total: int | None = None,
    max_epochs: int = 4,
    seed: int = 17,
    domain_weights: dict | None = None,
    lang_weights: dict | None = None,
    source_weights: dict | None = None,
    tokens: Column | None = None,
    domain: Column | None = None,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """How often each document is taken so that sources meet their target weights.

    Returns doc_id, domain, lang, source, n_tokens, quota (of its leaf) and epochs (0: not taken).  A document
    takes the prefix of an epoch's order (an md5 of seed, epoch and doc_id, then the id) if
    the tokens up to and with it don't exceed what whole epochs leave of the quota, so a leaf falls short
    of its quota by less than its next document.  A null lang or source is the empty name;
    null texts have no tokens and go with the prefix they stand in.  Leaves without tokens get nothing.
    Rows with one id are ordered by their tokens and all counted.  Of other columns, those named in `carry` come
    along as the struct `row`, without being shuffled but for the few rows where a prefix ends."""
    leaf = ["domain", "lang", "source"]
    named = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), (token_count(F.col("text")) if tokens is None else tokens).alias("n_tokens"), (domain_of(F.col("source")) if domain is None else F.coalesce(domain, F.lit(""))).alias("domain"), *([F.struct(*(F.col(f"`{c}`") for c in carry)).alias("row")] if carry else []))
    weights = [DOMAIN_WEIGHTS if domain_weights is None else domain_weights, LANG_WEIGHTS if lang_weights is None else lang_weights, SOURCE_WEIGHTS if source_weights is None else source_weights]
    budgets = leaf_budgets(named.select(*leaf, F.col("n_tokens").alias("tokens")), total, max_epochs, *weights)
    whole = F.when(F.col("available") > 0, F.expr("quota div available")).otherwise(0)
    plan = save(budgets.withColumn("whole", whole.cast("long")).withColumn("rest", F.when(F.col("available") > 0, F.expr("quota % available")).otherwise(0).cast("long")))
    bounded = plan.count() <= BROADCAST_LEAVES
    small = (lambda df: F.broadcast(df)) if bounded else (lambda df: df)
    keyed = named.join(small(plan.select(*leaf, "quota", "whole", "rest")), leaf).withColumn("key", order_key(seed, F.col("whole"), F.col("doc_id"))).withColumn("digits", F.substring("key", 1, DIGITS))
    totals = keyed.groupBy(*leaf, "digits").agg(F.sum("n_tokens").alias("n"), F.first("rest").alias("rest"))
    before = F.sum("n").over(Window.partitionBy(*leaf).orderBy("digits")) - F.col("n")
    # where the prefix ends: the first digits that don't fit as a whole
    ends = totals.withColumn("before", before).where("before + n > rest").groupBy(*leaf).agg(F.min(F.struct("digits", "before")).alias("end"))
    ends = save(ends.select(*leaf, F.col("end.digits").alias("end_digits"), F.col("end.before").alias("before")))
    placed = keyed.join(small(ends), leaf, "left")
    taken = F.when(F.col("end_digits").isNull() | (F.col("digits") < F.col("end_digits")), 1).otherwise(0)
    columns = ["doc_id", *leaf, "n_tokens", "quota", *(["row"] if carry else [])]
    sure = placed.where("end_digits is null or digits != end_digits").select(*columns, (F.col("whole") + F.when(F.col("quota") > 0, taken).otherwise(0)).cast("long").alias("epochs"))
    at_end = placed.where("digits = end_digits")
    so_far = F.sum("n_tokens").over(Window.partitionBy(*leaf, "digits").orderBy("key", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    edge = at_end.withColumn("_sum", so_far + F.col("before")).select(*columns, (F.col("whole") + F.when((F.col("quota") > 0) & (F.col("_sum") <= F.col("rest")), 1).otherwise(0)).cast("long").alias("epochs"))
    return sure.unionByName(edge)


def mix_sql(max_epochs: int = 4, seed: int = 17) -> str:
    """The same in DuckDB SQL over `documents`, with the production weights."""
    weight = lambda c, w: f"case {' '.join(f'''when {c} = '{k}' then {v}''' for k, v in w.items())} else 1 end"

    def fill(source: str, parent: str, name: str) -> str:
        part = f"partition by {parent}" if parent else ""
        return f"""
  select * exclude (l, w, rate, common), case when common is null then usable else least(usable, cast(floor(common * weight) as bigint)) end as share from (
    select *, first_value(rate ignore nulls) over ({part} order by usable::double / weight, {name} rows between unbounded preceding and current row) as common from (
      select *, case when l::double / w < usable::double / weight then l::double / w end as rate from (
        select *, cast(budget - coalesce(sum(usable) over ({part} order by usable::double / weight, {name} rows between unbounded preceding and 1 preceding), 0) as bigint) as l,
          cast(sum(weight) over ({part}) - coalesce(sum(weight) over ({part} order by usable::double / weight, {name} rows between unbounded preceding and 1 preceding), 0) as bigint) as w
        from {source})))"""

    return f"""
with named as (
  select doc_id, coalesce(lang, '') as lang, coalesce(source, '') as source,
    case when length(text) > 0 then cast(length(text) - length(replace(text, ' ', '')) + 1 as bigint) else 0 end as n_tokens
  from documents),
docs as (select doc_id, lang, source, n_tokens, 'd' || (strpos('0123456789abcdef', substr(md5(source), 1, 1)) % 3) as domain from named),
leaves as (select domain, lang, source, cast(sum(n_tokens) as bigint) as available, cast(sum(n_tokens) * {max_epochs} as bigint) as usable, {weight("source", SOURCE_WEIGHTS)} as weight from docs group by all),
langs as (select domain, lang, cast(sum(usable) as bigint) as usable, {weight("lang", LANG_WEIGHTS)} as weight from leaves group by all),
doms as (select domain, cast(sum(usable) as bigint) as usable, {weight("domain", DOMAIN_WEIGHTS)} as weight, (select cast(sum(available) as bigint) from leaves) as budget from leaves group by all),
f1 as ({fill("doms", "", "domain")}),
l2 as (select l.*, f.share as budget from langs l join (select domain, share from f1) f using (domain)),
f2 as ({fill("l2", "domain", "lang")}),
l3 as (select l.*, f.share as budget from leaves l join (select domain, lang, share from f2) f using (domain, lang)),
f3 as ({fill("l3", "domain, lang", "source")}),
plan as (select domain, lang, source, share as quota, case when available > 0 then share // available else 0 end as whole, case when available > 0 then share % available else 0 end as rest from f3),
keyed as (select d.*, p.quota, p.whole, p.rest, md5('{seed}:' || p.whole || ':' || coalesce(cast(doc_id as varchar), '')) as key from docs d join plan p using (domain, lang, source)),
summed as (select *, sum(n_tokens) over (partition by domain, lang, source order by key, doc_id, n_tokens rows between unbounded preceding and current row) as s from keyed)
select doc_id, domain, lang, source, n_tokens, quota, cast(whole + case when quota > 0 and s <= rest then 1 else 0 end as bigint) as epochs from summed"""
