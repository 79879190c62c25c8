"""URL filter: allow and block rules by host and path, and a weighted vocabulary for what no rule covers.

The vocabulary is one Aho-Corasick automaton over the lower-cased url.  An occurrence counts
only between boundaries: neither neighbour is an ASCII letter or digit.  A url is blocked
on one strict term, or on `soft_limit` different soft terms.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (verdict, host, path prefix)
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
STRICT = ("adult-x", "casino", "cheap-pills", "free-porn", "hardcore", "malware", "phishing", "porn", "spam-farm", "viagra", "warez", "xxx")
SOFT = ("adult", "bet", "bonus", "cheap", "click", "crack", "deals", "escort", "farm", "free", "gambling", "loan", "nude", "pills", "poker", "prize", "sex", "slots", "spam", "torrent", "win")


def _ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_host(url: Column) -> Column:
    """What follows the first :// up to /, ?, # or the end, with A-Z lower-cased; empty without :// or for null."""
    return F.coalesce(_ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty without :// or for null."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _hits(strict: tuple[str, ...], soft: tuple[str, ...]):
    def rows(batches):
        import ahocorasick

        auto = ahocorasick.Automaton()
        for t in {*strict, *soft}:
            auto.add_word(t, t)
        auto.make_automaton()
        strict_set, soft_set = set(strict), set(soft)
        edge = set("abcdefghijklmnopqrstuvwxyz0123456789")
        for batch in batches:
            n_strict, n_soft = [], []
            for url in batch.column("url_lower").to_pylist():
                found = set()
                for end, term in auto.iter(url or ""):
                    start = end - len(term) + 1
                    if (start == 0 or url[start - 1] not in edge) and (end + 1 == len(url) or url[end + 1] not in edge):
                        found.add(term)
                n_strict.append(len(found & strict_set))
                n_soft.append(len(found & soft_set))
            keep = [c for c in batch.schema.names if c != "url_lower"]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(n_strict, pa.int64()), pa.array(n_soft, pa.int64())], names=[*keep, "n_strict", "n_soft"])

    return rows


def filter_urls(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, strict: tuple[str, ...] = STRICT, soft: tuple[str, ...] = SOFT, soft_limit: int = 2, id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """Verdict for every url: id, host, path, rule, verdict, n_strict, n_soft.

    A rule fits its host and all subdomains if the path starts with the rule's; of those
    that fit, the longest (host and path together) gives the verdict, and the first listed among
    equally long ones.  Without a rule the vocabulary decides.  A null url, or one without
    ://, has an empty host and path; a null is allowed.  Repeated rows are each answered; other columns are ignored."""
    base = pages.select(F.col(f"`{id_column}`").alias(id_column), F.col(f"`{url_column}`").alias("url"))
    out = base.select(id_column, url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"), _ascii_lower(F.coalesce("url", F.lit(""))).alias("url_lower"))
    kind = out.schema[id_column].dataType.simpleString()
    out = out.mapInArrow(_hits(strict, soft), f"`{id_column}` {kind}, host string, path string, n_strict long, n_soft long")
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    rule = verdict = None
    for what, host, path in ordered:
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule = F.when(fits, host + path) if rule is None else rule.when(fits, host + path)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    own = F.when((F.col("n_strict") >= 1) | (F.col("n_soft") >= soft_limit), "block").otherwise("allow")
    return out.select(id_column, "host", "path", (F.lit(None).cast("string") if rule is None else rule).alias("rule"), (own if verdict is None else verdict.otherwise(own)).alias("verdict"), "n_strict", "n_soft")


def filter_sql(rules: tuple[tuple[str, str, str], ...] = RULES, strict: tuple[str, ...] = STRICT, soft: tuple[str, ...] = SOFT, soft_limit: int = 2) -> str:
    """The same in DuckDB SQL over `pages`."""
    hit = lambda t: f"cast(regexp_matches(u, '(^|[^a-z0-9]){t}([^a-z0-9]|$)') as bigint)"
    fits = lambda h, p: f"(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')"
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    case = lambda f: "case " + " ".join(f"when {fits(h, p)} then '{f(w, h, p)}'" for w, h, p in ordered)
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
with cut as (
  select page_id, {lower.format("coalesce(url, '')")} as u,
    coalesce({lower.format("regexp_extract(url, '^.*?://([^/?#]*)', 1, 's')")}, '') as host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') as path
  from pages),
hits as (select *, {' + '.join(map(hit, strict))} as n_strict, {' + '.join(map(hit, soft))} as n_soft from cut)
select page_id, host, path, {case(lambda w, h, p: h + p)} end as rule,
  {case(lambda w, h, p: w)} when n_strict >= 1 or n_soft >= {soft_limit} then 'block' else 'allow' end as verdict, n_strict, n_soft
from hits"""
