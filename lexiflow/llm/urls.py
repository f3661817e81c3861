"""URL filter: rules first, then a tree of path templates per host.

Pages that a rule covers are the labelled ones.  The others are judged by the
template of their path: digits and long hexadecimal runs are masked, each
path is a branch of its host's tree, and level by level

* where a segment varies (the chance that the next page brings a value not seen
  before, estimated as values seen once / (pages + 1), is NEW_SHARE or more), its values
  on fewer than MIN_PAGES pages, labelled or not, become the wildcard ``*``, but for
  labelled ones whose share of blocked pages differs from that of their siblings;
* another labelled value seen on fewer than MIN_PAGES pages, or whose share of blocked
  pages does not differ from that of its labelled siblings (two-proportion
  test, |z| < 1.96), is merged with them into ``~``;
* any other value stays as it is.

From level LEVELS on the rest of the path is one value, whole and masked.

Templates are rejected by smoothed purity, (blocked + K base) / (labelled + K)
of at least PURITY, where ``base`` is the blocked share of all of the host's pages,
itself smoothed toward that of all pages; pages without a rule count there as
not blocked.  A template is evidence for the pages it covers only if COVERED of
them are labelled: a few blocked pages among many paths that merely stand under
the same host condemn none of them.

All counting is on distinct (host, masked path) pairs, aggregated before the
shuffle, so a host with a third of all pages is a few rows there.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialize

MIN_PAGES = 8
NEW_SHARE = 0.2
Z2 = 1.96 * 1.96
PURITY, COVERED = 0.75, 0.5
K = 2.0     # pages that the level above is worth
LEVELS = 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): after the first ``://`` up to ``/``, ``?``, ``#`` or the
    end, A-Z lower-cased; then up to ``?``, ``#`` or the end.  Null or without
    ``://``: both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(raw) + 1), "^[^?#]*", 0)
    return F.translate(raw, UPPER, LOWER), path


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule ``host/path`` that fits; rules are (verdict, rule)."""
    out = F.lit(None).cast("string")
    for _, r in sorted(rules, key=lambda x: (len(x[1]), x[1])):
        h, p = r.split("/", 1)[0], "/" + r.split("/", 1)[1]
        out = F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.lit(r)).otherwise(out)
    return out


def rule_verdict(rule: Column, rules: Sequence[tuple[str, str]]) -> Column:
    out = F.lit(None).cast("string")
    for v, r in rules:
        out = F.when(rule == r, F.lit(v)).otherwise(out)
    return out


def masked_segments(path: Column) -> list[Column]:
    """LEVELS values of the path, masked (null where there is none): its first
    segments, and the rest as one."""
    segs = F.filter(F.split(path, "/"), lambda s: s != "")
    mask = lambda s: F.regexp_replace(F.regexp_replace(s, "[0-9a-f]{12,}", "{x}"), "[0-9]+", "{n}")
    rest = F.when(F.size(segs) >= LEVELS, F.array_join(F.slice(segs, F.lit(LEVELS), F.size(segs)), "/"))
    return [mask(F.get(segs, F.lit(i))) for i in range(LEVELS - 1)] + [mask(rest)]


def judge_pages(pages: DataFrame, rules: Sequence[tuple[str, str]], id_col: str = "page_id",
                url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity, covered.

    The rule's verdict where one fits (template and figures are then null),
    else that of the path's template.  Null and malformed urls have an empty
    host and path, which is a template like any other.  Repeated rows and ids
    are kept; other columns are left out; an empty table gives an empty result."""
    host, path = url_parts(F.col(url_col))
    p = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    p = p.withColumn("rule", rule_for(F.col("host"), F.col("path"), rules))
    p = p.withColumn("verdict", rule_verdict(F.col("rule"), rules))
    raw = [f"s{i}" for i in range(LEVELS)]
    p = p.select("*", *[c.alias(n) for c, n in zip(masked_segments(F.col("path")), raw, strict=True)])

    keys = ["host", *raw]
    tree = (p.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count("verdict").alias("labelled"),
                                 F.count_if(F.col("verdict") == "block").alias("blocked")))
    done: list[str] = []
    for i, s in enumerate(raw):
        tree = _generalise(tree, ["host", *done], s, f"t{i}")
        done.append(f"t{i}")
    stats = tree.groupBy("host", *done).agg(F.sum("n").alias("n"), F.sum("labelled").alias("l"), F.sum("blocked").alias("b"))
    hosts = tree.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("blocked").alias("hb"))
    whole = hosts.agg(F.sum("hn").alias("n"), F.sum("hb").alias("b")).first()
    base = (F.col("hb") + K * (whole["b"] or 0) / (whole["n"] or 1)) / (F.col("hn") + K)
    scored = _join(stats, hosts, ["host"]).select("host", *done, ((F.col("b") + K * base) / (F.col("l") + K)).alias("purity"),
                                                  (F.col("l") / F.col("n")).alias("covered"))
    by_path = (_join(tree.select(*keys, *done), scored, ["host", *done])
               .select(*keys, "purity", "covered", F.concat(F.col("host"), F.lit("/"), F.concat_ws("/", *done)).alias("template")))

    ruled = p.filter(F.col("rule").isNotNull()).select(
        "page_id", "host", "path", "rule", "verdict",
        F.lit(None).cast("string").alias("template"), F.lit(None).cast("double").alias("purity"), F.lit(None).cast("double").alias("covered"))
    rest = _join(p.filter(F.col("rule").isNull()).drop("verdict"), by_path, keys).select(
        "page_id", "host", "path", "rule",
        F.when((F.col("purity") >= PURITY) & (F.col("covered") >= COVERED), F.lit("block")).otherwise(F.lit("allow")).alias("verdict"),
        "template", "purity", "covered")
    return ruled.unionByName(rest)


def _join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join in which null equals null, with equal keys for the shuffle."""
    on = [F.coalesce(F.col(f"l.{k}"), F.lit("\0")) == F.coalesce(F.col(f"r.{k}"), F.lit("\0")) for k in keys]
    extra = [F.col(f"r.{c}") for c in right.columns if c not in keys]
    return left.alias("l").join(right.alias("r"), on).select("l.*", *extra)


def _generalise(tree: DataFrame, node: list[str], value: str, name: str) -> DataFrame:
    """Add ``name``: what the branch ``value`` under ``node`` becomes."""
    child = tree.groupBy(*node, value).agg(F.sum("n").alias("cn"), F.sum("labelled").alias("cl"),
                                           F.sum("blocked").alias("cb"))
    seldom = F.col(value).isNotNull() & (F.col("cn") < MIN_PAGES)
    once = F.count_if(F.col(value).isNotNull() & (F.col("cn") == 1))
    parent = child.groupBy(*node).agg(F.sum("cl").alias("pl"), F.sum("cb").alias("pb"), (once / (F.sum("cn") + 1)).alias("new"))
    both = _join(child, parent, node)
    others, others_b = F.col("pl") - F.col("cl"), F.col("pb") - F.col("cb")
    share = F.try_divide("pb", "pl")
    gap = F.try_divide("cb", "cl") - F.try_divide(others_b, others)
    spread = share * (1 - share) * (F.try_divide(F.lit(1.0), F.col("cl")) + F.try_divide(F.lit(1.0), others))
    similar = (others > 0) & (gap * gap <= F.lit(Z2) * spread)
    became = (F.when(F.col(value).isNull(), F.lit(None).cast("string"))
               .when(seldom & (F.col("new") >= NEW_SHARE) & F.coalesce(similar | (others == 0) | (F.col("cl") == 0), F.lit(True)), F.lit("*"))
               .when(F.col("cl") == 0, F.col(value))
               .when((F.col("cn") < MIN_PAGES) | similar, F.lit("~")).otherwise(F.col(value)))
    # written, so that the plan of one level does not repeat those before it
    return materialize(_join(tree, both.select(*node, value, became.alias(name)), [*node, value]), "url-tree")
