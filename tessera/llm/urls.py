"""URL filters: rules first, then path-template trees.

Where no rule fits, a URL is judged by the template of its path. Per host, a tree
is grown from the first path segment down: at each node the segments of one shape
(digits written as ``#``) become a wildcard when at least ``LEAST_VALUES`` values
of it occur, and the plain segments without labels do when there are more than
``MAX_CHILDREN`` plain ones; segments with labels keep branches of their own, so
that a rule for one says nothing of the rest. Sibling branches
with labels whose shares of bad URLs do not differ at the 5 % level are merged and
share their counts.

The same tree is grown over all hosts of a domain (their last two labels) and over all
hosts, and a template that its host knows little of falls back on them. With ``n``
labelled URLs of the template in a scope, ``bad`` of them bad, the purity is smoothed by
that of the next wider scope, which weighs as much as ``STRENGTH`` labels:

    (bad + STRENGTH * wider) / (n + STRENGTH),    1/2 beyond the widest.

A template is rejected if its purity is at least ``REJECT``. Evidence passes between
equal templates of different hosts, never from one branch of a host to another: labels
are the verdicts of the rules by default (or a table of (url, bad)), and a rule for one
branch says nothing of its neighbours. A template without labels anywhere is allowed.

All steps are aggregations and joins on (scope, prefix, shape); a host's URLs are never
gathered. Paths of any depth keep all their segments: below a node with fewer paths than
a wildcard needs nothing can be generalised, so its paths are done, and the rounds go as
deep as the tree branches.

Cases: null URLs and those without ``://`` have empty host and path, fit no rule
and are judged like any others of that host and path; an empty path has a template
of its own; rows alike get rows alike; null and repeated ids are kept; an empty
table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import cut

#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
LEAST_VALUES = 3
MAX_CHILDREN = 50
LEAST_LABELS = 5
STRENGTH = 2.0
REJECT = 0.9
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null for none."""
    order = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))
    fits = [((host == h) | host.endswith("." + h)) & path.startswith(p) for _, h, p in order]
    none = F.lit(None).cast("string")
    pick = lambda values: reduce(lambda rest, x: F.when(x[0], F.lit(x[1])).otherwise(rest), reversed(list(zip(fits, values, strict=True))), none)
    return pick([h + p for _, h, p in order]), pick([v for v, _, _ in order])


def segments(path: Column) -> Column:
    return F.when(path == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(path, r"\A/", ""), "/"))


def shape(segment: Column) -> Column:
    return F.regexp_replace(segment, r"[0-9a-f]{8}-[0-9a-f-]{27}|[0-9a-f]{32,}|[0-9]+", "#")


def scopes(host: Column) -> list[Column]:
    """The host, its domain and all hosts, from narrow to wide; no two scopes have one name."""
    return [F.concat(F.lit("="), host), F.concat(F.lit("+"), F.regexp_extract(host, r"[^.]*(?:\.[^.]*)?\z", 0)), F.lit("*")]


def templates(urls: DataFrame) -> DataFrame:
    """(scope, path, parent, template, n, labelled, bad) from (scope, path, bad); bad is 1, 0 or null."""
    paths = urls.groupBy("scope", "path").agg(F.count(F.lit(1)).alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    keep = ["scope", "path", "n", "labelled", "bad"]
    open_ = cut(paths.select(*keep, segments(F.col("path")).alias("rest"), F.lit("").alias("template")))
    done = None
    while True:
        # a node with few paths has nothing to generalise
        node = open_.filter(F.size("rest") > 0).groupBy("scope", "template").agg(F.count(F.lit(1)).alias("paths")).filter(F.col("paths") >= LEAST_VALUES)
        node = cut(node.select(F.col("scope").alias("ns"), F.col("template").alias("nt")))
        at_node = (F.col("scope") == F.col("ns")) & (F.col("template") == F.col("nt"))
        ended = open_.filter(F.size("rest") == 0).unionByName(open_.filter(F.size("rest") > 0).join(node, at_node, "left_anti"))
        whole = F.when(F.size("rest") > 0, F.concat("template", F.lit("/"), F.array_join("rest", "/"))).otherwise(F.col("template"))
        ended = ended.select(*keep, whole.alias("template"))
        done = ended if done is None else done.unionByName(ended)
        if node.isEmpty():
            return cut(done.withColumn("parent", F.regexp_replace("template", r"/[^/]*\z", "")))
        here = open_.filter(F.size("rest") > 0).join(node, at_node).drop("ns", "nt").withColumn("seg", F.element_at("rest", 1))
        here = here.withColumn("shape", shape(F.col("seg")))
        values = here.groupBy("scope", "template", "shape", "seg").agg(F.sum("labelled").alias("labelled"))
        shapes = cut(values.groupBy("scope", "template", "shape").agg(F.count(F.lit(1)).alias("values"), F.sum("labelled").alias("labelled")))
        wild = F.col("shape").contains("#") & (F.col("values") >= LEAST_VALUES)
        plain = shapes.groupBy("scope", "template").agg(F.sum(F.when(~wild, F.col("values")).otherwise(0)).alias("plain"))
        p = plain.filter(F.col("plain") > MAX_CHILDREN).select(F.col("scope").alias("ps"), F.col("template").alias("pt"), "plain")
        token = F.when(wild, F.regexp_replace("shape", "#", "*")).when(F.col("plain").isNotNull() & (F.col("labelled") == 0), "*")
        tokens = shapes.filter(wild | (F.col("labelled") == 0)).join(p, (F.col("scope") == F.col("ps")) & (F.col("template") == F.col("pt")), "left")
        tokens = cut(tokens.select(F.col("scope").alias("ts"), F.col("template").alias("tt"), F.col("shape").alias("th"), token.alias("token")).filter("token is not null"))
        here = here.join(tokens, (F.col("scope") == F.col("ts")) & (F.col("template") == F.col("tt")) & (F.col("shape") == F.col("th")), "left")
        rest = F.slice("rest", F.lit(2), F.size("rest"))
        open_ = cut(here.select(*keep, rest.alias("rest"), F.concat("template", F.lit("/"), F.coalesce("token", "seg")).alias("template")))


def merged(paths: DataFrame) -> DataFrame:
    """(scope, template, n, bad): labels by template, those of like siblings put together."""
    one = cut(paths.groupBy("scope", "parent", "template").agg(F.sum("labelled").alias("n"), F.sum("bad").alias("bad")).filter("n > 0"))
    ok = F.col("n") >= LEAST_LABELS
    kin = one.filter(ok).groupBy("scope", "parent").agg(F.sum("n").alias("all_n"), F.sum("bad").alias("all_bad"))
    kin = kin.withColumnRenamed("scope", "ks").withColumnRenamed("parent", "kp")
    same = (F.col("scope") == F.col("ks")) & (F.col("parent") == F.col("kp"))
    one = one.join(kin, same, "left").drop("ks", "kp")
    rest_n, rest_bad = F.col("all_n") - F.col("n"), F.col("all_bad") - F.col("bad")
    share = F.col("all_bad") / F.col("all_n")
    # null (and so not merged) where a branch has no labelled kin
    spread = F.sqrt(share * (1 - share) * (1 / F.col("n") + F.try_divide(F.lit(1), rest_n)))
    near = F.abs(F.col("bad") / F.col("n") - F.try_divide(rest_bad, rest_n)) <= 1.96 * spread
    one = cut(one.withColumn("merge", F.coalesce(ok & near, F.lit(False))).select("scope", "parent", "template", "n", "bad", "merge"))
    like = one.filter("merge").groupBy("scope", "parent").agg(F.sum("n").alias("like_n"), F.sum("bad").alias("like_bad"))
    like = like.withColumnRenamed("scope", "ks").withColumnRenamed("parent", "kp").withColumn("like", F.lit(True))
    one = one.join(like, same & (F.col("merge") == F.col("like")), "left")
    return one.select("scope", "template", F.coalesce("like_n", "n").alias("n"), F.coalesce("like_bad", "bad").alias("bad"))


def judge(pages: DataFrame, id_col: str = "page_id", url: str = "url", rules=RULES, labels: DataFrame | None = None) -> DataFrame:
    """id, host, path, rule, verdict, template, purity."""
    u = F.col(f"`{url}`")
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), host_of(u).alias("host"), path_of(u).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("id", "host", "path", rule.alias("rule"), verdict.alias("ruled"))
    if labels is None:
        known = rows.select("host", "path", F.when(F.col("ruled") == "block", 1).when(F.col("ruled") == "allow", 0).alias("bad"))
    else:
        own = labels.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("bad").cast("int").alias("bad"))
        known = rows.select("host", "path", F.lit(None).cast("int").alias("bad")).union(own)
    known = known.select(F.explode(F.array(*scopes(F.col("host")))).alias("scope"), "path", "bad")
    paths = templates(known)
    pure = merged(paths).select(F.col("scope").alias("xs"), F.col("template").alias("xt"), F.col("n").alias("xn"), F.col("bad").alias("xb"))
    # each path with the labels of its template in each scope
    tree = paths.join(pure, (F.col("scope") == F.col("xs")) & (F.col("template") == F.col("xt")), "left")
    tree = cut(tree.select("scope", "path", "template", F.coalesce("xn", F.lit(0)).alias("n"), F.coalesce("xb", F.lit(0)).alias("bad")))
    here = rows.select("host", "path").distinct()
    purity = F.lit(0.5)
    for k, scope in reversed(list(enumerate(scopes(F.col("host"))))):
        mine = tree.select(F.col("scope").alias("s"), F.col("path").alias("p"), *(F.col(x).alias(f"{x}{k}") for x in ("template", "n", "bad")))
        here = here.join(mine, (scope == F.col("s")) & (F.col("path") == F.col("p"))).drop("s", "p")
        purity = (F.col(f"bad{k}") + STRENGTH * purity) / (F.col(f"n{k}") + STRENGTH)
    here = cut(here.select(F.col("host").alias("yh"), F.col("path").alias("yp"), F.col("template0").alias("template"), purity.alias("purity")))
    out = rows.join(here, (F.col("host") == F.col("yh")) & (F.col("path") == F.col("yp")), "left")
    final = F.coalesce("ruled", F.when(F.col("purity") >= REJECT, "block").otherwise("allow"))
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", final.alias("verdict"), "template", "purity")
