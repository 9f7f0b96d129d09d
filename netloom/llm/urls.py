"""URL filter: a tree of path templates per host, judged by smoothed labelled purity, under explicit rules.

1. Segments that look variable (numbers, hex, dates) become a class; the pages of one host and typed path are
   counted together with their labels, so that the tree works on templates, not on pages.
2. Level by level, down to the deepest path, a node whose literal children are many and mostly seen once (VARIETY, RARE) takes one wildcard child; literal siblings whose
   share of good labels does not differ (two-sided z under Z) from the other pages of their node are merged.
3. A template's purity is (good + STRENGTH * parent's purity) / (labelled + STRENGTH), from the root (all pages) over host and branches
   down; a template below PURITY is blocked.

Each round of templates() takes every unsettled node over the segments that all its paths share, in one step, and then over one level where they
part; there are as many rounds as the longest path has partings.

Rules (host suffix, path prefix, verdict) come first; the longest that fits decides.

Defined results: a null url or one without `://` has empty host and path, no rule, and the verdict of the template tree for
the empty host; literal segments that begin like a mark of the tree ({ * ~) are escaped by a backslash; null ids and repeated rows each get their row; pages without any label are allowed; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, forget, sized

RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
VARIETY, RARE, Z, STRENGTH, PURITY = 12, 3.0, 1.96, 8.0, 0.5
#: Most templates that are broadcast (about 100 bytes each); beyond it the join shuffles.
BROADCAST_TEMPLATES = 100_000


def host(url: Column) -> Column:
    h = F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit(""))
    return F.translate(h, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule(h: Column, p: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for text, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        at, _, rest = text.partition("/")
        fits = ((h == at) | h.endswith("." + at)) & p.startswith("/" + rest)
        out = F.when(fits, F.struct(F.lit(text).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def segments(p: Column) -> Column:
    """Typed segments: {n} numbers, {h} long hex, {d} dates; an extension stays. Others stay, and the tree tests and generalises them."""
    typed = lambda s: (
        F.when(s.rlike(r"^[0-9]+(\.[a-z]+)?$"), F.regexp_replace(s, r"^[0-9]+", "{n}"))
        .when(s.rlike(r"^[0-9]{4}-[0-9]{2}(-[0-9]{2})?$"), F.lit("{d}"))
        .when(s.rlike(r"^[0-9a-fA-F-]{8,}$") & s.rlike("[0-9]"), F.lit("{h}"))
        .when(s.rlike(r"^[{*~\\\\]"), F.concat(F.lit("\\"), s))
        .otherwise(s)
    )
    own = F.filter(F.split(p, "/"), lambda s: s != "")
    return F.concat(F.transform(own, typed), F.when(p.endswith("/"), F.array(F.lit("/"))).otherwise(F.array().cast("array<string>")))


def templates(typed: DataFrame) -> DataFrame:
    """typed: (host, segs, n, labelled, good) by distinct host and segs. Returns (host, segs, template, purity, verdict)."""
    total = typed.agg(F.sum("labelled").alias("n"), F.sum("good").alias("g")).first()
    prior = (total.g + 1) / (total.n + 1) if total.n else 1.0
    purity = lambda above: (F.col("k_good") + STRENGTH * above) / (F.col("k_labelled") + STRENGTH)
    tops = typed.groupBy("host").agg(F.sum("good").alias("k_good"), F.sum("labelled").alias("k_labelled")).select("host", purity(F.lit(prior)).alias("purity"))
    tree = cut(typed.join(tops, "host").select("host", "segs", "n", "labelled", "good", "purity", F.lit("").alias("template"), F.lit(0).alias("at")), "tree")
    settled = [tree.where(F.size("segs") <= F.col("at"))]
    while not (rows := tree.where(F.size("segs") > F.col("at"))).isEmpty():
        # the next segments that all paths of a node share (before them, merged paths may differ): those of its least and greatest rest
        rest = F.slice("segs", F.col("at") + 1, F.size("segs"))
        nodes = rows.groupBy("host", "template").agg(F.min(rest).alias("lo"), F.max(rest).alias("hi"), F.sum("labelled").alias("l"), F.sum("good").alias("g"))
        parting = F.array_position(F.zip_with("lo", "hi", lambda x, y: F.coalesce(x == y, F.lit(False))), F.lit(False)).cast("int")
        nodes = nodes.select("host", "template", F.when(parting == 0, F.size("lo")).otherwise(parting - 1).alias("steps"), "l", "g")
        own, steps = F.col("g") / F.col("l"), F.col("steps")
        moved = rows.join(nodes, ["host", "template"]).select(
            "host", "segs", "n", "labelled", "good",
            F.when(F.col("l") > 0, own + (F.col("purity") - own) * F.pow(STRENGTH / (F.col("l") + STRENGTH), steps)).otherwise(F.col("purity")).alias("purity"),  # `steps` levels with the same counts
            F.concat("template", F.when(steps > 0, F.concat(F.lit("/"), F.array_join(F.slice("segs", F.col("at") + 1, steps), "/"))).otherwise("")).alias("template"), (F.col("at") + steps).alias("at"),
        )
        moved = cut(moved, "moved")
        seg = F.get("segs", F.col("at"))
        kids = moved.where(F.size("segs") > F.col("at")).withColumn("seg", seg).groupBy("host", "template", "seg").agg(F.sum("n").alias("k_n"), F.sum("labelled").alias("k_labelled"), F.sum("good").alias("k_good"))
        nodes = kids.groupBy("host", "template").agg(F.count("*").alias("variety"), F.sum("k_n").alias("n"), F.sum("k_labelled").alias("labelled"), F.sum("k_good").alias("good"))
        rest_n, rest_g = F.col("labelled") - F.col("k_labelled"), F.col("good") - F.col("k_good")
        p = F.col("good") / F.col("labelled")
        z = F.abs(F.col("k_good") / F.col("k_labelled") - rest_g / rest_n) / F.sqrt(p * (1 - p) * (1 / F.col("k_labelled") + 1 / rest_n))
        differs = F.coalesce((F.col("k_labelled") > 0) & (rest_n > 0) & (p > 0) & (p < 1) & (F.when((F.col("k_labelled") > 0) & (rest_n > 0) & (p > 0) & (p < 1), z) >= Z), F.lit(False))
        wild = (F.col("variety") >= VARIETY) & (F.col("n") / F.col("variety") <= RARE)
        shown = F.when(wild, "*").when(F.col("seg").startswith("{") | (F.col("seg") == "/"), F.col("seg")).when(differs | (F.col("variety") == 1), F.col("seg")).otherwise("~")
        branch = kids.join(nodes, ["host", "template"]).select("host", "template", "seg", F.concat("template", F.lit("/"), shown).alias("child"), "k_labelled", "k_good")
        merged = branch.groupBy("host", "template", "child").agg(F.sum("k_labelled").alias("k_labelled"), F.sum("k_good").alias("k_good"))
        step = branch.select("host", "template", "seg", "child").join(merged, ["host", "template", "child"])
        tree = cut(moved.withColumn("seg", seg).join(step, ["host", "template", "seg"], "left").select(
            "host", "segs", "n", "labelled", "good", F.when(F.col("child").isNull(), F.col("purity")).otherwise(purity(F.col("purity"))).alias("purity"), F.coalesce("child", "template").alias("template"),
            (F.col("at") + F.col("child").isNotNull().cast("int")).alias("at"),
        ), "tree")
        forget(moved)
        settled.append(tree.where(F.size("segs") <= F.col("at")))
    return reduce(DataFrame.union, settled).select("host", "segs", "template", "purity", F.when(F.col("purity") < PURITY, "block").otherwise("allow").alias("method"))


def judge(pages: DataFrame, labels: DataFrame, rules=RULES) -> DataFrame:
    """One row for each row of pages(page_id, url): page_id, host, path, rule, verdict, template, purity.

    labels(doc_id, quality, toxic) marks the page whose url has doc_id as its last numeric segment: good is quality 1 and not toxic.
    """
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    own = own.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    own = own.withColumn("segs", segments(F.col("path")))
    doc = F.regexp_extract("path", r"/([0-9]{1,18})(?:\.[a-z]+)?/?$", 1)
    good = labels.where("doc_id >= 0 and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc")).agg(F.min(((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).cast("int")).alias("good"))
    marked = own.select("host", "segs", F.when(doc != "", doc.cast("long")).otherwise(-1 - F.pmod(F.xxhash64("host", "path"), F.lit(1 << 40))).alias("doc")).join(good, "doc", "left")  # pages without a number are spread
    typed = cut(marked.groupBy("host", "segs").agg(F.count("*").alias("n"), F.count("good").alias("labelled"), F.coalesce(F.sum("good"), F.lit(0)).alias("good")), "typed")
    judged = cut(templates(typed), "templates")
    forget(typed)
    out = own.join(sized(judged, BROADCAST_TEMPLATES), ["host", "segs"], "left").withColumn("r", rule(F.col("host"), F.col("path"), rules))
    return out.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", "method", F.lit("allow")).alias("verdict"), "template", "purity")
