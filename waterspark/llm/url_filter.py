"""URL verdicts: rules first, then a path-template tree per host. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waterspark.llm.shared import stored

#: (verdict, host, path): a rule holds for its host and all subdomains below its path.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Levels of the tree; what lies deeper is one wildcard.
DEPTH = 4
#: A node with more children than this, with fewer pages for each than ``RARE``, is variable.
CHILDREN, RARE = 20, 5
#: Branches within so many standard errors of their siblings' common purity are merged.
ERRORS = 1.96
#: Smoothing: pages seen beforehand, of them bad; and the purity from which a template goes.
SEEN, BAD, REJECT = 4.0, 1.0, 0.75
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 1), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 2)


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits; null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, at, below in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(below)
        name = F.when(fits, F.lit(at + below)).otherwise(name)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def segment(path: Column, level: int, depth: int) -> Column:
    """The path's segment at a level with digits as ``#``; beyond the tree one wildcard;
    null where the path has ended."""
    cut = F.filter(F.split(path, "/"), lambda s: s != "")
    plain = F.regexp_replace(F.try_element_at(cut, F.lit(level)), "[0-9]+", "#")
    return F.when(F.size(cut) > depth, F.lit("**")).otherwise(F.lit(None)) if level > depth else plain


def template_tree(pages: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(host, shape, purity) from rows (host, path, verdict): for each distinct shape of a
    path on a host the smoothed share of blocked pages of its template.

    A shape is the path with digits generalised. Level by level, the children of a node
    become a wildcard where they are many and rare. Templates below one node that have
    labelled pages are merged where their shares do not differ significantly from the
    node's, so they judge together.
    """
    levels = [f"s{i}" for i in range(1, depth + 2)]
    leaves = pages.select("host", *[segment(F.col("path"), i, depth).alias(f"s{i}") for i in range(1, depth + 2)], "verdict")
    bad = F.col("verdict") == "block"
    leaves = leaves.groupBy("host", *levels).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(bad.cast("long")).alias("bad"),
        F.count("verdict").alias("labelled"),
    )
    tree = stored(leaves.withColumn("node", F.lit("")).withColumn("above", F.lit("")), "url-leaves")
    for level in levels:
        children = tree.filter(F.col(level).isNotNull()).groupBy("host", "node", level).agg(F.sum("n").alias("n"))
        wild = (
            children.groupBy("host", "node")
            .agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("pages"))
            .filter((F.col("kinds") > CHILDREN) & (F.col("pages") < F.col("kinds") * RARE))
            .select("host", "node", F.lit(True).alias("wild"))
        )
        name = F.when(F.col("wild"), F.lit("*")).otherwise(F.col(level))
        inside = F.col(level).isNotNull()
        tree = stored(
            tree.join(wild, ["host", "node"], "left")
            .withColumn("above", F.when(inside, F.col("node")).otherwise(F.col("above")))
            .withColumn("node", F.when(inside, F.concat("node", F.lit("/"), name)).otherwise(F.col("node")))
            .drop("wild"),
            "url-tree",
        )
    branches = tree.groupBy("host", "above", "node").agg(F.sum("bad").alias("bad"), F.sum("labelled").alias("labelled"))
    branches = branches.withColumn("bad", F.coalesce("bad", F.lit(0)))
    joint = branches.groupBy("host", "above").agg((F.sum("bad") / F.greatest(F.sum("labelled"), F.lit(1))).alias("share"))
    apart = F.abs(F.col("bad") / F.greatest("labelled", F.lit(1)) - F.col("share")) > ERRORS * F.sqrt(
        F.col("share") * (1 - F.col("share")) / F.greatest("labelled", F.lit(1))
    )
    merged = branches.join(joint, ["host", "above"]).withColumn(
        "template", F.when((F.col("labelled") == 0) | apart, F.col("node")).otherwise(F.concat("above", F.lit("/+")))
    )
    judged = merged.groupBy("host", "template").agg(
        ((F.sum("bad") + BAD) / (F.sum("labelled") + SEEN)).alias("purity")
    )
    named = merged.select("host", "node", "template").join(judged, ["host", "template"])
    shape = F.concat_ws("/", *levels)
    return tree.select("host", shape.alias("shape"), "node").join(named, ["host", "node"]).select("host", "shape", "purity")


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple = RULES, depth: int = DEPTH) -> DataFrame:
    """(page_id, host, path, rule, verdict, purity), one row per input row.

    The longest rule that fits decides. Elsewhere the page's template does: blocked where
    the smoothed share of blocked pages among its labelled pages, which are those a rule
    decides, reaches ``REJECT``; a template without labelled pages is allowed. A null url,
    or one without ``://``, has an empty host and path, and is judged like any other.
    Repeated rows repeat; other columns do not matter.

    Pages meet the tree as counts of shapes, so a host with a third of all pages is reduced
    before the shuffle; only the pages without a rule are joined to the verdicts, by host
    and shape.
    """
    host, path = url_host(F.col(url_col)), url_path(F.col(url_col))
    cut = stored(pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path")), "urls")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    cut = cut.withColumn("rule", rule).withColumn("verdict", verdict)
    shapes = template_tree(cut, depth)
    shape = F.concat_ws("/", *[segment(F.col("path"), i, depth) for i in range(1, depth + 2)])
    ruled = cut.filter("rule is not null").withColumn("purity", F.lit(None).cast("double"))
    free = cut.filter("rule is null").withColumn("shape", shape).join(shapes, ["host", "shape"], "left")
    free = free.withColumn("verdict", F.when(F.col("purity") >= REJECT, "block").otherwise("allow"))
    columns = ["page_id", "host", "path", "rule", "verdict", "purity"]
    return ruled.select(*columns).unionByName(free.select(*columns))


def oracle_sql(rules: tuple = RULES, depth: int = DEPTH) -> str:
    """The same in SQL."""
    fits = [
        (at + below, what, f"(host = '{at}' OR ends_with(host, '.{at}')) AND starts_with(path, '{below}')")
        for what, at, below in sorted(rules, key=lambda r: -len(r[1] + r[2]))
    ]
    rule = "CASE " + " ".join(f"WHEN {c} THEN '{n}'" for n, _, c in fits) + " END"
    verdict = "CASE " + " ".join(f"WHEN {c} THEN '{v}'" for _, v, c in fits) + " END"
    cut = "list_filter(string_split(path, '/'), lambda s: s <> '')"
    segments = [f"CASE WHEN len({cut}) >= {i} THEN regexp_replace(({cut})[{i}], '[0-9]+', '#', 'g') END AS s{i}" for i in range(1, depth + 1)]
    segments.append(f"CASE WHEN len({cut}) > {depth} THEN '**' END AS s{depth + 1}")
    levels = [f"s{i}" for i in range(1, depth + 2)]
    names = ", ".join(levels)
    steps = []
    for n, level in enumerate(levels, 1):
        steps.append(f"""
        w{n} AS (
            SELECT host, node FROM (SELECT host, node, {level}, sum(n) AS n FROM t{n - 1} WHERE {level} IS NOT NULL GROUP BY ALL)
            GROUP BY host, node HAVING count(*) > {CHILDREN} AND sum(n) < count(*) * {RARE}
        ), t{n} AS (
            SELECT t.host, {", ".join("t." + x for x in levels)}, t.n, t.bad, t.labelled,
                CASE WHEN {level} IS NOT NULL THEN t.node || '/' || CASE WHEN w.host IS NOT NULL THEN '*' ELSE {level} END ELSE t.node END AS node,
                CASE WHEN {level} IS NOT NULL THEN t.node ELSE t.above END AS above
            FROM t{n - 1} t LEFT JOIN w{n} w ON t.host = w.host AND t.node = w.node
        )""")
    last = f"t{depth + 1}"
    return f"""
    WITH u AS (
        SELECT page_id, coalesce(url, '') AS url FROM pages
    ), c AS (
        SELECT page_id, translate(regexp_extract(url, '{PARTS}', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(url, '{PARTS}', 2) AS path FROM u
    ), p AS (
        SELECT *, {rule} AS rule, {verdict} AS ruled, {", ".join(segments)} FROM c
    ), t0 AS (
        SELECT host, {names}, count(*) AS n, coalesce(sum((ruled = 'block')::INT), 0) AS bad, count(ruled) AS labelled, '' AS node, '' AS above
        FROM p GROUP BY host, {names}
    ), {", ".join(steps)}, b AS (
        SELECT host, above, node, sum(bad) AS bad, sum(labelled) AS labelled FROM {last} GROUP BY ALL
    ), j AS (
        SELECT host, above, sum(bad) / greatest(sum(labelled), 1) AS share FROM b GROUP BY ALL
    ), m AS (
        SELECT b.*, CASE WHEN labelled = 0 OR abs(bad / greatest(labelled, 1) - share) > {ERRORS} * sqrt(share * (1 - share) / greatest(labelled, 1))
            THEN node ELSE above || '/+' END AS template
        FROM b JOIN j USING (host, above)
    ), g AS (
        SELECT host, template, (sum(bad) + {BAD}::DOUBLE) / (sum(labelled) + {SEEN}::DOUBLE) AS purity FROM m GROUP BY ALL
    ), x AS (
        SELECT t.host, concat_ws('/', {", ".join("t." + x for x in levels)}) AS shape, g.purity
        FROM {last} t JOIN m ON t.host = m.host AND t.node = m.node JOIN g ON m.host = g.host AND m.template = g.template
    )
    SELECT page_id, p.host, path, rule,
        CASE WHEN rule IS NOT NULL THEN ruled WHEN purity >= {REJECT} THEN 'block' ELSE 'allow' END AS verdict,
        CASE WHEN rule IS NULL THEN purity END AS purity
    FROM p LEFT JOIN x ON p.host = x.host AND concat_ws('/', {", ".join("p." + x for x in levels)}) = x.shape
    """
