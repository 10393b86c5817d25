"""URL filters with a path-template tree: rules decide first, templates learned from the ruled URLs decide the rest.

Per host the paths form a tree. Segments that vary (they hold digits, are long, or are rare among many siblings) become
the wildcard ``*``; deeper segments than DEPTH become one ``**``. Branches of the same parent that cannot be told apart
are merged: by the Hoeffding bound, neither the shares of what lies right below them nor their shares of blocked URLs
differ, and together they have enough URLs for the bound to be able to tell; a branch that follows another has enough of
its own (8). A branch without labels is compared by what lies below it alone, so it may come to a template with labels. The branch with most labels, then most URLs, leads; every
other one goes to the first leader that it is like. A template is rejected when the share of blocked URLs among its
labelled ones, with one more of either kind, reaches REJECT. Labels are the verdicts of the rules.

The tree is built from counts per distinct pattern, never from single URLs, so a host with a third of all rows weighs
no more than its number of patterns. Rare segments are folded first, by joining the totals of their parents, so when
branches are compared a parent has 1 / RARE of them or MANY at most. Only DataFrame expressions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import materialize

#: verdict, host, path.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
DEPTH = 3
#: A segment is rare when its parent has more kinds of segments than this and it has a smaller share of the parent's URLs.
MANY, RARE = 16, 0.05
LONG = 24
#: Hoeffding's factor at 5 % of errors, sqrt(ln(2 / 0.05) / 2); smoothed share of blocked URLs that rejects a template.
HOEFFDING, REJECT = 1.3581, 0.8

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> Column:
    """The longest rule that fits, as a struct of its text and its verdict; null if none does."""
    out = None
    for verdict, at, begin in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(begin)
        value = F.struct(F.lit(at + begin).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def _segments(path: Column) -> list[Column]:
    """The first DEPTH segments as patterns: '*' where a segment varies by itself, '' where there is none."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    pattern = lambda x: F.when(x.isNull(), "").when(x.rlike("[0-9]") | (F.length(x) > LONG), "*").otherwise(x)
    return [pattern(F.get(parts, F.lit(i))) for i in range(DEPTH)] + [F.when(F.size(parts) > DEPTH, "**").otherwise("")]


def _folded(tree: DataFrame) -> DataFrame:
    """``tree`` with f{d} for each s{d}: the segment, or '*' where it is rare among many below the same parent."""
    for d in range(DEPTH):
        parent = ["host", *(f"f{i}" for i in range(d))]
        kids = tree.groupBy(*parent, f"s{d}").agg(F.sum("n").alias("m"))
        totals = kids.groupBy(*parent).agg(F.sum("m").alias("total"), F.count("*").alias("kinds"))
        rare = (F.col("kinds") > MANY) & (F.col("m") < RARE * F.col("total")) & (F.col(f"s{d}") != "")
        names = kids.join(totals, parent).select(*parent, f"s{d}", F.when(rare, "*").otherwise(F.col(f"s{d}")).alias(f"f{d}"))
        tree = materialize(tree.join(names, [*parent, f"s{d}"]))
    return tree.withColumn(f"f{DEPTH}", F.col(f"s{DEPTH}"))


def _bound(n: Column, m: Column) -> Column:
    return HOEFFDING * (F.try_divide(F.lit(1.0), F.sqrt(n)) + F.try_divide(F.lit(1.0), F.sqrt(m)))


def _like(one: Column, two: Column) -> Column:
    """Whether branch two, which would follow one (labelled, n, blocked, below), can't be told apart from it, though they have URLs enough for that."""
    share = lambda k, c: F.aggregate(k["below"], F.lit(0.0), lambda sum_, e: sum_ + F.when(e["c"] == c, e["share"]).otherwise(F.lit(0.0)))
    kinds = F.array_distinct(F.concat(F.transform(one["below"], lambda e: e["c"]), F.transform(two["below"], lambda e: e["c"])))
    differ = F.coalesce(F.array_max(F.transform(kinds, lambda c: F.abs(share(one, c) - share(two, c)))), F.lit(0.0))
    blocked = F.abs(F.try_divide(one["blocked"], one["labelled"]) - F.try_divide(two["blocked"], two["labelled"]))
    bound = _bound(one["n"], two["n"])
    return (_bound(two["n"], two["n"]) < 1) & (bound < 1) & (differ < bound) & ~F.coalesce(blocked >= _bound(one["labelled"], two["labelled"]), F.lit(False))


def _level(tree: DataFrame, d: int) -> DataFrame:
    """``tree`` with t{d}: segment f{d}, or the like sibling of it that leads."""
    parent = ["host", *(f"t{i}" for i in range(d))]
    sums = [F.sum(c).alias(c) for c in ("n", "labelled", "blocked")]
    below = tree.groupBy(*parent, F.col(f"f{d}").alias("g"), F.col(f"f{d + 1}").alias("c")).agg(*sums)
    branches = below.groupBy(*parent, "g").agg(*sums, F.collect_list(F.struct("c", F.col("n").alias("m"))).alias("parts"))
    branches = branches.withColumn("below", F.transform("parts", lambda e: F.struct(e["c"].alias("c"), (e["m"] / F.col("n")).alias("share"))))
    # Lists of a parent's branches and of what is below each: as long as folding leaves them.
    branch = F.struct((-F.col("labelled")).alias("r0"), (-F.col("n")).alias("r1"), "g", "labelled", "n", "blocked", "below")
    rank = lambda x: F.struct(x["r0"], x["r1"], x["g"])
    groups = branches.groupBy(*parent).agg(F.array_sort(F.collect_list(branch)).alias("all"))
    leads = lambda x: ~F.exists("all", lambda y: (rank(y) < rank(x)) & _like(y, x))
    groups = groups.withColumn("leaders", F.filter("all", leads))
    leader = lambda x: F.get(F.filter("leaders", lambda y: (rank(y) < rank(x)) & _like(y, x)), F.lit(0))["g"]
    named = F.transform("all", lambda x: F.struct(x["g"].alias("g"), F.coalesce(leader(x), x["g"]).alias(f"t{d}")))
    names = groups.select(*parent, F.inline(named)).withColumnRenamed("g", f"f{d}")
    return materialize(tree.join(names, [*parent, f"f{d}"]))


def filter_urls(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict and purity of every row of ``pages``.

    ``verdict`` is the rule's where one fits, else ``block`` if the template's smoothed share of blocked URLs reaches
    REJECT, else ``allow``; ``purity`` is that share and null where a rule decides. A template without labels
    has 0.5. A null URL or one without ``://`` has empty host and path and
    is judged like a host of its own. Rows that repeat and null ids are judged one by one; an empty table gives an empty
    result; other columns are not read.
    """
    url = F.col(url_col)
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    keys = [f"s{i}" for i in range(DEPTH + 1)]
    rows = rows.select("*", *(c.alias(k) for c, k in zip(_segments(F.col("path")), keys)))
    label = F.col("_rule").isNotNull().cast("long")
    blocked = F.coalesce(F.col("_rule.verdict") == "block", F.lit(False)).cast("long")
    tree = rows.groupBy("host", *keys).agg(F.count("*").alias("n"), F.sum(label).alias("labelled"), F.sum(blocked).alias("blocked"))
    tree = _folded(materialize(tree))
    for d in range(DEPTH):
        tree = _level(tree, d)
    template = ["host", *(f"t{i}" for i in range(DEPTH)), f"f{DEPTH}"]
    purity = tree.groupBy(*template).agg(((F.sum("blocked") + 1) / (F.sum("labelled") + 2)).alias("purity"))
    judged = materialize(tree.join(purity, template).select("host", *keys, F.round("purity", 9).alias("purity")))
    ruled = rows.where("_rule is not null").select("page_id", "host", "path", "_rule.rule", "_rule.verdict", F.lit(None).cast("double").alias("purity"))
    open_rows = rows.where("_rule is null").join(judged, ["host", *keys], "left")
    verdict = F.when(F.col("purity") >= REJECT, "block").otherwise("allow")
    return ruled.union(open_rows.select("page_id", "host", "path", F.lit(None).cast("string"), verdict, "purity"))


def _oracle() -> str:
    """The same in DuckDB, level by level."""
    keys = [f"s{i}" for i in range(DEPTH + 1)]
    pattern = lambda x: f"CASE WHEN {x} IS NULL THEN '' WHEN regexp_matches({x}, '[0-9]') OR length({x}) > {LONG} THEN '*' ELSE {x} END"
    ruled = sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r))
    case = lambda i: "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{(v, h + p)[i]}'" for v, h, p in ruled) + " END"
    sql = [
        f"parsed AS (SELECT page_id, translate(coalesce(regexp_extract(url, '{_URL}', 1), ''), '{_UPPER}', '{_LOWER}') AS host, coalesce(regexp_extract(url, '{_URL}', 2), '') AS path FROM pages)",
        "parted AS (SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS parts FROM parsed)",
        f"ruled AS (SELECT page_id, host, path, {case(1)} AS rule, {case(0)} AS said, {', '.join(f'{pattern(f"parts[{i + 1}]")} AS s{i}' for i in range(DEPTH))}, CASE WHEN len(parts) > {DEPTH} THEN '**' ELSE '' END AS s{DEPTH} FROM parted)",
        f"fold0 AS (SELECT host, {', '.join(keys)}, count(*) AS n, count(rule) AS labelled, count(*) FILTER (WHERE said = 'block') AS blocked FROM ruled GROUP BY ALL)",
    ]
    bound = lambda n, m: f"{HOEFFDING} * (1.0::DOUBLE / sqrt({n}) + 1.0::DOUBLE / sqrt({m}))"
    for d in range(DEPTH):
        up = ", ".join(["host", *(f"f{i}" for i in range(d))])
        sql += [
            f"kids{d} AS (SELECT *, CASE WHEN count(*) OVER w > {MANY} AND m < {RARE} * sum(m) OVER w AND s{d} <> '' THEN '*' ELSE s{d} END AS f{d} FROM (SELECT {up}, s{d}, sum(n) AS m FROM fold{d} GROUP BY ALL) WINDOW w AS (PARTITION BY {up}))",
            f"fold{d + 1} AS (SELECT x.*, k.f{d} FROM fold{d} x JOIN kids{d} k USING ({up}, s{d}))",
        ]
    sql.append(f"tree0 AS (SELECT *, s{DEPTH} AS f{DEPTH} FROM fold{DEPTH})")
    for d in range(DEPTH):
        names = ["host", *(f"t{i}" for i in range(d))]
        up = ", ".join(names)
        of = lambda x: ", ".join(f"{x}.{n}" for n in names)
        alike = f"coalesce(abs(a.blocked / nullif(a.labelled, 0) - b.blocked / nullif(b.labelled, 0)) < {bound('nullif(a.labelled, 0)', 'nullif(b.labelled, 0)')}, true) AND {bound('b.n', 'b.n')} < 1 AND {bound('a.n', 'b.n')} < 1"
        first = "(a.labelled > b.labelled OR a.labelled = b.labelled AND (a.n > b.n OR a.n = b.n AND a.g < b.g))"
        sql += [
            f"groups{d} AS (SELECT {up}, f{d} AS g, sum(n) AS n, sum(labelled) AS labelled, sum(blocked) AS blocked FROM tree{d} GROUP BY ALL)",
            f"below{d} AS (SELECT {up}, f{d} AS g, f{d + 1} AS c, sum(n) AS m FROM tree{d} GROUP BY ALL)",
            f"near{d} AS (SELECT {of('a')}, a.g AS ga, b.g AS gb, a.n AS na, b.n AS nb FROM groups{d} a JOIN groups{d} b USING ({up}) WHERE {first} AND {alike})",
            f"shares{d} AS (SELECT {of('p')}, ga, gb, na, nb, c, m / na AS share FROM near{d} p JOIN below{d} x ON ({of('p')}, ga) = ({of('x')}, x.g) UNION ALL SELECT {of('p')}, ga, gb, na, nb, c, -m / nb FROM near{d} p JOIN below{d} x ON ({of('p')}, gb) = ({of('x')}, x.g))",
            f"pairs{d} AS (SELECT {up}, ga, gb FROM (SELECT {up}, ga, gb, na, nb, c, abs(sum(share)) AS differ FROM shares{d} GROUP BY ALL) GROUP BY {up}, ga, gb, na, nb HAVING max(differ) < {bound('na', 'nb')})",
            f"leaders{d} AS (SELECT * FROM groups{d} x WHERE NOT EXISTS (SELECT 1 FROM pairs{d} p WHERE ({of('p')}, p.gb) = ({of('x')}, x.g)))",
            f"led{d} AS (SELECT {of('p')}, gb AS g, arg_min(ga, (-l.labelled, -l.n, ga)) AS leader FROM pairs{d} p JOIN leaders{d} l ON ({of('p')}, ga) = ({of('l')}, l.g) GROUP BY ALL)",
            f"tree{d + 1} AS (SELECT f.*, coalesce(x.leader, f.f{d}) AS t{d} FROM tree{d} f LEFT JOIN led{d} x ON ({of('f')}, f.f{d}) = ({of('x')}, x.g))",
        ]
    last = ", ".join(["host", *(f"t{i}" for i in range(DEPTH)), f"f{DEPTH}"])
    sql.append(f"judged AS (SELECT host, {', '.join(keys)}, round((sum(blocked) OVER w + 1) / (sum(labelled) OVER w + 2), 9)::DOUBLE AS purity FROM tree{DEPTH} WINDOW w AS (PARTITION BY {last}))")
    return f"WITH {', '.join(sql)} SELECT page_id, r.host, path, rule, coalesce(said, CASE WHEN purity >= {REJECT} THEN 'block' ELSE 'allow' END) AS verdict, CASE WHEN rule IS NULL THEN purity END AS purity FROM ruled r JOIN judged j USING (host, {', '.join(keys)})"


ORACLE_SQL = _oracle()
