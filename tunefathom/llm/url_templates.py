"""URL filter: allow and block rules, extended to unruled URLs by a path-template tree per host.

The rules decide the URLs they fit and label the tree with them. Below a host, level by level, segments met under one
template that are too rare to tell apart (identifiers, slugs) become the wildcard ``*``. Frequent ones with labels are
compared with their labelled siblings by a two-proportion test: those that are blocked clearly more often merge into the
branch ``-``, those clearly less often into ``+``, and those alike into ``=``. Frequent ones without labels are ``?``: they
are not taken for their labelled siblings. A template is rejected where the block rate of its own labels, smoothed
towards ``NEUTRAL``, reaches ``MAX_BLOCKED``; what has no evidence is allowed, whatever other hosts are like.

Everything is built from DataFrame functions. URLs are reduced to distinct (host, generalised path) before the tree
is grown, and every group in it is a sum, so a host with a third of all pages is combined on the map side; the join
back has one row per key on one side and is split by the adaptive skew join. Each level is settled, so the plan grows
with the number of levels only.

Defined results: a null URL, or one without ``://``, has an empty host and an empty path, fits no rule and is judged
like other paths of the empty host; equal URLs get equal verdicts; other columns stay and result columns replace
input columns of the same name; without labels nothing but the rules blocks; ties of rules go to the earlier one; an
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tunefathom.session import settled

#: (verdict, host, path) of every rule; a rule fits its host and all subdomains, the longest fitting one wins.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
#: Levels of the tree; deeper segments are summed up as ``**``.
LEVELS = 4
#: A segment is looked at on its own from so many pages and labels on.
MIN_PAGES, MIN_LABELS = 10, 5
#: Standard errors between a segment's block rate and its siblings'.
MIN_Z = 2.0
#: Weight of the neutral rate in a template's, that rate, and the one from which a template is rejected.
SMOOTHING, NEUTRAL, MAX_BLOCKED = 10.0, 0.25, 0.5
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    text = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(text, _URL, 1), _UPPER, _LOWER), F.regexp_extract(text, _URL, 2)


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule (host and path) and its verdict, both null where none fits."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = [((host == h) | host.endswith("." + h)) & path.startswith(p) for _, h, p in ordered]
    if not fits:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    return (F.coalesce(*[F.when(f, F.lit(h + p)) for f, (_, h, p) in zip(fits, ordered)]),
            F.coalesce(*[F.when(f, F.lit(v)) for f, (v, _, _) in zip(fits, ordered)]))


def general_path(path: Column) -> Column:
    """Runs of digits stand for any number."""
    return F.regexp_replace(path, "[0-9]+", "#")


def _segment(segments: Column, level: int) -> Column:
    return F.coalesce(F.get(segments, F.lit(level)), F.lit(""))


def grow_templates(pages: DataFrame, levels: int = LEVELS) -> DataFrame:
    """``template`` and smoothed ``block_rate`` of every (host, general path); pages carry ``rule_verdict`` as label."""
    paths = pages.groupBy("host", "general").agg(
        F.count("*").alias("n"), F.count("rule_verdict").alias("labelled"), F.count_if(F.col("rule_verdict") == "block").alias("blocked"))
    paths = paths.withColumn("segments", F.filter(F.split("general", "/"), lambda s: s != "")).withColumn("template", F.lit(""))
    for level in range(levels):
        paths = settled(paths.withColumn("segment", _segment(F.col("segments"), level)), "url-level")
        nodes = paths.groupBy("host", "template", "segment").agg(F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
        whole = paths.groupBy("host", "template").agg(F.sum("labelled").alias("all_labelled"), F.sum("blocked").alias("all_blocked"))
        others = F.col("all_labelled") - F.col("labelled")
        overall = F.col("all_blocked") / F.col("all_labelled")
        apart = F.lit(MIN_Z) * F.sqrt(overall * (1 - overall) * (1 / F.col("labelled") + 1 / others))
        differs = F.col("blocked") / F.col("labelled") - (F.col("all_blocked") - F.col("blocked")) / others
        branch = (F.when(F.col("segment") == "", "").when(F.col("n") < MIN_PAGES, "/*").when(F.col("labelled") < MIN_LABELS, "/?")
                  .when(others == 0, "/=").when(differs > apart, "/-").when(differs < -apart, "/+").otherwise("/="))
        named = nodes.join(whole, ["host", "template"]).select("host", "template", "segment", branch.alias("branch"))
        paths = paths.join(named, ["host", "template", "segment"]).withColumn("template", F.concat("template", "branch")).drop("branch", "segment")
    paths = paths.withColumn("template", F.when(F.size("segments") > levels, F.concat("template", F.lit("/**"))).otherwise(F.col("template")))
    paths = settled(paths, "url-templates")
    smooth = (F.col("b") + F.lit(SMOOTHING * NEUTRAL)) / (F.col("l") + F.lit(SMOOTHING))
    rates = paths.groupBy("host", "template").agg(F.sum("blocked").alias("b"), F.sum("labelled").alias("l"))
    return paths.select("host", "general", "template").join(rates.select("host", "template", smooth.alias("block_rate")), ["host", "template"])


def judge_urls(pages: DataFrame, url: str = "url", rules=RULES, max_blocked: float = MAX_BLOCKED) -> DataFrame:
    """Adds ``host``, ``path``, ``rule``, ``template``, ``block_rate`` and ``verdict`` (the rule's, else the template's)."""
    made = ["host", "path", "rule", "template", "block_rate", "verdict"]
    kept = [c for c in pages.columns if c not in made]
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), *[c.alias(n) for c, n in zip(host_and_path(F.col(f"`{url}`")), ("host", "path"))])
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "rule_verdict": verdict, "general": general_path(F.col("path"))})
    judged = rows.join(grow_templates(rows), ["host", "general"])
    own = F.when(F.col("block_rate") >= max_blocked, "block").otherwise("allow")
    return judged.withColumn("verdict", F.coalesce("rule_verdict", own)).select(*[F.col("row")[c].alias(c) for c in kept], *made)


def sql() -> str:
    """The same verdicts for ``pages`` in DuckDB's SQL."""
    ordered = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))" for _, h, p in ordered]
    rule = "CASE " + " ".join(f"WHEN {f} THEN '{h}{p}'" for f, (_, h, p) in zip(fits, ordered)) + " END"
    verdict = "CASE " + " ".join(f"WHEN {f} THEN '{v}'" for f, (v, _, _) in zip(fits, ordered)) + " END"
    steps, before = [], "p0"
    for level in range(LEVELS):
        steps.append(f"""
s{level} AS (SELECT *, coalesce(list_extract(segments, {level + 1}), '') AS segment FROM {before}),
m{level} AS (SELECT host, template, segment, n, labelled, blocked, al - labelled AS others, blocked / labelled - (ab - blocked) / (al - labelled) AS differs,
  {MIN_Z} * sqrt(ab / al * (1 - ab / al) * (1 / labelled + 1 / (al - labelled))) AS apart FROM (
  SELECT *, sum(labelled) OVER (PARTITION BY host, template) AS al, sum(blocked) OVER (PARTITION BY host, template) AS ab FROM (
    SELECT host, template, segment, sum(n) AS n, sum(labelled)::DOUBLE AS labelled, sum(blocked)::DOUBLE AS blocked FROM s{level} GROUP BY host, template, segment))),
n{level} AS (SELECT host, template, segment, CASE WHEN segment = '' THEN '' WHEN n < {MIN_PAGES} THEN '/*' WHEN labelled < {MIN_LABELS} THEN '/?'
  WHEN others = 0 THEN '/=' WHEN differs > apart THEN '/-' WHEN differs < -apart THEN '/+' ELSE '/=' END AS branch FROM m{level}),
p{level + 1} AS (SELECT host, general, n, labelled, blocked, segments, template || branch AS template FROM s{level} JOIN n{level} USING (host, template, segment)),""")
        before = f"p{level + 1}"
    return f"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '{_URL}', 1), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(coalesce(url, ''), '{_URL}', 2) AS path FROM pages),
r AS (SELECT *, regexp_replace(path, '[0-9]+', '#', 'g') AS general, {rule} AS rule, {verdict} AS rule_verdict FROM u),
c AS (SELECT host, general, count(*) AS n, count(rule_verdict) AS labelled, count(*) FILTER (WHERE rule_verdict = 'block') AS blocked FROM r GROUP BY host, general),
p0 AS (SELECT *, list_filter(string_split(general, '/'), lambda s: s <> '') AS segments, '' AS template FROM c),{''.join(steps)}
t AS (SELECT host, general, labelled, blocked, CASE WHEN len(segments) > {LEVELS} THEN template || '/**' ELSE template END AS template FROM {before}),
v AS (SELECT host, template, (sum(blocked) + {SMOOTHING * NEUTRAL}::DOUBLE) / (sum(labelled) + {SMOOTHING}::DOUBLE) AS block_rate FROM t GROUP BY host, template)
SELECT r.page_id, r.host, r.path, r.rule, coalesce(r.rule_verdict, CASE WHEN v.block_rate >= {MAX_BLOCKED} THEN 'block' ELSE 'allow' END) AS verdict, t.template
FROM r JOIN t USING (host, general) JOIN v USING (host, template)"""
