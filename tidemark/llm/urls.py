"""URL filters with redirect equivalence; DataFrame functions only.

A rule (host, path, verdict) fits its host and all subdomains where the url's path starts with the rule's; the longest
counts. Urls that lead to each other are aliases: a page and the target of its canonical link or of its refresh, the two
ends of a recorded redirect, a url with and without ``www.`` or a closing slash. Connected components of these links, found
in a few shuffles, carry block decisions to aliases that no rule fits, unless one of the class is allowed by a rule.
Decisions meet as one pre-aggregated row for each url and then for each component, so a url or a component of any size is
never gathered.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common as C
from tidemark.llm.graph import components

#: (host, path, verdict) of the registered query.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: Rules are a list written out into the plan; more than so many are refused.
MOST_RULES = 2_000

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)([^#]*)"
_TAGS = r"(?i)<(?:link|meta)[\x09-\x0D\x20/][^<>]*>"


def _lower(text: Column) -> Column:
    return F.translate(text, C.UPPER, C.UPPER.lower())


def host_of(url: Column) -> Column:
    return _lower(F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 2)


def node_of(url: Column) -> Column:
    """What two urls share that are the same request: host, path and query, without scheme, default port and fragment. Null for what is no url."""
    host = F.regexp_replace(host_of(url), ":(80|443)?$", "")
    path = F.when(path_of(url) == "", "/").otherwise(path_of(url))
    return F.when(host != "", F.concat(host, path, F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 3)))


def plain_form(node: Column) -> Column:
    """A node without ``www.`` and without the closing slash of its path: servers redirect one to the other."""
    return F.regexp_replace(F.regexp_replace(node, r"(?s)^www\.", ""), r"(?s)^([^/]*/[^?]*[^?/])/+(\?.*)?$", "$1$2")


def match(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest rule that fits, as struct (rule, verdict); allow where an allowing and a blocking rule are the same. Null without one."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"rules: {len(rules)}; at most {MOST_RULES}")

    def fits(name: str, prefix: str) -> Column:
        return ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(prefix))

    ordered = sorted({(h.lower(), p, v) for h, p, v in rules}, key=lambda r: (-len(r[0] + r[1]), r[2], r[0]))
    return F.coalesce(*[F.when(fits(h, p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for h, p, v in ordered], F.lit(None).cast("struct<rule:string,verdict:string>"))


def _attribute(tag: Column, name: str) -> Column:
    """Of a tag; an empty text where there is none."""
    pattern = rf"""(?i)[\x09-\x0D\x20"'/]{name}[\x09-\x0D\x20]*=[\x09-\x0D\x20]*(?:"([^"]*)"|'([^']*)'|([^\x09-\x0D\x20"'>]+))"""
    return F.concat(*[F.regexp_extract(tag, pattern, k) for k in (1, 2, 3)])


def resolve(base: Column, link: Column) -> Column:
    """The url that a link of page base leads to: absolute, without scheme, from the root, of a query or a fragment alone, or relative with dot segments."""
    link = F.regexp_replace(F.btrim(link, F.lit(C.SPACES)), "&amp;", "&")
    origin, path = F.concat(F.lit("http://"), host_of(base)), path_of(base)
    folder = F.concat(F.lit("/"), F.regexp_extract(path, r"(?s)^/(.*/)?", 1))
    joined = F.concat(F.when(F.startswith(link, F.lit("/")), "").otherwise(folder), link)
    own, rest = F.regexp_extract(joined, r"(?s)^([^?#]*)(.*)$", 1), F.regexp_extract(joined, r"(?s)^([^?#]*)(.*)$", 2)
    segments = F.transform(F.split(own, "/"), lambda s: F.array(s))
    walked = F.aggregate(segments, F.expr("array()").cast("array<string>"), lambda a, s: F.when(s[0] == ".", a).when(s[0] == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(1)))).otherwise(F.concat(a, s)))
    clean = F.array_join(F.concat(walked, F.when(own.rlike(r"(?s)(^|/)\.\.?$"), F.array(F.lit(""))).otherwise(F.expr("array()").cast("array<string>"))), "/")
    return (
        F.when(link == "", F.lit(None))
        .when(link.rlike(r"(?s)^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(F.startswith(link, F.lit("//")), F.concat(F.lit("http:"), link))
        .when(F.startswith(link, F.lit("#")), base)
        .when(F.startswith(link, F.lit("?")), F.concat(origin, path, link))
        .otherwise(F.concat(origin, clean, rest))
    )


def links_of(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(url, target) for each canonical link and refresh in the markup of pages, outside comments."""
    markup = F.col(html_col)
    tags = F.regexp_extract_all(F.regexp_replace(markup, r"(?s)<!--.*?-->", ""), F.lit(_TAGS), F.lit(0))
    found = pages.where(markup.rlike("(?i)canonical|refresh")).select(F.col(url_col).alias("url"), F.explode(tags).alias("tag"))
    canonical = F.when(F.col("tag").rlike("(?i)^<link") & _attribute(F.col("tag"), "rel").rlike(r"(?i)(^|[\x09-\x0D\x20])canonical($|[\x09-\x0D\x20])"), _attribute(F.col("tag"), "href"))
    refresh = F.when(F.col("tag").rlike("(?i)^<meta") & _attribute(F.col("tag"), "http-equiv").rlike("(?i)^refresh$"), F.regexp_extract(_attribute(F.col("tag"), "content"), r"""(?i)^[^;,]*[;,][\x09-\x0D\x20]*(?:url[\x09-\x0D\x20]*=[\x09-\x0D\x20]*)?["']?([^"']*)""", 1))
    return found.select("url", resolve(F.col("url"), F.coalesce(canonical, refresh)).alias("target")).where("target IS NOT NULL")


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]], *, redirects: DataFrame | None = None, url_col: str = "url", html_col: str | None = "html", default: str = "allow") -> DataFrame:
    """All rows and columns of pages, with host, path, rule, verdict, reason ("rule", "alias" or "default"); columns of those names are replaced.

    The longest rule decides. A url that no rule fits is blocked if a rule blocks one of its aliases and none of them is allowed by a rule, is
    allowed if a rule allows one, and else gets the default. redirects (url, target) adds recorded redirects; urls of
    theirs need not be pages, and rules judge them too. Null urls and texts without ``://`` have empty host and path, no rule
    and no aliases. Repeated rows are judged alike; an empty table stays empty.
    """
    own = ("host", "path", "rule", "verdict", "reason")
    names = [c for c in pages.columns if c not in own]
    node, found = C.unused(pages, 2)
    url = pages[url_col]
    judged = pages.select(*[pages[c] for c in names], host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias(node), match(host_of(url), path_of(url), rules).alias(found))

    slim = pages.select(url.alias("url"))
    ends = [slim.select("url", F.lit(None).cast("string").alias("target"))]
    ends += [C.cut(links_of(pages, url_col, html_col))] if html_col else []
    ends += [redirects.select("url", "target")] if redirects is not None else []
    both = reduce(DataFrame.unionAll, ends)
    urls = both.select(F.explode(F.array("url", "target")).alias("url")).where("url IS NOT NULL")
    forms = urls.select(node_of(F.col("url")).alias("a")).where("a IS NOT NULL").select("a", plain_form(F.col("a")).alias("b"))
    edges = both.select(node_of(F.col("url")).alias("a"), node_of(F.col("target")).alias("b")).where("a IS NOT NULL AND b IS NOT NULL").unionAll(forms).where("a <> b")
    seeds = urls.select(node_of(F.col("url")).alias("node"), match(host_of(F.col("url")), path_of(F.col("url")), rules)["verdict"].alias("v")).where("node IS NOT NULL AND v IS NOT NULL").distinct()
    classes = components(edges)
    decided = classes.join(seeds, "node").groupBy("root").agg(F.min("v").alias("v"))  # "allow" comes before "block"
    aliases = C.cut(classes.join(decided, "root").select(F.col("node").alias(f"{node}n"), F.col("v").alias(f"{node}v")))
    alone = C.cut(seeds.groupBy("node").agg(F.min("v").alias("v")).join(classes, "node", "left_anti").select(F.col("node").alias(f"{node}n"), F.col("v").alias(f"{node}v")))  # urls that differ in their fragment only

    ruled = judged.where(F.col(found).isNotNull()).select(*names, "host", "path", F.col(found)["rule"].alias("rule"), F.col(found)["verdict"].alias("verdict"), F.lit("rule").alias("reason"))
    rest = judged.where(F.col(found).isNull()).join(aliases.unionAll(alone), F.col(node) == F.col(f"{node}n"), "left")
    led = F.col(f"{node}v")
    rest = rest.select(*names, "host", "path", F.lit(None).cast("string").alias("rule"), F.coalesce(led, F.lit(default)).alias("verdict"), F.when(led.isNotNull(), "alias").otherwise("default").alias("reason"))
    return ruled.unionAll(rest)


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(C.read(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict", "reason")


_SPACE = r"[\x09-\x0D\x20]"


def _sql_attribute(tag: str, name: str) -> str:
    return " || ".join(rf"""regexp_extract({tag}, '(?i)[\x09-\x0D\x20"''/]{name}{_SPACE}*={_SPACE}*(?:"([^"]*)"|''([^'']*)''|([^\x09-\x0D\x20"''>]+))', {k})""" for k in (1, 2, 3))


def _sql_part(url: str, k: int) -> str:
    part = rf"regexp_extract(coalesce({url}, ''), '^.*?://([^/?#]*)([^?#]*)([^#]*)', {k}, 's')"
    return f"translate({part}, '{C.UPPER}', '{C.UPPER.lower()}')" if k == 1 else part


def _sql_node(url: str) -> str:
    host = f"regexp_replace({_sql_part(url, 1)}, ':(80|443)?$', '')"
    return f"CASE WHEN {host} <> '' THEN {host} || CASE WHEN {_sql_part(url, 2)} = '' THEN '/' ELSE {_sql_part(url, 2)} END || {_sql_part(url, 3)} END"


OP13_SQL = rf"""
WITH RECURSIVE rules(rh, rp, v) AS (VALUES {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)}),
tags AS (SELECT url, unnest(regexp_extract_all(regexp_replace(html, '<!--.*?-->', '', 'gs'), '(?i)<(?:link|meta)[\x09-\x0D\x20/][^<>]*>')) AS tag
         FROM pages WHERE regexp_matches(html, '(?i)canonical|refresh')),
hrefs AS (SELECT url, regexp_replace(regexp_replace(regexp_replace(CASE
    WHEN regexp_matches(tag, '(?i)^<link') AND regexp_matches({_sql_attribute("tag", "rel")}, '(?i)(^|{_SPACE})canonical($|{_SPACE})') THEN {_sql_attribute("tag", "href")}
    WHEN regexp_matches(tag, '(?i)^<meta') AND regexp_matches({_sql_attribute("tag", "http-equiv")}, '(?i)^refresh$')
      THEN regexp_extract({_sql_attribute("tag", "content")}, '(?i)^[^;,]*[;,]{_SPACE}*(?:url{_SPACE}*={_SPACE}*)?["'']?([^"'']*)', 1) END,
    '^{_SPACE}+', ''), '{_SPACE}+$', ''), '&amp;', '&', 'g') AS link FROM tags),
joined AS (SELECT *, CASE WHEN starts_with(link, '/') THEN link ELSE '/' || regexp_extract({_sql_part("url", 2)}, '^/(.*/)?', 1, 's') || link END AS j FROM hrefs WHERE link <> ''),
walked AS (SELECT *, list_reduce(list_transform(string_split(regexp_extract(j, '^[^?#]*'), '/'), lambda s: [s]),
    lambda a, s: CASE WHEN s[1] = '.' THEN a WHEN s[1] = '..' THEN a[1:greatest(len(a) - 1, 1)] ELSE list_concat(a, s) END) AS w FROM joined),
targets AS (SELECT url, CASE WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN link WHEN starts_with(link, '//') THEN 'http:' || link WHEN starts_with(link, '#') THEN url
    WHEN starts_with(link, '?') THEN 'http://' || {_sql_part("url", 1)} || {_sql_part("url", 2)} || link
    ELSE 'http://' || {_sql_part("url", 1)} || array_to_string(CASE WHEN regexp_matches(regexp_extract(j, '^[^?#]*'), '(^|/)\.\.?$') THEN list_append(w, '') ELSE w END, '/') || regexp_extract(j, '[?#].*$', 0, 's') END AS target
    FROM walked),
urls AS (SELECT url FROM pages WHERE url IS NOT NULL UNION SELECT target FROM targets),
told AS (SELECT url, {_sql_part("url", 1)} AS host, {_sql_part("url", 2)} AS path, {_sql_node("url")} AS node FROM urls),
ruled AS (SELECT t.*, r.rh || r.rp AS rule, r.v FROM told t LEFT JOIN rules r ON (t.host = r.rh OR ends_with(t.host, '.' || r.rh)) AND starts_with(t.path, r.rp)
          QUALIFY row_number() OVER (PARTITION BY t.url ORDER BY length(r.rh || r.rp) DESC NULLS LAST, r.v) = 1),
forms AS (SELECT DISTINCT node AS a, regexp_replace(regexp_replace(node, '^www\.', ''), '^([^/]*/[^?]*[^?/])/+(\?.*)?$', '\1\2', 's') AS b FROM told WHERE node IS NOT NULL),
links AS (SELECT a, b FROM forms UNION SELECT {_sql_node("url")}, {_sql_node("target")} FROM targets),
ways AS (SELECT a, b FROM links WHERE a IS NOT NULL AND b IS NOT NULL UNION SELECT b, a FROM links WHERE a IS NOT NULL AND b IS NOT NULL),
flood(node, v) AS (SELECT node, v FROM ruled WHERE node IS NOT NULL AND v IS NOT NULL UNION SELECT w.b, f.v FROM flood f JOIN ways w ON w.a = f.node),
led AS (SELECT node, min(v) AS v FROM flood GROUP BY node)
SELECT page_id, {_sql_part("p.url", 1)} AS host, {_sql_part("p.url", 2)} AS path, r.rule, coalesce(r.v, led.v, 'allow') AS verdict,
       CASE WHEN r.v IS NOT NULL THEN 'rule' WHEN led.v IS NOT NULL THEN 'alias' ELSE 'default' END AS reason
FROM pages p LEFT JOIN ruled r ON p.url = r.url LEFT JOIN led ON r.node = led.node
"""
