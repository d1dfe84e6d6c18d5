"""Queries of document extraction and nested checks; a document's lines are its pages, a conversation is a research card."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import fixtures as X
from tidemark.operators import documents as dc
from tidemark.queries.base import Registry

query = Registry()
QUERIES, SQL = query.queries, query.sql


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = X.table(spark, sf_dir, "documents")
    return d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("page_no", "text")).withColumn("page_no", (F.col("page_no") + 1).cast("long"))


_OK = "ok AS (SELECT doc_id, coalesce(sum(length(text)), 0) >= greatest(300, 20 * count(*)) AS ok FROM pg GROUP BY 1)"
_PAGES = "pg AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS page_no FROM documents), c AS (SELECT doc_id, page_no, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM pg)"
_EXCERPT = "left(trim(regexp_replace(substr(t, greatest(p - 101, 0) + 1, p - 1 + 520 - greatest(p - 101, 0)), '\\s+', ' ', 'g')), 800)"


@query("h1_compact", f"WITH {_PAGES} SELECT doc_id, CAST(sum(length(t)) AS BIGINT) AS chars, md5(string_agg(t, '|' ORDER BY page_no)) AS digest FROM c GROUP BY 1")
def h1(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pages(spark, sf_dir).select("doc_id", "page_no", dc.compact_for_search(F.col("text")).alias("t"))
    all_of = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "t"))), lambda x: x["t"]), "|")
    return p.groupBy("doc_id").agg(F.sum(F.char_length("t")).alias("chars"), F.md5(all_of).alias("digest"))


_CLASSES = [("GPL", ["GNU General Public", "GPL"]), ("PERMISSIVE", ["MIT License", "Apache License"]), ("COMMON", ["CC BY-NC"])]


@query(
    "h2_classify_pages",
    f"""WITH {_PAGES}, {_OK}, h AS (SELECT doc_id, page_no, t, rank, name, instr(t, phrase) AS p FROM c, (VALUES (0, 'GPL', 'GNU General Public'), (0, 'GPL', 'GPL'), (1, 'PERMISSIVE', 'MIT License'), (1, 'PERMISSIVE', 'Apache License'), (2, 'COMMON', 'CC BY-NC')) v(rank, name, phrase)
   WHERE instr(t, phrase) > 0 AND NOT (name = 'PERMISSIVE' AND substr(t, instr(t, phrase) - 1, 1) = '-')
  UNION ALL SELECT doc_id, page_no, t, 3, 'PROSE', instr(t, 'the ') FROM c WHERE t LIKE '%the %' AND t LIKE '%tion%' AND t LIKE '%and %'),
 b AS (SELECT doc_id, min(struct_pack(r := rank, p := page_no, n := name, x := {_EXCERPT})) AS b FROM h GROUP BY 1)
 SELECT d.doc_id, CASE WHEN NOT ok THEN 'UNREADABLE' ELSE coalesce(b.n, 'NOT_FOUND') END AS classification, CASE WHEN ok THEN b.p END AS page, CASE WHEN ok THEN b.x END AS excerpt, CASE WHEN ok THEN sha256(b.x) END AS sha256
 FROM documents d LEFT JOIN b USING (doc_id) JOIN ok USING (doc_id)""",
)
def h2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dc.classify_pages(_pages(spark, sf_dir), _CLASSES, negations={"PERMISSIVE": "-"}, fallback=("PROSE", ["the ", "tion", "and "], "the "), gate=_gate(spark, sf_dir))


def _gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dc.readable(_pages(spark, sf_dir), least=300, per_page=20)


@query(
    "h3_flag_phrases",
    f"""WITH {_PAGES}, {_OK}, h AS (SELECT doc_id, page_no, t, CASE WHEN instr(t, 'secret') > 0 THEN instr(t, 'secret') ELSE instr(t, 'quevi') END AS p FROM c WHERE instr(t, 'secret') > 0 OR instr(t, 'quevi') > 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY page_no) <= 5),
 g AS (SELECT doc_id, string_agg(CAST(page_no AS VARCHAR), ',' ORDER BY page_no) AS pages, md5(string_agg({_EXCERPT}, '|' ORDER BY page_no)) AS excerpts FROM h GROUP BY 1)
 SELECT doc_id, CASE WHEN NOT ok THEN 'UNREADABLE' WHEN pages IS NULL THEN 'NOT_FOUND_IN_EXTRACTED_TEXT' ELSE 'FLAG_FOUND' END AS status, CASE WHEN ok THEN coalesce(pages, '') ELSE '' END AS pages,
 CASE WHEN ok THEN coalesce(excerpts, md5('')) ELSE md5('') END AS excerpts FROM documents LEFT JOIN g USING (doc_id) JOIN ok USING (doc_id)""",
)
def h3(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dc.flag_phrases(_pages(spark, sf_dir), ["secret", "quevi"], gate=_gate(spark, sf_dir))
    return out.select("doc_id", "status", F.array_join(F.transform("pages", lambda p: p.cast("string")), ",").alias("pages"), F.md5(F.array_join("excerpts", "|")).alias("excerpts"))


def _statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statement pages out of orders: a customer's orders are pages with labelled amounts."""
    from pyspark.sql import Window

    o = X.table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    page = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).cast("long")
    revenue = F.when(k % 3 == 0, F.concat(F.lit("营业 收入占比 "), (k % 90).cast("string"), F.lit("%"))).when(k % 3 == 1, F.concat(F.lit("营业收入合计 "), F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit(" 元"))).otherwise("")
    ratio = F.when(k % 4 == 0, F.concat(F.lit(" 资产负债率为 "), (k % 100).cast("string"), F.lit("% 。"))).otherwise("")
    return o.select(F.col("o_custkey").alias("doc_id"), page.alias("page_no"), F.concat(F.lit("单位："), F.when(k % 2 == 0, "千元").otherwise("元"), F.lit("，"), revenue, ratio).alias("text"))


_STATEMENTS = """st AS (SELECT o_custkey AS doc_id, o_orderkey AS k, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS page FROM orders),
 m AS (SELECT doc_id, page, 'revenue' AS metric, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS raw_value, CASE WHEN k % 2 = 0 THEN '千元' ELSE '元' END AS unit FROM st WHERE k % 3 = 1
  UNION ALL SELECT doc_id, page, 'debt_ratio', CAST(k % 100 AS VARCHAR) || '%', CASE WHEN k % 2 = 0 THEN '千元' ELSE '元' END FROM st WHERE k % 4 = 0)"""


@query("h4_h5_labelled_values", f"WITH {_STATEMENTS} SELECT doc_id, metric, min(struct_pack(p := page, v := raw_value)).v AS raw_value, min(struct_pack(p := page, u := unit)).u AS unit, min(page) AS page FROM m WHERE page <= 80 GROUP BY 1, 2")
def h4(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = {"revenue": ["营业收入"], "debt_ratio": ["资产负债率"]}
    return dc.labelled_values(_statements(spark, sf_dir), metrics, amounts=["revenue"])


@query(
    "h6_report_year",
    """WITH st AS (SELECT o_custkey AS doc_id, year(o_orderdate) AS y, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS page FROM orders)
 SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 2011 ELSE min(CASE WHEN y >= 2000 AND page <= 5 THEN struct_pack(p := page, y := CAST(y AS INT)) END).y END AS report_year FROM st GROUP BY 1""",
)
def h6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    o = X.table(spark, sf_dir, "orders")
    page = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    pages = o.select(F.col("o_custkey").alias("doc_id"), page.alias("page_no"), F.concat(F.date_format("o_orderdate", "yyyy"), F.lit(" 年年度报告")).alias("text"), F.when(F.col("o_custkey") % 4 == 0, "2011年度报告").otherwise("公告").alias("title"))
    return dc.report_year(pages)


@query("h6_readable", f"WITH {_PAGES} SELECT doc_id, count(*) AS pages, CAST(sum(length(text)) AS BIGINT) AS chars, sum(length(text)) >= greatest(1000, 20 * count(*)) AS readable FROM pg GROUP BY 1")
def h6_readable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dc.readable(_pages(spark, sf_dir))


@query(
    "h7_html_blocks",
    r"""SELECT page_id, CAST(i - 1 AS INT) AS block_no, trim(regexp_replace(regexp_replace(b[i], '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS text
 FROM (SELECT page_id, b, unnest(generate_series(1, len(b))) AS i FROM (SELECT page_id, regexp_extract_all(html, '(?is)<li(?:\s[^>]*)?>(.*?)</li>', 1) AS b FROM pages))""",
)
def h7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dc.html_blocks(X.table(spark, sf_dir, "pages"), page_id="page_id", html="html", tag="li")


def _rate_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of rate products for each bank and month, bank names only in the first row of each day."""
    from pyspark.sql import Window

    page = F.concat("bank", F.lit("-"), F.date_format("start", "yyyyMM"))
    w = Window.partitionBy("page").orderBy("start", "product")
    r = X.rates(spark, sf_dir).select(page.alias("page"), "bank", "product", "rate", "start").withColumn("i", F.row_number().over(w)).withColumn("same", F.lag("start").over(w).eqNullSafe(F.col("start")))
    row = F.concat(F.lit("<tr><td> "), F.when(F.col("same"), "").otherwise(F.concat(F.lit("B"), "bank", F.lit("-"), F.dayofmonth("start"))), F.lit("</td><td><b>"), "product", F.lit("</b></td><td>"), F.col("rate").cast("decimal(8,6)").cast("string"), F.lit("</td></tr>"))
    table = r.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", row.alias("row")))), lambda x: x["row"]), "\n").alias("t"))
    return table.select("page", F.concat(F.lit("<table>"), "t", F.lit("</table>")).alias("html"))


@query("h7_html_rows", X.with_views("rates") + " SELECT bank || '-' || strftime(start, '%Y%m') AS page, CAST(row_number() OVER (PARTITION BY bank, date_trunc('month', start) ORDER BY start, product) - 1 AS INT) AS row_no, 'B' || bank || '-' || day(start) AS name, product, CAST(CAST(rate AS DECIMAL(8,6)) AS DOUBLE) AS rate FROM rates")
def h7_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = dc.html_rows(_rate_pages(spark, sf_dir), page_id="page", html="html")
    flat = cells.select("page", "row_no", F.col("cells")[0].alias("name"), F.col("cells")[1].alias("product"), F.col("cells")[2].cast("double").alias("rate"))
    return dc.fill_down(flat, keys=["page"], order=["row_no"], columns=["name"])


@query(
    "h8_field_between",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN 'P' || o_orderkey END AS product, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) || '元' AS amount FROM orders""",
)
def h8(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    head = F.when(k % 5 == 0, "").when(k % 3 == 0, F.concat(F.lit("产 品\n名称：P"), k)).otherwise(F.concat(F.lit("产品名称： P"), k))
    text = F.concat(head, F.lit(" 起存金额： "), F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit("元 发行期限：三年"))
    labels = ["产品名称", "起存金额", "发行期限"]
    return X.table(spark, sf_dir, "orders").select("o_orderkey", dc.field_between(text, "产品名称", labels).alias("product"), dc.field_between(text, "起存金额", labels).alias("amount"))


@query("h9_links", r"""SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '(?i)href\s*=\s*["'']([^"''#]*)["'']', 1)) AS link FROM pages""")
def h9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dc.links(X.table(spark, sf_dir, "pages"), page_id="page_id", html="html")


def _cards(spark: SparkSession, sf_dir: str, only: DataFrame | None = None) -> DataFrame:
    """Cards out of orders: an order's lines are its evidence, its claims point at line numbers; of the orders in only (card_id), if it is given."""
    o, l = X.table(spark, sf_dir, "orders"), X.table(spark, sf_dir, "lineitem")
    if only is not None:
        l = l.join(only, F.col("l_orderkey") == F.col("card_id"), "left_semi")
    quality = F.when(F.col("l_returnflag") == "A", "A").when(F.col("l_returnflag") == "N", "B").otherwise("D")
    ev = l.groupBy("l_orderkey").agg(
        F.collect_list(
            F.struct(
                F.concat(F.lit("E"), "l_linenumber").alias("evidence_id"), F.concat("l_linestatus", F.lit(":"), "l_suppkey").alias("source_id"), quality.alias("quality"),
                F.col("l_shipdate").cast("timestamp").alias("as_of"), F.col("l_partkey").cast("string").alias("body"), F.sha2((F.col("l_partkey") + F.when(F.col("l_quantity") > 49, 1).otherwise(0)).cast("string"), 256).alias("content_hash"),
            )
        ).alias("evidence")
    )
    k = F.col("o_orderkey")

    def claims(n) -> F.Column:
        return F.transform(F.when(n > 0, F.sequence(F.lit(1), n.cast("int"))).otherwise(F.array().cast("array<int>")), lambda i: F.struct(F.concat(F.lit("claim "), i).alias("text"), F.array(F.concat(F.lit("E"), i)).alias("evidence_ids"), F.when(i % 2 == 0, F.array(F.lit("E1"))).otherwise(F.array().cast("array<string>")).alias("counter_ids")))

    made = o.join(ev, k == F.col("l_orderkey"))
    return made.select(
        k.alias("card_id"), F.col("o_custkey").alias("symbol"), F.col("o_orderdate").cast("timestamp").alias("as_of"), "evidence", claims(k % 4).alias("core"), claims(k % 3 + 1).alias("bull"), claims(k % 5).alias("bear"),
        claims(k % 2).alias("facts"), claims(k % 3).alias("inferences"), F.when(k % 7 != 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("invalidation"), F.array(F.lit("r")).alias("risks"),
        F.concat(claims(k % 4), claims(k % 3 + 1)).alias("claims"),
    )


_EV = "ev AS (SELECT o_orderkey AS k, o_custkey, o_orderdate, l_linenumber AS i, l_linestatus, l_returnflag, l_shipdate, l_quantity FROM orders JOIN lineitem ON l_orderkey = o_orderkey)"
_KNOWN = "kn AS (SELECT k, any_value(o_orderdate) AS tm, any_value(o_custkey) AS symbol, list(DISTINCT i) AS ids, count(*) AS n, count(DISTINCT i) AS nd, count(*) FILTER (WHERE l_shipdate > o_orderdate) AS late, count(DISTINCT l_linestatus) FILTER (WHERE l_returnflag IN ('A', 'N')) AS domains, count(*) FILTER (WHERE l_quantity > 49) AS bad FROM ev GROUP BY 1)"


@query(
    "h10_integrity",
    f"""WITH {_EV}, {_KNOWN}, r AS (SELECT *, len(list_filter(generate_series(1, greatest(k % 4, k % 3 + 1)), lambda x: NOT list_contains(ids, x))) AS unknown FROM kn)
 SELECT k AS card_id, unknown AS unknown_references, n - nd AS duplicate_ids, late AS late_evidence, tm > TIMESTAMP '2000-01-01' AS from_future, unknown + n - nd + late = 0 AND NOT tm > TIMESTAMP '2000-01-01' AS ok FROM r""",
)
def h10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dc.integrity(_cards(spark, sf_dir), now="2000-01-01")


_SCORE = f"""{_EV}, {_KNOWN}, cl AS (SELECT *, k % 4 + k % 3 + 1 + k % 5 AS n_claims, len(list_filter(list_concat(generate_series(1, k % 4), generate_series(1, k % 3 + 1), generate_series(1, k % 5)), lambda x: list_contains(ids, x))) AS sup FROM kn),
 cv AS (SELECT *, least(CAST(100 AS DOUBLE), sup / n_claims * 100) AS cover FROM cl),
 hf AS (SELECT *, concat_ws(',', CASE WHEN k % 5 < 2 THEN 'BEAR_CASE_LT_2' END, CASE WHEN k % 3 + 1 < 2 THEN 'BULL_CASE_LT_2' END, CASE WHEN domains < 2 THEN 'EVIDENCE_DOMAINS_LT_2' END, CASE WHEN late > 0 THEN 'FUTURE_EVIDENCE' END,
  CASE WHEN k % 7 = 0 THEN 'MISSING_INVALIDATION' END, CASE WHEN cover < 95 THEN 'STRONG_CLAIM_COVERAGE_LT_95' END, CASE WHEN sup < n_claims THEN 'UNKNOWN_EVIDENCE_REFERENCE' END) AS hard_failures, CASE WHEN k % 3 = 1 THEN 1 ELSE 0 END AS warnings FROM cv),
 sc AS (SELECT *, CASE WHEN hard_failures = '' THEN 0 ELSE len(string_split(hard_failures, ',')) END AS nf FROM hf)"""


@query("h11_research_score", f"WITH {_SCORE} SELECT k AS card_id, hard_failures, warnings, domains AS evidence_domains, {X.rnd('cover', 2)} AS claim_coverage, nf = 0 AS passed, greatest(CAST(0 AS DOUBLE), CAST(100 - 15 * nf - 3 * warnings AS DOUBLE)) AS score FROM sc")
def h11(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dc.research_score(_cards(spark, sf_dir))
    return out.withColumn("hard_failures", F.array_join("hard_failures", ","))


@query("h12_qualified", f"WITH {_SCORE}, l AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY tm DESC, k DESC) = 1) SELECT symbol, k AS card_id, greatest(CAST(0 AS DOUBLE), CAST(100 - 15 * nf - 3 * warnings AS DOUBLE)) AS score FROM l WHERE nf = 0")
def h12(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, lines = X.table(spark, sf_dir, "orders"), X.table(spark, sf_dir, "lineitem").select("l_orderkey")
    heads = o.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select(F.col("o_orderkey").alias("card_id"), F.col("o_custkey").alias("symbol"), F.col("o_orderdate").cast("timestamp").alias("as_of"))
    names = {"card_id": "card_id", "symbol": "symbol", "as_of": "as_of"}
    cards = _cards(spark, sf_dir, dc.latest_cards(heads, **names).select("card_id"))  # what is not a symbol's latest card is not scored
    return dc.qualified(heads, dc.research_score(cards), **names)[0]


@query(
    "h13_bundle_checks",
    f"""WITH {_EV}, {_KNOWN}, x AS (SELECT k, bad, n - nd AS dup, count(*) FILTER (WHERE l_shipdate > e.o_orderdate - INTERVAL 10 DAY) AS late, CASE WHEN list_contains(any_value(ids), 6) THEN 0 ELSE 1 END AS unk FROM ev e JOIN kn USING (k) GROUP BY ALL)
 SELECT k AS bundle_id, bad AS wrong_hashes, late AS late_items, dup AS duplicate_ids, CAST(unk AS BIGINT) AS unknown_conflicts, true AS in_order, bad + late + dup + unk = 0 AS ok FROM x""",
)
def h13(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _cards(spark, sf_dir)
    return dc.bundle_checks(c.select(F.col("card_id").alias("bundle_id"), "as_of", (F.col("as_of") - F.expr("interval 10 days")).alias("data_cutoff"), "evidence", F.array(F.array(F.lit("E6"))).alias("conflicts")))


def _talks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    t = X.table(spark, sf_dir, "conversations")
    claim = F.struct(F.when(F.col("turn") % 2 == 0, "FACT").otherwise("VIEW").alias("kind"), (F.char_length("text") % 7).alias("rank"), F.when(F.col("turn") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("T"), F.col("turn") + 1))).alias("evidence_ids"))
    by_role = t.groupBy("conv_id", "role").agg(F.collect_list(claim).alias("claims"))
    results = by_role.groupBy(F.col("conv_id").alias("result_id")).agg(F.collect_list(F.struct("role", "claims")).alias("roles"))
    evidence = t.groupBy(F.col("conv_id").alias("result_id")).agg(F.collect_set(F.concat(F.lit("T"), "turn")).alias("evidence_ids"))
    return results, evidence


@query(
    "h14_role_checks",
    """WITH c AS (SELECT t.conv_id, count(DISTINCT role) = 2 AND count(*) FILTER (WHERE role NOT IN ('user', 'assistant')) = 0 AS complete, count(*) FILTER (WHERE turn % 3 <> 0 AND NOT EXISTS (SELECT 1 FROM conversations u WHERE u.conv_id = t.conv_id AND u.turn = t.turn + 1)) AS unknown,
  count(*) FILTER (WHERE turn % 2 = 0 AND turn % 3 = 0) AS bare, count(*) FILTER (WHERE length(text) % 7 NOT BETWEEN 1 AND 5) AS ranks FROM conversations t GROUP BY 1)
 SELECT conv_id AS result_id, complete AS roles_complete, unknown AS unknown_references, bare AS bare_facts, ranks AS bad_ranks, complete AND unknown + bare + ranks = 0 AS ok FROM c""",
)
def h14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dc.role_checks(*_talks(spark, sf_dir), roles=["user", "assistant"])


@query(
    "h15_table_hash",
    """WITH r AS (SELECT l_returnflag, sha256('l_linenumber=+' || l_linenumber || '|l_orderkey=+' || l_orderkey || '|l_partkey=+' || l_partkey || '|l_quantity=' || CASE WHEN l_orderkey % 7 = 0 THEN '-' ELSE '+' || CAST(l_quantity AS BIGINT) END || '|l_returnflag=+' || l_returnflag) AS h FROM lineitem)
 SELECT l_returnflag, sha256("""
    + " || ',' || ".join(f"CAST(sum(CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT)) AS VARCHAR)" for i in range(8))
    + """ || ',' || count(*)) AS input_hash, count(*) AS n_rows FROM r GROUP BY 1""",
)
def h15(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = X.table(spark, sf_dir, "lineitem").select("l_returnflag", "l_orderkey", "l_partkey", "l_linenumber", F.when(F.col("l_orderkey") % 7 != 0, F.col("l_quantity").cast("bigint")).alias("l_quantity"))
    return dc.table_hash(lines, keys=["l_returnflag"])


@query(
    "h16_research_gate",
    f"""WITH {_SCORE}, x AS (SELECT c.c_custkey AS order_id, max(struct_pack(tm := tm, k := k, nf := nf)) AS b FROM customer c LEFT JOIN sc ON symbol = c_custkey AND tm <= TIMESTAMP '1997-06-01' GROUP BY 1),
 v AS (SELECT o_custkey AS order_id, CASE WHEN o_custkey % 4 = 0 THEN min(o_orderkey) ELSE max(struct_pack(d := o_orderdate, k := o_orderkey)).k END AS version FROM orders WHERE o_orderdate <= TIMESTAMP '1997-06-01' GROUP BY 1),
 f AS (SELECT order_id, b.k IS NOT NULL AS "exists", coalesce(b.k = version, false) AS latest, coalesce(b.tm + INTERVAL 365 DAY > TIMESTAMP '1997-06-01', false) AS unexpired, coalesce(b.k % 3 <> 0, false) AS allowed, coalesce(b.nf = 0, false) AS quality FROM x LEFT JOIN v USING (order_id))
 SELECT *, "exists" AND latest AND unexpired AND allowed AND quality AS open FROM f""",
)
def h16(spark: SparkSession, sf_dir: str) -> DataFrame:
    cards = _cards(spark, sf_dir)
    scores = dc.research_score(cards)
    meta = cards.select("card_id", "symbol", "as_of", (F.col("as_of") + F.expr("interval 365 days")).alias("expires_at"), F.when(F.col("card_id") % 3 != 0, "ACTIVE").otherwise("DRAFT").alias("status"))
    bound = X.table(spark, sf_dir, "orders").where("o_orderdate <= TIMESTAMP '1997-06-01'").groupBy(F.col("o_custkey").alias("c_custkey"))
    bound = bound.agg(F.when(F.col("c_custkey") % 4 == 0, F.min("o_orderkey")).otherwise(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey"))).alias("version"))
    orders = X.table(spark, sf_dir, "customer").join(bound, "c_custkey", "left").select(F.col("c_custkey").alias("order_id"), F.col("c_custkey").alias("symbol"), F.lit("1997-06-01").cast("timestamp").alias("at"), "version")
    return dc.research_gate(orders, meta, scores, order_id="order_id", symbol="symbol", at="at", version="version")


@query(
    "h17_directory_snapshots",
    """WITH x AS (SELECT s_nationkey AS url, 'S' || (s_suppkey % 5) AS name, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS number FROM supplier)
 SELECT CAST(url AS BIGINT) AS url, CAST(v AS BIGINT) AS captured_at, CAST(number AS INT) AS number, name || CASE WHEN v = 2 THEN '-new' ELSE '' END AS name FROM x, (VALUES (0), (2)) t(v)""",
)
def h17(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation's supplier list captured four times; from the third on names are new."""
    s = X.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long").alias("url"), "s_suppkey", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("at"))
    name = F.concat(F.lit("S"), F.col("s_suppkey") % 5, F.when(F.col("at") >= 2, "-new").otherwise(""))
    row = F.concat(F.lit("<tr><td>"), F.lit("7"), F.lit("</td><td><a>"), name, F.lit("</a></td></tr>"))
    pages = s.groupBy("url", F.col("at").cast("long").alias("at")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", row.alias("r")))), lambda x: x["r"]), "").alias("html"))
    return dc.directory_snapshots(pages, url="url", at="at", html="html").drop("digest")
