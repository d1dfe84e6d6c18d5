"""Market shapes as views over the star-schema test tables.

Each function has a SQL twin of the same columns in SQL_VIEWS, which the oracle queries start from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with its order: symbol, eff (ship date), known (order date) and the rest."""
    lines = table(spark, sf_dir, "lineitem").withColumn("eff", F.to_date("l_shipdate"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.to_date("o_orderdate").alias("known"))
    return lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).withColumn("symbol", F.col("l_suppkey"))


def _exact_sum(column: str):
    """The sum of cents, the same in whatever order they are added."""
    return F.sum(F.col(column).cast("decimal(18,2)")).cast("double")


def _exact_mean(column: str):
    """The mean of values of two decimals, the same in whatever order they are added: one that is half a unit of the last digit kept rounds up."""
    return _exact_sum(column) / F.count(column)


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, d, open, high, low, close, volume, amount: one bar for each supplier and ship date."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("symbol"), F.to_date("l_shipdate").alias("d"), "l_quantity", "l_extendedprice", (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))
    made = lines.groupBy("symbol", "d").agg(
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.round(_exact_sum("l_extendedprice") / F.sum("l_quantity"), 4).alias("close"),
        F.sum("l_quantity").cast("long").alias("volume"),
        _exact_sum("l_extendedprice").alias("amount"),
    )
    return made.select("symbol", "d", F.round((F.col("high") + F.col("low")) / 2, 4).alias("open"), F.round("high", 4).alias("high"), F.round("low", 4).alias("low"), "close", "volume", "amount")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, eff, known, value: unique by the first three."""
    return shipped(spark, sf_dir).groupBy("symbol", "eff", "known").agg(F.round(F.sum("l_extendedprice"), 2).alias("value"))


def cash_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, ex_date, known, kind, cash."""
    rows = shipped(spark, sf_dir).where("l_returnflag = 'R'")
    kind = F.when(F.col("l_linestatus") == "O", "SPECIAL").otherwise("ORDINARY")
    return rows.groupBy("symbol", F.col("eff").alias("ex_date"), "known", kind.alias("kind")).agg(F.round(F.sum("l_tax"), 4).alias("cash"))


def fiscal_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, fiscal_year, total, known: a year is known once its last order is."""
    return shipped(spark, sf_dir).groupBy("symbol", F.year("eff").alias("fiscal_year")).agg(F.round(F.sum("l_tax"), 4).alias("total"), F.max("known").alias("known"))


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bank, tenor (3 or 5), rate, start, end, known, minimum, product."""
    supplier, part = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "part")
    rows = shipped(spark, sf_dir).where("known <= eff").join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(
        F.col("s_nationkey").cast("long").alias("bank"),
        (3 + 2 * (F.col("p_size") % 2)).cast("long").alias("tenor"),
        F.round(0.01 + F.col("l_discount") / 4, 6).alias("rate"),
        F.col("known").alias("start"),
        F.col("eff").alias("end"),
        "known",
        F.when(F.col("l_quantity") > 5, F.col("l_quantity") * 1000).alias("minimum"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_extendedprice").cast("decimal(18,2)")).alias("product"),
    )


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """account, seq, d, side, quantity, price: each order is a fill; even keys buy."""
    quantity = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").cast("long").alias("quantity"))
    orders = table(spark, sf_dir, "orders")
    rows = orders.join(quantity, orders["o_orderkey"] == quantity["l_orderkey"])
    return rows.select(
        F.col("o_custkey").alias("account"),
        F.col("o_orderkey").alias("seq"),
        F.to_date("o_orderdate").alias("d"),
        F.when(F.col("o_orderkey") % 2 == 0, "BUY").otherwise("SELL").alias("side"),
        "quantity",
        F.round(F.col("o_totalprice") / F.col("quantity"), 2).alias("price"),
    )


def nav(spark: SparkSession, sf_dir: str) -> DataFrame:
    """account, seq, d, equity, flow_in, flow_out: an order adds to equity if finished, else it is a flow."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("account"), F.col("o_orderkey").alias("seq"), F.to_date("o_orderdate").alias("d"), "o_orderstatus", "o_totalprice")
    order = Window.partitionBy("account").orderBy("d", "seq")
    gain = F.when(F.col("o_orderstatus") == "F", -F.floor(F.col("o_totalprice") / 2).cast("double")).when(F.col("o_orderstatus") == "O", F.col("o_totalprice")).otherwise(F.lit(0.0))
    flow = F.when(F.col("o_orderstatus") == "P", F.col("o_totalprice")).otherwise(F.lit(0.0))
    return o.select(
        "account",
        "seq",
        "d",
        F.round(1e6 + F.sum(gain + flow).over(order), 2).alias("equity"),
        F.round(F.when(F.row_number().over(order) == 1, 1e6).otherwise(0.0) + flow, 2).alias("flow_in"),
    )


def cross_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each part and year with the fields of a universe row; as_of is the year."""
    lines = table(spark, sf_dir, "lineitem").withColumn("as_of", F.year("l_shipdate").cast("long"))
    sums = lines.groupBy("l_partkey", "as_of").agg(
        _exact_sum("l_extendedprice").alias("amount"),
        F.round(_exact_mean("l_quantity"), 4).alias("turnover"),
        F.round(_exact_mean("l_discount"), 4).alias("momentum20"),
        F.round(_exact_mean("l_tax"), 4).alias("momentum60"),
        F.round(F.max("l_extendedprice") - F.min("l_extendedprice"), 2).alias("volatility"),
        F.count("*").alias("history_days"),
    )
    part = table(spark, sf_dir, "part")
    rows = sums.join(part, sums["l_partkey"] == part["p_partkey"])
    size = F.col("p_size")
    return rows.select(
        F.col("p_partkey").alias("symbol"),
        "as_of",
        F.col("p_brand").alias("industry"),
        F.when(size % 17 == 0, "FUND").otherwise("STOCK").alias("asset_type"),
        F.when(size % 13 == 0, "D").when(size % 2 == 0, "A").otherwise("B").alias("data_quality"),
        F.when(size % 19 == 0, "SUSPENDED").otherwise("TRADING").alias("trading_status"),
        F.when(size % 23 == 0, "ST").otherwise("NORMAL").alias("risk_status"),
        "history_days",
        F.when(size % 29 != 0, F.col("p_retailprice")).alias("last_price"),
        "amount",
        "turnover",
        F.when(size % 5 != 0, F.col("p_retailprice") / 100).alias("roe"),
        F.when(size % 7 != 0, F.col("turnover") / 10).alias("cash_ratio"),
        (F.col("p_retailprice") / 50 - 22).alias("pe"),
        F.when(size % 11 != 0, F.col("p_retailprice") / 900).alias("pb"),
        "momentum20",
        "momentum60",
        F.round(F.col("momentum20") - 0.05, 4).alias("relative20"),
        "volatility",
        F.when(size % 3 != 0, size * 2.0).alias("catalyst"),
        F.when(size % 4 != 0, 100.0 - size).alias("risk"),
    )


def rnd(sql: str, n: int) -> str:
    """SQL that rounds a double as Spark's round() does: half up on its shortest decimal form."""
    return f"CAST(round(CAST(CAST({sql} AS VARCHAR) AS DECIMAL(38, 20)), {n}) AS DOUBLE)"


_EXACT = "CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE)"


def _mean(column: str) -> str:
    return f"CAST(sum(CAST({column} AS DECIMAL(18,2))) AS DOUBLE) / count({column})"


#: The same views in SQL.
SQL_VIEWS = {
    "shipped": """SELECT l.*, l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS eff, CAST(o_orderdate AS DATE) AS known, o_custkey, o_orderstatus
        FROM lineitem l JOIN orders ON l_orderkey = o_orderkey""",
    "bars": f"""SELECT symbol, d, {rnd("(high + low) / 2", 4)} AS open, {rnd("high", 4)} AS high, {rnd("low", 4)} AS low, close, volume, amount
        FROM (SELECT l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS d, max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
        {rnd(_EXACT + ' / sum(l_quantity)', 4)} AS close, CAST(sum(l_quantity) AS BIGINT) AS volume, {_EXACT} AS amount
        FROM lineitem GROUP BY 1, 2)""",
    "facts": "SELECT symbol, eff, known, round(sum(l_extendedprice), 2) AS value FROM shipped GROUP BY 1, 2, 3",
    "cash_events": """SELECT symbol, eff AS ex_date, known, CASE WHEN l_linestatus = 'O' THEN 'SPECIAL' ELSE 'ORDINARY' END AS kind, round(sum(l_tax), 4) AS cash
        FROM shipped WHERE l_returnflag = 'R' GROUP BY 1, 2, 3, 4""",
    "fiscal_years": "SELECT symbol, year(eff) AS fiscal_year, round(sum(l_tax), 4) AS total, max(known) AS known FROM shipped GROUP BY 1, 2",
    "rates": """SELECT CAST(s_nationkey AS BIGINT) AS bank, CAST(3 + 2 * (p_size % 2) AS BIGINT) AS tenor, round(0.01 + l_discount / 4, 6) AS rate, known AS start, eff AS "end", known,
        CASE WHEN l_quantity > 5 THEN l_quantity * 1000 END AS minimum,
        concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_extendedprice AS DECIMAL(18,2))) AS product
        FROM shipped JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey WHERE known <= eff""",
    "fills": f"""SELECT o_custkey AS account, o_orderkey AS seq, CAST(o_orderdate AS DATE) AS d, CASE WHEN o_orderkey % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side, quantity,
        {rnd('o_totalprice / quantity', 2)} AS price
        FROM orders JOIN (SELECT l_orderkey, CAST(sum(l_quantity) AS BIGINT) AS quantity FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey""",
    "nav": """SELECT account, seq, d, round(1e6 + sum(gain + flow) OVER w, 2) AS equity, round(CASE WHEN row_number() OVER w = 1 THEN 1e6 ELSE 0.0 END + flow, 2) AS flow_in
        FROM (SELECT o_custkey AS account, o_orderkey AS seq, CAST(o_orderdate AS DATE) AS d,
        CASE o_orderstatus WHEN 'F' THEN -floor(o_totalprice / 2) WHEN 'O' THEN o_totalprice ELSE 0.0 END AS gain, CASE o_orderstatus WHEN 'P' THEN o_totalprice ELSE 0.0 END AS flow FROM orders)
        WINDOW w AS (PARTITION BY account ORDER BY d, seq)""",
    "cross_section": f"""SELECT p_partkey AS symbol, as_of, p_brand AS industry, CASE WHEN p_size % 17 = 0 THEN 'FUND' ELSE 'STOCK' END AS asset_type,
        CASE WHEN p_size % 13 = 0 THEN 'D' WHEN p_size % 2 = 0 THEN 'A' ELSE 'B' END AS data_quality, CASE WHEN p_size % 19 = 0 THEN 'SUSPENDED' ELSE 'TRADING' END AS trading_status,
        CASE WHEN p_size % 23 = 0 THEN 'ST' ELSE 'NORMAL' END AS risk_status, history_days, CASE WHEN p_size % 29 <> 0 THEN p_retailprice END AS last_price, amount, turnover,
        CASE WHEN p_size % 5 <> 0 THEN p_retailprice / 100 END AS roe, CASE WHEN p_size % 7 <> 0 THEN turnover / 10 END AS cash_ratio, p_retailprice / 50 - 22 AS pe,
        CASE WHEN p_size % 11 <> 0 THEN p_retailprice / 900 END AS pb, momentum20, momentum60, round(momentum20 - 0.05, 4) AS relative20, volatility,
        CASE WHEN p_size % 3 <> 0 THEN CAST(p_size * 2.0 AS DOUBLE) END AS catalyst, CASE WHEN p_size % 4 <> 0 THEN CAST(100.0 - p_size AS DOUBLE) END AS risk
        FROM (SELECT l_partkey, CAST(year(l_shipdate) AS BIGINT) AS as_of, {_EXACT} AS amount, {rnd(_mean('l_quantity'), 4)} AS turnover, {rnd(_mean('l_discount'), 4)} AS momentum20,
        {rnd(_mean('l_tax'), 4)} AS momentum60, round(max(l_extendedprice) - min(l_extendedprice), 2) AS volatility, count(*) AS history_days FROM lineitem GROUP BY 1, 2)
        JOIN part ON l_partkey = p_partkey""",
}


def with_views(*names: str) -> str:
    """A WITH clause of the named views and those they start from."""
    needs = {"facts": ["shipped"], "cash_events": ["shipped"], "fiscal_years": ["shipped"], "rates": ["shipped"]}
    ordered = dict.fromkeys(x for n in names for x in [*needs.get(n, []), n])
    return "WITH " + ", ".join(f"{n} AS ({SQL_VIEWS[n]})" for n in ordered)
