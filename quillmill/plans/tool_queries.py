"""Queries of the table, SQL and graph tools (survey sections D, K and L)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.operators import graph as K
from quillmill.operators import tools as X
from quillmill.plans.registry import core
from quillmill.session import table

COLUMNS = {
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate",
    "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment",
    "nation": "n_nationkey n_name n_regionkey",
    "region": "r_regionkey r_name",
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice",
    "supplier": "s_suppkey s_name s_nationkey s_acctbal",
}


def string_ctes(*names: str) -> str:
    """CTEs <table>_data with every column as a string."""
    return ", ".join(f"{n}_data as (select {', '.join(f'cast({c} as varchar) as {c}' for c in COLUMNS[n].split())} from {n})" for n in names)


def sql_tool(name: str, tables: tuple[str, ...], query: str) -> None:
    """Registers a query of the SQL tool: one text, run by Spark over string views and by DuckDB over the same."""
    head = "with " + string_ctes(*tables)
    oracle = f"{head}, {query[5:]}" if query.lower().startswith("with ") else f"{head} {query}"

    def run(spark: SparkSession, d: str) -> DataFrame:
        session = X.ToolSession(spark, {t: table(spark, d, t) for t in tables})
        for t in tables:
            session.load(t)
        return spark.sql(query)

    run.__doc__ = f"L3, A20: {name.removeprefix('sql_')} through the SQL tool."
    core.query(name, oracle)(run)


sql_tool(
    "sql_join",
    ("orders", "customer", "nation"),
    "select n_name, count(*) as orders, round(sum(try_cast(o_totalprice as double)), 2) as total from orders_data join customer_data on o_custkey = c_custkey join nation_data on c_nationkey = n_nationkey group by n_name",
)
sql_tool("sql_outer", ("customer", "orders"), "select c_custkey, count(o_orderkey) as orders from customer_data left join orders_data on c_custkey = o_custkey and o_orderstatus = 'F' group by c_custkey")
sql_tool("sql_full_outer", ("nation", "supplier"), "select coalesce(n_nationkey, s_nationkey) as nation, count(s_suppkey) as suppliers from nation_data full outer join supplier_data on n_nationkey = s_nationkey group by 1")
sql_tool(
    "sql_semi_anti",
    ("customer", "orders"),
    "select c_mktsegment, count(*) as n from customer_data where exists (select 1 from orders_data where o_custkey = c_custkey and o_orderpriority = '1-URGENT') and not exists (select 1 from orders_data where o_custkey = c_custkey and o_orderstatus = 'P') group by c_mktsegment",
)
sql_tool("sql_having", ("lineitem",), "select l_suppkey, count(distinct l_partkey) as parts, round(avg(try_cast(l_quantity as double)), 4) as quantity from lineitem_data group by l_suppkey having count(*) > 50")
sql_tool("sql_rollup", ("lineitem",), "select coalesce(l_returnflag, '-') as flag, coalesce(l_linestatus, '-') as status, count(*) as n from lineitem_data group by rollup (l_returnflag, l_linestatus)")
sql_tool("sql_cube", ("part",), "select coalesce(p_brand, '-') as brand, coalesce(p_size, '-') as size, count(*) as n from part_data group by cube (p_brand, p_size)")
sql_tool("sql_grouping_sets", ("orders",), "select coalesce(o_orderstatus, '-') as status, coalesce(o_orderpriority, '-') as priority, count(*) as n from orders_data group by grouping sets ((o_orderstatus), (o_orderpriority), ())")
sql_tool(
    "sql_window",
    ("orders",),
    "select o_orderkey, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as nth, lag(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) as previous, round(sum(try_cast(o_totalprice as double)) over (partition by o_custkey order by o_orderdate, o_orderkey rows between 2 preceding and current row), 2) as last_three from orders_data",
)
sql_tool(
    "sql_set_ops",
    ("customer", "supplier", "nation"),
    "(select c_nationkey as nation, 'both' as kind from customer_data intersect select s_nationkey, 'both' from supplier_data) union all (select n_nationkey, 'unused' from nation_data except select c_nationkey, 'unused' from customer_data)".replace("(select c_nationkey", "select * from ((select c_nationkey", 1) + ") u",
)
sql_tool(
    "sql_cte",
    ("lineitem", "orders"),
    "with late as (select l_orderkey, max(l_shipdate) as last_ship from lineitem_data group by l_orderkey), big as (select o_orderkey, o_orderdate from orders_data where try_cast(o_totalprice as double) > 200000) select o_orderkey, o_orderdate, last_ship from big join late on l_orderkey = o_orderkey",
)
sql_tool(
    "sql_correlated",
    ("part", "lineitem"),
    "select p_partkey, p_brand, (select count(*) from lineitem_data where l_partkey = p_partkey and l_returnflag = 'R') as returned from part_data where try_cast(p_size as int) > (select avg(try_cast(p_size as int)) from part_data)",
)
sql_tool("sql_order_text", ("orders",), "select o_orderkey, o_totalprice from orders_data where o_orderkey < '20' order by o_orderkey limit 25")
sql_tool(
    "sql_as_of",
    ("orders", "customer"),
    "with o as (select o_custkey, o_orderkey, o_orderdate from orders_data), p as (select a.o_orderkey, b.o_orderkey as before, row_number() over (partition by a.o_orderkey order by b.o_orderdate desc, b.o_orderkey desc) as r from o a join o b on a.o_custkey = b.o_custkey and b.o_orderdate < a.o_orderdate) select o_orderkey, before from p where r = 1",
)
sql_tool("sql_case_strings", ("part",), "select upper(substring(p_name, 1, 5)) as head, case when p_type like '%STEEL%' then 'steel' when p_type like '%BRASS%' then 'brass' else 'other' end as metal, count(*) as n from part_data group by 1, 2")


@core.query(
    "filter_db",
    f"with {string_ctes('orders')} select o_orderkey, o_totalprice from (select o_orderkey, o_totalprice, o_orderstatus, o_orderpriority, o_orderdate from orders_data) where o_orderstatus = 'O' and o_orderpriority >= '3' and o_orderdate < '1997-01-01' and o_custkey > '5'".replace(
        "o_orderstatus, o_orderpriority, o_orderdate from", "o_orderstatus, o_orderpriority, o_orderdate, o_custkey from"
    ).replace("select o_orderkey, o_totalprice from (", "select o_orderkey from ("),
)
def filter_db(spark: SparkSession, d: str) -> DataFrame:
    """String comparison, one filter for all conjuncts."""
    df = X.as_strings(table(spark, d, "orders"))
    return X.filter_columns(df, "o_orderstatus='O', o_orderpriority>=3, o_orderdate<\"1997-01-01\", o_custkey>5").select("o_orderkey")


@core.query("get_value", f"with {string_ctes('nation')} select string_agg(n_name, ', ' order by cast(n_nationkey as int)) as value from nation_data where n_regionkey = '2'")
def get_value(spark: SparkSession, d: str) -> DataFrame:
    """D2."""
    df = X.filter_columns(X.as_strings(table(spark, d, "nation")), "n_regionkey=2").withColumn("o", F.col("n_nationkey").cast("int"))
    return X.get_value(df, "n_name", "o")


@core.query("tool_dispatch")
def tool_dispatch(spark: SparkSession, d: str) -> DataFrame:
    """A session of actions with its observations, failures included."""
    s = X.ToolSession(spark, {"nation": table(spark, d, "nation"), "region": table(spark, d, "region")})
    acts = ["", "LoadDB[nation]", "FilterDB[n_regionkey=1]", "FilterDB[n_regionkey=9]", "FilterDB[nothing=1]", "GetValue[n_name]", "Calculate[(2+3)*4]", "SQLInterpreter[select count(*) as n from nation_data]", "SQLInterpreter[drop table nation_data]", "Jump[1]", "Finish[done]"]
    return spark.createDataFrame([(i, a, s.act(a)) for i, a in enumerate(acts)], "step int, action string, observation string")


# The graph: customers are linked with the parts that they ordered.
VERT = "v as (select 'c' || c_custkey as id, c_name as name, c_mktsegment as segment from customer union all select 'p' || p_partkey, p_name || ' ' || p_partkey, p_brand from part)"
EDGE = "ed as (select 'c' || o_custkey as src, 'p' || l_partkey as dst, list_sort(list(distinct 'c' || o_custkey)) as items from orders join lineitem on l_orderkey = o_orderkey group by 1, 2)"


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c, p = table(spark, d, "customer"), table(spark, d, "part")
    v = c.select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    v = v.unionByName(p.select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("name"), F.col("p_brand").alias("segment")))
    o = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    e = o.groupBy(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst")).agg(F.array_sort(F.collect_set(F.concat(F.lit("c"), "o_custkey"))).alias("items"))
    return v, e


@core.query("neighbours", f"with {VERT}, {EDGE}, b as (select src, dst from ed union all select dst, src from ed) select distinct x.name, y.name as neighbour from v x join b on b.src = x.id join v y on y.id = b.dst")
def neighbours(spark: SparkSession, d: str) -> DataFrame:
    """K2, K1: neighbours of every named vertex."""
    v, e = _graph(spark, d)
    return K.neighbours(e, v, v.select("name"))


@core.query("node_check", f"with {VERT} select id, name, segment from v where name = 'Customer#000000007' or name = (select min(name) from v)")
def node_check(spark: SparkSession, d: str) -> DataFrame:
    """K3."""
    v, _ = _graph(spark, d)
    first = v.agg(F.min("name").alias("name"))
    return K.node(v, "Customer#000000007").unionByName(v.join(first, "name", "left_semi").select("id", "name", "segment"))


@core.query(
    "edge_check",
    f"""with {VERT}, {EDGE}, pr as (select x.name as a, y.name as b, ed.items from ed join v x on x.id = ed.src join v y on y.id = ed.dst),
    t as (select a, b, unnest(items) as id, generate_subscripts(items, 1) as pos from pr) select a, b, string_agg(v.name, ', ' order by pos) as items from t join v using (id) group by 1, 2""",
)
def edge_check(spark: SparkSession, d: str) -> DataFrame:
    """The titled items of every edge."""
    v, e = _graph(spark, d)
    names = v.select("id", "name")
    pairs = e.join(names.select(F.col("id").alias("src"), F.col("name").alias("a")), "src").join(names.select(F.col("id").alias("dst"), F.col("name").alias("b")), "dst").select("a", "b")
    return K.edge(e, v, pairs)


@core.query("usable_authors", f"with {VERT}, {EDGE}, b as (select src, dst from ed union all select dst, src from ed) select id, count(distinct dst) as degree from v join b on b.src = v.id where segment is not null and name is not null group by 1")
def usable_authors(spark: SparkSession, d: str) -> DataFrame:
    """K5."""
    v, e = _graph(spark, d)
    return K.usable_vertices(e, v, "segment is not null and name is not null")
