"""Queries over sheets, one for each operator, and what DuckDB must find for them.

Sheets are made once from the test tables, in the order of their keys, and found again in the fixtures' folder.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures as X
from .functions import cells as E
from .operators import reader as R
from .plans.scan import Options
from .sources import sinks
from .sources.opc import Workbook
from .sources.writer import raw_xlsx, temporary
from .sources.xlsx import sheet
from .streaming.workbooks import drain, stream_sheet

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            SQL[key] = sql
        return f

    return add


def load(spark: SparkSession, path: str, **options) -> DataFrame:
    return sheet(spark, path, Options(**options))[0]


# ---- scans ----

INTS = {
    "region": "r_regionkey", "nation": "n_nationkey n_regionkey", "customer": "c_nationkey", "supplier": "s_nationkey", "part": "p_size", "orders": "", "lineitem": "l_linenumber l_quantity",
    "events": "", "pages": "", "documents": "",
}
#: Columns of the table as the sheet gives them back: whole numbers are 64-bit, times are to the millisecond.
SELECT = {t: "* REPLACE (" + ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in cs.split()) + ")" if cs else "*" for t, cs in INTS.items()}
SELECT["events"] = "* REPLACE (date_trunc('milliseconds', ts) AS ts)"


def _scan(table: str) -> None:
    @query(f"SELECT {SELECT[table]} FROM {table}", f"scan_{table}")
    def scan(spark: SparkSession, sf_dir: str) -> DataFrame:
        return load(spark, X.workbook(spark, sf_dir, table))


for _t in INTS:
    _scan(_t)


@query(f"SELECT {SELECT['lineitem']} FROM lineitem")
def scan_seven_splits(spark, sf_dir):
    """The rows don't depend on where the sheet is cut."""
    return load(spark, X.workbook(spark, sf_dir, "lineitem"), splits=7)


@query("SELECT l_orderkey, l_shipdate FROM lineitem")
def scan_columns(spark, sf_dir):
    return load(spark, X.workbook(spark, sf_dir, "lineitem"), columns=["l_orderkey", "l_shipdate"])


@query("SELECT r_name, count(*) AS n FROM region GROUP BY r_name")
def scan_format_api(spark, sf_dir):
    """spark.read.format("xlsx") by itself, planned by the source."""
    from .sources.xlsx import register

    register(spark)
    return spark.read.format("xlsx").option("sheetName", "region").load(X.workbook(spark, sf_dir, "nation", "region")).groupBy("r_name").agg(F.count("*").alias("n"))


# ---- sheets ----

@query(f"SELECT {SELECT['region']} FROM region")
def sheet_by_name(spark, sf_dir):
    return load(spark, X.workbook(spark, sf_dir, "nation", "region"), sheet_name="region")


@query(f"SELECT {SELECT['region']} FROM region")
def sheet_by_idx(spark, sf_dir):
    return load(spark, X.workbook(spark, sf_dir, "nation", "region"), sheet_idx=1)


@query(f"SELECT {SELECT['nation']} FROM nation")
def sheet_default(spark, sf_dir):
    return load(spark, X.workbook(spark, sf_dir, "nation", "region"))


@query(f"SELECT {SELECT['nation']} FROM nation")
def sheet_name_beats_idx(spark, sf_dir):
    return load(spark, X.workbook(spark, sf_dir, "nation", "region"), sheet_name="nation", sheet_idx=1)


@query("SELECT * FROM (VALUES (0, 'nation'), (1, 'region')) AS v(idx, name)")
def sheet_names(spark, sf_dir):
    return spark.createDataFrame(list(enumerate(Workbook.open(X.workbook(spark, sf_dir, "nation", "region")).sheet_names())), "idx int, name string")


@query(f"SELECT {SELECT['region']} FROM region")
def select_sheet(spark, sf_dir):
    return R.read_xlsx(X.workbook(spark, sf_dir, "nation", "region"), spark=spark).select_sheet("region").df


# ---- header, skipped rows, batches ----

@query("SELECT CAST(n_nationkey AS BIGINT) AS col_0, n_name AS col_1, CAST(n_regionkey AS BIGINT) AS col_2 FROM nation")
def no_header(spark, sf_dir):
    return load(spark, X.workbook(spark, sf_dir, "nation", header=False), header=False)


@query("SELECT 'n_nationkey' AS col_0, 'n_name' AS col_1, 'n_regionkey' AS col_2 UNION ALL SELECT CAST(n_nationkey AS VARCHAR), n_name, CAST(n_regionkey AS VARCHAR) FROM nation")
def no_header_mixed(spark, sf_dir):
    return load(spark, X.workbook(spark, sf_dir, "nation"), header=False)


_ORDERED = "SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders"


@query(f"SELECT o_orderkey, o_custkey FROM ({_ORDERED}) WHERE rn NOT IN (1, 2, 5, 100)")
def skip_rows(spark, sf_dir):
    return load(spark, X.workbook(spark, sf_dir, "orders"), skip_rows=[1, 2, 5, 100]).select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey, o_custkey FROM orders")
def skip_header_noop(spark, sf_dir):
    return load(spark, X.workbook(spark, sf_dir, "orders"), skip_rows=[0]).select("o_orderkey", "o_custkey")


@query("SELECT CAST(n_nationkey AS BIGINT) AS col_0, n_name AS col_1 FROM nation WHERE n_nationkey NOT IN (0, 3)")
def skip_rows_no_header(spark, sf_dir):
    return load(spark, X.workbook(spark, sf_dir, "nation", header=False), header=False, skip_rows=[0, 3]).select("col_0", "col_1")


@query(f"SELECT (rn - 1) // 700 AS batch, count(*) AS n, min(o_orderkey) AS first, max(o_orderkey) AS last FROM ({_ORDERED}) GROUP BY 1")
def batch_sizes(spark, sf_dir):
    df = load(spark, X.workbook(spark, sf_dir, "orders"), batch_size=700, metadata=True, splits=3)
    return df.groupBy(F.col("_batch_id").alias("batch")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"))


@query("SELECT CAST(ceil(count(*) / 700.0) AS BIGINT) AS n_batches FROM orders")
def batch_count(spark, sf_dir):
    return R.count_batches(load(spark, X.workbook(spark, sf_dir, "orders"), batch_size=700, metadata=True))


@query("SELECT CAST(ceil((count(*) - 2) / 7.0) AS BIGINT) AS n_batches FROM nation")
def batch_count_skip(spark, sf_dir):
    r = R.read_xlsx(X.workbook(spark, sf_dir, "nation"), 7, skip_rows=[2, 4], spark=spark)
    return spark.createDataFrame([(len(r),)], "n_batches long")


@query(f"SELECT o_orderkey, (rn - 1) // 50 AS batch FROM ({_ORDERED}) WHERE rn <= 500")
def batch_preview(spark, sf_dir):
    df = R.preview(load(spark, X.workbook(spark, sf_dir, "orders"), batch_size=50, metadata=True), 10)
    return df.select("o_orderkey", F.col("_batch_id").alias("batch"))


@query("SELECT count(*) AS n, sum(n_nationkey) AS total FROM nation")
def batch_iteration(spark, sf_dir):
    """The iterator's batches, summed up one by one."""
    n = total = 0
    for batch in R.read_xlsx(X.workbook(spark, sf_dir, "nation"), 10, spark=spark):
        n, total = n + batch.num_rows, total + sum(batch.column("n_nationkey").to_pylist())
    return spark.createDataFrame([(n, total)], "n long, total long")


@query("SELECT 1 AS n_batches, count(*) AS n, sum(c_custkey) AS keys, count(DISTINCT c_name) AS names, round(sum(c_acctbal), 2) AS balance FROM customer")
def whole_sheet_batch(spark, sf_dir):
    """Without a batch size the iterator gives the sheet as one batch, which the caller holds."""
    batches = list(R.read_xlsx(X.workbook(spark, sf_dir, "customer"), None, spark=spark, splits=3))
    t = batches[0].select(["c_custkey", "c_name", "c_acctbal"])
    row = (len(batches), t.num_rows, pc.sum(t["c_custkey"]).as_py(), pc.count_distinct(t["c_name"]).as_py(), round(pc.sum(t["c_acctbal"]).as_py(), 2))
    return spark.createDataFrame([row], "n_batches int, n long, keys long, names long, balance double")


@query(f"SELECT (rn - 1) // 700 AS batch, count(*) AS n, min(o_orderkey) AS first, max(o_orderkey) AS last FROM ({_ORDERED}) GROUP BY 1")
def batch_tables(spark, sf_dir):
    """The sheet's batches as tables, each summed up by itself in a task: they end where they should, across splits."""

    def sums(i: int, b: pa.Table) -> pa.Table:
        first, last = pc.min_max(b["o_orderkey"]).as_py().values()
        return pa.table({"batch": pa.array([i]), "n": pa.array([b.num_rows]), "first": pa.array([first], pa.int64()), "last": pa.array([last], pa.int64())})

    return R.read_xlsx(X.workbook(spark, sf_dir, "orders"), 700, spark=spark, splits=3).map_batches(sums, "batch long, n long, first long, last long")


@query("SELECT CAST(row_number() OVER (ORDER BY o_orderkey) AS BIGINT) AS sheet_row, CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS BIGINT) AS ord, o_orderkey FROM orders")
def row_numbers(spark, sf_dir):
    return load(spark, X.workbook(spark, sf_dir, "orders"), metadata=True, splits=5).select(F.col("_row").alias("sheet_row"), F.col("_ord").alias("ord"), "o_orderkey")


# ---- types ----

@query("""SELECT * FROM (VALUES ('l_orderkey', 'bigint'), ('l_partkey', 'bigint'), ('l_suppkey', 'bigint'), ('l_linenumber', 'bigint'), ('l_quantity', 'bigint'), ('l_extendedprice', 'double'),
('l_discount', 'double'), ('l_tax', 'double'), ('l_returnflag', 'string'), ('l_linestatus', 'string'), ('l_shipdate', 'timestamp_ntz')) AS v(name, type)""")
def inferred_types(spark, sf_dir):
    df = load(spark, X.workbook(spark, sf_dir, "lineitem"))
    return spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in df.schema.fields], "name string, type string")


_WIDENING = '<row r="1"><c r="A1" t="inlineStr"><is><t>a</t></is></c><c r="B1" t="inlineStr"><is><t>b</t></is></c></row>' + "".join(
    f'<row r="{i + 2}"><c r="A{i + 2}"><v>{v}</v></c>' + (f'<c r="B{i + 2}" t="b"><v>1</v></c>' if i > 1 else "") + "</row>" for i, v in enumerate(["1", "2", "3.5", "4", "x", "6"])
)


@query("SELECT * FROM (VALUES ('a', 0, 'long'), ('a', 1, 'double'), ('a', 2, 'string'), ('b', 1, 'boolean'), ('b', 2, 'boolean')) AS v(name, batch, type)")
def inferred_types_by_batch(spark, sf_dir):
    df = load(spark, X.micro("widening", {"Sheet1": _WIDENING}), mode="cells").where("row > 0").withColumn("ord", F.col("row") - 1)
    out = R.types_by_batch(df, 2)
    return out.select(F.when(F.col("col") == 0, "a").otherwise("b").alias("name"), F.col("batch").cast("int").alias("batch"), "type")


@query("""SELECT 0 AS row, i AS col, 'string' AS kind, n AS value FROM (VALUES (0, 'n_nationkey'), (1, 'n_name'), (2, 'n_regionkey')) AS v(i, n)
UNION ALL SELECT n_nationkey + 1, 0, 'int', CAST(n_nationkey AS VARCHAR) FROM nation UNION ALL SELECT n_nationkey + 1, 1, 'string', n_name FROM nation UNION ALL SELECT n_nationkey + 1, 2, 'int', CAST(n_regionkey AS VARCHAR) FROM nation""")
def cells_long(spark, sf_dir):
    return load(spark, X.workbook(spark, sf_dir, "nation"), mode="cells").select(F.col("row").cast("int").alias("row"), "col", "kind", "value")


@query("SELECT o_orderkey, o_orderdate, year(o_orderdate) AS y, month(o_orderdate) AS m FROM orders")
def date_columns(spark, sf_dir):
    return load(spark, X.workbook(spark, sf_dir, "orders")).select("o_orderkey", "o_orderdate", F.year("o_orderdate").cast("long").alias("y"), F.month("o_orderdate").cast("long").alias("m"))


_STYLES = '<styleSheet><numFmts><numFmt numFmtId="164" formatCode="yyyy-mm-dd"/><numFmt numFmtId="165" formatCode="0.00"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="164"/><xf numFmtId="14"/><xf numFmtId="165"/></cellXfs></styleSheet>'
_head = lambda *names: '<row r="1">' + "".join(f'<c r="{chr(65 + i)}1" t="inlineStr"{s}><is><t>{n}</t></is></c>' for i, (n, s) in enumerate(names)) + "</row>"


@query("SELECT * FROM (VALUES (45000, TIMESTAMP '2023-03-15 00:00:00', 1), (45001, TIMESTAMP '2023-03-16 12:00:00', 2)) AS v(locked, free, n)")
def date_lock_header(spark, sf_dir):
    """A styled header fixes its column: `locked` has date styles below a bold header and stays a number."""
    rows = _head(("locked", ' s="0"'), ("free", ""), ("n", ""))
    rows += '<row r="2"><c r="A2" s="1"><v>45000</v></c><c r="B2" s="1"><v>45000</v></c><c r="C2"><v>1</v></c></row><row r="3"><c r="A3" s="1"><v>45001</v></c><c r="B3"><v>45001.5</v></c><c r="C3"><v>2</v></c></row>'
    return load(spark, X.micro("lock", {"Sheet1": rows}, styles=_STYLES)).select(F.col("locked").cast("int").alias("locked"), "free", F.col("n").cast("int").alias("n"))


@query("SELECT * FROM (VALUES (TIMESTAMP '2023-03-15 00:00:00', 1), (TIMESTAMP '2023-03-16 00:00:00', 2)) AS v(locked, n)")
def date_detection_by_cell(spark, sf_dir):
    rows = _head(("locked", ' s="0"'), ("n", "")) + '<row r="2"><c r="A2" s="1"><v>45000</v></c><c r="B2"><v>1</v></c></row><row r="3"><c r="A3" s="2"><v>45001</v></c><c r="B3"><v>2</v></c></row>'
    return load(spark, X.micro("bycell", {"Sheet1": rows}, styles=_STYLES), date_detection="cell").select("locked", F.col("n").cast("int").alias("n"))


# ---- functions ----

@query("""SELECT i, TIMESTAMP '1970-01-01' + to_milliseconds(CAST((floor(s) + CASE WHEN floor(s) > 60 THEN -25569 WHEN floor(s) >= 1 THEN -25568 ELSE -25569 END) * 86400000 + round((s - trunc(s)) * 86400000) AS BIGINT)) AS ts
FROM (SELECT i, i * 7.25 - 0.5 AS s FROM range(0, 9000) AS r(i))""")
def serial_to_ts(spark, sf_dir):
    return spark.range(9000).select(F.col("id").alias("i"), E.serial_to_timestamp(F.col("id") * 7.25 - 0.5).alias("ts"))


@query("""SELECT i, CASE WHEN i = 60 THEN 1900 ELSE year(t) END AS y, CASE WHEN i = 60 THEN 2 ELSE month(t) END AS m, CASE WHEN i = 60 THEN 29 ELSE day(t) END AS d, hour(t) AS h, minute(t) AS mi, second(t) AS s
FROM (SELECT i, TIMESTAMP '1899-12-30' + to_days(CAST(CASE WHEN i > 60 THEN i WHEN i >= 1 THEN i + 1 ELSE i END AS INTEGER)) + to_milliseconds(21610000) AS t FROM range(1, 3000) AS r(i))""")
def serial_parts(spark, sf_dir):
    """Serials a quarter of a day and ten seconds into each day, by calendar part."""
    df = spark.range(1, 3000).withColumn("p", E.serial_parts(F.col("id") + F.lit(21610.0) / 86400))
    return df.select(F.col("id").alias("i"), *(F.col(f"p.{a}").cast("long").alias(b) for a, b in (("year", "y"), ("month", "m"), ("day", "d"), ("hour", "h"), ("minute", "mi"), ("second", "s"))))


@query("SELECT n_nationkey AS k, CAST(n_nationkey AS VARCHAR) AS a, CASE WHEN n_nationkey > 4 THEN 'true' ELSE 'false' END AS b, '' AS c FROM nation")
def value_as_text(spark, sf_dir):
    k = F.col("n_nationkey")
    return load(spark, X.workbook(spark, sf_dir, "nation")).select(k.cast("int").alias("k"), E.as_text(k).alias("a"), E.as_text(k > 4).alias("b"), E.as_text(F.lit(None)).alias("c"))


@query("SELECT * FROM (VALUES (0, false), (1, true), (2, true), (3, false)) AS v(style, is_date)")
def style_dates(spark, sf_dir):
    """The cell styles of a workbook and whether they show dates."""
    book = Workbook.open(X.micro("styles", {"Sheet1": _head(("a", ""))}, styles=_STYLES))
    return spark.createDataFrame(list(enumerate(book.date_styles())), "style int, is_date boolean")


@query("SELECT * FROM (VALUES (0, 'A', 'xl/worksheets/sheet1.xml'), (1, 'R&D', 'xl/worksheets/sheet2.xml')) AS v(idx, name, part)")
def relationships(spark, sf_dir):
    """Sheets and the parts that their relationships lead to; a hidden sheet is a sheet."""
    book = '<workbook xmlns:r="r"><sheets><sheet name="A" sheetId="1" r:id="rId1"/><sheet name="R&amp;D" sheetId="2" state="hidden" r:id="rId2"/><sheet name="lost" sheetId="3" r:id="rId9"/></sheets></workbook>'
    rels = '<Relationships><Relationship Id="rId1" Target="/xl/worksheets/sheet1.xml"/><Relationship Id="rId2" Target="worksheets/sheet2.xml"/></Relationships>'
    found = Workbook.open(X.micro("rels", {"A": "", "B": ""}, workbook=book, rels=rels))
    return spark.createDataFrame([(i, n, p) for i, (n, p) in enumerate(found.sheets)], "idx int, name string, part string")


_CODES = ["yyyy-mm-dd", "[$-409]d-mmm-yy", "0.00", "#,##0", '"USD"', "mm:ss.000", "General", "HH:MM", "@", "[Red]@"]


@query("SELECT code, regexp_matches(lower(code), '[ymdhs]') AND NOT regexp_matches(code, '[0#]') AS is_date FROM (VALUES {}) AS v(code)".format(", ".join(f"('{c}')" for c in _CODES)))
def format_is_date(spark, sf_dir):
    df = spark.createDataFrame([(c,) for c in _CODES], "code string")
    return df.select("code", E.is_date_code(F.col("code")).alias("is_date"))


@query("SELECT id, id BETWEEN 14 AND 22 OR id BETWEEN 45 AND 47 OR id IN (164, 170) AS is_date FROM range(0, 200) AS r(id)")
def numfmt_is_date(spark, sf_dir):
    return spark.range(200).select("id", E.is_date_id(F.col("id"), [164, 170]).alias("is_date"))


_REFS = [("A1", 0, 0), ("Z10", 9, 25), ("AA1", 0, 26), ("xfd1048576", 1048575, 16383), ("7", 6, 0), ("C", 0, 2), ("BC23", 22, 54)]


@query("SELECT * FROM (VALUES {}) AS v(ref, row, col)".format(", ".join(map(str, _REFS))))
def a1_parse(spark, sf_dir):
    df = spark.createDataFrame([(r,) for r, *_ in _REFS], "ref string")
    return df.select("ref", E.a1_row(F.col("ref")).alias("row"), E.a1_column(F.col("ref")).alias("col"))


@query("SELECT * FROM (VALUES ('A1', 0, 0, 0, 0), ('A1:G10', 0, 0, 9, 6), ('B2:AA30', 1, 1, 29, 26), ('A1:B2:C3', NULL, NULL, NULL, NULL)) AS v(ref, start_row, start_col, end_row, end_col)")
def dimension_parse(spark, sf_dir):
    df = spark.createDataFrame([("A1",), ("A1:G10",), ("B2:AA30",), ("A1:B2:C3",)], "ref string")
    return df.withColumn("d", E.dimension(F.col("ref"))).select("ref", "d.*")


_RAW = [
    ("5", "", "int", 5, None), ("+5", "", "int", 5, None), ("-7", "n", "int", -7, None), ("1.0", "", "float", None, 1.0), ("1E5", "", "float", None, 100000.0), (".5", "", "float", None, 0.5), ("9223372036854775808", "", "float", None, 9.223372036854775808e18),
    (" 5 ", "", "string", None, None), ("5d", "", "string", None, None), ("", "", "string", None, None), ("0", "b", "bool", None, None), ("7", "b", "bool", None, None), ("#N/A", "e", "error", None, None), ("x", "str", "string", None, None), ("2024-01-02", "d", "iso", None, None),
]


@query("SELECT * FROM (VALUES {}) AS v(text, t, kind, i, f)".format(", ".join("({})".format(", ".join("NULL" if x is None else repr(x) for x in r)) for r in _RAW)))
def raw_value_parse(spark, sf_dir):
    df = spark.createDataFrame([r[:2] for r in _RAW], "text string, t string").withColumn("v", E.raw_value(F.col("text"), F.col("t")))
    return df.select("text", "t", "v.kind", F.col("v.int").cast("int").alias("i"), F.col("v.float").alias("f"))


# ---- hand-written sheets ----

@query("SELECT * FROM (VALUES (1, NULL), (2, NULL)) AS v(k, e)")
def errors_to_null(spark, sf_dir):
    rows = _head(("k", ""), ("e", "")) + '<row r="2"><c r="A2"><v>1</v></c><c r="B2" t="e"><v>#DIV/0!</v></c></row><row r="3"><c r="A3"><v>2</v></c><c r="B3" t="e"><v>#FOO!</v></c></row>'
    return load(spark, X.micro("errors", {"Sheet1": rows})).select(F.col("k").cast("int").alias("k"), F.col("e").cast("int").alias("e"))


@query("SELECT * FROM (VALUES (1, false), (2, true), (3, true), (4, true)) AS v(k, b)")
def bools(spark, sf_dir):
    rows = _head(("k", ""), ("b", "")) + "".join(f'<row r="{i}"><c r="A{i}"><v>{i - 1}</v></c><c r="B{i}" t="b"><v>{v}</v></c></row>' for i, v in enumerate(["0", "1", "true", ""], 2))
    return load(spark, X.micro("bools", {"Sheet1": rows})).select(F.col("k").cast("int").alias("k"), "b")


@query("SELECT * FROM (VALUES ('2024-01-02T03:04:05')) AS v(d)")
def iso_dates(spark, sf_dir):
    return load(spark, X.micro("iso", {"Sheet1": _head(("d", "")) + '<row r="2"><c r="A2" t="d"><v>2024-01-02T03:04:05</v></c></row>'}))


@query("SELECT * FROM (VALUES (1, 'ab'), (2, 'x&y'), (3, NULL), (4, 'zz'), (5, 'inline')) AS v(k, s)")
def shared_string_oob(spark, sf_dir):
    """Rich runs, entities, an index beyond the table, text in place of an index, and an inline string."""
    cell = ['t="s"><v>0</v>', 't="s"><v>1</v>', 't="s"><v>99</v>', 't="s"><v>zz</v>', 't="inlineStr"><is><r><t>in</t></r><r><t>line</t></r></is>']
    rows = _head(("k", ""), ("s", "")) + "".join(f'<row r="{i}"><c r="A{i}"><v>{i - 1}</v></c><c r="B{i}" {v}</c></row>' for i, v in enumerate(cell, 2))
    strings = "<sst><si><r><t>a</t></r><r><t>b</t></r></si><si><t>x&amp;y</t></si></sst>"
    return load(spark, X.micro("strings", {"Sheet1": rows}, strings=strings)).select(F.col("k").cast("int").alias("k"), "s")


@query("SELECT * FROM (VALUES (1, NULL, 3), (NULL, 5, NULL), (NULL, NULL, NULL)) AS v(a, b, c)")
def sparse_rows(spark, sf_dir):
    rows = _head(("a", ""), ("b", ""), ("c", "")) + '<row r="2"><c r="A2"><v>1</v></c><c r="C2"><v>3</v></c></row><row r="5"><c r="B5"><v>5</v></c></row><row r="6"><c r="A6" s="1"/></row>'
    return load(spark, X.micro("sparse", {"Sheet1": rows})).select(*(F.col(c).cast("int").alias(c) for c in "abc"))


@query("SELECT * FROM (VALUES (1, 2, 3, 4)) AS v(\"Unknown_0\", b, \"Unknown_2\", d)")
def header_gaps(spark, sf_dir):
    rows = '<row r="3"><c r="B3" t="inlineStr"><is><t>b</t></is></c><c r="D3" t="inlineStr"><is><t>d</t></is></c></row><row r="4"><c r="A4"><v>1</v></c><c r="B4"><v>2</v></c><c r="C4"><v>3</v></c><c r="D4"><v>4</v></c></row>'
    df = load(spark, X.micro("gaps", {"Sheet1": rows}))
    return df.select(*(F.col(c).cast("int").alias(c) for c in df.columns))


@query("SELECT * FROM (VALUES (1, 2, NULL), (3, 4, 5)) AS v(a, b, \"Unknown_2\")")
def wide_rows(spark, sf_dir):
    rows = _head(("a", ""), ("b", "")) + '<row r="2"><c r="A2"><v>1</v></c><c r="B2"><v>2</v></c></row><row r="3"><c r="A3"><v>3</v></c><c r="B3"><v>4</v></c><c r="C3"><v>5</v></c></row>'
    df = load(spark, X.micro("wide", {"Sheet1": rows}))
    return df.select(*(F.col(c).cast("int").alias(c) for c in df.columns))


# ---- sinks, generator, stream ----

@query(f"SELECT {SELECT['customer']} FROM customer")
def csv_roundtrip(spark, sf_dir):
    df = load(spark, X.workbook(spark, sf_dir, "customer"))
    return spark.read.schema(df.schema).csv(sinks.write_csv(df, f"{temporary()}/customer"), header=True)


@query(f"SELECT {SELECT['orders']} FROM orders")
def parquet_roundtrip(spark, sf_dir):
    return spark.read.parquet(sinks.write_parquet(load(spark, X.workbook(spark, sf_dir, "orders")), f"{temporary()}/orders"))


@query(f"SELECT {SELECT['supplier']} FROM supplier")
def workbook_roundtrip(spark, sf_dir):
    df = load(spark, X.workbook(spark, sf_dir, "supplier"))
    return load(spark, sinks.write_workbook(df, f"{temporary()}/supplier.xlsx"))


@query("SELECT 500 AS n, true AS ints, true AS floats, true AS texts, true AS times, true AS some_empty, 9 AS width")
def generator_shape(spark, sf_dir):
    df = load(spark, X.generate(f"{temporary()}/generated.xlsx", 500, 9))
    ok = lambda c: F.expr(f"coalesce(bool_and({c}), false)")
    return df.agg(
        F.count("*").cast("int").alias("n"), ok("Int between -1000000 and 999999").alias("ints"), ok("abs(Float) <= 1e6").alias("floats"), ok("String rlike '^row_[0-9]+_rnd[0-9]+$' and Unknown_8 is not null").alias("texts"),
        ok("year(DateTime) between 2000 and 2024 and DurationIso like 'PT%S'").alias("times"), F.expr("count(Empty) between 150 and 350").alias("some_empty"), F.lit(len(df.columns)).alias("width"),
    )


_streams = iter(range(1 << 30))


@query(f"SELECT {SELECT['orders']} FROM orders")
def stream_available_now(spark, sf_dir):
    return drain(stream_sheet(spark, X.workbook(spark, sf_dir, "orders"), splits=3), f"sheet_{next(_streams)}")


@query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation UNION ALL SELECT CAST(n_nationkey AS BIGINT), n_name, CAST(n_regionkey AS BIGINT) FROM nation")
def scan_directory(spark, sf_dir):
    """All workbooks of a directory as one table."""
    import shutil

    place = temporary()
    for i in range(2):
        shutil.copy(X.workbook(spark, sf_dir, "nation"), f"{place}/{i}.xlsx")
    return load(spark, place)


def _named(folder: str, name: str, cells: list[tuple]) -> None:
    """A workbook in folder: columns k, n, v; a text is a text, None no cell, other values numbers."""
    head = "".join(f'<c r="{c}1" t="str"><v>{h}</v></c>' for c, h in zip("ABC", "knv", strict=True))
    cell = lambda c, r, x: "" if x is None else f'<c r="{c}{r}" t="str"><v>{x}</v></c>' if isinstance(x, str) else f'<c r="{c}{r}"><v>{x}</v></c>'
    rows = "".join(f'<row r="{r}">{"".join(cell(c, r, x) for c, x in zip("ABC", xs, strict=True))}</row>' for r, xs in enumerate(cells, 2))
    raw_xlsx(f"{folder}/{name}.xlsx", {"Sheet1": f'<worksheet><sheetData><row r="1">{head}</row>{rows}</sheetData></worksheet>'})


@query("SELECT * FROM (VALUES (CAST(1 AS BIGINT), CAST(1 AS DOUBLE), '7'), (2, 2, '8'), (3, 2.5, 'x'), (4, NULL, NULL)) AS t(k, n, v)")
def scan_directory_mixed_types(spark, sf_dir):
    """Types join over the files of a directory: whole numbers with others, numbers with texts, and nothing with anything."""
    folder = temporary()
    _named(folder, "a", [(1, 1, 7), (2, 2, 8)])
    _named(folder, "b", [(3, 2.5, "x")])
    _named(folder, "c", [(4, None, None)])
    return load(spark, folder)


@query("SELECT * FROM (VALUES (CAST(1 AS BIGINT), CAST(10 AS BIGINT), 'm'), (2, 20, 'm'), (3, 30, 'b'), (4, 40, 'b'), (5, 50, 'z')) AS t(k, n, v)")
def stream_late_file(spark, sf_dir):
    """A stream over a directory, stopped and started again: a file that appears later is read once, also if its name comes first."""
    folder, out = temporary(), temporary()
    files = {"m": [(1, 10, "m"), (2, 20, "m")], "b": [(3, 30, "b"), (4, 40, "b")], "z": [(5, 50, "z")]}
    for name, cells in files.items():
        _named(folder, name, cells)
        stream = stream_sheet(spark, folder, "k long, n long, v string")
        stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/rows")


_Q1 = """SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS BIGINT) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price,
round(avg(l_quantity), 4) AS avg_qty, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus"""


@query(_Q1)
def flagship_pricing_summary(spark, sf_dir):
    df = load(spark, X.workbook(spark, sf_dir, "lineitem"), columns=["l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_discount", "l_shipdate"])
    return df.where("l_shipdate <= timestamp_ntz '1998-09-02'").groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base_price"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc_price"),
        F.round(F.avg("l_quantity"), 4).alias("avg_qty"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("count_order"),
    )


@query("SELECT r_name, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def sheets_joined(spark, sf_dir):
    """Sheets are tables: what Spark can do with those, it can do with sheets."""
    for t in ("orders", "customer", "nation", "region"):
        load(spark, X.workbook(spark, sf_dir, t)).createOrReplaceTempView(f"sheet_{t}")
    return spark.sql("SELECT r_name, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM sheet_orders JOIN sheet_customer ON o_custkey = c_custkey JOIN sheet_nation ON c_nationkey = n_nationkey JOIN sheet_region ON n_regionkey = r_regionkey GROUP BY r_name")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
