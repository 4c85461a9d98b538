"""Tables in texts and from facts: columns' roles, fee rows, reconstruction and typing."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import tables as T
from factloom.queries.base import query

TEXT_TABLES = r"""lines AS (SELECT doc_id, r.i AS i, [trim(regexp_replace(x, '\s+', ' ', 'g')) for x in string_split(lines[r.i], ' | ')] AS cells FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents), unnest(range(1, len(lines) + 1)) r(i)),
rows_ AS (SELECT *, CASE WHEN lag(i) OVER (PARTITION BY doc_id ORDER BY i) = i - 1 THEN 0 ELSE 1 END AS opens FROM lines WHERE len(cells) >= 3),
t AS (SELECT doc_id, i, cells, sum(opens) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS table_no FROM rows_)"""

#: What a cell of each role looks like, in patterns that both engines read.
CELL_ROLES = {"head": "^[A-ZÀ-ÖØ-Þ]", "close": "[.,]$", "long": "^.{9,}$"}


@query(
    rf"""WITH {TEXT_TABLES}, h AS (SELECT doc_id, table_no, count(*) AS n FROM t GROUP BY ALL),
cell AS (SELECT doc_id, table_no, r.j AS j, cells[r.j] AS x FROM t, unnest(range(1, len(cells) + 1)) r(j)),
score AS (SELECT doc_id, table_no, role, j, (1000 * count(*) // any_value(n))::BIGINT AS s FROM cell JOIN h USING (doc_id, table_no), (VALUES ('head', '{CELL_ROLES["head"]}'), ('close', '{CELL_ROLES["close"]}'), ('long', '{CELL_ROLES["long"]}')) p(role, pattern) WHERE regexp_matches(x, pattern) GROUP BY doc_id, table_no, role, j
  UNION ALL SELECT doc_id, table_no, unnest(['head', 'close', 'long']), 1073741824, 0 FROM h),
way AS (SELECT a.doc_id, a.table_no, a.j AS a, b.j AS b, c.j AS c FROM score a JOIN score b USING (doc_id, table_no) JOIN score c USING (doc_id, table_no) WHERE a.role = 'head' AND b.role = 'close' AND c.role = 'long' AND (a.j <> b.j OR a.j > 1e9) AND (a.j <> c.j OR a.j > 1e9) AND (b.j <> c.j OR b.j > 1e9)
  QUALIFY row_number() OVER (PARTITION BY a.doc_id, a.table_no ORDER BY a.s + b.s + c.s DESC, a.j, b.j, c.j) = 1)
SELECT doc_id, table_no, unnest(['head', 'close', 'long']) AS role, unnest([a, b, c]) % 1073741824 AS at FROM way"""
)
def x06_column_roles(t):
    """X-06: the columns of the tables in texts, each with one role at most: of all assignments the one with the highest total."""
    roles = {name: (lambda p: lambda c: c.rlike(p))(pattern) for name, pattern in CELL_ROLES.items()}
    found = T.column_roles(T.text_tables(t("documents"), "doc_id", "text"), ["doc_id", "table_no"], roles)
    return found.select("doc_id", "table_no", "role", F.col("at").cast("long").alias("at"))


FEE_CELLS = """[CASE WHEN l_suppkey % 3 = 0 THEN '종류' || l_returnflag || l_linenumber ELSE '수수료' || CASE l_returnflag WHEN 'A' THEN '선취' WHEN 'N' THEN '후취' ELSE '미징구' END || '-온라인(C' || l_linenumber || ')' END,
 CASE WHEN l_linestatus = 'F' THEN '없음' ELSE '납입금액의 ' || l_discount || '% 이내' END, CAST(l_tax AS VARCHAR), CAST(l_discount AS VARCHAR), CASE WHEN l_quantity > 25 THEN CAST(l_tax AS VARCHAR) ELSE '-' END,
 CASE WHEN l_quantity > 12 THEN '1,' || CAST(100 + l_quantity::INT AS VARCHAR) ELSE CAST(l_tax AS VARCHAR) END, CAST(l_quantity::INT + 9 AS VARCHAR), CAST(l_extendedprice AS VARCHAR)]"""


def fee_cells():
    named = F.when(F.col("l_suppkey") % 3 == 0, F.concat(F.lit("종류"), "l_returnflag", F.col("l_linenumber").cast("string"))).otherwise(
        F.concat(F.lit("수수료"), F.when(F.col("l_returnflag") == "A", "선취").when(F.col("l_returnflag") == "N", "후취").otherwise("미징구"), F.lit("-온라인(C"), F.col("l_linenumber").cast("string"), F.lit(")"))
    )
    tax, discount, quantity = F.col("l_tax").cast("string"), F.col("l_discount").cast("string"), F.col("l_quantity").cast("int")
    return F.array(
        named, F.when(F.col("l_linestatus") == "F", "없음").otherwise(F.concat(F.lit("납입금액의 "), discount, F.lit("% 이내"))), tax, discount, F.when(F.col("l_quantity") > 25, tax).otherwise("-"),
        F.when(F.col("l_quantity") > 12, F.concat(F.lit("1,"), (quantity + 100).cast("string"))).otherwise(tax), (quantity + 9).cast("string"), F.format_string("%.2f", "l_extendedprice"),
    )


NUMERIC = r"regexp_matches(replace(x, ',', ''), '^-?\d+(\.\d+)?$')"
NAMES_CLASS = r"(regexp_matches(x, '^종류[A-Za-z]') OR (contains(x, '수수료') AND (regexp_matches(x, '\([A-Za-z][A-Za-z0-9-]*\)') OR regexp_matches(x, '선취|미징구|후취'))))"


FEE_ROWS = rf"""c AS (SELECT row_number() OVER () AS id, l_orderkey, l_linenumber, {FEE_CELLS} AS c FROM lineitem),
e AS (SELECT id, l_orderkey, l_linenumber, c[1] AS first, r.i AS i, c[r.i] AS x FROM c, unnest(range(2, len(c) + 1)) r(i)),
k AS (SELECT *, {NUMERIC} AS num, count(CASE WHEN {NUMERIC} THEN 1 END) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e),
s AS (SELECT *, min(CASE WHEN num AND TRY_CAST(replace(x, ',', '') AS DOUBLE) >= 10 AND NOT (before = 3 AND regexp_matches(x, '^\d,[0-9]{{3}}$')) THEN i END) OVER (PARTITION BY id) AS stop FROM k),
g AS (SELECT id, l_orderkey, l_linenumber, any_value(first) AS class_name, coalesce(arg_min(x, i) FILTER (NOT num AND NOT {NAMES_CLASS}), '') AS sales_charge,
 list(CASE WHEN before = 3 AND regexp_matches(x, '^\d,[0-9]{{3}}$') THEN replace(x, ',', '.') ELSE replace(x, ',', '') END ORDER BY i) FILTER (num) AS rates FROM s WHERE i < coalesce(stop, 99) GROUP BY id, l_orderkey, l_linenumber)"""


@query(
    f"""WITH {FEE_ROWS} SELECT l_orderkey, l_linenumber, class_name, sales_charge, rates[1] AS total_fee, rates[2] AS sales_fee, CASE WHEN len(rates) >= 4 THEN rates[3] ELSE '' END AS peer_fee, CASE WHEN len(rates) >= 4 THEN rates[4] ELSE rates[3] END AS total_expense FROM g WHERE len(rates) >= 3"""
)
def x04_fee_rows(t):
    """X-04: class, sales charge and rates of a fee row; a comma read for a decimal point is mended where the row would not fit otherwise, amounts of money end the rates."""
    rows = F.array_compact(F.array(T.fee_row(fee_cells())))  # a filter on the struct would build it once more
    return t("lineitem").select("l_orderkey", "l_linenumber", F.inline(rows))


def fact_rows():
    """A fee row, or for returns a performance row, of a line item."""
    rate = lambda c: F.format_string("%.2f", c)
    performance = F.array(
        F.when(F.col("l_linenumber") == 1, "비교지수").otherwise(F.concat(F.lit("종류"), "l_linestatus")), F.date_format("l_shipdate", "yyyy.MM.dd"), rate("l_tax"), F.when(F.col("l_discount") > 0.05, "-").otherwise(rate("l_discount")), rate("l_quantity")
    )
    return F.when(F.col("l_returnflag") == "R", performance).otherwise(fee_cells())


@query(
    f"""WITH {FEE_ROWS.replace("FROM lineitem)", "FROM lineitem WHERE l_returnflag <> 'R')")}, fee AS (SELECT l_orderkey, count(*) AS n_fees FROM g WHERE len(rates) >= 3 GROUP BY ALL),
r AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN '비교지수' ELSE '종류' || l_linestatus END AS subject, strftime(l_shipdate, '%Y-%m-%d') AS d, printf('%.2f', l_tax) AS tax, CASE WHEN l_discount > 0.05 THEN '-' ELSE printf('%.2f', l_discount) END AS discount, printf('%.2f', l_quantity) AS quantity FROM lineitem WHERE l_returnflag = 'R'),
p AS (SELECT l_orderkey, count(*) AS n, string_agg(subject || '@' || d || ':' || tax || ',' || replace(discount, '-', '') || ',' || quantity || ',,', ';' ORDER BY l_linenumber, subject, d, tax, discount, quantity) AS performance FROM r GROUP BY ALL)
SELECT l_orderkey, CASE WHEN n > 0 AND n_fees > 0 THEN 'fees+performance' WHEN n_fees > 0 THEN 'fees' WHEN n > 0 THEN 'performance' ELSE 'other' END AS kind, coalesce(n_fees, 0) AS n_fees, coalesce(performance, '') AS performance FROM (SELECT DISTINCT l_orderkey FROM lineitem) LEFT JOIN fee USING (l_orderkey) LEFT JOIN p USING (l_orderkey)"""
)
def x05_reconstructed(t):
    """X-05, X-06: an order's rows as one table, taken apart into fee and performance rows and typed; dates are no subjects, dashes keep their place."""
    rows = t("lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", fact_rows().alias("cells")))), lambda x: x["cells"]).alias("rows"))
    made = T.reconstructed(rows)
    lines = F.transform("performance", lambda p: F.concat(p["subject"], F.lit("@"), p["inception"], F.lit(":"), F.array_join(p["rates"], ",")))
    return made.select("l_orderkey", "kind", F.size("fees").cast("long").alias("n_fees"), F.array_join(lines, ";").alias("performance"))
