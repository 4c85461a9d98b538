"""Tables found in texts and pages: runs of rows, wrapped rows, columns' roles, fee, performance and risk rows.

A table is an array of rows, a row an array of cells. All rules are folds and filters over such arrays, so a table is read where it lies: only the lines
of a text are put together, by their document.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the domain: words that head a table, sales charges that are none, names that are no subject of a performance row.
HEADER_WORDS = ["투자비용", "클래스종류", "종류", "구분", "투자자가부담하는수수료"]
NO_SALES_CHARGE = ["-", "없음", "해당없음", "해당사항없음"]
NO_SUBJECT = ["연평균수익률", "단위:%", "단위%)", "(연평균", "최초설정일"]
NO_SUBJECT_WHOLE = ["종류", "투자비용", "투자실적", "투자실적추이"]
CHANNELS = ["수수료", "오프라인", "온라인", "퇴직", "종류"]
#: Syllables of which every name of a share class has one, and every head of a risk table: cells without are not read any further.
CLASS_SIGNS, RISK_SIGNS = ["수", "종", "라", "퇴"], ["구", "위"]
RISK_NAME_HEADS = ["구분", "세부구분", "위험구분", "투자위험구분"]
RISK_TEXT_HEADS = ["주요투자위험내용", "위험의주요내용"]
FEE_CLASS = r"수수료(선취|후취|미징구)(?:-?(오프라인|온라인슈퍼|온라인|직판))?.*?-?(퇴직연금|개인연금)?.*?\(([A-Za-z][A-Za-z0-9\-]*)\)"
KIND_CLASS = r"종류([A-Za-z][A-Za-z0-9\-]*)"
GOES_ON = r"^[-–]?(오프라인|온라인|직판|퇴직연금|퇴직|연금|슈퍼)?.{0,24}\([A-Za-z0-9\-]+\)$|^[-–]?(오프라인|온라인슈퍼|온라인|직판|퇴직연금|개인연금|퇴직|연금|슈퍼)$"
FEE_FIELDS = ["class_name", "sales_charge", "total_fee", "sales_fee", "peer_fee", "total_expense"]
PERIODS = ["1Y", "2Y", "3Y", "5Y", "SI"]
#: A number from which on a cell of a fee row is an amount of money and no rate.
AMOUNT = 10


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once. A column that is named in several places is otherwise built as often, and nested rules grow without bound."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def clean(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def compact(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+", "")


def without_commas(c: Column) -> Column:
    return F.replace(c, F.lit(","), F.lit(""))


def is_number(c: Column) -> Column:
    return without_commas(c).rlike(r"^-?\d+(\.\d+)?$")


def number(c: Column) -> Column:
    """The value of a numeric cell, null for others."""
    return F.when(is_number(c), without_commas(c).try_cast("double"))


def is_date(c: Column) -> Column:
    return c.rlike(r"^(\d{4}|\d{2})[-/.]\d{1,2}[-/.]\d{1,2}$")


def iso_date(c: Column) -> Column:
    """``25.1.3`` and ``2025/1/3`` with dashes and four digits of the year."""
    plain = F.regexp_replace(c, "[./]", "-")
    return F.when(plain.rlike(r"^\d{2}-"), F.concat(F.lit("20"), plain)).otherwise(plain)


def is_sales_charge(c: Column) -> Column:
    return compact(c).isin(NO_SALES_CHARGE) | c.contains("납입")


def _any(c: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(w) for w in words])


def is_class(c: Column) -> Column:
    """A cell that names a share class."""

    def named(x: Column) -> Column:
        code, fee = r"\([A-Za-z][A-Za-z0-9\-]*\)", x.contains("수수료")
        named = (fee & x.rlike(code)) | x.rlike(r"^종류[A-Za-z]") | (x.rlike(code + "$") & _any(x, CHANNELS)) | (fee & _any(x, ["선취", "미징구", "후취"]))
        return (x != "") & ~x.isin(HEADER_WORDS) & ~x.startswith("투자자") & (F.length(x) <= 80) & named

    return F.when(_any(c, CLASS_SIGNS), let(compact(c), named)).otherwise(c.isNull() & F.lit(None))


def class_name(cells: Column) -> Column:
    """The share class that the cells of a row spell together, in its regular form; null if none."""

    def named(blob: Column) -> Column:
        part = lambda i: F.regexp_extract(blob, FEE_CLASS, i)
        dashed = lambda p: let(p, lambda x: F.when(x != "", F.concat(F.lit("-"), x)).otherwise(""))
        fee = lambda code: F.concat(F.lit("수수료"), part(1), dashed(part(2)), dashed(part(3)), F.lit("("), code, F.lit(")"))
        return F.when(blob.contains("수수료"), let(part(4), lambda code: F.when(code != "", fee(code))))

    kind = lambda c: F.regexp_extract(compact(c), KIND_CLASS, 1)
    kinds = F.filter(F.transform(F.filter(cells, lambda c: c.contains("종")), kind), lambda k: k != "")  # within a cell: a number beside it is no part of it
    return F.coalesce(let(compact(F.array_join(cells, "")), named), F.concat(F.lit("종류"), F.get(kinds, F.lit(0))))


def _filled(cells: Column) -> Column:
    return F.filter(F.transform(cells, clean), lambda c: c != "")


def _tail(cells: Column, start: int = 2) -> Column:
    return F.slice(cells, start, F.greatest(F.size(cells), F.lit(1)))


def fee_row(cells: Column) -> Column:
    """A struct of ``FEE_FIELDS`` from the cells of a fee row, null if it is none.

    A row has a class and three or four rates. Once three rates are read, a cell like ``1,807`` would not fit as an amount: it is a rate whose decimal point
    was read as a comma. Any other number of ``AMOUNT`` or more begins the examples in money, which are left out.
    """
    def numbers(cells: Column) -> Column:
        """The numeric cells: their place, the rate that they state, and whether they begin the examples."""
        known = F.transform(cells, lambda c, i: F.struct(i.alias("at"), c.alias("cell"), without_commas(c).alias("rate"), is_number(c).alias("is")))
        return F.transform(F.filter(known, lambda x: x["is"]), rated)

    def rated(x: Column, i: Column) -> Column:
        comma = (i == 3) & x["cell"].rlike(r"^\d,[0-9]{3}$")
        return F.struct(x["at"].alias("at"), F.when(comma, F.replace(x["cell"], F.lit(","), F.lit("."))).otherwise(x["rate"]).alias("rate"), (~comma & (x["rate"].try_cast("double") >= AMOUNT)).alias("ends"))

    def read(name: Column, cells: Column, found: Column) -> Column:
        """Rates and words before the examples, and the name, which a cell may state if the row's first cells do not."""
        ends = F.coalesce(F.array_position(F.transform(found, lambda x: x["ends"]), F.lit(True)), F.lit(0)).cast("int")
        cut = F.struct(F.when(ends > 0, F.get(found, ends - 1)["at"]).otherwise(F.size(cells)).alias("end"), F.when(ends > 0, ends - 1).otherwise(F.size(found)).alias("n"))
        return let(cut, lambda c: let(F.transform(F.slice(found, F.lit(1), c["n"]), lambda x: x["rate"]), lambda rates: F.when(F.size(rates) >= 3, let(words(cells, found, c), lambda w: spoken(name, w, rates)))))

    def words(cells: Column, found: Column, cut: Column) -> Column:
        places = F.transform(found, lambda x: x["at"])
        told = F.filter(F.transform(F.slice(cells, F.lit(1), cut["end"]), lambda c, i: F.struct(i.alias("at"), c.alias("cell"))), lambda x: ~F.array_contains(places, x["at"]))
        return F.transform(told, lambda x: F.struct(x["at"].alias("at"), x["cell"].alias("cell"), is_class(x["cell"]).alias("named")))

    def spoken(name: Column, told: Column, rates: Column) -> Column:
        names = F.when(~is_class(name), F.get(F.filter(told, lambda x: x["named"]), F.lit(0)))
        return let(names, lambda n: let(F.struct(F.coalesce(n["cell"], name).alias("name"), sales(told, n).alias("sales"), rates.alias("rates")), made))

    def sales(told: Column, n: Column) -> Column:
        return F.coalesce(F.get(F.filter(told, lambda x: ~x["at"].eqNullSafe(n["at"]) & (~x["named"] | is_sales_charge(x["cell"]))), F.lit(0))["cell"], F.lit(""))

    def made(read: Column) -> Column:
        rate, name, four = (lambda i: F.get(read["rates"], F.lit(i))), read["name"], F.size(read["rates"]) >= 4
        right = name.contains("수수료") | name.startswith("종류") | is_class(name) | (compact(name) == "투자신탁")
        fields = [name, read["sales"], rate(0), rate(1), F.when(four, rate(2)).otherwise(""), F.when(four, rate(3)).otherwise(rate(2))]
        return F.when(right, F.struct(*[v.alias(n) for n, v in zip(FEE_FIELDS, fields)]))

    def parsed(values: Column) -> Column:
        barred = F.exists(values, lambda x: is_date(x) | x.contains("비교지수") | x.contains("변동성"))
        first = F.coalesce(class_name(values), F.get(values, F.lit(0)))
        return F.when((F.size(values) > 0) & ~barred, let(_tail(values), lambda cells: let(numbers(cells), lambda found: F.when(F.size(found) >= 3, let(first, lambda name: read(name, cells, found))))))

    headless = lambda v: F.when(compact(F.get(v, F.lit(0))).isin(HEADER_WORDS), _tail(v)).otherwise(v)
    shorter = lambda v: F.when((F.length(F.get(v, F.lit(0))) > 80) & (F.size(v) > 1), _tail(v)).otherwise(v)
    return let(let(let(_filled(cells), shorter), headless), parsed)


def performance_row(cells: Column) -> Column:
    """``subject, inception, rates`` (one for each of ``PERIODS``, empty if not stated) from the cells of a performance row, null if it is none.

    The subject is a share class, the fund, its benchmark or its volatility. Dashes and blanks between rates keep their place.
    """
    def trimmed(c: Column) -> Column:
        last = F.array_max(F.transform(c, lambda x, i: F.when(x != "", i + 1).otherwise(0)))
        return F.slice(c, F.lit(1), F.coalesce(last, F.lit(0)))

    def shaped(c: Column) -> Column:
        part = F.struct(F.coalesce(F.get(c, F.lit(0)), F.lit("")).alias("head"), F.coalesce(F.get(c, F.lit(1)), F.lit("")).alias("second"), F.array_join(c, " ").alias("joined"), c.alias("c"))
        return F.when(F.size(c) > 0, let(part, chosen))

    def chosen(p: Column) -> Column:
        c, head, second, joined = p["c"], p["head"], p["second"], p["joined"]
        index = lambda x: x.contains("비교지수") | x.contains("변동성")
        subject = is_class(head) | head.startswith("종류") | compact(head).isin("투자신탁", "펀드") | is_class(second)
        row = F.exists(c, is_number) & ~joined.contains("납입금액") & ~joined.contains("이내") & ~is_date(head) & ~((F.size(c) >= 2) & is_sales_charge(second)) & (index(joined) | F.exists(c, is_date) | subject)
        titled = head.isin("투자실적추이", "(연평균수익률)", "(단위:%)", "투자비용", "종류", "최초설정일")
        second_named = (titled & index(second)) | (~titled & compact(head).rlike(r"^[A-Za-z][A-Za-z0-9\-]*$") & (is_class(second) | second.contains("수수료")))
        trend = ~titled & ~second_named & head.startswith("투자실적") & joined.contains("비교지수")
        rest = F.when(second_named, _tail(c, 3)).when(trend, F.filter(c, lambda x: ~x.contains("투자실적") & ~x.contains("연평균") & (x != "비교지수"))).otherwise(_tail(c))
        picked = F.struct(F.when(second_named, second).when(trend, "비교지수").otherwise(head).alias("name"), rest.alias("rest"))
        return F.when(row & ~(titled & ~second_named), let(picked, read_on))

    def read_on(p: Column) -> Column:
        x, name = compact(p["name"]), p["name"]
        skipped = (_any(x, NO_SUBJECT) | x.isin(NO_SUBJECT_WHOLE)) & ~name.contains("비교지수") & ~name.contains("변동성")
        start = F.struct(F.lit("").alias("inception"), F.array().cast("array<string>").alias("rates"))
        subject = F.coalesce(class_name(F.concat(F.array(name), F.filter(p["rest"], lambda y: y != ""))), name)
        return F.when(~skipped, let(F.aggregate(p["rest"], start, fold), lambda r: made(subject, r)))

    def fold(at: Column, cell: Column) -> Column:
        dates = is_date(cell) & (at["inception"] == "")
        lead = (cell == "") & (F.size(at["rates"]) == 0) & (at["inception"] == "")  # the place of a date that is not stated
        rate = F.when(~dates & is_number(cell), F.regexp_replace(cell, ",", "")).when(~dates & cell.isin("-", "–", "—", "") & ~lead, "")
        more = F.when(rate.isNotNull(), F.array(rate)).otherwise(F.array().cast("array<string>"))
        return F.struct(F.when(dates, iso_date(cell)).otherwise(at["inception"]).alias("inception"), F.concat(at["rates"], more).alias("rates"))

    def made(subject: Column, r: Column) -> Column:
        periods = F.array(*[F.coalesce(F.get(r["rates"], F.lit(i)), F.lit("")) for i in range(len(PERIODS))])
        return F.when(F.exists(r["rates"], lambda x: x != ""), F.struct(subject.alias("subject"), r["inception"].alias("inception"), periods.alias("rates")))

    return let(let(F.transform(cells, clean), trimmed), shaped)


def unwrapped(rows: Column) -> Column:
    """Rows without empty cells, where what a class name goes on with in a row below is put back to it."""

    def fold(done: Column, row: Column) -> Column:
        one, last = F.get(row, F.lit(0)), F.element_at(done, F.lit(-1))
        part = F.struct(one.alias("one"), F.regexp_replace(compact(one), "–", "-").alias("x"), F.get(last, F.lit(0)).alias("name"), last.alias("last"))
        return F.when(F.size(done) == 0, F.array(row)).otherwise(let(part, lambda p: joined(done, row, p)))

    def joined(done: Column, row: Column, p: Column) -> Column:
        one, name = p["one"], p["name"]
        goes = p["x"].rlike(GOES_ON) & ~is_number(p["x"])
        alone = (F.size(row) == 1) & (goes | name.endswith("-"))
        within = ~name.contains("(") & name.contains("수수료") & goes
        joint = F.when(name.endswith("-") | one.startswith("-"), F.concat(F.regexp_replace(name, "-+$", ""), F.when(one.startswith("-"), one).otherwise(F.concat(F.lit("-"), one)))).otherwise(F.concat(name, one))
        grown = F.concat(F.array(joint), _tail(p["last"]), F.when(alone, F.array().cast("array<string>")).otherwise(_tail(row)))
        return F.when(alone | within, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(grown))).otherwise(F.concat(done, F.array(row)))

    full = F.filter(F.transform(rows, _filled), lambda r: F.size(r) > 0)
    return F.aggregate(full, F.array().cast("array<array<string>>"), fold)


def _risk_role(cell: Column) -> Column:
    def role(x: Column) -> Column:
        return F.when(x.isin(RISK_NAME_HEADS), "name").when((x.contains("투자위험") & x.contains("주요내용")) | x.isin(RISK_TEXT_HEADS), "text").otherwise("")

    return F.when(_any(cell, RISK_SIGNS), let(F.regexp_replace(cell, "[^가-힣A-Za-z0-9]", ""), role)).otherwise("")


def risk_rows(rows: Column) -> Column:
    """``name, text`` of the risks of a table whose head names both columns; null for other tables.

    Names and texts are two streams: a name may be wrapped over rows until it says a risk and does not end in a conjunction; a text goes on where no
    name stands beside it. So a wrapped name shifts no text.
    """
    blank = F.array().cast("array<string>")
    role = lambda cells, which: F.array_position(F.transform(cells, _risk_role), F.lit(which))
    is_head = lambda cells: (role(cells, "name") > 0) & (role(cells, "text") > 0)

    def complete(parts: Column) -> Column:
        return let(F.regexp_replace(compact(F.array_join(parts, " ")), "[.,;:：]+$", ""), lambda x: x.contains("위험") & ~x.rlike("(및|또는|/|·|,)$"))

    def flushed(names: Column, parts: Column) -> Column:
        return F.when(complete(parts), F.concat(names, F.array(clean(F.array_join(parts, " "))))).otherwise(names)

    def fold(state: Column, row: Column) -> Column:
        part = F.struct(row["again"].alias("again"), row["name"].alias("name"), row["text"].alias("text"), F.array_join(F.filter(row["cells"], lambda c: c != ""), " ").alias("all"), (row["again"] | ((row["name"] != "") & complete(state["open"]))).alias("ends"))
        return F.when(F.exists(row["cells"], lambda c: c != ""), let(part, lambda p: opened(state, p))).otherwise(state)

    def opened(state: Column, p: Column) -> Column:
        names = F.when(p["ends"], flushed(state["names"], state["open"])).otherwise(state["names"])
        more = F.when(~p["again"] & (p["name"] != ""), F.array(p["name"])).otherwise(blank)
        parts = F.concat(F.when(p["ends"], blank).otherwise(state["open"]), more)
        part = F.struct(names.alias("names"), parts.alias("open"), (~p["again"] & (p["name"] != "") & complete(parts)).alias("full"))
        return let(part, lambda n: written(state["texts"], p, n))

    def written(texts: Column, p: Column, n: Column) -> Column:
        starts = (p["text"] != "") & ((p["name"] != "") | (F.size(texts) == 0))
        goes = F.when(p["text"] != "", p["text"]).when(p["name"] == "", p["all"]).otherwise("")
        grown = F.concat(F.slice(texts, F.lit(1), F.size(texts) - 1), F.array(F.concat_ws(" ", F.element_at(texts, F.lit(-1)), goes)))
        after = F.when(p["again"], texts).when(starts, F.concat(texts, F.array(p["text"]))).when((goes != "") & (F.size(texts) > 0), grown).otherwise(texts)
        return F.struct(F.when(n["full"], flushed(n["names"], n["open"])).otherwise(n["names"]).alias("names"), after.alias("texts"), F.when(n["full"], blank).otherwise(n["open"]).alias("open"))

    def made(read: Column) -> Column:
        zipped = F.arrays_zip(flushed(read["names"], read["open"]).alias("name"), read["texts"].alias("text"))
        return let(F.filter(zipped, lambda p: p["name"].isNotNull() & p["text"].isNotNull() & (p["name"] != "") & (p["text"] != "")), lambda both: F.when(F.size(both) > 0, both))

    def below(at: Column) -> Column:
        cell = lambda r, i: F.coalesce(F.get(r, (i - 1).cast("int")), F.lit(""))
        body = F.transform(
            F.slice(at["rows"], at["head"] + 1, F.greatest(F.size(at["rows"]) - at["head"], F.lit(0))),
            lambda r: F.struct(r.alias("cells"), is_head(r).alias("again"), cell(r, at["name"]).alias("name"), cell(r, at["text"]).alias("text")),
        )
        return F.when(at["head"] > 0, let(F.aggregate(body, F.struct(blank.alias("names"), blank.alias("texts"), blank.alias("open")), fold), made))

    def headed(clear: Column) -> Column:
        head = F.array_position(F.transform(clear, is_head), F.lit(True)).cast("int")
        return let(head, lambda h: let(F.struct(clear.alias("rows"), h.alias("head"), role(F.get(clear, h - 1), "name").alias("name"), role(F.get(clear, h - 1), "text").alias("text")), below))

    return let(F.transform(rows, lambda r: F.transform(r, clean)), headed)


def reconstructed(tables: DataFrame, rows: str = "rows") -> DataFrame:
    """``tables`` with ``kind`` (risk, fees, performance, fees+performance, other), ``fees``, ``performance``, ``risks`` (arrays; null or empty if none), and for
    tables that none could be built from ``headers`` and the rows below them (``body``), typed by the words of their headers."""
    t = tables.withColumn("risks", risk_rows(F.col(rows))).withColumn("_flat", unwrapped(F.col(rows)))
    found = lambda f: F.filter(F.transform("_flat", f), lambda x: x.isNotNull())
    t = t.withColumns({"fees": F.when(F.col("risks").isNull(), found(fee_row)), "performance": F.when(F.col("risks").isNull(), found(performance_row))})
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    head = F.coalesce(F.get("_flat", F.lit(0)), F.array().cast("array<string>"))
    blob = F.array_join(head, "")
    by_head = F.when(blob.contains("총보수"), "fees").when(blob.contains("최근") & blob.contains("1년"), "performance").otherwise("other")
    kind = F.when(F.col("risks").isNotNull(), "risk").when(some("fees") & some("performance"), "fees+performance").when(some("fees"), "fees").when(some("performance"), "performance").otherwise(by_head)
    t = t.withColumn("kind", kind)
    plain = ~(some("risks") | some("fees") | some("performance"))
    return t.withColumns({"headers": F.when(plain, head), "body": F.when(plain, _tail(F.col("_flat")))}).drop("_flat")


def text_tables(docs: DataFrame, doc_id: str, text: str, separator: str = " | ", least: int = 3) -> DataFrame:
    """``doc_id, table_no, row_no, cells`` (from 1): lines of ``least`` cells or more; neighbouring ones are one table. A null text has none."""
    lines = docs.select(doc_id, F.posexplode(F.split(text, "\n")).alias("_i", "_line"))
    cells = F.split("_line", "\\Q" + separator + "\\E", -1)
    rows = lines.select(doc_id, "_i", F.transform(cells, clean).alias("cells")).where(F.size("cells") >= least)
    w = Window.partitionBy(doc_id).orderBy("_i")
    opens = (F.coalesce(F.lag("_i").over(w), F.lit(-9)) + 1 != F.col("_i")).cast("long")
    rows = rows.withColumn("_opens", opens).withColumn("table_no", F.sum("_opens").over(w))
    first = F.min("_i").over(Window.partitionBy(doc_id, "table_no"))
    return rows.select(doc_id, "table_no", (F.col("_i") - first + 1).cast("long").alias("row_no"), "cells")


def assigned(scores: Column, roles: int) -> Column:
    """The column of each of ``roles`` roles (from 1; 0: none), one column for one role at most, with the highest total score; the first columns on ties.

    ``scores``: for each role an array of the columns' scores (long, not negative). Of a role's columns no more than its ``roles`` best can matter, as the
    other roles take fewer than that; all their combinations are compared.
    """
    none = F.struct(F.lit(0).cast("long").alias("less"), F.lit(1 << 30).alias("at"))
    start = F.array(F.struct(F.lit(0).cast("long").alias("less"), F.array().cast("array<int>").alias("at")))

    def best(r: int) -> Column:
        each = F.transform(F.get(scores, F.lit(r)), lambda s, i: F.struct((-s).cast("long").alias("less"), (i + 1).cast("int").alias("at")))
        return F.concat(F.slice(F.array_sort(F.filter(each, lambda e: e["less"] < 0)), 1, roles), F.array(none))

    def extended(done: Column, columns: Column) -> Column:
        fits = lambda p: F.filter(columns, lambda c: (c["at"] == 1 << 30) | ~F.array_contains(p["at"], c["at"]))
        return F.flatten(F.transform(done, lambda p: F.transform(fits(p), lambda c: F.struct((p["less"] + c["less"]).alias("less"), F.concat(p["at"], F.array(c["at"])).alias("at")))))

    ways = reduce(lambda done, r: let(best(r), lambda columns: extended(done, columns)), range(roles), start)
    return F.transform(F.array_min(ways)["at"], lambda x: F.when(x == 1 << 30, 0).otherwise(x))


def column_roles(rows: DataFrame, keys: list[str], roles: dict, cells: str = "cells") -> DataFrame:
    """``keys, role, at``: the column of each role of each table. ``roles``: name -> whether a cell (a column expression) looks like the role.

    A column's score for a role is the number of its cells that look like it, in thousandths of the table's rows, rounded down. Rows may be ragged.
    """
    each = rows.select(*keys, F.posexplode(cells).alias("_at", "_cell"))
    counts = each.groupBy(*keys, "_at").agg(*[F.count_if(f(F.col("_cell"))).alias(f"_r{i}") for i, f in enumerate(roles.values())])
    height = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    grid = counts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_at", *[f"_r{i}" for i in range(len(roles))]))).alias("_grid")).join(height, keys)
    share = lambda i: F.transform("_grid", lambda c: F.floor(1000 * c[f"_r{i}"] / F.col("_n")).cast("long"))
    scores = F.array(*map(share, range(len(roles))))
    found = grid.select(*keys, scores.alias("_scores")).select(*keys, assigned(F.col("_scores"), len(roles)).alias("_at"))
    named = F.arrays_zip(F.array(*[F.lit(r) for r in roles]).alias("role"), F.col("_at").alias("at"))
    return found.select(*keys, F.inline(named))
