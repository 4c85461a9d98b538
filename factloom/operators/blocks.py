"""Nested blocks of a text, the roles of its lines, the structure of a risk region and the records it holds.

A heading of a level closes every open block of its level and below and opens its own; an explicit stack in one fold over the lines knows which
are open. So blocks nest, none overlap, and with the lines before the first heading they cover the text without gap.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators.tables import let


@dataclass(frozen=True)
class Lexicon:
    """The words that give a line its role. Patterns are tried on the line without anything but letters and digits; the fixed values of the domain are the default."""

    kept: str = "가-힣A-Za-z0-9"
    section: str = r"^(위험|투자위험|주요투자위험|집합투자기구의투자위험|투자위험의주요내용)$|^\d+(의\d+)?(집합투자기구의)?투자위험"
    category: str = r"^([가-라]\d*)?(일반위험|특수위험|기타투자위험|기타위험)(등)?$"
    cause: str = "원인|발생요인"
    impact: str = "영향|결과|손실내용"
    mitigation: str = "완화|대응|관리방안|위험관리"
    description: str = "(투자위험|^위험).*(주요내용|설명|내용)|(주요내용|설명|내용).*투자위험|^위험(주요내용|설명|내용)"
    risk: str = "위험"
    possible: str = "(괴리|손실|부도|미상환).*가능성$"
    name_heads: str = "^(구분|세부구분|위험구분|투자위험구분|위험명|투자위험명|항목)$"
    longest_name: int = 40

    def letters(self, line: Column) -> Column:
        return F.regexp_replace(F.coalesce(line, F.lit("")), f"[^{self.kept}]", "")

    def role(self, line: Column) -> Column:
        """other, section, category, cause, impact, mitigation, description or name."""
        short = lambda x: F.length(x) <= self.longest_name
        return let(
            self.letters(line),
            lambda x: F.when(x == "", "other").when(x.rlike(self.section), "section").when(x.rlike(self.category), "category").when(x.rlike(self.cause), "cause").when(x.rlike(self.impact), "impact")
            .when(x.rlike(self.mitigation), "mitigation").when(x.rlike(self.description), "description").when(short(x) & (x.rlike(self.risk) | x.rlike(self.possible)), "name").otherwise("other"),
        )

    def head_role(self, cell: Column) -> Column:
        """What the head of a column says is below it: name, cause, impact, mitigation, description or head."""
        return let(
            self.letters(cell),
            lambda x: F.when(x.rlike(self.name_heads), "name").when(x.rlike(self.cause), "cause").when(x.rlike(self.impact), "impact").when(x.rlike(self.mitigation), "mitigation").when(x.rlike(self.description), "description").otherwise("head"),
        )


#: Marks that open a bullet.
BULLET = r"^[-–—ㆍ·▪•▶▷●○□◇※*]"
TOLD = ["description", "cause", "impact", "mitigation"]


def nested_blocks(lines: Column, level: Column) -> Column:
    """``start, stop`` (lines from 1, both within), ``level, depth, parent`` (the start of the block around it; null: none) of each block, by start.

    ``level``: a function of a line, 1 for the highest heading, null for no heading. Lines before the first heading are a block of level 0 of their own.
    """
    block = "struct<start:int,level:int,depth:int,parent:int>"
    whole = "array<struct<start:int,stop:int,level:int,depth:int,parent:int>>"

    def closed(blocks: Column, stop: Column) -> Column:
        return F.transform(blocks, lambda b: F.struct(b["start"].alias("start"), stop.cast("int").alias("stop"), b["level"].alias("level"), b["depth"].alias("depth"), b["parent"].alias("parent")))

    def fold(state: Column, line: Column) -> Column:
        at = state["at"] + 1
        stays = F.filter(state["open"], lambda b: (b["level"] < line) & (b["level"] > 0))
        goes = F.filter(state["open"], lambda b: (b["level"] >= line) | (b["level"] == 0))
        new = F.struct(at.alias("start"), line.alias("level"), (F.size(stays) + 1).alias("depth"), F.get(stays, F.size(stays) - 1)["start"].alias("parent")).cast(block)
        first = F.array(F.struct(at.alias("start"), F.lit(0).alias("level"), F.lit(1).alias("depth"), F.lit(None).alias("parent")).cast(block))
        opened = F.when(line.isNotNull(), F.concat(stays, F.array(new))).when(F.size(state["open"]) == 0, first).otherwise(state["open"])
        done = F.when(line.isNotNull(), F.concat(state["done"], closed(goes, state["at"]))).otherwise(state["done"])
        return F.struct(at.alias("at"), opened.alias("open"), done.alias("done"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{block}>").alias("open"), F.array().cast(whole).alias("done"))
    levels = F.transform(lines, lambda x: level(x).cast("int"))
    return let(F.aggregate(levels, start, fold), lambda s: F.array_sort(F.concat(s["done"], closed(s["open"], s["at"]))))


def blocks(docs: DataFrame, doc_id: str, text: str, level) -> DataFrame:
    """``doc_id, start, stop, level, depth, parent`` of every block of every text. A null text has no block, an empty one a single line."""
    return docs.select(doc_id, F.inline(nested_blocks(F.split(text, "\n"), level)))


def role_level(lexicon: Lexicon = Lexicon()):
    """The level of a line by its role: section, category, name."""
    return lambda line: let(lexicon.role(line), lambda r: F.when(r == "section", 1).when(r == "category", 2).when(r == "name", 3))


def structure(lines: Column, heads: Column, width: Column, boxed: Column, lexicon: Lexicon = Lexicon()) -> Column:
    """How a region states its risks: TABLE_2COL, TABLE_MULTI_COL, VERTICAL_PAIR, BULLET, INLINE, HEADING_PARAGRAPH or UNKNOWN, the first that fits.

    ``heads``: the head row of its table (null: none) and its ``width`` in columns; ``boxed``: whether its lines have places on the page.
    """
    roles = F.transform(F.coalesce(heads, F.array().cast("array<string>")), lexicon.head_role)
    told = lambda r: F.size(F.array_intersect(r, F.array(*map(F.lit, TOLD))))
    clear = F.filter(F.transform(lines, F.trim), lambda x: x != "")

    def by_table(r: Column) -> Column:
        return F.when(F.array_contains(r, "name") & (told(r) > 0), F.when((width > 2) | (told(r) > 1), "TABLE_MULTI_COL").otherwise("TABLE_2COL"))

    def by_text(x: Column) -> Column:
        named = F.exists(x, lambda y: lexicon.role(y) == "name")
        bullet = F.exists(x, lambda y: y.rlike(BULLET) & y.rlike(lexicon.risk))
        inline = F.array_join(x, "\n").rlike(rf"[{lexicon.kept}() ]({lexicon.risk})\s*[,，;；/]")
        return F.when(named & boxed, "VERTICAL_PAIR").when(bullet, "BULLET").when(inline, "INLINE").when(named, "HEADING_PARAGRAPH").otherwise("UNKNOWN")

    return F.coalesce(let(roles, by_table), let(clear, by_text))


def records(lines: Column, lexicon: Lexicon = Lexicon()) -> Column:
    """``name, text`` of the records that a region's lines spell: a name line, or several while nothing is said yet, then what is said until the next name.

    Lines before the first name belong to no record; a section's or category's heading ends one. A name without a text is no record.
    """
    blank = F.array().cast("array<string>")
    pair = "array<struct<name:string,text:string>>"

    def flushed(s: Column) -> Column:
        new = F.struct(F.array_join(s["name"], " ").alias("name"), F.array_join(s["text"], " ").alias("text"))
        return F.when((F.size(s["name"]) > 0) & (F.size(s["text"]) > 0), F.concat(s["done"], F.array(new))).otherwise(s["done"])

    def fold(s: Column, x: Column) -> Column:
        name, head, goes = x["role"] == "name", x["role"].isin("section", "category"), F.size(s["text"]) == 0
        line = F.array(x["line"])
        return F.struct(
            F.when(name & goes, F.concat(s["name"], line)).when(name, line).when(head, blank).otherwise(s["name"]).alias("name"),
            F.when(name | head | (F.size(s["name"]) == 0), blank).otherwise(F.concat(s["text"], line)).alias("text"),
            F.when(head | (name & ~goes), flushed(s)).otherwise(s["done"]).alias("done"),
        )

    clear = F.filter(F.transform(lines, lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    told = F.transform(clear, lambda x: F.struct(x.alias("line"), lexicon.role(x).alias("role")))
    return let(F.aggregate(told, F.struct(blank.alias("name"), blank.alias("text"), F.array().cast(pair).alias("done")), fold), flushed)
