"""Sources of raw text by name: from a source's own rows to whole texts.

Each takes rows with a unique `row` and gives row and text of those that it
keeps. They are what a mixture draws from; texts are rendered and filtered here,
by column expressions, and never cut."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rand import hash32, uniform
from ..functions.text import quality
from .driver import SOURCES, source
from .records import instruction_text

#: Least lengths by source, and what interface states are made of.
LEAST = {"thai_wiki": 300, "thai_edu": 200, "en_replay": 300, "html": 200}
MOST_HTML = 20000
ROLES = ["button", "link", "textbox", "checkbox", "combobox", "menuitem", "heading", "tab", "radio", "img"]
NAMES_TH = ["ชำระเงิน", "สมัครสมาชิก", "เข้าสู่ระบบ", "ค้นหา", "ตะกร้าสินค้า", "ที่อยู่จัดส่ง", "อีเมล", "รหัสผ่าน", "ยืนยัน", "ยกเลิก"]
NAMES_EN = ["Submit", "Cancel", "Search", "Login", "Sign up", "Cart", "Checkout", "Email", "Password", "Next"]


def kept(rows: DataFrame, text: Column, least: int = 0) -> DataFrame:
    """row and text, of those over the least length."""
    return rows.select("row", text.alias("text")).where(F.length("text") > least)


@source("thai_web")
def thai_web(rows: DataFrame, **measures) -> DataFrame:  # noqa: ANN003
    """Web texts that pass the quality filter; measures: its script and limits, if not Thai's."""
    return rows.where(quality(F.col("text"), **measures)).select("row", "text")


@source("thai_wiki")
def thai_wiki(rows: DataFrame) -> DataFrame:
    """Articles under their title."""
    return kept(rows.where(F.length("text") > LEAST["thai_wiki"]), F.concat(F.coalesce("title", F.lit("")), F.lit("\n\n"), F.col("text")))


@source("thai_edu")
def thai_edu(rows: DataFrame) -> DataFrame:
    """Instruction, input and output as lines."""
    return kept(rows, instruction_text(F.col("instruction"), F.col("input"), F.col("output")), LEAST["thai_edu"])


@source("parallel")
def parallel(rows: DataFrame) -> DataFrame:
    """Both sides, named, in either order; both must be there."""
    there = rows.where((F.coalesce("th", F.lit("")) != "") & (F.coalesce("en", F.lit("")) != ""))
    th, en = F.concat(F.lit("th: "), "th"), F.concat(F.lit("en: "), "en")
    return kept(there, F.when(uniform("parallel", "row") < 0.5, F.concat_ws("\n", th, en)).otherwise(F.concat_ws("\n", en, th)))


@source("en_replay")
def en_replay(rows: DataFrame) -> DataFrame:
    return kept(rows, F.col("text"), LEAST["en_replay"])


def ui_state(key: str) -> Column:
    """An interface of 8 to 40 elements with names, as lines, drawn by key."""
    pick = lambda xs, seed, i: F.element_at(F.array(*[F.lit(x) for x in xs]), (hash32(seed, key, i) % len(xs) + 1).cast("int"))

    def line(i: Column) -> Column:
        name = F.when(uniform("ui-th", key, i) < 0.7, pick(NAMES_TH, "ui-name", i)).otherwise(pick(NAMES_EN, "ui-name", i))
        return F.concat(F.lit("["), i.cast("string"), F.lit("] "), pick(ROLES, "ui-role", i), F.lit(' "'), name, F.lit('"'))

    return F.array_join(F.transform(F.sequence(F.lit(0), (7 + hash32("ui-n", key) % 33).cast("int")), line), "\n")


@source("machine")
def machine(rows: DataFrame) -> DataFrame:
    """40 % interface states, 30 % JSON records (`record`, a struct), 30 % HTML
    of fitting length; an interface where the HTML doesn't fit."""
    u, n = uniform("machine", "row"), F.length("html")
    fits = F.coalesce((n > LEAST["html"]) & (n < MOST_HTML), F.lit(False))
    return kept(rows, F.when(u < 0.4, ui_state("row")).when(u < 0.7, F.to_json("record")).when(fits, F.col("html")).otherwise(ui_state("row")))


def all_sources(inputs: dict[str, DataFrame], **settings: dict) -> DataFrame:
    """source, row, text of all the sources given, one below the other;
    settings: further arguments by source."""
    out = None
    for name in sorted(inputs):
        one = SOURCES[name](inputs[name], **settings.get(name, {})).select(F.lit(name).alias("source"), F.col("row").cast("string").alias("row"), "text")
        out = one if out is None else out.union(one)
    return out
