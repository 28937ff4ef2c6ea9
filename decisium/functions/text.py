"""Text measures and repairs as columns: built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The Thai block, and scripts that reject a record.
THAI = r"[\x{0E00}-\x{0E7F}]"
OTHER_SCRIPTS = (
    r"[\x{0400}-\x{052F}\x{0590}-\x{08FF}\x{0900}-\x{0DFF}\x{1100}-\x{11FF}\x{3040}-\x{30FF}\x{3130}-\x{318F}"
    r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}]"
)
#: Phrases of Thai boilerplate pages.
BOILERPLATE_TH = ["คลิกที่นี่", "สมัครสมาชิก", "เว็บพนัน", "บาคาร่า", "สล็อต", "หวยออนไลน์"]
CONTROL, ZERO_WIDTH = "<|ts_", "​"


def script_ratio(text: Column, script: str = THAI) -> Column:
    """Share of a text's characters that are of the script; 0 for an empty one."""
    return F.regexp_count(text, F.lit(script)) / F.greatest(F.lit(1), F.length(text))


def occurrences(text: Column, part: str) -> Column:
    """How often `part` occurs without overlap."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


def solid_lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(r"\S"))


def unique_line_ratio(text: Column) -> Column:
    """Distinct over all lines that aren't blank; null without such a line."""
    lines = solid_lines(text)
    return F.try_divide(F.size(F.array_distinct(lines)), F.size(lines))


def quality(text: Column, script: str = THAI, least_ratio: float = 0.5, boilerplate: list[str] | None = None, least: int = 200) -> Column:
    """Long enough, enough of the script, few repeated lines, links and boilerplate.
    The cheap tests come first."""
    bad = sum((occurrences(text, b) for b in (BOILERPLATE_TH if boilerplate is None else boilerplate)), F.lit(0))
    n = F.length(text)
    return F.coalesce(
        (n >= least) & (script_ratio(text, script) >= least_ratio) & (unique_line_ratio(text) >= 0.7) & (occurrences(text, "http") <= n / 200) & (bad <= 3),
        F.lit(False),
    )


def strip(text: Column) -> Column:
    """Without white space at either end, in the Unicode sense."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def sanitize(text: Column) -> Column:
    """Breaks up the strings of control tokens."""
    return F.replace(text, F.lit(CONTROL), F.lit("<" + ZERO_WIDTH + CONTROL[1:]))


def digest(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def other_script(text: Column, scripts: str = OTHER_SCRIPTS) -> Column:
    return text.rlike(scripts)


def salvage_json(text: Column) -> Column:
    """The outermost braces of a model's answer, if they hold valid JSON."""
    bare = strip(F.regexp_replace(strip(text), r"(?m)^```(?:json)?|```$", ""))
    found = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    return F.when(F.try_parse_json(F.when(found != "", found)).isNotNull(), found)


def normal_label(qtype: Column, kind: Column, raw: Column) -> Column:
    """A label as text by question type. kind: JSON kind of the raw label
    ('string', 'boolean', 'number'); null in, null out."""
    whole = F.when(kind == "boolean", F.when(raw == "true", "1").otherwise("0")).when(
        kind == "number", F.floor(F.abs(raw.try_cast("double"))).cast("string")
    ).when(strip(raw).rlike(r"^[+-]?\d+$"), strip(raw).try_cast("long").cast("string"))
    signed = F.when((kind == "number") & (raw.try_cast("double") <= -1), F.concat(F.lit("-"), whole)).otherwise(whole)
    truthy = F.when(kind == "boolean", raw == "true").when(kind == "string", F.lower(strip(raw)).isin("true", "yes", "ใช่", "1")).otherwise(raw.try_cast("double") != 0)
    return F.when(raw.isNull(), F.lit(None).cast("string")).when(qtype == "choice", raw).when(qtype == "score", signed).when(qtype == "noul", truthy.cast("string"))
