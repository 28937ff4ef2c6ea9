"""Decision records: questions as ordered option arrays, validation, rendering,
encoding, converters and gates. All are columns or DataFrame functions.

A question is a struct (qid, qtype, instructions, options array of (name, desc),
label_raw); a record has an array of them, in order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rand import hash32, uniform
from ..functions.text import sanitize, strip
from .decide import ABSTAIN, IGNORE, MOST_OPTIONS, chance, let

LEAST_LEVELS, MOST_LEVELS = 2, 10
#: Control tokens, and phrasings of questions.
TOKENS = {"state": "<|ts_state|>", "question": "<|ts_q|>", "answer": "<|ts_answer|>", "choice": "<|ts_choice|>", "score": "<|ts_score|>", "noul": "<|ts_noul|>"}
CHOICE_EN = ["Which {what} best matches this text?", "Classify the {what} of the state above.", "Select the correct {what}.", "What is the {what}?"]
CHOICE_TH = ["ข้อความนี้จัดอยู่ในหมวด{what}ใด", "เลือก{what}ที่ตรงกับข้อความมากที่สุด", "จาก state ด้านบน {what}ที่ถูกต้องคือข้อใด", "ระบุ{what}ของข้อความนี้"]
NOUL_EN = ["Is this text {what}?", "Does the state {what}?", "True or false: the text {what}."]
NOUL_TH = ["ข้อความนี้{what}หรือไม่", "จริงหรือไม่ว่า ข้อความนี้{what}", "state นี้{what}ใช่หรือไม่"]
TEMPLATES = {("en", "choice"): CHOICE_EN, ("th", "choice"): CHOICE_TH, ("en", "noul"): NOUL_EN, ("th", "noul"): NOUL_TH}
EVAL_ONLY = ["wisesight", "sib200_th", "banking77"]

CONVERTERS: dict[str, Callable[..., DataFrame]] = {}


def converter(name: str) -> Callable:
    """Registers a function from source DataFrames to records."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        CONVERTERS[name] = f
        return f

    return add


def special_tokens() -> list[str]:
    return [*TOKENS.values(), *[option_token(i) for i in range(256)]]


def option_token(i: int) -> str:
    return f"<|ts_opt_{i}|>"


def options(names: Column, descs: Column | None = None) -> Column:
    """Option structs of a name array and a description array or map."""
    none = F.lit(None).cast("string")
    if descs is None:
        return F.transform(names, lambda n: F.struct(n.alias("name"), none.alias("desc")))
    return F.transform(names, lambda n: F.struct(n.alias("name"), F.try_element_at(descs, n).alias("desc")))


def template(lang: Column, kind: str, what: str, seed: str, key: str) -> Column:
    """A phrasing picked by hash; languages other than Thai are asked in English."""
    pick = lambda xs: F.element_at(F.array(*[F.lit(x.replace("{what}", what)) for x in xs]), (hash32(seed, key) % len(xs) + 1).cast("int"))
    return F.when(lang == "th", pick(TEMPLATES["th", kind])).otherwise(pick(TEMPLATES["en", kind]))


def request_error(qtype: Column, names: Column, orders: Column | None = None, questions: Column | None = None) -> Column:
    """Why a question isn't valid; null if it is."""
    n = F.size(names)
    blank = F.exists(names, lambda x: F.coalesce(strip(x), F.lit("")) == "")
    out = F.when(~qtype.isin("choice", "score", "noul"), "unknown type")
    out = out.when((qtype == "choice") & ((n < 1) | (n > MOST_OPTIONS)), "choice takes 1 to 255 options").when((qtype == "choice") & blank, "blank option name")
    out = out.when((qtype == "score") & ((n < LEAST_LEVELS) | (n > MOST_LEVELS)), "score takes 2 to 10 levels")
    out = out.when((qtype == "noul") & (F.size(F.array_except(names, F.array(F.lit("true"), F.lit("false")))) > 0), "noul takes true and false")
    if questions is not None:
        out = out.when(questions < 1, "no question")
    if orders is not None:
        out = out.when((orders < 1) | (orders > 32), "permutations must be 1 to 32")
    return out


def parsed_question(raw: Column) -> Column:
    """A question's JSON as a struct (qtype, instructions, options, error), by
    its type: a choice's criteria are an object of names with descriptions or a
    list of names, a score's a list of levels, a noul's an object of true and
    false or absent. error says why it isn't a question; null if it is one."""
    m = F.from_json(raw, "map<string,string>")
    at = lambda k: F.try_element_at(m, F.lit(k))
    qtype, criteria = at("type"), at("criteria")
    given = F.map_entries(F.from_json(criteria, "map<string,string>"))
    listed = F.from_json(criteria, "array<string>")
    none = F.lit(None).cast("string")
    opt = lambda n, d: F.struct(n.alias("name"), d.alias("desc"))
    said = lambda k: F.try_element_at(F.from_json(criteria, "map<string,string>"), F.lit(k))
    is_list = criteria.startswith("[")
    choice = F.when(is_list, F.transform(listed, lambda n: opt(n, none))).otherwise(F.transform(given, lambda e: opt(e["key"], e["value"])))
    score = F.transform(listed, lambda x, i: opt(i.cast("string"), x))
    noul = F.array(opt(F.lit("no"), said("false")), opt(F.lit("yes"), said("true")))
    empty = F.array().cast("array<struct<name:string,desc:string>>")
    opts = F.coalesce(F.when(qtype == "choice", choice).when(qtype == "score", F.when(is_list, score)).when(qtype == "noul", noul), empty)
    names = F.when(qtype == "noul", F.coalesce(F.map_keys(F.from_json(criteria, "map<string,string>")), F.array().cast("array<string>"))).otherwise(F.transform(opts, lambda o: o["name"]))
    error = F.when(m.isNull(), "not an object").when(at("instructions").isNull(), "no instructions").otherwise(request_error(F.coalesce(qtype, F.lit("")), names))
    return F.struct(qtype.alias("qtype"), at("instructions").alias("instructions"), opts.alias("options"), error.alias("error"))


def parsed_questions(raw: Column) -> Column:
    """An object of questions by id as an array, in its order; null if it isn't one."""
    return F.transform(F.map_entries(F.from_json(raw, "map<string,string>")), lambda e: F.struct(e["key"].alias("qid"), parsed_question(e["value"]).alias("q")))


def record_error(state: Column, questions: Column, labels: Column) -> Column:
    """Why a record (all parts JSON or text) isn't valid; null if it is."""
    qs, given = parsed_questions(questions), F.from_json(labels, "map<string,string>")
    label = lambda x: F.try_element_at(given, x["qid"])
    slots = lambda x: F.transform(x["q"]["options"], lambda o: o["name"])
    whole = lambda v: v.try_cast("double").try_cast("long").cast("string")
    bad = lambda x: F.when(x["q"]["qtype"] == "choice", ~F.array_contains(slots(x), label(x))).when(x["q"]["qtype"] == "score", ~F.coalesce(F.array_contains(slots(x), whole(label(x))), F.lit(False))).otherwise(F.lit(False))
    keys, asked = F.map_keys(given), F.transform(qs, lambda x: x["qid"])
    differ = (F.size(F.array_except(keys, asked)) > 0) | (F.size(F.array_except(asked, keys)) > 0)
    return (
        F.when(state.isNull(), "no state").when(qs.isNull(), "no questions").when(F.coalesce(F.size(keys), F.lit(0)) < 1, "no labels").when(differ, "keys differ")
        .when(F.exists(qs, lambda x: x["q"]["error"].isNotNull()), "bad question").when(F.exists(qs, lambda x: label(x).isNull()), "null label").when(F.exists(qs, bad), "label outside")
    )


def instruction_text(*parts: Column) -> Column:
    """Parts of an instruction record as lines; a missing one is an empty line."""
    return F.concat_ws("\n", *[F.coalesce(p, F.lit("")) for p in parts])


def number(text: Column) -> Column:
    """A configuration value as a number where it is one."""
    return strip(text).try_cast("double")


def label_slot(names: Column, label: Column) -> Column:
    """Slot of the label; IGNORE without one, null where it isn't an option."""
    at = F.array_position(names, label)
    return F.when(label.isNull(), IGNORE).when(at > 0, (at - 1).cast("int"))


def shuffled(opts: Column, seed: str, key: Column) -> Column:
    """Options in hash order."""
    keyed = F.transform(opts, lambda o: F.struct(hash32(seed, key, o["name"]).alias("h"), o.alias("o")))
    return F.transform(F.array_sort(keyed), lambda x: x["o"])


def permuted(opts: Column, order: Column) -> Column:
    return F.transform(order, lambda i: F.element_at(opts, i + 1))


def drop_label(opts: Column, label: Column) -> tuple[Column, Column]:
    """Options without the label's, and abstain as the slot."""
    return F.filter(opts, lambda o: o["name"] != label), F.lit(ABSTAIN)


def question_to_spec(raw: Column, label: Column, drop: Column | bool = False, order: Column | None = None, shuffle: Column | bool = False, seed: str = "order", key: Column | None = None) -> Column:
    """A question's JSON and its label's as a struct (qtype, instructions,
    options in their order, order (places of the options as given), slot, error).

    Only a choice's options change places: by `order` (places as given; those
    that it leaves out go), else by hash where `shuffle` holds; drop takes the
    label's option out, and abstain is the slot then. label: an option's name, a
    level or true and false, as text; null without one. error says why there is
    no spec: not a valid question, a label that isn't an option or level, or a
    drop of the only option."""
    flag = lambda x: F.lit(x) if isinstance(x, bool) else F.coalesce(x, F.lit(False))
    drop, shuffle = flag(drop), flag(shuffle)
    key = F.lit("") if key is None else key
    none = F.lit(None).cast("array<int>")

    def spec(q: Column) -> Column:
        names = F.transform(q["options"], lambda o: o["name"])
        n, choice = F.size(names), q["qtype"] == "choice"
        level = label.try_cast("double").try_cast("int")
        truth = F.when(F.lower(label).isin("true", "1", "yes"), 1).when(F.lower(label).isin("false", "0", "no"), 0)
        at = F.when(choice, F.array_position(names, label).cast("int") - 1).when(q["qtype"] == "score", F.when((level >= 0) & (level < n), level)).otherwise(truth)
        found = F.coalesce(at >= 0, F.lit(False))
        gone = choice & drop & found
        places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        kept = F.filter(places, lambda i: ~(gone & (i == at)))
        mixed = F.transform(F.array_sort(F.transform(kept, lambda i: F.struct(hash32(seed, key, i).alias("h"), i.alias("i")))), lambda x: x["i"])
        given = none if order is None else F.filter(order.cast("array<int>"), lambda i: F.array_contains(kept, i))
        placed = F.when(choice, F.coalesce(given, F.when(shuffle, mixed), kept)).otherwise(kept)
        slot = F.when(label.isNull(), F.lit(None).cast("int")).when(gone, ABSTAIN).otherwise(F.array_position(placed, at).cast("int") - 1)
        error = (
            F.when(q["error"].isNotNull(), q["error"]).when(label.isNotNull() & ~found, F.when(choice, "label isn't an option").when(q["qtype"] == "score", "level out of range").otherwise("label isn't true or false"))
            .when(gone & (n < 2), "can't drop the only option").when(label.isNotNull() & (slot < 0), "the order leaves the label out")
        )
        ok = error.isNull()
        return F.struct(q["qtype"].alias("qtype"), q["instructions"].alias("instructions"), F.when(ok, permuted(q["options"], placed)).alias("options"), F.when(ok, placed).alias("order"), F.when(ok, slot).alias("slot"), error.alias("error"))

    return let(parsed_question(raw), spec)


def gate_status(questions: Column, labels: Column, again: Column, blind: Column | None = None, least_chance: float = 0.34) -> Column:
    """How a generated record fares, from JSON: its labels (by question), those
    of a second labelling, and those of one that didn't see the state.

    invalid: no questions or labels, or a question without a label; disagree: a
    label differs; leak: all blind labels are right, though chance is under
    `least_chance`; else ok. Labels are compared as their question's type has
    them: names stripped, levels as whole numbers, truth as true and false."""
    qs = parsed_questions(questions)
    of = lambda m, x: same_kind(x["q"]["qtype"], F.try_element_at(F.from_json(m, "map<string,string>"), x["qid"]))
    agree = lambda other: F.forall(qs, lambda x: of(labels, x).eqNullSafe(of(other, x)))
    bad = qs.isNull() | (F.size(qs) < 1) | F.exists(qs, lambda x: x["q"]["error"].isNotNull() | of(labels, x).isNull())
    out = F.when(F.coalesce(bad, F.lit(True)), "invalid").when(~F.coalesce(agree(again), F.lit(False)), "disagree")
    if blind is not None:
        low = chance(F.transform(qs, lambda x: F.size(x["q"]["options"]))) < least_chance
        out = out.when(low & F.coalesce(agree(blind), F.lit(False)), "leak")
    return out.otherwise("ok")


def same_kind(qtype: Column, raw: Column) -> Column:
    """A label's text as its question's type has it."""
    level = F.floor(strip(raw).try_cast("double")).cast("string")
    truth = F.lower(strip(raw)).isin("true", "yes", "1", "ใช่").cast("string")
    return F.when(qtype == "score", F.when(F.lower(strip(raw)) == "true", "1").when(F.lower(strip(raw)) == "false", "0").otherwise(level)).when(qtype == "noul", truth).otherwise(strip(raw))


def render(qtype: Column, instructions: Column, opts: Column) -> Column:
    """A question's text block, ended by the answer token."""
    head = F.concat(F.lit(TOKENS["question"]), F.lit("<|ts_"), qtype, F.lit("|> "), strip(sanitize(instructions)))
    line = F.transform(
        opts,
        lambda o, i: F.concat(
            F.lit("<|ts_opt_"), i.cast("string"), F.lit("|> "), strip(sanitize(o["name"])), F.when(F.coalesce(o["desc"], F.lit("")) != "", F.concat(F.lit(": "), strip(sanitize(o["desc"])))).otherwise("")
        ),
    )
    return F.concat(head, F.lit("\n"), F.array_join(F.concat(line, F.array(F.lit(TOKENS["answer"]))), "\n"), F.lit("\n"))


def simple_tokens(text: Column) -> Column:
    """Tokens without a vocabulary: control tokens, words, single marks."""
    return F.regexp_extract_all(text, F.lit(r"(<\|ts_[a-z_0-9]+\|>|\w+|[^\w\s])"), F.lit(1))


def head_and_tail(ids: Column, budget: Column | int) -> Column:
    """At most `budget` ids: the first and the last ones. One is always kept."""
    b = F.lit(budget) if isinstance(budget, int) else budget
    keep = F.greatest(b - 1, F.lit(0))
    cut = F.concat(F.slice(ids, 1, 1), F.when(keep > 0, F.slice(ids, F.greatest(F.lit(1), F.size(ids) - keep + 1), keep)).otherwise(F.slice(ids, 1, 0)))
    return F.when(F.size(ids) > b, cut).otherwise(ids)


def encoded(df: DataFrame, state: str = "state_ids", questions: str = "question_ids", most_state: int = 32768, most: int = 65536) -> DataFrame:
    """input_ids, answer_positions and truncated from a row's state ids and its
    questions' ids; a question's answer token is its last."""
    sizes = F.transform(questions, lambda q: F.size(q))
    total = F.aggregate(sizes, F.lit(0), lambda s, x: s + x)
    budget = F.least(F.lit(most_state), F.lit(most) - total)
    out = df.withColumn("truncated", F.size(state) > budget).withColumn("_state", head_and_tail(F.col(state), budget))
    ends = F.aggregate(sizes, F.array().cast("array<int>"), lambda acc, x: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.size("_state") - 1) + x)))
    return out.withColumn("input_ids", F.concat("_state", F.flatten(questions))).withColumn("answer_positions", ends).drop("_state")


def padded(ids: Column, width: Column, pad: int = 0) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(pad), F.greatest(F.lit(0), width - F.size(ids))))


def distractors(vocabulary: Column, correct: Column, k: int, seed: str, key: Column) -> Column:
    """The correct option and k - 1 others by hash, in hash order."""
    others = F.array_sort(F.transform(F.filter(vocabulary, lambda x: x != correct), lambda x: F.struct(hash32(seed, key, x).alias("h"), x.alias("x"))))
    chosen = F.concat(F.array(correct), F.transform(F.slice(others, 1, k - 1), lambda x: x["x"]))
    mixed = F.array_sort(F.transform(chosen, lambda x: F.struct(hash32(seed + "-mix", key, x).alias("h"), x.alias("x"))))
    return F.transform(mixed, lambda x: x["x"])


def history(steps: DataFrame, group: str, order: str, action: str, k: int) -> DataFrame:
    """Adds history: the last k actions before each step."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(-k, -1)
    return steps.withColumn("history", F.collect_list(action).over(w))


def not_held_out(rows: DataFrame, source: str = "source", names: list[str] | None = None) -> DataFrame:
    """Without training rows of sources that are kept for evaluation."""
    return rows.where(~((F.col("split") == "train") & F.col(source).isin(names or EVAL_ONLY)))


def half_up_level(mean: Column) -> Column:
    return F.least(F.lit(4), F.greatest(F.lit(0), F.floor(mean + 0.5) - 1))


def option_count(seed: str, key: str) -> Column:
    """Log-uniform counts: mostly 2 to 12, else up to 255."""
    u = uniform(seed + "-u", key)
    wide = F.floor(F.exp(F.log(F.lit(2.0)) + u * (F.log(F.lit(255.0)) - F.log(F.lit(2.0)))))
    return F.when(uniform(seed + "-k", key) < 0.6, 2 + F.floor(u * 11)).otherwise(wide).cast("int")
