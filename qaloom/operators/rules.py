"""The automatic rules: which records fail, which cannot be judged, and why."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qaloom.functions import text as tx
from qaloom.functions import tools as tl
from qaloom.operators.skew import fixed, mark_repeats

# Rule keys and the note recorded for each, in rule order.
NOTES = {
    "duplicate": "سؤال مكرر",
    "english": "لفظ انجليزي في المخرج",
    "punctuation": "علامات الترقيم في المخرج تختلف عن المدخل",
    "unknown_tool": "الأداة المستخدمة في المخرج ليست من الأدوات المتاحة",
    "unknown_argument": "المدخل المستخدم في الأداة غير متاح للاستخدام",
    "missing_required": "أحد المدخلات المطلوبة غير مستخدم في الأداة",
    "output_punctuation": "علامات ترقيم غير مسموحة في المخرج",
    "word_mismatch": "كلمات المخرج لا تتطابق مع المدخل",
    "not_an_option": "يجب أن يكون المخرج أحد الأربع خيارات المتاحة",
}
# Data types, answer options, reasons.
DATA_TYPES = ["arabizi", "tool_calling", "saudi_dialect", "arabic_grammar"]
GRAMMAR_OPTIONS = ["أ", "ب", "ج", "د"]
NO_SCHEMA = "no tool schema found in the instruction"
NO_CALL = "no readable <tool_call> in the output"


def _none() -> Column:
    return F.array().cast("array<string>")


def _fired(*rules: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for test, name in rules]))


def english(output: Column) -> Column:
    return tx.has_latin_letter(output)


def punctuation(parts: Column, output: Column) -> Column:
    return tx.punctuation_set(tx.input_text(parts)) != tx.punctuation_set(output)


def output_punctuation(output: Column) -> Column:
    return tx.has_punctuation(output)


def word_mismatch(parts: Column, output: Column) -> Column:
    return F.size(F.array_except(tx.words(output), tx.words(tx.input_text(parts)))) > 0


def not_an_option(output: Column) -> Column:
    return ~tx.strip(output).isin(GRAMMAR_OPTIONS)


def tool_faults(tools: Column, calls: Column) -> Column:
    """Faults of all calls, each once, in the order in which they first occur.

    A call that names no offered tool has no other fault. Of two tools with one
    name the later definition counts.
    """
    def faults(call: Column) -> Column:
        named = F.try_element_at(F.filter(tools, lambda t: t["name"] == call["name"]), F.lit(-1))
        return tl.let(named, lambda tool: faults_with(call, tool))

    def faults_with(call: Column, tool: Column) -> Column:
        return F.when(tool.isNull(), F.array(F.lit("unknown_tool"))).otherwise(
            _fired(
                (F.size(F.array_except(call["arguments"], tool["properties"])) > 0, "unknown_argument"),
                (F.size(F.array_except(tool["required"], call["arguments"])) > 0, "missing_required"),
            )
        )

    return F.array_distinct(F.flatten(F.transform(calls, faults)))


def _rule_columns(data_type: str) -> tuple[Column, Column]:
    """(rules fired, reason it could not be judged) for one data type."""
    parts, output = F.col("input"), F.col("output")
    no_reason = F.lit(None).cast("string")
    if data_type == "arabizi":
        return _fired((english(output), "english"), (punctuation(parts, output), "punctuation")), no_reason
    if data_type == "saudi_dialect":
        return _fired(
            (output_punctuation(output), "output_punctuation"),
            (word_mismatch(parts, output), "word_mismatch"),
        ), no_reason
    if data_type == "arabic_grammar":
        return _fired((not_an_option(output), "not_an_option")), no_reason
    if data_type == "tool_calling":
        tools, calls = F.col("_tools"), F.col("_calls")
        reason = F.when(tools.isNull(), NO_SCHEMA).when(calls.isNull(), NO_CALL)
        return F.when(reason.isNull(), tool_faults(tools, calls)).otherwise(_none()), reason
    raise ValueError(f"Unknown data type {data_type!r}. Expected one of {', '.join(DATA_TYPES)}.")


def apply_rules(records: DataFrame, data_type: str | Column) -> DataFrame:
    """Add ``fired`` (rule keys, in rule order) and ``reason`` to every record.

    ``data_type`` is one type for all records, or a column that gives each its own.
    """
    kept = records.columns
    if isinstance(data_type, str):
        types, kind = [data_type], None
        _rule_columns(data_type)
    else:
        types, kind = DATA_TYPES, "_data_type"
        records = records.withColumn(kind, data_type)
    if "tool_calling" in types:
        mine = F.lit(True) if kind is None else F.col(kind) == "tool_calling"
        records = records.withColumn("_instruction", F.when(mine, F.col("instruction"))).withColumn(
            "_output", F.when(mine, F.col("output"))
        )
        records = tl.with_tools_and_calls(records, "_instruction", "_output", "_tools", "_calls")
    if kind is None:
        fired, reason = _rule_columns(types[0])
    else:
        unknown = F.raise_error(F.concat(F.lit("Unknown data type "), F.col(kind)))
        columns = {t: _rule_columns(t) for t in types}
        pick = lambda i: reduce(
            lambda rest, t: F.when(F.col(kind) == t, columns[t][i]).otherwise(rest),
            reversed(types), unknown.cast("array<string>" if i == 0 else "string"),
        )
        fired, reason = pick(0), pick(1)
    ruled = records.select(*kept, fired.alias("fired"), reason.alias("reason"))
    return fixed(ruled, "fired", "reason")


def _keyed(records: DataFrame) -> tuple[DataFrame, list[str]]:
    """Records with the digest of their question, and the columns that tell repeats."""
    keyed = records.withColumn("_key", tx.question_key(F.col("instruction"), F.col("input")))
    return keyed, [*[c for c in records.columns if c == "file"], "_key"]


def mark_duplicates(records: DataFrame, flag: str = "is_repeat") -> DataFrame:
    """Add ``flag`` to every record whose instruction and input came before.

    Records that name their ``file`` are compared within it.
    """
    keyed, keys = _keyed(records)
    return mark_repeats(keyed, keys, F.col("position"), flag).drop("_key")


def judge(records: DataFrame, data_type: str | Column) -> DataFrame:
    """Records with ``fired`` (a repeat first, then rules) and ``reason``.

    A record repeats an earlier one of its file, or of all when none is named. The
    rules run where the text is read, so what the join moves is only what is asked
    for of the result.
    """
    keyed, keys = _keyed(records)
    ruled = mark_repeats(
        apply_rules(keyed, data_type), keys, F.col("position"), "_repeat", among=keyed
    )
    fired = F.when(
        F.col("_repeat"), F.concat(F.array(F.lit("duplicate")), F.col("fired"))
    ).otherwise(F.col("fired"))
    return ruled.withColumn("fired", fired).drop("_repeat", "_key")


def note_of(check: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(v) for pair in NOTES.items() for v in pair]), check)


def findings(judged: DataFrame) -> DataFrame:
    """One row per rule that fired: position, source_id, check, note."""
    fired = judged.select("position", "source_id", F.explode("fired").alias("check"))
    return fired.withColumn("note", note_of(F.col("check")))


def failure_rows(judged: DataFrame) -> DataFrame:
    """One row per failed record, notes and rule keys stacked line by line."""
    return judged.where(F.size("fired") > 0).select(
        "position", "source_id", "instruction",
        tx.input_text(F.col("input")).alias("input"), "output",
        F.array_join(F.transform("fired", note_of), "\n").alias("notes"),
        F.array_join("fired", "\n").alias("check"),
        tx.row_hash(F.col("instruction"), F.col("input"), F.col("output")).alias("row_hash"),
    )


def unchecked_rows(judged: DataFrame, malformed: DataFrame | None = None) -> DataFrame:
    """Records no rule could judge, and those whose shape was refused on reading."""
    rows = judged.where(F.col("reason").isNotNull()).select("source_id", "reason")
    return rows if malformed is None else malformed.select("source_id", "reason").unionByName(rows)


def summary(judged: DataFrame, malformed: DataFrame | None = None) -> DataFrame:
    """Counts of records read and failed, of each check, unchecked, of each reason.

    One pass: every record turns into its tags, which are counted with a partial
    aggregate. ``first_position`` orders equal counts by first appearance.
    """
    def tag(section: str, label: Column) -> Column:
        return F.struct(F.lit(section).alias("section"), label.alias("label"))

    whole = F.lit("")
    tags = F.concat(
        F.array(tag("read", whole)),
        F.when(F.size("fired") > 0, F.array(tag("failed", whole))).otherwise(F.array()),
        F.transform("fired", lambda c: tag("check", c)),
        F.when(
            F.col("reason").isNotNull(), F.array(tag("unchecked", whole), tag("reason", F.col("reason")))
        ).otherwise(F.array()),
    )
    rows = judged.select("position", F.inline(tags))
    if malformed is not None:
        both = F.array(tag("unchecked", whole), tag("reason", F.col("reason")))
        rows = rows.unionByName(malformed.select(F.lit(-1).cast("long").alias("position"), F.inline(both)))
    return rows.groupBy("section", "label").agg(
        F.count(F.lit(1)).alias("records"), F.min("position").alias("first_position")
    )


def print_order(summary_rows: DataFrame) -> DataFrame:
    """Summary rows as a report lists them: highest count first within a section."""
    section = F.array_position(
        F.array(*[F.lit(s) for s in ("read", "failed", "check", "unchecked", "reason")]), F.col("section")
    )
    return summary_rows.orderBy(section, F.desc("records"), "first_position")
