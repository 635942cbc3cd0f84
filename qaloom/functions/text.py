"""Column builders over record text. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values. Unicode 15.1 is the pinned version; Java 17 knows an older one, so
# its classes are completed (or narrowed) by the code points listed here.
PUNCTUATION = (  # the characters beyond U+FFFF are not escaped: Java looks behind them only then
    r"\p{P}\x{61D}\x{1B7D}\x{1B7E}\x{2E53}-\x{2E5D}"
    "\U00010F86-\U00010F89\U000116B9\U00011B00-\U00011B09\U00011F43-\U00011F4F\U00012FF1\U00012FF2"
)
LATIN_SCRIPT_ONLY = (  # Latin script in Java, but not named LATIN
    r"\x{AA}\x{BA}\x{2B0}-\x{2B8}\x{2E0}-\x{2E4}\x{1D2C}-\x{1D5C}\x{1D9B}-\x{1DBE}"
    r"\x{212A}\x{212B}\x{2132}\x{214E}\x{2183}\x{2C7D}\x{A770}\x{A7F8}\x{A7F9}"
    r"\x{AB5C}-\x{AB5F}\x{AB69}"
)
LATIN_NAME_ONLY = (  # named LATIN, but unknown to Java 17 or of another script
    r"\x{2C2E}\x{2C5E}\x{A7C0}\x{A7C1}\x{A7D0}\x{A7D1}\x{A7D3}\x{A7D5}-\x{A7D9}"
    r"\x{1DF00}-\x{1DF1E}\x{1DF25}-\x{1DF2A}"
)
SPACE = (  # every Unicode white space and the four separators U+001C to U+001F
    r"\t-\r\x1c-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)

# Marks that are written differently in Arabic and Latin script.
FOLDED_MARKS = "؟،؛٪٫٬۔«»“”‘’–—…"
PLAIN_MARKS = "?,;%.,.\"\"\"\"''--."

UNIT_SEPARATOR = "\x1f"
PART_SEPARATOR = "\x1e"

_LATIN_LETTER = rf"[[\p{{IsLatin}}&&\p{{L}}]{LATIN_NAME_ONLY}](?<![{LATIN_SCRIPT_ONLY}])"
_MARK = f"[{PUNCTUATION}]"
# Every pattern asks first whether a character is of the wanted class and only then
# looks behind it; runs are possessive and start only where a run starts, so that
# a text is read in linear time.
_EDGE_MARKS = (  # a run of marks with white space, or an end of the text, on one side
    rf"{_MARK}(?:(?<![^{SPACE}]{_MARK}){_MARK}*+|(?<!{_MARK}{_MARK}){_MARK}*+(?![^{SPACE}]))"
)
_END_MARKS = rf"^{_MARK}++|{_MARK}(?<!{_MARK}{_MARK}){_MARK}*+\z"
_END_SPACE = rf"^[{SPACE}]++|[{SPACE}](?<![{SPACE}]{{2}})[{SPACE}]*+\z"


def has_punctuation(text: Column) -> Column:
    """Whether any character is of a Unicode punctuation category (not a symbol)."""
    return text.rlike(_MARK)


def has_latin_letter(text: Column) -> Column:
    """Whether any character is a letter of the Latin alphabet."""
    return text.rlike(_LATIN_LETTER)


def punctuation_set(text: Column) -> Column:
    """The sorted distinct marks of a text, with Arabic marks folded to plain ones."""
    marks = F.regexp_extract_all(F.translate(text, FOLDED_MARKS, PLAIN_MARKS), F.lit(_MARK), F.lit(0))
    return F.array_sort(F.array_distinct(marks))


def trim_punctuation(word: Column) -> Column:
    """Strip marks from both ends; marks inside stay."""
    return F.regexp_replace(word, _END_MARKS, "")


def words(text: Column) -> Column:
    """White-space separated words without the marks at their ends; no empty words.

    One pass removes the marks at word ends over the whole text, so no expression
    runs per word.
    """
    bare = F.regexp_replace(text, _EDGE_MARKS, "")
    return F.filter(F.split(bare, f"[{SPACE}]+"), lambda w: w != "")


def strip(text: Column) -> Column:
    """Trim every Unicode white space, not only U+0020."""
    return F.regexp_replace(text, _END_SPACE, "")


def input_text(parts: Column) -> Column:
    """The parts of a question as one text, one part per line."""
    return F.array_join(parts, "\n")


def row_hash(instruction: Column, parts: Column, output: Column) -> Column:
    """SHA-256 content fingerprint that links a record to a stored question."""
    content = F.concat_ws(
        UNIT_SEPARATOR, instruction, F.array_join(parts, PART_SEPARATOR), output
    )
    return F.sha2(content, 256)


def question_key(instruction: Column, parts: Column) -> Column:
    """32-byte digest of the exact (instruction, input) pair, for slim shuffles.

    Lengths go into the digest, so no two different pairs share an encoding even
    when a field holds a separator character.
    """
    counted = F.transform(parts, lambda p: F.concat(F.length(p).cast("string"), F.lit(":"), p))
    return F.unhex(
        F.sha2(
            F.concat(
                F.length(instruction).cast("string"), F.lit(":"), instruction,
                F.size(parts).cast("string"), F.lit(":"), F.array_join(counted, ""),
            ),
            256,
        )
    )


def stored_input(parts: Column) -> Column:
    """The parts as JSON text with ``", "`` between them and non-ASCII kept."""
    quoted = F.transform(parts, lambda p: F.regexp_replace(F.to_json(F.array(p)), r"^\[|\]\z", ""))
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))


def utc_day(moment: Column) -> Column:
    """Calendar day of a timestamp; the session time zone is UTC."""
    return F.date_format(moment, "yyyy-MM-dd")
