"""Text cleaning, argument decoding and matching as Column expressions."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The characters Python's str.isspace accepts, as a regex class body.
SPACE = r"\t-\r\x1c-\x20\x{85}\x{a0}\p{Z}"
_ZS = "\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
# The same characters listed for trim(), and those JavaScript's String.trim removes.
SPACE_CHARS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85" + _ZS
JS_SPACE_CHARS = "\t\n\x0b\x0c\r \ufeff" + _ZS
WORD = r"\p{L}\p{N}_"

# Fixed values of the spreadsheet export.
ILLEGAL_XML = r"[\x00-\x08\x0B-\x0C\x0E-\x1F\x7F-\x{84}\x{86}-\x{9F}]"
CELL_LIMIT = 32_767
TRUNCATED_SUFFIX = "\n……（内容过长，已截断）"
UNNAMED_ROOM = "群聊"

# Accepted spellings of a boolean.
TRUE_WORDS = ("1", "true", "yes", "y", "on")
FALSE_WORDS = ("0", "false", "no", "n", "off")


def strip(col: Column) -> Column:
    """Trim every Unicode white-space character, not only blanks."""
    return F.trim(col, F.lit(SPACE_CHARS))


def has_text(col: Column) -> Column:
    """Anything besides white space and NUL characters, that is, `clean_lines` leaves something."""
    return F.coalesce(col.rlike(f"[^{SPACE}\\x00]"), F.lit(False))


def blank_to_null(col: Column) -> Column:
    return F.nullif(strip(col), F.lit(""))


def visible_length(col: Column) -> Column:
    return F.length(F.regexp_replace(col, f"[{SPACE}]+", ""))


def alnum_length(col: Column) -> Column:
    return F.length(F.regexp_replace(col, r"[^\p{L}\p{N}]+", ""))


def contains_literal(col: Column, keyword) -> Column:
    """Substring test where % and _ in the keyword have no special meaning."""
    return F.contains(col, keyword if isinstance(keyword, Column) else F.lit(keyword))


def safe_cell(col: Column) -> Column:
    """Text that a spreadsheet shows as text: no formula start, no illegal characters, bounded."""
    text = F.regexp_replace(F.coalesce(col.cast("string"), F.lit("")), ILLEGAL_XML, "")
    prefix = F.when(text.rlike(r"^[=+\-@]"), F.lit("'")).otherwise(F.lit(""))
    room = F.lit(CELL_LIMIT) - F.length(prefix)
    cut = F.concat(
        F.substring(text, F.lit(1), room - len(TRUNCATED_SUFFIX)), F.lit(TRUNCATED_SUFFIX)
    )
    return F.concat(prefix, F.when(F.length(text) > room, cut).otherwise(text))


def safe_name(col: Column) -> Column:
    """File-name part of at most 40 characters, with a default for nothing left."""
    name = F.regexp_replace(col, r'[\\/:*?"<>|\x00-\x1F]', "_")
    name = F.regexp_replace(name, f"[{SPACE}]+", "_")
    name = F.left(F.regexp_replace(name, r"^[._]+|[._]+$", ""), F.lit(40))
    return F.coalesce(F.nullif(name, F.lit("")), F.lit(UNNAMED_ROOM))


def clean_lines(col: Column) -> Column:
    """One trimmed line per non-empty line, inner blanks and tabs collapsed."""
    text = strip(F.replace(F.coalesce(col, F.lit("")), F.lit("\0"), F.lit("")))
    lines = F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n")
    lines = F.transform(lines, lambda x: strip(F.regexp_replace(x, r"[ \t]+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def clean_web(col: Column) -> Column:
    """Web text: collapse blanks per line, keep at most one blank line after a text line."""
    lines = F.split(F.replace(F.coalesce(col, F.lit("")), F.lit("\u00a0"), F.lit(" ")), "\n")
    lines = F.transform(
        lines,
        lambda x: F.regexp_replace(F.trim(x, F.lit(JS_SPACE_CHARS)), r"[ \t]+", " "),
    )
    kept = F.filter(
        F.arrays_zip(lines.alias("line"), F.concat(F.array(F.lit("")), lines).alias("prev")),
        lambda x: (x["line"] != "") | (x["prev"] != ""),
    )
    text = F.array_join(F.transform(kept, lambda x: x["line"]), "\n")
    return F.trim(text, F.lit(JS_SPACE_CHARS))


def text_key(text: str | None) -> str | None:
    if text is None:
        return None
    return "".join(filter(str.isalnum, unicodedata.normalize("NFKC", text).casefold()))


@F.pandas_udf(T.StringType())
def match_key(texts: pd.Series) -> pd.Series:
    """NFKC, case-folded, alphanumerics only. No built-in does NFKC, hence the pandas UDF."""
    return texts.map(text_key)


def _json_string_list(col: Column) -> Column:
    """The items of a JSON array holding only strings; null for anything else."""
    items = F.try_variant_get(F.try_parse_json(col), "$", "array<variant>")
    strings = F.forall(items, lambda x: F.schema_of_variant(x) == "STRING")
    return F.when(strings, F.transform(items, lambda x: F.try_variant_get(x, "$", "string")))


def expand_list(col: Column, bracketed_names: bool = False) -> Column:
    """A plain value or a JSON array of strings as a list; null where the JSON is no such array.

    With `bracketed_names`, as for emoji names such as `[name]`, a bracketed text that is no JSON
    counts as a plain value.
    """
    text = strip(F.coalesce(col, F.lit("")))
    listed = F.transform(_json_string_list(text), strip)
    is_list = text.startswith("[")
    if bracketed_names:
        is_list = is_list & text.endswith("]") & F.try_parse_json(text).isNotNull()
    return (
        F.when(text == "", F.array().cast("array<string>"))
        .when(is_list, F.filter(listed, lambda x: x != ""))
        .otherwise(F.array(text))
    )


def coerce_bool(col: Column, default: bool = False) -> Column:
    """Boolean from its usual spellings; anything else gives the default."""
    word = F.lower(strip(col))
    return (
        F.when(word.isin(*TRUE_WORDS), True)
        .when(word.isin(*FALSE_WORDS), False)
        .otherwise(F.lit(default))
    )


def coerce_bool_number(col: Column, default: bool = False) -> Column:
    return F.coalesce(col != 0, F.lit(default))


def clamp_int(col: Column, default: int, low: int, high: int) -> Column:
    """Integer inside [low, high]; text that is no integer counts as the default."""
    text = strip(col.cast("string"))
    digits = F.replace(text, F.lit("_"), F.lit(""))
    number = F.when(text.rlike(r"^[+-]?\d+(_\d+)*$"), digits.try_cast("decimal(38,0)"))
    # A run of digits too long for a decimal still has a sign, which is all the clamp needs.
    huge = F.when(
        text.rlike(r"^[+-]?\d+(_\d+)*$"), F.when(text.startswith("-"), low).otherwise(high)
    )
    bounded = F.least(F.greatest(number, F.lit(low)), F.lit(high)).cast("int")
    clamped_default = min(max(default, low), high)
    return F.coalesce(F.when(number.isNotNull(), bounded), huge, F.lit(clamped_default))


def decode_settings(col: Column) -> Column:
    """JSON object as a map of JSON texts; null, blank, malformed or non-object gives {}."""
    parsed = F.from_json(col, T.MapType(T.StringType(), T.StringType()))
    return F.coalesce(parsed, F.create_map().cast("map<string,string>"))


def malformed_json(col: Column) -> Column:
    """True for non-blank text that is not JSON at all."""
    return F.coalesce(blank_to_null(col).isNotNull() & F.try_parse_json(col).isNull(), F.lit(False))


def normalize_enum(col: Column, allowed, aliases=None, default: str | None = "") -> Column:
    """Trimmed name, through the aliases, if it is allowed; otherwise the default."""
    name = strip(col)
    if aliases:
        pairs = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
        name = F.coalesce(F.element_at(pairs, name), name)
    return F.when(name.isin(*allowed), name).otherwise(F.lit(default))


def lookup(col: Column, table: dict, default=None) -> Column:
    """Value of a small constant table, or the default."""
    pairs = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.element_at(pairs, col), F.lit(default))


# Voice emotions and their aliases.
EMOTIONS = (
    "happy", "sad", "angry", "surprised", "fear", "hate", "excited", "lovey-dovey",
    "shy", "comfort", "tension", "tender", "magnetic", "vocal-fry", "ASMR",
)
EMOTION_ALIASES = {"vocal - fry": "vocal-fry"}

# Drawing sizes by resolution class and ratio.
RESOLUTION_CLASSES = {
    "4k": "4k", "2160p": "4k", "3840x2160": "4k",
    "2k": "2k", "1440p": "2k", "2048": "2k",
    "1k": "1k", "1024": "1k", "1024p": "1k",
}
DRAWING_SIZES = {
    "4k 16:9": "3840x2160", "4k 9:16": "2160x3840", "4k 1:1": "2048x2048",
    "4k 3:2": "3072x2048", "4k 2:3": "2048x3072",
    "2k 16:9": "2048x1152", "2k 9:16": "1152x2048", "2k 1:1": "2048x2048",
    "2k 3:2": "2048x1360", "2k 2:3": "1360x2048",
    "1k 16:9": "1536x864", "1k 9:16": "864x1536", "1k 1:1": "1024x1024",
    "1k 3:2": "1536x1024", "1k 2:3": "1024x1536",
}


def emotion(col: Column) -> Column:
    return normalize_enum(col, EMOTIONS, EMOTION_ALIASES)


def drawing_size(ratio: Column, resolution: Column, configured: Column | None = None) -> Column:
    """Configured size, else the size for a ratio at a resolution, else auto."""

    def squeezed(col):
        return F.lower(F.replace(F.coalesce(col, F.lit("")), F.lit(" "), F.lit("")))

    klass = lookup(squeezed(resolution), RESOLUTION_CLASSES)
    size = lookup(F.concat_ws(" ", klass, squeezed(ratio)), DRAWING_SIZES, "auto")
    return size if configured is None else F.coalesce(blank_to_null(configured), size)


# Emoji names with the digest and length of their image.
EMOJI = {
    "[调皮]": ("da56c104712858765ff6edb61083c4ab", 10250946),
    "[无语]": ("8690c66ab09a767cb5f7c7818c0a517f", 26296),
    "[爱心]": ("1b44ec167ccb38d8260a57bccaa516e5", 8337713),
    "[安慰]": ("ad2f9eb42093bf73190cef07d8958e6b", 418037),
    "[嘲笑]": ("16644536f3300a81d96f712a399ff92e", 205506),
    "[傻瓜]": ("45484d7b1133b16e68285943a6dc1ba3", 74925),
    "[厉害]": ("de4fb8aff77f474746efa3e7a6d638dc", 57770),
    "[生气]": ("b74fc587508b4b1ce13009ed73585f44", 59990),
    "[开心]": ("4aae9dbe27651859ed526bcaad5f1f34", 19788),
    "[禁止色色]": ("d4509efdb82cf39c9c5eabc67c7b03e1", 7739250),
    "[打你]": ("b7f19049a1e3f5814c976fb43934fd04", 2093382),
}


def emoji(col: Column) -> Column:
    """struct(md5, total_length) of an emoji name; null for a name the table lacks."""
    table = F.create_map(
        *[
            item
            for name, (md5, length) in EMOJI.items()
            for item in (
                F.lit(name),
                F.struct(F.lit(md5).alias("md5"), F.lit(length).alias("total_length")),
            )
        ]
    )
    return F.element_at(table, col)


def literal_pattern(find: str, match_case: bool = True, whole_word: bool = False) -> str:
    """Regex matching `find` literally, optionally only between non-word characters."""
    body = re.sub(r"([^\w\s])", r"\\\1", find)
    if whole_word:
        body = f"(?<![{WORD}]){body}(?![{WORD}])"
    return body if match_case else f"(?iu){body}"


# Fixed value: leftover template text on slides.
PLACEHOLDER = r"(?i)\b(?:lorem|ipsum|todo|x{3,})\b|\[insert|this\s+(?:page|slide).+layout"


def has_placeholder(col: Column) -> Column:
    return F.coalesce(col.rlike(PLACEHOLDER), F.lit(False))
