"""Column functions over texts, ids and hashes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the data model.
FPS = 12.5
FRAME_MICROS = 80_000
FRAME_SAMPLES = 1_920
PAD, EPAD = 151_669, 151_670
PLACEHOLDER = 2_048
CODEBOOKS = 8

SPACE = r"[ \t\n\x0B\f\r]+"
_checks: dict[str, Callable[[Column], Column]] = {}


def words(text: Column) -> Column:
    """Words parted by white space, without empty ones."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def _only(text: Column, letters: str) -> Column:
    """The characters that are of a class."""
    return F.regexp_replace(text, f"[^{letters}]+", "")


def _share(text: Column, target: str, others: str, score: Callable[[Column], Column]) -> Column:
    """``score`` of the target's share of all letters; 0.0 without a letter.

    An array of one binds the letters to a variable: the text is gone through once, and the target is looked for among its letters only.
    """
    share = lambda kept: F.when(F.length(kept) > 0, score(F.length(_only(kept, target)) / F.length(kept))).otherwise(0.0)
    return F.transform(F.array(_only(text, target + others)), share)[0]


def script_ratio(text: Column, target: str = "가-힣", others: str = "A-Za-z") -> Column:
    """F1: letters of the target script over all letters; 0.0 without a letter."""
    return _share(text, target, others, lambda share: share)


def english_ratio(text: Column, target: str = "가-힣", others: str = "A-Za-z") -> Column:
    """F2: what is left of 1 where there are letters, else 0.0."""
    return _share(text, target, others, lambda share: 1 - share)


def word_limit_compliance(text: Column, n: int = 10) -> Column:
    """1.0 up to ``n`` words, n / words beyond."""
    size = F.size(words(text))
    return F.when(size <= n, 1.0).otherwise(n / size)


def is_empty(text: Column) -> Column:
    """nothing but white space, tabs and newlines included."""
    return text.rlike(rf"^{SPACE[:-1]}*$")


def repetition_rate(text: Column, n: int = 3) -> Column:
    """share of word n-grams that repeat an earlier one; 0.0 under n + 1 words."""

    def rate(w: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))
        return F.when(F.size(w) < n + 1, 0.0).otherwise(F.transform(F.array(grams), lambda g: 1 - F.size(F.array_distinct(g)) / F.size(g))[0])

    # An array of one binds the words to a variable: they are split once, not once an n-gram.
    return F.transform(F.array(words(text)), rate)[0]


def frame_of(micros: Column) -> Column:
    """frame of a time in microseconds, in integers."""
    return F.floor(micros / F.lit(FRAME_MICROS)).cast("long")


def slot_and_role(codebook: Column, k: int = CODEBOOKS) -> tuple[Column, Column]:
    """place within its role, and role, of a codebook."""
    return codebook % k, F.floor(codebook / k).cast("long")


def strip_nonspoken(text: Column) -> tuple[Column, Column]:
    """F8: the text without think and tool_call spans, and the number of words in those spans."""
    pattern = r"(?s)<think>.*?</think>|<tool_call>.*?</tool_call>"
    spans = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    silent = F.aggregate(spans, F.lit(0), lambda s, x: s + F.size(words(x)))
    return F.regexp_replace(text, pattern, ""), silent


def hash32(text: Column) -> Column:
    """The first 32 bits of md5 as a long: the source of all reproducible choices."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def uniform(text: Column) -> Column:
    """A reproducible number in (0, 1)."""
    return (hash32(text) + 0.5) / F.lit(float(2**32))


def register_check(name: str, check: Callable[[Column], Column]) -> None:
    """Add a score of texts under a name, for ``check``."""
    _checks[name] = check


def check(name: str, text: Column) -> Column:
    return _checks[name](text)


register_check("script", script_ratio)
register_check("english", english_ratio)
register_check("word_limit", word_limit_compliance)


#: F1-F5 as SQL functions of a text: name, result type and body. A body uses those before it.
SQL_CHECKS = {
    "spoken_words": ("ARRAY<STRING>", "filter(split(text, '[ \\\\t\\\\n\\\\x0B\\\\f\\\\r]+'), w -> w <> '')"),
    "script_ratio": ("DOUBLE", "aggregate(array(regexp_replace(text, concat('[^', wanted, others, ']+'), '')), 0D, (s, k) -> CASE WHEN length(k) > 0 THEN length(regexp_replace(k, concat('[^', wanted, ']+'), '')) / length(k) ELSE 0D END)"),
    "english_ratio": ("DOUBLE", "aggregate(array(regexp_replace(text, concat('[^', wanted, others, ']+'), '')), 0D, (s, k) -> CASE WHEN length(k) > 0 THEN 1 - length(regexp_replace(k, concat('[^', wanted, ']+'), '')) / length(k) ELSE 0D END)"),
    "word_limit": ("DOUBLE", "CASE WHEN size(spoken_words(text)) <= most THEN 1D ELSE most / size(spoken_words(text)) END"),
    "is_blank": ("BOOLEAN", "text RLIKE '^[ \\\\t\\\\n\\\\x0B\\\\f\\\\r]*$'"),
    "repetition_rate": (
        "DOUBLE",
        "aggregate(array(spoken_words(text)), 0D, (s, w) -> CASE WHEN size(w) < n + 1 THEN 0D ELSE 1 - size(array_distinct(transform(sequence(1, size(w) - n + 1), i -> array_join(slice(w, i, n), ' ')))) / (size(w) - n + 1) END)",
    ),
}
SQL_ARGUMENTS = {
    "script_ratio": "text STRING, wanted STRING DEFAULT '가-힣', others STRING DEFAULT 'A-Za-z'", "english_ratio": "text STRING, wanted STRING DEFAULT '가-힣', others STRING DEFAULT 'A-Za-z'",
    "word_limit": "text STRING, most INT DEFAULT 10", "repetition_rate": "text STRING, n INT DEFAULT 3",
}


def register_sql_check(spark: SparkSession, name: str, body: str, returns: str = "DOUBLE", arguments: str = "text STRING") -> None:
    """A temporary SQL function of this session: a check that ``spark.sql`` queries call by name. Spark puts its body in their plans, so there is nothing to call at run time."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {returns} RETURN {body}")


def register_sql(spark: SparkSession) -> None:
    """F1-F5 as SQL functions."""
    for name, (returns, body) in SQL_CHECKS.items():
        register_sql_check(spark, name, body, returns, SQL_ARGUMENTS.get(name, "text STRING"))
