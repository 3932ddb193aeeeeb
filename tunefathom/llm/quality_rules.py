"""Quality rules: a table of thresholds compiled into one projection of text ratios.

Everything is a built-in expression over one row; nothing is shuffled, joined or handed to Python.

Words are runs of characters other than the ASCII white space 0x09-0x0D and 0x20, lines are separated by ``\\n``.

Defined results: a null or empty text has no words and lines, all its counts are 0 and it is not kept; a text of one
or two words has no three-word window; every other column of the input stays as it is, and result columns replace
input columns of the same name.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tunefathom.functions.numeric import let

WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
#: Very frequent words of the four languages of the corpus; prose in any of them contains some.
STOP_WORDS = {
    "en": ["the", "of", "and", "to", "a", "in", "is", "that", "for", "it", "as", "was", "with", "be", "by", "on", "are", "this", "from", "at", "have", "or", "not"],
    "de": ["der", "die", "das", "und", "in", "den", "von", "zu", "mit", "ist", "nicht", "ein", "eine", "auf", "für", "im", "dem", "sich", "auch", "es", "als", "an"],
    "fr": ["le", "la", "les", "de", "des", "et", "en", "du", "un", "une", "que", "qui", "dans", "pour", "est", "sur", "pas", "par", "au", "il", "ne", "se"],
    "es": ["el", "la", "los", "las", "de", "y", "en", "que", "un", "una", "del", "con", "por", "para", "se", "es", "no", "su", "al", "lo", "como", "más"],
}


@dataclass(frozen=True)
class Rule:
    """A text breaks the rule when ``scale * numerator`` leaves ``low * denominator .. high * denominator``."""
    name: str
    numerator: str
    denominator: str | None
    low: int | None = None
    high: int | None = None
    scale: int = 100


#: All thresholds are whole percentages (or plain numbers where there is no denominator).
RULES = [
    Rule("mean_word_length", "word_chars", "n_words", 200, 1500),
    Rule("symbol_ratio", "n_symbols", "n_words", None, 10),
    Rule("stop_word_ratio", "n_stop_words", "n_words", 2, None),
    Rule("letter_word_ratio", "n_letter_words", "n_words", 60, None),
    Rule("upper_word_ratio", "n_upper_words", "n_words", None, 40),
    Rule("duplicate_line_ratio", "n_dup_lines", "n_lines", None, 50),
    Rule("ellipsis_line_ratio", "n_ellipsis_lines", "n_lines", None, 30),
    Rule("bullet_line_ratio", "n_bullet_lines", "n_lines", None, 90),
]
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def _lines(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: line.rlike(WORD))


def _count(values: Column, holds) -> Column:
    return F.size(F.filter(values, holds)).cast("long")


def repeated_words(all_words: Column) -> Column:
    """How many words lie in a three-word window that occurs at least twice in the text.

    Windows are told apart by 64-bit hashes. Sorting them with their positions brings equal ones together, so the
    work is n log n for a text of n words; it is left out where no hash occurs twice.
    """
    def covered(w: Column) -> Column:
        n = F.size(w)
        # three shifted copies side by side: no lambda looks back into the whole array
        windows = F.arrays_zip(F.slice(w, F.lit(1), n - 2).alias("a"), F.slice(w, F.lit(2), n - 2).alias("b"), F.slice(w, F.lit(3), n - 2).alias("c"))
        hashes = F.transform(windows, lambda x: F.xxhash64(x))
        return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(spans(h)))

    def spans(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            n = F.size(s)
            pairs = F.arrays_zip(s.alias("x"), F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), F.slice(s, F.lit(1), n - 1)).alias("before"),
                                 F.slice(s, F.lit(2), n).alias("after"))
            same = F.filter(pairs, lambda p: (p["x"]["h"] == p["before"]["h"]) | (p["x"]["h"] == p["after"]["h"]))
            return F.sort_array(F.transform(same, lambda p: p["x"]["i"]))
        # a window covers three words, or fewer where the next repeated window begins earlier
        def length(starts: Column) -> Column:
            steps = F.arrays_zip(starts.alias("at"), F.slice(starts, F.lit(2), F.size(starts)).alias("next"))
            return F.aggregate(steps, F.lit(0).cast("long"), lambda total, p: total + F.coalesce(F.least(F.lit(3), p["next"] - p["at"]), F.lit(3)))
        return let(let(ordered, twice), length)

    return let(all_words, lambda w: F.when(F.size(w) < 4, F.lit(0).cast("long")).otherwise(covered(w)))


def _breaks(rule: Rule) -> Column:
    value, base = F.col(rule.numerator) * rule.scale, F.col(rule.denominator) if rule.denominator else F.lit(rule.scale)
    tests = [value < rule.low * base] * (rule.low is not None) + [value > rule.high * base] * (rule.high is not None)
    return reduce(lambda a, b: a | b, tests)


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds every count that the threshold table refers to. Map-only."""
    listed = sorted({w for each in STOP_WORDS.values() for w in each})
    parts = docs.withColumns({"_words": words(F.col(text)), "_lines": _lines(F.col(text))})
    whole = F.coalesce(F.col(text), F.lit(""))
    letter, upper, lower = r"\p{L}", r"\p{Lu}", r"\p{Ll}"
    return parts.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.regexp_replace(whole, r"[\x20\x09-\x0D]+", "")).cast("long"),
        "n_symbols": F.regexp_count(whole, F.lit(SYMBOL)).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": let(F.col("_lines"), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeated_words(F.col("_words")),
        "n_stop_words": _count(F.col("_words"), lambda w: F.lower(w).isin(listed)),
        "n_letter_words": _count(F.col("_words"), lambda w: w.rlike(letter)),
        "n_upper_words": _count(F.col("_words"), lambda w: w.rlike(upper + upper) & ~w.rlike(lower)),
        "n_ellipsis_lines": _count(F.col("_lines"), lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$")),
        "n_bullet_lines": _count(F.col("_lines"), lambda x: x.rlike(r"^[\x20\x09-\x0D]*[•*-][\x20\x09]")),
    }).drop("_words", "_lines")


def quality_rules(docs: DataFrame, text: str = "text", rules: list[Rule] = RULES, min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT) -> DataFrame:
    """All counts, ``base_failed``, the names of the ``broken`` rules and ``kept``, in one projection per row."""
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    broken = F.array_compact(F.array(*[F.when(_breaks(r), F.lit(r.name)) for r in rules])) if rules else F.array().cast("array<string>")
    return measure(docs, text).withColumns({"base_failed": base, "broken": broken}).withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0))


def sql(rules: list[Rule] = RULES) -> str:
    """The same decisions for ``documents`` in DuckDB's SQL."""
    listed = ", ".join("'" + w + "'" for w in sorted({w for each in STOP_WORDS.values() for w in each}))
    tests = []
    for r in rules:
        base = r.denominator or str(r.scale)
        tests += [f"{r.scale} * {r.numerator} < {r.low} * {base}"] * (r.low is not None) + [f"{r.scale} * {r.numerator} > {r.high} * {base}"] * (r.high is not None)
    return f"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS l FROM documents),
windows AS (SELECT doc_id, i, w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) AS s(k) GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(t, '{SYMBOL}')) AS BIGINT) AS n_symbols, CAST(len(l) AS BIGINT) AS n_lines,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
  len(list_filter(w, lambda x: lower(x) IN ({listed}))) AS n_stop_words, len(list_filter(w, lambda x: regexp_matches(x, '\\p{{L}}'))) AS n_letter_words,
  len(list_filter(w, lambda x: regexp_matches(x, '\\p{{Lu}}\\p{{Lu}}') AND NOT regexp_matches(x, '\\p{{Ll}}'))) AS n_upper_words,
  len(list_filter(l, lambda x: regexp_matches(x, '(\\.\\.\\.|…)[\\x20\\x09-\\x0D]*$'))) AS n_ellipsis_lines,
  len(list_filter(l, lambda x: regexp_matches(x, '^[\\x20\\x09-\\x0D]*[•*-][\\x20\\x09]'))) AS n_bullet_lines
  FROM w LEFT JOIN covered c ON w.doc_id = c.doc_id),
v AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT ({' OR '.join(tests)}) AS kept FROM v"""
