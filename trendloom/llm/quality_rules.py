"""Quality rules: a table of thresholds compiled into one projection of built-in functions."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom.llm.common import words

SYMBOLS = "#*$%&|<>"
WINDOW = 8  # words; three doublings in ``_repeats``
PUNCTUATION = ".,;:!?\"'()"

# The commonest function words of the corpus languages.
STOP_WORDS = [
    "the", "of", "and", "to", "a", "in", "that", "is", "was", "for", "it", "with", "as", "on", "be", "by", "are", "this", "from", "at",
    "der", "die", "und", "das", "von", "zu", "den", "mit", "sich", "des", "auf", "ist", "im", "dem", "nicht", "ein", "eine", "als", "für",
    "de", "la", "que", "el", "en", "y", "los", "del", "se", "las", "un", "por", "con", "no", "una", "su", "para", "al",
    "le", "et", "les", "du", "une", "est", "dans", "qui", "par", "pour", "au", "sur", "pas", "avec",
]


class Rule(NamedTuple):
    """A row passes where ``measure`` lies from ``least`` to ``most``; a bound of None is open."""

    name: str
    measure: str
    least: float | None = None
    most: float | None = None


# Bounds on the ratios of ``MEASURES``.
RULES = [
    Rule("word_length", "mean_word_length", 2.0, 12.0),
    Rule("symbols", "symbols_per_word", None, 0.1),
    Rule("capitals", "capital_share", None, 0.3),
    Rule("stop_words", "stop_word_share", 0.02, None),
    Rule("repeated_lines", "repeated_line_share", None, 0.3),
]


RESULT = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_capitals", "n_chars_all", "n_bytes", "n_stop", "n_repeat_words"]


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """The counts that rules are made of, as columns.

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words as in ``judged``; n_chars_all and n_bytes of the whole text;
    n_lines (lines with a word), n_capitals (characters A-Z), n_stop (words in ``STOP_WORDS`` in lower case and without
    punctuation at their ends). Columns of ``docs`` with such a name are replaced. Inner columns begin with ``_q_``.

    Each level is a projection of its own, and what a level reads more than once is not computed again.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    level = docs.withColumns({"_q_text": body, "_q_words": words(body), "_q_lines": F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    level = level.withColumns(
        {
            "n_words": F.size("_q_words").cast("long"),
            "word_chars": F.length(F.array_join("_q_words", "")).cast("long"),
            "n_symbols": F.regexp_count("_q_text", F.lit(f"[{SYMBOLS}]")).cast("long"),
            "n_lines": F.size("_q_lines").cast("long"),
            "n_dup_lines": (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long"),
            "n_capitals": F.regexp_count("_q_text", F.lit("[A-Z]")).cast("long"),
            "n_chars_all": F.length("_q_text").cast("long"),
            "n_bytes": F.octet_length("_q_text").cast("long"),
            "n_stop": F.size(F.filter("_q_words", lambda w: F.lower(F.btrim(w, F.lit(PUNCTUATION))).isin(STOP_WORDS))).cast("long"),
            "_q_hashes": F.transform("_q_words", lambda w: F.xxhash64(w)),
        }
    ).drop("_q_words", "_q_lines", "_q_text")
    return _repeats(level)


def _repeats(level: DataFrame) -> DataFrame:
    """n_repeat_words: words covered by windows of 8 words that occur twice or more in the text.

    Windows are compared by 64-bit hashes inside their own text, each made of two of half its width. Only a text that repeats
    a window sorts its windows.
    """

    def joined(column: str, step: int) -> Column:
        h = F.col(column)
        later = F.slice(h, step + 1, F.greatest(F.size(h) - step, F.lit(0)))
        return F.zip_with(F.slice(h, 1, F.size(later)), later, lambda a, b: F.xxhash64(a, b))

    level = level.withColumn("_q_two", joined("_q_hashes", 1)).drop("_q_hashes")
    level = level.withColumn("_q_four", joined("_q_two", 2)).drop("_q_two")
    level = level.withColumn("_q_windows", joined("_q_four", 4)).drop("_q_four")
    w = F.col("_q_windows")
    repeats = F.size(F.array_distinct(w)) < F.size(w)
    placed = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    level = level.withColumn("_q_placed", F.when(repeats, placed)).drop("_q_windows")
    p = F.col("_q_placed")
    again = F.transform(p, lambda x, j: F.when((x.h == F.get(p, j - 1).h) | (x.h == F.get(p, j + 1).h), x.i))
    level = level.withColumn("_q_starts", F.when(F.size(p) > 0, F.sort_array(F.array_compact(again)))).drop("_q_placed")
    s = F.col("_q_starts")
    covered = F.transform(s, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(s, j + 1) - x, F.lit(WINDOW))))
    total = F.aggregate(covered, F.lit(0).cast("long"), lambda a, b: a + b)
    return level.withColumn("n_repeat_words", F.coalesce(F.when(F.size(s) > 0, total), F.lit(0).cast("long"))).drop("_q_starts")


# Ratios by name; null where there is nothing to measure, which passes. Stop words are asked of Latin script alone, which
# takes less than three bytes for two characters.
MEASURES = {
    "mean_word_length": "word_chars / nullif(n_words, 0)",
    "symbols_per_word": "n_symbols / nullif(n_words, 0)",
    "capital_share": "n_capitals / nullif(word_chars, 0)",
    "stop_word_share": "if(2 * n_bytes < 3 * n_chars_all, n_stop / nullif(n_words, 0), null)",
    "repeated_line_share": "n_dup_lines / nullif(n_lines, 0)",
}


def compiled(rules: list[Rule]) -> dict[str, Column]:
    """One boolean per rule: whether the row passes."""
    out = {}
    for rule in rules:
        x = F.expr(MEASURES[rule.measure])
        bounds = [x >= F.lit(rule.least)] if rule.least is not None else []
        bounds += [x <= F.lit(rule.most)] if rule.most is not None else []
        passed = F.lit(True)
        for bound in bounds:
            passed = passed & bound
        out[f"passes_{rule.name}"] = F.coalesce(passed, F.lit(True))
    return out


def judged(docs: DataFrame, rules: list[Rule] | None = None, text: str = "text") -> DataFrame:
    """``docs`` with counts, one ``passes_<rule>`` per rule, ``base_failed`` and ``kept``.

    A word is a run of other characters than ASCII white space. word_chars: code points in words; n_symbols: characters of
    ``#*$%&|<>``; n_dup_lines: lines with a word that equal an earlier line; n_repeat_words: words in 8-word windows found
    twice or more in the text. base_failed: fewer than 20 words, or over 30 % of the words repeated. kept: not base_failed and
    all rules passed.

    Null and empty texts have counts of 0 and fail the base. Repeated rows are judged each. An empty table gives an empty
    one. Columns of ``docs`` named like a result are replaced, all others stay.
    """
    rules = RULES if rules is None else rules
    result = measured(docs, text)
    result = result.withColumns(compiled(rules))
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    verdict = F.lit(True)
    for rule in rules:
        verdict = verdict & F.col(f"passes_{rule.name}")
    result = result.withColumns({"base_failed": base, "kept": ~base & verdict})
    own = [c for c in result.columns if c not in docs.columns or c in COUNTS or c in ("base_failed", "kept") or c.startswith("passes_")]
    # A generator of one row keeps the optimizer from moving a later filter on the verdict below, where each level's columns
    # would be written out in full wherever the next level reads them.
    return result.select(*[c for c in docs.columns if c not in own], F.inline(F.array(F.struct(*own))))


def oracle(rules: list[Rule] | None = None) -> str:
    """The DuckDB twin of ``judged`` over ``documents``, without the pass columns."""
    measures = {
        "mean_word_length": "word_chars / nullif(n_words, 0)",
        "symbols_per_word": "n_symbols / nullif(n_words, 0)",
        "capital_share": "n_capitals / nullif(word_chars, 0)",
        "stop_word_share": "CASE WHEN 2 * n_bytes < 3 * n_chars_all THEN n_stop / nullif(n_words, 0) END",
        "repeated_line_share": "n_dup_lines / nullif(n_lines, 0)",
    }
    tests = []
    for rule in RULES if rules is None else rules:
        x = f"({measures[rule.measure]})"
        tests += [f"coalesce({x} >= {rule.least}, true)"] if rule.least is not None else []
        tests += [f"coalesce({x} <= {rule.most}, true)"] if rule.most is not None else []
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
windows AS (SELECT r, i, array_to_string(w[i:i + 7], ' ') AS k FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM w)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS n FROM windows) WHERE n >= 2),
covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY r),
m AS (SELECT w.r, doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
        CAST(len(regexp_extract_all(t, '[{SYMBOLS}]')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, len(l) AS n_lines, len(regexp_extract_all(t, '[A-Z]')) AS n_capitals,
        length(t) AS n_chars_all, strlen(t) AS n_bytes,
        len(list_filter(w, lambda x: lower(trim(x, '{PUNCTUATION.replace("'", "''")}')) IN ({stop}))) AS n_stop
      FROM w LEFT JOIN covered c ON c.r = w.r),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {" AND ".join(tests)} AS kept FROM b"""
