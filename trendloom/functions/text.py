"""Text functions, Column to Column. Patterns keep to syntax that Java regex and RE2 share."""

from __future__ import annotations

import html
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Character classes and patterns of the cleaning and hashtag rules.
SPACE = r"\t-\r\x1c-\x20\x85\p{Z}"
WORD = r"\p{L}\p{N}_"
DIGIT = (
    r"\p{Nd}\x{b2}\x{b3}\x{b9}\x{1369}-\x{1371}\x{19da}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}"
    r"\x{2460}-\x{2468}\x{2474}-\x{247c}\x{2488}-\x{2490}\x{24ea}\x{24f5}-\x{24fd}\x{24ff}"
    r"\x{2776}-\x{277e}\x{2780}-\x{2788}\x{278a}-\x{2792}"
)
HASHTAG = rf"(?:^|[{SPACE}])#([{WORD}]+)"
HASHTAG_FROM_SIGN = rf"#(?<=(?:^|[{SPACE}])#)([{WORD}]+)"
ALL_DIGITS = rf"^[{DIGIT}]+$"
MENTION = r"@[0-9A-Za-z_\x{130}\x{131}\x{17f}\x{212a}]+"
URL = rf"(?i)https?:(?://|\\\\)+(?:[{WORD}#@%$()~?+-=\\&](?:#!)?)*"
RETWEET = r"(?i)^RT[: \-]?"
EMOJI_RUN = (
    r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}"
    r"\x{1F900}-\x{1F9FF}\x{2700}-\x{27BF}\x{2600}-\x{26FF}]{2,}"
)
EMOJI_PLANES = r"[\x{2600}-\x{27BF}\x{1F1E0}-\x{1F9FF}]"
EDGE_SPACE = rf"^[{SPACE}]+|[{SPACE}]+$"
WITHOUT_EDGE_SPACE = rf"(?s)^[{SPACE}]*(.*[^{SPACE}])"
TERM = rf"[{WORD}]+"

# Scripts written without spaces (Thai, Lao, Myanmar, Khmer, Kana, Han), with their marks.
SPACELESS = (
    r"\x{e00}-\x{eff}\x{1000}-\x{109f}\x{1780}-\x{17ff}\x{2e80}-\x{2fdf}\x{3005}-\x{3007}\x{3040}-\x{30ff}\x{31f0}-\x{31ff}"
    r"\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{ff66}-\x{ff9f}\x{20000}-\x{323af}"
)
FROM_SPACELESS = r"[^\x00-\x{dff}]"  # any character from the first of them on

# Url prefix of each platform.
PLATFORMS = {
    "https://t.me/": "telegram",
    "https://twitter.com/": "twitter",
    "https://www.youtube.com/": "youtube",
    "https://www.instagram.com/": "instagram",
    "https://www.tiktok.com": "tiktok",
    "https://www.facebook.com": "facebook",
}


def hashtags(c: Column) -> Column:
    """Hashtags with their '#', in text order, repeats kept, tags of digits only left out.

    The pattern starts at the sign and looks back, so that the search can skip to the next '#'.
    """
    found = F.regexp_extract_all(c, F.lit(HASHTAG_FROM_SIGN), 1)
    return F.transform(
        F.filter(found, lambda tag: ~tag.rlike(ALL_DIGITS)), lambda tag: F.concat(F.lit("#"), tag)
    )


@F.pandas_udf(StringType())
def _unescape(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


def unescape_html(c: Column) -> Column:
    """Decode HTML entities; only texts that hold an '&' travel to Python."""
    return F.coalesce(_unescape(F.when(c.contains("&"), c)), c)


def text_transform(fn: Callable[[str], str | None]) -> Callable[[Column], Column]:
    """A user's text function as a Column function, run on Arrow batches; null stays null."""

    @F.pandas_udf(StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(fn, na_action="ignore")

    return run


def strip_mentions(c: Column) -> Column:
    return F.regexp_replace(c, MENTION, " ")


def strip_urls(c: Column) -> Column:
    return F.regexp_replace(c, URL, " ")


def strip_rt(c: Column) -> Column:
    return F.regexp_replace(c, RETWEET, " ")


def strip_emoji_runs(c: Column) -> Column:
    """Runs of two or more emoji; a quick look at their code ranges spares most texts the full pattern."""
    return F.when(c.rlike(EMOJI_PLANES), F.regexp_replace(c, EMOJI_RUN, " ")).otherwise(c)


def ustrip(c: Column) -> Column:
    """Trim all Unicode white space; Spark's ``trim`` takes off U+0020 only."""
    return F.regexp_extract(c, WITHOUT_EDGE_SPACE, 1)


def clean_text(c: Column) -> Column:
    """Entities, mentions, urls, retweet mark, emoji runs, edges. '' marks an unusable text."""
    return ustrip(strip_emoji_runs(strip_rt(strip_urls(strip_mentions(unescape_html(c))))))


def spaced_terms(c: Column) -> Column:
    """Lower-case words of a text, without scripts that are written without spaces."""
    plain = F.regexp_extract_all(F.lower(c), F.lit(TERM), 0)
    rest = F.regexp_extract_all(F.lower(F.regexp_replace(c, f"[{SPACELESS}]+", " ")), F.lit(TERM), 0)
    return F.when(c.rlike(f"[{SPACELESS}]"), rest).otherwise(plain)


def spaceless_runs(c: Column) -> Column:
    """Runs of characters of scripts that are written without spaces; a quick look at where they start spares most texts the search."""
    runs = F.regexp_extract_all(c, F.lit(f"[{SPACELESS}]+"), 0)
    return F.when(c.rlike(FROM_SPACELESS), runs).when(c.isNotNull(), F.array().cast("array<string>"))


def terms(c: Column) -> Column:
    """Words of a text in lower case; of scripts without spaces the pairs of neighbouring characters, or a character that stands alone."""
    pairs = F.regexp_extract_all(c, F.lit(f"(?=([{SPACELESS}]{{2}}|(?<![{SPACELESS}])[{SPACELESS}](?![{SPACELESS}])))[{SPACELESS}]"), 1)
    spaceless = c.rlike(FROM_SPACELESS) & c.rlike(f"[{SPACELESS}]")  # the quick look spares most texts the other
    return F.when(spaceless, F.concat(spaced_terms(c), pairs)).otherwise(F.regexp_extract_all(F.lower(c), F.lit(TERM), 0))


def segments(c: Column) -> Column:
    """Stretches of words, in lower case, that no sign but white space parts; scripts without spaces part them too."""
    signs = f"[^{WORD}{SPACE}]+"
    parted = F.when(c.rlike(FROM_SPACELESS), F.regexp_replace(c, f"[{SPACELESS}]+", "|")).otherwise(c)
    return F.split(F.lower(parted), signs)


def is_blank(c: Column, extra: tuple[str, ...] = ()) -> Column:
    return c.isNull() | c.isin("", "null", *extra)


def platform(url: Column) -> Column:
    """Platform of a url by its prefix; null stays null."""
    named = F.when(url.isNull(), F.lit(None).cast("string"))
    for prefix, name in PLATFORMS.items():
        named = named.when(url.startswith(prefix), name)
    return named.otherwise("unknown")
