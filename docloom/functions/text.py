"""Text scalars as column expressions; all of them stay in generated code."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

UNIT = "\x1f"

# Markers that decide a requirement's strength.
DEFINE_MARKERS = (" means ", " refers to ", "is defined as", " is a term for")
CONSTRAINT_MARKERS = (" if ", " when ", " unless ", "cannot", " only if ")
# Slot rules in order; the first slot with a keyword in the text wins.
SLOT_RULES = (
    ("exception", ("may not", "error", "cannot", "unavailable", "problem", "trouble", "warning", "caution", "hazard", "malfunction")),
    ("user_setting", ("customize", "preference")),
    ("hmi", ("steering wheel switch", "voice command", "long press", "double-tap")),
)
DEFAULT_SLOT = "requirements"
OVERVIEW_SLOT = "overview"
#: Order of the slots in a rendered page.
SLOT_ORDER = ("overview", "requirements", "hmi", "user_setting", "exception", "other", "safety")
STRENGTHS = ("define", "constraint", "capability")
STATUSES = ("unfilled", "from_manual", "measured", "estimated", "decided", "not_applicable")

BULLETS = "●•▪○◦■"
LABEL_LENGTH = 30


def normalise(s: Column) -> Column:
    """Lower case, dashes to spaces, no other signs, single spaces (TXT-1)."""
    s = F.regexp_replace(F.lower(s), "[-‐‑‒–—―]+", " ")
    s = F.regexp_replace(s, r"(?U)[^\w\s]", "")
    return strip(F.regexp_replace(s, r"(?U)\s+", " "))


def strip(s: Column) -> Column:
    """Without Unicode white space at both ends; trim() knows the space only."""
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def content_id(*parts: Column, length: int = 12) -> Column:
    """Prefix of the SHA-256 of the parts, joined by U+001F (TXT-2). Nulls count as empty."""
    return F.substring(F.sha2(F.concat_ws(UNIT, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, length)


@F.pandas_udf(StringType())
def slugify(s: pd.Series) -> pd.Series:
    """ASCII words joined by hyphens (TXT-3). Spark has no compatibility decomposition, so this one is vectorised Python."""
    flat = s.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode().lower())
    out = flat.str.replace(r"[^a-z0-9]+", "-", regex=True).str.strip("-")
    return out.where(out.isna() | (out != ""), "untitled")


def function_filename(number: Column, slug: Column) -> Column:
    """`<number>-<slug>.md`, the slug cut to 80 characters (TXT-4)."""
    return F.concat_ws("", number.cast("string"), F.lit("-"), F.rtrim(F.substring(slug, 1, 80), F.lit("-")), F.lit(".md"))


def clean_title(s: Column) -> Column:
    """Without leading numbering, unless nothing else is left (TXT-5)."""
    return F.coalesce(F.nullif(strip(F.regexp_replace(s, r"(?U)^\s*[\d.\-]+\s+", "")), F.lit("")), strip(s))


def clean_bookmark(s: Column) -> Column:
    """Without C1 controls (TXT-6)."""
    return strip(F.regexp_replace(s, "[\\u0080-\\u009f]", ""))


def clean_glyphs(s: Column) -> Column:
    """Private-use glyphs go; empty quotes stood around an icon (TXT-6)."""
    return F.regexp_replace(F.regexp_replace(s, "[\\ue000-\\uf8ff]", ""), '""|“”', "[icon]")


def strip_arrows(s: Column) -> Column:
    """Without the arrow glyphs of a running head, which read as the letter u (TXT-7)."""
    return F.regexp_replace(s, '(?:(?<!\\S)|(?<=[a-z]))u+(?=[A-Z0-9"])', " ")


def strip_note_glyph(s: Column) -> Column:
    return F.regexp_replace(s, r"^u(?=[A-Z])", "")


def strip_heading_marker(s: Column) -> Column:
    return F.regexp_replace(s, r"(?U)^■\s*", "")


def join_lines(lines: Column) -> Column:
    """Lines of a paragraph as one text; a hyphen before a lower-case start joins words (TXT-9)."""
    kept = F.filter(F.transform(lines, strip), lambda x: x != "")
    return F.aggregate(
        kept,
        F.lit(""),
        lambda acc, x: F.when(acc == "", x)
        .when(acc.rlike(r"(?U)\w-$") & x.rlike(r"(?U)^\p{Ll}"), F.concat(F.regexp_replace(acc, "-$", ""), x))
        .otherwise(F.concat(acc, F.lit(" "), x)),
    )


def _any(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def strength(s: Column) -> Column:
    """define, constraint or capability (TXT-10)."""
    low = F.lower(s)
    return F.when(_any(low, DEFINE_MARKERS), "define").when(_any(low, CONSTRAINT_MARKERS), "constraint").otherwise("capability")


def slot(s: Column, rules: tuple = SLOT_RULES) -> Column:
    """The first slot with a keyword in the text, else the default (TXT-11)."""
    low = F.lower(s)
    out = None
    for name, words in rules:
        out = F.when(_any(low, words), name) if out is None else out.when(_any(low, words), name)
    return F.lit(DEFAULT_SLOT) if out is None else out.otherwise(DEFAULT_SLOT)


# Fixed values: (flag, condition on the stripped text) for signs of a bad extraction (TXT-12).
ANOMALIES = (
    ("replacement_char", "�"),
    ("pua_glyph", "[\\ue000-\\uf8ff]"),
    ("orphan_lead", "^[>\\]\\)\\}»”’]"),
    ("orphan_trail", "[<\\[\\(\\{«“‘]$"),
    ("bullet_leftover", "[●•▪○◦]"),
)


def anomalies(s: Column) -> Column:
    """The flags that hold for a text, in fixed order. What is left without signs at its ends decides if it is too short; nothing left is no flag."""
    t = strip(s)
    left = F.regexp_replace(s, "^[ .:,;-]+|[ .:,;-]+$", "")
    flags = [F.when(t.rlike(p), F.lit(name)) for name, p in ANOMALIES] + [F.when(F.length(left).between(1, 2), F.lit("too_short"))]
    return F.filter(F.array(*flags), lambda x: x.isNotNull())


def looks_like_label(s: Column) -> Column:
    """A control's name: no page reference, and every Latin word starts upper-case (TXT-13)."""
    words = F.regexp_extract_all(s, F.lit("[A-Za-z]+"), F.lit(0))
    return ~s.rlike(r"^P\.?\s*[0-9]") & (F.size(words) > 0) & F.forall(words, lambda w: w.rlike("^[A-Z]"))


def is_running_label(s: Column) -> Column:
    """A line short and letter-bearing enough for a running head (FLT-11)."""
    t = strip(s)
    n = normalise(s)
    return (t != "") & ~t.rlike("[.!?:;]$") & (F.length(n) <= LABEL_LENGTH) & n.rlike("[a-zA-Z]")


def html_escape(s: Column) -> Column:
    return F.replace(F.replace(F.replace(s, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def diagram_label(s: Column, width: int = 60) -> Column:
    """Safe within a diagram's quotes, cut with an ellipsis (TXT-15)."""
    t = F.replace(F.replace(s, F.lit('"'), F.lit("'")), F.lit("\n"), F.lit(" "))
    return F.when(F.length(t) > width, F.concat(F.substring(t, 1, width - 1), F.lit("…"))).otherwise(t)


def natural_key(filename: Column) -> Column:
    """Sort key of `<n>-slug.md`; files without a number come last (TXT-16)."""
    n = F.nullif(F.regexp_extract(filename, "^([0-9]{1,9})-", 1), F.lit("")).try_cast("int")
    return F.struct(F.coalesce(n, F.lit(1_000_000_000)).alias("n"), filename.alias("name"))


def chapter_name(slug: Column) -> Column:
    return F.initcap(F.replace(slug, F.lit("-"), F.lit(" ")))


def production_filename(s: Column) -> Column:
    """Whether a line holds a typesetter's file name (FLT-2)."""
    return s.rlike(r"(?i)\.(?:book|fm|mif|indd|docx?|framemaker)\b")


# Model years, and words that are no part of a model's name.
YEAR = r"\b(19[89]\d|20[0-4]\d)\b"
NO_MODEL = ("owner's", "owners", "manual", "guide", "navigation")


def year(s: Column) -> Column:
    """The first model year, 1980 to 2049 (TXT-14)."""
    return F.nullif(F.regexp_extract(s, YEAR, 1), F.lit(""))


def identity(text: Column, makers: list[str]) -> Column:
    """struct(maker, model, year, evidence) read from a cover text (TXT-14).

    The maker is the first of the list that the text holds; the model is made of up to two of the three words behind it that are
    neither a year nor in NO_MODEL.
    """
    text = strip(text)
    low = F.lower(text)
    maker, model = F.lit(None).cast("string"), F.lit(None).cast("string")
    for m in reversed(makers):
        tail = F.regexp_extract(text, rf"(?iU)\Q{m}\E\s+([A-Za-z0-9][\w-]*(?:\s+[A-Za-z0-9][\w-]*){{0,2}})", 1)
        words = F.slice(F.filter(F.split(F.regexp_replace(tail, "(?U)" + YEAR, ""), r"(?U)\s+"), lambda w: ~F.btrim(F.lower(w), F.lit(".,")).isin(*NO_MODEL) & (w != "")), 1, 2)
        has = F.contains(low, F.lit(m.lower()))
        maker = F.when(has, F.lit(m)).otherwise(maker)
        model = F.when(has, F.nullif(F.array_join(words, " "), F.lit(""))).otherwise(model)
    return F.struct(maker.alias("maker"), model.alias("model"), year(text).alias("year"), F.substring(text, 1, 200).alias("evidence"))
