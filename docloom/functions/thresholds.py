"""Detection of vaguely stated quantities (TVF-2), in column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import content_id, strip

# Units, and numbers with them.
_TIME = r"(?:seconds?|sec\.?|minutes?|min\.?|hours?|hrs?)"
_UNITS = r"(?:seconds?|sec\.?|minutes?|min\.?|hours?|hrs?|miles?|mi\.?|km|kilometers?|feet|ft\.?|meters?|m\b|%|percent)"
NUMBER = rf"([0-9]+(?:\.[0-9]+)?)\s*({_UNITS})"
PAREN_NUMBER = rf"\(\s*([0-9]+(?:\.[0-9]+)?)\s*({_UNITS})\s*\)"
WINDOW = 60

# Fixed values: (id, kind, unit where none is named, pattern). Output follows this order.
PATTERNS = (
    ("vague_duration", "duration", "time", r"\b(?:a\s+certain\s+(?:period\s+of\s+)?time|for\s+a\s+while|after\s+a\s+(?:short|brief)\s+(?:time|period)|(?:shortly|briefly)\s+(?:after|before))\b"),
    ("vague_extreme", "range", None, r"\btoo\s+(?:short|long|far|close|high|low|fast|slow)\b"),
    ("vague_limit", "limit", None, r"\bthe\s+(?:upper|lower|maximum|minimum)\s+limit\b"),
    ("vague_distance", "distance", "distance", r"\b(?:nearby|in\s+the\s+vicinity|a\s+short\s+distance)\b"),
    ("vague_frequency", "frequency", None, r"\b(?:periodically|from\s+time\s+to\s+time|occasionally)\b"),
    ("vague_few_duration", "duration", "time", rf"\ba\s+few\s+{_TIME}\b"),
    ("vague_certain_quantity", "quantity", "as stated", r"\ba\s+certain\s+(?:level|degree|amount)\s+of\s+[A-Za-z]+\b"),
    ("vague_speed", "speed", "speed", r"\b(?:high|low)\s+speed\b"),
    ("vague_repeatedly", "count", "times", r"\brepeatedly\b[^.]{0,80}\buntil\b|\buntil\b[^.]{0,80}\brepeatedly\b"),
    ("vague_certain_count", "count", "times", r"\ba\s+certain\s+number\s+of\s+times\b"),
    ("vague_stated_duration", "duration", "time", rf"\bfor\s+[0-9]+\s+{_TIME}\b|\b[0-9]+\s+{_TIME}\s+(?:have\s+)?elapsed\b"),
)

#: Words of which a text must hold one for the pattern to match; they spare most texts the pattern itself.
KEYWORDS = {
    "vague_duration": ("certain", "while", "after", "shortly", "briefly"),
    "vague_extreme": ("too",),
    "vague_limit": ("limit",),
    "vague_distance": ("nearby", "vicinity", "distance"),
    "vague_frequency": ("periodically", "from", "occasionally"),
    "vague_few_duration": ("few",),
    "vague_certain_quantity": ("certain",),
    "vague_speed": ("speed",),
    "vague_repeatedly": ("repeatedly",),
    "vague_certain_count": ("certain",),
    "vague_stated_duration": ("for", "elapsed"),
}


def matches(text: Column, pattern: str, words: tuple[str, ...] = (), lowered: Column | None = None) -> Column:
    """array<struct<at int, hit string>>: non-overlapping matches and where they start.

    Texts whose lower-cased form holds none of the words (if given) match nothing. The starts come from the lengths of the pieces between the matches.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    found = F.aggregate(
        F.zip_with(pieces, hits, lambda p, h: F.struct(p.alias("p"), h.alias("h"))),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<at:int,hit:string>>").alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["p"]) + F.coalesce(F.length(x["h"]), F.lit(0))).alias("at"),
            F.when(x["h"].isNull(), acc["out"])
            .otherwise(F.concat(acc["out"], F.array(F.struct((acc["at"] + F.length(x["p"])).alias("at"), x["h"].alias("hit")))))
            .alias("out"),
        ),
        lambda acc: acc["out"],
    )
    low = F.lower(text) if lowered is None else lowered
    held = reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words], F.lit(not words))
    return F.when(held & text.rlike(pattern), found).otherwise(F.array().cast("array<struct<at:int,hit:string>>"))


def _found(text: Column, lowered: Column, no: int, name: str, kind: str, hint: str | None, pattern: str) -> Column:
    """Matches of one pattern with what is known of it."""
    return F.transform(
        matches(text, "(?i)" + pattern, KEYWORDS[name], lowered),
        lambda m: F.struct(
            F.lit(no).alias("pattern_no"), F.lit(name).alias("pattern_id"), F.lit(kind).alias("kind"), F.lit(hint).cast("string").alias("hint"), m["at"].alias("at"), m["hit"].alias("matching_text")
        ),
    )


def detect(rows: DataFrame, text: str = "text", source: str = "source") -> DataFrame:
    """A row for each match: the columns of rows and threshold_id, pattern_id, pattern_no, kind, at, matching_text, context, unit, value, status, evidence.

    A number with a unit within 60 characters of the match seeds the value; for a quantity a
    number in parentheses anywhere does too, kept with its unit. All patterns are tried
    in one pass over a row and nothing is shuffled.
    """
    found = [_found(F.col(text), F.col("_low"), k, *rule) for k, rule in enumerate(PATTERNS)]
    df = rows.withColumn("_low", F.lower(text)).withColumn("_m", F.explode(F.flatten(F.array(*found))))
    df = df.select(*rows.columns, "_m.*")
    start = F.greatest(F.col("at") - WINDOW, F.lit(0))
    stop = F.least(F.col("at") + F.length("matching_text") + WINDOW, F.length(text))
    df = df.withColumn("_w", strip(F.substr(F.col(text), start + 1, stop - start)))
    quantity = F.col("kind") == "quantity"
    near = F.col("_w").rlike("(?i)" + NUMBER)
    far = quantity & ~near & F.col(text).rlike("(?i)" + PAREN_NUMBER)
    pick = lambda k: F.when(near, F.regexp_extract("_w", "(?i)" + NUMBER, k)).when(far, F.regexp_extract(F.col(text), "(?i)" + PAREN_NUMBER, k))
    number, unit = pick(1), pick(2)
    value = F.when(quantity, F.concat_ws(" ", number, unit)).otherwise(number)
    named = F.when(F.col("pattern_id") == "vague_few_duration", F.regexp_extract("matching_text", rf"(?i)({_TIME})$", 1))
    seeded = near | far
    return df.select(
        *rows.columns,
        content_id(F.lit("threshold"), F.col(source), F.col("matching_text"), F.col("at")).alias("threshold_id"),
        "pattern_id", "pattern_no", "kind", "at", "matching_text", strip(F.col(text)).alias("context"),
        F.when(seeded & ~quantity, unit).when(seeded, F.col("hint")).otherwise(F.coalesce(named, F.col("hint"))).alias("unit"),
        F.when(seeded, value).alias("value"),
        F.when(seeded, "from_manual").otherwise("unfilled").alias("status"),
        F.when(seeded, F.concat(F.lit('Stated in the OM: "'), value, F.lit('"'))).alias("evidence"),
    )
