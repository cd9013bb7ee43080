"""Text functions of prompts and completions, with Python's rules for white space."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.isspace has it.
SPACE = r"[\s\x1C-\x1F\x85\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"


#: Its letters, one by one.
SPACES = "\t\n\x0b\x0c\r \x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Looks at the ends only."""
    return F.btrim(c, F.lit(SPACES))


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, f"{SPACE}+$", "")


#: White space beyond that of Java's \\s.
_RARE = r"[\x1C-\x1F\x85\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"


def token_count(c: Column) -> Column:
    """Runs of other than white space; the short class where a text has none of the rare kinds."""
    return F.when(c.rlike(_RARE), F.regexp_count(c, F.lit(f"[^{SPACE[1:-1]}]++"))).otherwise(F.regexp_count(c, F.lit(r"\S++")))


def normalized(c: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return strip(F.regexp_replace(c, f"{SPACE}+", " "))


def cleaned(c: Column) -> Column:
    """A problem's text without tags: blanks collapsed within lines, at most one empty line in a row, none at the ends."""
    bare = F.regexp_replace(F.regexp_replace(c, "<[^>]+>", " "), "\r\n?", "\n")
    return strip(F.regexp_replace(F.regexp_replace(bare, "[ \t]+", " "), "\n{3,}", "\n\n"))


def signature(c: Column) -> Column:
    """Tags dropped, white space collapsed, lower case, other than a-z, 0-9 as spaces, collapsed again.

    White space becomes a space like all that is neither a letter nor a digit, so one pass does.
    """
    bare = F.lower(F.when(F.contains(c, F.lit("<")), F.regexp_replace(c, "<[^>]+>", " ")).otherwise(c))
    return F.trim(F.regexp_replace(bare, "[^a-z0-9]++", " "))


def first_words(c: Column, n: int) -> Column:
    return F.substring_index(c, " ", n)


def think_format(c: Column) -> Column:
    """1 where the text opens with one thought, closed somewhere; else 0."""
    return c.rlike(r"(?sm)\A<think>(?!.*<think>)(.*?)</think>.*$").cast("double")


def summary(c: Column, lines: int, most: int) -> Column:
    """The first lines of the stripped text, cut to ``most`` letters with an ellipsis."""
    head = F.array_join(F.slice(F.split(strip(c), "\n"), 1, lines), "\n")
    return F.when(F.length(head) > most, F.concat(rstrip(F.substring(head, 1, max(0, most - 3))), F.lit("..."))).otherwise(head)


#: Fences and elements that hold code.
_FENCE = rf"(?si)```(?:python)?{SPACE}*(.*?){SPACE}*```"
_OPEN = rf"(?si)^{SPACE}*```(?:python)?{SPACE}*\n?"
_ELEMENT = rf"(?si)<CODE>{SPACE}*(.*?){SPACE}*</CODE>"


def response(c: Column) -> Column:
    """Stripped, without byte order marks."""
    return strip(F.replace(c, F.lit("\ufeff"), F.lit("")))


def fenced_blocks(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(_FENCE), 1)


def code_of(c: Column) -> Column:
    """The last fenced block, else what follows a fence that opens the text, else the last <CODE> element, else the text; stripped."""
    c = response(c)
    blocks, tags = fenced_blocks(c), F.regexp_extract_all(c, F.lit(_ELEMENT), 1)
    opened = F.regexp_replace(F.regexp_replace(c, _OPEN, ""), rf"{SPACE}*```+{SPACE}*$", "")
    return strip(F.when(F.size(blocks) > 0, F.element_at(blocks, -1)).when(c.rlike(_OPEN), opened).when(F.size(tags) > 0, F.element_at(tags, -1)).otherwise(c))


def format_ok(c: Column, allowance: int = 0) -> Column:
    """Just one fenced block, or without a fence just one <CODE> element, and at most ``allowance`` letters other than white space outside it."""
    c = response(c)
    outside = lambda pattern: F.length(F.regexp_replace(F.regexp_replace(c, pattern, ""), SPACE, "")) <= max(0, allowance)
    blocks, tags = fenced_blocks(c), F.regexp_extract_all(c, F.lit(_ELEMENT), 1)
    return F.when(F.size(blocks) > 0, (F.size(blocks) == 1) & outside(_FENCE)).when(c.rlike(_OPEN), False).otherwise((F.size(tags) == 1) & outside(_ELEMENT))


def fenced(code: Column, language: str = "python") -> Column:
    return F.concat(F.lit(f"```{language}\n"), code, F.lit("\n```"))


def before_stops(c: Column, stops: list[str]) -> Column:
    """The text up to the earliest stop string."""
    cuts = [F.when(F.contains(c, F.lit(s)), F.instr(c, s) - 1).otherwise(F.length(c)) for s in stops]
    return c.substr(F.lit(1), F.least(*cuts) if len(cuts) > 1 else cuts[0])


def same_text(a: Column, b: Column) -> Column:
    return normalized(a) == normalized(b)


def error_type(c: Column) -> Column:
    """The name of an error: before the colon, after the last dot, in capitals."""
    return F.upper(strip(F.element_at(F.split(F.element_at(F.split(c, ":"), 1), r"\."), -1)))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def complexity_key(given: Column, wanted: Column, index: Column) -> Column:
    """Order of test cases by size: total length, longer side, lines, digits, place."""
    digits = lambda c: F.regexp_count(c, F.lit(r"\p{Nd}"))
    lines = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    return F.struct((F.length(given) + F.length(wanted)).alias("total"), F.greatest(F.length(given), F.length(wanted)).alias("side"), (lines(given) + lines(wanted) + 2).alias("lines"), (digits(given) + digits(wanted)).alias("digits"), index.alias("index"))
