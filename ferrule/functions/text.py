"""Text functions as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words that the tokenizer drops, and the characters that an estimated token has.
STOP_WORDS = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "in", "is", "it", "its", "of", "on", "or", "that", "the", "this", "to", "was", "with"]
CHARS_PER_TOKEN = 3.5

# Fixed values, too: what is an identifier, one of its parts, and a token of a claim.
IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_]*|[0-9]+"
PART = r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+"
CLAIM_TOKEN = r"[A-Za-z_][A-Za-z0-9_]*|[0-9]+(?:\.[0-9]+)?"


def tokens(text: Column) -> Column:
    """Identifiers in lower case, followed by their camel-case and snake-case parts if there are several; stop words dropped, but not inside a whole."""
    stop = F.array(*map(F.lit, STOP_WORDS))

    def of(name: Column) -> Column:
        whole = F.lower(name)
        parts = F.regexp_extract_all(name, F.lit(PART), F.lit(0))
        kept = F.filter(F.transform(parts, lambda p: F.lower(p)), lambda p: ~F.array_contains(stop, p))
        alone = F.when(F.array_contains(stop, whole), F.array().cast("array<string>")).otherwise(F.array(whole))
        return F.when(F.size(parts) > 1, F.concat(F.array(whole), kept)).otherwise(alone)

    return F.flatten(F.transform(F.regexp_extract_all(text, F.lit(IDENTIFIER), F.lit(0)), of))


def claim_tokens(text: Column) -> Column:
    """Distinct identifiers and numbers in lower case, in order of first use."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(CLAIM_TOKEN), F.lit(0)))


def estimate_tokens(text: Column) -> Column:
    """0 for the empty text, else its length over ``CHARS_PER_TOKEN``, rounded up, and 1 at least."""
    return F.when(text == "", 0).otherwise(F.greatest(F.lit(1), F.ceil(F.length(text) / CHARS_PER_TOKEN))).cast("long")


def squeeze(text: Column) -> Column:
    """White space as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, r"[ \t\r\n\f\x0B]+", " "))


def clip(text: Column, n: int) -> Column:
    """At most ``n`` characters, the last of them an ellipsis if some are cut."""
    flat = squeeze(text)
    return F.when(F.length(flat) > n, F.concat(F.substring(flat, 1, n - 1), F.lit("…"))).otherwise(flat)


def first_sentence(text: Column) -> Column:
    """The first sentence of a comment, without inline tags, block tags and markup.

    The comment, up to its first block tag, is a list of words between white space and markup; the sentence ends with the
    first word that closes one, other than a lone mark at the start. White space and tag names are ASCII, as in the SQL.
    """
    unwrapped = F.regexp_replace(text, r"\{@[A-Za-z0-9_]+[ \t\r\n]+([^}]*)\}", "$1")
    lead = F.split(unwrapped, r"\n[ \t\r\n]*@[A-Za-z0-9_]", 2)[0]
    words = F.filter(F.split(lead, r"(?:[ \t\r\n\f\x0B]|<[^>]+>)+"), lambda w: w != "")
    closes = F.transform(words, lambda w, i: w.rlike(r"[.!?]$") & ((i > 0) | (F.length(w) > 1)))
    end = F.array_position(closes, True)
    return F.array_join(F.when(end > 0, F.slice(words, F.lit(1), end.cast("int"))).otherwise(words), " ")


def cut_to_tokens(text: Column, tokens: Column, marker: str = "[... truncated]") -> Column:
    """A struct of the text cut between lines to an estimated number of ``tokens``, and whether it was cut: text, cut.

    Whole lines stay while they fit the room that the marker leaves; the first that does not ends it, and the marker counts
    the lines left out. Lines add up in one fold that only counts, so its state stays small.
    """
    lines = F.split(text, "\n", -1)
    room = F.greatest(F.lit(0), F.floor(tokens * CHARS_PER_TOKEN).cast("int") - len(marker) - 1)
    start = F.struct(F.lit(0).alias("used"), F.lit(0).alias("kept"), F.lit(False).alias("full"))

    def step(acc: Column, line: Column) -> Column:
        used = acc["used"] + F.length(line) + 1
        full = acc["full"] | (used > room)
        return F.struct(F.when(full, acc["used"]).otherwise(used).alias("used"), (acc["kept"] + F.when(full, 0).otherwise(1)).alias("kept"), full.alias("full"))

    kept = F.aggregate(lines, start, step, lambda acc: acc["kept"])
    note = F.concat(F.lit(f"{marker} ("), (F.size(lines) - kept).cast("string"), F.lit(" more lines)"))
    short = F.array_join(F.concat(F.slice(lines, F.lit(1), kept), F.array(note)), "\n")
    over = estimate_tokens(text) > tokens
    return F.struct(F.when(over, short).otherwise(text).alias("text"), over.alias("cut"))


def content_id(*parts: Column) -> Column:
    """16 hex digits that name a row by its parts; null counts as the word None."""
    return F.substring(F.sha1(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("None")) for p in parts])), 1, 16)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once a row however often the body names it: columns on columns would repeat it at each use."""
    return F.transform(F.array(value), body)[0]


# The form of each kind of literal, in the order in which they are tried.
LITERALS = {
    "String": r'^"(?:[^"\\]|\\.)*"$',
    "char": r"^'(?:[^'\\]|\\.)+'$",
    "boolean": r"^(?:true|false)$",
    "long": r"^[-+]?[0-9][0-9_]*[lL]$",
    "int": r"^[-+]?[0-9][0-9_]*$",
    "float": r"^[-+]?(?:[0-9][0-9_]*\.[0-9]*|\.[0-9]+)[fF]$",
    "double": r"^[-+]?(?:[0-9][0-9_]*\.[0-9]*|\.[0-9]+)[dD]?$",
}


def literal_type(text: Column) -> Column:
    """The type of a text that is one literal of a C-like language, white space around it aside, or null."""
    plain = F.regexp_replace(text, r"^[ \t\r\n\f\x0B]+|[ \t\r\n\f\x0B]+$", "")
    return let(plain, lambda p: F.coalesce(*[F.when(p.rlike(form), F.lit(kind)) for kind, form in LITERALS.items()]))


def words_of(name: Column) -> Column:
    """The words of an identifier in lower case."""
    return F.transform(F.regexp_extract_all(name, F.lit(PART), F.lit(0)), lambda w: F.lower(w))


def ratio(found: Column, expected: Column) -> Column:
    """Percent found, null if nothing is expected."""
    return F.when(expected > 0, 100.0 * found / expected)
