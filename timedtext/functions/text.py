"""Column functions over cue and narration text. All are built-in expressions; texts are taken as NFC."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sentence terminators and trailing connectives.
TERMINATORS = ".?!…。？！"
CONNECTIVES = (
    "and but or so because that which who when where if as "
    "và nhưng hoặc vì mà thì hay khi nếu để rằng với còn dù tuy "
    "although though unless until while since after before "
    "however therefore moreover furthermore meanwhile nevertheless"
).split()


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


@cache
def _fold_map() -> tuple[str, str]:
    """Precomposed letters and their base letters, from the Unicode data of Python."""
    pairs = []
    for cp in range(0xC0, 0x1F00):
        c = chr(cp)
        base = "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x))
        if base != c and len(base) == 1:
            pairs.append((c, base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


@cache
def _marks() -> str:
    return "".join(chr(c) for c in range(sys.maxunicode) if 0x300 <= c < 0x370 and unicodedata.combining(chr(c)))


def fold(c: str | Column) -> Column:
    """Lower case without combining marks; letters that do not decompose stay."""
    source, target = _fold_map()
    low = F.lower(_col(c))
    # Text of single bytes has nothing to translate, which would cost a look-up a character.
    return F.when(F.octet_length(low) == F.length(low), low).otherwise(F.translate(low, source + _marks(), target))


@cache
def _changes(rule: str) -> tuple[str, str, dict[str, str]]:
    """Characters that a rule of Python's Unicode data changes: to one or none each, as two texts of which the first is longer, and to several."""
    change = {
        "casefold": lambda c: c.lower().casefold(),
        "nfkd": lambda c: "".join(x for x in unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", c).casefold()) if not unicodedata.combining(x)),
        "marks": lambda c: "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)),
    }[rule]
    one, none, many = {}, [], {}
    for cp in (*range(0xD800), *range(0xE000, 0x20000)):
        c = chr(cp)
        if 0xAC00 <= cp <= 0xD7A3 or (new := change(c)) == (c.lower() if rule == "casefold" else c):
            continue
        if new:
            (one if len(new) == 1 else many)[c] = new
        else:
            none.append(c)
    return "".join([*one, *none]), "".join(one.values()), many


def _changed(c: Column, rule: str) -> Column:
    """``c`` after a rule, by built-in expressions: single characters by one translation, the few longer ones character by character."""
    source, target, many = _changes(rule)
    text = F.translate(c, source, target)
    # One text for the parser: a thousand literals made one by one would take a second a use.
    table = F.expr("map(" + ", ".join(f"'{k}', '{v}'" for k, v in many.items()) + ")")
    codes = sorted(map(ord, many))
    starts = [k for i, k in enumerate(codes) if not i or codes[i - 1] != k - 1]
    ends = [k for i, k in enumerate(codes) if i + 1 == len(codes) or codes[i + 1] != k + 1]
    found = "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in zip(starts, ends)) + "]"
    each = F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))
    return F.when(text.rlike(found), F.array_join(F.transform(each, lambda x: F.coalesce(F.try_element_at(table, x), x)), "")).otherwise(text)


def without_marks(c: str | Column) -> Column:
    """Compatibility forms taken apart and combining marks dropped; the case stays."""
    return _changed(_col(c), "marks")


def has_cjk(c: str | Column) -> Column:
    return _col(c).rlike("[\\u4e00-\\u9fff]")


def cjk_ratio(c: str | Column) -> Column:
    """CJK characters over characters that are not blank; 0 for blank text."""
    solid = F.length(F.regexp_replace(_col(c), "(?U)\\s", ""))
    return F.when(solid > 0, F.regexp_count(_col(c), F.lit("[\\u4e00-\\u9fff]")) / solid).otherwise(F.lit(0.0))


def is_speakable(c: str | Column) -> Column:
    return _col(c).rlike("[\\p{L}\\p{N}]")


def ends_sentence(c: str | Column) -> Column:
    return F.coalesce(F.right(F.rtrim(_col(c)), F.lit(1)).isin(*TERMINATORS), F.lit(False))


def is_incomplete(c: str | Column) -> Column:
    """A trailing comma or connective."""
    t = F.trim(_col(c))
    return t.endswith(",") | t.rlike("(?iU)\\b(" + "|".join(CONNECTIVES) + ")\\s*$")


def alignment_key(c: str | Column) -> Column:
    """Letters and digits only, case-folded: a sharp s is ss, a final sigma a sigma, ligatures are letters. Texts are taken as NFC."""
    low = F.lower(_col(c))
    # Text of single bytes in lower case has nothing to fold, which would cost a look-up a character.
    return F.when(F.octet_length(low) == F.length(low), F.regexp_replace(low, "[^a-z0-9]+", "")).otherwise(F.regexp_replace(_changed(low, "casefold"), "[^\\p{L}\\p{N}]", ""))


def tokens(c: str | Column) -> Column:
    """Distinct folded word tokens longer than one character."""
    def found(low: Column) -> Column:
        words = lambda rule: F.regexp_extract_all(low, F.lit(rule), F.lit(0))
        # On text of single bytes both classes hold the same characters; the plain one is faster.
        return F.array_distinct(F.when(F.octet_length(low) == F.length(low), words("\\w{2,}")).otherwise(words("(?U)\\w{2,}")))

    return F.transform(F.array(fold(c)), found)[0]


def shared_tokens(x: Column, y: Column) -> Column:
    """Tokens of ``x`` that are in ``y``, over those of ``x``; 0 if either has none."""
    return F.when((F.size(x) > 0) & (F.size(y) > 0), F.size(F.array_intersect(x, y)) / F.size(x)).otherwise(F.lit(0.0))


def token_overlap(a: str | Column, b: str | Column) -> Column:
    """Shared tokens over the tokens of the first text; 0 if either has none."""
    # The array of one binds both token lists, so that they are found once.
    both = F.array(F.struct(tokens(a).alias("x"), tokens(b).alias("y")))
    return F.transform(both, lambda t: shared_tokens(t["x"], t["y"]))[0]


def list_overlap(required: str | Column, visible: str | Column, default: float, least: float = 0.45) -> Column:
    """Share of required phrases whose tokens mostly occur in the visible ones; ``default`` when nothing is required."""
    def hits(seen: Column) -> Column:
        def hit(x: Column) -> Column:
            return F.when((F.size(x) > 0) & (F.size(F.array_intersect(x, seen)) / F.size(x) >= least), 1.0).otherwise(0.0)

        return F.aggregate(F.transform(F.transform(_col(required), tokens), hit), F.lit(0.0), lambda s, v: s + v)

    n = F.size(_col(required))
    # An array of one binds the visible tokens, so that they are found once and not once a phrase.
    return F.when(n > 0, F.transform(F.array(tokens(F.array_join(_col(visible), " "))), hits)[0] / n).otherwise(F.lit(default))


def word_count(c: str | Column) -> Column:
    return F.regexp_count(_col(c), F.lit("(?U)\\w+"))


def sentences(c: str | Column) -> Column:
    """Number of sentences: pieces between a closing sign with blanks after it, blank ones apart."""
    pieces = F.split(F.regexp_replace(F.coalesce(_col(c), F.lit("")), "(?U)([.!?…])\\s+", "$1\x00"), "\x00")
    return F.size(F.filter(pieces, lambda x: F.trim(x) != ""))


def voice_seconds(c: str | Column) -> Column:
    """Estimated speaking time: 2.75 words a second and a lead of 0.35 s, held to 2..7 s."""
    return F.bround(F.least(F.lit(7.0), F.greatest(F.lit(2.0), word_count(c) / 2.75 + 0.35)), 3)


def clean_caption(c: str | Column) -> Column:
    """One line; quotes trimmed; runs of dots shortened; blanks around punctuation and decimal commas repaired."""
    t = F.trim(F.regexp_replace(F.replace(_col(c), F.lit("\\N"), F.lit(" ")), "(?U)\\s+", " "))
    t = F.regexp_replace(t, "(?<=[0-9]),\\s+(?=[0-9])", ",")
    t = F.btrim(t, F.lit(" \t\n\"'"))
    t = F.regexp_replace(t, "\\.{4,}", "...")
    t = F.regexp_replace(t, "\\s+([.,!?:;])", "$1")
    return F.regexp_replace(t, ",([^\\s0-9])", ", $1")


def clean_tags(tags: str | Column, most: int = 18) -> Column:
    """Lower-cased tags without ``#`` and punctuation, in first-seen order, at most ``most``."""
    plain = F.transform(_col(tags), lambda t: F.regexp_replace(F.regexp_replace(F.lower(t), "^#+", ""), "(?U)[^\\w-]+", ""))
    return F.slice(F.array_distinct(F.filter(plain, lambda t: t != "")), 1, most)


def name_key(c: str | Column) -> Column:
    """Words of the case-folded text, compatibility forms (ligatures, full-width and circled signs) taken apart, without combining marks."""
    return F.trim(F.regexp_replace(F.regexp_replace(_changed(_col(c), "nfkd"), "[^\\p{L}\\p{N}_]+", " "), " +", " "))


def terms(c: str | Column, stop: list[str] | None = None) -> Column:
    """ASCII tokens of the folded text, without one-letter tokens and stop words, in order."""
    found = F.regexp_extract_all(fold(c), F.lit("[a-z0-9]+"), F.lit(0))
    return F.filter(found, lambda t: (F.length(t) > 1) & ~t.isin(*stop) if stop else F.length(t) > 1)


def recover_json(c: str | Column) -> Column:
    """The JSON object in a reply: a code fence is stripped; else the outermost braces are taken; null if neither parses."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(_col(c)), "^```(?:json)?\\s*", ""), "\\s*```$", ""))
    inner = F.nullif(F.regexp_extract(bare, "(?s)\\{.*\\}", 0), F.lit(""))
    whole = F.when(F.try_parse_json(bare).isNotNull(), bare)
    return F.coalesce(whole, F.when(F.try_parse_json(inner).isNotNull(), inner))
