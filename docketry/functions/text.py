"""Text as Column functions: tokens, cleaning, excerpts, chunks, sections, ids, snippets, references."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Index tokens: lower-cased letters (with the Danish three) and digits.
TOKEN = "[a-zæøå0-9]+"
#: HTML entities and what they stand for (fixed values).
ENTITIES = {
    "&nbsp;": " ", "&amp;": "&", "&lt;": "<", "&gt;": ">", "&oslash;": "ø", "&aelig;": "æ", "&aring;": "å", "&Oslash;": "Ø", "&AElig;": "Æ", "&Aring;": "Å",
    "&ndash;": "–", "&mdash;": "—", "&ldquo;": '"', "&rdquo;": '"', "&laquo;": "«", "&raquo;": "»", "&bull;": "•", "&hellip;": "…", "&sect;": "§", "&para;": "¶", "&copy;": "©", "&reg;": "®", "&#167;": "§",
}
#: Kinds of personal data and the patterns that show them (fixed values, without look-around).
PERSONAL = {
    "id-number": r"[0-3][0-9][01][0-9][0-9]{2}[- ]?[0-9]{4}",
    "e-mail": r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[A-Za-z0-9_.]{2,}",
    "phone": r"(^|[^0-9])[0-9]{2} ?[0-9]{2} ?[0-9]{2} ?[0-9]{2}([^0-9]|$)",
    "street": r"[A-ZÆØÅ][a-zæøå]+(vej|gade|allé|alle|vænge|parken|stræde|plads|boulevard|toften) +[0-9]+",
}


def tokens(text: Column, pattern: str = TOKEN) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))


def squeezed(text: Column) -> Column:
    """ASCII white space as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, r"[ \t\n\r\f]+", " "))


def folded(text: Column) -> Column:
    return F.lower(squeezed(F.coalesce(text, F.lit(""))))


def dehyphenated(text: Column) -> Column:
    """Words that a line break parted with a hyphen, joined."""
    return F.regexp_replace(text, r"([0-9A-Za-zæøåÆØÅ_])-[ \t\n\r]+([0-9A-Za-zæøåÆØÅ_])", "$1$2")


def title(text: Column) -> Column:
    """The first line."""
    return F.substring_index(F.coalesce(text, F.lit("")), "\n", 1)


def strip_html(html: Column, headings: bool = False) -> Column:
    """Text of HTML: tags as spaces, entities resolved. With headings, h2 to h6 and bold paragraphs become #-lines
    and block ends become line ends; blank lines come one at a time."""
    x = F.coalesce(html, F.lit(""))
    if headings:
        for tag, mark in (("h2", "##"), ("h3", "###"), ("h[456]", "####")):
            x = F.regexp_replace(x, f"(?is)<{tag}[^>]*>[ \\t\\n\\r]*(.*?)[ \\t\\n\\r]*</{tag}>", f"\n{mark} $1\n")
        x = F.regexp_replace(x, r"(?is)<p[^>]*>[ \t\n\r]*<(?:strong|b)[^>]*>[ \t\n\r]*(.*?)[ \t\n\r]*</(?:strong|b)>[ \t\n\r]*</p>", "\n#### $1\n")
        x = F.regexp_replace(x, r"(?i)</p>|<br[ \t\n\r]*/?>|</div>", "\n")
    x = F.regexp_replace(x, "<[^>]+>", " ")
    for entity, said in ENTITIES.items():
        x = F.replace(x, F.lit(entity), F.lit(said))
    x = F.regexp_replace(x, "&#[0-9]+;", " ")
    if not headings:
        return squeezed(x)
    x = F.regexp_replace(F.regexp_replace(x, r"[ \t]+", " "), " ?\n ?", "\n")
    return F.regexp_replace(F.regexp_replace(x, "\n{3,}", "\n\n"), r"^[ \t\n\r]+|[ \t\n\r]+$", "")


def excerpt(text: Column, width: int = 280) -> Column:
    """The start of the text without heading marks, on one line."""
    return F.substring(squeezed(F.regexp_replace(text, r"(?m)^#{2,3} ", "")), 1, width)


def snippet(text: Column, query: Column, width: int = 320) -> Column:
    """The part of the text around the query's first place, a third of the width before it; marked where cut."""
    said = squeezed(F.coalesce(text, F.lit("")))
    spot = F.instr(F.lower(said), F.lower(F.trim(query)))
    start = F.when(spot > 0, F.greatest(F.lit(0), spot - 1 - width // 3)).otherwise(0)
    end = F.least(F.length(said), start + width)
    return F.concat(F.when(start > 0, F.lit("…")).otherwise(F.lit("")), F.substring(said, start + 1, end - start), F.when(end < F.length(said), F.lit("…")).otherwise(F.lit("")))


def stable_id(*parts: Column, prefix: str = "") -> Column:
    """The first 12 hex digits of the SHA-1 of the parts with a unit separator between them."""
    short = F.substring(F.sha1(F.concat_ws("\x1f", *parts).cast("binary")), 1, 12)
    return F.concat(F.lit(f"{prefix}-"), short) if prefix else short


def windows(words: Column, size: int, overlap: int, stop_at_end: bool = False) -> Column:
    """Overlapping runs of words. A last run may hold only overlap, unless stop_at_end."""
    step, n = size - overlap, F.size(words)
    last = F.greatest(F.lit(0), n - 1 - (overlap if stop_at_end else 0))
    return F.transform(F.sequence(F.lit(0), last, F.lit(step)), lambda i: F.slice(words, i + 1, size))


def quoted(text: Column, least: int = 3, most: int = 250) -> Column:
    """Phrases between quotation marks, squeezed, each once, in order."""
    found = F.regexp_extract_all(text, F.lit(f'["“”„«»]([^"“”„«»]{{{least},{most}}})["“”„«»]'), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, squeezed), lambda x: x != ""))


def personal_data(text: Column) -> Column:
    """Kinds of personal data that the text shows."""
    return F.array_compact(F.array(*(F.when(F.coalesce(text, F.lit("")).rlike(p), F.lit(k)) for k, p in PERSONAL.items())))


def citation_numbers(text: Column, most: int, word: str = "Kilde", span: int = 30) -> Column:
    """Numbers of sources cited as "[Kilde 3, 5-7]", each once, in order, from 1 to most; a range gives span + 1 at most."""
    inside = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"(?i)\[{word}r? +([0-9][^\]]{{0,80}})\]"), F.lit(1))
    parts = F.flatten(F.transform(inside, lambda x: F.regexp_extract_all(x, F.lit("[0-9]+ *[–—-] *[0-9]+|[0-9]+"), F.lit(0))))

    def numbers(part: Column) -> Column:
        low = F.regexp_extract(part, "^[0-9]{1,9}", 0).cast("int")
        high = F.regexp_extract(part, "[0-9]{1,9}$", 0).cast("int")
        return F.when(high < low, F.array().cast("array<int>")).otherwise(F.sequence(low, F.greatest(low, F.least(high, low + span))))

    return F.filter(F.array_distinct(F.flatten(F.transform(parts, numbers))), lambda n: (n >= 1) & (n <= most))


def safe_name(text: Column) -> Column:
    """A file name: Danish letters spelled out, others than letters and digits as single underscores."""
    x = F.lower(text)
    for a, b in (("æ", "ae"), ("ø", "oe"), ("å", "aa")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return F.regexp_replace(F.regexp_replace(x, "[^a-z0-9]+", "_"), "^_+|_+$", "")
