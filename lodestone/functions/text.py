"""Text rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that quote binding ignores (white space and punctuation), and marks
# that scans leave.
PUNCTUATION = "[\\s\u3000，。、；：？！“”‘’\"'（）()\\[\\]【】《》<>—\\-–_…·,.:;?!※◆●★☆→↑↓〓◎§]+"
SCAN_MARKS = "[⺀-⺟⻀-⻳〇○●◇◆□■△▲▽]"
SENTENCE_ENDS = r"[。！？.!?\n]"
CHUNK = 1200


def garbage(text: Column) -> Column:
    """Fewer than 300 characters, or fewer than one sentence end in 100 of the first 2,000."""
    head = F.substring(text, 1, 2000)
    return (F.length(text) < 300) | (F.regexp_count(head, F.lit(SENTENCE_ENDS)) / F.least(F.length(text), F.lit(2000)) < 0.01)


def bind_form(text: Column) -> Column:
    return F.regexp_replace(text, PUNCTUATION.removesuffix("]+") + SCAN_MARKS.removeprefix("[") + "+", "")


def bind(quote: Column, chunk: Column) -> Column:
    """EXACT if the chunk has the quote, NORMALIZED if so without punctuation (6 characters at least), else FAILED."""
    q, c = bind_form(quote), bind_form(chunk)
    return (
        F.when(quote.isNull() | chunk.isNull() | (quote == ""), "FAILED")
        .when(F.contains(chunk, quote), "EXACT")
        .when((F.length(q) >= 6) & F.contains(c, q), "NORMALIZED")
        .otherwise("FAILED")
    )


def chunks(text: Column, size: int = CHUNK) -> Column:
    """Consecutive pieces of ``size`` characters; none of an empty text."""
    n = F.ceil(F.length(text) / size).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substr(text, i * size + 1, F.lit(size))))


def split_point(text: Column) -> Column:
    """Characters before the balanced cut: the first blank line in the 2,000 characters after the
    middle, else the first line end after it; 0 where there is none or the text has under 800."""
    mid = F.floor(F.length(text) / 2).cast("int")
    blank = F.instr(F.substr(text, mid + 1, F.lit(2001)), "\n\n")
    line = F.instr(F.substr(text, mid + 1, F.length(text)), "\n")
    return F.when(F.length(text) < 800, 0).when(blank > 0, mid + blank - 1).when(line > 0, mid + line - 1).otherwise(0).cast("int")


def grams(text: Column, k: int) -> Column:
    """Distinct k-character pieces of the text without white space; a shorter text is its only one.

    The characters are bound as a lambda's variable, so they are made once a text.
    """
    def of(c: Column) -> Column:
        pieces = F.transform(F.sequence(F.lit(0), F.size(c) - k), lambda i: F.concat(*(F.get(c, i + j) for j in range(k))))
        return F.when(F.size(c) >= k, F.array_distinct(pieces)).when(F.get(c, F.lit(0)) != "", F.array(F.array_join(c, ""))).otherwise(F.array().cast("array<string>"))

    return F.get(F.transform(F.array(F.split(F.regexp_replace(text, r"[\s　]+", ""), "")), of), F.lit(0))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets as arrays; 0 where either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def year_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(公元前?\s*[0-9]+|[0-9]{3,4})"), F.lit(1))


# Topic profiles; earlier ones win ties.
TOPICS = [("structure", ["the", "of", "and"]), ("motion", ["ing", "tion", "to"]), ("place", ["in", "at", "on"])]


def topic(text: Column) -> Column:
    """The profile with most keywords contained, an earlier one among equals; 'none' without any."""
    hits = [sum((F.contains(text, F.lit(w)).cast("int") for w in words), F.lit(0)) for _, words in TOPICS]
    best = F.greatest(*hits)
    out = F.when(best == 0, "none")
    for (name, _), h in zip(TOPICS, hits, strict=True):
        out = out.when(h == best, name)
    return out


# Words that are no search terms.
STOP = ["the", "a", "of", "and", "to", "in", "is", "for"]


def query_terms(text: Column, most: int = 12) -> Column:
    """First distinct words of two characters or more that aren't stop words."""
    words = F.split(F.lower(text), r"[\s,.;:!?，。；：！？、]+")
    return F.slice(F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(STOP))), 1, most)


def sentences(text: Column, least: int = 6) -> Column:
    """Trimmed sentences of at least ``least`` characters."""
    return F.filter(F.transform(F.split(text, r"[。！？!?.\n]"), lambda x: F.trim(x)), lambda x: F.length(x) >= least)


def main_text(html: Column) -> Column:
    """Text of a page without scripts, styles, navigation, headers and frames; tags become spaces, blank lines at most one."""
    x = html
    for tag in ("script", "style", "noscript", "nav", "footer", "header", "iframe"):
        x = F.regexp_replace(x, rf"(?is)<{tag}[^>]*>.*?</{tag}>", " ")
    x = F.regexp_replace(x, r"<[^>]+>", " ")
    return F.trim(F.regexp_replace(x, r"\n{3,}", "\n\n"))


def simhash_bits(gram: Column) -> Column:
    """First 8 bytes of a piece's md5, as a signed integer."""
    return F.conv(F.substring(F.md5(gram), 1, 16), 16, -10).cast("long")
