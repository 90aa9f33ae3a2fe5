"""JSON that a model wrote: fenced, in prose, cut off, or with commas too many."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_FENCE = r"(?s)```(?:json)?\s*(.*?)```"


def unfenced(text: Column) -> Column:
    """The inside of the first code fence, else all of it, trimmed of white space."""
    return F.regexp_replace(F.when(text.rlike(_FENCE), F.regexp_extract(text, _FENCE, 1)).otherwise(text), r"^\s+|\s+$", "")


def braced(text: Column) -> Column:
    """From the first opening brace to the last closing one; null without both."""
    first, last = F.instr(text, "{"), F.length(text) - F.instr(F.reverse(text), "}") + 1
    return F.when((first > 0) & F.contains(text, F.lit("}")) & (first < last), F.substr(text, first, last - first + 1))


def without_last_commas(text: Column) -> Column:
    """No comma before a closing bracket."""
    return F.regexp_replace(text, r",(\s*[}\]])", "$1")


def completed(text: Column) -> Column:
    """From the first opening brace up to the last place where no element is half written, with what is open closed.

    An automaton over the characters keeps whether it is in a string, whether a backslash came before, and the
    closing brackets that are due.  Elements are whole at commas and closing brackets; after the outermost
    one closes, nothing more is read.  Null without a brace or a whole element."""
    body = F.when(F.instr(text, "{") > 0, F.substr(text, F.instr(text, "{")))
    start = F.struct(
        F.lit(0).alias("at"), F.lit(False).alias("quoted"), F.lit(False).alias("escaped"), F.lit("").alias("due"), F.lit(0).alias("whole"), F.lit("").alias("then"), F.lit(False).alias("over"))

    def step(s: Column, c: Column) -> Column:
        outside = ~s["quoted"]
        opens, closes = outside & c.isin("{", "["), outside & c.isin("}", "]") & (F.substring(s["due"], 1, 1) == c)
        due = F.when(opens, F.concat(F.when(c == "{", "}").otherwise("]"), s["due"])).when(closes, F.substring(s["due"], 2, 1 << 30)).otherwise(s["due"])
        at = s["at"] + 1
        comma = outside & (c == ",") & (s["due"] != "")
        new = F.struct(
            at.alias("at"), F.when(s["escaped"], s["quoted"]).when(c == '"', outside).otherwise(s["quoted"]).alias("quoted"), (s["quoted"] & ~s["escaped"] & (c == "\\")).alias("escaped"), due.alias("due"),
            F.when(closes, at).when(comma, s["at"]).otherwise(s["whole"]).alias("whole"), F.when(closes | comma, due).otherwise(s["then"]).alias("then"), (closes & (due == "")).alias("over"))
        return F.when(s["over"], s).otherwise(new)

    end = F.aggregate(F.split(body, ""), start, step)
    return F.get(F.transform(F.array(end), lambda e: F.when(e["whole"] > 0, F.concat(F.substr(body, F.lit(1), e["whole"]), e["then"]))), F.lit(0))


def parsed(text: Column) -> Column:
    """The value as a variant: the text without its fence, the braced part, that without last commas, and what can be
    completed of it, whichever parses first; null where none does.  Only a text that fails is looked at again."""
    body = unfenced(text)
    part = braced(body)
    return F.coalesce(F.try_parse_json(F.when(body != "", body)), F.try_parse_json(part), F.try_parse_json(without_last_commas(part)), F.try_parse_json(completed(without_last_commas(body))))
