"""Plot numbers and precincts named in the text of an advertisement. Columns only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plotlens.functions.text import without_tags

#: What a plot number, a precinct's number and its name look like in a text.
NUMBER = r"(?:dz(?:\.|ialk\w*)?)\s*(?:ewid\w*\s*)?(?:nr\.?|numer|o\s+numerze)?\s*[:.]?\s*(\d{1,4}(?:/\d{1,4})?)"
PRECINCT_NO = r"(?iU)obr[ęe]b\w*\s*(?:ewidencyjn\w*)?\s*[:.]?\s*(\d{1,4})\b"
PRECINCT_NAME = r"(?U)obr[ęe]b\w*\s*[:.]?\s*([A-ZŁŚŻĆÓ][\w-]+(?:\s+[A-ZŁŚŻĆÓ][\w-]+)?)"
#: Contexts in which the number behind the word is an area.
TRAP = r"(?iU)dzialk\w*\s+(?:o\s+)?(?:pow\.|powierzchni\w*|wielkosci|ma|liczy)\b|dzialk\w*\s*\d+\s*(?:m2|m²|ar|ha)"
#: Characters before and behind a match that are its context, and behind it where further numbers are looked for.
BEFORE, BEHIND, TAIL, MOST = 40, 12, 60, 5


def references(text: Column) -> Column:
    """A struct of ``numbers`` (five at most, in order), ``precinct_no``, ``precinct_name`` and ``sure``: one number only.

    Each match is taken with the text around it by look-behind and look-ahead, so its context can be
    told without positions. The look-behind tries many lengths, so it is made only where a number's word begins.
    A number with a slash that follows a match belongs to the same set.
    """
    plain = without_tags(text)
    whole = F.lit(rf"(?iUs)(?=dz)(?<=(^.{{0,{BEFORE - 1}}}|.{{{BEFORE}}}))({NUMBER})(?=(.{{0,{TAIL}}}))")
    part = lambda i: F.regexp_extract_all(plain, whole, F.lit(i))
    found = F.arrays_zip(part(1).alias("before"), part(2).alias("match"), part(3).alias("number"), part(4).alias("tail"))
    good = F.filter(found, lambda m: ~F.rlike(F.concat(m["before"], m["match"], F.substring(m["tail"], 1, BEHIND)), F.lit(TRAP)))
    more = F.flatten(F.transform(good, lambda m: F.concat(F.array(m["number"]), F.regexp_extract_all(m["tail"], F.lit(r"(\d{1,4}/\d{1,4})"), F.lit(1)))))
    numbers = F.slice(F.array_distinct(F.coalesce(more, F.array().cast("array<string>"))), 1, MOST)
    no = F.nullif(F.regexp_extract(plain, PRECINCT_NO, 1), F.lit(""))
    name = F.when(no.isNull(), F.nullif(F.trim(F.regexp_extract(plain, PRECINCT_NAME, 1)), F.lit("")))
    return F.struct(numbers.alias("numbers"), F.lpad(no, 4, "0").alias("precinct_no"), name.alias("precinct_name"), (F.size(numbers) == 1).alias("sure"))
