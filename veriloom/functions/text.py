"""Text functions with Unicode white space and word rules stated as explicit classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points that count as white space.
SPACE = r"[\t-\r\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
NOT_WORD = r"[^\p{L}\p{N}_]"


def norm(text: Column) -> Column:
    """White space runs become one space; none is left at the ends."""
    return F.trim(F.regexp_replace(text, SPACE + "+", " "))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+\\z", "")


def clean(text: Column) -> Column:
    return F.coalesce(norm(text), F.lit(""))


def tokens(text: Column) -> Column:
    """Distinct lower-cased words between white space."""
    return F.array_distinct(F.filter(F.split(F.lower(text), SPACE + "+"), lambda t: t != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 1 if both are empty, 0 if one is."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def quote_pattern(token: Column) -> Column:
    return F.regexp_replace(token, r"([\\.\[\]{}()*+?^$|\-#&~])", r"\\$1")


def grounded(token: Column, hay: Column) -> Column:
    """The lower-cased token stands in the hay with no word character at either side."""
    t = F.lower(norm(token))
    return (t != "") & F.regexp_like(hay, F.concat(F.lit(f"(?:^|{NOT_WORD})"), quote_pattern(t), F.lit(f"(?:$|{NOT_WORD})")))


def words(text: Column) -> Column:
    """Runs of word characters, in order."""
    return F.filter(F.split(text, NOT_WORD + "+"), lambda w: w != "")


def word_keys(text: Column) -> Column:
    """Distinct words and pairs of successive words, and ''."""
    # transform over an array of one names the words, so that they are split once
    keys = F.transform(F.array(words(text)), lambda ws: F.concat(F.array(F.lit("")), ws, F.filter(F.zip_with(ws, F.slice(ws, 2, F.size(ws)), lambda a, b: F.concat(a, F.lit(" "), b)), lambda k: k.isNotNull())))
    return F.array_distinct(F.get(keys, F.lit(0)))


def first_key(text: Column) -> Column:
    """The first two words (or the only one, or '')."""
    return F.array_join(F.slice(words(text), 1, 2), " ")


def first_group(text: Column, pattern: str) -> Column:
    """The first group of the first match (the match if there is none); null without a match."""
    import re

    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1 if re.compile(pattern).groups else 0))


def split_list(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), strip), lambda x: x != "")


def inverted_index_text(index: Column) -> Column:
    """map<word, array<int>> back to text: words in order of position; the later word wins a place."""
    entries = F.flatten(F.transform(F.map_entries(index), lambda e, i: F.transform(e["value"], lambda p: F.struct(p.alias("p"), (-i).alias("i"), e["key"].alias("w")))))
    ordered = F.array_sort(F.filter(entries, lambda s: s["p"].isNotNull()))
    # transform over an array of one names the sorted places, so that they are sorted once
    won = F.transform(F.array(ordered), lambda o: F.filter(o, lambda s, k: (k == 0) | (F.get(o, k - 1)["p"] != s["p"])))
    return F.coalesce(F.array_join(F.transform(F.get(won, F.lit(0)), lambda s: s["w"]), " "), F.lit(""))
