"""Column functions over text: tokens, term sets, similarity, answer normalization, evidence rendering."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The token pattern, the words left out of term sets, and the punctuation of answer normalization.
TOKEN = r"([A-Za-z0-9]+(?:'[A-Za-z0-9]+)?)"
STOP = (
    "a an and are as at be by for from has he in is it its of on that the to was were will with which what who when where why how "
    "did do does into than then their them this those these or if during after before over under about"
).split()
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
WORDS_ONLY = r"(?U)\s+"


def let(x: Column, f) -> Column:
    """f(x) with x computed once, also where f uses it inside lambdas that run many times."""
    return F.element_at(F.transform(F.array(x), f), 1)


def tokens(x: Column) -> Column:
    """Lower-case ASCII word tokens in order, repeats kept; null text gives an empty list."""
    return F.transform(F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(TOKEN), F.lit(1)), F.lower)


def terms(x: Column) -> Column:
    """The distinct tokens that aren't stop words, in order of first appearance."""
    stop = F.array(*map(F.lit, STOP))
    return F.array_distinct(F.array_except(tokens(x), stop))


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two lists of distinct terms: 1 if both are empty, 0 if one is."""
    case = lambda x, y: F.when((F.size(x) == 0) & (F.size(y) == 0), 1.0).when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))
    return let(F.struct(a.alias("x"), b.alias("y")), lambda s: case(s["x"], s["y"]))


def squeeze(x: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.regexp_replace(F.regexp_replace(x, WORDS_ONLY, " "), r"^ | $", "")


def normalize_answer(x: Column) -> Column:
    """Lower case, no ASCII punctuation, no articles, single spaces; null gives an empty string."""
    bare = F.translate(F.lower(F.coalesce(x, F.lit(""))), PUNCTUATION, "")
    return squeeze(F.regexp_replace(bare, r"(?U)\b(a|an|the)\b", " "))


def space_count(x: Column) -> Column:
    """Number of white-space separated parts, at least 1."""
    t = squeeze(F.coalesce(x, F.lit("")))
    return F.greatest(F.lit(1), F.when(t == "", 0).otherwise(F.size(F.split(t, " "))))


def paragraph_text(sentences: Column) -> Column:
    """The sentences without outer white space, blank and null ones left out, joined by spaces."""
    clean = F.transform(F.coalesce(sentences, F.array().cast("array<string>")), lambda s: F.regexp_replace(s, r"(?U)^\s+|(?<!\s)\s+$", ""))
    return F.array_join(F.filter(clean, lambda s: s.isNotNull() & (s != "")), " ")


def numbers(x: Column) -> Column:
    """All runs of digits, in order."""
    return F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(r"(\d+)"), F.lit(1))


def same_numbers(a: Column, b: Column) -> Column:
    """True if both hold the same numbers in the same order, and at least one."""
    return (F.size(numbers(a)) > 0) & (numbers(a) == numbers(b))


def contains_answer(answer: Column, evidence: Column) -> Column:
    """True if the normalized answer isn't empty and occurs in the normalized evidence."""
    n = normalize_answer(answer)
    return (n != "") & F.contains(normalize_answer(evidence), n)


def excerpt(x: Column, limit: int = 420) -> Column:
    """The non-blank lines joined by spaces; if longer than limit, cut and closed with three dots."""
    lines = F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), "\n"), lambda s: F.regexp_replace(s, r"(?U)^\s+|(?<!\s)\s+$", "")), lambda s: s != "")
    one = F.array_join(lines, " ")
    return F.when(F.length(one) <= limit, one).otherwise(F.concat(F.regexp_replace(F.substring(one, 1, limit - 3), r"(?U)(?<!\s)\s+$", ""), F.lit("...")))


def strip_answer_labels(x: Column) -> Column:
    """A generated text without leading 'assistant' and 'final answer' labels, however many, and without outer white space."""
    return F.regexp_replace(F.regexp_replace(x, r"(?U)^\s+|(?<!\s)\s+$", ""), r"(?i)^(?:(?:assistant|final answer)\s*:?\s*)+", "")


def slug(x: Column) -> Column:
    """Lower case, with every run of other characters than letters and digits as one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(x), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def render(selected: Column, titles: bool = True) -> Column:
    """Evidence text of a list of structs (title, text): a block for each title in order of first appearance, or the bare texts."""
    if not titles:
        return F.array_join(F.transform(selected, lambda s: s["text"]), "\n")
    heads = F.array_distinct(F.transform(selected, lambda s: s["title"]))
    block = lambda t: F.concat(F.lit("Title: "), t, F.lit("\n"), F.array_join(F.transform(F.filter(selected, lambda s: s["title"] == t), lambda s: F.concat(F.lit("- "), s["text"])), "\n"))
    return F.array_join(F.transform(heads, block), "\n\n")


def parse_evidence(x: Column) -> Column:
    """The (title, text) structs that rendered evidence lists: the inverse of render with titles; null gives an empty list."""
    item = "struct<title:string,text:string>"
    start = F.struct(F.lit("").alias("title"), F.array().cast(f"array<{item}>").alias("out"))
    step = lambda a, s: (
        F.when(F.startswith(s, F.lit("Title: ")), F.struct(F.substring(s, 8, 1 << 30).alias("title"), a["out"].alias("out")))
        .when(F.startswith(s, F.lit("- ")), F.struct(a["title"].alias("title"), F.concat(a["out"], F.array(F.struct(a["title"].alias("title"), F.substring(s, 3, 1 << 30).alias("text")))).alias("out")))
        .otherwise(a)
    )
    return F.aggregate(F.split(F.coalesce(x, F.lit("")), "\n"), start, step, lambda a: a["out"])


def sentence_list(context: Column) -> Column:
    """All sentences of a context as structs title, sent_id, text; null titles count as empty."""
    none = F.array().cast("array<struct<title:string,sentences:array<string>>>")
    return F.flatten(F.transform(F.coalesce(context, none), lambda p: F.transform(F.coalesce(p["sentences"], F.array().cast("array<string>")), lambda s, i: F.struct(F.coalesce(p["title"], F.lit("")).alias("title"), i.alias("sent_id"), s.alias("text")))))


def evidence_keys(evidence: Column, sentences: Column) -> Column:
    """The distinct support keys (title, sent_id) that rendered evidence holds: each line's first sentence of the same title and text in sentence_list."""
    found = lambda s: F.get(F.filter(sentences, lambda c: (c["title"] == s["title"]) & (c["text"] == s["text"])), F.lit(0))
    keys = F.transform(F.filter(F.transform(parse_evidence(evidence), found), lambda c: c.isNotNull()), lambda c: F.struct(c["title"].alias("title"), c["sent_id"].alias("sent_id")))
    return F.array_distinct(keys)


# The same definitions for single texts, for the selectors that run in Python.

_TOKEN_RE = re.compile(TOKEN)
_STOP_SET = frozenset(STOP)


def token_list(x: str | None) -> list[str]:
    """As tokens()."""
    return [t.lower() for t in _TOKEN_RE.findall(x or "")]


def term_list(x: str | None) -> list[str]:
    """As terms()."""
    return [t for t in dict.fromkeys(token_list(x)) if t not in _STOP_SET]


def joined(sentences: list[str | None] | None) -> str:
    """As paragraph_text()."""
    return " ".join(t for t in (s.strip() for s in sentences or [] if s is not None) if t)


def part_count(x: str | None) -> int:
    """As space_count()."""
    return max(1, len((x or "").split()))
