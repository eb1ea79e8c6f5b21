"""Text columns of pages and documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

HIDDEN = ("script", "style", "noscript", "svg", "template")
FRAME = ("nav", "footer", "header", "aside", "form", "iframe")
#: Words that carry no topic.
STOP_WORDS = (
    "a about after all also an and any are as at be because been before being between both but by can come could did do does "
    "doing down during each few for from further get got has had he her here hers him his how i if in into is it its just like "
    "make made may me might more most my no nor not now of off on once one only or other our out over own same she should so "
    "some such than that the their them then there these they this those through to too under until up very was we well were "
    "what when where which while who whom why will with would you your page home post content image https http www com org "
    "net blog article read using use used new even also"
).split()
_ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))


def without(html: Column, tags: tuple[str, ...]) -> Column:
    """html with the blocks of these tags as a space each."""
    return F.regexp_replace(html, rf"(?is)<({'|'.join(tags)})\b[^>]*>.*?</\1\s*>", " ")


def plain(html: Column) -> Column:
    """Text of markup: tags as spaces, common entities decoded, white space collapsed."""
    bare = F.regexp_replace(html, r"(?s)<[^>]*>", " ")
    decoded = reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), _ENTITIES, bare)
    return F.trim(F.regexp_replace(decoded, r"\s+", " "))


def visible(html: Column) -> Column:
    """What a reader sees: comments and hidden blocks gone."""
    return plain(without(F.regexp_replace(html, r"(?s)<!--.*?-->", " "), HIDDEN))


def main_text(html: Column) -> Column:
    """The article, main or body text outside the page's frame."""
    inner = without(without(F.regexp_replace(html, r"(?s)<!--.*?-->", " "), HIDDEN), FRAME)
    pick = lambda tag: F.nullif(F.regexp_extract(inner, rf"(?is)<{tag}\b[^>]*>(.*)</{tag}\s*>", 1), F.lit(""))
    return plain(F.coalesce(pick("main"), pick("article"), pick("body"), inner))


def words(text: Column) -> Column:
    """Letters, digits and apostrophes in a row that hold a letter or digit."""
    return F.filter(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}']+"), F.lit(0)), lambda w: w.rlike(r"[\p{L}\p{N}]"))


def sentences(text: Column) -> Column:
    """Stretches up to their end signs; a text without any is one sentence."""
    # what follows the last end sign is cut off before, as each of its places would be tried up to the end of the text
    ended = F.regexp_extract(text, r"(?s)^(.*[.!?])", 1)
    found = F.regexp_extract_all(ended, F.lit(r"[^.!?]+[.!?]+"), F.lit(0))
    return F.when(F.size(found) > 0, found).when(F.trim(text) != "", F.array(text)).otherwise(F.array().cast("array<string>"))


def syllables(word: Column) -> Column:
    """Vowel groups of a word's ASCII letters once a silent ending is off."""
    bare = F.regexp_replace(F.lower(word), "[^a-z]", "")
    stem = F.regexp_replace(F.regexp_replace(bare, "(?:[^laeiouy]es|ed|[^laeiouy]e)$", ""), "^y", "")
    groups = F.size(F.regexp_extract_all(stem, F.lit("[aeiouy]{1,2}"), F.lit(0)))
    return F.when(bare == "", 0).when(F.length(bare) <= 3, 1).otherwise(F.greatest(groups, F.lit(1)))


def syllable_count(ws: Column) -> Column:
    return F.aggregate(F.transform(ws, syllables), F.lit(0), lambda a, x: a + x)


def half_up(x: Column, digits: int = 0) -> Column:
    """Rounding with halves toward plus infinity."""
    return F.floor(x * 10**digits + 0.5) / 10**digits


def pct(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, 0.0).otherwise(half_up(100 * part / F.nullif(whole, F.lit(0))))


def flesch(words_: Column, sentences_: Column, syllables_: Column) -> Column:
    """Reading ease 0-100; null under eight words."""
    n = F.greatest(sentences_, F.lit(1))
    score = 206.835 - 1.015 * words_ / n - 84.6 * syllables_ / words_
    return F.when(words_ >= 8, F.least(F.lit(100.0), F.greatest(F.lit(0.0), score)))


def shingles(ws: Column, k: int) -> Column:
    """Stretches of k words in order, repeats included; a set is for groupBy to make, not for an array.

    The array is shifted k times as a whole: inside a lambda it would be made anew for each word."""
    n = F.greatest(F.size(ws) - k + 1, F.lit(0))
    shifted = F.arrays_zip(*[F.slice(ws, j + 1, n).alias(f"w{j}") for j in range(k)])
    return F.transform(shifted, lambda x: F.concat_ws(" ", *[x[f"w{j}"] for j in range(k)]))


def normal_text(text: Column) -> Column:
    """Lower case, no URLs, letters and digits of ASCII alone."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(text), r"https?://\S+", " "), "[^a-z0-9 ]", " "), " +", " "))
