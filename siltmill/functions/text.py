"""Text functions as column expressions: tokens, n-grams, digests, normal forms, set similarity."""

from __future__ import annotations

import re

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What parts words. Both read Unicode; they differ on marks and joiners only.
NON_WORD = {"minhash": r"(?U)\W", "simhash": r"[^\p{L}\p{N}_]"}


def tokens(text: Column | str, flavour: str = "minhash") -> Column:
    """Words in lower case, without empty ones."""
    return F.filter(F.split(F.lower(text), NON_WORD[flavour]), lambda x: x != "")


def has_words(text: Column | str, n: int) -> Column:
    """Whether there are n words at least, as size(tokens()) >= n says, but read no further than the n-th one; null for a null text."""
    if not 1 <= n <= 100:
        return F.size(tokens(text)) >= n
    # lower case makes no word of what is none, nor the other way round
    return F.rlike(F.col(text) if isinstance(text, str) else text, F.lit(rf"(?U)^\W*+(?:\w++\W++){{{n - 1}}}\w"))


def ngrams(words: Column, n: int, min_length: int = 5) -> Column:
    """Runs of n words joined by spaces; too short a text has none, one of fewer than n words a single run."""
    if n < 0:
        raise ValueError("n can't be negative")
    none = F.array().cast("array<string>")
    if n == 0:
        return F.when(words.isNotNull(), none)

    def runs(w: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))
        return F.when(F.size(w) < min_length, none).when(F.size(w) < n, F.array(F.array_join(w, " "))).otherwise(each)

    # a lambda's variable holds the words, which would else be made again for every run
    return F.when(words.isNotNull(), F.transform(F.array(words), runs)[0])


def ngram_set(text: Column | str, n: int, min_length: int = 5, flavour: str = "minhash") -> Column:
    return F.array_distinct(ngrams(tokens(text, flavour), n, min_length))


_WORDS = {"minhash": regex.compile(r"\w+"), "simhash": re.compile(r"\w+")}


def word_runs(text: str, n: int, min_length: int = 5, flavour: str = "minhash") -> dict[str, None]:
    """ngram_set() in Python, for functions that hash the n-grams there; a dict for its order."""
    words = _WORDS[flavour].findall(text.lower())
    if len(words) < min_length or n == 0:
        return {}
    if len(words) < n:
        return {" ".join(words): None}
    return dict.fromkeys(words if n == 1 else map(" ".join, zip(*(words[i:] for i in range(n)))))


def digest(data: Column | str, kind: str = "md5", raw: bool = False) -> Column:
    """MD5, SHA-1 or SHA-256, as hex or as bytes."""
    made = {"md5": F.md5, "sha1": F.sha1, "sha256": lambda c: F.sha2(c, 256)}[kind](data)
    return F.unhex(made) if raw else made


def normalize(line: Column | str) -> Column:
    """Stripped, in lower case, every digit 0, without punctuation, symbols and control characters."""
    line = F.lower(F.regexp_replace(line, r"(?U)^\s+|\s+$", ""))
    return F.regexp_replace(F.regexp_replace(line, r"\p{Nd}", "0"), r"[\p{P}\p{C}\p{S}]+", "")


NEWS_SIGNS = "\"#$%&\\()*+/:;<=>@[]^_`{|}~.?,!'"


def news_text(text: Column | str) -> Column:
    """Hyphenated line ends joined, other line ends spaces, listed signs and all but ASCII left out."""
    joined = F.replace(F.replace(F.col(text) if isinstance(text, str) else text, F.lit("-\n"), F.lit("")), F.lit("\n"), F.lit(" "))
    return F.regexp_replace(F.translate(joined, NEWS_SIGNS, ""), r"[^\x00-\x7F]", "")


def title_and_abstract(title: Column | str, abstract: Column | str) -> Column:
    """A paper's title and abstract as one text in lower case; a null counts as empty."""
    one = lambda c: F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    return F.lower(F.concat(one(title), F.lit(" "), one(abstract)))


def jaccard(a: Column, b: Column) -> Column:
    """Shared part of two sets; two empty ones are equal."""
    shared = F.size(F.array_intersect(a, b))
    whole = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b)) - shared
    return F.when(whole == 0, F.lit(1.0)).otherwise(shared / whole)


def set_precision(truth: Column, found: Column) -> Column:
    """Found ones that are true; 0 where nothing was found."""
    return F.when(F.size(found) == 0, 0.0).otherwise(F.size(F.array_intersect(truth, found)) / F.size(found))


def set_recall(truth: Column, found: Column) -> Column:
    """True ones that were found; 1 where there is nothing to find."""
    return F.when(F.size(truth) == 0, 1.0).otherwise(F.size(F.array_intersect(truth, found)) / F.size(truth))


def f1(precision: Column, recall: Column) -> Column:
    return F.when(precision + recall == 0, 0.0).otherwise(2 * precision * recall / (precision + recall))


def verdict(truth: Column, found: Column) -> Column:
    """TN or FN where nothing was found; TP where all true ones were, else FP."""
    return (
        F.when((F.size(found) == 0) & (F.size(truth) == 0), "TN")
        .when(F.size(found) == 0, "FN")
        .when((F.size(truth) > 0) & (F.size(F.array_except(truth, found)) == 0), "TP")
        .otherwise("FP")
    )
