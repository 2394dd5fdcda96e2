"""Text functions as Column expressions: tokens, hashes, normal forms, shingles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Start of the 64-bit FNV-1a hash, the salts of words and of word pairs, the negation words of tokens, and the
#: negation words, prefixes and antonyms of sentence pairs.
FNV_OFFSET = 0xCBF29CE484222325
WORD_SALT = 0x3456789012345678
BIGRAM_SALT = 0x0F1E2D3C4B5A6978
NEGATIONS = ("not", "no", "never", "nobody", "nothing", "none", "neither", "nor", "cannot", "without", "nowhere", "hardly", "isnt", "dont")
NLI_NEGATIONS = ("not", "no", "never", "nothing", "none", "nobody", "nowhere", "neither", "nor", "cannot", "without")
NLI_PREFIXES = ("un", "dis", "non")
ANTONYMS = (
    ("win", "lose"), ("open", "close"), ("open", "shut"), ("arrive", "depart"), ("arrive", "leave"), ("enter", "exit"), ("buy", "sell"), ("give", "take"),
    ("love", "hate"), ("increase", "decrease"), ("rise", "fall"), ("gain", "lose"), ("accept", "reject"), ("allow", "forbid"), ("appear", "disappear"), ("stay", "leave"),
    ("start", "stop"), ("begin", "finish"), ("remember", "forget"), ("hold", "release"), ("push", "pull"), ("fill", "empty"), ("expand", "shrink"), ("succeed", "fail"),
)
BUCKETS = 1 << 17
LOW32 = 4294967295


def tokens(text: Column) -> Column:
    """Blank-separated pieces with trimmed edges, without the empty ones: found by one pattern in one pass over the text."""
    return F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9](?:[^ \t\n\f\r]*[A-Za-z0-9])?"), F.lit(0))


def _fnv(items: Column, salt: int) -> Column:
    """FNV-1a of an array of byte values, in two halves of 32 bits so that nothing overflows (the prime is 2^40 + 435)."""
    start = FNV_OFFSET ^ salt
    zero = F.struct(F.lit(start >> 32).cast("bigint").alias("hi"), F.lit(start & LOW32).cast("bigint").alias("lo"))

    def step(h: Column, b: Column) -> Column:
        x = h["lo"].bitwiseXOR(b)
        hi = (h["hi"] * 435 + F.shiftright(x * 435, 32) + x * 256).bitwiseAND(F.lit(LOW32))
        return F.struct(hi.alias("hi"), (x * 435).bitwiseAND(F.lit(LOW32)).alias("lo"))

    return F.aggregate(items, zero, step, lambda h: F.shiftleft(h["hi"], 32).bitwiseOR(h["lo"]))


def _fold(b: Column) -> Column:
    """A byte with A-Z lower-cased."""
    return F.when(b.between(65, 90), b + 32).otherwise(b)


def word_hash(word: Column) -> Column:
    """Salted hash of a word's bytes, A-Z lower-cased, as a signed 64-bit number."""
    raw = F.hex(word.cast("binary"))
    byte = lambda i: F.conv(F.substring(raw, 2 * i + 1, 2), 16, 10).cast("bigint")
    values = F.transform(F.sequence(F.lit(0), F.octet_length(word) - 1), byte)
    return _fnv(F.transform(values, _fold), WORD_SALT)


def bigram_hash(a: Column, b: Column) -> Column:
    """Salted hash of two word hashes, low byte first; their bytes are folded like letters."""
    parts = lambda h: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.expr("0L") + F.call_function("shiftrightunsigned", h, 8 * i).bitwiseAND(F.lit(255)))
    return _fnv(F.transform(F.concat(parts(a), parts(b)), _fold), BIGRAM_SALT)


def leak_normal(text: Column) -> Column:
    """Lower case, white space to single blanks, then only a-z, 0-9 and blanks (so double blanks can remain), trimmed."""
    lowered = F.regexp_replace(F.lower(text), r"[ \t\n\x0b\f\r]+", " ")
    return F.trim(F.regexp_replace(lowered, "[^a-z0-9 ]", ""))


def characters(text: Column) -> Column:
    """Array of a text's characters."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def char_grams(chars: Column, k: int) -> Column:
    """Distinct substrings of k of an array of characters; the whole string if it is shorter, none if it is empty.

    chars should be a column, not an expression: it is read for every place.
    """
    n = F.size(chars)
    grams = F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.array_join(F.slice(chars, i, k), ""))
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(grams))


def runs(text: Column) -> Column:
    """Runs of a-z and 0-9 of the lower-cased text."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != "")


def hygiene_tokens(text: Column) -> Column:
    return runs(F.regexp_replace(text, "'", ""))


def nli_tokens(text: Column) -> Column:
    """Runs after n't has become not."""
    return runs(F.regexp_replace(F.lower(text), "n't", " not"))


def word_grams(words: Column, n: int) -> Column:
    """Distinct sequences of n words, joined by blanks."""
    count = F.size(words) - n + 1
    grams = F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.array_join(F.slice(words, i, n), " "))
    return F.when(count < 1, F.array().cast("array<string>")).otherwise(F.array_distinct(grams))


def input_bucket(text: Column) -> Column:
    """The first four runs, joined by blanks."""
    return F.array_join(F.slice(runs(text), 1, 4), " ")


def is_negation(token: Column) -> Column:
    """A negation word in either case, or a longer token that ends in n't or n"t."""
    return F.lower(token).isin(list(NEGATIONS)) | ((F.char_length(token) > 3) & token.rlike("n['\"][tT]$"))


def nli_features(premise: Column, hypothesis: Column) -> list[Column]:
    """Ten numbers of a sentence pair's tokens (arrays): Jaccard, share of the hypothesis in the premise, ratio of lengths, negations
    of either side and their difference (3 at most), shared numbers and those of the hypothesis only, words that meet their negated
    form and antonyms (3 at most). No tokens count as one where they divide."""
    p, h = F.array_distinct(premise), F.array_distinct(hypothesis)
    shared, least = F.size(F.array_intersect(p, h)), lambda n: F.greatest(n, F.lit(1))
    negations = lambda ws: F.size(F.filter(ws, lambda w: w.isin(list(NLI_NEGATIONS))))
    capped = lambda n: F.least(n, F.lit(3)).cast("double")
    numbers = lambda ws: F.filter(ws, lambda w: w.rlike("^[0-9]+$"))
    denied = lambda ws, pre: F.transform(F.filter(ws, lambda w: F.char_length(w) >= 3), lambda w: F.concat(F.lit(pre), w))
    crossed = sum((F.size(F.array_intersect(denied(a, pre), b)) for pre in NLI_PREFIXES for a, b in ((p, h), (h, p))), F.lit(0))
    has = F.array_contains
    opposed = sum((((has(p, a) & has(h, b)) | (has(p, b) & has(h, a))).cast("int") for a, b in ANTONYMS), F.lit(0))
    return [
        (shared / least(F.size(F.array_union(p, h)))).alias("jaccard"),
        (shared / least(F.size(h))).alias("contained"),
        (F.size(hypothesis) / least(F.size(premise))).alias("length_ratio"),
        capped(negations(hypothesis)).alias("neg_hypothesis"),
        capped(negations(premise)).alias("neg_premise"),
        capped(F.abs(negations(hypothesis) - negations(premise))).alias("neg_diff"),
        F.size(F.array_intersect(numbers(p), numbers(h))).cast("double").alias("numbers_shared"),
        F.size(F.array_except(numbers(h), numbers(p))).cast("double").alias("numbers_new"),
        capped(crossed).alias("denied"),
        capped(opposed).alias("opposed"),
    ]


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct elements; 1 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def dedup_key(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[ \t\n\x0b\f\r]+", " "))


def common_prefix(a: Column, b: Column) -> Column:
    """Number of equal leading tokens (arrays), case ignored."""
    n = F.least(F.size(a), F.size(b))
    same = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.lower(F.get(a, i)) == F.lower(F.get(b, i)))
    broken = F.array_position(same, F.lit(False))
    return F.when(n == 0, 0).when(broken == 0, n).otherwise((broken - 1).cast("int"))
