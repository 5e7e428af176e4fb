"""Text functions as Column expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Consonant groups of the phonetic code.
SOUND_LETTERS = "bfpvcgjkqsxzdtlmnr"
SOUND_DIGITS = "111122222222334556"

#: Anything but letters and digits separates tokens.
SEPARATORS = r"[^\p{L}\p{N}]+"
#: CAS numbers, hazard codes and locants such as 1,2- stay whole; then plain words.
DOMAIN_TOKEN = r"\d{2,7}-\d{2}-\d|[hHpP]\d{3}(?:\+[hHpP]\d{3})*|\d+(?:,\d+)*-[\p{L}][\p{L}\p{N}-]*|[\p{L}\p{N}]+"


def normalised(c: Column) -> Column:
    """Lower case without white space at either end, also beyond plain spaces."""
    return F.lower(F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))


def kgrams(c: Column, k: int = 3) -> Column:
    """Distinct k-grams of the lower-cased text between two ``$``; the whole if shorter."""
    padded = F.concat(F.lit("$"), F.lower(c), F.lit("$"))
    last = F.greatest(F.length(padded) - (k - 1), F.lit(1))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(padded, i, F.lit(k))))


def sound_code(c: Column) -> Column:
    """Four-character phonetic code.

    Only letters count; vowels and h, w, y separate equal codes; the first letter stays.
    Without letters the code is 0000.
    """
    letters = F.regexp_replace(F.lower(c), r"[^\p{L}]", "")
    codes = F.regexp_replace(F.translate(letters, SOUND_LETTERS, SOUND_DIGITS), "[^0-9]", "0")
    for digit in "0123456":
        codes = F.regexp_replace(codes, digit + "+", digit)
    digits = F.replace(F.substring(codes, F.lit(2), F.length(codes)), F.lit("0"), F.lit(""))
    code = F.substring(F.concat(F.upper(F.substring(letters, 1, 1)), digits, F.lit("000")), 1, 4)
    return F.when(letters == "", F.lit("0000")).otherwise(code)


def tokens(c: Column) -> Column:
    """Lower-cased tokens in order."""
    return F.filter(F.split(F.lower(c), SEPARATORS), lambda t: t != "")


def domain_tokens(c: Column) -> Column:
    """Lower-cased tokens, with CAS numbers, hazard codes and locants whole."""
    return F.transform(F.regexp_extract_all(c, F.lit(DOMAIN_TOKEN), F.lit(0)), F.lower)


# Suffixes that the stemmer takes off, longest first, and words it leaves.
SUFFIXES = ["ations", "ation", "ings", "ing", "edly", "ed", "ies", "es", "s"]
PROTECTED = ["chlorate", "chloride", "nitrate", "nitride", "sulfate", "sulfide", "gas", "glass"]
STOP_WORDS = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with"]


def stem(c: Column) -> Column:
    """Selective suffix stemmer: never below three letters, never a protected word."""
    branches = None
    for suffix in SUFFIXES:
        ok = c.endswith(suffix) & (F.length(c) >= len(suffix) + 3)
        value = F.substring(c, F.lit(1), F.length(c) - len(suffix))
        branches = F.when(ok, value) if branches is None else branches.when(ok, value)
    out = branches.otherwise(c)
    return F.when(c.isin(PROTECTED) | c.rlike(r"^\d|-\d"), c).otherwise(out)


def content_terms(c: Column) -> Column:
    """Stemmed domain tokens without stop words."""
    words = F.filter(domain_tokens(c), lambda t: ~t.isin(STOP_WORDS))
    return F.transform(words, stem)


def shingles(words: Column, n: int) -> Column:
    """Distinct n-word shingles of a token array; the whole if it is shorter, none if empty."""
    def made(w):
        last = F.greatest(F.size(w) - (n - 1), F.lit(1))
        return F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(w, i, F.lit(n)), " "))

    # as a lambda's argument the words are computed once, not once a shingle
    bound = F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, F.array_distinct(made(w))).otherwise(F.array().cast("array<string>"))), F.lit(0))
    return bound


def shingle_hashes(words: Column, n: int) -> Column:
    """64-bit hashes of the distinct shingles: a third of the size of their texts in a shuffle.

    Two shingles of a pair of texts are taken for equal by chance about once in 2^64.
    """
    def made(w):
        last = F.greatest(F.size(w) - n, F.lit(0))
        return F.array_distinct(F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(n)])))

    return F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, made(w)).otherwise(F.array().cast("array<bigint>"))), F.lit(0))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets; 0 if both are empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(both, F.lit(1)))


def term_set(c: Column) -> Column:
    """Set from a text like ``a; b``: lower-cased, trimmed, empty parts left out."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), ";"), lambda x: F.lower(F.trim(x)))
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


# Patterns for identifiers in safety documents; quantifiers are bounded.
PATTERNS = {
    "cas": r"\b[1-9][0-9]{1,6}-[0-9]{2}-[0-9]\b",
    "hazard": r"\b[HP][0-9]{3}\b",
    "limit": r"\b[0-9]{1,5}(?:\.[0-9]{1,4})? ?(?:ppm|mg/m3)\b",
    "email": r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9.-]{1,190}\.[A-Za-z]{2,10}",
    "phone": r"\b[0-9]{3}-[0-9]{3}-[0-9]{4}\b",
}
SECTION_HEADING = r"(?im)^[ \t]*section[ \t]+([0-9]{1,2})[ \t:.\-]"


def cas_valid(c: Column) -> Column:
    """Whether a CAS number's check digit holds."""
    digits = F.regexp_replace(c, "-", "")
    n = F.length(digits) - 1
    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + F.substring(digits, i, F.lit(1)).cast("int") * (n - i + 1))
    return total % 10 == F.substring(digits, -1, 1).cast("int")


def query_id(name: Column) -> Column:
    """Stable id of a query, below 10,000."""
    return F.pmod(F.xxhash64(name), F.lit(10000))
