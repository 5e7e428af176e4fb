"""Fill-in-middle transformation: texts cut at unit boundaries and put in a new order.

A unit grammar is a list of alternatives over character classes that together take every
character.  It is translated to a regex that matches the empty place between two
characters wherever one unit ends and the next begins, by lookbehind and lookahead at the
neighbouring classes; Spark's ``split`` then gives the units and loses nothing.  All of it
is column expressions over one scan, without a shuffle.

Nulls and edge cases: null and empty texts have no units and are plain; a null doc_id is
hashed as an empty text; very long texts are cut whole; rows with equal doc_id and
repeated rows give a row each, equal ones the same; an empty table gives an empty result;
extra columns don't matter, and names may clash.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from tessera.llm.common import unused

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Runs of letters; any other character alone.
WORDS = r"[A-Za-z]+|[^A-Za-z]"
#: Every character alone.
CHARACTERS = r"[\s\S]"
#: Lines with their newline.
LINES = r"[^\n]*[\n]|[^\n]+"
PLAIN_FROM, SPM_BELOW = 90, 20

_ALTERNATIVE = re.compile(r"(?:(\[(?:[^\]\\]|\\.)+\])\*)?(\[(?:[^\]\\]|\\.)+\])(\+?)(?:\||$)")


def _complement(cls: str) -> str:
    return "[" + cls[2:] if cls.startswith("[^") else "[^" + cls[1:]


def boundary(grammar: str) -> str:
    """Zero-width regex of the places between two units of ``grammar``.

    Alternatives are ``[c]`` (one character is a unit), ``[c]+`` (a run is) and ``[a]*[c]``
    (a unit ends with c).  One that has a place is always named by the class before it: a
    run ends before a character outside its class, the other two end after any c.  A run
    that another alternative may end (``[a]+`` beside ``[a]*[c]``) goes on over c.
    """
    parts, at = [], 0
    for m in _ALTERNATIVE.finditer(grammar):
        if m.start() != at:
            break
        parts.append(m.groups())
        at = m.end()
    if at != len(grammar) or not parts:
        raise ValueError(f"not a unit grammar: {grammar!r}")
    ended = {head for head, _, _ in parts if head}
    places = []
    for head, cls, run in parts:
        if not run:
            places.append(f"(?<={cls})(?!\\z)")
        elif cls not in ended:
            places.append(f"(?<={cls})(?={_complement(cls)})")
    return "|".join(places) or r"(?!)"


def units(text: Column, grammar: str = WORDS) -> Column:
    """Array of the units of a text; empty for null and empty texts."""
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(text, boundary(grammar), -1))


def draws(doc_id: Column, seed: str = "1") -> Column:
    """The first four 8-digit groups of the SHA-256 of ``seed:doc_id``, as longs."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.transform(F.array(*[F.substring(h, 8 * i + 1, 8) for i in range(4)]), lambda x: F.conv(x, 16, 10).cast("long"))


def rebuilt(output: Column, form: Column) -> Column:
    """The text that an output of that form was made from.

    The marks stand nowhere else in it: texts that hold one are plain, and no text's end
    and a mark's beginning make another.
    """
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    psm = F.concat(F.get(part, F.lit(1)), F.get(part, F.lit(3)), F.get(part, F.lit(2)))
    spm = F.concat(F.get(part, F.lit(2)), F.get(part, F.lit(3)), F.get(part, F.lit(1)))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def fill_in_middle(docs: DataFrame, *, grammar: str = WORDS, seed: str = "1", carry: list[str] | None = None) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output of every document.

    Cut places and form depend on doc_id alone: prefix and middle end after h1 % (n + 1)
    and h2 % (n + 1) units, whichever is smaller first; h3 and h4 choose the form.  With
    ``carry`` a struct ``carried`` of these columns comes along.
    """
    rest = F.struct(*[F.col(c) for c in carry]) if carry else F.lit(0)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), rest.alias("carried"))
    rows = rows.select("*", units(F.col("text"), grammar).alias("unit"), draws(F.col("doc_id"), seed).alias("h"))
    n = F.size("unit").cast("long")
    a, b = (F.get("h", F.lit(i)) % (n + 1) for i in (0, 1))
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains("text", F.lit(mark))
    plain = (n == 0) | marked | (F.get("h", F.lit(2)) % 100 >= PLAIN_FROM)
    form = F.when(plain, "plain").when(F.get("h", F.lit(3)) % 100 < SPM_BELOW, "spm").otherwise("psm")
    rows = rows.select("doc_id", "text", "carried", "unit", n.alias("n"), form.alias("form"), F.least(a, b).cast("int").alias("lo"), F.greatest(a, b).cast("int").alias("hi"))
    whole = F.array_join
    rows = rows.select(
        "doc_id", "text", "carried", "n", "form",
        whole(F.slice("unit", F.lit(1), F.col("lo")), "").alias("prefix"),
        whole(F.slice("unit", F.col("lo") + 1, F.col("hi") - F.col("lo")), "").alias("middle"),
        whole(F.slice("unit", F.col("hi") + 1, F.col("n").cast("int")), "").alias("suffix"))
    cut = F.col("form") != "plain"
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    spm = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text"))
    found = rows.select("doc_id", "n", "form", F.when(cut, F.length("prefix").cast("long")).alias("prefix_chars"),
                        F.when(cut, F.length("middle").cast("long")).alias("middle_chars"), output.alias("output"), "carried")
    return found if carry else found.drop("carried")


def transform(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with texts in their new order, the other columns as they are, and ``form``.

    Where ``docs`` has a column of that name the new one gets a longer name.
    """
    made = fill_in_middle(docs, carry=docs.columns, **options)
    columns = [F.col("output" if c.lower() == "text" else f"carried.`{c}`").alias(c) for c in docs.columns]
    return made.select(*columns, F.col("form").alias(unused(docs.columns, "form")))


def digests(docs: DataFrame, **options) -> DataFrame:
    """Lengths and hashes of outputs and of the texts rebuilt from them."""
    made = fill_in_middle(docs, **options)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(rebuilt(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
