"""Column expressions on texts, labels and index lists. Nothing here shuffles or leaves the JVM."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it, the information separators and next-line included.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]+"
#: Fixed value: the plain form of a statement.
CATEGORICAL = r"^(All|No|Some) .+ are( not)? .+\.$"
#: Words that don't count as content.
STOP_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "by", "can", "from", "in", "is", "it", "its", "no", "not", "of", "on", "or", "some", "that",
    "the", "there", "this", "to", "with", "all", "any", "every", "single", "thing", "things", "item", "items", "member", "members", "among",
    "included", "classified", "considered", "known", "therefore", "consequently", "thus", "follows", "conclusion", "conclude", "must",
    "case", "true", "fact",
]


def normalise(text: Column) -> Column:
    """Trimmed, with every run of white space as one space; a printable ASCII text that is so already is only looked through."""
    done = text.rlike(r"\A[ -~]*\z") & ~F.contains(text, F.lit("  ")) & ~F.startswith(text, F.lit(" ")) & ~F.endswith(text, F.lit(" "))
    return F.when(done, text).otherwise(F.trim(F.regexp_replace(text, SPACE, " ")))


def content_id(text: Column) -> Column:
    """SHA-256 (hex) of the normalised text; case counts."""
    return F.sha2(normalise(text), 256)


def signature(text: Column) -> Column:
    """Key for comparing texts without regard to case and white space."""
    return F.lower(normalise(text))


def sentences(text: Column) -> Column:
    """Sentences with their end marks; a text without an end mark is cut at its full stops instead.

    The text is cut behind each end mark, which reads it once: a mark without text before it is no
    sentence, and what follows the last mark goes.
    """
    return normal_sentences(normalise(text))


def normal_sentences(flat: Column) -> Column:
    """``sentences`` of a text that is normalised. Cuts are unit separators, which such a text doesn't hold."""
    cut = flat
    for mark in ".!?":
        cut = F.replace(cut, F.lit(mark), F.lit(mark + "\x1f"))
    # named once, as an element, so that it isn't cut twice
    ended = F.get(F.transform(F.array(F.split(cut, "\x1f")), lambda c: F.slice(c, F.lit(1), F.size(c) - 1)), F.lit(0))
    for mark in ".!?":
        ended = F.array_remove(ended, mark)
    rough = F.filter(F.transform(F.split(flat, r"(?<=[.!?])\s+|\.\s*"), lambda s: F.trim(s)), lambda s: s != "")
    rough = F.transform(rough, lambda s: F.when(s.rlike(r"[.!?]$"), s).otherwise(F.concat(s, F.lit("."))))
    # the parts are named once, as an element, so that they aren't cut twice
    either = lambda f: F.when(F.size(f) > 0, F.transform(f, lambda s: F.trim(s))).otherwise(rough)
    return F.get(F.transform(F.array(ended), either), F.lit(0))


def premises_and_conclusion(text: Column, marker: str = "Therefore,") -> Column:
    """struct(premises, conclusion), parted at the first marker; without one no premises and no conclusion."""
    at = F.instr(text, marker)
    before = F.regexp_replace(F.substring(text, F.lit(1), at - 1), rf"^{SPACE}|{SPACE}$", "")
    parts = F.filter(F.transform(F.split(before, r"\.\s+"), lambda p: F.trim(p)), lambda p: p != "")
    parts = F.filter(F.transform(parts, lambda p: F.trim(F.regexp_replace(p, r"\.$", ""))), lambda p: p != "")
    rest = F.regexp_replace(F.substring(text, at + len(marker), F.length(text)), rf"^{SPACE}|{SPACE}$", "")
    return F.struct(
        F.when(at > 0, parts).otherwise(F.array().cast("array<string>")).alias("premises"),
        F.when(at > 0, rest).alias("conclusion"),
    )


def content_words(text: Column, stop: Sequence[str] = STOP_WORDS, longer_than: int = 3) -> Column:
    """Distinct lower-case words of more than ``longer_than`` letters that aren't stop words."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[A-Za-z][A-Za-z'-]*"), F.lit(0))
    return F.array_distinct(F.array_except(F.filter(words, lambda w: F.length(w) > longer_than), F.array(*map(F.lit, stop))))


def overlaps(words: Column, others: Column) -> Column:
    """The two word sets share a word."""
    return F.arrays_overlap(words, others)


def label_key(value: Column) -> Column:
    """A loose boolean label as a key: true, false, or the value as it stands. Null stays null."""
    s = F.lower(F.trim(value))
    return F.when(s.isin("true", "1", "yes", "valid"), "true").when(s.isin("false", "0", "no", "invalid"), "false").otherwise(value)


def index_list(text: Column) -> Column:
    """All runs of digits in a text as ints; null gives an empty list."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("([0-9]+)"), F.lit(1))
    return found.cast("array<int>")


def premise_count(premises: Column, text: Column) -> Column:
    """Size of a list of premises, else the number of numbered lines; none gives null."""
    numbered = F.regexp_count(text, F.lit(r"(?im)^\s*(?:premise\s*)?\d+\s*[.:)\-]"))
    return F.nullif(F.coalesce(F.when(premises.isNotNull(), F.size(premises)), numbered), F.lit(0))


def is_late(indexes: Column, first_late: int = 3) -> Column:
    return F.exists(indexes, lambda i: i >= first_late)


def is_spread(indexes: Column) -> Column:
    """Some neighbours of the sorted list are more than one apart."""
    s = F.array_sort(indexes)
    gaps = F.zip_with(F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))), F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0))), lambda a, b: b - a)
    return (F.size(s) >= 2) & F.exists(gaps, lambda g: g > 1)


def is_categorical(sentence: Column, plain: str = CATEGORICAL) -> Column:
    """Of the plain form all / no / some ... are (not) ..."""
    return sentence.rlike(plain)


def ends_with_conclusion(parts: Column, marker: str = "Therefore,") -> Column:
    return F.when(F.size(parts) > 0, F.startswith(F.element_at(parts, -1), F.lit(marker))).otherwise(False)


def has_loose_pronoun(text: Column, pronoun: str = " of them ") -> Column:
    return F.contains(signature(text), F.lit(pronoun))


def capitalise(text: Column) -> Column:
    """First character in upper case, the rest as it is."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, F.lit(2), F.length(text)))


def valid_text(raw: Column) -> Column:
    """Text of a binary column without the bytes that aren't UTF-8; replacement characters of the input go too."""
    return F.replace(F.make_valid_utf8(raw.cast("string")), F.lit("�"), F.lit(""))


def one_line(text: Column) -> Column:
    """Outer line ends removed, inner ones as spaces."""
    return F.replace(F.regexp_replace(text, r"^\n+|\n+$", ""), F.lit("\n"), F.lit(" "))


def draw(n: int | Column, *parts: Column | str | int) -> Column:
    """A number below n that depends on the parts alone: the same on any partitioning and at any retry."""
    named = F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.pmod(F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("bigint"), F.lit(n) if isinstance(n, int) else n)


def list_text(values: Column | Iterable) -> Column:
    """An int list as text, for keys and reports: 1,4"""
    return F.array_join(F.transform(values, lambda v: v.cast("string")), ",")
