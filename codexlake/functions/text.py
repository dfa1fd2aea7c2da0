"""Text functions as columns: normalisers of five scripts, keys, slugs, scripts, routing.  JVM-side but for NFC/NFD."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Ground-truth conventions of the Greek manifests.  Left to right: Latin look-alikes, sharp s,
# raised dots, high commas, ticks, four-dot mark, question mark, half colon, dashes.
GREEK_FROM = "AEHIKMNOTXYot" + "\u00df" + "\u00b7\u2022" + "\u1fbf\u2019'\u02bc" + "\u00b4\u1ffd\u0384\u0374" + "\u205b" + ";" + "\u02d1" + "\u2013\u2014"
GREEK_TO = "ΑΕΗΙΚΜΝΟΤΧΥοτ" + "\u03db" + "\u0387\u0387" + "\u1fbd\u1fbd\u1fbd\u1fbd" + "\u1fbd\u1fbd\u1fbd\u1fbd" + "\u2058" + "\u037e" + ":" + "--"
# Syriac vowels and dots; the last four are tatweel, abbreviation mark and western stops.
SYRIAC_FROM = "\u0730\u0731\u0733\u0734\u0736\u0737\u073a\u073b\u073c\u073d\u073e\u073f\u0741\u0742.:\u0640\u070f"
SYRIAC_TO = "\u0732\u0732\u0735\u0735\u0738\u0738\u0323\u0323\u0323\u0323\u0323\u0307\u0307\u0323\u0701\u0703"


def nonblank(column: str) -> Column:
    """SQL's notion: something is left after trimming plain spaces."""
    return F.length(F.trim(column)) > 0


def strip(column: str | Column) -> Column:
    """Python's notion of trimming: all Unicode white space."""
    return F.regexp_replace(column, r"(?U)^\s+|\s+$", "")


def normal(column: str | Column, form: str = "NFC") -> Column:
    """Unicode normalisation in Arrow batches; null stays null."""

    def apply(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: unicodedata.normalize(form, t) if t is not None else None)

    return F.pandas_udf(apply, "string")(column)


def greek_gt(column: str | Column) -> Column:
    """Greek manifest form: one character map, then runs of colons to one."""
    return F.regexp_replace(F.translate(column, GREEK_FROM, GREEK_TO), ":{2,}", ":")


def armenian_gt(column: str | Column) -> Column:
    """Armenian ink rules after NFC: native hyphen, ech-yiwn ligature, single spaces, no trailing spaces."""
    ligature = F.regexp_replace(F.translate(normal(column), "-", "\u058a"), "\u0565\u0582", "\u0587")
    return F.regexp_replace(F.regexp_replace(ligature, " {2,}", " "), " +$", "")


def armenian_print(column: str | Column) -> Column:
    """Western stops to the Armenian marks they look like."""
    return F.translate(column, ".:", "\u2024\u0589")


def armenian_diplomatic(column: str) -> Column:
    """Drop [restorations]; a word that held one gets the abbreviation mark after its last letter."""
    words = F.split(F.translate(column, "{", "["), " ")

    def word(w: Column) -> Column:
        bare = F.translate(F.regexp_replace(w, r"\[[^\[\]]*\]", ""), "[]", "")
        marked = F.regexp_replace(bare, "^(.*[\u0531-\u0587])", "$1\u055f")
        return F.when(w.rlike(r"[\[\]]") & ~w.contains("~"), marked).otherwise(bare)

    return F.array_join(F.transform(words, word), " ")


def coptic_gt(column: str | Column) -> Column:
    """Coptic form: plain single spaces, no ellipsis, raised dots, conjoining macron, NFC."""
    spaced = F.regexp_replace(strip(F.translate(column, "\u00a0\u2026", " ")), r"(?U)\s+", " ")
    return normal(F.translate(spaced, ".\u0304", "\u00b7\ufe26"))


def syriac_gt(column: str | Column) -> Column:
    """Syriac form: single spaces, NFC, East Syriac vowels, generic dots, native stops; tatweel and mark dropped."""
    spaced = F.regexp_replace(strip(F.translate(column, "\u00a0", " ")), r"(?U)\s+", " ")
    return F.translate(normal(spaced), SYRIAC_FROM, SYRIAC_TO)


# Editorial tokens of Greek transcriptions and the ink they stand for, in their order.
GREEK_TOKENS: tuple[tuple[str, str, str], ...] = (
    ("letter count", r"\[[0-9]+\]", ""),
    ("kai with stroke", r"<\+\+>", "\u03d7"),
    ("kai", r"<\+>", "\u03d7"),
    *[(f"numeral {i}", f"<{i}>", letter + "\u0305") for i, letter in enumerate("αβγδε\u03dbζηθ", start=1)],
    ("deleted", r"<->", ""),
    ("spaced macron", "(?U)\\s*\u00af", "\u0305"),
)


def greek_editorial(column: str) -> tuple[Column, dict[str, Column]]:
    """The text with editorial tokens resolved, and the number of hits of each rule.

    Spaces are collapsed and trimmed only where a rule fired, so other rows stay as they are.
    """
    text = F.col(column)
    counts = {}
    for name, pattern, ink in GREEK_TOKENS:
        counts[name] = F.regexp_count(text, F.lit(pattern))
        text = F.regexp_replace(text, pattern, ink)
    tidy = F.trim(F.regexp_replace(text, " {2,}", " "))
    return F.when(text == F.col(column), text).otherwise(tidy), counts


def word_final_sigma(column: str | Column) -> Column:
    """σ at a word's end becomes ς, keeping its marks."""
    return F.regexp_replace(column, "σ([\u0300-\u036f]*)(?=$|[^\\p{L}\\p{N}_\u0300-\u036f])", "ς$1")


def loose_key(column: str) -> Column:
    """Near-duplicate key: NFD without marks, punctuation, symbols and spaces, case folded.  Null stays null."""

    def one(t: str) -> str:
        kept = (c for c in unicodedata.normalize("NFD", t) if (k := unicodedata.category(c)) != "Mn" and k[0] not in "PS" and not c.isspace() and c != "\u03d7")
        return "".join(kept).casefold()

    def apply(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: one(t) if t is not None else None)

    return F.pandas_udf(apply, "string")(column)


def slug(column: str | Column, joiner: str = "_") -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(column), "[^a-z0-9]+", joiner), f"^{joiner}+|{joiner}+$", "")


def route(column: str, rules: Sequence[tuple[str, str, int, int]]) -> Column:
    """First matching rule as ``struct<rule, source, page>``; rules: name, pattern, source group, page group (0: none)."""
    out = F.lit(None).cast("struct<rule:string,source:string,page:string>")
    for name, pattern, source, page in reversed(rules):
        hit = F.struct(F.lit(name).alias("rule"), F.regexp_extract(column, pattern, source).alias("source"), (F.regexp_extract(column, pattern, page) if page else F.lit(None).cast("string")).alias("page"))
        out = F.when(F.col(column).rlike(pattern), hit).otherwise(out)
    return out


# Unicode ranges of the scripts of the corpora.
SCRIPT_CLASSES = {"greek": r"[\u0370-\u03e1\u03f0-\u03ff\u1f00-\u1fff]", "coptic": r"[\u03e2-\u03ef\u2c80-\u2cff]", "armenian": r"[\u0530-\u058f]", "syriac": r"[\u0700-\u074f]", "latin": r"[A-Za-z\u00c0-\u024f]"}


def script_counts(column: str) -> dict[str, Column]:
    return {name: F.regexp_count(F.col(column), F.lit(pattern)).cast("bigint") for name, pattern in SCRIPT_CLASSES.items()}


def main_script(column: str) -> Column:
    """Script with most characters; Coptic takes the Greek letters of a text that holds any Coptic ones."""
    n = script_counts(column)
    n["coptic"] = F.when(n["coptic"] > 0, n["coptic"] + n["greek"]).otherwise(F.lit(0))
    most = F.greatest(*n.values())
    out = F.lit(None).cast("string")
    for name in reversed(("coptic", "greek", "armenian", "syriac", "latin")):
        out = F.when((n[name] == most) & (most > 0), name).otherwise(out)
    return out


def _series(of):  # noqa: ANN001, ANN202
    """A string function as an Arrow one; null stays null."""
    return lambda texts: texts.map(lambda t: of(t) if t is not None else None)


def fuzzy_key(column: str | Column) -> Column:
    """Key for near-equal texts: NFKD and case folding without marks, punctuation, spaces, symbols and controls."""

    def one(t: str) -> str:
        return "".join(c for c in unicodedata.normalize("NFKD", t).casefold() if unicodedata.category(c)[0] not in "MPZSC")

    return F.pandas_udf(_series(one), "string")(column)


def codepoints(text: str) -> str:
    """``U+XXXX`` of each character, ``(none)`` for the empty text."""
    return " ".join(f"U+{ord(c):04X}" for c in text) or "(none)"


def composition_changes(text: str) -> list[str]:
    """What NFC changes in a text, each starter with its marks on its own; the whole text if it composes across starters."""
    whole = unicodedata.normalize("NFC", text)
    starts = [i for i, c in enumerate(text) if not i or not unicodedata.combining(c)]
    parts = [text[a:b] for a, b in zip(starts, [*starts[1:], len(text)], strict=True)]
    composed = [unicodedata.normalize("NFC", p) for p in parts]
    if "".join(composed) != whole:
        parts, composed = [text], [whole]
    return [f"{codepoints(a)}->{codepoints(b)}" for a, b in zip(parts, composed, strict=True) if a != b]


def nfc_changes(column: str | Column) -> Column:
    """``composition_changes`` of a column; null stays null."""
    return F.pandas_udf(_series(composition_changes), "array<string>")(column)


def symbol_changes(column: str | Column, source: str, target: str) -> Column:
    """Characters of a text that a translation table changes, as ``U+XXXX->U+YYYY``; null stays null."""
    to = {c: target[i] if i < len(target) else "" for i, c in enumerate(source)}

    def one(t: str) -> list[str]:
        return [f"{codepoints(c)}->{codepoints(to[c])}" for c in t if to.get(c, c) != c]

    return F.pandas_udf(_series(one), "array<string>")(column)


_MARKS = "\u0300-\u036f\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f"


def barred_expansions(column: str | Column) -> Column:
    """Expansions ``(...)`` dropped; the letters on either side get an overline unless they have one.

    θ(εὸ)ς becomes θ̅ς̅.  A letter between two expansions is barred once.
    """
    letter = f"\\p{{L}}[{_MARKS}]*"
    mark = "\uf8ff"
    # Where an expansion stood, a private mark keeps the place; then the letters beside it are barred.
    held = F.regexp_replace(column, r"\([^()\s]*\)", mark)
    before = F.regexp_replace(held, f"({letter})(?=[{_MARKS}]*{mark})", "$1\u0305")
    after = F.regexp_replace(before, f"(?<={mark})({letter})", "$1\u0305")
    return F.translate(F.regexp_replace(after, "\u0305([\u0300-\u0304\u0306-\u036f]*)\u0305+", "\u0305$1"), mark, "")


def sigma_spaces(column: str | Column) -> Column:
    """A space after a final sigma that a letter follows."""
    return F.regexp_replace(column, f"(ς[\u0300-\u036f]*)(?=\\p{{L}})", "$1 ")


def line_end_hyphen(column: str | Column) -> Column:
    """Hyphens at the line's end dropped, after a letter or with the spaces before them; a doubled one between words becomes a space."""
    return F.regexp_replace(F.regexp_replace(column, r"(?<=\p{L})- -(?=\p{L})", " "), r"(?<=\p{L})-$|(?U)\s+-$", "")


def ruled(column: str, key: str, rules: Sequence[tuple[str, str | None, str]]) -> tuple[Column, Column]:
    """Ordered rules ``(pattern, key prefix or None, replacement)`` over a text, each only in rows whose ``key`` has its prefix.

    Returns the text, spaces tidied only where a rule fired, and how many substitutions each rule made.
    """
    text, counts = F.col(column), []
    for pattern, prefix, ink in rules:
        applies = F.lit(True) if prefix is None else F.coalesce(F.col(key).startswith(prefix), F.lit(False))
        counts.append(F.when(applies, F.regexp_count(text, F.lit(pattern))).otherwise(0))
        text = F.when(applies, F.regexp_replace(text, pattern, ink)).otherwise(text)
    n = F.array(*counts)
    return F.when(F.aggregate(n, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) > 0, F.trim(F.regexp_replace(text, " {2,}", " "))).otherwise(F.col(column)), n


# Normaliser of each language, applied after NFC.
NORMALISERS = {"armenian": armenian_gt, "coptic": coptic_gt, "greek": greek_gt, "syriac": syriac_gt}


def normalised(column: str, language: str) -> Column:
    """The form of a text for its language (a column), NFC where it has no normaliser of its own."""
    out = normal(column)
    for name, of in NORMALISERS.items():
        out = F.when(F.col(language) == name, of(column)).otherwise(out)
    return out


def encode_characters(column: str | Column, charset: Sequence[str]) -> Column:
    """Numbers of a text's characters in a character set (from 1; 0 is the blank); an unknown character is an error."""
    known = F.create_map(*[F.lit(x) for i, c in enumerate(charset, 1) for x in (c, i)]) if charset else F.create_map().cast("map<string,int>")
    chars = F.filter(F.split(column, ""), lambda c: c != "")
    return F.transform(chars, lambda c: F.coalesce(known[c], F.raise_error(F.concat(F.lit("character not in the set: "), c)).cast("int")))


# Order of the labels before a release.
_PRE = {"dev": -4, "a": -3, "alpha": -3, "b": -2, "beta": -2, "rc": -1}
_VERSION = r"^(?:v)?(\d{1,9})\.(\d{1,9})\.(\d{1,9})(?:[-.]?(dev|alpha|a|beta|b|rc)[-.]?(\d{0,9}))?$"


def version_key(column: str | Column) -> Column:
    """``struct`` that orders versions ``MAJOR.MINOR.PATCH[label[number]]``; null for anything else."""
    bare = F.trim(column)
    part = [F.regexp_extract(bare, _VERSION, i) for i in range(1, 6)]
    rank = F.coalesce(F.create_map(*[F.lit(x) for pair in _PRE.items() for x in pair])[part[3]], F.lit(0))
    numbers = [p.try_cast("bigint").alias(n) for p, n in zip(part[:3], ("major", "minor", "patch"), strict=True)]
    return F.when(bare.rlike(_VERSION), F.struct(*numbers, rank.alias("rank"), F.coalesce(part[4].try_cast("bigint"), F.lit(0)).alias("pre")))


def version_verdict(column: str, floor: str, latest: str) -> Column:
    """``missing``, ``malformed``, ``below floor``, ``outdated`` or ``current``."""
    own = version_key(column)
    return F.when(F.coalesce(F.length(strip(column)), F.lit(0)) == 0, "missing").when(own.isNull(), "malformed").when(own < version_key(F.lit(floor)), "below floor").when(own < version_key(F.lit(latest)), "outdated").otherwise("current")


def artifact_ref(column: str) -> Column:
    """``struct<id, tag>`` of ``registry://id?tag=t`` (tag ``stable`` unless given); nulls for other shapes."""
    fits = F.coalesce(F.col(column).rlike("^registry://[^/?#]+"), F.lit(False))
    tag = F.regexp_extract(column, r"[?&]tag=([^&#]*)", 1)
    return F.struct(F.when(fits, F.regexp_extract(column, "^registry://([^/?#]+)", 1)).alias("id"), F.when(fits, F.when(tag == "", "stable").otherwise(tag)).alias("tag"))


# What is masked in log texts, in this order.
_SECRETS = (
    (r"(\w+://)[^\s/@:]+:[^\s/@]+@", "$1<redacted>@"), (r"\?[^\s\"'<>]+=[^\s\"'<>]*", "?<redacted>"), (r"eyJ[\w-]+\.[\w-]+\.[\w-]*", "<jwt>"), (r"\bAKIA[0-9A-Z]{16}\b", "<aws-key>"),
    (r"[\w.+-]+@[\w-]+\.[\w.-]+", "<email>"), (r"\b[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\b", "<uuid>"), (r"\b[A-Za-z]:\\\\[^\s\"']+", "<path>"), (r"(?:/home|/Users|/root)/[^\s\"':]+", "<path>"),
)


def redact_log(column: str, most: int = 500) -> Column:
    """A log text on one line with credentials, tokens, addresses, ids and home paths masked, cut at ``most`` characters."""
    out = F.trim(F.regexp_replace(column, r"[\x00-\x1f\x7f]", " "))
    for pattern, mask in _SECRETS:
        out = F.regexp_replace(out, pattern, mask)
    return F.left(out, F.lit(most))


def encode_cursor(*columns: str) -> Column:
    """Opaque cursor of a page of results: its key columns as JSON in base 64."""
    return F.base64(F.encode(F.to_json(F.struct(*columns)), "UTF-8"))


def decode_cursor(column: str | Column, schema: str) -> Column:
    """The key columns of a cursor; null for what is none."""
    return F.from_json(F.decode(F.try_to_binary(column, F.lit("base64")), "UTF-8"), schema)
