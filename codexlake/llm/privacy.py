"""Personal information in free text: proposed spans, confirmed by checksums and scored by their context.

Every rule proposes spans with a base score; validators (Luhn, mod-97, mod 11,10) raise or refute it, and
words near the span move it up or down.  A span whose score reaches ``THRESHOLD`` is kept; of overlapping
spans the better one wins.  The rest of the text is left as it is.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from urllib.parse import quote, unquote, unquote_plus

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codexlake.llm.characters import per_distinct
from codexlake.runtime import table

THRESHOLD = 0.5
#: Characters on either side of a span in which context words count.
WINDOW = 28
PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "identity": "[ID]", "address": "[ADDRESS]", "name": "[NAME]"}
_SPAN = "array<struct<kind:string,start:int,end:int,score:double>>"


def luhn(digits: str) -> bool:
    """Luhn check of a string of digits, as cards have it."""
    total = sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits))))
    return len(digits) > 1 and total % 10 == 0


def mod97(account: str) -> bool:
    """Mod-97 check of an international bank account number."""
    moved = account[4:] + account[:4]
    return moved.isalnum() and moved.isascii() and int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def mod11_10(digits: str) -> bool:
    """ISO 7064 mod 11,10 check of a string of digits, as tax numbers have it."""
    product = 10
    for d in map(int, digits[:-1]):
        product = (2 * ((d + product) % 10 or 10)) % 11
    return len(digits) > 1 and (11 - product) % 10 == int(digits[-1])


@dataclass(frozen=True)
class Rule:
    """A proposal: pattern, base score, context that raises or lowers it, and a check that changes it."""

    kind: str
    pattern: regex.Pattern
    base: float
    raises: regex.Pattern | None = None
    gain: float = 0.4
    lowers: regex.Pattern | None = None
    loss: float = 0.7
    check: Callable[[str], float] | None = None
    #: What a text must hold for the pattern to be tried at all.
    needs: regex.Pattern = regex.compile(r"\d")


def _p(pattern: str, flags: int = 0) -> regex.Pattern:
    return regex.compile(pattern, flags | regex.VERBOSE)


def _digits(s: str) -> str:
    return "".join(c for c in s if c.isdigit())


_FILE_ENDINGS = "png|jpe?g|tiff?|webp|gif|svg|pdf|xml|json|txt|zip|py|js"
_TECHNICAL = _p(r"\b(?:shelfmark|signatur|cote|isbn|issn|doi|job|issue|ticket|version|polygon|line|lines|folio|fols?|cod|codex)\b[\s.:\#№°]*\S{0,6}$", regex.I)
_CALL = _p(r"\b(?:tel|tél|telephone|téléphone|telefon|phone|call|mobile|mobil|handy|whatsapp|rückruf|ring|fax|number|nummer|numéro|τηλ\w*|invite)\b", regex.I)
_IDENTITY = _p(r"\b(?:ssn|social\ security|identity|id\ card|id\ number|national\ insurance|passport|steuer-?id(?:nr)?|tax\ id|ausweis|personalausweis|insee|reader_id|ταυτότητα\w*|δελτίο)\b", regex.I)
_HOME = _p(r"\b(?:live|living|office|deliver|send|address|adresse|anschrift|wohne|habite|q)\b", regex.I)


def _phone_shape(s: str) -> float:
    d = _digits(s)
    if not 9 <= len(d) <= 15 or regex.fullmatch(r"(?:\d{4}[-./]\d{1,2}[-./]\d{1,2}|\d{1,2}[-./]\d{1,2}[-./]\d{4})", s.strip()):
        return -1
    if s.count("(") != s.count(")"):
        return -1
    if s.lstrip().startswith("+"):
        return 0.3
    if d.startswith("00"):
        return 0.1 if len(d) >= 11 else -0.2
    if d.startswith("0"):
        return 0.1 if 10 <= len(d) <= 12 else -0.2
    return 0.1 if len(d) == 10 and regex.fullmatch(r"\(?[2-9]\d\d\)?[ .-]?\d{3}[ .-]\d{4}", s.strip()) else -0.3


_STREET = r"(?i:street|st\.|road|rd\.?|avenue|ave\.?|lane|blvd\.?|boulevard|yard|square|sq\.|drive|dr\.|court|close|way|terrace|place|hill|row|crescent|gardens)"
_UP = r"\p{Lu}[\p{L}\p{M}'’.-]*"
_TOWN = r"(?:,[ ]+\p{Lu}[\p{Ll}\p{M}'’-]+(?:[ ]\p{Lu}\p{Ll}+)?)?"
_POST = r"(?:[ ]+(?:\p{Lu}{1,2}\d{1,2}\p{Lu}?[ ]+\d\p{Lu}{2}|\d{5})(?!\d))?"

RULES: tuple[Rule, ...] = (
    Rule(
        "email",
        _p(
            rf"""(?<![\p{{L}}\d])[\p{{L}}\d](?:[\p{{L}}\d._%+-]{{0,62}}[\p{{L}}\d_+-])?
            \s?(?:@|[(\[{{<]\s?(?:at|@|ät)\s?[)\]}}>]|\s(?:AT|at)\s(?=\S+\s(?:dot|DOT|\(dot))) \s?
            [\p{{L}}\d](?:[\p{{L}}\d-]*[\p{{L}}\d])?
            (?:\s?(?:\.|[(\[{{<]\s?(?:dot|punkt|point)\s?[)\]}}>]|\s(?:dot|DOT)\s)\s?(?!(?:{_FILE_ENDINGS})\b)[\p{{L}}\d](?:[\p{{L}}\d-]*[\p{{L}}\d])?)*?
            \s?(?:\.|[(\[{{<]\s?(?:dot|punkt|point)\s?[)\]}}>]|\s(?:dot|DOT)\s)\s?(?!(?:{_FILE_ENDINGS})\b)\p{{L}}{{2,}}(?:(?:\.|\s?[(\[]\s?dot\s?[)\]]\s?)\p{{L}}{{2,}})*""",
            regex.I,
        ),
        0.9,
        needs=regex.compile(r"@|[(\[{<\s](?:at|ät)[)\]}>\s]", regex.I),
    ),
    Rule("phone", _p(r"(?<![\p{L}\d.,:/\#=_-])(?:\+|\(\+?)?\d(?:[ .()/-]{0,2}\d){8,14}(?![\p{L}\d]|[.,:/-]\d)"), 0.4, _CALL, 0.3, _TECHNICAL, 0.8, _phone_shape),
    Rule("identity", _p(r"(?<![\p{L}\d-])\d{3}-\d{2}-\d{4}(?![\p{L}\d-])"), 0.6, _IDENTITY, 0.3, _TECHNICAL),
    Rule("identity", _p(r"(?<![\p{L}\d-])\d{2}\ ?\d{3}\ ?\d{3}\ ?\d{3}(?![\p{L}\d-]|\ \d)"), 0.1, _IDENTITY, 0.7, _TECHNICAL, 0.7, lambda s: 0.2 if mod11_10(_digits(s)) else 0.0),
    Rule("identity", _p(r"(?<![\p{L}\d])[A-Z]{2}\ ?\d{2}\ ?\d{2}\ ?\d{2}\ ?[A-D](?![\p{L}\d])"), 0.6, _IDENTITY, 0.3, _TECHNICAL),
    Rule("identity", _p(r"(?<![\p{L}\d])\p{Lu}{1,2}\ ?-?\d{6,7}(?![\p{L}\d])"), 0.1, _IDENTITY, 0.6, _TECHNICAL),
    Rule("identity", _p(r"(?<![\p{L}\d-])\d{6}[-+A]\d{3,4}[A-Z0-9]?(?![\p{L}\d-])"), 0.1, _IDENTITY, 0.6, _TECHNICAL),
    Rule("identity", _p(r"(?<![\p{L}\d-])(?=[A-Z0-9-]*\d)[A-Z]{1,2}[A-Z0-9]{1,3}-?[A-Z0-9]{4,7}(?![\p{L}\d-])"), 0.0, _p(r"\b(?:passport|reisepass|passeport|διαβατήρι\w*)\b", regex.I), 0.7, _TECHNICAL),
    Rule("identity", _p(r"(?<![\p{L}\d])[A-Z]{2}\d{2}(?:\ ?[A-Z0-9]{4}){2,7}(?:\ ?[A-Z0-9]{1,3})?(?![\p{L}\d])"), 0.0, check=lambda s: 0.9 if mod97(s.replace(" ", "")) else -1),
    Rule("identity", _p(r"(?<![\p{L}\d-])\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?![\p{L}\d-])"), 0.0, _p(r"\b(?:card|karte|carte|visa|mastercard|κάρτα\w*)\b", regex.I), 0.3, check=lambda s: 0.4 if 13 <= len(_digits(s)) <= 19 and luhn(_digits(s)) else -1),
    Rule("address", _p(r"\b(?i:P\.?\ ?O\.?\ ?Box)[ ]+\d+" + _TOWN), 0.8),
    Rule("address", _p(rf"(?:\b(?i:flat|apt\.?|apartment|unit|suite)[ ]+\d+\p{{L}}?,[ ]+)?(?<![\p{{L}}\d.,/-])\d{{1,4}}\p{{Ll}}?[ ]+(?:[NSEW]\.?[ ]+)?(?:{_UP}[ ]+){{1,3}}{_STREET}(?![\p{{L}}])(?:,[ ]+(?i:apt|flat|unit|suite)\.?[ ]+\d+)?{_TOWN}{_POST}"), 0.5, _HOME, 0.2, _TECHNICAL, 0.3),
    Rule("address", _p(rf"(?<![\p{{L}}\d.,/-])\d{{1,4}}(?:[ ]?bis|[ ]?ter)?,?[ ]+(?i:rue|avenue|boulevard|place|chemin|quai|impasse|allée)[ ]+(?:d(?:e[ ]la|es|u|e)[ ]|de[ ]l['’]|d['’]|l[ae]s?[ ])?{_UP}(?:,?[ ]+\d{{5}}(?:[ ]\p{{Lu}}\p{{Ll}}+)?)?"), 0.6, _HOME, 0.2),
    Rule("address", _p(rf"(?<!\p{{L}})\p{{Lu}}\p{{L}}*?(?:straße|strasse|str\.|gasse|weg|platz|allee|ufer|damm)[ ]+\d{{1,4}}\p{{Ll}}?(?![\d])(?:,[ ]+\d{{5}}(?:[ ]\p{{Lu}}\p{{Ll}}+)?)?"), 0.6, _HOME, 0.2),
    Rule("address", _p(r"(?<!\p{L})(?:Οδός|οδός|Λεωφόρος|λεωφόρος|Πλατεία)[ ]+\p{L}+(?:[ ]\p{L}+)?[ ]+\d{1,4}(?:,[ ]+\d{3}[ ]?\d{2})?"), 0.7, _HOME, 0.2),
)

# Names: shapes of a person's name, tried where words around it ask for a person.
_TITLE = r"(?:(?i:Dr|Prof|Mr|Mrs|Ms|Mme|Herr|Frau|Fr|Sr|Κα|Κος)\.?\s+)*"
_WORD = r"\p{L}[\p{L}\p{M}'’]+(?:-\p{L}[\p{L}\p{M}'’]+)*"
_CAP = r"\p{Lu}[\p{L}\p{M}'’]+(?:-\p{Lu}[\p{L}\p{M}'’]+)*"
_PARTICLE = r"(?:(?i:von|van|de|der|den|del|della|du|di|da|le|la|zu|zum|ter|bin|ibn|al)\s+)*"


def _name(word: str) -> str:
    initial = r"\p{L}\.(?:\s?\p{L}\.){0,3}"
    return rf"{_TITLE}(?:{_PARTICLE}{word},\s+(?:{initial}|{word})|(?:{initial}|{word}(?:\s+{initial})?)\s+{_PARTICLE}{word}(?:\s+{_CAP})?)"


# Words that ask for a person before or after a name, and words that are no name.
_BEFORE = r"(?:my\s+colleague|colleague|kollegin|kollege|mein(?:e)?\s+kolleg(?:e|in)|the\s+account\s+of|account\s+of|konto\s+von|compte\s+de|reported\s+by|written\s+by|uploaded\s+by|corrected\s+by|gemeldet\s+von|signalé\s+par|my\s+name\s+is|mein\s+name\s+ist|je\s+m['’]appelle|με\s+λένε|i\s+am|i['’]m|ich\s+bin|je\s+suis|this\s+is|please\s+ask|ask|contact|dear|hello|hi|thanks\s+to|greetings\s+from)"
_CLOSING = r"(?:(?:mit\s+)?(?:freundlichen|besten|herzlichen)\s+gr(?:ü|ue)(?:ß|ss)en|viele\s+gr(?:ü|ue)(?:ß|ss)e|mfg|best(?:\s+(?:wishes|regards))?|kind\s+regards|warm\s+regards|regards|cheers|sincerely|yours(?:\s+sincerely)?|cordialement|bien\s+à\s+vous|amicalement|με\s+εκτίμηση|φιλικά)"
_AFTER = r"(?:approved|saw|said|says|wrote|noticed|noted|reported|told|asked|uploaded|fixed|reviewed|corrected|transcribed|agrees|thinks|mentioned|confirmed|deleted)"
_STOP_WORDS = frozenset("the a an my our your this that these it we they he she not no new on in of to and or is was are be line lines page pages folio folios text model export version segmenter polygon room shelfmark job chapter cod gr isbn der die das ein eine wir la le les un une ligne saint st psalter lectionary homilies hymns acts gospel codex library team project reading lost".split())
_END = r"(?=\s*(?:$|[.;!?)\]\n]|\s-\s|—|,\s*(?:$|\n)))"
_NAME_RULES: tuple[tuple[regex.Pattern, float], ...] = (
    (_p(rf"(?<!\p{{L}})(?i:{_BEFORE}):?\s+(?<name>{_name(_WORD)})(?=\s+(?:saw|is|in|and|has|had|at|from|for|to|about|if|who|here|of|und|et|im|aus|I|ist|est)\b)"), 0.4),
    (_p(rf"(?<!\p{{L}})(?i:{_BEFORE}):?\s+(?<name>{_name(_WORD)}){_END}"), 0.4),
    (_p(rf"(?<!\p{{L}})(?i:{_CLOSING})[,:]?\s+(?<name>{_name(_WORD)}){_END}"), 0.5),
    (_p(rf"(?:—|–|--|\n-)\s*(?<name>{_name(_WORD)}){_END}"), 0.4),
    (_p(rf"(?:^|[.;!?\n(]\s*|\s-\s|—\s?)(?<name>{_name(_WORD)})\s+{_AFTER}(?!\p{{L}})"), 0.3),
)


def _name_score(name: str) -> float:
    words = regex.findall(r"\p{L}[\p{L}\p{M}'’]*", name)
    if any(len(w) > 1 and w.lower() in _STOP_WORDS for w in words) or not any(len(w) > 2 for w in words):
        return -1
    capital = [w for w in words if w[0].isupper() or not (w[0].islower() or w[0].isupper())]
    return 0.3 if len(capital) >= 2 or len(capital) == len(words) else 0.1


_PLAIN = {}


def _plain(text: str) -> str:
    """The text with plain spaces and narrow letters, every character in its place."""
    out = []
    for c in text:
        if c not in _PLAIN:
            k = unicodedata.normalize("NFKC", c)
            _PLAIN[c] = " " if c.isspace() and c != "\n" else k if len(k) == 1 else c
        out.append(_PLAIN[c])
    return "".join(out)


def find_spans(text: str, context: str = "") -> list[tuple[str, int, int, float]]:
    """Kept spans ``(kind, start, end, score)`` in order; ``context`` are words that stand before the text."""
    plain = text if text.isascii() else _plain(text)
    proposed = []
    held: dict[regex.Pattern, bool] = {}
    for rule in RULES:
        if rule.needs not in held:
            held[rule.needs] = rule.needs.search(plain) is not None
        if not held[rule.needs]:
            continue
        for m in rule.pattern.finditer(plain):
            score = rule.base + (rule.check(m.group()) if rule.check else 0.0)
            before, after = (context + " " + plain[max(0, m.start() - WINDOW) : m.start()])[-WINDOW - len(context) :], plain[m.end() : m.end() + WINDOW]
            if rule.raises and (rule.raises.search(before) or rule.raises.search(after)):
                score += rule.gain
            if rule.lowers and rule.lowers.search(before):
                score -= rule.loss
            proposed.append((score, rule.kind, m.start(), m.end()))
    for pattern, base in _NAME_RULES:
        for m in pattern.finditer(plain, overlapped=True):
            a, b = m.span("name")
            proposed.append((base + _name_score(plain[a:b]), "name", a, b))
    kept: list[tuple[str, int, int, float]] = []
    for score, kind, a, b in sorted(proposed, key=lambda x: (-x[0], x[2] - x[3], x[2])):
        if score >= THRESHOLD - 1e-9 and all(b <= s or a >= e for _, s, e, _ in kept):
            kept.append((kind, a, b, min(1.0, round(score, 3))))
    return sorted(kept, key=lambda x: x[1])


def redact_text(text: str, spans: Iterable[tuple[str, int, int, float]]) -> str:
    """The text with each span replaced by its kind's placeholder."""
    out, at = [], 0
    for kind, a, b, _ in spans:
        out += [text[at:a], PLACEHOLDER[kind]]
        at = b
    return "".join([*out, text[at:]])


_UUID = regex.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_PERSON_KEYS = frozenset({"name", "user", "username", "author", "owner", "member", "to", "from", "person", "colleague"})
_PERSON_FOLDERS = frozenset({"members", "users", "people", "authors", "profile", "u"})


def _value_spans(key: str, raw: str, folder: bool) -> tuple[str, list[tuple[str, int, int, float]]]:
    value = unquote(raw) if folder else unquote_plus(raw)
    if _UUID.fullmatch(value):
        return value, []
    spans = find_spans(value, key)
    asks = key.lower() in (_PERSON_FOLDERS if folder else _PERSON_KEYS)
    if asks and not spans:
        words = [w for w in regex.split(r"[\s._+-]+", value) if w]
        if 2 <= len(words) <= 4 and all(regex.fullmatch(r"\p{L}[\p{L}\p{M}'’]*\.?", w) for w in words) and not any(w.lower() in _STOP_WORDS for w in words):
            spans = [("name", 0, len(value), 0.8)]
    return value, spans


def scan_route(route: str) -> tuple[list[str], str]:
    """Kinds found in an app route, and the route with placeholders.

    Path segments and query values are decoded one by one; the folder or key before them is their context.
    """
    path, mark, query = route.partition("?")
    kinds: list[str] = []

    def cleaned(key: str, raw: str, folder: bool) -> str:
        value, spans = _value_spans(key, raw, folder)
        if not spans:
            return raw
        kinds.extend(k for k, *_ in spans)
        return quote(redact_text(value, spans), safe="[]")

    segments = path.split("/")
    segments = [cleaned(segments[i - 1] if i else "", s, True) if s else s for i, s in enumerate(segments)]
    pieces = regex.split(r"([&?;])", query)
    for i in range(0, len(pieces), 2):
        key, eq, raw = pieces[i].partition("=")
        pieces[i] = key + eq + cleaned(unquote_plus(key), raw, False) if eq else cleaned("", key, False)
    return kinds, "/".join(segments) + mark + "".join(pieces)


def _scan(column: str, route: bool) -> Column:
    """``struct<kinds array<string>, clean string>`` of a column; null stays null, empty text has no kinds."""

    def one(value: str) -> tuple[list[str], str]:
        if route:
            kinds, clean = scan_route(value)
        else:
            spans = find_spans(value)
            kinds, clean = [k for k, *_ in spans], redact_text(value, spans)
        return sorted(set(kinds)), clean

    def scan(values: pd.Series) -> pd.DataFrame:
        done = per_distinct(values, one)
        return pd.DataFrame({"kinds": [d[0] if d is not None else None for d in done], "clean": [d[1] if d is not None else None for d in done]})

    return F.pandas_udf(scan, "kinds array<string>, clean string")(column)


def personal_information(notes: DataFrame) -> DataFrame:
    """``feedback_id``, ``field_name``, ``kind``, ``redacted``: one row for each kind a field holds.

    Repeated rows count once; nulls and empty fields hold nothing; texts are read whole; other columns are
    ignored; an empty table gives an empty result.
    """
    fields = notes.where(F.col("id").isNotNull()).select("id", "message", "page_path").distinct()
    found = fields.select("id", _scan("message", False).alias("m"), _scan("page_path", True).alias("p"))
    both = F.array(F.struct(F.lit("message").alias("field_name"), F.col("m.kinds").alias("kinds"), F.col("m.clean").alias("redacted")), F.struct(F.lit("page_path").alias("field_name"), F.col("p.kinds").alias("kinds"), F.col("p.clean").alias("redacted")))
    return found.select(F.col("id").alias("feedback_id"), F.explode(both).alias("f")).select("feedback_id", "f.field_name", F.explode("f.kinds").alias("kind"), "f.redacted")


def redacted_notes(notes: DataFrame) -> DataFrame:
    """The same notes with typed placeholders in place of personal information; nulls stay null."""
    m, p = _scan("message", False), _scan("page_path", True)
    return notes.select("*", m.alias("__m"), p.alias("__p")).withColumns({"message": F.col("__m.clean"), "page_path": F.col("__p.clean")}).drop("__m", "__p")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_information(table(spark, sf_dir, "feedback")).select("feedback_id", "field_name", "kind").distinct()


def p3_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redacted_notes(table(spark, sf_dir, "feedback")).select("id", "user_id", "message", "page_path", "created_at", "received_at")
