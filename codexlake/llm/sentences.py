"""Sentences of documents in mixed scripts: candidate boundaries and a maximum-entropy classifier.

Candidates are the stops that the script around them uses.  What the habits of a script fix (a small letter,
digit or comma that follows, a blank line, a stop that has no other use) settles most of them.  A full stop
before a capital may end a sentence or an abbreviation; there a logistic model of the token before it and the
token after it decides.  The model of the token before is trained on reliable boundaries: stops at the end of a
block are positive, stops before a small letter, comma or digit negative; its features are the token's length,
case, digits, inner stops, script and how often it closes a block.  The token after adds the odds of its shape
at the start of a block against the middle of a sentence.  Token statistics cover all documents; the model is
fitted on their sums by feature cell, a table of bounded size.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codexlake.runtime import durable, table

# Stops by script, stops that have no other use, and the marks that may stand between a stop and the
# next sentence.
STOPS = {"latin": ".?!…", "greek": ".;!…⁘\u037e", "armenian": "։", "syriac": ".܂؟܀", "coptic": "⳾·.", "other": ".?!…"}
ALWAYS = "。！？｡．।॥።፧፨۔؟។။᙮᠃"
CASELESS = frozenset({"syriac", "coptic", "armenian"})
CLOSERS = "”»’\"')\\]“›」』）】〉》"
OPENERS = "“„«‘‚\"'([‹「『（【〈《"
_SPACES = " \u00a0\u202f\u2009"

_CANDIDATE = re.compile(rf"[.?!…;\u037e։·⁘⳾܂܀{ALWAYS}]+(?:[{CLOSERS}]|[{_SPACES}][»›])*")
_BLANK = re.compile(r"[^\S\n]*\n(?:[^\S\n]*\n)+\s*")
_ITEM = re.compile(r"\d{1,4}\.\s+\S")
_ROMAN = re.compile(r"[IVXLCDM]+")
_DIGITS = re.compile(r"\d+")
_GAP = re.compile(r"\s*")
_UPPER = "".join(c for c in map(chr, range(0x250)) if c.isupper()) + "Α-ΫἈ-Ὧ"
#: Shapes of a capitalised token: an initial, several capitals, a short and a longer word.
_SHAPES = re.compile(rf"(?:([{_UPPER}]\.)|([{_UPPER}]{{2}})|([{_UPPER}]\w{{0,2}}\b)|([{_UPPER}]\w))")
_MID = re.compile(rf"(?<=[^\W\d_][ \n]){_SHAPES.pattern}|(?<=,[ \n]){_SHAPES.pattern}")
_MID_SMALL = re.compile(r"(?<=[^\W\d_,][ \n])[^\W\d_]|(?<=,[ \n])[^\W\d_]")
#: Tokens of more characters are words, whatever they look like.
LONGEST = 64
#: Letters of a token up to which its shape leaves open whether it is an abbreviation.
SHORT = 6
#: Tokens with fewer stops than this are judged by their shape alone.
MIN_SEEN = 5
#: The odds that a following token adds lie within this factor.
MOST_ODDS = 50.0
#: Tokens whose own counts overrule their shape travel to the executors up to this number; more are joined.
MAX_LISTED = 100_000


def _script(ch: str) -> str:
    o = ord(ch)
    if o < 0x250 or 0x1E00 <= o < 0x1F00:
        return "latin"
    if 0x2C80 <= o < 0x2D00 or 0x3E2 <= o < 0x3F0:
        return "coptic"
    if 0x370 <= o < 0x400 or 0x1F00 <= o < 0x2000:
        return "greek"
    if 0x530 <= o < 0x590 or 0xFB13 <= o < 0xFB18:
        return "armenian"
    if 0x700 <= o < 0x750:
        return "syriac"
    return "other"


_SCRIPTS: dict[str, str] = {}


class _Place:
    """Scripts, tokens and line starts around the candidates of a text, worked out in one pass from left to right."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.seen = 0
        self.script = ""
        self.token = 0

    def to(self, at: int) -> None:
        """Move on to a place: the script of the nearest letter before it (else after it), and where its token begins."""
        text = self.text
        j = at - 1
        while j >= self.seen and not text[j].isalpha():
            j -= 1
        if j >= self.seen:
            self.script = self._of(text[j])
        elif not self.script:
            j = at
            while j < len(text) and not text[j].isalpha():
                j += 1
            self.script = self._of(text[j]) if j < len(text) else "other"
        j = at
        while j > self.seen and not text[j - 1].isspace():
            j -= 1
        if j > self.seen or not at:
            self.token = j
        self.seen = at

    @staticmethod
    def _of(ch: str) -> str:
        if ch not in _SCRIPTS:
            _SCRIPTS[ch] = _script(ch)
        return _SCRIPTS[ch]


def _key(place: _Place, at: int) -> tuple[str, int]:
    """The token that ends at a place as it is counted, and where it starts, without opening marks.

    Digits are all alike, and so are tokens after a closing bracket and tokens too long to be abbreviations.
    """
    s = place.token
    if at - s > LONGEST:
        return "…", s
    text = place.text
    while s < at and text[s] in OPENERS:
        s += 1
    token = text[s:at]
    if token and not token[-1].isalnum():
        return token[-1], s
    return _DIGITS.sub("#", token), s


def _starts_line(text: str, at: int) -> bool:
    while at and text[at - 1] in " \t":
        at -= 1
    return not at or text[at - 1] == "\n"


#: Shape of the number of an item that begins a line.
ITEM = 5


def _shape(text: str, at: int) -> int:
    """Number of the shape of a capitalised token, 0 for any other token."""
    m = _SHAPES.match(text, at)
    return m.lastindex if m else 0


#: Kinds of context: settled as no boundary, settled as boundary, or open.
NO, YES, OPEN = 0, 1, 2


def _judge(place: _Place, m: re.Match) -> tuple[int, str, tuple[str, int]]:
    """What the context of a candidate settles, the key of the token before an open full stop, and the script and shape after it."""
    i, e = m.span()
    place.to(i)
    text, script, none = place.text, place.script, ("", 0)
    stop = text[i]
    if stop in ALWAYS and (script == "other" or stop not in "؟"):
        return YES, "", none
    if stop not in STOPS[script]:
        return NO, "", none
    n = len(text)
    inner = text[i - 1] if i else ""
    follows = text[e] if e < n else ""
    if script in CASELESS:
        return (NO if stop == "." and inner.isdigit() and follows.isdigit() else YES), "", none
    if stop == "⁘":
        return YES, "", none
    if not follows:
        return YES, "", none
    if not follows.isspace():
        return NO, "", none
    if stop == "…" and inner in "[(":
        return NO, "", none
    j = _GAP.match(text, e).end()
    if j == n:
        return YES, "", none
    k = j
    while k < n and (text[k] in OPENERS or text[k] in _SPACES):
        k += 1
    first = text[k] if k < n else ""
    if first.islower():
        return NO, "", none
    if first.isdigit():
        if not (text.find("\n", e, j) >= 0 and k == j and _ITEM.match(text, j)):
            return NO, "", none
    elif not first.isalpha() and first != "…":
        return NO, "", none
    if stop != "." or text.startswith("..", i):
        return YES, "", none
    key, start = _key(place, i)
    if text[start:i].isdigit() and _starts_line(text, start):
        return NO, "", none
    return OPEN, key, (script, ITEM if first.isdigit() else _shape(text, k))


def _cell(key: str, seen: int, final: int) -> tuple[int, ...]:
    """Features of a token: length, inner stop, case, numeral, digits, script, and how often it closes a block."""
    letters = sum(c.isalpha() for c in key)
    rate = round(np.log((final + 0.3) / (seen + 2.0))) if seen >= MIN_SEEN else -2
    return (int(letters == 1), int(letters <= 2), int(letters <= 4), int(letters > SHORT), int("." in key), int(key[:1].isupper()), int(bool(_ROMAN.fullmatch(key))), int("#" in key), int(not key[-1:].isalnum()), int(any(_script(c) == "greek" for c in key)), max(-8, min(0, rate)))


_CELL_NAMES = ("one", "two", "four", "long", "inner", "upper", "roman", "digits", "mark", "greek", "rate")


def fit(cells: np.ndarray, positive: np.ndarray, negative: np.ndarray, rounds: int = 50, ridge: float = 1e-2) -> np.ndarray:
    """Weights of a logistic model by Newton steps over cells with counts of either label."""
    x = np.column_stack([np.ones(len(cells)), cells.astype(float)])
    total = positive + negative
    w = np.zeros(x.shape[1])
    scale = 1.0 / max(1.0, total.sum())
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (positive - total * p) * scale - ridge * scale * w
        hessian = (x * (total * p * (1 - p) * scale)[:, None]).T @ x + (ridge * scale + 1e-9) * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w = w + np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return w


#: Score of what is certain.
SURE = 30.0


@dataclass(slots=True)
class Model:
    """The fitted weights, the odds of the token after a stop, and the tokens whose own counts overrule their shape."""

    weights: np.ndarray
    after: dict[tuple[str, int], float]
    decided: dict[str, float] = field(default_factory=dict)

    def ends(self, key: str, following: tuple[str, int], decided: dict[str, float] | None = None) -> bool:
        """Whether a full stop between these tokens ends a sentence."""
        own = (self.decided if decided is None else decided).get(key)
        return (self.shape(key) if own is None else own) + self.after.get(following, 0.0) > 0

    def shape(self, key: str) -> float:
        """Score of a token of which too little was seen: plain words end sentences, the model judges the rest."""
        letters = sum(c.isalpha() for c in key)
        if key == "…" or (letters > SHORT and "." not in key):  # unless it is seen inside sentences, see ``own``
            return SURE
        if key.isalpha() and letters > 1 and (key.islower() or letters > 3) and not _ROMAN.fullmatch(key):
            return SURE
        return self.score(_cell(key, 0, 0))

    def own(self, key: str, seen: int, final: int, inside: int) -> float:
        """The same by the token's own counts, where there are enough of them."""
        if key == "…" or (not inside and sum(c.isalpha() for c in key) > SHORT):
            return self.shape(key)
        if seen >= MIN_SEEN:
            return self.score(_cell(key, seen, final))
        return -SURE if inside and not final else self.shape(key)

    def overrules(self, key: str, own: float) -> bool:
        """Whether a token's own score decides otherwise than its shape for any token after it."""
        shape = self.shape(key)
        return any((own + x > 0) != (shape + x > 0) for x in self.after.values())

    def score(self, cell: tuple[int, ...]) -> float:
        return float(np.dot(self.weights, (1.0, *cell)))


_COUNTED = "kind string, key string, seen long, final long, inside long"


def token_counts(docs: DataFrame) -> DataFrame:
    """Counts over all documents, ``kind``, ``key``, ``seen``, ``final``, ``inside``.

    Kind ``before``: tokens before a full stop, how often, at the end of a block, and surely inside a sentence.
    Kind ``after``: shapes of tokens by script (``script:shape``), how often at the start of a block (``final``) and
    in the middle of a sentence (``inside``).
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        shapes: Counter = Counter()
        for batch in batches:
            for text in batch["text"]:
                if not text:
                    continue
                place = _Place(text)
                for m in _CANDIDATE.finditer(text):
                    i, e = m.span()
                    place.to(i)
                    if text[i] != "." or text.startswith("..", i) or place.script in CASELESS:
                        continue
                    key = _key(place, i)[0]
                    if not key:
                        continue
                    j = _GAP.match(text, e).end()
                    rest = text[j : j + 1]
                    if not rest or text.count("\n", e, j) > 1:
                        counts[key, "final"] += 1
                    elif j > e and (rest.islower() or (rest.isdigit() and text.find("\n", e, j) < 0)) or rest in ",:;":
                        counts[key, "inside"] += 1
                    else:
                        counts[key, "open"] += 1
                first = _GAP.match(text).end()
                for at in [first, *(m.end() for m in _BLANK.finditer(text))]:
                    if at < len(text) and (script := _Place._of(text[at])) in ("latin", "greek"):
                        shapes[script, _shape(text, at), "final"] += 1
                for m in _MID.finditer(text):
                    shapes[_Place._of(m.group()[0]), (m.lastindex - 1) % 4 + 1, "inside"] += 1
                for ch, n in Counter(_MID_SMALL.findall(text)).items():
                    if ch.islower():
                        shapes[_Place._of(ch), 0, "inside"] += n
        rows = [("before", k, sum(counts[k, x] for x in ("final", "inside", "open")), counts[k, "final"], counts[k, "inside"]) for k in {k for k, _ in counts}]
        rows += [("after", f"{a}:{b}", 0, shapes[a, b, "final"], shapes[a, b, "inside"]) for a, b in {x[:2] for x in shapes}]
        yield pd.DataFrame(rows, columns=["kind", "key", "seen", "final", "inside"])

    return docs.select("text").mapInPandas(count, _COUNTED).groupBy("kind", "key").agg(*[F.sum(c).alias(c) for c in ("seen", "final", "inside")])


def _after_odds(rows: list, prior: float) -> dict[tuple[str, int], float]:
    """Log odds of each script's shapes at the start of a block against the middle of a sentence.

    ``prior`` corrects the odds of a boundary: stops inside a block are no reliable positives but mostly ends.
    """
    most = np.log(MOST_ODDS)
    out = {("other", ITEM): prior + most, ("other", 0): prior}
    for script in ("latin", "greek"):
        held = {int(r.key.partition(":")[2]): (r.final, r.inside) for r in rows if r.key.startswith(script + ":")}
        starts, middles = (sum(x[i] for x in held.values()) for i in (0, 1))
        for shape in range(5):
            start, middle = held.get(shape, (0, 0))
            odds = np.log((start + 1.0) / (starts + 5.0)) - np.log((middle + 1.0) / (middles + 5.0)) if shape and starts and middles else 0.0
            out[script, shape] = prior + float(np.clip(odds, -most, most))
        out[script, ITEM] = prior + most
    return out


def train(docs: DataFrame) -> tuple[Model, DataFrame]:
    """Fit on the reliable boundaries of all documents: the model, and ``key``, ``score`` of the tokens that overrule their shape."""
    known = durable(token_counts(docs))

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(*_cell(k, s, f), f, i) for k, s, f, i in zip(b["key"], b["seen"], b["final"], b["inside"], strict=True)]
            yield pd.DataFrame(rows, columns=[*_CELL_NAMES, "final", "inside"])

    before = known.where("kind = 'before'")
    schema = ", ".join(f"{c} int" for c in _CELL_NAMES) + ", final long, inside long"
    summed = before.mapInPandas(cells, schema).groupBy(*_CELL_NAMES).agg(F.sum("final").alias("final"), F.sum("inside").alias("inside")).toPandas()
    if summed["final"].sum() and summed["inside"].sum():
        weights = fit(summed[list(_CELL_NAMES)].to_numpy(), summed["final"].to_numpy(float), summed["inside"].to_numpy(float))
    else:
        weights = np.array([3.0, -8.0, *[0.0] * (len(_CELL_NAMES) - 1)])
    total = before.agg(F.sum("seen"), F.sum("final"), F.sum("inside")).first()
    prior = float(np.log(max(1.0, (total[0] - total[2]) / total[1]))) if total[1] else 0.0
    model = Model(weights, _after_odds(known.where("kind = 'after'").collect(), prior))

    def verdicts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            own = np.array([model.own(*r) for r in zip(x["key"], x["seen"], x["final"], x["inside"], strict=True)])
            listed = [model.overrules(k, o) for o, k in zip(own, x["key"], strict=True)]
            yield pd.DataFrame({"key": x["key"], "score": own})[listed]

    return model, before.select("key", "seen", "final", "inside").mapInPandas(verdicts, "key string, score double")


def open_keys(text: str) -> list[str]:
    """Distinct tokens of a text on which the model has to decide."""
    place = _Place(text)
    return sorted({key for verdict, key, _ in (_judge(place, m) for m in _CANDIDATE.finditer(text)) if verdict == OPEN})


def spans(text: str, model: Model, decided: dict[str, float] | None = None) -> tuple[list[int], list[int]]:
    """Starts and ends of the sentences of a text; together they cover all but white space."""
    cuts = [m.start() for m in _BLANK.finditer(text)]
    place = _Place(text)
    for m in _CANDIDATE.finditer(text):
        verdict, key, following = _judge(place, m)
        if verdict == YES or (verdict == OPEN and model.ends(key, following, decided)):
            cuts.append(m.end())
    cuts.append(len(text))
    starts, ends, at = [], [], 0
    for cut in sorted(cuts):
        a, b = at, cut
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if a < b:
            starts.append(a)
            ends.append(b)
        at = max(at, cut)
    return starts, ends


def split_sentences(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``sent_start``, ``sent_end``: code-point spans of the sentences of every document.

    Null, empty and blank texts have no sentences; a null ``doc_id`` is kept; texts of any length are read
    whole; repeated rows give repeated spans; other columns are ignored; an empty table gives an empty result.
    """
    read = docs.select("doc_id", "text").where(F.col("text").isNotNull())
    model, listed = train(read)
    some = listed.limit(MAX_LISTED + 1).collect()
    kind = "s array<int>, e array<int>"

    def table_of(out: list) -> pd.DataFrame:
        return pd.DataFrame({"s": [np.array(a, dtype=np.int32) for a, _ in out], "e": [np.array(b, dtype=np.int32) for _, b in out]})

    if len(some) <= MAX_LISTED:
        model.decided = {r.key: r.score for r in some}
        found = read.select("doc_id", F.pandas_udf(lambda texts: table_of([spans(t, model) for t in texts]), kind)("text").alias("x"))
    else:
        # The same by joins: each text, once, meets the scores of its own open tokens.
        digest = F.md5("text").alias("digest")
        keys = F.pandas_udf(lambda texts: texts.map(open_keys), "array<string>")
        asked = read.select(digest, "text").dropDuplicates(["digest"]).select("digest", F.explode(keys("text")).alias("key"))
        scores = asked.join(listed, "key").groupBy("digest").agg(F.map_from_entries(F.collect_list(F.struct("key", "score"))).alias("scores"))

        def cut(texts: pd.Series, given: pd.Series) -> pd.DataFrame:
            return table_of([spans(t, model, dict(g) if g is not None else {}) for t, g in zip(texts, given, strict=True)])

        found = read.select("doc_id", "text", digest).join(scores, "digest", "left").select("doc_id", F.pandas_udf(cut, kind)("text", "scores").alias("x"))
    return found.select("doc_id", F.explode(F.arrays_zip(F.col("x.s").alias("s"), F.col("x.e").alias("e"))).alias("z")).select("doc_id", F.col("z.s").cast("bigint").alias("sent_start"), F.col("z.e").cast("bigint").alias("sent_end"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_sentences(table(spark, sf_dir, "documents"))
