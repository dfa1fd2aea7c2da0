"""One consistent form of characters: invisible, spacing, compatibility, case and look-alike differences.

Two forms are offered.  ``consistent_form`` keeps words, marks and punctuation; ``letter_skeleton`` keeps
folded base letters and digits only.  Both work on distinct values of a batch, character by character
through a memo, so a batch costs one dictionary look-up a character.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import numpy as np
import pandas as pd

# Letters of different scripts that are drawn alike, one group a line; no group holds two
# letters of one script, so that letters which differ within a script stay different.
LOOK_ALIKES = """
a а α
c с ⲥ ϲ
d ԁ
e е
g ց ɡ
h һ հ
i і ι
j ј ϳ յ
k к κ
l ӏ
n ո
o о ο օ ⲟ
p р ρ ⲣ
q ԛ զ
s ѕ
u ս υ
v ѵ ν
w ԝ
x х
y у
A А Α Ⲁ Ꭺ ꓮ
B В Β Ⲃ Ᏼ ꓐ
C С Ⲥ Ϲ Ꮯ ꓚ
D Ꭰ ꓓ
E Е Ε Ⲉ Ꭼ ꓰ
F Ϝ ꓝ
G Ԍ Ꮐ ꓖ
H Н Η Ⲏ Ꮋ ꓧ
I І Ι Ⲓ Ӏ ꓲ
J Ј Ꭻ ꓙ
K К Κ Ⲕ Ꮶ ꓗ
L Լ Ꮮ ꓡ
M М Μ Ⲙ Ꮇ ꓟ
N Ν Ⲛ ꓠ
O О Ο Օ Ⲟ ꓳ
P Р Ρ Ⲣ Ꮲ ꓑ
Q Ԛ
R Ꭱ ꓣ
S Ѕ Տ Ꮪ ꓢ
T Т Τ Ⲧ Ꭲ ꓔ
U Ս ꓴ
V Ѵ Ꮩ ꓦ
W Ԝ Ꮃ ꓪ
X Х Χ Ⲭ ꓫ
Y Υ Ү Ⲩ ꓬ
Z Ζ Ⲍ Ꮓ ꓜ
Γ Г Ⲅ
Π П Ⲡ
Φ Ф Ⲫ
Θ Ѳ Ⲑ
: ։ ׃
- ‐ ‑ −
""".split("\n")
_TWIN = {ch: line.split()[0] for line in LOOK_ALIKES if line for ch in line.split()[1:]}

# The Default_Ignorable_Code_Point property, as ranges.
IGNORABLE_RANGES = (
    (0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F),
    (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
)


def is_ignorable(ch: str) -> bool:
    """Default-ignorable: drawn as nothing.  Control characters that are no white space count too.

    Format characters with a shape of their own (the Syriac abbreviation mark, the Arabic number sign) stay.
    """
    if unicodedata.category(ch) == "Cc":
        return not ch.isspace()
    return any(a <= ord(ch) <= b for a, b in IGNORABLE_RANGES)


class _Memo(dict):
    """Translation table for ``str.translate`` that works out each character once."""

    def __init__(self, of: Callable[[str], str]) -> None:
        super().__init__()
        self._of = of

    def __missing__(self, code: int) -> str:
        self[code] = out = self._of(chr(code))
        return out


def _twin(ch: str) -> str:
    """Look-alike representative of a character, looked through its accents and compatibility form."""
    return _TWIN.get(ch, ch)


def _visible(ch: str) -> str:
    if ch.isspace():
        return " "
    return "" if is_ignorable(ch) else _twin(ch)


_VISIBLE = _Memo(_visible)
_SPACED = _Memo(lambda ch: " " if ch.isspace() else "" if is_ignorable(ch) else ch)
_TWINS = _Memo(lambda ch: unicodedata.normalize("NFC", "".join(_twin(c) for c in unicodedata.normalize("NFD", ch))))


def normalise(text: str) -> str:
    """Compatibility composition, full case folding, plain spaces, no ignorable characters."""
    out = unicodedata.normalize("NFKC", text.translate(_SPACED)).casefold()
    return " ".join(unicodedata.normalize("NFKC", out.translate(_SPACED)).split())


def consistent_form(text: str, fold_case: bool = True) -> str:
    """``normalise`` with look-alike letters brought to one representative.

    With ``fold_case`` False case is kept: then two texts have the same form exactly if they look the same.
    """
    out = unicodedata.normalize("NFKC", text.translate(_VISIBLE)).translate(_VISIBLE)
    if fold_case:
        out = unicodedata.normalize("NFKC", out.casefold())
    return " ".join(unicodedata.normalize("NFC", out.translate(_TWINS)).split())


def _bare(ch: str) -> str:
    out = []
    if ch == ch.lower():  # twins of capitals would part them from their own small letters
        ch = _twin(ch)
    for c in unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", ch).casefold()):
        c = _twin(c)
        if unicodedata.category(c)[0] in "LN":
            out.append("σ" if c == "ς" else c.lower())
    return "".join(out)


_BARE = _Memo(_bare)


def letter_skeleton(text: str) -> str:
    """Folded base letters and digits: no case, accents, punctuation, spaces, look-alikes or invisibles."""
    return text.translate(_BARE)


def per_distinct(series: pd.Series, of: Callable[[str], str | None]) -> pd.Series:
    """``of`` applied once to each distinct value of the batch; null stays null."""
    codes, values = pd.factorize(series, use_na_sentinel=True)
    done = np.array([of(v) for v in values] + [None], dtype=object)
    return pd.Series(done[codes], index=series.index)
