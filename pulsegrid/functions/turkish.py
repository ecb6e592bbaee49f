"""The published Snowball stemmer for Turkish, as tables of suffix classes and a small machine that takes them off from the end.

A word is read backwards. Classes name suffixes, whether vowel harmony must hold, and which letter may stand between stem and suffix;
chains say in which order classes may follow each other, and what is cut off on the way. A cut stays made where a chain fails later on.
Words come in Turkish lower case. Words of one syllable, and those that no chain fits, stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

# --- Fixed values of the published algorithm ---------------------------------------------------------------------------

VOWELS = "aeıioöuü"
CLOSE = "ıiuü"
#: Which vowels may come before a vowel.
HARMONY = {"a": "aıou", "e": "eiöü", "ı": "aı", "i": "ei", "o": "ou", "ö": "öü", "u": "ou", "ü": "öü"}
#: Name: suffixes, whether harmony must hold, the letter that may join it to the stem (U: a close vowel).
CLASSES = {
    "possessive": ("mız miz muz müz nız niz nuz nüz m n", False, "U"),
    "sU": ("ı i u ü", True, "s"),
    "lArI": ("leri ları", False, ""),
    "yU": ("ı i u ü", True, "y"),
    "nU": ("nı ni nu nü", True, ""),
    "nUn": ("ın in un ün", True, "n"),
    "yA": ("a e", True, "y"),
    "nA": ("na ne", True, ""),
    "DA": ("da de ta te", True, ""),
    "ndA": ("nda nde", True, ""),
    "DAn": ("dan den tan ten", True, ""),
    "ndAn": ("ndan nden", True, ""),
    "ylA": ("la le", True, "y"),
    "ki": ("ki", False, ""),
    "ncA": ("ca ce", True, "n"),
    "yUm": ("ım im um üm", True, "y"),
    "sUn": ("sın sin sun sün", True, ""),
    "yUz": ("ız iz uz üz", True, "y"),
    "sUnUz": ("sınız siniz sunuz sünüz", False, ""),
    "lAr": ("ler lar", True, ""),
    "nUz": ("nız niz nuz nüz", True, ""),
    "DUr": ("tır tir tur tür dır dir dur dür", True, ""),
    "cAsInA": ("casına cesine", False, ""),
    "yDU": ("tım tim tum tüm dım dim dum düm tın tin tun tün dın din dun dün tık tik tuk tük dık dik duk dük tı ti tu tü dı di du dü", True, "y"),
    "ysA": ("sam san sak sem sen sek sa se", False, "y"),
    "ymUş": ("mış miş muş müş", True, "y"),
    "yken": ("ken", False, "y"),
}
HARDENED = {"b": "p", "c": "ç", "d": "t", "ğ": "k"}
RESERVED = ("ad", "soyad")

# --- Machine -----------------------------------------------------------------------------------------------------------


class _Word:
    __slots__ = ("at", "mark", "nouns", "text")

    def __init__(self, text: str) -> None:
        self.text, self.at, self.mark, self.nouns = text, len(text), 0, True


Step = Callable[[_Word], bool]


def _harmonic(left: str) -> bool:
    at = max(left.rfind(v) for v in VOWELS)
    return at >= 0 and any(c in HARMONY[left[at]] for c in left[:at])


def _suffix(name: str) -> Step:
    """Step over a suffix of a class, the longest that is there, and the letter that joins it."""
    endings, harmony, joint = CLASSES[name]
    by_length = tuple(sorted(endings.split(), key=len, reverse=True))
    joints, inner = (CLOSE, lambda c: c not in VOWELS) if joint == "U" else (joint, lambda c: c in VOWELS)

    def step(w: _Word) -> bool:
        if not w.text.endswith(by_length, 0, w.at):  # most words end here, before the search for vowels
            return False
        left = w.text[: w.at]
        if harmony and not _harmonic(left):
            return False
        w.at -= next(len(e) for e in by_length if left.endswith(e))
        if joint:
            if w.at < 2 or not inner(w.text[w.at - 2]):
                return False
            w.at -= w.text[w.at - 1] in joints
        return True

    return step


def _all(*steps: Step) -> Step:
    return lambda w: all(s(w) for s in steps)


def _any(*steps: Step) -> Step:
    def step(w: _Word) -> bool:
        right = len(w.text) - w.at
        for s in steps:
            if s(w):
                return True
            w.at = len(w.text) - right
        return False

    return step


def _maybe(*steps: Step) -> Step:
    return _any(_all(*steps), lambda w: True)


def _open(w: _Word) -> bool:
    w.mark = len(w.text) - w.at
    return True


def _cut(w: _Word) -> bool:
    w.text = w.text[: w.at] + w.text[len(w.text) - w.mark :]
    return True


def _no_nouns(w: _Word) -> bool:
    w.nouns = False
    return True


# --- Chains ------------------------------------------------------------------------------------------------------------

_S = {name: _suffix(name) for name in CLASSES}


def _one(*names: str) -> Step:
    return _any(*(_S[n] for n in names))


def _before_ki(w: _Word) -> bool:
    return _KI(w)


_plural = _all(_open, _S["lAr"], _cut)
_plural_then_ki = _maybe(_plural, _before_ki)
_owned = _all(_one("possessive", "sU"), _cut, _plural_then_ki)
_person = _maybe(_one("sUnUz", "lAr", "yUm", "sUn", "yUz"))

_KI = _all(
    _open,
    _S["ki"],
    _any(
        _all(_S["DA"], _cut, _maybe(_open, _any(_all(_S["lAr"], _cut, _maybe(_before_ki)), _all(_S["possessive"], _cut, _plural_then_ki)))),
        _all(_S["nUn"], _cut, _maybe(_open, _any(_all(_S["lArI"], _cut), _all(_open, _owned), _before_ki))),
        _all(_S["ndA"], _any(_all(_S["lArI"], _cut), _all(_S["sU"], _cut, _plural_then_ki), _before_ki)),
    ),
)
_VERBS = _all(
    _open,
    _any(
        _one("ymUş", "yDU", "ysA", "yken"),
        _all(_S["cAsInA"], _person, _S["ymUş"]),
        _all(_S["lAr"], _cut, _maybe(_open, _one("DUr", "yDU", "ysA", "ymUş")), _no_nouns),
        _all(_S["nUz"], _one("yDU", "ysA")),
        _all(_one("sUnUz", "yUz", "sUn", "yUm"), _cut, _maybe(_open, _S["ymUş"])),
        _all(_S["DUr"], _cut, _maybe(_open, _person, _S["ymUş"])),
    ),
    _cut,
)
_NOUNS = _any(
    _all(_plural, _maybe(_before_ki)),
    _all(_open, _S["ncA"], _cut, _maybe(_any(_all(_open, _S["lArI"], _cut), _all(_open, _owned), _all(_plural, _before_ki)))),
    _all(_open, _one("ndA", "nA"), _any(_all(_S["lArI"], _cut), _all(_S["sU"], _cut, _plural_then_ki), _before_ki)),
    _all(_open, _one("ndAn", "nU"), _any(_all(_S["sU"], _cut, _plural_then_ki), _S["lArI"])),
    _all(_open, _S["DAn"], _cut, _maybe(_open, _any(_all(_S["possessive"], _cut, _maybe(_plural, _maybe(_before_ki))), _all(_S["lAr"], _cut, _maybe(_before_ki)), _before_ki))),
    _all(_open, _one("nUn", "ylA"), _cut, _maybe(_any(_all(_plural, _before_ki), _all(_open, _owned), _before_ki))),
    _all(_open, _S["lArI"], _cut),
    _before_ki,
    _all(_open, _one("DA", "yU", "yA"), _cut, _maybe(_open, _any(_all(_S["possessive"], _cut, _maybe(_open, _S["lAr"])), _S["lAr"]), _cut, _open, _before_ki)),
    _all(_open, _owned),
)


@lru_cache(200_000)
def stem(word: str) -> str:
    if sum(c in VOWELS for c in word) < 2:
        return word
    w = _Word(word)
    _VERBS(w)
    if w.nouns:
        w.at = len(w.text)
        _NOUNS(w)
    out = w.text
    if out in RESERVED:
        return out
    if out[-1:] in ("d", "g"):
        last = next((c for c in reversed(out) if c in VOWELS), "")
        out += {"a": "ı", "ı": "ı", "e": "i", "i": "i", "o": "u", "u": "u", "ö": "ü", "ü": "ü"}.get(last, "")
    return out[:-1] + HARDENED[out[-1]] if out[-1:] in HARDENED else out
