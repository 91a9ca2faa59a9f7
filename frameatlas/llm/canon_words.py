"""Other words for the entries of the gender list, built from a few stems."""

from __future__ import annotations

# fixed values: ways of writing the listed genders
_FEMALE = ["woman", "women", "female", "females", "lady", "ladies"]
_MALE = ["man", "men", "male", "males", "gentleman", "gentlemen"]
_OLD = ["old", "older", "elderly", "senior", "aged", "mature"]
_YOUNG = ["young", "younger"]
_CHILD = ["little", "small", "school", "young", "baby", "teenage", "teen"]

GENDER_VARIANTS: dict[str, list[str]] = {
    "woman": [*_FEMALE, *(f"adult {w}" for w in _FEMALE), "f", "w", "fem"],
    "man": [*_MALE, *(f"adult {w}" for w in _MALE), "m", "guy", "guys"],
    "girl": ["girls", "female child", "female children", "child female", *(f"{a} {w}" for a in _CHILD for w in ("girl", "girls"))],
    "boy": ["boys", "male child", "male children", "child male", *(f"{a} {w}" for a in _CHILD for w in ("boy", "boys"))],
    "older woman": [f"{a} {w}" for a in _OLD for w in _FEMALE],
    "older man": [f"{a} {w}" for a in _OLD for w in _MALE],
    "young woman": [f"{a} {w}" for a in _YOUNG for w in _FEMALE],
    "young man": [f"{a} {w}" for a in _YOUNG for w in _MALE],
    "nonbinary": ["non binary", "enby", "nb", "non binary person", "genderqueer"],
    "transgender": ["trans", "transgendered", "transgendered person", "trans person"],
    "mixed group": ["mixed", "mixed gender", "mixed genders", "mixed gender group", "group mixed", "both", "both genders", "all genders", "all genders group", *(f"{a}{c}{b}" for x, y in zip(_FEMALE, _MALE) for a, b in ((x, y), (y, x)) for c in (" and ", " ", " with "))],
}
