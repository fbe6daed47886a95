"""The English (Porter2) stemmer, after the published algorithm."""

from __future__ import annotations

import re

VOWELS = "aeiouy"
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")

#: Fixed values of the algorithm: words with stems of their own, words left alone, and suffixes with what replaces them.
SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
INVARIANT = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
STEP2 = {
    "ization": "ize", "ational": "ate", "ousness": "ous", "iveness": "ive", "fulness": "ful", "tional": "tion", "lessli": "less", "biliti": "ble", "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al", "fulli": "ful", "ousli": "ous", "iviti": "ive",
    "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble",
}
STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")


def _region(word: str, start: int) -> int:
    """The end of the first non-vowel that follows a vowel, from ``start``."""
    m = re.compile(r"[aeiouy][^aeiouy]").search(word, start)
    return m.end() if m else len(word)


def _short_end(word: str) -> bool:
    """Whether a word ends in a short syllable."""
    return bool(re.search(r"[^aeiouy][aeiouy][^aeiouywxY]$", word) or re.fullmatch(r"[aeiouy][^aeiouy]", word))


def stem(word: str) -> str:
    """The stem of a lower-case English word."""
    if len(word) <= 2:
        return word
    word = word.removeprefix("'")
    if word in SPECIAL:
        return SPECIAL[word]
    word = re.sub(r"^y|(?<=[aeiouy])y", "Y", word)
    for prefix in ("gener", "commun", "arsen"):
        if word.startswith(prefix):
            r1 = len(prefix)
            break
    else:
        r1 = _region(word, 0)
    r2 = _region(word, r1)
    word = re.sub(r"'s'$|'s$|'$", "", word)
    # step 1a
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and re.search(r"[aeiouy]", word[:-2]):
        word = word[:-1]
    if word in INVARIANT:
        return word
    # step 1b
    m = re.search(r"(eedly|eed|ingly|edly|ing|ed)$", word)
    if m and m[1] in ("eed", "eedly"):
        if m.start() >= r1:
            word = word[: m.start()] + "ee"
    elif m and re.search(r"[aeiouy]", word[: m.start()]):
        word = word[: m.start()]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif word.endswith(DOUBLES):
            word = word[:-1]
        elif r1 >= len(word) and _short_end(word):
            word += "e"
    # step 1c
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in VOWELS:
        word = word[:-1] + "i"
    # step 2
    for suffix in sorted(STEP2, key=len, reverse=True):
        if word.endswith(suffix):
            if len(word) - len(suffix) >= r1:
                word = word[: -len(suffix)] + STEP2[suffix]
            break
    else:
        if word.endswith("ogi") and len(word) - 3 >= r1 and word[-4:-3] == "l":
            word = word[:-1]
        elif word.endswith("li") and len(word) - 2 >= r1 and word[-3:-2] in tuple("cdeghkmnrt"):
            word = word[:-2]
    # step 3
    for suffix in sorted([*STEP3, "ative"], key=len, reverse=True):
        if word.endswith(suffix):
            at = len(word) - len(suffix)
            if suffix == "ative":
                word = word[:at] if at >= r2 else word
            elif at >= r1:
                word = word[:at] + STEP3[suffix]
            break
    # step 4
    for suffix in sorted([*STEP4, "ion"], key=len, reverse=True):
        if word.endswith(suffix):
            at = len(word) - len(suffix)
            if at >= r2 and (suffix != "ion" or word[at - 1 : at] in ("s", "t")):
                word = word[:at]
            break
    # step 5
    if word.endswith("e") and (len(word) - 1 >= r2 or (len(word) - 1 >= r1 and not _short_end(word[:-1]))):
        word = word[:-1]
    elif word.endswith("l") and len(word) - 1 >= r2 and word[-2:-1] == "l":
        word = word[:-1]
    return word.replace("Y", "y")
