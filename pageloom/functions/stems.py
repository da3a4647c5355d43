"""Stems of German words by the published suffix-stripping rules of the Snowball project."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Vowels, letters that may stand before an ending s or st, and the endings of each step.
VOWELS, BEFORE_S, BEFORE_ST = "aeiouyäöü", "bdfghklmnrt", "bdfghklmnt"
FIRST_ENDINGS, SECOND_ENDINGS = ("em", "ern", "er", "en", "es", "e"), ("en", "er", "est")

_V, _C = f"[{VOWELS}]", f"[^{VOWELS}]"
#: What comes before region 1 (after the first consonant behind a vowel), and before region 2 (the same again).
BEFORE_R1, BEFORE_R2 = f"{_C}*{_V}+{_C}", f"{_C}*{_V}+{_C}{_C}*{_V}+{_C}"
# Region 1 begins behind three letters at least, so a word of one vowel and one consonant in front needs a letter more.
_R1 = f"(?:(?:{_C}+{_V}+|{_V}{{2,}}){_C}.*?|{_V}{_C}..*?)"
_FIRST = f"^({_R1})(?:(?<=nis)s(?:e|en|es)|{'|'.join(FIRST_ENDINGS)}|(?<=[{BEFORE_S}])s)$"
_SECOND = f"^({_R1})(?:{'|'.join(SECOND_ENDINGS)}|(?<=.{{3}}[{BEFORE_ST}])st)$"
_THIRD = f"^(?:(?={BEFORE_R2}.*(?:lich|heit)$)({_R1})(?:er|en)?(?:lich|heit)|({BEFORE_R2}.*?)(?:(?:(?<!e)ig)?(?:end|ung)|(?<!e)(?:ig|ik|isch)|(?:lich|ig)?keit))$"


def stem(word: Column) -> Column:
    """The stem of a word in lower case: three steps take endings off that lie behind the word's first or second syllable, and umlauts lose their dots. Null stays null. Each step reads the one before it once, so the expression stays as long as it is written."""
    out = F.replace(word, F.lit("ß"), F.lit("ss"))
    for letter in "uuyy":  # between vowels these are consonants; matches overlap, hence twice
        out = F.regexp_replace(out, f"({_V}){letter}({_V})", f"$1{letter.upper()}$2")
    out = F.regexp_replace(F.regexp_replace(out, _FIRST, "$1"), _SECOND, "$1")
    return F.translate(F.regexp_replace(out, _THIRD, "$1$2"), "UYäöü", "uyaou")
