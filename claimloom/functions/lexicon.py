"""Words of events by their base forms, the inflections of English verbs and nouns, and word tests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Base forms of words that tell of an event (fixed values).
EVENTS = (
    "increase decrease approve pass sign launch cut raise introduce exceed fall rise strike kill injure arrest acquire invest vote unveil ban reject win lose appoint resign allocate budget hit reach "
    "commence begin start publish agree complete open close build cause prevent cure treat trigger link correlate contribute result lead worsen improve associate flood earthquake landslide avalanche "
    "tsunami cyclone hurricane tornado typhoon drought wildfire outbreak epidemic pandemic explosion explode crash collapse submerge inundate evacuate displace devastate destroy damage occur happen erupt "
    "experience landfall"
).split()
#: Past forms that no rule gives (fixed values).
IRREGULAR = {"fall": "fell fallen", "rise": "rose risen", "strike": "struck", "win": "won", "lose": "lost", "begin": "began begun", "build": "built", "lead": "led"}
#: Forms of be, have and do (fixed values).
AUXILIARIES = "is are was were be been has have had do does did".split()
#: Verbs of saying (fixed values).
SAYING = "said announced stated declared reported confirmed claimed noted added revealed disclosed explained asserted warned expressed informed emphasized".split()
VOWELS = "aeiou"
#: Stressed on the last of several syllables, so that the last letter doubles.
LAST_STRESSED = {"occur", "begin"}


def inflections(word: str) -> list[str]:
    """The word, its plural or third person, its past and its ing-form."""
    s = word + ("es" if word.endswith(("s", "sh", "ch", "x", "o")) else "s")
    stem = word[:-1] if word.endswith("e") else word
    closed = len(word) > 2 and word[-1] not in VOWELS + "wxy" and word[-2] in VOWELS and word[-3] not in VOWELS
    if closed and (sum(c in VOWELS for c in word) == 1 or word in LAST_STRESSED):
        stem += word[-1]
    return [word, s, stem + "ed", stem + "ing", *IRREGULAR.get(word, "").split()]


def event_words() -> list[str]:
    return list(dict.fromkeys(f for w in EVENTS for f in inflections(w)))


def letters(text: Column) -> Column:
    """Words of a text in lower case, split at anything but letters, digits and underscores."""
    return F.split(F.lower(text), r"[^\p{L}\p{N}_]+")


def has_word(text: Column, words: list[str]) -> Column:
    """One of many words: a hash lookup for each word of the text."""
    return F.exists(letters(text), lambda w: w.isin(words))


def has_word_sql(text: str, words: list[str]) -> str:
    given = ", ".join(f"'{w}'" for w in words)
    return rf"list_has_any(string_split_regex(lower({text}), '[^\p{{L}}\p{{N}}_]+'), [{given}])"
