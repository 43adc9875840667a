"""What an alphabet is made of, as data: letters, look-alikes, digits read as letters, punctuation."""

from __future__ import annotations

from dataclasses import dataclass

#: White space as Python's str.isspace has it, for a Java character class.
JAVA_SPACE = r"\t\n\x0B\f\r\x1C-\x20\x85   -     　"
#: Digits as Python's str.isdigit has them: decimal digits of any script, super- and subscripts, circled digits.
JAVA_DIGIT = r"\p{Nd}²³¹⁰⁴-⁹₀-₉①-⑨⑴-⑼⒈-⒐⓪⓵-⓽⓿❶-❾➀-➈➊-➒"


def ranges(chars: str) -> str:
    """The characters as ranges of a character class: engines test a range faster than its members."""
    codes, out = sorted(set(map(ord, chars))), []
    for c in codes:
        if out and c == out[-1][1] + 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(chr(a) if a == b else f"{chr(a)}{chr(b)}" if b == a + 1 else f"{chr(a)}-{chr(b)}" for a, b in out)


@dataclass(frozen=True)
class AlphabetProfile:
    """`letters` lists the lower-case letters in the order in which spelling edits try them."""

    letters: str
    punctuation: str
    confusable_from: str = ""
    confusable_to: str = ""
    digit_from: str = ""
    digit_to: str = ""
    #: Letters besides the profile's own that a token may hold before it is mapped.
    foreign: str = "A-Za-z"

    @property
    def letter_class(self) -> str:
        """Both cases of the letters, to stand in a character class of Java, RE2 or Python."""
        return ranges(self.letters.upper() + self.letters)

    @property
    def token_pattern(self) -> str:
        return f"[{self.foreign}{self.letter_class}0-9]+"

    @property
    def punctuation_class(self) -> str:
        return "".join("\\" + c if c in "[]-^\\&" else c for c in self.punctuation)


# The Russian alphabet, the punctuation kept in results, Latin letters that look like
# Cyrillic ones, and digits that stand for letters inside words.
CYRILLIC = AlphabetProfile(
    letters="абвгдеёжзийклмнопрстуфхцчшщъыьэюя",
    punctuation=" .,!?;:-()[]{}\"'«»„“”%№+/=…—–",
    confusable_from="ABCEHKMOPTXYacekmoptxyijub",
    confusable_to="АВСЕНКМОРТХУасекмортхуийив",
    digit_from="036789",
    digit_to="озбтва",
)
LATIN = AlphabetProfile(letters="abcdefghijklmnopqrstuvwxyz", punctuation=CYRILLIC.punctuation, foreign="")
