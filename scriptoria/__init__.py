"""scriptoria: text-recognition analytics on Spark DataFrames."""

from scriptoria.functions.profile import CYRILLIC, LATIN, AlphabetProfile
from scriptoria.functions.text import cer, normalize, normalize_lite, wer

__all__ = ["CYRILLIC", "LATIN", "AlphabetProfile", "cer", "normalize", "normalize_lite", "wer"]
