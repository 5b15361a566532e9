"""loquat: a Spark-native engine that reads written Vietnamese and mixed Vietnamese/English text aloud."""

from loquat.operators.g2p import phonemize
from loquat.operators.normalize import normalize
from loquat.operators.pipeline import text_to_phonemes
from loquat.session import register_functions
from loquat.sources.lexicon import load_lexicon, seed_lexicon

__all__ = ["load_lexicon", "normalize", "phonemize", "register_functions", "seed_lexicon", "text_to_phonemes"]
