"""Pronunciation lexicons: the table, a seed, and files of them.

A lexicon has one row a word: ``word`` (lower case), ``kind`` ("merged": one pronunciation, ``phone``, English if
``is_en``; "common": a word of both languages with ``vi_phone`` and ``en_phone``).
"""

from __future__ import annotations

import json
import re
from collections import defaultdict
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .pooled import SCHEMA, read_pooled, write_sorted

FIXTURES = Path(__file__).resolve().parent.parent / "fixtures"
_TOKEN = re.compile(r"(?i)<en>.*?</en>|\w+(?:['’]\w+)*|[^\w\s]")
_INNER = re.compile(r"\w+(?:['’]\w+)*|[^\w\s]")


def merged(word: str, phone: str, english: bool = False) -> tuple:
    return word, "merged", phone, english, None, None


def common(word: str, vi: str, en: str) -> tuple:
    return word, "common", None, None, vi, en


def fixture(name: str) -> list[list]:
    return json.loads((FIXTURES / f"{name}.json").read_text())


# Sounds that only English words have here; words that the goldens say in two parts.
ENGLISH_SOUNDS = "ɪʊɹɾæʌɑ"
TWO_PARTS = {"mixedcase": ("mixed", "case")}


def seed_rows() -> list[tuple]:
    """Words of the golden pronunciations, whose text and phonemes align one to one.

    The language is inferred: a pronunciation is English if it is only met in English spans, or the word has no
    accent and a sound that only English has then. A word with a pronunciation of each language is common to both.
    """
    vi: dict[str, list[str]] = defaultdict(list)
    en: dict[str, list[str]] = defaultdict(list)
    for _, text, phones in fixture("phonemize_golden"):
        words = []
        for token in _TOKEN.findall(text):
            tagged = token[:4].lower() == "<en>"
            for word in _INNER.findall(token[4:-5]) if tagged else [token.lower()]:
                words += [(w, tagged) for w in TWO_PARTS.get(word, (word.lower(),)) if re.match(r"\w", w)]
        said = [x for x in re.sub(r"([.,!?;:])(?=\s|$)", r" \1", phones).split() if not re.fullmatch(r"[^\w\s]", x)]
        if len(words) == len(said):
            for (word, tagged), phone in zip(words, said, strict=True):
                (en if tagged or word.isascii() and set(phone) & set(ENGLISH_SOUNDS) else vi)[word].append(phone)
    rows = []
    for word in sorted({*vi, *en}):
        if word in vi and word in en and vi[word][0] != en[word][0]:
            rows.append(common(word, vi[word][0], en[word][0]))
        else:
            rows.append(merged(word, (vi.get(word) or en[word])[0], word not in vi))
    return rows


def seed_lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(seed_rows(), SCHEMA)


def overlay(*lexicons: DataFrame) -> DataFrame:
    """One row a word: of the first lexicon that has it; within one, "merged" before "common", then the smallest."""
    both = None
    for k, lexicon in enumerate(lexicons):
        part = lexicon.select("word", "kind", "phone", "is_en", "vi_phone", "en_phone").withColumn("_rank", F.lit(k))
        both = part if both is None else both.unionByName(part)
    order = W.partitionBy("word").orderBy("_rank", F.desc("kind"), "phone", "vi_phone", "en_phone")
    return both.withColumn("_first", F.row_number().over(order)).filter("_first = 1").drop("_rank", "_first")


def load_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """A lexicon from Parquet, or from a string-pooled file; missing files and other files raise."""
    if path.endswith(".parquet"):
        return spark.read.parquet(path).select("word", "kind", "phone", "is_en", "vi_phone", "en_phone")
    return read_pooled(spark, path)


def save_lexicon(lexicon: DataFrame, path: str, overwrite: bool = False) -> None:
    """A lexicon as a string-pooled file (repeated words as in ``overlay``); a file that is there raises if it isn't to be replaced."""
    write_sorted(overlay(lexicon), path, overwrite)
