"""Normalised text to phonemes: tokens, lexicon, language of shared words, segmentation of unknown words.

The plan: tokens are made in the row by Column expressions; one pass in Arrow batches looks words up in the lexicon,
which every worker holds, segments unknown ones (each once a worker), decides the language of words that both languages
have and puts the text together. Nothing is shuffled, and each input row gives one row, so it runs on streams too.

Workers hold a lexicon if it is counted to be small (``HELD_WORDS`` words, ``HELD_BYTES`` bytes). Of a larger one they hold
what the texts can meet, their distinct words and pieces of unknown ones, so that no token is exchanged either; the texts
are tokenised once more for that. Only if that is too much as well are distinct texts exploded to tokens and joined. All
three ways choose the languages of shared words by one function, and give the same.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loquat.functions.bind import let, lookup
from loquat.functions.resources import VIETNAMESE
from loquat.sources.lexicon import overlay

#: The inner class lets ASCII letters be seen at once.
WORD = r"[[a-zA-Z0-9_]\w]++(?:['’]\w++)*+"
TOKEN = rf"(?iUd)<en>(?:[^<\n]++|<(?!/en>))*+</en>|{WORD}|[^\w\s]"
INNER = rf"(?Ud)(?! )(?:{WORD}|[^\w\s])"
STOPS = ".!?;:()[]{}"
_UNACCENTED = "aeiou"
_VOWELS = _UNACCENTED + VIETNAMESE.replace("đ", "")
#: A lexicon of at most this many words and bytes is held by every worker.
HELD_WORDS, HELD_BYTES = 500_000, 64 << 20


def tokens(text: Column) -> Column:
    """array<struct<word, tagged>>: words and single marks; those of an English span are tagged."""
    one = lambda token: F.array(F.struct(token.alias("word"), F.lit(False).alias("tagged")))
    inner = lambda tag: F.transform(F.regexp_extract_all(F.regexp_replace(tag, "(?i)</?en>", ""), F.lit(INNER), F.lit(0)), lambda t: F.struct(t.alias("word"), F.lit(True).alias("tagged")))
    found = F.when(text.contains("</") & text.rlike("(?i)</en>"), F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))).otherwise(F.regexp_extract_all(text, F.lit(INNER), F.lit(0)))
    return F.flatten(F.transform(found, lambda t: F.when(t.rlike("(?is)^<en>.*</en>$"), inner(t)).otherwise(one(t))))


def _in_language(lang: Column, vi: Column, en: Column) -> Column:
    """The pronunciation of a word of both languages; an empty one gives way to the other."""
    return F.when((lang == "en") & (en != ""), en).when(vi != "", vi).otherwise(en)


def _has_vowel_and_consonant(word: Column) -> Column:
    return word.rlike(f"[{_VOWELS}]") & word.rlike(rf"[\p{{L}}&&[^{_VOWELS}]]")


def _pieces(word: str, longest: int) -> Column:
    """array<struct<i, j, piece>>: what stands between two places of a word, at most ``longest`` characters."""
    size = F.length(word)
    return F.flatten(F.transform(F.sequence(F.lit(1), size), lambda i: F.transform(F.sequence(i, F.least(i + F.lit(longest - 1), size)), lambda j: F.struct((i - 1).alias("i"), j.alias("j"), F.substring(word, i, j - i + 1).alias("piece")))))


def segment(unknown: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(word, lang, phone) of distinct unknown words: lexicon words that cover it, else character by character.

    Of the ways to reach a place in the word the one that comes from the smallest place counts. Pieces are no
    longer than the longest word of the lexicon, which bounds them by the word's length.
    """
    longest = lexicon.agg(F.max(F.length("word"))).first()[0] or 0
    letters = {r.word: r for r in lexicon.filter(F.length("word") == 1).collect()}  # single characters
    size = F.length("word")
    words = unknown.select("word", "lang")
    parts = words.select("word", "lang", F.explode(_pieces("word", longest)).alias("p")).select("word", "lang", "p.*") if longest else None
    if parts is not None:
        parts = parts.filter(_has_vowel_and_consonant(F.col("piece")))
        known = lexicon.withColumnRenamed("word", "piece")
        parts = parts.join(known, "piece").withColumn("said", F.trim(F.when(F.col("kind") == "merged", F.col("phone")).otherwise(_in_language(F.col("lang"), F.col("vi_phone"), F.col("en_phone")))))
        listed = parts.groupBy("word", "lang").agg(F.array_sort(F.collect_list(F.struct("i", "j", "said"))).alias("pieces"))
        begin = F.create_map(F.lit(0), F.lit(""))

        def step(reached: Column, p: Column) -> Column:
            said = lambda before: F.when(before == "", p["said"]).otherwise(F.concat(before, F.lit(" "), p["said"]))
            new = F.map_contains_key(reached, p["i"]) & ~F.map_contains_key(reached, p["j"])
            return F.when(new, F.map_concat(reached, F.create_map(p["j"], let(F.element_at(reached, p["i"]), said)))).otherwise(reached)

        covered = listed.select("word", "lang", F.element_at(F.aggregate("pieces", begin, step), size).alias("covered"))
        words = words.join(covered, ["word", "lang"], "left")
    else:
        words = words.withColumn("covered", F.lit(None).cast("string"))
    spoken = {lang: {k: (r.phone if r.kind == "merged" else r.en_phone if (lang == "en" and r.en_phone) or not r.vi_phone else r.vi_phone).strip() for k, r in letters.items()} for lang in ("vi", "en")}

    def spell(lang: str) -> Column:
        return F.array_join(F.transform(F.split("word", ""), lambda c: F.coalesce(lookup(spoken[lang], c), c) if spoken[lang] else c), "")

    return words.select("word", "lang", F.coalesce("covered", F.when(F.col("lang") == "en", spell("en")).otherwise(spell("vi"))).alias("phone"))


def _joined(df: DataFrame, lexicon: DataFrame, text_col: str, id_col: str, out_col: str) -> DataFrame:
    """Phonemes by joins with the lexicon, for each distinct text once."""
    key = ["_a", "_b"]
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = df.select(F.col(id_col).alias("_id"), text.alias("_text")).withColumns({"_a": F.xxhash64("_text"), "_b": F.xxhash64("_text", F.lit(1))})
    texts = keyed.dropDuplicates(key).select(*key, F.posexplode_outer(tokens(F.col("_text"))).alias("pos", "token"))
    rows = texts.select(*key, "pos", "token.word", "token.tagged").withColumn("low", F.lower("word"))
    rows = rows.join(lexicon.withColumnRenamed("word", "low"), "low", "left")
    merged, common = F.col("kind") == "merged", F.col("kind") == "common"
    punct = ~F.col("word").rlike(r"(?U)\w")
    accent = F.col("low").rlike(f"[{VIETNAMESE}]")
    lang = (
        F.when(punct, "punct").when(F.col("tagged"), "en").when(merged, F.when(F.col("is_en"), "en").otherwise("vi")).when(common, "common").when(accent, "vi").otherwise("en")
    )
    phone = F.when(punct, F.col("word")).when(merged, F.coalesce(F.trim("phone"), F.lit(""))).when(common & F.col("tagged") & (F.col("en_phone") != ""), F.trim("en_phone"))
    rows = rows.select(*key, "pos", "word", "low", lang.alias("lang"), phone.alias("phone"), "vi_phone", "en_phone")
    unknown = (F.col("phone").isNull()) & F.col("lang").isin("vi", "en")
    spelled = segment(rows.filter(unknown).select(F.col("low").alias("word"), "lang").distinct(), lexicon)
    spelled = spelled.select(F.col("word").alias("low"), "lang", F.col("phone").alias("spelled"))
    rows = rows.join(spelled, ["low", "lang"], "left")
    token = F.struct("pos", "lang", ((F.col("lang") == "punct") & F.col("word").isin(*STOPS)).alias("stop"), F.trim(F.coalesce("phone", "spelled")).alias("phone"), F.trim("vi_phone").alias("vi"), F.trim("en_phone").alias("en"))
    texts = rows.groupBy(*key).agg(F.array_sort(F.collect_list(F.when(F.col("word").isNotNull(), token))).alias("found"))
    joined = texts.select(F.struct(*key).alias("key"), "found").mapInArrow(_told, "key struct<_a: bigint, _b: bigint>, _said string")
    return keyed.join(joined.select("key.*", "_said"), key).select(F.col("_id").alias(id_col), F.col("_said").alias(out_col))


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _cuts(batches):
        said = [put_together([(t["lang"], t["phone"], t["vi"] or "", t["en"] or "") for t in text], [t["stop"] for t in text]) for text in rows.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(said, pa.string())], names=["key", "_said"])


def _met(df: DataFrame, lexicon: DataFrame, text_col: str) -> DataFrame:
    """The part of a lexicon that texts can meet: their words, and what words without one pronunciation may be made of."""
    words = df.select(F.explode(tokens(F.col(text_col))).alias("t")).select(F.lower("t.word").alias("word")).distinct()
    longest = lexicon.agg(F.max(F.length("word"))).first()[0] or 1
    split = words.join(lexicon.filter("kind = 'merged'").select("word"), "word", "left_anti").select(F.explode(_pieces("word", longest)).alias("p"))
    pieces = split.select(F.col("p.piece").alias("word")).filter((F.length("word") == 1) | _has_vowel_and_consonant(F.col("word"))).distinct()
    return lexicon.join(words.unionAll(pieces).distinct(), "word", "left_semi")


# ---- the lexicon in the workers -------------------------------------------


def _is_word(c: str) -> bool:
    """Whether a token that begins with this character is a word."""
    return unicodedata.category(c)[0] in "LM" or unicodedata.category(c) in ("Nd", "Nl", "Pc") or c in "\u200c\u200d" or "\u24b6" <= c <= "\u24e9"


class Speaker:
    """Words to phonemes by a lexicon of rows (word, kind, phone, vi_phone, en_phone, is_en); what a word sounds like is kept."""

    def __init__(self, rows: list):
        self.known = {r["word"]: r for r in rows}
        self.longest = max(map(len, self.known), default=0)
        self.kept: dict[str, tuple[str, str | None, str, str]] = {}

    def piece(self, word: str, lang: str) -> str:
        r = self.known[word]
        if r["kind"] == "merged":
            return (r["phone"] or "").strip(" ")
        vi, en = r["vi_phone"] or "", r["en_phone"] or ""
        return (en if lang == "en" and en or not vi else vi).strip(" ")

    def segmented(self, word: str, lang: str) -> str:
        """Lexicon words that cover an unknown one, each place being reached from the smallest place; else letter by letter."""
        reached = {0: ""}
        for i in range(len(word)):
            if i in reached:
                for j in range(i + 1, min(i + self.longest, len(word)) + 1):
                    part = word[i:j]
                    if j not in reached and part in self.known and any(c in _VOWELS for c in part) and any(c.isalpha() and c not in _VOWELS for c in part):
                        said = self.piece(part, lang)
                        reached[j] = f"{reached[i]} {said}" if reached[i] else said
        if len(word) in reached:
            return reached[len(word)]
        return "".join(self.piece(c, lang) if c in self.known else c for c in word)

    def look(self, token: str) -> tuple[str, str | None, str, str]:
        """(language, phonemes or None while that is open, Vietnamese and English phonemes) of a token, with ``TAG`` before it if it is tagged."""
        tagged, word = token[0] == TAG and len(token) > 1, token.removeprefix(TAG) if len(token) > 1 else token
        low = word.lower()
        if not _is_word(word[0]):
            return "punct", word.strip(" "), "", ""
        r = self.known.get(low)
        vi, en = ("", "") if r is None else (r["vi_phone"] or "", r["en_phone"] or "")
        if r is not None and r["kind"] == "merged":
            return "en" if tagged or r["is_en"] else "vi", (r["phone"] or "").strip(" "), vi, en
        if r is not None and not tagged:
            return "common", None, vi.strip(" "), en.strip(" ")
        if r is not None and en:
            return "en", en.strip(" "), vi, en
        lang = "en" if tagged or not any(c in VIETNAMESE for c in low) else "vi"
        return lang, self.segmented(low, lang).strip(" "), vi, en

    def say(self, words: list[str]) -> str:
        found = []
        for w in words:
            if w not in self.kept:
                if len(self.kept) >= KEPT_WORDS:
                    self.kept.clear()
                self.kept[w] = self.look(w)
            found.append(self.kept[w])
        return put_together(found, [f[0] == "punct" and w in STOPS for f, w in zip(found, words, strict=True)])


def put_together(found: list[tuple[str, str | None, str, str]], stops: list[bool]) -> str:
    """A text of tokens (language, phonemes or None while that is open, Vietnamese and English phonemes)."""
    langs = [f[0] for f in found]
    if "common" in langs:
        langs = shared_languages(langs, stops)
    said = [(en if lang == "en" else vi) if phone is None else phone for lang, (_, phone, vi, en) in zip(langs, found, strict=True)]
    return _BEFORE_MARK.sub(r"\1", " ".join(said))


def shared_languages(langs: list[str], stops: list[bool]) -> list[str]:
    """``langs`` with those of shared words ("common") decided.

    Between two marks that stop, a run of shared words takes the language of the nearer of the words of one language
    on either side, the right one of equals, or the only one, else Vietnamese. An earlier run, behind a comma, counts
    for the next as a word of its language; so a run after the first of its gap either takes the language on the
    right, or what the run before it has.
    """
    out, n = list(langs), len(langs)
    right: list[int | None] = [None] * n
    near = None
    for i in reversed(range(n)):
        right[i] = near
        if langs[i] in ("vi", "en"):
            near = i
        if stops[i]:
            near = None
    left = before = None
    choice, i = "vi", 0
    while i < n:
        if stops[i]:
            left = before = None
        if langs[i] in ("vi", "en"):
            left = i
        if langs[i] != "common":
            i += 1
            continue
        end = i
        while end + 1 < n and langs[end + 1] == "common":
            end += 1
        later = before is not None and (left is None or before > left)
        back = before if later else left
        ahead = right[end]
        if ahead is not None and (back is None or ahead - end <= i - back):
            choice = langs[ahead]
        elif not later:
            choice = "vi" if left is None else langs[left]
        out[i : end + 1] = [choice] * (end + 1 - i)
        before, i = end, end + 1
    return out


_BEFORE_MARK = re.compile(" ([.,!?;:])")
TAG = "\x01"
#: Words of which a worker keeps the phonemes.
KEPT_WORDS = 1_000_000


#: Tokens that a worker takes out of a batch at a time; a longer text is still taken whole.
TOKENS_AT_ONCE = 100_000


def _cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of batches, whose second column has lists, a bounded number of list entries at a time."""
    for rows in batches:
        ends, begin = rows.column(1).offsets.to_numpy(), 0
        while begin < rows.num_rows:
            end = max(begin + 1, int(np.searchsorted(ends, ends[begin] + TOKENS_AT_ONCE, "right")) - 1)
            yield rows.slice(begin, end - begin)
            begin = end


def _spoken(batches: Iterator[pa.RecordBatch], lexicon, names: list[str]) -> Iterator[pa.RecordBatch]:
    speaker = Speaker(lexicon.value)
    for rows in _cuts(batches):
        said = [speaker.say(words) for words in rows.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(said, pa.string())], names=names)


_COLUMNS = ["word", "kind", "phone", "vi_phone", "en_phone", "is_en"]


def held(lexicon: DataFrame) -> bool:
    """Whether workers can hold the lexicon."""
    size = F.sum(sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in _COLUMNS[:5]), F.lit(24))).alias("bytes")
    few = lexicon.agg(F.count("*").alias("words"), F.coalesce(size, F.lit(0)).alias("bytes")).first()
    return few.words <= HELD_WORDS and few.bytes <= HELD_BYTES


def phonemize(df: DataFrame, lexicon: DataFrame, text_col: str = "text", id_col: str = "id", out_col: str = "phonemes") -> DataFrame:
    """(id, phonemes) of each row; null and empty texts give ''. Streams need a lexicon that workers can hold."""
    lexicon = met = overlay(lexicon)
    if not held(lexicon):
        if df.isStreaming:
            raise ValueError("a stream needs a lexicon that workers can hold; see phoneme_stream")
        met = _met(df, lexicon, text_col).persist()
        if not held(met):
            met.unpersist()
            return _joined(df, lexicon, text_col, id_col, out_col)
    known = df.sparkSession.sparkContext.broadcast([r.asDict() for r in met.select(_COLUMNS).collect()])
    if met is not lexicon:
        met.unpersist()
    marked = F.transform(tokens(F.coalesce(F.col(text_col), F.lit(""))), lambda t: F.when(t["tagged"], F.concat(F.lit(TAG), t["word"])).otherwise(t["word"]))
    rows = df.select(F.col(id_col).alias(id_col), marked.alias("_words"))
    schema = T.StructType([rows.schema[id_col], T.StructField(out_col, T.StringType())])
    return rows.mapInArrow(lambda it: _spoken(it, known, [id_col, out_col]), schema)
