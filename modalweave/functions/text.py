"""Text expressions: blank tests, keyword tests, chunking and prompt variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vectors import col_of

# Prompt templates and keywords as published.
PROMPTS = {
    "direct": "%s",
    "video_context": "a video of %s",
    "audio_context": "the sound of %s",
    "hearing": "hearing %s",
    "audio_of": "audio of %s",
}
SYNONYMS = {
    "person talking": ["person speaking", "human voice", "talking", "conversation", "speech"],
    "music playing": ["musical instrument", "song", "melody", "rhythm", "music"],
    "car engine": ["vehicle sound", "car noise", "engine", "automobile", "transport"],
    "dog barking": ["dog sound", "animal noise", "barking", "canine", "pet sound"],
}
AUDIO_KEYWORDS = [
    "sound", "audio", "music", "talking", "speaking", "noise", "barking", "engine",
    "footsteps", "laughter", "siren", "explosion", "whisper", "shouting", "singing", "playing",
]
# The published list
STOP_WORDS = [
    "a", "an", "the", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does",
    "did", "will", "would", "could", "should", "may", "might", "can", "shall", "to", "of", "in", "for", "on",
    "with", "at", "by", "from", "as", "and", "or", "but", "not", "no", "it", "its", "this", "that", "these",
    "those", "i", "you", "he", "she", "they", "we", "my", "your", "his", "her", "their", "our", "me", "him",
    "them", "us", "who", "what", "which", "how",
]


def is_blank(text) -> Column:
    t = col_of(text)
    return t.isNull() | ~t.rlike(r"\S")


def non_blank(df: DataFrame, text: str) -> DataFrame:
    return df.filter(~is_blank(text))


def words(text) -> Column:
    """Whitespace-separated words, none of them empty."""
    return F.filter(F.split(col_of(text), r"\s+"), lambda w: w != "")


def contains_any(text, keywords) -> Column:
    """Case-insensitive: does any keyword occur anywhere in the text?"""
    low = F.lower(col_of(text))
    return F.exists(F.lit(list(keywords)), lambda k: F.contains(low, k))


def chunk_text(text, budget: int = 72) -> Column:
    """Greedy packing of words into chunks of at most ``budget`` estimated tokens.

    A word costs len // 4 + 1 and one more for its separator; the word that
    opens a later chunk does not pay the separator. One walk over the words
    notes where chunks begin, then each chunk is cut once, so the time follows
    the length of the text. Null stays null, a text without words has none.
    """

    def begins(acc, w):
        cost = F.floor(F.length(w) / 4).cast("int") + 1
        at = acc["at"] + 1
        over = (acc["cost"] + cost + 1 > budget) & (acc["at"] > 0)
        return F.struct(
            F.when(over, F.concat(acc["starts"], F.lit(","), at.cast("string"))).otherwise(acc["starts"]).alias("starts"),
            at.alias("at"),
            F.when(over, cost).otherwise(acc["cost"] + cost + 1).alias("cost"),
        )

    def cut(held):
        # beginnings are kept as text: an array in the state would be copied at every word
        none = F.struct(F.lit("1").alias("starts"), F.lit(0).alias("at"), F.lit(0).alias("cost"))
        starts = F.aggregate(held, none, begins, lambda acc: F.split(acc["starts"], ",").cast("array<int>"))

        def chunks(first):
            # a line break before a word that opens a chunk, a space before the others; words hold neither
            size = lambda s, i: F.coalesce(F.try_element_at(first, i + 2), F.size(held) + 1) - s
            line = lambda s, i: F.concat(F.array(F.lit("\n")), F.array_repeat(F.lit(" "), size(s, i) - 1))
            joined = F.array_join(F.zip_with(F.flatten(F.transform(first, line)), held, lambda x, w: F.concat(x, w)), "")
            return F.when(F.size(held) > 0, F.split(F.substr(joined, F.lit(2)), "\n")).otherwise(F.array().cast("array<string>"))

        # words and starts pass through a lambda variable, so that each is worked out once
        return F.transform(F.array(starts), chunks)[0]

    return F.transform(F.array(words(text)), cut)[0]


def prompt_variants(df: DataFrame, text: str, prompts=PROMPTS) -> DataFrame:
    """One row per (row, variant) with the text set into each template."""
    variants = F.array(
        *[
            F.struct(F.lit(name).alias("variant"), F.format_string(tpl, F.col(text)).alias("prompt"))
            for name, tpl in prompts.items()
        ]
    )
    return df.select("*", F.explode(variants).alias("_v")).select(
        *df.columns, "_v.variant", "_v.prompt"
    )


def synonym_variants(df: DataFrame, text: str, groups=SYNONYMS) -> DataFrame:
    """One row per synonym of every group phrase found in the text (else the text)."""
    found = F.flatten(
        F.array(
            *[
                F.when(F.contains(F.lower(F.col(text)), F.lit(phrase)), F.lit(list(names)))
                .otherwise(F.array().cast("array<string>"))
                for phrase, names in groups.items()
            ]
        )
    )
    chosen = F.when(F.size(found) > 0, found).otherwise(F.array(F.col(text)))
    return df.select("*", F.explode(chosen).alias("prompt"))


def augmented_targets(df: DataFrame, id_col: str = "video_id") -> DataFrame:
    """(id, pos, text): every text that may describe an item, in a fixed order."""
    one = lambda c: F.array(F.col(c))
    texts = F.concat(
        one("text_description"),
        F.coalesce("qa_questions", F.array().cast("array<string>")),
        F.coalesce("qa_answers", F.array().cast("array<string>")),
        one("youtube_title"),
        F.transform(
            F.coalesce("youtube_tags", F.array().cast("array<string>")),
            lambda t: F.concat(F.lit("a video tagged "), t),
        ),
        F.transform(
            F.filter(
                F.array("content_fine_category", "content_parent_category"),
                lambda c: c.isNotNull() & (c != ""),
            ),
            lambda c: F.concat(F.lit("a video about "), c),
        ),
    )
    kept = F.filter(texts, lambda t: t.isNotNull() & t.rlike(r"\S"))
    return df.select(id_col, F.posexplode(kept).alias("pos", "text"))
