"""Word lists of the name heuristic. They are a parameter of everything that reads them; these are the defaults.

Words that are never a name aren't listed: they come by rule from what the detectors know anyway (labels, street types, months,
entity types, closing words of organisations) and, for a corpus at hand, from the corpus itself (`learned`).
"""

from __future__ import annotations

import calendar
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.patterns import LABELS, STREET_TYPES
from spanloom.functions.places import COUNTRIES, PLACE_WORDS
from spanloom.schemas import ENTITY_TYPES

# Honorifics, closing words of organisations, particles between name words, capitalised function words.
TITLES = "mr mrs ms miss dr prof herr frau sir madam mx st".split()
ORG_WORDS = (
    "inc llc ltd gmbh ag plc corp co company hospital clinic klinik university universität bank group holdings foundation court gericht sons partners associates"
).split()
PARTICLES = "van von de da del della der den di du la le ten ter zu dos das bin ibn al af".split()
STOPWORDS = "The A An This That These Those His Her Their It He She They We You I On In At For And But Or If When According Patient".split()
# Words that open a sentence and are no name there, besides the function words.
OPENERS = """
later however meanwhile therefore thus moreover furthermore nevertheless nonetheless subsequently additionally finally firstly secondly
thirdly then now today yesterday tomorrow here there while after before during since although because unfortunately fortunately
consequently hence indeed instead overall similarly specifically generally typically currently recently previously initially eventually
ultimately perhaps maybe certainly clearly obviously actually basically essentially regardless accordingly alternatively besides conversely
likewise namely notably otherwise presently undoubtedly whereas yet so also please thanks thank dear hello hi yes no ok okay well just only
even still again once whenever wherever whether unless until following regarding concerning per via note under within having pursuant
applying acting both further given considering notwithstanding upon thereafter whilst throughout hereinafter your our could can kindly use
let need good check may might would should will shall must do does did get got make take give send provide enter click call contact reach
confirm verify update review submit complete ensure what which who whom whose where why how want all any looking remember join access
greetings welcome hey connect received best reminder payment team education warm cheers attached let's we've you'll we'll here's there's
it's that's
""".split()

CONTINENTS = "Africa America Asia Europe".split()
#: Openers and months that people are called, too: they stay in a run of name words.
ALSO_NAMES = "may will best good well warm still june april august summer".split()

#: A word is common in a corpus if it stands so often within sentences, and in such a share of that in lower case; so many words at most.
LEAST_SEEN, LOWER_SHARE, MOST_WORDS = 5, 0.5, 50_000


def by_rule() -> frozenset[str]:
    """Words that are no names because they open sentences, or are labels, kinds of streets, dates, types, parts of organisations or
    adjectives of places."""
    words = {w.lower() for w in (*STOPWORDS, *OPENERS, *LABELS.split("|"), *STREET_TYPES.split("|"), *calendar.month_name, *calendar.day_name)}
    words |= {part for t in ENTITY_TYPES for part in t.lower().split("_") if t != "PERSON"}
    words |= {w for w in ORG_WORDS if len(w) > 3 and w not in ("gmbh", "corp")}
    words |= {place.lower() + end for place in (*CONTINENTS, *COUNTRIES) for end in ("n", "an", "ian", "ese", "ish", "i")}
    return frozenset(words - {"", *ALSO_NAMES})


@dataclass(frozen=True)
class Lexicon:
    titles: frozenset[str] = frozenset(TITLES)
    org_words: frozenset[str] = frozenset(ORG_WORDS)
    particles: frozenset[str] = frozenset(PARTICLES)
    stopwords: frozenset[str] = frozenset(STOPWORDS)
    openers: frozenset[str] = frozenset(OPENERS) | {w.lower() for w in STOPWORDS}
    non_names: frozenset[str] = by_rule()

    @cached_property
    def kinds(self) -> dict[str, tuple]:
        """What a worker remembers of words that it has met (`kernel.words_of`)."""
        return {}

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "kinds"}

    @cached_property
    def never_alone(self) -> frozenset[str]:
        """Words that never stand for a person alone."""
        return self.non_names | self.titles | self.particles | PLACE_WORDS


DEFAULT = Lexicon()


def common_words(docs: DataFrame, least: int = LEAST_SEEN, share: float = LOWER_SHARE, text: str = "text") -> DataFrame:
    """(word, n, lower): words of a corpus that mostly stand in lower case, among all their places within sentences.

    A word within a sentence follows another word or a comma, so that a capital is the writer's choice. Counts are partial
    sums, and what is shuffled is one row for each word and task.
    """
    words = F.regexp_extract_all(F.col(text), F.lit(r"(?U)(?<=[\p{L}\p{N}],? )\p{L}{2,}"), F.lit(0))
    each = docs.select(F.explode(words).alias("w"))
    counted = each.groupBy(F.lower("w").alias("word")).agg(F.count("*").alias("n"), F.count_if(F.col("w") == F.lower("w")).alias("lower"))
    return counted.where((F.col("n") >= least) & (F.col("lower") >= share * F.col("n")))


def learned(docs: DataFrame, base: Lexicon = DEFAULT, most: int = MOST_WORDS, **options) -> Lexicon:
    """`base` with the most frequent common words of a corpus as words that are never names; `most` bounds what goes to every task."""
    rows = common_words(docs, **options).orderBy(F.desc("n"), "word").limit(most).collect()
    return replace(base, non_names=base.non_names | {r["word"] for r in rows} - base.titles - base.particles)
