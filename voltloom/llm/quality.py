"""Per-document text quality statistics, and the documents that are not running prose.

The statistics of a text are taken in one pass over its words and lines. For each language
a mergeable quantile sketch (KLL) of every statistic is built, and a document's value
becomes a robust z-score, its distance from the language's median in units of the
interquartile range, and a percentile. How deep a document lies in the tails away from
prose (few common words, many digits, few words on running lines) is the weighted sum of
its scores there; beyond ``DEPTH`` it is flagged. No bound on a statistic itself takes part.

A share of few words says little, so the score of common words is that of the share's
arcsine, whose chance deviation is known from the number of words alone.

The sketches are built twice: first of all documents, with the median and range of common
words read from the prose side of the distribution (its upper quantiles), then of the
documents that are not far out by those. A document's flag so does not depend on how
much junk the corpus holds.

Scale: one pass over the texts; the statistics are written to the shared folder and
read by two small passes that build sketches (some kilobytes a language, merged on the map
side). The sketches of a few languages are broadcast to the last pass.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltloom.session import cut

# Common words of running prose per language (pronouns, verbs, conjunctions, prepositions; no articles).
COMMON_WORDS = {
    "en": "i you we he she it they me us is was are be have has had do does did can could would will should not and but or if that this what which who when how because so than there to with from about before after while although until away all".split(),
    "fr": "je tu nous vous il elle on ils que qui quoi est sont était été avez ont avons faut faire ne pas et mais ou si ce cela parce pour dans avec sur avant après comme quand comment alors merci cette votre".split(),
    "de": "ich du wir ihr er es sie man uns euch ist sind war waren hat haben hatte wird kann sollte nicht kein und aber oder wenn dass das was wer wie so auf mit zu vor nach noch nur immer niemand bei".split(),
    "es": "yo tú él ella se lo nos que quien es son era fue han hay está estaba no y pero si porque para con por en como cuando antes después siempre nadie alguien muy gracias nuestra esto eso".split(),
    "ar": "في من على إلى عن أن لا لم لن ما هل هو هي هذا هذه كان كانت قد لأن لكن أو إذا كيف بعد قبل كل مع منذ أكثر لكم".split(),
}

MEASURES = ("words", "mean_word_length", "symbol_share", "end_punct_share", "common_share", "distinct_common", "digit_share", "running_share")

#: Statistics that make a document's depth: side of the tail, weight, most that is counted of the z-score.
TAILS = {"common_share": (-1, 1.0, 1e9), "digit_share": (1, 0.1, 20.0), "running_share": (-1, 0.05, 40.0)}
#: Depth beyond which a document is not prose; scores beyond which it takes no part in the second sketches.
DEPTH, FAR = 2.8, 2.5
#: Least deviation of each score, in units of the statistic (common_share: of its arcsine).
LEAST = {"common_share": 0.03, "running_share": 0.02, "digit_share": 0.01, "symbol_share": 0.01, "distinct_common": 0.5, "end_punct_share": 0.02, "mean_word_length": 0.05, "words": 1.0}
#: Documents a language must have for sketches of its own; below, all languages together stand in.
ENOUGH = 30

_OUT = "language string, words int, mean_word_length double, symbol_share double, end_punct_share double, common_share double, distinct_common int, digit_share double, running_share double"

_ADDRESS = re.compile(r"\b(?:https?://|www\.)\S+", re.I)
_MARKUP = re.compile(r"</?[a-z][^<>]*>|\[/?[a-z]+(?:=[^\[\]]*)?\]|\{\{[^{}]*\}\}|&#?\w+;", re.I)
_QUOTE = re.compile(r"^[>\s|]+(?=\S)", re.M)
_NO_WIDTH = dict.fromkeys(map(ord, "\u200b\u200c\u200d\ufeff"))
_ASCII_WORD = re.compile("[a-z]+")
_STOPS, _CLOSERS = frozenset(".!?…؟。;:"), "\"'»”)]"


def clean(text: str) -> str:
    """The text without addresses, markup, zero-width characters and quote marks."""
    if "://" in text or "www." in text or "WWW." in text:
        text = _ADDRESS.sub(" ", text)
    if "<" in text or "[" in text or "{{" in text or "&" in text:
        text = _MARKUP.sub(" ", text)
    if not text.isascii():
        text = text.translate(_NO_WIDTH)
    if ">" in text or "|" in text:
        text = _QUOTE.sub("", text)
    return text


def measure(text: str, languages: Mapping[str, frozenset], index: Mapping[str, Sequence[str]]) -> tuple:
    """The statistics of one text, in the order of the result's columns."""
    import regex

    t = clean(text)
    plain = t.isascii()
    find = _ASCII_WORD.findall if plain else regex.compile(r"[\p{L}\p{M}]+").findall
    words: list[str] = []
    lines = ends = running = 0
    for line in t.split("\n"):
        s = line.strip()
        if not s:
            continue
        lines += 1
        ends += s.rstrip(_CLOSERS)[-1:] in _STOPS
        w = find(s.lower())
        running += len(w) if len(w) >= 6 else 0
        words += w
    n = len(words)
    letters = sum(map(len, words))
    solid = sum(map(len, t.split()))
    if plain:
        digits = numbers = sum(map(t.count, "0123456789"))
    else:
        numbers = sum(map(len, regex.findall(r"\p{N}+", t)))
        digits = sum(map(len, regex.findall(r"\p{Nd}+", t)))
    common = Counter(w for w in words if w in index)
    hits = dict.fromkeys(languages, 0)
    for w, k in common.items():
        for lang in index[w]:
            hits[lang] += k
    best = max(hits, key=hits.get) if common else "und"
    share = lambda x, y: x / y if y else 0.0
    return best, n, share(letters, n), share(max(solid - letters - numbers, 0), solid), share(ends, lines), share(common.total(), n), len(common), share(digits, solid), share(running, n)


def text_statistics(df: DataFrame, doc: str, text: str, *, label: Column | None = None, common_words: Mapping[str, Sequence[str]] = COMMON_WORDS) -> DataFrame:
    """doc, language, listed, words, mean_word_length, symbol_share, end_punct_share, common_share, distinct_common, digit_share, running_share.

    common_share: share of words among the common words of any language of ``common_words``.
    running_share: share of words on lines of at least six words. language: the one whose
    common words are most frequent, 'und' without any. label: the language a text is said
    to have; a label outside ``common_words`` is taken over, and ``listed`` is false there.
    Defined cases: a null or empty text has zero words and shares of zero (symbol and
    digit share included); markup, addresses and quote marks are not counted; any length
    of text is taken whole; other columns are ignored.
    """
    languages = {lang: frozenset(words) for lang, words in common_words.items()}
    index: dict[str, list[str]] = {}
    for lang, words in languages.items():
        for w in words:
            index.setdefault(w, []).append(lang)
    names = [c.split()[0] for c in _OUT.split(", ")]

    @F.pandas_udf(_OUT)
    def stats(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([measure(t if isinstance(t, str) else "", languages, index) for t in texts], columns=names)

    said = F.lower(F.trim(label)) if label is not None else F.lit(None).cast("string")
    x = df.select(F.col(doc).alias("_doc"), said.alias("_said"), stats(F.col(text)).alias("_s"))
    other = F.col("_said").isNotNull() & (F.col("_said") != "") & ~F.col("_said").isin(*languages)
    return x.select(F.col("_doc").alias(doc), F.when(other, F.col("_said")).otherwise(F.col("_s.language")).alias("language"), F.coalesce(~other, F.lit(True)).alias("listed"), *[f"_s.{m}" for m in MEASURES])


def _scored(m: str) -> Column:
    """The statistic as it is sketched: the arcsine of the share of common words, all others as they are."""
    return F.asin(F.sqrt(m)) if m == "common_share" else F.col(m).cast("double")


def sketches(stats: DataFrame, *parts: Column) -> DataFrame:
    """One row per language (and part): a KLL sketch of every statistic. Those of several parts merge with merge_sketches."""
    return stats.groupBy(*parts, "language").agg(F.count(F.lit(1)).alias("documents"), *[F.kll_sketch_agg_double(_scored(m)).alias(f"k_{m}") for m in MEASURES])


def merge_sketches(parts: DataFrame, *by: str) -> DataFrame:
    return parts.groupBy(*by).agg(F.sum("documents").alias("documents"), *[F.kll_merge_agg_double(f"k_{m}").alias(f"k_{m}") for m in MEASURES])


def scales(table: DataFrame, *, prose_side: bool = False) -> DataFrame:
    """language, and of every statistic s_<m> (mid, spread) and q_<m> (its percentiles): from sketches, with a row 'und' for all languages together.

    prose_side: middle and spread of common words from the upper quantiles only.
    """
    known = table.where("language <> 'und'")
    pooled = merge_sketches(known.withColumn("all", F.lit("und")), "all").withColumnRenamed("all", "language")
    rows = known.where(F.col("documents") >= ENOUGH).unionByName(pooled)
    q = lambda k, p: F.kll_sketch_get_quantile_double(k, F.lit(p))

    def middle(m: str) -> Column:
        k = F.col(f"k_{m}")
        if prose_side and m == "common_share":  # quantiles of a normal distribution at 0.7 and 0.9
            spread = (q(k, 0.9) - q(k, 0.7)) / (1.2816 - 0.5244)
            return F.struct((q(k, 0.7) - 0.5244 * spread).alias("mid"), spread.alias("spread"))
        return F.struct(q(k, 0.5).alias("mid"), ((q(k, 0.75) - q(k, 0.25)) / 1.349).alias("spread"))

    percents = F.array(*[F.lit(i / 100) for i in range(1, 100)])
    return rows.select("language", *[middle(m).alias(f"s_{m}") for m in MEASURES], *[F.kll_sketch_get_quantile_double(F.col(f"k_{m}"), percents).alias(f"q_{m}") for m in MEASURES])


def _with_scores(stats: DataFrame, scale: DataFrame, measures: Sequence[str], percentiles: bool = False) -> DataFrame:
    """stats with z_<m> (and p_<m>) by the scale of the document's language, or of all languages where it has none."""
    cols = [*[f"s_{m}" for m in measures], *([f"q_{m}" for m in measures] if percentiles else [])]
    own = scale.select(F.col("language").alias("_lang"), *[F.col(c).alias(f"o{c}") for c in cols])
    pooled = scale.where("language = 'und'").select(*[F.col(c).alias(f"a{c}") for c in cols])
    x = stats.join(F.broadcast(own), F.col("language") == F.col("_lang"), "left").join(F.broadcast(pooled), F.lit(True), "left")  # a row a language; one row
    for m in measures:
        s = F.coalesce(f"os_{m}", f"as_{m}")
        spread = F.greatest(s["spread"], F.lit(LEAST[m]))
        if m == "common_share":  # and the chance deviation of a share of so many words
            spread = F.sqrt(spread * spread + 0.25 / F.greatest("words", F.lit(1)))
        x = x.withColumn(f"z_{m}", F.coalesce((_scored(m) - s["mid"]) / spread, F.lit(0.0)))
        if percentiles:
            points, v = F.coalesce(f"oq_{m}", f"aq_{m}"), _scored(m)
            x = x.withColumn(f"p_{m}", F.size(F.filter(points, lambda p, v=v: p <= v)))
    return x.drop("_lang", *[f"{k}{c}" for k in "oa" for c in cols])


def grade(stats: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """The statistics with z_* (robust z-scores), p_* (percentiles 0..99), ``depth`` and ``prose``.

    table: sketches per language, of documents that count as prose (None: those of ``stats``
    not far out, see above). Documents of a language with fewer than ``ENOUGH`` documents,
    or of none, are measured against all languages together; of a language that is not
    ``listed`` the share of common words says nothing, and the other scores count double.
    Defined cases: a document without words is not prose; equal statistics give a z of zero;
    in a corpus without any common word there is no scale, and all documents are not prose.
    """
    if table is None:
        stats = cut(stats)  # read three times: the texts are parsed once
        first = _with_scores(stats, scales(sketches(stats), prose_side=True), ("common_share", "digit_share", "symbol_share"))
        near = (F.col("z_common_share") > -FAR) & (F.col("z_digit_share") < 3 * FAR) & (F.col("z_symbol_share") < 3 * FAR)
        table = cut(sketches(first.where(near & (F.col("words") > 0)).select(*stats.columns)))
    x = _with_scores(stats, scales(table), MEASURES, percentiles=True)
    depth = F.lit(0.0)
    for m, (side, weight, most) in TAILS.items():
        out = F.least(F.greatest(F.col(f"z_{m}") * side, F.lit(0.0)), F.lit(most)) * weight
        depth = depth + (F.when(F.col("listed"), out).otherwise(0.0) if m == "common_share" else F.when(F.col("listed"), out).otherwise(out * 2))
    known = table.where("language <> 'und'").agg((F.count(F.lit(1)) > 0).alias("_known"))
    x = x.withColumn("depth", depth).join(F.broadcast(known), F.lit(True))  # one row
    return x.withColumn("prose", (F.col("depth") <= DEPTH) & (F.col("words") > 0) & F.col("_known")).drop("_known")
