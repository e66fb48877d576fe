"""Problem 9: statistics of text quality and texts that are not prose."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.llm.spread import spread
from trackloom.llm.words import BLANK, BREAK, DIGIT, END, HAN, HASH_BITS, JOIN, Chunk, HashTable, chunks, counted, cut
from trackloom.session import durable

#: Statistics that need no words; their tails tell the body of a corpus, whose common words are then learnt.
SURFACE = ("symbol_share", "digit_share", "mean_word_length")
#: Statistics of a text, in the order in which they are computed.
STATISTICS = (
    "n_words",
    "mean_word_length",
    "symbol_share",
    "digit_share",
    "punctuated_lines",
    "common_words",
    "running_words",
    "running_chars",
    "top_word_share",
    "distinct_words",
    "words_per_line",
)


@dataclass(frozen=True)
class QualityRules:
    """``growth``: factor between the buckets of a quantile sketch. ``body``, ``tail``: robust deviations up to which all surface
    statistics of a text must lie for it to teach common words, and beyond which one must lie for it to speak against them.
    ``most_languages``, ``most_words``: bounds of what is learnt. ``least_rate``: share of a language's body texts that hold a
    common word. ``window``, ``han_window``, ``dense``: words (Han characters) of a window that tells running text, and the common
    words it must hold. ``longest_word``, ``signs``: longest word that can run, and signs after a word that count with it.
    ``contrast``: see ``common_words``. ``least_scale``: smallest scale of a share's robust deviations. ``most_labels``: judged rows at
    most that set which tails count; ``most_tails``: tails at most that count, ``nearest``: where they may begin, in deviations.
    """

    growth: float = 1.01
    body: float = 1.0
    tail: float = 3.0
    most_languages: int = 64
    most_words: int = 200
    least_rate: float = 0.05
    window: int = 13
    han_window: int = 26
    dense: int = 4
    longest_word: int = 40
    signs: int = 3
    least_scale: float = 0.05
    contrast: float = 0.65
    most_labels: int = 4000
    most_tails: int = 32
    nearest: float = 0.5


#: Bound of robust scores, and words that a task counts before it hands them on.
LIMIT, MOST_HELD = 100.0, 500_000


class CommonWords:
    """Common words with the numbers of their languages, found by hash."""

    def __init__(self, words: dict[str, int]):
        self.languages = max(words.values(), default=-1) + 1
        c = cut(list(words))
        self.table = HashTable(c.hashes[np.unique(c.owner, return_index=True)[1]], np.fromiter(words.values(), np.int32, len(words)))

    def language(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word's language, -1 for other words."""
        return self.table.find(hashes)


def _running(chunk: Chunk, common: np.ndarray, is_han: np.ndarray, by_text: np.ndarray, r: QualityRules) -> np.ndarray:
    """Words from the first to the last common word of some window that holds ``dense`` of them.

    A text shorter than a window needs proportionally fewer. ``is_han``: texts mostly of Han characters; ``by_text``: words of each text.
    """
    n = len(common)
    edge = np.zeros(n + 2, np.int64)
    at = np.flatnonzero(common)
    of = chunk.owner[at]
    size = np.where(is_han, r.han_window, r.window)
    need = np.maximum(1, np.rint(r.dense * np.minimum(1, by_text / size))).astype(np.int64)
    for k in np.unique(need):
        mine = np.flatnonzero(need[of] == k)
        mine = mine[mine + k - 1 < len(at)]
        first, last = at[mine], at[mine + k - 1]
        close = (of[mine] == of[mine + k - 1]) & (last - first < size[of[mine]])
        edge += np.bincount(first[close], minlength=n + 2) - np.bincount(last[close] + 1, minlength=n + 2)
    return np.cumsum(edge)[:n] > 0


def text_statistics(texts: list[str], words: CommonWords, rules: QualityRules = QualityRules()) -> tuple[np.ndarray, np.ndarray]:
    """(number of the language seen in the words or -1, the STATISTICS) of every text.

    ``running_words`` and ``running_chars`` are the shares of words and of visible characters in running text: from the first to the
    last common word of some window that holds at least ``dense`` of them. A word counts with the few signs that follow it; what is
    too long for a word does not run.
    """
    r, n_texts = rules, len(texts)
    c = cut(texts)
    sums = lambda of, weight=None: np.bincount(of, weight, n_texts)
    surface, some = c.surface()
    blanks = c.blanks

    # Lines: the last visible character of each line that has one. Every text ends with a break.
    seen = np.flatnonzero((c.kinds & BLANK) == 0)
    breaks = np.flatnonzero(c.kinds & BREAK)
    before = breaks - blanks[breaks]
    ends = seen[before[before > np.concatenate([[0], before[:-1]])] - 1]
    of_line = np.searchsorted(c.first, ends, "right") - 1
    lines = np.maximum(1, np.bincount(of_line, minlength=n_texts))
    punctuated = np.bincount(of_line, ((c.kinds[ends] & END) > 0).astype(float), n_texts)

    n = sums(c.owner)
    many = np.maximum(1, n)
    lang = words.language(c.hashes)
    keys, times = counted((c.owner.astype(np.uint64) << np.uint64(HASH_BITS)) | (c.hashes >> np.uint64(64 - HASH_BITS)))
    of_key = (keys >> np.uint64(HASH_BITS)).astype(np.int64)
    distinct = np.bincount(of_key, minlength=n_texts)
    top = np.zeros(n_texts)
    np.maximum.at(top, of_key, times)

    common = lang >= 0
    votes = np.bincount(c.owner[common] * max(1, words.languages) + lang[common], minlength=n_texts * max(1, words.languages)).reshape(n_texts, -1)
    best = votes.argmax(axis=1)
    language = np.where(votes.max(axis=1) >= np.maximum(2, 0.05 * n), best, -1)

    length = c.stops - c.starts
    is_han_word = (c.kinds[c.starts] & HAN) > 0
    is_han = 2 * sums(c.owner, is_han_word.astype(float)) > n
    following = np.append(c.starts[1:], len(c.text))
    reach = np.minimum(np.minimum(c.stops + r.signs, following), c.first[c.owner + 1] - 1)
    stretch = np.where(length > r.longest_word, 0, reach - c.starts - (blanks[reach] - blanks[c.starts]))
    runs = _running(c, common, is_han, n, r) & (stretch > 0)
    columns = [
        n,
        surface[:, 2],
        surface[:, 0],
        surface[:, 1],
        punctuated / lines,
        sums(c.owner, common.astype(float)) / many,
        sums(c.owner, runs.astype(float)) / many,
        sums(c.owner, np.where(runs, stretch, 0).astype(float)) / some,
        np.where(n > 0, top / many, 1.0),
        distinct / many,
        n / lines,
    ]
    return language, np.stack([np.asarray(x, float) for x in columns], axis=1)


def written(documents: DataFrame) -> DataFrame:
    """``doc_id, text, tag`` of the texts that are not null, empty or blank; ``tag`` is ``lang`` in lower case, ``other`` if it has none."""
    tag = F.coalesce(F.nullif(F.lower(F.trim("lang")), F.lit("")), F.lit("other"))
    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", tag.alias("language")).where(r"text RLIKE '(?U)\\S'")


def surface_statistics(texts: DataFrame) -> DataFrame:
    """``language`` and SURFACE of each text of ``written``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_pylist()
            for begin, end in chunks(values):
                columns = cut(values[begin:end]).surface()[0]
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(begin, end - begin), *(pa.array(np.ascontiguousarray(columns[:, i])) for i in range(len(SURFACE)))], names=["language", *SURFACE])

    return spread(texts.select("text", "language")).mapInArrow(run, "language string, " + ", ".join(f"{s} double" for s in SURFACE))


def language_sketches(statistics: DataFrame, of: tuple[str, ...] = STATISTICS, growth: float = QualityRules.growth) -> DataFrame:
    """Quantile sketches of every statistic per language, in long form: language, statistic, bucket, n.

    A sketch counts values in buckets whose borders grow by the factor ``growth`` (0 and below: bucket null), so a quantile is off by
    at most half that factor. Counts add up, whatever the order or the parts, so the same corpus always gives the same sketch;
    its size is bounded by the range of the values, not by their number.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(s).alias("statistic"), F.col(s).alias("value")) for s in of]))
    value = F.col("p.value")
    bucket = F.when(value > 0, F.floor(F.log(value) / math.log(growth)).cast("int"))
    return statistics.select("language", pairs.alias("p")).groupBy("language", F.col("p.statistic").alias("statistic"), bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def merged_sketches(*parts: DataFrame) -> DataFrame:
    """Sketches of several parts of a corpus (days, sources) as if taken over all of it."""
    return reduce(DataFrame.unionByName, parts).groupBy("language", "statistic", "bucket").agg(F.sum("n").alias("n"))


def sketch_quantiles(sketches: DataFrame, growth: float = QualityRules.growth, **at: float) -> DataFrame:
    """language, statistic and one column per name in ``at``: the value at that quantile."""
    order = Window.partitionBy("language", "statistic").orderBy(F.asc_nulls_first("bucket"))
    whole = Window.partitionBy("language", "statistic")
    counted = sketches.withColumns({"seen": F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum("n").over(whole)})
    value = F.coalesce(F.pow(F.lit(growth), F.col("bucket") + 0.5), F.lit(0.0))
    return counted.groupBy("language", "statistic").agg(*[F.min(F.when(F.col("seen") >= q * F.col("total"), value)).alias(name) for name, q in at.items()])


def language_scales(sketches: DataFrame, of: tuple[str, ...], rules: QualityRules) -> DataFrame:
    """``language, <s>_mid, <s>_dev`` of every language and of ``other``, which stands for all languages together.

    The deviation is the distance from the median to the 84 % quantile or half of that between the 16 % and the 84 % quantile,
    whichever is less, so that a language with many tables is not measured by them; it is at least ``least_scale`` (of the median,
    where that is above 1). There is a row per known language, of which there are at most ``most_languages``.
    """
    every = merged_sketches(sketches.withColumn("language", F.lit("other")))
    quantiles = sketch_quantiles(sketches.where("language <> 'other'").unionByName(every), rules.growth, low=0.16, mid=0.5, high=0.84)
    spread_of = F.least(F.col("high") - F.col("mid"), (F.col("high") - F.col("low")) / 2)
    scaled = quantiles.withColumn("dev", F.greatest(spread_of, rules.least_scale * F.greatest(F.lit(1.0), F.col("mid"))))
    pick = lambda s, c: F.max(F.when(F.col("statistic") == s, F.col(c))).alias(f"{s}_{c}")
    return scaled.groupBy("language").agg(*[pick(s, c) for s in of for c in ("mid", "dev")])


def robust_scores(statistics: DataFrame, sketches: DataFrame, of: tuple[str, ...] = STATISTICS, rules: QualityRules = QualityRules()) -> DataFrame:
    """Adds ``<s>_z`` for each statistic: its distance from the language's median in robust deviations, limited to +-LIMIT."""
    # At most most_languages + 1 rows, by construction of the languages.
    joined = statistics.join(F.broadcast(language_scales(sketches, of, rules)), "language")
    z = lambda s: (F.col(s) - F.col(f"{s}_mid")) / F.col(f"{s}_dev")
    return joined.select(*statistics.columns, *[F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), z(s))).alias(f"{s}_z") for s in of])


def known_languages(documents: DataFrame, most: int) -> list[str]:
    """The ``most`` commonest tags of a corpus (any letter case), ties in alphabetical order. Only the tags are read."""
    tags = documents.select(F.lower(F.trim("lang")).alias("tag")).where("tag <> '' AND tag <> 'other'").groupBy("tag").count()
    return sorted(row.tag for row in tags.orderBy(F.desc("count"), "tag").limit(most).collect())


def word_counts(texts: DataFrame, scales: dict[str, tuple[np.ndarray, np.ndarray]], rules: QualityRules = QualityRules()) -> DataFrame:
    """``language, side, word, n``: texts of each language and side (``body`` or ``tail``) that hold a word of letters only.

    The row of the null word counts all texts of the side. ``scales``: language -> (medians, deviations) of SURFACE; texts between
    body and tail do not count.
    """
    default = scales.get("other")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flushed() -> pa.RecordBatch:
            keys = list(held)
            columns = [pa.array([k[i] for k in keys], pa.string()) for i in range(3)]
            return pa.RecordBatch.from_arrays([*columns, pa.array(list(held.values()), pa.int64())], names=["language", "side", "word", "n"])

        for batch in batches:
            values, languages = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            names = [(language, side) for language in dict.fromkeys(languages) for side in ("body", "tail")]
            number_of = {language: 2 * i for i, language in enumerate(dict.fromkeys(languages))}
            for begin, end in chunks(values):
                c = cut(values[begin:end])
                scale = [scales.get(language, default) for language in languages[begin:end]]
                z = np.abs(c.surface()[0] - np.stack([m for m, _ in scale])) / np.stack([d for _, d in scale])
                far = z.max(axis=1)
                used = (far <= rules.body) | (far > rules.tail)
                group_of = np.array([number_of[language] for language in languages[begin:end]], np.uint64) + (far > rules.tail).astype(np.uint64)
                for g, n in zip(*(x.tolist() for x in np.unique(group_of[used], return_counts=True))):
                    held[(*names[g], None)] += n
                # Digits and joined parts make no common word; their texts count all the same.
                odd = np.concatenate([[0], np.cumsum((c.kinds & (DIGIT | JOIN)) > 0, dtype=np.int32)])
                spelt = np.flatnonzero((odd[c.stops] == odd[c.starts]) & (c.stops - c.starts <= rules.longest_word) & used[c.owner])
                short = c.hashes[spelt] >> np.uint64(64 - HASH_BITS)
                once = counted((c.owner[spelt].astype(np.uint64) << np.uint64(HASH_BITS)) | short)[0]
                group = group_of[once >> np.uint64(HASH_BITS)]
                mask = np.uint64((1 << HASH_BITS) - 1)
                keys, counts = counted((group << np.uint64(HASH_BITS)) | (once & mask))
                distinct = counted(keys & mask)[0]
                place = np.zeros(len(distinct), np.int64)
                place[np.searchsorted(distinct, short)] = spelt
                words = [c.text[a:b] for a, b in zip(c.starts[place].tolist(), c.stops[place].tolist())]
                number = np.searchsorted(distinct, keys & mask).tolist()
                for g, i, count in zip((keys >> np.uint64(HASH_BITS)).tolist(), number, counts.tolist()):
                    held[(*names[g], words[i])] += count
                if len(held) > MOST_HELD:
                    yield flushed()
                    held.clear()
        if held:
            yield flushed()

    parts = spread(texts.select("text", "language")).mapInArrow(run, "language string, side string, word string, n bigint")
    return parts.groupBy("language", "side", "word").agg(F.sum("n").alias("n"))


def common_words(counts: DataFrame, rules: QualityRules = QualityRules()) -> dict[str, str]:
    """The common words of each language, learnt from the corpus: word -> language.

    Every text counts. A word belongs to the language in whose body texts it is most usual, so that texts with a wrong tag do little
    harm. It is common if at least ``least_rate`` of these texts hold it and if it is much rarer in the language's tail texts:
    words of running sentences are, while names of things stand in lists and tables as well. How much rarer is set by the
    language's own words: the share ``contrast`` of the (logarithmic) contrast that a tenth of its usual words exceed. At most
    ``most_words`` a language are kept, the most usual ones.

    ``counts`` are those of ``word_counts``.
    """
    of = lambda side, name: F.coalesce(F.sum(F.when(F.col("side") == side, F.col("n"))), F.lit(0)).alias(name)
    counts = durable(counts.groupBy("word", "language").agg(of("body", "in_body"), of("tail", "in_tail")))
    totals = counts.where("word IS NULL").select("language", F.col("in_body").alias("body"), F.col("in_tail").alias("tail"))
    rates = counts.where("word IS NOT NULL").join(F.broadcast(totals), "language").where("language <> 'other'").select(  # a row per known language
        "word",
        "language",
        (F.col("in_body") / F.col("body")).alias("rate"),
        ((F.col("in_tail") + 0.5) / (F.col("tail") + 1)).alias("tail_rate"),
    )
    best = rates.where("rate > 0").groupBy("word").agg(F.max(F.struct("rate", "language", "tail_rate")).alias("b")).select("word", "b.*").where(F.col("rate") >= rules.least_rate)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("language").orderBy(F.desc("rate"), "word"))).where(F.col("rank") <= 4 * rules.most_words)
    found = ranked.select("language", "word", "rate", (F.log("rate") - F.log("tail_rate")).alias("contrast")).toPandas()
    chosen: dict[str, str] = {}
    for language, rows in found.groupby("language", sort=True):
        enough = rows["contrast"] >= rules.contrast * max(0.0, rows["contrast"].quantile(0.9))
        kept = rows[enough].sort_values(["rate", "word"], ascending=[False, True]).head(rules.most_words)
        chosen |= dict.fromkeys(kept["word"], language)
    return chosen


def document_statistics(documents: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """``doc_id, language`` and the STATISTICS of every text that is not null, empty or blank; a row for each such row.

    ``language`` is the one whose common words the text holds, else the tag of the row if it is one of the corpus's commonest (any
    letter case), else ``other``. The texts are read three times: for the tails of the surface statistics, for the words, and for the
    statistics; the result is checkpointed.
    """
    known = known_languages(documents, rules.most_languages)
    texts = written(documents)
    texts = texts.withColumn("language", F.when(F.col("language").isin(known), F.col("language")).otherwise("other")) if known else texts.withColumn("language", F.lit("other"))
    scales = {
        row["language"]: tuple(np.array([row[f"{s}_{c}"] for s in SURFACE], float) for c in ("mid", "dev"))
        for row in language_scales(durable(language_sketches(surface_statistics(texts), SURFACE, rules.growth)), SURFACE, rules).collect()  # a row per known language
    }
    words = common_words(word_counts(texts, scales, rules), rules)
    names = sorted(set(words.values()))
    number = CommonWords({w: names.index(of) for w, of in words.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(1).to_pylist()
            for begin, end in chunks(values):
                language, columns = text_statistics(values[begin:end], number, rules)
                seen = [names[i] if i >= 0 else None for i in language.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(begin, end - begin), batch.column(2).slice(begin, end - begin), pa.array(seen, pa.string()), *(pa.array(np.ascontiguousarray(columns[:, i])) for i in range(len(STATISTICS)))],
                    names=["doc_id", "tag", "seen", *STATISTICS],
                )

    schema = "doc_id bigint, tag string, seen string, " + ", ".join(f"{s} double" for s in STATISTICS)
    measured = spread(texts.select("doc_id", "text", "language")).mapInArrow(run, schema)
    return durable(measured.select("doc_id", F.coalesce("seen", "tag").alias("language"), *STATISTICS))


def tails(scored: DataFrame, cuts: list[tuple[str, float]]) -> DataFrame:
    """Adds ``tails``: the cuts that a text lies beyond, as ``<statistic> below`` or ``above`` the cut, in robust deviations."""
    flags = [F.when(_beyond(s, cut), F.lit(f"{s} {'below' if cut < 0 else 'above'} {cut:.3g}")) for s, cut in cuts]
    return scored.withColumn("tails", F.array_compact(F.array(*flags)))


def _beyond(statistic: str, cut: float) -> Column:
    z = F.col(f"{statistic}_z")
    return z < cut if cut < 0 else z > cut


def in_tails(z: np.ndarray, cuts: list[tuple[int, float]]) -> np.ndarray:
    """1 where a row's column lies beyond a cut: below a negative one, above a positive one."""
    return np.stack([z[:, i] < cut if cut < 0 else z[:, i] > cut for i, cut in cuts], axis=1).astype(float) if cuts else np.zeros((len(z), 0))


def fit_weights(flags: np.ndarray, is_bad: np.ndarray, ridge: float = 1e-4, steps: int = 40) -> np.ndarray:
    """Weights (bias last) of a ridge logistic regression by Newton's method, on 0/1 columns."""
    x = np.concatenate([flags, np.ones((len(flags), 1))], axis=1)
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge * len(x))
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - is_bad) + penalty * w
        hessian = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit_tails(z: np.ndarray, is_bad: np.ndarray, rules: QualityRules = QualityRules()) -> tuple[list[tuple[int, float]], np.ndarray]:
    """Which tails count, and how much: (column, cut) pairs, and their weights with the bias last.

    Cuts between the quantiles of a column, at least ``nearest`` deviations off the median, are candidates. One after the other, the tail
    that would lower the deviance of a logistic regression most joins in, as long as it speaks against prose and at least three
    rows lie on either side, up to one for every dozen rows of the rarer sort and ``most_tails``. Weights stay above 0 and
    the bias below, so a text in no tail is prose.
    """
    options = []
    for i in range(z.shape[1]):
        values = np.unique(np.quantile(z[:, i], np.linspace(0, 1, 61)))
        options += [(i, float(c)) for c in (values[1:] + values[:-1]) / 2 if abs(c) >= rules.nearest]
    flags = in_tails(z, options)
    usable = [k for k in range(len(options)) if 3 <= flags[:, k].sum() <= len(z) - 3]
    options, flags = [options[k] for k in usable], flags[:, usable]
    chosen: list[int] = []
    weights = fit_weights(flags[:, chosen], is_bad)
    for _ in range(min(rules.most_tails, int(min(is_bad.sum(), (1 - is_bad).sum()) // 12) + 2, len(options))):
        p = 1 / (1 + np.exp(-np.clip(flags[:, chosen] @ weights[:-1] + weights[-1], -30, 30)))
        gradient = flags.T @ (is_bad - p)
        gain = np.where(gradient > 0, gradient**2 / ((flags**2).T @ (p * (1 - p)) + 1e-4 * len(z)), -1.0)
        gain[chosen] = -1.0
        if gain.max(initial=-1.0) <= 0:
            break
        chosen.append(int(gain.argmax()))
        weights = fit_weights(flags[:, chosen], is_bad)
    weights[:-1] = np.maximum(weights[:-1], 0.0)
    weights[-1] = min(weights[-1], -1e-6)
    return [options[k] for k in chosen], weights


#: The tail that decides where no rows of both sorts are judged: most of the text does not run.
DEFAULT_CUT = ("running_chars", -0.5)


def prose_scores(documents: DataFrame, labels: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """Statistics, robust scores, ``tails`` and ``not_prose_score`` (positive: not prose) of every text that is not blank.

    Method. Every statistic gets a mergeable quantile sketch per language over all documents; values become robust z-scores by
    these sketches; texts beyond a cut lie in a tail of the distribution, and the tails alone decide. Which cuts, and what each tail
    counts, is fitted on at most ``most_labels`` judged ids (the lowest hashes, so the same ones every time); a text in no
    tail is always prose. Without judged rows of both sorts a text is not prose if less than half of it runs in sentences.

    Defined cases: null, empty and blank texts have no row; repeated rows and ids have one each, and a repeated judged id teaches
    once, by the first of its texts in the order of their statistics; labels other than ``prose`` and ``not_prose`` are ignored, of
    contradicting ones ``not_prose`` holds; an empty table gives no rows.
    """
    statistics = document_statistics(documents, rules)
    scored = robust_scores(statistics, language_sketches(statistics, STATISTICS, rules.growth), STATISTICS, rules)
    judged = (
        labels.where(F.col("label").isin("prose", "not_prose") & F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").cast("bigint").alias("l_id"))
        .agg(F.max((F.col("label") == "not_prose").cast("double")).alias("is_bad"))
        .orderBy(F.xxhash64("l_id"), "l_id")
        .limit(rules.most_labels)
    )
    z = [f"{s}_z" for s in STATISTICS]
    # One row per judged id, so most_labels bounds what comes to the driver.
    rows = scored.join(judged, F.col("doc_id") == F.col("l_id")).groupBy("l_id").agg(F.min("is_bad").alias("is_bad"), F.min(F.struct(*z)).alias("z"))
    sample = rows.select("l_id", "is_bad", "z.*").toPandas().sort_values("l_id")
    is_bad = sample["is_bad"].to_numpy(float)
    fitted, weights = fit_tails(sample[z].to_numpy(float), is_bad, rules) if sample["is_bad"].nunique() == 2 else ([], np.zeros(1))
    cuts = [(STATISTICS[i], cut) for i, cut in fitted]
    if not cuts:
        return tails(scored, [DEFAULT_CUT]).withColumn("not_prose_score", F.lit(0.5) - F.col("running_chars"))
    score = F.lit(float(weights[-1]))
    for (s, cut), weight in zip(cuts, weights):
        score = score + F.when(_beyond(s, cut), float(weight)).otherwise(0.0)
    return tails(scored, cuts).withColumn("not_prose_score", score)
