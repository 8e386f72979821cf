"""Language identification: known words first, shorter and shorter character n-grams for the rest."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructType

from .common import free_prefix, held_out, map_batches, most_frequent, stored, table, without

#: Runs of word characters but decimal digits and underscores; those with superscripts, fractions or numeral signs in them are parted again.
RUN = re.compile(r"[^\W\d_]+")
UNDETERMINED = "und"
#: Words and n-grams that every worker holds: those with the highest counts over the whole training fold and as many again, in equal shares,
#: with the highest of each language. The others are looked up by joins with the stored counts; the bounds change no result.
MAX_WORDS = 60_000
MAX_GRAMS = 40_000
LONGEST_GRAM = 4
#: The n-grams of longer words are looked up anew each time: bounds the cache's memory, changes no result.
LONGEST_CACHED = 64
#: Documents of a corpus whose language is less likely than this, so that no language has most of the posterior, are not told.
LEAST_SCORE = 0.5
#: Partial counts that a worker holds before it hands them on.
FLUSH = 200_000
#: Weight of a backed-off word against a known one.
BACKOFF = 0.4
#: Steps in which the weights of words that are looked up are added: sums of whole numbers do not depend on the order of rows.
STEPS = 1 << 24


def count_words(text: str) -> Counter:
    """The runs of letters of a text with their counts."""
    found = Counter(RUN.findall(text))
    for run in [r for r in found if not r.isalpha()]:
        n = found.pop(run)
        for word in "".join(c if c.isalpha() else " " for c in run).split():
            found[word] += n
    return found


def grams(word: str, n: int) -> list[str]:
    padded = f"_{word}_"
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, Counter] = {}
    held = 0

    def out() -> pa.RecordBatch:
        rows = [(lang, w, n) for lang, c in counts.items() for w, n in c.items()]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], ["lang", "word", "n"])

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            counter = counts.setdefault(lang, Counter())
            before = len(counter)
            counter.update(count_words(text.lower()))
            held += len(counter) - before
        if held >= FLUSH:
            yield out()
            counts, held = {}, 0
    if held:
        yield out()


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, dict[str, int]] = {}
    for batch in batches:
        for lang, word, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            own = counts.setdefault(lang, {})
            padded = f"_{word}_"
            for k in range(1, LONGEST_GRAM + 1):
                for i in range(len(padded) - k + 1):
                    g = padded[i : i + k]
                    own[g] = own.get(g, 0) + n
        if sum(map(len, counts.values())) >= FLUSH:
            yield _gram_rows(counts)
            counts = {}
    if counts:
        yield _gram_rows(counts)


def _gram_rows(counts: dict[str, dict[str, int]]) -> pa.RecordBatch:
    langs = [lang for lang, c in counts.items() for _ in c]
    return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array([g for c in counts.values() for g in c], pa.string()), pa.array([n for c in counts.values() for n in c.values()], pa.int64())], ["lang", "word", "n"])


@dataclass
class LanguageModel:
    """Log frequencies by language: ``words`` and ``grams`` give a row of the matrices.

    Where they are not all that was learned, ``tables`` are the counts of all
    words and of all n-grams, and ``sums`` the words of each language.
    """

    languages: list[str]
    words: dict[str, int]
    word_scores: np.ndarray
    gram_rows: dict[str, int]
    gram_scores: np.ndarray
    sums: np.ndarray | None = None
    tables: tuple[DataFrame, DataFrame] | None = None

    def unseen(self, word: str) -> list[int]:
        """The rows of the longest n-grams of which any is known; none if none is."""
        for n in range(LONGEST_GRAM, 0, -1):
            rows = [self.gram_rows[g] for g in grams(word, n) if g in self.gram_rows]
            if rows:
                return rows
        return []

    def predict(self, text: str | None, cache: dict[str, list[int]]) -> tuple[str, float]:
        """Language and posterior: each known word counts its log frequency, each other one the mean of its n-grams', less."""
        found = count_words(text.lower()) if text else None
        if not found or not self.languages:
            return UNDETERMINED, 0.0
        rows, times, gram_rows, gram_times = [], [], [], []
        for word, n in found.items():
            row = self.words.get(word)
            if row is not None:
                rows.append(row)
                times.append(n)
                continue
            of = cache.get(word)
            if of is None:
                of = self.unseen(word)
                if len(cache) < FLUSH and len(word) <= LONGEST_CACHED:
                    cache[word] = of
            if of:
                gram_rows += of
                gram_times += [BACKOFF * n / len(of)] * len(of)
        total = np.array(times, dtype=float) @ self.word_scores[np.array(rows, dtype=int)] + np.array(gram_times, dtype=float) @ self.gram_scores[np.array(gram_rows, dtype=int)]
        odds = np.exp(total - total.max())
        best = int(np.argmax(total))
        return self.languages[best], float(odds[best] / odds.sum())


def _held(by_word: DataFrame, k: int, languages: list[str]) -> pa.Table:
    """The rows of ``(word, n, by)`` that workers hold, by falling count, with a column of counts for each language; they come as Arrow, whose memory is a small part of that of rows."""
    of = F.map_from_entries("by")
    counts = [F.coalesce(F.try_element_at(of, F.lit(lang)), F.lit(0)).alias(f"c{i}") for i, lang in enumerate(languages)]
    parts = (most_frequent(by_word, k), most_frequent_by_language(by_word, max(1, k // max(1, len(languages)))))
    rows = pa.concat_tables([part.select("word", "n", *counts).toArrow() for part in parts])
    rows = rows.sort_by([("n", "descending"), ("word", "ascending")]).combine_chunks()
    if not len(rows):
        return rows
    word = rows.column("word").chunk(0)  # a word of both parts has one count, so its rows are neighbours
    return rows.filter(pa.concat_arrays([pa.array([True]), pc.not_equal(word[1:], word[:-1])]))


def _scores(rows: pa.Table, languages: list[str], totals: np.ndarray) -> tuple[dict[str, int], np.ndarray]:
    """Smoothed log frequency by language, centred on each row so that an unknown one weighs nothing."""
    if not len(rows):
        return {}, np.zeros((0, len(languages)))
    counts = np.column_stack([rows.column(f"c{i}").to_numpy() for i in range(len(languages))]) + 0.5
    logs = np.log(counts) - np.log(totals + 1)
    return {word: r for r, word in enumerate(rows.column("word").to_pylist())}, logs - logs.mean(axis=1, keepdims=True)


def most_frequent_by_language(by_word: DataFrame, share: int) -> DataFrame:
    """The rows of ``(word, n, by)`` that are among about the ``share`` most frequent of any language; of a count step that overflows, those of least hash."""
    step = lambda n: F.floor(F.log2(n) * 8).cast("int")
    histogram = by_word.select(F.explode("by").alias("l")).groupBy(F.col("l.lang").alias("lang"), step("l.n").alias("step")).agg(F.count(F.lit(1)).alias("rows"))
    left: dict[str, int] = {}
    bounds: dict[str, tuple[int, int]] = {}  # a language's least step and the hashes of it that stay
    for r in histogram.orderBy(F.desc("step")).collect():
        free = left.setdefault(r["lang"], share)
        if free > 0:
            bounds[r["lang"]] = (r["step"], min(1 << 30, (free << 30) // r["rows"]))
            left[r["lang"]] = free - r["rows"]
    if not bounds:
        return by_word.limit(0)
    least, hashes = (F.create_map(*[F.lit(x) for lang, b in bounds.items() for x in (lang, b[i])]) for i in (0, 1))
    rank = F.pmod(F.xxhash64("word", F.lit(17)), F.lit(1 << 30))
    return by_word.filter(F.exists("by", lambda x: (step(x["n"]) > least[x["lang"]]) | ((step(x["n"]) == least[x["lang"]]) & (rank < hashes[x["lang"]]))))


def train(docs: DataFrame, max_words: int = MAX_WORDS, max_grams: int = MAX_GRAMS) -> LanguageModel:
    """Count the words and n-grams of every row with text and lang; the most frequent ones, of all and of each language, are held in the model, the others stay in its tables."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string").alias("lang"), "text")
    words = stored(map_batches(rows, _count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    totals = {r["lang"]: r["n"] for r in words.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    languages = sorted(totals)

    def top(counts: DataFrame, k: int) -> tuple[DataFrame, pa.Table]:
        by_word = stored(counts.groupBy("word").agg(F.sum("n").alias("n"), F.collect_list(F.struct("lang", "n")).alias("by")))
        return by_word, _held(by_word, k, languages)

    gram_counts = map_batches(words, _count_grams, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    sums = np.array([totals[x] for x in languages], dtype=float)
    all_words, held_words = top(words, max_words)
    all_grams, held_grams = top(gram_counts, max_grams)
    whole = all_words.count() == len(held_words) and all_grams.count() == len(held_grams)
    return LanguageModel(languages, *_scores(held_words, languages, sums), *_scores(held_grams, languages, sums * 5), sums, None if whole else (all_words, all_grams))


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """All columns of ``docs`` and ``lang_pred``, ``score`` (posterior of the predicted language).

    ``und`` and 0 for a null text, a text without letters, or a model that
    learned nothing; existing columns of those names are replaced. Equal texts
    get equal results, and a text without known words or n-grams the first
    language of equal scores; texts are read whole, whatever their length; an
    empty table gives none.
    """
    return _identified(without(docs, "lang_pred", "score"), model, without(docs, "lang_pred", "score").columns)


def _identified(docs: DataFrame, model: LanguageModel, columns: list[str]) -> DataFrame:
    """``columns`` of ``docs`` and the prediction: from held words in place; others, with their n-grams, join the model's tables."""
    if model.tables is None:
        return _by_held(docs, model).select(*columns, "lang_pred", "score")
    of = free_prefix(docs)
    row, base, words, times, joined = (of + name for name in ("row", "base", "words", "times", "joined"))
    first = _held_sums(docs, model, columns, row, base, words, times)
    tail = first.select(row, F.explode(F.arrays_zip(words, times)).alias("t")).select(row, F.col("t")[words].alias("word"), F.col("t")[times].alias("n"))
    languages = range(len(model.languages))
    by_word = tail.join(_table_weights(model.tables[0], model, model.sums), "word", "left")
    unseen = F.collect_list(F.when(F.col("v").isNull(), F.struct("word", "n"))).alias("unseen")
    looked_up = stored(by_word.groupBy(row).agg(*[F.sum(F.col("v")[i] * F.col("n")).alias(f"v{i}") for i in languages], unseen))
    others = looked_up.select(row, F.inline("unseen"))
    backed_off = others.join(_backed_off(others.select("word").distinct(), model), "word").select(row, *[(F.col("v")[i] * F.col("n")).alias(f"v{i}") for i in languages])
    sums = looked_up.drop("unseen").unionByName(backed_off).groupBy(row).agg(*[F.sum(f"v{i}").alias(f"v{i}") for i in languages])
    sums = sums.select(row, F.array(*[F.coalesce(f"v{i}", F.lit(0)) for i in languages]).alias(joined))
    total = F.when(F.col(joined).isNull(), F.col(base)).otherwise(F.zip_with(base, joined, lambda x, y: x + y / STEPS))
    best = F.array_max(base)
    found = first.join(sums, row, "left").withColumn(base, total)
    lang = F.array(*[F.lit(x) for x in model.languages])[(F.array_position(base, best) - 1).cast("int")]
    score = 1 / F.aggregate(F.transform(base, lambda x: F.exp(x - best)), F.lit(0.0), lambda a, x: a + x)
    return found.select(*columns, F.coalesce(F.when(F.col(base).isNotNull(), lang), F.lit(UNDETERMINED)).alias("lang_pred"), F.coalesce(score, F.lit(0.0)).alias("score"))


def _held_sums(docs: DataFrame, model: LanguageModel, columns: list[str], row: str, base: str, words: str, times: str) -> DataFrame:
    """``columns``, a row number, the sum of held words by language (null: no letter) and the other words with their counts; stored."""
    shared = docs.sparkSession.sparkContext.broadcast(replace(model, tables=None))  # bounded by about twice max_words and max_grams

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, scores = shared.value.words, shared.value.word_scores
        for batch in batches:
            sums, others, counts = [], [], []
            for text in batch.column("text").to_pylist():
                found = count_words(text.lower()) if text else {}
                held = [(known[w], n) for w, n in found.items() if w in known]
                total = np.array([n for _, n in held], dtype=float) @ scores[np.array([r for r, _ in held], dtype=int)]
                sums.append(total.tolist() if found else None)
                others.append([w for w in found if w not in known])
                counts.append([n for w, n in found.items() if w not in known])
            more = [pa.array(sums, pa.list_(pa.float64())), pa.array(others, pa.list_(pa.string())), pa.array(counts, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*columns, row)), *more], [*columns, row, base, words, times])

    numbered = docs.select(*dict.fromkeys([*columns, "text"]), F.monotonically_increasing_id().alias(row))
    schema = StructType([numbered.schema[c] for c in (*columns, row)])
    schema = schema.add(base, ArrayType(DoubleType())).add(words, ArrayType(StringType())).add(times, ArrayType(LongType()))
    return stored(map_batches(numbered, work, schema))


def _table_weights(counts: DataFrame, model: LanguageModel, sums: np.ndarray) -> DataFrame:
    """``word`` and ``v``: as ``_scores`` has them, in whole steps."""
    of = F.map_from_entries("by")
    logs = F.array(*[F.log(F.coalesce(F.try_element_at(of, F.lit(x)), F.lit(0)) + 0.5) - F.lit(float(np.log(n + 1))) for x, n in zip(model.languages, sums, strict=True)])
    mean = F.aggregate("logs", F.lit(0.0), lambda a, x: a + x) / len(model.languages)
    return counts.select("word", logs.alias("logs")).select("word", F.transform("logs", lambda x: _steps(x - mean)).alias("v"))


def _steps(x: Column) -> Column:
    return F.round(x * STEPS).cast("long")


def _backed_off(words: DataFrame, model: LanguageModel) -> DataFrame:
    """``word`` and ``v`` of distinct unseen words: of their longest n-grams of which any is known; words without any are left out."""
    shared = words.sparkSession.sparkContext.broadcast(replace(model, tables=None))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, steps = shared.value.gram_rows, np.rint(shared.value.gram_scores * STEPS).astype(np.int64)
        for batch in batches:
            out = []
            for word in batch.column(0).to_pylist():
                for k in range(LONGEST_GRAM, 0, -1):
                    parts = grams(word, k)
                    held = [rows[g] for g in parts if g in rows]
                    out.append((word, k, len(held), steps[held].sum(axis=0).tolist() if held else None, [g for g in parts if g not in rows]))
                    if held:
                        break
            types = [pa.string(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], ["word", "k", "n", "v", "missing"])

    languages = range(len(model.languages))
    tried = stored(map_batches(words, work, "word string, k int, n long, v array<long>, missing array<string>"))
    missing = tried.select(F.col("word").alias("of"), "k", F.explode("missing").alias("word"))
    rare = missing.join(_table_weights(model.tables[1], model, model.sums * 5), "word").select(F.col("of").alias("word"), "k", F.lit(1).cast("long").alias("n"), "v")
    by_length = tried.filter(F.col("n") > 0).select("word", "k", "n", "v").unionByName(rare).groupBy("word", "k").agg(F.sum("n").alias("n"), *[F.sum(F.col("v")[i]).alias(f"v{i}") for i in languages])
    longest = by_length.groupBy("word").agg(F.max_by(F.struct("n", *[f"v{i}" for i in languages]), "k").alias("l"))
    return longest.select("word", F.array(*[F.round(F.col("l")[f"v{i}"] * BACKOFF / F.col("l")["n"]).cast("long") for i in languages]).alias("v"))


def _by_held(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """All columns and the prediction from held words and n-grams alone, in place: whole where ``tables`` is None; ``und`` is right in any case."""
    shared = docs.sparkSession.sparkContext.broadcast(replace(model, tables=None))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, list[int]] = {}
        for batch in batches:
            found = [shared.value.predict(t, cache) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], [*batch.schema.names, "lang_pred", "score"])

    docs = without(docs, "lang_pred", "score")
    return map_batches(docs, work, StructType([*docs.schema.fields]).add("lang_pred", StringType()).add("score", DoubleType()))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.filter(~held_out()))
    return _identified(docs.select("doc_id", held_out().alias("held_out"), "text"), model, ["doc_id", "held_out"])


def keep_identified(docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """The documents whose language the model tells, with that language in ``lang``; all other columns stay as they are.

    ``und`` ones (null, empty and letterless texts) go, and those whose
    language is less than ``least`` likely by the model. What ``lang`` said
    before only trains the model: the prediction replaces it, null ones too.
    Held words and n-grams decide (``identify`` also looks the others up).
    Repeated rows fare alike, equal scores go to the first language by name,
    texts are read whole, whatever their length; an empty table gives none.
    """
    p = free_prefix(docs)
    own = {c: f"{p}own{i}" for i, c in enumerate(docs.columns) if c.lower() in ("lang_pred", "score")}
    placed = _by_held(docs.withColumnsRenamed(own), train(docs.filter(~held_out())))
    told = placed.filter((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least))
    return told.select(*[F.col("lang_pred").cast(docs.schema[c].dataType).alias(c) if c == "lang" else F.col(f"`{own.get(c, c)}`").alias(c) for c in docs.columns])
