"""Phrase collocation mining: weighted n-grams of distinct pieces, counted out of core by hash bucket."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, map_batches, stored, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PIECE_END = r"[.,;:!?\x0A-\x0D]"
NO_LANGUAGE = "und"
MOST_WORDS = 5
LEAST_COUNT = 100
TOP = 2000
#: Words of pieces whose n-grams are summed together before they are shuffled.
BLOCK_WORDS = 1 << 18
#: Lengths that are counted one by one; longer ones share a last round, for which the filter of these leaves few phrases.
SINGLE_ROUNDS = 3
#: Memory of the engine that counts a bucket; beyond it, the bucket spills to the task's own scratch folder.
BUCKET_MEMORY = "256MB"
#: Bits a key of the filter of frequent shorter phrases, and its largest size (16 MiB): a fuller filter lets more through, counts stay exact.
BITS_PER_KEY, MOST_BITS = 16, 1 << 27


def pieces(docs: DataFrame) -> DataFrame:
    """``(lang, piece, words, m)``: each distinct piece of a language once, its words parted by one space, with its multiplicity."""
    text = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), UPPER, LOWER)
    split = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANGUAGE)).alias("lang"), F.explode(F.split(text, PIECE_END)).alias("raw"))
    plain = split.select("lang", F.regexp_replace(F.btrim("raw", F.lit(" \t")), r"[ \t]+", " ").alias("piece")).filter("piece <> ''")
    words = (F.length("piece") - F.length(F.translate("piece", " ", "")) + 1).cast("long")
    return plain.groupBy("lang", "piece").agg(F.count(F.lit(1)).alias("m")).select("lang", "piece", words.alias("words"), "m")


def mixed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A 64-bit hash of two hashes, in order."""
    with np.errstate(over="ignore"):
        h = left * np.uint64(0x9E3779B97F4A7C15) + (right ^ (right >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _filter_places(bits: int) -> list[Column]:
    return [F.col("h").bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned("h", 32).bitwiseAND(F.lit(bits - 1))]


def phrase_filter(frequent: DataFrame, n: int) -> np.ndarray:
    """The bits of the hashes of ``frequent(h)``, ``n`` rows, as 64-bit words: bounded by ``MOST_BITS``, no false negatives."""
    bits = 1 << min(MOST_BITS.bit_length() - 1, max(16, (n * BITS_PER_KEY - 1).bit_length()))
    at = frequent.select(F.explode(F.array(*_filter_places(bits))).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("v")).toArrow()
    out = np.zeros(bits >> 6, dtype=np.int64)
    out[words.column("w").to_numpy()] = words.column("v").to_numpy()
    return out.view(np.uint64)


def passes(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    last = np.uint64(len(words) * 64 - 1)
    held = lambda at: (words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)
    return (held(hashes & last) & held((hashes >> np.uint64(32)) & last)).astype(bool)


def weighted_grams(block: pa.Table, levels: tuple[int, ...], filters: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """``(lang, phrase, h, n)``: phrases of as many words as ``levels`` name of a block's pieces with their weights, each once.

    A phrase is left out only where a filter knows that one of its shorter
    parts, and so the phrase itself, is not frequent.
    """
    split = pc.split_pattern(block.column("piece").combine_chunks(), " ")
    coded, langs = split.flatten().dictionary_encode(), block.column("lang").combine_chunks().dictionary_encode()
    word, vocabulary = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    row = np.repeat(np.arange(len(split)), np.diff(split.offsets.to_numpy()))
    weight, lang = block.column("m").to_numpy(), langs.indices.to_numpy().astype(np.int64)
    digest = lambda texts: np.fromiter((xxhash.xxh64_intdigest(t, 42) for t in texts.to_pylist()), dtype=np.uint64, count=len(texts))
    pair = lang[row] * len(vocabulary) + word
    found, first, code = np.unique(pair, return_index=True, return_inverse=True)
    hashes = mixed(digest(langs.dictionary)[found // len(vocabulary)], digest(vocabulary)[found % len(vocabulary)])
    at = np.arange(len(word))
    for level in range(1, max(levels) + 1):
        if level > 1:
            if level - 2 < len(filters):
                may = passes(filters[level - 2], hashes)[code]
                at, code = at[may], code[may]
            left = np.nonzero((at[1:] == at[:-1] + 1) & (row[at[1:]] == row[at[:-1]]))[0]
            pair = code[left] * len(hashes) + code[left + 1]
            found, first, after = np.unique(pair, return_index=True, return_inverse=True)
            hashes = mixed(hashes[found // len(hashes)], hashes[found % len(hashes)])
            at, code = at[left], after
        if level in levels:
            total = np.zeros(len(found), dtype=np.int64)
            np.add.at(total, code, weight[row[at]])
            start = at[first]
            phrase = pc.binary_join_element_wise(*[vocabulary.take(pa.array(word[start + j])) for j in range(level)], " ")
            yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(lang[row[start]])), phrase, pa.array(hashes.view(np.int64)), pa.array(total)], ["lang", "phrase", "h", "n"])


def _gram_batches(batches: Iterator[pa.RecordBatch], levels: tuple[int, ...], filters: list[np.ndarray], block_words: int) -> Iterator[pa.RecordBatch]:
    waiting, words = [], 0
    for batch in batches:
        waiting.append(batch)
        words += pc.sum(batch.column("words")).as_py() or 0
        if words >= block_words:
            yield from weighted_grams(pa.Table.from_batches(waiting), levels, filters)
            waiting, words = [], 0
    if waiting:
        yield from weighted_grams(pa.Table.from_batches(waiting), levels, filters)


def _count_bucket(batches: Iterator[pa.RecordBatch], least: int, memory: str) -> Iterator[pa.RecordBatch]:
    """The sums of one bucket's rows by (lang, phrase), those under ``least`` left out; rows stream in, groups beyond ``memory`` spill."""
    begun = next(batches, None)
    if begun is None:
        return

    def rows() -> Iterator[pa.RecordBatch]:
        yield begun
        yield from batches

    # the engine's spill files, like Spark's own, are read by this task alone and go with it
    with tempfile.TemporaryDirectory(prefix="collocations-") as scratch, duckdb.connect() as engine:
        engine.execute(f"SET threads = 1; SET memory_limit = '{memory}'; SET temp_directory = '{scratch}'; SET preserve_insertion_order = false")
        engine.register("grams", pa.RecordBatchReader.from_batches(begun.schema, rows()))
        found = engine.sql(f"SELECT lang, phrase, any_value(h) AS h, CAST(sum(n) AS BIGINT) AS f FROM grams GROUP BY lang, phrase HAVING sum(n) >= {int(least)}")
        yield from found.to_arrow_reader(10_000)


def frequent_phrases(parted: DataFrame, most_words: int = MOST_WORDS, least: int = LEAST_COUNT, memory: str = BUCKET_MEMORY, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``(lang, words, phrase, f)``, stored: every phrase of 1 to ``most_words`` words with its count, if that is ``least`` or more.

    Rounds over the stored pieces, one for each of the first lengths and one
    for all others: blocks of pieces give their phrases with weights, summed in
    the block, so a hot phrase has a row a block; rows are dealt out by the
    phrase's hash, and each bucket is summed by an engine that spills. A phrase
    can be frequent only if all shorter ones in it are, so a round looks at
    those that pass the filters of the rounds before.
    """
    spark = parted.sparkSession
    rounds = [(n,) for n in range(1, min(SINGLE_ROUNDS, most_words) + 1)] + [tuple(range(SINGLE_ROUNDS + 1, most_words + 1))]
    tables: list[DataFrame] = []
    filters: list[np.ndarray] = []
    for levels in filter(None, rounds):
        held = spark.sparkContext.broadcast(filters)
        grams = map_batches(parted.select("lang", "piece", "words", "m"), lambda b, levels=levels, held=held: _gram_batches(b, levels, held.value, block_words), "lang string, phrase string, h long, n long")
        counted = grams.repartition("h").mapInArrow(lambda b: _count_bucket(b, least, memory), "lang string, phrase string, h long, f long")
        tables.append(stored(counted))
        held.destroy()
        n = tables[-1].count()
        if not n or max(levels) == most_words:
            break
        filters = [*filters, phrase_filter(tables[-1], n)]
    whole = tables[0]
    for more in tables[1:]:
        whole = whole.unionByName(more)
    words = F.length("phrase") - F.length(F.translate("phrase", " ", "")) + 1
    out = stored(whole.select("lang", words.cast("int").alias("words"), "phrase", "f"))
    discard(*tables)
    return out


def collocations(docs: DataFrame, most_words: int = MOST_WORDS, least: int = LEAST_COUNT, top: int = TOP, cover_percent: int = 100, memory: str = BUCKET_MEMORY, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The ``top`` phrases of each language: ``(lang, rank, phrase, a, l, r, n, score)``.

    ``docs`` needs ``text`` and ``lang``; other columns are not read. A-Z are
    lower-cased, pieces end at `.,;:!?` and line ends, words at blanks and tabs.
    Candidates have 2 to ``most_words`` words and a count ``a`` of ``least`` or
    more. Each asks for the counts of both parts of every cut; the requests
    are shuffled to where the parts lie. Its score is that of the worst cut, the first of
    equal ones: floor(1000 a n / (l r)), in decimals of 38 digits. A candidate
    that a longer one of at least ``cover_percent`` of its count contains goes:
    counts never grow with length, so longer ones by one word decide.

    A null text is empty and a null language ``und``; texts without words give
    nothing; repeated rows count as often as they are there; texts of any
    length count whole, a piece as long as a text in one block of its own;
    equal scores order by count, then phrase in byte order; an empty table
    gives no rows.
    """
    parted = stored(pieces(docs))
    known = frequent_phrases(parted, most_words, least, memory, block_words)
    totals = stored(parted.groupBy("lang").agg(F.sum(F.col("m") * F.col("words")).alias("n")))
    discard(parted)
    candidates = known.filter("words > 1")
    spaced = F.split("phrase", " ")
    part = lambda begin, size: F.array_join(F.slice(spaced, begin, size), " ")
    requests = candidates.select("lang", "phrase", F.col("f").alias("a"), "words", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    requests = requests.select(
        "lang", "phrase", "a", "words", "k",
        F.explode(F.array(F.struct(F.lit("l").alias("side"), part(F.lit(1), F.col("k")).alias("part")), F.struct(F.lit("r").alias("side"), part(F.col("k") + 1, F.col("words") - F.col("k")).alias("part")))).alias("asked"),
    )
    requests = stored(requests.select("lang", "phrase", "a", "words", "k", "asked.side", "asked.part"))
    answers = requests.join(known.select("lang", F.col("phrase").alias("part"), F.col("f").alias("found")).hint("merge"), ["lang", "part"])
    each = [F.max(F.when((F.col("k") == k) & (F.col("side") == side), F.col("found"))).alias(f"{side}{k}") for k in range(1, most_words) for side in ("l", "r")]
    cut = answers.groupBy("lang", "phrase", "a", "words").agg(*each).join(totals, "lang")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = [
        F.when(
            F.col(f"l{k}").isNotNull(),
            F.struct(F.expr(f"(1000 * cast(a as decimal(19,0)) * cast(n as decimal(19,0))) div (cast(l{k} as decimal(19,0)) * cast(r{k} as decimal(19,0)))").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")),
        )
        for k in range(1, most_words)
    ]
    scored = stored(cut.select("lang", "phrase", "a", "words", "n", F.array_min(F.array_compact(F.array(*cuts))).alias("worst")))
    longer = scored.filter("words > 2").select("lang", F.explode(F.array(part(F.lit(1), F.col("words") - 1), part(F.lit(2), F.col("words") - 1))).alias("phrase"), "a")
    covered = stored(longer.groupBy("lang", "phrase").agg(F.max("a").alias("longer")))
    kept = scored.join(covered.hint("merge"), ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * wide("longer") < cover_percent * wide("a")))
    best = kept.select("lang", "phrase", "a", "worst.l", "worst.r", "n", "worst.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = stored(best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top))
    discard(known, totals, requests, scored, covered)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), parted AS (
  SELECT lang, w, count(*) AS times FROM (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces) WHERE len(w) > 0 GROUP BY ALL
), totals AS (
  SELECT lang, sum(len(w) * times) AS n FROM parted GROUP BY lang
), sizes AS (
  SELECT unnest(range(1, 6)) AS words
), counted AS (
  SELECT lang, words, array_to_string(list_slice(w, i, i + words - 1), ' ') AS phrase, sum(times) AS f
  FROM (SELECT lang, w, times, words, unnest(range(1, len(w) - words + 2)) AS i FROM parted, sizes WHERE len(w) >= words)
  GROUP BY ALL HAVING sum(times) >= 100
), cuts AS (
  SELECT lang, words, phrase, f, k, array_to_string(list_slice(string_split(phrase, ' '), 1, k), ' ') AS p, array_to_string(list_slice(string_split(phrase, ' '), k + 1, words), ' ') AS q
  FROM (SELECT *, unnest(range(1, words)) AS k FROM counted WHERE words > 1)
), scored AS (
  SELECT c.lang, c.words, c.phrase, c.f AS a, x.f AS l, y.f AS r, t.n, (1000::HUGEINT * c.f * t.n) // (x.f::HUGEINT * y.f) AS score,
    row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY (1000::HUGEINT * c.f * t.n) // (x.f::HUGEINT * y.f), k) AS nth
  FROM cuts c JOIN counted x ON x.lang = c.lang AND x.phrase = c.p JOIN counted y ON y.lang = c.lang AND y.phrase = c.q JOIN totals t ON t.lang = c.lang
), kept AS (
  SELECT * FROM scored s WHERE nth = 1 AND NOT EXISTS (
    SELECT 1 FROM counted o WHERE o.lang = s.lang AND o.words > s.words AND o.f >= s.a AND contains(' ' || o.phrase || ' ', ' ' || s.phrase || ' '))
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
"""
