"""Benchmark decontamination by pigeonhole edit matching."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DataType, IntegerType, LongType, StructType

from .common import free_prefix, map_batches, table

#: Edits allowed for each character of an item.
ERROR_RATE = 0.05
#: Characters of benchmark that one automaton holds; a larger benchmark takes several passes over the documents.
BLOCK_CHARS = 4_000_000
_SPACES = {c: " " for c in "\t\n\x0b\x0c\r\x85\xa0  "}
#: The one letter whose lower case is two characters, with the white space.
_FOLD = str.maketrans(_SPACES | {"\u0130": "i"})


def folded(text: str) -> str:
    """Lower case of all scripts and plain spaces, one character for one, so that offsets stay those of the text."""
    return text.translate(_FOLD).lower().replace("\u03c2", "\u03c3")


def pieces(item: str, rate: float = ERROR_RATE) -> list[tuple[int, str]]:
    """Error budget plus one pieces with their offsets: a match within the budget leaves one of them whole."""
    n = int(len(item) * rate) + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def myers(pattern: str, text: str, budget: int) -> tuple[int, int] | None:
    """(edits, end) of the best occurrence of ``pattern`` in ``text`` within ``budget`` edits, by Myers' bit vectors; the first end of the least edits."""
    m = len(pattern)
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    every, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = every, 0, m
    best = (score, 0) if score <= budget else None
    for j, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & every, pv & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = ph << 1 & every, mh << 1 & every
        pv, mv = mh | ~(xv | ph) & every, ph & xv
        if score <= budget and (best is None or score < best[0]):
            best = score, j
    return best


class Matcher:
    """The items of one block: an automaton of all their pieces."""

    def __init__(self, items: list[tuple[int, str]], rate: float = ERROR_RATE):
        self.items = [(i, folded(t).strip()) for i, t in items]
        self.budgets = [int(len(t) * rate) for _, t in self.items]
        found: dict[str, list[tuple[int, int]]] = {}
        for n, (_, text) in enumerate(self.items):
            for at, piece in pieces(text, rate) if text else ():
                found.setdefault(piece, []).append((n, at))
        self.automaton = ahocorasick.Automaton()
        for piece, places in found.items():
            self.automaton.add_word(piece, (len(piece), places))
        if found:
            self.automaton.make_automaton()
        self.empty = not found

    def search(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item, edits, start, end) of the best match of every item that occurs: offsets in the text, end exclusive."""
        if not text or self.empty:
            return []
        text = folded(text)
        windows: dict[int, list[list[int]]] = {}
        for last, (size, places) in self.automaton.iter(text):
            for n, at in places:
                k = self.budgets[n]
                start = last - size + 1 - at
                low, high = max(0, start - k), start + len(self.items[n][1]) + k
                runs = windows.setdefault(n, [])
                if runs and low <= runs[-1][1] and high >= runs[-1][0]:
                    runs[-1] = [min(low, runs[-1][0]), max(high, runs[-1][1])]
                else:
                    runs.append([low, high])
        out = []
        for n, runs in windows.items():
            item, k = self.items[n][1], self.budgets[n]
            best = None
            for low, high in runs:
                at = text.find(item, low, high)
                hit = (0, at + len(item) - low) if at >= 0 else myers(item, text[low:high], k)
                if hit and (best is None or hit[0] < best[0]):
                    best = hit[0], low + hit[1], low
                    if not hit[0]:
                        break
            if best:
                edits, end, low = best
                back = myers(item[::-1], text[low:end][::-1], k)
                out.append((self.items[n][0], edits, end - back[1] if back else low, end))
        return sorted(out)


def blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of at most ``block_chars`` characters (or one item); null and blank items match nothing and go."""
    rows = benchmark.filter("length(trim(text)) > 0").select("item_id", "text").orderBy("item_id", "text")
    size, held = 0, []
    for row in rows.toLocalIterator():
        if held and size + len(row["text"]) > block_chars:
            yield held
            size, held = 0, []
        size += len(row["text"])
        held.append((row["item_id"], row["text"]))
    yield held


def with_matches(docs: DataFrame, items: list[tuple], hits: str, rate: float = ERROR_RATE, only: str = "all", kind: DataType | None = None) -> DataFrame:
    """``docs`` and a column ``hits``, an array of (item_id, edits, start, end); ``only``: ``hit`` or ``clean`` keeps such rows; ``kind`` is that of the item ids."""
    shared = docs.sparkSession.sparkContext.broadcast(items)  # at most BLOCK_CHARS characters
    kind = kind or LongType()
    hit = StructType().add("item_id", kind).add("edits", IntegerType()).add("start", IntegerType()).add("end", IntegerType())
    schema = StructType([*docs.schema.fields]).add(hits, ArrayType(hit))
    arrow = pa.list_(pa.struct([("item_id", to_arrow_type(kind)), ("edits", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(shared.value, rate)
        for batch in batches:
            found = [[dict(zip(("item_id", "edits", "start", "end"), h, strict=True)) for h in matcher.search(t)] for t in batch.column("text").to_pylist()]
            out = pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, arrow)], [*batch.schema.names, hits])
            yield out if only == "all" else out.filter(pa.array([bool(f) == (only == "hit") for f in found], pa.bool_()))

    return map_batches(docs, work, schema)


def contaminations(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``(doc_id, item_id, edits, start, end)``: every benchmark item that occurs in a document within ``rate`` edits a character, at its best place.

    Letters match either case and white space any white space. Null and
    empty texts and items match nothing; repeated rows give repeated results,
    rows with a null id too; items with one text each give a row; ids are of
    any type; texts of any length are searched whole, in one pass of the
    automaton and about each hit; an empty table gives none. Other columns are
    not read.
    """
    out = None
    for items in blocks(benchmark, block_chars):
        found = with_matches(docs.select("doc_id", "text"), items, "hits", rate, "hit", benchmark.schema["item_id"].dataType)
        rows = found.select("doc_id", F.explode("hits").alias("h")).select("doc_id", "h.*")
        out = rows if out is None else out.unionByName(rows)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents in which no item occurs, null and empty ones and every one of repeated rows included; columns stay as they are."""
    hits = f"{free_prefix(docs)}hits"
    for items in blocks(benchmark, block_chars):
        docs = with_matches(docs, items, hits, rate, "clean", benchmark.schema["item_id"].dataType).drop(hits)
    return docs


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
