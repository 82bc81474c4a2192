"""Benchmark decontamination with a BM25 index and block-max WAND.

The items of a benchmark are an inverted index in blocks of ``BLOCK`` items with the
greatest score of each term per block.  Scores are BM25 over the item's own score, so 1 is
an item with all its words.  Every window of a training text is a query.  The pivot test,
whether the block maxima of its terms reach the threshold, is made for all windows of a
batch at once, with the terms of low weight left to a fixed slack (their lists alone never
reach the threshold).  Only the postings of blocks that pass are read and scored, and what
reaches the threshold is verified: the item's whole question and its whole answer must both
overlap with the window in word 3-grams.

Windows are twice as long as the longest item.  Items of more than ``ITEM_WORDS`` words are
kept whole in indexes of their own, one per doubling of the length, with longer windows.
"""

from __future__ import annotations

import math
import pickle
import re
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.lineage import lineage_dir, materialize
from weftgraph.llm.common import free_name

K1, B = 1.2, 0.75
BLOCK = 4
THRESHOLD = 0.6
OVERLAP = 0.6
GRAM = 3
#: What the terms left out of the pivot test may add to any item.
SLACK = 0.2
#: Items of up to so many words share one length of windows, those of up to twice as many the next.
ITEM_WORDS = 256
#: Items of one index; a larger benchmark becomes several indexes with the same statistics.
INDEX_ITEMS = 4096
#: Words that are tested together, and letters of a text that are split at once.
BATCH_WORDS, PIECE = 200_000, 1 << 20

HITS = ("array<struct<item_id: bigint, score: double, question_overlap: double, answer_overlap: double, "
        "first_word: bigint>>")
_words = re.compile(r"[^\W_]+").findall


def split_item(text: str) -> tuple[list[str], list[str]]:
    """Question and answer words: the last sentence answers; of a single sentence the last third."""
    parts = [w for w in (_words(s.lower()) for s in re.split(r"(?<=[.?!])\s+|\n", text)) if w]
    if not parts:
        return [], []
    if len(parts) > 1:
        return [w for p in parts[:-1] for w in p], parts[-1]
    cut = max(1, len(parts[0]) - max(1, len(parts[0]) // 3))
    return parts[0][:cut], parts[0][cut:]


def grams(words: Sequence[str]) -> set:
    n = min(GRAM, len(words))
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)} if n else set()


def overlap(mine: Sequence[str], window: Sequence[str], window_grams: set) -> float:
    """Share of the n-grams of some words that a window has; 1 for no words."""
    if not mine:
        return 1.0
    if len(mine) < GRAM:
        have = {tuple(window[i:i + len(mine)]) for i in range(len(window))}
        return float(tuple(mine) in have)
    own = grams(mine)
    return len(own & window_grams) / len(own)


def level_of(n_words: int) -> int:
    """0 for up to ``ITEM_WORDS`` words, one more for every doubling."""
    return ((n_words - 1) // ITEM_WORDS).bit_length()


@dataclass(frozen=True)
class Statistics:
    """Of all items: number, mean number of words, items that have a word, longest item by level."""

    n: int
    mean: float
    df: dict[str, int]
    longest: dict[int, int]

    @classmethod
    def of(cls, texts: Sequence[Sequence[str]]) -> "Statistics":
        longest: dict[int, int] = {}
        for k in map(len, texts):
            longest[level_of(k)] = max(longest.get(level_of(k), 0), k)
        return cls(len(texts), sum(map(len, texts)) / max(1, len(texts)), Counter(w for t in texts for w in set(t)), longest)


class BlockMaxIndex:
    """BM25 postings of the items of one level in blocks, with block maxima; ``longer`` is
    the index of the items above the level."""

    def __init__(self, items: Sequence[tuple[int, str]], block: int = BLOCK, threshold: float = THRESHOLD,
                 slack: float = SLACK, known: Statistics | None = None, level: int = 0):
        split = [(x, *split_item(x[1] or "")) for x in items]
        split = [(x, q, a, level_of(len(q) + len(a))) for x, q, a in split if q or a]
        known = known or Statistics.of([q + a for _, q, a, _ in split])
        self.items = [(x[0], q, a) for x, q, a, at in split if at == level]
        above = [(x, at) for x, _, _, at in split if at > level]
        self.longer = BlockMaxIndex([x for x, _ in above], block, threshold, slack, known,
                                    min(at for _, at in above)) if above else None
        texts = [q + a for _, q, a in self.items]
        n, self.threshold, self.block = len(texts), threshold, block
        self.chunk = known.longest.get(level, 1)
        df = {w: known.df[w] for w in {w for t in texts for w in t}}
        idf = {w: math.log(1 + (known.n - d + 0.5) / (d + 0.5)) for w, d in df.items()}
        self.terms = {w: i for i, w in enumerate(sorted(df))}
        postings: dict[str, list[tuple[int, float]]] = {w: [] for w in df}
        for i, t in enumerate(texts):
            own = {w: idf[w] * f * (K1 + 1) / (f + K1 * (1 - B + B * len(t) / known.mean)) for w, f in Counter(t).items()}
            total = sum(own.values())
            for w, v in own.items():
                postings[w].append((i, v / total))
        # lists outside the pivot test: the most frequent terms, as far as the slack allows
        rest, outside = np.zeros(n), set()
        for w in sorted(df, key=lambda w: (-df[w], w)):
            more = rest.copy()
            for i, v in postings[w]:
                more[i] += v
            if more.max() > slack:
                break
            rest, _ = more, outside.add(w)
        self.slack = float(rest.max(initial=0.0))
        blocks: list[dict] = [{} for _ in range(-(-n // block))]
        starts, block_of, most = [0], [], []
        for w in sorted(df):
            top: dict[int, float] = {}
            for i, v in postings[w]:
                blocks[i // block].setdefault("rows", []).append((self.terms[w], i, v))
                top[i // block] = max(top.get(i // block, 0.0), v)
            if w not in outside:
                block_of += list(top)
                most += list(top.values())
            starts.append(len(block_of))
        starts.append(len(block_of))  # of words that no item has
        self.starts, self.block_of, self.most = np.array(starts), np.array(block_of, np.int64), np.array(most)
        self.postings = [tuple(np.array(c) for c in zip(*b["rows"])) for b in blocks]
        self.grams = [(grams(q), grams(a)) for _, q, a in self.items]

    def state(self) -> dict:
        """Plain values and arrays that ``of_state`` takes; files hold these and not the class."""
        return self.__dict__ | {"longer": self.longer and self.longer.state()}

    @classmethod
    def of_state(cls, state: dict) -> "BlockMaxIndex":
        index = cls.__new__(cls)
        index.__dict__.update(state | {"longer": state["longer"] and cls.of_state(state["longer"])})
        return index

    def passing_blocks(self, ids: np.ndarray, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pivot test: pairs of a window (its first chunk; the next one belongs to it) and a
        block whose maxima reach the threshold.  A term counts once per chunk."""
        wide = len(self.starts)
        seen = np.unique(chunks * wide + ids)
        at, term = seen // wide, seen % wide
        n = self.starts[term + 1] - self.starts[term]
        at = np.repeat(at, n)
        entry = np.repeat(self.starts[term] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
        blocks, most = self.block_of[entry], self.most[entry]
        n_blocks, last = len(self.postings), int(chunks[-1])
        key = np.concatenate([at * n_blocks + blocks, (at - 1) * n_blocks + blocks])
        low = n_blocks  # the window before the first chunk is none
        total = np.bincount(key + low, weights=np.concatenate([most, most]), minlength=(last + 2) * n_blocks)[low:]
        found = np.flatnonzero(total >= self.threshold - self.slack - 1e-9)
        return found // n_blocks, found % n_blocks

    def score(self, block: int, terms: np.ndarray) -> list[tuple[int, float]]:
        """Items of a block whose score for the given distinct terms reaches the threshold."""
        term, item, weight = self.postings[block]
        hit = np.isin(term, terms, assume_unique=False)
        first = block * self.block
        total = np.bincount(item[hit].astype(np.int64) - first, weights=weight[hit], minlength=self.block)
        return [(first + int(i), float(total[i])) for i in np.flatnonzero(total >= self.threshold - 1e-9)]

    def verify(self, item: int, window: Sequence[str], window_grams: set) -> tuple[float, float]:
        _, q, a = self.items[item]
        return overlap(q, window, window_grams), overlap(a, window, window_grams)

    def search(self, texts: Sequence[str | None], least: float = OVERLAP) -> list[list[tuple]]:
        """Per text the verified items, each with its best window."""
        return search_all([self], texts, least)

    def search_into(self, texts: Sequence[str | None], out: list[dict], least: float) -> None:
        index: BlockMaxIndex | None = self
        while index is not None:
            index._search_level(texts, out, least)
            index = index.longer

    def _search_level(self, texts: Sequence[str | None], out: list[dict], least: float) -> None:
        if not self.items:
            return
        held, n_words = [], 0
        for i, text in enumerate(texts):
            for first, words in self._pieces(text or ""):
                held.append((i, first, words))
                n_words += len(words)
                if n_words >= BATCH_WORDS:
                    self._search(held, out, least)
                    held, n_words = [], 0
        self._search(held, out, least)

    def _pieces(self, text: str) -> Iterator[tuple[int, list[str]]]:
        """A text's words; a long text in pieces that share a window."""
        first, carry, at, piece = 0, [], 0, max(PIECE, 8 * self.chunk)
        while at < len(text):
            end = at + piece
            while end < len(text) and (text[end].isalnum() or text[end - 1].isalnum()) and end < at + 2 * piece:
                end += 1
            words = carry + _words(text[at:end].lower())
            yield first, words
            carry = words[-2 * self.chunk:]
            first += len(words) - len(carry)
            at = end

    def _search(self, held: list, out: list[dict], least: float) -> None:
        held = [h for h in held if h[2]]
        if not held:
            return
        none, get = len(self.starts) - 2, self.terms.get
        ids = np.fromiter((get(w, none) for _, _, words in held for w in words), np.int64)
        sizes = np.array([len(h[2]) for h in held])
        n_chunks = -(-sizes // self.chunk) + 1  # one empty chunk between two texts
        starts, base = np.append(0, np.cumsum(sizes)), np.append(0, np.cumsum(n_chunks))
        owner = np.repeat(np.arange(len(held)), sizes)
        chunks = base[owner] + (np.arange(len(ids)) - starts[owner]) // self.chunk
        windows, blocks = self.passing_blocks(ids, chunks)
        seen_window, terms, window, window_grams = -1, None, [], None
        for w, b in zip(windows.tolist(), blocks.tolist()):
            if w != seen_window:
                k = int(np.searchsorted(base, w, "right")) - 1
                i, first, words = held[k]
                at = (w - int(base[k])) * self.chunk
                window, window_grams, seen_window = words[at:at + 2 * self.chunk], None, w
                terms = np.unique(ids[starts[k] + at:starts[k] + min(len(words), at + 2 * self.chunk)])
            for item, score in self.score(b, terms):
                window_grams = grams_of_window(window) if window_grams is None else window_grams
                q, a = self.verify(item, window, window_grams)
                hit = (self.items[item][0], score, q, a, first + at)
                if q >= least and a >= least and (hit[0] not in out[i] or rank(out[i][hit[0]]) < rank(hit)):
                    out[i][hit[0]] = hit


def grams_of_window(words: Sequence[str]) -> set:
    return {tuple(words[i:i + GRAM]) for i in range(len(words) - GRAM + 1)}


def rank(hit: tuple) -> tuple:
    """Of an item's hits the greatest score counts, then the first window."""
    _, score, q, a, first = hit
    return score, -first, q, a


def search_all(indexes: Iterable[BlockMaxIndex], texts: Sequence[str | None], least: float = OVERLAP) -> list[list[tuple]]:
    """Per text the verified items of all indexes, each with its best window."""
    out: list[dict[int, tuple]] = [{} for _ in texts]
    for index in indexes:
        index.search_into(texts, out, least)
    return [[found[k] for k in sorted(found)] for found in out]


class StoredIndexes(Sequence):
    """Indexes in files of a folder that all executors share, one in memory at a time; a part
    without items has no file."""

    def __init__(self, folder: str, names: Sequence[str | None]):
        self.folder, self.names, self.held = folder, list(names), (None, None)

    def __len__(self) -> int:
        return len(self.names)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"held": (None, None)}

    def __getitem__(self, i: int) -> BlockMaxIndex:
        name = self.names[i]
        if name is None:
            return BlockMaxIndex([])
        if self.held[0] != name:
            self.held = (None, None)
            store, base = pafs.FileSystem.from_uri(self.folder)
            with store.open_input_file(f"{base}/{name}") as f:
                self.held = (name, BlockMaxIndex.of_state(pickle.loads(f.read())))
        return self.held[1]


def _split_items(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, text, copies, n, level, words``: items that differ, how often each is there, its
    number of words, its level and its distinct words; a null id is -1."""
    @F.pandas_udf("n bigint, level int, words array<string>")
    def split(texts: pd.Series) -> pd.DataFrame:
        own = [q + a for q, a in map(split_item, texts)]
        return pd.DataFrame({"n": [len(t) for t in own], "level": [level_of(len(t)) for t in own],
                             "words": [sorted(set(t)) for t in own]})

    given = benchmark.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-1)).alias("id"),
                             F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    items = given.groupBy("id", "text").agg(F.count(F.lit(1)).alias("copies")).withColumn("_s", split("text"))
    return items.select("id", "text", "copies", "_s.n", "_s.level", "_s.words")


def build_indexes(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text",
                  index_items: int | None = None) -> StoredIndexes:
    """Indexes of about ``index_items`` items each, all with the statistics of the whole
    benchmark: the number of indexes changes no hit and no score.

    Tasks build and write the indexes; the driver has their names, the number of items and of
    words, and the longest item of each level.
    """
    index_items = index_items or INDEX_ITEMS
    spark = benchmark.sparkSession
    items = materialize(_split_items(benchmark, id_col, text_col), "bm25-items")
    by_level = items.groupBy(F.when(F.col("n") > 0, F.col("level")).alias("level")).agg(
        F.sum("copies").alias("copies"), F.sum(F.col("copies") * F.col("n")).alias("n"), F.max("n").alias("longest")).collect()
    there = [r for r in by_level if r["level"] is not None]
    n, n_words = sum(r["copies"] for r in there), sum(r["n"] for r in there)
    mean, longest = n_words / max(1, n), {r["level"]: r["longest"] for r in there}
    parts = max(-(-sum(r["copies"] for r in by_level) // index_items), -(-n_words // (index_items * ITEM_WORDS)))
    folder, names = f"{lineage_dir(spark)}/bm25-{uuid.uuid4().hex}", [None] * parts
    if n:
        items = items.where("n > 0").withColumn("part", F.pmod(F.xxhash64("id", "text"), F.lit(parts)).cast("int"))
        df = (items.select("part", "copies", F.explode("words").alias("word")).groupBy("word")
              .agg(F.sum("copies").alias("df"), F.collect_set("part").alias("parts"))
              .select(F.explode("parts").alias("part"), "word", "df"))

        def write(rows: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
            known = Statistics(n, mean, dict(zip(counts["word"], counts["df"].tolist())), longest)
            index = BlockMaxIndex(sorted(zip(rows["id"].tolist(), rows["text"])), known=known)
            store, base = pafs.FileSystem.from_uri(folder)
            store.create_dir(base, recursive=True)
            name = uuid.uuid4().hex
            with store.open_output_stream(f"{base}/{name}") as f:
                f.write(pickle.dumps(index.state(), pickle.HIGHEST_PROTOCOL))
            return pd.DataFrame({"part": [int(rows["part"].iloc[0])], "name": [name]})

        # the written table names the files of the tasks that succeeded
        written = materialize(items.select("part", "id", "text").groupBy("part").cogroup(df.groupBy("part"))
                              .applyInPandas(write, "part int, name string"), "bm25-indexes")
        for r in written.collect():
            names[r["part"]] = r["name"]
    return StoredIndexes(folder, names)


def hits_of(indexes: Sequence[BlockMaxIndex], text: Column) -> Column:
    """Verified items of a text as an array."""
    @F.pandas_udf(HITS)
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        keys = ("item_id", "score", "question_overlap", "answer_overlap", "first_word")
        order = range(len(indexes))
        for s in batches:
            found = search_all((indexes[i] for i in order), list(s))
            order = order[::-1]  # the index in memory is the next one to be asked
            yield pd.Series([[dict(zip(keys, hit)) for hit in hits] for hits in found], dtype=object)

    return search(text.cast("string"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> tuple[DataFrame, str]:
    """All rows of ``docs`` with the benchmark items found in them, and that column's name.

    Null and empty texts have none, null or empty items are found nowhere, a null item id
    counts as -1, repeated rows are each reported, of items with the same id the best one.
    Texts are read as a whole.
    """
    name, = free_name(docs, "_hits")
    return docs.withColumn(name, hits_of(build_indexes(benchmark), F.col(text_col))), name


def leak_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, score, question_overlap, answer_overlap, first_word`` per document and item found in it."""
    found, name = find_leaks(docs.select("doc_id", "text"), benchmark)
    return found.select("doc_id", F.explode(name).alias("hit")).select("doc_id", "hit.*")


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents without any benchmark item, columns as given."""
    found, name = find_leaks(docs, benchmark)
    return found.where(F.size(name) == 0).select(*docs.columns)
