"""Language identification by rank-order profiles.

A profile is the list of the most frequent letter n-grams (1 to 3 letters, words padded
with a blank), most frequent first.  The distance of a document to a language is the sum,
over the document's profile, of how far each n-gram is out of its place in the language's
profile; an n-gram that the language lacks counts ``TOP`` places.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm.common import free_name, unit_hash

TOP = 400
#: The profiles are fitted on about this many labelled documents of each language.
FIT_DOCS = 4000
#: Bound on the number of languages; more is an error, never a cut.
MAX_LANGUAGES = 4096
SEED = 1994
#: A language is told where the score is this share of what all but ``TAIL`` of the training
#: documents reach.
SHARE, TAIL = 0.5, 0.01
PIECE = 1 << 18
UND = "und"
#: Codes of a language that a task counts before it hands them on.
HELD = 1 << 20


def letter_table() -> np.ndarray:
    """For every code point, whether it is a letter."""
    return np.char.isalpha(np.arange(0x110000, dtype=np.uint32).view("<U1"))


def _merge(parts: Sequence[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if len(parts) == 1:
        return parts[0]
    codes, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return codes, np.bincount(at, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)


def gram_counts(text: str, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all letter n-grams of a text and their counts.

    Upper case counts as lower case and every run of other characters as one blank.
    Code points take 21 bits each.  Texts are read in pieces, so that the working memory
    does not grow with the text.
    """
    parts, carry = [], np.full(1, 32, dtype=np.int64)
    for start in range(0, len(text), PIECE):
        piece = text[start:start + PIECE].lower().encode("utf-32-le", "surrogatepass")
        c = np.frombuffer(piece, dtype=np.uint32).astype(np.int64)
        c = np.where(letters[c], c, 32)
        if start + PIECE >= len(text):
            c = np.append(c, 32)
        c = np.concatenate([carry, c])
        blank = c == 32
        c = c[~(blank & np.append(False, blank[:-1]))]
        fresh = len(carry)
        one = c[fresh:]
        two = (c[:-1] << 21 | c[1:])[max(0, fresh - 1):]
        three = (c[:-2] << 42 | c[1:-1] << 21 | c[2:])[max(0, fresh - 2):]
        parts.append(np.unique(np.concatenate([one[one != 32], two, three]), return_counts=True))
        carry = c[-2:]
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    codes, counts = _merge(parts)
    if not (codes < 1 << 21).any():  # no letter
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return codes, counts


def ranked(codes: np.ndarray, counts: np.ndarray, top: int = TOP) -> np.ndarray:
    """The most frequent codes, ties by code."""
    return codes[np.lexsort((codes, -counts))[:top]]


@dataclass(frozen=True)
class Profiles:
    """Profiles of all languages: each known code's place in each language."""

    languages: tuple[str, ...]
    codes: np.ndarray
    places: np.ndarray  # (codes + 1) x languages, the last row for unknown codes; -1: not there
    top: int

    @classmethod
    def of(cls, by_language: dict[str, np.ndarray], top: int = TOP) -> "Profiles":
        languages = tuple(sorted(by_language))
        codes = np.unique(np.concatenate([np.empty(0, np.int64), *by_language.values()]))
        places = np.full((len(codes) + 1, len(languages)), -1, dtype=np.int32)
        for j, name in enumerate(languages):
            places[np.searchsorted(codes, by_language[name]), j] = np.arange(len(by_language[name]))
        return cls(languages, codes, places, top)

    def predict(self, text: str | None, letters: np.ndarray) -> tuple[str, float]:
        """Nearest language and 1 minus its share of the greatest possible distance."""
        mine = ranked(*gram_counts(text or "", letters), self.top)
        if not len(mine) or not self.languages:
            return UND, 0.0
        at = np.searchsorted(self.codes, mine)
        known = self.codes[np.minimum(at, len(self.codes) - 1)] == mine
        places = self.places[np.where(known, at, len(self.codes))]
        out = np.abs(places - np.arange(len(mine))[:, None])
        distance = np.where(places < 0, self.top, out).sum(axis=0)
        best = int(distance.argmin())
        return self.languages[best], float(1.0 - distance[best] / (self.top * len(mine)))


def training_part(doc_id: Column) -> Column:
    """Whether a document may be learned from: crc32 of its id as text is no multiple of 5."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 != 0, F.lit(False))


def training_sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                    fit_docs: int | None = FIT_DOCS, seed: int = SEED) -> DataFrame | None:
    """``lang, text`` of about ``fit_docs`` labelled training documents of each language, of all
    where that is None."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"),
                       F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where(training_part(F.col("id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not counts:
        return None
    if fit_docs is None:
        return rows.select("lang", "text")
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, fit_docs / r["n"]))])
    return rows.where(unit_hash(F.lit(seed), F.col("id")) / F.lit(2.0 ** 63) < share[F.col("lang")]).select("lang", "text")


def fit_profiles(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                 top: int = TOP, fit_docs: int | None = FIT_DOCS, seed: int = SEED) -> Profiles:
    """Profiles from about ``fit_docs`` labelled training documents of each language.

    The sample is drawn by a seeded hash of the id; where a language has fewer documents, or
    ``fit_docs`` is None, all are used.  Null labels, null texts and held-out documents are not used.
    """
    sample = training_sample(docs, id_col, text_col, lang_col, fit_docs, seed)
    if sample is None:
        return Profiles.of({}, top)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        letters, held = letter_table(), {}

        def rows_of(lang):
            codes, n = _merge(held.pop(lang))
            return pd.DataFrame({"lang": lang, "code": codes, "n": n})

        for b in batches:
            for lang, texts in b.groupby("lang")["text"]:
                new = [gram_counts(t, letters) for t in texts]
                held[lang] = [_merge([*held.get(lang, []), *new])]
                if len(held[lang][0][0]) > HELD:
                    yield rows_of(lang)
        for lang in list(held):
            yield rows_of(lang)

    grams = (sample.mapInPandas(count, "lang string, code bigint, n bigint")
             .groupBy("lang", "code").agg(F.sum("n").alias("n")))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    best = grams.withColumn("place", place).where(F.col("place") <= top).select("lang", "place", "code")
    by_language: dict[str, list] = {}
    for r in best.collect():  # at most `top` rows of at most MAX_LANGUAGES languages
        by_language.setdefault(r["lang"], []).append((r["place"], r["code"]))
    return Profiles.of({k: np.array([c for _, c in sorted(v)], dtype=np.int64) for k, v in by_language.items()}, top)


def identify(docs: DataFrame, profiles: Profiles, text_col: str = "text",
             names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """All rows and columns of ``docs`` with the predicted language and its score.

    ``und`` with score 0 where the text is null, empty or has no letter, or where no
    language was learned.  Equal distances go to the language first by name.
    """
    @F.arrow_udf("lang string, score double")
    def predict(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        letters = letter_table()
        for batch in texts:  # one text at a time becomes a Python value
            lang, score = zip(*(profiles.predict(t.as_py(), letters) for t in batch)) if len(batch) else ((), ())
            yield pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["lang", "score"])

    out, = free_name(docs, "_lang")
    return (docs.withColumn(out, predict(F.col(text_col).cast("string")))
            .withColumns({names[0]: F.col(f"{out}.lang"), names[1]: F.col(f"{out}.score")}).drop(out))


def language_report(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every document; a null id is held out."""
    found = identify(docs.select("doc_id", "text"), fit_profiles(docs))
    return found.select("doc_id", (~training_part(F.col("doc_id"))).alias("held_out"), "lang_pred", "score")


def least_score(docs: DataFrame, profiles: Profiles, share: float = SHARE, tail: float = TAIL) -> float:
    """The score from which a language is told, learned from all labelled training documents.

    Documents without a letter are not learned from; 0 where there is nothing to learn from.
    """
    rows = training_sample(docs, fit_docs=None)
    if rows is None:
        return 0.0
    scores = identify(rows, profiles).where(F.col("lang_pred") != UND)
    low = scores.agg(F.percentile_approx("score", tail, 10_000)).first()[0]
    return share * (low or 0.0)


def keep_identified(docs: DataFrame, profiles: Profiles, least: float = 0.0) -> DataFrame:
    """Documents whose language is known with a score above 0 and of at least ``least``; a
    score of 0 means that no profile has any n-gram of the text.

    A null text, one without letters and all texts where nothing was learned go; repeated rows
    stay or go together; an empty table gives an empty result.
    """
    lang, score = free_name(docs, "lang_pred", "score")
    found = identify(docs, profiles, names=(lang, score))
    return found.where((F.col(lang) != UND) & (F.col(score) > 0) & (F.col(score) >= least)).select(*docs.columns)
