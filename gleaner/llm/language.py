"""Language identification by nearest centroids (operator 7).

Texts become normalised TF-IDF vectors of hashed character two- and three-grams; each
language has a few centroids, clustered from its training texts; a text gets the language
of the centroid with the largest cosine. A text is rejected if its cosine is far below those of
pieces of the language's training texts; cosines of texts with few distinct grams are lower,
so the floor is for a language and a number of distinct grams.

The model is fit on a bounded sample: ``PER_LANGUAGE`` texts of each language at most,
those with the smallest hash of id and text. Each language's centroids and floors are found in a task of their
own; the driver gets these and a number for each hashed gram. Prediction reads every whole text, in pieces of
bounded size, and needs no shuffle.

Defined results: a text that is null or has no letter is ``und`` with score 0, and rejected;
so is every text if there is nothing to learn from; ties between languages go to the first
by code point; rows with a null language are not learned from; repeated rows give
repeated results; extra columns are ignored; a null id counts as an empty one in folds.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import Cuts, give_back, kind_of, lean, small_batches

#: Texts of each language in the training sample at most.
PER_LANGUAGE = 256
#: Languages that a model can tell apart; more are an error, not dropped.
MOST_LANGUAGES = 1024
CENTROIDS, ROUNDS, DIMENSIONS = 4, 8, 1 << 13
#: Words of the pieces of training texts that a language's floors come from.
PIECES = (1, 2, 4, 8, 16, 32, 128)
#: A text is rejected below this part of this quantile of the cosines of pieces of its length.
MARGIN, QUANTILE = 0.4, 0.1
#: A language with fewer training texts, too few for a quantile, has this part of their least cosine as its floor.
FEW, TOLERANCE = 50, 0.25
#: Characters that are counted at once.
PIECE = 1 << 20

LETTER = regex.compile(r"\p{L}")
_letters: list[np.ndarray] = []


def _table() -> np.ndarray:
    """Per code point a number for a letter, 0 for anything else."""
    if not _letters:
        is_letter = np.frombuffer(bytes(chr(c).isalpha() for c in range(0x110000)), np.uint8)
        _letters.append(np.where(is_letter, np.arange(0x110000) + 1, 0).astype(np.uint32))
    return _letters[0]


def grams(text: str) -> np.ndarray:
    """Counts of hashed two- and three-grams; whatever is no letter is one gap."""
    out = np.zeros(DIMENSIONS, np.int64)
    table, carry = _table(), np.zeros(1, np.uint32)
    lowered = text.lower()
    for at in range(0, len(lowered) + 1, PIECE):
        codes = table[np.frombuffer(lowered[at : at + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)]
        if at + PIECE > len(lowered):
            codes = np.append(codes, np.uint32(0))
        codes = np.concatenate([carry, codes])
        codes = codes[np.append(True, (codes[1:] != 0) | (codes[:-1] != 0))].astype(np.uint64)
        if len(codes) >= 3:
            mixed = codes[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ codes[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)
            # a gap in the middle joins two words; its gram tells nothing of either
            three = ((mixed ^ codes[2:] * np.uint64(0x165667B19E3779F9)) * np.uint64(0xFF51AFD7ED558CCD) >> np.uint64(51))[codes[1:-1] != 0]
            two = mixed * np.uint64(0xFF51AFD7ED558CCD) >> np.uint64(51)
            out += np.bincount(three.astype(np.int64), minlength=DIMENSIONS)
            out += np.bincount(two.astype(np.int64), minlength=DIMENSIONS)
        carry = codes[-2:].astype(np.uint32)
    return out


def piece(text: str, words: int) -> str | None:
    """So many words in a row, from a place that the text's hash gives; None if there are fewer, or no letter in them."""
    all_ = text.split()
    if len(all_) < words:
        return None
    at = zlib.crc32(text.encode("utf-8", "surrogatepass")) % (len(all_) - words + 1)
    part = " ".join(all_[at : at + words])
    return part if LETTER.search(part) else None


@dataclass
class Model:
    idf: np.ndarray
    languages: list[str]
    centroids: np.ndarray
    owner: np.ndarray
    #: Per language: lengths (logs of numbers of distinct grams), ascending, and the floor at each.
    floors: list[tuple[np.ndarray, np.ndarray]]

    def weighted(self, logs: np.ndarray) -> np.ndarray:
        """Logs of counts, in place -> unit vectors."""
        logs *= self.idf
        norm = np.linalg.norm(logs, axis=1, keepdims=True)
        logs /= np.where(norm > 0, norm, 1)
        return logs

    def cosines(self, counts: np.ndarray) -> np.ndarray:
        """(n, languages): the largest cosine with any of a language's centroids."""
        near = self.weighted(np.log1p(counts).astype(np.float32)) @ self.centroids.T
        return np.stack([near[:, self.owner == k].max(1) for k in range(len(self.languages))], 1)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        out: list[tuple[str, float, bool]] = [("und", 0.0, True)] * len(texts)
        told = [i for i, t in enumerate(texts) if t and LETTER.search(t)] if self.languages else []
        for at in range(0, len(told), 128):
            part = told[at : at + 128]
            counts = np.stack([grams(texts[i]) for i in part])
            near = self.cosines(counts)
            best = near.argmax(1)
            for i, k, row, n in zip(part, best, near, (counts > 0).sum(1), strict=True):
                score = float(min(max(row[k], 0.0), 1.0))
                lengths, floors = self.floors[k]
                out[i] = (self.languages[k], score, score < float(np.interp(np.log1p(n), lengths, floors)))
        return out


def _clustered(x: np.ndarray, k: int) -> np.ndarray:
    """Centroids by cosine, from starts that are far from each other."""
    k = min(k, len(x))
    starts = [0]
    for _ in range(k - 1):
        starts.append(int((x @ x[starts].T).max(1).argmin()))
    centers = x[starts]
    for _ in range(ROUNDS):
        own = (x @ centers.T).argmax(1)
        sums = np.stack([x[own == j].sum(0) if (own == j).any() else centers[j] for j in range(k)])
        centers = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centers


def training_sample(docs: DataFrame, held_out: Column, key: str, lang: str, text: str) -> DataFrame:
    """(lang, place, text): of each language's labelled texts those with the smallest hashes, ``PER_LANGUAGE`` at most.

    Rows that are equal in id and text count once.
    """
    usable = docs.where(~held_out & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    said = F.xxhash64(F.lit("language"), F.col(key), F.col(text))
    counts = usable.groupBy(lang).agg(F.approx_count_distinct(said)).limit(MOST_LANGUAGES + 1).collect()
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not counts:
        return usable.select(F.col(lang).alias("lang"), F.lit(0.0).alias("place"), F.col(text).alias("text")).limit(0)
    # twice as many as wanted, in the mean, leave enough after an estimate that is off
    share = F.create_map(*(x for r in counts for x in (F.lit(r[0]), F.lit(min(1.0, 2 * PER_LANGUAGE / max(r[1], 1))))))
    place = F.pmod(said, F.lit(1 << 30)) / float(1 << 30)
    some = usable.where(place < share[F.col(lang)]).select(F.col(lang).alias("lang"), place.alias("place"), F.col(text).alias("text"))
    once = some.groupBy("lang", "place").agg(F.min("text").alias("text"))
    return once.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("place"))).where(F.col("nth") <= PER_LANGUAGE).drop("nth")


def _counted(batches):
    """(lang, place, text) -> (lang, place, words, grams, logs of their counts) of each text (0 words) and its pieces."""
    for batch in batches:
        row, words, at, n = [], [], [], []
        for r, t in enumerate(batch.column(2).to_pylist()):
            for w in (0, *PIECES):
                part = piece(t, w) if w else t
                if part is None:
                    continue
                counts = grams(part)
                i = np.flatnonzero(counts)
                row.append(r)
                words.append(w)
                at.append(i.astype(np.int32))
                n.append(np.log1p(counts[i]).astype(np.float32))
        row = pa.array(row, pa.int32())
        yield pa.record_batch([batch.column(0).take(row), batch.column(1).take(row), pa.array(words, pa.int32()), pa.array(at, pa.list_(pa.int32())), pa.array(n, pa.list_(pa.float32()))], names=["lang", "place", "words", "at", "n"])


def _language(idf: np.ndarray, rows: pa.Table) -> pa.Table:
    """One language's rows of ``_counted`` -> (lang, centroids, lengths, floors)."""
    rows = rows.sort_by([("words", "ascending"), ("place", "ascending")]).combine_chunks()  # whatever order the tasks gave
    words, model = rows.column("words").to_numpy(), Model(idf, [], np.zeros((0, DIMENSIONS), np.float32), np.zeros(0, np.int64), [])
    lists = rows.column("at").combine_chunks()
    ends, at, n = lists.offsets.to_numpy(), lists.flatten().to_numpy(), rows.column("n").combine_chunks().flatten().to_numpy()

    def vectors(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unit vectors of these rows, and their numbers of distinct grams."""
        x = np.zeros((len(own), DIMENSIONS), np.float32)
        for i, r in enumerate(own):
            x[i, at[ends[r] : ends[r + 1]]] = n[ends[r] : ends[r + 1]]
        length = (x > 0).sum(1)
        return model.weighted(x), length

    x, _ = vectors(np.flatnonzero(words == 0))
    found = _clustered(x, CENTROIDS)
    lengths, floors = [], []
    for w in PIECES if len(x) >= FEW else ():
        y, length = vectors(np.flatnonzero(words == w))
        if len(y) >= FEW:
            lengths.append(float(np.log1p(np.median(length))))
            floors.append(MARGIN * float(np.quantile((y @ found.T).max(1), QUANTILE)))
    if not lengths:
        lengths, floors = [0.0], [TOLERANCE * float((x @ found.T).max(1).min())]
    return pa.table({"lang": rows.column("lang").slice(0, 1), "centroids": pa.array([found.ravel()], pa.list_(pa.float32())), "lengths": pa.array([lengths], pa.list_(pa.float64())), "floors": pa.array([floors], pa.list_(pa.float64()))})


def fit(docs: DataFrame, held_out: Column, key: str = "doc_id", lang: str = "lang", text: str = "text") -> Model:
    """A model from a bounded sample of the rows that are not held out; each language is fit in a task."""
    spark = docs.sparkSession
    small_batches(spark)
    cuts = Cuts(spark, "languages")
    rows = cuts.write(training_sample(docs, held_out, key, lang, text).mapInArrow(lean(_counted), "lang string, place double, words int, at array<int>, n array<float>"))
    texts = rows.where("words = 0")
    seen = np.zeros(DIMENSIONS)
    for r in texts.select(F.explode("at").alias("i")).groupBy("i").agg(F.count("*").alias("n")).collect():
        seen[r.i] = r.n
    idf = (np.log((1 + texts.count()) / (1 + seen)) + 1).astype(np.float32)
    told = spark.sparkContext.broadcast(idf)

    def run(own: pa.Table) -> pa.Table:
        out = _language(told.value, own)
        give_back()
        return out

    got = rows.groupBy("lang").applyInArrow(run, "lang string, centroids array<float>, lengths array<double>, floors array<double>").toArrow()
    cuts.drop(rows)
    model = Model(idf, [], np.zeros((0, DIMENSIONS), np.float32), np.zeros(0, np.int64), [])
    order = sorted(range(got.num_rows), key=lambda i: got.column("lang")[i].as_py())
    centers = []
    for k, i in enumerate(order):
        model.languages.append(got.column("lang")[i].as_py())
        centers.append(got.column("centroids")[i].values.to_numpy().reshape(-1, DIMENSIONS))
        model.floors.append((np.maximum.accumulate(got.column("lengths")[i].as_py()), np.maximum.accumulate(got.column("floors")[i].as_py())))
        model.owner = np.append(model.owner, [k] * len(centers[-1]))
    if centers:
        model.centroids = np.concatenate(centers)
    del got, centers
    give_back()
    return model


def fold(key: str = "doc_id") -> Column:
    """True for the held-out third: crc32 of the id as text, modulo 3, is 1."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def identified(docs: DataFrame, key: str = "doc_id", lang: str = "lang", text: str = "text") -> DataFrame:
    """Per row: key, ``held_out``, ``lang_pred``, ``score``, ``rejected``."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(fit(docs, fold(key), key, lang, text))
    small_batches(spark)

    def run(batches):
        for batch in batches:
            got = model.value.predict(batch.column(2).to_pylist())
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.bool_())], names=[key, "held_out", "lang_pred", "score", "rejected"])

    rows = docs.select(key, fold(key).alias("held_out"), text)
    return rows.mapInArrow(lean(run), f"`{key}` {kind_of(docs, key)}, held_out boolean, lang_pred string, score double, rejected boolean")


def recognised(docs: DataFrame, key: str = "doc_id", lang: str = "lang", text: str = "text") -> DataFrame:
    """``docs`` without the rows that are rejected; the columns stay as they are."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, fold(key), key, lang, text))
    small_batches(docs.sparkSession)
    at = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            got = model.value.predict(batch.column(at).to_pylist())
            yield batch.filter(pa.array([not g[2] for g in got], pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)
