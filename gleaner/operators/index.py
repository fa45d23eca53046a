"""The index of a feature space: vocabulary (fid, ftype, fname, df) and vectors (pmid, date_key, features)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.operators import blocks, dense, order
from gleaner.session import Cuts


def document_frequency(long: DataFrame) -> DataFrame:
    """(ftype, fname, df): documents per feature; ``long`` is distinct per document."""
    return long.groupBy("ftype", "fname").agg(F.count("*").alias("df"))


def numbered(names: DataFrame, first: int = 1, cuts: Cuts | None = None) -> DataFrame:
    """Adds ``fid``: dense from ``first`` in the order of type and name, numbered by range."""
    return order.numbered(names, ["ftype", "fname"], "fid", first, cuts)


def vocabulary(long: DataFrame) -> DataFrame:
    """fid from 1, ftype, fname, df. Id 0 stays free."""
    return numbered(document_frequency(long)).select("fid", "ftype", "fname", "df")


def grown(vocab: DataFrame, long: DataFrame, grow: bool = True) -> DataFrame:
    """The vocabulary after more documents: known features count on, new ones get the next ids if ``grow``."""
    delta = document_frequency(long).withColumnRenamed("df", "more")
    known = vocab.join(delta, ["ftype", "fname"], "left").select("fid", "ftype", "fname", (F.col("df") + F.coalesce("more", F.lit(0))).alias("df"))
    if not grow:
        return known
    top = vocab.agg(F.coalesce(F.max("fid"), F.lit(0)).alias("top"))
    new = numbered(delta.join(vocab, ["ftype", "fname"], "left_anti")).crossJoin(F.broadcast(top))
    return known.unionByName(new.select((F.col("fid") + F.col("top")).alias("fid"), "ftype", "fname", F.col("more").alias("df")))


def removed(vocab: DataFrame, vectors: DataFrame) -> DataFrame:
    """The vocabulary without some documents' counts; features stay at zero."""
    delta = vectors.select(F.explode("features").alias("fid")).groupBy("fid").agg(F.count("*").alias("less"))
    return vocab.join(delta, "fid", "left").select("fid", "ftype", "fname", (F.col("df") - F.coalesce("less", F.lit(0))).alias("df"))


def vectors(articles: DataFrame, long: DataFrame, vocab: DataFrame) -> DataFrame:
    """(pmid, date_key, features): sorted ids; unknown names are dropped, an article without features has an empty vector.

    ``articles`` has pmid and date_key.
    """
    ids = long.join(vocab.select("fid", "ftype", "fname"), ["ftype", "fname"]).select("pmid", "fid")
    # dealt by document first: sets are not built twice, nor sorted over a whole file's part
    sets = ids.repartition("pmid").groupBy("pmid").agg(F.array_sort(F.collect_set("fid")).alias("features"))
    return articles.select("pmid", "date_key").join(sets, "pmid", "left").withColumn("features", F.coalesce("features", F.array().cast("array<int>")))


def named_sets(articles: DataFrame, sets: DataFrame) -> DataFrame:
    """(pmid, date_key, names): articles with their distinct features as one array of (ftype, fname); null if there are none."""
    return articles.select("pmid", "date_key").join(sets.select("pmid", "names"), "pmid", "left")


def long_of(sets: DataFrame) -> DataFrame:
    """(pmid, ftype, fname) of sets of names."""
    return sets.select("pmid", F.explode("names").alias("f")).select("pmid", "f.ftype", "f.fname")


def vectors_of_sets(sets: DataFrame, vocab: DataFrame) -> DataFrame:
    """``vectors`` of articles that carry their names (``named_sets``): where the vocabulary is small enough, each stays where it is; else by blocks."""
    if (known := dense.names(vocab)) is not None:
        return dense.numbered(sets, known)
    return blocks.numbered(sets, vocab)


def type_mask(types: Sequence[str]) -> Column:
    return F.col("ftype").isin(list(types)) if types else F.lit(False)


def feature_names(vocab: DataFrame, ids: DataFrame) -> DataFrame:
    """fid -> type and name; an unknown id has null names (``strict`` callers check)."""
    return ids.join(vocab.select("fid", "ftype", "fname"), "fid", "left")


def vacuum_map(vocab: DataFrame, mincount: int) -> DataFrame:
    """(old, new): the kept features numbered densely from 0 in id order, dropped ones -1."""
    kept = order.numbered(vocab.where(F.col("df") >= mincount).select("fid"), ["fid"], "new", 0)
    return vocab.select(F.col("fid").alias("old")).join(kept.select(F.col("fid").alias("old"), "new"), "old", "left").withColumn("new", F.coalesce("new", F.lit(-1)))


def vacuum_vocabulary(vocab: DataFrame, mapping: DataFrame) -> DataFrame:
    kept = mapping.where("new >= 0").withColumnRenamed("old", "fid")
    return vocab.join(kept, "fid").select(F.col("new").alias("fid"), "ftype", "fname", "df")


def vacuum_vectors(docs: DataFrame, mapping: DataFrame) -> DataFrame:
    """The vectors in new ids; documents that lose all features keep an empty vector."""
    kept = mapping.where("new >= 0").withColumnRenamed("old", "fid")
    ids = docs.select("pmid", F.explode("features").alias("fid")).join(kept, "fid").groupBy("pmid").agg(F.array_sort(F.collect_list("new")).alias("kept"))
    return docs.select("pmid", "date_key").join(ids, "pmid", "left").select("pmid", "date_key", F.coalesce("kept", F.array().cast("array<int>")).alias("features"))


def added(docs: DataFrame, vocab: DataFrame, articles: DataFrame, long: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vectors, vocabulary) after adding the articles that are not indexed yet."""
    fresh = articles.join(docs.select("pmid"), "pmid", "left_anti")
    fresh_long = long.join(fresh.select("pmid"), "pmid", "left_semi")
    bigger = grown(vocab, fresh_long)
    return docs.unionByName(vectors(fresh, fresh_long, bigger)), bigger


def added_sets(docs: DataFrame, vocab: DataFrame, sets: DataFrame, cuts: Cuts) -> tuple[DataFrame, DataFrame]:
    """``added`` of articles that carry their names."""
    fresh = cuts.write(sets.join(docs.select("pmid"), "pmid", "left_anti"))
    bigger = cuts.write(grown(vocab, long_of(fresh)))
    return docs.unionByName(vectors_of_sets(fresh, bigger)), bigger


def replaced(docs: DataFrame, changes: DataFrame) -> DataFrame:
    """Vectors with some documents' rows replaced."""
    return docs.join(changes.select("pmid"), "pmid", "left_anti").unionByName(changes)


def deleted(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of a store, articles or vectors, without those of some keys; unknown keys are ignored."""
    return rows.join(ids.select("pmid"), "pmid", "left_anti")


def insertable(docs: DataFrame, new: DataFrame) -> DataFrame:
    """``new``, or an error if a key is there already or twice."""
    taken = new.groupBy("pmid").agg(F.count("*").alias("n")).join(docs.select("pmid", F.lit(1).alias("there")), "pmid", "left")
    bad = taken.where("n > 1 or there = 1").limit(5).collect()
    if bad:
        raise ValueError(f"keys that are not unique: {[r.pmid for r in bad]}")
    return new
