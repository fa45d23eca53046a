"""Sentence-level co-occurrence of drugs and genes in texts."""

from __future__ import annotations

import re
import uuid
from array import array
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.arrays import placed
from gleaner.functions.text import sentences
from gleaner.operators.order import numbered
from gleaner.session import small_batches

#: Score from which a gene span is kept in a store of spans, and above which it counts.
KEPT_SCORE, GENE_SCORE = 0.1, 0.85


def _words(drugs: DataFrame) -> DataFrame:
    r"""The drugs with ``_kept``: aliases in lower case, anything but letters as one gap, in their order.

    An alias of three characters or less is dropped, where a gap counts as the three of ``\s+`` do.
    """
    low = F.transform("aliases", lambda a: F.trim(F.regexp_replace(F.lower(a), "[^a-z]+", " ")))
    kept = F.filter(F.array_distinct(low), lambda a: F.length(F.replace(a, F.lit(" "), F.lit(r"\s+"))) > 3)
    return drugs.withColumn("_kept", kept).where(F.size("_kept") > 0)


def drug_patterns(drugs: DataFrame) -> DataFrame:
    """(drug_id, name, pattern): any of a drug's aliases, with any gap between words; the first that fits wins.

    A drug without an alias to search for has no row.
    """
    patterns = F.transform("_kept", lambda a: F.replace(a, F.lit(" "), F.lit(r"\s+")))
    return _words(drugs).select("drug_id", "name", F.concat(F.lit(r"\b("), F.array_join(patterns, "|"), F.lit(r")\b")).alias("pattern"))


def match_spans(text: Column, pattern: Column) -> Column:
    """Array of (start, end) of all matches, from 0, ends exclusive."""
    return F.transform(placed(text, pattern), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))


#: Characters of aliases that one pass over the texts looks for, about; a larger table takes several passes.
PASS_CHARS = 16 << 20
_WORD = re.compile("[a-z0-9]+")
#: Of a run's hash, in 64 bits.
_FACTOR, _ALL = 0x9E3779B97F4A7C15, (1 << 64) - 1
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Aliases:
    """Runs of words that begin an alias, and those that are one, as sorted hashes: a few bytes for each, whatever the number of aliases.

    ``listed`` has each drug's aliases. A hash of a run is built word by word; a run that fits by its hash is compared with the alias.
    """

    def __init__(self, listed: pa.ChunkedArray | pa.Array | Iterable[Iterable[str]]):
        lists = listed if isinstance(listed, pa.Array | pa.ChunkedArray) else pa.array(list(listed), pa.list_(pa.string()))
        self.lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        begun, ends, places, drugs = array("Q"), array("Q"), array("i"), array("i")
        for first in range(0, len(self.lists), 4096):
            for drug, aliases in enumerate(self.lists.slice(first, 4096).to_pylist(), first):
                for place, alias in enumerate(aliases):
                    run = 0
                    for word in alias.split(" "):
                        run = (run * _FACTOR + hash(word)) & _ALL
                        begun.append(run)
                    ends.append(run)
                    places.append(place)
                    drugs.append(drug)
        self.begun = np.unique(np.frombuffer(begun, np.uint64))
        ends = np.frombuffer(ends, np.uint64)
        order = np.argsort(ends, kind="stable")
        self.ends, self.places, self.drugs = ends[order], np.frombuffer(places, np.int32)[order], np.frombuffer(drugs, np.int32)[order]

    def _runs(self, words: list[str]) -> Iterator[tuple[int, int, int]]:
        """(i, j, place in ``ends``) of every alias that words i to j are, by i, j."""
        if not words or not len(self.begun):
            return
        hashes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
        at, runs, found, j = np.arange(len(words)), np.zeros(len(words), np.uint64), [], 0
        while len(at):
            runs = runs * np.uint64(_FACTOR) + hashes[at + j]
            known = self.begun[np.minimum(np.searchsorted(self.begun, runs), len(self.begun) - 1)] == runs
            at, runs = at[known], runs[known]
            low, high = np.searchsorted(self.ends, runs), np.searchsorted(self.ends, runs, "right")
            for k in np.flatnonzero(low < high):
                found += [(int(at[k]), int(at[k]) + j, e) for e in range(low[k], high[k])]
            j += 1
            more = at + j < len(words)
            at, runs = at[more], runs[more]
        for i, j, e in sorted(found):
            if self.lists[int(self.drugs[e])][int(self.places[e])].as_py() == " ".join(words[i : j + 1]):
                yield i, j, e

    def matches(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(drug, start, end) of every match: each drug's leftmost ones that do not overlap, the first alias that fits."""
        low = text.lower()
        if len(low) != len(text):  # a letter that lower case makes longer would move all places
            low = text.translate(_LOWER)
        words, spans, free = _WORD.findall(low), None, {}
        for i, fitting in groupby(self._runs(words), lambda x: x[0]):
            found: dict[int, tuple[int, int]] = {}
            for _, j, e in fitting:
                drug, place = int(self.drugs[e]), int(self.places[e])
                if drug not in found or place < found[drug][0]:
                    found[drug] = (place, j)
            spans = spans or [m.span() for m in _WORD.finditer(low)]
            for drug, (_, j) in found.items():
                if free.get(drug, 0) <= i:
                    free[drug] = j + 1
                    yield drug, spans[i][0], spans[j][1]


#: The aliases that this worker has hashed last.
_known: dict[str, Aliases] = {}


def find_drugs(texts: DataFrame, drugs: DataFrame) -> DataFrame:
    """(text_id, drug_id, name, surface, start, end): every match of every drug, in one pass over the texts.

    Letters are lowered and all but letters and digits are gaps, so a match is a run of whole words: each text's words
    are looked up in hashes of all aliases, whatever their number. Those of a pass hold
    ``PASS_CHARS``, which is all that is broadcast.
    """
    spark = texts.sparkSession
    small_batches(spark)
    kept = _words(drugs).select("drug_id", "name", "_kept")
    size = kept.agg(F.sum(F.length(F.array_join("_kept", " ")))).first()[0] or 0
    passes = -(-size // PASS_CHARS) or 1
    found = None
    for k in range(passes):
        own = kept.where(F.pmod(F.xxhash64("drug_id", "_kept"), F.lit(passes)) == k).toArrow()
        got = _found(texts, spark.sparkContext.broadcast(own), kept)
        found = got if found is None else found.unionByName(got)
    return found


def _found(texts: DataFrame, listed, kept: DataFrame) -> DataFrame:
    key = f"_{uuid.uuid4().hex}"

    def run(batches):
        table = listed.value
        if key not in _known:
            _known.clear()
            _known[key] = Aliases(table.column("_kept"))
        for batch in batches:
            rows, which, surface, start, end = [], [], [], [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                for drug, a, b in _known[key].matches(text or ""):
                    rows.append(row)
                    which.append(drug)
                    surface.append(text[a:b])
                    start.append(a)
                    end.append(b)
            drugs = [table.column(c).take(pa.array(which, pa.int64())).combine_chunks() for c in ("drug_id", "name")]
            yield pa.record_batch([batch.column("text_id").take(pa.array(rows, pa.int64())), *drugs, pa.array(surface, pa.string()), pa.array(start, pa.int32()), pa.array(end, pa.int32())], names=["text_id", "drug_id", "name", "surface", "start", "end"])

    out = texts.select("text_id").schema.add(kept.schema["drug_id"]).add(kept.schema["name"]).add("surface", "string").add("start", "integer").add("end", "integer")
    return texts.select("text_id", "text").mapInArrow(run, out)


def gene_spans(found: DataFrame, least: float = GENE_SCORE) -> DataFrame:
    """Spans (text_id, name, start, end, score) of more than ``least``."""
    return found.where(F.col("score") > least)


def stored_spans(found: DataFrame) -> DataFrame:
    return found.where(F.col("score") >= KEPT_SCORE)


def not_overlapping(genes: DataFrame, drugs: DataFrame) -> DataFrame:
    """Genes of which each drug of the text ends at or before their start, or starts after their end.

    Of the drugs that start no later than a gene's end, the one that reaches farthest decides:
    one pass over a text's spans in order.
    """
    names = genes.columns
    d = drugs.select("text_id", F.col("start").alias("_at"), F.lit(0).alias("_kind"), F.col("end").alias("_far"), F.lit(None).cast(genes.select(F.struct("*").alias("g")).schema["g"].dataType).alias("_gene"))
    g = genes.select("text_id", F.col("end").alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast("int").alias("_far"), F.struct("*").alias("_gene"))
    reach = F.max("_far").over(Window.partitionBy("text_id").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0))
    rows = d.unionByName(g).withColumn("_reach", F.coalesce(reach, F.lit(0))).where(F.col("_gene").isNotNull() & (F.col("_reach") <= F.col("_gene.start")))
    return rows.select(*(F.col("_gene")[c].alias(c) for c in names))


def sentence_rows(texts: DataFrame) -> DataFrame:
    """(text_id, number, sentence, start, end)."""
    return texts.select("text_id", F.posexplode(sentences(F.col("text"))).alias("number", "s")).select("text_id", "number", "s.sentence", "s.start", "s.end")


def in_sentences(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """``spans`` (text_id, start, end, ...) that lie in one sentence, with its ``number``.

    Sentences and spans of a text are walked once in order: the last sentence that starts
    before a span is the only one that may hold it.
    """
    kept = spans.columns
    held = F.struct(*(c for c in kept if c != "text_id"))
    kind = spans.select(held.alias("s")).schema["s"].dataType
    s = sentence_rows(texts).select("text_id", F.col("start").alias("_at"), F.col("number").alias("_order"), F.struct("number", "end").alias("_sentence"), F.lit(None).cast(kind).alias("_span"))
    shape = s.schema["_sentence"].dataType
    p = spans.select("text_id", F.col("start").alias("_at"), F.lit((1 << 31) - 1).alias("_order"), F.lit(None).cast(shape).alias("_sentence"), held.alias("_span"))
    last = F.last("_sentence", ignorenulls=True).over(Window.partitionBy("text_id").orderBy("_at", "_order").rowsBetween(Window.unboundedPreceding, 0))
    rows = s.unionByName(p).withColumn("_in", last).where(F.col("_span").isNotNull() & (F.col("_span.end") <= F.col("_in.end")))
    return rows.select("text_id", F.col("_in.number").alias("number"), *(F.col("_span")[c].alias(c) for c in kept if c != "text_id"))


def cooccurrences(texts: DataFrame, drugs: DataFrame, genes: DataFrame) -> DataFrame:
    """(text_id, drug, genes): the genes in any sentence with the drug, sorted.

    ``drugs`` are spans of ``find_drugs``, ``genes`` spans that count. Everything is dealt by
    text once; what a sentence holds is gathered as sets of names.
    """
    span = lambda df, name, kind: df.select("text_id", "start", "end", F.trim(name).alias("name") if kind == "drug" else F.col(name).alias("name"), F.lit(kind).alias("kind"))
    both = span(drugs, "name", "drug").unionByName(span(not_overlapping(genes, drugs), "name", "gene"))
    names = lambda kind: F.collect_set(F.when(F.col("kind") == kind, F.col("name")))
    held = in_sentences(texts, both).groupBy("text_id", "number").agg(names("drug").alias("drugs"), names("gene").alias("genes")).where("size(drugs) > 0 and size(genes) > 0")
    each = held.select("text_id", F.explode("drugs").alias("drug"), "genes")
    return each.groupBy("text_id", "drug").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("genes")))).alias("genes"))


def new_texts(texts: DataFrame, done: DataFrame) -> DataFrame:
    """Texts whose result is not stored yet."""
    return texts.join(done.select("text_id").distinct(), "text_id", "left_anti")


def pair_articles(found: DataFrame) -> DataFrame:
    """(gene, drug, pmid): a row per pair and article."""
    return found.select(F.explode("genes").alias("gene"), "drug", F.col("text_id").alias("pmid")).distinct()


def global_pairs(found: DataFrame) -> DataFrame:
    """(gene, drug, n): in how many articles each pair is. The articles are ``pair_articles``."""
    return pair_articles(found).groupBy("gene", "drug").agg(F.count("*").alias("n"))


def with_association(ids: DataFrame, found: DataFrame) -> DataFrame:
    """The ids that have at least one association."""
    return ids.join(found.where(F.size("genes") > 0).select(F.col("text_id").alias("pmid")), "pmid", "left_semi")


def pair_rows(found: DataFrame) -> DataFrame:
    """(PMID, GENE, DRUG): one row per pair and article."""
    return found.select(F.col("text_id").alias("PMID"), F.explode("genes").alias("GENE"), F.col("drug").alias("DRUG")).distinct().select("PMID", "GENE", "DRUG")


#: An exported abstract has so many characters at most.
ABSTRACT = 2450


def star_schema(found: DataFrame, articles: DataFrame) -> dict[str, DataFrame]:
    """Tables genedrug (id, gene, drug, numarticles), dg_pmids (pmid, text, dg_id), cbs (an article a row)."""
    ids = numbered(global_pairs(found), ["gene", "drug"], "id", 0)
    genedrug = ids.select("id", "gene", "drug", F.col("n").alias("numarticles"))
    dg = pair_articles(found).join(ids.select("id", "gene", "drug"), ["gene", "drug"]).select(F.col("pmid").cast("string").alias("pmid"), F.lit(None).cast("string").alias("text"), F.col("id").alias("dg_id"))
    per = found.groupBy("text_id").agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("genes")))), " ").alias("genes"), F.array_join(F.array_sort(F.collect_set("drug")), " ").alias("drugs"))
    cbs = articles.join(per, articles.pmid == per.text_id).select(
        F.col("pmid").cast("string").alias("pmid"), "title", F.when(F.col("abstract") != "", F.substring("abstract", 1, ABSTRACT)).alias("abs"), "genes", "drugs", F.lit(None).cast("string").alias("coes"), F.lit(None).cast("string").alias("evid_loc")
    )
    return {"genedrug": genedrug, "dg_pmids": dg, "cbs": cbs}


def sql_literal(value: Column, text: bool) -> Column:
    quoted = F.concat(F.lit("'"), F.replace(value.cast("string"), F.lit("'"), F.lit("''")), F.lit("'")) if text else value.cast("string")
    return F.coalesce(quoted, F.lit("NULL"))


def insert_statements(table: DataFrame, name: str) -> DataFrame:
    """(value): an INSERT per row."""
    kinds = dict(table.dtypes)
    values = F.concat_ws(", ", *(sql_literal(F.col(c), kinds[c] == "string") for c in table.columns))
    return table.select(F.concat(F.lit(f"INSERT INTO {name} VALUES ("), values, F.lit(");")).alias("value"))
