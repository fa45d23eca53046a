"""The registered queries of the retrieval engine, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.config import Params
from gleaner.functions import codec, dates
from gleaner.functions.arrays import placed
from gleaner.functions.text import article_text
from gleaner.operators import blocks, browse, cooccur, index, metrics, model, retrieve, sweep, validate
from gleaner.operators.features import extract, sets
from gleaner.operators.order import numbered
from gleaner.session import Cuts, stored
from gleaner.sources import corpora, readers, writers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

#: Dates that the dated queries use, and the score from which the basket corpus returns a part.
LOW, HIGH, LEAST_SCORE = 19960101, 19991231, -3.0
FOLDS, SEED = 5, 7
#: From this date on, orders are the second batch of a growing index.
LATER = 19950101


def query(f):
    QUERIES[f.__name__] = f
    return f


# ---- the basket corpus


def index_tables(spark, sets: DataFrame) -> dict[str, DataFrame]:
    """Vectors and vocabulary of (pmid, date_key, names); the features are extracted once, and stay with their article."""
    cuts = Cuts(spark, "index")
    sets = cuts.write(sets)
    vocab = cuts.write(index.numbered(index.document_frequency(index.long_of(sets)), cuts=cuts).select("fid", "ftype", "fname", "df"))
    return {"vectors": index.vectors_of_sets(sets, vocab), "vocabulary": vocab}


def word_index_tables(spark, sets: DataFrame, mincount: int) -> dict[str, DataFrame]:
    """The same where names are as many as words: they are written, counted and numbered once per block of documents."""
    cuts = Cuts(spark, "index")
    docs, terms = blocks.coded_names(sets, cuts)
    names = blocks.document_frequency(terms).where(F.col("df") >= mincount)
    vocab = cuts.write(index.numbered(names, cuts=cuts).select("fid", "ftype", "fname", "df"))
    return {"vectors": blocks.numbered_codes(docs, terms, vocab), "vocabulary": vocab}


def indexed(spark, d, name: str, sources: tuple[str, ...], make) -> tuple[DataFrame, DataFrame]:
    """(vectors, vocabulary): the index is stored once per state of the files, and scanned by every query."""
    tables = stored(spark, name, [f"{d}/{s}.parquet" for s in sources], make)
    return tables["vectors"], tables["vocabulary"]


def basket(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(vectors, vocabulary, positives)."""
    docs, vocab = indexed(spark, d, "basket", ("orders", "lineitem", "part"), lambda: index_tables(spark, index.named_sets(corpora.basket_articles(spark, d), corpora.basket_sets(spark, d))))
    return docs, vocab, corpora.basket_positives(spark, d)


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    """Rounded, and without negative zeros."""
    return df.withColumns({c: F.round(F.col(c), digits) + F.lit(0.0) for c in names})


@query
def doc_features_basket(spark, d):
    return corpora.basket_features(spark, d)


@query
def vocabulary_df(spark, d):
    return index.vocabulary(corpora.basket_features(spark, d))


@query
def doc_vectors(spark, d):
    docs, _, _ = basket(spark, d)
    return docs.select("pmid", "date_key", F.array_join(F.col("features").cast("array<string>"), " ").alias("features"))


@query
def codec_round_trip(spark, d):
    docs, _, _ = basket(spark, d)
    coded = docs.withColumn("code", codec.vb_encode(F.col("features")))
    return coded.select("pmid", F.octet_length("code").alias("n_bytes"), F.lower(F.hex("code")).alias("code"), (codec.vb_decode(F.col("code")) == F.col("features")).alias("same"))


@query
def date_keys(spark, d):
    orders = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_orderdate")
    key = dates.date_key(F.col("o_orderdate"))
    text = F.date_format("o_orderdate", "yyyy/MM/dd")
    return orders.select(F.col("o_orderkey").alias("pmid"), key.alias("date_key"), (dates.key_date(key) == F.col("o_orderdate").cast("date")).alias("back"), dates.parse_date(text).alias("parsed"), dates.date_is_valid(text, F.lit("2000-03-01").cast("date")).alias("valid"))


@query
def pos_counts(spark, d):
    docs, _, positives = basket(spark, d)
    return model.count_features(docs.join(positives, "pmid", "left_semi"))


@query
def bg_counts_all(spark, d):
    counts, _ = model.counts_by_subtraction(*basket(spark, d))
    return counts.select("fid", "pos", "neg")


@query
def bg_counts_dated(spark, d):
    counts, totals = model.counts_dated(*basket(spark, d), LOW, HIGH)
    return counts.crossJoin(F.broadcast(totals)).select("fid", "pos", "neg", "pdocs", "ndocs")


def trained(spark, d, method: str = "laplace_split", **more) -> model.Model:
    return retrieve.learn(*basket(spark, d), Params(method=method, **more))


@query
def infogain(spark, d):
    return rounded(trained(spark, d).weights.select("fid", "infogain"), "infogain", digits=9)


@query
def select_features(spark, d):
    return trained(spark, d, mincount=20, min_infogain=1e-6, positives_only=True, type_mask=("flag",)).weights.select("fid", "selected")


@query
def feature_stats(spark, d):
    return rounded(model.feature_stats(trained(spark, d, mincount=20, type_mask=("flag",)), ("flag",)), "aggressivity", "pos_average", "neg_average")


@query
def tfidf_top(spark, d):
    return model.top_tfidf(trained(spark, d), 20).select("fid", "ftype", "fname", "pos", "neg", "tfidf")


def _weights(method: str):
    def run(spark, d):
        return rounded(trained(spark, d, method).weights.select("fid", "pfreq", "nfreq", "score"), "pfreq", "nfreq", "score", digits=8)

    return run


for _name, _method in {"weights_laplace": "laplace", "weights_split": "laplace_split", "weights_bgfreq": "bgfreq", "weights_ratio": "rubin"}.items():
    QUERIES[_name] = _weights(_method)


@query
def model_scalars(spark, d):
    return rounded(trained(spark, d).scalars.select("pdocs", "ndocs", "numdocs", "prior", "base"), "prior", "base")


@query
def feature_csv(spark, d):
    return model.feature_table(trained(spark, d, mincount=2), 50)


@query
def retrieve_topk(spark, d):
    """The flagship: learn from the positives, rank all other documents."""
    results, _, _ = retrieve.query(*basket(spark, d), Params(limit=500))
    return results


@query
def retrieve_dated(spark, d):
    results, _, _ = retrieve.query(*basket(spark, d), Params(limit=500, mindate=LOW, maxdate=HIGH))
    return results


@query
def retrieve_threshold(spark, d):
    docs, vocab, positives = basket(spark, d)
    m = retrieve.learn(docs, vocab, positives, Params(method="bgfreq"))
    return retrieve.passing(retrieve.scored(docs, m), LEAST_SCORE)


@query
def score_inputs(spark, d):
    _, inputs, _ = retrieve.query(*basket(spark, d))
    return inputs.select("pmid", "score")


@query
def param_sweep(spark, d):
    docs, vocab, positives = basket(spark, d)
    counts, totals = model.counts_by_subtraction(docs, vocab, positives)
    m = sweep.train_all(counts, totals, sweep.smoothing_grid())
    return sweep.ranked_all(sweep.score_all(docs, m), 100)


@query
def id_status(spark, d):
    orders = corpora.basket_articles(spark, d)
    ids = orders.select(F.col("pmid")).unionByName(orders.select((F.col("pmid") + 1_000_000_000).alias("pmid")).where("pmid % 3 = 0"))
    return retrieve.id_status(ids, orders, corpora.basket_positives(spark, d))


@query
def random_negatives(spark, d):
    return retrieve.negatives(corpora.basket_articles(spark, d), corpora.basket_positives(spark, d), 200, SEED)


@query
def vacuum_map(spark, d):
    vocab = index.vocabulary(corpora.basket_features(spark, d))
    return index.vacuum_map(vocab, _mincount(spark, d))


def _mincount(spark, d) -> int:
    """A tenth of the orders: keeps the flags, the types and few others."""
    return max(1, spark.read.parquet(f"{d}/orders.parquet").count() // 10)


@query
def vacuum_vectors(spark, d):
    docs, vocab, _ = basket(spark, d)
    kept = index.vacuum_vectors(docs, index.vacuum_map(vocab, _mincount(spark, d)))
    return kept.select("pmid", "date_key", F.array_join(F.col("features").cast("array<string>"), " ").alias("features"))


@query
def incremental_df(spark, d):
    """All orders in two batches, by date: the later one brings features that the earlier has not."""
    long = Cuts(spark, "batches").write(corpora.basket_features(spark, d).join(corpora.basket_articles(spark, d), "pmid"))
    first = index.vocabulary(long.where(F.col("date_key") < LATER).select("pmid", "ftype", "fname"))
    return index.grown(first, long.where(F.col("date_key") >= LATER).select("pmid", "ftype", "fname"))


@query
def tp_vs_rank(spark, d):
    results, _, _ = retrieve.query(*basket(spark, d), Params(limit=1000), exclude_positives=False)
    return rounded(retrieve.truepos_vs_rank(results, corpora.basket_positives(spark, d)), "precision", "recall")


@query
def retrieval_test(spark, d):
    docs, vocab, positives = basket(spark, d)
    return rounded(retrieve.retrieval_test(docs, vocab, positives, 1998, 100), "precision", "recall")


# ---- the text corpus


def _space(name: str):
    return lambda spark, d: extract(corpora.text_articles(spark, d), name)


for _name, _spacename in {
    "words_title_case": "word", "words_fold": "word_fold", "words_num": "word_num", "words_strip": "word_strip", "words_raw": "raw_word", "words_raw_all": "raw_all",
    "features_headings": "mqi", "features_authors": "author", "features_union": "wmqia", "features_filtered": "wmqia_filt",
}.items():
    QUERIES[_name] = _space(_spacename)


def text_corpus(spark, d) -> tuple[DataFrame, DataFrame]:
    """(vectors, vocabulary) of lower-cased words that two documents or more have."""

    def make():
        articles = corpora.text_articles(spark, d)
        key = dates.date_key(F.col("date_completed"))
        return word_index_tables(spark, articles.select("pmid", key.alias("date_key"), sets("word_strip").alias("names")), 2)

    return indexed(spark, d, "text", ("documents",), make)


@query
def retrieve_text(spark, d):
    docs, vocab = text_corpus(spark, d)
    positives = corpora.toxic_labels(spark, d).where("label = 1").select("pmid")
    results, _, _ = retrieve.query(docs, vocab, positives, Params(limit=200, threshold=0.0))
    return rounded(results, "score", digits=4).select("pmid", "score")


@query
def fold_assignment(spark, d):
    return validate.folds(corpora.toxic_labels(spark, d), FOLDS, SEED).select("pmid", "label", "fold")


def cv(spark, d, digits: int = 4) -> DataFrame:
    """Cross-validated scores of the labelled documents in headings, journal and folded words."""
    docs, vocab = text_corpus(spark, d)
    folded = validate.folds(corpora.toxic_labels(spark, d), FOLDS, SEED)
    return rounded(validate.cross_validate(docs, vocab, folded, Params(mincount=2)), "score", digits=digits)


@query
def cv_scores(spark, d):
    return cv(spark, d, 4)


def _basket_scores(spark, d) -> DataFrame:
    """(pmid, label, fold, score) of all orders, by the model of the plain query; folds by id."""
    docs, vocab, positives = basket(spark, d)
    cuts = Cuts(spark, "scores")
    ids = model.written_ids(positives, cuts)
    m = retrieve.learn(docs, vocab, ids)
    scores = rounded(retrieve.score(docs, m), "score", digits=3)
    flagged = scores.join(ids.withColumn("label", F.lit(1)), "pmid", "left")
    return cuts.write(flagged.select("pmid", F.coalesce("label", F.lit(0)).alias("label"), (F.col("pmid") % FOLDS).cast("int").alias("fold"), "score"))


@query
def confusion_curve(spark, d):
    return metrics.confusion_curve(_basket_scores(spark, d))


@query
def metric_curve(spark, d):
    return rounded(metrics.ratio_curve(metrics.confusion_curve(_basket_scores(spark, d)), 0.3), "tpr", "fpr", "ppv", "u", "fm", "fma")


@query
def roc_area_se(spark, d):
    curve = metrics.confusion_curve(_basket_scores(spark, d))
    both = metrics.roc_error(curve).crossJoin(metrics.curve_areas(metrics.ratio_curve(curve)))
    return rounded(both, "w", "q1", "q2", "w_stderr", "roc_area", "pr_area")


@query
def avg_precision(spark, d):
    return rounded(metrics.averaged_precision(_basket_scores(spark, d)), "avprec", digits=9)


@query
def breakeven(spark, d):
    return rounded(metrics.breakeven(metrics.ratio_curve(metrics.confusion_curve(_basket_scores(spark, d)))), "breakeven")


@query
def precision_11(spark, d):
    return rounded(metrics.precision_11(metrics.ratio_curve(metrics.confusion_curve(_basket_scores(spark, d)))), "precision")


@query
def threshold_metrics(spark, d):
    scores = _basket_scores(spark, d)
    at = metrics.index_for(metrics.confusion_curve(scores), LEAST_SCORE)
    matrix = metrics.confusion_curve(scores).join(F.broadcast(at), "score")
    out = metrics.performance(matrix.select("score", "tp", "tn", "fp", "fn"), 0.3)
    return rounded(out.select("score", *metrics.METRICS), *metrics.METRICS)


@query
def best_threshold(spark, d):
    ratios = metrics.ratio_curve(metrics.confusion_curve(_basket_scores(spark, d)), 0.3)
    return rounded(metrics.threshold_maximising(ratios, "fma").select("score", "fma"), "fma")


@query
def fold_range(spark, d):
    return rounded(metrics.performance_range(_basket_scores(spark, d), LEAST_SCORE, 0.5), "average", "minimum", "maximum")


@query
def score_histogram(spark, d):
    return rounded(metrics.histogram(_basket_scores(spark, d)), "left", "mass")


@query
def weight_histogram(spark, d):
    m = trained(spark, d)
    return rounded(metrics.feature_histogram(rounded(m.weights, "score", digits=3)), "left", "mass")


@query
def score_density(spark, d):
    return rounded(metrics.kernel_density(_basket_scores(spark, d), points=64), "x", "density")


@query
def roc_interpolated(spark, d):
    ratios = metrics.ratio_curve(metrics.confusion_curve(_basket_scores(spark, d)))
    points = ratios.groupBy("fpr").agg(F.max("tpr").alias("tpr"))
    return rounded(metrics.interpolated(points, "fpr", "tpr", points=101, least=50), "fpr", "tpr")


# ---- result tables


def _results(spark, d) -> DataFrame:
    """The newest documents as ranked results, rendered: rank by date and id, score from both."""
    articles = corpora.text_articles(spark, d)
    ranked = articles.select("pmid", F.round(100 - F.col("pmid") % 997 / 10, 2).alias("score"))
    return browse.rendered(retrieve.ranked(ranked, None).join(articles, "pmid"))


@query
def browse_filter(spark, d):
    chosen = browse.Filter(minscore=20.0, mindate="2001.01.01", maxdate="2008.06.30", title_or_abstract="an", exclude="qu[ae]", journal="SRC1", authors="src1[0-9] (en|de)")
    return browse.visible(_results(spark, d), chosen).select("pmid", "rank", "visible")


@query
def browse_sort(spark, d):
    """By first author, latest first; numbered by range, without the texts."""
    rows = _results(spark, d).select("rank", "pmid", "shown_score", "date", "authors", "journal", browse.surname().alias("surname"))
    return numbered(rows, [F.asc_nulls_last("surname"), F.desc("date"), "rank"], "place").drop("surname")


@query
def result_pages(spark, d):
    return browse.paged(_results(spark, d), 64).select("pmid", "rank", "page")


@query
def page_ids(spark, d):
    return browse.joined_ids(browse.paged(_results(spark, d), 64), "page = 1")


# ---- co-occurrence


#: Drugs (id, name, aliases) and gene words that the invented texts have.
DRUGS = (("D1", "Haren", ("Haren", "the-han")), ("D2", "Ention", ("Ention", "tion")), ("D3", "Der ver", ("Der  ver", "verein", "abc")))
GENES = ("inger", "inthe", "keit", "ción", "eau")


def _texts(spark, d):
    articles = corpora.text_articles(spark, d)
    return articles.select(F.col("pmid").alias("text_id"), article_text(F.col("title"), F.col("abstract")).alias("text"))


def _drugs(spark):
    return spark.createDataFrame([(i, n, list(a)) for i, n, a in DRUGS], "drug_id string, name string, aliases array<string>")


def _genes(texts):
    """Spans of the gene words; their score stands for a finder's."""
    rows = texts.select("text_id", F.explode(placed(F.col("text"), "|".join(GENES))).alias("s"))
    score = F.when((F.col("text_id") + F.col("s.start")) % 5 == 0, 0.5).otherwise(0.9)
    return rows.select("text_id", F.col("s.all").alias("name"), "s.start", "s.end", score.alias("score"))


@query
def sentences(spark, d):
    return cooccur.sentence_rows(_texts(spark, d))


@query
def term_spans(spark, d):
    return cooccur.find_drugs(_texts(spark, d), _drugs(spark))


def _found(spark, d):
    cuts = Cuts(spark, "spans")
    texts = cuts.write(_texts(spark, d))
    drugs = cuts.write(cooccur.find_drugs(texts, _drugs(spark)))
    return cuts.write(cooccur.cooccurrences(texts, drugs, cooccur.gene_spans(_genes(texts))))


@query
def cooccurrences(spark, d):
    return _found(spark, d).withColumn("genes", F.array_join("genes", " "))


@query
def cooccurrence_pairs(spark, d):
    return cooccur.global_pairs(_found(spark, d))


@query
def pair_articles(spark, d):
    return cooccur.pair_rows(_found(spark, d))


def _star(spark, d) -> dict[str, DataFrame]:
    return cooccur.star_schema(_found(spark, d), corpora.text_articles(spark, d))


@query
def export_star(spark, d):
    return _star(spark, d)["cbs"].select("pmid", "title", "abs", "genes", "drugs")


@query
def export_genedrug(spark, d):
    return _star(spark, d)["genedrug"]


@query
def export_dg_pmids(spark, d):
    return _star(spark, d)["dg_pmids"].select("pmid", "dg_id")


# ---- sources and streams


@query
def event_counts(spark, d):
    """The running counts of a file stream of events, after all of it."""
    from gleaner.streaming.ingest import running_counts

    path, table = Cuts(spark, "events").root, f"{d}/events.parquet"
    # a table may be one file, which a stream reads by a pattern only; this one fits that name alone
    stream = spark.readStream.schema(spark.read.parquet(table).schema).parquet(f"{table[:-1]}[t]")
    counts = running_counts(stream.select("event_type"))
    kept = lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/counts")
    q = counts.writeStream.outputMode("complete").foreachBatch(kept).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{path}/counts")


@query
def tag_lines(spark, d):
    rows = _results(spark, d).withColumn("tag", F.when(F.col("pmid") % 3 == 0, F.lit(0)).when(F.col("pmid") % 3 == 1, F.lit(1)))
    return browse.read_tags(browse.tag_lines(rows))


@query
def score_lines(spark, d):
    return writers.score_lines(retrieve.query(*basket(spark, d), Params(limit=200))[0].select("pmid", "score"))


@query
def lookup_vectors(spark, d):
    docs, _, positives = basket(spark, d)
    found = readers.lookup(docs, positives.unionByName(positives.selectExpr("pmid + 1000000000 AS pmid")))
    return found.select("pmid", "date_key", F.size("features").alias("n"))
