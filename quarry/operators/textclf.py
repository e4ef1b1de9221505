"""Text features, prompted labelling and ranking metrics (Q*).

Term statistics are relational: documents are tokenised by a JVM regex,
exploded to (doc, term) rows and aggregated; document frequencies are a
groupBy on the term.  The term table is never collected.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quarry.functions.columns import tokens
from quarry.operators.shape import q
from quarry.session import cut_lineage, spread


def doc_terms(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(doc, term, tf) for every token of two or more word characters, whole texts."""
    src = spread(df.select(q(id_col).alias("doc"), q(text).alias("__t")))
    e = src.select("doc", F.explode(tokens(F.col("__t"))).alias("term"))
    return cut_lineage(e.groupBy("doc", "term").agg(F.count(F.lit(1)).alias("tf")))  # read for the frequencies and for the rows


def _doc_freq(tf: DataFrame) -> DataFrame:
    """Documents per term."""
    return tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def term_features(df: DataFrame, id_col: str, text: str, kind: str = "binary", max_df: float = 0.95,
                  min_df: int = 1) -> DataFrame:
    """Binary or count term features in long form, dropping terms in more than max_df of docs (Q1)."""
    tf = doc_terms(df, id_col, text)
    n_docs = F.lit(df.select(F.count(F.lit(1))).first()[0])  # one value
    keep = _doc_freq(tf).filter((F.col("df") <= n_docs * max_df) & (F.col("df") >= min_df)).select("term")
    out = tf.join(keep, "term")
    val = F.lit(1).cast("long") if kind == "binary" else F.col("tf")
    return out.select("doc", "term", val.alias("value"))


def tfidf(df: DataFrame, id_col: str, text: str, max_df: float = 1.0) -> DataFrame:
    """TF-IDF with smoothed idf ln((1+n)/(1+df)) + 1 and L2-normalised rows (Q2).

    Document frequencies join back on the term (AQE splits the partitions of
    very common terms); the row norm is a window over one document's terms.
    """
    from pyspark.sql import Window
    tf = doc_terms(df, id_col, text)
    n_docs = F.lit(df.select(F.count(F.lit(1))).first()[0])  # one value
    dfreq = _doc_freq(tf).filter(F.col("df") <= n_docs * max_df)
    idf = F.ln((1 + n_docs) / (1 + F.col("df"))) + 1
    w = tf.join(dfreq.select("term", idf.alias("idf")), "term").withColumn("w", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc")))
    return w.select("doc", "term", (F.col("w") / norm).alias("weight"))


def common_terms(words: DataFrame, col: str, max_df: float) -> list[str]:
    """Terms of the texts or token arrays ``col`` that lie in more than ``max_df`` of the rows.

    Bounded: the rows hold (mean distinct terms) x n pairs, so at most
    (mean distinct terms) / ``max_df`` terms can be that common.
    """
    return _common(words, _term_rows(words, col), max_df)


def _term_rows(words: DataFrame, col: str) -> DataFrame:
    """(term, df): the rows that hold each term of the texts or token arrays ``col``."""
    own = q(col) if dict(words.dtypes)[col].startswith("array") else tokens(q(col))
    return words.select(F.explode(F.array_distinct(own)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def _common(words: DataFrame, rows: DataFrame, max_df: float) -> list[str]:
    n = words.count()
    return sorted(r["term"] for r in rows.filter(F.col("df") > n * max_df).collect())


def text_classifier(df: DataFrame, text: str, label: str, kind: str = "binary", max_df: float = 0.95, max_iter: int = 50,
                    reg: float = 0.0, n_features: int = 1 << 18):
    """Fitted pipeline tokenise -> hashed term features -> multinomial logistic regression (M8, Q3, Q8).

    ``kind``: binary, count or tfidf.  Terms are hashed into ``n_features``
    columns (at most; the smallest power of two that holds twice the distinct
    terms is enough), so every term counts however many there are and no
    vocabulary is held; terms in more than ``max_df`` of the documents are
    removed.  The texts are spread over the cluster and tokenised once, and the
    hashed features are written once; the fit reads these tables.
    """
    return next(text_classifiers(df, text, label, [kind], max_df, max_iter, reg, n_features))[1]


def text_classifiers(df: DataFrame, text: str, label: str, kinds: list[str], max_df: float = 0.95, max_iter: int = 50, reg: float = 0.0,
                     n_features: int = 1 << 18):
    """(kind, fitted pipeline as in ``text_classifier``) for several kinds that share one tokenised table and its term counts."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer, StopWordsRemover, StringIndexer
    tokenizer = RegexTokenizer(inputCol=text, outputCol="__tok", pattern=r"(?U)\b\w\w+\b", gaps=False, toLowercase=True)
    source = spread(df.select(q(label), q(text)))
    words = cut_lineage(tokenizer.transform(source.filter(q(text).isNotNull())).select(q(label), "__tok"))
    indexer = StringIndexer(inputCol=label, outputCol="__y", stringOrderType="alphabetAsc", handleInvalid="skip").fit(words)
    seen = cut_lineage(_term_rows(words, "__tok"))  # one row a term: the common ones and their number are read off it
    remover = StopWordsRemover(inputCol="__tok", outputCol="__kept", stopWords=_common(words, seen, max_df), caseSensitive=True, locale="en_US")
    terms = seen.agg(F.approx_count_distinct("term")).first()[0]
    size = min(n_features, 1 << max(4, int(2 * terms).bit_length()))
    tables: dict = {}
    for kind in kinds:
        hashing = HashingTF(inputCol="__kept", outputCol="__tf", numFeatures=size, binary=kind == "binary")
        stages = [indexer, tokenizer, remover, hashing]
        if (kind == "binary") not in tables:
            tables[kind == "binary"] = cut_lineage(hashing.transform(remover.transform(indexer.transform(words))).select("__y", "__tf"))
        feats = tables[kind == "binary"]
        if kind == "tfidf":
            idf = IDF(inputCol="__tf", outputCol="__x").fit(feats)
            stages.append(idf)
            feats = idf.transform(feats)
        stages.append(LogisticRegression(featuresCol="__x" if kind == "tfidf" else "__tf", labelCol="__y", family="multinomial",
                                         maxIter=max_iter, regParam=reg).fit(feats))
        yield kind, PipelineModel(stages)


def top_k_classes(pred: DataFrame, labels: list[str], k: int = 3, prob_col: str = "probability",
                  out: str = "top_k") -> DataFrame:
    """Top-k class labels by probability, most likely first (Q3)."""
    from pyspark.ml.functions import vector_to_array

    from quarry.functions.columns import top_k_entries
    p = vector_to_array(F.col(prob_col))
    return pred.withColumn(out, F.transform(top_k_entries(p, labels, k), lambda x: x["name"]))


def rank_metrics(df: DataFrame, true_col: str, preds_col: str, k: int = 3) -> DataFrame:
    """Hit@k, top-1 accuracy, MRR@k and empty-prediction rate (Q4)."""
    preds = F.slice(q(preds_col), 1, k)
    pos = F.array_position(preds, q(true_col))
    return df.agg(F.avg((pos > 0).cast("double")).alias("hit_at_k"),
                  F.avg(F.coalesce((F.try_element_at(q(preds_col), F.lit(1)) == q(true_col)).cast("double"), F.lit(0.0))).alias("top1"),
                  F.avg(F.when(pos > 0, 1.0 / pos).otherwise(0.0)).alias("mrr_at_k"),
                  F.avg((F.size(q(preds_col)) == 0).cast("double")).alias("empty_rate"),
                  F.count(F.lit(1)).alias("n"))


def accuracy_per_category(df: DataFrame, true_col: str, preds_col: str, k: int = 3) -> DataFrame:
    """Hit rate per true category, worst first (Q5)."""
    hit = F.array_contains(F.slice(q(preds_col), 1, k), q(true_col)).cast("double")
    g = df.groupBy(q(true_col).alias("category")).agg(F.avg(hit).alias("accuracy"), F.count(F.lit(1)).alias("n"))
    return g.orderBy("accuracy", "category")


def errors(df: DataFrame, true_col: str, preds_col: str, k: int = 3) -> DataFrame:
    """Rows whose true label is not among the first k predictions (Q5)."""
    return df.filter(~F.array_contains(F.slice(q(preds_col), 1, k), q(true_col)))


# Prompt templates of the reference classifier (text as written there).
ZERO_SHOT_TEMPLATE = (
    "You are a news article classifier. Your task is to assign the most appropriate category to a news article.\n\n"
    "CATEGORIES:\n{cats}\n\nARTICLE:\n\"\"\"\n{text}\n\"\"\"\n\n"
    "Return EXACTLY {k} categories from the list above, ranked from most likely to least likely.\n"
    "Respond ONLY with a JSON array of strings, nothing else. Example: [\"POLITICS\", \"BUSINESS\", \"CRIME\"]\n"
)
FEW_SHOT_TEMPLATE = (
    "You are a news article classifier. Your task is to assign the most appropriate category to a news article.\n\n"
    "CATEGORIES:\n{cats}\n\nHere are some examples:\n\n{examples}\nNow classify this article:\n\n"
    "ARTICLE:\n\"\"\"\n{text}\n\"\"\"\n\n"
    "Return EXACTLY {k} categories from the list above, ranked from most likely to least likely.\n"
    "Respond ONLY with a JSON array of strings, nothing else. Example: [\"POLITICS\", \"BUSINESS\", \"CRIME\"]\n"
)
EXAMPLE_TEMPLATE = 'Article: "{text}"\nCategory: {category}\n\n'


def _fill(template: str, cats: str, k: int, examples=None):
    """Split a template around {text} (and {examples}) into literal pieces."""
    head, tail = template.split("{text}")
    head = head.replace("{cats}", cats).replace("{k}", str(k))
    tail = tail.replace("{k}", str(k))
    if examples is None:
        return [F.lit(head)], [F.lit(tail)]
    pre, post = head.split("{examples}")
    return [F.lit(pre), examples, F.lit(post)], [F.lit(tail)]


def examples_block(examples: DataFrame, text: str, category: str) -> DataFrame:
    """Few-shot block from example rows (one per category), ordered by category; one row."""
    pre, rest = EXAMPLE_TEMPLATE.split("{text}")
    mid, post = rest.split("{category}")
    item = F.concat(F.lit(pre), q(text), F.lit(mid), q(category), F.lit(post))
    packed = F.sort_array(F.collect_list(F.struct(q(category).alias("c"), item.alias("s"))))
    return examples.agg(F.array_join(F.transform(packed, lambda x: x["s"]), "").alias("block"))


def build_prompt(df: DataFrame, text: str, labels: list[str], k: int = 3, examples: DataFrame | None = None,
                 out: str = "prompt") -> DataFrame:
    """Zero-shot prompt, or few-shot when an examples block (one row) is given (Q6)."""
    cats = ", ".join(labels)
    if examples is None:
        pre, post = _fill(ZERO_SHOT_TEMPLATE, cats, k)
    else:
        block = examples.select("block").scalar()
        pre, post = _fill(FEW_SHOT_TEMPLATE, cats, k, block)
    return df.withColumn(out, F.concat(*pre, F.coalesce(q(text), F.lit("")), *post))


def call_model(df: DataFrame, col: str, fn: Callable[[str], str], out: str = "response",
               partitions: int | None = None) -> DataFrame:
    """Apply an external per-text function in Arrow batches; a failing row gives '' (Q7).

    ``fn`` is supplied by the caller (a client for a model service); it is
    shipped to the executors once per task.  ``partitions`` spreads slow
    calls over more tasks.
    """
    schema = StructType([*df.schema.fields, StructField(out, StringType())])  # a new type: df.schema itself is shared

    def run(batches):
        for pdf in batches:
            res = []
            for v in pdf[col].tolist():
                try:
                    res.append("" if v is None else str(fn(v)))
                except Exception:  # noqa: BLE001
                    res.append("")
            pdf = pdf.copy()
            pdf[out] = pd.Series(res, index=pdf.index, dtype="object")
            yield pdf

    src = df.repartition(partitions) if partitions else df
    return src.mapInPandas(run, schema)
