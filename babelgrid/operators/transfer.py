"""Train on every language, score on every language, in one plan.

The model is multinomial Naive Bayes with Laplace smoothing, one model per
(task, transfer language), trained by grouped counts:

    log P(c | d) ~ log prior(c) + sum_{w in d, w in V} tf(w) * log((n(c, w) + 1) / (n(c) + |V|))

which is rewritten so that only non-zero counts are ever stored or joined:

    = log prior(c) + sum tf * log(1 + n(c, w))  -  N_V(d) * log(n(c) + |V|)

with ``N_V(d)`` the number of tokens of ``d`` that are in the vocabulary.  The
per-token weight table therefore never needs a (token x class) completion.

A document's tokens are counted in its row.  The weights of a token are one row
with the counts of all languages.  Weights whose size is below the session's
threshold are broadcast.  Beyond it the most frequent tokens of the scored
documents, found by a mergeable sketch of bounded size, meet their weights in a
broadcast and are summed to one row per document and language before anything
is shuffled; the rest, which few languages share, are joined by token.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixtures import transfer_languages, with_transfer_languages
from ..functions.text import ws_tokens
from ..session import materialize
from .classification import argmax, classification_grid
from .joins import fits_broadcast, join_dim

#: Tokens of a task whose weights are broadcast: a bound on what is sent, times languages and classes.
HOT_TOKENS = 1024
#: Items that the sketch of frequent tokens tracks per task.
SKETCH_ITEMS = 32_768


# Generators below use the *_outer form plus an explicit null filter: the plain
# form makes the optimizer infer ``size(array) > 0`` and push it below the
# projection, which tokenizes every text twice.


def doc_tokens(c) -> F.Column:
    """The Spark-native tokenizer of the engine: lower-case, split on white space."""
    return ws_tokens(F.lower(c if not isinstance(c, str) else F.col(c)))


@dataclass
class NaiveBayesModel:
    weights: DataFrame        # task, token, per_lang array<struct<transfer_lang, counts array<long>[K]>>
    class_stats: DataFrame    # task, transfer_lang, logprior array<double>[K], logden array<double>[K]
    num_classes: int


def token_bag(tokens: F.Column) -> F.Column:
    """Array of tokens to an array of (token, tf): the runs of the sorted tokens, linear after the sort."""
    def runs(t: F.Column) -> F.Column:
        at = F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda i: (i == 0) | (F.get(t, i) != F.get(t, i - 1)))
        bag = F.transform(F.array(at), lambda s: F.zip_with(
            s, F.concat(F.slice(s, 2, F.size(s)), F.array(F.size(t))),
            lambda i, j: F.struct(F.get(t, i).alias("token"), (j - i).cast("long").alias("tf"))))[0]
        return F.when(F.size(t) > 0, bag)

    # one-element arrays: the tokens and the runs' starts are made once
    return F.transform(F.array(F.array_sort(tokens)), runs)[0]


def frequent_tokens(bags: DataFrame, most: int = HOT_TOKENS, items: int = SKETCH_ITEMS) -> DataFrame:
    """(task, token): per task about the ``most`` tokens that most documents have.

    A frequent-items sketch, merged over tasks: a token in more than a
    ``3.5 / items`` share of all pairs is always tracked, however the rows lie.
    """
    tokens = bags.select("task", F.explode_outer("bag.token").alias("token")).filter(F.col("token").isNotNull())
    top = tokens.groupBy("task").agg(F.expr(f"approx_top_k(token, {int(most)}, {int(items)})").alias("top"))
    return top.select("task", F.explode("top.item").alias("token"))


def train_naive_bayes(train: DataFrame, num_classes: int, persist: bool = True) -> NaiveBayesModel:
    """``train``: task, lang, label (0..K-1), text.  One model per (task, lang)."""
    k = range(num_classes)
    toks = train.select("task", F.col("lang").alias("transfer_lang"), "label", F.explode_outer(doc_tokens("text")).alias("token")) \
        .filter(F.col("token").isNotNull())
    counts = toks.groupBy("task", "transfer_lang", "token").agg(
        *[F.count(F.when(F.col("label") == i, F.lit(1))).alias(f"n{i}") for i in k])
    # one row per token, as long as the list of languages that know it
    weights = counts.groupBy("task", "token").agg(F.collect_list(F.struct(
        "transfer_lang", F.array(*[F.col(f"n{i}") for i in k]).alias("counts"))).alias("per_lang"))
    if persist:
        weights = materialize(weights, "nb_weights")
    per_lang = weights.select("task", F.explode("per_lang").alias("w")).groupBy("task", "w.transfer_lang").agg(
        F.count(F.lit(1)).alias("v"), *[F.sum(F.col("w.counts")[i]).alias(f"t{i}") for i in k])
    docs = train.groupBy("task", F.col("lang").alias("transfer_lang")).agg(
        F.count(F.lit(1)).alias("nd"), *[F.count(F.when(F.col("label") == i, F.lit(1))).alias(f"d{i}") for i in k])
    # a language whose training texts have no token keeps its priors
    st = docs.join(per_lang, ["task", "transfer_lang"], "left").fillna(0, ["v", *[f"t{i}" for i in k]])
    logprior = F.array(*[F.when(F.col(f"d{i}") > 0, F.log(F.col(f"d{i}") / F.col("nd"))) for i in k])
    logden = F.array(*[F.log(F.col(f"t{i}") + F.col("v")) for i in k])
    class_stats = st.select("task", "transfer_lang", logprior.alias("logprior"), logden.alias("logden"))
    return NaiveBayesModel(weights, class_stats, num_classes)


def predict_naive_bayes(model: NaiveBayesModel, test: DataFrame, langs: DataFrame) -> DataFrame:
    """Score every test row with the model of every transfer language.

    ``test``: task, lang, id, label, text.  Returns task, transfer_lang,
    task_lang, id, label, pred.
    """
    k = range(model.num_classes)
    keys = ["task", "lang", "id", "label"]
    tokens = doc_tokens("text")
    if fits_broadcast(model.weights):
        # one row per occurrence: the sums collapse a document before the shuffle
        toks = test.select(*keys, F.explode_outer(tokens).alias("token"), F.lit(1).cast("long").alias("tf")) \
            .filter(F.col("token").isNotNull())
        parts = [toks.join(F.broadcast(model.weights), ["task", "token"])]
    else:
        bags = materialize(test.select(*keys, token_bag(tokens).alias("bag")), "nb_bags")
        toks = bags.select(*keys, F.explode_outer("bag").alias("x")).filter(F.col("x").isNotNull()) \
            .select(*keys, "x.token", "x.tf")
        # hot tokens without weights stay in, so that they are not looked for again
        hot = materialize(frequent_tokens(bags).join(model.weights, ["task", "token"], "left"), "nb_hot")
        parts = [toks.join(F.broadcast(hot), ["task", "token"]),
                 toks.join(F.broadcast(hot.select("task", "token")), ["task", "token"], "left_anti")
                 .join(model.weights, ["task", "token"])]
    hits = [p.select(*keys, "tf", F.explode("per_lang").alias("w")).select(*keys, "w.transfer_lang", "tf", "w.counts")
            for p in parts]
    # every (row, transfer language) pair exists even with no known token
    base = with_transfer_languages(test.select(*keys), langs) \
        .select(*keys, "transfer_lang", F.lit(0).cast("long").alias("tf"), F.lit(None).cast("array<bigint>").alias("counts"))
    agg = reduce(DataFrame.unionByName, hits, base).groupBy(*keys, "transfer_lang").agg(
        F.sum("tf").alias("nv"), *[F.sum(F.col("tf") * F.log1p(F.col("counts")[i])).alias(f"a{i}") for i in k])
    scored = join_dim(agg, model.class_stats, ["task", "transfer_lang"])
    score = F.array(*[F.col("logprior")[i] + F.coalesce(F.col(f"a{i}"), F.lit(0.0)) - F.col("nv") * F.col("logden")[i] for i in k])
    return scored.select("task", "transfer_lang", F.col("lang").alias("task_lang"), "id", "label",
                         argmax(score).alias("pred"))


def transfer_grid(examples: DataFrame, num_classes: int, persist: bool = True) -> DataFrame:
    """Flagship: (task_lang, transfer_lang, accuracy, f1_score) for all pairs.

    ``examples``: task, lang, split, id, label, text.
    """
    train = examples.filter(F.col("split") == "train")
    test = examples.filter(F.col("split") == "test")
    model = train_naive_bayes(train, num_classes, persist)
    preds = predict_naive_bayes(model, test, transfer_languages(examples))
    g = classification_grid(preds, ["task", "task_lang", "transfer_lang"])
    return g.select("task_lang", "transfer_lang", "accuracy", "f1_score")
