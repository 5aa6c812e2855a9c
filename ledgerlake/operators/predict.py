"""Counter-account prediction: TF-IDF cosine over weighted field tokens, k nearest, vote with abstention."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of the method: field weights, neighbours, bonus, half-life in days, thresholds.
WEIGHTS = {"payee": 3.0, "narration": 1.5, "account": 0.75, "metadata": 0.5, "sign": 0.5}


@dataclass(frozen=True)
class Config:
    k: int = 10
    bonus: float = 0.25
    half_life: float = 365.0
    min_confidence: float = 0.30
    min_margin: float = 0.10
    min_support: int = 1


_CJK = re.compile(r"[぀-ヿ㐀-䶿一-鿿가-힯]")
_WORD = re.compile(r"\d+|[^\W\d_]+")


def tokenize(text: str | None) -> list[str]:
    """NFKC and case folding; words, a placeholder for digits, 1- and 2-grams of CJK runs."""
    out: list[str] = []
    for w in _WORD.findall(unicodedata.normalize("NFKC", text or "").casefold()):
        if w[0].isdigit():
            out.append("<n>")
        elif _CJK.search(w):
            out += [*w, *(w[i : i + 2] for i in range(len(w) - 1))]
        else:
            out.append(w)
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def tokens(s: pd.Series) -> pd.Series:
    return s.map(tokenize)


def term_counts(df: DataFrame, key: str, fields: dict[str, Column], weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """key, term (field:token), tf (weighted count)."""
    named = lambda f: lambda t: F.struct(F.concat(F.lit(f + ":"), t).alias("term"), F.lit(weights.get(f, 1.0)).alias("w"))
    each = [F.transform(c, named(f)) for f, c in fields.items()]
    rows = df.select(key, F.explode(F.flatten(F.array(*each))).alias("x"))
    return rows.groupBy(key, F.col("x.term").alias("term")).agg(F.sum("x.w").alias("tf"))


def idf(train: DataFrame, key: str, n: int) -> DataFrame:
    """term, idf = ln((1 + n) / (1 + df)) + 1."""
    return train.groupBy("term").agg((F.log((F.lit(1.0) + n) / (F.lit(1.0) + F.count("*"))) + 1).alias("idf"))


def unit_vectors(terms: DataFrame, weights: DataFrame, key: str) -> DataFrame:
    """key, term, w with norm 1; terms unknown in training weigh as never seen and so match nothing."""
    w = terms.join(weights, "term").withColumn("w", F.col("tf") * F.col("idf"))
    norm = w.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("_n"))
    return w.join(norm, key).select(key, "term", (F.col("w") / F.col("_n")).alias("w"))


def neighbours(queries: DataFrame, corpus: DataFrame, q: str, c: str) -> DataFrame:
    """q, c, cosine of pairs that share a term."""
    return queries.join(corpus.withColumnRenamed("w", "v"), "term").groupBy(q, c).agg(F.sum(F.col("w") * F.col("v")).alias("cosine"))


def training_rows(postings: DataFrame, opens: DataFrame, closes: DataFrame, names: tuple[str, ...] = ("Assets", "Liabilities")) -> DataFrame:
    """Of two-posting transactions: seq, date, payee, narration, account (known side), label, number, currency."""
    per = postings.where("number is not null").groupBy("seq").agg(F.count("*").alias("n"))
    two = postings.join(per.where("n = 2"), "seq")
    a = two.select("seq", "idx", "date", "payee", "narration", "account", "number", "currency")
    b = two.select("seq", F.col("idx").alias("i2"), F.col("account").alias("label"))
    side = lambda c: F.substring_index(c, ":", 1).isin(*names)
    both = a.join(b, "seq").where("idx <> i2").where(side("account") | ~side("label"))
    still_open = opens.select("account").join(closes.select("account"), "account", "left_anti").withColumnRenamed("account", "label")
    return both.join(still_open, "label", "left_semi").drop("i2", "idx")


def features(rows: DataFrame, key: str) -> DataFrame:
    parts = F.split("account", ":")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), ":"))
    sign = F.array(F.when(F.col("number") < 0, "-").otherwise("+"))
    return term_counts(rows, key, {"payee": tokens("payee"), "narration": tokens("narration"), "account": prefixes, "sign": sign})


def classes(terms: DataFrame, key: str, name: str) -> tuple[DataFrame, DataFrame]:
    """Rows with equal terms as one class: (key, ``name``), (``name``, term, tf)."""
    whole = terms.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("term", "tf"))).alias("v")).withColumn(name, F.sha2(F.to_json("v"), 256))
    return whole.select(key, name), whole.groupBy(name).agg(F.first("v").alias("v")).select(name, F.explode("v").alias("x")).select(name, "x.term", "x.tf")


def _rank(rows: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= k).drop("_r")


def vote(pairs: DataFrame, train: DataFrame, asked: DataFrame, q: str, c: str, config: Config = Config()) -> DataFrame:
    """q, label, confidence, margin of queries that don't abstain.

    pairs: qv, cv, cosine of classes; train: c, cv, label, date, number, currency; asked: q, qv, date, number, currency.
    Within a class and label only age and the bonus for equal amounts set rows apart: the k newest of each, and the
    k newest of each amount, hold the k nearest of every query.
    """
    support = train.groupBy("label").agg(F.count("*").alias("support")).where(F.col("support") >= config.min_support)
    t = train.join(support, "label").select(c, "cv", "label", F.col("date").alias("t_date"), F.abs("number").alias("amount"), "currency")
    pairs = pairs.where("cosine > 0")
    newest = [F.col("t_date").desc(), F.col(c)]
    ranks = [F.col("adj").desc(), F.col("t_date").desc(), F.col("label"), F.col(c)]
    asked = asked.withColumn("amount", F.abs("number")).drop("number")

    def adjusted(rows, bonus):
        age = F.greatest(F.datediff("date", "t_date"), F.lit(0))
        return rows.withColumn("adj", (F.col("cosine") + F.lit(bonus)) * F.pow(F.lit(2.0), -age / config.half_life))

    base = _rank(t, ["cv", "label"], newest, config.k).withColumnsRenamed({"amount": "t_n", "currency": "t_c"})
    days = adjusted(asked.select("qv", "date").distinct().join(pairs, "qv").join(base, "cv"), 0.0)
    days = _rank(days, ["qv", "date"], ranks, config.k).drop("cv").withColumnsRenamed({"qv": "d_v", "date": "d_d"})
    same = F.coalesce((F.col("amount") == F.col("t_n")) & (F.col("currency") == F.col("t_c")), F.lit(False))
    unequal = asked.join(days, (F.col("qv") == F.col("d_v")) & F.col("date").eqNullSafe(F.col("d_d"))).where(~same)
    equal = _rank(t.where("amount is not null and currency is not null"), ["cv", "label", "amount", "currency"], newest, config.k)
    equal = adjusted(asked.join(equal, ["amount", "currency"]).join(pairs, ["qv", "cv"]), config.bonus)
    columns = [q, c, "label", "t_date", "cosine", "adj"]
    top = _rank(unequal.select(*columns).unionByName(equal.select(*columns)), [q], ranks, config.k)
    votes = top.groupBy(q, "label").agg(F.sum("adj").alias("v"), F.max("cosine").alias("confidence"), F.max("t_date").alias("newest"))
    order = Window.partitionBy(q).orderBy(F.col("v").desc(), F.col("newest").desc(), "label")
    ranked = votes.withColumn("_r", F.row_number().over(order)).withColumn("_next", F.lead("v").over(order))
    margin = F.when(F.col("_next").isNull(), 1.0).otherwise((F.col("v") - F.col("_next")) / F.col("v"))
    best = ranked.where("_r = 1").withColumn("margin", margin)
    return best.where((F.col("confidence") >= config.min_confidence) & (F.col("margin") >= config.min_margin)).select(q, "label", "confidence", "margin")


def predict(train: DataFrame, asked: DataFrame, config: Config = Config()) -> DataFrame:
    """seq, label, confidence, margin for transactions with one known side (seq, date, payee, narration, account, number, currency)."""
    t, a = train.withColumnRenamed("seq", "c"), asked.withColumnRenamed("seq", "q")
    tf = features(t, "c")
    weights = idf(tf, "c", t.select("c").distinct().count())
    (t_class, t_terms), (a_class, a_terms) = classes(tf, "c", "cv"), classes(features(a, "q"), "q", "qv")
    pairs = neighbours(unit_vectors(a_terms, weights, "qv"), unit_vectors(t_terms, weights, "cv"), "qv", "cv")
    return vote(pairs, t.join(t_class, "c"), a.select("q", "date", "number", "currency").join(a_class, "q"), "q", "c", config).withColumnRenamed("q", "seq")


def classify(df: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """``counter``: the account of the first rule (field, regex, account) that matches."""
    out = F.lit(None).cast("string")
    for name, rx, account in reversed(rules):
        out = F.when(F.regexp_like(F.col(name), F.lit(rx)), account).otherwise(out)
    return df.withColumn("counter", out)
