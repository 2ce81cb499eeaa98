"""Steps around models that are passed in as functions: prompts, replies, filters, and the classifier trained here."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .services import cached_results


def numbered(texts: Column, label: str = "Description") -> Column:
    """The texts that are not empty, numbered and apart by blank lines."""
    kept = F.filter(texts, lambda t: t.isNotNull() & (F.trim(t) != ""))
    return F.array_join(F.transform(kept, lambda t, i: F.concat(F.lit(f"{label} "), (i + 1).cast("string"), F.lit("\n"), t)), "\n\n")


def pair_prompts(pairs: DataFrame, entity_text: str, category: str, definition: str, examples: list[tuple[str, bool]] | None = None) -> DataFrame:
    """pairs with `prompt`: the question whether a text belongs to a category, after examples with their answers."""
    shown = "".join(f"Text: {t}\nAnswer: {'yes' if a else 'no'}\n\n" for t, a in examples or [])
    return pairs.withColumn("prompt", F.concat(F.lit(shown), F.lit("Category: "), F.col(category), F.lit("\n"), F.col(definition), F.lit("\nText: "), F.col(entity_text), F.lit("\nAnswer:")))


def fewshot_filter(pairs: DataFrame, entity: str, category: str, prompt: str, cache: DataFrame, call: Callable[[str], str], parents: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Pairs whose reply begins with yes, and for entities without any, their forced parents (entity, category) if
    given; and the new cache."""
    keyed = pairs.withColumn("pair", F.concat_ws("|", F.col(entity).cast("string"), category))
    answers, cache = cached_results(keyed, cache, "pair", prompt, call)
    good = keyed.join(answers.where(F.lower(F.trim("response")).startswith("yes")).select("pair").distinct(), "pair", "left_semi").drop("pair", prompt)
    if parents is not None:
        lost = pairs.select(entity).distinct().join(good.select(entity).distinct(), entity, "left_anti")
        good = good.select(entity, category).unionByName(parents.join(lost, entity, "left_semi").select(entity, category))
    return good, cache


def predictions(answers: DataFrame, key: str, labels: list[str], overrides: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Valid predictions (key, label, probability), with manual overrides (key, label) first, and what is no label.
    answers: key, response, logprob."""
    clean = answers.withColumn("label", F.trim("response"))
    valid = clean.where(F.col("label").isin(labels)).select(key, "label", F.exp("logprob").alias("probability"))
    wrong = clean.where(~F.coalesce(F.col("label").isin(labels), F.lit(False))).select(key, "response")
    if overrides is not None:
        own = overrides.select(key, "label", F.lit(1.0).alias("probability"))
        valid = valid.join(own, key, "left_anti").unionByName(own)
        wrong = wrong.join(own, key, "left_anti")
    return valid, wrong


def chunk_numbers(df: DataFrame, key: str, size: int) -> DataFrame:
    """df with `chunk`: rows in order of the key, `size` to a chunk."""
    spark = df.sparkSession
    ranges = df.select(key).repartitionByRange(key).sortWithinPartitions(key).withColumn("_p", F.spark_partition_id())
    from ..sources.shared import keep

    ranges = keep(ranges.withColumn("_i", F.monotonically_increasing_id() - F.shiftleft(F.col("_p").cast("long"), 33)))
    counts = {r["_p"]: r["n"] for r in ranges.groupBy("_p").agg(F.count("*").alias("n")).collect()}  # one row a partition
    before, total = {}, 0
    for p in sorted(counts):
        before[p], total = total, total + counts[p]
    starts = spark.createDataFrame(list(before.items()) or [(0, 0)], "_p int, _b long")
    numbers = ranges.join(F.broadcast(starts), "_p").select(F.col(key).alias("_k"), F.floor((F.col("_b") + F.col("_i")) / size).cast("long").alias("chunk"))
    return df.join(numbers, df[key] == numbers["_k"]).drop("_k")


def geotags(answers: DataFrame, key: str) -> DataFrame:
    """key, tags: the entities of replies `{"locations": [{"metadatas": [{"entity": ...}]}]}`, fences off, a comma before
    the end repaired; null where the reply is none."""
    from ..functions.profile import parse_reply

    parsed = parse_reply(F.col("response"), "locations array<struct<metadatas: array<struct<entity: string>>>>")
    names = F.flatten(F.transform(parsed["locations"], lambda x: F.transform(x["metadatas"], lambda m: m["entity"])))
    return answers.select(key, F.array_distinct(F.filter(names, lambda n: n.isNotNull() & (n != ""))).alias("tags"))


def geocoded(rows: DataFrame, address: str, cache: DataFrame, call: Callable[[str], str], longest: int = 100) -> tuple[DataFrame, DataFrame]:
    """rows with lat, lon and country of their addresses, asked once for each; long addresses are keyed by their
    version-5 identifier."""
    from ..functions.profile import parse_reply
    from ..functions.text import uuid5

    name = F.when(F.length(address) > longest, uuid5(F.col(address))).otherwise(F.col(address))
    keyed = rows.withColumn("address_key", name)
    answers, cache = cached_results(keyed.where(F.col(address) != "").select("address_key", F.col(address).alias("_a")).dropDuplicates(["address_key"]), cache, "address_key", "_a", call)
    place = parse_reply(F.col("response"), "lat double, lon double, country string")
    got = answers.select(F.col("address_key").alias("_k"), place["lat"].alias("lat"), place["lon"].alias("lon"), place["country"].alias("country"))
    return keyed.join(got, keyed["address_key"] == got["_k"], "left").drop("_k", "address_key"), cache


def reply_or_text(c: Column, schema: str) -> tuple[Column, Column]:
    """A reply parsed as JSON without its fence, and the bare text where it is no JSON."""
    from ..functions.profile import parse_reply

    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(c), r"^```[a-z]*\s*", ""), r"\s*```$", ""))
    return parse_reply(c, schema), F.when(F.try_parse_json(bare).isNull(), bare)


def expand_terms(start: str, call: Callable[[str], list[str]], rounds: int = 5, least_new: float = 0.1) -> list[str]:
    """A term and what a model adds to it, asked again for each round's new terms, until a round adds nothing or too
    small a part of what it returns is new."""
    known, latest = [start], [start]
    for _ in range(rounds):
        got = [t.strip().lower() for x in latest for t in call(x) if t.strip()]
        new = [t for t in dict.fromkeys(got) if t not in known]
        if not new:
            break
        known += new
        if len(new) / len(got) < least_new:
            break
        latest = new
    return known


def central_texts(nodes: DataFrame, cluster: str, text: str, centrality: str, key: str, n: int = 20, weight: str | None = None) -> DataFrame:
    """cluster, prompt: the numbered texts of the n most central nodes of each cluster (times a weight, if given)."""
    score = F.col(centrality) * (F.col(weight) if weight else F.lit(1.0))
    top = nodes.withColumn("_r", F.row_number().over(Window.partitionBy(cluster).orderBy(F.desc(score), key))).where(F.col("_r") <= n)
    texts = F.transform(F.array_sort(F.collect_list(F.struct("_r", F.col(text).alias("t")))), lambda x: x["t"])
    return top.groupBy(cluster).agg(numbered(texts).alias("prompt"))


class OrgTypes:
    """A text model (naive Bayes over hashed 1- to 3-grams with idf) and a logistic model over categories and its answer;
    rules go over their answers."""

    def __init__(self, text: str, label: str, categories: list[str], features: int = 1 << 14, rounds: int = 20):
        self.text, self.label, self.categories, self.features, self.rounds = text, label, categories, features, rounds

    def _terms(self, df: DataFrame, *more: Column) -> DataFrame:
        from pyspark.ml.feature import NGram

        words = F.filter(F.split(F.lower(F.coalesce(F.col(self.text), F.lit(""))), r"\W+"), lambda w: w != "")
        rows = df.select("*", words.alias("_w1"), *more)
        for n in (2, 3):
            rows = NGram(n=n, inputCol="_w1", outputCol=f"_w{n}").transform(rows)
        return rows.withColumn("_terms", F.concat("_w1", "_w2", "_w3")).drop("_w1", "_w2", "_w3")

    def fit(self, df: DataFrame) -> OrgTypes:
        from pyspark.ml import Pipeline
        from pyspark.ml.classification import LogisticRegression, NaiveBayes
        from pyspark.ml.feature import IDF, HashingTF, OneHotEncoder, StringIndexer, VectorAssembler

        from ..sources.shared import keep

        rows = self._terms(df, F.col(self.label).cast("double").alias("_y"))
        self.tf = HashingTF(numFeatures=self.features, inputCol="_terms", outputCol="_tf")
        counted = keep(self.tf.transform(rows).drop("_terms", self.text))
        terms = [IDF(inputCol="_tf", outputCol="_x"), NaiveBayes(featuresCol="_x", labelCol="_y", predictionCol="_text", probabilityCol="_tp", rawPredictionCol="_tr")]
        self.first = Pipeline(stages=terms).fit(counted)
        index = [StringIndexer(inputCol=c, outputCol=f"_i_{c}", handleInvalid="keep") for c in self.categories]
        coded = OneHotEncoder(inputCols=[f"_i_{c}" for c in self.categories], outputCols=[f"_o_{c}" for c in self.categories], handleInvalid="keep")
        join = VectorAssembler(inputCols=["_text", *[f"_o_{c}" for c in self.categories]], outputCol="_z")
        second = LogisticRegression(featuresCol="_z", labelCol="_y", predictionCol="prediction", probabilityCol="_p", rawPredictionCol="_r", maxIter=self.rounds, regParam=1e-3)
        self.second = Pipeline(stages=[*index, coded, join, second]).fit(keep(self.first.transform(counted).drop("_tf", "_x", "_tp", "_tr")))
        return self

    def predict(self, df: DataFrame, key: str, never: Column, always: Column) -> DataFrame:
        """key, prediction: 0 where `never` holds, else 1 where `always` holds, else the model's."""
        rows = self._terms(df, never.alias("_never"), always.alias("_always"))
        got = self.second.transform(self.first.transform(self.tf.transform(rows)))
        return got.select(key, F.when(F.col("_never"), 0.0).when(F.col("_always"), 1.0).otherwise(F.col("prediction")).alias("prediction"))


def summaries(rows: DataFrame, key: str, texts: list[str], cache: DataFrame, call: Callable[[str], str], fallback: str | None = None) -> tuple[DataFrame, DataFrame]:
    """rows with `summary`: a model's reply to their numbered texts, null where they have none or it fails; then the
    text of the fallback column if one is named."""
    asked = rows.withColumn("_p", numbered(F.array(*[F.col(t) for t in texts])))
    answers, cache = cached_results(asked.where(F.col("_p") != "").select(key, "_p"), cache, key, "_p", call)
    out = rows.join(answers.withColumnRenamed("response", "summary"), key, "left")
    return out.withColumn("summary", F.coalesce("summary", fallback)) if fallback else out, cache


def translated(rows: DataFrame, key: str, columns: list[str], language: str, cache: DataFrame, call: Callable[[str], str], target: str = "en") -> tuple[DataFrame, DataFrame]:
    """rows whose texts in another language are a model's translations, where there are any; and the new cache.  Each
    column of a row is asked for by itself."""
    far = rows.where(F.coalesce(F.col(language), F.lit(target)) != target)
    asked = None
    for c in columns:
        part = far.where(F.col(c) != "").select(F.concat_ws("|", F.col(key).cast("string"), F.lit(c)).alias("id"), F.col(c).alias("_t"))
        asked = part if asked is None else asked.unionByName(part)
    answers, cache = cached_results(asked, cache, "id", "_t", call)
    for c in columns:
        got = answers.where(F.col("id").endswith(f"|{c}")).select(F.regexp_extract("id", r"^(.*)\|", 1).alias("_k"), F.col("response").alias("_r"))
        rows = rows.join(got, rows[key].cast("string") == got["_k"], "left").withColumn(c, F.coalesce("_r", c)).drop("_k", "_r")
    return rows, cache
