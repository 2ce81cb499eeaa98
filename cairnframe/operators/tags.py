"""Tag operators: histograms, n-grams, dictionary matches, keyword statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tag_hist(df: DataFrame, tags: str, blacklist: list[str] | None = None, min_count: int = 0) -> DataFrame:
    """tag, n for each tag that occurs at least min_count times."""
    out = df.select(F.explode(tags).alias("tag"))
    if blacklist:
        out = out.where(~F.col("tag").isin(blacklist))
    return out.groupBy("tag").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def keep_common_tags(df: DataFrame, key: str, tags: str, min_count: int = 2) -> DataFrame:
    """Per row, the tags that occur at least min_count times in the table; the number of them.

    The counts are joined to exploded tags, so their number does not matter.
    """
    rows = df.select(key, F.explode(tags).alias("tag"))
    common = rows.groupBy("tag").agg(F.count("*").alias("_n")).where(F.col("_n") >= min_count).select("tag")
    kept = rows.join(common, "tag").groupBy(key).agg(F.array_sort(F.collect_list("tag")).alias("tags"))
    none = F.array().cast("array<string>")
    return df.select(key).join(kept, key, "left").select(key, F.coalesce("tags", none).alias("tags")).withColumn("n_tags", F.size("tags"))


def ngrams(words: Column, most: int = 3) -> Column:
    """All n-grams of 1 to `most` words, as text."""
    n, none = F.size(words), F.array().cast("array<string>")

    def of(k: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1)))
        return F.when(n >= k, F.transform(starts, lambda i: F.array_join(F.slice(words, i, k), " "))).otherwise(none)

    return F.concat(*map(of, range(1, most + 1)))


def exploded_ngrams(df: DataFrame, keys: list[str], words: str, most: int) -> DataFrame:
    """keys, ngram: a row for each n-gram of 1 to `most` words.  Words are numbered and their followers found by position,
    one list for each n, so the work grows with the words and not with their square."""
    rows = df.select(*keys, words, F.posexplode(words).alias("_i", "_x"))
    gram = lambda n: F.when(F.col("_i") + n <= F.size(words), F.array_join(F.slice(words, F.col("_i") + 1, n), " "))
    return rows.select(*keys, F.explode(F.array(*[gram(n) for n in range(1, most + 1)])).alias("ngram")).where("ngram is not null")


def ngram_weights(df: DataFrame, key: str, words: str, most: int = 3) -> DataFrame:
    """key, ngram, weight: the share of the row's n-grams."""
    rows = df.select(key, F.explode(ngrams(F.col(words), most)).alias("ngram"))
    counts = rows.groupBy(key, "ngram").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(key))
    return counts.select(key, "ngram", "n", (F.col("n") / total).alias("weight"))


#: Common English words that are no tags by themselves.
STOP_WORDS = (
    "a about above after again against all am an and any are as at be because been before being below between both but by can did do does doing down during each few for from further had has"
    " have having he her here hers herself him himself his how i if in into is it its itself just me more most my myself no nor not now of off on once only or other our ours ourselves out over"
    " own same she should so some such than that the their theirs them themselves then there these they this those through to too under until up very was we were what when where which while who"
    " whom why will with you your yours yourself yourselves"
).split()
#: Characters that end a phrase.
PHRASE_END = r"[`=~!@#$%^*()_+\[\]{};\\:\"<,.|>?]"


def text_ngrams(df: DataFrame, key: str, text: Column, most: int = 5, stop: list[str] | None = None) -> DataFrame:
    """key, ngram, n, weight: n-grams of the lower-cased words of a text, over the ends of phrases too, without single
    stop words; the weight is the share of the row's n-grams."""
    words = F.filter(F.split(F.regexp_replace(F.lower(text), PHRASE_END, " "), r"\s+"), lambda w: w != "")
    rows = exploded_ngrams(df.select(key, words.alias("_w")), [key], "_w", most).where(~F.col("ngram").isin(STOP_WORDS if stop is None else stop))
    counts = rows.groupBy(key, "ngram").agg(F.count("*").alias("n"))
    return counts.select(key, "ngram", "n", (F.col("n") / F.sum("n").over(Window.partitionBy(key))).alias("weight"))


def dictionary_match(weights: DataFrame, key: str, dictionary: DataFrame, related: bool = True) -> DataFrame:
    """key, tag, weight: weights of n-grams found in a dictionary (term, tags, related), summed by each of its tags and,
    if asked, of its related tags."""
    own = F.concat("tags", F.coalesce("related", F.array().cast("array<string>"))) if related else F.col("tags")
    found = weights.join(F.broadcast(dictionary), weights["ngram"] == dictionary["term"])
    return found.select(key, F.explode(own).alias("tag"), "weight").groupBy(key, "tag").agg(F.sum("weight").alias("weight"))


def keyword_tags(df: DataFrame, key: str, texts: list[str], dictionary: DataFrame, blacklist: list[str] | None = None, most: int = 5) -> DataFrame:
    """df with tags: weighted tags (struct<tag, wt>, largest first) of its text columns joined by ` / `, found in a
    dictionary; empty where nothing is found."""
    text = F.concat_ws(" / ", *[F.when(F.col(c) != "", F.col(c)) for c in texts])
    found = dictionary_match(text_ngrams(df, key, text, most), key, dictionary)
    if blacklist:
        found = found.where(~F.col("tag").isin(blacklist))
    own = found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("n"), "tag"))).alias("_t"))
    own = own.select(key, F.transform("_t", lambda x: F.struct(x["tag"].alias("tag"), (-x["n"]).alias("wt"))).alias("tags"))
    return df.join(own, key, "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<struct<tag:string,wt:double>>")))


def master_keywords(df: DataFrame, keywords: str, blacklist: list[str], whitelist: list[str], least: int = 2) -> DataFrame:
    """keyword: lower-cased keywords of three characters or more that are not blacklisted and occur `least` times or are
    whitelisted."""
    rows = df.select(F.explode(keywords).alias("k")).select(F.lower(F.trim("k")).alias("keyword")).where(F.length("keyword") >= 3)
    if blacklist:
        rows = rows.where(~F.col("keyword").isin(blacklist))
    out = rows.groupBy("keyword").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("keyword")
    more = df.sparkSession.createDataFrame([(w.lower(),) for w in whitelist], "keyword string")
    return out.unionByName(more).distinct()


def found_keywords(df: DataFrame, key: str, text: Column, master: DataFrame, most: int = 3, unigrams: bool = False, stop: list[str] | None = None) -> DataFrame:
    """key, keyword: n-grams of 2 (or 1) to `most` words that are master keywords.  Phrases end at punctuation and at stop
    words, and n-grams stay inside a phrase."""
    phrases = F.split(F.regexp_replace(F.lower(text), PHRASE_END, "\u0001"), "\u0001")
    rows = df.select(key, F.posexplode(phrases).alias("p", "phrase")).select(key, "p", F.posexplode(F.filter(F.split("phrase", r"\s+"), lambda w: w != "")).alias("i", "w"))
    rows = rows.withColumn("_s", F.col("w").isin(STOP_WORDS if stop is None else stop).cast("int"))
    rows = rows.withColumn("g", F.sum("_s").over(Window.partitionBy(key, "p").orderBy("i"))).where("_s = 0")
    lists = rows.groupBy(key, "p", "g").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "w"))), lambda x: x["w"]).alias("words"))
    grams = lists.select(key, F.explode(ngrams(F.col("words"), most)).alias("keyword")).distinct()
    if not unigrams:
        grams = grams.where(F.col("keyword").contains(" "))
    return grams.join(master, "keyword", "left_semi").select(key, "keyword")


def sub_phrases(rows: DataFrame, key: str, master: DataFrame) -> DataFrame:
    """key, keyword: the keywords of a row and all shorter phrases inside them that are master keywords."""
    inner = rows.select(key, F.explode(ngrams(F.split("keyword", " "), 8)).alias("keyword")).join(master, "keyword", "left_semi")
    return rows.select(key, "keyword").unionByName(inner.select(key, "keyword")).distinct()


def regrouped_terms(mapping: DataFrame, term: str, group: str) -> tuple[DataFrame, DataFrame]:
    """From (group, terms): group, terms (distinct, in order) after terms are lower-cased and trimmed; and the terms that
    stand in several groups, with those groups."""
    rows = mapping.select(group, F.explode(term).alias("t")).select(group, F.lower(F.trim("t")).alias("t")).where("t <> ''").distinct()
    groups = rows.groupBy(group).agg(F.array_sort(F.collect_list("t")).alias(term))
    many = rows.groupBy("t").agg(F.array_sort(F.collect_list(group)).alias("groups")).where(F.size("groups") > 1)
    return groups, many


def parts_of_tags(tags: DataFrame, tag: str) -> DataFrame:
    """tag, kind: `unigram` for a tag that is a word of a longer tag, `bigram` for a tag of two words inside a longer one."""
    own = tags.select(F.col(tag).alias("tag")).distinct().withColumn("w", F.split("tag", " "))
    words = own.where(F.size("w") > 1).select(F.explode("w").alias("tag")).distinct()
    pairs = own.where(F.size("w") > 2).select(F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.array_join(F.slice("w", i, 2), " "))).alias("tag")).distinct()
    one = own.where(F.size("w") == 1).join(words, "tag", "left_semi").select("tag", F.lit("unigram").alias("kind"))
    return one.unionByName(own.where(F.size("w") == 2).join(pairs, "tag", "left_semi").select("tag", F.lit("bigram").alias("kind")))


def distinctive_keywords(df: DataFrame, cluster: str, keyword: str, importance: str, n: int, most_clusters: int = 2) -> DataFrame:
    """cluster, keywords: the n most important keywords of each cluster that occur at most most_clusters times in all."""
    often = df.groupBy(F.col(keyword).alias("_k")).agg(F.count("*").alias("_n")).where(F.col("_n") <= most_clusters)
    rows = df.join(often, df[keyword] == often["_k"], "left_semi")
    rank = F.row_number().over(Window.partitionBy(cluster).orderBy(F.desc(importance), keyword))
    top = rows.withColumn("_r", rank).where(F.col("_r") <= n)
    return top.groupBy(cluster).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", F.col(keyword).alias("k")))), lambda x: x["k"]).alias("keywords"))


def skill_scores(people: DataFrame, person: str, skill: str, skills: DataFrame, idf: DataFrame, threshold: float = 0.33) -> DataFrame:
    """Per person: skills, relevant skills, both weighted by idf, their ratios, the most frequent parent skill, and whether
    the ratio passes the threshold.  skills: skill, parent, relevant (0 or 1); idf: skill, idf."""
    rows = people.select(F.col(person).alias("person"), F.lower(F.col(skill)).alias("skill")).distinct().join(skills, "skill").join(idf, "skill", "left").na.fill(0.0, ["idf"])
    sums = rows.groupBy("person").agg(F.count("*").alias("n"), F.sum("relevant").alias("n_relevant"), F.sum("idf").alias("w"), F.sum(F.col("idf") * F.col("relevant")).alias("w_relevant"))
    parents = rows.groupBy("person", "parent").agg(F.count("*").alias("c")).groupBy("person").agg(F.min(F.struct((-F.col("c")).alias("c"), "parent"))["parent"].alias("top_parent"))
    ratio = F.col("n_relevant") / F.col("n")
    return sums.join(parents, "person").select("*", ratio.alias("ratio"), F.try_divide("w_relevant", "w").alias("weighted_ratio"), (ratio > threshold).alias("relevant"))


def term_idf(df: DataFrame, terms: str) -> DataFrame:
    """term, df, idf = 1 + ln(rows / df + 1)."""
    total = df.agg(F.count("*").alias("_rows"))
    return df.select(F.explode(terms).alias("term")).groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(total)).select("term", "df", (1 + F.log(F.col("_rows") / F.col("df") + 1)).alias("idf"))


def keyword_entropy(df: DataFrame, tag: str, cluster: str) -> DataFrame:
    """Per tag: count, clusters, entropy over clusters (ln), and the largest entropy possible."""
    counts = df.groupBy(tag, cluster).agg(F.count("*").alias("c"))
    w = Window.partitionBy(tag)
    p = F.col("c") / F.sum("c").over(w)
    parts = counts.withColumn("e", -p * F.log(p))
    return parts.groupBy(tag).agg(F.sum("c").alias("n"), F.count("*").alias("n_clusters"), F.sum("e").alias("entropy")).withColumn("max_entropy", F.log("n_clusters"))


def cluster_names(df: DataFrame, tag: str, cluster: str, n: int = 5, least: int = 2, top: int = 10) -> DataFrame:
    """cluster, name, top_tags: of the `top` tags most over-represented in a cluster, count * sqrt(share in the cluster /
    share overall), those that are no single word inside another of them; the first n are the name.  Only tags that
    occur `least` times count."""
    often = df.groupBy(tag).agg(F.count("*").alias("_g")).where(F.col("_g") >= least)
    total = often.agg(F.sum("_g").alias("_all"))
    counts = df.groupBy(cluster, tag).agg(F.count("*").alias("_c")).join(often, tag)
    rows = counts.withColumn("_s", F.sum("_c").over(Window.partitionBy(cluster))).crossJoin(F.broadcast(total))
    ratio = (F.col("_c") / F.col("_s")) / (F.col("_g") / F.col("_all"))
    rows = rows.withColumn("_w", F.col("_c") * F.sqrt(ratio)).where(ratio > 1)
    rank = F.row_number().over(Window.partitionBy(cluster).orderBy(F.desc(F.round("_w", 6)), tag))
    best = rows.withColumn("_r", rank).where(F.col("_r") <= top)
    lists = best.groupBy(cluster).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", F.col(tag).alias("t")))), lambda x: x["t"]).alias("_t"))
    inside = F.flatten(F.transform(F.filter("_t", lambda x: x.contains(" ")), lambda x: F.split(x, " ")))
    kept = F.filter("_t", lambda x: ~F.array_contains(F.col("_inside"), x))
    out = lists.withColumn("_inside", inside).withColumn("_t", kept)
    return out.select(cluster, F.array_join(F.slice("_t", 1, n), ", ").alias("name"), F.array_join("_t", ", ").alias("top_tags"))


def explode_chunks(df: DataFrame, key: str, chunks: Column) -> DataFrame:
    """key, position (from 0 among what is kept), chunk; chunks of up to three spaces go."""
    kept = F.filter(chunks, lambda c: ~c.isin("", " ", "  ", "   "))
    return df.select(key, F.posexplode(kept).alias("position", "chunk"))
