"""Organisations, people and investors from several sources: merges, children, lookups and status rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import fuzzy_names


def merge_profiles(left: DataFrame, right: DataFrame, key: str, fill: list[str], unions: list[str], mapped: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """left with a profile of the same key: columns in `fill` are left's unless null or empty, then the profile's; columns
    in `unions` are lists, united without repeats; values of `mapped` columns of the profile are renamed first.  Other
    columns of the profile are added where left has none of the name."""
    r = right
    for c, names in (mapped or {}).items():
        table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
        r = r.withColumn(c, F.coalesce(F.try_element_at(table, F.col(c)), F.col(c)))
    r = r.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_r_{c}") for c in r.columns if c != key])
    out = left.join(r, left[key] == r["_k"], "left")
    for c in [c for c in right.columns if c != key]:
        theirs = F.col(f"_r_{c}")
        if c in unions:
            none = F.array().cast("array<string>")
            out = out.withColumn(c, F.array_sort(F.array_distinct(F.concat(F.coalesce(c, none), F.coalesce(theirs, none)))))
        elif c in left.columns:
            if c in fill:
                out = out.withColumn(c, F.when(F.col(c).isNull() | (F.col(c).cast("string") == ""), theirs).otherwise(F.col(c)))
        else:
            out = out.withColumn(c, theirs)
    return out.drop("_k", *[f"_r_{c}" for c in right.columns if c != key])


def combine_sources(first: DataFrame, second: DataFrame, key: list[str], kinds: str, names: dict[str, str], order: list[str]) -> DataFrame:
    """Both sources by column name, missing columns null; values of `kinds` renamed; one row of each key, the first in
    order of the first source, then of the second."""
    both = first.withColumn("_s", F.lit(0)).unionByName(second.withColumn("_s", F.lit(1)), allowMissingColumns=True)
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    both = both.withColumn(kinds, F.coalesce(F.try_element_at(table, F.col(kinds)), F.col(kinds)))
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("_s", *order))
    return both.withColumn("_n", rank).where("_n = 1").drop("_n", "_s")


def children(parents: DataFrame, key: str, rows: DataFrame, parent: str, identity: str, fields: list[str], order: list[str], name: str) -> DataFrame:
    """parents with a list of child structs, one for each identity (the first in order), in order; null where none."""
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy(parent, identity).orderBy(*order))).where("_n = 1")
    items = F.array_sort(F.collect_list(F.struct(*[F.col(o).alias(f"_o{k}") for k, o in enumerate(order)], *[F.col(f) for f in fields])))
    lists = first.groupBy(F.col(parent).alias("_k")).agg(items.alias("_i"))
    kept = F.transform("_i", lambda x: F.struct(*[x[f].alias(f) for f in fields]))
    return parents.join(lists.select("_k", kept.alias(name)), parents[key] == F.col("_k"), "left").drop("_k")


def distinct_children(parents: DataFrame, lists: str, identity: str, fields: list[str]) -> DataFrame:
    """The structs of all parents' lists, one for each identity (the least by its fields)."""
    rows = parents.select(F.explode(lists).alias("c")).select(F.col(f"c.{identity}").alias(identity), F.struct(*[F.col(f"c.{f}").alias(f) for f in fields]).alias("s"))
    return rows.where(F.col(identity).isNotNull()).groupBy(identity).agg(F.min("s").alias("s")).select(identity, *[F.col(f"s.{f}").alias(f) for f in fields if f != identity])


def with_aggregates(main: DataFrame, key: str, parts: list[tuple[DataFrame, str, list[Column]]]) -> DataFrame:
    """main with aggregates of several tables, each by its own key, joined one after the other."""
    for table, own, aggs in parts:
        got = table.groupBy(F.col(own).alias("_k")).agg(*aggs)
        main = main.join(got, main[key] == got["_k"], "left").drop("_k")
    return main


def has_member(c: Column, field: str, values: list[str]) -> Column:
    """Whether a list of structs holds one whose field, a value or a list of values, is one of the values."""
    own = lambda x: F.lower(x[field].cast("string"))
    return F.coalesce(F.exists(c, lambda x: own(x).isin([v.lower() for v in values]) if len(values) else F.lit(False)), F.lit(False))


def match_names(rows: DataFrame, name: str, names: DataFrame, other: str, ratio: float = 0.7, jaccard: float = 0.6) -> DataFrame:
    """(name_a, name_b, ratio, jaccard): for each name its equal ones if there are any, else those that are alike."""
    found = fuzzy_names(rows, names, name, other, ratio, jaccard).withColumn("same", (F.col("ratio") == 1) | (F.col("jaccard") == 1))
    any_ = F.max(F.col("same").cast("int")).over(Window.partitionBy("name_a"))
    return found.withColumn("_any", any_).where(F.col("same") | (F.col("_any") == 0)).drop("_any", "same")


def cascade(rows: DataFrame, key: str, lookups: list[tuple[DataFrame, str, str]], name: str) -> DataFrame:
    """rows with `name` and `found_by`: the value of the first lookup (table, rows' column, value column; the table's key
    has the rows' column's name) that knows the row's value; of several the least."""
    out = rows
    for k, (table, column, value) in enumerate(lookups):
        t = table.where(F.col(column).isNotNull()).groupBy(F.col(column).alias(f"_c{k}")).agg(F.min(value).alias(f"_v{k}"))
        out = out.join(t, out[column] == t[f"_c{k}"], "left").drop(f"_c{k}")
    values = [F.col(f"_v{k}") for k in range(len(lookups))]
    by = F.coalesce(*[F.when(v.isNotNull(), F.lit(c)) for v, (_, c, _) in zip(values, lookups, strict=True)])
    return out.withColumn(name, F.coalesce(*values)).withColumn("found_by", by).drop(*[f"_v{k}" for k in range(len(lookups))])


def union_lookups(people: DataFrame, person: str, first: str, second: str, ids: DataFrame, links: DataFrame) -> DataFrame:
    """(org, person): people whose first column is an organisation's id, and those whose second is its link; none twice."""
    a = people.join(ids, people[first] == ids["id"]).select("org", F.col(person).alias("person"))
    b = people.join(links, people[second] == links["link"]).select("org", F.col(person).alias("person"))
    return a.unionByName(b).distinct()


def filled(rows: DataFrame, key: str, better: DataFrame, columns: list[str]) -> DataFrame:
    """rows where columns become those of `better` (same key) that are not empty, such as translations."""
    b = better.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_b_{c}") for c in columns]).dropDuplicates(["_k"])
    out = rows.join(b, rows[key] == b["_k"], "left")
    for c in columns:
        out = out.withColumn(c, F.when(F.col(f"_b_{c}") != "", F.col(f"_b_{c}")).otherwise(F.col(c)))
    return out.drop("_k", *[f"_b_{c}" for c in columns])


def pending(documents: DataFrame, results: DataFrame, key: str, error: str, again: bool = True) -> DataFrame:
    """Documents without a result, and those whose result is an error if they are to run again."""
    done = results.where(F.col(error).isNull()) if again else results
    return documents.join(done.select(key).distinct(), key, "left_anti")


def located_in(df: DataFrame, places: str, place: str) -> DataFrame:
    return df.where(F.array_contains(places, place))


def active(status: Column, days: Column, outlier: int) -> Column:
    """Operating, and with a round in the last `outlier` days or none at all."""
    return (status == "operating") & (days.isNull() | (days <= outlier))


def late_venture(status: Column, stages: Column, late: list[str], days: Column, outlier: int) -> Column:
    """Active, with a round of a late stage and without an exit."""
    return active(status, days, outlier) & F.arrays_overlap(stages, F.array(*map(F.lit, late))) & ~F.coalesce(F.exists(stages, lambda s: s.startswith("post_ipo") | (s == "ipo")), F.lit(False))


def late_commercial(status: Column, stages: Column, days: Column, outlier: int) -> Column:
    """Active, with private equity or debt as its only rounds."""
    return active(status, days, outlier) & (F.size(stages) > 0) & (F.size(F.array_except(stages, F.array(F.lit("private_equity"), F.lit("debt_financing")))) == 0)


def portfolio(rounds: DataFrame, investors: str, company: str, companies: DataFrame, key: str, wanted: DataFrame | None = None) -> DataFrame:
    """(investor, company, ..., in_original): one row for each investor of a round, only wanted investors (investor) if
    given, with the company's attributes and whether it is among the companies."""
    rows = rounds.withColumn("investor", F.explode(investors)).drop(investors)
    if wanted is not None:
        rows = rows.join(wanted.select("investor").distinct(), "investor", "left_semi")
    c = companies.select(F.col(key).alias("_k"), *[x for x in companies.columns if x != key and x not in rows.columns])
    return rows.join(c, rows[company] == c["_k"], "left").withColumn("in_original", F.col("_k").isNotNull()).drop("_k")


def original_investors(investments: DataFrame) -> DataFrame:
    """Rows of investors with at least one investment in an original company."""
    own = investments.where("in_original").select("investor").distinct()
    return investments.join(own, "investor", "left_semi")


def investor_metadata(ids: DataFrame, organisations: DataFrame, people: DataFrame, government: list[str]) -> DataFrame:
    """Metadata of each investor: of the organisation of its id, else of the person; and whether it is a government's."""
    o = organisations.select(F.col("id").alias("_o"), F.col("name").alias("_on"), F.col("types").alias("_ot"))
    p = people.select(F.col("id").alias("_p"), F.col("name").alias("_pn"))
    out = ids.join(o, ids["id"] == o["_o"], "left").join(p, ids["id"] == p["_p"], "left")
    kind = F.when(F.col("_o").isNotNull(), "organisation").when(F.col("_p").isNotNull(), "person")
    flag = F.coalesce(F.arrays_overlap("_ot", F.array(*map(F.lit, government))), F.lit(False))
    return out.select("id", F.coalesce("_on", "_pn").alias("name"), kind.alias("kind"), flag.alias("government"))


def founder_toplines(ventures: DataFrame, key: str, people: DataFrame, org: str, flags: list[str], first_year: str, founded: str, majority: float = 0.5, large: float = 0.75) -> DataFrame:
    """ventures with founders counted, sums of their flags, any and all, a majority and a large one, and the years from
    the floor of the mean first year to the founding year."""
    aggs = [F.coalesce(F.sum(F.col(c).cast("int")), F.lit(0)).alias(f"n_{c}") for c in flags]
    own = people.groupBy(F.col(org).alias("_k")).agg(F.count("*").alias("n_founders"), *aggs, F.floor(F.avg(first_year)).alias("mean_first_year"))
    out = ventures.join(own, ventures[key] == own["_k"], "left").drop("_k").na.fill(0, ["n_founders", *[f"n_{c}" for c in flags]])
    for c in flags:
        n = F.col(f"n_{c}")
        share = F.try_divide(n.cast("double"), F.col("n_founders").cast("double"))
        out = out.withColumns({f"any_{c}": n > 0, f"all_{c}": (n > 0) & (n == F.col("n_founders")), f"{c}_majority": F.coalesce(share > majority, F.lit(False)), f"{c}_large_majority": F.coalesce(share > large, F.lit(False))})
    return out.withColumn("years_before", F.col(founded) - F.col("mean_first_year"))


def first_known(*columns: Column) -> Column:
    """The first of several ids that is neither null nor empty."""
    return F.coalesce(*[F.when(c != "", c) for c in columns])


def pick_location(c: Column, fields: list[str]) -> Column:
    """Of a list of location structs with `is_primary` and `deleted`: the first primary one that is not deleted, else the
    first not deleted; its fields without blanks, joined by a comma."""
    alive = F.filter(c, lambda x: ~F.coalesce(x["deleted"], F.lit(False)))
    first = F.coalesce(F.try_element_at(F.filter(alive, lambda x: F.coalesce(x["is_primary"], F.lit(False))), F.lit(1)), F.try_element_at(alive, F.lit(1)))
    return F.array_join(F.filter(F.array(*[first[f] for f in fields]), lambda x: x.isNotNull() & (x != "")), ", ")


def flat_values(c: Column, fields: list[str]) -> Column:
    """The values of a list of structs that are not empty, in order, as one list."""
    return F.filter(F.flatten(F.transform(c, lambda x: F.array(*[x[f] for f in fields]))), lambda v: v.isNotNull() & (v != ""))


def in_given_order(names: list[str], table: DataFrame, key: str) -> DataFrame:
    """The table's rows of the given names, in their order (position from 0); names it does not know stay, with nulls."""
    given = table.sparkSession.createDataFrame(list(enumerate(names)), "position int, _n string")
    return given.join(table, given["_n"] == table[key], "left").withColumn(key, F.col("_n")).drop("_n")


def clean_levels(df: DataFrame, columns: list[str], level: str = "No_Level") -> DataFrame:
    """Blank instead of placeholders such as `No_Level_2_...`; of values with a colon only what stands after it."""
    for c in columns:
        x = F.trim(F.regexp_replace(F.col(c), r"^[^:]*:", ""))
        df = df.withColumn(c, F.when(F.col(c).rlike(rf"^{level}_\d+_"), F.lit("")).otherwise(x))
    return df


def apply_settings(df: DataFrame, settings: list[dict]) -> DataFrame:
    """Columns that a settings table keeps (keep = 1), in its order and under its labels."""
    return df.select(*[F.col(s["column"]).alias(s.get("label") or s["column"]) for s in settings if int(s.get("keep", 0)) == 1 and s["column"] in df.columns])


def settings_lists(settings: list[dict], names: list[str]) -> dict[str, list[str]]:
    """By setting, the labels of the kept columns for which it is 1."""
    return {n: [s.get("label") or s["column"] for s in settings if int(s.get("keep", 0)) == 1 and int(s.get(n) or 0) == 1] for n in names}


def first_of_each(df: DataFrame, source: str, n: int, order: list[str]) -> DataFrame:
    """The first n rows of each source."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(source).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def down_sample(df: DataFrame, label: str, fractions: dict[str, float], key: str, seed: int = 1) -> DataFrame:
    """Of each class the fraction of rows with the smallest hashes of (key, seed), at least its floor; classes that are
    not named stay whole.  The same rows come out at every run."""
    table = F.create_map(*[F.lit(x) for pair in fractions.items() for x in pair])
    place = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1_000_000)) / 1_000_000
    return df.where(place < F.coalesce(F.try_element_at(table, F.col(label)), F.lit(1.0)))


def mapped(df: DataFrame, run: Callable[[DataFrame], DataFrame], pieces: int = 8) -> DataFrame:
    """run over df dealt into pieces."""
    return run(df.repartition(pieces))


def coerced(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Columns as numbers of a type; what is none becomes null."""
    return df.withColumns({c: F.expr(f"try_cast(`{c}` as {kind})") for c, kind in columns.items()})


def missing_text(c: Column, least: int = 100) -> Column:
    """Whether a text is null or shorter than `least` characters."""
    return c.isNull() | (F.length(c) < least)


def some_text(*columns: Column) -> Column:
    """Whether one of the texts is neither null nor blank."""
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.trim(c) != "", F.lit(False))
    return out


def match_hosts(rows: DataFrame, website: str, urls: DataFrame, url: str) -> DataFrame:
    """rows whose website has the host of one of the urls, with that url (the least); each row once."""
    from ..functions.url import host

    known = urls.select(host(F.col(url)).alias("_h"), F.col(url).alias("matched")).where("_h <> ''").groupBy("_h").agg(F.min("matched").alias("matched"))
    return rows.withColumn("_h", host(F.col(website))).join(known, "_h").drop("_h")


def with_known(rows: DataFrame, key: str, listing: DataFrame, value: str, process) -> DataFrame:
    """rows with a value: that of the listing (key, value) where it has one, else what `process`, a function of the rows
    it lacks, gives."""
    found = rows.join(listing.select(key, value), key)
    missing = rows.join(listing.select(key).distinct(), key, "left_anti")
    return found.unionByName(process(missing), allowMissingColumns=True)


def provenance_lists(prior: DataFrame, new: DataFrame, key: str, items: str) -> DataFrame:
    """key, provenance (prior, new or both), all items, and the items that are only new; null lists count as empty."""
    none = F.array().cast("array<string>")
    a, b = prior.select(F.col(key).alias("_a"), F.col(items).alias("_x")), new.select(F.col(key).alias("_b"), F.col(items).alias("_y"))
    x, y = F.coalesce("_x", none), F.coalesce("_y", none)
    kind = F.when(F.col("_b").isNull(), "prior").when(F.col("_a").isNull(), "new").otherwise("both")
    return a.join(b, F.col("_a") == F.col("_b"), "full").select(F.coalesce("_a", "_b").alias(key), kind.alias("provenance"), F.array_sort(F.array_union(x, y)).alias("items"), F.array_sort(F.array_except(y, x)).alias("added"))


def similar_clusters(pairs: DataFrame, sizes: DataFrame, n: int) -> DataFrame:
    """(a, b, sim): for each cluster the n others with the largest similarity, smaller ones first among equals.
    pairs: a, b, sim; sizes: cluster, size."""
    s = sizes.select(F.col("cluster").alias("b"), F.col("size").alias("_s"))
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("sim"), "_s", "b"))
    return pairs.join(s, "b").withColumn("_r", rank).where(F.col("_r") <= n).select("a", "b", "sim")


def equity_stage(types: Column, order: list[str], mapping: dict[str, str]) -> Column:
    """The latest stage, in `order`, of a list of round types, after types that are combined are renamed; null where
    none is known."""
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    known = F.array(*map(F.lit, order))
    place = F.array_max(F.transform(types, lambda t: F.array_position(known, F.coalesce(F.try_element_at(table, t), t))))
    return F.when(place > 0, F.element_at(known, F.greatest(place, F.lit(1)).cast("int")))


def raised_from(rounds: Column, kinds: list[str]) -> Column:
    """The sum of amounts of rounds (structs with kind and amount) of some kinds; 0 where there are none."""
    return F.aggregate(F.filter(rounds, lambda r: r["kind"].isin(kinds)), F.lit(0).cast("decimal(38,2)"), lambda a, r: (a + F.coalesce(r["amount"], F.lit(0))).cast("decimal(38,2)"))
