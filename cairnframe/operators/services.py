"""Outside services as functions passed in: paged reads, lookups in chunks, cached maps with an error budget, memos.

A service is a plain function that tasks call; nothing here knows a vendor.  Pages and chunks are dealt over tasks."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .joins import upsert


def offset_pages(spark: SparkSession, fetch: Callable[[int, int], tuple[list[dict], int]], schema: str, page: int = 100, limit: int | None = None) -> DataFrame:
    """All records of a service that takes (offset, limit) and gives (records, total).  The first page tells the total;
    the others are read in parallel and none beyond the total is asked for."""
    records, total = fetch(0, min(page, limit or page))
    total = min(total, limit) if limit is not None else total
    first = spark.createDataFrame([tuple(r.values()) for r in records[:total]], schema)
    if total <= page:
        return first
    offsets = list(range(page, total, page))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for o in pdf["id"]:
                got = fetch(int(o), min(page, total - int(o)))[0]
                if got:
                    yield pd.DataFrame(got)

    rest = spark.range(page, total, page, min(len(offsets), 200)).mapInPandas(read, schema)
    return first.unionByName(rest)


def keyset_pages(spark: SparkSession, fetch: Callable[[object, int], list[dict]], key: str, schema: str, page: int = 1000, limit: int | None = None, hold: int = 100_000, put: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """All records of a service that takes (after, page) and gives the records after that key, until a page is empty.
    A page needs the key of the one before, so one reader asks; every `hold` records go to `put` (a write), so the
    driver holds no more."""
    parts, held, after, seen = [], [], None, 0
    while limit is None or seen < limit:
        got = fetch(after, page if limit is None else min(page, limit - seen))
        if not got:
            break
        held += [tuple(r.values()) for r in got]
        seen, after = seen + len(got), got[-1][key]
        if len(held) >= hold:
            parts.append(put(spark.createDataFrame(held, schema)))
            held = []
    parts.append(spark.createDataFrame(held, schema))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def in_chunks(values: DataFrame, column: str, fetch: Callable[[list], list[dict]], schema: str, size: int = 200) -> DataFrame:
    """Records that a service gives for chunks of a column's values; chunks are dealt over tasks, and equal records are
    one."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            own = pdf[column].tolist()
            for k in range(0, len(own), size):
                got = fetch(own[k : k + size])
                if got:
                    yield pd.DataFrame(got)

    return values.select(column).distinct().mapInPandas(read, schema).distinct()


def read_through(ids: DataFrame, key: str, cache: DataFrame, fetch: Callable[[list], list[dict]], schema: str, batch: int = 20) -> tuple[DataFrame, DataFrame]:
    """Records for the ids from a cache (key, ...), and for those it lacks from the service; and the new cache."""
    missing = ids.select(key).distinct().join(cache, key, "left_anti")
    fresh = in_chunks(missing, key, fetch, schema, batch)
    merged = cache.unionByName(fresh)
    return ids.join(merged, key, "left"), merged


def tree_of(fetch: Callable[[object], list[dict]], root: object, key: str, most: int = 10) -> list[dict]:
    """All nodes below a root, each with its parent and depth, by asking for the children of each level's nodes."""
    out, level = [], [root]
    for depth in range(1, most + 1):
        after = []
        for parent in level:
            for child in fetch(parent):
                out.append({**child, "parent": parent, "depth": depth})
                after.append(child[key])
        if not after:
            break
        level = after
    return out


def bulk_job(submit: Callable[[list], str], status: Callable[[str], list[str] | None], read: Callable[[str], list[dict]], ids: list, wait: float = 60.0, rounds: int = 10) -> list[dict]:
    """Records of a job: submitted, asked for its parts until they are there, then read part by part."""
    job = submit(ids)
    for _ in range(rounds):
        parts = status(job)
        if parts is not None:
            return [r for p in parts for r in read(p)]
        time.sleep(wait)
    raise TimeoutError(f"job {job} has no parts after {rounds} rounds")


def search_body(any_of: dict[str, list[str]], none_of: dict[str, list[str]] | None = None, match: str = "match_phrase") -> dict:
    """A boolean search: or within a filter, and across filters, and a list of what must not match; empty filters go."""
    each = lambda f, values: {"bool": {"should": [{match: {f: v}} for v in values], "minimum_should_match": 1}}
    body = {"must": [each(f, v) for f, v in any_of.items() if v]}
    if not_ := [{match: {f: v}} for f, values in (none_of or {}).items() for v in values]:
        body["must_not"] = not_
    return {"query": {"bool": body}, "sort": ["_score"]}


def cached_results(rows: DataFrame, cache: DataFrame, key: str, text: str, call: Callable[[str], str], max_errors: int = 1, use_cached: bool = True) -> tuple[DataFrame, DataFrame]:
    """(key, response) for all rows that have one, and the new cache (key, text_id, response, num_errors).

    A row whose key and text are in the cache is not asked again; a changed text is; an error counts, and a row whose
    errors reach the budget is skipped.  The model is called once for each distinct text of a task's rows.
    """
    asked = rows.select(F.col(key).alias("q_key"), F.col(text).alias("q_text"), F.md5(text).alias("q_id"))
    c = cache.select(F.col(key).alias("c_key"), F.col("text_id").alias("c_id"), F.col("response").alias("c_response"), F.col("num_errors").alias("c_errors"))
    state = asked.join(c, (asked["q_key"] == c["c_key"]) & (asked["q_id"] == c["c_id"]), "left")
    found = state.where(F.col("c_response").isNotNull()) if use_cached else state.limit(0)
    due = state.where((F.col("c_response").isNull() if use_cached else F.lit(True)) & (F.coalesce("c_errors", F.lit(0)) < max_errors))
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, tuple[str | None, int]] = {}
        for pdf in batches:
            got = []
            for k, t, i, e in zip(pdf["q_key"], pdf["q_text"], pdf["q_id"], pdf["e"], strict=True):
                if i not in known:
                    try:
                        known[i] = (call(t), 0)
                    except Exception:  # what a service may raise is not known here; it is counted
                        known[i] = (None, 1)
                response, failed = known[i]
                got.append((k, i, response, int(e) + failed))
            yield pd.DataFrame(got, columns=[key, "text_id", "response", "num_errors"])

    due = due.select("q_key", "q_text", "q_id", F.coalesce("c_errors", F.lit(0)).cast("int").alias("e"))
    fresh = due.mapInPandas(run, f"`{key}` {kind}, text_id string, response string, num_errors int")
    from ..sources.shared import keep

    fresh = keep(fresh)  # the service is asked once, whatever is done with the answers
    answers = found.select(F.col("q_key").alias(key), F.col("c_response").alias("response")).unionByName(fresh.where("response is not null").select(key, "response"))
    old = cache.select(key, "text_id", "response", "num_errors").withColumn("_v", F.lit(0))
    return answers, upsert(old, fresh.withColumn("_v", F.lit(1)), [key], "_v").drop("_v")


def memo_key(name: str, args: tuple, kwargs: dict) -> str:
    """The key of a call: the function's name and its arguments as JSON, in order of their names."""
    return json.dumps([name, args, dict(sorted(kwargs.items()))], sort_keys=True, default=str)


def memoized(fn: Callable, store: dict[str, str]) -> Callable:
    """fn with results kept as JSON in a store (any mapping, such as one over a table) by name and arguments."""

    def call(*args, **kwargs):
        key = memo_key(fn.__name__, args, kwargs)
        if key not in store:
            store[key] = json.dumps(fn(*args, **kwargs))
        return json.loads(store[key])

    return call


def resume(rows: DataFrame, done: DataFrame, key: str, run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """All results: those that are there, and run over the rows that have none."""
    return done.unionByName(run(rows.join(done.select(key).distinct(), key, "left_anti")))


def still_valid(cache: DataFrame, written: str, as_of, days: int = 90) -> DataFrame:
    """Cache rows written in the last `days` days."""
    return cache.where(F.col(written) >= F.date_sub(as_of, days))


def prompt_registry(prompts: DataFrame, registry: DataFrame) -> DataFrame:
    """The registry (id, prompt) with the prompts it lacks; an id is the version-5 identifier of the text."""
    from ..functions.text import uuid5

    new = prompts.select(uuid5(F.col("prompt")).alias("id"), "prompt").distinct()
    return registry.unionByName(new.join(registry, "id", "left_anti"))


def embedded(rows: DataFrame, key: str, text: str, cache: DataFrame, call: Callable[[str], list[float]]) -> tuple[DataFrame, DataFrame]:
    """(key, vector) of each row's text, and the new cache; a text is asked for once, whatever rows hold it.  Rows whose
    text has no vector are left out, so vectors are joined by key and never by position."""
    texts = rows.select(F.md5(text).alias("id"), F.col(text).alias("_t")).where(F.col("_t").isNotNull()).dropDuplicates(["id"])
    answers, cache = cached_results(texts, cache, "id", "_t", lambda t: json.dumps(call(t)))
    vectors = answers.select("id", F.from_json("response", "array<double>").alias("vector"))
    return rows.select(key, F.md5(text).alias("id")).join(vectors, "id").select(key, "vector"), cache


def sheet_values(spark: SparkSession, fetch: Callable[[], list[list]], header: bool = True) -> DataFrame:
    """A range that a sheet service gives, as texts; the first row names the columns, short rows end in nulls."""
    rows = fetch()
    names = [str(x) for x in rows[0]] if header and rows else [f"column_{k + 1}" for k in range(max(map(len, rows), default=0))]
    body = rows[1:] if header else rows
    data = [tuple(None if k >= len(r) or r[k] in (None, "") else str(r[k]) for k in range(len(names))) for r in body]
    return spark.createDataFrame(data, ", ".join(f"`{n}` string" for n in names))


def sheet_rows(df: DataFrame, empty: bool, mode: str = "append") -> list[list]:
    """The values to send to a sheet service: the header only where the sheet is empty or overwritten, nulls as ''."""
    body = [["" if v is None else v for v in r] for r in df.toLocalIterator()]  # a sheet's rows are bounded
    return [list(df.columns), *body] if empty or mode == "overwrite" else body


def setting(config: dict, key: str, defaults: dict | None = None):
    """The value of a dotted key in nested settings, else in the defaults, else None."""
    for source in (config, defaults or {}):
        at = source
        for part in key.split("."):
            at = at.get(part) if isinstance(at, dict) else None
        if at is not None:
            return at
    return None
