"""Cached map-and-merge summarisation in waves of DataFrames.

A wave builds prompts, drops those the cache answers, sends each distinct rest to the model in Arrow batches and appends
the answers. Texts above the budget are cut, their parts summarised, and the parts merged level by level. The driver loops over levels,
never over rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from scriptoria.functions.text import content_key
from scriptoria.functions.vocabulary import MERGE_INSTRUCTIONS, PROMPTS, SYSTEM_PROMPT
from scriptoria.operators.cache import answered, append, misses, open_cache
from scriptoria.operators.chunking import Counter, chunks_of, count_words, groups_of, structural_chunks_of
from scriptoria.plans.models import Summariser
from scriptoria.runtime import cut_lineage, spread

#: Most tokens of a model's context, share of it for a chunk, and most levels of merging.
CONTEXT, SHARE, LEVELS = 4096, 0.75, 12


def budget(kind: str, context: int = CONTEXT, chunk: int | None = None, count: Counter = count_words, most: int = CONTEXT) -> tuple[int, int]:
    """Tokens available to a prompt of a kind, and to a chunk, in a context of at most ``most``; at least one each."""
    context = min(context, most)
    available = max(1, context - count(SYSTEM_PROMPT) - count(PROMPTS.get(kind, PROMPTS["module"]).replace("{text}", "")))
    return available, max(1, min(chunk if chunk else int(context * SHARE), available))


def ask(prompts: DataFrame, model: Summariser, cache: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """``prompts`` (key, text, ...) with ``value``, and the new (key, value) rows. A failed prompt has a null value and is not stored."""
    schema = StructType([StructField("key", StringType()), StructField("value", StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for text in pdf["text"]:
                try:
                    out.append(model.summarise(text or "", kind))
                except RuntimeError:
                    out.append(None)
            yield pd.DataFrame({"key": pdf["key"], "value": out})

    fresh = cut_lineage(spread(misses(prompts.select("key", "text"), cache)).mapInPandas(run, schema).where("value is not null"))
    known = cache.select("key", "value", "stored_at").unionByName(fresh.withColumn("stored_at", F.current_timestamp()))
    return answered(prompts, known), fresh


def _texts(function):
    @F.pandas_udf(ArrayType(StringType()))
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: function(v), na_action=None)

    return run


def summarise(texts: DataFrame, model: Summariser, kind: str = "docstring", cache_path: str | None = None, context: int = CONTEXT, chunk: int | None = None, count: Counter = count_words, after_chunk: Callable[[str], str] | None = None, levels: int = LEVELS, most: int = CONTEXT) -> DataFrame:
    """``(id, summary)`` of ``texts`` (id, text): one call where the text fits, else parts and merges.

    A column ``parts`` (array of strings), where not null, is what a text that does not fit is packed from; otherwise its blocks are.
    ``after_chunk`` is applied to each part's answer before it is merged.

    Failed parts are skipped; without any part the summary is empty. If merging has not ended after ``levels`` levels, as with
    a model that does not shorten, the parts are joined. Null texts count as empty. A second run over the same cache makes no calls.
    """
    spark = texts.sparkSession
    available, size = budget(kind, context, chunk, count, most)
    room = max(1, available - count(MERGE_INSTRUCTIONS))
    cache = open_cache(spark, cache_path)
    new: list[DataFrame] = []
    tokens = F.pandas_udf(lambda s: s.map(count), "long")
    given = F.col("parts") if "parts" in texts.columns else F.lit(None).cast("array<string>")
    rows = texts.select(F.col("id").cast("string").alias("id"), F.coalesce("text", F.lit("")).alias("text"), given.alias("parts")).withColumn("n", tokens("text"))
    blocks, packed = _texts(lambda t: chunks_of(t, size, count)), _texts(lambda p: structural_chunks_of([x for x in p if x] if p is not None else [], size, count))
    cut = F.when(F.col("n") <= available, F.array("text")).when(F.col("parts").isNotNull(), packed(F.col("parts"))).otherwise(blocks(F.col("text")))
    parts = rows.select("id", F.posexplode(cut).alias("pos", "text"), (F.col("n") <= available).alias("whole"))
    prefix = F.when(F.col("whole"), F.lit(kind)).otherwise(F.concat(F.lit(f"{kind}:part"), F.col("pos").cast("string")))
    done, fresh = ask(parts.withColumn("key", content_key(prefix, F.col("text"))), model, cache, kind)
    new.append(fresh)
    if after_chunk:
        hook = F.pandas_udf(lambda s: s.map(after_chunk, na_action="ignore"), StringType())
        done = done.withColumn("value", F.when(F.col("whole"), F.col("value")).otherwise(hook("value")))
    state = cut_lineage(done.where("value is not null").select("id", "pos", "value", "whole"))
    finished = [state.where("whole").select("id", F.col("value").alias("summary"))]
    open_parts = state.where("not whole").select("id", "pos", "value")
    for level in range(levels):
        lists = open_parts.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]).alias("v"))
        single = lists.where("size(v) = 1").select("id", F.col("v")[0].alias("summary"))
        finished.append(single)
        many = lists.where("size(v) > 1")
        if not many.take(1):
            open_parts = None
            break
        group = F.pandas_udf(lambda s: s.map(lambda v: [f"{MERGE_INSTRUCTIONS}" + "\n".join(f"- {x}" for x in g) for g in groups_of(list(v), room, count)]), "array<string>")
        prompts = many.select("id", F.posexplode(group("v")).alias("pos", "text")).withColumn("key", content_key(f"{kind}:merge{level}", F.col("text")))
        done, fresh = ask(prompts, model, cache, "docstring")
        new.append(fresh)
        open_parts = cut_lineage(done.where("value is not null").select("id", "pos", "value"))
    if open_parts is not None:
        finished.append(open_parts.groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]), "\n").alias("summary")))
    if cache_path:
        append(reduce(DataFrame.unionByName, new).dropDuplicates(["key"]), cache_path)
    found = reduce(DataFrame.unionByName, finished)
    return rows.select("id").distinct().join(found, "id", "left").select("id", F.coalesce("summary", F.lit("")).alias("summary"))
