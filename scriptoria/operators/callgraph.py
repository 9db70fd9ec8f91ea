"""Call graphs of modules: resolution of call names, nodes, edges, degrees and clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_LAST = lambda c: F.element_at(F.split(c, "[.]"), -1)


def callables(symbols: DataFrame, scope: str = "module_id") -> DataFrame:
    """``(scope, qualname, name, signature, calls, ord)``: functions and methods, once per qualified name.

    Of repeated names the last definition holds, at the place of the first. Rows without a scope or name are dropped;
    a missing qualified name is the name.
    """
    s = symbols.where(F.col("kind").isin("function", "method") & F.col(scope).isNotNull() & (F.coalesce("name", F.lit("")) != ""))
    rows = s.select(scope, F.coalesce("qualname", "name").alias("qualname"), "name", "signature", F.coalesce("calls", F.array().cast("array<string>")).alias("calls"), F.coalesce("ord", F.lit(0)).alias("ord"))
    value = F.struct("name", "signature", "calls")
    return rows.groupBy(scope, "qualname").agg(F.max_by(value, F.struct("ord", F.xxhash64("name", "signature", "calls"))).alias("v"), F.min("ord").alias("ord")).select(scope, "qualname", "v.*", "ord")


def resolve_calls(defs: DataFrame, scope: str = "module_id") -> DataFrame:
    """``(scope, source, raw, target)``: each distinct call of each callable with the definition it means, or null.

    An exact qualified name wins; else definitions of the same last part are candidates: a single one is taken, of
    several the first under the longest prefix of the caller's name, none if no prefix holds one. Calls meet the definitions of
    their last part in one window, so rows already partitioned by scope are not shuffled again, and stay together by scope.
    """
    none = F.array().cast("array<string>")
    call = F.explode(F.concat(F.array(F.lit(None).cast("string")), F.coalesce(F.filter(F.array_distinct("calls"), lambda c: c.isNotNull()), none)))
    rows = defs.select(scope, F.col("qualname").alias("source"), "ord", call.alias("raw")).withColumn("__simple", _LAST(F.coalesce("raw", "source")))
    met = Window.partitionBy(scope, "__simple").orderBy("ord", "source").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    own = F.when(F.col("raw").isNull(), F.struct("ord", F.col("source").alias("qualname")))  # each definition stands once without a call
    called = rows.withColumn("__n", F.count("raw").over(met)).where("__n > 0")
    joined = called.withColumn("__c", F.collect_list(own).over(met)).where("raw is not null")
    exact = F.when(F.exists("__c", lambda d: d["qualname"] == F.col("raw")), F.col("raw"))
    parts = F.split("source", "[.]")
    prefixes = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), "."))
    under = lambda p: F.filter("__c", lambda d: F.startswith(d["qualname"], F.concat(p, F.lit("."))))
    near = F.when(F.size("__c") == 1, F.col("__c")[0]["qualname"]).when(F.size("__c") > 1, F.try_element_at(F.filter(F.transform(prefixes, lambda p: F.try_element_at(under(p), F.lit(1))["qualname"]), lambda q: q.isNotNull()), F.lit(1)))
    return joined.select(scope, "source", "raw", F.coalesce(exact, near).alias("target"))


def links(resolved: DataFrame, scope: str = "module_id") -> DataFrame:
    """``(scope, source, target, external)`` of each resolved call, repeated ones included; a call of the caller itself counts as external."""
    inner = F.col("target").isNotNull() & (F.col("target") != F.col("source"))
    return resolved.select(scope, "source", F.when(inner, F.col("target")).otherwise(F.col("raw")).alias("target"), (~inner).alias("external"))


def edges(resolved: DataFrame, scope: str = "module_id") -> DataFrame:
    """``(scope, source, target, external)``: distinct edges; a call of the caller itself counts as external."""
    return links(resolved, scope).distinct()


def nodes(defs: DataFrame, graph_edges: DataFrame, scope: str = "module_id") -> DataFrame:
    """``(scope, qualname, display, external)``: callables that call or are called, and external names."""
    linked = graph_edges.select(scope, F.col("source").alias("qualname")).unionByName(graph_edges.where("not external").select(scope, F.col("target").alias("qualname"))).distinct()
    inside = defs.join(linked, [scope, "qualname"], "left_semi").select(scope, "qualname", F.coalesce("signature", "name").alias("display"), F.lit(False).alias("external"))
    outside = graph_edges.where("external").select(scope, F.col("target").alias("qualname"), F.col("target").alias("display"), F.lit(True).alias("external")).distinct()
    return inside.unionByName(outside)


def called_by(graph_edges: DataFrame, scope: str = "module_id") -> DataFrame:
    """``(scope, qualname, callers, n)`` of the callables that others call."""
    inner = graph_edges.where("not external")
    return inner.groupBy(scope, F.col("target").alias("qualname")).agg(F.sort_array(F.collect_set("source")).alias("callers"), F.count_distinct("source").alias("n"))


def degrees(defs: DataFrame, graph_edges: DataFrame, scope: str = "module_id") -> DataFrame:
    """``(scope, qualname, calls_out, calls_external, calls_in)`` of every callable, zeros included."""
    out = graph_edges.groupBy(scope, F.col("source").alias("qualname")).agg(F.count_if(~F.col("external")).alias("calls_out"), F.count_if("external").alias("calls_external"))
    into = graph_edges.where("not external").groupBy(scope, F.col("target").alias("qualname")).agg(F.count("*").alias("calls_in"))
    return defs.select(scope, "qualname").join(out, [scope, "qualname"], "left").join(into, [scope, "qualname"], "left").na.fill(0, ["calls_out", "calls_external", "calls_in"])


def clusters(graph_nodes: DataFrame, scope: str = "module_id") -> DataFrame:
    """``(scope, cluster, members)``: internal nodes by the first part of their name, from two members on."""
    inner = graph_nodes.where("not external").select(scope, F.split("qualname", "[.]")[0].alias("cluster"), "qualname")
    return inner.groupBy(scope, "cluster").agg(F.count_distinct("qualname").alias("members")).where("members >= 2")


def most_called(graph_edges: DataFrame, top: int, scope: str = "module_id") -> DataFrame:
    """``(scope, qualname, n, rank)``: the ``top`` called callables of each scope, ties by name."""
    counted = graph_edges.where("not external").groupBy(scope, F.col("target").alias("qualname")).agg(F.count("*").alias("n"))
    return counted.withColumn("rank", F.row_number().over(Window.partitionBy(scope).orderBy(F.desc("n"), "qualname"))).where(F.col("rank") <= top)
