"""Evidence for the sections of a manual: collection, ranking, parsing and validation."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptoria.functions.text import file_name, path_tokens, placeholders, split_lines, strip
from scriptoria.functions.vocabulary import EVIDENCE_SKIP, RANKING_SKIP, RANKING_SUFFIXES, RANKING_WORDS, REFERENCE_SUFFIXES, SECTIONS
from scriptoria.runtime import salted_join, widen

Sections = list[tuple[str, str, list[str]]]
#: Parts that the paths of one key are spread over.
SALTS = 16
_EDGE = r"[\p{L}\p{M}\p{N}_]"


def section_table(spark: SparkSession, sections: Sections = SECTIONS) -> DataFrame:
    """``(ord, section, token, keywords)`` of the sections, a row each."""
    return spark.createDataFrame([(i, *s) for i, s in enumerate(sections)], "ord int, section string, token string, keywords array<string>")


def first_section(line: Column, sections: Sections = SECTIONS) -> Column:
    """The first section one of whose keywords is a whole word of ``line``; null if there is none."""
    low = F.lower(strip(line))
    out = None
    for name, _, words in sections:
        hit = low.rlike(rf"(?<!{_EDGE})(?:{'|'.join(map(re.escape, words))})(?!{_EDGE})")
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def any_keyword(sections: Sections = SECTIONS) -> str:
    """The pattern of any section's keyword as a whole word of a text in lower case; the edge before it is checked last."""
    words = sorted({w for _, _, ws in sections for w in ws}, key=lambda w: (-len(w), w))
    return rf"(?:{'|'.join(map(re.escape, words))})(?!{_EDGE})(?<!{_EDGE}(?:{'|'.join(map(re.escape, words))}))"


def map_evidence(docs: DataFrame, id_col: str, path_col: str, text_col: str, top: int | None = 10, window: int = 20, sections: Sections = SECTIONS, skip: list[str] = EVIDENCE_SKIP) -> DataFrame:
    """``(section, rank, id, path, line_no, snippet)``: the best snippets of each section.

    A snippet is a line with a section's keyword and up to ``window`` lines after it, ended by a blank line or a
    heading; none follow in suppressed folders, where Overview has no evidence at all. Ranked by length,
    Overview by readmes and docs first; ties by id and line. Ranking keeps ``top`` rows per section in two
    steps, first within salted parts, so that a section that holds most rows is not sorted in one task. ``top`` None
    keeps all, unranked. Null paths are files at the root; null texts have no lines.
    """
    parts = F.split(F.lower(F.coalesce(path_col, F.lit(""))), "/")
    inside = F.arrays_overlap(parts, F.array(*[F.lit(s) for s in skip]))
    first = (F.lower(file_name(F.col(path_col))) == "readme.md") | F.array_contains(parts, "docs")
    # texts without any keyword go before they are cut into lines
    told = docs.select(id_col, path_col, text_col).where(F.lower(text_col).rlike(any_keyword(sections)))
    rows = widen(told).select(id_col, path_col, inside.alias("__in"), F.coalesce(first, F.lit(False)).alias("__first"), split_lines(F.col(text_col)).alias("__lines"))
    # hits are found by their index within the row, so that no row carries the lines of its text
    is_hit = lambda i: F.lower(F.element_at("__lines", i)).rlike(any_keyword(sections))
    rows = rows.select("*", F.filter(F.when(F.size("__lines") > 0, F.sequence(F.lit(1), F.size("__lines"))), is_hit).alias("__at"))

    def hit(i: Column) -> Column:
        after = F.when(F.col("__in"), F.array().cast("array<string>")).otherwise(F.slice("__lines", i + 1, window))
        return F.struct(i.alias("line_no"), F.element_at("__lines", i).alias("line"), after.alias("after"))

    hits = rows.select(id_col, path_col, "__in", "__first", F.explode(F.transform("__at", hit)).alias("__h")).select(id_col, path_col, "__in", "__first", "__h.*")
    hits = hits.withColumn("section", first_section(F.col("line"), sections))
    stop = F.array_position(F.transform("after", lambda x: (strip(x) == "") | x.rlike(r"^\s*(?:#|<h[1-6])")), F.lit(True)).cast("int")
    taken = F.transform(F.when(stop > 0, F.slice("after", 1, stop - 1)).otherwise(F.col("after")), strip)
    snippet = F.concat(strip(F.col("line")), F.when(F.size(taken) > 0, F.concat(F.lit("\n"), F.array_join(taken, " "))).otherwise(""))
    prio = F.when((F.col("section") == "Overview") & F.col("__first"), 0).otherwise(1)
    found = hits.select("section", prio.alias("__prio"), id_col, path_col, "line_no", snippet.alias("snippet"), "__in").where("section is not null and not (__in and section = 'Overview')").drop("__in")
    if top is None:
        return found.drop("__prio")
    order = [F.col("__prio"), F.length("snippet").desc(), F.col(id_col), F.col("line_no")]
    part = found.withColumn("__salt", F.pmod(F.xxhash64(id_col, "line_no"), F.lit(64)))
    kept = part.withColumn("__r", F.row_number().over(Window.partitionBy("section", "__salt").orderBy(*order))).where(F.col("__r") <= top)
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("section").orderBy(*order))).where(F.col("rank") <= top).select("section", "rank", id_col, path_col, "line_no", "snippet")


def section_coverage(spark: SparkSession, evidence: DataFrame, sections: Sections = SECTIONS) -> DataFrame:
    """``(ord, section, snippets, inferred, body)``: every section with its number of snippets; without any, its placeholder."""
    counted = evidence.groupBy("section").agg(F.count("*").alias("snippets"))
    return section_table(spark, sections).join(counted, "section", "left").select(
        "ord", "section", F.coalesce("snippets", F.lit(0)).alias("snippets"), F.col("snippets").isNull().alias("inferred"), F.when(F.col("snippets").isNull(), F.col("token")).alias("body")
    )


def files_by_section(evidence: DataFrame, path_col: str = "path") -> DataFrame:
    """``(path, sections)``: the sections each path contributes to, sorted."""
    return evidence.groupBy(path_col).agg(F.sort_array(F.collect_set("section")).alias("sections"))


def missing_sections(text: Column, sections: Sections = SECTIONS) -> Column:
    """Sections whose placeholder stands in ``text``, in their order."""
    have = placeholders(text)
    return F.filter(F.array(*[F.when(F.array_contains(have, token), F.lit(name)) for name, token, _ in sections]), lambda x: x.isNotNull())


def parse_manual(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, ord, title, body)``: sections opened by ``Title: text`` lines, further lines joined to them.

    Lines before the first title are dropped; of a repeated title the last one holds, at the place of the first.
    The fold runs over each row's lines, without a shuffle for the lines.
    """
    head = r"^([A-Za-z &]+):\s*(.*)$"
    lines = F.filter(F.transform(split_lines(F.col(text_col)), strip), lambda x: x != "")
    fold = F.aggregate(
        lines,
        F.array().cast("array<struct<title:string,body:string>>"),
        lambda acc, x: F.when(x.rlike(head), F.concat(acc, F.array(F.struct(F.trim(F.regexp_extract(x, head, 1)).alias("title"), F.trim(F.regexp_extract(x, head, 2)).alias("body"))))).otherwise(
            F.when(F.size(acc) == 0, acc).otherwise(
                F.concat(
                    F.slice(acc, 1, F.size(acc) - 1),
                    F.transform(F.slice(acc, -1, 1), lambda s: F.struct(s["title"].alias("title"), F.concat(s["body"], F.when(s["body"] == "", "").otherwise("\n"), x).alias("body"))),
                )
            )
        ),
    )
    rows = texts.where(F.col(text_col).rlike(r"(?m)^\s*[A-Za-z &]+:")).select(id_col, F.posexplode(fold).alias("pos", "s"))
    last = rows.groupBy(id_col, F.col("s.title").alias("title")).agg(F.min("pos").alias("ord"), F.max_by("s.body", "pos").alias("body"))
    return last.select(id_col, "ord", "title", "body")


def infer_missing(sections: DataFrame, id_col: str, required: list[str] | None = None) -> DataFrame:
    """``(id, title, body, inferred)``: the given sections plus, for each id, the required ones it lacks."""
    required = [s[0] for s in SECTIONS] if required is None else required
    wanted = sections.select(id_col).distinct().select(id_col, F.explode(F.array(*[F.lit(r) for r in required])).alias("title"))
    have = sections.where(strip(F.col("body")) != "").select(id_col, "title", "body")
    lacking = wanted.join(have.select(id_col, "title"), [id_col, "title"], "left_anti").select(id_col, "title", F.concat("title", F.lit(" details (inferred)")).alias("body"), F.lit(True).alias("inferred"))
    return have.withColumn("inferred", F.lit(False)).unionByName(lacking)


def fallback_sections(text: Column, required: list[str] | None = None) -> Column:
    """Sections made from a plain text alone: Overview holds it, the others are marked as inferred."""
    required = [s[0] for s in SECTIONS] if required is None else required
    body = lambda r: F.when(strip(F.coalesce(text, F.lit(""))) == "", F.lit("No information provided.")).otherwise(strip(text) if r == "Overview" else F.lit(f"{r} details (inferred)"))
    return F.array(*[F.struct(F.lit(r).alias("title"), body(r).alias("body")) for r in required])


def reference_pattern(suffixes: list[str] = REFERENCE_SUFFIXES) -> str:
    """The pattern of a file reference."""
    return rf"(?<![\p{{L}}\p{{N}}_])[\p{{L}}\p{{N}}_][\p{{L}}\p{{N}}_./-]*\.(?:{'|'.join(suffixes)})(?![\p{{L}}\p{{N}}_])"


def references(texts: DataFrame, id_col: str, text_col: str, suffixes: list[str] = REFERENCE_SUFFIXES) -> DataFrame:
    """``(id, ref)``: distinct file references of each text."""
    found = F.array_distinct(F.regexp_extract_all(F.coalesce(text_col, F.lit("")), F.lit(reference_pattern(suffixes)), F.lit(0)))
    return texts.select(id_col, F.explode(found).alias("ref"))


def missing_references(texts: DataFrame, id_col: str, text_col: str, files: DataFrame, path_col: str, suffixes: list[str] = REFERENCE_SUFFIXES) -> DataFrame:
    """``(id, ref)``: references that equal neither a path nor a file name of ``files``; null paths name no file."""
    names = files.where(F.col(path_col).isNotNull()).select(F.explode(F.array(F.col(path_col), file_name(F.col(path_col)))).alias("ref")).distinct()
    found = references(texts, id_col, text_col, suffixes)
    # distinct references are few beside their uses, of which one may hold a third
    lost = found.select("ref").distinct().join(names, "ref", "left_anti")
    return salted_join(found, lost, ["ref"])


def annotate_missing(texts: DataFrame, id_col: str, text_col: str, missing: DataFrame) -> DataFrame:
    """``texts`` with `` [missing]`` after each missing reference, and the list ``missing_references``."""
    lists = missing.groupBy(id_col).agg(F.sort_array(F.collect_set("ref")).alias("missing_references"))
    joined = texts.join(lists, id_col, "left")
    # longest first, so that a reference within a longer one is not marked twice; marks are set on word ends only
    marked = F.aggregate(
        F.coalesce("missing_references", F.array().cast("array<string>")),
        F.col(text_col),
        lambda acc, r: F.regexp_replace(acc, F.concat(F.lit(r"(?<![\p{L}\p{N}_./-])\Q"), r, F.lit(r"\E(?![\p{L}\p{N}_])(?! \[missing\])")), F.concat(F.replace(r, F.lit("$"), F.lit("\\$")), F.lit(" [missing]"))),
    )
    return joined.withColumn(text_col, marked)


def rank_files(files: DataFrame, path_col: str, patterns: DataFrame | None = None, pattern_col: str = "pattern", top: int | None = 12, suffixes: list[str] = RANKING_SUFFIXES, words: list[str] = RANKING_WORDS, skip: list[str] = RANKING_SKIP) -> DataFrame:
    """``(path, score)``: code files by score, then path: 2 for a telling name, 1 for each distinct reference.

    References are matched by containment in the path. Each reference is keyed by that of its trigrams which the fewest paths hold, a
    shorter one by itself, and each path by all its runs of up to three characters: no pair is lost, and what meets is checked. Keys that
    many paths share are salted. ``top`` None keeps all files.
    """
    path = F.col(path_col)
    low, parts = F.lower(path), F.split(F.lower(path), "/")
    folders = F.slice(parts, 1, F.size(parts) - 1)
    ok = F.lit(False)
    for s in suffixes:
        ok = ok | F.endswith(path, F.lit(s))
    skipped = F.arrays_overlap(folders, F.array(*[F.lit(s) for s in skip])) | F.exists(folders, lambda d: F.endswith(d, F.lit(".egg-info")))
    base = files.where(path.isNotNull()).select(path_col).distinct().where(ok & ~skipped)
    own = F.when(low.rlike("|".join(words)), 2).otherwise(0)
    if patterns is None:
        scored = base.select(path_col, own.alias("score"))
    else:
        refs = patterns.select(F.lower(pattern_col).alias("ref")).where("ref <> ''").distinct()
        grams = lambda c, n: F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(c, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
        wide = base.select(path_col, low.alias("__low"), F.explode(F.array_distinct(F.concat(grams(low, 1), grams(low, 2), grams(low, 3)))).alias("g"))
        counted = wide.groupBy("g").agg(F.count("*").alias("n"))
        own_grams = refs.select("ref", F.explode(F.array_distinct(F.when(F.length("ref") < 3, F.array("ref")).otherwise(grams(F.col("ref"), 3)))).alias("g"))
        # a reference with a trigram that no path holds lies in none
        keyed = salted_join(own_grams, counted, ["g"], "left").groupBy("ref").agg(F.min_by("g", F.struct("n", "g")).alias("g"), F.bool_and(F.col("n").isNotNull()).alias("met")).where("met").select("ref", "g")
        spread = keyed.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        pairs = wide.withColumn("__salt", F.pmod(F.xxhash64(path_col), F.lit(SALTS)).cast("int")).join(spread, ["g", "__salt"])
        hits = pairs.where(F.contains(F.col("__low"), F.col("ref"))).groupBy(path_col).agg(F.count("*").alias("refs"))
        scored = base.join(hits, path_col, "left").select(path_col, (own + F.coalesce("refs", F.lit(0))).cast("int").alias("score"))
    return scored if top is None else scored.orderBy(F.desc("score"), path_col).limit(top)


def document_patterns(docs: DataFrame, text_col: str) -> DataFrame:
    """``(pattern)``: distinct path-like tokens of the documents."""
    return docs.select(F.explode(path_tokens(F.col(text_col))).alias("pattern")).distinct()


def sections_of_snippets(snippets: DataFrame, path_col: str, text_col: str, sections: Sections = SECTIONS, wanted: list[str] | None = None) -> DataFrame:
    """``(section, path, text)``: every section one of whose keywords is part of the text, whole words or not."""
    low = F.lower(text_col)
    use = [s for s in sections if wanted is None or s[0] in wanted]
    if not use:
        return snippets.select(F.lit("").alias("section"), path_col, text_col).limit(0)
    hits = F.array(*[F.when(reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words]), F.lit(name)) for name, _, words in use])
    return snippets.select(F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("section"), path_col, text_col)
