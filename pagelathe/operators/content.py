"""What pages say: title, language, outline and its violations, words, split (STF23-25, WIN5, WIN14, AGG17, AGG18)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelathe.functions import text as T
from pagelathe.session import spread

MAIN_ROLES, FRAME_ROLES = ("main", "article"), ("navigation", "banner", "contentinfo", "complementary", "search")


def outline(nodes: DataFrame) -> DataFrame:
    """``page_id, pos, level, text`` of headings: h1 to h6, and role heading with its aria-level (2 without one)."""
    level = F.when(F.col("tag").rlike("^h[1-6]$"), F.substring("tag", 2, 1).cast("int")).otherwise(F.coalesce(F.col("attrs")["aria-level"].try_cast("int"), F.lit(2)))
    heads = nodes.where(F.col("tag").rlike("^h[1-6]$") | (F.col("attrs")["role"] == "heading"))
    w = Window.partitionBy("page_id").orderBy("node_id")
    return heads.select("page_id", (F.row_number().over(w) - 1).alias("pos"), level.alias("level"), F.coalesce("text", "own_text").alias("text"))


def outline_violations(heads: DataFrame, key: str = "page_id") -> DataFrame:
    """``key, kind, pos, level``: a level skipped, a further h1, or no h1 at all (then pos is null).

    A page that opens below h1 misses its h1; it does not skip.  Null levels are no headings.
    """
    heads = heads.where(F.col("level").isNotNull())
    w = Window.partitionBy(key).orderBy("pos")
    marked = heads.withColumn("before", F.lag("level").over(w)).withColumn("h1s", F.sum((F.col("level") == 1).cast("int")).over(w))
    skipped = marked.where(F.col("level") > F.col("before") + 1).select(key, F.lit("skipped-level").alias("kind"), "pos", "level")
    more = marked.where((F.col("level") == 1) & (F.col("h1s") > 1)).select(key, F.lit("multiple-h1").alias("kind"), "pos", "level")
    none = heads.groupBy(key).agg(F.sum((F.col("level") == 1).cast("int")).alias("h1s"), F.min_by("level", "pos").alias("level")).where(F.col("h1s") == 0)
    return skipped.unionByName(more).unionByName(none.select(key, F.lit("missing-h1").alias("kind"), F.lit(None).cast("int").alias("pos"), "level"))


def report_outline(content_reports: DataFrame) -> DataFrame:
    """The outline of each report as rows."""
    return content_reports.select("report_id", F.posexplode("outline").alias("pos", "h")).select("report_id", "pos", F.col("h.level").alias("level"), F.col("h.text").alias("text"))


def word_counts(pages: DataFrame) -> DataFrame:
    """``page_id, n_words, minutes`` of the text of each page; null html gives 0."""
    n = T.word_count(T.plain(F.col("html")))
    return pages.select("page_id", n.cast("long").alias("n_words")).withColumn("minutes", T.reading_minutes(F.col("n_words")))


def stopword_language(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, lang``: the script that settles it, else a strict winner among everyday words with three hits or more.

    Texts that decide nothing have no row.  The words of a text are counted in one pass over it; no join.
    """
    t = F.coalesce(F.col("text"), F.lit(""))
    script = F.lit(None).cast("string")
    for lang, pattern in reversed(T.SCRIPTS):
        script = F.when(F.regexp_count(t, F.lit(pattern)) >= T.SCRIPT_HITS, lang).otherwise(script)
    script = F.when(t.rlike("[\u0370-\ud7af]"), script)  # most texts have no such letter and are scanned once
    known = sorted({w for listed in T.STOPWORDS.values() for w in listed.split()})
    words = F.filter(F.regexp_extract_all(F.lower(t), F.lit(T.WORD), F.lit(0)), lambda w: w.isin(*known))

    def votes(found):
        def hits(listed: str):
            return F.size(F.filter(found, lambda w: w.isin(*listed.split())))

        return F.sort_array(F.array(*[F.struct(hits(s).alias("n"), F.lit(lang).alias("lang")) for lang, s in T.STOPWORDS.items()]), asc=False)

    # bound by a lambda, so that the words of a text are found once and not once a language
    found = spread(documents.select(key, "text")).select(key, script.alias("script"), F.transform(F.array(words), votes)[0].alias("v"))
    best, second = F.col("v")[0], F.col("v")[1]
    vote = F.when((best["n"] >= T.WORD_HITS) & (best["n"] > second["n"]), best["lang"])
    return found.select(key, F.coalesce("script", vote).alias("lang")).where(F.col("lang").isNotNull())


def split_content(nodes: DataFrame) -> DataFrame:
    """``page_id, main_chars, frame_chars, total_chars, main_share, confidence`` by landmarks alone, outermost first.

    Infers no main region; ``page_tree.splits`` does.  With a main landmark the confidence is 0.75 + 0.2 * share; with frame landmarks alone, 0.25 + 0.35 * share
    of what they leave; 0.1 without any landmark, 0 without text.
    """
    prose = nodes.where(~F.col("tag").isin("script", "style", "noscript", "template", "title", "head") & (F.length("own_text") > 0) & F.array_contains("tags", "body"))
    chain = F.filter(F.concat("roles", F.array(F.coalesce("role", F.lit("")))), lambda r: r.isin(*MAIN_ROLES, *FRAME_ROLES))
    outer = F.try_element_at(chain, F.lit(1))
    n = F.length("own_text")
    sums = prose.groupBy("page_id").agg(
        F.sum(F.when(outer.isin(*MAIN_ROLES), n).otherwise(0)).alias("main_chars"), F.sum(F.when(outer.isin(*FRAME_ROLES), n).otherwise(0)).alias("frame_chars"), F.sum(n).alias("total_chars")
    )
    rest = F.col("total_chars") - F.col("frame_chars")
    main = F.when(F.col("main_chars") > 0, F.col("main_chars")).otherwise(F.when(F.col("frame_chars") > 0, rest).otherwise(F.col("total_chars")))
    share = F.round(main / F.col("total_chars"), 4)
    confidence = F.when(F.col("main_chars") > 0, 0.75 + 0.2 * share).when(F.col("frame_chars") > 0, 0.25 + 0.35 * share).otherwise(0.1)
    return sums.select("page_id", main.alias("main_chars"), "frame_chars", "total_chars", share.alias("main_share"), F.round(confidence, 2).alias("confidence"))
