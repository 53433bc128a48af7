"""Course hierarchy of documents as flat node tables.

Running counters and parents are carried over slices of the section order, so
one very long document does not end up in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillspark.functions import text as tx
from quillspark.operators.ordered import last_before, running, top_k

SLICE = 1024


def section_tree(sections: DataFrame) -> DataFrame:
    """Each section with its parent: the nearest earlier one of a smaller level."""
    rank = F.element_at(F.create_map(F.lit("h1"), F.lit(1), F.lit("h2"), F.lit(2), F.lit("h3"), F.lit(3)), F.lower("level"))
    node = F.concat(F.lit("n_"), F.lpad(F.col("section_ord").cast("string"), 5, "0"))
    rows = sections.withColumns({"_level": F.coalesce(rank, F.lit(3)), "node_id": node})
    piece = F.floor(F.col("section_ord") / SLICE)
    rows = last_before(rows, ["doc_id"], ["section_ord"], piece, {"_h1": F.col("node_id")}, F.col("_level") == 1)
    rows = last_before(rows, ["doc_id"], ["section_ord"], piece, {"_h12": F.col("node_id")}, F.col("_level") <= 2)
    parent = F.when(F.col("_level") == 2, F.col("_h1")).when(F.col("_level") == 3, F.col("_h12"))
    return rows.select(
        "doc_id", "section_ord", "node_id", parent.alias("parent_id"),
        F.coalesce(F.nullif(tx.strip("heading"), F.lit("")), F.lit("Untitled")).alias("heading"), "level", "page",
        tx.strip(F.coalesce("content", F.lit(""))).alias("content"))


def course_nodes(sections: DataFrame, subjects: DataFrame | None = None) -> DataFrame:
    """Subject, unit, topic and subtopic nodes of every document.

    Headings of level one become units, of level two topics, deeper ones
    subtopics; content moves into subtopics, and missing ancestors are made up.
    ``subjects(doc_id, subject)`` names the root.
    """
    title = F.coalesce(F.nullif(tx.strip("heading"), F.lit("")), F.lit("Untitled"))
    rows = sections.select(
        "doc_id", "section_ord", F.lower(F.coalesce("level", F.lit("h3"))).alias("level"), title.alias("title"),
        tx.strip(F.coalesce("content", F.lit(""))).alias("content"), F.coalesce("page", F.lit(1)).alias("page"))
    piece = F.floor(F.col("section_ord") / SLICE)
    rows = last_before(rows, ["doc_id"], ["section_ord"], piece, {
        "_before": F.when(F.col("level") != "h1", "topic").when(F.col("content") != "", "topic").otherwise("unit")})
    first, no_topic = F.col("_before").isNull(), F.coalesce(F.col("_before"), F.lit("unit")) == "unit"
    kind = "array<struct<level:string,title:string,content:string>>"
    none = F.expr(f"cast(array() as {kind})")

    def made(level: str, name: Column, content: Column | None = None) -> Column:
        body = content if content is not None else F.lit(None).cast("string")
        return F.array(F.struct(F.lit(level).alias("level"), name.alias("title"), body.alias("content")))

    filled = F.col("content") != ""
    name = F.col("title")
    details = F.when(filled, made("subtopic", F.concat(name, F.lit(" Details")), F.col("content"))).otherwise(none)
    overview = F.when(filled, made("topic", F.concat(name, F.lit(" Overview")))).otherwise(none)
    lead = F.when(first, made("unit", F.lit("General Unit"))).otherwise(none)
    nodes = (
        F.when(F.col("level") == "h1", F.concat(made("unit", name), overview, details))
        .when(F.col("level") == "h2", F.concat(lead, made("topic", name), details))
        .otherwise(F.concat(lead, F.when(no_topic, made("topic", F.lit("General Topic"))).otherwise(none),
                            made("subtopic", name, F.col("content")))))
    listed = rows.select("doc_id", "section_ord", "page", F.posexplode(nodes).alias("_p", "_n")).select(
        "doc_id", "section_ord", "page", "_p", "_n.*")
    order = ["section_ord", "_p"]
    counted = running(listed, ["doc_id"], order, piece, {
        "sort_order": F.lit(1), **{f"_{k}": F.when(F.col("level") == k, 1).otherwise(0) for k in ("unit", "topic", "subtopic")}})
    ordinal = F.when(F.col("level") == "unit", F.col("_unit")).when(F.col("level") == "topic", F.col("_topic")).otherwise(F.col("_subtopic"))
    named = counted.withColumn("node_id", tx.node_id(F.col("level"), ordinal, F.col("title")))
    named = last_before(named, ["doc_id"], order, piece, {"_in_unit": F.col("node_id")}, F.col("level") == "unit")
    named = last_before(named, ["doc_id"], order, piece, {"_in_topic": F.col("node_id")}, F.col("level") == "topic")
    roots = sections.select("doc_id").distinct()
    roots = roots.join(subjects, "doc_id", "left") if subjects is not None else roots.withColumn("subject", F.lit(None).cast("string"))
    subject = F.coalesce(F.nullif(tx.strip("subject"), F.lit("")), F.lit("General Studies"))
    roots = roots.select("doc_id", subject.alias("title")).withColumn(
        "node_id", tx.node_id(F.lit("subject"), F.lit(1), F.col("title")))
    below = named.join(roots.select("doc_id", F.col("node_id").alias("_root")), "doc_id").select(
        "doc_id", "node_id",
        F.when(F.col("level") == "unit", F.col("_root")).when(F.col("level") == "topic", F.col("_in_unit"))
        .otherwise(F.col("_in_topic")).alias("parent_id"),
        "level", "title", "content", "page", "sort_order")
    top = roots.select("doc_id", "node_id", F.lit(None).cast("string").alias("parent_id"), F.lit("subject").alias("level"), "title",
                       F.lit(None).cast("string").alias("content"), F.lit(1).alias("page"), F.lit(0).cast("bigint").alias("sort_order"))
    return top.unionByName(below)


def readable_tree(nodes: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Nodes with their place among their siblings; ``max_chars`` cuts the content."""
    parent = nodes.withColumn("_parent", F.coalesce("parent_id", F.lit("")))
    placed = running(parent, ["doc_id", "_parent"], ["sort_order"], F.floor(F.col("sort_order") / SLICE), {"child_ord": F.lit(1)})
    return placed.withColumn("content", tx.head(tx.strip(F.coalesce("content", F.lit(""))), max_chars)).withColumn(
        "has_content", F.col("content") != "").drop("_parent")


def breadcrumbs(nodes: DataFrame) -> DataFrame:
    """Path from the subject to every subtopic title; the last node of a title wins."""
    def up(i: int) -> DataFrame:
        return nodes.select("doc_id", F.col("node_id").alias(f"_p{i}"), F.col("title").alias(f"_t{i}"),
                            F.col("parent_id").alias(f"_p{i + 1}"))

    rows = nodes.where("level = 'subtopic'").select("doc_id", "title", "node_id", "sort_order", F.col("parent_id").alias("_p1"))
    for i in (1, 2, 3):
        rows = rows.join(up(i), ["doc_id", f"_p{i}"], "left")
    path = F.concat_ws(" > ", "_t3", "_t2", "_t1", "title")
    return rows.groupBy("doc_id", "title").agg(F.max_by(path, F.col("sort_order")).alias("path"))


def fallback_tree(chunks: DataFrame, texts: int = 4, limit: int = 200) -> DataFrame:
    """A flat tree from chunk sections: four texts each, 200 sections, first seen first.

    ``chunks(doc_id, position, section, text)``.
    """
    rows = chunks.withColumn("section", tx.strip(F.coalesce("section", F.lit("")))).where("section <> ''")
    seen = rows.groupBy("doc_id", "section").agg(F.min("position").alias("_first"))
    ordered = top_k(seen, ["doc_id"], [F.asc("_first")], limit, "ordinal")
    filled = rows.withColumn("text", tx.strip("text")).where("text <> ''")
    head = top_k(filled, ["doc_id", "section"], [F.asc("position")], texts, "_r")
    parts = F.array_sort(F.collect_list(F.struct("_r", "text")))
    bodies = head.groupBy("doc_id", "section").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n\n").alias("content"))
    nodes = ordered.join(bodies, ["doc_id", "section"], "left")
    return nodes.select("doc_id", F.concat(F.lit("n_"), F.lpad(F.col("ordinal").cast("string"), 5, "0")).alias("node_id"),
                        F.lit("n_00000").alias("parent_id"), F.col("section").alias("heading"),
                        F.coalesce("content", F.lit("")).alias("content"))


def folded(title: Column) -> Column:
    return F.array_join(tx.words(F.lower(F.coalesce(title, F.lit("")))), " ")


def locate_nodes(chunks: DataFrame, nodes: DataFrame) -> DataFrame:
    """The subtopic node of every chunk, by its section title.

    The title itself is tried before its "… Details" form, an exact spelling
    before a case- and space-folded one; among equal titles the one on the
    chunk's page wins, then the first. ``chunks(doc_id, chunk_id, section, page)``.
    """
    subs = nodes.where("level = 'subtopic'").select(
        "doc_id", "node_id", F.col("page").alias("_page"), "sort_order", tx.strip("title").alias("_title"),
        folded(F.col("title")).alias("_key"))
    section = tx.strip(F.coalesce("section", F.lit("")))
    rows = chunks.withColumn("_sec", section)
    tries = F.array(*[F.struct(F.lit(p).alias("p"), t.alias("t")) for p, t in (
        (0, F.col("_sec")), (1, F.concat("_sec", F.lit(" Details"))))])
    asked = rows.where("_sec <> ''").select("doc_id", "chunk_id", F.col("page").alias("_at"), F.explode(tries).alias("_x")).select(
        "doc_id", "chunk_id", "_at", F.col("_x.p").alias("_try"), F.col("_x.t").alias("_want"), folded(F.col("_x.t")).alias("_key"))
    found = asked.join(subs, ["doc_id", "_key"])
    order = F.struct(F.col("_try").alias("a"), (F.col("_title") != F.col("_want")).cast("int").alias("b"),
                     (F.col("_page") != F.col("_at")).cast("int").alias("c"), F.col("sort_order").alias("d"))
    best = found.groupBy("doc_id", "chunk_id").agg(F.min_by(F.struct("node_id", "_title"), order).alias("_b"))
    return rows.join(best, ["doc_id", "chunk_id"], "left").withColumns({
        "node_id": F.coalesce("_b.node_id", F.lit("")),
        "node_title": F.when(F.col("_sec") == "", "").otherwise(F.coalesce("_b._title", F.concat("_sec", F.lit(" Details"))))}).drop("_b", "_sec")


def decorate_hits(hits: DataFrame, nodes: DataFrame, titles: DataFrame) -> DataFrame:
    """Hits with node, path and display title. ``titles(doc_id, filename)``."""
    located = locate_nodes(hits, nodes)
    paths = breadcrumbs(nodes)
    by_node = paths.select("doc_id", F.col("title").alias("node_title"), F.col("path").alias("_path"))
    by_section = paths.select("doc_id", F.col("title").alias("section"), F.col("path").alias("_spath"))
    rows = located.join(by_node, ["doc_id", "node_title"], "left").join(by_section, ["doc_id", "section"], "left").join(
        titles, "doc_id", "left")
    name = F.coalesce(F.nullif("filename", F.lit("")), F.col("doc_id").cast("string"))
    return rows.withColumns({
        "section_path": F.coalesce("_path", "_spath", "section"), "filename": name,
        "title": F.coalesce(F.nullif("node_title", F.lit("")), F.nullif("section", F.lit("")), name)}).drop("_path", "_spath")


def library_tree(nodes: DataFrame, titles: DataFrame) -> DataFrame:
    """Every node below the subject of its document, ready to nest by subject and document."""
    subjects = nodes.where("level = 'subject'").select("doc_id", F.col("title").alias("subject"))
    below = nodes.where("level <> 'subject'")
    return below.join(subjects, "doc_id", "left").join(titles, "doc_id", "left").select(
        F.coalesce("subject", F.lit("General Studies")).alias("subject"), "doc_id",
        F.coalesce(F.nullif("filename", F.lit("")), F.col("doc_id").cast("string")).alias("document_title"), "node_id", "parent_id",
        "title", "level", "page", "sort_order", (tx.strip(F.coalesce("content", F.lit(""))) != "").alias("has_content"))
