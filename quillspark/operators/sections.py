"""From raw pages, markdown, HTML or sheets to headed sections.

A document is one row, so everything about its lines is done with array
functions inside the row: no line-level shuffle, whatever the corpus size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillspark.functions import text as tx

HEADING = r"(?md)^(#{1,6})\s+([^\n]+)"


def strip_running_lines(pages: Column) -> Column:
    """Remove the header and footer lines repeated on at least half of the pages."""
    def edge(page: Column, index: int) -> Column:
        filled = F.filter(F.transform(F.split(page, "\n"), tx.strip), lambda s: s != "")
        return F.when(F.size(filled) > 0, F.element_at(filled, index))

    def repeated(lines: Column, n: Column) -> Column:
        return F.filter(F.array_distinct(lines), lambda s: s.isNotNull() & (F.length(s) < 120) & (
            F.size(F.filter(lines, lambda x: x == s)) >= n * 0.5))

    def clean(marks: Column) -> Column:
        def one(page: Column) -> Column:
            lines = F.split(page, "\n")
            kept = F.filter(lines, lambda s, i: ~(F.array_contains(marks["head"], tx.strip(s)) & (i < 3)) & ~(
                F.array_contains(marks["foot"], tx.strip(s)) & (i > F.size(lines) - 4)))
            return F.array_join(kept, "\n")
        return F.transform(pages, one)

    def with_edges(edges: Column) -> Column:
        n = F.size(pages)
        marks = F.struct(repeated(edges["first"], n).alias("head"), repeated(edges["last"], n).alias("foot"))
        return tx.bind(marks, clean)

    edges = F.struct(F.transform(pages, lambda p: edge(p, 1)).alias("first"),
                     F.transform(pages, lambda p: edge(p, -1)).alias("last"))
    return F.when(F.size(pages) < 3, pages).otherwise(tx.bind(edges, with_edges))


def estimate_page(content: Column, pages: Column, chars: int | None = None) -> Column:
    """Page sharing most of the distinct words of a section (of its first ``chars`` characters); 1 if none does."""
    snippet = F.array_distinct(tx.words(F.lower(tx.strip(tx.head(content, chars)))))

    def best(overlaps: Column) -> Column:
        top = F.array_max(overlaps)
        return F.when(top > 0, F.array_position(overlaps, top)).otherwise(1).cast("int")

    overlaps = tx.bind(snippet, lambda words: F.transform(
        pages, lambda p: F.size(F.array_intersect(words, tx.words(F.lower(p))))))
    return F.when(F.coalesce(F.size(pages), F.lit(0)) < 1, 1).otherwise(tx.bind(overlaps, best))


def extract_tables(text: Column) -> Column:
    """Runs of lines starting with ``|`` as arrays of rows of trimmed cells."""
    blank = r"[\t\x0b\f\r\x1c-\x20\x85\p{Z}]*"
    runs = F.regexp_extract_all(text, F.lit(rf"((?:(?:^|\n){blank}\|[^\n]*)+)"), F.lit(1))

    def cells(line: Column) -> Column:
        parts = F.split(line, r"\|")
        return F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))), tx.strip)

    def rows(run: Column) -> Column:
        lines = F.filter(F.transform(F.split(run, "\n"), tx.strip), lambda s: s.startswith("|"))
        content = F.filter(lines, lambda s: ~F.regexp_like(F.regexp_replace(s, r"\|", ""), F.lit(r"^[\s\-:]+$")))
        return F.transform(content, cells)

    return F.filter(F.transform(runs, rows), lambda t: F.size(t) > 1)


def split_headings(docs: DataFrame) -> DataFrame:
    """Markdown documents to sections; text before the first heading is not one.

    ``docs(doc_id, content, pages)``, ``pages`` an array that may be null.
    """
    pieces = F.split(F.col("content"), r"(?md)(?=^#{1,6}\s+[^\n])")
    exploded = docs.select("doc_id", "pages", F.posexplode(pieces).alias("_pos", "_piece")).where(
        F.regexp_like("_piece", F.lit(r"^#{1,6}\s+[^\n]")))
    marks = F.regexp_extract("_piece", HEADING, 1)
    body = tx.strip(F.regexp_replace("_piece", r"\A#{1,6}\s+[^\n]+", ""))
    sections = exploded.select(
        "doc_id", "pages", "_pos", tx.strip(F.regexp_extract("_piece", HEADING, 2)).alias("heading"),
        F.when(F.length(marks) == 1, "h1").when(F.length(marks) == 2, "h2").otherwise("h3").alias("level"),
        body.alias("content")).where("content <> ''")
    order = Window.partitionBy("doc_id").orderBy("_pos")
    return sections.withColumns({
        "section_ord": F.row_number().over(order),
        "page": estimate_page(F.col("content"), F.col("pages")),
    }).drop("_pos", "pages")


def normalize(docs: DataFrame, source_type: str = "markdown") -> DataFrame:
    """Sections of every document; one without headings is a single section."""
    headed = split_headings(docs)
    plain = docs.join(headed.select("doc_id").distinct(), "doc_id", "left_anti").select(
        "doc_id", F.lit("Document Content").alias("heading"), F.lit("h1").alias("level"),
        tx.strip(F.col("content")).alias("content"), F.lit(1).alias("section_ord"),
        estimate_page(F.col("content"), F.col("pages")).alias("page"))
    both = headed.unionByName(plain)
    return both.withColumn("tables", extract_tables(F.col("content"))).withColumn(
        "metadata", F.create_map(F.lit("source_type"), F.lit(source_type)))


def sheet_sections(rows: DataFrame) -> DataFrame:
    """Worksheet rows to one h1 section per sheet.

    ``rows(doc_id, sheet_no, sheet, row_no, cells)``. A worksheet has at most
    1,048,576 rows in its file format, which bounds the group.
    """
    line = F.array_join(F.transform("cells", lambda c: F.coalesce(c, F.lit(""))), " | ")
    filled = F.exists("cells", lambda c: tx.strip(F.coalesce(c, F.lit(""))) != "")
    listed = rows.withColumn("_line", F.when(filled, line))
    grouped = listed.groupBy("doc_id", "sheet_no", "sheet").agg(
        F.array_sort(F.collect_list(F.when(F.col("_line").isNotNull(), F.struct("row_no", "_line")))).alias("_l"))
    return grouped.select(
        "doc_id", F.col("sheet_no").alias("section_ord"), F.col("sheet").alias("heading"), F.lit("h1").alias("level"),
        F.array_join("_l._line", "\n").alias("content"), F.col("sheet_no").alias("page")
    ).withColumn("tables", extract_tables(F.col("content"))).withColumn(
        "metadata", F.create_map(F.lit("source_type"), F.lit("excel")))


# Named entities and the characters they stand for.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "),
            ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")]


def html_to_markdown(html: Column) -> Column:
    """Readable text of a page with its headings as ``#`` lines."""
    text = F.regexp_replace(html, r"(?is)<(script|style|nav|head)\b.*?</\1>|<!--.*?-->", "")
    for depth in range(1, 7):
        text = F.regexp_replace(text, rf"(?i)<h{depth}\b[^>]*>", "\n\n" + "#" * depth + " ")
    text = F.regexp_replace(text, r"(?i)</(h[1-6]|p|div|li|tr|article|footer|ul|table)>|<(br|p)\b[^>]*>", "\n")
    text = F.regexp_replace(text, r"<[^>]*>", "")
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return tx.strip(F.regexp_replace(text, r"[ \t]*\n\s*", "\n"))


def page_sections(pages: DataFrame) -> DataFrame:
    """``pages(page_id, html)`` to sections of one document per page."""
    docs = pages.select(F.col("page_id").alias("doc_id"), html_to_markdown(F.col("html")).alias("content"),
                        F.expr("cast(null as array<string>)").alias("pages"))
    return normalize(docs, "html")
