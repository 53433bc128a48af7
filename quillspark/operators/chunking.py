"""Sections to chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillspark.functions import text as tx

TARGET_WORDS = 350
MIN_WORDS = 120
OVERLAP = 2
WINDOW, STEP, WHOLE = 375, 325, 400


def group_sentences(sents: Column, target: int = TARGET_WORDS, smallest: int = MIN_WORDS) -> Column:
    """Sentence groups of at least ``target`` words, two sentences of overlap.

    The fold keeps sentence numbers only; the texts are cut out once at the
    end. A tail under ``smallest`` words joins the last group, with the
    overlap it already holds.
    """
    start_state = F.struct(
        F.lit(0).alias("i"), F.lit(1).alias("start"), F.lit(0).alias("words"), F.lit(0).alias("last"),
        F.expr("cast(array() as array<struct<a:int,b:int>>)").alias("cuts"))

    def step(acc: Column, count: Column) -> Column:
        i, total = acc["i"] + 1, acc["words"] + count
        emit = total >= target
        carries = (i - acc["start"] + 1) > OVERLAP
        return F.struct(
            i.alias("i"),
            F.when(emit & carries, i - (OVERLAP - 1)).when(emit, i + 1).otherwise(acc["start"]).alias("start"),
            F.when(emit & carries, acc["last"] + count).when(emit, 0).otherwise(total).alias("words"),
            count.alias("last"),
            F.when(emit, F.concat(acc["cuts"], F.array(F.struct(acc["start"].alias("a"), i.alias("b")))))
            .otherwise(acc["cuts"]).alias("cuts"))

    def build(bound: Column) -> Column:
        s = bound["s"]

        def joined(a: Column, b: Column) -> Column:
            return F.array_join(F.slice(s, a, b - a + 1), " ")

        def finish(acc: Column) -> Column:
            texts = F.transform(acc["cuts"], lambda c: joined(c["a"], c["b"]))
            tail = joined(acc["start"], acc["i"])
            merged = F.concat(
                F.slice(texts, 1, F.greatest(F.size(texts) - 1, F.lit(0))),
                F.array(F.concat_ws(" ", F.element_at(texts, -1), tail)))
            return (
                F.when(acc["start"] > acc["i"], texts)
                .when((acc["words"] < smallest) & (F.size(texts) > 0), merged)
                .otherwise(F.concat(texts, F.array(tail)))
            )

        return F.aggregate(bound["n"], start_state, step, finish)

    counted = tx.bind(sents, lambda s: F.struct(s.alias("s"), F.transform(s, tx.word_count).alias("n")))
    return F.when(F.size(sents) == 0, F.expr("cast(array() as array<string>)")).otherwise(tx.bind(counted, build))


def eav_lines(table: Column) -> Column:
    """A table as ``Entity | Attribute | Value`` lines, the header naming the attributes."""
    header = F.element_at(table, 1)

    def lines(row: Column) -> Column:
        entity = F.when(F.size(row) > 0, F.element_at(row, 1)).otherwise("Unknown")
        return F.transform(row, lambda value, i: F.concat(
            F.lit("Entity: "), entity, F.lit(" | Attribute: "),
            F.when(i < F.size(header), F.get(header, i)).otherwise(
                F.concat(F.lit("Column_"), (i + 1).cast("string"))),
            F.lit(" | Value: "), value))

    body = F.slice(table, 2, F.greatest(F.size(table) - 1, F.lit(1)))
    return F.when(F.size(table) < 2, "").otherwise(F.array_join(F.flatten(F.transform(body, lines)), "\n"))


def parent_text(heading: Column, content: Column) -> Column:
    return tx.bind(tx.words(content), lambda w: F.concat(
        heading, F.lit("\n\n"), F.array_join(F.slice(w, 1, 100), " "), F.when(F.size(w) > 100, "...").otherwise("")))


def chunk_key(doc_id: Column, section: Column, kind: Column, ordinal: Column) -> Column:
    """A content-derived id, equal on every run."""
    seed = F.concat_ws("|", doc_id.cast("string"), section.cast("string"), kind, ordinal.cast("string"))
    return F.concat(F.lit("c_"), F.substring(F.sha2(seed, 256), 1, 12))


def chunk_sections(sections: DataFrame) -> DataFrame:
    """Parent, table and text chunks of every section, in one pass over the rows.

    Table chunks under ten words are dropped, and so are text chunks under
    fifty: only longer ones can be valid or worth keeping.
    """
    piece = "struct<type:string,ord:int,text:string>"

    def pieces(kind: str, texts: Column) -> Column:
        return F.transform(texts, lambda t, i: F.struct(F.lit(kind).alias("type"), (i + 1).alias("ord"), t.alias("text")))

    tables = F.transform(F.coalesce("tables", F.expr("cast(array() as array<array<array<string>>>)")), eav_lines)
    parents = F.array(parent_text(F.col("heading"), F.col("content")))
    texts = F.transform(group_sentences(tx.sentences(F.col("content"))), tx.strip)
    everything = F.concat(*[p.cast(f"array<{piece}>") for p in (
        pieces("parent", parents), pieces("table", tables), pieces("text", texts))])
    filled = sections.where(tx.strip("content") != "")
    rows = filled.select("doc_id", "section_ord", F.col("heading").alias("section"), "page", "level",
                         F.explode(everything).alias("_p")).select("*", "_p.*").drop("_p")
    rows = rows.withColumn("word_count", tx.word_count(F.col("text")))
    enough = (F.col("type") == "parent") | ((F.col("type") == "table") & (F.col("word_count") >= 10)) | (
        (F.col("type") == "text") & (F.col("word_count") >= 50))
    kept = rows.withColumn("kept", enough)
    owner = chunk_key(F.col("doc_id"), F.col("section_ord"), F.lit("parent"), F.lit(1))
    return kept.withColumns({
        "chunk_id": chunk_key(F.col("doc_id"), F.col("section_ord"), F.col("type"), F.col("ord")),
        "parent_id": F.when(F.col("type") != "parent", owner),
    })


def chunk_summary(chunks: DataFrame) -> DataFrame:
    """Chunk counts per document; takes the output of ``chunk_sections`` with dropped rows."""
    kept = F.col("kept")
    return chunks.groupBy("doc_id").agg(
        F.count_if(kept).alias("total"), F.count_if(kept & (F.col("type") == "parent")).alias("parents"),
        F.count_if(kept & (F.col("type") == "text")).alias("text_chunks"),
        F.count_if(kept & (F.col("type") == "table")).alias("table_chunks"),
        F.count_if(~kept & (F.col("type") == "text")).alias("discarded"))


def sliding_windows(sections: DataFrame) -> DataFrame:
    """Sections of at most 400 words whole, longer ones as overlapping 375-word windows."""
    split = sections.where(tx.strip("content") != "").withColumn("_w", tx.words(F.col("content")))
    n = F.size("_w")
    starts = F.when(n <= WHOLE, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), n - 1, F.lit(STEP)))
    rows = split.withColumn("_n", n).select("*", F.posexplode(starts).alias("_o", "_s"))
    text = F.when(F.col("_n") <= WHOLE, tx.strip("content")).otherwise(
        F.array_join(F.slice("_w", F.col("_s") + 1, WINDOW), " "))
    return rows.select(
        "doc_id", "section_ord", (F.col("_o") + 1).alias("ord"), text.alias("text"),
        F.col("heading").alias("section"),
        chunk_key(F.col("doc_id"), F.col("section_ord"), F.lit("window"), F.col("_o") + 1).alias("chunk_id"))


def fetch_in_order(wanted: DataFrame, chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Chunks named by an id list, in list order; unknown ids are skipped."""
    listed = wanted.select(*keys, F.posexplode("chunk_ids").alias("pos", "chunk_id"))
    return listed.join(chunks, ["chunk_id"])


def spread_sample(chunks: DataFrame, key: str, order: str, slice_by: Column) -> DataFrame:
    """Up to eight chunks whole; else three from the start, the middle and the end."""
    from quillspark.operators.ordered import running

    placed = running(chunks, [key], [order], slice_by, {"_i": F.lit(1)}, totals={"_n": F.lit(1)})
    i, n = F.col("_i") - 1, F.col("_n")
    mid = F.floor(n / 2)
    keep = (n <= 8) | (i < 3) | (i >= n - 3) | ((i >= mid - 1) & (i <= mid + 1))
    return placed.where(keep).withColumn("sample_ord", F.col("_i")).drop("_i", "_n")
