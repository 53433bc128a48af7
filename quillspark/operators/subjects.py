"""Subject classification and the subject library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quillspark.functions import labels as lb, text as tx
from quillspark.operators.suggest import similar_pairs
from quillspark.plans.lineage import cut

# Subjects in order of precedence with their keywords.
SUBJECT_KEYWORDS = {
    "Machine Learning": ["machine learning", "supervised", "unsupervised", "regression", "classification", "overfitting",
                         "neural network"],
    "Python": ["python", "pip", "numpy", "pandas", "def ", "list comprehension", "tuple", "dictionary", "django", "flask"],
    "Computer Programming": ["programming", "algorithm", "java", "c++", "javascript", "function", "variable", "loop",
                             "compiler"],
    "Data Structures": ["array", "linked list", "stack", "queue", "tree", "graph", "sorting", "hash table"],
    "Operating Systems": ["process", "thread", "scheduler", "kernel", "paging", "deadlock", "semaphore", "ipc"],
    "Database Systems": ["sql", "database", "query", "normalization", "transaction", "indexing", "join", "acid"],
    "Artificial Intelligence": ["artificial intelligence", "intelligent agent", "knowledge representation",
                                "expert system", "search", "planning", "inference", "heuristic", "logic programming"],
    "Aerospace Engineering": ["aerospace", "propulsion", "thrust", "turbine", "compressor", "rocket", "nozzle",
                              "jet engine"],
    "Computer Networks": ["tcp", "udp", "ip", "routing", "network", "protocol", "osi", "dns", "http"],
}
# Extra points for a pattern found at least once.
SUBJECT_BONUS = {
    "Artificial Intelligence": [(r"\bartificial intelligence\b", 6), (r"\bai\b", 4), (r"\bintelligent agents?\b", 3),
                                (r"\bmachine learning\b", -1)],
    "Machine Learning": [(r"\bmachine learning\b", 4), (r"\bml\b", 2), (r"\bartificial intelligence\b", -1)],
    "Python": [(r"\bpython\b", 6), (r"\bpython programming\b", 6), (r"\bdef\s+[a-zA-Z_]\w*\s*\(", 2)],
    "Computer Programming": [(r"\bcomputer programming\b", 5), (r"\bpython\b", -2)],
}


def _bounded(keyword: str) -> str:
    escaped = "".join("\\" + c if c in "+.*?()[]{}^$|\\" else c for c in keyword)
    return r"(?U)\b" + escaped + r"\b"


def keyword_score(text: Column, keywords: list[str], bonus: list[tuple[str, int]]) -> Column:
    """Phrases count twice, words once at word boundaries, plus the bonus patterns."""
    score = F.lit(0)
    for word in keywords:
        if " " in word:
            score = score + (F.length(text) - F.length(F.replace(text, F.lit(word), F.lit("")))) / len(word) * 2
        else:
            score = score + F.regexp_count(text, F.lit(_bounded(word)))
    for pattern, points in bonus:
        score = score + F.when(F.regexp_like(text, F.lit("(?U)" + pattern)), points).otherwise(0)
    return score.cast("int")


def classify(samples: DataFrame, keywords: dict[str, list[str]] = SUBJECT_KEYWORDS,
             bonus: dict[str, list[tuple[str, int]]] = SUBJECT_BONUS, chars: int | None = None) -> DataFrame:
    """Best-scoring subject of every sample; a plain projection.

    ``samples(doc_id, sample)``. ``subject`` needs two points, ``fallback``
    takes any positive score; equal scores go to the earlier subject.
    """
    lowered = samples.withColumn("_t", F.lower(tx.head(F.coalesce("sample", F.lit("")), chars)))
    scored = lowered.withColumn("_s", F.array(*[
        keyword_score(F.col("_t"), words, bonus.get(name, [])) for name, words in keywords.items()]))
    names = F.array(*[F.lit(n) for n in keywords])
    top = F.array_max("_s")
    winner = F.element_at(names, F.array_position("_s", top).cast("int"))
    return scored.withColumns({
        "score": F.greatest(top, F.lit(0)),
        "subject": F.when(top >= 2, winner).otherwise("General Studies"),
        "fallback": F.when(top > 0, winner).otherwise("General Studies")}).drop("_t", "_s")


def sample_text(chunks: DataFrame, chars: int | None = None) -> DataFrame:
    """A document's sampled chunks as one text; ``chars`` cuts each chunk."""
    line = F.concat(F.lit("[Section: "), F.coalesce("section", F.lit("Unknown")), F.lit("]\n"), tx.head(F.col("text"), chars))
    parts = F.array_sort(F.collect_list(F.struct("sample_ord", line.alias("t"))))
    return chunks.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda p: p["t"]), "\n\n").alias("sample"))


def canonical_subjects(labels: DataFrame, floor: float = 0.62) -> DataFrame:
    """Replace each document's label by the most similar label of the other documents.

    ``labels(doc_id, subject)``. Similarity is the larger of the sequence ratio
    and the token Jaccard, computed between distinct labels only; a label its
    document alone uses does not match itself.
    """
    named = labels.withColumn("subject", F.coalesce(F.nullif(tx.strip("subject"), F.lit("")), F.lit("General Studies")))
    distinct = named.groupBy("subject").agg(F.count("*").alias("_uses")).withColumn("_low", F.lower("subject"))
    left = distinct.select(F.col("_low").alias("word")).distinct()
    pairs = similar_pairs(left, left.withColumnRenamed("word", "term"), floor, word_first=True)
    tokens = F.array_distinct(F.regexp_extract_all("_low", F.lit("([a-z0-9]+)"), F.lit(1)))
    tokened = distinct.select("_low").distinct().withColumn("_tok", tokens)
    shared = tokened.select(F.col("_low").alias("word"), F.size("_tok").alias("_na"), F.explode("_tok").alias("_k")).join(
        tokened.select(F.col("_low").alias("term"), F.size("_tok").alias("_nb"), F.explode("_tok").alias("_k")), "_k")
    jaccard = shared.groupBy("word", "term", "_na", "_nb").agg(F.count("*").alias("_c")).select(
        "word", "term", (F.col("_c") / (F.col("_na") + F.col("_nb") - F.col("_c"))).alias("ratio"))
    best = pairs.unionByName(jaccard).groupBy("word", "term").agg(F.max("ratio").alias("ratio")).where(F.col("ratio") >= floor)
    options = (
        best.join(distinct.select(F.col("_low").alias("word"), F.col("subject").alias("_mine")), "word")
        .join(distinct.select(F.col("_low").alias("term"), F.col("subject").alias("_other"), "_uses"), "term")
        .where((F.col("_mine") != F.col("_other")) | (F.col("_uses") > 1))
    )
    chosen = options.groupBy(F.col("_mine").alias("subject")).agg(
        F.max_by("_other", F.struct("ratio", (F.col("_mine") == F.col("_other")).alias("same"), "_uses", "_other")).alias("canonical"))
    return named.join(chosen, "subject", "left").withColumn("canonical", F.coalesce("canonical", "subject"))


def reclassify(samples: DataFrame, keywords: dict[str, list[str]] = SUBJECT_KEYWORDS,
               bonus: dict[str, list[tuple[str, int]]] = SUBJECT_BONUS) -> DataFrame:
    """Subject of every ready document, made canonical; documents without text get an error."""
    classified = classify(samples, keywords, bonus).withColumn("error", F.when(F.coalesce("sample", F.lit("")) == "", "no text"))
    subject = lb.sanitize_subject(F.col("subject"))
    clean = classified.withColumn("subject", F.when(subject == "General", "General Studies").otherwise(subject))
    clean = cut(clean.select("doc_id", "subject", "score", "error"))
    return canonical_subjects(clean.where("error is null").select("doc_id", "subject", "score")).unionByName(
        clean.where("error is not null").select("doc_id", "subject", "score", F.lit(None).cast("string").alias("canonical"), "error"),
        allowMissingColumns=True)


# --- library ------------------------------------------------------------------------

def add_to_library(library: DataFrame, additions: DataFrame) -> DataFrame:
    """Append documents to their subjects, the earlier entry of a pair winning."""
    both = library.select("subject", "doc_id", "title", F.lit(0).alias("_o")).unionByName(
        additions.select("subject", "doc_id", "title", F.lit(1).alias("_o")))
    return both.groupBy("subject", "doc_id").agg(F.min_by("title", F.struct("_o", "title")).alias("title"))


def library_subjects(library: DataFrame) -> DataFrame:
    """Subjects with their document counts; an empty subject has no row."""
    return library.groupBy("subject").agg(F.count("*").alias("doc_count"))


def remove_from_library(library: DataFrame, removals: DataFrame) -> DataFrame:
    """Drop documents; a removal without a subject applies to all subjects."""
    everywhere = removals.where("subject is null").select("doc_id")
    left = library.join(everywhere, "doc_id", "left_anti")
    return left.join(removals.where("subject is not null").select("subject", "doc_id"), ["subject", "doc_id"], "left_anti")


def subject_of(documents: DataFrame, library: DataFrame) -> DataFrame:
    """The (first) subject a document is filed under, else the default."""
    first = library.groupBy("doc_id").agg(F.min("subject").alias("_s"))
    return documents.join(first, "doc_id", "left").withColumn("subject", F.coalesce(F.nullif("_s", F.lit("")), F.lit("General Studies"))).drop("_s")
