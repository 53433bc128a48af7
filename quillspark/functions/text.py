"""Text preparation and tokenising as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Every character Python's str.split() treats as white space; the same class
# text is valid for Java and for RE2, so the oracle can share it.
SPACE = r"[\t-\r\x1c-\x20\x85\p{Z}]"
WORD = r"[\p{L}\p{N}_]"
NOT_WORD = r"[^\p{L}\p{N}_]"

# White space other than the blank, and the characters up to U+024F no index
# term contains: a table lookup handles them faster than a pattern.
BREAKS = "".join(chr(c) for c in (*range(0x09, 0x0E), *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                                  0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
DROPPED = "".join(chr(c) for c in range(0x21, 0x250)
                  if not (chr(c).isdigit() and c < 0x80) and not "a" <= chr(c) <= "z" and chr(c) not in BREAKS)

# Stop words of the keyword index.
STOP_WORDS = [
    "a", "an", "the", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did",
    "will", "would", "could", "should", "may", "might", "shall", "can", "need", "must", "in", "on", "at", "to", "for",
    "of", "with", "by", "from", "as", "into", "through", "during", "before", "after", "above", "below", "and", "but",
    "or", "nor", "not", "so", "yet", "both", "either", "this", "that", "these", "those", "it", "its", "i", "me", "my",
    "we", "our", "you", "your", "he", "she", "they", "what", "which", "who", "whom", "how", "when", "where", "why",
    "if", "then", "than", "also", "just", "very", "too", "more", "each", "every", "all", "any", "some", "no", "only",
]

# Words ignored when a question is reduced to keywords.
NOISE_WORDS = [
    "a", "an", "the", "is", "are", "am", "was", "were", "be", "being", "been", "what", "who", "when", "where", "why",
    "how", "please", "explain", "define", "of", "for", "to", "in", "on", "at", "with", "about", "from", "by", "this",
    "that", "it",
]

# Phrases that mark a chunk as able to answer a question.
ANSWER_PHRASES = [
    "is", "are", "means", "refers to", "defined as", "consists of", "includes", "known as",
    "called", "used for", "used to", "provides", "enables", "describes", "explains", "represents",
]

# The shorter phrase list of the chunk quality check.
QUALITY_PHRASES = [
    "is", "are", "means", "refers to", "defined as", "consists of", "includes", "known as",
    "used for", "provides", "describes", "explains", "represents",
]

# Words a complete chunk may not end with.
DANGLING_WORDS = ["and", "or", "but", "the", "a", "an", "of", "in", "to", "for", "with", "is"]
QUALITY_DANGLING_WORDS = ["and", "or", "but", "the", "a", "an", "of", "in", "to", "for", "with"]


def head(text: Column, chars: int | None) -> Column:
    """The first characters of a text; all of it without a number."""
    return text if chars is None else F.substring(text, 1, chars)


def bind(value: Column, use) -> Column:
    """Evaluate ``value`` once and hand it to ``use``.

    Spark substitutes a column into every lambda that names it, which would
    compute it again per element; the one-element array keeps it bound.
    """
    return F.element_at(F.transform(F.array(value), use), 1)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def words(text: Column) -> Column:
    """Whitespace words, without the empty strings a leading space would give."""
    return F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def unicode_words(text: Column) -> Column:
    """Runs of word characters; membership here equals a word-boundary match."""
    return F.filter(F.split(text, f"{NOT_WORD}+"), lambda w: w != "")


def tokenize(text: Column, legacy: bool = False) -> Column:
    """Index terms of a text.

    ``legacy`` deletes every character outside ``[a-z0-9 ]`` including line
    breaks, so the words around a break fuse; the default turns white space
    into a blank first.
    """
    blanks = "" if legacy else " " * len(BREAKS)
    common = F.translate(F.lower(text), BREAKS + DROPPED, blanks)
    rest = F.regexp_replace(common, "[^a-z0-9 ]+", "")
    kept = F.when(F.regexp_like(common, F.lit("[^a-z0-9 ]")), rest).otherwise(common)
    return F.filter(F.split(kept, " "), lambda t: (F.length(t) > 1) & ~t.isin(STOP_WORDS))


def clean_text(text: Column) -> Column:
    """Undo line wrapping and collapse white space."""
    joined = F.regexp_replace(text, f"({WORD})-\n({WORD})", "$1$2")
    single = F.regexp_replace(joined, "(?<!\n)\n(?!\n)", " ")
    blanks = F.regexp_replace(single, "[ \t]+", " ")
    return strip(F.regexp_replace(blanks, "\n{3,}", "\n\n"))


def sentences(text: Column) -> Column:
    """Split after ``.``, ``!`` or ``?`` followed by white space."""
    parts = F.split(text, f"(?<=[.!?]){SPACE}+")
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def sanitize_query(text: Column, cap: int | None = None) -> Column:
    """Trim, cut at ``cap`` characters if given, and drop a word equal to one of the last three kept."""
    kept = F.aggregate(
        words(head(strip(text), cap)),
        F.expr("cast(array() as array<string>)"),
        lambda acc, w: F.when(
            F.exists(F.slice(acc, F.greatest(F.size(acc) - 2, F.lit(1)), 3),
                     lambda s: F.lower(s) == F.lower(w)),
            acc,
        ).otherwise(F.concat(acc, F.array(w))),
    )
    return F.nullif(F.array_join(kept, " "), F.lit(""))


def keywords(text: Column) -> Column:
    """Question keywords, repeats kept."""
    found = F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9+#]{2,})"), F.lit(1))
    return F.filter(found, lambda t: ~t.isin(NOISE_WORDS))


def normalize_query(text: Column, most: int | None = None) -> Column:
    """Lower-cased question followed by its keywords, the first ``most`` of them if given."""
    cleaned = sanitize_query(text)
    lowered = F.lower(cleaned)
    keys = keywords(lowered)
    bag = F.concat(lowered, F.lit(" | keywords: "), F.array_join(keys if most is None else F.slice(keys, 1, most), " "))
    return F.when(F.size(keys) > 0, bag).otherwise(lowered)


def is_valid_query(text: Column) -> Column:
    q = strip(F.coalesce(text, F.lit("")))
    letters = F.length(F.regexp_replace(q, "[^a-zA-Z]", ""))
    return (F.length(q) >= 3) & ~((letters > 0) & (letters <= 2))


def library_query_type(text: Column) -> Column:
    q = F.lower(strip(text))
    explains = q.contains("explain") | q.contains("simplify") | q.contains("describe") | q.contains("rephrase")
    return (
        F.when(q.startswith("what is") | q.startswith("define"), "definition")
        .when(explains, "explanation")
        .otherwise("general")
    )


def keyword_hits(keys: Column, text: Column) -> Column:
    """How many keywords occur in ``text`` as whole words."""
    lowered = F.lower(text)

    def boundary(k: Column) -> Column:
        # '+' and '#' are not word characters: a boundary next to one needs a
        # word character on its other side.
        head = F.when(F.regexp_like(k, F.lit("^[+#]")), F.lit(f"(?<={WORD})")).otherwise(F.lit(f"(?<!{WORD})"))
        tail = F.when(F.regexp_like(k, F.lit("[+#]$")), F.lit(f"(?={WORD})")).otherwise(F.lit(f"(?!{WORD})"))
        return F.regexp_like(lowered, F.concat(head, F.regexp_replace(k, r"\+", r"\\+"), tail))

    def count(bag: Column) -> Column:
        return F.size(F.filter(keys, lambda k: F.when(
            F.regexp_like(k, F.lit("[+#]")), boundary(k)).otherwise(F.array_contains(bag, k))))

    return bind(unicode_words(lowered), count)


def model_tokens(text: Column) -> Column:
    """Context-budget estimate: one and a half tokens a word."""
    return F.floor(word_count(text) * F.lit(1.5)).cast("int")


def ledger_tokens(text: Column) -> Column:
    """Ledger estimate: four characters a token, at least one unless empty."""
    n = F.length(F.coalesce(text, F.lit("")))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n / 4))).cast("int")


def slug(text: Column) -> Column:
    dashed = F.regexp_replace(F.lower(strip(F.coalesce(text, F.lit("")))), "[^a-z0-9]+", "-")
    short = F.substring(F.regexp_replace(dashed, "^-+|-+$", ""), 1, 60)
    return F.when(short == "", "node").otherwise(short)


def node_id(level: Column, ordinal: Column, title: Column) -> Column:
    # Pad to four digits without lpad, which would cut longer counters.
    digits = ordinal.cast("string")
    padded = F.when(F.length(digits) < 4, F.lpad(digits, 4, "0")).otherwise(digits)
    return F.concat_ws("_", level, padded, slug(title))


def contains_any(text: Column, phrases: list[str]) -> Column:
    hit = F.lit(False)
    for phrase in phrases:
        hit = hit | text.contains(phrase)
    return hit


def can_answer(text: Column) -> Column:
    return contains_any(F.lower(text), ANSWER_PHRASES)


def has_complete_idea(text: Column) -> Column:
    return contains_any(F.lower(text), QUALITY_PHRASES)


def last_word(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.element_at(words(text), -1)), "[.,;:!?]+$", "")


def is_valid_chunk(text: Column) -> Column:
    """At least 120 words, a sentence mark, and no dangling last word."""
    return (
        (word_count(text) >= 120)
        & ~F.coalesce(last_word(text), F.lit("")).isin(DANGLING_WORDS)
        & F.regexp_like(text, F.lit("[.!?]"))
    )


def layout_profile(text: Column, page_count: Column) -> dict[str, Column]:
    """Signals and score that decide how a document would be parsed."""
    lines = F.split(text, "\n")
    n_lines = F.size(lines)
    filled = F.size(F.filter(lines, lambda s: strip(s) != ""))
    tables = F.regexp_count(text, F.lit(r"(\|[^\n]*\|)|(\t[^\n]*\t)|(_{3,})|(─{3,})|[┌┐└┘├┤]"))
    average = F.length(text) / F.greatest(filled, F.lit(1))
    empty_share = (n_lines - filled) / F.greatest(n_lines, F.lit(1))
    density = filled / F.greatest(page_count, F.lit(1))
    score = (
        F.when(tables > 3, 40).otherwise(0)
        + F.when(average < 30, 15).otherwise(0)
        + F.when(empty_share > 0.4, 10).otherwise(0)
        + F.when(density > 80, 10).otherwise(0)
    )
    blank = strip(F.coalesce(text, F.lit(""))) == ""
    return {
        "word_count": F.when(blank, 0).otherwise(word_count(text)),
        "table_matches": F.when(blank, 0).otherwise(tables),
        "score": F.when(blank, 0).otherwise(score),
        "parser": F.when(blank, "ocr").when(score >= 40, "docling").otherwise("pymupdf"),
    }


def highlight(text: Column, query: Column, open_tag: str = "<mark>", close_tag: str = "</mark>") -> Column:
    """Mark every occurrence of the query's terms longer than two letters."""
    terms = F.filter(words(F.lower(query)), lambda t: F.length(t) > 2)
    escaped = F.transform(terms, lambda t: F.regexp_replace(t, r"([\\.*+?^${}()|\[\]])", r"\\$1"))
    pattern = F.concat(F.lit("(?i)("), F.array_join(F.array_distinct(escaped), "|"), F.lit(")"))
    return F.when(F.size(terms) == 0, text).otherwise(
        F.regexp_replace(text, pattern, F.lit(f"{open_tag}$1{close_tag}"))
    )
