"""Learner, topic and subject labels as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from quillspark.functions import text as tx

# Experience points per action and level thresholds.
XP = {"upload": 20, "ask": 5, "quiz_complete": 50, "correct_answer": 10, "daily_streak": 30}
LEVEL_STEPS = [100, 300, 700, 1500, 3000]

# Question keywords and the topic each stands for, first match wins.
QUESTION_TOPICS = [
    ("neural network", "Neural Networks"), ("cnn", "Neural Networks"), ("convolutional", "Neural Networks"),
    ("gradient", "Optimization"), ("backpropagation", "Optimization"), ("learning rate", "Optimization"),
    ("overfitting", "Regularization"), ("regularization", "Regularization"), ("dropout", "Regularization"),
    ("supervised", "Learning Types"), ("unsupervised", "Learning Types"), ("reinforcement", "Learning Types"),
    ("classification", "Classification"), ("regression", "Regression"), ("clustering", "Clustering"),
    ("decision tree", "Tree Models"), ("random forest", "Tree Models"), ("activation", "Neural Networks"),
    ("loss function", "Optimization"),
]

# Spellings that map to one subject, and labels too vague to keep.
CANONICAL_SUBJECTS = {
    "ai": "AI", "artificial intelligence": "AI", "artificial-intelligence": "AI", "ml": "Machine Learning",
    "machine learning": "Machine Learning", "python": "Python", "python programming": "Python",
    "computer programming": "Computer Programming",
}
GENERIC_SUBJECTS = ["general", "general studies", "document", "notes", "study material", "miscellaneous"]

# Advice texts; {t} is the topic.
ADVICE = {
    "critical": ("You are struggling with '{t}'",
                 "Your accuracy is very low — fundamental concepts may need review",
                 ["Start with basic definitions of {t}",
                  "Read the relevant sections in your document carefully",
                  "Use the 'Ask AI' feature to get explanations of key concepts",
                  "Create flashcards for the core terms",
                  "Take a focused quiz on just this topic"]),
    "high": ("'{t}' needs significant improvement",
             "You're getting less than half the questions right",
             ["Review the document sections about {t}",
              "Focus on understanding 'why' — not just memorizing facts",
              "Use flashcards to reinforce weak areas",
              "Practice with targeted quiz questions"]),
    "medium": ("'{t}' is below passing level",
               "Close to mastery but still missing key concepts",
               ["Review the questions you got wrong",
                "Focus on the subtopics within {t} that trip you up",
                "Try explaining the concept in your own words using Ask AI"]),
    "low": ("'{t}' could use a bit more practice",
            "You're close to mastery",
            ["Review edge cases and advanced details",
             "Challenge yourself with harder questions"]),
}
TREND_NOTES = {
    "improving": "📈 You're improving — keep up the momentum!",
    "declining": "📉 Your performance is declining — revisit the basics",
    "stable": "→ Your performance is stable — focus on weak sub-areas",
}
DECLINING_STEP = "Go back to fundamentals before attempting harder questions"
RECOMMENDATIONS = {
    ("low", "declining"): "Revise: {t}. Focus on definitions and core concepts; use Mentor for guided review.",
    ("low", "other"): "Revise: {t}. Start with definitions and short explanations before harder questions.",
    ("middle", "improving"): "Revise: {t}. You are improving — drill flashcards and quick recall on key terms.",
    ("middle", "other"): "Revise: {t}. Focus on definitions and concepts; alternate flashcards with short quizzes.",
    ("upper", "improving"): "Revise: {t}. Almost there — add harder practice and link ideas across sections.",
    ("upper", "other"): "Revise: {t}. Tighten weak subtopics and re-read the related sections in your course.",
}


def _fill(template: str, topic: Column) -> Column:
    parts = template.split("{t}")
    pieces = [F.lit(parts[0])]
    for p in parts[1:]:
        pieces += [topic, F.lit(p)]
    return F.concat(*pieces)


def level(xp: Column) -> Column:
    return reduce(lambda acc, step: acc + F.when(xp >= step, 1).otherwise(0), LEVEL_STEPS[:4], F.lit(1))


def xp_to_next(xp: Column) -> Column:
    found = None
    for step in LEVEL_STEPS:
        found = F.when(xp < step, F.lit(step) - xp) if found is None else found.when(xp < step, F.lit(step) - xp)
    return found.otherwise(0)


def xp_gained(action: Column, correct: Column) -> Column:
    return (
        F.when(action == "upload", XP["upload"]).when(action == "ask", XP["ask"])
        .when(action == "quiz_complete", XP["quiz_complete"] + correct * XP["correct_answer"])
        .when(action == "correct_answer", XP["correct_answer"]).when(action == "daily_streak", XP["daily_streak"])
        .otherwise(0)
    )


def _or_default(value: Column, default: str) -> Column:
    return F.coalesce(F.nullif(tx.strip(value), F.lit("")), F.lit(default))


def topic_key(subject: Column, topic: Column) -> Column:
    return F.concat_ws("::", _or_default(subject, "General Studies"), _or_default(topic, "General"))


def split_topic_key(key: Column) -> tuple[Column, Column]:
    raw = tx.strip(F.coalesce(key, F.lit("")))
    at = F.locate("::", raw)
    subject = F.when(at > 0, _or_default(F.substring(raw, F.lit(1), at - 1), "General Studies")).otherwise("General Studies")
    topic = F.when(at > 0, _or_default(F.substring(raw, at + 2, F.length(raw)), "General")).otherwise(
        _or_default(raw, "General"))
    return subject, topic


def topic_of_question(question: Column) -> Column:
    lowered, found = F.lower(question), None
    for word, topic in QUESTION_TOPICS:
        hit = lowered.contains(word)
        found = F.when(hit, topic) if found is None else found.when(hit, topic)
    return found.otherwise("General")


def answered_topic(topic: Column, question: Column) -> Column:
    """The stated topic unless it says nothing."""
    stated = tx.strip(F.coalesce(topic, F.lit("")))
    vague = (stated == "") | F.lower(stated).isin("general", "general topic", "misc")
    return F.when(vague, topic_of_question(question)).otherwise(stated)


def mastery(accuracy: Column) -> Column:
    return F.when(accuracy >= 0.8, "strong").when(accuracy >= 0.6, "moderate").otherwise("weak")


def severity(accuracy: Column) -> Column:
    return F.when(accuracy < 0.3, "critical").when(accuracy < 0.5, "high").when(accuracy < 0.6, "medium").otherwise("low")


def recommendation(topic: Column, accuracy: Column, direction: Column) -> Column:
    t = F.coalesce(F.nullif(topic, F.lit("")), F.lit("this topic"))

    def pick(band: str, trend: str) -> Column:
        return F.when(direction == trend, _fill(RECOMMENDATIONS[band, trend], t)).otherwise(
            _fill(RECOMMENDATIONS[band, "other"], t))

    return F.when(accuracy < 0.3, pick("low", "declining")).when(accuracy < 0.5, pick("middle", "improving")).otherwise(
        pick("upper", "improving"))


def advice(topic: Column, accuracy: Column, direction: Column) -> dict[str, Column]:
    """Issue, reason, severity, steps, trend note and priority."""
    grade = severity(accuracy)

    def by_grade(pick) -> Column:
        out = None
        for name, entry in ADVICE.items():
            value = pick(entry)
            out = F.when(grade == name, value) if out is None else out.when(grade == name, value)
        return out

    steps = by_grade(lambda e: F.array(*[_fill(s, topic) for s in e[2]]))
    return {
        "issue": by_grade(lambda e: _fill(e[0], topic)),
        "reason": by_grade(lambda e: F.lit(e[1])),
        "severity": grade,
        "steps": F.when(direction == "declining", F.concat(F.array(F.lit(DECLINING_STEP)), steps)).otherwise(steps),
        "trend_note": F.when(direction == "improving", TREND_NOTES["improving"])
        .when(direction == "declining", TREND_NOTES["declining"]).otherwise(TREND_NOTES["stable"]),
        "priority": F.when(accuracy < 0.4, "high").when(accuracy < 0.6, "medium").otherwise("low"),
    }


def sessions_needed(accuracy: Column) -> Column:
    return F.when(accuracy < 0.3, 3).when(accuracy < 0.5, 2).otherwise(1)


def sanitize_subject(label: Column) -> Column:
    """A noisy label as a clean subject, ``General`` when nothing is left."""
    s = F.regexp_replace(tx.strip(F.coalesce(label, F.lit(""))), "^\"+|\"+$", "")
    s = F.regexp_replace(F.regexp_replace(s, "^'+|'+$", ""), f"{tx.SPACE}+", " ")
    s = F.regexp_replace(s, r"(?i)\.pdf$|\.xlsx$", "")
    s = F.regexp_replace(s, r"(?i)\bdoc_[a-z0-9]+\b", "")
    s = tx.strip(F.regexp_replace(s, r"[^A-Za-z0-9 &/\-]", ""))

    def decide(c: Column) -> Column:
        lowered = F.lower(c)
        known = F.element_at(F.create_map(*[F.lit(x) for kv in CANONICAL_SUBJECTS.items() for x in kv]), lowered)
        title = F.array_join(F.transform(F.regexp_extract_all(lowered, F.lit("([a-z]+|[^a-z]+)"), F.lit(1)), F.initcap), "")
        return (
            F.when((F.length(c) < 2) | (F.length(c) > 40), "General").when(known.isNotNull(), known)
            .when(lowered.isin(GENERIC_SUBJECTS) | (tx.word_count(c) > 4), "General").otherwise(title)
        )

    return tx.bind(s, decide)
