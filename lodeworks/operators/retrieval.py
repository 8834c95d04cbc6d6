"""Retrieval over chunks with vectors, and the questions that drive it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What questions of each type contain, in order of precedence.
QUESTION_WORDS = {
    "file_specific": ["file", "in the file", "this file", "which file", "what file"],
    "function_specific": ["function", "method", "def ", "function called", "this function"],
    "class_specific": ["class", "this class", "which class", "class definition"],
    "issue_related": ["issue", "problem", "bug", "error", "vulnerability", "security", "performance"],
    "metrics": ["score", "quality", "metrics", "complexity", "complex", "coverage", "debt"],
    "code_specific": ["code", "implementation", "how does", "what does", "where is"],
}
METRIC_WORDS = ["complex", "quality", "score", "metrics", "coverage"]
FOLLOW_PHRASES = [
    "what about this", "what about that", "what about its", "what about it", "how about this", "how about that", "how about its", "how about it",
    "and this", "and that", "but this", "but that", "also this", "also that",
]
FOLLOW_PRONOUNS = ["it", "here", "there"]
FOLLOW_STARTS = ["and", "but", "however", "additionally", "furthermore"]
FOLLOW_VERBS = ["is", "was", "does", "did", "can", "will", "would", "should"]


def cosine(a: Column, b: Column) -> Column:
    """Of two float arrays, in double precision; null for a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def top_k(chunks: DataFrame, query: list[float], k: int = 5, where: Column | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, similarity): the k chunks nearest to one query vector among those that `where` lets through."""
    if where is not None:
        chunks = chunks.filter(where)
    similarity = F.greatest(F.lit(0.0), cosine(F.col(vector_col), F.array(*(F.lit(float(x)) for x in query))))
    return chunks.select(id_col, similarity.alias("similarity")).orderBy(F.desc("similarity"), id_col).limit(k)


def broadened(narrow: DataFrame, wide: DataFrame, k: int = 5, enough: int = 2, least: float = 0.1, id_col: str = "vec_id") -> DataFrame:
    """Narrow results first; where fewer than `enough`, wide ones fill up; each id once, at most k, similar enough."""
    short = narrow.agg((F.count("*") < enough).alias("short"))
    both = narrow.withColumn("tier", F.lit(0)).unionByName(wide.crossJoin(short).filter("short").drop("short").withColumn("tier", F.lit(1)))
    once = both.groupBy(id_col).agg(F.min("tier").alias("tier"), F.max("similarity").alias("similarity"))
    return once.orderBy("tier", F.desc("similarity"), id_col).limit(k).filter(F.col("similarity") >= least)


def _has(text: Column, words: list[str]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | text.contains(w)
    return found


def question_type(question: Column) -> Column:
    low = F.lower(question)
    scores = {t: sum((low.contains(w).cast("int") for w in words), F.lit(0)) for t, words in QUESTION_WORDS.items()}
    ranked = F.array(*(F.struct(s.alias("score"), F.lit(-k).alias("order"), F.lit(t).alias("type")) for k, (t, s) in enumerate(scores.items())))
    best = F.array_max(ranked)
    metric = (scores["metrics"] > 0) & (scores["code_specific"] > 0) & _has(low, METRIC_WORDS)
    return F.when(metric, "metrics").when(best["score"] > 0, best["type"]).otherwise("general")


def is_follow_up(question: Column) -> Column:
    low = F.regexp_replace(F.lower(question), r"^\s+|\s+$", "")
    words = F.split(low, r"\s+")
    first, second = F.element_at(words, 1), F.get(words, F.lit(1))
    pronoun = F.arrays_overlap(words, F.array(*(F.lit(w) for w in FOLLOW_PRONOUNS)))
    points = first.isin("this", "that") & F.coalesce(second.isin(*FOLLOW_VERBS), F.lit(False))
    return (low != "") & (_has(low, FOLLOW_PHRASES) | pronoun | first.isin(*FOLLOW_STARTS) | points)


def recent_turns(turns: DataFrame, k: int = 3, longest: int = 150) -> DataFrame:
    """The last k turns of each conversation, texts cut."""
    order = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    rows = turns.withColumn("age", F.row_number().over(order)).filter(F.col("age") <= k)
    return rows.select("conv_id", "turn", "role", F.substring("text", 1, longest).alias("text"))


# Words that are no keywords.
STOP_WORDS = ["what", "how", "where", "when", "why", "this", "that", "with", "from"]


def keywords(turns: DataFrame, last: int = 10, k: int = 10, longer_than: int = 3) -> DataFrame:
    """(conv_id, word): the first k words, in code-point order, of each conversation's last turns (five questions and their
    answers) that are long enough, hold a letter or digit and are no stop words. Words are what white space parts."""
    order = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    rows = turns.withColumn("age", F.row_number().over(order)).filter(F.col("age") <= last)
    words = rows.select("conv_id", F.explode(F.split(F.lower("text"), r"\s+")).alias("word")).filter(F.length("word") > longer_than)
    words = words.filter(F.col("word").rlike(r"[\p{L}\p{N}]") & ~F.col("word").isin(STOP_WORDS)).distinct()
    first = Window.partitionBy("conv_id").orderBy("word")
    return words.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= k).select("conv_id", "word")


# How sure answers of each kind are.
TYPE_FACTOR = {"file_specific": 1.0, "function_specific": 1.1, "class_specific": 1.1, "issue_related": 1.0, "metrics": 0.9, "code_specific": 0.8, "general": 0.7}


def answer_confidence(mean_similarity: Column, kind: Column) -> Column:
    factor = F.element_at(F.create_map(*(F.lit(x) for pair in TYPE_FACTOR.items() for x in pair)), kind)
    return F.when(mean_similarity.isNull(), 0.3).otherwise(F.least(F.greatest(mean_similarity * factor, F.lit(0.1)), F.lit(1.0)))


def upsert(store: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The store with rows put in: those of a key that is there already take its place."""
    return store.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows)


def collection_info(chunks: DataFrame, vector_col: str = "embedding", kind_col: str = "label") -> DataFrame:
    """One row: how many chunks, vectors, lengths of vectors and kinds there are."""
    return chunks.agg(
        F.count("*").alias("n_chunks"), F.count(vector_col).alias("n_vectors"), F.min(F.size(vector_col)).alias("least_length"), F.max(F.size(vector_col)).alias("most_length"),
        F.countDistinct(kind_col).alias("n_kinds"),
    )


def related(chunks: DataFrame, focus: DataFrame, k: int, id_col: str, path_col: str, vector: list[float], vector_col: str = "embedding") -> DataFrame:
    """(id, similarity): the k chunks nearest to a vector in files other than those of focus."""
    return top_k(chunks.join(focus.select(path_col).distinct(), path_col, "left_anti"), vector, k, None, id_col, vector_col)
