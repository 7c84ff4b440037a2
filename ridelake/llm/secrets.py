"""Secret scan: random forest over candidate strings, with native functions throughout.

A candidate is a run of at least 16 key characters. Its length, its character
transitions, how much of it dictionary pieces cover, the path it stands in and the
words around it are the features; a forest trained on labelled findings tells
secrets from the false positives that patterns alone would report.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridelake.llm.common import remainder

CANDIDATE = r"[A-Za-z0-9+/_\-]{16,}"
#: Common words and pieces of words of four languages.
DICTIONARY = (
    "tion|ment|ing|heit|keit|lich|schaft|ción|able|ness|ous|the|and|that|with|you|for|are|was|this|from|une|des|les|que|pour|"
    "der|die|und|das|ein|ich|sch|ung|los|las|con|por|para|en|er|es|re|on|an|or|in|ou|test|user|name|file|data|value|example"
)
SECRET_WORDS = "key|token|secret|passw|pwd|auth|bearer|credential|api|private"
HARMLESS_WORDS = "commit|sha|hash|checksum|md5|digest|uuid|example|dummy|sample|test|version|http|www|id"
HARMLESS_PATHS = "test|example|sample|mock|doc|fixture"
#: Labelled findings the forest is trained on, at most, and the forest.
TRAIN_ROWS = 20_000
TREES, DEPTH, SEED = 20, 6, 42
THRESHOLD = 0.5
FOLDS, HELD = 3, 1


def _share(text: Column, pattern: str) -> Column:
    """Share of the characters that the pattern's matches cover."""
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))) / F.greatest(F.length(text), F.lit(1))


def candidates(docs: DataFrame, path: str = "source") -> DataFrame:
    """Candidate strings of every whole text: doc_id, path, at (place of the word), value, word, before (two words) and after."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(path).cast("string"), F.lit("")).alias("path"), text.alias("text"))
    words = docs.filter(F.col("text").rlike(CANDIDATE)).withColumn("words", F.split("text", r"\s+", -1)).drop("text")
    places = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.get("words", i).rlike(CANDIDATE))
    blank = lambda i: F.coalesce(F.get("words", i), F.lit(""))
    # A candidate leaves its text with its neighbours alone, not with all the words.
    near = lambda i: F.struct(
        i.alias("at"), blank(i).alias("word"), F.concat_ws(" ", blank(i - 2), blank(i - 1)).alias("before"), blank(i + 1).alias("after")
    )
    found = words.select("doc_id", "path", F.inline(F.transform(places, near)))
    return found.select("*", F.explode(F.regexp_extract_all("word", F.lit(f"({CANDIDATE})"), F.lit(1))).alias("value"))


def features(found: DataFrame) -> tuple[DataFrame, list[str]]:
    v, low = F.col("value"), F.lower("before")
    signs = {
        "length": F.length(v).cast("double"),
        "digits": _share(v, "[0-9]"),
        "capitals": _share(v, "[A-Z]"),
        "symbols": _share(v, r"[+/_\-]"),
        "hex": v.rlike("^[0-9a-fA-F]+$").cast("double"),
        "distinct": F.size(F.array_distinct(F.split(v, ""))) / F.length(v),
        # Character transitions: vowel and consonant, digit and letter, runs of consonants and digits.
        "vowel_consonant": _share(v, "(?i)[aeiou][b-df-hj-np-tv-z]"),
        "consonant_runs": _share(v, "(?i)[b-df-hj-np-tv-z]{3,}"),
        "digit_letter": _share(v, "[0-9][A-Za-z]"),
        "letter_digit": _share(v, "[A-Za-z][0-9]"),
        "digit_runs": _share(v, "[0-9]{4,}"),
        "case_changes": _share(v, "[a-z][A-Z]"),
        "repeats": _share(v, r"(.)\1+"),
        "dictionary": _share(F.lower(v), DICTIONARY),
        "harmless_path": F.lower("path").rlike(HARMLESS_PATHS).cast("double"),
        "path_depth": (F.length("path") - F.length(F.replace(F.col("path"), F.lit("/"), F.lit("")))).cast("double"),
        "secret_before": low.rlike(SECRET_WORDS).cast("double"),
        "harmless_before": low.rlike(HARMLESS_WORDS).cast("double"),
        "assigned": (F.col("before").rlike("[=:]>?\\s*$") | F.col("word").rlike("^[\\w.\\-]+[=:]")).cast("double"),
        "quoted": F.col("word").rlike("[\"'`]").cast("double"),
        "secret_in_word": F.lower(F.replace(F.col("word"), v, F.lit(""))).rlike(SECRET_WORDS).cast("double"),
        "after_symbol": F.col("after").rlike(r"^[^\w\s]").cast("double"),
    }
    names = [f"f_{n}" for n in signs]
    return found.withColumns({f"f_{n}": F.coalesce(c.cast("double"), F.lit(0.0)) for n, c in signs.items()}), names


def weak_labels(found: DataFrame) -> DataFrame:
    """Labelled findings where none are given: strings assigned under a secret's name are 1, plain words and numbers are 0, the rest has none."""
    v, context = F.col("value"), F.lower(F.concat_ws(" ", "before", "word"))
    secret = context.rlike(f"({SECRET_WORDS})[\\w\\-]*[\"']?\\s*[=:]") & v.rlike("[0-9]") & v.rlike("[A-Za-z]")
    harmless = ~v.rlike("[0-9]") | ~v.rlike("[A-Za-z]") | context.rlike(f"\\b({HARMLESS_WORDS})\\s*[=:]")
    return found.withColumn("label", F.when(secret, 1.0).when(harmless, 0.0))


def train(findings: DataFrame, rows: int = TRAIN_ROWS):
    """The forest, from findings with a ``label`` of 0 or 1; None if they are not of both kinds.

    At most ``rows`` of them are used, the smallest by hash of the finding.
    """
    known, names = features(findings.filter("label in (0, 1)"))
    order = F.xxhash64("value", "before", "word", "after", "path")
    known = known.select(F.col("label").cast("double").alias("label"), *names, order.alias("order"))
    known = known.orderBy("order", "label", *names).limit(rows).coalesce(1)
    if known.select("label").distinct().count() < 2:
        return None
    forest = RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=TREES, maxDepth=DEPTH, seed=SEED)
    return Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="features"), forest]).fit(known.drop("order"))


def classify(found: DataFrame, model) -> DataFrame:
    """``found`` with score, the forest's probability of a secret, and predicted; without a model the score is 0.5."""
    if model is None:
        return found.withColumns({"score": F.lit(0.5), "predicted": F.lit(0)})
    scored, names = features(found)
    scored = model.transform(scored).withColumn("score", vector_to_array("probability")[1])
    scored = scored.withColumn("predicted", (F.col("score") > THRESHOLD).cast("int"))
    return scored.select(*found.columns, "score", "predicted")


def scan(docs: DataFrame, findings: DataFrame | None = None, path: str = "source") -> DataFrame:
    """Every candidate of every whole text with its score: doc_id, at, value_sha256, n_chars, held_out, score, predicted.

    ``findings`` are labelled candidates; without them weak labels outside the
    held-out third of the documents take their place. Null and empty texts have no
    candidates; repeated rows repeat theirs.
    """
    found = candidates(docs, path)
    held = remainder(F.col("doc_id"), FOLDS) == HELD
    model = train(findings if findings is not None else weak_labels(found.filter(~held)))
    return classify(found, model).select(
        "doc_id", "at", F.sha2("value", 256).alias("value_sha256"), F.length("value").cast("long").alias("n_chars"), held.alias("held_out"), "score", "predicted"
    )
