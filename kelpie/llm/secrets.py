"""Secret scanning with a random forest that removes false positives, in DataFrame functions and Spark's own ML.

Candidates are runs of 16 and more key characters with a digit among them, values of 8 and more characters of any kind that
are given to a credential's name (in the same word, or the word before), and heads of private-key blocks. Each is described by its length, character
classes and the changes between them, its coverage by the corpus's dictionary (3-letter pieces of the frequent words of
all documents), the path-like marks of the word around it, and its neighbouring words. A forest trained on labelled
findings gives each candidate a score; those under the threshold are false positives.

Labelled findings are a table of candidates with a label (1 secret, 0 not). Where none is at hand, as in the query,
weak_labels() marks the candidates that leave no doubt by what surrounds them or by their form (a value given to a
credential's name, a known prefix; plain numbers, UUIDs, parts of addresses), and the forest is trained without the features
that say so (LABEL_MAKING): it has to tell them by length, transitions, coverage, path marks and neighbours.

Defined results. A null or empty text has no candidate. Repeated rows give repeated findings. Without findings of both
kinds the score is the weak label, and 0.5 where there is none. An empty table gives an empty table. Extra columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Runs of key characters; those with a digit are candidates. Every pattern here goes over a text once: a name is looked for from
#: the begin of its run of word characters only, and what was taken is never given back.
RUN = r"[A-Za-z0-9+/_\-]{16,}+"
#: Names that credentials go by.
NAMES = r"(?i)(?:token|password|passwd|pwd|secret|api_?key|access_?key|auth|bearer|credential|private_?key)"
KNOWN = r"^(-----BEGIN|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk_live_[A-Za-z0-9]{16,}|xox[bap]-[A-Za-z0-9-]{10,}|eyJ[A-Za-z0-9_-]{10,})"
UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
#: A run of word characters with such a name in it, and a sign after it.
NAMED = rf"""(?<![\w\-])(?:(?!{NAMES})[\w\-])*+{NAMES}[\w\-]*+["'`]?+\s*+[:=]"""
#: A value of 8 and more characters after a credential's name in the same word; a word that ends with such a name and a sign.
VALUE = rf"""{NAMED}\s*+["'`]?+([^\s"'`]{{8,}}+)"""
NAME_ENDS = rf"""{NAMED}\s*+["'`]?+$"""
PEM = r"^-----BEGIN$"
NEIGHBOURS = 3
#: Bounds of what is held as constants: the dictionary's words, and the findings a forest is trained on.
DICTIONARY_WORDS = 3000
TRAINING_FINDINGS = 20_000
TREES, DEPTH, SEED = 30, 6, 7
THRESHOLD = 0.5


def dictionary(docs: DataFrame, text_col: str = "text", n: int = DICTIONARY_WORDS) -> list[str]:
    """The 3-letter pieces of the n most frequent words (4 letters and more, lower case) of all texts."""
    words = docs.select(F.explode(F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(r"\p{L}{4,}"), F.lit(0))).alias("w"))
    top = words.groupBy("w").count().orderBy(F.desc("count"), "w").limit(n)
    pieces = top.select(F.explode(_pieces(F.col("w"))).alias("p")).distinct()
    return sorted(r["p"] for r in pieces.collect())


def _pieces(w: Column) -> Column:
    """The pieces of w of three letters a-z."""
    return F.regexp_extract_all(w, F.lit("(?=([a-z]{3}))"), F.lit(1))


def _runs(text: Column) -> Column:
    """The runs of key characters that have a digit."""
    return F.filter(F.regexp_extract_all(text, F.lit(RUN), F.lit(0)), lambda x: F.rlike(x, F.lit("[0-9]")))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, word_no, nth (in the word), candidate, word, before, after."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    may = (F.size(_runs(F.col("text"))) > 0) | F.contains("text", F.lit("-----BEGIN")) | F.rlike("text", F.lit(NAMED))
    some = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).filter(may)
    words = some.select("doc_id", F.regexp_extract_all("text", F.lit(common.WORD), F.lit(0)).alias("ws"))
    none = F.array().cast("array<string>")

    def found_in(w, i):
        """The candidates of a word."""
        last, two = F.get("ws", i - 1), F.concat_ws("", F.get("ws", i - 2), F.get("ws", i - 1))
        runs = F.when(F.length(w) >= 16, _runs(w)).otherwise(none)
        inside = F.when(F.contains(w, F.lit("=")) | F.contains(w, F.lit(":")), F.filter(F.array(F.regexp_extract(w, VALUE, 1)), lambda x: x != "")).otherwise(none)
        signed = F.coalesce(F.rlike(last, F.lit(r"""[:=]["'`]?$""")), F.lit(False))
        bare = F.regexp_replace(F.regexp_replace(w, F.lit(r"""^["'`]++"""), F.lit("")), F.lit(r"""(?<!["'`,;])["'`,;]++$"""), F.lit(""))
        given = F.when(signed & (F.length(bare) >= 8) & F.coalesce(F.rlike(two, F.lit(NAME_ENDS)), F.lit(False)), F.array(bare)).otherwise(none)
        key = F.when(F.rlike(w, F.lit(PEM)), F.array(F.array_join(F.slice("ws", i + 1, F.lit(4)), " "))).otherwise(none)
        key = F.filter(key, lambda x: F.contains(x, F.lit("PRIVATE KEY-----")))
        # A run within a given value is the same finding.
        values = F.concat(inside, given)
        alone = F.filter(runs, lambda x: ~F.exists(values, lambda v: F.contains(v, x)))
        return F.array_distinct(F.concat(values, key, alone))

    def described(w, i):
        low = F.greatest(i - NEIGHBOURS, F.lit(0))
        return F.struct(
            i.alias("word_no"), w.alias("word"), F.array_join(F.slice("ws", low + 1, i - low), " ").alias("before"), F.array_join(F.slice("ws", i + 2, F.lit(2)), " ").alias("after"), found_in(w, i).alias("found")
        )

    found = words.select("doc_id", F.explode(F.filter(F.transform("ws", described), lambda x: F.size(x["found"]) > 0)).alias("c"))
    return found.select("doc_id", "c.word_no", F.posexplode("c.found").alias("nth", "candidate"), "c.word", "c.before", "c.after")


FEATURES = [
    "f_length", "f_transitions", "f_digits", "f_upper", "f_distinct", "f_hex", "f_coverage", "f_slashes", "f_dots", "f_address",
    "f_name_before", "f_assigned", "f_quoted", "f_words_before", "f_numbers_near", "f_known",
]
#: What weak labels are made of; a forest that learns from them doesn't see it.
LABEL_MAKING = ["f_name_before", "f_assigned", "f_address", "f_known"]


def described(found: DataFrame, pieces: list[str]) -> DataFrame:
    """found with the columns FEATURES."""
    c, w, before, after = F.col("candidate"), F.col("word"), F.col("before"), F.col("after")
    n = F.length(c)
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[a-z]", "l"), "[A-Z]", "u"), "[0-9]", "d")
    own = _pieces(F.lower(c))
    known = F.array(*map(F.lit, pieces)) if pieces else F.array().cast("array<string>")
    lead = F.concat_ws(" ", before, F.expr("left(word, greatest(locate(candidate, word) - 1, 0))"))
    share = lambda x: x.cast("double") / n
    flag = lambda x: F.when(x, 1.0).otherwise(0.0)
    return found.withColumns({
        "f_length": n.cast("double"),
        "f_transitions": share(F.length(F.regexp_replace(classes, r"(.)\1*", "$1")) - 1),
        "f_digits": share(F.regexp_count(c, F.lit("[0-9]"))),
        "f_upper": share(F.regexp_count(c, F.lit("[A-Z]"))),
        "f_distinct": share(F.size(F.array_distinct(F.split(c, "")))),
        "f_hex": flag(F.rlike(c, F.lit("^([0-9a-f]+|[0-9A-F]+)$")) & F.rlike(c, F.lit("[a-fA-F]"))),
        "f_coverage": F.coalesce(F.try_divide(F.size(F.array_intersect(own, known)).cast("double"), F.size(F.array_distinct(own))), F.lit(0.0)),
        "f_slashes": F.regexp_count(w, F.lit("/")).cast("double"),
        "f_dots": F.regexp_count(w, F.lit(r"\.")).cast("double"),
        "f_address": flag(F.rlike(w, F.lit(r"://|@|^www\."))),
        "f_name_before": flag(F.rlike(lead, F.lit(NAMES))),
        "f_assigned": flag(F.rlike(lead, F.lit(r"[=:]\s*[\"'`]?\s*$"))),
        "f_quoted": flag(F.rlike(w, F.lit("[\"'`]"))),
        "f_words_before": F.regexp_count(before, F.lit(r"(^| )\p{L}+[.,]?(?= |$)")).cast("double"),
        "f_numbers_near": F.regexp_count(F.concat_ws(" ", before, after), F.lit("[0-9]+")).cast("double"),
        "f_known": flag(F.rlike(c, F.lit(KNOWN))),
    })


def weak_labels(found: DataFrame) -> Column:
    """1 or 0 for findings that leave no doubt, else null."""
    plain = F.rlike("candidate", F.lit(r"^[0-9+/_\-]+$")) | F.rlike("candidate", F.lit(UUID)) | (F.col("f_address") == 1)
    named = (F.col("f_name_before") == 1) & (F.col("f_assigned") == 1)
    return F.when((F.col("f_known") == 1) | (named & ~plain), 1).when(plain & ~named, 0)


def train(findings: DataFrame, label: str = "label", features: list[str] | None = None):
    """A fitted forest from findings with features (FEATURES unless given) and label; None without findings of both kinds. At most
    TRAINING_FINDINGS of each label are taken, the first by a hash of the finding."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    features = features or FEATURES
    known = findings.filter(F.col(label).isNotNull())
    counts = {r[label]: r["count"] for r in known.groupBy(label).count().collect()}
    if len(counts) < 2:
        return None
    order = [F.xxhash64("candidate", "doc_id", "word_no"), F.col("candidate"), F.col("doc_id"), F.col("word_no"), F.col("nth")]
    parts = [known.filter(F.col(label) == k).orderBy(*order).limit(TRAINING_FINDINGS) for k in sorted(counts)]
    rows = common.written(parts[0].unionByName(parts[1]).select(*features, F.col(label).cast("double").alias("label")), "secret-training")
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), forest]).fit(rows)


def scan(docs: DataFrame, labelled: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every candidate with score and is_secret. labelled: candidates (as from described()) with a column label."""
    from pyspark.ml.functions import vector_to_array

    found = described(candidates(docs, id_col, text_col), dictionary(docs, text_col))
    found = common.written(found.withColumn("weak", weak_labels(found)), "secret-candidates")
    model = train(found, "weak", [f for f in FEATURES if f not in LABEL_MAKING]) if labelled is None else train(labelled)
    out = ["doc_id", "word_no", "nth", "candidate", "before", "score"]
    if model is None:
        scored = found.withColumn("score", F.coalesce(F.col("weak").cast("double"), F.lit(0.5)))
    else:
        scored = model.transform(found).withColumn("score", vector_to_array("probability")[1])
    return scored.select(*out, (F.col("score") >= THRESHOLD).alias("is_secret"))


def op10_forest_secrets(spark, sf_dir: str) -> DataFrame:
    return scan(common.documents(spark, sf_dir))
