"""Secret scanning: token-shaped candidates, and a random forest that removes false positives; DataFrame operations alone."""

from __future__ import annotations

import base64
from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.wordset import WordSet

#: A run of 16 or more token characters with a digit; runs are read once, however long they are.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{16,}+={0,2}"
#: Characters before and after a candidate that count as its neighbours.
AROUND = 40
#: Slots of the filter that holds the dictionary's words.
DICTIONARY_SLOTS = 1 << 18
#: Candidates whose lengths are added up together.
RUN = 256
#: Words that identifiers, paths and placeholders are made of.
WORDS = tuple(
    "access account action admin alpha api app array auth author base bearer beta block branch buffer build bytes cache call change chunk class client code color "
    "column config connect content context count create custom data date default delete demo detail device display doc document dummy element end entry error event example "
    "export factory fake field file filter first fixture format get group handler head header here hidden host html http id image import index info input insert item key last "
    "layer length level lib line link list load local log login main map master max message method min mode model module name network new next node null number object open "
    "option order output package page param parse path placeholder port post private process profile project property public python query random read record remove render "
    "replace report request reset response result root row sample save schema script search second secret section select server service session set setting size source start state static status "
    "string style switch system table tag target temp template test text thread time title token total track tree type update upload url user util value version view web width window word worker write your"
    .split()
)
#: The commonest pairs of letters in English words; fixed values.
PAIRS = "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le".split()
FEATURES = ("length", "digits", "upper", "changes", "hex", "distinct", "pairs", "dictionary", "separators", "path_test", "said_secret", "said_public", "placeholder")


def vocabulary_words(path: str, shortest: int = 4) -> list[str]:
    """Words of a dictionary: the tokens of letters alone, ``shortest`` or more, in a file of base64 tokens and ranks (on the driver, as large as a vocabulary)."""
    with open(path, "rb") as f:
        tokens = (base64.b64decode(line.split()[0]).decode(errors="replace").strip().lower() for line in f if line.strip())
        return sorted({t for t in tokens if len(t) >= shortest and t.isalpha() and t.isascii()})


class Dictionary:
    """The words of code, and perhaps those of a list; both for whole runs of letters of a candidate."""

    def __init__(self, spark: SparkSession, words: Sequence[str] = ()):
        every = sorted({*WORDS, *words})
        self.set = WordSet(spark.createDataFrame([(w,) for w in every], "word string"), "word", DICTIONARY_SLOTS)

    def covered(self, candidate: Column) -> Column:
        """Characters in runs of three or more letters of one case (the first may be a capital) that are words."""
        runs = F.transform(F.regexp_extract_all(candidate, F.lit("[A-Z]?[a-z]{2,}|[A-Z]{3,}(?![a-z])"), F.lit(0)), F.lower)
        return F.aggregate(F.filter(runs, lambda r: (F.length(r) > 2) & self.set.may_have(r)), F.lit(0), lambda s, r: s + F.length(r))


def with_features(findings: DataFrame, dictionary: Dictionary) -> DataFrame:
    """``findings`` (candidate, before, after, path) with the numbers that the forest sees."""
    c, n = F.col("candidate"), F.length("candidate").cast("double")
    low, near = F.lower(c), F.lower(F.concat_ws(" ", "before", "after"))
    count = lambda p, of=c: F.regexp_count(of, F.lit(p)).cast("double")
    changes = "(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Za-z])|(?<=[0-9])(?=[^0-9])|(?<=[+/_=-])(?=[A-Za-z0-9])"
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("double")
    return findings.withColumns({
        "length": n,
        "digits": count("[0-9]") / n,
        "upper": count("[A-Z]") / n,
        "changes": count(changes) / n,
        "hex": flag(low.rlike("^[0-9a-f]+$")),
        "distinct": F.size(F.array_distinct(F.split(c, ""))) / n,
        "pairs": count("(?=" + "|".join(PAIRS) + ")", low) / n,
        "dictionary": dictionary.covered(c) / n,
        "separators": count("[+/_=-]") / n,
        "path_test": flag(F.lower("path").rlike("test|example|sample|fixture|mock|docs?/|readme")),
        "said_secret": flag(near.rlike("secret|token|passw|pwd|api.?key|access.?key|private.?key|credential|auth|bearer")),
        "said_public": flag(near.rlike("sha-?[0-9]|md5|checksum|digest|commit|revision|integrity|uuid|guid|etag|hash|version")),
        "placeholder": flag(low.rlike("(.)\\1{5,}|1234567|abcdef|example|your|placeholder|dummy|sample")),
    })


def labelled_findings(spark: SparkSession, rows: int = 4000, seed: str = "train") -> DataFrame:
    """Labelled findings made by rule: candidate, before, after, path and label (1: a secret), a bounded training sample.

    Half are tokens of usual shapes; the others digests, identifiers, placeholders, names of code, paths and tokens in test files. The words
    before them lean to the label but do not tell it: one secret in four is announced by nothing or by a public word, one of the others in
    four by a secret's word; only digests need their neighbours, as keys in hexadecimal look the same. Everything follows from hashes of
    ``seed`` and the row's number, so two seeds share no token.
    """
    h = lambda salt: F.sha2(F.concat_ws("|", F.lit(seed), F.col("id").cast("string"), F.lit(salt)), 256)
    draw = lambda salt, n: F.pmod(F.xxhash64("id", F.lit(seed + salt)), F.lit(n))
    pick = lambda salt, *of: F.element_at(F.array(*map(F.lit, of)), (draw(salt, len(of)) + 1).cast("int"))
    mixed = F.regexp_replace(F.concat(F.base64(F.unhex(h("b"))), F.base64(F.unhex(h("c")))), "[+/=]", "7")
    size = lambda low, high: (draw("size", high - low + 1) + low).cast("int")
    word = lambda salt: pick(salt, *WORDS)
    uuid = F.regexp_replace(F.substring(h("u"), 1, 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    number = F.pmod(F.xxhash64("id"), F.lit(9000)).cast("string")
    name = F.concat_ws("_", word("1"), word("2"), word("3"), number)
    camel = F.concat(word("4"), F.initcap(word("5")), F.initcap(word("6")), number)
    told, public = pick("t", 'token = "', "secret: ", "api_key=", "password = '", "auth token ", "access key ", "credential "), pick("p", "commit ", "sha256:", "checksum ", "md5 ", "integrity ", "etag ", "uuid ", "version ")
    plain, code = pick("n", "value ", "the ", "id=", "see ", "x = ", ""), pick("c", "src/app.py", "config/prod.env", "deploy.yml", "src0", "notes.txt")
    tests = pick("e", "tests/fixtures/a.py", "docs/example.md", "sample/readme.txt")
    kind = F.pmod(F.col("id"), F.lit(14))
    hexes = F.substring(h("x"), F.lit(1), F.when(draw("hex", 3) == 0, 32).when(draw("hex", 3) == 1, 40).otherwise(64))
    shape = F.when(kind.isin(0, 7), hexes).when(kind == 1, F.substring(mixed, F.lit(1), size(24, 64))).when(kind == 2, F.concat(pick("g", "ghp_", "gho_", "sk_live_", "xoxb-", "glpat-", "npm_"), F.substring(mixed, F.lit(1), size(20, 40))))
    shape = shape.when(kind == 3, F.concat(pick("k", "AKIA", "ASIA"), F.upper(F.substring(mixed, 1, 16)))).when(kind == 4, F.concat(F.lit("eyJ"), F.substring(mixed, F.lit(1), size(30, 80)))).when(kind == 5, F.concat(F.lit("AIza"), F.substring(mixed, 1, 35))).when(kind == 6, F.substring(mixed, F.lit(1), size(16, 30)))
    shape = shape.when(kind == 8, uuid).when(kind == 9, F.when(draw("form", 2) == 0, name).otherwise(camel)).when(kind == 10, F.concat(pick("h", "your_token_here_", "xxxxxxxxxxxxxxxxxx", "example_secret_key_", "placeholder_value_", "AKIAEXAMPLEEXAMPLE"), number))
    shape = shape.when(kind == 11, F.substring(mixed, F.lit(1), size(24, 44))).when(kind == 12, F.concat_ws("/", word("7"), word("8"), F.concat(word("9"), F.lit("-2024-01-"), number))).otherwise(F.concat_ws("-", word("10"), number, word("11"), word("12")))
    lean = draw("lean", 8)
    before = F.when(kind == 0, told).when(kind == 7, F.when(lean < 6, public).otherwise(plain))
    before = before.when(kind <= 6, F.when(lean < 6, told).when(lean == 6, plain).otherwise(public)).otherwise(F.when(lean < 2, told).when(lean < 5, plain).otherwise(public))
    before = F.when(kind == 11, F.when(lean < 6, told).otherwise(plain)).otherwise(before)
    path = F.when(kind == 11, tests).otherwise(F.when(draw("path", 10) == 0, tests).otherwise(code))
    label = (kind <= 6) & ~((kind <= 6) & (draw("path", 10) == 0))
    return spark.range(0, rows, 1, 2).select(shape.alias("candidate"), before.alias("before"), pick("a", '" of', " and", "'", "").alias("after"), path.alias("path"), label.cast("double").alias("label"))


def train(findings: DataFrame, dictionary: Dictionary, trees: int = 20, depth: int = 8) -> PipelineModel:
    """A forest on the features of labelled findings (candidate, before, after, path, label)."""
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(with_features(findings, dictionary))
    forest = RandomForestClassifier(labelCol="label", numTrees=trees, maxDepth=depth, seed=7, featureSubsetStrategy="onethird").fit(rows)
    return PipelineModel([VectorAssembler(inputCols=list(FEATURES), outputCol="features"), forest])


def candidates(docs: DataFrame, path: str = "source") -> DataFrame:
    """doc_id, start (of characters, from 0), candidate, before, after and path for every candidate in whole texts."""
    text = F.col("text")
    rows = docs.where(text.rlike(CANDIDATE)).select(F.col("doc_id").cast("long").alias("doc_id"), (F.col(path) if path in docs.columns else F.lit(None)).cast("string").alias("path"), F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)).alias("hits"), F.split(text, CANDIDATE, -1).alias("gaps"))
    # Where each candidate starts: the lengths of what lies before it, by totals of runs of RUN of them, so a text of many takes no sum of all for each.
    sizes = F.zip_with("gaps", "hits", lambda g, h: F.struct(F.length(g).alias("gap"), (F.length(g) + F.coalesce(F.length(h), F.lit(0))).alias("both")))
    add = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda s, v: s + v)

    def starts(x: Column) -> Column:
        before = lambda i: add(F.slice(x["totals"], F.lit(1), F.floor(i / RUN).cast("int"))) + add(F.transform(F.slice(x["sizes"], (F.floor(i / RUN) * RUN + 1).cast("int"), i % RUN), lambda s: s["both"]))
        return F.transform(F.slice(x["sizes"], F.lit(1), F.size(x["sizes"]) - 1), lambda s, i: before(i) + s["gap"])

    def totals(sizes: Column) -> Column:
        runs = F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / RUN).cast("int"))
        return F.transform(runs, lambda r: add(F.transform(F.slice(sizes, r * RUN + 1, F.lit(RUN)), lambda s: s["both"])))

    once = lambda v, use: F.element_at(F.transform(F.array(v), use), 1)
    start = once(sizes, lambda s: once(F.struct(s.alias("sizes"), totals(s).alias("totals")), starts))
    left, right = F.transform("gaps", lambda g: F.substring(g, -AROUND, AROUND)), F.transform(F.slice("gaps", F.lit(2), F.size("hits")), lambda g: F.substring(g, 1, AROUND))
    each = rows.select("doc_id", "path", F.explode(F.arrays_zip(F.col("hits").alias("hits"), start.alias("start"), F.slice(left, F.lit(1), F.size("hits")).alias("left"), right.alias("right"))).alias("x"))
    return each.select("doc_id", F.col("x.start").alias("start"), F.col("x.hits").alias("candidate"), F.col("x.left").alias("before"), F.col("x.right").alias("after"), "path")


def scan(docs: DataFrame, model: PipelineModel, dictionary: Dictionary, path: str = "source", least: float = 0.5) -> DataFrame:
    """doc_id, start, length, candidate, score (0 to 1) and secret for every candidate of ``docs`` (doc_id, text, perhaps a path column).

    Each is scored from its length, character changes and pairs, dictionary coverage, path and neighbouring words. Rows need no
    others: nothing is shuffled. Null and empty texts have no candidates, and an empty table none; a null path says nothing; further columns
    are ignored, whatever their names; repeated rows repeat, and equal candidates with equal neighbours tie. A very long text, or one of
    very many candidates, takes work about in proportion.
    """
    rows = with_features(candidates(docs, path), dictionary)
    scored = model.transform(rows).withColumn("score", vector_to_array("probability")[1])
    return scored.select("doc_id", "start", F.length("candidate").alias("length"), "candidate", F.round("score", 6).alias("score"), (F.col("score") >= least).alias("secret"))
