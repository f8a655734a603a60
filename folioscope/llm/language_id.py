"""Language identification by fusing evidence: the text, a declared language, an address suffix and the host's prior; or none of the known languages."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.shared import SMALL, Scratch, bound_batches, fresh
from folioscope.llm.words import LOWER, chunks

#: Byte trigrams are hashed to so many slots.
SLOTS = 1 << 16
#: Of each trigram's slot so many counts are taken to be there, and so large a share of a language's own counts over all slots at most: a small language isn't washed out.
PSEUDO, OWN_PSEUDO = 0.05, 0.01
#: Rows dealt to so many parts where a host may be frequent and the table of hosts is large.
SALTS = 16
#: A language's own suffix of an address, by language; fixed values.
SUFFIXES = {"de": ("de", "at"), "en": ("uk", "us", "au"), "es": ("es", "mx"), "fr": ("fr",)}


def _trigrams(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the byte trigrams (A-Z lowered) that lie in one row, and where each row's begin. Digits count as spaces."""
    low = LOWER[data].astype(np.uint32)
    low[(low < 97) | ((low > 122) & (low < 128))] = 32
    n = len(low)
    if n < 3:
        return np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    slot = (((low[:-2] << 16 | low[1:-1] << 8 | low[2:]) * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    whole = row[:-2] == row[2:]
    return slot[whole], np.searchsorted(row[:-2][whole], np.arange(len(at)))


def declared_languages(docs: DataFrame, code: Column, least_share: float = 0.0) -> list[str]:
    """The codes that rows declare, in order, or those that a share of ``least_share`` of the rows with a code declare; a grouped count of at most 26 * 26 codes."""
    seen = docs.select(code.alias("code")).where("code is not null").groupBy("code").count().collect()
    total = sum(r[1] for r in seen)
    return sorted(r[0] for r in seen if r[1] >= least_share * total)


def smoothed(counts: np.ndarray) -> np.ndarray:
    """Log probabilities of counts by language (rows) and slot: PSEUDO more in each slot, or OWN_PSEUDO of the language's counts where that is less."""
    own = counts.sum(1, keepdims=True)
    counts = counts + np.where(own > 0, np.minimum(PSEUDO, OWN_PSEUDO * own / counts.shape[1]), PSEUDO)
    return np.log(counts / counts.sum(1, keepdims=True)).astype(np.float32)


def text_model(docs: DataFrame, declared: Column, languages: Sequence[str]) -> np.ndarray:
    """Log probabilities of trigram slots by language, from all rows that declare one of ``languages``."""
    size = len(languages) * SLOTS

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(size, np.int64)
        for batch in batches:
            lang = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for first, data, at in chunks(batch.column(0)):
                slot, begin = _trigrams(data, at)
                of = np.repeat(lang[first : first + len(at) - 1], np.diff(begin))
                sums += np.bincount(of * SLOTS + slot, minlength=size)
        found = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(sums[found])], names=["slot", "n"])

    bound_batches(docs.sparkSession)
    which = F.array_position(F.array(*map(F.lit, languages)), declared) - 1
    rows = docs.where(F.col("text").isNotNull()).select("text", which.cast("int").alias("which")).where("which >= 0")
    got = rows.mapInArrow(counted, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # at most languages * SLOTS
    counts = np.zeros(size)
    counts[got["slot"].to_numpy()] = got["n"].to_numpy()
    return smoothed(counts.reshape(len(languages), SLOTS))


def _normal(values: Column) -> Column:
    """The logarithms of an array, shifted to sum to one as probabilities."""
    top = F.array_max(values)
    total = F.aggregate(values, F.lit(0.0), lambda s, x: s + F.exp(x - top))
    return F.transform(values, lambda x: x - top - F.log(total))


def _usual(scored: DataFrame) -> dict[int, float]:
    """For each size of a text (the power of two of its trigrams) the least mean log likelihood under any language that is usual.

    That is the median less the larger of FAR times the distance to the lower quartile and of MARGIN: a bound that does not move with
    a small share of texts in other languages. A size with under 100 texts has the bound of the nearest size that has more.
    """
    got = scored.where("n > 0").groupBy(F.floor(F.log2("n")).alias("size")).agg(F.count("*"), *[F.percentile_approx("mean", q, 1000) for q in (0.25, 0.5)]).collect()
    least = {r[0]: r[3] - max(FAR * (r[3] - r[2]), MARGIN) for r in got if r[1] >= 100} or {r[0]: r[3] - max(FAR * (r[3] - r[2]), MARGIN) for r in got}
    return {size: least[min(least, key=lambda x: (abs(x - size), x))] for size in range(64)} if least else {}


#: A text is unusual from so many times the distance of median and lower quartile, and from so many nats a trigram, below the median.
FAR, MARGIN = 6.0, 0.5
#: The prior of a text in none of the known languages.
OTHER = 0.01


def identify(docs: DataFrame, languages: Sequence[str] | None = None, declared: str | None = "lang", host: str | None = "source", smoothing: float = 20.0, tempering: float = 0.1, least: float = 0.5, least_share: float = 0.0, outputs: Sequence[str] = ("language", "text_language", "posterior", "accepted")) -> DataFrame:
    """All columns of ``docs`` (which has text), and language, text_language, posterior (double) and accepted (boolean).

    ``languages`` are all those that rows declare, however rare (or from ``least_share`` of them on), or the given ones. The log posterior of a language adds up the evidence of a row:

    * text: ``tempering`` times the log likelihood of the text's byte trigrams under the language's model, which is counted
      over all rows that declare a language (trigrams overlap, hence the tempering);
    * declared markup language: how often rows whose text speaks for this language declare that one (add-one smoothing);
    * address suffix: the last label of the host, where it is a language's own (``SUFFIXES``), counts as 0.8 for these;
    * host: the prior of the languages at the host, smoothed by ``smoothing`` rows of its domain's, which is smoothed so by its
      suffix's, and that by the global one: counts of the text's own language, grouped.

    A class for texts in none of the languages takes part with the prior OTHER. Its log likelihood is that of a text just at the
    bound of the usual ones of its size (``_usual``, from all rows), where all languages together explain each trigram: so a text in two of
    them is usual, and Italian among English and German ones, or a row of random letters, falls below, the surer the longer it is. A declaration
    is as probable in it as in all rows, a suffix says nothing.

    accepted: there is a letter in the text, and the languages together have a posterior of ``least`` at least. Null and empty texts, and
    texts without letters, get the language that the other evidence has, and are rejected. A null or unknown declaration, and a null
    host, are no evidence. Ties go to the first language in order; repeated rows count each and get equal results; an empty table gives no
    rows; a text of any length is one sum over its trigrams. If no row declares a language and none are given, language is null and
    nothing is accepted. ``outputs`` are the names of the results; columns of docs with these names are replaced, others stay whatever their names. Texts are never
    shuffled while the table of hosts is small; beyond that, hosts join in parts, so that a frequent one is split.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "language")
    language_, text_language_, posterior_, accepted_ = mine = list(outputs)
    docs = docs.drop(*mine)
    text_, said_, host_, own_, prior_, p_, salt_, spoken_ = fresh([*docs.columns, *mine], "scores", "said", "host", "own", "prior", "p", "salt", "spoken")
    code = F.lower(F.col(declared) if declared else F.lit(None).cast("string")).substr(1, 2)
    code = F.when(code.rlike("^[a-z]{2}$"), code)
    languages = list(languages) if languages is not None else declared_languages(docs, code, least_share)
    if not languages:
        return docs.select("*", F.lit(None).cast("string").alias(language_), F.lit(None).cast("string").alias(text_language_), F.lit(0.0).alias(posterior_), F.lit(False).alias(accepted_))
    n, said = len(languages), F.when(code.isin(*languages), code)
    model = text_model(docs, said, languages)
    alike = np.full(SLOTS, -np.inf)
    for row in model:
        alike = np.logaddexp(alike, row)
    logs = spark.sparkContext.broadcast((model, alike - np.log(n)))  # languages * SLOTS numbers, and as many as SLOTS

    @F.arrow_udf("array<double>")
    def likelihood(text: pa.Array) -> pa.Array:
        """By language; then the mean log likelihood of a trigram under all languages alike, and the number of trigrams."""
        out, (rows, both) = [], logs.value
        for _, data, at in chunks(text):
            slot, begin = _trigrams(data, at)
            sums = [np.diff(np.concatenate([[0.0], np.cumsum(row[slot], dtype=np.float64)])[begin]) for row in (*rows, both)]
            size = np.diff(begin)
            out.append(np.stack([*sums[:-1], sums[-1] / np.maximum(size, 1), size], 1))
        flat = np.concatenate([*out, np.zeros((0, n + 2))])
        return pa.ListArray.from_arrays(np.arange(len(flat) + 1) * (n + 2), flat.ravel()).cast(pa.list_(pa.float64()))

    names = F.array(*map(F.lit, languages))
    place = F.lower(F.col(host)) if host else F.lit(None).cast("string")
    of = lambda c, i: F.get(F.col(c), F.lit(i))
    by_language = F.slice(text_, 1, n)
    scored = docs.withColumn(text_, likelihood("text")).withColumn(said_, said).withColumn(host_, place)
    scored = scored.withColumn(own_, F.when(F.col("text").rlike("\\p{L}"), F.element_at(names, F.array_position(by_language, F.array_max(by_language)).cast("int"))))
    slim = scratch.keep(scored.where(F.col(own_).isNotNull()).select(F.col(host_).alias("host"), F.col(own_).alias("own"), F.col(said_).alias("said"), of(text_, n).alias("mean"), of(text_, n + 1).alias("n")))
    usual = _usual(slim)
    suffix = F.coalesce(F.when(F.col("host").contains("."), F.substring_index("host", ".", -1)), F.lit(""))
    seen = slim.groupBy("host", "own", "said").agg(F.count("*").alias("rows"))
    seen = scratch.keep(seen.withColumn("domain", F.coalesce(F.regexp_extract("host", "([^.]+\\.[^.]+)$", 1), F.lit(""))).withColumn("suffix", suffix))

    # Global counts and the declarations: languages squared numbers.
    told = {(r[0], r[1]): r[2] for r in seen.groupBy("own", "said").agg(F.sum("rows")).collect()}
    whole = [1.0 + sum(v for (own, _), v in told.items() if own == x) for x in languages]
    share = [x / sum(whole) for x in whole]
    declare = {d: [float(np.log((told.get((own, d), 0) + 1) / (sum(told.get((own, e), 0) + 1 for e in languages)))) for own in languages] for d in languages}
    spoken_all = {d: float(np.log(sum(s * np.exp(x) for s, x in zip(share, declare[d], strict=True)))) for d in languages}

    def level(keys: list[str], above: DataFrame | None, prior: Column) -> DataFrame:
        counts = seen.groupBy(*keys).agg(*[F.sum(F.when(F.col("own") == x, F.col("rows")).otherwise(0)).alias(f"n{i}") for i, x in enumerate(languages)])
        counts = counts.withColumn("up", prior) if above is None else counts.join(above.withColumnRenamed("prior", "up"), keys[:-1])
        total = sum((F.col(f"n{i}") for i in range(n)), F.lit(smoothing))
        return counts.select(*keys, F.array(*[(F.col(f"n{i}") + smoothing * F.col("up")[i]) / total for i in range(n)]).alias("prior"))

    flat = F.array(*map(F.lit, share))
    hosts = level(["suffix", "domain", "host"], level(["suffix", "domain"], level(["suffix"], None, flat), flat), flat)
    hosts = scratch.keep(hosts.where("host is not null").select(F.col("host").alias(host_), F.col("prior").alias(prior_)))
    scratch.drop_all_but(hosts)
    if scratch.size(hosts) < SMALL:
        out = scored.join(F.broadcast(hosts), host_, "left")
    else:
        parts = hosts.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias(salt_))
        out = scored.withColumn(salt_, F.pmod(F.xxhash64("text"), F.lit(SALTS)).cast("int")).join(parts, [host_, salt_], "left").drop(salt_)

    log_flat = F.array(*[F.lit(float(np.log(x))) for x in share])
    label = F.when(F.col(host_).contains("."), F.substring_index(host_, ".", -1))
    told_by = lambda x: F.array(*[F.lit(float(np.log((0.8 if y == x else 0.2 / max(1, n - 1)) if n > 1 else 1.0))) for y in languages])
    own_suffix = F.coalesce(*[F.when(label == s, told_by(x)) for x in languages for s in SUFFIXES.get(x, ())], F.array_repeat(F.lit(float(-np.log(n))), n))
    # One row for each language: languages squared numbers.
    told_rows = spark.createDataFrame([(x, [*declare[x], spoken_all[x]]) for x in languages], f"`{said_}` string, `{spoken_}` array<double>")
    out = out.join(F.broadcast(told_rows), said_, "left")
    spoken = F.coalesce(F.col(spoken_), F.array_repeat(F.lit(0.0), n + 1))
    prior = F.coalesce(F.transform(prior_, lambda x: F.log(x)), log_flat)
    bound = F.get(F.array(*[F.lit(usual.get(i, 0.0)) for i in range(64)]), F.greatest(F.floor(F.log2(F.greatest(of(text_, n + 1), F.lit(1.0)))), F.lit(0)).cast("int"))
    # Above the bound the class of other texts is the less likely by as much as the text is more usual than one at the bound.
    other = tempering * (F.array_max(by_language) - of(text_, n + 1) * (of(text_, n) - bound)) + F.get(spoken, F.lit(n)) - float(np.log(n)) + float(np.log(OTHER))
    known = [tempering * of(text_, i) + F.get(spoken, F.lit(i)) + F.get(own_suffix, F.lit(i)) + F.get(prior, F.lit(i)) + float(np.log(1 - OTHER)) for i in range(n)]
    out = out.withColumn(p_, F.array(*known, other)).withColumn(p_, _normal(F.col(p_)))
    languages_ = F.slice(p_, 1, n)
    best = F.array_max(languages_)
    out = out.withColumn(language_, F.element_at(names, F.array_position(languages_, best).cast("int"))).withColumn(text_language_, F.col(own_)).withColumn(posterior_, F.exp(best))
    out = out.withColumn(accepted_, F.col(own_).isNotNull() & (1 - F.exp(of(p_, n)) >= least))
    return out.select(*docs.columns, *mine)
