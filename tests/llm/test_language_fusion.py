"""The fused posterior recomputed in plain Python, and texts in none of the known languages."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from folioscope.llm import language_id
from tests.llm.conftest import frame

SUFFIXES = {"de": ("de", "at"), "en": ("uk", "us", "au"), "es": ("es", "mx"), "fr": ("fr",)}
OTHERS = {
    "italian": "Nel mezzo del cammin di nostra vita mi ritrovai per una selva oscura che la diritta via era smarrita. ",
    "polish": "Litwo, ojczyzno moja, ty jesteś jak zdrowie, ile cię trzeba cenić, ten tylko się dowie, kto cię stracił. ",
    "chinese": "道可道，非常道。名可名，非常名。無名天地之始；有名萬物之母。故常無欲，以觀其妙；常有欲，以觀其徼。",
    "letters": "xqzj wvkp qqtz gxjw zzvq pkwx jqvz hgxq wwzk vjqx kzzp xvqw jjkz qpxv zwqk ",
}


def slots(text):
    b = [c + 32 if 65 <= c <= 90 else c for c in text.encode()]
    b = [c if 97 <= c <= 122 or c >= 128 else 32 for c in b]
    return [(((x << 16 | y << 8 | z) * 2654435761) & 0xFFFFFFFF) >> 16 for x, y, z in zip(b, b[1:], b[2:], strict=False)]


def quantile(values, q):
    """The smallest value that at least the share q of the values do not exceed."""
    values = sorted(values)
    return values[max(0, math.ceil(q * len(values)) - 1)]


def brute(rows):
    """rows: (text, lang, host). (language, posterior, accepted) of each."""
    size, known = 1 << 16, Counter(r[1] for r in rows if r[1])
    langs = sorted(known)
    n, counts = len(langs), {x: Counter() for x in langs}
    for text, lang, _ in rows:
        if lang in counts:
            counts[lang].update(slots(text))
    extra = {x: min(0.05, 0.01 * sum(counts[x].values()) / size) for x in langs}
    total = {x: sum(counts[x].values()) + extra[x] * size for x in langs}
    p = lambda x, s: (counts[x][s] + extra[x]) / total[x]
    text, mean = [], []
    for r in rows:
        s = slots(r[0])
        text.append([sum(math.log(p(x, t)) for t in s) for x in langs])
        mean.append(sum(math.log(sum(p(x, t) for x in langs) / n) for t in s) / max(1, len(s)))
    own = [langs[max(range(n), key=lambda i, t=t: (t[i], -i))] if any(c.isalpha() for c in r[0]) else None for r, t in zip(rows, text, strict=True)]
    by_size = {}
    for r, o, m in zip(rows, own, mean, strict=True):
        if o and slots(r[0]):
            by_size.setdefault(int(math.log2(len(slots(r[0])))), []).append(m)
    least = {k: quantile(v, 0.5) - max(6 * (quantile(v, 0.5) - quantile(v, 0.25)), 0.5) for k, v in by_size.items() if len(v) >= 100 or all(len(x) < 100 for x in by_size.values())}
    told = Counter((o, r[1] if r[1] in langs else None) for o, r in zip(own, rows, strict=True) if o)
    whole = [1 + sum(v for (o, _), v in told.items() if o == x) for x in langs]
    share = [w / sum(whole) for w in whole]
    said = {d: [(told[o, d] + 1) / sum(told[o, e] + 1 for e in langs) for o in langs] for d in langs}
    keys = lambda h: [(h.rpartition(".")[2] if "." in h else "",), (".".join(h.split(".")[-2:]) if "." in h else "",), (h,)]

    def prior(host):
        up, seen = share, ()
        for k in keys(host.lower()):
            seen += k
            got = Counter(o for o, r in zip(own, rows, strict=True) if o and r[2] is not None and sum(map(tuple, keys(r[2].lower())[: len(seen)]), ()) == seen)
            if len(seen) < 3 and seen[-1] == "":
                got += Counter(o for o, r in zip(own, rows, strict=True) if o and r[2] is None)
            up = [(got[x] + 20 * u) / (sum(got.values()) + 20) for x, u in zip(langs, up, strict=True)]
        return up

    out = []
    for r, t, m, o in zip(rows, text, mean, own, strict=True):
        host, k = (r[2] or "").lower(), len(slots(r[0]))
        says = said[r[1]] + [sum(s * x for s, x in zip(share, said[r[1]], strict=True))] if r[1] in langs else [1] * (n + 1)
        label = host.rpartition(".")[2] if "." in host else None
        speaks = next((x for x in langs if label in SUFFIXES.get(x, ())), None)
        suffix = [1 / n if speaks is None else 0.8 if x == speaks else 0.2 / (n - 1) for x in langs] + [1 / n]
        at = int(math.log2(k)) if k else 0
        bound = least[min(least, key=lambda x: (abs(x - at), x))]
        every = [0.1 * x for x in t] + [0.1 * (max(t) - k * (m - bound))]
        priors = [0.99 * x for x in (prior(host) if r[2] is not None else share)] + [0.01]
        logs = [a + math.log(b * c * d) for a, b, c, d in zip(every, says, suffix, priors, strict=True)]
        top = max(logs)
        post = [math.exp(x - top) / sum(math.exp(y - top) for y in logs) for x in logs]
        best = max(range(n), key=lambda i: (logs[i], -i))
        out.append((langs[best], post[best], o is not None and 1 - post[n] >= 0.5))
    return out


def sentences(seed, n=160):
    rng = random.Random(seed)
    words = {
        "de": "der die das und nicht ist ich wir haben gehen heute schule buch tisch hund katze haus lernen morgen abend",
        "en": "the and not this that have going today school book table dog cat house learning morning evening with from",
        "fr": "le la les et ne pas est nous avons aller école livre table chien chat maison matin soir avec dans",
        "es": "el la los y no es nosotros vamos escuela libro mesa perro gato casa mañana tarde con para aprender",
    }
    out = []
    for i in range(n):
        k = rng.choice(list(words))
        text = " ".join(rng.choice(words[k].split()) for _ in range(rng.randint(1, 60)))
        out.append((text, rng.choice([k, k, k, None, "de", "xx"]), rng.choice([f"www.{k}{i % 5}.{k}", "a.example.com", "news.example.com", "localhost", None])))
    return out


def test_fusion_equals_brute_force(spark):
    rows = [*sentences(1), *sentences(1)[:20], ("12 34 56", "en", "a.example.com"), ("ok", "fr", None), (OTHERS["italian"] * 3, "en", "www.en1.en")]
    docs = frame(spark, [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]).repartition(5)
    got = language_id.identify(docs).orderBy("doc_id").collect()
    for g, (language, posterior, accepted) in zip(got, brute(rows), strict=True):
        assert (g.language, g.accepted) == (language, accepted) and g.posterior == pytest.approx(posterior, abs=2e-3), g


@pytest.mark.parametrize("declared", ["en", None])
def test_other_languages_and_letter_junk_are_rejected_and_mixtures_stay(spark, declared):
    rows = sentences(2, 600)
    mixed = " ".join(t for t, k, _ in rows[:40] if k in ("de", "es"))
    more = [*[t * 4 for t in OTHERS.values()], mixed]
    docs = frame(spark, [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]).union(frame(spark, more, [declared] * len(more), ["www.en1.en"] * len(more), 1000))
    got = language_id.identify(docs)
    assert [r.accepted for r in got.where("doc_id >= 1000").orderBy("doc_id").collect()] == [False] * len(OTHERS) + [True]
    assert got.where("doc_id < 1000 and not accepted").count() <= 3


def test_languages_come_from_the_declarations(spark):
    docs = frame(spark, ["ciao bella come stai oggi", "hello there how are you"] * 20, ["it-IT", "EN"] * 20)
    assert {(r.lang, r.language) for r in language_id.identify(docs).collect()} == {("it-IT", "it"), ("EN", "en")}
    none = language_id.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert len(none) == 40 and not any(r.accepted for r in none) and {r.language for r in none} == {None}


def test_names_that_clash_and_repeated_rows(spark):
    docs = frame(spark, [r[0] for r in sentences(3, 50)], ["en"] * 50).selectExpr("*", "1 AS scores", "2 AS said", "3 AS host", "4 AS own", "5 AS prior", "6 AS p")
    got = language_id.identify(docs.union(docs), host="source").collect()
    assert len(got) == 100 and {(r.scores, r.said, r.host, r.own, r.prior, r.p) for r in got} == {(1, 2, 3, 4, 5, 6)} and len({(r.doc_id, r.posterior) for r in got}) == 50


@pytest.mark.parametrize("rare", ["fr", "it"])
def test_a_rare_language_stays_and_junk_goes(spark, rare):
    """Real documents, one language thinned to a thousandth of the rows, or a few of a language of their own."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    if rare == "fr":
        few = docs.where("lang = 'fr'").orderBy("doc_id").limit(10)
    else:
        texts = [OTHERS["italian"] + f"Capitolo {i} del libro che si legge la sera con gli amici di casa nostra, e poi si dorme. " * (1 + i) for i in range(8)]
        few = frame(spark, texts, ["it"] * 8, ["www.libro.it"] * 8, 10**6)
    junk = frame(spark, [OTHERS["letters"] * 4, "".join(random.Random(5).choice("bcdfghjklmnpqrstvwxz ") for _ in range(900))], ["en", "de"], ["www.en1.en"] * 2, 2 * 10**6)
    most = docs.where("lang <> 'fr'")
    got = language_id.identify(most.unionByName(few).unionByName(junk)).select("doc_id", "lang", "language", "accepted").collect()
    own = [r for r in got if r.lang == rare]
    assert len(own) == few.count() and sum(r.accepted and r.language == rare for r in own) >= 0.95 * len(own)
    assert not any(r.accepted for r in got if r.doc_id >= 2 * 10**6)
    assert sum(not r.accepted for r in got if r.doc_id < 10**6) < 0.005 * len(got)
