"""Keyword-stuffed and link-list pages (problem 8).

One pass over the texts gives each document a vector of features: density of links, of tags and of separators, share of the
most repeated words, entropy, share of function words and share of advertising words.  Per
language a robust centre and scatter (medians, median absolute deviations, correlations of winsorised scores; two
aggregations) turn the vectors into Mahalanobis distances.  Flagged are outliers that lie in a spam-directed direction: the
direction from labelled good to labelled spam documents, fitted on at most ``MAX_LABELS`` judged documents, or a fixed prior
where fewer than ``MIN_LABELS`` of either kind are judged.  An exact count follows: more than half of the words must stand in
promotional lines of the message or of added lines (lock files, change logs, translations and test data never count).

Languages of fewer than ``MIN_DOCS`` documents share one pooled model, so any number of languages is served.

Null, empty and wordless texts are no spam; null or odd languages belong to the pooled model; conflicting labels of one
document are outvoted, ties and ``unsure`` are ignored; documents named twice are reported once; no texts are cut.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.sources.scratch import materialize

FEATURES = ("links", "tags", "bars", "top_words", "entropy", "function_words", "ad_words")
#: Sign of each feature for spam, used where labels are too few.
PRIOR = (1.0, 1.0, 0.5, 1.0, -0.5, -1.0, 2.0)
MAX_LABELS = 20_000
MIN_LABELS = 15
MIN_DOCS = 200
#: Cut of the squared distance: the 97.5 % point of the chi-squared distribution with 7 degrees of freedom.
CUTOFF = 16.01
MIN_COSINE = 0.1
#: Least scale of a feature as a share of its mean deviation; matters where the median deviation is 0.
MEAN_SHARE = 0.5
SHARE = 0.5
#: Advertising words that a promotional line has at least.
LINE_ADS = 0.05

# Function words of the languages at hand.
FUNCTION_WORDS = frozenset(
    "the a an of to in on at by for from with without and or but not no is are was were be been has have had it its this that these those which who what when while before after until because as than then only so if into over under up out we they you he she may can could will would must should how still any all both each "
    "der die das den dem des ein eine einen einem und oder aber nicht kein ist sind war waren wird werden wurde hat haben hatte es sie er wir ihr ich zu zum zur im in am an auf aus bei mit nach von vor weil wenn als auch nur noch schon dass "
    "le la les un une des du de et ou mais ne pas est sont était être a ont il elle nous vous ils je ce cette ces que qui dans sur sous par pour avec sans plus se sa son ses au aux après avant "
    "el los las una unos y o pero es son fue ser ha han lo ella nosotros que quien en sobre por para con sin se su sus al del después antes ya no "
    "o os as um uma e ou mas não é são foi ser tem há ele ela nós que quem em no na nos nas sobre por para com sem se seu sua ao do da dos das depois antes já".split()
)
# Words of advertising in the languages at hand.
AD_WORDS = frozenset(
    "buy cheap cheapest free sale sales offer offers best discount discounts online price prices shop store top deal deals now near me original official fast bargain coupon promo bonus win order "
    "billig billige günstig günstige kaufen angebot angebote rabatt preis preise jetzt bester beste gratis kostenlos "
    "acheter cher prix promotion réduction remise solde soldes gratuit gratuite meilleur meilleure boutique offre offres maintenant ligne "
    "comprar barato barata precio precios gratis oferta ofertas descuento descuentos mejor tienda ahora rebajas "
    "preço preços grátis desconto descontos melhor loja agora promoção compre".split()
)
_WORD = re.compile(r"[^\W_]+")
_URL = re.compile(r"(?:https?://|www\.)[^\s\"'<>)\]]+")
_TAG = re.compile(r"(?<![\w&/#])#[^\W_][\w-]*")
_MARKUP = re.compile(r"</?[a-zA-Z][^>]*>")
_SPACED = re.compile(r"\b[^\W\d_](?:[.*_·-][^\W\d_]){3,}\b")
_CAMEL = re.compile(r"(?<=[a-zß-öø-ÿ])(?=[A-ZÀ-Þ])|(?<=\d)(?=[A-Za-z])")
_HEADER = re.compile(r"(?:commit [0-9a-f]{7,}|Author:|Date:|From:|From [0-9a-f]{7,}|Merge:|changeset:|user:|date:|description:\s*$|parent:|branch:|tag:|diff --git |diff -r |index [0-9a-f]+\.\.|new file mode|deleted file mode|old mode|new mode|similarity index|rename (?:from|to) |copy (?:from|to) |Binary files |GIT binary patch|--- |\+\+\+ |@@ |---\s*$|-- $|\d+\.\d+\.\d+\s*$|(?:Signed-off|Reviewed|Acked|Tested|Reported)-by:|Co-authored-by:)", re.I)
_HEADER_STARTS = frozenset("cCaAdDfFmMuUpPbBtTiInNoOsSrRgG-+@0123456789")
_SUBJECT = re.compile(r"Subject:\s*(?:\[[^\]]*\]\s*)?")
_PATH = re.compile(r"diff --git a/\S+ b/(\S+)|\+\+\+ (?:b/)?(\S+)|diff -r \S+(?: -r \S+)? (\S+)")
_EXEMPT = re.compile(r"(?:^|/)(?:package-lock\.json|yarn\.lock|[^/]*\.lock|go\.sum|[^/]*lock\.ya?ml|change ?logs?[^/]*|changes[^/]*|history[^/]*|releases?\.[^/]*)$|\.(?:po|pot|mo|xliff?|arb|strings)$|(?:^|/)(?:locales?|i18n|translations?|tests?|testdata|fixtures|spec)/|_(?:cases|tests?|fixtures?)\.[a-z]+$", re.I)


def _body(text: str) -> list[tuple[str, bool]]:
    """(line without marks, may be promotional) of the message and of the hunks, without headers, paths and hunk marks."""
    out, in_diff, exempt = [], False, False
    for raw in text.splitlines():
        if raw[:1] in _HEADER_STARTS and _HEADER.match(raw):
            if raw.startswith(("diff ", "+++ ")):
                in_diff = True
                if m := _PATH.match(raw):
                    path = m[1] or m[2] or m[3]
                    if path != "/dev/null":
                        exempt = bool(_EXEMPT.search(path))
            elif in_diff and raw.startswith("-- "):
                in_diff = False
            continue
        if m := _SUBJECT.match(raw):
            out.append((raw[m.end() :], True))
        elif in_diff:
            if raw[:1] in "+- ":
                out.append((raw[1:], raw[:1] == "+" and not exempt))
            elif raw:
                out.append((raw, False))
        elif raw.strip():
            out.append((raw, True))
    return out


def _plain(line: str) -> str:
    """Spelled-out words (b.u.y) are joined."""
    return _SPACED.sub(lambda m: re.sub(r"[\W_]", "", m[0]), line) if _SPACED.search(line) else line


def read_page(text: str) -> tuple[list[float], float, int]:
    """Features, share of words in promotional lines, number of words."""
    lines = _body(text)
    body = "\n".join(line for line, _ in lines)
    if _SPACED.search(body):
        lines = [(_plain(line), may) for line, may in lines]
        body = "\n".join(line for line, _ in lines)
    words = _WORD.findall(body.lower())
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES), 0.0, 0
    count = Counter(words)
    content = {w: c for w, c in count.items() if c > 1 and w not in FUNCTION_WORDS and len(w) > 1}
    top = sum(sorted(content.values(), reverse=True)[:5]) / n
    entropy = -sum(c * math.log(c / n) for c in count.values()) / n / math.log(n) if n > 1 else 1.0
    tags = _TAG.findall(body) if "#" in body else []
    ads = sum(c for w, c in count.items() if w in AD_WORDS) + sum(_ad_words(t) for t in tags if t[1:].lower() not in AD_WORDS)
    function = sum(c for w, c in count.items() if w in FUNCTION_WORDS)
    promo = 0
    if ads >= LINE_ADS * SHARE * n or len(tags) > 1:  # else promotional lines can't make up the share
        repeated = {w for w, c in content.items() if c >= 3}
        for line, may in lines:
            if may and _promotional(line, repeated):
                promo += len(_WORD.findall(line))
    features = [math.log1p(100 * body.count("://") / n), math.log1p(100 * len(tags) / n), math.log1p(100 * body.count("|") / n), top, entropy, function / n, math.log1p(100 * ads / n)]
    return features, promo / n, n


def _ad_words(tag: str) -> int:
    """Words run together in a tag are told apart by their capitals."""
    return sum(w.lower() in AD_WORDS for part in _WORD.findall(tag) for w in _CAMEL.split(part))


def _promotional(line: str, repeated: set[str]) -> bool:
    ws = _WORD.findall(line.lower())
    n = len(ws)
    if n < 2 and "#" not in line and "://" not in line:
        return False
    tags = _TAG.findall(line) if "#" in line else ()
    ad = sum(w in AD_WORDS for w in ws)
    if tags:
        ad += sum(_ad_words(t) for t in tags if t[1:].lower() not in AD_WORDS)
    if not n or ad < 1 or ad < LINE_ADS * n:
        return False
    if 2 * len(tags) >= len(line.split()):
        return True
    if "://" in line or "www." in line:
        urls = len(_URL.findall(line))
        outside = _WORD.findall(_MARKUP.sub(" ", _URL.sub(" ", line)).lower())
        return len(outside) <= 12 * urls and sum(w in FUNCTION_WORDS and w not in AD_WORDS for w in outside) <= 0.2 * len(outside)
    function = sum(w in FUNCTION_WORDS and w not in AD_WORDS for w in ws)
    if line.count("|") >= 2:
        return function <= 0.2 * n
    return 2 * sum(w in AD_WORDS or w in repeated for w in ws) >= n and function <= 0.3 * n


_SCHEMA = "doc_id BIGINT, lang STRING, " + ", ".join(f"{f} DOUBLE" for f in FEATURES) + ", share DOUBLE, n_words BIGINT"


def page_features(documents: DataFrame) -> DataFrame:
    """(doc_id, lang, features, share, n_words) of documents with words."""
    schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), *((f, pa.float64()) for f in FEATURES), ("share", pa.float64()), ("n_words", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in schema]
            for doc, lang, text in zip(b.column("doc_id").to_pylist(), b.column("lang").to_pylist(), b.column("text"), strict=True):
                features, share, n = read_page(text.as_py())
                if n:
                    for c, x in zip(cols, (doc, (lang or "und").strip().lower() or "und", *features, share, n), strict=True):
                        c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return documents.select("doc_id", "lang", "text").where("doc_id IS NOT NULL AND text IS NOT NULL").mapInArrow(run, _SCHEMA)


def robust_models(features: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Language -> centre, scale, inverse correlation; '' is the pooled model of the rare languages.

    At most (documents / MIN_DOCS) languages have a model of their own, and each is a few numbers.
    """
    k = len(FEATURES)
    sizes = features.groupBy("lang").count().where(F.col("count") >= MIN_DOCS)
    own = [r.lang for r in sizes.collect()]
    group = F.when(F.col("lang").isin(own), F.col("lang")).otherwise("") if own else F.lit("")
    named = features.withColumn("model", group)
    # The pooled model is fitted on all documents.
    both = named.select("model", *FEATURES).where("model <> ''").unionByName(named.select(F.lit("").alias("model"), *FEATURES))
    centre = {r.model: np.array(r[1:], float) for r in both.groupBy("model").agg(*(F.percentile_approx(f, 0.5, 1000).alias(f) for f in FEATURES)).collect()}
    if not centre:
        return {}

    def by_model(table: dict[str, np.ndarray], i: int):
        return F.element_at(F.create_map(*(x for m, v in table.items() for x in (F.lit(m), F.lit(float(v[i]))))), F.col("model"))

    away = both.select("model", *(F.abs(F.col(f) - by_model(centre, i)).alias(f) for i, f in enumerate(FEATURES)))
    spread = away.groupBy("model").agg(*(F.percentile_approx(f, 0.5, 1000).alias(f) for f in FEATURES), *(F.avg(f).alias(f"m_{f}") for f in FEATURES)).collect()
    scale = {r.model: np.array([max(1.4826 * r[1 + i], MEAN_SHARE * 1.2533 * r[1 + k + i], 1e-3) for i in range(k)]) for r in spread}
    z = [F.greatest(F.lit(-2.5), F.least(F.lit(2.5), (F.col(f) - by_model(centre, i)) / by_model(scale, i))).alias(f"z{i}") for i, f in enumerate(FEATURES)]
    products = [F.avg(F.col(f"z{i}") * F.col(f"z{j}")).alias(f"c{i}_{j}") for i in range(k) for j in range(i + 1)]
    models = {}
    for r in both.select("model", *z).groupBy("model").agg(*products).collect():
        c = np.zeros((k, k))
        for i in range(k):
            for j in range(i + 1):
                c[i, j] = c[j, i] = r[f"c{i}_{j}"]
        d = np.sqrt(np.maximum(np.diag(c), 1e-6))
        models[r.model] = (centre[r.model], scale[r.model], np.linalg.inv(0.9 * c / np.outer(d, d) + 0.1 * np.eye(k)))
    return models


def verdicts(labels: DataFrame) -> DataFrame:
    """(doc_id, spam): the majority of the reviewers; ties and unsure are left out."""
    vote = F.when(F.lower(F.trim("label")) == "spam", 1).when(F.lower(F.trim("label")) == "ok", -1).otherwise(0)
    return labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.sum(vote).alias("v")).where("v <> 0").select("doc_id", (F.col("v") > 0).alias("spam"))


def score_pages(features: DataFrame, labels: DataFrame) -> DataFrame:
    """features with ``distance`` (squared, robust) and ``cosine`` to the spam direction in the scaled space."""
    models = robust_models(features)
    if not models:
        return features.withColumn("distance", F.lit(0.0)).withColumn("cosine", F.lit(0.0))
    judged = features.join(verdicts(labels), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELS).collect()

    def scaled(lang: str, x: list[float]) -> np.ndarray:
        centre, scale, _ = models.get(lang, models[""])
        return np.clip((np.array(x) - centre) / scale, -25, 25)

    seen: dict[bool, list[np.ndarray]] = {True: [], False: []}
    for r in judged:
        seen[r.spam].append(scaled(r.lang, [r[f] for f in FEATURES]))
    if min(map(len, seen.values())) >= MIN_LABELS:
        towards = np.median(seen[True], axis=0) - np.median(seen[False], axis=0)
    else:
        towards = np.array(PRIOR)
    towards = towards / max(1e-9, float(np.linalg.norm(towards)))
    shared = features.sparkSession.sparkContext.broadcast((models, towards))
    names = features.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, towards = shared.value
        for b in batches:
            x = np.stack([b.column(f).to_numpy() for f in FEATURES], axis=1) if b.num_rows else np.zeros((0, len(FEATURES)))
            langs = b.column("lang").to_pylist()
            m = [models.get(g, models[""]) for g in langs]
            distance, cosine = np.zeros(len(langs)), np.zeros(len(langs))
            for i, (centre, scale, inverse) in enumerate(m):
                z = np.clip((x[i] - centre) / scale, -25, 25)
                distance[i] = z @ inverse @ z
                cosine[i] = z @ towards / max(1e-9, float(np.linalg.norm(z)))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(distance), pa.array(cosine)], names=[*names, "distance", "cosine"])

    return features.mapInArrow(run, _SCHEMA + ", distance DOUBLE, cosine DOUBLE")


def spam_pages(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """All scored pages with ``outlier`` (far out, towards spam) and ``spam`` (outlier, and mostly promotional words)."""
    scored = score_pages(materialize(page_features(documents), "pages"), labels)
    outlier = (F.col("distance") > CUTOFF) & (F.col("cosine") > MIN_COSINE)
    return scored.withColumn("outlier", outlier).withColumn("spam", outlier & (F.col("share") > SHARE))


def found(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id)."""
    return spam_pages(documents, labels).where("spam").select("doc_id").distinct()
