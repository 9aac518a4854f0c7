"""Language identification in two steps: the family first, then one-versus-one linear SVMs among its languages.

Texts become hashed byte-trigram vectors. A linear classifier (one squared-hinge machine against the rest for
each family) names the family; within it every pair of languages has a linear support vector machine, and
the language with the largest sum of pairwise confidences wins, so each machine only ever separates close relatives.
Families come from ``FAMILIES``; a code that it lacks is a family of its own.

Learning uses a bounded sample: at most about ``PER_LANGUAGE`` texts of a language and ``MOST`` in all, picked by
a hash of doc_id. Every text is then scored whole, in Arrow batches, by weights of fixed size.

Defined results: null text, or text without a letter, is ``und`` with score 0; so is everything where nothing could
be learned (an empty table or no lang). With one learned language every text with a letter gets it. Rows
without lang teach nothing; repeated rows score alike; whole texts are scored, however long. Other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, table
from .features import byte_grams, fold, thin, unit

UNDETERMINED = "und"
DIMS = 4096
PER_LANGUAGE, MOST = 1000, 6000
#: A text of so many bytes whose cosine with the mean text of its predicted language is below ``OUTSIDE`` is in none of the learned languages.
ENOUGH, OUTSIDE = 100, 0.2
#: ISO 639-1 codes by family.
FAMILIES = {
    "germanic": "af da de en fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "indo-aryan": "bn gu hi mr ne pa si ur",
    "iranian": "fa ku ps tg",
    "uralic": "et fi hu",
    "turkic": "az kk ky tk tr tt ug uz",
    "semitic": "am ar he mt",
    "dravidian": "kn ml ta te",
    "sinitic": "yue zh",
    "austronesian": "id jv mg ms su tl",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
_LETTER = regex.compile(r"\p{L}")


def family_of(lang: str) -> str:
    return _FAMILY.get(lang.lower().replace("_", "-").split("-")[0], lang)


def vector(text: str) -> np.ndarray:
    return unit(byte_grams(text.lower().encode("utf-8", "replace"), DIMS))


def svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, steps: int = 150) -> np.ndarray:
    """Weights of a linear SVM with squared hinge loss, by accelerated full-batch descent; y is +1 or -1, the last column of x all ones."""
    share = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32)
    rate = 1.0 / (1.0 + 4 * c)  # rows have length sqrt(2), shares sum to 1
    w = look = np.zeros(x.shape[1], np.float32)
    for k in range(steps):
        slack = np.maximum(0, 1 - y * (x @ look))
        new = look - rate * (look - 2 * c * (x.T @ (share * y * slack)))
        w, look = new, new + (k / (k + 3)) * (new - w)
    return w.astype(np.float32)


def unit_length(x: np.ndarray) -> np.ndarray:
    return x / max(float(np.sqrt(x @ x)), 1e-9)


def _sure(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-4 * np.clip(margin, -10, 10)))


class HierarchicalModel:
    """Family weights and, for each family, the weights of its pairs of languages."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        self.langs = sorted(set(langs))
        families = np.array([family_of(v) for v in langs])
        self.families = sorted(set(families))
        self.members = {f: [v for v in self.langs if family_of(v) == f] for f in self.families}
        self.family_w = np.array([svm(x, np.where(families == f, 1.0, -1.0).astype(np.float32)) for f in self.families]) if len(self.families) > 1 else None
        lang = np.array(langs)
        self.centres = {v: unit_length(x[lang == v, :-1].mean(0)) for v in self.langs}
        self.pair_w = {}
        for f in self.families:
            for a, b in combinations(self.members[f], 2):
                rows = (lang == a) | (lang == b)
                self.pair_w[a, b] = svm(x[rows], np.where(lang[rows] == a, 1.0, -1.0).astype(np.float32))

    def predict(self, v: np.ndarray) -> tuple[str, float, float]:
        """The language, its score, and the cosine with that language's mean text."""
        lang, score = self.decide(np.append(v, np.float32(1)))
        return lang, score, float(self.centres[lang] @ v)

    def decide(self, v: np.ndarray) -> tuple[str, float]:
        family, score = self.families[0], 1.0
        if self.family_w is not None:
            p = _sure(self.family_w @ v)
            family, score = self.families[int(p.argmax())], float(p.max() / p.sum())
        members = self.members[family]
        if len(members) == 1:
            return members[0], score
        votes = dict.fromkeys(members, 0.0)
        for a, b in combinations(members, 2):
            p = float(_sure(self.pair_w[a, b] @ v))
            votes[a] += p
            votes[b] += 1 - p
        best = max(members, key=lambda m: votes[m])
        return best, score * votes[best] / (len(members) - 1)


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, most: int = MOST) -> HierarchicalModel | None:
    """Learns from text and lang of the rows of ``docs`` (doc_id, text, lang) that are not held out."""
    known = docs.select("doc_id", "text", "lang").filter((fold(F.col("doc_id")) != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return None
    bound = max(1, min(per_language, most // len(counts)))
    chance = F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, min(1.0, bound / n))])
    picked = known.filter(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) < F.element_at(chance, F.col("lang")) * (1 << 30))
    # The driver holds the vectors once, with room for the chance in the sample's size, and no more than one text.
    x, langs = np.empty((2 * most + 1024, DIMS + 1), np.float32), []
    for r in picked.select("text", "lang").toLocalIterator():
        if not _LETTER.search(r["text"]):
            continue
        if len(langs) == len(x):
            raise ValueError("the sample is far larger than its bound; there are more languages than it can hold")
        x[len(langs), :DIMS], x[len(langs), DIMS] = vector(r["text"]), 1
        langs.append(r["lang"])
    return HierarchicalModel(x[: len(langs)], langs) if langs else None


def predict(docs: DataFrame, model: HierarchicalModel | None, text: str = "text", into: str = "language") -> DataFrame:
    """``docs`` with a struct column ``into`` (lang_pred, score, likeness), in place of any column of that name."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, likeness double")
    def identify(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = sent.value
        for texts in batches:
            rows = [m.predict(vector(t)) if m is not None and t is not None and _LETTER.search(t) else (UNDETERMINED, 0.0, 0.0) for t in texts]
            yield pd.DataFrame(rows, columns=["lang_pred", "score", "likeness"])

    return docs.withColumn(into, identify(F.col(f"`{text}`")))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs)
    found = predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), "language.lang_pred", "language.score")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text is in some learned language.

    Rejected are texts without a letter, null and empty ones among them, and texts of ``ENOUGH`` bytes or more that are unlike the language
    they would be in. Where no row has a lang nothing is learned, and all texts with a letter stay. Repeated rows are judged alike; other
    columns pass through; an empty table stays empty.
    """
    model, into = fit(docs), fresh(docs, "language")[0]
    if model is None:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    found = predict(docs, model, into=into)
    like = (F.octet_length("text") < ENOUGH) | (F.col(f"{into}.likeness") >= OUTSIDE)
    return found.filter((F.col(f"{into}.lang_pred") != UNDETERMINED) & like).drop(into)
