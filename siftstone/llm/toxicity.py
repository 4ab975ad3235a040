"""Toxicity by weak supervision.

1. Voters. Twelve stand without any label: lexicons of abuse in four languages (insults, contempt and
   threats in English), abuse spelled with digits or signs for letters, an insult close to an address, telling someone to be
   silent, threat frames, shouting, and a word said again and again. Others are lexicons of words and of beginnings of words
   (4 and 5 letters), mined from parts of the labelled documents: the documents are dealt to FOLDS folds by a hash of their
   ids, and each pair of folds gives two lexicons, of the terms that its toxic documents have more often than chance allows (a
   binomial test, corrected for the number of terms tested). A mined lexicon does not vote on documents it was mined from.
2. Label model. A generative model with a hidden label: each voter hits toxic and clean documents at two rates. They are found by
   expectation-maximisation from the votes alone, from which voters hit the same documents; given labels do not enter but for the share of
   toxic ones, which is the hidden label's prior, and the start assumes that a hit speaks for toxic. Voters that
   agree beyond what the hidden label explains are correlated; on a document, each voter's evidence is divided by one plus the sum of its
   correlations with the other voters that say something there, so that copies of one voter count once. `LabelModel.accuracy` and `.precision` tell how good each voter is held to be.
3. Classifier. A linear (logistic) model over words, beginnings and the voters, fitted to the posterior labels; its terms are
   those that pass the same test with posterior labels.

Labels are used of rows that are not held out only; at most SAMPLE labelled documents, those with the least hash of doc_id, are used, of rows
with one id the one of least label and text. Their terms stay on the executors; only the votes, the counts of terms that may be
tested, and the numbers of those chosen come to the driver. Scoring reads each document once, without a shuffle. Texts of any length are scored whole.

A null text counts as empty. Null labels are left out. With labels of one kind only, or
none, every score is the share of toxic ones (0 without any). Repeated rows get equal scores; an empty table gives no rows. Extra columns are left out.
"""

from __future__ import annotations

import math
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftstone.llm.common import checkpointed, give_back, held_out, id_and_text, small_batches
from siftstone.llm.quality import labelled_sample

SAMPLE = 8000
THRESHOLD = 0.5
FOLDS = 4
#: Terms with LEAST toxic documents or more, and a share of PURE of toxic ones among all
#: their documents, are tested, at this level for all together.
LEAST, LEVEL, PURE = 3, 0.001, 0.98

#: Abusive words by language and kind. Fixed values.
LEXICONS = {
    "insults": "idiot idiots moron morons stupid loser losers pathetic worthless dumb fool imbecile clown cretin dunce halfwit simpleton".split(),
    "contempt": "scum trash garbage filth vermin disgusting despicable subhuman parasite pig swine revolting loathsome".split(),
    "threats": "kill hang beat burn shoot strangle stab lynch".split(),
    "german": "idiot trottel depp dummkopf blödmann vollidiot arschloch abschaum dreck drecksau schwein miststück penner versager widerlich erbärmlich wertlos ekelhaft ungeziefer untermensch".split(),
    "french": "idiot idiote imbécile crétin connard connasse abruti débile ordure déchet salaud salope minable pathétique dégoûtant vermine raclure bouffon nul pourriture".split(),
    "spanish": "idiota imbécil estúpido estúpida tonto tonta basura escoria inútil patético asqueroso asquerosa payaso perdedor cretino gilipollas cabrón cerdo despreciable alimaña".split(),
}
#: Signs and digits that stand for letters. Fixed values.
LEET = str.maketrans("013457@$!", "oieastasi")

_LETTERS = re.compile(r"[^\W\d_]+")
_SPELLED, _SIGN = re.compile(r"[\w@$!*]+"), re.compile(r"[\d@$!*]")
_ADDRESS = re.compile(r"\b(?:you(?:'re| are| is|r)?|du bist|ihr seid|tu es|t'es|vous êtes|eres|sois)\b")
_SILENCE = re.compile(r"\b(?:shut up|shut your|go to hell|get lost|halt die|halt's maul|verpiss dich|ta gueule|la ferme|cállate|vete al)\b")
_THREAT = re.compile(r"\b(?:i(?:'ll| will| am going to)|we(?:'ll| will)|you (?:should|deserve to)|ich werde dich|je vais te|te voy a)\s+(?:\w+\s+){0,2}(?:kill|hurt|hang|beat|burn|shoot|die|umbringen|töten|tuer|frapper|matar|pegar)\b")
#: Words of which every text has one that the two patterns before find. Fixed values.
_SILENCERS = frozenset("shut hell lost halt verpiss gueule ferme cállate vete".split())
_DEEDS = frozenset("kill hurt hang beat burn shoot die umbringen töten tuer frapper matar pegar".split())
_ABUSE = frozenset(w for words in LEXICONS.values() for w in words) - set(LEXICONS["threats"])
_LONGEST = max(map(len, _ABUSE))
_SETS = tuple(frozenset(words) for words in LEXICONS.values())
FIXED = (*LEXICONS, "spelled", "insult_and_address", "silence", "threat_frame", "shouting", "again")


def words_of(text: str) -> list[str]:
    return _LETTERS.findall(text.lower())


def terms_of(text: str, words: list[str] | None = None) -> set[str]:
    """Distinct words in lower case, and their beginnings of 4 and 5 letters with a hyphen."""
    words = set(words_of(text) if words is None else words)
    return words | {w[:4] + "-" for w in words} | {w[:5] + "-" for w in words if len(w) > 4}


def _spelled(low: str) -> bool:
    """Abuse with signs or digits for letters: id1ot, st*pid."""
    done = 0
    for sign in _SIGN.finditer(low):
        at = sign.start()
        if at < done:
            continue
        # the word around the sign, as far as a word of abuse may reach
        found = next(m for m in _SPELLED.finditer(low, max(done, at - _LONGEST - 2), at + _LONGEST + 2) if m.end() > at)
        done = found.end()
        word = found.group().strip("!*")
        if len(word) > _LONGEST or not _SIGN.search(word):
            continue
        plain = word.translate(LEET)
        if plain in _ABUSE:
            return True
        if "*" in plain and len(plain.replace("*", "")) > 1 and any(len(w) == len(plain) and all(a in (b, "*") for a, b in zip(plain, w, strict=True)) for w in _ABUSE):
            return True
    return False


def fixed_votes(text: str, terms: set[str], words: list[str] | None = None) -> list[bool]:
    """The hits of the voters that stand without labels, in the order of FIXED."""
    low = text.lower()
    words = words_of(text) if words is None else words
    silence = not terms.isdisjoint(_SILENCERS) and bool(_SILENCE.search(low))
    threat = not terms.isdisjoint(_DEEDS) and bool(_THREAT.search(low))
    again = b"\1\1\1" in bytes(map(str.__eq__, words, words[1:]))
    abuse = not terms.isdisjoint(_ABUSE)
    near = abuse and any(not _ABUSE.isdisjoint(_LETTERS.findall(low[m.end() : m.end() + 60])) for m in _ADDRESS.finditer(low))
    return [not terms.isdisjoint(words) for words in _SETS] + [_spelled(low), near, silence, threat, text.count("!") * 50 > len(text) + 200, again]


def log_tail(k: int, n: int, p: float) -> float:
    """Logarithm of the chance of k or more hits in n."""
    i = np.arange(k, n + 1)
    lg = np.array([math.lgamma(x + 1) for x in range(n + 1)])
    return float(np.logaddexp.reduce(lg[n] - lg[i] - lg[n - i] + i * math.log(p) + (n - i) * math.log1p(-p)))


def chosen_terms(counts: list[tuple[str, float, float]], toxic: float, clean: float) -> list[str]:
    """Terms (term, toxic documents, clean ones) that pass the test, in order."""
    tested = [(t, c, d) for t, c, d in counts if c >= LEAST]
    share = (toxic + 1) / (toxic + clean + 2)
    tails: dict[tuple[int, int], float] = {}
    out = []
    for t, c, d in tested:
        if c >= PURE * (c + d):
            k, n = math.floor(c + 1e-6), math.ceil(c + d - 1e-6)
            if (k, n) not in tails:
                tails[k, n] = log_tail(k, n, share)
            if tails[k, n] < math.log(LEVEL / len(tested)):
                out.append(t)
    return sorted(out)


class LabelModel:
    """Hits of many voters, explained by a hidden label; see the module's docstring."""

    def __init__(self, hits: np.ndarray, prior: float, votes: np.ndarray | None = None, abstains: np.ndarray | None = None, rounds: int = 60):
        """hits: documents by voters; votes: where a voter votes at all; prior: the share of toxic documents.

        abstains: voters that say nothing where they do not hit, as lexicons of one language do.
        """
        self.misses = np.ones(hits.shape[1]) if abstains is None else 1.0 - abstains
        hits = hits.astype(np.float64)
        votes = np.ones(hits.shape) if votes is None else votes.astype(np.float64)
        self.prior = float(np.clip(prior, 1e-3, 1 - 1e-3))
        self.rate1, self.rate0 = np.full(hits.shape[1], 0.5), np.full(hits.shape[1], 0.02)
        self._correlate(hits, votes)
        post = self.posterior(hits, votes)
        for _ in range(rounds):
            self.rate1 = np.clip((post @ (hits * votes) + 0.5) / (post @ votes + 2), 1e-4, 1 - 1e-4)
            self.rate0 = np.clip(((1 - post) @ (hits * votes) + 0.05) / ((1 - post) @ votes + 1), 1e-4, 1 - 1e-4)
            post = self.posterior(hits, votes)
        self.fitted = post
        self.accuracy = self.prior * self.rate1 + (1 - self.prior) * (1 - self.rate0)
        self.precision = self.prior * self.rate1 / (self.prior * self.rate1 + (1 - self.prior) * self.rate0)

    def _correlate(self, hits, votes):
        """What two voters agree beyond what one hidden label explains, over the documents that both vote on.

        Were voters independent given the label, correlations would be products a_i a_j of how well each voter follows it, and
        a_i^2 = r_ij r_ik / r_jk for any two others. Copies of i only raise that, so the lower quartile over all others is taken.
        """
        rest = votes * (hits - hits.sum(0) / np.maximum(votes.sum(0), 1))
        both = np.maximum(votes.T @ votes, 1)
        dev = np.sqrt((rest * rest).sum(0) / np.maximum(votes.sum(0), 1))
        r = (rest.T @ rest) / both / np.maximum(np.outer(dev, dev), 1e-9)
        m = len(r)
        follows = np.zeros(m)
        for i in range(m):
            others = [j for j in range(m) if j != i and r[i, j] > 0.02]
            found = [r[i, j] * r[i, k] / r[j, k] for j, k in combinations(others, 2) if r[j, k] > 0.02]
            follows[i] = np.sqrt(np.clip(np.quantile(found, 0.25), 0, 1)) if found else 0.0
        explained = np.outer(follows, follows)
        # the share of agreement that the label leaves open
        self.correlation = np.clip((r - explained) / np.maximum(1 - explained, 1e-3), 0, 1)
        np.fill_diagonal(self.correlation, 1)
        self.discount = self.correlation.sum(1)

    def posterior(self, hits, votes=1.0):
        hits = np.asarray(hits, np.float64)
        says = votes * np.maximum(hits, self.misses)
        evidence = hits * np.log(self.rate1 / self.rate0) + (1 - hits) * np.log((1 - self.rate1) / (1 - self.rate0))
        # the voters that say something on a document share their evidence as far as they are correlated
        logit = math.log(self.prior / (1 - self.prior)) + (says * evidence / np.maximum(says @ self.correlation, 1)).sum(1)
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


class ToxicityModel:
    def __init__(self, voters: dict[str, list[int]] | None = None, terms: list[str] | None = None, weights: np.ndarray | None = None, bias: float = 0.0, prior: float = 0.0, label_model: LabelModel | None = None):
        """voters: the mined voters of each term; terms: those of the classifier; weights: of the terms in their order, then of all voters."""
        self.voters, self.weights, self.bias, self.prior, self.label_model = voters or {}, weights, bias, prior, label_model
        self.number = {t: k for k, t in enumerate(terms or ())}

    def votes(self, text: str, terms: set[str], words: list[str] | None = None) -> np.ndarray:
        out = np.zeros(len(FIXED) + N_MINED, bool)
        out[: len(FIXED)] = fixed_votes(text, terms, words)
        for t in terms & self.voters.keys():
            out[self.voters[t]] = True
        return out

    def score(self, texts: list[str]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.prior)
        out = np.full(len(texts), self.bias)
        n = len(self.number)
        for k, t in enumerate(texts):
            words = words_of(t)
            terms = terms_of(t, words)
            numbers = sorted(self.number[x] for x in terms & self.number.keys())
            out[k] += self.weights[numbers].sum() + self.weights[n:][self.votes(t, terms, words)].sum()
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


_PAIRS = tuple(combinations(range(FOLDS), 2))
#: Mined voters: words and beginnings of each pair of folds; they follow the fixed ones.
N_MINED = 2 * len(_PAIRS)
#: Voters that abstain where they do not hit: the fixed ones, which know some languages and kinds of abuse only, and the beginnings.
ABSTAINS = np.array([k < len(FIXED) or (k - len(FIXED)) % 2 == 1 for k in range(len(FIXED) + N_MINED)])


def linear(rows: np.ndarray, cols: np.ndarray, n_terms: int, votes: np.ndarray, target: np.ndarray, steps: int = 300) -> tuple[np.ndarray, float]:
    """(weights, bias) of a logistic model of `target`, from terms (rows, cols) and votes, by adaptive gradient steps."""
    prior = float(np.clip(target.mean(), 1e-3, 1 - 1e-3))
    w, bias = np.zeros(n_terms + votes.shape[1]), math.log(prior / (1 - prior))
    size, bias_size = np.full(len(w), 1e-8), 1e-8
    v = votes.astype(np.float64)
    for _ in range(steps):
        logit = bias + np.bincount(rows, w[cols], len(target)) + v @ w[n_terms:]
        gap = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - target) / len(target)
        grad = np.r_[np.bincount(cols, gap[rows], n_terms), v.T @ gap] + 1e-6 * w
        size += grad * grad
        bias_size += gap.sum() ** 2
        w -= 0.5 * grad / np.sqrt(size)
        bias -= 0.5 * gap.sum() / np.sqrt(bias_size)
    return w, bias


def _prepared(sample: DataFrame) -> DataFrame:
    """(_id, y, fold, terms, fixed) of a sample (_id, text, y), written once."""

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            words = [words_of(t) for t in texts]
            terms = [terms_of(t, w) for t, w in zip(texts, words, strict=True)]
            fixed = [fixed_votes(t, s, w) for t, s, w in zip(texts, terms, words, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("y"), batch.column("fold"), pa.array([sorted(s) for s in terms], pa.list_(pa.string())), pa.array(fixed, pa.list_(pa.bool_()))], ["_id", "y", "fold", "terms", "fixed"])
            give_back()

    fold = F.pmod(F.xxhash64("_id", F.lit(7)), F.lit(FOLDS)).cast("int")
    rows = sample.select("_id", "text", (F.col("y") > 0).cast("double").alias("y"), fold.alias("fold"))
    return checkpointed(rows.mapInArrow(run, "_id long, y double, fold int, terms array<string>, fixed array<boolean>"))


def train(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Fit a model on the labelled rows of `docs` that are not held out."""
    spark = docs.sparkSession
    small_batches(spark)
    sample = _prepared(labelled_sample(docs, labels, "toxic", SAMPLE))
    rows = sorted(sample.select("_id", "y", "fold", "fixed").collect())
    y, fold = np.array([r["y"] for r in rows]), np.array([r["fold"] for r in rows], np.int64)
    if not len(rows) or y.min() == y.max():
        return ToxicityModel(prior=float(y.mean()) if len(rows) else 0.0)
    each = sample.select("_id", "y", "fold", F.explode("terms").alias("term"))
    by_fold = each.groupBy("term").pivot("fold", list(range(FOLDS))).agg(F.sum("y").alias("c"), F.count(F.lit(1)).alias("n"))
    counts = by_fold.select("term", *[F.coalesce(f"{f}_{x}", F.lit(0)).cast("int").alias(f"{x}{f}") for f in range(FOLDS) for x in "cn"])
    may = counts.filter(sum((F.col(f"c{f}") for f in range(FOLDS)), F.lit(0)) >= LEAST).collect()
    voters: dict[str, list[int]] = {}
    for k, pair in enumerate(_PAIRS):
        toxic = float(y[np.isin(fold, pair)].sum())
        table = [(r["term"], float(sum(r[f"c{f}"] for f in pair)), float(sum(r[f"n{f}"] - r[f"c{f}"] for f in pair))) for r in may]
        for kind in (0, 1):
            for t in chosen_terms([x for x in table if x[0].endswith("-") == bool(kind)], toxic, float(np.isin(fold, pair).sum()) - toxic):
                voters.setdefault(t, []).append(len(FIXED) + 2 * k + kind)
    at = {r["_id"]: k for k, r in enumerate(rows)}

    def found(terms: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Which documents have which of the terms, as positions of both."""
        numbered = spark.createDataFrame(pa.table({"term": pa.array(terms, pa.string()), "k": pa.array(range(len(terms)), pa.int64())}))
        got = each.select("_id", "term").join(numbered, "term").select("_id", "k").toArrow()
        return np.array([at[i] for i in got.column("_id").to_pylist()], np.int64), got.column("k").to_numpy().astype(np.int64)

    names = sorted(voters)
    votes = np.zeros((len(rows), len(FIXED) + N_MINED), bool)
    votes[:, : len(FIXED)] = [r["fixed"] for r in rows]
    for d, k in zip(*found(names), strict=True):
        votes[d, voters[names[k]]] = True
    allowed = np.ones(votes.shape, bool)
    for k, pair in enumerate(_PAIRS):
        allowed[np.isin(fold, pair), len(FIXED) + 2 * k : len(FIXED) + 2 * k + 2] = False
    model = ToxicityModel(voters, label_model=LabelModel(votes, float(y.mean()), allowed, ABSTAINS))
    post = model.label_model.fitted

    posterior = spark.createDataFrame(pa.table({"_id": [r["_id"] for r in rows], "p": post}))
    soft = each.select("_id", "term").join(posterior, "_id").groupBy("term").agg(F.sum("p").alias("c"), F.sum(1 - F.col("p")).alias("d"))
    may = [(r["term"], r["c"], r["d"]) for r in soft.filter(F.col("c") >= LEAST).collect()]
    terms = chosen_terms(may, float(post.sum()), float((1 - post).sum()))
    model.number = {t: k for k, t in enumerate(terms)}
    doc, col = found(terms)
    order = np.lexsort((col, doc))
    model.weights, model.bias = linear(doc[order], col[order], len(terms), votes, post)
    return model


def score_column(model: ToxicityModel, text: str = "text") -> Column:
    """The score of each whole text."""
    model.label_model = None  # not needed for scoring

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        give_back()
        return pa.array(model.score([t or "" for t in column.to_pylist()]), pa.float64())

    return score(F.col(text).cast("string"))


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each document."""
    model = train(docs, labels)
    scored = id_and_text(docs).select("doc_id", held_out().alias("held_out"), score_column(model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
