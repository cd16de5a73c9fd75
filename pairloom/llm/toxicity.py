"""Toxicity by a weighted grammar over clauses.

Words are mapped to classes: insult, target, negation, reporting, modal, harm. Five small transducers read the
classes of a clause side by side (their composition keeps the tuple of their states): the insult and the threat
transducers emit weights, and the target, negation and reported-speech transducers raise or lower what is emitted
while they are in their active state. Clauses give totals, totals give the features of a text, and a logistic
regression turns these into a score.

Target, negation, reporting, modal and harm words are short fixed lists. Insults are learned, as words and as stems
(first four or five letters): an entry must be far likelier in toxic texts, in several of them, and in several
different contexts, so that copies of one text teach nothing. All entries that meet this are kept; those of a sample
are bounded by its words. Learning uses at most SAMPLE labelled ids of each label, taken in the order of a hash of the
id, and at most SAMPLE texts of these; the grammar then reads every text in full, whatever its length.

Null and empty texts have no clauses and get the score of the intercept. Without labels of both kinds nothing can be
learned: all scores are 0. A text with several labels counts as toxic if any says so; null labels are ignored.
Repeated rows get equal scores; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.tables import stage

SAMPLE = 12_000  # labelled rows of each label that learning reads
LEAST_TEXTS = 6
LEAST_CONTEXTS = 5
LEAST_ODDS = 8.0  # how much likelier an entry is in toxic texts
STEMS = (4, 5)

# fixed values: closed-class words in the languages of the corpus
CLASSES = {
    "target": "you your yours u he she they them him her this these that those du dich dir ihr sie er tu te toi vous il elle "
    "ils tú usted ustedes él ella ellos",
    "negation": "not no never none neither nor without isn't aren't don't nicht kein keine nie ohne ne pas jamais sans "
    "nunca sin tampoco",
    "reporting": "said says say saying told tells wrote writes claimed claims quoted quote according called reported sagte "
    "sagt schrieb zitierte dit disait écrit selon dijo dice escribió según",
    "modal": "will shall gonna going must should werde wirst wird vais va voy vas",
    "harm": "kill hurt beat destroy murder attack shoot stab burn hang töten schlagen tuer frapper matar golpear",
}
TARGET, NEGATION, REPORTING, MODAL, HARM, INSULT = 1, 2, 3, 4, 5, 6
CLASS_OF = {
    word: number
    for number, name in enumerate(("target", "negation", "reporting", "modal", "harm"), 1)
    for word in CLASSES[name].split()
}
CLAUSE = re.compile(r"[^.!?;:\n]+")
WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
QUOTES = '"“”„«»'
FEATURES = ("weight", "strongest", "clauses", "aimed", "negated", "reported", "threats")


@dataclass
class Lexicon:
    """Weights of insults by word and by stem."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    known: dict[str, tuple[int, float]] = field(default_factory=dict)

    def classify(self, word: str) -> tuple[int, float]:
        """Class and weight of a word; remembered for the words met last."""
        found = self.known.get(word)
        if found is None:
            weight = max([self.words.get(word, 0.0), *(self.stems.get(word[:n], 0.0) for n in STEMS if len(word) > n)])
            found = (INSULT, weight) if weight else (CLASS_OF.get(word, 0), 0.0)
            if len(self.known) >= 1 << 18:
                self.known.clear()
            self.known[word] = found
        return found


def _held(active: int, seen: bool, span: int) -> int:
    """Next state of a transducer that stays active for ``span`` words after a trigger."""
    return span if seen else max(0, active - 1)


def read_clause(classes: list[tuple[int, float]], quoted: bool) -> tuple[float, int, int, int, int]:
    """Run the composed transducers over a clause: emitted weight, insults, aimed, negated, threats."""
    reported = quoted or any(c == REPORTING for c, _ in classes)
    target = negation = modal = threat = 0
    total, insults, aimed, negated, threats = 0.0, 0, 0, 0, 0
    ahead = [False] * (len(classes) + 1)  # a target follows within three words
    last = len(classes) + 9
    for i in range(len(classes) - 1, -1, -1):
        ahead[i] = last - i <= 3
        if classes[i][0] == TARGET:
            last = i
    for i, (kind, weight) in enumerate(classes):
        if kind == INSULT:
            factor = 1.5 if target or ahead[i] else 1.0
            aimed += bool(target or ahead[i])
            if negation:
                factor *= 0.5
                negated += 1
            total += weight * factor * (0.7 if reported else 1.0)
            insults += 1
        elif kind == HARM and modal and not negation:
            threat = 4
        if threat and (kind == TARGET or ahead[i]):
            threats += 1
            total += 0.7 if reported else 1.0
            threat = 0
        target = _held(target, kind == TARGET, 3)
        negation = _held(negation, kind == NEGATION, 3)
        modal = _held(modal, kind == MODAL, 3)
        threat = max(0, threat - 1)
    return total, insults, aimed, negated, threats


def text_features(text: str, lexicon: Lexicon) -> list[float]:
    totals = [0.0] * len(FEATURES)
    folded = text.lower()
    for clause in CLAUSE.finditer(folded):
        body = clause.group()
        classes = [lexicon.classify(w) for w in WORD.findall(body)]
        if not any(c >= HARM for c, _ in classes):
            continue
        quoted = any(q in body for q in QUOTES)
        weight, insults, aimed, negated, threats = read_clause(classes, quoted)
        totals[0] += weight
        totals[1] = max(totals[1], weight)
        totals[2] += insults > 0 or threats > 0
        totals[3] += aimed
        totals[4] += negated
        totals[5] += insults if quoted or any(c == REPORTING for c, _ in classes) else 0
        totals[6] += threats
    return [math.log1p(x) for x in totals]


def labelled_sample(labels: DataFrame, key: str, label: str, allowed: Column, most: int = SAMPLE) -> DataFrame:
    """At most ``most`` ids of each label among the allowed rows, with their label and the number of rows that each
    stands for."""
    known = labels.where(allowed & F.col(label).isNotNull() & F.col(key).isNotNull())
    known = known.groupBy(F.col(key).alias("key")).agg((F.max(label) > 0).cast("int").alias("label"))
    sizes = {row["label"]: row["count"] for row in known.groupBy("label").count().collect()}
    taken = [
        known.where(F.col("label") == kind)
        .orderBy(F.xxhash64("key"), "key")
        .limit(most)
        .withColumn("stands_for", F.lit(max(1.0, sizes.get(kind, 0) / most)))
        for kind in (0, 1)
    ]
    return taken[0].unionByName(taken[1])


def learn_lexicon(sample: DataFrame, least_texts: int = LEAST_TEXTS, least_contexts: int = LEAST_CONTEXTS) -> Lexicon:
    """Insults from (text, label): words and stems with their log odds. Each is in ``least_texts`` toxic texts or more, so
    there are at most the sample's distinct words a text / ``least_texts``, three times over."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, list[int]] = defaultdict(lambda: [0, 0, 0])
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own: dict[str, int] = {}
                before = ""
                for word in WORD.findall((text or "").lower()):
                    context = 1 << (hash_of(before) % 62)
                    for entry in (f"w{word}", *(f"s{word[:n]}" for n in STEMS if len(word) > n)):
                        own[entry] = own.get(entry, 0) | context
                    before = word
                for entry, contexts in own.items():
                    counts = found[entry]
                    counts[label] += 1
                    counts[2] |= contexts if label else 0
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(found.keys(), pa.string()),
                    *(pa.array([c[i] for c in found.values()], pa.int64()) for i in range(3)),
                ],
                ["entry", "clean", "toxic", "contexts"],
            )

    sizes = {row["label"]: row["count"] for row in sample.groupBy("label").count().collect()}
    if len(sizes) < 2:
        return Lexicon()
    odds = ((F.col("toxic") + 0.5) / (sizes[1] + 1)) / ((F.col("clean") + 0.5) / (sizes[0] + 1))
    rows = (
        sample.select("text", "label")
        .mapInArrow(count, "entry string, clean bigint, toxic bigint, contexts bigint")
        .groupBy("entry")
        .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"), F.bit_or("contexts").alias("contexts"))
        .where((F.col("toxic") >= least_texts) & (F.bit_count("contexts") >= least_contexts) & (odds >= LEAST_ODDS))
        .select("entry", F.log(odds).alias("weight"))
        .collect()
    )
    entries = {row["entry"]: row["weight"] for row in rows}
    return Lexicon(
        {e[1:]: w for e, w in entries.items() if e[0] == "w"}, {e[1:]: w for e, w in entries.items() if e[0] == "s"}
    )


def hash_of(word: str) -> int:
    """The same number for a word in every process."""
    h = 0
    for c in word[-6:]:
        h = (h * 131 + ord(c)) & 0xFFFFFF
    return h >> 3


def fit_weights(rows: np.ndarray, labels: np.ndarray, weights: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weighted logistic regression by Newton steps; the last number is the intercept, which is not shrunk."""
    x = np.hstack([rows, np.ones((len(rows), 1))])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    beta = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (weights * (p - labels)) + penalty * beta
        hessian = (x * (weights * p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        beta -= step
        if np.abs(step).max() < 1e-6:
            break
    return beta


@dataclass
class Model:
    lexicon: Lexicon
    weights: list[float] | None


def learn(
    docs: DataFrame,
    labels: DataFrame,
    allowed: Column,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    most: int = SAMPLE,
) -> Model:
    """Lexicon and regression from the labelled rows that ``allowed`` admits. The sample has at most 2 * ``most``
    texts, so its ids are broadcast and only its features come to the driver. Where an id repeats, its different texts
    count as texts each, equal ones once, and the first by their hashes make the sample."""
    ids = F.broadcast(labelled_sample(labels, key, label, allowed, most))
    own = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(ids, "key")
    own = own.withColumn("same", F.xxhash64("text"))
    texts = own.select("key", "same", "label").distinct()
    first = [
        texts.where(F.col("label") == kind).orderBy(F.xxhash64("key", "same"), "key", "same").limit(most)
        for kind in (0, 1)
    ]
    picked = F.broadcast(first[0].unionByName(first[1]).select("key", "same"))
    sample = own.join(picked, ["key", "same"]).dropDuplicates(["key", "same"])
    sample = stage(sample.select("text", "label", "stands_for"), "toxic-sample")
    lexicon = learn_lexicon(sample)

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [text_features(t, lexicon) for t in batch.column(0).to_pylist()]
            values = pa.array(rows, pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([values, batch.column(1), batch.column(2)], ["x", "label", "stands_for"])

    rows = sample.mapInArrow(described, "x array<double>, label int, stands_for double").collect()
    if len({row["label"] for row in rows}) < 2:
        return Model(lexicon, None)
    x, y, w = (np.array([row[c] for row in rows], float) for c in ("x", "label", "stands_for"))
    return Model(lexicon, fit_weights(x, y, w / w.mean()).tolist())


def score(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, predicted) of every row."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, beta = model.lexicon, model.weights
        for batch in batches:
            scores = [
                1 / (1 + math.exp(-sum(map(float.__mul__, [*text_features(t or "", lexicon), 1.0], beta)))) if beta else 0.0
                for t in batch.column(1).to_pylist()
            ]
            predicted = [int(s >= 0.5) for s in scores]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()), pa.array(predicted, pa.int32())],
                ["key", "score", "predicted"],
            )

    own = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = own.select("key").schema.add("score", "double").add("predicted", "integer")
    return own.mapInArrow(scored, schema).withColumnRenamed("key", key)


def fold(key: str, of: int) -> Column:
    return F.crc32(F.col(key).cast("string").cast("binary")) % of


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every text scored by a model that has seen the labels of four of five folds."""
    model = learn(docs, labels, fold(key, 5) != 0, key, text)
    held_out = F.coalesce(fold(key, 5) == 0, F.lit(False))
    return score(docs, model, key, text).select(key, held_out.alias("held_out"), "score", "predicted")
