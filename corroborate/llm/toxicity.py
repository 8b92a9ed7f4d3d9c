"""Toxicity scores of text restored by a noisy channel.

A writer who hides a word from filters sends it through a channel that swaps letters
for look-alikes, sets separators between them and repeats them.  Each suspicious
stretch of text becomes a lattice: a column per character, with the letters that it
may stand for, or nothing where it may be a separator or a repetition.  Viterbi
decoding finds the cheapest path under channel costs and a character trigram model,
and the restored words are scored.  Plain words of letters need no decoding: their
lattice has one path.

The character model counts trigrams over the distinct words of all training texts, and
keeps those of at least ``MIN_GRAM_SHARE``.  The scorer learns with Spark from a sample of
about ``MAX_ROWS`` labelled training rows, chosen by a hash: it counts the distinct texts of either label that hold a restored word or word prefix
(case and white space make no difference), and keeps features whose share of toxic documents departs from the overall
share by a likelihood ratio beyond ``MIN_EVIDENCE``, that are ``MIN_PURITY`` toxic and that at least
``MIN_SHARE`` of toxic documents hold, which bounds the model.  A document's score
is one minus the product of its features' remaining doubts.

Defined results: a null or empty text and a text without features have the score of a
document without toxic features; rows whose label is null or that have several labels
of one kind count once each; with no labels every score is 0; repeated rows each give
a row; an empty table gives an empty one; input columns named like a result are
replaced by it.
"""

from __future__ import annotations

import math
import re
from collections.abc import Collection, Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from . import _common as C

MIN_EVIDENCE, MIN_PURITY, MIN_SHARE, PREFIXES, MAX_ROWS = 11.0, 0.92, 0.0015, (4, 5, 6), 40_000
MIN_GRAM_SHARE = 2e-6

#: Letters that a look-alike may stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "*": "aeiou", "#": "h", "%": "x",
}
SWAP_COST, DROP_COST, KEEP_COST, REPEAT_COST = 1.2, 0.4, 0.0, 0.3
SEPARATORS = set(" .-_*~'`​­")
_PLAIN_ENDS = "".join(sorted(SEPARATORS - set(LOOKALIKES)))

_WORD = re.compile(r"[^\W\d_]+")
_APART = re.compile(r"(?<!\S)(?:[^\W_]|[@$!|+(€*#%])(?:\s(?:[^\W_]|[@$!|+(€*#%])){3,}(?!\S)")  # letters or look-alikes set apart by spaces
_MIXED = re.compile(r"[\w@$!|+(€*#%.\-~'`­​]+")
_THRICE = re.compile(r"([^\W\d_])\1\1")
_RUN = re.compile(r"(\S\s?)\1{8,}")  # repetitions beyond eight tell no readings apart
_BETWEEN = re.compile("[" + re.escape("".join(sorted(SEPARATORS))) + r"\s]")
_PARTED = re.compile("[" + re.escape(_PLAIN_ENDS) + r"\s]")
_MINGLED = re.compile(r"[^\W\d_].*[\W\d_]|[\W\d_].*[^\W\d_]")  # letters and other signs
WORD, EDGE, COMMIT = 512, 128, 256


@dataclass
class CharModel:
    """Character trigrams with back-off to bigrams and letters."""

    counts: dict[str, int]
    total: dict[str, int] = field(default_factory=dict)

    def __post_init__(self):
        self.memo: dict[str, float] = {}
        self.low: dict[str, int] = {}
        for g, n in self.counts.items():
            for at in (0, 1, 2):
                self.total[g[at:2]] = self.total.get(g[at:2], 0) + n
                self.low[g[at:]] = self.low.get(g[at:], 0) + n

    def cost(self, gram: str) -> float:
        got = self.memo.get(gram)
        if got is None:
            p = 1.0 / 400
            for at in (2, 1, 0):
                p = (self.low.get(gram[at:], 0) + 4.0 * p) / (self.total.get(gram[at:2], 0) + 4.0)
            self.memo[gram] = got = -math.log(p)
        return got


@lru_cache(maxsize=4096)
def _options(ch: str, again: bool) -> tuple[tuple[str, float], ...]:
    """What a character may stand for, each with its cost."""
    options: list[tuple[str, float]] = []
    if ch.isalpha():
        options.append((ch, KEEP_COST))
    options += [(c, SWAP_COST) for c in LOOKALIKES.get(ch, "")]
    if ch in SEPARATORS or not (ch.isalnum() or options):
        options.append(("", DROP_COST))
    if again:
        options.append(("", REPEAT_COST))
    return tuple(options or [("", 4 * DROP_COST)])


def _path(back: list[dict[str, tuple[str, str]]], state: str) -> list[str]:
    """The letters read on the way to ``state``."""
    read = []
    for came in reversed(back):
        state, out = came[state]
        read.append(out)
    return read[::-1]


def readings(stretch: str, model: CharModel, ends: Iterable[int], several: bool = False) -> list[str]:
    """The cheapest reading of each of the stretch's beginnings that end at ``ends``; of ``several`` words, if so, which separators set apart.

    Every ``COMMIT`` signs the columns behind the state through which all open paths lead are read off and given up, so
    memory does not follow the stretch's length and the reading is that of the whole lattice."""
    costs: dict[str, float] = {"^^": 0.0}
    back: list[dict[str, tuple[str, str]]] = []  # by column: the state before and the letter read
    previous, ends, found, settled, known = "", set(ends), [], [], model.memo
    for at, ch in enumerate(stretch.lower(), 1):
        options = _options(ch, ch == previous)
        now: dict[str, float] = {}
        came: dict[str, tuple[str, str]] = {}
        apart = several and ch in SEPARATORS
        one = len(options) == 1 and len(costs) == 1 and not apart and options[0][0]
        if one:  # a letter after a settled beginning
            (state, cost), (out, extra) = *costs.items(), options[0]
            step = known.get(state + out)
            into = state[1] + out
            now[into], came[into] = cost + extra + (model.cost(state + out) if step is None else step), (state, out)
        for state, cost in () if one else costs.items():
            for out, extra in (*options, (" ", DROP_COST)) if apart and state != "^^" else options:
                into, gram = (state[1] + out, state + out) if out != " " else ("^^", state + "$")
                if out:
                    step = known.get(gram)
                    value = cost + extra + (model.cost(gram) if step is None else step)
                else:
                    into, value = state, cost + extra
                best = now.get(into)
                if best is None or value < best or (value == best and (state, out) < came[into]):
                    now[into], came[into] = value, (state, out)
        costs, previous = now, ch
        back.append(came)
        if at in ends:
            _, state = min((cost + model.cost(state + "$"), state) for state, cost in costs.items())
            found.append("".join(settled + _path(back, state)))
        if at % COMMIT == 0:
            live = set(costs)
            for k in range(len(back) - 1, 0, -1):
                live = {back[k][state][0] for state in live}
                if len(live) == 1:
                    settled += _path(back[:k], *live)
                    back = back[k:]
                    break
    return found


def restore(stretch: str, model: CharModel) -> str:
    """The cheapest reading of one suspicious stretch."""
    return "".join(readings(stretch, model, [len(stretch.lower())]))


def all_readings(stretch: str, model: CharModel) -> set[str]:
    """Readings of the whole stretch and of what is left when characters at its ends are plain punctuation or digits.

    A word has at most ``EDGE`` look-alikes ahead of its first letter or digit and behind its last, and counts by its first
    ``WORD`` signs if it has more, whatever the stretch's length."""
    stretch = stretch.lower().strip(_PLAIN_ENDS)
    plain = [k for k, ch in enumerate(stretch) if ch.isalnum()]
    last = next((k + 1 for k in range(len(stretch) - 1, -1, -1) if stretch[k].isalpha()), None)
    if not stretch:
        return set()
    begins = {0} | ({k for k in range(max(1, plain[0] - EDGE), plain[0] + 1) if stretch[k] != stretch[k - 1]} if plain else set())
    ends = {len(stretch), *(range(plain[-1] + 1, min(len(stretch), plain[-1] + 1 + EDGE)) if plain else ())} | ({last} if last else set())
    return {r for b in begins for r in readings(stretch[b : b + WORD], model, {min(e - b, WORD) for e in ends})}


def hidden_words(stretch: str, model: CharModel) -> set[str]:
    """Words of a stretch of any length, read as one word and, if separators spell it out or set look-alikes apart, as several."""
    stretch = _RUN.sub(lambda m: 8 * m.group(1), stretch.lower())
    words = all_readings(stretch, model)
    spelt, parts = [[p for p in x.split(stretch) if p] for x in (_BETWEEN, _PARTED)]
    if words and len(spelt) < 4 and (len(parts) < 2 or not any(_MINGLED.search(p) for p in parts)):
        return words
    return words.union(*(r.split() for r in readings(stretch, model, [len(stretch)], several=True)))


class Reader:
    """Features of texts; remembers what it found for each stretch without white space."""

    def __init__(self, model: CharModel, wanted: set[str] | None = None):
        self.model, self.wanted, self.memo = model, wanted, {}

    @classmethod
    def shared(cls, model: CharModel, wanted: Collection[str] | None) -> Reader:
        """The reader that earlier tasks of this worker made for the same broadcast values, with what it remembers."""
        kept = vars(model).setdefault("readers", {})
        if id(wanted) not in kept:
            kept[id(wanted)] = cls(model, None if wanted is None else set(wanted)), wanted
        return kept[id(wanted)][0]

    def of_token(self, token: str) -> tuple[str, ...]:
        if token.isalpha() and not _THRICE.search(token.lower()):
            return self.of_word(token.lower())
        words = set(_WORD.findall(token.lower()))
        if _THRICE.search(token.lower()):
            for w in list(words):
                words |= hidden_words(w, self.model)
        if not token.isalpha():
            for m in _MIXED.findall(token):
                # a word with plain punctuation at its ends is itself its one reading
                if len(m) > 1 and not m.lower().strip(_PLAIN_ENDS).isalpha():
                    words |= hidden_words(m, self.model)
        return self.of_words(words)

    def of_word(self, word: str) -> tuple[str, ...]:
        """A word and its beginnings, those wanted."""
        found = (word, *[word[:n] + "*" for n in PREFIXES if len(word) >= n])
        return found if self.wanted is None else tuple(f for f in found if f in self.wanted)

    def of_words(self, words: set[str]) -> tuple[str, ...]:
        return tuple({f for w in words if w for f in self.of_word(w)})

    def features(self, text: str | None) -> set[str]:
        text, memo = text or "", self.memo
        found: set[str] = set()
        for token in set(text.split()):
            got = memo.get(token)
            if got is None:
                if len(memo) > 400_000:
                    memo.clear()
                memo[token] = got = self.of_token(token)
            if got:
                found.update(got)
        for m in _APART.finditer(text):
            found.update(self.of_words(hidden_words(m.group(), self.model)))
        return found


def _words_of_letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct words of letters of each batch of texts."""
    for batch in C.small_batches(batches):
        words: set[str] = set()
        for text in batch.column(0).to_pylist():
            words.update((text or "").lower().split())
        yield pa.RecordBatch.from_arrays([pa.array([w for w in words if w.isalpha()], pa.string())], ["word"])


def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each trigram occurs in the words of a batch."""
    for batch in batches:
        seen: dict[str, int] = {}
        for w in batch.column(0).to_pylist():
            w = f"^^{w}$"
            for k in range(len(w) - 2):
                seen[w[k : k + 3]] = seen.get(w[k : k + 3], 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["gram", "n"])


def character_model(texts: DataFrame, min_share: float = MIN_GRAM_SHARE) -> CharModel:
    """Trigrams of the distinct words of letters of all ``texts``, of whatever length; how texts lie in files plays no part.

    Trigrams that are fewer than ``min_share`` of all are left to the back-off, so the model has at most 1 / ``min_share``."""
    words = texts.select("text").mapInArrow(_words_of_letters, "word string").distinct()
    grams = C.cut(words.mapInArrow(_trigrams, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")))
    total = grams.agg(F.sum("n")).first()[0] or 0
    return CharModel({r.gram: r.n for r in grams.where(F.col("n") >= min_share * total).orderBy("gram").toLocalIterator()})


def _feature_counts(chars, wanted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader.shared(chars.value, wanted.value)
        for batch in C.small_batches(batches):
            seen: dict[str, int] = {}
            for text in batch.column(0).to_pylist():
                for f in reader.features(text):
                    seen[f] = seen.get(f, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["feature", "n"])

    return run


@dataclass
class ToxicModel:
    chars: CharModel
    doubt: dict[str, float]  # chance that a document with the feature is clean
    base: float


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> ToxicModel:
    """docs: doc_id, text of training rows; labels: doc_id, toxic.  Learns characters from all rows, labels from about ``max_rows``."""
    spark = docs.sparkSession
    marks = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).distinct()
    total = marks.count()
    chosen = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < 1e6 * min(1.0, max_rows / max(1, total)))
    sample = C.cut(docs.join(chosen, "doc_id").select("doc_id", "text", "toxic"))
    chars = character_model(docs)
    same = F.sha2(F.trim(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"\s+", " ")), 256)
    known = C.cut(sample.groupBy("toxic", same.alias("same")).agg(F.min("text").alias("text")).select("text", "toxic"))
    n = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    clean, toxic = n.get(0, 0), n.get(1, 0)
    if not clean or not toxic:
        return ToxicModel(chars, {}, float(bool(toxic)))
    held = spark.sparkContext.broadcast(chars)

    def counts(label: int, wanted: set[str] | None) -> DataFrame:
        rows = known.where(F.col("toxic") == label).select("text")
        return rows.mapInArrow(_feature_counts(held, spark.sparkContext.broadcast(wanted)), "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))

    found = {r.feature: r.n for r in counts(1, None).where(F.col("n") >= max(3.0, MIN_SHARE * toxic)).toLocalIterator()}
    against = {r.feature: r.n for r in counts(0, set(found)).toLocalIterator()}
    share = toxic / (clean + toxic)
    doubt = {}
    for feature, t in found.items():
        c = against.get(feature, 0)
        own = t / (c + t)
        if own > MIN_PURITY and t * math.log(own / share) + (c * math.log((1 - own) / (1 - share)) if c else 0.0) > MIN_EVIDENCE:
            doubt[feature] = (c + 0.3 * (1 - share)) / (c + t + 0.3)
    return ToxicModel(chars, doubt, share / 4)


def score(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """Columns of ``docs`` with score, predicted and evidence (the features found)."""
    made = {"score": "double", "predicted": "int", "evidence": "array<string>"}
    base = docs.select(*C.carried(docs, made))
    schema = base.withColumns({k: F.lit(None).cast(v) for k, v in made.items()}).schema
    arrow = to_arrow_schema(schema)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        reader = Reader.shared(m.chars, m.doubt)
        for batch in C.small_batches(batches):
            out: dict[str, list] = {k: [] for k in made}
            for text in batch.column(batch.schema.get_field_index("text")).to_pylist():
                found = reader.features(text)
                doubts = sorted(m.doubt[f] for f in found)
                value = 1 - (1 - m.base) * math.prod(doubts) if found else m.base
                out["score"].append(value)
                out["predicted"].append(int(value >= 0.5))
                out["evidence"].append(sorted(found))
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) if f.name in out else batch.column(f.name) for f in arrow], schema=arrow)

    return base.mapInArrow(run, schema)


def held_out(doc_id: str | Column) -> Column:
    return F.coalesce(C.crc_mod(doc_id, 5) == 0, F.lit(False))


def query(spark, sf_dir: str) -> DataFrame:
    docs = C.ids(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    model = fit(docs.where(~held_out("doc_id")), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")
