"""Toxicity scores from a learnt lexicon, Levenshtein automata and context windows.

Fitting, on at most ``fit_rows`` labelled rows (a documented bound; the rows are
the first by a hash of the id; of near copies among them one):

1. terms: words, and word beginnings of ``STEMS`` characters, whose documents are
   labelled toxic far more often than others;
2. harmless words: ordinary words that are one edit away from a term; terms with
   many of them are matched exactly only;
3. weights: every document's findings become a few sums, and a logistic
   regression (pulled towards a stated prior) weighs them.

Scoring covers every text as a whole.  The lexicon is a trie.  A document's word
is a Levenshtein automaton (a pair of bit vectors: positions reached with no
error and with at most one), and the automaton is walked over the trie, so a
misspelled term is found without enumerating misspellings.  A cheap test first
drops words that share neither the beginning nor the end of any term, which a
word within one edit of a term cannot fail.

Context: each finding has a window of ``WINDOW`` words on either side.  Inside
quotation marks, or with a word of reporting or of speaking about words in the
window, it counts as quoted; quoted findings have weights of their own.

Words are cached per worker within a bound, which changes speed only.

Defined results: null and empty texts have no findings and the score of such
texts; rows that repeat an id each get a row; a label that is null is no label;
a null id is never a training row and its score is defined all the same; without
labels of both kinds every score is 0.  Other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.llm.shared import written
from docquarry.llm.substring_dedup import _pieces
from docquarry.llm.words import as_bytes, hash_words, window_hashes

STEMS = (4, 5, 6, 7)
WINDOW = 6
CACHE = 400_000
FUZZY_SHARE = 0.01  # of the toxic rows must hold a term for its misspellings to count
MOST_NEIGHBOURS = 5  # a term with more ordinary words one edit away is matched exactly only
REPORTING = frozenset(
    "said says say saying called calls call quoted quotes quote quoting wrote writes word words term terms insult insults slur slurs phrase defined definition "
    "dit disait mot mots terme insulte sagte sagt wort wörter begriff beleidigung dijo dice palabra palabras término insulto".split()
)
OPENING, CLOSING = "\"'“‘«„‹(", "\"'”’»“›)"
_LEET = str.maketrans("0134578@$!|", "oieastbasil")
_STRIP = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum()) + OPENING + CLOSING + "…–—·•¡¿"
FEATURES = ("exact", "exact_quoted", "misspelled", "misspelled_quoted", "share")
PRIOR = np.array([1.0, 0.35, 0.8, 0.25, 0.3])


@dataclass
class Trie:
    """Terms by their characters; ``word`` and ``stem`` hold a node's weight if a term ends there."""

    next: list[dict[str, int]] = field(default_factory=lambda: [{}])
    word: list[float] = field(default_factory=lambda: [0.0])
    text: list[str] = field(default_factory=lambda: [""])
    stem: list[float] = field(default_factory=lambda: [0.0])

    def add(self, term: str, weight: float, stem: bool) -> None:
        node = 0
        for c in term:
            if c not in self.next[node]:
                self.next[node][c] = len(self.next)
                self.next.append({})
                self.word.append(0.0)
                self.text.append(self.text[node] + c)
                self.stem.append(0.0)
            node = self.next[node][c]
        to = self.stem if stem else self.word
        to[node] = max(to[node], weight)


class Lexicon:
    """Terms [(term, is_stem, weight)] and the matching of words against them."""

    def __init__(self, terms: list[tuple[str, bool, float]], harmless: frozenset[str] = frozenset(), least_fuzzy: int = 5, rigid: frozenset[str] = frozenset()):
        self.harmless = harmless
        self.trie, self.fuzzy, self.least = Trie(), Trie(), least_fuzzy
        self.heads: set[str] = set()
        self.tails: set[str] = set()
        for term, stem, weight in terms:
            self.trie.add(term, weight, stem)
            if not stem and len(term) >= least_fuzzy and term not in rigid:
                self.fuzzy.add(term, weight, False)
                self.heads.add(term[:2])
                self.tails.add(term[-2:])
        self.cache: dict[str, tuple[float, bool] | None] = {}

    def exact(self, word: str) -> float:
        """Weight of the word as a term, or of the longest stem that begins it."""
        node, best = 0, 0.0
        for c in word:
            node = self.trie.next[node].get(c)
            if node is None:
                return best
            best = self.trie.stem[node] or best
        return max(best, self.trie.word[node])

    def misspelled(self, word: str) -> float:
        """Largest weight of a term within one edit."""
        return max((self.fuzzy.word[n] for n in self.within_one_edit(word)), default=0.0)

    def neighbours(self, word: str) -> list[str]:
        return [self.fuzzy.text[n] for n in self.within_one_edit(word)]

    def within_one_edit(self, word: str) -> list[int]:
        """Trie nodes of the terms within one edit: the word's automaton walked over the trie."""
        if len(word) < self.least - 1 or not (word[:2] in self.heads or word[-2:] in self.tails):
            return []
        masks: dict[str, int] = {}
        for i, c in enumerate(word):
            masks[c] = masks.get(c, 0) | 1 << i
        done, trie, found = 1 << len(word), self.fuzzy, []
        open_ = [(0, 1, 3)]  # node, positions without an error, positions with at most one
        while open_:
            node, none, one = open_.pop()
            if one & done and trie.word[node]:
                found.append(node)
            for c, child in trie.next[node].items():
                m = masks.get(c, 0)
                moved = (none & m) << 1
                # one error: as before, or now by an extra letter of the term, another letter, or a letter of the word too many
                with_one = (one & m) << 1 | none | none << 1 | moved | moved << 1
                with_one &= 2 * done - 1
                if with_one:
                    open_.append((child, moved, with_one))
        return found

    def look(self, raw: str) -> tuple[float, bool] | None:
        """(weight, misspelled) of a token as it stands in a text, or None."""
        word = raw.lower().strip(_STRIP)
        if not word:
            return None
        found = self.exact(word)
        if found:
            return found, False
        plain = word if word.isalpha() else "".join(c for c in word.translate(_LEET) if c.isalpha())
        if plain != word and (found := self.exact(plain)):
            return found, True
        found = 0.0 if plain in self.harmless else self.misspelled(plain)
        return (found, True) if found else None

    def near_misses(self, text: str) -> set[str]:
        """Words of the text that are found as misspellings only."""
        words = {w if (w := t.lower().strip(_STRIP)).isalpha() else "".join(c for c in w.translate(_LEET) if c.isalpha()) for t in set(text.split())}
        return {w for w in words if not self.exact(w) and self.misspelled(w)}

    def findings(self, text: str) -> np.ndarray:
        """FEATURES of one text."""
        tokens = text.split()
        new = set(tokens).difference(self.cache)
        if len(self.cache) + len(new) > CACHE:
            self.cache.clear()
            new = set(tokens)
        for t in new:
            self.cache[t] = self.look(t)
        get = self.cache.__getitem__
        hits = [(i, h) for i, h in enumerate(map(get, tokens)) if h]
        sums = np.zeros(4)
        for i, (weight, wrong) in hits:
            sums[2 * wrong + quoted(tokens, i)] += weight
        out = np.empty(len(FEATURES))
        out[:4] = np.log1p(sums)
        out[4] = math.log1p(100 * len(hits) / max(len(tokens), 20))
        return out


def quoted(tokens: list[str], i: int) -> bool:
    """Is the token spoken about rather than used: in quotation marks or next to reporting words?"""
    lo, hi = max(0, i - WINDOW), min(len(tokens), i + WINDOW + 1)
    if any(t.lower().strip(_STRIP) in REPORTING for t in tokens[lo:hi]):
        return True
    begun = next((k for k in range(i, lo - 1, -1) if tokens[k][0] in OPENING or k < i and tokens[k][-1] in CLOSING), None)
    if begun is None or tokens[begun][0] not in OPENING:
        return False
    return any(tokens[k].rstrip(".,;:!?")[-1:] in CLOSING and tokens[k].rstrip(".,;:!?")[-1:] for k in range(i, hi))


def count_terms(texts: list[str], toxic: list[int]) -> dict[str, list[int]]:
    """Documents of each kind that hold each word, or (with a leading ^) begin a word with a stem."""
    out: tuple[Counter, Counter] = (Counter(), Counter())
    for text, y in zip(texts, toxic, strict=True):
        words = {w for t in set(text.split()) if len(w := t.lower().strip(_STRIP)) >= 3}
        out[y].update(words)
        out[y].update({"^" + w[:n] for w in words for n in STEMS if len(w) > n})
    return {t: [out[0][t], out[1][t]] for t in {*out[0], *out[1]}}


def choose_terms(counts: list[tuple[str, int, int]], clean: int, toxic: int) -> list[tuple[str, bool, float]]:
    """Terms with strong evidence; a stem only where it says more than the words and longer stems it covers, and then it stands for them."""
    weight = {t: math.log((b + 0.5) / (toxic + 1)) - math.log((a + 0.5) / (clean + 1)) for t, a, b in counts}
    held = {t: b for t, _, b in counts}
    sure = {t: weight[t] - 2 * math.sqrt(1 / (b + 0.5) + 1 / (a + 0.5)) for t, a, b in counts}
    strong = sorted((t for t in weight if weight[t] >= 3.5 and sure[t] >= 1.0), key=lambda t: (len(t), t))
    words = {t for t in strong if t[0] != "^"}
    most_word: dict[str, int] = {}  # by stem, documents of its commonest word
    most_stem: dict[str, int] = {}
    for t in words:
        for n in STEMS:
            most_word["^" + t[:n]] = max(most_word.get("^" + t[:n], 0), held[t])
    for t in strong:
        if t[0] == "^":
            for n in STEMS:
                if n < len(t) - 1:
                    most_stem[t[: n + 1]] = max(most_stem.get(t[: n + 1], 0), held[t])
    stems = [t for t in strong if t[0] == "^" and held[t] >= 1.3 * most_word.get(t, 0) and held[t] >= 1.05 * most_stem.get(t, 0) and held[t] >= 8]
    roots = {t[1:] for t in stems}
    chosen = [(t, False) for t in words if not any(t[:n] in roots for n in STEMS)] + [(t, True) for t in sorted(roots) if not any(t[:n] in roots for n in STEMS if n < len(t))]
    ranked = sorted(chosen, key=lambda x: (-held["^" + x[0] if x[1] else x[0]], x))
    return [(t, s, min(weight["^" + t if s else t], 8.0)) for t, s in ranked]


def fit_weights(x: np.ndarray, y: np.ndarray, pull: float = 2.0, steps: int = 60) -> np.ndarray:
    """Logistic regression by Newton steps; coefficients are pulled towards PRIOR, the intercept is free.

    A second fit measures the prior in units of the first one's weight for exact
    findings, so kinds of findings that the sample lacks keep their proportion to it.
    """
    x = np.column_stack([x, np.ones(len(x))])
    strength = np.append(np.full(len(PRIOR), pull), 1e-3)
    prior = np.append(PRIOR, 0.0)
    for _ in range(2):
        beta = np.append(prior[:-1], -3.0)
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            grad = x.T @ (p - y) + strength * (beta - prior)
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(strength), grad)
            beta -= step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
            if np.abs(step).max() < 1e-8:
                break
        prior = np.append(PRIOR * max(beta[0], 1.0), 0.0)
    return beta


@dataclass
class Model:
    terms: list[tuple[str, bool, float]]
    beta: np.ndarray | None
    harmless: frozenset[str] = frozenset()
    rigid: frozenset[str] = frozenset()

    def scorer(self):
        lexicon = Lexicon(self.terms, self.harmless, rigid=self.rigid)

        def score(texts: list[str]) -> np.ndarray:
            if self.beta is None:
                return np.zeros(len(texts))
            x = np.array([lexicon.findings(t) for t in texts]).reshape(-1, len(FEATURES))
            return 1 / (1 + np.exp(-np.clip(x @ self.beta[:-1] + self.beta[-1], -30, 30)))

        return score


def fold(doc_id: Column, parts: int = 3) -> Column:
    """crc32 of the id as text, modulo ``parts``."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts))


def _mark(batches):
    """The smallest hash of three words in a row: near copies mostly share it, other texts don't."""
    for b in _pieces(batches):
        words, offsets = hash_words(as_bytes(b.column("text")), lower=True)
        least = np.zeros(b.num_rows, np.uint64)
        for i, (s, e) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
            own = words[s:e]
            windows = window_hashes(own, 3)
            least[i] = windows.min() if len(windows) else own.sum(dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("y"), pa.array(least.view(np.int64))], ["id", "y", "mark"])


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = 20_000, held_out_fold: int = 1, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learn from labelled rows outside the held-out fold, ``fit_rows`` of them at most."""
    key = F.col(id_col).cast("long")
    sample = (
        labels.select(key.alias("id"), F.col(label_col).cast("int").alias("y"))
        .filter("id IS NOT NULL AND y IS NOT NULL")
        .filter(fold(F.col("id")) != held_out_fold)
        .dropDuplicates(["id"])
        .orderBy(F.xxhash64("id"), "id")
        .limit(fit_rows)
    )
    texts = docs.select(key.alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # Of copies and near copies in the sample one speaks, or a copied text's rare words would look like evidence.
    marked = texts.join(F.broadcast(sample), "id").mapInArrow(_mark, "id long, y int, mark long")
    sample = marked.groupBy("mark", "y").agg(F.min("id").alias("id")).select("id", "y")
    sample = written(sample, "toxicity-sample")
    rows = texts.join(F.broadcast(sample), "id").select("text", F.when(F.col("y") > 0, 1).otherwise(0).alias("y"))

    def count(batches):
        for b in batches:
            y = b.column("y").to_pylist()
            found = count_terms(b.column("text").to_pylist(), y)
            terms = ["", *found]
            pairs = [[len(y) - sum(y), sum(y)], *found.values()]
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["term", "clean", "toxic"])

    counted = rows.mapInArrow(count, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    least = 3
    kept = [tuple(r) for r in counted.filter(f"term = '' OR (toxic >= {least} AND toxic > clean)").collect()]
    clean, toxic = next(((a, b) for t, a, b in kept if t == ""), (0, 0))
    if not clean or not toxic:
        return Model([], None)
    terms = choose_terms([k for k in kept if k[0]], clean, toxic)
    held = {t: b for t, _, b in kept}
    rare = frozenset(t for t, stem, w in terms if not stem and (w < 4 or held[t] < max(8, FUZZY_SHARE * toxic)))

    # Ordinary words one edit away from a term: learnt from one half of the sample, so that the other half measures what is left.
    def near(batches):
        lexicon = Lexicon(terms, rigid=rare)
        for b in batches:
            found = set().union(*map(lexicon.near_misses, b.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], ["word"])

    half = F.pmod(F.xxhash64("text"), F.lit(2))
    harmless = frozenset(r.word for r in rows.filter(half == 0).filter("y = 0").select("text").mapInArrow(near, "word string").distinct().collect())

    lexicon = Lexicon(terms, rigid=rare)
    met = Counter(t for w in harmless for t in lexicon.neighbours(w))
    rigid = rare | {t for t, n in met.items() if n > MOST_NEIGHBOURS}

    def features(batches):
        lexicon = Lexicon(terms, harmless, rigid=rigid)
        for b in batches:
            x = np.array([lexicon.findings(t) for t in b.column("text").to_pylist()]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in x.T), b.column("y")], [*FEATURES, "y"])

    table = np.array([tuple(r) for r in rows.filter(half == 1).mapInArrow(features, ", ".join(f"{f} double" for f in FEATURES) + ", y int").collect()], float)
    table = table[np.lexsort(table.T)] if len(table) else table  # rows arrive in any order
    if len(table) == 0 or table[:, -1].min() == table[:, -1].max():
        return Model(terms, np.append(PRIOR, -3.0), harmless, rigid)
    return Model(terms, fit_weights(table[:, :-1], table[:, -1]), harmless, rigid)


def toxicity(docs: DataFrame, model: Model, threshold: float = 0.7, held_out_fold: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches):
        score = model.scorer()
        for b in _pieces(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(score([t.decode() for t in as_bytes(b.column("text"))]))], ["doc_id", "score"])

    scored = rows.mapInArrow(run, "doc_id long, score double")
    return scored.select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id")) == held_out_fold, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text scores below ``threshold``, with all their columns."""

    def run(batches):
        score = model.scorer()
        for whole in batches:
            for b in _pieces(iter([whole]), text_col):
                texts = [t.decode() for t in as_bytes(b.column(b.schema.get_field_index(text_col)))]
                yield b.filter(pa.array(score(texts) < threshold))

    return docs.mapInArrow(run, docs.schema)
