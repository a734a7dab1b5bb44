"""Toxicity by a weighted finite-state pattern grammar.

A lexicon maps words to classes, and transducers over classes are composed. From right to left, one machine sees what an insult is said of: a thing within three
tokens behind it (scum on a pond, a stupid question) weakens it unless it is aimed at someone, a person behind it aims it. From left to right, negation weakens what
follows it, reported speech weakens the rest of its clause or quotation, the target machine aims insults and threats at persons before them, the threat machine turns
intent, threat and target into violence, and the insult machine weighs what is left. Every clause is run through both; matched clauses are scored, not words: violence
and insults that are aimed make a document toxic, an insult that is aimed at nobody counts for part, so that it takes several of them, a negated, reported or
misplaced one for little. A document is toxic when its clauses sum to ``LIMIT``.

The lexicon grows by stems learned from labelled rows, for each language: those whose longer forms stand in far more toxic than clean
documents. At most ``LABELLED_ROWS`` rows of either label are read for that, the ones with the least hash; near copies among them share one
vote, and a stem must have ``FORMS`` different forms, so that a text which was copied often teaches no more than one that wasn't. What chance
alone puts of such forms into a text of its length, measured on the clean rows, is taken off its score.

Defined results: null, empty and blank texts have no clause and are never flagged; repeated documents are flagged each; a null language
uses the stems of all languages; labels that are null, or of no document, teach nothing, and without labels only the built-in lexicon
counts; of stems with the same evidence the shorter goes first, then by letters; of the labelled rows those with the least hash, then id; further columns are
ignored. Texts are read whole, whatever their length.
"""

from __future__ import annotations

import functools
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import Scratch, read_table, row_key

LIMIT = 1.0
LABELLED_ROWS = 3000
#: Lengths of stems in letters; least evidence for one (log-likelihood ratio) and least ratio of its rates among toxic and clean rows.
STEM_LETTERS = range(4, 11)
EVIDENCE = 40.0
RATIO = 5.0
FORMS = 4
LEXICON = {
    "INSULT": "idiot idiots moron morons scum stupid loser losers pathetic worthless disgusting imbecile imbeciles bastard bastards bitch bitches asshole assholes dumbass retard retarded "
    "degenerate degenerates subhuman vermin filth dimwit halfwit cretin scumbag scumbags jackass dipshit shithead fuckwit wanker twat idiotic moronic "
    "dummkopf vollidiot trottel arschloch abschaum hurensohn schwachkopf missgeburt versager widerling connard connasse salaud salope abruti crétin imbécile enculé "
    "pendejo gilipollas cabrón imbécil estúpido estúpida hijoputa subnormal",
    "MILD": "trash clown clowns garbage dumb ugly useless fool fools coward cowards dreck lâche payaso basura",
    "THREAT": "kill murder stab strangle shoot hurt destroy beat burn crush töten umbringen tuer matar",
    "TARGET": "you u ya your yourself y'all you're youre him her them they he she these those everyone women men people immigrants muslims jews christians du ihr euch dich tu toi vous ustedes usted",
    "SELF": "i i'll i'm we we'll ich je yo",
    "COPULA": "are is am be was were 're bist seid es est eres son",
    "WILL": "will gonna shall should must going deserve 'll werde werden vais voy",
    "NEGATION": "not never no isn't aren't wasn't don't doesn't didn't won't without nobody nicht kein keine jamais nunca neither nor cannot can't",
    "REPORT": "said says say called calls wrote writes quoted quotes reported claimed claims alleged word term sagte sagt disait dijo dice article headline",
    "THING": "pond lake water surface river soil crop crops plant plants growth development control collection disposal truck bin heap question questions mistake mistakes idea ideas "
    "joke jokes weather luck habit habits game games movie film song rule rules policy machine computer printer phone software code bug frage fragen fehler idee wetter erreur idée pregunta error",
}
QUOTE, OTHER, LEARNED, AIMED, MISPLACED, VIOLENCE = "QUOTE", "OTHER", "LEARNED", "AIMED", "MISPLACED", "VIOLENCE"
CLASS = {w: c for c, words in LEXICON.items() for w in words.split()}
TRIGGERS = frozenset(w for w, c in CLASS.items() if c in ("INSULT", "MILD", "THREAT"))
CLASSES = (*LEXICON, LEARNED, QUOTE, OTHER)
_INSULTS = {"INSULT": 1.0, "MILD": 0.9, LEARNED: 1.0, MISPLACED: 1.0}
_WORD = re.compile(r"\w+")
_CLAUSE = re.compile(r"[.!?;\n]+")
_TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)*|[\"“”«»]")
_HARM = ("INSULT", "MILD", "THREAT", LEARNED, AIMED, MISPLACED)
_HARMFUL = frozenset(_HARM)
#: What a learned form counts in a clause, where it is aimed at nobody.
LEARNED_WEIGHT = 0.6


class Transducer:
    """Sequential: step(state, symbol) gives (state, symbol, weight); all states are reached from 0."""

    def __init__(self, step):
        self.step = step

    def then(self, other: Transducer) -> Transducer:
        """Composition: the second reads what the first writes; weights multiply."""

        def step(state, symbol):
            a, b = state if state != 0 else (0, 0)
            a, middle, w = self.step(a, symbol)
            b, out, v = other.step(b, middle)
            return (a, b), out, w * v

        return Transducer(step)

    def table(self, alphabet) -> tuple[list[dict[str, int]], list[dict[str, tuple[str, float]]]]:
        """All reachable states as tables of the next state and of what is written with what weight, a state's row by symbol."""
        index, todo = {0: 0}, [0]
        to: list[dict[str, int]] = []
        written: list[dict[str, tuple[str, float]]] = []
        while todo:
            s = todo.pop(0)
            row, w = {}, {}
            for x in alphabet:
                t, out, v = self.step(s, x)
                if t not in index:
                    index[t] = len(index)
                    todo.append(t)
                row[x] = index[t]
                w[x] = out, v
            to.append(row)
            written.append(w)
        return to, written


def _negation(state, x):
    """After a negation, an insult within five tokens counts a tenth and a threat is none."""
    if x == "NEGATION":
        return 5, OTHER, 1.0
    if state and x in _HARM:
        return (state - 1, OTHER, 1.0) if x == "THREAT" else (state - 1, x, 0.1)
    return max(0, state - 1), x, 1.0


def _report(state, x):
    """After a verb of speech, or in a quotation that one opens, an insult counts a fifth and a threat is none. States: 0 plain, 1 reported, 2 in a reported quotation."""
    if x == "REPORT":
        return 1 if state == 0 else state, OTHER, 1.0
    if x == QUOTE:
        return {0: 0, 1: 2, 2: 0}[state], OTHER, 1.0
    if state and x in _HARM:
        return (state, OTHER, 1.0) if x == "THREAT" else (state, x, 0.2)
    return state, x, 1.0


def _said_of(state, x):
    """Read from right to left. State (thing, target): tokens in which each still counts, 0 for none."""
    thing, target = state or (0, 0)
    after = max(0, thing - 1), max(0, target - 1)
    if x == "THING":
        return (3, after[1]), OTHER, 1.0
    if x == "TARGET":
        return (after[0], 2), x, 1.0
    if x in _INSULTS and thing:
        return after, MISPLACED, 1.0
    if x in _INSULTS and target:
        return after, AIMED, _INSULTS[x]
    return after, x, 1.0


def _target(state, x):
    """For five tokens after a target, insults are aimed at it. The state counts them down."""
    if x == "TARGET":
        return 5, x, 1.0
    if state and x in _INSULTS:
        return state - 1, AIMED, _INSULTS[x]
    return max(0, state - 1), x, 1.0


def _threat(state, x):
    """A threat within three tokens of intent, with a target within two tokens behind it, is violence. State (intent, threat): tokens in which each still counts."""
    intent, threat = state or (0, 0)
    after = max(0, intent - 1), max(0, threat - 1)
    if x == "WILL":
        return (3, after[1]), OTHER, 1.0
    if x == "THREAT":
        return (0, 2) if intent else after, OTHER, 1.0
    if x == "TARGET" and threat:
        return (after[0], 0), VIOLENCE, 1.0
    return after, x, 1.0


_WEIGHTS = {AIMED: 1.5, MISPLACED: 0.12, VIOLENCE: 1.5, "INSULT": 0.6, "MILD": 0.5, LEARNED: LEARNED_WEIGHT}


def _insult(state, x):
    """Has one state. Emits HIT with the weight of what the others have found."""
    return (0, "HIT", _WEIGHTS[x]) if x in _WEIGHTS else (0, OTHER, 0.0)


BACKWARD = Transducer(_said_of)
FORWARD = [Transducer(f) for f in (_negation, _report, _target, _threat, _insult)]
_BACK_TO, _BACK = BACKWARD.table(CLASSES)
_TO, _OUT = functools.reduce(Transducer.then, FORWARD).table((*CLASSES, AIMED, MISPLACED))


def grammar_score(classes: list[str]) -> float:
    """What the two machines make of a clause's classes."""
    seen, state = [], 0
    for x in reversed(classes):
        seen.append(_BACK[state][x])
        state = _BACK_TO[state][x]
    score, state = 0.0, 0
    for x, weight in reversed(seen):
        out, w = _OUT[state][x]
        if out == "HIT":
            score += w * weight
        state = _TO[state][x]
    return score


class Stems:
    """Learned stems of one language: a longer word that begins with one is a form of it, unless it is one of the common words."""

    def __init__(self, stems: list[str], common: list[str], rate: float):
        """rate: forms among the words of clean rows."""
        self.stems, self.common, self.rate = tuple(sorted(stems)), frozenset(common), rate

    def has(self, word: str) -> bool:
        return word.startswith(self.stems) and word not in self.common and word not in self.stems

    def any_in(self, words: set[str]) -> bool:
        return bool(self.stems) and any(map(self.has, words))


NO_STEMS = Stems([], [], 0.0)


def normal(token: str) -> str:
    return token.lower().replace("’", "'")


def clause_scores(text: str | None, learned: Stems = NO_STEMS) -> list[tuple[str, float]]:
    """(clause, score) of every clause with a score."""
    out = []
    for clause in _CLAUSE.split(text) if text else ():
        classes = []
        for token in _TOKEN.findall(clause):
            low = normal(token)
            classes.append(QUOTE if low in '"“”«»' else CLASS.get(low) or (LEARNED if learned.stems and learned.has(low) else OTHER))
        if not _HARMFUL.isdisjoint(classes) and (score := grammar_score(classes)) > 0:
            out.append((clause.strip(), round(score, 6)))
    return out


def may_match(text: str | None, learned: Stems = NO_STEMS) -> bool:
    """Whether any word can begin to score; a text without one has no matched clause."""
    if not text:
        return False
    words = set(map(normal, set(_TOKEN.findall(text))))  # the tokens that the grammar reads; no clause ends within one
    return not TRIGGERS.isdisjoint(words) or learned.any_in(words)


def document_score(text: str | None, learned: Stems = NO_STEMS) -> tuple[float, list[tuple[str, float]]]:
    """(score of the document, its matched clauses)."""
    if not may_match(text, learned):
        return 0.0, []
    found = clause_scores(text, learned)
    score = sum(s for _, s in found)
    if learned.rate:
        by_chance = learned.rate * len(_WORD.findall(text)) * LEARNED_WEIGHT
        score -= min(by_chance, sum(s for _, s in found) - sum(s for _, s in clause_scores(text)))
    return round(score, 6), found


def _evidence(a: float, n: float, b: float, m: float) -> float:
    """Log-likelihood ratio of a in n against b in m having one rate."""
    p = (a + b) / (n + m)
    ll = lambda k, t, q: (k * math.log(q) if k else 0.0) + ((t - k) * math.log(1 - q) if t > k else 0.0)
    return 2 * (ll(a, n, a / n) + ll(b, m, b / m) - ll(a, n, p) - ll(b, m, p)) if 0 < p < 1 else 0.0


def learn(spark: SparkSession, docs: DataFrame, labels: DataFrame, labelled_rows: int = LABELLED_ROWS) -> dict[str, Stems]:
    """The stems of each language."""
    scratch = Scratch(spark, "toxicity")
    toxic_of = labels.filter("toxic is not null and doc_id is not null").select("doc_id", F.col("toxic").cast("int").alias("y")).distinct()
    rows = toxic_of.withColumn("n", F.row_number().over(Window.partitionBy("y").orderBy(F.xxhash64("doc_id"), "doc_id"))).filter(F.col("n") <= labelled_rows)
    known = docs.select("doc_id", "text", "lang").filter("text is not null and lang is not null").join(F.broadcast(rows.select("doc_id", "y")), "doc_id")
    found = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), 0)
    words = known.select(row_key("doc_id", "text").alias("rid"), "lang", "y", found.alias("all"))
    four = lambda seed: F.array_min(F.transform(F.sequence(F.lit(1), F.greatest(F.size("all") - 3, F.lit(1))), lambda i: F.xxhash64(F.lit(seed), F.concat_ws(" ", F.slice("all", i, 4)))))
    words = scratch.table(words.select("rid", "lang", "y", F.size("all").alias("n"), F.array_distinct("all").alias("w"), *[four(k).alias(f"m{k}") for k in range(3)]), "words")
    # near copies have the same least hash of four words in a row: the middle of three counts is how many share a vote
    shares = [F.count("*").over(Window.partitionBy("lang", f"m{k}")).alias(f"c{k}") for k in range(3)]
    votes = words.select("rid", "lang", "y", "n", "w", *shares).withColumn("v", 1.0 / F.array_sort(F.array("c0", "c1", "c2"))[1]).drop("c0", "c1", "c2")
    votes = scratch.table(votes, "votes")
    bad, good = F.sum(F.col("v") * F.col("y")).alias("a"), F.sum(F.col("v") * (1 - F.col("y"))).alias("b")
    totals: dict[str, list[float]] = {}
    for r in votes.groupBy("lang").agg(bad, good, F.sum(F.col("v") * (1 - F.col("y")) * F.col("n")).alias("clean")).collect():
        totals[r.lang] = [r.a, r.b, r.clean]
    each = votes.select("rid", "lang", "y", "v", F.explode("w").alias("word")).filter((F.length("word") > STEM_LETTERS[0]) & ~F.col("word").isin(sorted(CLASS)))
    forms = scratch.table(each.groupBy("lang", "word").agg(bad, good), "forms")
    lengths = F.sequence(F.lit(STEM_LETTERS[0]), F.least(F.length("word") - 1, F.lit(STEM_LETTERS[-1])))
    stem = F.explode(F.transform(lengths, lambda k: F.substring("word", F.lit(1), k))).alias("stem")
    # only stems of enough forms, most of them among toxic rows, are worth counting by document
    several = forms.filter("a > b").select("lang", stem).groupBy("lang", "stem").agg(F.count("*").alias("k")).filter(F.col("k") >= FORMS).select("lang", "stem")
    counts = each.select("rid", "lang", "y", "v", stem).distinct().join(several, ["lang", "stem"]).groupBy("lang", "stem").agg(bad, good)
    likely: dict[str, list[tuple[float, str]]] = {}
    for r in counts.filter("a >= 8 and a > b / 4").collect():
        t, c, _ = totals[r.lang]
        if t and c and (r.a / t) >= RATIO * (r.b / c):
            if (e := _evidence(min(r.a, t), t, min(r.b, c), c)) >= EVIDENCE:
                likely.setdefault(r.lang, []).append((e, r.stem))
    chosen: dict[str, list[str]] = {}
    for lang, stems in likely.items():
        mine = chosen.setdefault(lang, [])
        for _, s in sorted(stems, key=lambda x: (-x[0], len(x[1]), x[1])):
            if not any(s.startswith(x) or x.startswith(s) for x in mine):
                mine.append(s)
    out: dict[str, Stems] = {}
    for lang, stems in chosen.items():
        t, c, size = totals[lang]
        got = forms.filter(F.col("lang") == lang).filter(F.col("word").rlike("^(?:" + "|".join(stems) + ").+")).collect()  # forms of a few stems in a bounded sample
        common = [r.word for r in got if r.b > 3 and r.a / t < RATIO * r.b / c * 2]
        out[lang] = Stems(stems, common, sum(r.b for r in got if r.word not in common) / max(1, size))
    for name in ("words", "votes", "forms"):
        scratch.drop(name)
    return out


def _scored(stems: dict[str, Stems]):
    every = Stems([s for x in stems.values() for s in x.stems], [w for x in stems.values() for w in x.common], max([0.0, *(x.rate for x in stems.values())]))

    def run(batches):
        for b in batches:
            ids, total, clauses = [], [], []
            for i, text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                score, found = document_score(text, every if lang is None else stems.get(lang, NO_STEMS))
                if score >= LIMIT:
                    ids.append(i)
                    total.append(score)
                    clauses.append([{"clause": c, "score": s} for c, s in found])
            kind = pa.list_(pa.struct([("clause", pa.string()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total, pa.float64()), pa.array(clauses, kind)], ["doc_id", "score", "clauses"])

    return run


def toxic(docs: DataFrame, stems: dict[str, Stems] | None = None) -> DataFrame:
    """The toxic documents: doc_id, score, clauses (those that matched, with their scores)."""
    return docs.select("doc_id", "text", "lang").mapInArrow(_scored(stems or {}), "doc_id long, score double, clauses array<struct<clause:string,score:double>>")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return toxic(docs, learn(spark, docs, read_table(spark, sf_dir, "labels")))
