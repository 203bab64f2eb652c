"""Language identification by cross-parsing entropy.

Labelled text of each language becomes a suffix automaton, which recognises
every substring of it.  A text is parsed greedily into the longest phrases
that occur in a language's sample; the fewer phrases per character (times the
logarithm of the sample's length), the closer the language.

The automata are laid out in one sparse transition table, and texts are parsed
in windows side by side, so a step over all windows is a handful of array
operations.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnstile.functions.ordered import interpolated_percentiles
from turnstile.llm.common import distinct_sample, giving_back, text_slices
from turnstile.session import reuse

SAMPLE_CHARS = 24_000   # bound: characters learned per language
SAMPLE_DOCS = 200       # bound: different texts drawn per language
TRIES = 4096            # cells that are tried together when a row is placed
WINDOW = 1024           # characters parsed as one lane; phrases end at its end
LEAST_LIMIT_DOCS = 20   # a language with fewer takes the widest limit of the others
LIMIT_SHARE = 0.99      # share of labelled documents at or below a language's ordinary entropy
CLEARLY = 1.75          # an entropy this many times the ordinary one is clearly above it
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def normalise(text: str | None) -> tuple[np.ndarray, int]:
    """Lower-cased code points with each run of other characters as one
    space, and the number of letters."""
    if not text:
        return np.empty(0, dtype=np.uint32), 0
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    letter = _letters()[codes]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first other character after a letter becomes the space
    return np.where(letter, codes, 32)[keep].astype(np.uint32), int(letter.sum())


class SuffixAutomaton:
    """Online construction; ``moves[s]`` maps a symbol to the next state."""

    def __init__(self, symbols):
        self.moves: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for c in symbols:
            last = self._extend(last, c)

    def _extend(self, last: int, c: int) -> int:
        moves, link, length = self.moves, self.link, self.length
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                clone = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        return new


def _interleave(moves: list[dict[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start of each state's row, each cell's state or -1, its next state): rows
    of several moves where their first fit is among the free cells, longest
    first, and those of one move in what is left.  The root has no row."""
    total = sum(map(len, moves))
    base = np.zeros(len(moves), dtype=np.int64)
    owner = np.full(2 * total + 1024, -1, dtype=np.int64)
    to = np.zeros(len(owner), dtype=np.int64)
    low = 0  # no free cell before it
    wide = sorted((s for s in range(1, len(moves)) if len(moves[s]) > 1), key=lambda s: (-len(moves[s]), s))
    for s in wide:
        own = np.array(sorted(moves[s]), dtype=np.int64)
        shift = own - own[0]
        at = low
        while True:
            if at + TRIES + shift[-1] >= len(owner):
                more = len(owner) + TRIES + int(shift[-1])
                owner = np.concatenate([owner, np.full(more, -1, dtype=np.int64)])
                to = np.concatenate([to, np.zeros(more, dtype=np.int64)])
            free = np.flatnonzero(owner[at:at + TRIES] < 0) + at
            for d in shift[1:].tolist():
                free = free[owner[free + d] < 0]
            if len(free):
                break
            at += TRIES
        first = int(free[0])
        base[s] = first - own[0]
        owner[first + shift] = s
        to[first + shift] = [moves[s][c] for c in own.tolist()]
        taken = owner[low:low + TRIES] >= 0
        low += int(taken.argmin()) if not taken.all() else TRIES
    single = np.array([s for s in range(1, len(moves)) if len(moves[s]) == 1], dtype=np.int64)
    short = len(single) - int((owner < 0).sum())
    if short > 0:
        owner = np.concatenate([owner, np.full(short, -1, dtype=np.int64)])
        to = np.concatenate([to, np.zeros(short, dtype=np.int64)])
    cell = np.flatnonzero(owner < 0)[:len(single)]
    symbol, target = (np.array(z, dtype=np.int64) for z in zip(*[next(iter(moves[s].items())) for s in single.tolist()])) \
        if len(single) else (np.empty(0, np.int64),) * 2
    base[single] = cell - symbol
    owner[cell], to[cell] = single, target
    end = int(np.flatnonzero(owner >= 0)[-1]) + 1 if (owner >= 0).any() else 0
    return base, owner[:end], to[:end]


class CrossParser:
    """The automata of all languages, laid out sparsely in one table.

    A state's move by a symbol is at cell ``base[state] + symbol``, which is the
    state's own if it holds its number in the upper half; the lower half is the
    next state.  Rows are shifted so that they fill each other's gaps, so the
    table grows with the moves (fewer than three a character) and not with
    states times symbols.  Without a move a new phrase starts, by the language's
    row of ``fresh``.  A symbol that a sample does not have ends the phrase and
    counts as one of its own.
    """

    def __init__(self, samples: dict[str, np.ndarray]):
        self.languages = sorted(samples)
        self.limits: dict[str, float] = {}  # see learn_limits
        symbols = sorted(set().union(*(np.unique(s).tolist() for s in samples.values()))) if samples else []
        self.width = len(symbols) + 1
        self.symbol = {c: k + 1 for k, c in enumerate(symbols)}  # 0: in no sample
        self.codes = np.array(symbols, dtype=np.uint32)
        self.weight = np.array([math.log2(max(2, len(samples[x]))) for x in self.languages])
        self.fresh = np.zeros((len(self.languages), self.width), dtype=np.int32)
        # A row may start before its first cell and end after its last one by the width.
        tables, bases, roots, states, cells = [], [], [], 0, self.width
        for k, language in enumerate(self.languages):
            automaton = SuffixAutomaton([self.symbol[c] for c in samples[language].tolist()])
            roots.append(states)
            self.fresh[k] = states
            for c, to in automaton.moves[0].items():
                self.fresh[k, c] = states + to
            base, owner, to = _interleave(automaton.moves)
            table = np.full(len(owner), -1, dtype=np.int64)
            own = owner >= 0
            table[own] = (owner[own] + states << 32) | (to[own] + states)
            tables.append(table)
            bases.append(base + cells)
            states += len(automaton.moves)
            cells += len(table)
        if max(states, cells + self.width, self.fresh.size) >= 1 << 31:
            raise OverflowError(f"{len(self.languages)} languages: {states} states, {cells} cells")
        edge = np.full(self.width, -1, dtype=np.int64)
        self.roots = np.array(roots, dtype=np.int32)
        self.table = np.concatenate([edge, *tables, edge]) if tables else np.empty(0, np.int64)
        self.base = np.concatenate(bases).astype(np.int32) if bases else np.empty(0, np.int32)

    def to_symbols(self, codes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.where(self.codes[at] == codes, at + 1, 0).astype(np.int32)

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases of each text under each language, (texts, languages)."""
        if not self.languages:
            return np.zeros((len(texts), 0), dtype=np.int64)
        lanes, owner = [], []
        for i, codes in enumerate(texts):
            if len(codes):
                symbols = self.to_symbols(codes)
                for at in range(0, len(symbols), WINDOW):
                    lanes.append(symbols[at:at + WINDOW])
                    owner.append(i)
        out = np.zeros((len(texts), len(self.languages)), dtype=np.int64)
        if not lanes:
            return out
        sizes = np.array([len(x) for x in lanes])
        order = np.argsort(-sizes, kind="stable")
        steps = np.zeros((WINDOW, len(lanes)), dtype=np.int32)
        for lane, k in enumerate(order.tolist()):
            steps[: sizes[k], lane] = lanes[k]
        active = len(lanes) - np.searchsorted(np.sort(sizes), np.arange(WINDOW), side="right")
        placed = np.array(owner)[order]
        for k in range(len(self.languages)):
            state = np.full(len(lanes), self.roots[k], dtype=np.int32)
            count = np.zeros(len(lanes), dtype=np.int32)
            for t in range(int(sizes.max())):
                n = int(active[t])
                symbol = steps[t, :n]
                cell = self.table.take(self.base.take(state[:n]) + symbol)
                new = (cell >> 32) != state[:n]
                count[:n] += new
                state[:n] = np.where(new, self.fresh[k].take(symbol), cell.astype(np.int32))
            np.add.at(out[:, k], placed, count)
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, confidence) per text; ties go to the smaller name."""
        return [(language, score) for language, score, _ in self.judge(texts)]

    def judge(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """(language, confidence, strange) per text; strange is a text above
        the limits of all languages."""
        normal = [normalise(t) for t in texts]
        counts = self.phrases([codes for codes, _ in normal])
        limits = np.array([self.limits.get(x, np.inf) for x in self.languages])
        out = []
        for (codes, letters), row in zip(normal, counts):
            if not letters or not self.languages:
                out.append((UNKNOWN, 0.0, False))
                continue
            entropy = row * self.weight / len(codes)
            best = int(np.argmin(entropy))
            others = np.delete(entropy, best)
            margin = 1.0 if not len(others) else 1.0 - entropy[best] / others.min()
            strange = bool((sure_entropy(row, self.weight, len(codes)) > limits).all())
            out.append((self.languages[best], float(min(1.0, max(0.0, margin))), strange))
        return out


def sure_entropy(phrases: np.ndarray, weight: np.ndarray, length: int) -> np.ndarray:
    """Bits per character that a text shows beyond chance: with two standard
    deviations (the root of the count) fewer phrases.  Short texts show little."""
    return (phrases - 2 * np.sqrt(phrases)).clip(0) * weight / length


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang",
          sample_chars: int = SAMPLE_CHARS) -> CrossParser:
    """Learn from a bounded sample of labelled rows.

    Every language is learned, however many there are.  Rows with a null
    language or text teach nothing.  Per language, different texts are taken
    whole in the order of a hash until ``sample_chars`` characters are
    together, at most ``SAMPLE_DOCS`` of them; of the last one, and of a text
    that is longer by itself, a part from a place chosen by its hash.  So
    copies count once, the sample does not depend on partitioning, and a
    language with less text than that is used whole.
    """
    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")) \
                   .where("lang is not null and text is not null and lang <> 'und'")
    order = Window.partitionBy("lang").orderBy("_hash")
    # The texts that the sample needs, a language's at most twice its size.
    size = F.least(F.char_length("text"), F.lit(sample_chars))
    drawn = distinct_sample(rows, "text", SAMPLE_DOCS, "lang") \
        .withColumn("before", F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, -1))) \
        .where(F.coalesce("before", F.lit(0)) < sample_chars)
    spare = F.greatest(F.lit(0), F.char_length("text") - sample_chars)
    drawn = drawn.select("lang", "_hash", F.substring("text", F.pmod(F.col("_hash"), spare + 1).cast("int") + 1,
                                                      F.lit(sample_chars)).alias("text")).collect()
    samples: dict[str, list[np.ndarray]] = {}
    for r in sorted(drawn, key=lambda r: (r["lang"], r["_hash"])):
        own = samples.setdefault(r["lang"], [])
        left = sample_chars - sum(map(len, own))
        codes = normalise(r["text"])[0]
        at = r["_hash"] % (max(0, len(codes) - left) + 1)
        own.append(codes[at:at + max(0, left)])
    return CrossParser({k: np.concatenate(v) for k, v in samples.items() if sum(map(len, v))})


def learn_limits(parser: CrossParser, labelled: DataFrame, text_col: str = "text",
                 lang_col: str = "lang") -> CrossParser:
    """``parser`` with a limit of the entropy for each of its languages.

    Every labelled text is measured, by a parser that has not learned it: each
    half of the texts (by a hash, so copies stay together) teaches one that
    measures the other half.  A limit is ``CLEARLY`` times what ``LIMIT_SHARE``
    of a language's different texts stay below.  Without enough labelled
    documents of any language there is no limit.
    """
    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")) \
                   .where("lang is not null and text is not null and lang <> 'und'") \
                   .withColumn("half", F.pmod(F.xxhash64("text", F.lit("half")), F.lit(2)).cast("int"))
    # Two parsers, each bounded by the sample sizes above; the first has learned from half 1.
    shared = labelled.sparkSession.sparkContext.broadcast([train(rows.where(F.col("half") == 1 - k)) for k in range(2)])

    def run(batches):
        at = [{x: k for k, x in enumerate(p.languages)} for p in shared.value]
        for batch in batches:
            for k, parser in enumerate(shared.value):
                for part, texts in text_slices(batch.filter(pc.equal(batch.column("half"), k)), "text"):
                    normal = [normalise(t) for t in texts]
                    counts = parser.phrases([codes for codes, _ in normal])
                    found = [(x, h, float(sure_entropy(row, parser.weight, len(codes))[at[k][x]]))
                             for x, h, (codes, letters), row in zip(part.column("lang").to_pylist(),
                                                                    part.column("hash").to_pylist(), normal, counts)
                             if letters and x in at[k]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.float64()))],
                        names=["lang", "hash", "entropy"])

    measured = rows.withColumn("hash", F.xxhash64("text", F.lit("sample"))) \
                   .mapInArrow(giving_back(run), "lang string, hash long, entropy double")
    measured = reuse(measured.groupBy("lang", "hash").agg(F.min("entropy").alias("entropy")))  # numbers, copies once
    found = interpolated_percentiles(measured, "entropy", {"e": LIMIT_SHARE}, ["lang"]).collect()  # a row a language
    limits = {r["lang"]: CLEARLY * r["e"] for r in found if r["n"] >= LEAST_LIMIT_DOCS}
    widest = max(limits.values(), default=math.inf)
    parser.limits = {x: limits.get(x, widest) for x in parser.languages}
    return parser


def identify(docs: DataFrame, parser: CrossParser, text_col: str = "text", pred_col: str = "lang_pred",
             score_col: str = "score", strange_col: str | None = None) -> DataFrame:
    """``docs`` with the predicted language and its confidence (0 to 1), and
    with ``strange_col`` also whether the text lies above all limits.

    Every whole text is parsed.  A null text, or one without a letter, is
    ``und`` with confidence 0 and not strange.  Existing columns of the result
    names are replaced; every other column, null or not, passes through unchanged.
    """
    kept = [c for c in docs.columns if c not in (pred_col, score_col, strange_col)]
    src = docs.select(*[F.col(f"`{c}`") for c in kept])
    schema = T.StructType([*src.schema.fields, T.StructField(pred_col, T.StringType()),
                           T.StructField(score_col, T.DoubleType()),
                           *([T.StructField(strange_col, T.BooleanType())] if strange_col else [])])
    shared = docs.sparkSession.sparkContext.broadcast(parser)  # bounded by the sample sizes above

    def run(batches):
        for batch in batches:
            for part, texts in text_slices(batch, text_col):
                found = shared.value.judge(texts)
                results = [pa.array([r[k] for r in found], kind) for k, kind in enumerate(
                    (pa.string(), pa.float64(), pa.bool_())[:3 if strange_col else 2])]
                yield pa.RecordBatch.from_arrays([*part.columns, *results], names=schema.names)

    return src.mapInArrow(giving_back(run), schema)
