"""Secret scans: fixed rules, and character Markov models of random strings
and of ordinary identifiers compared by log-likelihood ratio.

The models are trained from labelled samples: the values that the rules find
are random strings (beside generated ones), and the other tokens of the corpus
are ordinary identifiers (beside common ones of program texts).  A token is a secret where, per character, the random model
explains it better by more than a margin.
"""

from __future__ import annotations

import heapq
import re
import zlib
from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnstile.llm.common import distinct_sample, giving_back, text_slices

# Fixed by the contract: the base rules and the least lengths of their values.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LEAST = 12
KINDS = ("assign", "access", "hex", "markov")

# Tokens that the models judge: characters of keys and identifiers.
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
LEAST_KINDS = 2   # of lower case, capitals and digits in a key; one kind alone is a word, a number or a ruler
LEAST_CHARS = 8   # different characters in a key
TOKEN_CHARS = re.compile(r"[A-Za-z0-9+/_=-]+")
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
MARGIN = 0.5            # nats per character
SAMPLE_DOCS = 20_000    # bound: different texts whose tokens the models learn from
SAMPLE_TOKENS = 40      # bound: tokens of each class taken from one of these texts, by a checksum
SMOOTHING = 0.5
LIMIT = 3.0             # most that one character can weigh, nats
GENERATED = 400         # generated random strings among the labelled samples
WEIGHT = 20             # times that each identifier below counts

# Identifiers of program texts, labelled ordinary.
IDENTIFIERS = """
getElementById getElementsByClassName addEventListener removeEventListener documentElement innerHTML querySelectorAll
XMLHttpRequest HttpServletRequest AbstractSingletonProxyFactoryBean NullPointerException IllegalArgumentException
ConcurrentHashMap ArrayIndexOutOfBoundsException toString hashCode compareTo isEmpty SimpleDateFormat StringBuilder
DataFrameReader SparkSession readStream writeStream setUpClass tearDown assertEqual assertRaises TestCase2 utf8 utf-8
user_id customer_id order_date created_at updated_at is_active page_number total_amount first_name last_name
max_connections default_timeout_seconds retry_count http_status_code base_url file_path output_directory version_2
test_case_01 table_name_v2 column_3 step-1 chapter-12 figure-3-2 section_4_1 release-2024-01-15 build-1024 node-12
background-color margin-left font-family border-radius text-align align-items main-content navigation-menu
MAX_VALUE MIN_VALUE DEFAULT_CHARSET BUFFER_SIZE ERROR_CODE HTTP_NOT_FOUND CONTENT_TYPE README LICENSE TODO JSON XML
/usr/local/bin /etc/hosts src/main/java com/example/service index/html static/images/logo lib/python3/site-packages
2024-01-15 2023-12-31T23 1990-2000 123456 1000000 3600 192 255 phone-555-1234 id=12345 width=100 height=200 lang=en
ISO-8859-1 SHA-256 Base64Encoder MD5Digest UTF8Decoder OAuth2Client Http2Connection Vector3D Matrix4x4 Point2D IPv4
Internationalization18n accountSettingsPage1 userAccountSettings shoppingCartItems2 paymentMethodType_1 addressLine2
""".split()

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each rule, code points, by start and
    then by kind in rule order.  A run of 16 or more hex digits is found as a
    whole, since the rule takes every digit it can."""
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


_INDEX = np.full(128, -1, dtype=np.int64)
_INDEX[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))


def _bigrams(tokens: list[str]) -> np.ndarray:
    """Counts of (previous, next) symbols; row 0 of ``previous`` is a start."""
    counts = np.zeros((len(ALPHABET) + 1, len(ALPHABET)))
    for token in tokens:
        s = _INDEX[np.frombuffer(token.encode("ascii"), dtype=np.uint8)]
        np.add.at(counts, (np.concatenate([[0], s[:-1] + 1]), s), 1)
    return counts


@dataclass
class MarkovRatio:
    """log P(next | previous, random) - log P(next | previous, ordinary)."""
    ratio: np.ndarray | None  # None: nothing to learn from, nothing is flagged
    margin: float = MARGIN

    def per_character(self, token: str) -> float:
        s = _INDEX[np.frombuffer(token.encode("ascii"), dtype=np.uint8)]
        return float(self.ratio[np.concatenate([[0], s[:-1] + 1]), s].mean())

    def is_random(self, token: str) -> bool:
        kinds = any(map(str.islower, token)) + any(map(str.isupper, token)) + any(map(str.isdigit, token))
        if self.ratio is None or kinds < LEAST_KINDS or len(set(token)) < LEAST_CHARS:
            return False
        return self.per_character(token) > self.margin


def builtin_counts() -> tuple[np.ndarray, np.ndarray]:
    """Bigram counts of generated random strings (keys of all symbols, of
    letters and digits, of capitals and digits, hex) and of IDENTIFIERS."""
    rng = np.random.default_rng(31)
    kinds = [ALPHABET, ALPHABET[:62], ALPHABET[26:62], "0123456789abcdef"]
    strings = ["".join(rng.choice(list(kinds[k % 4]), 40)) for k in range(GENERATED)]
    return _bigrams(strings), WEIGHT * _bigrams([x for x in IDENTIFIERS if TOKEN_CHARS.fullmatch(x)])


def fit(random: np.ndarray, ordinary: np.ndarray, margin: float = MARGIN) -> MarkovRatio:
    """First-order models of both classes from bigram counts of the corpus.
    The random class has the generated strings' shape where the corpus has
    little to say; no single character weighs more than LIMIT."""
    if not random.any() or not ordinary.any():
        return MarkovRatio(None, margin)
    generated, known = builtin_counts()
    # Both sources of random strings count alike, however many secrets the corpus has.
    random = generated + random * (generated.sum() / random.sum())

    def log_p(counts: np.ndarray) -> np.ndarray:
        counts = counts + SMOOTHING
        return np.log(counts / counts.sum(axis=1, keepdims=True))
    return MarkovRatio(np.clip(log_p(random) - log_p(ordinary + known), -LIMIT, LIMIT), margin)


class Covered:
    """What spans cover, to ask whether others are clear of it."""

    def __init__(self, spans: list[Span]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b, _ in spans:  # by start; overlapping ones become one
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def clear(self, start: int, end: int) -> bool:
        at = bisect_left(self.starts, end)  # the last cover that begins before the end
        return not at or self.ends[at - 1] <= start


def labelled_tokens(text: str) -> tuple[list[str], list[str]]:
    """(random, ordinary) tokens of one text as the rules label them."""
    spans = base_spans(text)
    random = []
    for a, b, kind in spans:
        value = ASSIGN.match(text, a, b)[2] if kind == "assign" else text[a:b]
        if value.isascii() and all(_INDEX[ord(c)] >= 0 for c in value):
            random.append(value)
    covered = Covered(spans)
    words = re.finditer(r"[A-Za-z0-9+/_=-]{6,}", text)
    ordinary = [m[0] for m in words if covered.clear(m.start(), m.end())]
    return _some(random), _some(ordinary)


def _some(tokens: list[str]) -> list[str]:
    """At most SAMPLE_TOKENS of a text's tokens, from wherever in the text."""
    if len(tokens) <= SAMPLE_TOKENS:
        return tokens
    return heapq.nsmallest(SAMPLE_TOKENS, tokens, key=lambda t: (zlib.crc32(t.encode()), t))


def train(docs: DataFrame, text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> MarkovRatio:
    """Learn both models from a bounded sample of different texts, drawn by a
    hash.  Without a token of either class nothing is ever flagged."""
    texts = docs.select(F.col(text_col).alias("text")).where("text is not null")
    schema = T.StructType([T.StructField("previous", T.IntegerType()), T.StructField("next", T.IntegerType()),
                           T.StructField("random", T.LongType()), T.StructField("ordinary", T.LongType())])

    def run(batches):
        total = np.zeros((2, len(ALPHABET) + 1, len(ALPHABET)))
        for batch in batches:
            for _, part in text_slices(batch, "text"):
                found = [labelled_tokens(t) for t in part]
                for k in (0, 1):
                    total[k] += _bigrams([x for f in found for x in f[k]])
        a, b = np.nonzero(total.sum(axis=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)),
             pa.array(total[0][a, b].astype(np.int64)), pa.array(total[1][a, b].astype(np.int64))],
            names=schema.names)

    counts = distinct_sample(texts, "text", sample_docs).select("text").mapInArrow(giving_back(run), schema) \
                  .groupBy("previous", "next").agg(F.sum("random"), F.sum("ordinary")).collect()  # one row a bigram
    table = np.zeros((2, len(ALPHABET) + 1, len(ALPHABET)))
    for a, b, random, ordinary in counts:
        table[:, a, b] = random, ordinary
    return fit(table[0], table[1])


def spans_of(text: str | None, model: MarkovRatio) -> list[Span]:
    """All spans of one text: those of the rules, and tokens clear of them
    that the models find random."""
    if not text:
        return []
    spans = base_spans(text)
    covered = Covered(spans)
    more = [(m.start(), m.end(), "markov") for m in TOKEN.finditer(text)
            if covered.clear(m.start(), m.end()) and model.is_random(m[0])]
    return sorted(spans + more, key=lambda s: (s[0], KINDS.index(s[2])))


def scan(docs: DataFrame, model: MarkovRatio, text_col: str = "text", spans_col: str = "spans",
         redact: str | None = None) -> DataFrame:
    """``docs`` with its secrets as ``spans``: array of (start, end, kind),
    code points, end exclusive, by start and then kind.

    With ``redact`` the text itself comes back with each span replaced (spans
    that touch or overlap become one).  A null or empty text has no spans and
    stays as it is.  An existing column of the result's name is replaced;
    every other column passes through unchanged.
    """
    kept = [c for c in docs.columns if c != spans_col]
    src = docs.select(*[F.col(f"`{c}`") for c in kept])
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
                         T.StructField("kind", T.StringType())])
    schema = T.StructType([*src.schema.fields, T.StructField(spans_col, T.ArrayType(span))])
    arrow = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
    at = kept.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one number a bigram

    def run(batches):
        for batch in batches:
            for part, texts in text_slices(batch, text_col):
                found = [spans_of(t, shared.value) for t in texts]
                columns = list(part.columns)
                if redact is not None:
                    columns[at] = pa.array([redacted(t, s, redact) for t, s in zip(texts, found)], pa.string())
                rows = [[{"start": a, "end": b, "kind": k} for a, b, k in s] for s in found]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(rows, arrow)], names=schema.names)

    return src.mapInArrow(giving_back(run), schema)


def redacted(text: str | None, spans: list[Span], mark: str) -> str | None:
    if not spans:
        return text
    out, at = [], 0
    for start, end, _ in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])
