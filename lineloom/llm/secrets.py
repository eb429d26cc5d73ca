"""Secrets: fixed formats by pattern, and further credentials by the likelihood of inferred automata.

Grammar inference works on labelled credentials: the values that the fixed formats found, a bounded sample by hash
order. Their strings of character classes make a prefix tree, whose statistically compatible states are merged
(ALERGIA: Hoeffding bounds on end and transition frequencies) into a probabilistic automaton. A second automaton
is learned in the same way from ordinary strings: long words and numbers, which mix no letters with digits. Neither is learned from
the candidates. Every candidate of every text, those of the fixed formats included, is scored by the difference of the
two log likelihoods per character. The threshold is what most of the credentials held back from the fit reach and hardly any ordinary string held back
does; other candidates from it on become spans of kind ``format``, and spans of the fixed formats below it are counted as unlikely.
"""

from __future__ import annotations

import math
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lineloom.llm.common import per_batch, stored

#: Kinds in the order that breaks ties between spans of one start.
KINDS = ("assign", "access", "hex", "format")
_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
#: High-recall candidates: long runs of key characters with a digit; see ``candidates``.
_LONG = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
#: Ordinary strings: words, also joined ones, and numbers.
_ORDINARY = re.compile(r"(?<![A-Za-z0-9+/_=-])(?:[A-Za-z]+(?:[/_-][A-Za-z]+)*|[0-9]+)(?![A-Za-z0-9+/_=-])")
_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

Span = tuple[int, int, int, int, int]  # start, end, kind, start and end of the value


def base_spans(text: str, raw: bytes | None = None) -> list[Span]:
    """Spans of the fixed formats, leftmost and non-overlapping within a kind, by start and then kind."""
    low, out = (text.encode("utf-8", "surrogatepass") if raw is None else raw).lower(), []
    if any(w in low for w in _WORDS):
        out += [(*m.span(), 0, *m.span(1)) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
    if b"akia" in low:
        out += [(*m.span(), 1, *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(*m.span(), 2, *m.span()) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], s[2]))


def candidates(text: str, base: list[Span]) -> list[tuple[int, int]]:
    """Long runs of key characters with a digit that no base span touches."""
    out, at = [], 0
    ends = sorted((s[0], s[1]) for s in base)
    for m in _LONG.finditer(text):
        while at < len(ends) and ends[at][1] <= m.start():
            at += 1
        if not (at < len(ends) and ends[at][0] < m.end()) and re.search("[0-9]", m[0]):
            out.append(m.span())
    return out


def ordinary(text: str, base: list[Span], least: int = 8, most: int = 4) -> list[str]:
    """Of a text's words, and of its numbers, the ``most`` lowest by hash that have ``least`` characters or more and that no base span touches."""
    found, at = {True: {}, False: {}}, 0
    ends = sorted((s[0], s[1]) for s in base)
    for m in _ORDINARY.finditer(text):
        if m.end() - m.start() < least:
            continue
        while at < len(ends) and ends[at][1] <= m.start():
            at += 1
        if not (at < len(ends) and ends[at][0] < m.end()):
            found[m[0][0].isdigit()][m[0]] = zlib.crc32(m[0].encode())
    return [v for kind in (False, True) for v in sorted(found[kind], key=lambda v, of=found[kind]: (of[v], v))[:most]]


_CLASS = {**{c: "d" for c in "0123456789"}, **{c: "h" for c in "abcdef"}, **{c: "l" for c in "ghijklmnopqrstuvwxyz"}, **{c: "H" for c in "ABCDEF"}, **{c: "U" for c in "GHIJKLMNOPQRSTUVWXYZ"}}


def shape(value: str) -> str:
    """Character classes of a string: digit, hex letter, other letter (by case); other characters stand for themselves."""
    return "".join([_CLASS.get(c, c) for c in value])


class Automaton:
    """A deterministic probabilistic automaton inferred from strings by merging compatible prefix-tree states."""

    def __init__(self, strings: list[str], alpha: float = 0.05) -> None:
        self.ended, self.next, self.flow = [0], [{}], [{}]  # per state: strings that end there; target and count by character
        for s in sorted(strings):
            at = 0
            for c in s:
                if c not in self.next[at]:
                    self.next[at][c], self.flow[at][c] = len(self.ended), 0
                    self.ended.append(0)
                    self.next.append({})
                    self.flow.append({})
                self.flow[at][c] += 1
                at = self.next[at][c]
            self.ended[at] += 1
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self.arcs: dict[int, tuple[dict[str, tuple[int, float]], float, float]] = {}
        for r in self._merged():
            rest = self._total(r) + 1.0  # half a count each for an end and for a character that was not seen here
            self.arcs[r] = ({c: (t, math.log(self.flow[r][c] / rest)) for c, t in self.next[r].items()}, math.log((self.ended[r] + 0.5) / rest), math.log(0.5 / rest / 64))
        del self.ended, self.next, self.flow

    def _total(self, state: int) -> int:
        return self.ended[state] + sum(self.flow[state].values())

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return n1 > 0 and n2 > 0 and abs(f1 / n1 - f2 / n2) > self.bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def _compatible(self, red: int, blue: int) -> bool:
        todo = [(red, blue)]
        while todo:
            a, b = todo.pop()
            na, nb = self._total(a), self._total(b)
            if self._differ(self.ended[a], na, self.ended[b], nb):
                return False
            for c in self.next[a].keys() | self.next[b].keys():
                if self._differ(self.flow[a].get(c, 0), na, self.flow[b].get(c, 0), nb):
                    return False
                if c in self.next[a] and c in self.next[b]:
                    todo.append((self.next[a][c], self.next[b][c]))
        return True

    def _fold(self, red: int, blue: int) -> None:
        """Adds the tree at ``blue`` to the automaton at ``red``."""
        todo = [(red, blue)]
        while todo:
            a, b = todo.pop()
            self.ended[a] += self.ended[b]
            for c, y in self.next[b].items():
                self.flow[a][c] = self.flow[a].get(c, 0) + self.flow[b][c]
                if c in self.next[a]:
                    todo.append((self.next[a][c], y))
                else:
                    self.next[a][c] = y

    def _merged(self) -> list[int]:
        """Merges until every state left is told apart from the others; what hangs below a blue state is a tree until then."""
        red = [0]
        while blue := next(((r, c, t) for r in red for c, t in sorted(self.next[r].items()) if t not in red), None):
            parent, c, state = blue
            like = next((r for r in red if self._compatible(r, state)), None)
            if like is None:
                red.append(state)
            else:
                self.next[parent][c] = like
                self._fold(like, state)
        return red

    def log_likelihood(self, s: str) -> float:
        at, out = 0, 0.0
        for c in s:
            arcs, _, unseen = self.arcs[at]
            to = arcs.get(c)
            if to is None:
                out += unseen
                at = 0
            else:
                out += to[1]
                at = to[0]
        return out + self.arcs[at][1]


def score(good: Automaton, other: Automaton, value: str) -> float:
    s = shape(value)
    return (good.log_likelihood(s) - other.log_likelihood(s)) / (len(s) + 1)


def learn(credentials: list[str], others: list[str], kept_recall: float = 0.95, false_rate: float = 0.01) -> tuple[Automaton, Automaton, float]:
    """Both automata and the threshold, from the quarter of either kind that is held back from the fit.

    It is the score that ``kept_recall`` of the credentials reach, or if more that which at most ``false_rate`` of the ordinary strings reach, or 0.
    """
    part = lambda x: (x[::4], [v for i, v in enumerate(x) if i % 4] or x)
    (held, fit), (held_others, fit_others) = part(credentials), part(others)
    good, other = Automaton([shape(c) for c in fit]), Automaton([shape(c) for c in fit_others])
    scores = sorted(score(good, other, c) for c in held)
    if not scores:
        return good, other, math.inf
    false = sorted(score(good, other, c) for c in held_others)
    above = math.nextafter(false[-1 - int(false_rate * len(false))], math.inf) if false else 0.0
    return good, other, max(0.0, above, scores[int((1 - kept_recall) * len(scores))])


_FOUND = "doc_id bigint, base array<struct<s:int,e:int,k:int,v:string>>, more array<struct<s:int,e:int,k:int,v:string>>, ordinary array<string>"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, more, ordinary): base spans and unmatched candidates of each text with their strings, and some ordinary strings."""
    kind = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32()), ("k", pa.int32()), ("v", pa.string())]))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        base, more, plain = [], [], []
        for t in batch.column(1):
            text = t.as_py() or ""
            spans = base_spans(text)
            base.append([{"s": s, "e": e, "k": k, "v": text[vs:ve]} for s, e, k, vs, ve in spans])
            more.append([{"s": s, "e": e, "k": 3, "v": text[s:e]} for s, e in candidates(text, spans)])
            plain.append(ordinary(text, spans))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, kind), pa.array(more, kind), pa.array(plain, pa.list_(pa.string()))], ["doc_id", "base", "more", "ordinary"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(per_batch(run), _FOUND)


def _sample(values: DataFrame, rows: int, chars: int) -> list[str]:
    """Distinct strings ``v``, the first by hash: at most ``rows`` of them and ``chars`` characters in all. The same in each run."""
    first = values.distinct().where(F.length("v") <= chars).orderBy(F.xxhash64("v"), "v").limit(rows)
    size = F.sum(F.length("v")).over(Window.partitionBy(F.lit(0)).orderBy(F.xxhash64("v"), "v"))  # of at most ``rows`` rows
    return [r.v for r in first.withColumn("_size", size).where(F.col("_size") <= chars).orderBy(F.xxhash64("v"), "v").collect()]


def train(found: DataFrame, sample_rows: int = 600, sample_chars: int = 200_000) -> tuple[Automaton, Automaton, float] | None:
    """The automata and their threshold from a scan; None without credentials. See ``find``."""
    credentials = _sample(found.select(F.explode("base").alias("x")).select(F.col("x.v").alias("v")), sample_rows, sample_chars)
    if not credentials:
        return None
    plain = found.select(F.explode("ordinary").alias("v"))
    others = [v for digits in (False, True) for v in _sample(plain.where(F.col("v").rlike("^[0-9]") == digits), sample_rows, sample_chars)]
    return learn(credentials, sorted(others, key=lambda v: zlib.crc32(v.encode())))


def find(docs: DataFrame, sample_rows: int = 600, sample_chars: int = 200_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, base and more (arrays of spans with start, end, kind and string), n_unlikely.

    ``base`` has the fixed formats, ``more`` the candidates that the automata accept, ``n_unlikely`` counts base spans that score below the threshold. Null texts count as empty and
    have no spans; ids may be null or repeat, each row is judged on its own; an empty table gives an empty result.
    ``sample_rows`` and ``sample_chars`` bound the labelled credentials, and likewise the words and the numbers, that the automata are fitted on.
    Without any credential in the table nothing is added.
    """
    found = stored(scan(docs, id_col, text_col), "secrets")
    model = train(found, sample_rows, sample_chars)
    found = found.drop("ordinary")
    if model is None:
        return found.select("doc_id", "base", F.filter("more", lambda x: F.lit(False)).alias("more"), F.lit(0).cast("bigint").alias("n_unlikely"))
    sent = found.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        good, other, least = sent.value
        likely = lambda x: score(good, other, x["v"]) >= least
        more = [[x for x in row.as_py() or () if likely(x)] for row in batch.column(2)]
        unlikely = [sum(not likely(x) for x in row.as_py() or ()) for row in batch.column(1)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(more, batch.schema.field(2).type), pa.array(unlikely, pa.int64())], ["doc_id", "base", "more", "n_unlikely"])

    some = (F.size("base") > 0) | (F.size("more") > 0)
    scored = found.where(some).mapInArrow(per_batch(run), _FOUND.replace("ordinary array<string>", "n_unlikely bigint"))
    return found.where(~some).withColumn("n_unlikely", F.lit(0).cast("bigint")).unionByName(scored)


def digest(found: DataFrame) -> DataFrame:
    """The columns that the query returns: counts and a hash of the base spans, and all spans as a string."""
    name = F.array(*[F.lit(k) for k in KINDS])
    order = lambda a, b: F.when(a.s != b.s, F.when(a.s < b.s, -1).otherwise(1)).when(a.k != b.k, F.when(a.k < b.k, -1).otherwise(1)).otherwise(0)
    said = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(name, x.k), x.s.cast("string"), x.e.cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda x: x.k == k)).cast("bigint")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{KINDS[k]}") for k in range(3)],
        F.sha2(said(F.col("base")), 256).alias("base_sha256"),
        said(F.array_sort(F.concat("base", "more"), order)).alias("spans"),
        F.size("more").cast("bigint").alias("n_format"),
        "n_unlikely",
    )


def redact(text: str, spans: list[tuple[int, int]], mark: str = "[SECRET]") -> str:
    """``text`` with each maximal run of spans replaced by ``mark``."""
    out, at = [], 0
    for s, e in sorted(spans):
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])

