"""Secret scans by grammar inference (operator 10).

Fixed rules find labelled credentials.  For each kind, and each alphabet in it, a prefix tree of
their character classes is folded into a probabilistic automaton: two states are merged where their outgoing frequencies are
statistically compatible, all the way down.  Every candidate string of every text is then scored by
how much likelier its format is under one of the automata than in ordinary text.
"""

import hashlib
import math
import re
from collections import Counter
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colpack.llm.common import drop_kept, lean, materialize

KINDS = ("assign", "access", "hex")
#: Kind of the spans that only the automata find.
FORMAT = "format"
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KEYWORDS = ("passw", "secret", "token", "api")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: Labelled credentials of a kind, and ordinary strings, that the automata are fitted on at most, and how much of the beginning of each.
SAMPLE, LONGEST = 2000, 200
#: Confidence of the compatibility test; candidates score at least SCORE nats a character.
ALPHA, SCORE = 0.05, 1.0
#: Probability kept for what a state has never emitted.
UNSEEN = 1e-4

#: Character classes and how many characters each has.
CLASSES = {"d": "0123456789", "h": "abcdef", "l": "ghijklmnopqrstuvwxyz", "H": "ABCDEF", "L": "GHIJKLMNOPQRSTUVWXYZ", "s": "+/_.=-"}
CLASS_OF = str.maketrans({c: k for k, v in CLASSES.items() for c in v})
EACH = {k: math.log(1 / len(v)) for k, v in CLASSES.items()}


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed rules' matches by start, then kind as listed."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if any(len(w) >= 32 for w in text.split()):
        found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def _mixed(s: str) -> bool:
    return any(map(str.isdigit, s)) and any(map(str.isalpha, s))


def candidates(text: str) -> list[tuple[int, int]]:
    """Spans of all strings of 16 or more credential characters with a letter and a digit."""
    if not any(len(w) >= 16 and _mixed(w) for w in text.split()):
        return []
    return [m.span() for m in CANDIDATE.finditer(text) if _mixed(m.group())]


class Automaton:
    """A probabilistic automaton over character classes, merged from a prefix tree."""

    def __init__(self, strings: list[str], alpha: float = ALPHA):
        self.next: list[dict[str, int]] = [{}]
        self.count: list[dict[str, int]] = [{}]  # by symbol; "" is the end
        for s in strings:
            at = 0
            for c in s.translate(CLASS_OF):
                self.count[at][c] = self.count[at].get(c, 0) + 1
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.count.append({})
                at = self.next[at][c]
            self.count[at][""] = self.count[at].get("", 0) + 1
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge()

    def _differ(self, a: int, b: int) -> bool:
        """Whether the frequencies at two states differ by more than Hoeffding's bound allows."""
        m, n = sum(self.count[a].values()), sum(self.count[b].values())
        if not m or not n:
            return False
        most = self.bound * (1 / math.sqrt(m) + 1 / math.sqrt(n))
        return any(abs(self.count[a].get(c, 0) / m - self.count[b].get(c, 0) / n) > most for c in {*self.count[a], *self.count[b]})

    def _compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            if self._differ(a, b):
                return False
            todo += [(self.next[a][c], self.next[b][c]) for c in self.next[a].keys() & self.next[b].keys()]
        return True

    def _fold(self, a: int, b: int) -> None:
        """Add the tree below b to the state a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            for c, n in self.count[b].items():
                self.count[a][c] = self.count[a].get(c, 0) + n
            for c, t in self.next[b].items():
                if c in self.next[a]:
                    todo.append((self.next[a][c], t))
                else:
                    self.next[a][c] = t

    def _merge(self) -> None:
        """States are settled in the order of their first prefix: merged into a settled one, or settled."""
        settled, fringe = [0], [(0, c) for c in sorted(self.next[0])]
        while fringe:
            a, c = fringe.pop(0)
            b = self.next[a][c]
            if b in settled:
                continue
            into = next((s for s in settled if self._compatible(s, b)), None)
            if into is None:
                settled.append(b)
                fringe += [(b, d) for d in sorted(self.next[b])]
            else:
                self.next[a][c] = into
                self._fold(into, b)
                fringe = [(s, d) for s in settled for d in sorted(self.next[s]) if self.next[s][d] not in settled]
        self.states = settled
        self.log = {}
        for s in settled:
            total = sum(self.count[s].values())
            rest = math.log(UNSEEN)
            self.log[s] = {c: math.log(self.count[s].get(c, 0) / total) if self.count[s].get(c) else rest for c in (*CLASSES, "")} if total else dict.fromkeys((*CLASSES, ""), rest)

    def score(self, string: str) -> float:
        """Log likelihood of the string's characters; the end costs nothing, so lengths may differ."""
        at, total = 0, 0.0
        for c in string.translate(CLASS_OF):
            total += self.log[at][c] + EACH[c]
            at = self.next[at].get(c, at)
        return total


def alphabet(string: str) -> frozenset[str]:
    """The character classes of a string."""
    return frozenset(string.translate(CLASS_OF))


class Scorer:
    """Format likelihood against ordinary strings.

    Each kind has an automaton, and so has each alphabet within it, as one kind can hold several formats.
    Credentials without a label stand among the ordinary strings and must not vouch for their format: left
    out are those that an automaton explains better than random characters and whose alphabet is a larger
    part of the labelled strings than of the ordinary ones.  A format no rarer among ordinary strings than
    among labelled ones counts as ordinary.
    """

    def __init__(self, labelled: dict[str, list[str]], ordinary: list[str]):
        formats: dict[tuple, list[str]] = {}
        for kind, strings in labelled.items():
            for s in strings:
                formats.setdefault((kind,), []).append(s)
                formats.setdefault((kind, alphabet(s)), []).append(s)
        self.automata = {f: Automaton(strings) for f, strings in formats.items()}
        self.flat = -math.log(sum(map(len, CLASSES.values())))
        self.plain = None
        credentials, others = (Counter(map(alphabet, strings)) for strings in (chain(*labelled.values()), ordinary))
        m, n = credentials.total(), others.total()
        ordinary = [s for s in ordinary if credentials[alphabet(s)] * n <= others[alphabet(s)] * m or self(s) <= 0]
        self.plain = Automaton(ordinary) if ordinary else None

    def __call__(self, string: str) -> float:
        """Nats a character by which the best automaton beats ordinary text; -inf without automata."""
        if not self.automata:
            return -math.inf
        plain = max(self.flat * len(string), self.plain.score(string) if self.plain else -math.inf)
        return (max(a.score(string) for a in self.automata.values()) - plain) / len(string)


def found_spans(text: str, scorer: Scorer) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, all spans): the automata add candidates that overlap no base span."""
    base = base_spans(text)
    more = []
    for a, b in candidates(text):
        if not any(x < b and a < y for x, y, _ in base) and scorer(text[a:b]) >= SCORE:
            more.append((a, b, FORMAT))
    return base, sorted(base + more, key=lambda s: (s[0], (*KINDS, FORMAT).index(s[2])))


def fit_scorer(df: DataFrame, text_col: str = "text", sample: int = SAMPLE, longest: int = LONGEST) -> Scorer:
    """Automata from a bounded sample of the labelled credentials in df, of ordinary strings likewise.

    The fit reads the first longest characters of a string; strings are scored whole, however long.
    Of each kind the sample values of least hash are taken, over the whole table, so the choice does not
    depend on the order of rows.  At most sample strings of each kind reach the driver.
    """

    def run(batches):
        drop_kept()
        for batch in batches:
            kinds, values = [], []
            for text in batch.column(0).to_pylist():
                if not text:
                    continue
                base = base_spans(text)
                for a, b, kind in base:
                    kinds.append(kind)
                    values.append(ASSIGN.match(text, a).group(2) if kind == "assign" else text[a:b])
                for a, b in candidates(text):
                    if not any(x < b and a < y for x, y, _ in base):
                        kinds.append("ordinary")
                        values.append(text[a:b])
                for w in text.split():
                    if len(w) >= 16 and (m := CANDIDATE.match(w)) and not base_spans(w):
                        kinds.append("ordinary")
                        values.append(m.group())
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(values, pa.string())], ["kind", "value"])

    labelled = df.select(F.col(f"`{text_col}`").alias("__text")).mapInArrow(lean(run), "kind string, value string")
    strings: dict[str, list[str]] = {}
    rows = materialize(labelled.select("kind", F.substring("value", 1, longest).alias("value")).distinct(), "credentials")
    for kind in (*KINDS, "ordinary"):
        strings[kind] = [r["value"] for r in rows.where(F.col("kind") == kind).orderBy(F.xxhash64("value"), "value").limit(sample).collect()]
    return Scorer({k: strings[k] for k in KINDS}, strings["ordinary"])


def _digest(spans) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans) of every row of df.

    A null or empty text has no span.  Repeated rows and null ids stay rows of their own; other columns
    are not read; in a table without labelled credentials the automata add nothing.
    """
    scorer = fit_scorer(df, text_col, sample)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        drop_kept()
        for batch in batches:
            counts, base_digest, spans = ([], [], []), [], []
            for text in batch.column(1).to_pylist():
                base, every = found_spans(text or "", scorer)
                for column, k in zip(counts, KINDS):
                    column.append(sum(s[2] == k for s in base))
                base_digest.append(hashlib.sha256(_digest(base).encode()).hexdigest())
                spans.append(_digest(every))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(base_digest, pa.string()), pa.array(spans, pa.string())], [id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return df.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").alias("__text")).mapInArrow(lean(run), f"`{id_col}` {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")


def mask(text: str, spans, word: str = "[SECRET]") -> str:
    """The text with every span, overlapping ones joined, replaced by word."""
    out, at = [], 0
    for a, b, _ in sorted(spans):
        if a >= at:
            out += [text[at:a], word]
        at = max(at, b)
    return "".join(out) + text[at:]


def redact(df: DataFrame, text_col: str = "text", chars_col: str = "n_chars", sample: int = SAMPLE) -> DataFrame:
    """df with secrets in its texts replaced by [SECRET], and chars_col, if there, set to the new length."""
    scorer = fit_scorer(df, text_col, sample)
    at = df.columns.index(text_col)
    chars = df.columns.index(chars_col) if chars_col in df.columns else None

    def run(batches):
        drop_kept()
        for batch in batches:
            columns = list(batch.columns)
            texts = [t and mask(t, found_spans(t, scorer)[1]) for t in columns[at].to_pylist()]
            if chars is not None:
                old = columns[at].to_pylist()
                lengths = [n if new == was else len(new) for n, was, new in zip(columns[chars].to_pylist(), old, texts)]
                columns[chars] = pa.array(lengths, columns[chars].type)
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return df.mapInArrow(lean(run), df.schema)
