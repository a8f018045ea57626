"""Secret scans by grammar inference.

Labelled credentials become a prefix-tree acceptor per format; statistically compatible states are merged
(ALERGIA: Hoeffding bound on the outgoing frequencies, red-blue order), which leaves one probabilistic automaton
per format. Every candidate (run of ``LEAST`` credential characters or more, of any length, letters or digits alone
included, and its parts at separators and at known starts) is scored by the log-likelihood ratio of its best format
against a background model of ordinary tokens, and spans above the threshold are reported under ``grammar``. Callers
pass labelled credentials and ordinary tokens of their own to ``fit_grammar``; those of ``labelled_samples`` are the default.
Three plain formats (``assign``, ``access``, ``hex``) are always reported; the automata add spans, never remove.

Cases: null or empty texts give no spans; repeated rows give repeated results; an empty table gives an empty one;
extra columns are ignored. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import math
import os
import random
import re
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import id_text, trim

KINDS = ("assign", "access", "hex", "grammar")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
LEAST = 16  # characters of the shortest candidate, or of the shortest labelled credential if that is less
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")

LOWER, UPPER, DIGIT = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: name -> (literal start, alphabet after it, shortest and longest length of the rest)
FORMATS = {
    "access_key": ("AKIA", UPPER + DIGIT, 16, 16),
    "code_host": ("ghp_", UPPER + LOWER + DIGIT, 36, 36),
    "chat_bot": ("xoxb-", DIGIT + "-" + LOWER, 24, 48),
    "payment": ("sk_live_", UPPER + LOWER + DIGIT, 24, 32),
    "cloud_api": ("AIza", UPPER + LOWER + DIGIT + "_-", 35, 35),
    "web_token": ("eyJ", UPPER + LOWER + DIGIT + "_-", 40, 90),
    "hex_key": ("", DIGIT + "abcdef", 32, 64),
    "base64_key": ("", UPPER + LOWER + DIGIT + "+/", 40, 44),
}
SEPARATORS = "=.-_/+"
SEPARATOR = re.compile("[=._/+-]")
#: Web tokens of one to three parts: an end for each group.
WEB_TOKEN = re.compile(r"eyJ[\w-]{13,}()(?:\.[\w-]+()(?:\.[\w-]+())?)?", re.A)
LONGEST = 128  # characters of parts between two separators, at most
HEAD = 4  # so many first characters stay literal symbols; later ones are read as character classes


def symbols(token: str) -> list[str]:
    return [c if i < HEAD else _kind(c) for i, c in enumerate(token)]


def _kind(c: str) -> str:
    if c.isdigit():
        return "d"
    if c.islower():
        return "h" if c <= "f" else "l"
    if c.isupper():
        return "H" if c <= "F" else "U"
    return c


def labelled_samples(per_format: int, seed: int = 7) -> tuple[dict[str, list[str]], list[str]]:
    """Labelled credentials by format, and ordinary tokens, made by rule."""
    rnd = random.Random(seed)
    good = {name: [start + "".join(rnd.choices(alphabet, k=rnd.randint(lo, hi))) for _ in range(per_format)] for name, (start, alphabet, lo, hi) in FORMATS.items()}
    parts = random.Random(seed + 1)
    segment = lambda lo, hi: "".join(parts.choices(UPPER + LOWER + DIGIT + "_-", k=parts.randint(lo, hi)))
    good["signed_token"] = [f"eyJ{segment(17, 90)}.eyJ{segment(17, 200)}.{segment(*parts.choice(((43, 43), (86, 86), (342, 342))))}" for _ in range(per_format)]
    syllables = ["th", "er", "on", "an", "re", "ing", "ed", "es", "ou", "ver", "sch", "ció", "ment", "able", "ly"]
    plain = []
    for i in range(per_format * 4):
        word = "".join(rnd.choices(syllables, k=rnd.randint(6, 12))).replace("ó", "o")
        plain.append((word, word.capitalize(), "".join(rnd.choices(DIGIT, k=rnd.randint(16, 20))), f"{word[:8]}-{word[8:]}.{rnd.randint(1, 2030)}", f"{word[:6]}_{word[6:]}/{word[:5]}{rnd.randint(1, 99)}")[i % 5])
    return good, plain


class Automaton:
    """Counts of arrivals, ends and moves of every state; ``fit`` merges compatible states of the prefix tree."""

    def __init__(self) -> None:
        self.total, self.final, self.moves = [0], [0], [{}]

    def add(self, syms: list[str]) -> None:
        s = 0
        self.total[0] += 1
        for a in syms:
            if a not in self.moves[s]:
                self.moves[s][a] = [len(self.total), 0]
                self.total.append(0)
                self.final.append(0)
                self.moves.append({})
            self.moves[s][a][1] += 1
            s = self.moves[s][a][0]
            self.total[s] += 1
        self.final[s] += 1

    def _differ(self, f1: int, n1: int, f2: int, n2: int, alpha: float) -> bool:
        return abs(f1 / n1 - f2 / n2) > (1 / math.sqrt(n1) + 1 / math.sqrt(n2)) * math.sqrt(0.5 * math.log(2 / alpha))

    def _compatible(self, p: int, q: int, alpha: float) -> bool:
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            n1, n2 = self.total[p], self.total[q]
            if not n1 or not n2:
                continue
            if self._differ(self.final[p], n1, self.final[q], n2, alpha):
                return False
            for a in self.moves[p].keys() | self.moves[q].keys():
                x, y = self.moves[p].get(a, (0, 0)), self.moves[q].get(a, (0, 0))
                if self._differ(x[1], n1, y[1], n2, alpha):
                    return False
                if x[1] and y[1]:
                    todo.append((x[0], y[0]))
        return True

    def _fold(self, p: int, q: int) -> None:
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            if p == q:
                continue
            self.total[p] += self.total[q]
            self.final[p] += self.final[q]
            for a, (t, n) in self.moves[q].items():
                if a in self.moves[p]:
                    self.moves[p][a][1] += n
                    todo.append((self.moves[p][a][0], t))
                else:
                    self.moves[p][a] = [t, n]

    def fit(self, alpha: float) -> "Automaton":
        red = [0]
        while True:
            blue = sorted({(-self.total[t], t, s, a) for s in red for a, (t, _) in self.moves[s].items() if t not in red})
            if not blue:
                return self._reachable(red)
            _, q, s, a = blue[0]
            for p in red:
                if self._compatible(p, q, alpha):
                    self.moves[s][a][0] = p
                    self._fold(p, q)
                    break
            else:
                red.append(q)

    def _reachable(self, red: list[int]) -> "Automaton":
        new = {s: i for i, s in enumerate(red)}
        self.total, self.final = [self.total[s] for s in red], [self.final[s] for s in red]
        self.moves = [{a: (new[t], n) for a, (t, n) in self.moves[s].items()} for s in red]
        return self

    def log_likelihoods(self, syms: list[str], ends: list[int], floor: float = 1e-4) -> list[float]:
        """Of the first so many symbols, for each of the ascending ``ends``, in one walk."""
        s, out, at, found = 0, 0.0, 0, []
        for end in ends:
            while at < end and (move := self.moves[s].get(syms[at])):
                out += math.log(max(floor, move[1] / self.total[s]))
                s, at = move[0], at + 1
            if at < end:
                found.append(-math.inf if at < HEAD else out + (end - at) * math.log(floor))
            else:
                found.append(out + math.log(max(floor, self.final[s] / max(1, self.total[s]))))
        return found


@dataclass(frozen=True)
class Grammar:
    """Automata by format; the background's log-probabilities of literal and class symbols; and what candidates need:
    the least length, the literal starts of formats, patterns of those formats, and the formats without a start."""

    automata: dict[str, Automaton]
    head: dict[str, float]
    rest: dict[str, float]
    run: re.Pattern
    known: re.Pattern | None
    started: list[re.Pattern]
    plain: frozenset[str]
    least: int


def _alphabet(chars: str) -> str:
    """The characters, and those of their kinds: a letter beyond f stands for all of its case."""
    lower, upper = (set(chars) & set(kind) for kind in (LOWER, UPPER))
    full = lambda own, kind: kind if own - set(kind[:6]) else kind[:6] if own else ""
    return full(lower, LOWER) + full(upper, UPPER) + (DIGIT if set(chars) & set(DIGIT) else "") + "".join(sorted(set(chars) - set(LOWER + UPPER + DIGIT)))


def fit_grammar(labelled: dict[str, list[str]], ordinary: list[str], alpha: float = 0.05) -> Grammar:
    """The grammar of labelled credentials (two or more of each format) and of ordinary tokens. Each format's literal
    start, alphabet and lengths are taken from its credentials."""
    if any(len(set(tokens)) < 2 for tokens in labelled.values()):
        raise ValueError("a format needs two different labelled credentials")
    automata, starts, started = {}, [], []
    for name, tokens in labelled.items():
        a = Automaton()
        for t in tokens:
            a.add(symbols(t))
        automata[name] = a.fit(alpha)
        start = os.path.commonprefix(tokens)[:8]
        if len(start) >= 3:
            rests = [len(t) - len(start) for t in tokens]
            starts.append(start)
            started.append(re.compile(f"{re.escape(start)}(?=([{re.escape(_alphabet(''.join(t[len(start) :] for t in tokens)))}]{{{min(rests)},{max(rests)}}}))"))
    head, rest = Counter(), Counter()
    for t in ordinary:
        head.update(symbols(t)[:HEAD])
        rest.update(symbols(t)[HEAD:])
    logs = [{c: math.log((n + 1) / (sum(k.values()) + 70)) for c, n in k.items()} | {"": math.log(1 / (sum(k.values()) + 70))} for k in (head, rest)]
    least = min(LEAST, *(len(t) for ts in labelled.values() for t in ts))
    run = re.compile(rf"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{{{least},}}")
    known = re.compile("|".join(map(re.escape, sorted(set(starts), key=len, reverse=True)))) if starts else None
    return Grammar(automata, *logs, run, known, started, frozenset(n for n, ts in labelled.items() if len(os.path.commonprefix(ts)) < 3), least)


@lru_cache(maxsize=4)
def model(per_format: int = 150, alpha: float = 0.05, seed: int = 7) -> Grammar:
    """The grammar of ``labelled_samples``. ``per_format`` bounds the labelled sample that is fitted."""
    return fit_grammar(*labelled_samples(per_format, seed), alpha)


def scores(token: str, ends: list[int], fitted: Grammar) -> list[tuple[str, float]]:
    """Of the candidate up to each of the ascending ``ends``: the best format, and its log-likelihood ratio against the
    background per character."""
    automata, head, rest = fitted.automata, fitted.head, fitted.rest
    token = token[: ends[-1]]
    syms = symbols(token)
    usual = symbols(token.lower()) if token.isalpha() and token.isupper() else syms  # ordinary words also come in capitals
    back = list(accumulate((head if i < HEAD else rest).get(a, (head if i < HEAD else rest)[""]) for i, a in enumerate(usual)))
    best = [max(zip(found, automata), key=lambda x: x[0]) for found in zip(*(a.log_likelihoods(syms, ends) for a in automata.values()))]
    return [(name, (b - back[end - 1]) / end) for (b, name), end in zip(best, ends)]


def score(token: str, fitted: Grammar) -> tuple[str, float]:
    """The best format of a candidate, and its log-likelihood ratio against the background per character."""
    return scores(token, [len(token)], fitted)[0]


def credentials(token: str, fitted: Grammar, threshold: float) -> list[tuple[int, int, str, float]]:
    """(start, end, format, score) of the credentials of a run, which do not overlap: formats of a literal start come
    first, by their log-likelihood ratio as a whole, then the longest of the others.

    Candidates start at the run's start, behind a separator or at a format's literal start, and end before a separator
    or at the run's end; those of a format's literal start also end where its alphabet or greatest length does. They
    have ``LONGEST`` characters at most, but for the run, its parts between ``=``, its parts without
    separators, and web tokens, which have any length."""
    seps = [m.start() for m in SEPARATOR.finditer(token)]
    starts, stops = {0, *(i + 1 for i in seps)}, [*seps, len(token)]
    wanted: dict[int, set[int]] = {}
    for a in sorted({*starts, *(m.start() for m in (fitted.known.finditer(token) if fitted.known else ()))}):
        for z in stops[bisect_right(stops, a) :]:
            if z - a > LONGEST and (wanted.get(a) or a not in starts):
                break
            wanted.setdefault(a, set()).add(z)
    wanted.setdefault(0, set()).add(len(token))
    equals = [-1, *(i for i in seps if token[i] == "="), len(token)]
    for a, z in zip(equals, equals[1:]):
        wanted.setdefault(a + 1, set()).add(z)
    free = 0  # behind the run of letters and digits of the last web token: what starts within it is bounded
    for m in fitted.known.finditer(token) if fitted.known else ():
        a = m.start()
        ends = [z for rx in fitted.started if (found := rx.match(token, a)) for _, z in found.regs[1:]]
        if a >= free and (found := WEB_TOKEN.match(token, a)):
            ends, free = [*ends, *(z for _, z in found.regs[1:] if z > 0)], found.end(1)
        wanted.setdefault(a, set()).update(ends)
    found = []
    for a, ends in wanted.items():
        ends = sorted(z - a for z in ends if z - a >= fitted.least and token[z - 1] not in SEPARATORS)
        if ends and token[a] not in SEPARATORS:
            found += [(name in fitted.plain, -n if name in fitted.plain else -n * s, a, a + n, name, s) for n, (name, s) in zip(ends, scores(token[a : a + ends[-1]], ends, fitted)) if s >= threshold]
    used, out = bytearray(len(token)), []
    for _, _, a, z, name, s in sorted(found):
        if used.find(1, a, z) < 0:
            used[a:z] = b"\x01" * (z - a)
            out.append((a, z, name, s))
    return out


def scan_text(text: str, fitted: Grammar, threshold: float) -> list[tuple[str, int, int, str, float]]:
    """(kind, start, end, format, score) of one text by start, then kind."""
    out = []
    lowered = text.encode().lower()
    if any(w in lowered for w in ASSIGN_WORDS):
        out += [("assign", m.start(), m.end(), m[1].lower(), 0.0) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    for run in fitted.run.finditer(text):
        token, at = run[0], run.start()
        if "AKIA" in token:
            out += [("access", at + m.start(), at + m.end(), "", 0.0) for m in ACCESS.finditer(token) if len(m[0]) >= 18]
        out += [("hex", at + m.start(), at + m.end(), "", 0.0) for m in HEX.finditer(token) if len(m[0]) >= 16]
        if core := token.strip(SEPARATORS):
            start = at + token.index(core)
            out += [("grammar", start + a, start + z, name, s) for a, z, name, s in credentials(core, fitted, threshold)]
    return sorted(set(out), key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


SCHEMA = "doc_id long, spans array<struct<kind string, start int, end int, format string, score double>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("format", pa.string()), ("score", pa.float64())]))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, grammar: Grammar | None = None) -> DataFrame:
    """(doc_id, spans) of every row. One narrow scan: no shuffle, and memory of one Arrow batch."""
    fitted = grammar or model()

    def scan(batches):
        for b in batches:
            rows = [[dict(zip(("kind", "start", "end", "format", "score"), s)) for s in scan_text(t, fitted, threshold)] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, _SPANS)], ["doc_id", "spans"])

    return id_text(docs, id_col, text_col).mapInArrow(scan, SCHEMA)


def joined(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """The counts and digests of ``op2_secret_scan``."""
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(joined(F.filter("spans", lambda s: s["kind"] != "grammar")), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"), count("grammar").alias("n_grammar"),
    )


def redact(docs: DataFrame, threshold: float = 0.5, mark: str = "<SECRET>", grammar: Grammar | None = None) -> DataFrame:
    """The columns of ``docs`` with every found span of ``text`` replaced by ``mark``; n_chars follows the new text.
    Null texts stay null."""
    fitted, at = grammar or model(), docs.columns.index("text")

    def clean(text: str | None) -> str | None:
        if not text:
            return text
        out, end = [], 0
        for _, s, e, _, _ in scan_text(text, fitted, threshold):
            if s >= end:
                out += [text[end:s], mark]
            elif e <= end:
                continue
            end = max(end, e)
        return "".join([*out, text[end:]]) if out else text

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(map(clean, c.to_pylist()), c.type) if i == at else c for i, c in enumerate(b.columns)], names=b.schema.names)
        trim()

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
