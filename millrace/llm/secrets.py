"""Secret scans: fixed patterns plus two character Markov models compared by log-likelihood ratio.

One model is trained on random strings, the other on ordinary identifiers (labelled samples).  Each side is a mixture: a model for each kind of
characters that its samples use, and one for all.  A token of an unbroken secret alphabet is a secret when random strings explain it better
than ordinary ones by a margin, and by nothing else.
Row-local: no shuffle at all, memory of one text per worker.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import text_or_empty

KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Shortest token that the models judge: below it random strings and words overlap (see the README for figures).
MIN_CHARS = 20
#: Log-likelihood ratio from which a token is a secret: on held-out samples no identifier and no prose word reaches it.
MARGIN = 24.0
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"

#: Words from which ordinary identifiers are put together for training.
IDENTIFIER_WORDS = (
    "get set user name file path index value count list map key data node tree parse load save read write open close "
    "start stop init config option default error handler request response server client socket buffer stream string "
    "number array object class method function module package import export test mock build deploy release version "
    "update delete insert select query table column row field schema model view controller service factory manager "
    "provider context session cache store state event listener callback promise thread worker queue stack message "
    "channel topic group member account order payment invoice product customer address street country language "
    "image video audio document page section header footer article comment category status result report summary "
    "average maximum minimum total window frame screen button label input output format encode decode convert "
    "transform filter reduce sort merge split join search find replace match pattern token lexer international "
    "environment development production application information organization administration representation"
).split()


#: Parts of words of several languages, from which long ordinary words are put together for training.
WORD_PARTS = (
    "ver sicher ung schaft keit heit lich haft kraft fahr zeug pflicht arbeit geber nehmer gesell amt rechts schutz bund straf buch wirt haupt "
    "mann wort zahl gegen stand zwischen bau werk stell leit ungs mente cion dad ment tion able isme aire eur ista ador anti contra inter super "
    "trans pre des constitu administr naci responsab gouverne electro encefalo grafi wyswietl anie uzytk ownik owie ski prze nie czy szcz rodz owa "
    "pol przy wiel zapis llan pwll gwyn gyll goger chwyrn drob trefn iaeth ll ddwy jarvi nen kku tta vaara lentokone suihku turbiini apu meka nikko "
    "over heid aanspra kelijk waar digheid onder zoek bestuurs uitvoer samen stelling ing ness less ship ful counter"
).split()


def _ordinary(k: int, rng: random.Random) -> str:
    """The ``k``-th kind of ordinary string: names in several styles, long words, paths, rules, runs, repeated patterns, dates and counters."""
    words = [rng.choice(IDENTIFIER_WORDS) for _ in range(rng.randint(2, 7))]
    word = lambda: "".join(rng.choice(WORD_PARTS) for _ in range(rng.randint(3, 8)))
    name = ("_".join(words), "-".join(words), "".join(w.title() for w in words), "_".join(words).upper(), "/".join(words),
            words[0] + "".join(w.title() for w in words[1:]))
    if k % 12 < 6:
        return name[k % 12] + (f"{rng.choice('_-')}{rng.randint(0, 2030)}" if rng.random() < 0.3 else "")
    if k % 12 < 9:
        text = (word(), word().capitalize(), rng.choice("/-").join(word() for _ in range(rng.randint(2, 4))))[k % 12 - 6]
        return text.upper() if rng.random() < 0.1 else text
    if k % 12 == 9:
        return rng.choice(ALPHABET) * rng.randint(20, 80)
    if k % 12 == 10:
        unit = "".join(rng.choice("-_=+/" if rng.random() < 0.5 else rng.choice(words)) for _ in range(rng.randint(2, 4)))
        return unit * rng.randint(8, 20)
    date = f"{rng.randint(1990, 2035)}{rng.randint(1, 12):02d}{rng.randint(1, 28):02d}"
    return rng.choice([date + f"{rng.randint(0, 23):02d}{rng.randint(0, 59):02d}{rng.randint(0, 59):02d}000000", f"{rng.randint(0, 99999):024d}",
                       "1234567890" * 3, f"{date[:4]}-{date[4:6]}-{date[6:]}/{rng.randint(1, 999):08d}"])


def labelled_samples(n: int = 4000, seed: int = 7) -> list[tuple[str, int]]:
    """``n`` random strings (label 1) and ``n`` ordinary ones (label 0), the same for the same seed."""
    rng, out = random.Random(seed), []
    alphabets = [ALPHABET[:62], ALPHABET[:62] + "+/", ALPHABET[:62] + "_-", "0123456789abcdef",
                 "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", ALPHABET[26:62]]
    for k in range(n):
        letters = alphabets[k % len(alphabets)]
        out.append(("".join(rng.choice(letters) for _ in range(rng.randint(20, 64))), 1))
        out.append((_ordinary(k, rng), 0))
    return out


CODES = np.full(256, len(ALPHABET), np.int64)
CODES[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))


def codes(text: str) -> np.ndarray:
    """The characters' states, after the state of the beginning; characters outside ALPHABET share one."""
    return np.concatenate([[len(ALPHABET) + 1], CODES[np.frombuffer(text.encode("latin-1", "replace"), np.uint8)]])


class MarkovModel:
    """First-order character model over ALPHABET; transitions are smoothed by ``weight`` draws of the characters' own frequencies (plus ``k``)."""

    def __init__(self, texts: Iterable[str], weight: float = 4.0, k: float = 0.5):
        n = len(ALPHABET) + 2
        counts = np.zeros((n, n - 1))
        for t in texts:
            c = codes(t)
            np.add.at(counts, (c[:-1], c[1:]), 1)
        single = (counts.sum(0) + k) / (counts.sum() + k * (n - 1))
        self.logp = np.log((counts + weight * single) / (counts.sum(1, keepdims=True) + weight))

    def score(self, text: str) -> float:
        """Log probability of the text."""
        c = codes(text)
        return float(self.logp[c[:-1], c[1:]].sum())


def character_classes(text: str) -> tuple[bool, ...]:
    """Which kinds of characters occur: a-f, g-z, A-F, G-Z, digits, others."""
    return tuple(re.search(p, text) is not None for p in ("[a-f]", "[g-z]", "[A-F]", "[G-Z]", "[0-9]", "[^A-Za-z0-9]"))


class MarkovMixture:
    """Markov models of the samples by their kinds of characters, and one of all of them, each weighted by its share of the samples.

    Kinds with under ``least`` of the samples are in the common one only.
    """

    def __init__(self, texts: Iterable[str], least: float = 0.02):
        groups: dict[tuple, list[str]] = {}
        texts = list(texts)
        for t in texts:
            groups.setdefault(character_classes(t), []).append(t)
        large = [g for g in groups.values() if len(g) >= least * len(texts)]
        total = len(texts) + sum(map(len, large))
        self.parts = [(math.log(max(len(g), 1) / max(total, 1)), MarkovModel(g)) for g in [texts, *large]]

    def score(self, text: str) -> float:
        return float(np.logaddexp.reduce([w + m.score(text) for w, m in self.parts]))


def repeated_unit(text: str, longest: int = 64) -> str | None:
    """The shortest unit of at most ``longest`` characters that makes up the text three times or more (the last time perhaps cut), or None."""
    return next((text[:p] for p in range(1, min(longest, len(text) // 3) + 1) if text[p:] == text[:-p]), None)


class SecretModel:
    """The pair of mixtures; ``ratio`` is log P(random) - log P(ordinary).  A repeated unit is as ordinary as one copy of it is."""

    def __init__(self, samples: Iterable[tuple[str, int]], margin: float = MARGIN):
        samples = [(t or "", int(y or 0)) for t, y in samples]
        self.random = MarkovMixture(t for t, y in samples if y)
        self.ordinary = MarkovMixture(t for t, y in samples if not y)
        self.margin = margin

    def ratio(self, text: str) -> float:
        unit = repeated_unit(text)
        copied = -math.inf if unit is None else self.ordinary.score(unit) - math.log(len(text))
        return self.random.score(text) - max(self.ordinary.score(text), copied)

    def is_secret(self, text: str) -> bool:
        return self.ratio(text) > self.margin


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans of the fixed patterns (start, end, kind) in code points, ordered by start, then kind as listed."""
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def tokens(min_chars: int) -> re.Pattern:
    """Unbroken runs of the secret alphabet of ``min_chars`` characters or more."""
    return re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}" % min_chars)


def model_spans(text: str, model: SecretModel, base: list[tuple[int, int, str]], min_chars: int = MIN_CHARS) -> list[tuple[int, int, str]]:
    """Spans that the likelihood ratio adds; tokens that touch a base span are not reported again."""
    out, at, covered = [], 0, 0  # base spans are ordered by start: those before ``at`` begin before the token ends
    for m in tokens(min_chars).finditer(text):
        s, e = m.span()
        while at < len(base) and base[at][0] < e:
            covered = max(covered, base[at][1])
            at += 1
        if covered <= s and model.is_secret(m.group()):
            out.append((s, e, "markov"))
    return out


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{s}:{e}" for s, e, kind in spans)


FOUND = "doc_id long, n_assign long, n_access long, n_hex long, n_markov long, base_sha256 string, spans array<struct<kind:string,start:int,end:int>>"


def scan_secrets(docs: DataFrame, samples: Iterable[tuple[str, int]] | None = None, margin: float = MARGIN, min_chars: int = MIN_CHARS,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_assign, n_access, n_hex, n_markov, base_sha256 (digest of the spans of the fixed
    patterns), spans (list of kind, start, end).

    Whole texts; null counts as empty and has no spans.  ``samples``: labelled strings (1 random, 0 ordinary);
    by default the generated ones.  Repeated rows give repeated results; other columns are ignored.
    """
    pairs = list(samples) if samples is not None else labelled_samples()

    def scan(batches):
        model = SecretModel(pairs, margin)
        for batch in batches:
            counts, digests, spans = [[], [], [], []], [], []
            for text in batch.column(1).to_pylist():
                base = base_spans(text)
                found = sorted(base + model_spans(text, model, base, min_chars), key=lambda s: (s[0], KINDS.index(s[2])))
                kinds = [k for _, _, k in found]
                for out, kind in zip(counts, KINDS):
                    out.append(kinds.count(kind))
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append([{"kind": k, "start": s, "end": e} for s, e, k in found])
            kind_t = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(digests, pa.string()), pa.array(spans, pa.list_(kind_t))],
                names=["doc_id", "n_assign", "n_access", "n_hex", "n_markov", "base_sha256", "spans"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return src.mapInArrow(scan, FOUND)


def precision_and_recall(model: SecretModel, held_out: list[tuple[str, int]]) -> tuple[float, float]:
    """Of labelled strings: the share of secrets among those called so, and the share of secrets that are called so."""
    called = [y for t, y in held_out if model.is_secret(t)]
    secrets = sum(y for _, y in held_out)
    return sum(called) / max(len(called), 1), sum(called) / max(secrets, 1)


def brute_force(text: str) -> str:
    """The base spans' digest by plain scanning with the patterns as they are stated (for tests)."""
    out = []
    for kind, pattern, keep in (
            ("assign", ASSIGN.pattern, lambda m: len(m.group(2)) >= 6),
            ("access", r"AKIA[A-Z0-9]+", lambda m: len(m.group()) >= 20),
            ("hex", r"[0-9a-f]+", lambda m: len(m.group()) >= 24)):
        flags = re.I | re.A if kind == "assign" else 0
        out += [(m.start(), KINDS.index(kind), m.end(), kind) for m in re.finditer(pattern, text, flags) if keep(m)]
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(out)).encode()).hexdigest()
