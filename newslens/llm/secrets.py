"""Secret scans: three fixed patterns, and a character network over every other key-like string."""

from __future__ import annotations

import hashlib
import random
import re
import string
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newslens.llm.charcnn import CharCNN, Example
from newslens.llm.common import map_batches
from newslens.sources.tables import table

# The base patterns, in the order their kinds are listed.
KINDS = ("assign", "access", "hex", "model")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KEYWORDS = ("password", "passwd", "secret", "token", "api")

#: A candidate for the network: a stretch of key characters of at least ``LONG``, or of ``SHORT`` with a digit.
SHORT, LONG = 12, 16
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.-]{12,}")
BEFORE, BEHIND = 24, 8
#: Labelled findings that are generated, the share held out for calibration, and the recall to keep on it.
FINDINGS, HELD_OUT, RECALL = 12000, 0.25, 0.98
EPOCHS = 6
#: Characters of a generated candidate at most (with its surroundings it fits a row of the network).
MOST = 150
MASK = "[REDACTED]"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the patterns' matches, leftmost and non-overlapping within each kind. A match whose
    value is too short is dropped, together with the text it took."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[0], x[2]))


def _keyed(body: str) -> bool:
    """Is a stretch long enough to be a key: ``LONG`` characters, or ``SHORT`` with a digit?"""
    return len(body) >= SHORT and (len(body) >= LONG or any(c in string.digits for c in body))


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Spans of the key-like strings: the maximal runs of key characters that have a letter or digit outside the base
    spans, each followed by its stretches between base spans that are long enough themselves. Both lists are walked once."""
    out, first = [], 0
    for m in CANDIDATE.finditer(text):
        if not _keyed(m[0]):
            continue
        while first < len(taken) and taken[first][1] <= m.start():
            first += 1
        cuts, at, i = [], m.start(), first
        while i < len(taken) and taken[i][0] < m.end():
            s, e, _ = taken[i]
            if e > at:
                cuts.append((at, s))
                at = e
            i += 1
        cuts.append((at, m.end()))
        if len(cuts) == 1:
            out.append((m.start(), m.end()))
        elif any(c.isalnum() for s, e in cuts for c in text[s:e]):
            out.append((m.start(), m.end()))
            out += [(s, e) for s, e in cuts if _keyed(text[s:e])]
    return out


@lru_cache(maxsize=1)
def _vocabulary() -> list[str]:
    """Words of running text: those of the language manual that Python carries with it."""
    from pydoc_data.topics import topics

    return sorted({w.lower() for t in topics.values() for w in re.findall(r"[A-Za-z]{2,12}", t)})


def labelled_findings(n: int = FINDINGS, seed: int = 7) -> list[tuple[Example, int]]:
    """Labelled findings made by rule: keys of common formats and random strings of all alphabets and lengths in the
    contexts they leak in, against strings that only look alike (identifiers, slugs, paths, addresses, versions, dates,
    numbers, long words) made of dictionary words and of pronounceable ones."""
    r = random.Random(seed)
    digits, lower, upper = string.digits, string.ascii_lowercase, string.ascii_uppercase
    alnum, known = string.ascii_letters + digits, _vocabulary()

    def some(chars, a, b=None):
        return "".join(r.choice(chars) for _ in range(r.randint(a, b or a)))

    def word(least=1):
        """A dictionary word, or a made-up one of consonants and vowels."""
        while True:
            w = r.choice(known) if r.random() < 0.6 else "".join(
                some("bcdfghjklmnprstvwz", 0, 2) + some("aeiouäéy", 1) + some("nrstl", 0, 1) for _ in range(r.randint(1, 4)))
            if len(w) >= least:
                return "".join(c for c in w if c in lower)

    def words(k):
        return " ".join(word() for _ in range(k))

    def name(style, k):
        """An identifier of ``k`` words."""
        w = [word(2) for _ in range(k)]
        return {"snake": "_".join(w), "kebab": "-".join(w), "dotted": ".".join(w), "camel": w[0] + "".join(map(str.capitalize, w[1:])),
                "pascal": "".join(map(str.capitalize, w)), "const": "_".join(w).upper(), "joined": "".join(w)}[style]

    def number(a, b):
        return str(r.randint(a, b))

    def any_name():
        return name(r.choice(["snake", "kebab", "dotted", "camel", "pascal", "const", "joined"]), r.randint(2, 5))

    def uuid():
        h = some(digits + "abcdef", 32)
        return "-".join((h[:8], h[8:12], h[12:16], h[16:20], h[20:]))

    def path():
        return "/".join(r.choice([word(2), any_name(), number(1, 2030), some(digits, 2)]) for _ in range(r.randint(2, 6)))

    def host():
        return r.choice(["www.", "", f"{word(2)}."]) + word(3) + r.choice(["", "-" + word(2), word(2), number(1, 99)]) + \
            r.choice([".com", ".org", ".net", ".de", ".co.uk", ".io", ".example.org"])

    secret = (
        lambda: r.choice(["ghp_", "gho_", "npm_"]) + some(alnum, 36), lambda: r.choice(["sk-", "rk-", "pk-"]) + some(alnum, 20, 48),
        lambda: r.choice(["sk_live_", "rk_test_", "key-", "SG.", "pat_"]) + some(alnum, 16, 40),
        lambda: f"xoxb-{some(digits, 10, 12)}-{some(alnum, 24)}", lambda: "AIza" + some(alnum + "_-", 35),
        lambda: some(alnum + "+/", 20, 90) + r.choice(["", "=", "=="]), lambda: some(alnum, 16, 64), lambda: some(alnum, 16, 32),
        lambda: f"eyJ{some(alnum, 20, 30)}.eyJ{some(alnum, 20, 40)}.{some(alnum + '_-', 20, 43)}",
        lambda: "glpat-" + some(alnum + "_-", 20), lambda: "ASIA" + some(upper + digits, 16), lambda: some(upper + digits, 16, 40),
        lambda: some(digits + "ABCDEF", 24, 64), lambda: some(string.ascii_letters, 20, 48), lambda: some(string.ascii_letters, 32, 44),
        lambda: some(lower + digits, 16, 40), lambda: some(lower, 24, 44), lambda: some(upper, 24, 44), lambda: some(alnum, 12, 15),
        lambda: "-".join(some(upper + digits, 5) for _ in range(r.randint(4, 6))), lambda: some(alnum + "_-", 20, 44))
    harmless = (
        lambda: some(digits, 12, 24), lambda: some(digits, 16), lambda: f"{number(0, 999)}.{some(digits, 11, 24)}",
        any_name, any_name, any_name, lambda: any_name() + number(0, 2030), lambda: any_name() + r.choice("-_.") + number(0, 999),
        lambda: name(r.choice(["camel", "pascal"]), r.randint(2, 4)) + number(1, 99) + word(2).capitalize(), lambda: name("pascal", 3) + some(digits, 1, 4),
        lambda: name("kebab", r.randint(3, 8)) + "-" + number(1, 20300), uuid, uuid, lambda: uuid().upper(),
        lambda: name("snake", 3) + "_v" + number(0, 9) + "." + number(0, 20), path, path, lambda: "/" + path() + r.choice([".html", ".py", ".txt", "/", ".md", ".json"]),
        lambda: host() + "/" + path(), lambda: host() + "/" + path() + r.choice([".html", ".htm", ".php", ""]), host,
        lambda: f"{host()}/{word(3)}/{any_name()}/blob/{word(3)}/{path()}.{r.choice(['py', 'rs', 'go', 'js'])}",
        lambda: f"20{some(digits, 2)}-{some(digits, 2)}-{some(digits, 2)}-{name('kebab', r.randint(1, 6))}",
        lambda: f"20{some(digits, 2)}/{some(digits, 2)}/{some(digits, 2)}/{name('kebab', r.randint(2, 7))}",
        lambda: word(6) + word(6) + word(4), lambda: (word(8) + word(8)).upper(), lambda: word(5).capitalize() + word(6) + word(6),
        lambda: "-".join(some(digits, 2, 6) for _ in range(r.randint(3, 5))), lambda: ".".join(number(1, 255) for _ in range(r.randint(4, 7))),
        lambda: r.choice("=-_.") * r.randint(16, 40) + r.choice(["", some(digits, 1, 2)]), lambda: r.choice(digits + lower + "AX") * r.randint(16, 60),
        lambda: "20" + some(digits, 6) + "T" + some(digits, 6) + r.choice(["", "-" + word(2)]), lambda: f"{word(3)}-{number(0, 9)}.{number(0, 30)}.{number(0, 9)}-{word(2)}.{number(1, 9)}",
        lambda: f"{word(3)}={number(1, 999)}/{word(3)}={any_name()}")
    before = (lambda: words(4) + " ", lambda: words(3) + ' key = "', lambda: words(2) + " Bearer ", lambda: words(2) + "\nauth: ",
              lambda: words(3) + " (", lambda: words(3).upper() + "!! ", lambda: some(alnum, 8, 20) + " and ", lambda: some(digits, 16) + " ",
              lambda: words(2) + "$$$ ", lambda: words(2) + ": ", lambda: "")
    out = []
    for i in range(n):
        good = i % 3 == 0
        body = r.choice(secret if good else harmless)()
        while len(body) < SHORT:
            body = r.choice(secret if good else harmless)()
        left = r.choice(before)() if good or r.random() < 0.5 else words(4) + r.choice([" ", "\n", " (", " https://"])
        out.append((Example(left[-BEFORE:], body[:MOST], (r.choice(["", '"', ".", ",", " "]) + " " + words(2))[:BEHIND]), int(good)))
    return out


@lru_cache(maxsize=1)
def trained() -> CharCNN:
    """The network, trained on the labelled findings and calibrated on the held-out ones."""
    rows = labelled_findings()
    cut = int(len(rows) * (1 - HELD_OUT))
    x, y = [e for e, _ in rows], np.array([t for _, t in rows], float)
    return CharCNN().fit(x[:cut], y[:cut], EPOCHS).calibrate(x[cut:], y[cut:], RECALL)


def scan(texts: list[str], net: CharCNN) -> list[list[tuple[int, int, int]]]:
    """All (start, end, kind) spans of each text, by start and kind: the base spans, and the candidates to which
    the network gives at least its threshold. A stretch of a run that is found whole is not listed again."""
    found = [base_spans(t) for t in texts]
    asked = [(i, s, e) for i, t in enumerate(texts) for s, e in candidates(t, found[i])]
    for a in range(0, len(asked), 256):
        part = asked[a:a + 256]
        p = net.probability([Example(texts[i][max(0, s - BEFORE):s], texts[i][s:e], texts[i][e:e + BEHIND])
                             for i, s, e in part])
        for (i, s, e), v in zip(part, p):
            if v >= net.threshold and not (found[i] and found[i][-1][2] == 3 and e <= found[i][-1][1]):
                found[i].append((s, e, 3))
    return [sorted(f, key=lambda x: (x[0], x[2])) for f in found]


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


_COLUMNS = ("n_assign", "n_access", "n_hex", "base_sha256", "n_model", "spans")


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per row of ``docs``: key, counts of the base kinds and of the network's spans, SHA-256 of the base
    spans' list, and all spans (code points, end exclusive). NULL text counts as empty: no spans, the hash of the
    empty string. Repeated rows and rows without a key stay. Further columns are not read."""
    net = trained()
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType)]
                          + [T.StructField(c, T.StringType() if c in ("base_sha256", "spans") else T.LongType()) for c in _COLUMNS])

    def run(b: pa.RecordBatch) -> dict:
        found = scan([t or "" for t in b.column(1).to_pylist()], net)
        count = {f"n_{name}": [sum(x[2] == k for x in f) for f in found] for k, name in enumerate(KINDS)}
        base = [hashlib.sha256(_joined(x for x in f if x[2] < 3).encode()).hexdigest() for f in found]
        return {key: b.column(0)} | count | {"base_sha256": base, "spans": [_joined(f) for f in found]}

    return map_batches(docs.select(F.col(key), F.col(text)), run, schema)


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """``text`` with every span, overlapping ones as one, replaced by the mask."""
    out, at, i = [], 0, 0
    while i < len(spans):
        s, e = spans[i][:2]
        while i + 1 < len(spans) and spans[i + 1][0] < e:
            i += 1
            e = max(e, spans[i][1])
        out += [text[at:s], MASK]
        at, i = e, i + 1
    return "".join(out) + text[at:]


def redact_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the secrets in ``text`` replaced by the mask; all other columns and NULL texts stay."""
    net = trained()
    at = docs.columns.index(text)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = b.column(at).to_pylist()
        new = [t if t is None else redact(t, f) if f else t for t, f in zip(texts, scan([t or "" for t in texts], net))]
        return pa.RecordBatch.from_arrays([pa.array(new, b.schema.field(at).type) if i == at else c
                                           for i, c in enumerate(b.columns)], schema=b.schema)

    return map_batches(docs, run, docs.schema)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))
