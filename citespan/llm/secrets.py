"""Secrets in text: fixed patterns, and a linear-chain conditional random field for what they miss.

The field labels tokens B (a secret begins), I (it goes on) or O.  A token's features are its shape, the
words and signs beside it, and traits of the file; weights and label transitions are fitted by
maximum likelihood (forward-backward), labels decoded by Viterbi.  A secret may begin at a token that looks
random (``_CANDIDATE``) and at any token of ``_KEYED_CHARS`` characters or more that follows a key word, whatever
it looks like; it may go on over signs and tokens joined to it.  All other tokens are O by constraint.  A
chain falls apart at a token whose label is fixed, and windows round the free tokens hold all that their
features look at, so decoding the windows gives what decoding the whole text would.

Training labels come from the fixed patterns over a bounded sample of documents (``TRAIN_DOCS``) and of
their runs of tokens (``TRAIN_RUNS``), and from all lines written here (``_seed``), so that a corpus without secrets still gives a model.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import claim, cut, fresh, table

#: Documents read for training at most: with a fixed pattern's match, and without.
TRAIN_DOCS = 400
#: Characters of the training documents together; they are read whole, as many as fit.
TRAIN_CHARS = 8_000_000
#: Runs of tokens of those documents that the field is fitted on at most, drawn by hash; the written lines come on top.
TRAIN_RUNS = 4000

# The base patterns and the least lengths of their matches.
_ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "crf")

_CANDIDATE = re.compile(r"(?=[A-Za-z+/_-]{0,64}[0-9])(?=[0-9+/_-]{0,64}[A-Za-z])[A-Za-z0-9+/_-]{8,}|(?:gh[pousr]_|sk[_-]|pk_|xox|eyJ|AIza|glpat-|npm_)[A-Za-z0-9+/_-]{5,}|[A-Za-z0-9+/]{32,}={0,2}")
_TOKEN = re.compile(r"[A-Za-z0-9+/_-]+|[^\sA-Za-z0-9+/_-]")
_JOINT = frozenset(".=:~")
#: Characters of a token that is free because it follows a key word, signs between them, and how far apart they are.
_KEYED_CHARS, _KEYED_SIGNS, _KEYED_GAP = 6, 4, 8
#: Tokens before and after a free one that its features look at.
_BEFORE, _AFTER = _KEYED_SIGNS + 1, 1
B, I, O = 0, 1, 2

# Words that stand beside secrets, and beside harmless identifiers.
_KEY_WORDS = frozenset("password passwd pwd pass passphrase secret secrets token tokens key keys apikey api_key auth authorization bearer credential credentials private access client_secret access_key secret_key".split())
_ID_WORDS = frozenset("id uuid commit sha sha1 sha256 md5 hash checksum version build revision isbn doi phone tel order invoice ref issue page model serial part http https www url href src".split())
# The end of a key word and what may stand between it and a token that is free for it; ``_keyed`` decides.
_KEYED = re.compile(
    r"(?i)(?:pwd|pass|passwd|password|passphrase|secrets?|tokens?|keys?|apikey|auth|authorization|bearer|credentials?|private|access)(?![A-Za-z0-9+/_-])"
    r"[^A-Za-z0-9+/_-]{1,8}(?=[A-Za-z0-9+/_-]{6})"
)
_KEYED_SIGN_WORDS = ("pwd", "pass", "secret", "token", "key", "auth", "bearer", "credential", "private", "access")
_PREFIXES = ("ghp_", "gho_", "sk_", "sk-", "pk_", "xox", "AKIA", "ASIA", "eyJ", "AIza", "glpat-", "npm_", "SG")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns' matches, leftmost and not overlapping within a kind."""
    out = []
    lower = text.lower()
    if any(w in lower for w in _ASSIGN_WORDS):
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return out


def in_order(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in in_order(spans))


# --- features -------------------------------------------------------------------------------------

_LENGTHS = (4, 8, 12, 16, 20, 24, 32, 40, 64)
_SHAPES = [f"len{i}" for i in range(len(_LENGTHS) + 1)] + [
    "digit", "upper", "lower", "mixed", "sign", "hex", "digits only", "one digit run at an end", "changes0", "changes1", "changes2",
    "entropy0", "entropy1", "entropy2", "entropy3", "prefix", "joint", "quote", "candidate", "few vowels", "consonants", "one case word", "hyphens", "keyed by a sign", "keyed by a space",
]
_SIDES = [f"{side} {what}" for side in ("prev1", "prev2", "prev3", "next1") for what in ("key word", "id word", "= or :", "quote", "word", "number", "slash", "at", "none")]
_FILE = ["many candidates", "no candidate but one", "few words", "code signs"]
FEATURES = {name: i for i, name in enumerate([*_SHAPES, *_SIDES, *_FILE, "any"])}


_CONSONANTS = re.compile(r"(?i)[bcdfghjklmnpqrstvwxz]{4}")


def _shape(t: str) -> list[str]:
    n = len(t)
    out = [f"len{sum(n >= x for x in _LENGTHS)}"]
    d, u, lo = sum(c.isdigit() for c in t), sum("A" <= c <= "Z" for c in t), sum("a" <= c <= "z" for c in t)
    out += ["digit"] * (d > 0) + ["upper"] * (u > 0) + ["lower"] * (lo > 0) + ["mixed"] * (u > 0 and lo > 0) + ["sign"] * (d + u + lo < n)
    out += ["hex"] * bool(n > 7 and re.fullmatch("[0-9a-f]+", t)) + ["digits only"] * (d == n)
    out += ["one digit run at an end"] * bool(re.fullmatch("[A-Za-z]+[0-9]+|[0-9]+[A-Za-z]+", t))
    kinds = ["d" if c.isdigit() else "a" if c.isalpha() else "s" for c in t]
    changes = sum(a != b for a, b in zip(kinds, kinds[1:])) / max(1, n - 1)
    out.append("changes0" if changes < 0.15 else "changes1" if changes < 0.35 else "changes2")
    counts = [t.count(c) for c in set(t)]
    entropy = -sum(c / n * math.log2(c / n) for c in counts)
    out.append(f"entropy{sum(entropy >= x for x in (2.5, 3.2, 3.8))}")
    out += ["prefix"] * t.startswith(_PREFIXES) + ["joint"] * (t in _JOINT) + ["quote"] * (t in "\"'`")
    out += ["consonants"] * bool(_CONSONANTS.search(t))
    out += ["few vowels"] * (d + u + lo > 5 and sum(c in "aeiouyAEIOUY" for c in t) < 0.2 * (u + lo)) + ["one case word"] * bool(re.fullmatch("[A-Z]?[a-z]+|[A-Z]+", t)) + ["hyphens"] * (t.count("-") > 1)
    return out + ["candidate"] * bool(_CANDIDATE.fullmatch(t))


def _side(t: str | None) -> str:
    if t is None:
        return "none"
    low = t.lower()
    if low in _KEY_WORDS or any(low.endswith(w) for w in ("password", "secret", "token", "_key", "apikey", "passwd")):
        return "key word"
    if low in _ID_WORDS:
        return "id word"
    return "= or :" if t in "=:" else "quote" if t in "\"'`" else "at" if t == "@" else "number" if t.isdigit() else "slash" if t in "/#&?%" else "word"


def _is_key(t: str) -> bool:
    return _side(t) == "key word"


def _keyed(tokens: list[tuple[str, int, int]], i: int) -> str:
    """How a token follows a key word: by a sign, by a space, or not at all ('')."""
    t, start, _ = tokens[i]
    if len(t) < _KEYED_CHARS:
        return ""
    for j in range(i - 1, max(-1, i - 2 - _KEYED_SIGNS), -1):
        word, _, end = tokens[j]
        if start - end > _KEYED_GAP:
            return ""
        if len(word) > 1 or word.isalnum():
            return "" if not _is_key(word) else "sign" if any(x in ":=" for x, _, _ in tokens[j + 1 : i]) else "space"
    return ""


def _free(tokens: list[tuple[str, int, int]]) -> np.ndarray:
    """Whether B or I is allowed, for a run of tokens."""
    free = np.zeros(len(tokens), bool)
    for i, (t, s, _) in enumerate(tokens):
        beside = i > 0 and free[i - 1] and tokens[i - 1][2] == s
        free[i] = bool(_CANDIDATE.fullmatch(t)) or beside and (t in _JOINT or len(t) >= 4 and not t.isalpha()) or bool(_keyed(tokens, i))
    return free


def _tokens(text: str, lo: int, hi: int) -> list[tuple[str, int, int]]:
    return [(m.group(), m.start(), m.end()) for m in _TOKEN.finditer(text, lo, hi)]


_INNER = re.compile(r"[A-Za-z0-9+/_-]*")


def _reach_back(text: str, at: int) -> int:
    """Where the _BEFORE tokens before ``at`` start, or so far back that they are too far to count."""
    size = 64
    while True:
        lo = max(0, at - size)
        while lo and text[lo - 1 : lo + 1].isascii() and _INNER.fullmatch(text[lo - 1 : lo + 1]):  # not within a token
            lo -= 1
        found = _tokens(text, lo, at)
        if lo == 0 or len(found) >= _BEFORE:
            return found[-_BEFORE][1] if len(found) >= _BEFORE else 0
        size *= 4


def windows(text: str) -> list[list[tuple[str, int, int]]]:
    """Runs of tokens (text, start, end) round all that may be free; runs that meet are one."""
    starts = [m.start() for m in _CANDIDATE.finditer(text)]
    lower = text.lower()
    if any(w in lower for w in _KEYED_SIGN_WORDS):
        starts = sorted({*starts, *(m.end() for m in _KEYED.finditer(text))})
    out: list[list[tuple[str, int, int]]] = []
    done = 0
    for at in starts:
        if out and at < done:
            continue
        lo = _reach_back(text, at)
        if out and lo <= out[-1][-1][2]:
            run, lo = out[-1], out[-1][-1][2]
        else:
            run = []
            out.append(run)
        hi = _INNER.match(text, at).end()
        run += _tokens(text, lo, max(hi, at + 1))
        # On over all that is joined to it, and one token more.
        while (m := _TOKEN.search(text, run[-1][2])) is not None:
            joined = m.start() == run[-1][2]
            run.append((m.group(), m.start(), m.end()))
            if not joined:
                break
        done = run[-1][2]
    return out


def features(tokens: list[tuple[str, int, int]], file: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(matrix of 0 and 1, whether B or I is allowed) for a run of tokens."""
    x = np.zeros((len(tokens), len(FEATURES)), np.float32)
    free = _free(tokens)
    words = [t for t, _, _ in tokens]
    for i, t in enumerate(words):
        if not free[i]:
            continue
        how = _keyed(tokens, i)
        names = _shape(t) + [f"keyed by a {how}"] * bool(how) + [f"prev{k} {_side(words[i - k] if i >= k else None)}" for k in (1, 2, 3)]
        names += [f"next1 {_side(words[i + 1] if i + 1 < len(words) else None)}", *file, "any"]
        x[i, [FEATURES[n] for n in names]] = 1
    return x, free


def file_features(text: str, runs: int) -> list[str]:
    n = max(1, len(text))
    out = ["many candidates"] * (runs > 5) + ["no candidate but one"] * (runs == 1)
    return out + ["few words"] * (n < 200) + ["code signs"] * (sum(text.count(c) for c in "{};=") / n > 0.02)


# --- the field ------------------------------------------------------------------------------------


class Field:
    """Weights of features by label, of label pairs, and of the first label."""

    def __init__(self, emit: np.ndarray, move: np.ndarray):
        self.emit, self.move = emit, move

    def potentials(self, x: np.ndarray, free: np.ndarray) -> np.ndarray:
        e = x @ self.emit
        e[~free, B] = e[~free, I] = -1e9
        e[~free, O] = 0
        return e

    def viterbi(self, x: np.ndarray, free: np.ndarray) -> list[int]:
        e = self.potentials(x, free)
        best, back = e[0].copy(), []
        best[I] = -1e9  # nothing goes on at the start
        for row in e[1:]:
            at = best[:, None] + self.move
            back.append(at.argmax(axis=0))
            best = at.max(axis=0) + row
        path = [int(best.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        return path[::-1]


def _lse(a: np.ndarray, axis: int) -> np.ndarray:
    m = a.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(a - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def fit(runs: list[tuple[np.ndarray, np.ndarray, list[int]]], steps: int = 180, ridge: float = 0.005) -> Field:
    """Maximum likelihood of labelled runs (features, free, labels), by Adam on forward-backward sums."""
    n, width = len(runs), max(len(y) for _, _, y in runs)
    k = len(FEATURES)
    x, free = np.zeros((n, width, k), np.float32), np.zeros((n, width), bool)
    y, on = np.full((n, width), O), np.zeros((n, width), bool)
    for r, (a, f, labels) in enumerate(runs):
        m = len(labels)
        x[r, :m], free[r, :m], y[r, :m], on[r, :m] = a, f, labels, True
    field = Field(np.zeros((k, 3)), np.array([[-1.0, 0, 0], [-1, 0, 0], [0, -1e9, 0]]))
    frozen = np.array([[0, 0, 0], [0, 0, 0], [0, 1, 0]], bool)
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (field.emit, field.move)]
    gold = np.eye(3)[y] * on[:, :, None]
    pairs = np.einsum("ntp,ntq->pq", gold[:, :-1], gold[:, 1:])
    for step in range(1, steps + 1):
        e = x @ field.emit
        e[~free] = (-1e9, -1e9, 0)
        fwd, bwd = np.zeros_like(e), np.zeros_like(e)
        fwd[:, 0] = e[:, 0] + (0, -1e9, 0)
        for t in range(1, width):
            fwd[:, t] = _lse(fwd[:, t - 1, :, None] + field.move, 1) + e[:, t]
        for t in range(width - 2, -1, -1):
            bwd[:, t] = _lse(field.move + (e[:, t + 1] + bwd[:, t + 1])[:, None, :], 2)
        total = _lse(fwd[:, -1], 1)
        p = np.exp(fwd + bwd - total[:, None, None]) * on[:, :, None]
        seen = np.exp(fwd[:, :-1, :, None] + field.move + (e + bwd)[:, 1:, None, :] - total[:, None, None, None]) * on[:, 1:, None, None]
        grads = [np.einsum("ntk,ntl->kl", x, gold - p) / n - ridge / 10 * field.emit, (pairs - seen.sum(axis=(0, 1))) / n - ridge / 10 * field.move]
        grads[1][frozen] = 0
        for w, g, (m1, m2) in zip((field.emit, field.move), grads, moments):
            m1 += 0.1 * (g - m1)
            m2 += 0.01 * (g * g - m2)
            w += 0.1 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
    return field


def _labels(tokens: list[tuple[str, int, int]], free: np.ndarray, spans: list[tuple[str, int, int]]) -> list[int]:
    """B and I for the tokens of a span's value: those that end where a span ends, and free ones before."""
    out = []
    for i, (_, s, e) in enumerate(tokens):
        inside = free[i] and any(a <= s and e <= b for _, a, b in spans)
        out.append(O if not inside else I if i and out[-1] != O and tokens[i - 1][2] == s else B)
    return out


# Common words that stand after key words in running text.
_PLAIN = (
    "garden policy required manager economy holder factor through another between important question service account feature chapter control element letters message meeting number office people person present problem program "
    "project reason result school sector simple single social someone station student subject support system teacher thought together towards village without writing"
).split()


# Written lines: what stands round a value ({k} a key word, {v} the value).
_KEYED_LINES = ("{k}: {v}", "{k}={v}", "{k} = '{v}'", '"{k}": "{v}"', "the {k} is {v} ok", "{k} {v} now", "my {k}: {v}, please", "export {k}={v}")
_BARE_LINES = ("see {v} there", "x = {v}", "({v})", "and {v}, then", "export GITHUB={v}", "url: {v}", "{v}", "use '{v}' now")
_KEYS = ("password", "pwd", "passphrase", "secret", "token", "api_key", "authorization", "bearer", "credentials", "private_key", "client_secret", "access_key", "auth", "secret_key", "Authorization: Bearer")
_ID_LINES = ("commit {v} of it", "the id {v} of the row", "order {v} was sent", "version {v} is out", "mail {v} now", "see {v} there", "model {v}, new", "ref: {v}", "https://example.org/{v}/b", "call {v} today", "{v}")


def _seed() -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Written lines with values made from digests: some are secrets, some harmless.

    Values with a known beginning are secrets anywhere, random ones after a key word; numbers, ids and
    versions are harmless, and so are common words after key words.
    """
    import base64

    out = []
    for i in range(360):
        h = hashlib.sha256(f"seed {i}".encode()).digest() + hashlib.sha256(f"more {i}".encode()).digest()
        b64, hx, num = base64.b64encode(h).decode().rstrip("="), h.hex(), str(int.from_bytes(h[:12], "big"))
        safe = b64.replace("/", "x").replace("+", "y")
        letters = "".join(chr(97 + c % 26) for c in h)
        plain = [_PLAIN[c % len(_PLAIN)] for c in h[:4]]
        n = h[5] % 12
        begun = (f"ghp_{safe[:36]}", f"sk_live_{safe[:24]}", f"eyJ{safe[:20]}.eyJ{safe[5:30]}.{safe[8:40]}", f"xoxb-{num[:11]}-{safe[:24]}", f"glpat-{safe[:20]}", f"npm_{safe[:36]}", f"AIza{safe[:35]}")
        random = (b64[: 40 - n], safe[: 10 + n], letters[: 10 + n], hx[: 24 + n], "-".join(plain), letters[: 8 + n].upper(), f"{plain[0].title()}{num[: 2 + n // 3]}!", safe[: 24 + n])
        harmless = (
            f"{num[:8]}A1", f"page{num[:2]}", f"978-{num[:10]}", f"v{num[0]}-{num[1:3]}-beta{num[4]}", f"user{num[:4]}@example.org", f"AB-{num[:4]}-X1", f"{hx[:8]}-{hx[8:12]}-4{hx[13:16]}-a{hx[17:20]}-{hx[20:32]}", hx[: 7 + n // 3], num[: 10 + n // 2],
            f"10-{num[:3]}-{num[3:7]}", f"a{num[:5]}", f"{num[:2]}.{num[2:4]}.{num[4:6]}", f"2{num[:3]}-0{num[4]}-1{num[5]}T0{num[6]}:30", f"{plain[0]}-{plain[1]}-{plain[2]}-{num[:3]}", f"utf-{num[0]}x{num[1:3]}",
        )
        k = _KEYS[i % len(_KEYS)]
        for value, line, secret in (
            (begun[i % len(begun)], (_KEYED_LINES + _BARE_LINES)[h[0] % 16], True),
            (random[i % len(random)], _KEYED_LINES[h[1] % len(_KEYED_LINES)], True),
            (harmless[i % len(harmless)], _ID_LINES[h[2] % len(_ID_LINES)], False),
            (plain[1], _KEYED_LINES[h[3] % len(_KEYED_LINES)], False),
        ):
            text = f"some words and {line.replace('{k}', k)} then more words"
            at = text.index("{v}")
            out.append((text.replace("{v}", value), [("crf", at, at + len(value))] if secret else []))
    return out


def _runs(lines) -> Iterator[tuple[bytes, list[tuple[str, int, int]], list[str], list[tuple[str, int, int]]]]:
    """(hash of its place, tokens, file features, spans) of each run with a free token, 40 tokens at most."""
    for no, (text, spans) in enumerate(lines):
        found = windows(text)
        file = file_features(text, len(found))
        for tokens in found:
            for i in range(0, len(tokens), 40):
                part = tokens[i : i + 40]
                if _free(part).any():
                    yield hashlib.md5(f"{no} {part[0][1]}".encode()).digest(), part, file, spans


def train(texts: list[str]) -> Field:
    """Fit the field on all written lines, and on TRAIN_RUNS runs of texts labelled by the fixed patterns."""
    drawn = heapq.nsmallest(TRAIN_RUNS, _runs((t, base_spans(t)) for t in texts), key=lambda r: r[0])
    runs = []
    for _, part, file, spans in [*_runs(_seed()), *drawn]:
        x, free = features(part, file)
        runs.append((x, free, _labels(part, free, spans)))
    return fit(runs)


def find(text: str, field: Field) -> list[tuple[str, int, int]]:
    """All spans: the fixed patterns', and the field's that reach beyond each of those."""
    base = base_spans(text)
    found = windows(text)
    if not found:
        return base
    file, out = file_features(text, len(found)), []
    for tokens in found:
        x, free = features(tokens, file)
        start = None
        labels = field.viterbi(x, free) + [O]
        for i, label in enumerate(labels):
            if start is not None and label != I:
                out.append(("crf", tokens[start][1], tokens[i - 1][2]))
                start = None
            if label == B:
                start = i
    taken = [(s, e) for _, s, e in base]
    return base + [x for x in out if not any(s <= x[1] and x[2] <= e for s, e in taken)]


SPANS = "spans array<struct<kind string, start long, end long>>"


def train_on(docs: DataFrame) -> Field:
    """The field for docs, from a bounded sample: of the documents with a fixed pattern's sign and of
    those without, the TRAIN_DOCS and a quarter of that with the smallest hash of the text, and of these,
    in that order, as many whole texts as have TRAIN_CHARS together."""
    sign = F.col("text").rlike(r"(?i)(password|passwd|secret|token|api_?key)[\"']?\s?[:=]|AKIA[A-Z0-9]{16}|[0-9a-f]{24}")
    hashed = cut(docs.filter("text IS NOT NULL").select(F.xxhash64("text").alias("h"), sign.alias("sign"), F.length("text").alias("n")).distinct())
    chosen, size = [], 0
    drawn = [hashed.filter(F.col("sign") == on).orderBy("h", "n").limit(n).collect() for on, n in ((True, TRAIN_DOCS), (False, TRAIN_DOCS // 4))]
    for r in sorted((r for part in drawn for r in part), key=lambda r: (r.h, r.n)):
        if size + r.n <= TRAIN_CHARS:
            chosen.append(r.h)
            size += r.n
    if not chosen:
        return train([])
    of_hash = docs.filter(F.xxhash64("text").isin(chosen)).groupBy(F.xxhash64("text").alias("h")).agg(F.min("text").alias("text"))
    return train([r.text for r in sorted(of_hash.collect())])


def scan(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """docs and a column ``spans`` of (kind, start, end) in code points, end exclusive, by start.

    Texts are read whole; null counts as empty and has no spans.  Repeated rows give repeated results.
    If docs has a column named spans, the new one is named spans_.
    """
    field = field or train_on(docs)
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("secrets")
        f = shared.value
        for batch in batches:
            at = batch.schema.get_field_index("text")
            got = [[{"kind": k, "start": s, "end": e} for k, s, e in in_order(find(t.as_py() or "", f))] for t in batch.column(at)]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, kind)], names=[*batch.schema.names, name])

    name = fresh(docs, "spans")
    fields = [f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema.fields]
    return docs.mapInArrow(spans, ", ".join([*fields, SPANS.replace("spans", name, 1)]))


def redact(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """docs with each secret replaced by ``[SECRET]``; overlapping spans are one.  n_chars follows."""
    field = field or train_on(docs)
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def masked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("secrets")
        f = shared.value
        for batch in batches:
            at = batch.schema.get_field_index("text")
            got = [None if not t.is_valid else _masked(t.as_py(), find(t.as_py(), f)) for t in batch.column(at)]
            columns = list(batch.columns)
            columns[at] = pa.array(got, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    out = docs.mapInArrow(masked, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def _masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    parts, at = [], 0
    for _, s, e in in_order(spans):
        if s >= at:
            parts += [text[at:s], "[SECRET]"]
        at = max(at, e)
    return "".join([*parts, text[at:]])


def _kind_is(kind: str):
    return lambda s: s["kind"] == kind


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' secrets, as counts and digests of their spans."""
    found = scan(table(spark, sf_dir, "documents", "doc_id", "text"))
    n = {k: F.size(F.filter("spans", _kind_is(k))).cast("long").alias(f"n_{k}") for k in KINDS[:3]}
    text = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = text(F.filter("spans", lambda s: s["kind"] != "crf"))
    return found.select(F.col("doc_id").cast("long"), *n.values(), F.sha2(base.cast("binary"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
